"""Helpers that several operators of this subpackage share."""

from __future__ import annotations

import gc
import tempfile
import uuid
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of serialised rows that one Python task takes at a time.
ARROW_ROWS = 2000


def shared_dir(spark: SparkSession, label: str) -> str:
    """A new folder name under ``spark.checkpoint.dir``; only a plain local session may go without that setting."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        master = spark.sparkContext.master
        if not (master == "local" or master.startswith("local[")):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        root = tempfile.mkdtemp(prefix="rosterank-llm-")
        spark.conf.set("spark.checkpoint.dir", root)
    return f"{root.rstrip('/')}/{label}-{uuid.uuid4().hex}"


def stage(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` to the shared folder and go on from the written table: lineage ends, lost executors cost nothing."""
    spark = df.sparkSession
    path = shared_dir(spark, label)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


#: Bound on the keys that ``join_hot`` broadcasts, and the rows below which no key is hot.
HOT, HOT_LEAST = 1 << 16, 1000


def join_hot(facts: DataFrame, lookup: DataFrame, on: str | list[str]) -> DataFrame:
    """Inner join of written ``facts`` to ``lookup``, which has one row per key and the number of its facts in ``times``.

    Keys that hold more than 1 in ``HOT`` of all facts meet them by broadcast: there are fewer than ``HOT`` of them,
    whatever the data, because the numbers sum to the facts at most. All other keys are shuffled and hold at most that share.
    """
    keys = [on] if isinstance(on, str) else on
    bar = F.lit(max(HOT_LEAST, facts.count() // HOT))
    hot = F.broadcast(lookup.where(F.col("times") > bar).drop("times"))
    cold = lookup.where(F.col("times") <= bar).drop("times")
    others = facts.join(hot.select(*keys), keys, "left_anti")  # before the shuffle
    return facts.join(hot, keys).unionByName(others.join(cold.hint("merge"), keys))


def release(spark: SparkSession) -> None:
    """Let Spark's cleaner drop the shuffle files of stages whose results are written: a size-neutral housekeeping."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def columns(df: DataFrame, **wanted: str) -> DataFrame:
    """Only the named columns, cast; other columns (also those whose names clash with ours) are left behind."""
    return df.select(*[F.col(f"`{name}`").cast(kind).alias(name) for name, kind in wanted.items()])


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def buckets_for(spark: SparkSession, size: float, bucket_bytes: int = 24 << 20) -> int:
    """So many buckets that each holds about ``bucket_bytes`` at most, and every shuffle slot has one."""
    return int(max(shuffle_partitions(spark), -(-size // bucket_bytes)))


def crc32_mod3(doc_id: Column) -> Column:
    return F.crc32(doc_id.cast("string").cast("binary")) % 3


def held_out(doc_id: Column) -> Column:
    """True for the rows kept out of training; a null id counts as held out."""
    return F.coalesce(crc32_mod3(doc_id) == 1, F.lit(True))


def any_null(names: Iterable[str]) -> Column:
    out = F.lit(False)
    for name in names:
        out = out | F.col(name).isNull()
    return out
