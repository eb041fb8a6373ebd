"""Written intermediate tables: they cut lineage, survive lost executors and give the planner real sizes."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_SETTING = "spark.checkpoint.dir"


def staging_root(spark: SparkSession) -> str:
    """The shared folder named by the session; a temporary folder only for a local session without one."""
    root = spark.conf.get(_SETTING, None)
    if root:
        return root.rstrip("/")
    master = spark.sparkContext.master
    if not (master == "local" or master.startswith("local[")):
        raise RuntimeError(f"set {_SETTING} to a folder every executor can reach")
    root = tempfile.mkdtemp(prefix="rosterank-")
    atexit.register(shutil.rmtree, root, ignore_errors=True)  # a shared folder belongs to the cluster and is left to it
    spark.conf.set(_SETTING, root)
    return root


def stage(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` once as parquet and continue from the written table."""
    path = f"{staging_root(df.sparkSession)}/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
