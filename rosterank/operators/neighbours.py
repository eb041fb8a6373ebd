"""Next row in order within a group, for groups too large for one window task."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from rosterank.staging import stage


def with_next(df: DataFrame, key: str, order: Sequence[str], columns: Sequence[str], prefix: str = "next_") -> DataFrame:
    """Add ``prefix + column`` from the following row of the same ``key`` (NULL on the last row).

    A plain ``lead`` puts a whole group in one task. Here the rows are range-partitioned on (key, order), so a
    large group covers several ranges; ``lead`` runs inside a range, and the one row per range and key whose
    successor starts the next range gets it from a table of range heads.
    """
    ranged = stage(
        df.repartitionByRange(key, *order).withColumn("_range", F.spark_partition_id()), "ordered"
    )
    inside = Window.partitionBy("_range", key).orderBy(*order)
    across = Window.partitionBy(key).orderBy("_range")
    payload = F.struct(*[F.col(c) for c in columns])
    led = ranged.withColumn("_next", F.lead(payload).over(inside)).withColumn(
        "_last", F.lead(F.lit(True), 1, False).over(inside) == F.lit(False)
    )
    heads = (
        ranged.groupBy(key, "_range")
        .agg(F.min_by(payload, F.struct(*[F.col(c) for c in order])).alias("_head"))
        .withColumn("_following", F.lead("_head").over(across))
        .select(F.col(key), F.col("_range"), F.lit(True).alias("_last"), "_following")
        .filter(F.col("_following").isNotNull())
    )
    joined = led.join(heads, [key, "_range", "_last"], "left").withColumn(
        "_next", F.coalesce("_next", "_following")
    )
    return joined.select(
        *[F.col(c) for c in df.columns], *[F.col("_next")[c].alias(prefix + c) for c in columns]
    )
