"""Exact top-n per group without sending a whole group through one task."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def top_per_group(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[Column],
    n: int,
    *,
    spread_by: Sequence[str],
    spread: int = 64,
    rank_column: str = "rank",
) -> DataFrame:
    """Rows ranked 1..n in every group.

    Two rounds: first inside (group, salt), then over the at most ``spread * n`` rows left per group. Both
    rounds filter on row_number, so Spark also cuts each map partition to n rows before either shuffle.
    """
    salted = df.withColumn("_salt", F.pmod(F.xxhash64(*spread_by), F.lit(spread)))
    local = Window.partitionBy(*keys, "_salt").orderBy(*order)
    final = Window.partitionBy(*keys).orderBy(*order)
    heads = salted.withColumn("_place", F.row_number().over(local)).filter(F.col("_place") <= n)
    return (
        heads.drop("_salt", "_place")
        .withColumn(rank_column, F.row_number().over(final))
        .filter(F.col(rank_column) <= n)
    )
