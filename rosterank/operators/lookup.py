"""Equi-joins against a smaller table: broadcast behind a counted bound, skew-split shuffle join beyond it."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rosterank.staging import stage

MAX_BROADCAST_ROWS = 1_000_000
HOT_ROWS = 1_000_000
SALTS = 32


def at_most(df: DataFrame, rows: int) -> bool:
    return df.limit(rows + 1).count() <= rows


def join_lookup(
    facts: DataFrame,
    lookup: DataFrame,
    on: Sequence[str],
    *,
    how: str = "inner",
    spread_by: str,
    bounded_by: DataFrame | None = None,
    heat: str | None = None,
    max_rows: int = MAX_BROADCAST_ROWS,
    hot_rows: int = HOT_ROWS,
) -> DataFrame:
    """Join ``facts`` to ``lookup`` (``inner``, ``left``, ``left_semi`` or ``left_anti``).

    ``bounded_by`` names a table with at least as many rows as ``lookup`` that is cheaper to count (a written
    one). Past the broadcast bound both sides are shuffled. There a hot key (a word every text holds) would land
    in one task, so keys with more than ``hot_rows`` facts are split over salts by ``spread_by`` and only their
    lookup rows are repeated. ``heat`` is a lookup column that already holds the number of facts per key;
    without it the facts are counted. Hot keys are few by definition: at most facts / hot_rows.
    """
    if at_most(lookup if bounded_by is None else bounded_by, max_rows):
        return facts.join(F.broadcast(lookup), list(on), how)
    keys = list(on)
    if heat is None:
        busy = facts.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") > hot_rows)
    else:
        busy = lookup.filter(F.col(heat) > hot_rows)
    hot = stage(busy.select(*keys).distinct().withColumn("_hot", F.lit(True)), "hot-keys")
    if hot.isEmpty() or not at_most(hot, max_rows):
        return facts.join(lookup, keys, how)
    spread = F.when(F.col("_hot"), F.pmod(F.xxhash64(spread_by), F.lit(SALTS)).cast("int")).otherwise(F.lit(0))
    copies = F.sequence(F.lit(0), F.when(F.col("_hot"), F.lit(SALTS - 1)).otherwise(F.lit(0)))
    salted = facts.join(F.broadcast(hot), keys, "left").withColumn("_salt", spread).drop("_hot")
    repeated = lookup.join(F.broadcast(hot), keys, "left").withColumn("_salt", F.explode(copies)).drop("_hot")
    return salted.join(repeated, [*keys, "_salt"], how).drop("_salt")
