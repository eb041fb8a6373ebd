"""Gates of any number of descriptions, met by signatures of profiles instead of by profiles.

All that the experience and location gates see of a profile is its signature: whole years below and above, whether it
moves, and which of the descriptions' places it names. There are few signatures, however many profiles share them. They
meet the descriptions by equality on two indexes at once:

* Years: a range is cut into blocks of 1, 2, 4, ... years (at most two of each size); a year lies in one block per size.
* Places: an inverted list place -> descriptions, with one entry for descriptions without places and one for all movers.

So nothing grows with profiles times descriptions but the matches themselves, and profiles are scanned once.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rosterank.functions import gates
from rosterank.functions.basics import once, strings
from rosterank.staging import stage

SIGNATURE = ["years_low", "years_high", "moves", "hits"]
#: Years are shifted to be non-negative and cut off at 2 ** SIZES; beyond lie only ranges that were never meant.
SIZES, SHIFT = 52, 1 << 20
#: Entries of the place index that are no places: for profiles that move, and for descriptions without places.
MOVERS, ANYWHERE = "\x01movers", "\x01anywhere"


def _position(years: Column) -> Column:
    return F.least(F.greatest(years.cast("double") + SHIFT, F.lit(0.0)), F.lit(float(1 << SIZES))).cast("bigint")


def places_of(features: DataFrame) -> list[str]:
    """All places that descriptions name. Descriptions take them from one vocabulary of cities, which bounds the list."""
    found = features.select(F.explode("locations").alias("place")).distinct().collect()
    return sorted(r["place"] for r in found)


def with_signature(profiles: DataFrame, places: Sequence[str]) -> DataFrame:
    """``profiles`` with the columns SIGNATURE."""
    years = F.coalesce(F.col("profile.years_of_experience"), F.lit(0.0))
    where = gates.whereabouts(F.col("profile.location"), F.col("profile.country"), F.col("signals.willing_to_relocate"))
    none = F.array().cast("array<string>")
    hits = once(
        where,
        lambda w: F.when(w["home"] & ~w["moves"], F.filter(strings(places), lambda t: F.contains(w["place"], t))).otherwise(none),
    )
    return profiles.select(
        "*",
        _position(F.floor(years)).alias("years_low"),
        _position(F.ceil(years)).alias("years_high"),
        F.coalesce("signals.willing_to_relocate", F.lit(False)).alias("moves"),
        hits.alias("hits"),
    )


def _blocks(low: Column, high: Column) -> Column:
    """array<struct<size, block>>: the fewest blocks of 2 ** size years that make up low to high."""
    none = F.array().cast("array<struct<size:int,block:bigint>>")
    start = F.struct(low.alias("a"), (high + 1).alias("b"), none.alias("out"))

    def step(acc: Column, size: Column) -> Column:
        a, b = acc["a"], acc["b"]
        open_ = a < b
        first = F.when(open_ & (a % 2 == 1), F.array(F.struct(size.alias("size"), a.alias("block")))).otherwise(none)
        last = F.when(open_ & (b % 2 == 1) & ((a + a % 2) < b), F.array(F.struct(size.alias("size"), (b - 1).alias("block")))).otherwise(none)
        return F.struct(
            F.shiftright(a + a % 2, 1).alias("a"), F.shiftright(b - b % 2, 1).alias("b"), F.concat(acc["out"], first, last).alias("out")
        )

    return F.aggregate(F.sequence(F.lit(0), F.lit(SIZES)), start, step)["out"]


def _description_keys(features: DataFrame, use_location: bool) -> DataFrame:
    listed = F.when(F.size("locations") > 0, F.col("locations")).otherwise(F.array(F.lit(ANYWHERE)))
    names = F.array_distinct(F.concat(F.array(F.lit(MOVERS)), listed)) if use_location else F.array(F.lit(ANYWHERE))
    blocks = features.select("jd_id", _position(F.col("exp_max")).alias("exp_max"), names.alias("names"), F.inline(_blocks(_position(F.col("exp_min")), _position(F.col("exp_max")))))
    return stage(blocks.select("jd_id", "exp_max", "size", "block", F.explode("names").alias("name")), "description-index")


def _own_names(use_location: bool) -> Column:
    if not use_location:
        return F.array(F.lit(ANYWHERE))
    return F.when(F.col("moves"), F.array(F.lit(MOVERS))).otherwise(F.concat(F.array(F.lit(ANYWHERE)), "hits"))


def match_signatures(signatures: DataFrame, features: DataFrame, *, use_location: bool = True) -> DataFrame:
    """(SIGNATURE, jd_id): each signature, of rows without repeats, with the descriptions whose gates it passes."""
    index = _description_keys(features, use_location)
    sizes = sorted(r["size"] for r in index.select("size").distinct().collect())  # SIZES + 1 at most
    if not sizes:
        return signatures.select(*SIGNATURE, F.lit(None).cast("string").alias("jd_id")).where("false")
    own = signatures.select(*SIGNATURE, F.explode(F.array(*[F.lit(s) for s in sizes])).alias("size"), _own_names(use_location).alias("names"))
    own = own.select(*SIGNATURE, "size", F.expr("shiftright(years_low, size)").alias("block"), F.explode("names").alias("name"))
    met = own.join(index, ["size", "block", "name"]).where("years_high <= exp_max")
    return met.select(*SIGNATURE, "jd_id").distinct()


def match_places(groups: DataFrame, features: DataFrame) -> DataFrame:
    """(moves, hits, jd_id) of the location gate alone, for ``groups`` (moves, hits) without repeats."""
    listed = F.when(F.size("locations") > 0, F.col("locations")).otherwise(F.array(F.lit(ANYWHERE)))
    names = features.select("jd_id", F.explode(F.array_distinct(F.concat(F.array(F.lit(MOVERS)), listed))).alias("name"))
    return groups.select("moves", "hits", F.explode(_own_names(True)).alias("name")).join(names, "name").select("moves", "hits", "jd_id").distinct()
