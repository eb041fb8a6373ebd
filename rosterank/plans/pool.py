"""Stage 1: which profiles are in the running for which description.

The gates of all descriptions travel as one small literal array, so a profile is tested against them where it is
scanned: one row per profile in, at most one row out, no join and no shuffle, and the outer experience bounds
reach the file scan as constants. More than MAX_DESCRIPTIONS descriptions are met by signatures (``gate_index``).
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F

from rosterank.functions import gates
from rosterank.functions.basics import literal, once
from rosterank.operators.lookup import MAX_BROADCAST_ROWS, join_lookup
from rosterank.operators.topk import top_per_group
from rosterank.plans.gate_index import SIGNATURE, match_places, match_signatures, places_of, with_signature
from rosterank.staging import stage

MIN_POOL = 100
MAX_DESCRIPTIONS = 2_000  # rows of one gate array; more descriptions are scored in blocks


@dataclass(frozen=True)
class Gates:
    """Parameters of the descriptions' gates: id, experience range and places, nothing that grows with profiles."""

    array: Column
    exp_min: float
    exp_max: float
    places: tuple[str, ...]


def gate_board(features: DataFrame) -> Gates | None:
    """The gates of all descriptions; None for more than MAX_DESCRIPTIONS."""
    rows = _gate_columns(features).limit(MAX_DESCRIPTIONS + 1).collect()
    return _board(rows) if len(rows) <= MAX_DESCRIPTIONS else None


def _gate_columns(features: DataFrame) -> DataFrame:
    return features.select("jd_id", "exp_min", "exp_max", "locations")


def _stream_boards(features: DataFrame) -> list[Gates]:
    """The gates in hash blocks of about a quarter of MAX_DESCRIPTIONS, for streams, which can't be written and met again."""
    written = stage(_gate_columns(features), "gates")
    blocks = -(-4 * written.count() // MAX_DESCRIPTIONS)
    return [_board(written.filter(F.pmod(F.xxhash64("jd_id"), F.lit(blocks)) == i).collect()) for i in range(blocks)]


def _board(rows: list[Row]) -> Gates:
    items = sorted((r.asDict() for r in rows), key=lambda r: r["jd_id"])
    ddl = "array<struct<jd_id:string,exp_min:bigint,exp_max:bigint,locations:array<string>>>"
    return Gates(
        array=literal(items, ddl),
        exp_min=float(min((r["exp_min"] for r in items), default=0)),
        exp_max=float(max((r["exp_max"] for r in items), default=0)),
        places=tuple(sorted({place for r in items for place in r["locations"]})),
    )


def _yoe() -> Column:
    return F.coalesce(F.col("profile.years_of_experience"), F.lit(0.0))


def _trap(as_of: dt.date) -> Column:
    return gates.honeypot_reason(F.col("skills"), F.col("career_history"), F.col("profile.years_of_experience"), as_of)


def _trapped(as_of: dt.date) -> Column:
    return gates.is_honeypot(F.col("skills"), F.col("career_history"), F.col("profile.years_of_experience"), as_of)


def _whereabouts() -> Column:
    return gates.whereabouts(
        F.col("profile.location"), F.col("profile.country"), F.col("signals.willing_to_relocate")
    )


def _where_true(array: Column, also: Column) -> Column:
    """One row for a non-empty ``array`` where ``also`` holds, else none. Both are evaluated once, ``also`` last."""
    return F.explode(F.filter(F.array(array), lambda found: (F.size(found) > 0) & also))


def gate_profiles(candidates: DataFrame, features: DataFrame, as_of: dt.date, *, use_location: bool = True) -> DataFrame:
    """Profiles that pass for at least one description, with those descriptions in ``jd_ids``."""
    board = gate_board(features)
    if board is None:
        screened = _screened(candidates, features, ~_trapped(as_of))
        return _by_signature(screened, features, use_location).select(*candidates.columns, "jd_ids")
    located = _gate_block(candidates, board, as_of, use_location)
    return located.withColumn("jd_ids", F.transform("matches", lambda m: m["jd_id"])).drop("matches")


def _screened(candidates: DataFrame, features: DataFrame, also: Column) -> DataFrame:
    """Written table of the profiles that pass the title gate and ``also``, with their signatures: the only scan."""
    titled = candidates.filter(~gates.is_disqualified_title(F.col("profile.current_title")) & also)
    return stage(with_signature(titled, places_of(features)), "screened")


def _by_signature(screened: DataFrame, features: DataFrame, use_location: bool) -> DataFrame:
    """Screened profiles with ``jd_ids``, for any number of descriptions."""
    counted = stage(screened.groupBy(*SIGNATURE).agg(F.count(F.lit(1)).alias("n")), "signatures")
    pairs = match_signatures(counted, features, use_location=use_location)
    sets = pairs.groupBy(*SIGNATURE).agg(F.sort_array(F.collect_set("jd_id")).alias("jd_ids"))  # descriptions at most
    sets = stage(sets.join(counted, SIGNATURE), "signature-sets")
    entries = sets.agg(F.sum(F.size("jd_ids"))).first()[0] or 0
    most = MAX_BROADCAST_ROWS if entries <= MAX_BROADCAST_ROWS else 0
    return join_lookup(screened, sets, SIGNATURE, spread_by="candidate_id", heat="n", max_rows=most)


def gate_matches(candidates: DataFrame, features: DataFrame, as_of: dt.date) -> DataFrame:
    """Profiles that pass all gates but location for some description, with ``matches``: array of (jd_id, located).

    With more descriptions than one block holds a profile comes once for each block in which it passes.
    """
    board = gate_board(features)
    boards = _stream_boards(features) if board is None else [board]
    return reduce(DataFrame.unionByName, [_gate_block(candidates, board, as_of, False) for board in boards])


def _gate_block(candidates: DataFrame, board: Gates, as_of: dt.date, located_only: bool) -> DataFrame:
    years = F.col("profile.years_of_experience")
    in_reach = candidates.filter(years.isNull() | ((years >= board.exp_min) & (years <= board.exp_max)))
    titled = in_reach.filter(~gates.is_disqualified_title(F.col("profile.current_title")))
    experienced = F.filter(board.array, lambda g: gates.passes_experience(years, g["exp_min"], g["exp_max"]))

    def matches(where: Column) -> Column:
        found = F.transform(
            experienced,
            lambda g: F.struct(g["jd_id"].alias("jd_id"), gates.within_reach(where, g["locations"]).alias("located")),
        )
        return F.filter(found, lambda m: m["located"]) if located_only else found

    found = once(_whereabouts(), matches)
    return titled.select("*", _where_true(found, ~_trapped(as_of)).alias("matches"))


def build_pool(candidates: DataFrame, features: DataFrame, as_of: dt.date, min_pool: int = MIN_POOL) -> DataFrame:
    """Written table of surviving profiles with ``jd_ids`` and the relaxed subset ``relaxed_ids``.

    Profiles are scanned once and only survivors are written; scoring and explaining read that table. A second
    pass without the location gate happens only when some description has fewer than ``min_pool`` survivors,
    and only for those descriptions. (With more than MAX_DESCRIPTIONS it reads the screened profiles, not the source.)
    """
    if gate_board(features) is None:
        return _pool_of(_screened(candidates, features, ~_trapped(as_of)), candidates.columns, features, min_pool)
    return _relaxed_if_short(
        lambda some, use: gate_profiles(candidates, some, as_of, use_location=use), features, min_pool
    )


def _pool_of(screened: DataFrame, columns: list[str], features: DataFrame, min_pool: int) -> DataFrame:
    gated = lambda some, use: _by_signature(screened, some, use).select(*columns, "jd_ids")
    return _relaxed_if_short(gated, features, min_pool)


def _relaxed_if_short(gated: Callable[[DataFrame, bool], DataFrame], features: DataFrame, min_pool: int) -> DataFrame:
    none = F.array().cast("array<string>")
    strict = stage(gated(features, True), "pool").withColumn("relaxed_ids", none)
    counts = strict.select(F.explode("jd_ids").alias("jd_id")).groupBy("jd_id").count()
    enough = counts.filter(F.col("count") >= min_pool).select("jd_id")
    short = stage(features.join(enough, "jd_id", "left_anti"), "short-descriptions")
    if short.isEmpty():
        return strict
    short_ids = short.agg(F.collect_list("jd_id")).scalar()
    kept = strict.withColumn("jd_ids", F.array_except("jd_ids", short_ids)).filter(F.size("jd_ids") > 0)
    relaxed = stage(gated(short, False), "relaxed-pool")
    return kept.unionByName(relaxed.withColumn("relaxed_ids", F.col("jd_ids")))


def pool_with_counts(
    candidates: DataFrame, features: DataFrame, as_of: dt.date, min_pool: int = MIN_POOL
) -> tuple[DataFrame, DataFrame]:
    """``build_pool`` and ``drop_counts`` from one scan of the profiles, for any number of descriptions.

    The scan writes what the gates see of every profile, and the profile itself only if no gate of its own drops it.
    """
    seen = _seen(candidates, features, as_of)
    sound = ~F.col("bad_title") & ~F.col("trap")
    whole = [F.when(sound, F.col(f"`{c}`")).alias(c) for c in candidates.columns]
    written = stage(seen.select(*SIGNATURE, "bad_title", "trap", *whole), "seen")
    pool = _pool_of(written.filter(sound).drop("bad_title", "trap"), candidates.columns, features, min_pool)
    return pool, _counts(written, features)


def _seen(candidates: DataFrame, features: DataFrame, as_of: dt.date) -> DataFrame:
    """``candidates`` with everything that the gates see of them: SIGNATURE, bad_title, trap (false after a bad title)."""
    bad_title = gates.is_disqualified_title(F.col("profile.current_title"))
    trap = F.when(F.col("bad_title"), F.lit(False)).otherwise(_trapped(as_of))
    return with_signature(candidates, places_of(features)).withColumn("bad_title", bad_title).withColumn("trap", trap)


def pool_pairs(pool: DataFrame) -> DataFrame:
    """(jd_id, candidate_id, relaxed), one row per profile and description it is in the running for."""
    return pool.select("candidate_id", "relaxed_ids", F.explode("jd_ids").alias("jd_id")).select(
        "jd_id", "candidate_id", F.array_contains("relaxed_ids", F.col("jd_id")).alias("relaxed")
    )


def pool_status(pool: DataFrame, features: DataFrame, min_pool: int = MIN_POOL) -> DataFrame:
    """(jd_id, pooled, relaxed, enough) of every description: ``enough`` is false if its pool stays short even relaxed."""
    counts = pool_pairs(pool).groupBy("jd_id").agg(F.count(F.lit(1)).alias("pooled"), F.bool_or("relaxed").alias("relaxed"))
    every = features.select("jd_id").join(counts, "jd_id", "left")
    pooled = F.coalesce("pooled", F.lit(0).cast("bigint"))
    return every.select("jd_id", pooled.alias("pooled"), F.coalesce("relaxed", F.lit(True)).alias("relaxed"), (pooled >= min_pool).alias("enough"))


class ShortPoolError(ValueError):
    """Some description has too few profiles to rank, even without its location gate."""


def require_pools(pool: DataFrame, features: DataFrame, min_pool: int = MIN_POOL) -> None:
    """Raise ShortPoolError, with the first few descriptions, if any pool has less than ``min_pool`` profiles."""
    short = pool_status(pool, features, min_pool).filter("NOT enough").orderBy("jd_id").limit(10).collect()
    if short:
        raise ShortPoolError("too few profiles: " + ", ".join(f"{r['jd_id']} ({r['pooled']})" for r in short))


def drop_counts(candidates: DataFrame, features: DataFrame, as_of: dt.date) -> DataFrame:
    """Per description: profiles processed, dropped at each gate and surviving, from one scan.

    Profiles are first counted by everything a gate can see of them (years, matched places, flags), which combines before
    the shuffle; only those groups meet the descriptions, by equality (see ``gate_index``). What a description drops
    for its location or years follows from what it doesn't drop.
    """
    return _counts(_seen(candidates, features, as_of).select(*SIGNATURE, "bad_title", "trap"), features)


def _counts(seen: DataFrame, features: DataFrame) -> DataFrame:
    def number(which: Column, name: str) -> Column:
        return F.sum(F.when(which, F.col("n")).otherwise(F.lit(0))).alias(name)

    flat = seen.groupBy(*SIGNATURE, "bad_title", "trap").agg(F.count(F.lit(1)).alias("n"))
    groups = flat.groupBy(*SIGNATURE).agg(F.sum("n").alias("n"), number(F.col("bad_title"), "title"), number(F.col("trap"), "honeypot"))
    groups = stage(groups, "signatures")
    places = groups.groupBy("moves", "hits").agg(F.sum("n").alias("n"))
    located = match_places(places, features).join(places, ["moves", "hits"]).groupBy("jd_id").agg(F.sum("n").alias("located"))
    fitting = match_signatures(groups, features).join(groups, SIGNATURE)
    fitting = fitting.groupBy("jd_id").agg(*[F.sum(c).alias(c) for c in ("n", "title", "honeypot")])
    processed = groups.agg(F.sum("n")).first()[0]
    if processed is None:
        processed, features = 0, features.where("false")
    total = F.lit(processed).cast("bigint")
    every = features.select("jd_id").join(located, "jd_id", "left").join(fitting, "jd_id", "left").na.fill(0)
    return every.select(
        "jd_id",
        total.alias("processed"),
        (total - F.col("located")).alias("dropped_location"),
        (F.col("located") - F.col("n")).alias("dropped_experience"),
        F.col("title").alias("dropped_title"),
        F.col("honeypot").alias("dropped_honeypot"),
        (F.col("n") - F.col("title") - F.col("honeypot")).alias("surviving"),
    )


def honeypot_reasons(candidates: DataFrame, as_of: dt.date) -> DataFrame:
    """(candidate_id, honeypot_reason) of every implausible profile."""
    reason = F.explode(F.array_compact(F.array(_trap(as_of))))
    return candidates.select("candidate_id", reason.alias("honeypot_reason"))


def honeypot_sample(candidates: DataFrame, features: DataFrame, as_of: dt.date, n: int = 5) -> DataFrame:
    """The first ``n`` profiles per description that fail at the honeypot gate and pass the ones before it."""
    board = gate_board(features)
    if board is None:
        found = _by_signature(_screened(candidates, features, _trapped(as_of)), features, True)
    else:
        found = _trapped_block(candidates, board, as_of)
    # the reason goes along instead of the profile, so that what is sorted is small
    told = found.select("jd_ids", "candidate_id", _trap(as_of).alias("honeypot_reason"))
    trapped = told.select(F.explode("jd_ids").alias("jd_id"), "candidate_id", "honeypot_reason")
    first = top_per_group(trapped, ["jd_id"], [F.asc("candidate_id")], n, spread_by=["candidate_id"])
    return first.select("jd_id", "candidate_id", "honeypot_reason", "rank")


def _trapped_block(candidates: DataFrame, board: Gates, as_of: dt.date) -> DataFrame:
    years = F.col("profile.years_of_experience")
    experienced = F.filter(board.array, lambda g: gates.passes_experience(years, g["exp_min"], g["exp_max"]))
    fits = once(
        _whereabouts(), lambda where: F.filter(experienced, lambda g: gates.within_reach(where, g["locations"]))
    )
    titled = candidates.filter(~gates.is_disqualified_title(F.col("profile.current_title")))
    return titled.select("*", _where_true(F.transform(fits, lambda g: g["jd_id"]), _trapped(as_of)).alias("jd_ids"))
