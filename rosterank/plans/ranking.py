"""Stages 2 and 3: score the pool, keep the best per description, repair ties, explain."""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rosterank.functions import explain, scores
from rosterank.functions.basics import lowered, text
from rosterank.functions.texts import profile_text
from rosterank.operators.dense import dense_score, with_cosines
from rosterank.operators.lookup import join_lookup
from rosterank.operators.substrings import mutual_substrings
from rosterank.operators.tfidf import MAX_TERMS, tfidf_similarity
from rosterank.operators.topk import top_per_group
from rosterank.plans.jobs import extract_jd_features, with_weight_levels
from rosterank.plans.pool import MAX_DESCRIPTIONS, MIN_POOL, build_pool, require_pools
from rosterank.staging import stage

FINAL_ROWS = 100
SELECTED_ROWS = 150


def behavior_columns(signals: Column, as_of: dt.date) -> dict[str, Column]:
    """The nine point columns by name."""
    return scores.behavior_points(signals, as_of)


def profile_scores(
    profiles: DataFrame,
    features: DataFrame,
    as_of: dt.date,
    *,
    carry: Sequence[str] = (),
    about: Sequence[str] = (),
    vectors: DataFrame | None = None,
) -> DataFrame:
    """(jd_id, candidate_id, experience, seniority, behavior) per profile and description, row by row.

    ``carry`` and ``about`` name further columns to keep of the profiles and of the features. ``profiles`` has
    ``jd_ids``; ``features`` has at most MAX_DESCRIPTIONS rows, which bounds the broadcast. With ``vectors``
    (jd_id, embedding) the profiles' ``embedding`` gives ``semantic`` too.
    """
    points = behavior_columns(F.col("signals"), as_of)
    rows = profiles.select(
        "candidate_id",
        "jd_ids",
        F.col("profile.years_of_experience").alias("yoe"),
        F.col("profile.current_title").alias("title"),
        *[c.alias(f"points_{name}") for name, c in points.items()],
        *carry,
        *(["embedding"] if vectors is not None else []),
    )
    semantic = []
    if vectors is None:
        rows = rows.select("*", F.explode("jd_ids").alias("jd_id"))
    else:
        rows = with_cosines(rows, vectors, key="jd_id", of="embedding", ids="jd_ids", vector="embedding", output="cosines")
        rows = rows.select("*", F.inline(F.arrays_zip(F.col("jd_ids").alias("jd_id"), F.col("cosines").alias("cosine"))))
        semantic = [dense_score(F.col("cosine")).alias("semantic")]
    return rows.join(F.broadcast(features.select("jd_id", "exp_min", "exp_max", *about)), "jd_id").select(
        "jd_id",
        "candidate_id",
        *carry,
        *about,
        scores.experience_fit(F.col("yoe"), F.col("exp_min"), F.col("exp_max")).alias("experience"),
        scores.seniority(F.col("title")).alias("seniority"),
        scores.behavior_multiplier({name: F.col(f"points_{name}") for name in points}).alias("behavior"),
        *semantic,
    )


def row_scores(
    profiles: DataFrame,
    features: DataFrame,
    as_of: dt.date,
    *,
    carry: Sequence[str] = (),
    about: Sequence[str] = (),
    vectors: DataFrame | None = None,
) -> DataFrame:
    """``profile_scores`` plus ``skill``, all inside the row: the form a stream needs.

    ``features`` comes from ``with_weight_levels``. Every skill is matched against every term; for a whole pool
    ``pool_scores`` matches each distinct name once.
    """
    rows = profile_scores(profiles, features, as_of, carry=("skills", *carry), about=("levels", *about), vectors=vectors)
    totals = rows.withColumn("total", scores.skill_total(F.col("skills"), F.col("levels"))).drop("skills", "levels")
    return totals.withColumn("skill", scores.skill_score(F.col("total"))).drop("total")


def name_weights(pool: DataFrame, features: DataFrame) -> DataFrame:
    """Written table (jd_id, name, weight): the best term weight of every distinct skill name in the pool.

    Every name meets the terms of all descriptions once, by substrings; the empty name is part of every term.
    """
    names = pool.select(F.explode(F.transform("skills", lambda s: lowered(s["name"]))).alias("name")).distinct()
    names = stage(names, "skill-names")
    weights = stage(features.select("jd_id", F.explode("combined").alias("e")).select("jd_id", "e.term", "e.weight"), "terms")
    terms = stage(weights.select("term").distinct(), "distinct-terms")
    pairs = stage(mutual_substrings(names, terms), "name-terms")
    best = pairs.join(weights, "term").groupBy("jd_id", "name").agg(F.max("weight").alias("weight"))
    bare = weights.groupBy("jd_id").agg(F.max("weight").alias("weight")).select("jd_id", F.lit("").alias("name"), "weight")
    return stage(best.unionByName(bare), "name-weights")


def skill_scores(pool: DataFrame, features: DataFrame) -> DataFrame:
    """(jd_id, candidate_id, skill) of the profiles with a matching skill.

    The shares are folded in the order of the profile's own skill list, so the sum does not depend on the plan.
    """
    listed = pool.select("candidate_id", F.explode("jd_ids").alias("jd_id"), "skills")
    skills = listed.select("jd_id", "candidate_id", F.posexplode("skills").alias("at", "s")).select(
        "jd_id",
        "candidate_id",
        "at",
        lowered(F.col("s.name")).alias("name"),
        scores.proficiency_multiplier(F.col("s.proficiency")).alias("proficiency"),
        scores.duration_trust(F.col("s.duration_months")).alias("trust"),
    )
    matched = join_lookup(skills, name_weights(pool, features), ["jd_id", "name"], spread_by="candidate_id")
    share = F.col("weight") * F.col("proficiency") * F.col("trust")
    totals = matched.groupBy("jd_id", "candidate_id").agg(
        F.sort_array(F.collect_list(F.struct("at", share.alias("share")))).alias("shares")
    )
    total = F.aggregate("shares", F.lit(0.0), lambda acc, x: acc + x["share"])
    return totals.select("jd_id", "candidate_id", total.alias("total")).select(
        "jd_id", "candidate_id", scores.skill_score(F.col("total")).alias("skill")
    )


def pool_scores(pool: DataFrame, features: DataFrame, rows: DataFrame) -> DataFrame:
    """Add ``skill`` to the slim ``rows`` (jd_id, candidate_id, ...) of a pool; 0 without a matching skill."""
    return rows.join(skill_scores(pool, features), ["jd_id", "candidate_id"], "left").withColumn(
        "skill", F.coalesce("skill", F.lit(0.0))
    )


def pool_texts(pool: DataFrame) -> DataFrame:
    """(text_id, jd_ids, text): the profile texts of a pool."""
    text = profile_text(F.col("profile"), F.col("career_history"), F.col("skills"))
    return pool.select(F.col("candidate_id").alias("text_id"), "jd_ids", text.alias("text"))


def score_pool(
    pool: DataFrame,
    features: DataFrame,
    as_of: dt.date,
    *,
    semantic: str = "tfidf",
    max_terms: int = MAX_TERMS,
) -> DataFrame:
    """Scored pairs (jd_id, candidate_id, experience, seniority, behavior, skill, semantic, score).

    ``semantic="tfidf"`` fits TF-IDF on each description's pool. ``semantic="dense"`` reads an ``embedding``
    column of the pool and of the features; there only slim score rows are shuffled.
    """
    if semantic == "dense":
        rows = profile_scores(pool, features, as_of, vectors=features)
    elif semantic == "tfidf":
        similar = tfidf_similarity(pool_texts(pool), features.select("jd_id", "text"), max_terms)
        rows = profile_scores(pool, features, as_of).join(
            similar.select("jd_id", F.col("text_id").alias("candidate_id"), "semantic"), ["jd_id", "candidate_id"]
        )
    else:
        raise ValueError(f"unknown semantic mode {semantic!r}")
    return with_composite(pool_scores(pool, features, rows))


def with_composite(rows: DataFrame) -> DataFrame:
    parts = [F.col(c) for c in ("semantic", "skill", "behavior", "experience", "seniority")]
    return rows.withColumn("score", scores.composite(*parts))


def select_top(scored: DataFrame, top_n: int = SELECTED_ROWS) -> DataFrame:
    """Best ``top_n`` per description by (score descending, candidate_id), ranked from 1.

    The effective size min(top_n, max(100, pool)) never cuts more than this does: a pool smaller than 100 is
    kept whole either way.
    """
    return top_per_group(
        scored, ["jd_id"], [F.desc("score"), F.asc("candidate_id")], top_n, spread_by=["candidate_id"]
    )


def score_range(selected: DataFrame) -> DataFrame:
    return selected.groupBy("jd_id").agg(
        F.count(F.lit(1)).alias("selected"), F.min("score").alias("low_score"), F.max("score").alias("high_score")
    )


def repair_scores(ranked: DataFrame, key: str = "jd_id") -> DataFrame:
    """Lower every score to the smallest one ranked before it. Groups are final lists of at most k rows."""
    order = Window.partitionBy(key).orderBy("rank").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return ranked.withColumn("score", F.min("score").over(order))


def rerank_ties(ranked: DataFrame, key: str = "jd_id") -> DataFrame:
    """Renumber so that equal scores are in candidate_id order; ``rank`` before the change is ``listed_rank``."""
    order = Window.partitionBy(key).orderBy(F.desc("score"), F.asc("candidate_id"))
    return ranked.withColumnRenamed("rank", "listed_rank").withColumn("rank", F.row_number().over(order))


def _explainable(pool: DataFrame) -> DataFrame:
    """What explanations say of a profile; its summary is not even read."""
    some = F.struct(*[F.col(f"profile.{name}") for name in ("years_of_experience", "current_company", "location")])
    return pool.select("candidate_id", "jd_ids", some.alias("profile"), "career_history", "skills", "signals")


def explain_ranked(ranked: DataFrame, pool: DataFrame, features: DataFrame) -> DataFrame:
    """Add ``reasoning``. ``ranked`` holds at most k rows per description, so it is broadcast to the pool."""
    found = _explainable(pool).join(F.broadcast(ranked), "candidate_id").filter(F.array_contains("jd_ids", F.col("jd_id")))
    return _explain(found, ranked.columns, features)


def explain_pairs(pool: DataFrame, pairs: DataFrame, features: DataFrame) -> DataFrame:
    """``explain_ranked`` for any number of pairs: both sides are shuffled on the candidate."""
    found = _explainable(pool).join(pairs, "candidate_id").filter(F.array_contains("jd_ids", F.col("jd_id")))
    return _explain(found, pairs.columns, features)


def _explain(found: DataFrame, columns: list[str], features: DataFrame) -> DataFrame:
    about = features.select("jd_id", "exp_min", "exp_max", "locations", "skill_weights")
    found = found.join(F.broadcast(about), "jd_id")
    picked = found.select(
        *[F.col(c) for c in columns],
        "exp_min",
        "exp_max",
        "locations",
        "profile",
        "signals",
        explain.strongest_skills(F.col("skills"), F.col("skill_weights")).alias("top_skills"),
        explain.first_relevant_job(F.col("career_history"), F.col("skill_weights")).alias("job"),
    )
    clauses = picked.select(
        *[F.col(c) for c in columns],
        explain.skill_clause(
            F.col("profile.years_of_experience"),
            F.col("skill"),
            F.col("top_skills"),
            F.col("profile.current_company"),
            F.col("exp_min"),
            F.col("exp_max"),
        ).alias("c1"),
        explain.career_clause(F.col("job")).alias("c2"),
        explain.engagement_clause(F.col("behavior"), F.col("signals.recruiter_response_rate")).alias("c3"),
        explain.notice_clause(F.col("signals.notice_period_days")).alias("c4"),
        explain.location_clause(
            F.col("profile.location"), F.col("signals.willing_to_relocate"), F.col("locations")
        ).alias("c5"),
    )
    parts = [F.col(f"c{i}") for i in range(1, 6)]
    return clauses.withColumn("reasoning", explain.sentences(F.col("rank"), parts)).drop("c1", "c2", "c3", "c4", "c5")


def finalise(selected: DataFrame, pool: DataFrame, features: DataFrame, k: int = FINAL_ROWS) -> DataFrame:
    """jd_id, candidate_id, rank, score, reasoning: the first ``k`` selected rows, repaired and explained.

    The label in the text follows the rank before ties are renumbered.
    """
    best = stage(selected.filter(F.col("rank") <= k), "ranked")
    explained = explain_ranked(best, pool, features)
    return rerank_ties(repair_scores(explained)).select("jd_id", "candidate_id", "rank", "score", "reasoning")


def rank_candidates(
    candidates: DataFrame,
    jds: DataFrame,
    as_of: dt.date,
    *,
    k: int = FINAL_ROWS,
    top_n: int = SELECTED_ROWS,
    semantic: str = "tfidf",
    max_descriptions: int = MAX_DESCRIPTIONS,
    min_pool: int = MIN_POOL,
    max_terms: int = MAX_TERMS,
    allow_short: bool = True,
) -> DataFrame:
    """The whole run: jds(jd_id, text[, embedding]) x candidates -> ranked, explained rows per description.

    ``min_pool`` is the number of survivors below which a description's location gate is dropped, ``max_terms`` the
    size of a vocabulary. A description whose pool stays smaller than that gives a short list (``pool_status`` tells which),
    or a ShortPoolError without ``allow_short``.

    All descriptions are gated in one scan. More than ``max_descriptions`` of them are then scored in hash blocks of
    about half that size, out of the written pool, and the results united.
    """
    features = extract_jd_features(jds)
    if semantic == "dense":
        features = stage(features.join(jds.select("jd_id", "embedding"), "jd_id"), "jd-vectors")
    count = features.count()
    blocks = 1 if count <= max_descriptions else -(-2 * count // max_descriptions)
    results = []
    every = build_pool(candidates, features, as_of, min_pool)
    if not allow_short:
        require_pools(every, features, min_pool)
    own = lambda jd_id, block: F.pmod(F.xxhash64(jd_id), F.lit(blocks)) == block
    for block in range(blocks):
        part, pool = features, every
        if blocks > 1:
            part = stage(features.filter(own("jd_id", block)), "jd-block")
            ids = F.filter("jd_ids", lambda jd_id: own(jd_id, block))  # noqa: B023
            pool = stage(every.withColumn("jd_ids", ids).filter(F.size("jd_ids") > 0), "pool-block")
        levels = with_weight_levels(part)
        scored = score_pool(pool, levels, as_of, semantic=semantic, max_terms=max_terms)
        results.append(finalise(select_top(scored, top_n), pool, part, k))
    united = results[0]
    for result in results[1:]:
        united = united.unionByName(result)
    return united


def relevant_jobs(pool: DataFrame, features: DataFrame) -> DataFrame:
    """(jd_id, candidate_id, title, company) of the first relevant recent job of every pooled profile."""
    about = features.select("jd_id", "skill_weights")
    jobs = (
        pool.select("candidate_id", "career_history", F.explode("jd_ids").alias("jd_id"))
        .join(F.broadcast(about), "jd_id")
        .select(
            "jd_id",
            "candidate_id",
            explain.first_relevant_job(F.col("career_history"), F.col("skill_weights")).alias("job"),
        )
    )
    return jobs.filter(F.col("job").isNotNull()).select(
        "jd_id", "candidate_id", text(F.col("job.title")).alias("title"), text(F.col("job.company")).alias("company")
    )


def top_skills(pool: DataFrame, features: DataFrame) -> DataFrame:
    """(jd_id, candidate_id, position, name): up to three strongest matching skills per pooled profile."""
    about = features.select("jd_id", "skill_weights")
    return (
        pool.select("candidate_id", "skills", F.explode("jd_ids").alias("jd_id"))
        .join(F.broadcast(about), "jd_id")
        .select(
            "jd_id",
            "candidate_id",
            F.posexplode(explain.strongest_skills(F.col("skills"), F.col("skill_weights"))).alias("position", "name"),
        )
    )
