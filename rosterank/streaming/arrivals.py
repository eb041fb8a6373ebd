"""Arriving profile files: stateless gating and scoring, and a ranking refreshed per micro-batch.

Whether a description relaxes its location gate depends on how many profiles pass all of its gates in the end, so a stream
can't decide it. Both forms therefore keep, per description, the profiles that pass everything and those that pass
everything but the location, with a count of the former, and the choice is made when the results are read.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from rosterank.operators.lookup import join_lookup
from rosterank.operators.tfidf import fixed_similarity
from rosterank.plans.pool import MIN_POOL, gate_matches
from rosterank.plans.ranking import SELECTED_ROWS, pool_texts, row_scores, select_top, with_composite
from rosterank.schemas import candidate_schema
from rosterank.staging import stage

#: Folders that a store's versions take in turn. More than one, so that readers find the last version while one is written.
SLOTS = 3


def read_arrivals(
    spark: SparkSession, folder: str, *, embeddings: bool = False, files_per_batch: int = 1000
) -> DataFrame:
    """Stream of profiles from JSON-lines files that appear in ``folder``."""
    schema = candidate_schema() + (", embedding ARRAY<FLOAT>" if embeddings else "")
    return (
        spark.readStream.schema(StructType.fromDDL(schema)).option("maxFilesPerTrigger", files_per_batch).json(folder)
    )


def _matched(profiles: DataFrame, features: DataFrame, as_of: dt.date) -> DataFrame:
    """Profiles that pass all gates but location, with ``jd_ids`` and ``located_ids``, those whose location passes too."""
    ids = lambda found: F.transform(found, lambda m: m["jd_id"])
    found = gate_matches(profiles, features, as_of)
    located = F.filter("matches", lambda m: m["located"])
    return found.select("*", ids("matches").alias("jd_ids"), ids(located).alias("located_ids")).drop("matches")


def _with_located(rows: DataFrame) -> DataFrame:
    return rows.withColumn("located", F.array_contains("located_ids", F.col("jd_id"))).drop("located_ids")


def score_arrivals(arrivals: DataFrame, features: DataFrame, as_of: dt.date) -> DataFrame:
    """Row scores of the arriving profiles that pass all gates but location, and ``located``. Nothing is kept between batches.

    ``features`` comes from ``with_weight_levels`` and is static. ``settle`` makes the pool out of the stored rows.
    """
    return _with_located(row_scores(_matched(arrivals, features, as_of), features, as_of, carry=("located_ids",)))


def settle(scored: DataFrame, min_pool: int = MIN_POOL) -> DataFrame:
    """The rows of each description's pool, with ``relaxed``, out of all rows of ``score_arrivals`` so far.

    A description with at least ``min_pool`` located rows keeps these, any other keeps all of its rows.
    """
    counts = scored.groupBy("jd_id").agg((F.count_if("located") < min_pool).alias("relaxed"))
    rows = join_lookup(scored, stage(counts, "settled"), ["jd_id"], spread_by="candidate_id")
    return rows.filter(F.col("located") | F.col("relaxed")).drop("located")


def append_scores(scored: DataFrame, out: str, checkpoint: str) -> StreamingQuery:
    return (
        scored.writeStream.format("parquet")
        .option("path", out)
        .option("checkpointLocation", checkpoint)
        .outputMode("append")
        .trigger(availableNow=True)
        .start()
    )


def dense_scorer(features: DataFrame, as_of: dt.date) -> Callable[[DataFrame], DataFrame]:
    """Scores of matched profiles by their ``embedding`` and that of the features."""
    vectors = stage(features.select("jd_id", "embedding"), "jd-vectors")

    def score(matched: DataFrame) -> DataFrame:
        return with_composite(row_scores(matched, features, as_of, carry=("located_ids",), vectors=vectors))

    return score


def tfidf_scorer(features: DataFrame, vocabulary: DataFrame, as_of: dt.date) -> Callable[[DataFrame], DataFrame]:
    """Scores of matched profiles by their text under a fixed ``vocabulary`` (``fit_vocabulary``, ``load_vocabulary``).

    The similarity is the plain cosine: dividing by the pool's best would need the whole pool.
    """

    def score(matched: DataFrame) -> DataFrame:
        profiles = stage(matched, "matched")
        similar = fixed_similarity(pool_texts(profiles), vocabulary)
        similar = similar.select("jd_id", F.col("text_id").alias("candidate_id"), "semantic")
        rows = row_scores(profiles, features, as_of, carry=("located_ids",))
        return with_composite(rows.join(similar, ["jd_id", "candidate_id"]))

    return score


def refresh_ranking(
    arrivals: DataFrame,
    features: DataFrame,
    as_of: dt.date,
    store: str,
    checkpoint: str,
    top_n: int = SELECTED_ROWS,
    *,
    scorer: Callable[[DataFrame], DataFrame] | None = None,
    basis: str = "dense",
    min_pool: int = MIN_POOL,
) -> StreamingQuery:
    """Keep the best ``top_n`` per description over everything that has arrived, in dense mode or by ``scorer``.

    Each batch merges its own best rows with those of the version before, for located profiles and for all that pass
    the other gates, and adds up the located ones. Descriptions that have ``min_pool`` of them need the other list no
    more, and later batches don't score for it. The merge is exact: a row outside a batch's best ``top_n`` cannot be in the
    overall best.

    Versions take the folders ``store/slot=0`` to ``SLOTS - 1`` in turn; ``store/log`` names the batch that each holds, once
    it is whole. A repeated batch starts from the version before it and takes the same folder, so a restart changes
    nothing. ``basis`` names what scores are comparable under (a vocabulary's version); a store of another one is refused.
    """
    score = scorer or dense_scorer(features, as_of)

    def merge(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        before = _versions(spark, store).filter(F.col("batch") < batch_id).orderBy(F.desc("batch")).limit(1).collect() if batch_id else []
        if before and before[0]["basis"] != basis:
            raise ValueError(f"the store holds scores under {before[0]['basis']}, not under {basis}: use another store")
        found = _matched(batch, features, as_of)
        if before:
            last = spark.read.schema(_version_schema()).parquet(f"{store}/slot={before[0]['slot']}")
            full = last.filter(F.col("candidate_id").isNull() & (F.col("n_located") >= min_pool)).select("jd_id")
            full = F.array(*[F.lit(r["jd_id"]) for r in full.collect()]).cast("array<string>")  # descriptions at most
            wanted = F.array_union(F.array_except("jd_ids", full), F.col("located_ids"))
            found = found.withColumn("jd_ids", wanted).filter(F.size("jd_ids") > 0)
        rows = stage(_with_located(score(found)).select("jd_id", "candidate_id", "score", "located"), "arrived")
        counts = rows.groupBy("jd_id").agg(F.count_if("located").alias("n_located"))
        if before:
            counts = counts.unionByName(last.filter(F.col("candidate_id").isNull()).select("jd_id", "n_located"))
            rows = rows.unionByName(last.filter(F.col("candidate_id").isNotNull()).select("jd_id", "candidate_id", "score", "located"))
        counts = counts.groupBy("jd_id").agg(F.sum("n_located").alias("n_located"))
        # rows of the open list that are located are in the located list too
        best = select_top(rows.filter("located"), top_n).drop("rank")
        others = select_top(rows, top_n).drop("rank").filter("NOT located")
        kept = best.unionByName(others).withColumn("n_located", F.lit(None).cast("bigint"))
        slot = (before[0]["slot"] + 1) % SLOTS if before else 0
        kept.unionByName(counts, allowMissingColumns=True).write.mode("overwrite").parquet(f"{store}/slot={slot}")
        entry = spark.range(1).select(F.lit(batch_id).cast("bigint").alias("batch"), F.lit(basis).alias("basis"))
        entry.write.mode("overwrite").parquet(f"{store}/log/slot={slot}")

    return (
        arrivals.writeStream.foreachBatch(merge)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def _version_schema() -> str:
    return "jd_id string, candidate_id string, score double, located boolean, n_located bigint"


def _versions(spark: SparkSession, store: str) -> DataFrame:
    return spark.read.schema("batch bigint, basis string, slot int").parquet(f"{store}/log")


def latest_ranking(
    spark: SparkSession, store: str, top_n: int = SELECTED_ROWS, min_pool: int = MIN_POOL
) -> DataFrame:
    """(jd_id, candidate_id, score, relaxed, rank) of the newest whole version written by ``refresh_ranking``."""
    newest = _versions(spark, store).orderBy(F.desc("batch")).limit(1).collect()[0]
    version = spark.read.schema(_version_schema()).parquet(f"{store}/slot={newest['slot']}")
    counts = version.filter(F.col("candidate_id").isNull()).select("jd_id", (F.col("n_located") < min_pool).alias("relaxed"))
    rows = version.filter(F.col("candidate_id").isNotNull()).drop("n_located").join(counts, "jd_id")
    return select_top(rows.filter(F.col("located") | F.col("relaxed")).drop("located"), top_n)
