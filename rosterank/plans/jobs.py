"""Job descriptions: features out of free text, and the per-description tables the other plans read."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rosterank.functions import jd_text
from rosterank.staging import stage

FALLBACK_BELOW = 5


def extract_jd_features(jds: DataFrame) -> DataFrame:
    """jd_id, text -> written table jd_id, text, exp_min, exp_max, locations, skill_weights (heaviest first).

    Written, because a filter on the arrays (``explode`` adds one by itself) would be pushed through the
    projections of ``feature_columns`` and pull the whole-text expressions back into the lambdas.
    """
    return stage(feature_columns(jds), "jd-features")


def feature_columns(jds: DataFrame) -> DataFrame:
    """The features as a lazy projection.

    Row-local from end to end: a text is searched once for the whole vocabulary and all cities, and once more for its own
    words if it is sparse, so a table of any number of descriptions is one scan without join or shuffle. Each ``select`` below only reads columns the previous one has finished; that
    keeps the whole-text expressions out of the lambdas.
    """
    low = jds.select("jd_id", "text", F.lower(F.coalesce("text", F.lit(""))).alias("low"))
    low = low.withColumn("held", jd_text.held(F.col("low")))
    found = low.select(
        "jd_id",
        "text",
        "low",
        jd_text.experience_range(F.col("low")).alias("range"),
        jd_text.locations(F.col("held")).alias("locations"),
        jd_text.vocabulary_hits(F.col("held")).alias("hits"),
        jd_text.shaped_terms(F.col("low")).alias("shaped"),
    )
    shaped = F.array_except("shaped", F.transform("hits", lambda e: e["term"]))
    named = found.withColumn(
        "named",
        F.concat(
            "hits", F.transform(shaped, lambda t: F.struct(t.alias("term"), F.lit(1.0).alias("weight")))
        ).cast(jd_text.TERM),
    )
    sparse = F.size("named") < FALLBACK_BELOW
    worded = named.withColumn("words", F.when(sparse, jd_text.plain_words(F.col("low"))))
    counted = worded.withColumn("counted", jd_text.counted_words(F.col("low"), F.col("words")))
    weighted = counted.withColumn(
        "by_frequency",
        F.when(
            sparse,
            jd_text.frequency_weights(
                F.col("counted"), F.array_max(F.transform("counted", lambda c: c["n"]))
            ),
        ),
    )
    extra = jd_text.without_terms(F.col("by_frequency"), F.transform("named", lambda e: e["term"]))
    return weighted.withColumn(
        "entries", F.when(sparse, F.concat("named", extra)).otherwise(F.col("named"))
    ).select(
        "jd_id",
        "text",
        F.col("range.exp_min").alias("exp_min"),
        F.col("range.exp_max").alias("exp_max"),
        "locations",
        jd_text.by_weight(F.col("entries")).alias("skill_weights"),
    )


def with_weight_levels(features: DataFrame) -> DataFrame:
    """Written feature table with the combined vocabulary of each description grouped by weight."""
    combined = stage(
        features.withColumn("combined", jd_text.combined_weights(F.col("skill_weights"))), "jd-features"
    )
    return combined.withColumn("levels", jd_text.weight_levels(F.col("combined")))


def combined_weight_rows(features: DataFrame) -> DataFrame:
    """(jd_id, term, weight): the description's own terms over the vocabulary's reduced weights.

    No list is empty, for it has the whole vocabulary; a plain ``explode`` would make each list twice, to ask that first.
    """
    terms = features.filter(F.col("skill_weights").isNotNull())
    terms = terms.select("jd_id", F.explode_outer(jd_text.combined_weights(F.col("skill_weights"))).alias("e"))
    return terms.select("jd_id", "e.term", "e.weight")
