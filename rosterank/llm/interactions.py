"""Audit of the order of document filters by Lehmer ranks and difference arrays.

A document fails a set of filters, its mask. In whatever order the filters are applied, it is removed by the first one of
its mask. So the audit needs only how many documents of each part have each mask:

1. One pass over the texts gives each document its mask and a digest. Only these few bytes are shuffled. Identical texts
   are told by SHA-256; groups of copies are combined before they meet.
2. The orders are numbered lexicographically (Lehmer ranks, 0 to 119 for five filters). The orders in which a mask's
   documents go at a given step fill intervals of ranks, since all orders with the same beginning follow one another.
   ``removal_intervals`` lists them; their number depends on the filters alone (a few hundred rows for five).
3. Each count is added where an interval begins and subtracted where it ends. The running sum over the ranks is the number
   that the step removes in each order. Everything else follows from that and the counts of the masks.

Defined cases: a null text is empty; a null language is the part with the empty name, like an empty one; rows that share an
id are documents of their own, and none of them has a smaller id than the others, so equal rows aren't copies of each
other; a null id is larger than all others; a label counts if any row of ``labels`` with the document's id says so, and
null ids have none; an empty table gives no rows; extra columns are left behind; very long texts are read whole.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from itertools import groupby, permutations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from rosterank.llm.common import columns, stage

#: White space between words (fixed values of the contract).
SPACES = r"[\x20\x09-\x0D]+"
COUNTS = ("n", "good", "toxic")
#: Partitions over which rows without an id are spread when they pass the labels, which they can't meet.
SPREAD = 1024


def text_filters(text: Column) -> dict[str, Column]:
    """The failure conditions that a text decides alone, by name; a filter on copies is added by ``failure_masks``."""
    words = F.array_remove(F.split(text, SPACES), "")
    number, distinct = F.size(words), F.size(F.array_distinct(words))
    capitals = F.char_length(F.regexp_replace(text, "[^A-Z]+", ""))
    return {
        "A": number < 100,
        "B": 100 * distinct < 80 * number,
        "C": 100 * capitals > 10 * F.char_length(text),
        "D": text.rlike(r"[#$%&*|]"),
    }


def failure_masks(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """(part, mask, n, good, toxic): documents of each part by the filters they fail, bit k for the k-th of ABCDE."""
    docs = columns(documents, doc_id="long", text="string", lang="string")
    docs = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), F.coalesce("lang", F.lit("")).alias("part"))
    alone = list(text_filters(F.col("text")).values())
    bits = [F.when(fails, F.lit(1 << k)).otherwise(F.lit(0)) for k, fails in enumerate(alone)]
    copies = 1 << len(alone)
    mask = bits[0]
    for bit in bits[1:]:
        mask = mask + bit
    rows = docs.select("doc_id", "part", mask.alias("mask"), F.unhex(F.sha2(F.col("text").cast("binary"), 256)).alias("digest"))
    rows = rows.groupBy("doc_id", "part", "mask", "digest").agg(F.count(F.lit(1)).alias("n"))

    told = columns(labels, doc_id="long", quality="int", toxic="int").where("doc_id IS NOT NULL")
    told = told.groupBy("doc_id").agg(F.max(F.col("quality") == 1).alias("good"), F.max(F.col("toxic") == 1).alias("toxic"))
    spread = F.when(F.col("doc_id").isNull(), F.pmod(F.xxhash64("digest", "part"), F.lit(SPREAD))).otherwise(F.lit(0))
    rows = rows.withColumn("spread", spread).join(told.withColumn("spread", F.lit(0).cast("long")), ["doc_id", "spread"], "left")
    rows = rows.withColumn("good", F.coalesce("good", F.lit(False))).withColumn("toxic", F.coalesce("toxic", F.lit(False)))

    # per text and kind of document: all of them, and the first id with its own number of rows
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", F.col("n").alias("times"))).alias("first")
    alike = rows.groupBy("digest", "part", "mask", "good", "toxic").agg(F.sum("n").alias("n"), first)
    place = F.struct("first.none", "first.doc_id")
    alike = alike.withColumn("leads", place.eqNullSafe(F.min(place).over(Window.partitionBy("digest"))))
    originals = F.when(F.col("leads"), F.col("first.times")).otherwise(F.lit(0))
    each = alike.select(
        "part",
        "good",
        "toxic",
        F.inline(
            F.array(
                F.struct(F.col("mask").alias("mask"), originals.alias("n")),
                F.struct((F.col("mask") + copies).alias("mask"), (F.col("n") - originals).alias("n")),
            )
        ),
    ).where("n > 0")
    count = lambda name: F.sum(F.when(F.col(name), F.col("n")).otherwise(F.lit(0)))
    return each.groupBy("part", "mask").agg(F.sum("n").alias("n"), count("good").alias("good"), count("toxic").alias("toxic"))


def removal_intervals(names: Sequence[str]) -> list[tuple[int, int, int, int]]:
    """(mask, step, low, high): in the orders of ranks low to high - 1 the documents with that mask go at that step."""
    orders = [[1 << names.index(name) for name in order] for order in permutations(names)]  # lexicographic
    out = []
    for mask in range(1, 1 << len(names)):
        steps = [next(step for step, bit in enumerate(order, 1) if mask & bit) for order in orders]
        at = 0
        for step, run in groupby(steps):
            size = len(list(run))
            out.append((mask, step, at, at + size))
            at += size
    return out


def audit_orders(masks: DataFrame, names: Sequence[str] = "ABCDE") -> DataFrame:
    """One row per part, order of the filters ``names`` (in alphabetical order) and step, from (part, mask, n, good, toxic).

    ``masks`` has at most 2 ** filters rows a part, and so has everything here a bounded number of rows a part.
    """
    spark = masks.sparkSession
    names = list(names)
    if names != sorted(set(names)) or not 1 <= len(names) <= 6:
        raise ValueError("one to six filters with different names in alphabetical order")
    ranks = math.factorial(len(names))
    intervals = spark.createDataFrame(removal_intervals(names), "mask int, step int, low int, high int")

    # counts at the ends of the intervals; the grid makes every rank present
    end = lambda at, sign: F.struct(F.col(at).alias("rank"), *[(sign * F.col(c)).alias(c) for c in COUNTS])
    met = masks.join(F.broadcast(intervals), "mask")
    ends = met.select("part", "step", F.inline(F.array(end("low", 1), end("high", -1)))).where(F.col("rank") < ranks)
    zeros = [F.lit(0).cast("long").alias(c) for c in COUNTS]
    parts = masks.select("part").distinct()
    steps = parts.select("part", F.explode(F.sequence(F.lit(1), F.lit(len(names)))).alias("step"))
    grid = steps.select("part", "step", F.explode(F.sequence(F.lit(0), F.lit(ranks - 1))).alias("rank"), *zeros)
    change = ends.unionByName(grid).groupBy("part", "step", "rank").agg(*[F.sum(c).alias(c) for c in COUNTS])
    along = Window.partitionBy("part", "step").orderBy("rank")
    gone = change.select("part", "step", "rank", *[F.sum(c).over(along).alias(c) for c in COUNTS])

    # which filter acts at a step, from the order's letters
    letters = F.array(*[F.lit("".join(order)) for order in permutations(names)])
    gone = gone.withColumn("filter_order", F.element_at(letters, F.col("rank") + 1))
    gone = gone.withColumn("filter", F.substr("filter_order", F.col("step"), F.lit(1)))

    bits = [F.struct(F.lit(name).alias("filter"), F.lit(1 << k).alias("bit")) for k, name in enumerate(names)]
    fails = masks.select("part", "n", "mask", F.inline(F.array(*bits)))
    hit = F.col("mask").bitwiseAND(F.col("bit")) != 0
    own = fails.groupBy("part", "filter").agg(
        F.sum("n").alias("everyone"),
        F.sum(F.when(hit, F.col("n")).otherwise(F.lit(0))).alias("failing"),
        F.sum(F.when(F.col("mask") == F.col("bit"), F.col("n")).otherwise(F.lit(0))).alias("unique_fails"),
    )
    so_far = Window.partitionBy("part", "rank").orderBy("step")
    whole = gone.join(own, ["part", "filter"])
    return whole.select(
        "part",
        "filter_order",
        F.col("step").cast("int").alias("step"),
        (F.col("everyone") - F.sum("n").over(so_far)).alias("kept"),
        F.col("n").alias("removed"),
        (F.col("failing") - F.col("n")).alias("redundant"),
        "unique_fails",
        F.col("good").alias("good_lost"),
        F.col("toxic").alias("toxic_lost"),
        F.sum("n").over(Window.partitionBy("part", "filter")).alias("shapley"),
    )


def op12_interactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each of five filters removes at each step of all their orders, per language."""
    documents, labels = (spark.read.parquet(f"{sf_dir}/{name}.parquet") for name in ("documents", "labels"))
    return audit_orders(stage(failure_masks(documents, labels), "masks"))


SQL = """
WITH RECURSIVE l AS (
  SELECT doc_id, bool_or(quality = 1) AS good, bool_or(toxic = 1) AS toxic FROM labels GROUP BY doc_id
), d AS (
  SELECT doc_id, coalesce(text, '') AS t, coalesce(lang, '') AS part,
    regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w FROM documents
), f AS (
  SELECT part, coalesce(good, false) AS good, coalesce(toxic, false) AS toxic, [
    len(w) < 100, 100 * len(list_distinct(w)) < 80 * len(w),
    100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 10 * length(t), regexp_matches(t, '[#$%&*|]'),
    coalesce(doc_id > min(doc_id) OVER (PARTITION BY t), doc_id IS NULL AND min(doc_id) OVER (PARTITION BY t) IS NOT NULL)] AS fails
  FROM d LEFT JOIN l USING (doc_id)
), m AS (
  SELECT part, fails, count(*) AS n, count(*) FILTER (good) AS good, count(*) FILTER (toxic) AS toxic FROM f GROUP BY part, fails
), o AS (
  SELECT '' AS filter_order UNION ALL
  SELECT concat(filter_order, x) FROM o, (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x) WHERE NOT contains(filter_order, x)
), s AS (
  SELECT filter_order, unnest(range(1, 6)) AS step FROM o WHERE length(filter_order) = 5
), g AS (
  SELECT part, filter_order, step, fails[ascii(filter_order[step]) - 64] AS hit, n, good, toxic, filter_order[step] AS x,
    len(list_filter(range(1, step), lambda i: fails[ascii(filter_order[i]) - 64])) > 0 AS before,
    len(list_filter(fails, lambda v: v)) = 1 AS single
  FROM m, s
), r AS (
  SELECT part, filter_order, step, x, coalesce(sum(n) FILTER (NOT hit AND NOT before), 0) AS kept,
    coalesce(sum(n) FILTER (hit AND NOT before), 0) AS removed, coalesce(sum(n) FILTER (hit AND before), 0) AS redundant,
    coalesce(sum(n) FILTER (hit AND single), 0) AS unique_fails, coalesce(sum(good) FILTER (hit AND NOT before), 0) AS good_lost,
    coalesce(sum(toxic) FILTER (hit AND NOT before), 0) AS toxic_lost
  FROM g GROUP BY part, filter_order, step, x
)
SELECT part, filter_order, CAST(step AS INTEGER) AS step, CAST(kept AS BIGINT) AS kept, CAST(removed AS BIGINT) AS removed,
  CAST(redundant AS BIGINT) AS redundant, CAST(unique_fails AS BIGINT) AS unique_fails, CAST(good_lost AS BIGINT) AS good_lost,
  CAST(toxic_lost AS BIGINT) AS toxic_lost, CAST(sum(removed) OVER (PARTITION BY part, x) AS BIGINT) AS shapley
FROM r
"""
