"""Documents linked by the Jaccard similarity of their word n-grams, by vertical partitioning.

1. Each text becomes its set of n-grams. Documents with equal sets are one class; one of them stands for it.
2. A class can be linked only if enough of its n-grams occur in another class. Hashes of all n-grams are counted over
   all classes (each batch of documents sends a hash once); classes with too few shared ones are done.
3. The shared n-grams of the others, in one global order from rare to frequent, are cut into fragments at fixed pivots.
   To compare a pair, its overlap is counted in each fragment separately and summed.
4. Pairs come from prefixes: linked classes share one of their rarest n-grams, as many as the threshold leaves room for.
   First every class is compared with one leader, the most central class that its prefix meets. Classes that are
   linked by then need no further comparison with each other. All other pairs that share a prefix n-gram are compared,
   unless the sizes of their fragments show that they can't be linked. Lists of a frequent n-gram are dealt in blocks.

No pair of linked documents is lost: what is skipped is linked already or is proven to lie below the threshold.

Defined cases: a null text or one without words has an empty set and no links; a text of fewer words than an n-gram has
its whole word sequence as its only member; a null id is never the smallest of a component unless it is alone (then the
component is null); rows that share an id are documents of their own.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rosterank.llm.blocks import _FACTORS, Words, by_bucket
from rosterank.llm.common import buckets_for, join_hot, release, stage
from rosterank.llm.components import components
from rosterank.llm.ordered import ROW_BITS, Texts, exchange, groups_of, mix, ordered_batches, send

SETS = "batch long, idx int, doc_id long, n int, sig0 long, sig1 long"
CLASSES = "node long, n int, c int, central double, grams array<long>, places array<long>"
_SETS = pa.schema([("batch", pa.int64()), ("idx", pa.int32()), ("doc_id", pa.int64()), ("n", pa.int32()), ("sig0", pa.int64()), ("sig1", pa.int64())])
_CLASSES = pa.schema(
    [("node", pa.int64()), ("n", pa.int32()), ("c", pa.int32()), ("central", pa.float64()), ("grams", pa.list_(pa.int64())), ("places", pa.list_(pa.int64()))]
)
#: ASCII lower case (fixed values of the contract).
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
#: Rows of a frequent n-gram's list that are compared at a time.
BLOCK_ROWS = 512


def grams(texts: Texts, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(document index, hash) of every n-gram, in text order; a shorter text has one for all its words."""
    texts.bytes = _LOWER[texts.bytes]
    words = Words(texts)
    hashed = words.windows(size, _FACTORS[2048:])
    count = words.high - words.low
    doc = np.repeat(np.arange(len(texts.ids)), count)
    fits = words.fits(size)[: len(hashed)]
    short = np.flatnonzero((count > 0) & (count < size))
    extra = np.zeros(len(short), np.uint64)
    for k in range(size - 1):
        has = count[short] > k
        extra[has] += words.hash[words.low[short[has]] + k] * _FACTORS[3072 + k]
    extra = mix(extra + count[short].astype(np.uint64))
    d = np.concatenate([doc[: len(hashed)][fits], short])
    h = np.concatenate([hashed[fits], extra])
    order = np.argsort(d, kind="stable")
    return d[order], h[order]


def _sets(size: int):
    def work(table: pa.Table) -> pa.Table:
        texts = Texts(table)
        doc, hashed = grams(texts, size)
        order = np.argsort(hashed)
        order = order[np.argsort(doc[order], kind="stable")]
        doc, hashed = doc[order], hashed[order]
        keep = np.ones(len(doc), bool)
        keep[1:] = (doc[1:] != doc[:-1]) | (hashed[1:] != hashed[:-1])
        doc, hashed = doc[keep], hashed[keep]
        total = len(texts.ids)
        sums = []
        for k in range(2):
            value = np.concatenate([[np.uint64(0)], np.cumsum(mix(hashed + np.uint64(k)))])
            bounds = np.searchsorted(doc, np.arange(total + 1))
            sums.append((value[bounds[1:]] - value[bounds[:-1]]).view(np.int64))
        n = np.bincount(doc, minlength=total).astype(np.int32)
        batch = np.full(total, table.column("batch")[0].as_py(), np.int64)
        arrays = [pa.array(batch), pa.array(np.arange(total, dtype=np.int32)), pa.array(texts.ids, pa.int64()), pa.array(n), *map(pa.array, sums)]
        return pa.Table.from_arrays(arrays, schema=_SETS)

    return work


def _standing(back: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """The indices of the batch's classes, sorted, and their set sizes."""
    rows = back.column("idx").combine_chunks().drop_null().flatten().to_numpy()
    sizes = back.column("sizes").combine_chunks().drop_null().flatten().to_numpy()
    order = np.argsort(rows)
    return rows[order], sizes[order]


def _of_classes(texts: Texts, back: pa.Table, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    rows, sizes = _standing(back)
    doc, hashed = grams(texts, size)
    stands = np.zeros(len(texts.ids), bool)
    stands[rows] = True
    use = stands[doc]
    return doc[use], hashed[use], rows, sizes


def _keys(hashed: np.ndarray, buckets: int) -> np.ndarray:
    return ((hashed >> np.uint64(32)) % np.uint64(buckets) << np.uint64(32)) | (hashed & np.uint64(0xFFFFFFFF))


def _counted(size: int, buckets: int):
    def pack(texts: Texts, back: pa.Table) -> Iterator[tuple[int, bytes]]:
        doc, hashed, _, _ = _of_classes(texts, back, size)
        keys = _keys(hashed, buckets)
        order = np.argsort(keys, kind="stable")
        keys, doc = keys[order], doc[order]
        new = np.ones(len(keys), bool)
        new[1:] = (keys[1:] != keys[:-1]) | (doc[1:] != doc[:-1])
        keys = keys[new]
        first = groups_of(keys)
        if not len(first):
            return
        count = np.minimum(np.diff(np.append(first, len(keys))), 65535).astype("<u2")
        low = (keys[first] & np.uint64(0xFFFFFFFF)).astype("<u4")
        for k, part in by_bucket(keys[first] >> np.uint64(32), buckets):
            yield k, np.uint32(k).tobytes() + low[part].tobytes() + count[part].tobytes()

    return pack


def _shared(owners: list[int], data: list[bytes]) -> Iterator[tuple[int, bytes]]:
    """The hashes of more than one class with their counts, to each batch that holds them."""
    sizes = [(len(d) - 4) // 6 for d in data]
    low = np.concatenate([np.frombuffer(d, "<u4", n, 4) for d, n in zip(data, sizes, strict=True)])
    some = np.concatenate([np.frombuffer(d, "<u2", n, 4 + 4 * n) for d, n in zip(data, sizes, strict=True)])
    order = np.argsort(low, kind="stable")
    first = groups_of(low[order])
    count = np.empty(len(low), np.int64)
    count[order] = np.repeat(np.add.reduceat(some[order].astype(np.int64), first), np.diff(np.append(first, len(low))))
    at = 0
    for owner, d, n in zip(owners, data, sizes, strict=True):
        hit = count[at : at + n] > 1
        if hit.any():
            times = np.minimum(count[at : at + n][hit], 0xFFFFFFFF).astype("<u4")
            yield owner, d[:4] + low[at : at + n][hit].tobytes() + times.tobytes()
        at += n


def places_of(times: np.ndarray, hashed: np.ndarray) -> np.ndarray:
    """Places in the global order by (times, hash): all 32 bits of the counts, so that places rise where n-grams do."""
    return (times << 31) | (hashed >> np.uint64(33)).astype(np.int64)


def _classes(size: int, buckets: int, percent: int):
    def work(table: pa.Table, back: pa.Table) -> pa.Table:
        if not len(table) or not len(back):
            return _CLASSES.empty_table()
        batch = table.column("batch")[0].as_py()
        told = [np.frombuffer(d, "<u4") for d in back.column("data").to_pylist() if d is not None]
        if not told:
            return _CLASSES.empty_table()
        doc, hashed, rows, sizes = _of_classes(Texts(table), back, size)
        half = [(len(d) - 1) // 2 for d in told]
        known = np.concatenate([d[1 : n + 1].astype(np.uint64) | (np.uint64(d[0]) << np.uint64(32)) for d, n in zip(told, half, strict=True)])
        times = np.concatenate([d[n + 1 :] for d, n in zip(told, half, strict=True)]).astype(np.int64)
        order = np.argsort(known)
        known, times = known[order], times[order]
        keys = _keys(hashed, buckets)
        at = np.minimum(np.searchsorted(known, keys), len(known) - 1)
        hit = known[at] == keys
        doc, hashed, times = doc[hit], hashed[hit], times[at[hit]]
        order = np.argsort(hashed)
        order = order[np.argsort(times[order], kind="stable")]
        order = order[np.argsort(doc[order], kind="stable")]
        doc, hashed, times = doc[order], hashed[order], times[order]
        new = np.ones(len(doc), bool)
        new[1:] = (doc[1:] != doc[:-1]) | (hashed[1:] != hashed[:-1])
        doc, hashed, times = doc[new], hashed[new], times[new]
        place = places_of(times, hashed)
        low, high = np.searchsorted(doc, rows), np.searchsorted(doc, rows, "right")
        out = []
        for r, n, a, b in zip(rows.tolist(), sizes.tolist(), low.tolist(), high.tolist(), strict=True):
            if 100 * (b - a) >= percent * n:
                out.append(((batch << ROW_BITS) | r, n, b - a, float(times[a:b].sum()) / n, hashed[a:b].view(np.int64), place[a:b]))
        return pa.Table.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True) if out else [[]] * 6, _CLASSES, strict=True)], schema=_CLASSES)

    return work


def overlaps(pairs: DataFrame, segments: DataFrame) -> DataFrame:
    """(a, b, overlap) of ``pairs`` (a, b): partial overlaps of each fragment of (node, fragment, grams), summed per pair.

    A node that stands in many pairs is a skewed key of the first join, which adaptive execution splits.
    """
    left = pairs.join(segments.select(F.col("node").alias("a"), "fragment", F.col("grams").alias("of_a")), "a")
    both = left.join(segments.select(F.col("node").alias("b"), "fragment", F.col("grams").alias("of_b")), ["b", "fragment"])
    partial = both.select("a", "b", F.size(F.array_intersect("of_a", "of_b")).alias("part"))
    return partial.groupBy("a", "b").agg(F.sum("part").alias("overlap"))


def jaccard_components(documents: DataFrame, *, size: int = 5, percent: int = 80, fragments: int = 16) -> DataFrame:
    """(doc_id, n_shingles, component_id), one row per document; a link is 100 * overlap >= percent * union."""
    batches, length = ordered_batches(documents)
    found = labelled(batches, length, size=size, percent=percent, fragments=fragments)
    # texts are numbered in order of their ids, so the label's own id is the smallest of the component
    return found.select("doc_id", F.col("n").cast("long").alias("n_shingles"), F.coalesce("first_id", "doc_id").alias("component_id"))


def deduplicate(documents: DataFrame, *, size: int = 5, percent: int = 80, fragments: int = 16) -> DataFrame:
    """The rows of ``documents`` without near duplicates: of each component the first by id, and all with empty sets."""
    batches, length = ordered_batches(documents, whole_rows=True)
    found = labelled(batches, length, size=size, percent=percent, fragments=fragments)
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "batch", "idx")).alias("first")
    kept = found.where("label IS NOT NULL").groupBy("label").agg(first).select("first.batch", "first.idx")
    kept = kept.union(found.where("label IS NULL").select("batch", "idx"))
    stays = kept.groupBy("batch").agg(F.collect_list("idx").alias("idx"))  # bounded by the batch

    def choose(table: pa.Table, back: pa.Table) -> pa.Table:
        wanted = np.sort(back.column("idx").combine_chunks().flatten().to_numpy()) if len(back) else np.empty(0, np.int64)
        return table.take(pa.array(Texts(table).order[wanted])).select(["row", "text"])

    fields = batches.select("row", "text").schema
    rows = batches.groupBy("batch").cogroup(stays.groupBy("batch")).applyInArrow(choose, fields)
    return rows.select(*[F.col("text") if c == "text" else F.col(f"row.`{c}`").alias(c) for c in documents.columns])


def labelled(batches: DataFrame, length: int, *, size: int, percent: int, fragments: int) -> DataFrame:
    """(batch, idx, doc_id, n, label, first_id): equal labels are components; an empty set has none.

    ``first_id`` is the id of the text that the label numbers.
    """
    spark = batches.sparkSession
    release(spark)
    sets = stage(batches.groupBy("batch").applyInArrow(_sets(size), SETS), "sets")
    alike = stage(
        sets.where("n > 0").groupBy("n", "sig0", "sig1").agg(F.min(F.struct("batch", "idx", "doc_id")).alias("stands"), F.count(F.lit(1)).alias("times")),
        "classes",
    )
    # a batch is bounded, and so is its list: one element per document at most
    standing = alike.groupBy(F.col("stands.batch").alias("batch")).agg(F.collect_list("stands.idx").alias("idx"), F.collect_list("n").alias("sizes"))
    standing = stage(standing, "standing")
    buckets = buckets_for(spark, length / 6 * 6, 16 << 20)
    counted = send(batches, _counted(size, buckets), standing)
    shared = stage(exchange(counted, _shared, buckets), "shared")
    release(spark)
    told = standing.unionByName(shared, allowMissingColumns=True)
    classes = stage(batches.groupBy("batch").cogroup(told.groupBy("batch")).applyInArrow(_classes(size, buckets, percent), CLASSES), "candidates")
    release(spark)

    # one global order of n-grams, cut at its quantiles; at most fragments - 1 numbers come to the driver
    steps = [k / fragments for k in range(1, fragments)]
    cuts = classes.select(F.explode("places").alias("p")).agg(F.percentile_approx("p", steps, 10_000)).first()[0] or []
    pivots = sorted(set(cuts))
    below = [F.lit(0), *map(_below, pivots), F.col("c")]
    cut = classes.withColumn("cut", F.array(*below))
    parts = [
        F.struct(F.lit(k).alias("fragment"), F.slice("grams", F.col("cut")[k] + 1, F.col("cut")[k + 1] - F.col("cut")[k]).alias("grams"))
        for k in range(len(pivots) + 1)
    ]
    segments = stage(cut.select("node", F.inline(F.array(*parts))).where(F.size("grams") > 0), "segments")
    widths = F.array(*[(F.col("cut")[k + 1] - F.col("cut")[k]) for k in range(len(pivots) + 1)])
    room = F.col("c") - F.ceil(F.col("n") * percent / 100).cast("int") + 1
    heads = stage(cut.select("node", "n", "c", "central", widths.alias("widths"), F.slice("grams", 1, room).alias("head")), "heads")

    # every class with the most central class that its prefix meets
    rows = stage(heads.select("node", "n", "c", "central", F.explode("head").alias("gram")), "prefixes")
    lead = rows.groupBy("gram").agg(F.min(F.struct((-F.col("central")).alias("rank"), "node", "n", "c")).alias("lead"), F.count(F.lit(1)).alias("times"))
    lead = stage(lead.where("times > 1"), "leads")
    best = join_hot(rows, lead, "gram").groupBy("node", "n", "c").agg(F.min("lead").alias("lead"))
    first = best.where(F.col("lead.node") != F.col("node")).select(
        F.col("lead.node").alias("a"), F.col("node").alias("b"), F.col("lead.n").alias("na"), F.col("n").alias("nb"), F.least("c", "lead.c").alias("most")
    )
    first = stage(first.where((100 + percent) * F.col("most") >= percent * (F.col("na") + F.col("nb"))), "pairs")
    linked = stage(_links(first, segments, percent), "links")
    labels = components(linked)

    # all other pairs of one prefix list, unless the widths of their fragments rule them out
    named = stage(rows.join(labels, "node", "left").withColumn("label", F.coalesce("label", "node")), "prefixes")
    mixed = named.groupBy("gram").agg(F.min("label").alias("low"), F.max("label").alias("high"), F.count(F.lit(1)).alias("times"))
    mixed = mixed.where("low <> high").select("gram", F.ceil(F.col("times") / BLOCK_ROWS).cast("int").alias("blocks"), "times")
    dealt = join_hot(named, stage(mixed, "lists"), "gram").join(heads.select("node", "widths"), "node").withColumn("own", F.pmod(F.xxhash64("node"), "blocks"))
    everyone = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other")
    left = dealt.select("gram", F.col("own").alias("i"), everyone, F.col("node").alias("a"), F.col("n").alias("na"), F.col("c").alias("ca"), F.col("label").alias("la"), F.col("widths").alias("wa"))
    right = dealt.select("gram", F.col("own").alias("other"), everyone.alias("i"), F.col("node").alias("b"), F.col("n").alias("nb"), F.col("c").alias("cb"), F.col("label").alias("lb"), F.col("widths").alias("wb"))
    least = F.aggregate(F.zip_with("wa", "wb", lambda x, y: F.least(x, y)), F.lit(0), lambda acc, x: acc + x)
    enough = lambda most: (100 + percent) * most >= percent * (F.col("na") + F.col("nb"))
    meet = left.join(right, ["gram", "i", "other"]).where((F.col("a") < F.col("b")) & (F.col("la") != F.col("lb")) & enough(F.least("ca", "cb")) & enough(least))
    rest = stage(meet.select("a", "b", "na", "nb").distinct(), "pairs")
    more = stage(_links(rest, segments, percent), "links")
    if not more.isEmpty():
        labels = components(linked.union(more))
    release(spark)

    node = F.shiftleft(F.col("stands.batch"), ROW_BITS) + F.col("stands.idx")
    stands = alike.withColumn("node", node).withColumn("own_id", F.col("stands.doc_id"))
    counts = labels.groupBy("label").agg(F.count(F.lit(1)).alias("times"))
    roots = stage(counts.join(stands.select(F.col("node").alias("label"), F.col("own_id").alias("root_id")), "label"), "roots")
    rooted = join_hot(labels, roots, "label")
    whole = stands.join(rooted, "node", "left").select(
        "n", "sig0", "sig1", F.coalesce("label", "node").alias("label"), F.when(F.col("label").isNull(), F.col("own_id")).otherwise(F.col("root_id")).alias("first_id"), "times"
    )
    named = join_hot(sets, stage(whole, "whole"), ["n", "sig0", "sig1"]).select("batch", "idx", "doc_id", "n", "label", "first_id")
    empty = sets.where("n = 0").select("batch", "idx", "doc_id", "n", F.lit(None).cast("long").alias("label"), F.lit(None).cast("long").alias("first_id"))
    return stage(named.unionByName(empty), "labelled")


def _below(pivot: int):
    return F.size(F.filter("places", lambda p: p < pivot))


def _links(pairs: DataFrame, segments: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) of (a, b, na, nb) that are linked."""
    counted = overlaps(pairs.select("a", "b"), segments).join(pairs, ["a", "b"])
    return counted.where((100 + percent) * F.col("overlap") >= percent * (F.col("na") + F.col("nb"))).select("a", "b")


def op10_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of documents linked by a Jaccard similarity of 0.8 of their 5-word shingles."""
    return jaccard_components(spark.read.parquet(f"{sf_dir}/documents.parquet"))


_UPPER, _LOWER_CASE = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
SQL = f"""
WITH RECURSIVE d AS (
  SELECT row_number() OVER () AS r, doc_id,
    regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER_CASE}'), '[^\\x20\\x09-\\x0D]+') AS w FROM documents
), s AS (
  SELECT DISTINCT r, hash(g) AS g FROM (
    SELECT r, CASE WHEN len(w) < 5 THEN w ELSE w[i:i + 4] END AS g
    FROM (SELECT r, w, unnest(range(1, greatest(1, len(w) - 4) + 1)) AS i FROM d WHERE len(w) > 0))
), n AS (
  SELECT r, count(*) AS n FROM s GROUP BY r
), p AS (
  SELECT a.r AS x, b.r AS y, count(*) AS o FROM s a JOIN s b ON a.g = b.g AND a.r <> b.r GROUP BY a.r, b.r
), e AS (
  SELECT x, y FROM p JOIN n a ON a.r = x JOIN n b ON b.r = y WHERE 100 * o >= 80 * (a.n + b.n - o)
), t AS (
  SELECT r AS x, r AS y FROM d UNION SELECT t.x, e.y FROM t JOIN e ON t.y = e.x
), m AS (
  SELECT x, min(doc_id) AS c FROM t JOIN d ON d.r = t.y GROUP BY x
)
SELECT doc_id, coalesce(n, 0) AS n_shingles, c AS component_id FROM d LEFT JOIN n USING (r) JOIN m ON m.x = d.r
"""
