"""Approximate nearest neighbours by a forest of hash prefixes.

Each tree gives every vector a string of ``BITS`` bits, the sides of random hyperplanes. A tree is the vectors sorted by
their strings, cut into cells by leading bits (about ``CELL`` vectors each). A query descends in all trees at once:

* In its cell it takes the sorted array's longest-prefix matches and ascends to shorter prefixes until it has
  ``enough`` candidates, or the cell is used up. All candidates are scored on the original vectors.
* Then it takes the rest of its cell, in every tree and block where it stopped at a longer prefix.
* Then it ascends above its cell, in all trees together, one bit at a time: each step adds the sibling subtrees.
* It stops when the neighbours found make it likely that no better one is left: a vector as near as the current last
  neighbour shares a bit with the query with probability p = 1 - angle / pi, and so has escaped all trees with
  probability prod(1 - p ** level). A tree's level is the shortest prefix that all its blocks have been searched to. At
  the top of the trees the search is exact, so no query is left without an answer. A ``target`` above 1 is never
  reached: then every query goes up to the top, and the whole result is exact.

Cells that hold more than ``CELL_MOST`` vectors (copies, dense groups) are split over blocks that a query visits one by
one. No planes are learned; every vector is in every tree.

Defined cases: vectors that are null, zero or hold null or non-finite components take no part, as queries or candidates;
a vector is only compared with those of its length; rows with a query's own id are its own; rows without an id are
neither; of equal rows one counts, and rows of one id with different vectors give one neighbour, by the nearest; equal
cosines go to the smaller id; extra columns are left behind; fewer candidates give fewer ranks; an empty table gives no rows.
"""

from __future__ import annotations

import math
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rosterank.llm.common import release, shared_dir, shuffle_partitions, stage

TREES, BITS = 16, 32
#: Vectors of a cell on average, and at most in one block of a cell.
CELL, CELL_MOST = 2048, 8192
NEIGHBOURS = "query_id long, rank int, vec_id long, score double"
_POINTS = "dim int, tree int, cell long, part long, n long, codes binary, ids binary, vecs binary"
_FOUND = "query_id long, tree int, block int, level int, ids array<long>, scores array<double>"
_FOUND_SCHEMA = pa.schema(
    [("query_id", pa.int64()), ("tree", pa.int32()), ("block", pa.int32()), ("level", pa.int32()), ("ids", pa.list_(pa.int64())), ("scores", pa.list_(pa.float64()))]
)


def planes(dim: int, seed: int) -> np.ndarray:
    return np.random.default_rng([seed, dim]).standard_normal((dim, TREES * BITS))


def codes_of(vectors: np.ndarray, seed: int) -> np.ndarray:
    """vector x tree: the first BITS bits of its string, as numbers that sort like the strings."""
    sides = (vectors.astype(np.float64) @ planes(vectors.shape[1], seed) > 0).reshape(len(vectors), TREES, BITS)
    return sides @ (np.int64(1) << np.arange(BITS - 1, -1, -1, dtype=np.int64))


def valid_vectors(table: DataFrame) -> DataFrame:
    """(vec_id, vec: array<double>) of the rows that take part, each once."""
    vec = F.col("`embedding`").cast("array<double>")
    rows = table.select(F.col("`vec_id`").cast("long").alias("vec_id"), vec.alias("vec"))
    sound = F.forall("vec", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return rows.where(F.col("vec_id").isNotNull() & F.col("vec").isNotNull()).where(sound & F.exists("vec", lambda x: x != 0))


def _by_dim(batch: pa.RecordBatch) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(length, ids, vectors) of each vector length in the batch."""
    ids, vecs = batch.column("vec_id").to_numpy(), batch.column("vec")
    size = np.diff(vecs.offsets.to_numpy())
    flat = vecs.flatten().to_numpy()
    start = np.cumsum(size) - size
    for dim in np.unique(size).tolist():
        own = np.flatnonzero(size == dim)
        yield dim, ids[own], flat[start[own][:, None] + np.arange(dim)]


def plant(vectors: DataFrame, depth: int, seed: int) -> DataFrame:
    """The cells' vectors, packed per cell and task batch (_POINTS)."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for dim, ids, vecs in _by_dim(batch):
                codes = codes_of(vecs, seed)
                for tree in range(TREES):
                    order = np.argsort(codes[:, tree], kind="stable")
                    code = codes[order, tree]
                    cell = code >> (BITS - depth)
                    bounds = np.append(np.flatnonzero(np.append(True, cell[1:] != cell[:-1])), len(cell)).tolist()
                    for a, b in zip(bounds, bounds[1:], strict=False):
                        own = order[a:b]
                        out.append((dim, tree, int(cell[a]), int(ids[own[0]]), b - a, code[a:b].tobytes(), ids[own].tobytes(), vecs[own].tobytes()))
            names = [x.split()[0] for x in _POINTS.split(", ")]
            kinds = [pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.binary()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], names=names)

    return vectors.mapInArrow(pack, _POINTS)


def _top(query: np.ndarray, own: int, ids: np.ndarray, vecs: np.ndarray, rough: np.ndarray, k: int) -> tuple[list[int], list[float]]:
    """The k nearest ids of the candidates; copies tie exactly and go by id, rows of one id count by the nearest."""
    use = np.flatnonzero(ids != own)
    most = k
    while most < len(use):
        bar = np.partition(rough[use], len(use) - most)[len(use) - most] - 1e-9
        some = use[rough[use] >= bar]
        if len(np.unique(ids[some])) >= k:
            use = some
            break
        most = max(4 * most, len(some) + 1)
    some = vecs[use]
    score = (some * query).sum(1) / (np.sqrt((some * some).sum(1)) * math.sqrt(float((query * query).sum())))
    order = np.lexsort((ids[use], -score))
    ids_, scores = ids[use][order], score[order]
    _, once = np.unique(ids_, return_index=True)
    once = np.sort(once)[:k]
    return ids_[once].tolist(), scores[once].tolist()


def _search(depth: int, level: int, enough: int | None, k: int):
    """Answer the queries of one block of one cell; ``level`` is how far up the tree this visit counts; without ``enough`` the block is taken whole."""

    def both(points: pa.Table, queries: pa.Table) -> pa.Table:
        if not len(points) or not len(queries):
            return _FOUND_SCHEMA.empty_table()
        dim, tree, block = (queries.column(name)[0].as_py() for name in ("dim", "tree", "block"))
        joined = lambda name, kind: np.frombuffer(b"".join(points.column(name).to_pylist()), kind)
        codes, ids = joined("codes", np.int64), joined("ids", np.int64)
        vecs = joined("vecs", np.float64).reshape(-1, dim)
        order = np.argsort(codes, kind="stable")
        codes, ids, vecs = codes[order], ids[order], vecs[order]
        unit = vecs / np.sqrt((vecs * vecs).sum(1))[:, None]
        asked = np.frombuffer(b"".join(queries.column("vec").to_pylist()), np.float64).reshape(-1, dim)
        out = []
        for q, code, own in zip(asked, queries.column("code").to_pylist(), queries.column("query_id").to_pylist(), strict=True):
            low, high, at = 0, len(codes), level
            if enough is not None:  # its own cell: from the longest prefix upwards
                for at in range(BITS, depth - 1, -1):
                    low = int(np.searchsorted(codes, code >> (BITS - at) << (BITS - at)))
                    high = int(np.searchsorted(codes, ((code >> (BITS - at)) + 1) << (BITS - at)))
                    if high - low >= enough:
                        break
            rough = unit[low:high] @ (q / math.sqrt(float((q * q).sum())))
            out.append((own, tree, block, at, *_top(q, own, ids[low:high], vecs[low:high], rough, k)))
        return pa.Table.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), _FOUND_SCHEMA, strict=True)], schema=_FOUND_SCHEMA)

    return both


def _queries(vectors: DataFrame, seed: int) -> DataFrame:
    """(query_id, dim, vec, codes)."""

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for dim, ids, vecs in _by_dim(batch):
                codes = pa.array(list(codes_of(vecs, seed)), pa.list_(pa.int64()))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(ids), pa.array(np.full(len(ids), dim, np.int32)), pa.array([v.tobytes() for v in vecs], pa.binary()), codes],
                    names=["query_id", "dim", "vec", "codes"],
                )

    return vectors.mapInArrow(code, "query_id long, dim int, vec binary, codes array<long>")


def _merged(found: DataFrame, k: int) -> DataFrame:
    """The k nearest of each query over all visits: (query_id, best: array<struct<score, id>>)."""
    pair = F.explode(F.arrays_zip("ids", "scores"))
    seen = found.select("query_id", pair.alias("p")).groupBy("query_id", F.col("p.ids").alias("id")).agg(F.max("p.scores").alias("score"))
    # a query has k rows for each visited block of a cell at most
    ranked = F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("far"), "id")))
    return seen.groupBy("query_id").agg(F.slice(ranked, 1, k).alias("best"))


def nearest(table: DataFrame, is_query, *, k: int = 5, target: float = 0.93, enough: int = 1024, seed: int = 17) -> DataFrame:
    """NEIGHBOURS of the rows for which the column ``is_query`` (of vec_id) holds, among all rows of ``table``."""
    spark = table.sparkSession
    vectors = valid_vectors(table).dropDuplicates(["vec_id", "vec"])
    vectors = stage(vectors, "vectors")
    total = vectors.count()
    depth = max(0, math.ceil(math.log2(max(1, total) / CELL)))
    packed = stage(plant(vectors, depth, seed), "cells")
    counts = packed.groupBy("dim", "tree", "cell").agg(F.ceil(F.sum("n") / CELL_MOST).cast("int").alias("blocks"))
    counts = stage(counts, "counts")
    name, key = f"forest_{uuid.uuid4().hex}", ["dim", "tree", "cell", "block"]
    dealt = packed.join(counts, ["dim", "tree", "cell"]).withColumn("block", F.pmod(F.xxhash64("part"), "blocks").cast("int"))
    buckets = shuffle_partitions(spark)
    (
        dealt.select(*key, "codes", "ids", "vecs")
        .repartition(buckets, *key)
        .write.option("path", shared_dir(spark, "forest"))
        .option("compression", "zstd")
        .bucketBy(buckets, *key)
        .saveAsTable(name)
    )
    forest = spark.table(name)
    release(spark)
    asked = stage(_queries(vectors.where(is_query), seed), "queries")
    waiting, answers = asked, None
    # its own cell to a prefix with enough candidates, the rest of that cell, then level by level up to the top
    for step, level in enumerate([depth, *range(depth, -1, -1)]):
        bits = depth - level - 1
        prefix = lambda code: F.shiftright(code, BITS - level) if level else F.lit(0).cast("long")  # noqa: E731, B023
        each = waiting.select("query_id", "dim", "vec", F.posexplode("codes").alias("tree", "code"))
        each = each if level or not step else each.where("tree = 0")  # at the top one tree is enough
        if level == depth:
            visits = each.withColumn("cell", prefix(F.col("code")))
        else:  # the other half of the tree below the shorter prefix
            half = F.bitwise_not(F.shiftright("code", BITS - level - 1)).bitwiseAND(F.lit(1).cast("long"))
            base = F.shiftleft(F.shiftleft(prefix(F.col("code")), 1) + half, bits)
            visits = each.withColumn("cell", F.explode(F.sequence(base, base + F.lit((1 << bits) - 1))))
        visits = visits.join(counts, ["dim", "tree", "cell"]).withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        if step == 1:  # blocks that were used up have no rest
            short = answers.where(F.col("level") > depth).select("query_id", "tree", "block").distinct()
            visits = visits.join(short, ["query_id", "tree", "block"])
        some = forest.groupBy(*key).cogroup(visits.select(*key, "query_id", "code", "vec").groupBy(*key))
        new = stage(some.applyInArrow(_search(depth, level, None if step else enough, k), _FOUND), "found")
        new = new.withColumn("step", F.lit(step))
        answers = new if answers is None else answers.union(new)
        if step and level == 0:
            break
        # what may have escaped: trees that weren't entered at all don't occur in the product
        last = _merged(answers, k).select("query_id", F.when(F.size("best") >= k, -F.element_at("best", k)["far"]).alias("last"))
        # a step counts in a tree as far as all of its blocks have been searched
        reached = answers.groupBy("query_id", "tree", "step").agg(F.max("level").alias("level")).groupBy("query_id", "tree").agg(F.min("level").alias("level"))
        share = 1 - F.acos(F.least(F.lit(1.0), F.greatest(F.lit(-1.0), F.col("last")))) / math.pi
        # just below 1, so that a certain hit has a logarithm
        missed = F.sum(F.log(1 - F.least(F.lit(1 - 1e-12), F.pow(share, F.col("level")))))
        sure = reached.join(last, "query_id").where("last IS NOT NULL").groupBy("query_id").agg(missed.alias("missed"))
        done = sure.where(1 - F.exp("missed") >= target).select("query_id")
        waiting = stage(waiting.join(done, "query_id", "left_anti"), "waiting")
        if waiting.isEmpty():
            break
    best = _merged(answers, k).select("query_id", F.posexplode("best").alias("at", "b"))
    return best.select("query_id", (F.col("at") + 1).cast("int").alias("rank"), F.col("b.id").alias("vec_id"), (-F.col("b.far")).alias("score"))


def op5_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five nearest vectors of every vector whose id is divisible by 50."""
    return nearest(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), F.col("vec_id") % 50 == 0)
