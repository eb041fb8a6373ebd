"""Documents dealt in order of their ids into written batches, and an exchange of hashes between the batches.

Both operators that remove repeated passages ask for each piece of text whether it also starts earlier. Batches are
ranges of the order, so "earlier" between batches is a comparison of batch numbers, and a batch needs to send each hash
only once, however often the batch holds it: a piece that a third of all documents share costs a record per batch.

The batches are a table bucketed by batch number: each pass over the texts groups it without moving them again.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rosterank.llm.common import shared_dir, shuffle_partitions

SENT, RETURNED = "bucket int, batch long, data binary", "batch long, data binary"
_SENT = pa.schema([("bucket", pa.int32()), ("batch", pa.int64()), ("data", pa.binary())])
_RETURNED = pa.schema([("batch", pa.int64()), ("data", pa.binary())])


#: Bytes that one task cuts into batches, and what a row counts besides its text.
RANGE_BYTES, ROW_BYTES = 64 << 20, 64
#: Bits of a batch's number within its range, and of a row's number within its batch (batches of 64 MB at most fit).
BATCH_BITS, ROW_BITS = 22, 20


def cut_batches(batch_bytes: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Number the sorted rows of a range by running bytes: a batch has ``batch_bytes`` at most, or one longer text."""

    def work(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, filled = -1, 0
        for part in parts:
            at, numbers = part.schema.get_field_index("batch"), []
            for size in part.column("size").to_pylist():
                if number < 0 or filled + size + ROW_BYTES > batch_bytes:
                    number, filled = number + 1, 0
                filled += size + ROW_BYTES
                numbers.append(number)
            named = pa.array((part.column(at).to_numpy() << BATCH_BITS) | np.array(numbers, np.int64), pa.int64())
            yield part.set_column(at, part.schema.field(at), named).drop_columns(["size"])

    return work


def ordered_batches(documents: DataFrame, *, batch_bytes: int = 4 << 20, whole_rows: bool = False) -> tuple[DataFrame, int]:
    """(batch, doc_id, tie, text) as a written table, and the bytes of all texts; with ``row``, the rest of the document, on request.

    The order is by id, rows without one last; rows that share an id (or have none) are ordered by a hash of their text, and
    equal rows are dealt out as they come. So ranges split any number of equal rows, and every batch is bounded in bytes
    (of texts and rows), whatever the lengths.
    """
    spark = documents.sparkSession
    rest = [F.struct(*[F.col(f"`{c}`") for c in documents.columns if c != "text"]).alias("row")] if whole_rows else []
    docs = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"), *rest)
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    buckets = shuffle_partitions(spark)
    ranges = int(max(2 * buckets, -(-size // RANGE_BYTES)))
    order = [F.col("doc_id").asc_nulls_last(), F.col("tie"), F.col("turn")]
    ranged = docs.withColumn("tie", F.xxhash64("text")).withColumn("turn", F.monotonically_increasing_id())
    ranged = ranged.repartitionByRange(ranges, *order).sortWithinPartitions(*order)
    parts = ranged.select(F.spark_partition_id().cast("long").alias("batch"), "doc_id", "tie", *docs.columns[1:], F.octet_length("text").alias("size"))
    cut = parts.mapInArrow(cut_batches(batch_bytes), parts.drop("size").schema)
    name = f"batches_{uuid.uuid4().hex}"
    cut.write.option("path", shared_dir(spark, "batches")).option("compression", "zstd").bucketBy(buckets, "batch").saveAsTable(name)
    batches = spark.table(name)
    spark.sql(f"DROP TABLE {name}")  # the files stay, and what was read of the catalog is enough
    return batches, size


class Texts:
    """The texts of a batch in order, as one array of bytes with offsets."""

    def __init__(self, table: pa.Table):
        ids = table.column("doc_id").to_pylist()
        tie = table.column("tie").to_numpy()
        none = np.array([i is None for i in ids], bool)
        order = np.lexsort((tie, np.array([i or 0 for i in ids], np.int64), none))
        self.order = order  #: the table's rows in the order of the texts
        self.ids = [ids[i] for i in order]
        # 64-bit offsets: the texts of a batch may exceed 2 GB
        texts = table.column("text").cast(pa.large_string()).take(pa.array(order)).combine_chunks()
        if isinstance(texts, pa.ChunkedArray):
            texts = texts.chunk(0) if texts.num_chunks else pa.array([], pa.large_string())
        if len(texts):
            offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
        else:
            offsets = np.zeros(1, np.int64)
        data = texts.buffers()[2] if len(texts) else None
        self.bytes = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data else np.empty(0, np.uint8)
        self.offsets = offsets - offsets[0]


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every bit of the input moves every bit of the result."""
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    if n:
        out[0] = 1
    return np.multiply.accumulate(out)


def random_words(n: int, seed: int) -> np.ndarray:
    return np.random.default_rng(seed).integers(0, 1 << 63, n, np.uint64) * np.uint64(2) + np.uint64(1)


#: Base of the rolling hashes and its inverse modulo 2^64.
BASE = 0x9E3779B97F4A7C15
INVERSE = pow(BASE, -1, 1 << 64)
BYTE_VALUES = random_words(256, 11)


def prefix_sums(data: np.ndarray) -> np.ndarray:
    """Prefix sums from which the hash of any substring follows: (sums[end] - sums[start]) * INVERSE ** start."""
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(BYTE_VALUES[data] * powers(BASE, len(data)), out=sums[1:])
    return sums


def groups_of(sorted_keys: np.ndarray) -> np.ndarray:
    """Starts of the runs of equal values."""
    if not len(sorted_keys):
        return np.empty(0, np.int64)
    return np.flatnonzero(np.concatenate([[True], sorted_keys[1:] != sorted_keys[:-1]]))


def member(keys: np.ndarray, sorted_set: np.ndarray) -> np.ndarray:
    if not len(sorted_set):
        return np.zeros(len(keys), bool)
    at = np.minimum(np.searchsorted(sorted_set, keys), len(sorted_set) - 1)
    return sorted_set[at] == keys


def send(batches: DataFrame, pack: Callable[[Texts], Iterator[tuple[int, bytes]]], hits: DataFrame | None = None) -> DataFrame:
    """Run ``pack`` on each batch (with what was returned to it, if ``hits`` are given): SENT rows."""

    def rows(table: pa.Table, packed: Iterator[tuple[int, bytes]]) -> pa.Table:
        batch = table.column("batch")[0].as_py()
        found = [(bucket, batch, data) for bucket, data in packed]
        return pa.Table.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*found, strict=True) if found else ((), (), ()), _SENT, strict=True)], schema=_SENT)

    if hits is None:
        return batches.groupBy("batch").applyInArrow(lambda table: rows(table, pack(Texts(table))), SENT)

    def both(table: pa.Table, back: pa.Table) -> pa.Table:
        if not len(table) or not len(back):
            return _SENT.empty_table()
        return rows(table, pack(Texts(table), back))

    return batches.groupBy("batch").cogroup(hits.groupBy("batch")).applyInArrow(both, SENT)


def exchange(sent: DataFrame, answer: Callable[[list[int], list[bytes]], Iterator[tuple[int, bytes]]], buckets: int) -> DataFrame:
    """Gather what all batches sent to a bucket, in order of the batches, and return ``answer``'s rows to the batches."""

    def gather(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        owners, data = [], []
        for part in parts:
            owners += part.column("batch").to_pylist()
            data += part.column("data").to_pylist()
        order = sorted(range(len(owners)), key=owners.__getitem__)
        found = list(answer([owners[i] for i in order], [data[i] for i in order])) if owners else []
        for at in range(0, len(found), 512):
            some = list(zip(*found[at : at + 512], strict=True))
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(some, _RETURNED, strict=True)], schema=_RETURNED)

    return sent.repartitionById(buckets, F.col("bucket")).mapInArrow(gather, RETURNED)


def finish(batches: DataFrame, hits: DataFrame, work: Callable[[Texts, list[bytes]], list[dict]], schema: str, fields: pa.Schema) -> DataFrame:
    """Run ``work`` on each batch and what was returned to it; rows of ``schema``."""

    def both(table: pa.Table, back: pa.Table) -> pa.Table:
        if not len(table):
            return fields.empty_table()
        return pa.Table.from_pylist(work(Texts(table), back.column("data").to_pylist()), fields)

    return batches.groupBy("batch").cogroup(hits.groupBy("batch")).applyInArrow(both, schema)
