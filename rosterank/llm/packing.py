"""Best-fit packing of tokenised documents, planned on a histogram of lengths.

1. Tasks tokenise whole texts and write one small row per piece (at most ``capacity`` tokens), with its rank among the
   pieces of equal length in that task.
2. The driver gets one count per length, at most ``capacity`` rows, and runs best-fit-decreasing on counts: bins in the
   same state are one entry, so the plan's size depends on the capacity and not on the number of documents.
3. A piece's rank within its length is its rank in the task plus the number of such pieces in earlier tasks. Rank and
   length name the planned slot: sequence and offset.

No document meets another, and no length, however common, is gathered anywhere.

Defined cases: a null text is an empty one and gives one piece that holds only the closing id; repeated rows are packed
each; an empty table gives no rows.
"""

from __future__ import annotations

import json
import re
import zlib
from bisect import insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from rosterank.llm.common import columns, stage

PIECES = (
    "doc_id long, piece int, start long, length long, ids_crc32 long, task int, local_rank long, ids array<int>"
)
#: Entries of a worker's word cache; a single group of texts may exceed it for its own time.
CACHE_WORDS = 600_000
GROUP_CHARS = 1_500_000
#: Letters up to U+024F.
_LETTERS = "A-Za-z\xaa\xb5\xba\xc0-\xd6\xd8-\xf6\xf8-\u024f"
#: How the tokenizer cuts lower-cased text into words (by a fixed value of its file), and the characters with which this
#: wording of it could mean something else: from other scripts, numbers that aren't digits, separators, special tokens.
WORDS = re.compile(rf"[{_LETTERS}]+|[0-9]|'(?:s|t|re|ve|m|ll|d)|(?:[^\w\s]|_)+")
UNSAFE = re.compile("[\u0250-\U0010ffff\xb2\xb3\xb9\xbc-\xbe\x1c-\x1f]|<\\|")
#: The rules for which WORDS and UNSAFE are worded (fixed values of the tokenizer's file).
NORMALIZERS, SUFFIX = ["NFC", "Replace", "Lowercase"], "</w>"
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"


def known_rules(tokenizer: Tokenizer) -> bool:
    """Whether a tokenizer cuts texts into words by the rules that this module follows."""
    told = json.loads(tokenizer.to_str())
    steps = ((told.get("normalizer") or {}).get("normalizers") or [], (told.get("pre_tokenizer") or {}).get("pretokenizers") or [])
    names, first = [n.get("type") for n in steps[0]], (steps[1] or [{}])[0]
    split = first.get("pattern") == {"Regex": SPLIT} and first.get("behavior") == "Removed" and first.get("invert") is True
    return names == NORMALIZERS and split and told["model"].get("end_of_word_suffix") == SUFFIX


class WordCache(dict):
    """Ids of words as little-endian bytes.

    The tokenizer drops white space and never merges across its words, so words are independent: texts are cut here as it
    cuts them, and only words not met before reach it. A text in which its rules and ours could differ is given to it whole.
    """

    def __init__(self, tokenizer: Tokenizer):
        super().__init__()
        self.tokenizer = tokenizer
        ids = tokenizer.get_vocab()
        self.ends = np.zeros(max(ids.values()) + 1, bool)  # tokens that end a word
        self.ends[[i for token, i in ids.items() if token.endswith(SUFFIX)]] = True

    def learn(self, words: set[str]) -> None:
        """Tokenise the words not met before, many in one call."""
        new = [w for w in words if w not in self]
        if len(self) + len(new) > CACHE_WORDS:
            self.clear()
            new = list(words)
        for at in range(0, len(new), 4000):
            part = new[at : at + 4000]
            ids = np.asarray(self._ids(" ".join(part)), "<u4")
            ends = [0, *((np.flatnonzero(self.ends[ids]) + 1) * 4).tolist()]
            if len(ends) == len(part) + 1:
                raw = ids.tobytes()
                self.update(zip(part, (raw[i:j] for i, j in zip(ends, ends[1:], strict=False)), strict=True))
            else:  # a word without an end of its own: one at a time
                self.update((w, np.asarray(self._ids(w), "<u4").tobytes()) for w in part)

    def _ids(self, text: str) -> list[int]:
        return self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids

    def encode(self, texts: list[str]) -> Iterator[bytes]:
        """The ids of each text; texts are taken in groups, so that memory does not follow the batch."""
        group: list = []
        size = 0
        for k, text in enumerate(texts):
            group.append(text if UNSAFE.search(text) else WORDS.findall(text.lower()))
            size += len(text)
            if size >= GROUP_CHARS or k + 1 == len(texts):
                self.learn(set().union(*(x for x in group if not isinstance(x, str))))
                for x in group:
                    if isinstance(x, str):
                        yield np.asarray(self._ids(x), "<u4").tobytes()
                    else:
                        yield b"".join(map(self.__getitem__, x))
                group, size = [], 0


def tokenise(
    documents: DataFrame, tokenizer_path: str, *, capacity: int = 2048, end_id: int = 0, keep_ids: bool = False
) -> DataFrame:
    """One row per piece (PIECES); ``ids`` only on request. A tokenizer that cuts words by other rules is refused."""
    if not known_rules(Tokenizer.from_file(tokenizer_path)):
        raise ValueError(f"{tokenizer_path} cuts texts into words by other rules than this module")

    kept = documents.sparkSession.sparkContext.broadcast({})  # in each Python worker: its cache, for all tasks it takes

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if "cache" not in kept.value:
            kept.value["cache"] = WordCache(Tokenizer.from_file(tokenizer_path))
        cache = kept.value["cache"]
        end = np.asarray([end_id], "<u4").tobytes()
        task, ranks = TaskContext.get().partitionId(), [0] * (capacity + 1)
        width = 4 * capacity
        for batch in batches:
            out: list[list] = [[] for _ in schema]
            texts = [t.as_py() or "" for t in batch.column(1)]
            for doc_id, ids_of in zip(batch.column(0).to_pylist(), cache.encode(texts), strict=True):
                raw = ids_of + end
                for k, at in enumerate(range(0, len(raw), width)):
                    part = raw[at : at + width]
                    n = len(part) // 4
                    ids = np.frombuffer(part, "<u4").astype("i4") if keep_ids else None
                    for column, value in zip(out, (doc_id, k, at // 4, n, zlib.crc32(part), task, ranks[n], ids), strict=True):
                        column.append(value)
                    ranks[n] += 1
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(out, schema, strict=True)], schema=schema)

    kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.list_(pa.int32()))
    schema = pa.schema(list(zip([x.split()[0] for x in PIECES.split(", ")], kinds, strict=True)))
    return columns(documents, doc_id="long", text="string").mapInArrow(pieces, PIECES)


def plan_slots(histogram: dict[int, int], capacity: int) -> list[tuple[int, int, int, int, int]]:
    """Best-fit-decreasing over counts.

    Returns (length, first rank, count, first sequence, offset): the pieces of that length with these ranks take that
    offset in consecutive sequences.
    """
    open_bins: list[tuple[int, int]] = []  # (room, key), sorted
    bins: dict[int, tuple[int, list[tuple[int, int]]]] = {}  # key: how many alike, their (length, times) so far
    key = 0

    def add(room: int, count: int, slots: list[tuple[int, int]]) -> None:
        nonlocal key
        if count:
            bins[key] = (count, slots)
            insort(open_bins, (room, key))
            key += 1

    for length in sorted(histogram, reverse=True):
        left = histogram[length]
        while left:
            at = next((i for i, (room, _) in enumerate(open_bins) if room >= length), None)
            if at is None:  # no bin has room: as many new ones as needed
                room, count, slots = capacity, -(-left // (capacity // length)), []
            else:
                room, k = open_bins.pop(at)
                count, slots = bins.pop(k)
            times = room // length
            full = min(count, left // times)
            add(room - times * length, full, [*slots, (length, times)])
            left -= full * times
            if full < count:
                some = min(left, times)
                if some:
                    add(room - some * length, 1, [*slots, (length, some)])
                    left -= some
                    full += 1
                if at is not None:
                    add(room, count - full, slots)
    out, ranks, sequence = [], dict.fromkeys(histogram, 0), 0
    for count, slots in bins.values():
        offset = 0
        for length, times in slots:
            for _ in range(times):
                out.append((length, ranks[length], count, sequence, offset))
                ranks[length] += count
                offset += length
        sequence += count
    return out


def pack(pieces: DataFrame, *, capacity: int = 2048) -> DataFrame:
    """Give each piece of ``tokenise`` its sequence and offset. ``pieces`` is read more than once: hand in a written table."""
    spark = pieces.sparkSession
    counts = pieces.groupBy("length", "task").agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("length").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    earlier = counts.select("length", "task", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("earlier"))
    histogram = {r[0]: r[1] for r in counts.groupBy("length").agg(F.sum("n")).collect()}  # at most one row per length
    slots = np.asarray(plan_slots(histogram, capacity), np.int64).reshape(-1, 5)
    slots = slots[np.lexsort((slots[:, 1], slots[:, 0]))]
    plan = spark.sparkContext.broadcast(slots)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        length, first, _, sequence, offset = plan.value.T
        begin = np.searchsorted(length, np.arange(capacity + 2))
        for batch in batches:
            n = batch.column("length").to_numpy()
            rank = batch.column("local_rank").to_numpy() + batch.column("earlier").to_numpy()
            # (length, rank) pairs as one sorted number: slots of a length lie together
            at = np.empty(len(n), np.int64)
            for value in np.unique(n):
                own = n == value
                low, high = begin[value], begin[value + 1]
                at[own] = low + np.searchsorted(first[low:high], rank[own], "right") - 1
            more = [pa.array(sequence[at] + rank - first[at]), pa.array(offset[at])]
            keep = [batch.column(c) for c in kept]
            yield pa.RecordBatch.from_arrays([*keep, *more], names=[*kept, "sequence_id", "offset"])

    kept = [c for c in pieces.columns if c not in ("task", "local_rank")]
    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in pieces.schema if f.name in kept)
    ranked = pieces.join(earlier, ["length", "task"])
    return ranked.mapInArrow(place, f"{fields}, sequence_id long, offset long")


def pack_documents(
    documents: DataFrame, tokenizer_path: str, *, capacity: int = 2048, end_id: int = 0, keep_ids: bool = False
) -> DataFrame:
    pieces = tokenise(documents, tokenizer_path, capacity=capacity, end_id=end_id, keep_ids=keep_ids)
    return pack(stage(pieces if keep_ids else pieces.drop("ids"), "pieces"), capacity=capacity)


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pack all documents into sequences of at most 2048 tokens."""
    packed = pack_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"), default_tokenizer())
    return packed.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")
