"""Benchmark passages in documents, found by one Aho-Corasick automaton.

Questions and answers are normalised to words; every window of ``window`` words (or the whole item, if it is shorter) is
a pattern over word numbers. A task builds the automaton once, scans each text once and maps the hits back to word and
character offsets of the original text.

The benchmark is a stated set. Its bound is ``block_bytes``: up to that size there is one automaton. A larger set is cut
into blocks of that size, each with its own automaton, and their hits are united, so no item is left out at any size.
Long texts are scanned in pieces of ``PIECE`` words that overlap by a window less one word: memory is bounded by a piece.

Defined cases: a null text has no words and no hits; an item without words has no window and never occurs; a null
item id is written as an empty string; rows of one item id count as one item; repeated documents are scanned each.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rosterank.llm.common import columns

#: Words are runs of these bytes of the lower-cased UTF-8 text: digits, a-z and everything outside ASCII.
WORD = re.compile(rb"[0-9A-Za-z\x80-\xff]+")
_FOLD = bytes(
    c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256)
)
PIECE = 200_000

HITS = (
    "doc_id long, n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean, "
    "items array<string>, spans array<struct<start: long, end: long>>"
)


def words_of(text: str) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").translate(_FOLD).split()


class Finder:
    """The automaton of one block of items, over numbers of the words that occur in them."""

    def __init__(self, items: list[tuple[str, str]], window: int):
        self.window, self.numbers = window, {}
        owners: dict[tuple[int, ...], set[str]] = {}
        for item, text in items:
            ids = [self.numbers.setdefault(w, len(self.numbers) + 1) for w in words_of(text)]
            for at in range(max(1, len(ids) - window + 1) if ids else 0):
                owners.setdefault(tuple(ids[at : at + window]), set()).add(item)
        self.automaton = ahocorasick.Automaton(ahocorasick.STORE_ANY, ahocorasick.KEY_SEQUENCE)
        for key, found in owners.items():
            self.automaton.add_word(key, (len(key), tuple(found)))
        if owners:
            self.automaton.make_automaton()
        self.empty = not owners

    def find(self, words: list[bytes]) -> tuple[list[tuple[int, int]], set[str]]:
        """Hit word ranges (start, end exclusive; they may overlap) and the items found."""
        ranges, items = [], set()
        if self.empty:
            return ranges, items
        get, step = self.numbers.get, PIECE - self.window + 1
        for base in range(0, max(1, len(words) - self.window + 1), step):
            for last, (size, found) in self.automaton.iter(tuple(get(w, 0) for w in words[base : base + PIECE])):
                ranges.append((base + last + 1 - size, base + last + 1))
                items.update(found)
        return ranges, items


def united(ranges: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for start, end in sorted(ranges):
        if out and start <= out[-1][1]:
            out[-1][1] = max(out[-1][1], end)
        else:
            out.append([start, end])
    return [(a, b) for a, b in out]


def char_spans(text: str, runs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Word ranges as character offsets of the original text."""
    raw = text.encode("utf-8", "surrogatepass")
    at = [m.span() for m in WORD.finditer(raw)]
    starts = np.cumsum((np.frombuffer(raw, np.uint8) & 0xC0) != 0x80)  # characters begun up to each byte
    return [(int(starts[at[a][0]]) - 1, int(starts[at[b - 1][1] - 1])) for a, b in runs]


def blocks_of(benchmark: DataFrame, block_bytes: int) -> Iterator[list[tuple[str, str]]]:
    """The items in blocks of bounded size; one block at a time is on the driver."""
    held, size = [], 0
    rows = columns(benchmark, item_id="string", text="string").where("text IS NOT NULL")
    for item, text in rows.toLocalIterator():
        held.append((item or "", text))
        size += len(text) + 64
        if size >= block_bytes:
            yield held
            held, size = [], 0
    if held:
        yield held


def _finders(benchmark: DataFrame, window: int, block_bytes: int):
    """What gives a task its automata: they are built there, once per task, from the broadcast blocks of items."""
    context = benchmark.sparkSession.sparkContext
    blocks = [context.broadcast(b) for b in blocks_of(benchmark, block_bytes)]
    return lambda: [Finder(b.value, window) for b in blocks]


def _found(finders: list[Finder], words: list[bytes]) -> tuple[list[tuple[int, int]], set[str]]:
    ranges, items = [], set()
    for finder in finders:
        some, found = finder.find(words)
        ranges += some
        items |= found
    return ranges, items


def drop_contaminated(documents: DataFrame, benchmark: DataFrame, *, window: int = 10, block_bytes: int = 16 << 20) -> DataFrame:
    """The rows of ``documents`` in which no window of the benchmark occurs. Nothing is shuffled."""
    finders = _finders(benchmark, window, block_bytes)

    def choose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = finders()
        for batch in batches:
            texts = batch.column(batch.schema.get_field_index("text"))
            yield batch.filter(pa.array([not _found(known, words_of(t.as_py() or ""))[0] for t in texts], pa.bool_()))

    return documents.mapInArrow(choose, documents.schema)


def find_benchmark(
    documents: DataFrame, benchmark: DataFrame, *, window: int = 10, block_bytes: int = 16 << 20
) -> DataFrame:
    """One row per document: counts, the items found and the hit character ranges (HITS)."""
    finders = _finders(benchmark, window, block_bytes)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = finders()
        for batch in batches:
            rows = []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                text = text.as_py() or ""
                words = words_of(text)
                ranges, items = _found(known, words)
                runs = united(ranges)
                rows.append(
                    {
                        "doc_id": doc_id,
                        "n_words": len(words),
                        "n_hit": sum(b - a for a, b in runs),
                        "n_items": len(items),
                        "items_sha256": hashlib.sha256(",".join(sorted(items)).encode()).hexdigest(),
                        "contaminated": bool(runs),
                        "items": sorted(items),
                        "spans": [{"start": a, "end": b} for a, b in char_spans(text, runs)] if runs else [],
                    }
                )
            yield pa.RecordBatch.from_pylist(rows, schema)

    span = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
    schema = pa.schema(
        [
            ("doc_id", pa.int64()),
            ("n_words", pa.int64()),
            ("n_hit", pa.int64()),
            ("n_items", pa.int64()),
            ("items_sha256", pa.string()),
            ("contaminated", pa.bool_()),
            ("items", pa.list_(pa.string())),
            ("spans", span),
        ]
    )
    return columns(documents, doc_id="long", text="string").mapInArrow(scan, HITS)


def op2_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark passages of ten words in every document."""
    documents = spark.read.parquet(f"{sf_dir}/documents.parquet")
    found = find_benchmark(documents, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return found.select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")


_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_WORDS = f"regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"
SQL = f"""
WITH items AS (
  SELECT coalesce(CAST(item_id AS VARCHAR), '') AS item, {_WORDS} AS w FROM benchmark
), wins AS (
  SELECT DISTINCT item, len(w[i:i + 9]) AS size, w[i:i + 9] AS win
  FROM (SELECT item, w, unnest(range(1, greatest(1, len(w) - 9) + 1)) AS i FROM items WHERE len(w) > 0)
), docs AS (
  SELECT row_number() OVER () AS r, doc_id, {_WORDS} AS w FROM documents
), sizes AS (
  SELECT DISTINCT size FROM wins
), cand AS (
  SELECT r, i, size, w[i:i + size - 1] AS win
  FROM (SELECT r, w, size, unnest(range(1, len(w) - size + 2)) AS i FROM docs, sizes WHERE len(w) >= size)
), hits AS (
  SELECT r, i, size, item FROM cand JOIN wins USING (size, win)
), covered AS (
  SELECT r, count(DISTINCT j) AS n_hit
  FROM (SELECT DISTINCT r, unnest(range(i, i + size)) AS j FROM hits) GROUP BY r
), named AS (
  SELECT r, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT r, item FROM hits) GROUP BY r
)
SELECT doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
  sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM docs LEFT JOIN covered USING (r) LEFT JOIN named USING (r)
"""
