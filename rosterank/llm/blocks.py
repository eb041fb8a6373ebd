"""Removal of repeated word passages, found by fixed-block anchors.

A window is ``window`` words of one document. Any window holds a whole block of ``window // 2`` words that begins at a
multiple of that length, so:

1. Index the non-overlapping blocks of every document and probe them with every rolling window of block length. Both are
   hashes, dealt to buckets; a hash that is a block somewhere and occurs at least twice is an anchor.
2. Every window around an anchor is a possible repeat. These windows alone are hashed as a whole (64 bits and the bucket
   number, from independent sums) and dealt again; each batch learns which of its windows also start in an earlier batch.
3. Each batch extends what it was told and what repeats within itself to maximal runs, and removes their words.

An anchor of step 1 may be a chance meeting of two hashes; it costs a comparison in step 2 and changes no result.

Defined cases: a null or empty text has no words; a text shorter than a window loses nothing; rows without an id come
after all others; rows that share an id are ordered by a hash of their text, and of equal rows one comes first.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from rosterank.llm.common import buckets_for, release, stage
from rosterank.llm.ordered import (
    BASE,
    INVERSE,
    Texts,
    exchange,
    finish,
    groups_of,
    member,
    mix,
    ordered_batches,
    powers,
    prefix_sums,
    random_words,
    send,
)

#: White space between words: blank and 9 to 13 (fixed values of the contract).
SPACE = np.zeros(256, bool)
SPACE[[32, *range(9, 14)]] = True
_FACTORS, _OTHERS = random_words(4096, 3), random_words(4096, 5)

CLEANED = "doc_id long, n_words long, n_removed long, kept_sha256 string, kept string"
_CLEANED = pa.schema(
    [("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept_sha256", pa.string()), ("kept", pa.string())]
)


class Words:
    """Hashes of all words of a batch, and where each document's words lie."""

    def __init__(self, texts: Texts):
        data, offsets = texts.bytes, texts.offsets
        inside = ~SPACE[data]
        before, after = np.zeros_like(inside), np.zeros_like(inside)
        before[1:], after[:-1] = inside[:-1], inside[1:]
        filled = offsets[:-1][offsets[:-1] < offsets[1:]]
        before[filled] = False
        after[filled[1:] - 1] = False
        starts, ends = np.flatnonzero(inside & ~before), np.flatnonzero(inside & ~after) + 1
        del inside, before, after
        sums = prefix_sums(data)
        value = (sums[ends] - sums[starts]) * powers(INVERSE, len(data))[starts]
        self.hash = mix(value + (ends - starts).astype(np.uint64) * np.uint64(BASE))
        self.low = np.searchsorted(starts, offsets[:-1])
        self.high = np.searchsorted(starts, offsets[1:])
        size = self.high - self.low
        self.end = np.repeat(self.high, size)  # of the word's document
        self.place = np.arange(len(starts)) - np.repeat(self.low, size)

    def windows(self, size: int, factors: np.ndarray) -> np.ndarray:
        """Hashes of all runs of ``size`` words, also of those that cross into the next document."""
        n = max(0, len(self.hash) - size + 1)
        out = np.zeros(n, np.uint64)
        for k in range(size):
            out += self.hash[k : k + n] * factors[k]
        return mix(out)

    def fits(self, size: int) -> np.ndarray:
        """Whether a run of that size that starts here stays in its document."""
        return np.arange(len(self.hash)) + size <= self.end


def by_bucket(bucket: np.ndarray, count: int) -> Iterator[tuple[int, slice]]:
    """Slices of a sorted bucket column."""
    bounds = np.searchsorted(bucket, np.arange(count + 1))
    for k in range(count):
        if bounds[k] < bounds[k + 1]:
            yield k, slice(bounds[k], bounds[k + 1])


def anchor_keys(words: Words, block: int, buckets: int) -> np.ndarray:
    """Bucket and 32 hash bits of each rolling window of block length."""
    hashed = words.windows(block, _FACTORS)
    return ((hashed >> np.uint64(32)) % np.uint64(buckets) << np.uint64(32)) | (hashed & np.uint64(0xFFFFFFFF))


def _probes(window: int, block: int, buckets: int):
    def pack(texts: Texts) -> Iterator[tuple[int, bytes]]:
        words = Words(texts)
        keys = anchor_keys(words, block, buckets)
        n = len(keys)
        size = np.repeat(words.high - words.low, words.high - words.low)[:n]
        use = np.flatnonzero((size >= window) & words.fits(block)[:n])
        order = use[np.argsort(keys[use], kind="stable")]
        ranked = keys[order]
        first = groups_of(ranked)
        if not len(first):
            return
        many = np.diff(np.append(first, len(ranked))) > 1
        indexed = np.logical_or.reduceat(words.place[order] % block == 0, first)
        unique = ranked[first]
        flags = (many + 2 * indexed).astype(np.uint8)
        low = (unique & np.uint64(0xFFFFFFFF)).astype("<u4")
        for k, part in by_bucket(unique >> np.uint64(32), buckets):
            yield k, np.uint32(k).tobytes() + low[part].tobytes() + flags[part].tobytes()

    return pack


def _anchors(owners: list[int], data: list[bytes]) -> Iterator[tuple[int, bytes]]:
    """The hashes that are a block somewhere and occur at least twice, to each batch that holds them."""
    sizes = [(len(d) - 4) // 5 for d in data]
    low = np.concatenate([np.frombuffer(d, "<u4", n, 4) for d, n in zip(data, sizes, strict=True)])
    flags = np.concatenate([np.frombuffer(d, np.uint8, n, 4 + 4 * n) for d, n in zip(data, sizes, strict=True)])
    order = np.argsort(low, kind="stable")
    first = groups_of(low[order])
    count = np.add.reduceat(1 + (flags[order] & 1).astype(np.int64), first)
    indexed = np.bitwise_or.reduceat(flags[order], first) & 2
    hit = np.zeros(len(low), bool)
    hit[order] = np.repeat((count > 1) & (indexed > 0), np.diff(np.append(first, len(low))))
    at = 0
    for owner, d, n in zip(owners, data, sizes, strict=True):
        found = low[at : at + n][hit[at : at + n]]
        if len(found):
            yield owner, d[:4] + found.tobytes()
        at += n


def window_keys(words: Words, window: int, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """64 hash bits and the bucket of each window."""
    return words.windows(window, _FACTORS[1024:]), words.windows(window, _OTHERS) % np.uint64(buckets)


def _suspects(window: int, block: int, anchor_buckets: int, buckets: int):
    def pack(texts: Texts, back: pa.Table) -> Iterator[tuple[int, bytes]]:
        words = Words(texts)
        told = [np.frombuffer(d, "<u4") for d in back.column("data").to_pylist()]
        known = np.sort(np.concatenate([d[1:].astype(np.uint64) | (np.uint64(d[0]) << np.uint64(32)) for d in told]))
        hit = member(anchor_keys(words, block, anchor_buckets), known)
        seen = np.concatenate([[0], np.cumsum(hit)])
        hashed, bucket = window_keys(words, window, buckets)
        n = len(hashed)
        reach = window - block + 1  # starts of blocks inside a window
        near = seen[np.minimum(np.arange(n) + reach, len(hit))] > seen[:n]
        use = np.flatnonzero(near & words.fits(window)[:n])
        order = use[np.lexsort((hashed[use], bucket[use]))]
        keep = np.ones(len(order), bool)
        keep[1:] = (hashed[order][1:] != hashed[order][:-1]) | (bucket[order][1:] != bucket[order][:-1])
        order = order[keep]
        values = hashed[order].astype("<u8")
        for k, part in by_bucket(bucket[order], buckets):
            yield k, np.uint64(k).tobytes() + values[part].tobytes()

    return pack


def _repeats(owners: list[int], data: list[bytes]) -> Iterator[tuple[int, bytes]]:
    """To each batch its windows that an earlier batch also holds. Batches come in order."""
    values = np.concatenate([np.frombuffer(d, "<u8", offset=8) for d in data])
    order = np.argsort(values, kind="stable")
    later = np.ones(len(values), bool)
    later[order[groups_of(values[order])]] = False
    at = 0
    for owner, d in zip(owners, data, strict=True):
        n = len(d) // 8 - 1
        found = values[at : at + n][later[at : at + n]]
        if len(found):
            yield owner, d[:8] + found.tobytes()
        at += n


def _clean(window: int, buckets: int, keep_text: bool):
    def work(texts: Texts, back: list[bytes]) -> list[dict]:
        words = Words(texts)
        hashed, bucket = window_keys(words, window, buckets)
        n = len(hashed)
        fits = words.fits(window)[:n]
        told = [np.frombuffer(d, "<u8") for d in back]
        known = np.concatenate([d[1:] for d in told] or [np.empty(0, np.uint64)])
        place = np.concatenate([np.full(len(d) - 1, d[0]) for d in told] or [np.empty(0, np.uint64)])
        order = np.argsort(known, kind="stable")
        known, place = known[order], place[order]
        repeat = np.zeros(n, bool)
        if len(known):
            at = np.minimum(np.searchsorted(known, hashed), len(known) - 1)
            repeat = (known[at] == hashed) & (place[at] == bucket)
        use = np.flatnonzero(fits)
        both = mix(hashed[use] ^ (bucket[use] * np.uint64(BASE)))
        order = use[np.argsort(both, kind="stable")]
        again = np.ones(len(order), bool)
        again[groups_of(np.sort(both, kind="stable"))] = False
        repeat[order[again]] = True
        starts = np.flatnonzero(repeat & fits)
        depth = np.zeros(len(words.hash) + 1, np.int64)
        np.add.at(depth, starts, 1)
        np.add.at(depth, starts + window, -1)
        covered = np.cumsum(depth[:-1]) > 0
        total = np.concatenate([[0], np.cumsum(covered)])
        raw, out = texts.bytes.tobytes(), []
        for k, doc_id in enumerate(texts.ids):
            low, high = words.low[k], words.high[k]
            gone = int(total[high] - total[low])
            kept = raw[texts.offsets[k] : texts.offsets[k + 1]].split()
            if gone:
                kept = [w for w, c in zip(kept, covered[low:high].tolist(), strict=True) if not c]
            text = b" ".join(kept)
            row = {"doc_id": doc_id, "n_words": int(high - low), "n_removed": gone, "kept_sha256": hashlib.sha256(text).hexdigest()}
            out.append(row | {"kept": text.decode() if keep_text else None})
        return out

    return work


def remove_repeats(documents: DataFrame, *, window: int = 20, keep_text: bool = True) -> DataFrame:
    """CLEANED rows, one per document: words covered by a window that also starts earlier are gone."""
    if not 2 <= window <= 1024:
        raise ValueError("a window has 2 to 1024 words")
    spark, block = documents.sparkSession, window // 2
    batches, size = ordered_batches(documents)
    release(spark)
    anchor_buckets = buckets_for(spark, size / 6 * 5, 16 << 20)
    anchors = stage(exchange(send(batches, _probes(window, block, anchor_buckets)), _anchors, anchor_buckets), "anchors")
    release(spark)
    buckets = buckets_for(spark, size / 6 * 4, 16 << 20)
    suspects = send(batches, _suspects(window, block, anchor_buckets, buckets), anchors)
    repeats = stage(exchange(suspects, _repeats, buckets), "repeats")
    release(spark)
    return finish(batches, repeats, _clean(window, buckets, keep_text), CLEANED, _CLEANED)


def op8_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Repeated passages of twenty words in all documents."""
    cleaned = remove_repeats(spark.read.parquet(f"{sf_dir}/documents.parquet"), keep_text=False)
    return cleaned.select("doc_id", "n_words", "n_removed", "kept_sha256")


SQL = """
WITH d AS (
  SELECT row_number() OVER (ORDER BY doc_id NULLS LAST, text) AS r, doc_id,
    regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w FROM documents
), v AS (
  SELECT r, i, w[i:i + 19] AS win FROM (SELECT r, w, unnest(range(1, len(w) - 18)) AS i FROM d WHERE len(w) >= 20)
), f AS (
  SELECT r, i, row_number() OVER (PARTITION BY win ORDER BY r, i) AS n FROM v
), c AS (
  SELECT r, list(DISTINCT j) AS gone FROM (SELECT r, unnest(range(i, i + 20)) AS j FROM f WHERE n > 1) GROUP BY r
)
SELECT doc_id, len(w) AS n_words, coalesce(len(gone), 0) AS n_removed,
  sha256(CASE WHEN gone IS NULL THEN array_to_string(w, ' ')
    ELSE coalesce(array_to_string(list_transform(list_filter(range(1, len(w) + 1), lambda k: NOT list_contains(gone, k)), lambda k: w[k]), ' '), '') END) AS kept_sha256
FROM d LEFT JOIN c USING (r)
"""
