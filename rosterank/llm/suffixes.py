"""Removal of repeated byte strings, by blockwise suffix sorting with a difference cover.

A repeat is a string of ``length`` bytes (a window) of one document that also starts earlier.

1. Anchors. The window's anchor is its substring of ``ANCHOR`` bytes with the smallest hash (the leftmost of equals), so
   equal windows have equal anchors at the same place. Consecutive windows with one anchor are a context. Anchors are
   counted over all documents; contexts whose anchor is unique hold no repeat and go no further.
2. Suffix buckets. The remaining contexts (each different one of a batch once) are dealt by anchor. A bucket holds all
   candidates for equality, so the buckets are sorted independently, one at a time in each task. Contexts of a hot anchor
   (more than ``HOT_CONTEXTS`` that differ) would crowd one bucket: their windows are dealt one by one, each different one
   of a batch once, by a hash of the whole window, and compared by 128 bits of two independent hashes.
3. In a bucket the windows are sorted in blocks by their first bytes. Long ties are resolved by ranks of a difference
   cover sample, made once per bucket: of positions that are in the cover modulo ``PERIOD``, ranked by ``DEPTH`` bytes.
   Any two windows reach sample positions by one common shift, so first bytes, a sample rank and last bytes decide
   equality; memory is bounded by the sample and one block. What is found equal is compared byte by byte once more.
4. Each batch marks the windows it was told, and all later copies of its own contexts, and removes their bytes.

Defined cases: a null or empty text has no bytes; a text shorter than a window loses nothing; rows without an id come
after all others; rows that share an id are ordered by a hash of their text, and of equal rows one comes first. What is
kept is bytes: a cut may fall inside a character.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession

from rosterank.llm.blocks import by_bucket
from rosterank.llm.common import buckets_for, release, stage
from rosterank.llm.ordered import (
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
    send,
)

ANCHOR = 32
#: Every difference modulo 13 is one of two members of the cover.
PERIOD, COVER = 13, (0, 1, 3, 9)
#: First and last bytes of a window that are compared beside a sample rank.
EDGE = 16
#: Windows of a block.
BLOCK = 1 << 18
#: Differing contexts, summed over the batches, from which an anchor's windows are dealt on.
HOT_CONTEXTS = 1 << 13

CLEANED = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary"
_CLEANED = pa.schema(
    [
        ("doc_id", pa.int64()),
        ("n_bytes", pa.int64()),
        ("n_removed", pa.int64()),
        ("n_spans", pa.int64()),
        ("kept_sha256", pa.string()),
        ("kept", pa.binary()),
    ]
)


def slide(values: np.ndarray, width: int, best) -> np.ndarray:
    """``best`` (np.minimum or np.maximum) of every run of ``width`` values."""
    out, span = values, 1
    while 2 * span <= width:
        out = best(out[:-span], out[span:])
        span *= 2
    return best(out[: len(out) - (width - span)], out[width - span :]) if span < width else out


class Contexts:
    """The contexts of a batch in order: window starts low to high, the anchor's hash, and a hash of the whole context."""

    def __init__(self, texts: Texts, length: int):
        data, offsets = texts.bytes, texts.offsets
        n, empty = len(data), np.empty(0, np.int64)
        self.length, self.data = length, data
        self.sums = self.inverse = np.empty(0, np.uint64)
        self.low = self.high = empty
        self.anchor = self.whole = np.empty(0, np.uint64)
        if n < length:
            return
        sums, inverse = prefix_sums(data), powers(INVERSE, n)
        prints = mix((sums[ANCHOR:] - sums[:-ANCHOR]) * inverse[: n - ANCHOR + 1])
        size = np.diff(offsets)
        end = np.repeat(offsets[1:], size)
        reach = length - ANCHOR + 1
        least = slide(prints, reach, np.minimum)  # of each window
        valid = np.arange(len(least)) + length <= end[: len(least)]
        least[~valid] = 0
        # a place is an anchor if its hash is the least of some window that holds it
        padded = np.concatenate([np.zeros(reach - 1, np.uint64), least, np.zeros(reach - 1, np.uint64)])
        most = slide(padded, reach, np.maximum)[: len(prints)]
        place = np.flatnonzero((prints == most) & (most > 0))
        if not len(place):
            return
        del most, padded
        # runs of windows with one least hash, and the run of each anchor
        begin = groups_of(least)
        stop = np.append(begin[1:], len(least)) - 1
        run = np.searchsorted(begin, np.minimum(place, len(least) - 1), "right") - 1
        value = prints[place]
        while (wrong := np.flatnonzero(least[begin[run]] != value)).size:
            run[wrong] -= 1
        low = np.maximum(begin[run], place - reach + 1)
        same = np.flatnonzero((run[1:] == run[:-1]) & (value[1:] == value[:-1])) + 1
        low[same] = np.maximum(low[same], place[same - 1] + 1)
        high = np.minimum(stop[run], place)
        use = low <= high
        self.low, self.high, self.anchor, self.sums, self.inverse = low[use], high[use], value[use], sums, inverse
        self.whole = self.hashes(self.low, self.high)

    def hashes(self, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        """Hashes of the contexts of the windows low to high."""
        return mix((self.sums[high + self.length] - self.sums[low]) * self.inverse[low] + (high - low).astype(np.uint64))


def anchor_keys(anchor: np.ndarray, buckets: int) -> np.ndarray:
    """Bucket and 32 hash bits of each anchor."""
    return ((anchor >> np.uint64(32)) % np.uint64(buckets) << np.uint64(32)) | (anchor & np.uint64(0xFFFFFFFF))


def differing(codes: np.ndarray) -> np.ndarray:
    """Differing contexts of an anchor in a batch, from its code: 0 occurs once, 1 more often in one form, then in eighths of a doubling."""
    return np.where(codes < 2, 1, np.exp2((codes.astype(np.float64) - 2) / 8))


def _anchors(length: int, buckets: int):
    def pack(texts: Texts) -> Iterator[tuple[int, bytes]]:
        every = Contexts(texts, length)
        keys = anchor_keys(every.anchor, buckets)
        order = np.lexsort((every.whole, keys))
        keys, whole = keys[order], every.whole[order]
        first = groups_of(keys)
        if not len(first):
            return
        new = np.ones(len(keys), np.int64)
        new[1:] = (keys[1:] != keys[:-1]) | (whole[1:] != whole[:-1])
        forms, times = np.add.reduceat(new, first), np.diff(np.append(first, len(keys)))
        many = np.where(forms > 1, 2 + np.ceil(8 * np.log2(forms)), times > 1).astype(np.uint8)
        low = (keys[first] & np.uint64(0xFFFFFFFF)).astype("<u4")
        for k, part in by_bucket(keys[first] >> np.uint64(32), buckets):
            yield k, np.uint32(k).tobytes() + low[part].tobytes() + many[part].tobytes()

    return pack


def _repeated(hot_contexts: int):
    def answer(owners: list[int], data: list[bytes]) -> Iterator[tuple[int, bytes]]:
        """The anchors that occur at least twice, to each batch that holds them: bucket, number of those that aren't hot, these, the hot ones."""
        sizes = [(len(d) - 4) // 5 for d in data]
        low = np.concatenate([np.frombuffer(d, "<u4", n, 4) for d, n in zip(data, sizes, strict=True)])
        many = np.concatenate([np.frombuffer(d, np.uint8, n, 4 + 4 * n) for d, n in zip(data, sizes, strict=True)])
        order = np.argsort(low, kind="stable")
        first = groups_of(low[order])
        of = np.diff(np.append(first, len(low)))
        count = np.add.reduceat(1 + (many[order] > 0).astype(np.int64), first)
        crowd = np.add.reduceat(differing(many[order]), first)
        hit, hot = np.zeros(len(low), bool), np.zeros(len(low), bool)
        hit[order], hot[order] = np.repeat(count > 1, of), np.repeat(crowd > hot_contexts, of)
        at = 0
        for owner, d, n in zip(owners, data, sizes, strict=True):
            own, hit_, hot_ = low[at : at + n], hit[at : at + n], hot[at : at + n]
            even = own[hit_ & ~hot_]
            if hit_.any():
                yield owner, d[:4] + np.uint32(len(even)).tobytes() + even.tobytes() + own[hit_ & hot_].tobytes()
            at += n

    return answer


class Candidates:
    """The contexts of a batch with repeated anchors, each different one once and numbered within its bucket.

    Each window of a hot anchor is a context of its own. Its bucket is ``buckets`` or more: a key of the whole window
    modulo ``buckets`` names the task.
    """

    def __init__(self, texts: Texts, back: list[bytes], length: int, anchor_buckets: int, buckets: int):
        every = Contexts(texts, length)
        told = [np.frombuffer(d, "<u4") for d in back]
        full = lambda d, low: low.astype(np.uint64) | (np.uint64(d[0]) << np.uint64(32))
        none = [np.empty(0, np.uint64)]
        known = np.sort(np.concatenate([full(d, d[2 : 2 + d[1]]) for d in told] or none))
        crowded = np.sort(np.concatenate([full(d, d[2 + d[1] :]) for d in told] or none))
        keys = anchor_keys(every.anchor, anchor_buckets)
        use, hot = member(keys, known), np.flatnonzero(member(keys, crowded))
        self.data = every.data
        number = every.high[hot] - every.low[hot] + 1
        windows = np.repeat(every.low[hot] - (np.cumsum(number) - number), number) + np.arange(number.sum())
        self.low, self.high = np.append(every.low[use], windows), np.append(every.high[use], windows)
        self.other = window_keys(self.data, windows, length)  #: second hashes of the windows, which are the last contexts
        self.even = int(use.sum())  #: contexts before them
        whole = np.append(every.whole[use], every.hashes(windows, windows))
        bucket = np.append(mix(every.anchor[use]) % np.uint64(buckets), mix(self.other) % np.uint64(buckets) + np.uint64(buckets))
        place = np.argsort(self.low, kind="stable")  # in text order again
        self.low, self.high, whole, bucket = self.low[place], self.high[place], whole[place], bucket[place]
        self.whole, self.place = whole, place
        order = np.lexsort((whole, bucket))  # stable: copies stay in text order
        new = np.ones(len(order), bool)
        new[1:] = (whole[order][1:] != whole[order][:-1]) | (bucket[order][1:] != bucket[order][:-1])
        first = order[new]  # of each different context, its first place
        kind = np.empty(len(order), np.int64)
        kind[order] = np.cumsum(new) - 1
        self.again = np.ones(len(order), bool)
        self.again[first] = False
        sent = first[np.lexsort((self.low[first], bucket[first]))]  # in a bucket by place
        number = np.empty(len(first), np.int64)
        number[kind[sent]] = np.arange(len(sent))
        self.sent, self.bucket, self.number = sent, bucket[sent], number[kind]  # number: of each place's context


def _contexts(length: int, anchor_buckets: int, buckets: int):
    def pack(texts: Texts, back: pa.Table) -> Iterator[tuple[int, bytes]]:
        some = Candidates(texts, back.column("data").to_pylist(), length, anchor_buckets, buckets)
        press, raw = zstandard.ZstdCompressor(level=1), memoryview(some.data.tobytes())
        for k, part in by_bucket(some.bucket, 2 * buckets):
            own = some.sent[part]
            if k >= buckets:
                head = np.array([k, len(own)], "<u4").tobytes()
                yield k - buckets, press.compress(head + some.whole[own].tobytes() + some.other[some.place[own] - some.even].tobytes())
                continue
            low, high = some.low[own], some.high[own]
            body = b"".join(raw[a:b] for a, b in zip(low.tolist(), (high + length).tolist(), strict=True))
            head = np.array([k, len(own)], "<u4").tobytes() + (high - low).astype("<u2").tobytes()
            yield k, press.compress(head + body)

    return pack


def words_at(data: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Eight bytes from each place, as numbers that sort like the bytes."""
    return np.lib.stride_tricks.sliding_window_view(data, 8)[at].copy().view(">u8")[:, 0].astype(np.uint64)


def window_keys(data: np.ndarray, windows: np.ndarray, length: int) -> np.ndarray:
    """Hashes of whole windows, independent of the sums that anchors and contexts are hashed by."""
    keys = np.full(len(windows), 0x5851F42D4C957F2D, np.uint64)
    for k in [*range(0, length - 7, 8), length - 8] if len(windows) else []:
        keys = mix(keys * np.uint64(0xD6E8FEB86659FD93) + words_at(data, windows + k))
    return keys


def sample_ranks(data: np.ndarray, at: np.ndarray, depth: int) -> np.ndarray:
    """Ranks of the strings of ``depth`` bytes (a multiple of eight) at the given places; equal strings rank alike."""
    keys = [words_at(data, at + k) for k in range(0, depth, 8)]
    order = np.lexsort(keys[::-1])
    new = np.zeros(len(at), bool)
    for key in keys:
        ranked = key[order]
        new[1:] |= ranked[1:] != ranked[:-1]
    ranks = np.empty(len(at), np.int64)
    ranks[order] = np.cumsum(new)
    return ranks


def equal(data: np.ndarray, a: np.ndarray, b: np.ndarray, length: int) -> np.ndarray:
    out = np.ones(len(a), bool)
    for k in [*range(0, length - 7, 8), length - 8]:
        out &= words_at(data, a + k) == words_at(data, b + k)
    return out


def first_places(data: np.ndarray, windows: np.ndarray, length: int) -> np.ndarray:
    """For each window (a place in ``data``, ascending) the first window that it equals, itself if it is the first."""
    depth = (length - PERIOD + 1) // 8 * 8
    if depth < length - EDGE or len(windows) < 2:
        raise ValueError("a window is too short for the cover")
    inside = np.zeros(len(data) + 1, np.int64)
    np.add.at(inside, windows, 1)
    np.add.at(inside, np.minimum(windows + PERIOD, len(data)), -1)
    reached = np.cumsum(inside[:-1]) > 0  # places that some window reaches by a shift
    in_cover = np.zeros(PERIOD, bool)
    in_cover[list(COVER)] = True
    at = np.flatnonzero(reached & in_cover[np.arange(len(data)) % PERIOD] & (np.arange(len(data)) + depth <= len(data)))
    ranks = np.zeros(len(data), np.int64)
    ranks[at] = sample_ranks(data, at, depth)
    shifts = np.array([sorted((c - r) % PERIOD for c in COVER) for r in range(PERIOD)])

    first = windows.copy()
    leading = data[windows].astype(np.int64) << 8 | data[windows + 1]
    by_lead = np.argsort(leading.astype(np.uint16), kind="stable")
    bounds = groups_of(leading[by_lead])
    at = 0
    while at < len(by_lead):  # one block of suffixes at a time: whole groups of equal first bytes
        ends = bounds[np.searchsorted(bounds, at + BLOCK, "right") :]
        nxt = int(ends[0]) if len(ends) else len(by_lead)
        own = by_lead[at:nxt]
        place = windows[own]
        edge = mix(words_at(data, place) + np.uint64(1))
        for k in (8, length - EDGE, length - 8):
            edge = mix(edge ^ words_at(data, place + k))
        least = place.copy()
        shift = shifts[place % PERIOD]
        whole = np.concatenate([(ranks[place + shift[:, j]] << 4) | shift[:, j] for j in range(len(COVER))])
        edges = np.tile(edge, len(COVER))
        order = np.lexsort((edges, whole))
        new = np.ones(len(order), bool)
        new[1:] = (whole[order][1:] != whole[order][:-1]) | (edges[order][1:] != edges[order][:-1])
        starts = np.flatnonzero(new)
        of = np.tile(np.arange(len(place)), len(COVER))[order]
        group = np.minimum.reduceat(place[of], starts)
        np.minimum.at(least, of, np.repeat(group, np.diff(np.append(starts, len(order)))))
        moved = np.flatnonzero(least < place)
        good = equal(data, place[moved], least[moved], length)
        if not good.all():  # two edges met by their hash alone: compare these windows as they are
            seen: dict[bytes, int] = {}
            least = np.array([seen.setdefault(data[p : p + length].tobytes(), p) for p in np.sort(place).tolist()])[np.argsort(np.argsort(place))]
        first[own] = least
        at = nxt
    return first


def _later_windows(owners: list[int], data: list[bytes]) -> Iterator[tuple[int, bytes]]:
    """The windows of hot anchors that an earlier batch has sent too, as _sorted_bucket's rows."""
    if not owners:
        return
    head = np.array([np.frombuffer(d, "<u4", 2) for d in data]).astype(np.int64)
    number = head[:, 1]
    one, two = (np.concatenate([np.frombuffer(d, "<u8", n, 8 + 8 * n * k) for d, n in zip(data, number.tolist(), strict=True)]) for k in (0, 1))
    order = np.lexsort((two, one))  # stable: in order of the batches
    later = np.zeros(len(one), bool)
    later[order[1:]] = (one[order][1:] == one[order][:-1]) & (two[order][1:] == two[order][:-1])
    ends = np.cumsum(number)
    for batch, k, a, b in zip(owners, head[:, 0].tolist(), (ends - number).tolist(), ends.tolist(), strict=True):
        at = np.flatnonzero(later[a:b])
        if len(at):
            rows = np.zeros((len(at), 3), "<u4")
            rows[:, 0] = at
            yield batch, np.uint32(k).tobytes() + rows.tobytes()


def _sorted_bucket(length: int, buckets: int):
    def answer(owners: list[int], data: list[bytes]) -> Iterator[tuple[int, bytes]]:
        press = zstandard.ZstdDecompressor()
        opened = [press.decompress(d) for d in data]
        hot = [int(np.frombuffer(raw, "<u4", 1)[0]) >= buckets for raw in opened]
        some = lambda values, kind: [v for v, h in zip(values, hot, strict=True) if h == kind]
        yield from _later_windows(some(owners, True), some(opened, True))
        owners, data = some(owners, False), some(opened, False)
        if not owners:
            return
        known: dict[bytes, int] = {}
        texts, counts, kinds, bucket = [], [], [], 0
        for raw in data:
            bucket, n = np.frombuffer(raw, "<u4", 2)
            sizes = np.frombuffer(raw, "<u2", n, 8).astype(np.int64) + length
            ends = 8 + 2 * int(n) + np.cumsum(sizes)
            counts.append(int(n))
            for a, b in zip((ends - sizes).tolist(), ends.tolist(), strict=True):
                text = raw[a:b]
                kind = known.setdefault(text, len(texts))
                if kind == len(texts):
                    texts.append(text)
                    kinds.append((kind, True))
                else:
                    kinds.append((kind, False))
        joined = np.frombuffer(b"".join(texts), np.uint8)
        size = np.array([len(t) for t in texts])
        begin = np.cumsum(size) - size
        number = size - length + 1
        owner = np.repeat(np.arange(len(texts)), number)
        windows = np.repeat(begin - np.concatenate([[0], np.cumsum(number)[:-1]]), number) + np.arange(number.sum())
        later = first_places(joined, windows, length) < windows if len(windows) > 1 else np.zeros(len(windows), bool)
        # runs of repeated windows of each context
        flags = np.concatenate([[False], later, [False]])
        border = np.concatenate([[True], owner[1:] != owner[:-1], [True]])
        opens = np.flatnonzero(later & (~flags[:-2] | border[:-1]))
        closes = np.flatnonzero(later & (~flags[2:] | border[1:]))
        spans: dict[int, list[tuple[int, int]]] = {}
        for o, a, b in zip(owner[opens].tolist(), (windows[opens] - begin[owner[opens]]).tolist(), (windows[closes] - begin[owner[opens]]).tolist(), strict=True):
            spans.setdefault(o, []).append((a, b))
        at = 0
        for batch, n in zip(owners, counts, strict=True):
            out = []
            for i, (kind, new) in enumerate(kinds[at : at + n]):
                for a, b in spans.get(kind, ()) if new else ((0, len(texts[kind]) - length),):
                    out.append((i, a, b))
            at += n
            if out:
                yield batch, np.uint32(bucket).tobytes() + np.array(out, "<u4").tobytes()

    return answer


def _clean(length: int, anchor_buckets: int, buckets: int, keep_bytes: bool):
    def work(texts: Texts, back: list[bytes]) -> list[dict]:
        anchors = [d[1:] for d in back if d[:1] == b"a"]
        told = [np.frombuffer(d, "<u4", offset=1) for d in back if d[:1] == b"r"]
        some = Candidates(texts, anchors, length, anchor_buckets, buckets)
        depth = np.zeros(len(texts.bytes) + 1, np.int64)
        np.add.at(depth, some.low[some.again], 1)
        np.add.at(depth, some.high[some.again] + length, -1)
        base = np.searchsorted(some.bucket, np.arange(2 * buckets))
        for d in told:
            row = d[1:].reshape(-1, 3).astype(np.int64)
            low = some.low[some.sent[base[d[0]] + row[:, 0]]]
            np.add.at(depth, low + row[:, 1], 1)
            np.add.at(depth, low + row[:, 2] + length, -1)
        covered = np.cumsum(depth[:-1]) > 0
        total = np.concatenate([[0], np.cumsum(covered)])
        out = []
        for doc_id, a, b in zip(texts.ids, texts.offsets[:-1].tolist(), texts.offsets[1:].tolist(), strict=True):
            gone = int(total[b] - total[a])
            part, own = texts.bytes[a:b], covered[a:b]
            kept = part[~own].tobytes() if gone else part.tobytes()
            runs = int(own[0]) + int((own[1:] & ~own[:-1]).sum()) if gone else 0
            row = {"doc_id": doc_id, "n_bytes": b - a, "n_removed": gone, "n_spans": runs, "kept_sha256": hashlib.sha256(kept).hexdigest()}
            out.append(row | {"kept": kept if keep_bytes else None})
        return out

    return work


def remove_repeats(documents: DataFrame, *, length: int = 100, keep_bytes: bool = True) -> DataFrame:
    """CLEANED rows, one per document: bytes covered by a string of ``length`` that also starts earlier are gone."""
    from pyspark.sql import functions as F

    if not 96 <= length <= 1024 or (length - PERIOD + 1) // 8 * 8 < length - EDGE:
        raise ValueError("the cover serves lengths from 96 bytes whose remainder modulo 8 lets a sample reach the last bytes")
    spark = documents.sparkSession
    batches, size = ordered_batches(documents, batch_bytes=2 << 20)
    release(spark)
    anchor_buckets = buckets_for(spark, size / 30 * 5, 16 << 20)
    anchors = stage(exchange(send(batches, _anchors(length, anchor_buckets)), _repeated(HOT_CONTEXTS), anchor_buckets), "anchors")
    release(spark)
    buckets = buckets_for(spark, size / 2, 6 << 20)
    sent = send(batches, _contexts(length, anchor_buckets, buckets), anchors)
    repeats = stage(exchange(sent, _sorted_bucket(length, buckets), buckets), "repeats")
    release(spark)
    marked = lambda df, kind: df.select("batch", F.concat(F.lit(kind).cast("binary"), "data").alias("data"))
    told = marked(anchors, "a").union(marked(repeats, "r"))
    return finish(batches, told, _clean(length, anchor_buckets, buckets, keep_bytes), CLEANED, _CLEANED)


def op7_suffixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Repeated strings of 100 bytes in all documents."""
    cleaned = remove_repeats(spark.read.parquet(f"{sf_dir}/documents.parquet"), keep_bytes=False)
    return cleaned.select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")


#: Windows of 100 bytes as 200 hexadecimal digits.
SQL = """
WITH d AS (
  SELECT row_number() OVER (ORDER BY doc_id NULLS LAST, text) AS r, doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents
), w AS (
  SELECT r, i, substr(h, 2 * i + 1, 200) AS s
  FROM (SELECT r, h, unnest(range(0, greatest(0, length(h) // 2 - 99))) AS i FROM d)
), n AS (
  SELECT r, i FROM (SELECT r, i, row_number() OVER (PARTITION BY s ORDER BY r, i) AS turn FROM w) WHERE turn > 1
), g AS (
  SELECT r, i, sum(CASE WHEN i > before + 100 THEN 1 ELSE 0 END) OVER (PARTITION BY r ORDER BY i) AS run
  FROM (SELECT r, i, coalesce(lag(i) OVER (PARTITION BY r ORDER BY i), -1000) AS before FROM n)
), m AS (
  SELECT r, min(i) AS a, max(i) + 100 AS b FROM g GROUP BY r, run
), k AS (
  SELECT r, a, b, coalesce(lag(b) OVER (PARTITION BY r ORDER BY a), 0) AS from_, coalesce(lead(a) OVER (PARTITION BY r ORDER BY a), -1) AS next FROM m
), c AS (
  SELECT r, sum(b - a) AS n_removed, count(*) AS n_spans,
    string_agg(substr(h, 2 * from_ + 1, 2 * (a - from_)) || CASE WHEN next < 0 THEN substr(h, 2 * b + 1) ELSE '' END, '' ORDER BY a) AS kept
  FROM k JOIN d USING (r) GROUP BY r
)
SELECT doc_id, CAST(length(h) // 2 AS BIGINT) AS n_bytes, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed,
  CAST(coalesce(n_spans, 0) AS BIGINT) AS n_spans, sha256(unhex(coalesce(kept, h))) AS kept_sha256
FROM d LEFT JOIN c USING (r)
"""
