"""op7, op8 and op10 against brute force."""

import hashlib
import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from rosterank.llm import blocks, jaccard, suffixes
from rosterank.llm.ordered import Texts, ordered_batches
from tests.llm.data import DOCUMENTS, documents, near, prose


def in_order(rows):
    return sorted(rows, key=lambda r: (r[0] is None, r[0] or 0))


def test_bytes_against_brute_force(spark):
    rows = [r for r in DOCUMENTS if r[0] is not None]
    seen, want = set(), []
    for doc_id, text in in_order(rows):
        raw = (text or "").encode()
        gone = bytearray(len(raw))
        for s in range(len(raw) - 99):
            if raw[s : s + 100] in seen:
                gone[s : s + 100] = b"\1" * 100
            seen.add(raw[s : s + 100])
        kept = bytes(b for b, g in zip(raw, gone, strict=True) if not g)
        spans = sum(1 for i, g in enumerate(gone) if g and (not i or not gone[i - 1]))
        want.append((doc_id, len(raw), sum(gone), spans, hashlib.sha256(kept).hexdigest(), kept))
    got = suffixes.remove_repeats(documents(spark, rows)).collect()
    assert sorted(map(tuple, got)) == sorted(want)
    assert sum(w[2] for w in want) > 0


def test_words_against_brute_force(spark):
    rows = [r for r in DOCUMENTS if r[0] is not None]
    seen, want = set(), []
    for doc_id, text in in_order(rows):
        words = re.findall("[^\x20\x09-\x0d]+", text or "")
        gone = [False] * len(words)
        for s in range(len(words) - 19):
            window = tuple(words[s : s + 20])
            if window in seen:
                gone[s : s + 20] = [True] * 20
            seen.add(window)
        kept = " ".join(w for w, g in zip(words, gone, strict=True) if not g)
        want.append((doc_id, len(words), sum(gone), hashlib.sha256(kept.encode()).hexdigest(), kept))
    got = blocks.remove_repeats(documents(spark, rows)).collect()
    assert sorted(map(tuple, got)) == sorted(want)


def brute_components(rows):
    sets = []
    for _, text in rows:
        low = (text or "").translate({c: c + 32 for c in range(65, 91)})
        words = re.findall("[^\x20\x09-\x0d]+", low)
        sets.append({tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set())
    label = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and 100 * both >= 80 * (len(sets[i]) + len(sets[j]) - both):
                old, new = label[i], label[j]
                label = [new if x == old else x for x in label]
    out = []
    for i, (doc_id, _) in enumerate(rows):
        ids = [r[0] for r, x in zip(rows, label, strict=True) if x == label[i] and r[0] is not None]
        out.append((doc_id, len(sets[i]), min(ids) if ids else None))
    return out, label


def test_components_against_brute_force(spark):
    want, label = brute_components(DOCUMENTS)
    got = jaccard.jaccard_components(documents(spark)).collect()
    assert Counter(map(tuple, got)) == Counter(want)
    kept = jaccard.deduplicate(documents(spark))
    assert kept.columns == documents(spark).columns
    assert kept.count() == len(set(label))
    assert {r[2] for r in want} == {r["doc_id"] for r in kept.collect()}


@pytest.mark.parametrize("work", [suffixes.remove_repeats, blocks.remove_repeats, jaccard.jaccard_components, jaccard.deduplicate])
def test_empty_table(spark, work):
    assert work(documents(spark, [])).count() == 0


def test_rows_without_id_come_last(spark):
    got = {(r["doc_id"], r["n_words"]): r["n_removed"] for r in blocks.remove_repeats(documents(spark)).collect()}
    assert got[(None, 40)] == 40  # the passage, which documents with ids hold
    assert got[(None, 4)] == 0


def test_first_places_of_any_bytes():
    rng = np.random.default_rng(0)
    data = np.concatenate([rng.integers(0, 2, 3000), np.zeros(500), rng.integers(0, 2, 900)]).astype(np.uint8)
    data[2000:2300] = data[100:400]
    data[3600:3900] = data[150:450]
    windows = np.arange(len(data) - 99)
    seen: dict[bytes, int] = {}
    want = [seen.setdefault(data[p : p + 100].tobytes(), p) for p in windows.tolist()]
    assert suffixes.first_places(data, windows, 100).tolist() == want


def test_cover_meets_every_difference():
    found = {(a - b) % suffixes.PERIOD for a in suffixes.COVER for b in suffixes.COVER}
    assert found == set(range(suffixes.PERIOD))


def test_places_rise_with_frequent_grams():
    """Fragments are cut by places, so the grams of a class have to lie in place order whatever their counts."""
    text = prose(31, 400)
    table = pa.table({"batch": pa.array([0, 0], pa.int32()), "doc_id": [1, 2], "tie": [0, 0], "text": [text, near(text, 3, 4)]})
    doc, hashed = jaccard.grams(Texts(table), 5)
    known = np.unique(jaccard._keys(hashed, 1)).astype("<u4")
    times = np.random.default_rng(2).integers(2, 1 << 32, len(known)).astype("<u4")
    times[::2] = times[::2] % (1 << 20) + 2
    back = pa.table({"idx": [[0, 1]], "sizes": [[len(set(hashed[doc == k].tolist())) for k in (0, 1)]], "data": [np.uint32(0).tobytes() + known.tobytes() + times.tobytes()]})
    rows = jaccard._classes(5, 1, 80)(table, back).to_pylist()
    assert len(rows) == 2 and all(r["places"] == sorted(r["places"]) and r["places"][0] >= 0 for r in rows)
    for pivot in sorted({p for r in rows for p in r["places"]})[::20]:
        low, high = set(), set()
        for r in rows:
            cut = sum(p < pivot for p in r["places"])
            low |= set(r["grams"][:cut])
            high |= set(r["grams"][cut:])
        assert not low & high


def brute_bytes(rows):
    seen, want = set(), []
    for doc_id, text in in_order(rows):
        raw = (text or "").encode()
        gone = bytearray(len(raw))
        for s in range(len(raw) - 99):
            if raw[s : s + 100] in seen:
                gone[s : s + 100] = b"\1" * 100
            seen.add(raw[s : s + 100])
        want.append((doc_id, sum(gone), bytes(b for b, g in zip(raw, gone, strict=True) if not g)))
    return want


def test_hot_anchors_spread_over_tasks(spark, monkeypatch):
    """A line that many documents share between different texts: its contexts don't meet in one task, and nothing is lost."""
    monkeypatch.setattr(suffixes, "HOT_CONTEXTS", 20, raising=False)
    line, r = "#license 7781 zq: this line stands in every second file, ok#", random.Random(8)
    odd = lambda n: "".join(r.choice("0123456789abcdef") for _ in range(n))
    right = [odd(45) for _ in range(150)]  # two documents go on alike after the line
    rows = [(i, odd(120) + line + right[i // 2] + odd(90) + (line * 2 if i % 50 == 0 else "")) for i in range(300)]
    sizes, exchange = [], suffixes.exchange

    def watched(sent, answer, buckets):
        sizes.append([r[0] for r in sent.selectExpr("bucket", "length(data) AS n").groupBy("bucket").sum("n").select("sum(n)").collect()])
        return exchange(sent, answer, buckets)

    monkeypatch.setattr(suffixes, "exchange", watched)
    got = suffixes.remove_repeats(documents(spark, rows)).collect()
    assert sorted((r["doc_id"], r["n_removed"], bytes(r["kept"])) for r in got) == sorted(brute_bytes(rows))
    assert sum(r["n_removed"] > 0 for r in got) >= 150
    assert max(sizes[1]) < 0.5 * sum(sizes[1])


def test_batches_are_bounded_in_bytes(spark):
    """Long texts among short ones, and thousands of equal rows without an id: every batch stays small, order holds."""
    rows = [(i, "x" * (20_000 if i >= 1800 else 40)) for i in range(2000)] + [(None, "same text " * 200)] * 3000 + [(5000, "y" * 700_000)]
    batches, size = ordered_batches(documents(spark, rows), batch_bytes=250_000)
    assert size == sum(len(t) for _, t in rows)
    found = batches.selectExpr("batch", "doc_id", "length(text) AS n").collect()
    assert Counter((r["doc_id"], r["n"]) for r in found) == Counter((i, len(t)) for i, t in rows)
    filled: dict = {}
    for r in found:
        filled.setdefault(r["batch"], []).append((r["doc_id"] is None, r["doc_id"] or 0, r["n"]))
    assert max(sum(n for *_, n in b) for b in filled.values() if len(b) > 1) <= 250_000
    ends = [(min(b)[:2], max(b)[:2]) for _, b in sorted(filled.items())]
    assert all(a[1] <= b[0] for a, b in zip(ends, ends[1:], strict=False))
    assert not [t for t in spark.catalog.listTables() if t.name.startswith("batches_")]


def test_a_chain_of_shifted_documents(spark):
    """71 documents, each shifted by 10 of 104 words: neighbours are linked, and all are one component."""
    words = prose(77, 104 + 700).split()
    rows = [(500 - i, " ".join(words[10 * i : 10 * i + 104])) for i in range(71)]
    got = {r["doc_id"]: r["component_id"] for r in jaccard.jaccard_components(documents(spark, rows)).collect()}
    want, _ = brute_components(rows)
    assert got == {i: c for i, _, c in want} and set(got.values()) == {430}
