"""op11, op12 and op13 against brute force and round trips."""

import hashlib
import re
from collections import Counter
from itertools import permutations

import pytest

from rosterank.llm import common, interactions, rotation, runs
from tests.llm.data import DOCUMENTS, documents, prose

UNITS = re.compile("[A-Za-z]+|[^A-Za-z]", re.S)


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def brute_rotation(doc_id, text, plain=10, spm=20):
    text = text or ""
    units = UNITS.findall(text)
    digest = sha(f"1:{'' if doc_id is None else doc_id}")
    h = [int(digest[k : k + 8], 16) for k in (0, 8, 16, 24)]
    a, b = sorted(x % (len(units) + 1) for x in h[:2])
    prefix, middle, suffix = ("".join(u) for u in (units[:a], units[a:b], units[b:]))
    if not text or re.search("<[PSM]>", text) or h[2] % 100 >= 100 - plain:
        return doc_id, len(units), "plain", None, None, text, text
    if h[3] % 100 < spm:
        return doc_id, len(units), "spm", len(prefix), len(middle), f"<S>{suffix}<P>{prefix}<M>{middle}", text
    return doc_id, len(units), "psm", len(prefix), len(middle), f"<P>{prefix}<S>{suffix}<M>{middle}", text


ODD = ["a<P>b", "<S>", "x <M> y", "<<P", "S><", "<P<S<M", "\x00é\n\r\n", "😀a😀bc", "ﬁ", "<", "A", "Zz9", "P>" * 40]


@pytest.mark.parametrize(("plain", "spm"), [(10, 20), (0, 0), (0, 100), (100, 0)])
def test_rotations_against_brute_force(spark, plain, spm):
    rows = [*DOCUMENTS, *[(100 + i, t) for i, t in enumerate(ODD)], *[(1000 + i, prose(i, i % 7) + ODD[i % 13] * (i % 3)) for i in range(200)]]
    rows.append((5000, "long " * 200_000))
    out = rotation.restore_texts(rotation.rotate_texts(documents(spark, rows), plain_percent=plain, spm_percent=spm))
    assert Counter(map(tuple, out.collect())) == Counter(brute_rotation(i, t, plain, spm) for i, t in rows)


def test_rotation_of_nothing(spark):
    assert rotation.restore_texts(rotation.rotate_texts(documents(spark, []))).count() == 0


def test_a_rotation_exchanges_blocks():
    for text in (b"", b"a", b"abcdefg"):
        for a in range(len(text) + 1):
            for b in range(a, len(text) + 1):
                for c in range(b, len(text) + 1):
                    out = bytearray(text)
                    rotation.rotate(out, a, b, c)
                    assert bytes(out) == text[:a] + text[b:c] + text[a:b] + text[c:]


LINES = "\x20\x09\x0a\x0b\x0c\x0d"
FAILING = [
    (1, prose(1, 150), "en"),
    (2, prose(1, 150), "en"),
    (2, prose(1, 150), "en"),
    (2, prose(1, 150), "de"),
    (3, prose(1, 150), None),
    (None, prose(1, 150), ""),
    (None, None, "fr"),
    (4, "", "fr"),
    (5, "A | B " * 60, "fr"),
    (6, "SHOUT " * 30, "x"),
    (7, "Word joined word\x0bword", "x"),
    *[(20 + i, prose(i % 9, 60 + 15 * i) + "&|#"[i % 5 : i % 5 + 1] + "ABC" * (i % 4 * 40), ("en", "de", None)[i % 3]) for i in range(40)],
]
LABELS = [(1, 1, 0), (2, 0, 1), (2, 1, None), (3, None, 1), (5, 1, 1), (None, 1, 1), (22, 1, 1), (23, 0, 1), (24, 1, 0), (999, 1, 1)]


def fails_of(rows):
    out = []
    for doc_id, text, _ in rows:
        t = text or ""
        words = [w for w in re.split(f"[{LINES}]+", t) if w]
        same = [i for i, other, _ in rows if (other or "") == t]
        copies = any(i is not None and (doc_id is None or i < doc_id) for i in same)
        capitals = sum("A" <= c <= "Z" for c in t)
        bad = (len(words) < 100, 100 * len(set(words)) < 80 * len(words), 100 * capitals > 10 * len(t), bool(re.search("[#$%&*|]", t)), copies)
        out.append("".join(f for f, b in zip("ABCDE", bad, strict=True) if b))
    return out


def brute_audit(rows, labels):
    fails = fails_of(rows)
    good, toxic = ({i for i, *v in labels if v[k] == 1 and i is not None} for k in (0, 1))
    out = []
    for part in {r[2] or "" for r in rows}:
        own = [(i, f) for (i, _, lang), f in zip(rows, fails, strict=True) if (lang or "") == part]
        some = []
        for order in map("".join, permutations("ABCDE")):
            left = own
            for step, f in enumerate(order, 1):
                gone = [i for i, bad in left if f in bad]
                left = [(i, bad) for i, bad in left if f not in bad]
                redundant = sum(f in bad for _, bad in own) - len(gone)
                unique = sum(bad == f for _, bad in own)
                some.append((part, order, step, len(left), len(gone), redundant, unique, sum(i in good for i in gone), sum(i in toxic for i in gone)))
        shapley = Counter()
        for r in some:
            shapley[r[1][r[2] - 1]] += r[4]
        out += [(*r, shapley[r[1][r[2] - 1]]) for r in some]
    return out


def test_audit_against_brute_force(spark):
    docs = spark.createDataFrame([(*r, 7, "clash") for r in FAILING], "doc_id long, text string, lang string, mask int, part string")
    labels = spark.createDataFrame(LABELS, "doc_id long, quality int, toxic int")
    masks = interactions.failure_masks(docs, labels)
    got = interactions.audit_orders(masks)
    assert got.columns == ["part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]
    assert sorted(map(tuple, got.collect())) == sorted(brute_audit(FAILING, LABELS))
    assert interactions.audit_orders(interactions.failure_masks(docs.limit(0), labels)).count() == 0
    alone = interactions.failure_masks(docs, labels.limit(0)).agg({"n": "sum", "good": "sum", "toxic": "sum"}).first()
    assert sorted(alone) == [0, 0, len(FAILING)]


def test_intervals_cover_every_order_once():
    for names in ("A", "AB", "ABCD", "ABCDE"):
        orders = list(permutations(names))
        for mask in range(1, 1 << len(names)):
            covered = []
            for m, step, low, high in interactions.removal_intervals(names):
                if m == mask:
                    covered += range(low, high)
                    assert all([bool(mask >> names.index(f) & 1) for f in orders[r][:step]] == [False] * (step - 1) + [True] for r in range(low, high))
            assert covered == list(range(len(orders)))


LICENCE = "Licensed under the public terms of 1999."
LINED = [
    *DOCUMENTS,
    (100, f"{LICENCE}\n{prose(40, 20)}\n{LICENCE}"),
    (101, f"\t{LICENCE.upper()}\x0b \r\nÄhnliche Zeile\n{prose(41, 9)}"),
    (102, f"ähnliche Zeile\nÄHNLICHE ZEILE\n\n\n{LICENCE}\n"),
    (102, f"{LICENCE}\nanother text of the same id"),
    (103, "Ähnliche ZEILE \n123456789\n1234567890\n\n"),
    (104, "123456789\n 1234567890  \n\t1234567890\x0c"),
    (105, f"{LICENCE}\n{LICENCE}"),
    (-5, "123456789\nanother text of the SAME id"),
    (None, f"{LICENCE}\nonly where no id is"),
    (None, "only where no id is\nno id, no passage"),
    *[(200 + i, f"{LICENCE}\n{prose(50 + i % 4, 6)}\n" + "short\n" * (i % 3)) for i in range(60)],
    (400, "\n".join(f"line number {i % 3000} of a long text" for i in range(6000))),
    (401, "\n".join(f"Line number {i} of a long text" for i in range(2999, -1, -2))),
]


def brute_lines(rows, least=10):
    key = lambda line: line.strip(LINES).translate({c: c + 32 for c in range(65, 91)})
    holders: dict = {}
    for doc_id, text in rows:
        for line in (text or "").split("\n"):
            holders.setdefault(key(line), set()).add(doc_id)
    out = Counter()
    for doc_id, text in rows:
        lines, kept = (text or "").split("\n"), []
        for line in lines:
            ids = holders[key(line)]
            if len(key(line)) < least or not any(i is not None and (doc_id is None or i < doc_id) for i in ids):
                kept.append(line)
        out[(doc_id, len(lines), len(lines) - len(kept), "\n".join(kept))] += 1
    return out


@pytest.mark.parametrize(("batches", "fanout", "hot"), [(8, 4, 1000), (5, 2, 3), (1, 2, 0)])
def test_lines_against_brute_force(spark, monkeypatch, batches, fanout, hot):
    monkeypatch.setattr(common, "HOT_LEAST", hot)  # more and fewer hashes go by broadcast
    got = runs.remove_lines(documents(spark, LINED), batches=batches, fanout=fanout)
    assert Counter(map(tuple, got.collect())) == brute_lines(LINED)
    assert not [t for t in spark.catalog.listTables() if t.name.startswith(("run_", "hashes_"))]


def test_lines_of_nothing(spark):
    assert runs.remove_lines(documents(spark, [])).count() == 0
    odd = [(None, None), (None, "a line without any id\na line without any id"), (None, "a line without any id")]
    got = runs.remove_lines(documents(spark, odd))
    assert Counter(map(tuple, got.collect())) == brute_lines(odd)
