"""op1, op2, op4 and op9 against brute force and round trips."""

import base64
import hashlib
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from tokenizers import Tokenizer

from rosterank.llm import decontaminate, packing, secrets, warc
from rosterank.llm.common import shared_dir
from tests.llm.data import DOCUMENTS, PASSAGE, documents, prose

PAGES = [
    (1, "http://a/1", "<p>x</p>"),
    (2, "http://a/2", "<p>x</p>"),
    (2, "http://a/2", "<p>x</p>"),
    (0, None, "<p>ü</p>"),
    (5, "http://a/5", None),
    (4, "http://a/4", ""),
    (None, "http://a/n", "<p>ü</p>"),
    (7, "http://a\r\n/7", prose(3, 20000)),
    *[(100 + i, f"http://b/{i}", "<html>" + prose(i, 60) + "</html>") for i in range(60)],
]


def test_archives_round_trip(spark):
    pages = spark.createDataFrame([(*p, "clash") for p in PAGES], "page_id long, url string, html string, digest string")
    manifest = warc.write_archives(pages, shared_dir(spark, "warc"), archive_bytes=20_000)
    got = warc.read_archives(manifest).collect()
    assert len(got) == len(PAGES)
    assert all(r["verified"] for r in got if r["record_type"] == "response")
    groups: dict = {}
    for page, _, html in PAGES:
        groups.setdefault((html or "").encode(), []).append(page)
    want = Counter()
    for body, ids in groups.items():
        ids.sort(key=lambda i: (i is None, i or 0))
        digest = base64.b32encode(hashlib.sha1(body).digest()).decode()
        for k, page in enumerate(ids):
            want[(page, len(body), digest, "revisit" if k else "response", ids[0] if k else None)] += 1
    fields = ("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
    assert Counter(tuple(r[f] for f in fields) for r in got) == want
    one = next(r for r in got if r["page_id"] == 130)
    assert b"WARC-Target-URI: http://b/30" in warc.read_record(one["archive"], one["offset"])
    assert manifest.agg({"dictionary_bytes": "max"}).first()[0] > 0


def test_small_payloads_are_never_revisits(spark):
    pages = spark.createDataFrame(PAGES, "page_id long, url string, html string")
    kinds = warc.plan_records(pages, min_bytes=9).collect()
    assert {r["page_id"] for r in kinds if r["record_type"] == "revisit"} == {None}
    assert warc.write_archives(pages.limit(0), shared_dir(spark, "warc")).count() == 0


ITEMS = [(1, PASSAGE), (2, "one, two THREE!"), (3, None), (4, ""), (5, "..."), (6, "absent " * 12), (1, prose(17, 50))]


def test_benchmark_against_brute_force(spark):
    words = lambda t: re.findall("[0-9a-z\x80-\U0010ffff]+", (t or "").translate({c: c + 32 for c in range(65, 91)}))
    windows: dict = {}
    for item, text in ITEMS:
        w = words(text)
        for i in range(max(1, len(w) - 9) if w else 0):
            windows.setdefault(tuple(w[i : i + 10]), set()).add(str(item))
    want = Counter()
    for doc_id, text in DOCUMENTS:
        w = words(text)
        hit, items = set(), set()
        for i in range(len(w)):
            for size in {len(k) for k in windows}:
                if i + size <= len(w) and (found := windows.get(tuple(w[i : i + size]))):
                    hit.update(range(i, i + size))
                    items |= found
        named = hashlib.sha256(",".join(sorted(items)).encode()).hexdigest()
        want[(doc_id, len(w), len(hit), len(items), named, bool(hit))] += 1
    bench = spark.createDataFrame(ITEMS, "item_id long, text string")
    for block_bytes in (16 << 20, 1):  # one automaton, and one for each item
        found = decontaminate.find_benchmark(documents(spark), bench, block_bytes=block_bytes)
        assert Counter(tuple(r)[:6] for r in found.collect()) == want
    row = next(r for r in found.collect() if r["doc_id"] == 6)
    text = dict(DOCUMENTS)[6]
    assert [text[s["start"] : s["end"]] for s in row["spans"]] == [PASSAGE]
    assert decontaminate.drop_contaminated(documents(spark), bench).count() == sum(n for k, n in want.items() if not k[5])
    assert not decontaminate.find_benchmark(documents(spark), bench.limit(0)).where("contaminated").count()
    assert decontaminate.find_benchmark(documents(spark, []), bench).count() == 0


def brute_secrets(text):
    kinds = (
        ("assign", r"""((?:[Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy]))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
        ("access", r"AKIA[A-Z0-9]+", 0, 20),
        ("hex", r"[0-9a-f]+", 0, 24),
    )
    found = [(m.start(), k, m.end(), name) for k, (name, p, g, least) in enumerate(kinds) for m in re.finditer(p, text or "") if len(m[g]) >= least]
    return [(a, b, name) for a, _, b, name in sorted(found)]


def test_secrets_against_brute_force(spark):
    many = " ".join(f"token=abcdef{i} é" for i in range(1300))
    rows = [*DOCUMENTS, (30, many), (31, "PASSWORD:'" + "x" * 300)]
    got = secrets.find_secrets(documents(spark, rows)).collect()
    found = Counter((r["doc_id"], tuple((s["start"], s["end"], s["kind"]) for s in r["found"])) for r in got)
    assert found == Counter((i, tuple(brute_secrets(t))) for i, t in rows)
    clean = {r["doc_id"]: r for r in secrets.redact(documents(spark, rows)).collect()}
    assert clean[20]["text"] == 'x [assign]" [assign] [hex] é secret=é'
    assert clean[20]["n_chars"] == len(clean[20]["text"])
    assert clean[11]["text"] == "one two three" and clean[8]["text"] is None
    assert secrets.find_secrets(documents(spark, [])).count() == 0


def test_trigram_queries():
    assert secrets.trigram_query(r"AKIA[A-Z0-9]+") == frozenset([frozenset({"aki", "kia"})])
    assert frozenset() in secrets.trigram_query(r"[0-9a-f]+")
    assert secrets.trigram_query(r"(abc|xyz)[0-9]+tail") == frozenset([frozenset({"abc", "tai", "ail"}), frozenset({"xyz", "tai", "ail"})])
    for pattern in (r"a?bcd", r"(ab){2}cde", r"x|yyy", r"(?i:KEY)\d"):
        assert frozenset() not in secrets.trigram_query(pattern) or pattern == r"x|yyy"


ODD = ["<|endoftext|> a<|startoftext|>b", "é ́x Σ AΣ", "a b\x1cc\x85d", "don't 's  12ab ½ ²", "\U0001f600 hi‍", "ẞİ İ", "日本語 text"]


def test_packing(spark):
    rows = [*DOCUMENTS, *[(50 + i, t) for i, t in enumerate(ODD)], *[(100 + i, prose(i, 3 + i * 37 % 400)) for i in range(80)]]
    path = packing.default_tokenizer()
    own = Tokenizer.from_file(path)
    want = Counter()
    for doc_id, text in rows:
        ids = np.array([*own.encode(text or "", add_special_tokens=False).ids, 0], "<u4")
        for k, at in enumerate(range(0, len(ids), 256)):
            part = ids[at : at + 256]
            want[(doc_id, k, at, len(part), zlib.crc32(part.tobytes()))] += 1
    got = packing.pack_documents(documents(spark, rows), path, capacity=256).collect()
    assert Counter(tuple(r[c] for c in ("doc_id", "piece", "start", "length", "ids_crc32")) for r in got) == want
    sequences: dict = {}
    for r in got:
        sequences.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for parts in sequences.values():
        parts.sort()
        assert parts[0][0] == 0 and sum(n for _, n in parts) <= 256
        assert all(a + n == b for (a, n), (b, _) in zip(parts, parts[1:], strict=False))
    assert len(sequences) <= 1.02 * -(-sum(r["length"] for r in got) // 256) + 1
    assert packing.pack_documents(documents(spark, []), path).count() == 0


def test_words_meet_the_tokenizer_as_in_their_texts():
    own = Tokenizer.from_file(packing.default_tokenizer())
    texts = [*ODD, *(t or "" for _, t in DOCUMENTS), "it's IT'LL _a__b 1234 ... ?! x_y 'S'", "".join(map(chr, range(32, 592)))]
    want = [np.asarray(own.encode(t, add_special_tokens=False).ids, "<u4").tobytes() for t in texts]
    assert list(packing.WordCache(own).encode(texts)) == want


def test_other_tokenizers_are_refused(spark, tmp_path):
    from tokenizers import models, pre_tokenizers

    other = Tokenizer(models.BPE(vocab={"a": 0, "b": 1}, merges=[], end_of_word_suffix="</w>"))
    other.pre_tokenizer = pre_tokenizers.Whitespace()
    other.save(str(tmp_path / "other.json"))
    assert packing.known_rules(Tokenizer.from_file(packing.default_tokenizer())) and not packing.known_rules(other)
    with pytest.raises(ValueError, match="other rules"):
        packing.pack_documents(documents(spark), str(tmp_path / "other.json"))


@pytest.mark.parametrize("histogram", [{}, {5: 1}, {10: 7}, {6: 5, 4: 5, 3: 1}, {1: 25, 9: 2, 10: 1}])
def test_plan_places_everything_once(histogram):
    slots = packing.plan_slots(histogram, 10)
    count, filled = Counter(), {}
    for length, _, times, sequence, offset in slots:
        count[length] += times
        for k in range(times):
            filled.setdefault(sequence + k, []).append((offset, length))
    assert count == histogram
    assert all(sum(n for _, n in parts) <= 10 for parts in filled.values())
