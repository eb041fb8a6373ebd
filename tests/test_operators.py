import random
from collections import Counter

from pyspark.sql import functions as F
from rosterank.functions import search
from rosterank.operators import dense, lookup, tfidf
from rosterank.operators.neighbours import with_next
from rosterank.operators.topk import top_per_group


def test_top_per_group_with_a_hot_group(spark):
    rng = random.Random(1)
    rows = [("hot" if i % 3 else f"g{i % 7}", f"id{i:05d}", rng.randint(0, 50)) for i in range(3000)]
    df = spark.createDataFrame(rows, "g string, id string, score int")
    got = top_per_group(df, ["g"], [F.desc("score"), F.asc("id")], 10, spread_by=["id"]).collect()
    want = []
    for g in {r[0] for r in rows}:
        best = sorted((r for r in rows if r[0] == g), key=lambda r: (-r[2], r[1]))[:10]
        want += [(g, i, s, n) for n, (_, i, s) in enumerate(best, 1)]
    assert sorted((r.g, r.id, r.score, r["rank"]) for r in got) == sorted(want)


def test_skew_split_join_equals_plain_join(spark):
    facts = spark.createDataFrame([("the" if i % 3 else f"w{i % 50}", i) for i in range(2000)], "w string, id int")
    side = spark.createDataFrame([("the", 1.0), *[(f"w{i}", float(i)) for i in range(0, 50, 2)]], "w string, x double")
    for how in ("inner", "left", "left_semi", "left_anti"):
        want = sorted(facts.join(side, ["w"], how).collect(), key=str)
        split = lookup.join_lookup(facts, side, ["w"], how=how, spread_by="id", max_rows=10, hot_rows=100)
        assert sorted(split.collect(), key=str) == want
        small = lookup.join_lookup(facts, side, ["w"], how=how, spread_by="id")
        assert sorted(small.collect(), key=str) == want


def test_next_row_across_ranges(spark):
    rows = [("big" if i % 4 else "small", i % 37, i) for i in range(2000)]
    df = spark.createDataFrame(rows, "f string, r int, n int")
    got = {(x.f, x.n): x.next_n for x in with_next(df, "f", ["r", "n"], ["n"]).collect()}
    want = {}
    for f in ("big", "small"):
        order = sorted((r, n) for g, r, n in rows if g == f)
        want |= {(f, n): nxt for (_, n), nxt in zip(order, [n for _, n in order[1:]] + [None])}
    assert got == want


def test_frequency_cut_equals_a_full_sort(spark):
    rng = random.Random(3)
    counts = Counter(rng.randint(1, 400) ** 2 // 400 for _ in range(3000))
    stats = [("a", f"t{t}", c) for t, c in counts.items()] + [("b", "only", 4)]
    df = spark.createDataFrame(stats, "jd_id string, term string, cf bigint")
    sizes = spark.createDataFrame([("a",), ("b",)], "jd_id string")
    for limit in (1, 7, 50, len(counts), len(counts) + 5):
        got = {(r.jd_id, r.term) for r in tfidf.most_frequent(df, sizes, limit).collect()}
        best = sorted((s for s in stats if s[0] == "a"), key=lambda s: (-s[2], s[1]))[:limit]
        assert got == {("a", s[1]) for s in best} | {("b", "only")}


def test_tfidf_against_hand_computation(spark):
    import math

    texts = [(1, ["j"], "Café search search"), (2, ["j"], "roses"), (3, ["j"], "!")]
    docs = spark.createDataFrame(texts, "text_id int, jd_ids array<string>, text string")
    jds = spark.createDataFrame([("j", "cafe search")], "jd_id string, text string")
    got = {r.text_id: r for r in tfidf.tfidf_similarity(docs, jds).collect()}
    # corpus of 4: cafe, search, "cafe search" in 2 texts; "search search" and roses in one
    two, one = math.log(5 / 3) + 1, math.log(5 / 2) + 1
    tf2 = (1 + math.log(2)) * two
    dot = two * two + tf2 * two + two * two
    norm = math.sqrt(two**2 + tf2**2 + two**2 + one**2) * math.sqrt(3 * two**2)
    assert abs(got[1].similarity - dot / norm) < 1e-12
    assert (got[1].semantic, got[2].semantic, got[3].semantic) == (1.0, 0.0, 0.0)


VECTORS = [[1.0, 0.0, 2.0], [0.5, -1.0, 0.25], [0.0, 0.0, 0.0], None, [], [1.0, None, 2.0], [float("nan"), 1.0, 1.0], [1.0, 2.0], [3.0, 4.0, 0.0]]


def plain_cosine(a, b):
    import math

    if not a or not b or len(a) != len(b) or any(x is None or not math.isfinite(x) for x in [*a, *b]):
        return 0.0
    length = math.sqrt(sum(x * x for x in a)) * math.sqrt(sum(x * x for x in b))
    return sum(x * y for x, y in zip(a, b)) / length if length else 0.0


def test_cosines_of_sound_and_odd_vectors(spark):
    pairs = [(i, j, a, b) for i, a in enumerate(VECTORS) for j, b in enumerate(VECTORS)]
    df = spark.createDataFrame(pairs, "i int, j int, a array<double>, b array<double>")
    for r in dense.with_cosine(df, "a", "b", "c").collect():
        assert abs(r.c - plain_cosine(VECTORS[r.i], VECTORS[r.j])) < 1e-12
    references = spark.createDataFrame([(f"r{j}", b) for j, b in enumerate(VECTORS)], "jd_id string, v array<double>")
    listed = [f"r{j}" for j in range(len(VECTORS))]
    rows = spark.createDataFrame([(i, a, listed if i % 2 else [*listed[::-1], "unknown"]) for i, a in enumerate(VECTORS)] + [(99, [1.0, 1.0, 1.0], None)], "i int, e array<double>, ids array<string>")
    for r in dense.with_cosines(rows, references, key="jd_id", of="v", ids="ids", vector="e", output="c").collect():
        if r.i == 99:
            assert r.c is None
            continue
        want = [0.0 if name == "unknown" else plain_cosine(VECTORS[r.i], VECTORS[int(name[1:])]) for name in r.ids]
        assert all(abs(x - y) < 1e-12 for x, y in zip(r.c, want, strict=True))


def test_word_counts_equal_plain_counts():
    rng = random.Random(4)
    for _ in range(200):
        text = "".join(rng.choice("aab-1 .é") for _ in range(rng.randrange(120)))
        words = sorted({"".join(rng.choice("aab-1") for _ in range(rng.randrange(1, 5))) for _ in range(12)})
        assert search.count_in(text, words) == [float(text.count(w)) for w in words]
    assert search.count_in("", ["a"]) == [0.0] and search.count_in("aaa", []) == []


def test_counting_grows_with_the_text():
    import time

    def seconds(n):
        words = [f"w{i:x}x{i * 7919 % 9973:x}" for i in range(n)]
        start = time.perf_counter()
        assert sum(search.count_in(" ".join(words), words)) >= n
        return time.perf_counter() - start

    seconds(500)
    assert seconds(16_000) < 30 * seconds(2_000)  # eight times the words; a search per word would take 64 times as long


def test_held_terms(spark):
    terms = ["ab", "b", "abc", "x y", "é"]
    texts = ["abcd", "", None, "x  y", "x yé", "B"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    got = [r[0] for r in df.select(search.held_terms(F.col("t"), terms)).collect()]
    assert got == [[k for k, term in enumerate(terms) if term in (t or "")] for t in texts]


def test_terms_as_numbers_order_and_count_like_strings(spark, monkeypatch):
    """Repeated ids, accents, short words and the same vocabulary whether terms are counted as numbers or as strings."""
    rng = random.Random(9)
    word = lambda: "".join(rng.choice("abAé_1") for _ in range(rng.randrange(1, 4)))
    rows = [(n // 2 if n < 6 else n, ["j"] if n % 3 else ["j", "k"], rng.choice([" ", "-", "\n", "\x00"]).join(word() for _ in range(rng.randrange(30)))) for n in range(60)]
    texts = spark.createDataFrame([*rows, (99, ["j"], None)], "text_id int, jd_ids array<string>, text string")
    jds = spark.createDataFrame([("j", "ab éa ab_1"), ("k", "")], "jd_id string, text string")
    found = []
    for most in (tfidf.MAX_WORDS, 3):
        monkeypatch.setattr(tfidf, "MAX_WORDS", most)
        found.append(sorted(map(str, tfidf.fit_vocabulary(texts, jds, 40).collect())))
    assert found[0] == found[1] and len(found[0]) == 80
    for n, rows in enumerate((found[0], tfidf.tfidf_similarity(texts, jds, 40).collect())):
        assert n == 0 or len(rows) == 61 + sum("k" in r[1] for r in texts.collect())


def test_texts_are_not_shuffled(spark, tmp_path):
    """Before, every text went through an exchange and every term of it into a table."""
    import re

    texts = spark.createDataFrame([(n, ["j"], f"word{n % 7} text") for n in range(50)], "text_id int, jd_ids array<string>, text string")
    single, several = tfidf.one_per_id(texts)
    assert several is None
    plan = tfidf.counts_of_sets(single.selectExpr("xxhash64(jd_ids) set_id", "text"), None)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Exchange", plan) and "InArrow" in plan
