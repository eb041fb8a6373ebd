"""Work that has to grow with the input and no faster."""

import datetime as dt
import gzip
import random
import unicodedata
from collections import Counter
from pathlib import Path

import pyarrow as pa
from catalog import registry
from pyspark.sql import DataFrameReader
from pyspark.sql import functions as F
from rosterank import check_files, load_candidates, read_ranking_rows, vocab
from rosterank.functions import jd_text, term_slices
from rosterank.functions.texts import strip_marks
from rosterank.operators import tfidf
from rosterank.plans import jobs, ranking
from rosterank.staging import staging_root


def test_rare_words_are_not_numbered(spark, monkeypatch):
    """Before, the driver collected every word, and past MAX_WORDS terms were counted as strings: junk alone led there."""
    rng = random.Random(5)
    common = [f"w{i}" for i in range(12)]
    made = lambda n: " ".join([*rng.choices(common, k=20), f"junk{n}", f"é{n}x", rng.choice(["-", " ", " "])])
    rows = [(n - n % 2 if n < 8 else n, [f"j{n % 5}"] if n % 11 else [f"other{n % 3}"], made(n)) for n in range(300)]
    texts = spark.createDataFrame([*rows, (900, ["j1"], None), (901, None, "w1 w2")], "text_id int, jd_ids array<string>, text string")
    jds = spark.createDataFrame([(f"j{n}", f"w{n} w1 alone{n}") for n in range(7)], "jd_id string, text string")
    kinds = []
    counting = tfidf.counts_of_sets
    monkeypatch.setattr(tfidf, "counts_of_sets", lambda some, words: kinds.append(None if words is None else len(words)) or counting(some, words))

    def found():
        kinds.clear()
        vocabulary = sorted(map(str, tfidf.fit_vocabulary(texts, jds, 15).collect()))
        similar = {(r["jd_id"], r["text_id"]): round(r["similarity"], 12) for r in tfidf.tfidf_similarity(texts, jds, 15).collect()}
        return vocabulary, similar

    want = found()
    monkeypatch.setattr(tfidf, "ORDERED_SETS", 2)
    monkeypatch.setattr(tfidf, "MAX_WORDS", 100)
    assert found() == want
    assert kinds and all(n is not None and n < 30 for n in kinds)
    monkeypatch.setattr(tfidf, "MAX_BROADCAST_ROWS", 20)  # several passes
    assert found() == want


def test_rare_terms_are_not_counted_by_name(spark, monkeypatch):
    """Before, every word and pair of a pool was shuffled with its count, once for each description."""
    rng = random.Random(6)
    common = [f"w{i}" for i in range(8)]
    sets = [["a"], ["a", "b"], ["b", "c"], ["c"], ["d"], [], None]
    rows = [(n // 2 if n < 6 else n, rng.choice(sets), " ".join([*rng.choices(common, k=12), f"junk{n}", f"wort\u00e9{n}"])) for n in range(400)]
    texts = spark.createDataFrame([*rows, (900, ["a"], None)], "text_id int, jd_ids array<string>, text string")
    jds = spark.createDataFrame([(x, f"w1 w2 alone{x}") for x in "abcde"], "jd_id string, text string")
    words = lambda t: [strip_marks(w) for w in t.split()]
    terms = lambda ws: Counter([*ws, *map(" ".join, zip(ws, ws[1:], strict=False))])
    want = []
    for x in "abcde":
        alike = {}  # texts with one id are one
        for n, jd_ids, text in rows:
            if x in (jd_ids or []):
                alike.setdefault((n, tuple(jd_ids)), Counter()).update(terms(words(text)))
        own, cf, df = terms(words(f"w1 w2 alone{x}")), Counter(), Counter()
        for counts in [*alike.values(), own]:
            cf.update(counts)
            df.update(counts.keys())
        n_texts = sum(x in (jd_ids or []) for _, jd_ids, _ in [*rows, (900, ["a"], None)]) + 1
        want += [(x, t, df[t], n_texts, own[t]) for t in sorted(cf, key=lambda t: (-cf[t], t))[:15]]
    counted = []
    likely = tfidf.likely_terms

    def told(*args):
        bounds, counts = likely(*args)
        counted.extend(r["term"] for c in counts for r in c.select("term").distinct().collect())
        return bounds, counts

    monkeypatch.setattr(tfidf, "likely_terms", told)
    found = lambda: sorted(tuple(r) for r in tfidf.fit_vocabulary(texts, jds, 15).collect())
    assert found() == sorted(want)
    assert counted and sum("junk" in t or "worte" in t for t in counted) < 100  # of 1,600
    monkeypatch.setattr(tfidf, "MAX_SET_BOUNDS", 0)
    monkeypatch.setattr(tfidf, "CLASSES", 2)
    monkeypatch.setattr(term_slices, "SUM_ROWS", 10)
    assert found() == sorted(want)


def test_accents_are_folded_in_slices(spark):
    """Before, every pass folded all texts with accents in the JVM, character by character."""
    texts = ["caf\u00e9 na\u00efve x", "\u00bdab\u2026cd", None, "", "\u4e2d\u6587\u3002\u5b57\u5b57 \ufb01n", "\ud55c\uae00 \u2121x", "a\u2014bc_\u0301d \u200d", "e\u0301e \u0391\u0392 11", "one-two\u2028three"]
    tokens = term_slices.Tokens.of(next(term_slices.slices(iter([pa.record_batch({"text": pa.array(texts)})]))).column("text"))
    got = [[] for _ in texts]
    for row, code in zip(tokens.row, tokens.code, strict=True):
        got[row].append(tokens.words[code].as_py())
    letter = lambda c: c == "_" or unicodedata.category(c)[0] in "LN"
    plain = ["".join(c if letter(c) else " " for c in strip_marks(t or "")) for t in texts]
    plain = ["".join(c.lower() if c < "\x80" else c for c in t) for t in plain]
    assert got == [[w for w in t.split() if len(w) > 1] for t in plain]
    ends = [(tokens.words[tokens.code[k]].as_py(), tokens.words[tokens.code[k + 1]].as_py()) for k in tokens.linked]
    assert ("cafe", "naive") in ends and ("one", "two") in ends and ("two", "three") not in ends  # a break parts them
    rows = spark.createDataFrame([(1, ["j"], "\u00c9t\u00e9")], "text_id int, jd_ids array<string>, text string")
    assert "translate" not in tfidf.one_per_id(rows)[0]._jdf.queryExecution().optimizedPlan().toString()


def test_explanations_read_no_summary(spark, tmp_path):
    """Before, whole profiles with their texts were read to explain a few of them."""
    kinds = "candidate_id string, jd_ids array<string>, profile struct<years_of_experience:double,current_title:string,current_company:string,location:string,summary:string>, "
    kinds += "career_history array<struct<title:string,company:string,description:string>>, skills array<struct<name:string,proficiency:string,duration_months:bigint>>, "
    kinds += "signals struct<recruiter_response_rate:double,notice_period_days:bigint,willing_to_relocate:boolean>"
    made = [("c1", ["j"], (4.0, "t", "co", "Pune", "long text"), [("E", "A", "uses spark")], [("Spark", "expert", 5)], (0.5, 20, True)), ("c2", ["j"], None, None, None, None)]
    spark.createDataFrame(made, kinds).write.parquet(f"{tmp_path}/pool")
    about = spark.createDataFrame([("j", 3, 6, ["pune"], [("spark", 1.0)])], "jd_id string, exp_min bigint, exp_max bigint, locations array<string>, skill_weights array<struct<term:string,weight:double>>")
    ranked = spark.createDataFrame([("j", "c1", 1, 0.7, 1.2), ("j", "c2", 2, 0.1, 0.5)], "jd_id string, candidate_id string, rank int, skill double, behavior double")
    pool = spark.read.parquet(f"{tmp_path}/pool")
    for explained in (ranking.explain_ranked(ranked, pool, about), ranking.explain_pairs(pool, ranked, about)):
        got = {r["candidate_id"]: r["reasoning"] for r in explained.collect()}
        assert got["c1"] == "Strong fit: 4yr exp, strong skill match (Spark); shipped E at A. Active on platform, 50% response rate; available in 20d; based in pune."
        assert got["c2"].startswith("Strong fit: 0yr exp")
        assert "summary" not in explained._jdf.queryExecution().executedPlan().toString()


def test_combined_weights_are_made_once(spark):
    terms = vocab.tiered_terms()
    features = spark.createDataFrame(
        [("a", [(terms[3][1], 3.0), ("other", 1.0), (terms[-1][1], 1.0)]), ("b", []), ("c", None)],
        "jd_id string, skill_weights array<struct<term:string,weight:double>>",
    )
    rows = jobs.combined_weight_rows(features)
    got = {}
    for r in rows.collect():
        got.setdefault(r["jd_id"], []).append((r["term"], r["weight"]))
    rest = lambda known: [(t, vocab.TIER_WEIGHTS[tier][1]) for tier, t in terms if t not in known]
    assert got["a"] == [(terms[3][1], 3.0), ("other", 1.0), (terms[-1][1], 1.0), *rest({terms[3][1], terms[-1][1]})]
    assert got["b"] == rest(()) and set(got) == {"a", "b"}
    lists = features.select(jd_text.combined_weights(F.col("skill_weights")).alias("l")).filter("l is not null").collect()
    assert [[tuple(e) for e in r["l"]] for r in lists] == [got["a"], got["b"]]
    plan = rows._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("array_except") == len(vocab.TIER_WEIGHTS)  # before, the lists were made in a filter as well


def test_array_files_are_compressed(spark, tmp_path):
    """Before, arrays and lines were written as they are, and profiles shuffled."""
    day = dt.datetime(2023, 5, 1)
    orders = [(k, k % 40, "O", 100.0 + k, day, "1-URGENT") for k in [*range(0, 450, 3), 7, 7, 12_345_678]]
    spark.createDataFrame(orders, "o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_totalprice double, o_orderdate timestamp_ntz, o_orderpriority string").write.parquet(f"{tmp_path}/orders.parquet")
    spark.createDataFrame([(n, n % 20, "click") for n in range(60)], "event_id bigint, user_id bigint, event_type string").write.parquet(f"{tmp_path}/events.parquet")
    root = Path(staging_root(spark).removeprefix("file:"))
    before = set(root.iterdir())
    rows = registry.json_arrays(spark, str(tmp_path)).collect()
    each = {kind: sorted(tuple(r)[1:] for r in rows if r["format"] == kind) for kind in ("array", "lines")}
    assert each["array"] == each["lines"] and len(each["lines"]) == len(orders)
    made = [f for folder in set(root.iterdir()) - before for f in folder.rglob("part-*") if folder.name.startswith(("arrays", "lines"))]
    assert len([f for f in made if f.parent.name.startswith("file=")]) == 6
    assert made and all(f.name.endswith(".txt.gz") for f in made)


def test_bounded_gzip_files_are_read_unshuffled(spark, tmp_path, monkeypatch):
    """Before, the profiles of gzip files were shuffled once read, and a file held all of its task."""
    day = dt.datetime(2023, 5, 1)
    orders = [(k, k and k % 40, "O", 100.0 + (k or 0), day, "1-URGENT") for k in [*range(0, 450, 3), 7, 7, None, 12_345_678]]
    spark.createDataFrame(orders, "o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_totalprice double, o_orderdate timestamp_ntz, o_orderpriority string").write.parquet(f"{tmp_path}/orders.parquet")
    spark.createDataFrame([(n, n % 20, "click") for n in range(60)], "event_id bigint, user_id bigint, event_type string").write.parquet(f"{tmp_path}/events.parquet")
    monkeypatch.setattr(registry, "FILE_ROWS", 5)
    root = Path(staging_root(spark).removeprefix("file:"))
    before = set(root.iterdir())
    found = registry.json_roundtrip(spark, str(tmp_path))
    assert "Exchange" not in found._jdf.queryExecution().executedPlan().toString()
    rows = found.collect()
    each = {kind: sorted(str(tuple(r)[1:]) for r in rows if r["format"] == kind) for kind in ("lines", "gzip")}
    assert each["lines"] == each["gzip"] and len(each["lines"]) == len(orders)
    made = [f for folder in set(root.iterdir()) - before for f in folder.rglob("part-*") if folder.name.startswith(("lines", "gzip"))]
    packed = {f: gzip.open(f, "rt").read().splitlines() for f in made if f.name.endswith(".gz")}
    plain = [line for f in made if f.name.endswith(".json") for line in f.read_text().splitlines()]
    assert sorted(plain) == sorted(sum(packed.values(), []))  # both forms are written, whole profiles in each
    assert max(map(len, packed.values())) <= 5
    whole = load_candidates(spark, str(next(iter(packed))), partitions=3)
    assert whole.rdd.getNumPartitions() == 3  # any other gzip file is spread


def test_files_are_listed_once(spark, tmp_path, monkeypatch):
    """Before, they were listed three times and scanned eight times."""
    header = b"candidate_id,rank,score,reasoning\n"
    (tmp_path / "a.csv").write_bytes(header + b'CAND_0000001,1,0.5,"open')
    (tmp_path / "b.csv").write_bytes(header + b"x\xff\ry\rz\xfe\r\n\xc3\rA0\xd0\n")
    (tmp_path / "c.csv").write_bytes(b"")
    (tmp_path / "d.csv").write_bytes(b'\n"x\ny",1\n')
    calls = []
    for name in ("text", "load"):
        monkeypatch.setattr(DataFrameReader, name, lambda self, *a, f=getattr(DataFrameReader, name), **b: calls.append(a) or f(self, *a, **b))
    root = Path(staging_root(spark).removeprefix("file:"))
    before = set(root.iterdir())
    report = check_files(spark, f"{tmp_path}/*.csv", 1)
    assert len(calls) == 1
    assert not [f for f in set(root.iterdir()) - before if f.name.startswith("entered-splits")]  # each file is one split
    got = sorted((r["file"][-5:], r["rule"], r["detail"]) for r in report.filter("rule in ('not_utf8', 'empty_file', 'row_count', 'header')").collect())
    assert got == [("b.csv", "not_utf8", "4 lines"), ("c.csv", "empty_file", "no header row"), ("d.csv", "header", "")]
    rows = {(r["file"][-5:], r["row_num"]): r["reasoning"] or r["candidate_id"] for r in read_ranking_rows(spark, f"{tmp_path}/*.csv").collect()}
    assert rows == {("a.csv", 1): "reasoning", ("a.csv", 2): "open", ("d.csv", 1): None, ("d.csv", 2): "x\ny"}
