"""Streams against the same work in one batch: relaxation, restarts, versions, a saved vocabulary."""

import datetime as dt
import json
import os
import random

import pytest
from pyspark.errors import StreamingQueryException
from pyspark.sql import functions as F
from rosterank.operators import tfidf
from rosterank.operators.substrings import mutual_substrings
from rosterank.plans import jobs, pool, ranking
from rosterank.streaming import arrivals
from tests.profiles import frame, profile

AS_OF = dt.date(2024, 1, 31)
JD = "{} 5-9 years. FAISS, Pinecone, BM25, Python, embeddings, ranking, semantic search"
PLACES = {"pune": "Pune.", "kochi": "Kochi.", "anywhere": "Remote."}
MIN_POOL, TOP = 20, 15


def people():
    r, names = random.Random(5), ["FAISS", "Python", "Excel", "Pinecone", "BM25", ""]
    rows = []
    for i in range(72):
        some = [(r.choice(names), r.choice(["expert", "beginner", None]), r.randrange(40), 1) for _ in range(r.randrange(4))]
        job = ("Search Engineer", "Acme", r.choice(["Built embeddings", "Shipped ranking", "Ran payroll"]), "2019-01-01", 20)
        where = "Kochi, Kerala" if i % 9 == 0 else "Pune, Maharashtra"
        row = profile(i, yoe=3.0 + i % 10, skills=some, career=[job], location=where, recruiter_response_rate=i % 10 / 10)
        rows.append({**row, "embedding": [r.random() - 0.3 for _ in range(4)]})
    return rows


def arrive(folder, rows, first=0):
    """Six files, a batch each."""
    os.makedirs(folder, exist_ok=True)
    for n in range(6):
        path = f"{folder}/{first + n}.json"
        with open(path, "w") as f:
            f.writelines(json.dumps(r) + "\n" for r in rows[n::6])
        os.utime(path, (1_700_000_000 + first + n,) * 2)


@pytest.fixture(scope="module")
def setting(spark, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("stream") / "in")
    rows = people()
    arrive(folder, rows)
    jds = spark.createDataFrame([(j, JD.format(p), [0.5, 0.1, 0.3, float(k)]) for k, (j, p) in enumerate(PLACES.items())], "jd_id string, text string, embedding array<float>")
    features = jobs.extract_jd_features(jds.select("jd_id", "text")).join(jds.select("jd_id", "embedding"), "jd_id")
    features = jobs.with_weight_levels(features).cache()
    whole = spark.read.schema(arrivals.read_arrivals(spark, folder, embeddings=True).schema).json(folder)
    return folder, whole, features, pool.build_pool(whole, features, AS_OF, MIN_POOL)


def ranked(df):
    return sorted((r["jd_id"], r["rank"], r["candidate_id"], round(r["score"], 9)) for r in df.collect())


def test_scores_settle_into_the_pool(spark, setting, tmp_path):
    folder, _, features, survivors = setting
    scored = arrivals.score_arrivals(arrivals.read_arrivals(spark, folder, files_per_batch=1), features, AS_OF)
    arrivals.append_scores(scored, str(tmp_path / "out"), str(tmp_path / "log")).awaitTermination()
    got = arrivals.settle(spark.read.schema(scored.schema).parquet(str(tmp_path / "out")), MIN_POOL)
    want = pool.pool_pairs(survivors)
    key = lambda df: sorted((r["jd_id"], r["candidate_id"], r["relaxed"]) for r in df.collect())
    assert key(got) == key(want)
    assert {(r["jd_id"], r["relaxed"]) for r in got.collect()} == {("pune", False), ("kochi", True), ("anywhere", False)}


def test_ranking_relaxes_restarts_and_keeps_few_folders(spark, setting, tmp_path):
    """Pune is short of profiles in the first batches, Kochi to the end; the fifth batch fails once half-way."""
    folder, _, features, survivors = setting
    store, log, broken = str(tmp_path / "best"), str(tmp_path / "log"), []
    score = arrivals.dense_scorer(features, AS_OF)

    def failing(matched):
        broken.append(1)
        if len(broken) == 5:
            raise RuntimeError("lost")
        return score(matched)

    def run(scorer):
        stream = arrivals.read_arrivals(spark, folder, embeddings=True, files_per_batch=1)
        arrivals.refresh_ranking(stream, features, AS_OF, store, log, TOP, scorer=scorer, min_pool=MIN_POOL).awaitTermination()

    with pytest.raises(StreamingQueryException):
        run(failing)
    run(None)
    live = arrivals.latest_ranking(spark, store, TOP, MIN_POOL)
    best = ranking.select_top(ranking.score_pool(survivors, features, AS_OF, semantic="dense"), TOP)
    assert ranked(live) == ranked(best)
    assert {r["jd_id"]: r["relaxed"] for r in live.collect()} == {"pune": False, "kochi": True, "anywhere": False}
    slots = [f for f in os.listdir(store) if f.startswith("slot=")]
    assert len(slots) == arrivals.SLOTS and len(os.listdir(f"{store}/log")) == arrivals.SLOTS
    assert max(r["batch"] for r in arrivals._versions(spark, store).collect()) == 5


def test_ranking_under_a_saved_vocabulary(spark, setting, tmp_path):
    folder, _, features, survivors = setting
    texts, saved = ranking.pool_texts(survivors), str(tmp_path / "vocabularies")
    assert tfidf.save_vocabulary(tfidf.fit_vocabulary(texts, features.select("jd_id", "text")), saved) == 1
    assert tfidf.save_vocabulary(tfidf.fit_vocabulary(texts, features.select("jd_id", "text"), 5), saved) == 2
    assert tfidf.vocabulary_versions(spark, saved) == [1, 2]
    first, newest = tfidf.load_vocabulary(spark, saved, 1), tfidf.load_vocabulary(spark, saved)
    assert newest.groupBy("jd_id").count().agg(F.max("count")).first()[0] == 5 < first.count() / 3

    store, log, inbox = str(tmp_path / "best"), str(tmp_path / "log"), str(tmp_path / "in")
    arrive(inbox, people())

    def run(vocabulary, basis):
        stream = arrivals.read_arrivals(spark, inbox, files_per_batch=3)
        scorer = arrivals.tfidf_scorer(features, vocabulary, AS_OF)
        arrivals.refresh_ranking(stream, features, AS_OF, store, log, TOP, scorer=scorer, basis=basis, min_pool=MIN_POOL).awaitTermination()

    run(first, "1")
    similar = tfidf.fixed_similarity(texts, first).select("jd_id", F.col("text_id").alias("candidate_id"), "semantic")
    rows = ranking.profile_scores(survivors, features, AS_OF).join(similar, ["jd_id", "candidate_id"])
    best = ranking.select_top(ranking.with_composite(ranking.pool_scores(survivors, features, rows)), TOP)
    assert ranked(arrivals.latest_ranking(spark, store, TOP, MIN_POOL)) == ranked(best)
    arrive(inbox, [{**r, "candidate_id": "CAND_9" + r["candidate_id"][6:]} for r in people()], first=10)
    with pytest.raises(StreamingQueryException, match="use another store"):
        run(newest, "2")


def test_large_sets_of_descriptions_score_alike(spark, setting, monkeypatch):
    """Weights beyond the broadcast bound are gathered per set; the similarities are the same."""
    _, _, features, survivors = setting
    texts, jds = ranking.pool_texts(survivors), features.select("jd_id", "text")
    found = []
    for bound, small in ((1_000_000, False), (3, True), (3, False)):
        monkeypatch.setattr(tfidf, "MAX_BROADCAST_ROWS", bound)
        monkeypatch.setattr(tfidf, "_sets_are_small", lambda sets, small=small: small)
        rows = tfidf.tfidf_similarity(texts, jds).collect()
        found.append(sorted((r["jd_id"], r["text_id"], round(r["similarity"], 12), r["semantic"]) for r in rows))
    assert found[0] == found[1] == found[2] and len(found[0]) > 100


def test_mutual_substrings_against_all_pairs(spark):
    r = random.Random(2)
    word = lambda: "".join(r.choice("abç") for _ in range(r.randrange(7)))
    names, terms = sorted({word() for _ in range(80)} | {"", "a" * 40}), sorted({word() for _ in range(60)} | {"cabab"} - {""})
    got = mutual_substrings(spark.createDataFrame([(n,) for n in names], "name string"), spark.createDataFrame([(t,) for t in terms], "term string"))
    want = sorted((n, t) for n in names for t in terms if n and t and (n in t or t in n))
    assert sorted(map(tuple, got.collect())) == want
    nothing = spark.createDataFrame([], "term string")
    assert mutual_substrings(spark.createDataFrame([("a",)], "name string"), nothing).count() == 0


def test_the_gate_is_the_reason_without_words(spark):
    from rosterank.functions import gates

    rows = [
        profile(1), profile(2, yoe=1.0, career=[("E", "A", "d", "2019-01-01", 40)]), profile(3, skills=[("QLoRA", "expert", 30, 1)]),
        profile(4, skills=[("a", "expert", 0, 1)] * 3), profile(5, skills=[("a", "expert", None, 1)] * 2),
        profile(6, career=[("E", "A", "d", "1989-01-01", 4)]), profile(7, career=[("E", "A", "d", "n/a", 4)]),
        profile(8, skills=[("a", "expert", 5, 501)]), profile(9, skills=[("a", "expert", None, 501)]), profile(10, yoe=None),
    ]
    args = F.col("skills"), F.col("career_history"), F.col("profile.years_of_experience"), AS_OF
    empty = frame(spark, rows).withColumn("skills", F.lit(None).cast("array<struct<name:string,proficiency:string,duration_months:bigint,endorsements:bigint>>"))
    for df in (frame(spark, rows), empty):
        got = df.select(gates.is_honeypot(*args).alias("trap"), gates.honeypot_reason(*args).alias("why")).collect()
        assert [r.trap for r in got] == [r.why is not None for r in got]
    assert sum(r.why is not None for r in frame(spark, rows).select(gates.honeypot_reason(*args).alias("why")).collect()) == 5
