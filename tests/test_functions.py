import datetime as dt
import random
import unicodedata

import pytest
from pyspark.sql import functions as F
from rosterank import vocab
from rosterank.functions import gates, jd_text, scores
from rosterank.functions.basics import exact_round
from rosterank.functions.texts import fold_accents, strip_marks
from rosterank.plans.jobs import extract_jd_features
from rosterank.plans.pool import honeypot_reasons
from tests.profiles import frame, profile

AS_OF = dt.date(2024, 1, 31)


def test_exact_round_is_the_round_of_python(spark):
    rng = random.Random(7)
    values = [k / 1e5 for k in range(0, 4000)] + [rng.random() for _ in range(4000)] + [0.00525, 0.00015, 2.5e-5]
    df = spark.createDataFrame([(v,) for v in values], "x double")
    for digits in (2, 4, 6):
        got = df.select("x", exact_round(F.col("x"), digits).alias("r")).collect()
        assert [r.r for r in got] == [round(r.x, digits) for r in got]


def test_vocabulary_sizes():
    assert [len(t) for t in (vocab.TIER3, vocab.TIER2, vocab.TIER1)] == [61, 65, 22]
    assert len(vocab.GENERIC_WORDS) == 173 and len(vocab.DISQUALIFIED_TITLES) == 29


@pytest.mark.parametrize(
    ("days", "points"),
    [(-1, 20), (14, 20), (15, 17), (30, 17), (31, 12), (60, 12), (61, 7), (90, 7), (91, 3), (180, 3), (181, 0)],
)
def test_recency_steps(spark, days, points):
    day = str(AS_OF - dt.timedelta(days=days))
    row = spark.createDataFrame([(day,)], "d string").select(scores.recency_points(F.col("d"), AS_OF).alias("p"))
    assert row.first().p == points


def test_behavior_defaults_and_maximum(spark):
    best = profile(
        1, last_active_date="2024-01-30", open_to_work_flag=True, recruiter_response_rate=0.8,
        avg_response_time_hours=4.0, notice_period_days=0, github_activity_score=70.0, interview_completion_rate=0.8,
        verified_email=True, verified_phone=True, applications_submitted_30d=1, saved_by_recruiters_30d=1,
    )
    empty = dict(profile(2), signals=None)
    odd = profile(3, last_active_date="2024-02-30", notice_period_days=91)
    parts = scores.behavior_points(F.col("signals"), AS_OF)
    df = frame(spark, [best, empty, odd]).select("candidate_id", *[c.alias(n) for n, c in parts.items()])
    got = df.select(scores.behavior_multiplier({n: F.col(n) for n in parts}).alias("b")).collect()
    assert [r.b for r in got] == [1.2, 0.22, 0.2]  # notice defaults to 90 days: 2 points


def test_experience_and_seniority(spark):
    df = spark.createDataFrame([(4.0,), (4.9,), (5.0,), (9.0,), (9.1,), (11.0,), (3.0,)], "y double")
    fit = df.select(scores.experience_fit(F.col("y"), F.lit(4), F.lit(11)).alias("f")).collect()
    assert [r.f for r in fit] == [0.65, 0.65, 1.0, 1.0, 0.8, 0.8, 0.4]
    titles = ["Internal Tools Engineer", "Staff Lead", "VP Data", "Senior Engineer", "Engineer", None]
    df = spark.createDataFrame([(t,) for t in titles], "t string")
    assert [r.s for r in df.select(scores.seniority(F.col("t")).alias("s")).collect()] == [0.8, 1.1, 1.05, 1.0, 0.95, 0.95]


def test_title_gate_keeps_substring_hits(spark):
    titles = ["HR", "HR Lead", "Salesforce Developer", "ML Engineer", None]
    df = spark.createDataFrame([(t,) for t in titles], "t string")
    got = [r.b for r in df.select(gates.is_disqualified_title(F.col("t")).alias("b")).collect()]
    assert got == [False, True, True, False, False]


def test_location_gate(spark):
    rows = [
        ("Pune", "India", False, ["pune"], True), ("Austin", "USA", True, ["pune"], True),
        ("Pune", "USA", False, ["pune"], False), ("Kochi", "in", False, ["pune"], False),
        ("Greater Noida", None, None, ["noida"], True), (None, "", False, [], True), (None, "", False, ["pune"], False),
    ]
    df = spark.createDataFrame(rows, "l string, c string, r boolean, t array<string>, want boolean")
    got = df.select("want", gates.passes_location(F.col("l"), F.col("c"), F.col("r"), F.col("t")).alias("got")).collect()
    assert [r.got for r in got] == [r.want for r in got]


def test_honeypot_rules(spark):
    job = ("Engineer", "Acme", "work", "2015-01-01")
    rows = [
        profile(1, yoe=5.0, career=[(*job, 90)]),  # 5 * 12 * 1.4 + 6 = 90: allowed
        profile(2, yoe=5.0, career=[(*job, 91)]),
        profile(3, yoe=0.0, career=[(*job, 500)]),  # no stated experience: rule skipped
        profile(4, skills=[("Python", "expert", 90, 1), ("LangChain", "expert", 13, 1)]),
        profile(5, skills=[("LangChain", "expert", 12, 1)]),
        profile(6, skills=[("Storage Systems", "expert", 37, 1)]),  # "rag" inside "storage"
        profile(7, skills=[(n, "expert", None, 0) for n in "abc"]),
        profile(8, career=[("E", "A", "d", "1989-12-31", 1)]),
        profile(9, career=[("E", "A", "d", "abcd", 1), ("E", "A", "d", None, 1), ("E", "A", "d", "", 1)]),
        profile(10, skills=[("x", "beginner", None, 501)]),  # months default to 12 here
        profile(11, skills=[("x", "beginner", 5, 501)]),
        dict(profile(12), career_history=None, skills=None),
    ]
    got = {int(r.candidate_id[5:]): r.honeypot_reason for r in honeypot_reasons(frame(spark, rows), AS_OF).collect()}
    assert got == {
        2: "Career history (91mo) exceeds stated experience (5.0yr)",
        4: "'LangChain' claimed 13mo but only exists since 2022",
        6: "'Storage Systems' claimed 37mo but only exists since 2020",
        7: "Expert on 3 skills with 0 months each",
        8: "Career start date before 1990",
        11: "Endorsement count inconsistent with usage duration",
    }


def test_jd_features(spark):
    texts = {
        "range": "We want 5-9 years. Noida / Pune. tier-1, bm25, FAISS, Python",
        "plus": "5+ years, python sql java rust scala",
        "minimum": "minimum 3 years",
        "least": "at least 2 yrs",
        "of": "7 years of experience",
        "to": "3 to 5 yrs",
        "none": "no number here",
        "sparse": "aardvark zebra zebra ze-bra",
    }
    rows = {r.jd_id: r for r in extract_jd_features(spark.createDataFrame(list(texts.items()), "jd_id string, text string")).collect()}
    ranges = {k: (r.exp_min, r.exp_max) for k, r in rows.items()}
    assert ranges == {
        "range": (4, 11), "plus": (4, 11), "minimum": (2, 9), "least": (1, 8), "of": (6, 13), "to": (2, 7),
        "none": (3, 12), "sparse": (3, 12),
    }
    assert rows["range"].locations == ["delhi", "greater noida", "gurgaon", "gurugram", "ncr", "noida", "pune"]
    assert rows["plus"].locations == []
    # four named terms are too few, so words of the text follow by frequency
    assert [(w.term, w.weight) for w in rows["range"].skill_weights][:3] == [("bm25", 3.0), ("faiss", 3.0), ("python", 2.0)]
    assert ("tier-1", 1.0) in [(w.term, w.weight) for w in rows["range"].skill_weights]
    # "java" is also inside nothing else here; vocabulary order is tier, then term
    assert [w.term for w in rows["plus"].skill_weights] == ["java", "python", "rust", "scala", "sql"]
    # the hyphenated word is a shaped term of weight 1; "zebra" occurs twice, the most frequent
    assert [(w.term, w.weight) for w in rows["sparse"].skill_weights] == [("zebra", 1.5), ("aardvark", 1.25), ("ze-bra", 1.0)]


def test_combined_weights_cover_the_vocabulary(spark):
    jds = spark.createDataFrame([("a", "python faiss sql java rust tier-1")], "jd_id string, text string")
    combined = extract_jd_features(jds).select(jd_text.combined_weights(F.col("skill_weights")).alias("c")).first().c
    weights = {e.term: e.weight for e in combined}
    assert len(weights) == len(combined) == 148 + 1
    assert (weights["python"], weights["faiss"], weights["kafka"], weights["pytorch"], weights["api"]) == (2.0, 3.0, 2.0, 1.5, 0.5)


def test_skill_total_boundaries(spark):
    levels = jd_text.weight_levels(F.col("terms"))
    rows = [
        ([("python", 2.0), ("faiss", 3.0)], [("Python", "expert", 24)], 2.0 * 1.2),
        ([("python", 2.0)], [("Python", "odd", 3)], 2.0 * 0.6 * 0.3),
        ([("python", 2.0)], [("Python", "advanced", 4)], 2.0 * 1.0 * (4 / 24.0)),
        ([("python", 2.0), ("faiss", 3.0)], [("", "beginner", 25)], 3.0 * 0.4),  # an empty name matches everything
        ([("react", 2.0)], [("React Native", None, None)], 2.0 * 0.6 * 0.3),
        ([("react native", 2.0)], [("act", "intermediate", 48)], 2.0 * 0.7),
        ([("python", 2.0)], [("Excel", "expert", 24)], 0.0),
    ]
    schema = (
        "terms array<struct<term:string,weight:double>>,"
        "skills array<struct<name:string,proficiency:string,duration_months:bigint>>, want double"
    )
    df = spark.createDataFrame(rows, schema).withColumn("levels", levels)
    got = df.select("want", scores.skill_total(F.col("skills"), F.col("levels")).alias("got")).collect()
    assert [r.got for r in got] == [r.want for r in got]


def test_accent_folding_matches_decomposition(spark):
    chars = [chr(c) for c in (*range(0x20, 0xD800), *range(0xF900, 0xFB50), *range(0xFB50, 0xFE00, 7), *range(0x1D400, 0x1D500))]
    rng = random.Random(3)
    mixed = ["".join(rng.choice(chars) for _ in range(60)) for _ in range(300)]
    df = spark.createDataFrame([(c,) for c in [*chars, *mixed, "", "한국어 ﬁnd ½ straße Ǆ"]], "c string")
    for row in df.select("c", fold_accents(F.col("c")).alias("folded")).collect():
        assert row.folded == strip_marks(row.c), row.c
    assert "Python" not in df.select(fold_accents(F.col("c")))._jdf.queryExecution().toString()
