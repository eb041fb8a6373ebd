"""Gating by signatures against the plain gates, one profile and one description at a time."""

import datetime as dt
import math
import random

from pyspark.sql import functions as F
from rosterank.plans import gate_index, pool
from tests.profiles import frame, profile

AS_OF = dt.date(2024, 1, 31)
CITIES = ["noida", "greater noida", "pune", "kochi", "delhi"]
FEATURES = "jd_id string, exp_min bigint, exp_max bigint, locations array<string>"


def described(n, seed=1):
    r = random.Random(seed)
    rows = []
    for i in range(n):
        low = r.randrange(14)
        high = r.choice([low, low + 1, low + r.randrange(9), 12, 10**15 + 6])
        rows.append((f"jd{i:05d}", low, high, sorted(r.sample(CITIES, r.randrange(4)))))
    return rows


def peopled(n, seed=2):
    r = random.Random(seed)
    places = ["Noida, UP", "Greater Noida", "Pune and Kochi", "Austin", "", None, "New Delhi"]
    rows = []
    for i in range(n):
        yoe = r.choice([None, float(r.randrange(15)), r.random() * 14, 0.0, 5.5, -1.0, 1e18])
        title = "HR Manager" if i % 11 == 0 else "ML Engineer"
        skills = [("QLoRA", "expert", 90, 1)] if i % 7 == 0 else []
        rows.append(profile(i, yoe=yoe, title=title, location=r.choice(places), country=r.choice(["India", "USA", None]), relocate=r.choice([True, False, None]), skills=skills))
    return rows


def brute(rows, descriptions, use_location=True):
    found = {}
    for i, p in enumerate(rows):
        who = p["profile"]
        yoe, place = who["years_of_experience"] or 0.0, (who["location"] or "").lower()
        ids = []
        for jd, low, high, cities in descriptions:
            home = (who["country"] or "").lower() in ("india", "in", "")
            here = p["signals"]["willing_to_relocate"] or not cities or (home and any(c in place for c in cities))
            if low <= yoe <= high and (here or not use_location):
                ids.append(jd)
        if ids and i % 11 and i % 7:
            found[p["candidate_id"]] = sorted(ids)
    return found


def test_blocks_make_up_their_range(spark):
    r = random.Random(6)
    ranges = [(0, 0), (1, 1), (0, 12), (5, 4), (7, 1 << 40), *[(a, a + r.randrange(70)) for a in (r.randrange(90) for _ in range(200))]]
    df = spark.createDataFrame(ranges, "a bigint, b bigint").select("a", "b", gate_index._blocks(F.col("a"), F.col("b")).alias("found"))
    for row in df.collect():
        spans = sorted((x.block << x.size, (x.block + 1) << x.size) for x in row.found)
        if row.a <= row.b:
            assert spans[0][0] == row.a and spans[-1][1] == row.b + 1
            assert all(x[1] == y[0] for x, y in zip(spans, spans[1:]))  # noqa: B905
            assert len(spans) <= 2 * math.ceil(math.log2(row.b - row.a + 2))
        else:
            assert not spans


def test_signatures_pass_what_profiles_pass(spark, monkeypatch):
    monkeypatch.setattr(pool, "MAX_DESCRIPTIONS", 10)
    rows, descriptions = peopled(400), described(300)
    people, features = frame(spark, rows), spark.createDataFrame(descriptions, FEATURES)
    for use in (True, False):
        got = pool.gate_profiles(people, features, AS_OF, use_location=use)
        assert got.columns == [*people.columns, "jd_ids"]
        assert {r["candidate_id"]: r["jd_ids"] for r in got.collect()} == brute(rows, descriptions, use)


def test_ten_thousand_descriptions(spark):
    rows, descriptions = peopled(60, seed=8), described(10_000, seed=9)
    features = spark.createDataFrame(descriptions, FEATURES)
    got = pool.gate_profiles(frame(spark, rows), features, AS_OF)
    assert {r["candidate_id"]: r["jd_ids"] for r in got.collect()} == brute(rows, descriptions)
    counts = {r["jd_id"]: r for r in pool.drop_counts(frame(spark, rows), features, AS_OF).collect()}
    assert len(counts) == 10_000
    passing = brute(rows, descriptions)
    surviving = {jd: 0 for jd, *_ in descriptions}
    for ids in passing.values():
        for jd in ids:
            surviving[jd] += 1
    assert {jd: r["surviving"] for jd, r in counts.items()} == surviving
    assert all(sum(r[c] for c in r.asDict() if c.startswith("dropped")) + r["surviving"] == r["processed"] == 60 for r in counts.values())


def test_nothing_to_gate(spark):
    features = spark.createDataFrame(described(3), FEATURES)
    assert pool.drop_counts(frame(spark, []), features, AS_OF).count() == 0
    assert pool.gate_profiles(frame(spark, peopled(5)), features.limit(0), AS_OF).count() == 0


def test_pools_and_counts_from_one_scan(spark):
    rows, descriptions = peopled(300, seed=4), described(40, seed=5)
    people, features = frame(spark, rows), spark.createDataFrame(descriptions, FEATURES)
    found, counts = pool.pool_with_counts(people, features, AS_OF, 30)
    key = lambda df: sorted((r["candidate_id"], r["jd_id"], r["relaxed"]) for r in pool.pool_pairs(df).collect())
    assert key(found) == key(pool.build_pool(people, features, AS_OF, 30))
    assert sorted(map(str, counts.collect())) == sorted(map(str, pool.drop_counts(people, features, AS_OF).collect()))
    assert {r["candidate_id"]: r["profile"] for r in found.collect()} == {r["candidate_id"]: r["profile"] for r in people.collect() if r["candidate_id"] in {x["candidate_id"] for x in found.collect()}}


def test_short_pools_are_told_or_refused(spark):
    import pytest
    from rosterank import ShortPoolError, pool_status, rank_candidates

    rows = peopled(300, seed=4)
    jds = spark.createDataFrame([("many", "0 to 40 years. Python"), ("few", "13 to 13 years. Kochi"), ("none", "30+ years")], "jd_id string, text string")
    from rosterank.plans import jobs

    features = jobs.extract_jd_features(jds)
    people = frame(spark, rows)
    status = {r["jd_id"]: r for r in pool_status(pool.build_pool(people, features, AS_OF), features).collect()}
    assert status["many"]["enough"] and not status["many"]["relaxed"] and status["many"]["pooled"] >= 100
    assert status["few"]["relaxed"] and not status["few"]["enough"] and 0 < status["few"]["pooled"] < 100
    assert (status["none"]["pooled"], status["none"]["enough"]) == (0, False)
    with pytest.raises(ShortPoolError, match="few .*none"):
        rank_candidates(people, jds, AS_OF, allow_short=False)


def test_malformed_records_are_split_off(spark, tmp_path):
    from rosterank import load_candidates, split_malformed

    (tmp_path / "a.jsonl").write_text('{"candidate_id": "CAND_0000001"}\n{"candidate_id": \n\nnot JSON\n{"profile": {"location": "Pune"}}\n')
    sound, others = split_malformed(load_candidates(spark, str(tmp_path / "a.jsonl"), keep_malformed=True))
    assert [r["candidate_id"] for r in sound.collect()] == ["CAND_0000001"] and "_corrupt_record" not in sound.columns
    raw = sorted(r["raw"] for r in others.collect())
    assert len(raw) == 3 and raw[0] == "not JSON" and any("Pune" in r for r in raw)
