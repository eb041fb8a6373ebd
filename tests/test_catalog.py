"""The derived fixtures use their whole tables, and files with faults read like a strict line-by-line reader."""

from pathlib import Path

import pytest
from pyspark.sql import functions as F

from catalog import adapter, registry
from rosterank import check_files, read_ranking_rows, vocab

SF = Path("/root/testdata/sf0.001")
needs_tables = pytest.mark.skipif(not SF.exists(), reason="driver tables not present")
HEADER = "candidate_id,rank,score,reasoning"


@needs_tables
def test_every_event_reaches_a_profile(spark):
    orders = adapter.table(spark, str(SF), "orders")
    users = adapter.table(spark, str(SF), "events").select("user_id").distinct()
    top = users.agg(F.max("user_id")).first()[0] + 1
    met = orders.select((F.col("o_orderkey") % (top + top // 8)).alias("user_id")).distinct()
    assert users.join(met, "user_id", "left_anti").count() == 0


@needs_tables
def test_expert_without_use_is_found(spark):
    reasons = registry.honeypot_reasons(spark, str(SF))
    assert reasons.where(F.col("honeypot_reason").startswith("Expert on")).count() > 0


def _rows(n):
    return [f"CAND_{i:07d},{i},0.5,text" for i in range(1, n + 1)]


@pytest.mark.parametrize(
    ("content", "rules"),
    [
        ("\n".join([HEADER, *_rows(100)]), set()),
        ("\r\n".join([HEADER, *_rows(100), "", "  ", ", ,\t,", ""]), set()),
        ("\n".join(["", HEADER, *_rows(100)]), {"header", "row_count", "id_format", "rank_not_integer", "score_not_number"}),
        ("\n".join([HEADER, '","', *_rows(100)]), {"row_count", "cell_count"}),
        ("\n".join([HEADER, *_rows(99)]), {"row_count", "rank_missing"}),
        ("\n".join([HEADER, *_rows(99), 'CAND_0000100,100,0.5,"two\nlines, ""quoted"""']), set()),
        ("\n".join([HEADER, *_rows(99), 'CAND_0000100,100,0.5,te"xt']), set()),
        ("", {"empty_file"}),
    ],
)
def test_files_are_read_without_loss(spark, tmp_path, content, rules):
    (tmp_path / "team.csv").write_bytes(content.encode())
    assert {r["rule"] for r in check_files(spark, f"{tmp_path}/*.csv").collect()} == rules


def test_several_files_at_once(spark, tmp_path):
    (tmp_path / "a.csv").write_text("\n".join([HEADER, *_rows(100)]))
    (tmp_path / "b.csv").write_bytes(b"\xff\n")
    (tmp_path / "c.csv").write_text("\n".join(["x", *_rows(100)]))
    found = {(r["file"][-5:], r["rule"]) for r in check_files(spark, f"{tmp_path}/*.csv").collect()}
    assert found == {("b.csv", "not_utf8"), ("c.csv", "header")}
    assert read_ranking_rows(spark, f"{tmp_path}/*.csv").groupBy("file").count().count() == 2


def test_fixed_words_by_literal_values():
    assert ("pytorch", 2016) in vocab.TECH_BIRTH_YEARS and len(vocab.TECH_BIRTH_YEARS) == 27
    assert "hr " in vocab.DISQUALIFIED_TITLES and "hr" in vocab.NON_TECH_ROLES
    assert {"pinecone", "retrieval augmented generation", "nodejs"} <= set(vocab.TIER3)
    assert {"a/b testing", "c++", "deep learning"} <= set(vocab.TIER2) and {"ci/cd", "tokenizer"} <= set(vocab.TIER1)
