"""Light registered queries against their SQL at the smallest scale (the driver compares all of them)."""

from pathlib import Path

import pytest

from catalog.oracle import all_oracles
from catalog.registry import all_queries

SF = Path("/root/testdata/sf0.001")
LIGHT = ["gate_drop_counts", "honeypot_reasons", "jd_experience", "jd_skill_weights", "skill_score", "final_ranking", "output_violations"]


def test_every_oracle_has_a_query():
    assert set(all_oracles()) <= set(all_queries())


@pytest.mark.skipif(not SF.exists(), reason="driver tables not present")
@pytest.mark.parametrize("name", LIGHT)
def test_query_equals_sql(spark, name):
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for path in SF.glob("*.parquet"):
        con.execute(f"CREATE VIEW {path.stem} AS SELECT * FROM '{path}'")
    df = all_queries()[name](spark, str(SF))
    cursor = con.execute(all_oracles()[name])
    names = [d[0] for d in cursor.description]
    assert sorted(names) == sorted(df.columns)
    want = sorted(map(str, cursor.fetchall()))
    assert sorted(str(tuple(r)) for r in df.select(*names).collect()) == want
