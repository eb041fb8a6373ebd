"""Ranking files read in many small splits, against the standard reader on the whole file."""

import csv
import io
import random
import re

import pytest
from rosterank import check_files, read_ranking_rows


def standard(text):
    rows = []
    for cells in csv.reader(io.StringIO(text, newline="")):
        if not rows or any(c.strip() for c in cells):
            rows.append((len(rows) + 1, len(cells), *[*cells, None, None, None, None][:4]))
    return rows


def random_file(r):
    cell = lambda: "".join(r.choice(['a', 'é', ' ', '"', '""', ',', '\n', '\r', '\r\n', '"x\ny"', "long" * r.randrange(9)]) for _ in range(r.randrange(5)))
    tidy = lambda c: '"' + c.replace('"', '""') + '"'
    out = []
    for _ in range(r.randrange(1, 25)):
        row = [cell() for _ in range(r.randrange(1, 6))]
        out.append(",".join(tidy(c) if r.random() < 0.8 else c.replace("\n", " ") for c in row) if r.random() < 0.9 else r.choice(["", " ,, ", '" \n "', "\t"]))
    return r.choice(["\n", "\r\n"]).join(out) + r.choice(["", "\n", "\n\n", '"open to the end', '"open\n'])


@pytest.fixture
def tiny_splits(spark):
    names = ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")
    before = [spark.conf.get(n) for n in names]
    for n, v in zip(names, ("61", "1"), strict=True):
        spark.conf.set(n, v)
    yield
    for n, v in zip(names, before, strict=True):
        spark.conf.set(n, v)


def test_splits_give_the_rows_of_the_whole_file(spark, tmp_path, tiny_splits):
    r, want = random.Random(11), {}
    for n in range(15):
        text = random_file(r)
        (tmp_path / f"{n}.csv").write_bytes(text.encode())
        want[n] = standard(text)
    (tmp_path / "40.csv").write_bytes(b"a,b\n\xff,c\n")
    (tmp_path / "41.csv").write_bytes(b"")
    (tmp_path / "42.csv").write_bytes(b"\n \n,\na\n")
    want[42] = standard("\n \n,\na\n")
    got = {n: [] for n in want}
    for row in read_ranking_rows(spark, f"{tmp_path}/*.csv").collect():
        file, *rest = tuple(row)
        got[int(re.search(r"(\d+)\.csv$", file)[1])].append(tuple(rest))
    assert {n: sorted(rows, key=lambda x: x[0]) for n, rows in got.items()} == want
    assert sum(any("\n" in (c or "") for c in row[2:]) for rows in want.values() for row in rows) > 8


def test_names_with_blanks_and_signs(spark, tmp_path):
    folder = tmp_path / "middle east +1 50%"
    folder.mkdir()
    lines = ["candidate_id,rank,score,reasoning", *(f"CAND_{i:07d},{i},{1 - i / 1000},text" for i in range(1, 101))]
    (folder / "a b.csv").write_text("\n".join(lines))
    (folder / "c+d.csv").write_text("")
    pattern = f"{tmp_path}/*/*.csv"
    assert {r["file"].rpartition("/")[2] for r in read_ranking_rows(spark, pattern).collect()} == {"a b.csv"}
    found = [(r["rule"], r["file"].rpartition(str(tmp_path))[2]) for r in check_files(spark, pattern).collect()]
    assert found == [("empty_file", "/middle east +1 50%/c+d.csv")]
