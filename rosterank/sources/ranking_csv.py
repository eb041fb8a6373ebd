"""Ranking files: the CSV sink and its strict read-back."""

from __future__ import annotations

import csv
import io
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from rosterank.operators.lookup import join_lookup
from rosterank.schemas import RANKING_COLUMNS
from rosterank.staging import stage


def write_ranking_csv(ranked: DataFrame, path: str, *, by_description: bool = False) -> None:
    """Write header and rows in rank order as one CSV file, or one per description under jd_id=.../.

    A ranking holds at most k rows per description, so one file each is small by construction.
    """
    if by_description:
        placed = ranked.select("jd_id", *RANKING_COLUMNS).repartition("jd_id").sortWithinPartitions("jd_id", "rank")
        writer = placed.write.partitionBy("jd_id")
    else:
        writer = ranked.select(*RANKING_COLUMNS).coalesce(1).sortWithinPartitions("rank").write
    writer.option("header", True).option("escape", '"').option("emptyValue", "").csv(path)


def file_name() -> Column:
    """The scanned file's path with its characters as they are; a plus sign stands for itself in paths."""
    return F.url_decode(F.replace("_metadata.file_path", F.lit("+"), F.lit("%2B")))


#: What a character does to the reader at the start of a field, inside a plain one, inside quotes, and after a quote there.
_FIELD, _PLAIN, _QUOTED, _CLOSED = range(4)


def quoted_after(line: bytes, quoted: bool) -> bool:
    """Whether the reader is inside quotes at the end of a line (and its line feed) that it begins inside or outside of them."""
    if b'"' not in line:
        return quoted
    state = _QUOTED if quoted else _FIELD
    for char in line:
        if state == _QUOTED:
            state = _CLOSED if char == 34 else _QUOTED
        elif char in (44, 13):  # comma, carriage return
            state = _FIELD
        elif char == 34 and state != _PLAIN:
            state = _QUOTED
        else:
            state = _PLAIN
    return state == _QUOTED


def _splits(parts: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, int, list[bytes]]]:
    """(file, start, lines) of each split of a file, one after the other; a task holds the lines of one split."""
    for file, start, _, lines in _sized_splits(parts):
        yield file, start, lines


def _sized_splits(parts: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, int, int | None, list[bytes]]]:
    """``_splits`` with the file's size where the split is all of it."""
    at, lines = None, []
    for part in parts:
        sizes = part.column("whole").to_pylist() if "whole" in part.schema.names else [None] * len(part)
        for file, start, size, line in zip(part.column("file").to_pylist(), part.column("start").to_pylist(), sizes, part.column("line").to_pylist(), strict=True):
            if (file, start, size) != at:
                if at is not None:
                    yield *at, lines
                at, lines = (file, start, size), []
            lines.append(line)
    if at is not None:
        yield *at, lines


def _last_open(lines: list[bytes], quoted: bool) -> tuple[bool, int]:
    """(inside quotes at the end, index of the first line of the record that is open there).

    The index is 0 as well if the record was open before the split, and counts all lines if none is open.
    """
    first = 0
    for n, line in enumerate(lines):
        quoted = quoted_after(line, quoted)
        if not quoted:
            first = n + 1
    return quoted, first


#: Whether a split is all of its file.
WHOLE = "start = 0 AND length >= size"

_PIECES = "file STRING, start BIGINT, bytes BIGINT, open0 BOOLEAN, open1 BOOLEAN, tail0 BINARY, tail1 BINARY, ended1 BOOLEAN"
_PIECES_SCHEMA = pa.schema(
    [
        ("file", pa.string()), ("start", pa.int64()), ("bytes", pa.int64()), ("open0", pa.bool_()), ("open1", pa.bool_()),
        ("tail0", pa.binary()), ("tail1", pa.binary()), ("ended1", pa.bool_()),
    ]
)


def _pieces(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """What each split does to a reader that enters it outside (0) or inside (1) of quotes, and what it leaves open."""
    for file, start, lines in _splits(parts):
        row = {"file": file, "start": start, "bytes": sum(map(len, lines)) + len(lines)}
        for quoted in (0, 1):
            open_, first = _last_open(lines, bool(quoted))
            row |= {f"open{quoted}": open_, f"tail{quoted}": b"\n".join([*lines[first:], b""]) if open_ else b"", "ended1": first > 0}
        yield pa.RecordBatch.from_pylist([row], _PIECES_SCHEMA)


def _resolved(pieces: pa.Table) -> pa.Table:
    """The splits of one file that a record enters, or that the file ends in with a record open; what stands before them."""
    out, quoted, before = [], 0, b""
    rows = sorted(pieces.to_pylist(), key=lambda r: r["start"])
    # a file without a line feed at its end is one byte shorter than its lines with theirs
    bare = sum(r["bytes"] for r in rows) > rows[0]["size"]
    for n, r in enumerate(rows):
        last = n + 1 == len(rows)
        open_ = r[f"open{quoted}"]
        if quoted or (last and open_):
            out.append({"file": r["file"], "start": r["start"], "quoted": bool(quoted), "before": before, "last": last, "bare": bare})
        tail = r[f"tail{quoted}"]
        before = before + tail if quoted and not r["ended1"] else tail
        quoted = int(open_)
    return pa.Table.from_pylist(out, _RESOLVED)


_RESOLVED = pa.schema(
    [("file", pa.string()), ("start", pa.int64()), ("quoted", pa.bool_()), ("before", pa.binary()), ("last", pa.bool_()), ("bare", pa.bool_())]
)


def _rows_of(entered: dict[tuple[str, int], dict]):
    """Parse whole records: a split begins with what records before it left open, and leaves its own open one to the next."""

    def work(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        csv.field_size_limit(1 << 30)
        names = ["file", "start", "place", "n_cells", "blank", *RANKING_COLUMNS]
        kinds = [pa.string(), pa.int64(), pa.int64(), pa.int32(), pa.bool_(), *[pa.string()] * len(RANKING_COLUMNS)]
        for file, start, size, lines in _sized_splits(parts):
            # a file without a line feed at its end is one byte shorter than its lines with theirs
            bare = size is not None and sum(map(len, lines)) + len(lines) > size
            known = entered.get((file, start), {"quoted": False, "before": b"", "last": size is not None, "bare": bare})
            open_, first = _last_open(lines, known["quoted"])
            if open_ and not known["last"]:
                lines = lines[:first]
                if not first:  # all of the split belongs to a record that ends later
                    continue
            whole = known["before"] + b"\n".join([*lines, b""])
            if known["last"] and open_ and known["bare"]:
                whole = whole[:-1]
            found = []
            for place, cells in enumerate(csv.reader(io.StringIO(whole.decode("utf-8", "replace"), newline=""))):
                padded = [*cells, *[None] * len(RANKING_COLUMNS)][: len(RANKING_COLUMNS)]
                found.append((file, start, place, len(cells), not any(cell.strip() for cell in cells), *padded))
            for at in range(0, len(found), 10_000):
                columns = zip(*found[at : at + 10_000], strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=names)

    return work


def file_lines(spark: SparkSession, path: str) -> DataFrame:
    """file, start and length of the split, size of the file, value: the lines of the files under ``path``, from one listing."""
    whole = F.col("_metadata.file_size").alias("size")
    start, length = F.col("_metadata.file_block_start").alias("start"), F.col("_metadata.file_block_length").alias("length")
    return spark.read.option("lineSep", "\n").text(path).select(file_name().alias("file"), start, length, whole, F.col("value"))


def split_facts(lines: DataFrame) -> DataFrame:
    """Written table (file, start, length, size, n_broken) of the splits of ``file_lines``: how many lines are not UTF-8.

    A carriage return ends a line here as well. Lines are taken apart byte by byte, so only those that are not UTF-8.
    """
    spelled = F.split(F.regexp_replace(F.hex("value"), "(..)", "$1 "), "0D ")
    parts = F.filter(spelled, lambda part: ~F.is_valid_utf8(F.unhex(F.replace(part, F.lit(" "), F.lit(""))).cast("string")))
    broken = F.when(~F.is_valid_utf8("value"), F.size(parts)).otherwise(0)
    counted = lines.groupBy("file", "start", "length", "size").agg(F.sum(broken).alias("n_broken"))
    return stage(counted, "split-facts")


def read_ranking_rows(spark: SparkSession, path: str) -> DataFrame:
    """file, row_num, n_cells and the first four cells as text; nothing is lost but rows of blank cells.

    The first physical row of a file is its header whatever it holds, also if it is blank. Quoted line breaks are allowed.
    A file with bytes that are not UTF-8 gives no rows.

    Files of any size are read in splits: each split tells what it does to a reader that enters it outside or inside of
    quotes, a file's splits are put together from that, and then every split parses the records that end in it. Where all
    files are one split each, the first of these two scans is left out.
    """
    lines = file_lines(spark, path)
    return parse_rows(lines, split_facts(lines))


def parse_rows(lines: DataFrame, facts: DataFrame) -> DataFrame:
    """``read_ranking_rows`` of ``file_lines`` and their ``split_facts``."""
    broken = facts.filter("n_broken > 0").select("file").distinct()
    raw = lines.select("file", "start", "length", "size", F.col("value").cast("binary").alias("line"))
    whole = F.expr(WHOLE)
    entered = {}
    if not facts.filter(~whole).isEmpty():
        sizes = facts.groupBy("file").agg(F.max("size").alias("size"))
        pieces = raw.filter(~whole).select("file", "start", "line").mapInArrow(_pieces, _PIECES).join(sizes, "file")
        resolved = pieces.groupBy("file").applyInArrow(_resolved, "file STRING, start BIGINT, quoted BOOLEAN, before BINARY, last BOOLEAN, bare BOOLEAN")
        # only splits that a quoted line break crosses, each with the record so far
        entered = {(r["file"], r["start"]): r.asDict() for r in stage(resolved, "entered-splits").collect()}
    raw = raw.select("file", "start", "line", F.when(whole, F.col("size")).alias("whole"))
    cells = ", ".join(f"`{c}` STRING" for c in RANKING_COLUMNS)
    parsed = raw.mapInArrow(_rows_of(entered), f"file STRING, start BIGINT, place BIGINT, n_cells INT, blank BOOLEAN, {cells}")
    parsed = stage(parsed, "parsed-rows")

    # a file's first row counts whatever it holds; places follow from the rows of the splits before
    counts = parsed.groupBy("file", "start").agg(F.count_if(~F.col("blank")).alias("n"), F.min_by("blank", "place").alias("first"))
    order = Window.partitionBy("file").orderBy("start")
    opens = F.row_number().over(order) == 1
    counts = counts.select("file", "start", opens.alias("opens"), (F.col("n") + (opens & F.col("first")).cast("int")).alias("n"))
    counts = counts.withColumn("earlier", F.sum("n").over(order) - F.col("n"))
    counts = stage(counts.join(broken, "file", "left_anti"), "split-counts")
    kept = join_lookup(parsed, counts, ["file", "start"], spread_by="place")
    kept = kept.filter(~F.col("blank") | (F.col("opens") & (F.col("place") == 0)))
    within = Window.partitionBy("file", "start").orderBy("place")  # the rows of one split
    number = (F.col("earlier") + F.row_number().over(within)).alias("row_num")
    return kept.select("file", number, "n_cells", *RANKING_COLUMNS)
