"""Checks on ranking files: every rule is a filter, an aggregation or an ordered-neighbour comparison."""

from __future__ import annotations

from urllib.parse import unquote

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rosterank.operators.lookup import join_lookup
from rosterank.operators.neighbours import with_next
from rosterank.schemas import RANKING_COLUMNS
from rosterank.sources.ranking_csv import file_lines, parse_rows, split_facts
from rosterank.staging import stage

EXPECTED_ROWS = 100
ID_SHAPE = "^CAND_[0-9]{7}$"
INTEGER = "^(0|-?[1-9][0-9]*)$"
DIGITS = "[0-9](_?[0-9])*"
NUMBER = rf"^[+-]?({DIGITS}(\.({DIGITS})?)?|\.{DIGITS})([eE][+-]?{DIGITS})?$"
SPECIAL = "^[+-]?(nan|inf|infinity)$"


def _float(value: Column) -> Column:
    low = F.lower(value)
    plain = F.when(value.rlike(NUMBER), F.replace(value, F.lit("_"), F.lit("")).try_cast("double"))
    special = (
        F.when(low.contains("nan"), F.lit(float("nan")))
        .when(low.startswith("-"), F.lit(float("-inf")))
        .otherwise(F.lit(float("inf")))
    )
    return F.coalesce(plain, F.when(low.rlike(SPECIAL), special))


def _report(df: DataFrame, rule: str, detail: Column, row_num: Column | None = None) -> DataFrame:
    row = F.lit(None).cast("bigint") if row_num is None else row_num
    return df.select("file", F.lit(rule).alias("rule"), row.alias("row_num"), detail.alias("detail"))


def _repeats(rows: DataFrame, column: str) -> DataFrame:
    """Second and later rows of a value within a file. Only repeated values are joined back."""
    repeated = stage(
        rows.select("file", column, "row_num")
        .repartition("file", column)  # nearly all values differ: combining them before the shuffle would hold a whole scan
        .groupBy("file", column)
        .agg(F.min("row_num").alias("first_row"), F.count(F.lit(1)).alias("n"))
        .filter(F.col("n") > 1)
        .drop("n"),
        "repeated",
    )
    return join_lookup(rows, repeated, ["file", column], spread_by="row_num").filter(
        F.col("row_num") > F.col("first_row")
    )


def violations(rows: DataFrame, expected_rows: int = EXPECTED_ROWS) -> DataFrame:
    """(file, rule, row_num, detail); empty means valid. ``row_num`` is NULL for rules about a whole file.

    ``rows``: file, row_num (header 1, data from 2), n_cells and the four cells as strings.
    """
    header = rows.filter(F.col("row_num") == 1)
    data = rows.filter(F.col("row_num") > 1)
    exact = F.lit(True)
    for name in RANKING_COLUMNS:
        exact = exact & F.col(name).eqNullSafe(F.lit(name))
    bad_header = header.filter(~(exact & (F.col("n_cells") == len(RANKING_COLUMNS))))

    per_file = rows.groupBy("file").agg(F.count_if(F.col("row_num") > 1).alias("n"))
    wide = data.filter(F.col("n_cells") != len(RANKING_COLUMNS))

    def cell(name: str) -> Column:
        return F.trim(F.coalesce(F.col(name), F.lit("")))

    well_shaped = data.filter(F.col("n_cells") == len(RANKING_COLUMNS))
    cells = well_shaped.select(
        "file", "row_num", cell("candidate_id").alias("cid"), cell("rank").alias("rank_text"), cell("score").alias("score_text")
    )
    parsed = stage(
        cells.withColumn("rank", F.when(F.col("rank_text").rlike(INTEGER), F.col("rank_text").try_cast("decimal(38,0)")))
        .withColumn("score", _float(F.col("score_text")))
        .withColumn("id_ok", F.col("cid").rlike(ID_SHAPE))
        .withColumn("rank_ok", F.coalesce(F.col("rank").between(1, expected_rows), F.lit(False))),
        "ranking-rows",
    )
    row = F.col("row_num")
    ranked = parsed.filter(F.col("rank_ok"))
    missing = (
        rows.select("file")
        .distinct()
        .withColumn("place", F.explode(F.sequence(F.lit(1), F.lit(expected_rows))))
        .select("file", F.col("place").cast("decimal(38,0)").alias("rank"))
        .join(ranked.select("file", "rank").repartition("file", "rank").distinct(), ["file", "rank"], "left_anti")
    )
    comparable = parsed.filter(F.col("rank").isNotNull() & F.col("score").isNotNull() & (F.col("cid") != ""))
    led = with_next(
        comparable.select("file", "rank", "row_num", "score", "cid"),
        "file",
        ["rank", "row_num"],
        ["rank", "score", "cid"],
    )
    numbers = ~F.isnan("score") & ~F.isnan("next_score")
    pair = F.concat(F.col("rank").cast("string"), F.lit(" and "), F.col("next_rank").cast("string"))
    reports = [
        _report(bad_header, "header", F.concat_ws(",", *RANKING_COLUMNS), row),
        _report(per_file.filter(F.col("n") != expected_rows), "row_count", F.col("n").cast("string")),
        _report(wide, "cell_count", F.col("n_cells").cast("string"), row),
        _report(parsed.filter(F.col("cid") == ""), "id_missing", F.lit(""), row),
        _report(parsed.filter((F.col("cid") != "") & ~F.col("id_ok")), "id_format", F.col("cid"), row),
        _report(_repeats(parsed.filter("id_ok"), "cid"), "id_repeated", F.col("cid"), row),
        _report(parsed.filter(F.col("rank").isNull()), "rank_not_integer", F.col("rank_text"), row),
        _report(parsed.filter(F.col("rank").isNotNull() & ~F.col("rank_ok")), "rank_range", F.col("rank_text"), row),
        _report(_repeats(ranked, "rank"), "rank_repeated", F.col("rank_text"), row),
        _report(parsed.filter(F.col("score").isNull()), "score_not_number", F.col("score_text"), row),
        _report(missing, "rank_missing", F.col("rank").cast("string")),
        _report(led.filter(numbers & (F.col("score") < F.col("next_score"))), "score_order", pair, row),
        _report(
            led.filter(numbers & (F.col("score") == F.col("next_score")) & (F.col("cid") > F.col("next_cid"))),
            "tie_order",
            pair,
            row,
        ),
    ]
    united = reports[0]
    for report in reports[1:]:
        united = united.unionByName(report)
    return united


def check_files(spark: SparkSession, path: str, expected_rows: int = EXPECTED_ROWS) -> DataFrame:
    """All rules on the ranking files under ``path``: names, emptiness, encoding, then ``violations``."""
    # A scan skips files without content, so names come from the file listing and the empty ones are what is left. Files are
    # listed once and scanned twice, for facts of whole files and for their rows: with many small files that is the time.
    lines = file_lines(spark, path)
    facts = split_facts(lines)
    files = spark.createDataFrame([(unquote(f),) for f in lines.inputFiles()], "file STRING")
    key = F.regexp_replace("file", "^([a-z0-9]+):/+", "$1:/")  # the two sources write "file:/" differently
    filled = facts.select(key.alias("key")).distinct()
    named = _report(files.filter(~F.lower("file").endswith(".csv")), "file_name", F.lit("not a .csv file"))
    empty = _report(files.withColumn("key", key).join(filled, "key", "left_anti"), "empty_file", F.lit("no header row"))
    broken = facts.groupBy("file").agg(F.sum("n_broken").alias("n")).filter("n > 0")
    encoding = _report(broken, "not_utf8", F.concat(F.col("n").cast("string"), F.lit(" lines")))
    # every rule reads the rows: they are parsed once and written
    found = violations(stage(parse_rows(lines, facts), "ranking-cells"), expected_rows)
    unreadable = broken.select("file")
    return named.unionByName(empty).unionByName(encoding).unionByName(found.join(unreadable, "file", "left_anti"))
