"""Profiles, descriptions and ranking files derived from the driver tables.

Every order is one profile. Its nested fields are computed from the order's own columns (and the aggregated
events of a user), so a profile is complete in its row: no group of rows is ever collected into one.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from catalog import phrases
from rosterank.functions.basics import literal

AS_OF = dt.date(2024, 1, 31)
SPREAD_ROWS = 200_000
GROUPED_ROWS = 50_000  # profiles of a task that holds whole groups of them as text


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """Use all cores for a table whose file has fewer splits than there are cores, and tasks of at most SPREAD_ROWS rows on
    average, because what is derived from a row can be a hundred times as large; scans with enough splits stay as they are."""
    wanted = max(df.sparkSession.sparkContext.defaultParallelism, -(-df.count() // SPREAD_ROWS))
    return df if df.rdd.getNumPartitions() >= wanted else df.repartition(wanted)


def pick(values: Sequence[str | None], index: Column) -> Column:
    return F.get(literal(list(values), "array<string>"), (index % len(values)).cast("int"))


def signals_by_user(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events")
    good = F.col("event_type").isin("click", "purchase")
    return events.groupBy("user_id").agg(
        (F.count_if(good) / F.count(F.lit(1))).alias("rrr"),
        F.count_if(F.col("event_type") == "signup").alias("apps"),
        F.count_if(F.col("event_type") == "view").alias("saves"),
    )


def _career(k: Column, c: Column, p: Column, day: Column) -> Column:
    def job(i: Column) -> Column:
        start = (
            F.when(k % 997 == 0, F.lit("1985-01-01"))
            .when(k % 991 == 0, F.lit("n/a"))
            .when(k % 89 == 0, F.lit(None).cast("string"))
            .otherwise(F.date_format(F.date_sub(day, (i * 400).cast("int")), "yyyy-MM-dd"))
        )
        return F.struct(
            pick(phrases.ROLES, c + i * 3).alias("title"),
            pick(phrases.COMPANIES, k + i).alias("company"),
            pick(phrases.DUTIES, k + i * 3).alias("description"),
            start.alias("start_date"),
            F.when((k + i) % 41 != 0, (p + i * 17) % 30 + 6).alias("duration_months"),
        )

    jobs = F.transform(F.sequence(F.lit(0).cast("bigint"), c % 5), job)
    empty = F.filter(jobs, lambda j: F.lit(False))
    return F.when(c % 13 == 0, empty).when(c % 13 != 1, jobs)


def _skills(k: Column, c: Column, p: Column) -> Column:
    def skill(i: Column) -> Column:
        idle = k % 101 == 0  # expert on everything, used never
        level = F.when(idle, "expert").otherwise(pick(phrases.LEVELS, k + i))
        return F.struct(
            pick(phrases.SKILLS, k + i * 5 + c).alias("name"),
            level.alias("proficiency"),
            F.when(idle, F.lit(0).cast("bigint"))
            .when(k % 7 == 0, F.when((k + i) % 2 == 0, F.lit(0).cast("bigint")))
            .otherwise((p + i * 11) % 60)
            .alias("duration_months"),
            ((k * 13 + i * 101) % 620).alias("endorsements"),
        )

    return F.when(c % 17 != 0, F.transform(F.sequence(F.lit(0).cast("bigint"), c % 9), skill))


def candidates(spark: SparkSession, sf_dir: str, *, summaries: bool = False, embeddings: bool = False, together: int | None = None) -> DataFrame:
    """One profile per order. ``summaries`` adds a whole document as summary, ``embeddings`` a vector.

    ``together`` puts the profiles of so many consecutive order keys into one task, with their number as ``file``: orders are
    moved before profiles, which are twenty times as large, are made of them.
    """
    orders = spread(table(spark, sf_dir, "orders"))
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    p = F.floor("o_totalprice")
    day = F.to_date("o_orderdate")
    active = (
        F.when(k % 83 == 0, F.lit("unknown"))
        .when(k % 79 == 0, F.lit("2024-03-01"))
        .when(k % 71 != 0, F.date_format(F.date_sub(F.lit(AS_OF), (p % 220).cast("int")), "yyyy-MM-dd"))
    )
    # Order keys are dealt over all users and an eighth more numbers: every user meets orders, some orders meet no user.
    numbers = table(spark, sf_dir, "events").agg((F.max("user_id") + 1 + F.floor((F.max("user_id") + 1) / 8))).scalar()
    rows = orders.join(signals_by_user(spark, sf_dir), k % numbers == F.col("user_id"), "left")
    summary = F.lit(None).cast("string")
    if summaries:
        texts = table(spark, sf_dir, "documents").select("doc_id", F.col("text").alias("_summary"))
        n_texts = table(spark, sf_dir, "documents").agg(F.count(F.lit(1))).scalar()
        rows = rows.join(texts, k % n_texts == F.col("doc_id"), "left")
        summary = F.col("_summary")
    extra = []
    if embeddings:
        vectors = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
        n_vectors = table(spark, sf_dir, "embeddings").agg(F.count(F.lit(1))).scalar()
        rows = rows.join(vectors, k % n_vectors == F.col("vec_id"), "left")
        extra = [F.col("embedding")]
    if together:
        tasks = max(spark.sparkContext.defaultParallelism, -(-orders.count() // GROUPED_ROWS))
        rows = rows.withColumn("file", F.floor(k / together)).repartition(tasks, "file")
        extra = [*extra, F.col("file")]
    signals = F.struct(
        F.when(k % 5 != 1, k % 5 == 0).alias("willing_to_relocate"),
        active.alias("last_active_date"),
        (F.col("o_orderstatus") == "O").alias("open_to_work_flag"),
        F.col("rrr").alias("recruiter_response_rate"),
        F.when(k % 31 != 0, (p % 100).cast("double")).alias("avg_response_time_hours"),
        F.when(k % 29 != 0, k * 37 % 6 * 30).alias("notice_period_days"),
        F.when(k % 23 != 0, (p % 103 - 1).cast("double")).alias("github_activity_score"),
        (c % 11 / F.lit(10.0)).alias("interview_completion_rate"),
        (k % 2 == 0).alias("verified_email"),
        (k % 3 == 0).alias("verified_phone"),
        F.col("apps").alias("applications_submitted_30d"),
        F.col("saves").alias("saved_by_recruiters_30d"),
    )
    return rows.select(
        F.format_string("CAND_%07d", k).alias("candidate_id"),
        F.struct(
            F.when(k % 59 != 0, p % 131 / F.lit(10.0)).alias("years_of_experience"),
            pick(phrases.TITLES, c).alias("current_title"),
            pick(phrases.COMPANIES, c).alias("current_company"),
            pick(phrases.PLACES, k * 7 + c).alias("location"),
            pick(phrases.COUNTRIES, c).alias("country"),
            F.concat(pick(phrases.TITLES, c), F.lit(" "), F.col("o_orderpriority")).alias("headline"),
            summary.alias("summary"),
        ).alias("profile"),
        _career(k, c, p, day).alias("career_history"),
        _skills(k, c, p).alias("skills"),
        F.when(k % 37 != 0, signals).alias("signals"),
        *extra,
    )


def region_jds(spark: SparkSession, sf_dir: str) -> DataFrame:
    region = table(spark, sf_dir, "region")
    return region.select(
        F.concat(F.lit("JD_"), "r_name").alias("jd_id"), pick(phrases.REGION_JDS, F.col("r_regionkey")).alias("text")
    )


def region_jds_with_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The vector of a region's description is that of the embedding with the region's key."""
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    region = table(spark, sf_dir, "region")
    return region.join(vectors, F.col("r_regionkey") == F.col("vec_id")).select(
        F.concat(F.lit("JD_"), "r_name").alias("jd_id"),
        pick(phrases.REGION_JDS, F.col("r_regionkey")).alias("text"),
        "embedding",
    )


def nation_jds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One description per nation; with the smaller tables some have less than a pool of located profiles."""
    n = F.col("n_nationkey")
    parts = [pick(phrases.NATION_YEARS, n), pick(phrases.NATION_PLACES, F.floor(n / 5)), pick(phrases.NATION_TERMS, n)]
    return table(spark, sf_dir, "nation").select(
        F.concat(F.lit("JD_"), "n_name").alias("jd_id"), F.concat_ws(" ", *parts).alias("text")
    )


def nation_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(jd_id, embedding): the embedding with the nation's key."""
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    nation = table(spark, sf_dir, "nation")
    rows = nation.join(vectors, F.col("n_nationkey") == F.col("vec_id"))
    return rows.select(F.concat(F.lit("JD_"), "n_name").alias("jd_id"), "embedding")


def document_jds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document, whole, as a description between an opening and a closing line."""
    return spread(table(spark, sf_dir, "documents")).select(
        F.col("doc_id").cast("string").alias("jd_id"),
        F.concat_ws(
            "\n",
            pick(phrases.JD_OPENINGS, F.col("doc_id")),
            F.col("text"),
            pick(phrases.JD_CLOSINGS, F.floor(F.col("doc_id") / 3)),
        ).alias("text"),
    )


def item_jds(items: DataFrame) -> DataFrame:
    """(item_id, value): every benchmark passage as a description."""
    opening, closing = pick(phrases.JD_OPENINGS, F.col("item_id")), pick(phrases.JD_CLOSINGS, F.floor(F.col("item_id") / 3))
    return items.select("item_id", F.concat_ws("\n", opening, "text", closing).alias("value"))


def ranking_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every 100 consecutive orders as one ranking file, with faults spread by order key."""
    k = F.col("o_orderkey")
    p = F.floor("o_totalprice")
    place = k % 100
    base = F.lit(0.99) - place * F.lit(0.005)
    return spread(table(spark, sf_dir, "orders")).select(
        F.concat(F.lit("file_"), F.floor(k / 100).cast("string")).alias("file"),
        (place + 2).alias("row_num"),
        F.when(k % 113 == 0, F.lit(5)).otherwise(F.lit(4)).alias("n_cells"),
        F.when(k % 127 == 0, F.lit(" "))
        .when(k % 131 == 0, F.concat(F.lit("CAND_"), k.cast("string")))
        .when(k % 137 == 0, F.format_string("CAND_%07d", F.floor(k / 100) * 100 + 1))
        .otherwise(F.format_string("CAND_%07d", k))
        .alias("candidate_id"),
        F.when(k % 139 == 0, F.concat(F.lit("0"), (place + 1).cast("string")))
        .when(k % 149 == 0, F.lit("101"))
        .when(k % 151 == 0, F.lit("7"))
        .otherwise((place + 1).cast("string"))
        .alias("rank"),
        F.when(k % 157 == 0, F.lit("high"))
        .when(k % 163 == 0, F.lit("nan"))
        .when(p % 29 == 0, F.lit("0.5"))
        .when(k % 3 == 1, (base + F.lit(0.005)).cast("decimal(10,3)").cast("string"))
        .otherwise(base.cast("decimal(10,3)").cast("string"))
        .alias("score"),
        F.lit("text").alias("reasoning"),
    )


def ranking_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every 100 consecutive orders as the lines of one ranking file; the file's number names its fault.

    1 a blank first line, 2 another header, 3 no last row, 4 rows of blank cells and one of a lone comma, 5 a byte that is
    not UTF-8; 1, 5 and 6 a name that is not .csv; others have none.
    """
    k = F.col("o_orderkey")
    rows = table(spark, sf_dir, "orders").select(F.floor(k / 100).alias("file"), (k % 100).alias("at"))
    whole = Window.partitionBy("file")  # a file has at most 100 rows
    rows = rows.withColumn("low", F.min("at").over(whole)).withColumn("high", F.max("at").over(whole))
    fault, at = F.col("file") % 9, F.col("at")
    header = F.when(fault == 2, "candidate_id,score,rank,reasoning").otherwise("candidate_id,rank,score,reasoning")
    place = F.format_string("%07d", F.col("file") * 100 + at)
    body = F.concat(F.lit("CAND_"), place, F.lit(","), (at + 1).cast("string"), F.lit(",0.5,text"))
    bad = F.concat(body, F.expr("CAST(X'FF' AS STRING)"))
    line = lambda i, text: F.struct((at * 10 + i).alias("place"), text.alias("line"))
    first, last = at == F.col("low"), at == F.col("high")
    made = F.array(
        F.when(first & (fault == 1), line(0, F.lit(""))),
        F.when(first, line(1, header)),
        F.when(~(last & (fault == 3)), line(2, F.when(first & (fault == 5), bad).otherwise(body))),
        F.when(first & (fault == 4), line(3, F.lit("  "))),
        F.when(first & (fault == 4), line(4, F.lit(" ,,\t,"))),
        F.when(first & (fault == 4), line(5, F.lit('","'))),
    )
    return rows.select("file", fault.alias("fault"), F.explode(F.array_compact(made)).alias("l")).select("file", "fault", "l.place", "l.line")
