"""Removal of lines that an earlier document holds, by levelled sorted runs of line hashes.

The documents are dealt in order of their ids into a few batches (quantiles of the id, so a batch is as large as the table is).
All lines are hashed once; per batch each hash is kept once, sorted and bucketed by hash. Then, batch after batch:

1. The batch's hashes are merge-anti-joined with every run. Nothing is shuffled, since runs have the same buckets and order.
2. What is left is new. It becomes a run of the lowest level.
3. When a level has ``fanout`` runs, they are compacted into one run of the next level.

A hash that a run holds was seen in an earlier batch, so the batch's lines with it go. A new hash stays in the smallest
id of the batch that holds it. Only hashes that cost some document a line meet the lines again, to name the line numbers,
and only these numbers meet the texts. Hashes are 96 bits.

Hot lines: batches combine equal hashes before the shuffle, and hashes of very many lines meet them by a bounded broadcast
(``join_hot``).

Only DataFrame functions are used. Written tables under ``spark.checkpoint.dir`` separate the steps; the catalog entries of
the runs are dropped at the end.

Defined cases: a null or empty text is one empty line; rows that share an id count as one document, so they don't take
lines from each other; all rows without an id count as one document after all others; repeated lines of one document
all stay or all go; a text of any length is one row; an empty table gives no rows; extra columns are left behind.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rosterank.llm.common import buckets_for, columns, join_hot, shared_dir, stage

#: Characters stripped from both ends of a line: blank and 9 to 13 (fixed values of the contract).
SPACES = " \t\n\x0b\x0c\r"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Bytes of a hash with its counts.
_KEY_BYTES = 40


def line_key(line: Column) -> Column:
    """The line without white space at its ends, ASCII letters in lower case."""
    bare = F.btrim(line, F.lit(SPACES))
    ascii_only = F.char_length(bare) == F.octet_length(bare)  # then the quick function changes A-Z only
    return F.when(ascii_only, F.lower(bare)).otherwise(F.translate(bare, _UPPER, _LOWER))


def hashed_lines(documents: DataFrame, *, batches: int, least: int) -> DataFrame:
    """(batch, doc_id, tie, line, h, g): the hashes of all lines whose key has at least ``least`` code points, staged.

    ``tie`` is a hash of the text, so that (doc_id, tie) names equal rows only.
    """
    docs = _texts(documents)
    steps = [k / batches for k in range(1, batches)]
    bounds = steps and docs.agg(F.percentile_approx("doc_id", steps, 10_000)).first()[0] or []
    # rows without an id are a batch of their own after all others
    batch = F.lit(0)
    for bound in sorted(set(bounds)):
        batch = batch + (F.col("doc_id") > bound).cast("int")
    batch = F.when(F.col("doc_id").isNull(), F.lit(len(bounds) + 1)).otherwise(batch)
    # the inner array binds a key, so that it is made once for both hashes
    hashes = lambda line: F.transform(
        F.array(line_key(line)), lambda key: F.when(F.char_length(key) >= least, F.struct(F.xxhash64(key).alias("h"), F.hash(key).alias("g")))
    )[0]
    lines = docs.select(batch.alias("batch"), "doc_id", "tie", F.posexplode(F.transform(F.split("text", "\n"), hashes)).alias("line", "key"))
    return stage(lines.where("key IS NOT NULL").select("batch", "doc_id", "tie", "line", "key.h", "key.g"), "lines")


def _texts(documents: DataFrame) -> DataFrame:
    docs = columns(documents, doc_id="long", text="string").withColumn("text", F.coalesce("text", F.lit("")))
    return docs.withColumn("tie", F.xxhash64("text"))


class Runs:
    """Sorted runs of hashes in levels; every run is a table bucketed and sorted by hash."""

    def __init__(self, spark: SparkSession, buckets: int, fanout: int):
        self.spark, self.buckets, self.fanout = spark, buckets, fanout
        self.levels: list[list[str]] = []
        self.names: list[str] = []

    def write(self, rows: DataFrame, label: str, *by: str) -> str:
        """A bucketed and sorted table; its rows are only moved if they don't lie in its buckets yet."""
        name = f"{label}_{uuid.uuid4().hex}"
        self.names.append(name)
        writer = rows.write.option("path", shared_dir(self.spark, label)).option("compression", "zstd")
        writer = writer.partitionBy(*by) if by else writer
        writer.bucketBy(self.buckets, "h", "g").sortBy("h", "g").saveAsTable(name)
        return name

    def unseen(self, hashes: DataFrame) -> DataFrame:
        """``hashes`` that no run holds."""
        for level in reversed(self.levels):
            for name in level:
                hashes = hashes.join(self.spark.table(name).hint("merge"), ["h", "g"], "left_anti")
        return hashes

    def add(self, hashes: DataFrame) -> DataFrame:
        """A new run, and compaction where a level is full; the run's rows."""
        name = self.write(hashes, "run")
        rows = self.spark.table(name)
        for level in range(len(self.levels) + 1):
            if level == len(self.levels):
                self.levels.append([])
            self.levels[level].append(name)
            if len(self.levels[level]) < self.fanout:
                break
            together = self.spark.table(self.levels[level][0])
            for other in self.levels[level][1:]:
                together = together.unionByName(self.spark.table(other))
            name = self.write(together.repartition(self.buckets, "h", "g"), "run")
            self.levels[level] = []
        return rows

    def drop(self) -> None:
        for name in self.names:
            self.spark.sql(f"DROP TABLE IF EXISTS {name}")


def lost_lines(lines: DataFrame, *, batches: int, fanout: int) -> DataFrame:
    """(batch, h, g, seen, first, times): hashes by which a batch's documents lose lines, staged.

    ``seen`` ones are in an earlier batch; of the others the document ``first`` keeps its lines.
    """
    spark = lines.sparkSession
    runs = Runs(spark, buckets_for(spark, lines.count() * _KEY_BYTES), fanout)
    grouped = lines.groupBy("batch", "h", "g").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last"), F.count(F.lit(1)).alias("times"))
    found = None
    try:
        table = spark.table(runs.write(grouped.repartition(runs.buckets, "h", "g"), "hashes", "batch"))
        for batch in sorted(r["batch"] for r in table.select("batch").distinct().collect()):  # batches + 1 at most
            own = table.where(F.col("batch") == batch)
            new = runs.add(runs.unseen(own.select("h", "g")))
            held = own.join(new.withColumn("new", F.lit(True)).hint("merge"), ["h", "g"], "left")
            lost = held.where("new IS NULL OR first < last").select(
                F.lit(batch).alias("batch"), "h", "g", F.col("new").isNull().alias("seen"), "first", "times"
            )
            lost = stage(lost, "lost")
            found = lost if found is None else found.unionByName(lost)
    finally:
        runs.drop()
    if found is None:
        return spark.createDataFrame([], "batch int, h long, g int, seen boolean, first long, times long")
    return found


def remove_lines(documents: DataFrame, *, least: int = 10, batches: int = 8, fanout: int = 4) -> DataFrame:
    """(doc_id, n_lines, n_dropped, kept): every text without the lines that a document of a smaller id holds.

    Lines are compared by ``line_key``; shorter keys than ``least`` code points always stay.
    """
    lines = hashed_lines(documents, batches=batches, least=least)
    lost = lost_lines(lines, batches=batches, fanout=fanout)
    goes = F.col("seen") | F.coalesce(F.col("doc_id") > F.col("first"), F.lit(False))
    met = join_hot(lines, lost, ["batch", "h", "g"]).where(goes)
    gone = stage(met.groupBy("doc_id", "tie").agg(F.collect_set("line").alias("gone")), "gone")  # one text's lines at most

    docs = _texts(documents)
    same = docs["doc_id"].eqNullSafe(gone["doc_id"]) & (docs["tie"] == gone["tie"])
    both = docs.join(gone.hint("merge"), same, "left").select(docs["doc_id"], "text", "gone")
    number = F.char_length("text") - F.char_length(F.replace("text", F.lit("\n"))) + 1
    # array_except is linear; the outer array binds the pieces, so that a text is split once
    stay = lambda pieces: F.array_except(F.sequence(F.lit(0), F.size(pieces) - 1), F.col("gone"))
    rest = F.transform(F.array(F.split("text", "\n")), lambda pieces: F.array_join(F.transform(stay(pieces), lambda i: F.get(pieces, i)), "\n"))[0]
    return both.select(
        "doc_id",
        number.cast("long").alias("n_lines"),
        F.when(F.col("gone").isNull(), F.lit(0)).otherwise(F.size("gone")).cast("long").alias("n_dropped"),
        F.when(F.col("gone").isNull(), F.col("text")).otherwise(rest).alias("kept"),
    )


def op13_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document without the lines of ten or more characters that an earlier one holds."""
    cleaned = remove_lines(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return cleaned.select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))


SQL = f"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents
), l AS (
  SELECT r, doc_id, unnest(lines) AS line, unnest(range(1, len(lines) + 1)) AS i FROM d
), k AS (
  SELECT r, doc_id, i, line, translate(trim(line, concat(' ', chr(9), chr(10), chr(11), chr(12), chr(13))), '{_UPPER}', '{_LOWER}') AS key FROM l
), m AS (
  SELECT r, i, line, length(key) >= 10 AND coalesce(doc_id > min(doc_id) OVER (PARTITION BY key),
    doc_id IS NULL AND min(doc_id) OVER (PARTITION BY key) IS NOT NULL) AS gone FROM k
)
SELECT any_value(doc_id) AS doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (NOT gone), '')) AS kept_sha256
FROM m JOIN d USING (r) GROUP BY r
"""
