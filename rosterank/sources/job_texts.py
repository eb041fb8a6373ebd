"""Job descriptions: one plain-text file each."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def load_job_texts(spark: SparkSession, path: str | list[str], *, name_pattern: str = r"([^/]*?)(?:\.[^./]*)?$") -> DataFrame:
    """(jd_id, text): the first group of ``name_pattern`` in the file's path, and the file's whole text.

    The pattern's default is the file's name without its suffix; a folder per description needs one of its own.
    """
    name = F.regexp_extract(F.url_decode("_metadata.file_path"), name_pattern, 1)
    return spark.read.text(path, wholetext=True).select(name.alias("jd_id"), F.col("value").alias("text"))
