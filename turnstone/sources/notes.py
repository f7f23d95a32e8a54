"""The markdown note library: ``lessons``, ``runbooks`` and ``decisions`` below one folder."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import local_path
from .transcripts import _exists

# fixed values: searched folders in listing order; the file that is no note
CATEGORIES = ["lessons", "runbooks", "decisions"]
NOT_A_NOTE = "README.md"


def scan_notes(spark: SparkSession, root: str) -> DataFrame:
    """``(rel_path, category, stem, content)`` of every note; a note is one small file.

    Files that are not valid UTF-8 are left out.
    """
    folders = [f"{root.rstrip('/')}/{c}" for c in CATEGORIES]
    folders = [f for f in folders if _exists(spark, f)]
    if not folders:
        return spark.createDataFrame([], "rel_path string, category string, stem string, content string")
    path = local_path(F.col("_metadata.file_path"))
    return (
        spark.read.option("pathGlobFilter", "*.md")
        .text(folders, wholetext=True)
        .filter(F.is_valid_utf8("value"))
        .withColumn("path", path)
        .select(
            # from two folders above the root on, or as many as there are
            F.regexp_extract("path", r"((?:[^/]+/){1,3}[^/]+)$", 1).alias("rel_path"),
            F.regexp_extract("path", r"([^/]+)/[^/]+$", 1).alias("category"),
            F.regexp_extract("path", r"([^/]+)\.md$", 1).alias("stem"),
            F.regexp_replace("value", r"\r\n?", "\n").alias("content"),
            F.regexp_extract("path", r"([^/]+)$", 1).alias("_name"),
        )
        .filter(F.col("_name") != NOT_A_NOTE)
        .drop("_name")
    )
