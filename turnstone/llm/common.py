"""What the operators of this folder share."""

from __future__ import annotations

from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from turnstone.session import scratch_path

BATCH_BYTES = 4 << 20  # of rows that a Python task gets at once
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def ready(spark: SparkSession) -> None:
    """Let Python tasks import this package where it lies beside the driver; clusters install it."""
    home = str(Path(__file__).resolve().parents[2])
    paths = spark.sparkContext.environment.get("PYTHONPATH", "")
    if home not in paths.split(":"):
        spark.sparkContext.environment["PYTHONPATH"] = f"{home}:{paths}".rstrip(":")


def small_batches(spark: SparkSession) -> None:
    """Let Python tasks of this session get ``BATCH_BYTES`` of rows at a time, unless the session names a limit itself.

    Spark's own limit is 10,000 rows, whatever their size, often all of a task: the executor then holds them several times
    outside its heap, and the worker once more with all it makes of them, and neither gives the memory back.
    """
    limit = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark.conf.get(limit, None) is None:
        spark.conf.set(limit, str(BATCH_BYTES))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ready(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def texts_of(docs: DataFrame) -> DataFrame:
    """Only ``doc_id`` and ``text``; a null text counts as empty. Other columns, of any name, are left out."""
    ready(docs.sparkSession)
    return docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")
    )


def named(docs: DataFrame, name: str) -> Column:
    """A column of a frame by its exact name."""
    return docs["`" + name.replace("`", "``") + "`"]


def packed(docs: DataFrame) -> DataFrame:
    """``row`` (all columns of the input), ``doc_id`` and ``text``: no column of the input can clash with an operator's own."""
    ready(docs.sparkSession)
    return docs.select(
        F.struct(*[named(docs, c).alias(c) for c in docs.columns]).alias("row"),
        F.col("doc_id").cast("long").alias("doc_id"),
        F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"),
    )


def unpacked(rows: DataFrame, columns: list[str]) -> DataFrame:
    return rows.select(*[F.col("row").getField(c).alias(c) for c in columns])


def lower_ascii(column: Column) -> Column:
    return F.translate(column, UPPER, LOWER)


def written(frame: DataFrame, name: str) -> DataFrame:
    """The frame as a table in the shared folder: computed once, and safe from lost executors."""
    path = scratch_path(frame.sparkSession, name)
    frame.write.parquet(path)
    return frame.sparkSession.read.schema(frame.schema).parquet(path)


def words_of(text: bytes) -> list[bytes]:
    """Words between ASCII white space, A-Z in lower case."""
    return text.lower().split()


def utf8(column: pa.Array) -> list[bytes]:
    """The values of a string column as UTF-8."""
    return column.cast(pa.binary()).to_pylist()


def batches_of(table_: pa.Table, schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    yield from table_.cast(schema).to_batches()


def sums_between(values: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Sum of each run of values; ``ends`` holds the end of each run, and the first starts at 0."""
    total = np.concatenate([[0], np.cumsum(values)])
    return total[ends] - total[np.concatenate([[0], ends[:-1]])]
