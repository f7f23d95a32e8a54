"""A training corpus prepared in five stages, each written as Parquet and read again as the next one's documents."""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession

from turnstone.llm.common import small_batches, table
from turnstone.llm.decontaminate import without_contaminated
from turnstone.llm.line_chunks import without_repeated_lines
from turnstone.llm.near_copies import without_near_copies
from turnstone.llm.packing import pack
from turnstone.llm.tokens import public_tokenizer
from turnstone.llm.toxicity import train, without_toxic
from turnstone.session import scratch_path


Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def lean(stage: Stage) -> Stage:
    """The stage with small batches for its Python tasks. Its result is run later, so the session keeps the limit.

    Executors live through all stages and keep the memory that the largest batches took.
    """

    @wraps(stage)
    def with_small_batches(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        small_batches(spark)
        return stage(spark, docs, sf_dir)

    return with_small_batches


@lean
def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the lexicon, learned from all labelled documents of the table, does not call toxic."""
    lexicon = train(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return without_toxic(docs, lexicon)


@lean
def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return without_repeated_lines(docs)


@lean
def simhash_near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return without_near_copies(docs)


@lean
def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return without_contaminated(docs, table(spark, sf_dir, "benchmark"))


@lean
def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pack(docs, public_tokenizer())


STAGES: list[tuple[str, Stage]] = [
    ("toxicity", toxicity),
    ("line_dedup", line_dedup),
    ("simhash_near_dedup", simhash_near_dedup),
    ("decontamination", decontamination),
    ("packing", packing),
]

# the lexicon's curve, the rolling hashes and the packing search have no SQL; tests compare each stage with brute force
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = scratch_path(spark, name)
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
