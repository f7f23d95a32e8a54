"""Structured Streaming ingest of transcripts that land as new files.

A file source does not see later growth of a file it knows, so a growing transcript lands in
pieces, ``project_slug=<slug>/transcript=<session>/<piece>``; whole transcripts may land as
``<slug>/<session>.jsonl``.
"""

from __future__ import annotations

import gc
import hashlib
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import IntegerType, LongType, StringType, StructField, StructType

from ..functions.redact import Rule, redact
from ..operators.messages import anti_insert, first_uuid_wins
from ..plans.ingest import ingest
from ..session import adopted, session_like
from ..sources.store import Store, key_prefix
from ..sources.transcripts import _exists, line_pos, raw_lines

# of the tables of ``stream_dedup``; a table keeps the number it was made with
DEDUP_PREFIXES = 64

# of a micro-batch: the driver holds one or two kB for each, and every batch has its fixed costs
FILES_PER_TRIGGER = 50_000

# Settings of the stream's file source only. Landed files are many and small, and each is opened once.
LANDED = {
    # else the driver keeps up to 250 MB of what listings said of files
    "spark.sql.hive.filesourcePartitionFileCacheSize": "0",
    # and the hosts of each file, beside its status
    "spark.sql.sources.ignoreDataLocality": "true",
    # tasks of the job that looks a micro-batch's files up, of which there would be up to 10,000; the driver remembers tasks
    "spark.sql.sources.parallelPartitionDiscovery.parallelism": "64",
    # what opening a file counts as: with the usual 4 MB a task gets 4 to 32 files
    "spark.sql.files.openCostInBytes": str(256 * 1024),
}


def landed_lines(spark: SparkSession, path: str, glob: str = "*", per_trigger: int | None = None) -> DataFrame:
    """Stream of ``(file_path, file_name, block, mtime, value)`` as files land.

    A micro-batch has ``per_trigger`` files at most (``FILES_PER_TRIGGER``); all others follow in the next ones.
    """
    reader = session_like(spark, LANDED).readStream.format("text").option("recursiveFileLookup", "true")
    lines = reader.option("pathGlobFilter", glob).option("maxFilesPerTrigger", per_trigger or FILES_PER_TRIGGER).load(path)
    meta = F.col("_metadata")
    return adopted(spark, lines).select(
        meta["file_path"].alias("file_path"),
        meta["file_name"].alias("piece"),
        meta["file_block_start"].alias("block"),
        meta["file_modification_time"].alias("mtime"),
        "value",
    )


def stream_redact(lines: DataFrame, rules: list[Rule] | None = None, column: str = "value") -> DataFrame:
    """Stateless redaction, before anything is written."""
    return lines.withColumn(column, redact(column, rules))


def _batch_lines(batch: DataFrame, batch_id: int) -> DataFrame:
    from ..functions.text import local_path

    # rows are numbered inside the batch: the numbers grow within every block
    place = line_pos(batch_id, F.col("mtime"), F.col("piece"), F.col("block"), F.monotonically_increasing_id())
    return batch.select(local_path("file_path").alias("file_path"), place.alias("pos"), "value")


def stream_ingest(
    store: Store,
    lines: DataFrame,
    checkpoint: str,
    rules: list[Rule] | None = None,
    engineer: str | Column | None = None,
    writer: str | None = None,
    **trigger,
) -> StreamingQuery:
    """Run ``ingest`` on every micro-batch.

    Writes are keyed by the stream (its checkpoint folder, or ``writer``) and the batch id: a replayed batch
    replaces its own rows, other streams and batch jobs share the store. Sessions merge this batch with the
    partials of the stream's earlier ones. Give a trigger, e.g. ``availableNow=True``.
    """
    name = writer or writer_of(checkpoint)

    def store_batch(batch: DataFrame, batch_id: int) -> None:
        # frames are cyclic garbage in Python; until it is collected the driver keeps their plans and the files these name
        gc.collect()
        here = Store(batch.sparkSession, store.root, name)
        ingest(here, raw_lines(_batch_lines(batch, batch_id)), batch_id, rules, engineer, in_pieces=True)

    return (
        lines.writeStream.foreachBatch(store_batch)
        .option("checkpointLocation", checkpoint)
        .trigger(**trigger)
        .start()
    )


def writer_of(checkpoint: str) -> str:
    """A stream is known by its checkpoint folder: a new folder numbers its batches anew."""
    return "stream-" + hashlib.sha256(checkpoint.rstrip("/").encode()).hexdigest()[:16]


def stream_dedup(
    stream: DataFrame, table: str, checkpoint: str, key: tuple[str, ...] = ("uuid",), **trigger
) -> StreamingQuery:
    """Append first occurrences of a key to a Parquet table, for good and without growing state.

    The table is partitioned by a prefix of the key's hash; each micro-batch is compared with what all others stored
    under its prefixes. A batch is written aside and moved into place, so one that dies leaves nothing that counts and
    runs again, also if it was the first."""
    writer = writer_of(checkpoint)

    def append_new(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        fresh = first_uuid_wins(batch, key, order=[c for c in batch.columns if c not in key])
        fresh = fresh.withColumn("key_prefix", key_prefix(key, DEDUP_PREFIXES))
        if _exists(spark, table):
            own = (F.col("batch_id") == batch_id) & (F.col("writer") == writer)
            fresh = anti_insert(fresh, stored_under(spark, table, batch, key).filter(~own), key)
        aside = f"{table}/_writing/{uuid.uuid4().hex}"
        fresh.repartition("key_prefix").write.partitionBy("key_prefix").parquet(aside)
        put_in_place(spark, aside, f"{table}/writer={writer}/batch_id={batch_id}")

    return (
        stream.writeStream.foreachBatch(append_new)
        .option("checkpointLocation", checkpoint)
        .trigger(**trigger)
        .start()
    )


def stored_under(spark: SparkSession, table: str, batch: DataFrame, key: tuple[str, ...]) -> DataFrame:
    """What the table of ``stream_dedup`` holds under the prefixes of a batch's keys."""
    prefixes = [r[0] for r in batch.select(key_prefix(key, DEDUP_PREFIXES)).distinct().collect()]  # a row for each prefix at most
    places = [StructField("key_prefix", IntegerType()), StructField("batch_id", LongType()), StructField("writer", StringType())]
    return spark.read.schema(StructType([*batch.schema.fields, *places])).parquet(table).filter(F.col("key_prefix").isin(prefixes))


def put_in_place(spark: SparkSession, aside: str, path: str) -> None:
    """Make a complete folder the content of ``path``; what was there is moved away first and deleted last."""
    hadoop = spark._jvm.org.apache.hadoop.fs.Path
    source, target, old = hadoop(aside), hadoop(path), hadoop(f"{aside}.old")
    files = target.getFileSystem(spark._jsc.hadoopConfiguration())
    files.mkdirs(target.getParent())
    if files.exists(target) and not files.rename(target, old):
        raise OSError(f"cannot move {path} away")
    if not files.rename(source, target):
        raise OSError(f"cannot move {aside} to {path}")
    files.delete(old, True)
    spark.catalog.refreshByPath(path)


def dedup_within(stream: DataFrame, event_time: str, delay: str, key: tuple[str, ...] = ("uuid",)) -> DataFrame:
    """Bounded variant: forgets a key once the watermark has passed it."""
    return stream.withWatermark(event_time, delay).dropDuplicatesWithinWatermark(list(key))
