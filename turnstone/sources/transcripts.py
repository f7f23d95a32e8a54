"""Reading raw transcripts: JSON lines under ``<root>/<project>/<session>.jsonl``."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import local_path, session_from_path, slug_from_path, strip
from ..session import evaluated_once, materialized


def line_pos(batch=0, mtime=None, piece="", block=0, row=0) -> Column:
    """Build a ``pos`` value from columns or literals."""

    def col(x):
        return x if isinstance(x, Column) else F.lit(x)

    return F.struct(
        col(batch).cast("bigint").alias("batch"),
        col(mtime).cast("timestamp").alias("mtime"),
        col(piece).cast("string").alias("piece"),
        col(block).cast("bigint").alias("block"),
        col(row).cast("bigint").alias("row"),
    )


def text_lines(frame: DataFrame, batch_id: int = 0) -> DataFrame:
    """Rows of a text source -> ``(file_path, pos, value)``.

    Row numbers grow within a block and blocks are ordered by their offset, so the order of a
    split file is that of the file.
    """
    meta = F.col("_metadata")
    return frame.select(
        local_path(meta["file_path"]).alias("file_path"),
        line_pos(
            batch_id,
            meta["file_modification_time"],
            meta["file_name"],
            meta["file_block_start"],
            F.monotonically_increasing_id(),
        ).alias("pos"),
        "value",
    )


_STRICT = {
    "maxStringLen": str(2**31 - 1), "allowSingleQuotes": "false", "allowNonNumericNumbers": "false",
    "mode": "PERMISSIVE",
}


def raw_lines(lines: DataFrame) -> DataFrame:
    """``(file_path, pos, value)`` -> stripped non-blank lines, parsed to VARIANT.

    ``problem`` says why a line cannot be used; only JSON objects can. A parsed line holds at most 128 MiB; what
    is longer is ``too long`` and kept as text.
    """
    valid = F.is_valid_utf8("value")
    text = F.when(valid, strip("value")).otherwise(F.make_valid_utf8("value"))
    stripped = lines.select("file_path", "pos", valid.alias("valid"), text.alias("text")).filter("text <> ''")
    # The parser stops after the first value and does not look at what follows. Inside an array that
    # ends with the text's length, anything but exactly one value shows.
    size = F.length("text")
    framed = F.concat(F.lit("["), "text", F.lit(","), size.cast("string"), F.lit("]"))
    # the plain parser stops at strings of 20 million characters; this one is told not to, and is as strict
    long = F.from_json(framed, "variant", _STRICT)
    parse = F.when(size < 19_000_000, F.try_parse_json(framed)).otherwise(long)
    parsed = stripped.withColumn("framed", F.when(F.col("valid"), parse)).withColumn(
        "whole",
        (F.try_variant_get("framed", "$[1]", "bigint") == size)
        & F.try_variant_get("framed", "$[2]", "variant").isNull(),
    )
    is_object = F.col("whole") & F.col("text").startswith("{")
    problem = (
        F.when(~F.col("valid"), F.lit("not utf-8"))
        .when(is_object, F.lit(None).cast("string"))
        .when(F.col("whole"), F.lit("not an object"))
        .when(F.octet_length("text") > 120_000_000, F.lit("too long"))
        .otherwise(F.lit("not json"))
    )
    return evaluated_once(
        parsed.select(
            slug_from_path("file_path").alias("project_slug"),
            session_from_path("file_path").alias("transcript"),
            "pos",
            F.col("text").alias("value"),
            F.when(is_object, F.try_variant_get("framed", "$[0]", "variant")).alias("v"),
            problem.alias("problem"),
        )
    )


def scan_transcripts(
    spark: SparkSession, path: str | list[str], glob: str = "*.jsonl", batch_id: int = 0
) -> DataFrame:
    """All transcripts below ``path`` as parsed lines. Large files are split, never held whole."""
    reader = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", glob)
    return raw_lines(text_lines(reader.text(path), batch_id))


def transcript_inventory(
    spark: SparkSession, path: str, project_slug: str | None = None, glob: str = "*.jsonl"
) -> DataFrame:
    """The transcripts of one project or all, newest first. File contents are not read."""
    empty = "path string, project_slug string, session_id string, modified timestamp, size bigint"
    if not _exists(spark, path):
        return spark.createDataFrame([], empty)
    files = (
        spark.read.format("binaryFile")
        .option("recursiveFileLookup", "true")
        .option("pathGlobFilter", glob)
        .load(path)
        .select(
            local_path("path").alias("path"),
            F.col("modificationTime").alias("modified"),
            F.col("length").alias("size"),
        )
        .select(
            "path",
            slug_from_path("path").alias("project_slug"),
            session_from_path("path").alias("session_id"),
            "modified",
            "size",
        )
    )
    if project_slug:
        files = files.filter(F.col("project_slug") == project_slug)
    return files.orderBy(F.desc("modified"), "path")


def _exists(spark: SparkSession, path: str) -> bool:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where)


# fixed values: both spellings of the request keys
_ALIASES = {
    "transcript_path": "transcriptPath",
    "session_id": "sessionId",
    "project_slug": "projectSlug",
}


def _request(requests: DataFrame) -> DataFrame:
    """Fold the two spellings of every key into one column; an empty string counts as missing."""
    folded = {}
    for snake, camel in _ALIASES.items():
        given = [F.nullif(F.col(c), F.lit("")) for c in (snake, camel) if c in requests.columns]
        folded[snake] = F.coalesce(*given) if given else F.lit(None).cast("string")
    return requests.withColumns(folded).drop(*_ALIASES.values())


def resolve_transcripts(requests: DataFrame, inventory: DataFrame) -> DataFrame:
    """Requests -> file: an existing explicit path, else ``<slug>/<session>.jsonl``, else the
    newest file of the slug, else NULL."""
    # used three times; the rebalance leaves few files of it and the order of the inventory behind
    files = materialized(inventory.select("path", "project_slug", "session_id", "modified").hint("rebalance"), "inventory")
    by_path = files.select(F.col("path").alias("transcript_path"), F.col("path").alias("_given"))
    by_name = files.groupBy("project_slug", "session_id").agg(F.max("path").alias("_named"))
    newest = files.groupBy("project_slug").agg(
        F.max_by("path", F.struct("modified", "path")).alias("_newest")
    )
    # a request without a path or session meets nothing: it goes around that join instead of into one task with all like it
    asked = _request(requests)
    named, unnamed = asked.filter("transcript_path is not null"), asked.filter("transcript_path is null")
    asked = named.join(by_path, "transcript_path", "left").unionByName(unnamed.withColumn("_given", F.lit(None).cast("string")))
    told, untold = asked.filter("session_id is not null"), asked.filter("session_id is null")
    asked = told.join(by_name, ["project_slug", "session_id"], "left").unionByName(
        untold.withColumn("_named", F.lit(None).cast("string"))
    )
    return (
        asked.join(newest, "project_slug", "left")
        .withColumn("resolved_path", F.coalesce("_given", "_named", "_newest"))
        .drop("_given", "_named", "_newest")
    )
