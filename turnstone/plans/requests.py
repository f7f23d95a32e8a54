"""Requests -> stored transcripts, in one call."""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.redact import Rule
from ..functions.text import session_from_path, slug_from_path
from ..schema import POS
from ..session import materialized
from ..sources.store import Store
from ..sources.transcripts import raw_lines, resolve_transcripts, text_lines, transcript_inventory
from .ingest import Ingested, ingest


@dataclass
class Answered:
    """What became of the requests. ``report`` has a row for each: its columns, ``resolved_path``, ``lines`` and
    ``turns`` of the transcript, and ``outcome``: ``stored``, ``no transcript``, ``empty`` or ``no turns``."""

    report: DataFrame
    ingested: Ingested | None


def scan_paths(store: Store, paths: DataFrame, glob: str = "*.jsonl") -> DataFrame:
    """Lines of the transcripts that ``paths`` (``path``) names, before they are parsed.

    Only the folders of these transcripts are listed, and of other files in them no line goes on.
    """
    wanted = paths.select(F.col("path").alias("file_path")).distinct()
    folders = wanted.select(F.regexp_replace("file_path", "/[^/]*$", "").alias("folder")).distinct()
    # a row for each project that was asked for
    named = sorted(r.folder for r in folders.collect())
    if not named:
        return store.spark.createDataFrame([], f"file_path string, pos {POS}, value string")
    plain = [re.sub(r"([\\\[\]{}*?,])", r"\\\1", folder) for folder in named]
    lines = text_lines(store.spark.read.option("pathGlobFilter", glob).text(plain))
    return lines.join(wanted, "file_path", "left_semi")


def ingest_requests(
    store: Store,
    requests: DataFrame,
    root: str,
    batch_id: int,
    rules: list[Rule] | None = None,
    engineer: str | Column | None = None,
    glob: str = "*.jsonl",
) -> Answered:
    """Resolve requests by path, by session or as the newest transcript of a project, and store what they name.

    A transcript named by several requests is read once; a file without any byte counts as none. A request without a transcript, and a transcript that is empty
    or has no turns, is told in the report and stops no other.
    """
    found = materialized(resolve_transcripts(requests, transcript_inventory(store.spark, root, glob=glob)), "requests")
    named = found.filter("resolved_path is not null").select(F.col("resolved_path").alias("path")).distinct()
    done = None
    empty = "project_slug string, transcript string, lines bigint, turns bigint"
    counts = store.spark.createDataFrame([], empty)
    if not named.isEmpty():
        done = ingest(store, raw_lines(scan_paths(store, named, glob)), batch_id, rules, engineer)
        counts = store.read("lines", only=batch_id).groupBy("project_slug", "transcript").agg(
            F.count("*").alias("lines"), F.count_if("is_turn").alias("turns")
        )
    placed = found.withColumns({"_slug": slug_from_path("resolved_path"), "_name": session_from_path("resolved_path")})
    met = placed.join(
        counts.select(F.col("project_slug").alias("_slug"), F.col("transcript").alias("_name"), "lines", "turns"), ["_slug", "_name"], "left"
    ).drop("_slug", "_name")
    outcome = (
        F.when(F.col("resolved_path").isNull(), "no transcript")
        .when(F.col("lines").isNull(), "empty")
        .when(F.col("turns") == 0, "no turns")
        .otherwise("stored")
    )
    return Answered(met.withColumn("outcome", outcome), done)
