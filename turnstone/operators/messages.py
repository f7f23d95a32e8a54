"""Message rows: insert-if-absent, lookups, deletes."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.tokens import doc_length, normalized
from ..session import evaluated_once
from .filters import filter_project

_KEY = ("project_slug", "uuid")


def first_uuid_wins(messages: DataFrame, key: tuple[str, ...] = _KEY, order: list | None = None) -> DataFrame:
    """First occurrence of every uuid. The row-number filter is also applied before the shuffle,
    so copies of one uuid leave each task as a single row."""
    order = order or ["pos.batch", "pos.mtime", "transcript", "pos"]
    first = Window.partitionBy(*key).orderBy(*order)
    return messages.withColumn("_rn", F.row_number().over(first)).filter("_rn = 1").drop("_rn")


def anti_insert(
    new: DataFrame, stored: DataFrame, key: tuple[str, ...] = _KEY, asked: DataFrame | None = None
) -> DataFrame:
    """Rows of ``new`` whose key is not stored. ``asked`` may hold the same keys more cheaply.

    The big table is reduced to the keys that reappear first: a small batch is then the side Spark
    can broadcast once it has measured it, and the stored rows need no shuffle.
    """
    wanted = (new if asked is None else asked).select(*key).distinct()
    known = stored.select(*key).join(wanted, list(key), "left_semi").distinct()
    return new.join(known, list(key), "left_anti")


def insert_messages(new: DataFrame, stored: DataFrame, key: tuple[str, ...] = _KEY, order: list | None = None) -> DataFrame:
    return anti_insert(first_uuid_wins(new, key, order), stored, key, asked=new)


def ingest_stats(new: DataFrame, inserted: DataFrame) -> DataFrame:
    """Inserted and total messages per session."""
    marked = new.select("session_id", F.lit(0).alias("i")).unionByName(
        inserted.select("session_id", F.lit(1).alias("i"))
    )
    return marked.groupBy("session_id").agg(
        F.sum("i").alias("messages_inserted"), F.count_if(F.col("i") == 0).alias("messages_total")
    )


def with_search_columns(messages: DataFrame) -> DataFrame:
    """Add the normalised text and its length; stored tables carry them already."""
    if "norm" in messages.columns:
        return messages
    # the text is normalised once per row, whatever conditions follow
    return evaluated_once(messages.withColumn("norm", normalized("content"))).withColumn(
        "doc_len", doc_length("norm")
    )


def _in_order(messages: DataFrame) -> list[str]:
    """Text time first; reading order, where known, decides ties."""
    return ["timestamp", "pos"] if "pos" in messages.columns else ["timestamp", "uuid"]


def session_messages(sessions: DataFrame, messages: DataFrame) -> DataFrame:
    """Messages of the chosen sessions, many at once."""
    keys = ["project_slug", "session_id"]
    return messages.join(sessions.select(*keys), keys)


def transcript(
    messages: DataFrame, session_ids: list[str] | DataFrame, limit: int | None = None, slug: str | None = None
) -> DataFrame:
    """Messages of the given sessions in time order; ``limit`` applies to each session.

    Projects may share a session id: a frame with ``project_slug`` (see ``locate_session``) or ``slug`` names the one.
    """
    chosen = filter_project(messages, slug)
    if isinstance(session_ids, DataFrame):
        key = [c for c in ("project_slug", "session_id") if c in session_ids.columns]
        chosen = chosen.join(session_ids.select(*key).distinct(), key, "left_semi")
    else:
        chosen = chosen.filter(F.col("session_id").isin(session_ids))
    order = _in_order(messages)
    if limit is not None:
        w = Window.partitionBy("project_slug", "session_id").orderBy(*order)
        chosen = chosen.withColumn("_rn", F.row_number().over(w)).filter(F.col("_rn") <= limit).drop("_rn")
    return chosen.orderBy("project_slug", "session_id", *order).select(
        "project_slug", "session_id", "uuid", "parent_uuid", "timestamp", "role", "content"
    )


def orphan_messages(messages: DataFrame, sessions: DataFrame) -> DataFrame:
    keys = ["project_slug", "session_id"]
    return messages.join(sessions.select(*keys), keys, "left_anti")


def purge_project(sessions: DataFrame, messages: DataFrame, slug: str) -> tuple[DataFrame, DataFrame]:
    """Sessions without the project's, and the messages that still have a session."""
    keys = ["project_slug", "session_id"]
    kept = sessions.filter(~F.col("project_slug").eqNullSafe(slug))
    return kept, messages.join(kept.select(*keys), keys, "left_semi")
