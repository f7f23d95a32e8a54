"""Row filters shared by listings, searches and digests. Each is a plain predicate, so it reaches
the scan and prunes project partitions."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import iso_timestamp

# fixed values: the noise filter and the look-back of team activity
MIN_TURNS = 2
LOOKBACK_DAYS = 7


def filter_project(frame: DataFrame, slug: str | None = None) -> DataFrame:
    return frame.filter(F.col("project_slug") == slug) if slug else frame


def filter_min_turns(frame: DataFrame, min_turns: int = MIN_TURNS) -> DataFrame:
    return frame.filter(F.col("turn_count") >= min_turns)


def filter_engineer(frame: DataFrame, engineer: str | None = None, slug: str | None = None) -> DataFrame:
    if engineer:
        frame = frame.filter(F.col("engineer_id") == engineer)
    return filter_project(frame, slug)


def filter_not_self(frame: DataFrame, viewer: str) -> DataFrame:
    return frame.filter(~F.col("engineer_id").eqNullSafe(viewer))


def last_touched() -> Column:
    """End of a session, else its start; an empty text counts as missing."""
    return F.coalesce(F.nullif("ended_at", F.lit("")), F.nullif("started_at", F.lit("")))


def is_recent(as_of: datetime | str, days: int = LOOKBACK_DAYS) -> Column:
    """True unless the session was last touched before the cutoff; unreadable times stay."""
    cutoff = F.lit(str(as_of)).cast("timestamp") - F.expr(f"INTERVAL {int(days)} DAYS")
    touched = iso_timestamp(last_touched())
    return touched.isNull() | (touched >= cutoff)


def filter_recency(frame: DataFrame, as_of: datetime | str, days: int = LOOKBACK_DAYS) -> DataFrame:
    return frame.filter(is_recent(as_of, days))


def filter_not_current(latest: DataFrame, current: DataFrame) -> DataFrame:
    """Drop a project's newest session when it is the current one; nothing takes its place."""
    return latest.join(current.select("session_id").distinct(), "session_id", "left_anti")
