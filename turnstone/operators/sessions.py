"""Session rows: rollup of transcripts, versions, listings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .filters import MIN_TURNS, filter_min_turns, filter_project

_KEY = ["project_slug", "transcript"]
_EDGES = ["first_session", "first_ts", "first_branch", "first_cwd"]


def _placed(column: str) -> Column:
    """(place, value) of a present value; NULL otherwise, which min and max skip."""
    return F.when(
        F.col(column).isNotNull(), F.struct(F.col("pos").alias("pos"), F.col(column).alias("value"))
    )


def tool_freq(lines: DataFrame) -> DataFrame:
    """Tool uses per transcript as a map with sorted keys."""
    uses = lines.select(*_KEY, F.explode("tools").alias("tool")).groupBy(*_KEY, "tool").count()
    return _as_map(uses)


def _as_map(uses: DataFrame) -> DataFrame:
    entries = F.array_sort(F.collect_list(F.struct("tool", "count")))
    return uses.groupBy(*_KEY).agg(F.map_from_entries(entries).alias("tool_call_freq"))


def _with_tools(rows: DataFrame, freq: DataFrame) -> DataFrame:
    none = F.create_map().cast("map<string,bigint>")
    return rows.join(freq, _KEY, "left").withColumn("tool_call_freq", F.coalesce("tool_call_freq", none))


def session_partials(lines: DataFrame) -> DataFrame:
    """What one set of lines says about its transcripts. Partials of several sets merge exactly,
    so a growing transcript never has to be read again.

    One pass over the lines: a line counts once for each of its tools, and for the session with its first.
    """
    uses = lines.select(
        *_KEY, "pos", "raw_session", "timestamp", "git_branch", "cwd", "is_turn", F.posexplode_outer("tools").alias("_nr", "tool")
    )
    by_tool = uses.groupBy(*_KEY, "tool").agg(
        F.min(_placed("raw_session")).alias("first_session"),
        F.min(_placed("timestamp")).alias("first_ts"),
        F.max(_placed("timestamp")).alias("last_ts"),
        F.min(_placed("git_branch")).alias("first_branch"),
        F.min(_placed("cwd")).alias("first_cwd"),
        F.count_if(F.col("is_turn") & (F.coalesce("_nr", F.lit(0)) == 0)).alias("turn_count"),
        F.count("tool").alias("count"),
    )
    named = F.collect_list(F.when(F.col("tool").isNotNull(), F.struct("tool", "count")))
    return by_tool.groupBy(*_KEY).agg(
        *[F.min(c).alias(c) for c in _EDGES],
        F.max("last_ts").alias("last_ts"),
        F.sum("turn_count").alias("turn_count"),
        F.map_from_entries(F.array_sort(named)).alias("tool_call_freq"),
    )


def merge_partials(partials: DataFrame) -> DataFrame:
    rows = partials.groupBy(*_KEY).agg(
        *[F.min(c).alias(c) for c in _EDGES],
        F.max("last_ts").alias("last_ts"),
        F.sum("turn_count").alias("turn_count"),
    )
    uses = (
        partials.select(*_KEY, F.explode("tool_call_freq").alias("tool", "n"))
        .groupBy(*_KEY, "tool")
        .agg(F.sum("n").alias("count"))
    )
    return _with_tools(rows, _as_map(uses))


def finish_sessions(partials: DataFrame) -> DataFrame:
    """One row per transcript: first and last timestamp in reading order over all lines."""
    return partials.select(
        F.coalesce(F.nullif("first_session.value", F.lit("")), F.col("transcript")).alias("session_id"),
        "project_slug",
        "transcript",
        F.coalesce("first_ts.value", F.lit("")).alias("started_at"),
        F.coalesce("last_ts.value", F.lit("")).alias("ended_at"),
        F.col("turn_count").cast("bigint").alias("turn_count"),
        "tool_call_freq",
        F.col("first_branch.value").alias("git_branch"),
        F.col("first_cwd.value").alias("cwd"),
    )


def session_rollup(lines: DataFrame) -> DataFrame:
    return finish_sessions(session_partials(lines))


def upsert_sessions(
    versions: DataFrame,
    key: tuple[str, ...] = ("project_slug", "session_id"),
    seq: str | list[str] = "batch_id",
) -> DataFrame:
    """Resolve versions: the start and the project of the first one, the rest of the last one."""
    seq = [seq] if isinstance(seq, str) else seq
    order = F.struct(*seq)
    rest = [c for c in versions.columns if c not in (*key, *seq, "started_at", "project_slug")]
    first = [c for c in ("started_at", "project_slug") if c not in key]
    # values go inside a struct: a NULL of the last version replaces an earlier value
    resolved = versions.groupBy(*key).agg(
        F.min_by(F.struct(*first), order).alias("_first"),
        F.max_by(F.struct(*rest), order).alias("_last"),
    )
    return resolved.select(*key, "_first.*", "_last.*")


def latest_session_per_project(sessions: DataFrame, min_turns: int = MIN_TURNS) -> DataFrame:
    newest = Window.partitionBy("project_slug").orderBy(F.desc("started_at"), "session_id")
    return (
        filter_min_turns(sessions, min_turns)
        .withColumn("_rn", F.row_number().over(newest))
        .filter("_rn = 1")
        .drop("_rn")
    )


# the columns of a listing
LISTED = [
    "session_id", "project_slug", "started_at", "ended_at", "turn_count", "tool_call_freq",
    "git_branch", "cwd",
]


def recent_sessions(
    sessions: DataFrame, slug: str | None = None, limit: int = 10, min_turns: int = MIN_TURNS
) -> DataFrame:
    """Newest sessions by the text of their start; equal starts in id order."""
    kept = filter_min_turns(filter_project(sessions, slug), min_turns)
    columns = [c for c in LISTED if c in sessions.columns]
    return kept.select(*columns).orderBy(F.desc("started_at"), "session_id").limit(limit)


def session_count(sessions: DataFrame, slug: str | None = None) -> DataFrame:
    return filter_project(sessions, slug).agg(F.count("*").alias("n"))


def list_projects(sessions: DataFrame) -> DataFrame:
    return sessions.select("project_slug").distinct().orderBy("project_slug")


def locate_session(ids: DataFrame, sessions: DataFrame) -> DataFrame:
    """Owning project of each session id; the first in sorted order when several own it."""
    owned = sessions.select("session_id", "project_slug").join(
        ids.select("session_id").distinct(), "session_id", "left_semi"
    )
    return owned.groupBy("session_id").agg(F.min("project_slug").alias("project_slug"))
