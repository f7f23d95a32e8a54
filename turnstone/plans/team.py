"""The shared corpus: what the others did, and search over everybody's messages."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.rank import team_rank
from ..functions.text import cap_block, fmt_iso_short, preview
from ..operators.filters import LOOKBACK_DAYS, MIN_TURNS, filter_engineer, filter_min_turns, is_recent
from ..operators.match import Condition
from ..session import evaluated_once
from .search import _scored, _tidy, _with_texts

# fixed values: how many are fetched and shown, size limit and its marker
FETCHED = 30
SHOWN = 10
MAX_CHARS = 3_000
CAP_MARK = "[…trimmed…]"

_LISTED = [
    "session_id", "engineer_id", "project_slug", "started_at", "ended_at", "turn_count", "git_branch", "cwd",
]


def team_recent(
    sessions: DataFrame,
    limit: int = 10,
    engineer: str | None = None,
    slug: str | None = None,
    min_turns: int = MIN_TURNS,
) -> DataFrame:
    kept = filter_min_turns(filter_engineer(sessions, engineer, slug), min_turns)
    columns = [c for c in _LISTED if c in sessions.columns]
    return kept.select(*columns).orderBy(F.desc("started_at"), "session_id").limit(limit)


def _candidates(sessions: DataFrame, recent: Column, fetch_limit: int | None, shown: int) -> DataFrame:
    """The few sessions any viewer can see.

    With a fetch limit these are the newest ones. Without it nobody sees more than ``shown`` of one
    engineer, and one engineer is the only one a viewer skips: ``shown`` per engineer, then
    ``2 * shown`` overall, hold every viewer's list.
    """
    if fetch_limit is not None:
        return team_recent(sessions, fetch_limit).filter(recent)
    newest = Window.partitionBy("engineer_id").orderBy(F.desc("started_at"), "session_id")
    some = (
        filter_min_turns(sessions)
        .filter(recent)
        .withColumn("_rn", F.row_number().over(newest))
        .filter(F.col("_rn") <= shown)
        .drop("_rn")
    )
    return team_recent(some, 2 * shown)


def _entry() -> Column:
    """Two lines about one session, shown by its end time."""
    ended = F.coalesce(F.nullif("ended_at", F.lit("")), F.col("started_at"), F.lit(""))
    branch = F.coalesce(F.nullif("git_branch", F.lit("")), F.lit(""))
    return F.concat(
        F.lit("- ["),
        fmt_iso_short(ended),
        F.lit("] **"),
        F.coalesce("engineer_id", F.lit("?")),
        F.lit("**"),
        F.when(branch != "", F.concat(F.lit(" on `"), branch, F.lit("`"))).otherwise(F.lit("")),
        F.lit(" ("),
        F.coalesce(F.col("turn_count"), F.lit(0)).cast("string"),
        F.lit(" turns)\n   project: "),
        F.coalesce(F.nullif("project_slug", F.lit("")), F.lit("?")),
    )


def team_activity(
    sessions: DataFrame,
    viewers: DataFrame,
    as_of: datetime | str,
    days: int = LOOKBACK_DAYS,
    fetch_limit: int | None = None,
    shown: int = SHOWN,
    max_chars: int = MAX_CHARS,
) -> DataFrame:
    """``(viewer, text)`` of what others did lately, for every viewer at once.

    ``fetch_limit=FETCHED`` looks at the newest sessions of the whole corpus only, before any other filter. The
    candidates are a bounded list. They reach the viewers as one scalar subquery, so viewers
    are neither joined nor shuffled. Viewers with nothing to see get no row.
    """
    few = _candidates(sessions, is_recent(as_of, days), fetch_limit, shown)
    entry = F.struct(
        "started_at",
        "session_id",
        F.coalesce("engineer_id", F.lit("?")).alias("engineer_id"),
        _entry().alias("entry"),
    )
    newest_first = F.array_sort(
        F.collect_list(entry),
        lambda a, b: F.when(a["started_at"] > b["started_at"], -1)
        .when(a["started_at"] < b["started_at"], 1)
        .when(a["session_id"] < b["session_id"], -1)
        .when(a["session_id"] > b["session_id"], 1)
        .otherwise(0),
    )
    others = F.slice(
        F.filter(F.col("_few"), lambda s: ~s["engineer_id"].eqNullSafe(F.col("viewer"))), 1, shown
    )
    header = f"Recent team activity (other engineers, last {days} days):\n\n"
    lines = F.array_join(F.transform(F.col("_others"), lambda s: s["entry"]), "\n")
    seen = viewers.select("viewer").withColumn("_few", few.agg(newest_first).scalar())
    return (
        evaluated_once(seen.select("viewer", others.alias("_others")))
        .filter(F.size("_others") > 0)
        .select("viewer", cap_block(F.concat(F.lit(header), lines), max_chars, CAP_MARK).alias("text"))
    )


def team_search(
    messages: DataFrame,
    sessions: DataFrame,
    condition: Condition,
    engineer: str | None = None,
    slug: str | None = None,
    limit: int = 10,
    stemmed: bool = True,
    stats: DataFrame | None = None,
) -> DataFrame:
    """Best messages of the whole team. Statistics are those of the whole corpus, whatever the
    engineer and project filters; exclude a term with ``cond & ~term(...)``. ``stats``: ``Store.search_stats(team=True)``."""
    hits, _ = _scored(messages, condition, (), stemmed, stats)
    top = _with_texts(messages, filter_engineer(hits, engineer, slug).orderBy("score", "uuid").limit(limit))
    branches = sessions.select("session_id", "git_branch")
    return (
        _tidy(top)
        .join(branches, "session_id")
        .select(
            F.col("timestamp").alias("ts"),
            "engineer_id",
            "project_slug",
            "git_branch",
            team_rank("score").alias("rank"),
            preview("content").alias("content_preview"),
            "session_id",
            "role",
        )
        .orderBy(F.desc("rank"), "session_id", "ts")
    )
