"""What happened last time: one text block per project, for all projects in one job."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import cap_block, fmt_iso_short, tools_line, trim_turn
from ..operators.filters import MIN_TURNS, filter_not_current
from ..operators.joins import salted_join
from ..operators.sessions import latest_session_per_project

# fixed values: size limit, its marker, turns kept in full, speaker labels
MAX_CHARS = 12_000
CAP_MARK = "[…trimmed for context budget…]"
FULL_TURNS = 2 * 2
LABELS = {"user": "User", "assistant": "Claude"}
# the shortest header, and what the shortest turn adds: its label, mark-up and two line breaks
_HEADER_CHARS = len("### Previous session ()")
_TURN_CHARS = len("**User:** ") + 2

_KEY = ["project_slug", "session_id"]


def _turn_order(messages: DataFrame) -> list[str]:
    return ["timestamp", "pos"] if "pos" in messages.columns else ["timestamp", "uuid"]


def tail_turns_full(messages: DataFrame, max_chars: int | None = MAX_CHARS) -> DataFrame:
    """Mark the last turns of each session and keep the first ones that can fill the block.

    The block is cut at ``max_chars``, and every turn adds at least ``_TURN_CHARS``, so later turns
    cannot show. Dropping them here loses nothing and bounds what one session sends to one task;
    the row-number limit is also applied before the shuffle. Without ``max_chars`` all turns stay.
    """
    order = Window.partitionBy(*_KEY).orderBy(*_turn_order(messages))
    counts = messages.groupBy(*_KEY).agg(F.count("*").alias("_turns"))
    numbered = messages.withColumn("nr", F.row_number().over(order))
    if max_chars is not None:
        numbered = numbered.filter(F.col("nr") <= max(1, -(-(max_chars - _HEADER_CHARS) // _TURN_CHARS)))
    return (
        numbered.join(counts, _KEY)  # few rows per session by now, already grouped by it
        .withColumn("is_full", F.col("nr") > F.col("_turns") - FULL_TURNS)
        .drop("_turns")
    )


def digest_text(turns: DataFrame, max_chars: int | None = MAX_CHARS) -> DataFrame:
    """Rendered turns of a session, in order."""
    label = F.when(F.col("role") == "user", LABELS["user"]).otherwise(LABELS["assistant"])
    body = trim_turn("content", F.col("is_full"))
    if max_chars is not None:
        body = F.substring(body, 1, max_chars + 1)
    line = F.concat(F.lit("**"), label, F.lit(":** "), body)
    listed = F.array_sort(F.collect_list(F.struct("nr", line.alias("line"))))
    return turns.groupBy(*_KEY).agg(
        F.array_join(F.transform(listed, lambda t: F.concat(t["line"], F.lit("\n"))), "\n").alias("body")
    )


def session_digest(
    sessions: DataFrame,
    messages: DataFrame,
    current: DataFrame | None = None,
    min_turns: int = MIN_TURNS,
    max_chars: int | None = MAX_CHARS,
) -> DataFrame:
    """``(project_slug, session_id, text)`` of every project's newest session.

    ``current(session_id)`` names running sessions: a project whose newest session is one of them
    gets no digest. Sessions without messages give none either. ``max_chars=None`` gives the whole digest.
    """
    chosen = latest_session_per_project(sessions, min_turns)
    if current is not None:
        chosen = filter_not_current(chosen, current)
    said = salted_join(messages, chosen.select(*_KEY), _KEY, ["uuid"])
    turns = digest_text(tail_turns_full(said, max_chars), max_chars)
    branch = F.coalesce(F.nullif("git_branch", F.lit("")), F.lit(""))
    header = F.concat(
        F.lit("### Previous session ("),
        fmt_iso_short("started_at"),
        F.when(branch != "", F.concat(F.lit(" on `"), branch, F.lit("`"))).otherwise(F.lit("")),
        F.lit(")\n\n"),
    )
    tools = F.coalesce(F.concat(tools_line("tool_call_freq"), F.lit("\n\n")), F.lit(""))
    whole = F.concat(header, tools, F.col("body"))
    text = whole if max_chars is None else cap_block(whole, max_chars, CAP_MARK)
    return chosen.join(turns, _KEY).select(*_KEY, text.alias("text"))
