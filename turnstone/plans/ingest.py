"""Transcripts -> stored sessions and messages, and optionally the team's tables."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.redact import Rule
from ..operators.messages import ingest_stats, insert_messages, with_search_columns
from ..operators.parse import parse_lines, quarantined, turns
from ..operators.sessions import finish_sessions, merge_partials, session_partials
from ..sources.store import Store

_ORDER = ("session_id", "timestamp")


@dataclass
class Ingested:
    """What one batch did."""

    stats: DataFrame
    quarantine: DataFrame
    team: DataFrame | None = None  # the stats of the team tables


def _stage(store: Store, raw: DataFrame, rules: list[Rule] | None, batch_id: int) -> DataFrame:
    """Parse once. The redacted lines are written to the shared store and both branches read them
    back, column-pruned; a lost executor costs no second parse."""
    store.write("lines", parse_lines(raw, rules), batch_id)
    return store.read("lines", only=batch_id)


def _sessions(store: Store, lines: DataFrame, batch_id: int, in_pieces: bool) -> DataFrame:
    """Sessions the batch touches; none without a turn. Pieces are put together with what this writer has seen of
    their transcripts in other batches."""
    key = ["project_slug", "transcript"]
    partials = session_partials(lines).withColumn("in_pieces", F.lit(in_pieces))
    mixed = store.read("partials", others=batch_id).filter(F.col("in_pieces") != in_pieces)
    clash = mixed.join(partials.select(*key), key, "left_semi").select(*key).first()
    if clash is not None:
        raise ValueError(f"{clash.project_slug}/{clash.transcript} is stored both whole and in pieces")
    store.write("partials", partials, batch_id)
    own = store.read("partials", only=batch_id)
    if in_pieces:
        seen = store.read("partials").filter((F.col("batch_id") <= batch_id) & (F.col("writer") == store.writer))
        own = merge_partials(seen.join(own.select(*key), key, "left_semi"))
    return finish_sessions(own).filter("turn_count > 0")


def ingest(
    store: Store,
    raw: DataFrame,
    batch_id: int,
    rules: list[Rule] | None = None,
    engineer: str | Column | None = None,
    in_pieces: bool = False,
) -> Ingested:
    """Store a batch of transcripts.

    ``in_pieces`` says that a batch may hold the continuation of earlier transcripts (streams);
    otherwise a transcript is read whole, as often as it grows. One transcript cannot be both. Re-reading
    changes nothing but the session's end, counts, branch and directory. A message id belongs to the batch that
    stored it first; a batch that runs again keeps its own and leaves those of all others. With an ``engineer``
    the same rows also go to the team tables; either target is tried when the other fails.
    """
    lines = _stage(store, raw, rules, batch_id)
    sessions = _sessions(store, lines, batch_id, in_pieces)
    said = turns(lines, sessions)

    failures, team = [], None
    try:
        _store_local(store, sessions, said, batch_id)
    except Exception as failure:  # the other target still runs; raised below
        failures.append(failure)
    if engineer is not None:
        try:
            team = publish_team(store, sessions, said, batch_id, engineer)
        except Exception as failure:
            failures.append(failure)
    if failures:
        raise failures[0] if len(failures) == 1 else ExceptionGroup("neither target was stored", failures)
    inserted = store.read("messages", only=batch_id)
    return Ingested(ingest_stats(said, inserted), quarantined(lines), team)


def _store_local(store: Store, sessions: DataFrame, said: DataFrame, batch_id: int) -> None:
    new = insert_messages(said, store.stored_keys("messages", said, batch_id))
    staged = store.stage_messages("messages", with_search_columns(new).drop("transcript"), batch_id, _ORDER)
    store.publish([*staged, store.stage("sessions", _stamped(sessions, batch_id), batch_id, ("session_id",))])


def publish_team(
    store: Store, sessions: DataFrame, said: DataFrame, batch_id: int, engineer: str | Column
) -> DataFrame:
    """The same rows tagged with the engineer. A message id counts once in the whole corpus.

    Returns what was pushed: ``session_id``, ``messages_inserted``, ``messages_total``.
    """
    who = engineer if isinstance(engineer, Column) else F.lit(engineer)
    new = insert_messages(
        said.withColumn("engineer_id", who), store.stored_keys("team_messages", said, batch_id), key=("uuid",)
    )
    staged = store.stage_messages("team_messages", with_search_columns(new).drop("transcript"), batch_id, _ORDER)
    tagged = _stamped(sessions, batch_id).withColumn("engineer_id", who)
    store.publish([*staged, store.stage("team_sessions", tagged, batch_id, ("session_id",))])
    return ingest_stats(said, store.read("team_messages", only=batch_id))


def _stamped(sessions: DataFrame, batch_id: int) -> DataFrame:
    return sessions.drop("transcript").withColumns(
        {"last_synced_at": F.current_timestamp(), "seq": F.lit(batch_id).cast("bigint")}
    )
