from .filters import (
    filter_engineer,
    filter_min_turns,
    filter_not_current,
    filter_not_self,
    filter_project,
    filter_recency,
)
from .joins import salted_join
from .match import Condition, phrase, prefix, term
from .messages import (
    anti_insert,
    first_uuid_wins,
    ingest_stats,
    insert_messages,
    orphan_messages,
    purge_project,
    session_messages,
    transcript,
)
from .parse import keep_line_types, parse_lines, quarantined, route_role, turns, valid_message
from .sessions import (
    latest_session_per_project,
    list_projects,
    locate_session,
    merge_partials,
    recent_sessions,
    session_count,
    session_partials,
    session_rollup,
    tool_freq,
    upsert_sessions,
)

__all__ = [n for n in dir() if not n.startswith("_")]
