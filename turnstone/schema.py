"""Table schemas. Timestamps stay ISO text: they are compared and ordered as text."""

from __future__ import annotations

# Place of a line in its transcript; the struct sorts in reading order. Blocks of one file may be
# read by different tasks, and a transcript may arrive in several pieces and batches.
POS = "struct<batch:bigint,mtime:timestamp,piece:string,block:bigint,row:bigint>"

LINES = f"""
    transcript string, pos {POS}, timestamp string, raw_session string, git_branch string,
    cwd string, is_turn boolean, uuid string, parent_uuid string, role string, content string,
    tools array<string>, problem string, project_slug string
"""

_FIRST = f"struct<pos:{POS},value:string>"

PARTIALS = f"""
    transcript string, first_session {_FIRST}, first_ts {_FIRST}, last_ts {_FIRST},
    first_branch {_FIRST}, first_cwd {_FIRST}, turn_count bigint, tool_call_freq map<string,bigint>,
    in_pieces boolean, project_slug string, batch_id bigint, writer string
"""

SESSIONS = """
    session_id string, started_at string, ended_at string, turn_count bigint,
    tool_call_freq map<string,bigint>, git_branch string, cwd string, last_synced_at timestamp,
    seq bigint, project_slug string, batch_id bigint, writer string
"""

MESSAGES = f"""
    uuid string, session_id string, parent_uuid string, timestamp string, role string,
    content string, pos {POS}, norm string, doc_len bigint, project_slug string, batch_id bigint, writer string
"""

TEAM_SESSIONS = f"engineer_id string, {SESSIONS}"
TEAM_MESSAGES = f"engineer_id string, {MESSAGES}"

# what later batches and searches need of the messages without reading them
KEYS = "uuid string, project_slug string, prefix int, batch_id bigint, writer string"
STATS = "project_slug string, n_docs bigint, total_len bigint, batch_id bigint, writer string"

TABLES = {
    "lines": LINES + ", batch_id bigint, writer string",
    "partials": PARTIALS,
    "sessions": SESSIONS,
    "messages": MESSAGES,
    "team_sessions": TEAM_SESSIONS,
    "team_messages": TEAM_MESSAGES,
    "keys": KEYS,
    "team_keys": KEYS,
    "stats": STATS,
    "team_stats": STATS,
}
