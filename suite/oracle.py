"""The same rows in SQL (DuckDB), one statement per query."""

from __future__ import annotations

from turnstone.functions.text import WHITESPACE

from .queries import JWT, KEYWORDS
from .stem_sql import STEMS

ORACLE: dict[str, str] = {}
WS = "'" + WHITESPACE + "'"
ISO = "'%Y-%m-%dT%H:%M:%SZ'"


def strip(x: str) -> str:
    return f"trim({x}, {WS})"


def minutes(x: str) -> str:
    return f"strftime(TIMESTAMP '2024-01-01' + to_minutes({x}), {ISO})"


# ---------------------------------------------------------------- transcripts

TALK = f"""talk AS (
    SELECT 'p' || (conv_id % 4) AS project_slug, 'c' || conv_id AS session_id, conv_id, turn, role,
           text, {minutes("conv_id * 20 + turn")} AS ts
    FROM conversations)"""
SAID = f"""{TALK}, said AS (
    SELECT 'c' || conv_id || '-' || turn AS uuid, session_id,
           CASE WHEN turn > 0 THEN 'c' || conv_id || '-' || (turn - 1) END AS parent_uuid,
           ts AS "timestamp", role, {strip("text")} AS content, project_slug
    FROM talk WHERE role IN ('user', 'assistant') AND {strip("text")} <> '')"""
MESSAGES = f"WITH {SAID} SELECT * FROM said"
TALK_TOOLS = f"""uses AS (
    SELECT session_id, 'Tool' || (turn % 3) AS tool, count(*) AS n
    FROM talk WHERE role = 'assistant' GROUP BY ALL)"""
TALK_SESSIONS = f"""{SAID}, {TALK_TOOLS}, sessions AS (
    SELECT t.session_id, t.project_slug, arg_min(ts, turn) AS started_at, arg_max(ts, turn) AS ended_at,
           count(*) FILTER (role IN ('user', 'assistant') AND {strip("text")} <> '') AS turn_count,
           CASE WHEN max(turn) > 0 THEN 'b' || (any_value(conv_id) % 3) END AS git_branch,
           '/work/' || t.project_slug AS cwd
    FROM talk t GROUP BY t.session_id, t.project_slug)"""
TOOL_JSON = """'{' || string_agg('"' || tool || '":' || n, ',' ORDER BY tool) || '}'"""
STORED_SESSIONS = f"""WITH {TALK_SESSIONS}
    SELECT s.session_id, project_slug, started_at, ended_at, turn_count,
           coalesce((SELECT {TOOL_JSON} FROM uses u WHERE u.session_id = s.session_id), '{{}}') AS tools,
           git_branch, cwd
    FROM sessions s"""

for name in (
    "parse_messages", "scan_transcripts", "ingest_twice", "ingest_replay", "stream_ingest_messages", "stream_after_batch",
):
    ORACLE[name] = MESSAGES
ORACLE["publish_team"] = f"WITH {SAID} SELECT 'ann' AS engineer_id, * FROM said"
ORACLE["session_rollup"] = STORED_SESSIONS
ORACLE["stored_sessions"] = STORED_SESSIONS + " WHERE turn_count > 0"
# lines of which most lack something
ODD = "odd AS (SELECT 'c' || conv_id AS transcript, turn, role, text, conv_id, (conv_id + turn) % 8 AS k FROM conversations)"
ORACLE["keep_line_types"] = f"WITH {ODD} SELECT transcript, turn FROM odd WHERE k <> 7 AND role IN ('user', 'assistant')"
ORACLE["valid_message"] = f"WITH {ODD} SELECT transcript, turn FROM odd WHERE k IN (0, 4, 5, 6, 7)"
ORACLE["route_role"] = f"""WITH {ODD} SELECT transcript, turn, CASE WHEN k = 7 THEN 'user' ELSE role END AS role FROM odd
    WHERE k = 7 OR k IN (0, 1, 2, 6) AND role IN ('user', 'assistant')"""
ORACLE["drop_empty_turns"] = f"""WITH {ODD} SELECT transcript, turn FROM odd
    WHERE k = 0 AND role IN ('user', 'assistant') AND {strip("text")} <> ''"""
ORACLE["push_result"] = f"""WITH {SAID} SELECT session_id, count(*) FILTER (split_part(uuid, '-', 2)::INT % 3 <> 0) AS messages_inserted,
    count(*) AS messages_total FROM said GROUP BY session_id"""
ORACLE["compacted_store"] = MESSAGES + " WHERE project_slug <> 'p3'"
ORACLE["ingest_requests"] = MESSAGES + " WHERE CAST(substr(session_id, 2) AS BIGINT) % 3 < 2"
ORACLE["stored_projects"] = f"WITH {SAID} SELECT DISTINCT project_slug FROM said"
ORACLE["extract_text"] = f"""WITH {TALK} SELECT project_slug, session_id AS transcript, turn,
    CASE WHEN role = 'assistant' AND {strip("text")} = '' THEN '' ELSE text END AS content FROM talk"""
ORACLE["parent_if_string"] = f"""WITH {ODD} SELECT transcript, turn,
    CASE WHEN turn > 0 AND k <> 5 THEN 'c' || conv_id || '-' || (turn - 1) END AS parent_uuid FROM odd"""
ORACLE["quarantine"] = f"""SELECT source AS project_slug,
    CASE WHEN json_valid({strip("text")}) THEN 'not an object' ELSE 'not json' END AS problem, count(*) AS n
    FROM documents WHERE {strip("text")} <> '' GROUP BY ALL"""
ORACLE["tool_use_names"] = f"""WITH {TALK} SELECT project_slug, 'Tool' || (turn % 3) AS tool, count(*) AS n
    FROM talk WHERE role = 'assistant' GROUP BY ALL"""
_SHOWN = 'project_slug, session_id, uuid, parent_uuid, "timestamp", role, content'
ORACLE["transcript"] = f"WITH {SAID} SELECT {_SHOWN} FROM said"
ORACLE["transcript_head"] = f"""WITH {SAID} SELECT {_SHOWN} FROM said
    QUALIFY row_number() OVER (PARTITION BY session_id ORDER BY "timestamp") <= 2"""
ORACLE["latest_transcript"] = f"""WITH {TALK} SELECT DISTINCT project_slug, session_id, session_id AS found FROM talk"""

# ---------------------------------------------------------------- events

EVENTS = f"""ev AS (
    SELECT event_id, 'u' || user_id AS engineer_id, 'p' || (user_id % 5) AS project_slug,
           'u' || user_id || '-' || strftime(ts, '%Y%m%d') AS session_id,
           CASE WHEN user_id % 7 <> 0 THEN 'b' || (user_id % 3) END AS git_branch,
           '/work/p' || (user_id % 5) AS cwd, strftime(ts, {ISO}) AS stamp, event_type AS tool
    FROM events)"""
EVENT_SESSIONS = f"""{EVENTS}, sessions AS (
    SELECT session_id, project_slug, engineer_id, git_branch, cwd, min(stamp) AS started_at,
           max(stamp) AS ended_at, count(*) AS turn_count
    FROM ev GROUP BY ALL)"""
EVENT_TOOLS = f"""{EVENTS}, uses AS (
    SELECT project_slug, session_id, tool, count(*) AS n FROM ev GROUP BY ALL)"""
LISTED = "session_id, project_slug, started_at, ended_at, turn_count, git_branch"

ORACLE["tool_freq"] = f"""WITH {EVENT_TOOLS}
    SELECT project_slug, session_id, {TOOL_JSON} AS tools FROM uses GROUP BY ALL"""
ORACLE["top_tools"] = f"""WITH {EVENT_TOOLS}
    SELECT session_id, 'Tools used: ' || string_agg(tool || ' ×' || n, ', ' ORDER BY n DESC, tool) AS line
    FROM (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY n DESC, tool) AS r FROM uses)
    WHERE r <= 6 GROUP BY session_id"""
ORACLE["event_rollup"] = ORACLE["merge_partials"] = f"""WITH {EVENT_SESSIONS}, uses AS (
    SELECT session_id, tool, count(*) AS n FROM ev GROUP BY ALL), bounds AS (
    SELECT session_id, arg_min(stamp, event_id) AS started_at, arg_max(stamp, event_id) AS ended_at
    FROM ev GROUP BY ALL)
    SELECT s.session_id, project_slug, b.started_at, b.ended_at, turn_count, u.tools, git_branch, cwd
    FROM sessions s JOIN bounds b USING (session_id)
    JOIN (SELECT session_id, {TOOL_JSON} AS tools FROM uses GROUP BY ALL) u USING (session_id)"""


def listing(tail: str, columns: str = LISTED) -> str:
    return f"WITH {EVENT_SESSIONS} SELECT {columns} FROM sessions {tail}"


ORACLE["recent_sessions"] = listing("WHERE turn_count >= 2 ORDER BY started_at DESC, session_id LIMIT 10")
ORACLE["recent_sessions_project"] = listing(
    "WHERE turn_count >= 3 AND project_slug = 'p1' ORDER BY started_at DESC, session_id LIMIT 20"
)
ORACLE["filter_min_turns"] = listing("WHERE turn_count >= 4")
ORACLE["session_count"] = listing("", "count(*) AS n")
ORACLE["session_count_project"] = listing("WHERE project_slug = 'p2'", "count(*) AS n")
ORACLE["list_projects"] = listing("", "DISTINCT project_slug")
_LATEST = """WHERE turn_count >= 2
    QUALIFY row_number() OVER (PARTITION BY project_slug ORDER BY started_at DESC, session_id) = 1"""
ORACLE["latest_session_per_project"] = listing(_LATEST)
ORACLE["filter_not_current"] = f"""SELECT * FROM ({listing(_LATEST)}) WHERE session_id NOT IN (
    WITH {EVENT_SESSIONS} SELECT arg_max(session_id, ended_at) FROM sessions)"""
ORACLE["filter_recency"] = listing("WHERE ended_at >= '2024-01-24T00:00:00Z'")
ORACLE["filter_engineer"] = listing("WHERE engineer_id = 'u7' AND project_slug = 'p2'")
ORACLE["filter_not_self"] = listing("WHERE engineer_id <> 'u7' GROUP BY project_slug", "project_slug, count(*) AS n")
ORACLE["upsert_sessions"] = f"""WITH {EVENTS}, versions AS (
    SELECT session_id, project_slug, event_id % 2 AS b, min(stamp) AS started_at, max(stamp) AS ended_at,
           count(*) AS turn_count,
           CASE WHEN event_id % 2 = 0 THEN coalesce(git_branch, 'main') ELSE git_branch END AS git_branch
    FROM ev GROUP BY ALL)
    SELECT v.session_id, v.project_slug, f.started_at, v.ended_at, v.turn_count, v.git_branch
    FROM versions v JOIN versions f USING (session_id)
    WHERE v.b = (SELECT max(b) FROM versions x WHERE x.session_id = v.session_id)
      AND f.b = (SELECT min(b) FROM versions x WHERE x.session_id = v.session_id)"""
ORACLE["team_recent"] = listing(
    "WHERE turn_count >= 2 ORDER BY started_at DESC, session_id LIMIT 30", "engineer_id, " + LISTED
)


def activity(source: str) -> str:
    entry = """'- [' || replace(ended_at[:16], 'T', ' ') || '] **' || engineer_id || '**'
        || coalesce(' on `' || git_branch || '`', '') || ' (' || turn_count || ' turns)'
        || chr(10) || '   project: ' || project_slug"""
    block = f"""'Recent team activity (other engineers, last 7 days):' || chr(10) || chr(10)
        || string_agg({entry}, chr(10) ORDER BY started_at DESC, session_id)"""
    return f"""WITH {EVENT_SESSIONS}, few AS ({source}),
    viewers AS (SELECT DISTINCT engineer_id AS viewer FROM sessions), ranked AS (
        SELECT viewer, few.*, row_number() OVER (PARTITION BY viewer ORDER BY started_at DESC, session_id) AS r
        FROM viewers JOIN few ON engineer_id <> viewer WHERE ended_at >= '2024-01-24T00:00:00Z')
    SELECT viewer, CASE WHEN length(t) > 3000
               THEN rtrim(left(t, 3000), {WS}) || chr(10) || chr(10) || '[…trimmed…]' ELSE t END AS text
    FROM (SELECT viewer, {block} AS t FROM ranked WHERE r <= 10 GROUP BY viewer)"""


ORACLE["team_activity_fetched"] = activity(
    "SELECT * FROM sessions WHERE turn_count >= 2 ORDER BY started_at DESC, session_id LIMIT 30"
)
ORACLE["team_activity"] = ORACLE["team_activity_unlimited"] = activity("SELECT * FROM sessions WHERE turn_count >= 2")

# ---------------------------------------------------------------- documents as messages

DOC_SESSIONS = f"""dm AS (
    SELECT doc_id::VARCHAR AS uuid, source || '/' || lang AS session_id, {minutes("doc_id")} AS ts,
           source AS project_slug, lang, text FROM documents), ds AS (
    SELECT session_id, project_slug, lang AS git_branch, min(ts) AS started_at, max(ts) AS ended_at,
           count(*) AS turn_count FROM dm GROUP BY ALL)"""
LATEST_DOC = """SELECT * FROM ds WHERE turn_count >= 2
    QUALIFY row_number() OVER (PARTITION BY project_slug ORDER BY started_at DESC, session_id) = 1"""
ORACLE["locate_session"] = "SELECT lang AS session_id, min(source) AS project_slug FROM documents GROUP BY lang"
ORACLE["session_messages"] = f"""WITH {DOC_SESSIONS}
    SELECT project_slug, session_id, uuid, ts AS "timestamp" FROM dm
    WHERE session_id IN (SELECT session_id FROM ({LATEST_DOC}))"""
ORACLE["purge_project"] = f"""WITH {DOC_SESSIONS}
    SELECT uuid, project_slug, session_id FROM dm WHERE project_slug <> 'src3'"""
ORACLE["orphan_messages"] = f"WITH {DOC_SESSIONS} SELECT uuid, project_slug, session_id FROM dm WHERE lang = 'fr'"
ORACLE["emit_json"] = f"""WITH {DOC_SESSIONS}
    SELECT '{{"session_id":"' || session_id || '","project_slug":"' || project_slug || '","started_at":"'
        || started_at || '","turn_count":' || turn_count || '}}' AS json FROM ds"""
ORACLE["first_uuid_wins"] = ORACLE["stream_dedup_documents"] = (
    "SELECT md5(text) AS uuid, min(doc_id) AS doc_id FROM documents GROUP BY 1"
)
ORACLE["insert_messages"] = """SELECT md5(text) AS uuid, min(doc_id) AS doc_id FROM documents
    WHERE md5(text) NOT IN (SELECT md5(text) FROM documents WHERE lang = 'en') GROUP BY 1"""
ORACLE["ingest_stats"] = """WITH d AS (
    SELECT lang, doc_id, min(doc_id) OVER (PARTITION BY md5(text)) AS first FROM documents)
    SELECT lang AS session_id, count(*) FILTER (doc_id = first) AS messages_inserted,
           count(*) AS messages_total FROM d GROUP BY lang"""


def turn_lines(source: str, label: str) -> str:
    """Rendered turns of every session of ``source(session_id, ts, content)``."""
    return f"""numbered AS (
        SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY ts DESC) AS back FROM {source}),
    bodies AS (
        SELECT session_id, string_agg('**' || {label} || ':** ' || CASE WHEN back <= 4 OR length(content) <= 600
            THEN content ELSE rtrim(left(content, 600), {WS}) || ' […]' END || chr(10), chr(10) ORDER BY ts) AS body
        FROM numbered GROUP BY session_id)"""


def capped(block: str) -> str:
    mark = "chr(10) || chr(10) || '[…trimmed for context budget…]'"
    return f"CASE WHEN length({block}) > 12000 THEN rtrim(left({block}, 12000), {WS}) || {mark} ELSE {block} END"


_HEADER = """'### Previous session (' || replace(started_at[:16], 'T', ' ')
    || coalesce(' on `' || git_branch || '`', '') || ')' || chr(10) || chr(10)"""
ORACLE["session_digest"] = f"""WITH {TALK_SESSIONS}, latest AS (
        SELECT * FROM sessions WHERE turn_count >= 2
        QUALIFY row_number() OVER (PARTITION BY project_slug ORDER BY started_at DESC, session_id) = 1),
    mine AS (SELECT session_id, "timestamp" AS ts, role, content FROM said),
    {turn_lines("mine", "CASE WHEN role = 'user' THEN 'User' ELSE 'Claude' END")},
    blocks AS (
        SELECT project_slug, session_id, {_HEADER} || coalesce((
            SELECT 'Tools used: ' || string_agg(tool || ' ×' || n, ', ' ORDER BY n DESC, tool)
            FROM uses u WHERE u.session_id = latest.session_id) || chr(10) || chr(10), '') || body AS b
        FROM latest JOIN bodies USING (session_id))
    SELECT project_slug, session_id, {capped("b")} AS text FROM blocks"""
ORACLE["document_digest"] = f"""WITH {DOC_SESSIONS}, latest AS ({LATEST_DOC}),
    mine AS (SELECT session_id, ts, text AS content FROM dm),
    {turn_lines("mine", "'User'")},
    blocks AS (SELECT project_slug, session_id, {_HEADER} || body AS b FROM latest JOIN bodies USING (session_id))
    SELECT project_slug, session_id, {capped("b")} AS text FROM blocks"""

# ---------------------------------------------------------------- text

_REDACTED = f"text || ' key {JWT}'"
for _pattern, _with in (
    (r"[A-Za-z0-9._%+-]+@([A-Za-z0-9.-]+\.[A-Za-z]{2,})", r"<USER>@\1"),
    (r'(token = ")[0-9a-f]{40}(")', r"\1<TOKEN>\2"),
    (r"[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}", "<IP>"),
    (r"eyJ[A-Za-z0-9_-]{10,}\.eyJ[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{20,}", "<JWT-REDACTED>"),
):
    _REDACTED = f"regexp_replace({_REDACTED}, '{_pattern}', '{_with}', 'g')"
ORACLE["redact_documents"] = ORACLE["stream_redact_documents"] = f"SELECT doc_id, {_REDACTED} AS text FROM documents"
ORACLE["strip_text"] = f"SELECT doc_id, {strip('text')} AS text FROM documents"
ORACLE["slugify_names"] = r"""SELECT p_partkey, trim(regexp_replace(lower('  ' || p_name || '__' || p_brand
    || '!! ' || p_type), '[^\p{L}\p{N}]+', '-', 'g'), '-') AS slug FROM part"""
ORACLE["user_ids"] = """SELECT s_suppkey, trim(regexp_replace(lower(s_name), '[^a-z0-9]+', '-', 'g'), '-') AS user_id
    FROM supplier"""
ORACLE["fmt_short"] = """SELECT event_id, strftime(ts, '%Y-%m-%d %H:%M') AS long_form,
    strftime(ts, '%Y-%m-%d 00:00') AS day_form, left('at ' || strftime(ts, '%Y-%m-%dT%H:%M'), 16) AS unreadable
    FROM events"""
ORACLE["fmt_team"] = "SELECT event_id, strftime(ts, '%Y-%m-%d %H:%M') AS shown FROM events"
ORACLE["slug_from_cwd"] = r"""SELECT p_partkey, CASE WHEN p_size > 25 THEN p_type
    ELSE ltrim(translate('C:\src/' || p_brand || '\' || p_name, '\/:', '---'), '-') END AS slug FROM part"""
ORACLE["slug_from_path"] = """WITH p AS (
    SELECT page_id, url || '.jsonl' AS path FROM pages)
    SELECT page_id, regexp_extract(path, '([^/]+)/[^/]+$', 1) AS slug,
           regexp_extract(path, '([^/]+?)(?:\\.[^./]*)?$', 1) AS session FROM p"""
ORACLE["trim_turns"] = f"""SELECT conv_id, turn, CASE WHEN turn > 3 OR length(text) <= 600 THEN text
    ELSE rtrim(left(text, 600), {WS}) || ' […]' END AS text FROM conversations"""
ORACLE["cap_block"] = f"""SELECT doc_id, CASE WHEN length(text) > 3000
    THEN rtrim(left(text, 3000), {WS}) || chr(10) || chr(10) || '[…trimmed…]' ELSE text END AS text FROM documents"""
ORACLE["preview"] = "SELECT doc_id, replace(left(text, 200), chr(10), ' ') AS preview FROM documents"

# ---------------------------------------------------------------- search

TOKENS = r"regexp_extract_all(strip_accents(lower(text)), '[\p{L}\p{N}]+')"
DOCS = f"docs AS (SELECT doc_id::VARCHAR AS uuid, source, lang, text, {TOKENS} AS tok FROM documents)"
ORACLE["tokenize"] = f"SELECT word, count(*) AS n FROM (SELECT unnest({TOKENS}) AS word FROM documents) GROUP BY word"
ORACLE["corpus_stats"] = f"""WITH {DOCS} SELECT source AS project_slug, count(*) AS n_docs,
    round(avg(len(tok)), 6) AS avg_len FROM docs GROUP BY source"""


def word(w: str) -> str:
    return f"len(list_filter(tok, lambda x: x = '{w}'))"


def starts(w: str) -> str:
    return f"len(list_filter(tok, lambda x: starts_with(x, '{w}')))"


def pair(a: str, b: str) -> str:
    return f"len(list_filter(range(1, len(tok)), lambda i: tok[i] = '{a}' AND tok[i + 1] = '{b}'))"


def scored(tfs: list[str], holds: str, counts: list[str] | None = None, by: str = "source", docs: str = DOCS) -> str:
    """``hits(uuid, source, lang, text, score)``; conditions name the counts ``t0, t1, …``."""
    counts = counts or ["true"] * len(tfs)
    cols = ", ".join(f"{tf} AS t{k}" for k, tf in enumerate(tfs))
    dfs = ", ".join(f"count(*) FILTER (t{k} > 0) AS d{k}" for k in range(len(tfs)))
    shares = " + ".join(
        f"""CASE WHEN t{k} > 0 AND ({c}) THEN
            -(CASE WHEN n + 0.5 > 2 * d{k} + 0.5 AND ln((n - d{k} + 0.5) / (d{k} + 0.5)) > 0
              THEN ln((n - d{k} + 0.5) / (d{k} + 0.5)) ELSE 1e-6 END)
            * (t{k} * 2.2) / (t{k} + 1.2 * (0.25 + 0.75 * len(tok) / al)) ELSE 0 END"""
        for k, c in enumerate(counts)
    )
    return f"""{docs}, counted AS (SELECT *, {cols} FROM docs), stats AS (
        SELECT {by} AS part, count(*)::DOUBLE AS n, avg(len(tok)) AS al, {dfs} FROM counted GROUP BY part), hits AS (
        SELECT uuid, source, lang, text, {shares} AS score
        FROM counted JOIN stats ON part = {by} WHERE {holds})"""


def found(*args, **kw) -> str:
    return f"WITH {scored(*args, **kw)} SELECT source AS project_slug, uuid, round(score, 6) AS score FROM hits"


ORACLE["search_term"] = found([word("thble")], "t0 > 0")
ORACLE["search_or"] = found([word("erin"), word("thor"), word("des")], "t0 > 0 OR t1 > 0 OR t2 > 0")
ORACLE["search_and_not"] = found(
    [word("ther"), word("tion"), word("est")], "t0 > 0 AND t1 > 0 AND NOT t2 > 0", ["true", "true", "false"]
)
ORACLE["search_nested"] = found(
    [word("ble"), word("thth"), word("des"), pair("de", "la")],
    "(t0 > 0 AND t1 > 0) OR (t2 > 0 AND t3 = 0)",
    ["t0 > 0 AND t1 > 0", "t0 > 0 AND t1 > 0", "t3 = 0", "false"],
)
ORACLE["search_phrase"] = found([pair("of", "the")], "t0 > 0")
ORACLE["search_prefix"] = found([starts("thon")], "t0 > 0")
ORACLE["topk_per_project"] = f"""WITH {scored([word("than"), word("erin")], "t0 > 0 OR t1 > 0")}
    SELECT source AS project_slug, uuid, round(score, 6) AS score FROM hits
    QUALIFY row_number() OVER (PARTITION BY source ORDER BY score, uuid) <= 3"""


def best(hits: str, where: str, limit: int) -> str:
    return f"""WITH {DOC_SESSIONS}, {hits}, top AS (
        SELECT * FROM hits WHERE {where} ORDER BY score, uuid LIMIT {limit})
    SELECT t.uuid AS message_uuid, m.session_id, m.ts AS "timestamp", 'user' AS role, m.project_slug,
           s.started_at AS session_started_at, s.git_branch, round(t.score, 6) AS score
    FROM top t JOIN dm m USING (uuid) JOIN ds s USING (session_id)"""


ORACLE["search_top"] = best(scored([word("ther"), word("mentaux")], "t0 > 0 OR t1 > 0"), "true", 10)
ORACLE["search_project"] = best(scored([word("ther"), word("hin")], "t0 > 0 OR t1 > 0"), "source = 'src7'", 5)
ORACLE["team_search"] = f"""WITH {DOC_SESSIONS}, {scored(
    [pair("of", "the"), word("thble")], "t0 > 0 AND t1 = 0", ["true", "false"], by="1")}, top AS (
        SELECT * FROM hits WHERE lang = 'en' ORDER BY score, uuid LIMIT 10)
    SELECT m.ts, t.lang AS engineer_id, m.project_slug, t.lang AS git_branch, round(-t.score, 6) AS rank,
           replace(left(t.text, 200), chr(10), ' ') AS content_preview, m.session_id, 'user' AS role
    FROM top t JOIN dm m USING (uuid)"""
SAID_DOCS = f"""{TALK_SESSIONS}, docs AS (
    SELECT uuid, project_slug AS source, session_id AS lang, content AS text, {TOKENS.replace("text", "content")} AS tok
    FROM said WHERE project_slug <> 'p3')"""
ORACLE["stored_stats"] = f"""WITH {SAID_DOCS} SELECT source AS project_slug, count(*) AS n_docs,
    CAST(sum(len(tok)) AS BIGINT) AS total_len FROM docs GROUP BY source"""
ORACLE["search_stored"] = f"""WITH {scored([word("ther"), word("tion")], "t0 > 0 OR t1 > 0", docs=SAID_DOCS)}, top AS (
        SELECT * FROM hits ORDER BY score, uuid LIMIT 20)
    SELECT t.uuid AS message_uuid, m.session_id, m."timestamp", m.role, m.project_slug,
           s.started_at AS session_started_at, s.git_branch, round(t.score, 6) AS score
    FROM top t JOIN said m USING (uuid) JOIN sessions s ON s.session_id = m.session_id"""
ORACLE["search_many"] = f"""WITH {DOCS}, asked AS (
        SELECT item_id AS query_id, unnest(list_distinct({TOKENS})) AS phrase
        FROM benchmark),
    words AS (SELECT uuid, source, len(tok) AS dl, unnest(tok) AS phrase FROM docs),
    tf AS (SELECT uuid, source, dl, phrase, count(*) AS t FROM words
           WHERE phrase IN (SELECT phrase FROM asked) GROUP BY ALL),
    stats AS (SELECT source, count(*)::DOUBLE AS n, avg(len(tok)) AS al FROM docs GROUP BY source),
    df AS (SELECT source, phrase, count(*) AS d FROM tf GROUP BY ALL),
    shares AS (
        SELECT uuid, source, phrase, -(CASE WHEN ln((n - d + 0.5) / (d + 0.5)) > 0
               THEN ln((n - d + 0.5) / (d + 0.5)) ELSE 1e-6 END) * (t * 2.2)
               / (t + 1.2 * (0.25 + 0.75 * dl / al)) AS share
        FROM tf JOIN df USING (source, phrase) JOIN stats USING (source)),
    scored AS (
        SELECT query_id, source, uuid, sum(share::DECIMAL(28, 18))::DOUBLE AS score
        FROM shares JOIN asked USING (phrase) GROUP BY ALL)
    SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score, uuid) AS rank,
           source AS project_slug, uuid, round(score, 6) AS score
    FROM scored QUALIFY rank <= 10"""

# the same over stems: every word of documents and queries, stemmed once
VOCABULARY = f"""vocabulary AS (SELECT DISTINCT unnest({TOKENS}) AS word
    FROM (SELECT text FROM documents UNION ALL SELECT text FROM benchmark)), {STEMS}"""
STEMMED_DOCS = f"""{VOCABULARY}, flat AS (
        SELECT doc_id, unnest(tok) AS word, generate_subscripts(tok, 1) AS place FROM (SELECT doc_id, {TOKENS} AS tok FROM documents)),
    docs AS (SELECT d.doc_id::VARCHAR AS uuid, any_value(source) AS source, any_value(lang) AS lang, any_value(text) AS text,
        coalesce(list(stem ORDER BY place) FILTER (stem IS NOT NULL), []) AS tok
        FROM documents d LEFT JOIN flat USING (doc_id) LEFT JOIN stems USING (word) GROUP BY d.doc_id)"""
ORACLE["porter_stem"] = f"""WITH vocabulary AS (SELECT DISTINCT unnest({TOKENS}) AS word FROM documents), {STEMS}
    SELECT word, stem FROM stems"""
# stems of erings, thoned, estly
ORACLE["search_stemmed"] = found(
    [word("er"), pair("thone", "the"), word("estli")], "(t0 > 0 OR t1 > 0) AND t2 = 0", ["true", "true", "false"], docs=STEMMED_DOCS
)
_MANY = ORACLE["search_many"]
ORACLE["search_many_stemmed"] = (
    _MANY.replace(DOCS, STEMMED_DOCS, 1)
    .replace("asked AS (", "said AS (", 1)
    .replace("words AS (", "asked AS (SELECT query_id, phrase AS written, stem AS phrase FROM said JOIN stems ON word = phrase),\n    words AS (", 1)
)

# ---------------------------------------------------------------- notes

NOTES = """notes AS (
    SELECT page_id, 'notes/' || url AS rel_path,
           ['lessons', 'runbooks', 'decisions'][page_id % 3 + 1] AS category, page_id % 3 AS category_rank,
           regexp_replace(url, '[^a-z0-9]+', '-', 'g') AS stem,
           '# ' || regexp_extract(html, '<title>([^<]*)</title>', 1) || chr(10) || chr(10) || regexp_replace(
               regexp_replace(html, '</(p|h1|div|title|li)>', chr(10) || chr(10), 'g'), '<[^>]*>', '', 'g') AS content
    FROM pages)"""
_LINES = "string_split_regex(content, '\\r\\n|[\\n\\r\\x0b\\x0c\\x1c\\x1d\\x1e\\x{85}\\x{2028}\\x{2029}]')"
_HEADING = f"""coalesce({strip(f"ltrim(list_filter(list_transform({_LINES}, lambda l: {strip('l')}), lambda l: starts_with(l, '# '))[1], '# ')")}, '')"""
TITLED = f"{NOTES}, titled AS (SELECT *, {_HEADING} AS heading FROM notes)"
_SCORE = " + ".join(
    f"(CASE WHEN contains(lower({field}), lower('{k}')) THEN {weight} ELSE 0 END)"
    for k in KEYWORDS
    for field, weight in (("stem", 5.0), ("heading", 3.0), ("content", 1.0))
)
_MATCHED = (
    "array_to_string(list_filter(["
    + ", ".join(
        f"CASE WHEN contains(lower(stem || chr(0) || heading || chr(0) || content), lower('{k}')) THEN '{k}' END"
        for k in sorted(set(KEYWORDS))
    )
    + "], lambda k: k IS NOT NULL), '|')"
)
_TITLE = "coalesce(nullif(heading, ''), stem)"
_USABLE = f"""length({strip("ltrim(p, '#')")}) >= 30 AND NOT starts_with(p, '---') AND NOT starts_with(p, '**Status**')
    AND NOT starts_with(p, '**Last verified**') AND NOT starts_with(p, '**Severity**')"""
EXCERPTS = f"""{TITLED}, paras AS (
        SELECT page_id, unnest(list_transform(string_split(content, chr(10) || chr(10)), lambda p: {strip("p")})) AS p,
               unnest(range(len(string_split(content, chr(10) || chr(10))))) AS pos FROM titled),
    rated AS (
        SELECT page_id, p, pos, least(len(regexp_extract_all(p, '(?i){"|".join(KEYWORDS)}')), 3) AS hits
        FROM paras WHERE {_USABLE}),
    chosen AS (
        SELECT page_id, p FROM rated
        QUALIFY row_number() OVER (PARTITION BY page_id ORDER BY hits DESC, pos) = 1),
    excerpts AS (
        SELECT page_id, {strip(f"replace(CASE WHEN length(p) > 240 THEN rtrim(left(p, 240), {WS}) || ' …' ELSE p END, chr(10), ' ')")} AS excerpt
        FROM chosen)"""
ORACLE["keyword_score"] = f"""WITH {TITLED}
    SELECT page_id, ({_SCORE})::DOUBLE AS score FROM titled WHERE {_SCORE} > 0"""
ORACLE["matched_keywords"] = f"WITH {TITLED} SELECT page_id, {_MATCHED} AS matched FROM titled"
ORACLE["extract_title"] = f"WITH {TITLED} SELECT page_id, {_TITLE} AS title FROM titled"
ORACLE["best_excerpt"] = f"""WITH {EXCERPTS}
    SELECT page_id, coalesce(excerpt, '') AS excerpt FROM titled LEFT JOIN excerpts USING (page_id)"""
ORACLE["notes_search"] = f"""WITH {EXCERPTS}
    SELECT rel_path, {_TITLE} AS title, ({_SCORE})::DOUBLE AS score, coalesce(excerpt, '') AS excerpt,
           {_MATCHED} AS matched_keywords
    FROM titled LEFT JOIN excerpts USING (page_id) WHERE {_SCORE} > 0
    ORDER BY score DESC, category_rank, rel_path LIMIT 10"""
