"""One callable per operator: ``(spark, sf_dir) -> DataFrame``, over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from turnstone import functions as X
from turnstone import operators as O
from turnstone import plans as P
from turnstone.functions.redact import BUILTIN_RULES, Rule
from turnstone.operators.parse import parse_lines
from turnstone.plans.ingest import ingest
from turnstone.plans.notes import score_notes
from turnstone.session import materialized, scratch_path
from turnstone.sources import Store, json_rows, resolve_transcripts, scan_transcripts, transcript_inventory
from turnstone.streaming import landed_lines, stream_dedup, stream_ingest, stream_redact

from . import tables as T

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def query(build: Query) -> Query:
    QUERIES[build.__name__] = build
    return build


# ---------------------------------------------------------------- transcripts and sessions


def _parsed(spark, d):
    return parse_lines(T.transcript_lines(spark, d))


def _turns(lines):
    return O.turns(lines, O.session_rollup(lines))


_MESSAGE = ["uuid", "session_id", "parent_uuid", "timestamp", "role", "content", "project_slug"]
_SESSION = [
    "session_id", "project_slug", "started_at", "ended_at", "turn_count", "tools", "git_branch", "cwd",
]


@query
def parse_messages(spark, d):
    return _turns(_parsed(spark, d)).select(*_MESSAGE)


@query
def session_rollup(spark, d):
    rolled = O.session_rollup(_parsed(spark, d))
    return rolled.withColumn("tools", X.tool_json("tool_call_freq")).select(*_SESSION)


def _places(lines):
    return lines.select("transcript", F.col("pos.row").alias("turn"))


@query
def keep_line_types(spark, d):
    return _places(O.keep_line_types(T.odd_lines(spark, d)))


@query
def valid_message(spark, d):
    return _places(O.valid_message(T.odd_lines(spark, d)))


@query
def route_role(spark, d):
    role = F.try_variant_get("v", "$.message.role", "string")
    return O.route_role(T.odd_lines(spark, d)).select("transcript", F.col("pos.row").alias("turn"), role.alias("role"))


@query
def drop_empty_turns(spark, d):
    """Turns that are left of lines of which most lack something."""
    return _places(parse_lines(T.odd_lines(spark, d)).filter("is_turn"))


@query
def extract_text(spark, d):
    content = F.try_variant_get("v", "$.message.content", "variant")
    return T.transcript_lines(spark, d).select(
        "project_slug", "transcript", F.col("pos.row").alias("turn"), X.extract_text(content).alias("content")
    )


@query
def parent_if_string(spark, d):
    return T.odd_lines(spark, d).select(
        "transcript", F.col("pos.row").alias("turn"), X.parent_if_string("v").alias("parent_uuid")
    )


@query
def quarantine(spark, d):
    """Lines that are no transcript lines: here the raw documents, read as if they were."""
    lines = T.table(spark, d, "documents").select(
        F.concat(F.lit("/"), "source", F.lit("/"), "lang", F.lit(".jsonl")).alias("file_path"),
        T.line_pos(row=F.col("doc_id")).alias("pos"),
        F.col("text").alias("value"),
    )
    bad = O.quarantined(parse_lines(T.raw_lines(lines)))
    return bad.groupBy("project_slug", "problem").agg(F.count("*").alias("n"))


@query
def tool_freq(spark, d):
    freq = O.tool_freq(T.event_lines(spark, d))
    return freq.select("project_slug", F.col("transcript").alias("session_id"), X.tool_json("tool_call_freq").alias("tools"))


@query
def top_tools(spark, d):
    freq = O.tool_freq(T.event_lines(spark, d))
    return freq.select(F.col("transcript").alias("session_id"), X.tools_line("tool_call_freq").alias("line"))


@query
def tool_use_names(spark, d):
    content = F.try_variant_get("v", "$.message.content", "variant")
    names = T.transcript_lines(spark, d).select("project_slug", F.explode(X.tool_use_names(content)).alias("tool"))
    return names.groupBy("project_slug", "tool").agg(F.count("*").alias("n"))


@query
def event_rollup(spark, d):
    rolled = O.session_rollup(T.event_lines(spark, d))
    return rolled.withColumn("tools", X.tool_json("tool_call_freq")).select(*_SESSION)


@query
def merge_partials(spark, d):
    """Sessions seen in two halves and merged again."""
    from turnstone.operators.sessions import finish_sessions

    lines = T.event_lines(spark, d)
    even = F.col("pos.row") % 2 == 0
    halves = O.session_partials(lines.filter(even)).unionByName(O.session_partials(lines.filter(~even)))
    rolled = finish_sessions(O.merge_partials(halves))
    return rolled.withColumn("tools", X.tool_json("tool_call_freq")).select(*_SESSION)


# ---------------------------------------------------------------- listings


_LISTED = ["session_id", "project_slug", "started_at", "ended_at", "turn_count", "git_branch"]


@query
def recent_sessions(spark, d):
    return O.recent_sessions(T.event_sessions(spark, d)).select(*_LISTED)


@query
def recent_sessions_project(spark, d):
    return O.recent_sessions(T.event_sessions(spark, d), slug="p1", limit=20, min_turns=3).select(*_LISTED)


@query
def filter_min_turns(spark, d):
    return O.filter_min_turns(T.event_sessions(spark, d), 4).select(*_LISTED)


@query
def session_count(spark, d):
    return O.session_count(T.event_sessions(spark, d))


@query
def session_count_project(spark, d):
    return O.session_count(T.event_sessions(spark, d), "p2")


@query
def list_projects(spark, d):
    return O.list_projects(T.event_sessions(spark, d))


@query
def latest_session_per_project(spark, d):
    return O.latest_session_per_project(T.event_sessions(spark, d)).select(*_LISTED)


@query
def filter_not_current(spark, d):
    """Newest sessions, but for those whose engineer did something last."""
    sessions = T.event_sessions(spark, d)
    running = sessions.groupBy().agg(F.max_by("session_id", "ended_at").alias("session_id"))
    return O.filter_not_current(O.latest_session_per_project(sessions), running).select(*_LISTED)


@query
def filter_recency(spark, d):
    return O.filter_recency(T.event_sessions(spark, d), "2024-01-31 00:00:00").select(*_LISTED)


@query
def filter_engineer(spark, d):
    return O.filter_engineer(T.event_sessions(spark, d), "u7", "p2").select(*_LISTED)


@query
def filter_not_self(spark, d):
    others = O.filter_not_self(T.event_sessions(spark, d), "u7")
    return others.groupBy("project_slug").agg(F.count("*").alias("n"))


@query
def locate_session(spark, d):
    """Owner of every document session id, looked up by language alone."""
    sessions = T.doc_sessions(spark, d).withColumn("session_id", F.col("git_branch"))
    return O.locate_session(sessions.select("session_id"), sessions)


@query
def transcript(spark, d):
    said = _turns(_parsed(spark, d))
    return O.transcript(said, said.select("project_slug", "session_id"))


@query
def transcript_head(spark, d):
    said = _turns(_parsed(spark, d))
    return O.transcript(said, said.select("project_slug", "session_id"), limit=2)


@query
def session_messages(spark, d):
    chosen = O.latest_session_per_project(T.doc_sessions(spark, d))
    return O.session_messages(chosen, T.doc_messages(spark, d)).select("project_slug", "session_id", "uuid", "timestamp")


# ---------------------------------------------------------------- inserts, versions, deletes


@query
def upsert_sessions(spark, d):
    """Two versions of every session; the later one has no branch for some engineers."""
    versions = T.event_sessions(spark, d, "batch_id").withColumn(
        "git_branch", F.when(F.col("batch_id") == 0, F.coalesce("git_branch", F.lit("main"))).otherwise(F.col("git_branch"))
    )
    return O.upsert_sessions(versions).select(*_LISTED)


def _copies(spark, d):
    """Documents keyed by their text, so that exact copies share an id."""
    return T.table(spark, d, "documents").select(
        F.md5("text").alias("uuid"), F.col("doc_id"), F.col("lang"), F.lit("all").alias("project_slug")
    )


@query
def first_uuid_wins(spark, d):
    return O.first_uuid_wins(_copies(spark, d), order=["doc_id"]).select("uuid", "doc_id")


@query
def insert_messages(spark, d):
    """Everything inserted into a store that holds the English texts."""
    texts = _copies(spark, d)
    stored = O.first_uuid_wins(texts.filter("lang = 'en'"), order=["doc_id"])
    return O.insert_messages(texts, stored, order=["doc_id"]).select("uuid", "doc_id")


@query
def ingest_stats(spark, d):
    texts = _copies(spark, d).withColumn("session_id", F.col("lang"))
    return O.ingest_stats(texts, O.first_uuid_wins(texts, order=["doc_id"]))


@query
def purge_project(spark, d):
    _, kept = O.purge_project(T.doc_sessions(spark, d), T.doc_messages(spark, d), "src3")
    return kept.select("uuid", "project_slug", "session_id")


@query
def orphan_messages(spark, d):
    sessions = T.doc_sessions(spark, d).filter("git_branch <> 'fr'")
    return O.orphan_messages(T.doc_messages(spark, d), sessions).select("uuid", "project_slug", "session_id")


@query
def emit_json(spark, d):
    return json_rows(T.doc_sessions(spark, d).select("session_id", "project_slug", "started_at", "turn_count"))


# ---------------------------------------------------------------- text


# rules as a user would write them, in Python's dialect
RULES = [
    Rule(r"[A-Za-z0-9._%+-]+@([A-Za-z0-9.-]+\.[A-Za-z]{2,})", r"<USER>@\1"),
    Rule(r'(token = ")[0-9a-f]{40}(")', r"\g<1><TOKEN>\2"),
    Rule(r"[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}", "<IP>"),
    *BUILTIN_RULES,
]
# a made-up token of the shape the built-in rule looks for
JWT = "eyJhbGciOiJIUzI1NiJ9x.eyJzdWIiOiIxMjM0NTY3ODkwIn0.SflKxwRJSMeKKF2QT4fwpMeJf36"


@query
def redact_documents(spark, d):
    docs = T.table(spark, d, "documents")
    return docs.select("doc_id", X.redact(F.concat("text", F.lit(" key " + JWT)), RULES).alias("text"))


@query
def strip_text(spark, d):
    padded = F.concat(F.lit(" \t\n"), "text", F.lit("\r\n \u00a0"))
    return T.table(spark, d, "documents").select("doc_id", X.strip(padded).alias("text"))


@query
def slugify_names(spark, d):
    name = F.concat(F.lit("  "), "p_name", F.lit("__"), "p_brand", F.lit("!! "), "p_type")
    return T.table(spark, d, "part").select("p_partkey", X.slugify(name).alias("slug"))


@query
def user_ids(spark, d):
    return T.table(spark, d, "supplier").select("s_suppkey", X.normalize_user_id("s_name").alias("user_id"))


@query
def fmt_short(spark, d):
    e = T.table(spark, d, "events")
    iso = F.expr("date_format(ts, \"yyyy-MM-dd'T'HH:mm:ss.SSS'+05:00'\")")
    day = F.expr("date_format(ts, 'yyyy-MM-dd')")
    return e.select(
        "event_id",
        X.fmt_iso_short(iso).alias("long_form"),
        X.fmt_iso_short(day).alias("day_form"),
        X.fmt_iso_short(F.concat(F.lit("at "), iso)).alias("unreadable"),
    )


@query
def fmt_team(spark, d):
    iso = F.expr("date_format(ts, \"yyyy-MM-dd'T'HH:mm:ss'Z'\")")
    return T.table(spark, d, "events").select("event_id", X.fmt_iso_team(iso).alias("shown"))


@query
def slug_from_cwd(spark, d):
    cwd = F.concat(F.lit("C:\\src/"), "p_brand", F.lit("\\"), "p_name")
    slug = F.when(F.col("p_size") > 25, F.col("p_type"))
    return T.table(spark, d, "part").select("p_partkey", X.slug_from_cwd(slug, cwd).alias("slug"))


@query
def slug_from_path(spark, d):
    url = F.col("url")
    path = F.concat(url, F.lit(".jsonl"))
    return T.table(spark, d, "pages").select(
        "page_id", X.slug_from_path(path).alias("slug"), X.session_from_path(path).alias("session")
    )


@query
def trim_turns(spark, d):
    return T.table(spark, d, "conversations").select(
        "conv_id", "turn", X.trim_turn("text", F.col("turn") > 3).alias("text")
    )


@query
def cap_block(spark, d):
    return T.table(spark, d, "documents").select("doc_id", X.cap_block("text", 3000, "[…trimmed…]").alias("text"))


@query
def preview(spark, d):
    return T.table(spark, d, "documents").select("doc_id", X.preview("text").alias("preview"))


@query
def tokenize(spark, d):
    words = T.table(spark, d, "documents").select(F.explode(X.tokenize("text")).alias("word"))
    return words.groupBy("word").agg(F.count("*").alias("n"))


@query
def porter_stem(spark, d):
    """Stems of the vocabulary."""
    words = T.table(spark, d, "documents").select(F.explode(X.tokenize("text")).alias("word")).distinct()
    return words.withColumn("stem", X.porter_stem("word"))


# ---------------------------------------------------------------- search


_HIT = ["message_uuid", "session_id", "timestamp", "role", "project_slug", "session_started_at", "git_branch"]


def _found(spark, d, condition):
    hits = P.score_hits(T.searchable(spark, d), condition, stemmed=False)
    return hits.select("project_slug", "uuid", F.round("score", 6).alias("score"))


@query
def corpus_stats(spark, d):
    stats = P.corpus_stats(T.searchable(spark, d))
    return stats.select("project_slug", "n_docs", F.round("avg_len", 6).alias("avg_len"))


@query
def search_term(spark, d):
    return _found(spark, d, O.term("thble"))


@query
def search_or(spark, d):
    return _found(spark, d, O.term("erin") | O.term("thor") | O.term("des"))


@query
def search_and_not(spark, d):
    return _found(spark, d, O.term("ther") & O.term("tion") & ~O.term("est"))


@query
def search_nested(spark, d):
    return _found(spark, d, (O.term("ble") & O.term("thth")) | (O.term("des") & ~O.phrase("de la")))


@query
def search_phrase(spark, d):
    return _found(spark, d, O.phrase("of the"))


@query
def search_prefix(spark, d):
    return _found(spark, d, O.prefix("thon"))


@query
def search_top(spark, d):
    top = P.search(T.doc_messages(spark, d), T.doc_sessions(spark, d), O.term("ther") | O.term("mentaux"), stemmed=False)
    return top.select(*_HIT, F.round("score", 6).alias("score"))


@query
def search_project(spark, d):
    top = P.search(
        T.doc_messages(spark, d), T.doc_sessions(spark, d), O.term("ther") | O.term("hin"), slug="src7", limit=5, stemmed=False
    )
    return top.select(*_HIT, F.round("score", 6).alias("score"))


@query
def topk_per_project(spark, d):
    hits = P.score_hits(T.searchable(spark, d), O.term("than") | O.term("erin"), stemmed=False)
    return P.topk_per_project(hits, 3).select("project_slug", "uuid", F.round("score", 6).alias("score"))


def _bulk_queries(spark, d):
    """One query per benchmark passage: all its words."""
    words = F.array_distinct(X.tokenize("text"))
    asked = T.table(spark, d, "benchmark").select(
        F.col("item_id").alias("query_id"), words.alias("phrases"), F.lit(False).alias("match_all")
    )
    return asked


@query
def search_many(spark, d):
    found = P.search_many(T.searchable(spark, d), _bulk_queries(spark, d), stemmed=False)
    return found.select("query_id", "rank", "project_slug", "uuid", F.round("score", 6).alias("score"))


@query
def search_many_stemmed(spark, d):
    found = P.search_many(T.searchable(spark, d), _bulk_queries(spark, d))
    return found.select("query_id", "rank", "project_slug", "uuid", F.round("score", 6).alias("score"))


@query
def search_stemmed(spark, d):
    hits = P.score_hits(T.searchable(spark, d), (O.term("erings") | O.phrase("thoned the")) & ~O.term("estly"))
    return hits.select("project_slug", "uuid", F.round("score", 6).alias("score"))


@query
def search_snippet(spark, d):
    top = P.search(T.doc_messages(spark, d), T.doc_sessions(spark, d), O.term("hables") | O.phrase("of the"), limit=25)
    return top.select("message_uuid", "snippet", F.round("score", 6).alias("score"))


# ---------------------------------------------------------------- digests and the team


@query
def session_digest(spark, d):
    lines = _parsed(spark, d)
    sessions = O.session_rollup(lines)
    return P.session_digest(sessions, O.first_uuid_wins(_turns(lines)))


@query
def document_digest(spark, d):
    """Long sessions, where only the first turns fit the block."""
    sessions = T.doc_sessions(spark, d).withColumn("tool_call_freq", F.create_map().cast("map<string,bigint>"))
    return P.session_digest(sessions, T.doc_messages(spark, d))


@query
def team_recent(spark, d):
    return P.team_recent(T.event_sessions(spark, d), limit=30).select("engineer_id", *_LISTED)


@query
def team_activity(spark, d):
    sessions = T.event_sessions(spark, d)
    viewers = T.event_rows(spark, d).select(F.col("engineer_id").alias("viewer")).distinct()
    return P.team_activity(sessions, viewers, "2024-01-31 00:00:00")


@query
def team_activity_unlimited(spark, d):
    """The filters before any fetch limit."""
    sessions = T.event_sessions(spark, d)
    viewers = T.event_rows(spark, d).select(F.col("engineer_id").alias("viewer")).distinct()
    return P.team_activity(sessions, viewers, "2024-01-31 00:00:00", fetch_limit=None)


@query
def team_activity_fetched(spark, d):
    """Among the newest sessions of all only, whatever the viewer."""
    sessions = T.event_sessions(spark, d)
    viewers = T.event_rows(spark, d).select(F.col("engineer_id").alias("viewer")).distinct()
    return P.team_activity(sessions, viewers, "2024-01-31 00:00:00", fetch_limit=30)


@query
def team_search(spark, d):
    found = P.team_search(
        T.doc_messages(spark, d), T.doc_sessions(spark, d), O.phrase("of the") & ~O.term("thble"), engineer="en", stemmed=False
    )
    return found.withColumn("rank", F.round("rank", 6))


@query
def publish_team(spark, d):
    """Transcripts stored for one engineer after another; a message id counts once in the corpus."""
    store = Store(spark, scratch_path(spark, "team"))
    lines = T.transcript_lines(spark, d)
    ingest(store, lines, 0, engineer="ann")
    ingest(store, lines, 1, engineer="bob")
    return store.scan_messages(team=True).select("engineer_id", *_MESSAGE)


# ---------------------------------------------------------------- notes


KEYWORDS = ["thble", "of the", "thble", "example-com", "êeux"]


@query
def keyword_score(spark, d):
    scored = score_notes(T.page_notes(spark, d), KEYWORDS)
    return scored.select("page_id", "score")


@query
def matched_keywords(spark, d):
    notes = T.page_notes(spark, d)
    found = X.matched_keywords(KEYWORDS, "stem", X.extract_title("content", F.lit("")), "content")
    return notes.select("page_id", F.array_join(found, "|").alias("matched"))


@query
def extract_title(spark, d):
    return T.page_notes(spark, d).select("page_id", X.extract_title("content", "stem").alias("title"))


@query
def best_excerpt(spark, d):
    return T.page_notes(spark, d).select("page_id", X.best_excerpt("content", KEYWORDS).alias("excerpt"))


@query
def notes_search(spark, d):
    found = P.notes_search(T.page_notes(spark, d), KEYWORDS, limit=10)
    return found.withColumn("matched_keywords", F.array_join("matched_keywords", "|"))


# ---------------------------------------------------------------- files and streams


@query
def scan_transcripts(spark, d):
    landing = scratch_path(spark, "landing")
    T.land_transcripts(spark, d, landing)
    from turnstone.sources import scan_transcripts as scan

    # sessions and turns read the parsed lines; the files are opened once
    return _turns(materialized(parse_lines(scan(spark, landing)).hint("rebalance"), "lines")).select(*_MESSAGE)


@query
def latest_transcript(spark, d):
    """Files asked for by session (in either spelling) or by project."""
    landing = scratch_path(spark, "landing")
    T.land_transcripts(spark, d, landing)
    files = transcript_inventory(spark, landing)
    asked = T.table(spark, d, "conversations").select(
        F.expr("concat('p', conv_id % 4)").alias("projectSlug"),
        F.expr("if(conv_id % 2 = 0, concat('c', conv_id), null)").alias("sessionId"),
        F.expr("if(conv_id % 2 = 0, null, concat('c', conv_id))").alias("session_id"),
    )
    found = resolve_transcripts(asked.distinct(), files)
    return found.select("project_slug", "session_id", X.session_from_path("resolved_path").alias("found"))


@query
def ingest_twice(spark, d):
    """A batch stored twice: what is stored is what one run stores."""
    store = Store(spark, scratch_path(spark, "store"))
    lines = T.transcript_lines(spark, d)
    ingest(store, lines, 0)
    ingest(store, lines, 1)
    return store.scan_messages().select(*_MESSAGE)


@query
def ingest_replay(spark, d):
    """A batch of the first half of each transcript, one of the whole, then the first again over the whole."""
    store = Store(spark, scratch_path(spark, "store"))
    lines = T.transcript_lines(spark, d)
    ingest(store, lines.filter("pos.row % 2 = 0"), 0)
    ingest(store, lines, 1)
    ingest(store, lines, 0)
    return store.scan_messages().select(*_MESSAGE)


@query
def stream_after_batch(spark, d):
    """One store: a batch of some projects, a stream of the others, and a second stream over the same files."""
    landing = scratch_path(spark, "landing")
    T.land_transcripts(spark, d, landing)
    store = Store(spark, scratch_path(spark, "store"))
    ingest(store, T.transcript_lines(spark, d).filter("project_slug in ('p0', 'p1')"), 0)
    for _ in range(2):
        landed = landed_lines(spark, landing, glob="*.jsonl").filter("file_path not rlike '/p[01]/[^/]*$'")
        stream_ingest(store, landed, scratch_path(spark, "offsets"), availableNow=True).awaitTermination()
    return store.scan_messages().select(*_MESSAGE)


@query
def push_result(spark, d):
    """What a team push inserted, where a second engineer pushes the same transcripts and more."""
    store = Store(spark, scratch_path(spark, "team"))
    lines = T.transcript_lines(spark, d)
    ingest(store, lines.filter("pos.row % 3 = 0"), 0, engineer="ann")
    return ingest(store, lines, 1, engineer="bob").team


@query
def stored_projects(spark, d):
    store = Store(spark, scratch_path(spark, "store"))
    ingest(store, T.transcript_lines(spark, d), 0)
    return store.list_projects()


def _two_batches(spark, d):
    """Half of each transcript, then the whole; one project is purged in between."""
    store = Store(spark, scratch_path(spark, "store"))
    lines = T.transcript_lines(spark, d)
    ingest(store, lines.filter("pos.row % 2 = 0"), 0)
    store.purge_project("p3")
    ingest(store, lines.filter("project_slug <> 'p3'"), 1)
    return store


@query
def stored_stats(spark, d):
    """Statistics of a store after a replay and a purge, from the sums of its batches."""
    store = _two_batches(spark, d)
    ingest(store, T.transcript_lines(spark, d).filter("project_slug <> 'p3'"), 1)
    return store.search_stats()


@query
def search_stored(spark, d):
    """A search over the store: one filtered pass over the texts."""
    found = P.search_store(_two_batches(spark, d), O.term("ther") | O.term("tion"), limit=20, stemmed=False)
    return found.select(*_HIT, F.round("score", 6).alias("score"))


@query
def compacted_store(spark, d):
    """What a store holds after its older batches were merged, unused folders deleted, and one more batch."""
    store = _two_batches(spark, d)
    store.compact()
    store.vacuum()
    ingest(store, T.transcript_lines(spark, d).filter("project_slug <> 'p3'"), 2)
    return store.scan_messages().select(*_MESSAGE)


@query
def ingest_requests(spark, d):
    """Requests by path, by session and for a project's newest transcript, all in one call."""
    landing = scratch_path(spark, "landing")
    T.land_transcripts(spark, d, landing)
    files = materialized(transcript_inventory(spark, landing).select("path", "project_slug", "session_id").hint("rebalance"), "asked")
    number = F.regexp_extract("session_id", "[0-9]+", 0).cast("long")
    asked = files.filter(number % 3 < 2).select(
        F.when(number % 3 == 0, F.col("path")).alias("transcript_path"), F.when(number % 3 == 1, F.col("session_id")).alias("sessionId"), "project_slug"
    )
    none = spark.createDataFrame([(None, "missing", "nobody")], asked.schema)
    store = Store(spark, scratch_path(spark, "store"))
    P.ingest_requests(store, asked.unionByName(none), landing, 0)
    return store.scan_messages().select(*_MESSAGE)


@query
def stored_sessions(spark, d):
    store = Store(spark, scratch_path(spark, "store"))
    ingest(store, T.transcript_lines(spark, d), 0)
    ingest(store, T.transcript_lines(spark, d), 1)
    return store.scan_sessions().withColumn("tools", X.tool_json("tool_call_freq")).select(*_SESSION)


@query
def stream_ingest_messages(spark, d):
    landing = scratch_path(spark, "landing")
    T.land_transcripts(spark, d, landing)
    store = Store(spark, scratch_path(spark, "store"))
    stream = landed_lines(spark, landing, glob="*.jsonl")
    stream_ingest(store, stream, scratch_path(spark, "offsets"), availableNow=True).awaitTermination()
    return store.scan_messages().select(*_MESSAGE)


def _document_stream(spark, d):
    schema = T.table(spark, d, "documents").schema
    return spark.readStream.schema(schema).parquet(f"{d}/documents*.parquet")


@query
def stream_redact_documents(spark, d):
    """Redacted before it is written."""
    out = scratch_path(spark, "redacted")
    docs = _document_stream(spark, d).select("doc_id", F.concat("text", F.lit(" key " + JWT)).alias("text"))
    (
        stream_redact(docs, RULES, column="text")
        .writeStream.format("parquet")
        .option("checkpointLocation", scratch_path(spark, "offsets"))
        .option("path", out)
        .trigger(availableNow=True)
        .start()
        .awaitTermination()
    )
    return spark.read.schema("doc_id bigint, text string").parquet(out)


@query
def stream_dedup_documents(spark, d):
    out = scratch_path(spark, "unique")
    docs = _document_stream(spark, d).select(F.md5("text").alias("uuid"), "doc_id")
    stream_dedup(docs, out, scratch_path(spark, "offsets"), availableNow=True).awaitTermination()
    return spark.read.parquet(out).select("uuid", "doc_id")
