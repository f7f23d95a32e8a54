import json
import sys
import time

import pytest
from conftest import assistant, user

from turnstone.operators import (
    locate_session, orphan_messages, purge_project, recent_sessions, session_count, transcript, upsert_sessions,
)
from turnstone.plans import ingest
from turnstone.sources import Store, emit_json, json_rows, resolve_transcripts, scan_transcripts, transcript_inventory
from turnstone.streaming import landed_lines, stream_dedup, stream_ingest
from turnstone.streaming.ingest import dedup_within


@pytest.fixture
def store(spark, tmp_path):
    return Store(spark, str(tmp_path / "store"))


def scan(spark, tmp_path):
    return scan_transcripts(spark, str(tmp_path / "projects"))


def stats(result):
    return {r.session_id: (r.messages_inserted, r.messages_total) for r in result.stats.collect()}


def test_ingest_is_idempotent_and_updates(spark, tmp_path, store, write_transcript):
    first = [
        user("u1", "hello", ts="2031-11-02T10:00:00Z", gitBranch="main"),
        assistant("a1", [{"type": "text", "text": "hi there"}, {"type": "tool_use", "name": "Bash"}]),
    ]
    write_transcript(first)
    assert stats(ingest(store, scan(spark, tmp_path), 0)) == {"sess-a": (2, 2)}
    assert stats(ingest(store, scan(spark, tmp_path), 1)) == {"sess-a": (0, 2)}
    # read again, grown, with another start and without a branch
    grown = [user("u0", "earlier", ts="2031-11-02T09:00:00Z"), user("u1", "changed"), user("u2", "new")]
    write_transcript(grown)
    assert stats(ingest(store, scan(spark, tmp_path), 2)) == {"sess-a": (2, 3)}

    (session,) = store.scan_sessions().collect()
    assert session.started_at == "2031-11-02T10:00:00Z"  # the first version's
    assert (session.turn_count, session.git_branch, session.tool_call_freq) == (3, None, {})
    assert session.last_synced_at is not None
    texts = {r.uuid: r.content for r in store.scan_messages().collect()}
    assert texts == {"u1": "hello", "a1": "hi there", "u0": "earlier", "u2": "new"}
    assert session_count(store.scan_sessions(), "proj").first().n == 1
    assert [r.project_slug for r in store.list_projects().collect()] == ["proj"]


def test_a_batch_that_runs_again_changes_nothing(spark, tmp_path, store, write_transcript):
    write_transcript([user("u1", "a"), user("u1", "b"), user("u2", "c")])
    ingest(store, scan(spark, tmp_path), 0)
    ingest(store, scan(spark, tmp_path), 0)
    assert sorted((r.uuid, r.content) for r in store.scan_messages().collect()) == [("u1", "a"), ("u2", "c")]
    assert store.scan_sessions().first().turn_count == 3


def test_nothing_is_stored_without_messages(spark, tmp_path, store, write_transcript):
    write_transcript([{"type": "system", "timestamp": "t"}, "broken"], name="empty")
    result = ingest(store, scan(spark, tmp_path), 0)
    assert store.scan_sessions().count() == 0 and result.quarantine.count() == 1


def test_numeric_project_names_stay_text(spark, tmp_path, store, write_transcript):
    write_transcript([user("u1", "a"), user("u2", "b")], slug="007")
    ingest(store, scan(spark, tmp_path), 0)
    assert store.scan_messages().first().project_slug == "007"


def test_team_copy(spark, tmp_path, store, write_transcript):
    write_transcript([user("u1", "shared")], slug="p1")
    ingest(store, scan(spark, tmp_path), 0, engineer="ann")
    ingest(store, scan(spark, tmp_path), 1, engineer="bob")
    assert [(r.uuid, r.engineer_id) for r in store.scan_messages(team=True).collect()] == [("u1", "ann")]
    (session,) = store.scan_sessions(team=True).collect()
    assert (session.session_id, session.engineer_id) == ("sess-a", "bob")


def test_purge(spark, tmp_path, store, write_transcript):
    write_transcript([user("u1", "a"), user("u2", "b")], slug="keep", name="k")
    write_transcript([user("u3", "c"), user("u4", "d")], slug="drop", name="d")
    ingest(store, scan(spark, tmp_path), 0)
    sessions, messages = store.scan_sessions(), store.scan_messages()
    kept, left = purge_project(sessions, messages, "drop")
    assert [r.project_slug for r in kept.collect()] == ["keep"]
    assert {r.uuid for r in left.collect()} == {"u1", "u2"}
    assert {r.uuid for r in orphan_messages(messages, kept).collect()} == {"u3", "u4"}
    store.purge_project("drop")
    assert {r.project_slug for r in store.scan_messages().collect()} == {"keep"}
    assert [r.project_slug for r in store.list_projects().collect()] == ["keep"]


SESSION = "session_id string, project_slug string, started_at string, turn_count bigint"


def test_listings(spark):
    rows = [("noise", "p", "3", 1), ("real", "p", "1", 4), ("b", "q", "2", 2), ("a", "q", "2", 2)]
    sessions = spark.createDataFrame(rows, SESSION)
    assert [r.session_id for r in recent_sessions(sessions).collect()] == ["a", "b", "real"]
    assert [r.session_id for r in recent_sessions(sessions, slug="p", limit=5).collect()] == ["real"]
    owners = spark.createDataFrame([("x", "q", "1", 2), ("x", "p", "1", 2), ("y", "q", "1", 2)], SESSION)
    ids = spark.createDataFrame([("x",), ("z",)], "session_id string")
    assert [tuple(r) for r in locate_session(ids, owners).collect()] == [("x", "p")]
    assert session_count(sessions, "none").first().n == 0


def test_versions_keep_the_first_project_corpus_wide(spark):
    versions = spark.createDataFrame(
        [("s", "p1", "1", 2, 0), ("s", "p2", "2", 5, 1)], SESSION + ", batch_id bigint"
    )
    (row,) = upsert_sessions(versions, key=("session_id",)).collect()
    assert (row.project_slug, row.started_at, row.turn_count) == ("p1", "1", 5)


def test_transcript_order(spark, tmp_path, store, write_transcript):
    lines = [user(f"u{i}", f"t{i}", ts="2031-11-02T10:00:00Z") for i in range(3)]
    write_transcript(lines + [user("first", "t", ts="2031-11-02T09:00:00Z")])
    ingest(store, scan(spark, tmp_path), 0)
    write_transcript(lines + [user("first", "t", ts="2031-11-02T09:00:00Z"), user("u3", "t3", ts="2031-11-02T10:00:00Z")])
    ingest(store, scan(spark, tmp_path), 1)
    got = [r.uuid for r in transcript(store.scan_messages(), ["sess-a"]).collect()]
    assert got == ["first", "u0", "u1", "u2", "u3"]
    assert [r.uuid for r in transcript(store.scan_messages(), ["sess-a"], limit=2).collect()] == ["first", "u0"]


def test_json(spark, tmp_path):
    frame = spark.createDataFrame([("a", None, 1)], "x string, y string, n bigint")
    assert json_rows(frame).first().json == '{"x":"a","y":null,"n":1}'
    emit_json(frame, str(tmp_path / "out"))
    written = "".join(part.read_text() for part in (tmp_path / "out").glob("*.json"))
    assert json.loads(written) == {"x": "a", "y": None, "n": 1}


def test_resolve(spark, tmp_path, write_transcript):
    old = write_transcript(["{}"], slug="my proj+x", name="old")
    time.sleep(1.1)
    new = write_transcript(["{}"], slug="my proj+x", name="new")
    other = write_transcript(["{}"], slug="other", name="o")
    files = transcript_inventory(spark, str(tmp_path / "projects"))
    assert [r.path for r in transcript_inventory(spark, str(tmp_path / "projects"), "my proj+x").collect()] == [str(new), str(old)]
    assert transcript_inventory(spark, str(tmp_path / "missing")).count() == 0
    rows = [
        (1, str(other), None, None, None),
        (2, None, None, None, str(other)),
        (3, None, None, "my proj+x", None),
        (4, None, "old", "my proj+x", None),
        (5, None, None, None, None),
        (6, "/does/not/exist.jsonl", None, None, None),
        (7, "/does/not/exist.jsonl", "nope", "my proj+x", None),
        (8, "", "o", "other", ""),
    ]
    asked = spark.createDataFrame(rows, "n int, transcript_path string, sessionId string, project_slug string, transcriptPath string")
    got = {r.n: r.resolved_path for r in resolve_transcripts(asked, files).collect()}
    assert got == {1: str(other), 2: str(other), 3: str(new), 4: str(old), 5: None, 6: None, 7: str(new), 8: str(other)}


def _land(tmp_path, slug, session, piece, lines):
    folder = tmp_path / "landing" / f"project_slug={slug}" / f"transcript={session}"
    folder.mkdir(parents=True, exist_ok=True)
    (folder / piece).write_text("\n".join(json.dumps(x) for x in lines) + "\n")


def test_stream_equals_batch(spark, tmp_path, store, write_transcript):
    lines = [
        user("u1", "one", ts="2031-11-02T10:00:00Z", gitBranch="b"),
        assistant("a1", [{"type": "text", "text": "two"}, {"type": "tool_use", "name": "Bash"}], ts="2031-11-02T10:00:01Z"),
        user("u1", "again", ts="2031-11-02T10:00:02Z"),
        assistant("a2", [{"type": "tool_use", "name": "Bash"}], ts="2031-11-02T10:00:03Z"),
        user("u2", "last", ts="2031-11-02T10:00:04Z"),
    ]

    def run():
        stream = landed_lines(spark, str(tmp_path / "landing"), glob="*.jsonl")
        stream_ingest(store, stream, str(tmp_path / "offsets"), availableNow=True).awaitTermination()

    _land(tmp_path, "proj", "sess-a", "0.jsonl", lines[:2])
    run()
    assert store.scan_sessions().first().turn_count == 2
    _land(tmp_path, "proj", "sess-a", "1.jsonl", lines[2:])
    run()

    write_transcript(lines)
    whole = Store(spark, str(tmp_path / "whole"))
    ingest(whole, scan(spark, tmp_path), 0)
    columns = ["session_id", "started_at", "ended_at", "turn_count", "tool_call_freq", "git_branch"]
    assert store.scan_sessions().select(*columns).collect() == whole.scan_sessions().select(*columns).collect()

    def said(s):
        return sorted((r.uuid, r.content, r.session_id) for r in s.scan_messages().collect())

    assert said(store) == said(whole) == [("a1", "two", "sess-a"), ("u1", "one", "sess-a"), ("u2", "last", "sess-a")]


def test_a_stream_takes_a_bounded_number_of_files_at_once(spark, tmp_path, store, write_transcript, monkeypatch):
    from turnstone.streaming import ingest as streaming

    monkeypatch.setattr(streaming, "FILES_PER_TRIGGER", 2)
    lines = [user(f"u{i}", f"text {i}", ts=f"2031-11-02T10:00:0{i}Z") for i in range(5)]
    for i, line in enumerate(lines):  # one transcript in five pieces, and five others
        _land(tmp_path, "proj", "sess-a", f"{i}.jsonl", [line])
        _land(tmp_path, "more", f"s{i}", "0.jsonl", [user(f"w{i}", "alone"), user("u0", "again")])
    before = dict(spark.conf.getAll)
    stream = landed_lines(spark, str(tmp_path / "landing"))
    stream_ingest(store, stream, str(tmp_path / "offsets"), availableNow=True).awaitTermination()
    assert dict(spark.conf.getAll) == before  # the file source has a session of its own

    read = store.read("lines").groupBy("batch_id").agg({"pos.piece": "count"}).collect()
    assert len(read) == 5 and sum(r[1] for r in read) == 15  # two files each
    found = {r.uuid: r.content for r in store.scan_messages().filter("project_slug = 'proj'").collect()}
    assert found == {f"u{i}": f"text {i}" for i in range(5)}
    write_transcript(lines)
    whole = Store(spark, str(tmp_path / "whole"))
    ingest(whole, scan(spark, tmp_path), 0)
    columns = ["session_id", "started_at", "ended_at", "turn_count"]
    kept = store.scan_sessions().filter("project_slug = 'proj'").select(*columns)
    assert kept.collect() == whole.scan_sessions().select(*columns).collect()
    assert sorted(r.uuid for r in store.scan_messages().filter("project_slug = 'more'").collect()) == ["u0", *(f"w{i}" for i in range(5))]


def test_stream_dedup(spark, tmp_path):
    source, table = tmp_path / "rows", tmp_path / "unique"
    schema = "uuid string, n int"

    def run(rows):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(source))
        stream = spark.readStream.schema(schema).parquet(str(source))
        stream_dedup(stream, str(table), str(tmp_path / "o"), availableNow=True).awaitTermination()

    run([("a", 1), ("a", 2), ("b", 3)])
    run([("b", 0), ("c", 4)])
    rows = spark.read.parquet(str(table)).select("uuid", "n").collect()
    assert sorted(map(tuple, rows)) == [("a", 1), ("b", 3), ("c", 4)]


def test_bounded_dedup_is_a_stream(spark, tmp_path):
    (tmp_path / "in").mkdir()
    stream = spark.readStream.schema("uuid string, ts timestamp").json(str(tmp_path / "in"))
    assert dedup_within(stream, "ts", "1 hour").isStreaming


def test_an_earlier_batch_run_again_over_more_lines(spark, tmp_path, store, write_transcript):
    lines = [user(f"k{i}", f"text {i}") for i in range(3)]
    write_transcript(lines[:2])
    ingest(store, scan(spark, tmp_path), 0)
    write_transcript(lines)
    ingest(store, scan(spark, tmp_path), 1)
    ingest(store, scan(spark, tmp_path), 0)
    assert sorted(r.uuid for r in store.scan_messages().collect()) == ["k0", "k1", "k2"]


def test_writers_do_not_replace_each_other(spark, tmp_path, store, write_transcript):
    write_transcript([user("k0", "whole"), user("k1", "whole")], name="w")
    ingest(store, scan(spark, tmp_path), 0)
    for nr in range(2):  # the second stream starts anew over the same files
        _land(tmp_path, "proj", "in-pieces", "0.jsonl", [user("k2", "piece"), user("k0", "again")])
        stream = landed_lines(spark, str(tmp_path / "landing"))
        stream_ingest(store, stream, str(tmp_path / f"offsets{nr}"), availableNow=True).awaitTermination()
    got = sorted((r.uuid, r.content) for r in store.scan_messages().collect())
    assert got == [("k0", "whole"), ("k1", "whole"), ("k2", "piece")]
    assert {r.transcript: r.turn_count for r in store.read("partials").collect()} == {"w": 2, "in-pieces": 2}


def test_whole_and_piecewise_transcripts_do_not_mix(spark, tmp_path, store, write_transcript):
    write_transcript([user("k0", "a")])
    ingest(store, scan(spark, tmp_path), 0)
    with pytest.raises(ValueError, match="proj/sess-a is stored both whole and in pieces"):
        ingest(store, scan(spark, tmp_path), 1, in_pieces=True)


def test_a_failed_write_leaves_the_batch_as_it_was(spark, tmp_path, store, write_transcript):
    from pyspark.sql import functions as F

    write_transcript([user("k0", "a")])
    ingest(store, scan(spark, tmp_path), 0)
    broken = store.read("messages").withColumn("doc_len", F.raise_error(F.lit("no")).cast("long"))
    with pytest.raises(Exception, match="no"):
        store.write("messages", broken, 0)
    assert [r.uuid for r in store.scan_messages().collect()] == ["k0"]


def test_both_failures_are_told(spark, tmp_path, store, write_transcript, monkeypatch):
    write_transcript([user("k0", "a")])

    def fail(*_):
        raise OSError("full")

    monkeypatch.setattr(sys.modules["turnstone.plans.ingest"], "insert_messages", fail)
    with pytest.raises(ExceptionGroup) as caught:
        ingest(store, scan(spark, tmp_path), 0, engineer="ann")
    assert len(caught.value.exceptions) == 2


def test_one_session_of_one_project(spark, tmp_path, store, write_transcript):
    write_transcript([user("k0", "mine")], slug="p1")
    write_transcript([user("k1", "other")], slug="p2")
    ingest(store, scan(spark, tmp_path), 0)
    ids = spark.createDataFrame([("sess-a",)], "session_id string")
    found = transcript(store.scan_messages(), locate_session(ids, store.scan_sessions()))
    assert [(r.project_slug, r.content) for r in found.collect()] == [("p1", "mine")]
    assert [r.content for r in transcript(store.scan_messages(), ["sess-a"], slug="p2").collect()] == ["other"]


def test_landed_transcripts_are_one_file_each(spark, tmp_path):
    import os

    from suite import tables

    sf_dir = "/root/testdata/sf0.001"
    if not os.path.isdir(sf_dir):
        pytest.skip("no test tables")
    tables.land_transcripts(spark, sf_dir, (tmp_path / "landing").as_uri())
    said = tables.transcript_json(spark, sf_dir).orderBy("project_slug", "transcript", "turn").collect()
    wanted = {}
    for r in said:
        wanted.setdefault(f"{r.project_slug}/{r.transcript}.jsonl", []).append(r.value)
    # no folders, parts or checksums of single files
    found = {str(p.relative_to(tmp_path / "landing")): p for p in (tmp_path / "landing").rglob("*") if p.is_file()}
    assert {n: p.read_text().split("\n")[:-1] for n, p in found.items()} == wanted
    assert {len(p.parts) for p in (x.relative_to(tmp_path / "landing") for x in found.values())} == {2}


def test_an_inventory_is_listed_once(spark, write_transcript, tmp_path):
    write_transcript([user("u1", "x")], "p", "s1")
    files = transcript_inventory(spark, str(tmp_path / "projects"))
    asked = spark.createDataFrame([("p", "s1"), ("p", None), ("q", "s1")], "project_slug string, session_id string")
    found = resolve_transcripts(asked, files)
    assert "binaryFile" not in found._jdf.queryExecution().optimizedPlan().toString()
    assert {(r.project_slug, r.session_id): r.resolved_path is not None for r in found.collect()} == {
        ("p", "s1"): True, ("p", None): True, ("q", "s1"): False
    }
