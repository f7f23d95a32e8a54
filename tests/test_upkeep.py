"""What a store keeps of its batches: manifest, keys, statistics, compaction; and recovery of interrupted writes."""

import pytest
from conftest import assistant, user
from pyspark.sql import functions as F

from turnstone.operators import term
from turnstone.plans import corpus_stats, ingest, ingest_requests, score_hits, search_store
from turnstone.sources import Store, scan_transcripts
from turnstone.streaming import stream_dedup
from turnstone.streaming.ingest import stored_under, writer_of


@pytest.fixture
def store(spark, tmp_path):
    return Store(spark, str(tmp_path / "store"))


def plan(frame):
    return frame._jdf.queryExecution().executedPlan().toString()


def said(store):
    return sorted((r.project_slug, r.uuid, r.content) for r in store.scan_messages().collect())


def told(store):
    columns = ["project_slug", "session_id", "started_at", "ended_at", "turn_count", "git_branch", "tool_call_freq"]
    return sorted(map(repr, map(tuple, store.scan_sessions().select(*columns).collect())))


def counted(store):
    return sorted((r.project_slug, r.n_docs, r.total_len) for r in store.search_stats().collect())


def scan(spark, tmp_path):
    return scan_transcripts(spark, str(tmp_path / "projects"))


def grow(write_transcript, n):
    for slug in ("p", "q"):
        lines = [user(f"u{i}", f"needle {slug} {i} more words", ts=f"2031-11-02T08:00:0{i}Z") for i in range(n)]
        lines.append(assistant("a", [{"type": "text", "text": "an answer"}, {"type": "tool_use", "name": "Bash"}]))
        write_transcript(lines, slug=slug, name=f"s-{slug}")


def test_statistics_follow_replays_and_purges(spark, tmp_path, store, write_transcript):
    grow(write_transcript, 1)
    ingest(store, scan(spark, tmp_path), 0)
    grow(write_transcript, 3)
    for batch in (1, 1, 0):
        ingest(store, scan(spark, tmp_path), batch)
        fresh = corpus_stats(store.scan_messages()).collect()
        assert counted(store) == sorted((r.project_slug, r.n_docs, round(r.n_docs * r.avg_len)) for r in fresh)
    assert counted(store) == [("p", 4, 17), ("q", 4, 17)]
    store.purge_project("q")
    assert counted(store) == [("p", 4, 17)] and store.read("keys").filter("project_slug = 'q'").isEmpty()
    ingest(store, scan(spark, tmp_path), 2)  # what was purged may come again
    assert counted(store) == [("p", 4, 17), ("q", 4, 17)]


def test_a_search_reads_texts_once_and_scores_as_without_statistics(spark, tmp_path, store, write_transcript):
    grow(write_transcript, 3)
    ingest(store, scan(spark, tmp_path), 0)
    condition = term("needle") & ~term("2")
    plain = {(r.project_slug, r.uuid): r.score for r in score_hits(store.scan_messages(), condition).collect()}
    hits = score_hits(store.scan_messages(), condition, stats=store.search_stats())
    assert {(r.project_slug, r.uuid): r.score for r in hits.collect()} == plain and len(plain) == 4
    # the texts were read when the narrow rows were written; the plan reads those and the statistics
    assert "norm" not in plan(hits) and "content" not in plan(hits)
    found = search_store(store, condition, slug="p", stemmed=False)
    assert {r.message_uuid for r in found.collect()} == {"u0", "u1"}
    assert all(r.session_started_at == "2031-11-02T08:00:00Z" for r in found.collect())
    assert plan(found).count("norm#") > 0 and "PartitionFilters: [isnotnull(project_slug" in plan(found)


def test_a_batch_reads_keys_of_its_prefixes_only(spark, tmp_path, store, write_transcript):
    grow(write_transcript, 3)
    ingest(store, scan(spark, tmp_path), 0)
    asked = spark.createDataFrame([("p", "u1")], "project_slug string, uuid string")
    keys = store.stored_keys("messages", asked, others=1)
    text = plan(keys)
    filters = text.split("PartitionFilters: [", 1)[1].split("]", 1)[0]
    assert "prefix#" in filters and "content" not in text
    assert ("p", "u1") in {(r.project_slug, r.uuid) for r in keys.collect()}
    whole = store.read("keys").count()
    assert whole == store.scan_messages().count() and keys.count() < whole


def test_compaction_changes_nothing_that_is_read(spark, tmp_path, store, write_transcript):
    for batch in range(3):
        grow(write_transcript, batch + 1)
        ingest(store, scan(spark, tmp_path), batch, engineer="ann")
    before = said(store), told(store), counted(store), store.scan_messages(team=True).count()
    assert store.compact() == {"batch": 1}
    assert (said(store), told(store), counted(store), store.scan_messages(team=True).count()) == before
    assert {b for _, _, b in store._live("messages")} == {1, 2} and {b for _, _, b in store._live("lines")} == {2}
    assert store.vacuum() > 0 and (said(store), told(store)) == before[:2]
    with pytest.raises(ValueError, match="batch 1 of batch is compacted"):
        ingest(store, scan(spark, tmp_path), 1)
    grow(write_transcript, 5)
    ingest(store, scan(spark, tmp_path), 3)
    assert len(said(store)) == 12 and {r.turn_count for r in store.scan_sessions().collect()} == {6}
    assert [r.started_at for r in store.scan_sessions().collect()] == ["2031-11-02T08:00:00Z"] * 2


def test_an_interrupted_compaction_changes_nothing(spark, tmp_path, store, write_transcript, monkeypatch):
    for batch in range(2):
        grow(write_transcript, batch + 1)
        ingest(store, scan(spark, tmp_path), batch)
    before, folders = (said(store), told(store), counted(store)), store.manifest.read().folders

    def stop(*_):
        raise OSError("gone")

    monkeypatch.setattr(Store, "_replace", stop)
    with pytest.raises(OSError, match="gone"):
        store.compact()
    assert (said(store), told(store), counted(store)) == before and store.manifest.read().folders == folders
    assert store.vacuum() >= 4  # what the interrupted run had written


def test_a_batch_that_dies_before_it_is_published_is_not_seen(spark, tmp_path, store, write_transcript, monkeypatch):
    grow(write_transcript, 1)
    ingest(store, scan(spark, tmp_path), 0)
    before = said(store), told(store), counted(store)
    grow(write_transcript, 3)
    with monkeypatch.context() as patch:
        patch.setattr(Store, "stage_marks", lambda *_: (_ for _ in ()).throw(OSError("gone")))
        with pytest.raises(OSError, match="gone"):
            ingest(store, scan(spark, tmp_path), 1)
    assert (said(store), told(store), counted(store)) == before
    ingest(store, scan(spark, tmp_path), 1)
    assert len(said(store)) == 8 and counted(store) == [("p", 4, 17), ("q", 4, 17)]


def test_a_reader_keeps_what_it_opened(spark, tmp_path, store, write_transcript):
    grow(write_transcript, 1)
    ingest(store, scan(spark, tmp_path), 0)
    opened = store.scan_messages()
    grow(write_transcript, 3)
    ingest(store, scan(spark, tmp_path), 0)  # a new generation of the same batch
    assert opened.count() == 4 and store.scan_messages().count() == 8


def dedup(spark, tmp_path, rows):
    schema = "uuid string, n int"
    spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "rows"))
    stream = spark.readStream.schema(schema).parquet(str(tmp_path / "rows"))
    stream_dedup(stream, str(tmp_path / "unique"), str(tmp_path / "o"), availableNow=True).awaitTermination()
    got = spark.read.parquet(str(tmp_path / "unique")).select("uuid", "n").collect()
    return sorted(map(tuple, got))


def test_a_first_batch_that_died_half_written_runs_again(spark, tmp_path):
    # what is left when the driver dies between the write and the move: a table folder without any batch
    spark.createDataFrame([("x", 9)], "uuid string, n int").write.parquet(str(tmp_path / "unique" / "_writing" / "abc"))
    assert dedup(spark, tmp_path, [("a", 1), ("a", 2), ("b", 3)]) == [("a", 1), ("b", 3)]
    # and a batch folder without rows
    (tmp_path / "unique" / f"writer={writer_of('other')}" / "batch_id=0").mkdir(parents=True)
    assert dedup(spark, tmp_path, [("b", 0), ("c", 4)]) == [("a", 1), ("b", 3), ("c", 4)]
    batch = spark.createDataFrame([("a", 5)], "uuid string, n int")
    text = plan(stored_under(spark, str(tmp_path / "unique"), batch, ("uuid",)))
    assert "key_prefix#" in text.split("PartitionFilters: [", 1)[1].split("]", 1)[0]


def test_requests_are_stored_and_reported(spark, tmp_path, store, write_transcript):
    path = write_transcript([user("u1", "by path")], slug="p {a}+b", name="one")
    write_transcript([user("u2", "by name")], slug="q", name="two")
    write_transcript([user("u3", "not asked for")], slug="q", name="other")
    write_transcript(["", " "], slug="r", name="blank")  # a file without any byte counts as none
    write_transcript([{"type": "system", "timestamp": "t"}, "broken"], slug="s", name="noise")
    rows = [
        (1, str(path), None, None), (2, None, "two", "q"), (3, None, "two", "q"), (4, None, "none", "nowhere"),
        (5, None, "blank", "r"), (6, None, None, "s"),
    ]
    asked = spark.createDataFrame(rows, "n int, transcript_path string, session_id string, project_slug string")
    done = ingest_requests(store, asked, str(tmp_path / "projects"), 0)
    got = {r.n: (r.outcome, r.lines, r.turns) for r in done.report.collect()}
    assert got == {
        1: ("stored", 1, 1), 2: ("stored", 1, 1), 3: ("stored", 1, 1), 4: ("no transcript", None, None),
        5: ("empty", None, None), 6: ("no turns", 2, 0),
    }
    assert [r[1:] for r in said(store)] == [("u1", "by path"), ("u2", "by name")]
    assert done.ingested.quarantine.count() == 1
    none = ingest_requests(store, asked.filter("n = 4"), str(tmp_path / "projects"), 1)
    assert [r.outcome for r in none.report.collect()] == ["no transcript"] and none.ingested is None


def test_no_common_word_brings_messages_of_its_own(spark):
    from turnstone.plans import search_many

    rows = [(str(i), "p", f"common word {'rare' if i % 40 == 0 else 'plain'} {i} " + "pad " * (i % 7)) for i in range(400)]
    messages = spark.createDataFrame(rows, "uuid string, project_slug string, content string")
    queries = spark.createDataFrame([(1, ["common", "rare"], False), (2, ["rare", "common"], True)], "query_id int, phrases array<string>, match_all boolean")
    got = search_many(messages, queries, limit=5)
    found = {}
    for r in got.collect():
        found.setdefault(r.query_id, []).append(r.uuid)
    best = sorted((i for i in range(0, 400, 40)), key=lambda i: (4 + i % 7, str(i)))[:5]
    assert {k: set(v) for k, v in found.items()} == {1: {str(i) for i in best}, 2: {str(i) for i in best}}
