import json

import pytest
from conftest import assistant, user
from pyspark.sql import functions as F

from turnstone.operators import parse_lines, quarantined, session_rollup, tool_freq, turns
from turnstone.sources import scan_transcripts
from turnstone.sources.transcripts import line_pos, raw_lines


def run(spark, path, rules=None):
    lines = parse_lines(scan_transcripts(spark, str(path.parents[1])), rules)
    sessions = session_rollup(lines)
    said = turns(lines, sessions).orderBy("pos").collect()
    return sessions.collect(), said, lines


def test_one_row_for_a_transcript_and_one_for_each_turn(spark, write_transcript):
    """Metadata before, between and behind the turns; several text blocks, tools, branches and folders."""
    path = write_transcript(
        [
            {"type": "mode", "timestamp": "2031-11-02T07:59:58Z", "sessionId": "night-shift", "cwd": "/srv/kiln"},
            user("q-1", "  Which kiln runs hot?\n", ts="2031-11-02T08:00:00Z", gitBranch="glaze", parentUuid=None),
            assistant(
                "r-1",
                [
                    {"type": "thinking", "thinking": "look at the log first"},
                    {"type": "text", "text": "The third."},
                    {"type": "tool_use", "name": "Grep", "input": {"pattern": "kiln"}},
                    {"type": "tool_use", "name": "Read", "input": {}},
                    {"type": "text", "text": "It is 40 degrees over."},
                    {"type": "tool_use", "name": "Grep", "input": {}},
                ],
                ts="2031-11-02T08:00:09Z", parentUuid="q-1", gitBranch="other", cwd="/tmp",
            ),
            {"type": "attachment", "timestamp": "2031-11-02T08:00:10Z"},
            user("q-2", [{"type": "tool_result", "content": "41"}], ts="2031-11-02T08:00:11Z", parentUuid="r-1"),
            user("q-3", "Turn it down.", ts="2031-11-02T08:01:30Z", parentUuid={"not": "text"}),
            {"type": "mode", "timestamp": "2031-11-02T08:02:00Z"},
        ],
        slug="-srv-kiln",
        name="abc-7",
    )
    (session,), said, _ = run(spark, path)
    assert (session.session_id, session.transcript, session.project_slug) == ("night-shift", "abc-7", "-srv-kiln")
    assert (session.git_branch, session.cwd) == ("glaze", "/srv/kiln")
    assert (session.started_at, session.ended_at) == ("2031-11-02T07:59:58Z", "2031-11-02T08:02:00Z")
    assert (session.turn_count, session.tool_call_freq) == (3, {"Grep": 2, "Read": 1})
    assert [(m.uuid, m.parent_uuid, m.role) for m in said] == [
        ("q-1", None, "user"), ("r-1", "q-1", "assistant"), ("q-3", None, "user"),
    ]
    assert [m.content for m in said] == ["Which kiln runs hot?", "The third.\n\nIt is 40 degrees over.", "Turn it down."]
    assert {m.session_id for m in said} == {"night-shift"}


@pytest.mark.parametrize("keep", [1, 17, -1])
def test_a_line_that_was_not_written_to_its_end(spark, write_transcript, keep):
    last = json.dumps(assistant("r-9", [{"type": "text", "text": "unfinished"}]))
    path = write_transcript([user("q-8", "kept"), user("q-9", "kept too"), last[:keep]])
    (session,), said, lines = run(spark, path)
    assert session.turn_count == 2 and [m.uuid for m in said] == ["q-8", "q-9"]
    assert [(r.problem, r.line) for r in quarantined(lines).collect()] == [("not json", last[:keep])]


def test_a_message_needs_an_object_and_an_id_but_no_role(spark):
    from turnstone.operators import valid_message

    bodies = ['{"uuid":"a","message":{}}', '{"uuid":"b","message":{"role":5}}', '{"uuid":"c","message":"x"}', '{"uuid":"d","message":[1]}',
              '{"uuid":7,"message":{}}', '{"message":{}}', '{"uuid":"e","message":null}']
    lines = spark.createDataFrame([(f"/p/{i}.jsonl", b) for i, b in enumerate(bodies)], "file_path string, value string")
    raw = raw_lines(lines.select("file_path", line_pos().alias("pos"), "value"))
    assert sorted(r.transcript for r in valid_message(raw).collect()) == ["0", "1"]


def test_very_long_lines_are_kept(spark):
    """Strings beyond 20 million characters, which the plain parser refuses."""
    shapes = spark.sql("""select '/p/long.jsonl' as file_path, concat('{"type":"user","uuid":"u","message":{"role":"user","content":"',
        repeat('x', 21000000), '"}}') as value union all select '/p/bad.jsonl', concat('{"type":"user","x":\\'', repeat('x', 21000000), '\\'}')""")
    lines = parse_lines(raw_lines(shapes.select("file_path", line_pos().alias("pos"), "value")))
    got = {r.transcript: tuple(r)[1:] for r in lines.select("transcript", "is_turn", "problem", F.length("content")).collect()}
    assert got == {"long": (True, None, 21000000), "bad": (False, "not json", 21000022)}


def test_bad_lines_do_not_lose_the_file(spark, tmp_path, write_transcript):
    one = json.dumps(user("u9", "one of two"))
    after = [one + " tail", one + one, one + "," + one, one + "]", one + "], 1", one + ", 3", '{"a": 1},"b": 2']
    path = write_transcript([user("u1", "kept"), "[1, 2]", "7", "   ", "not json", *after])
    with path.open("ab") as out:
        out.write(b'\n{"type": "user", "x": "\xff\xfe"}\n')
    (session,), said, lines = run(spark, path)
    assert session.turn_count == 1 and [m.content for m in said] == ["kept"]
    problems = sorted(r.problem for r in quarantined(lines).collect())
    assert problems == ["not an object"] * 2 + ["not json"] * 8 + ["not utf-8"]


def test_bad_file_alone(spark, write_transcript):
    path = write_transcript(["{broken", "also broken"])
    (session,), said, _ = run(spark, path)
    assert session.turn_count == 0 and said == []


def test_loose_types(spark, write_transcript):
    path = write_transcript(
        [
            user("u1", "[1,2]", sessionId=""),
            user(7, "number as id"),
            user("u2", [{"type": "text", "text": 5}, {"type": "text", "text": "  "}, "bare",
                        {"type": "text", "text": "one"}, {"type": "text", "text": "two"}]),
            user("u3", {"type": "text", "text": "object"}),
            user("u4", "   \u00a0\n"),
            {"type": "user", "uuid": "u5", "message": "no object"},
            {"type": "user", "uuid": "u6", "timestamp": 12, "message": {"role": "tool", "content": "x"}},
            {"type": "summary", "uuid": "u7", "message": {"role": "user", "content": "metadata"}},
            {"type": "assistant", "uuid": "u8", "message": {"role": "user", "content": "role decides"}},
        ],
        name="file-stem",
    )
    (session,), said, _ = run(spark, path)
    assert [(m.uuid, m.content) for m in said] == [("u1", "[1,2]"), ("u2", "one\n\ntwo"), ("u8", "role decides")]
    assert session.session_id == "file-stem"  # the first id is empty
    assert said[2].timestamp == "" and session.turn_count == 3


def test_tools(spark, write_transcript):
    tool = {"type": "tool_use", "name": "Read"}
    path = write_transcript(
        [
            assistant("a1", [tool, tool, {"type": "tool_use", "name": 3}, {"type": "tool_use"}]),
            assistant(9, [tool]),
            user("u1", [tool]),
            assistant("a2", [{"type": "tool_use", "name": "Edit"}, {"type": "text", "text": " done "}]),
        ]
    )
    (session,), said, lines = run(spark, path)
    assert session.tool_call_freq == {"Read": 2, "Edit": 1}
    assert [m.content for m in said] == ["done"]
    assert tool_freq(lines).collect()[0].tool_call_freq == {"Edit": 1, "Read": 2}


def test_duplicate_uuid_counts_as_turn(spark, write_transcript):
    path = write_transcript([user("u1", "a"), user("u1", "b")])
    (session,), said, _ = run(spark, path)
    assert session.turn_count == 2 and [m.content for m in said] == ["a", "b"]


def test_missing_times_and_line_ends(spark, write_transcript):
    line = {"type": "user", "uuid": "u1", "message": {"role": "user", "content": "x"}}
    path = write_transcript([line, {**line, "uuid": "u2"}], newline="\r\n")
    (session,), said, _ = run(spark, path)
    assert (session.started_at, session.ended_at) == ("", "") and len(said) == 2


def test_first_values_in_file_order(spark, write_transcript):
    path = write_transcript(
        [
            user("u1", "x", ts="2031-11-02T12:00:00Z", gitBranch="", cwd=4),
            user("u2", "y", ts="2031-11-02T09:00:00Z", gitBranch="one", cwd="/a"),
            user("u3", "z", ts="2031-11-02T10:00:00Z", gitBranch="two", cwd="/b"),
        ]
    )
    (session,), _, _ = run(spark, path)
    # order of the file, not of the times
    assert (session.started_at, session.ended_at) == ("2031-11-02T12:00:00Z", "2031-11-02T10:00:00Z")
    assert (session.git_branch, session.cwd) == ("one", "/a")


def test_split_files_keep_their_order(spark, write_transcript):
    path = write_transcript([user(f"u{i}", f"text {i} " + "pad " * 30) for i in range(2000)])
    size = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", "20000")
        scan = scan_transcripts(spark, str(path.parents[1]))
        assert scan.rdd.getNumPartitions() > 5
        lines = parse_lines(scan)
        said = turns(lines, session_rollup(lines)).orderBy("pos").collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", size)
    assert [m.uuid for m in said] == [f"u{i}" for i in range(2000)]


def test_secrets_never_leave_the_parser(spark, write_transcript):
    jwt = "eyJhbGciOiJIUzI1NiJ9x.eyJzdWIiOiIxMjM0NTY3ODkwIn0.SflKxwRJSMeKKF2QT4fwpMeJf36"
    path = write_transcript([user("u1", f"my token {jwt} ok"), f"broken {jwt}"])
    _, said, lines = run(spark, path)
    assert said[0].content == "my token <JWT-REDACTED> ok"
    assert jwt not in str(quarantined(lines).collect())


def test_filters_do_not_repeat_the_parse(spark):
    lines = spark.createDataFrame([("/p/s.jsonl", "{}")], "file_path string, value string")
    raw = raw_lines(lines.select("file_path", line_pos().alias("pos"), "value"))
    plan = parse_lines(raw).filter("is_turn and uuid is not null")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("VariantExpressionEvalUtils.parseJson") == 1
