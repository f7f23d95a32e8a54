from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from turnstone.plans import notes_search, session_digest, team_activity, team_recent
from turnstone.plans.notes import score_notes
from turnstone.sources import scan_notes

SESSIONS = """session_id string, project_slug string, started_at string, ended_at string, turn_count bigint,
              tool_call_freq map<string,bigint>, git_branch string"""
MESSAGES = "uuid string, project_slug string, session_id string, timestamp string, role string, content string"


def digest(spark, sessions, messages, **more):
    return {
        r.project_slug: r.text
        for r in session_digest(
            spark.createDataFrame(sessions, SESSIONS), spark.createDataFrame(messages, MESSAGES), **more
        ).collect()
    }


def said(n, text="t", session="s", slug="p"):
    return [
        (f"{session}{i:05d}", slug, session, f"2031-11-02T10:{i // 60:02d}:{i % 60:02d}Z", "user" if i % 2 == 0 else "assistant", text)
        for i in range(n)
    ]


def session(sid="s", slug="p", start="2031-11-02T10:00:00Z", turns=6, tools=None, branch="main"):
    return (sid, slug, start, start, turns, tools or {}, branch)


def test_digest_of_short_and_long_turns(spark):
    text = digest(spark, [session(tools={"b": 1, "a": 1})], said(6, "x" * 700))["p"]
    short, full = "x" * 600 + " […]", "x" * 700
    expected = ["### Previous session (2031-11-02 10:00 on `main`)", "", "Tools used: a ×1, b ×1", ""]
    for i in range(6):
        expected += [f"**{'User' if i % 2 == 0 else 'Claude'}:** {short if i < 2 else full}", ""]
    assert text == "\n".join(expected)


def test_digest_takes_the_newest_session_or_nothing(spark):
    sessions = [session("old"), session("new", start="2031-11-03T10:00:00Z"), session("tiny", start="2031-11-04", turns=1)]
    messages = said(2, session="old") + said(2, session="new") + said(1, session="tiny")
    assert "2031-11-03" in digest(spark, sessions, messages)["p"]
    current = spark.createDataFrame([("new",)], "session_id string")
    assert digest(spark, sessions, messages, current=current) == {}
    assert digest(spark, [session("empty")], messages) == {}


def _whole_digest(contents, cap=12_000):
    """The block built from all turns."""
    parts = ["### Previous session (2031-11-02 10:00)", ""]
    for i, text in enumerate(contents):
        full = i >= len(contents) - 4 or len(text) <= 600
        parts += [f"**{'User' if i % 2 == 0 else 'Claude'}:** " + (text if full else text[:600].rstrip() + " […]"), ""]
    block = "\n".join(parts)
    return block if len(block) <= cap else block[:cap].rstrip() + "\n\n[…trimmed for context budget…]"


@pytest.mark.parametrize("n, text", [(3000, "y"), (990, ""), (30, "z" * 650), (5, "w" * 20_000)])
def test_digest_of_a_huge_session_is_whole(spark, n, text):
    got = digest(spark, [session(turns=n, branch=None)], said(n, text))["p"]
    assert got == _whole_digest([text] * n)


def test_a_huge_session_leaves_each_task_cut(spark):
    plan = session_digest(
        spark.createDataFrame([session()], SESSIONS), spark.createDataFrame(said(4), MESSAGES)
    )._jdf.queryExecution().executedPlan().toString()
    assert plan.count("WindowGroupLimit") >= 4  # before and after both shuffles
    assert "CartesianProduct" not in plan


NOW = datetime(2026, 5, 20, 12)
TEAM = """session_id string, engineer_id string, project_slug string, started_at string, ended_at string,
          turn_count bigint, git_branch string"""


def team(days, who, branch="feat/x", turns=10, ended=None):
    ts = (NOW - timedelta(days=days)).strftime("%Y-%m-%dT%H:%M:%S+00:00")
    return (f"sess-{who}-{days}", who, "C--proj", ts, ts if ended is None else ended, turns, branch)


def activity(spark, rows, viewers=("robert",), **more):
    who = spark.createDataFrame([(v,) for v in viewers], "viewer string")
    return {r.viewer: r.text for r in team_activity(spark.createDataFrame(rows, TEAM), who, NOW, **more).collect()}


def test_team_block(spark):
    block = activity(spark, [team(0.5, "daisy", "feat/awesome", 42), team(1, "robert")])["robert"]
    assert block == (
        "Recent team activity (other engineers, last 7 days):\n\n"
        "- [2026-05-20 00:00] **daisy** on `feat/awesome` (42 turns)\n   project: C--proj"
    )


def test_team_filters(spark):
    rows = [team(0.5, "robert"), team(1, "daisy"), team(2, "robert"), team(12, "morgan"), team(2.5, "casey")]
    block = activity(spark, rows)["robert"]
    assert "**daisy**" in block and "**casey**" in block  # a stale row in between does not stop the list
    assert "**robert**" not in block and "**morgan**" not in block
    assert activity(spark, [team(0.5, "robert"), team(1, "robert")]) == {}


def test_team_times(spark):
    rows = [team(30, "late", ended="2026-05-19T08:00:00Z"), team(30, "odd", ended="no time"), team(30, "gone", ended="")]
    block = activity(spark, rows)["robert"]
    assert "[2026-05-19 08:00] **late**" in block and "[no time] **odd**" in block and "gone" not in block


@pytest.mark.parametrize("limit", [30, None])
def test_everybody_gets_their_own_list(spark, limit):
    # one engineer holds most sessions, and the newest ones
    rows = [team(0.01 * i, "busy") for i in range(40)] + [team(1 + 0.1 * i, f"e{i % 3}") for i in range(20)]
    rows += [team(0.005, "short", turns=1)]
    got = activity(spark, rows, viewers=("busy", "e1", "guest"), fetch_limit=limit)
    newest = sorted((r for r in rows if r[5] >= 2), key=lambda r: (r[3], ), reverse=True)
    for viewer in ("busy", "e1", "guest"):
        fetched = newest if limit is None else newest[:limit]
        expected = [r for r in fetched if r[1] != viewer][:10]
        assert got.get(viewer, "").count("- [") == len(expected), viewer
        assert [line.split("**")[1] for line in got.get(viewer, "").splitlines() if line.startswith("- [")] == [r[1] for r in expected]


def test_team_cap_and_recent(spark):
    rows = [team(0.1 * i, f"engineer-{i}", branch="b" * 400) for i in range(10)]
    block = activity(spark, rows)["robert"]
    assert block.endswith("\n\n[…trimmed…]") and len(block) <= 3000 + len("\n\n[…trimmed…]")
    listed = team_recent(spark.createDataFrame(rows, TEAM), limit=2, engineer="engineer-3").collect()
    assert [r.engineer_id for r in listed] == ["engineer-3"]


@pytest.fixture
def library(tmp_path):
    root = tmp_path / "repo" / ".notes" / "library"
    files = {
        "lessons/deno-cache.md": "# Deno cache\n\n**Status**: active\n\nClear the deno cache before you deploy, or the old module is served.\n",
        "runbooks/deploy.md": "no heading\n\nRun the deploy script and then check that the deno cache is cold.\r\nDone.",
        "decisions/README.md": "# deno cache\n\ndeno cache deno cache deno cache deno cache",
        "decisions/none.md": "# Other\n\nNothing to see in this paragraph, move on please.",
        "_archive/old.md": "# deno cache",
        "lessons/notes.txt": "deno cache",
    }
    for name, text in files.items():
        path = root / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_bytes(text.encode())
    (root / "lessons" / "binary.md").write_bytes(b"\xff\xfe deno cache")
    return root


def test_notes(spark, library):
    notes = scan_notes(spark, str(library))
    assert sorted(r.stem for r in notes.collect()) == ["deno-cache", "deploy", "none"]
    found = notes_search(notes, ["Deno Cache", "deploy", "deploy"]).collect()
    assert [(r.title, r.score) for r in found] == [("deploy", 5 + 1 + 5 + 1 + 1), ("Deno cache", 3 + 1 + 1 + 1)]
    assert found[0].matched_keywords == ["Deno Cache", "deploy"]
    assert found[1].rel_path == ".notes/library/lessons/deno-cache.md"
    assert found[1].excerpt.startswith("Clear the deno cache")
    assert scan_notes(spark, str(library / "nowhere")).count() == 0


def test_excerpts(spark):
    from turnstone.functions import best_excerpt

    def excerpt(text, *keywords):
        return spark.range(1).select(best_excerpt(F.lit(text), list(keywords)).alias("x")).first().x

    a, b, c = "first paragraph with many words in it", "cache and cache are in here, twice over", "cache cache CACHE three times and then more"
    d = "cache cache cache cache four times in this one"
    assert excerpt("\n\n".join([a, b, c, d]), "cache") == c  # three are enough
    assert excerpt("\n\n".join([a, b]), "nothing") == a
    assert excerpt("\n\n".join(["--- front matter that is long enough to count", "# short", b]), "cache") == b
    assert excerpt("tiny", "tiny") == ""
    long = "word\n" * 100
    assert excerpt(long, "word") == long[:240].rstrip().replace("\n", " ") + " …"
    assert excerpt(a + " (a.b) +", "(a.b)", "+") == a + " (a.b) +"


def test_tied_notes_keep_folder_order(spark):
    rows = [("z/b", "decisions", "b", "key"), ("z/a", "lessons", "a", "key"), ("z/c", "lessons", "c", "key")]
    notes = spark.createDataFrame(rows, "rel_path string, category string, stem string, content string")
    assert [r.rel_path for r in notes_search(notes, ["key"]).collect()] == ["z/a", "z/c", "z/b"]
    assert score_notes(notes, ["absent"]).count() == 0
