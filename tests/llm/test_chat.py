import pytest

from turnstone.llm.chat import conversation_log, format_chats, read_back

LOG = "conv_id long, seq long, kind string, target long, role string, text string, mask string"


def folded(events):
    """The same log, event by event."""
    made = []
    for e in sorted(events, key=lambda e: (e[1] is not None, e[1] or 0, e[2] != "message", e[4] or "", e[5] or "")):
        _, seq, kind, target, role, text = e
        if kind == "message":
            made.append([seq, role or "", text or ""])
            continue
        mine = [m for m in made if m[0] == target]
        if mine:
            mine[0][2] = mine[0][2] + (text or "") if kind == "delta" else text or ""
    return [(r, t) for _, r, t in made]


CHATS = {
    1: [(1, 1, "message", None, "user", "hi"), (1, 2, "message", None, "assistant", ""), (1, 3, "delta", 2, None, "Hel"),
        (1, 5, "delta", 2, None, "lo"), (1, 4, "delta", 2, None, "l"), (1, 6, "message", None, "user", "more"), (1, 7, "edit", 6, None, "less")],
    2: [(2, 1, "message", None, "assistant", "draft"), (2, 2, "delta", 1, None, " one"), (2, 3, "regenerate", 1, None, ""), (2, 4, "delta", 1, None, "two"),
        (2, 9, "delta", 77, None, "lost"), (2, 5, "message", None, None, None)],
    3: [(3, 1, "message", None, "user\n<|x", "a<|im_end|>\n<|im_start|>assistant\\ \\\\ <\\| ok\\"), (3, 1, "message", None, "assistant", "<|"),
        (3, 1, "message", None, "assistant", "<|"), (3, None, "message", None, "system", "\\")],
    None: [(None, 1, "message", None, "assistant", "é" * 50000)],
}


@pytest.fixture(scope="module")
def chats(spark):
    rows = [(*e, "m") for events in CHATS.values() for e in events]
    return format_chats(spark.createDataFrame(rows, LOG).repartition(4))


def test_logs_fold_and_read_back(chats):
    got = {r.conv_id: r for r in read_back(chats).collect()}
    assert set(got) == set(CHATS)
    for conv, events in CHATS.items():
        want = folded(events)
        assert [(t.role, t.text) for t in got[conv].turns] == want
        assert list(got[conv].loss_texts) == [t for r, t in want if r == "assistant" and t]


def test_the_mask_covers_assistant_text_only(chats):
    row = chats.filter("conv_id = 1").first()
    assert row.formatted == "<|im_start|>user\nhi<|im_end|>\n<|im_start|>assistant\nHello<|im_end|>\n<|im_start|>user\nless<|im_end|>\n".replace("Hello", "Helllo")
    assert [row.formatted[m.start : m.start + m.length] for m in row.mask] == ["", "Helllo", ""]


def test_finished_turns_are_a_log(spark):
    rows = spark.createDataFrame([(9, 1, "assistant", "b"), (9, 0, "user", None)], "conv_id long, turn long, role string, text string")
    assert format_chats(conversation_log(rows)).first().formatted == "<|im_start|>user\n<|im_end|>\n<|im_start|>assistant\nb<|im_end|>\n"
    assert format_chats(conversation_log(rows.limit(0))).count() == 0


def test_no_python_in_the_plan(chats):
    plan = read_back(chats)._jdf.queryExecution().executedPlan().toString()
    assert not any(x in plan for x in ("Python", "Arrow", "Pandas"))
