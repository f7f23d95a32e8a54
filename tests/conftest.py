import json
import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

from turnstone.session import build_session  # noqa: E402


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = build_session(
        "tests",
        "local[4]",
        **{
            "spark.ui.enabled": "false",
            "spark.ui.showConsoleProgress": "false",
            "spark.sql.shuffle.partitions": "4",
            "spark.driver.memory": "4g",
            "spark.checkpoint.dir": tmp_path_factory.mktemp("shared").as_uri(),
            "spark.sql.warehouse.dir": str(tmp_path_factory.mktemp("warehouse")),
        },
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture
def write_transcript(tmp_path):
    """Write a transcript file; items are objects or raw text."""

    def write(lines, slug="proj", name="sess-a", root="projects", newline="\n"):
        folder = tmp_path / root / slug
        folder.mkdir(parents=True, exist_ok=True)
        path = folder / f"{name}.jsonl"
        text = newline.join(x if isinstance(x, str) else json.dumps(x) for x in lines)
        path.write_bytes(text.encode())
        return path

    return write


def user(uuid, text, ts="2031-11-02T08:00:00Z", **more):
    return {
        "type": "user", "uuid": uuid, "timestamp": ts, "sessionId": "sess-a",
        "message": {"role": "user", "content": text}, **more,
    }


def assistant(uuid, blocks, ts="2031-11-02T08:00:05Z", **more):
    return {
        "type": "assistant", "uuid": uuid, "timestamp": ts, "sessionId": "sess-a",
        "message": {"role": "assistant", "content": blocks}, **more,
    }
