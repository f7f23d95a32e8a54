import json

import pytest
from pyspark.sql import functions as F

from turnstone import functions as X
from turnstone.functions.redact import Rule, java_pattern, java_replacement
from turnstone.functions.text import iso_timestamp


@pytest.fixture(scope="module")
def value(spark):
    one = spark.range(1)

    def evaluate(column):
        return one.select(column.alias("x")).first().x

    return evaluate


JWT = "eyJhbGciOiJIUzI1NiIsInR5cCI6IkpXVCJ9.eyJzdWIiOiIxMjM0NTY3ODkwIn0.SflKxwRJSMeKKF2QT4fwpMeJf36POk6yJV"


@pytest.mark.parametrize(
    "text, expected",
    [
        ("2031-11-02T10:00:00+05:00", "2031-11-02 10:00"),
        ("2031-11-02T10:07:59.123Z", "2031-11-02 10:07"),
        ("2031-11-02", "2031-11-02 00:00"),
        ("2031-11-02 10", "2031-11-02 10:00"),
        ("2026-13-06T10:00:00Z", "2026-13-06T10:00"),
        ("2031-11-02T25:00:00Z", "2031-11-02T25:00"),
        ("yesterday at half past nine", "yesterday at hal"),
        ("", ""),
    ],
)
def test_short_time(value, text, expected):
    assert value(X.fmt_iso_short(F.lit(text))) == expected


def test_times(value):
    assert value(X.fmt_iso_team(F.lit("2031-11-02T10:00:00Z"))) == "2031-11-02 10:00"
    assert value(X.fmt_iso_team(F.lit(None).cast("string"))) == ""
    same = iso_timestamp(F.lit("2031-11-02T10:00:00+05:00")) == F.lit("2031-11-02 05:00:00").cast("timestamp")
    assert value(same) is True
    assert value(iso_timestamp(F.lit("soon"))) is None


@pytest.mark.parametrize("text", ["  a b\t\n", "\u00a0\u2003x\x85\x1c", "", " \n ", "no"])
def test_strip(value, text):
    assert value(X.strip(F.lit(text))) == text.strip()


@pytest.mark.parametrize(
    "text, expected", [("  Foo__Bar! ", "foo-bar"), ("!!!", "untitled"), ("Été à 9", "été-à-9"), ("a - b", "a-b")]
)
def test_slugify(value, text, expected):
    assert value(X.slugify(F.lit(text))) == expected


def test_names(value):
    assert value(X.normalize_user_id(F.lit("Ann O'Neil"))) == "ann-o-neil"
    assert value(X.normalize_user_id(F.lit("***"), default=None)) is None
    assert value(X.normalize_user_id(F.lit("***"))) == "unknown"
    none = F.lit(None).cast("string")
    assert value(X.slug_from_cwd(none, F.lit("C:\\Users\\a"))) == "C--Users-a"
    assert value(X.slug_from_cwd(none, F.lit("/home/a"))) == "home-a"
    assert value(X.slug_from_cwd(F.lit("given"), F.lit("/home/a"))) == "given"
    assert value(X.slug_from_cwd(none, F.lit(""))) is None
    assert value(X.slug_from_path(F.lit("/x/proj/s.1.jsonl"))) == "proj"
    assert value(X.session_from_path(F.lit("/x/proj/s.1.jsonl"))) == "s.1"
    assert value(X.session_from_path(F.lit("/x/project_slug=a%3Ab/transcript=t/part-0.txt"))) == "t"
    assert value(X.slug_from_path(F.lit("/x/project_slug=a%3Ab/transcript=t/part-0.txt"))) == "a:b"


def test_cuts(value):
    long = "x" * 598 + "  " + "y" * 50
    assert value(X.trim_turn(F.lit(long), False)) == "x" * 598 + " […]"
    assert value(X.trim_turn(F.lit(long), True)) == long
    assert value(X.trim_turn(F.lit("x" * 600), False)) == "x" * 600
    assert value(X.cap_block(F.lit("ab \ncd"), 4, "[…]")) == "ab\n\n[…]"
    assert value(X.cap_block(F.lit("abcd"), 4, "[…]")) == "abcd"
    assert value(X.preview(F.lit("a\nb" * 100))) == ("a\nb" * 100)[:200].replace("\n", " ")


def test_tools(value):
    freq = F.create_map(*[F.lit(x) for kv in {"b": 2, "a": 2, "c": 9, "d": 1, "e": 1, "f": 1, "g": 1}.items() for x in kv])
    freq = freq.cast("map<string,bigint>")
    assert value(X.tools_line(freq)) == "Tools used: c ×9, a ×2, b ×2, d ×1, e ×1, f ×1"
    assert value(X.tool_json(freq)) == '{"a":2,"b":2,"c":9,"d":1,"e":1,"f":1,"g":1}'
    assert value(X.tools_line(F.create_map().cast("map<string,bigint>"))) is None


def test_builtin_redaction(value):
    prose = "Nothing sensitive here, just running a normal query."
    assert value(X.redact(F.lit(prose))) == prose
    assert value(X.redact(F.lit(f"the token: {JWT} please"))) == "the token: <JWT-REDACTED> please"
    short = "Image data: eyJ123.eyJ456.short"
    assert value(X.redact(F.lit(short))) == short


def test_custom_redaction(value):
    rules = X.union_rules(
        [("MySecret[A-Za-z0-9]+", "<USER-REDACTED>"), (r"(user@example\.com)\s*/\s*\S+", r"\1 / <PW-REDACTED>")]
    )
    text = f"Found MySecretABC123 and user@example.com / hunter2 in {JWT}"
    assert value(X.redact(F.lit(text), rules)) == (
        "Found <USER-REDACTED> and user@example.com / <PW-REDACTED> in <JWT-REDACTED>"
    )


@pytest.mark.parametrize(
    "pattern, replacement, text",
    [
        (r"(?P<who>\w+)@(?P=who)", r"\g<who>!", "Zoé@Zoé x@y"),
        (r"[[&]+", "#", "a[[b&&c"),
        (r"[]x]", "#", "a]bx"),
        (r"[^]x]", "#", "a]bx"),
        (r"(\d)(\d)", r"\g<2>0\1", "12 34"),
        (r"a{,2}b", "#", "aaab b"),
        (r"x{y}", "$1", "x{y}"),
        (r"\bkey\b$", r"cost $5 \\ done", "my key"),
        (r".", "#", "a\u2028b\r"),
        (r"end\Z", "#", "end"),
        (r"(?i)ÉTÉ", "#", "été"),
    ],
)
def test_python_rules_keep_their_meaning(value, pattern, replacement, text):
    import re

    assert value(X.redact(F.lit(text), [Rule(pattern, replacement)])) == re.sub(pattern, replacement, text)


def test_rules_without_counterpart_are_errors():
    with pytest.raises(ValueError):
        java_pattern(r"(a)?b(?(1)c|d)")
    with pytest.raises(Exception):
        java_pattern("(")
    assert java_replacement(r"\1\n$") == "$1\n\\$"


def test_rule_files(spark, tmp_path):
    def put(name, content):
        path = tmp_path / name
        path.write_text(content if isinstance(content, str) else json.dumps(content))
        return str(path)

    files = [
        put("env.json", [{"pattern": "a"}, {"pattern": 3}, "x", {"pattern": "b", "replacement": "B"}]),
        put("home.json", [{"pattern": "c"}, {"pattern": "("}, {"pattern": "d"}]),
        put("object.json", {"pattern": "e"}),
        put("broken.json", "{"),
        str(tmp_path / "missing.json"),
        put("project.json", [{"pattern": "f", "replacement": "F"}]),
    ]
    assert X.load_redaction_rules(files) == [("a", "<REDACTED>"), ("b", "B"), ("c", "<REDACTED>"), ("f", "F")]
    assert X.load_redaction_rules([f"file://{f}" for f in files], spark) == X.load_redaction_rules(files)
