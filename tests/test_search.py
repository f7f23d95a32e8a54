import math
import sys

import pytest
from pyspark.sql import functions as F

from turnstone.functions import porter_stem, tokenize
from turnstone.operators import phrase, prefix, term
from turnstone.plans import score_hits, search, search_many, team_search, topk_per_project

CORPUS = [
    "we need to update the database schema",
    "run an ALTER TABLE migration on the rcs_saved_reports table",
    "databases are running; schema schema",
    "hello Café world",
    "foo bar baz qux database",
    " ".join(f"w{i}" for i in range(30)) + " schema and then "
    + " ".join(f"v{i}" for i in range(30)) + " schema migration end",
]
MESSAGE = "uuid string, project_slug string, session_id string, timestamp string, role string, content string"


@pytest.fixture(scope="module")
def messages(spark):
    rows = [(str(i), "p", "s", f"2031-11-02T10:0{i}:00Z", "user", t) for i, t in enumerate(CORPUS, 1)]
    return spark.createDataFrame(rows, MESSAGE).cache()


@pytest.fixture(scope="module")
def sessions(spark):
    return spark.createDataFrame(
        [("s", "p", "2031-11-02T10:00:00Z", "main")],
        "session_id string, project_slug string, started_at string, git_branch string",
    )


# scores of a stand-alone full-text index over the same six texts
GOLDEN = {
    "schema": (term("schema"), {3: -0.000002, 1: -0.000001, 6: -0.000001}),
    "database": (term("database"), {3: -0.000001, 5: -0.000001, 1: -0.000001}),
    "or": (term("schema") | term("migration"), {2: -0.676192, 6: -0.259967, 3: -0.000002, 1: -0.000001}),
    "phrase": (phrase("schema schema"), {3: -1.811019}),
    "not": (term("schema") & ~term("databases"), {6: -0.000001}),
    "nested": ((term("schema") | term("migration")) & ~term("table"), {6: -0.259967, 3: -0.000002, 1: -0.000001}),
    "and": (term("schema") & term("databases"), {3: -0.000003, 1: -0.000003}),
    "diacritics": (term("cafe"), {4: -1.948468}),
    "bare word": (term("rcs_saved_reports"), {2: -1.494701}),
    "prefix": (prefix("ru*"), {3: -0.819292, 2: -0.676192}),
    "prefix of many": (prefix("v1"), {6: -2.099784}),
    "mixed": (phrase("database schema") | term("hello"), {4: -1.948468, 1: -1.691684}),
}


@pytest.mark.parametrize("name", GOLDEN)
def test_scores(messages, name):
    condition, expected = GOLDEN[name]
    hits = score_hits(messages, condition).collect()
    assert {int(r.uuid): round(r.score, 6) for r in hits} == expected


def test_order_and_columns(messages, sessions):
    top = search(messages, sessions, term("schema") | term("migration"), limit=2)
    assert top.columns == [
        "message_uuid", "session_id", "timestamp", "role", "snippet", "score", "project_slug",
        "session_started_at", "git_branch",
    ]
    assert [r.message_uuid for r in top.collect()] == ["2", "6"]
    assert search(messages, sessions, term("schema"), slug="other").count() == 0


@pytest.mark.parametrize(
    "condition, uuid, expected",
    [
        (term("schema") | term("migration"), "6", "…v21 v22 v23 v24 v25 v26 v27 v28 v29 «schema» «migration» end"),
        (term("schema"), "6", "…w25 w26 w27 w28 w29 «schema» and then v0 v1 v2 v3…"),
        (term("w5"), "6", "w0 w1 w2 w3 w4 «w5» w6 w7 w8 w9 w10 w11…"),
        (phrase("schema schema"), "3", "databases are running; «schema schema»"),
        (term("running"), "3", "databases are «running»; schema schema"),
        (term("café"), "4", "hello «Café» world"),
    ],
)
def test_snippets(messages, sessions, condition, uuid, expected):
    found = {r.message_uuid: r.snippet for r in search(messages, sessions, condition).collect()}
    assert found[uuid] == expected


def test_snippet_prefers_the_start_of_a_sentence(spark, sessions):
    text = " ".join(f"a{i}" for i in range(20)) + ". " + " ".join(f"b{i}" for i in range(20))
    one = spark.createDataFrame([("1", "p", "s", "t", "user", text)], MESSAGE)
    (row,) = search(one, sessions, term("b7")).collect()
    assert row.snippet == "…b0 b1 b2 b3 b4 b5 b6 «b7» b8 b9 b10 b11…"


def test_condition_needs_a_token():
    with pytest.raises(ValueError):
        term("!!")


@pytest.mark.parametrize(
    "text, expected",
    [
        ("Über ñandú çà", ["uber", "nandu", "ca"]),
        ("Straße GROSS", ["straße", "gross"]),
        ("a1b2 3.14 x²", ["a1b2", "3", "14", "x²"]),
        ("don't e-mail", ["don", "t", "e", "mail"]),
        ("日本語 text", ["日本語", "text"]),
        ("Привет МИР", ["привет", "мир"]),
        ("ø œ đ ł ﬁne", ["ø", "œ", "đ", "ł", "ﬁne"]),
        ("Cafe\u0301s", ["cafes"]),
        ("İstanbul", ["istanbul"]),
        ("", []),
        (" -- ", []),
        ("Plain ASCII_text", ["plain", "ascii", "text"]),
    ],
)
def test_tokens(spark, text, expected):
    from turnstone.functions.tokens import query_tokens

    assert spark.range(1).select(tokenize(F.lit(text)).alias("t")).first().t == expected
    assert query_tokens(text) == expected


def test_stems(spark):
    expected = {
        "databases": "databas", "migrations": "migrat", "running": "run", "relational": "relat", "hopping": "hop",
        "generalization": "gener", "happy": "happi", "sky": "sky", "ponies": "poni", "agreed": "agre",
        "controlled": "control", "adjustment": "adjust", "nationally": "nation", "etes": "et", "ies": "ie",
    }
    words = spark.createDataFrame([(w,) for w in expected], "word string")
    assert {r.word: r.stem for r in words.withColumn("stem", porter_stem("word")).collect()} == expected


def test_statistics_are_per_project(spark, messages, sessions):
    other = messages.withColumn("project_slug", F.lit("q")).filter("uuid = '4'").withColumn("uuid", F.lit("9"))
    both = messages.unionByName(other)
    scores = {r.uuid: r.score for r in score_hits(both, term("hello")).collect()}
    assert round(scores["4"], 6) == -1.948468
    assert scores["9"] > -1e-5  # the only text of its project
    best = topk_per_project(score_hits(both, term("hello") | term("database")), 1).collect()
    assert {r.project_slug: r.uuid for r in best} == {"p": "4", "q": "9"}


def test_stemmed_prefix_against_brute_force(spark):
    from turnstone.functions import stem_word

    words = ["happy", "happily", "happiness", "happen", "hap", "running", "runner", "runs", "run", "runny", "rune"]
    rows = [(w, "p", "s", "t", "user", w) for w in words]
    docs = spark.createDataFrame(rows, MESSAGE)
    for start in ("happy", "hap", "runn", "running", "rune", "ru"):
        found = {r.uuid for r in score_hits(docs, prefix(start)).collect()}
        assert found == {w for w in words if stem_word(w).startswith(stem_word(start))}, start


def _brute_force(rows, phrases, match_all):
    """Scores of one project by the textbook formula."""
    from turnstone.functions.stem import stem_word
    from turnstone.functions.tokens import query_tokens

    docs = {u: [stem_word(t) for t in query_tokens(c)] for u, c in rows}
    wanted = [[stem_word(t) for t in query_tokens(p)] for p in phrases]
    mean = sum(map(len, docs.values())) / len(docs)

    def tf(doc, p):
        return sum(doc[i : i + len(p)] == p for i in range(len(doc)))

    scores = {}
    for u, doc in docs.items():
        counts = [tf(doc, p) for p in wanted]
        if not (all(counts) if match_all else any(counts)):
            continue
        total = 0.0
        for p, f in zip(wanted, counts):
            n = sum(tf(d, p) > 0 for d in docs.values())
            idf = math.log((len(docs) - n + 0.5) / (n + 0.5))
            idf = idf if idf > 0 else 1e-6
            total -= idf * f * 2.2 / (f + 1.2 * (0.25 + 0.75 * len(doc) / mean))
        scores[u] = round(total, 6)
    return scores


def test_many_searches_at_once(spark, messages):
    asked = {
        1: (["schema", "migration"], False),
        2: (["schema", "databases"], True),
        3: (["schema schema"], True),
        4: (["rcs_saved_reports", "hello"], False),
    }
    queries = spark.createDataFrame(
        [(k, p, m) for k, (p, m) in asked.items()], "query_id int, phrases array<string>, match_all boolean"
    )
    found = {k: {} for k in asked}
    for r in search_many(messages, queries).collect():
        found[r.query_id][r.uuid] = round(r.score, 6)
    rows = [(str(i), t) for i, t in enumerate(CORPUS, 1)]
    for k, (phrases, match_all) in asked.items():
        assert found[k] == _brute_force(rows, phrases, match_all), k


def test_team_search(spark, messages, sessions):
    team = messages.withColumn("engineer_id", F.when(F.col("uuid") < "4", "ann").otherwise("bob"))
    found = team_search(team, sessions, (term("schema") | term("migration")) & ~term("run"), engineer="bob").collect()
    assert [(r.ts, r.engineer_id) for r in found] == [("2031-11-02T10:06:00Z", "bob")]
    # the statistics are those of the whole corpus
    assert round(found[0]["rank"], 6) == 0.259967
    assert "\n" not in found[0].content_preview


def _bulk(spark):
    rows = [(str(i), "p", "running runner walks " * 50 + f"n{i}") for i in range(40)]
    messages = spark.createDataFrame(rows, "uuid string, project_slug string, content string")
    queries = spark.createDataFrame(
        [(1, ["running", "walked"], False), (2, ["running", "walked"], True)], "query_id int, phrases array<string>, match_all boolean"
    )
    return messages, queries


def test_bulk_search_stems_each_word_once(spark, monkeypatch):
    from collections.abc import Iterator

    import pandas as pd
    from pyspark.sql.functions import pandas_udf

    from turnstone.functions.stem import stem_word
    module = sys.modules["turnstone.plans.search"]

    stemmed = spark.sparkContext.accumulator(0)

    @pandas_udf("string")
    def counting(terms: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in terms:
            stemmed.add(len(batch))
            yield batch.map(stem_word, na_action="ignore")

    monkeypatch.setattr(module, "porter_stem", counting)
    messages, queries = _bulk(spark)
    assert search_many(messages, queries, limit=3).count() == 6
    # 6,000 places of three words; the queries' own words are stemmed too, wherever they are asked for
    assert 0 < stemmed.value < 200


def test_bulk_search_adds_a_message_up_in_one_join(spark):
    messages, queries = _bulk(spark)
    found = search_many(messages, queries, limit=3)
    assert found._jdf.queryExecution().optimizedPlan().toString().count("Join Inner") == 1
    assert {(r.query_id, r.rank) for r in found.collect()} == {(q, n) for q in (1, 2) for n in (1, 2, 3)}
