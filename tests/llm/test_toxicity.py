import math
import random
import time

import pytest

from turnstone.llm.toxicity import Lexicon, folded, hits, score_documents, train, without_toxic


def test_folding():
    assert folded("1d10t, ІDІOТ! Ídïot $cum a!b trash$$$").split() == ["idiot", "idiot", "idiot", "scum", "aib", "trash"]


def test_folding_keeps_all_scripts():
    assert folded("Слово\u2014слова, id\u200biot don\u2019t").split() == [*folded("слово").split(), *folded("слова").split(), "idiot", "don", "t"]
    assert folded("你是x がき").split() == ["你", "是", "x", "\u304b\u3099", "き"]
    assert all(folded(w).split() != [] for w in ("дурак", "μωρός", "غبي", "मूर्ख", "바보"))


def plain_hits(weights, exceptions, words):
    """Every word against every term and phrase, one by one."""
    found, at = {}, 0
    for i, w in enumerate(words):
        fitting = [x for t, x in weights.items() if (f" {w} " == t if t.endswith(" ") else f" {w}".startswith(t))]
        spared = any(
            words[j : j + len(p)] == p for p in (e.split() for e in exceptions) for j in range(max(0, i - len(p) + 1), i + 1)
        )
        if fitting and not spared:
            found[at] = max(fitting)
        at += len(w) + 1
    return found


def test_matcher_and_scores_as_naive_search(spark):
    r = random.Random(5)
    word = lambda: "".join(r.choice("abд") for _ in range(r.randint(1, 6)))
    rows, lexicons = [], []
    for _ in range(60):
        known = [word() for _ in range(12)]
        weights = {f" {w} ": r.random() + 1 for w in known[:4]} | {f" {w[:4]}": r.random() + 1 for w in known[4:8]}
        phrases = [" ".join(r.choices(known, k=r.randint(2, 3))) for _ in range(4)]
        words = r.choices(known, k=r.randint(0, 60))
        lexicon = Lexicon(weights, phrases, slope=1.5, bias=-0.5)
        assert hits(lexicon.machine(), words) == plain_hits(weights, phrases, words)
        rows.append(" ".join(words))
        lexicons.append(lexicon)
    lexicon = lexicons[0]
    docs = spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string")
    for got in score_documents(docs, lexicon).collect():
        words = folded(rows[got.doc_id]).split()
        raw = sum(plain_hits(lexicon.weights, lexicon.exceptions, words).values()) / math.sqrt(len(words) + 20)
        assert got.score == pytest.approx(1 / (1 + math.exp(0.5 - 1.5 * raw)), abs=1e-12)


def test_long_texts_full_of_exceptions_take_linear_time():
    machine = Lexicon({" fool ": 3.0}, ["fool gold"]).machine()
    started = time.process_time()
    assert len(hits(machine, ["fool", "gold", "fool", "x"] * 100_000)) == 100_000
    assert time.process_time() - started < 10


@pytest.fixture(scope="module")
def model(spark, prose):
    rows = [(i, prose.text(40) + (" you muppetish fool, muppetry" if i % 4 == 0 else " plain") + (" fool gold" if i % 4 == 1 else ""), int(i % 4 == 0)) for i in range(200)]
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(i, x) for i, _, x in rows] + [(None, 1), (3, None)], "doc_id long, toxic int")
    return train(docs, labels), docs, rows


def test_learned_terms_and_scores(spark, model, frame):
    lexicon, docs, rows = model
    assert any(t.strip().startswith("mupp") for t in lexicon.weights)
    got = {r.doc_id: r for r in score_documents(docs, lexicon).collect()}
    assert all(got[i].predicted == x for i, _, x in rows)
    odd = frame([(1, None), (2, ""), (3, "MUPPETISH f00l mupp3try"), (3, "MUPPETISH f00l mupp3try"), (None, "calm words " * 20000)])
    found = [(r.doc_id, r.score, r.predicted) for r in score_documents(odd, lexicon).collect()]
    assert len(found) == 5 and all(0 <= s <= 1 for _, s, _ in found)
    assert {(i, p) for i, _, p in found} == {(1, 0), (2, 0), (3, 1), (None, 0)}
    kept = without_toxic(odd, lexicon)
    assert kept.columns == odd.columns and sorted(str(r.doc_id) for r in kept.collect()) == ["1", "2", "None"]
    assert score_documents(odd.limit(0), lexicon).count() == 0


def test_exception_phrases_spare_a_term(spark):
    lexicon = Lexicon({" fool ": 3.0}, ["fool s gold"], slope=10.0, bias=-2.0)
    docs = spark.createDataFrame([(1, "fool's gold"), (2, "a fool and his gold"), (3, "foolish")], "doc_id long, text string")
    assert {r.doc_id: r.predicted for r in score_documents(docs, lexicon).collect()} == {1: 0, 2: 1, 3: 0}


def test_without_labels_nothing_is_toxic(spark, corpus, frame):
    docs = frame(corpus)
    none = spark.createDataFrame([], "doc_id long, toxic int")
    assert {r.predicted for r in score_documents(docs, train(docs, none)).collect()} == {0}
