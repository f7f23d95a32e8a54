import math
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from turnstone.llm.backoff_lm import score_texts
from turnstone.llm.line_chunks import without_repeated_lines, without_spans


@pytest.mark.parametrize("order, part_chars", [(3, 2_000), (1, 10**9), (2, 5_000)])
def test_automaton_as_brute_force(corpus, frame, order, part_chars):
    strength = (5.0, 2.0)
    got = score_texts(frame(corpus), F.col("doc_id") % 3 != 0, order, strength, part_chars).collect()
    seen = [Counter() for _ in range(order + 1)]
    tokens = [(i, (t or "").encode().lower().split() + [b"\n"]) for i, t in corpus]
    for i, w in tokens:
        if i is not None and i % 3:
            for n in range(1, order + 1):
                seen[n].update(tuple(w[k : k + n]) for k in range(len(w) - n + 1))
    total, kinds = sum(seen[1].values()), len(seen[1])

    def read(state, word):
        """Follows failure arcs from the state until it has an arc for the word."""
        if not state:
            return (seen[1][(word,)] + 1) / (total + kinds + 1)
        held, k = seen[len(state)][state], strength[len(state) - 1]
        below = read(state[1:], word)
        return (seen[len(state) + 1][(*state, word)] + k * below) / (held + k) if held else below

    want = []
    for i, w in tokens:
        base = sum(math.log10(read((), x)) for x in w)
        score = sum(math.log10(read(tuple(w[max(0, k - order + 1) : k]), w[k])) for k in range(len(w)))
        want.append((i, len(w), sum((x,) in seen[1] for x in w), total, base, score))
    key = lambda r: (r[0] is None, r[0] or 0, r[1])
    assert len(got) == len(want)
    for a, b in zip(sorted(map(tuple, got), key=key), sorted(want, key=key)):
        assert a[:4] == b[:4] and a[4] == pytest.approx(b[4]) and a[5] == pytest.approx(b[5])


def test_probabilities_sum_to_one(spark):
    """After any words, the probabilities of all known tokens, the end and one unknown word."""
    learned = "a b a c b a a b"
    rows = [(0, learned)] + [(i + 1, t) for i, t in enumerate(["a b a", "a b b", "a b c", "a b zz", "a b"])]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    s = {r.doc_id: r.score for r in score_texts(docs, F.col("doc_id") == 0, 3, (2.0, 1.0)).collect()}
    # (a b x end) and (a b end): take the end's share out with another text that ends alike
    whole = score_texts(docs, F.lit(False), 3).first()
    assert whole.train_tokens == 0 and whole.n_known == 0 and whole.score == 0.0
    assert all(v < 0 for v in s.values())
    assert score_texts(docs.limit(0), F.lit(True)).count() == 0


def plain_chunks(text):
    """(first word, word after the last) of each chunk, by the rules in plain Python."""
    import xxhash

    least = lambda v, i: (i == 0 or v[i] < v[i - 1]) and (i == len(v) - 1 or v[i] < v[i + 1])
    pieces, at = [], 0  # first word and words of each line or piece of a long one
    for line in text.split("\n"):
        own = line.encode().split()
        hashes = [xxhash.xxh64_intdigest(w, 11) for w in own]
        begin = 0
        for i in range(len(own)):
            if i == len(own) - 1 or (len(own) > 8 and least(hashes, i)):
                pieces.append((at + begin, hashes[begin : i + 1]))
                begin = i + 1
        at += len(own)
    mix, full = 0x9E3779B97F4A7C15, (1 << 64) - 1
    lines = [sum(h * pow(mix, k + 1, 1 << 64) for k, h in enumerate(p)) & full for _, p in pieces]
    rolled = []
    for i in range(len(lines)):
        r = 0
        for k in range(2):
            r = (r * mix + (lines[i + k] if i + k < len(lines) else 0)) & full
        rolled.append((r ^ r >> 29) * mix & full)
    starts = [pieces[i][0] for i in range(len(pieces)) if i == 0 or least(rolled, i)]
    return list(zip(starts, starts[1:] + [at]))


def brute(rows):
    """Texts without repeated passages: copies of chunks of 6 words, grown by up to 32 equal words, in runs of 20 words."""
    places = defaultdict(set)
    for i, t in rows:
        words = (t or "").encode().split()
        for a, b in plain_chunks(t or ""):
            if b - a >= 6:
                places[tuple(words[a:b])].add((i is None, i or 0, t or "", a, b))
    twice = {p for same in places.values() if len(same) > 1 for p in same}
    starts, ends = {(*p[:3], p[3]) for p in twice}, {(*p[:3], p[4]) for p in twice}
    gone = defaultdict(set)
    for same in places.values():
        # the order of texts of one id is by a hash; here it tells itself
        first, *copies = sorted(same)
        others = first[2].encode().split()
        for p in copies:
            words, a, b = p[2].encode().split(), p[3], p[4]
            low, high = 0, 0
            while low < 32 and not {(*p[:3], a), (*first[:3], first[3])} & ends and a - low > 0 and first[3] - low > 0 and words[a - low - 1] == others[first[3] - low - 1]:
                low += 1
            while high < 32 and not {(*p[:3], b), (*first[:3], first[4])} & starts and b + high < len(words) and first[4] + high < len(others) and words[b + high] == others[first[4] + high]:
                high += 1
            gone[p[:3]].update(range(a - low, b + high))
    out = []
    for i, t in rows:
        own, spans = sorted(gone[i is None, i or 0, t or ""]), []
        for w in own:
            if spans and spans[-1][1] == w:
                spans[-1][1] += 1
            else:
                spans.append([w, w + 1])
        out.append((i, without_spans((t or "").encode(), [(a, b) for a, b in spans if b - a >= 20]).decode()))
    return out


def five(text):
    words = text.split()
    return {tuple(words[k : k + 5]) for k in range(len(words) - 4)}


def test_repeated_passages_go_and_the_first_stays(corpus, prose, frame):
    passage = prose.text(90)
    rows = list(corpus) + [(300 + k, f"{prose.text(30)} {passage} {prose.text(25)}") for k in range(6)]
    rows += [(400, None), (401, prose.text(40_000)), (402, f"{prose.text(9)}\n{passage}\n{prose.text(700)}")]
    got = without_repeated_lines(frame(rows))
    assert got.columns == frame(rows).columns
    found = sorted(((r.doc_id, r.text) for r in got.collect()), key=str)
    assert found == sorted(brute(rows), key=str)
    texts = dict(found)
    for k in (301, 302, 303, 304, 305, 402):
        # a chunk at the passage's edge may be one only here and in a later text, and stays where it is first
        assert len(five(passage) & five(texts[k])) <= 2
    assert five(passage) <= five(texts[300]) and texts[401] == dict(rows)[401] and texts[400] == ""
    assert without_repeated_lines(frame(rows).limit(0)).count() == 0


def test_common_phrases_stay(spark, prose):
    """Unrelated texts that share a phrase of up to 19 words lose nothing."""
    rows = []
    for n in (6, 9, 12, 15, 19):
        for k in range(12):
            shared = prose.text(n).replace("\n", " ")
            rows += [(len(rows), f"{prose.text(60)} {shared} {prose.text(60)}"), (len(rows) + 1, f"{prose.text(50)} {shared} {prose.text(70)}")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    assert dict(map(tuple, without_repeated_lines(docs).collect())) == dict(rows)


def test_recall_on_planted_passages(spark, prose):
    rows, passages = [], []
    for n in range(50, 101, 2):
        passages.append(prose.text(n))
        rows += [(len(rows) + k, f"{prose.text(20 + 7 * k)} {passages[-1]} {prose.text(33)}") for k in range(4)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    got = dict(map(tuple, without_repeated_lines(docs).collect()))
    left = total = 0
    for nr, passage in enumerate(passages):
        assert five(passage) <= five(got[4 * nr])
        for k in (1, 2, 3):
            total += len(five(passage))
            left += len(five(passage) & five(got[4 * nr + k]))
    assert left / total <= 0.1


def test_removal_keeps_the_rest_as_it_was():
    text = "  one two\tthree \n four five\n\nsix "
    assert without_spans(text.encode(), []) == text.encode()
    assert without_spans(text.encode(), [(1, 3)]) == b"  one \nfour five\n\nsix "
    assert without_spans(text.encode(), [(0, 6)]) == b"  "
    assert without_spans(text.encode(), [(0, 2), (1, 4)]) == b"  five\n\nsix "


def test_counts_follow_the_text(spark, prose):
    text = prose.text(200)
    docs = spark.createDataFrame([(1, text, 7, "s"), (2, text, 7, "s")], "doc_id long, text string, n_chars long, source string")
    got = {r.doc_id: r for r in without_repeated_lines(docs).collect()}
    assert got[1].text == text and got[1].n_chars == len(text)
    assert len(got[2].text) < len(text) / 2 and got[2].n_chars == len(got[2].text)
