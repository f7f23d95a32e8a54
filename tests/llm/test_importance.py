import hashlib
import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from turnstone.llm import span_crc
from turnstone.llm.importance import feature_buckets, resample
from turnstone.llm.span_crc import crc32_of_spans

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
ASCII_LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def features(text, shortest, longest):
    words = WORD.findall((text or "").translate(ASCII_LOWER))
    return [" ".join(words[i : i + n]) for n in range(shortest, longest + 1) for i in range(len(words) - n + 1)], len(words)


def plain(docs, target, percent, min_words, seed, shortest, longest, buckets):
    bucket = lambda f: zlib.crc32(f.encode()) % buckets
    s = Counter(bucket(f) for _, t in docs for f in features(t, shortest, longest)[0])
    t = Counter(bucket(f) for x in target for f in features(x, shortest, longest)[0])
    total, wanted = sum(s.values()), sum(t.values())
    gain = [math.floor(1000 * math.log((t[b] + 1) * (total + buckets) / ((s[b] + 1) * (wanted + buckets)))) for b in range(buckets)]
    rows = []
    for i, text in docs:
        found, n_words = features(text, shortest, longest)
        h = int(hashlib.sha256(f"{seed}:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        weight = sum(gain[bucket(f)] for f in found)
        rows.append([i, len(found), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), n_words])
    may = sorted((r for r in rows if r[4] >= min_words), key=lambda r: (-r[3], r[0] is None, r[0] or 0))
    drawn = {id(r): n + 1 for n, r in enumerate(may[: len(may) * percent // 100])}
    return [(*r[:4], drawn.get(id(r))) for r in rows]


@settings(max_examples=80, deadline=None)
@given(st.binary(min_size=1, max_size=1500), st.data())
def test_checksums_as_the_librarys(data, draw):
    spans = [(a, draw.draw(st.integers(0, len(data) - a))) for a in draw.draw(st.lists(st.integers(0, len(data)), max_size=30))]
    starts, lengths = (np.array([s[i] for s in spans], np.int64) for i in range(2))
    got = crc32_of_spans(np.frombuffer(data, np.uint8), starts, lengths)
    assert got.tolist() == [zlib.crc32(data[a : a + n]) for a, n in spans]


def test_checksums_of_long_spans_and_of_many(monkeypatch):
    data = np.random.default_rng(0).integers(0, 256, 300_000, np.uint8)
    lengths = np.array([*range(0, 1100), 5_000, 200_000, 299_000])
    starts = np.arange(len(lengths)) % 7
    for piece in (1 << 20, 3_000):  # few bytes at a time change nothing
        monkeypatch.setattr(span_crc, "PIECE", piece)
        got = crc32_of_spans(data, starts, lengths)
        assert got.tolist() == [zlib.crc32(data[a : a + n].tobytes()) for a, n in zip(starts, lengths)]


@settings(max_examples=80, deadline=None)
@given(st.lists(st.text(st.sampled_from("aB3 ,-\0\néß漢́İK"), max_size=30), max_size=6), st.sampled_from([(1, 1), (1, 3), (2, 2)]))
def test_buckets_of_features(texts, sizes):
    bucket, of, words = feature_buckets([t.encode() for t in texts], *sizes, 997)
    got = [sorted(bucket[of == i].tolist()) for i in range(len(texts))]
    assert got == [sorted(zlib.crc32(f.encode()) % 997 for f in features(t, *sizes)[0]) for t in texts]
    assert words.tolist() == [features(t, 1, 1)[1] for t in texts]


@pytest.mark.parametrize(("sizes", "percent", "min_words"), [((1, 1), 10, 20), ((1, 2), 35, 5), ((2, 3), 100, 0)])
def test_drawn_as_by_brute_force(spark, corpus, frame, prose, sizes, percent, min_words):
    docs = [*corpus, (200, "x" * 3_000 + " " + prose.text(30)), (201, prose.text(9_000)), (202, "Ünï çødé 漢字 word " * 9), (7, corpus[7][1])]
    target = [prose.text(60), None, "", docs[3][1]]
    wanted = spark.createDataFrame([(t, "z") for t in target], "text string, doc_id string")
    got = resample(frame(docs), wanted, percent, min_words, 2024, *sizes, buckets=500)
    assert got.columns == ["doc_id", "n_features", "weight", "score", "rank"]
    assert sorted(map(repr, map(tuple, got.collect()))) == sorted(map(repr, plain(docs, target, percent, min_words, 2024, *sizes, 500)))


def test_empty_tables(spark, frame):
    none = spark.createDataFrame([], "text string")
    assert resample(frame([]), none).collect() == []
    rows = resample(frame([(1, None), (2, "one word"), (None, "")]), none, percent=100, min_words=1, longest=1).collect()
    assert {(r.doc_id, r.n_features, r["rank"]) for r in rows} == {(1, 0, None), (2, 2, 1), (None, 0, None)}
