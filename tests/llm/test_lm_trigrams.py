"""The LM query with triples of words against SQL, over its whole table."""

import duckdb
import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import functions as F

from turnstone.llm.backoff_lm import END, SEED, border, pack_counts, pack_sorted, runs_of, score_texts, token_hashes, unpack_counts, unpack_sorted
from turnstone.llm.queries import op7_lm_scoring

SF = "/root/testdata/sf0.001"
CRC = """xor(list_reduce(list_concat([4294967295::UBIGINT], list_transform(string_split(doc_id::VARCHAR, ''), lambda ch: ascii(ch)::UBIGINT)),
  lambda c, b: list_reduce(list_concat([xor(c, b)], [0::UBIGINT, 0, 0, 0, 0, 0, 0, 0]),
    lambda x, y: CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384::UBIGINT) ELSE x >> 1 END)), 4294967295::UBIGINT)"""
SQL = rf"""
WITH docs AS (SELECT doc_id, row_number() OVER () AS n, {CRC} % 7 = 2 AS held_out,
    list_append(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+'), chr(10)) AS words
  FROM documents),
tokens AS (SELECT n, held_out, unnest(words) AS w, generate_subscripts(words, 1) AS place FROM docs),
runs AS (SELECT *, lag(w) OVER (PARTITION BY n ORDER BY place) AS prev, lag(w, 2) OVER (PARTITION BY n ORDER BY place) AS far FROM tokens),
learned AS (SELECT * FROM runs WHERE NOT coalesce(held_out, false)),
ones AS (SELECT w, count(*) AS c FROM learned GROUP BY w),
twos AS (SELECT prev, w, count(*) AS c FROM learned WHERE prev IS NOT NULL GROUP BY prev, w),
threes AS (SELECT far, prev, w, count(*) AS c FROM learned WHERE far IS NOT NULL GROUP BY far, prev, w),
sums AS (SELECT coalesce(sum(c), 0)::BIGINT AS total, count(*) AS kinds FROM ones),
low AS (SELECT r.*, o.c IS NOT NULL AS known, (coalesce(o.c, 0) + 1) / (total + kinds + 1.0::DOUBLE) AS base, h.c AS held, coalesce(t.c, 0) AS c
  FROM runs r CROSS JOIN sums LEFT JOIN ones o ON o.w = r.w LEFT JOIN ones h ON h.w = r.prev
  LEFT JOIN twos t ON t.prev = r.prev AND t.w = r.w),
mid AS (SELECT *, CASE WHEN held IS NULL THEN base ELSE (c + 150.0 * base) / (held + 150.0) END AS p FROM low),
top AS (SELECT m.*, CASE WHEN h.c IS NULL THEN p ELSE (coalesce(t.c, 0) + 40.0 * p) / (h.c + 40.0) END AS q
  FROM mid m LEFT JOIN twos h ON h.prev = m.far AND h.w = m.prev
  LEFT JOIN threes t ON t.far = m.far AND t.prev = m.prev AND t.w = m.w)
SELECT doc_id, count(*) AS n_tokens, count(*) FILTER (known) AS n_known, any_value(total) AS train_tokens, sum(log10(base)) AS base_score, sum(log10(q)) AS score
FROM top JOIN docs USING (n) CROSS JOIN sums GROUP BY n, doc_id"""


def test_query_reads_triples(spark):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{SF}/documents.parquet'")
    names = ["doc_id", "n_tokens", "n_known", "train_tokens", "base_score", "score"]
    key = lambda r: (r[0] is None, *(x or 0 for x in r))
    want = sorted(con.sql(SQL).fetchall(), key=key)
    got = sorted((tuple(r[c] for c in names) for r in op7_lm_scoring(spark, SF).collect()), key=key)
    assert len(got) == len(want) > 0
    for a, b in zip(got, want):
        assert a[:4] == b[:4] and abs(a[4] - b[4]) < 1e-5 and abs(a[5] - b[5]) < 1e-5


def test_packed_ranges_come_back():
    rng = np.random.default_rng(3)
    for i in range(7):
        base = border(i, 7)
        for size in (0, 1, 2, 5_000):
            keys = np.unique(np.concatenate([rng.integers(base, border(i + 1, 7), size, np.uint64, endpoint=False), np.array([base] * (size > 1), np.uint64)]))
            counts = rng.integers(0, 70_000, len(keys))
            assert (unpack_sorted(pack_sorted(keys, base), base, len(keys)) == keys).all()
            assert (unpack_counts(pack_counts(counts)) == counts).all()
    keys = np.unique(rng.integers(border(6, 7), border(7, 7) - 1, 5_000, np.uint64))
    assert len(pack_sorted(keys, border(6, 7))) < 7 * len(keys)


def test_hashes_are_those_of_the_words():
    texts = ["", " ", "a", "\tA a\x0bB\n", "x\u00a0y\x1cz \u2028 É é", "Some words, some Words.\n" * 40, "  \n ", "the end\n"]
    got, ends = token_hashes(pa.array(texts, pa.large_string()).slice(1))
    words = [t.encode().lower().split() for t in texts[1:]]
    assert got.tolist() == [h for w in words for h in [*(xxhash.xxh64_intdigest(x, SEED) for x in w), END]]
    assert np.diff(ends, prepend=0).tolist() == [len(w) + 1 for w in words]
    assert runs_of([], 5) == [] and runs_of([0, 3, 1, 12, 0, 1, 9], 5) == [(0, 3), (3, 6), (6, 7)]
    none, ends = token_hashes(pa.array([], pa.large_string()))
    assert len(none) == len(ends) == 0


def test_scoring_sorts_n_grams_and_searches_none(spark, monkeypatch):
    """Run as Spark runs it, but in this process: no search in all n-grams for each place, no table of hashes."""
    from turnstone.llm import backoff_lm

    taken = {}
    group = type(spark.range(1).groupBy("id"))
    kept = group.applyInArrow
    monkeypatch.setattr(group, "applyInArrow", lambda self, f, schema: (taken.setdefault(f.__name__, f), kept(self, f, schema))[1])
    cogroup = type(spark.range(1).groupBy("id").cogroup(spark.range(1).groupBy("id")))
    joined = cogroup.applyInArrow
    monkeypatch.setattr(cogroup, "applyInArrow", lambda self, f, schema: (taken.setdefault(f.__name__, f), joined(self, f, schema))[1])
    docs = spark.createDataFrame([(1, "a b a c"), (2, "a b")], "doc_id long, text string")
    want = score_texts(docs, F.lit(True), 3).collect()
    codec = pa.Codec("zstd")
    texts = pa.table({"doc_id": [1, 2], "text": [codec.compress(t, asbytes=True) for t in (b"a b a c", b"a b")], "size": [7, 3], "learn": [True, True]})
    key = (pa.scalar(0),)
    counted = taken["count"](key, texts)
    totals = pa.concat_tables([taken["add"]((pa.scalar(n), pa.scalar(0)), counted.filter(pa.compute.equal(counted["n"], n))) for n in (1, 2, 3)])

    def refuse(*_, **__):
        raise AssertionError("searched")

    plain = np.unique
    monkeypatch.setattr(backoff_lm.np, "searchsorted", refuse)
    monkeypatch.setattr(backoff_lm.np, "unique", lambda x, return_inverse=False: plain(x, return_inverse=True) if return_inverse else refuse())
    got = taken["score"](key, texts, totals).to_pylist()
    assert sorted(tuple(r.values()) for r in got) == sorted(map(tuple, want))
