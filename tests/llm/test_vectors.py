import hashlib

import duckdb
import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from turnstone.llm.hash_forest import hits_in_shard, nearest_vectors
from turnstone.llm.queries import op12_nearest_vectors
from turnstone.llm.vector_codes import Cells, compress

SF = "/root/testdata/sf0.1"
SCHEMA = "vec_id long, embedding array<float>, label int, v string, id int, shard string, `a.b` int"


def frame(spark, rows):
    return spark.createDataFrame([(i, v, label, "x", 1, "y", 2) for i, v, label in rows], SCHEMA).repartition(3)


def messy(seed, n=300, width=8):
    """(vec_id, vector, label): copies, scaled copies, near copies, ties, repeated rows, vectors that take no part."""
    rng = np.random.default_rng(seed)
    made = [np.round(rng.normal(size=width), 2).astype(np.float32).tolist() for _ in range(n)]
    rows = [(i, v, None if i % 7 == 0 else int(i % 3)) for i, v in enumerate(made)]
    rows += [(1000 + i, made[0], 1) for i in range(40)]
    rows += [(2000 + i, [x * 2 for x in made[3]], 2) for i in range(10)]
    rows += [(3000 + i, [float(np.float32(made[5][0] + 0.01 * i)), *made[5][1:]], 0) for i in range(20)]
    rows += [rows[50], rows[50], rows[100]]
    rows += [
        (4000, None, 1), (4001, [], 1), (4002, [float("nan")] + made[0][1:], 1), (4050, [None] + made[0][1:], None),
        (4004, [float("inf")] + made[0][1:], 2), (4100, [0.0] * width, 1), (4006, [1.0, 2.0, 3.0, 4.0], 1), (None, made[9], 5),
    ]
    return rows


def plain_codes(rows, n_entries, rounds, scale=1024):
    """Codes by full search, in Python integers."""
    ok = [(i, v, label) for i, v, label in rows if v and all(x is not None and np.isfinite(x) for x in v) and len(v) == 8]
    ok.sort(key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    parts = [[[int(np.floor(float(x) * scale)) for x in v[p * 2 : p * 2 + 2]] for p in range(4)] for _, v, _ in ok]
    books = [[row[p] for row in parts[:n_entries]] for p in range(4)]

    def nearest(part, book):
        return min((sum((a - b) ** 2 for a, b in zip(part, entry)), e) for e, entry in enumerate(book))

    for _ in range(rounds):
        for p in range(4):
            groups = {}
            for row in parts:
                groups.setdefault(nearest(row[p], books[p])[1], []).append(row[p])
            for e, group in groups.items():
                books[p][e] = [sum(c) // len(group) for c in zip(*group)]
    sha = hashlib.sha256(",".join(str(x) for book in books for entry in book for x in entry).encode()).hexdigest()
    out = []
    for (i, _, label), row in zip(ok, parts):
        best = [nearest(row[p], books[p]) for p in range(4)]
        out.append((i, "".join(f"{e:02x}" for _, e in best), sum(d for d, _ in best), label))
    sums = {}
    for _, _, error, label in out:
        sums[label] = sums.get(label, 0) + error
    return [(i, code, error, sums[label], sha) for i, code, error, label in out]


@pytest.mark.parametrize(("n_entries", "rounds"), [(16, 4), (256, 2), (1, 1), (64, 0)])
def test_codes_as_by_full_search(spark, n_entries, rounds):
    rows = messy(3)
    got = compress(frame(spark, rows), n_entries=n_entries, rounds=rounds)
    assert got.columns == ["vec_id", "code", "error", "label_error", "codebooks_sha256"]
    assert sorted(map(repr, map(tuple, got.collect()))) == sorted(map(repr, plain_codes(rows, n_entries, rounds)))


def test_codes_of_few_and_of_no_vectors(spark):
    rows = [(7, [1.0] * 8, None), (7, [1.0] * 8, None), (9, None, 1)]
    assert [tuple(r)[:4] for r in compress(frame(spark, rows)).collect()] == [(7, "00000000", 0, 0)] * 2
    for none in ([], [(1, None, 1)], [(1, [1.0, 2.0, 3.0], 1)]):
        assert compress(frame(spark, none)).collect() == []


def test_too_large_components_are_refused(spark):
    with pytest.raises(Exception, match="too large"):
        compress(frame(spark, [(1, [1e30] * 8, 1)])).collect()


@settings(max_examples=60, deadline=None)
@given(st.integers(1, 40), st.integers(1, 4), st.sampled_from([1, 8, 64, 1000]), st.integers(0, 10**6))
def test_cells_never_lose_the_nearest(n_entries, width, side, seed):
    rng = np.random.default_rng(seed)
    entries, parts = rng.integers(-90, 90, (n_entries, width)), rng.integers(-130, 130, (200, width))
    entries[n_entries // 2] = entries[0]  # a tie
    index, error = Cells(entries, side).nearest(parts)
    full = ((parts[:, None] - entries[None]) ** 2).sum(axis=2)
    assert (index == full.argmin(axis=1)).all() and (error == full.min(axis=1)).all()


def test_a_cell_is_bounded_once_and_spares_most_entries(monkeypatch):
    rng = np.random.default_rng(1)
    entries = rng.integers(-1000, 1000, (256, 3))
    cells = Cells(entries, 64)
    learned = []
    monkeypatch.setattr(cells, "learn", lambda new, old=cells.learn: learned.append(len(new)) or old(new))
    parts = rng.integers(-300, 300, (5_000, 3))
    first = cells.nearest(parts)
    assert (cells.nearest(parts)[0] == first[0]).all() and len(learned) == 1 and sum(learned) <= 10**3
    assert cells.masks.mean() < 0.2


def test_a_full_memory_starts_over(monkeypatch):
    monkeypatch.setattr("turnstone.llm.vector_codes.KEPT_CELLS", 30)
    rng = np.random.default_rng(2)
    entries = rng.integers(-100, 100, (20, 4))
    cells = Cells(entries, 16)
    for _ in range(6):
        parts = rng.integers(-100, 100, (25, 4))
        full = ((parts[:, None] - entries[None]) ** 2).sum(axis=2)
        assert (cells.nearest(parts)[0] == full.argmin(axis=1)).all() and len(cells.known) <= 30


def plain_cosine(a, b):
    a, b = np.asarray(a, float), np.asarray(b, float)
    return float(a @ b / (np.sqrt(a @ a) * np.sqrt(b @ b)))


def usable(rows):
    return [(i, v) for i, v, _ in rows if i is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v)]


@pytest.mark.parametrize(("shard_rows", "block_rows", "least_rows"), [(65_536, 16_384, 4_096), (60, 7, 50), (5, 3, 2)])
def test_hits_as_by_comparing_all(spark, shard_rows, block_rows, least_rows):
    rows = messy(4)
    good = usable(rows)
    # a recall of 1 climbs to the empty prefix of every tree: all vectors are met
    vectors = frame(spark, rows)
    got = {}
    found = nearest_vectors(vectors, vectors.filter("vec_id % 50 = 0"), 5, 1.0, shard_rows, block_rows, least_rows)
    assert found.columns == ["query_id", "rank", "vec_id", "score"]
    for r in found.collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    asked = sorted({i for i, _ in good if i % 50 == 0})
    assert sorted(got) == asked
    for q in asked:
        mine = [v for i, v in good if i == q][0]
        best = sorted((-round(plain_cosine(mine, v), 12), i) for i, v in good if i != q and len(v) == len(mine))[:5]
        own = sorted(got[q])
        assert [r for r, _, _ in own] == list(range(1, len(best) + 1))
        assert [(i, pytest.approx(-c, abs=1e-12)) for c, i in best] == [(i, s) for _, i, s in own]


def test_few_candidates_and_no_queries(spark):
    rows = [(0, [1.0, 0.0], 1), (1, [1.0, 1.0], 1), (2, [-1.0, 0.0], 1), (50, None, 1), (100, [0.0, 0.0], 1)]
    vectors = frame(spark, rows)
    got = nearest_vectors(vectors, vectors.filter("vec_id % 50 = 0")).collect()
    assert [(r.query_id, r["rank"], r.vec_id) for r in got] == [(0, 1, 1), (0, 2, 2)]
    assert got[0].score == pytest.approx(np.sqrt(0.5)) and got[1].score == -1.0
    assert nearest_vectors(vectors, vectors.filter("vec_id = 50")).collect() == []
    assert nearest_vectors(frame(spark, []), frame(spark, [])).collect() == []
    alone = frame(spark, rows[:1])
    assert nearest_vectors(alone, alone).collect() == []


def test_cosine_of_huge_and_tiny_vectors():
    ids, vectors = np.arange(4), np.array([[1e300, 1e300], [1e-300, 1e-300], [1e300, 0], [-1e-300, -1e-300]])
    hits = hits_in_shard(ids, vectors, ids[:1], vectors[:1], 3, 0.9)
    assert hits["vec_id"].tolist() == [1, 2, 3]
    assert hits["score"].tolist() == pytest.approx([1, np.sqrt(0.5), -1])


def test_recall_on_the_whole_table(spark):
    data = duckdb.sql(f"SELECT vec_id, embedding FROM '{SF}/embeddings.parquet'").fetchall()
    ids, unit = np.array([r[0] for r in data]), np.array([r[1] for r in data], float)
    unit /= np.linalg.norm(unit, axis=1, keepdims=True)
    got = {}
    for r in op12_nearest_vectors(spark, SF).collect():
        got.setdefault(r.query_id, {})[r.vec_id] = r.score
    met = total = 0
    for q in np.flatnonzero(ids % 50 == 0):
        cosine = unit @ unit[q]
        cosine[q] = -2
        best = np.argsort(-cosine)[:5]
        hits = got[int(ids[q])]
        assert len(hits) == 5
        assert all(abs(score - cosine[np.flatnonzero(ids == i)[0]]) < 1e-12 for i, score in hits.items())
        met += len({int(i) for i in ids[best]} & set(hits))
        total += 5
    assert met / total >= 0.9
