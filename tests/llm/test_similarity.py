import hashlib
import itertools

import numpy as np
import pytest
import xxhash

from turnstone.llm.components import components
from turnstone.llm.fingerprints import fingerprint, fingerprint_documents, neighbours
from turnstone.llm.near_copies import without_near_copies
from turnstone.llm.simhash_tree import fingerprints, links, near_duplicates


def plain_print(text, size=3):
    w = (text or "").encode().lower().split()
    h = [xxhash.xxh64_intdigest(b" ".join(w[i : i + size]), 42) for i in range(max(1, len(w) - size + 1))] if w else []
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def grouped(nodes, pairs):
    up = {n: n for n in nodes}

    def root(n):
        while up[n] != n:
            n = up[n]
        return n

    for a, b in pairs:
        a, b = root(a), root(b)
        up[max(a, b)] = min(a, b)
    return {n: root(n) for n in nodes}


def test_components_as_union_find(spark):
    rng = np.random.default_rng(2)
    pairs = [(int(a), int(b)) for a, b in rng.integers(0, 400, (330, 2))] + [(1000 + i, 1001 + i) for i in range(40)] + [(5000, 5001 + i) for i in range(60)]
    got = {r.node: r.root for r in components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    want = grouped({n for p in pairs for n in p}, pairs)
    linked = {n for a, b in pairs if a != b for n in (a, b)}
    assert got == {n: r for n, r in want.items() if n in linked}


@pytest.mark.parametrize("shard_rows", [40, 100_000])
def test_tree_finds_all_links(spark, shard_rows):
    rng = np.random.default_rng(3)
    base = rng.integers(0, 1 << 63, 900, dtype=np.uint64)
    near = [int(x) ^ sum(1 << int(b) for b in rng.choice(64, k, replace=False)) for x, k in zip(base[:300], itertools.cycle([1, 2, 3, 4, 5]))]
    crowd = [int(base[0]) ^ 1 << b for b in range(64)]
    points = sorted({*map(int, base), *near, *crowd})
    frame = spark.createDataFrame([(p - (1 << 64) if p >> 63 else p,) for p in points], "fp long").repartition(3)
    got = links(frame, 3, shard_rows).collect()
    found = grouped(points, [(r.a % (1 << 64), r.b % (1 << 64)) for r in got])
    pairs = [(a, b) for a, b in itertools.combinations(points, 2) if (a ^ b).bit_count() <= 3]
    assert found == grouped(points, pairs)
    assert all((r.a, r.b) and len(got) < 20 * len(points) for r in got)


def test_near_duplicates_as_brute_force(corpus, frame):
    prints = [plain_print(t) for _, t in corpus]
    pairs = [(i, j) for i, j in itertools.combinations(range(len(corpus)), 2) if (prints[i] ^ prints[j]).bit_count() <= 3]
    roots = grouped(range(len(corpus)), pairs)
    least = {}
    for n, r in roots.items():
        if corpus[n][0] is not None:
            least[r] = min(least.get(r, 1 << 60), corpus[n][0])
    want = sorted(str((corpus[n][0], f"{prints[n]:016x}", least.get(r))) for n, r in roots.items())
    assert sorted(str(tuple(r)) for r in near_duplicates(frame(corpus)).collect()) == want
    assert near_duplicates(frame(corpus).limit(0)).count() == 0


def test_a_long_text_is_voted_in_pieces(spark, monkeypatch):
    text = "one two three four five six " * 60
    monkeypatch.setattr("turnstone.llm.shingles.PIECE", 7)
    from turnstone.llm.shingles import fingerprints_of

    assert int(fingerprints_of([text.encode()], 3)[0]) == plain_print(text)
    assert fingerprints(spark.createDataFrame([(1, text)], "doc_id long, text string")).first().fp % (1 << 64) == plain_print(text)


def test_edits_as_brute_force(corpus, frame):
    got = fingerprint_documents(frame(corpus)).collect()
    assert len(got) == len(corpus)
    rows = sorted(((i, t or "") for i, t in corpus), key=lambda d: (d[0] is None, -(d[0] or 0), d[1]))
    want = []
    for k, (i, t) in enumerate(rows):
        cut = len(t) // 3
        e = t[: len(t) - cut] + rows[(k + 1) % len(rows)][1][:cut]
        want.append((i, len(t), hashlib.sha256(e.encode()).hexdigest()))
    assert sorted(str((r.doc_id, r.n_chars, r.edited_sha256)) for r in got) == sorted(map(str, want))
    distinct = {int(r.fingerprint, 16) for r in got}
    for r in got:
        own = int(r.fingerprint, 16)
        assert r.n_near == sum(0 < (own ^ x).bit_count() <= 3 for x in distinct)
        assert r.near_edited == 1 - (own ^ int(r.edited_fingerprint, 16)).bit_count() / 64
    texts = dict(corpus)
    prints = {r.doc_id: r.fingerprint for r in got}
    assert all(prints[a] == prints[b] for a, b in itertools.combinations(texts, 2) if (texts[a] or "") == (texts[b] or ""))
    assert fingerprint_documents(frame(corpus).limit(0)).count() == 0
    assert fingerprint_documents(frame(corpus[:1])).first().near_next == 1.0


@pytest.mark.parametrize("most", [4, 40])
def test_crowded_buckets_count_every_neighbour_once(spark, most):
    rng = np.random.default_rng(9)
    # many that agree in all but a few bits, so that buckets and their sub-buckets are both crowded
    points = {0x5A5A << 40 | int(low) for low in rng.integers(0, 1 << 10, 150)}
    points |= {0x5A5A << 40 | 1 << int(b) for b in range(64)} | {int(x) for x in rng.integers(0, 1 << 63, 100)}
    points |= {x ^ 1 << 63 for x in list(points)[:20]}
    frame = spark.createDataFrame([(p - (1 << 64) if p >> 63 else p,) for p in sorted(points)] * 2, "fp long").repartition(3)
    got = {r.fp % (1 << 64): r.n_near for r in neighbours(frame, 3, most).collect()}
    near = {p: sum(0 < (p ^ q).bit_count() <= 3 for q in points) for p in points}
    assert got == {p: n for p, n in near.items() if n}


def test_weighted_votes_as_counted_one_by_one(prose):
    for text in ["", "one", "a b", prose.text(80), "x y " * 50 + prose.text(30), "a b c " * 9]:
        got, terms = fingerprint(text), plain_terms(text)
        weights = {h: 1 + int(np.floor(np.log2(terms.count(h)))) for h in terms}
        assert got == sum(1 << b for b in range(64) if 2 * sum(w for h, w in weights.items() if h >> b & 1) > sum(weights.values()))


def plain_terms(text, size=2):
    w = text.encode().lower().split()
    return [xxhash.xxh64_intdigest(b" ".join(w[i : i + size]), 42) for i in range(max(1, len(w) - size + 1))] if w else []


def test_one_of_each_group_of_near_copies_stays(corpus, frame):
    sets = []
    for _, t in corpus:
        w = (t or "").encode().lower().split()
        sets.append({tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set())
    near = lambda x, y: x == y or len(x & y) >= 0.8 * len(x | y) - 1e-9
    pairs = [(i, j) for i, j in itertools.combinations(range(len(corpus)), 2) if near(sets[i], sets[j])]
    roots = grouped(range(len(corpus)), pairs)
    best = {}
    for n, r in roots.items():
        i = corpus[n][0]
        best[r] = min(best.get(r, (True, 0)), (i is None, i or 0))
    got = without_near_copies(frame(corpus))
    assert got.columns == frame(corpus).columns
    assert sorted(str(r.doc_id) for r in got.collect()) == sorted(str(None if none else i) for none, i in best.values())
    assert without_near_copies(frame(corpus).limit(0)).count() == 0
