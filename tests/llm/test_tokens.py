import zlib
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from turnstone.llm.packing import best_fit, complete, dominated, fillings, lower_bound, pack
from turnstone.llm.range_coder import RUN, Model, decode, encode, frequencies, renewals, stretches
from turnstone.llm.token_store import decoded, packed_frequencies, read_tokens, unpacked_frequencies, write_tokens
from turnstone.llm.tokens import WordTokenizer, public_tokenizer, split_known, tokenizer

PATH = public_tokenizer()


def library_ids(text):
    return tokenizer(PATH).library.encode(text or "", add_special_tokens=False).ids


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(st.characters(exclude_categories=["Cs"]), max_size=60), max_size=5))
def test_word_by_word_gives_the_librarys_ids(texts):
    assert [x.tolist() for x in tokenizer(PATH).encode(texts)] == [library_ids(t) for t in texts]


def test_a_full_memory_starts_over(monkeypatch, prose):
    monkeypatch.setattr("turnstone.llm.tokens.KEPT_WORDS", 20)
    monkeypatch.setattr("turnstone.llm.tokens.CHUNK_WORDS", 30)
    texts = [prose.text(25) for _ in range(9)] + ["", "it's <|endoftext|>"]
    assert [x.tolist() for x in WordTokenizer(PATH).encode(texts)] == [library_ids(t) for t in texts]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 65535) | st.integers(0, 6), max_size=400), st.sampled_from([1, 7, 64, 300]))
def test_coder_round_trip(ids, size):
    x = np.array(ids, np.uint16)
    blocks = encode(x, size)
    assert len(blocks) == -(-len(x) // size)
    assert decode(blocks, len(x), size).tolist() == ids


def test_coder_gains_on_repeats_and_codes_blocks_apart():
    x = np.tile(np.arange(300, dtype=np.uint16) * 7, 20)
    blocks = encode(x, 2000)
    assert sum(map(len, blocks)) < len(x)  # half of two bytes an id
    assert decode(blocks[1:2], 2000, 2000).tolist() == x[2000:4000].tolist()


def test_store_reads_back_in_order(spark, corpus, frame, tmp_path, monkeypatch):
    path = str(tmp_path / "ids")
    write_tokens(frame(corpus), path, PATH, end_id=1)
    got = sorted(read_tokens(spark, path).collect(), key=lambda r: r.start)
    at = 0
    rows = sorted(((i, t or "") for i, t in corpus), key=lambda d: (d[0] is not None, d[0] or 0, d[1].encode()))
    assert len(got) == len(rows)
    for r, (i, t) in zip(got, rows):
        ids = np.array(library_ids(t) + [1], "<u4")
        assert (r.doc_id, r.start, r.n_tokens, r.ids_crc32) == (i, at, len(ids), zlib.crc32(ids.tobytes()))
        at += len(ids)
    row = spark.read.parquet(path).first().asDict()
    row["payload"] = bytes([row["payload"][0] ^ 255]) + bytes(row["payload"][1:])
    with pytest.raises(ValueError, match="damaged"):
        decoded(row)
    empty = str(tmp_path / "none")
    write_tokens(frame(corpus).limit(0), empty, PATH)
    assert read_tokens(spark, empty).count() == 0


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 40), max_size=60))
def test_bin_completion_uses_each_piece_once(lengths):
    counts = np.bincount(np.array(lengths, int), minlength=41)
    plan = complete(counts, nodes=300)
    used = Counter()
    for filling, times in plan:
        assert sum(x * n for x, n in filling) <= 40
        for x, n in filling:
            used[x] += n * times
    assert used == Counter(lengths)
    total = sum(t for _, t in plan)
    assert lower_bound(counts) <= total <= sum(t for _, t in best_fit(counts))


def test_bin_completion_beats_best_fit():
    counts = np.zeros(101, int)
    for x in (50, 30, 20, 40, 35, 25, 48, 28, 24):  # three perfect bins that best fit misses
        counts[x] += 1
    assert sum(t for _, t in complete(counts)) == 3


@given(st.lists(st.integers(1, 12), max_size=7), st.integers(1, 20))
def test_fillings_are_all_there_least_waste_first(lengths, room):
    counts = np.bincount(np.array(lengths, int), minlength=room + 1)
    got = list(fillings(counts, room))
    every = {()}
    for x in lengths:
        every |= {tuple(sorted([*f, x])) for f in every}
    # by brute force over subsets: each multiset that fits, once
    fit = {tuple(sorted(Counter(f).items(), reverse=True)) for f in every if sum(f) <= room}
    assert sorted(f for f, _ in got) == sorted(fit)
    assert all(w == room - sum(x * n for x, n in f) for f, w in got) and [w for _, w in got] == sorted(w for _, w in got)
    for filling, waste in got:
        left = Counter(lengths)
        left.subtract(dict(filling))
        left = +left
        longer = any(y <= waste for y in left) or any(x < y <= x + waste for x, _ in filling for y in left)
        assert dominated(np.array([left.get(x, 0) for x in range(len(counts))]), filling, waste) == longer


@pytest.mark.parametrize("seed", [0, 1])
def test_planted_triples_are_found(seed):
    rng = np.random.default_rng(seed)
    counts = np.zeros(2049, np.int64)
    for _ in range(300):  # no two of three pieces leave room that a fourth could use
        a = int(rng.integers(780, 1024))
        b = int(rng.integers(512, (2048 - a) // 2 + 1))
        for x in (a, b, 2048 - a - b):
            counts[x] += 1
    assert sum(t for _, t in best_fit(counts)) > 330
    plan = complete(counts)
    assert 300 <= sum(t for _, t in plan) <= 303
    used = np.zeros_like(counts)
    for filling, times in plan:
        assert sum(x * n for x, n in filling) <= 2048
        for x, n in filling:
            used[x] += n * times
    assert (used == counts).all()


def test_pack_as_told(corpus, frame):
    got = pack(frame(corpus), PATH, capacity=64, end_id=0).collect()
    by = Counter((r.doc_id, r.piece) for r in got)
    sequences = {}
    for r in got:
        sequences.setdefault(r.sequence_id, []).append(r)
    for rows in sequences.values():
        at = 0
        for r in sorted(rows, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= 64
    for i, t in corpus:
        ids = np.array(library_ids(t) + [0], "<u4")
        mine = [r for r in got if r.doc_id == i]
        crcs = Counter((r.piece, r.start, r.length, r.ids_crc32) for r in mine)
        for piece, start in enumerate(range(0, len(ids), 64)):
            own = ids[start : start + 64]
            assert crcs[piece, start, len(own), zlib.crc32(own.tobytes())] >= 1
    assert by[5, 0] == 2
    counts = np.bincount([r.length for r in got], minlength=65)
    assert len(sequences) <= lower_bound(counts) + 1
    assert pack(frame(corpus).limit(0), PATH).count() == 0


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(st.sampled_from("aSÀéßÿİſKJ\u030c\u0327\u0338'.,<|>=09 \n\u00a0\u2028ΣΐЖ中\u1100\u1161ªµ×÷"), max_size=30), max_size=4))
def test_taking_words_apart_gives_the_librarys_ids(texts):
    texts = [*texts, "it's DON'T dogs' Ça, “Été”… the<|endoftext|>. Naïve!? <|endoftext|>.,", "ÀÖØÞ àöøþÿ. " + " ".join(texts)]
    words = WordTokenizer(PATH)
    assert words.splits
    assert [x.tolist() for x in words.encode(texts)] == [library_ids(t) for t in texts]


def test_letters_are_encoded_once_for_all_cases_and_ends(prose):
    letters = sorted({w for w in prose.known if len(w) > 2})[:150]
    texts = [f"{form}{end}" for w in letters for form in (w, w.upper(), w.capitalize()) for end in ("", ",", ".", "!?")]
    words = WordTokenizer(PATH)
    assert [x.tolist() for x in words.encode([" ".join(texts)])] == [library_ids(" ".join(texts))]
    assert len(words.numbers) <= len(letters) + 4


def test_other_tokenizers_are_not_taken_apart(tmp_path):
    import json

    config = json.load(open(PATH))
    assert split_known(config)
    assert not split_known(config | {"normalizer": None}) and not split_known(config | {"pre_tokenizer": None})
    assert not split_known(config | {"added_tokens": [{"id": 5, "content": "abc"}]})
    config["normalizer"]["normalizers"].pop()  # upper case stays
    path = tmp_path / "cased.json"
    path.write_text(json.dumps(config))
    words, text = WordTokenizer(str(path)), "Abc, ABC it's abc. É"
    assert [x.tolist() for x in words.encode([text])] == [words.library.encode(text, add_special_tokens=False).ids]


def test_coder_beats_zlib_on_the_documents():
    import pyarrow.parquet as pq

    texts = pq.read_table("/root/testdata/sf0.01/documents.parquet", columns=["text"])["text"].to_pylist()
    ids = np.concatenate(list(tokenizer(PATH).encode([t or "" for t in texts])))[:300_000]
    found = frequencies(ids)
    assert found.sum() == 1 << 20 and (found[ids] > 0).all()
    table = packed_frequencies(found)
    assert (unpacked_frequencies(table) == found).all()
    blocks = encode(ids, 2048, found)
    assert (decode(blocks, len(ids), 2048, found) == ids).all()
    assert (decode(blocks[3:5], 4096, 2048, found) == ids[3 * 2048 : 5 * 2048]).all()
    plain = [len(zlib.compress(ids[a : a + 2048].tobytes())) for a in range(0, len(ids), 2048)]
    shares = np.bincount(ids) / len(ids)
    entropy = -(shares[shares > 0] * np.log2(shares[shares > 0])).sum() * len(ids) / 8
    assert sum(map(len, blocks)) < entropy  # of the ids one by one, what they are told from not counted
    assert sum(map(len, blocks)) + len(table) < 0.9 * sum(plain)


@settings(max_examples=40, deadline=None)
@given(st.lists(st.integers(0, 65535) | st.integers(0, 3), max_size=700), st.sampled_from([3, 200, 2048]))
def test_coder_round_trip_with_frequencies(ids, size):
    x = np.array(ids, np.uint16)
    found = frequencies(x)
    assert decode(encode(x, size, found), len(x), size, found).tolist() == ids


@given(st.integers(1, 5000), st.sampled_from([1, 2, 7, 33, 300, 2048]))
def test_runs_of_steps_take_each_id_once(total, size):
    runs = list(stretches(total, size))
    assert sum((behind - first) * blocks for first, behind, blocks in runs) == total
    starts = {first for first, _, _ in runs}
    assert all(0 < behind - first <= RUN for first, behind, _ in runs) and {x for x in renewals(size) if x < min(size, total)} <= starts


def test_encoder_works_out_the_chances_of_many_steps_together(monkeypatch):
    calls = []
    foretold = Model.foretold
    monkeypatch.setattr(Model, "foretold", lambda self, two, one: calls.append(two.shape) or foretold(self, two, one))
    x = np.tile(np.arange(700, dtype=np.uint16) * 5, 9)
    blocks = encode(x, 2048)
    assert len(calls) < 2048 // RUN + 10 and sum(a * b for a, b in calls) == len(x)
    assert (decode(blocks, len(x), 2048) == x).all()


@pytest.mark.parametrize("seed", [0, 1, 2])
def test_coder_keeps_rare_ids_between_long_runs(seed):
    rng = np.random.default_rng(seed)  # chances near one, and ids of the least frequency where another was foretold
    x = np.repeat(rng.integers(0, 3, 400), rng.integers(1, 200, 400)).astype(np.uint16)
    rare = rng.choice(len(x), 300, replace=False)
    x[rare] = rng.permutation(65_536)[:300]
    found = frequencies(x)
    assert found[x].min() < 40
    blocks = encode(x, 2048, found)
    assert (decode(blocks, len(x), 2048, found) == x).all()
    assert sum(map(len, blocks)) < len(x) / 4


def test_words_are_merged_once_over_chunks_and_kept_as_arrow(monkeypatch):
    monkeypatch.setattr("turnstone.llm.tokens.CHUNK_WORDS", 40)
    words = WordTokenizer(PATH)
    merged = []
    merge = WordTokenizer._merged
    monkeypatch.setattr(WordTokenizer, "_merged", lambda self, new: merged.extend(new.to_pylist()) or merge(self, new))
    texts = [" ".join(f"Wört{chr(97 + i % 26)}{chr(97 + j)}{e}" for i in range(k, k + 9)) for k in range(30) for j, e in enumerate([",", ".", ""])]
    texts += ["", ",. 42 中 it's"]
    assert [x.tolist() for x in words.encode(texts)] == [library_ids(t) for t in texts]
    assert len(merged) == len(set(merged)) > 70
    assert words.numbers.nbytes < 40 * len(words.numbers)
