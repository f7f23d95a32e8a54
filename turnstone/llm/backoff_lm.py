"""LM scoring by a weighted backoff automaton over smoothed word n-grams.

Tokens are words between ASCII white space, A-Z in lower case, then one end. A model of order m has a state for each seen
run of up to m - 1 words and the empty one. A state has an arc for each word seen after it, weighted with its smoothed log10
probability, and a failure arc to the state of the run without its first word, weighted with log10 of the share kept for
words not seen there. Reading a token follows its arc; where there is none, failure arcs are taken until there is, and
their weights add up. The empty state has an arc for every token: (c + 1) / (N + V + 1).

Smoothing is Dirichlet's at each order, P(w | h) = (c(hw) + k P(w | h')) / (c(h) + k), which sums to one over all tokens,
unknown ones being one class. ``strength`` gives k for each order above one.

The corpus is cut into parts of about ``part_chars`` characters by a hash of the row. Each part counts its n-grams
as sorted 64-bit hashes; for each range of hashes one task adds up all parts' counts and returns to each part the totals of its
own n-grams, in their order, with N and V of the range. A frequent n-gram is one number in each part. The part then reads its
texts through its piece of the automaton. Nothing of the model passes the driver, and no task holds more than a part or a
range. Every n-gram counts, there is no cutoff. Hashes are sent as differences inside their range, texts and counts compressed.

A null text is empty and scores its end alone. Null and repeated ids are kept, a row each. Rows with a null training
mark are scored but not learned. Without training rows every token is unknown. An empty table gives an empty result.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from turnstone.llm.common import ready, utf8

SEED = 7
HASHED_BYTES = 4_000_000  # of texts whose words are taken apart at once
END = xxhash.xxh64_intdigest(b"\n end", SEED)  # no word holds white space
MIX = np.uint64(0x9E3779B97F4A7C15)


def token_hashes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all tokens of all texts, and where each text ends. Each distinct word is hashed once."""
    # white space and A-Z are single bytes in UTF-8, so the words are those of `words_of`
    split = pc.ascii_split_whitespace(pc.ascii_lower(texts))
    words = split.flatten().dictionary_encode()
    kinds = words.dictionary.cast(pa.large_binary()).to_numpy(zero_copy_only=False)
    own = np.fromiter((xxhash.xxh64_intdigest(w, SEED) for w in kinds), np.uint64, len(kinds))[words.indices.to_numpy()]
    cuts = split.offsets.to_numpy().astype(np.int64) - split.offsets[0].as_py()
    # white space at either end of a text leaves an empty word there, which is none
    empty = (kinds == b"")[words.indices.to_numpy()]
    if empty.any():
        cuts = np.concatenate([[0], np.cumsum(~empty)])[cuts]
        own = own[~empty]
    ends = cuts[1:] + np.arange(1, len(cuts))
    hashes = np.full(len(own) + len(texts), END, np.uint64)
    real = np.ones(len(hashes), bool)
    real[ends - 1] = False
    hashes[real] = own
    return hashes, ends


def gram_hashes(tokens: np.ndarray, ends: np.ndarray, order: int) -> list[np.ndarray]:
    """For each n up to the order: the hash of the n tokens that end at each place; 0 where the text is too short."""
    place = np.arange(len(tokens)) - np.repeat(np.concatenate([[0], ends[:-1]]), np.diff(np.concatenate([[0], ends]))) if len(ends) else np.empty(0, np.int64)
    grams = [tokens]
    for n in range(2, order + 1):
        before = np.concatenate([np.zeros(1, np.uint64), grams[-1][:-1]])  # n - 1 tokens, up to the last place
        mixed = (before ^ (before >> np.uint64(29))) * MIX + np.uint64(n)
        mixed = (mixed ^ (mixed >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93) + tokens
        grams.append(np.where(place >= n - 1, mixed ^ (mixed >> np.uint64(31)), np.uint64(0)))
    return grams


def pack_sorted(keys: np.ndarray, base: int) -> bytes:
    """Sorted keys from ``base`` up, as their differences in the fewest whole bytes that hold the largest.

    The top bytes are mostly small and are compressed; the others are as good as random.
    """
    gaps = np.diff(keys, prepend=np.uint64(base))
    width = max(1, -(-int(gaps.max()).bit_length() // 8)) if len(gaps) else 1
    flat = gaps.astype("<u8").view(np.uint8).reshape(-1, 8)
    return bytes([width]) + flat[:, : width - 1].tobytes() + zlib.compress(flat[:, width - 1].tobytes(), 1)


def unpack_sorted(data: bytes, base: int, size: int) -> np.ndarray:
    width, low = data[0], size * (data[0] - 1)
    wide = np.zeros((size, 8), np.uint8)
    wide[:, : width - 1] = np.frombuffer(data, np.uint8, low, 1).reshape(size, width - 1)
    wide[:, width - 1] = np.frombuffer(zlib.decompress(memoryview(data)[1 + low :]), np.uint8)
    return np.uint64(base) + np.cumsum(wide.view("<u8").ravel(), dtype=np.uint64)


def pack_counts(counts: np.ndarray) -> bytes:
    width = next(w for w in (1, 2, 4, 8) if not len(counts) or int(counts.max()) < 1 << 8 * w)
    return bytes([width]) + zlib.compress(counts.astype(f"<u{width}").tobytes(), 1)


def unpack_counts(data: bytes) -> np.ndarray:
    return np.frombuffer(zlib.decompress(memoryview(data)[1:]), f"<u{data[0]}").astype(np.int64)


def shrunk(rows: DataFrame) -> DataFrame:
    """The rows with their texts compressed, each by itself, and ``size``, their bytes before."""

    def shrink(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = pa.Codec("zstd", compression_level=1)
        for batch in batches:
            texts = utf8(batch["text"])
            yield pa.RecordBatch.from_arrays(
                [batch["doc_id"], pa.array([codec.compress(t, asbytes=True) for t in texts], pa.binary()),
                 pa.array(list(map(len, texts)), pa.int64()), batch["learn"], batch["part"]],
                ["doc_id", "text", "size", "learn", "part"],
            )

    return rows.mapInArrow(shrink, "doc_id long, text binary, size long, learn boolean, part int")


def runs_of(sizes: list[int], most: int) -> list[tuple[int, int]]:
    """Rows cut into runs of about ``most`` bytes; no row is cut."""
    which = np.cumsum(sizes, dtype=np.int64) // most
    cuts = [0, *(np.flatnonzero(np.diff(which)) + 1).tolist(), len(sizes)]
    return [(a, b) for a, b in zip(cuts, cuts[1:]) if b > a]


def rows_of(table_: pa.Table, order: int) -> tuple[list, np.ndarray, np.ndarray, np.ndarray, list[np.ndarray]]:
    """Ids, training marks, text ends, and for each n the hashes of all places."""
    codec = pa.Codec("zstd")
    texts = [codec.decompress(t, n, asbytes=True) for t, n in zip(table_["text"].to_pylist(), table_["size"].to_pylist())]
    found = [token_hashes(pa.array(texts[a:b], pa.large_string())) for a, b in runs_of(list(map(len, texts)), HASHED_BYTES)]
    tokens = np.concatenate([x for x, _ in found]) if found else np.empty(0, np.uint64)
    sizes = np.concatenate([np.diff(e, prepend=0) for _, e in found]) if found else np.empty(0, np.int64)
    ends = np.cumsum(sizes)
    trained = np.array([bool(x) for x in table_["learn"].to_pylist()], bool)
    return table_["doc_id"].to_pylist(), trained, ends, sizes, gram_hashes(tokens, ends, order)


def border(i: int, ranges: int) -> int:
    """The least hash of one of the equal ranges of hashes."""
    return (i << 64) // ranges


def ranges_of(keys: np.ndarray, ranges: int) -> np.ndarray:
    """Where each of the equal ranges of hashes begins among sorted keys, and the end."""
    borders = [border(i, ranges) for i in range(1, ranges)]
    return np.concatenate([[0], np.searchsorted(keys, np.array(borders, np.uint64)), [len(keys)]])


def score_texts(docs: DataFrame, learn: Column, order: int = 3, strength: tuple[float, ...] = (150.0, 40.0), part_chars: int = 16_000_000) -> DataFrame:
    """``doc_id``, ``n_tokens``, ``n_known``, ``train_tokens``, ``base_score``, ``score`` of every row of ``docs``.

    ``learn`` says which rows the model learns from. ``base_score`` is the score of the empty state alone.
    """
    ready(docs.sparkSession)
    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"),
        F.coalesce(learn, F.lit(False)).alias("learn"),
    )
    chars = docs.agg(F.sum(F.length("text").cast("long"))).first()[0] or 0
    parts = max(1, -(-chars // part_chars))
    rows = shrunk(rows.withColumn("part", F.pmod(F.xxhash64("doc_id", "text"), F.lit(parts)).cast("int")))

    def count(key: tuple, group: pa.Table) -> pa.Table:
        part, out = key[0].as_py(), []
        _, trained, _, sizes, grams = rows_of(group, order)
        weights = np.repeat(trained, sizes)
        for n, places in enumerate(grams, 1):
            real = places[places != 0] if n > 1 else places
            keys, which = np.unique(real, return_inverse=True)
            learned = np.bincount(which, weights=weights[places != 0] if n > 1 else weights, minlength=len(keys)).astype(np.int64)
            cuts = ranges_of(keys, parts)
            out.append(pa.table({
                "part": pa.array(np.full(parts, part, np.int32)), "n": pa.array(np.full(parts, n, np.int32)), "range": pa.array(np.arange(parts, dtype=np.int32)),
                "keys": pa.array([pack_sorted(keys[a:b], border(i, parts)) for i, (a, b) in enumerate(zip(cuts, cuts[1:]))], pa.binary()),
                "counts": pa.array([pack_counts(learned[a:b]) for a, b in zip(cuts, cuts[1:])], pa.binary()),
            }))
        return pa.concat_tables(out)

    counted = rows.groupBy("part").applyInArrow(count, "part int, n int, range int, keys binary, counts binary")

    def add(key: tuple, group: pa.Table) -> pa.Table:
        counts = [unpack_counts(x) for x in group["counts"].to_pylist()]
        base = border(key[1].as_py(), parts)
        keys = [unpack_sorted(x, base, len(c)) for x, c in zip(group["keys"].to_pylist(), counts)]
        kinds, which = np.unique(np.concatenate(keys), return_inverse=True)
        totals = np.bincount(which, weights=np.concatenate(counts), minlength=len(kinds)).astype(np.int64)
        cuts = np.cumsum([0, *map(len, keys)])
        found = [pack_counts(totals[which[a:b]]) for a, b in zip(cuts, cuts[1:])]
        size = len(found)
        return pa.table({
            "part": group["part"], "n": pa.array([key[0].as_py()] * size, pa.int32()), "range": pa.array([key[1].as_py()] * size, pa.int32()),
            "totals": pa.array(found, pa.binary()), "tokens": pa.array([int(totals.sum())] * size, pa.int64()),
            "types": pa.array([int((totals > 0).sum())] * size, pa.int64()),
        })

    totals = counted.groupBy("n", "range").applyInArrow(add, "part int, n int, range int, totals binary, tokens long, types long")

    def score(key: tuple, texts: pa.Table, model: pa.Table) -> pa.Table:
        doc_ids, _, ends, _, grams = rows_of(texts, order)
        own: dict[int, list] = {}
        tokens = types = 0
        for n, at, packed, some, kinds in zip(*(model[c].to_pylist() for c in ("n", "range", "totals", "tokens", "types"))):
            own.setdefault(n, []).append((at, packed))
            if n == 1:
                tokens, types = tokens + some, types + kinds
        counts = []
        for n, places in enumerate(grams, 1):
            real = places != 0 if n > 1 else np.ones(len(places), bool)
            found = np.zeros(len(places), np.int64)
            if n in own:
                # without the inverse, numpy builds a table of hashes, which takes four times as long as the sort
                which = np.unique(places[real], return_inverse=True)[1]
                found[real] = np.concatenate([unpack_counts(p) for _, p in sorted(own[n])])[which]
            counts.append(found)
        base, weight = traverse(counts, ends, tokens, types, strength)
        whole = lambda x: np.add.reduceat(x, np.concatenate([[0], ends[:-1]])) if len(ends) else x
        n = len(doc_ids)
        return pa.table({
            "doc_id": pa.array(doc_ids, pa.int64()), "n_tokens": pa.array(np.diff(np.concatenate([[0], ends])), pa.int64()),
            "n_known": pa.array(whole((counts[0] > 0).astype(np.int64)), pa.int64()), "train_tokens": pa.array([tokens] * n, pa.int64()),
            "base_score": pa.array(whole(base), pa.float64()), "score": pa.array(whole(weight), pa.float64()),
        })

    return rows.groupBy("part").cogroup(totals.groupBy("part")).applyInArrow(
        score, "doc_id long, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    )


def traverse(counts: list[np.ndarray], ends: np.ndarray, tokens: int, types: int, strength: tuple[float, ...]) -> tuple[np.ndarray, np.ndarray]:
    """The empty state's weight and the automaton's weight of each token.

    ``counts[n - 1]`` holds for each place how often its last n tokens were seen. The state before a place is the longest
    run of up to order - 1 tokens before it that was seen; it is carried along by the counts of the places before.
    """
    base = np.log10((counts[0] + 1) / (tokens + types + 1.0))
    starts = np.concatenate([[0], ends[:-1]])
    # arc[n]: weight of reading the token in the state of n - 1 tokens before it, over failure arcs where it has none
    arc = base.copy()
    for n in range(2, len(counts) + 1):
        k = strength[n - 2]
        before = np.concatenate([[0], counts[n - 2][:-1]])  # how often that state was seen
        before[starts] = 0
        seen = counts[n - 1]
        failure = np.log10(k / (before + k))
        with np.errstate(divide="ignore"):
            own = np.log10((seen + k * 10.0**arc) / (before + k))
        arc = np.where(before == 0, arc, np.where(seen > 0, own, failure + arc))
    return base, arc
