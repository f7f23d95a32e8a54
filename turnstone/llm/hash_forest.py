"""Approximate nearest neighbours by cosine, in a forest of sorted hash strings.

A tree has a hash string for each vector: 32 bits, the signs of random projections, so two vectors share a bit with
probability 1 - angle / pi. A tree is its strings in sorted order. A query descends in every tree at once to the vectors
with the longest common prefix (in a sorted array, a range found by bisection) and then ascends in step over all trees, one
bit at a time; each step adds the sibling ranges. What it meets is compared exactly, once. It stops when a vector as near
as its worst hit so far would have been met in one of the trees with probability ``recall``; so it goes far where
neighbours are far and stops at once among copies. Nothing caps the candidates, and where no prefix is short enough to give
that probability, the ascent ends at the empty prefix, which all vectors share.

Rows are dealt over shards by a hash of their id, each at most about ``shard_rows``, with a forest of its own; more shards than that
are made if the cluster has room for more tasks, of ``least_rows`` or more. Queries come to the shards in
blocks of at most about ``block_rows``; a shard that serves several blocks is sent once for each. A task so holds one shard and one
block, and returns the best of each query there; the best of all shards are a query's hits. In a shard equal vectors
are one, with the smallest ids it can need, so a group of copies is compared once.

Vectors that are null, empty, zero, or hold a null or non-finite component take no part, as query or as hit. Only vectors of
one length are compared. Queries with equal ids are one query, with the least of their vectors. A query is not its own hit; other
rows with its id are not either. A null id takes no part. Equal rows are separate hits; ties go to the smaller id. Other columns are
not read. Nothing to search, or no query, gives no rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from turnstone.llm.common import ready
from turnstone.llm.vector_codes import finite

BITS = 32
TREES = 128
AT_ONCE = 256  # queries that ascend together
PAIRS = 1 << 17  # vectors compared at a time
SCHEMA = "query_id long, vec_id long, score double"


def scaled(vectors: np.ndarray) -> np.ndarray:
    """Rows times a power of two that keeps their squares in range; it cancels out of a cosine without a trace."""
    _, power = np.frexp(np.abs(vectors).max(axis=1))
    return np.ldexp(vectors, -power[:, None])


def lengths_of(vectors: np.ndarray) -> np.ndarray:
    return np.sqrt(np.einsum("ij,ij->i", vectors, vectors))


class Forest:
    """Sorted hash strings over distinct vectors."""

    def __init__(self, vectors: np.ndarray, trees: int = TREES, seed: int = 5):
        rng = np.random.default_rng(seed)
        self.vectors, self.lengths = vectors, lengths_of(vectors)
        self.planes = [rng.standard_normal((vectors.shape[1], BITS)).astype(np.float32) for _ in range(trees)]
        self.order = np.empty((trees, len(vectors)), np.int32)
        self.sorted = np.empty((trees, len(vectors)), np.uint32)
        single = self._single(vectors)
        for t in range(trees):
            strings = self._strings(single, t)
            self.order[t] = np.argsort(strings, kind="stable")
            self.sorted[t] = strings[self.order[t]]

    @staticmethod
    def _single(vectors: np.ndarray) -> np.ndarray:
        return (vectors / lengths_of(vectors)[:, None]).astype(np.float32)

    def _strings(self, single: np.ndarray, tree: int) -> np.ndarray:
        return np.packbits(single @ self.planes[tree] > 0, axis=1).view(">u4").ravel().astype(np.uint32)

    def search(self, queries: np.ndarray, ids: np.ndarray, only: np.ndarray, k: int, recall: float) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """For each query: its number, and the numbers and cosines of the vectors met that are no worse than the ``k``-th best.

        ``only`` has, for each vector indexed, the one id that all its rows have, or the least number if they have several. A vector with the
        query's own id (``ids``) alone does not count as one of the ``k``.
        """
        for at in range(0, len(queries), AT_ONCE):
            yield from self._together(queries[at : at + AT_ONCE], ids[at : at + AT_ONCE], only, at, k, recall)

    def _descend(self, strings: np.ndarray) -> int:
        """Bits of the longest prefix that a query has in common with a vector of some tree."""
        longest = 0
        for own, tree in zip(strings, self.sorted):
            at = np.searchsorted(tree, own)
            for near in (np.maximum(at - 1, 0), np.minimum(at, len(tree) - 1)):
                differs = int((own ^ tree[near]).min())
                longest = max(longest, BITS - differs.bit_length())
        return longest

    def _together(self, queries, ids, only, first, k, recall):
        n, size, trees = len(queries), len(self.vectors), len(self.planes)
        lengths, single = lengths_of(queries), self._single(queries)
        strings = np.stack([self._strings(single, t) for t in range(trees)])
        met = np.zeros((n, size), bool)
        top = np.full((n, k), -2.0)  # the best cosines, but for a query's own vector
        found = []  # number of query, number of vector, cosine
        low = np.full((trees, n), -1)
        high = np.full((trees, n), -1)
        asking = np.arange(n)
        for bits in range(self._descend(strings), -1, -1):
            fresh = np.zeros((len(asking), size), bool)
            last = np.uint32((1 << (BITS - bits)) - 1)  # the bits after the prefix
            for t in range(trees):
                begin = strings[t, asking] & ~last
                from_, to = np.searchsorted(self.sorted[t], begin), np.searchsorted(self.sorted[t], begin | last, side="right")
                old_low, old_high = low[t, asking], high[t, asking]
                new = old_low < 0
                old_low, old_high = np.where(new, from_, old_low), np.where(new, from_, old_high)
                for start, stop in ((from_, old_low), (old_high, to)):
                    many = stop - start
                    total = int(many.sum())
                    if total:
                        of = np.repeat(np.arange(len(asking)), many)
                        fresh[of, self.order[t][np.arange(total) + np.repeat(start - (np.cumsum(many) - many), many)]] = True
                low[t, asking], high[t, asking] = from_, to
            fresh &= ~met[asking]
            met[asking] |= fresh
            row, which = np.nonzero(fresh)
            cosine = self._cosines(queries, lengths, asking[row], which)
            found.append((asking[row], which, cosine))
            self._keep_best(top, asking[row], np.where(only[which] == ids[asking[row]], -2.0, cosine), k)
            worst = top[asking, k - 1]
            agree = 1 - np.arccos(np.clip(worst, -1, 1)) / math.pi
            asking = asking[(worst < -1.5) | ((1 - agree**bits) ** trees > 1 - recall)]
            if not len(asking):
                break
        row, which, cosine = (np.concatenate(f) for f in zip(*found))
        good = cosine >= top[row, k - 1]
        row, which, cosine = row[good], which[good], cosine[good]
        order = np.argsort(row, kind="stable")
        cuts = np.searchsorted(row[order], np.arange(1, n))
        for q, (w, c) in enumerate(zip(np.split(which[order], cuts), np.split(cosine[order], cuts))):
            yield first + q, w, c

    @staticmethod
    def _keep_best(top: np.ndarray, row: np.ndarray, cosine: np.ndarray, k: int) -> None:
        """Put new cosines, in the order of their rows, among the best of each row."""
        better = cosine > top[row, k - 1]
        row, cosine = row[better], cosine[better]
        order = np.lexsort((-cosine, row))
        row, cosine = row[order], cosine[order]
        rows, begin = np.unique(row, return_index=True)
        place = np.arange(len(row)) - np.repeat(begin, np.diff(np.append(begin, len(row))))
        new = np.full((len(rows), k), -2.0)
        few = place < k
        new[np.searchsorted(rows, row[few]), place[few]] = cosine[few]
        top[rows] = -np.sort(-np.concatenate([top[rows], new], axis=1), axis=1)[:, :k]

    def _cosines(self, queries: np.ndarray, lengths: np.ndarray, row: np.ndarray, which: np.ndarray) -> np.ndarray:
        out = np.empty(len(row))
        for at in range(0, len(row), PAIRS):
            r, w = row[at : at + PAIRS], which[at : at + PAIRS]
            dots = np.einsum("ij,ij->i", queries[r], self.vectors[w])
            out[at : at + PAIRS] = dots / (lengths[r] * self.lengths[w])
        return out


def hits_in_shard(ids: np.ndarray, vectors: np.ndarray, query_ids: np.ndarray, queries: np.ndarray, k: int, recall: float) -> pd.DataFrame:
    """The ``k`` best hits of each query among the vectors of one shard."""
    vectors, queries = scaled(vectors), scaled(queries)
    order = np.argsort(ids, kind="stable")
    ids, vectors = ids[order], vectors[order]
    names = np.ascontiguousarray(vectors + 0.0).view(np.dtype((np.void, vectors.shape[1] * 8))).ravel()
    _, first, copy_of = np.unique(names, return_index=True, return_inverse=True)
    members = np.argsort(copy_of, kind="stable")  # smallest ids first in each group of copies
    ends = np.cumsum(np.bincount(copy_of))
    begins = ends - np.bincount(copy_of)
    least, most = ids[members[begins]], ids[members[ends - 1]]
    only = np.where(least == most, least, np.iinfo(np.int64).min)
    forest = Forest(vectors[first])
    rows = []
    for q, which, cosine in forest.search(queries, query_ids, only, k, recall):
        found = []  # of a group of copies its k smallest ids are enough, the query's own left out
        for g, c in zip(which.tolist(), cosine.tolist()):
            copies = ids[members[begins[g] : ends[g]]]
            a, b = np.searchsorted(copies, query_ids[q]), np.searchsorted(copies, query_ids[q], side="right")
            found += [(-c, i) for i in (*copies[: min(a, k)].tolist(), *copies[b : b + k].tolist())]
        rows += [(int(query_ids[q]), i, -c) for c, i in sorted(found)[:k]]
    return pd.DataFrame(rows, columns=["query_id", "vec_id", "score"]).astype({"query_id": "int64", "vec_id": "int64", "score": "float64"})


def nearest_vectors(
    vectors: DataFrame, queries: DataFrame, k: int = 5, recall: float = 0.9, shard_rows: int = 65_536, block_rows: int = 16_384,
    least_rows: int = 4_096,
) -> DataFrame:
    """``query_id``, ``rank``, ``vec_id`` and ``score``, the cosine, of the ``k`` nearest vectors found for each query.
    Both frames: ``vec_id``, ``embedding``. ``recall``: the probability to meet a vector as near as the worst hit."""
    spark = vectors.sparkSession
    ready(spark)

    def usable(frame: DataFrame) -> DataFrame:
        rows = frame.select(F.col("vec_id").cast("long").alias("id"), F.col("embedding").cast("array<double>").alias("v"))
        return rows.filter(F.col("id").isNotNull() & finite(F.col("v")) & F.exists("v", lambda x: x != 0))

    index, asked = usable(vectors), usable(queries).groupBy("id").agg(F.min("v").alias("v"))
    n, n_asked = index.count(), asked.count()
    room = int(spark.conf.get("spark.sql.shuffle.partitions"))
    shards = max(-(-n // shard_rows), min(room, -(-n // least_rows)), 1)
    blocks = max(-(-n_asked // block_rows), 1)
    shard, block = F.pmod(F.xxhash64("id"), F.lit(shards)), F.pmod(F.xxhash64("id", F.lit(1)), F.lit(blocks))
    # at most (shards + blocks) copies of a row travel, and a task holds one shard and one block, whatever their ids or copies
    left = index.select("id", "v", shard.alias("shard"), F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"))
    right = asked.select("id", "v", F.explode(F.sequence(F.lit(0), F.lit(shards - 1))).alias("shard"), block.alias("block"))
    spread = lambda frame: frame.withColumn("shard", F.col("shard").cast("int")).withColumn("block", F.col("block").cast("int"))

    def search(rows: pa.Table, asks: pa.Table) -> pa.Table:
        found = []
        if rows.num_rows and asks.num_rows:
            sizes = [np.asarray(t["v"].combine_chunks().value_lengths()) for t in (rows, asks)]
            for size in np.unique(sizes[1]):
                mine = [t.filter(pa.array(s == size)) for t, s in zip((rows, asks), sizes)]
                if mine[0].num_rows:
                    columns = [
                        (np.asarray(t["id"]), np.asarray(t["v"].combine_chunks().flatten(), np.float64).reshape(t.num_rows, -1)) for t in mine
                    ]
                    found.append(hits_in_shard(*columns[0], *columns[1], k, recall))
        frame = pd.concat(found) if found else pd.DataFrame({"query_id": [], "vec_id": [], "score": []})
        types = pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.float64())])
        return pa.Table.from_pandas(frame, types, preserve_index=False)

    hits = spread(left).groupBy("shard", "block").cogroup(spread(right).groupBy("shard", "block")).applyInArrow(search, SCHEMA)
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    # at most k rows for each query and shard; the limit is applied before the shuffle too
    return hits.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
