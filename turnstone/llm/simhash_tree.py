"""SimHash near-duplicates by vantage-point trees.

Fingerprints are 64 majority bits over the hashes of word shingles; two link at ``radius`` or fewer differing bits.
Equal fingerprints meet first, so a group of exact copies is one point. A tree of vantage points, fitted on a bounded
sample, deals the points to shards by Hamming distance: inside a node's ball or outside. By the triangle inequality a
partner of a point lies within ``radius`` of its distance, so a point near a boundary is sent along as a query to each
shard beyond that it could reach, and to no other. In its shard a tree goes on splitting; leaves compare exactly. A
shard returns at most one link for each of its points (a spanning forest), never a group's pairs; components join them.

The sample only shapes the shards; every fingerprint is placed and every pair within the radius is found. The share of
points near a boundary is about a third at each level for random fingerprints, so copies of points grow with the tree's
depth, by about the number of points to the power 0.4.

A null text is empty: fingerprint zero, which links like any other. Null ids are kept; a component's id is its
smallest id and null if it has none. Repeated rows come out as often as they went in. An empty table gives an empty one.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from turnstone.llm.common import texts_of, utf8, written
from turnstone.llm.components import components
from turnstone.llm.shingles import fingerprints_of

LEAF = 768


def distance(points: np.ndarray, vantage: np.uint64) -> np.ndarray:
    return np.bitwise_count(points ^ vantage).astype(np.int16)


def split_of(points: np.ndarray) -> tuple[np.uint64, int] | None:
    """A vantage point and the radius of its ball that halves the points; none if nothing divides them."""
    best = None
    for vantage in points[np.linspace(0, len(points) - 1, 5).astype(int)]:
        d = distance(points, vantage)
        mu = int(np.median(d))
        if (d <= mu).all():
            mu -= 1
        if not (d <= mu).any():
            continue
        near = int(((d > mu - 3) & (d <= mu + 3)).sum())
        if best is None or near < best[0]:
            best = near, vantage, mu
    return best and best[1:]


def build(sample: np.ndarray, shards: int) -> list:
    """A tree as nested lists [vantage, mu, inside, outside]; a leaf is its shard's number."""
    numbers = iter(range(1 << 30))

    def node(points: np.ndarray, share: int) -> list | int:
        cut = split_of(points) if share > 1 and len(points) > 1 else None
        if cut is None:
            return next(numbers)
        inside = distance(points, cut[0]) <= cut[1]
        return [int(cut[0]), cut[1], node(points[inside], share // 2), node(points[~inside], share - share // 2)]

    return node(sample, shards)


def route(tree: list | int, points: np.ndarray, radius: int) -> Iterator[tuple[int, np.ndarray, bool]]:
    """For each shard it touches: its number, places of points, and whether they live there (else they ask there)."""
    stack = [(tree, np.arange(len(points)), np.empty(0, np.int64))]
    while stack:
        node, home, asking = stack.pop()
        if not len(home) and not len(asking):
            continue
        if isinstance(node, int):
            if len(home):
                yield node, home, True
            if len(asking):
                yield node, asking, False
            continue
        vantage, mu, inner, outer = node
        d, q = distance(points[home], np.uint64(vantage)), distance(points[asking], np.uint64(vantage))
        stack.append((inner, home[d <= mu], asking[q <= mu + radius]))
        stack.append((outer, home[d > mu], np.concatenate([asking[q > mu - radius], home[(d <= mu) & (d > mu - radius)]])))


class Forest:
    """Sets of linked points, joined many links at a time."""

    def __init__(self, size: int):
        self.parent = np.arange(size)

    def add(self, a: np.ndarray, b: np.ndarray) -> None:
        while len(a):
            a, b = self.parent[a], self.parent[b]
            differ = a != b
            a, b = a[differ], b[differ]
            np.minimum.at(self.parent, np.maximum(a, b), np.minimum(a, b))
            while True:
                above = self.parent[self.parent]
                if (above == self.parent).all():
                    break
                self.parent = above


def compare(points: np.ndarray, a: np.ndarray, b: np.ndarray, radius: int, found: Forest) -> None:
    """Exact pairs between two lists of places, in blocks."""
    for at in range(0, len(a), LEAF):
        for to in range(0, len(b), LEAF):
            x, y = a[at : at + LEAF], b[to : to + LEAF]
            i, j = np.nonzero(np.bitwise_count(points[x][:, None] ^ points[y][None, :]) <= radius)
            found.add(x[i], y[j])


def link_within(points: np.ndarray, own: np.ndarray, radius: int, found: Forest) -> None:
    """All links among the points at the places ``own``."""
    stack = [own]
    while stack:
        own = stack.pop()
        cut = split_of(points[own]) if len(own) > LEAF else None
        if cut is None:
            compare(points, own, own, radius, found)
            continue
        vantage, mu = cut
        d = distance(points[own], vantage)
        stack += [own[d <= mu], own[d > mu]]
        link_between(points, own[(d <= mu) & (d > mu - radius)], own[(d > mu) & (d <= mu + radius)], radius, found)


def link_between(points: np.ndarray, a: np.ndarray, b: np.ndarray, radius: int, found: Forest) -> None:
    stack = [(a, b)]
    while stack:
        a, b = stack.pop()
        if not len(a) or not len(b):
            continue
        cut = split_of(points[b]) if min(len(a), len(b)) > LEAF else None
        if cut is None:
            compare(points, a, b, radius, found)
            continue
        vantage, mu = cut
        d, e = distance(points[a], vantage), distance(points[b], vantage)
        stack += [
            (a[d <= mu], b[e <= mu]), (a[d > mu], b[e > mu]),
            (a[(d <= mu) & (d > mu - radius)], b[(e > mu) & (e <= mu + radius)]),
            (a[(d > mu) & (d <= mu + radius)], b[(e <= mu) & (e > mu - radius)]),
        ]


def fingerprints(docs: DataFrame, words: int = 3) -> DataFrame:
    """``doc_id`` and ``fp``, the fingerprint's 64 bits as a long, of every row."""

    def prints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fp = fingerprints_of(utf8(batch["text"]), words)
            yield pa.RecordBatch.from_arrays([batch["doc_id"], pa.array(fp.view(np.int64))], ["doc_id", "fp"])

    return texts_of(docs).mapInArrow(prints, "doc_id long, fp long")


def links(points: DataFrame, radius: int = 3, shard_rows: int = 16_384, most_shards: int = 4_096) -> DataFrame:
    """``a``, ``b``: links that join all distinct fingerprints (``fp``) within the radius of each other."""
    shards = min(most_shards, max(1, -(-points.count() // shard_rows)))
    # at most 16 * most_shards numbers, taken by a hash
    sample = np.array([r["fp"] for r in points.orderBy(F.xxhash64("fp"), "fp").limit(16 * shards).collect()], np.int64)
    tree = build(sample.view(np.uint64), shards)

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fp = batch["fp"].to_numpy(zero_copy_only=False)
            for shard, places, home in route(tree, fp.view(np.uint64), radius):
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(places), shard, np.int32)), pa.array(fp[places]), pa.array(np.full(len(places), home))],
                    ["shard", "fp", "home"],
                )

    def link(group: pa.Table) -> pa.Table:
        home = group["home"].to_numpy(zero_copy_only=False)
        fp = group["fp"].to_numpy()
        order = np.argsort(fp, kind="stable")
        fp, home = fp[order], home[order]
        found, places = Forest(len(fp)), np.arange(len(fp))
        link_within(fp.view(np.uint64), places[home], radius, found)
        link_between(fp.view(np.uint64), places[~home], places[home], radius, found)
        joined = found.parent != places
        return pa.table({"a": fp[joined], "b": fp[found.parent[joined]]})

    dealt = points.select("fp").mapInArrow(deal, "shard int, fp long, home boolean")
    return dealt.groupBy("shard").applyInArrow(link, "a long, b long")


def classes(prints: DataFrame, radius: int = 3) -> DataFrame:
    """``fp`` and ``component_id``, the smallest ``doc_id`` it reaches, of each distinct fingerprint of ``prints``."""
    points = written(prints.groupBy("fp").agg(F.min("doc_id").alias("least")), "points")
    roots = components(links(points, radius))
    placed = points.join(roots, points["fp"] == roots["node"], "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    ids = placed.groupBy("root").agg(F.min("least").alias("component_id"))
    return placed.join(ids, "root").select("fp", "component_id")


def near_duplicates(docs: DataFrame, words: int = 3, radius: int = 3) -> DataFrame:
    """``doc_id``, ``fingerprint`` (16 hex digits) and ``component_id`` of every row."""
    prints = written(fingerprints(docs, words), "fingerprints")
    return prints.join(classes(prints, radius), "fp").select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id"
    )
