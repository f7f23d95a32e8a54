"""Vector code compression: each part of a vector becomes the index of its nearest codebook entry; the search is memoised.

Components become integers (``floor(scale * x)``) and vectors are cut into equal consecutive parts, each position with its own
codebook: it starts as that part of the first vectors by id and is replaced ``rounds`` times by the floored means of the parts
assigned to each entry (unused entries stay). Distances are squared and Euclidean, in integers; ties go to the lower index.

Nearest entries are found through coarse cells: a part's coordinates divided by the cell's side name its cell, which is
looked up by its hash (its bytes are compared). A cell keeps the entries that its box does not rule out: those whose least
distance to the box is not above the smallest of the largest distances. Only these are evaluated exactly, for each
part in the cell. The memory of a task holds ``KEPT_CELLS`` cells a position, cells of a codebook forget with it, and a full
memory starts over: it decides how often a box is computed, never what is found.

A task sends sums and counts of its parts, so a row for each entry and coordinate leaves it; a codebook is all that reaches
the driver, and travels with the tasks of the next round. Vectors stay where they are and are read anew in each round.

A null vector, or one with a null or non-finite component, is left out; so is one whose length is not that of most kept
vectors that have all parts (ties: the shorter). A component beyond 2**26 after scaling is an error: distances would not fit in a
long. Equal ids are vectors of their own; a null id comes last among the first vectors. Fewer vectors than entries give a
smaller codebook, none an empty one. Other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from turnstone.llm.common import ready, written

KEPT_CELLS = 50_000
GROUP_ROWS = 4_096
PAIRS = 1 << 18  # parts and entries compared at a time
LARGEST = 1 << 26


def finite(column: Column) -> Column:
    """Whether a vector is there and holds finite numbers only."""
    good = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != F.lit(float("inf")))
    return F.coalesce(F.forall(column, good), F.lit(False))


def rows_of(column: pa.Array) -> np.ndarray:
    """Vectors of one length as a matrix of doubles."""
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1)


def integers(vectors: np.ndarray, scale: int) -> np.ndarray:
    whole = np.floor(vectors * scale)
    if whole.size and np.abs(whole).max() > LARGEST:
        raise ValueError("a component is too large for exact distances")
    return whole.astype(np.int64)


class Cells:
    """Which entries of one codebook may be nearest in the coarse cells seen so far."""

    def __init__(self, entries: np.ndarray, side: int):
        self.entries, self.side = entries, side
        self.known: dict[bytes, int] = {}
        self.masks = np.empty((0, len(entries)), bool)

    def learn(self, cells: np.ndarray) -> np.ndarray:
        """Masks of cells, by the least and largest distance of each entry to the cell's box."""
        out = np.empty((len(cells), len(self.entries)), bool)
        step = max(1, PAIRS // len(self.entries))
        for at in range(0, len(cells), step):
            some = cells[at : at + step]
            near, far = (np.zeros((len(some), len(self.entries)), np.int64) for _ in range(2))
            for coordinate, entry in zip(some.T, self.entries.T):  # few cells differ in a coordinate: each is squared once
                distinct, which = np.unique(coordinate, return_inverse=True)
                low = (distinct * self.side)[:, None]
                below, above = low - entry, entry - (low + self.side - 1)
                near += (np.maximum(np.maximum(below, above), 0) ** 2)[which]
                far += (np.maximum(np.abs(below), np.abs(above)) ** 2)[which]
            out[at : at + step] = near <= far.min(axis=1)[:, None]
        return out

    def of(self, parts: np.ndarray) -> np.ndarray:
        """The number of each part's cell in ``masks``."""
        cells = np.ascontiguousarray(parts // self.side)
        names = cells.view(np.dtype((np.void, cells.shape[1] * 8))).ravel()
        distinct, first, which = np.unique(names, return_index=True, return_inverse=True)
        keys = [n.tobytes() for n in distinct]
        if len(self.known) + len(keys) > KEPT_CELLS:
            self.known, self.masks = {}, self.masks[:0]
        new = [i for i, k in enumerate(keys) if k not in self.known]
        if new:
            self.known.update(zip((keys[i] for i in new), range(len(self.masks), len(self.masks) + len(new))))
            self.masks = np.concatenate([self.masks, self.learn(cells[first[new]])])
        return np.fromiter((self.known[k] for k in keys), np.int64, len(keys))[which]

    def nearest(self, parts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Index of the nearest entry and its squared distance, for each part."""
        cell = self.of(parts)
        index, error = np.empty(len(parts), np.int64), np.empty(len(parts), np.int64)
        step = max(1, PAIRS // len(self.entries))
        for at in range(0, len(parts), step):
            some = parts[at : at + step]
            row, entry = np.nonzero(self.masks[cell[at : at + step]])
            gap = some[row] - self.entries[entry]
            distance = np.einsum("pj,pj->p", gap, gap)
            begin = np.searchsorted(row, np.arange(len(some)))  # every box keeps an entry
            best = np.minimum.reduceat(distance, begin)
            hit = np.flatnonzero(distance == best[row])
            where = np.searchsorted(row[hit], np.arange(len(some)))  # the first hit has the lowest index
            index[at : at + step], error[at : at + step] = entry[hit[where]], best
        return index, error


def nearest_entries(parts: np.ndarray, memory: list[Cells]) -> tuple[np.ndarray, np.ndarray]:
    """Indexes and squared distances, a column for each position. ``parts``: vector, position, coordinate."""
    found = [cells.nearest(np.ascontiguousarray(parts[:, p])) for p, cells in enumerate(memory)]
    return np.stack([f[0] for f in found], axis=1), np.stack([f[1] for f in found], axis=1)


def groups(batches: Iterator[pa.RecordBatch], n_parts: int, scale: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    for batch in batches:
        for at in range(0, batch.num_rows, GROUP_ROWS):
            some = batch.slice(at, GROUP_ROWS)
            yield some, integers(rows_of(some["embedding"]), scale).reshape(some.num_rows, n_parts, -1)


class Codec:
    """Codebooks for the parts of vectors: ``entries[position, entry, coordinate]``."""

    def __init__(self, entries: np.ndarray, n_parts: int, scale: int, side: int):
        self.entries, self.n_parts, self.scale, self.side = entries, n_parts, scale, side

    def sha256(self) -> str:
        return hashlib.sha256(",".join(map(str, self.entries.ravel().tolist())).encode()).hexdigest()

    def sums(self, vectors: DataFrame) -> list:
        """Count and sums of the parts that each entry is nearest to; at most a row for each entry and coordinate."""
        entries, n_parts, scale, side = self.entries, self.n_parts, self.scale, self.side
        width = entries.shape[2]

        def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            memory = [Cells(e, side) for e in entries]
            total = np.zeros((*entries.shape[:2], width + 1), np.int64)
            for _, parts in groups(batches, n_parts, scale):
                index, _ = nearest_entries(parts, memory)
                for p in range(n_parts):
                    np.add.at(total[p], index[:, p], np.concatenate([parts[:, p], np.ones((len(parts), 1), np.int64)], axis=1))
            p, e = np.nonzero(total[:, :, width])
            values = total[p, e]
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.repeat(p * entries.shape[1] + e, width + 1)), pa.array(np.tile(np.arange(width + 1), len(p))), pa.array(values.ravel())],
                ["entry", "at", "v"],
            )

        return vectors.select("embedding").mapInArrow(add, "entry long, at long, v long").groupBy("entry", "at").agg(F.sum("v").alias("v")).collect()

    def moved(self, vectors: DataFrame) -> "Codec":
        """The codebooks after one more round."""
        n, width = self.entries.shape[1:]
        total = np.zeros((self.entries.shape[0] * n, width + 1), np.int64)
        for r in self.sums(vectors):
            total[r["entry"], r["at"]] = r["v"]
        total = total.reshape(self.entries.shape[0], n, width + 1)
        count = total[:, :, width:]
        means = total[:, :, :width] // np.maximum(count, 1)
        return Codec(np.where(count > 0, means, self.entries), self.n_parts, self.scale, self.side)

    def encode(self, vectors: DataFrame, columns: list[str]) -> DataFrame:
        """``columns`` of the vectors with ``code`` (two hex digits a part) and ``error``."""
        entries, n_parts, scale, side = self.entries, self.n_parts, self.scale, self.side

        def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            memory = [Cells(e, side) for e in entries]
            for some, parts in groups(batches, n_parts, scale):
                index, error = nearest_entries(parts, memory)
                codes = [row.tobytes().hex() for row in index.astype(np.uint8)]
                yield pa.RecordBatch.from_arrays(
                    [*(some[c] for c in columns), pa.array(codes, pa.string()), pa.array(error.sum(axis=1))], [*columns, "code", "error"]
                )

        rows = vectors.select(*columns, "embedding")
        schema = rows.schema[: len(columns)].add("code", "string").add("error", "long")
        return rows.mapInArrow(code, schema)


def kept_vectors(vectors: DataFrame, n_parts: int) -> DataFrame:
    """The rows that take part, with their columns as they are; none if no vector does."""
    ready(vectors.sparkSession)
    good = vectors.filter(finite(F.col("embedding")) & (F.size("embedding") > 0) & (F.size("embedding") % n_parts == 0))
    common = good.groupBy(F.size("embedding").alias("n")).count().orderBy(F.desc("count"), "n").first()
    return good.filter(F.size("embedding") == (common["n"] if common else 0))


def fit_codec(
    vectors: DataFrame, n_parts: int = 4, n_entries: int = 256, rounds: int = 4, scale: int = 1024, side: int = 64
) -> Codec:
    """Codebooks learned from all ``vectors`` (``vec_id``, ``embedding``), as ``kept_vectors`` gives them."""
    if not 0 < n_entries <= 256:
        raise ValueError("an index has two hex digits")
    first = vectors.select("vec_id", "embedding").orderBy(F.asc_nulls_last("vec_id"), "embedding").limit(n_entries).collect()
    if not first:
        return Codec(np.empty((n_parts, 0, 0), np.int64), n_parts, scale, side)
    start = integers(np.array([r["embedding"] for r in first], np.float64), scale)
    codec = Codec(start.reshape(len(first), n_parts, -1).transpose(1, 0, 2).copy(), n_parts, scale, side)
    for _ in range(rounds):
        codec = codec.moved(vectors)
    return codec


def compress(vectors: DataFrame, **options: int) -> DataFrame:
    """``vec_id``, ``code``, ``error``, ``label_error`` (errors of all vectors with the label) and ``codebooks_sha256``.
    ``vectors``: ``vec_id``, ``embedding``, ``label``."""
    kept = kept_vectors(vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding", "label"), options.get("n_parts", 4))
    codec = fit_codec(kept, **options)
    # written once: the labels' sums and the rows both start from it
    coded = written(codec.encode(kept, ["vec_id", "label"]), "codes").alias("c")
    # partial sums, so a label of very many vectors costs a row for each task; joined by a side Spark has measured
    sums = coded.groupBy("label").agg(F.sum("error").alias("label_error")).alias("s")
    return coded.join(sums, F.col("c.label").eqNullSafe(F.col("s.label"))).select(
        "vec_id", "code", "error", "label_error", F.lit(codec.sha256()).alias("codebooks_sha256")
    )
