"""Word shingles as 64-bit hashes, and SimHash votes over them, in numpy."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import xxhash

from turnstone.llm.common import words_of

SEED = 42
PIECE = 1 << 18  # shingles whose bits are unpacked at a time: 16 MB


def shingle_hashes(words: list[bytes], size: int) -> np.ndarray:
    """XXH64 of each run of ``size`` words joined by blanks; of the whole sequence if it is shorter; none of no words."""
    if not words:
        return np.empty(0, np.uint64)
    joined, digest = b" ".join(words), xxhash.xxh64_intdigest
    if len(words) <= size:
        return np.array([digest(joined, SEED)], np.uint64)
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(lengths + 1) - 1
    starts = (ends - lengths)[: len(words) - size + 1].tolist()
    return np.array([digest(joined[s:e], SEED) for s, e in zip(starts, ends[size - 1 :].tolist())], np.uint64)


def votes(hashes: np.ndarray, weights: np.ndarray | None = None) -> np.ndarray:
    """For each of 64 bits, highest first: the weight of the hashes that have it."""
    total = np.zeros(64, np.int64 if weights is None else np.float64)
    for at in range(0, len(hashes), PIECE):
        bits = np.unpackbits(hashes[at : at + PIECE].astype(">u8").view(np.uint8).reshape(-1, 8), axis=1)
        total += bits.sum(axis=0, dtype=np.int64) if weights is None else weights[at : at + PIECE] @ bits
    return total


def majority(ones: np.ndarray, whole: np.ndarray) -> np.ndarray:
    """Fingerprints: a bit is 1 if more than half the weight has it. ``ones`` is (n, 64)."""
    return np.packbits(2 * ones > whole[:, None], axis=1).view(">u8").ravel().astype(np.uint64)


def fingerprints_of(texts: Iterable[bytes], size: int) -> np.ndarray:
    rows, counts = [], []
    for hashes in hashes_of(texts, size):
        rows.append(votes(hashes))
        counts.append(len(hashes))
    return majority(np.array(rows).reshape(-1, 64), np.array(counts)) if rows else np.empty(0, np.uint64)


def hashes_of(texts: Iterable[bytes], size: int) -> Iterator[np.ndarray]:
    for text in texts:
        yield shingle_hashes(words_of(text), size)
