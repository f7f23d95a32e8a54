"""CRC-32 of many spans of one buffer at a time, from a position table.

A checksum without its initial value is linear over exclusive or: each byte adds a number that depends on the byte and on
its distance from the span's end alone. So the numbers are looked up for all bytes of all spans at once, put together by
``bitwise_xor.reduceat`` over the spans, and a constant for the span's length adds the initial value. Spans longer than the
table fold block by block: the checksum so far is carried over a block by four tables, then the block's own bytes are added.
"""

from __future__ import annotations

from functools import cache

import numpy as np

POLYNOMIAL = 0xEDB88320  # fixed value: CRC-32 of zip files, bits reversed
BLOCK = 256  # distances in the table, and bytes of a block of a long span
PIECE = 1 << 20  # bytes of spans looked up at a time
FULL = np.uint32(0xFFFFFFFF)


@cache
def tables() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``at[d, b]``: what byte b adds at distance d from the end. ``length[n]``: the constant of n bytes. ``over[i, b]``:
    byte i of a checksum carried over a block."""
    byte = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        byte = np.where(byte & 1, byte >> 1 ^ np.uint32(POLYNOMIAL), byte >> 1)
    one = byte  # over a zero byte: the low byte moves out through the table

    def step(x: np.ndarray) -> np.ndarray:
        return x >> np.uint32(8) ^ one[x & np.uint32(255)]

    at = np.empty((BLOCK, 256), np.uint32)
    at[0] = one
    for d in range(1, BLOCK):
        at[d] = step(at[d - 1])
    length = np.empty(BLOCK + 1, np.uint32)
    length[0] = FULL
    for n in range(BLOCK):
        length[n + 1] = step(length[n : n + 1])[0]
    # a checksum's byte i passes the block as if it were the block's byte i
    return at, length, np.stack([at[BLOCK - 1 - i] for i in range(4)])


def short_spans(data: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Checksums of spans of 1 to ``BLOCK`` bytes."""
    at, length, _ = tables()
    ends = np.cumsum(lengths)
    begins = ends - lengths
    place = np.arange(ends[-1])
    of = np.repeat(np.arange(len(starts)), lengths)
    byte = data[place + (starts - begins)[of]]
    distance = (ends - 1)[of] - place
    return np.bitwise_xor.reduceat(at.ravel()[distance * 256 + byte], begins) ^ length[lengths] ^ FULL


def long_spans(data: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Checksums of longer spans: what is over from whole blocks first, then block by block, all spans in step."""
    at, _, over = tables()
    distance = (np.arange(BLOCK - 1, -1, -1) * 256)[None, :]
    first = (lengths - 1) % BLOCK + 1
    state = short_spans(data, starts, first) ^ FULL
    here, stop = starts + first, starts + lengths
    on = np.flatnonzero(here < stop)
    while len(on):
        now = state[on]
        moved = over[0][now & 255] ^ over[1][now >> 8 & 255] ^ over[2][now >> 16 & 255] ^ over[3][now >> 24]
        block = data[here[on][:, None] + np.arange(BLOCK)[None, :]]
        state[on] = moved ^ np.bitwise_xor.reduce(at.ravel()[distance + block], axis=1)
        here[on] += BLOCK
        on = on[here[on] < stop[on]]
    return state ^ FULL


def crc32_of_spans(data: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Unsigned CRC-32 of ``data[start : start + length]`` for each span; spans may overlap. ``data`` holds bytes."""
    out = np.zeros(len(starts), np.uint32)
    long = lengths > BLOCK
    if long.any():
        which = np.flatnonzero(long)
        for few in np.array_split(which, -(-len(which) // (PIECE // BLOCK))):
            out[few] = long_spans(data, starts[few], lengths[few])
    which = np.flatnonzero(~long & (lengths > 0))
    if len(which):
        total = np.cumsum(lengths[which])
        cuts = np.searchsorted(total, np.arange(PIECE, total[-1], PIECE))
        for few in np.split(which, cuts):
            if len(few):
                out[few] = short_spans(data, starts[few], lengths[few])
    return out
