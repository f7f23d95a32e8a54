"""An adaptive context-mixing range coder for token ids below 65,536, run over many blocks at once.

A block is coded on its own: its model and coder start anew, so it can be read without any other. Blocks advance in step,
one id each, so a step is a few numpy operations over all of them. An encoder knows all ids beforehand: only its memories and its
range go step by step, the chances are worked out for ``RUN`` steps together.

Three models predict the next id. Order 2 and order 1 remember which id followed the last two ids, or the last one, and how
often they were right lately; order 0 knows how frequent ids are. The candidate is the id of the highest order that has one.
Each order turns its confidence in that id into a probability learned from the block so far; the three are mixed in the
logistic domain with weights that follow the errors. The mixed probability codes whether the candidate comes; if not, the id is
coded by its frequency. Memories of what followed are renewed with every id, probabilities and weights at the steps of ``renewals``,
for all states at once. All arithmetic is in whole numbers.

Frequencies (``frequencies``) are those of all ids that are coded together, kept beside the blocks; without them all ids are alike.

The coder holds a low end and a range of 64 bits. An id's share of the range is a number of 32 bits, 12 of the candidate's
probability and 20 of the frequencies, times the upper half of the range; once the range falls below 32 bits a 32-bit word is
written. A range that still straddles a word's border is cut at it first, so no carry is ever needed.
"""

from __future__ import annotations

from collections.abc import Iterator
from decimal import Decimal
from functools import cache

import numpy as np

HALF, LOW32, ONE = np.uint64(32), np.uint64(0xFFFFFFFF), np.uint64(1)
FULL = np.uint64(4096)  # of the chances
SLOT_BITS = 11  # of each order's memory of a block
TOTAL_BITS = 20  # of the sum of all frequencies
LIMIT = 2047
STATES = 256  # order 2: 8 confidences; order 1: 4, and whether it agrees; order 0: 4 classes
MIX_LAST, MIX_BEFORE = np.uint32(0x9E3779B1), np.uint32(0x85EBCA77)  # products run over, their upper bits are taken
RUN = 32  # steps whose chances an encoder works out together
START = 8  # what a state's first probability weighs, in ids


@cache
def tables() -> tuple[np.ndarray, np.ndarray]:
    """stretch of a 12-bit probability, ln(p / (1 - p)) * 256; squash, its inverse, of -2047..2047."""
    stretch = np.zeros(4096, np.int64)
    for p in range(1, 4096):
        stretch[p] = max(-LIMIT, min(LIMIT, int((Decimal(p) / Decimal(4096 - p)).ln() * 256)))
    stretch[0] = -LIMIT
    squash = np.array([int(Decimal(4096) / (1 + (-Decimal(x) / 256).exp())) for x in range(-LIMIT, LIMIT + 1)], np.int64)
    return stretch, np.clip(squash, 1, 4095).astype(np.int16)


def frequencies(ids: np.ndarray) -> np.ndarray:
    """How frequent each of the 65,536 ids is, of 2 to the power 20 in all; none that occurs has zero."""
    counts = np.bincount(ids, minlength=1 << 16)
    there = counts > 0
    if not there.any():
        return np.full(1 << 16, 1 << TOTAL_BITS - 16, np.int64)
    found = there + counts * ((1 << TOTAL_BITS) - int(there.sum())) // int(counts.sum())
    found[counts.argmax()] += (1 << TOTAL_BITS) - int(found.sum())
    return found


class Model:
    """Tables hold a row for each slot or state and a column for each block, so blocks that meet the same words share memory lines."""

    def __init__(self, lanes: int, freq: np.ndarray | None):
        freq = np.full(1 << 16, 1 << TOTAL_BITS - 16, np.int64) if freq is None else freq
        self.freq, self.cum = freq.astype(np.uint64), (np.cumsum(freq) - freq).astype(np.uint64)
        self.common = np.searchsorted([32, 256, 2048], freq, side="right").astype(np.int32)
        self.stretch, self.squash = tables()
        self.lanes, self.row = lanes, np.arange(lanes)
        self.rows = np.stack([self.row, self.row + (lanes << SLOT_BITS)])
        self.table = np.zeros(2 * lanes << SLOT_BITS, np.int32)  # of order 2, then of order 1: an id and how sure it is, 0 to 7
        self.weights = np.full((3, lanes), 26_000, np.int64)
        self.seen, self.right = ([np.zeros((n, lanes), np.int64) for n in (8, 8, 4)] for _ in range(2))
        # chances of each state's candidate before anything is learned, of 4096, order by order
        self.start = [np.array(x, np.int64)[:, None] for x in (
            [300, 1400, 2300, 2900, 3300, 3500, 3700, 3900], [60, 500, 1000, 1500, 120, 1300, 2400, 3300], [900, 1000, 1100, 1300],
        )]
        self.states: list[np.ndarray] = []
        self.hits: list[np.ndarray] = []
        self.votes: list[np.ndarray] = []
        self.renew()

    @staticmethod
    def by_order(x: np.ndarray) -> list[np.ndarray]:
        both = x.reshape(64, 4, -1).sum(axis=1, dtype=np.int32).reshape(8, 8, -1)
        none = x.reshape(64, 4, -1).sum(axis=0, dtype=np.int32)
        return [both.sum(axis=1), both.sum(axis=0), none.astype(np.int64)]

    def renew(self) -> None:
        """Learn from the steps since the last time, and mix a probability for every state of every block."""
        if self.states:
            states, hits = np.concatenate(self.states), np.concatenate(self.hits)
            self.states, self.hits = [], []
            seen, right = (
                np.bincount(x, minlength=STATES * self.lanes).astype(np.int32).reshape(STATES, self.lanes) for x in (states, states[hits])
            )
            errors = (right << 12) - seen * self.p.reshape(STATES, self.lanes)  # at most 512 steps of 4096 each
            for k, (error, votes) in enumerate(zip(self.by_order(errors), self.votes)):
                self.weights[k] = np.clip(self.weights[k] + ((error * votes).sum(axis=0) >> 15), -100_000, 100_000)
            for total, more in zip((*self.seen, *self.right), (*self.by_order(seen), *self.by_order(right))):
                total += more
        self.votes = [
            self.stretch.take(((right << 12) + START * first) // (seen + START), mode="clip")
            for seen, right, first in zip(self.seen, self.right, self.start)
        ]
        two, one, none = ((v * w).astype(np.int32) for v, w in zip(self.votes, self.weights))
        mixed = (two[:, None] + one)[:, :, None] + none
        mixed >>= 16
        mixed += LIMIT
        self.p = self.squash.take(mixed.ravel(), mode="clip")

    def slots(self, last: np.ndarray, before: np.ndarray) -> np.ndarray:
        """Where the orders 2 and 1 of the first blocks remember what follows; ids of one step, or of several steps as rows."""
        at = np.empty((*last.shape[:-1], 2, last.shape[-1]), np.int64)
        at[..., 0, :] = last * MIX_LAST + before * MIX_BEFORE >> np.uint32(32 - SLOT_BITS)
        at[..., 1, :] = last & np.uint16((1 << SLOT_BITS) - 1)
        at *= self.lanes
        at += self.rows[:, : last.shape[-1]]
        return at

    def foretold(self, two: np.ndarray, one: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The candidate and the state that says how likely it is, of what the two orders remember."""
        # choices between whole numbers by masks of ones or zeros: where() is slow on what cannot be foretold
        kept, sure = one >> 3, two & 7
        candidate = kept ^ (kept ^ two >> 3) & -sure >> 31
        agrees = (kept == candidate).view(np.int8) << 4
        state = (sure << 5) + ((one & 6) << 1) + self.common.take(candidate) + agrees
        return candidate, state * np.int64(self.lanes) + self.row[: one.shape[-1]]

    def note(self, states: np.ndarray, hits: np.ndarray) -> None:
        self.states.append(states.ravel())
        self.hits.append(hits.ravel())

    def remember(self, at: np.ndarray, had: np.ndarray, fresh: np.ndarray) -> None:
        """``fresh``: the ids that came, as one that the memory is little sure of."""
        sure = had & 7
        # wrong: half as sure, or forgotten
        new = sure + 1
        new >>= 1
        np.subtract(had, new, out=new)
        other = new ^ fresh
        sure -= 2
        other &= sure >> 31
        new ^= other
        # right again: surer
        sure -= 5
        sure >>= 31
        np.subtract(had, sure, out=sure)
        sure ^= new
        np.bitwise_xor(had, fresh, out=other)
        other -= 8
        other >>= 31
        sure &= other
        new ^= sure
        self.table[at] = new


def renewals(length: int) -> set[int]:
    return {32, 128, 256, *range(512, length, 512)}


def stretches(total: int, size: int) -> Iterator[tuple[int, int, int]]:
    """Steps of all blocks in runs: the first step, the one behind the last, and how many blocks go on; only the last block may be shorter."""
    lanes, steps = -(-total // size), min(size, total)
    last = total - (lanes - 1) * size
    cuts = sorted({*range(0, steps, RUN), *(x for x in renewals(size) if x < steps), last, steps})
    for first, behind in zip(cuts, cuts[1:]):
        yield first, behind, lanes if first < last else lanes - 1


def narrowed(low: np.ndarray, span: np.ndarray) -> np.ndarray:
    """A range that has become short, cut at a word's border if it straddles one."""
    return np.where((low ^ (low + span - ONE)) > LOW32, (~low + ONE) & LOW32, span)


def encode(ids: np.ndarray, size: int, freq: np.ndarray | None = None) -> list[bytes]:
    """The coded blocks of ``size`` ids, the last may be shorter."""
    if not len(ids):
        return []
    lanes = -(-len(ids) // size)
    whole = len(ids) // size
    came = np.zeros((min(size, len(ids)) + 2, lanes), np.uint16)  # a row for each step, behind two of nothing
    came[2:, :whole] = ids[: whole * size].reshape(whole, -1).T if whole else 0
    if whole < lanes:
        came[2 : len(ids) - whole * size + 2, whole] = ids[whole * size :]
    model = Model(lanes, freq)
    low, span = np.zeros(lanes, np.uint64), np.full(lanes, 0xFFFFFFFFFFFFFFFF, np.uint64)
    rows: list[np.ndarray] = []
    words: list[np.ndarray] = []
    renew = renewals(size)
    for first, behind, n in stretches(len(ids), size):
        if first in renew:
            model.renew()
        now = came[first + 2 : behind + 2, :n]
        # all ids are known: only the memory and the range go step by step
        at = model.slots(came[first + 1 : behind + 1, :n], came[first:behind, :n])
        fresh = (now.astype(np.int32) << 3) + 1
        had = np.empty(at.shape, np.int32)
        for step in range(behind - first):
            model.table.take(at[step], out=had[step], mode="clip")
            model.remember(at[step], had[step], fresh[step])
        candidate, state = model.foretold(had[:, 0], had[:, 1])
        hit = candidate == now
        model.note(state, hit)
        p = model.p.take(state).astype(np.uint64)
        bound, rest = p << np.uint64(TOTAL_BITS), FULL - p
        starts = (bound + rest * model.cum.take(now)) * ~hit
        widths = np.where(hit, bound, rest * model.freq.take(now))
        lo, sp = low[:n], span[:n]
        for step in range(behind - first):
            part = sp >> HALF
            lo += part * starts[step]
            np.multiply(part, widths[step], out=sp)
            short = np.flatnonzero(sp <= LOW32)
            if len(short):
                cut = lo.take(short)
                rows.append(short)
                words.append((cut >> HALF).astype(np.uint32))
                span[short] = narrowed(cut, sp.take(short)) << HALF
                low[short] = cut << HALF
    rows.append(np.arange(lanes))
    words.append(((low + LOW32) >> HALF).astype(np.uint32))
    row = np.concatenate(rows)
    put = np.argsort(row.astype(np.uint16) if lanes < 1 << 16 else row, kind="stable")
    stream = np.concatenate(words)[put].astype("<u4")
    parts = np.split(stream, np.cumsum(np.bincount(row, minlength=lanes))[:-1])
    return [part.tobytes() for part in parts]


def decode(blocks: list[bytes], total: int, size: int, freq: np.ndarray | None = None) -> np.ndarray:
    """The ids of all blocks; ``total`` of them, in blocks of ``size``."""
    if not total:
        return np.zeros(0, np.uint16)
    lanes, steps = -(-total // size), min(size, total)
    came = np.zeros((steps + 2, lanes), np.uint16)
    model = Model(lanes, freq)
    owner = np.repeat(np.arange(1 << 16, dtype=np.uint16), model.freq.astype(np.int64))  # the id of each place of all frequencies
    parts = [np.frombuffer(b, "<u4") for b in blocks]
    # two words behind each block: what is read past its end is zero
    sizes = np.array([len(p) + 2 for p in parts])
    stream = np.concatenate([x for p in parts for x in (p, np.zeros(2, np.uint32))]).astype(np.uint64)
    at = np.cumsum(sizes) - sizes
    value = stream[at] << HALF | stream[at + 1]
    at += 2
    low, span = np.zeros(lanes, np.uint64), np.full(lanes, 0xFFFFFFFFFFFFFFFF, np.uint64)
    renew = renewals(size)
    top = np.uint64((1 << TOTAL_BITS) - 1)
    for first, behind, n in stretches(total, size):
        if first in renew:
            model.renew()
        lo, sp, of = low[:n], span[:n], value[:n]
        for step in range(first, behind):
            places = model.slots(came[step + 1, :n], came[step, :n])
            had = model.table.take(places)
            candidate, state = model.foretold(had[0], had[1])
            p = model.p.take(state).astype(np.uint64)
            part = sp >> HALF
            share = part * (FULL - p)
            bound = part * p << np.uint64(TOTAL_BITS)
            above = of - lo
            hit = above < bound
            above -= bound
            above //= share
            found = owner.take(np.minimum(above, top).view(np.int64))
            now = np.where(hit, candidate.astype(np.uint16), found)
            lo += (bound + share * model.cum.take(now)) * ~hit
            np.copyto(sp, np.where(hit, bound, share * model.freq.take(now)))
            short = np.flatnonzero(sp <= LOW32)
            if len(short):
                cut = lo.take(short)
                value[short] = of.take(short) << HALF | stream.take(at.take(short), mode="clip")
                at[short] += 1
                span[short] = narrowed(cut, sp.take(short)) << HALF
                low[short] = cut << HALF
            came[step + 2, :n] = now
            model.note(state, hit)
            model.remember(places, had, (now.astype(np.int32) << 3) + 1)
    return came[2:].T.ravel()[:total] if steps == size else came[2:, 0].copy()
