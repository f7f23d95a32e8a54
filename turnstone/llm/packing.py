"""Best-fit packing of token sequences by bin completion, branch and bound over counts of lengths.

Documents are cut into pieces of at most ``capacity`` ids, so there are at most ``capacity`` different lengths; packing
only needs how many pieces have each. The search works on those counts. It takes the longest piece left and enumerates the
fillings of the room beside it, least waste first, from the sums that the pieces left can reach, so no length is passed over.
A filling that another dominates (it can be made longer by swapping a piece for a larger one that is left, or by adding
one) is not tried; one that is tried is laid as often as its counts allow. The best-fit solution is the first incumbent; a branch
whose waste already rules out fewer sequences than the incumbent's is pruned. The search ends when the incumbent meets the
lower bound, when nothing is left to try, or after half of ``nodes`` fillings; the other half goes to searches of the same kind over
the worst filled sequences and ``WINDOW`` others at a time. The problem is NP-hard, and this budget is its only limit.

The driver holds counts by length, at most ``capacity`` of them, and fillings, at most one for each length they use up.
Pieces stay distributed: each gets its rank among those of its length from partial counts, and the rank names its
place. Ids are taken once and pieces written to the shared folder, so ranks do not change if a task is run again.

A null text is empty and is one piece, the end id. Null and repeated document ids are kept: each row has its own pieces.
An empty table gives an empty result. Other columns are not read.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from turnstone.llm.common import texts_of, written
from turnstone.llm.tokens import tokenizer

WINDOW = 24
Filling = tuple[tuple[int, int], ...]  # lengths and how often, longest first


def lower_bound(counts: np.ndarray) -> int:
    """Sequences that no packing can do without: by total length, and by pieces that cannot share one."""
    capacity = len(counts) - 1
    lengths = np.arange(len(counts))
    total = int((counts * lengths).sum())
    best = -(-total // capacity)
    for k in range(1, capacity // 2 + 1):
        large, middle = int(counts[capacity - k + 1 :].sum()), counts[capacity // 2 + 1 : capacity - k + 1]
        room = int((middle * (capacity - lengths[capacity // 2 + 1 : capacity - k + 1])).sum())
        small = int((counts[k : capacity // 2 + 1] * lengths[k : capacity // 2 + 1]).sum())
        best = max(best, large + int(middle.sum()) + max(0, -(-(small - room) // capacity)))
    return best


def fillings(counts: np.ndarray, room: int) -> Iterator[tuple[Filling, int]]:
    """All fillings of the room with what each wastes: least waste first, those with larger pieces first among equals."""
    have = [int(x) for x in np.flatnonzero(counts[: room + 1]) if x]
    most = [int(counts[x]) for x in have]
    # bit s of reach[i]: some pieces of the first i lengths have the sum s
    reach, whole = [1], (1 << room + 1) - 1
    for x, n in zip(have, most):
        now, left, step = reach[-1], min(n, room // x), 1
        while left:
            take = min(step, left)
            now |= now << x * take & whole
            left -= take
            step *= 2
        reach.append(now)

    def with_sum(i: int, target: int) -> Iterator[Filling]:
        if not target:
            yield ()
            return
        for j in range(i, 0, -1):
            if not reach[j] >> target & 1:
                return
            x = have[j - 1]
            for times in range(min(most[j - 1], target // x), 0, -1):
                if reach[j - 1] >> target - x * times & 1:
                    for others in with_sum(j - 1, target - x * times):
                        yield ((x, times), *others)

    for waste in range(room + 1):
        for filling in with_sum(len(have), room - waste):
            yield filling, waste


def dominated(left: np.ndarray, filling: Filling, waste: int) -> bool:
    """Whether a piece left fits beside the filling, or in the place of a smaller one of it."""
    return bool(waste) and any(left[x + 1 : x + waste + 1].any() for x in (0, *(x for x, _ in filling)))


def lay(counts: np.ndarray, longest: int, filling: Filling) -> int:
    """How many sequences with this filling the counts allow."""
    need = Counter(dict(filling))
    need[longest] += 1
    return min(int(counts[x]) // n for x, n in need.items())


def best_fit(counts: np.ndarray) -> list[tuple[Filling, int]]:
    """Longest first, each sequence filled by the largest piece that still fits, again and again."""
    counts, out, capacity = counts.copy(), [], len(counts) - 1
    while counts.any():
        longest = int(np.flatnonzero(counts)[-1])
        need: Counter = Counter({longest: 1})
        room = capacity - longest
        while room:
            fit = np.flatnonzero(counts[: room + 1])
            fit = fit[[counts[x] > need[int(x)] for x in fit]] if len(fit) else fit
            if not len(fit):
                break
            x = int(fit[-1])
            take = min(room // x, int(counts[x]) - need[x])
            need[x] += take
            room -= x * take
        times = min(int(counts[x]) // n for x, n in need.items())
        out.append((tuple(sorted(need.items(), reverse=True)), times))
        for x, n in need.items():
            counts[x] -= n * times
    return out


def search(counts: np.ndarray, nodes: int) -> tuple[list[tuple[Filling, int]], int]:
    """The best solution found, and how many of the nodes are left."""
    capacity = len(counts) - 1
    bound, total = lower_bound(counts), int((counts * np.arange(len(counts))).sum())
    incumbent = best_fit(counts)
    fewest = sum(t for _, t in incumbent)
    Level = tuple[np.ndarray, int, int, int, Iterator[tuple[Filling, int]]]

    def level(now: np.ndarray, waste: int, used: int) -> Level:
        longest = int(np.flatnonzero(now)[-1])
        rest = now.copy()
        rest[longest] -= 1
        return now, waste, used, longest, fillings(rest, capacity - longest)

    # depth first: counts left, waste and sequences so far, the longest piece, fillings to try; and what was laid before each
    stack: list[Level] = []
    laid: list[tuple[Filling, int]] = []
    if fewest > bound:
        stack.append(level(counts, 0, 0))
    while stack and nodes > 0 and fewest > bound:
        now, waste, used, longest, untried = stack[-1]
        del laid[len(stack) - 1 :]
        filling, room = next(untried, ((), capacity + 1))
        # all waste of a better solution, for it has at least one sequence less
        spare = (fewest - 1) * capacity - total - waste
        if room > min(spare, capacity):
            stack.pop()
            continue
        nodes -= 1
        need = Counter(dict(filling))
        need[longest] += 1
        left = now.copy()
        for x, n in need.items():
            left[x] -= n
        times = lay(now, longest, filling)
        if room * times > spare or dominated(left, filling, room):
            continue
        for x, n in need.items():
            left[x] -= n * (times - 1)
        laid.append((tuple(sorted(need.items(), reverse=True)), times))
        if left.any():
            stack.append(level(left, waste + room * times, used + times))
        elif used + times < fewest:
            fewest, incumbent = used + times, list(laid)
    return incumbent, nodes


def complete(counts: np.ndarray, nodes: int = 4_000) -> list[tuple[Filling, int]]:
    """Fillings and how often to lay each: all pieces of ``counts`` (by length), in as few sequences as found."""
    bound, random = lower_bound(counts), np.random.default_rng(0)
    plan, left = search(counts, nodes - nodes // 2)
    nodes = nodes // 2 + left
    while nodes > 0 and sum(t for _, t in plan) > bound:
        full = np.array([sum(x * n for x, n in f) for f, _ in plan])
        times = np.array([t for _, t in plan])
        worst = [i for i in np.argsort(full, kind="stable")[:WINDOW].tolist() if full[i] < len(counts) - 1]
        taken = Counter(worst[: WINDOW // 2])
        for i in random.choice(len(plan), WINDOW, p=times / times.sum()).tolist():
            taken[i] += taken[i] < times[i]
        part = np.zeros_like(counts)
        for i, n in taken.items():
            for x, m in plan[i][0]:
                part[x] += m * n
        found, left = search(part, min(nodes, 8 * WINDOW))
        nodes -= max(WINDOW, min(nodes, 8 * WINDOW) - left)
        if sum(t for _, t in found) <= sum(taken.values()):
            merged: Counter = Counter({})
            for i, (filling, t) in enumerate(plan):
                merged[filling] += t - taken[i]
            for filling, t in found:
                merged[filling] += t
            plan = [(f, t) for f, t in merged.items() if t]
    return plan


def places(plan: list[tuple[Filling, int]]) -> dict[int, tuple[np.ndarray, ...]]:
    """For each length: ranks at which a run of places begins, and the run's first sequence, pieces in one, offset."""
    runs: dict[int, list[tuple[int, int, int, int]]] = {}
    given: Counter = Counter()
    sequence = 0
    for filling, times in plan:
        offset = 0
        for length, n in filling:
            runs.setdefault(length, []).append((given[length], sequence, n, offset))
            given[length] += n * times
            offset += length * n
        sequence += times
    return {length: tuple(np.array(c, np.int64) for c in zip(*r)) for length, r in runs.items()}


def pieces_of(docs: DataFrame, tokenizer_path: str, capacity: int, end_id: int) -> DataFrame:
    """``doc_id``, ``piece``, ``start``, ``length``, ``ids_crc32``, and ``part`` and ``nth`` among its length there."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, part = tokenizer(tokenizer_path), TaskContext.get().partitionId()
        seen: Counter = Counter()
        end = np.array([end_id], np.uint16)
        for batch in batches:
            rows = []
            for doc_id, ids in zip(batch["doc_id"].to_pylist(), words.encode(batch["text"])):
                ids = np.concatenate([ids, end]).astype("<u4")
                for piece, start in enumerate(range(0, len(ids), capacity)):
                    own = ids[start : start + capacity]
                    rows.append((doc_id, piece, start, len(own), zlib.crc32(own.tobytes()), part, seen[len(own)]))
                    seen[len(own)] += 1
            kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64()]
            names = ["doc_id", "piece", "start", "length", "ids_crc32", "part", "nth"]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows) if rows else [[]] * 7, kinds)], names)

    return texts_of(docs).mapInArrow(cut, "doc_id long, piece int, start long, length long, ids_crc32 long, part int, nth long")


def pack(docs: DataFrame, tokenizer_path: str, capacity: int = 2048, end_id: int = 0, nodes: int = 4_000) -> DataFrame:
    """``doc_id``, ``piece``, ``start``, ``length``, ``ids_crc32``, ``sequence_id``, ``offset`` of every piece."""
    pieces = written(pieces_of(docs, tokenizer_path, capacity, end_id), "pieces")
    partial = pieces.groupBy("part", "length").agg(F.count("*").alias("n"))
    before = partial.select(
        "part", "length", "n", (F.sum("n").over(Window.partitionBy("length").orderBy("part")) - F.col("n")).alias("before")
    )
    counts = np.zeros(capacity + 1, np.int64)
    for row in partial.groupBy("length").agg(F.sum("n").alias("n")).collect():  # at most `capacity` rows
        counts[row["length"]] = row["n"]
    runs = places(complete(counts, nodes))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length, rank = batch["length"].to_numpy(), batch["rank"].to_numpy()
            sequence, offset = np.zeros(len(length), np.int64), np.zeros(len(length), np.int64)
            for one in np.unique(length):
                mine = length == one
                begins, first, each, at = runs[int(one)]
                run = np.searchsorted(begins, rank[mine], side="right") - 1
                within = rank[mine] - begins[run]
                sequence[mine] = first[run] + within // each[run]
                offset[mine] = at[run] + within % each[run] * one
            yield pa.RecordBatch.from_arrays(
                [*(batch[c] for c in ("doc_id", "piece", "start", "length", "ids_crc32")), pa.array(sequence), pa.array(offset)],
                ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"],
            )

    ranked = pieces.join(before.drop("n"), ["part", "length"]).withColumn("rank", F.col("before") + F.col("nth"))
    ranked = ranked.select("doc_id", "piece", "start", "length", "ids_crc32", "rank")
    return ranked.mapInArrow(place, "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")
