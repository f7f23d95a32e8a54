"""Document fingerprints: SimHash of weighted terms, and all fingerprints within a Hamming radius by permuted block tables.

Terms are runs of ``words`` words, hashed to 64 bits; a term that stands t times votes with 1 + floor(log2 t). The 64 bits
are cut into radius + 2 blocks. Two fingerprints within the radius agree in at least two blocks, so for each choice of
two blocks a table keyed by them (the permuted leading bits) brings every such pair into one bucket. A pair counts in
the first table it meets in only. Equal fingerprints meet before, and a bucket returns a count for each fingerprint,
never its pairs. A bucket of more than ``most`` fingerprints is keyed again by radius + 1 blocks of its other bits, one of
which a pair must share; what stays crowded is dealt into salted pieces, and each two pieces are a group of their own. No
task holds more than about two pieces of ``most`` fingerprints.

A null text is empty and has fingerprint zero. Equal texts have equal fingerprints. Null ids are kept and come last in
descending order; rows with equal ids are ordered by text. The next document of the last one is the first, and of the
only one itself. An empty table gives an empty result. Other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from turnstone.llm.common import texts_of, words_of, written
from turnstone.llm.shingles import majority, shingle_hashes, votes

BITS = 64
BLOCK = 1024


def fingerprint(text: str, words: int = 2) -> int:
    terms, counts = np.unique(shingle_hashes(words_of(text.encode()), words), return_counts=True)
    ones, whole, times = np.zeros(BITS, np.int64), 0, 1
    while len(terms):
        ones += votes(terms)
        whole += len(terms)
        times *= 2
        terms, counts = terms[counts >= times], counts[counts >= times]
    return int(majority(ones[None, :], np.array([whole]))[0])


def likeness(a: int, b: int) -> float:
    """Share of equal bits."""
    return 1 - (a ^ b).bit_count() / BITS


def edited(text: str, following: str) -> str:
    """The text with its last third replaced by as much of the start of the following one."""
    cut = len(text) // 3
    return text[: len(text) - cut] + following[:cut]


COLUMNS = "doc_id long, n_chars long, edited_sha256 string, fp long, edited_fp long, near_edited double, near_next double"
NAMES = [c.split()[0] for c in COLUMNS.split(", ")]


def compared(doc_id: int | None, text: str, own: int, following: str, next_print: int, words: int) -> tuple:
    changed = edited(text, following)
    print_ = fingerprint(changed, words)
    return doc_id, len(text), hashlib.sha256(changed.encode()).hexdigest(), own, print_, likeness(own, print_), likeness(own, next_print)


def signed(value: int) -> int:
    return value - (1 << BITS) if value >= 1 << (BITS - 1) else value


def as_batch(rows: list[tuple], extra: str = "") -> pa.RecordBatch:
    kinds = {"long": pa.int64(), "string": pa.string(), "double": pa.float64(), "int": pa.int32()}
    fields = [c.split() for c in (COLUMNS + extra).split(", ")]
    rows = [(*r[:3], signed(r[3]), signed(r[4]), *r[5:]) for r in rows]
    columns = zip(*rows) if rows else [[] for _ in fields]
    return pa.RecordBatch.from_arrays([pa.array(c, kinds[k]) for c, (_, k) in zip(columns, fields)], [n for n, _ in fields])


def with_edits(docs: DataFrame, words: int = 2) -> DataFrame:
    """Every document in descending ``doc_id`` with its edited text's digest and both fingerprints' likenesses.

    One range shuffle brings neighbours together. The last document of a range needs the first of the next range: those,
    two for each range, go through the shared folder and are finished apart.
    """
    extra = ", part int, edge string, text string"

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, last = TaskContext.get().partitionId(), None
        for batch in batches:
            out = []
            for doc_id, text in zip(batch["doc_id"].to_pylist(), batch["text"].to_pylist()):
                own = fingerprint(text, words)
                if last is None:
                    out.append((doc_id, 0, None, own, 0, 0.0, 0.0, part, "first", text))
                else:
                    out.append((*compared(*last, text, own, words), None, None, None))
                last = doc_id, text, own
            yield as_batch(out, extra)
        if last is not None:
            yield as_batch([(last[0], 0, None, last[2], 0, 0.0, 0.0, part, "last", last[1])], extra)

    ordered = texts_of(docs).repartitionByRange(F.desc_nulls_last("doc_id")).sortWithinPartitions(F.desc_nulls_last("doc_id"), "text")
    scanned = written(ordered.mapInArrow(scan, COLUMNS + extra), "edits")
    done = scanned.filter("edge is null").select(*NAMES)
    firsts = scanned.filter("edge = 'first'").select(F.col("part").alias("next"), F.col("text").alias("following"), F.col("fp").alias("next_fp"))
    # numbers of ranges alone meet in one task; the texts go from range to range
    ring = Window.orderBy("part")
    order = scanned.filter("edge = 'first'").select("part", F.coalesce(F.lead("part").over(ring), F.first("part").over(ring)).alias("next"))
    mask = (1 << BITS) - 1

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield as_batch([compared(i, t, fp & mask, f, n & mask, words) for i, t, fp, f, n in zip(*(c.to_pylist() for c in batch.columns))])

    tails = scanned.filter("edge = 'last'").select("part", "doc_id", "text", "fp").join(order, "part").join(firsts, "next")
    tails = tails.select("doc_id", "text", "fp", "following", "next_fp")
    return done.unionByName(tails.mapInArrow(finish, COLUMNS))


def block_masks(radius: int) -> list[int]:
    """The bits of the blocks that each table is keyed by."""
    edges = np.linspace(0, BITS, radius + 3).round().astype(int)
    blocks = [((1 << int(b - a)) - 1) << int(a) for a, b in zip(edges, edges[1:])]
    return [x | y for x, y in combinations(blocks, 2)]


def rest_masks(mask: int, radius: int) -> list[int]:
    """radius + 1 blocks of the bits that ``mask`` lacks."""
    bits = [b for b in range(BITS) if not mask >> b & 1]
    return [sum(1 << bits[i] for i in part) for part in np.array_split(np.arange(len(bits)), radius + 1)]


def near_counts(x: np.ndarray, y: np.ndarray, radius: int, earlier: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """For each of ``x`` and of ``y``, how many of the other side are near and agree in none of the ``earlier`` blocks."""
    n, m = np.zeros(len(x), np.int64), np.zeros(len(y), np.int64)
    for at in range(0, len(x), BLOCK):
        for to in range(0, len(y), BLOCK):
            differ = x[at : at + BLOCK, None] ^ y[None, to : to + BLOCK]
            near = (np.bitwise_count(differ) <= radius) & (differ != 0)
            for mask in earlier:
                near &= (differ & np.uint64(mask)) != 0
            n[at : at + BLOCK] += near.sum(axis=1)
            m[to : to + BLOCK] += near.sum(axis=0)
    return n, m


def crowded(placed: DataFrame, keys: list[str], most: int) -> DataFrame:
    """Keys of more than ``most`` rows, with ``pieces``, how many pieces of that size they make."""
    sizes = placed.groupBy(*keys).agg(F.count("*").alias("n")).filter(F.col("n") > most)
    return written(sizes.select(*keys, F.ceil(F.col("n") / most).cast("int").alias("pieces")), "crowded")


def neighbours(prints: DataFrame, radius: int = 3, most: int = 1_024) -> DataFrame:
    """``fp`` and ``n_near``, how many other distinct fingerprints lie within the radius, for those that have any."""
    masks = block_masks(radius)
    rests = [rest_masks(m, radius) for m in masks]
    points = prints.select("fp").distinct()
    keyed = F.array(*[F.struct(F.lit(i).alias("table"), F.col("fp").bitwiseAND(F.lit(signed(m))).alias("key")) for i, m in enumerate(masks)])
    placed = points.select("fp", F.inline(keyed))
    large = crowded(placed, ["table", "key"], most)
    whole = placed.join(large, ["table", "key"], "left_anti").withColumn("sub", F.lit(-1))

    rest = F.element_at(F.array(*[F.array(*[F.lit(signed(m)) for m in r]) for r in rests]), F.col("table") + 1)
    again = (
        placed.join(large.select("table", "key"), ["table", "key"])
        .select("fp", "table", "key", F.posexplode(rest).alias("sub", "mask"))
        .withColumn("subkey", F.col("fp").bitwiseAND(F.col("mask"))).drop("mask")
    )
    keys = ["table", "key", "sub", "subkey"]
    larger = crowded(again, keys, most)
    # a row goes to the groups of its own piece with each piece
    salted = again.join(larger, keys, "left").withColumn("pieces", F.coalesce("pieces", F.lit(1)))
    salted = salted.withColumn("piece", F.pmod(F.xxhash64("fp"), F.col("pieces")).cast("int"))
    salted = salted.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("pieces") - 1)))
    groups = (
        salted.groupBy(*keys, F.least("piece", "other").alias("low"), F.greatest("piece", "other").alias("high"))
        .agg(F.collect_list(F.when(F.col("piece") == F.least("piece", "other"), F.col("fp"))).alias("fps"),
             F.collect_list(F.when(F.col("piece") != F.least("piece", "other"), F.col("fp"))).alias("others"))
        .select("table", "sub", "fps", F.when(F.col("low") != F.col("high"), F.col("others")).alias("others"))
    )
    buckets = whole.groupBy("table", "key", "sub").agg(F.collect_list("fp").alias("fps"))
    buckets = buckets.filter(F.size("fps") > 1).select("table", "sub", "fps", F.lit(None).cast("array<long>").alias("others"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps, ns = [np.empty(0, np.uint64)], [np.empty(0, np.int64)]
            for table, sub, own, others in zip(batch["table"].to_pylist(), batch["sub"].to_pylist(), batch["fps"], batch["others"]):
                earlier = masks[:table] + rests[table][: max(sub, 0)]  # pairs that met in one of these are counted there
                x = own.values.to_numpy().view(np.uint64)
                if not others.is_valid:
                    found = [(x, near_counts(x, x, radius, earlier)[0])]
                else:
                    y = others.values.to_numpy().view(np.uint64)
                    found = list(zip((x, y), near_counts(x, y, radius, earlier)))
                for values, n in found:
                    fps.append(values[n > 0])
                    ns.append(n[n > 0])
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(fps).view(np.int64)), pa.array(np.concatenate(ns))], ["fp", "n"])

    counted = [g.mapInArrow(count, "fp long, n long") for g in (buckets, groups)]
    return counted[0].unionByName(counted[1]).groupBy("fp").agg(F.sum("n").alias("n_near"))


def fingerprint_documents(docs: DataFrame, words: int = 2, radius: int = 3) -> DataFrame:
    """``doc_id``, ``n_chars``, ``edited_sha256``, ``fingerprint``, ``edited_fingerprint``, ``near_edited``, ``near_next``, ``n_near``."""
    rows = written(with_edits(docs, words), "fingerprints")
    near = neighbours(rows, radius)
    text = lambda c: F.lower(F.lpad(F.hex(c), 16, "0"))
    return rows.join(near, "fp", "left").select(
        "doc_id", "n_chars", "edited_sha256", text("fp").alias("fingerprint"), text("edited_fp").alias("edited_fingerprint"),
        "near_edited", "near_next", F.coalesce("n_near", F.lit(0)).alias("n_near"),
    )
