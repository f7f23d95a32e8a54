"""Importance resampling towards a target distribution, by hashed word features.

Features are all runs of ``shortest`` to ``longest`` words, joined by one blank, repeats counted; a feature's bucket is the
CRC-32 of its bytes (see ``span_crc``) modulo ``buckets``. A bucket's gain is the floor of 1000 times the logarithm of its
smoothed share in the target over that in the documents; a document's weight is the sum of its features' gains. A share of
the documents with enough words is drawn without replacement: the highest weights after Gumbel noise from the id.

Bucket counts and totals come from all rows; a task sends its counts once, not once a document. The gains, one number
for each bucket, travel with the tasks. Ranks come from one range shuffle of ids and numbers: the count of each range
gives its first rank, so no task sees more than its range.

A null text has no words; documents without features weigh 0 and are never drawn; n_words alone decides who may be. Rows
with equal ids are documents of their own, in any order among each other if they are alike. A null id has noise as the
empty text and comes last among equal scores. Null target texts count nothing; an empty target is smoothed alone. An
empty table stays empty. Other columns are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from turnstone.llm.common import ready, texts_of, written
from turnstone.llm.span_crc import crc32_of_spans

CHUNK_BYTES = 1 << 22
# byte -> byte in lower case, 0 for bytes outside words; fixed rule: 0-9, A-Z, a-z and all of 128 and above are in words
_IN = np.array([b if b >= 128 or chr(b).isalnum() else 0 for b in range(256)], np.uint8)
_LOWER = np.array([b + 32 if 65 <= b <= 90 else _IN[b] for b in range(256)], np.uint8)


def feature_buckets(texts: list[bytes], shortest: int, longest: int, buckets: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bucket of each feature, the text it belongs to, and the number of words of each text."""
    data = _LOWER[np.frombuffer(b"\0".join([*texts, b""]), np.uint8)]  # a byte outside words ends each text
    inside = np.concatenate([[False], data != 0, [False]])
    edges = np.flatnonzero(inside[1:] != inside[:-1])
    starts, ends = edges[::2], edges[1::2]
    sizes = np.fromiter(map(len, texts), np.int64, len(texts)) + 1
    of = np.searchsorted(np.cumsum(sizes), starts, side="right")
    if longest > 1:  # words one blank apart
        lengths = ends - starts
        begins = np.cumsum(lengths + 1) - lengths - 1
        together = np.full(int((lengths + 1).sum()), 32, np.uint8)
        word = np.repeat(np.arange(len(starts)), lengths)
        place = np.arange(len(word)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
        together[begins[word] + place] = data[starts[word] + place]
        data, starts, ends = together, begins, begins + lengths
    found, owners = [], []
    for n in range(shortest, longest + 1):
        whole = np.flatnonzero(of[n - 1 :] == of[: len(of) - n + 1]) if len(of) >= n else np.empty(0, np.int64)
        found.append(crc32_of_spans(data, starts[whole], ends[whole + n - 1] - starts[whole]).astype(np.int64) % buckets)
        owners.append(of[whole])
    return np.concatenate(found), np.concatenate(owners), np.bincount(of, minlength=len(texts))


def chunks(batch: pa.RecordBatch) -> Iterator[tuple[pa.RecordBatch, list[bytes]]]:
    """Rows of about ``CHUNK_BYTES`` of text at a time."""
    texts = batch["text"].cast(pa.binary()).to_pylist()
    first = held = 0
    for i, text in enumerate(texts):
        held += len(text)
        if held >= CHUNK_BYTES or i == len(texts) - 1:
            yield batch.slice(first, i + 1 - first), texts[first : i + 1]
            first, held = i + 1, 0


def bucket_counts(texts: DataFrame, shortest: int, longest: int, buckets: int) -> np.ndarray:
    """Features of all texts in each bucket."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            for _, some in chunks(batch):
                total += np.bincount(feature_buckets(some, shortest, longest, buckets)[0], minlength=buckets)
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(total[used])], ["bucket", "n"])

    # at most a row for each bucket reaches the driver
    rows = texts.select("text").mapInArrow(count, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect()
    counts = np.zeros(buckets, np.int64)
    counts[[r["bucket"] for r in rows]] = [r["n"] for r in rows]
    return counts


def gains(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    buckets, total, wanted = len(source), int(source.sum()), int(target.sum())
    return np.array(
        [math.floor(1000 * math.log((t + 1) * (total + buckets) / ((s + 1) * (wanted + buckets)))) for s, t in zip(source.tolist(), target.tolist())],
        np.int64,
    )


def noise(seed: int) -> Column:
    """1000 times Gumbel noise from the id, rounded down."""
    mark = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")))
    h = F.conv(F.substring(F.sha2(mark, 256), 1, 8), 16, 10).cast("double")
    return F.floor(-1000 * F.log(-F.log((h + 0.5) / F.lit(4294967296.0))))


def importance_weights(docs: DataFrame, target: DataFrame, shortest: int = 1, longest: int = 2, buckets: int = 10_000) -> DataFrame:
    """``doc_id``, ``n_words``, ``n_features`` and ``weight`` of every document. ``target``: ``text``."""
    ready(docs.sparkSession)
    wanted = target.select(F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    texts = texts_of(docs)
    gain = gains(bucket_counts(texts, shortest, longest, buckets), bucket_counts(wanted, shortest, longest, buckets))

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, some in chunks(batch):
                bucket, of, words = feature_buckets(some, shortest, longest, buckets)
                order = np.argsort(of, kind="stable")
                n = np.bincount(of, minlength=len(some))
                total = np.concatenate([[0], np.cumsum(gain[bucket[order]])])
                ends = np.cumsum(n)
                yield pa.RecordBatch.from_arrays(
                    [rows["doc_id"], pa.array(words, pa.int64()), pa.array(n, pa.int64()), pa.array(total[ends] - total[ends - n])],
                    ["doc_id", "n_words", "n_features", "weight"],
                )

    return texts.mapInArrow(weigh, "doc_id long, n_words long, n_features long, weight long")


def resample(
    docs: DataFrame, target: DataFrame, percent: int = 10, min_words: int = 20, seed: int = 2024,
    shortest: int = 1, longest: int = 2, buckets: int = 10_000,
) -> DataFrame:
    """``doc_id``, ``n_features``, ``weight``, ``score`` and ``rank`` of every document; undrawn ones have no rank."""
    scored = importance_weights(docs, target, shortest, longest, buckets).withColumn("score", F.col("weight") + noise(seed))
    may = (F.col("n_words") >= min_words).alias("may")
    order = [F.desc("may"), F.desc("score"), F.asc_nulls_last("doc_id"), F.asc("weight"), F.asc("n_features")]
    # each task marks its rows with its range; the sample that chooses ranges reads a written table, not the texts again
    listed = written(scored.withColumn("may", may), "weights")

    def numbered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, place = TaskContext.get().partitionId(), 0
        for batch in batches:
            marks = [pa.array(np.full(batch.num_rows, part)), pa.array(np.arange(place, place + batch.num_rows))]
            place += batch.num_rows
            yield pa.RecordBatch.from_arrays([*batch.columns, *marks], [*batch.schema.names, "part", "place"])

    kept = listed.select("doc_id", "n_features", "weight", "score", "may")
    ranges = written(
        kept.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(
            numbered, "doc_id long, n_features long, weight long, score long, may boolean, part long, place long"
        ),
        "ranks",
    )
    # a row for each range
    sums = ranges.groupBy("part").agg(F.count_if("may").alias("n"))
    whole = Window.orderBy("part")
    before = sums.select(
        "part", (F.sum("n").over(whole) - F.col("n")).alias("before"),
        F.floor(F.sum("n").over(whole.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)) * percent / 100).alias("drawn"),
    )
    rank = F.col("place") + F.col("before") + 1
    return ranges.join(before, "part").select(
        "doc_id", "n_features", "weight", "score", F.when(F.col("may") & (rank <= F.col("drawn")), rank).alias("rank")
    )
