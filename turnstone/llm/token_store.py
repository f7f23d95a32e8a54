"""Token ids on disk: range-coded blocks in Parquet files, written in ascending ``doc_id`` and read back.

A file row is a segment, a run of whole documents: ``shard`` and ``first``, its place among the ids; ``doc_ids`` and
``lengths`` (ids of each document); ``block_ids``, ``sizes`` and ``crcs``, the coded bytes and the crc32 of the ids
(little-endian 16-bit) of each block; ``frequencies``, how frequent each id is in the segment; ``payload``, the coded blocks one
after another. Each block is coded by itself and read with the frequencies alone. A block whose ids do not give its checksum is an error.

A null text is empty and has the end id only. Null ids come first; rows with equal ids are ordered by text, and all are
written. An empty table gives an empty store. Other columns are not read. Ids above 65,535 are refused.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from turnstone.llm.common import texts_of
from turnstone.llm.range_coder import decode, encode, frequencies
from turnstone.llm.tokens import tokenizer

BLOCK_IDS = 2_048
SEGMENT_IDS = 8_388_608
SCHEMA = (
    "shard int, first long, doc_ids array<long>, lengths array<long>, block_ids int, sizes array<int>, crcs array<long>, "
    "frequencies binary, payload binary"
)
ARROW = pa.schema([
    ("shard", pa.int32()), ("first", pa.int64()), ("doc_ids", pa.list_(pa.int64())), ("lengths", pa.list_(pa.int64())),
    ("block_ids", pa.int32()), ("sizes", pa.list_(pa.int32())), ("crcs", pa.list_(pa.int64())), ("frequencies", pa.binary()),
    ("payload", pa.binary()),
])


def packed_frequencies(found: np.ndarray) -> bytes:
    """The frequencies' bytes, all lowest ones first, compressed."""
    return zlib.compress(found.astype("<u4").view(np.uint8).reshape(-1, 4).T.tobytes())


def unpacked_frequencies(data: bytes) -> np.ndarray:
    return np.frombuffer(zlib.decompress(data), np.uint8).reshape(4, -1).T.copy().view("<u4").ravel().astype(np.int64)


def segment(shard: int, first: int, doc_ids: list, parts: list[np.ndarray]) -> pa.RecordBatch:
    ids = np.concatenate(parts)
    found = frequencies(ids)
    blocks = encode(ids, BLOCK_IDS, found)
    crcs = [zlib.crc32(ids[at : at + BLOCK_IDS].astype("<u2").tobytes()) for at in range(0, len(ids), BLOCK_IDS)]
    sizes = [len(b) for b in blocks]
    row = [shard, first, doc_ids, [len(p) for p in parts], BLOCK_IDS, sizes, crcs, packed_frequencies(found), b"".join(blocks)]
    return pa.RecordBatch.from_arrays([pa.array([v], f.type) for v, f in zip(row, ARROW)], schema=ARROW)


def write_tokens(docs: DataFrame, path: str, tokenizer_path: str, end_id: int = 1) -> None:
    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, shard, first = tokenizer(tokenizer_path), TaskContext.get().partitionId(), 0
        end = np.array([end_id], np.uint16)
        doc_ids: list = []
        parts: list[np.ndarray] = []
        held = 0
        for batch in batches:
            for doc_id, ids in zip(batch["doc_id"].to_pylist(), words.encode(batch["text"])):
                doc_ids.append(doc_id)
                parts.append(np.concatenate([ids, end]))
                held += len(ids) + 1
                if held >= SEGMENT_IDS:
                    yield segment(shard, first, doc_ids, parts)
                    first, doc_ids, parts, held = first + held, [], [], 0
        if parts:
            yield segment(shard, first, doc_ids, parts)

    ordered = texts_of(docs).repartitionByRange(F.asc_nulls_first("doc_id")).sortWithinPartitions(F.asc_nulls_first("doc_id"), "text")
    ordered.mapInArrow(write, SCHEMA).write.parquet(path)


def decoded(row: dict) -> np.ndarray:
    """The ids of a segment, checked block by block."""
    cuts = np.cumsum([0, *row["sizes"]])
    blocks = [row["payload"][a:b] for a, b in zip(cuts, cuts[1:])]
    ids = decode(blocks, int(sum(row["lengths"])), row["block_ids"], unpacked_frequencies(row["frequencies"]))
    for at, crc in zip(range(0, len(ids), row["block_ids"]), row["crcs"]):
        if zlib.crc32(ids[at : at + row["block_ids"]].astype("<u2").tobytes()) != crc:
            raise ValueError(f"block at id {row['first'] + at} of shard {row['shard']} is damaged")
    return ids


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    """``doc_id``, ``start``, ``n_tokens``, ``ids_crc32`` of each document, from its decoded ids."""
    stored = spark.read.schema(SCHEMA).parquet(path)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                ids = decoded(row).astype("<u4")
                ends = np.cumsum(np.array(row["lengths"], np.int64))
                starts = ends - row["lengths"]
                crcs = [zlib.crc32(ids[a:b].tobytes()) for a, b in zip(starts.tolist(), ends.tolist())]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([row["shard"]] * len(crcs), pa.int32()), pa.array(row["doc_ids"], pa.int64()), pa.array(starts + row["first"]),
                     pa.array(row["lengths"], pa.int64()), pa.array(crcs, pa.int64())],
                    ["shard", "doc_id", "start", "n_tokens", "ids_crc32"],
                )

    found = stored.mapInArrow(read, "shard int, doc_id long, start long, n_tokens long, ids_crc32 long")
    # a row for each shard, that is each task that wrote
    sums = stored.groupBy("shard").agg(F.sum(F.aggregate("lengths", F.lit(0).cast("long"), lambda a, x: a + x)).alias("n"))
    before = sums.select("shard", (F.sum("n").over(Window.orderBy("shard")) - F.col("n")).alias("before"))
    return found.join(before, "shard").select("doc_id", (F.col("start") + F.col("before")).alias("start"), "n_tokens", "ids_crc32")
