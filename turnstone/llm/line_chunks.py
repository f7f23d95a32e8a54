"""Line dedup by content-defined chunks of lines.

Lines end where the text's lines end. Passages also move between documents inside lines, so a line of more than ``LONG``
words is wrapped by its own content: a piece ends after a word whose hash is the least among its neighbours. Each line has a
hash of its words; rolling hashes over ``window`` line hashes choose the chunk boundaries, where they are least among their
neighbours. Text before or after a passage moves no boundary inside it, and two boundaries are never next to each
other, so every inner chunk has several lines.

A chunk of ``SEED_WORDS`` words or more that stands more than once in the corpus is a copy in all places but the first: the
smallest ``doc_id`` (nulls last), then text hash, then place. Copies grow to each side on which neither they nor the first
have another repeated chunk, while the words there are equal, by at most ``MARGIN`` words, so a passage goes with its ends and
short chunks; copies that touch become one run, and runs of ``min_words`` words or more are removed. A shorter run, a common
phrase, stays.

Only 64-bit hashes and places are shuffled for all chunks; texts are then asked for the bytes of those whose hash stands in
several places, and bytes decide. The least place of a hash is a window over rows of four numbers.

A null text is empty. An emptied document stays, with an empty text. Rows with equal id and text are one document:
they share their places and come out alike, each of them. Columns keep their names and order; ``text`` and ``n_chars`` (if
there) tell of the new text, all others pass through whatever their names. An empty table stays empty.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructType

from turnstone.llm.common import named, ready, utf8

SEED = 11
MIX = np.uint64(0x9E3779B97F4A7C15)
GROUP_BYTES = 4 << 20  # of texts whose equal chunks meet in a task
LONG = 8
MARGIN = 32
SEED_WORDS = 6  # shorter chunks are found as what lies beside others
_BLACK = np.array([not bytes([b]).isspace() for b in range(256)])


class _Hashes(dict):
    def __missing__(self, word: bytes) -> int:
        number = self[word] = xxhash.xxh64_intdigest(word, SEED)
        return number


def least_here(values: np.ndarray, group: np.ndarray) -> np.ndarray:
    """Where a value is less than both neighbours of its own group; group ends count as larger."""
    top = np.uint64(0xFFFFFFFFFFFFFFFF)
    before = np.concatenate([[top], values[:-1]])
    before[np.concatenate([[True], group[1:] != group[:-1]])] = top
    after = np.concatenate([values[1:], [top]])
    after[np.concatenate([group[1:] != group[:-1], [True]])] = top
    return (values < before) & (values < after)


def chunk_words(hashes: np.ndarray, doc: np.ndarray, line: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
    """First word and word after the last of each chunk. ``doc`` tells the words' texts apart, ``line`` their lines."""
    if not len(hashes):
        return np.empty(0, np.int64), np.empty(0, np.int64)
    new_line = np.concatenate([[True], line[1:] != line[:-1]])
    sizes = np.diff(np.append(np.flatnonzero(new_line), len(line)))
    ends = least_here(hashes, line) & np.repeat(sizes > LONG, sizes)
    starts = np.flatnonzero(new_line | np.concatenate([[False], ends[:-1]]))  # of lines and their pieces
    nth = np.arange(len(hashes)) - np.repeat(starts, np.diff(np.append(starts, len(hashes))))
    powers = np.cumprod(np.full(int(nth.max()) + 1, MIX, np.uint64))
    lines = np.add.reduceat(hashes * powers[nth], starts)
    of = doc[starts]
    rolled = np.zeros(len(lines), np.uint64)
    for k in range(window):
        ahead = np.concatenate([lines[k:], np.zeros(min(k, len(lines)), np.uint64)])
        inside = np.concatenate([of[k:], np.full(min(k, len(lines)), -1)]) == of
        rolled = rolled * MIX + np.where(inside, ahead, np.uint64(0))
    rolled = (rolled ^ rolled >> np.uint64(29)) * MIX
    first = least_here(rolled, of) | np.concatenate([[True], of[1:] != of[:-1]])
    word = starts[np.flatnonzero(first)]
    return word, np.append(word[1:], len(hashes))


def split_lines(text: bytes) -> tuple[list[bytes], list[int]]:
    """The words of a text, and the number of words of each of its lines that has any."""
    words: list[bytes] = []
    sizes: list[int] = []
    for line in text.split(b"\n"):
        own = line.split()
        if own:
            words += own
            sizes.append(len(own))
    return words, sizes


def chunks_in(texts: list[bytes], window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Text, first word, word after the last, and hash of each chunk that may be a copy."""
    known = _Hashes()
    words, lines = zip(*map(split_lines, texts)) if texts else ((), ())
    flat = [w for own in words for w in own]
    sizes = [len(own) for own in words]
    hashes = np.fromiter(map(known.__getitem__, flat), np.uint64, len(flat))
    per_line = [n for own in lines for n in own]
    a, b = chunk_words(hashes, np.repeat(np.arange(len(sizes)), sizes), np.repeat(np.arange(len(per_line)), per_line), window)
    begin = np.cumsum([0, *sizes])
    if not len(a):
        return a, a, b, np.empty(0, np.uint64)
    # chunks follow each other without gaps: a hash is a sum of word hashes, each times a power that tells its place
    nth = np.arange(len(hashes)) - np.repeat(a, b - a)
    whole = np.add.reduceat(hashes * np.cumprod(np.full(int(nth.max()) + 1, MIX, np.uint64))[nth], a)
    whole = (whole ^ whole >> np.uint64(29)) * MIX
    large = b - a >= SEED_WORDS
    a, b = a[large], b[large]
    of = np.searchsorted(begin, a, side="right") - 1
    return of, a - begin[of], b - begin[of], whole[large]


def common_end(left: list[bytes], right: list[bytes]) -> int:
    """How many of the last words are equal."""
    n = 0
    for x, y in zip(reversed(left), reversed(right)):
        if x != y:
            break
        n += 1
    return n


def runs(spans: list[tuple[int, int]], least: int) -> list[tuple[int, int]]:
    """Spans that touch as one, if it has at least as many words."""
    out: list[list[int]] = []
    for start, end in sorted(spans):
        if out and start <= out[-1][1]:
            out[-1][1] = max(out[-1][1], end)
        else:
            out.append([start, end])
    return [(a, b) for a, b in out if b - a >= least]


def text_mark() -> Column:
    """Tells apart the texts of one id: half a hash, or a whole one where there is no id."""
    return F.when(F.col("doc_id").isNull(), F.xxhash64("text")).otherwise(F.shiftrightunsigned(F.xxhash64("text"), 32))


def groups(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of about ``GROUP_BYTES`` of text at a time."""
    for batch in batches:
        first = held = 0
        sizes = np.asarray(pc.fill_null(pc.binary_length(batch["text"]), 0)).tolist()
        for i, size in enumerate(sizes):
            held += size
            if held >= GROUP_BYTES or i == len(sizes) - 1:
                yield batch.slice(first, i + 1 - first)
                first, held = i + 1, 0


def place_batch(rows: list[tuple], kinds: dict[str, pa.DataType]) -> pa.RecordBatch:
    columns = zip(*rows) if rows else [[]] * len(kinds)
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds.values())], list(kinds))


# a span is one number: its first word, and in the last 28 bits how many words it has
PLACE = {"doc_id": pa.int64(), "of": pa.int64(), "span": pa.int64()}
PLACED = "doc_id long, of long, span long"
WORDS = (1 << 28) - 1


def found_in_groups(texts: DataFrame, window: int) -> DataFrame:
    """Place and ``hash`` of each chunk that may be a copy."""
    kinds = PLACE | {"hash": pa.int64()}

    def chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in groups(batches):
            which, a, b, hashes = chunks_in(utf8(batch["text"]), window)
            which, spans = pa.array(which, pa.int64()), pa.array(a << 28 | b - a, pa.int64())
            hashes = pa.array(hashes.view(np.int64))
            yield pa.RecordBatch.from_arrays([batch["doc_id"].take(which), batch["of"].take(which), spans, hashes], list(kinds))

    return texts.mapInArrow(chunks, f"{PLACED}, hash long")


def doc_key() -> Column:
    """One number to join texts and places by; both compare id and text mark after that."""
    return F.xxhash64("doc_id", "of")


def repeated_spans(texts: DataFrame, window: int) -> DataFrame:
    """Places of all copies, grown to their ends, from ``texts`` (``row``, ``key``, ``doc_id``, ``of``, ``text``)."""
    places = found_in_groups(texts.select("doc_id", "of", "text"), window)
    here = F.struct(F.col("doc_id").isNull(), "doc_id", "of", "span")
    of_hash = Window.partitionBy("hash")
    several = places.withColumn("low", F.min(here).over(of_hash)).withColumn("high", F.max(here).over(of_hash)).filter("low <> high")
    asked = several.select(doc_key().alias("key"), F.col("doc_id").alias("asked_id"), F.col("of").alias("asked_of"), "span")
    asked = asked.repartition("key").groupBy("key", "asked_id", "asked_of").agg(F.collect_set("span").alias("asked"))
    kinds = PLACE | {"bytes": pa.binary(), "before": pa.binary(), "after": pa.binary()}

    def fetch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in groups(batches):
            rows = []
            columns = zip(*(batch[c].to_pylist() for c in ("doc_id", "of", "asked_id", "asked_of", "asked")), utf8(batch["text"]))
            for doc_id, of, asked_id, asked_of, asked, text in columns:
                if (asked_id, asked_of) != (doc_id, of):  # another document with the same key
                    continue
                words = text.split()
                mine = [(x >> 28, (x >> 28) + (x & WORDS), x) for x in asked]
                starts, ends = {a for a, _, _ in mine}, {b for _, b, _ in mine}
                for a, b, x in mine:
                    before = words[max(0, a - MARGIN) : a] if a not in ends else ()
                    after = words[b : b + MARGIN] if b not in starts else ()
                    rows.append((doc_id, of, x, *(b" ".join(w) for w in (words[a:b], before, after))))
            yield place_batch(rows, kinds)

    # all columns go along, so that this join and the last one share the shuffle of the texts
    told = texts.join(asked, "key").mapInArrow(fetch, f"{PLACED}, bytes binary, before binary, after binary")
    equal = Window.partitionBy("bytes").orderBy(here)
    first = told.withColumns({"at": F.first(here).over(equal), "left": F.first("before").over(equal), "right": F.first("after").over(equal)})
    copies = first.filter(here != F.col("at")).select("doc_id", "of", "span", "before", "after", "left", "right")

    def grow(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for doc_id, of, span, *beside in zip(*(c.to_pylist() for c in batch.columns)):
                before, after, left, right = (x.split() for x in beside)
                low, high = common_end(before, left), common_end(after[::-1], right[::-1])
                rows.append((doc_id, of, (span >> 28) - low << 28 | (span & WORDS) + low + high))
            yield place_batch(rows, PLACE)

    return copies.mapInArrow(grow, PLACED)


def without_spans(text: bytes, spans: list[tuple[int, int]]) -> bytes:
    """The text without words start to end of each span; a line feed behind a span stays."""
    if not spans:
        return text
    black = _BLACK[np.frombuffer(text, np.uint8)]
    edges = np.flatnonzero(np.diff(black, prepend=False, append=False))
    starts, ends = edges[::2].tolist(), edges[1::2].tolist()  # of words
    out, done = [], 0
    for start, end in sorted(spans):
        begin = starts[start]
        if begin > done:
            out.append(text[done:begin])
        tail = starts[end] if end < len(starts) else len(text)
        if tail > done and b"\n" in text[ends[end - 1] : tail]:
            out.append(b"\n")
        done = max(done, tail)
    out.append(text[done:])
    return b"".join(out)


def without_repeated_lines(docs: DataFrame, window: int = 2, min_words: int = 20) -> DataFrame:
    """All documents, with their columns, without the repeated passages of ``min_words`` words or more."""
    ready(docs.sparkSession)
    others = [c for c in docs.columns if c != "text"]
    rows = docs.select(
        F.struct(*[named(docs, c).alias(c) for c in others]).alias("row"), F.col("doc_id").cast("long").alias("doc_id"),
        F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"),
    )
    marked = rows.withColumn("of", text_mark()).withColumn("key", doc_key())
    spans = repeated_spans(marked, window).withColumn("key", doc_key()).repartition("key")
    spans = spans.groupBy("key", "doc_id", "of").agg(F.collect_set("span").alias("spans"))
    spans = spans.groupBy("key").agg(F.collect_list(F.struct("doc_id", "of", "spans")).alias("spans"))
    joined = marked.join(spans, "key", "left")

    def rewrite(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in groups(batches):
            new = []
            for doc_id, of, spans, text in zip(*(batch[c].to_pylist() for c in ("doc_id", "of", "spans")), utf8(batch["text"])):
                own = next((x["spans"] for x in spans or () if (x["doc_id"], x["of"]) == (doc_id, of)), ())
                mine = [(x >> 28, (x >> 28) + (x & WORDS)) for x in own]
                new.append(without_spans(text, runs(mine, min_words)))
            yield pa.RecordBatch.from_arrays([batch["row"], pa.array(new, pa.binary()).cast(pa.string())], ["row", "text"])

    new = joined.mapInArrow(rewrite, StructType().add("row", joined.schema["row"].dataType).add("text", StringType()))
    out = []
    for name in docs.columns:
        column = F.col("text") if name == "text" else F.col("row").getField(name)
        if name == "n_chars":
            column = F.length("text").cast(docs.schema[name].dataType)
        out.append(column.alias(name))
    return new.select(*out)
