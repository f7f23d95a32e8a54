"""One document of each group of near copies stays.

Documents link if the sets of their five-word shingles have a Jaccard similarity of ``similarity`` or more; a group is
what links connect. Candidates come from two sides. The vantage-point trees of ``simhash_tree`` give documents whose
SimHash fingerprints differ in at most ``radius`` bits. At a similarity of 0.8 fingerprints of 64 bits differ in about
ten, where distances to any vantage point (32, give or take 4) rule nothing out, so each document also has ``facets``
fingerprints of a few minimum-hash shingles each; two documents at 0.8 share one of 20 with probability 0.9996. Every
candidate pair is then verified by the exact sets.

Equal word sequences meet first and count as one text. In a bucket each text is paired with the bucket's first and with
its neighbour in an order that differs from facet to facet: two pairs a text. The pair that most buckets name
is verified first; other pairs only if their texts are not connected yet. Texts of a bucket (of a facet, or of equal
fingerprints) that holds three or more and is not one group by then are open: all pairs of open texts of different
groups are searched exactly, by an ordered prefix of their rarest shingles with bounds on length and position.

Of a group the document with the smallest id (nulls last, then the text's hash) stays, and of repeated rows one. A null
text is empty; all texts without words are copies of each other. Texts of fewer than five words have one shingle, the whole.
All columns pass through, whatever their names. An empty table stays empty.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from turnstone.llm.common import named, texts_of, utf8, words_of, written
from turnstone.llm.components import components
from turnstone.llm.shingles import majority, shingle_hashes, votes
from turnstone.llm.simhash_tree import links

WORDS, FACETS, PER_FACET = 5, 20, 5
SPAN = 1 << 18


def minima(hashes: np.ndarray) -> np.ndarray:
    """The least value of each of the permutations h * odd + shift over the hashes."""
    rng = np.random.Generator(np.random.PCG64(5))
    odd = rng.integers(0, 1 << 63, FACETS * PER_FACET, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    shift = rng.integers(0, 1 << 63, FACETS * PER_FACET, dtype=np.uint64)
    mixed = (hashes ^ (hashes >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    return np.array([(mixed * a + b).min() for a, b in zip(odd, shift)], np.uint64)


def facets_of(hashes: np.ndarray) -> list[int]:
    if not len(hashes):
        return []
    low = minima(hashes).reshape(FACETS, PER_FACET)
    return [xxhash.xxh64_intdigest(row.tobytes(), i) - (1 << 63) for i, row in enumerate(low)]


def sketches(docs: DataFrame) -> DataFrame:
    """``doc_id``, ``of``, ``words`` (digest of the word sequence), ``n`` distinct shingles, ``fp``, ``facets``."""

    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            digests, n, prints, facets = [], [], [], []
            for text in utf8(batch["text"]):
                words = words_of(text)
                all_hashes = shingle_hashes(words, WORDS)
                hashes = np.unique(all_hashes)
                digests.append(xxhash.xxh3_128_digest(b" ".join(words)))
                n.append(len(hashes))
                prints.append(majority(votes(all_hashes)[None, :], np.array([len(all_hashes)]))[0])
                facets.append(facets_of(hashes))
            yield pa.RecordBatch.from_arrays(
                [batch["doc_id"], batch["of"], pa.array(digests, pa.binary()), pa.array(n, pa.int64()),
                 pa.array(np.array(prints, np.uint64).view(np.int64)), pa.array(facets, pa.list_(pa.int64()))],
                ["doc_id", "of", "words", "n", "fp", "facets"],
            )

    rows = texts_of(docs).withColumn("of", F.xxhash64("text"))
    return rows.mapInArrow(sketch, "doc_id long, of long, words binary, n long, fp long, facets array<long>")


def candidates(texts: DataFrame, radius: int) -> DataFrame:
    """``a``, ``b``, ``times``: pairs of texts (``words``) that may be near copies, the later one first."""
    keyed = texts.select("words", "rank", F.explode("facets").alias("key"))
    bucket = Window.partitionBy("key")
    turn = bucket.orderBy(F.xxhash64("words", "key"))
    met = keyed.select(
        "words", F.min(F.struct("rank", "words")).over(bucket)["words"].alias("first"), F.lag("words").over(turn).alias("next")
    )
    pairs = met.select(F.col("words").alias("a"), F.explode(F.array("first", "next")).alias("b"))
    # equal fingerprints, and those that the tree links
    of_print = texts.groupBy("fp").agg(F.min(F.struct("rank", "words"))["words"].alias("first"))
    same = texts.join(of_print, "fp").select(F.col("words").alias("a"), F.col("first").alias("b"))
    found = links(of_print.select("fp"), radius)
    ends = of_print.select(F.col("fp").alias("a"), F.col("first").alias("one"))
    others = of_print.select(F.col("fp").alias("b"), F.col("first").alias("two"))
    near = found.join(ends, "a").join(others, "b").select(F.col("one").alias("a"), F.col("two").alias("b"))
    every = pairs.unionByName(same).unionByName(near).filter("b is not null and a <> b")
    every = every.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    return every.groupBy("a", "b").agg(F.count("*").alias("times"))


def open_texts(texts: DataFrame, groups: DataFrame) -> DataFrame:
    """``words`` and ``root`` of the texts in buckets of three or more that are not one group yet."""
    keys = F.concat("facets", F.array(F.xxhash64("fp", F.lit("print"))))
    placed = texts.join(groups, F.col("words") == F.col("node"), "left").select("words", F.coalesce("root", "words").alias("root"), F.explode(keys).alias("key"))
    several = placed.groupBy("key").agg(F.count("*").alias("n"), F.min("root").alias("low"), F.max("root").alias("high"))
    return placed.join(several.filter("n > 2 and low <> high").select("key"), "key", "left_semi").select("words", "root").distinct()


def sharing_prefixes(sets: DataFrame, similarity: float) -> DataFrame:
    """``a``, ``b``: all pairs of sets (``words``, ``root``, ``hashes``) of different roots that can be as similar as asked.

    With n shingles in an order common to all, rarest first, two sets that overlap in m share one of the first n - m + 1 of
    each. The larger of two overlaps in at least similarity * n, the smaller in 2 * similarity / (1 + similarity) * n.
    """

    def shingles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (b.slice(at, 500) for b in batches for at in range(0, b.num_rows, 500)):
            sizes = [len(x) // 8 for x in batch["hashes"].to_pylist()]
            which = pa.array(np.repeat(np.arange(len(sizes)), sizes))
            flat = np.frombuffer(b"".join(batch["hashes"].to_pylist()), np.int64)
            yield pa.RecordBatch.from_arrays(
                [batch["words"].take(which), batch["root"].take(which), pa.array(np.repeat(sizes, sizes), pa.int64()), pa.array(flat)], ["words", "root", "n", "h"]
            )

    every = sets.mapInArrow(shingles, "words binary, root binary, n long, h long")
    known = every.groupBy("h").agg(F.count("*").alias("times"), F.min("root").alias("low"), F.max("root").alias("high"))
    place = F.row_number().over(Window.partitionBy("words").orderBy("times", "h"))
    placed = every.join(known, "h").withColumn("at", place)
    n_first = lambda share: F.col("n") - F.ceil(F.col("n") * share - 1e-9) + 1
    # a shingle of one group alone joins no two groups
    front = written(placed.withColumn("short", F.col("at") <= n_first(2 * similarity / (1 + similarity)))
                    .filter((F.col("at") <= n_first(similarity)) & (F.col("low") != F.col("high"))).select("words", "root", "n", "h", "at", "short"), "fronts")
    small, large = front.filter("short").alias("s"), front.alias("l")
    fits = (F.col("s.n") <= F.col("l.n")) & (F.col("s.n") >= F.col("l.n") * similarity - 1e-9) & (F.col("s.root") != F.col("l.root"))
    fits &= (F.col("s.n") < F.col("l.n")) | (F.col("s.words") < F.col("l.words"))
    met = small.join(large, (F.col("s.h") == F.col("l.h")) & fits).groupBy(F.col("s.words").alias("a"), F.col("l.words").alias("b")).agg(
        F.count("*").alias("both"), F.least(F.first("s.n") - F.max("s.at"), F.first("l.n") - F.max("l.at")).alias("behind"), F.first(F.col("s.n") + F.col("l.n")).alias("sum")
    )
    # shingles met so far, and at most all behind the last of them
    return met.filter(F.col("both") + F.col("behind") >= F.col("sum") * similarity / (1 + similarity) - 1e-6).select("a", "b")


def verified(pairs: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """The pairs whose shingle sets are as similar as asked."""

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kept = []
            for one, two in zip(batch["one"].to_pylist(), batch["two"].to_pylist()):
                x, y = np.frombuffer(one, np.uint64), np.frombuffer(two, np.uint64)
                both = len(np.intersect1d(x, y, assume_unique=True))
                kept.append(both >= similarity * (len(x) + len(y) - both) - 1e-9)
            mask = pa.array(kept, pa.bool_())
            yield pa.RecordBatch.from_arrays([batch["a"].filter(mask), batch["b"].filter(mask)], ["a", "b"])

    one = sets.select(F.col("words").alias("a"), F.col("hashes").alias("one"))
    two = sets.select(F.col("words").alias("b"), F.col("hashes").alias("two"))
    return pairs.select("a", "b").join(one, "a").join(two, "b").mapInArrow(check, "a binary, b binary")


def without_near_copies(docs: DataFrame, similarity: float = 0.8, radius: int = 3) -> DataFrame:
    """One document of each group, with all columns."""
    rows = written(sketches(docs), "sketches")
    rank = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "of")
    texts = written(
        rows.groupBy("words").agg(F.min(rank).alias("rank"), F.first("n").alias("n"), F.first("fp").alias("fp"), F.first("facets").alias("facets")), "texts"
    )
    sizes = texts.select("words", "n")
    pairs = candidates(texts, radius).join(sizes.select(F.col("words").alias("a"), F.col("n").alias("na")), "a")
    pairs = pairs.join(sizes.select(F.col("words").alias("b"), F.col("n").alias("nb")), "b")
    fits = F.least("na", "nb") >= F.greatest("na", "nb") * similarity - 1e-9
    pairs = written(pairs.filter(fits).select("a", "b", "times"), "pairs")

    def hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [np.unique(shingle_hashes(words_of(t), WORDS)).tobytes() for t in utf8(batch["text"])]
            yield pa.RecordBatch.from_arrays([batch["words"], pa.array(found, pa.binary())], ["words", "hashes"])

    def sets_of(some: DataFrame) -> DataFrame:
        wanted = some.join(texts.select("words", "rank"), "words")
        wanted = wanted.select("words", F.col("rank")["doc_id"].alias("at_id"), F.col("rank")["of"].alias("at_of"))
        whole = texts_of(docs).withColumn("of", F.xxhash64("text"))
        whole = whole.join(wanted, (F.col("of") == F.col("at_of")) & F.col("doc_id").eqNullSafe(F.col("at_id"))).select("words", "text")
        return written(whole.mapInArrow(hashes, "words binary, hashes binary").dropDuplicates(["words"]), "sets")

    sets = sets_of(pairs.select(F.explode(F.array("a", "b")).alias("words")).distinct())
    likely = F.row_number().over(Window.partitionBy("a").orderBy(F.desc("times"), "b"))
    ranked = pairs.withColumn("nth", likely)
    first = written(verified(ranked.filter("nth = 1"), sets, similarity), "verified")
    roots = written(components(first), "roots")
    side = lambda k: roots.select(F.col("node").alias(k), F.col("root").alias("root_" + k))
    rest = ranked.filter("nth > 1").join(side("a"), "a", "left").join(side("b"), "b", "left")
    rest = rest.filter(F.coalesce("root_a", "a") != F.coalesce("root_b", "b"))
    second = verified(rest, sets, similarity)
    groups = written(components(roots.select(F.col("node").alias("a"), F.col("root").alias("b")).unionByName(second)), "groups")
    left = written(open_texts(texts, groups), "open")
    if not left.isEmpty():
        sets = sets_of(left.select("words"))
        third = verified(sharing_prefixes(sets.join(left, "words"), similarity), sets, similarity)
        groups = components(groups.select(F.col("node").alias("a"), F.col("root").alias("b")).unionByName(third))

    placed = texts.select("words", "rank").join(groups, F.col("words") == F.col("node"), "left")
    keepers = placed.groupBy(F.coalesce("root", "words").alias("root")).agg(F.min("rank").alias("rank"))
    times = rows.groupBy("doc_id", "of").agg(F.count("*").alias("times"))
    keepers = keepers.select(F.col("rank")["doc_id"].alias("at_id"), F.col("rank")["of"].alias("at_of")).join(
        times, F.col("at_id").eqNullSafe(F.col("doc_id")) & (F.col("at_of") == F.col("of"))
    ).select("at_id", "at_of", "times")
    packed = docs.select(
        F.struct(*[named(docs, c).alias(c) for c in docs.columns]).alias("row"), F.col("doc_id").cast("long").alias("doc_id"),
        F.xxhash64(F.coalesce(F.col("text").cast("string"), F.lit(""))).alias("of"),
    )
    kept = packed.join(keepers, F.col("doc_id").eqNullSafe(F.col("at_id")) & (F.col("of") == F.col("at_of")))
    once = kept.filter("times = 1").select("row").unionByName(kept.filter("times > 1").dropDuplicates(["doc_id", "of"]).select("row"))
    return once.select(*[F.col("row").getField(c).alias(c) for c in docs.columns])
