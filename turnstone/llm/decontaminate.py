"""Benchmark decontamination with DataFrame operations only: size-partitioned MinHash containment search.

Texts become lower-case words of letters and digits, and the set of their five-word shingles, each hashed. An item is
contained if at least ``threshold`` of its distinct shingles occur in a document, wherever they stand.

A long document's MinHash sketch says nothing about a short item in it, so the sketch is taken of the item and
sized by the item: items fall into partitions of equal shingle count n, and each keeps its
k = n - ceil(threshold * n) + 1 minimum hashes. A document that holds the threshold's share misses at most k - 1
shingles, so it holds one of the k for certain: a document's shingles that hit a sketch give candidates without a miss.
Candidates are then verified by the exact shingles, compared as words, not as hashes.

An item of fewer than five words has one shingle, all its words, looked for as a run of that many words. An
empty or null item or document matches nothing; equal rows give equal rows. A null ``doc_id`` or ``item_id`` stays null
in the result. Contamination depends on the text alone; other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from turnstone.llm.common import packed, unpacked

WORDS = 5


def word_list(text: Column) -> Column:
    """Lower-case words of letters and digits; none for an empty text."""
    spaced = F.trim(F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}]+", " "))
    return F.when(spaced == "", F.array().cast("array<string>")).otherwise(F.split(spaced, " "))


def shingled(rows: DataFrame, keys: list[str], words: str, size: int) -> DataFrame:
    """A row for each place of a ``size``-word shingle: the keys, ``hash`` and, as an array, ``shingle``."""
    long_enough = rows.filter(F.size(words) >= size)
    # the list beside itself, moved by one word each: rows of `size` words come out of generated code
    beside = F.arrays_zip(*[F.slice(words, F.lit(i + 1), F.size(words) - (size - 1)).alias(f"w{i}") for i in range(size)])
    placed = long_enough.select(*keys, F.inline(beside))
    names = [f"w{i}" for i in range(size)]
    return placed.select(*keys, F.xxhash64(*names).alias("hash"), F.array(*names).alias("shingle"))


def item_shingles(items: DataFrame, threshold: float) -> DataFrame:
    """``item``, ``size`` (words of a shingle), ``hash``, ``shingle``, ``n`` and ``sketched`` for each distinct shingle."""
    listed = items.select(F.col("item_id").alias("item_id"), word_list(F.coalesce("text", F.lit(""))).alias("words"))
    listed = listed.select(F.struct("item_id", F.xxhash64("words").alias("of")).alias("item"), "words").dropDuplicates(["item"])
    parts = None
    for size in range(1, WORDS + 1):
        fitting = listed.filter(F.size("words") == size if size < WORDS else F.size("words") >= size)
        part = shingled(fitting, ["item"], "words", size).withColumn("size", F.lit(size))
        parts = part if parts is None else parts.unionByName(part)
    sets = parts.distinct().groupBy("item", "size").agg(F.array_sort(F.collect_list(F.struct("hash", "shingle"))).alias("all"))
    n = F.size("all")
    k = n - F.ceil(n * F.lit(threshold) - F.lit(1e-9)) + 1
    return sets.select("item", "size", n.alias("n"), k.alias("k"), F.posexplode("all").alias("place", "s")).select(
        "item", "size", "n", (F.col("place") < F.col("k")).alias("sketched"), F.col("s")["hash"].alias("hash"), F.col("s")["shingle"].alias("shingle")
    )


def contained_items(docs: DataFrame, items: DataFrame, keys: list[str], threshold: float = 0.8) -> DataFrame:
    """``keys`` of documents (which tell their texts apart), ``item_id``, ``n_shingles``, ``n_found`` and ``containment``."""
    shingles = item_shingles(items, threshold)
    sizes = [r["size"] for r in shingles.select("size").distinct().collect()]  # five rows at most
    texts = docs.select(*keys, "text")
    listed = texts.select(*keys, word_list(F.col("text")).alias("words"))
    if not sizes:
        return listed.limit(0).select(*keys, F.lit(None).cast("long").alias("item_id"), F.lit(0).alias("n_shingles"), F.lit(0).alias("n_found"), F.lit(0.0).alias("containment"))
    sketch = shingles.filter("sketched").select("size", "hash", "item", "n")
    found = []
    for size in sorted(sizes):
        mine = sketch.filter(F.col("size") == size).drop("size")
        found.append(shingled(listed, keys, "words", size).select(*keys, "hash").join(mine, "hash").select(*keys, "item", "n").withColumn("size", F.lit(size)))
    candidates = found[0]
    for more in found[1:]:
        candidates = candidates.unionByName(more)
    # one row for a document and size, so its text is shingled once again, for all its candidates
    candidates = candidates.distinct().groupBy(*keys, "size").agg(F.collect_list(F.struct("item", "n")).alias("items"))
    on = [F.col(f"d.{k}").eqNullSafe(F.col(f"c.{k}")) for k in keys]
    near = texts.alias("d").join(candidates.alias("c"), on).select(
        *[F.col(f"d.{k}").alias(k) for k in keys], word_list(F.col("text")).alias("words"), "size", "items"
    )
    verified = []
    for size in sorted(sizes):
        places = shingled(near.filter(F.col("size") == size), [*keys, "items"], "words", size)
        wanted = shingles.filter(F.col("size") == size).select("hash", "shingle", "item")
        held = places.join(wanted, ["hash", "shingle"])
        held = held.withColumn("n", F.get(F.filter("items", lambda x: x["item"].eqNullSafe(F.col("item"))), F.lit(0))["n"]).filter("n is not null")
        verified.append(held.select(*keys, "item", "n", "shingle").distinct().groupBy(*keys, "item", "n").agg(F.count("*").cast("int").alias("n_found")))
    pairs = verified[0]
    for more in verified[1:]:
        pairs = pairs.unionByName(more)
    pairs = pairs.groupBy(*keys, F.col("item")["item_id"].alias("item_id"), F.col("n").alias("n_shingles")).agg(F.max("n_found").alias("n_found"))
    return pairs.withColumn("containment", F.col("n_found") / F.col("n_shingles")).filter(F.col("n_found") >= F.col("n_shingles") * threshold - 1e-9)


def contamination(docs: DataFrame, items: DataFrame, threshold: float = 0.8) -> DataFrame:
    """``doc_id``, ``item_id``, ``n_shingles``, ``n_found``, ``containment`` of each document that contains an item."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    return contained_items(rows.withColumn("of", F.xxhash64("text")), items, ["doc_id", "of"], threshold).drop("of")


def without_contaminated(docs: DataFrame, items: DataFrame, threshold: float = 0.8) -> DataFrame:
    """The documents that contain no item, with all their columns."""
    rows = packed(docs).withColumn("of", F.xxhash64("text"))
    bad = contained_items(rows, items, ["doc_id", "of"], threshold).select(F.col("doc_id").alias("bad_id"), F.col("of").alias("bad_of")).distinct()
    clean = rows.join(bad, F.col("doc_id").eqNullSafe(F.col("bad_id")) & (F.col("of") == F.col("bad_of")), "left_anti")
    return unpacked(clean, docs.columns)
