"""Toxicity: a weighted lexicon, found by Aho-Corasick in the folded text, normalised by length, with exception phrases.

Folding lowers case, drops accents and invisible signs, maps letters that look like Latin ones and digits or signs that stand
for letters, and leaves words of letters of any script; Chinese and Japanese signs are words of their own. A term is a whole word or the start of words; its weight is the log odds of documents that have it.
An exception phrase is a term with a neighbour that only clean documents hold; a term inside one counts nothing. A text's
raw score is the sum of the best weight of each word over the square root of its length; a logistic curve maps it to 0..1.

Lexicon, phrases and curve are learned from at most ``sample_rows`` labelled rows, taken by a hash of the id; every
document is scored whole, in time linear in its length but for the sorting of its exceptions. The model is at most ``max_terms`` terms and as many phrases, so it fits any task.

A null text is empty and gets the score of a text without terms; so does every text if no row is labelled. Equal
texts get equal scores. Equal hashes of labelled ids are taken by id, equal evidence of terms by term. Labels with a null id or verdict are not used. Other columns are not read.
"""

from __future__ import annotations

import math
import re
import unicodedata
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructType

from turnstone.llm.common import packed, texts_of, unpacked, written

HOMOGLYPHS = str.maketrans(
    "аіјеоорсухѕԁһкмтвнβαεικορτυνхʟıøłđæœßþ",
    "aijeoopcyxsdhkmtbhbaeikoptuvxlioldaosp",
)
SIGNS = {"@": "a", "$": "s", "!": "i", "+": "t", "|": "i"}
DIGITS = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "9": "g"}
_TABLE = bytes(
    ord(DIGITS.get(chr(b), chr(b) if "a" <= chr(b) <= "z" else " ")) if b < 128 else ord(" ") for b in range(256)
)
_DIGIT_LETTERS = str.maketrans(DIGITS)
_SIGN_INSIDE = re.compile(r"(?<=[a-z0-9])[!+|](?=[a-z0-9])|[@$](?=[a-z0-9])")
_DROPPED = regex.compile(r"[\u0300-\u036F\p{Cf}]+")
_NO_LETTER = regex.compile(r"[^\p{L}\p{M}]+")
_SIGN_WORD = regex.compile(r"[\p{Han}\p{Hiragana}\p{Katakana}]\p{M}*")
PREFIXES = range(4, 9)


def folded(text: str) -> str:
    """Words of letters, each with one blank or more before it, and one at the end."""
    text = text.lower()
    plain = text.isascii()
    if not plain:
        text = _DROPPED.sub("", unicodedata.normalize("NFKD", text.translate(HOMOGLYPHS)))
    if any(sign in text for sign in SIGNS):
        text = _SIGN_INSIDE.sub(lambda m: SIGNS[m[0]], text)
    if plain:
        return f" {text.encode().translate(_TABLE).decode()} "
    text = _NO_LETTER.sub(" ", text.translate(_DIGIT_LETTERS))
    return f" {_SIGN_WORD.sub(' \\g<0> ', text)} "


def words_in(text: str) -> list[str]:
    return folded(text).split()


def terms_in(words: list[str]) -> set[str]:
    """Words as `` word `` and their starts as `` sta``."""
    found = {f" {w} " for w in set(words)}
    for w in set(words):
        found.update(f" {w[:k]}" for k in PREFIXES if len(w) > k)
    return found


@dataclass
class Lexicon:
    weights: dict[str, float] = field(default_factory=dict)
    exceptions: list[str] = field(default_factory=list)
    slope: float = 0.0
    bias: float = -30.0

    def machine(self) -> ahocorasick.Automaton | None:
        patterns: dict[str, tuple[int, float | None]] = {t: (len(t), w) for t, w in self.weights.items()}
        patterns |= {f" {p} ": (len(p) + 2, None) for p in self.exceptions}
        if not patterns:
            return None
        machine = ahocorasick.Automaton()
        for pattern, value in patterns.items():
            machine.add_word(pattern, value)
        machine.make_automaton()
        return machine


def hits(machine: ahocorasick.Automaton | None, words: list[str]) -> dict[int, float]:
    """Best weight at each word's place in the joined text, without those inside exception phrases."""
    if machine is None or not words:
        return {}
    best: dict[int, float] = {}
    spared: list[tuple[int, int]] = []
    for end, (size, weight) in machine.iter(f" {' '.join(words)} "):
        start = end - size + 1
        if weight is None:
            spared.append((start, end))
        else:
            best[start] = max(weight, best.get(start, weight))
    if not spared:
        return best
    # one sweep over places and phrases, both in order; ``reach`` is how far the phrases begun so far go
    spared.sort()
    kept, reach, nth = {}, 0, 0
    for at in sorted(best):
        while nth < len(spared) and spared[nth][0] <= at:
            reach = max(reach, spared[nth][1])
            nth += 1
        if at >= reach:
            kept[at] = best[at]
    return kept


def raw_score(machine: ahocorasick.Automaton | None, words: list[str]) -> float:
    return sum(hits(machine, words).values()) / math.sqrt(len(words) + 20)


def train(
    docs: DataFrame, labels: DataFrame, sample_rows: int = 20_000, max_terms: int = 4_000, min_docs: int = 5,
    min_weight: float = 2.0, min_evidence: float = 12.0, extra_exceptions: tuple[str, ...] = (),
) -> Lexicon:
    """A lexicon from labelled documents. ``labels``: ``doc_id``, ``toxic``."""
    chosen = (
        labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic"))
        .dropna().groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
        .orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample_rows)
    )
    # at most sample_rows pairs of numbers go to every task; the documents stay where they are
    sample = written(texts_of(docs).join(F.broadcast(chosen), "doc_id").select("text", "toxic"), "labelled")
    sizes = {r["toxic"]: r["n"] for r in sample.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    bad, good = sizes.get(1, 0), sizes.get(0, 0)
    if not bad or not good:
        return Lexicon(exceptions=list(extra_exceptions), bias=30.0 if bad else -30.0)

    def count_terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts: tuple[Counter, Counter] = (Counter(), Counter())
            for text, toxic in zip(batch["text"].to_pylist(), batch["toxic"].to_pylist()):
                counts[1 if toxic else 0].update(terms_in(words_in(text)))
            terms = list(counts[0].keys() | counts[1].keys())
            yield pa.RecordBatch.from_arrays(
                [pa.array(terms, pa.string()), *(pa.array([c[t] for t in terms], pa.int64()) for c in counts)], ["term", "clean", "toxic"]
            )

    counted = sample.mapInArrow(count_terms, "term string, clean long, toxic long").groupBy("term").agg(
        F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic")
    )
    t, c = F.col("toxic"), F.col("clean")
    share = (t + c) / F.lit(bad + good)
    evidence = t * F.log(t / bad / share) + F.when(c > 0, c * F.log(c / good / share)).otherwise(0)
    weight = F.log((t + 0.5) / (bad + 1)) - F.log((c + 0.5) / (good + 1))
    kept = (
        counted.filter(t >= min_docs).withColumn("weight", weight).withColumn("evidence", evidence)
        .filter((F.col("weight") >= min_weight) & (F.col("evidence") >= min_evidence))
        .orderBy(F.desc("evidence"), "term").limit(max_terms)
    )
    lexicon = Lexicon({r["term"]: r["weight"] for r in kept.collect()}, list(extra_exceptions))
    lexicon.exceptions += learned_exceptions(sample, lexicon, max_terms, min_docs)
    machine_of = lexicon.machine

    def score_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = machine_of()
        for batch in batches:
            raw = [raw_score(machine, words_in(x)) for x in batch["text"].to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(raw, pa.float64()), batch["toxic"]], ["raw", "toxic"])

    # equal scores meet before they leave their task; at most sample_rows of them
    points = sample.mapInArrow(score_rows, "raw double, toxic int").groupBy("raw", "toxic").count().orderBy("raw", "toxic").collect()
    lexicon.slope, lexicon.bias = fit_curve(
        np.array([p["raw"] for p in points]), np.array([float(p["toxic"]) for p in points]), np.array([float(p["count"]) for p in points])
    )
    return lexicon


def learned_exceptions(sample: DataFrame, lexicon: Lexicon, most: int, min_docs: int) -> list[str]:
    """Two-word phrases around a term that several clean documents and no toxic one hold."""
    machine_of = lexicon.machine

    def phrases(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = machine_of()
        for batch in batches:
            rows = []
            for text, toxic in zip(batch["text"].to_pylist(), batch["toxic"].to_pylist()):
                words = words_in(text)
                places = hits(machine, words)
                if not places:
                    continue
                at, found = 0, set()
                for i, w in enumerate(words):
                    if at in places:
                        found.update(" ".join(p) for p in (words[max(0, i - 1) : i + 1], words[i : i + 2]) if len(p) == 2)
                    at += len(w) + 1
                rows += [(p, toxic) for p in found]
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.string()), pa.array([r[1] for r in rows], pa.int32())], ["phrase", "toxic"])

    counted = sample.mapInArrow(phrases, "phrase string, toxic int").groupBy("phrase").agg(
        F.sum("toxic").alias("toxic"), F.count("*").alias("n")
    )
    kept = counted.filter((F.col("toxic") == 0) & (F.col("n") >= min_docs)).orderBy(F.desc("n"), "phrase").limit(most)
    return [r["phrase"] for r in kept.collect()]


def fit_curve(x: np.ndarray, y: np.ndarray, n: np.ndarray, ridge: float = 0.01) -> tuple[float, float]:
    """Slope and bias of a logistic curve, by Newton steps on the weighted rows; the ridge bounds the slope."""
    a, b = 0.0, 0.0
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(a * x + b, -35, 35)))
        g = np.array([(n * (p - y) * x).sum() + ridge * a, (n * (p - y)).sum() + ridge * b])
        v = n * p * (1 - p)
        h = np.array([[(v * x * x).sum() + ridge, (v * x).sum()], [(v * x).sum(), v.sum() + ridge]])
        step = np.linalg.solve(h, g)
        step /= max(1.0, np.abs(step).max() / 5)
        a, b = a - step[0], b - step[1]
        if np.abs(step).max() < 1e-9:
            break
    return max(0.0, float(a)), float(b)


def score_documents(docs: DataFrame, lexicon: Lexicon, columns: str = "doc_id") -> DataFrame:
    """``columns`` of the documents (``doc_id``, or ``row`` from ``packed``) with ``score`` and ``predicted``."""
    rows = (packed(docs) if columns == "row" else texts_of(docs)).select(columns, "text")
    machine_of, slope, bias = lexicon.machine, lexicon.slope, lexicon.bias
    keep = rows.schema[columns].dataType

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = machine_of()
        for batch in batches:
            raw = np.array([raw_score(machine, words_in(x)) for x in batch["text"].to_pylist()], float)
            p = 1 / (1 + np.exp(-np.clip(slope * raw + bias, -700, 700)))
            yield pa.RecordBatch.from_arrays([batch[columns], pa.array(p, pa.float64())], [columns, "score"])

    scored = rows.mapInArrow(score, StructType().add(columns, keep).add("score", DoubleType()))
    return scored.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def without_toxic(docs: DataFrame, lexicon: Lexicon) -> DataFrame:
    """The documents that are not predicted toxic, with all their columns."""
    return unpacked(score_documents(docs, lexicon, "row").filter(F.col("predicted") == 0), docs.columns)
