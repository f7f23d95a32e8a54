"""Search conditions: terms, phrases and prefixes combined with ``& | ~``.

    term("schema") | (phrase("database schema") & ~prefix("arch"))

A condition is compiled to boolean columns over a normalised text; nothing is parsed.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.stem import porter_stem, stem_word
from ..functions.tokens import query_tokens


class Condition:
    def __and__(self, other: "Condition") -> "Condition":
        return Both(self, other)

    def __or__(self, other: "Condition") -> "Condition":
        return Either(self, other)

    def __invert__(self) -> "Condition":
        return Without(self)

    def phrases(self) -> list["Phrase"]:
        raise NotImplementedError

    def holds(self, present: dict[int, Column]) -> Column:
        """Whether a text matches; ``present`` tells by phrase identity which phrases occur."""
        raise NotImplementedError

    def counting(self, present: dict[int, Column], gate: Column) -> dict[int, Column]:
        """Which phrases add to the score: those in the parts of the condition that hold."""
        raise NotImplementedError


@dataclass(eq=False)
class Phrase(Condition):
    terms: list[str]
    is_prefix: bool = False

    def phrases(self):
        return [self]

    def holds(self, present):
        return present[id(self)]

    def counting(self, present, gate):
        return {id(self): gate & present[id(self)]}


@dataclass(eq=False)
class Both(Condition):
    left: Condition
    right: Condition

    def phrases(self):
        return self.left.phrases() + self.right.phrases()

    def holds(self, present):
        return self.left.holds(present) & self.right.holds(present)

    def counting(self, present, gate):
        gate = gate & self.holds(present)
        return {**self.left.counting(present, gate), **self.right.counting(present, gate)}


@dataclass(eq=False)
class Either(Condition):
    left: Condition
    right: Condition

    def phrases(self):
        return self.left.phrases() + self.right.phrases()

    def holds(self, present):
        return self.left.holds(present) | self.right.holds(present)

    def counting(self, present, gate):
        return {**self.left.counting(present, gate), **self.right.counting(present, gate)}


@dataclass(eq=False)
class Without(Condition):
    inner: Condition

    def phrases(self):
        return self.inner.phrases()

    def holds(self, present):
        return ~self.inner.holds(present)

    def counting(self, present, gate):
        return self.inner.counting(present, F.lit(False))


def _tokens(text: str) -> list[str]:
    tokens = query_tokens(text)
    if not tokens:
        raise ValueError(f"no searchable token in {text!r}")
    return tokens


def term(text: str) -> Condition:
    """One word. A text of several tokens (``saved_reports``) is a phrase of them."""
    return Phrase(_tokens(text))


def phrase(text: str) -> Condition:
    """Adjacent tokens."""
    return Phrase(_tokens(text))


def prefix(text: str) -> Condition:
    """The last token is only the start of a word."""
    return Phrase(_tokens(text), is_prefix=True)


def distinct_phrases(condition: Condition) -> list[Phrase]:
    """Phrases in order. The same object used twice is one phrase."""
    return list({id(p): p for p in condition.phrases()}.values())


class Matcher:
    """Columns that find a condition's phrases in the ``norm`` column of ``docs``.

    Unstemmed terms become literals. Stemmed terms become the words of the vocabulary that share
    the stem: one row, looked up once per search, whose patterns are literals as well and so are
    compiled once. A stem differs from its words by a finite list of suffixes, so the
    alternatives stay few however large the vocabulary is.
    """

    def __init__(self, docs: DataFrame, condition: Condition, stemmed: bool):
        self.condition = condition
        self.phrases = distinct_phrases(condition)
        self.stemmed = stemmed
        self.docs = docs
        if stemmed:
            self.words = _word_patterns(docs, self.phrases).first()["words"]

    def _word(self, number: int, place: int) -> str:
        """Regex of the words a term stands for."""
        found = self.phrases[number]
        if self.stemmed:
            return self.words[f"w{number}_{place}"]
        last = found.is_prefix and place == len(found.terms) - 1
        return found.terms[place] + ("[^ ]*" if last else "")

    def pattern(self, number: int) -> Column:
        """Regex of a phrase. Only its first word is consumed, so overlapping places all count."""
        first, *rest = [self._word(number, k) for k in range(len(self.phrases[number].terms))]
        return F.lit(f" {first}(?= {''.join(f'{w} ' for w in rest)})")

    def present(self, number: int) -> Column:
        found = self.phrases[number]
        if self.stemmed:
            # the start of the stem rules most texts out without a regex
            return self._may_hold(number) & F.regexp_like("norm", self.pattern(number))
        literal = " " + " ".join(found.terms) + ("" if found.is_prefix else " ")
        return F.contains("norm", F.lit(literal))

    def _may_hold(self, number: int) -> Column:
        """Whether the text has, for each term of the phrase, a word with the start of its stem."""
        held = F.lit(True)
        for word in dict.fromkeys(self.phrases[number].terms):
            held = held & F.contains("norm", F.lit(f" {_stem_start(stem_word(word))}"))
        return held

    def occurrences(self, number: int) -> Column:
        return F.regexp_count("norm", self.pattern(number))

    def by_phrase(self, columns: list[Column]) -> dict[int, Column]:
        return {id(p): c for p, c in zip(self.phrases, columns)}

    def blank_before(self, number: int) -> Column:
        """Regex of the blank in front of every place of a phrase."""
        words = [self._word(number, k) for k in range(len(self.phrases[number].terms))]
        return F.lit(f" (?={''.join(f'{w} ' for w in words)})")


# characters of a stem's end that may differ from the words it stands for
STEM_TAIL = 2


def _stem_start(stem: str) -> str:
    """What all words with the stem start with."""
    return stem[: max(1, len(stem) - STEM_TAIL)]


def _word_patterns(docs: DataFrame, phrases: list[Phrase]) -> DataFrame:
    """One row, one struct: for every term the regex of the words sharing its stem."""
    wanted = {}
    for number, found in enumerate(phrases):
        for place, word in enumerate(found.terms):
            last = found.is_prefix and place == len(found.terms) - 1
            wanted[f"w{number}_{place}"] = (stem_word(word), last)
    starts = "|".join(sorted({_stem_start(stem) for stem, _ in wanted.values()}))
    vocabulary = (
        docs.select(F.explode(F.regexp_extract_all("norm", F.lit(f" ((?:{starts})[^ ]*)"), F.lit(1))).alias("word"))
        .groupBy("word")
        .agg(F.count("*").alias("uses"))
        .withColumn("stem", porter_stem("word"))
        # reading the count keeps the grouping below the stemming: without it the optimizer drops
        # the grouping, as a set needs none, and every use of a word would be stemmed
        .filter("uses > 0")
    )
    columns = []
    for name, (stem, is_prefix) in wanted.items():
        if not is_prefix:
            words = F.collect_set(F.when(F.col("stem") == stem, F.col("word")))
            columns.append(F.concat(F.lit("(?:"), _any_of(words), F.lit(")")).alias(name))
            continue
        # every word with the start, but for those whose stem is shorter than it, and the few
        # words whose stem has the start though they do not
        by_stem, by_word = F.startswith("stem", F.lit(stem)), F.startswith("word", F.lit(stem))
        extra = F.collect_set(F.when(by_stem & ~by_word, F.col("word")))
        lost = F.collect_set(F.when(by_word & ~by_stem, F.col("word")))
        columns.append(
            F.concat(
                F.lit("(?:(?!(?:"), _any_of(lost), F.lit(f")(?: |$)){stem}[^ ]*|"), _any_of(extra), F.lit(")")
            ).alias(name)
        )
    return vocabulary.agg(F.struct(*columns).alias("words"))


def _any_of(words: Column) -> Column:
    """Alternatives, or a regex that never matches."""
    return F.when(F.size(words) > 0, F.array_join(F.array_sort(words), "|")).otherwise(F.lit("(?!)"))
