"""A short window of a text around its hits, built from token positions.

Only the few winning rows of a search pass through here. The work per row grows linearly with its
text.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import _c
from .tokens import token_pattern

# fixed values: window size, hit marks, cut mark, preference for sentence starts
WINDOW = 12
OPEN, CLOSE, CUT = "«", "»", "…"
NEW_PHRASE, REPEAT = 1000, 1
TEXT_START, SENTENCE_START = 120, 100

_FLAG = "\x01"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` with ``value`` evaluated once, also where ``body`` uses it inside lambdas."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _flagged(norm: Column, pattern: Column) -> Column:
    """Tokens, those at which the pattern starts carrying a flag."""
    return F.array_remove(F.split(F.regexp_replace(norm, pattern, F.lit(" " + _FLAG)), " "), "")


def _hits_at(norm: Column, phrases: list[tuple[Column, Column, int]]) -> Column:
    """Per token the phrases that start there, as (start, phrase number, end)."""
    flagged = F.arrays_zip(*[_flagged(norm, p).alias(f"t{k}") for k, (_, p, _) in enumerate(phrases)])

    def here(tokens: Column, i: Column) -> Column:
        found = [
            F.when(
                counts & F.startswith(tokens[f"t{k}"], F.lit(_FLAG)),
                F.struct(i.alias("s"), F.lit(k).alias("p"), (i + (size - 1)).alias("e")),
            )
            for k, (counts, _, size) in enumerate(phrases)
        ]
        return F.filter(F.array(*found), lambda h: h.isNotNull())

    return F.transform(flagged, here)


def _worth(found: Column) -> Column:
    kinds = F.size(F.array_distinct(F.transform(found, lambda h: h["p"])))
    return kinds * (NEW_PHRASE - REPEAT) + F.size(found) * REPEAT


def _window(at: Column, start: Column, n: int) -> Column:
    return F.flatten(F.slice(at, start + 1, F.lit(n)))


def _centred(found: Column, n_tokens: Column, n: int) -> Column:
    first = F.get(found, F.lit(0))["s"]
    span = F.element_at(found, -1)["e"] + 1 - first
    half = ((F.lit(n) - span) / 2).cast("int")  # towards zero
    return F.greatest(F.least(first - half, n_tokens - n), F.lit(0))


def _candidate(worth: Column, early: Column, start: Column) -> Column:
    return F.struct(worth.alias("worth"), early.alias("early"), start.alias("start"))


def _best_start(at: Column, sentences: Column, n: int) -> Column:
    """Window with the most distinct phrases, then hits, then the earliest; a window from the start
    of a hit's sentence is preferred to one centred on the hit."""
    n_tokens = F.size(at)

    def around(here: Column, i: Column) -> Column:
        centred = let(
            _window(at, i, n), lambda found: _candidate(_worth(found), -2 * i, _centred(found, n_tokens, n))
        )
        return F.when(F.size(here) > 0, centred)

    def from_sentence(start: Column, k: Column) -> Column:
        next_start = F.coalesce(F.get(sentences, k + 1), n_tokens)
        inside = F.flatten(F.slice(at, start + 2, next_start - start - 1))
        bonus = F.when(start == 0, TEXT_START).otherwise(SENTENCE_START)
        return let(
            F.get(inside, F.lit(0))["s"],
            lambda hit: F.when(
                hit.isNotNull() & (n_tokens > n),
                _candidate(_worth(_window(at, start, n)) + bonus, -2 * hit - 1, start),
            ),
        )

    both = F.concat(F.transform(at, around), F.transform(sentences, from_sentence))
    return F.coalesce(F.array_max(both)["start"], F.lit(0))


def _render(shown: Column, gaps: Column, at: Column, begin: Column, n: int) -> Column:
    n_tokens = F.size(at)
    end = F.least(begin + n, n_tokens) - 1

    def piece(hits: Column, i: Column) -> Column:
        own = F.filter(hits, lambda h: (h["s"] <= i) & (i <= h["e"]))
        opens = (F.size(own) > 0) & ~F.exists(own, lambda h: h["s"] < i)
        closes = (F.size(own) > 0) & ((i == end) | ~F.exists(own, lambda h: i < h["e"]))
        return F.concat(
            F.when(i > begin, F.get(gaps, i)).otherwise(F.lit("")),
            F.when(opens, F.lit(OPEN)).otherwise(F.lit("")),
            F.get(shown, i),
            F.when(closes, F.lit(CLOSE)).otherwise(F.lit("")),
        )

    body = let(
        _window(at, begin, n),
        lambda hits: F.array_join(F.transform(F.sequence(begin, end), lambda i: piece(hits, i)), ""),
    )
    return F.concat(
        F.when(begin > 0, F.lit(CUT)).otherwise(F.get(gaps, F.lit(0))),
        body,
        F.when(begin + n < n_tokens, F.lit(CUT)).otherwise(F.element_at(gaps, -1)),
    )


def snippet(content, norm, phrases: list[tuple[Column, Column, int]], n: int = WINDOW) -> Column:
    """Best window of at most ``n`` tokens of ``content`` with its hits marked.

    ``phrases`` holds, per phrase, whether it counts in this row, the regex of the blank in
    ``norm`` before each of its places, and its number of terms.
    """
    content, norm = _c(content), _c(norm)
    shown = F.regexp_extract_all(content, F.lit(token_pattern()), F.lit(0))
    gaps = F.split(content, token_pattern(), -1)

    def starts(gaps: Column) -> Column:
        indexed = F.transform(
            gaps, lambda gap, i: F.when((i == 0) | gap.rlike(r"[.:][ \t\n\r]+$"), i)
        )
        return F.filter(indexed, lambda i: i.isNotNull() & (i < F.size(gaps) - 1))

    def window(at: Column, gaps: Column) -> Column:
        begin = let(starts(gaps), lambda sentences: _best_start(at, sentences, n))
        return let(begin, lambda b: let(shown, lambda s: _render(s, gaps, at, b, n)))

    marked = let(_hits_at(norm, phrases), lambda at: let(gaps, lambda g: window(at, g)))
    return F.when(F.size(shown) > 0, marked).otherwise(content)
