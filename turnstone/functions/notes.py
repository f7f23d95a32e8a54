"""Weighted keyword search over short markdown notes, as column expressions."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import _c, rstrip, strip

# fixed values: field weights, excerpt rules
NAME_WEIGHT, TITLE_WEIGHT, BODY_WEIGHT = 5.0, 3.0, 1.0
EXCERPT_CHARS = 240
EXCERPT_MARK = " …"
MIN_PARAGRAPH = 30
ENOUGH_HITS = 3
SKIPPED_STARTS = ["---", "**Status**", "**Last verified**", "**Severity**"]
_LINE_BREAKS = r"\r\n|[\n\r\x0b\x0c\x1c\x1d\x1e\x85  ]"


def keyword_contains(text, keyword) -> Column:
    """Case-insensitive substring test."""
    keyword = keyword if isinstance(keyword, Column) else F.lit(keyword)
    return F.contains(F.lower(_c(text)), F.lower(keyword))


def extract_title(content, stem) -> Column:
    """First top-level heading, else the file stem."""
    lines = F.transform(F.split(_c(content), _LINE_BREAKS), strip)
    first = F.get(F.filter(lines, lambda line: line.startswith("# ")), F.lit(0))
    title = strip(F.ltrim(first, F.lit("# ")))
    return F.coalesce(F.nullif(title, F.lit("")), _c(stem))


def heading(content) -> Column:
    """The title without the fallback: ``""`` when there is no heading."""
    return extract_title(content, F.lit(""))


def keyword_score(keywords: list[str], stem, title, content) -> Column:
    """Sum over keywords, repeats counted again, of the weights of the fields that hold them."""
    total = F.lit(0.0)
    for keyword in keywords:
        for text, weight in ((stem, NAME_WEIGHT), (title, TITLE_WEIGHT), (content, BODY_WEIGHT)):
            total = total + F.when(keyword_contains(text, keyword), weight).otherwise(0.0)
    return total


def matched_keywords(keywords: list[str], stem, title, content) -> Column:
    found = [
        F.when(
            keyword_contains(stem, k) | keyword_contains(title, k) | keyword_contains(content, k),
            F.lit(k),
        )
        for k in sorted(set(keywords))
    ]
    return F.filter(F.array(*found), lambda k: k.isNotNull())


def _any_keyword(keywords: list[str]) -> str:
    quoted = (re.sub(r"([^\w\s])", r"\\\1", k) for k in keywords)
    return "(?iu)" + "|".join(quoted)


def best_excerpt(content, keywords: list[str], n: int = EXCERPT_CHARS) -> Column:
    """The paragraph with most keyword hits; the first to reach three ends the search."""
    paragraphs = F.transform(F.split(_c(content), "\n\n", -1), strip)

    def usable(p: Column) -> Column:
        ok = F.length(strip(F.ltrim(p, F.lit("#")))) >= MIN_PARAGRAPH
        for start in SKIPPED_STARTS:
            ok = ok & ~p.startswith(start)
        return ok

    pattern = F.lit(_any_keyword(keywords))
    rated = F.transform(
        F.filter(paragraphs, usable),
        lambda p, i: F.struct(
            F.least(F.regexp_count(p, pattern), F.lit(ENOUGH_HITS)).alias("hits"),
            (-i).alias("early"),
            p.alias("p"),
        ),
    )
    # counts of three and more are equal, so the earliest of them wins
    best = F.coalesce(F.array_max(rated)["p"], F.lit(""))
    cut = F.substring(best, 1, n)
    marked = F.when(F.length(best) > n, F.concat(rstrip(cut), F.lit(EXCERPT_MARK))).otherwise(cut)
    return strip(F.replace(marked, F.lit("\n"), F.lit(" ")))
