"""Tokens: lower-case, Latin diacritics folded, split on everything that is no letter or digit.

A text is normalised into one string, `` tok tok tok `` with single blanks around every token.
Term and phrase tests become plain substring and regex tests on it, which Spark compiles; an array
of tokens is only built where positions are needed.
"""

from __future__ import annotations

import unicodedata
from functools import cache

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import _c

# letters, digits, private use; a combining mark inside a token belongs to it
_TOKEN_CLASS = r"\p{L}\p{N}\p{Co}"


@cache
def _folding() -> tuple[str, str, str]:
    """(accented letters, their ASCII letters, combining marks), by rule.

    A letter folds when it decomposes into one ASCII letter and one mark; letters with several
    marks and letters such as ß, ø, œ, đ, ł keep their form.
    """
    letters, plain, marks = [], [], set()
    for code in (*range(0xC0, 0x250), *range(0x1E00, 0x1F00)):
        parts = unicodedata.normalize("NFD", chr(code))
        if len(parts) == 2 and parts[0].isascii():
            marks.add(parts[1])
            if chr(code).islower():
                letters.append(chr(code))
                plain.append(parts[0])
    # the long s is a case form of s
    return "".join(letters) + "ſ", "".join(plain) + "s", "".join(sorted(marks))


def token_pattern() -> str:
    """One token in an unfolded text."""
    return f"[{_TOKEN_CLASS}][{_TOKEN_CLASS}{_folding()[2]}]*"


def _is_ascii(text: Column) -> Column:
    return F.octet_length(text) == F.length(text)


def _fold(text: Column) -> Column:
    letters, plain, marks = _folding()
    # characters of `matching` beyond the length of `replace` are deleted
    return F.translate(F.lower(F.replace(text, F.lit("İ"), F.lit("i"))), letters + marks, plain)


def fold_text(text) -> Column:
    """Lower-case without Latin diacritics. Pure ASCII takes the short way."""
    text = _c(text)
    return F.when(_is_ascii(text), F.lower(text)).otherwise(_fold(text))


def normalized(text) -> Column:
    text = _c(text)

    def spaced(folded: Column, others: str) -> Column:
        return F.regexp_replace(F.concat(F.lit(" "), folded, F.lit(" ")), others, " ")

    return F.when(_is_ascii(text), spaced(F.lower(text), "[^a-z0-9]+")).otherwise(
        spaced(_fold(text), f"[^{_TOKEN_CLASS}]+")
    )


def doc_length(norm) -> Column:
    """Number of tokens of a normalised text."""
    norm = _c(norm)
    return (F.length(norm) - F.length(F.replace(norm, F.lit(" "))) - 1).cast("bigint")


def split_norm(norm) -> Column:
    return F.array_remove(F.split(_c(norm), " "), "")


def tokenize(text) -> Column:
    return split_norm(normalized(text))


def query_tokens(text: str) -> list[str]:
    """The tokens of a short query text, on the driver, by the same rules."""
    letters, plain, marks = _folding()
    table = str.maketrans(letters, plain, marks)
    folded = text.replace("İ", "i").lower().translate(table)
    kept = (c if unicodedata.category(c)[0] in "LN" or unicodedata.category(c) == "Co" else " " for c in folded)
    return "".join(kept).split()
