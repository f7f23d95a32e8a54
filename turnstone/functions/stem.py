"""Porter (1980) stemming, for vocabularies.

Stemming runs over distinct terms, never over every token of every text.
"""

from __future__ import annotations

import re
import sys
from collections.abc import Iterator

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

# ship this small module with the tasks, so executors need no copy of the package
cloudpickle.register_pickle_by_value(sys.modules[__name__])

# fixed values: the suffix tables of the published algorithm
_STEP2 = {
    "ational": "ate", "tional": "tion", "enci": "ence", "anci": "ance", "izer": "ize",
    "logi": "log", "bli": "ble", "alli": "al", "entli": "ent", "eli": "e", "ousli": "ous",
    "ization": "ize", "ation": "ate", "ator": "ate", "alism": "al", "iveness": "ive",
    "fulness": "ful", "ousness": "ous", "aliti": "al", "iviti": "ive", "biliti": "ble",
}
_STEP3 = {
    "icate": "ic", "ative": "", "alize": "al", "iciti": "ic", "ical": "ic", "ful": "", "ness": "",
}
_STEP4 = dict.fromkeys(
    ["al", "ance", "ence", "er", "ic", "able", "ible", "ant", "ement", "ment", "ent", "ion", "ou",
     "ism", "ate", "iti", "ous", "ive", "ize"],
    "",
)
_SHORTEST, _LONGEST = 3, 64


_VOWELS = str.maketrans("aeiou", "vvvvv")
_CONSONANTS = re.compile("[^vy]")


def _shape(word: str) -> str:
    """v/c per letter; y is a vowel after a consonant."""
    shape = _CONSONANTS.sub("c", word.replace("v", "c").translate(_VOWELS))
    while "y" in shape:
        at = shape.index("y")
        shape = shape[:at] + ("v" if shape[at - 1 : at] == "c" else "c") + shape[at + 1 :]
    return shape


def _measure(word: str) -> int:
    return _shape(word).count("vc")


def _short_end(word: str) -> bool:
    """Ends consonant-vowel-consonant, the last not w, x or y."""
    return _shape(word).endswith("cvc") and word[-1] not in "wxy"


def _swap(word: str, table: dict[str, str], least: int) -> str:
    """Replace the longest listed suffix if what precedes it measures at least ``least``."""
    for size in range(min(7, len(word) - 1), 1, -1):
        if word[-size:] in table:
            head = word[:-size]
            if _measure(head) < least or (word.endswith("ion") and least > 1 and head[-1] not in "st"):
                return word
            return head + table[word[-size:]]
    return word


def _inflection(word: str) -> str:
    if len(word) > 3 and word.endswith(("sses", "ies")):
        word = word[:-2]
    elif word.endswith("s") and not word.endswith("ss"):
        word = word[:-1]

    if word.endswith("eed"):
        return word[:-1] if _measure(word[:-3]) > 0 else word
    for ending in ("ed", "ing"):
        head = word[: -len(ending)]
        if word.endswith(ending) and "v" in _shape(head):
            if head[-2:] in ("at", "bl", "iz"):
                return head + "e"
            if head[-1:] == head[-2:-1] and _shape(head)[-1] == "c" and head[-1] not in "lsz":
                return head[:-1]
            return head + "e" if _measure(head) == 1 and _short_end(head) else head
    return word


def _stem_bytes(word: str) -> str:
    word = _inflection(word)
    if word.endswith("y") and "v" in _shape(word[:-1]):
        word = word[:-1] + "i"
    word = _swap(word, _STEP2, 1)
    word = _swap(word, _STEP3, 1)
    word = _swap(word, _STEP4, 2)
    if word.endswith("e"):
        measure = _measure(word[:-1])
        if measure > 1 or (measure == 1 and not _short_end(word[:-1])):
            word = word[:-1]
    if word.endswith("ll") and _measure(word[:-1]) > 1:
        word = word[:-1]
    return word


def stem_word(term: str) -> str:
    """Stem of one folded term. Lengths count UTF-8 bytes; every non-ASCII byte is a consonant."""
    raw = term.encode()
    if not _SHORTEST <= len(raw) <= _LONGEST:
        return term
    return _stem_bytes(raw.decode("latin-1")).encode("latin-1").decode(errors="replace")


@F.pandas_udf(StringType())
def porter_stem(terms: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for batch in terms:
        yield batch.map(stem_word, na_action="ignore")
