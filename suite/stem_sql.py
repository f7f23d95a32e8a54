"""Porter's steps as SQL over a table ``vocabulary(word)``: common table expressions up to ``stems(word, stem)``."""

from __future__ import annotations

from turnstone.functions.stem import _STEP2, _STEP3, _STEP4

# letter shapes: y is a vowel behind a consonant; at a word's start it is written Y, which is none
CONSONANTS, VOWELS = "[^aeiou][^aeiouy]*", "[aeiouy][aeiou]*"
SOME = f"^({CONSONANTS})?{VOWELS}{CONSONANTS}"
ONE = f"^({CONSONANTS})?{VOWELS}{CONSONANTS}({VOWELS})?$"
MORE = f"^({CONSONANTS})?({VOWELS}{CONSONANTS}){{2}}"
VOWEL = f"^({CONSONANTS})?[aeiouy]"
SHORT = f"^{CONSONANTS}[aeiouy][^aeiouwxy]$"


def has(text: str, shape: str) -> str:
    return f"regexp_matches({text}, '{shape}')"


def head(n: int) -> str:
    return f"left(w, length(w) - {n})"


def swapped(table: dict[str, str], shape: str) -> str:
    cases = []
    for suffix in sorted(table, key=len, reverse=True):
        before = head(len(suffix))
        fits = has(before, shape) + (f" AND right({before}, 1) IN ('s', 't')" if suffix == "ion" else "")
        cases.append(f"WHEN ends_with(w, '{suffix}') AND length(w) > {len(suffix)} THEN CASE WHEN {fits} THEN {before} || '{table[suffix]}' ELSE w END")
    return f"CASE {' '.join(cases)} ELSE w END"


def mended(n: int) -> str:
    """What is left when an ending of n letters goes."""
    h = head(n)
    double = f"length({h}) > 1 AND right({h}, 1) = left(right({h}, 2), 1) AND right({h}, 1) NOT IN ('a', 'e', 'i', 'o', 'u', 'y', 'l', 's', 'z')"
    return f"""CASE WHEN right({h}, 2) IN ('at', 'bl', 'iz') THEN {h} || 'e' WHEN {double} THEN left({h}, length({h}) - 1)
        WHEN {has(h, ONE)} AND {has(h, SHORT)} THEN {h} || 'e' ELSE {h} END"""


STEPS = [
    f"""CASE WHEN length(w) > 3 AND (ends_with(w, 'sses') OR ends_with(w, 'ies')) THEN {head(2)}
        WHEN ends_with(w, 's') AND NOT ends_with(w, 'ss') THEN {head(1)} ELSE w END""",
    f"""CASE WHEN ends_with(w, 'eed') THEN CASE WHEN {has(head(3), SOME)} THEN {head(1)} ELSE w END
        WHEN ends_with(w, 'ed') AND {has(head(2), VOWEL)} THEN {mended(2)}
        WHEN ends_with(w, 'ing') AND {has(head(3), VOWEL)} THEN {mended(3)} ELSE w END""",
    f"CASE WHEN ends_with(w, 'y') AND {has(head(1), VOWEL)} THEN {head(1)} || 'i' ELSE w END",
    swapped(_STEP2, SOME),
    swapped(_STEP3, SOME),
    swapped(_STEP4, MORE),
    f"""CASE WHEN ends_with(w, 'e') AND ({has(head(1), MORE)} OR {has(head(1), ONE)} AND NOT {has(head(1), SHORT)})
        THEN {head(1)} ELSE w END""",
    f"CASE WHEN ends_with(w, 'll') AND {has(head(1), MORE)} THEN {head(1)} ELSE w END",
]
_NAMES = [f"step{k}" for k in range(len(STEPS) + 1)]
STEMS = ", ".join(
    [f"{_NAMES[0]} AS (SELECT word, regexp_replace(word, '^y', 'Y') AS w FROM vocabulary WHERE strlen(word) BETWEEN 3 AND 64)"]
    + [f"{new} AS (SELECT word, {step} AS w FROM {old})" for old, new, step in zip(_NAMES, _NAMES[1:], STEPS)]
    + [f"stems AS (SELECT word, coalesce(regexp_replace(w, '^Y', 'y'), word) AS stem FROM vocabulary LEFT JOIN {_NAMES[-1]} USING (word))"]
)
