"""Secret redaction: ordered rules compiled to chained ``regexp_replace`` columns.

Rules are written in Python's regex dialect. Spark evaluates Java's, so each rule is rewritten
once, on the driver, when the plan is built. A rule that cannot be carried over is an error and
never skipped, because redaction is what keeps secrets out of the store.
"""

from __future__ import annotations

import json
import re
from pathlib import Path
from typing import NamedTuple

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from .text import _c


class Rule(NamedTuple):
    pattern: str
    replacement: str


# fixed values: the built-in rule (three base64url segments) and the default replacement
BUILTIN_RULES = [
    Rule(
        r"eyJ[A-Za-z0-9_-]{10,}\.eyJ[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{20,}",
        "<JWT-REDACTED>",
    ),
]
DEFAULT_REPLACEMENT = "<REDACTED>"


def load_redaction_rules(paths: list[str], spark: SparkSession | None = None) -> list[Rule]:
    """Rules of all existing files, in the order given (environment, home, project).

    Files are the driver's own, or with ``spark`` those of any storage that Spark reads.

    Entries that are not usable objects are skipped. An invalid regex ends its own file: rules
    before it stay, rules after it are dropped.
    """
    rules: list[Rule] = []
    for path in paths:
        if spark is not None:
            where = spark._jvm.org.apache.hadoop.fs.Path(path)
            if where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where):
                rules += _rules_of("".join(r.value for r in spark.read.text(path, wholetext=True).collect()))
        elif Path(path).exists():
            try:
                rules += _rules_of(Path(path).read_text(encoding="utf-8"))
            except (OSError, ValueError):
                continue
    return rules


def _rules_of(text: str) -> list[Rule]:
    try:
        entries = json.loads(text)
    except ValueError:
        return []
    kept: list[Rule] = []
    for entry in entries if isinstance(entries, list) else []:
        if not isinstance(entry, dict):
            continue
        rule = Rule(entry.get("pattern"), entry.get("replacement", DEFAULT_REPLACEMENT))
        if not all(isinstance(field, str) for field in rule):
            continue
        try:
            re.compile(rule.pattern)
        except re.error:
            break
        kept.append(rule)
    return kept


def union_rules(custom: list[Rule], builtin: list[Rule] | None = None) -> list[Rule]:
    """Custom rules first, then the built-in ones."""
    return [Rule(*r) for r in custom] + (BUILTIN_RULES if builtin is None else builtin)


_UNPORTABLE = re.compile(r"\(\?\((?:\w+)\)|\(\?[aiLmsux]*[aL][aiLmsux]*[:)]")


def java_pattern(pattern: str) -> str:
    """Python regex -> Java regex with the same matches."""
    compiled = re.compile(pattern)  # raises for an invalid rule
    if _UNPORTABLE.search(pattern):
        raise ValueError(f"redaction rule has no Java counterpart: {pattern!r}")
    out, i, in_class = [], 0, False
    while i < len(pattern):
        ch = pattern[i]
        if ch == "\\":
            pair = pattern[i : i + 2]
            out.append(r"\z" if pair == r"\Z" and not in_class else pair)
            i += 2
            continue
        if in_class:
            if ch == "]" and not first:
                in_class = False
            elif ch in "[&" or (ch == "]" and first):
                out.append("\\")
            first = first and ch == "^" and pattern[i - 1] == "["
        elif ch == "[":
            in_class, first = True, True
        elif pattern.startswith("(?P<", i):
            out.append("(?<")
            i += 4
            continue
        elif pattern.startswith("(?P=", i):
            end = pattern.index(")", i)
            out.append(r"\k<" + pattern[i + 4 : end] + ">")
            i = end + 1
            continue
        elif ch == "{" and re.match(r"\{,\d+\}", pattern[i:]):
            out.append("{0")
            i += 1
            continue
        elif ch == "{" and not re.match(r"\{\d+(,\d*)?\}", pattern[i:]):
            out.append("\\")  # a brace that is no repetition is literal
        out.append(ch)
        i += 1
    bad = [n for n in compiled.groupindex if not re.fullmatch(r"[A-Za-z][A-Za-z0-9]*", n)]
    if bad:
        raise ValueError(f"group names {bad} have no Java counterpart: {pattern!r}")
    # U: \w \d \s \b are Unicode-aware; d: only \n ends a line
    return "(?Ud)" + "".join(out)


_TEMPLATE = re.compile(r"\\g<(\w+)>|\\([1-9]\d?)|\\(.)|([$])|([^\\$]+)", re.S)
# fixed values: the control escapes of a replacement template
_CONTROL = {"n": "\n", "t": "\t", "r": "\r", "a": "\a", "f": "\f", "v": "\v", "0": "\0"}


def java_replacement(template: str) -> str:
    """Python replacement template -> Java replacement string."""
    out, after_group = [], False
    for named, number, escaped, dollar, plain in _TEMPLATE.findall(template):
        group = named or number
        if group:
            out.append("$" + group if group.isdigit() else "${" + group + "}")
        elif escaped:
            out.append("\\\\" if escaped == "\\" else _CONTROL.get(escaped, "\\" + escaped))
        elif dollar:
            out.append("\\$")
        else:
            # a digit right after a group reference must not be read as part of it
            out.append("\\" + plain if after_group and plain[0].isdigit() else plain)
        after_group = bool(group)
    return "".join(out)


def redact(text, rules: list[Rule] | None = None) -> Column:
    """Apply ``rules`` in order; the built-in rules alone when none are given."""
    text = _c(text)
    for rule in BUILTIN_RULES if rules is None else rules:
        text = F.regexp_replace(
            text, F.lit(java_pattern(rule.pattern)), F.lit(java_replacement(rule.replacement))
        )
    return text
