"""URL filter: all wildcard rules at once by a bit-parallel automaton (Shift-And over several machine words).

A glob is read left to right: ``*`` stands for any run without ``/``, ``**`` for any run, ``?`` for one character but
``/``; everything else for itself. Each literal of each glob owns one bit. A bit moves on when the next byte is its
successor's literal and stays when a wildcard follows it, so one shift, two masks and one OR advance every glob over
every URL of a batch.

A null or malformed URL has an empty host and path; no rule fits it and it gets the default verdict. Equal URLs get
equal results. Rules of equal length are told apart by their place, the later one wins. The compiled masks are the
rules' size, which the caller gives; nothing that grows with the URLs leaves its task.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from turnstone.llm.common import lower_ascii, ready

SLASH = ord("/")


@dataclass(frozen=True)
class Rule:
    """``site`` is a host and the start of a path, such as ``example.com/en/``; it holds for all subdomains."""

    verdict: str
    site: str

    @property
    def glob(self) -> str:
        return f"*.{self.site}**"


@dataclass(frozen=True)
class Automaton:
    """Masks of all globs: ``step[byte]`` for bits that are reached, ``stay[byte]`` for bits that may stay."""

    step: np.ndarray
    stay: np.ndarray
    first: np.ndarray
    accept: list[tuple[int, int]]  # word and bit of each glob's end

    @staticmethod
    def of(globs: list[str]) -> Automaton:
        bits: list[tuple[str, object]] = []  # of each bit: how it is reached
        loops: dict[int, str] = {}
        starts, ends = [], []
        for glob in globs:
            starts.append(len(bits))
            bits.append(("start", None))
            data, at = glob.encode(), 0
            while at < len(data):
                if data[at : at + 2] == b"**":
                    loops[len(bits) - 1] = "any"
                    at += 2
                    continue
                if data[at : at + 1] == b"*":
                    loops.setdefault(len(bits) - 1, "segment")
                elif data[at : at + 1] == b"?":
                    bits.append(("one", None))
                else:
                    bits.append(("byte", data[at]))
                at += 1
            ends.append(len(bits) - 1)
        words = max(1, -(-len(bits) // 64))
        step, stay = np.zeros((256, words), np.uint64), np.zeros((256, words), np.uint64)
        first = np.zeros(words, np.uint64)
        for bit, (kind, value) in enumerate(bits):
            word, mask = bit // 64, np.uint64(1 << bit % 64)
            for byte in range(256):
                inner = 0x80 <= byte <= 0xBF  # the later bytes of a character
                if kind == "byte" and byte == value or kind == "one" and not inner and byte != SLASH:
                    step[byte, word] |= mask
                loop = loops.get(bit)
                if loop == "any" or loop == "segment" and byte != SLASH or kind == "one" and inner:
                    stay[byte, word] |= mask
        for bit in starts:
            first[bit // 64] |= np.uint64(1 << bit % 64)
        return Automaton(step, stay, first, [(b // 64, b % 64) for b in ends])

    def ends(self, data: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """Bits of each text after its last byte; the texts lie one after another in ``data``."""
        order = np.argsort(-lengths, kind="stable")
        starts, lengths = starts[order], lengths[order]
        state = np.repeat(self.first[None, :], len(order), axis=0)
        one, top = np.uint64(1), np.uint64(63)
        active = len(order)
        for at in range(int(lengths[0]) if len(order) else 0):
            active = int(np.searchsorted(-lengths[:active], -at, side="left"))  # texts longer than at
            now, byte = state[:active], data[starts[:active] + at]
            moved = now << one
            moved[:, 1:] |= now[:, :-1] >> top
            state[:active] = (moved & self.step[byte]) | (now & self.stay[byte])
        out = np.empty_like(state)
        out[order] = state
        return out


def host_of(url: Column) -> Column:
    return lower_ascii(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def judge_urls(pages: DataFrame, rules: list[Rule], default: str = "allow", key: str = "page_id", url: str = "url") -> DataFrame:
    """``key``, host, path, the longest rule that fits, and its verdict, of every page."""
    ready(pages.sparkSession)
    found = pages.select(F.col(key).alias("key"), host_of(F.col(url)).alias("host"), path_of(F.col(url)).alias("path"))
    if not rules:
        return found.select(F.col("key").alias(key), "host", "path", F.lit(None).cast("string").alias("rule"), F.lit(default).alias("verdict"))
    machine = Automaton.of([r.glob for r in rules])
    ranked = sorted(range(len(rules)), key=lambda i: (len(rules[i].site), i))
    key_type = found.schema["key"].dataType.simpleString()

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lines = [b"." + h.encode() + p.encode() for h, p in zip(batch["host"].to_pylist(), batch["path"].to_pylist())]
            lengths = np.fromiter(map(len, lines), np.int64, len(lines))
            ends = machine.ends(np.frombuffer(b"".join(lines), np.uint8), np.cumsum(lengths) - lengths, lengths)
            best = np.full(len(lines), -1)
            for i in ranked:
                word, bit = machine.accept[i]
                best[(ends[:, word] >> np.uint64(bit)) & np.uint64(1) == 1] = i
            rule = [rules[i] if i >= 0 else None for i in best]
            yield pa.RecordBatch.from_arrays(
                [batch["key"], batch["host"], batch["path"], pa.array([r and r.site for r in rule], pa.string()),
                 pa.array([r.verdict if r else default for r in rule], pa.string())],
                ["key", "host", "path", "rule", "verdict"],
            )

    judged = found.mapInArrow(judge, f"key {key_type}, host string, path string, rule string, verdict string")
    return judged.withColumnRenamed("key", key)
