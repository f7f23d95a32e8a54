"""Token ids of whole texts, each distinct word encoded once per task.

Holds for tokenizers that never join characters across white space (all that drop it), such as word_bpe_49k: the ids of
a text are then those of its words, one after another. The library encodes the words; a task keeps what it has seen, as an
Arrow array that Arrow searches: no word that is known becomes a Python object.

Words of Latin letters with ASCII punctuation behind them are taken apart first where the tokenizer does so itself: lower
case, then runs of letters and runs of punctuation (``split_known``). The letters go straight to the library's merges, once for all
ways to write and to end a word. All other words, and all words of other tokenizers, pass the library as they are.
"""

from __future__ import annotations

import json
import os
import re
from collections.abc import Iterator
from functools import cache
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

KEPT_WORDS = 1_000_000  # about 35 MB; beyond it a worker starts over with an empty memory
CHUNK_WORDS = 1_000_000

# letters that NFC leaves alone beside one another, and whose lower case is one letter of the same kind
LETTERS = "".join(chr(c) for c in (*range(65, 91), *range(97, 123), *range(0xC0, 0xD7), *range(0xD8, 0xF7), *range(0xF8, 0x100)))
PUNCTUATION = "".join(chr(c) for c in (*range(33, 48), *range(58, 65), *range(91, 97), *range(123, 127)))
NORMALIZERS = [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]
PRE_TOKENIZERS = [
    {"type": "Split", "pattern": {"Regex": r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"}, "behavior": "Removed", "invert": True},
    {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
]


def split_known(config: dict) -> bool:
    """Whether a tokenizer lower-cases words and cuts them between letters and punctuation, and has no token of its own there."""
    steps = (config.get("normalizer") or {}).get("normalizers"), (config.get("pre_tokenizer") or {}).get("pretokenizers")
    inside = re.compile(f"[{LETTERS}]*[{re.escape(PUNCTUATION)}]*")
    return steps == (NORMALIZERS, PRE_TOKENIZERS) and not any(inside.fullmatch(t["content"]) for t in config["added_tokens"])


def byte_letters() -> dict[int, str]:
    """The letter that stands for each byte in a byte-level vocabulary; bytes that print stand for themselves."""
    printed = {*range(33, 127), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    others = [b for b in range(256) if b not in printed]
    return {b: chr(256 + k) for k, b in enumerate(others)}


BYTE_LETTERS = byte_letters()
LETTER_OF_BYTE = np.array([ord(BYTE_LETTERS.get(b, chr(b))) for b in range(256)], "<u4")
BETWEEN = BYTE_LETTERS[ord("\n")]


class WordTokenizer:
    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        if self.library.get_vocab_size() > 1 << 16:
            raise ValueError("ids beyond 16 bits")
        with open(path, encoding="utf-8") as file:
            self.splits = split_known(json.load(file))
        self._forget()

    def _forget(self) -> None:
        self.numbers = pa.array([""], pa.string())  # the words known, each at its number
        self.flat = np.empty(1 << 16, np.uint16)
        self.ends = np.zeros(2, np.int64)

    def _merged(self, words: pa.Array) -> list[list[int]]:
        """The ids of words of lower-case letters."""
        joined = pc.binary_join(pa.ListArray.from_arrays([0, len(words)], words), "\n")[0].as_buffer()
        letters = LETTER_OF_BYTE[np.frombuffer(joined, np.uint8)].tobytes().decode("utf-32-le").split(BETWEEN)
        merge = self.library.model.tokenize
        return [[t.id for t in merge(w)] for w in letters]

    def _numbers(self, letters: pa.Array, others: pa.Array) -> np.ndarray:
        """The numbers in the memory of distinct words, ``letters`` before ``others``; new ones are encoded first."""
        words = pa.concat_arrays([letters, others])
        found = pc.index_in(words, value_set=self.numbers)
        new = pc.is_null(found)
        fresh = np.flatnonzero(new.to_numpy(zero_copy_only=False))
        numbers = found.fill_null(0).to_numpy().astype(np.int64)
        if len(fresh):
            added = words.filter(new)
            merged = int(np.searchsorted(fresh, len(letters)))
            ids = self._merged(added.slice(0, merged)) if merged else []
            ids += [x.ids for x in self.library.encode_batch_fast(added.slice(merged).to_pylist(), add_special_tokens=False)]
            numbers[fresh] = np.arange(len(self.numbers), len(self.numbers) + len(fresh))
            self.numbers = pa.concat_arrays([self.numbers, added])
            used, ends = self.ends[-1], self.ends[-1] + np.cumsum(np.fromiter(map(len, ids), np.int64, len(ids)))
            if ends[-1] > len(self.flat):
                self.flat = np.concatenate([self.flat[:used], np.empty(int(ends[-1]) * 2 - used, np.uint16)])
            self.flat[used : ends[-1]] = np.fromiter(chain.from_iterable(ids), np.uint16, int(ends[-1] - used))
            self.ends = np.concatenate([self.ends, ends])
        return numbers

    def _kinds(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of distinct words, one word after another, and where each word's end."""
        ending = pc.utf8_ltrim(words, LETTERS)  # of a plain word, its punctuation
        plain = pc.equal(pc.binary_length(pc.ascii_ltrim(ending, PUNCTUATION)), 0) if self.splits else pa.repeat(False, len(words))
        is_plain = plain.to_numpy(zero_copy_only=False)
        lower = pc.utf8_lower(pc.ascii_rtrim(words.filter(plain), PUNCTUATION)).dictionary_encode()
        ending = ending.filter(plain).dictionary_encode()
        others = words.filter(pc.invert(plain))
        # no word is in two of the three, but the empty one, which is known from the start
        numbers = self._numbers(lower.dictionary, pa.concat_arrays([ending.dictionary, others]))
        of_lower, of_ending, of_others = np.split(numbers, np.cumsum([len(lower.dictionary), len(ending.dictionary)]))
        units = np.zeros((len(words), 2), np.int64)
        units[is_plain, 0] = of_lower[lower.indices.to_numpy()]
        units[is_plain, 1] = of_ending[ending.indices.to_numpy()]
        units[~is_plain, 0] = of_others
        ids, ends = gathered(self.flat, self.ends, units.ravel())
        return ids, ends[::2]

    def encode(self, texts: list[str] | pa.Array) -> Iterator[np.ndarray]:
        """The ids of each text, as unsigned 16-bit numbers."""
        texts = texts if isinstance(texts, pa.Array) else pa.array(texts, pa.string())
        split = pc.ascii_split_whitespace(texts)
        words, ends = split.flatten(), split.offsets.to_numpy().astype(np.int64)
        ends -= ends[0]
        at = 0
        while at < len(texts):
            to = max(at + 1, int(np.searchsorted(ends, ends[at] + CHUNK_WORDS, side="right")) - 1)
            kinds = words.slice(ends[at], ends[to] - ends[at]).dictionary_encode()
            ids, cuts = gathered(*self._kinds(kinds.dictionary), kinds.indices.to_numpy())
            yield from np.split(ids, cuts[ends[at + 1 : to] - ends[at]])
            if len(self.numbers) > KEPT_WORDS:
                self._forget()
            at = to


def gathered(flat: np.ndarray, ends: np.ndarray, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The runs named by ``which``, one after another, and where each begins, with the end; run k is ``flat[ends[k]:ends[k + 1]]``."""
    lengths = np.diff(ends)[which]
    places = np.concatenate([[0], np.cumsum(lengths)])
    at = np.repeat((ends[which] - places[:-1]).astype(np.int32), lengths)  # Arrow's strings, and so their ids, are below 2^31
    at += np.arange(places[-1], dtype=np.int32)
    return flat[at], places


@cache
def tokenizer(path: str) -> WordTokenizer:
    """One for each Python worker."""
    return WordTokenizer(path)


def public_tokenizer(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)
