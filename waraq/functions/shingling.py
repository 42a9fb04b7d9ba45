"""Shingle hashes of whole texts in numpy, for Arrow passes: words are hashed once, shingles are combined from their words."""

from __future__ import annotations

import hashlib
import re

import numpy as np

_BASE, _MIX = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)
MEMO_WORDS = 500_000
#: White space as Python's str.split sees it.
_SPACES = re.compile(r"\s+")


def canonical(text: str) -> str:
    """What functions.text.canonical gives for a column."""
    return " ".join(text.lower().replace("ß", "ss").split())


def word_hash(word: str) -> int:
    return int.from_bytes(hashlib.blake2b(word.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "big")


class Shingler:
    """Distinct shingle hashes (uint64) of canonical texts; words are remembered between texts."""

    def __init__(self, size: int, unit: str):
        self.size, self.unit = size, unit
        self.memo: dict[str, int] = {}

    def __call__(self, text: str) -> np.ndarray:
        return np.unique(self._rolled(self._parts([canonical(text)])[0]))

    def windows(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(hashes, owner): all shingles of many canonical texts, repeated ones too, and the place in `texts` of the text of each."""
        parts, lengths = self._parts(texts)
        owner = np.repeat(np.arange(len(texts)), lengths)
        h = self._rolled(parts)
        inside = owner[: len(h)] == owner[self.size - 1 :][: len(h)]
        return h[inside], owner[: len(h)][inside]

    def _parts(self, texts: list[str]) -> tuple[np.ndarray, list[int]]:
        """What shingles are made of, of one text after the other, and how much of it is each text's."""
        if self.unit == "char":
            return np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64) * _MIX, [len(t) for t in texts]
        split = [t.split(" ") if t else [] for t in texts]
        if len(self.memo) > MEMO_WORDS:
            self.memo.clear()
        memo = self.memo
        for words in split:
            for w in words:
                if w not in memo:
                    memo[w] = word_hash(w)
        return np.fromiter((memo[w] for words in split for w in words), np.uint64), [len(words) for words in split]

    def _rolled(self, parts: np.ndarray) -> np.ndarray:
        n = len(parts) - self.size + 1
        if n <= 0:
            return np.empty(0, np.uint64)
        out = np.zeros(n, np.uint64)
        for i in range(self.size):
            out *= _BASE
            out += parts[i : i + n]
            out ^= out >> np.uint64(31)
        out *= _MIX
        out ^= out >> np.uint64(29)
        return out
