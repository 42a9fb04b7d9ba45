"""A compressed FM-index in numpy: wavelet matrix, backward search and thresholded matching statistics.

The index holds a collection of pieces of documents. Its suffixes are sorted to a depth of at least
the threshold, which is all that backward search for patterns of that length needs. Bits are packed
in 64-bit words with a running count per word. Many pieces are searched in step, so that each step is
a handful of array operations.
"""

from __future__ import annotations

import numpy as np

_ONE = np.uint64(1)


class WaveletMatrix:
    """Rank of a symbol in a sequence, with n*log2(sigma) bits and a count for every 64 of them."""

    def __init__(self, codes: np.ndarray, bits: int):
        self.bits, n = bits, len(codes)
        self.words, self.counts, self.zeros = [], [], []
        for level in range(bits - 1, -1, -1):
            bit = (codes >> level & 1).astype(np.uint8)
            padded = np.zeros((n // 64 + 1) * 64, np.uint8)
            padded[:n] = bit
            words = np.packbits(padded, bitorder="little").view(np.uint64)
            counts = np.zeros(len(words), np.int64)
            np.cumsum(np.bitwise_count(words)[:-1], out=counts[1:])
            self.words.append(words)
            self.counts.append(counts)
            self.zeros.append(n - int(bit.sum()))
            codes = np.concatenate([codes[bit == 0], codes[bit == 1]])

    def ranks(self, symbols: np.ndarray, at: np.ndarray) -> np.ndarray:
        """How often each symbol stands before its place, plus where the symbol's block begins."""
        at = at.copy()
        for level in range(self.bits):
            word = at >> 6
            ones = self.counts[level][word] + np.bitwise_count(self.words[level][word] & ((_ONE << (at & 63).astype(np.uint64)) - _ONE))
            is_one = symbols >> (self.bits - 1 - level) & 1
            at = np.where(is_one, self.zeros[level] + ones, at - ones)
        return at


class FMIndex:
    """Index of pieces; owners[k] is the document of piece k."""

    def __init__(self, pieces: list[np.ndarray], owners: np.ndarray, depth: int):
        self.depth = depth
        lengths = np.array([len(p) for p in pieces], np.int64)
        self.starts = np.concatenate([[0], np.cumsum(lengths + 1)])[:-1]
        size = int((lengths + 1).sum())
        alphabet = np.unique(np.concatenate(pieces))
        reach = 1
        while reach < depth:
            reach *= 2
        text = np.zeros(size + 2 * reach, np.int64)
        owner = np.full(len(text), -1, np.int64)
        for start, piece, who in zip(self.starts, pieces, owners):
            text[start : start + len(piece)] = np.searchsorted(alphabet, piece) + 1
            owner[start : start + len(piece) + 1] = who
        self.text, self.lengths, self.owners = text, lengths, owners
        bits = int(len(alphabet)).bit_length()
        order, levels = self._sorted(text, bits, reach)
        self.order, self.owner = order, owner[order]
        self.lcp = self._common(text, order, levels)
        # the symbol before each suffix; a stable sort by it is the LF mapping
        self.before = WaveletMatrix(text[order - 1], bits)
        self.first = self._first(text, bits)
        n = len(order)
        change = np.flatnonzero(self.owner[1:] != self.owner[:-1]) + 1
        self.other = np.append(change, n)[np.searchsorted(change, np.arange(n), "right")]  # next suffix of another document
        bound = np.flatnonzero(np.append(self.lcp < depth, True))  # classes of suffixes with depth symbols in common
        cls = np.searchsorted(bound, np.arange(n), "right") - 1
        self.class_from, self.class_to = bound[cls], bound[cls + 1]
        self.smaller_before, self.smaller_after = _nearest_smaller(self.lcp)

    @staticmethod
    def _sorted(text: np.ndarray, bits: int, reach: int) -> tuple[np.ndarray, list[tuple[int, np.ndarray]]]:
        """Suffixes in order of their first `reach` symbols, and their ranks at each doubling."""
        n, width = len(text), 1
        key = text.copy()
        while 2 * width * bits <= 62 and width < reach:
            key = (key << (width * bits)) | np.append(key[width:], np.zeros(width, np.int64))
            width *= 2
        levels: list[tuple[int, np.ndarray]] = []
        while True:
            order = np.argsort(key, kind="stable")
            ordered = key[order]
            rank = np.empty(n, np.int64)
            rank[order] = np.append(0, np.cumsum(ordered[1:] != ordered[:-1]))
            levels.append((width, rank))
            if width >= reach:
                return order, levels
            key = rank * n + np.append(rank[width:], np.zeros(width, np.int64))
            width *= 2

    @staticmethod
    def _common(text: np.ndarray, order: np.ndarray, levels: list[tuple[int, np.ndarray]]) -> np.ndarray:
        """Symbols in common with the suffix before, as far as suffixes are sorted."""
        a, b = order[:-1], order[1:]
        last = len(text) - 1
        got = np.zeros(len(a), np.int64)
        for width, rank in reversed(levels):
            got += width * (rank[np.minimum(a + got, last)] == rank[np.minimum(b + got, last)])
        for _ in range(levels[0][0] - 1):
            got += text[np.minimum(a + got, last)] == text[np.minimum(b + got, last)]
        return np.append(0, got)

    def _first(self, text: np.ndarray, bits: int) -> np.ndarray:
        """Of each symbol: suffixes that begin with a smaller one, less what ranks() adds for its block."""
        symbols = np.arange(1 << bits)
        block = self.before.ranks(symbols, np.zeros(len(symbols), np.int64))
        smaller = np.concatenate([[0], np.cumsum(np.bincount(text, minlength=1 << bits))])[: 1 << bits]
        return smaller - block

    def shared_windows(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(piece, offset, class): each window of `depth` symbols that another document holds too.

        Every piece is streamed through the index from its end: the match grows to the left while some
        other document holds it, and otherwise falls back to the longest shorter one (the parent in the
        tree of common prefixes). The match is kept at `depth` symbols at most.
        """
        lane = np.flatnonzero(self.lengths >= self.depth)
        at = self.lengths[lane] - 1
        low, high, size = np.zeros(len(lane), np.int64), np.full(len(lane), len(self.order), np.int64), np.zeros(len(lane), np.int64)
        lcp = np.append(self.lcp, 0)
        found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        while len(lane):
            symbol = self.text[self.starts[lane] + at]
            both = self.before.ranks(np.concatenate([symbol, symbol]), np.concatenate([low, high]))
            shift = self.first[symbol]
            l2, h2 = both[: len(lane)] + shift, both[len(lane) :] + shift
            ok = h2 > l2
            ok[ok] = self.other[l2[ok]] < h2[ok]
            # no other document: the parent, or the next symbol where the match was empty
            kl, kh = lcp[low], lcp[high]
            k = np.where(kl >= kh, low, np.minimum(high, len(self.order) - 1))
            up, down = self.smaller_before[k], self.smaller_after[k]
            empty = ~ok & (size == 0)
            falls = ~ok & ~empty
            root = falls & (np.maximum(kl, kh) == 0)
            size = np.where(ok, size + 1, np.where(empty, 0, np.maximum(kl, kh)))
            low = np.where(ok, l2, np.where(empty, low, up))
            high = np.where(ok, h2, np.where(empty, high, down))
            low[root], high[root], size[root] = 0, len(self.order), 0
            full = ok & (size >= self.depth)
            if full.any():
                low[full], high[full] = self.class_from[low[full]], self.class_to[low[full]]
                size[full] = self.depth
                found.append((lane[full], at[full], low[full]))
            at = at - (ok | empty)
            live = (at >= 0) & (at + size + 1 >= self.depth)
            if not live.all():
                lane, at, low, high, size = lane[live], at[live], low[live], high[live], size[live]
        if not found:
            none = np.empty(0, np.int64)
            return none, none, none
        return tuple(np.concatenate(x) for x in zip(*found))

    def documents(self, cls: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(index into cls, document), each once."""
        sizes = self.class_to[cls] - cls
        which = np.repeat(np.arange(len(cls)), sizes)
        place = np.arange(len(which)) - np.repeat(np.cumsum(sizes) - sizes, sizes) + np.repeat(cls, sizes)
        pairs = np.unique(np.stack([which, self.owner[place]]), axis=1)
        return pairs[0], pairs[1]


def _nearest_smaller(a: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each place the nearest one before (else 0) and after (else the length) with a smaller value.

    Places whose neighbour isn't smaller follow that neighbour's own nearest, again and again.
    """
    n = len(a)

    def before(v: np.ndarray) -> np.ndarray:
        out = np.arange(-1, n - 1)
        open_ = np.flatnonzero((out >= 0) & (v[out] >= v))
        while len(open_):
            out[open_] = out[out[open_]]
            o = out[open_]
            open_ = open_[(o >= 0) & (v[o] >= v[open_])]
        return out

    left = before(a)
    right = n - 1 - before(a[::-1])[::-1]
    return np.maximum(left, 0), right
