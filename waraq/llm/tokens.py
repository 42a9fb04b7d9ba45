"""Problem 8: encoding of the whole corpus with a public byte-level BPE tokenizer.

The text is cut into pieces by the tokenizer's pattern. A piece's bytes are mapped to Latin-1 and run
through an Aho-Corasick automaton of the vocabulary, which gives every token at every place in one
pass. From the left, the longest token that is compatible with its predecessor is taken; where none
is, the last token is taken back, and a place once given up is never entered again, so the work is
linear. Two adjacent tokens are compatible when merging their joined bytes gives just these two; this
is memoised. A sequence of which all neighbours are compatible is the exact result of the merges.

Workers keep a bounded memo of whole chunks (white space and what follows up to the next white space).

Defined cases: null and empty texts have no ids; blank texts have the ids of their spaces; special
tokens are never produced; repeated rows are encoded each; other columns are ignored.
"""

from __future__ import annotations

import base64
import re
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
import regex
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession

from waraq.session import spread

DEFAULT_VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
_SPACE = r"\t-\r \x85\xa0  -     　"
_PIECE = regex.compile(rf"'s|'t|'re|'ve|'m|'ll|'d| ?\p{{L}}+| ?\p{{N}}+| ?[^{_SPACE}\p{{L}}\p{{N}}]+|[{_SPACE}]+(?![^{_SPACE}])|[{_SPACE}]+")
#: Chunks may be encoded by themselves only where no other kind of white space stands in the text.
_OTHER_SPACE = re.compile(r"[\t\x0b-\r\x1c-\x1f\x85\xa0  -     　]")
_CHUNK = re.compile(r"[ \n]*[^ \n]+|[ \n]+")
MEMO_ENTRIES = 400_000


class ByteBPE:
    """Exact byte-pair encoding by longest match and backtracking."""

    def __init__(self, rank_file: bytes):
        self.ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, rank_file.splitlines())}
        self.automaton = ahocorasick.Automaton()
        for token, rank in self.ranks.items():
            self.automaton.add_word(token.decode("latin-1"), (len(token), rank))
        self.automaton.make_automaton()
        self.bytes_of = {r: t for t, r in self.ranks.items()}
        self.pairs: dict[int, bool] = {}
        self.pieces: dict[str, bytes] = {}
        self.chunks: dict[str, bytes] = {}

    def merged(self, data: bytes) -> list[int]:
        """The merges carried out one by one; only for pairs of tokens, as it is quadratic."""
        parts = [data[i : i + 1] for i in range(len(data))]
        while len(parts) > 1:
            best = min(((self.ranks.get(a + b, 1 << 60), i) for i, (a, b) in enumerate(zip(parts, parts[1:]))), default=(1 << 60, 0))
            if best[0] == 1 << 60:
                break
            i = best[1]
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
        return [self.ranks[p] for p in parts]

    def compatible(self, a: int, b: int) -> bool:
        key = a << 32 | b
        known = self.pairs.get(key)
        if known is None:
            if len(self.pairs) > 4 * MEMO_ENTRIES:
                self.pairs.clear()
            known = self.pairs[key] = self.merged(self.bytes_of[a] + self.bytes_of[b]) == [a, b]
        return known

    def piece_ids(self, data: bytes) -> list[int]:
        whole = self.ranks.get(data)
        if whole is not None:
            return [whole]
        n = len(data)
        at: list[list[tuple[int, int]]] = [[] for _ in range(n)]  # tokens that begin here, shorter ones first
        for end, found in self.automaton.iter(data.decode("latin-1")):
            at[end - found[0] + 1].append(found)
        ids: list[int] = []
        choice: list[int] = []  # for each taken token, which of those at its place
        alive = bytearray(b"\x01") * (n + 1)
        pos, k = 0, len(at[0]) - 1
        while pos < n:
            last = ids[-1] if ids else -1
            here = at[pos]
            while k >= 0:
                length, token = here[k]
                if alive[pos + length] and (last < 0 or self.compatible(last, token)):
                    break
                k -= 1
            if k >= 0:
                ids.append(token)
                choice.append(k)
                pos += length
                if pos < n:
                    k = len(at[pos]) - 1
            else:
                alive[pos] = 0
                pos -= len(self.bytes_of[ids.pop()])
                k = choice.pop()
        return ids

    def _piece(self, piece: str) -> bytes:
        got = self.pieces.get(piece)
        if got is None:
            ids = self.piece_ids(piece.encode("utf-8", "replace"))
            got = pa.array(ids, pa.int32()).buffers()[1].to_pybytes()[: 4 * len(ids)]
            if len(self.pieces) > MEMO_ENTRIES:
                self.pieces.clear()
            if len(piece) <= 100:
                self.pieces[piece] = got
        return got

    def _chunk(self, chunk: str) -> bytes:
        got = b"".join([self._piece(p) for p in _PIECE.findall(chunk)])
        if len(self.chunks) > MEMO_ENTRIES:
            self.chunks.clear()
        if len(chunk) <= 100:
            self.chunks[chunk] = got
        return got

    def encode_bytes(self, text: str) -> bytes:
        """The ids of a text as little-endian 32-bit integers."""
        if _OTHER_SPACE.search(text):
            return b"".join([self._piece(p) for p in _PIECE.findall(text)])
        known, make = self.chunks.get, self._chunk
        return b"".join([known(c) or make(c) for c in _CHUNK.findall(text)])


_loaded: dict[int, ByteBPE] = {}


def tokenizer(vocabulary: Broadcast) -> ByteBPE:
    """One encoder for each worker process, kept between tasks."""
    key = hash(vocabulary.value)
    if key not in _loaded:
        _loaded.clear()
        _loaded[key] = ByteBPE(vocabulary.value)
    return _loaded[key]


def vocabulary(spark: SparkSession, path: str = DEFAULT_VOCABULARY) -> Broadcast:
    """The rank file (under 1 MB for a public vocabulary of 50k) for the workers."""
    with open(path, "rb") as f:
        return spark.sparkContext.broadcast(f.read())


def encode(df: DataFrame, key: str, text: str, path: str = DEFAULT_VOCABULARY) -> DataFrame:
    """(key, ids): the ids of each text, in the order of the tokenizer."""
    ranks = vocabulary(df.sparkSession, path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = tokenizer(ranks)
        for b in batches:
            for i in range(0, b.num_rows, 2000):
                part = b.slice(i, 2000)
                rows = [bpe.encode_bytes(t) if t else b"" for t in part.column(1).to_pylist()]
                offsets, total = [0], 0
                for r in rows:
                    total += len(r) // 4
                    offsets.append(total)
                values = pa.Array.from_buffers(pa.int32(), total, [None, pa.py_buffer(b"".join(rows))])
                yield pa.RecordBatch.from_arrays([part.column(0), pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), values)], [key, "ids"])

    return spread(df.select(key, text)).mapInArrow(run, f"{key} {df.schema[key].dataType.simpleString()}, ids array<int>")


def count(df: DataFrame, key: str, text: str, path: str = DEFAULT_VOCABULARY) -> DataFrame:
    """All columns but the text, and n_tokens: the number of ids of each text."""
    ranks = vocabulary(df.sparkSession, path)
    rest = [c for c in df.columns if c != text]
    schema = ", ".join(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in rest) + ", n_tokens bigint"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = tokenizer(ranks)
        for b in batches:
            sizes = [len(bpe.encode_bytes(t)) // 4 if t else 0 for t in b.column(len(rest)).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(sizes, pa.int64())], [*rest, "n_tokens"])

    return spread(df.select(*rest, text)).mapInArrow(run, schema)
