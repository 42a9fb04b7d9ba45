"""Problem 5: evaluation texts leaking into training text, by size-partitioned MinHash containment search.

Items are partitioned by their number of words. Each partition keeps the hash values of its items'
8-word shingles below a threshold (a MinHash sketch by threshold: unlike a fixed number of
minima it compares a short item with a long document). An item of w words of which the share C leaks
has at least ceil(C*w/8) places of shingles in the document. A sketch holds different values, so what
counts is how many different shingles these places must have: at least as many as the item's most frequent
shingles need to fill them. The threshold is the smallest sampling rate at which all of those are missed
with a probability of at most `miss`, never below that of the partition; for short items, and for long
ones that repeat a few shingles, that rate is 1 or near it. A document that holds a sketch value of an item is a candidate, and candidates are
verified on the spot by exact containment of the item's shingles, as words.

The items are the stated query set. Up to a bounded size their sketches are sent to the workers and the documents
stream past them without a shuffle, so that a document repeated in a third of all rows costs no more than
any other. A larger set stays distributed: the workers get a bitmap of fixed size of all sketch values, the
documents stream past that once, and only what it lets through is joined with the sketches. Both ways give the same rows.

Defined cases: null, empty and short texts have no shingles and no hits; rows without an id are left out; repeated rows and repeated
documents count once; an item of fewer than 8 words can't leak; of several texts of one item or
document the largest containment counts; other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from waraq.llm.words import WORD, kept, new_name
from waraq.session import cut, spread

SHINGLE = 8
#: Upper bounds (words) of the partitions; the last is open.
PARTITIONS = (16, 32, 64, 128, 256, 512, 1024, 4096)
#: Characters of items up to which their sketches are sent to the workers; they take about twice as many bytes.
BLOCK_CHARS = 20_000_000
#: Bits of the bitmap of larger sets.
BITS = 1 << 28
_BASES = [np.uint64(pow(0x9E3779B97F4A7C15, w, 1 << 64)) for w in (1, 2, 4)]
_MIX = np.uint64(0xD6E8FEB86659FD93)
MEMO_WORDS = 500_000


def sampling_rate(words_from: int, containment: float, miss: float) -> float:
    """Smallest share of hash values to keep for items of at least words_from words."""
    runs = max(1, math.ceil(containment * words_from / SHINGLE))
    return 1 - miss ** (1 / runs) if runs > 1 else 1.0


def threshold(n_words: int, containment: float, miss: float) -> int:
    """Largest hash value that the sketch of an item of n_words keeps."""
    low = 1
    for high in PARTITIONS:
        if n_words <= high:
            break
        low = high + 1
    return min(2**64 - 1, int(sampling_rate(low, containment, miss) * 2**64))


def rate_threshold(counts: np.ndarray, n_words: int, containment: float, miss: float) -> int:
    """threshold() of an item by the number of places of each of its different shingles."""
    places = max(1, math.ceil(containment * n_words / SHINGLE))
    runs = int(np.searchsorted(np.cumsum(np.sort(counts)[::-1]), places)) + 1
    rate = 1 - miss ** (1 / runs) if runs > 1 else 1.0
    return max(threshold(n_words, containment, miss), min(2**64 - 1, int(rate * 2**64)))


def split(text: str) -> list[str]:
    return WORD.findall(text.lower())


def shingle_values(words: list[str], memo: dict[str, int]) -> np.ndarray:
    """A 64-bit hash of each run of eight words, in order."""
    if len(words) < SHINGLE:
        return np.empty(0, np.uint64)
    if len(memo) > MEMO_WORDS:
        memo.clear()
    for w in words:
        if w not in memo:
            memo[w] = xxhash.xxh64_intdigest(w)
    h = np.fromiter(map(memo.__getitem__, words), np.uint64, len(words))
    for width, base in zip((1, 2, 4), _BASES):
        h = h[:-width] * base + h[width:]
    h ^= h >> np.uint64(31)
    h *= _MIX
    return h ^ (h >> np.uint64(29))


class Sketch:
    """A block of items: sketch values in order, and whose they are."""

    def __init__(self, items: list[tuple[str, str]], containment: float, miss: float):
        memo: dict[str, int] = {}
        self.items = [(i, split(t)) for i, t in items]
        values, owners = [], []
        for k, (_, ws) in enumerate(self.items):
            v, places = np.unique(shingle_values(ws, memo), return_counts=True)
            v = v[v <= np.uint64(rate_threshold(places, len(ws), containment, miss))]
            values.append(v)
            owners.append(np.full(len(v), k, np.int32))
        v, o = np.concatenate(values or [np.empty(0, np.uint64)]), np.concatenate(owners or [np.empty(0, np.int32)])
        order = np.argsort(v, kind="stable")
        self.values, self.owners = v[order], o[order]

    def candidates(self, values: np.ndarray) -> set[int]:
        if not len(self.values) or not len(values):
            return set()
        left = np.searchsorted(self.values, values)
        hit = self.values[np.minimum(left, len(self.values) - 1)] == values
        found: set[int] = set()
        for v in set(values[hit].tolist()):
            a, b = np.searchsorted(self.values, np.uint64(v)), np.searchsorted(self.values, np.uint64(v), "right")
            found.update(self.owners[a:b].tolist())
        return found


def covered_words(item: list[str], shingles: set[tuple[str, ...]]) -> int:
    """Words of the item inside shingles that stand in the document."""
    covered = end = 0
    for i, s in enumerate(zip(*(item[k:] for k in range(SHINGLE)))):
        if s in shingles:
            covered += i + SHINGLE - max(i, end)
            end = i + SHINGLE
    return covered


def leaks(docs: DataFrame, doc_id: str, doc: str, items: DataFrame, item_id: str, item: str, containment: float = 0.6, miss: float = 1e-9) -> DataFrame:
    """(doc_id, item_id, containment, n_words, n_covered): containment is the share of the item's words inside shared runs of eight or more."""
    texts = spread(docs.select(F.col(doc_id).cast("string").alias("doc_id"), F.col(doc).alias("doc")).filter(F.col("doc_id").isNotNull() & (F.length(doc) > 0)))
    pool = items.select(F.col(item_id).cast("string").alias("item_id"), F.col(item).alias("text")).filter(F.col("item_id").isNotNull() & (F.length("text") > 0)).distinct()
    if (pool.agg(F.sum(F.length("text"))).first()[0] or 0) <= BLOCK_CHARS:
        found = _streamed(texts, [(r["item_id"], r["text"]) for r in pool.collect()], containment, miss)
    else:
        found = _joined(texts, pool, containment, miss)
    best = F.max_by(F.struct("n_words", "n_covered"), F.struct(F.col("n_covered") / F.col("n_words"), "n_words")).alias("m")
    return found.groupBy("doc_id", "item_id").agg(best).select("doc_id", "item_id", (F.col("m.n_covered") / F.col("m.n_words")).alias("containment"), F.col("m.n_words").alias("n_words"), F.col("m.n_covered").alias("n_covered"))


_ROWS = "doc_id string, item_id string, n_words int, n_covered int"


def _batch(out: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*out)) if out else [[], [], [], []]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.string(), pa.int32(), pa.int32()))], ["doc_id", "item_id", "n_words", "n_covered"])


def _streamed(texts: DataFrame, items: list[tuple[str, str]], containment: float, miss: float) -> DataFrame:
    """The documents past the sketches of all items."""
    shared, name = texts.sparkSession.sparkContext.broadcast(items), new_name()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sketch, memo = kept(name, lambda: Sketch(shared.value, containment, miss)), {}
        for b in batches:
            out: list[tuple] = []
            for d, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                words = split(text)
                near = sketch.candidates(shingle_values(words, memo))
                if near:
                    shingles = set(zip(*(words[k:] for k in range(SHINGLE))))
                    for k in near:
                        item, ws = sketch.items[k]
                        n = covered_words(ws, shingles)
                        if n >= containment * len(ws) - 1e-9:
                            out.append((d, item, len(ws), n))
            yield _batch(out)

    return texts.mapInArrow(run, _ROWS)


def _joined(texts: DataFrame, pool: DataFrame, containment: float, miss: float) -> DataFrame:
    """The documents past a bitmap of the sketch values, what it lets through joined with the sketches, and the pairs verified."""

    def sketched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            values = [Sketch([("", t)], containment, miss).values.view(np.int64) for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([xxhash.xxh64_intdigest(t) - 2**63 for t in b.column(1).to_pylist()], pa.int64()), pa.array(values, pa.list_(pa.int64()))], ["item_id", "e", "values"])

    sketches = cut(spread(pool).mapInArrow(sketched, "item_id string, e bigint, values array<bigint>").select("item_id", "e", F.explode("values").alias("value")))
    slot = F.pmod("value", F.lit(BITS))
    maps = sketches.groupBy(F.bitmap_bucket_number(slot + 1).alias("k")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(slot + 1)).alias("bits")).collect()  # BITS / 8 bytes at most
    whole = np.zeros(BITS // 8, np.uint8)
    for r in maps:
        part = np.frombuffer(r["bits"], np.uint8)
        whole[(r["k"] - 1) * len(part) : r["k"] * len(part)] = part
    shared = texts.sparkSession.sparkContext.broadcast(whole)

    def through(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits, memo = shared.value, {}
        for b in batches:
            docs, hashes, values = [], [], []
            for d, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                v = np.unique(shingle_values(split(text), memo)).view(np.int64)
                at = v % BITS
                v = v[(bits[at >> 3] >> (at & 7).astype(np.uint8)) & 1 == 1]
                if len(v):
                    docs.append(d)
                    hashes.append(xxhash.xxh64_intdigest(text) - 2**63)
                    values.append(v)
            yield pa.RecordBatch.from_arrays([pa.array(docs, pa.string()), pa.array(hashes, pa.int64()), pa.array(values, pa.list_(pa.int64()))], ["doc_id", "d", "values"])

    near = texts.mapInArrow(through, "doc_id string, d bigint, values array<bigint>").select("doc_id", "d", F.explode("values").alias("value"))
    pairs = cut(near.join(sketches, "value").select("doc_id", "d", "item_id", "e").distinct())

    def named(df: DataFrame, key: str, text: str, mark: str) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array([xxhash.xxh64_intdigest(t) - 2**63 for t in b.column(1).to_pylist()], pa.int64()), b.column(1)], [key, mark, text])

        return df.select(key, text).mapInArrow(run, f"{key} string, {mark} bigint, {text} string")

    held = named(texts, "doc_id", "doc", "d").join(pairs.select("doc_id", "d").distinct(), ["doc_id", "d"], "left_semi").distinct()
    both = pairs.join(held, ["doc_id", "d"]).join(named(pool, "item_id", "text", "e").distinct(), ["item_id", "e"]).select("doc_id", "doc", "item_id", "text")

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out: list[tuple] = []
            for d, doc, item, text in zip(*(b.column(i).to_pylist() for i in range(4))):
                words, ws = split(doc), split(text)
                n = covered_words(ws, set(zip(*(words[k:] for k in range(SHINGLE)))))
                if n >= containment * len(ws) - 1e-9:
                    out.append((d, item, len(ws), n))
            yield _batch(out)

    return both.mapInArrow(verify, _ROWS)
