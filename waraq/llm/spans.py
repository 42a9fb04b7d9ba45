"""Problem 10: long exact spans shared between records, by sharded compressed FM-indexes.

A window is a run of `length` characters (200). Each window is assigned to one anchor: the k-gram with
the smallest hash inside it, which is the same wherever the window stands. Anchors that only one
document holds can't belong to a shared window and are dropped; the windows of the others are cut out
and sent to the shard of their anchor, so equal windows meet in one shard and shards stay small
whatever the size of the corpus. Each shard builds an FM-index of its pieces and streams them through
it: backward search over the wavelet matrix gives thresholded matching statistics, that is all windows
that another document of the shard holds, as classes of equal windows.

Equal pieces of one document are searched once, and pieces are cut to like lengths. Windows of an anchor
that very many documents hold (page chrome, say) are anchored again by a longer k-gram. What is still that
frequent comes as classes with members: its windows are grouped by their 128-bit digests, whose rows grow with
the documents and not with their pairs, and only pairs() lets the members of a class meet, in blocks. Copies of
whole texts are collapsed beforehand and put back at the end.

Defined cases: null, empty and short texts share nothing; rows without an id are no document; a span repeated within one document only is
not shared; rows with equal ids are one document each id; an empty table gives no rows; characters
are code points; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from waraq.llm.fm_index import FMIndex
from waraq.operators.groups import pairs_within, with_group
from waraq.session import cut, parallelism, spread

LENGTH = 200
ANCHOR = 100
LONG_ANCHOR = 170
#: Texts with one anchor beyond which it is anchored again, then grouped by window.
HOT_TEXTS = 2000
#: Windows to a piece.
MOST_WINDOWS = 512
#: Characters of pieces to a shard.
SHARD_CHARS = 500_000
#: Tasks that search shards, at most; each takes shards in turn.
MOST_TASKS = 20_000
#: Anchor rows (24 bytes each) up to which they are broadcast to the texts.
BROADCAST_ROWS = 1_000_000
_A, _B = 0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93


def code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def gram_hashes(points: np.ndarray, k: int) -> np.ndarray:
    """A 64-bit hash of each k-gram, by doubling."""
    step = points.astype(np.uint64) * np.uint64(_B)
    step ^= step >> np.uint64(29)
    width, out, done, rest = 1, None, 0, k
    while rest:
        if rest & 1:
            if out is None:
                out = step
            else:
                m = len(step) - done
                out = out[:m] * np.uint64(pow(_A, width, 1 << 64)) + step[done : done + m]
            done += width
        rest >>= 1
        if rest:
            step = step[:-width] * np.uint64(pow(_A, width, 1 << 64)) + step[width:]
            width *= 2
    out = out ^ (out >> np.uint64(31))
    out *= np.uint64(_B)
    return out ^ (out >> np.uint64(32))


def anchors(points: np.ndarray, length: int, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash, first window, last window) of each anchor, in the order of the text."""
    if len(points) < length:
        return np.empty(0, np.uint64), np.empty(0, np.int64), np.empty(0, np.int64)
    h = gram_hashes(points, k)
    w = length - k + 1
    low, width = h, 1  # minima of growing windows first, as the search for places reads w times as much
    while 2 * width <= w:
        low = np.minimum(low[:-width], low[width:])
        width *= 2
    low = np.minimum(low[: len(h) - w + 1], low[w - width : w - width + len(h) - w + 1])
    change = np.flatnonzero(low[1:] != low[:-1]) + 1
    first = np.append(0, change)
    last = np.append(change, len(low)) - 1
    # where a text goes round in circles one anchor may cover it all: a search goes in step through pieces of like length
    parts = (last - first) // MOST_WINDOWS + 1
    start = np.repeat(first, parts) + MOST_WINDOWS * (np.arange(parts.sum()) - np.repeat(np.cumsum(parts) - parts, parts))
    return np.repeat(low[first], parts), start, np.minimum(start + MOST_WINDOWS - 1, np.repeat(last, parts))


def _anchor_rows(texts: DataFrame, length: int, k: int) -> DataFrame:
    """(doc, h, a, b, one): the windows a..b of each anchor; one is 1 where the text shows the anchor first, else 0. texts: (doc bigint, base int, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            docs, hs, firsts, lasts, ones = [], [], [], [], []
            for doc, base, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                h, a, b = anchors(code_points(text), length, k)
                docs.append(np.full(len(h), doc, np.int64))
                hs.append(h.view(np.int64))
                firsts.append(a + base)
                lasts.append(b + base)
                one = np.zeros(len(h), np.int64)
                one[np.unique(h, return_index=True)[1]] = 1
                ones.append(one)
            if docs:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(docs)), pa.array(np.concatenate(hs)), pa.array(np.concatenate(firsts), pa.int32()), pa.array(np.concatenate(lasts), pa.int32()), pa.array(np.concatenate(ones), pa.int32())], ["doc", "h", "a", "b", "one"])

    return texts.mapInArrow(run, "doc bigint, h bigint, a int, b int, one int")


def _shared(rows: DataFrame) -> DataFrame:
    """(h, texts) of the anchors that at least two documents hold, with the number of texts; combined before the shuffle."""
    return rows.groupBy("h").agg(F.sum("one").alias("texts"), F.min("doc").alias("lo"), F.max("doc").alias("hi")).filter(F.col("lo") < F.col("hi")).select("h", "texts")


def _pieces(texts: DataFrame, wanted: DataFrame, length: int) -> DataFrame:
    """(doc, h, a, text): the text of the windows a..b of each wanted anchor."""
    held = wanted.groupBy("doc").agg(F.collect_list(F.struct("h", "a", "b")).alias("w"))
    if wanted.count() <= BROADCAST_ROWS:
        held = F.broadcast(held)

    def cut_out(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def made(rows: list[tuple]) -> pa.RecordBatch:
            columns = list(zip(*rows)) or [[], [], [], []]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.int32(), pa.string()))], ["doc", "h", "a", "text"])

        for batch in batches:
            rows: list[tuple] = []
            for doc, text, windows in zip(*(batch.column(i).to_pylist() for i in range(3))):
                for w in windows:
                    rows.append((doc, w["h"], w["a"], text[w["a"] : w["b"] + length]))
                    if len(rows) >= 20_000:
                        yield made(rows)
                        rows = []
            yield made(rows)

    # a window in the middle of a long text is found in one step here, and by a walk from its beginning in SQL
    return texts.join(held, "doc").select("doc", "text", "w").mapInArrow(cut_out, "doc bigint, h bigint, a int, text string")


def _windows(pieces: DataFrame, length: int) -> DataFrame:
    """(doc, a, m): the digest of each window of the pieces. pieces: (doc, h, a, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            docs, at, digests = [], [], []
            for doc, a, text in zip(*(batch.column(i).to_pylist() for i in (0, 2, 3))):
                for i in range(len(text) - length + 1):
                    docs.append(doc)
                    at.append(a + i)
                    digests.append(hashlib.md5(text[i : i + length].encode("utf-8", "surrogatepass")).digest())
            yield pa.RecordBatch.from_arrays([pa.array(docs, pa.int64()), pa.array(at, pa.int32()), pa.array(digests, pa.binary())], ["doc", "a", "m"])

    return pieces.mapInArrow(run, "doc bigint, a int, m binary").distinct()


_RESULT = "doc bigint, other bigint, a int, b int"


def _search(length: int, wants: tuple[str, ...]):
    """For each shard: pairs (doc, other, null, null) and shared spans (doc, null, a, b), as wanted."""

    def run(table: pa.Table) -> pa.Table:
        docs = table.column("doc").to_numpy()
        starts = table.column("a").to_numpy()
        # a document that goes round in circles has the same piece in many places: it is searched once
        numbers: dict[tuple, int] = {}
        number = np.array([numbers.setdefault(x, len(numbers)) for x in zip(docs.tolist(), table.column("text").to_pylist())])
        index = FMIndex([code_points(t).astype(np.int64) for _, t in numbers], np.array([d for d, _ in numbers], np.int64), length)
        piece, offset, cls = index.shared_windows()
        if not len(piece):
            return pa.table({"doc": pa.array([], pa.int64()), "other": pa.array([], pa.int64()), "a": pa.array([], pa.int32()), "b": pa.array([], pa.int32())})
        pairs = np.zeros((2, 0), np.int64)
        if "pairs" in wants:
            which, who = index.documents(np.unique(cls))
            cuts = np.append(np.flatnonzero(np.append(True, which[1:] != which[:-1])), len(which))
            sets = {who[i:j].tobytes() for i, j in zip(cuts[:-1], cuts[1:])}
            left, right = [], []
            for s in sets:
                d = np.frombuffer(s, np.int64)
                i, j = np.triu_indices(len(d), 1)
                left.append(d[i])
                right.append(d[j])
            pairs = np.unique(np.stack([np.concatenate(left), np.concatenate(right)]), axis=1)
        if "spans" not in wants:
            n = pairs.shape[1]
            return pa.table({"doc": pa.array(pairs[0]), "other": pa.array(pairs[1]), "a": pa.nulls(n, pa.int32()), "b": pa.nulls(n, pa.int32())})
        order = np.lexsort((offset, piece))
        p, o = piece[order], offset[order]
        gap = np.append(True, (p[1:] != p[:-1]) | (o[1:] > o[:-1] + length))
        begin = np.flatnonzero(gap)
        end = np.append(begin[1:], len(p)) - 1
        # each place of a piece has the piece's spans
        count = np.bincount(p[begin], minlength=len(numbers))
        first = np.cumsum(count) - count
        place = np.repeat(np.arange(len(docs)), count[number])
        mine = np.arange(len(place)) - np.repeat(np.cumsum(count[number]) - count[number], count[number]) + first[number[place]]
        spans = (docs[place], starts[place] + o[begin[mine]], starts[place] + o[end[mine]] + length)
        n, m = pairs.shape[1], len(place)
        return pa.table(
            {
                "doc": pa.array(np.concatenate([pairs[0], spans[0]])),
                "other": pa.chunked_array([pa.array(pairs[1]), pa.nulls(m, pa.int64())]),
                "a": pa.chunked_array([pa.nulls(n, pa.int32()), pa.array(spans[1], pa.int32())]),
                "b": pa.chunked_array([pa.nulls(n, pa.int32()), pa.array(spans[2], pa.int32())]),
            }
        )

    return run


class SharedSpans:
    """Spans of at least `length` characters that stand verbatim in more than one document."""

    def __init__(self, documents: DataFrame, key: str = "doc_id", text: str = "text", length: int = LENGTH, wants: tuple[str, ...] = ("pairs", "spans")):
        """wants: what will be asked for; pairs cost more than spans where many documents share a span."""
        self.length, self.wants = length, wants
        texts = documents.select(F.col(key).cast("bigint").alias("doc"), F.col(text).alias("text")).filter(F.col("doc").isNotNull() & (F.length("text") >= length))
        # copies of whole texts: the smallest id stands for all
        same = texts.select("doc", F.md5("text").alias("m"), F.length("text").alias("n"))
        self.copies = cut(with_group(same, "m", "doc", F.min("doc").alias("rep")).filter(F.col("doc") != F.col("rep")).select("doc", "rep", "n"))
        drop = self.copies.select("doc").distinct()
        unique = texts.join(F.broadcast(drop) if self.copies.count() <= BROADCAST_ROWS else drop, "doc", "left_anti")
        # windows by their anchors; those of very frequent anchors again by a longer one
        k = min(ANCHOR, length // 2)
        rows = cut(_anchor_rows(spread(unique).select("doc", F.lit(0).alias("base"), "text"), length, k))
        shared = cut(_shared(rows))
        cold = rows.join(shared.filter(F.col("texts") <= HOT_TEXTS).select("h"), "h", "left_semi").select("doc", "h", "a", "b")
        wanted, self.classes = cold, None
        hot = shared.filter(F.col("texts") > HOT_TEXTS).select("h")
        if hot.limit(1).count():
            again = rows.join(F.broadcast(hot) if shared.count() <= BROADCAST_ROWS else hot, "h", "left_semi")
            longer = cut(_anchor_rows(_pieces(unique, again, length).select("doc", F.col("a").alias("base"), "text"), length, min(LONG_ANCHOR, length - 1)).dropDuplicates(["doc", "h", "a", "b"]))
            counts = cut(_shared(longer))
            wanted = wanted.unionByName(longer.join(counts.filter(F.col("texts") <= HOT_TEXTS).select("h"), "h", "left_semi").select("doc", "h", "a", "b"))
            hottest = counts.filter(F.col("texts") > HOT_TEXTS).select("h")
            if not hottest.isEmpty():
                members = _windows(_pieces(unique, longer.join(hottest, "h", "left_semi"), length), length)
                self.classes = cut(with_group(members, "m", "doc", F.min("doc").alias("lo"), F.max("doc").alias("hi")).filter(F.col("lo") < F.col("hi")).select("doc", "a", "m"))
        wanted = cut(wanted)
        chars = wanted.agg(F.sum(F.col("b") - F.col("a") + length)).first()[0] or 0
        shards = max(1, -(-chars // SHARD_CHARS))
        if shards > 1:
            shards = max(shards, parallelism(documents.sparkSession))
        pieces = _pieces(unique, wanted.select("doc", F.xxhash64("h").alias("h"), "a", "b"), length)
        routed = pieces.select(F.pmod("h", F.lit(shards)).alias("shard"), "doc", "a", "text")
        # as many tasks as there is work for, which the planner would judge by the bytes of the pieces
        routed = routed.repartition(min(shards, MOST_TASKS), "shard")
        self.found = cut(routed.groupBy("shard").applyInArrow(_search(length, wants), _RESULT))

    def pairs(self) -> DataFrame:
        """(doc_a, doc_b), doc_a < doc_b: documents that share a span."""
        linked = self.found.filter(F.col("other").isNotNull()).select("doc", "other")
        if self.classes is not None:
            met = pairs_within(self.classes.select("doc", "m").distinct(), "m", "doc")
            linked = linked.unionByName(met.select(F.col("a").alias("doc"), F.col("b").alias("other")))
        linked = linked.distinct()
        members = self.copies.select("rep", "doc").distinct()
        # a linked text and its copies on either side, then copies among themselves
        left = linked.unionByName(linked.join(members, linked["doc"] == members["rep"]).select(members["doc"].alias("doc"), "other"))
        both = left.unionByName(left.join(members.withColumnRenamed("doc", "copy"), F.col("other") == F.col("rep")).select("doc", F.col("copy").alias("other")))
        among = pairs_within(members.unionByName(members.select("rep", F.col("rep").alias("doc")).distinct()), "rep", "doc")
        return both.unionByName(among.select(F.col("a").alias("doc"), F.col("b").alias("other"))).select(F.least("doc", "other").alias("doc_a"), F.greatest("doc", "other").alias("doc_b")).filter(F.col("doc_a") < F.col("doc_b")).distinct()

    def spans(self) -> DataFrame:
        """(doc_id, span_start, span_end): the maximal shared spans of each document; a copied text is shared as a whole."""
        parts = self.found.filter(F.col("other").isNull()).select("doc", "a", "b")
        members = self.copies.select("rep", "doc", "n").distinct()
        whole = members.select("doc", F.lit(0).alias("a"), F.col("n").alias("b")).unionByName(members.select(F.col("rep").alias("doc"), F.lit(0).alias("a"), F.col("n").alias("b")))
        parts = parts.unionByName(whole)
        if self.classes is not None:
            parts = parts.unionByName(self.classes.select("doc", "a", (F.col("a") + self.length).alias("b")))
        merged = F.aggregate(
            F.array_sort(F.collect_set(F.struct("a", "b"))),
            F.array().cast("array<struct<a:int,b:int>>"),
            lambda acc, x: F.when((F.size(acc) > 0) & (F.element_at(acc, -1)["b"] >= x["a"]), F.concat(F.slice(acc, F.lit(1), F.size(acc) - 1), F.array(F.struct(F.element_at(acc, -1)["a"].alias("a"), F.greatest(F.element_at(acc, -1)["b"], x["b"]).alias("b"))))).otherwise(F.concat(acc, F.array(x))),
        )
        return parts.groupBy("doc").agg(merged.alias("m")).select(F.col("doc").alias("doc_id"), F.explode("m").alias("s")).select("doc_id", F.col("s.a").alias("span_start"), F.col("s.b").alias("span_end"))

    def coverage(self, documents: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
        """(doc_id, n_chars, n_spans, shared_chars, shared): every document, with how much of it is shared elsewhere."""
        sums = self.spans().groupBy("doc_id").agg(F.count("*").cast("int").alias("n_spans"), F.sum(F.col("span_end") - F.col("span_start")).alias("shared_chars"))
        sizes = documents.select(F.col(key).cast("bigint").alias("doc_id"), F.coalesce(F.length(text), F.lit(0)).alias("n_chars"))
        shared = F.coalesce("shared_chars", F.lit(0))
        return sizes.join(sums, "doc_id", "left").select("doc_id", "n_chars", F.coalesce("n_spans", F.lit(0)).alias("n_spans"), shared.alias("shared_chars"), F.when(F.col("n_chars") > 0, shared / F.col("n_chars")).otherwise(0.0).alias("shared"))
