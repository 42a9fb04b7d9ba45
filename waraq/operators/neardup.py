"""Near-duplicate detection: one-permutation MinHash, banding, star candidates, verification and components.

A document's shingle hashes are sketched into bins by one hash; empty bins borrow from others in an
order fixed by digests. Candidates of a band bucket are its anchor (the smallest key) with every other
member, so a bucket of m documents gives m-1 pairs and not m². Anchors come from an aggregation with
map-side combining and are joined back with salt, so a bucket may hold any share of all rows.

The star is the reference's rule and that of the SQL, and leaves pairs that never meet as anchor and member
untried. `every` tries them too: linked() gives the components of all pairs of a bucket, for which only
members that the star left apart have to meet, and pairs() all pairs themselves. At a threshold t of which
(1 - t) * permutations is below the number of bands, no pair of sketches is missed: some band is equal.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from waraq.config import NearDup
from waraq.functions.shingling import canonical
from waraq.functions.text import h60, key, shingles
from waraq.operators.components import connected_components
from waraq.operators.groups import with_group
from waraq.operators.sampling import lowest_per_group
from waraq.session import cut, spread

#: Members of a bucket that meet in one place.
BLOCK = 500


def probe_order(bins: int, seed: int) -> np.ndarray:
    """For each bin the other bins in the order in which it borrows from them."""
    digest = lambda b, p: hashlib.md5(f"{seed}|{b}|{p}".encode()).hexdigest()
    return np.array([sorted((p for p in range(bins) if p != b), key=lambda p: digest(b, p)) for b in range(bins)])


def shingle_hashes(text: str, size: int) -> np.ndarray:
    """h60 of the distinct shingles of a text, as functions.text has them for columns."""
    words = canonical(text).split(" ")
    grams = {" ".join(words[i : i + size]) for i in range(len(words) - size + 1)}
    return np.fromiter((int.from_bytes(hashlib.md5(g.encode("utf-8", "surrogatepass")).digest()[:8], "big") >> 4 for g in grams), np.int64, len(grams))


def sketch(hashes: np.ndarray, order: np.ndarray) -> np.ndarray:
    """The smallest value of each bin; an empty bin takes that of the first filled one in its order."""
    k = len(order)
    out = np.full(k, np.iinfo(np.int64).max)
    np.minimum.at(out, hashes % k, hashes // k % (1 << 32))
    filled = out != np.iinfo(np.int64).max
    if not filled.all():
        empty = np.flatnonzero(~filled)
        first = filled[order[empty]].argmax(1)
        out[empty] = out[order[empty, first]]
    return out


def sketched(docs: DataFrame, config: NearDup = NearDup(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, doc_key, n_shingles, bins) of documents with enough shingles; one narrow pass, no shuffle."""
    source = spread(docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")))
    kind, k, seed = docs.schema[id_col].dataType.simpleString(), config.permutations, config.seed

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        order = probe_order(k, seed)
        for b in batches:
            keep, sizes, rows = [], [], []
            for i, text in enumerate(b.column(1).to_pylist()):
                h = shingle_hashes(text or "", config.shingle_size)
                if len(h) >= config.min_shingles:
                    keep.append(i)
                    sizes.append(len(h))
                    rows.append(sketch(h, order))
            flat = np.concatenate(rows) if rows else np.empty(0, np.int64)
            bins = pa.ListArray.from_arrays(pa.array(np.arange(0, len(flat) + 1, k), pa.int32()), pa.array(flat, pa.int64()))
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(keep, pa.int64())), pa.array(sizes, pa.int32()), bins], ["id", "n_shingles", "bins"])

    made = source.mapInArrow(run, f"id {kind}, n_shingles int, bins array<bigint>")
    return made.select("id", key("near/k", F.col("id").cast("string")).alias("doc_key"), "n_shingles", "bins")


def candidates(sketches: DataFrame, config: NearDup = NearDup()) -> DataFrame:
    """(a, b): anchor and member of some bucket, each unordered pair once, a the smaller key."""
    bands = F.transform(F.sequence(F.lit(0), F.lit(config.bands - 1)), lambda i: F.xxhash64(i, F.slice("bins", i * config.rows + 1, config.rows)))
    buckets = sketches.select("doc_key", F.explode(bands).alias("bucket"))
    met = with_group(buckets, "bucket", "doc_key", F.min("doc_key").alias("anchor"), F.count("*").alias("n")).filter(F.col("n") > 1)
    return met.filter(F.col("doc_key") != F.col("anchor")).select(F.col("anchor").alias("a"), F.col("doc_key").alias("b")).distinct()


def meetings(sketches: DataFrame, config: NearDup = NearDup(), roots: DataFrame | None = None) -> DataFrame:
    """(a, b): all pairs of some bucket, each once, a the smaller key; with (node, root), those of different roots that the star hasn't tried.

    A bucket is dealt into blocks that meet pairwise, so its work is spread however large it is.
    """
    bands = F.transform(F.sequence(F.lit(0), F.lit(config.bands - 1)), lambda i: F.xxhash64(i, F.slice("bins", i * config.rows + 1, config.rows)))
    if roots is None:
        held = sketches.select("doc_key", F.col("doc_key").alias("root"), F.explode(bands).alias("bucket"))
    else:
        held = sketches.select("doc_key", "bins").join(roots.withColumnRenamed("node", "doc_key"), "doc_key", "left").select("doc_key", F.coalesce("root", "doc_key").alias("root"), F.explode(bands).alias("bucket"))
    members = with_group(held, "bucket", "doc_key", F.count("*").alias("n"), F.min("doc_key").alias("anchor"), F.min("root").alias("low"), F.max("root").alias("high")).filter(F.col("low") < F.col("high"))
    if roots is not None:
        members = members.filter((F.col("n") > 2) & (F.col("doc_key") != F.col("anchor")))
    blocks = F.ceil(F.col("n") / BLOCK)
    dealt = cut(members.select("bucket", "doc_key", "root", blocks.alias("blocks"), F.pmod(F.xxhash64(F.lit("block"), "doc_key"), blocks).alias("block")))
    x = dealt.select("bucket", F.col("block").alias("i"), F.explode(F.sequence("block", F.col("blocks") - 1)).alias("j"), F.col("doc_key").alias("x"), F.col("root").alias("p"))
    y = dealt.select("bucket", F.explode(F.sequence(F.lit(0).cast("bigint"), "block")).alias("i"), F.col("block").alias("j"), F.col("doc_key").alias("y"), F.col("root").alias("q"))
    met = x.join(y, ["bucket", "i", "j"]).filter((F.col("p") != F.col("q")) & ((F.col("i") < F.col("j")) | (F.col("x") < F.col("y"))))
    return met.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()


def agreement(x: Column, y: Column, k: int) -> Column:
    return F.size(F.filter(F.zip_with(x, y, lambda a, b: a == b), lambda e: e)) / F.lit(float(k))


def measured(found: DataFrame, sketches: DataFrame, config: NearDup, least: float) -> DataFrame:
    """(a, b, similarity) of the pairs that agree in at least the least share of their bins."""
    held = sketches.select("doc_key", "bins")
    joined = found.join(held.withColumnsRenamed({"doc_key": "a", "bins": "x"}), "a").join(held.withColumnsRenamed({"doc_key": "b", "bins": "y"}), "b")
    return joined.select("a", "b", agreement(F.col("x"), F.col("y"), config.permutations).alias("similarity")).filter(F.col("similarity") >= least)


def pairs(sketches: DataFrame, config: NearDup = NearDup(), every: bool = False) -> DataFrame:
    """(a, b, similarity) of candidates that agree in at least `retain` of their bins."""
    return measured(meetings(sketches, config) if every else candidates(sketches, config), sketches, config, config.retain)


def linked(sketches: DataFrame, config: NearDup, threshold: float) -> DataFrame:
    """(a, b, similarity): links with the components of all pairs of a bucket that reach the threshold.

    Equal sketches are linked to the first of them, which alone meets others: the star, then what it left apart.
    """
    same = with_group(sketches.select("doc_key", F.md5(F.array_join(F.col("bins").cast("array<string>"), ",")).alias("sketch")), "sketch", "doc_key", F.min("doc_key").alias("first"))
    copies = cut(same.filter(F.col("doc_key") != F.col("first")).select(F.col("first").alias("a"), F.col("doc_key").alias("b"), F.lit(1.0).alias("similarity")))
    single = sketches.join(copies.select(F.col("b").alias("doc_key")), "doc_key", "left_anti")
    star = cut(measured(candidates(single, config), single, config, threshold))
    rest = measured(meetings(single, config, connected_components(star)), single, config, threshold)
    return copies.unionByName(star).unionByName(rest)


def clusters(sketches: DataFrame, retained: DataFrame, threshold: float) -> DataFrame:
    """(id, doc_key, cluster, size, kept) of each sketched document; the smallest key of a cluster is kept."""
    roots = connected_components(retained.filter(F.col("similarity") >= threshold).select("a", "b"))
    named = sketches.select("id", "doc_key").join(roots.withColumnRenamed("node", "doc_key"), "doc_key", "left").withColumn("cluster", F.coalesce("root", "doc_key")).drop("root")
    return with_group(named, "cluster", "doc_key", F.count("*").alias("size")).select("id", "doc_key", "cluster", "size", (F.col("doc_key") == F.col("cluster")).alias("kept"))


def verdicts(docs: DataFrame, config: NearDup = NearDup(), id_col: str = "doc_id", text_col: str = "text", every: bool = False) -> DataFrame:
    """(id, kept, reason, cluster_size) of every document; too short ones are kept as such."""
    sketches = cut(sketched(docs, config, id_col, text_col))
    found = clusters(sketches, cut(linked(sketches, config, config.threshold) if every else pairs(sketches, config)), config.threshold)
    joined = docs.select(F.col(id_col).alias("id")).join(found, "id", "left")
    reason = F.when(F.col("kept").isNull(), "too_few_shingles").when(~F.col("kept"), "near_duplicate").otherwise("unique")
    return joined.select(F.col("id").alias(id_col), F.coalesce("kept", F.lit(True)).alias("kept"), reason.alias("reason"), F.coalesce("size", F.lit(1)).cast("bigint").alias("cluster_size"))


def sweep(docs: DataFrame, thresholds: tuple, config: NearDup = NearDup(), id_col: str = "doc_id", text_col: str = "text", every: bool = False) -> DataFrame:
    """(threshold, clusters, removed, largest): the same pairs clustered at other thresholds, none below `retain`."""
    if min(thresholds) < config.retain:
        raise ValueError(f"pairs below {config.retain} were not retained")
    sketches = cut(sketched(docs, config, id_col, text_col))
    retained, out = None if every else cut(pairs(sketches, config)), None
    for t in thresholds:
        links = cut(linked(sketches, config, t)) if every else retained
        sizes = connected_components(links.filter(F.col("similarity") >= t).select("a", "b")).groupBy("root").agg(F.count("*").alias("n"))
        row = sizes.agg(F.lit(t).alias("threshold"), F.count("*").alias("clusters"), F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("removed"), F.coalesce(F.max("n"), F.lit(0)).alias("largest"))
        out = row if out is None else out.unionByName(row)
    return out


def similarity_histogram(retained: DataFrame) -> DataFrame:
    """(band, pairs): twentieths, the last one closed."""
    return retained.groupBy(F.least(F.floor(F.col("similarity") * 20 + 1e-9), F.lit(19)).cast("int").alias("band")).agg(F.count("*").alias("pairs"))


def exact_jaccard(docs: DataFrame, named: DataFrame, size: int = 5, unit: str = "word", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(a, b, jaccard, containment) of named pairs of ids from their shingles themselves; two empty sets are equal.

    containment is the share of the smaller set in the larger.
    """
    wanted = named.select(F.col("a").alias("id")).unionByName(named.select(F.col("b").alias("id"))).distinct()
    held = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).join(wanted, "id", "left_semi").select("id", F.transform(shingles(F.col("text"), size, unit), h60).alias("hs"))
    j = named.select("a", "b").join(held.withColumnsRenamed({"id": "a", "hs": "x"}), "a").join(held.withColumnsRenamed({"id": "b", "hs": "y"}), "b")
    j = j.withColumn("n", F.size(F.array_intersect("x", "y")))
    union, least = F.size("x") + F.size("y") - F.col("n"), F.least(F.size("x"), F.size("y"))
    return j.select("a", "b", F.when(union > 0, F.col("n") / union).otherwise(1.0).alias("jaccard"), F.when(least > 0, F.col("n") / least).otherwise(1.0).alias("containment"))


def named_pairs(sketches: DataFrame, retained: DataFrame) -> DataFrame:
    """(a, b, similarity) by ids instead of keys, a the smaller id."""
    ids = sketches.select("id", "doc_key")
    j = retained.join(ids.withColumnsRenamed({"id": "x", "doc_key": "a"}), "a").join(ids.withColumnsRenamed({"id": "y", "doc_key": "b"}), "b")
    return j.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"), "similarity")


def pair_examples(retained: DataFrame, per_band: int = 12) -> DataFrame:
    """A few pairs of each band of similarity, those with the lowest digest: a report."""
    return lowest_per_group(retained.withColumn("band", F.least(F.floor(F.col("similarity") * 20 + 1e-9), F.lit(19)).cast("int")).withColumn("pair", F.concat_ws("|", "a", "b")), ["band"], per_band, "examples", "pair").drop("pair")


def cross_source(found: DataFrame, sources: DataFrame) -> DataFrame:
    """(source_a, source_b, clusters) of clusters that span sources. sources: (id, source)."""
    sets = found.filter(F.col("size") > 1).join(sources, "id").groupBy("cluster").agg(F.array_sort(F.collect_set(F.coalesce("source", F.lit("")))).alias("s")).filter(F.size("s") > 1)
    first = sets.select("s", F.explode("s").alias("source_a"))
    return first.select("source_a", F.explode(F.filter("s", lambda x: x > F.col("source_a"))).alias("source_b")).groupBy("source_a", "source_b").agg(F.count("*").alias("clusters"))


def without(docs: DataFrame, removed: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Documents that an earlier stage didn't remove: the same as if these had never been indexed."""
    return docs.join(removed.select(id_col).distinct(), id_col, "left_anti")
