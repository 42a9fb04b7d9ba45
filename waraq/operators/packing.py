"""Packing of token streams into sequences of a fixed length, by prefix sums instead of a running buffer.

Each stream (population, split and arm) is ordered by a digest of the document id. A document's offset
in its stream is the sum of all lengths before it, taken in levels of hash ranges, so no task holds a whole stream.
Documents run on from one sequence into the next, or (across=False) each begins one of its own and what doesn't fill a
sequence is dropped.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from waraq.config import Packing
from waraq.operators.prefix import running_total
from waraq.session import spread


def streams(assigned: DataFrame) -> DataFrame:
    """A row per stream of a document: held-out documents go into one stream, trained ones into one per arm."""
    arms = F.when(F.col("split_name") == "train", F.col("arms")).otherwise(F.array(F.lit("")))
    out = assigned.filter(F.col("split_name") != "unassigned").withColumn("arm", F.explode(arms))
    return out.withColumn("stream", F.concat_ws("/", "population", "split_name", F.when(F.col("arm") != "", F.col("arm"))))


def byte_ids(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, ids): the bytes of each text, a tokenizer that needs no vocabulary."""
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            data = [(t or "").encode() for t in b.column(1).to_pylist()]
            offsets = pa.array(np.concatenate([[0], np.cumsum([len(x) for x in data], dtype=np.int64)]).astype(np.int32))
            values = pa.array(np.frombuffer(b"".join(data), np.uint8).astype(np.int32))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.ListArray.from_arrays(offsets, values)], [id_col, "ids"])

    return spread(docs.select(id_col, text_col)).mapInArrow(run, f"{id_col} {kind}, ids array<int>")


def placed(docs: DataFrame, config: Packing = Packing(), id_col: str = "doc_id", length_col: str = "n_tokens", across: bool = True) -> DataFrame:
    """Adds n (length with its end token; without across, cut to whole sequences) and at (offset in its stream); empty documents are left out."""
    n = (F.col(length_col) + 1).cast("bigint")
    if not across:
        n = n - F.pmod(n, F.lit(config.sequence_length).cast("bigint"))
    d = docs.filter(F.col(length_col) > 0).withColumn("n", n).filter(F.col("n") > 0).withColumn("_o", F.md5(F.concat(F.lit(config.salt + "|"), F.col(id_col).cast("string"))))
    return running_total(d, "stream", "_o", "n", id_col, "at").drop("_o")


def stream_report(at: DataFrame, config: Packing = Packing()) -> DataFrame:
    """(stream, documents, tokens, sequences, dropped_tokens)."""
    length = F.lit(config.sequence_length)
    sums = at.groupBy("stream").agg(F.count("*").alias("documents"), F.sum("n").alias("tokens"))
    return sums.select("stream", "documents", "tokens", F.floor(F.col("tokens") / length).alias("sequences"), F.pmod("tokens", length).cast("bigint").alias("dropped_tokens"))


def sequences(at: DataFrame, config: Packing = Packing(), bytes_col: str = "n_tokens") -> DataFrame:
    """(stream, seq, documents, separators, text_bytes) of the full sequences.

    A document gives a row for each sequence it reaches; its bytes are shared out by differences of
    floors, so that the parts add up to the whole.
    """
    length = config.sequence_length
    first, last = F.floor(F.col("at") / length), F.floor((F.col("at") + F.col("n") - 1) / length)
    part = at.withColumn("seq", F.explode(F.sequence(first, last)))
    lo = F.greatest(F.col("seq") * length - F.col("at"), F.lit(0))
    hi = F.least((F.col("seq") + 1) * length - F.col("at"), F.col("n"))
    share = F.floor(F.col(bytes_col) * hi / F.col("n")) - F.floor(F.col(bytes_col) * lo / F.col("n"))
    ends = F.when(hi == F.col("n"), 1).otherwise(0)
    totals = at.groupBy("stream").agg(F.floor(F.sum("n") / length).alias("full"))
    return part.groupBy("stream", "seq").agg(F.count("*").alias("documents"), F.sum(ends).alias("separators"), F.sum(share).cast("bigint").alias("text_bytes")).join(totals, "stream").filter(F.col("seq") < F.col("full")).drop("full")


def pack_ids(at: DataFrame, ids_col: str, config: Packing = Packing(), id_col: str = "doc_id") -> DataFrame:
    """(stream, seq, ids): the full sequences themselves, each of exactly sequence_length ids."""
    length, eos = config.sequence_length, config.eos

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            # all documents of the batch in one array, each with its end token (or cut to n), then one cut at every sequence boundary
            lists = b.column(3)
            ends = lists.offsets.to_numpy()[1:] - lists.offsets[0].as_py()
            flat = np.insert(lists.flatten().to_numpy(zero_copy_only=False), ends, eos)
            size = np.diff(np.append(0, ends)) + 1
            n, at_ = b.column(2).to_numpy(), b.column(1).to_numpy()
            start = np.cumsum(size) - size
            first, last = at_ // length, (at_ + n - 1) // length
            parts = last - first + 1
            owner = np.repeat(np.arange(len(n)), parts)
            seq = np.arange(parts.sum()) - np.repeat(np.cumsum(parts) - parts, parts) + first[owner]
            lo = np.maximum(seq * length, at_[owner])
            hi = np.minimum((seq + 1) * length, (at_ + n)[owner])
            where = start[owner] + lo - at_[owner]
            take = np.concatenate([np.arange(a, a + k) for a, k in zip(where, hi - lo)]) if len(where) else np.empty(0, np.int64)
            parts_ = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(hi - lo)), pa.int32()), pa.array(flat[take].astype(np.int32)))
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(owner)), pa.array(seq), pa.array((lo - seq * length).astype(np.int32)), parts_], ["stream", "seq", "inside", "part"])

    parts = at.select("stream", "at", "n", ids_col).mapInArrow(cut, "stream string, seq bigint, inside int, part array<int>")
    whole = parts.groupBy("stream", "seq").agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("inside", "part"))), lambda x: x["part"])).alias("ids"))
    return whole.filter(F.size("ids") == length)


def verify(packed: DataFrame, config: Packing = Packing(), vocabulary: int = 257) -> DataFrame:
    """One row of checks: sequences, those of a wrong length, and ids out of range."""
    return packed.agg(F.count("*").alias("sequences"), F.count_if(F.size("ids") != config.sequence_length).alias("wrong_length"), F.coalesce(F.sum(F.size(F.filter("ids", lambda x: (x < 0) | (x >= vocabulary)))), F.lit(0)).alias("out_of_range"))


def write(packed: DataFrame, path: str, config: Packing = Packing()) -> DataFrame:
    """Parquet by stream, at most sequences_per_shard to a file; returns the manifest, which is written beside it.

    (stream, file, sequences, tokens, bytes, sha256) of each file, from the files themselves.
    """
    spark = packed.sparkSession
    packed.write.partitionBy("stream").option("maxRecordsPerFile", config.sequences_per_shard).mode("overwrite").parquet(f"{path}/data")
    rows = spark.read.parquet(f"{path}/data").select("stream", _file(F.col("_metadata.file_path")).alias("file"), F.size("ids").alias("n"))
    sums = rows.groupBy("stream", "file").agg(F.count("*").alias("sequences"), F.sum("n").cast("bigint").alias("tokens"))
    sums.join(_digests(spark, path), "file").write.mode("overwrite").parquet(f"{path}/manifest")
    return spark.read.parquet(f"{path}/manifest")


def _file(path: Column) -> Column:
    """The part of a path below data, as it was written."""
    return F.url_decode(F.url_decode(F.substring_index(path, "/data/", -1)))


def _digests(spark: SparkSession, path: str) -> DataFrame:
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.parquet").load(f"{path}/data")
    return files.select(_file(F.col("path")).alias("file"), F.col("length").alias("bytes"), F.sha2("content", 256).alias("sha256"))


def verify_corpus(spark: SparkSession, path: str, config: Packing = Packing(), vocabulary: int = 257) -> DataFrame:
    """(file, problem): files that are missing, of another digest or number of sequences, not in the manifest, or with sequences of a wrong length or ids out of range."""
    listed = spark.read.parquet(f"{path}/manifest")
    there = _digests(spark, path).withColumnsRenamed({"bytes": "b", "sha256": "digest"})
    joined = listed.join(there, "file", "full")
    files = joined.select("file", F.when(F.col("digest").isNull(), "missing").when(F.col("sha256").isNull(), "unlisted").when(F.col("digest") != F.col("sha256"), "digest").alias("problem")).filter("problem is not null")
    sound = joined.filter(F.col("digest") == F.col("sha256")).select("file", "sequences")
    rows = spark.read.parquet(f"{path}/data").select(_file(F.col("_metadata.file_path")).alias("file"), "ids").join(F.broadcast(sound) if sound.count() < 1_000_000 else sound, "file")
    bad = F.exists("ids", lambda x: (x < 0) | (x >= vocabulary))
    found = rows.groupBy("file", "sequences").agg(F.count("*").alias("n"), F.count_if(F.size("ids") != config.sequence_length).alias("short"), F.count_if(bad).alias("out"))
    inside = found.select("file", F.explode(F.array_compact(F.array(F.when(F.col("n") != F.col("sequences"), "sequences"), F.when(F.col("short") > 0, "length"), F.when(F.col("out") > 0, "vocabulary")))).alias("problem"))
    return files.unionByName(inside)


def indexed(packed: DataFrame, streams: list[str] | None = None) -> DataFrame:
    """Adds index: the place of each sequence among all of the chosen streams, which follow each other by name."""
    mine = packed if streams is None else packed.filter(F.col("stream").isin(*streams))
    # a row for each stream
    sizes = mine.groupBy("stream").agg((F.max("seq") + 1).alias("_n")).withColumn("_base", F.coalesce(F.sum("_n").over(Window.orderBy("stream").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    return mine.join(F.broadcast(sizes.drop("_n")) if sizes.count() < 100_000 else sizes.drop("_n"), "stream").withColumn("index", F.col("_base") + F.col("seq")).drop("_base")
