"""Streams of documents through the stages that look at one document at a time, and exact deduplication by batch."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from waraq.config import EvalSet
from waraq.functions.text import canonical, key
from waraq.operators import decontaminate


def read_parquet(spark: SparkSession, path: str, files_per_batch: int = 8) -> DataFrame:
    """New files of a folder; the schema is that of the files already there."""
    return spark.readStream.schema(spark.read.parquet(path).schema).option("maxFilesPerTrigger", files_per_batch).parquet(path)


def each_batch(stream: DataFrame, f: Callable[[DataFrame], DataFrame], out: str, checkpoint: str) -> StreamingQuery:
    """f over each batch, appended to a table; stops when all files there are have been read."""

    def write(batch: DataFrame, n: int) -> None:
        f(batch).withColumn("batch", F.lit(n)).write.mode("overwrite").parquet(f"{out}/batch={n}")

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def decontaminated(stream: DataFrame, items: DataFrame, out: str, checkpoint: str, spec: EvalSet = EvalSet("default")) -> StreamingQuery:
    """Documents of each batch without those that hold evaluation items."""

    def clean(batch: DataFrame) -> DataFrame:
        bad = decontaminate.verdicts(decontaminate.hits(batch, items, spec), spec).select("doc_id")
        return batch.join(bad.withColumnRenamed("doc_id", "_bad"), F.col("doc_id").cast("string") == F.col("_bad"), "left_anti")

    return each_batch(stream, clean, out, checkpoint)


def first_seen(stream: DataFrame, within: str, text_col: str = "text", time_col: str = "loaded_ts") -> DataFrame:
    """Of equal texts within a time the first to arrive: bounded state, and so not the survivor that the batch operator picks."""
    marked = stream.withColumn("content_hash", key("dedup/c", canonical(F.col(text_col))))
    return marked.withWatermark(time_col, within).dropDuplicatesWithinWatermark(["content_hash"])


def windowed_counts(stream: DataFrame, time_col: str, width: str, late: str, by: str) -> DataFrame:
    """(window, by, n) with rows up to `late` behind still counted."""
    return stream.withWatermark(time_col, late).groupBy(F.window(time_col, width), by).agg(F.count("*").alias("n"))
