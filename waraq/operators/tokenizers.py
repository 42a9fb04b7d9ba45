"""Sizes of texts under a tokenizer, and fertility reports."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from waraq.functions.text import rate, text_or_empty, tokens
from waraq.session import spread

_loaded: dict[str, object] = {}


def _model(path: str):
    import sentencepiece

    if path not in _loaded:
        _loaded[path] = sentencepiece.SentencePieceProcessor(model_file=path)
    return _loaded[path]


def encode_pieces(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, ids) by a SentencePiece model file that all workers can read; no ids for null and empty texts."""
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = _model(path)
        for b in batches:
            ids = model.encode(b.column(1).to_pylist(), num_threads=1)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(ids, pa.list_(pa.int32()))], [id_col, "ids"])

    return spread(docs.select(id_col, text_or_empty(F.col(text_col)).alias("text"))).mapInArrow(run, f"{id_col} {kind}, ids array<int>")


def fertility(sized: DataFrame, by: str, text_col: str = "text", size_col: str = "n_tokens") -> DataFrame:
    """(by, documents, tokens, chars_per_token, bytes_per_token, tokens_per_word)."""
    t = text_or_empty(F.col(text_col))
    d = sized.select(F.col(by).alias(by), F.col(size_col).cast("bigint").alias("n"), F.length(t).cast("bigint").alias("c"), F.octet_length(t).cast("bigint").alias("b"), F.size(tokens(t)).cast("bigint").alias("w"))
    sums = d.groupBy(by).agg(F.count("*").alias("documents"), F.sum("n").alias("tokens"), F.sum("c").alias("c"), F.sum("b").alias("b"), F.sum("w").alias("w"))
    return sums.select(by, "documents", "tokens", rate(F.col("c"), F.col("tokens")).alias("chars_per_token"), rate(F.col("b"), F.col("tokens")).alias("bytes_per_token"), rate(F.col("tokens"), F.col("w")).alias("tokens_per_word"))


def draw_summary(df: DataFrame, by: str, value: str) -> DataFrame:
    """(by, n, mean, sd, sem, least, most) of repeated draws of a score."""
    s = df.filter(F.col(value).isNotNull()).groupBy(by).agg(F.count("*").alias("n"), F.avg(value).alias("mean"), F.coalesce(F.stddev_samp(value), F.lit(0.0)).alias("sd"), F.min(value).alias("least"), F.max(value).alias("most"))
    return s.select(by, "n", "mean", "sd", (F.col("sd") / F.sqrt("n")).alias("sem"), "least", "most")
