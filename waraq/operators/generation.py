"""Metrics of generated text, lexicons and infilling scores."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from waraq.functions.text import let, ngrams, rate, tokens
from waraq.session import spread


def distinct_n(words: Column, n: int) -> Column:
    """Distinct n-grams over all; 0 where there is none."""
    return let(ngrams(words, n), lambda g: rate(F.size(F.array_distinct(g)), F.size(g)))


def statistics(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, n_words, distinct_1..4, repetition): repetition is 1 - distinct_4 where a 4-gram exists."""
    w = df.select(id_col, tokens(F.col(text_col)).alias("w"))
    out = w.select(id_col, F.size("w").alias("n_words"), *(distinct_n(F.col("w"), n).alias(f"distinct_{n}") for n in range(1, 5)))
    return out.withColumn("repetition", F.when(F.col("n_words") >= 4, 1 - F.col("distinct_4")).otherwise(0.0))


def prefix_echo(df: DataFrame, id_col: str, prefix_col: str, text_col: str, n: int = 4) -> DataFrame:
    """(id, echo): share of the text's n-grams that stand in its prefix."""
    p, t = ngrams(tokens(F.col(prefix_col)), n), ngrams(tokens(F.col(text_col)), n)
    echo = let(p, lambda ps: let(t, lambda ts: rate(F.size(F.filter(ts, lambda g: F.array_contains(ps, g))), F.size(ts))))
    return df.select(id_col, echo.alias("echo"))


def _longest_repeat(words: list[str]) -> int:
    """Words of the longest run that occurs twice, by doubling and halving on runs of hashed words."""
    low, high = 0, len(words)
    while high - low > 1:
        n = (low + high) // 2
        seen, again = set(), False
        for i in range(len(words) - n + 1):
            g = tuple(words[i : i + n])
            if g in seen:
                again = True
                break
            seen.add(g)
        low, high = (n, high) if again else (low, n)
    return low


def longest_repeated_run(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, longest_run). A run that repeats contains shorter ones that do, so halving finds the longest."""
    kind = df.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([_longest_repeat((t or "").split()) for t in b.column(1).to_pylist()], pa.int32())], [id_col, "longest_run"])

    return spread(df.select(id_col, text_col)).mapInArrow(run, f"{id_col} {kind}, longest_run int")


def commit_order(df: DataFrame, id_col: str, steps_col: str) -> DataFrame:
    """(id, in_order, same_pass): of neighbouring positions, how many were committed left to right, and in one pass."""
    s = F.col(steps_col)
    pairs = F.when(F.size(s) >= 2, F.transform(F.sequence(F.lit(0), F.size(s) - 2), lambda i: F.get(s, i + 1) - F.get(s, i))).otherwise(F.array().cast("array<int>"))
    return df.select(id_col, rate(F.size(F.filter(pairs, lambda d: d > 0)), F.size(pairs)).alias("in_order"), rate(F.size(F.filter(pairs, lambda d: d == 0)), F.size(pairs)).alias("same_pass"))


#: Words of letters and marks; the lexicon compares them without marks.
WORD = r"[\p{L}\p{M}]+"


def skeletons(text: Column) -> Column:
    bare = F.regexp_replace(F.coalesce(text, F.lit("")), r"\p{M}+", "")
    return F.filter(F.regexp_extract_all(bare, F.lit(r"(\p{L}+)"), F.lit(1)), lambda w: w.rlike(r"[\x{600}-\x{6FF}\x{750}-\x{77F}\x{FB50}-\x{FDFF}\x{FE70}-\x{FEFF}]"))


def lexicon(df: DataFrame, text_col: str = "text", min_count: int = 2) -> DataFrame:
    """(word, n) of Arabic-script words that occur often enough."""
    return df.select(F.explode(skeletons(F.col(text_col))).alias("word")).groupBy("word").agg(F.count("*").alias("n")).filter(F.col("n") >= min_count)


def unknown_rate(df: DataFrame, words: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, words, unknown): words of each text, and those that the lexicon lacks; texts without such words have no row."""
    each = df.select(id_col, F.explode(skeletons(F.col(text_col))).alias("word")).groupBy(id_col, "word").agg(F.count("*").alias("k"))
    joined = each.join(words.select("word", F.lit(1).alias("known")), "word", "left")
    return joined.groupBy(id_col).agg(F.sum("k").alias("words"), F.coalesce(F.sum(F.when(F.col("known").isNull(), F.col("k"))), F.lit(0)).alias("unknown"))


def infill_scores(df: DataFrame, gold_col: str, made_col: str, by: str) -> DataFrame:
    """(by, items, exact, f1): exact matches, and the mean multiset F1, of made tokens cut to the length of gold."""
    gold, made = F.col(gold_col), F.slice(F.col(made_col), F.lit(1), F.size(gold_col))
    same = F.aggregate(F.array_distinct(gold), F.lit(0), lambda a, x: a + F.least(F.size(F.filter(gold, lambda y: y == x)), F.size(F.filter(made, lambda y: y == x))))
    f1 = F.when(F.size(gold) + F.size(made) > 0, 2 * same / (F.size(gold) + F.size(made))).otherwise(1.0)
    return df.select(by, (gold == made).cast("int").alias("e"), f1.alias("f")).groupBy(by).agg(F.count("*").alias("items"), F.sum("e").alias("exact"), F.avg("f").alias("f1"))
