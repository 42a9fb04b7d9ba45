"""Quality measurements of documents, and verdicts under thresholds that can change without another pass.

measure() never decides: length, repetition, links, markup and replacement characters become columns.
score() turns them into reasons. The repetition measures look at every n-gram of one document and at
nothing else, so they run in one Arrow pass without a shuffle.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from waraq.config import Quality
from waraq.functions.text import matched_chars, rate, text_or_empty
from waraq.session import spread

# What counts as a link, a tag and an entity.
URL = r"(?i:https?://|www\.)[^\s<>\"'،؛)\]}]+"
TAG = r"</?[A-Za-z][A-Za-z0-9]*(?:\s[^<>]{0,200})?/?>"
ENTITY = r"&(?:[A-Za-z][A-Za-z0-9]{1,31}|#\d{1,7}|#[Xx][0-9A-Fa-f]{1,6});"


def _spans(text: str, most: int | None) -> tuple[list[str], list[int], list[int], int]:
    """Words, where they begin and end, and the characters that ratios are over."""
    words, starts, ends, at = [], [], [], 0
    pieces = text.split()
    for w in pieces[:most]:
        at = text.index(w, at)
        words.append(w.lower())
        starts.append(at)
        at += len(w)
        ends.append(at)
    return words, starts, ends, (ends[-1] if len(words) < len(pieces) else len(text))


def repetition(text: str, top: tuple, dup: tuple, most: int | None = None) -> tuple[float, list[float], list[float]]:
    """(share of characters in repeated lines, top n-gram ratios, repeated n-gram ratios), of the whole text or its first words."""
    rows = [x for x in (line.strip() for line in text.replace("\r", "\n").split("\n")) if x]
    seen = Counter(rows)
    total = sum(map(len, rows))
    dup_lines = sum(len(x) for x in rows if seen[x] > 1) / total if total else 0.0
    words, starts, ends, chars = _spans(text, most)
    tops, dups = [], []
    for n in top:
        grams = [" ".join(words[i : i + n]) for i in range(len(words) - n + 1)]
        if not grams or not chars:
            tops.append(0.0)
            continue
        gram, times = Counter(grams).most_common(1)[0]
        tops.append(min(times * len(gram) / chars, 1.0) if times > 1 else 0.0)
    for n in dup:
        grams = list(zip(*(words[k:] for k in range(n))))
        count = Counter(grams)
        covered, end = 0, -1
        for i, g in enumerate(grams):
            if count[g] > 1:
                last = ends[i + n - 1]
                covered += max(0, last - max(starts[i], end))
                end = max(end, last)
        dups.append(covered / chars if chars else 0.0)
    return dup_lines, tops, dups


def measure(docs: DataFrame, config: Quality = Quality(), id_col: str = "doc_id", text_col: str = "text", carry: tuple[str, ...] = ()) -> DataFrame:
    """(id, carried columns.., chars, words, dup_line_ratio, top_{n}gram.., dup_{n}gram.., url_ratio, html_ratio, replacement_rate)."""
    top, dup = [n for n, _ in config.top_ngram], [n for n, _ in config.dup_ngram]
    held = [c for c in carry if c != id_col]
    source = spread(docs.select(F.col(id_col).alias("_id"), text_or_empty(F.col(text_col)).alias("_text"), *held))
    t = F.col("_text")
    native = source.select(
        "_id",
        "_text",
        *held,
        F.length(t).alias("chars"),
        rate(matched_chars(t, URL), F.length(t)).alias("url_ratio"),
        rate(matched_chars(t, TAG) + matched_chars(t, ENTITY), F.length(t)).alias("html_ratio"),
        rate(F.regexp_count(t, F.lit("\\x{FFFD}")), F.length(t)).alias("replacement_rate"),
    )
    names = ["dup_line_ratio", *(f"top_{n}gram" for n in top), *(f"dup_{n}gram" for n in dup)]
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            words, columns = [], [[] for _ in names]
            for text in b.column(1).to_pylist():
                lines, tops, dups = repetition(text, top, dup)
                words.append(len(text.split()))
                for column, x in zip(columns, (lines, *tops, *dups)):
                    column.append(x)
            yield pa.RecordBatch.from_arrays([b.column(0), *b.columns[2:], pa.array(words, pa.int32()), *(pa.array(c, pa.float64()) for c in columns)], [id_col, *b.schema.names[2:], "words", *names])

    kept = "".join(f"{f.name} {f.dataType.simpleString()}, " for f in native.schema.fields if f.name in held)
    return native.mapInArrow(run, f"{id_col} {kind}, {kept}chars int, url_ratio double, html_ratio double, replacement_rate double, words int, " + ", ".join(f"{n} double" for n in names))


def reasons(config: Quality = Quality(), script_share: Column | None = None, script_floor: Column | None = None) -> Column:
    """Every rule is evaluated; the array keeps the order of the rules."""
    above = lambda name, limit, reason: F.when(F.col(name) > limit, reason)
    rules = [F.when((F.col("chars") < config.min_chars) | (F.col("words") < config.min_words), "too_short")]
    if script_share is not None:
        rules.append(F.when(script_share < script_floor, "script_ratio"))
    rules.append(above("dup_line_ratio", config.max_dup_line_ratio, "repetition:dup_lines"))
    rules += [above(f"top_{n}gram", limit, f"repetition:top_{n}gram") for n, limit in config.top_ngram]
    rules += [above(f"dup_{n}gram", limit, f"repetition:dup_{n}gram") for n, limit in config.dup_ngram]
    rules += [above("url_ratio", config.max_url_ratio, "url_density"), above("html_ratio", config.max_html_ratio, "html_residue"), above("replacement_rate", config.max_replacement_rate, "replacement_chars")]
    return F.array_compact(F.array(*rules))


def families(found: Column) -> Column:
    return F.array_distinct(F.transform(found, lambda r: F.split(r, ":")[0]))


def score(measured: DataFrame, config: Quality = Quality(), **script: Column) -> DataFrame:
    """Adds reasons, families and kept."""
    out = measured.withColumn("reasons", reasons(config, **script))
    return out.withColumn("families", families(F.col("reasons"))).withColumn("kept", F.size("reasons") == 0)


def family_counts(scored: DataFrame) -> DataFrame:
    """(family, fired, sole): rejections by family, and those that no other family shares."""
    return scored.select(F.explode("families").alias("family"), (F.size("families") == 1).alias("alone")).groupBy("family").agg(F.count("*").alias("fired"), F.count_if("alone").alias("sole"))


def percentiles(measured: DataFrame, metrics: list[str], points: tuple = (0.01, 0.05, 0.25, 0.5, 0.75, 0.95, 0.99)) -> DataFrame:
    """(metric, point, value): nearest-rank percentiles, exact.

    Values are counted first (the counts of distinct values, spread over tasks), and ranks come from
    running sums over ranges of values, so no task sorts the whole corpus.
    """
    long = measured.select(F.explode(F.array(*(F.struct(F.lit(m).alias("metric"), F.col(m).cast("double").alias("value")) for m in metrics))).alias("x")).select("x.*")
    counts = long.groupBy("metric", "value").agg(F.count("*").alias("n"))
    coarse = F.floor(F.log2(F.col("value") + 1e-9) * 64)  # about a hundredth of the value: a few thousand bins in all
    counts = counts.withColumn("bin", coarse)
    bins = counts.groupBy("metric", "bin").agg(F.sum("n").alias("bin_n"))
    order = Window.partitionBy("metric").orderBy("bin")
    bins = bins.withColumn("before", F.coalesce(F.sum("bin_n").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).withColumn("total", F.sum("bin_n").over(Window.partitionBy("metric")))
    inside = Window.partitionBy("metric", "bin").orderBy("value").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    placed = counts.join(bins.select("metric", "bin", "before", "total"), ["metric", "bin"]).withColumn("upto", F.col("before") + F.sum("n").over(inside))
    wanted = placed.withColumn("point", F.explode(F.array(*(F.lit(p) for p in points)))).withColumn("rank", F.least(F.floor(F.col("point") * F.col("total")), F.col("total") - 1))
    return wanted.filter((F.col("rank") < F.col("upto")) & (F.col("rank") >= F.col("upto") - F.col("n"))).select("metric", "point", "value")
