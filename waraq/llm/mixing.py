"""Problem 9: mixing sources to target weights by systematic sampling.

Sizes are tokens of a public tokenizer. A source of size T with target share s contributes N*s tokens
to a mixture of size N, so each of its documents is expected N*s/T times. Within a source the
documents' expected copies are added up along one order, one random offset is added, and a document
is emitted once for each integer boundary its interval crosses: never more than ceil(N*s/T) times.
The order runs through size classes, so that the tokens reached follow the documents reached.

The running sum is taken in levels (totals of size classes, of ranges of buckets, of buckets, then ranks
inside a bucket), so a source with any share of the rows is spread over many tasks and no level has many rows in one. Sums are integers in units of 2^-20
copies and therefore exact and independent of partitioning.

N is the largest size at which no source needs more than its max_repeats, unless given; with a larger
N the sources that reach their cap fall short, which the report shows.

Defined cases: documents of null or unlisted source have share 0; a null share is 0, a null max_repeats 1; documents without tokens are not
emitted; a listed source without tokens contributes nothing and the other shares are scaled up to 1
in proportion; an empty table gives an empty mixture; repeated rows are documents of their own;
columns other than id, text and source are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from waraq.llm.tokens import DEFAULT_VOCABULARY, count
from waraq.session import cut

UNIT = 1 << 20
#: Rows of a bucket of all classes, and buckets of a range.
BUCKET_ROWS, RANGE = 20_000, 1024


def _plan(sizes: list, targets: list, total_tokens: int | None) -> dict[str, tuple[float, int, int]]:
    """source -> (share aimed at, cap, expected copies of each document in units)."""
    have = {r["source"]: r["tokens"] for r in sizes if r["tokens"]}
    listed = {r["source"]: (r["target_share"], 1 if r["max_repeats"] is None else r["max_repeats"]) for r in targets if r["source"] is not None and (r["target_share"] or 0) > 0}
    usable = {s: v for s, v in listed.items() if s in have}
    scale = sum(v[0] for v in usable.values())
    if not usable:
        return {}
    usable = {s: (share / scale, cap) for s, (share, cap) in usable.items()}
    whole = min(cap * have[s] / share for s, (share, cap) in usable.items()) if total_tokens is None else total_tokens
    return {s: (share, cap, min(cap * UNIT, int(whole * share / have[s] * UNIT + 0.5))) for s, (share, cap) in usable.items()}


def mixture(documents: DataFrame, targets: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source", total_tokens: int | None = None, seed: int = 7, path: str = DEFAULT_VOCABULARY) -> tuple[DataFrame, DataFrame]:
    """(chosen, report).

    chosen: key, source, n_tokens and copies (at least 1) of each document of the mixture.
    report: for each source its target and actual share, tokens before and after, documents and copies.
    """
    spark = documents.sparkSession
    sized = cut(count(documents.select(F.col(key).alias("key"), F.col(source).alias("source"), F.col(text).alias("text")), "key", "text", path))
    totals = sized.groupBy("source").agg(F.sum("n_tokens").alias("tokens"), F.count("*").alias("docs"))
    # one row per source, and only those that targets list: targets is a small table of the caller's
    listed = targets.select("source", "target_share", "max_repeats")
    known = totals.join(listed.select("source"), "source", "left_semi").collect()
    plan = _plan(known, listed.collect(), total_tokens)
    rows = sum(r["docs"] for r in known)
    buckets = max(1, -(-rows // BUCKET_ROWS))
    planned = F.broadcast(spark.createDataFrame([(s, v[0], v[1], v[2]) for s, v in plan.items()], "source string, aimed double, cap int, units bigint"))
    order = F.xxhash64(F.lit(seed), F.col("key").cast("string"))
    use = (
        sized.filter(F.col("n_tokens") > 0)
        .join(planned, "source")
        .withColumn("_h", order)
        .withColumn("_class", F.floor(4 * F.log2("n_tokens")).cast("int"))
        .withColumn("_bucket", F.pmod(F.shiftright("_h", 8), F.lit(buckets)).cast("int"))
    )
    counts = cut(use.groupBy("source", "_class", "_bucket").agg(F.count("*").alias("n")).withColumn("_range", F.floor(F.col("_bucket") / RANGE)))
    levels, starts = (("source", "_class"), ("source", "_class", "_range"), ("source", "_class", "_range", "_bucket")), counts.withColumn("_start", F.lit(0).cast("bigint"))
    for level in levels:
        before = Window.partitionBy(*level[:-1]).orderBy(level[-1]).rowsBetween(Window.unboundedPreceding, -1)
        sums = counts.groupBy(*level).agg(F.sum("n").alias("n")).select(*level, F.coalesce(F.sum("n").over(before), F.lit(0)).alias("_more"))
        starts = starts.join(sums, list(level)).withColumn("_start", F.col("_start") + F.col("_more")).drop("_more")
    starts = starts.select("source", "_class", "_bucket", "_start")
    rank = F.row_number().over(Window.partitionBy("source", "_class", "_bucket").orderBy("_h", "key")) - 1
    offset = F.pmod(F.xxhash64(F.lit(seed), F.lit("offset"), F.col("source")), F.lit(UNIT))
    placed = use.withColumn("_rank", rank).join(starts, ["source", "_class", "_bucket"]).withColumn("_at", (F.col("_start") + F.col("_rank")) * F.col("units") + offset)
    copies = F.shiftright(F.col("_at") + F.col("units"), 20) - F.shiftright("_at", 20)
    chosen = placed.select(F.col("key").alias(key), "source", "n_tokens", copies.cast("int").alias("copies"), "cap").filter(F.col("copies") > 0)
    reached = chosen.groupBy("source").agg(F.sum(F.col("n_tokens") * F.col("copies")).alias("mixed_tokens"), F.sum("copies").alias("mixed_documents"), F.max("copies").alias("most_copies"))
    share_of_all = F.sum("mixed_tokens").over(Window.partitionBy(F.lit(1)))
    report = (
        totals.join(listed, "source", "full")
        .join(reached, "source", "left")
        .select(
            "source",
            F.coalesce("target_share", F.lit(0.0)).alias("target_share"),
            F.coalesce(F.col("mixed_tokens") / share_of_all, F.lit(0.0)).alias("actual_share"),
            F.coalesce("tokens", F.lit(0)).alias("tokens"),
            F.coalesce("docs", F.lit(0)).alias("documents"),
            F.coalesce("mixed_tokens", F.lit(0)).alias("mixed_tokens"),
            F.coalesce("mixed_documents", F.lit(0)).alias("mixed_documents"),
            F.coalesce("most_copies", F.lit(0)).alias("most_copies"),
            "max_repeats",
        )
    )
    return chosen.drop("cap"), report
