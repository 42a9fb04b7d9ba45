"""Train, validation and test by hash bucket, with nested arms, solved from a histogram of characters.

The histogram is one aggregation; bands are found with running sums over it (at most `buckets` rows a
population) and joined back by population. A stored histogram can be
solved again under other budgets without reading a document.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from waraq.config import Budgets, Splits


def bucketed(docs: DataFrame, config: Splits = Splits(), id_col: str = "doc_id") -> DataFrame:
    """Adds bucket: the halves of a pair (`id#part`) share theirs."""
    pair = F.substring_index(F.col(id_col).cast("string"), "#", 1)
    return docs.withColumn("bucket", F.pmod(F.conv(F.substring(F.md5(F.concat(F.lit(config.salt + "|"), pair)), 1, 15), 16, 10).cast("bigint"), F.lit(config.buckets)))


def histogram(docs: DataFrame, config: Splits = Splits(), id_col: str = "doc_id", population_col: str = "population", chars_col: str = "chars") -> DataFrame:
    """(population, bucket, chars) of non-empty buckets."""
    b = bucketed(docs.filter(F.col(population_col).isNotNull()), config, id_col)
    return b.groupBy(F.col(population_col).alias("population"), "bucket").agg(F.sum(F.coalesce(F.col(chars_col), F.lit(0)).cast("bigint")).alias("chars"))


def bands(hist: DataFrame, config: Splits = Splits()) -> DataFrame:
    """(population, validation_from, test_from, arm_{name}..): largest suffixes and prefixes within budget.

    Test is cut from above, validation below it, and the arms from below, where they may not pass the
    validation band. A cut never overshoots: it ends at the first bucket that would.
    """
    totals = hist.groupBy("population").agg(F.sum("chars").alias("total"))
    down = Window.partitionBy("population").orderBy(F.desc("bucket"))
    up = Window.partitionBy("population").orderBy("bucket")
    h = hist.join(totals, "population").withColumn("from_above", F.sum("chars").over(down)).withColumn("from_below", F.sum("chars").over(up))
    budget = F.floor(F.col("total") * config.heldout_share)
    test = h.groupBy("population").agg(F.coalesce(F.max(F.when(F.col("from_above") > budget, F.col("bucket") + 1)), F.lit(0)).alias("test_from"))
    h = h.join(test, "population")
    held = h.groupBy("population").agg(F.coalesce(F.sum(F.when(F.col("bucket") >= F.col("test_from"), F.col("chars"))), F.lit(0)).alias("test_chars"))
    h = h.join(held, "population")
    over = (F.col("bucket") < F.col("test_from")) & (F.col("from_above") - F.col("test_chars") > budget)
    validation = F.coalesce(F.max(F.when(over, F.col("bucket") + 1)), F.lit(0)).alias("validation_from")
    arm = lambda share: F.coalesce(F.min(F.when(F.col("from_below") > F.floor(F.col("total") * share), F.col("bucket"))), F.lit(config.buckets))
    out = h.groupBy("population", "test_from").agg(validation, *(arm(share).alias(f"arm_{name}") for name, share in config.arms))
    return out.select("population", "validation_from", "test_from", *(F.least(f"arm_{name}", "validation_from").alias(f"arm_{name}") for name, _ in config.arms))


def assign(docs: DataFrame, solved: DataFrame, config: Splits = Splits(), id_col: str = "doc_id", population_col: str = "population") -> DataFrame:
    """Adds bucket, split_name and arms; populations without bands are unassigned. solved has a row per population, which the planner broadcasts while it is small."""
    b = bucketed(docs, config, id_col).withColumn("population", F.col(population_col))
    j = b.join(solved, "population", "left")
    split = F.when(F.col("test_from").isNull(), "unassigned").when(F.col("bucket") >= F.col("test_from"), "test").when(F.col("bucket") >= F.col("validation_from"), "validation").otherwise("train")
    arms = F.array_compact(F.array(*(F.when(F.col("bucket") < F.col(f"arm_{name}"), name) for name, _ in config.arms)))
    names = [f"arm_{name}" for name, _ in config.arms]
    return j.withColumn("split_name", split).withColumn("arms", F.when(F.col("split_name") == "train", arms).otherwise(F.array().cast("array<string>"))).drop("test_from", "validation_from", *names)


def summary(assigned: DataFrame, chars_col: str = "chars") -> DataFrame:
    """(population, split_name, arm, documents, chars): arm is 'all' for the whole of a split."""
    arms = F.explode(F.concat(F.array(F.lit("all")), F.col("arms")))
    return assigned.withColumn("arm", arms).groupBy(F.coalesce("population", F.lit("")).alias("population"), "split_name", "arm").agg(F.count("*").alias("documents"), F.coalesce(F.sum(F.col(chars_col).cast("bigint")), F.lit(0)).alias("chars"))


def save(hist: DataFrame, path: str, config: Splits = Splits()) -> None:
    """The histogram with what it was made under, for later solving."""
    hist.withColumn("buckets", F.lit(config.buckets)).withColumn("salt", F.lit(config.salt)).write.mode("overwrite").parquet(path)


def resolve(spark: SparkSession, path: str, config: Splits = Splits()) -> DataFrame:
    """Bands from a stored histogram under other budgets; raises where it is empty or its buckets are others."""
    stored = spark.read.parquet(path)
    made = stored.select("buckets", "salt").distinct().limit(2).collect()
    if [tuple(r) for r in made] != [(config.buckets, config.salt)]:
        raise ValueError(f"the histogram at {path} is empty or was made under other buckets")
    return bands(stored.select("population", "bucket", "chars"), config)


# -- budgets in tokens


def budgets(spark: SparkSession, config: Budgets) -> DataFrame:
    """(population, band, size): the characters of each arm and held-out set that a sampled histogram must hold; a row for each setting."""
    rows = []
    for population, _ in config.targets:
        held = config.chars(population, config.heldout_tokens()) * config.sample_rate
        rows += [(population, "test", held), (population, "validation", held)]
        rows += [(population, f"arm_{name}", config.chars(population, tokens) * config.sample_rate) for name, tokens in config.arms]
    return spark.createDataFrame(rows, "population string, band string, size double")


def token_bands(hist: DataFrame, config: Budgets = Budgets()) -> DataFrame:
    """(population, band, bucket_from, bucket_to, chars, target, exhausted) of each population with a target.

    Test is the largest suffix within its budget, validation the largest below it, and each arm the largest prefix
    below that. exhausted tells that the buckets ran out before the budget did, which falling short by a part of one bucket is not.
    """
    spark = hist.sparkSession
    wanted = budgets(spark, config)
    of = lambda band: wanted.filter(F.col("band") == band).select("population", F.col("size").alias("budget"))
    down, up = Window.partitionBy("population").orderBy(F.desc("bucket")), Window.partitionBy("population").orderBy("bucket")
    h = hist.select("population", "bucket", "chars")
    all_ = wanted.select("population").distinct()

    def suffix(rows: DataFrame, band: str, upper: DataFrame) -> DataFrame:
        """upper: (population, bucket_to)."""
        run = rows.join(of(band), "population").withColumn("run", F.sum("chars").over(down))
        stop = run.groupBy("population").agg(F.max(F.when(F.col("run") > F.col("budget"), F.col("bucket") + 1)).alias("stop"), F.sum("chars").alias("total"), F.max(F.when(F.col("run") <= F.col("budget"), F.col("run"))).alias("chars"))
        out = upper.join(stop, "population", "left").join(of(band), "population")
        return out.select("population", F.lit(band).alias("band"), F.coalesce("stop", F.lit(0)).cast("bigint").alias("bucket_from"), F.col("bucket_to").cast("bigint").alias("bucket_to"), F.coalesce("chars", F.lit(0)).cast("bigint").alias("chars"), F.col("budget").alias("target"), (F.col("stop").isNull() & (F.coalesce("total", F.lit(0)) < F.col("budget"))).alias("exhausted"))

    below = lambda rows, band: rows.join(band.select("population", F.col("bucket_from").alias("_to")), "population").filter(F.col("bucket") < F.col("_to")).drop("_to")
    test = suffix(h, "test", all_.withColumn("bucket_to", F.lit(config.buckets)))
    rest = below(h, test)
    validation = suffix(rest, "validation", test.select("population", F.col("bucket_from").alias("bucket_to")))
    rest = below(rest, validation)
    out = test.unionByName(validation)
    upper = validation.select("population", F.col("bucket_from").alias("upper"))
    for name, _ in config.arms:
        run = rest.join(of(f"arm_{name}"), "population").withColumn("run", F.sum("chars").over(up))
        stop = run.groupBy("population").agg(F.min(F.when(F.col("run") > F.col("budget"), F.col("bucket"))).alias("stop"), F.sum("chars").alias("total"), F.max(F.when(F.col("run") <= F.col("budget"), F.col("run"))).alias("chars"))
        arm = upper.join(stop, "population", "left").join(of(f"arm_{name}"), "population")
        out = out.unionByName(arm.select("population", F.lit(f"arm_{name}").alias("band"), F.lit(0).cast("bigint").alias("bucket_from"), F.coalesce("stop", "upper").cast("bigint").alias("bucket_to"), F.coalesce("chars", F.lit(0)).cast("bigint").alias("chars"), F.col("budget").alias("target"), (F.col("stop").isNull() & (F.coalesce("total", F.lit(0)) < F.col("budget"))).alias("exhausted")))
    return out


def resolve_tokens(spark: SparkSession, path: str, config: Budgets) -> DataFrame:
    """token_bands() of a stored histogram, under corrected characters a token or other budgets; no document is read again."""
    stored = spark.read.parquet(path)
    made = stored.select("buckets", "salt").distinct().limit(2).collect()
    if [tuple(r) for r in made] != [(config.buckets, config.salt)]:
        raise ValueError(f"the histogram at {path} is empty or was made under other buckets")
    return token_bands(stored.select("population", "bucket", "chars"), config)


def funding(hist: DataFrame, config: Budgets = Budgets()) -> DataFrame:
    """(arm, population, supply_tokens, required_tokens, funded): whether each population's pool, scaled up from its sample, can give what an arm and the held-out sets ask of it."""
    spark = hist.sparkSession
    rows = [(f"{name}", p, dict(config.chars_per_token)[p], (tokens + 2 * config.heldout_tokens()) * config.share(p)) for name, tokens in config.arms for p, _ in config.targets]
    asked = spark.createDataFrame(rows, "arm string, population string, ratio double, required_tokens double")
    have = hist.groupBy("population").agg(F.sum("chars").alias("chars"))
    supply = F.coalesce("chars", F.lit(0)) / F.col("ratio") / config.sample_rate
    return asked.join(have, "population", "left").select("arm", "population", supply.alias("supply_tokens"), "required_tokens", (supply >= F.col("required_tokens")).alias("funded"))
