"""Samples, limits and orders that are functions of ids alone, so they don't depend on reading order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from waraq.functions.text import stable_unit


def hash_sample(df: DataFrame, share: float, salt: str, id_col: str = "doc_id") -> DataFrame:
    return df.filter(stable_unit(F.col(id_col).cast("string"), salt) < share)


def lowest_per_group(df: DataFrame, group: list[str], n: int, salt: str, id_col: str = "doc_id", salts: int = 32) -> DataFrame:
    """The n rows of each group with the lowest hash: a limit per source, or a sample per label.

    A first cut within salted parts of a group leaves at most n * salts of its rows for the final one.
    """
    by = df.withColumn("_u", F.md5(F.concat(F.lit(salt + "|"), F.col(id_col).cast("string")))).withColumn("_s", F.pmod(F.xxhash64(id_col), F.lit(salts)))
    part = by.withColumn("_r", F.row_number().over(Window.partitionBy(*group, "_s").orderBy("_u", id_col))).filter(F.col("_r") <= n)
    return part.withColumn("_r", F.row_number().over(Window.partitionBy(*group).orderBy("_u", id_col))).filter(F.col("_r") <= n).drop("_u", "_s", "_r")


def union_of(sources: dict[str, tuple[DataFrame, float]], salt: str, id_col: str = "doc_id") -> DataFrame:
    """Several sources, each at its own rate, with a source column."""
    out = None
    for name, (df, share) in sources.items():
        part = hash_sample(df, share, salt, id_col).withColumn("source", F.lit(name))
        out = part if out is None else out.unionByName(part, allowMissingColumns=True)
    return out


def epoch_rank(id_col: Column, seed: int, epoch: int) -> Column:
    """A sort key that permutes ids as a function of seed and epoch."""
    return F.md5(F.concat_ws("|", F.lit(seed), F.lit(epoch), id_col.cast("string")))


def assign_tasks(df: DataFrame, shares: dict[str, float], salt: str, id_col: str = "doc_id") -> DataFrame:
    """Adds task: each row's task by where its hash falls among the cumulated shares."""
    unit, total, at, out = stable_unit(F.col(id_col).cast("string"), salt), sum(shares.values()), 0.0, None
    for name, share in shares.items():
        at += share / total
        out = F.when(unit < at, name) if out is None else out.when(unit < at, name)
    return df.withColumn("task", out.otherwise(list(shares)[-1]))


def apportion(n: int, shares: dict[str, float], offset: float = 0.5) -> dict[str, int]:
    """Whole counts that sum to n, by systematic selection along the cumulated shares."""
    total, at, got = sum(shares.values()), 0.0, {}
    for name, share in shares.items():
        before, at = at, at + n * share / total
        got[name] = int(at + offset + 1e-9) - int(before + offset + 1e-9)
    return got


def validation_sample(scored: DataFrame, uniform: int, rejected: int, salt: str, id_col: str = "doc_id") -> DataFrame:
    """(id, stratum, family) for review: a uniform stratum, and one of rejected rows that begins with the rarest family.

    A rejected row counts for its rarest family; each family gives the rows with the lowest hash, up to an
    even share of the stratum.
    """
    every = lowest_per_group(scored.select(id_col, F.lit("uniform").alias("stratum"), F.lit("").alias("family")), ["stratum"], uniform, salt, id_col)
    fired = scored.filter(F.size("families") > 0).select(id_col, F.explode("families").alias("family"))
    counts = fired.groupBy("family").agg(F.count("*").alias("n"))
    mine = fired.join(F.broadcast(counts), "family").groupBy(id_col).agg(F.min(F.struct("n", "family"))["family"].alias("family"))
    share = -(-rejected // max(1, counts.count()))
    bad = lowest_per_group(mine, ["family"], share, salt, id_col).select(id_col, F.lit("rejected").alias("stratum"), "family")
    return every.select(id_col, "stratum", "family").unionByName(bad)


def rebalance(wanted: dict[str, float], reached: dict[str, float]) -> dict[str, float]:
    """Shares to ask for so that, with the losses seen so far, the wanted ones are reached; they sum to 1."""
    need = {k: w * w / reached[k] if reached.get(k) else w for k, w in wanted.items()}
    total = sum(need.values())
    return {k: v / total for k, v in need.items()}
