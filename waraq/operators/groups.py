"""What is known of a group, brought back to each of its members, and the members of a group in pairs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SALTS = 16
#: Members of a group that meet in one place.
BLOCK = 1000


def salt(id_col: str) -> Column:
    return F.pmod(F.xxhash64(id_col), F.lit(SALTS))


def with_group(rows: DataFrame, key: str, id_col: str, *aggregates: Column) -> DataFrame:
    """rows with the aggregates of their group.

    The group's row goes to as many (key, salt) places as the group has, so a group that holds a third of
    all rows is joined in SALTS tasks, and one of a single row in one place.
    """
    salted = rows.withColumn("_salt", salt(id_col))
    sums = salted.groupBy(key).agg(*aggregates, F.collect_set("_salt").alias("_salts"))
    return salted.join(sums.withColumn("_salt", F.explode("_salts")).drop("_salts"), [key, "_salt"]).drop("_salt")


def pairs_within(rows: DataFrame, key: str, id_col: str) -> DataFrame:
    """(a, b), a < b: the ids of each group in pairs; rows: distinct (id, key).

    A group is dealt into blocks that meet pairwise, so the pairs of a group of any size come from many tasks.
    """
    several = with_group(rows.select(key, id_col), key, id_col, F.count("*").alias("_n")).filter(F.col("_n") > 1)
    blocks = F.ceil(F.col("_n") / BLOCK)
    dealt = several.select(key, id_col, blocks.alias("_of"), F.pmod(F.xxhash64(F.lit("block"), id_col), blocks).alias("_own"))
    x = dealt.select(key, F.col("_own").alias("_i"), F.explode(F.sequence("_own", F.col("_of") - 1)).alias("_j"), F.col(id_col).alias("_x"))
    y = dealt.select(key, F.explode(F.sequence(F.lit(0).cast("bigint"), "_own")).alias("_i"), F.col("_own").alias("_j"), F.col(id_col).alias("_y"))
    met = x.join(y, [key, "_i", "_j"]).filter((F.col("_i") < F.col("_j")) | (F.col("_x") < F.col("_y")))
    return met.select(F.least("_x", "_y").alias("a"), F.greatest("_x", "_y").alias("b"))
