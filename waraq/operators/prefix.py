"""Running totals along a digest, within groups of any size."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def running_total(rows: DataFrame, by: str, order: str, size: str, id_col: str, name: str = "before", total: str | None = None) -> DataFrame:
    """Adds the sum of size before each row of its group, in order of a hex digest and then the id; and the group's total, if named.

    Sums are taken in three levels: of the 256 first ranges of the digest, of the 65,536 ranges of two bytes, and along the
    rows of one of these. So a group of any share of all rows is spread over as many tasks.
    """
    d = rows.withColumn("_r2", F.substring(order, 1, 4))
    fine = d.groupBy(by, "_r2").agg(F.sum(size).alias("_t")).withColumn("_r1", F.substring("_r2", 1, 2))
    coarse = fine.groupBy(by, "_r1").agg(F.sum("_t").alias("_c"))
    earlier = lambda *keys, at: Window.partitionBy(*keys).orderBy(at).rowsBetween(Window.unboundedPreceding, -1)
    coarse = coarse.withColumn("_b1", F.coalesce(F.sum("_c").over(earlier(by, at="_r1")), F.lit(0)))
    if total:
        coarse = coarse.withColumn(total, F.sum("_c").over(Window.partitionBy(by)))
    fine = fine.withColumn("_b2", F.coalesce(F.sum("_t").over(earlier(by, "_r1", at="_r2")), F.lit(0)))
    starts = fine.join(coarse, [by, "_r1"]).select(by, "_r2", (F.col("_b1") + F.col("_b2")).alias("_base"), *([total] if total else []))
    inside = Window.partitionBy(by, "_r2").orderBy(order, id_col).rowsBetween(Window.unboundedPreceding, -1)
    placed = d.withColumn("_in", F.coalesce(F.sum(size).over(inside), F.lit(0))).join(starts, [by, "_r2"])
    return placed.withColumn(name, F.col("_base") + F.col("_in")).drop("_r2", "_in", "_base")
