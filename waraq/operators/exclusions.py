"""Exclusion lists: ids with the reading plan they hold for, and their application by anti-join."""

from __future__ import annotations

import json

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

HEADER = "#!exclusions "


def write(ids: DataFrame, path: str, stage: str, plans: dict[str, str], id_col: str = "doc_id") -> None:
    """A folder of text files of ids and a header with their number and the plans that they were found under."""
    spark = ids.sparkSession
    distinct = ids.select(F.col(id_col).cast("string").alias("value")).distinct()
    distinct.write.mode("overwrite").text(f"{path}/ids")
    head = {"version": 1, "stage": stage, "count": spark.read.text(f"{path}/ids").count(), "plans": plans}
    spark.createDataFrame([(HEADER + json.dumps(head, sort_keys=True),)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/header")


def read(spark: SparkSession, path: str, plans: dict[str, str] | None = None) -> DataFrame:
    """(doc_id); raises where the header is missing, the count is off, or a plan is another one."""
    head = spark.read.text(f"{path}/header").first()
    if head is None or not head[0].startswith(HEADER):
        raise ValueError(f"{path} has no header")
    info = json.loads(head[0][len(HEADER) :])
    ids = spark.read.text(f"{path}/ids").select(F.col("value").alias("doc_id"))
    if (n := ids.count()) != info["count"]:
        raise ValueError(f"{path} has {n} ids, its header says {info['count']}")
    for source, plan in (plans or {}).items():
        if info["plans"].get(source, plan) != plan:
            raise ValueError(f"{path} was made under another plan of {source}")
    return ids


def union(*lists: DataFrame) -> DataFrame:
    out = lists[0].select("doc_id")
    for x in lists[1:]:
        out = out.unionByName(x.select("doc_id"))
    return out.distinct()


def apply(docs: DataFrame, excluded: DataFrame, id_col: str = "doc_id") -> DataFrame:
    return docs.join(excluded.select(F.col("doc_id").alias("_x")).distinct(), F.col(id_col).cast("string") == F.col("_x"), "left_anti")


def report(docs: DataFrame, excluded: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """(listed, hits, unapplied): ids of the list that documents have, and those that none has."""
    listed = excluded.select("doc_id").distinct()
    met = docs.select(F.col(id_col).cast("string").alias("doc_id")).distinct().withColumn("hit", F.lit(1))
    return listed.join(met, "doc_id", "left").agg(F.count("*").alias("listed"), F.count("hit").alias("hits"), (F.count("*") - F.count("hit")).alias("unapplied"))


def coverage(spark: SparkSession, paths: list[str], sources: list[str]) -> DataFrame:
    """(name, verdict, stages): each source that is read, covered by the lists or not, and each list without a header; a row for each."""
    rows, stages_of = [], {}
    for path in paths:
        try:
            head = spark.read.text(f"{path}/header").first()
        except AnalysisException:
            head = None
        if head is None or not head[0].startswith(HEADER):
            rows.append((path, "headerless", []))
            continue
        info = json.loads(head[0][len(HEADER) :])
        for source in info["plans"]:
            stages_of.setdefault(source, set()).add(info["stage"])
    rows += [(s, "covered" if s in stages_of else "uncovered", sorted(stages_of.get(s, ()))) for s in sources]
    return spark.createDataFrame(rows, "name string, verdict string, stages array<string>")


def union_of_stages(lists: dict[str, DataFrame]) -> DataFrame:
    """(doc_id, stages): the ids of several stages' lists, each once, with the stages that removed it."""
    out = None
    for stage, ids in lists.items():
        part = ids.select(F.col("doc_id").cast("string").alias("doc_id"), F.lit(stage).alias("stage"))
        out = part if out is None else out.unionByName(part)
    return out.groupBy("doc_id").agg(F.array_sort(F.collect_set("stage")).alias("stages"))
