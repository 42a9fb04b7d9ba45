"""Declared sources: layouts, manifests, formats and document ids. Schemas are stated, never inferred."""

from __future__ import annotations

import hashlib
import json
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from waraq.operators.sampling import hash_sample


@dataclass(frozen=True)
class Layout:
    """Where a source keeps its text, its id and what else is carried along; unit is document or sentence."""

    text: str = "text"
    id: str | None = "id"
    meta: tuple = ()
    unit: str = "document"


LAYOUTS = {
    "web": Layout("text", "id", ("url", "dump", "date", "language", "language_script", "language_score", "minhash_cluster_size")),
    "encyclopedia": Layout("text", "id", ("url", "title")),
    "parallel": Layout("Roman-Urdu text", None, ("Urdu text",), "sentence"),
}


def project(df: DataFrame, source: str, layout: Layout, keep_empty: bool = False) -> DataFrame:
    """(source, doc_id, text, meta). A missing column is an error; null texts are empty and empty ones are skipped.

    Without an id column the position is the id: the file and the row in it, which Parquet knows.
    """
    missing = {layout.text, *([layout.id] if layout.id else []), *layout.meta} - set(df.columns)
    if missing:
        raise ValueError(f"{source} has no column {sorted(missing)}")
    positional = F.concat_ws(":", F.element_at(F.split(F.col("_metadata.file_path"), "/"), -1), F.col("_metadata.row_index"))
    local = F.col(layout.id).cast("string") if layout.id else positional
    meta = F.map_from_arrays(F.array(*(F.lit(m) for m in layout.meta)), F.array(*(F.col(m).cast("string") for m in layout.meta))) if layout.meta else F.create_map().cast("map<string,string>")
    out = df.select(F.lit(source).alias("source"), F.concat_ws(":", F.lit(source), local).alias("doc_id"), F.coalesce(F.col(layout.text), F.lit("")).alias("text"), meta.alias("meta"))
    return out if keep_empty else out.filter(F.trim("text") != "")


def parquet(spark: SparkSession, path: str | list[str], source: str, layout: Layout, **kw: bool) -> DataFrame:
    return project(spark.read.parquet(*([path] if isinstance(path, str) else path)), source, layout, **kw)


def csv(spark: SparkSession, path: str | list[str], schema: str) -> DataFrame:
    """RFC 4180 with line breaks in quoted fields and fields of any length."""
    return spark.read.schema(schema).option("header", True).option("multiLine", True).option("escape", '"').option("maxCharsPerColumn", -1).csv(path)


def jsonl(spark: SparkSession, path: str, field: str = "text") -> DataFrame:
    return spark.read.schema(f"`{field}` string").json(path).select(F.col(field).alias("text"))


def paragraphs(spark: SparkSession, path: str, min_chars: int = 1) -> DataFrame:
    """(doc_id, text) of the paragraphs of plain text files; the id is the file and the paragraph's number."""
    whole = spark.read.text(path, wholetext=True).select(F.element_at(F.split(F.col("_metadata.file_path"), "/"), -1).alias("file"), F.posexplode(F.split("value", r"\n[ \t]*\n")).alias("pos", "text"))
    return whole.select(F.concat_ws(":", "file", "pos").alias("doc_id"), F.trim("text").alias("text")).filter(F.length("text") >= min_chars)


def parallel_halves(pairs: DataFrame, id_col: str, roman_col: str, urdu_col: str) -> DataFrame:
    """(doc_id, text): both halves of each pair, named id#roman and id#urdu."""
    halves = F.array(F.struct(F.concat(F.col(id_col).cast("string"), F.lit("#roman")).alias("doc_id"), F.col(roman_col).alias("text")), F.struct(F.concat(F.col(id_col).cast("string"), F.lit("#urdu")).alias("doc_id"), F.col(urdu_col).alias("text")))
    return pairs.select(F.inline(halves)).filter(F.trim(F.coalesce("text", F.lit(""))) != "")


_FILES = "files array<struct<source:string,path:string,local_path:string,sha256:string,split:string,size:bigint>>"


def manifest(spark: SparkSession, path: str, source: str | None = None, split: str | None = None) -> DataFrame:
    """(source, path, local_path, sha256, split, size) in order, with forward slashes."""
    files = spark.read.schema(_FILES).option("multiLine", True).json(path).select(F.inline("files"))
    files = files.withColumn("local_path", F.translate("local_path", "\\", "/"))
    if source:
        files = files.filter(F.col("source") == source)
    if split:
        files = files.filter(F.col("split") == split)
    return files.orderBy("source", "path")


def manifest_problems(files: DataFrame) -> DataFrame:
    """(path, problem): digests of a wrong form, sizes that aren't positive, and paths that occur twice."""
    bad = files.select("path", F.explode(F.array_compact(F.array(F.when(~F.coalesce(F.col("sha256"), F.lit("")).rlike("^[0-9a-f]{64}$"), "sha256"), F.when(F.coalesce(F.col("size"), F.lit(0)) <= 0, "size")))).alias("problem"))
    twice = files.groupBy("path").agg(F.count("*").alias("n")).filter(F.col("n") > 1).select("path", F.lit("duplicate").alias("problem"))
    return bad.unionByName(twice)


def verify_files(spark: SparkSession, files: DataFrame, root: str) -> DataFrame:
    """(local_path, verdict): ok, missing, size or sha256, from the files themselves."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root).select(F.regexp_replace("path", f"^file:(//)?{root.rstrip('/')}/", "").alias("local_path"), F.col("length"), F.sha2("content", 256).alias("digest"))
    j = files.join(found, "local_path", "left")
    verdict = F.when(F.col("digest").isNull(), "missing").when(F.col("length") != F.col("size"), "size").when(F.col("digest") != F.col("sha256"), "sha256").otherwise("ok")
    return j.select("local_path", verdict.alias("verdict"))


def plan_fingerprint(digests: list[str], layout: Layout, share: float, salt: str, seed: int = 0) -> str:
    """What a read depends on; a limit doesn't change which documents come first."""
    return hashlib.sha256(json.dumps([sorted(digests), layout.text, layout.id, layout.meta, share, salt, seed]).encode()).hexdigest()[:16]


def sampled(docs: DataFrame, share: float, salt: str) -> DataFrame:
    return docs if share >= 1 else hash_sample(docs, share, salt)


def from_host(docs: DataFrame, part: str, url: Column | None = None) -> DataFrame:
    return docs.filter((url if url is not None else F.col("url")).contains(part))


def host(url: Column) -> Column:
    return F.regexp_replace(F.lower(F.try_parse_url(url, F.lit("HOST"))), r"^www\.", "")
