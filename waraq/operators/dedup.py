"""Exact deduplication of documents and lines. Survivors depend on ids and texts, never on order."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from waraq.functions.text import WS, canonical, key, lines, text_or_empty
from waraq.operators.groups import salt, with_group


def keyed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Adds doc_key (a digest of the id, so that no source is favoured) and content_hash."""
    return docs.withColumn("doc_key", key("dedup/k", F.col(id_col).cast("string"))).withColumn("content_hash", key("dedup/c", canonical(F.col(text_col))))


def groups(docs: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """One row per distinct content; aggregated before the shuffle, so a huge group is a few partial rows."""
    return docs.groupBy("content_hash").agg(F.count("*").alias("group_size"), F.min(F.struct("doc_key", F.col(id_col).alias("id"))).alias("first"))


def verdicts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, content_hash, group_size, kept): kept is the document of the smallest key."""
    k = keyed(docs.select(id_col, text_col), id_col, text_col).drop(text_col)
    return with_group(k, "content_hash", id_col, F.count("*").alias("group_size"), F.min(F.struct("doc_key", F.col(id_col).alias("id"))).alias("first")).select(id_col, "content_hash", "group_size", (F.col(id_col) == F.col("first.id")).alias("kept"))


def largest_groups(docs: DataFrame, top: int = 20, examples: int = 4, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The report of the largest groups: size, survivor and the lowest other ids.

    The largest groups are chosen from counts; only their rows are looked at again.
    """
    k = keyed(docs.select(id_col, text_col), id_col, text_col).drop(text_col)
    best = groups(k, id_col).filter(F.col("group_size") > 1).orderBy(F.desc("group_size"), "content_hash").limit(top)
    rest = k.join(F.broadcast(best.select("content_hash")), "content_hash", "left_semi").withColumn("_salt", F.pmod(F.xxhash64(id_col), F.lit(64)))
    within = Window.partitionBy("content_hash", "_salt").orderBy(id_col)
    few = rest.withColumn("_r", F.row_number().over(within)).filter(F.col("_r") <= examples)
    least = few.groupBy("content_hash").agg(F.array_join(F.slice(F.array_sort(F.collect_list(id_col)), 1, examples), ",").alias("example_ids"))
    return best.join(least, "content_hash").select("content_hash", "group_size", F.col("first.id").alias("kept_id"), "example_ids")


def statistics(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Documents, distinct contents, groups of copies, removable documents and the largest group."""
    sizes = keyed(docs.select(id_col, text_col), id_col, text_col).groupBy("content_hash").agg(F.count("*").alias("n"))
    return sizes.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("documents"),
        F.count("*").alias("distinct_documents"),
        F.count_if(F.col("n") > 1).alias("groups"),
        F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("duplicates"),
        F.coalesce(F.max("n"), F.lit(0)).alias("largest_group"),
    )


def cross_source(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """(source_a, source_b, groups): contents that two sources share."""
    k = keyed(docs.select(id_col, text_col, source_col), id_col, text_col).select("content_hash", F.coalesce(source_col, F.lit("")).alias("s"))
    sets = k.groupBy("content_hash").agg(F.array_sort(F.collect_set("s")).alias("s")).filter(F.size("s") > 1)
    first = sets.select("s", F.explode("s").alias("source_a"))
    return first.select("source_a", F.explode(F.filter("s", lambda x: x > F.col("source_a"))).alias("source_b")).groupBy("source_a", "source_b").agg(F.count("*").alias("groups"))


def removed_by_source(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """(source, documents, removed, removed_cross): removed_cross lost to a survivor of another source."""
    k = keyed(docs.select(id_col, text_col, source_col), id_col, text_col).drop(text_col).withColumn("s", F.coalesce(source_col, F.lit("")))
    lost = F.col(id_col) != F.col("first.id")
    found = with_group(k, "content_hash", id_col, F.min(F.struct("doc_key", F.col(id_col).alias("id"), "s")).alias("first"))
    return found.groupBy(F.col("s").alias("source")).agg(F.count("*").alias("documents"), F.count_if(lost).alias("removed"), F.count_if(lost & (F.col("s") != F.col("first.s"))).alias("removed_cross"))


def survivors(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs that exact deduplication keeps."""
    kept = verdicts(docs, id_col, text_col).filter("kept").select(id_col)
    return docs.join(kept, id_col, "left_semi")


def line_index(docs: DataFrame, min_chars: int = 60, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(line_hash, documents, line_chars, owner, salts): each distinct line, in how many documents, whose it stays, and where its holders are."""
    doc_key = key("dedup/k", F.col(id_col).cast("string"))
    each = docs.select(id_col, doc_key.alias("doc_key"), F.explode(F.array_distinct(F.filter(lines(F.col(text_col)), lambda x: F.length(x) >= min_chars))).alias("line"))
    return each.groupBy(F.md5("line").alias("line_hash")).agg(F.count("*").alias("documents"), F.max(F.length("line")).alias("line_chars"), F.min(F.struct("doc_key", F.col(id_col).alias("id")))["id"].alias("owner"), F.collect_set(salt(id_col)).alias("salts"))


def line_statistics(docs: DataFrame, min_chars: int = 60, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    found = line_index(docs, min_chars, id_col, text_col)
    n, c = F.col("documents"), F.col("line_chars")
    total = lambda x: F.coalesce(F.sum(x), F.lit(0)).cast("bigint")
    return found.agg(F.count("*").alias("distinct_lines"), F.count_if(n > 1).alias("shared_lines"), total(n * c).alias("line_chars"), total(F.when(n > 1, n * c)).alias("shared_chars"), total(F.when(n > 1, (n - 1) * c)).alias("removable_chars"))


def strip_lines(docs: DataFrame, min_chars: int = 60, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, text, removed_lines): shared lines stay in their owner only; no document is emptied.

    Only the lines to remove are shuffled back to their documents.
    """
    index = line_index(docs, min_chars, id_col, text_col).filter(F.col("documents") > 1)
    shared = index.select("line_hash", "owner", F.explode("salts").alias("_salt"))
    long = docs.select(id_col, F.explode(F.array_distinct(F.filter(lines(F.col(text_col)), lambda x: F.length(x) >= min_chars))).alias("line"))
    drop = long.select(id_col, F.md5("line").alias("line_hash"), salt(id_col).alias("_salt")).join(shared, ["line_hash", "_salt"]).filter(F.col(id_col) != F.col("owner")).groupBy(id_col).agg(F.collect_set("line_hash").alias("drop"))
    raw = F.split(text_or_empty(F.col(text_col)), "\n")
    stripped = lambda x: F.regexp_replace(x, f"^{WS}+|{WS}+$", "")
    kept = F.filter(raw, lambda x: ~F.array_contains(F.coalesce(F.col("drop"), F.array().cast("array<string>")), F.md5(stripped(x))))
    joined = docs.select(id_col, text_col).join(drop, id_col, "left").withColumn("_kept", kept)
    empty = ~F.exists("_kept", lambda x: stripped(x) != "")
    return joined.select(id_col, F.when(empty, text_or_empty(F.col(text_col))).otherwise(F.array_join("_kept", "\n")).alias("text"), F.when(empty, F.lit(0)).otherwise(F.size(raw) - F.size("_kept")).alias("removed_lines"))


def variants(docs: DataFrame, other_text: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(variant, distinct_documents): how many contents there are under each of two forms of the texts."""
    both = docs.select(F.explode(F.array(F.struct(F.lit(text_col).alias("variant"), key("dedup/c", canonical(F.col(text_col))).alias("h")), F.struct(F.lit(other_text).alias("variant"), key("dedup/c", canonical(F.col(other_text))).alias("h")))).alias("x")).select("x.*")
    return both.distinct().groupBy("variant").agg(F.count("*").alias("distinct_documents"))
