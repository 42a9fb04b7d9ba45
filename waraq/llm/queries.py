"""The pN_ queries: each problem's operator over its whole tables, with production parameters."""

from __future__ import annotations

import secrets
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from waraq.llm import copies, languages, leaks, lookalikes, mixing, mojibake, pii, repetition, spans, tokens
from waraq.session import cut, table

Query = Callable[[SparkSession, str], DataFrame]


def _p1_restored(spark: SparkSession, d: str) -> DataFrame:
    return mojibake.restored(table(spark, d, "probe_dedup_joint"), "record_id", "text")


def _p1_found(spark: SparkSession, d: str) -> DataFrame:
    return _p1_restored(spark, d).select("record_id").distinct()


def _p2_ledger(spark: SparkSession, d: str) -> DataFrame:
    return repetition.ledger(table(spark, d, "demo_pairs"), "idx", ["ar_text", "diff_text"])


def _p2_found(spark: SparkSession, d: str) -> DataFrame:
    return _p2_ledger(spark, d).filter(repetition.rejected("v1")).select("idx", "field_name").distinct()


def _p2_policy_ablation(spark: SparkSession, d: str) -> DataFrame:
    return repetition.ablation(_p2_ledger(spark, d), "v3")


def _p3_scan(spark: SparkSession, d: str) -> DataFrame:
    return pii.scan(table(spark, d, "pii_results"), "result_id", "text", table(spark, d, "known_names"))


def _secret(spark: SparkSession) -> bytes:
    """The key of the surrogates: the session's, else one of this run that nobody keeps."""
    named = spark.conf.get("spark.waraq.surrogates.key", None)
    return named.encode() if named else secrets.token_bytes(32)


def _p3_items(spark: SparkSession, d: str) -> DataFrame:
    return pii.items(_p3_scan(spark, d), "result_id", table(spark, d, "known_names"), _secret(spark)).drop("surrogate")


def _p3_found(spark: SparkSession, d: str) -> DataFrame:
    return _p3_items(spark, d).select("result_id", "category", "span_start").distinct()


def _p3_replaced(spark: SparkSession, d: str) -> DataFrame:
    return pii.replaced(cut(_p3_scan(spark, d)), "result_id", table(spark, d, "known_names"), _secret(spark))


def _p3_checks(spark: SparkSession, d: str) -> DataFrame:
    return pii.checks(cut(_p3_scan(spark, d)), "result_id", table(spark, d, "known_names"), _secret(spark))


def _p4_forms(spark: SparkSession, d: str) -> DataFrame:
    joint = table(spark, d, "probe_dedup_joint").select("record_id", "text")
    validation = table(spark, d, "quality_validation").select("record_id", F.col("excerpt").alias("text"))
    return lookalikes.consistent(joint.unionByName(validation), "record_id", "text").withColumnRenamed("key", "record_id")


def _p4_found(spark: SparkSession, d: str) -> DataFrame:
    return lookalikes.same_look(_p4_forms(spark, d).withColumnRenamed("record_id", "key"))


def _p4_classes(spark: SparkSession, d: str) -> DataFrame:
    return lookalikes.looks(_p4_forms(spark, d).withColumnRenamed("record_id", "key")).withColumnRenamed("key", "record_id")


def _p5_leaks(spark: SparkSession, d: str) -> DataFrame:
    return leaks.leaks(table(spark, d, "probe_decon_rup_survivors"), "doc_id", "doc", table(spark, d, "eval_items"), "item_id", "text").withColumnRenamed("item_id", "eval_id")


def _p5_found(spark: SparkSession, d: str) -> DataFrame:
    return _p5_leaks(spark, d).select("doc_id", "eval_id").distinct()


def _p6_copy_sets(spark: SparkSession, d: str) -> DataFrame:
    return copies.copy_sets(table(spark, d, "probe_dedup_wikipedia"), "row_id", "text")


def _p6_found(spark: SparkSession, d: str) -> DataFrame:
    return _p6_copy_sets(spark, d).filter(F.col("row_id") != F.col("keep_id")).select("keep_id", "row_id")


def _p7_segments(spark: SparkSession, d: str) -> DataFrame:
    return languages.segment_languages(table(spark, d, "segments"), table(spark, d, "label_samples"))


def _p7_documents(spark: SparkSession, d: str) -> DataFrame:
    return languages.document_languages(_p7_segments(spark, d))


def _p7_found(spark: SparkSession, d: str) -> DataFrame:
    found = cut(_p7_segments(spark, d))
    recorded = languages.latest_population(table(spark, d, "split_assignments"))
    documents = languages.document_languages(found).join(recorded, "doc_id", "left").select("doc_id", F.lit(-1).alias("seg_no"), "recorded", "label")
    every = found.select("doc_id", F.col("seg_no").cast("int").alias("seg_no"), "recorded", "label").unionByName(documents)
    return every.filter(~F.col("label").eqNullSafe(F.col("recorded"))).select("doc_id", "seg_no", "label").distinct()


def _p8_ids(spark: SparkSession, d: str) -> DataFrame:
    return tokens.encode(table(spark, d, "documents"), "doc_id", "text")


def _p9_mixture(spark: SparkSession, d: str) -> DataFrame:
    return mixing.mixture(table(spark, d, "documents"), table(spark, d, "mix_targets"))[0]


def _p9_shares(spark: SparkSession, d: str) -> DataFrame:
    return mixing.mixture(table(spark, d, "documents"), table(spark, d, "mix_targets"))[1]


def _p9_reached(spark: SparkSession, d: str) -> DataFrame:
    """(source, share_reached, within_cap) of each listed source: shares within a hundredth, or two copies of its largest document."""
    documents, targets = table(spark, d, "documents"), table(spark, d, "mix_targets")
    chosen, report = mixing.mixture(documents, targets)
    largest = chosen.groupBy("source").agg(F.max("n_tokens").alias("largest"))
    total = report.agg(F.sum("mixed_tokens").alias("total"))
    near = F.abs(F.col("actual_share") - F.col("target_share")) <= F.greatest(F.lit(0.01), 2 * F.coalesce("largest", F.lit(0)) / F.col("total"))
    # total is a single row
    return report.join(largest, "source", "left").join(F.broadcast(total)).filter(F.col("max_repeats").isNotNull()).select("source", near.alias("share_reached"), (F.col("most_copies") <= F.col("max_repeats")).alias("within_cap"))


def _p10_found(spark: SparkSession, d: str) -> DataFrame:
    return spans.SharedSpans(table(spark, d, "documents"), wants=("pairs",)).pairs()


def _p10_coverage(spark: SparkSession, d: str) -> DataFrame:
    documents = table(spark, d, "documents")
    return spans.SharedSpans(documents, wants=("spans",)).coverage(documents)


QUERIES: dict[str, Query] = {
    "p1_found": _p1_found,
    "p1_restored": _p1_restored,
    "p2_found": _p2_found,
    "p2_ledger": _p2_ledger,
    "p2_policy_ablation": _p2_policy_ablation,
    "p3_found": _p3_found,
    "p3_items": _p3_items,
    "p3_replaced": _p3_replaced,
    "p3_checks": _p3_checks,
    "p4_found": _p4_found,
    "p4_forms": _p4_forms,
    "p4_classes": _p4_classes,
    "p5_found": _p5_found,
    "p5_leaks": _p5_leaks,
    "p6_found": _p6_found,
    "p6_copy_sets": _p6_copy_sets,
    "p7_found": _p7_found,
    "p7_segments": _p7_segments,
    "p7_documents": _p7_documents,
    "p8_ids": _p8_ids,
    "p9_mixture": _p9_mixture,
    "p9_shares": _p9_shares,
    "p9_reached": _p9_reached,
    "p10_found": _p10_found,
    "p10_coverage": _p10_coverage,
}
