"""The composed curation plan: encoding, language, normalization, quality, redaction, exact, line and near deduplication, decontamination.

Each stage sees what the one before it left. All that looks at one document at a time is one narrow pass from the scan
to the verdict; evaluation items are normalized and redacted as the documents are before the two meet.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from waraq.config import Encoding, EvalSet, NearDup, Quality
from waraq.functions.text import rate
from waraq.operators import decontaminate, dedup, encoding, neardup, normalize, pii, quality, scripts
from waraq.session import cut


def stages(docs: DataFrame, quality_config: Quality = Quality(), profile: scripts.Profile = scripts.URDU_PROFILE) -> DataFrame:
    """(doc_id, source, text, label, reasons, kept): everything that looks at one document at a time.

    Language is judged on repaired text, quality on normalized text with the scripts found before; a document in another
    language has the reason 'language' and no other.
    """
    valid = encoding.validate(docs.select("doc_id", "source", "text"), Encoding())
    ok = valid.filter(F.col("enc.verdict").isin("ok", "repaired")).select("doc_id", "source", F.col("enc.text").alias("text"))
    labelled = scripts.classify(ok, profile)
    share = {s: rate(F.col("scripts")[s], F.col("scripts.letters")) for s in scripts.SCRIPTS}
    floors, shares = None, None
    for name, (expected, floor) in profile.expected.items():
        total = sum((share[s] for s in expected[1:]), share[expected[0]])
        floors = F.when(F.col("label") == name, floor) if floors is None else floors.when(F.col("label") == name, floor)
        shares = F.when(F.col("label") == name, total) if shares is None else shares.when(F.col("label") == name, total)
    flat = labelled.select("doc_id", "source", "label", shares.alias("script_share"), floors.alias("script_floor"), normalize.normalized(F.col("text")).alias("text"))
    measured = quality.measure(flat, quality_config, carry=("source", "label", "script_share", "script_floor", "text"))
    scored = quality.score(measured, quality_config, script_share=F.col("script_share"), script_floor=F.col("script_floor"))
    wanted = F.col("label").isin(*scripts.KEPT)
    judged = scored.select("doc_id", "source", "text", "label", F.when(wanted, F.col("reasons")).otherwise(F.array(F.lit("language"))).alias("reasons"), (wanted & F.col("kept")).alias("kept"))
    # only what stays goes on: the text of a rejected document is not needed again
    return pii.redacted(judged.withColumn("text", F.when(F.col("kept"), F.col("text"))))


def curate(docs: DataFrame, items: DataFrame, quality_config: Quality = Quality(), spec: EvalSet = EvalSet("default"), near_config: NearDup = NearDup(), profile: scripts.Profile = scripts.URDU_PROFILE) -> DataFrame:
    """(doc_id, source, label, stage, removed_lines): where each document leaves the plan, or 'kept', and the lines it lost to other documents."""
    passed = cut(stages(docs, quality_config, profile))
    good = passed.filter("kept").select("doc_id", "text")
    unique = cut(dedup.verdicts(good).select("doc_id", F.col("kept").alias("unique")))
    stripped = cut(dedup.strip_lines(neardup.without(good, unique.filter(~F.col("unique")))))
    texts = stripped.select("doc_id", "text")
    near = cut(neardup.verdicts(texts, near_config, every=True).filter(~F.col("kept")).select("doc_id", F.lit(True).alias("near")).distinct())
    dirty = decontaminate.verdicts(decontaminate.hits(neardup.without(texts, near), decontaminate.prepared(items), spec), spec).select(F.col("doc_id").alias("_d"), F.lit(True).alias("dirty"))
    joined = (
        docs.select("doc_id", F.coalesce("source", F.lit("")).alias("source"))
        .join(passed.select("doc_id", "label", "reasons", F.col("kept").alias("good")), "doc_id", "left")
        .join(unique, "doc_id", "left")
        .join(stripped.select("doc_id", "removed_lines"), "doc_id", "left")
        .join(near, "doc_id", "left")
        .join(dirty, F.col("doc_id").cast("string") == F.col("_d"), "left")
    )
    language = F.array_contains("reasons", "language")
    stage = F.when(F.col("good").isNull(), "encoding").when(language, "language").when(~F.col("good"), "quality").when(~F.col("unique"), "exact_duplicate").when(F.col("near"), "near_duplicate").when(F.col("dirty"), "contaminated").otherwise("kept")
    return joined.select("doc_id", "source", F.coalesce("label", F.lit("")).alias("label"), stage.alias("stage"), F.coalesce("removed_lines", F.lit(0)).alias("removed_lines"))
