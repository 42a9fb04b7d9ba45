"""Registry of the core queries: each operator over its whole tables."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from waraq import oracles
from waraq.config import Budgets, Damage, EvalSet, NearDup, Packing, Quality, Splits
from waraq.functions.text import h60, shingles, text_or_empty, tokens
from waraq.operators import analytics, corruption, decontaminate, dedup, encoding, exclusions, generation, neardup, normalize, packing, pii, quality, sampling, scripts, splits, tokenizers
from waraq.plans import pipeline
from waraq.session import cut, spread, table
from waraq.sources import readers

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES = oracles.ORACLES
SPLITS = Splits()


def query(f: Query) -> Query:
    QUERIES[f.__name__] = f
    return f


def _docs(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents")


def _items(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "eval_items").select("item_id", "text")


def _trained(spark: SparkSession, d: str) -> DataFrame:
    """(doc_id, text, source): documents that hold passages of items, items that were collected as documents, and the items themselves; rows repeat, and the operators count equal ones once."""
    rows = table(spark, d, "probe_decon_rup_survivors")
    documents = rows.select("doc_id", F.col("doc").alias("text"), F.lit("documents").alias("source"))
    copies = rows.filter(F.col("eval").isNotNull()).select(F.concat(F.lit("pair:"), F.col("pair_id").cast("string")).alias("doc_id"), F.col("eval").alias("text"), F.lit("pairs").alias("source"))
    return documents.unionByName(copies).unionByName(table(spark, d, "eval_items").select(F.col("item_id").alias("doc_id"), "text", F.lit("items").alias("source")))


def _sets(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "eval_items").select("item_id", "eval_set", "text")


SPECS = [EvalSet("reading-quiz", containment=0.6), EvalSet.for_sentences("parl-test-roman"), EvalSet.for_sentences("parl-test-urdu")]


@query
def exact_dedup_verdicts(spark, d):
    return dedup.verdicts(_docs(spark, d))


@query
def exact_dedup_groups(spark, d):
    return dedup.largest_groups(_docs(spark, d))


@query
def exact_dedup_statistics(spark, d):
    return dedup.statistics(_docs(spark, d))


@query
def exact_dedup_cross_source(spark, d):
    return dedup.cross_source(_docs(spark, d))


@query
def exact_dedup_removed_by_source(spark, d):
    return dedup.removed_by_source(_docs(spark, d))


@query
def line_dedup_statistics(spark, d):
    return dedup.line_statistics(dedup.survivors(_docs(spark, d)))


@query
def line_dedup_strip(spark, d):
    return dedup.strip_lines(dedup.survivors(_docs(spark, d))).select("doc_id", F.md5("text").alias("text_md5"), "removed_lines")


@query
def stable_sample(spark, d):
    return sampling.hash_sample(_docs(spark, d), 0.2, "sample-1").select("doc_id", "source")


@query
def lowest_per_source(spark, d):
    return sampling.lowest_per_group(_docs(spark, d).select("doc_id", "source"), ["source"], 7, "limit-1")


@query
def union_with_rates(spark, d):
    docs = _docs(spark, d).select("doc_id", "source")
    parts = {"news": (docs.filter("source = 'news'").drop("source"), 0.5), "forum": (docs.filter("source = 'forum'").drop("source"), 1.0)}
    return sampling.union_of(parts, "union-1")


@query
def epoch_order(spark, d):
    return _docs(spark, d).select("doc_id", sampling.epoch_rank(F.col("doc_id"), 3, 1).alias("rank_key"))


@query
def task_mixture(spark, d):
    shares = {"lm": 0.65, "infill": 0.10, "pair": 0.10, "restore": 0.08, "switch": 0.07}
    return sampling.assign_tasks(_docs(spark, d).select("doc_id"), shares, "tasks-1").groupBy("task").agg(F.count("*").alias("documents"))


@query
def encoding_rates(spark, d):
    t = text_or_empty(F.col("text"))
    return _docs(spark, d).select("doc_id", encoding.mojibake_chars(t).alias("mojibake_chars"), F.regexp_count(t, F.lit("\\x{FFFD}")).alias("replacement_chars"), F.regexp_count(t, F.lit(encoding.CONTROLS)).alias("control_chars"))


@query
def encoding_verdicts(spark, d):
    return encoding.validate(_docs(spark, d).select("doc_id", "text")).select("doc_id", "enc.verdict", "enc.chars", "enc.passes")


@query
def encoding_log(spark, d):
    return encoding.log(encoding.validate(_docs(spark, d).select("doc_id", "text")))


@query
def script_counts(spark, d):
    return _docs(spark, d).select("doc_id", scripts.script_counts(F.col("text")).alias("s")).select("doc_id", "s.*")


def _profile(spark: SparkSession, d: str) -> scripts.Profile:
    """Roman Urdu words by the labelled samples."""
    return scripts.Profile(roman_urdu=scripts.learned_words(table(spark, d, "label_samples")))


@query
def language_scores(spark, d):
    found = scripts.with_evidence(_docs(spark, d).select("doc_id", "text"), _profile(spark, d))
    return found.select("doc_id", *(F.round(f"scores.{c}", 9).alias(c) for c in ("urdu", "persian", "arabic", "roman_urdu", "english", "lowercase")))


@query
def language_labels(spark, d):
    return scripts.classify(_docs(spark, d).select("doc_id", "text"), _profile(spark, d)).select("doc_id", "label")


@query
def language_confusion(spark, d):
    return analytics.confusion(scripts.classify(_docs(spark, d).select("doc_id", "text", "lang"), _profile(spark, d)), "lang", "label")


@query
def normalize_text(spark, d):
    return normalize.normalize(_docs(spark, d).select("doc_id", "text")).select("doc_id", F.md5("norm.text").alias("text_md5"), "norm.chars_in", "norm.chars_out")


@query
def normalize_log(spark, d):
    return normalize.log(normalize.normalize(_docs(spark, d).select("doc_id", "text")))


def _measured(spark, d):
    return quality.measure(_docs(spark, d), Quality())


@query
def quality_metrics(spark, d):
    m = _measured(spark, d)
    return m.select(*(F.round(c, 9).alias(c) if t == "double" else F.col(c) for c, t in m.dtypes))


@query
def quality_verdicts(spark, d):
    return quality.score(_measured(spark, d)).select("doc_id", F.array_join("reasons", ",").alias("reasons"), "kept")


@query
def quality_family_counts(spark, d):
    return quality.family_counts(quality.score(_measured(spark, d)))


@query
def quality_sentence_variant(spark, d):
    config = Quality.for_sentences()
    return quality.score(quality.measure(_docs(spark, d), config), config).groupBy("kept").agg(F.count("*").alias("documents"))


@query
def quality_percentiles(spark, d):
    return quality.percentiles(_measured(spark, d), ["chars", "words", "dup_line_ratio", "top_3gram"]).withColumn("value", F.round("value", 9))


@query
def quality_agreement(spark, d):
    rows = table(spark, d, "quality_validation").select("record_id", "filter_verdict", "human_verdict").distinct()
    return analytics.agreement(rows, "filter_verdict", "human_verdict")


@query
def pii_emails(spark, d):
    return _docs(spark, d).select("doc_id", F.size(pii.emails(F.col("text"))).alias("n"), F.md5(pii.redact_emails(F.col("text"))).alias("text_md5"))


@query
def pii_shapes(spark, d):
    return pii.email_shapes(table(spark, d, "pii_results").select("result_id", "text").distinct())


@query
def pii_redact(spark, d):
    return pii.redact(table(spark, d, "pii_results"), "result_id").distinct()


@query
def shingle_counts(spark, d):
    hs = spread(_docs(spark, d).select("doc_id", "text")).select("doc_id", F.transform(shingles(F.col("text")), h60).alias("hs"))
    total = F.aggregate("hs", F.lit(0).cast("decimal(38,0)"), lambda a, x: a + x.cast("decimal(38,0)"))
    return hs.select("doc_id", F.size("hs").alias("n_shingles"), F.pmod(total, F.lit(1_000_000_007).cast("decimal(38,0)")).cast("bigint").alias("checksum"))


@query
def minhash_sketches(spark, d):
    return neardup.sketched(_docs(spark, d)).select(F.col("id").alias("doc_id"), "n_shingles", F.md5(F.array_join(F.col("bins").cast("array<string>"), ",")).alias("bins_md5"))


def _near(spark, d):
    sketches = cut(neardup.sketched(_docs(spark, d)))
    return sketches, cut(neardup.pairs(sketches))


@query
def minhash_pairs(spark, d):
    return _near(spark, d)[1]


@query
def near_dup_histogram(spark, d):
    return neardup.similarity_histogram(_near(spark, d)[1])


@query
def near_dup_verdicts(spark, d):
    return neardup.verdicts(_docs(spark, d))


@query
def near_dup_all_verdicts(spark, d):
    return neardup.verdicts(_docs(spark, d), every=True)


@query
def near_dup_sweep(spark, d):
    return neardup.sweep(_docs(spark, d), (0.5, 0.6, 0.7, 0.8, 0.9))


@query
def decontaminate_containments(spark, d):
    return decontaminate.containments(_trained(spark, d), _items(spark, d), EvalSet("all", retain=0.2)).select("doc_id", "item_id", "shared", F.round("containment", 9).alias("containment"), F.round("jaccard", 9).alias("jaccard"))


@query
def decontaminate_char_containments(spark, d):
    spec = EvalSet.for_sentences("all")
    return decontaminate.containments(_trained(spark, d), _items(spark, d), spec).select("doc_id", "item_id", "shared", F.round("containment", 9).alias("containment"), F.round("jaccard", 9).alias("jaccard"))


@query
def decontaminate_exact_documents(spark, d):
    return decontaminate.exact_documents(_trained(spark, d), _items(spark, d))


@query
def decontaminate_exact_lines(spark, d):
    return decontaminate.exact_lines(_trained(spark, d), _items(spark, d))


@query
def decontaminate_verdicts(spark, d):
    return decontaminate.verdicts(decontaminate.hits(_trained(spark, d), _items(spark, d))).withColumn("containment", F.round("containment", 9))


@query
def decontaminate_coverage(spark, d):
    sets = table(spark, d, "eval_items").select("item_id", "eval_set")
    return decontaminate.coverage(decontaminate.hits(_trained(spark, d), _items(spark, d)), _items(spark, d), sets)


@query
def decontaminate_sweep(spark, d):
    return decontaminate.sweep(decontaminate.hits(_trained(spark, d), _items(spark, d)), (0.5, 0.7, 0.8, 0.9))


@query
def decontaminate_report(spark, d):
    found = decontaminate.hits_by_set(_trained(spark, d), _sets(spark, d), SPECS)
    return decontaminate.report(found, SPECS, _trained(spark, d))


@query
def decontaminate_prepared_items(spark, d):
    return decontaminate.prepared(_sets(spark, d)).select("item_id", F.md5("text").alias("text_md5"))


def _population(spark, d):
    return _docs(spark, d).select("doc_id", F.col("lang").alias("population"), F.col("n_chars").alias("chars"), F.coalesce(F.octet_length("text"), F.lit(0)).alias("n_tokens"))


def _assigned(spark, d):
    docs = _population(spark, d)
    return splits.assign(docs, splits.bands(splits.histogram(docs, SPLITS), SPLITS), SPLITS)


@query
def split_histogram(spark, d):
    return splits.histogram(_population(spark, d), SPLITS)


@query
def split_bands(spark, d):
    return splits.bands(splits.histogram(_population(spark, d), SPLITS), SPLITS)


#: Budgets that the tables can partly meet: one population falls short.
BUDGETS = Budgets(arms=(("A", 3_000), ("B", 30_000)), targets=(("urdu", 80), ("roman_urdu", 15), ("english", 5)), chars_per_token=(("urdu", 3.5), ("roman_urdu", 4.2), ("english", 4.5)), heldout_sequences=8, sequence_length=128)


@query
def split_token_bands(spark, d):
    found = splits.token_bands(splits.histogram(_population(spark, d), BUDGETS), BUDGETS)
    return found.withColumn("target", F.round("target", 6))


@query
def split_token_bands_resolved(spark, d):
    """The same histogram solved for other characters a token and a sample of a tenth."""
    other = replace(BUDGETS, chars_per_token=(("urdu", 3.739), ("roman_urdu", 4.066), ("english", 3.9)), sample_rate=0.1)
    return splits.token_bands(splits.histogram(_population(spark, d), BUDGETS), other).withColumn("target", F.round("target", 6))


@query
def split_funding(spark, d):
    found = splits.funding(splits.histogram(_population(spark, d), BUDGETS), BUDGETS)
    return found.select("arm", "population", *(F.round(c, 6).alias(c) for c in ("supply_tokens", "required_tokens")), "funded")


@query
def split_assignment(spark, d):
    return _assigned(spark, d).select("doc_id", "bucket", "split_name", F.array_join("arms", ",").alias("arms"))


@query
def split_summary(spark, d):
    return splits.summary(_assigned(spark, d))


@query
def pack_streams(spark, d):
    return packing.stream_report(packing.placed(packing.streams(_assigned(spark, d))))


@query
def pack_sequences(spark, d):
    return packing.sequences(packing.placed(packing.streams(_assigned(spark, d))))


@query
def pack_verify(spark, d):
    text = packing.byte_ids(_docs(spark, d))
    at = packing.placed(packing.streams(_assigned(spark, d)))
    return packing.verify(packing.pack_ids(at.join(text, "doc_id"), "ids", Packing()))


@query
def exclusions_apply(spark, d):
    lost = dedup.verdicts(_docs(spark, d)).filter(~F.col("kept")).select(F.col("doc_id").cast("string").alias("doc_id"))
    return exclusions.apply(_docs(spark, d), lost).select("doc_id")


@query
def exclusions_report(spark, d):
    removed = dedup.verdicts(_docs(spark, d)).filter(~F.col("kept")).select(F.col("doc_id").cast("string").alias("doc_id"))
    gone = table(spark, d, "eval_items").select(F.col("item_id").alias("doc_id"))
    return exclusions.report(_docs(spark, d), exclusions.union(removed, gone))


@query
def domain_rates(spark, d):
    docs = _docs(spark, d)
    return analytics.domain_rates(docs, readers.host(F.col("url")), F.regexp_count(text_or_empty(F.col("text")), F.lit("[يك]")), 5, 2000).withColumn("per_kchar", F.round("per_kchar", 9))


@query
def lexicon_counts(spark, d):
    return generation.lexicon(_docs(spark, d))


@query
def lexicon_unknown_rate(spark, d):
    made = table(spark, d, "demo_pairs").select("idx", "ar_text").distinct()
    return generation.unknown_rate(made, generation.lexicon(_docs(spark, d)), "idx", "ar_text")


@query
def generation_statistics(spark, d):
    rows = table(spark, d, "demo_pairs").select("idx", "ar_text").distinct()
    found = generation.statistics(spread(rows), "idx", "ar_text")
    return found.select("idx", "n_words", *(F.round(c, 9).alias(c) for c in ("distinct_1", "distinct_2", "distinct_3", "distinct_4", "repetition")))


@query
def prefix_echo(spark, d):
    rows = table(spark, d, "demo_pairs").select("idx", "prefix", "diff_text").distinct()
    return generation.prefix_echo(rows, "idx", "prefix", "diff_text", 2).withColumn("echo", F.round("echo", 9))


@query
def longest_repeated_run(spark, d):
    return generation.longest_repeated_run(table(spark, d, "demo_pairs").select("idx", "ar_text").distinct(), "idx", "ar_text")


@query
def cooccurrence(spark, d):
    rows = table(spark, d, "demo_pairs").select("idx", "ar_text", "diff_text").distinct()
    return analytics.cooccurrence(rows, "ar_text", "diff_text", 20).withColumn("p", F.round("p", 9))


@query
def ngram_overlap(spark, d):
    made = table(spark, d, "demo_pairs").select("idx", "ar_text").distinct()
    return analytics.ngram_overlap(made, _docs(spark, d), "idx", "ar_text", 5).withColumn("overlap", F.round("overlap", 9))


@query
def romanize(spark, d):
    return corruption.corrupt(_docs(spark, d), "romanize").select("doc_id", F.md5("text").alias("text_md5"))


@query
def code_switch(spark, d):
    return corruption.corrupt(_docs(spark, d), "code_switch", 3)


@query
def corrupt_restore(spark, d):
    return corruption.corrupt(_docs(spark, d), "restore", 5)


@query
def corrupt_reversible(spark, d):
    """Normalization undoes the reversible half of OCR damage, however much there is of it."""
    clean = normalize.normalize(_docs(spark, d).select("doc_id", "text")).select("doc_id", F.col("norm.text").alias("text"))
    damaged = corruption.corrupt(clean, "ocr", 3, config=Damage(ocr_rate=(0.5, 0.5), ocr_lossy_share=0.0)).select("doc_id", F.col("text").alias("bad"))
    both = clean.join(damaged, "doc_id").select("text", "bad", normalize.normalized(F.col("bad")).alias("back"))
    return both.agg(F.count_if(F.col("back") != F.col("text")).alias("not_restored"), (F.count_if(F.col("bad") != F.col("text")) > 0).alias("some_damaged"))


@query
def latest_assignment(spark, d):
    """What arrived late replaces what was there; the row written last wins, wherever it stands."""
    rows = table(spark, d, "split_assignments").select("doc_id", "population", "split_name", "written_ts", "loaded_ts").distinct()
    late = F.col("loaded_ts") > F.col("written_ts") + F.expr("interval 7 days")
    old, new = rows.filter(~F.coalesce(late, F.lit(False))), rows.filter(late)
    return analytics.upsert(old, new, ["doc_id"], "written_ts").select("doc_id", "population", "split_name")


@query
def fetch_plan(spark, d):
    files = table(spark, d, "mix_targets").select(F.col("source").alias("path"), F.col("max_repeats").alias("rank"), (F.col("target_share") * 1000).cast("bigint").alias("size"))
    return analytics.fetch_plan(files, 600).select("path", "upto")


@query
def domain_top_share(spark, d):
    docs = _docs(spark, d)
    return analytics.top_share(docs, readers.host(F.col("url")), F.length(text_or_empty(F.col("text")))).withColumn("share", F.round("share", 9))


@query
def specific_pairs(spark, d):
    rows = table(spark, d, "demo_pairs").select("idx", "ar_text", "diff_text").distinct()
    return analytics.specific_pairs(rows, "ar_text", "diff_text", 5, 0.3).select("u", "s", "n", *(F.round(c, 9).alias(c) for c in ("p", "q", "lift")))


@query
def commit_order(spark, d):
    """Steps of a hash order stand for those of a decoder: the n-th word of a text is committed in step n * 7 mod 5."""
    words = table(spark, d, "demo_pairs").filter("diff_text is not null").groupBy("idx").agg(F.min("diff_text").alias("t"))
    steps = F.transform(tokens(F.col("t")), lambda x, i: (F.length(x) * 7 + i) % 5)
    return generation.commit_order(words.select("idx", steps.cast("array<int>").alias("steps")), "idx", "steps").select("idx", F.round("in_order", 9).alias("in_order"), F.round("same_pass", 9).alias("same_pass"))


@query
def infill_scores(spark, d):
    """Each prefix against the words that a text made of it begins with, by the number of forward passes."""
    rows = table(spark, d, "demo_pairs").select("ar_forwards", tokens(F.col("prefix")).alias("gold"), tokens(F.col("ar_text")).alias("made")).filter("ar_forwards is not null")
    return generation.infill_scores(rows, "gold", "made", "ar_forwards").withColumn("f1", F.round("f1", 9))


@query
def task_counts(spark, d):
    """Whole numbers of tasks by systematic apportionment of all documents, and the shares to ask for after losses."""
    shares = {"lm": 0.65, "infill": 0.10, "pair": 0.10, "restore": 0.08, "switch": 0.07}
    n = _docs(spark, d).count()
    again = sampling.rebalance(shares, {"lm": 0.70, "infill": 0.05, "pair": 0.10, "restore": 0.08, "switch": 0.07})
    rows = [(t, k, round(again[t], 9)) for t, k in sampling.apportion(n, shares).items()]
    return spark.createDataFrame(rows, "task string, documents bigint, share double")


@query
def exclusions_stages(spark, d):
    exact = dedup.verdicts(_docs(spark, d)).filter(~F.col("kept")).select("doc_id")
    short = quality.score(_measured(spark, d)).filter(F.array_contains("reasons", "too_short")).select("doc_id")
    return exclusions.union_of_stages({"dedup": exact, "quality": short}).select("doc_id", F.array_join("stages", ",").alias("stages"))


@query
def pack_indexed(spark, d):
    """The global places of the sequences of the training streams."""
    at = packing.sequences(packing.placed(packing.streams(_assigned(spark, d)))).select("stream", "seq")
    return packing.indexed(at.filter(F.col("stream").contains("/train/")))


@query
def pack_whole(spark, d):
    """Streams in which each document begins a sequence of its own."""
    return packing.stream_report(packing.placed(packing.streams(_assigned(spark, d)), Packing(sequence_length=128), across=False), Packing(sequence_length=128))


@query
def tokenizer_sample(spark, d):
    return analytics.budget_prefix(_population(spark, d), "population", "chars", 0.1, F.md5(F.concat(F.lit("tokenizer-1|"), F.col("doc_id").cast("string")))).select("doc_id", "population")


@query
def curation_pipeline(spark, d):
    return pipeline.curate(_docs(spark, d), _items(spark, d), profile=_profile(spark, d))


@query
def curation_stages(spark, d):
    """How many documents leave the plan where, by the production settings."""
    return pipeline.curate(_docs(spark, d), _items(spark, d), profile=_profile(spark, d)).groupBy("stage").agg(F.count("*").alias("documents"))


@query
def near_dup_config(spark, d):
    c = NearDup()
    return spark.createDataFrame([(s / 10, float(c.candidate_probability(s / 10))) for s in range(1, 11)], "similarity double, probability double").withColumn("probability", F.round("probability", 9))


@query
def exact_jaccard_pairs(spark, d):
    sketches, retained = _near(spark, d)
    found = neardup.exact_jaccard(_docs(spark, d), neardup.named_pairs(sketches, retained))
    return found.select("a", "b", F.round("jaccard", 9).alias("jaccard"), F.round("containment", 9).alias("containment"))


@query
def near_dup_pair_examples(spark, d):
    return neardup.pair_examples(_near(spark, d)[1], 3)


@query
def near_dup_cross_source(spark, d):
    sketches, retained = _near(spark, d)
    return neardup.cross_source(neardup.clusters(sketches, retained, 0.5), _docs(spark, d).select(F.col("doc_id").alias("id"), "source"))


@query
def char_shingle_counts(spark, d):
    return table(spark, d, "eval_items").select("item_id", F.size(shingles(F.col("text"), 5, "char")).alias("n_shingles"))


@query
def decontaminate_histogram(spark, d):
    return decontaminate.histogram(decontaminate.containments(_trained(spark, d), _items(spark, d), EvalSet("all", retain=0.0)))


@query
def decontaminate_unmeasurable(spark, d):
    return decontaminate.unmeasurable(_items(spark, d), EvalSet("all", min_shingles=40))


@query
def decontaminate_removals(spark, d):
    return decontaminate.removals(decontaminate.hits_by_set(_trained(spark, d), _sets(spark, d), SPECS), SPECS)


@query
def dedup_variants(spark, d):
    docs = normalize.normalize(_docs(spark, d).select("doc_id", "text")).select("doc_id", "text", F.col("norm.text").alias("normalized"))
    return dedup.variants(docs, "normalized")


@query
def language_log(spark, d):
    return scripts.log(scripts.kept(scripts.classify(_docs(spark, d).select("doc_id", "text"), _profile(spark, d))))


@query
def pii_contexts(spark, d):
    return pii.contexts(table(spark, d, "pii_results").select("result_id", "text").distinct(), id_col="result_id")


@query
def byte_fertility(spark, d):
    found = tokenizers.fertility(_docs(spark, d).withColumn("n_tokens", F.coalesce(F.octet_length("text"), F.lit(0))), "source")
    return found.select("source", "documents", "tokens", *(F.round(c, 9).alias(c) for c in ("chars_per_token", "bytes_per_token", "tokens_per_word")))


@query
def piece_fertility(spark, d):
    ids = tokenizers.encode_pieces(_docs(spark, d), "/opt/tokenizers/piece_bpe_32k.model").select("doc_id", F.size("ids").alias("n_tokens"))
    return tokenizers.fertility(_docs(spark, d).join(ids, "doc_id"), "lang")


@query
def draw_summary(spark, d):
    rows = table(spark, d, "demo_pairs").select("idx", "ar_forwards", "ar_secs").distinct()
    found = tokenizers.draw_summary(rows, "ar_forwards", "ar_secs")
    return found.select("ar_forwards", "n", *(F.round(c, 6).alias(c) for c in ("mean", "sd", "sem", "least", "most")))


@query
def validation_sample(spark, d):
    return sampling.validation_sample(quality.score(_measured(spark, d)), 50, 40, "review-1")
