"""Composed reports: domains, co-occurrence, verbatim overlap, fetch plans and upserts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from waraq.functions.text import h60, ngrams, rate, tokens
from waraq.operators.prefix import running_total


def domain_rates(docs: DataFrame, host: Column, hits: Column, min_docs: int = 5, min_chars: int = 20_000, text_col: str = "text") -> DataFrame:
    """(host, documents, chars, hits, per_kchar) of hosts with enough text."""
    d = docs.select(host.alias("host"), F.length(F.coalesce(text_col, F.lit(""))).cast("bigint").alias("c"), hits.cast("bigint").alias("h")).filter(F.col("host").isNotNull())
    sums = d.groupBy("host").agg(F.count("*").alias("documents"), F.sum("c").alias("chars"), F.sum("h").alias("hits"))
    return sums.filter((F.col("documents") >= min_docs) & (F.col("chars") >= min_chars)).withColumn("per_kchar", 1000 * F.col("hits") / F.col("chars"))


def cooccurrence(pairs: DataFrame, left: str, right: str, min_pairs: int = 5) -> DataFrame:
    """(u, s, n, p): words of one side with words of the other of the same row, and the share of u's rows that have s."""
    rows = pairs.select(F.array_distinct(tokens(F.lower(left))).alias("us"), F.array_distinct(tokens(F.lower(right))).alias("ss"))
    alone = rows.select(F.explode("us").alias("u")).groupBy("u").agg(F.count("*").alias("n_u")).filter(F.col("n_u") >= min_pairs)
    both = rows.select(F.explode("us").alias("u"), "ss").select("u", F.explode("ss").alias("s")).groupBy("u", "s").agg(F.count("*").alias("n")).filter(F.col("n") >= min_pairs)
    return both.join(alone, "u").select("u", "s", "n", (F.col("n") / F.col("n_u")).alias("p"))


def ngram_overlap(made: DataFrame, corpus: DataFrame, id_col: str, text_col: str, n: int, corpus_text: str = "text") -> DataFrame:
    """(id, grams, overlap): share of a text's n-grams of words that stand in the corpus.

    The corpus is reduced to the distinct hashes that occur on the other side before anything is joined back.
    """
    a = made.select(id_col, F.explode(ngrams(tokens(F.lower(text_col)), n)).alias("g")).select(id_col, h60(F.col("g")).alias("h"))
    c = corpus.select(F.explode(F.array_distinct(ngrams(tokens(F.lower(corpus_text)), n))).alias("g")).select(h60(F.col("g")).alias("h"))
    known = c.join(a.select("h").distinct(), "h", "left_semi").distinct().withColumn("hit", F.lit(1))
    return a.join(known, "h", "left").groupBy(id_col).agg(F.count("*").alias("grams"), rate(F.count("hit"), F.count("*")).alias("overlap"))


def fetch_plan(files: DataFrame, budget: int) -> DataFrame:
    """The longest beginning, in order of (rank, path), that fits a budget of bytes; it stops at the first file that doesn't."""
    order = Window.orderBy("rank", "path")
    run = files.withColumn("upto", F.sum("size").over(order))
    return run.filter(F.col("upto") <= budget)


def upsert(old: DataFrame, new: DataFrame, keys: list[str], version: str) -> DataFrame:
    """Both tables by key; of rows with equal keys the one of the latest version."""
    both = old.unionByName(new, allowMissingColumns=True)
    rest = [c for c in both.columns if c not in keys]
    return both.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.col(version)).alias("r")).select(*keys, "r.*")


def confusion(docs: DataFrame, expected: str, got: str) -> DataFrame:
    return docs.groupBy(F.coalesce(F.col(expected), F.lit("")).alias("expected"), F.col(got).alias("label")).agg(F.count("*").alias("n"))


def agreement(judged: DataFrame, verdict: str, mark: str) -> DataFrame:
    """(verdict, mark, n) of rows where both are given."""
    return judged.filter(F.col(verdict).isNotNull() & F.col(mark).isNotNull()).groupBy(F.col(verdict).alias("verdict"), F.col(mark).alias("mark")).agg(F.count("*").alias("n"))


def budget_prefix(docs: DataFrame, by: str, size: str, budget: float, order: Column, id_col: str = "doc_id") -> DataFrame:
    """Documents of each group, in order of a hex digest, up to and with the one that passes the group's share of its size.

    Rows without a group are left out.
    """
    d = docs.filter(F.col(by).isNotNull()).withColumn("_o", order)
    placed = running_total(d, by, "_o", size, id_col, "_before", "_all")
    return placed.filter(F.col("_before") < F.col("_all") * budget).drop("_o", "_before", "_all")


def top_share(docs: DataFrame, host: Column, size: Column, share: float = 0.01) -> DataFrame:
    """(hosts, top_hosts, top_size, size, share): how much of the corpus the largest hosts hold, that share of all hosts and one at least.

    Hosts are ranked in two levels, by halves of a power of two of their size and then within one of these.
    """
    sums = docs.select(host.alias("host"), size.cast("bigint").alias("s")).filter(F.col("host").isNotNull()).groupBy("host").agg(F.sum("s").alias("s")).withColumn("bin", F.floor(F.log2(F.col("s") + 1) * 2))
    bins = sums.groupBy("bin").agg(F.count("*").alias("k"))
    above = bins.withColumn("before", F.coalesce(F.sum("k").over(Window.orderBy(F.desc("bin")).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))  # some 120 rows
    rank = F.row_number().over(Window.partitionBy("bin").orderBy(F.desc("s"), "host"))
    ranked = sums.withColumn("r", rank).join(F.broadcast(above.select("bin", "before")), "bin").withColumn("rank", F.col("r") + F.col("before"))
    total = sums.agg(F.count("*").alias("hosts"), F.sum("s").alias("size"))
    chosen = ranked.join(F.broadcast(total)).filter(F.col("rank") <= F.greatest(F.lit(1), F.floor(F.col("hosts") * share)))
    return chosen.groupBy("hosts", "size").agg(F.count("*").alias("top_hosts"), F.sum("s").alias("top_size")).select("hosts", "top_hosts", "top_size", "size", rate(F.col("top_size"), F.col("size")).alias("share"))


def specific_pairs(pairs: DataFrame, left: str, right: str, min_pairs: int = 5, least: float = 0.5) -> DataFrame:
    """(u, s, n, p, q, lift): word pairs of cooccurrence() that stand together more than apart.

    p is the share of u's rows that have s, q the share of s's rows that have u, and lift how many times more often
    they meet than by chance; kept are pairs with both shares at least `least`.
    """
    both = cooccurrence(pairs, left, right, min_pairs)
    ss = pairs.select(F.explode(F.array_distinct(tokens(F.lower(right)))).alias("s")).groupBy("s").agg(F.count("*").alias("n_s"))
    rows = pairs.agg(F.count("*").alias("rows"))
    j = both.join(ss, "s").join(F.broadcast(rows))
    q = F.col("n") / F.col("n_s")
    return j.select("u", "s", "n", "p", q.alias("q"), (F.col("p") * F.col("rows") / F.col("n_s")).alias("lift")).filter((F.col("p") >= least) & (F.col("q") >= least))


def substitutions(pairs: DataFrame, skeleton_u: Column, skeleton_s: Column) -> DataFrame:
    """specific pairs with similarity: 1 less the edit distance of the words' skeletons over the longer one; what is one word spelled otherwise is near 1."""
    longest = F.greatest(F.length(skeleton_u), F.length(skeleton_s))
    return pairs.withColumn("similarity", F.when(longest > 0, 1 - F.levenshtein(skeleton_u, skeleton_s) / longest).otherwise(1.0))


def overlap_against_control(made: DataFrame, corpus: DataFrame, control: DataFrame, id_col: str, text_col: str, sizes: tuple[int, ...] = (3, 5, 8)) -> DataFrame:
    """(n, texts, overlap, control): the mean overlap of texts with the corpus and with a control corpus, for several lengths of n-grams."""
    out = None
    for n in sizes:
        a = ngram_overlap(made, corpus, id_col, text_col, n).agg(F.count("*").alias("texts"), F.avg("overlap").alias("overlap"))
        b = ngram_overlap(made, control, id_col, text_col, n).agg(F.avg("overlap").alias("control"))
        row = a.join(F.broadcast(b)).select(F.lit(n).alias("n"), "texts", "overlap", "control")
        out = row if out is None else out.unionByName(row)
    return out


def crossing(curves: DataFrame, x: str, a: str, b: str) -> DataFrame:
    """(x, from_x, to_x): where two curves that are given at the same points change places, on the straight line between the last point before and the first after."""
    order = Window.orderBy(x)  # the points of one report
    d = curves.select(x, (F.col(a) - F.col(b)).alias("d")).withColumn("px", F.lag(x).over(order)).withColumn("pd", F.lag("d").over(order))
    return d.filter(F.signum("d") * F.signum("pd") < 0).select((F.col("px") + (F.col(x) - F.col("px")) * F.col("pd") / (F.col("pd") - F.col("d"))).alias("x"), F.col("px").alias("from_x"), F.col(x).alias("to_x"))
