"""Problem 2: repetition inside a single document, as a rule bitmask ledger.

Every rule is evaluated once per text. The ledger keeps the measurements and one bit for each failed
rule; policies are versioned bit masks over the ledger, and ablations come from the counts of each
distinct mask, so neither re-reads a text.

Defined cases: null, empty and wordless texts measure 0 and fail nothing; rows without an id are left out; texts with fewer words than
a rule's window measure 0 for it; repeated input rows give one ledger row; other columns are ignored.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from waraq.llm.words import WORD
from waraq.session import spread

_DIGIT = regex.compile(r"\p{Nd}")
_SENTENCE = regex.compile(r"[.!?؟۔।\n]+")


@dataclass(frozen=True)
class Rule:
    """A text fails the rule when its measure reaches the threshold (never at a measure of 0)."""

    name: str
    bit: int
    threshold: float


RULES = (
    Rule("words_in_repeated_4grams", 0, 0.4),
    Rule("words_in_repeated_8grams", 1, 0.4),
    Rule("repeated_sentences", 2, 0.3),
    Rule("repeated_paragraphs", 3, 0.3),
    Rule("top_word_share", 4, 0.3),
    Rule("top_4gram_share", 5, 0.2),
    Rule("adjacent_word_echo", 6, 0.2),
)
#: Versioned policies: a text is rejected when it fails any rule of the mask.
POLICIES = {"v1": 0b0000001, "v2": 0b0101101, "v3": 0b1111111}


def fold(text: str) -> list[str]:
    """Words without case, each digit as the same sign."""
    return WORD.findall(_DIGIT.sub("0", text).lower())


def covered_share(tokens: list, n: int) -> tuple[float, float]:
    """Share of tokens inside an n-gram that occurs at least twice, and share of n-grams that are the most frequent one."""
    grams = len(tokens) - n + 1
    if grams < 2:
        return 0.0, 0.0
    keys = list(zip(*(tokens[k:] for k in range(n))))
    counts = Counter(keys)
    if len(counts) == grams:
        return 0.0, 0.0
    covered, end = 0, 0
    for i, k in enumerate(keys):
        if counts[k] > 1:
            covered += i + n - max(i, end)
            end = i + n
    top = max(counts.values())
    return covered / len(tokens), (top / grams if top > 1 else 0.0)


def unit_share(units: list[str]) -> float:
    """Share of characters in units that occur again, first occurrences not counted."""
    units = [u for u in (" ".join(u.split()) for u in units) if u]
    total = sum(map(len, units))
    if not total:
        return 0.0
    seen: set[str] = set()
    again = 0
    for u in units:
        if u in seen:
            again += len(u)
        seen.add(u)
    return again / total


def measure(text: str | None) -> tuple[int, list[float]]:
    """Number of words, and the measure of each of RULES."""
    tokens = fold(text or "")
    n = len(tokens)
    if not n:
        return 0, [0.0] * len(RULES)
    ids: dict[str, int] = {}
    coded = [ids.setdefault(t, len(ids)) for t in tokens]
    four, top4 = covered_share(coded, 4)
    eight, _ = covered_share(coded, 8)
    top1 = max(Counter(coded).values()) / n if n >= 20 else 0.0
    echo = sum(a == b for a, b in zip(coded, coded[1:])) / n
    return n, [four, eight, unit_share(_SENTENCE.split(text)), unit_share(text.split("\n")), top1, top4, echo]


def ledger(df: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """One row per (key, field_name): n_words, fail_bits and a measure column for each rule."""
    schema = f"{key} {df.schema[key].dataType.simpleString()}, field_name string, n_words int, fail_bits int, " + ", ".join(f"{r.name} double" for r in RULES)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keys, names, lengths, bits, values = [], [], [], [], [[] for _ in RULES]
            for field in fields:
                for k, text in zip(b.column(key).to_pylist(), b.column(field).to_pylist()):
                    n, m = measure(text)
                    keys.append(k)
                    names.append(field)
                    lengths.append(n)
                    bits.append(sum(1 << r.bit for r, x in zip(RULES, m) if x and x >= r.threshold - 1e-12))
                    for column, x in zip(values, m):
                        column.append(x)
            yield pa.RecordBatch.from_arrays(
                [pa.array(keys, b.schema.field(key).type), pa.array(names, pa.string()), pa.array(lengths, pa.int32()), pa.array(bits, pa.int32()), *(pa.array(v, pa.float64()) for v in values)],
                [key, "field_name", "n_words", "fail_bits", *(r.name for r in RULES)],
            )

    return spread(df.select(key, *fields).filter(F.col(key).isNotNull())).mapInArrow(run, schema).distinct()


def rejected(policy: str) -> Column:
    return F.col("fail_bits").bitwiseAND(F.lit(POLICIES[policy])) != 0


def ablation(found: DataFrame, policy: str) -> DataFrame:
    """For each rule of the policy: texts that fail it, that fail only it, and rejections left without it.

    Counts of the distinct masks (at most 2^rules rows) are made first; everything else is bitwise on them.
    """
    mask = POLICIES[policy]
    counts = found.groupBy(F.col("fail_bits").bitwiseAND(F.lit(mask)).alias("bits")).agg(F.count("*").alias("n"))
    rules = F.explode(F.array(*(F.struct(F.lit(r.name).alias("rule"), F.lit(1 << r.bit).alias("bit")) for r in RULES if mask >> r.bit & 1)))
    fired = F.col("bits").bitwiseAND(F.col("r.bit")) != 0
    left = F.col("bits").bitwiseAND(F.bitwise_not(F.col("r.bit"))) != 0
    count = lambda c: F.coalesce(F.sum(F.when(c, F.col("n"))), F.lit(0)).cast("bigint")
    return (
        counts.select("bits", "n", rules.alias("r"))
        .groupBy(F.lit(policy).alias("policy"), F.col("r.rule").alias("rule"))
        .agg(F.sum("n").alias("texts"), count(fired).alias("fired"), count(fired & ~left).alias("sole"), count(F.col("bits") != 0).alias("rejected"), count(left).alias("rejected_without"))
    )
