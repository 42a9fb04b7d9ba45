"""Normalization of Arabic-script text: presentation forms, letter folding, deletions, digits and white space."""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from waraq.functions.text import text_or_empty
from waraq.session import spread

# Letters and the Urdu letter each folds to.
FOLDS = {
    "yeh": ("يىېۍؠ", "ی"),
    "kaf": ("كڪ", "ک"),
    "gaf": ("ڰڲ", "گ"),
    "heh": ("هە", "ہ"),
    "heh_hamza": ("ۀ", "ۂ"),
    "teh_marbuta": ("ةۃ", "ہ"),
    "alef": ("أإٱٲٳ", "ا"),
}
# Characters that are deleted.
DELETIONS = {
    "tatweel": "ـ",
    "zero_width": "​‍﻿­⁠᠎" + "".join(chr(c) for c in range(0xFE00, 0xFE10)),
    "zwnj": "‌",
    "bidi": "‎‏؜‪‫‬‭‮⁦⁧⁨⁩",
}
# Digits and separators, and their ASCII form.
DIGITS = ("٠١٢٣٤٥٦٧٨٩۰۱۲۳۴۵۶۷۸۹٫٬", "01234567890123456789.,")
_LINE_BREAKS = r"\r\n|[\r\x0b\x0c\x{85}\x{2028}\x{2029}]"
_HORIZONTAL = r"[\t \x{A0}\x{1680}\x{2000}-\x{200A}\x{202F}\x{205F}\x{3000}]+"


def presentation_forms() -> dict[str, str]:
    """Compatibility images of the Arabic presentation-form blocks, from the Unicode data."""
    out = {}
    for first, last in ((0xFB50, 0xFDFF), (0xFE70, 0xFEFC)):
        for point in range(first, last + 1):
            image = unicodedata.normalize("NFKC", chr(point))
            if image != chr(point):
                out[chr(point)] = image
    return out


def expandpresentation_forms(text: Column) -> Column:
    """Single-letter forms by one translate; ligatures one by one, and only where any stands in the text."""
    forms = presentation_forms()
    single = {c: x for c, x in forms.items() if len(x) == 1}
    out = F.translate(text, "".join(single), "".join(single.values()))
    ligatures = {c: x for c, x in forms.items() if len(x) > 1}
    # a ligature becomes a mark of its own, then the mark its letters: few distinct lengths keep the plan small
    replaced = F.array_join(F.transform(F.split(out, ""), lambda c: F.coalesce(F.try_element_at(F.create_map(*(F.lit(x) for pair in ligatures.items() for x in pair)), c), c)), "")
    return F.when(out.rlike("[\\x{FB50}-\\x{FDFF}\\x{FE70}-\\x{FEFC}]"), replaced).otherwise(out)


def rule_counts(text: Column) -> Column:
    """struct of hits by rule, counted after presentation forms are expanded."""
    t = text
    count = lambda chars: F.length(t) - F.length(F.translate(t, chars, ""))
    return F.struct(*(count(src).alias(name) for name, (src, _) in FOLDS.items()), *(count(chars).alias(name) for name, chars in DELETIONS.items()), count(DIGITS[0]).alias("digits"))


def _folded(text: Column) -> Column:
    sources = "".join(src for src, _ in FOLDS.values()) + DIGITS[0]
    images = "".join(dst * len(src) for src, dst in FOLDS.values()) + DIGITS[1]
    return F.translate(text, sources + "".join(DELETIONS.values()), images)


def collapse(text: Column) -> Column:
    """One kind of line break, single spaces, no spaces around line breaks, at most two line breaks together."""
    t = F.regexp_replace(text, _LINE_BREAKS, "\n")
    t = F.regexp_replace(t, _HORIZONTAL, " ")
    t = F.regexp_replace(t, " ?\n ?", "\n")
    t = F.regexp_replace(t, "\n{3,}", "\n\n")
    return F.regexp_replace(t, "^[\n ]+|[\n ]+$", "")


def normalized(text: Column) -> Column:
    return collapse(_folded(expandpresentation_forms(text_or_empty(text))))


def normalize(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """Adds norm: struct(text, chars_in, chars_out, rules)."""
    staged = spread(docs).withColumn("_x", expandpresentation_forms(text_or_empty(F.col(text_col))))
    staged = staged.withColumn("_f", _folded(F.col("_x")))
    out = collapse(F.col("_f"))
    return staged.withColumn("norm", F.struct(out.alias("text"), F.length(text_or_empty(F.col(text_col))).alias("chars_in"), F.length(out).alias("chars_out"), rule_counts(F.col("_x")).alias("rules"))).drop("_x", "_f")


def log(docs: DataFrame) -> DataFrame:
    """One row: documents, changed documents, characters in and out, hits by rule."""
    rules = [f.name for f in docs.schema["norm"].dataType["rules"].dataType.fields]
    return docs.agg(
        F.count("*").alias("documents"),
        F.sum(F.col("norm.chars_in")).alias("chars_in"),
        F.sum(F.col("norm.chars_out")).alias("chars_out"),
        *(F.sum(f"norm.rules.{r}").alias(r) for r in rules),
    )
