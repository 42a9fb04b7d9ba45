"""Column builders that every stage shares, so that equal texts are equal everywhere."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space as Python's str.split sees it; the class is valid in Java and in RE2.
WS = r"[\t-\r\x1c-\x20\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"
NON_WS = WS.replace("[", "[^", 1)


def let(value: Column, f: Callable[[Column], Column]) -> Column:
    """f(value) with value evaluated once: an expression that a lambda refers to would be evaluated in every step."""
    return F.transform(F.array(value), f)[0]


def text_or_empty(text: Column) -> Column:
    return F.coalesce(text, F.lit(""))


def canonical(text: Column) -> Column:
    """White space collapsed and case folded: what exact and near deduplication compare."""
    return F.trim(F.regexp_replace(F.replace(F.lower(text_or_empty(text)), F.lit("ß"), F.lit("ss")), f"{WS}+", " "))


def tokens(text: Column) -> Column:
    return F.regexp_extract_all(text_or_empty(text), F.lit(f"({NON_WS}+)"), F.lit(1))


def h60(x: Column) -> Column:
    """The first 60 bits of MD5 as a bigint: the same in every engine."""
    return F.conv(F.substring(F.md5(x), 1, 15), 16, 10).cast("bigint")


def key(space: str, x: Column) -> Column:
    """A 128-bit digest in a named key space, as hex; order of hex is order of the number."""
    return F.md5(F.concat(F.lit(space + "|"), x))


def stable_unit(x: Column, salt: str) -> Column:
    """A number in [0, 1) from an id alone: 52 bits, exact in a double."""
    return F.conv(F.substring(F.md5(F.concat(F.lit(salt + "|"), x)), 1, 13), 16, 10).cast("double") / F.lit(float(16**13))


def lines(text: Column) -> Column:
    """Stripped, non-empty lines."""
    return F.filter(F.transform(F.split(text_or_empty(text), "\n"), lambda x: F.regexp_replace(x, f"^{WS}+|{WS}+$", "")), lambda x: x != "")


def ngrams(words: Column, n: int) -> Column:
    """All n-grams of an array of words, in order; none below n words."""
    return let(words, lambda w: F.when(F.size(w) >= n, F.transform(F.sequence(F.lit(1), F.size(w) - (n - 1)), lambda i: F.array_join(F.slice(w, i, n), " "))).otherwise(F.array().cast("array<string>")))


def shingles(text: Column, size: int = 5, unit: str = "word") -> Column:
    """Distinct shingles of the canonical text, of words or (for single sentences) of characters."""
    if unit == "char":
        return let(canonical(text), lambda t: F.array_distinct(F.when(F.length(t) >= size, F.transform(F.sequence(F.lit(1), F.length(t) - (size - 1)), lambda i: F.substring(t, i, size))).otherwise(F.array().cast("array<string>"))))
    return F.array_distinct(ngrams(F.filter(F.split(canonical(text), " "), lambda w: w != ""), size))


def matched_chars(text: Column, pattern: str) -> Column:
    """Characters inside matches of a pattern."""
    return F.aggregate(F.regexp_extract_all(text_or_empty(text), F.lit(f"({pattern})"), F.lit(1)), F.lit(0), lambda a, m: a + F.length(m))


def rate(part: Column, whole: Column) -> Column:
    return F.when(whole > 0, part / whole).otherwise(F.lit(0.0))
