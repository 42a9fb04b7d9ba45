"""Encoding validation: UTF-8 bytes, replacement and control characters, and a byte-image test for mojibake."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from waraq.config import Encoding
from waraq.functions.text import let, matched_chars, rate, text_or_empty
from waraq.session import spread

#: Control characters other than tab, line feed, carriage return, vertical tab and form feed.
CONTROLS = r"[\x00-\x08\x0E-\x1F\x7F-\x{9F}]"


def _cp1252() -> dict[int, str]:
    """What each byte from 0x80 reads as in Windows-1252; undefined bytes read as themselves."""
    out = {}
    for b in range(0x80, 0x100):
        try:
            out[b] = bytes([b]).decode("cp1252")
        except UnicodeDecodeError:
            out[b] = chr(b)
    return out


_IMAGE = _cp1252()


def _images(first: int, last: int) -> str:
    return "[" + "".join(f"\\x{{{ord(_IMAGE[b]):X}}}" for b in range(first, last + 1)) + "]"


_CONT = _images(0x80, 0xBF)
#: A well-formed multi-byte UTF-8 sequence whose bytes were read as Windows-1252 characters.
MOJIBAKE = f"(?:{_images(0xC2, 0xDF)}{_CONT}|{_images(0xE0, 0xEF)}{_CONT}{_CONT}|{_images(0xF0, 0xF4)}{_CONT}{_CONT}{_CONT})"


def decode_utf8(data: Column, on_error: str = "reject") -> Column:
    """Text of UTF-8 bytes without a byte order mark; null, or replacement characters, where malformed."""
    bare = F.when(F.hex(F.substring(data, 1, 3)) == "EFBBBF", F.substring(data, 4, 2**31 - 5)).otherwise(data)
    as_text = bare.cast("string")
    return F.when(F.is_valid_utf8(as_text), as_text) if on_error == "reject" else F.make_valid_utf8(as_text)


def mojibake_chars(text: Column) -> Column:
    return matched_chars(text, MOJIBAKE)


def _unread(text: Column) -> Column:
    """The text with its Windows-1252 characters taken as bytes and decoded as UTF-8; null where that fails."""
    special = [(c, b) for b, c in _IMAGE.items() if ord(c) > 0xFF]

    def decode(latin: Column) -> Column:
        data = F.encode(F.when(~latin.rlike(r"[^\x00-\x{FF}]"), latin), "ISO-8859-1").cast("string")
        return let(data, lambda d: F.when(F.is_valid_utf8(d), d))

    return let(F.translate(text, "".join(c for c, _ in special), "".join(chr(b) for _, b in special)), decode)


def repair(text: Column, passes: int) -> Column:
    """struct(text, left, passes): undoes whole-text misreadings as long as each pass lowers the count and loses nothing.

    left is the number of characters that still look misread.
    """

    def state(t: Column, left: Column, done: Column) -> Column:
        return F.struct(t.alias("text"), left.alias("left"), done.alias("passes"))

    def step(s: Column) -> Column:
        def better(new: Column) -> Column:
            return let(mojibake_chars(new), lambda n: F.when(new.isNotNull() & (n < s["left"]) & ~new.contains("\ufffd"), state(new, n, s["passes"] + 1)).otherwise(s))

        return F.when(s["left"] > 0, let(_unread(s["text"]), better)).otherwise(s)

    out = let(text_or_empty(text), lambda t: state(t, mojibake_chars(t), F.lit(0)))
    for _ in range(passes):
        out = let(out, step)
    return out


def _judged(s: Column, config: Encoding) -> Column:
    t, n = s["text"], F.length(s["text"])
    mojibake, replacement, control = rate(s["left"], n), rate(F.regexp_count(t, F.lit("\\x{FFFD}")), n), rate(F.regexp_count(t, F.lit(CONTROLS)), n)

    def verdict(r: Column) -> Column:
        name = (
            F.when(r["mojibake_rate"] > config.max_mojibake_rate, "mojibake")
            .when(r["replacement_rate"] > config.max_replacement_rate, "replacement_heavy")
            .when(r["control_rate"] > config.max_control_rate, "control_heavy")
            .when(s["passes"] > 0, "repaired")
            .otherwise("ok")
        )
        clean = F.when(r["control_rate"] > 0, F.regexp_replace(t, CONTROLS, "")).otherwise(t)
        return let(clean, lambda c: F.struct(name.alias("verdict"), c.alias("text"), F.length(c).alias("chars"), r["mojibake_rate"].alias("mojibake_rate"), r["replacement_rate"].alias("replacement_rate"), r["control_rate"].alias("control_rate"), s["passes"].alias("passes")))

    return let(F.struct(mojibake.alias("mojibake_rate"), replacement.alias("replacement_rate"), control.alias("control_rate")), verdict)


def validate(docs: DataFrame, config: Encoding = Encoding(), text_col: str = "text") -> DataFrame:
    """Adds enc: struct(verdict, text, chars, mojibake_rate, replacement_rate, control_rate, passes).

    Verdicts in order: mojibake, replacement_heavy, control_heavy, repaired, ok; all rates are measured
    after repair and before controls are removed.
    """
    return spread(docs).withColumn("enc", let(repair(F.col(text_col), config.max_repair_passes), lambda s: _judged(s, config)))


def log(validated: DataFrame, text_col: str = "text") -> DataFrame:
    """(verdict, documents, bytes_in, chars_out)."""
    return validated.groupBy("enc.verdict").agg(F.count("*").alias("documents"), F.sum(F.octet_length(text_or_empty(F.col(text_col)))).alias("bytes_in"), F.sum("enc.chars").alias("chars_out"))
