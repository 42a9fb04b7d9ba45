"""Problem 6: copies hidden by formatting, found by commutative hashing of fields.

A text is either a list of named fields (a JSON object or name and value pairs) or prose. Each
normalized (name, value) pair is hashed and the hashes are added up, so the order of fields does not
matter and nothing is sorted; prose is one unnamed field. Rows are grouped by 128 bits of two such sums;
a salted join compares every row's fields with those of its group's smallest row, so that a group of any
size never meets in one task. Fields are compared as multisets, the second of two equal pairs being
another field than the first. Rows that differ in spite of equal sums are regrouped by sums of a longer hash.

Two relations make copies: equal letters and digits in the same order, and equal multisets of named
fields. A field list also has a letter key; groups joined by either relation are merged by repeated
minima over the (small) table of distinct key pairs.

Defined cases: rows without an id, null texts and texts without a letter or digit belong to no set; repeated rows count
once; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import ast
import json
from collections.abc import Iterator

import pyarrow as pa
import regex
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from waraq.operators.groups import salt, with_group
from waraq.session import cut, spread

_EDGES = regex.compile(r"^[\s﻿\xA0]+|[\s\xA0]+$")
_FIELD_SPLIT = regex.compile(r"\s*[\r\n;|]+\s*")
_FIELD = regex.compile(r"\s*([\p{L}\p{M}\p{Nd}_.\- ]{1,40}?)\s*[:=]\s*(.*?)\s*", regex.S)
SALTS = 16
_SEEDS = (11, 29)


class _Signs(dict):
    """For str.translate: letters and digits stay, everything else goes."""

    def __missing__(self, point: int) -> int | None:
        c = chr(point)
        self[point] = point if c.isalpha() or c.isdecimal() else None
        return self[point]


_SIGNS = _Signs({ord("ς"): ord("σ"), ord("ß"): "ss"})


def signs(text: str) -> str:
    """Letters and digits of a text in order, without case, spaces, punctuation and symbols."""
    return text.lower().translate(_SIGNS)


class _Pairs(list):
    """The members of a JSON object in order, repeated names included."""


def _spelled(value: object) -> str:
    """A value of a JSON text as its text."""
    if isinstance(value, _Pairs):
        return " ".join(f"{k} {_spelled(v)}" for k, v in value)
    if isinstance(value, dict):
        return " ".join(f"{k} {_spelled(v)}" for k, v in value.items())
    if isinstance(value, list | tuple):
        return " ".join(map(_spelled, value))
    return value if isinstance(value, str) else "null" if value is None else str(value).lower()


def fields(text: str) -> list[tuple[str, str]] | None:
    """Normalized names and values of a list of named fields; None for prose."""
    t = _EDGES.sub("", text)
    if t.startswith("{") and t.endswith("}"):
        try:
            found = json.loads(t, object_pairs_hook=_Pairs, parse_int=str, parse_float=str, parse_constant=str, strict=False)
        except (ValueError, RecursionError):
            try:
                found = _Pairs(ast.literal_eval(t).items())  # objects in single quotes
            except (ValueError, SyntaxError, AttributeError, RecursionError, MemoryError):
                found = None
        if isinstance(found, _Pairs) and found:
            return [(signs(str(k)), signs(_spelled(v))) for k, v in found]
    if ":" not in text and "=" not in text:
        return None
    parts = [p for p in _FIELD_SPLIT.split(text) if p.strip()]
    if len(parts) < 2:
        return None
    out = []
    for p in parts:
        m = _FIELD.fullmatch(p)
        if not m:
            return None
        out.append((signs(m[1]), signs(m[2])))
    return out


def numbered(pairs: list[tuple[str, str]]) -> list[str]:
    """The pairs as texts of which no two are equal: the k-th of equal ones carries its number."""
    times: dict[tuple[str, str], int] = {}
    out = []
    for p in pairs:
        k = times[p] = times.get(p, 0) + 1
        out.append("\x01".join(p) if k == 1 else "\x01".join((*p, str(k))))
    return out


def multiset_key(payload: list[str]) -> str:
    """Sums modulo 2^64 of the fields' hashes under two seeds: the same for every order of the fields."""
    return "".join(f"{sum(xxhash.xxh3_64_intdigest(x, seed) for x in payload) % (1 << 64):016x}" for seed in _SEEDS)


def _keyed(df: DataFrame, row_id: str, text: str) -> DataFrame:
    """(row_id, key, payload): a row for the letters of a text and one for its fields, if it is a list of some."""
    kind = df.schema[row_id].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at, keys, payloads = [], [], []
            for i, t in enumerate(b.column(1).to_pylist()):
                letters = signs(t)
                if not letters:
                    continue
                named = fields(t)
                for mark, payload in (("t", ["\x01" + letters]), ("f", numbered(named) if named else None)):
                    if payload:
                        at.append(i)
                        keys.append(mark + multiset_key(payload))
                        payloads.append(payload)
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(at, pa.int64())), pa.array(keys, pa.string()), pa.array(payloads, pa.list_(pa.string()))], ["row_id", "key", "payload"])

    source = spread(df.select(F.col(row_id).alias("row_id"), F.col(text).alias("text")).filter(F.col("row_id").isNotNull() & F.col("text").isNotNull()))
    return source.mapInArrow(run, f"row_id {kind}, key string, payload array<string>")


def _verified(keyed: DataFrame) -> DataFrame:
    """(row_id, key) with keys split where a row's fields differ from those of the key's smallest row.

    Groups are counted on ids and keys alone. Only rows of groups of two and more bring their fields, and
    the smallest row's fields go to as many (key, salt) places as the group has, so that a group of any
    size is spread.
    """
    ids = cut(keyed.select("row_id", "key").distinct())
    groups = ids.withColumn("salt", salt("row_id")).groupBy("key").agg(F.min("row_id").alias("rep"), F.count("*").alias("n"), F.collect_set("salt").alias("salts")).filter(F.col("n") > 1)
    places = cut(groups.select("key", "rep", F.explode("salts").alias("salt")))
    held = keyed.withColumn("salt", salt("row_id")).join(places, ["key", "salt"])
    leads = held.filter(F.col("row_id") == F.col("rep")).groupBy("key").agg(F.first("payload").alias("lead")).join(places.select("key", "salt"), "key")
    same = (F.size("payload") == F.size("lead")) & (F.size(F.array_intersect("payload", "lead")) == F.size("lead"))
    digest = lambda first: F.aggregate("payload", F.lit(0).cast("decimal(38,0)"), lambda a, x: a + F.conv(F.substring(F.sha2(x, 256), first, 15), 16, 10).cast("decimal(38,0)"))
    own = F.concat_ws("/", "key", digest(1).cast("string"), digest(16).cast("string"))
    split = cut(held.join(leads, ["key", "salt"]).filter(~same).select("row_id", "key", own.alias("own")).distinct())
    if split.isEmpty():
        return ids
    return ids.join(split, ["row_id", "key"], "left").select("row_id", F.coalesce("own", "key").alias("key"))


def copy_sets(df: DataFrame, row_id: str, text: str) -> DataFrame:
    """(row_id, keep_id, size): the set of each row with text, its smallest row_id and its size."""
    named = _verified(cut(_keyed(df, row_id, text)))
    of = lambda kind: F.min(F.when(F.col("key").startswith(kind), F.col("key")))
    rows = cut(named.groupBy("row_id").agg(of("t").alias("lkey"), of("f").alias("fkey")))
    # merge: a field list links its letter key with its field key; prose that shares the letter key follows
    links = cut(rows.filter(F.col("fkey").isNotNull()).select("lkey", "fkey").distinct().withColumn("label", F.col("fkey")))
    while True:
        a = links.groupBy("lkey").agg(F.min("label").alias("label"))
        b = links.drop("label").join(a, "lkey").groupBy("fkey").agg(F.min("label").alias("label"))
        new = cut(links.withColumnRenamed("label", "old").join(b, "fkey"))
        moved = not new.filter(F.col("old") != F.col("label")).isEmpty()
        links = new.drop("old")
        if not moved:
            break
    # a letter key may be that of a third of all rows: its label goes to each of its salted places
    salts = F.explode(F.array(*(F.lit(i).cast("bigint") for i in range(SALTS))))
    roots = links.groupBy("lkey").agg(F.min("label").alias("label")).withColumn("_s", salts)
    labelled = rows.withColumn("_s", F.pmod(F.xxhash64("row_id"), F.lit(SALTS))).join(roots, ["lkey", "_s"], "left").select("row_id", F.coalesce("label", "lkey").alias("set_key"))
    return with_group(labelled, "set_key", "row_id", F.min("row_id").alias("keep_id"), F.count("*").alias("size")).select("row_id", "keep_id", "size")
