"""Problem 1: text decoded with the wrong character encoding, found and restored by a character model.

A smoothed character trigram model is trained on the clean records (counts of all of them, in tables of
a fixed size). Every encode-decode chain proposes places: runs of characters that are, byte for byte in
the wrongly assumed encoding, well formed in the true one. Each place is scored by how much likelier
the model finds its surroundings with the characters restored, and the likeliest non-overlapping ones
are accepted beyond a margin. Repairs repeat, as text may have been garbled more than once. Rare single-byte
chains compete as wholes: where the others find nothing or leave something over, one is taken if it makes the record likelier. The margin is validated on all clean records, each held out in turn, and on a corruption of
each; it stands for the odds against a garbled place in any record, so in a record that is known to have
gone through a chain the odds turn, and that chain's other places are accepted unless the model finds
them unlikelier by the least margin. A replacement character is scored as a place whose best
restoration is the likeliest of the corpus's frequent characters; no honest text shows one, so the least margin holds.

Chains are UTF-8 read as any of seven single-byte encodings, and Arabic or Cyrillic single bytes read as
a Western, DOS or the other one of these; Arabic code pages as what was read are only tried for UTF-8, as single bytes
of another encoding would make a place of every Arabic word.

Defined cases: null and empty texts and rows without an id are not affected; characters replaced or lost (U+FFFD, question
marks, orphaned lead bytes) leave a record affected but not restored (restored is null); repeated rows
count once; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import math
import re
import unicodedata
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from waraq.llm.words import kept, new_name
from waraq.session import cut, spread

#: Encodings that UTF-8 bytes may have been read in, and pairs of single-byte encodings (read as, true).
READ_AS = ("latin-1", "cp1252", "cp1256", "mac_roman", "cp437", "cp850", "cp1251")
SINGLE = (("cp1252", "cp1256"),)
#: Rarer pairs, of which a record has gone through one, if any.
RARE = (*((r, "cp1256") for r in ("mac_roman", "cp437", "cp850", "cp1251")), *((r, "cp1251") for r in ("cp1252", "mac_roman", "cp437", "cp850")))
MAX_PASSES = 3
#: Slots of the tables of singles, pairs and triples: the model's size whatever the corpus.
SLOTS = (1 << 17, 1 << 20, 1 << 22)
#: Trigrams and places that a worker remembers, at most.
MEMO = 500_000
#: The margin is never below this; places in a record known to be garbled may be unlikelier by as much.
LEAST = 3.0
#: The most frequent characters, of which one may have stood where a replacement character is.
FREQUENT = 64
#: Up to so many distinct records are judged by the driver, more by the workers; in the same parts, with the same outcome.
HELD_OUT = 1000
#: Parts that validate the margin, at least, each judged by a model without it; and the characters of one, about, with 64 for each text.
PARTS, PART_CHARS = 32, 1 << 23
#: Of so many records that seem clean one may be garbled, and stands for no honest one.
ODD = 1000
GAINS = "corrupted boolean, gain double"
_P = (0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D)


def _high(encoding: str) -> dict[str, int]:
    """Characters of the upper half of an encoding; undefined bytes are read as C1 controls."""
    out: dict[str, int] = {}
    for b in range(128, 256):
        try:
            out[bytes([b]).decode(encoding)] = b
        except UnicodeDecodeError:
            out.setdefault(chr(b), b)
    return out


def _class(high: dict[str, int], a: int, b: int) -> str:
    return "[" + "".join(re.escape(c) for c, x in high.items() if a <= x <= b) + "]"


@dataclass(frozen=True)
class Chain:
    read_as: str
    true: str

    @property
    def name(self) -> str:
        return f"{self.read_as}>{self.true}"


class Proposer:
    """The places where one chain could have garbled a text."""

    def __init__(self, chain: Chain):
        self.chain = chain
        self.high = _high(chain.read_as)
        any_ = _class(self.high, 0x80, 0xFF)
        if chain.true == "utf-8":
            c = _class(self.high, 0x80, 0xBF)
            two, three, four = (_class(self.high, *x) for x in ((0xC2, 0xDF), (0xE0, 0xEF), (0xF0, 0xF4)))
            self.place = re.compile(f"(?:{two}{c}|{three}{c}{c}|{four}{c}{c}{c})+")
            self.needs = (frozenset(x for x, b in self.high.items() if 0xC2 <= b <= 0xF4), frozenset(x for x, b in self.high.items() if b < 0xC0))
        else:
            self.place = re.compile(any_ + "{2,}|(?<![^ ])" + any_ + "(?= )")
            self.needs = (frozenset(x for x in self.high if not x.isspace()),)
        self.memo: dict[str, str | None] = {}

    def possible(self, signs: set[str]) -> bool:
        """Whether a text of these characters can have a place."""
        return not any(need.isdisjoint(signs) for need in self.needs)

    def __call__(self, text: str) -> Iterator[tuple[int, int, str]]:
        memo = self.memo
        for m in self.place.finditer(text):
            old = m[0]
            new = memo[old] if old in memo else self.restore(old)
            if new is not None:
                yield m.start(), m.end(), new

    def restore(self, old: str) -> str | None:
        """What a place was before, if it decodes to text other than itself."""
        try:
            new = bytes(map(self.high.__getitem__, old)).decode(self.chain.true)
        except UnicodeDecodeError:
            new = None
        if new is not None and (new == old or any(unicodedata.category(c) in _NO_TEXT for c in new)):
            new = None
        if len(self.memo) > MEMO:
            self.memo.clear()
        self.memo[old] = new
        return new

    def garble(self, text: str) -> str | None:
        """What the chain makes of an honest text; None where it can't be or doesn't matter."""
        back = {b: c for c, b in self.high.items()}
        try:
            data = text.encode(self.chain.true)
        except UnicodeEncodeError:
            return None
        if max(data, default=0) < 128:
            return None
        return "".join(chr(b) if b < 128 else back[b] for b in data)


COMMON_PROPOSERS = tuple(Proposer(Chain(*c)) for c in [*((r, "utf-8") for r in READ_AS), *SINGLE])
RARE_PROPOSERS = tuple(Proposer(Chain(*c)) for c in RARE)
PROPOSERS = COMMON_PROPOSERS + RARE_PROPOSERS
#: Categories of code points that no text decodes to: unassigned, private and surrogate ones.
_NO_TEXT = frozenset(("Cn", "Co", "Cs"))
_REPLACED = re.compile("\ufffd+")
_ARABIC = re.compile("[ء-ۓ]+")
_LATIN_HIGH = frozenset(map(chr, range(0xC0, 0x100)))
_BROKEN = re.compile("[\x80-\x84\x86-\x9f�]")


def seems_clean(text: str) -> bool:
    """No trace of any chain but what honest text of the same letters may show by chance."""
    if text.isascii():
        return "\x7f" not in text or not _BROKEN.search(text)
    if _BROKEN.search(text):
        return False
    signs = set(text)
    for p in PROPOSERS:
        if p.chain.true != "utf-8" or not p.possible(signs):
            continue
        places = [m[0] for m in p.place.finditer(text)]
        if places and (p.chain.read_as != "cp1256" or sum(map(len, places)) > 0.15 * len(text) or any(len(x) > 4 or not _ARABIC.fullmatch(x) for x in places)):
            return False
    return signs.isdisjoint(_LATIN_HIGH) or len(re.findall("[À-ÿ]", text)) <= 0.2 * len(text)


class Model:
    """Interpolated trigram model over hashed tables."""

    def __init__(self, tables: list[np.ndarray]):
        self.t1, self.t2, self.t3 = tables
        self.total = float(self.t1.sum()) + 1.0
        top = np.argsort(-self.t1, kind="stable")[:FREQUENT]
        self.frequent = [chr(c) for c in top.tolist() if self.t1[c] and not 0xD800 <= c < 0xE000 and not chr(c).isspace()]
        self.memo: dict[str, float] = {}

    def _trigram(self, t: str) -> float:
        a, b, c = map(ord, t)
        n3, n2 = self.t3[_slot3(a, b, c)], self.t2[_slot2(a, b)]
        m2, m1 = self.t2[_slot2(b, c)], self.t1[b % SLOTS[0]]
        p = 0.05 * (self.t1[c % SLOTS[0]] + 0.5) / (self.total + 0.5 * SLOTS[0])
        if n2:
            p += 0.70 * min(1.0, n3 / n2)
        if m1:
            p += 0.25 * min(1.0, m2 / m1)
        if len(self.memo) > MEMO:
            self.memo.clear()
        got = self.memo[t] = math.log(p)
        return got

    def log_likelihood(self, text: str) -> float:
        """Of all characters from the third on."""
        memo, out = self.memo, 0.0
        for i in range(len(text) - 2):
            t = text[i : i + 3]
            got = memo.get(t)
            out += self._trigram(t) if got is None else got
        return out

    def gain(self, text: str, start: int, end: int, new: str) -> float:
        left = text[max(0, start - 2) : start].rjust(2, "\n")
        right = text[end : end + 2].ljust(2, "\n")
        return self.log_likelihood(left + new + right) - self.log_likelihood(left + text[start:end] + right)


    def lost(self, text: str) -> float:
        """How much likelier the best of the frequent characters makes a place of replacement characters."""
        best = 0.0
        for m in _REPLACED.finditer(text):
            best = max(best, max((self.gain(text, m.start(), m.end(), c) for c in self.frequent), default=0.0))
        return best


def _slot2(a: int, b: int) -> int:
    return (a * _P[0] + b * _P[1]) % SLOTS[1]


def _slot3(a: int, b: int, c: int) -> int:
    return (a * _P[0] + b * _P[1] + c * _P[2]) % SLOTS[2]


def repair_once(model: Model, text: str, margin: float, proposers: tuple = COMMON_PROPOSERS) -> tuple[str, list[tuple[float, str]], bool]:
    """(text, accepted (gain, chain), whether characters of a garbled run are left over)."""
    if text.isascii():
        return text, [], False
    signs = set(text)
    gains: dict[tuple, float] = {}  # several chains often propose the same
    proposals = []
    for p in proposers:
        if p.possible(signs):
            for place in p(text):
                gain = gains.get(place)
                if gain is None:
                    gain = gains[place] = model.gain(text, *place)
                proposals.append((gain, *place, p))
    best = sorted((x for x in proposals if x[0] > margin), key=lambda x: (-x[0], x[1], x[4].chain.name))
    if not best:
        return text, [], False
    taken: list[tuple] = []
    used = bytearray(len(text))
    chains: set[str] = set()

    def take(x: tuple) -> bool:
        if any(used[x[1] : x[2]]):
            return False
        used[x[1] : x[2]] = b"\x01" * (x[2] - x[1])
        taken.append(x)
        return True

    for x in best:
        if take(x):
            chains.add(x[4].chain.name)
    for x in sorted(proposals, key=lambda x: (-x[0], x[1])):
        if x[4].chain.name in chains and x[0] > -LEAST:
            take(x)
    left_over = False
    for x in taken:
        a, b = x[1], x[2]
        for at, step in ((a - 1, -1), (b, 1)):
            c = text[at] if 0 <= at < len(text) else " "
            if not (0 <= at < len(text) and used[at]) and (c == "�" or (c == "?" and step > 0 and at + 1 < len(text) and text[at + 1] in x[4].high) or (c in x[4].high and x[4].chain.read_as != "cp1256" and not c.isspace() and x[4].chain.true == "utf-8")):
                left_over = True
    out, at = [], 0
    for _, start, end, new, _ in sorted(taken, key=lambda x: x[1]):
        out += [text[at:start], new]
        at = end
    return "".join(out) + text[at:], [(x[0], x[4].chain.name) for x in taken], left_over


def _passes(model: Model, text: str, margin: float, first: tuple) -> tuple[str, list[tuple[float, str]], int, bool]:
    accepted, lost, passes = [], False, 0
    for k in range(MAX_PASSES):
        new, got, left = repair_once(model, text, margin, COMMON_PROPOSERS if k else first)
        if not got:
            break
        lost |= left
        accepted += got
        text, passes = new, passes + 1
    if passes and ("�" in text or _BROKEN.search(text)):
        lost = True
    return text, accepted, passes, lost


def repair(model: Model, text: str, margin: float) -> tuple[str, list[tuple[float, str]], int, bool]:
    """(text, accepted places, passes, whether something was lost)."""
    if text.isascii():
        return text, [], 0, False
    best, signs = _passes(model, text, margin, COMMON_PROPOSERS), set(text)
    if best[1] and not best[3]:
        return best  # nothing is left over for a rare chain to explain
    gain = sum(g for g, _ in best[1])
    for p in RARE_PROPOSERS:
        if p.possible(signs):
            other = _passes(model, text, margin, (p,))
            more = sum(g for g, _ in other[1])
            if more > gain + 1e-9:
                best, gain = other, more
    return best


def train(clean: DataFrame, text: str) -> Model:
    """Counts of all clean texts; each task adds up its own tables and sends what isn't zero."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables = [np.zeros(n, np.int64) for n in SLOTS]
        for b in batches:
            texts = [t for t in b.column(0).to_pylist() if t and seems_clean(t)]
            if not texts:
                continue
            # records are apart by two line ends, which also stand for a record's beginning and end
            x = np.frombuffer(("\n\n" + "\n\n".join(texts) + "\n\n").encode("utf-32-le", "replace"), np.uint32).astype(np.int64)
            tables[0] += np.bincount(x % SLOTS[0], minlength=SLOTS[0])
            tables[1] += np.bincount((x[:-1] * _P[0] + x[1:] * _P[1]) % SLOTS[1], minlength=SLOTS[1])
            tables[2] += np.bincount((x[:-2] * _P[0] + x[1:-1] * _P[1] + x[2:] * _P[2]) % SLOTS[2], minlength=SLOTS[2])
        for k, t in enumerate(tables):
            at = np.flatnonzero(t)
            for i in range(0, len(at), 100_000):
                part = at[i : i + 100_000]
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(part), k, np.int8)), pa.array(part.astype(np.int32)), pa.array(t[part])], ["k", "slot", "n"])

    sums = clean.select(text).mapInArrow(run, "k tinyint, slot int, n bigint").groupBy("k", "slot").agg(F.sum("n").alias("n"))
    got = sums.toArrow()
    k, slot, n = (got.column(c).to_numpy() for c in ("k", "slot", "n"))
    tables = []
    for i, size in enumerate(SLOTS):
        t = np.zeros(size, np.float32)
        t[slot[k == i]] = n[k == i]
        tables.append(t)
    return Model(tables)


def without(model: Model, texts: list[tuple[str, int]]) -> Model:
    """The model as if trained without these clean texts; each with the number of its rows."""
    tables = [t.astype(np.float64) for t in (model.t1, model.t2, model.t3)]
    for text, rows in texts:
        x = np.frombuffer(("\n\n" + text + "\n\n").encode("utf-32-le", "replace"), np.uint32).astype(np.int64)
        np.subtract.at(tables[0], x[2:] % SLOTS[0], rows)
        np.subtract.at(tables[1], (x[1:-1] * _P[0] + x[2:] * _P[1]) % SLOTS[1], rows)
        np.subtract.at(tables[2], (x[:-2] * _P[0] + x[1:-1] * _P[1] + x[2:] * _P[2]) % SLOTS[2], rows)
    return Model([np.maximum(t, 0).astype(np.float32) for t in tables])


def validate(model: Model, rows: DataFrame, shared: Broadcast, least: float = LEAST) -> float:
    """The margin between what honest texts reach and what nearly all corruptions reach, nearer to the former.

    All distinct texts that seem clean are judged, each by the model without it and its part.
    """
    spark, h = rows.sparkSession, F.xxhash64("text")
    size = rows.groupBy(h.alias("h")).agg(F.max(F.length("text")).alias("n")).agg(F.count("n").alias("texts"), F.coalesce(F.sum(F.col("n") + 64), F.lit(0)).alias("chars")).first()
    parts = max(PARTS, size["chars"] // PART_CHARS)
    part = F.pmod(h, F.lit(parts)).cast("int")
    if size["texts"] <= HELD_OUT and size["chars"] <= PART_CHARS:
        held: dict[int, Counter] = {}
        for r in rows.groupBy("text").count().select("text", "count", part.alias("part")).collect():
            held.setdefault(r["part"], Counter())[r["text"]] = r["count"]
        gains = [x for k, texts in sorted(held.items()) for x in judged_part(model, texts, k)]
        return margin(spark.createDataFrame(gains, GAINS), least)
    name = new_name()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        texts, k = Counter(), 0
        for b in batches:
            texts.update(b.column(0).to_pylist())
            k = b.column(1)[0].as_py() if b.num_rows else k
        got = judged_part(kept(name, lambda: Model(list(shared.value))), texts, k)
        for i in range(0, len(got), 100_000):
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*got[i : i + 100_000]), (pa.bool_(), pa.float64()))], ["corrupted", "gain"])

    # a part is a partition, so a worker that counts its rows knows the model without them
    return margin(cut(rows.select("text", part.alias("part")).repartitionById(parts, "part").mapInArrow(run, GAINS)), least)


def margin(gains: DataFrame, least: float) -> float:
    """The margin by the gains of all honest texts and of all corruptions."""
    reached = gains.filter("corrupted")
    bins = sorted((r["bin"], r["count"]) for r in reached.groupBy(F.floor("gain").alias("bin")).count().collect())
    honest, sure = gains.filter("not corrupted"), None
    rank = sum(n for _, n in bins) // 50
    for b, n in bins:
        if rank < n:
            sure = reached.filter(F.floor("gain") == b).orderBy("gain").offset(rank).limit(1).first()["gain"]
            break
        rank -= n
    over = F.lit(False) if sure is None else F.col("gain") >= sure
    r = honest.agg(F.count("gain").alias("texts"), F.count_if(over).alias("over"), F.max("gain").alias("all"), F.max(F.when(~over, F.col("gain"))).alias("under")).first()
    # a few that reach what corruptions do are garbled ones that seem clean; more are honest, as far as can be told
    highest = max(0.0, (r["under"] if r["over"] <= r["texts"] // ODD else r["all"]) or 0.0)
    if sure is None:
        sure = highest + 2 * least
    return max(least, (highest + sure) / 2 if sure > highest else highest)


def judged_part(model: Model, texts: Counter, k: int) -> list[tuple[bool, float]]:
    """(whether of a corruption, gain) of the clean texts of part k, by the model without them; with the rows of each."""
    clean = sorted(t for t in texts if seems_clean(t))
    if not clean:
        return []
    chance, reached = judged(without(model, [(t, texts[t]) for t in clean]), clean, k)
    return [*((False, g) for g in chance), *((True, g) for g in reached)]


def judged(model: Model, clean: list[str], first: int) -> tuple[list[float], list[float]]:
    """The gains that honest texts reach, and those of their corruptions."""
    chance, reached = [], []
    for t in clean:
        signs = set(t)
        places = {x for p in PROPOSERS if p.possible(signs) for x in p(t)}  # several chains often propose the same
        chance.append(max((model.gain(t, *x) for x in places), default=0.0))
    for i, t in enumerate(clean, first):
        p = COMMON_PROPOSERS[i % len(COMMON_PROPOSERS)]
        words = [w for w in t.split(" ") if any(c > "\x7f" for c in w)]
        if not words:
            continue
        word = words[i // len(COMMON_PROPOSERS) % len(words)]
        bad = p.garble(word)
        if bad is None:
            continue
        garbled = t.replace(word, bad, 1)
        at = garbled.find(bad)
        gains = [model.gain(garbled, a, b, new) for a, b, new in p(garbled) if a < at + len(bad) and b > at]
        if gains:
            reached.append(max(gains))
    return chance, reached


def restored(df: DataFrame, key: str, text: str) -> DataFrame:
    """(key, chains, gain, passes, lost, restored) of the affected rows."""
    spark = df.sparkSession
    rows = df.select(F.col(key).alias("key"), F.col(text).alias("text")).filter(F.col("key").isNotNull() & (F.length("text") > 0))
    source = spread(rows)
    model = train(source, "text")
    shared, name = spark.sparkContext.broadcast((model.t1, model.t2, model.t3)), new_name()
    enough = validate(model, rows, shared)
    kind = df.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = kept(name, lambda: Model(list(shared.value)))
        for b in batches:
            rows: list[list] = [[] for _ in range(6)]
            for k, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                new, accepted, passes, lost = repair(known, t, enough)
                gone = known.lost(t) if "\ufffd" in t else 0.0
                broken = gone > LEAST
                if accepted or broken:
                    values = (k, sorted({c for _, c in accepted}), max((g for g, _ in accepted), default=gone), passes, lost or broken, None if lost or broken else new)
                    for column, v in zip(rows, values):
                        column.append(v)
            kinds = (b.schema.field(0).type, pa.list_(pa.string()), pa.float64(), pa.int32(), pa.bool_(), pa.string())
            yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(rows, kinds)], ["key", "chains", "gain", "passes", "lost", "restored"])

    return source.mapInArrow(run, f"key {kind}, chains array<string>, gain double, passes int, lost boolean, restored string").distinct().withColumnRenamed("key", key)
