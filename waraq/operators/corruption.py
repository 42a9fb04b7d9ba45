"""Seeded damage to text: romanization, code switching, OCR confusions and spacing.

What happens to a document follows from its id, the seed and its text, so a rerun or another
partitioning gives the same result. Romanization and code switching are native expressions: vowels that
the script doesn't write are marked by one pattern over the neighbours of a letter, then letters are translated. OCR and
spacing damage is drawn as a plan of edits, all places of a document at once, and then applied.

Half of the OCR damage can be undone: variants, digits, presentation forms and invisible characters are
taken from what normalization folds and deletes, so normalization gives back a text that was normalized.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from waraq.config import Damage
from waraq.functions.text import stable_unit, text_or_empty
from waraq.operators.normalize import DELETIONS, DIGITS, FOLDS, presentation_forms
from waraq.session import spread

# Letters and their usual Roman spelling, within, at the beginning and at the end of a word.
ROMAN = {
    "ا": "a", "آ": "aa", "ب": "b", "پ": "p", "ت": "t", "ٹ": "t", "ث": "s", "ج": "j",
    "چ": "ch", "ح": "h", "خ": "kh", "د": "d", "ڈ": "d", "ذ": "z", "ر": "r", "ڑ": "r",
    "ز": "z", "ژ": "zh", "س": "s", "ش": "sh", "ص": "s", "ض": "z", "ط": "t", "ظ": "z",
    "ع": "a", "غ": "gh", "ف": "f", "ق": "q", "ک": "k", "گ": "g", "ل": "l", "م": "m",
    "ن": "n", "ں": "n", "و": "o", "ہ": "h", "ۂ": "ae", "ھ": "h", "ء": "", "ئ": "y",
    "ی": "i", "ے": "e", "ۓ": "e", "۔": ".", "،": ",", "؟": "?", "؛": ";", "٪": "%",
}
ROMAN_FIRST = {"و": "w", "ی": "y", "ا": "a", "آ": "aa", "ع": "a"}
ROMAN_LAST = {"ہ": "a", "و": "o", "ی": "i", "ے": "e"}
VOWELS = "اآوىیےۂۓءئ"
# Letters that differ in their dots only.
DOT_FAMILIES = ("بپتٹثنی", "جچحخ", "دڈذ", "رڑزژ", "سش", "صض", "طظ", "عغ", "فق", "کگ", "ہھ", "ںن")

#: What a word of the script is made of.
SCRIPT = r"\x{600}-\x{6FF}\x{750}-\x{77F}\x{8A0}-\x{8FF}\x{FB50}-\x{FDFF}\x{FE70}-\x{FEFF}"
_CONSONANTS = "".join(c for c, x in ROMAN.items() if x.isalpha() and c not in VOWELS)
_SILENT = VOWELS + "ہ"  # no vowel is read before these
_MARK = "\uFFFE"


def romanized(text: Column) -> Column:
    """Words of the script in Roman letters, their punctuation in its Latin form; everything else stays.

    A consonant has an unwritten vowel after it when another consonant follows: always at the beginning of a word,
    elsewhere only if that one isn't followed by a written vowel itself.
    """
    word, follower = f"[{SCRIPT}]", f"[{SCRIPT}&&[^{_SILENT}ھ]]"
    vowel = f"(?<!{word})[{_CONSONANTS}](?={follower})|(?<={word})[{_CONSONANTS}](?={follower}(?![{_SILENT}]))"
    t = F.regexp_replace(text, f"({vowel})", f"$1{_MARK}")
    inside = rf"{SCRIPT}{_MARK}"
    t = F.regexp_replace(t, f"(?<=[{VOWELS}])ہ(?![{inside}])", "h")
    for c, x in ROMAN_FIRST.items():
        if ROMAN[c] != x:
            t = F.regexp_replace(t, f"(?<![{inside}]){c}", x)
    for c, x in ROMAN_LAST.items():
        if ROMAN[c] != x:
            t = F.regexp_replace(t, f"{c}(?![{inside}])", x)
    for c, x in ROMAN.items():
        if len(x) > 1:
            t = F.replace(t, F.lit(c), F.lit(x))
    single = {c: x for c, x in ROMAN.items() if len(x) == 1} | {_MARK: "a"}
    t = F.translate(t, "".join(single), "".join(single.values()))
    return F.when(text.rlike(word), F.regexp_replace(t, word, "")).otherwise(text)


def switched(text: Column, id_: Column, seed: int, config: Damage = Damage()) -> Column:
    """The text with some of its words of the script romanized; how many is drawn for each document."""
    name = F.concat(id_.cast("string"), F.lit(f"|{seed}"))
    low, high = config.switch_rate
    share = F.lit(low) + F.lit(high - low) * stable_unit(name, "switch-share")
    runs = F.regexp_extract_all(text, F.lit(f"([{SCRIPT}]+|[^{SCRIPT}]+)"), F.lit(1))
    pick = lambda x, i: F.when(x.rlike(f"^[{SCRIPT}]") & (stable_unit(F.concat(name, F.lit("|"), i.cast("string")), "switch") < share), romanized(x)).otherwise(x)
    return F.array_join(F.transform(runs, pick), "")


@lru_cache(maxsize=1)
def confusions() -> dict[str, list[str]]:
    """For each letter those that differ from it in their dots."""
    return {c: sorted({x for f in DOT_FAMILIES if c in f for x in f} - {c}) for f in DOT_FAMILIES for c in f}


@lru_cache(maxsize=1)
def reversible() -> dict[str, list[str]]:
    """For each character what normalization would make it of: the first kind of variants, digits and presentation forms that there is."""
    kinds: list[dict[str, list[str]]] = [{}, {}, {}]
    for variants, clean in FOLDS.values():
        kinds[0].setdefault(clean, []).extend(variants)
    for variant, clean in zip(*DIGITS):
        kinds[1].setdefault(clean, []).append(variant)
    for form, clean in presentation_forms().items():
        if len(clean) == 1 and not clean.isspace():
            kinds[2].setdefault(clean, []).append(form)
    return kinds[2] | kinds[1] | kinds[0]


INVISIBLE = "".join(DELETIONS.values())


def _generator(doc_id: object, seed: int, kind: str) -> np.random.Generator:
    key = int.from_bytes(hashlib.sha256(f"{kind}|{seed}|{doc_id}".encode()).digest()[:16], "big")
    return np.random.Generator(np.random.Philox(key=key))


def _between(draw: np.random.Generator, span: tuple[float, float]) -> float:
    return span[0] + (span[1] - span[0]) * draw.random()


def ocr(text: str, draw: np.random.Generator, config: Damage = Damage()) -> str:
    """Confuses letters by their dots, drops and doubles others, and brings in what normalization undoes."""
    rate = _between(draw, config.ocr_rate)
    places = np.flatnonzero(draw.random(len(text)) < rate)
    signs, confused, undone = list(text), confusions(), reversible()
    for at, (lossy, way, pick) in zip(places.tolist(), draw.random((len(places), 3)).tolist()):
        c = signs[at]
        if lossy < config.ocr_lossy_share:
            others = confused.get(c)
            signs[at] = others[int(pick * len(others))] if others else "" if way < config.drop_share else c + c if way < config.drop_share + config.double_share else c
        elif way < config.ocr_insert_share:
            signs[at] = c + INVISIBLE[int(pick * len(INVISIBLE))]
        elif c in undone:
            signs[at] = undone[c][int(pick * len(undone[c]))]
    return "".join(signs)


def spacing(text: str, draw: np.random.Generator, config: Damage = Damage()) -> str:
    """Joins some words and splits others; no character but the space changes."""
    words = text.split(" ")
    rate = _between(draw, config.spacing_rate)
    hit = draw.random(len(words) - 1) < rate
    between = [" "] * (len(words) - 1)
    for i, (way, pick) in zip(np.flatnonzero(hit).tolist(), draw.random((int(hit.sum()), 2)).tolist()):
        word = words[i + 1]
        if way < config.spacing_join_share and words[i]:
            between[i] = ""
        elif len(word) > 3:
            at = 1 + int(pick * (len(word) - 1))
            words[i + 1] = word[:at] + " " + word[at:]
    return words[0] + "".join(b + w for b, w in zip(between, words[1:]))


def restore_task(text: str, draw: np.random.Generator, config: Damage = Damage()) -> str:
    """What a scan does: signs first, then the gaps between them."""
    return spacing(ocr(text, draw, config), draw, config)


DRAWN: dict[str, Callable[[str, np.random.Generator, Damage], str]] = {"spacing": spacing, "ocr": ocr, "restore": restore_task}
KINDS = (*DRAWN, "code_switch", "romanize")


def corrupt(docs: DataFrame, kind: str, seed: int = 0, id_col: str = "doc_id", text_col: str = "text", config: Damage = Damage()) -> DataFrame:
    """(id, text) with one kind of damage; null texts stay null."""
    source = docs.select(F.col(id_col).alias(id_col), F.col(text_col).alias("text"))
    if kind == "romanize":
        return source.withColumn("text", romanized(F.col("text")))
    if kind == "code_switch":
        return spread(source).withColumn("text", F.when(F.col("text").isNotNull(), switched(text_or_empty(F.col("text")), F.col(id_col), seed, config)))
    change, id_kind = DRAWN[kind], docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            new = [t and change(t, _generator(i, seed, kind), config) for i, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist())]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(new, pa.string())], [id_col, "text"])

    return spread(source).mapInArrow(run, f"{id_col} {id_kind}, text string")
