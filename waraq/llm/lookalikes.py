"""Problem 4: visually identical text with different characters.

Every text is first brought to one form where no judgement is needed: composed accents, compatibility
forms (full width, presentation forms, ligatures) resolved, invisible characters removed, one kind of
space, one keyboard for yeh, kaf and heh. Look-alikes of other alphabets are then repaired by token:
the token's scripts are counted, and in a token of mixed scripts, or of a script foreign to its text,
the letters are substituted toward the dominant script (else another of the token's) when the result
stands in the vocabulary of the corpus, that is among the tokens of one script that at least SEEN texts have. Honest foreign words
therefore stay as they are. Texts are the same to a reader when their repaired forms are the same. The
skeleton, in which any look-alike left over counts as its prototype, is a report beside the form.

Defined cases: null, empty and blank texts (also texts of invisible characters only) have no form and
no partner, nor have rows without an id; repeated rows count once; equal texts are partners; an empty table gives no rows; other
columns are ignored.
"""

from __future__ import annotations

import unicodedata
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from waraq.operators.groups import pairs_within, with_group
from waraq.session import cut, spread

#: Texts that must have a word for it to count as vocabulary, and words that a worker counts at a time.
SEEN, MEMO_WORDS = 2, 500_000
# Letters of other alphabets that are drawn like a Latin letter, and that Latin letter.
CYRILLIC = "аАвВеЕкКмМнНоОрРсСтТуУхХіІјЈѕЅһҺԁԛԜԝӏԌҮ"
CYRILLIC_AS = "aABBeEkKmMHHoOpPcCTTyYxXiIjJsShhdqWwlGY"
GREEK = "ΑαΒΕΖΗΙιΚκΜΝνΟοΡρΤΥυΧχϲϹϳͿ"
GREEK_AS = "AaBEZHIiKkMNvOoPpTYuXxcCjJ"
# The Arabic keyboard's letters, and the Urdu keyboard's.
KEYBOARD = "يىكهەۀ٠١٢٣٧٨٩"
KEYBOARD_AS = "ییکہہۂ۰۱۲۳۷۸۹"
# Small Cyrillic letters that only resemble a small capital are not look-alikes of a Latin letter.
_NOT_ALIKE = set("вмнткҺ")

LATIN, CYR, GRK, OTHER = "latin", "cyrillic", "greek", "other"
TO_LATIN = {a: b for a, b in [*zip(CYRILLIC, CYRILLIC_AS), *zip(GREEK, GREEK_AS)] if a not in _NOT_ALIKE}
_FROM_LATIN = {CYR: {b: a for a, b in zip(CYRILLIC, CYRILLIC_AS) if a not in _NOT_ALIKE}, GRK: {b: a for a, b in zip(GREEK, GREEK_AS)}}
_COMPATIBLE = regex.compile("[ﬀ-ﬆﭐ-ﷇﷰ-ﷻﹰ-ﻼ！-～Ⅰ-ⅿ]+")
_INVISIBLE = regex.compile(r"[\p{Cf}͏ᅟᅠ឴឵᠋-᠎︀-️\U000E0100-\U000E01EF]+")
_SPACES = regex.compile(r"[\s\p{Z}\x1c-\x1f\x85]+")
_HAMZA = ((r"ی" + "ٔ", "ئ"), ("ہ" + "ٔ", "ۂ"), ("و" + "ٔ", "ؤ"))
_KEYS = str.maketrans(KEYBOARD, KEYBOARD_AS)
_SKELETON = str.maketrans(TO_LATIN)
_TOKEN = regex.compile(r"[\p{L}\p{M}]+")
_SUSPECT = regex.compile(r"[\p{Script=Cyrillic}\p{Script=Greek}]")


def basic_form(text: str) -> str:
    """One form of a text without any judgement about alphabets."""
    t = _INVISIBLE.sub("", text)
    t = _COMPATIBLE.sub(lambda m: unicodedata.normalize("NFKC", m[0]), t)
    t = unicodedata.normalize("NFC", t)
    t = t.translate(_KEYS)
    for a, b in _HAMZA:
        if a in t:
            t = t.replace(a, b)
    return _SPACES.sub(" ", t).strip()


def skeleton(text: str) -> str:
    """Look-alikes as their prototypes, accents composed again."""
    if not _SUSPECT.search(text):
        return text
    parts = unicodedata.normalize("NFD", text).translate(_SKELETON)
    return basic_form(unicodedata.normalize("NFC", parts))


def _script(c: str) -> str | None:
    if c < "\x80" or "À" <= c <= "ɏ" or "Ḁ" <= c <= "ỿ":
        return LATIN if c.isalpha() else None
    if "Ͱ" <= c <= "Ͽ" or "ἀ" <= c <= "῿":
        return GRK
    if "Ѐ" <= c <= "ԯ":
        return CYR
    return OTHER if c.isalpha() else None


def token_scripts(token: str) -> Counter:
    return Counter(s for c in token if (s := _script(c)))


def toward(token: str, script: str) -> str | None:
    """The token with every foreign letter replaced by its look-alike in the script; None where one has none."""
    out = []
    for c in unicodedata.normalize("NFD", token):
        s = _script(c)
        if s in (None, script):
            out.append(c)
            continue
        c = TO_LATIN.get(c, c if s == LATIN else None)
        if c is not None and script != LATIN:
            c = _FROM_LATIN[script].get(c)
        if c is None:
            return None
        out.append(c)
    return unicodedata.normalize("NFC", "".join(out))


def candidates(token: str, text_script: str) -> list[str]:
    """Repairs of a token in order of preference; none for a token of the text's own script alone."""
    scripts = token_scripts(token)
    alphabets = {s: n for s, n in scripts.items() if s != OTHER}
    if not alphabets or (len(alphabets) == 1 and text_script in alphabets):
        return []
    if len(alphabets) == 1:
        goals = [text_script] if text_script != OTHER else []
    else:
        goals = sorted(alphabets, key=lambda s: (-alphabets[s], s != text_script, s))
    return [c for c in dict.fromkeys(toward(token, g) for g in goals) if c and c != token]


def text_script(tokens: list[str]) -> str:
    total: Counter = Counter()
    for t in tokens:
        total += token_scripts(t)
    total.pop(OTHER, None)
    return total.most_common(1)[0][0] if total else OTHER


def suspects(text: str) -> dict[str, list[str]]:
    """Tokens with letters of another alphabet than they seem, and their possible repairs."""
    if not _SUSPECT.search(text):
        return {}
    tokens = _TOKEN.findall(text)
    script = text_script(tokens)
    found = {t: candidates(t, script) for t in set(tokens) if _SUSPECT.search(t)}
    return {t: c for t, c in found.items() if c}


def consistent(df: DataFrame, key: str, text: str, seen: int = SEEN) -> DataFrame:
    """(key, form, skeleton) of each distinct row with visible text; seen: texts that make a word one of the corpus."""
    source = spread(df.select(F.col(key).alias("key"), F.col(text).alias("text")).filter(F.col("key").isNotNull() & F.col("text").isNotNull()))
    kind = df.schema[key].dataType.simpleString()

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keys, forms, odd = [], [], []
            for k, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                form = basic_form(t)
                if form:
                    keys.append(k)
                    forms.append(form)
                    odd.append([{"token": t, "goals": c} for t, c in suspects(form).items()])
            yield pa.RecordBatch.from_arrays([pa.array(keys, b.schema.field(0).type), pa.array(forms, pa.string()), pa.array(odd, pa.list_(pa.struct([("token", pa.string()), ("goals", pa.list_(pa.string()))])))], ["key", "form", "odd"])

    base = cut(source.mapInArrow(first, f"key {kind}, form string, odd array<struct<token:string,goals:array<string>>>").distinct())

    def vocabulary(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter = Counter()
        for b in batches:
            for x in b.column(0).to_pylist():
                seen.update(set(_TOKEN.findall(x)))
            if len(seen) > MEMO_WORDS:
                yield counted(seen)
                seen = Counter()
        yield counted(seen)

    def counted(seen: Counter) -> pa.RecordBatch:
        known = [t for t in seen if len(token_scripts(t)) == 1]
        return pa.RecordBatch.from_arrays([pa.array(known, pa.string()), pa.array([seen[t] for t in known], pa.int64())], ["word", "n"])

    words = base.select("form").mapInArrow(vocabulary, "word string, n bigint").groupBy("word").agg(F.sum("n").alias("n")).filter(F.col("n") >= seen).select("word")
    goals = base.select(F.explode("odd").alias("o")).select("o.token", "o.goals").distinct().select("token", F.posexplode("goals").alias("rank", "word"))
    repairs = goals.join(words, "word").groupBy("token").agg(F.min_by("word", F.struct("rank", "word")).alias("word"))
    fixes = base.select("key", "form", F.explode("odd").alias("o")).select("key", F.xxhash64("form").alias("f"), F.col("o.token").alias("token")).join(repairs, "token").groupBy("key", "f").agg(F.collect_list(F.struct("token", "word")).alias("fixes"))

    def second(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            forms, bones = [], []
            for form, fix in zip(b.column(1).to_pylist(), b.column(2).to_pylist()):
                if fix:
                    known = {f["token"]: f["word"] for f in fix}
                    form = _TOKEN.sub(lambda m: known.get(m[0], m[0]), form)
                forms.append(form)
                bones.append(skeleton(form))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(forms, pa.string()), pa.array(bones, pa.string())], ["key", "form", "skeleton"])

    joined = base.select("key", "form", F.xxhash64("form").alias("f")).join(fixes, ["key", "f"], "left").select("key", "form", "fixes")
    return joined.mapInArrow(second, f"key {kind}, form string, skeleton string")


def same_look(forms: DataFrame) -> DataFrame:
    """(id_a, id_b), id_a < id_b: keys whose texts look the same, that is have the same form."""
    prints = cut(forms.select("key", F.md5("form").alias("p")).distinct())
    return pairs_within(prints, "p", "key").select(F.col("a").alias("id_a"), F.col("b").alias("id_b")).filter(F.col("id_a") < F.col("id_b")).distinct()


def looks(forms: DataFrame) -> DataFrame:
    """(key, look, size): each key with the smallest key of its look as the name of the class, and the number of its keys."""
    prints = forms.select("key", F.md5("form").alias("p")).distinct()
    return with_group(prints, "p", "key", F.min("key").alias("look"), F.count("*").alias("size")).select("key", "look", "size").distinct()
