"""Script shares and language evidence from function words and letters, with pluggable word lists."""

from __future__ import annotations

import re
import unicodedata
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache, reduce
from itertools import product

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, IntegerType, StringType, StructField, StructType

from waraq.config import Language
from waraq.functions.text import text_or_empty
from waraq.session import spread

# Script ranges.
ARABIC = r"\x{600}-\x{6FF}\x{750}-\x{77F}\x{870}-\x{89F}\x{8A0}-\x{8FF}\x{FB50}-\x{FDFF}\x{FE70}-\x{FEFF}"
LATIN = r"\x{41}-\x{5A}\x{61}-\x{7A}\x{C0}-\x{24F}\x{1E00}-\x{1EFF}"
DEVANAGARI = r"\x{900}-\x{97F}"
SCRIPTS = ("arabic", "latin", "devanagari", "other")

# Letters that mark Urdu and Arabic.
URDU_LETTERS = "ٹڈڑںےۓہۂھ"
ARABIC_LETTERS = "ةًٌٍأإؤئى"

# Function words of each language.
URDU_WORDS = """
ہے ہیں ہو ہوا ہوئی ہوئے ہونے تھا تھی تھے کے کی کا کو نے سے میں پر اور یہ وہ کہ بھی نہیں
گیا گئی گئے کیا کرنے کرنا کرتے کرتی کرتا لیے لئے ساتھ اس ان ایک ہر جو جس تک بعد دیا رہے
رہا رہی ہمیں انہوں انہیں والے والی والا کچھ سب پھر اگر لیکن مگر آپ ہم تم میرے اپنے اپنی
بہت زیادہ کیوں کیسے کہاں جب تب صرف طرح بارے دوران خلاف بجائے علاوہ
"""
PERSIAN_WORDS = """
است این آن را که های برای می هم ما شما بود شد کرد خود دیگر بسیار هستند نیست چه کجا آیا
توسط بین درباره باشد کنید کند شود شده کرده بودند آنها یک هر ولی اگر اما چون تا روی نیز
"""
ARABIC_WORDS = """
في من على عن إلى هذا هذه التي الذي أن إن كان قد لا ما بين بعد كل هو هي كما حيث لكن عند
أو ثم كانت يكون تكون الذين ذلك تلك أي بها به له لها منذ حتى وقد وقال أيضا نحن أنا
"""
ENGLISH_WORDS = """
the of and to in is it that for was on with as are be this have from at by not but or an they we you he she his her
all would there their what so up out if about who which when will can has had more one been my me no do does did said
than then them these into over only also its may such other some time could our your any first new like now people
after most made where how because being were very much many should must under between while during before same both
each own too still every another however us main per say
"""


# Consonants and their usual Roman spelling.
_CONSONANTS = {
    "ب": "b", "پ": "p", "ت": "t", "ٹ": "t", "ج": "j", "چ": "ch", "ح": "h", "خ": "kh", "د": "d", "ڈ": "d", "ر": "r",
    "ڑ": "r", "ز": "z", "س": "s", "ش": "sh", "ص": "s", "ض": "z", "ط": "t", "ظ": "z", "غ": "gh", "ف": "f", "ق": "q",
    "ک": "k", "گ": "g", "ل": "l", "م": "m", "ن": "n", "و": "w", "ی": "y", "ہ": "h",
}
_LONG = {"ا": ("a", "aa"), "آ": ("aa", "a"), "و": ("o", "u", "oo"), "ی": ("i", "e", "ai", "ee"), "ے": ("e", "ay", "ai", "ey"), "ئ": ("", "y"), "ں": ("n", ""), "ھ": ("h",), "ع": ("a", "")}


def spellings(word: str, most: int = 8) -> list[str]:
    """Roman spellings of a word, which has no fixed one: the plainest ones, from three letters on.

    Of two letters there is only the plainest, and only with h, j or k, as short words with most other letters stand in many languages.

    A letter is read as a long vowel where it isn't at the beginning or before another one, and a short vowel may stand
    between two consonants; a spelling is the plainer the earlier its choices stand.
    """
    choices: list[tuple[str, ...]] = []
    for i, c in enumerate(word):
        after = word[i + 1 : i + 2]
        vowel = c in _LONG and (c not in "وی" or (i > 0 and after not in ("ا", "ے", "ی")))
        if c == "ہ" and i == len(word) - 1 and i > 0:
            choices.append(("a", "ah", "e") if word[i - 1] not in _LONG else ("", "h"))
        elif vowel:
            choices.append(_LONG[c])
        else:
            x = _CONSONANTS.get(c, "")
            choices.append((x + "a", x + "i", x + "u", x) if after and after not in _LONG and (after != "ہ" or i + 2 < len(word)) else (x,))
    ranked = sorted(product(*(range(len(c)) for c in choices)), key=lambda t: (sum(t), t))
    found = dict.fromkeys("".join(c[k] for c, k in zip(choices, t)) for t in ranked)
    return [w for k, w in enumerate(found) if len(w) > 2 or (k == 0 and len(w) == 2 and w[0] in "hjk")][:most]


#: Labelled samples that a word list is learned from, at most.
MAX_SAMPLES = 50_000


def learned_words(samples: DataFrame, language: str = "roman_urdu", others: tuple[str, ...] = ("english", "other"), least: int = 2, times: int = 8) -> tuple[str, ...]:
    """The Latin-script words of a language by labelled samples: seen often enough, and so many times as frequent as in each of the others. samples: (label, text)."""
    wanted = samples.filter(F.col("label").isin(language, *others) & F.col("text").isNotNull()).select("label", "text").orderBy(F.xxhash64("text"), "text").limit(MAX_SAMPLES)
    words = wanted.select("label", F.explode(F.regexp_extract_all(F.lower("text"), F.lit("([a-z][a-z']*)"), F.lit(1))).alias("w"))
    names = (language, *others)
    of = lambda name: F.count_if(F.col("label") == name)
    each = words.groupBy("w").agg(*(of(x).alias(f"n{i}") for i, x in enumerate(names)))
    total = words.agg(*(of(x).alias(f"t{i}") for i, x in enumerate(names)))  # a single row
    rarer = [F.col("n0") * F.col(f"t{i}") >= times * F.col(f"n{i}") * F.col("t0") for i in range(1, len(names))]
    kept = each.join(F.broadcast(total)).filter((F.col("n0") >= least) & reduce(lambda a, b: a & b, rarer)).select("w")
    return tuple(sorted(r["w"] for r in kept.collect()))


@dataclass(frozen=True)
class Profile:
    """Word lists of the languages to tell apart; words that two Latin-script languages share count for neither.

    Roman Urdu words are the spellings of the Urdu ones unless a list is given, which learned_words() makes of samples.
    """

    urdu: tuple = tuple(URDU_WORDS.split())
    persian: tuple = tuple(PERSIAN_WORDS.split())
    arabic: tuple = tuple(ARABIC_WORDS.split())
    roman_urdu: tuple = field(default_factory=lambda: tuple(sorted({x for w in URDU_WORDS.split() for x in spellings(w)})))
    english: tuple = tuple(ENGLISH_WORDS.split())
    expected: dict = field(default_factory=lambda: {"urdu": (("arabic",), 0.60), "roman_urdu": (("latin",), 0.60), "code_switched": (("arabic", "latin"), 0.90)})

    def only(self, name: str, other: str) -> tuple:
        return tuple(sorted(set(getattr(self, name)) - set(getattr(self, other))))


URDU_PROFILE = Profile()


def script_counts(text: Column) -> Column:
    """struct of letters by script; every character beyond the basic plane counts as other."""
    t = text_or_empty(text)
    letters = F.regexp_count(t, F.lit(r"\p{L}"))
    arabic = F.regexp_count(t, F.lit(rf"[\p{{L}}&&[{ARABIC}]]"))
    latin = F.regexp_count(t, F.lit(rf"[\p{{L}}&&[{LATIN}]]"))
    devanagari = F.regexp_count(t, F.lit(rf"[\p{{L}}&&[{DEVANAGARI}]]"))
    beyond = F.regexp_count(t, F.lit(r"[\x{10000}-\x{10FFFF}&&[^\p{L}]]"))
    return F.struct(arabic.alias("arabic"), latin.alias("latin"), devanagari.alias("devanagari"), (letters - arabic - latin - devanagari + beyond).alias("other"), (letters + beyond).alias("letters"))


_ARABIC_WORD = re.compile("[\u0600-\u06ff\u0750-\u077f\u08a0-\u08ff]+")
_LATIN_WORD = re.compile("[A-Za-z][A-Za-z']*")
_SENTENCE = re.compile("[۔؟?!.]+[ \t-\r\u200f\u200e]*|\n+")
SCORES = ("urdu", "persian", "arabic", "roman_urdu", "english", "lowercase")
_SCRIPT_FIELDS, _SCORE_FIELDS = ("arabic", "latin", "devanagari", "other", "letters"), SCORES


def _ranges(pattern: str) -> list[tuple[int, int]]:
    return [(int(a, 16), int(b, 16)) for a, b in re.findall(r"\\x\{(\w+)\}-\\x\{(\w+)\}", pattern)]


@lru_cache(maxsize=1)
def _classes() -> np.ndarray:
    """For each character of the basic plane: 1 to 4 for letters of SCRIPTS, 0 for the rest; with 8 and 16 for letters that mark Urdu and Arabic."""
    out = np.zeros(0x10000, np.uint8)
    for point in range(0x10000):
        if unicodedata.category(chr(point))[0] == "L":
            out[point] = 4
    for k, pattern in enumerate((ARABIC, LATIN, DEVANAGARI), 1):
        for first, last in _ranges(pattern):
            part = out[first : last + 1]
            part[part > 0] = k
    for marks, bit in ((URDU_LETTERS, 8), (ARABIC_LETTERS, 16)):
        for c in marks:
            out[ord(c)] |= bit
    return out


class Judge:
    """Scripts, scores and labels of texts, a batch at a time."""

    def __init__(self, profile: Profile, config: Language):
        self.config = config
        self.arabic_words: dict[str, int] = {}
        for bit, words in ((1, profile.urdu), (2, profile.persian), (4, profile.arabic)):
            for w in words:
                self.arabic_words[w] = self.arabic_words.get(w, 0) | bit
        self.latin_words = {w: 1 for w in profile.only("roman_urdu", "english")} | {w: 2 for w in profile.only("english", "roman_urdu")}

    def evidence(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(letters by script and in all, scores) of each text."""
        n = len(texts)
        points = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)
        owner = np.repeat(np.arange(n), [len(t) for t in texts])
        kind = np.where(points > 0xFFFF, 4, _classes()[np.minimum(points, 0xFFFF)])
        counts = np.bincount(owner * 5 + (kind & 7), minlength=5 * n).reshape(n, 5)
        counts = np.concatenate([counts[:, 1:], counts[:, 1:].sum(1, keepdims=True)], 1)
        marks = np.stack([np.bincount(owner[(kind & bit) > 0], minlength=n) for bit in (8, 16)], 1) / np.maximum(counts[:, 4:], 1)
        scores = np.zeros((n, len(SCORES)))
        for i, text in enumerate(texts):
            words = _ARABIC_WORD.findall(text) if counts[i, 0] else ()
            if words:
                got = Counter(map(self.arabic_words.get, words))
                for bit in (0, 1, 2):
                    scores[i, bit] = sum(k for mask, k in got.items() if mask and mask >> bit & 1) / len(words)
                scores[i, 0] += self.config.urdu_letter_weight * marks[i, 0]
                scores[i, 2] += self.config.arabic_letter_weight * marks[i, 1]
            words = _LATIN_WORD.findall(text) if counts[i, 1] else ()
            if words:
                low = text.lower() if len(text) == len(text.lower()) else None
                lowered = _LATIN_WORD.findall(low) if low is not None else ()
                if len(lowered) != len(words):
                    lowered = [w.lower() for w in words]
                got = Counter(map(self.latin_words.get, lowered))
                scores[i, 3], scores[i, 4] = got[1] / len(words), got[2] / len(words)
                scores[i, 5] = sum(len(w) > 1 and w == x for w, x in zip(words, lowered)) / len(words)
        return counts, scores

    def labels(self, counts: np.ndarray, scores: np.ndarray) -> list[str]:
        """The language of each span from its scripts and scores, for one script or a mixture of two; ties go to what is named first."""
        c = self.config
        n = counts[:, 4]
        share = counts[:, :4] / np.maximum(n, 1)[:, None]

        def side(columns: tuple[int, ...], names: tuple[str, ...], unsure: str) -> np.ndarray:
            part = scores[:, columns]
            order = np.sort(part, 1)
            sure = (order[:, -1] >= c.min_evidence) & (order[:, -1] - order[:, -2] >= c.min_margin)
            return np.where(sure, np.array(names)[part.argmax(1)], unsure)

        arabic = side((0, 1, 2), ("urdu", "persian", "arabic"), "urdu")
        latin = side((3, 4), ("roman_urdu", "english"), "other")
        top = share.max(1)
        single = np.select([share[:, 0] == top, share[:, 1] == top, share[:, 2] == top], [arabic, latin, "hindi"], "other")
        mixed = 1 - top >= c.mixed_min_ratio
        switched = mixed & (share[:, 0] >= c.mixed_min_ratio) & (share[:, 1] >= c.mixed_min_ratio) & (arabic == "urdu") & (scores[:, 5] >= c.running_text_rate)
        return np.where(n == 0, "empty", np.where(switched, "code_switched", single)).tolist()

    def classify(self, texts: list[str]) -> tuple[list[str], np.ndarray, np.ndarray]:
        """(labels, counts, scores); mixed texts are labelled by the letters of their labelled sentences."""
        c = self.config
        counts, scores = self.evidence(texts)
        labels = self.labels(counts, scores)
        top = counts[:, :4].max(1) / np.maximum(counts[:, 4], 1)
        mixed = np.flatnonzero((counts[:, 4] >= c.min_letters) & (1 - top >= c.mixed_min_ratio)).tolist()
        parts = [(i, p) for i in mixed for p in _SENTENCE.split(texts[i])]
        if parts:
            inner, inner_scores = self.evidence([p for _, p in parts])
            held: dict[int, Counter] = {}
            for (i, _), label, n in zip(parts, self.labels(inner, inner_scores), inner[:, 4].tolist()):
                if n >= c.sentence_min_letters:
                    held.setdefault(i, Counter())[label] += n
            for i, by in held.items():
                total = sum(by.values())
                partner = max(by["english"], by["roman_urdu"])
                if by["code_switched"] >= c.code_switch_min_share * total or (by["urdu"] >= c.alternation_min_share * total and partner >= c.alternation_min_share * total):
                    labels[i] = "code_switched"
                else:
                    labels[i] = min(by, key=lambda k: (-by[k], k))
        return [x if n >= c.min_letters else "empty" for x, n in zip(labels, counts[:, 4].tolist())], counts, scores


def _judged(docs: DataFrame, profile: Profile, config: Language, text_col: str, labelled: bool) -> DataFrame:
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        judge = Judge(profile, config)
        for b in batches:
            texts = [t or "" for t in b.column(at).to_pylist()]
            labels, counts, scores = judge.classify(texts) if labelled else ([], *judge.evidence(texts))
            found = [pa.StructArray.from_arrays([pa.array(x.astype(np.int32)) for x in counts.T], list(_SCRIPT_FIELDS)), pa.StructArray.from_arrays([pa.array(np.ascontiguousarray(x)) for x in scores.T], list(_SCORE_FIELDS))]
            names = [*b.schema.names, "scripts", "scores"]
            if labelled:
                found.append(pa.array(labels, pa.string()))
                names.append("label")
            yield pa.RecordBatch.from_arrays([*b.columns, *found], names)

    schema = StructType([*docs.schema.fields, StructField("scripts", StructType([StructField(f, IntegerType()) for f in _SCRIPT_FIELDS])), StructField("scores", StructType([StructField(f, DoubleType()) for f in _SCORE_FIELDS]))])
    if labelled:
        schema = schema.add("label", StringType())
    return docs.mapInArrow(run, schema)


def with_evidence(docs: DataFrame, profile: Profile = URDU_PROFILE, config: Language = Language(), text_col: str = "text") -> DataFrame:
    """Adds scripts (letters by script) and scores (urdu, persian, arabic, roman_urdu, english, lowercase), in one Arrow pass."""
    return _judged(spread(docs), profile, config, text_col, False)


def classify(docs: DataFrame, profile: Profile = URDU_PROFILE, config: Language = Language(), text_col: str = "text") -> DataFrame:
    """Adds scripts, scores and label in one Arrow pass: mixed documents are labelled by the letters of their labelled sentences, all of them."""
    return _judged(spread(docs), profile, config, text_col, True)


def log(classified: DataFrame) -> DataFrame:
    """(label, documents, letters): what each label holds."""
    return classified.groupBy("label").agg(F.count("*").alias("documents"), F.sum("scripts.letters").cast("bigint").alias("letters"))


KEPT = ("urdu", "roman_urdu", "code_switched")


def kept(classified: DataFrame) -> DataFrame:
    return classified.filter(F.col("label").isin(*KEPT))
