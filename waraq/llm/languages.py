"""Problem 7: the language of each segment and document, by multilingual mixture inference.

Each language has a word model: a character n-gram model with smoothing by shorter contexts, mixed
with the frequencies of whole words. A segment is a mixture of languages; expectation maximisation
finds the proportions under which its words are likeliest, over sets of one to all of the
languages, and the set with the best likelihood penalised by its size (BIC) is taken. Words then share
out their letters by their posterior language.

A document is inferred in the same way from all its segments. A segment that no mixture could explain
better is one unit, the words of the others are units of their own. Units are counted by their signature, the log
likelihoods of the languages below the best one in steps, of which there are boundedly many
however large the document, and EM and the choice of the set run over the counted signatures.

The models are first fitted on the labelled samples and then once more on counts of all segments whose
recorded label agrees with a sure first result, which adds the vocabulary of the corpus. Counts of words and
of n-grams are held in hashed tables of a fixed size, so what is sent to the workers is bounded however many words
the corpus has, and every language has slots of its own.

Defined cases: segments without a document id, without text or with fewer than min_letters letters have no language and do
not count for their document; a document without any other segment has no row; ties go to the
language named first; repeated rows count once; other columns are ignored.
"""

from __future__ import annotations

import math
import unicodedata
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from waraq.llm.words import kept, new_name
from waraq.session import spread

LANGUAGES = ("urdu", "roman_urdu", "english", "persian", "arabic", "hindi", "other")
LABELS = (*LANGUAGES, "code_switched")
MIN_LETTERS = 20
SWITCH_SHARE = 0.3
ORDER = 5
ITERATIONS = 12
#: Weight of what all languages of a script have seen, and what one more language in a mixture must gain for each log word.
SHARED, PENALTY = 0.2, 3.0
#: How far the words beside a word speak for its language: their weight, and the most that one of them may say.
BESIDE, BESIDE_MOST = 0.5, 4.0
#: Labelled samples that the first models are fitted on, at most.
MAX_LABELLED = 50_000
MEMO_WORDS = 300_000
#: Slots of each language for words, n-grams and their contexts, whatever the corpus; counts of n-grams are whole parts of 1 / WEIGHT.
WORD_SLOTS, GRAM_SLOTS, CONTEXT_SLOTS, WEIGHT = 1 << 20, 1 << 20, 1 << 19, 1000
#: Characters that an unseen one is one of.
ALPHABET = 200
_CF = regex.compile(r"\p{Cf}+")
#: Size of the steps in which a signature counts, the steps at most, and the bits of each language.
STEP, DEEPEST, BITS = 0.25, 255, 8
# The Arabic keyboard's letters as Urdu text may have them, and the Urdu keyboard's.
_KEYS = str.maketrans("يكهى", "یکہی")
_FLOOR = -60.0


def _same_script(language: str, word: str) -> bool:
    c = word[:1]
    if "\u0600" <= c <= "\u06ff":
        return language in ("urdu", "persian", "arabic")
    if "\u0900" <= c <= "\u097f":
        return language == "hindi"
    return language in ("roman_urdu", "english", "other")


class _Signs(dict):
    """For str.translate: letters, marks, invisible signs and apostrophes stay, the rest becomes space."""

    def __missing__(self, point: int) -> int:
        c = chr(point)
        kind = unicodedata.category(c)
        self[point] = point if kind[0] in "LM" or kind == "Cf" or c in "'’" else 32
        return self[point]


_SIGNS = _Signs()


def _n_letters(word: str) -> int:
    return sum(map(str.isalpha, word))


def words(text: str) -> list[str]:
    return [_CF.sub("", w).lower() for w in text.translate(_SIGNS).split() if _n_letters(w)]


def _slot(text: str, slots: int) -> int:
    return xxhash.xxh3_64_intdigest(text.encode("utf-8", "surrogatepass")) % slots


def _contexts(word: str) -> list[tuple[str, str]]:
    """(context, character) of each n-gram of a word up to ORDER, by character and from the empty context up."""
    marked = "^" + word + "$"
    return [(marked[i - k : i], marked[i]) for i in range(1, len(marked)) for k in range(min(i, ORDER - 1) + 1)]


class Counts:
    """Counts of words and n-grams by language and slot, as they are added up."""

    def __init__(self) -> None:
        self.words: Counter = Counter()
        self.grams: Counter = Counter()

    def add(self, language: int, word: str, n: int) -> None:
        self.words[language, _slot(word, WORD_SLOTS)] += n
        weight = round(WEIGHT * (1 + math.log(n)))  # a frequent word shouldn't drown the others' spelling
        for context, c in _contexts(word):
            self.grams[language, _slot(f"{context}\x00{c}", GRAM_SLOTS), _slot(context, CONTEXT_SLOTS)] += weight

    def rows(self) -> list[tuple[int, int, int, int]]:
        """(language, slot, slot of the context or -1 for a word, count)."""
        return [(a, w, -1, n) for (a, w), n in self.words.items()] + [(a, g, c, n) for (a, g, c), n in self.grams.items()]


class Model:
    """Log likelihood of words for each language."""

    def __init__(self, language: np.ndarray, slot: np.ndarray, context: np.ndarray, count: np.ndarray):
        """The columns of Counts.rows(), each (language, slot) of a word and of an n-gram once."""
        k = len(LANGUAGES)
        word = context < 0
        self.known = np.zeros((k, WORD_SLOTS), np.float32)
        self.known[language[word], slot[word]] = count[word]
        self.totals = np.bincount(language[word], count[word], k)
        self.grams = np.zeros((k, GRAM_SLOTS), np.float32)
        self.grams[language[~word], slot[~word]] = count[~word] / WEIGHT
        self.mass, self.kinds = np.zeros((k, CONTEXT_SLOTS), np.float32), np.zeros((k, CONTEXT_SLOTS), np.float32)
        for i in range(k):
            mine = ~word & (language == i)
            self.mass[i] = np.bincount(context[mine], count[mine] / WEIGHT, CONTEXT_SLOTS)
            self.kinds[i] = np.bincount(context[mine], minlength=CONTEXT_SLOTS)
        self.memo: dict[str, int] = {}
        self.empty: set[str] = set()
        self.scores = np.empty((1024, len(LANGUAGES)))
        self.letters = np.empty(1024)

    def spelled(self, form: str) -> np.ndarray:
        """Likelihood of the spelling in each language: Witten-Bell smoothing, from the empty context up."""
        pairs = _contexts(form)
        g = self.grams[:, [_slot(f"{x}\x00{c}", GRAM_SLOTS) for x, c in pairs]]
        at = [_slot(x, CONTEXT_SLOTS) for x, _ in pairs]
        mass, kinds = self.mass[:, at], self.kinds[:, at]
        order = np.array([len(x) for x, _ in pairs])
        where = np.cumsum(order == 0) - 1
        p = np.full((len(LANGUAGES), int((order == 0).sum())), 1.0 / ALPHABET)
        seen = np.ones_like(p, bool)
        for k in range(ORDER):
            now = np.flatnonzero(order == k)
            i = where[now]
            m, d = mass[:, now], kinds[:, now]
            seen[:, i] &= m > 0
            p[:, i] = np.where(seen[:, i], (g[:, now] + d * p[:, i]) / np.maximum(m + d, 1e-9), p[:, i])
        return np.exp(np.maximum(np.log(p).sum(1), _FLOOR * 4)) * (self.totals > 0)

    def __call__(self, word: str) -> np.ndarray:
        """Log likelihoods of a word, as words() gives it."""
        # Arabic has its own keyboard; for the other languages its letters are another typing of theirs
        form = word.translate(_KEYS)
        one, slot = self.spelled(form), _slot(form, WORD_SLOTS)
        known = self.known[:, slot].astype(float)
        # names go through all languages of a script, so a part of every model is what all have seen
        shared = (known / np.maximum(self.totals, 1)).mean() * np.array([_same_script(name, form) for name in LANGUAGES])
        if form != word:
            arabic, slot = LANGUAGES.index("arabic"), _slot(word, WORD_SLOTS)
            one[arabic] = self.spelled(word)[arabic]
            known[arabic] = self.known[arabic, slot]
            shared[arabic] = (self.known[:, slot] / np.maximum(self.totals, 1)).mean() * _same_script("arabic", word)
        out = np.log(0.4 * known / (self.totals + 1) + 0.4 * one + SHARED * shared + 1e-300)
        return np.maximum(out, out.max() + _FLOOR)

    def times(self, language: str, word: str) -> float:
        """How often a word has been seen, with those of its slot."""
        return float(self.known[LANGUAGES.index(language), _slot(word, WORD_SLOTS)])

    def _add(self, raw: str) -> int:
        """The row of a word as it stands in a text; -1 for one without letters."""
        n, k = _n_letters(raw), len(self.memo)
        if not n:
            self.empty.add(raw)
            return -1
        if k >= len(self.letters):
            self.scores = np.concatenate([self.scores, np.empty_like(self.scores)])
            self.letters = np.concatenate([self.letters, np.empty_like(self.letters)])
        self.scores[k] = self(_CF.sub("", raw).lower())
        self.letters[k] = n
        self.memo[raw] = k
        return k

    def rows(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(rows of the words of all texts, number of words of each text)."""
        if len(self.memo) + len(self.empty) > MEMO_WORDS:
            self.memo.clear()
            self.empty.clear()
        flat: list[int] = []
        count = np.zeros(len(texts), int)
        get = self.memo.get
        for i, t in enumerate(texts):
            before = len(flat)
            for w in t.translate(_SIGNS).split():
                k = get(w)
                if k is None:
                    k = -1 if w in self.empty else self._add(w)
                if k >= 0:
                    flat.append(k)
            count[i] = len(flat) - before
        return np.array(flat, int), count


def _expect(scores: np.ndarray, units: np.ndarray, weight: np.ndarray, owner: np.ndarray, starts: np.ndarray, allowed: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(proportions, log likelihood, posteriors) of mixtures; rows of a mixture are together, from starts on; allowed: mixtures x languages.

    A row stands for so many units of equal scores, which count in the proportions by their weight.
    """
    top = scores.max(1, keepdims=True)
    like = np.exp(scores - top) * allowed[owner]
    share = allowed / allowed.sum(1, keepdims=True)
    for step in range(ITERATIONS + 1):
        post = like * share[owner]
        mass = np.maximum(post.sum(1, keepdims=True), 1e-300)
        post /= mass
        if step == ITERATIONS:
            break
        share = np.add.reduceat(post * weight, starts)
        share /= np.maximum(share.sum(1, keepdims=True), 1e-300)
    return share, np.add.reduceat(units * (np.log(mass[:, 0]) + top[:, 0]), starts), post


def _infer(scores: np.ndarray, units: np.ndarray, n_words: np.ndarray, n_letters: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(letters by language, whether a mixture could pay) of each text; count: rows of each text, at least one.

    One language is tried first. No mixture fits better than each row's best language, so the sets of two and more, which
    leave out the languages of the smallest proportions one by one, are only tried where that bound could pay for one more.
    """
    k = len(LANGUAGES)
    starts = np.cumsum(count) - count
    top = scores.max(1)
    fits = np.add.reduceat(scores * units[:, None], starts)
    price = PENALTY * np.log(np.maximum(np.add.reduceat(n_words, starts), 2))
    best, single = fits.max(1) - price, fits.argmax(1)
    taken = np.zeros((len(count), k))
    taken[np.arange(len(count)), single] = np.add.reduceat(n_letters, starts)
    some = np.flatnonzero(np.add.reduceat(top * units, starts) - 2 * price > best)
    open_ = np.zeros(len(count), bool)
    open_[some] = True
    if len(some):
        rows = np.flatnonzero(np.repeat(open_, count))
        scores, units, n_words, n_letters, count = scores[rows], units[rows], n_words[rows, None], n_letters[rows, None], count[some]
        starts = np.cumsum(count) - count
        owner = np.repeat(np.arange(len(some)), count)
        everything, _, _ = _expect(scores, units, n_words, owner, starts, np.ones((len(some), k)))
        order = np.argsort(-everything, axis=1, kind="stable")
        # a language of less than half a word can't pay for itself
        useful = (everything * np.add.reduceat(n_words, starts) >= 0.5).sum(1)
        good, mixed = best[some], taken[some]
        for size in range(2, k + 1):
            here = np.flatnonzero(useful >= size)
            if not len(here):
                break
            rows = np.flatnonzero((useful >= size)[owner])
            n = count[here]
            first = np.cumsum(n) - n
            allowed = np.zeros((len(here), k))
            np.put_along_axis(allowed, order[here, :size], 1.0, axis=1)
            _, fit, post = _expect(scores[rows], units[rows], n_words[rows], np.repeat(np.arange(len(here)), n), first, allowed)
            value = fit - size * price[some[here]]
            better = value > good[here] + 1e-9
            good[here] = np.where(better, value, good[here])
            mixed[here] = np.where(better[:, None], np.add.reduceat(post * n_letters[rows], first), mixed[here])
        taken[some] = mixed
    return taken, open_


class Mixtures:
    """The languages of a batch of texts: rows of their words, number of words and letters, letters by language."""

    def __init__(self, model: Model, texts: list[str]):
        self.rows, self.count = model.rows(texts)
        self.letters = np.zeros(len(texts))
        self.taken = np.zeros((len(texts), len(LANGUAGES)))
        self.filled = np.flatnonzero(self.count)
        if not len(self.filled):
            return
        count = self.count[self.filled]
        starts = np.cumsum(count) - count
        scores, n_letters = model.scores[self.rows], model.letters[self.rows]
        near = np.maximum(scores - scores.max(1, keepdims=True), -BESIDE_MOST)
        near *= BESIDE
        inside = np.ones((len(scores), 1))
        inside[starts] = 0.0  # the first word of a text has no word before it
        scores[1:] += near[:-1] * inside[1:]
        near *= inside
        scores[:-1] += near[1:]
        ones = np.ones(len(scores))
        self.scores, self.n_letters = scores, n_letters
        self.taken[self.filled], self.open = _infer(scores, ones, ones, n_letters, count)
        self.letters[self.filled] = np.add.reduceat(n_letters, starts)

    def units(self) -> tuple[np.ndarray, np.ndarray]:
        """((signature, units, words, letters) by column, number of those of each text).

        A text that no mixture explains better is one unit, words of the others are units of their own.
        """
        held = np.zeros(len(self.count), np.int64)
        if not len(self.filled):
            return np.zeros((4, 0), np.int64), held
        count = self.count[self.filled]
        starts = np.cumsum(count) - count
        columns = np.stack([signatures(np.add.reduceat(self.scores, starts)), np.ones(len(count), np.int64), count, self.letters[self.filled].astype(np.int64)])
        held[self.filled] = 1
        odd = np.flatnonzero(self.open)
        if not len(odd):
            return columns, held
        rows = np.flatnonzero(np.repeat(self.open, count))
        owner = np.repeat(odd, count[odd])
        sign = signatures(self.scores[rows])
        order = np.lexsort((sign, owner))
        owner, sign, n_letters = owner[order], sign[order], self.n_letters[rows][order]
        first = np.flatnonzero(np.append(True, (owner[1:] != owner[:-1]) | (sign[1:] != sign[:-1])))
        n = np.diff(np.append(first, len(owner)))
        parts = np.stack([sign[first], n, n, np.add.reduceat(n_letters, first).astype(np.int64)])
        held[self.filled[odd]] = np.bincount(owner[first], minlength=len(count))[odd]
        every = np.concatenate([columns[:, ~self.open], parts], 1)
        at = np.argsort(np.concatenate([np.flatnonzero(~self.open), owner[first]]), kind="stable")
        return every[:, at], held


def signatures(scores: np.ndarray) -> np.ndarray:
    """Steps below the best language, BITS for each language."""
    steps = np.minimum(np.rint((scores.max(1, keepdims=True) - scores) / STEP), DEEPEST).astype(np.int64)
    return (steps << (BITS * np.arange(len(LANGUAGES)))).sum(1)


def of_signatures(signature: np.ndarray) -> np.ndarray:
    return -STEP * ((signature[:, None] >> (BITS * np.arange(len(LANGUAGES)))) & DEEPEST).astype(float)


def labels_of(taken: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(label, confidence) of letters by language, a row for each text; the confidence is the share that decides."""
    total = taken.sum(1)
    shares = taken / np.maximum(total, 1e-300)[:, None]
    urdu, english = shares[:, 0] + shares[:, 1], shares[:, 2]
    switched = (urdu >= SWITCH_SHARE) & (english >= SWITCH_SHARE)
    best = np.where(switched, len(LANGUAGES), shares.argmax(1))
    best = np.where(total > 0, best, LANGUAGES.index("other"))
    return np.array(LABELS)[best], np.where(switched, np.minimum(1.0, urdu + english), shares.max(1))


_ROWS = "language int, slot int, context int, n bigint"


def _batch(counts: Counts) -> pa.RecordBatch:
    rows = np.array(counts.rows(), np.int64).reshape(-1, 4)
    return pa.RecordBatch.from_arrays([pa.array(rows[:, i].astype(np.int32)) for i in range(3)] + [pa.array(rows[:, 3])], ["language", "slot", "context", "n"])


def _tables(words: DataFrame) -> tuple[np.ndarray, ...]:
    """The columns of a model from (language, word, n) with each word of a language once; at most a row for each slot comes back."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = Counts()
        for b in batches:
            for language, word, n in zip(*(b.column(i).to_pylist() for i in range(3))):
                counts.add(language, word, n)
            if len(counts.grams) > MEMO_WORDS:
                yield _batch(counts)
                counts = Counts()
        yield _batch(counts)

    rows = words.select("language", "word", "n").mapInArrow(run, _ROWS)
    sums = rows.groupBy("language", "slot", (F.col("context") < 0).alias("whole")).agg(F.min("context").alias("context"), F.sum("n").alias("n")).toArrow()
    return tuple(sums.column(c).to_numpy() for c in ("language", "slot", "context", "n"))


def _sample_words(samples: DataFrame) -> Counter:
    """(language, word) of the labelled samples."""
    counts: Counter = Counter()
    wanted = samples.filter(F.col("label").isin(*LANGUAGES) & F.col("text").isNotNull()).select("label", "text").orderBy(F.xxhash64("text"), "text").limit(MAX_LABELLED)
    for r in wanted.collect():
        k = LANGUAGES.index(r["label"])
        counts.update((k, w if r["label"] == "arabic" else w.translate(_KEYS)) for w in words(r["text"]))
    return counts


def _first_model(samples: Counter) -> tuple[np.ndarray, ...]:
    counts = Counts()
    for (language, word), n in samples.items():
        counts.add(language, word, n)
    sums: dict[tuple[int, int, bool], list[int]] = {}
    for language, slot, context, n in counts.rows():
        held = sums.setdefault((language, slot, context < 0), [context, 0])
        held[0], held[1] = min(held[0], context), held[1] + n
    rows = np.array([(a, b, c, n) for (a, b, _), (c, n) in sums.items()], np.int64).reshape(-1, 4)
    return tuple(rows[:, i] for i in range(4))


def _second_model(samples: Counter, rows: DataFrame) -> tuple[np.ndarray, ...]:
    """Adds the words of all segments of which the recorded label and a sure first result agree."""
    spark = rows.sparkSession
    shared, name_of = spark.sparkContext.broadcast(_first_model(samples)), new_name()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = kept(name_of, lambda: Model(*shared.value), alone=True)
        for b in batches:
            found: Counter = Counter()
            texts, recorded = b.column(0).to_pylist(), np.array(b.column(1).to_pylist(), object)
            mix = Mixtures(model, texts)
            label, sure = labels_of(mix.taken)
            agrees = (label == recorded) & (sure >= 0.95) & (mix.letters >= MIN_LETTERS)
            raw = list(model.memo)
            for i, name in enumerate(LANGUAGES):
                n = np.bincount(mix.rows[np.repeat(agrees & (label == name), mix.count)])
                for k in np.flatnonzero(n).tolist():
                    w = _CF.sub("", raw[k]).lower()
                    found[i, w if name == "arabic" else w.translate(_KEYS)] += int(n[k])
            keys = list(found)
            yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in keys], pa.int32()), pa.array([x[1] for x in keys], pa.string()), pa.array([found[x] for x in keys], pa.int64())], ["language", "word", "n"])

    corpus = rows.filter(F.col("label").isin(*LANGUAGES)).select("text", "label").mapInArrow(run, "language int, word string, n bigint")
    given = spark.createDataFrame([(a, w, n) for (a, w), n in samples.items()], "language int, word string, n bigint")
    return _tables(corpus.unionByName(given).groupBy("language", "word").agg(F.sum("n").alias("n")))


def segment_languages(segments: DataFrame, samples: DataFrame) -> DataFrame:
    """(doc_id, seg_no, recorded, label, confidence, mix) of each segment with enough letters; mix: letters by language."""
    rows = spread(segments.select("doc_id", "seg_no", F.col("label").alias("label"), "text").filter(F.col("doc_id").isNotNull() & F.col("text").isNotNull()))
    shared, name = segments.sparkSession.sparkContext.broadcast(_second_model(_sample_words(samples), rows)), new_name()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = kept(name, lambda: Model(*shared.value), alone=True)
        for b in batches:
            mix = Mixtures(known, b.column(3).to_pylist())
            label, sure = labels_of(mix.taken)
            columns, held = mix.units()
            parts = pa.StructArray.from_arrays([pa.array(c) for c in columns], ["signature", "units", "words", "letters"])
            units = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(held)), pa.int32()), parts)
            out = pa.RecordBatch.from_arrays([*b.columns[:3], pa.array(label.tolist(), pa.string()), pa.array(sure), units], ["doc_id", "seg_no", "recorded", "label", "confidence", "units"])
            yield out.filter(pa.array(mix.letters >= MIN_LETTERS))

    kinds = {f.name: f.dataType.simpleString() for f in segments.schema.fields}
    return rows.mapInArrow(run, f"doc_id {kinds['doc_id']}, seg_no {kinds['seg_no']}, recorded string, label string, confidence double, units array<struct<signature:bigint,units:bigint,words:bigint,letters:bigint>>").distinct()


def document_languages(found: DataFrame) -> DataFrame:
    """(doc_id, label, confidence) of each document, inferred from the units of all its segments.

    Units are added up by signature before a document comes together, so a document of any size is a bounded row.
    """
    sums = found.select("doc_id", F.explode("units").alias("u")).groupBy("doc_id", "u.signature").agg(*(F.sum(f"u.{c}").alias(c) for c in ("units", "words", "letters")))
    whole = sums.groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct("signature", "units", "words", "letters"))).alias("units"))
    kind = found.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            rows = b.column(1)
            count = np.diff(rows.offsets.to_numpy())
            signature, units, n_words, n_letters = (x.to_numpy(zero_copy_only=False) for x in rows.flatten().flatten())
            taken, _ = _infer(of_signatures(signature), units.astype(float), n_words.astype(float), n_letters.astype(float), count)
            label, sure = labels_of(taken)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(label.tolist(), pa.string()), pa.array(sure)], ["doc_id", "label", "confidence"])

    return whole.mapInArrow(run, f"doc_id {kind}, label string, confidence double")


def latest_population(assignments: DataFrame) -> DataFrame:
    """(doc_id, recorded): the population of the row written last."""
    return assignments.groupBy("doc_id").agg(F.max_by("population", F.struct("written_ts", "loaded_ts")).alias("recorded"))
