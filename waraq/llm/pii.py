"""Problem 3: personal information in free text, found and replaced.

Found are e-mail addresses (also those written to escape robots), phone numbers, identity numbers,
street addresses and person names, in English, Roman Urdu and Urdu, digits of any of these scripts.
Names come from a list that is known to be incomplete, so the list also gives the endings of family
names and the letter sequences of names; a word that has them counts as a name beside another one or
beside a title.

Each find becomes a typed placeholder in one output and a surrogate in another. Surrogates are keyed with a
secret of the caller's: the same entity gets the same one throughout the corpus, whatever its spelling,
two entities never get the same one, none gets what is itself an entity of the corpus, and type, script, letter case and format are kept.
All of this is settled over the whole corpus: in every round each entity that has no surrogate yet draws
one, draws that meet a real entity, a settled surrogate or another draw with a smaller hash are given up,
and what is left draws again from a larger space.

Names are drawn from the known ones of the same gender, later with family names put together from halves
of known ones. The gender of a given name is learned from the titles it stands behind in the corpus; a name
without a title takes that, and where the corpus shows none the draw is from all names. Mailboxes are
drawn at a reserved domain with as many labels; digits are permuted by a keyed cycle through all numbers
of that length, which leaves none as it was. An address keeps its words for streets, blocks and the like;
its numbers and single letters are permuted and each word of a place is drawn as names are.

Defined cases: null and empty texts and rows without an id have no finds; placeholders already in a text
are not finds; overlapping finds are settled in the order e-mail, identity number, phone, address,
name; repeated rows give equal rows once; an empty table gives no rows; other columns are ignored. Without any
known name, names are made of syllables.
"""

from __future__ import annotations

import hashlib
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from waraq.llm.words import kept, new_name
from waraq.session import cut, spread

#: Words that a worker remembers, and names that it can hold.
MEMO_WORDS, MOST_NAMES = 500_000, 5_000_000
CATEGORIES = ("email", "identity_number", "phone", "street_address", "person_name")
_DIGITS = {ord(c): str(i % 10) for i, c in enumerate("٠١٢٣٤٥٦٧٨٩۰۱۲۳۴۵۶۷۸۹०१२३४५६७८९０１２３４５６７８９")}

_AT = r"(?:\s?[@＠]\s?|\s*[\[({<]\s*(?:at|@|ایٹ)\s*[\])}>]\s*)"
_DOT = r"(?:[.．]|\s*[\[({<]\s*(?:dot|\.|ڈاٹ)\s*[\])}>]\s*)"
_LABEL = r"[a-z0-9](?:[a-z0-9-]{0,61}[a-z0-9])?"
_LOCAL = r"(?<![\w.+%-])[a-z0-9](?:[a-z0-9._%+-]{0,62}[a-z0-9])?"
EMAIL = regex.compile(rf"{_LOCAL}(?:{_AT}(?:{_LABEL}{_DOT}){{1,6}}[a-z]{{2,24}}|\s+(?:at|ایٹ)\s+{_LABEL}(?:\s+(?:dot|ڈاٹ)\s+{_LABEL}){{0,5}}\s+(?:dot|ڈاٹ)\s+[a-z]{{2,24}})(?![\w@-])", regex.I)
IDENTITY = re.compile(r"(?<![\w.+/-])(?:[1-9]\d{4}(?:[-–][0-9]{7}[-–]|[ \xa0][0-9]{7}[ \xa0])\d|[1-9]\d{12}|[A-Z]{2}[ -]?\d{7})(?![\w/]|[-.]\d)")
_SEP = r"[ \xa0.\-–]"
PHONE = re.compile(rf"(?<![\w.+/:\-])(?:(?:\+|00)[1-9]\d{{0,3}}(?:{_SEP}?\(?\d{{1,12}}\)?)(?:{_SEP}\d{{2,8}}){{0,4}}|\(0\d{{2,3}}\){_SEP}?\d{{3,8}}(?:{_SEP}\d{{3,8}}){{0,2}}|0\d{{2,3}}(?:{_SEP}\d{{3,8}}){{1,3}}|0\d{{10,11}})(?![\w/]|[-.:]\d)")
_NUMBER = r"[0-9]{1,5}(?:[-/]?[A-Za-z](?![A-Za-z]))?"
_PLACE = r"[A-Za-z][A-Za-z'-]+(?: (?:(?-i:[A-Z])[A-Za-z'-]+|(?:town|colony|plaza|road|street|avenue|lane|bazaar)\b)){0,2}"
_PART = rf"(?:(?:street|gali|st|floor|manzil|block|sector|phase|lane|road)\s*(?:no\.?|number|#)?\s*#?\s*(?:{_NUMBER}|[A-Z](?![A-Za-z]))|mohalla {_PLACE}|{_PLACE})"
_LATIN_UNIT = rf"(?:(?:house|ghar|makan|flat|plot|kothi|apartment|apt|h)\s*(?:no\.?|number|#)?\s*#?\s*{_NUMBER}|{_NUMBER} {_PLACE} (?:road|street|avenue|lane|bazaar))"
ADDRESS = re.compile(rf"(?<![\w#])(?:{_LATIN_UNIT})(?:,\s*{_PART}){{1,5}}", re.I)
_LATIN_KEY = re.compile(r"\b(?:street|gali|st ?#|floor|manzil|block|sector|phase|town|colony|plaza|road|mohalla|lane|avenue)", re.I)
_URDU_WORD = r"[ء-ۓ]+"
ADDRESS_URDU = re.compile(rf"(?<![ء-ۓ])(?:مکان|کوٹھی|فلیٹ|گھر|پلاٹ|دکان)\s*(?:نمبر|#)?\s*[0-9]+(?:[،,]\s*(?:(?:گلی|بلاک|منزل|سیکٹر|سڑک)\s*(?:نمبر)?\s*[0-9]+|محلہ {_URDU_WORD}|{_URDU_WORD}(?: (?:ٹاؤن|کالونی|پلازہ|روڈ|بازار))?)){{1,5}}")
_URDU_KEY = re.compile("گلی|بلاک|منزل|سیکٹر|محلہ|ٹاؤن|کالونی|پلازہ|روڈ|سڑک")
#: Numbers that only look like one of the above, by the words before them.
_NOT_NUMBER = re.compile(r"(?:isbn|آئی ایس بی این|serial|سیریل|version|lot|صفحہ|page|order|invoice|model)\s*(?:no\.?|number|نمبر)?\s*[:#]?\s*$", re.I)

_TITLE = re.compile(r"(?:\b(?:mr|mrs|ms|miss|dr|prof|sir|madam|janab|mohtarma|sahib|syed|mera naam|my name is|contact person:?|name:)\.?|محترمہ|جناب|ڈاکٹر|پروفیسر|میرا نام|سید|مسٹر|مس|نام:)\s+$", re.I)
_FEMALE = re.compile(r"(?:mrs|ms|miss|madam|mohtarma|محترمہ|مس)\.?\s+$", re.I)
_MALE = re.compile(r"(?:mr|sir|janab|جناب|مسٹر)\.?\s+$", re.I)
_NOT_PERSON = re.compile(r"\s+(?:textile|mills?|traders?|brothers|sons|industries|ltd|limited|pvt|company|enterprises|school|college|university|hospital|road|street|town|colony|plaza|chowk|bazaar|high school|ہائی|اسکول|کالج|یونیورسٹی|ہسپتال|ٹیکسٹائل|ملز|ٹریڈرز|لمیٹڈ|کمپنی|روڈ|ٹاؤن|کالونی|پلازہ|چوک)", re.I)
_PAIR = regex.compile(r"(?<![\p{L}\p{M}@._+-])((?:\p{Lu}\.|[ء-ۓ]\.|\p{L}[\p{L}\p{M}'’-]+))\s+(?=(\p{L}[\p{L}\p{M}'’-]{2,})(?![\p{L}\p{M}@_+]|[.-]\p{L}))")


@dataclass(frozen=True)
class Find:
    start: int
    end: int
    category: str
    entity: str  # the same for each spelling of the same entity
    gender: str = ""


class Names:
    """The known names, and what they show of names in general."""

    def __init__(self, rows: list[tuple[str, str, str]]):
        """rows: (name_part, roman, urdu)."""
        self.given: dict[str, str] = {}
        self.family: dict[str, str] = {}
        self.forms: dict[str, tuple[str, str]] = {}
        grams: Counter = Counter()
        endings: Counter = Counter()
        count: Counter = Counter()
        for part, roman, urdu in rows:
            if not (roman or urdu):
                continue
            one = (roman or urdu).lower()
            for n in (roman, urdu):
                if not n:
                    continue
                n = n.lower()
                (self.given if part == "given" else self.family)[n] = one
                self.forms[one] = (roman or urdu, urdu or roman)
                marked = "^" + n
                grams.update(marked[i : i + 3] for i in range(len(marked) - 2))
                if part == "family":
                    script = n[0] > "֐"
                    count[script] += 1
                    endings.update((script, n[-k:]) for k in range(3, 7) if len(n) >= k + 2)
        self.grams = frozenset(grams)
        wanted = {e for (s, e), k in endings.items() if k >= max(3, 0.05 * count[s])}
        self.endings = tuple(sorted(wanted, key=lambda e: (-len(e), e)))
        self._family: dict[str, int] = {}
        self.given_pool, self.family_pool = sorted(set(self.given.values())), sorted(set(self.family.values()))

    def likely(self, word: str, least: float = 0.75) -> bool:
        """The word's letter sequences are those of names."""
        marked = "^" + word
        seen = [marked[i : i + 3] in self.grams for i in range(len(marked) - 2)]
        return bool(seen) and sum(seen) >= least * len(seen)

    def family_like(self, word: str) -> int:
        """2: known, or with an ending and the letters of family names; 1: with an ending; 0: neither."""
        got = self._family.get(word)
        if got is None:
            w = word.lower()
            end = next((e for e in self.endings if w.endswith(e)), None)
            got = 2 if w in self.family else 0 if end is None or len(w) - len(end) < 2 else 2 if self.likely(w) else 1
            if len(self._family) > MEMO_WORDS:
                self._family.clear()
            self._family[word] = got
        return got

    def is_given(self, word: str) -> bool:
        w = word.lower()
        if w in self.given:
            return True
        if len(w) < 4:
            return False
        return self.likely(w, 1.0) and (word[:1].isupper() or word[:1] > "֐")

    def identity(self, word: str) -> str:
        w = word.lower()
        return self.given.get(w) or self.family.get(w) or w


def find(text: str, names: Names) -> list[Find]:
    """The finds of a text, in order, without overlaps."""
    plain = text.translate(_DIGITS)
    taken = bytearray(len(text))
    out: list[Find] = []

    def take(a: int, b: int, category: str, entity: str, gender: str = "") -> None:
        if not any(taken[a:b]):
            taken[a:b] = b"\x01" * (b - a)
            out.append(Find(a, b, category, entity, gender))

    if "@" in plain or "＠" in plain or "dot" in plain.lower() or "ڈاٹ" in plain:
        for m in EMAIL.finditer(plain):
            flat = re.sub(r"\s*[\[({<]?\s*(?:\bdot\b|ڈاٹ)\s*[\])}>]?\s*", ".", re.sub(r"\s*[\[({<]?\s*(?:\bat\b|[@＠]|ایٹ)\s*[\])}>]?\s*", "@", m[0].lower(), count=1))
            take(m.start(), m.end(), "email", flat.replace("．", ".").replace(" ", ""))
    for m in IDENTITY.finditer(plain):
        if not _NOT_NUMBER.search(plain[max(0, m.start() - 30) : m.start()]):
            take(m.start(), m.end(), "identity_number", re.sub(r"[^0-9A-Z]", "", m[0]))
    for m in PHONE.finditer(plain):
        digits = re.sub(r"\D", "", m[0])
        far = m[0][0] == "+" or digits.startswith("00")
        n = len(digits) - 2 * digits.startswith("00")
        if (8 <= n <= 15 if far else 10 <= n <= 12) and not _NOT_NUMBER.search(plain[max(0, m.start() - 30) : m.start()]):
            number = digits[2:] if digits.startswith("00") else digits
            take(m.start(), m.end(), "phone", "92" + number[1:] if not far else number)
    for pattern, key in ((ADDRESS, _LATIN_KEY), (ADDRESS_URDU, _URDU_KEY)):
        for m in pattern.finditer(plain):
            if key.search(m[0]):
                take(m.start(), m.end(), "street_address", re.sub(r"[\W_]+", " ", m[0].lower()).strip())
    for m in _PAIR.finditer(text):
        last = m[2]
        like = names.family_like(last)
        if not like and not last[0].isupper():
            continue
        first, a, b = m[1], m.start(1), m.end(2)
        if not like and not first[0].isupper():
            continue
        before = text[max(0, a - 20) : a]
        titled = bool(_TITLE.search(before))
        given = first.lower() in names.given
        if not titled and (not like or like == 1 and not given):
            continue
        initial = len(first) == 2 and first[1] == "."
        cased = last[0] >= "֐" or (first[0].isupper() and last[0].isupper())
        if _NOT_PERSON.match(text, b) or _NOT_PERSON.fullmatch(" " + last) or (not cased and not titled and not (given and last.lower() in names.family)):
            continue
        if initial or titled or names.is_given(first):
            gender = "f" if _FEMALE.search(before) else "m" if _MALE.search(before) else ""
            take(a, b, "person_name", f"{first.lower() if initial else names.identity(first)} {names.identity(last)}", gender)
    return sorted(out, key=lambda f: f.start)


def shape(span: str) -> str:
    """Digits as d, letters as x, the rest as it is; at most 40 characters. Never the find itself."""
    return "".join("d" if c.isdecimal() else "x" if c.isalpha() else c for c in span)[:40]


PLACEHOLDERS = {"email": "[EMAIL]", "phone": "[PHONE]", "identity_number": "[ID]", "street_address": "[ADDRESS]", "person_name": "[NAME]"}


def _names_of(known_names: DataFrame) -> list[tuple[str, str, str]]:
    """The list of known names, which every worker holds whole; a list too large for that is refused, not cut."""
    rows = known_names.select("name_part", "roman", "urdu").distinct().orderBy("name_part", "roman", "urdu").limit(MOST_NAMES + 1).collect()
    if len(rows) > MOST_NAMES:
        raise ValueError(f"more than {MOST_NAMES} known names")
    return [(r["name_part"], r["roman"], r["urdu"]) for r in rows if r["name_part"]]


_MATCH = "array<struct<category:string,span_start:int,span_end:int,shape:string,entity:string,gender:string>>"
_MATCH_TYPE = pa.list_(pa.struct([("category", pa.string()), ("span_start", pa.int32()), ("span_end", pa.int32()), ("shape", pa.string()), ("entity", pa.string()), ("gender", pa.string())]))


def scan(df: DataFrame, key: str, text: str, known_names: DataFrame) -> DataFrame:
    """(key, text, matches) of each distinct row with text."""
    shared, name = df.sparkSession.sparkContext.broadcast(_names_of(known_names)), new_name()
    kind = df.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = kept(name, lambda: Names(shared.value))
        for b in batches:
            rows = [[{"category": f.category, "span_start": f.start, "span_end": f.end, "shape": shape(t[f.start : f.end]), "entity": f.entity, "gender": f.gender} for f in find(t, names)] for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(rows, _MATCH_TYPE)], [key, "text", "matches"])

    source = spread(df.select(key, F.col(text).alias("text")).filter(F.col(key).isNotNull() & (F.length("text") > 0)))
    return source.mapInArrow(run, f"{key} {kind}, text string, matches {_MATCH}").distinct()


# -- surrogates


#: Words of addresses that stay: they tell what a number or a name is.
ADDRESS_WORDS = frozenset("house ghar makan flat plot kothi apartment apt no number street gali st floor manzil block sector phase lane road mohalla town colony plaza avenue bazaar مکان کوٹھی فلیٹ گھر پلاٹ دکان نمبر گلی بلاک منزل سیکٹر سڑک محلہ ٹاؤن کالونی پلازہ روڈ بازار".split())
_ADDRESS_TOKEN = regex.compile(r"\p{L}+|\d+")
_AT_SIGN = regex.compile(rf"{_AT}|\s+(?:at|ایٹ)\s+", regex.I)
_DOT_SIGN = regex.compile(rf"{_DOT}|\s+(?:dot|ڈاٹ)\s+", regex.I)
_SYLLABLES = ("ba", "da", "ka", "la", "ma", "na", "ra", "sa", "to", "zi")
_URDU_SYLLABLES = ("با", "دا", "کا", "لا", "ما", "نا", "را", "سا", "تو", "زی")
SALTS = 16
#: Rounds of drawing; each enlarges the space by more than the last, so a few are enough for any corpus.
ROUNDS = 40


class Keyed:
    """Draws and permutations that follow from a secret."""

    def __init__(self, secret: bytes):
        if len(secret) < 8:
            raise ValueError("surrogates need a secret of at least 8 bytes")
        self.key = hashlib.sha256(secret).digest()

    def draw(self, *parts: object) -> int:
        return int.from_bytes(hashlib.blake2b("\x1f".join(map(str, parts)).encode(), key=self.key, digest_size=8).digest(), "big")

    def pick(self, pool: list, *parts: object):
        return pool[self.draw(*parts) % len(pool)]

    def sign(self, sign: str, signs: str, purpose: str) -> str:
        """The next of the signs in a keyed cycle of all: a permutation that leaves none as it is."""
        cycle = sorted(signs, key=lambda c: (self.draw(purpose, "cycle", c), c))
        return cycle[(cycle.index(sign) + 1) % len(cycle)]

    def digits(self, digits: str, purpose: str) -> str:
        """The next number in a keyed cycle through all numbers of this length; none stays as it is.

        The cycle's order is a balanced Feistel network on decimal halves, undone, moved by one and done again.
        """
        n = len(digits)
        if n < 2:
            return self.sign(digits, "0123456789", purpose) if n else digits
        a, b = digits[: n // 2], digits[n // 2 :]
        mix = lambda r, half, size, way, of: str((int(of) + way * self.draw(purpose, n, r, half)) % 10**size).zfill(size)
        for r in reversed(range(8)):
            a, b = mix(r, a, len(b), -1, b), a
        a, b = (x := str((int(a + b) + 1) % 10**n).zfill(n))[: n // 2], x[n // 2 :]
        for r in range(8):
            a, b = b, mix(r, b, len(a), 1, a)
        return a + b

    def number(self, digits: str, purpose: str) -> str:
        """As digits(), among the numbers with as many leading zeros."""
        core = digits.lstrip("0")
        if len(core) < 2:
            return digits[: len(digits) - 1] + self.digits(digits[-1:], purpose)
        new = self.digits(core, purpose)
        while new[0] == "0":
            new = self.digits(new, purpose)
        return digits[: len(digits) - len(core)] + new


def _keep_digits(span: str, digits: str) -> str:
    """The span with its digits replaced one by one, each in its own script."""
    it = iter(digits)
    return "".join(chr(ord(c) - int(c.translate(_DIGITS) if ord(c) in _DIGITS else c) + int(next(it))) if c.isdecimal() else c for c in span)


def _like(word: str, model: str) -> str:
    return word.upper() if model.isupper() and len(model) > 1 else word.capitalize() if model[:1].isupper() else word.lower()


def _is_initial(first: str) -> bool:
    return len(first) == 2 and first[1] == "."


class Drawer:
    """What an entity draws in a round: (forms, ticket). Forms are how the surrogate would be known if it were found; a ticket is what is needed to write it."""

    def __init__(self, names: Names, genders: dict[str, str], secret: bytes):
        self.names, self.keyed = names, Keyed(secret)
        pool = [n for n in names.given_pool]
        self.given = {g: [n for n in pool if not g or genders.get(n) == g] or pool for g in ("", "f", "m")}
        self.pairs = [names.forms[n] for n in names.family_pool]

    def _made(self, n: int, *parts: object) -> tuple[str, str]:
        """(roman, urdu) of a family name: a known one, or one of n + 1 pieces of known ones."""
        if not self.pairs:
            picks = [self.keyed.draw(*parts, i) % len(_SYLLABLES) for i in range(3 + n)]
            return "".join(_SYLLABLES[i] for i in picks), "".join(_URDU_SYLLABLES[i] for i in picks)
        if not n:
            return self.keyed.pick(self.pairs, *parts)
        picks = [self.keyed.pick(self.pairs, *parts, i) for i in range(n + 1)]
        piece = lambda w, i: w[len(w) // 2 :] if i == n else w[: (len(w) + 1) // 2]
        return tuple("".join(piece(p[k], i) for i, p in enumerate(picks)) for k in (0, 1))  # type: ignore[return-value]

    def person(self, entity: str, gender: str, attempt: int) -> tuple[list[str], str]:
        pool = self.given[gender]
        g = self.names.forms[self.keyed.pick(pool, "given", entity, attempt)] if pool else self._made(0, "given", entity, attempt)
        f = self._made(attempt // 2, "family", entity, attempt)
        initial = _is_initial(entity.split(" ")[0])
        forms = [f"{x[:1]}. {y}" if initial else f"{x} {y}" for x, y in zip(g, f)]
        return sorted({x.lower() for x in forms}), "|".join((*g, *f))

    def email(self, entity: str, attempt: int) -> tuple[list[str], str]:
        ascii_ = lambda w: "".join(c for c in w.lower() if "a" <= c <= "z")
        first, last = (ascii_(self._made(0, part, entity, attempt)[0]) or self.keyed.pick(list(_SYLLABLES), part, entity, attempt) for part in ("mailbox", "mail"))
        number = self.keyed.draw("number", entity, attempt) % 10 ** min(15, 1 + 2 * attempt) if attempt else ""
        local = f"{first}.{last}{number}"
        return [local + "@" + ".".join(_labels(entity.count(".", entity.find("@")) + 1))], local

    def identity(self, entity: str, attempt: int) -> tuple[list[str], str]:
        out = "".join(self.keyed.sign(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", f"id{attempt}.{i}") for i, c in enumerate(entity) if not c.isdecimal())
        new = out + self.keyed.number("".join(c for c in entity if c.isdecimal()), f"id{attempt}")
        return [new], new

    def phone(self, entity: str, attempt: int) -> tuple[list[str], str]:
        tail = min(7, len(entity) - 3)  # country and operator codes stay: the number remains of its kind
        new = entity[:-tail] + self.keyed.digits(entity[-tail:], f"phone{attempt}.{entity[:-tail]}")
        return [new], new

    def place(self, word: str, attempt: int) -> tuple[list[str], str]:
        """A word for a place in the script of the given one."""
        made = self._made(attempt // 2, "place", word, attempt)[word[-1:] > "֐"].lower()
        made = "".join(c for c in made if c.isalpha())
        while len(made) < 2 or made in ADDRESS_WORDS:
            made += self.keyed.pick(list(_SYLLABLES), "more", word, attempt, len(made))
        return [made], made

    def address(self, entity: str, places: dict[str, str], attempt: int) -> tuple[list[str], str]:
        return [_ADDRESS_TOKEN.sub(lambda m: self.address_token(m[0], places, str(attempt), m.start() == 0), entity)], str(attempt)

    def address_token(self, token: str, places: dict[str, str], attempt: str, first: bool) -> str:
        low = token.lower()
        if token[0].isdecimal():
            return _keep_digits(token, self.keyed.number(token.translate(_DIGITS), "address" + attempt))
        if low in ADDRESS_WORDS or first and low == "h":
            return token
        if len(token) > 1:
            return _like(places[low], token)
        return _like(self.keyed.sign(low, "abcdefghijklmnopqrstuvwxyz", "address" + attempt), token) if "a" <= low <= "z" else token

    def draw(self, category: str, entity: str, gender: str, places: dict[str, str], attempt: int) -> tuple[list[str], str]:
        if category == "person_name":
            return self.person(entity, gender, attempt)
        if category == "street_address":
            return self.address(entity, places, attempt)
        return {"email": self.email, "identity_number": self.identity, "phone": self.phone, "place": self.place}[category](entity, attempt)

    def write(self, category: str, span: str, ticket: str, places: dict[str, str]) -> str:
        """The surrogate in the place of a find, written as the find is."""
        if category in ("identity_number", "phone"):
            digits = re.sub(r"\D", "", ticket)
            n = sum(c.isdecimal() for c in span)
            # a national number lacks the country's digits, an international one may begin with zeros
            old = "".join(c.translate(_DIGITS) for c in span if c.isdecimal())
            new = digits if category == "identity_number" else old[: n - min(7, len(digits) - 3)] + digits[-min(7, len(digits) - 3) :]
            letters = iter(c for c in ticket if not c.isdecimal())
            return "".join(next(letters, c) if c.isalpha() else c for c in _keep_digits(span, new)) if category == "identity_number" else _keep_digits(span, new)
        if category == "street_address":
            return _ADDRESS_TOKEN.sub(lambda m: self.address_token(m[0], places, ticket, m.start() == 0), span)
        if category == "email":
            at = _AT_SIGN.search(span)
            if not at:
                return ticket + "@" + ".".join(_labels(2))
            dots = [m[0] for m in _DOT_SIGN.finditer(span, at.end())] or ["."]
            labels = _labels(len(dots) + 1)
            return _like(ticket, span) + at[0] + "".join(_like(a, span) + b for a, b in zip(labels, [*dots, ""]))
        g, f = (lambda x: ((x[0], x[2]), (x[1], x[3]))[span[-1:] > "֐"])(ticket.split("|"))
        parts = span.split()
        return f"{g[:1].upper() + '.' if _is_initial(parts[0]) else _like(g, parts[0])} {_like(f, parts[-1])}"


def _labels(n: int) -> list[str]:
    """A domain of n labels under a name that is reserved for examples."""
    return ["mail", *["host"] * (n - 2), "example"]


def _place_words(entity: Column) -> Column:
    """The words of an address that name places."""
    return F.array_distinct(F.filter(F.regexp_extract_all(entity, F.lit(r"(\p{L}+)"), F.lit(1)), lambda w: (F.length(w) > 1) & ~w.isin(*sorted(ADDRESS_WORDS))))


_PLACES = "array<struct<word:string,ticket:string>>"


def _settle(entities: DataFrame, drawer, name: str) -> DataFrame:
    """(category, entity, ticket, forms) of each (category, entity, gender, places), by rounds of draws."""

    def draws(attempt: int):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            d = kept(name, drawer)
            for b in batches:
                made = [d.draw(c, e, g or "", {p["word"]: p["ticket"] for p in ps or []}, attempt) for c, e, g, ps in zip(*(b.column(i).to_pylist() for i in range(4)))]
                yield pa.RecordBatch.from_arrays([*b.columns[:2], pa.array([m[1] for m in made], pa.string()), pa.array([m[0] for m in made], pa.list_(pa.string()))], ["category", "entity", "ticket", "forms"])

        return run

    left = entities.select("category", "entity", "gender", "places")
    taken = entities.select("category", F.col("entity").alias("form"))
    settled = None
    for attempt in range(ROUNDS):
        drawn = cut(left.mapInArrow(draws(attempt), "category string, entity string, ticket string, forms array<string>"))
        forms = drawn.select("category", "entity", F.explode("forms").alias("form"))
        first = forms.groupBy("category", "form").agg(F.min(F.struct(F.xxhash64("entity"), "entity")).alias("w"))
        second = forms.join(first, ["category", "form"]).filter(F.col("entity") != F.col("w.entity"))
        lost = forms.join(taken, ["category", "form"], "left_semi").select("category", "entity").unionByName(second.select("category", "entity"))
        winners = cut(drawn.join(lost, ["category", "entity"], "left_anti"))
        settled = winners if settled is None else settled.unionByName(winners)
        left = cut(left.join(winners.select("category", "entity"), ["category", "entity"], "left_anti"))
        if left.isEmpty():
            return settled
        taken = taken.unionByName(winners.select("category", F.explode("forms").alias("form")))
    raise RuntimeError("surrogates kept colliding")


class Surrogates:
    """The surrogates of all that a scan found; found: (key, matches) of the whole corpus, which is gone through several times."""

    def __init__(self, found: DataFrame, known_names: DataFrame, secret: bytes):
        rows = _names_of(known_names)
        spark = found.sparkSession
        m = found.select(F.explode("matches").alias("m")).select("m.category", "m.entity", "m.gender")
        every = cut(m.groupBy("category", "entity").agg(F.count_if(F.col("gender") == "f").alias("f"), F.count_if(F.col("gender") == "m").alias("m")))
        # a given name's gender is that of at least two thirds of the titles it stands behind
        given = F.substring_index("entity", " ", 1)
        sums = every.filter(F.col("category") == "person_name").groupBy(given.alias("given")).agg(F.sum("f").alias("gf"), F.sum("m").alias("gm"))
        of = lambda f, m: F.when(f > 2 * m, "f").when(m > 2 * f, "m").otherwise("")
        learned = cut(sums.select("given", of(F.col("gf"), F.col("gm")).alias("learned")).filter(F.col("learned") != ""))
        known = spark.createDataFrame([(n,) for n in Names(rows).given_pool], "given string")
        genders = dict(known.join(learned, "given").collect())  # as many rows as the list of known names, at most
        shared, self.name = spark.sparkContext.broadcast((rows, genders, secret)), new_name()

        def drawer() -> Drawer:
            names, by_name, key = shared.value
            return Drawer(Names(names), by_name, key)

        self.drawer = drawer
        none = F.lit(None).cast(_PLACES)
        words = every.filter(F.col("category") == "street_address").select("entity", F.explode(_place_words(F.col("entity"))).alias("word"))
        distinct = words.select(F.lit("place").alias("category"), F.col("word").alias("entity"), F.lit("").alias("gender"), none.alias("places")).distinct()
        self.words = cut(_settle(cut(distinct), drawer, self.name).select(F.col("entity").alias("word"), "ticket"))
        held = words.join(self.words, "word").groupBy("entity").agg(F.collect_list(F.struct("word", "ticket")).alias("places")).withColumn("category", F.lit("street_address"))
        told = every.join(learned, (F.substring_index(every["entity"], " ", 1) == learned["given"]) & (F.col("category") == "person_name"), "left")
        told = told.select("category", "entity", F.coalesce(F.when(F.col("f") > F.col("m"), "f").when(F.col("m") > F.col("f"), "m"), "learned", F.lit("")).alias("gender"))
        entities = cut(told.join(held, ["category", "entity"], "left").select("category", "entity", "gender", "places"))
        self.tickets = cut(_settle(entities, drawer, self.name).join(entities.select("category", "entity", "places"), ["category", "entity"]))

    def to(self, found: DataFrame, key: str) -> DataFrame:
        """(key, t, m, ticket, forms, places) of each find; a ticket goes to as many salted places as its entity has."""
        m = found.select(key, *(["t"] if "t" in found.columns else []), F.explode("matches").alias("m")).withColumn("salt", F.pmod(F.xxhash64(key), F.lit(SALTS)))
        m = m.withColumns({"category": F.col("m.category"), "entity": F.col("m.entity")})
        salts = m.groupBy("category", "entity").agg(F.collect_set("salt").alias("salts"))
        spreadout = self.tickets.join(salts, ["category", "entity"]).withColumn("salt", F.explode("salts")).drop("salts")
        return m.join(spreadout, ["category", "entity", "salt"])

    def checks(self) -> DataFrame:
        """(property, violations) over all surrogates; every number is 0."""
        t = self.tickets
        forms = t.select("category", "entity", F.explode("forms").alias("form"))
        shared = forms.groupBy("category", "form").agg(F.count_distinct("entity").alias("n")).filter(F.col("n") > 1)
        real = forms.join(t.select("category", F.col("entity").alias("form")), ["category", "form"], "left_semi")
        several = t.groupBy("category", "entity").agg(F.count("*").alias("n")).filter(F.col("n") > 1)
        words = self.words.join(self.words.select(F.col("word").alias("ticket")), "ticket", "left_semi")
        named = {"surrogates of two entities": shared, "surrogates that are entities": real, "entities with two surrogates": several, "places named as other places": words}
        out = None
        for name, rows in named.items():
            one = rows.agg(F.count("*").alias("violations")).select(F.lit(name).alias("property"), "violations")
            out = one if out is None else out.unionByName(one)
        return out


def items(scanned: DataFrame, key: str, known_names: DataFrame, secret: bytes) -> DataFrame:
    """(key, category, span_start, span_end, shape, surrogate): each item of personal information with its surrogate's normal form."""
    found = cut(scanned.select(key, "matches").distinct())
    joined = Surrogates(found, known_names, secret).to(found, key)
    return joined.select(key, "m.category", "m.span_start", "m.span_end", "m.shape", F.col("forms")[0].alias("surrogate")).distinct()


def checks(scanned: DataFrame, key: str, known_names: DataFrame, secret: bytes) -> DataFrame:
    """(property, violations) of the surrogates, and of the texts that they were written into."""
    done = Surrogates(cut(scanned.select(key, "matches").distinct()), known_names, secret)
    texts = _written(scanned, key, done).agg(F.coalesce(F.sum("unchanged"), F.lit(0)).alias("violations"))
    return done.checks().unionByName(texts.select(F.lit("finds that stayed as they were").alias("property"), "violations"))


def _written(scanned: DataFrame, key: str, done: Surrogates) -> DataFrame:
    """(key, redacted, surrogate, unchanged)."""
    texts = scanned.withColumn("t", F.xxhash64("text"))
    held = done.to(texts.select(key, "t", "matches").distinct(), key).groupBy(key, "t").agg(F.collect_list(F.struct(F.col("m.span_start").alias("a"), F.col("m.span_end").alias("b"), "category", "ticket", "places")).alias("finds"))
    joined = texts.join(held, [key, "t"], "left").select(key, "text", "finds")
    kind, name, drawer = scanned.schema[key].dataType.simpleString(), done.name, done.drawer

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        d = kept(name, drawer)
        for b in batches:
            redacted, surrogate, unchanged = [], [], []
            for text, finds in zip(b.column(1).to_pylist(), b.column(2).to_pylist()):
                one, two, at, same = [], [], 0, 0
                for f in sorted(finds or [], key=lambda f: f["a"]):
                    span = text[f["a"] : f["b"]]
                    new = d.write(f["category"], span, f["ticket"], {p["word"]: p["ticket"] for p in f["places"] or []})
                    same += new.lower() == span.lower()
                    one += [text[at : f["a"]], PLACEHOLDERS[f["category"]]]
                    two += [text[at : f["a"]], new]
                    at = f["b"]
                redacted.append("".join(one) + text[at:])
                surrogate.append("".join(two) + text[at:])
                unchanged.append(same)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(redacted, pa.string()), pa.array(surrogate, pa.string()), pa.array(unchanged, pa.int32())], [key, "redacted", "surrogate", "unchanged"])

    return joined.mapInArrow(run, f"{key} {kind}, redacted string, surrogate string, unchanged int")


def replaced(scanned: DataFrame, key: str, known_names: DataFrame, secret: bytes) -> DataFrame:
    """(key, redacted, surrogate): the text with typed placeholders, and with surrogates.

    Whoever has the secret can tell what a surrogate of a number stood for, so it is the caller's to keep.
    """
    return _written(scanned, key, Surrogates(cut(scanned.select(key, "matches").distinct()), known_names, secret)).select(key, "redacted", "surrogate")
