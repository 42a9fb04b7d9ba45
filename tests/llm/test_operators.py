"""The training-data operators against brute force, round trips and held-out accuracy."""

import itertools
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from waraq.llm import copies, languages, leaks, lookalikes, mixing, mojibake, pii, repetition, spans, tokens
from waraq.llm.fm_index import FMIndex
from waraq.session import table

CLASH = ["key", "h", "n", "t", "a", "b", "doc", "label", "size", "ticket", "payload", "form", "odd", "units", "copies"]


def clashing(df):
    """Extra columns with the names that operators use inside."""
    for c in CLASH:
        if c not in df.columns:
            df = df.withColumn(c, F.lit("x"))
    return df


def rows_of(df, *cols):
    return sorted(tuple(r[c] for c in cols) for r in df.collect())


# 1


def honest_corpus():
    rng = random.Random(4)
    words = "کتاب شہر میں عکس تک رکھ جھک بہت اچھا ہے یہ وہ نے کے پانی درخت سڑک".split()
    latin = "le château à côté était déjà fermé naïve façade résumé São Brandão".split()
    out = [" ".join(rng.choice(words) for _ in range(40)) for _ in range(250)]
    return out + [" ".join(rng.choice(latin) for _ in range(30)) for _ in range(150)]


def test_mojibake_round_trip(spark):
    honest = honest_corpus()
    rows, expected = [(i, t) for i, t in enumerate(honest)], {}
    for k, p in enumerate(mojibake.PROPOSERS):
        source = honest[k] if p.chain.true == "utf-8" else honest[k].replace("ے", "ی").replace("ک", "ك").replace("ہ", "ه").replace("ی", "ي")
        bad = p.garble(source)
        if bad is not None:
            rows.append((1000 + k, bad))
            expected[1000 + k] = source
    found = {r["record_id"]: r for r in mojibake.restored(spark.createDataFrame(rows, "record_id bigint, text string"), "record_id", "text").collect()}
    assert set(found) == set(expected)
    for k, t in expected.items():
        assert found[k]["restored"] == t and not found[k]["lost"]


@pytest.mark.parametrize("most", [400, 300, 1000])
def test_mojibake_trains_on_most_texts_at_every_size(spark, monkeypatch, most):
    honest, models, parts, validate, judged = honest_corpus(), [], [], mojibake.validate, mojibake.judged
    monkeypatch.setattr(mojibake, "HELD_OUT", most)
    monkeypatch.setattr(mojibake, "validate", lambda model, *a: models.append(model) or validate(model, *a))
    monkeypatch.setattr(mojibake, "judged", lambda model, texts, k: parts.append((model, texts)) or judged(model, texts, k))
    df = spark.createDataFrame(enumerate(honest * 2), "record_id bigint, text string")
    mojibake.restored(df, "record_id", "text")
    clean = [t for t in honest if mojibake.seems_clean(t)]
    assert models[0].total == pytest.approx(2 * sum(len(t) + 2 for t in clean), rel=0.02)
    for model, texts in parts:
        assert 0 < len(texts) <= 40
        rest = mojibake.train(df.filter(~F.col("text").isin(texts)), "text")
        assert np.array_equal(model.t3, rest.t3)
    assert len(parts) >= 2 and sorted(t for _, texts in parts for t in texts) == sorted(set(clean)) or most == 300


def test_mojibake_lost_bytes_are_found_and_not_restored(spark):
    honest = honest_corpus()
    bad = honest[0].encode().decode("latin-1").replace("\x81", "�")
    rows = [*enumerate(honest), (999, bad), (998, "caf� bar")]
    found = {r["record_id"]: r for r in mojibake.restored(spark.createDataFrame(rows, "record_id bigint, text string"), "record_id", "text").collect()}
    assert set(found) == {999, 998} and all(r["lost"] and r["restored"] is None for r in found.values())


def test_mojibake_margin_is_validated_on_all_texts(spark, monkeypatch):
    honest, margins, validate = honest_corpus(), [], mojibake.validate
    df = spark.createDataFrame(enumerate(honest * 2), "record_id bigint, text string")
    for most in (20, 1000):
        monkeypatch.setattr(mojibake, "HELD_OUT", most)
        monkeypatch.setattr(mojibake, "validate", lambda *a: margins.append(validate(*a)) or margins[-1])
        mojibake.restored(df, "record_id", "text")
    assert margins[0] == margins[1]


def test_mojibake_margin_against_brute_force(spark):
    rng = random.Random(9)
    for honest, bad in ((300, 400), (3000, 0), (0, 700), (2500, 3000)):
        chance, reached = [rng.uniform(-9, 8) for _ in range(honest)], [rng.gauss(40, 9) for _ in range(bad)]
        highest = max([0.0, *chance])
        sure = sorted(reached)[bad // 50] if bad else highest + 6
        for odd in ([], [70.0], [70.0] * 5):
            above = max(70.0 if len(odd) > (honest + len(odd)) // 1000 else 0.0, highest)
            expected = (highest + sure) / 2 if above == highest else above
            if odd and not bad:
                expected = 73.0  # nothing tells how far corruptions reach
            gains = [*((False, x) for x in chance + odd), *((True, x) for x in reached)]
            rng.shuffle(gains)
            assert mojibake.margin(spark.createDataFrame(gains, mojibake.GAINS), 3.0) == pytest.approx(max(3.0, expected))


def test_mojibake_empty_table(spark):
    assert mojibake.restored(spark.createDataFrame([], "record_id bigint, text string"), "record_id", "text").count() == 0


def test_mojibake_honest_places_of_a_garbled_record_stay(spark):
    honest = [t + (" نہیں ملا، لیکن کیا؟ ہاں" if i % 10 == 0 else " نہیں ملا ہے، لیکن کیا ہے؟ ہاں") for i, t in enumerate(honest_corpus()[:250])]
    bad = honest[0].replace("شہر", "شہر".encode().decode("cp1256"))
    assert bad != honest[0]
    rows = [*enumerate(honest), (999, bad)]
    found = {r["record_id"]: r for r in mojibake.restored(spark.createDataFrame(rows, "record_id bigint, text string"), "record_id", "text").collect()}
    assert set(found) == {999} and found[999]["restored"] == honest[0]


# 2


def brute_repetition(text):
    w = [re.sub(r"\d", "0", x) for x in repetition.WORD.findall(text.lower())]
    grams = [tuple(w[i : i + 4]) for i in range(len(w) - 3)]
    covered = {i + k for i, g in enumerate(grams) if grams.count(g) > 1 for k in range(4)}
    return len(covered) / len(w) if w else 0.0


def test_repetition_against_brute_force():
    rng = random.Random(1)
    for _ in range(300):
        text = " ".join(rng.choice("ab cd Ef 12 34 gh".split()) for _ in range(rng.randint(0, 30)))
        n, m = repetition.measure(text)
        assert m[0] == pytest.approx(brute_repetition(text))


def test_repetition_edges_and_ablation(spark):
    loop = "one two three four " * 50
    rows = [(1, None, ""), (2, "a b", loop), (2, "a b", loop), (3, "   ", "x"), (4, loop * 200, None)]
    df = clashing(spark.createDataFrame(rows, "idx bigint, ar_text string, diff_text string"))
    found = repetition.ledger(df, "idx", ["ar_text", "diff_text"])
    assert found.count() == 8
    assert rows_of(found.filter(repetition.rejected("v1")), "idx", "field_name") == [(2, "diff_text"), (4, "ar_text")]
    report = {r["rule"]: r for r in repetition.ablation(found, "v3").collect()}
    assert report["words_in_repeated_4grams"]["fired"] == 2 and report["words_in_repeated_4grams"]["texts"] == 8
    assert all(r["rejected_without"] <= r["rejected"] for r in report.values())
    assert repetition.ledger(df.limit(0), "idx", ["ar_text"]).count() == 0


# 3

SECRET = b"a secret of tests"
KNOWN = [("given", "Rahimu", "رحیمو"), ("given", "Saliko", "سلیکو"), ("family", "Karandar", "کراندر"), ("family", "Maloandar", "ملواندر"), ("family", "Tiraandar", "تراندر"), ("family", "Bosuandar", "بسواندر")]
TEXTS = {
    1: ("Write to Ab.c+x@mail.example.org, thanks.", [("email", 9)]),
    2: ("me [at] shop [dot] example or you＠web.example", [("email", 0), ("email", 30)]),
    3: ("Call (029) 55501699 or +92 398 2839275 or 0391.456.1603.", [("phone", 5), ("phone", 23), ("phone", 42)]),
    4: ("CNIC 91025-4719038-0 and ۹۹۹۱۴ ۵۷۷۸۹۷۲ ۸ and ZQ3291804", [("identity_number", 5), ("identity_number", 25), ("identity_number", 45)]),
    5: ("Address: House No. 796, Street 31, Rodar Town, Lispura. Next", [("street_address", 9)]),
    6: ("پتہ: مکان نمبر ۷۲۵، گلی نمبر ۲۹، محلہ میسیم، ومبو۔", [("street_address", 5)]),
    7: ("Mr. Rahimu Karandar came, then R. Maloandar.", [("person_name", 4), ("person_name", 31)]),
    8: ("Karandar Textile Mills opened in 1920. ISBN 0220645138, Rs 500 @ 10.5%, 1,749,000, 02-03-2023, Version 1.0.0.4", []),
    9: ("رابطہ [@] یا [#] پر کریں۔ وہ خوشی سے آیا", []),
    10: ("محترمہ سلیکو ملواندر سے ملاقات ہوئی", [("person_name", 7)]),
}


def names():
    return pii.Names(KNOWN)


@pytest.mark.parametrize("k", TEXTS)
def test_pii_finds(k):
    text, expected = TEXTS[k]
    assert [(f.category, f.start) for f in pii.find(text, names())] == expected


def test_surrogates_are_distinct_consistent_and_of_the_same_form(spark):
    known = spark.createDataFrame(KNOWN, "name_part string, roman string, urdu string")
    rows = [(i, t) for i, (t, _) in TEXTS.items()] + [(20, "Mr. Rahimu Karandar again"), (21, "RAHIMU KARANDAR signed the form"), (22, None), (23, "")]
    df = clashing(spark.createDataFrame(rows, "result_id bigint, text string"))
    got = {r["result_id"]: r for r in pii.replaced(pii.scan(df, "result_id", "text", known), "result_id", known, SECRET).collect()}
    assert set(got) == {i for i, t in rows if t}
    assert got[4]["redacted"] == "CNIC [ID] and [ID] and [ID]" and got[9]["surrogate"] == TEXTS[9][0]
    assert re.fullmatch(r"CNIC [1-9]\d{4}-\d{7}-\d and [۱-۹][۰-۹]{4} [۰-۹]{7} [۰-۹] and [A-Z]{2}\d{7}", got[4]["surrogate"])
    one = got[7]["surrogate"].split(" came")[0].removeprefix("Mr. ")
    assert got[20]["surrogate"] == f"Mr. {one} again" and got[21]["surrogate"].startswith(one.upper()) and one not in got[7]["surrogate"].split("came")[1]
    keyed = pii.Keyed(SECRET)
    numbers = {keyed.digits(f"{i:05d}", "x") for i in range(0, 100000, 7)}
    assert len(numbers) == len(range(0, 100000, 7)) and all(keyed.digits(f"{i:03d}", "x") != f"{i:03d}" for i in range(1000))


def test_surrogates_of_addresses(spark):
    known = spark.createDataFrame(KNOWN, "name_part string, roman string, urdu string")
    places = ["Rodar Town", "Misal Town", "Mohalla Kotal", "Karandar Colony", "Tira Colony", "LISPURA Town"]
    texts = [f"House {n}, Street {k}, {p}" for n in (5, 6, 12) for k in range(1, 10) for p in places] + ["House 12-B, Block C, Rodar Town", "مکان نمبر ۷، گلی نمبر ۳، محلہ میسیم", "مکان نمبر ۷، گلی نمبر ۴، محلہ میسیم", "Flat No. 5, street 3, rodar town"]
    df = spark.createDataFrame(list(enumerate(texts)), "result_id bigint, text string")
    got = {r["result_id"]: r["surrogate"] for r in pii.replaced(pii.scan(df, "result_id", "text", known), "result_id", known, SECRET).collect()}
    changed = [got[i] for i in range(len(texts))]
    assert len(set(changed)) == len(texts) and not set(changed) & set(texts)
    form = lambda t: re.sub("[A-Z]+", "X", re.sub("[a-z]+", "x", re.sub(r"\d", "0", t)))
    assert all("Rodar" not in t and "Misal" not in t and "Kotal" not in t and "میسیم" not in t for t in changed)
    assert [form(t) for t in changed[:162]] == [form(t) for t in texts[:162]] and re.fullmatch(r"House \d\d-[A-Z], Block [A-Z], [A-Z][a-z]+ Town", changed[162])
    assert re.fullmatch(r"مکان نمبر [۰-۹]، گلی نمبر [۰-۹]، محلہ [ء-ۓ]+", changed[163]) and changed[162].split(", ")[2].lower() == changed[165].split(", ")[2]
    keyed = pii.Keyed(SECRET)
    assert sorted(keyed.digits(c, "x") for c in "0123456789") == list("0123456789")
    assert sorted(keyed.number(f"{i}", "x") for i in range(10, 100)) == [f"{i}" for i in range(10, 100)]


def test_surrogates_need_a_secret_and_follow_from_it(spark):
    with pytest.raises(ValueError):
        pii.Keyed(b"")
    a, b = pii.Keyed(SECRET), pii.Keyed(b"another secret")
    assert a.digits("1234567", "x") == pii.Keyed(SECRET).digits("1234567", "x") != b.digits("1234567", "x")


def test_surrogates_of_many_entities_are_distinct_and_no_entities(spark):
    known = spark.createDataFrame(KNOWN, "name_part string, roman string, urdu string")
    given, family = [n for p, n, _ in KNOWN if p == "given"], [n for p, n, _ in KNOWN if p == "family"]
    people = [f"Mr. {g} {f}" for g in given for f in family]
    texts = people + [f"Call 0391 4561{i:03d}" for i in range(300)] + [f"CNIC 91025-47190{i:02d}-0" for i in range(100)] + [f"to u{i}@web.example or u{i} [at] mail [dot] web [dot] example" for i in range(200)]
    texts += [f"House No. {i}, Street 3, Block C" for i in range(1, 10)]
    df = spark.createDataFrame(list(enumerate(texts)), "result_id bigint, text string")
    scanned = pii.scan(df, "result_id", "text", known)
    assert {r["property"]: r["violations"] for r in pii.checks(scanned, "result_id", known, SECRET).collect()} == dict.fromkeys(["surrogates of two entities", "surrogates that are entities", "entities with two surrogates", "places named as other places", "finds that stayed as they were"], 0)
    out = {r["result_id"]: r["surrogate"] for r in pii.replaced(scanned, "result_id", known, SECRET).collect()}
    made = [out[i] for i in range(len(people))]
    assert len(set(made)) == len(people) and not set(made) & set(people) and not any(c.isdigit() for t in made for c in t)
    assert re.fullmatch(r"to \w+\.\w+@mail\.example or \w+\.\w+ \[at\] mail \[dot\] host \[dot\] example", out[len(people) + 400])


def test_surrogates_keep_gender_where_titles_tell_it(spark):
    women, men = ["Salika", "Nurani", "Rahila"], ["Karimo", "Talibo", "Zamiro"]
    rows = [("given", n, None) for n in women + men] + [("family", f, None) for f in ("Karandar", "Maloandar", "Tiraandar", "Bosuandar", "Lemuandar")]
    known = spark.createDataFrame(rows, "name_part string, roman string, urdu string")
    texts = [f"Mrs. {n} Karandar" for n in women] + [f"Mr. {n} Karandar" for n in men] + [f"{n} Maloandar came" for n in women + men]
    df = spark.createDataFrame(list(enumerate(texts)), "result_id bigint, text string")
    out = {r["result_id"]: r["surrogate"] for r in pii.replaced(pii.scan(df, "result_id", "text", known), "result_id", known, SECRET).collect()}
    for i in range(12):
        first = out[i].replace("Mrs. ", "").replace("Mr. ", "").split()[0]
        assert (first in women) == (i in (0, 1, 2, 6, 7, 8)), out[i]


def test_surrogates_of_an_empty_table_and_without_known_names(spark):
    known = spark.createDataFrame([], "name_part string, roman string, urdu string")
    df = spark.createDataFrame([(1, "Mr. Rahimu Karandar, House 5, Street 3, Rodar Town or a@b.example")], "result_id bigint, text string")
    assert pii.items(pii.scan(df.limit(0), "result_id", "text", known), "result_id", known, SECRET).count() == 0
    got = pii.replaced(pii.scan(df, "result_id", "text", known), "result_id", known, SECRET).first()["surrogate"]
    assert re.fullmatch(r"Mr. [A-Z][a-z]+ [A-Z][a-z]+, House \d, Street \d, [A-Z][a-z]+ Town or [a-z]+\.[a-z]+@mail.example", got)


def test_address_ends_before_the_next_word():
    text = "woh Ghar No. 625, Gali 31, Tutupura Colony mein rehte hain"
    assert [text[f.start : f.end] for f in pii.find(text, names())] == ["Ghar No. 625, Gali 31, Tutupura Colony"]


# 4


def test_lookalikes(spark):
    same = ["Yeh kitab pichle saal", "Yеh kitаb рісhlе ѕааl", "Ｙｅｈ kitab pich‍le saal", "Yeh kitab pichle  saal"]
    urdu = ["كل يہ ہے آج ئ", "کل یہ ہے آج ئ", "ﮐﻞ ﯾﮧ ﮨﮯ آج ئ"]
    other = ["Yeh kitab pichle sаal.", "yeh kitab pichle saal", "Москва рада", "café", "cafe"]
    blank = [None, "", "  ", "​﻿"]
    texts = same + urdu + other + blank
    df = clashing(spark.createDataFrame(list(enumerate(texts)) + [(0, texts[0])], "record_id bigint, text string"))
    forms = lookalikes.consistent(df, "record_id", "text")
    got = {r["key"]: r["form"] for r in forms.collect()}
    assert set(got) == set(range(len(texts) - len(blank)))
    assert got[1] == texts[0] and got[9] == "Москва рада"
    expected = [*itertools.combinations(range(4), 2), *itertools.combinations(range(4, 7), 2)]
    assert rows_of(lookalikes.same_look(forms), "id_a", "id_b") == sorted(expected)
    assert lookalikes.same_look(lookalikes.consistent(df.limit(0), "record_id", "text")).count() == 0


def test_the_vocabulary_decides_what_is_repaired(spark):
    """Toward a word of the corpus a mixed token is repaired; toward none it stays, and the texts differ."""
    rows = [(1, "kitab pichle saal"), (2, "kitab pichle saal"), (3, "kitаb рichle saal"), (4, "zuqnа vela"), (5, "zuqna vela")]
    df = spark.createDataFrame(rows, "record_id bigint, text string")
    forms = lookalikes.consistent(df, "record_id", "text")
    assert rows_of(lookalikes.same_look(forms), "id_a", "id_b") == [(1, 2), (1, 3), (2, 3)]
    got = {r["key"]: r for r in forms.collect()}
    assert got[4]["form"] != got[5]["form"] and got[4]["skeleton"] == got[5]["skeleton"]
    assert rows_of(lookalikes.same_look(lookalikes.consistent(df, "record_id", "text", seen=1)), "id_a", "id_b") == [(1, 2), (1, 3), (2, 3), (4, 5)]
    assert rows_of(lookalikes.looks(forms), "key", "look", "size") == [(1, 1, 3), (2, 1, 3), (3, 1, 3), (4, 4, 1), (5, 5, 1)]


def test_a_look_of_a_third_of_all_rows(spark, monkeypatch):
    from waraq.operators import groups

    monkeypatch.setattr(groups, "BLOCK", 20)
    df = spark.range(300).select(F.col("id").alias("record_id"), F.when(F.col("id") % 3 == 0, F.lit("same text")).otherwise(F.concat(F.lit("text "), F.col("id"))).alias("text"))
    found = lookalikes.same_look(lookalikes.consistent(df, "record_id", "text"))
    assert rows_of(found, "id_a", "id_b") == list(itertools.combinations(range(0, 300, 3), 2))


# 5


def brute_leak(item, doc):
    i, d = leaks.split(item), leaks.split(doc)
    held = {tuple(d[k : k + 8]) for k in range(len(d) - 7)}
    covered = {k + j for k in range(len(i) - 7) if tuple(i[k : k + 8]) in held for j in range(8)}
    return len(covered) / len(i) if i else 0.0


@pytest.mark.parametrize("most", [leaks.BLOCK_CHARS, 10])
def test_leaks_against_brute_force(spark, monkeypatch, most):
    monkeypatch.setattr(leaks, "BLOCK_CHARS", most)
    rng = random.Random(2)
    vocabulary = [f"w{i}" for i in range(40)]
    items = [(f"i{k}", " ".join(rng.choice(vocabulary) for _ in range(rng.randint(5, 60)))) for k in range(40)]
    docs = [("none", None), ("empty", ""), ("long", " ".join(rng.choice(vocabulary) for _ in range(20000)))]
    for k in range(80):
        words = [rng.choice(vocabulary) for _ in range(rng.randint(0, 200))]
        item = rng.choice(items)[1].split()
        a = rng.randrange(len(item))
        b = rng.randint(a, len(item))
        at = rng.randint(0, len(words))
        docs.append((f"d{k}", ", ".join(words[:at] + item[a:b] + words[at:]).upper()))
    df = clashing(spark.createDataFrame(docs + docs[5:9], "doc_id string, doc string"))
    got = {(r["doc_id"], r["item_id"]): r["containment"] for r in leaks.leaks(df, "doc_id", "doc", clashing(spark.createDataFrame([*items, ("x", None)], "item_id string, text string")), "item_id", "text").collect()}
    want = {(d, i): c for d, doc in docs for i, item in items if doc and (c := brute_leak(item, doc)) >= 0.6}
    assert got == pytest.approx(want) and want


def test_recall_of_long_and_repetitive_items(spark):
    """Items of 30 to 10,000 words, every other one a passage over and over, each leaked to the share that just counts."""
    rng = random.Random(31)
    items, docs = [], []
    for k in range(120):
        n = rng.choice([30, 60, 200, 300, 1000, 3000, 10000])
        period = rng.choice([9, 20, 100]) if k % 2 else n
        passage = [f"w{k}x{rng.randrange(10**7)}" for _ in range(min(period, n))]
        words = (passage * (n // len(passage) + 1))[:n]
        items.append((f"i{k}", " ".join(words)))
        at = rng.randrange(n - -(-6 * n // 10) + 1)
        docs.append((f"d{k}", " ".join([f"z{rng.randrange(99)}" for _ in range(50)] + words[at : at - (-6 * n // 10)] + ["end"] * 3)))
    found = leaks.leaks(spark.createDataFrame(docs, "doc_id string, doc string"), "doc_id", "doc", spark.createDataFrame(items, "item_id string, text string"), "item_id", "text")
    assert rows_of(found, "doc_id", "item_id") == sorted((f"d{k}", f"i{k}") for k in range(120))
    kept = [len(leaks.Sketch([i], 0.6, 1e-9).values) / max(1, len(set(leaks.shingle_values(leaks.split(i[1]), {}).tolist()))) for i in items]
    assert min(kept) < 0.1 and max(kept) == 1


def test_leak_sketches_keep_all_of_short_items():
    assert leaks.threshold(13, 0.6, 1e-9) == 2**64 - 1
    assert 0 < leaks.threshold(5000, 0.6, 1e-9) < 2**64 - 1


def test_items_that_repeat_a_passage_are_not_missed():
    rng = random.Random(12)
    for k in range(60):
        passage = " ".join(f"w{k}x{rng.randrange(10**6)}" for _ in range(20))
        sketch = leaks.Sketch([("e", " ".join([passage] * 250))], 0.6, 1e-9)
        assert sketch.candidates(leaks.shingle_values(leaks.split(passage + " " + passage), {})) == {0}
    words = [f"w{i}" for i in range(5000)]
    assert len(leaks.Sketch([("e", " ".join(words))], 0.6, 1e-9).values) < 1000


# 6


def test_copies(spark):
    rows = [
        (5, "Hello, World! 12"), (3, "HELLO world 12"), (9, "hello world 13"),
        (10, '{"name": "Ab", "n": "1"}'), (11, "n = 1; name = ab"), (12, "name: AB\nn: 1"), (13, "name: ab\nn: 2"), (14, "name 'Ab' n 1"),
        (20, None), (21, ""), (22, "...!"), (5, "Hello, World! 12"), (30, "x" * 200_000), (31, "X" * 200_000 + "."),
        (40, '{"a": "b", "c": "d"}'), (41, '{"c": "d", "a": "b"}'), (42, '{"c": "b", "a": "d"}'), (43, "a: b\na: b\nc: d"),
        (50, "x: 1\nx: 1\ny: 2"), (51, "y: 2; x: 1; x: 1"), (52, "y: 2; y: 2; x: 1"), (60, "{'k': 'v', 'w': {'z': 1}}"), (61, '{"w": {"z": 1}, "k": "V"}'),
    ]
    df = clashing(spark.createDataFrame(rows, "row_id bigint, text string"))
    got = {r["row_id"]: (r["keep_id"], r["size"]) for r in copies.copy_sets(df, "row_id", "text").collect()}
    assert got[5] == got[3] == (3, 2) and got[9] == (9, 1)
    assert got[10] == got[11] == got[12] == got[14] == (10, 4) and got[13] == (13, 1)
    assert got[50] == got[51] == (50, 2) and got[52] == (52, 1) and got[60] == got[61] == (60, 2)
    assert got[30] == got[31] == (30, 2) and got[40] == got[41] == (40, 2) and got[42] == (42, 1) and got[43] == (43, 1)
    assert not {20, 21, 22} & set(got)
    assert copies.copy_sets(df.limit(0), "row_id", "text").count() == 0


def test_rows_of_equal_sums_and_other_fields_are_apart(spark, monkeypatch):
    rows = [(1, "t1", ["a", "b"]), (2, "t1", ["b", "a"]), (3, "t1", ["a", "c"]), (4, "t1", ["c", "a"]), (5, "t2", ["a", "b"])]
    got = {r["row_id"]: r["key"] for r in copies._verified(spark.createDataFrame(rows, "row_id bigint, key string, payload array<string>")).collect()}
    assert got[1] == got[2] == "t1" and got[3] == got[4] != "t1" and got[5] == "t2"


def test_copies_of_a_hot_group(spark):
    df = spark.range(3000).select(F.col("id").alias("row_id"), F.when(F.col("id") % 3 == 0, F.lit("Same text!")).otherwise(F.concat(F.lit("text "), F.col("id"))).alias("text"))
    sizes = copies.copy_sets(df, "row_id", "text").groupBy("size").count().collect()
    assert {r["size"]: r["count"] for r in sizes} == {1000: 1000, 1: 2000}


# 7


def test_languages_held_out(spark, sf):
    samples = table(spark, sf, "label_samples")
    train = samples.filter("pmod(xxhash64(sample_id), 4) <> 0")
    test = samples.filter("pmod(xxhash64(sample_id), 4) = 0").select(F.col("sample_id").cast("string").alias("doc_id"), F.lit(0).alias("seg_no"), F.col("label"), "text")
    extra = spark.createDataFrame([("n", 0, "urdu", None), ("e", 0, "urdu", ""), ("s", 0, None, "chota")], test.schema)
    got = languages.segment_languages(clashing(test.unionByName(extra)), train)
    rows = got.collect()
    assert sum(r["label"] == r["recorded"] for r in rows) >= 0.95 * len(rows) and len(rows) > 60
    assert not {"n", "e", "s"} & {r["doc_id"] for r in rows} and all(0 <= r["confidence"] <= 1 + 1e-9 for r in rows)
    docs = {r["doc_id"]: r["label"] for r in languages.document_languages(got).collect()}
    assert all(docs[r["doc_id"]] == r["label"] for r in rows)


def test_corpus_words_of_every_language_count(spark, sf):
    samples = languages._sample_words(table(spark, sf, "label_samples"))
    first = languages.Model(*languages._first_model(samples))
    rows = table(spark, sf, "label_samples").filter("label in ('urdu', 'english')").select(F.concat("text", F.when(F.col("label") == "english", F.lit(" thingamajig")).otherwise(F.lit(" کتابچہ"))).alias("text"), "label").cache()
    once = rows.filter("label = 'english'").limit(1).select(F.concat("text", F.lit(" doohickeyish")).alias("text"), "label")
    model = languages.Model(*languages._second_model(samples, rows.unionByName(once)))
    assert model.times("english", "thingamajig") > 1 and model.times("english", "doohickeyish") == 1 and model.times("urdu", "thingamajig") == 0
    assert model.times("urdu", "کتابچہ") > first.times("urdu", "کتابچہ") and model.totals[0] > first.totals[0]
    # tables added up by Spark are those added up in one place
    alone = languages.Model(*languages._tables(spark.createDataFrame([(a, w, n) for (a, w), n in samples.items()], "language int, word string, n bigint").repartition(5)))
    assert np.array_equal(alone.grams, first.grams) and np.array_equal(alone.mass, first.mass) and np.array_equal(alone.known, first.known)


def test_latest_population_wins(spark):
    rows = [("a", "urdu", "2024-01-01", "2024-01-01"), ("a", "english", "2024-02-01", "2024-01-05"), ("b", None, "2024-01-01", "2024-01-01")]
    df = spark.createDataFrame(rows, "doc_id string, population string, written_ts string, loaded_ts string")
    assert {r["doc_id"]: r["recorded"] for r in languages.latest_population(df).collect()} == {"a": "english", "b": None}


# 8


def test_token_ids_equal_a_public_library(spark):
    tokenizers, public = pytest.importorskip("tokenizers"), pytest.importorskip("public_tokenizers")
    reference = tokenizers.Tokenizer.from_file(public.path("byte_bpe_50k.json"))
    reference.encode_special_tokens = True
    rng = random.Random(3)
    alphabet = list("abcdeth inguo '\"!?.,  \n\t\xa0　\x1c\x85éüکیا۔ے१२٤३'s'll<|endoftext|>-=_/𝔘😀‌́")
    texts = ["".join(rng.choice(alphabet) for _ in range(rng.randint(1, 80))) for _ in range(2000)]
    texts += ["ab" * 30000, " " * 5000, "   x", "x   ", "<|endoftext|>", "\n\n a"]
    rows = [*enumerate(texts), (-1, None), (-2, "")]
    got = {r["doc_id"]: r["ids"] for r in tokens.encode(clashing(spark.createDataFrame(rows, "doc_id bigint, text string")), "doc_id", "text").collect()}
    assert got[-1] == got[-2] == []
    for i, t in enumerate(texts):
        assert got[i] == reference.encode(t, add_special_tokens=False).ids, repr(t[:80])


# 9


def test_mixture_keeps_shares_and_caps(spark):
    rng = random.Random(5)
    rows = [(i, "ab cd ef " * rng.randint(0, 30), rng.choice(["a"] * 6 + ["b"] * 3 + ["c", None, "z"])) for i in range(6000)] + [(9001, None, "a"), (9002, "", "b")]
    docs = clashing(spark.createDataFrame(rows, "doc_id bigint, text string, source string"))
    targets = spark.createDataFrame([("a", 0.5, 1), ("b", 0.2, 2), ("c", 0.3, 3), ("q", 0.0, 1)], "source string, target_share double, max_repeats int")
    chosen, report = mixing.mixture(docs, targets)
    got = {r["source"]: r for r in report.collect()}
    for s, share in (("a", 0.5), ("b", 0.2), ("c", 0.3)):
        assert abs(got[s]["actual_share"] - share) < 0.01 and got[s]["most_copies"] <= got[s]["max_repeats"]
    assert got["z"]["mixed_tokens"] == 0 and got[None]["mixed_tokens"] == 0
    again = mixing.mixture(docs.repartition(7), targets)[0]
    assert rows_of(chosen, "doc_id", "copies") == rows_of(again, "doc_id", "copies")
    assert mixing.mixture(docs.limit(0), targets)[0].count() == 0
    short = {r["source"]: r for r in mixing.mixture(docs, targets, total_tokens=10**9)[1].collect()}
    assert short["c"]["most_copies"] == 3 and short["a"]["most_copies"] == 1


# 10


def test_fm_index_against_brute_force():
    rng = random.Random(3)
    for trial in range(60):
        n = rng.choice([5, 8, 13])
        letters = "ab" if trial % 3 == 0 else "abcdefg"
        docs = ["".join(rng.choice(letters) for _ in range(rng.randint(1, 60))) for _ in range(rng.randint(1, 8))]
        for _ in range(rng.randint(0, 5)):
            a, j = rng.choice(docs), rng.randrange(len(docs))
            s, q = rng.randint(0, len(a)), rng.randint(0, len(docs[j]))
            docs[j] = docs[j][:q] + a[s : s + rng.randint(n - 2, n + 10)] + docs[j][q:]
        owners = np.array([rng.choice(range(len(docs))) for _ in docs])
        index = FMIndex([np.array([ord(c) for c in d], np.int64) for d in docs], owners, n)
        piece, at, cls = index.shared_windows()
        want = {(i, s) for i, d in enumerate(docs) for s in range(len(d) - n + 1) if any(d[s : s + n] in docs[j] and owners[j] != owners[i] for j in range(len(docs)))}
        assert {(int(x), int(y)) for x, y in zip(piece, at)} == want


def brute_spans(texts, n):
    held = {}
    for k, t in texts:
        for i in range(len(t or "") - n + 1):
            held.setdefault(t[i : i + n], set()).add(k)
    pairs = {p for v in held.values() for p in itertools.combinations(sorted(v), 2)}
    cover = {}
    for k, t in texts:
        marks = set()
        for i in range(len(t or "") - n + 1):
            if len(held[t[i : i + n]]) > 1:
                marks.update(range(i, i + n))
        cover[k] = len(marks)
    return pairs, cover


@pytest.mark.parametrize("hot", [2000, 4])
def test_shared_spans_against_brute_force(spark, hot, monkeypatch):
    monkeypatch.setattr(spans, "HOT_TEXTS", hot)
    rng = random.Random(6)
    n = 24
    passages = ["".join(rng.choice("abcdefghij ") for _ in range(rng.randint(18, 60))) for _ in range(12)]
    texts = []
    for k in range(60):
        t = "".join(rng.choice("abcdefghij ") for _ in range(rng.randint(0, 150)))
        for _ in range(rng.randint(0, 2)):
            at = rng.randint(0, len(t))
            t = t[:at] + rng.choice(passages) + t[at:]
        texts.append((k, t))
    texts += [(100, None), (101, ""), (102, texts[3][1]), (103, texts[3][1]), (104, "ab" * 400), (107, "q" + "ab" * 300), (105, "é😀" * 30), (106, "x" + "é😀" * 30)]
    df = clashing(spark.createDataFrame(texts, "doc_id bigint, text string"))
    op = spans.SharedSpans(df, length=n)
    pairs, cover = brute_spans(texts, n)
    assert set(rows_of(op.pairs(), "doc_a", "doc_b")) == pairs and pairs
    got = {r["doc_id"]: r["shared_chars"] for r in op.coverage(df).collect()}
    assert got == cover
    assert set(rows_of(spans.SharedSpans(df, length=n, wants=("pairs",)).pairs(), "doc_a", "doc_b")) == pairs
    assert {r["doc_id"]: r["shared_chars"] for r in spans.SharedSpans(df, length=n, wants=("spans",)).coverage(df).collect()} == cover
    assert spans.SharedSpans(df.limit(0), length=n).pairs().count() == 0


def test_every_query_runs(spark, sf):
    from waraq.llm.queries import QUERIES

    for name, f in QUERIES.items():
        df = f(spark, sf)
        assert df.columns and df.count() >= 0, name


NULLS = "record_id bigint, doc_id string, idx bigint, seg_no int, label string, text string, source string"


def everything(spark, df):
    """Each operator over one table, as (name, rows)."""
    known = spark.createDataFrame([*KNOWN, (None, "A", "B"), ("given", None, None)], "name_part string, roman string, urdu string")
    samples = spark.createDataFrame([("urdu", "یہ ایک کتاب ہے"), ("english", "this is a book"), (None, "x"), ("hindi", None)], "label string, text string")
    items = spark.createDataFrame([("i", " ".join("abcdefghijkl")), (None, " ".join("abcdefghijkl")), ("j", None)], "item_id string, text string")
    targets = spark.createDataFrame([("a", 0.5, None), ("b", None, 2), (None, 0.5, 1)], "source string, target_share double, max_repeats int")
    yield "p1", mojibake.restored(df, "record_id", "text")
    yield "p2", repetition.ledger(df, "idx", ["text"])
    scanned = pii.scan(df, "record_id", "text", known)
    yield "p3", pii.items(scanned, "record_id", known, SECRET)
    yield "p3r", pii.replaced(scanned, "record_id", known, SECRET)
    yield "p4", lookalikes.same_look(lookalikes.consistent(df, "record_id", "text"))
    yield "p5", leaks.leaks(df, "doc_id", "text", items, "item_id", "text")
    yield "p6", copies.copy_sets(df, "record_id", "text")
    found = languages.segment_languages(df, samples)
    yield "p7", found
    yield "p7d", languages.document_languages(found)
    yield "p8", tokens.encode(df, "record_id", "text")
    chosen, report = mixing.mixture(df, targets, key="record_id")
    yield "p9", chosen
    yield "p9r", report
    op = spans.SharedSpans(df, "record_id", "text", length=30)
    yield "p10", op.pairs()
    yield "p10c", op.coverage(df, "record_id", "text")


def test_empty_tables(spark):
    empty = clashing(spark.createDataFrame([], NULLS))
    for name, df in everything(spark, empty):
        assert name == "p9r" or df.count() == 0, name


def test_nulls_in_any_column_ties_and_very_long_texts(spark):
    long = "abc def 12 " * 60_000
    rows = [(1, "d", 1, 0, "urdu", "یہ ایک کتاب ہے اور یہ کتاب ہے", "a"), (1, "d", 1, 0, "urdu", "یہ ایک کتاب ہے اور یہ کتاب ہے", "a"), (None, None, None, None, None, "یہ ایک کتاب ہے اور یہ کتاب ہے", None), (2, None, 2, 1, None, None, "b"), (3, "e", 3, None, "x", "", "a"), (4, "f", 4, 2, "", long, "a"), (5, "g", 5, 3, "english", long + ".", "b"), (6, "h", 6, 4, "hindi", " " * 1000, None), (7, "i", 7, 5, None, "x" * 100_000, "a"), (8, "j", 8, 6, "y", "@" * 20_000 + "1" * 20_000, "b")]
    got = {name: df.collect() for name, df in everything(spark, clashing(spark.createDataFrame(rows, NULLS)))}
    assert {r["idx"] for r in got["p2"]} == set(range(1, 9)) and not got["p1"]
    assert {r["record_id"]: r["ids"] for r in got["p8"] if r["record_id"] in (2, 3)} == {2: [], 3: []} and len(got["p8"]) == len(rows)
    assert {(r["doc_a"], r["doc_b"]) for r in got["p10"]} == {(4, 5)}
    assert {r["row_id"]: r["size"] for r in got["p6"]} == {1: 1, 4: 2, 5: 2, 7: 1, 8: 1}
    assert all(r["doc_id"] for r in got["p7"]) and {r["doc_id"]: r["label"] for r in got["p7"]}["d"] == "urdu"
