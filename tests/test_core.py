"""The core operators against plain Python, their invariants, and their SQL."""

import hashlib
import itertools
import random
import re

import pytest
from pyspark.sql import functions as F

from waraq import config
from waraq.config import Damage
from waraq.functions import text as T
from waraq.operators import analytics, corruption, decontaminate, dedup, encoding, exclusions, generation, neardup, normalize, packing, pii, quality, sampling, scripts, splits
from waraq.operators.components import connected_components
from waraq.plans import pipeline
from waraq.sources import readers


def one(spark, value, expr, kind="string"):
    return spark.createDataFrame([(value,)], f"text {kind}").select(expr(F.col("text")).alias("x")).first()["x"]


def docs_of(spark, texts, **extra):
    rows = [(i, t) for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    for name, value in extra.items():
        df = df.withColumn(name, value)
    return df


# text


@pytest.mark.parametrize("s", ["", "  A  b\t\nC ", "Straße\xa0 X", None, "a b　c\x85d"])
def test_canonical_and_tokens_are_pythons(spark, s):
    assert one(spark, s, T.canonical) == " ".join((s or "").lower().replace("ß", "ss").split())
    assert one(spark, s, T.tokens) == (s or "").split()


def test_shingles(spark):
    words = [random.Random(1).choice("abcdef") for _ in range(60)]
    assert set(one(spark, " ".join(words), T.shingles)) == {" ".join(words[i : i + 5]) for i in range(56)}
    assert one(spark, "a b c d", T.shingles) == []


def test_stable_unit_does_not_depend_on_order(spark):
    df = spark.range(500).withColumn("u", T.stable_unit(F.col("id").cast("string"), "s"))
    values = {r["id"]: r["u"] for r in df.repartition(7).collect()}
    assert values == {r["id"]: r["u"] for r in df.coalesce(1).collect()}
    assert values[3] == int(hashlib.md5(b"s|3").hexdigest()[:13], 16) / 16**13 and 0.4 < sum(values.values()) / 500 < 0.6


def test_configs_are_strict_and_have_fingerprints():
    with pytest.raises(ValueError):
        config.Quality.from_dict({"min_char": 3})
    assert config.Quality().fingerprint() != config.Quality(min_chars=3).fingerprint() == config.Quality.from_dict({"min_chars": 3}).fingerprint()
    assert config.NearDup().candidate_probability(0.8) > 0.99


# deduplication


def test_exact_dedup_survivor_is_a_function_of_ids(spark):
    df = docs_of(spark, ["Same  text", "same text", "other", None, "", "SAME TEXT\n"])
    for parts in (1, 5):
        got = {r["doc_id"]: (r["group_size"], r["kept"]) for r in dedup.verdicts(df.repartition(parts)).collect()}
        key = lambda i: hashlib.md5(f"dedup/k|{i}".encode()).hexdigest()
        assert [i for i in (0, 1, 5) if got[i][1]] == [min((0, 1, 5), key=key)] and got[0][0] == 3 and got[3][0] == 2 and got[2] == (1, True)
    stats = dedup.statistics(df).first()
    assert stats["documents"] == 6 and stats["distinct_documents"] + stats["duplicates"] == 6
    assert dedup.survivors(df).count() == 3
    empty = dedup.statistics(df.limit(0)).first()
    assert empty["documents"] == 0 and empty["largest_group"] == 0


def test_a_group_of_a_third_of_all_rows(spark):
    df = spark.range(3000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 == 0, F.lit("the same")).otherwise(F.concat(F.lit("text "), F.col("id"))).alias("text"), F.lit("s").alias("source"))
    got = dedup.verdicts(df).collect()
    assert len(got) == 3000 and sum(r["kept"] for r in got) == 2001 and max(r["group_size"] for r in got) == 1000
    assert dedup.removed_by_source(df).first()["removed"] == 999


def test_lines_stay_with_one_owner_and_no_document_is_emptied(spark):
    line = "x" * 70
    df = docs_of(spark, [f"{line}\nown text of one", f"{line}\nown text of two", line, "short\nshort"])
    got = {r["doc_id"]: r for r in dedup.strip_lines(df).collect()}
    assert got[2]["text"] == line and got[3]["text"] == "short\nshort"
    assert sum(line in got[i]["text"] for i in (0, 1)) == sum(got[i]["removed_lines"] == 0 for i in (0, 1))
    assert dedup.line_statistics(df).first()["removable_chars"] == 140


def test_components_are_union_find(spark):
    rng = random.Random(2)
    edges = [(f"{i:03d}", f"{i + 1:03d}") for i in range(30)] + [(f"{rng.randrange(100, 300)}", f"{rng.randrange(100, 300)}") for _ in range(150)]
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges:
        parent[max(find(a), find(b))] = min(find(a), find(b))
    got = {r["node"]: r["root"] for r in connected_components(spark.createDataFrame(edges, "a string, b string")).collect()}
    assert got == {x: find(x) for x in parent}


def test_near_duplicates(spark):
    rng = random.Random(7)
    base = [f"word{rng.randrange(400)}" for _ in range(200)]
    near = base[:100] + ["changed"] + base[101:]
    texts = [" ".join(base), " ".join(near), " ".join(f"w{rng.randrange(400)}" for _ in range(200)), "too short", None]
    df = docs_of(spark, texts)
    got = {r["doc_id"]: (r["kept"], r["reason"], r["cluster_size"]) for r in neardup.verdicts(df).collect()}
    assert sorted((got[0][0], got[1][0])) == [False, True] and got[0][2] == 2 and got[2] == (True, "unique", 1)
    assert got[3][1] == got[4][1] == "too_few_shingles"
    with pytest.raises(ValueError):
        neardup.sweep(df, (0.3,))
    rows = {r["threshold"]: r["removed"] for r in neardup.sweep(df, (0.5, 0.8, 0.99)).collect()}
    assert rows[0.5] >= rows[0.8] >= rows[0.99]


def test_pairs_that_are_not_anchored_are_tried(spark):
    rng = random.Random(11)
    texts = []
    for family in range(3):
        base = [f"w{family}x{rng.randrange(10**6)}" for _ in range(200)]
        for _ in range(40):
            changed = list(base)
            for at in rng.sample(range(200), rng.choice((2, 2, 3))):
                changed[at] = f"y{rng.randrange(10**9)}"
            texts += [" ".join(changed)] * rng.choice((1, 1, 2))
    sketches = neardup.sketched(docs_of(spark, texts)).cache()
    held = {r["doc_key"]: r["bins"] for r in sketches.collect()}
    alike = {(a, b): sum(map(int.__eq__, held[a], held[b])) / 128 for a, b in itertools.combinations(sorted(held), 2)}
    root = {k: k for k in held}
    for a, b in (p for p, x in alike.items() if x >= 0.8):
        old, new = max(root[a], root[b]), min(root[a], root[b])
        root |= {k: new for k, r in root.items() if r == old}
    got = {r["doc_key"]: r["cluster"] for r in neardup.clusters(sketches, neardup.linked(sketches, config.NearDup(), 0.8), 0.8).collect()}
    star = {r["doc_key"]: r["cluster"] for r in neardup.clusters(sketches, neardup.pairs(sketches), 0.8).collect()}
    assert got == root and star != root
    assert {(r["a"], r["b"]) for r in neardup.pairs(sketches, every=True).collect() if r["similarity"] >= 0.8} == {p for p, x in alike.items() if x >= 0.8}
    removed = [r["removed"] for r in neardup.sweep(docs_of(spark, texts), (0.8,), every=True).collect()]
    kept = [r["kept"] for r in neardup.verdicts(docs_of(spark, texts), every=True).collect()]
    assert removed == [kept.count(False)] == [len(root) - len(set(root.values()))]


def test_sketches_estimate_jaccard():
    rng = random.Random(3)
    order = neardup.probe_order(128, 0)
    import numpy as np

    for share in (0.2, 0.5, 0.8):
        a = [rng.getrandbits(60) for _ in range(400)]
        b = a[: int(400 * share)] + [rng.getrandbits(60) for _ in range(400 - int(400 * share))]
        x, y = (neardup.sketch(np.array(s), order) for s in (a, b))
        j = len(set(a) & set(b)) / len(set(a) | set(b))
        assert abs((x == y).mean() - j) < 0.15


def test_decontamination_is_directed_and_inclusive(spark):
    rng = random.Random(4)
    item = [f"i{rng.randrange(1000)}" for _ in range(29)]  # 25 shingles
    doc = [f"d{rng.randrange(1000)}" for _ in range(400)]
    texts = [" ".join(doc[:100] + item[:24] + doc[100:]), " ".join(doc[:100] + item[:23] + doc[100:]), " ".join(item).upper(), None]
    items = spark.createDataFrame([("q", " ".join(item)), ("short", "a b c"), ("nul", None)], "item_id string, text string")
    df = docs_of(spark, texts)
    hits = decontaminate.hits(df, items)
    got = {r["doc_id"]: (r["reason"], r["containment"]) for r in decontaminate.verdicts(hits).collect()}
    assert got == {"0": ("containment", 0.8), "2": ("exact_document", 1.0)}
    sets = spark.createDataFrame([("q", "s"), ("short", "s"), ("nul", "s")], "item_id string, eval_set string")
    assert decontaminate.coverage(hits, items, sets).first().asDict() == {"eval_set": "s", "items": 3, "found": 1}


def shuffled_rows(df):
    """Rows that the shuffles of a plan write when it runs."""

    def walk(p):
        name = p.nodeName()
        if name.startswith("AdaptiveSparkPlan"):
            return walk(p.executedPlan())
        if "QueryStage" in name:
            return walk(p.plan())
        if name == "ReusedExchange":
            return 0
        own = p.metrics().get("shuffleRecordsWritten")
        return (own.get().value() if own.isDefined() else 0) + sum(walk(p.children().apply(i)) for i in range(p.children().size()))

    df.collect()
    return walk(df._jdf.queryExecution().executedPlan())


@pytest.fixture(scope="module")
def phrase_shared(spark):
    """120 items and 301 documents that all hold a common phrase, so that each pair shares shingles; the last document is an item's text with a word more."""
    word = lambda r: "".join(r.choice("abcdefghijklmnop") for _ in range(7))
    rng, phrase = random.Random(11), "as it has been said before on this same page by many others"
    texts = [f"{' '.join(word(rng) for _ in range(12))} {phrase}" for _ in range(420)]
    items = spark.createDataFrame([(f"i{n}", ("words", "sentences")[n % 2], t) for n, t in enumerate(texts[:120])], "item_id string, eval_set string, text string")
    return docs_of(spark, [*texts[120:], texts[1] + " more"]), items, [config.EvalSet("words"), config.EvalSet.for_sentences("sentences")]


def test_report_shuffles_documents_once_and_no_pairs(spark, phrase_shared):
    docs, items, specs = phrase_shared
    found = decontaminate.hits_by_set(docs, items, specs)
    assert [(r["doc_id"], r["item_id"], r["exact"]) for r in found.collect()] == [("300", "i1", "")]
    assert shuffled_rows(found) < 2 * 301
    rows = {tuple(r) for r in decontaminate.report(found, specs, docs.withColumn("source", F.lit("s"))).collect()}
    assert rows == {("reason", "containment", 1, 1), ("set", "sentences", 1, 1), ("source", "s", 1, 1)}


def test_removals_take_whole_pairs_and_shuffle_no_pairs_of_items(spark, phrase_shared):
    docs, items, specs = phrase_shared
    halves = docs.select(F.concat(F.lit("p"), F.floor(F.col("doc_id") / 2).cast("string"), F.lit("#"), (F.col("doc_id") % 2).cast("string")).alias("doc_id"), "text")
    found = decontaminate.removals(decontaminate.hits_by_set(halves, items, specs), specs)
    assert [r["doc_id"] for r in found.collect()] == ["p150"]
    assert shuffled_rows(found) < 2 * 301


def test_char_containments_equal_brute_force_and_shuffle_no_pairs(spark, monkeypatch):
    """Repeated rows, ids with several texts (those of as many shingles count as one), items of equal text or of several, and item sets in parts."""
    rng, spec = random.Random(12), config.EvalSet.for_sentences("s")
    sentence = lambda: " ".join(rng.choice(["pani", "kitab", "ghar", "shehar", "raat", "subah", "dost", "kal", "bohat", "purana"]) for _ in range(10))
    items = [(f"i{n}", sentence()) for n in range(60)]
    items += [("i60", items[0][1]), ("i1", sentence()), items[2], ("short", "pani"), ("nul", None)]
    docs = [(f"d{n}", sentence()) for n in range(150)]
    docs += [(f"e{n}", t[: len(t) * 9 // 10 - n % 3]) for n, (_, t) in enumerate(items[:60])] + [(f"f{n % 20}", f"{t} {sentence()}") for n, (_, t) in enumerate(items[:60])]
    docs += [(i, t) for i, t in items if t] + docs[:40] + [("g", items[3][1][:25]), ("g", items[3][1][25:]), ("null", None), (None, items[4][1])]
    sh = lambda t: {c[k : k + 5] for c in [" ".join((t or "").lower().split())] for k in range(len(c) - 4)}
    sides = []
    for rows in (docs, items):
        side = {}
        for i, t in rows:
            if i is not None and sh(t):
                side.setdefault((i, len(sh(t))), set()).update(sh(t))
        sides.append(side)
    for retain in (0.8, 0.0):
        want = {(d, i, len(a & b), n, m) for (d, n), a in sides[0].items() for (i, m), b in sides[1].items() if d != i and m >= 25 and a & b and len(a & b) / m >= retain}
        want = {(d, i, s, round(s / m, 9), round(s / (m + n - s), 9)) for d, i, s, n, m in want}
        for at_once in (4_000_000, 2_000):
            monkeypatch.setattr(decontaminate, "BROADCAST_SHINGLES", at_once)
            got = decontaminate.containments(spark.createDataFrame(docs, "doc_id string, text string"), spark.createDataFrame(items, "item_id string, text string"), config.EvalSet(**{**vars(spec), "retain": retain}))
            assert {(r["doc_id"], r["item_id"], r["shared"], round(r["containment"], 9), round(r["jaccard"], 9)) for r in got.collect()} == want
            assert got.count() >= len(want) > 100 and shuffled_rows(got) <= len(docs)


def test_popular_shingles_are_counted_in_halves(monkeypatch):
    import numpy as np
    import pyarrow as pa

    hs = [[1, 2, 3, 4, n] for n in range(10, 50)]
    x = decontaminate._index(pa.table({"item_id": [f"i{n}" for n in range(40)], "eval_set": ["s"] * 40, "size": pa.array([5] * 40, pa.int32()), "hs": pa.array(hs, pa.list_(pa.int64()))}), 5, "word", {"s": 0.0})
    h, owner = np.array([1, 2, 3, 11, 4, 12, 1, 99], np.uint64), np.array([0, 0, 0, 0, 1, 2, 3, 3])
    whole = [v.tolist() for v in x.candidates(h, owner)]
    assert list(zip(*whole, strict=True)) == [(0, i) for i in range(40)] + [(1, i) for i in range(40)] + [(2, 2)] + [(3, i) for i in range(40)]
    monkeypatch.setattr(decontaminate, "PAIRS", 1)
    assert [v.tolist() for v in x.candidates(h, owner)] == whole


# stages


def test_encoding_verdicts(spark):
    urdu = "یہ ایک کتاب ہے اور یہ بہت اچھی ہے"
    once = urdu.encode().decode("latin-1")
    texts = ["plain text", "café " * 20 + "cafÃ©" * 2, "x�" * 3, "\x01\x02abc", None, "caf\xc3\xa9 et th\xc3\xa9"]
    got = {r["doc_id"]: r for r in encoding.validate(docs_of(spark, texts)).select("doc_id", "enc.*").collect()}
    assert [got[i]["verdict"] for i in range(6)] == ["ok", "mojibake", "replacement_heavy", "control_heavy", "ok", "repaired"]
    assert got[5]["text"] == "café et thé" and got[5]["passes"] == 1 and got[4]["text"] == ""
    assert encoding.log(encoding.validate(docs_of(spark, [once]))).count() == 1
    data = spark.createDataFrame([(bytearray(b"\xef\xbb\xbfok"),), (bytearray(b"\xff\xfe"),)], "d binary")
    assert [r[0] for r in data.select(encoding.decode_utf8(F.col("d"))).collect()] == ["ok", None]


def test_normalization(spark):
    f = lambda s: one(spark, s, normalize.normalized)
    assert f("كتابي هذه") == "کتابی ہذہ" and f("ﻛﺘﺎﺏ ﷲ") == "کتاب اللہ" and f("۱۲٣") == "123" and f("a‌b​cـ") == "abc"
    assert f("  a \t b \r\n\n\n\n c ") == "a b\n\nc"
    for s in ("كتاب ﷺ", "ٹڈڑںےۓھ", None, "", "a\n\nb"):
        assert f(f(s)) == f(s)
    row = normalize.log(normalize.normalize(docs_of(spark, ["كك ي", None]))).first()
    assert row["kaf"] == 2 and row["yeh"] == 1 and row["documents"] == 2


def test_language_labels(spark):
    texts = ["یہ ایک کتاب ہے اور میں نے اس کو بہت پڑھا ہے", "yeh kitab bohat achi hai aur main ne is ko parha hai", "the book was on the table and it is not mine", "إن الكتاب في هذا المكان الذي كان على الطريق", "این کتاب را برای شما آن است که هم دیگر بود", "यह किताब बहुत अच्छी है और मैंने इस किताब को बहुत बार पढ़ा है", "12 34", "یہ کتاب بہت اچھی ہے۔ the book was very good and it is here. وہ بھی نہیں آیا ہے۔ this is not the same as that.", None]
    got = {r["doc_id"]: r["label"] for r in scripts.classify(docs_of(spark, texts)).collect()}
    assert got == dict(enumerate(["urdu", "roman_urdu", "english", "arabic", "persian", "hindi", "empty", "code_switched", "empty"]))


def test_quality_against_plain_python(spark):
    rng = random.Random(5)
    texts = [None, "", "one"] + [" ".join(rng.choice("ab cd ef gh ij".split()) + rng.choice(["", "\n", "  "]) for _ in range(rng.randint(3, 40))) for _ in range(25)]
    for t in texts:
        words = list(re.finditer(r"\S+", t or ""))
        low = [m[0].lower() for m in words]
        lines, tops, dups = quality.repetition(t or "", (3,), (5,), 10**6)
        grams = [tuple(low[i : i + 5]) for i in range(len(low) - 4)]
        marked = {p for i, g in enumerate(grams) if grams.count(g) > 1 for p in range(words[i].start(), words[i + 4].end())}
        assert dups[0] == pytest.approx(len(marked) / len(t) if t else 0.0)
    got = quality.score(quality.measure(docs_of(spark, texts))).collect()
    assert len(got) == len(texts) and all("too_short" in r["reasons"] for r in got)
    fired = {r["family"]: r for r in quality.family_counts(quality.score(quality.measure(docs_of(spark, texts)))).collect()}
    assert fired["too_short"]["fired"] == len(texts) and fired["too_short"]["sole"] <= fired["too_short"]["fired"]


def test_repetition_late_in_a_long_text_counts(spark):
    text = " ".join(f"w{i}" for i in range(100_000)) + " round and round it goes again" * 50_000
    got = quality.score(quality.measure(docs_of(spark, [text]))).first()
    share = len(" round and round it goes again") * 50_000 / len(text)
    assert got["words"] == 400_000 and got["dup_10gram"] == pytest.approx(share, abs=1e-4) and "repetition:dup_10gram" in got["reasons"]


def test_percentiles_are_nearest_rank(spark):
    values = [random.Random(6).randrange(50) for _ in range(333)]
    df = spark.createDataFrame([(float(v),) for v in values], "m double")
    got = {r["point"]: r["value"] for r in quality.percentiles(df, ["m"]).collect()}
    assert got == {p: sorted(values)[min(int(p * 333), 332)] for p in (0.01, 0.05, 0.25, 0.5, 0.75, 0.95, 0.99)}


@pytest.mark.parametrize("text,kinds", [("a@b.com", ["email"]), ("0300-1234567 and 021 34567890", ["phone", "phone"]), ("+92 300 1234567", ["phone"]), ("ISBN 0220645138", []), ("2020-01-01 12:30:11", []), ("@handle 10.5%", []), ("12345-1234567-1", [])])
def test_pii_forms(spark, text, kinds):
    assert [k for *_, k in pii.spans(text)] == kinds


def test_redaction_is_idempotent(spark):
    df = docs_of(spark, ["mail a.b@c.org or (021) 34567890!", None, "x" * 100_000])
    first = pii.redact(df)
    assert pii.redact(first.select("doc_id", "text")).select("text").exceptAll(first.select("text")).count() == 0
    assert {r["doc_id"]: r["text"] for r in first.collect()}[0] == "mail [@] or [#]!"


# splits, packing, exclusions


def test_splits_never_overshoot_and_nest(spark):
    rng = random.Random(8)
    rows = [(f"d{i}", rng.choice(["u", "r", None]), rng.randint(0, 500)) for i in range(3000)]
    df = spark.createDataFrame(rows, "doc_id string, population string, chars bigint")
    c = config.Splits(buckets=300)
    got = splits.assign(df, splits.bands(splits.histogram(df, c), c), c)
    rows = got.collect()
    for p in ("u", "r"):
        total = sum(r["chars"] for r in rows if r["population"] == p)
        for split in ("test", "validation"):
            assert sum(r["chars"] for r in rows if r["population"] == p and r["split_name"] == split) <= total * 0.02
        assert sum(r["chars"] for r in rows if r["population"] == p and "A" in r["arms"]) <= total * 0.05
    assert all("B" in r["arms"] for r in rows if "A" in r["arms"])
    assert all((r["split_name"] == "unassigned") == (r["population"] is None) for r in rows)
    pair = spark.createDataFrame([("p#roman", "u", 1), ("p#urdu", "u", 1)], df.schema)
    assert pair.transform(lambda x: splits.bucketed(x, c)).select("bucket").distinct().count() == 1


def test_a_stored_histogram_is_solved_again(spark, tmp_path):
    df = spark.range(500).select(F.col("id").alias("doc_id"), F.lit("u").alias("population"), F.lit(10).alias("chars"))
    c = config.Splits(buckets=100)
    splits.save(splits.histogram(df, c), str(tmp_path / "h"), c)
    other = config.Splits(buckets=100, heldout_share=0.1)
    assert splits.resolve(spark, str(tmp_path / "h"), other).collect() == splits.bands(splits.histogram(df, other), other).collect()
    with pytest.raises(ValueError):
        splits.resolve(spark, str(tmp_path / "h"), config.Splits(buckets=50))


def test_packing_is_a_running_buffer(spark):
    rng = random.Random(9)
    c = config.Packing(sequence_length=16)
    texts = ["x" * rng.randint(0, 40) for _ in range(80)]
    df = docs_of(spark, texts).withColumn("stream", F.lit("s")).withColumn("n_tokens", F.length("text"))
    at = packing.placed(df, c)
    order = sorted((i for i, t in enumerate(texts) if t), key=lambda i: (hashlib.md5(f"packing-1|{i}".encode()).hexdigest(), i))
    buffer = [x for i in order for x in [*texts[i].encode(), c.eos]]
    packed = packing.pack_ids(at.join(packing.byte_ids(df), "doc_id"), "ids", c)
    assert [r["ids"] for r in packed.orderBy("seq").collect()] == [buffer[k : k + 16] for k in range(0, len(buffer) - 15, 16)]
    rows = packing.sequences(at, c).collect()
    assert sum(r["separators"] for r in rows) == buffer[: len(buffer) // 16 * 16].count(c.eos)
    report = packing.stream_report(at, c).first()
    assert report["tokens"] == len(buffer) and report["sequences"] * 16 + report["dropped_tokens"] == len(buffer)
    assert packing.verify(packed, c).first().asDict() == {"sequences": len(buffer) // 16, "wrong_length": 0, "out_of_range": 0}


def test_exclusions(spark, tmp_path):
    ids = spark.createDataFrame([("1",), ("2",), ("2",), ("77",)], "doc_id string")
    exclusions.write(ids, str(tmp_path / "x"), "dedup", {"web": "plan-a"})
    back = exclusions.read(spark, str(tmp_path / "x"), {"web": "plan-a", "other": "plan-z"})
    df = docs_of(spark, ["a", "b", "c"])
    assert [r["doc_id"] for r in exclusions.apply(df, back).collect()] == [0]
    assert exclusions.report(df, back).first().asDict() == {"listed": 3, "hits": 2, "unapplied": 1}
    with pytest.raises(ValueError):
        exclusions.read(spark, str(tmp_path / "x"), {"web": "plan-b"})


# sources and samples


def test_sources(spark, tmp_path):
    spark.createDataFrame([("t1", "i1", "u"), (None, "i2", "u"), ("  ", "i3", "u")], "text string, id string, url string").write.parquet(str(tmp_path / "p"))
    layout = readers.Layout(meta=("url",))
    rows = readers.parquet(spark, str(tmp_path / "p"), "web", layout).collect()
    assert [(r["doc_id"], r["text"], r["meta"]) for r in rows] == [("web:i1", "t1", {"url": "u"})]
    with pytest.raises(ValueError):
        readers.parquet(spark, str(tmp_path / "p"), "web", readers.Layout(text="body"))
    positional = readers.parquet(spark, str(tmp_path / "p"), "web", readers.Layout(id=None), keep_empty=True)
    assert positional.select("doc_id").distinct().count() == 3
    (tmp_path / "a.csv").write_text('k,t\n1,"line one\nline ""two"""\n')
    assert readers.csv(spark, str(tmp_path / "a.csv"), "k int, t string").first()["t"] == 'line one\nline "two"'
    (tmp_path / "a.jsonl").write_text('{"text": "x"}\n{"text": "y"}\n')
    assert readers.jsonl(spark, str(tmp_path / "a.jsonl")).count() == 2
    (tmp_path / "a.txt").write_text("one\n\ntwo\n \nthree")
    assert [r["text"] for r in readers.paragraphs(spark, str(tmp_path / "a.txt")).collect()] == ["one", "two", "three"]
    (tmp_path / "f").mkdir()
    (tmp_path / "f" / "d.bin").write_bytes(b"abc")
    digest = hashlib.sha256(b"abc").hexdigest()
    (tmp_path / "m.json").write_text('{"files": [{"source": "s", "path": "b", "local_path": "d.bin", "sha256": "%s", "split": "t", "size": 3}, {"source": "s", "path": "a", "local_path": "q\\\\e.bin", "sha256": "no", "split": "t", "size": 0}]}' % digest)
    files = readers.manifest(spark, str(tmp_path / "m.json"), "s", "t")
    assert [r["local_path"] for r in files.collect()] == ["q/e.bin", "d.bin"]
    assert {(r["path"], r["problem"]) for r in readers.manifest_problems(files).collect()} == {("a", "sha256"), ("a", "size")}
    assert {r["local_path"]: r["verdict"] for r in readers.verify_files(spark, files, str(tmp_path / "f")).collect()} == {"d.bin": "ok", "q/e.bin": "missing"}
    halves = readers.parallel_halves(spark.createDataFrame([(1, "r", "u"), (2, None, "v")], "id int, a string, b string"), "id", "a", "b")
    assert {r["doc_id"] for r in halves.collect()} == {"1#roman", "1#urdu", "2#urdu"}
    assert readers.plan_fingerprint(["a", "b"], layout, 0.5, "s") == readers.plan_fingerprint(["b", "a"], layout, 0.5, "s") != readers.plan_fingerprint(["a"], layout, 0.5, "s")


def test_samples(spark):
    df = spark.range(2000).select(F.col("id").alias("doc_id"), (F.col("id") % 3).alias("g"))
    few = sampling.lowest_per_group(df, ["g"], 5, "s")
    assert {r["g"]: r["count"] for r in few.groupBy("g").count().collect()} == {0: 5, 1: 5, 2: 5}
    assert {r["doc_id"] for r in few.collect()} == {r["doc_id"] for r in sampling.lowest_per_group(df.repartition(9), ["g"], 5, "s").collect()}
    assert sum(sampling.apportion(64, {"a": 0.65, "b": 0.2, "c": 0.15}).values()) == 64


# generation, corruption, analytics


def test_generation_metrics(spark):
    df = docs_of(spark, ["a b a b a b", "x", None, "a b c d"])
    got = {r["doc_id"]: r for r in generation.statistics(df, "doc_id", "text").collect()}
    assert got[0]["distinct_1"] == pytest.approx(1 / 3) and got[0]["repetition"] == pytest.approx(1 / 3) and got[2]["n_words"] == 0
    assert {r["doc_id"]: r["longest_run"] for r in generation.longest_repeated_run(df, "doc_id", "text").collect()} == {0: 4, 1: 0, 2: 0, 3: 0}
    steps = spark.createDataFrame([(1, [0, 1, 1, 0]), (2, [3]), (3, None)], "id int, s array<int>")
    assert {r["id"]: (r["in_order"], r["same_pass"]) for r in generation.commit_order(steps, "id", "s").collect()}[1] == (pytest.approx(1 / 3), pytest.approx(1 / 3))
    items = spark.createDataFrame([("a", [1, 2, 2], [2, 2, 9, 9]), ("a", [5], [5])], "arm string, gold array<int>, made array<int>")
    row = generation.infill_scores(items, "gold", "made", "arm").first()
    assert row["exact"] == 1 and row["f1"] == pytest.approx((2 / 3 + 1) / 2)


def test_lexicon(spark):
    df = docs_of(spark, ["کتاب کِتاب شہر", "abc شہر نیا", None])
    assert {r["word"]: r["n"] for r in generation.lexicon(df).collect()} == {"کتاب": 2, "شہر": 2}
    assert {r["doc_id"]: (r["words"], r["unknown"]) for r in generation.unknown_rate(df, generation.lexicon(df), "doc_id", "text").collect()} == {0: (3, 0), 1: (2, 1)}


def test_corruption_depends_on_the_id_only(spark):
    df = docs_of(spark, ["یہ ایک کتاب ہے اور گھر میں بہت لوگ ہیں" * 5, None, ""])
    for kind in corruption.KINDS:
        a = {r["doc_id"]: r["text"] for r in corruption.corrupt(df, kind, 3).collect()}
        assert a == {r["doc_id"]: r["text"] for r in corruption.corrupt(df.repartition(3), kind, 3).collect()} and a[1] is None


# Words and how speakers write them.
WRITTEN = {"کرتے": "karte", "گھر": "ghar", "بندہ": "banda", "درگاہ": "dargah", "صفحہ": "safha", "ہمارے": "hamare", "پڑھنا": "parhna", "اچھا": "achha", "لڑکی": "larki", "بھائی": "bhayi", "کتاب۔": "kataba.", "plain text": "plain text", "": ""}


def test_romanization(spark):
    df = spark.createDataFrame([*enumerate(WRITTEN), (-1, None)], "doc_id bigint, text string")
    got = {r["doc_id"]: r["text"] for r in corruption.corrupt(df, "romanize").collect()}
    assert [got[i] for i in range(len(WRITTEN))] == list(WRITTEN.values()) and got[-1] is None
    mixed = {r["doc_id"]: r["text"] for r in corruption.corrupt(df.withColumn("text", F.repeat(F.concat("text", F.lit(" ")), 200)), "code_switch", 1, config=Damage(switch_rate=(0.5, 0.5))).collect()}
    assert set(mixed[1].split()) == {"گھر", "ghar"} and mixed[11].split()[:2] == ["plain", "text"]


CLEAN = "یہ کتاب 1947 میں لاہور سے چھپی، اور اس کے 350 صفحات ہیں۔ لوگ اسے آج بھی پڑھتے ہیں۔ کیا آپ نے دیکھی؟"


def test_half_of_ocr_damage_is_undone_by_normalization(spark):
    df = spark.createDataFrame([(i, CLEAN) for i in range(40)], "doc_id bigint, text string")
    back = lambda config: [r["text"] for r in corruption.corrupt(df, "ocr", 1, config=config).select(normalize.normalized(F.col("text")).alias("text")).collect()]
    assert df.select(normalize.normalized(F.col("text")).alias("t")).first()["t"] == CLEAN
    assert set(back(Damage(ocr_rate=(0.5, 0.5), ocr_lossy_share=0.0))) == {CLEAN}
    assert CLEAN not in back(Damage(ocr_rate=(0.5, 0.5), ocr_lossy_share=1.0))
    damaged = [r["text"] for r in corruption.corrupt(df, "ocr", 1, config=Damage(ocr_rate=(0.4, 0.4))).collect()]
    assert len(set(damaged)) == 40 and CLEAN not in damaged and not any("\u064b" <= c <= "\u0660" and c != "\u0660" or c == "\u0670" for t in damaged for c in t)
    undone = {v for vs in corruption.reversible().values() for v in vs}
    assert not undone & {c for f in corruption.DOT_FAMILIES for c in f}


def test_spacing_moves_spaces_only(spark):
    df = spark.createDataFrame([(i, CLEAN) for i in range(20)], "doc_id bigint, text string")
    got = [r["text"] for r in corruption.corrupt(df, "spacing", 3, config=Damage(spacing_rate=(0.5, 0.5))).collect()]
    assert CLEAN not in got and {t.replace(" ", "") for t in got} == {CLEAN.replace(" ", "")}
    with pytest.raises(ValueError):
        Damage(ocr_rate=(0.5, 0.1))


def test_reports(spark):
    files = spark.createDataFrame([("a", 1, 5), ("b", 1, 5), ("c", 2, 1)], "path string, rank int, size bigint")
    assert [r["path"] for r in analytics.fetch_plan(files, 9).collect()] == ["a"]
    old = spark.createDataFrame([("k", 1, "o"), ("m", 1, "o")], "id string, v int, x string")
    new = spark.createDataFrame([("k", 2, "n")], old.schema)
    assert {r["id"]: r["x"] for r in analytics.upsert(old, new, ["id"], "v").collect()} == {"k": "n", "m": "o"}
    pairs = spark.createDataFrame([("a b", "x"), ("a", "x y"), ("b", "y")], "l string, r string")
    assert {(r["u"], r["s"]): r["p"] for r in analytics.cooccurrence(pairs, "l", "r", 2).collect()} == {("a", "x"): 1.0}
    made = docs_of(spark, ["a b c d", "q r"])
    assert {r["doc_id"]: r["overlap"] for r in analytics.ngram_overlap(made, docs_of(spark, ["x a b c"]), "doc_id", "text", 2).collect()} == {0: pytest.approx(2 / 3), 1: 0.0}


def test_streams(spark, tmp_path):
    from waraq.streaming import stages

    src = str(tmp_path / "in")
    words = " ".join(f"w{i}" for i in range(40))
    docs_of(spark, [words, "clean text " * 5]).withColumn("loaded_ts", F.lit("2024-01-01").cast("timestamp")).write.parquet(src)
    items = spark.createDataFrame([("q", words)], "item_id string, text string")
    stages.decontaminated(stages.read_parquet(spark, src), items, str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
    assert [r["doc_id"] for r in spark.read.parquet(str(tmp_path / "out")).collect()] == [1]
    seen = stages.first_seen(stages.read_parquet(spark, src), "1 hour")
    q = seen.writeStream.format("memory").queryName("seen").option("checkpointLocation", str(tmp_path / "cp2")).trigger(availableNow=True).start()
    q.awaitTermination()
    assert spark.table("seen").count() == 2


def test_late_rows_still_count_within_the_watermark(spark, tmp_path):
    from waraq.streaming import stages

    for name, rows in (("a", [("2024-01-01 00:00:10", "x"), ("2024-01-01 00:09:00", "x")]), ("b", [("2024-01-01 00:05:00", "x"), ("2024-01-01 02:00:00", "y")])):
        spark.createDataFrame(rows, "ts string, kind string").select(F.col("ts").cast("timestamp").alias("ts"), "kind").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    counts = stages.windowed_counts(stages.read_parquet(spark, str(tmp_path / "in"), 1), "ts", "10 minutes", "30 minutes", "kind")
    q = counts.writeStream.format("memory").queryName("windows").outputMode("complete").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination()
    assert sorted((r["kind"], r["n"]) for r in spark.table("windows").collect()) == [("x", 3), ("y", 1)]


def urdu_words(rng, n):
    return ["".join(rng.choice("بپتٹجچدڈرڑسشکگلمنے") for _ in range(5)) for _ in range(n)]


def test_composed_plan_where_documents_leave_it(spark):
    rng = random.Random(8)
    base, passage, line = urdu_words(rng, 200), urdu_words(rng, 60), " ".join(urdu_words(rng, 20))
    raw_item = " ".join(passage).replace("ک", "ك") + " a.b@mail.example"  # an item as it was before normalization and redaction
    texts = {
        0: " ".join(base), 1: " ".join(base[:100] + ["بدلا"] + base[101:]), 2: " ".join(base), 3: " ".join(urdu_words(rng, 200)),
        4: " ".join(urdu_words(rng, 100) + passage + ["[@]"] + urdu_words(rng, 100)), 5: "plain english text that is not wanted here " * 20, 6: "بہت کم", 7: None,
        8: " ".join(urdu_words(rng, 150)) + "\n" + line, 9: line + "\n" + " ".join(urdu_words(rng, 150)), 10: " ".join(urdu_words(rng, 150)) + " Ã˜Â¨" * 90 + "Ã¿",
    }
    df = spark.createDataFrame(list(texts.items()), "doc_id bigint, text string").withColumn("source", F.lit("s"))
    items = spark.createDataFrame([("e", raw_item)], "item_id string, text string")
    rows = {r["doc_id"]: r for r in pipeline.curate(df, items).collect()}
    got = {i: r["stage"] for i, r in rows.items()}
    assert sorted(got[i] for i in (0, 1, 2)) == ["exact_duplicate", "kept", "near_duplicate"] and got[3] == "kept"
    assert got[4] == "contaminated" and got[5] == "language" and got[6] in ("language", "quality") and got[7] == "language" and got[10] == "encoding"
    assert got[8] == got[9] == "kept" and sorted(rows[i]["removed_lines"] for i in (8, 9)) == [0, 1]
    assert pipeline.curate(df.limit(0), items).count() == 0


def test_numbers_of_candidates_are_taken_by_groups_of_digits():
    assert [(t, k) for a, b, k in pii.spans("(042) 1234567 oder") for t in ["(042) 1234567 oder"[a:b]]] == [("(042) 1234567", "phone")]
    assert pii.spans("0300123456") == [] and pii.spans("03001234567") == [(0, 11, "phone")] and pii.spans("+92 300 1234567 89 99 99") == [(0, 15, "phone")]
    assert pii.unsafe_placeholders() == [] and pii.unsafe_placeholders(("[@]", "03001234567")) == ["03001234567"]


# budgets


def test_token_bands_never_overshoot_and_tell_what_runs_out(spark):
    from dataclasses import replace

    rng = random.Random(3)
    config = config_of_budgets()
    hist = [("x", b, rng.randint(1, 50)) for b in sorted(rng.sample(range(config.buckets), 400))] + [("y", 7, 5)]
    found = {(r["population"], r["band"]): r for r in splits.token_bands(spark.createDataFrame(hist, "population string, bucket bigint, chars bigint"), config).collect()}
    chars = lambda p, a, b: sum(c for q, k, c in hist if q == p and a <= k < b)
    for (p, band), r in found.items():
        assert r["chars"] == chars(p, r["bucket_from"], r["bucket_to"]) <= r["target"]
    x = {b: r for (p, b), r in found.items() if p == "x"}
    assert x["test"]["bucket_from"] == x["validation"]["bucket_to"] and x["arm_A"]["bucket_to"] <= x["arm_B"]["bucket_to"] <= x["validation"]["bucket_from"]
    assert x["arm_B"]["exhausted"] and not x["arm_A"]["exhausted"] and not x["test"]["exhausted"] and all(r["exhausted"] for (p, _), r in found.items() if p == "y")
    again = {(r["population"], r["band"]): r for r in splits.token_bands(spark.createDataFrame(hist, "population string, bucket bigint, chars bigint"), replace(config, heldout_sequences=2)).collect()}
    assert again["x", "arm_A"]["bucket_to"] == x["arm_A"]["bucket_to"]  # an arm doesn't move with the held-out sets
    funded = {(r["arm"], r["population"]): r["funded"] for r in splits.funding(spark.createDataFrame(hist, "population string, bucket bigint, chars bigint"), config).collect()}
    assert funded["A", "x"] and not funded["B", "x"] and not funded["A", "y"]


def config_of_budgets():
    return config.Budgets(arms=(("A", 1000), ("B", 9000)), targets=(("x", 9), ("y", 1)), chars_per_token=(("x", 2.0), ("y", 3.0)), heldout_sequences=4, sequence_length=100)


def test_components_of_hubs_chains_and_loops(spark):
    rng = random.Random(2)
    edges = [(f"h{i:04d}", "h0500") for i in range(1000)] + [(f"c{i:03d}", f"c{i + 1:03d}") for i in range(150)] + [("x", "x"), ("p", "q"), ("q", "p"), ("q", "r")]
    edges += [(f"r{rng.randrange(80):02d}", f"r{rng.randrange(80):02d}") for _ in range(60)]
    parent = {}

    def root(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges:
        a, b = sorted((root(a), root(b)))
        parent[b] = a
    got = {r["node"]: r["root"] for r in connected_components(spark.createDataFrame(edges, "a string, b string")).collect()}
    assert got == {n: root(n) for n in parent}
    assert connected_components(spark.createDataFrame([], "a string, b string")).count() == 0


def test_packed_corpus_is_checked_against_its_manifest(spark, tmp_path):
    cfg = config.Packing(sequence_length=16, sequences_per_shard=3)
    df = docs_of(spark, ["abcdefghij" * k for k in range(1, 9)]).withColumn("stream", F.when(F.col("doc_id") % 2 == 0, F.lit("urdu/train/A")).otherwise(F.lit("urdu/test"))).withColumn("n_tokens", F.length("text"))
    packed = packing.pack_ids(packing.placed(df, cfg).join(packing.byte_ids(df), "doc_id"), "ids", cfg)
    path = str(tmp_path / "corpus")
    manifest = packing.write(packed, path, cfg).collect()
    assert sum(r["sequences"] for r in manifest) == packed.count() and all(r["tokens"] == 16 * r["sequences"] for r in manifest)
    assert packing.verify_corpus(spark, path, cfg).count() == 0
    assert {r["problem"] for r in packing.verify_corpus(spark, path, config.Packing(sequence_length=8)).collect()} == {"length"}
    assert {r["problem"] for r in packing.verify_corpus(spark, path, cfg, vocabulary=100).collect()} == {"vocabulary"}
    files = sorted((tmp_path / "corpus" / "data").rglob("*.parquet"))
    files[0].unlink()
    files[1].write_bytes(files[2].read_bytes())
    for crc in (tmp_path / "corpus" / "data").rglob(".*.crc"):
        crc.unlink()
    assert {r["problem"] for r in packing.verify_corpus(spark, path, cfg).collect()} == {"missing", "digest"}


def test_packed_ids_are_the_streams_in_order(spark):
    cfg = config.Packing(sequence_length=7)
    rng = random.Random(5)
    texts = ["".join(rng.choice("abc") for _ in range(rng.randint(0, 40))) for _ in range(30)]
    df = docs_of(spark, texts).withColumn("stream", F.lit("s")).withColumn("n_tokens", F.length("text"))
    for across in (True, False):
        at = packing.placed(df, cfg, across=across)
        got = {r["seq"]: r["ids"] for r in packing.pack_ids(at.join(packing.byte_ids(df), "doc_id"), "ids", cfg).collect()}
        flat = []
        for r in sorted(at.collect(), key=lambda r: r["at"]):
            assert r["at"] == len(flat)
            flat += [*texts[r["doc_id"]].encode(), cfg.eos][: r["n"]]
        assert got == {k: flat[7 * k : 7 * k + 7] for k in range(len(flat) // 7)} and got
    index = packing.indexed(packing.pack_ids(packing.placed(df.unionByName(df.withColumn("stream", F.lit("t"))), cfg).join(packing.byte_ids(df), "doc_id"), "ids", cfg))
    assert sorted(r["index"] for r in index.collect()) == list(range(index.count()))


def test_governance(spark):
    from waraq.sources import governance

    sources = spark.createDataFrame([("a", "CC-BY-4.0", "0" * 40), ("b", "CC-BY-NC-4.0", "main"), ("c", "made up", None), ("d", "CC-BY-SA-4.0", "f" * 64), ("d", "CC0-1.0", "f" * 64)], "source string, licence string, revision string")
    terms = governance.licences(spark)
    verdicts = {(r["source"], r["licence"]): r["verdict"] for r in governance.judged(sources, terms).collect()}
    assert verdicts["a", "CC-BY-4.0"] == "ok" and verdicts["b", "CC-BY-NC-4.0"] == "no_commercial_use" and verdicts["c", "made up"] == "unknown_licence"
    docs = spark.createDataFrame([(1, "a"), (2, "b"), (3, "z"), (4, None), (5, "d")], "doc_id bigint, source string")
    assert sorted(r["doc_id"] for r in governance.eligible(docs, sources, terms).collect()) == [1, 5]
    assert sorted((r["source"], r["share_alike"]) for r in governance.attribution(sources, terms).collect()) == [("a", False), ("d", True)]
    assert sorted((r["source"], r["problem"]) for r in governance.problems(sources).collect()) == [("b", "revision"), ("c", "revision"), ("d", "duplicate")]
    files = [("a", f"p{i}", i, "0" * 64) for i in range(9)]
    one = lambda rows: governance.identity(spark.createDataFrame(rows, "source string, path string, size bigint, sha256 string")).first()
    assert one(files) == one(files[::-1] + files[:2]) and one(files)["fingerprint"] != one(files[:-1] + [("a", "p8", 9, "0" * 64)])["fingerprint"]


def test_coverage_of_exclusion_lists(spark, tmp_path):
    ids = spark.createDataFrame([("x",)], "doc_id string")
    exclusions.write(ids, str(tmp_path / "one"), "dedup", {"news": "p1"})
    got = {r["name"]: (r["verdict"], r["stages"]) for r in exclusions.coverage(spark, [str(tmp_path / "one"), str(tmp_path / "none")], ["news", "forum"]).collect()}
    assert got == {"news": ("covered", ["dedup"]), "forum": ("uncovered", []), str(tmp_path / "none"): ("headerless", [])}


def test_reports_on_words_and_curves(spark):
    rows = spark.createDataFrame([("a b", "x y"), ("a", "x"), ("a c", "x"), ("b", "y"), ("c", "z")], "l string, r string")
    found = {(r["u"], r["s"]): round(r["lift"], 6) for r in analytics.specific_pairs(rows, "l", "r", 1, 0.9).collect()}
    assert found == {("a", "x"): round(5 / 3, 6), ("b", "y"): 2.5}
    same = analytics.substitutions(spark.createDataFrame([("kitab", "kitaab"), ("abc", "xyz")], "u string, s string"), F.col("u"), F.col("s")).collect()
    assert [round(r["similarity"], 3) for r in same] == [0.833, 0.0]
    curve = spark.createDataFrame([(1, 3.0, 1.0), (2, 2.0, 1.0), (3, 1.0, 2.0)], "step int, a double, b double")
    assert [(r["x"], r["from_x"], r["to_x"]) for r in analytics.crossing(curve, "step", "a", "b").collect()] == [(2.5, 2, 3)]
    made = spark.createDataFrame([(1, "one two three four")], "idx bigint, t string")
    corpus, control = docs_of(spark, ["zero one two three four five"]), docs_of(spark, ["one two"])
    assert [(r["n"], r["overlap"], r["control"]) for r in analytics.overlap_against_control(made, corpus, control, "idx", "t", (2, 3)).collect()] == [(2, 1.0, 1 / 3), (3, 1.0, 0.0)]


# the registry


def test_queries_match_their_sql(spark, sf):
    duckdb = pytest.importorskip("duckdb")
    from pathlib import Path

    from waraq.queries import ORACLES, QUERIES

    assert set(ORACLES) <= set(QUERIES)
    con = duckdb.connect()
    for p in Path(sf).glob("*.parquet"):
        con.execute(f"create view {p.stem} as select * from '{p}'")
    plain = lambda v: None if v is None or v != v else round(v, 7) if isinstance(v, float) else v
    for name, sql in ORACLES.items():
        got = QUERIES[name](spark, sf)
        columns = sorted(got.columns)
        ours = sorted((tuple(plain(r[c]) for c in columns) for r in got.collect()), key=repr)
        cursor = con.execute(sql)
        names = [d[0] for d in cursor.description]
        theirs = sorted((tuple(plain(r[names.index(c)]) for c in columns) for r in cursor.fetchall()), key=repr)
        assert ours == theirs, name


def test_entry_runs(spark):
    import __spark_entry__ as entry

    if set(entry.oracle_sql()) - set(entry.queries()):
        pytest.fail("SQL without a query")
    assert entry.entry(spark).count() > 0 and list(itertools.islice(entry.queries(), 1))
