"""DuckDB SQL for the core queries, written independently of the Spark plans."""

from __future__ import annotations

import hashlib
import re
import unicodedata

WS = r"[\t-\r\x1c-\x20\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"
NON = WS.replace("[", "[^", 1)


def canon(t: str) -> str:
    return f"trim(regexp_replace(replace(lower(coalesce({t}, '')), 'ß', 'ss'), '{WS}+', ' ', 'g'))"


def h60(x: str) -> str:
    return f"('0x' || substr(md5({x}), 1, 15))::bigint"


def unit(x: str, salt: str) -> str:
    return f"(('0x' || substr(md5('{salt}|' || {x}), 1, 13))::bigint / 4503599627370496.0)"


def strip(x: str) -> str:
    return f"regexp_replace({x}, '^{WS}+|{WS}+$', '', 'g')"


def shingle_list(t: str, n: int = 5) -> str:
    return f"(select list(distinct array_to_string(w[i:i+{n - 1}], ' ')) from (select w, unnest(range(1, len(w) - {n - 2})) i from (select list_filter(string_split({canon(t)}, ' '), lambda x: x <> '') w)))"


DEDUP = f"k as (select doc_id, source, md5('dedup/c|' || {canon('text')}) h, md5('dedup/k|' || doc_id::varchar) k from documents)"
LINES = f"l as (select distinct doc_id, md5('dedup/k|' || doc_id::varchar) k, line from (select doc_id, {strip('x')} line from (select doc_id, unnest(string_split(coalesce(text, ''), chr(10))) x from documents)) where length(line) >= 60), li as (select line, count(*) n, length(line) c, arg_min(doc_id, k) owner from l group by line)"
SURVIVORS = f"{DEDUP}, sv as (select documents.* from documents join (select doc_id, row_number() over (partition by h order by k) r from k) using (doc_id) where r = 1)"
LINES = f"{SURVIVORS}, {LINES.replace('documents)', 'sv)')}"
ORACLES: dict[str, str] = {
    "exact_dedup_verdicts": f"with {DEDUP} select doc_id, h as content_hash, count(*) over (partition by h) as group_size, row_number() over (partition by h order by k) = 1 as kept from k",
    "exact_dedup_groups": f"with {DEDUP}, g as (select h, count(*) n, arg_min(doc_id, k) kept, array_to_string(list_sort(list(doc_id))[1:4], ',') ids from k group by h having count(*) > 1) select h as content_hash, n as group_size, kept as kept_id, ids as example_ids from g order by n desc, h limit 20",
    "exact_dedup_statistics": f"with {DEDUP}, g as (select count(*) n from k group by h) select sum(n)::bigint as documents, count(*) as distinct_documents, count(*) filter (n > 1) as groups, sum(n - 1)::bigint as duplicates, max(n) as largest_group from g",
    "exact_dedup_cross_source": f"with {DEDUP}, s as (select distinct h, coalesce(source, '') s from k) select a.s as source_a, b.s as source_b, count(*) as groups from s a join s b on a.h = b.h and a.s < b.s group by 1, 2",
    "exact_dedup_removed_by_source": f"with {DEDUP}, f as (select *, row_number() over (partition by h order by k) r, first_value(coalesce(source, '')) over (partition by h order by k) fs from k) select coalesce(source, '') as source, count(*) as documents, count(*) filter (r > 1) as removed, count(*) filter (r > 1 and coalesce(source, '') <> fs) as removed_cross from f group by 1",
    "line_dedup_statistics": f"with {LINES} select count(*) as distinct_lines, count(*) filter (n > 1) as shared_lines, sum(n * c)::bigint as line_chars, coalesce(sum(n * c) filter (n > 1), 0)::bigint as shared_chars, coalesce(sum((n - 1) * c) filter (n > 1), 0)::bigint as removable_chars from li",
    "line_dedup_strip": f"""with {LINES}, d as (select l.doc_id, list(distinct l.line) drops from l join li on l.line = li.line where li.n > 1 and li.owner <> l.doc_id group by 1),
j as (select t.doc_id, coalesce(t.text, '') txt, string_split(coalesce(t.text, ''), chr(10)) raw, coalesce(d.drops, []) drops from sv t left join d using (doc_id)),
m as (select doc_id, txt, raw, list_filter(raw, lambda x: not list_contains(drops, {strip('x')})) kept from j),
e as (select *, len(list_filter(kept, lambda x: {strip('x')} <> '')) = 0 as gone from m)
select doc_id, md5(case when gone then txt else array_to_string(kept, chr(10)) end) as text_md5, (case when gone then 0 else len(raw) - len(kept) end)::int as removed_lines from e""",
    "stable_sample": f"select doc_id, source from documents where {unit('doc_id::varchar', 'sample-1')} < 0.2",
    "lowest_per_source": "select doc_id, source from (select *, row_number() over (partition by source order by md5('limit-1|' || doc_id::varchar), doc_id) r from documents) where r <= 7",
    "union_with_rates": f"select doc_id, source from documents where source = 'forum' or (source = 'news' and {unit('doc_id::varchar', 'union-1')} < 0.5)",
    "epoch_order": "select doc_id, md5('3|1|' || doc_id::varchar) as rank_key from documents",
    "task_mixture": f"select case when u < 0.65 then 'lm' when u < 0.75 then 'infill' when u < 0.85 then 'pair' when u < 0.93 then 'restore' else 'switch' end as task, count(*) as documents from (select {unit('doc_id::varchar', 'tasks-1')} u from documents) group by 1",
}


def _image(b: int) -> str:
    try:
        return bytes([b]).decode("cp1252")
    except UnicodeDecodeError:
        return chr(b)


def _class(a: int, b: int) -> str:
    return "[" + "".join(f"\\x{{{ord(_image(x)):X}}}" for x in range(a, b + 1)) + "]"


_C = _class(0x80, 0xBF)
_MOJIBAKE = f"(?:{_class(0xC2, 0xDF)}{_C}|{_class(0xE0, 0xEF)}{_C}{_C}|{_class(0xF0, 0xF4)}{_C}{_C}{_C})"
ORACLES["encoding_rates"] = rf"select doc_id, coalesce(list_sum(list_transform(regexp_extract_all(coalesce(text, ''), '{_MOJIBAKE}'), lambda x: length(x))), 0)::int as mojibake_chars, len(regexp_extract_all(coalesce(text, ''), '\x{{FFFD}}'))::int as replacement_chars, len(regexp_extract_all(coalesce(text, ''), '[\x00-\x08\x0E-\x1F\x7F-\x{{9F}}]'))::int as control_chars from documents"

_ARABIC = r"\x{600}-\x{6FF}\x{750}-\x{77F}\x{870}-\x{89F}\x{8A0}-\x{8FF}\x{FB50}-\x{FDFF}\x{FE70}-\x{FEFF}"
_LATIN = r"\x{41}-\x{5A}\x{61}-\x{7A}\x{C0}-\x{24F}\x{1E00}-\x{1EFF}"
_SCRIPTS = rf"""l as (select doc_id, coalesce(text, '') t, regexp_extract_all(coalesce(text, ''), '\p{{L}}') ls from documents),
s as (select doc_id, t, len(list_filter(ls, lambda x: regexp_matches(x, '[{_ARABIC}]'))) arabic, len(list_filter(ls, lambda x: regexp_matches(x, '[{_LATIN}]'))) latin, len(list_filter(ls, lambda x: regexp_matches(x, '[\x{{900}}-\x{{97F}}]'))) devanagari, len(ls) n,
len(list_filter(regexp_extract_all(t, '[\x{{10000}}-\x{{10FFFF}}]'), lambda x: not regexp_matches(x, '\p{{L}}'))) beyond from l)"""
ORACLES["script_counts"] = f"with {_SCRIPTS} select doc_id, arabic::int as arabic, latin::int as latin, devanagari::int as devanagari, (n - arabic - latin - devanagari + beyond)::int as other, (n + beyond)::int as letters from s"


def _roman() -> str:
    """rl(ru, en): words of Roman Urdu by the labelled samples without English ones, and English ones without these."""
    from waraq.operators import scripts as S

    english = "[" + ", ".join(f"'{w}'" for w in sorted(set(S.ENGLISH_WORDS.split()))) + "]"
    return f"""rs as (select label, unnest(regexp_extract_all(lower(text), '[a-z][a-z'']*')) w from label_samples where text is not null and label in ('roman_urdu', 'english', 'other')),
rn as (select w, count(*) filter (label = 'roman_urdu') a, count(*) filter (label = 'english') b, count(*) filter (label = 'other') c from rs group by 1), rt as (select sum(a) ta, sum(b) tb, sum(c) tc from rn),
rw as (select w from rn, rt where a >= 2 and a * tb >= 8 * b * ta and a * tc >= 8 * c * ta), rl as (select list_filter(ws, lambda w: not list_contains({english}, w)) ru, list_filter({english}, lambda w: not list_contains(ws, w)) en from (select list(w) ws from rw))"""


_SHARE = "coalesce(len(list_filter(low, lambda w: list_contains({0}, w))) / nullif(len(low), 0)::double, 0.0)"


def _language_scores() -> str:
    from waraq.operators import scripts as S

    listed = lambda ws: "[" + ", ".join("'" + w.replace("'", "''") + "'" for w in ws) + "]"
    p = S.URDU_PROFILE
    share = lambda ws, words: f"coalesce(len(list_filter({words}, lambda w: list_contains({listed(ws)}, w))) / nullif(len({words}), 0)::double, 0.0)"
    count = lambda cs: f"(length(t) - length(translate(t, '{cs}', '')))"
    return rf"""with {_roman()}, {_SCRIPTS}, w as (select doc_id, t, n + beyond as letters, regexp_extract_all(t, '[\x{{600}}-\x{{6FF}}\x{{750}}-\x{{77F}}\x{{8A0}}-\x{{8FF}}]+') aw, regexp_extract_all(t, '[A-Za-z][A-Za-z'']*') lw, list_transform(regexp_extract_all(t, '[A-Za-z][A-Za-z'']*'), lambda x: lower(x)) low from s)
select doc_id, round(case when len(aw) = 0 then 0.0 else {share(p.urdu, 'aw')} + 4.0 * coalesce({count(S.URDU_LETTERS)} / nullif(letters, 0)::double, 0.0) end, 9) as urdu,
round({share(p.persian, 'aw')}, 9) as persian,
round(case when len(aw) = 0 then 0.0 else {share(p.arabic, 'aw')} + 2.0 * coalesce({count(S.ARABIC_LETTERS)} / nullif(letters, 0)::double, 0.0) end, 9) as arabic,
round({_SHARE.format('ru')}, 9) as roman_urdu, round({_SHARE.format('en')}, 9) as english,
round(coalesce(len(list_filter(lw, lambda x: length(x) > 1 and x = lower(x))) / nullif(len(lw), 0)::double, 0.0), 9) as lowercase from w, rl"""


ORACLES["language_scores"] = _language_scores()


def _normalize() -> str:
    from waraq.operators import normalize as N

    forms = {chr(c): unicodedata.normalize("NFKC", chr(c)) for a, b in ((0xFB50, 0xFDFF), (0xFE70, 0xFEFC)) for c in range(a, b + 1)}
    one = {c: x for c, x in forms.items() if len(x) == 1 and x != c}
    more = {c: x for c, x in forms.items() if len(x) > 1}
    pairs = ", ".join(f"'{c}': '{x}'" for c, x in more.items())
    source = "".join(s for s, _ in N.FOLDS.values()) + N.DIGITS[0]
    image = "".join(x * len(s) for s, x in N.FOLDS.values()) + N.DIGITS[1]
    gone = "".join(N.DELETIONS.values())
    return rf"""with m as (select map {{{pairs}}} m), a as (select doc_id, coalesce(text, '') t, translate(coalesce(text, ''), '{"".join(one)}', '{"".join(one.values())}') x from documents),
b as (select doc_id, t, case when regexp_matches(x, '[\x{{FB50}}-\x{{FDFF}}\x{{FE70}}-\x{{FEFC}}]') then array_to_string(list_transform(string_split(x, ''), lambda c: coalesce(m[c], c)), '') else x end x from a, m),
c as (select doc_id, t, translate(x, '{source}{gone}', '{image}') x from b),
d as (select doc_id, t, regexp_replace(regexp_replace(x, '\r\n|[\r\x0b\x0c\x{{85}}\x{{2028}}\x{{2029}}]', chr(10), 'g'), '[\t \x{{A0}}\x{{1680}}\x{{2000}}-\x{{200A}}\x{{202F}}\x{{205F}}\x{{3000}}]+', ' ', 'g') x from c),
e as (select doc_id, t, regexp_replace(regexp_replace(regexp_replace(x, ' ?\n ?', chr(10), 'g'), '\n{{3,}}', chr(10) || chr(10), 'g'), '^[\n ]+|[\n ]+$', '', 'g') x from d)
select doc_id, md5(x) as text_md5, length(t)::int as chars_in, length(x)::int as chars_out from e"""


ORACLES["normalize_text"] = _normalize()

_TOP, _DUP = (3, 4), (5, 6, 7, 8, 9, 10)


def _quality() -> str:
    matched = lambda p: f"coalesce(list_sum(list_transform(regexp_extract_all(t, '{p}'), lambda x: length(x))), 0)"
    url = r"(?:[hH][tT][tT][pP][sS]?://|[wW][wW][wW]\.)[^\s<>\"''،؛)\]}]+"
    tag = r"</?[A-Za-z][A-Za-z0-9]*(?:\s[^<>]{0,200})?/?>"
    entity = r"&(?:[A-Za-z][A-Za-z0-9]{1,31}|#\d{1,7}|#[Xx][0-9A-Fa-f]{1,6});"
    parts = [
        "b as (select doc_id, coalesce(text, '') t, length(coalesce(text, '')) chars from documents)",
        f"ln as (select doc_id, x, count(*) over (partition by doc_id, x) k from (select doc_id, {strip('y')} x from (select doc_id, unnest(regexp_split_to_array(t, '[\\r\\n]+')) y from b)) where x <> '')",
        "dl as (select doc_id, coalesce(sum(length(x)) filter (k > 1), 0) / sum(length(x))::double v from ln group by 1)",
        f"pp as (select doc_id, unnest(ps) p, generate_subscripts(ps, 1) i from (select doc_id, regexp_extract_all(t, '{NON}+|{WS}+') ps from b))",
        f"oo as (select *, sum(length(p)) over (partition by doc_id order by i) e from pp)",
        f"tk as (select doc_id, lower(p) w, e - length(p) st, e en, row_number() over (partition by doc_id order by i) r from oo where regexp_matches(p, '{NON}'))",
        "wc as (select doc_id, count(*) n from tk group by 1)",
    ]
    select = ["b.doc_id", "b.chars::int as chars", "coalesce(wc.n, 0)::int as words", f"round(case when b.chars > 0 then {matched(url)} / b.chars::double else 0.0 end, 9) as url_ratio", f"round(case when b.chars > 0 then ({matched(tag)} + {matched(entity)}) / b.chars::double else 0.0 end, 9) as html_ratio", r"round(case when b.chars > 0 then len(regexp_extract_all(t, '\x{FFFD}')) / b.chars::double else 0.0 end, 9) as replacement_rate", "round(coalesce(dl.v, 0.0), 9) as dup_line_ratio"]
    joins = ["b", "left join wc using (doc_id)", "left join dl using (doc_id)"]
    for n in _TOP + _DUP:
        ws = " || ' ' || ".join("w" if k == 0 else f"lead(w, {k}) over o" for k in range(n))
        parts.append(f"g{n} as (select doc_id, g, st, en, r, count(*) over (partition by doc_id, g) k from (select doc_id, {ws} g, st, lead(en, {n - 1}) over o en, r from tk window o as (partition by doc_id order by r)) where g is not null)")
        if n in _TOP:
            parts.append(f"t{n} as (select doc_id, arg_min(k * length(g), (-k, r)) v, max(k) k from g{n} group by 1)")
            select.append(f"round(case when t{n}.k > 1 then least(t{n}.v / b.chars::double, 1.0) else 0.0 end, 9) as top_{n}gram")
            joins.append(f"left join t{n} using (doc_id)")
        else:
            parts.append(f"m{n} as (select doc_id, st, en, max(en) over (partition by doc_id order by r rows between unbounded preceding and 1 preceding) pm from g{n} where k > 1)")
            parts.append(f"u{n} as (select doc_id, sum(greatest(0, en - greatest(st, coalesce(pm, -1)))) v from m{n} group by 1)")
            select.append(f"round(coalesce(u{n}.v / b.chars::double, 0.0), 9) as dup_{n}gram")
            joins.append(f"left join u{n} using (doc_id)")
    return "with " + ",\n".join(parts) + "\nselect " + ", ".join(select) + " from " + " ".join(joins)


ORACLES["quality_metrics"] = _quality()
_RULES = [("too_short", "chars < 400 or words < 40"), ("repetition:dup_lines", "dup_line_ratio > 0.5"), ("repetition:top_3gram", "top_3gram > 0.26"), ("repetition:top_4gram", "top_4gram > 0.22"), *((f"repetition:dup_{n}gram", f"dup_{n}gram > {x}") for n, x in zip(_DUP, (0.60, 0.58, 0.56, 0.54, 0.52, 0.50))), ("url_density", "url_ratio > 0.3"), ("html_residue", "html_ratio > 0.1"), ("replacement_chars", "replacement_rate > 0.001")]
_REASONS = "list_filter([" + ", ".join(f"case when {c} then '{r}' end" for r, c in _RULES) + "], lambda x: x is not null)"
ORACLES["quality_verdicts"] = f"select doc_id, array_to_string({_REASONS}, ',') as reasons, len({_REASONS}) = 0 as kept from ({ORACLES['quality_metrics']})"
ORACLES["quality_family_counts"] = f"with f as (select list_distinct(list_transform({_REASONS}, lambda x: split_part(x, ':', 1))) fs from ({ORACLES['quality_metrics']})) select family, count(*) as fired, count(*) filter (alone) as sole from (select unnest(fs) family, len(fs) = 1 alone from f) group by 1"
ORACLES["quality_percentiles"] = f"with q as ({ORACLES['quality_metrics']}), m as (select 'chars' metric, chars::double v from q union all select 'words', words::double from q union all select 'dup_line_ratio', dup_line_ratio from q union all select 'top_3gram', top_3gram from q), r as (select metric, v, row_number() over (partition by metric order by v) - 1 i, count(*) over (partition by metric) n from m), p as (select unnest([0.01, 0.05, 0.25, 0.5, 0.75, 0.95, 0.99])::double point) select metric, point, v as value from r, p where i = least(floor(point * n), n - 1)"
ORACLES["quality_agreement"] = "select filter_verdict as verdict, human_verdict as mark, count(*) as n from (select distinct record_id, filter_verdict, human_verdict from quality_validation) where filter_verdict is not null and human_verdict is not null group by 1, 2"

_EMAIL = r"[A-Za-z0-9._%+\-]{1,64}@(?:[A-Za-z0-9](?:[A-Za-z0-9\-]{0,61}[A-Za-z0-9])?\.){1,4}[A-Za-z]{2,24}"
ORACLES["pii_emails"] = f"select doc_id, len(regexp_extract_all(coalesce(text, ''), '{_EMAIL}'))::int as n, md5(regexp_replace(coalesce(text, ''), '{_EMAIL}', '[@]', 'g')) as text_md5 from documents"
ORACLES["pii_shapes"] = rf"with m as (select unnest(regexp_extract_all(text, '{_EMAIL}')) m from (select distinct result_id, text from pii_results) where text is not null), s as (select substr(regexp_replace(regexp_replace(m, '\p{{L}}', 'x', 'g'), '\p{{Nd}}', 'd', 'g'), 1, 40) shape from m) select shape, count(*) as n from s group by 1 order by 2 desc, 1 limit 200"

_SH = f"sh as (select doc_id, {shingle_list('text')} ss from documents)"
ORACLES["shingle_counts"] = f"with {_SH} select doc_id, coalesce(len(ss), 0)::int as n_shingles, (coalesce(list_sum(list_transform(ss, lambda x: {h60('x')}::hugeint)), 0) % 1000000007)::bigint as checksum from sh"


def _minhash(k: int = 128) -> str:
    order = ", ".join(f"({b}, {p}, {r})" for b in range(k) for r, p in enumerate(sorted((p for p in range(k) if p != b), key=lambda p: hashlib.md5(f"0|{b}|{p}".encode()).hexdigest())))
    return f"""{_SH}, hs as (select doc_id, len(ss) n, unnest(ss) s from sh where len(ss) >= 8),
hb as (select doc_id, n, {h60('s')} h from hs), bn as (select doc_id, n, h % {k} bin, min((h // {k}) % 4294967296) v from hb group by 1, 2, 3),
pr(bin, p, r) as (values {order}), dd as (select distinct doc_id, n from bn), al as (select doc_id, n, unnest(range({k})) bin from dd),
em as (select al.doc_id, al.n, al.bin from al anti join bn on al.doc_id = bn.doc_id and al.bin = bn.bin),
fl as (select em.doc_id, em.n, em.bin, arg_min(bn.v, pr.r) v from em join pr on pr.bin = em.bin join bn on bn.doc_id = em.doc_id and bn.bin = pr.p group by 1, 2, 3),
sk as (select doc_id, n, list(v order by bin) bins from (select * from bn union all select * from fl) group by 1, 2)"""


_MINHASH = _minhash()
ORACLES["minhash_sketches"] = f"with {_MINHASH} select doc_id, n::int as n_shingles, md5(array_to_string(bins, ',')) as bins_md5 from sk"
_PAIRS = f"""{_MINHASH}, ky as (select doc_id, md5('near/k|' || doc_id::varchar) k, bins from sk), bk as (select k, md5(i::varchar || '|' || array_to_string(bins[i*4+1:i*4+4], ',')) b from (select *, unnest(range(32)) i from ky)),
an as (select b, min(k) a from bk group by 1), cp as (select distinct an.a, bk.k b from bk join an using (b) where bk.k <> an.a),
ps as (select cp.a, cp.b, len(list_filter(list_zip(x.bins, y.bins), lambda z: z[1] = z[2])) / 128.0::double similarity from cp join ky x on x.k = cp.a join ky y on y.k = cp.b), rt as (select * from ps where similarity >= 0.5)"""
ORACLES["minhash_pairs"] = f"with {_PAIRS} select a, b, similarity from rt"
ORACLES["near_dup_histogram"] = f"with {_PAIRS} select least(floor(similarity * 20 + 1e-9), 19)::int as band, count(*) as pairs from rt group by 1"
_CLUSTERS = _PAIRS.replace("sh as", "sh as", 1) + ", ed as (select a, b from rt where similarity >= 0.8 union select b, a from rt where similarity >= 0.8), rc as (select a node, b other from ed union select rc.node, ed.b from rc join ed on rc.other = ed.a), rr as (select node, least(node, min(other)) root from rc group by 1)"
ORACLES["near_dup_verdicts"] = f"with recursive {_CLUSTERS}, cl as (select ky.doc_id, ky.k, coalesce(rr.root, ky.k) c from ky left join rr on rr.node = ky.k), sz as (select *, count(*) over (partition by c) n from cl) select d.doc_id, coalesce(sz.k = sz.c, true) as kept, case when sz.k is null then 'too_few_shingles' when sz.k = sz.c then 'unique' else 'near_duplicate' end as reason, coalesce(sz.n, 1) as cluster_size from documents d left join sz using (doc_id)"

_TRAINED = "documents as (select distinct doc_id, doc as text, 'documents' as source from probe_decon_rup_survivors union select 'pair:' || pair_id, eval, 'pairs' from probe_decon_rup_survivors where eval is not null union all select item_id, text, 'items' from eval_items)"


def char_list(t: str, n: int = 5) -> str:
    return f"(select list(distinct s[i:i+{n - 1}]) from (select s, unnest(range(1, length(s) - {n - 2})) i from (select {canon(t)} s)))"


def _decon(shingled=shingle_list, least: int = 8) -> str:
    return f"""sh as (select doc_id::varchar doc_id, {shingled('text')} ss from documents where text <> ''), eh as (select item_id, {shingled('text')} ss from eval_items), es as (select item_id, len(ss) m, unnest(ss) s from eh where len(ss) >= {least}), ds as (select doc_id, len(ss) n, unnest(ss) s from sh), ct as (select doc_id, item_id, n, m, count(*) shared from ds join es using (s) where doc_id <> item_id group by all)"""


_DECON = _decon()
_CONTAINED = "select doc_id, item_id, shared, round(shared / m::double, 9) as containment, round(shared / (m + n - shared)::double, 9) as jaccard from ct where shared / m::double >= "
ORACLES["decontaminate_containments"] = f"with {_TRAINED}, {_DECON} {_CONTAINED} 0.2"
ORACLES["decontaminate_char_containments"] = f"with {_TRAINED}, {_decon(char_list, 25)} {_CONTAINED} 0.8"


def _long(t: str) -> str:
    return f"list_distinct(list_transform(list_filter(list_transform(string_split(coalesce({t}, ''), chr(10)), lambda x: {strip('x')}), lambda x: length(x) >= 40), lambda x: md5({canon('x')})))"


_EXACT = f"""xd as (select distinct d.doc_id::varchar doc_id, e.item_id from documents d join eval_items e on md5({canon('d.text')}) = md5({canon('e.text')}) where {canon('e.text')} <> '' and d.doc_id::varchar <> e.item_id),
dl as (select doc_id::varchar doc_id, unnest({_long('text')}) h from documents), el as (select item_id, unnest({_long('text')}) h from eval_items), xl as (select distinct doc_id, item_id from dl join el using (h) where doc_id <> item_id)"""
ORACLES["decontaminate_exact_documents"] = f"with {_TRAINED}, {_EXACT} select doc_id, item_id from xd"
ORACLES["decontaminate_exact_lines"] = f"with {_TRAINED}, {_EXACT} select doc_id, item_id from xl"


_HITS = f"{_TRAINED}, {_DECON}, {_EXACT}, ht as (select doc_id, item_id, 0 r, 1.0::double c from xd union all select doc_id, item_id, 1, 1.0 from xl union all select doc_id, item_id, 2, shared / m::double from ct where shared / m::double >= 0.5)"
_VERDICT = "b as (select *, row_number() over (partition by doc_id order by r, -c, item_id) k from ht where r < 2 or c >= {0}) select doc_id, case r when 0 then 'exact_document' when 1 then 'exact_line' else 'containment' end as reason, item_id, round(c, 9) as containment from b where k = 1"
ORACLES["decontaminate_verdicts"] = f"with {_HITS}, {_VERDICT.format(0.8)}"
ORACLES["decontaminate_coverage"] = f"with {_HITS}, o as (select distinct item_id from ht where r < 2 or c >= 0.8) select eval_set, count(*) as items, count(o.item_id) as found from eval_items left join o using (item_id) group by 1"
ORACLES["decontaminate_sweep"] = f"with {_HITS}, t as (select unnest([0.5, 0.7, 0.8, 0.9])::double threshold) select threshold, count(distinct doc_id) as documents, count(distinct item_id) as items from ht, t where r < 2 or c >= threshold group by 1"
# each set under its own specification: words for the quiz, characters for sentences
_BY_SET = f"""{_TRAINED}, {_EXACT}, {_decon()}, {re.sub(r'\b(sh|eh|es|ds|ct)\b', r'c\1', _decon(char_list, 25))},
hs as (select doc_id, item_id, 'exact_document' reason from xd union all select doc_id, item_id, 'exact_line' from xl
union all select doc_id, item_id, 'containment' from ct join eval_items using (item_id) where eval_set = 'reading-quiz' and shared / m::double >= 0.6
union all select doc_id, item_id, 'containment' from cct join eval_items using (item_id) where eval_set <> 'reading-quiz' and shared / m::double >= 0.9)"""
ORACLES["decontaminate_report"] = f"""with {_BY_SET}, j as (select hs.*, eval_set, source from hs join eval_items using (item_id) left join (select distinct doc_id, source from documents) using (doc_id))
select 'reason' as "by", reason as name, count(distinct doc_id) as documents, count(distinct item_id) as items from j group by reason union all select 'set', eval_set, count(distinct doc_id), count(distinct item_id) from j group by eval_set union all select 'source', source, count(distinct doc_id), count(distinct item_id) from j group by source"""
ORACLES["decontaminate_removals"] = f"with {_BY_SET} select distinct split_part(doc_id, '#', 1) as doc_id from hs"

_BUCKET = "(('0x' || substr(md5('splits-1|' || split_part(doc_id::varchar, '#', 1)), 1, 15))::bigint % 100000)"
_HIST = f"po as (select doc_id, lang population, n_chars chars, strlen(coalesce(text, '')) n_tokens, {_BUCKET} bucket from documents), hi as (select population, bucket, sum(coalesce(chars, 0))::bigint chars from po where population is not null group by 1, 2)"
_BANDS = f"""{_HIST}, dn as (select population, unnest(range(100000)) bucket from (select distinct population from hi)), fu as (select dn.population, dn.bucket, coalesce(hi.chars, 0) chars from dn left join hi using (population, bucket)),
tt as (select population, sum(chars) t from fu group by 1), cu as (select fu.*, t, sum(chars) over (partition by population order by bucket desc) above, sum(chars) over (partition by population order by bucket) below from fu join tt using (population)),
te as (select population, coalesce(max(bucket + 1) filter (above > floor(t * 0.02)), 0) test_from from cu group by 1), th as (select population, test_from, coalesce(sum(chars) filter (bucket >= test_from), 0) held from cu join te using (population) group by 1, 2),
bd as (select population, test_from, coalesce(max(bucket + 1) filter (bucket < test_from and above - held > floor(t * 0.02)), 0) validation_from, coalesce(min(bucket) filter (below > floor(t * 0.05)), 100000) a, coalesce(min(bucket) filter (below > floor(t * 0.2)), 100000) b from cu join th using (population) group by 1, 2)"""
ORACLES["split_histogram"] = f"with {_HIST} select population, bucket, chars from hi"
ORACLES["split_bands"] = f"with {_BANDS} select population, validation_from, test_from, least(a, validation_from) as arm_A, least(b, validation_from) as arm_B from bd"
_ASSIGN = f"{_BANDS}, ag as (select po.*, case when bd.test_from is null then 'unassigned' when bucket >= test_from then 'test' when bucket >= validation_from then 'validation' else 'train' end split_name, bucket < least(a, validation_from) in_a, bucket < least(b, validation_from) in_b from po left join bd using (population)), am as (select *, case when split_name = 'train' then list_filter([case when in_a then 'A' end, case when in_b then 'B' end], lambda x: x is not null) else [] end arms from ag)"
ORACLES["split_assignment"] = f"with {_ASSIGN} select doc_id, bucket, split_name, array_to_string(arms, ',') as arms from am"
ORACLES["split_summary"] = f"with {_ASSIGN} select coalesce(population, '') as population, split_name, arm, count(*) as documents, coalesce(sum(chars), 0)::bigint as chars from (select *, unnest(list_concat(['all'], arms)) arm from am) group by 1, 2, 3"
_PACK = f"{_ASSIGN}, st as (select doc_id, n_tokens, concat_ws('/', population, split_name, case when arm <> '' then arm end) stream from (select *, unnest(case when split_name = 'train' then arms else [''] end) arm from am where split_name <> 'unassigned')), pl as (select *, n_tokens + 1 n, coalesce(sum(n_tokens + 1) over (partition by stream order by md5('packing-1|' || doc_id::varchar), doc_id rows between unbounded preceding and 1 preceding), 0)::bigint place from st where n_tokens > 0)"
ORACLES["pack_streams"] = f"with {_PACK} select stream, count(*) as documents, sum(n)::bigint as tokens, (sum(n) // 512)::bigint as sequences, (sum(n) % 512)::bigint as dropped_tokens from pl group by 1"
ORACLES["pack_sequences"] = f"""with {_PACK}, tl as (select stream, sum(n) // 512 whole from pl group by 1), ex as (select pl.*, unnest(range(place // 512, (place + n - 1) // 512 + 1)) seq from pl),
lh as (select *, greatest(seq * 512 - place, 0) lo, least((seq + 1) * 512 - place, n) hi from ex)
select lh.stream, seq, count(*) as documents, count(*) filter (hi = n) as separators, sum(n_tokens * hi // n - n_tokens * lo // n)::bigint as text_bytes from lh join tl using (stream) where seq < tl.whole group by 1, 2"""
ORACLES["pack_verify"] = f"with {_PACK} select sum(x)::bigint as sequences, 0::bigint as wrong_length, 0::bigint as out_of_range from (select sum(n) // 512 x from pl group by stream)"
ORACLES["exclusions_apply"] = f"with {DEDUP} select doc_id from (select doc_id, row_number() over (partition by h order by k) r from k) where r = 1"
ORACLES["exclusions_report"] = f"with {DEDUP}, x as (select doc_id::varchar id from (select doc_id, row_number() over (partition by h order by k) r from k) where r > 1 union select item_id from eval_items), d as (select distinct doc_id::varchar id from documents) select count(*) as listed, count(d.id) as hits, count(*) - count(d.id) as unapplied from x left join d using (id)"
ORACLES["domain_rates"] = r"with h as (select regexp_replace(regexp_extract(lower(url), '^[a-z]+://([^/:?#]+)', 1), '^www\.', '') host, length(coalesce(text, '')) c, len(regexp_extract_all(coalesce(text, ''), '[يك]')) k from documents where url is not null) select host, count(*) as documents, sum(c)::bigint as chars, sum(k)::bigint as hits, round(1000 * sum(k) / sum(c)::double, 9) as per_kchar from h where host <> '' group by 1 having count(*) >= 5 and sum(c) >= 2000"
_SKEL = r"list_filter(regexp_extract_all(regexp_replace(coalesce({t}, ''), '\p{{M}}+', '', 'g'), '\p{{L}}+'), lambda w: regexp_matches(w, '[\x{{600}}-\x{{6FF}}\x{{750}}-\x{{77F}}\x{{FB50}}-\x{{FDFF}}\x{{FE70}}-\x{{FEFF}}]'))"
_LEX = f"lx as (select word, count(*) n from (select unnest({_SKEL.format(t='text')}) word from documents) group by 1 having count(*) >= 2)"
ORACLES["lexicon_counts"] = f"with {_LEX} select word, n from lx"
ORACLES["lexicon_unknown_rate"] = f"with {_LEX}, m as (select idx, unnest({_SKEL.format(t='ar_text')}) word from (select distinct idx, ar_text from demo_pairs)) select idx, count(*) as words, count(*) filter (lx.word is null) as unknown from m left join lx using (word) group by 1"
_TOK = f"regexp_extract_all(coalesce({{t}}, ''), '{NON.replace('{', '{{').replace('}', '}}')}+')"


def _grams(w: str, n: int) -> str:
    return f"list_transform(range(1, len({w}) - {n - 2}), lambda i: array_to_string({w}[i:i+{n - 1}], ' '))"


_D = lambda n: f"coalesce(len(list_distinct({_grams('w', n)})) / nullif(len({_grams('w', n)}), 0)::double, 0.0)"
ORACLES["generation_statistics"] = f"with w as (select idx, {_TOK.format(t='ar_text')} w from (select distinct idx, ar_text from demo_pairs)) select idx, len(w)::int as n_words, " + ", ".join(f"round({_D(n)}, 9) as distinct_{n}" for n in range(1, 5)) + f", round(case when len(w) >= 4 then 1 - {_D(4)} else 0.0 end, 9) as repetition from w"
ORACLES["prefix_echo"] = f"with w as (select idx, {_TOK.format(t='prefix')} p, {_TOK.format(t='diff_text')} w from (select distinct idx, prefix, diff_text from demo_pairs)) select idx, round(coalesce(len(list_filter({_grams('w', 2)}, lambda g: list_contains({_grams('p', 2)}, g))) / nullif(len({_grams('w', 2)}), 0)::double, 0.0), 9) as echo from w"
ORACLES["cooccurrence"] = f"with r as (select distinct idx, ar_text, diff_text from demo_pairs), w as (select row_number() over () i, list_distinct({_TOK.format(t='lower(ar_text)')}) us, list_distinct({_TOK.format(t='lower(diff_text)')}) ss from r), u as (select i, unnest(us) u from w), s as (select i, unnest(ss) s from w), nu as (select u, count(*) n from u group by 1 having count(*) >= 20), b as (select u, s, count(*) n from u join s using (i) group by 1, 2 having count(*) >= 20) select b.u, b.s, b.n, round(b.n / nu.n::double, 9) as p from b join nu using (u)"
ORACLES["ngram_overlap"] = f"with m as (select idx, unnest({_grams('w', 5)}) g from (select idx, {_TOK.format(t='lower(ar_text)')} w from (select distinct idx, ar_text from demo_pairs))), c as (select distinct unnest({_grams('w', 5)}) g from (select {_TOK.format(t='lower(text)')} w from documents)) select idx, count(*) as grams, round(count(c.g) / count(*)::double, 9) as overlap from m left join c using (g) group by 1"
ORACLES["latest_assignment"] = "select doc_id, population, split_name from (select *, row_number() over (partition by doc_id order by written_ts desc) r from (select distinct doc_id, population, split_name, written_ts from split_assignments)) where r = 1"
ORACLES["fetch_plan"] = "select path, upto from (select source path, sum((target_share * 1000)::bigint) over (order by max_repeats, source)::bigint upto from mix_targets) where upto <= 600"
ORACLES["tokenizer_sample"] = "select doc_id, lang as population from (select *, coalesce(sum(n_chars) over (partition by lang order by md5('tokenizer-1|' || doc_id::varchar), doc_id rows between unbounded preceding and 1 preceding), 0) before, sum(n_chars) over (partition by lang) t from documents where lang is not null) where before < t * 0.1"
ORACLES["near_dup_config"] = "select i / 10.0::double as similarity, round(1 - pow(1 - pow(i / 10.0::double, 4), 32), 9) as probability from range(1, 11) x(i)"

ORACLES["exact_jaccard_pairs"] = f"with {_PAIRS}, nm as (select least(x.doc_id, y.doc_id) a, greatest(x.doc_id, y.doc_id) b from rt join ky x on x.k = rt.a join ky y on y.k = rt.b), ij as (select a, b, len(p.ss) m, len(q.ss) n, len(list_intersect(p.ss, q.ss)) i from nm join sh p on p.doc_id = a join sh q on q.doc_id = b) select a, b, round(i / (m + n - i)::double, 9) as jaccard, round(i / least(m, n)::double, 9) as containment from ij"
ORACLES["near_dup_pair_examples"] = f"with {_PAIRS}, bn2 as (select *, least(floor(similarity * 20 + 1e-9), 19)::int band from rt) select a, b, similarity, band from (select *, row_number() over (partition by band order by md5('examples|' || a || '|' || b), a || '|' || b) r from bn2) where r <= 3"
ORACLES["near_dup_cross_source"] = f"with recursive {_CLUSTERS.replace('similarity >= 0.8', 'similarity >= 0.5')}, cl as (select ky.doc_id, coalesce(rr.root, ky.k) c from ky left join rr on rr.node = ky.k), cs as (select distinct c, coalesce(source, '') s from cl join documents using (doc_id)) select p.s as source_a, q.s as source_b, count(*) as clusters from cs p join cs q on p.c = q.c and p.s < q.s group by 1, 2"
ORACLES["char_shingle_counts"] = f"with c as (select item_id, {canon('text')} t from eval_items) select item_id, coalesce(len((select list(distinct substr(t, i::int, 5)) from (select unnest(range(1, length(t) - 3)) i))), 0)::int as n_shingles from c"
ORACLES["decontaminate_histogram"] = f"with {_TRAINED}, {_DECON} select case when shared >= m then '1.00' else printf('%.1f', floor(shared / m::double * 10 + 1e-9) / 10) end as band, count(*) as hits from ct group by 1"
ORACLES["decontaminate_unmeasurable"] = f"select item_id, coalesce(len(ss), 0)::int as n_shingles from (select item_id, {shingle_list('text')} ss from eval_items) where coalesce(len(ss), 0) < 40"
ORACLES["byte_fertility"] = f"select source, count(*) as documents, sum(b)::bigint as tokens, round(coalesce(sum(c) / nullif(sum(b), 0)::double, 0.0), 9) as chars_per_token, round(coalesce(sum(b) / nullif(sum(b), 0)::double, 0.0), 9) as bytes_per_token, round(coalesce(sum(b) / nullif(sum(w), 0)::double, 0.0), 9) as tokens_per_word from (select source, strlen(coalesce(text, '')) b, length(coalesce(text, '')) c, len({_TOK.format(t='text')}) w from documents) group by 1"
ORACLES["draw_summary"] = "select ar_forwards, count(*) as n, round(avg(ar_secs), 6) as mean, round(coalesce(stddev_samp(ar_secs), 0.0), 6) as sd, round(coalesce(stddev_samp(ar_secs), 0.0) / sqrt(count(*)), 6) as sem, round(min(ar_secs), 6) as least, round(max(ar_secs), 6) as most from (select distinct idx, ar_forwards, ar_secs from demo_pairs) where ar_secs is not null group by 1"


def _spans(source: str, name: str) -> str:
    """CTEs that end in {name}(id, letters, minor, label): the label of each span (id, t) of a relation."""
    from waraq.operators import scripts as S

    listed = lambda ws: "[" + ", ".join("'" + w.replace("'", "''") + "'" for w in ws) + "]"
    p, n = S.URDU_PROFILE, name
    share = lambda ws, words: f"coalesce(len(list_filter({words}, lambda w: list_contains({listed(ws)}, w))) / nullif(len({words}), 0)::double, 0.0)"
    count = lambda cs: f"(length(t) - length(translate(t, '{cs}', '')))"
    return rf"""{n}a as (select id, t, regexp_extract_all(t, '\p{{L}}') ls from {source}),
{n}b as (select id, t, len(list_filter(ls, lambda x: regexp_matches(x, '[{_ARABIC}]'))) ar, len(list_filter(ls, lambda x: regexp_matches(x, '[{_LATIN}]'))) la, len(list_filter(ls, lambda x: regexp_matches(x, '[\x{{900}}-\x{{97F}}]'))) de, len(ls) + len(list_filter(regexp_extract_all(t, '[\x{{10000}}-\x{{10FFFF}}]'), lambda x: not regexp_matches(x, '\p{{L}}'))) letters,
regexp_extract_all(t, '[\x{{600}}-\x{{6FF}}\x{{750}}-\x{{77F}}\x{{8A0}}-\x{{8FF}}]+') aw, regexp_extract_all(t, '[A-Za-z][A-Za-z'']*') lw, list_transform(regexp_extract_all(t, '[A-Za-z][A-Za-z'']*'), lambda x: lower(x)) low from {n}a),
{n}c as (select id, letters, ar / letters::double ar, la / letters::double la, de / letters::double de, (letters - ar - la - de) / letters::double ot,
case when len(aw) = 0 then 0.0 else {share(p.urdu, 'aw')} + 4.0 * {count(S.URDU_LETTERS)} / letters::double end u, {share(p.persian, 'aw')} pe, case when len(aw) = 0 then 0.0 else {share(p.arabic, 'aw')} + 2.0 * {count(S.ARABIC_LETTERS)} / letters::double end ab,
{_SHARE.format('ru')} ro, {_SHARE.format('en')} en, coalesce(len(list_filter(lw, lambda x: length(x) > 1 and x = lower(x))) / nullif(len(lw), 0)::double, 0.0) lc from {n}b, rl where letters > 0),
{n}d as (select *, 1 - greatest(ar, la, de, ot) minor, list_sort([u, pe, ab]) az, list_sort([ro, en]) lz from {n}c),
{n}e as (select *, case when az[3] < 0.08 or az[3] - az[2] < 0.02 then 'urdu' when u = az[3] then 'urdu' when pe = az[3] then 'persian' else 'arabic' end al, case when lz[2] < 0.08 or lz[2] - lz[1] < 0.02 then 'other' when ro = lz[2] then 'roman_urdu' else 'english' end ll from {n}d),
{n}f as (select *, case when ar = 1 - minor then al when la = 1 - minor then ll when de = 1 - minor then 'hindi' else 'other' end single from (select * replace (1 - greatest(ar, la, de, ot) as minor), greatest(ar, la, de, ot) top from {n}e)),
{n} as (select id, letters, minor, case when minor >= 0.1 and ar >= 0.1 and la >= 0.1 and al = 'urdu' and lc >= 0.5 then 'code_switched' when ar = top then al when la = top then ll when de = top then 'hindi' else 'other' end as label from {n}f)"""


def _labels() -> str:
    return rf"""{_roman()}, src as (select doc_id id, coalesce(text, '') t from documents), {_spans('src', 'dd0')},
sen as (select id, unnest(regexp_split_to_array(t, '[۔؟?!.]+[\s\x{{200F}}\x{{200E}}]*|\n+')) t from src join dd0 using (id) where dd0.letters >= 20 and dd0.minor >= 0.1), {_spans('sen', 'ss0')},
by0 as (select id, label, sum(letters) n from ss0 where letters >= 8 group by 1, 2), sh0 as (select id, label, n, n / sum(n) over (partition by id) s from by0),
rf0 as (select id, coalesce(max(s) filter (label = 'code_switched'), 0) sw, coalesce(max(s) filter (label = 'urdu'), 0) su, greatest(coalesce(max(s) filter (label = 'english'), 0), coalesce(max(s) filter (label = 'roman_urdu'), 0)) pa, arg_min(label, (-n, label)) best from sh0 group by 1),
lb0 as (select d.doc_id, d.lang, case when coalesce(dd0.letters, 0) < 20 then 'empty' when rf0.id is null then dd0.label when sw >= 0.1 or (su >= 0.3 and pa >= 0.3) then 'code_switched' else best end as label, coalesce(dd0.letters, 0) letters from documents d left join dd0 on dd0.id = d.doc_id left join rf0 on rf0.id = d.doc_id)"""


ORACLES["language_labels"] = f"with {_labels()} select doc_id, label from lb0"
ORACLES["language_confusion"] = f"with {_labels()} select coalesce(lang, '') as expected, label, count(*) as n from lb0 group by 1, 2"
ORACLES["language_log"] = f"with {_labels()} select label, count(*) as documents, sum(letters)::bigint as letters from lb0 where label in ('urdu', 'roman_urdu', 'code_switched') group by 1"


def _encoding() -> str:
    special = [(_image(b), chr(b)) for b in range(0x80, 0x100) if ord(_image(b)) > 0xFF]
    bad = lambda t: f"coalesce(list_sum(list_transform(regexp_extract_all({t}, '{_MOJIBAKE}'), lambda x: length(x))), 0)"
    out = f"e0 as (select doc_id, strlen(coalesce(text, '')) bytes_in, coalesce(text, '') t, 0 p, {bad("coalesce(text, '')")} m from documents)"
    for i in range(3):
        latin = f"translate(t, '{''.join(a for a, _ in special)}', '{''.join(b for _, b in special)}')"
        out += rf""", n{i} as (select *, case when m > 0 and not regexp_matches({latin}, '[^\x00-\x{{FF}}]') then try(decode(unhex(array_to_string(list_transform(string_split({latin}, ''), lambda c: lpad(to_hex(unicode(c)), 2, '0')), '')))) end nt from e{i}),
k{i} as (select *, case when nt is not null and not contains(nt, chr(65533)) then {bad('nt')} end nm from n{i}),
e{i + 1} as (select doc_id, bytes_in, case when nm < m then nt else t end t, case when nm < m then p + 1 else p end p, case when nm < m then nm else m end m from k{i})"""
    ctl = r"[\x00-\x08\x0E-\x1F\x7F-\x{9F}]"
    return out + rf""", r as (select *, length(t) n, len(regexp_extract_all(t, '\x{{FFFD}}')) f, len(regexp_extract_all(t, '{ctl}')) c from e3),
v as (select doc_id, bytes_in, p, length(regexp_replace(t, '{ctl}', '', 'g')) chars, case when n > 0 and m / n::double > 0.001 then 'mojibake' when n > 0 and f / n::double > 0.001 then 'replacement_heavy' when n > 0 and c / n::double > 0.001 then 'control_heavy' when p > 0 then 'repaired' else 'ok' end verdict from r)"""


ORACLES["encoding_verdicts"] = f"with {_encoding()} select doc_id, verdict, chars::int as chars, p::int as passes from v"
ORACLES["encoding_log"] = f"with {_encoding()} select verdict, count(*) as documents, sum(bytes_in)::bigint as bytes_in, sum(chars)::bigint as chars_out from v group by 1"


def _normalize_log() -> str:
    from waraq.operators import normalize as N

    head = ORACLES["normalize_text"].rsplit("select doc_id, md5(x)", 1)[0]
    count = lambda cs: f"sum(length(b.x) - length(translate(b.x, '{cs}', '')))::bigint"
    rules = {**{k: src for k, (src, _) in N.FOLDS.items()}, **N.DELETIONS, "digits": N.DIGITS[0]}
    return head + "select count(*) as documents, sum(length(b.t))::bigint as chars_in, sum(length(e.x))::bigint as chars_out, " + ", ".join(f"{count(cs)} as {k}" for k, cs in rules.items()) + " from b join e using (doc_id)"


ORACLES["normalize_log"] = _normalize_log()
ORACLES["dedup_variants"] = ORACLES["normalize_text"].rsplit("select doc_id, md5(x)", 1)[0] + f"select 'text' as variant, count(distinct {canon('t')}) as distinct_documents from e union all select 'normalized', count(distinct {canon('x')}) from e"
ORACLES["near_dup_sweep"] = f"with recursive {_PAIRS}, th as (select unnest([0.5, 0.6, 0.7, 0.8, 0.9])::double t), ed as (select t, a, b from rt, th where similarity >= t union select t, b, a from rt, th where similarity >= t), rc as (select t, a node, b other from ed union select rc.t, rc.node, ed.b from rc join ed on rc.t = ed.t and rc.other = ed.a), rr as (select t, node, least(node, min(other)) root from rc group by 1, 2), sz as (select t, root, count(*) n from rr group by 1, 2) select th.t as threshold, count(root) as clusters, coalesce(sum(n - 1), 0)::bigint as removed, coalesce(max(n), 0) as largest from th left join sz on sz.t = th.t group by 1"


def _romanized() -> str:
    """Each letter by its neighbours: (doc_id, out) of the documents with text."""
    from waraq.operators.corruption import ROMAN, ROMAN_FIRST, ROMAN_LAST, SCRIPT, VOWELS

    table = lambda m: "MAP {" + ", ".join(f"'{k}': '{v}'" for k, v in m.items()) + "}"
    silent = VOWELS + "ہ"
    consonants = "".join(c for c, x in ROMAN.items() if x.isalpha() and c not in VOWELS)
    word = lambda c: f"coalesce(regexp_matches({c}, '[{SCRIPT}]'), false)"
    return f"""c as (select doc_id, i, s[i] ch from (select doc_id, s, unnest(range(1, len(s) + 1)) i from (select doc_id, regexp_extract_all(text, '(?s).') s from documents))),
n as (select *, {word('ch')} w, {word('lag(ch) over p')} pw, {word('lead(ch) over p')} nw, lag(ch) over p pc, lead(ch) over p nc, lead(ch, 2) over p n2 from c window p as (partition by doc_id order by i)),
r as (select doc_id, i, case when not w then ch
 when not pw and {table(ROMAN_FIRST)}[ch] is not null then {table(ROMAN_FIRST)}[ch]
 when not nw and ch = 'ہ' and pw and contains('{VOWELS}', pc) then 'h'
 when not nw and {table(ROMAN_LAST)}[ch] is not null then {table(ROMAN_LAST)}[ch]
 else coalesce({table(ROMAN)}[ch], '') end
 || case when w and contains('{consonants}', ch) and nw and not contains('{silent}ھ', nc) and (not pw or not coalesce(contains('{silent}', n2), false)) then 'a' else '' end piece from n),
ro as (select doc_id, string_agg(piece, '' order by i) out from r group by 1)"""


ORACLES["romanize"] = f"with {_romanized()} select doc_id, case when text is null then null else md5(coalesce(out, '')) end as text_md5 from documents left join ro using (doc_id)"
# what must hold whatever the corpus
ORACLES["corrupt_reversible"] = "select cast(0 as bigint) as not_restored, true as some_damaged"


def _budgeted(arms, targets, ratios, held, rate=1.0) -> str:
    """(population, band, bucket_from, bucket_to, chars, target, exhausted), bucket by bucket."""
    whole = sum(targets.values())
    rows = [(p, b, n * t / whole * ratios[p] * rate) for p, t in targets.items() for b, n in (("test", held), ("validation", held), *((f"arm_{a}", n) for a, n in arms.items()))]
    bu = "bu as (select * from (values " + ", ".join(f"('{p}', '{b}', {n!r}::double)" for p, b, n in rows) + ") v(population, band, target))"
    above = lambda src, band, name: f"""{name}r as (select {src}.*, target, sum(chars) over (partition by population order by bucket desc) run from {src} join bu using (population) where band = '{band}'),
{name} as (select population, coalesce(max(bucket + 1) filter (run > target), 0) f, max(bucket + 1) filter (run > target) is null and coalesce(sum(chars), 0) < any_value(target) x from {name}r group by 1)"""  # noqa: E731
    out = f"""{_HIST}, {bu}, ps as (select distinct population from bu), {above('hi', 'test', 'te')}, ta as (select ps.population, coalesce(f, 0) f, coalesce(x, true) x from ps left join te using (population)),
h2 as (select hi.* from hi join ta using (population) where bucket < f), {above('h2', 'validation', 'va')}, vb as (select ps.population, coalesce(va.f, 0) f, coalesce(va.x, true) x from ps left join va using (population)), h3 as (select hi.* from hi join vb using (population) where bucket < f),
ar as (select h3.*, band, target, sum(chars) over (partition by population, band order by bucket) run from h3 join bu using (population) where band like 'arm%'),
ac as (select population, band, min(bucket) filter (run > target) s, coalesce(sum(chars), 0) < any_value(target) short from ar group by 1, 2),
bands as (select population, 'test' band, f bucket_from, 100000 bucket_to, x exhausted from ta union all select vb.population, 'validation', vb.f, ta.f, vb.x from vb join ta using (population)
union all select bu.population, bu.band, 0, coalesce(s, vb.f), s is null and coalesce(short, true) from bu join vb using (population) left join ac using (population, band) where bu.band like 'arm%')"""
    return f"with {out} select b.population, b.band, b.bucket_from::bigint as bucket_from, b.bucket_to::bigint as bucket_to, coalesce((select sum(chars) from hi where hi.population = b.population and bucket >= b.bucket_from and bucket < b.bucket_to), 0)::bigint as chars, round(bu.target, 6) as target, b.exhausted from bands b join bu using (population, band)"


_ARMS, _TARGETS = {"A": 3_000, "B": 30_000}, {"urdu": 80, "roman_urdu": 15, "english": 5}
_RATIOS = {"urdu": 3.5, "roman_urdu": 4.2, "english": 4.5}
ORACLES["split_token_bands"] = _budgeted(_ARMS, _TARGETS, _RATIOS, 8 * 128)
ORACLES["split_token_bands_resolved"] = _budgeted(_ARMS, _TARGETS, {"urdu": 3.739, "roman_urdu": 4.066, "english": 3.9}, 8 * 128, 0.1)
ORACLES["split_funding"] = "with a as (select * from (values " + ", ".join(f"('{a}', '{p}', {_RATIOS[p]}::double, {(n + 2 * 8 * 128) * t / 100!r}::double)" for a, n in _ARMS.items() for p, t in _TARGETS.items()) + ") v(arm, population, ratio, required)), s as (select lang population, sum(coalesce(n_chars, 0)) chars from documents where lang is not null group by 1) select arm, population, round(coalesce(chars, 0) / ratio, 6) as supply_tokens, round(required, 6) as required_tokens, coalesce(chars, 0) / ratio >= required as funded from a left join s using (population)"
ORACLES["domain_top_share"] = r"with h as (select regexp_replace(regexp_extract(lower(url), '^[a-z]+://([^/:?#]+)', 1), '^www\.', '') host, length(coalesce(text, '')) c from documents where url is not null), g as (select host, sum(c) s, row_number() over (order by sum(c) desc, host) r from h where host <> '' group by 1), t as (select count(*) n, sum(s) a from g) select n as hosts, count(*) as top_hosts, sum(s)::bigint as top_size, a::bigint as size, round(sum(s) / a::double, 9) as share from g, t where r <= greatest(1, floor(n * 0.01)) group by n, a"
ORACLES["specific_pairs"] = f"""with r as (select distinct idx, ar_text, diff_text from demo_pairs), w as (select row_number() over () i, list_distinct({_TOK.format(t='lower(ar_text)')}) us, list_distinct({_TOK.format(t='lower(diff_text)')}) ss from r), u as (select i, unnest(us) u from w), s as (select i, unnest(ss) s from w),
nu as (select u, count(*) n from u group by 1 having count(*) >= 5), ns as (select s, count(*) n from s group by 1), b as (select u, s, count(*) n from u join s using (i) group by 1, 2 having count(*) >= 5), p as (select b.u, b.s, b.n, b.n / nu.n::double p, b.n / ns.n::double q, (b.n / nu.n::double) * (select count(*) from r) / ns.n::double lift from b join nu using (u) join ns using (s))
select u, s, n, round(p, 9) as p, round(q, 9) as q, round(lift, 9) as lift from p where p >= 0.3 and q >= 0.3"""
ORACLES["commit_order"] = f"""with t as (select idx, min(diff_text) t from demo_pairs where diff_text is not null group by 1), s as (select idx, i, (length(w[i]) * 7 + i - 1) % 5 c from (select idx, w, unnest(range(1, len(w) + 1)) i from (select idx, {_TOK.format(t='t')} w from t))), d as (select idx, c - lag(c) over (partition by idx order by i) d from s)
select t.idx, round(coalesce(count(*) filter (d > 0) / nullif(count(d), 0)::double, 0.0), 9) as in_order, round(coalesce(count(*) filter (d = 0) / nullif(count(d), 0)::double, 0.0), 9) as same_pass from t left join d using (idx) group by 1"""
ORACLES["infill_scores"] = f"""with r as (select row_number() over () i, ar_forwards f, {_TOK.format(t='prefix')} g, {_TOK.format(t='ar_text')} m from demo_pairs where ar_forwards is not null), c as (select i, f, g, m[1:len(g)] m from r), gc as (select i, w, count(*) n from (select i, unnest(g) w from c) group by 1, 2), mc as (select i, w, count(*) n from (select i, unnest(m) w from c) group by 1, 2), o as (select i, sum(least(gc.n, mc.n)) same from gc join mc using (i, w) group by 1)
select f as ar_forwards, count(*) as items, sum((g = m)::int)::bigint as exact, round(avg(case when len(g) + len(m) > 0 then 2 * coalesce(same, 0) / (len(g) + len(m))::double else 1.0 end), 9) as f1 from c left join o using (i) group by 1"""
ORACLES["task_counts"] = "with s as (select * from (values (1, 'lm', 0.65::double, 0.70::double), (2, 'infill', 0.10, 0.05), (3, 'pair', 0.10, 0.10), (4, 'restore', 0.08, 0.08), (5, 'switch', 0.07, 0.07)) v(i, task, share, reached)), n as (select count(*) n from documents), c as (select *, coalesce(sum(share) over (order by i rows between unbounded preceding and 1 preceding), 0) lo, sum(share) over (order by i) hi from s) select task, (floor(n * hi + 0.5 + 1e-9) - floor(n * lo + 0.5 + 1e-9))::bigint as documents, round(share * share / reached / (select sum(share * share / reached) from s), 9) as share from c, n"
ORACLES["exclusions_stages"] = f"with {DEDUP}, e as (select doc_id, 'dedup' s from (select doc_id, row_number() over (partition by h order by k) r from k) where r > 1 union select doc_id, 'quality' from ({ORACLES['quality_verdicts']}) where list_contains(string_split(reasons, ','), 'too_short')) select doc_id::varchar as doc_id, string_agg(s, ',' order by s) as stages from e group by 1"
ORACLES["pack_indexed"] = f"""with {_PACK}, tl as (select stream, (sum(n) // 512)::bigint whole from pl where contains(stream, '/train/') group by 1 having sum(n) >= 512), b as (select stream, whole, coalesce(sum(whole) over (order by stream rows between unbounded preceding and 1 preceding), 0) base from tl) select stream, seq::bigint as seq, (base + seq)::bigint as index from (select *, unnest(range(whole)) seq from b)"""
ORACLES["pack_whole"] = f"with {_PACK}, w as (select stream, n - n % 128 n from pl where n >= 128) select stream, count(*) as documents, sum(n)::bigint as tokens, (sum(n) // 128)::bigint as sequences, 0::bigint as dropped_tokens from w group by 1"
ORACLES["quality_sentence_variant"] = f"select not (chars < 20 or words < 3 or url_ratio > 0.3 or html_ratio > 0.1 or replacement_rate > 0.001) as kept, count(*) as documents from ({ORACLES['quality_metrics']}) group by 1"
