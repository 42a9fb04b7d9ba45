"""SQL that states a pN_ query's result independently, for those that SQL can express on whole tables."""

_WORDS = r"'[\p{L}\p{M}\p{Nd}]+'"

ORACLES: dict[str, str] = {
    # what must hold of the mixture: every listed source reaches its share and keeps its cap
    "p9_reached": "select source, true as share_reached, true as within_cap from mix_targets",
    # what must hold of all surrogates, whatever the corpus
    "p3_checks": """
select property, cast(0 as bigint) as violations from (values ('surrogates of two entities'), ('surrogates that are entities'), ('entities with two surrogates'), ('places named as other places'), ('finds that stayed as they were')) v(property)""",
    "p2_found": rf"""
with t as (select distinct idx, 'ar_text' field_name, ar_text txt from demo_pairs union select distinct idx, 'diff_text', diff_text from demo_pairs),
w as (select idx, field_name, regexp_extract_all(lower(regexp_replace(txt, '\p{{Nd}}', '0', 'g')), {_WORDS}) ws from t where txt is not null),
g as (select idx, field_name, len(ws) n, i, ws[i] || ' ' || ws[i+1] || ' ' || ws[i+2] || ' ' || ws[i+3] gram from (select *, unnest(range(1, len(ws) - 2)) i from w)),
c as (select *, count(*) over (partition by idx, field_name, gram) k from g),
m as (select distinct idx, field_name, n, i + o as p from c, (values (0), (1), (2), (3)) v(o) where k >= 2)
select idx, field_name from m group by idx, field_name, n having count(*) >= 0.4 * n""",
    "p5_found": rf"""
with d as (select distinct doc_id, regexp_extract_all(lower(doc), {_WORDS}) ws from probe_decon_rup_survivors where doc is not null),
dg as (select distinct doc_id, array_to_string(ws[i:i+7], ' ') gram from (select *, unnest(range(1, len(ws) - 6)) i from d)),
e as (select item_id, regexp_extract_all(lower(text), {_WORDS}) ws from eval_items where text is not null),
eg as (select item_id, len(ws) n, i, array_to_string(ws[i:i+7], ' ') gram from (select *, unnest(range(1, len(ws) - 6)) i from e)),
h as (select distinct doc_id, item_id, n, i + o as p from dg join eg using (gram), (values (0), (1), (2), (3), (4), (5), (6), (7)) v(o))
select doc_id, item_id as eval_id from h group by doc_id, item_id, n having count(*) >= 0.6 * n""",
}

ORACLES["p5_leaks"] = ORACLES["p5_found"].replace("select doc_id, item_id as eval_id from h", "select doc_id, item_id as eval_id, count(*) / n::double as containment, n::int as n_words, count(*)::int as n_covered from h")
# every window of 200 characters that stands in two documents, looked up one by one
_WINDOWS = """d as (select doc_id, any_value(text) t from documents where length(text) >= 200 group by 1), w as (select doc_id, i, md5(substr(t, i, 200)) m from (select doc_id, t, unnest(range(1, length(t) - 198)) i from d)),
s as (select m from w group by 1 having count(distinct doc_id) > 1), h as (select w.* from w join s using (m))"""
ORACLES["p10_found"] = f"with {_WINDOWS}, k as (select distinct doc_id, m from h) select distinct a.doc_id as doc_a, b.doc_id as doc_b from k a join k b on a.m = b.m and a.doc_id < b.doc_id"
ORACLES["p10_coverage"] = f"""with {_WINDOWS}, g as (select doc_id, i, coalesce(i > lag(i) over (partition by doc_id order by i) + 200, true) fresh from h), n as (select *, sum(fresh::int) over (partition by doc_id order by i) k from g), p as (select doc_id, k, max(i) - min(i) + 200 c from n group by 1, 2), t as (select doc_id, count(*) n, sum(c) c from p group by 1)
select doc_id, coalesce(length(text), 0)::int as n_chars, coalesce(n, 0)::int as n_spans, coalesce(c, 0)::bigint as shared_chars, case when length(text) > 0 then coalesce(c, 0) / length(text)::double else 0.0 end as shared from documents left join t using (doc_id)"""
