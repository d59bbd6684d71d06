"""SQL for DuckDB with the same rows as the queries, where SQL can express them: plain definitions without the methods."""

from __future__ import annotations

_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
_LOWER = f"translate(coalesce(text, ''), '{_UPPER}', '{_UPPER.lower()}')"
_BLANK = "\\x20\\x09-\\x0D"
_TERMS = f"regexp_extract_all({_LOWER}, '[a-z0-9\\x{{80}}-\\x{{10FFFF}}]+')"
_BASE32 = " || ".join(f"substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', (((('0x' || substr(h, {1 + 5 * g}, 5))::bigint >> {15 - 5 * k}) & 31) + 1)::int, 1)" for g in range(8) for k in range(4))

WARC = f"with p as (select page_id, coalesce(html, '') as b from pages), f as (select b, min(page_id) as first from p group by 1), r as (select page_id, strlen(b) as payload_bytes, sha1(b) as h, case when page_id <> first then first end as refers_to from p join f using (b)) select page_id, payload_bytes, {_BASE32} as payload_digest, case when refers_to is null then 'response' else 'revisit' end as record_type, refers_to, case when refers_to is null then payload_bytes else 0 end as stored_bytes from r"

TOP_K = "with v as (select vec_id, list_transform(embedding, lambda x: floor(64 * x::double)) as v from embeddings where embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0), s as (select q.vec_id as query_id, c.vec_id, list_inner_product(q.v, c.v)::bigint as score from v q, v c where q.vec_id % 20 = 0 and c.vec_id <> q.vec_id) select query_id, row_number() over (partition by query_id order by score desc, vec_id)::int as rank, vec_id, score from s qualify rank <= 20"

SUFFIX_DEDUP = """
with d as (select row_number() over () as r, doc_id, encode(coalesce(text, '')) as b from documents), l as (select *, octet_length(b) as n from d),
w as (select r, i, md5(hex(array_slice(b, i, i + 199))) as h from (select r, b, unnest(range(1, n - 198)) as i from l where n >= 200)),
hit as (select r, i from (select r, i, count(*) over (partition by h) as c from w) where c > 1),
isl as (select r, i, sum(fresh) over (partition by r order by i) as g from (select r, i, case when i <= lag(i) over (partition by r order by i) + 200 then 0 else 1 end as fresh from hit)),
span as (select r, g, min(i) as s, max(i) + 200 as e from isl group by 1, 2),
cut as (select r, s, coalesce(lag(e) over (partition by r order by s), 1) as k, e from span),
gone as (select r, count(*) as n_spans, sum(e - s) as n_removed, max(e) as last from span group by 1),
kept as (select cut.r, string_agg(hex(array_slice(b, k, s - 1)), '' order by s) as x from cut join l using (r) group by 1)
select doc_id, n as n_bytes, coalesce(n_removed, 0)::bigint as n_removed, coalesce(n_spans, 0)::bigint as n_spans, case when n_spans is null then sha256(b) else sha256(unhex(x || hex(array_slice(b, last, n)))) end as kept_sha256 from l left join gone using (r) left join kept using (r)
"""

DECONTAMINATION = f"""
with it as (select item_id, ws, len(ws) as n, len(ws) - len(ws) // 3 as cut from (select item_id, {_TERMS} as ws from benchmark) where len(ws) > 0),
parts as (select item_id, ws, unnest([{{'part': 'w', 'lo': 1, 'hi': n}}, {{'part': 'q', 'lo': 1, 'hi': cut}}, {{'part': 'a', 'lo': cut + 1, 'hi': n}}], recursive := true) from it),
ig as (select distinct item_id, part, array_to_string(ws[p:p + 4], ' ') as g from (select *, unnest(range(lo, hi - 3)) as p from parts)),
totals as (select item_id, part, count(*) as m from ig group by 1, 2),
d as (select doc_id, ws, len(ws) as n, greatest(1, ceil(len(ws) / (select max(n) from it)::double)::bigint - 1) as k, (select max(n) from it) as l from (select doc_id, {_TERMS} as ws from documents)),
dg as (select doc_id, p, array_to_string(ws[p:p + 4], ' ') as g from (select doc_id, ws, unnest(range(1, n - 3)) as p from d)),
hits as (select doc_id, item_id, part, g, p from dg join ig using (g)),
shares as (select h.doc_id, w, h.item_id, h.part, count(distinct g) as c from hits h join (select doc_id, n, l, unnest(range(0, k)) as w from d) x on h.doc_id = x.doc_id and p >= w * l + 1 and p + 4 <= least(w * l + 2 * l, n) group by 1, 2, 3, 4),
s as (select doc_id, w, item_id, max(case when part = 'w' then c / m::double end) as whole, max(case when part = 'q' then c / m::double end) as q, max(case when part = 'a' then c / m::double end) as a from shares join totals using (item_id, part) group by 1, 2, 3),
found as (select doc_id, list_sort(list(distinct item_id)) as item_ids, max(whole) as best from s where whole >= 0.8 and q >= 0.5 and a >= 0.5 group by 1)
select doc_id, case when n = 0 then 0 else k end as n_passages, coalesce(array_to_string(item_ids, ','), '') as item_ids, coalesce(best, 0.0) as best_overlap, item_ids is not null as contaminated from d left join found using (doc_id)
"""

SENTENCE_SPANS = f"""
with d as (select doc_id, coalesce(text, '') as text, regexp_extract(coalesce(text, ''), '^[{_BLANK}]*') as lead, regexp_extract_all(coalesce(text, ''), '[^{_BLANK}]+[{_BLANK}]*') as toks from documents),
t as (select doc_id, unnest(toks) as tok, generate_subscripts(toks, 1) as i from d),
w as (select *, regexp_extract(tok, '^[^{_BLANK}]+') as word from t),
f as (select *, regexp_matches(word, '[.!?]$|[.!?][\"'')\\]}}]$') or contains(tok, chr(10)) as stop from w),
s as (select *, 1 + coalesce(sum(stop::int) over (partition by doc_id order by i rows between unbounded preceding and 1 preceding), 0)::bigint as sent from f),
sents as (select doc_id, sent, min(i) as a, max(i) as b, string_agg(tok, '' order by i) as part from s group by 1, 2),
lw as (select doc_id, list(translate(word, '{_UPPER}', '{_UPPER.lower()}') order by i) as ws from s group by 1),
ends as (select x.doc_id, x.sent, x.a, min(y.sent) as last, min(y.b) as b from sents x join sents y on x.doc_id = y.doc_id and y.sent >= x.sent + 1 and y.sent <= x.sent + 40 and y.b - x.a + 1 >= 20 group by 1, 2, 3),
back as (select y.doc_id, max(x.sent) as sent, max(x.a) as a, y.sent as last, y.b from sents x join sents y on x.doc_id = y.doc_id and y.sent >= x.sent + 1 and y.sent <= x.sent + 40 and y.b - x.a + 1 >= 20 group by y.doc_id, y.sent, y.b),
edges as (select doc_id, sent, a, last, b from ends union select doc_id, sent, a, last, b from back),
spans as (select doc_id, sent, last, md5(array_to_string(ws[a:b], ' ')) as h from edges join lw using (doc_id)),
later as (select * from spans qualify row_number() over (partition by h order by doc_id, sent) > 1),
gone as (select distinct doc_id, unnest(range(sent, last + 1)) as sent from later),
k as (select doc_id, count(*) as n_sentences, count(gone.sent) as n_removed, coalesce(string_agg(case when gone.sent is null then part end, '' order by sents.sent), '') as kept from sents left join gone using (doc_id, sent) group by 1)
select doc_id, coalesce(n_sentences, 0)::bigint as n_sentences, coalesce(n_removed, 0)::bigint as n_removed, strlen(lead || coalesce(kept, ''))::bigint as kept_bytes, sha256(lead || coalesce(kept, '')) as kept_sha256 from d left join k using (doc_id)
"""

NEAR_DEDUP = f"""
with recursive d as (select doc_id, regexp_extract_all({_LOWER}, '[^{_BLANK}]+') as ws from documents),
g as (select distinct doc_id, unnest(case when len(ws) = 0 then []::varchar[] when len(ws) < 3 then [array_to_string(ws, ' ')] else list_transform(range(1, len(ws) - 1), lambda p: array_to_string(ws[p:p + 2], ' ')) end) as s from d),
n as (select doc_id, count(*) as n from g group by 1),
e as (select a.doc_id as x, b.doc_id as y from g a join g b on a.s = b.s and a.doc_id <> b.doc_id join n na on na.doc_id = a.doc_id join n nb on nb.doc_id = b.doc_id group by 1, 2, na.n, nb.n having 100 * count(*) >= 85 * (na.n + nb.n - count(*))),
reach as (select doc_id as x, doc_id as y from d union select r.x, e.y from reach r join e on r.y = e.x),
c as (select x as doc_id, min(y) as component_id from reach group by 1)
select doc_id, coalesce(n, 0)::bigint as n_shingles, component_id, doc_id = component_id as kept from d left join n using (doc_id) join c using (doc_id)
"""

ORACLES: dict[str, str] = {"op1_warc_bundles": WARC, "op3_exact_top_k": TOP_K, "op5_suffix_dedup": SUFFIX_DEDUP, "op6_decontamination": DECONTAMINATION, "op7_sentence_spans": SENTENCE_SPANS, "op8_near_dedup": NEAR_DEDUP}
