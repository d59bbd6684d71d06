"""The same queries in DuckDB's SQL, to hold results against."""

from __future__ import annotations

from quillspark.functions.text import KEYWORD_STOPWORDS, STOPWORDS
from quillspark.operators.context import LIMIT_WORDS, NORMATIVE, SCOPE, TECHNICAL

NL = "chr(10)"


def words(values) -> str:
    return "[" + ", ".join("'" + v.replace("'", "''") + "'" for v in values) + "]"


def fold(x: str) -> str:
    return f"lower(strip_accents(coalesce({x}, '')))"


def collapse(x: str) -> str:
    return f"trim(regexp_replace({x}, '\\s+', ' ', 'g'))"


def points(x: str) -> str:
    return rf"regexp_replace(regexp_replace({x}, '(\d),(\d)', '\1.\2', 'g'), '(\d),(\d)', '\1.\2', 'g')"


def tokens(x: str) -> str:
    return f"list_filter(regexp_extract_all({points(fold(x))}, '[a-z0-9]+(?:[.,][0-9]+)*'), lambda t: not list_contains({words(STOPWORDS)}, t) and (length(t) > 1 or regexp_matches(t, '[0-9]')))"


def keywords(x: str) -> str:
    return f"list_filter(list_transform(string_split({collapse(x)}, ' '), lambda w: regexp_replace(lower(w), '^[.,;:!?()]+|[.,;:!?()]+$', '', 'g')), lambda w: length(w) > 1 and not list_contains({words(KEYWORD_STOPWORDS)}, w))"


def simplified(x: str) -> str:
    ks = keywords(x)
    return f"case when len({ks}) >= 2 then array_to_string(list_transform(list_slice(list_sort(list_transform({ks}, lambda w, i: {{'n': -length(w), 'i': i, 'w': w}})), 1, 3), lambda s: s.w), ' ') else {x} end"


def truncated(x: str, n: int) -> str:
    flat = collapse(f"coalesce({x}, '')")
    head = f"left({flat}, {n})"
    last = f"({n} - position(' ' in reverse({head})))"
    return f"case when length({flat}) <= {n} then {flat} else regexp_replace(case when contains({head}, ' ') and {last} > {n // 2} then left({head}, {last}) else {head} end, '[ ,;:.-]+$', '') end"


def density(x: str) -> str:
    return f"case when length({x}) = 0 or {x} is null then 0.0 else length(regexp_replace({x}, '[^0-9]', '', 'g')) / length({x})::double end"


def numbers(x: str) -> str:
    return rf"(coalesce(regexp_matches({x}, '\d+[.,]\d+'), false) or {density(x)} >= 0.03)"


RULE = r"'^\s*\|?[\s:|-]*-{3,}[\s:|-]*\|?\s*$'"


def table_line(x: str) -> str:
    return rf"(starts_with(trim({x}), '|') and len(regexp_extract_all({x}, '\|')) >= 2)"


def has_table(x: str) -> str:
    lines = f"string_split(coalesce({x}, ''), {NL})"
    return f"(len(list_filter({lines}, lambda x: regexp_matches(x, {RULE}))) > 0 or len(list_filter({lines}, lambda x: {table_line('x')})) >= 2)"


def quality(x: str) -> str:
    f = fold(x)
    return f"case when contains({f}, 'tabelas auxiliares estruturadas') or contains({f}, 'transcricao estruturada') or contains({f}, 'transcricao)') then 'structured' when contains({f}, 'anexo ocr') then 'ocr' else 'document' end"


def source_id(t: str, n: str, y: str) -> str:
    return " || ".join([f"coalesce(nullif(trim({t}), ''), 'N/A')", "' '", f"coalesce(nullif(trim({n}), ''), 'N/A')", "'/'", f"coalesce(nullif(trim({y}), ''), 'N/A')"])


CORPUS = f"""
li as (select l_orderkey, string_agg('| ' || l_linenumber || ' | ' || cast(l_quantity as decimal(12,2)) || ' | ' || cast(l_extendedprice as decimal(12,2)) || ' |', {NL} order by l_linenumber, l_partkey, l_quantity, l_extendedprice) as rows from lineitem group by 1),
sections as (select o_custkey, o_orderkey, year(o_orderdate) as y, concat_ws({NL}, '## ANEXO ' || o_orderkey, 'Art. ' || (o_orderkey % 50) || ' Priority ' || o_orderpriority || ' with status ' || o_orderstatus || '.', case when o_orderkey % 7 = 0 then '(transcricao)' end, case when o_orderkey % 5 = 0 then 'Anexo OCR ' || o_orderkey end, '| line | qty | price |' || {NL} || '| --- | --- | --- |', rows) as s from orders left join li on o_orderkey = l_orderkey),
per as (select o_custkey, min(y) as y, string_agg(s, {NL} order by o_orderkey) as body from sections group by 1),
corpus as (select 'CUS/' || yy || '/CUS-' || case when length(num) >= 8 then num else lpad(num, 8, '0') end || '-' || yy || '.md' as path, c_mktsegment as type, num as number, yy as year, c_name as summary, c_nationkey::bigint as nation, c_acctbal as balance, concat_ws({NL}, '# Customer ' || num, body) as text from (select *, c_custkey::varchar as num, coalesce(y, 1992)::varchar as yy from customer left join per on c_custkey = o_custkey))
"""
_START = r"Art\.\s*\d|CAPITULO\s|SECAO\s|TITULO\s|ANEXO\s|##\s|###\s"
CHUNKS = CORPUS + rf""",
split as (select * exclude (text), text as whole, list_filter(list_transform(string_split(regexp_replace(text, '(?i)(\n\s*(?:{_START}))', chr(1) || '\1', 'g'), chr(1)), lambda b: regexp_replace(b, '^\s+|\s+$', '', 'g')), lambda b: b <> '') as bs from corpus),
numbered as (select * exclude (bs, whole), unnest(case when len(bs) <= 1 then [whole] else bs end) as text, generate_subscripts(case when len(bs) <= 1 then [whole] else bs end, 1) as chunk, greatest(len(bs), 1) as total_chunks from split),
chunks as (select *, {quality('text')} as quality from numbered)
"""
HITS = CHUNKS + f""",
hits as (select *, number::bigint % 11 = 0 as priority, {source_id('type', 'number', 'year')} as source_id, path || '|' || chunk as key from (select *, nation as query_id, row_number() over (partition by nation order by balance desc, path, chunk) as rank from chunks) where rank <= 40)
"""
BM25 = f"""
bags as materialized (select doc_id, {tokens('text')} as t from documents),
postings as materialized (select doc_id, term, dl, count(*) as tf from (select doc_id, len(t) as dl, unnest(t) as term from bags) group by 1, 2, 3),
size as (select count(*) as n_docs, avg(len(t)) as avgdl from bags where len(t) > 0),
rawidf as (select term, count(*) as df, ln((any_value(n_docs) - count(*) + 0.5) / (count(*) + 0.5)) as raw from postings, size group by 1),
terms as (select term, df, case when raw < 0 then 0.25 * avg(raw) over () else raw end as idf from rawidf),
weights as (select doc_id, postings.term, idf * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / avgdl)) as w from postings join terms using (term), size)
"""


def search(name: str, text: str, k: int, where: str = "true", source: str = "benchmark") -> str:
    return f"""
{name}_q as (select query_id, term, count(*) as qtf from (select item_id as query_id, unnest({tokens(text)}) as term from {source}) group by 1, 2),
{name}_s as (select query_id, doc_id, round(sum(qtf * w), 6) as score from {name}_q join weights using (term) where {where} group by 1, 2),
{name} as (select *, row_number() over (partition by query_id order by score desc, doc_id) as rank from {name}_s qualify rank <= {k})
"""


KEYWORD_LIST = f"""
asked as (select distinct item_id as query_id, unnest({keywords('text')}) as word from benchmark),
kw as (select query_id, doc_id, count(*) as score from asked join (select doc_id, lower(concat_ws(' ', lang, source, text)) as t from documents) on contains(t, word) group by 1, 2),
keyword as (select *, row_number() over (partition by query_id order by score desc, doc_id) as rank from kw qualify rank <= 30)
"""
FULL_SEARCH = f"""
qv as (select item_id as query_id, embedding::double[] as q from benchmark join embeddings on vec_id = item_id),
dn as (select query_id, vec_id as doc_id, round(list_inner_product(q, embedding::double[]), 6) as score from qv, embeddings where vec_id in (select doc_id from documents)),
dense as (select query_id, doc_id, row_number() over (partition by query_id order by score desc, doc_id) as rank from dn qualify rank <= 48),
lists as (select query_id, doc_id, rank, 0 as l from dense union all select query_id, doc_id, rank, 1 from lex),
rrf as (select query_id, doc_id, round(sum(1.0::double / (60 + rank)), 9) as rrf, min(struct_pack(l := l, r := rank)) as seen from lists group by 1, 2),
fz as (select *, row_number() over (partition by query_id order by rrf desc, seen) as c from rrf),
ck as (select doc_id, 'doc-' || (doc_id // 8) as path, doc_id % 8 + 1 as chunk, text, case source when 'src1' then 'structured' when 'src2' then 'ocr' else 'document' end as quality, {has_table('text')} as has, {numbers('text')} as num from documents),
res as (select item_id as query_id, doc_id, true as priority, 0 as a, chunk as c from benchmark join ck on path = 'doc-' || (item_id // 8) where item_id % 5 = 0 union all select query_id, doc_id, false, 1, c from fz),
ded as (select * from res qualify row_number() over (partition by query_id, doc_id order by a, c) = 1),
pr as (select *, row_number() over (partition by query_id order by a, c) as prior from ded),
qk as (select item_id as query_id, list_distinct({keywords('text')}) as ks from benchmark),
sc as (select pr.query_id, pr.doc_id, path, chunk, priority, prior, len(list_filter(ks, lambda w: contains(lower(text), w))) as h, len(ks) as nk, least(len(regexp_extract_all(text, '(?i)\\bArt\\.\\s*\\d+')) * 0.3, 2.0) + case when has then 4 else 0 end + case quality when 'structured' then 5 when 'ocr' then -2 else 0 end + case when priority then 10 else 0 end + 100 * coalesce(rrf, 0) as more from pr join ck using (doc_id) join qk on qk.query_id = pr.query_id left join rrf on rrf.query_id = pr.query_id and rrf.doc_id = pr.doc_id),
rk as (select *, row_number() over (partition by query_id order by round(h + case when nk > 0 then 3.0 * h / nk else 0 end + more, 6) desc, prior) as r0 from sc),
np as (select *, count(*) filter (where priority) over (partition by query_id) as np, row_number() over (partition by query_id, priority order by r0) as place from rk),
lp as (select query_id, doc_id, path, chunk, priority, row_number() over (partition by query_id order by priority desc, place) as rank from np where priority or place <= 16 - np),
seen as (select query_id, path, count(*) as n, min(rank) as first from lp group by 1, 2),
el as (select *, row_number() over (partition by query_id order by first) as place from seen qualify place = 1 or n >= 2),
par as (select *, row_number() over (partition by query_id order by first) as parent from el qualify parent <= 3),
sib as (select doc_id, path, chunk, case when has then 3.0 else 0.0 end + case when num then 1.5 else 0 end + case quality when 'structured' then 2.0 when 'ocr' then -1.0 else 0 end as s from ck),
ex as (select par.query_id, sib.doc_id, parent, row_number() over (partition by par.query_id, par.path order by s desc, sib.chunk) as e from par join sib using (path) where s > 0 and not exists (select 1 from lp where lp.query_id = par.query_id and lp.doc_id = sib.doc_id) qualify e <= 3),
cnt as (select query_id, count(*) as n from lp group by 1),
ad as (select ex.query_id, doc_id, row_number() over (partition by ex.query_id order by parent, e) as added, n from ex join cnt using (query_id) qualify added <= greatest(least(8, 40 - n), 0)),
ev as (select query_id, doc_id, priority, rank from lp union all select query_id, doc_id, false, n + added from ad),
hv as (select query_id, ev.doc_id as key, priority, rank, path as norm, text, quality from ev join ck using (doc_id)),
nm as (select query_id, norm, row_number() over (partition by query_id order by min(rank)) as n from hv group by 1, 2 qualify n <= 3),
ax as (select 'doc-' || (doc_id // 8) as norm, 'Auxiliary ' || doc_id as text, -doc_id - 1 as key, row_number() over (partition by doc_id // 8 order by doc_id) as m from labels qualify m <= 12),
inj as (select query_id, key, false as priority, norm, text, 'structured' as quality, true as injected, 0 as x, n as y, m as z from nm join ax using (norm)),
al as (select * from inj union all select query_id, key, priority, norm, text, quality, false, 1, rank, 0 from hv where not exists (select 1 from inj where inj.query_id = hv.query_id and inj.text = hv.text)),
gr as (select *, case when quality = 'structured' then 0 when quality = 'ocr' and max((quality = 'structured')::int) over (partition by query_id, norm) = 1 then 2 else 1 end as g from al),
od as (select *, row_number() over (partition by query_id order by g, x, y, z) as rank, count(*) over (partition by query_id) as total, case when priority then 0 when injected or quality = 'structured' then 1 else 2 end as q from gr),
lq as (select *, row_number() over (partition by query_id order by q, rank) as place, count(*) filter (where q < 2) over (partition by query_id) as kept from od),
lb as (select *, case when kept >= 40 then 32 else kept end as base from lq)
select query_id, key, md5(text) as digest, priority, injected, row_number() over (partition by query_id order by case when total <= 40 then rank else place end) as rank from lb where total <= 40 or (q < 2 and place <= base) or (q = 2 and place - kept <= 40 - base)
"""

FUSED = BM25 + "," + search("full_list", "text", 30) + "," + search("short_list", simplified("text"), 30) + "," + KEYWORD_LIST + """,
lists as (select query_id, doc_id, rank, 0 as list, 1.0 as weight from full_list union all select query_id, doc_id, rank, 1, 0.7 from short_list union all select query_id, doc_id, rank, 2, 1.0 from keyword),
merged as (select query_id, doc_id, round(sum(weight::double / (60 + rank)), 9) as score_rrf, min(list * 1000 + rank) as seen from lists group by 1, 2),
fused as (select query_id, doc_id, score_rrf, row_number() over (partition by query_id order by score_rrf desc, seen) as rank from merged)
"""

_HEADING = r"'^\s{0,3}(#{1,6})\s+(.+?)\s*#*\s*$'"
_MARKER = r"'^\s*(?:anexo\b|apendice\b|capitulo\s+[ivxlcdm0-9]|secao\s+[ivxlcdm0-9]|subsecao\s+[ivxlcdm0-9]|titulo\s+[ivxlcdm0-9]|tabela\s+[0-9ivxlcdm]|quadro\s+[0-9ivxlcdm])'"
_LEVELS = range(1, 7)
LINES = CHUNKS + f""",
raw_lines as (select path, chunk, unnest(string_split(text, {NL})) as line, generate_subscripts(string_split(text, {NL}), 1) as n from chunks),
parsed as (select *, chunk * 1000000 + n as pos, length(regexp_extract(line, {_HEADING}, 1)) as lv, trim(regexp_extract(line, {_HEADING}, 2)) as title, {table_line('line')} as is_table, regexp_matches(line, {RULE}) as is_rule, last_value(case when trim(line) <> '' then line end ignore nulls) over (partition by path, chunk order by n rows between unbounded preceding and 1 preceding) as prior from raw_lines),
said as (select *, case when lv > 0 then title else line end as said from parsed),
marked as (select *, case when regexp_matches({fold('said')}, {_MARKER}) then {truncated("regexp_replace(said, '^[# ]+|[# ]+$', '', 'g')", 90)} end as marker, case when is_rule and {table_line('prior')} then {truncated("replace(regexp_replace(trim(prior), '^[|]+|[|]+$', '', 'g'), '|', '; ')", 220)} end as opened from said)
"""
TRAILS = LINES + f""",
per_chunk as (select path, chunk, {', '.join(f'max(pos) filter (where lv = {k}) as p{k}, arg_max(title, pos) filter (where lv = {k}) as t{k}' for k in _LEVELS)}, arg_max(marker, pos) filter (where marker is not null) as m, arg_max(opened, pos) filter (where opened is not null) as o, arg_min(is_table, pos) filter (where trim(line) <> '') as first_table from marked group by 1, 2),
carried as (select path, chunk, o is null as unopened, first_table, {', '.join(f'last_value(p{k} ignore nulls) over w as p{k}, last_value(t{k} ignore nulls) over w as t{k}' for k in _LEVELS)}, last_value(m ignore nulls) over w as m, last_value(o ignore nulls) over w as header from per_chunk window w as (partition by path order by chunk rows between unbounded preceding and current row)),
listed as (select *, list_filter([{', '.join('case when ' + ' and '.join([f'p{k} is not null', *(f'p{k} > coalesce(p{j}, -1)' for j in range(1, k))]) + f' then t{k} end' for k in _LEVELS)}, m], lambda x: x is not null) as every from carried),
distinct_parts as (select *, list_filter(every, lambda x, i: list_position(every, x) = i) as parts from listed),
joined as (select path, chunk, coalesce(header, '') as header, coalesce(first_table and unopened, false) as continues, array_to_string(list_slice(parts, greatest(len(parts) - 3, 1), len(parts)), ' > ') as whole from distinct_parts),
trails as (select path, chunk, header, continues, {truncated('whole', 240)} as trail from joined)
"""
_ENTRIES = f"entries as (select c_custkey as ord, c_mktsegment as type, case when c_custkey % 3 = 0 then c_mktsegment else c_mktsegment || ' ' || (c_custkey % 4) end as name, [lower(c_mktsegment), 'seg ' || (c_custkey % 6)] as aliases from customer), types as (select type, arg_max(name, (case when upper(name) <> type then length(name) else 0 end) * 10000000000 - ord) as name, list_sort(list_distinct(flatten(list(aliases)))) as aliases, count(*) as n_docs from entries group by 1), winners as (select alias, type from (select type, n_docs, {collapse(fold('a'))} as alias from (select type, n_docs, unnest(aliases) as a from types)) where alias <> '' qualify row_number() over (partition by alias order by n_docs desc, type) = 1)"

ORACLES: dict[str, str] = {
    "normalize_text": f"select doc_id, md5({fold('text')}) as search, md5({fold('text')}) as ascii, md5({collapse(fold('text'))}) as alias, md5({collapse(points(fold('text')))}) as comparison, md5(lower({collapse('text')})) as plain from documents",
    "tokenize": f"select doc_id, len(t)::bigint as n_tokens, len(list_distinct(t))::bigint as n_distinct, md5(array_to_string(t, ' ')) as digest from (select doc_id, {tokens('text')} as t from documents)",
    "keywords": f"select doc_id, len(k)::bigint as n_keywords, md5(array_to_string(k, ' ')) as digest from (select doc_id, {keywords('text')} as k from documents)",
    "simplify_query": f"select item_id, {simplified('text')} as simple from benchmark",
    "truncate_words": f"select doc_id, {truncated('text', 220)} as short from documents",
    "digit_density": f"select doc_id, round({density('text')}, 9) as density, {numbers('text')} as has_numbers from documents",
    "strip_front_matter": "select doc_id, md5(text) as body from documents",
    "safe_filename": "select p_partkey, coalesce(nullif(regexp_replace(regexp_replace(regexp_replace(string_split(replace(p_type || '\\' || p_name || ' ' || p_size || '%.md', '\\', '/'), '/')[-1], '[^A-Za-z0-9._-]', '_', 'g'), '_+', '_', 'g'), '^[._]+|[._]+$', '', 'g'), ''), 'document') as name from part",
    "identifiers": "select c_custkey, trim(concat_ws(' ', c_mktsegment, coalesce(nullif(ltrim(n, '0'), ''), n))) || '/' || y as identifier, " + source_id("c_mktsegment", "n", "y") + " as source_id, 'p' || c_custkey || '|' || (c_custkey % 9) as chunk_key, case when c_custkey % 2 = 0 then 'p' || c_custkey else c_mktsegment || '|' || n || '|' || y end as standard_key, c_mktsegment || '-' || lpad(n, 8, '0') || '-' || y as regulatory_id, regexp_replace(n, '^0+(.)', '\\1') as bare from (select *, lpad(c_custkey::varchar, 6, '0') as n, (1990 + c_custkey % 30)::varchar as y from customer)",
    "first_filled": "select s_suppkey, coalesce(nullif(trim(case when s_suppkey % 3 = 0 then ' ' end), ''), nullif(trim(case when s_suppkey % 2 = 0 then s_name end), ''), '') as first, case when s_suppkey % 4 = 0 then null when s_suppkey % 4 = 1 then null else trim(s_name) end as filter from supplier",
    "render_markdown_tables": f"select l_orderkey, '| line | flags | price |' || {NL} || '| --- | --- | --- |' || {NL} || string_agg('| ' || l_linenumber || ' | ' || l_returnflag || '\\|' || l_linestatus || ' | ' || cast(l_extendedprice as decimal(12,2)) || ' |', {NL} order by l_linenumber, l_partkey, l_returnflag, l_linestatus, l_extendedprice) as markdown from lineitem group by 1",
    "split_structure": f"with {CHUNKS} select path, chunk::bigint as chunk, total_chunks::bigint as total_chunks, md5(text) as digest, length(text)::bigint as n_chars from chunks",
    "source_quality": f"with {CHUNKS} select quality, count(*) as n from chunks group by 1",
    "table_detection": f"with {CHUNKS} select path, chunk::bigint as chunk, {has_table('text')} as has_table, {numbers('text')} as has_numbers from chunks",
    "tabular_share": f"with {CHUNKS} select type, round(avg(({has_table('text')})::int), 6) as share, count(*) as n_chunks from chunks group by 1",
    "bm25_stats": f"with {BM25} select n_docs, round(avgdl, 6) as avgdl, round((select avg(raw) from rawidf), 6) as mean_idf, (select count(*) from rawidf) as n_terms from size",
    "bm25_terms": f"with {BM25} select term, df, round(idf, 6) as idf from terms",
    "bm25_topk": f"with {BM25}, {search('found', 'text', 20)} select query_id, doc_id, rank, score from found",
    "bm25_filtered": f"with {BM25}, {search('found', 'text', 20, "doc_id in (select doc_id from documents where lang = 'en' and source = 'src1')")} select query_id, doc_id, rank, score from found",
    "dense_topk": "with q as (select vec_id as query_id, embedding::double[] as q from embeddings where vec_id % 100 = 0), s as (select query_id, vec_id, round(list_inner_product(q, embedding::double[]), 6) as score from q, embeddings where vec_id <> query_id) select query_id, vec_id, score, row_number() over (partition by query_id order by score desc, vec_id) as rank from s qualify rank <= 20",
    "dense_filtered": "with q as (select vec_id as query_id, embedding::double[] as q from embeddings where vec_id % 100 = 0), s as (select query_id, vec_id, round(list_inner_product(q, embedding::double[]), 6) as score from q, embeddings where label = 3 and vec_id <> query_id) select query_id, vec_id, score, row_number() over (partition by query_id order by score desc, vec_id) as rank from s qualify rank <= 10",
    "keyword_fallback": f"with {KEYWORD_LIST} select query_id, doc_id, score, rank from keyword",
    "rrf_fusion": f"with {FUSED} select query_id, doc_id, score_rrf, rank from fused where rank <= 40",
    "hybrid_search": f"with {FUSED}, asked2 as (select item_id as query_id, list_distinct({keywords('text')}) as ks from benchmark), scored as (select query_id, doc_id, f.rank as prior, len(list_filter(ks, lambda w: contains(lower(text), w))) as hits, len(ks) as nk, text, score_rrf from fused f join documents using (doc_id) join asked2 using (query_id) where f.rank <= 45) select query_id, doc_id, score, row_number() over (partition by query_id order by score desc, prior) as rank from (select query_id, doc_id, prior, round(hits + 3.0 * hits / nk + least(len(regexp_extract_all(text, '(?i)\\bArt\\.\\s*\\d+')) * 0.3, 2.0) + case when {has_table('text')} then 3 else 0 end + 100 * score_rrf, 6) as score from scored) qualify rank <= 30",
    "dedupe_first": "select doc_id from (select doc_id, row_number() over (partition by text order by doc_id) as n from documents) where n = 1",
    "rerank": f"with {HITS}, q as (select query_id, ['priority', 'anexo', 'high', 'line'] as ks from (select distinct query_id from hits)), s as (select query_id, key, rank as prior, len(list_filter(ks, lambda w: contains(lower(text), w))) as h, text, quality, priority from hits join q using (query_id)), t as (select query_id, key, prior, round(h + 3.0 * h / 4 + least(len(regexp_extract_all(text, '(?i)\\bArt\\.\\s*\\d+')) * 0.3, 2.0) + case when {has_table('text')} then 4 else 0 end + case quality when 'structured' then 5 when 'ocr' then -2 else 0 end + case when priority then 10 else 0 end + 100.0 / (60 + prior), 6) as score from s) select query_id, key, score, row_number() over (partition by query_id order by score desc, prior) as rank from t",
    "limit_priority": f"with {HITS}, f as (select *, count(*) filter (where priority) over (partition by query_id) as np, row_number() over (partition by query_id, priority order by rank) as place from hits) select query_id, key, row_number() over (partition by query_id order by priority desc, place) as rank from f where priority or place <= 16 - np",
    "limit_quality": f"with {HITS}, g as (select *, count(*) over (partition by query_id) as n, case when priority then 0 when quality = 'structured' then 1 else 2 end as g from hits), p as (select *, row_number() over (partition by query_id order by g, rank) as place, count(*) filter (where g < 2) over (partition by query_id) as kept from g), b as (select *, case when kept >= 16 then 13 else kept end as base from p) select query_id, key, row_number() over (partition by query_id order by case when n <= 16 then rank else place end) as rank from b where n <= 16 or (g < 2 and place <= base) or (g = 2 and place - kept <= 16 - base)",
    "expand_siblings": f"with {HITS}, h as (select * from hits where rank <= 16), sib as (select path, chunk, {'case when ' + has_table('text') + ' then 3.0 else 0.0 end'} + case when {numbers('text')} then 1.5 else 0 end + case quality when 'structured' then 2.0 when 'ocr' then -1.0 else 0 end as s from chunks), seen as (select query_id, path, count(*) as n, min(rank) as first from h group by 1, 2), el as (select *, row_number() over (partition by query_id order by first) as place from seen qualify place = 1 or n >= 2), par as (select *, row_number() over (partition by query_id order by first) as parent from el qualify parent <= 3), c as (select par.query_id, par.path, sib.chunk, s, parent, row_number() over (partition by par.query_id, par.path order by s desc, sib.chunk) as e from par join sib using (path) where s > 0 and not exists (select 1 from h where h.query_id = par.query_id and h.path = sib.path and h.chunk = sib.chunk) qualify e <= 3) select query_id, path, chunk::bigint as chunk, s::double as sibling_score, row_number() over (partition by query_id order by parent, e) as added from c qualify added <= 8",
    "inject_aux": f"with {HITS}, h as (select query_id, rank, type as norm, text from hits where rank <= 20), aux as (select c_mktsegment as norm, 'Auxiliary ' || c_custkey as text, c_custkey as ord from customer), seen as (select query_id, norm, min(rank) as first, row_number() over (partition by query_id order by min(rank)) as n from h group by 1, 2 qualify n <= 3), a as (select *, row_number() over (partition by norm order by ord) as m from aux qualify m <= 12), added as (select query_id, norm, text, true as injected, 0 as x, n as y, m as z from seen join a using (norm)), every as (select * from added union all select query_id, norm, text, false, 1, rank, 0 from h where not exists (select 1 from added d where d.query_id = h.query_id and d.text = h.text)) select query_id, norm, md5(text) as digest, injected, row_number() over (partition by query_id order by x, y, z) as rank from every",
    "prioritize_sources": f"with {HITS}, g as (select *, case when quality = 'structured' then 0 when quality = 'ocr' and max((quality = 'structured')::int) over (partition by query_id, path) = 1 then 2 else 1 end as g from hits) select query_id, key, row_number() over (partition by query_id order by g, rank) as rank from g",
    "new_documents_anti": "select doc_id from documents where doc_id not in (select doc_id from labels)",
    "semi_structured": f"with {HITS} select query_id, key from hits where path in (select path from hits where quality = 'structured')",
    "duplicate_upload_check": "with u as (select p_partkey, lower(p_name) || case when p_partkey % 2 = 0 then '.PDF' else '.md' end as name, md5(p_brand) as sha256 from part), c as (select case when p_partkey % 5 = 0 then '' else 'old ' end || p_name || '.pdf' as name, md5('x' || p_partkey) as sha256 from part) select p_partkey, name from u where lower(name) in (select lower(name) from c) or regexp_replace(lower(name), '\\.[^.]*$', '') in (select regexp_replace(lower(name), '\\.[^.]*$', '') from c) or sha256 in (select sha256 from c)",
    "catalog_merge": "select coalesce(a.k, b.k) as k, case when a.k is not null then a.v else b.v end as v from (select c_custkey * 2 as k, c_name as v from customer) a full outer join (select c_custkey * 3 as k, c_mktsegment as v from customer) b on a.k = b.k",
    "type_catalog": f"with {_ENTRIES} select type, name, array_to_string(aliases, ', ') as aliases, n_docs from types",
    "alias_winner": f"with {_ENTRIES} select alias, type from winners",
    "detect_references": f"with {_ENTRIES}, q as (select o_orderkey, 'About ' || c_mktsegment || ' n. ' || o_custkey || '/' || year(o_orderdate) || case when o_orderkey % 2 = 0 then ' and seg ' || (o_orderkey % 6) || ' 1.0' || o_orderkey || ' de 1999' else '' end as question from orders join customer on o_custkey = c_custkey) select o_orderkey, w.type, q.number, q.year from (select o_orderkey, lower(c_mktsegment) as alias, o_custkey::varchar as number, year(o_orderdate)::varchar as year from orders join customer on o_custkey = c_custkey union all select o_orderkey, 'seg ' || (o_orderkey % 6), '10' || o_orderkey, '1999' from orders join customer on o_custkey = c_custkey where o_orderkey % 2 = 0) q join winners w using (alias)",
    "valid_years": f"with {CORPUS} select distinct year from corpus where regexp_matches(year, '^(19|20)[0-9]{{2}}$')",
    "parse_file_names": f"with {CORPUS} select path, 'CUS' as type, number, year from corpus",
    "fenced_context": f"with {HITS}, r as (select *, row_number() over w as i, count(*) over (partition by query_id, source_id) as n from hits window w as (partition by query_id, source_id order by rank)), b as (select query_id, source_id, min(rank) as first, '===== SOURCE BEGIN: ' || source_id || ' =====' || {NL} || 'ID: ' || source_id || {NL} || '{SCOPE[0]}' || {NL} || '{SCOPE[1]}' || {NL} || 'Path: ' || arg_min(path, rank) || {NL} || string_agg('--- Part ' || i || '/' || n || ' (chunk ' || chunk || '/' || total_chunks || ') ---' || {NL} || text, {NL} order by rank) || {NL} || '===== SOURCE END: ' || source_id || ' =====' as b from r group by 1, 2) select query_id, md5(string_agg(b, {NL} || {NL} order by first)) as digest, length(string_agg(b, {NL} || {NL} order by first)) + 2 as size from b group by 1",
    "pack_score": f"with {HITS} select query_id, key, round(greatest(0, 21.0 - rank) + case when priority then 40 else 0 end + case quality when 'structured' then 30 when 'ocr' then -5 else 0 end + case when {has_table('text')} then 35 else 0 end + least(20.0, 100 * ({density('text')})), 6) as score from hits",
    "cut_keep_table": f"with {CHUNKS}, l as (select path, chunk, text, unnest(string_split(text, {NL})) as line, generate_subscripts(string_split(text, {NL}), 1) as n from chunks), t as (select *, row_number() over (partition by path, chunk order by n) as i from l where starts_with(trim(line), '|')), s as (select path, chunk, line, n, sum(length(line)) over (partition by path, chunk order by n) + i - 1 as total from t), k as (select path, chunk, string_agg(line, {NL} order by n) as kept from s where total <= 120 group by 1, 2) select c.path, c.chunk::bigint as chunk, md5(case when length(text) <= 120 then text else coalesce(kept, left(text, 120)) end) as digest from chunks c left join k on c.path = k.path and c.chunk = k.chunk",
    "route_template": f"with q as (select doc_id, {fold('text')} as f, text from documents) select doc_id, case when {' or '.join(f"contains(f, '{w}')" for w in TECHNICAL)} then 'parameters' when {' or '.join(f"contains(f, '{w}')" for w in NORMATIVE)} then 'normative' when (contains(text, '| --- |') or regexp_matches(text, '\\d+[,.]?\\d*E[+\\-]?\\d+') or regexp_matches(text, '\\d+\\s+\\d+\\s+\\d+')) and ({' or '.join(f"contains(f, '{w}')" for w in LIMIT_WORDS)}) then 'parameters' else 'answer' end as template from q",
    "failure_classes": "select event_id, case when contains(m, '401') or contains(m, 'unauthorized') or contains(m, 'invalid api key') or contains(m, 'no auth credentials') then 'credential' when contains(m, '402') or contains(m, 'payment required') or contains(m, 'more credits') or contains(m, 'insufficient credits') or contains(m, 'insufficient_quota') or contains(m, 'billing') then 'credit' when contains(m, '429') or contains(m, 'rate limit') or contains(m, 'too many requests') or contains(m, 'quota exceeded') then 'rate_limit' when contains(m, 'context length') or contains(m, 'context_length_exceeded') or contains(m, 'maximum context') or contains(m, 'prompt tokens limit') or contains(m, 'too many tokens') then 'too_long' when contains(m, 'timeout') or contains(m, 'timed out') or contains(m, 'connection') or contains(m, 'network') or contains(m, 'unreachable') or contains(m, 'temporarily unavailable') or contains(m, '503') or contains(m, '502') then 'communication' else 'unknown' end as cause from (select event_id, lower('Error ' || event_id || ' ' || event_type || case event_id % 5 when 0 then ' Timed out' when 1 then ' Billing' when 2 then ' Rate limit' else '' end) as m from events)",
    "history_window": f"select conv_id, string_agg(role || ': ' || left(coalesce(text, ''), 1000), {NL} order by back desc) as history from (select *, row_number() over (partition by conv_id order by turn desc, role desc, text desc) as back from conversations) where back <= 8 group by 1",
    "latest_job_state": "select user_id, event_id, event_type from events qualify row_number() over (partition by user_id order by ts desc, event_id desc) = 1",
    "job_states": "select user_id as job_id, arg_max(event_type, struct_pack(u := ts, s := event_type)) as status, strftime(max(ts), '%Y-%m-%d %H:%M:%S') as updated_at, strftime(min(ts), '%Y-%m-%d %H:%M:%S') as created_at from events group by 1",
    "not_indexed": r"with f as (select 'File ' || p_partkey || case when p_partkey % 2 = 0 then '.PDF' else '.docx' end as name, md5('content ' || p_partkey) as sha256 from part), m as (select 'file ' || (p_partkey * 3) || case when p_partkey % 4 = 0 then '.pdf' else '.md' end as name, case when p_partkey % 5 = 0 then '' else md5('content ' || (p_partkey * 7)) end as sha256 from part) select name, sha256 from f where lower(name) not in (select lower(name) from m) and regexp_replace(lower(name), '\.[^.]*$', '.md') not in (select lower(name) from m) and sha256 not in (select sha256 from m where sha256 <> '')",
    "header_fields": "select o_orderkey, case o_orderkey % 4 when 0 then 'instrucao normativa' when 1 then 'resolucao' when 2 then 'nota tecnica sei' else '' end as act, case when o_orderkey % 3 = 0 then '1' || lpad((o_orderkey % 1000)::varchar, 3, '0') else o_orderkey::varchar end as number, case when o_orderkey % 3 <> 0 and regexp_matches(o_orderkey::varchar, '^(19|20)[0-9]{2}$') then o_orderkey::varchar else year(o_orderdate)::varchar end as year from orders",
    "reference_text": "select doc_id, 'Expected: a, ' || doc_id || '.' || case when doc_id % 3 <> 0 then ' Document: DOC ' || doc_id || '.' else '' end as reference from labels",
    "stability_check": "select event_id, user_id, coalesce(length(event_type) = lag(length(event_type)) over w, false) as stable from events window w as (partition by user_id order by ts, event_id)",
    "plain_context": f"with {HITS} select query_id, md5(string_agg(text, {NL} || {NL} order by rank)) as digest from hits group by 1",
    "log_lines": f"with {HITS}, f as (select *, concat_ws(', ', case when priority then 'priority' end, case when {has_table('text')} then 'table' end, case when quality <> 'document' then quality end) as flags from hits) select query_id, rank, md5('chunk[' || rank || '] ' || type || ' ' || number || '/' || year || ' part ' || chunk || '/' || total_chunks || ' (' || length(text) || ' chars)' || case when flags <> '' then ' [' || flags || ']' else '' end || {NL} || '  section: -' || {NL} || '  text: ' || replace(left(text, 120), {NL}, ' ') || '...') as digest from f",
    "hit_projection": f"with {HITS} select query_id, rank, type, number, year, md5(left(text, 500)) as excerpt, path, 0.0::double as relevance from hits",
    "file_entries": "select p_partkey, case m when 0 then 'RES ' || n || '/2024' when 1 then '50500.0124472/' || n when 2 then 'A' || n || ' Nota Tecnica' when 3 then 'RES ' || n || '/' || y else 'a/' || n end as title, case m when 1 then 'SEI' when 2 then 'NT' when 4 then 'EXTRA' else 'RES' end as type, case m when 0 then n when 1 then '50500.0124472-' || n when 2 then 'A' || n || '_Nota_Tecnica' when 3 then n else 'a-' || n end as number, case m when 0 then '2024' when 3 then y else '' end as year from (select p_partkey, p_partkey % 5 as m, p_partkey::varchar as n, case when regexp_matches(p_partkey::varchar, '^(19|20)[0-9]{2}$') then p_partkey::varchar else '2023' end as y from part)",
    "citations": "select o_orderkey, case when o_orderkey % 2 = 0 then 'RES ' || o_orderkey || '/2021; Resolução ' || o_orderkey || '/2020' else 'INM ' || o_orderkey || '/2023' end as cited from orders",
    "full_search": f"with {BM25}, {search('lex', 'text', 48)}, {FULL_SEARCH}",
    "keep_generations": "select user_id, event_id from events qualify row_number() over (partition by user_id order by ts desc, event_id desc) <= 2",
    "coverage": f"with v as (select item_id as case_id, unnest(list_distinct({keywords('text')})) as value from benchmark), t as (select {collapse(points(fold('text')))} as t from documents), w as (select distinct value, {collapse(points(fold('value')))} as x from v), k as materialized (select value from w where exists (select 1 from t where contains(t, x))), f as (select distinct case_id, value from v join k using (value)) select case_id, n_expected, n_found, round(n_found::double / n_expected, 6) as coverage from (select v.case_id, count(*) as n_expected, count(f.value) as n_found from v left join f on v.case_id = f.case_id and v.value = f.value group by 1)",
    "case_metrics": f"with {HITS}, c as (select query_id as case_id, arg_min(path, rank) filter (where rank > 30) as doc, (query_id % 3) as m from hits group by 1, 3) select case_id, bool_or(h.rank <= 20 and h.path = c.doc) as hit, count(*) filter (where h.rank <= 20 and quality = 'structured') as n_structured, count(*) filter (where h.rank <= 20 and quality = 'ocr') as n_ocr, bool_or(h.rank <= 20 and h.path = c.doc) and count(*) filter (where h.rank <= 20 and quality = 'structured') >= any_value(m) as ok from c join hits h on h.query_id = c.case_id group by 1",
    "model_report": "select 'm' || (doc_id % 7) as model, round(avg(case when toxic = 0 then quality end), 6) as mean_coverage, round(avg(doc_id % 10), 6) as mean_seconds, count(*) filter (where toxic = 1) as n_errors from labels group by 1",
    "model_ranking": "select model, row_number() over (order by mean_coverage desc, hit_rate desc, mean_seconds, model) as place from (select 'm' || (doc_id % 7) as model, round(avg(quality), 6) as mean_coverage, round(avg(toxic), 6) as hit_rate, round(avg(doc_id % 10), 6) as mean_seconds from labels group by 1)",
    "run_summary": "select lang, count(*) as n_cases, round(avg(quality), 6) as mean_coverage, round(avg(case when toxic = 1 then (n_chars > 1000)::int end), 6) as hit_rate, round(avg(case when quality = 1 then n_chars / 1000.0 end), 6) as mean_completeness from labels join documents using (doc_id) group by 1",
    "group_hits": f"with {HITS} select query_id, source_id, min(rank) as first, count(*) as n, md5(string_agg(chunk || '/' || total_chunks || ' ' || text, {NL} order by rank)) as digest, row_number() over (partition by query_id order by min(rank)) <= 3 as open from hits group by 1, 2",
    "filter_options": f"with {CORPUS} select 'type' as field, 'Todos' as value union all select distinct 'type', type from corpus union all select 'year', 'Todos' union all select distinct 'year', year from corpus",
    "conversation_retention": "select conv_id, turn, role from conversations where trim(coalesce(text, '')) <> '' and not contains(lower(text), 'error') and not contains(lower(text), 'the') qualify row_number() over (partition by conv_id order by turn desc, role desc, text desc) <= 10",
    "clean_cells": r"select p_partkey, case when v = '' or lower(v) = 'none' or (length(v) <= 2 and not regexp_matches(v, '^[0-9]+$')) or regexp_matches(v, '^(?:None|\(?\s*[A-Z]\s*\)?|[\d]+[-\s]*[A-Z]{1,4}[a-z]{0,2}[A-Z]*|\W+)$') then '' else v end as cell from (select p_partkey, case p_partkey % 8 when 0 then 'None' when 1 then '(A)' when 2 then '1- EXProD' when 3 then p_name || ' x' when 4 then '7' when 5 then 'ab' when 6 then '--' else p_brand end as v from part)",
    "scientific_repair": "select l_orderkey, l_linenumber, v, case when regexp_matches(v, '^[0-9]{6,8}$') and regexp_matches(v, '0[6-9]$') then left(v, 1) || ',' || substr(v, 2, 2) || 'E+' || right(v, 2) else v end as repaired from (select l_orderkey, l_linenumber, l_partkey || '000' || (l_linenumber + 4) as v from lineitem)",
    "decimal_repair": "select p_partkey, case when p_size > 10 then left(p_size::varchar, 1) || ',' || right(p_size::varchar, 1) else p_size::varchar end || ' m/km; ' || (p_size * 100 + 1) // 10 || ' units >0,5' as fixed from part",
    "best_of_n": "select o_custkey, coalesce(min(o_orderkey) filter (where o_totalprice / 500000 >= 0.85), arg_min(o_orderkey, struct_pack(s := -o_totalprice, o := o_orderkey))) as best from orders group by 1",
    "image_extraction": "select p_partkey, 'https://host/' || p_partkey || '.png' as url, left(sha256('https://host/' || p_partkey || '.png'), 16) as key from part",
    "parse_headings": f"with {LINES} select lv::bigint as level, coalesce(marker, '') as marker, count(*) as n, min(nullif(title, '')) as first_title from marked where lv > 0 or marker is not null group by 1, 2",
    "breadcrumbs": f"with {TRAILS} select path, chunk::bigint as chunk, trail, header, continues from trails",
    "contextual_chunks": f"with {TRAILS}, p as (select c.path, c.chunk, text, '[' || concat_ws(' | ', 'Document: ' || type || ' ' || number || '/' || year, 'Subject: ' || summary, case when trail <> '' then 'Section: ' || trail end, case when continues and header <> '' then 'Table continued: ' || header end) || ']' || {NL} as prefix from chunks c join trails t on c.path = t.path and c.chunk = t.chunk) select path, chunk::bigint as chunk, prefix, md5(prefix || text) as digest from p",
    "fallback_ladder": f"with {FUSED}, steps as (select query_id, doc_id, rank, 0 as step from full_list where score > 40 union all select query_id, doc_id, rank, 1 from full_list where score > 20 union all select query_id, doc_id, rank, 2 from short_list), c as (select *, count(*) over (partition by query_id, step) as n from steps), d as (select *, min(case when n >= 2 or step = 2 then step end) over (partition by query_id) as chosen from c) select query_id, doc_id, rank, step from d where step = chosen",
}
