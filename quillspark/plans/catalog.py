"""Named queries over the driver's tables, one or more for each operator."""

from __future__ import annotations

from pyspark.sql import Column, Window
from pyspark.sql import functions as F

from quillspark.functions import ocr as O
from quillspark.functions import structure as S
from quillspark.functions import text as T
from quillspark.operators import catalog as C
from quillspark.operators import context as K
from quillspark.operators import evaluate as E
from quillspark.operators import search as R
from quillspark.plans import corpus as P
from quillspark.session import spread, table
from quillspark.streaming import ingest as I

QUERIES = {}


def query(f):
    QUERIES[f.__name__] = f
    return f


def digest(c) -> Column:
    return F.md5(F.encode(c if isinstance(c, Column) else F.col(c), "UTF-8"))


def docs(spark, sf_dir):
    return spread(table(spark, sf_dir, "documents"), "doc_id")


def questions(spark, sf_dir):
    return table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), "text")


# Text


@query
def normalize_text(spark, sf_dir):
    t = F.col("text")
    return docs(spark, sf_dir).select("doc_id", digest(T.search_normal(t)).alias("search"), digest(T.ascii_normal(t)).alias("ascii"), digest(T.alias_normal(t)).alias("alias"), digest(T.comparison_normal(t)).alias("comparison"), digest(T.comparison_plain(t)).alias("plain"))


@query
def tokenize(spark, sf_dir):
    rows = docs(spark, sf_dir).select("doc_id", T.tokens(F.col("text")).alias("t"))
    return rows.select("doc_id", F.size("t").cast("long").alias("n_tokens"), F.size(F.array_distinct("t")).cast("long").alias("n_distinct"), digest(F.array_join("t", " ")).alias("digest"))


@query
def keywords(spark, sf_dir):
    rows = docs(spark, sf_dir).select("doc_id", T.keywords(F.col("text")).alias("k"))
    return rows.select("doc_id", F.size("k").cast("long").alias("n_keywords"), digest(F.array_join("k", " ")).alias("digest"))


@query
def simplify_query(spark, sf_dir):
    return table(spark, sf_dir, "benchmark").select("item_id", T.simplified(F.col("text")).alias("simple"))


@query
def truncate_words(spark, sf_dir):
    return docs(spark, sf_dir).select("doc_id", T.truncated(F.col("text"), 220).alias("short"))


@query
def digit_density(spark, sf_dir):
    return docs(spark, sf_dir).select("doc_id", F.round(T.digit_density(F.col("text")), 9).alias("density"), T.has_numbers(F.col("text")).alias("has_numbers"))


@query
def strip_front_matter(spark, sf_dir):
    text = F.concat(F.lit("---\nid: "), F.col("doc_id").cast("string"), F.lit("\n---\n\n"), F.col("text"))
    return docs(spark, sf_dir).select("doc_id", digest(T.without_front_matter(text)).alias("body"))


@query
def safe_filename(spark, sf_dir):
    name = F.concat(F.col("p_type"), F.lit("\\"), F.col("p_name"), F.lit(" "), F.col("p_size").cast("string"), F.lit("%.md"))
    return table(spark, sf_dir, "part").select("p_partkey", T.safe_filename(name).alias("name"))


@query
def identifiers(spark, sf_dir):
    rows = table(spark, sf_dir, "customer").select("c_custkey", F.col("c_mktsegment").alias("t"), F.lpad(F.col("c_custkey").cast("string"), 6, "0").alias("n"), (1990 + F.col("c_custkey") % 30).cast("string").alias("y"))
    path = F.concat(F.lit("p"), F.col("c_custkey").cast("string"))
    t, n, y = F.col("t"), F.col("n"), F.col("y")
    return rows.select("c_custkey", T.document_identifier(t, n, y).alias("identifier"), T.source_id(t, n, y).alias("source_id"), T.chunk_key(path, F.col("c_custkey") % 9).alias("chunk_key"), T.standard_key(F.when(F.col("c_custkey") % 2 == 0, path), t, n, y).alias("standard_key"), T.regulatory_id(t, n, y).alias("regulatory_id"), T.bare_number(n).alias("bare"))


@query
def first_filled(spark, sf_dir):
    k = F.col("s_suppkey")
    first = T.first_filled(F.when(k % 3 == 0, F.lit(" ")), F.when(k % 2 == 0, F.col("s_name")))
    asked = F.when(k % 4 == 0, F.lit(" ")).when(k % 4 == 1, F.lit("Todos")).otherwise(F.col("s_name"))
    return table(spark, sf_dir, "supplier").select("s_suppkey", first.alias("first"), T.filter_text(asked).alias("filter"))


@query
def render_markdown_tables(spark, sf_dir):
    cells = F.array(F.col("l_linenumber").cast("string"), F.concat_ws("|", "l_returnflag", "l_linestatus"), F.col("l_extendedprice").cast("decimal(12,2)").cast("string"))
    rows = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.sort_array(F.collect_list(F.struct("l_linenumber", "l_partkey", "l_returnflag", "l_linestatus", "l_extendedprice", cells.alias("c")))).alias("r"))
    body = F.concat(F.array(F.array(*map(F.lit, ("line", "flags", "price")))), F.transform("r", lambda s: s["c"]))
    return rows.select("l_orderkey", T.markdown_table(body).alias("markdown"))


@query
def image_extraction(spark, sf_dir):
    text = F.concat(F.lit("See ![plan](https://host/"), F.col("p_partkey").cast("string"), F.lit(".png) and ![x](local.png)"))
    return table(spark, sf_dir, "part").select("p_partkey", F.inline(T.image_links(text)))


# Structure


@query
def split_structure(spark, sf_dir):
    return P.chunks(spark, sf_dir).select("path", F.col("chunk").cast("long").alias("chunk"), F.col("total_chunks").cast("long").alias("total_chunks"), digest("text").alias("digest"), F.length("text").cast("long").alias("n_chars"))


@query
def parse_headings(spark, sf_dir):
    rows = S.with_structure(S.lines(P.chunks(spark, sf_dir)))
    return rows.where("level is not null or marker is not null").groupBy(F.coalesce("level", F.lit(0)).cast("long").alias("level"), F.coalesce("marker", F.lit("")).alias("marker")).agg(F.count("*").alias("n"), F.min("title").alias("first_title"))


@query
def breadcrumbs(spark, sf_dir):
    return S.breadcrumbs(P.chunks(spark, sf_dir)).select("path", F.col("chunk").cast("long").alias("chunk"), "trail", "header", "continues")


@query
def contextual_chunks(spark, sf_dir):
    chunks = P.chunks(spark, sf_dir)
    rows = chunks.join(S.breadcrumbs(chunks), ["path", "chunk"])
    prefix = S.context_prefix(T.document_identifier(F.col("type"), F.col("number"), F.col("year")), F.col("summary"), F.col("trail"), F.col("header"), F.col("continues"))
    return rows.select("path", F.col("chunk").cast("long").alias("chunk"), prefix.alias("prefix"), digest(F.concat(prefix, F.col("text"))).alias("digest"))


@query
def table_detection(spark, sf_dir):
    return P.chunks(spark, sf_dir).select("path", F.col("chunk").cast("long").alias("chunk"), T.has_table(F.col("text")).alias("has_table"), T.has_numbers(F.col("text")).alias("has_numbers"))


@query
def source_quality(spark, sf_dir):
    return P.chunks(spark, sf_dir).groupBy("quality").agg(F.count("*").alias("n"))


@query
def tabular_share(spark, sf_dir):
    return P.chunks(spark, sf_dir).groupBy("type").agg(F.round(F.avg(T.has_table(F.col("text")).cast("int")), 6).alias("share"), F.count("*").alias("n_chunks"))


@query
def harvest_tables(spark, sf_dir):
    return K.harvest(K.fenced(P.hits(spark, sf_dir))).select("query_id", F.col("n").cast("long").alias("n"), digest("block").alias("digest"))


@query
def recursive_chunks(spark, sf_dir):
    rows = S.chunk_blocks(docs(spark, sf_dir).select("doc_id", "text"))
    return rows.groupBy("doc_id").agg(F.count("*").alias("n_pieces"), F.max(F.length("text")).cast("long").alias("longest"))


# Retrieval


def index(spark, sf_dir):
    """The lexical index, kept by the session: later queries over the same tables find it by its plan."""
    return R.postings(docs(spark, sf_dir), "doc_id").persist()


def weights(spark, sf_dir):
    return R.bm25_weights(index(spark, sf_dir), "doc_id").persist()


@query
def bm25_stats(spark, sf_dir):
    terms, size = R.bm25_statistics(index(spark, sf_dir), "doc_id")
    return size.crossJoin(terms.agg(F.count("*").alias("n_terms"))).select("n_docs", F.round("avgdl", 6).alias("avgdl"), F.round("mean_idf", 6).alias("mean_idf"), "n_terms")


@query
def bm25_terms(spark, sf_dir):
    terms, _ = R.bm25_statistics(index(spark, sf_dir), "doc_id")
    return terms.select("term", "df", F.round("idf", 6).alias("idf"))


@query
def bm25_topk(spark, sf_dir):
    return R.bm25_search(questions(spark, sf_dir), weights(spark, sf_dir), "doc_id", 20)


@query
def bm25_filtered(spark, sf_dir):
    allowed = docs(spark, sf_dir).where(R.metadata_filter(lang="en", source="src1")).select("doc_id")
    return R.bm25_search(questions(spark, sf_dir), weights(spark, sf_dir), "doc_id", 20, allowed)


def query_vectors(spark, sf_dir):
    return table(spark, sf_dir, "embeddings").where("vec_id % 100 = 0")


@query
def dense_topk(spark, sf_dir):
    return R.dense_search(table(spark, sf_dir, "embeddings"), query_vectors(spark, sf_dir), 20)


@query
def dense_filtered(spark, sf_dir):
    return R.dense_search(table(spark, sf_dir, "embeddings").where(R.metadata_filter(label=3)), query_vectors(spark, sf_dir), 10)


@query
def mmr_topk(spark, sf_dir):
    vectors = table(spark, sf_dir, "embeddings")
    near = R.dense_search(vectors, query_vectors(spark, sf_dir), 90).join(vectors.select("vec_id", "embedding"), "vec_id")
    return R.mmr(near, 30)


@query
def keyword_fallback(spark, sf_dir):
    rows = docs(spark, sf_dir).select("doc_id", "lang", "source", "text")
    return R.keyword_search(questions(spark, sf_dir), rows, "doc_id", ["lang", "source", "text"], 30)


def fused_lists(spark, sf_dir):
    asked, weighed = questions(spark, sf_dir), weights(spark, sf_dir)
    full = R.bm25_search(asked, weighed, "doc_id", 30)
    short = R.bm25_search(asked.withColumn("text", T.simplified(F.col("text"))), weighed, "doc_id", 30)
    return [full, short, keyword_fallback(spark, sf_dir)]


@query
def rrf_fusion(spark, sf_dir):
    return R.fuse(fused_lists(spark, sf_dir), "doc_id", k=40)


@query
def hybrid_search(spark, sf_dir):
    """Two BM25 lists and one of keywords, fused, then reranked by content."""
    fused = R.fuse(fused_lists(spark, sf_dir), "doc_id", k=R.candidate_count(15)).withColumnRenamed("rank", "prior")
    words = questions(spark, sf_dir).select("query_id", F.array_distinct(T.keywords(F.col("text"))).alias("words"))
    rows = fused.join(docs(spark, sf_dir).select("doc_id", "text"), "doc_id").join(words, "query_id")
    score = R.rerank_score(F.col("text"), F.col("words"), F.lit("document"), F.lit(False), F.col("score_rrf"), F.lit(False))
    return R.ranked(rows.withColumn("score", F.round(score, 6)), 30, [F.desc("score"), F.col("prior")]).select("query_id", "doc_id", "score", "rank")


def parted(spark, sf_dir):
    """Documents as chunks: eight neighbours are one path."""
    key = F.col("doc_id")
    quality = F.when(F.col("source") == "src1", "structured").when(F.col("source") == "src2", "ocr").otherwise("document")
    path = F.concat(F.lit("doc-"), F.floor(key / 8).cast("string"))
    return docs(spark, sf_dir).select(key.alias("key"), path.alias("path"), (key % 8 + 1).alias("chunk"), "text", quality.alias("quality"), path.alias("norm"))


@query
def full_search(spark, sf_dir):
    """Dense and BM25 lists, named documents, rerank, limits, siblings, auxiliary tables and source order in one plan."""
    asked, chunks, vectors = questions(spark, sf_dir), parted(spark, sf_dir), table(spark, sf_dir, "embeddings")
    lexical = R.bm25_search(asked, weights(spark, sf_dir), "doc_id", R.candidate_count(16)).withColumnRenamed("doc_id", "key")
    asking = vectors.join(asked.select("query_id"), F.col("vec_id") == F.col("query_id"), "left_semi")
    known = vectors.join(docs(spark, sf_dir).select("doc_id"), F.col("vec_id") == F.col("doc_id"), "left_semi")
    dense = R.dense_search(known, asking, R.candidate_count(16), include_self=True).withColumnRenamed("vec_id", "key")
    named = asked.where("query_id % 5 = 0").select("query_id", F.concat(F.lit("doc-"), F.floor(F.col("query_id") / 8).cast("string")).alias("path"))
    key = F.col("doc_id")
    aux = table(spark, sf_dir, "labels").select(F.concat(F.lit("doc-"), F.floor(key / 8).cast("string")).alias("norm"), F.concat(F.lit("Auxiliary "), key.cast("string")).alias("text"), key.alias("ord"), (-key - 1).alias("key"))
    found = R.full_search(asked, chunks, [dense, lexical], named, aux, 16, (1.0, 1.0))
    return found.select("query_id", "rank", "key", digest("text").alias("digest"), "priority", "injected")


@query
def plain_context(spark, sf_dir):
    return K.plain(P.hits(spark, sf_dir)).select("query_id", digest("context").alias("digest"))


@query
def log_lines(spark, sf_dir):
    name = F.concat(F.col("type"), F.lit(" "), F.col("number"), F.lit("/"), F.col("year"))
    line = K.summary_line(F.col("rank"), F.col("text"), F.col("quality"), {"priority": F.col("priority")}, name, F.lit(""), F.col("chunk"), F.col("total_chunks"))
    return P.hits(spark, sf_dir).select("query_id", "rank", digest(line).alias("digest"))


@query
def hit_projection(spark, sf_dir):
    return K.hit_rows(P.hits(spark, sf_dir)).select("query_id", "rank", "type", "number", "year", digest("excerpt").alias("excerpt"), "path", "relevance")


@query
def fallback_ladder(spark, sf_dir):
    full, short, words = fused_lists(spark, sf_dir)
    narrow = full.where("score > 40")
    return R.with_fallback(*[narrow.select("query_id", "doc_id", "rank"), [full.where("score > 20").select("query_id", "doc_id", "rank"), short.select("query_id", "doc_id", "rank")]])


@query
def dedupe_first(spark, sf_dir):
    return R.first_by(docs(spark, sf_dir), ["text"], [F.col("doc_id")]).select("doc_id")


@query
def rerank(spark, sf_dir):
    hits = P.hits(spark, sf_dir).withColumnRenamed("rank", "prior")
    words = F.array(*map(F.lit, ("priority", "anexo", "high", "line")))
    rrf = 1.0 / (R.RRF_K + F.col("prior"))
    score = R.rerank_score(F.col("text"), words, F.col("quality"), F.col("priority"), rrf, T.has_table(F.col("text")))
    return R.ranked(hits.withColumn("score", F.round(score, 6)), None, [F.desc("score"), F.col("prior")]).select("query_id", "key", "score", "rank")


@query
def limit_priority(spark, sf_dir):
    return R.limit_priority(P.hits(spark, sf_dir).select("query_id", "rank", "key", "priority"), 16, "key").select("query_id", "key", "rank")


@query
def limit_quality(spark, sf_dir):
    hits = P.hits(spark, sf_dir).select("query_id", "rank", "key", "priority", (F.col("quality") == "structured").alias("structured"))
    return R.limit_quality(hits, 16, "key").select("query_id", "key", "rank")


@query
def expand_siblings(spark, sf_dir):
    chunks = P.chunks(spark, sf_dir).withColumn("sibling_score", R.sibling_score(F.col("text"), F.lit(""), F.col("quality")))
    hits = P.hits(spark, sf_dir, 16).select("query_id", "rank", "path", "chunk")
    found = R.expand_siblings(hits, chunks.select("path", "chunk", "sibling_score"))
    return found.withColumn("chunk", F.col("chunk").cast("long"))


@query
def inject_aux(spark, sf_dir):
    hits = P.hits(spark, sf_dir, 20).select("query_id", "rank", F.col("type").alias("norm"), "text")
    aux = table(spark, sf_dir, "customer").select(F.col("c_mktsegment").alias("norm"), F.concat(F.lit("Auxiliary "), F.col("c_custkey").cast("string")).alias("text"), F.col("c_custkey").alias("ord"))
    return R.inject(hits, aux).select("query_id", "norm", digest("text").alias("digest"), "injected", "rank")


@query
def prioritize_sources(spark, sf_dir):
    return R.prioritize_sources(P.hits(spark, sf_dir).withColumn("norm", F.col("path"))).select("query_id", "key", "rank")


# Joins and sets


@query
def new_documents_anti(spark, sf_dir):
    return C.new_documents(docs(spark, sf_dir), table(spark, sf_dir, "labels"), "doc_id").select("doc_id")


@query
def semi_structured(spark, sf_dir):
    hits = P.hits(spark, sf_dir)
    return hits.join(hits.where("quality = 'structured'").select("path").distinct(), "path", "left_semi").select("query_id", "key")


@query
def duplicate_upload_check(spark, sf_dir):
    part = table(spark, sf_dir, "part")
    uploads = part.select("p_partkey", F.concat(F.lower("p_name"), F.when(F.col("p_partkey") % 2 == 0, ".PDF").otherwise(".md")).alias("name"), digest("p_brand").alias("sha256"))
    other = F.when(F.col("p_partkey") % 5 == 0, "").otherwise("old ")
    known = part.select(F.concat(other, "p_name", F.lit(".pdf")).alias("name"), digest(F.concat(F.lit("x"), F.col("p_partkey").cast("string"))).alias("sha256"))
    return C.duplicates(uploads, known).select("p_partkey", "name")


@query
def catalog_merge(spark, sf_dir):
    customer = table(spark, sf_dir, "customer")
    recorded = customer.select((F.col("c_custkey") * 2).alias("k"), F.col("c_name").alias("v"))
    found = customer.select((F.col("c_custkey") * 3).alias("k"), F.col("c_mktsegment").alias("v"))
    return C.merge(recorded, found, "k")


# Catalog


def entries(spark, sf_dir):
    k = F.col("c_custkey")
    name = F.when(k % 3 == 0, F.col("c_mktsegment")).otherwise(F.concat("c_mktsegment", F.lit(" "), (k % 4).cast("string")))
    return table(spark, sf_dir, "customer").select(k.alias("ord"), F.col("c_mktsegment").alias("type"), name.alias("name"), F.array(F.lower("c_mktsegment"), F.concat(F.lit("seg "), (k % 6).cast("string"))).alias("aliases"))


@query
def type_catalog(spark, sf_dir):
    return C.type_catalog(entries(spark, sf_dir)).withColumn("aliases", F.array_join("aliases", ", "))


@query
def alias_winner(spark, sf_dir):
    return C.alias_winners(C.type_catalog(entries(spark, sf_dir)))


@query
def detect_references(spark, sf_dir):
    winners = C.alias_winners(C.type_catalog(entries(spark, sf_dir))).orderBy("alias").collect()
    types = F.create_map(*(F.lit(x) for r in winners for x in (r.alias, r.type)))
    orders = table(spark, sf_dir, "orders").join(table(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    key = F.col("o_orderkey").cast("string")
    more = F.when(F.col("o_orderkey") % 2 == 0, F.concat(F.lit(" and seg "), (F.col("o_orderkey") % 6).cast("string"), F.lit(" 1.0"), key, F.lit(" de 1999"))).otherwise("")
    text = F.concat(F.lit("About "), "c_mktsegment", F.lit(" n. "), F.col("o_custkey").cast("string"), F.lit("/"), F.year("o_orderdate").cast("string"), more)
    return orders.select("o_orderkey", F.inline(C.references(text, C.alias_pattern([r.alias for r in winners]), types)))


@query
def valid_years(spark, sf_dir):
    return C.valid_years(P.corpus(spark, sf_dir))


@query
def parse_file_names(spark, sf_dir):
    return P.corpus(spark, sf_dir).select("path").select("path", *(v.alias(k) for k, v in C.parse_file_name(F.col("path")).items()))


# Context


@query
def fenced_context(spark, sf_dir):
    return K.fenced(P.hits(spark, sf_dir)).select("query_id", digest("context").alias("digest"), (F.length("context") + 2).cast("long").alias("size"))


def scored_hits(spark, sf_dir):
    return P.hits(spark, sf_dir).withColumn("score", F.round(K.pack_score(F.col("rank"), F.col("text"), F.col("quality"), F.col("priority"), F.lit(False)), 6))


@query
def pack_score(spark, sf_dir):
    return scored_hits(spark, sf_dir).select("query_id", "key", "score")


@query
def pack_greedy(spark, sf_dir):
    packed = K.pack_greedy(scored_hits(spark, sf_dir), 4000)
    return packed.select("query_id", "rank", "source_id", digest("text").alias("digest"))


@query
def cut_keep_table(spark, sf_dir):
    return P.chunks(spark, sf_dir).select("path", F.col("chunk").cast("long").alias("chunk"), digest(S.cut_keeping_table(F.col("text"), 120)).alias("digest"))


@query
def route_template(spark, sf_dir):
    return docs(spark, sf_dir).select("doc_id", K.template(F.col("text"), F.array().cast("array<string>"), F.array(F.col("text"))).alias("template"))


@query
def failure_classes(spark, sf_dir):
    kind = F.col("event_id") % 5
    message = F.concat(F.lit("Error "), F.col("event_id").cast("string"), F.lit(" "), "event_type", F.when(kind == 0, " Timed out").when(kind == 1, " Billing").when(kind == 2, " Rate limit").otherwise(""))
    return table(spark, sf_dir, "events").select("event_id", K.failure_cause(message).alias("cause"))


@query
def history_window(spark, sf_dir):
    return K.history(table(spark, sf_dir, "conversations"))


# Ingestion: events as a log of states


def newest(spark, sf_dir, n):
    place = F.row_number().over(Window.partitionBy("user_id").orderBy(F.desc("ts"), F.desc("event_id")))
    return table(spark, sf_dir, "events").withColumn("n", place).where(F.col("n") <= n)


@query
def latest_job_state(spark, sf_dir):
    last = F.max_by(F.struct("event_id", "event_type"), F.struct("ts", "event_id"))
    return table(spark, sf_dir, "events").groupBy("user_id").agg(last.alias("s")).select("user_id", "s.*")


@query
def job_states(spark, sf_dir):
    log = table(spark, sf_dir, "events").select(F.col("user_id").alias("job_id"), F.col("event_type").alias("status"), F.col("ts").alias("updated_at"))
    shown = lambda c: F.date_format(c, "yyyy-MM-dd HH:mm:ss").alias(c)
    return I.latest_states(log).select("job_id", "status", shown("updated_at"), shown("created_at"))


@query
def not_indexed(spark, sf_dir):
    """Files whose name, markdown name or content the manifest doesn't know."""
    part, key = table(spark, sf_dir, "part"), F.col("p_partkey")
    content = lambda n: digest(F.concat(F.lit("content "), n.cast("string")))
    files = part.select(F.concat(F.lit("File "), key.cast("string"), F.when(key % 2 == 0, ".PDF").otherwise(".docx")).alias("name"), content(key).alias("sha256"))
    manifest = part.select(F.concat(F.lit("file "), (key * 3).cast("string"), F.when(key % 4 == 0, ".pdf").otherwise(".md")).alias("name"), F.when(key % 5 == 0, "").otherwise(content(key * 7)).alias("sha256"))
    return I.not_indexed(files, manifest).select("name", "sha256")


@query
def header_fields(spark, sf_dir):
    """Act, number and year that a document's head names."""
    key = F.col("o_orderkey")
    act = F.when(key % 4 == 0, "INSTRUÇÃO  NORMATIVA").when(key % 4 == 1, "Resolução").when(key % 4 == 2, "Nota Técnica SEI").otherwise("Anything")
    number = F.when(key % 3 == 0, F.concat(F.lit("1."), F.lpad((key % 1000).cast("string"), 3, "0"))).otherwise(key.cast("string"))
    text = F.concat(F.lit("Ministry\n"), act, F.lit(" No "), number, F.lit(", de "), F.year("o_orderdate").cast("string"), F.lit(" for all"))
    return table(spark, sf_dir, "orders").select("o_orderkey", F.coalesce(C.header_act(text), F.lit("")).alias("act"), C.header_number(text).alias("number"), C.header_year(text).alias("year"))


@query
def stability_check(spark, sf_dir):
    """Events as polls of a user's file, its size the length of the event's type."""
    polls = table(spark, sf_dir, "events").select(F.col("user_id").alias("path"), F.length("event_type").alias("size"), F.lit(0).alias("mtime"), F.struct("ts", "event_id").alias("poll"))
    return I.settled(polls).select(F.col("poll.event_id").alias("event_id"), F.col("path").alias("user_id"), "stable")


@query
def keep_generations(spark, sf_dir):
    return newest(spark, sf_dir, 2).select("user_id", "event_id")


# Evaluation


@query
def coverage(spark, sf_dir):
    items = table(spark, sf_dir, "benchmark")
    cases = items.select(F.col("item_id").alias("case_id"), T.keywords(F.col("text")).alias("expected"))
    return E.coverage_everywhere(cases, docs(spark, sf_dir).select("text"))


@query
def case_metrics(spark, sf_dir):
    hits = P.hits(spark, sf_dir).withColumnRenamed("query_id", "case_id")
    cases = hits.groupBy("case_id").agg(F.min_by(F.when(F.col("rank") > 30, F.col("path")), F.when(F.col("rank") > 30, F.col("rank"))).alias("doc")).withColumn("min_structured", F.col("case_id") % 3)
    return E.case_metrics(cases, hits.where("rank <= 20").select("case_id", "path", "quality"))


def labelled(spark, sf_dir):
    model = F.concat(F.lit("m"), (F.col("doc_id") % 7).cast("string"))
    return table(spark, sf_dir, "labels").select("doc_id", model.alias("model"), "quality", "toxic", (F.col("doc_id") % 10).alias("seconds"))


@query
def model_report(spark, sf_dir):
    return E.model_report(labelled(spark, sf_dir).select("model", F.col("quality").alias("coverage"), "seconds", (F.col("toxic") == 1).alias("error")))


@query
def model_ranking(spark, sf_dir):
    report = labelled(spark, sf_dir).groupBy("model").agg(F.round(F.avg("quality"), 6).alias("mean_coverage"), F.round(F.avg("toxic"), 6).alias("hit_rate"), F.round(F.avg("seconds"), 6).alias("mean_seconds"))
    return E.model_ranking(report).select("model", "place")


@query
def run_summary(spark, sf_dir):
    rows = labelled(spark, sf_dir).join(docs(spark, sf_dir).select("doc_id", "lang", "n_chars"), "doc_id")
    results = rows.select("lang", F.col("quality").alias("coverage"), F.when(F.col("toxic") == 1, (F.col("n_chars") > 1000).cast("int")).alias("hit"), F.when(F.col("quality") == 1, F.col("n_chars") / 1000.0).alias("completeness"))
    return E.run_summary(results, ["lang"])


@query
def reference_text(spark, sf_dir):
    key = F.col("doc_id")
    expected = F.array(F.lit("a"), key.cast("string"))
    doc = F.when(key % 3 != 0, F.concat(F.lit("DOC "), key.cast("string")))
    return table(spark, sf_dir, "labels").select("doc_id", E.reference_text(expected, doc).alias("reference"))


# Minor operators


@query
def group_hits(spark, sf_dir):
    shown = F.transform("parts", lambda p: F.concat(p["chunk"].cast("string"), F.lit("/"), p["total"].cast("string"), F.lit(" "), p["text"]))
    return K.by_source(P.hits(spark, sf_dir)).select("query_id", "source_id", "first", "n", digest(F.array_join(shown, "\n")).alias("digest"), "open")


@query
def filter_options(spark, sf_dir):
    return K.filter_options(P.corpus(spark, sf_dir), ["type", "year"])


@query
def conversation_retention(spark, sf_dir):
    """The last turns of each conversation; those whose text is empty or tells of a failure go."""
    turns = table(spark, sf_dir, "conversations")
    return K.retained(turns, K.is_failure_notice(F.col("text"), ("error", "the"))).select("conv_id", "turn", "role")


@query
def file_entries(spark, sf_dir):
    """Names of each kind that a file may have, and what they say."""
    key = F.col("p_partkey")
    number = key.cast("string")
    path = (
        F.when(key % 5 == 0, F.concat(F.lit("in/RES-000"), number, F.lit("-2024.md"))).when(key % 5 == 1, F.concat(F.lit("in/50500.0124472-"), number, F.lit(".md")))
        .when(key % 5 == 2, F.concat(F.lit("in/A"), number, F.lit("_Nota_Tecnica.md"))).when(key % 5 == 3, F.concat(F.lit("entrada/x_"), number, F.lit(".md"))).otherwise(F.concat(F.lit("extra/a-"), number, F.lit(".md")))
    )
    text = F.concat(F.lit("Resolução No "), number, F.lit(", de 2023"))
    entry = C.file_entry(path, text, F.create_map(F.lit("resolucao"), F.lit("RES")), F.array(F.lit("RES")))
    return table(spark, sf_dir, "part").select("p_partkey", entry.alias("e")).select("p_partkey", "e.*")


@query
def citations(spark, sf_dir):
    """What answers cite: in their section of sources, or anywhere without one."""
    key = F.col("o_orderkey").cast("string")
    free = F.concat(F.lit("Segundo a Resolução "), key, F.lit("/2020, e Documento: RES "), key, F.lit("/2021."))
    section = F.concat(F.lit("A Resolução 5/2020.\nTRECHOS DOS DOCUMENTOS CITADOS: Documento: INM "), key, F.lit("/2023\n### fim"))
    text = F.when(F.col("o_orderkey") % 2 == 0, free).otherwise(section)
    return table(spark, sf_dir, "orders").select("o_orderkey", F.array_join(C.citations(text), "; ").alias("cited"))


# Recognised text


@query
def clean_cells(spark, sf_dir):
    k = F.col("p_partkey") % 8
    value = F.when(k == 0, "None").when(k == 1, "(A)").when(k == 2, "1- EXProD").when(k == 3, F.concat("p_name", F.lit(" x"))).when(k == 4, "7").when(k == 5, "ab").when(k == 6, "--").otherwise(F.col("p_brand"))
    return table(spark, sf_dir, "part").select("p_partkey", O.clean_cell(value).alias("cell"))


@query
def scientific_repair(spark, sf_dir):
    value = F.concat(F.col("l_partkey").cast("string"), F.lit("000"), (F.col("l_linenumber") + 4).cast("string"))
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", value.alias("v"), O.restore_exponent(value).alias("repaired"))


@query
def decimal_repair(spark, sf_dir):
    text = F.concat(F.col("p_size").cast("string"), F.lit(" m/km; "), F.floor((F.col("p_size") * 100 + 1) / 10).cast("string"), F.lit(" units >05"))
    return table(spark, sf_dir, "part").select("p_partkey", O.restore_decimals(text).alias("fixed"))


@query
def ocr_quality(spark, sf_dir):
    noisy = F.regexp_replace("text", r"\| (\d)\.00 \|", "| as /] |")
    rows = P.chunks(spark, sf_dir).withColumn("noisy", noisy)
    return rows.select("path", F.col("chunk").cast("long").alias("chunk"), F.round(O.quality_score(F.col("noisy")), 6).alias("score"), digest(O.repaired(F.col("noisy"))).alias("repaired"))


@query
def best_of_n(spark, sf_dir):
    """Orders as readings of their customer: the first that is good enough, else the best."""
    best = O.best_reading(F.col("o_orderkey"), F.col("o_totalprice") / 500000, F.col("o_orderkey"))
    return table(spark, sf_dir, "orders").groupBy("o_custkey").agg(best.alias("best"))
