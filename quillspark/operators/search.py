"""Retrieval over batches of questions: BM25, dense and MMR search, fusion, reranking, limits, expansion.

Ranked lists are DataFrames with `query_id` and `rank` (from 1); equal scores keep the order of the prior rank or key.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillspark.functions import structure as S
from quillspark.functions import text as T
from quillspark.session import cut

K1, B, EPSILON = 1.5, 0.75, 0.25
RRF_K, RRF_WEIGHTS = 60, (1.0, 0.7, 1.0)
CAP = 40
#: Query vectors that meet a batch of vectors at once, and bytes of them that are broadcast for one scan.
QUERY_BLOCK, QUERY_BYTES = 512, 128 << 20
#: Questions whose keywords are held in one block, and words that a worker remembers.
KEYWORD_BLOCK, KNOWN_WORDS = 512, 200_000


def postings(docs: DataFrame, key: str, text: str = "text") -> DataFrame:
    """(key, term, tf, dl) of every document with tokens."""
    rows = docs.select(key, T.tokens(F.col(text)).alias("t")).where(F.size("t") > 0)
    return rows.select(key, F.size("t").alias("dl"), F.explode("t").alias("term")).groupBy(key, "term", "dl").agg(F.count("*").alias("tf"))


def bm25_statistics(index: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """(term, df, idf) and one row of (n_docs, avgdl, mean_idf); a negative idf becomes a share of the mean."""
    size = index.select(key, "dl").distinct().agg(F.count("*").alias("n_docs"), F.avg("dl").alias("avgdl"))
    df = index.groupBy("term").agg(F.count("*").alias("df")).crossJoin(F.broadcast(size))
    raw = df.withColumn("raw", F.log((F.col("n_docs") - F.col("df") + 0.5) / (F.col("df") + 0.5)))
    mean = raw.agg(F.avg("raw").alias("mean_idf"))
    # Both right sides are single rows.
    terms = raw.crossJoin(F.broadcast(mean)).select("term", "df", F.when(F.col("raw") < 0, EPSILON * F.col("mean_idf")).otherwise(F.col("raw")).alias("idf"))
    return terms, size.crossJoin(mean)


def bm25_weights(index: DataFrame, key: str) -> DataFrame:
    """(key, term, w): each posting's contribution to a query that names the term once."""
    terms, size = bm25_statistics(index, key)
    tf = F.col("tf")
    w = F.col("idf") * tf * (K1 + 1) / (tf + K1 * (1 - B + B * F.col("dl") / F.col("avgdl")))
    return index.join(terms, "term").crossJoin(F.broadcast(size.select("avgdl"))).select(key, "term", w.alias("w"))


def question_terms(questions: DataFrame, text: str = "text") -> DataFrame:
    return questions.select("query_id", F.explode(T.tokens(F.col(text))).alias("term")).groupBy("query_id", "term").agg(F.count("*").alias("qtf"))


def ranked(rows: DataFrame, k: int | None, order: list[Column], by: tuple[str, ...] = ("query_id",)) -> DataFrame:
    rows = rows.withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy(*order)))
    return rows.where(F.col("rank") <= k) if k else rows


def bm25_search(questions: DataFrame, weights: DataFrame, key: str, k: int = 30, candidates: DataFrame | None = None) -> DataFrame:
    """(query_id, key, score, rank): documents that share a token with the question, best first.

    `candidates` holds the keys that a filter leaves; a column query_id in it makes the filter the question's own.
    """
    hits = question_terms(questions).join(weights, "term")
    if candidates is not None:
        hits = hits.join(candidates, [c for c in ("query_id", key) if c in candidates.columns], "left_semi")
    scored = hits.groupBy("query_id", key).agg(F.round(F.sum(F.col("qtf") * F.col("w")), 6).alias("score"))
    return ranked(scored, k, [F.desc("score"), F.col(key)])


def metadata_filter(**fields) -> Column:
    """Equality of up to three fields as text; fields that are None say nothing."""
    return reduce(lambda a, b: a & b, [F.col(k).cast("string") == F.lit(str(v)) for k, v in fields.items() if v is not None], F.lit(True))


def dense_search(vectors: DataFrame, queries: DataFrame, k: int, key: str = "vec_id", vector: str = "embedding", include_self: bool = False) -> DataFrame:
    """Exact inner-product search of normalised vectors.

    Query vectors are broadcast, up to QUERY_BYTES of them for a scan of the vectors; more take further scans. They meet the
    vectors in blocks of QUERY_BLOCK. Each partition keeps its own k best of every query, so k rows a query and partition are
    shuffled.
    """
    queries = queries.select(F.col(key).cast("long").alias("query_id"), F.col(vector).cast("array<double>").alias("q"))
    total = queries.count()
    width = queries.agg(F.max(F.size("q"))).first()[0] or 1
    blocks = max(1, -(-total * width * 8 // QUERY_BYTES))
    out = []
    for block in range(blocks):
        rows = queries.where(F.pmod(F.xxhash64("query_id"), F.lit(blocks)) == block).orderBy("query_id").collect()
        if not rows:
            continue
        held = vectors.sparkSession.sparkContext.broadcast((np.array([r.query_id for r in rows]), np.array([r.q for r in rows], np.float64)))

        def best_of(frame, ids, matrix):
            score = matrix @ np.stack(frame["v"].to_numpy()).T.astype(np.float64)
            own = frame[key].to_numpy()
            if not include_self:
                score[ids[:, None] == own[None, :]] = -np.inf
            n = min(k, score.shape[1])
            best = np.argpartition(-score, n - 1, axis=1)[:, :n] if n < score.shape[1] else np.broadcast_to(np.arange(n), score.shape)
            # Candidates that tie with the last one stay, so that ties go by key.
            edge = np.take_along_axis(score, best, 1).min(1)
            i, j = np.nonzero((score >= edge[:, None] - 1e-9) & (score > -np.inf))
            return pd.DataFrame({"query_id": ids[i], key: own[j], "score": score[i, j].round(6)})

        def search(frames, held=held, best_of=best_of):
            ids, matrix = held.value
            kept = pd.DataFrame({"query_id": np.zeros(0, np.int64), key: np.zeros(0, np.int64), "score": np.zeros(0)})
            for frame in frames:
                found = [best_of(frame, ids[b : b + QUERY_BLOCK], matrix[b : b + QUERY_BLOCK]) for b in range(0, len(ids), QUERY_BLOCK)]
                kept = pd.concat([kept, *found]).sort_values(["query_id", "score", key], ascending=[True, False, True]).groupby("query_id").head(k)
            yield kept

        out.append(vectors.select(F.col(key).cast("long").alias(key), F.col(vector).alias("v")).where(F.col("v").isNotNull()).mapInPandas(search, f"query_id long, {key} long, score double"))
    if not out:
        return queries.select("query_id", F.lit(0).cast("long").alias(key), F.lit(0.0).alias("score"), F.lit(0).alias("rank")).limit(0)
    return ranked(reduce(DataFrame.unionByName, out), k, [F.desc("score"), F.col(key)])


def mmr(candidates: DataFrame, k: int, balance: float = 0.7, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """Greedy choice of k candidates a query: balance * relevance - (1 - balance) * likeness to what is chosen.

    candidates: (query_id, key, vector, score); they are a bounded list per query, so each query is one small frame.
    """

    def choose(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values(["score", key], ascending=[False, True]).reset_index(drop=True)
        x, relevance = np.stack(frame[vector].to_numpy()).astype(np.float64), frame["score"].to_numpy()
        alike, nearest, chosen = x @ x.T, np.full(len(frame), -np.inf), []
        for _ in range(min(k, len(frame))):
            value = balance * relevance - (1 - balance) * (nearest if chosen else 0.0)
            value[chosen] = -np.inf
            chosen.append(int(np.argmax(value)))
            nearest = np.maximum(nearest, alike[chosen[-1]])
        return pd.DataFrame({"query_id": frame["query_id"].iloc[0], key: frame[key].iloc[chosen].to_numpy(), "rank": np.arange(1, len(chosen) + 1)})

    return candidates.groupBy("query_id").applyInPandas(choose, f"query_id long, {key} long, rank int")


def fuse(lists: list[DataFrame], key: str, weights: tuple[float, ...] = RRF_WEIGHTS, k: int | None = None) -> DataFrame:
    """Weighted reciprocal ranks: (query_id, key, score_rrf, rank); equal scores keep the order of first sight."""
    rows = [x.select("query_id", key, "rank", F.lit(n).alias("list"), F.lit(w).alias("weight")) for n, (x, w) in enumerate(zip(lists, weights, strict=False))]
    merged = reduce(DataFrame.unionByName, rows).groupBy("query_id", key).agg(F.round(F.sum(F.col("weight") / (RRF_K + F.col("rank"))), 9).alias("score_rrf"), F.min(F.struct("list", "rank")).alias("seen"))
    return ranked(merged, k, [F.desc("score_rrf"), F.col("seen")]).drop("seen")


def first_by(rows: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The first row of each key."""
    return rows.withColumn("__n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("__n = 1").drop("__n")


def rerank_score(text: Column, words: Column, quality: Column, priority: Column, rrf: Column, has_table: Column, technical: Column | None = None) -> Column:
    """Additive relevance of a chunk for a question's distinct keywords."""
    low = F.lower(F.coalesce(text, F.lit("")))
    hits = F.size(F.filter(words, lambda w: F.contains(low, w)))
    articles = F.least(F.regexp_count(text, F.lit(r"(?i)\bArt\.\s*\d+")) * 0.3, F.lit(2.0))
    plus = lambda c, v: F.when(c, F.lit(float(v))).otherwise(0.0)
    share = F.when(F.size(words) > 0, 3.0 * hits / F.size(words)).otherwise(0.0)
    table = T.has_table(text) | F.coalesce(has_table, F.lit(False))
    return hits + share + (plus(technical, 2) if technical is not None else F.lit(0.0)) + plus(has_table, 1) + articles + plus(table, 3) + plus(quality == "structured", 5) - plus(quality == "ocr", 2) + plus(priority, 10) + 100.0 * F.coalesce(rrf, F.lit(0.0))


def limit_priority(rows: DataFrame, k: int, key: str, priority: str = "priority") -> DataFrame:
    """All distinct priority rows, then others up to k in all."""
    w = Window.partitionBy("query_id", priority)
    first = F.row_number().over(Window.partitionBy("query_id", priority, key).orderBy("rank"))
    rows = rows.withColumn("__first", first).where(~F.col(priority) | (F.col("__first") == 1)).drop("__first")
    rows = rows.withColumn("__place", F.row_number().over(w.orderBy("rank"))).withColumn("__n", F.count(F.when(F.col(priority), 1)).over(Window.partitionBy("query_id")))
    rows = rows.where(F.col(priority) | (F.col("__place") <= k - F.col("__n"))).drop("rank", "__n")
    return ranked(rows, None, [F.desc(priority), F.col("__place")]).drop("__place")


def limit_quality(rows: DataFrame, k: int, key: str) -> DataFrame:
    """Up to k rows: priority, then structured or injected, then the rest, with a reserve for the rest.

    rows: query_id, rank, key, priority, structured. Lists of k rows and fewer stay as they are.
    """
    every = Window.partitionBy("query_id")
    rows = rows.withColumn("__all", F.count("*").over(every))
    short = rows.where(F.col("__all") <= k).drop("__all")
    long = first_by(rows.where(F.col("__all") > k), ["query_id", key], [F.col("rank")])
    group = F.when(F.col("priority"), 0).when(F.col("structured"), 1).otherwise(2)
    long = long.withColumn("__g", group).withColumn("__place", F.row_number().over(every.orderBy("__g", "rank"))).withColumn("__kept", F.count(F.when(F.col("__g") < 2, 1)).over(every))
    long = long.withColumn("__base", F.when(F.col("__kept") >= k, F.greatest(F.lit(k - max(2, k // 5)), F.lit(0))).otherwise(F.col("__kept")))
    rest = F.col("__place") - F.col("__kept")
    long = long.where(((F.col("__g") < 2) & (F.col("__place") <= F.col("__base"))) | ((F.col("__g") == 2) & (rest <= k - F.col("__base"))))
    long = ranked(long.drop("rank"), None, [F.col("__place")]).drop("__all", "__g", "__place", "__kept", "__base")
    return short.unionByName(long.select(*short.columns))


def sibling_score(text: Column, section: Column, quality: Column) -> Column:
    sec = T.search_normal(section)
    plus = lambda c, v: F.when(c, F.lit(float(v))).otherwise(0.0)
    return plus(T.has_table(text), 3) + plus(T.has_numbers(text), 1.5) + plus(quality == "structured", 2) - plus(quality == "ocr", 1) + plus(F.contains(sec, F.lit("anexo")) | F.contains(sec, F.lit("tabela")) | F.contains(sec, F.lit("quadro")), 1)


def expand_siblings(hits: DataFrame, chunks: DataFrame, parents: int = 3, each: int = 3, total: int = 8, least: int = 2) -> DataFrame:
    """Tabular chunks of the documents that lead the list: (query_id, path, chunk, sibling_score, added).

    hits: query_id, rank, path, chunk; chunks: path, chunk, sibling_score. The first document always counts, others with
    `least` chunks in the list; then the best siblings each, up to the room below 40.
    """
    seen = hits.where("path != ''").groupBy("query_id", "path").agg(F.count("*").alias("n"), F.min("rank").alias("first"))
    seen = seen.withColumn("place", F.row_number().over(Window.partitionBy("query_id").orderBy("first")))
    seen = seen.where((F.col("place") == 1) | (F.col("n") >= least))
    seen = seen.withColumn("parent", F.row_number().over(Window.partitionBy("query_id").orderBy("first"))).where(F.col("parent") <= parents)
    # Of a path's chunks only the best can come in: those that are added and those that a list below CAP holds already.
    best = F.row_number().over(Window.partitionBy("path").orderBy(F.desc("sibling_score"), "chunk"))
    chunks = chunks.where("sibling_score > 0").withColumn("__best", best).where(F.col("__best") <= each + CAP).drop("__best")
    room = hits.groupBy("query_id").agg(F.greatest(F.least(F.lit(total), CAP - F.count("*")), F.lit(0)).alias("room"))
    found = seen.join(chunks, "path").join(hits.select("query_id", "path", "chunk"), ["query_id", "path", "chunk"], "left_anti")
    found = found.withColumn("n_each", F.row_number().over(Window.partitionBy("query_id", "path").orderBy(F.desc("sibling_score"), "chunk"))).where(F.col("n_each") <= each)
    found = found.withColumn("added", F.row_number().over(Window.partitionBy("query_id").orderBy("parent", "n_each"))).join(room, "query_id").where(F.col("added") <= F.col("room"))
    return found.select("query_id", "path", "chunk", "sibling_score", "added")


def inject(hits: DataFrame, auxiliary: DataFrame, norms: int = 3, each: int = 12, carry: tuple[str, ...] = ()) -> DataFrame:
    """Auxiliary chunks of the first norms in front; originals with one of their texts go: (query_id, rank, norm, text, injected).

    Columns in `carry`, which both sides have, stay too.
    """
    seen = hits.where("norm is not null").groupBy("query_id", "norm").agg(F.min("rank").alias("first"))
    seen = seen.withColumn("n", F.row_number().over(Window.partitionBy("query_id").orderBy("first"))).where(F.col("n") <= norms)
    aux = auxiliary.withColumn("m", F.row_number().over(Window.partitionBy("norm").orderBy("ord"))).where(F.col("m") <= each)
    added = seen.join(aux, "norm").select("query_id", "norm", "text", *carry, F.lit(True).alias("injected"), F.struct(F.lit(0).alias("a"), F.col("n").alias("b"), F.col("m").alias("c")).alias("o"))
    kept = hits.join(added.select("query_id", "text").distinct(), ["query_id", "text"], "left_anti").select("query_id", "norm", "text", *carry, F.lit(False).alias("injected"), F.struct(F.lit(1).alias("a"), F.col("rank").alias("b"), F.lit(0).alias("c")).alias("o"))
    return ranked(added.unionByName(kept), None, [F.col("o")]).drop("o")


def prioritize_sources(hits: DataFrame, quality: str = "quality", norm: str = "norm") -> DataFrame:
    """Structured rows first; recognised ones last where their norm has structured rows too."""
    has = F.max(F.col(quality) == "structured").over(Window.partitionBy("query_id", norm))
    group = F.when(F.col(quality) == "structured", 0).when((F.col(quality) == "ocr") & has, 2).otherwise(1)
    rows = hits.withColumn("__g", group).withColumnRenamed("rank", "__before")
    return ranked(rows, None, [F.col("__g"), F.col("__before")]).drop("__g", "__before")


def full_search(questions: DataFrame, chunks: DataFrame, lists: list[DataFrame], named: DataFrame, auxiliary: DataFrame, k: int = 16, weights: tuple[float, ...] = RRF_WEIGHTS, fallbacks: tuple[DataFrame, ...] = ()) -> DataFrame:
    """(query_id, rank, key, norm, text, quality, priority, injected): the whole search, at most CAP chunks a question.

    questions: query_id, text; chunks: key, path, chunk, text, quality, norm; lists: ranked candidates (query_id, key, rank), as
    dense, MMR and BM25 search give them; named: query_id, path of documents that the question names; auxiliary: norm, text, ord,
    key. Named documents come in whole as priority, then the fused lists; a question with fewer than two chunks takes the first
    of `fallbacks` (ranked lists) that has two. The list is reranked, cut to k, widened by tabular siblings, given the norms'
    auxiliary tables, put in the order of sources and cut to CAP. Keys alone travel until the list is cut; the fused list, the
    kept one and the widened one are written once, as later steps read each of them several times.
    """
    fused = cut(fuse(lists, "key", weights))
    whole = named.join(chunks.select("path", "key", "chunk"), "path").select("query_id", "key", F.lit(True).alias("priority"), F.struct(F.lit(0).alias("a"), F.col("path").alias("b"), F.col("chunk").cast("long").alias("c")).alias("o"))
    rest = fused.select("query_id", "key", F.lit(False).alias("priority"), F.struct(F.lit(1).alias("a"), F.lit("").alias("b"), F.col("rank").cast("long").alias("c")).alias("o"))
    found = ranked(first_by(whole.unionByName(rest), ["query_id", "key"], [F.col("o")]), None, [F.col("o")]).drop("o")
    if fallbacks:
        found = with_fallback(found, [x.select("query_id", "key", F.lit(False).alias("priority"), "rank") for x in fallbacks]).drop("step")
    words = questions.select("query_id", F.array_distinct(T.keywords(F.col("text"))).alias("words"))
    rows = found.withColumnRenamed("rank", "prior").join(fused.select("query_id", "key", "score_rrf"), ["query_id", "key"], "left")
    rows = rows.join(chunks, "key").join(words, "query_id")
    score = rerank_score(F.col("text"), F.col("words"), F.col("quality"), F.col("priority"), F.col("score_rrf"), T.has_table(F.col("text")))
    scored = rows.select("query_id", "key", "path", "chunk", "priority", "prior", F.round(score, 6).alias("score"))
    kept = cut(limit_priority(ranked(scored, None, [F.desc("score"), F.col("prior")]), k, "key").select("query_id", "rank", "key", "path", "chunk", "priority"))
    siblings = chunks.select("path", "chunk", sibling_score(F.col("text"), F.lit(""), F.col("quality")).alias("sibling_score"))
    n = kept.groupBy("query_id").agg(F.max("rank").alias("n"))
    added = expand_siblings(kept, siblings).join(n, "query_id").join(chunks.select("path", "chunk", "key"), ["path", "chunk"])
    every = kept.select("query_id", "rank", "key", "priority").unionByName(added.select("query_id", (F.col("n") + F.col("added")).cast("int").alias("rank"), "key", F.lit(False).alias("priority")))
    every = cut(every.join(chunks.select("key", "norm", "text", "quality"), "key"))
    tables = auxiliary.select("norm", "text", "ord", "key", F.lit(False).alias("priority"), F.lit("structured").alias("quality"))
    ordered = prioritize_sources(inject(every, tables, carry=("key", "priority", "quality")))
    ordered = ordered.withColumn("structured", F.col("injected") | (F.col("quality") == "structured"))
    return limit_quality(ordered, CAP, "key").select("query_id", "rank", "key", "norm", "text", "quality", "priority", "injected")


class Holders(dict):
    """Word -> places of the terms that lie within it; terms have no blanks."""

    def __init__(self, terms: list[bytes]):
        self.place = {t: n for n, t in enumerate(terms)}
        self.lengths = sorted({len(t) for t in terms})

    def __missing__(self, word: bytes) -> tuple[int, ...]:
        found = {self.place.get(word[i : i + n]) for n in self.lengths for i in range(len(word) - n + 1)} - {None}
        if len(self) >= KNOWN_WORDS:
            self.clear()
        self[word] = out = tuple(found)
        return out


def keyword_search(questions: DataFrame, catalog: DataFrame, key: str, fields: list[str], k: int, condition: Column | None = None) -> DataFrame:
    """Without vectors: rows that hold keywords of the question in their fields, most keywords first.

    A keyword counts where it is a substring of the whole fields. Keywords have no blanks, so a row's distinct words say which
    it holds. Questions come in blocks of bounded size, and each partition keeps its own k best of every question.
    catalog: one row a key, which isn't null.
    """
    asked = questions.select("query_id", F.array_distinct(T.keywords(F.col("text"))).alias("words"))
    rows = catalog.where(condition) if condition is not None else catalog
    # Bytes: a UTF-8 substring is one of characters too, and bytes.split() knows the same blanks as the keywords' \s.
    rows = rows.select(key, F.lower(F.concat_ws(" ", *fields)).cast("binary").alias("__text"))
    schema = f"query_id {asked.schema['query_id'].dataType.simpleString()}, {key} {rows.schema[key].dataType.simpleString()}, score long"
    blocks = max(1, -(-asked.count() // KEYWORD_BLOCK))
    out = []
    for block in range(blocks):
        held = [r for r in asked.where(F.pmod(F.xxhash64("query_id"), F.lit(blocks)) == block).orderBy("query_id").collect() if r.words]
        if not held:
            continue
        ids, terms = list(dict.fromkeys(r.query_id for r in held)), sorted({w.encode() for r in held for w in r.words})
        column, place = {q: n for n, q in enumerate(ids)}, {t: n for n, t in enumerate(terms)}
        matrix = np.zeros((len(terms), len(ids)), np.float32)
        for r in held:
            for w in r.words:
                matrix[place[w.encode()], column[r.query_id]] += 1

        def search(batches, ids=ids, terms=terms, matrix=matrix):
            holders, names, step = Holders(terms), pd.Series(ids), max(1, (4 << 20) // len(terms))
            kept = None
            for batch in batches:
                for begin in range(0, batch.num_rows, step):
                    piece = batch.slice(begin, step)
                    piece = piece.take(pc.sort_indices(piece.column(key)))
                    has = np.zeros((piece.num_rows, len(terms)), np.float32)
                    for n, text in enumerate(piece.column("__text").to_pylist()):
                        has[n, list({t for word in set(text.split()) for t in holders[word]})] = 1
                    score = (has @ matrix).astype(np.int32)
                    # Rows are in the order of their keys, which a stable sort keeps among equals.
                    best = np.argsort(-score, axis=0, kind="stable")[:k]
                    top = np.take_along_axis(score, best, 0)
                    i, j = np.nonzero(top > 0)
                    found = pd.DataFrame({"query": j, key: piece.column(key).to_pandas().to_numpy()[best[i, j]], "score": top[i, j].astype(np.int64)})
                    kept = found if kept is None else pd.concat([kept, found])
                    kept = kept.sort_values(["query", "score", key], ascending=[True, False, True]).groupby("query").head(k)
            if kept is not None and len(kept):
                yield pa.RecordBatch.from_pandas(pd.DataFrame({"query_id": names.iloc[kept["query"]].to_numpy(), key: kept[key].to_numpy(), "score": kept["score"].to_numpy()}), preserve_index=False)

        out.append(rows.mapInArrow(search, schema))
    if not out:
        return asked.select("query_id").crossJoin(rows.select(key)).select("query_id", key, F.lit(0).cast("long").alias("score"), F.lit(0).alias("rank")).limit(0)
    return ranked(reduce(DataFrame.unionByName, out), k, [F.desc("score"), F.col(key)])


def with_fallback(primary: DataFrame, fallbacks: list[DataFrame], least: int = 2) -> DataFrame:
    """Each question's rows of the first list that has `least` of them; the last list counts with any number."""
    every = [primary, *fallbacks]
    rows = reduce(DataFrame.unionByName, [x.withColumn("step", F.lit(n)) for n, x in enumerate(every)])
    n = F.count("*").over(Window.partitionBy("query_id", "step"))
    fits = rows.withColumn("fits", (n >= least) | (F.col("step") == len(fallbacks)))
    return fits.withColumn("chosen", F.min(F.when(F.col("fits"), F.col("step"))).over(Window.partitionBy("query_id"))).where("step = chosen").drop("fits", "chosen")


def candidate_count(k: int) -> int:
    return max(3 * k, 45)


def source_class(text: str = "text", section: str = "section") -> Column:
    return S.source_quality(F.col(text), F.col(section), F.lit(None).cast("string"))
