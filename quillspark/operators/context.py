"""From ranked chunks to a bounded context: fences, sizes, structural scores, packing, evidence, routing, history."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillspark.functions import structure as S
from quillspark.functions import text as T

#: Share of the budget that one source may take, and room that fences take around a cut chunk.
SOURCE_SHARE, FENCE_RESERVE = 0.4, 220
BUDGETS = {"local": 24_000, "remote": 50_000}
HARVEST_LIMIT = 14_000
SCOPE = ("Scope: rules, values and forms below hold for this source ONLY.", "Do not use this block to infer duties of other sources.")
# Words that choose a template, after folding accents.
TECHNICAL = "parametro tecnico valor valores limite limites medida metodologia ensaio equipamento tolerancia faixa indice maximo minimo conformidade desempenho criterio criterios indicador indicadores especificacao especificacoes".split()
NORMATIVE = ["resolucao", "instrucao normativa", "deliberacao", "portaria", "regulamento", "normativo", "legal", "direito", "obrigacao", "dever", "prazo", "penalidade", "lei", "decreto", "in"]
NORM_TYPES = ["resolucao", "deliberacao", "portaria", "instrucao normativa", "lei", "decreto"]
LIMIT_WORDS = ["limite", "limites", "valor", "valores", "maximo", "minimo", "tolerancia"]
# Causes of failed calls and what their messages hold, in order of precedence.
FAILURES = (
    ("credential", ("401", "unauthorized", "invalid api key", "no auth credentials")),
    ("credit", ("402", "payment required", "more credits", "insufficient credits", "insufficient_quota", "billing")),
    ("rate_limit", ("429", "rate limit", "too many requests", "quota exceeded")),
    ("too_long", ("context length", "context_length_exceeded", "maximum context", "prompt tokens limit", "too many tokens")),
    ("communication", ("timeout", "timed out", "connection", "network", "unreachable", "temporarily unavailable", "503", "502")),
)


def any_of(text: Column, words) -> Column:
    out = F.lit(False)
    for w in words:
        out = out | F.contains(text, F.lit(w))
    return out


def fenced(hits: DataFrame) -> DataFrame:
    """(query_id, context): sources in order of first sight, chunks within them by rank.

    hits: query_id, rank, source_id, path, chunk, total_chunks, text.
    """
    source = Window.partitionBy("query_id", "source_id")
    rows = hits.withColumn("i", F.row_number().over(source.orderBy("rank"))).withColumn("n", F.count("*").over(source))
    piece = F.concat(F.lit("--- Part "), F.col("i"), F.lit("/"), F.col("n"), F.lit(" (chunk "), F.coalesce(F.col("chunk"), F.col("i")), F.lit("/"), F.coalesce(F.col("total_chunks"), F.col("n")), F.lit(") ---\n"), F.coalesce("text", F.lit("")))
    blocks = rows.groupBy("query_id", "source_id").agg(F.min("rank").alias("first"), F.min_by("path", "rank").alias("path"), F.sort_array(F.collect_list(F.struct("rank", piece.alias("p")))).alias("parts"))
    head = F.concat_ws("\n", F.concat(F.lit("===== SOURCE BEGIN: "), "source_id", F.lit(" =====")), F.concat(F.lit("ID: "), "source_id"), *map(F.lit, SCOPE), F.when(F.coalesce("path", F.lit("")) != "", F.concat(F.lit("Path: "), "path")))
    block = F.concat_ws("\n", head, F.array_join(F.transform("parts", lambda s: s["p"]), "\n"), F.concat(F.lit("===== SOURCE END: "), "source_id", F.lit(" =====")))
    return blocks.groupBy("query_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("first", block.alias("b")))), lambda s: s["b"]), "\n\n").alias("context"))


def source_types(hits: DataFrame, kind: str = "type") -> DataFrame:
    """(query_id, types, counts): distinct types of a context, and chunks of each."""
    per = hits.groupBy("query_id", kind).agg(F.count("*").alias("n"))
    return per.groupBy("query_id").agg(F.sort_array(F.collect_list(kind)).alias("types"), F.map_from_entries(F.sort_array(F.collect_list(F.struct(kind, "n")))).alias("counts"))


def context_size(contexts: DataFrame, instructions: int = 0) -> DataFrame:
    return contexts.select("query_id", (F.lit(instructions) + 2 + F.length("context")).alias("size"))


def pack_score(rank: Column, text: Column, quality: Column, priority: Column, injected: Column) -> Column:
    """rank from 1."""
    plus = lambda c, v: F.when(c, F.lit(float(v))).otherwise(0.0)
    return F.greatest(F.lit(0.0), 21.0 - rank) + plus(priority, 40) + plus(injected, 25) + plus(quality == "structured", 30) - plus(quality == "ocr", 5) + plus(T.has_table(text), 35) + F.least(F.lit(20.0), 100.0 * T.digit_density(text))


def assembled_size(rows: list[dict]) -> int:
    """Length of the fenced context of rows in rank order."""
    groups: dict[str, list[dict]] = {}
    for r in rows:
        groups.setdefault(r["source_id"], []).append(r)
    total = 0
    for name, own in groups.items():
        lines = [f"===== SOURCE BEGIN: {name} =====", f"ID: {name}", *SCOPE]
        if own[0]["path"]:
            lines.append(f"Path: {own[0]['path']}")
        for i, r in enumerate(own, 1):
            lines += [f"--- Part {i}/{len(own)} (chunk {r['chunk']}/{r['total_chunks']}) ---", r["text"] or ""]
        lines.append(f"===== SOURCE END: {name} =====")
        total += sum(map(len, lines)) + len(lines) - 1
    return total + 2 * max(0, len(groups) - 1)


def pack(rows: list[dict], limit: int, overhead: int = 0, share: float = SOURCE_SHARE) -> list[dict]:
    """Greedy choice by score within the budget; the list itself where all fits. rows: in rank order, with a score."""
    size = lambda x: overhead + 2 + assembled_size(x)
    if not rows or size(rows) <= limit:
        return rows
    cap = max(1, int(limit * (share if 0 < share <= 1 else SOURCE_SHARE)))
    chosen, used = [], {}
    for k in sorted(range(len(rows)), key=lambda k: (-rows[k]["score"], k)):
        source, length = rows[k]["source_id"], len(rows[k]["text"] or "")
        if used.get(source, 0) > 0 and used[source] + length > cap:
            continue
        if size([rows[j] for j in sorted([*chosen, k])]) <= limit:
            chosen.append(k)
            used[source] = used.get(source, 0) + length
    if chosen:
        return [rows[k] for k in sorted(chosen)]
    best = max(range(len(rows)), key=lambda k: (rows[k]["score"], -k))
    room = max(1, max(1, limit - overhead - 2) - FENCE_RESERVE)
    return [rows[best] | {"text": cut(rows[best]["text"] or "", room)}]


def cut(text: str, limit: int) -> str:
    if len(text) <= limit:
        return text
    kept, n = [], 0
    for line in (x for x in text.split("\n") if x.strip().startswith("|")):
        n += len(line) + (1 if kept else 0)
        if n > limit:
            break
        kept.append(line)
    return "\n".join(kept) if kept else text[:limit]


def pack_greedy(hits: DataFrame, limit: int, overhead: int = 0) -> DataFrame:
    """(query_id, rank, source_id, path, chunk, total_chunks, text) that go into each context.

    The fold depends on what was chosen before, so each question's list (40 rows at most) is one small frame.
    """
    columns = ["query_id", "rank", "source_id", "path", "chunk", "total_chunks", "text"]

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        rows = frame.sort_values("rank").to_dict("records")
        return pd.DataFrame(pack(rows, limit, overhead), columns=[*columns, "score"])[columns]

    return hits.select(*columns, F.col("score").cast("double").alias("score")).groupBy("query_id").applyInPandas(run, "query_id long, rank int, source_id string, path string, chunk int, total_chunks int, text string")


def harvest(contexts: DataFrame, limit: int = HARVEST_LIMIT) -> DataFrame:
    """(query_id, n, block): tables of a context with their titles, until their lengths pass `limit` together."""
    rows = contexts.select("query_id", F.posexplode(F.split("context", "\n")).alias("n", "line"))
    named = F.last(F.when(F.startswith("line", F.lit("===== SOURCE BEGIN: ")), F.regexp_extract("line", "^===== SOURCE BEGIN: (.*) =====$", 1)), ignorenulls=True)
    rows = rows.withColumn("source", named.over(Window.partitionBy("query_id").orderBy("n")))
    runs = S.table_runs(rows, ["query_id"]).join(rows.select("query_id", F.col("n").alias("first"), "source"), ["query_id", "first"])
    block = F.concat_ws("\n", F.concat(F.lit("[Source: "), "source", F.lit("]")), "block")
    runs = runs.withColumn("block", block).withColumn("n", F.row_number().over(Window.partitionBy("query_id").orderBy("first")))
    so_far = F.sum(F.length("block")).over(Window.partitionBy("query_id").orderBy("first"))
    return runs.withColumn("so_far", so_far).where((F.col("so_far") <= limit) | (F.col("n") == 1)).select("query_id", "n", "block")


def merge_evidence(tables: Column, written: Column, nothing: str = "NO_EVIDENCE") -> Column:
    """Tables first, then what was written unless it says that there is nothing."""
    text = F.trim(F.coalesce(written, F.lit("")))
    return F.concat_ws("\n\n", F.nullif(F.coalesce(tables, F.lit("")), F.lit("")), F.when((text != "") & ~F.contains(text, F.lit(nothing)), text))


def template(question: Column, types: Column, context_texts: Column) -> Column:
    """parameters, normative or answer."""
    q = T.ascii_normal(question)
    kinds = F.transform(types, T.ascii_normal)
    technical = any_of(q, TECHNICAL) | (F.contains(F.array_join(kinds, " "), F.lit("instrucao normativa")) & F.contains(q, F.lit("parametro")))
    normative = any_of(q, NORMATIVE) | F.arrays_overlap(kinds, F.array(*map(F.lit, NORM_TYPES)))
    tables = F.exists(context_texts, lambda x: F.contains(x, F.lit("| --- |")) | x.rlike(r"\d+[,.]?\d*E[+\-]?\d+") | x.rlike(r"\d+\s+\d+\s+\d+"))
    limits = any_of(q, TECHNICAL) | any_of(q, LIMIT_WORDS)
    return F.when(technical, "parameters").when(normative, "normative").when(tables & limits, "parameters").otherwise("answer")


def failure_cause(message: Column) -> Column:
    low, out = F.lower(F.coalesce(message, F.lit(""))), F.lit("unknown")
    for cause, marks in reversed(FAILURES):
        out = F.when(any_of(low, marks), F.lit(cause)).otherwise(out)
    return out


def is_failure_notice(text: Column, notices: tuple[str, ...]) -> Column:
    low = F.lower(F.trim(F.coalesce(text, F.lit(""))))
    return (low == "") | any_of(low, notices)


def hit_view(text: Column, length: int = 500) -> Column:
    return F.substring(F.coalesce(text, F.lit("")), 1, length)


def hit_rows(hits: DataFrame, length: int = 500) -> DataFrame:
    """(query_id, rank, type, number, year, excerpt, path, relevance): texts as excerpts, what is missing empty or 0."""
    shown = [F.trim(F.coalesce(F.col(c).cast("string"), F.lit(""))).alias(c) for c in ("type", "number", "year")]
    known = F.col("score").cast("double") if "score" in hits.columns else F.lit(None).cast("double")
    return hits.select("query_id", "rank", *shown, hit_view(F.col("text"), length).alias("excerpt"), F.coalesce("path", F.lit("")).alias("path"), F.coalesce(known, F.lit(0.0)).alias("relevance"))


def plain(hits: DataFrame) -> DataFrame:
    """(query_id, context): texts by rank with an empty line between them."""
    rows = hits.groupBy("query_id").agg(F.sort_array(F.collect_list(F.struct("rank", F.coalesce("text", F.lit("")).alias("t")))).alias("l"))
    return rows.select("query_id", F.array_join(F.transform("l", lambda s: s["t"]), "\n\n").alias("context"))


def summary_line(place: Column, text: Column, quality: Column, marks: dict[str, Column], name: Column, section: Column, chunk: Column, total: Column) -> Column:
    """Three lines for a log: what a chunk is with its marks, its section, the start of its text without a context prefix."""
    text = F.coalesce(text, F.lit(""))
    body = F.regexp_replace(text, r"^\[[^\n]*\]\n", "")
    named = [F.when(F.coalesce(c, F.lit(False)), F.lit(m)) for m, c in marks.items()]
    named += [F.when(T.has_table(text), F.lit("table")), F.when(quality != "document", quality)]
    flags = F.concat_ws(", ", *named)
    unknown = lambda c: F.coalesce(c.cast("string"), F.lit("?"))
    head = F.concat(F.lit("chunk["), place.cast("string"), F.lit("] "), unknown(name), F.lit(" part "), unknown(chunk), F.lit("/"), unknown(total), F.lit(" ("), F.length(text).cast("string"), F.lit(" chars)"), F.when(flags != "", F.concat(F.lit(" ["), flags, F.lit("]"))).otherwise(""))
    where = F.substring(F.coalesce(F.nullif(section, F.lit("")), F.lit("-")), 1, 140)
    return F.concat_ws("\n", head, F.concat(F.lit("  section: "), where), F.concat(F.lit("  text: "), F.replace(F.substring(body, 1, 120), F.lit("\n"), F.lit(" ")), F.lit("...")))


def by_source(hits: DataFrame, opened: int = 3) -> DataFrame:
    """(query_id, source_id, first, n, parts, open): a result list by source in order of first sight, the first ones open."""
    part = F.struct("rank", "chunk", F.col("total_chunks").alias("total"), "text")
    rows = hits.groupBy("query_id", "source_id").agg(F.min("rank").alias("first"), F.count("*").alias("n"), F.sort_array(F.collect_list(part)).alias("parts"))
    place = F.row_number().over(Window.partitionBy("query_id").orderBy("first"))
    return rows.withColumn("open", place <= opened)


def filter_options(rows: DataFrame, fields: list[str], every: str = "Todos") -> DataFrame:
    """(field, value): the distinct values of each field in one pass, and one value for all of them."""
    pairs = F.array(*(F.struct(F.lit(c).alias("field"), F.col(c).cast("string").alias("value")) for c in fields))
    found = rows.select(F.inline(pairs)).where("coalesce(value, '') != ''").distinct()
    return found.unionByName(rows.sparkSession.createDataFrame([(c, every) for c in fields], "field string, value string"))


def retained(turns: DataFrame, failed: Column, last: int = 10) -> DataFrame:
    """The last turns of each conversation; those that failed aren't kept and don't count."""
    back = F.row_number().over(Window.partitionBy("conv_id").orderBy(F.desc("turn"), F.desc("role"), F.desc("text")))
    return turns.where(~F.coalesce(failed, F.lit(False))).withColumn("__back", back).where(F.col("__back") <= last).drop("__back")


def history(turns: DataFrame, last: int = 8, length: int = 1000) -> DataFrame:
    """(conv_id, history): the last turns, each cut, in order."""
    rows = turns.withColumn("back", F.row_number().over(Window.partitionBy("conv_id").orderBy(F.desc("turn"), F.desc("role"), F.desc("text")))).where(F.col("back") <= last)
    line = F.concat(F.col("role"), F.lit(": "), F.left(F.coalesce("text", F.lit("")), F.lit(length)))
    return rows.groupBy("conv_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct((-F.col("back")).alias("b"), line.alias("t")))), lambda s: s["t"]), "\n").alias("history"))
