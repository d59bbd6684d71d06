"""Structure of markdown documents: blocks, headings, markers, breadcrumbs, context prefixes, tables, source classes."""

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillspark.functions import text as T

# What opens a block. Matching ignores case; accents are folded only with fold=True.
BLOCK_STARTS = r"Art\.\s*\d|CAPITULO\s|SECAO\s|TITULO\s|ANEXO\s|##\s|###\s"
BLOCK_SPLIT = rf"(?i)(?=\n\s*(?:{BLOCK_STARTS}))"
HEADING = r"^\s{0,3}(#{1,6})\s+(.+?)\s*#*\s*$"
MARKER = r"^\s*(?:anexo\b|apendice\b|capitulo\s+[ivxlcdm0-9]|secao\s+[ivxlcdm0-9]|subsecao\s+[ivxlcdm0-9]|titulo\s+[ivxlcdm0-9]|tabela\s+[0-9ivxlcdm]|quadro\s+[0-9ivxlcdm])"
MARKER_LENGTH, HEADER_LENGTH, TRAIL_LENGTH, SUMMARY_LENGTH, TRAIL_LEVELS = 90, 220, 240, 220, 4
# Marks that merged tables and recognised images leave in a text.
STRUCTURED_MARKS = ("tabelas auxiliares estruturadas", "transcricao estruturada", "transcricao)")
OCR_MARKS = ("anexo ocr",)


def blocks(text: Column, fold: bool = False) -> Column:
    """Trimmed blocks; a text that doesn't split stays as it is, untrimmed."""
    pattern = BLOCK_SPLIT.replace("CAPITULO", "CAP[IÍ]TULO").replace("SECAO", "SE[CÇ][AÃ]O").replace("TITULO", "T[IÍ]TULO") if fold else BLOCK_SPLIT
    found = F.filter(F.transform(F.split(text, pattern), lambda b: F.regexp_replace(b, r"^\s+|\s+$", "")), lambda b: b != "")
    return F.when(F.size(found) <= 1, F.array(text)).otherwise(found)


def recursive_split(text: str, size: int = 1500, overlap: int = 200, separators: tuple[str, ...] = ("\n\n", "\n", ". ", " ")) -> list[str]:
    """Pieces of at most `size` characters where the separators allow; neighbours share up to `overlap` characters.

    A text is cut at the first separator it holds; parts that are still too long are cut by the next ones; small parts
    are joined while they fit.
    """
    if len(text) <= size:
        return [text] if text.strip() else []
    separator = next((s for s in separators if s in text), None)
    if separator is None:
        step = max(1, size - overlap)
        return [text[k : k + size] for k in range(0, max(1, len(text) - overlap), step)]
    rest = separators[separators.index(separator) + 1 :]
    out, held, length = [], [], 0

    def flush() -> None:
        if held and separator.join(held).strip():
            out.append(separator.join(held).strip())

    for part in text.split(separator):
        if len(part) > size:
            flush()
            held, length = [], 0
            out += recursive_split(part, size, overlap, rest)
            continue
        if held and length + len(separator) + len(part) > size:
            flush()
            while held and (length > overlap or length + len(separator) + len(part) > size):
                length -= len(held[0]) + (len(separator) if len(held) > 1 else 0)
                del held[0]
        length += len(part) + (len(separator) if held else 0)
        held.append(part)
    flush()
    return out


def chunk_blocks(docs: DataFrame, size: int = 1500, overlap: int = 200, text_col: str = "text") -> DataFrame:
    """Blocks by structure, then by size: tables up to three times the size stay whole, other long blocks are cut."""

    @F.pandas_udf("array<string>")
    def cut(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: recursive_split(t or "", size, overlap))

    # One row per block, so that only long blocks go to Python.
    rows = docs.select("*", F.posexplode_outer(blocks(F.col(text_col))).alias("block", "__b"))
    table = F.contains("__b", F.lit("| --- |")) | (F.size(F.filter(F.split("__b", "\n"), lambda x: F.startswith(F.trim(x), F.lit("|")))) >= 2)
    whole = (F.length("__b") <= size) | (table & (F.length("__b") <= 3 * size))
    short = rows.where(F.coalesce(whole, F.lit(True))).withColumn("piece", F.lit(0))
    long = rows.where(~whole).select(*rows.columns[:-1], F.posexplode(cut("__b")).alias("piece", "__b")).select(*rows.columns, "piece")
    return short.unionByName(long).withColumn(text_col, F.col("__b")).drop("__b")


def numbered(chunks: DataFrame, path: str = "path", order: tuple[str, ...] = ("block",)) -> DataFrame:
    """chunk from 1 and total_chunks, by document."""
    w = Window.partitionBy(path)
    return chunks.withColumn("chunk", F.row_number().over(w.orderBy(*order))).withColumn("total_chunks", F.count("*").over(w))


def lines(chunks: DataFrame, path: str = "path", chunk: str = "chunk", text: str = "text") -> DataFrame:
    """(path, chunk, at, line): lines of a document numbered across its chunks; `at` sorts them."""
    rows = chunks.select(path, chunk, F.posexplode(F.split(text, "\n")).alias("n", "line"))
    return rows.select(path, chunk, F.struct(F.col(chunk).alias("c"), "n").alias("at"), "line")


def with_structure(rows: DataFrame) -> DataFrame:
    """Adds heading level and title, marker, table flags and the text of a table's header line."""
    level = F.length(F.regexp_extract("line", HEADING, 1))
    said = F.when(level > 0, F.trim(F.regexp_extract("line", HEADING, 2))).otherwise(F.col("line"))
    marker = F.when(T.search_normal(said).rlike(MARKER), T.truncated(F.regexp_replace(said, r"^[# ]+|[# ]+$", ""), MARKER_LENGTH))
    return rows.withColumns({"level": F.when(level > 0, level), "title": F.nullif(F.trim(F.regexp_extract("line", HEADING, 2)), F.lit("")), "marker": marker, "is_table": T.is_table_line(F.col("line")), "is_rule": F.col("line").rlike(T.SEPARATOR_ROW)})


def breadcrumbs(chunks: DataFrame, path: str = "path", chunk: str = "chunk", text: str = "text") -> DataFrame:
    """(path, chunk, trail, header, continues): state carried from chunk to chunk of a document, as windows.

    A heading closes those of its own and deeper levels: level k is open if its last heading is later than the last one
    of every level above it. The trail is that of the chunk's last line.
    """
    rows = with_structure(lines(chunks, path, chunk, text))
    so_far = Window.partitionBy(path).orderBy("at").rowsBetween(Window.unboundedPreceding, 0)
    filled = F.when(F.trim("line") != "", F.struct("at", "line", "is_table"))
    # A header line stands in the same chunk as its rule.
    before = F.last(filled, ignorenulls=True).over(Window.partitionBy(path, chunk).orderBy("at").rowsBetween(Window.unboundedPreceding, -1))
    state = {f"h{k}": F.last(F.when(F.col("level") == k, F.struct("at", F.col("title").alias("t"))), ignorenulls=True).over(so_far) for k in range(1, 7)}
    state["m"] = F.last(F.when(F.col("marker").isNotNull(), F.col("marker")), ignorenulls=True).over(so_far)
    state["prior"] = before
    rows = rows.withColumns(state)
    cells = lambda x: F.replace(F.regexp_replace(F.trim(x), r"^\|+|\|+$", ""), F.lit("|"), F.lit("; "))
    rows = rows.withColumn("opened", F.when(F.col("is_rule") & F.col("prior.is_table"), T.truncated(cells(F.col("prior.line")), HEADER_LENGTH)))
    rows = rows.withColumn("header", F.last("opened", ignorenulls=True).over(so_far))
    first = F.min(F.when(F.trim("line") != "", F.struct("at", "is_table")))
    per = rows.groupBy(path, chunk).agg(F.max_by(F.struct(*(f"h{k}" for k in range(1, 7)), "m", "header"), "at").alias("s"), first.alias("first"), F.max(F.col("opened").isNotNull()).alias("opens"))
    open_ = []
    for k in range(1, 7):
        later = [F.coalesce(F.col(f"s.h{k}.at") > F.col(f"s.h{j}.at"), F.col(f"s.h{j}").isNull()) for j in range(1, k)]
        keep = F.col(f"s.h{k}").isNotNull()
        for cond in later:
            keep = keep & cond
        open_.append(F.when(keep, F.col(f"s.h{k}.t")))
    trail = F.array_distinct(F.array_compact(F.array(*open_, F.col("s.m"))))
    trail = F.slice(trail, F.greatest(F.size(trail) - TRAIL_LEVELS + 1, F.lit(1)), F.lit(TRAIL_LEVELS))
    return per.select(path, chunk, T.truncated(F.array_join(trail, " > "), TRAIL_LENGTH).alias("trail"), F.coalesce(F.col("s.header"), F.lit("")).alias("header"), F.coalesce(F.col("first.is_table") & ~F.col("opens"), F.lit(False)).alias("continues"))


def context_prefix(identifier: Column, summary: Column, trail: Column, header: Column, continues: Column) -> Column:
    """One bracketed line; empty parts are left out."""
    part = lambda name, value: F.when(F.coalesce(value, F.lit("")) != "", F.concat(F.lit(f"{name}: "), value))
    inner = F.concat_ws(" | ", part("Document", identifier), part("Subject", T.truncated(summary, SUMMARY_LENGTH)), part("Section", trail), F.when(continues & (header != ""), F.concat(F.lit("Table continued: "), header)))
    return F.when(inner != "", F.concat(F.lit("["), inner, F.lit("]\n"))).otherwise(F.lit(""))


def source_quality(text: Column, section: Column, recorded: Column) -> Column:
    """structured, ocr or document; a recorded class wins."""
    known = F.lower(F.trim(F.coalesce(recorded, F.lit(""))))

    def any_in(c: Column, marks: tuple[str, ...]) -> Column:
        out = F.lit(False)
        for m in marks:
            out = out | F.contains(c, F.lit(m))
        return out

    def by_marks(x: Column) -> Column:
        body, sec = x["body"], x["sec"]
        merged = F.contains(sec, F.lit("anexo -")) & ~F.contains(sec, F.lit("ocr")) & T.has_table(text) & (F.contains(text, F.lit("| ---")) | F.contains(F.replace(text, F.lit(" "), F.lit("")), F.lit("|---|")))
        return F.when(any_in(body, STRUCTURED_MARKS), "structured").when(merged, "structured").when(any_in(sec, OCR_MARKS) | any_in(body, OCR_MARKS), "ocr").otherwise("document")

    folded = F.struct(T.search_normal(text).alias("body"), T.search_normal(section).alias("sec"))
    return F.when(known.isin("structured", "ocr", "document"), known).otherwise(T.let(folded, by_marks))


def table_runs(rows: DataFrame, keys: list[str], order: str = "n", line: str = "line") -> DataFrame:
    """Longest runs of table lines with up to three title lines above: (keys, run, first, last, block).

    Titles are the lines directly above; a table line or one of 120 and more characters that is no heading ends them.
    """
    w = Window.partitionBy(*keys).orderBy(order)
    flagged = rows.withColumn("t", T.is_table_line(F.col(line)))
    flagged = flagged.withColumn("starts", F.col("t") & ~F.coalesce(F.lag("t").over(w), F.lit(False)))
    flagged = flagged.withColumn("run", F.sum(F.col("starts").cast("int")).over(w))
    title = lambda k: F.struct(F.lag(line, k).over(w).alias("x"), F.lag("t", k).over(w).alias("t"))
    flagged = flagged.withColumns({f"up{k}": title(k) for k in (1, 2, 3)})
    fits = lambda s: s["x"].isNotNull() & ~s["t"] & ((F.length(s["x"]) < 120) | F.startswith(F.trim(s["x"]), F.lit("#")))
    one, two, three = (F.col(f"up{k}") for k in (1, 2, 3))
    titles = F.when(fits(one) & fits(two) & fits(three), F.array(three["x"], two["x"], one["x"])).when(fits(one) & fits(two), F.array(two["x"], one["x"])).when(fits(one), F.array(one["x"])).otherwise(F.array().cast("array<string>"))
    flagged = flagged.withColumn("titles", F.when(F.col("starts"), titles))
    runs = flagged.where("t").groupBy(*keys, "run").agg(F.min(order).alias("first"), F.max(order).alias("last"), F.max("titles").alias("titles"), F.sort_array(F.collect_list(F.struct(order, line))).alias("l"))
    text = F.array_join(F.concat("titles", F.transform("l", lambda s: s[line])), "\n")
    return runs.select(*keys, "run", "first", "last", F.regexp_replace(text, r"^\s+|\s+$", "").alias("block"))


def cut_keeping_table(text: Column, limit: int) -> Column:
    """The leading table lines that fit `limit`, where the text has any table line that fits; else its first characters."""
    rows = F.filter(F.split(text, "\n"), lambda x: F.startswith(F.trim(x), F.lit("|")))
    state = lambda kept, n, full: F.struct(kept.alias("kept"), n.alias("n"), full.alias("full"))
    cost = lambda s, x: F.length(x) + F.when(F.size(s["kept"]) > 0, 1).otherwise(0)
    grown = F.aggregate(
        rows, state(F.array().cast("array<string>"), F.lit(0), F.lit(False)),
        lambda s, x: F.when(s["full"] | (s["n"] + cost(s, x) > limit), state(s["kept"], s["n"], F.lit(True))).otherwise(state(F.array_append(s["kept"], x), s["n"] + cost(s, x), F.lit(False))),
        lambda s: s["kept"],
    )
    return F.when(F.length(text) <= limit, text).when(F.size(grown) > 0, F.array_join(grown, "\n")).otherwise(F.substring(text, 1, limit))
