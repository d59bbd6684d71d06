"""Document catalogs: types and aliases, references in questions, file names, merging and change detection."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillspark.functions import text as T

FILE_NAME = r"^([A-Za-z]{2,5})-(\d+)-(\d{4})\.md$"
# Names of acts in a header, and their numbers and years, after folding accents.
ACT_NAME = r"(instrucao\s+normativa(?:\s+complementar)?|resolucao|deliberacao|portaria|decreto|lei|voto|consulta|oficio|nota\s+tecnica(?:\s+sei)?|sei)\b"
ACT_NUMBER = r"(?:^|\s)n(?:o|\.)?\s*(\d{1,3}(?:\.\d{3})+|\d+)\b"
ACT_YEAR = r"\b((?:19|20)\d{2})\b"
PROCESS = r"^\d{5}\.\d{7}"
HEADER_CHARS, NUMBER_CHARS = 4000, 1500
# The folder of new files, the mark of technical notes, the type without a folder.
ENTRY_FOLDER, NOTE_MARK, NO_FOLDER = "entrada", "nota_tecnica", "DOC"
# Sections of an answer that cite, and what a citation looks like; the first group is the citation.
CITED_SECTIONS = (
    r"(?idU)TRECHOS DOS DOCUMENTOS CITADOS:([\s\S]+?)(?:$|(?:###|\*\*\*))",
    r"(?idU)FONTES CONSULTADAS:([\s\S]+?)(?:$|(?:###|\*\*\*))",
)
CITATIONS = (
    r"Documento:\s*([A-Za-zçÇáàâãéèêíìîóòôõúùûÁÀÂÃÉÈÊÍÌÎÓÒÔÕÚÙÛ]+\s+\d+\/\d{4})",
    r"Documento:\s*([A-Za-zçÇáàâãéèêíìîóòôõúùûÁÀÂÃÉÈÊÍÌÎÓÒÔÕÚÙÛ]+\s+\d+\s+de\s+\d{4})",
    r"TRECHOS DOS DOCUMENTOS CITADOS:[\s\S]*?(?:\*\*)?Documento:\s*([^\n\"]*\d{4})(?:\*\*)?",
    r"TRECHOS[\s\S]+?(?:\*\*)?([A-Za-zçÇáàâãéèêíìîóòôõúùûÁÀÂÃÉÈÊÍÌÎÓÒÔÕÚÙÛ]+\s+\d+\/\d{4})(?:\*\*)?",
    r"(?:^|\s)(?:a\s+)?([Ii]nstrução\s+[Nn]ormativa\s+(?:n[°º\.]?\s*)?\d+\/?\d*\s*(?:de\s*)?\d{4})",
    r"(?:^|\s)(?:a\s+)?([Rr]esolução\s+(?:n[°º\.]?\s*)?\d+\/?\d*\s*(?:de\s*)?\d{4})",
    r"(?:^|\s)(?:o\s+)?([Vv]oto\s+(?:n[°º\.]?\s*)?\d+\/?\d*\s*(?:de\s*)?\d{4})",
    r"(?:^|\s)(?:a\s+)?([Dd]eliberação\s+(?:n[°º\.]?\s*)?\d+\/?\d*\s*(?:de\s*)?\d{4})",
    r"(?:^|\s)(?:a\s+)?([Pp]ortaria\s+(?:n[°º\.]?\s*)?\d+\/?\d*\s*(?:de\s*)?\d{4})",
    r"([A-Za-zçÇáàâãéèêíìîóòôõúùûÁÀÂÃÉÈÊÍÌÎÓÒÔÕÚÙÛ]+\s+0+(\d+)\/\d{4})",
    r"FONTES CONSULTADAS[\s\S]*?(?:\*\*)?([^\n\"]*\d{4})(?:\*\*)?",
)


def file_name(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def parse_file_name(path: Column) -> dict[str, Column]:
    """type, number without leading zeros and year of TYPE-number-year.md; empty strings otherwise."""
    name = file_name(path)
    return {"type": F.upper(F.regexp_extract(name, FILE_NAME, 1)), "number": T.bare_number(F.regexp_extract(name, FILE_NAME, 2)), "year": F.regexp_extract(name, FILE_NAME, 3)}


def infer_type(path: Column) -> Column:
    """From the file name, else the first path part of two to four capitals."""
    parts = F.filter(F.split(path, "/"), lambda p: p.rlike("^[A-Z]{2,4}$"))
    return F.coalesce(F.nullif(parse_file_name(path)["type"], F.lit("")), F.get(parts, F.lit(0)))


def file_entry(path: Column, text: Column, by_act: Column, allowed: Column, suggested: Column | None = None) -> Column:
    """Struct (title, type, number, year) of a document by its file name, or by what stands in for one.

    TYPE-number-year names say all; a process number is of type SEI, a technical note NT, both with the stem as number; a new
    file is classified by its text; any other takes its folder's name as type.
    """
    name = file_name(path)
    stem, folder = F.regexp_replace(name, r"(?<=.)\.[^.]*$", ""), F.coalesce(F.try_element_at(F.split(path, "/"), F.lit(-2)), F.lit(""))
    regular, new = parse_file_name(path), F.lower(folder) == ENTRY_FOLDER
    by_name = F.when(stem.rlike(PROCESS), F.lit("SEI")).when(F.contains(F.lower(stem), F.lit(NOTE_MARK)), F.lit("NT"))
    by_folder = F.when(folder != "", F.upper(folder)).otherwise(NO_FOLDER)
    text = F.coalesce(text, F.lit(""))
    numbered = lambda kind, number, year: F.concat(kind, F.lit(" "), number, F.when(year != "", F.concat(F.lit("/"), year)).otherwise(""))
    plain_title = F.translate(stem, "_-", " /")
    entry = lambda title, kind, number, year: F.struct(title.alias("title"), kind.alias("type"), number.alias("number"), year.alias("year"))
    kind, number, year = classify(path, text, by_act, allowed, suggested), header_number(text), header_year(text)
    classified = entry(F.when(number != "", numbered(kind, number, year)).otherwise(plain_title), kind, number, year)
    return (
        F.when(regular["type"] != "", entry(numbered(regular["type"], regular["number"], regular["year"]), regular["type"], regular["number"], regular["year"]))
        .when(by_name.isNull() & new, classified)
        .otherwise(entry(plain_title, F.coalesce(by_name, by_folder), stem, F.lit("")))
    )


def header_act(text: Column) -> Column:
    return F.nullif(F.regexp_extract(T.collapse(T.search_normal(F.substring(text, 1, HEADER_CHARS))), ACT_NAME, 1), F.lit(""))


def header_number(text: Column) -> Column:
    return F.regexp_replace(F.regexp_extract(T.search_normal(F.substring(text, 1, NUMBER_CHARS)), ACT_NUMBER, 1), r"\.", "")


def header_year(text: Column) -> Column:
    return F.regexp_extract(T.search_normal(F.substring(text, 1, NUMBER_CHARS)), ACT_YEAR, 1)


def classify(path: Column, text: Column, by_act: Column, allowed: Column, suggested: Column | None = None) -> Column:
    """File name, process number, header act through the catalog's map, then a suggestion; OTHER if not allowed."""
    found = F.coalesce(infer_type(path), F.when(file_name(path).rlike(PROCESS), F.lit("SEI")), F.try_element_at(by_act, header_act(text)), suggested if suggested is not None else F.lit(None).cast("string"))
    return F.when(F.array_contains(allowed, found), found).otherwise(F.lit("OTHER"))


def type_catalog(entries: DataFrame) -> DataFrame:
    """(type, name, aliases, n_docs): documents and aliases together, the longest name first seen.

    entries: type, name, aliases, ord; a name equal to the type counts only where there is no other.
    """
    real = F.when(F.upper("name") != F.col("type"), F.length("name")).otherwise(0)
    return entries.groupBy("type").agg(F.max_by("name", F.struct(real, -F.col("ord"))).alias("name"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("aliases")))).alias("aliases"), F.count("*").alias("n_docs"))


def alias_winners(catalog: DataFrame) -> DataFrame:
    """(alias, type): of types that share an alias the one with most documents, then the first by type."""
    rows = catalog.select("type", "n_docs", F.explode("aliases").alias("alias"))
    rows = rows.withColumn("alias", T.alias_normal(F.col("alias"))).where("alias != ''")
    best = F.row_number().over(Window.partitionBy("alias").orderBy(F.desc("n_docs"), "type"))
    return rows.withColumn("n", best).where("n = 1").select("alias", "type")


def alias_pattern(aliases: list[str]) -> str | None:
    """Alternation of aliases, longest first; None without any. The catalog of types is small and read by the driver."""
    known = sorted({a for a in aliases if a}, key=lambda a: (-len(a), a))
    return "|".join(r"\s+".join(map(re.escape, a.split())) for a in known) or None


def references(question: Column, pattern: str | None, types: Column) -> Column:
    """Array of (type, number, year) named in a question. `types`: map from alias to type.

    There is no word boundary on the left, so a short alias also matches at the end of a longer word.
    """
    if not pattern:
        return F.array().cast("array<struct<type:string,number:string,year:string>>")
    whole = rf"({pattern})\s*(?:n[o.]\s*)?(\d[\d.]*)\s*(?:/|,?\s*de\s+)(\d{{4}})"
    q = T.alias_normal(question)
    group = lambda k: F.regexp_extract_all(q, F.lit(whole), F.lit(k))
    found = F.arrays_zip(group(1).alias("a"), group(2).alias("n"), group(3).alias("y"))
    named = F.transform(found, lambda r: F.struct(F.try_element_at(types, F.regexp_replace(r["a"], r"\s+", " ")).alias("type"), F.replace(r["n"], F.lit("."), F.lit("")).alias("number"), r["y"].alias("year")))
    return F.filter(named, lambda r: r["type"].isNotNull())


def merge(recorded: DataFrame, found: DataFrame, key: str) -> DataFrame:
    """Entries of the record win over those found in the file system."""
    others = [c for c in recorded.columns if c != key]
    r, f = recorded.alias("r"), found.alias("f")
    return r.join(f, F.col(f"r.{key}") == F.col(f"f.{key}"), "full_outer").select(F.coalesce(f"r.{key}", f"f.{key}").alias(key), *(F.when(F.col(f"r.{key}").isNotNull(), F.col(f"r.{c}")).otherwise(F.col(f"f.{c}")).alias(c) for c in others))


def new_documents(current: DataFrame, indexed: DataFrame, key: str) -> DataFrame:
    return current.join(indexed.select(key), key, "left_anti")


def duplicates(uploads: DataFrame, catalog: DataFrame) -> DataFrame:
    """Uploads whose name, stem or content is in the catalog; one equi-join for each rule instead of an OR."""
    stem = lambda c: F.regexp_replace(F.lower(c), r"\.[^.]*$", "")
    hits = [uploads.join(catalog.select(F.lower("name").alias("k")).distinct(), F.lower("name") == F.col("k"), "left_semi"), uploads.join(catalog.select(stem("name").alias("k")).distinct(), stem("name") == F.col("k"), "left_semi"), uploads.join(catalog.select("sha256").distinct(), "sha256", "left_semi")]
    return hits[0].unionByName(hits[1]).unionByName(hits[2]).distinct()


def valid_years(years: DataFrame, column: str = "year") -> DataFrame:
    return years.select(F.trim(F.col(column).cast("string")).alias("year")).where(F.col("year").rlike(r"^(?:19|20)\d{2}$")).distinct()


def citations(text: Column, patterns: list[str] | None = None) -> Column:
    """Distinct citations in order, without emphasis marks: those of the citing sections, or of the whole text if they have none.

    With `patterns`, their whole matches anywhere in the text.
    """

    def within(part: Column) -> Column:
        every = [F.regexp_extract_all(part, F.lit(p), F.lit(0)) for p in patterns] if patterns else [F.regexp_extract_all(part, F.lit(f"(?imdU){p}"), F.lit(1)) for p in CITATIONS]
        return F.filter(F.flatten(F.array(*every)), lambda x: F.trim(x) != "")

    found = within(text)
    if not patterns:
        cited = F.concat(*(within(F.regexp_extract(text, section, 1)) for section in CITED_SECTIONS))
        found = T.let(cited, lambda c: F.when(F.size(c) > 0, c).otherwise(found))
    return F.array_distinct(F.filter(F.transform(found, lambda x: T.collapse(F.translate(x, "*_`", ""))), lambda x: x != ""))
