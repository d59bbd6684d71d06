"""Small pieces around a search: parameter bounds, budgets, templates, models, path-restricted search, direct loading."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillspark.functions import structure as S
from quillspark.functions import text as T
from quillspark.operators import search as R
from quillspark.operators.context import BUDGETS

# What names of local models hold.
LOCAL_MARKS = ("ollama", "llama3", "qwen2.5", "phi3")
PATH_QUESTION, PATH_K = "conteúdo completo do documento", 50


@dataclass(frozen=True)
class Parameters:
    k: int = 30
    temperature: float = 0.1
    max_tokens: int = 1024

    def __post_init__(self):
        for name, least, most in (("k", 1, 40), ("temperature", 0, 1), ("max_tokens", 1, 4096)):
            value = getattr(self, name)
            if isinstance(value, bool) or not least <= value <= most:
                raise ValueError(f"{name} must lie between {least} and {most}")


def is_local_model(name: Column) -> Column:
    low = F.lower(F.coalesce(name, F.lit("")))
    out = F.lit(False)
    for mark in LOCAL_MARKS:
        out = out | F.contains(low, F.lit(mark))
    return out


def context_budget(provider: str, override: int | None = None) -> int:
    return override if override and override > 0 else BUDGETS["local" if provider in ("local", "ollama") else "remote"]


def choose_model(wanted: str | None, offered: list[str]) -> str:
    """The wanted model where the provider has it, else its first."""
    if not offered:
        raise ValueError("no model is offered")
    return wanted if wanted in offered else offered[0]


def template_for(templates: DataFrame, asked: DataFrame, default_family: str = "default") -> DataFrame:
    """(kind, family, template): the family's template of that kind, or the default family's."""
    own = templates.select("kind", "family", "template")
    base = own.where(F.col("family") == default_family).select("kind", F.col("template").alias("base"))
    return asked.join(own, ["kind", "family"], "left").join(base, "kind", "left").select("kind", "family", F.coalesce("template", "base").alias("template"))


def resolve_references(references: DataFrame, catalog: DataFrame) -> DataFrame:
    """(query_id, path, friendly) of the catalog's documents that a question names; numbers compare without zeros."""
    r = references.select("query_id", "type", T.bare_number(F.col("number")).alias("number"), "year").distinct()
    c = catalog.select("type", T.bare_number(F.col("number")).alias("number"), "year", "path")
    return r.join(c, ["type", "number", "year"]).select("query_id", "path", T.document_identifier(F.col("type"), F.col("number"), F.col("year")).alias("friendly"))


def priority_chunks(resolved: DataFrame, chunks: DataFrame) -> DataFrame:
    """All chunks of the documents that questions name, marked as priority, in document order."""
    rows = resolved.join(chunks, "path").withColumn("priority", F.lit(True))
    return R.ranked(rows, PATH_K, [F.col("path"), F.col("chunk")], ("query_id", "path"))


def path_search(vectors: DataFrame, queries: DataFrame, path: str, k: int = PATH_K) -> DataFrame:
    """Dense search within one document; hits are priority."""
    return R.dense_search(vectors.where(F.col("path") == path), queries, k).withColumn("priority", F.lit(True))


def load_document(documents: DataFrame, path: str, size: int = 1500, overlap: int = 200) -> DataFrame:
    """The chunks of one document straight from its text, as priority, with the number padded."""
    rows = S.numbered(S.chunk_blocks(documents.where(F.col("path") == path), size, overlap), order=("block", "piece")).drop("block", "piece")
    return rows.withColumns({"priority": F.lit(True), "number": T.padded(F.col("number"))})


def locate(catalog: DataFrame, asked: DataFrame) -> DataFrame:
    """First file by path for each (type, number, year)."""
    keys = ["type", "number", "year"]
    bare = lambda df: df.withColumn("number", T.bare_number(F.col("number")))
    return bare(asked).join(bare(catalog).groupBy(*keys).agg(F.min("path").alias("path")), keys, "left")


def experiment_corpus(catalog: DataFrame, critical: list[str], others: int) -> DataFrame:
    """The critical documents, which must all be there, and the first others by path."""
    must = catalog.where(F.col("path").isin(critical))
    if must.count() != len(set(critical)):
        raise ValueError("critical documents are missing")
    return must.unionByName(catalog.where(~F.col("path").isin(critical)).orderBy("path").limit(others))


def check_index(candidate: DataFrame, added: int) -> None:
    """A candidate index has at least as many vectors as were added."""
    if candidate.where("embedding is not null").count() < added:
        raise ValueError("the candidate index lacks vectors")


def drop_tail(rows: list[dict], size: Callable[[list[dict]], int], limit: int) -> list[dict]:
    """Drops chunks from the end until the context fits; one always stays."""
    while len(rows) > 1 and size(rows) > limit:
        rows = rows[:-1]
    return rows


def grid_to_markdown(header: Column, rows: Column, clean: Callable[[Column], Column]) -> Column:
    """A recognised grid: cells cleaned, numeric headers replaced by the first row, empty rows dropped, names filled in."""
    numeric = F.forall(header, lambda h: F.trim(h).rlike("^[0-9]+$")) & (F.size(rows) > 1)
    heads, body = F.when(numeric, F.get(rows, F.lit(0))).otherwise(header), F.when(numeric, F.slice(rows, F.lit(2), F.greatest(F.size(rows) - 1, F.lit(0)))).otherwise(rows)
    named = F.transform(heads, lambda h, i: F.coalesce(F.nullif(clean(h), F.lit("")), F.concat(F.lit("Col"), i.cast("string"))))
    cells = F.filter(F.transform(body, lambda r: F.transform(r, lambda c: F.replace(clean(c), F.lit("|"), F.lit("/")))), lambda r: F.exists(r, lambda c: c != ""))
    line = lambda r: F.concat(F.lit("| "), F.array_join(r, " | "), F.lit(" |"))
    rule = F.transform(heads, lambda h: F.lit("---"))
    return F.when(F.size(cells) > 0, F.array_join(F.concat(F.array(line(named), line(rule)), F.transform(cells, line)), "\n")).otherwise("")
