"""Model calls around an answer, all hooks: streamed pieces, evidence in two passes, suggestions, table notes, judging."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspark.operators.context import harvest, merge_evidence
from quillspark.operators.embedding import generate

NOTHING = "NO_EVIDENCE"
MEASURES = ("faithfulness", "answer_relevancy", "context_precision", "context_recall")
#: Calls to a local model that run at a time: least, most, and where none is stated.
GATE = (1, 8, 1)


def reply_text(reply: object) -> str:
    """A model's reply as trimmed text: its attribute `content` where it has one, else the value itself; empty for None."""
    content = getattr(reply, "content", reply)
    return "" if content is None else str(content).strip()


def gate(wanted: int | None) -> int:
    """How many calls run at a time, within the bounds of GATE."""
    least, most, usual = GATE
    return usual if wanted is None else min(most, max(least, wanted))


def stream(prompts: DataFrame, model: Callable[[str], Iterable[object]], parallel: int | None = None) -> DataFrame:
    """(query_id, n, piece, error) from (query_id, prompt): pieces as the model yields them, numbered from 1.

    A call that fails ends with one row that holds its error; what came before stays.
    """

    def pieces(query_id: int, prompt: str) -> Iterator[tuple]:
        n = 0
        try:
            for piece in model(prompt):
                n += 1
                yield query_id, n, str(getattr(piece, "content", piece)), None
        except Exception as e:  # told per question, as the others go on
            yield query_id, n + 1, None, f"{type(e).__name__}: {e}"

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for query_id, prompt in zip(frame["query_id"], frame["prompt"]):
                yield pd.DataFrame(list(pieces(query_id, prompt)), columns=["query_id", "n", "piece", "error"])

    return prompts.select("query_id", "prompt").repartition(gate(parallel)).mapInPandas(run, "query_id long, n int, piece string, error string")


def evidence(contexts: DataFrame, model: Callable[[str], object], ask: str = "Question: {question}\n\nContext:\n{context}", parallel: int | None = None, **retries) -> DataFrame:
    """(query_id, question, evidence) from (query_id, question, context): tables of the context first, then what the model finds.

    A failed or empty extraction counts as NOTHING, so that tables alone go on.
    """
    text = F.replace(F.replace(F.lit(ask), F.lit("{question}"), F.coalesce("question", F.lit(""))), F.lit("{context}"), F.coalesce("context", F.lit("")))
    found = generate(contexts.select("query_id", text.alias("prompt")), lambda p: reply_text(model(p)), gate(parallel), **retries)
    written = found.select("query_id", F.coalesce(F.nullif(F.trim("answer"), F.lit("")), F.lit(NOTHING)).alias("written"))
    tables = harvest(contexts.select("query_id", "context")).groupBy("query_id").agg(F.sort_array(F.collect_list(F.struct("n", "block"))).alias("b"))
    tables = tables.select("query_id", F.array_join(F.transform("b", lambda s: s["block"]), "\n\n").alias("tables"))
    rows = contexts.select("query_id", "question").join(written, "query_id", "left").join(tables, "query_id", "left")
    both = merge_evidence(F.col("tables"), F.col("written"), NOTHING)
    return rows.select("query_id", "question", F.when(both == "", F.lit(NOTHING)).otherwise(both).alias("evidence"))


def two_pass(contexts: DataFrame, extract: Callable[[str], object], write: Callable[[str], object], draft: str = "Question: {question}\n\nEvidence:\n{evidence}", parallel: int | None = None, **retries) -> DataFrame:
    """(query_id, answer, error): evidence is gathered first, the answer is written from it alone."""
    found = evidence(contexts, extract, parallel=parallel, **retries)
    prompt = F.replace(F.replace(F.lit(draft), F.lit("{question}"), F.coalesce("question", F.lit(""))), F.lit("{evidence}"), F.col("evidence"))
    return generate(found.select("query_id", prompt.alias("prompt")), lambda p: reply_text(write(p)), gate(parallel), **retries)


def suggest_types(documents: DataFrame, model: Callable[[str], object], allowed: list[str], length: int = 4000) -> DataFrame:
    """Adds `suggested`: the type that the model names for a document's head, null where it is none of `allowed` or the call fails."""
    known = {a.upper() for a in allowed}

    @F.pandas_udf("string")
    def run(heads: pd.Series) -> pd.Series:
        def one(head):
            try:
                word = reply_text(model(head)).upper()
            except Exception:  # a suggestion is only a help
                return None
            return word if word in known else None

        return heads.map(one).astype("object")

    return documents.withColumn("suggested", run(F.substring(F.coalesce("text", F.lit("")), 1, length)))


def suggest_aliases(catalog: DataFrame, model: Callable[[str], Iterable[str]] | None = None) -> DataFrame:
    """The catalog of types (type, name, aliases, n_docs) with aliases that the model adds; as it is without a model."""
    if model is None:
        return catalog

    @F.pandas_udf("array<string>")
    def run(names: pd.Series) -> pd.Series:
        def one(name):
            try:
                return [str(a).strip().lower() for a in model(name)]
            except Exception:  # a suggestion is only a help
                return []

        return names.map(one)

    more = F.filter(run(F.coalesce("name", F.col("type"))), lambda a: a != "")
    return catalog.withColumn("aliases", F.array_sort(F.array_distinct(F.concat("aliases", more))))


def describe_tables(tables: DataFrame, model: Callable[[str], object], by: tuple[str, ...] = ("path", "page", "place")) -> DataFrame:
    """Tables (path, page, place, text) with the model's line about each in front, numbered n in order within their document.

    A table whose call fails stays without a line.
    """
    from pyspark.sql import Window

    @F.pandas_udf("string")
    def run(texts: pd.Series) -> pd.Series:
        def one(text):
            try:
                return reply_text(model(text or ""))
            except Exception:  # the table itself is what counts
                return ""

        return texts.map(one)

    rows = tables.withColumn("about", run(F.col("text")))
    text = F.concat_ws("\n\n", F.nullif(F.col("about"), F.lit("")), F.col("text"))
    return rows.withColumn("text", text).withColumn("n", F.row_number().over(Window.partitionBy(by[0]).orderBy(*by[1:]))).drop("about")


def judge(samples: DataFrame, model: Callable[[dict], dict]) -> DataFrame:
    """(case_id, four measures) of samples (case_id, question, answer, contexts, reference); null where the judge gives no number."""

    def number(value: object) -> float | None:
        return float(value) if isinstance(value, (int, float)) and not isinstance(value, bool) and math.isfinite(value) else None

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            out = []
            for row in frame.to_dict("records"):
                sample = row | {"contexts": list(row["contexts"]) if row["contexts"] is not None and len(row["contexts"]) else [""]}
                try:
                    given = model(sample)
                except Exception:  # a case that can't be judged has no measures
                    given = {}
                out.append([row["case_id"], *(number(given.get(m)) for m in MEASURES)])
            yield pd.DataFrame(out, columns=["case_id", *MEASURES])

    schema = f"case_id {samples.schema['case_id'].dataType.simpleString()}, " + ", ".join(f"{m} double" for m in MEASURES)
    return samples.select("case_id", "question", "answer", "contexts", "reference").mapInPandas(run, schema)
