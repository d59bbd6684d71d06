"""Evaluation of retrieval: coverage, case metrics, run summaries, model rankings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillspark.functions import text as T


def coverage(cases: DataFrame, hits: DataFrame, empty: float = 1.0, normal: bool = False) -> DataFrame:
    """(case_id, n_expected, n_found, coverage): expected values that occur in any retrieved text, after folding.

    cases: case_id, expected (array); hits: case_id, text, which is in normal form already where `normal` is set. Without expected values the coverage is `empty`.
    """
    values = cases.select("case_id", F.explode_outer(F.array_distinct("expected")).alias("value")).withColumn("v", T.comparison_normal(F.col("value")))
    texts = hits.select("case_id", (F.col("text") if normal else T.comparison_normal(F.col("text"))).alias("t"))
    # One row per text: its values that are found, so that texts aren't multiplied by them.
    asked = values.where("value is not null").groupBy("case_id").agg(F.collect_list(F.struct("value", "v")).alias("asked"))
    hit = texts.join(asked, "case_id").select("case_id", F.explode(F.filter("asked", lambda a: F.contains(F.col("t"), a["v"]))).alias("a"))
    found = hit.select("case_id", "a.value", F.lit(1).alias("hit")).distinct()
    per = values.join(found, ["case_id", "value"], "left").groupBy("case_id").agg(F.count("value").alias("n_expected"), F.count("hit").alias("n_found"))
    return per.withColumn("coverage", F.when(F.col("n_expected") == 0, F.lit(empty)).otherwise(F.round(F.col("n_found") / F.col("n_expected"), 6)))


def coverage_everywhere(cases: DataFrame, texts: DataFrame) -> DataFrame:
    """As `coverage`, with every text (column text) searched for every case.

    A value without spaces occurs in a text where it is a word or lies within one, so values meet the distinct words of
    all texts: by an equi-join first, those left as substrings. Only values with spaces that are no word meet whole texts.
    """
    values = cases.select("case_id", F.explode_outer(F.array_distinct("expected")).alias("value")).withColumn("v", T.comparison_normal(F.col("value")))
    asked = values.where("value is not null").select("v").distinct()
    normal = texts.select(T.comparison_normal(F.col("text")).alias("t"))
    words = normal.select(F.explode(F.array_distinct(F.split("t", " "))).alias("word")).where("word is not null").distinct()
    whole = asked.join(words, F.col("v") == F.col("word")).select("v")
    left = asked.join(whole, "v", "left_anti")
    spaced = F.contains(F.col("v"), F.lit(" "))
    # The right sides are values of the cases.
    within = words.join(F.broadcast(left.where(~spaced)), F.contains(F.col("word"), F.col("v"))).select("v")
    phrases = normal.join(F.broadcast(left.where(spaced)), F.contains(F.col("t"), F.col("v"))).select("v")
    found = whole.unionByName(within).unionByName(phrases).distinct().withColumn("hit", F.lit(1))
    per = values.join(found, "v", "left").groupBy("case_id").agg(F.count("value").alias("n_expected"), F.count_if(F.col("value").isNotNull() & F.col("hit").isNotNull()).alias("n_found"))
    return per.withColumn("coverage", F.when(F.col("n_expected") == 0, F.lit(1.0)).otherwise(F.round(F.col("n_found") / F.col("n_expected"), 6)))


def case_metrics(cases: DataFrame, hits: DataFrame) -> DataFrame:
    """(case_id, hit, n_structured, n_ocr, ok) from hits (case_id, path, quality) and cases (case_id, doc, min_structured)."""
    per = cases.join(hits, "case_id", "left").groupBy("case_id", "doc", "min_structured").agg(F.max(F.col("path") == F.col("doc")).alias("hit"), F.count_if(F.col("quality") == "structured").alias("n_structured"), F.count_if(F.col("quality") == "ocr").alias("n_ocr"))
    hit = F.when(F.col("doc").isNotNull(), F.coalesce("hit", F.lit(False)))
    return per.select("case_id", hit.alias("hit"), "n_structured", "n_ocr", (F.coalesce(hit, F.lit(True)) & (F.col("n_structured") >= F.coalesce("min_structured", F.lit(0)))).alias("ok"))


def plain_mean(value: Column) -> Column:
    """Mean without nulls and NaN."""
    return F.avg(F.when(~F.isnan(value.cast("double")), value))


def run_summary(results: DataFrame, group: list[str] | None = None) -> DataFrame:
    """Mean coverage and completeness, and the share of hits among cases that expect a document."""
    keys = group or []
    return results.groupBy(*keys).agg(F.count("*").alias("n_cases"), F.round(plain_mean(F.col("coverage")), 6).alias("mean_coverage"), F.round(F.avg(F.col("hit").cast("double")), 6).alias("hit_rate"), F.round(plain_mean(F.col("completeness")), 6).alias("mean_completeness"))


def model_report(runs: DataFrame) -> DataFrame:
    """(model, mean_coverage over runs without error, mean_seconds over all, n_errors)."""
    return runs.groupBy("model").agg(F.round(F.avg(F.when(~F.col("error"), F.col("coverage"))), 6).alias("mean_coverage"), F.round(F.avg("seconds"), 6).alias("mean_seconds"), F.count_if("error").alias("n_errors"))


def model_ranking(report: DataFrame) -> DataFrame:
    """Best coverage first, then most hits, then least time."""
    return report.withColumn("place", F.row_number().over(Window.orderBy(F.desc("mean_coverage"), F.desc("hit_rate"), "mean_seconds", "model")))


def reference_text(expected: Column, doc: Column) -> Column:
    return F.concat_ws(" ", F.concat(F.lit("Expected: "), F.array_join(expected, ", "), F.lit(".")), F.when(doc.isNotNull(), F.concat(F.lit("Document: "), doc, F.lit("."))))


def select_cases(cases: DataFrame, wanted: str | None) -> DataFrame:
    ids = [x.strip() for x in (wanted or "").split(",") if x.strip()]
    return cases.where(F.col("case_id").cast("string").isin(ids)) if ids else cases
