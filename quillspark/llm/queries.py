"""Queries of the training-data operators, each over its whole table with production parameters."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillspark.llm import op01_warc, op02_secrets, op03_topk, op04_quality, op05_suffix_dedup, op06_decontamination, op07_sentence_spans, op08_near_dedup, op09_token_files, op10_bpe
from quillspark.llm.common import table
from quillspark.llm.oracles import ORACLES

__all__ = ["ORACLES", "QUERIES"]


def op1_warc_bundles(spark, sf_dir):
    return op01_warc.read_back(op01_warc.write(table(spark, sf_dir, "pages")))


def op2_secret_scan(spark, sf_dir):
    return op02_secrets.digests(op02_secrets.scan(table(spark, sf_dir, "documents"), op02_secrets.train(spark)))


def op3_exact_top_k(spark, sf_dir):
    return op03_topk.top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0, k=20, scale=64.0)


def op4_quality_classifier(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return op04_quality.classify(docs, op04_quality.train(docs, table(spark, sf_dir, "labels")))


def op5_suffix_dedup(spark, sf_dir):
    return op05_suffix_dedup.digests(op05_suffix_dedup.deduplicate(table(spark, sf_dir, "documents"), length=200, keep="none"))


def op6_decontamination(spark, sf_dir):
    found = op06_decontamination.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.withColumn("item_ids", F.array_join(F.transform("item_ids", lambda i: i.cast("string")), ","))


def op7_sentence_spans(spark, sf_dir):
    return op07_sentence_spans.digests(op07_sentence_spans.deduplicate(table(spark, sf_dir, "documents"), ends=True))


def op8_near_dedup(spark, sf_dir):
    return op08_near_dedup.near_duplicates(table(spark, sf_dir, "documents"), words=3, percent=85)


def op9_token_files(spark, sf_dir):
    manifest = op09_token_files.write(table(spark, sf_dir, "documents"), op10_bpe.default_vocabulary("word_bpe_49k.json"), end_id=2)
    return op09_token_files.read(manifest, digest_only=True)


def op10_bpe_round_trip(spark, sf_dir):
    return op10_bpe.round_trip(table(spark, sf_dir, "documents"), op10_bpe.default_vocabulary("byte_bpe_50k.json"))


QUERIES = {f.__name__: f for f in (op1_warc_bundles, op2_secret_scan, op3_exact_top_k, op4_quality_classifier, op5_suffix_dedup, op6_decontamination, op7_sentence_spans, op8_near_dedup, op9_token_files, op10_bpe_round_trip)}
