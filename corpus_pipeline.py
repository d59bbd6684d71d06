"""Five stages from raw documents to token ids; each reads what its predecessor wrote.

1. quality: documents that the classifier scores below 0.5 go.
2. near_dedup: one document of each group of near copies stays (five-word shingles, similarity 0.8 or more).
3. decontaminate: documents that hold a benchmark item go.
4. secrets: secrets are replaced in the texts.
5. encode: byte-level BPE ids of every text, and the digest of what they decode to.

All but the last stage return the columns of `documents`. `run` writes each stage's rows to the shared folder.
"""

from __future__ import annotations

from quillspark.llm import op02_secrets, op04_quality, op06_decontamination, op08_near_dedup, op10_bpe
from quillspark.llm.common import materialize, table


def quality(spark, docs, sf_dir):
    network = op04_quality.train(docs, table(spark, sf_dir, "labels"))
    return op04_quality.keep_good(docs, network)


def near_dedup(spark, docs, sf_dir):
    return op08_near_dedup.keep_one(docs, words=5, percent=80)


def decontaminate(spark, docs, sf_dir):
    return op06_decontamination.keep_clean(docs, table(spark, sf_dir, "benchmark"))


def secrets(spark, docs, sf_dir):
    return op02_secrets.redact(docs, op02_secrets.train(spark))


def encode(spark, docs, sf_dir):
    return op10_bpe.round_trip(docs, op10_bpe.default_vocabulary("byte_bpe_50k.json"))


STAGES = [("quality", quality), ("near_dedup", near_dedup), ("decontaminate", decontaminate), ("secrets", secrets), ("encode", encode)]

#: A trained classifier and a tokenizer take part, which SQL cannot express; tests hold the rows against brute force.
ORACLE_SQL = None


def run(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
