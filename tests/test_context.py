import random

import pytest
from pyspark.sql import functions as F

from quillspark.operators import context as K

HITS = "query_id long, rank int, source_id string, path string, chunk int, total_chunks int, text string, score double"


def hits(seed=0, n=20, sources=3):
    r = random.Random(seed)
    return [(1, k + 1, f"S{r.randrange(sources)}", "p" if r.random() < 0.8 else "", k + 1, n, "x" * r.randrange(20, 300), float(r.randrange(50))) for k in range(n)]


def dicts(rows):
    return [dict(zip([x.split()[0] for x in HITS.split(", ")], r)) for r in rows]


@pytest.mark.parametrize("limit", [500, 1500, 4000, 100_000])
def test_packing(spark, limit):
    for seed in range(3):
        rows = hits(seed)
        got = K.pack_greedy(spark.createDataFrame(rows, HITS), limit).orderBy("rank").collect()
        assert [r.rank for r in got] == [r["rank"] for r in K.pack(dicts(rows), limit)]
        size = 2 + K.assembled_size([r.asDict() for r in got])
        assert size <= limit or len(got) == 1
        if limit == 100_000:
            assert len(got) == len(rows)


def test_size_is_that_of_the_context(spark):
    rows = hits(4)
    context = K.fenced(spark.createDataFrame(rows, HITS))
    assert K.context_size(context, 7).first()["size"] == 9 + K.assembled_size(dicts(rows))
    assert K.fenced(spark.createDataFrame(rows, HITS)).first().context.count("SOURCE BEGIN") == len({r[2] for r in rows})


def test_source_cap():
    rows = [dict(query_id=1, rank=k + 1, source_id="ab"[k > 3], path="p", chunk=k, total_chunks=8, text="y" * 300, score=100.0 - k) for k in range(8)]
    packed = K.pack(rows, 2600)
    assert {r["source_id"] for r in packed} == {"a", "b"}
    table = dict(rows[0], text="intro " * 200 + "\n| a | b |\n| 1 | 2 |")
    assert K.pack([table], 700)[0]["text"] == "| a | b |\n| 1 | 2 |"


def test_routes_and_failures(spark):
    rows = spark.createDataFrame([("Qual o parâmetro?", "parameters"), ("Qual o prazo?", "normative"), ("Como vai", "answer")], "q string, want string")
    assert rows.where(K.template(F.col("q"), F.array().cast("array<string>"), F.array(F.lit("1"))) != F.col("want")).count() == 0
    asked = spark.createDataFrame([("Error 402: more credits, context length", "credit"), ("HTTP 401", "credential"), ("Timed out", "communication"), ("?", "unknown"), (None, "unknown")], "m string, want string")
    assert asked.where(K.failure_cause(F.col("m")) != F.col("want")).count() == 0
    merged = spark.range(1).select(K.merge_evidence(F.lit("| t |"), F.lit(" said ")), K.merge_evidence(F.lit(""), F.lit("NO_EVIDENCE")), K.is_failure_notice(F.lit("  "), ("sorry",))).first()
    assert tuple(merged) == ("| t |\n\nsaid", "", True)


def test_harvest_and_history(spark):
    context = "===== SOURCE BEGIN: A 1/2 =====\nID: x\nTitle\n| a | b |\n| 1 | 2 |\n===== SOURCE END: A 1/2 ====="
    rows = spark.createDataFrame([(1, context)], "query_id long, context string")
    assert [r.block for r in K.harvest(rows).collect()] == ["[Source: A 1/2]\n===== SOURCE BEGIN: A 1/2 =====\nID: x\nTitle\n| a | b |\n| 1 | 2 |"]
    turns = spark.createDataFrame([(1, k, "user", f"t{k}") for k in range(12)], "conv_id long, turn long, role string, text string")
    assert K.history(turns, 2).first().history == "user: t10\nuser: t11"
    types = K.source_types(spark.createDataFrame([(1, "a"), (1, "a"), (1, "b")], "query_id long, type string")).first()
    assert types.types == ["a", "b"] and types.counts == {"a": 2, "b": 1}
