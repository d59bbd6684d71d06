import random

import numpy as np
from pyspark.sql import functions as F

from quillspark.operators import search as R


def lists(spark, *ranked):
    return [spark.createDataFrame([(1, d, k + 1) for k, d in enumerate(x)], "query_id long, doc string, rank int") for x in ranked]


def test_fusion(spark):
    got = [r.doc for r in R.fuse(lists(spark, ["a", "b", "c"], ["b", "d"], ["b"]), "doc").orderBy("rank").collect()]
    assert got[0] == "b" and sorted(got) == ["a", "b", "c", "d"]
    assert R.fuse(lists(spark, ["a"], ["z"]), "doc", (1.0, 1.0)).orderBy("rank").first().doc == "a"


def rows(spark, n=30, seed=0):
    r = random.Random(seed)
    data = [(1, k + 1, f"k{r.randrange(n)}", r.random() < 0.2, r.random() < 0.4) for k in range(n)]
    return data, spark.createDataFrame(data, "query_id long, rank int, key string, priority boolean, structured boolean")


def test_limit_priority(spark):
    for seed in range(4):
        data, df = rows(spark, seed=seed)
        first, others = [], []
        for _, _, key, priority, _ in data:
            if not priority:
                others.append(key)
            elif key not in first:
                first.append(key)
        got = [r.key for r in R.limit_priority(df, 6, "key").orderBy("rank").collect()]
        assert got == first + others[: max(0, 6 - len(first))]


def test_limit_quality(spark):
    for seed in range(4):
        data, df = rows(spark, seed=seed)
        for k in (4, 10, 30):
            if len(data) <= k:
                want = [d[2] for d in data]
            else:
                seen, groups = set(), ([], [], [])
                for _, _, key, priority, structured in data:
                    if key not in seen:
                        seen.add(key)
                        groups[0 if priority else 1 if structured else 2].append(key)
                chosen = groups[0] + groups[1]
                if len(chosen) >= k:
                    base = chosen[: max(0, k - max(2, k // 5))]
                    want = base + groups[2][: k - len(base)]
                else:
                    want = chosen + groups[2][: k - len(chosen)]
            assert [r.key for r in R.limit_quality(df, k, "key").orderBy("rank").collect()] == want


def test_expansion_caps(spark):
    hits = spark.createDataFrame([(1, k + 1, p, c) for k, (p, c) in enumerate([("a", 1), ("b", 1), ("b", 2), ("c", 1), ("", 9)])], "query_id long, rank int, path string, chunk int")
    chunks = spark.createDataFrame([(p, c, float(s)) for p in "abc" for c, s in [(1, 9), (2, 3), (3, 3), (4, 5), (5, 0), (6, 1)]], "path string, chunk int, sibling_score double")
    got = [(r.path, r.chunk) for r in R.expand_siblings(hits, chunks).orderBy("added").collect()]
    assert got == [("a", 4), ("a", 2), ("a", 3), ("b", 4), ("b", 3), ("b", 6)]
    full = spark.createDataFrame([(1, k + 1, "a", 100 + k) for k in range(39)], "query_id long, rank int, path string, chunk int")
    assert R.expand_siblings(full, chunks).count() == 1


def test_dense_and_mmr(spark):
    r = np.random.default_rng(0)
    x = r.normal(size=(200, 8))
    x /= np.linalg.norm(x, axis=1)[:, None]
    vectors = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>").repartition(5)
    got = R.dense_search(vectors, vectors.where("vec_id < 3"), 10).collect()
    for q in range(3):
        score = (x @ x[q]).round(6)
        want = sorted((i for i in range(200) if i != q), key=lambda i: (-score[i], i))[:10]
        assert [g.vec_id for g in sorted((g for g in got if g.query_id == q), key=lambda g: g.rank)] == want
    near = R.dense_search(vectors, vectors.where("vec_id = 0"), 20).join(vectors, "vec_id")
    chosen = [g.vec_id for g in R.mmr(near, 5).orderBy("rank").collect()]
    cand = sorted(near.collect(), key=lambda g: (-g.score, g.vec_id))
    picked = []
    while len(picked) < 5:
        best = max((c for c in cand if c.vec_id not in picked), key=lambda c: 0.7 * c.score - 0.3 * max((x[c.vec_id] @ x[p] for p in picked), default=0))
        picked.append(best.vec_id)
    assert chosen == picked
    empty = R.dense_search(vectors, vectors.where("vec_id < 0"), 10)
    assert empty.count() == 0


def test_fallback_and_filter(spark):
    first = spark.createDataFrame([(1, "a", 1), (2, "a", 1), (2, "b", 2)], "query_id long, doc string, rank int")
    second = spark.createDataFrame([(1, "x", 1), (1, "y", 2), (2, "z", 1), (3, "q", 1)], "query_id long, doc string, rank int")
    got = sorted((r.query_id, r.doc) for r in R.with_fallback(first, [second]).collect())
    assert got == [(1, "x"), (1, "y"), (2, "a"), (2, "b"), (3, "q")]
    df = spark.createDataFrame([(2024, "a"), (2023, "a")], "year int, type string")
    assert df.where(R.metadata_filter(year="2024", type="a", number=None)).count() == 1


def test_sources_rise(spark):
    hits = spark.createDataFrame([(1, k + 1, n, q) for k, (n, q) in enumerate([("a", "ocr"), ("b", "ocr"), ("a", "structured"), ("c", "document")])], "query_id long, rank int, norm string, quality string")
    assert [(r.norm, r.quality) for r in R.prioritize_sources(hits).orderBy("rank").collect()] == [("a", "structured"), ("b", "ocr"), ("c", "document"), ("a", "ocr")]
    assert R.candidate_count(10) == 45 and R.candidate_count(30) == 90
    assert hits.select(F.max("rank")).first()[0] == 4


def test_dense_in_blocks(spark, monkeypatch):
    rng = np.random.default_rng(3)
    rows = [(n, [float(x) for x in v / np.linalg.norm(v)]) for n, v in enumerate(rng.normal(size=(60, 4)))]
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    queries = vectors.where("vec_id % 6 = 0")
    show = lambda df: sorted(map(tuple, df.select("query_id", "vec_id", "rank").collect()))
    whole = show(R.dense_search(vectors, queries, 5))
    monkeypatch.setattr(R, "QUERY_BLOCK", 3)
    monkeypatch.setattr(R, "QUERY_BYTES", 4 * 4 * 8)
    assert show(R.dense_search(vectors, queries, 5)) == whole and len(whole) == 50


def test_full_search_falls_back(spark):
    chunks = spark.createDataFrame([(n, f"p{n // 2}", n % 2 + 1, f"word{n} of text", "document", f"p{n // 2}") for n in range(8)], "key long, path string, chunk int, text string, quality string, norm string")
    asked = spark.createDataFrame([(1, "word0"), (2, "word5"), (3, "none")], "query_id long, text string")
    ranked = lambda rows: spark.createDataFrame(rows, "query_id long, key long, rank int")
    lists = [ranked([(1, 0, 1), (1, 3, 2), (2, 5, 1)])]
    named = spark.createDataFrame([(3, "p3")], "query_id long, path string")
    aux = spark.createDataFrame([("p0", "table of p0", 1, -1)], "norm string, text string, ord int, key long")
    found = R.full_search(asked, chunks, lists, named, aux, 4, (1.0,), (ranked([(2, 4, 1), (2, 5, 2), (1, 7, 1), (1, 6, 2)]),))
    keys = {}
    for r in found.orderBy("query_id", "rank").collect():
        keys.setdefault(r.query_id, []).append((r.key, r.priority, r.injected))
    # Question 1 has two chunks, an auxiliary table and a sibling with digits, 2 takes the other list, 3 the document that it names.
    assert keys[1] == [(-1, False, True), (0, False, False), (3, False, False), (1, False, False)]
    assert {k for k, _, _ in keys[2]} == {4, 5} and keys[2][0][0] == 5
    assert keys[3] == [(6, True, False), (7, True, False)]
