import numpy as np
import pytest
from pyspark.sql import functions as F

from quillspark.llm import op03_topk as K


LIMITS = -(1 << 63), (1 << 63) - 1
LARGEST = np.finfo(np.float64).max


def scaled(c, scale):
    x = max(min(scale * float(c), LARGEST), -LARGEST)
    return int(np.floor(x))


def brute(rows, asks, k=20, scale=64):
    """rows: (vec_id, vector); vec_ids may repeat, the smallest vector of a query's rows asks."""
    fine = [(i, [scaled(c, scale) for c in v]) for i, v in rows if i is not None and v and all(c is not None and np.isfinite(c) for c in v)]
    lengths = [len(v) for _, v in fine]
    fine = [(i, v) for i, v in fine if len(v) == max(sorted(set(lengths)), key=lengths.count)] if fine else []
    out = []
    for i in sorted({i for i, _ in fine if asks(i)}):
        q = min(v for j, v in fine if j == i)
        best = sorted((-max(LIMITS[0], min(LIMITS[1], sum(a * b for a, b in zip(q, w)))), j) for j, w in fine if j != i)[:k]
        out += [(i, r + 1, j, -s) for r, (s, j) in enumerate(best)]
    return sorted(out)


@pytest.mark.parametrize("kind", ["random", "ties", "clusters", "large"])
def test_search(kind):
    r = np.random.default_rng(3)
    n, d = 700, 24
    x = {"random": r.integers(-64, 65, (n, d)), "ties": r.integers(0, 2, (n, d)), "clusters": (r.integers(-64, 65, (5, d))[r.integers(0, 5, n)] + r.integers(-1, 2, (n, d))), "large": r.integers(-(2**30), 2**30, (60, d))}[kind].astype(float)
    ids = r.permutation(5000)[: len(x)]
    q = ids % 7 == 0
    at, vec, score = K.search(x[q], ids[q], x, ids, 20)
    want = brute([(int(i), v.tolist()) for i, v in zip(ids, x)], lambda i: i % 7 == 0, scale=1)
    got = sorted((int(ids[q][a]), int(v), int(s)) for a, v, s in zip(at, vec, score))
    assert got == sorted((i, j, s) for i, _, j, s in want)


def test_query(spark):
    r = np.random.default_rng(5)
    rows = [(i, r.normal(0, 0.3, 16).tolist()) for i in range(300)] + [(400, None), (420, [0.1] * 15 + [None]), (440, [float("nan")] * 16), (460, [float("inf")] + [0.0] * 15), (None, [0.0] * 16), (480, []), (600, [0.0] * 16)]
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("g", F.lit("x"))
    rows = [(x.vec_id, x.embedding) for x in vectors.collect()]
    for sizes in ((16, 8), (100_000, 100_000), (3, 300)):
        got = K.top_k(vectors, F.col("vec_id") % 20 == 0, group_rows=sizes[0], block_rows=sizes[1])
        assert sorted(map(tuple, got.collect())) == brute(rows, lambda i: i % 20 == 0)
    assert K.top_k(vectors.limit(0), F.col("vec_id") % 20 == 0).count() == 0
    assert K.top_k(vectors.where("vec_id = 20"), F.col("vec_id") % 20 == 0).count() == 0


@pytest.mark.parametrize("seeded", [False, True])
def test_clusters_are_pruned(seeded):
    """Tight clusters with different segment means: few pairs survive, and exact products are made for few pairs."""
    r = np.random.default_rng(9)
    n, d, of = 6000, 64, 40
    centres = np.repeat(r.integers(-60, 61, (of, 16)), 4, axis=1)
    x = (centres[r.integers(0, of, n)] + r.integers(-2, 3, (n, d))).astype(float)
    ids, q = np.arange(n), np.arange(n) % 20 == 0
    exact = x[q] @ x.T
    exact[np.arange(q.sum()), ids[q]] = -np.inf
    counts = np.zeros(2 + len(K.LEVELS), np.int64)
    least = np.sort(exact, 1)[:, -20] if seeded else None
    at, vec, score = K.search(x[q], ids[q], x, ids, 20, least, counts)
    for k in range(int(q.sum())):
        order = np.lexsort((ids, -exact[k]))[:20]
        assert vec[at == k].tolist() == order.tolist() and score[at == k].tolist() == exact[k][order].tolist()
    pairs, *alive, products = counts.tolist()
    assert pairs == q.sum() * n and alive == sorted(alive, reverse=True) and alive[-1] < 0.05 * pairs and products < 0.2 * pairs


def test_odd_rows(spark):
    r = np.random.default_rng(6)
    rows = [(i, r.normal(0, 0.3, 8).tolist()) for i in range(60)]
    rows += [(20, [0.5] * 8), (20, [-0.5] * 8), (40, rows[40][1]), (7, rows[7][1]), (7, [0.1] * 8)]
    rows += [(80, [1e300] + [1.0] * 7), (81, [-1e300] + [0.0] * 7), (82, [1e308] * 8), (100, [3e6] * 8), (101, [-3e6, 2e15] + [0.5] * 6), (120, [0.0] * 8), (121, [1.0] * 7), (122, [1.0] * 9)]
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("v", F.lit("clash")).withColumn("score", F.lit(1))
    want = brute(rows, lambda i: i % 20 == 0)
    for sizes in ((100_000, 100_000), (16, 3)):
        got = K.top_k(vectors, F.col("vec_id") % 20 == 0, group_rows=sizes[0], block_rows=sizes[1])
        assert sorted(map(tuple, got.collect())) == want
