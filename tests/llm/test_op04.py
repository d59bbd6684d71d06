import numpy as np
import pytest

from quillspark.llm import op04_quality as Q

SF = "/root/testdata/sf0.01"


def brute_score(net, data):
    """Filter by filter and place by place."""
    highs, means = [], []
    for k in range(max(1, -(-max(len(data) - Q.WIDTH + 1, 0) // Q.STEP))):
        chunk = data[k * Q.STEP : k * Q.STEP + Q.CHUNK]
        x = [np.maximum(net.bias + sum(net.tables[j, chunk[i + j]] for j in range(Q.WIDTH)), 0) for i in range(len(chunk) - Q.WIDTH + 1)] or [np.zeros(Q.FILTERS)]
        highs.append(np.max(x, 0))
        means.append(np.mean(x, 0))
    f = np.concatenate([np.mean(highs, 0), np.max(highs, 0), np.mean(means, 0), np.max(means, 0)])
    return 1 / (1 + np.exp(-(f @ net.weights + net.shift[0])))


def test_scores_cover_the_whole_text():
    net, r = Q.Network(), np.random.default_rng(0)
    texts = [r.integers(0, 256, n).astype(np.uint8) for n in (0, 1, 3, 4, 5, 255, 256, 257, 508, 509, 2000)]
    got = net.score(np.concatenate(texts), np.cumsum([0, *map(len, texts)]), block=3)
    assert np.allclose(got, [brute_score(net, t) for t in texts], atol=1e-5)
    longer = np.append(texts[-1], np.full(300, 33, np.uint8))
    assert net.score(longer, np.array([0, len(longer)]))[0] != got[-1]


@pytest.mark.parametrize("held", [512, 2])
def test_gradient(monkeypatch, held):
    monkeypatch.setattr(Q, "HELD", held)
    net, r = Q.Network(), np.random.default_rng(1)
    net.tables, net.weights = net.tables.astype(np.float64), net.weights.astype(np.float64)
    rows = np.concatenate([Q.cut(r.integers(0, 256, n).astype(np.uint8)) for n in (600, 40)])
    begins, labels, weight = np.array([0, len(rows) - 1]), np.array([1.0, 0.0]), np.ones(2)

    def loss():
        _, high, mean = net.pools(rows)
        p = net.probability(net.combine(high, mean, begins))
        return -np.mean(labels * np.log(p) + (1 - labels) * np.log(1 - p))

    g = net.gradients(rows, begins, labels, weight)[0] - Q.DECAY * net.tables
    for j, v, f in [(0, int(rows[0, 0]), 3), (2, int(rows[1, 9]), 7), (4, int(rows[-1, 20]), 0)]:
        at = net.tables[j, v, f]
        net.tables[j, v, f] = at + 1e-2
        up = loss()
        net.tables[j, v, f] = at - 1e-2
        down = loss()
        net.tables[j, v, f] = at
        assert g[j, v, f] == pytest.approx((up - down) / 2e-2, abs=2e-4)


def test_held_out_accuracy(spark):
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    got = Q.classify(docs, Q.train(docs, labels)).join(labels, "doc_id").where("held_out").toPandas()
    assert (got.predicted == got.quality).mean() > 0.93
    kept = Q.keep_good(docs.withColumn("score", docs.lang), Q.train(docs, labels))
    assert kept.columns == [*docs.columns, "score"] and 0 < kept.count() < docs.count()


def test_odd_rows(spark):
    docs = spark.createDataFrame([(1, None), (2, ""), (None, "x"), (3, "long " * 50_000), (3, "a"), (3, "a")], "doc_id long, text string").selectExpr("*", "'x' as held_out", "1 as score", "'y' as label", "2 as quality")
    labels = spark.createDataFrame([(1, None), (2, 1), (None, 0), (3, 5)], "doc_id long, quality int")
    for network in (Q.train(docs, labels), None):
        rows = Q.classify(docs, network).collect()
        assert len(rows) == 6 and all(0 <= r.score <= 1 for r in rows)
    assert Q.train(docs, labels.limit(0)) is None
    assert Q.classify(docs.limit(0), None).count() == 0
