"""Coverage and keyword search over whole tables and texts, against brute force."""

from quillspark.operators import evaluate as E
from quillspark.operators import search as R


def test_coverage_everywhere(spark):
    texts = ["Prazo de 30  dias, 1,5 km", "transport", None, "", "Área"]
    cases = [(1, ["area", "port", "prazo", "1.5"]), (2, ["30 dias", "de 31"]), (3, []), (4, None), (5, ["area", "area", "none", None])]
    got = E.coverage_everywhere(spark.createDataFrame(cases, "case_id long, expected array<string>"), spark.createDataFrame([(t,) for t in texts], "text string"))
    assert sorted(map(tuple, got.collect())) == [(1, 4, 4, 1.0), (2, 2, 1, 0.5), (3, 0, 0, 1.0), (4, 0, 0, 1.0), (5, 2, 1, 0.5)]


def test_keyword_search_small(spark, monkeypatch):
    monkeypatch.setattr(R, "KEYWORD_BLOCK", 2)
    texts = ["x " * 400 + "transporte", "Porte único", None, "porte and área", "nothing"] + [f"área {n}" for n in range(9)]
    asked = [(1, "porte área"), (2, "único"), (3, "absent"), (4, "de"), (5, None), (6, "x porte porte")]
    got = R.keyword_search(spark.createDataFrame(asked, "query_id long, text string"), spark.createDataFrame(list(enumerate(texts)), "id int, text string").repartition(3), "id", ["text"], 4)
    want = []
    for q, question in asked:
        words = {w for w in (question or "").split() if len(w) > 1 and w != "de"}
        scored = sorted((-sum(w in (t or "").lower() for w in words), n) for n, t in enumerate(texts))
        want += [(q, n, -s, r + 1) for r, (s, n) in enumerate(scored[:4]) if s]
    assert sorted(map(tuple, got.select("query_id", "id", "score", "rank").collect())) == sorted(want)
    assert R.keyword_search(spark.createDataFrame([], "query_id long, text string"), spark.createDataFrame([(1, "a")], "id int, text string"), "id", ["text"], 4).count() == 0
