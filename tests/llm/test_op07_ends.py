"""Repeated runs are covered to their last sentence."""

from quillspark.llm import op07_sentence_spans as S


def test_last_sentence_of_a_passage(spark):
    words = lambda c, n: " ".join(f"{c}{k}" for k in range(n)) + ". "
    passage = words("a", 12) + words("b", 12) + words("c", 5)
    docs = spark.createDataFrame([(i, words(f"p{i}x", 15) + passage + words(f"q{i}x", 15)) for i in (1, 2)], "doc_id long, text string")
    got = sorted((r.doc_id, r.n_removed, "c4." in r.kept_text) for r in S.deduplicate(docs, ends=True).collect())
    assert got == [(1, 0, True), (2, 3, False)]
