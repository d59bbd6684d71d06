import pytest
from pyspark.sql import functions as F

from quillspark.functions.ocr import clean_cell
from quillspark.operators import service as V


def test_bounds_and_models(spark):
    assert V.Parameters(k=40).k == 40
    for bad in ({"k": 0}, {"k": 41}, {"temperature": 1.5}, {"max_tokens": 5000}, {"k": True}):
        with pytest.raises(ValueError):
            V.Parameters(**bad)
    assert V.context_budget("ollama") == 24_000 and V.context_budget("openai") == 50_000 and V.context_budget("x", 7) == 7
    assert V.choose_model("b", ["a", "b"]) == "b" and V.choose_model("z", ["a", "b"]) == "a"
    assert V.drop_tail([{"n": 3}, {"n": 3}, {"n": 9}], lambda r: sum(x["n"] for x in r), 6) == [{"n": 3}, {"n": 3}]
    names = spark.createDataFrame([("Qwen2.5:7b", True), ("gpt-x", False), (None, False)], "m string, want boolean")
    assert names.where(V.is_local_model(F.col("m")) != F.col("want")).count() == 0
    templates = spark.createDataFrame([("answer", "default", "d"), ("answer", "local", "l"), ("normative", "default", "n")], "kind string, family string, template string")
    asked = spark.createDataFrame([("answer", "local"), ("normative", "local")], "kind string, family string")
    assert {r.kind: r.template for r in V.template_for(templates, asked).collect()} == {"answer": "l", "normative": "n"}


def test_documents(spark):
    catalog = spark.createDataFrame([("INM", "00034", "2024", "a.md"), ("INM", "34", "2024", "b.md"), ("RES", "1", "2020", "c.md")], "type string, number string, year string, path string")
    refs = spark.createDataFrame([(1, "INM", "34", "2024"), (1, "INM", "034", "2024")], "query_id long, type string, number string, year string")
    found = V.resolve_references(refs, catalog)
    assert sorted(map(tuple, found.collect())) == [(1, "a.md", "INM 34/2024"), (1, "b.md", "INM 34/2024")]
    chunks = spark.createDataFrame([("a.md", 2, "y"), ("a.md", 1, "x"), ("c.md", 1, "z")], "path string, chunk int, text string")
    assert [(r.chunk, r.priority, r["rank"]) for r in V.priority_chunks(found, chunks).orderBy("rank").collect()] == [(1, True, 1), (2, True, 2)]
    assert V.locate(catalog, refs.drop("query_id").distinct()).select("path").distinct().first().path == "a.md"
    docs = spark.createDataFrame([("a.md", "34", "Intro\n## One\n" + "word " * 600)], "path string, number string, text string")
    loaded = V.load_document(docs, "a.md").orderBy("chunk").collect()
    assert [r.chunk for r in loaded] == list(range(1, len(loaded) + 1)) and {r.total_chunks for r in loaded} == {len(loaded)} and loaded[0].number == "00000034" and len(loaded) > 2
    assert V.experiment_corpus(catalog, ["c.md"], 1).count() == 2
    with pytest.raises(ValueError):
        V.experiment_corpus(catalog, ["zzz"], 1)
    with pytest.raises(ValueError):
        V.check_index(spark.createDataFrame([(None,)], "embedding array<float>"), 1)


def test_grid(spark):
    grid = spark.createDataFrame([(["0", "1"], [["Name", "None"], ["a|b", "7"], ["None", "(A)"]]), (["Head", "x y z"], [["None", "None"]])], "h array<string>, r array<array<string>>")
    got = [r[0] for r in grid.select(V.grid_to_markdown(F.col("h"), F.col("r"), clean_cell)).collect()]
    assert got == ["| Name | Col1 |\n| --- | --- |\n| a/b | 7 |", ""]
    vectors = spark.createDataFrame([(1, "p", [1.0, 0.0]), (2, "q", [0.0, 1.0]), (3, "p", [0.6, 0.8])], "vec_id long, path string, embedding array<double>")
    assert [(r.vec_id, r.priority) for r in V.path_search(vectors, vectors.where("vec_id = 1"), "p").collect()] == [(3, True)]
