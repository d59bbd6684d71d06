from types import SimpleNamespace

import pytest
from pyspark.sql import functions as F

from quillspark.operators import answers as A
from quillspark.operators import catalog as C
from quillspark.operators import context as K
from quillspark.sources import files as S


def test_replies():
    assert [A.reply_text(x) for x in (SimpleNamespace(content=" a "), "b\n", None, 3)] == ["a", "b", "", "3"]
    assert [A.gate(x) for x in (None, 0, 3, 99)] == [1, 1, 3, 8]


def test_stream(spark):
    def model(prompt):
        yield prompt[:1]
        if prompt == "bad":
            raise ValueError("cut")
        yield prompt[1:]

    rows = A.stream(spark.createDataFrame([(1, "good"), (2, "bad")], "query_id long, prompt string"), model).collect()
    assert sorted(map(tuple, rows)) == [(1, 1, "g", None), (1, 2, "ood", None), (2, 1, "b", None), (2, 2, None, "ValueError: cut")]


def test_two_pass(spark):
    context = "===== SOURCE BEGIN: X =====\nTitle\n| a | b |\n| --- | --- |\n| 1 | 2 |\n===== SOURCE END: X ====="
    rows = spark.createDataFrame([(1, "q1", context), (2, "q2", ""), (3, "q3", None)], "query_id long, question string, context string")

    def extract(prompt):
        if "q3" in prompt:
            raise ValueError("no")
        return "" if "q2" in prompt else " found "

    found = {r.query_id: r.evidence for r in A.evidence(rows, extract, wait=0.0).collect()}
    assert found[1].startswith("[Source: X]") and found[1].endswith("\n\nfound") and found[2] == found[3] == A.NOTHING
    answers = {r.query_id: r.answer for r in A.two_pass(rows, extract, lambda p: p.upper(), wait=0.0).collect()}
    assert answers[1].startswith("QUESTION: Q1") and "FOUND" in answers[1] and answers[3].endswith(A.NOTHING)


def test_suggestions(spark):
    docs = spark.createDataFrame([(1, "a resolution"), (2, "odd"), (3, None)], "i int, text string")
    assert [r.suggested for r in A.suggest_types(docs, lambda h: "res" if "resol" in h else "zzz", ["RES"]).orderBy("i").collect()] == ["RES", None, None]
    types = spark.createDataFrame([("RES", "Resolution", ["r"], 2)], "type string, name string, aliases array<string>, n_docs int")
    assert A.suggest_aliases(types).first().aliases == ["r"]
    assert A.suggest_aliases(types, lambda n: [" Resol ", "r", ""]).first().aliases == ["r", "resol"]


def test_tables_and_judge(spark):
    tables = spark.createDataFrame([("p", 2, 1, "t3"), ("p", 1, 2, "t2"), ("p", 1, 1, "t1")], "path string, page int, place int, text string")

    def about(text):
        if text == "t2":
            raise ValueError
        return f"about {text}"

    assert [(r.n, r.text) for r in A.describe_tables(tables, about).orderBy("n").collect()] == [(1, "about t1\n\nt1"), (2, "t2"), (3, "about t3\n\nt3")]
    samples = spark.createDataFrame([(1, "q", "a", ["c"], "r"), (2, "q", "a", [], "r")], "case_id int, question string, answer string, contexts array<string>, reference string")
    rows = A.judge(samples, lambda s: {"faithfulness": float(len(s["contexts"])), "context_recall": float("nan"), "answer_relevancy": True}).orderBy("case_id").collect()
    assert [tuple(r) for r in rows] == [(1, 1.0, None, None, None), (2, 1.0, None, None, None)]


def test_context_views(spark):
    hits = spark.createDataFrame([(1, 2, "b", "s", 2, 2), (1, 1, None, "s", 1, 2)], "query_id int, rank int, text string, source_id string, chunk int, total_chunks int")
    assert K.plain(hits).first().context == "\n\nb"
    line = K.summary_line(F.lit(3), F.lit("[Document: x]\n| a |\n| --- |\n| 1,0 |"), F.lit("ocr"), {"priority": F.lit(True), "expanded": F.lit(None).cast("boolean")}, F.lit("RES 1/2020"), F.lit(""), F.lit(1), F.lit(None).cast("int"))
    head, section, text = spark.range(1).select(line).first()[0].split("\n")
    assert head.startswith("chunk[3] RES 1/2020 part 1/? (") and "[priority, " in head and head.endswith("ocr]")
    assert section == "  section: -" and text == "  text: | a | | --- | | 1,0 |..."
    rows = spark.createDataFrame([("A", "2020"), ("A", None), ("B", "")], "type string, year string")
    assert sorted(map(tuple, K.filter_options(rows, ["type", "year"]).collect())) == [("type", "A"), ("type", "B"), ("type", "Todos"), ("year", "2020"), ("year", "Todos")]
    shown = K.hit_rows(spark.createDataFrame([(1, 1, None, "5", None, "x" * 600, None)], "query_id int, rank int, type string, number string, year string, text string, path string")).first()
    assert (shown.type, shown.number, shown.year, len(shown.excerpt), shown.path, shown.relevance) == ("", "5", "", 500, "", 0.0)


@pytest.mark.parametrize(
    ("path", "text", "want"),
    [
        ("x/RES-00006053-2024.md", None, ("RES 6053/2024", "RES", "6053", "2024")),
        ("x/50500.0124472025-25.md", None, ("50500.0124472025/25", "SEI", "50500.0124472025-25", "")),
        ("x/A_Nota_Tecnica.md", None, ("A Nota Tecnica", "NT", "A_Nota_Tecnica", "")),
        ("x/entrada/new_file.md", "Resolução No 12, de 2023", ("RES 12/2023", "RES", "12", "2023")),
        ("x/entrada/new_file.md", "", ("new file", "OTHER", "", "")),
        ("x/extra/a-b.md", None, ("a/b", "EXTRA", "a-b", "")),
        ("lone.md", None, ("lone", "DOC", "lone", "")),
    ],
)
def test_file_entry(spark, path, text, want):
    entry = C.file_entry(F.lit(path), F.lit(text).cast("string"), F.create_map(F.lit("resolucao"), F.lit("RES")), F.array(F.lit("RES")))
    assert tuple(spark.range(1).select(entry.alias("e")).first().e) == want


@pytest.mark.parametrize(
    ("answer", "want"),
    [
        ("Segundo a Resolução 5/2020 e Documento: RES 12/2021.", ["RES 12/2021", "Resolução 5/2020"]),
        ("A Resolução 5/2020.\nFONTES CONSULTADAS: **INM 18/2023**\n### fim", ["Resolução 5/2020", ": INM 18/2023"]),
        ("TRECHOS DOS DOCUMENTOS CITADOS: Documento: RES 1/2020\nDocumento: RES  1 de 2020", ["RES 1/2020", "RES 1 de 2020"]),
        ("RES 00012/2020", ["RES 00012/2020"]),
        ("nothing", []),
        ("", []),
    ],
)
def test_citations(spark, answer, want):
    assert spark.range(1).select(C.citations(F.lit(answer))).first()[0] == want


def test_recognition(spark, tmp_path):
    images = spark.createDataFrame([("a", b"one"), ("b", b"two")], "key string, content binary")
    poor, good = "ab", "enough plain text to be of use"

    def engine_one(b):
        if b == b"two":
            raise ValueError
        return good

    def engine_two(b):
        assert b == b"two"  # the first is settled
        return poor

    readings = S.recognise(images, [bytes], [engine_one, engine_two]).persist()
    rows = {r.key: (r.quality, r.text) for r in readings.collect()}
    assert rows == {"a": (1.0, good), "b": (0.6, poor)}
    cache = spark.createDataFrame([("a", "4", 0.9, "old"), ("c", "4", 0.9, "kept"), ("d", "3", 0.9, "gone"), ("e", "4", 0.1, "gone")], "key string, version string, quality double, text string")
    assert {r.key: r.text for r in S.update_cache(cache, readings).collect()} == {"a": good, "b": poor, "c": "kept"}
    report = S.write_sections({"Summary": spark.createDataFrame([(1,)], "n int"), "Cases of it": spark.createDataFrame([(2, "x")], "n int, t string")}, str(tmp_path), "Run").first().markdown
    assert report.startswith("# Run\n\n## Summary") and "## Cases of it" in report and spark.read.json(f"{tmp_path}/cases_of_it").first().t == "x"
