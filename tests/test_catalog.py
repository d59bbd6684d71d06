from pyspark.sql import functions as F

from quillspark.operators import catalog as C
from quillspark.operators import evaluate as E


def test_file_names_and_types(spark):
    rows = spark.createDataFrame([("d/INM/2024/INM-00000034-2024.md",), ("d/RES/x.md",), ("q/50500.1234567.md",)], "p string")
    got = [tuple(r) for r in rows.select(*C.parse_file_name(F.col("p")).values(), C.infer_type(F.col("p"))).collect()]
    assert got == [("INM", "34", "2024", "INM"), ("", "", "", "RES"), ("", "", "", None)]
    by_act = F.create_map(F.lit("portaria"), F.lit("POR"))
    allowed = F.array(*map(F.lit, ("INM", "POR", "SEI")))
    kinds = spark.createDataFrame([("a/INM-1-2020.md", ""), ("a/50500.1234567.md", ""), ("a/b.md", "PORTARIA nº 1.234, de 2019"), ("a/RES-1-2020.md", "")], "p string, t string")
    assert [r[0] for r in kinds.select(C.classify(F.col("p"), F.col("t"), by_act, allowed)).collect()] == ["INM", "SEI", "POR", "OTHER"]
    head = kinds.where("t != ''").select(C.header_number(F.col("t")), C.header_year(F.col("t"))).first()
    assert tuple(head) == ("1234", "2019")


def test_aliases_and_references(spark):
    entries = spark.createDataFrame([(k, t, n, a) for k, (t, n, a) in enumerate([("INM", "INM", ["in"])] * 2 + [("INS", "Instrução Normativa", ["in", "Instrução  Normativa"])] * 11)], "ord int, type string, name string, aliases array<string>")
    catalog = C.type_catalog(entries)
    winners = {r.alias: r.type for r in C.alias_winners(catalog).collect()}
    assert winners == {"in": "INS", "instrucao normativa": "INS"} and {r.type: r.n_docs for r in catalog.collect()} == {"INM": 2, "INS": 11}
    pattern = C.alias_pattern(list(winners))
    types = F.create_map(*(F.lit(x) for kv in winners.items() for x in kv))
    asked = spark.createDataFrame([("Ver a Instrução Normativa nº 34/2024 e IN 1.234, de 2019",), ("nada",)], "q string")
    got = [[tuple(x) for x in r[0]] for r in asked.select(C.references(F.col("q"), pattern, types)).collect()]
    assert got == [[("INS", "34", "2024"), ("INS", "1234", "2019")], []]
    assert asked.select(F.size(C.references(F.col("q"), C.alias_pattern([]), types))).first()[0] == 0


def test_sets(spark):
    rec = spark.createDataFrame([("a", "1"), ("b", None)], "k string, v string")
    new = spark.createDataFrame([("b", "2"), ("c", "3")], "k string, v string")
    assert sorted(map(tuple, C.merge(rec, new, "k").collect()), key=str) == [("a", "1"), ("b", None), ("c", "3")]
    years = spark.createDataFrame([("2024",), (" 1999 ",), ("",), ("20245",), (None,), ("2024",)], "year string")
    assert sorted(r.year for r in C.valid_years(years).collect()) == ["1999", "2024"]
    cited = spark.range(1).select(C.citations(F.lit("See **Art. 1** and Art. 2, Art.  1"), [r"\*{0,2}Art\.\s*\d"])).first()[0]
    assert cited == ["Art. 1", "Art. 2"]


def test_evaluation(spark):
    cases = spark.createDataFrame([(1, ["3,5 m", "x"], "d", 1), (2, [], None, 0)], "case_id int, expected array<string>, doc string, min_structured int")
    hits = spark.createDataFrame([(1, "Limite 3.5 M", "d", "structured"), (1, "y", "e", "ocr"), (2, "z", "f", "document")], "case_id int, text string, path string, quality string")
    got = {r.case_id: (r.n_expected, r.n_found, r.coverage) for r in E.coverage(cases, hits).collect()}
    assert got == {1: (2, 1, 0.5), 2: (0, 0, 1.0)}
    metrics = {r.case_id: (r.hit, r.n_structured, r.n_ocr, r.ok) for r in E.case_metrics(cases, hits).collect()}
    assert metrics == {1: (True, 1, 1, True), 2: (None, 0, 0, True)}
    runs = spark.createDataFrame([(0.5, True, 1.0), (float("nan"), None, None), (1.0, False, 0.0)], "coverage double, hit boolean, completeness double")
    assert tuple(E.run_summary(runs).first()) == (3, 0.75, 0.5, 0.5)
    assert E.select_cases(cases, "2, 9").count() == 1 and E.select_cases(cases, " ").count() == 2
    text = cases.select(E.reference_text(F.col("expected"), F.col("doc"))).first()[0]
    assert text == "Expected: 3,5 m, x. Document: d."
