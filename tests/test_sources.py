import io
import json
import os
import zipfile

import pytest
from pyspark.sql import functions as F

from quillspark.operators import embedding as M
from quillspark.sources import files as S
from quillspark.sources.generations import Generations, swap_folder, writer_lock


def office(members):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name, text in ({"[Content_Types].xml": "<Types/>"} | members).items():
            z.writestr(name, text)
    return out.getvalue()


W = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'
P = lambda t, style="": f'<w:p>{f"<w:pPr><w:pStyle w:val=%s/></w:pPr>" % (chr(34) + style + chr(34)) if style else ""}<w:r><w:t>{t}</w:t></w:r></w:p>'
DOCX = office({"word/document.xml": f'<w:document {W}><w:body>{P("Head", "Heading1")}{P("Some body text here")}<w:tbl><w:tr><w:tc>{P("a")}</w:tc><w:tc>{P("b|c")}</w:tc></w:tr><w:tr><w:tc><w:tcPr><w:gridSpan w:val="2"/></w:tcPr>{P("wide")}</w:tc></w:tr></w:tbl></w:body></w:document>'})
X = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main" xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"'
XLSX = office({
    "xl/workbook.xml": f'<workbook {X}><sheets><sheet name="One" sheetId="1" r:id="rId1"/><sheet name="Gone" sheetId="2" state="hidden" r:id="rId2"/></sheets></workbook>',
    "xl/_rels/workbook.xml.rels": '<Relationships><Relationship Id="rId1" Target="worksheets/sheet1.xml"/><Relationship Id="rId2" Target="worksheets/sheet2.xml"/></Relationships>',
    "xl/sharedStrings.xml": f"<sst {X}><si><t>name</t></si><si><t>merged</t></si></sst>",
    "xl/styles.xml": f'<styleSheet {X}><cellXfs><xf numFmtId="0"/><xf numFmtId="10"/></cellXfs></styleSheet>',
    "xl/worksheets/sheet1.xml": f'<worksheet {X}><sheetData><row r="1"><c r="A1" t="s"><v>0</v></c><c r="B1" t="inlineStr"><is><t>value</t></is></c></row><row r="2"><c r="A2" t="s"><v>1</v></c><c r="B2" s="1"><v>0.125</v></c></row><row r="3"><c r="B3"><f>A1+1</f></c></row><row r="4"><c r="B4"><f>1+1</f><v>2</v></c></row></sheetData><mergeCells><mergeCell ref="A2:A4"/></mergeCells></worksheet>',
    "xl/worksheets/sheet2.xml": f"<worksheet {X}><sheetData/></worksheet>",
})


def test_converters(spark, tmp_path):
    assert S.docx_to_markdown(DOCX) == "## Head\n\nSome body text here\n\n| a | b\\|c |\n| --- | --- |\n| wide |  |"
    assert S.xlsx_to_markdown(XLSX) == "## One\n\n| name | value |\n| --- | --- |\n| merged | 12,5% |\n| merged | [formula: =A1+1] |\n| merged | 2 |"
    for name, content in {"a.docx": DOCX, "b.xlsx": XLSX, "c.pdf": b"%PDF x", "d.docx": b"bad"}.items():
        (tmp_path / name).write_bytes(content)
    got = {r.path[-6:]: (r.markdown is not None, r.error) for r in S.convert(spark.read.format("binaryFile").load(str(tmp_path)), {"pdf": lambda b: "text " * 20}).collect()}
    assert [got[k][0] for k in ("a.docx", "b.xlsx", "/c.pdf"[-6:], "d.docx")] == [True, True, True, False] and "BadZipFile" in got["d.docx"][1]


def test_uploads(spark):
    files = [("a.docx", DOCX), ("b.xlsx", XLSX), ("../../c d.pdf", b"%PDF-1.4"), ("e.pdf", b"nope"), ("f.docx", XLSX), ("g.docx", b"PK broken"), ("h.exe", b"x"), ("i", b"x"), ("j.pdf", b""), ("k.pdf", b"%PDF" + b"x" * 999)]
    got = {r.name: (r.safe_name, r.reason) for r in S.validate_uploads(spark.createDataFrame(files, "name string, content binary"), max_bytes=20 * len(DOCX)).collect()}
    assert [got[n][1] for n in ("a.docx", "b.xlsx", "../../c d.pdf")] == [None] * 3 and got["../../c d.pdf"][0] == "c_d.pdf"
    assert [got[n][1] for n in ("e.pdf", "f.docx", "g.docx", "h.exe", "i", "j.pdf")] == ["no PDF", "damaged or mismatched office file", "damaged or mismatched office file", "unknown format", "bad name", "empty"]


@pytest.fixture
def tree(tmp_path):
    for name, text in {"A/2020/A-00000001-2020.md": "one", "B/A-00000001-2020.md": "twin", "B/B-2-2021.md": "two", "auxiliary_tables/A-00000001-2020-limits.md": "---\nx: y\n---\n| a |", "B/new.pdf": "%PDF", "B/B-2-2021.pdf": "%PDF"}.items():
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_text(text)
    return tmp_path


def test_scans(spark, tree):
    found = S.markdown_files(spark, str(tree))
    assert sorted(r.text for r in found.collect()) == ["one", "two"]
    assert [os.path.basename(r.path) for r in S.pending_conversions(spark, str(tree)).collect()] == ["new.pdf"]
    docs = found.withColumn("doc_id", F.regexp_extract("path", r"([A-Z]-\d+-\d{4})\.md$", 1))
    merged = {r.doc_id: r.text for r in S.merge_auxiliary(docs, S.auxiliary_files(spark, str(tree))).collect()}
    assert merged == {"A-00000001-2020": "one\n\n## Tabelas auxiliares estruturadas - A-00000001-2020-limits\n\n| a |", "B-2-2021": "two"}
    (tree / "catalog.json").write_text(json.dumps([{"title": "t", "md_file": "x/B-2-2021.md", "extraction_warnings": ["w"]}]))
    catalog = S.read_catalog(spark, str(tree / "catalog.json"))
    assert catalog.first().extraction_warnings == ["w"]
    (tree / "other.json").write_text('{"a": 1}')
    assert S.read_catalog(spark, str(tree / "other.json")).count() == 0
    assert sorted((os.path.basename(r.path), r.kind) for r in S.change_detection(spark, str(tree), catalog).collect()) == [("A-00000001-2020.md", "markdown"), ("new.pdf", "pdf")]


def test_image_cache(spark):
    url = "https://h/a.png"
    docs = spark.createDataFrame([("p", f"x ![i]({url}) y"), ("q", "none")], "path string, text string")
    key = docs.select(F.left(F.sha2(F.encode(F.lit(url), "UTF-8"), 256), F.lit(16))).first()[0]
    cache = lambda v, q: spark.createDataFrame([(key, v, q, "| seen |")], "key string, version string, quality double, text string")
    text = lambda c: {r.path: r.text for r in S.enrich_images(docs, c).collect()}["p"]
    assert "## Anexo OCR\n\n| seen |" in text(cache("4", 0.9)) and text(cache("3", 0.9)) == text(cache("4", 0.5)) == f"x ![i]({url}) y"


def test_generations(spark, tmp_path):
    store = Generations(str(tmp_path))
    table = lambda n: {"chunks": spark.range(n), "catalog": spark.range(1)}
    assert store.current() is None and store.read(spark) is None
    first = store.commit(table(2), "p", "m", [{"name": "a", "sha256": ""}], batch=1)
    assert store.commit(table(9), "p", "m", [], batch=1) == first
    names = [store.commit(table(n), "p", "m", []) for n in (3, 4, 5)]
    assert store.read(spark).count() == 5 and len(os.listdir(tmp_path / "generations")) == 2 and store.current() == names[-1]
    with pytest.raises(ValueError, match="made with"):
        store.check_model("p", "other")
    with pytest.raises(Exception):
        store.commit({"chunks": spark.range(1).select(F.raise_error(F.lit("no"))), "catalog": spark.range(1)}, "p", "m", [])
    assert store.current() == names[-1]
    with writer_lock(str(tmp_path)), pytest.raises(FileExistsError), writer_lock(str(tmp_path)):
        pass
    (tmp_path / "new").mkdir()
    (tmp_path / "old").mkdir()
    (tmp_path / "old" / "x").write_text("1")
    with pytest.raises(OSError):
        swap_folder(str(tmp_path / "absent"), str(tmp_path / "old"))
    assert (tmp_path / "old" / "x").exists()
    swap_folder(str(tmp_path / "new"), str(tmp_path / "old"))
    assert not (tmp_path / "old" / "x").exists()


def test_hooks(spark, tmp_path):
    rows = M.embed(spark.createDataFrame([(1, "alfa beta"), (2, "beta alfa"), (3, "")], "i int, text string")).orderBy("i").collect()
    assert rows[0].embedding == rows[1].embedding and abs(sum(x * x for x in rows[0].embedding) - 1) < 1e-6 and not any(rows[2].embedding)
    got = M.generate(spark.createDataFrame([(1, "a"), (2, "bad")], "query_id long, prompt string"), lambda p: p.upper() if p != "bad" else 1 / 0, attempts=1).orderBy("query_id").collect()
    assert got[0].answer == "A" and "ZeroDivisionError" in got[1].error
    assert M.rewrite("q", "h", lambda p: "short") == "q" and M.rewrite("q", "h", lambda p: "long enough answer") == "long enough answer" and M.rewrite("q", " ", None) == "q"
    report = S.write_report(spark.createDataFrame([(1, None), (2, "x|y")], "case int, note string"), str(tmp_path / "r"), "Run").first().markdown
    assert report == "# Run\n\n| case | note |\n| --- | --- |\n| 1 |  |\n| 2 | x\\|y |"
