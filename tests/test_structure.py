import random
import re

from pyspark.sql import functions as F

from quillspark.functions import structure as S
from quillspark.functions import text as T
from tests.test_text import python_normal, python_truncate


def fold_state(chunks):
    """The state carried from chunk to chunk, line by line."""
    levels, marker, header, out = {}, "", "", []
    is_table = lambda x: x.strip().startswith("|") and x.count("|") >= 2
    for text in chunks:
        lines, opened, first = text.split("\n"), False, ""
        for k, line in enumerate(lines):
            if not line.strip():
                continue
            first = first or line
            h = re.match(S.HEADING, line)
            said = h[2].strip() if h else line
            if h:
                levels = {n: t for n, t in levels.items() if n < len(h[1])} | {len(h[1]): said}
            if re.match(S.MARKER, python_normal(said)):
                marker = python_truncate(said.strip("# "), S.MARKER_LENGTH)
            if re.match(T.SEPARATOR_ROW, line):
                before = next((x for x in reversed(lines[:k]) if x.strip()), "")
                if is_table(before):
                    header, opened = python_truncate(before.strip().strip("|").replace("|", "; "), S.HEADER_LENGTH), True
        trail = []
        for t in [*(levels[n] for n in sorted(levels)), marker]:
            if t and t not in trail:
                trail.append(t)
        out.append((python_truncate(" > ".join(trail[-4:]), S.TRAIL_LENGTH), header, bool(first) and is_table(first) and not opened))
    return out


def test_breadcrumbs_against_a_fold(spark):
    r = random.Random(5)
    pieces = ["# A{}", "## B{}", "### C {} ###", "###### F{}", "text {}", "", "ANEXO {}", "Capítulo IV {}", "## Anexo {}", "| a{} | b |", "| --- | --- |", "| 1 | 2 |", "Tabela 3 {}"]
    docs = {f"p{d}": ["\n".join(r.choice(pieces).format(r.randrange(4)) for _ in range(r.randrange(1, 9))) for _ in range(r.randrange(1, 7))] for d in range(60)}
    rows = [(p, k + 1, t) for p, chunks in docs.items() for k, t in enumerate(chunks)]
    got = {(x.path, x.chunk): (x.trail, x.header, x.continues) for x in S.breadcrumbs(spark.createDataFrame(rows, "path string, chunk int, text string")).collect()}
    for p, chunks in docs.items():
        for k, want in enumerate(fold_state(chunks)):
            assert got[p, k + 1] == want, (chunks, k)


def test_blocks(spark):
    text = "Intro\n\nArt. 1 first\nmore\n  art. 2 second\n## Heading\n### Sub\nANEXO I x"
    got = spark.createDataFrame([(text,), ("plain \n",)], "t string").select(S.blocks(F.col("t"))).collect()
    assert got[0][0] == ["Intro", "Art. 1 first\nmore", "art. 2 second", "## Heading", "### Sub", "ANEXO I x"] and got[1][0] == ["plain \n"]
    accented = spark.createDataFrame([("a\nCAPÍTULO I\nb",)], "t string").select(F.size(S.blocks(F.col("t"))), F.size(S.blocks(F.col("t"), fold=True))).first()
    assert tuple(accented) == (1, 2)


def test_recursive_split():
    r = random.Random(1)
    text = "\n\n".join(". ".join(" ".join("w" * r.randrange(1, 9) for _ in range(r.randrange(1, 40))) for _ in range(r.randrange(1, 9))) for _ in range(20))
    pieces = S.recursive_split(text, 300, 60)
    assert all(0 < len(p) <= 300 for p in pieces)
    assert set(text.replace(".", " ").split()) == set(" ".join(pieces).replace(".", " ").split())
    assert S.recursive_split("x" * 1000, 300, 60)[0] == "x" * 300 and S.recursive_split("  ", 300, 60) == []


def test_whole_tables_and_long_blocks(spark):
    table = "| a | b |\n| --- | --- |\n" + "| 1 | 2 |\n" * 300
    docs = spark.createDataFrame([(1, "x\n## T\n" + table), (2, "word " * 900), (3, None)], "id int, text string")
    got = S.chunk_blocks(docs).groupBy("id").agg(F.count("text").alias("n"), F.max(F.length("text")).alias("m")).orderBy("id").collect()
    assert [(r.id, r.n) for r in got][0] == (1, 2) and got[0].m > 1500 and got[1].n == 4 and got[1].m <= 1500


def test_source_class_and_tables(spark):
    rows = [("x\n(Transcrição)", "", None, "structured"), ("## Anexo OCR x", "", None, "ocr"), ("plain", "", "OCR", "ocr"), ("| a | b |\n| --- | --- |", "Anexo - Limites", None, "structured"), ("plain", "anexo ocr 2", None, "ocr"), ("plain", "", "other", "document")]
    df = spark.createDataFrame([(a, b, c, d) for a, b, c, d in rows], "t string, s string, q string, want string")
    assert df.where(S.source_quality(F.col("t"), F.col("s"), F.col("q")) != F.col("want")).count() == 0
    text = "Title\n| a | b |\n| 1 | 2 |\nlater " + "y" * 200 + "\n| c | d |"
    lines = spark.createDataFrame([(1, text)], "k int, t string").select("k", F.posexplode(F.split("t", "\n")).alias("n", "line"))
    assert [r.block for r in S.table_runs(lines, ["k"]).orderBy("first").collect()] == ["Title\n| a | b |\n| 1 | 2 |", "| c | d |"]
    cut = spark.createDataFrame([("intro\n| a |\n| bb |\n| ccc |",), ("x" * 50,)], "t string").select(S.cut_keeping_table(F.col("t"), 13)).collect()
    assert [r[0] for r in cut] == ["| a |\n| bb |", "x" * 13]
