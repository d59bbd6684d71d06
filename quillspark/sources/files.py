"""Document files: markdown trees, catalogs, pending conversions, office formats, uploads, recognised images."""

import datetime
import io
import re
import zipfile
from collections.abc import Callable
from functools import reduce
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType

from quillspark.functions import text as T
from quillspark.functions.ocr import best_reading, cache_entry
from quillspark.session import cut

AUXILIARY, INBOX = "auxiliary_tables", "inbox"
IGNORED = (AUXILIARY, ".git", "__pycache__")
ENTRY = "title string, summary string, date string, type string, number string, year string, agency string, url string, html_file string, md_file string, source_format string, extraction_method string, table_origin string, extraction_warnings array<string>"
MAX_UPLOAD = 50 << 20
SHEET_ROWS, SHEET_COLUMNS = 10_000, 200
LEAST_PDF, LEAST_DOCX = 50, 20
OCR_VERSION, OCR_LEAST = "4", 0.55


def path_parts(path: Column) -> Column:
    return F.split(path, "/")


def in_folder(path: Column, folders) -> Column:
    return F.arrays_overlap(path_parts(path), F.array(*map(F.lit, folders)))


def markdown_files(spark: SparkSession, root: str, skip=IGNORED) -> DataFrame:
    """(path, text): every markdown file below the root, the first of each base name by path."""
    rows = spark.read.format("text").option("wholetext", True).option("recursiveFileLookup", True).option("pathGlobFilter", "*.md").load(root).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("text"))
    rows = rows.where(~in_folder(F.col("path"), skip))
    first = F.row_number().over(Window.partitionBy(F.element_at(path_parts(F.col("path")), -1)).orderBy("path"))
    return rows.withColumn("n", first).where("n = 1").drop("n")


def auxiliary_files(spark: SparkSession, root: str) -> DataFrame:
    """(path, doc_id, text) of auxiliary tables: doc_id is the TYPE-number-year before the slug; front matter is dropped."""
    rows = spark.read.format("text").option("wholetext", True).option("recursiveFileLookup", True).option("pathGlobFilter", "*.md").load(root)
    rows = rows.select(F.col("_metadata.file_path").alias("path"), T.without_front_matter(F.col("value")).alias("text")).where(in_folder(F.col("path"), [AUXILIARY]))
    return rows.withColumn("doc_id", F.regexp_extract(F.element_at(path_parts(F.col("path")), -1), r"^([A-Z]+-\d+-\d{4})-", 1)).where("doc_id != ''")


def merge_auxiliary(documents: DataFrame, auxiliary: DataFrame, heading: str = "## Tabelas auxiliares estruturadas") -> DataFrame:
    """Documents (doc_id, text) with their auxiliary tables appended in path order: an equi-join on the derived id."""
    slug = F.regexp_replace(F.element_at(path_parts(F.col("path")), -1), r"\.md$", "")
    block = F.concat(F.lit(f"{heading} - "), slug, F.lit("\n\n"), F.trim("text"))
    added = auxiliary.where(F.trim("text") != "").groupBy("doc_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("path", block.alias("b")))), lambda s: s["b"]), "\n\n").alias("added"))
    return documents.join(added, "doc_id", "left").withColumn("text", F.concat_ws("\n\n", "text", "added")).drop("added")


def read_catalog(spark: SparkSession, path: str) -> DataFrame:
    """Entries of a JSON list; anything else gives none."""
    raw = spark.read.format("text").option("wholetext", True).load(path).select(F.ltrim("value").alias("value"))
    return raw.where(F.startswith("value", F.lit("["))).select(F.inline(F.from_json("value", f"array<struct<{', '.join(x.replace(' ', ':', 1) for x in ENTRY.split(', '))}>>")))


def pending_conversions(spark: SparkSession, root: str) -> DataFrame:
    """PDF paths without a markdown file of the same stem beside them, sorted."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root).select("path")
    stem = F.regexp_replace("path", r"\.[^./]*$", "")
    kind = lambda x: F.lower(F.regexp_extract("path", r"\.([^./]*)$", 1)) == x
    return files.where(kind("pdf")).withColumn("stem", stem).join(files.where(kind("md")).select(stem.alias("stem")), "stem", "left_anti").select("path").orderBy("path")


def change_detection(spark: SparkSession, root: str, catalog: DataFrame) -> DataFrame:
    """(path, kind): markdown files that the catalog lacks by name, and unconverted PDFs."""
    name = lambda c: F.lower(F.element_at(path_parts(c), -1))
    new = markdown_files(spark, root).withColumn("k", name(F.col("path"))).join(catalog.select(name(F.col("md_file")).alias("k")), "k", "left_anti")
    return new.select("path", F.lit("markdown").alias("kind")).unionByName(pending_conversions(spark, root).withColumn("kind", F.lit("pdf")))


# Office formats


def _cell(value) -> str:
    if value is None:
        return ""
    text = value.isoformat() if isinstance(value, (datetime.datetime, datetime.date)) else str(value)
    return text.replace("|", "\\|").replace("\r", " ").replace("\n", " ").strip()


def rows_to_markdown(rows: list[list]) -> str:
    if not rows:
        return ""
    width = max(map(len, rows))
    table = [[_cell(v) for v in [*r, *[""] * (width - len(r))]] for r in rows]
    if not any(any(r) for r in table):
        return ""
    line = lambda r: "| " + " | ".join(r) + " |"
    return "\n".join([line(table[0]), line(["---"] * width), *map(line, table[1:])])


def _local(tag: str) -> str:
    return tag.rpartition("}")[2]


def _attribute(node, name: str):
    return next((v for k, v in node.attrib.items() if _local(k) == name), None)


def docx_to_markdown(content: bytes) -> str:
    """Paragraphs and tables in body order; headings as ##; text of merged cells once."""
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        body = next(n for n in ElementTree.fromstring(z.read("word/document.xml")) if _local(n.tag) == "body")
    text = lambda node: "".join(n.text or "" for n in node.iter() if _local(n.tag) == "t").strip()
    out = []
    for node in body:
        if _local(node.tag) == "p":
            style = next((_attribute(n, "val") or "" for n in node.iter() if _local(n.tag) == "pStyle"), "")
            if t := text(node):
                out.append(f"## {t}" if style.lower().startswith(("heading", "title", "ttulo", "titulo")) else t)
        elif _local(node.tag) == "tbl":
            rows = []
            for tr in (n for n in node if _local(n.tag) == "tr"):
                cells = []
                for tc in (n for n in tr if _local(n.tag) == "tc"):
                    continued = any(_local(n.tag) == "vMerge" and _attribute(n, "val") != "restart" for n in tc.iter())
                    span = next((int(_attribute(n, "val") or 1) for n in tc.iter() if _local(n.tag) == "gridSpan"), 1)
                    cells += ["" if continued else text(tc), *[""] * (span - 1)]
                rows.append(cells)
            if table := rows_to_markdown(rows):
                out.append(table)
    done = "\n\n".join(out)
    if len(done) < LEAST_DOCX:
        raise ValueError("document without text")
    return done


def _column(reference: str) -> tuple[int, int]:
    letters = "".join(c for c in reference if c.isalpha())
    n = 0
    for c in letters.upper():
        n = 26 * n + ord(c) - 64
    return int("".join(c for c in reference if c.isdigit())) - 1, n - 1


def xlsx_to_markdown(content: bytes) -> str:
    """Visible sheets; a formula's kept value, else the formula; merged ranges repeat their first cell; shares as %."""
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        names = set(z.namelist())
        read = lambda n: ElementTree.fromstring(z.read(n))
        shared = ["".join(t.text or "" for t in si.iter() if _local(t.tag) == "t") for si in read("xl/sharedStrings.xml")] if "xl/sharedStrings.xml" in names else []
        share_styles = set()
        if "xl/styles.xml" in names:
            styles = read("xl/styles.xml")
            formats = {_attribute(n, "numFmtId"): _attribute(n, "formatCode") or "" for n in styles.iter() if _local(n.tag) == "numFmt"}
            cells = next((n for n in styles if _local(n.tag) == "cellXfs"), [])
            share_styles = {str(k) for k, n in enumerate(cells) if _attribute(n, "numFmtId") in ("9", "10") or "%" in formats.get(_attribute(n, "numFmtId"), "")}
        targets = {_attribute(n, "Id"): _attribute(n, "Target").lstrip("/").removeprefix("xl/") for n in read("xl/_rels/workbook.xml.rels")}
        out = []
        for sheet in (n for n in read("xl/workbook.xml").iter() if _local(n.tag) == "sheet"):
            if (_attribute(sheet, "state") or "visible") != "visible":
                continue
            root = read("xl/" + targets[next(v for k, v in sheet.attrib.items() if _local(k) == "id" and k != "id")])
            grid: dict[tuple[int, int], str] = {}
            for c in (n for n in root.iter() if _local(n.tag) == "c"):
                parts = {_local(n.tag): n for n in c}
                kind, value = _attribute(c, "t"), parts["v"].text if "v" in parts else None
                if kind == "s" and value is not None:
                    value = shared[int(value)]
                elif kind == "inlineStr":
                    value = "".join(t.text or "" for t in c.iter() if _local(t.tag) == "t")
                elif value is None and "f" in parts:
                    value = f"[formula: ={parts['f'].text or ''}]"
                elif value is not None and _attribute(c, "s") in share_styles and kind in (None, "n"):
                    value = f"{float(value) * 100:.2f}".rstrip("0").rstrip(".").replace(".", ",") + "%"
                at = _column(_attribute(c, "r"))
                if value is not None and at[0] < SHEET_ROWS and at[1] < SHEET_COLUMNS:
                    grid[at] = value
            for m in (n for n in root.iter() if _local(n.tag) == "mergeCell"):
                (r0, c0), (r1, c1) = map(_column, _attribute(m, "ref").split(":"))
                for r in range(r0, min(r1, SHEET_ROWS - 1) + 1):
                    for c in range(c0, min(c1, SHEET_COLUMNS - 1) + 1):
                        grid[r, c] = grid.get((r0, c0), "")
            if grid:
                height, width = (max(k[i] for k in grid) + 1 for i in (0, 1))
                rows = [[grid.get((r, c), "") for c in range(width)] for r in range(height)]
                if table := rows_to_markdown([r for r in rows if any(r)]):
                    out.append(f"## {_attribute(sheet, 'name')}\n\n{table}")
    if not out:
        raise ValueError("workbook without values")
    return "\n\n".join(out)


def no_pdf_reader(content: bytes) -> str:
    raise NotImplementedError("give a converter for PDF files")


CONVERTERS: dict[str, Callable[[bytes], str]] = {"docx": docx_to_markdown, "xlsx": xlsx_to_markdown, "pdf": no_pdf_reader}


def convert(files: DataFrame, converters: dict[str, Callable[[bytes], str]] | None = None) -> DataFrame:
    """(path, format, markdown, error) of binary files; a file that fails gives its error and no text."""
    known = CONVERTERS | (converters or {})

    def run(frames):
        for frame in frames:
            rows = []
            for path, content in zip(frame["path"], frame["content"]):
                kind = path.rpartition(".")[2].lower()
                try:
                    text = known[kind](bytes(content))
                    if kind == "pdf" and len(text) < LEAST_PDF:
                        raise ValueError("too little text")
                    rows.append((path, kind, text, None))
                except Exception as e:  # a bad file is a result, not a failed job
                    rows.append((path, kind, None, f"{type(e).__name__}: {e}"))
            yield pd.DataFrame(rows, columns=["path", "format", "markdown", "error"])

    return files.select("path", "content").mapInPandas(run, "path string, format string, markdown string, error string")


# Uploads


def _members(content: bytes, needed: str) -> bool:
    try:
        with zipfile.ZipFile(io.BytesIO(content)) as z:
            return needed in z.namelist() and "[Content_Types].xml" in z.namelist() and z.testzip() is None
    except (zipfile.BadZipFile, OSError, RuntimeError):
        return False


@F.pandas_udf(BooleanType())
def _is_office(content: pd.Series, kind: pd.Series) -> pd.Series:
    needed = {"docx": "word/document.xml", "xlsx": "xl/workbook.xml"}
    return pd.Series([k in needed and c is not None and _members(bytes(c), needed[k]) for c, k in zip(content, kind)])


def validate_uploads(files: DataFrame, max_bytes: int = MAX_UPLOAD, formats: tuple[str, ...] = ("pdf", "docx", "xlsx")) -> DataFrame:
    """Adds safe_name, format, sha256 and reason (null where the file may come in). files: name, content."""
    name = T.safe_filename(F.col("name"), "")
    kind = F.lower(F.regexp_extract(name, r"\.([^.]*)$", 1))
    rows = files.withColumns({"safe_name": name, "format": kind, "sha256": F.sha2("content", 256)})
    size = F.coalesce(F.octet_length("content"), F.lit(0))
    magic = F.hex(F.substring(F.col("content"), 1, 4)) == "25504446"
    # Only files that pass the cheap tests are opened.
    cheap = F.when(size == 0, "empty").when(size > max_bytes, "too large").when(~F.contains("safe_name", F.lit(".")), "bad name").when(~F.col("format").isin(*formats), "unknown format").when((F.col("format") == "pdf") & ~magic, "no PDF")
    rows = rows.withColumn("reason", cheap)
    office = rows.where(F.col("reason").isNull() & F.col("format").isin("docx", "xlsx"))
    office = office.withColumn("reason", F.when(~_is_office("content", "format"), "damaged or mismatched office file"))
    return rows.where(~(F.col("reason").isNull() & F.col("format").isin("docx", "xlsx"))).unionByName(office)


# Recognised images


def cached_images(links: DataFrame, cache: DataFrame) -> DataFrame:
    """Links (path, url, key) with the cached text, null where the cache is old or too poor."""
    good = cache.where((F.col("version") == OCR_VERSION) & (F.col("quality") >= OCR_LEAST)).select("key", F.col("text").alias("recognised"))
    return links.join(good, "key", "left")


def enrich_images(documents: DataFrame, cache: DataFrame, heading: str = "## Anexo OCR") -> DataFrame:
    """Documents (path, text) whose image links are followed by what the cache knows of them."""
    links = documents.select("path", F.inline(T.image_links(F.col("text"))))
    found = cached_images(links, cache).where("recognised is not null").groupBy("path").agg(F.collect_list(F.struct("url", "recognised")).alias("images"))
    text = F.aggregate(F.coalesce("images", F.array().cast("array<struct<url:string,recognised:string>>")), F.col("text"), lambda t, i: F.replace(t, F.concat(F.lit("("), i["url"], F.lit(")")), F.concat(F.lit("("), i["url"], F.lit(")\n\n"), F.lit(heading), F.lit("\n\n"), i["recognised"], F.lit("\n\n"))))
    return documents.join(found, "path", "left").withColumn("text", text).drop("images")


def write_report(summary: DataFrame, path: str, title: str) -> DataFrame:
    """Writes rows as JSON lines; returns one row with a markdown table of them. Reports have one row a case."""
    summary.write.mode("overwrite").json(path)
    cells = F.array(*(F.coalesce(F.col(c).cast("string"), F.lit("")) for c in summary.columns))
    rows = summary.select(cells.alias("c")).agg(F.sort_array(F.collect_list("c")).alias("r"))
    return rows.select(F.concat(F.lit(f"# {title}\n\n"), T.markdown_table(F.concat(F.array(F.array(*map(F.lit, summary.columns))), "r"))).alias("markdown"))


def write_sections(sections: dict[str, DataFrame], path: str, title: str) -> DataFrame:
    """Writes each section's rows as JSON lines in its own folder; one row with a markdown report that has a table a section."""
    parts = []
    for n, (name, rows) in enumerate(sections.items()):
        body = write_report(rows, f"{path}/{re.sub(r'[^a-z0-9]+', '_', name.lower()).strip('_')}", name)
        parts.append(body.select(F.lit(n).alias("n"), F.concat(F.lit("#"), "markdown").alias("part")))
    every = reduce(DataFrame.unionByName, parts).agg(F.sort_array(F.collect_list(F.struct("n", "part"))).alias("l"))
    return every.select(F.concat(F.lit(f"# {title}\n\n"), F.array_join(F.transform("l", lambda s: s["part"]), "\n\n")).alias("markdown"))


def _reader(prepared: Callable[[bytes], bytes], engine: Callable[[bytes], str]) -> Callable[[str], Column]:
    def one(image):
        try:
            return engine(prepared(bytes(image)))
        except Exception:  # other variants and engines may read it
            return None

    @F.pandas_udf("string")
    def read(content: pd.Series) -> pd.Series:
        return content.map(one).astype("object")

    return read


def recognise(images: DataFrame, prepare: list[Callable[[bytes], bytes]], engines: list[Callable[[bytes], str]], enough: float = 0.85, version: str = OCR_VERSION) -> DataFrame:
    """(key, version, quality, text) of images (key, content): each variant of the image with each engine, the best reading kept.

    Preparation and engines are hooks. A round is one variant with one engine; images whose reading scores `enough` take part
    in no further round, and an engine that fails on an image gives it no reading. What a round read is checkpointed, so no
    engine runs twice on an image. Scoring and repair are native.
    """
    left, found = images.select("key", "content"), []
    for n, (prepared, engine) in enumerate((p, e) for p in prepare for e in engines):
        texts = cut(left.select("key", _reader(prepared, engine)("content").alias("read")).where("read is not null"))
        scored = cut(texts.select(F.lit(n).alias("n"), cache_entry(F.col("key"), F.col("read"), version).alias("e")).select("n", "e.*"))
        found.append(scored)
        left = left.join(scored.where(F.col("quality") >= enough).select("key"), "key", "left_anti")
    best = best_reading(F.struct("version", "quality", "text"), F.col("quality"), F.col("n"), enough)
    return reduce(DataFrame.unionByName, found).groupBy("key").agg(best.alias("b")).select("key", "b.*")


def update_cache(cache: DataFrame, readings: DataFrame) -> DataFrame:
    """The cache with new readings (key, version, quality, text) in the place of entries with their keys; old and poor ones go."""
    good = cache.where((F.col("version") == OCR_VERSION) & (F.col("quality") >= OCR_LEAST))
    return good.join(readings.select("key"), "key", "left_anti").unionByName(readings.select("key", "version", "quality", "text"))
