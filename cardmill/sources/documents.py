"""Scans of study documents: text, Markdown, slides and pages as chunks.

Each reader gives (doc_id, chunk_pos, text, source). Files are read by the
cluster (``text`` with wholetext, ``binaryFile``), one row per file; slides and
pages are taken apart in Python where the file is.
"""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

TEXT_SUFFIXES = (".txt", ".md", ".markdown", ".text")
CHUNKS = "doc_id string, chunk_pos int, text string, source string"
_A = "{http://schemas.openxmlformats.org/drawingml/2006/main}"
_C = "{http://schemas.openxmlformats.org/drawingml/2006/chart}"
_R = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}"
SMALLEST_IMAGE = 32
#: Signs of formulas.
MATH_OPERATORS = r"[=+\-−*/×÷^<>≤≥≈≠∑∏∫√∂∇]"
MATH_SIGNS = r"[∑∏∫√∂∇≤≥≈≠∞±]"
GREEK = r"[Α-Ωα-ω]"


def looks_like_math(line: Column) -> Column:
    """A short line with an operator and a distinctive sign, a Greek letter, an
    equation with two sides or two operators."""
    text = F.btrim(F.regexp_replace(line, r"\s+", " "))
    operators = F.regexp_count(text, F.lit(MATH_OPERATORS))
    named = text.rlike("[A-Za-z0-9]")
    sides = (F.btrim(F.substring_index(text, "=", 1)) != "") & (F.btrim(F.regexp_extract(text, "=(.*)$", 1)) != "")
    return (text != "") & (F.length(text) <= 240) & (operators > 0) & (text.rlike(MATH_SIGNS) | text.rlike(GREEK) | (text.contains("=") & named & sides) | (~text.contains("=") & (operators >= 2) & named))


#: What stands around a formula that is marked.
MATH_MARK = ("[math: ", " | source text layer]")


def math_marks(text: Column) -> Column:
    """The lines of a text that look like formulas, each once and marked as read from it."""
    tidy = F.transform(F.split(F.coalesce(text, F.lit("")), r"\r\n|[\n\r]"), lambda x: F.btrim(F.regexp_replace(x, r"\s+", " ")))
    return F.transform(F.array_distinct(F.filter(tidy, looks_like_math)), lambda x: F.concat(F.lit(MATH_MARK[0]), x, F.lit(MATH_MARK[1])))


def with_math(chunks: DataFrame) -> DataFrame:
    """Chunks whose formulas stand once more, marked, at the end of their text; null stays null."""
    marked = F.concat_ws("\n", "text", F.nullif(F.array_join(math_marks(F.col("text")), "\n"), F.lit("")))
    return chunks.withColumn("text", F.when(F.col("text").isNotNull(), marked))


def table_rows(rows: list[list[str | None]]) -> str:
    """Rows of a grid as lines with bars; empty rows are left out."""
    lines = (" | ".join((c or "").strip() for c in row) for row in rows)
    return "\n".join(line for line in lines if line.strip(" |"))


def read_text_files(spark: SparkSession, path: str) -> DataFrame:
    """One chunk per text file with text; the source is the file's name."""
    name = F.col("_metadata.file_name")
    rows = spark.read.text(path, wholetext=True).select(name.alias("source"), F.btrim(F.regexp_replace("value", r"^[\s ]+|[\s ]+$", "")).alias("text"))
    return rows.where("text <> ''").select(F.col("source").alias("doc_id"), F.lit(0).alias("chunk_pos"), "text", "source")


def chart_value(value: str | None) -> str:
    """A chart's number: whole ones without a point, others to twelve digits."""
    if value is None or value == "":
        return ""
    try:
        number = float(value)
    except ValueError:
        return value
    return str(int(number)) if number == int(number) else format(number, ".12g")


def _paragraphs(node: ElementTree.Element) -> str:
    lines = ("".join(t.text or "" for t in p.iter(f"{_A}t")) for p in node.iter(f"{_A}p"))
    return "\n".join(line for line in lines if line.strip())


def _chart(xml: bytes) -> str:
    root = ElementTree.fromstring(xml)
    title = root.find(f".//{_C}title")
    names, columns, labels = [], [], []
    for series in root.iter(f"{_C}ser"):
        name = series.find(f"{_C}tx//{_C}v")
        names.append((name.text or "") if name is not None else "")
        for part, into in (("cat", labels), ("val", None)):
            points = {int(p.get("idx", "0")): (p.findtext(f"{_C}v") or "") for p in series.iterfind(f"{_C}{part}//{_C}pt")}
            if into is None:
                columns.append(points)
            elif not into:
                into.extend(points.get(i, "") for i in range(max(points, default=-1) + 1))
    grid = [["Category", *names]] + [[label, *(chart_value(c.get(i)) for c in columns)] for i, label in enumerate(labels)]
    head = "Chart" + (f": {' '.join(_paragraphs(title).split())}" if title is not None and _paragraphs(title) else "")
    return f"{head}\n{table_rows(grid)}" if labels else ""


def slide_texts(content: bytes) -> list[tuple[int, str]]:
    """(number, text) of the slides with text: frames, tables, charts, notes."""
    out = []
    with zipfile.ZipFile(io.BytesIO(content)) as package:
        names = set(package.namelist())
        slides = sorted((int(m[1]), n) for n in names if (m := re.fullmatch(r"ppt/slides/slide(\d+)\.xml", n)))
        for number, name in slides:
            root = ElementTree.fromstring(package.read(name))
            parts = []
            for table in root.iter(f"{_A}tbl"):
                parts.append("Table:\n" + table_rows([["".join(t.text or "" for t in cell.iter(f"{_A}t")) for cell in row.iter(f"{_A}tc")] for row in table.iter(f"{_A}tr")]))
                table.clear()
            parts.insert(0, _paragraphs(root))
            links = f"ppt/slides/_rels/slide{number}.xml.rels"
            for link in ElementTree.fromstring(package.read(links)) if links in names else ():
                target = re.sub(r"^\.\./", "ppt/", link.get("Target", ""))
                if target in names and "/charts/" in target:
                    parts.append(_chart(package.read(target)))
                elif target in names and "/notesSlides/" in target:
                    notes = _paragraphs(ElementTree.fromstring(package.read(target)))
                    parts.append(f"Notes: {notes}" if notes else "")
            text = "\n".join(p for p in parts if p.strip()).strip()
            if text:
                out.append((number, text))
    return out


def page_texts(content: bytes, name: str, ocr: bool = False) -> list[tuple[str, str]]:
    """(source, text) of the pages of a PDF; needs PyMuPDF on the workers."""
    try:
        import fitz
    except ImportError as missing:
        raise RuntimeError("reading PDF pages needs PyMuPDF on the workers") from missing
    out = []
    with fitz.open(stream=content, filetype="pdf") as document:
        for number, page in enumerate(document, 1):
            source, text = f"{name} p.{number}", page.get_text().strip()
            images = [i for i in page.get_images(full=True) if i[2] >= SMALLEST_IMAGE and i[3] >= SMALLEST_IMAGE]
            if text:
                grids = [t.extract() for t in page.find_tables().tables]
                tables = ["Table:\n" + table_rows(g) for g in grids if len(g) > 1 and max(map(len, g)) > 1]
                out.append((source, "\n".join([text, *tables])))
            elif images:
                seen = ""
                if ocr:
                    try:
                        seen = page.get_text(textpage=page.get_textpage_ocr(full=True)).strip()
                    except Exception:  # no recognition installed
                        seen = ""
                marker = f"[page without text: {len(images)} image{'s' * (len(images) != 1)}; {'nothing recognised' if ocr else 'recognition is off'}]"
                out.append((f"{source} (OCR)", seen) if seen else (source, marker))
    return out


def read_slides(spark: SparkSession, path: str) -> DataFrame:
    """One chunk per slide with text; a file that is no package gives none."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for name, content in zip(batch["name"], batch["content"]):
                try:
                    rows += [(name, at, text, f"{name} slide {number}") for at, (number, text) in enumerate(slide_texts(content))]
                except (zipfile.BadZipFile, ElementTree.ParseError):
                    continue
            yield pd.DataFrame(rows, columns=["doc_id", "chunk_pos", "text", "source"]).astype({"chunk_pos": "int32"})

    return _files(spark, path).mapInPandas(run, CHUNKS)


def read_pages(spark: SparkSession, path: str, ocr: bool = False) -> DataFrame:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [(name, at, text, source) for name, content in zip(batch["name"], batch["content"]) for at, (source, text) in enumerate(page_texts(content, name, ocr))]
            yield pd.DataFrame(rows, columns=["doc_id", "chunk_pos", "text", "source"]).astype({"chunk_pos": "int32"})

    return with_math(_files(spark, path).mapInPandas(run, CHUNKS))


def _files(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.format("binaryFile").load(path).select(F.regexp_extract("path", r"([^/]+)$", 1).alias("name"), "content")


def read_documents(spark: SparkSession, path: str, ocr: bool = False) -> DataFrame:
    """Chunks of a file by its suffix; an unknown suffix is a ValueError."""
    suffix = re.search(r"(\.\w+)$", path.lower())
    kind = suffix[1] if suffix else ""
    if kind in TEXT_SUFFIXES:
        return read_text_files(spark, path)
    if kind == ".pptx":
        return read_slides(spark, path)
    if kind == ".pdf":
        return read_pages(spark, path, ocr)
    raise ValueError(f"no reader for files like {path!r}")
