"""Files to pages of text: Spark reads the bytes, a parser by extension cuts them within the task."""

from __future__ import annotations

import io
import json
import posixpath
import re
import zipfile
from collections.abc import Callable, Iterator
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.text import chunk, sections

Page = tuple[int, str]
ROWS_PER_PAGE = 100
_W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
_A = "{http://schemas.openxmlformats.org/drawingml/2006/main}"
_P = "{http://schemas.openxmlformats.org/presentationml/2006/main}"
_R = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}"
_S = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"


def parse_text(data: bytes) -> list[Page]:
    return [(1, data.decode("utf-8", "ignore"))]


def parse_docx(data: bytes) -> list[Page]:
    """Paragraphs joined by newlines, as one page."""
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        root = ElementTree.fromstring(z.read("word/document.xml"))
    return [(1, "\n".join("".join(t.text or "" for t in p.iter(f"{_W}t")) for p in root.iter(f"{_W}p")))]


def _paragraphs(root) -> str:
    return "\n".join("".join(t.text or "" for t in p.iter(f"{_A}t")) for p in root.iter(f"{_A}p")).strip()


def _is(shape, *kinds: str) -> bool:
    place = shape.find(f".//{_P}nvPr/{_P}ph")
    return place is not None and place.get("type") in kinds


def parse_pptx(data: bytes) -> list[Page]:
    """A page for each slide that has text, numbered as the slides: title, other shapes, speaker notes."""
    out = []
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        names = set(z.namelist())
        for number, name in sorted((int(m[1]), n) for n in names if (m := re.fullmatch(r"ppt/slides/slide(\d+)\.xml", n))):
            shapes = list(ElementTree.fromstring(z.read(name)).iter(f"{_P}sp"))
            title = next((x for x in shapes if _is(x, "title", "ctrTitle")), None)
            parts = [f"Slide Title: {_paragraphs(title)}"] if title is not None and _paragraphs(title) else []
            parts += [text for x in shapes if x is not title and (text := _paragraphs(x))]
            links = f"ppt/slides/_rels/slide{number}.xml.rels"
            for link in ElementTree.fromstring(z.read(links)) if links in names else ():
                target = f"ppt/{link.get('Target', '').removeprefix('../')}"
                if link.get("Type", "").endswith("/notesSlide") and target in names:
                    notes = "\n".join(filter(None, (_paragraphs(x) for x in ElementTree.fromstring(z.read(target)).iter(f"{_P}sp") if _is(x, "body"))))
                    parts += [f"Speaker Notes: {notes}"] if notes else []
            if parts:
                out.append((number, "\n".join(parts)))
    return out or [(1, "[PowerPoint file appears to have no text content]")]


def paged(sentences: list[str], head: str = "", before: int = 0) -> list[Page]:
    """Pages of a hundred sentences, one a line, numbered on from `before`."""
    return [(before + 1 + i // ROWS_PER_PAGE, head + "\n".join(sentences[i : i + ROWS_PER_PAGE])) for i in range(0, len(sentences), ROWS_PER_PAGE)]


def parse_csv(data: bytes) -> list[Page]:
    """`Row n: k=v, k=v.` sentences, a hundred to a page; rows without values are skipped but counted. A file without any is text."""
    import csv

    rows = [r for r in csv.reader(io.StringIO(data.decode("utf-8", "ignore"))) if r]
    out = []
    for n, row in enumerate(rows[1:], 1):
        fields = [f"{k.strip()}={v.strip()}" for k, v in zip(rows[0], row, strict=False) if k and v.strip()]
        if fields:
            out.append(f"Row {n}: {', '.join(fields)}.")
    return paged(out) or parse_text(data)


def _column(reference: str) -> int:
    """The number, from 0, of the column in a cell's reference such as AB12."""
    n = 0
    for c in re.match("[A-Z]*", reference)[0]:
        n = 26 * n + ord(c) - 64
    return n - 1


def parse_xlsx(data: bytes) -> list[Page]:
    """`In sheet 's', row i: ...` sentences, rows from 0; a sheet's first row with values names the columns. Pages are numbered over all sheets, none has two."""
    out: list[Page] = []
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        shared = []
        if "xl/sharedStrings.xml" in z.namelist():
            shared = ["".join(t.text or "" for t in si.iter(f"{_S}t")) for si in ElementTree.fromstring(z.read("xl/sharedStrings.xml")).iter(f"{_S}si")]
        targets = {}
        if "xl/_rels/workbook.xml.rels" in z.namelist():
            targets = {r.get("Id"): r.get("Target", "") for r in ElementTree.fromstring(z.read("xl/_rels/workbook.xml.rels"))}
        sheets = [(s.get("name", ""), targets.get(s.get(f"{_R}id"))) for s in ElementTree.fromstring(z.read("xl/workbook.xml")).iter(f"{_S}sheet")]
        for i, (title, target) in enumerate(sheets, 1):
            # a target is relative to xl/, or to the package if it begins with a slash; a sheet without one goes by its position
            name = posixpath.normpath(posixpath.join("/xl", target))[1:] if target else f"xl/worksheets/sheet{i}.xml"
            header, sentences = None, []
            if name not in z.namelist():
                continue
            at = 0
            for row in ElementTree.fromstring(z.read(name)).iter(f"{_S}row"):
                at = int(row.get("r", at + 1))
                cells: dict[int, str] = {}
                for c in row.iter(f"{_S}c"):
                    k = _column(c.get("r", ""))
                    k = k if k >= 0 else max(cells, default=-1) + 1
                    v = c.find(f"{_S}v")
                    value = "".join(t.text or "" for t in c.iter(f"{_S}t")) if c.get("t") == "inlineStr" else (v.text if v is not None else "") or ""
                    cells[k] = (shared[int(value)] if c.get("t") == "s" and value else value).strip()
                if not any(cells.values()):
                    continue
                if header is None:
                    header = {k: cells.get(k) or f"Col{k}" for k in range(max(cells) + 1)}
                    continue
                fields = [f"{header[k]}={v}" for k, v in sorted(cells.items()) if k in header and v.lower() not in ("", "none", "null")]
                if fields:
                    sentences.append(f"In sheet '{title}', row {at - 1}: {', '.join(fields)}.")
            out += paged(sentences, f"Sheet: {title}\n\n", len(out))
    return out or [(1, "[Excel file appears to be empty]")]


#: By extension; `register_parser` adds others, such as one for PDF where a library for it is installed.
PARSERS: dict[str, Callable[[bytes], list[Page]]] = {"txt": parse_text, "log": parse_text, "json": parse_text, "csv": parse_csv, "docx": parse_docx, "pptx": parse_pptx, "ppt": parse_pptx, "xlsx": parse_xlsx, "xls": parse_xlsx}


def register_parser(extension: str, parser: Callable[[bytes], list[Page]]) -> None:
    PARSERS[extension.lower()] = parser


def parse_files(spark: SparkSession, path: str) -> DataFrame:
    """source_file, file_type, page, text, error of all files below path; unknown types are read as text.

    A row for every non-blank page, and for a file that its parser refuses (broken, or a binary .xls or .ppt, for which there is
    no parser) one row with the error and neither page nor text; the other files' pages come all the same.
    """
    parsers = dict(PARSERS)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            rows = []
            for file, data in zip(f["path"], f["content"], strict=True):
                name = file.rpartition("/")[2]
                kind = name.rpartition(".")[2].lower()
                try:
                    rows += [(name, kind, page, text, None) for page, text in parsers.get(kind, parse_text)(bytes(data)) if text.strip()]
                except Exception as e:  # whatever a parser raises is that file's error, not the job's
                    rows.append((name, kind, None, None, f"{type(e).__name__}: {e}"[:500]))
            out = pd.DataFrame(rows, columns=["source_file", "file_type", "page", "text", "error"])
            yield out.astype({"page": "Int32"})

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(run, "source_file string, file_type string, page int, text string, error string")


def read_files(spark: SparkSession, path: str) -> DataFrame:
    """source_file, file_type, page, text of every page that `parse_files` could read."""
    return parse_files(spark, path).where("error IS NULL").drop("error")


def file_chunks(pages: DataFrame) -> DataFrame:
    """source_file, file_type, page, chunk_index, text, section_type, has_risk_signal of pages (source_file, file_type, page, text).

    Each page is cut into sections and these into chunks; chunk_index runs on over a file's pages. Blank pages have no chunk.
    """
    told = pages.where(F.trim("text") != "").select(F.struct("source_file", "file_type", "page").alias("id"), "text")
    rows = chunk(sections(told)).select("id.*", "chunk_index", "text", "section_type", "has_risk_signal")
    per_page = rows.groupBy("source_file", "page").agg(F.count("*").alias("n"))
    earlier = Window.partitionBy("source_file").orderBy("page").rowsBetween(Window.unboundedPreceding, -1)
    before = per_page.select("source_file", "page", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("before"))
    rows = rows.join(before, ["source_file", "page"])
    return rows.select("source_file", "file_type", "page", (F.col("before") + F.col("chunk_index")).cast("int").alias("chunk_index"), "text", "section_type", "has_risk_signal")


def write_report(df: DataFrame, path: str) -> None:
    """A report as JSON files."""
    df.write.mode("errorifexists").json(path)


def read_cases(spark: SparkSession, path: str, key: str) -> DataFrame:
    """The cases of one array of a JSON dataset, a row each."""
    return spark.read.option("multiLine", True).json(path).select(F.explode(key).alias("case")).select("case.*")


def tolerant_json(text: str) -> dict:
    """JSON from a model's answer: as it is, else from its fenced block, else an error."""
    for candidate in (text, *re.findall(r"```(?:json)?\s*(.*?)```", text, re.DOTALL)):
        try:
            return json.loads(candidate)
        except ValueError:
            continue
    return {"error": "no JSON", "raw": text[:1000]}
