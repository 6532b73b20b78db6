"""Document parsers: bytes of a file to text and tables, as Arrow-batched functions over binary columns."""

from __future__ import annotations

import csv
import io
import re
import xml.etree.ElementTree as ET
import zipfile
from functools import lru_cache
from html.parser import HTMLParser

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType, StructField, StructType

from evidara.operators.steps import in_steps

TABLES = ArrayType(ArrayType(ArrayType(StringType())))
ARROW_PARSED = pa.struct([("text", pa.string()), ("tables", pa.list_(pa.list_(pa.list_(pa.string())))), ("error", pa.string())])
PARSED = StructType([StructField("text", StringType()), StructField("tables", TABLES), StructField("error", StringType())])
# Element names of tables, rows and cells in XML documents.
ROWS, CELLS = {"tr", "row", "table-row"}, {"td", "th", "cell", "table-cell", "covered-table-cell", "entry"}

squeeze = lambda s: " ".join(s.split())


class _Page(HTMLParser):
    """Text chunks, white space collapsed, and grids of tables; a nested table starts the outer one anew."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.chunks: list[str] = []
        self.tables: list[list[list[str]]] = []
        self.rows: list[list[str]] | None = None
        self.cell: list[str] | None = None

    def handle_starttag(self, tag, attrs):
        if tag == "table":
            self.rows = []
        elif tag == "tr" and self.rows is not None:
            self.rows.append([])
        elif tag in ("td", "th") and self.rows:
            self.cell = []

    def handle_endtag(self, tag):
        if tag in ("td", "th") and self.cell is not None and self.rows:
            self.rows[-1].append(squeeze(" ".join(self.cell)))
            self.cell = None
        elif tag == "table" and self.rows is not None:
            filled = [r for r in self.rows if any(r)]
            if filled:
                self.tables.append(filled)
            self.rows = None

    def handle_data(self, data):
        if text := squeeze(data):
            self.chunks.append(text)
            if self.cell is not None:
                self.cell.append(text)


def html(text: str) -> tuple[str, list]:
    page = _Page()
    page.feed(text)
    page.close()
    return "\n".join(page.chunks), page.tables


@lru_cache(maxsize=1024)
def _local(tag) -> str:
    return tag.rpartition("}")[2] if isinstance(tag, str) else ""


def local(e) -> str:
    return _local(e.tag)


def joined(e) -> str:
    """All text below an element, piece by piece with a space between."""
    return " ".join(t for t in map(squeeze, e.itertext()) if t)


def xml(data: bytes) -> tuple[str, list]:
    root = ET.fromstring(data)
    text = "\n".join(t for t in map(squeeze, root.itertext()) if t)
    grids = []
    for table in (e for e in root.iter() if local(e) in ("table", "tbl")):
        rows = [[squeeze("".join(c.itertext())) for c in r if local(c) in CELLS | {"tc"}] for r in table.iter() if local(r) in ROWS]
        if rows := [r for r in rows if any(r)]:
            grids.append(rows)
    return text, grids


def csv_text(text: str) -> tuple[str, list]:
    rows = [r for r in csv.reader(io.StringIO(text), delimiter=delimiter(text)) if any(c.strip() for c in r)]
    return "\n".join(" | ".join(r) for r in rows), [rows] if rows else []


def delimiter(text: str) -> str:
    """The most even of , ; tab and | over the first lines; a comma if none."""
    lines = [line for line in text[: 128 << 10].splitlines() if line.strip()][:40]
    counts = {d: [line.count(d) for line in lines] for d in ",;\t|"}
    score = lambda d: (sum(n > 0 for n in counts[d]), -len(set(counts[d])), sum(counts[d]))
    best = max(counts, key=score, default=",")
    return best if lines and sum(counts[best]) else ","


def docx(data: bytes) -> tuple[str, list]:
    """Lines are paragraphs, also those in cells; tables and rows without text are left out."""
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        root = ET.fromstring(z.read("word/document.xml"))
    lines = [t for p in root.iter() if local(p) == "p" and (t := joined(p))]
    grids = []
    for table in (e for e in root.iter() if local(e) == "tbl"):
        rows = [[joined(c) for c in r if local(c) == "tc"] for r in table if local(r) == "tr"]
        if rows := [r for r in rows if any(r)]:
            grids.append(rows)
    return "\n".join(lines), grids


@lru_cache(maxsize=4096)
def a1(ref: str) -> int:
    n = 0
    for ch in re.match("[A-Za-z]*", ref or "")[0].upper():
        n = n * 26 + ord(ch) - 64
    return n - 1


def cell_text(cell, shared: list[str]) -> str:
    """A cell's text; inline strings aren't resolved, as in the engine whose results are to be met."""
    v = ""
    for e in cell:
        if local(e) == "v":
            v = (e.text or "").strip()
            break
    kind = cell.get("t")
    if kind and kind.strip().lower() == "s" and v.isdigit() and int(v) < len(shared):
        return shared[int(v)]
    return v


def xlsx(data: bytes) -> tuple[str, list]:
    """Each sheet, by the name of its part, as a grid that is as wide as its widest row; blank rows are left out."""
    from evidara.sources import sheets  # which builds on this module

    def dense(rows) -> list[list[str]]:
        known: dict[int, dict[int, str]] = {}
        for _, number, cells in rows:
            known.setdefault(number, {}).update(cells)
        columns = range(1, max((k for cells in known.values() for k in cells), default=0) + 1)
        every = ([known[number].get(k, "") for k in columns] for number in sorted(known))
        return [row for row in every if "".join(row).strip()]

    z = sheets.Package(data)
    shared = sheets.shared_strings(z)
    parts = sorted(n for n in z.members if re.fullmatch(r"xl/worksheets/.*\.xml", n))
    grids = [g for g in (dense(sheets.sheet_rows(z, part, shared)) for part in parts) if g]
    return "\n".join(" | ".join(r) for g in grids for r in g), grids


def pptx(data: bytes) -> tuple[str, list]:
    """Text of the slides, by the name of their part, so slide10 comes before slide2; slides without text are left out."""
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        slides = (ET.fromstring(z.read(n)) for n in sorted(z.namelist()) if n.startswith("ppt/slides/slide") and n.endswith(".xml"))
        texts = [" ".join(t for e in root.iter() if local(e) == "t" and (t := (e.text or "").strip())) for root in slides]
    return "\n\n".join(t for t in texts if t), []


def odf(data: bytes) -> tuple[str, list]:
    """Text and tables of content.xml, without which the file is an error."""
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        return xml(z.read("content.xml"))


def bundle(data: bytes) -> tuple[str, list]:
    """Members of a zip of (x)html or xml files, by name; xml members that aren't well formed are passed over."""
    texts, grids = [], []
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        for name in sorted(z.namelist()):
            if re.search(r"\.(x?html|htm)$", name, re.I):
                text, tables = html(z.read(name).decode("utf-8", "replace"))
            elif name.lower().endswith(".xml"):
                try:
                    text, tables = joined(ET.fromstring(z.read(name))), xml(z.read(name))[1]
                except ET.ParseError:
                    continue
            else:
                continue
            texts.append(text)
            grids += tables
    return "\n\n".join(t for t in texts if t), grids


def markdown(text: str) -> tuple[str, list]:
    """Pipe tables: a header, a divider, then rows of the same width."""
    cells = lambda line: [c.strip() for c in line.strip().strip("|").split("|")]
    lines, grids, i = text.splitlines(), [], 0
    while i + 1 < len(lines):
        if "|" in lines[i] and re.fullmatch(r"\s*\|?(\s*:?-{3,}:?\s*\|)*\s*:?-{3,}:?\s*\|?\s*", lines[i + 1]) and "|" in lines[i + 1]:
            grid = [cells(lines[i])]
            i += 2
            while i < len(lines) and "|" in lines[i] and lines[i].strip() and len(cells(lines[i])) == len(grid[0]):
                grid.append(cells(lines[i]))
                i += 1
            grids.append(grid)
        else:
            i += 1
    return text, grids


PARSERS = {
    "html": lambda b: html(b.decode("utf-8", "replace")), "xml": xml, "csv": lambda b: csv_text(b.decode("utf-8-sig", "replace")), "docx": docx, "xlsx": xlsx,
    "pptx": pptx, "odf": odf, "zip": bundle,
    "markdown": lambda b: markdown(b.decode("utf-8", "replace")), "latin1": lambda b: (b.decode("latin-1"), []),
}


def parser_of(media: Column, suffix: Column) -> Column:
    """Which of PARSERS reads a file: by media type, then suffix; null if none."""
    m = F.lower(F.coalesce(media, F.lit("")))
    s = F.lower(F.coalesce(suffix, F.lit("")))
    return (
        F.when((m == "text/csv") | (s == ".csv"), "csv").when(m.isin("text/markdown", "text/plain") | s.isin(".txt", ".md", ".rst", ".adoc", ".tex"), "markdown")
        .when(m.isin("text/html", "application/xhtml+xml") | s.isin(".html", ".htm", ".xhtml"), "html").when(m.isin("application/xml", "text/xml", "image/svg+xml") | s.isin(".xml", ".svg", ".fb2", ".dita", ".dbk"), "xml")
        .when(s == ".docx", "docx").when(s == ".doc", "latin1").when(s == ".xlsx", "xlsx").when(s == ".pptx", "pptx").when(s.isin(".odt", ".ods", ".odp", ".odg"), "odf").when(s.isin(".epub", ".oxps", ".3mf"), "zip")
    )


def dealt(rows: DataFrame, *by: str) -> DataFrame:
    """Rows of few bytes and long work, dealt to all tasks (by keys, if some are given) before files are written or read from them: a table's file may be one task."""
    return rows.repartition(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), *by)


@F.arrow_udf(PARSED)
def parse(kind: pa.Array, content: pa.Array) -> pa.Array:
    """Text and tables of each file; a file that can't be read has an error and nothing else."""
    kinds = iter(kind.to_pylist())

    def one(k, data) -> dict:
        try:
            text, tables = PARSERS[k](data) if k in PARSERS and data is not None else (None, [])
            return {"text": text, "tables": tables, "error": None if text is not None else "unsupported"}
        except Exception as e:  # noqa: BLE001  a broken file is a row with its reason
            return {"text": None, "tables": [], "error": f"{type(e).__name__}: {e}"}

    return in_steps(content, lambda files: pa.array([one(next(kinds), data) for data in files], ARROW_PARSED))


def canonical_urls(text: str) -> list[str]:
    """Addresses that a page gives for itself: canonical link, og and twitter, refresh, base; http(s), each once."""
    found: list[str] = []

    class P(HTMLParser):
        def handle_starttag(self, tag, attrs):
            a = {k: v or "" for k, v in attrs}
            if tag == "link" and "canonical" in a.get("rel", "").lower():
                found.append(a.get("href", ""))
            elif tag == "meta" and (a.get("property") or a.get("name", "")).lower() in ("og:url", "twitter:url"):
                found.append(a.get("content", ""))
            elif tag == "meta" and a.get("http-equiv", "").lower() == "refresh" and (m := re.search(r"url\s*=\s*['\"]?([^'\";]+)", a.get("content", ""), re.I)):
                found.append(m[1].strip())
            elif tag == "base":
                found.append(a.get("href", ""))

    P().feed(text)
    return list(dict.fromkeys(u for u in found if re.match("https?://", u, re.I)))


@F.pandas_udf(ArrayType(StringType()))
def page_urls(pages: pd.Series) -> pd.Series:
    return pages.map(lambda p: canonical_urls(p) if p else [])


# Suffixes of the files that a folder's scan takes.
CANDIDATES = (
    ".pdf", ".doc", ".docx", ".xls", ".xlsx", ".csv", ".txt", ".rst", ".adoc", ".tex", ".html", ".htm", ".xml", ".xhtml",
    ".svg", ".fb2", ".dita", ".dbk", ".pptx", ".odt", ".ods", ".odp", ".odg", ".epub", ".oxps", ".3mf", ".md",
)


def files(spark, path: str, suffixes: tuple[str, ...] = CANDIDATES) -> DataFrame:
    """(path, suffix, length, content) of the files below a folder with one of the suffixes; content that isn't used isn't read."""
    read = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    suffix = F.lower(F.regexp_extract("path", r"(\.[^./]+)$", 1))
    return read.select("path", suffix.alias("suffix"), "length", "content").filter(F.col("suffix").isin(*suffixes))
