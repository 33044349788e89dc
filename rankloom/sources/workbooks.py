"""Workbooks (xlsx) as rows.

Spark reads the files, so they may lie in any store it reaches; each is one row of bytes, and one function
turns it into the rows of a sheet, streaming its cells, so a folder of workbooks is read by as many tasks as
it has splits of files. A sheet's first row names its columns; only those asked for are read, in any order,
and one that a workbook lacks is null there. Values are text: shared and inline strings with their line
breaks and all their formatted runs, numbers and booleans as the file writes them, formulas by their
stored result. An empty or missing cell is null, and a row without any value of the columns is none.
"""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree as XML

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

ROWS_AT_ONCE = 4096
# The namespaces and part names of the format.
_MAIN = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
_LINK = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}id"
_BOOK, _LINKS, _STRINGS = "xl/workbook.xml", "xl/_rels/workbook.xml.rels", "xl/sharedStrings.xml"


def _texts(element) -> str:
    """The text of a string item: its own or all its runs', without phonetic guides."""
    return "".join(t.text or "" for e in element if e.tag in (f"{_MAIN}t", f"{_MAIN}r")
                   for t in ([e] if e.tag == f"{_MAIN}t" else e.iter(f"{_MAIN}t")))


def _finished(book: zipfile.ZipFile, part: str, tag: str):
    """The elements of a name as they end; each is let go after use."""
    with book.open(part) as f:
        for _, e in XML.iterparse(f):
            if e.tag == _MAIN + tag:
                yield e
                e.clear()


def _part_of(book: zipfile.ZipFile, sheet: str | None) -> str:
    """The part of the named sheet, or of the first."""
    links = {e.get("Id"): e.get("Target") for e in XML.fromstring(book.read(_LINKS))}
    for e in XML.fromstring(book.read(_BOOK)).iter(f"{_MAIN}sheet"):
        if sheet in (None, e.get("name")):
            target = links[e.get(_LINK)]
            return target.lstrip("/") if target.startswith("/") else f"xl/{target}"
    raise ValueError(f"no sheet {sheet!r}")


def _column(reference: str | None, after: int) -> int:
    """Number of a cell's column from its reference (``BC7``); the next one where it has none."""
    letters = re.match(r"[A-Z]+", reference or "")
    if not letters:
        return after + 1
    n = 0
    for c in letters.group():
        n = 26 * n + ord(c) - 64
    return n - 1


def sheet_rows(content: bytes, sheet: str | None = None) -> Iterator[tuple[int, dict[int, str]]]:
    """(number from 1, values by column) of the rows of a workbook's sheet."""
    with zipfile.ZipFile(io.BytesIO(content)) as book:
        strings = [_texts(e) for e in _finished(book, _STRINGS, "si")] if _STRINGS in book.namelist() else []
        number = 0
        for row in _finished(book, _part_of(book, sheet), "row"):
            number = int(row.get("r") or number + 1)
            values, at = {}, -1
            for cell in row.iter(f"{_MAIN}c"):
                at = _column(cell.get("r"), at)
                kind, v, inline = cell.get("t"), cell.find(f"{_MAIN}v"), cell.find(f"{_MAIN}is")
                text = _texts(inline) if inline is not None else v.text if v is not None else None
                if text is not None and kind == "s":
                    text = strings[int(text)]
                if text:
                    values[at] = text
            yield number, values


def read_workbooks(spark: SparkSession, path: str, columns: list[str], sheet: str | None = None) -> DataFrame:
    """(file, row, the named columns) of every workbook under ``path``, from its first or the named sheet. A
    file that is no workbook, or lacks the sheet, fails the job with its name."""
    schema = ", ".join(["file string", "row int", *(f"`{c}` string" for c in columns)])
    fields = ["file", "row", *columns]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, content in zip(batch.column("path").to_pylist(), batch.column("content"), strict=True):
                try:
                    yield from _batches(name, content.as_py())
                except (zipfile.BadZipFile, KeyError, ValueError, IndexError, XML.ParseError) as e:
                    raise ValueError(f"{name} cannot be read as a workbook: {e}") from e

    def _batches(name: str, content: bytes) -> Iterator[pa.RecordBatch]:
        rows, heads = sheet_rows(content, sheet), None
        out: list[list] = []
        for number, values in rows:
            if heads is None:
                heads = {text.strip(): at for at, text in reversed(values.items())}
                continue
            found = [values.get(heads[c]) if c in heads else None for c in columns]
            if any(x is not None for x in found):
                out.append([name, number, *found])
            if len(out) == ROWS_AT_ONCE:
                yield _batch(out)
                out = []
        if out:
            yield _batch(out)

    def _batch(rows: list[list]) -> pa.RecordBatch:
        kinds = [pa.string(), pa.int32(), *([pa.string()] * len(columns))]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], fields)

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.xlsx").option("recursiveFileLookup", "true").load(path)
    return files.select("path", "content").mapInArrow(run, schema)


def read_labelled_workbooks(spark: SparkSession, path: str) -> DataFrame:
    """labelled(Query, Assessment_url, ord) of a folder of workbooks; ``ord`` keeps file and row order."""
    rows = read_workbooks(spark, path, ["Query", "Assessment_url"])
    return rows.select("Query", "Assessment_url", F.struct("file", "row").alias("ord"))
