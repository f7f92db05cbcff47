"""Excel workbooks as a job over many files, one workbook per input row.

A workbook is a zip of XML parts.  Each task streams the rows of its sheets, so a
sheet is never held as a table; only the shared strings of one workbook are.
"""

from __future__ import annotations

import io
import posixpath
import re
import zipfile
from collections.abc import Iterator, Sequence
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# XML names of the workbook format.
_MAIN = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
_REL_ID = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}id"

BATCH_ROWS = 1_000


def _column_index(reference: str) -> int:
    """'C7' -> 2."""
    index = 0
    for letter in re.match(r"[A-Z]+", reference).group():
        index = index * 26 + ord(letter) - 64
    return index - 1


def _text(node: ElementTree.Element) -> str:
    """Plain or rich text without phonetic readings."""
    runs = node.findall(f"{_MAIN}r") or [node]
    return "".join(t.text or "" for run in runs for t in run.findall(f"{_MAIN}t"))


def _sheet_part(book: zipfile.ZipFile, sheet: int | str) -> str:
    sheets = list(ElementTree.fromstring(book.read("xl/workbook.xml")).iter(f"{_MAIN}sheet"))
    chosen = sheets[sheet] if isinstance(sheet, int) else next(s for s in sheets if s.get("name") == sheet)
    links = ElementTree.fromstring(book.read("xl/_rels/workbook.xml.rels"))
    target = next(link.get("Target") for link in links if link.get("Id") == chosen.get(_REL_ID))
    return posixpath.normpath(posixpath.join("xl", target)).lstrip("/") if target[0] != "/" else target[1:]


def workbook_rows(content: bytes, sheet: int | str = 0) -> Iterator[list[str | None]]:
    """Cell texts of one sheet, row by row; empty cells are None."""
    with zipfile.ZipFile(io.BytesIO(content)) as book:
        shared: list[str] = []
        if "xl/sharedStrings.xml" in book.namelist():
            with book.open("xl/sharedStrings.xml") as part:
                for _, node in ElementTree.iterparse(part):
                    if node.tag == f"{_MAIN}si":
                        shared.append(_text(node))
                        node.clear()
        with book.open(_sheet_part(book, sheet)) as part:
            for _, node in ElementTree.iterparse(part):
                if node.tag != f"{_MAIN}row":
                    continue
                cells: list[str | None] = []
                for cell in node.findall(f"{_MAIN}c"):
                    at = _column_index(cell.get("r")) if cell.get("r") else len(cells)
                    cells.extend([None] * (at + 1 - len(cells)))
                    kind, value = cell.get("t"), cell.find(f"{_MAIN}v")
                    inline = cell.find(f"{_MAIN}is")
                    if inline is not None:
                        cells[at] = _text(inline)
                    elif value is not None and value.text is not None and kind != "e":
                        if kind == "s":
                            cells[at] = shared[int(value.text)]
                        elif kind == "b":
                            cells[at] = str(value.text == "1")
                        else:
                            cells[at] = value.text
                yield cells
                node.clear()


def parse_workbooks(books: DataFrame, columns: Sequence[str], sheet: int | str = 0) -> DataFrame:
    """Rows of all workbooks in the binary column ``content``; columns by header name."""
    names = list(columns)

    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for content in batch["content"]:
                rows = workbook_rows(content, sheet)
                header = next(rows, [])
                places = [header.index(name) if name in header else None for name in names]
                found: list[list[str | None]] = []
                for row in rows:
                    if not any(row):
                        continue
                    found.append([row[p] if p is not None and p < len(row) else None for p in places])
                    if len(found) == BATCH_ROWS:
                        yield pd.DataFrame(found, columns=names)
                        found = []
                if found:
                    yield pd.DataFrame(found, columns=names)

    schema = ", ".join(f"`{name}` string" for name in names)
    return books.select("content").mapInPandas(parse, schema)


def workbook_columns(books: DataFrame, sheet: int | str = 0) -> list[str]:
    """The header names of all workbooks, in the order of their first appearance by place, then name."""

    def first(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            seen: dict[str, int] = {}
            for content in batch["content"]:
                for place, name in enumerate(next(workbook_rows(content, sheet), [])):
                    if name:
                        seen[name] = min(place, seen.get(name, place))
            yield pd.DataFrame({"name": list(seen), "place": list(seen.values())}).astype({"name": str, "place": int})

    found = books.select("content").mapInPandas(first, "name string, place int")
    names = found.groupBy("name").agg(F.min("place").alias("place"))
    return [row["name"] for row in names.orderBy("place", "name").collect()]  # column names only


def read_workbooks(books: DataFrame, sheet: int | str = 0, columns: Sequence[str] | None = None) -> DataFrame:
    """All workbooks of the binary column ``content``, as string columns named by the header rows.

    Workbooks may differ in their columns: the result has all of them, null where a
    workbook lacks one.
    """
    return parse_workbooks(books, columns or workbook_columns(books, sheet), sheet)


def workbook_files(spark: SparkSession, path: str) -> DataFrame:
    """All ``.xlsx`` files below a path, one row each."""
    books = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    return books.where(F.lower("path").endswith(".xlsx")).select("content")
