"""Wide trace tables in XLSX files.

A file is a ZIP archive of XML parts. A task streams the first sheet's part and gives its cells as rows, another streams
the shared texts; cells that refer to a shared text meet it by an equal-key join. Parts are compressed as one stream, so a
file is read by one task, but in pieces, never as a whole.
"""

from __future__ import annotations

import re
import zipfile
from collections.abc import Iterator
from xml.etree.ElementTree import iterparse

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fluora.sources.traces import number
from fluora.sources.video import opened

#: Cells or texts that are handed on together.
BATCH = 50_000
SHEETS, RELATIONS, TEXTS = "xl/workbook.xml", "xl/_rels/workbook.xml.rels", "xl/sharedStrings.xml"


def _plain(tag: str) -> str:
    """A tag or attribute name without its namespace."""
    return tag.rsplit("}", 1)[-1]


def first_sheet(book: zipfile.ZipFile) -> str:
    """The part of the first sheet, by the workbook's relations."""
    with book.open(SHEETS) as f:
        link = next(v for _, e in iterparse(f) if _plain(e.tag) == "sheet" for k, v in e.attrib.items() if _plain(k) == "id" and "}" in k)
    with book.open(RELATIONS) as f:
        target = next(e.attrib["Target"] for _, e in iterparse(f) if _plain(e.tag) == "Relationship" and e.attrib["Id"] == link)
    return target.lstrip("/") if target.startswith("/") else f"xl/{target}"


def column_number(reference: str) -> int:
    """The place, from 0, of a column in letters: A is 0, Z 25, AA 26."""
    n = 0
    for c in re.match("[A-Z]+", reference).group():
        n = 26 * n + ord(c) - 64
    return n - 1


def _text(element) -> str:
    """The text of a cell or shared item; phonetic hints don't count."""
    if _plain(element.tag) == "rPh":
        return ""
    return (element.text or "" if _plain(element.tag) == "t" else "") + "".join(map(_text, element))


def sheet_cells(f) -> Iterator[tuple[int, int, str, str]]:
    """(row, column, kind, value) of a sheet's part, in order; rows and cells without a reference follow the one before."""
    row, col = -1, -1
    for event, e in iterparse(f, ("start", "end")):
        tag = _plain(e.tag)
        if event == "start" and tag == "row":
            row, col = int(e.attrib["r"]) - 1 if "r" in e.attrib else row + 1, -1
        elif event == "end" and tag == "c":
            col = column_number(e.attrib["r"]) if "r" in e.attrib else col + 1
            kind = e.attrib.get("t", "n")
            value = _text(e) if kind == "inlineStr" else next((v.text or "" for v in e if _plain(v.tag) == "v"), "")
            if value != "" or kind == "inlineStr":
                yield row, col, kind, value
        elif event == "end" and tag == "row":
            e.clear()


def shared_texts(f) -> Iterator[tuple[int, str]]:
    n = 0
    for _, e in iterparse(f):
        if _plain(e.tag) == "si":
            yield n, _text(e)
            n += 1
            e.clear()


def _streamed(found: Iterator[tuple], columns: list[str], file: str) -> Iterator[pd.DataFrame]:
    rows: list[tuple] = []
    for r in found:
        rows.append((file, *r))
        if len(rows) == BATCH:
            yield pd.DataFrame(rows, columns=["file", *columns])
            rows = []
    if rows:
        yield pd.DataFrame(rows, columns=["file", *columns])


def wide_xlsx(spark: SparkSession, path: str) -> DataFrame:
    """(col_ord, name, frame, y, cell) of the first sheet of an XLSX file, as ``wide_csv`` gives them.

    The first row has the names; repeated ones get a numbered suffix. Frames are the rows below it, by their place in the
    sheet. Truth values are 1 and 0, errors are missing; cells that a row doesn't have are empty.
    """

    def cells(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            for file in part.path:
                with opened(file) as raw, zipfile.ZipFile(raw) as book, book.open(first_sheet(book)) as f:
                    yield from _streamed(sheet_cells(f), ["row", "col_ord", "kind", "value"], file)

    def texts(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            for file in part.path:
                with opened(file) as raw, zipfile.ZipFile(raw) as book:
                    if TEXTS in book.namelist():
                        with book.open(TEXTS) as f:
                            yield from _streamed(shared_texts(f), ["nth", "text"], file)

    files = spark.read.format("binaryFile").load(path).select("path")  # contents aren't read
    rows = files.mapInPandas(cells, "file string, row long, col_ord int, kind string, value string")
    told = files.mapInPandas(texts, "file string, nth long, text string").withColumnRenamed("file", "of")
    nth = F.when(F.col("kind") == "s", F.col("value").cast("long"))
    rows = rows.withColumn("nth", nth).join(told.withColumnRenamed("nth", "at"), (F.col("file") == F.col("of")) & (F.col("nth") == F.col("at")), "left")
    cell = F.when(F.col("kind") == "s", F.col("text")).when(F.col("kind") == "e", F.lit("")).otherwise(F.col("value"))
    rows = rows.select("row", "col_ord", cell.alias("cell"))
    names, seen = [], {}
    head = {r.col_ord: r.cell for r in rows.where("row = 0").collect()}  # one row of the sheet
    for i in range(max(head, default=-1) + 1):
        name = head.get(i, "")
        n = seen.get(name, 0)
        seen[name] = n + 1
        names.append((i, f"{name}.{n}" if n else name))
    heads = spark.createDataFrame(names, "col_ord int, name string")
    frames = rows.where("row > 0").select("row").distinct()
    table = frames.join(F.broadcast(heads)).join(rows, ["row", "col_ord"], "left")  # names: one row of the sheet
    cell = F.coalesce("cell", F.lit(""))
    return table.select("col_ord", "name", (F.col("row") - 1).alias("frame"), number(cell).alias("y"), cell.alias("cell"))
