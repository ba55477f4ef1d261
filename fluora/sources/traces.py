"""Readers: wide trace tables as CSV, square matrices, graph JSON, regions of interest."""

from __future__ import annotations

import csv
import struct
import zipfile
from collections.abc import Iterator
from io import BytesIO

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Cell texts that mean a missing number.
MISSING = ("", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN", "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null")


def number(cell: Column) -> Column:
    """A cell as a double, null for missing tokens and for what isn't a number."""
    cell = F.trim(cell)
    return F.nanvl(F.when(~cell.isin(*MISSING), cell).try_cast("double"), F.lit(None).cast("double"))


def header(spark: SparkSession, path: str) -> list[str]:
    """The column names of a CSV file, from its first record; repeated names get a numbered suffix after a dot."""
    lines, n = spark.read.text(path, lineSep="\n"), 1
    while True:  # on as long as a quoted name is open
        first = [r[0] for r in lines.limit(n).collect()]
        text = "\n".join(first)
        if text.count('"') % 2 == 0 or len(first) < n:
            break
        n *= 2
    names, seen = [], {}
    for name in next(csv.reader(text.rstrip("\r").splitlines(keepends=True)), [""]):
        n = seen.get(name, 0)
        seen[name] = n + 1
        names.append(f"{name}.{n}" if n else name)
    return names


def records(spark: SparkSession, path: str) -> DataFrame:
    """(record, value): the records of a CSV file, numbered from 0 in file order; quoted cells may hold line breaks.

    Whether a line begins within quotes depends on all quotes before it. Each split counts its quotes, and its records for
    either case of how it begins; the counts are combined over the splits in order, so splits are read in parallel. Lines
    of one record are put together again, also over the border of two splits; blank lines between records don't count.
    """
    place = F.struct("_metadata.file_path", "_metadata.file_block_start", F.monotonically_increasing_id().alias("n"))
    lines = spark.read.text(path, lineSep="\n").select(place.alias("place"), "value")
    lines = lines.withColumn("chunk", F.struct("place.file_path", "place.file_block_start"))
    lines = lines.withColumn("quotes", F.length("value") - F.length(F.replace("value", F.lit('"'), F.lit("")))).withColumn("blank", F.col("value").isin("", "\r"))
    before = Window.partitionBy("chunk").orderBy("place.n").rowsBetween(Window.unboundedPreceding, -1)
    lines = lines.withColumn("open", F.coalesce(F.sum("quotes").over(before), F.lit(0)) % 2 == 1)
    counts = lines.groupBy("chunk").agg(F.sum("quotes").alias("quotes"), F.count_if(F.expr("not open and not blank")).alias("outside"), F.count_if(F.expr("open and not blank")).alias("inside"))
    ahead = Window.orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)  # a row a split
    counts = counts.withColumn("opens", F.coalesce(F.sum("quotes").over(ahead), F.lit(0)) % 2 == 1)
    counts = counts.withColumn("first", F.coalesce(F.sum(F.when(F.col("opens"), F.col("inside")).otherwise(F.col("outside"))).over(ahead), F.lit(0)))
    rows = lines.drop("quotes").join(counts.select("chunk", "opens", "first"), "chunk")
    quotes = F.length("value") - F.length(F.replace("value", F.lit('"'), F.lit("")))
    rows = rows.withColumn("within", F.col("open") != F.col("opens")).withColumn("starts", ~F.col("within") & ~F.col("blank"))
    so_far = Window.partitionBy("chunk").orderBy("place.n").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("record", F.col("first") + F.count_if("starts").over(so_far) - 1).withColumn("part", F.col("within") | (quotes % 2 == 1))
    whole = rows.where("starts and not part").select("record", "value")
    broken = rows.where("part").groupBy("record").agg(F.sort_array(F.collect_list(F.struct("place", "value"))).alias("s"))
    return whole.unionByName(broken.select("record", F.array_join("s.value", "\n").alias("value")))


def _cells(line: Column) -> Column:
    """The cells of a CSV line; lines without quotes are split at commas."""
    quoted = F.regexp_extract_all(F.concat(F.lit(","), line), F.lit(r',("[^"]*(?:""[^"]*)*"|[^,]*)'), 1)
    plain = F.transform(quoted, lambda c: F.when(c.startswith('"'), F.replace(F.substr(c, F.lit(2), F.length(c) - 2), F.lit('""'), F.lit('"'))).otherwise(c))
    return F.when(line.contains('"'), plain).otherwise(F.split(line, ",", -1))


def wide_csv(spark: SparkSession, path: str, only: list[str] | None = None) -> DataFrame:
    """(col_ord, name, frame, y, cell) of a wide CSV: records are split and exploded, never inferred column by column.

    Frames are the records in file order. Quoted cells may hold commas, doubled quotes and line breaks. With ``only``,
    other columns' cells are dropped from a record before it is exploded.
    """
    names = header(spark, path)
    rows = records(spark, path).where("record > 0")
    wanted = F.array(*[F.lit(only is None or n in only) for n in names])
    placed = F.transform(_cells(F.regexp_replace("value", "\r$", "")), lambda c, i: F.struct(i.alias("col_ord"), c.alias("cell")))
    cells = rows.select((F.col("record") - 1).alias("frame"), F.explode(F.filter(placed, lambda s: F.coalesce(F.get(wanted, s["col_ord"]), F.lit(False)))).alias("s"))
    cells = cells.select("frame", "s.col_ord", "s.cell")
    name = F.element_at(F.array(*[F.lit(n) for n in names]), F.col("col_ord") + 1)
    return cells.select("col_ord", name.alias("name"), "frame", number(F.col("cell")).alias("y"), "cell")


def times(cells: DataFrame) -> DataFrame:
    """(frame, t) of the first of the columns ``time_s`` and ``time`` that has a finite number in every frame, else empty."""
    frames = cells.select("frame").distinct().count()
    rows = cells.where(F.trim("name").isin("time_s", "time") & F.col("y").isNotNull() & (F.abs("y") < float("inf")))
    full = {r["name"] for r in rows.groupBy(F.trim("name").alias("name")).agg(F.countDistinct("frame").alias("n")).where(F.col("n") == frames).collect()}
    name = next((n for n in ("time_s", "time") if n in full), "")
    return rows.where(F.trim("name") == name).select("frame", F.col("y").alias("t"))


def numeric_columns(cells: DataFrame) -> DataFrame:
    """(col_ord, name) of the columns whose cells are all numbers or missing, metadata names left out."""
    from fluora.functions.columns import ignored

    bad = F.col("y").isNull() & ~F.trim("cell").isin(*MISSING)
    return cells.where(~ignored(F.col("name"))).groupBy("col_ord", "name").agg(F.bool_or(bad).alias("bad")).where("not bad").select("col_ord", "name").orderBy("col_ord")


def matrix_csv(spark: SparkSession, path: str) -> DataFrame:
    """(i, j, value) of a labelled square matrix: the first column holds the row labels."""
    cells = wide_csv(spark, path)
    labels = cells.where("col_ord = 0").select("frame", F.trim("cell").alias("i"))
    values = cells.where("col_ord > 0").select("frame", F.trim("name").alias("j"), "y")
    n, m = labels.count(), values.select("j").distinct().count()
    if n != m or n < 2:
        raise ValueError(f"not a square matrix of two rows at least: {n} x {m}")
    return values.join(labels, "frame").select("i", "j", F.col("y").alias("value"))


def jgf(documents: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) of rows (json): a graph, the first of graphs, or bare nodes; nodes as a list or by id.

    nodes: (id, ord, label, x, y) with the ordinal for missing coordinates; edges: (source, target, weight), 0 where no
    number is given.
    """
    node = "STRUCT<id: STRING, label: STRING, metadata: STRUCT<x: DOUBLE, y: DOUBLE, roi_name: STRING, strength: DOUBLE>>"
    edge = "STRUCT<source: STRING, target: STRING, weight: STRING, metadata: STRUCT<weight: STRING>>"
    whole = F.coalesce(F.get_json_object("json", "$.graph"), F.get_json_object("json", "$.graphs[0]"), F.col("json"))
    rows = documents.select(whole.alias("g"))
    raw = F.get_json_object("g", "$.nodes")
    listed = F.from_json(raw, f"ARRAY<{node}>")
    keyed = F.transform(F.map_entries(F.from_json(raw, f"MAP<STRING, {node}>")), lambda e: F.struct(e["key"].alias("id"), e["value"]["label"].alias("label"), e["value"]["metadata"].alias("metadata")))
    nodes = rows.select(F.posexplode(F.when(F.ltrim(raw).startswith("{"), keyed).otherwise(listed)).alias("ord", "n"))
    if nodes.isEmpty():
        raise ValueError("the graph has no nodes")
    nodes = nodes.select("n.id", "ord", F.coalesce("n.label", "n.id").alias("label"), F.coalesce("n.metadata.x", F.col("ord").cast("double")).alias("x"), F.coalesce("n.metadata.y", F.col("ord").cast("double")).alias("y"))
    edges = rows.select(F.explode(F.from_json(F.get_json_object("g", "$.edges"), f"ARRAY<{edge}>")).alias("e"))
    weight = F.coalesce(F.coalesce("e.metadata.weight", "e.weight").try_cast("double"), F.lit(0.0))
    return nodes, edges.select("e.source", "e.target", weight.alias("weight"))


#: Fixed values of the region file format: magic, version, shape codes, sizes of both headers.
ROI_MAGIC, ROI_VERSION, ROI_POLYGON, ROI_RECT, ROI_OVAL, ROI_HEAD = b"Iout", 227, 0, 1, 2, 64


def encode_roi(kind: str, xs=(), ys=(), left: int = 0, top: int = 0, width: int = 0, height: int = 0) -> bytes:
    """A region as a file: bounding box, then the corners' offsets from it, then an empty second header."""
    xs, ys = [int(round(x)) for x in xs], [int(round(y)) for y in ys]
    if kind == "polygon":
        left, top, width, height = min(xs), min(ys), max(xs) - min(xs), max(ys) - min(ys)
    code = {"polygon": ROI_POLYGON, "rect": ROI_RECT, "oval": ROI_OVAL}[kind]
    head = struct.pack(">4shBBhhhhH", ROI_MAGIC, ROI_VERSION, code, 0, top, left, top + height, left + width, len(xs)).ljust(ROI_HEAD, b"\0")
    body = np.array([x - left for x in xs] + [y - top for y in ys], ">i2").tobytes()
    return head + body + bytes(ROI_HEAD)


def decode_roi(data: bytes) -> dict:
    magic, _, code, _, top, left, bottom, right, n = struct.unpack(">4shBBhhhhH", data[:18])
    if magic != ROI_MAGIC:
        raise ValueError("not a region of interest")
    kind = {ROI_RECT: "rect", ROI_OVAL: "oval"}.get(code, "polygon")
    at = np.frombuffer(data, ">i2", 2 * n if kind == "polygon" else 0, ROI_HEAD).astype(float)
    return {"kind": kind, "xs": (at[:n] + left).tolist() if kind == "polygon" else [], "ys": (at[n:] + top).tolist() if kind == "polygon" else [], "left": float(left), "top": float(top), "width": float(right - left), "height": float(bottom - top)}


def roi_zip(spark: SparkSession, path: str) -> DataFrame:
    """(file, roi_id, name, kind, xs, ys, left, top, width, height) of archives of region files, ids from 1 in file order."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            for file, content in zip(part.path, part.content, strict=True):
                with zipfile.ZipFile(BytesIO(content)) as z:
                    names = [n for n in z.namelist() if n.lower().endswith(".roi")]
                    rows = [{"file": file, "roi_id": i, "name": n.rsplit("/", 1)[-1][:-4], **decode_roi(z.read(n))} for i, n in enumerate(names, 1)]
                if rows:
                    yield pd.DataFrame(rows)

    files = spark.read.format("binaryFile").load(path).select("path", "content")
    return files.mapInPandas(run, "file string, roi_id int, name string, kind string, xs array<double>, ys array<double>, left double, top double, width double, height double")
