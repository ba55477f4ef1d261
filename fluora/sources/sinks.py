"""Writers of traces, matrices and graphs as text."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def wide(traces: DataFrame, names: list[str]) -> DataFrame:
    """(frame, line): a CSV line for every frame with the traces (name, frame, y) in the given order, nulls empty.

    A line is collected as an array, so thousands of columns need no pivot.
    """
    order = F.array(*[F.lit(n) for n in names])
    rows = traces.groupBy("frame").agg(F.map_from_entries(F.collect_list(F.struct("name", F.coalesce(F.col("y").cast("string"), F.lit(""))))).alias("m"))
    return rows.select("frame", F.array_join(F.transform(order, lambda n: F.coalesce(F.try_element_at("m", n), F.lit(""))), ",").alias("line"))


def write_traces(traces: DataFrame, names: list[str], path: str) -> None:
    """Text files whose lines, in order of the files, are the header and all frames."""
    spark = traces.sparkSession
    head = spark.range(1).select(F.lit(-1).cast("long").alias("frame"), F.lit(",".join(["frame", *names])).alias("line"))
    rows = wide(traces, names).select("frame", F.concat_ws(",", "frame", "line").alias("line"))
    head.unionByName(rows).repartitionByRange("frame").sortWithinPartitions("frame").select("line").write.text(path)


def write_table(cells: DataFrame, traces: DataFrame, path: str, dropped: DataFrame | None = None) -> None:
    """The table that cells (col_ord, name, frame, cell) came from, with the samples of traces (trace, frame, y) in place of theirs.

    All other columns stay as they were; those of ``dropped`` (trace) go. Text files whose lines follow each other in the
    order of the files, the header first. A line's cells meet in one row, as a line is one value of the file.
    """
    if dropped is not None:
        cells = cells.join(dropped.select(F.col("trace").alias("name")), "name", "left_anti")
    new = traces.select(F.col("trace").alias("name"), "frame", F.coalesce(F.col("y").cast("string"), F.lit("")).alias("new"))
    rows = cells.join(new, ["name", "frame"], "left").select("frame", "col_ord", F.coalesce("new", "cell").alias("cell"))
    head = cells.select(F.lit(-1).cast("long").alias("frame"), "col_ord", F.col("name").alias("cell")).distinct()
    quoted = F.concat(F.lit('"'), F.replace("cell", F.lit('"'), F.lit('""')), F.lit('"'))
    rows = head.unionByName(rows).withColumn("cell", F.when(F.col("cell").rlike('[,"\\n\\r]'), quoted).otherwise(F.col("cell")))
    lines = rows.groupBy("frame").agg(F.sort_array(F.collect_list(F.struct("col_ord", "cell"))).alias("s"))
    lines = lines.select("frame", F.array_join("s.cell", ",").alias("line"))
    lines.repartitionByRange("frame").sortWithinPartitions("frame").select("line").write.text(path)


def matrix_lines(matrix: DataFrame) -> DataFrame:
    """(i, line): a row of the matrix (i, j, value) with its label and numbers of six decimals."""
    rows = matrix.groupBy("i").agg(F.sort_array(F.collect_list(F.struct("j", "value"))).alias("s"))
    return rows.select("i", F.concat_ws(",", F.col("i").cast("string"), F.transform("s", lambda c: F.format_string("%.6f", c["value"]))).alias("line"))


def write_matrix(matrix: DataFrame, path: str, labels: DataFrame | None = None) -> None:
    """Writes a whole matrix (i, j, value) with a header line of its labels, in the order of ``labels`` (ord, label), else sorted.

    Text files whose lines follow each other in the order of the files. A line holds one row of the matrix.
    """
    if labels is None:
        names = matrix.select(F.col("i").cast("string").alias("label"), F.col("i").alias("ord")).distinct()
    else:
        names = labels.select(F.col("label").cast("string").alias("label"), "ord")
    name = lambda c: F.col(c).cast("string")
    rows = matrix.select(name("i").alias("i"), name("j").alias("j"), "value").join(names.select(F.col("label").alias("i"), F.col("ord").alias("row")), "i").join(names.select(F.col("label").alias("j"), F.col("ord").alias("at")), "j")
    quoted = lambda c: F.when(c.rlike('[,"\\n\\r]'), F.concat(F.lit('"'), F.replace(c, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(c)
    body = rows.groupBy("i", "row").agg(F.sort_array(F.collect_list(F.struct("at", "value"))).alias("s"))
    body = body.select(F.lit(1).alias("kind"), F.col("row"), F.concat_ws(",", quoted(F.col("i")), F.transform("s", lambda c: F.format_string("%.6f", c["value"]))).alias("line"))
    top = names.agg(F.sort_array(F.collect_list(F.struct("ord", "label"))).alias("s"), F.min("ord").alias("row"))
    top = top.select(F.lit(0).alias("kind"), "row", F.concat(F.lit(","), F.array_join(F.transform("s.label", quoted), ",")).alias("line"))
    top.unionByName(body).repartitionByRange("kind", "row").sortWithinPartitions("kind", "row").select("line").write.text(path)


def metric_file_name(stem: str, metric: str, suffix: str) -> str:
    return f"{stem}_{re.sub(r'[^0-9A-Za-z]', '', metric)}{suffix}"


#: The columns of a spike file, in order.
SPIKE_COLUMNS = ("signal", "spike_index", "start_s", "end_s", "width_s", "spike_time_s", "max_height", "auc", "x", "y", "truncated")


def spike_table(spikes: DataFrame) -> DataFrame:
    """Spikes in the columns of a spike file: the trace is the signal, and without regions there are no places."""
    rows = spikes if "signal" in spikes.columns else spikes.withColumn("signal", F.col("trace").cast("string"))
    for c in ("x", "y"):
        rows = rows if c in rows.columns else rows.withColumn(c, F.lit(None).cast("double"))
    return rows.select(*SPIKE_COLUMNS).orderBy("signal", "spike_index")


def spike_lines(spikes: DataFrame) -> DataFrame:
    """Spikes with numbers of six decimals as text, empty for missing ones."""
    text = lambda c: F.when(F.col(c).isNull() | F.isnan(c), F.lit("")).otherwise(F.format_string("%.6f", F.col(c)))
    return spikes.select(*[text(c).alias(c) if t == "double" else F.col(c) for c, t in spikes.dtypes])


def network(nodes: DataFrame, edges: DataFrame, threshold: float) -> tuple[DataFrame, DataFrame]:
    """Edge rows (source, target, weight) at or above the threshold and node rows with their degree, as text."""
    from fluora.operators.graph import above, degrees

    lines = above(edges, threshold).select("source", "target", F.format_string("%.6f", "weight").alias("weight"))
    deg = degrees(edges, nodes, threshold)
    return lines, nodes.join(deg, "id").select("id", "label", F.format_string("%.6f", "x").alias("x"), F.format_string("%.6f", "y").alias("y"), "degree")
