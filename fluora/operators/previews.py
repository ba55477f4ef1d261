"""Previews: what a filter or a detection makes of traces that are cut down to some hundred points.

All take traces (trace, frame, y) and give (trace, series, place, value); places count the points. Traces without any
sample have no series.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fluora.operators import filters, spikes, traces as series

POINTS = 800


def points(rows: DataFrame, most: int = POINTS) -> DataFrame:
    """(trace, frame, y): evenly spread samples without gaps, their frames counted from 0."""
    place = F.row_number().over(Window.partitionBy("trace").orderBy("frame")).cast("long") - 1
    cut_down = series.decimated(series.cleaned(rows), most).select("trace", place.alias("frame"), "y")
    return series.gap_filled(cut_down).where("filled is not null").select("trace", "frame", F.col("filled").alias("y"))


def _long(rows: DataFrame, names: list[str]) -> DataFrame:
    pairs = F.array(*[F.struct(F.lit(n).alias("series"), F.col(n).cast("double").alias("value")) for n in names])
    return rows.select("trace", F.col("frame").alias("place"), F.explode(pairs).alias("s")).select("trace", "s.series", "place", "s.value")


def als(rows: DataFrame, most: int = POINTS, **options) -> DataFrame:
    """Series baseline, corrected and smoothed of traces of three points or more."""
    some = points(rows, most)
    long = some.groupBy("trace").agg(F.count("*").alias("n")).where("n >= 3")
    return _long(filters.als_filtered(some.join(long.select("trace"), "trace", "left_semi"), **options), ["baseline", "corrected", "smoothed"])


def band_pass(rows: DataFrame, most: int = POINTS, **options) -> DataFrame:
    """Series filtered."""
    return _long(filters.band_pass(points(rows, most), **options), ["filtered"])


def active(rows: DataFrame, k: float = 2.5, duration: int = 3, most: int = POINTS) -> DataFrame:
    """Series active or inactive, with the trace itself, and threshold."""
    some = points(rows, most)
    limits = series.robust(some, k)
    kind = series.longest_runs(some, limits).join(limits.select("trace", "threshold"), "trace")
    out = some.join(kind, "trace")
    line = _long(out, ["threshold"])
    name = F.when(F.col("longest") >= duration, "active").otherwise("inactive")
    return line.unionByName(out.select("trace", name.alias("series"), F.col("frame").alias("place"), F.col("y").alias("value")))


def spiking(rows: DataFrame, k: float = 3.0, fraction: float = 0.5, duration: int = 3, most: int = POINTS) -> DataFrame:
    """Series threshold, half_level and detected: between the frames a spike is measured at its level and the trace, else the baseline.

    Where two spikes meet, the later one counts. Traces without spread have no series.
    """
    some = points(rows, most)
    limits = series.robust(some, k).where("sigma > 0")
    found = spikes.measured(some.withColumn("t", F.col("frame").cast("double")), k, fraction, duration)
    own = found.select("trace", F.explode(F.sequence("lo", "hi")).alias("frame"), F.col("spike_index").alias("spike"), "level")
    own = own.groupBy("trace", "frame").agg(F.max(F.struct("spike", "level")).alias("s")).select("trace", "frame", F.col("s.level").alias("level"))
    out = some.join(limits, "trace").join(own, ["trace", "frame"], "left")
    out = out.withColumn("half_level", F.coalesce("level", "baseline")).withColumn("detected", F.when(F.col("level").isNotNull(), F.col("y")).otherwise(F.col("baseline")))
    return _long(out, ["threshold", "half_level", "detected"])


def series_names(rows: DataFrame) -> list[str]:
    """The series of a preview (trace, series, ...) in order of the first trace that has each, the original first."""
    first = rows.groupBy("series").agg(F.min("trace").alias("trace")).orderBy("trace", "series")
    return ["Original", *[r.series for r in first.collect()]]
