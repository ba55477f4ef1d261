"""Operators on traces in long form: (trace, frame, y), y null where a sample is missing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Frames in a block. Runs are found within blocks and then joined, so that a long trace is not one task's work.
BLOCK = 1 << 16


def cleaned(traces: DataFrame) -> DataFrame:
    """NaN as null, the one form of a missing value."""
    return traces.withColumn("y", F.nanvl(F.col("y"), F.lit(None).cast("double")))


def robust(traces: DataFrame, k: float) -> DataFrame:
    """(trace, baseline, sigma, threshold): median, 1.4826 times the median absolute deviation, baseline + k sigma.

    Where the deviation is zero, sigma is the population standard deviation. Two aggregations; exact medians keep the
    distinct values of a trace in a task.
    """
    base = traces.groupBy("trace").agg(F.median("y").alias("baseline"), F.stddev_pop("y").alias("sd"))
    dev = traces.join(base, "trace").groupBy("trace", "baseline", "sd").agg(F.median(F.abs(F.col("y") - F.col("baseline"))).alias("mad"))
    sigma = F.when(1.4826 * F.col("mad") > 0, 1.4826 * F.col("mad")).otherwise(F.col("sd"))
    return dev.select("trace", "baseline", sigma.alias("sigma"), (F.col("baseline") + k * sigma).alias("threshold"))


def longest_runs(traces: DataFrame, thresholds: DataFrame) -> DataFrame:
    """(trace, longest): the longest run of consecutive frames above the threshold; a missing sample ends a run.

    Frames are numbered without gaps. Blocks give their length, first, last and best run; the blocks of a trace are then
    folded in order.
    """
    rows = traces.join(thresholds.select("trace", "threshold"), "trace")
    rows = rows.select("trace", "frame", F.expr(f"frame div {BLOCK}").alias("block"), F.coalesce(F.col("y") > F.col("threshold"), F.lit(False)).alias("above"))
    island = F.col("frame") - F.row_number().over(Window.partitionBy("trace", "block", "above").orderBy("frame"))
    runs = rows.withColumn("island", island).groupBy("trace", "block", "above", "island").agg(F.count("*").alias("n"), F.min("frame").alias("a"), F.max("frame").alias("b"))
    above = F.col("above")
    edge = runs.groupBy("trace", "block").agg(
        F.sum("n").alias("n"),
        F.max(F.when(above, F.col("n")).otherwise(0)).alias("best"),
        F.min_by(F.when(above, F.col("n")).otherwise(0), "a").alias("head"),
        F.max_by(F.when(above, F.col("n")).otherwise(0), "b").alias("tail"),
    )
    parts = edge.groupBy("trace").agg(F.sort_array(F.collect_list(F.struct("block", "n", "best", "head", "tail"))).alias("parts"))
    zero = F.lit(0).cast("long")

    def joined(acc: Column, p: Column) -> Column:
        whole = acc["tail"] + p["head"]
        return F.struct(F.greatest(acc["best"], p["best"], whole).alias("best"), F.when(p["head"] == p["n"], whole).otherwise(p["tail"]).alias("tail"))

    folded = F.aggregate("parts", F.struct(zero.alias("best"), zero.alias("tail")), joined, lambda acc: acc["best"])
    return parts.select("trace", folded.alias("longest"))


def active(traces: DataFrame, k: float = 2.5, duration: int = 3) -> DataFrame:
    """(trace, threshold, longest) of traces that stay above their threshold for ``duration`` frames."""
    limits = robust(traces, k)
    return longest_runs(traces, limits).where(F.col("longest") >= duration).join(limits.select("trace", "threshold"), "trace")


def gap_filled(traces: DataFrame) -> DataFrame:
    """Adds ``filled``: linear between the neighbours of a gap by frame, flat at the ends, null if all are missing.

    Neighbours are looked for within blocks of frames; where a block has none, its neighbours' first and last samples count,
    carried over the blocks of a trace.
    """
    point = F.when(F.col("y").isNotNull(), F.struct("frame", "y"))
    rows = traces.withColumn("_block", F.expr(f"frame div {BLOCK}")).withColumn("_p", point)
    edges = rows.groupBy("trace", "_block").agg(F.min("_p").alias("_first"), F.max("_p").alias("_last"))
    blocks = Window.partitionBy("trace").orderBy("_block")  # a row a block
    carried = edges.select("trace", "_block", F.last("_last", True).over(blocks.rowsBetween(Window.unboundedPreceding, -1)).alias("_before"), F.first("_first", True).over(blocks.rowsBetween(1, Window.unboundedFollowing)).alias("_after"))
    order = Window.partitionBy("trace", "_block").orderBy("frame")
    before = F.last("_p", True).over(order.rowsBetween(Window.unboundedPreceding, 0))
    after = F.first("_p", True).over(order.rowsBetween(0, Window.unboundedFollowing))
    rows = rows.join(carried, ["trace", "_block"]).withColumn("_a", F.coalesce(before, "_before")).withColumn("_b", F.coalesce(after, "_after"))
    slope = (F.col("_b.y") - F.col("_a.y")) / (F.col("_b.frame") - F.col("_a.frame"))
    value = F.when(F.col("y").isNotNull(), F.col("y")).when(F.col("_a").isNull(), F.col("_b.y")).when(F.col("_b").isNull(), F.col("_a.y"))
    rows = rows.withColumn("filled", value.otherwise(F.col("_a.y") + (F.col("frame") - F.col("_a.frame")) * slope))
    return rows.select(*traces.columns, "filled")


def zscored(traces: DataFrame) -> DataFrame:
    """Adds ``z``: centred and divided by the sample standard deviation; unchanged where that isn't positive."""
    stats = traces.groupBy("trace").agg(F.avg("y").alias("_m"), F.stddev_samp("y").alias("_s"))
    return traces.join(stats, "trace").withColumn("z", F.when(F.col("_s") > 0, (F.col("y") - F.col("_m")) / F.col("_s")).otherwise(F.col("y"))).drop("_m", "_s")


def decimated(traces: DataFrame, points: int = 800) -> DataFrame:
    """At most ``points`` frames of each trace, evenly spread: the frames floor(i * (n - 1) / (points - 1))."""
    n = traces.groupBy("trace").agg(F.count("*").alias("n"))
    rows = traces.join(n, "trace")
    # the first i whose place isn't before the frame, and whether its place is the frame
    first = F.expr(f"(frame * {points - 1} + n - 2) div greatest(n - 1, 1)")
    place = F.expr(f"(first * (n - 1)) div {points - 1}")
    rows = rows.withColumn("first", first)
    kept = (F.col("n") <= points) | (place == F.col("frame"))
    return rows.where(kept).drop("n", "first")


def complete_frames(traces: DataFrame) -> DataFrame:
    """The rows of frames that no trace misses."""
    missing = traces.where("y is null").select("frame").distinct()
    return traces.join(missing, "frame", "left_anti")


def shared_frames(traces: DataFrame, least: int = 2) -> DataFrame:
    """The rows of frames in which every trace has a sample; traces may begin and end anywhere. Too few such frames are an error."""
    n = traces.select("trace").distinct().count()
    counts = traces.groupBy("frame").agg(F.count("y").alias("n"))
    seen = counts.agg(F.min("n").alias("least"), F.count_if(F.col("n") == n).alias("full")).first()
    if seen["full"] < least:
        raise ValueError(f"not enough complete rows: {seen['full']}, of {least} at least")
    return traces if seen["least"] == n else traces.join(counts.where(F.col("n") == n).select("frame"), "frame", "left_semi")


def first_traces(header: DataFrame, n: int) -> DataFrame:
    """The first n columns in file order; header has (col_ord, name)."""
    return header.where(F.col("col_ord") < n)


def sliding_median(traces: DataFrame, window: int) -> DataFrame:
    """Adds ``median``: of the frames within window // 2 on either side."""
    half = window // 2
    order = Window.partitionBy("trace").orderBy("frame").rowsBetween(-half, half)
    return traces.withColumn("median", F.percentile("y", 0.5).over(order))


def timed(traces: DataFrame, times: DataFrame | None, fps: float) -> DataFrame:
    """Adds ``t``: the recording's own time of a frame (frame, t), where there is any, else frame / fps."""
    if times is None or times.isEmpty():
        return traces.withColumn("t", F.col("frame") / F.lit(float(fps)))
    return traces.join(times.select("frame", "t"), "frame", "left")


def run_summary(traces: DataFrame) -> DataFrame:
    """(traces, all_missing, some_missing): how many traces there are, lack every sample, or lack some."""
    rows = cleaned(traces).groupBy("trace").agg(F.count("y").alias("n"), F.count("*").alias("all"))
    return rows.agg(F.count("*").alias("traces"), F.count_if(F.col("n") == 0).alias("all_missing"), F.count_if((F.col("n") > 0) & (F.col("n") < F.col("all"))).alias("some_missing"))
