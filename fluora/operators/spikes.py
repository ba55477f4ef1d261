"""Spikes of traces (trace, frame, t, y): apexes, search bounds and half-peak measurement, all by windows and keys.

Frames are numbered without gaps and y has no missing values (fill gaps first). Every step is keyed by trace and frame,
so spikes of a trace are never compared with each other.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fluora.functions.shared import checkpoint, cut
from fluora.operators.graph import map_to_rois
from fluora.operators.imaging import centroids
from fluora.operators.traces import robust


def apexes(traces: DataFrame, k: float = 3.0, duration: int = 3) -> DataFrame:
    """(trace, spike, frame, y, baseline): the first maximum of every run above the threshold of ``duration`` frames."""
    limits = robust(traces, k).where("sigma > 0")
    rows = traces.join(limits, "trace").where("y > threshold")
    island = F.col("frame") - F.row_number().over(Window.partitionBy("trace").orderBy("frame"))
    runs = rows.withColumn("island", island).groupBy("trace", "island", "baseline").agg(F.count("*").alias("n"), F.min(F.struct((-F.col("y")).alias("low"), "frame")).alias("m"))
    tops = runs.where(F.col("n") >= duration).select("trace", "baseline", F.col("m.frame").alias("frame"), (-F.col("m.low")).alias("y"))
    return tops.select("trace", F.row_number().over(Window.partitionBy("trace").orderBy("frame")).alias("spike"), "frame", "y", "baseline")


def bounds(traces: DataFrame, tops: DataFrame) -> DataFrame:
    """tops with (low, high): the first minima between neighbouring apexes, or the ends of the trace."""
    order = Window.partitionBy("trace").orderBy("frame")
    marked = traces.select("trace", "frame", "y").join(tops.select("trace", "frame", "spike"), ["trace", "frame"], "left")
    # gap g lies after apex g; gap 0 before the first
    gaps = marked.withColumn("gap", F.coalesce(F.last("spike", True).over(order), F.lit(0)))
    gaps = gaps.groupBy("trace", "gap").agg(F.min(F.struct("y", "frame")).alias("m"), F.min("frame").alias("first"), F.max("frame").alias("last"))
    top = tops.withColumn("spikes", F.count("*").over(Window.partitionBy("trace")))
    ends = gaps.groupBy("trace").agg(F.min("first").alias("first"), F.max("last").alias("last"))
    before = gaps.select("trace", (F.col("gap") + 1).alias("spike"), F.col("m.frame").alias("before"))
    after = gaps.select("trace", F.col("gap").alias("spike"), F.col("m.frame").alias("after"))
    out = top.join(ends, "trace").join(before, ["trace", "spike"], "left").join(after, ["trace", "spike"], "left")
    low = F.when(F.col("spike") == 1, F.col("first")).otherwise(F.col("before"))
    high = F.when(F.col("spike") == F.col("spikes"), F.col("last")).otherwise(F.col("after"))
    return out.select("trace", "spike", "frame", "y", "baseline", low.alias("low"), high.alias("high"))


def _cross(t: Column, y: Column, t2: Column, y2: Column, level: Column) -> Column:
    share = F.least(F.greatest((level - y) / (y2 - y), F.lit(0.0)), F.lit(1.0))
    return F.when(y2 == y, t2).otherwise(t + share * (t2 - t))


def spikes(traces: DataFrame, k: float = 3.0, fraction: float = 0.5, duration: int = 3) -> DataFrame:
    """One row per spike: times, width, height, area and whether it is cut by its bounds."""
    return measured(traces, k, fraction, duration).drop("level", "lo", "hi")


def located(found: DataFrame, labels: DataFrame, rois: DataFrame) -> DataFrame:
    """Spikes with (signal, x, y): the trace's name and the centre of its region, null where it has none.

    labels has (ord, label), a row for each trace in order; rois (roi_id, xs, ys, left, top, width, height).
    """
    at = map_to_rois(labels, rois.select("roi_id"), leading=False).join(centroids(rois), "roi_id", "left")
    at = at.select(F.col("label").alias("trace"), "x", "y")
    return found.join(at, "trace", "left").withColumn("signal", F.col("trace"))


def summary(found: DataFrame, labels: DataFrame) -> DataFrame:
    """(signals, spikes, empty, unmapped, truncated): counts of a run, from located spikes; unmapped signals among those with spikes."""
    per = found.groupBy("trace").agg(F.count("*").alias("n"), F.bool_and(F.col("x").isNull()).alias("lost"), F.count_if("truncated").alias("cut"))
    rows = labels.select(F.col("label").alias("trace")).join(per, "trace", "left")
    return rows.agg(F.count("*").alias("signals"), F.coalesce(F.sum("n"), F.lit(0)).alias("spikes"), F.count_if(F.col("n").isNull()).alias("empty"), F.count_if("lost").alias("unmapped"), F.coalesce(F.sum("cut"), F.lit(0)).alias("truncated"))


def measured(traces: DataFrame, k: float = 3.0, fraction: float = 0.5, duration: int = 3) -> DataFrame:
    """``spikes`` with the level at which a spike is measured and the frames (lo, hi) it is measured between."""
    traces = cut(traces.select("trace", "frame", "t", "y"))
    tops = checkpoint(bounds(traces, checkpoint(apexes(traces, k, duration)))).withColumnRenamed("frame", "apex").withColumnRenamed("y", "top")
    order = Window.partitionBy("trace").orderBy("frame")
    near = traces.select("trace", "frame", "t", "y", *[f(c).over(order).alias(n) for c in ("t", "y") for f, n in ((F.lag, f"{c}_before"), (F.lead, f"{c}_after"))])
    # a spike's frames: from its lower bound on, by filling forward; an upper bound that the next spike begins with belongs to both
    starts = tops.select("trace", F.col("low").alias("frame"), F.col("spike").alias("start"))
    own = near.join(starts, ["trace", "frame"], "left").withColumn("spike", F.last("start", True).over(order)).drop("start")
    both = tops.withColumn("next", F.lead("spike").over(Window.partitionBy("trace").orderBy("spike"))).where("next is not null")
    shared = near.join(both.select("trace", F.col("high").alias("frame"), "spike"), ["trace", "frame"]).select(own.columns)
    rows = own.unionByName(shared).where("spike is not null").join(tops, ["trace", "spike"]).where("frame between low and high")
    level = F.col("baseline") + fraction * (F.col("top") - F.col("baseline"))
    rows = rows.withColumn("level", level)
    here = F.struct("frame", "t", "y", "t_after", "y_after", "t_before", "y_before")
    under = F.col("y") <= F.col("level")
    flanks = rows.groupBy("trace", "spike", "apex", "top", "baseline", "level", "low", "high").agg(
        F.max(F.when(under & (F.col("frame") < F.col("apex")), here)).alias("j"),
        F.min(F.when(under & (F.col("frame") > F.col("apex")), here)).alias("k"),
        F.max(F.when(F.col("frame") == F.col("low"), here)).alias("a"),
        F.max(F.when(F.col("frame") == F.col("high"), here)).alias("b"),
        F.max(F.when(F.col("frame") == F.col("apex"), F.col("t"))).alias("spike_time_s"),
    )
    left, right = F.col("j").isNotNull(), F.col("k").isNotNull()
    flanks = flanks.select(
        "trace", "spike", "baseline", "level", "spike_time_s", (F.col("top") - F.col("baseline")).alias("max_height"), (~left | ~right).alias("truncated"),
        F.when(left, _cross(F.col("j.t"), F.col("j.y"), F.col("j.t_after"), F.col("j.y_after"), F.col("level"))).otherwise(F.col("a.t")).alias("start_s"),
        F.when(left, F.col("level")).otherwise(F.col("a.y")).alias("start_y"),
        F.when(left, F.col("j.frame")).otherwise(F.col("a.frame")).alias("after"),
        F.when(right, _cross(F.col("k.t_before"), F.col("k.y_before"), F.col("k.t"), F.col("k.y"), F.col("level"))).otherwise(F.col("b.t")).alias("end_s"),
        F.when(right, F.col("level")).otherwise(F.col("b.y")).alias("end_y"),
        F.when(right, F.col("k.frame")).otherwise(F.col("b.frame")).alias("before"),
    )
    flanks = checkpoint(flanks)
    # the area: pieces between samples inside, and one piece at each end
    inner = rows.select("trace", "spike", "frame", "t", "y", "t_after", "y_after").join(flanks.select("trace", "spike", "baseline", "after", "before"), ["trace", "spike"]).where("frame > after and frame < before")
    piece = (F.col("t_after") - F.col("t")) * ((F.col("y") + F.col("y_after")) / 2 - F.col("baseline"))
    area = inner.groupBy("trace", "spike").agg(F.sum(F.when(F.col("frame") + 1 < F.col("before"), piece)).alias("body"), F.min(F.struct("frame", "t", "y")).alias("p"), F.max(F.struct("frame", "t", "y")).alias("q"))
    out = flanks.join(area, ["trace", "spike"], "left")
    slab = lambda t1, y1, t2, y2: (t2 - t1) * ((y1 + y2) / 2 - F.col("baseline"))
    whole = slab(F.col("start_s"), F.col("start_y"), F.col("end_s"), F.col("end_y"))
    parts = slab(F.col("start_s"), F.col("start_y"), F.col("p.t"), F.col("p.y")) + F.coalesce("body", F.lit(0.0)) + slab(F.col("q.t"), F.col("q.y"), F.col("end_s"), F.col("end_y"))
    return out.select("trace", F.col("spike").alias("spike_index"), "start_s", "end_s", (F.col("end_s") - F.col("start_s")).alias("width_s"), "spike_time_s", "max_height", F.when(F.col("p").isNull(), whole).otherwise(parts).alias("auc"), "truncated", "level", F.col("after").alias("lo"), F.col("before").alias("hi"))
