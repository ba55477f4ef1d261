"""Traces, frames and regions made of the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def event_traces(spark: SparkSession, sf_dir: str, by: str = "user_id") -> DataFrame:
    """(trace, frame, y): the values of events in time order, a trace for each user or type."""
    e = _table(spark, sf_dir, "events")
    frame = F.row_number().over(Window.partitionBy(by).orderBy("ts", "event_id")).cast("long") - 1
    return e.select(F.col(by).alias("trace"), frame.alias("frame"), F.col("value").alias("y"))


def vector_traces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(trace, frame, y): embeddings as traces over their dimensions."""
    e = _table(spark, sf_dir, "embeddings")
    rows = e.select(F.col("vec_id").alias("trace"), F.posexplode("embedding").alias("frame", "y"))
    return rows.select("trace", F.col("frame").cast("long").alias("frame"), F.col("y").cast("double").alias("y"))


def vector_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(frame, px): embeddings as frames of 8 by 8 pixels."""
    e = _table(spark, sf_dir, "embeddings")
    return e.select(F.col("vec_id").alias("frame"), F.col("embedding").cast("array<double>").alias("px"))


def block_masks(spark: SparkSession, first: int = 0, last: int = 7) -> DataFrame:
    """(roi_id, pixel): regions of 8 pixels each."""
    return spark.range(first * 8, last * 8 + 8).select((F.expr("id div 8") + 1).cast("int").alias("roi_id"), F.col("id").cast("int").alias("pixel"))
