"""The corpus pipeline: documents from quality rules to token ids, one operator a stage.

Rows are kept or dropped by a stage's decision only. Rows that share a doc_id, or have none, are told apart by their
texts; only rows of one id and one text count as one document where a stage keeps one of a group. Documents that mixing takes twice come out as two rows.

A stage reads what its predecessor has written, so the tables that its predecessors worked with are deleted first. Tables of
other queries of the application stay.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fluora.llm import line_dedup, mixing, ngram_join, quality, sentencepiece_bpe
from fluora.llm.common import cut, drop, fresh, noted, shared_dir, small

#: Kept documents (16 bytes each) that are broadcast at most.
KEPT = 2_000_000
#: Tables that the stages run so far have worked with.
_worked: list[str] = []

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def _stage(work: Stage) -> Stage:
    """Deletes the tables of earlier stages, then runs this one and notes its tables."""

    @wraps(work)
    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        drop(spark, _worked)
        with noted(_worked):
            return work(spark, docs, sf_dir)

    return run


@_stage
def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep."""
    return quality.filtered(docs)


@_stage
def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents without lines that an earlier line matches; n_chars follows the text."""
    out = line_dedup.deduplicated(docs)
    new = {"text": F.col("text"), "n_chars": F.when(F.size("removed") > 0, F.length("text")).otherwise(F.col("record.n_chars")).cast("long")}
    return out.select(*[new.get(c, F.col("record")[c]).alias(c) for c in docs.columns])


@_stage
def join_near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group: the smallest id of a class, then the smallest hash of a text; of equal texts with that id, one."""
    classes = ngram_join.classed(docs).where(F.col("doc_id").eqNullSafe(F.col("class_id")) & (F.col("tid") == F.col("class_tid")))
    kept = cut(classes.groupBy("doc_id", "tid").agg(F.count("*").alias("n")))
    ident, tid = fresh(docs.columns, "kept_id"), fresh(docs.columns, "kept_tid")
    same = docs["doc_id"].eqNullSafe(F.col(ident)) & (F.xxhash64(F.coalesce(docs["text"], F.lit(""))) == F.col(tid))
    one = docs.join(small(kept.select(F.col("doc_id").alias(ident), F.col("tid").alias(tid)), KEPT), same, "left_semi")
    if kept.where("n > 1").isEmpty():
        return one
    return one.withColumn(tid, F.xxhash64(F.coalesce("text", F.lit("")))).dropDuplicates(["doc_id", tid]).drop(tid)


@_stage
def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them."""
    return mixing.mix(docs)


@_stage
def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every text with their count and digests; decoding gives the text back."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", sentencepiece_bpe.BATCH)
    return sentencepiece_bpe.digests(docs)


STAGES = [("quality rules", quality_rules), ("line dedup", dedup_lines), ("n-gram Jaccard join", join_near), ("mixing", mix_sources), ("SentencePiece", encode)]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies all stages to documents; each is written to the shared folder and read again by the next."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES:
        path = f"{shared_dir(spark)}/pipeline-{uuid.uuid4().hex}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    drop(spark, _worked)
    return docs
