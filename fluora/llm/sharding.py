"""Sharding by a two-pass external shuffle.

Pass one scatters records by a seeded hash of their id and text into buckets, as many as make one bucket fit in memory. Pass two
puts each bucket into canonical order, permutes it by Fisher-Yates (Spark's ``shuffle`` of an array) and hands it on.
Buckets in order form one random order of all records; shard k takes the k-th run of it, so a bucket goes to one or two
neighbouring shards without a further exchange, counts differ by one at most (law ``rows``) and slots have no gaps.

A retried task makes the same records in the same order, as buckets have their own partitions and are sorted first.

Edge cases: a null text counts no bytes and has the checksum of an empty one; a null id is a value like any other; rows
that are equal in id and text land in one bucket; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fluora.llm.common import checkpoint, fresh, small

#: Bytes of records that a bucket has on average.
BUCKET_BYTES = 4 << 20


def record_bytes(text: Column | str) -> Column:
    """The size of a record: its text's UTF-8 bytes plus 16."""
    return F.coalesce(F.octet_length(text), F.lit(0)).cast("long") + 16


def shuffled(docs: DataFrame, shards: int = 40, seed: int = 5, bucket_bytes: int = BUCKET_BYTES, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """All rows of ``docs`` with ``shard`` and ``slot``, in random order within and across shards.

    The rows are in the column ``record`` (a struct of the columns of ``docs``), so that no name clashes.
    """
    total = docs.agg(F.sum(record_bytes(text)).alias("bytes"), F.count("*").alias("n")).first()
    n, buckets = total["n"], max(1, -(-(total["bytes"] or 0) // bucket_bytes))
    key = F.xxhash64(F.lit(seed), F.col(doc_id), F.col(text))
    bucket = F.pmod(key, F.lit(buckets)).cast("int")
    counts = docs.groupBy(bucket.alias("bucket")).agg(F.count("*").alias("count"))
    starts = counts.select("bucket", (F.sum("count").over(Window.orderBy("bucket")) - F.col("count")).alias("start"))
    starts = small(checkpoint(starts), 1_000_000)  # 16 bytes a row
    item = fresh(docs.columns, "item")
    record = F.struct(*[docs[c] for c in docs.columns]).alias("record")
    scattered = docs.select(bucket.alias("bucket"), F.struct(key.alias("key"), F.col(doc_id).alias("id"), record).alias(item)).repartitionById(buckets, F.col("bucket"))
    listed = scattered.groupBy("bucket").agg(F.sort_array(F.collect_list(item)).alias("items")).sortWithinPartitions("bucket")
    dealt = listed.select("bucket", F.shuffle("items", F.lit(seed)).alias("items")).join(starts, "bucket")
    dealt = dealt.select("start", F.posexplode("items").alias("pos", "item")).select((F.col("start") + F.col("pos")).alias("at"), "item.record")
    least, more = divmod(n, shards)
    big = more * (least + 1)  # rows in the shards that have one more
    low = F.col("at") < big
    shard = F.when(low, F.expr(f"at div {least + 1}")).otherwise(F.expr(f"{more} + (at - {big}) div {max(least, 1)}"))
    slot = F.when(low, F.expr(f"at % {least + 1}")).otherwise(F.expr(f"(at - {big}) % {max(least, 1)}"))
    return dealt.select("record", shard.cast("int").alias("shard"), slot.cast("long").alias("slot"))


def write(docs: DataFrame, path: str, shards: int = 40, seed: int = 5, bucket_bytes: int = BUCKET_BYTES) -> None:
    """Writes the shards as Parquet folders ``shard=K``; files in a folder and rows in a file are in slot order."""
    out = shuffled(docs, shards, seed, bucket_bytes)
    out.write.partitionBy("shard").parquet(path)


def op5_sharding(spark, sf_dir: str) -> DataFrame:
    """Puts all documents into shards 0 to 39 under the law ``rows``; one row per document."""
    out = shuffled(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    text = F.col("record.text")
    return out.select(
        F.col("record.doc_id").alias("doc_id"),
        record_bytes(text).alias("size"),
        F.crc32(F.coalesce(text, F.lit("")).cast("binary")).alias("text_crc32"),
        F.lit("rows").alias("law"),
        "shard",
        "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )
