"""Cases that several operators share: clashing columns, written shards, tables of other queries beside a pipeline."""

from collections import Counter

import pytest
from pyspark.sql import functions as F

from fluora.llm import chat, sharding, warc
from fluora.llm.quality import op8_quality

SF = "/root/testdata/sf0.001"


def test_lazy_queries_survive_a_pipeline(spark):
    """The pipeline deletes its own tables only."""
    import corpus_pipeline
    from fluora.plans.queries import queries

    lazy, core = op8_quality(spark, SF), queries()["spike_table"](spark, SF)
    n = corpus_pipeline.run(spark, SF).count()
    assert n > 0 and lazy.count() == spark.read.parquet(f"{SF}/documents.parquet").count() and core.count() > 0


def test_written_shards(spark, tmp_path):
    docs = spark.createDataFrame([(i % 90, f"text {i % 70}", "clash", i) for i in range(500)], "doc_id long, text string, SHARD string, slot int").repartition(4)
    sharding.write(docs, f"file://{tmp_path}/out", shards=7, seed=3, bucket_bytes=700)
    back = spark.read.parquet(f"file://{tmp_path}/out").select("shard", "slot", "record.*").toDF("at", "place", "doc_id", "text", "c", "i")
    rows = back.collect()
    assert Counter((r.doc_id, r.text, r.c, r.i) for r in rows) == Counter((r.doc_id, r.text, "clash", r[3]) for r in docs.collect())
    sizes = Counter(r["at"] for r in rows)
    assert set(sizes) == set(range(7)) and max(sizes.values()) - min(sizes.values()) <= 1
    assert all(sorted(r.place for r in rows if r["at"] == s) == list(range(n)) for s, n in sizes.items())
    files = back.withColumn("file", F.input_file_name()).withColumn("nth", F.monotonically_increasing_id()).groupBy("file").agg(F.array_sort(F.collect_list(F.struct("nth", "place"))).alias("s")).collect()
    assert all([x.place for x in r.s] == sorted(x.place for x in r.s) for r in files)  # rows in a file are in order


@pytest.mark.parametrize("names", [("PAYLOAD", "record_type"), ("Url_", "offset")])
def test_archives_of_tables_with_clashing_columns(spark, tmp_path, names):
    pages = spark.createDataFrame([(1, "u", "<p>", 5, "x"), (2, "v", "<p>", 6, "y"), (3, None, None, 7, None)], f"page_id long, url string, html string, {names[0]} int, {names[1]} string")
    out = {r.page_id: (r.record_type, r.payload_bytes, r.refers_to) for r in warc.read(warc.write(pages, f"file://{tmp_path}/a")).collect()}
    assert out == {1: ("revisit", 3, 2), 2: ("response", 3, None), 3: ("response", 0, None)}


def test_chat_of_tables_with_clashing_columns(spark):
    rows = spark.createDataFrame([(1, 0, "user", "a", 9, "k"), (1, 1, "assistant", "b", 9, None)], "conv_id long, turn long, role string, text string, SEQ int, Kind string")
    back = chat.read_back(chat.render(chat.fold(chat.events_of(rows)))).first()
    assert [(t.role, t.text) for t in back.turns] == [("user", "a"), ("assistant", "b")] and back.learned == "b"
