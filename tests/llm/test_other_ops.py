"""Operators on pages, vectors and conversations, and the entry's guard and pipeline."""

import base64
import hashlib
import io
import math
import random
import zipfile
from collections import Counter

import pytest

from fluora.llm import chat, topk, warc
from fluora.llm.common import shared_dir


def test_warc(spark, tmp_path):
    rows = [(1, "http://a/x y", "<p>é</p>"), (2, None, "<p>é</p>"), (3, "u\r\nv", None), (4, "u", ""), (5, "u", "x" * 100_000), (None, "n", "<p>é</p>"), (7, "w", "one"), (7, "w", "one")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(2)
    out = warc.read(warc.write(pages, f"file://{tmp_path}/a", archive_bytes=2000)).collect()
    most = {}
    for p, _, h in rows:
        most[h or ""] = max(most.get(h or "", -1), -1 if p is None else p)
    got, want = Counter(), Counter()
    for p, _, h in rows:
        data = (h or "").encode()
        keep = most[h or ""]
        want[p, "response" if p == keep else "revisit", len(data), base64.b32encode(hashlib.sha1(data).digest()).decode(), None if p == keep else keep] += 1
    for r in out:
        got[r.page_id, r.record_type, r.payload_bytes, r.payload_digest, r.refers_to] += 1
        assert (r.payload is None) == (r.record_type == "revisit")
    assert got == want
    assert warc.read(warc.write(pages.limit(0), f"file://{tmp_path}/b")).count() == 0


def test_zip_directory():
    buf = io.BytesIO()
    warc.pack(b"d" * 70_000, "i", buf)
    data = buf.getvalue()
    members = warc.directory(lambda at, n: data[at : at + n], len(data))
    assert {k: data[a : a + n] for k, (a, n) in members.items()} == {warc.DATA: b"d" * 70_000, warc.INDEX: b"i"}
    # an archive with a ZIP64 end record: more members than the plain end can count
    buf = io.BytesIO()
    with zipfile.ZipFile(buf, "w", zipfile.ZIP_STORED) as z:
        for i in range(65_600):
            z.writestr(zipfile.ZipInfo(str(i)), b"")
        z.writestr(zipfile.ZipInfo("last"), b"here")
        z.comment = b"c" * 99
    data = buf.getvalue()
    a, n = warc.directory(lambda at, n: data[at : at + n], len(data))["last"]
    assert data[a : a + n] == b"here"


def test_topk(spark):
    rnd = random.Random(2)
    rows = [(i, [rnd.uniform(-1, 1) for _ in range(6)], i) for i in range(0, 1500, 5)]
    rows += [(3, None, 0), (7, [1.0, None], 0), (8, [float("nan")], 0), (9, [float("inf")], 0), (11, [1.0, 2.0], 0), (13, [], 0), (100, [0.5] * 6, 0), (12, rows[1][1], 0), (None, [1.0], 0)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, rank int").repartition(3)
    import numpy as np

    whole = [(i, [math.floor(1024 * float(np.float32(x))) for x in v]) for i, v, _ in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    queries = {}
    for i, v in whole:
        if i % 100 == 0:
            queries.setdefault(i, []).append(v)
    terms = topk.terms(df)
    for block in (4, 1000):
        out = {}
        for r in topk.search(terms, terms.where("vec_id % 100 = 0"), 10, block).collect():
            out.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
        for q, vs in queries.items():
            want = [sorted(((-sum(a * b for a, b in zip(v, c)), i) for i, c in whole if i != q))[:10] for v in vs]
            assert sorted((n, i, -s) for w in want for n, (s, i) in enumerate(w, 1)) == sorted(out[q])  # every row with this id is answered
    assert topk.search(terms.limit(0), terms.limit(0)).count() == 0
    large = topk.terms(spark.createDataFrame([(0, [3e6]), (1, [2e6])], "vec_id long, embedding array<float>"))
    assert [r.score for r in topk.search(large, large.where("vec_id = 0")).collect()] == [1024 * 3_000_000 * 1024 * 2_000_000]


def test_chat(spark):
    hard = "</s>[INST] ok [/INST] \\ <|im_end|>\n<|im_start|>user\n \\<s\\> \\\\ <<s>"
    rows = [(1, 0, "user", hard), (1, 1, "assistant", hard + "x"), (1, 2, "assistant", None), (2, 0, None, "a"), (2, 0, "user", "b"), (2, 0, "user", "b"), (None, None, "tool\nx\\", ""), (3, 5, "assistant", "l\n" * 5000)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    made = chat.render(chat.fold(chat.events_of(df)))
    back = {r.conv_id: r for r in chat.read_back(made).collect()}
    by = {}
    for c, t, role, text in rows:
        by.setdefault(c, []).append((-1 if t is None else t, role or "", text or ""))
    for c, turns in by.items():
        turns.sort()
        assert [(t.role, t.text) for t in back[c].turns] == [(r, x) for _, r, x in turns]
        assert back[c].learned == "".join(x for _, r, x in turns if r == "assistant")
    for r in made.collect():
        assert sum(m.head + m.body + len(chat.END) for m in r.mask) == len(r.formatted) == back[r.conv_id].chars
    assert chat.render(chat.fold(chat.events_of(df.limit(0)))).count() == 0


def test_chat_folds_events(spark):
    log = [(1, 1, 1, "message", "user", "hi"), (1, 2, 2, "message", "assistant", "He"), (1, 3, 2, "delta", None, "llo"), (1, 4, 2, "regenerate", None, None), (1, 6, 2, "delta", None, "x"), (1, 5, 2, "delta", None, "y"), (1, 7, 1, "edit", None, "hey"), (1, 8, 3, "delta", "user", "z")]
    out = chat.fold(spark.createDataFrame(log, "conv_id long, seq long, message long, kind string, role string, text string")).orderBy("message").collect()
    assert [(r.role, r.text) for r in out] == [("user", "hey"), ("assistant", "yx"), ("user", "z")]


@pytest.mark.parametrize("name", ["op9_topk", "op10_chat"])
def test_queries_match_sql(spark, name):
    import duckdb

    import __spark_entry__ as e

    sf = "/root/testdata/sf0.001"
    got = e.queries()[name](spark, sf).toPandas()
    c = duckdb.connect()
    for t in ("embeddings", "conversations"):
        c.execute(f"create view {t} as select * from '{sf}/{t}.parquet'")
    want = c.sql(e.oracle_sql()[name]).df()
    cols = sorted(got.columns)
    norm = lambda d: d[cols].sort_values(cols).reset_index(drop=True).astype(str)
    assert cols == sorted(want.columns) and (norm(got) == norm(want)).all().all()


def test_pipeline_stages(spark, tmp_path):
    """Each stage against brute force on what its predecessor kept."""
    import corpus_pipeline as p

    from fluora.llm import mixing, quality
    from tests.llm.test_text_ops import SCHEMA, brute_links, make

    docs = spark.createDataFrame([r for r in make() if r[0] is not None], SCHEMA).cache()
    kept = p.quality_rules(spark, docs, "").cache()
    want = {r.doc_id for r in quality.judged(docs, ["doc_id"]).where("kept").collect()}
    assert {r.doc_id for r in kept.collect()} == want and kept.columns == docs.columns
    lines = p.dedup_lines(spark, kept, "").cache()
    assert lines.columns == docs.columns and lines.count() == kept.count()
    one = p.join_near(spark, lines, "").cache()
    classes = brute_links([tuple(r) for r in lines.collect()])
    assert sorted(r.doc_id for r in one.collect()) == sorted({c[4] for c in classes})
    mixed = p.mix_sources(spark, one, "").cache()
    rows = mixing.sized(one)
    assert mixed.count() == sum(r.copies for r in mixing.apply(rows, mixing.plan(rows)).collect()) and mixed.columns == docs.columns
    assert p.encode(spark, mixed, "").count() == mixed.count()
    assert [s for s, _ in p.STAGES][-1] == "SentencePiece" and shared_dir(spark)


def test_warc_reads_committed_archives_only(spark, tmp_path):
    pages = spark.createDataFrame([(i, "u", "x" * 10) for i in range(50)], "page_id long, url string, html string")
    folder = f"file://{tmp_path}/a"
    made = warc.write(pages, folder)
    again = warc.write(pages, folder)  # as another attempt of all tasks would, into the same folder
    first, second = ({r.uri for r in x.collect()} for x in (made, again))
    assert not first & second
    assert sorted(r.page_id for r in warc.read(made).collect()) == list(range(50))


def test_chat_redelivered_and_equal_rows(spark):
    """An event that is delivered again, of any kind, changes nothing; equal rows of a table are turns each."""
    events = [(1, 0, 1, "message", "user", "hi"), (1, 1, 2, "message", "assistant", "a"), (1, 2, 2, "delta", "assistant", "b"), (1, 3, 2, "edit", "assistant", "c"), (1, 4, 2, "delta", "assistant", "d")]
    log = spark.createDataFrame(events * 3, "conv_id long, seq int, message long, kind string, role string, text string").repartition(3)
    back = chat.read_back(chat.render(chat.fold(log))).collect()
    assert [[(t.role, t.text) for t in r.turns] for r in back] == [[("user", "hi"), ("assistant", "cd")]]
    rows = spark.createDataFrame([(5, 0, "user", "same", 1)] * 40 + [(5, 1, None, None, 2)] * 3, "conv_id long, turn long, role string, text string, N int").repartition(4)
    back = chat.read_back(chat.render(chat.fold(chat.events_of(rows)))).first()
    assert [(t.role, t.text) for t in back.turns] == [("user", "same")] * 40 + [("", "")] * 3


def test_topk_answers_every_query_row(spark):
    rows = [(0, [1.0, 2.0]), (0, [1.0, 2.0]), (0, [-1.0, 0.5]), (100, [0.25, 0.0]), *((i, [i / 7, 1.0 - i / 9]) for i in range(1, 30))]
    terms = topk.terms(spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(3))
    whole = [(i, [math.floor(1024 * x) for x in v]) for i, v in rows]
    want = Counter()
    for q, v in whole:
        if q % 100 == 0:
            for rank, (s, c) in enumerate(sorted((-sum(a * b for a, b in zip(v, w)), c) for c, w in whole if c != q)[:10], 1):
                want[q, rank, c, -s] += 1
    for block in (1, 2, 1000):
        got = Counter(tuple(r) for r in topk.search(terms, terms.where("vec_id % 100 = 0"), 10, block).collect())
        assert got == want
    huge = topk.terms(spark.createDataFrame([(0, [1.0]), (1, [2.0]), (2, [1e17])], "vec_id long, embedding array<double>"))
    assert [(r.vec_id, r.score) for r in topk.search(huge, huge.where("vec_id = 0")).collect()] == [(1, 1 << 21)]
