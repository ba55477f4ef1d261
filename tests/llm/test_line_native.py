"""Line dedup in DataFrame functions only."""

import random

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from fluora.llm import line_dedup
from fluora.llm.line_shingles import Lines


@pytest.fixture
def native(spark, monkeypatch):
    """A session whose tables refuse Python on the executors."""

    def refuse(*_, **__):
        raise AssertionError("Python on the executors")

    for name in ("mapInArrow", "mapInPandas"):
        monkeypatch.setattr(type(spark.range(1)), name, refuse)
    return spark


def test_lines_go_without_python(native):
    line = " ".join(f"w{i}" for i in range(60))
    near = line.replace("w30 ", "other ")
    rows = [(1, f"{line}\nfew words"), (2, f"one\n{near}"), (3, None), (4, ""), (5, f" few \twords\r\n\n{line}  \n")]
    out = line_dedup.deduplicated(native.createDataFrame(rows, "doc_id long, text string"))
    assert {r.record.doc_id: (list(r.removed), r.text) for r in out.collect()} == {1: ([], rows[0][1]), 2: ([1], "one"), 3: ([], None), 4: ([], ""), 5: ([0, 2], "\n")}


def test_sets_are_those_of_the_plain_form(native):
    """Sizes, equal sets and prefixes of all lines; 256 bits that only a line's shingles set."""
    rng = random.Random(3)
    words = ["a", "bb", "ccc", "größe", "x" * 300, "\x00", "漢字"]
    texts = ["", "\n", " \t\n\x0b", "a", *["".join(rng.choice(words) + rng.choice(["  ", " ", "\t", "\n", "\r\n", " "]) for _ in range(rng.randrange(60))) for _ in range(100)]]
    plain = Lines([t.encode() for t in texts])
    keys, starts = plain.sets()
    want = {(i, k): frozenset(keys[a:b].tolist()) for i, k, a, b in zip(plain.text.tolist(), plain.number.tolist(), starts, starts[1:], strict=False)}
    docs = native.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {(r.doc_id, r.line_no): r for r in line_dedup.prefixes(docs).collect()}
    assert got.keys() == want.keys()
    assert len({(want[k], r.set_id) for k, r in got.items()}) == len(set(want.values())) == len({r.set_id for r in got.values()})
    for k, r in got.items():
        n = len(want[k])
        assert r.n == n and len(set(r.prefix)) == n - -(-4 * n // 5) + 1 and list(r.prefix) == sorted(r.prefix)
    sets = docs.select(F.col("doc_id").alias("line"), F.array_distinct(line_dedup.shingles(F.col("text"))).alias("tokens")).where("tokens is not null")
    bits = {r.line: [r[b] for b in line_dedup.SKETCH] for r in line_dedup.bitmaps(sets).collect()}
    for r in sets.collect():
        assert [sum({1 << (t >> 16 & 63) for t in r.tokens if t >> 22 & 3 == i}) for i in range(4)] == [b & (1 << 64) - 1 for b in bits[r.line]]


def test_pipeline_stage_goes_without_python(native):
    rows = [(1, "some words that come twice\nfirst", 32), (2, "second\nsome words that come twice", 33), (3, None, None)]
    out = corpus_pipeline.dedup_lines(native, native.createDataFrame(rows, "doc_id long, text string, n_chars long"), "")
    assert {tuple(r) for r in out.collect()} == {rows[0], (2, "second", 6), rows[2]}
