"""Alignment against whole texts given to the libraries, all pairs of tokens compared."""

import hashlib
import random
from collections import Counter

import pytest

from fluora.llm import alignment

pytest.importorskip("tokenizers")
pytest.importorskip("sentencepiece")

ODD = ["", " ", "\n", "  a  b ", "a\nb\r\nc\td", "x\r y;\r\n", "</s> <s>[INST] <|endoftext|> <0x41>", "é́ 日本語。テスト 🏳️‍🌈", "a b　c\u0085d\x1ce f", "don't 's 'LL", "word" * 400, "▁a", "a ▁ b", "tab\t\tx\n\n\n  y", "\t lead", "\rlead", "nul\x00 x", "﻿hi \v\f v", "  ", "a b c"]


def aligned_whole(two, text):
    """(a, b, groups, links) of a whole text, every pair of tokens tested."""
    if not text:
        return [], [], [], []
    a, b = two.a.encode(" " + text, add_special_tokens=False).ids, two.b.encode(text)
    spans = []
    for ids, table in ((a, two.bytes_a), (b, two.bytes_b)):
        end, own = 0, []
        for i in ids:
            own.append((end, end + len(table[i]), i))
            end = own[-1][1]
        if b"".join(table[i] for i in ids) != (" " + text).encode():
            return [], [], [], []
        spans.append(own)
    links = [(x[2], y[2]) for x in spans[0] for y in spans[1] if x[0] < y[1] and y[0] < x[1]]
    cuts = sorted({x[1] for x in spans[0]} & {y[1] for y in spans[1]})
    groups = [([x[2] for x in spans[0] if low < x[1] <= high], [y[2] for y in spans[1] if low < y[1] <= high]) for low, high in zip([0, *cuts], cuts, strict=False)]
    return a, b, groups, links


def brute(two, rows):
    found = [(i, *aligned_whole(two, t)) for i, t in rows]
    counts = Counter(link for f in found for link in f[4])
    most = {}
    for (_, b), n in counts.items():
        most[b] = max(most.get(b, 0), n)
    return Counter(
        (i, len(a), len(b), len(groups), len(links), sum(counts[x] == most[x[1]] for x in links), sum(counts[x] for x in links), hashlib.sha256(";".join(f"{','.join(map(str, x))}|{','.join(map(str, y))}" for x, y in groups).encode()).hexdigest() if a else "")
        for i, a, b, groups, links in found
    )


def rows_of(df):
    return Counter(tuple(r) for r in df.select("doc_id", *alignment.SUMS, "groups_sha256").collect())


def test_segments_encode_by_themselves():
    two, rnd = alignment.pair(), random.Random(4)
    letters = ["a", "The", "é", "́", "'s", "'", " ", "  ", "\n", "\t", "\r", ";", ")", "1", "23", " ", "　", "\x1c", "\u0085", "日", "<s>", "{", "\v"]
    for text in [*ODD, *("".join(rnd.choice(letters) for _ in range(rnd.randint(1, 12))) for _ in range(3000))]:
        parts = two.segments(text)
        if "▁" in text or not text:
            assert parts == []
            continue
        assert "".join(parts) == " " + text and all(parts)
        done = list(two.aligned(parts))
        a, b, groups, _ = aligned_whole(two, text) if len(text) < 200 else (two.a.encode(" " + text, add_special_tokens=False).ids, two.b.encode(text), None, None)
        assert [i for d in done for i in d[0]] == a and [i for d in done for i in d[1]] == b, repr(text)
        assert groups is None or [g for d in done for g in d[2]] == groups


def test_align(spark, monkeypatch):
    rnd = random.Random(6)
    texts = [None, *ODD, *(" ".join(rnd.choice(["the", "of", "Ähre,", "12%", "on\nthe"]) for _ in range(rnd.randint(0, 40))) for _ in range(60))]
    rows = [(i, t) for i, t in enumerate(texts)] + [(3, "same the text")] * 40 + [(None, "no id"), (2**60 + 1, "large id")]
    docs = spark.createDataFrame([(i, t, "clash", 1) for i, t in rows], "doc_id long, text string, SEGMENT string, lot int").repartition(3)
    want = brute(alignment.pair(), rows)
    for lot_bytes, most in ((1, 0), (300, 10**6), (alignment.LOT_BYTES, 0)):
        monkeypatch.setattr(alignment, "PAIRS", most)
        found = alignment.align(docs, lot_bytes=lot_bytes)
        assert rows_of(alignment.composed(found)) == want
    assert sum(r.n for r in found.held.collect()) == sum(len(alignment.pair().segments(t)) for _, t in rows)
    assert alignment.composed(alignment.align(docs.limit(0))).count() == 0


def test_query(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    out = rows_of(alignment.op11_alignment(spark, "/root/testdata/sf0.001"))
    assert sum(out.values()) == len(rows)
    short = [r for r in rows if len(r[1] or "") < 400]
    part = spark.createDataFrame(short, "doc_id long, text string")
    assert rows_of(alignment.composed(alignment.align(part))) == brute(alignment.pair(), short)
    lengths = {i: len(alignment.pair().b.encode(t)) for i, t in rows if t}
    assert all(r[2] == lengths.get(r[0], 0) for r in out)
