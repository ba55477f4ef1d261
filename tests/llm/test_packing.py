"""Packing: token ids against the library, plans against a packing made one sequence at a time, whole results on Spark."""

import random
import zlib
from array import array
from collections import Counter

import numpy as np
import pytest

from fluora.llm import packing, word_ids

tokenizers = pytest.importorskip("tokenizers")


def one_by_one(counts: dict[int, int], limit: int) -> list[tuple[int, ...]]:
    have, out = Counter(counts), []
    while have := +have:
        inside, gap = [], limit
        while fits := [x for x in have if have[x] > 0 and x <= gap]:
            have[max(fits)] -= 1
            inside.append(max(fits))
            gap -= max(fits)
        if gap and len(inside) > 1:
            least = min(inside)
            have[least] += 1
            pairs = [(a + b, a) for a in have for b in have if have[a] > 0 and have[b] > 0 and (a > b or a == b and have[a] > 1) and least < a + b <= gap + least]
            inside.remove(least)
            put = [least]
            if pairs:
                both, a = max(pairs)
                put = [a, both - a]
            for x in put:
                have[x] -= 1
            inside += put
        out.append(tuple(sorted(inside)))
    return out


def test_plan_is_that_of_single_sequences():
    rnd = random.Random(1)
    for _ in range(200):
        limit = rnd.choice([1, 10, 30, 64])
        counts = {rnd.randint(1, limit): rnd.choice([1, 2, 3, 10, 50]) for _ in range(rnd.randint(0, limit))}
        fast = [tuple(sorted(Counter(i).elements())) for n, i in packing.plan(counts, limit) for _ in range(n)]
        assert fast == one_by_one(counts, limit)


@pytest.fixture(scope="module")
def whole():
    return tokenizers.Tokenizer.from_file(word_ids.tokenizer_path())


def ids_of(whole, text: str) -> bytes:
    return array("I", whole.encode(text or "", add_special_tokens=False).ids).tobytes()


def encoded(enc, texts: list[str]) -> list[bytes]:
    parts = [t.encode() for t in texts]
    ids, ends = enc.encode(np.frombuffer(b"".join(parts), np.uint8), np.concatenate([[0], np.cumsum([len(p) for p in parts])]).astype(np.int64))
    return [ids[a:b].tobytes() for a, b in zip(ends, ends[1:], strict=False)]


def test_ids_are_the_library_s(whole, monkeypatch):
    odd = ["", " ", "A<|endoftext|>b <|startoftext|>", "İstanbul ŉ ſ ǅ", "a b　c\x1cd\x85e", "é ́x", "ΑΣ Σ", "don't WE'LL 's 'S", "x" * 3000, "日本語 テスト", "ﬁ ½ ² 12³4", " a ", "a\x0bb\x0cc\rd\te", "é́", "﻿hi", "ªº µ ÿ ß ẞ", "a\x00b", "<|", "ab­cd ʼn"]
    rnd, letters = random.Random(3), "aZ é́ \u0085ÀßĲ'st’<|>09²½\n\tΣİͅ日ẞ"
    texts = [*odd, *("".join(rnd.choice(letters) for _ in range(rnd.randint(0, 14))) for _ in range(3000))]
    want = [ids_of(whole, t) for t in texts]
    for cache, window, same in ((word_ids.CACHE, word_ids.WINDOW, False), (100, 64, False), (1000, 64, True)):
        monkeypatch.setattr(word_ids, "CACHE", cache)
        monkeypatch.setattr(word_ids, "WINDOW", window)
        enc = word_ids.WordIds(word_ids.tokenizer_path())
        if same:  # many words share a hash
            enc.inverse = np.zeros_like(enc.inverse)
        for at in range(0, len(texts), 700):
            assert encoded(enc, texts[at : at + 700]) == want[at : at + 700]
    assert encoded(enc, []) == [] and encoded(enc, ["", ""]) == [b"", b""]


def test_packed(spark, whole):
    rnd = random.Random(5)
    texts = [None, "", " \n", "word " * 300, "x y " * 40, *(" ".join(rnd.choice(["the", "of", "Ähre", "12"]) for _ in range(rnd.randint(0, 70))) for _ in range(300))]
    rows = [(i, t, "clash", 0) for i, t in enumerate(texts)] + [(7, "same text", "x", 1)] * 150 + [(None, "no id", "x", 2)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, PIECE string, length int").repartition(3)
    out = packing.packed(docs, limit=64).collect()
    want, got = Counter(), Counter()
    for i, t, *_ in rows:
        ids = ids_of(whole, t) + b"\1\0\0\0"
        for k, a in enumerate(range(0, len(ids), 256)):
            want[i, k, a // 4, ids[a : a + 256]] += 1
    sequences = {}
    for r in out:
        got[r.doc_id, r.piece, r.start, bytes(r.ids)] += 1
        assert r.length * 4 == len(r.ids)
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
    assert got == want
    lengths = Counter(r.length for r in out)
    for places in sequences.values():
        end = 0
        for offset, n in sorted(places):
            assert offset == end
            end += n
        assert end <= 64
    assert sorted(tuple(sorted(n for _, n in p)) for p in sequences.values()) == sorted(one_by_one(lengths, 64))
    assert sorted(sequences) == list(range(len(sequences)))
    assert packing.packed(docs.limit(0), limit=64).count() == 0


def test_query(spark, whole):
    out = packing.op13_packing(spark, "/root/testdata/sf0.001").collect()
    texts = {r.doc_id: r.text for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()}
    for r in out:
        ids = ids_of(whole, texts[r.doc_id]) + b"\1\0\0\0"
        assert zlib.crc32(ids[4 * r.start : 4 * (r.start + r.length)]) == r.ids_crc32
    total = sum(r.length for r in out)
    used = len({r.sequence_id for r in out})
    assert total <= 4096 * used and used <= 1 + 1.01 * total / 4096
