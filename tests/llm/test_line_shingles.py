import random
import re

import numpy as np

from fluora.llm import line_shingles
from fluora.llm.line_shingles import Lines, bitmaps, chunks


def brute(line: bytes) -> set:
    w = re.findall(rb"[^\x20\x09-\x0D]+", line)
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def test_sets_of_lines_match_brute_force(monkeypatch):
    rng = random.Random(3)
    words = ["a", "bb", "ccc", "größe", "x" * 300, "\x00", "漢字"]
    texts = ["", "\n", " \t\n\x0b", "a", *["".join(rng.choice(words) + rng.choice(["  ", " ", "\t", "\n", "\r\n", " "]) for _ in range(rng.randrange(60))) for _ in range(200)]]
    data = [t.encode() for t in texts]
    wanted = [(i, k, brute(x)) for i, t in enumerate(data) for k, x in enumerate(t.split(b"\n")) if brute(x)]
    ranks = np.random.default_rng(1).integers(1, 64, 1 << 16).astype(np.uint8)
    seen: dict = {}
    for step in (1 << 18, 64):  # the latter makes most words start a new piece
        monkeypatch.setattr(line_shingles, "STEP", step)
        lines = Lines(data)
        assert [(i, k) for i, k, _ in wanted] == list(zip(lines.text.tolist(), lines.number.tolist(), strict=True))
        keys, starts = lines.sets(ranks)
        bits = list(bitmaps(keys, starts[:-1], 4))
        for at, (_, _, s) in enumerate(wanted):
            some = keys[starts[at] : starts[at + 1]].tolist()
            assert len(some) == len(s) and some == sorted(some)
            assert seen.setdefault(frozenset(s), some) == some  # equal sets have equal keys, wherever they are
            assert 1 <= sum(int(b[at]).bit_count() for b in bits) <= len(s)
    assert len({tuple(v) for v in seen.values()}) == len(seen)


def test_no_texts_and_chunks():
    for texts in ([], [b""], [b" \n "]):
        lines = Lines(texts)
        keys, starts = lines.sets()
        assert not len(keys) and not len(lines.text) and starts.tolist() == [0]
    assert list(chunks([b"x" * line_shingles.CHUNK, b"y", b"z"])) == [(0, 1), (1, 3)]
