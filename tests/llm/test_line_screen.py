"""The screening round of line dedup."""

import os
import random

from fluora.llm import line_dedup


def shingles(line: str) -> set:
    w = line.split()
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))}


def test_screening_keeps_similar_lines_and_makes_few_shingles(spark):
    rng = random.Random(5)
    lines = []
    for k in range(60):
        w = [rng.choice("abc") if k % 3 == 0 else f"w{rng.randrange(40)}" for _ in range(rng.randrange(1, 60))]
        w = w * rng.choice([1, 1, 3])
        near = list(w)
        near[rng.randrange(len(w))] = "other"
        lines += [" ".join(w), " ".join(near), " ".join(w[1:] + w[:1])]
    lines.append(" ".join(f"x{i}" for i in range(104)))
    docs = spark.createDataFrame(list(enumerate(lines)), "doc_id long, text string")
    rows = line_dedup.screened(docs).collect()
    ids = {r.line: r.doc_id for r in rows if r.head}
    assert sorted(ids.values()) == list(range(len(lines)))
    tokens = {i: set() for i in ids.values()}
    for r in rows:
        tokens[ids[r.line]] |= {r.token} - {None}
    sets = [shingles(x) for x in lines]
    near = [(a, b) for a in range(len(lines)) for b in range(a) if 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b])]
    assert len(near) > 30 and all(tokens[a] & tokens[b] for a, b in near)
    assert len(tokens[len(lines) - 1]) == 21  # of 100


def test_sets_are_made_of_met_lines_only_and_the_screening_table_goes(spark, monkeypatch):
    seen, tables = [], []
    plain, screen = line_dedup._sets, line_dedup.screened
    monkeypatch.setattr(line_dedup, "_sets", lambda docs, some: seen.append(some.count()) or plain(docs, some))
    monkeypatch.setattr(line_dedup, "screened", lambda docs: tables.extend((t := screen(docs)).inputFiles()) or t)
    line = " ".join(f"w{i}" for i in range(60))
    rows = [(1, line), (2, line.replace("w30 ", "other ")), (3, line), *[(9 + k, " ".join(f"u{k}_{i}" for i in range(30))) for k in range(20)]]
    out = line_dedup.removed(spark.createDataFrame(rows, "doc_id long, text string"))
    assert {r.doc_id for r in out.collect()} == {2, 3}
    assert seen == [2]
    assert tables and not any(os.path.exists(t.removeprefix("file://")) for t in tables)
