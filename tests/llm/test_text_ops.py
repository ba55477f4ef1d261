"""Operators on documents against brute force, with nulls, empty and long texts, ties, repeated rows and odd columns."""

import hashlib
import math
import random
import re
import zlib
from array import array
from collections import Counter

import pytest
from pyspark.sql import functions as F

from fluora.llm import line_dedup, lm_scoring, mixing, ngram_join, quality, sentencepiece_bpe, sharding

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, row string, Record int"


def make(seed=1):
    rnd = random.Random(seed)
    word = lambda: "".join(rnd.choice("abcdefg") for _ in range(rnd.randint(1, 4)))
    line = lambda n: " ".join(word() for _ in range(n))
    texts = [line(rnd.randint(1, 60)) for _ in range(60)]
    base = line(150)
    for k in range(12):  # near copies
        w = base.split(" ")
        w[10 * k] = "zz" + str(k)
        texts.append(" ".join(w))
    shared = line(55)
    texts += [shared + "\n" + line(20), line(9) + "\n" + shared, shared + "\n" + shared, texts[0], texts[0]]
    texts += ["", None, " \n\t ", "a", "a b c d", "## $$ && " * 30, "x y " * 3000, line(20000), "é漢字 \U0001f642 \x00z  two   spaces ", "ÀB cD " * 12]
    rows = [(i, t, rnd.choice(["en", "de", None]), rnd.choice(["a", "b", "c", None]), len(t or ""), "r", i) for i, t in enumerate(texts)]
    return [*rows, rows[3], rows[60], (None, "null id " * 5, None, None, 1, None, None)]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(make(), SCHEMA).repartition(3).cache()


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def shingles(text):
    w = WORD.findall(text or "")
    return {tuple(w[k : k + 5]) for k in range(max(len(w) - 4, 1))} if w else set()


def test_mixing(docs, none):
    rows = mixing.sized(docs)
    out = mixing.apply(rows, mixing.plan(rows)).collect()
    assert len(out) == len(make())
    size, want = Counter(), {}
    for _, t, _, s, *_ in make():
        size[s] += len(WORD.findall(t or ""))
    total, names = sum(size.values()), sorted(size, key=lambda s: (s is None, s or ""))
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
    full, left = set(), 1.5 * total
    while True:
        share = {s: left * weight[s] / sum(weight[x] for x in names if x not in full) for s in names if s not in full}
        over = [s for s in share if share[s] > 2 * size[s]]
        if not over:
            break
        full |= set(over)
        left = 1.5 * total - sum(2 * size[s] for s in full)
    want = {("b" if s is None else "a" + s): 2 * size[s] if s in full else share[s] for s in names}
    taken, most = Counter(), Counter()
    for r in out:
        assert r.target == pytest.approx(want[r.key]) and 0 <= r.copies <= 2
        taken[r.key] += r.size * r.copies
        most[r.key] = max(most[r.key], r.size)
    for k in want:
        assert abs(taken[k] - want[k]) <= most[k]
    again = mixing.apply(rows.repartition(5), mixing.plan(rows.repartition(5))).collect()
    assert Counter((r.doc_id, r.copies) for r in again) == Counter((r.doc_id, r.copies) for r in out)
    mixed = mixing.mix(docs)
    assert mixed.columns == docs.columns and mixed.count() == sum(r.copies for r in out)
    assert mixing.mix(none).count() == 0


def test_sharding(docs, none):
    out = sharding.shuffled(docs, 7, bucket_bytes=20_000).collect()
    by = {}
    for r in out:
        by.setdefault(r.shard, []).append(r.slot)
    assert all(sorted(v) == list(range(len(v))) for v in by.values())
    assert sorted(by) == list(range(7)) and max(map(len, by.values())) - min(map(len, by.values())) <= 1
    assert Counter((r.record.doc_id, r.record.text) for r in out) == Counter((r[0], r[1]) for r in make())
    order = [r.record.doc_id for r in sorted(out, key=lambda r: (r.shard, r.slot))]
    assert order != sorted(order, key=lambda d: (d is None, d or 0))
    again = sharding.shuffled(docs.repartition(2), 7, bucket_bytes=20_000).collect()
    assert {(r.record.doc_id, r.shard, r.slot) for r in again} == {(r.record.doc_id, r.shard, r.slot) for r in out}
    assert sharding.shuffled(none, 7).count() == 0


def test_sentencepiece(docs, none):
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=sentencepiece_bpe.model_path())
    got = Counter(map(tuple, sentencepiece_bpe.digests(docs).collect()))
    want = Counter()
    for d, t, *_ in make():
        ids = sp.encode(t or "", add_bos=True, add_eos=True)
        want[d, len(ids), hashlib.sha256(array("I", ids).tobytes()).hexdigest(), hashlib.sha256(sp.decode(ids).encode()).hexdigest()] += 1
    assert got == want
    enc, rnd = sentencepiece_bpe.encoder(sentencepiece_bpe.model_path()), random.Random(4)
    texts = ["".join(rnd.choice("abeht n  in▁\n.,!()=;'01é漢Ω_-\t\U0001f642") for _ in range(rnd.randint(0, 60))) for _ in range(3000)]
    texts += [sp.id_to_piece(rnd.randrange(259, 32000)) * rnd.randint(1, 3) for _ in range(3000)] + [" " * n + "a" * (n % 2) for n in range(80)]
    assert enc.encode(texts) == [array("I", sp.encode(t, add_bos=True, add_eos=True)).tobytes() for t in texts]
    assert sentencepiece_bpe.tokenized(none).count() == 0 and sentencepiece_bpe.digests(none).count() == 0


def test_quality(docs, none):
    got = quality.judged(docs.drop("row"), ["doc_id", "text"]).collect()
    assert len(got) == len(make())
    for r in got:
        t = r.text or ""
        w = WORD.findall(t)
        where = {}
        for i in range(len(w) - 7):
            where.setdefault(tuple(w[i : i + 8]), []).append(i)
        in_ = {j for v in where.values() if len(v) > 1 for i in v for j in range(i, i + 8)}
        seen, dup = set(), 0
        for x in t.split("\n"):
            dup += bool(WORD.search(x)) and x in seen
            seen.add(x)
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == (len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), dup, len(in_))
        assert r.base_failed == (len(w) < 20 or 100 * len(in_) > 30 * len(w)) and not (r.base_failed and r.kept)
    assert quality.filtered(docs).columns == docs.columns and quality.filtered(none).count() == 0


def test_quality_finds_outliers(spark):
    rnd = random.Random(3)
    line = lambda n: " ".join("".join(rnd.choice("etaoin") for _ in range(rnd.randint(2, 7))) for _ in range(n))
    rows = [(i, line(rnd.randint(40, 400)), "en", "s") for i in range(300)]
    rows += [(1000 + i, " ".join(w + "***" for w in line(100).split()), "en", "s") for i in range(40)]
    copy = line(90)
    rows += [(2000 + i, copy, "en", "s") for i in range(500)]
    got = {r.doc_id: r.kept for r in quality.judged(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string"), ["doc_id"]).collect()}
    assert sum(got[i] for i in range(300)) >= 299 and not any(got[1000 + i] for i in range(40)) and got[2000]


def test_quality_model_is_the_same_at_every_size(spark):
    """Draws from one distribution, where most texts share few vectors and the others are spread."""

    def model(n):
        rnd = random.Random(6)
        rows = []
        for i in range(n):
            many = rnd.random() < 0.9
            z = (5000 + rnd.randrange(6), 4000 + rnd.randrange(6), 0, 0) if many else (rnd.randrange(4000, 6000), rnd.randrange(3500, 4500), rnd.randrange(1, 3000), rnd.randrange(300))
            rows += [("k", i, *map(int, z), False)] * (1 + 50 * (i == 7))  # one text has exact copies
        kind = "key string, text_hash long, " + ", ".join(f"z_{k} long" for k in quality.NAMES) + ", base_failed boolean"
        return quality.estimate(spark.createDataFrame(rows, kind)).first().asDict()

    small, large = model(1000), model(100_000)
    assert all(small[k] == pytest.approx(large[k], abs=0.05) for k in small if k != "key")
    assert abs(large["m_2"]) < 0.01 and large["m_0"] == pytest.approx(5002.5 / 1024, abs=0.01)


def similar(a, b):
    return 9 * len(a & b) >= 4 * (len(a) + len(b))


def test_line_dedup(docs, none):
    first, gone = [], {}
    for d, t in sorted({(r[0], r[1]) for r in make()}, key=lambda r: (r[0] is not None, r[0] or 0)):
        for i, x in enumerate((t or "").split("\n")):
            s = shingles(x)
            if s:
                if any(similar(s, o) for o in first):
                    gone.setdefault(d, []).append(i)
                first.append(s)
    out = line_dedup.deduplicated(docs).collect()
    assert len(out) == len(make())
    for r in out:
        rem = gone.get(r.record.doc_id, [])
        t = r.record.text
        assert list(r.removed) == rem
        assert r.text == (t if not rem else "\n".join(x for i, x in enumerate(t.split("\n")) if i not in rem))
    assert line_dedup.deduplicated(none).count() == 0


def test_line_dedup_of_large_groups(spark, monkeypatch):
    """Near copies of one line that match few others, in salted blocks; copies of short lines."""
    monkeypatch.setattr(line_dedup, "BLOCK", 100)
    rnd = random.Random(11)
    base = [str(rnd.random()) for _ in range(50)]
    rows = []
    for i in range(2000):
        w = list(base)
        for _ in range(rnd.randint(1, 2)):
            w[rnd.randrange(50)] = str(rnd.random())
        rows.append((i, " ".join(w)))
    rows += [(3000 + i, f"buy it now\n{rnd.random()}\nbuy it") for i in range(30)]
    seen, want = [], set()
    for i, t in rows[:2000]:
        s = shingles(t)
        if any(similar(s, o) for o in seen):
            want.add((i, (0,)))
        seen.append(s)
    want |= {(3000 + i, (0, 2)) for i in range(1, 30)}
    out = line_dedup.deduplicated(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).where(F.size("removed") > 0).collect()
    assert {(r.record.doc_id, tuple(r.removed)) for r in out} == want and len(want) > 500


def test_line_dedup_tells_rows_of_one_id_apart(spark):
    """Rows that share an id or have none lose the lines that match earlier ones, and no others."""
    rnd = random.Random(9)
    line = lambda: " ".join(str(rnd.random()) for _ in range(100))
    base, near = line(), []
    for k in range(4):
        w = base.split(" ")
        w[5 + 20 * k] = "other"
        near.append(" ".join(w))
    rows = [(d, "\n".join([line(), base if k == 0 else line(), line()])) for d in (None, 7) for k in range(4)]
    rows += [(8, x) for x in near[:2]] + [(None, near[2]), (None, near[3]), rows[2], rows[5]]
    out = line_dedup.deduplicated(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert len(out) == len(rows)
    having = [r for r in out if any(similar(shingles(x), shingles(base)) for x in r.record.text.split("\n"))]
    lost = [r for r in out if len(r.removed)]
    assert all(r in having for r in lost) and len(having) == 6 and len(lost) == 5
    for r in lost:
        gone = [r.record.text.split("\n")[i] for i in r.removed]
        assert len(gone) == 1 and similar(shingles(gone[0]), shingles(base))


def brute_links(rows):
    by = {}
    for d, t, *_ in rows:
        by.setdefault(t or "", []).append(d)
    texts = list(by)
    sets, links, group = [shingles(t) for t in texts], [0] * len(texts), list(range(len(texts)))
    for i in range(len(texts)):
        for j in range(i):
            if sets[i] and sets[j] and similar(sets[i], sets[j]):
                links[i] += 1
                links[j] += 1
                a, b = group[i], group[j]
                group = [b if g == a else g for g in group]
    ids = lambda i: [d for d in by[texts[i]] if d is not None]
    least = {g: min((d for i in range(len(texts)) if group[i] == g for d in ids(i)), default=None) for g in set(group)}
    return {(d, min(ids(i), default=None), len(by[t]), links[i], least[group[i]]) for i, t in enumerate(texts) for d in by[t]}


@pytest.mark.parametrize("block", [256, 3])
def test_ngram_join(docs, none, block, monkeypatch):
    monkeypatch.setattr(ngram_join, "BLOCK", block)
    monkeypatch.setattr(ngram_join, "SMALL", 64 if block > 9 else 4)
    out = [tuple(r) for r in ngram_join.linked(docs).collect()]
    assert len(out) == len(make()) and set(out) == brute_links(make())
    if block > 9:
        assert ngram_join.linked(none).count() == 0
        assert ngram_join.recall(ngram_join.depth()) >= ngram_join.TARGET > ngram_join.recall(ngram_join.depth() + 1)


def test_join_near_keeps_one_row_of_each_class(spark):
    """Rows without an id, or with a shared one, are kept or dropped by their texts."""
    import corpus_pipeline

    rnd = random.Random(8)
    line = lambda: " ".join(str(rnd.random()) for _ in range(60))
    own, shared, base = [line() for _ in range(9)], [line() for _ in range(9)], line()
    near = base + " end"
    rows = [(None, t) for t in own] + [(7, t) for t in shared] + [(None, own[0]), (7, shared[0])]
    rows += [(3, base), (None, base), (9, near), (7, near)]  # one class: the row of id 3 stays
    rows += [(5, t + x) for t in [line()] for x in ("", " a", " b")]  # one class under one id: one row stays
    out = corpus_pipeline.join_near(spark, spark.createDataFrame(rows, "doc_id long, text string"), "").collect()
    got = Counter(map(tuple, out))
    assert all(got[None, t] == 1 for t in own) and all(got[7, t] == 1 for t in shared)
    assert got[3, base] == 1 and sum(d == 5 for d, _ in out) == 1 and len(out) == 20


def lm_rows():
    rnd = random.Random(5)
    out = make()
    for i in range(1000, 1400):
        a = "the cat sat on red mats" if i % 2 else "der hund lief im wald"
        out.append((i, " ".join(rnd.choice(a.split()) for _ in range(60)), None, None, 0, None, 0))
    return out


def test_lm_scoring(spark, none):
    rows = lm_rows()
    docs = spark.createDataFrame(rows, SCHEMA)
    held = lambda d: zlib.crc32(("" if d is None else str(d)).encode()) % 10 == 0
    lower = lambda t: re.sub("[A-Z]", lambda m: m[0].lower(), t or "")
    tok = [(d, [*WORD.findall(lower(t)), None]) for d, t, *_ in rows]
    c = Counter(w for d, ws in tok if not held(d) for w in ws)
    n, v = sum(c.values()), len(c)
    want = sorted((-1 if d is None else d, held(d), len(ws), sum(c[w] > 0 for w in ws), n, round(sum(math.log10((c[w] + 0.1) / (n + 0.1 * (v + 1))) for w in ws), 4)) for d, ws in tok)
    out = lm_scoring.scored(docs).collect()
    assert sorted((-1 if r.doc_id is None else r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 4)) for r in out) == want
    test = [r for r in out if r.held_out and (r.doc_id or 0) >= 1000]
    assert sum(r.score for r in test) > sum(r.base_score for r in test) + 0.1 * sum(r.n_tokens for r in test)
    assert lm_scoring.scored(none).count() == 0


def test_lm_probabilities_sum_to_one():
    """Over all words of a small vocabulary and the unknown one, after any context; words of a class share its probability."""
    import numpy as np

    own = [(f"w{i}", 100 - i) for i in range(10)]
    rare = [(f"r{i}", 1 + i % 3) for i in range(40)]
    rest = {}
    for w, c in rare:
        k = lm_scoring.last_class(w.encode())
        n, v = rest.get(k, (0, 0))
        rest[k] = (n + c, v + 1)
    lexicon = lm_scoring.Lexicon(own, [], 7, rest, 0.6)
    model = lm_scoring.Model(lexicon)
    rng = np.random.default_rng(1)
    ids = rng.integers(0, len(lexicon.group), 3000)
    model.train(ids, np.array([0]), 1, 0.1)
    n = len(lexicon.group)
    texts = np.concatenate([np.array([12, 5, 1, w]) for w in range(n)])
    p = 10.0 ** model.log_probs(texts, np.arange(n) * 4)[3::4]
    assert np.isclose(p.sum(), 1, atol=1e-4)
    # within the classes: known words less the discount, and the unknown one
    for k, (c, v) in rest.items():
        inner = sum(10.0 ** (math.log10(x - 0.6) - lexicon.log_n[k]) for w, x in rare if lm_scoring.last_class(w.encode()) == k)
        assert np.isclose(inner + 10.0 ** (lexicon.log_miss[k] - lexicon.log_n[k]), 1) and v and c
    # brute force for one token
    r, before = model, [1, 5, 12]
    made = sum(r.c[j] * r.r[before[j]] for j in range(3))
    groups, w = np.exp(made @ r.gq.T + r.gb), 6
    same = np.flatnonzero(r.group == r.group[w])
    items = np.exp(made @ r.q[same].T + r.b[same])
    assert np.isclose(p[w], groups[r.group[w]] / groups.sum() * items[list(same).index(w)] / items.sum(), rtol=1e-3)


def test_mixing_rounds_rows_of_one_id_apart(spark):
    rows = [(1, f"w{i} " + "x " * (40 + i % 3), "a") for i in range(200)] + [(i + 2, "y " * 30, "b") for i in range(300)]
    sized = mixing.sized(spark.createDataFrame(rows, "doc_id long, text string, source string"))
    out = mixing.apply(sized, mixing.plan(sized)).collect()
    for key in {r.key for r in out}:
        some = [r for r in out if r.key == key]
        assert abs(sum(r.size * r.copies for r in some) - some[0].target) <= 45


def test_sharding_scatters_rows_of_one_id(spark):
    rows = spark.range(3000).select(F.lit(7).cast("long").alias("doc_id"), F.concat(F.lit("text "), F.col("id")).alias("text"))
    out = sharding.shuffled(rows, 3, bucket_bytes=8000).withColumn("part", F.spark_partition_id())
    assert out.groupBy("part").count().agg(F.max("count")).first()[0] < 1000
    assert sorted((r.shard, r.slot) for r in out.collect()) == [(s, i) for s in range(3) for i in range(1000)]


def test_mixing_takes_a_part_of_equal_rows(spark):
    from fluora.llm import mixing

    docs = spark.createDataFrame([(1, "two words", "a")] * 5000 + [(i, "one more text", "b") for i in range(700)], "doc_id long, text string, source string").repartition(5)
    rows = mixing.numbered(mixing.sized(docs))
    assert rows.count() == 5700
    model = mixing.plan(rows)
    per = {r.key: r for r in mixing.apply(rows, model).withColumn("taken", F.col("size") * F.col("copies")).groupBy("key", "target").agg(F.sum("taken").alias("taken"), F.max("copies").alias("most")).collect()}
    for r in per.values():
        assert abs(r.taken - r.target) <= 3 and r.most <= 2
    again = mixing.numbered(mixing.sized(docs.repartition(3)))
    assert again.exceptAll(rows).count() == 0 and rows.exceptAll(again).count() == 0
