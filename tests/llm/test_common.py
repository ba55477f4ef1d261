import random

from fluora.llm.common import components, let, window_hashes, words


def test_components(spark):
    rnd = random.Random(7)
    edges = [(i, i + 1) for i in range(100, 160)] + [(0, i) for i in range(1, 40)] + [(rnd.randrange(200, 300), rnd.randrange(200, 300)) for _ in range(60)] + [(5, 5)]
    group = {v: v for e in edges for v in e}

    def find(v):
        while group[v] != v:
            v = group[v]
        return v

    for a, b in edges:
        x, y = sorted((find(a), find(b)))
        group[y] = x
    alone = {v for v in group if all(v not in e or e[0] == e[1] for e in edges)}
    got = {r.node: r.comp for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {v: find(v) for v in group if v not in alone}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_words_and_windows(spark):
    df = spark.createDataFrame([(" a\tb c \n d ",), ("",), (None,)], "t string")
    got = [r.w for r in df.select(words("t").alias("w")).collect()]
    assert got == [["a", "b c", "d"], [], []]
    assert df.select(let(words("t"), lambda w: window_hashes(w, 2)).alias("h")).first().h[0] is not None
