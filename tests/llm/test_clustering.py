"""Clustering against plain Lloyd rounds with all distances, in Python integers."""

import hashlib
import math
import random
from collections import Counter

import numpy as np
import pytest

from fluora.llm import clustering


def lloyd(rows, k, rounds, seed):
    """(vec_id, vector, cluster, distance) of rows (vec_id, vector), and the centroids."""
    key = lambda r: (r[0] is None, hashlib.sha256(f"{seed}:{r[0]}".encode()).hexdigest() if r[0] is not None else "", r[1])
    centroids = [list(v) for _, v in sorted(rows, key=key)[:k]]
    near = lambda v: min((sum((a - b) ** 2 for a, b in zip(v, c, strict=True)), i) for i, c in enumerate(centroids))
    for _ in range(rounds):
        groups = {}
        for _, v in rows:
            groups.setdefault(near(v)[1], []).append(v)
        for c, own in groups.items():
            centroids[c] = [sum(x) // len(own) for x in zip(*own, strict=True)]
    return Counter((i, tuple(v), near(v)[1], near(v)[0]) for i, v in rows), centroids


@pytest.mark.parametrize("size,span,n", [(2, 3, 150), (4, 40, 120), (3, clustering.WIDEST, 60)])
def test_rounds(spark, size, span, n):
    rnd = random.Random(size)
    rows = [(i // 2, [rnd.randint(-span, span) for _ in range(size)]) for i in range(n)]  # two rows an id
    rows += [rows[3], rows[3], (None, [0] * size), (-9, [1] * size)]
    df = spark.createDataFrame(rows, "vec_id long, v array<int>").repartition(3)
    for k in (1, 5, 8):
        out, centroids = clustering.clustered(df, k, 6, 3, size)
        want, ends = lloyd(rows, k, 6, 3)
        assert centroids.tolist() == ends
        assert Counter((r.vec_id, tuple(r.v), r.cluster, r.distance) for r in out.collect()) == want


def test_few_or_no_vectors(spark):
    df = spark.createDataFrame([(5, [1, 2]), (6, [1, 2])], "vec_id long, v array<int>")
    out, centroids = clustering.clustered(df, 8, 3, 3, 2)
    assert centroids.tolist() == [[1, 2]] * 2 and {r.cluster for r in out.collect()} == {0}  # ties go to the smaller number
    out, centroids = clustering.clustered(df.limit(0), 8, 3, 3, 2)
    assert out.count() == 0 and len(centroids) == 0


def test_nearest_stops_only_strictly_beyond():
    # as far from centroid 1 as twice the distance: the same distance, so the smaller number wins
    vectors, centroids = np.array([[5]]), np.array([[0], [10]])
    assert [x.tolist() for x in clustering.nearest(vectors, np.array([1]), centroids)] == [[0], [25]]


def test_kept(spark):
    good = [0.5, -0.0001]
    rows = [(1, good, 0), (2, None, 0), (3, [1.0, None], 0), (4, [float("nan"), 1.0], 0), (5, [float("inf"), 1.0], 0), (6, [1.0], 0), (7, [], 0), (None, good, 0)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, CLUSTER int")
    assert sorted((r.vec_id or 0, r.v) for r in clustering.kept(df, 2).collect()) == [(0, [512, -1]), (1, [512, -1])]
    large = spark.createDataFrame([(1, [1e17, 1.0])], df.schema[:2])
    with pytest.raises(Exception, match="too large"):
        clustering.kept(large, 2).collect()


def test_query(spark, tmp_path):
    rnd = random.Random(8)
    rows = [(i, [rnd.choice([-1.0, 0.25, 0.3, 1.0]) for _ in range(64)], 0) for i in range(60)] + [(100, [0.0] * 63, 1), (101, None, 1)]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").write.parquet(f"{tmp_path}/embeddings.parquet")
    scaled = [(i, [math.floor(1024 * float(np.float32(x))) for x in v]) for i, v, _ in rows[:60]]
    want, ends = lloyd(scaled, 8, 10, 3)
    per = Counter()
    for (_, _, c, d), n in want.items():
        per[c] += d * n
    digest = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in ends]
    got = {(r.vec_id, r.cluster, r.distance, r.cluster_inertia, r.inertia, r.centroid_sha256) for r in clustering.op12_clustering(spark, str(tmp_path)).collect()}
    assert got == {(i, c, d, per[c], sum(per.values()), digest[c]) for i, _, c, d in want}
