"""Centroid clustering by sort-means, in exact integers.

In each round every centroid has the others sorted by distance. A vector first measures the distance to its previous
centroid, then scans that centroid's list in order, and stops as soon as the next one is strictly more than twice as far
from the previous centroid as the vector is: by the triangle inequality no later one can be nearer than the previous
centroid, or as near. Distances stay squared, so "twice" is a factor of four and nothing is rounded.

A round is one pass of Arrow batches over the vectors: it writes them with their new clusters, and Spark adds up the sums
and counts of the clusters in two steps (batch, then all). What reaches the driver is one row for each centroid.

Edge cases: only vectors with exactly ``size`` components, none null or non-finite, take part; with fewer vectors than
centroids there are as many centroids as vectors; rows that share an id or a vector count each; starts with one hash (equal
ids) go by their components, null ids come last; an empty table gives an empty result; columns beside the id and the vector
play no part. Components beyond ``WIDEST`` (after scaling) are refused with an error, as distances would leave 64 bits.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fluora.llm.common import cut, drop, noted

SCALE = 1024
#: Largest component: four times 64 squared differences of twice this stay below 2^63.
WIDEST = 1 << 26
#: Vectors that a task works on at a time.
BATCH = 8_192


def kept(vectors: DataFrame, size: int = 64, vec_id: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(vec_id, v): vectors of ``size`` finite components, scaled and floored to integers."""
    v = F.col(vector)
    whole = (F.size(v) == size) & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    scaled = F.transform(v, lambda x: F.floor(x.cast("double") * SCALE))
    fits = F.forall(v, lambda x: F.abs(x.cast("double") * SCALE) <= WIDEST)
    refused = F.raise_error(F.lit("a component is too large for exact distances")).cast("array<int>")
    return vectors.where(F.coalesce(whole, F.lit(False))).select(F.col(vec_id).cast("long").alias("vec_id"), F.when(fits, scaled.cast("array<int>")).otherwise(refused).alias("v"))


def starts(vectors: DataFrame, k: int = 8, seed: int = 3) -> np.ndarray:
    """The k vectors with the smallest SHA-256 of ``seed:vec_id``, in that order."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")), 256)
    rows = vectors.orderBy(digest.asc_nulls_last(), "v").limit(k).select("v").collect()  # k rows
    return np.array([r.v for r in rows], np.int64)


def nearest(vectors: np.ndarray, before: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(cluster, squared distance) of each vector by the sorted scan from its previous cluster; ties go to the smaller number."""
    apart = ((centroids[:, None] - centroids[None]) ** 2).sum(-1)
    order = np.argsort(apart, axis=1, kind="stable")
    cluster, distance = before.copy(), ((vectors - centroids[before]) ** 2).sum(1)
    reach = 4 * distance
    for home in range(len(centroids)):
        here = np.flatnonzero(before == home)
        for other in order[home]:
            if other == home:
                continue
            here = here[apart[home, other] <= reach[here]]  # the others are done
            if not len(here):
                break
            d = ((vectors[here] - centroids[other]) ** 2).sum(1)
            nearer = (d < distance[here]) | (d == distance[here]) & (other < cluster[here])
            cluster[here[nearer]], distance[here[nearer]] = other, d[nearer]
    return cluster, distance


def _batches(some, size: int) -> Iterator[tuple]:
    """Pieces of a record batch with their vectors as a matrix."""
    for at in range(0, some.num_rows, BATCH):
        rows = some.slice(at, BATCH)
        yield rows, rows.column("v").flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(-1, size)


def _assigned(centroids: np.ndarray) -> Callable[[Iterator], Iterator]:
    def run(parts: Iterator) -> Iterator:
        import pyarrow as pa

        for some in parts:
            for rows, x in _batches(some, centroids.shape[1]):
                cluster, distance = nearest(x, rows.column("cluster").to_numpy(), centroids)
                yield pa.RecordBatch.from_arrays([rows.column("vec_id"), rows.column("v"), pa.array(cluster, pa.int32()), pa.array(distance, pa.int64())], ["vec_id", "v", "cluster", "distance"])

    return run


def _summed(size: int) -> Callable[[Iterator], Iterator]:
    def run(parts: Iterator) -> Iterator:
        import pyarrow as pa

        n, sums = {}, {}
        for some in parts:
            for rows, x in _batches(some, size):
                cluster = rows.column("cluster").to_numpy()
                for c in np.unique(cluster).tolist():
                    own = x[cluster == c]
                    n[c] = n.get(c, 0) + len(own)
                    sums[c] = sums.get(c, 0) + own.sum(0)
        if n:
            yield pa.RecordBatch.from_arrays([pa.array(list(n), pa.int32()), pa.array(list(n.values()), pa.int64()), pa.array([s.tolist() for s in sums.values()], pa.list_(pa.int64()))], ["cluster", "n", "sums"])

    return run


def moved(assigned: DataFrame, centroids: np.ndarray) -> np.ndarray:
    """The floor of the mean of each cluster's vectors; a centroid without vectors stays."""
    size = centroids.shape[1]
    parts = assigned.select("v", "cluster").mapInArrow(_summed(size), "cluster int, n long, sums array<long>")
    total = parts.groupBy("cluster").agg(F.sum("n").alias("n"), *[F.sum(F.get("sums", F.lit(i)).cast("decimal(38,0)")).alias(f"s{i}") for i in range(size)])
    out = centroids.copy()
    for row in total.collect():  # a row a centroid
        out[row.cluster] = [int(row[f"s{i}"]) // row.n for i in range(size)]
    return out


def clustered(vectors: DataFrame, k: int = 8, rounds: int = 10, seed: int = 3, size: int = 64) -> tuple[DataFrame, np.ndarray]:
    """((vec_id, v, cluster, distance), centroids) of (vec_id, v) after so many rounds and a last assignment."""
    spark = vectors.sparkSession
    with noted([]) as old:
        vectors = cut(vectors)
    centroids = starts(vectors, k, seed)
    now = vectors.withColumn("cluster", F.lit(0))
    schema = "vec_id long, v array<int>, cluster int, distance long"
    if not len(centroids):
        return now.withColumn("distance", F.lit(0).cast("long")), centroids
    for i in range(rounds + 1):
        with noted([]) as written:
            assigned = cut(now.select("vec_id", "v", "cluster").mapInArrow(_assigned(centroids), schema))
        drop(spark, old)  # the round before has been read for the last time
        now, old = assigned, written
        if i < rounds:
            centroids = moved(now, centroids)
    return now, centroids


def op12_clustering(spark, sf_dir: str) -> DataFrame:
    """Ten rounds over eight centroids; one row per vector."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH)
    rows, centroids = clustered(kept(spark.read.parquet(f"{sf_dir}/embeddings.parquet")))
    sums = {r.cluster: int(r.s) for r in rows.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("s")).collect()}
    digests = [(c, sums.get(c, 0), hashlib.sha256(",".join(map(str, x)).encode()).hexdigest()) for c, x in enumerate(centroids.tolist())]
    per = spark.createDataFrame(digests, "cluster int, cluster_inertia long, centroid_sha256 string")
    out = rows.join(F.broadcast(per), "cluster").withColumn("inertia", F.lit(sum(sums.values())).cast("long"))  # a row a centroid
    return out.select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def oracle(rounds: int = 10) -> str:
    """The same in SQL, every distance measured: one common table for each round's centroids."""
    near = "SELECT rid, k.c, sum((w - x) * (w - x)) AS d FROM t JOIN {k} k USING (i) GROUP BY 1, 2"
    best = f"SELECT rid, c, d FROM ({near}) QUALIFY row_number() OVER (PARTITION BY rid ORDER BY d, c) = 1"
    steps = [
        f"""k{n + 1} AS MATERIALIZED (WITH a AS ({best.format(k=f"k{n}")}), m AS (SELECT c, i, sum(w) AS s, count(*) AS n FROM a JOIN t USING (rid) GROUP BY 1, 2)
SELECT k.c, k.i, coalesce(((s - ((s % n) + n) % n) // n)::BIGINT, k.x) AS x FROM k{n} k LEFT JOIN m USING (c, i))"""
        for n in range(rounds)
    ]
    return f"""WITH e AS (SELECT row_number() OVER () AS rid, vec_id, embedding FROM embeddings WHERE len(embedding) = 64),
p AS (SELECT rid, vec_id, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) AS i FROM e),
bad AS (SELECT DISTINCT rid FROM p WHERE x IS NULL OR isnan(x) OR isinf(x)),
t AS MATERIALIZED (SELECT rid, vec_id, i, floor(1024 * x)::BIGINT AS w FROM p WHERE rid NOT IN (SELECT rid FROM bad)),
f AS (SELECT rid, row_number() OVER (ORDER BY sha256('3:' || vec_id), ws) - 1 AS c FROM (SELECT rid, vec_id, list(w ORDER BY i) AS ws FROM t GROUP BY 1, 2) QUALIFY c < 8),
k0 AS MATERIALIZED (SELECT c, i, w AS x FROM f JOIN t USING (rid)),
{", ".join(steps)},
z AS (SELECT c, sha256(string_agg(x::VARCHAR, ',' ORDER BY i)) AS h FROM k{rounds} GROUP BY 1),
r AS MATERIALIZED ({best.format(k=f"k{rounds}")})
SELECT vec_id, r.c::INT AS cluster, d::BIGINT AS distance, (sum(d) OVER (PARTITION BY r.c))::BIGINT AS cluster_inertia, (sum(d) OVER ())::BIGINT AS inertia, h AS centroid_sha256
FROM r JOIN e USING (rid) JOIN z USING (c)"""


ORACLE = oracle()
