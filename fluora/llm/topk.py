"""Exact top-k search by term-at-a-time accumulation.

Vectors become sparse rows of integer terms: component x of dimension d is the weight ``floor(1024 * x)`` of term d.
Queries are taken in blocks of a fixed size by hash, one pass over the candidates for each block; the driver holds one block. A task turns each batch of
candidates into postings (for each term the candidates that have it, with weights); every query row scatters its
weighted postings into a dense array of scores, the k best are picked by partition selection, and Spark merges the
tasks' best by rank.

Edge cases: vectors that are null, hold a null or non-finite component take no part; missing dimensions of shorter
vectors count as zero; ties go to the smaller id; rows that share an id are candidates each, but never for a query of
that id; every query row is answered, also those that repeat; queries with no other vector give no row; scores are 64-bit
integers, and a pair whose sum might leave them (by the sum of absolute products) takes no part.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fluora.llm.common import cut

#: Queries that one pass serves (64 dimensions of 8 bytes: 16 MB at most in a task).
BLOCK = 32_768
#: Candidates whose dense scores a task holds at a time.
BATCH = 4_096
SCALE = 1024


def terms(vectors: DataFrame, vec_id: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(vec_id, weights) of the vectors that take part."""
    v = F.col(vector)
    whole = v.isNotNull() & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = vectors.where(F.coalesce(whole, F.lit(False)) & F.col(vec_id).isNotNull())
    weights = F.transform(v, lambda x: F.floor(x.cast("double") * SCALE).cast("long"))
    return rows.select(F.col(vec_id).cast("long").alias("vec_id"), weights.alias("weights"))


def dense(rows: pd.Series) -> np.ndarray:
    """A matrix of weights, zero where a row is shorter."""
    out = np.zeros((len(rows), max((len(r) for r in rows), default=0)), np.int64)
    for i, r in enumerate(rows):
        out[i, : len(r)] = r
    return out


def best(numbers: np.ndarray, query_ids: np.ndarray, queries: np.ndarray, ids: np.ndarray, weights: np.ndarray, k: int) -> Iterator[pd.DataFrame]:
    """The k best candidates of each query, by scattering the postings of the query's terms."""
    order = np.argsort(ids, kind="stable")  # equal scores then keep the smaller ids first
    ids, weights = ids[order], weights[order]
    postings = []
    for d in range(weights.shape[1]):
        at = np.flatnonzero(weights[:, d])
        postings.append((None if len(at) == len(ids) else at, weights[at, d]))
    found = []
    d = min(queries.shape[1], weights.shape[1])
    size = lambda m: np.abs(m[:, :d].astype(np.float64))
    wide = size(queries).max(initial=0) * size(weights).max(initial=0) * d >= 2**63
    scores = np.zeros(len(ids), np.int64)
    for i, (qid, query) in enumerate(zip(query_ids, queries, strict=True)):
        scores[:] = 0
        for d_ in np.flatnonzero(query[: len(postings)]):
            at, w = postings[d_]
            if at is None:
                scores += query[d_] * w
            else:
                scores[at] += query[d_] * w
        fits = ids != qid
        if wide:
            fits &= size(weights) @ size(queries[i : i + 1])[0] < 2**63
        take = min(len(ids), k + len(ids) - int(fits.sum()))
        if take < len(ids):
            edge = np.partition(scores, len(ids) - take)[len(ids) - take]
            some = np.flatnonzero((scores >= edge) & fits)
        else:
            some = np.flatnonzero(fits)
        some = some[np.argsort(-scores[some], kind="stable")][:k]
        found.append((np.full(len(some), numbers[i]), np.full(len(some), qid), ids[some], scores[some]))
    names = ("number", "query_id", "vec_id", "score")
    yield pd.DataFrame({name: np.concatenate([f[i] for f in found]) for i, name in enumerate(names)})


def _search(block: pd.DataFrame, first: int, k: int) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
    query_ids, queries = block.vec_id.to_numpy(np.int64), dense(block.weights)
    numbers = first + np.arange(len(query_ids))

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            for i in range(0, len(part), BATCH):
                some = part.iloc[i : i + BATCH]
                if len(some) and len(query_ids):
                    yield from best(numbers, query_ids, queries, some.vec_id.to_numpy(np.int64), dense(some.weights), k)

    return run


def search(candidates: DataFrame, queries: DataFrame, k: int = 10, block: int = BLOCK) -> DataFrame:
    """(query_id, rank, vec_id, score): the k candidates with the highest inner product for each query.

    Both tables have (vec_id, weights). Equal query rows are searched once and answered each. Blocks are made by a hash of
    the row; where there are several, the driver fetches one at a time and writes what it finds before the next.
    """
    rows = queries.groupBy("vec_id", "weights").agg(F.count("*").alias("n"))
    blocks = max(1, -(-queries.count() * 9 // (8 * block)))  # a bit more than needed, as hashes fill them unevenly
    if blocks > 1:
        rows = cut(rows)
    out, first = None, 0
    for b in range(blocks):
        own = rows.where(F.pmod(F.xxhash64("vec_id", "weights"), F.lit(blocks)) == b).toPandas()  # about ``block`` rows
        scored = candidates.mapInPandas(_search(own, first, k), "number long, query_id long, vec_id long, score long")
        by_query = Window.partitionBy("number").orderBy(F.desc("score"), "vec_id")
        ranked = scored.withColumn("rank", F.row_number().over(by_query)).where(F.col("rank") <= k)
        if (own.n > 1).any():
            again = candidates.sparkSession.createDataFrame(pd.DataFrame({"number": first + np.arange(len(own)), "n": own.n})[own.n > 1], "number long, n long")
            ranked = ranked.join(F.broadcast(again), "number", "left")  # at most a block
            ranked = ranked.select("*", F.explode(F.sequence(F.lit(1).cast("long"), F.coalesce("n", F.lit(1).cast("long")))))
        ranked = ranked.select("query_id", "rank", "vec_id", "score")
        ranked = cut(ranked) if blocks > 1 else ranked
        out = ranked if out is None else out.unionByName(ranked)
        first += len(own)
    return out


def op9_topk(spark, sf_dir: str) -> DataFrame:
    """The 10 best other vectors for every vector whose id is divisible by 100."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH)
    rows = terms(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
    return search(rows, rows.where("vec_id % 100 = 0"))


ORACLE = """
WITH parts AS (SELECT vec_id, unnest(embedding) AS x, generate_subscripts(embedding, 1) AS d FROM embeddings),
bad AS (SELECT DISTINCT vec_id FROM parts WHERE x IS NULL OR isnan(x) OR isinf(x)),
t AS (SELECT vec_id, d, floor(1024 * x::DOUBLE)::BIGINT AS w FROM parts WHERE vec_id NOT IN (SELECT vec_id FROM bad)),
s AS (SELECT q.vec_id AS query_id, c.vec_id, sum(q.w * c.w)::BIGINT AS score
  FROM t q JOIN t c ON q.d = c.d WHERE q.vec_id % 100 = 0 AND c.vec_id <> q.vec_id GROUP BY 1, 2),
r AS (SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INT AS rank, vec_id, score FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 10
"""
