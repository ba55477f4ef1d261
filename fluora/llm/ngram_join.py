"""N-gram Jaccard join of documents by banded MinHash LSH with exact verification.

A text is the set of its five-word shingles. Each of ``TREES`` bands hashes ``depth()`` min-hashes of a text, and texts
with one hash are candidates of each other. The depth is the largest, up to ``LONGEST``, at which a pair at the threshold
meets in some band with the target recall; it doesn't depend on the input, and there is no sorted trie as in an LSH
forest. Candidates are verified on whole sets.

Equal texts are one node. Candidates are linked to the smallest text of their prefix, so a large group costs a link a
member, and the components of these links are verified as a whole: small ones in one go, larger ones by pairs of blocks
of ``BLOCK`` texts, of which only those are formed that hold candidates. A block pair is one matrix product, which gives
counts of links and a spanning forest, never rows of pairs; so every link between different texts is counted, also in a
group of thousands of near copies.

Result: one row per document with ``class_id`` (smallest id of the documents linked to it, directly or not), ``text_id``
(smallest id of the documents with its text), ``n_copies`` (documents with its text) and ``n_links`` (other texts of
similarity 0.8 or more).

Edge cases: texts without words have no shingles and link to nothing, but equal ones are copies; texts of less than five
words are one shingle; null is an empty text; a null id counts as larger than all others; rows that share an id count
each; an empty table gives an empty result. Texts are told apart by a 64-bit hash.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fluora.llm.common import checkpoint, components, cut

SHINGLE, THRESHOLD = 5, 0.8
TREES, LONGEST, TARGET = 16, 8, 0.998
#: Texts in a block; buckets up to SMALL texts are expanded into pairs where their component needs blocks.
BLOCK, SMALL = 256, 64
#: Texts to fetch (below 100 bytes each) that are broadcast at most.
BROADCAST = 500_000
BATCH = 256
_WORD = re.compile(r"[^\x20\x09-\x0D]+")


def recall(depth: int, trees: int = TREES, similarity: float = THRESHOLD) -> float:
    """The chance that a pair shares a prefix of this depth in one of the trees."""
    return 1 - (1 - similarity**depth) ** trees


def depth(target: float = TARGET, trees: int = TREES, longest: int = LONGEST, threshold: float = THRESHOLD) -> int:
    """The longest prefix, shortened until the recall at the threshold reaches the target."""
    k = longest
    while k > 1 and recall(k, trees, threshold) < target:
        k -= 1
    return k


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads them."""
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    return x ^ (x >> np.uint64(29))


class Shingler:
    """Shingle sets of texts; word hashes are kept in a bounded cache."""

    def __init__(self, most: int = 200_000):
        self.cache: dict[str, int] = {}
        self.most = most

    def __call__(self, texts: list[str]) -> list[np.ndarray]:
        import xxhash

        cache, parts = self.cache, [_WORD.findall(t) for t in texts]
        if len(cache) > self.most:
            cache.clear()
        for w in set().union(*parts).difference(cache):
            cache[w] = xxhash.xxh3_64_intdigest(w)
        out = []
        for words in parts:
            h = np.fromiter(map(cache.__getitem__, words), np.uint64, len(words))
            n = max(len(h) - SHINGLE + 1, min(len(h), 1))
            s = np.zeros(n, np.uint64)
            for j in range(min(SHINGLE, len(h))):
                s = mixed(s * np.uint64(31) + h[j : j + n])
            out.append(np.unique(s))
        return out


def prefixes(sets: list[np.ndarray], k: int, trees: int = TREES, seed: int = 2) -> np.ndarray:
    """For each set and tree a 64-bit hash of the tree and its label's first k min-hashes; no set is empty."""
    starts = np.cumsum([0] + [len(s) for s in sets[:-1]])
    every, out = np.concatenate(sets), np.zeros((len(sets), trees), np.uint64)
    rng = np.random.default_rng(seed)
    odd = rng.integers(0, 1 << 63, (trees, LONGEST), dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    for t in range(trees):
        label = np.full(len(sets), t + 1, np.uint64)
        for j in range(k):
            label = mixed(label * np.uint64(31) + np.minimum.reduceat((every ^ odd[t, j]) * odd[t, j] ^ (every >> np.uint64(32)) * odd[t, j - 1], starts))
        out[:, t] = label
    return out


def signatures(docs: DataFrame, k: int) -> DataFrame:
    """(doc_id, tid, prefixes) of docs (doc_id, text); tid is the text's hash, prefixes one hash per tree or null."""

    def run(parts: Iterator) -> Iterator:
        import pyarrow as pa

        shingler = Shingler()
        for part in parts:
            for at in range(0, part.num_rows, BATCH):
                some = part.slice(at, BATCH)
                sets = shingler(some.column(2).to_pylist())
                full = [i for i, s in enumerate(sets) if len(s)]
                labels: list = [None] * len(sets)
                if full:
                    for i, row in zip(full, prefixes([sets[i] for i in full], k).view(np.int64).tolist(), strict=True):
                        labels[i] = row
                yield pa.RecordBatch.from_arrays([some.column(0), some.column(1), pa.array(labels, pa.list_(pa.int64()))], ["doc_id", "tid", "prefixes"])

    rows = docs.select("doc_id", F.xxhash64(F.coalesce("text", F.lit(""))).alias("tid"), F.coalesce("text", F.lit("")).alias("text"))
    return rows.mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, tid long, prefixes array<long>")


def similar(sets: list[np.ndarray], left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Which sets of ``left`` and ``right`` (places in ``sets``) have the similarity: a matrix of booleans."""
    both = np.union1d(left, right)
    where = np.zeros(len(sets), np.int64)
    where[both] = np.arange(len(both))
    sizes = np.array([len(sets[i]) for i in both])
    _, code, count = np.unique(np.concatenate([sets[i] for i in both]), return_inverse=True, return_counts=True)
    row = np.repeat(np.arange(len(both)), sizes)
    shared = count[code] > 1
    row, code = row[shared], code[shared]
    order = np.argsort(code, kind="stable")
    row, code = row[order], np.unique(code[order], return_inverse=True)[1]
    overlap = np.zeros((len(left), len(right)), np.float64)
    for low in range(0, int(code[-1]) + 1 if len(code) else 0, 4096):
        a, b = np.searchsorted(code, [low, low + 4096])
        m = np.zeros((len(both), 4096), np.float32)
        m[row[a:b], code[a:b] - low] = 1
        overlap += m[where[left]] @ m[where[right]].T
    return 9 * overlap >= 4 * (sizes[where[left]][:, None] + sizes[where[right]][None, :])


def _verify(rows: pd.DataFrame) -> pd.DataFrame:
    """Links of all cells in ``rows`` (cell, low, high, tid, block, tokens): (tid, links, to), to = a linked text or null."""
    out = []
    for (_, low, high), cell in rows.groupby(["cell", "low", "high"], sort=True):
        cell = cell.drop_duplicates("tid").sort_values("tid")
        ids, block = cell.tid.to_numpy(), cell.block.to_numpy()
        sets = [np.frombuffer(t, np.uint64) for t in cell.tokens]
        left, right = np.flatnonzero(block == low), np.flatnonzero(block == high)
        if not len(left) or not len(right):
            continue
        hit = similar(sets, left, right)
        if low == high:
            np.fill_diagonal(hit, False)
            links, to = hit.sum(1), hit.argmax(1)
            out.append(pd.DataFrame({"tid": ids[left], "links": links, "to": pd.array(np.where(links > 0, ids[right][to], 0), "Int64")})[links > 0])
            tree = _forest(hit | hit.T)
            out.append(pd.DataFrame({"tid": ids[left][[a for a, _ in tree]], "links": 0, "to": pd.array(ids[left][[b for _, b in tree]], "Int64")}))
        else:
            for x, y, h in ((left, right, hit), (right, left, hit.T)):
                links, to = h.sum(1), h.argmax(1)
                out.append(pd.DataFrame({"tid": ids[x], "links": links, "to": pd.array(np.where(links > 0, ids[y][to], 0), "Int64")})[links > 0])
            n = len(left)
            whole = np.zeros((n + len(right),) * 2, bool)
            whole[:n, n:], whole[n:, :n] = hit, hit.T
            names = np.concatenate([ids[left], ids[right]])
            tree = _forest(whole)
            out.append(pd.DataFrame({"tid": names[[a for a, _ in tree]], "links": 0, "to": pd.array(names[[b for _, b in tree]], "Int64")}))
    empty = pd.DataFrame({"tid": pd.Series(dtype="int64"), "links": pd.Series(dtype="int64"), "to": pd.Series(dtype="Int64")})
    return pd.concat([empty, *out], ignore_index=True)


def _forest(hit: np.ndarray) -> list[tuple[int, int]]:
    """Edges that connect what ``hit`` connects."""
    open_, out = np.ones(len(hit), bool), []
    for root in range(len(hit)):
        if open_[root]:
            open_[root], todo = False, [root]
            while todo:
                a = todo.pop()
                new = np.flatnonzero(hit[a] & open_)
                open_[new] = False
                out += [(a, int(b)) for b in new]
                todo += new.tolist()
    return out


def _cells(shared: DataFrame) -> DataFrame:
    """(cell, low, high, tid, block) that bring all candidates together, from (prefix, tid, least, size)."""
    comps = components(shared.select(F.col("tid").alias("a"), F.col("least").alias("b")))
    sizes = comps.groupBy("comp").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks"))
    texts = checkpoint(comps.join(sizes, "comp").select(F.col("node").alias("tid"), "comp", "blocks", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int").alias("block")))
    alone = texts.where("blocks = 1").select("comp", F.lit(0).alias("low"), F.lit(0).alias("high"), "tid", F.lit(0).alias("block"))
    large = texts.where("blocks > 1")
    # texts of large buckets meet all blocks of their component, others the blocks of their candidates
    hot = shared.where(F.col("size") > SMALL).select("tid").distinct().join(large, "tid")
    wide = hot.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    some = shared.where(F.col("size") <= SMALL).select("prefix", "tid").join(large, "tid")
    met = some.join(some.select("prefix", F.col("tid").alias("tid2"), F.col("block").alias("other")), "prefix").where("tid != tid2")
    cells = wide.select("comp", "tid", "block", "other").unionByName(met.select("comp", "tid", "block", "other"))
    cells = cells.select("comp", F.least("block", "other").alias("low"), F.greatest("block", "other").alias("high"), "tid", "block").distinct()
    return alone.unionByName(cells).withColumnRenamed("comp", "cell")


def linked(docs: DataFrame, target: float = TARGET) -> DataFrame:
    """(doc_id, text_id, n_copies, n_links, class_id) for all rows of docs (doc_id, text)."""
    return classed(docs, target).select("doc_id", "text_id", "n_copies", "n_links", "class_id")


def classed(docs: DataFrame, target: float = TARGET) -> DataFrame:
    """``linked`` with the text's hash tid, and class_tid: the smallest hash of the texts that have the class's smallest id."""
    docs = docs.select("doc_id", "text")
    sigs = cut(signatures(docs, depth(target)))
    texts = sigs.groupBy("tid").agg(F.min("doc_id").alias("text_id"), F.count("*").alias("n_copies"))
    members = sigs.where("prefixes is not null").groupBy("tid").agg(F.first("prefixes").alias("prefixes")).select("tid", F.explode("prefixes").alias("prefix"))
    buckets = members.groupBy("prefix").agg(F.min("tid").alias("least"), F.count("*").alias("size")).where("size > 1")
    shared = cut(members.join(buckets, "prefix"))
    cells = cut(_cells(shared))
    # sets of the texts in cells, read from one document each
    wanted = cells.groupBy("tid").agg(F.collect_list(F.struct("cell", "low", "high", "block")).alias("cells")).join(texts.select("tid", "text_id"), "tid")
    wanted = cut(wanted.withColumnRenamed("tid", "wanted"))
    few = wanted.count() <= BROADCAST
    rows = docs.withColumn("tid", F.xxhash64(F.coalesce("text", F.lit(""))))
    here = F.broadcast(wanted) if few else wanted
    rows = rows.join(here, rows["doc_id"].eqNullSafe(here["text_id"]) & (rows["tid"] == here["wanted"])).select("tid", "text", "cells")

    def tokens(parts: Iterator) -> Iterator:
        import pyarrow as pa

        shingler = Shingler()
        for part in parts:
            for at in range(0, part.num_rows, BATCH):
                some = part.slice(at, BATCH)
                sets = shingler(some.column(1).to_pylist())
                yield pa.RecordBatch.from_arrays([some.column(0), pa.array([s.tobytes() for s in sets], pa.binary()), some.column(2)], ["tid", "tokens", "cells"])

    kind = rows.schema["cells"].dataType.simpleString()
    sets = rows.mapInArrow(tokens, f"tid long, tokens binary, cells {kind}")
    sets = sets.select("tid", "tokens", F.explode("cells").alias("c")).select("tid", "tokens", "c.*")
    groups = max(1, cells.select("cell", "low", "high").distinct().count() // 100)
    lot: Column = F.when(F.col("low") != F.col("high"), F.xxhash64("cell", "low", "high")).otherwise(F.pmod(F.xxhash64("cell", "low", "high"), F.lit(groups)))
    found = cut(sets.groupBy(lot.alias("lot")).applyInPandas(lambda rows: _verify(rows.drop(columns="lot", errors="ignore")), "tid long, links long, to long"))
    classes = components(found.where("to is not null").select(F.col("tid").alias("a"), F.col("to").alias("b")))
    links = found.groupBy("tid").agg(F.sum("links").alias("n_links"))
    known = texts.join(links, "tid", "left").join(classes.withColumnRenamed("node", "tid"), "tid", "left").withColumn("comp", F.coalesce("comp", "tid"))
    least = known.groupBy("comp").agg(F.min(F.struct(F.col("text_id").isNull(), "text_id", "tid")).alias("least"))
    least = least.select("comp", F.col("least.text_id").alias("class_id"), F.col("least.tid").alias("class_tid"))
    known = known.join(least, "comp").select("tid", "text_id", "n_copies", F.coalesce("n_links", F.lit(0)).alias("n_links"), "class_id", "class_tid")
    return sigs.select("doc_id", "tid").join(known, "tid").select("doc_id", "tid", "text_id", "n_copies", "n_links", "class_id", "class_tid")


def op2_ngram_join(spark, sf_dir: str) -> DataFrame:
    """All documents with their class, copies and number of similar texts."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 1024)
    return linked(spark.read.parquet(f"{sf_dir}/documents.parquet"))
