"""Helpers that several operators share: word splitting and hashing, size-checked broadcasts, components; and those of the shared folder."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fluora.functions.shared import checkpoint, cut, drop, noted, shared_dir

__all__ = ["checkpoint", "components", "cut", "drop", "fresh", "let", "noted", "shared_dir", "small", "uniform", "window_hashes", "words"]

#: Word separators besides the space: the control characters tab to carriage return.
GAPS = "\t\n\x0b\x0c\r"
#: Most rows of a per-group parameter table that are broadcast (each row is below 1 KB).
BROADCAST_ROWS = 10_000


def words(text: Column | str) -> Column:
    """The words ``[^\\x20\\x09-\\x0D]+`` of a text in order; none for null.

    All separators become spaces first, as splitting at one plain character needs no regular expression.
    """
    col = F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit(""))
    for gap in GAPS:
        col = F.replace(col, F.lit(gap), F.lit(" "))
    return F.array_remove(F.split(col, " "), "")


def small(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """The (already computed) table with a broadcast hint if it has at most ``rows`` rows, else as it is."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def fresh(taken: list[str], name: str) -> str:
    """A column name that ``taken`` doesn't hold in any letter case."""
    low = {t.lower() for t in taken}
    while name.lower() in low:
        name = "_" + name
    return name


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with the value computed once for a row, also where ``use`` has lambdas."""
    return F.transform(F.array(value), use)[0]


def window_hashes(w: Column, k: int) -> Column:
    """A 64-bit hash of every window of k words; one window at least, so test the number of words first."""
    starts = F.sequence(F.lit(0), F.greatest(F.lit(0), F.size(w) - k))
    return F.transform(starts, lambda i: F.xxhash64(*[F.get(w, i + j) for j in range(k)]))


def uniform(*cols: Column | str, seed: int) -> Column:
    """A number in [0, 1) that depends on the values and the seed only."""
    return F.shiftrightunsigned(F.xxhash64(F.lit(seed), *cols), 11) / F.lit(float(1 << 53))


def components(edges: DataFrame) -> DataFrame:
    """(node, comp) of the undirected graph of (a, b): comp is the smallest node that can be reached.

    Each round points nodes to their smallest neighbour, follows pointers to their ends and merges nodes that end at the
    same one: edges within a merged node go, so a large group costs one pass over its edges.
    """
    one = edges.select("a", "b").where("a != b")
    one = checkpoint(one.unionByName(one.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    labels = one.select(F.col("a").alias("node"), F.col("a").alias("comp")).distinct()
    while not one.isEmpty():
        points = checkpoint(one.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("b")).select("node", F.least("node", "b").alias("to")))
        while True:  # follow pointers to their ends; each turn doubles the way
            far = points.select(F.col("node").alias("to"), F.col("to").alias("far"))
            jumped = checkpoint(points.join(far, "to").select("node", F.col("far").alias("to"), (F.col("far") < F.col("to")).alias("moved")))
            points = jumped.select("node", "to")
            if jumped.where("moved").isEmpty():
                break
        labels = checkpoint(labels.join(points.select(F.col("node").alias("comp"), "to"), "comp", "left").select("node", F.coalesce("to", "comp").alias("comp")))
        ends = one.join(points.select(F.col("node").alias("a"), F.col("to").alias("a2")), "a").join(points.select(F.col("node").alias("b"), F.col("to").alias("b2")), "b")
        one = checkpoint(ends.select(F.col("a2").alias("a"), F.col("b2").alias("b")).where("a != b").distinct())
    return labels
