"""Mixing sources to target weights by entropy balancing.

Each document gets a rate, the expected number of its copies. Among all rates that reach the token targets of every
source and stay at or below ``cap``, the ones nearest to 1 in relative entropy are ``min(cap, exp(l * size))``; ``l`` is
the source's dual variable. The dual is convex, and all its variables are found together by Newton steps inside
brackets; a step is one aggregation over a table of (source, size, count). Rates are rounded to copies by a seeded
number for each document plus one shift for each source, chosen so that the copies' tokens meet the target.

Sums are made of integers, so results don't depend on the order of rows or on partitions.

Edge cases: a null source is a source of its own, sorted last; documents of size 0 count nothing and take nothing; a
source whose target is ``cap`` times its size has every document ``cap`` times; rows equal in id, source and text are
counted and numbered, so that the mix can take some of them (``mix``, which has to find its rows again, takes all of them
equally often); an empty table gives an empty result.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fluora.llm.common import checkpoint, cut, fresh, small, uniform, words

#: Newton steps at most; brackets shrink in every one.
STEPS = 60
#: A source is done if its expected tokens are within this share of the target; rounding removes the rest.
TOLERANCE = 1e-3
#: Fixed-point units of a copy in the rounding codes, and of a token in the sums.
UNIT, FINE = 1 << 22, 4096


def source_key(source: Column | str) -> Column:
    """A non-null key that sorts by code point with null last."""
    col = F.col(source) if isinstance(source, str) else source
    return F.coalesce(F.concat(F.lit("a"), col.cast("string")), F.lit("b"))


def targets(totals: DataFrame, weights=(5, 2, 1), share: float = 1.5, cap: float = 2.0) -> DataFrame:
    """Adds ``target`` to (key, total): shares by weight, none above ``cap`` times its total, the excess reshared.

    The repeated resharing ends at ``min(cap * total, weight * level)`` for one level, found from running sums. There is
    one row per source.
    """
    by_key = Window.orderBy("key")
    nth = F.row_number().over(by_key) - 1
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (nth % len(weights) + 1).cast("int"))
    t = totals.withColumn("weight", weight).withColumn("bound", F.lit(cap) * F.col("total"))
    order = Window.orderBy(F.col("bound") / F.col("weight"), "key")
    before, after = order.rowsBetween(Window.unboundedPreceding, -1), order.rowsBetween(0, Window.unboundedFollowing)
    whole = Window.partitionBy()
    t = t.withColumn("left", F.lit(share) * F.sum("total").over(whole) - F.coalesce(F.sum("bound").over(before), F.lit(0.0)))
    t = t.withColumn("level", F.col("left") / F.sum("weight").over(after))
    fits = F.when(F.col("level") * F.col("weight") <= F.col("bound"), F.struct(F.col("bound") / F.col("weight"), "key", "level"))
    t = t.withColumn("level", F.min(fits).over(whole)["level"])
    return t.select("key", "total", F.least("bound", F.coalesce(F.col("weight") * F.col("level"), F.col("bound"))).alias("target"))


def rate(lam: Column, size: Column, cap: float) -> Column:
    return F.least(F.lit(float(cap)), F.exp(F.least(lam * size, F.lit(math.log(cap) + 1))))


def _tokens(value: Column) -> Column:
    """A sum of token counts in fixed point, which doesn't depend on the order of rows."""
    return F.sum((value * FINE).cast("decimal(28,0)")).cast("double") / FINE


def fit(sized: DataFrame, goals: DataFrame, cap: int = 2, seed: int = 17) -> DataFrame:
    """Finds (key, total, target, lam, threshold) for each source of ``sized`` (doc_id, key, size, tie).

    ``goals`` has (key, total, target). ``threshold`` is the rounding code under which a copy is taken.
    """
    hist = checkpoint(sized.where("size > 0").groupBy("key", "size").agg(F.count("*").alias("n")))
    x = F.col("size").cast("double")
    shape = hist.groupBy("key").agg(F.min("size").alias("least"), (_tokens(x * x * F.col("n")) / F.sum(F.col("size") * F.col("n"))).alias("mean"))
    state = goals.join(shape, "key", "left").select(
        "*",
        (F.log(F.col("target") / F.col("total")) / F.col("least")).alias("low"),
        (F.lit(math.log(cap)) / F.col("least")).alias("high"),
    ).withColumn("low", F.least("low", F.lit(0.0)))
    state = state.withColumn("open", F.coalesce((F.col("target") > 0) & (F.col("target") < F.col("total") * cap), F.lit(False)))
    state = checkpoint(state.withColumn("lam", F.round(F.greatest("low", F.least("high", F.log(F.col("target") / F.col("total")) / F.col("mean"))), 12)))
    kept = state.columns
    for _ in range(STEPS):
        if state.where("open").isEmpty():
            break
        r = rate(F.col("lam"), x, cap)
        step = hist.join(state.where("open"), "key").groupBy(*kept).agg(
            _tokens(x * r * F.col("n")).alias("got"),
            _tokens(F.when(r < cap, x * x * r).otherwise(0.0) * F.col("n")).alias("slope"),
        )
        step = step.withColumn("low", F.when(F.col("got") <= F.col("target"), F.col("lam")).otherwise(F.col("low")))
        step = step.withColumn("high", F.when(F.col("got") > F.col("target"), F.col("lam")).otherwise(F.col("high")))
        newton = F.col("lam") + F.try_divide(F.col("target") - F.col("got"), F.col("slope"))
        step = step.withColumn("done", (F.abs(F.col("got") - F.col("target")) <= TOLERANCE * F.col("target")) | (F.col("high") - F.col("low") <= 2e-12))
        step = step.withColumn("lam", F.when(F.col("done"), F.col("lam")).when((newton > F.col("low")) & (newton < F.col("high")), F.round(newton, 12)).otherwise(F.round((F.col("low") + F.col("high")) / 2, 12)))
        step = step.withColumn("open", ~F.col("done")).select(*kept)
        state = checkpoint(state.where("not open").unionByName(step))
    model = state.select("key", "total", "target", "lam")
    first = _edge(sized, model, None, cap, seed)
    return checkpoint(_edge(sized, checkpoint(first), 12, cap, seed).withColumn("threshold", F.coalesce("threshold", F.lit(0).cast("long"))))


def _codes(cap: int, seed: int) -> Column:
    """Codes of the shifts at which a document gains its copies: j - rate - a seeded number, in fixed point."""
    first = ((1 + cap - rate(F.col("lam"), F.col("size").cast("double"), cap) - uniform(F.col("doc_id"), F.col("size"), F.col("tie"), seed=seed)) * UNIT).cast("long")
    return F.array(*[first + F.lit(j * UNIT).cast("long") for j in range(cap)])


def _edge(sized: DataFrame, model: DataFrame, bits: int | None, cap: int, seed: int) -> DataFrame:
    """Narrows the threshold: the code whose smaller codes hold the tokens that the target asks for.

    The first call (``bits`` None) tells apart units of 4096 codes, the second the codes within the chosen unit. A
    source has at most (2 * cap + 1) * 1024 units and 4096 codes in one, so the windows below are bounded.
    """
    model = small(model)
    rows = sized.where("size > 0").join(model, "key").withColumn("code", F.explode(_codes(cap, seed)))
    if bits is None:
        rows, had = rows.withColumn("bin", F.shiftright("code", 12)), F.lit(0).cast("long")
    else:
        rows = rows.where(F.shiftright("code", bits) == F.shiftright("threshold", bits)).withColumn("bin", F.col("code"))
        had = F.col("had")
    bins = rows.groupBy("key", "bin").agg(F.sum("size").alias("mass"))
    upto = F.sum("mass").over(Window.partitionBy("key").orderBy("bin"))
    bins = bins.join(model, "key").withColumn("upto", upto + had).withColumn("under", F.col("upto") - F.col("mass"))
    if bits is None:
        pick = bins.where(F.col("under") <= F.col("target")).groupBy("key").agg(F.max(F.struct("bin", "under")).alias("m"))
        pick = pick.select("key", F.shiftleft(F.col("m.bin"), 12).alias("threshold"), F.col("m.under").alias("had"))
    else:
        # the nearer one of the edges below and above each code
        near = F.min(F.least(F.struct(F.abs(F.col("under") - F.col("target")).alias("d"), F.col("bin").alias("at")), F.struct(F.abs(F.col("upto") - F.col("target")).alias("d"), (F.col("bin") + 1).alias("at")))).alias("m")
        pick = bins.groupBy("key").agg(near).select("key", F.col("m.at").alias("threshold"))
    kept = [c for c in model.columns if c not in ("threshold", "had")]
    return model.select(*kept).join(pick, "key", "left")


def copies(cap: int = 2, seed: int = 17) -> Column:
    """The number of copies of a row that has doc_id, size, tie and its source's lam, threshold, total and target."""
    under = F.size(F.filter(_codes(cap, seed), lambda c: c < F.col("threshold")))
    return F.when(F.col("target") >= F.col("total") * cap, F.lit(cap)).otherwise(F.coalesce(under, F.lit(0)))


def sized(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """(doc_id, key, size, tie) of all documents, computed once; ``tie`` is the text's hash and tells rows of one id apart."""
    return cut(docs.select(F.col(doc_id).alias("doc_id"), source_key(source).alias("key"), F.size(words(text)).cast("long").alias("size"), F.xxhash64(F.col(text)).alias("tie")))


def numbered(rows: DataFrame) -> DataFrame:
    """The same rows with ties that differ among equal ones, by their number; equal rows meet as a count, not in one task."""
    counts = rows.groupBy(*rows.columns).agg(F.count("*").alias("n"))
    nth = counts.withColumn("nth", F.explode(F.sequence(F.lit(1).cast("long"), "n")))
    return cut(nth.withColumn("tie", F.when(F.col("nth") > 1, F.xxhash64("tie", "nth")).otherwise(F.col("tie"))).select(*rows.columns))


def plan(rows: DataFrame, weights=(5, 2, 1), share: float = 1.5, cap: int = 2, seed: int = 17) -> DataFrame:
    """The fitted mix of ``rows`` (doc_id, key, size, tie): one row per source."""
    totals = rows.groupBy("key").agg(F.sum("size").alias("total"))
    return fit(rows, checkpoint(targets(totals, weights, share, float(cap))), cap, seed)


def apply(rows: DataFrame, model: DataFrame, cap: int = 2, seed: int = 17) -> DataFrame:
    """Adds total, target, lam, rate and copies to rows that have doc_id, key, size and tie."""
    out = rows.join(small(model), "key")
    rates = F.when(F.col("target") >= F.col("total") * cap, F.lit(float(cap))).otherwise(rate(F.col("lam"), F.col("size").cast("double"), cap))
    return out.withColumn("copies", copies(cap, seed)).withColumn("rate", rates)


def mix(docs: DataFrame, weights=(5, 2, 1), share: float = 1.5, cap: int = 2, seed: int = 17) -> DataFrame:
    """The mixed documents: every row as often as its copies say, with the columns of ``docs``."""
    model = plan(sized(docs), weights, share, cap, seed)
    row = fresh(docs.columns, "row")
    rows = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias(row), F.col("doc_id"), source_key("source").alias("key"), F.size(words("text")).cast("long").alias("size"), F.xxhash64("text").alias("tie"))
    taken = apply(rows, model, cap, seed).where("copies > 0")
    return taken.select(row, F.explode(F.array_repeat(F.lit(0), F.col("copies")))).select(f"{row}.*")


def op1_mixing(spark, sf_dir: str) -> DataFrame:
    """Mixes all documents; one row per document with the words that the mix takes of it."""
    rows = numbered(sized(spark.read.parquet(f"{sf_dir}/documents.parquet")))
    out = apply(rows, plan(rows))
    return out.select("doc_id", "size", F.col("total").alias("source_size"), "target", (F.col("size") * F.col("copies")).alias("taken"), "copies", "rate")
