"""Quality rules: base limits on word statistics, then robust multivariate outliers.

Statistics of each text are transformed to a vector. For every pair of language and source, location and scatter are
estimated by minimum covariance determinant: from medians and quartiles on, each step keeps the ``SHARE`` of vectors
nearest in Mahalanobis distance and takes their mean and covariance, which never enlarges the determinant. Documents
beyond ``CUTOFF`` are rejected.

A step is one aggregation of moments by (pair, bin of distance); the nearest bins that hold the share are then merged.
Moments are sums of fixed-point integers, so results don't depend on the order of rows. A vector weighs as many as the
distinct texts that have it, so the estimate is the same at every size of a corpus, and a mass of exact copies doesn't
shrink the scatter; documents that fail the base limits don't count. Texts are told apart by a 64-bit hash. Scatter is shrunk towards fixed spreads with the weight of ``PRIOR`` texts, and has them as a floor in part, so
small groups and constant statistics need no special case.

Edge cases: null and empty texts have no words and fail the base limits; null language or source is a value of its own;
a group without any vector rejects nothing but base failures; an empty table gives an empty result.
"""

from __future__ import annotations

import operator
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fluora.llm.common import checkpoint, cut, fresh, let, small, window_hashes, words

WINDOW = 8
MIN_WORDS, MAX_REPEAT_PERCENT = 20, 30
#: The transformed statistics, and the spread that each has at least in part.
SPREADS = {"length": 1.0, "word": 0.35, "symbols": 0.5, "repeats": 0.1}
#: Share of texts, by their vectors, that the estimate rests on; factor by which their covariance is too small for normal vectors:
#: share / P(chi2 with p + 2 degrees <= the chi2 quantile of the share with p degrees), p = 4.
SHARE, CONSISTENCY = 0.75, 1.486
STEPS, PRIOR, FLOOR = 8, 50, 0.5
#: Squared distance: the chi2 quantile with 4 degrees that one in a hundred million normal vectors passes.
CUTOFF = 43.07
FIXED = 1024
NAMES = list(SPREADS)
P = len(NAMES)


def repeated(w: Column) -> Column:
    """How many words lie in windows of 8 that the text has twice or more."""

    def total(hashes: Column) -> Column:
        pairs = F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        twice = let(pairs, lambda s: F.filter(F.zip_with(s, F.slice(s, 2, F.size(s)), lambda a, b: F.when(a["h"] == b["h"], F.array(a["i"], b["i"]))), lambda x: x.isNotNull()))
        places = F.sort_array(F.array_distinct(F.flatten(twice)))
        start = F.struct(F.lit(-WINDOW).alias("last"), F.lit(0).alias("n"))
        return F.aggregate(places, start, lambda acc, i: F.struct(i.alias("last"), (acc["n"] + F.least(F.lit(WINDOW), i - acc["last"])).alias("n")), lambda acc: acc["n"])

    found = let(window_hashes(w, WINDOW), lambda h: F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0)).otherwise(total(h)))
    return F.when(F.size(w) > WINDOW, found).otherwise(F.lit(0))


def statistics(docs: DataFrame, keep: list[str]) -> DataFrame:
    """``keep`` with key, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, text_hash, base_failed and the vector z_*.

    Computed once, in the shared folder: the counts of a text come out of one expression over its words.
    """
    t = F.coalesce("text", F.lit(""))
    lines = F.filter(F.split(t, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    counts = let(words("text"), lambda w: F.struct(F.size(w).alias("n_words"), F.length(F.array_join(w, "")).alias("word_chars"), repeated(w).alias("n_repeat_words")))
    counted = cut(docs.select(
        *keep,
        group_key().alias("key"),
        F.xxhash64(t).alias("text_hash"),
        counts.alias("counts"),
        (F.length(t) - F.length(F.regexp_replace(t, "[#*$%&|<>]+", ""))).cast("long").alias("n_symbols"),
        let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines"),
    ))
    out = counted.select(*keep, "key", "text_hash", "n_symbols", "n_dup_lines", *[F.col(f"counts.{c}").cast("long").alias(c) for c in ("n_words", "word_chars", "n_repeat_words")])
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))
    return out.withColumn("base_failed", failed).select("*", *vector())


def group_key() -> Column:
    part = lambda c: F.coalesce(F.concat(F.length(c).cast("string"), F.lit(":"), F.col(c)), F.lit("-"))
    return F.concat(part("lang"), F.lit("/"), part("source"))


def vector() -> list[Column]:
    """The transformed statistics in fixed point."""
    n = F.greatest(F.col("n_words"), F.lit(1)).cast("double")
    values = [F.log1p(n), F.col("word_chars") / n, F.log1p(100 * F.col("n_symbols") / n), F.sqrt(F.col("n_repeat_words") / n)]
    return [F.round(v * FIXED).cast("long").alias(f"z_{k}") for v, k in zip(values, NAMES, strict=True)]


def _distance() -> Column:
    """Squared Mahalanobis distance of z by forward substitution with the Cholesky factor l_i_j around m_i."""
    y: list[Column] = []
    for i, k in enumerate(NAMES):
        rest = F.col(f"z_{k}") / FIXED - F.col(f"m_{i}")
        for j in range(i):
            rest = rest - F.col(f"l_{i}_{j}") * y[j]
        y.append(rest / F.col(f"l_{i}_{i}"))
    return reduce(operator.add, [v * v for v in y])


def _factor(df: DataFrame, n: Column, mean: list[Column], cov) -> DataFrame:
    """(key, m_i, l_i_j) from moments: shrunk scatter with a floor, and its Cholesky factor column by column."""
    spreads = list(SPREADS.values())
    s = lambda i, j: (n * CONSISTENCY * cov(i, j) + (PRIOR * spreads[i] ** 2 if i == j else 0.0)) / (n + PRIOR) + (FLOOR * spreads[i] ** 2 if i == j else 0.0)
    out = df.select("key", *[m.alias(f"m_{i}") for i, m in enumerate(mean)], *[s(i, j).alias(f"s_{i}_{j}") for i in range(P) for j in range(i + 1)])
    for j in range(P):
        inner = F.col(f"s_{j}_{j}") - reduce(operator.add, [F.col(f"l_{j}_{k}") ** 2 for k in range(j)], F.lit(0.0))
        out = out.withColumn(f"l_{j}_{j}", F.sqrt(inner))
        for i in range(j + 1, P):
            rest = F.col(f"s_{i}_{j}") - reduce(operator.add, [F.col(f"l_{i}_{k}") * F.col(f"l_{j}_{k}") for k in range(j)], F.lit(0.0))
            out = out.withColumn(f"l_{i}_{j}", rest / F.col(f"l_{j}_{j}"))
    return out.drop(*[f"s_{i}_{j}" for i in range(P) for j in range(i + 1)])


def estimate(stats: DataFrame, steps: int = STEPS) -> DataFrame:
    """Location and Cholesky factor for each key of ``stats`` (key, text_hash, z_*, base_failed)."""
    z = [f"z_{k}" for k in NAMES]
    texts = stats.where("not base_failed").select("key", "text_hash", *z).distinct()
    vectors = cut(texts.groupBy("key", *z).agg(F.count("*").alias("weight")))
    quart = vectors.groupBy("key").agg(*[F.percentile(c, [0.25, 0.5, 0.75], F.col("weight")).alias(c) for c in z])
    spread = [F.greatest((F.col(c)[2] - F.col(c)[0]) / FIXED / 1.349, F.lit(0.0)) for c in z]
    model = checkpoint(_factor(quart, F.lit(1000.0), [F.col(c)[1] / FIXED for c in z], lambda i, j: spread[i] ** 2 if i == j else F.lit(0.0)))
    cells = [(i, j) for i in range(P) for j in range(i + 1)]
    product = lambda i, j: (F.col(z[i]) * F.col(z[j])).cast("decimal(24,0)") * F.col("weight").cast("decimal(12,0)")
    for _ in range(steps):
        near = vectors.join(small(model), "key").withColumn("bin", F.floor(8 * F.log2(_distance() + 2.0**-10)).cast("int"))
        bins = near.groupBy("key", "bin").agg(F.sum("weight").alias("n"), *[F.sum(F.col(c) * F.col("weight")).alias(f"a_{i}") for i, c in enumerate(z)], *[F.sum(product(i, j)).alias(f"b_{i}_{j}") for i, j in cells])
        before = F.coalesce(F.sum("n").over(Window.partitionBy("key").orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        bins = bins.withColumn("before", before).withColumn("all", F.sum("n").over(Window.partitionBy("key")))
        kept = bins.where(F.col("before") < SHARE * F.col("all")).groupBy("key").agg(F.sum("n").cast("double").alias("n"), *[F.sum(f"a_{i}").cast("double").alias(f"a_{i}") for i in range(P)], *[F.sum(f"b_{i}_{j}").cast("double").alias(f"b_{i}_{j}") for i, j in cells])
        mean = [F.col(f"a_{i}") / F.col("n") / FIXED for i in range(P)]
        cov = lambda i, j, mean=mean: F.col(f"b_{i}_{j}") / F.col("n") / FIXED**2 - mean[i] * mean[j]
        model = checkpoint(_factor(kept, F.col("n"), mean, cov))
    return model


def judged(docs: DataFrame, keep: list[str]) -> DataFrame:
    """The columns ``keep`` of all documents with statistics, base_failed, distance and kept; docs has text, lang, source."""
    stats = statistics(docs, keep)
    model = small(estimate(stats))
    out = stats.join(model, "key", "left").withColumn("distance", _distance())
    return out.withColumn("kept", ~F.col("base_failed") & F.coalesce(F.col("distance") <= CUTOFF, F.lit(True)))


def filtered(docs: DataFrame) -> DataFrame:
    """The documents that the rules keep, with the columns of ``docs``."""
    names = docs.columns
    row = fresh(names, "row")
    packed = docs.select(F.struct(*[docs[c] for c in names]).alias(row), "text", "lang", "source")
    return judged(packed, [row]).where("kept").select(f"{row}.*")


def op8_quality(spark, sf_dir: str) -> DataFrame:
    """Statistics and verdict of all documents."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang", "source")
    return judged(docs, ["doc_id"]).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "distance")
