"""The queries of the library on the driver's tables, and SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fluora.functions import columns
from fluora.operators import association, cells, filters, graph, imaging, inpainting, previews, registration, segmentation, spikes, tiles, traces
from fluora.sources import sinks, tables

BINS, DIGITS = 8, 6
Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}
_SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def keep(f: Query) -> Query:
        _QUERIES[f.__name__] = f
        if sql is not None:
            _SQL[f.__name__] = sql
        return f

    return keep


def queries() -> dict[str, Query]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)


def r(col: str, digits: int = 6) -> Column:
    """Rounded, with the sign of zero removed."""
    return (F.round(col, digits) + F.lit(0.0)).alias(col)


T1 = "t AS (SELECT user_id AS trace, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS frame, value AS y FROM events)"
T2 = "t AS (SELECT event_type AS trace, row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) - 1 AS frame, value AS y FROM events)"
T3 = "t AS (SELECT vec_id AS trace, generate_subscripts(embedding, 1) - 1 AS frame, unnest(embedding)::DOUBLE AS y FROM embeddings)"
PX = "px AS (SELECT vec_id AS frame, generate_subscripts(embedding, 1) - 1 AS pixel, unnest(embedding)::DOUBLE AS v FROM embeddings)"


def robust_sql(k: float) -> str:
    return f"""b AS (SELECT trace, median(y) AS baseline, stddev_pop(y) AS sd FROM t GROUP BY trace),
d AS (SELECT t.trace, median(abs(y - baseline)) AS mad FROM t JOIN b USING (trace) GROUP BY t.trace),
lim AS (SELECT b.trace, baseline, CASE WHEN 1.4826 * mad > 0 THEN 1.4826 * mad ELSE sd END AS sigma,
  baseline + {k} * (CASE WHEN 1.4826 * mad > 0 THEN 1.4826 * mad ELSE sd END) AS threshold FROM b JOIN d USING (trace))"""


RUNS = """up AS (SELECT trace, frame FROM t JOIN lim USING (trace) WHERE y > threshold),
isl AS (SELECT trace, frame - row_number() OVER (PARTITION BY trace ORDER BY frame) AS island FROM up),
len AS (SELECT trace, island, count(*) AS n FROM isl GROUP BY 1, 2),
runs AS (SELECT lim.trace, threshold, coalesce(max(n), 0)::BIGINT AS longest FROM lim LEFT JOIN len USING (trace) GROUP BY 1, 2)"""


@query(f"WITH {T1}, {robust_sql(2.5)}, {RUNS} SELECT trace, longest, round(threshold, 8) AS threshold FROM runs WHERE longest >= 2")
def active_traces(spark, sf_dir):
    """Flagship: traces that stay above their robust threshold for two frames."""
    return traces.active(tables.event_traces(spark, sf_dir), 2.5, 2).select("trace", "longest", r("threshold", 8))


@query(f"WITH {T1}, {robust_sql(2.5)} SELECT trace, round(baseline, 8) AS baseline, round(sigma, 8) AS sigma, round(threshold, 8) AS threshold FROM lim")
def robust_threshold(spark, sf_dir):
    return traces.robust(tables.event_traces(spark, sf_dir), 2.5).select("trace", r("baseline", 8), r("sigma", 8), r("threshold", 8))


@query(f"WITH {T2}, {robust_sql(1.0)}, {RUNS} SELECT trace, longest FROM runs")
def longest_run(spark, sf_dir):
    rows = tables.event_traces(spark, sf_dir, "event_type")
    return traces.longest_runs(rows, traces.robust(rows, 1.0)).select("trace", "longest")


GAPS = "g AS (SELECT trace, frame, CASE WHEN frame % 7 = 3 OR frame % 11 < 2 THEN NULL ELSE y END AS y FROM t)"


def gappy(rows: DataFrame) -> DataFrame:
    return rows.withColumn("y", F.when((F.col("frame") % 7 != 3) & (F.col("frame") % 11 >= 2), F.col("y")))


@query(f"""WITH {T1}, {GAPS}, w AS (SELECT *, max(CASE WHEN y IS NOT NULL THEN frame END) OVER (PARTITION BY trace ORDER BY frame ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS fa,
min(CASE WHEN y IS NOT NULL THEN frame END) OVER (PARTITION BY trace ORDER BY frame ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS fb FROM g)
SELECT w.trace, w.frame, round(CASE WHEN w.y IS NOT NULL THEN w.y WHEN fa IS NULL THEN b.y WHEN fb IS NULL THEN a.y ELSE a.y + (w.frame - fa) * (b.y - a.y) / (fb - fa) END, 8) AS filled
FROM w LEFT JOIN g a ON a.trace = w.trace AND a.frame = fa LEFT JOIN g b ON b.trace = w.trace AND b.frame = fb""")
def gap_filled(spark, sf_dir):
    return traces.gap_filled(gappy(tables.event_traces(spark, sf_dir))).select("trace", "frame", r("filled", 8))


@query(f"WITH {T1}, s AS (SELECT trace, avg(y) AS m, stddev_samp(y) AS s FROM t GROUP BY 1) SELECT trace, frame, round(CASE WHEN s > 0 THEN (y - m) / s ELSE y END, 6) AS z FROM t JOIN s USING (trace)")
def zscore_traces(spark, sf_dir):
    return traces.zscored(tables.event_traces(spark, sf_dir)).select("trace", "frame", r("z"))


@query(f"""WITH {T2}, n AS (SELECT trace, count(*) AS n FROM t GROUP BY 1), i AS (SELECT unnest(range(0, 800)) AS i),
p AS (SELECT DISTINCT trace, CASE WHEN n <= 800 THEN -1 ELSE (i * (n - 1)) // 799 END AS frame FROM n CROSS JOIN i)
SELECT t.trace, t.frame, y FROM t JOIN n USING (trace) WHERE n <= 800 OR EXISTS (SELECT 1 FROM p WHERE p.trace = t.trace AND p.frame = t.frame)""")
def decimated_traces(spark, sf_dir):
    return traces.decimated(tables.event_traces(spark, sf_dir, "event_type")).select("trace", "frame", "y")


@query(f"WITH {T1} SELECT a.trace, a.frame, round(median(b.y), 6) AS median FROM t a JOIN t b ON a.trace = b.trace AND b.frame BETWEEN a.frame - 3 AND a.frame + 3 GROUP BY 1, 2")
def sliding_median(spark, sf_dir):
    return traces.sliding_median(tables.event_traces(spark, sf_dir), 7).select("trace", "frame", r("median"))


@query(f"WITH {PX} SELECT frame, (pixel // 8 + 1)::INT AS roi_id, round(max(v), 6) AS max, round(avg(v), 6) AS mean, round(stddev_pop(v), 6) AS std, round(sum(v), 6) AS int FROM px GROUP BY 1, 2")
def roi_metrics(spark, sf_dir):
    out = imaging.roi_metrics(tables.vector_frames(spark, sf_dir), tables.block_masks(spark))
    return out.select("frame", "roi_id", r("max"), r("mean"), r("std"), r("int"))


@query(f"WITH {PX} SELECT pixel::INT AS pixel, round(avg(v), 6) AS mean, round(max(v), 6) AS max, round(stddev_pop(v), 6) AS std FROM px GROUP BY 1")
def projection_mean_max_std(spark, sf_dir):
    return imaging.projection(tables.vector_frames(spark, sf_dir)).select("pixel", r("mean"), r("max"), r("std"))


@query(f"""WITH {PX}, p AS (SELECT pixel::INT AS pixel, max(v) AS m FROM px GROUP BY 1), s AS (SELECT min(m) AS lo, max(m) AS hi FROM p)
SELECT pixel, floor(CASE WHEN hi > lo THEN (m - lo) / (hi - lo) * 255 ELSE 0 END)::INT AS u8 FROM p, s""")
def projection_u8(spark, sf_dir):
    return imaging.to_u8(imaging.projection(tables.vector_frames(spark, sf_dir)), "max")


@query(f"WITH {PX} SELECT pixel::INT AS pixel, round(median(v), 6) AS median FROM px GROUP BY 1")
def global_median(spark, sf_dir):
    return imaging.median_background(tables.vector_frames(spark, sf_dir)).select("pixel", r("median"))


@query(f"""WITH {PX}, m AS (SELECT pixel, median(v) AS m FROM px GROUP BY 1), d AS (SELECT frame, abs(v - m) AS d FROM px JOIN m USING (pixel)),
l AS (SELECT frame, avg(d) + 2.0 * greatest(stddev_pop(d), 1e-6) AS l FROM d GROUP BY 1)
SELECT frame, sum(CASE WHEN d > l THEN 1 ELSE 0 END)::BIGINT AS n FROM d JOIN l USING (frame) GROUP BY 1""")
def frame_outliers(spark, sf_dir):
    return imaging.outlier_pixels(tables.vector_frames(spark, sf_dir), 2.0)


RECTS = """WITH s AS (SELECT s_suppkey AS id, (s_suppkey * 7) % 40 - 4 AS x, (s_suppkey * 5) % 30 - 3 AS y, 1 + s_suppkey % 9 AS w, 1 + s_suppkey % 6 AS h FROM supplier),
g AS (SELECT a.range AS px, b.range AS py FROM range(32) a CROSS JOIN range(24) b),
m AS (SELECT id AS roi_id, (py * 32 + px)::INT AS pixel FROM s JOIN g ON px >= x AND px < x + w AND py >= y AND py < y + h)"""


@query(f"{RECTS} SELECT roi_id, pixel FROM m")
def rect_masks(spark, sf_dir):
    s, k = spark.read.parquet(f"{sf_dir}/supplier.parquet"), F.col("s_suppkey")
    rois = s.select(k.alias("roi_id"), (k * 7 % 40 - 4).alias("left"), (k * 5 % 30 - 3).alias("top"), (1 + k % 9).alias("width"), (1 + k % 6).alias("height"))
    return imaging.rect_pixels(rois, 24, 32).select("roi_id", F.col("pixel").cast("int").alias("pixel"))


@query(f"{RECTS} SELECT DISTINCT pixel FROM m")
def mask_union(spark, sf_dir):
    return imaging.mask_union(rect_masks(spark, sf_dir))


@query(f"{RECTS} SELECT DISTINCT pixel FROM m WHERE roi_id % 2 = 1 AND pixel NOT IN (SELECT pixel FROM m WHERE roi_id % 2 = 0)")
def mask_difference(spark, sf_dir):
    """Pixels of regions of odd number that no region of even number has."""
    masks = rect_masks(spark, sf_dir)
    return imaging.mask_difference(masks.where("roi_id % 2 = 1"), masks.where("roi_id % 2 = 0"))


CORNERS = """p AS (SELECT s_suppkey AS id, (s_suppkey * 7) % 20 + 0.5 AS x, (s_suppkey * 5) % 14 + 0.5 AS y, 2 + s_suppkey % 7 AS a FROM supplier),
c AS (SELECT id, CASE WHEN id % 2 = 0 THEN x + a / 3 ELSE x + a / 2 END AS x, CASE WHEN id % 2 = 0 THEN y + a / 3 ELSE y + a / 2 END AS y FROM p)"""


@query(f"WITH {CORNERS} SELECT id AS roi_id, round(x, 6) AS x, round(y, 6) AS y FROM c")
def roi_centroids(spark, sf_dir):
    """Centres of triangles (even numbers) and boxes."""
    s, k = spark.read.parquet(f"{sf_dir}/supplier.parquet"), F.col("s_suppkey")
    x, y, a = (k * 7 % 20 + 0.5).cast("double"), (k * 5 % 14 + 0.5).cast("double"), (2 + k % 7).cast("double")
    three = lambda *v: F.when(k % 2 == 0, F.array(*v)).otherwise(F.array().cast("array<double>"))
    rois = s.select(k.alias("roi_id"), three(x, x + a, x).alias("xs"), three(y, y, y + a).alias("ys"), x.alias("left"), y.alias("top"), a.alias("width"), a.alias("height"))
    return imaging.centroids(rois).select("roi_id", r("x"), r("y"))


@query(f"WITH {CORNERS} SELECT id AS roi_id, row_number() OVER (ORDER BY round(y, 6), round(x, 6), id)::INT AS ord FROM c")
def reading_order(spark, sf_dir):
    return imaging.reading_order(roi_centroids(spark, sf_dir)).select("roi_id", "ord")


@query("SELECT (p_partkey - 1)::BIGINT AS frame, (sum(p_partkey * 7 % 5 - 2) OVER w)::BIGINT AS dy, (sum(p_partkey * 3 % 7 - 3) OVER w)::BIGINT AS dx FROM part WINDOW w AS (ORDER BY p_partkey)")
def summed_steps(spark, sf_dir):
    k = F.col("p_partkey")
    return imaging.summed_steps(spark.read.parquet(f"{sf_dir}/part.parquet").select((k - 1).cast("long").alias("frame"), (k * 7 % 5 - 2).alias("dy"), (k * 3 % 7 - 3).alias("dx")))


@query(f"WITH {PX} SELECT frame, pixel::INT AS pixel, round(v, 6) AS v, round(median(v) OVER (PARTITION BY pixel ORDER BY frame ROWS BETWEEN 3 PRECEDING AND 3 FOLLOWING), 6) AS median FROM px")
def windowed_background(spark, sf_dir):
    return imaging.with_background(tables.vector_frames(spark, sf_dir), 7).select("frame", "pixel", r("v"), r("median"))


@query("""WITH s AS (SELECT s_suppkey AS id, (s_suppkey * 7) % 20 + 0.5 AS x, (s_suppkey * 5) % 14 + 0.5 AS y, 2 + s_suppkey % 7 AS a FROM supplier),
g AS (SELECT p.range AS px, q.range AS py FROM range(32) p CROSS JOIN range(24) q)
SELECT id AS roi_id, (py * 32 + px)::INT AS pixel FROM s JOIN g ON px > x AND py > y AND (px - x) + (py - y) < a""")
def polygon_masks(spark, sf_dir):
    s, k = spark.read.parquet(f"{sf_dir}/supplier.parquet"), F.col("s_suppkey")
    x, y, a = (k * 7 % 20 + 0.5).cast("double"), (k * 5 % 14 + 0.5).cast("double"), (2 + k % 7).cast("double")
    rois = s.select(k.alias("roi_id"), F.array(x, x + a, x).alias("xs"), F.array(y, y, y + a).alias("ys"))
    return imaging.polygon_pixels(rois, 24, 32).select("roi_id", F.col("pixel").cast("int").alias("pixel"))


PAIRS = f"""{T3}, m AS (SELECT trace, avg(y) AS m FROM t GROUP BY 1), c AS (SELECT trace, frame, y - m AS y FROM t JOIN m USING (trace)),
n AS (SELECT trace, sqrt(sum(y * y)) AS n FROM c GROUP BY 1), dot AS (SELECT a.trace AS i, b.trace AS j, sum(a.y * b.y) AS d FROM c a JOIN c b ON a.frame = b.frame AND a.trace < b.trace GROUP BY 1, 2),
e AS (SELECT i AS source, j AS target, round(CASE WHEN p.n * q.n > 0 THEN least(greatest(d / (p.n * q.n), -1), 1) ELSE 0 END, 6) AS weight FROM dot JOIN n p ON p.trace = i JOIN n q ON q.trace = j)"""


SHARED = f"""{T1}, f AS (SELECT frame FROM t GROUP BY 1 HAVING count(y) = (SELECT count(DISTINCT trace) FROM t)), s AS (SELECT t.* FROM t JOIN f USING (frame)),
m AS (SELECT trace, avg(y) AS m FROM s GROUP BY 1), c AS (SELECT trace, frame, y - m AS y FROM s JOIN m USING (trace)), n AS (SELECT trace, sqrt(sum(y * y)) AS n FROM c GROUP BY 1),
dot AS (SELECT a.trace AS i, b.trace AS j, sum(a.y * b.y) AS d FROM c a JOIN c b ON a.frame = b.frame GROUP BY 1, 2)"""


@query(f"WITH {SHARED} SELECT i, j, round(CASE WHEN i = j THEN 1 WHEN p.n * q.n > 0 THEN least(greatest(d / (p.n * q.n), -1), 1) ELSE 0 END, 6) AS value FROM dot JOIN n p ON p.trace = i JOIN n q ON q.trace = j")
def pearson_ragged(spark, sf_dir):
    """The whole matrix of traces of unequal length, over the frames that all of them have."""
    rows = tables.event_traces(spark, sf_dir)
    return association.matrix(association.pearson(rows, DIGITS), rows.select("trace").distinct())


def pairs(spark, sf_dir) -> graph.Folded:
    return association.correlated(tables.vector_traces(spark, sf_dir), DIGITS)


def weights(spark, sf_dir, least: float | None = None) -> DataFrame:
    return graph.edges(pairs(spark, sf_dir)(cells.every_pair(least)))


@query(f"WITH {PAIRS} SELECT source AS i, target AS j, weight AS value FROM e")
def pearson_matrix(spark, sf_dir):
    return association.pearson(tables.vector_traces(spark, sf_dir), DIGITS)


CODES = f"""{T3}, s AS (SELECT trace, min(y) AS lo, max(y) AS hi FROM t GROUP BY 1),
c AS (SELECT trace, frame, least({BINS - 1}, floor((y - lo) / (CASE WHEN hi > lo THEN hi - lo ELSE 1 END) * {BINS}))::INT AS bin FROM t JOIN s USING (trace)),
h AS (SELECT trace, ln(sum(n)) - sum(n * ln(n)) / sum(n) AS h FROM (SELECT trace, bin, count(*) AS n FROM c GROUP BY 1, 2) GROUP BY 1)"""


@query(f"WITH {CODES} SELECT trace, frame, bin FROM c")
def trace_bins(spark, sf_dir):
    return association.binned(tables.vector_traces(spark, sf_dir), BINS)


@query(f"WITH {CODES} SELECT trace, round(h, 6) AS entropy FROM h")
def trace_entropy(spark, sf_dir):
    return association.entropies(tables.vector_traces(spark, sf_dir), BINS).select("trace", r("entropy"))


@query(f"""WITH {CODES}, k AS (SELECT a.trace AS i, b.trace AS j, a.bin AS p, b.bin AS q, count(*) AS n FROM c a JOIN c b ON a.frame = b.frame AND a.trace < b.trace GROUP BY 1, 2, 3, 4),
x AS (SELECT i, j, ln(sum(n)) - sum(n * ln(n)) / sum(n) AS h FROM k GROUP BY 1, 2)
SELECT i, j, round(CASE WHEN a.h > 0 AND b.h > 0 THEN least(greatest((a.h + b.h - x.h) / sqrt(a.h * b.h), 0), 1) ELSE 0 END, 6) AS value FROM x JOIN h a ON a.trace = i JOIN h b ON b.trace = j""")
def nmi_matrix(spark, sf_dir):
    return association.nmi(tables.vector_traces(spark, sf_dir), BINS, DIGITS)


@query(f"WITH {PAIRS} SELECT source, target, weight FROM e")
def graph_edges(spark, sf_dir):
    return weights(spark, sf_dir)


ENDS = "z AS (SELECT source AS id, target AS other, weight FROM e UNION ALL SELECT target, source, weight FROM e)"


@query(f"WITH {PAIRS}, {ENDS} SELECT id, round(sum(abs(weight)), 6) AS strength FROM z GROUP BY 1")
def node_strength(spark, sf_dir):
    return graph.pair_strengths(pairs(spark, sf_dir), DIGITS).select("id", r("strength"))


@query(f"WITH {PAIRS}, {ENDS} SELECT vec_id AS id, sum(CASE WHEN abs(weight) >= 0.3 THEN 1 ELSE 0 END)::BIGINT AS degree FROM embeddings LEFT JOIN z ON z.id = vec_id GROUP BY 1")
def node_degree(spark, sf_dir):
    nodes = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select(F.col("vec_id").alias("id"))
    return graph.pair_degrees(pairs(spark, sf_dir), nodes, 0.3)


@query(f"WITH {PAIRS} SELECT source, target, weight FROM e ORDER BY abs(weight) DESC, source, target LIMIT 40000")
def graph_topk_edges(spark, sf_dir):
    return graph.pair_strongest(pairs(spark, sf_dir), 40_000)


@query(f"""WITH {PAIRS}, w AS (SELECT abs(weight) AS w FROM e ORDER BY 1 DESC LIMIT 2000), s AS (SELECT min(w) AS w, max(w) AS m FROM w)
SELECT round(round_even(w / m * 1000, 0) / 1000 * m, 6) AS threshold FROM s""")
def graph_initial_threshold(spark, sf_dir):
    return graph.pair_initial_threshold(pairs(spark, sf_dir)).select(r("threshold"))


@query(f"""WITH {PAIRS}, {ENDS}, o AS (SELECT id, other, weight, row_number() OVER (PARTITION BY id ORDER BY abs(weight) DESC, other)::INT AS rank FROM z)
SELECT id, rank, other, weight FROM o WHERE rank <= 6""")
def neighbours_of(spark, sf_dir):
    return graph.pair_neighbours(pairs(spark, sf_dir))


@query(f"""WITH {PAIRS}, mx AS (SELECT max(abs(weight)) AS m FROM e), h AS (SELECT least(63, floor(abs(weight) / m * 64))::INT AS bin, count(*)::BIGINT AS n FROM e, mx GROUP BY 1)
SELECT bin, n, round(ln(1 + n) / (SELECT ln(1 + max(n)) FROM h), 6) AS height FROM h""")
def weight_histogram(spark, sf_dir):
    return graph.pair_histogram(pairs(spark, sf_dir)).select("bin", "n", r("height"))


@query(f"""WITH {PAIRS}, mx AS (SELECT max(abs(weight)) AS m FROM e)
SELECT weight < 0 AS negative, least(15, floor((abs(weight) - 0.1) / (m - 0.1) * 16))::INT AS bucket, count(*)::BIGINT AS n FROM e, mx WHERE abs(weight) >= 0.1 GROUP BY 1, 2""")
def edge_buckets(spark, sf_dir):
    return graph.pair_buckets(pairs(spark, sf_dir), 0.1)


@query(f"WITH {PAIRS} SELECT count(*)::BIGINT AS edge_count, round(max(abs(weight)), 4) AS max_abs_weight FROM e")
def graph_summary(spark, sf_dir):
    return graph.pair_summary(pairs(spark, sf_dir))


@query(f"WITH {PAIRS} SELECT source, target, printf('%.6f', weight) AS weight FROM e WHERE abs(weight) >= 0.5")
def network_edges(spark, sf_dir):
    return sinks.network(network_points(spark, sf_dir), weights(spark, sf_dir, 0.5), 0.5)[0]


def network_points(spark, sf_dir) -> DataFrame:
    """(id, label, x, y): embeddings as nodes at their first two components."""
    e = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    place = [F.get("embedding", F.lit(i)).cast("double").alias(c) for i, c in enumerate("xy")]
    return e.select(F.col("vec_id").alias("id"), F.concat(F.lit("v"), F.col("vec_id").cast("string")).alias("label"), *place)


@query(f"""WITH {PAIRS}, {ENDS}, d AS (SELECT id, count(*) AS n FROM z WHERE abs(weight) >= 0.5 GROUP BY 1)
SELECT vec_id AS id, 'v' || vec_id AS label, printf('%.6f', embedding[1]::DOUBLE) AS x, printf('%.6f', embedding[2]::DOUBLE) AS y, coalesce(n, 0)::BIGINT AS degree FROM embeddings LEFT JOIN d ON d.id = vec_id""")
def network_nodes(spark, sf_dir):
    return sinks.network(network_points(spark, sf_dir), weights(spark, sf_dir, 0.5), 0.5)[1]


@query("""WITH n AS (SELECT (n_nationkey % 20)::BIGINT AS id, max(n_nationkey) AS ord FROM nation GROUP BY 1),
r AS (SELECT c_nationkey::BIGINT AS source, (c_custkey % 25)::BIGINT AS target, c_acctbal::DOUBLE AS weight FROM customer),
b AS (SELECT r.*, p.ord AS a, q.ord AS b FROM r LEFT JOIN n p ON p.id = source LEFT JOIN n q ON q.id = target)
SELECT a::BIGINT AS a, b::BIGINT AS b, weight FROM b WHERE (SELECT bool_and(a IS NOT NULL AND b IS NOT NULL) FROM b) OR (a IS NOT NULL AND b IS NOT NULL AND a <> b)""")
def linked_edges(spark, sf_dir):
    """Nodes 20 to 24 repeat the ids 0 to 4, so some ends are unknown and the last of equal ids counts."""
    nation = spark.read.parquet(f"{sf_dir}/nation.parquet").select((F.col("n_nationkey") % 20).cast("long").alias("id"), F.col("n_nationkey").cast("long").alias("ord"))
    raw = spark.read.parquet(f"{sf_dir}/customer.parquet").select(F.col("c_nationkey").cast("long").alias("source"), (F.col("c_custkey") % 25).cast("long").alias("target"), F.col("c_acctbal").cast("double").alias("weight"))
    return graph.linked_edges(nation, raw)


@query("""WITH l AS (SELECT row_number() OVER (ORDER BY s_suppkey) - 1 AS ord, s_suppkey FROM supplier), n AS (SELECT count(*) AS n, count(*) // 2 AS k FROM l),
k AS (SELECT ord, ((ord * 13) % 50)::DOUBLE AS x, ((ord * 29) % 70)::DOUBLE AS y FROM l, n WHERE ord < k),
s AS (SELECT avg(x) AS cx, avg(y) AS cy, 0.75 * greatest(max(x) - min(x), max(y) - min(y), 1) AS r FROM k)
SELECT l.ord, round(coalesce(x, cx + r * cos(2 * pi() * l.ord / n)), 6) AS x, round(coalesce(y, cy + r * sin(2 * pi() * l.ord / n)), 6) AS y FROM l CROSS JOIN n CROSS JOIN s LEFT JOIN k ON k.ord = l.ord""")
def node_positions(spark, sf_dir):
    from pyspark.sql import Window

    s = spark.read.parquet(f"{sf_dir}/supplier.parquet")
    ord_ = F.row_number().over(Window.orderBy("s_suppkey")).cast("long") - 1
    labels = s.select(ord_.alias("ord"), F.concat(F.lit("cell"), F.col("s_suppkey").cast("string")).alias("label"))
    half = labels.agg(F.expr("count(*) div 2").alias("k"))
    known = labels.join(F.broadcast(half)).where("ord < k").select((F.col("ord") + 1).cast("int").alias("roi_id"), (F.col("ord") * 13 % 50).cast("double").alias("x"), (F.col("ord") * 29 % 70).cast("double").alias("y"))
    return graph.positions(graph.map_to_rois(labels, known.select("roi_id")), known).select("ord", r("x"), r("y"))


SPIKES = f"""{robust_sql(1.5)},
up AS (SELECT trace, frame, y FROM t JOIN lim USING (trace) WHERE sigma > 0 AND y > threshold),
isl AS (SELECT *, frame - row_number() OVER (PARTITION BY trace ORDER BY frame) AS g FROM up),
top AS (SELECT *, row_number() OVER (PARTITION BY trace, g ORDER BY y DESC, frame) AS n, count(*) OVER (PARTITION BY trace, g) AS size FROM isl),
apex AS (SELECT trace, row_number() OVER (PARTITION BY trace ORDER BY frame)::INT AS spike, frame, y FROM top WHERE n = 1 AND size >= 2),
ext AS (SELECT trace, max(frame) AS last FROM t GROUP BY 1),
seg AS (SELECT a.trace, a.spike, a.frame AS f1, b.frame AS f2 FROM apex a JOIN apex b ON a.trace = b.trace AND b.spike = a.spike + 1),
low AS (SELECT trace, spike, frame FROM (SELECT s.trace, s.spike, t.frame, row_number() OVER (PARTITION BY s.trace, s.spike ORDER BY t.y, t.frame) AS n FROM seg s JOIN t ON t.trace = s.trace AND t.frame BETWEEN f1 AND f2) WHERE n = 1),
bound AS (SELECT a.trace, a.spike, a.frame AS apex, a.y AS top, baseline, coalesce(l.frame, 0) AS low, coalesce(h.frame, last) AS high
  FROM apex a JOIN ext USING (trace) JOIN lim USING (trace) LEFT JOIN low l ON l.trace = a.trace AND l.spike = a.spike - 1 LEFT JOIN low h ON h.trace = a.trace AND h.spike = a.spike)"""


def spike_traces(spark, sf_dir) -> DataFrame:
    return tables.event_traces(spark, sf_dir, "event_type").withColumn("t", F.col("frame").cast("double"))


@query(f"WITH {T2}, {SPIKES} SELECT trace, spike, frame, y FROM apex")
def spike_apexes(spark, sf_dir):
    return spikes.apexes(spike_traces(spark, sf_dir), 1.5, 2).select("trace", "spike", "frame", "y")


@query(f"WITH {T2}, {SPIKES} SELECT trace, spike, low, high FROM bound")
def spike_bounds(spark, sf_dir):
    rows = spike_traces(spark, sf_dir)
    return spikes.bounds(rows, spikes.apexes(rows, 1.5, 2)).select("trace", "spike", "low", "high")


MEASURED = f"""{SPIKES}, lv AS (SELECT *, baseline + 0.5 * (top - baseline) AS lev FROM bound),
jk AS (SELECT v.trace, v.spike, max(CASE WHEN t.frame < apex AND t.y <= lev THEN t.frame END) AS j, min(CASE WHEN t.frame > apex AND t.y <= lev THEN t.frame END) AS k
  FROM lv v JOIN t ON t.trace = v.trace AND t.frame BETWEEN low AND high GROUP BY 1, 2),
p AS (SELECT v.*, j, k, CASE WHEN j IS NULL THEN low ELSE j + (lev - a.y) / (b.y - a.y) END AS s, CASE WHEN k IS NULL THEN high ELSE k - 1 + (lev - c.y) / (d.y - c.y) END AS e,
  CASE WHEN j IS NULL THEN l.y ELSE lev END AS sy, CASE WHEN k IS NULL THEN h.y ELSE lev END AS ey
  FROM lv v JOIN jk USING (trace, spike) LEFT JOIN t a ON a.trace = v.trace AND a.frame = j LEFT JOIN t b ON b.trace = v.trace AND b.frame = j + 1
  LEFT JOIN t c ON c.trace = v.trace AND c.frame = k - 1 LEFT JOIN t d ON d.trace = v.trace AND d.frame = k LEFT JOIN t l ON l.trace = v.trace AND l.frame = low LEFT JOIN t h ON h.trace = v.trace AND h.frame = high),
pt AS (SELECT trace, spike, 0 AS o, s AS x, sy - baseline AS y FROM p UNION ALL SELECT trace, spike, 2, e, ey - baseline FROM p
  UNION ALL SELECT p.trace, spike, 1, t.frame, t.y - baseline FROM p JOIN t ON t.trace = p.trace AND t.frame > coalesce(j, low) AND t.frame < coalesce(k, high)),
ar AS (SELECT trace, spike, sum((x2 - x) * (y + y2) / 2) AS auc FROM (SELECT trace, spike, x, y, lead(x) OVER w AS x2, lead(y) OVER w AS y2 FROM pt WINDOW w AS (PARTITION BY trace, spike ORDER BY o, x)) GROUP BY 1, 2)
SELECT trace, spike AS spike_index, round(s, 6) AS start_s, round(e, 6) AS end_s, round(e - s, 6) AS width_s, apex::DOUBLE AS spike_time_s, round(top - baseline, 6) AS max_height, round(auc, 6) AS auc, j IS NULL OR k IS NULL AS truncated FROM p JOIN ar USING (trace, spike)"""


@query(f"WITH {T2}, {MEASURED}")
def spike_table(spark, sf_dir):
    return rounded_spikes(spikes.spikes(spike_traces(spark, sf_dir), 1.5, 0.5, 2))


def rounded_spikes(out: DataFrame) -> DataFrame:
    return out.select("trace", "spike_index", r("start_s"), r("end_s"), r("width_s"), "spike_time_s", r("max_height"), r("auc"), "truncated")


NAMES = "h AS (SELECT (p_partkey - 1)::INT AS col_ord, CASE p_partkey % 6 WHEN 0 THEN 'Mean' || p_partkey WHEN 1 THEN p_partkey || '_mean' WHEN 2 THEN 'Std Dev ' || p_partkey WHEN 3 THEN 'IntDen-' || p_partkey WHEN 4 THEN 'baseline_filt_' || p_partkey ELSE 'frame' END AS name FROM part)"


def name_table(spark, sf_dir) -> DataFrame:
    k = F.col("p_partkey").cast("string")
    kind = F.col("p_partkey") % 6
    name = F.when(kind == 0, F.concat(F.lit("Mean"), k)).when(kind == 1, F.concat(k, F.lit("_mean"))).when(kind == 2, F.concat(F.lit("Std Dev "), k)).when(kind == 3, F.concat(F.lit("IntDen-"), k)).when(kind == 4, F.concat(F.lit("baseline_filt_"), k)).otherwise("frame")
    return spark.read.parquet(f"{sf_dir}/part.parquet").select((F.col("p_partkey") - 1).cast("int").alias("col_ord"), name.alias("name"))


@query(f"""WITH {NAMES} SELECT col_ord, name, CASE WHEN name LIKE 'Mean%' THEN 'Mean' WHEN name LIKE '%_mean' THEN 'mean' ELSE 'baseline_filt_' END AS metric, (col_ord + 1)::INT AS neuron
FROM h WHERE name <> 'frame' AND name NOT LIKE 'Std%' AND name NOT LIKE 'Int%'""")
def signal_columns(spark, sf_dir):
    return columns.signal_columns(name_table(spark, sf_dir))


@query(f"WITH {NAMES} SELECT (col_ord + 1)::INT AS neuron, name, 'IntDen' AS metric FROM h WHERE name LIKE 'IntDen%'")
def select_metric_columns(spark, sf_dir):
    return columns.select_metric(name_table(spark, sf_dir), "Int")


@query()
def als_smoothed(spark, sf_dir):
    return filters.als_filtered(tables.event_traces(spark, sf_dir))


@query(f"""WITH {T3}, n AS (SELECT trace, frame, y FROM t), f AS (SELECT range AS f FROM range(0, 43)),
pad AS (SELECT range AS i, CASE WHEN range < 10 THEN 10 - range WHEN range < 74 THEN range - 10 ELSE 2 * 63 - (range - 10) END AS frame FROM range(0, 84)),
v AS (SELECT trace, i, y FROM pad JOIN n USING (frame)),
g AS (SELECT f, CASE WHEN f = 0 THEN 0 ELSE 1 / sqrt(1 + pow(f * 10.0 / 84 / 3.0, 4)) / sqrt(1 + pow(0.1 / (f * 10.0 / 84), 4)) * (CASE WHEN f = 42 THEN 1 ELSE 2 END) END AS g FROM f),
c AS (SELECT trace, f, sum(y * cos(2 * pi() * f * i / 84)) AS re, sum(y * sin(2 * pi() * f * i / 84)) AS im FROM v CROSS JOIN f GROUP BY 1, 2)
SELECT trace, (k.range)::BIGINT AS frame, round(sum(g / 84 * (re * cos(2 * pi() * c.f * (k.range + 10) / 84) + im * sin(2 * pi() * c.f * (k.range + 10) / 84))) + 0.0, 6) AS filtered FROM c JOIN g USING (f) CROSS JOIN range(0, 64) k GROUP BY 1, 2""")
def bandpass_traces(spark, sf_dir):
    return filters.band_pass(tables.vector_traces(spark, sf_dir)).select("trace", "frame", r("filtered"))


def thinned_sql(points: int) -> str:
    """t: traces of event types, cut down to this many points."""
    return f"""{T2.replace("t AS", "w AS", 1)}, n AS (SELECT trace, count(*) AS n FROM w GROUP BY 1), i AS (SELECT unnest(range(0, {points})) AS i),
pl AS (SELECT DISTINCT trace, (i * (n - 1)) // {points - 1} AS frame FROM n CROSS JOIN i WHERE n > {points}),
t AS (SELECT w.trace, row_number() OVER (PARTITION BY w.trace ORDER BY w.frame) - 1 AS frame, y FROM w JOIN n USING (trace) LEFT JOIN pl ON pl.trace = w.trace AND pl.frame = w.frame WHERE n <= {points} OR pl.frame IS NOT NULL)"""


@query(f"""WITH {thinned_sql(800)}, {robust_sql(1.0)}, {RUNS}
SELECT trace, 'threshold' AS series, frame AS place, round(threshold, 8) AS value FROM t JOIN lim USING (trace)
UNION ALL SELECT trace, CASE WHEN longest >= 3 THEN 'active' ELSE 'inactive' END, frame, round(y, 8) FROM t JOIN runs USING (trace)""")
def preview_active(spark, sf_dir):
    return previews.active(tables.event_traces(spark, sf_dir, "event_type"), 1.0, 3).select("trace", "series", "place", r("value", 8))


@query(f"WITH {thinned_sql(200)}, {MEASURED}")
def preview_spikes(spark, sf_dir):
    """Spikes of traces cut down to 200 points, where durations count points."""
    from pyspark.sql import Window

    rows = traces.decimated(tables.event_traces(spark, sf_dir, "event_type"), 200)
    place = F.row_number().over(Window.partitionBy("trace").orderBy("frame")).cast("long") - 1
    rows = rows.withColumn("frame", place).withColumn("t", F.col("frame").cast("double"))
    return rounded_spikes(spikes.spikes(rows, 1.5, 0.5, 2))


@query(f"""WITH {PX}, m AS (SELECT pixel, median(v) AS m FROM px GROUP BY 1), d AS (SELECT frame, pixel, v, m, abs(v - m) AS d FROM px JOIN m USING (pixel)),
l AS (SELECT frame, avg(d) + 2.0 * greatest(stddev_pop(d), 1e-6) AS l FROM d GROUP BY 1)
SELECT frame, pixel::INT AS pixel, round(CASE WHEN d > l THEN m ELSE v END, 6) AS v FROM d JOIN l USING (frame)""")
def background_filled(spark, sf_dir):
    frames = tables.vector_frames(spark, sf_dir)
    background = imaging.with_background(frames)
    return imaging.background_filled(background, imaging.outliers_of(background, 2.0)).select("frame", "pixel", r("v"))


@query(f"""WITH {PX}, a AS (SELECT frame AS image, pixel FROM px WHERE v >= 0.1), s AS (SELECT * FROM (VALUES (0, 0), (1, 0), (-1, 0), (0, 1), (0, -1)) AS s(dx, dy)),
n AS (SELECT image, pixel % 8 + dx AS x, pixel // 8 + dy AS y FROM a CROSS JOIN s)
SELECT DISTINCT image, (y * 8 + x)::INT AS pixel FROM n WHERE x BETWEEN 0 AND 7 AND y BETWEEN 0 AND 7""")
def dilated_masks(spark, sf_dir):
    masks = imaging.pixels(tables.vector_frames(spark, sf_dir)).where("v >= 0.1").select(F.col("frame").alias("image"), "pixel")
    return imaging.dilated(masks, 8, 8).select("image", F.col("pixel").cast("int").alias("pixel"))


@query(f"""WITH {PX}, a AS (SELECT frame AS image, pixel, pixel % 8 AS x, pixel // 8 AS y FROM px WHERE v >= 0), s AS (SELECT * FROM (VALUES (0, 0), (1, 0), (-1, 0), (0, 1), (0, -1)) AS s(dx, dy)),
n AS (SELECT a.image, a.pixel, b.image IS NULL AS gone FROM a CROSS JOIN s LEFT JOIN a b ON b.image = a.image AND b.x = a.x + dx AND b.y = a.y + dy WHERE a.x + dx BETWEEN 0 AND 7 AND a.y + dy BETWEEN 0 AND 7)
SELECT image, pixel::INT AS pixel FROM n GROUP BY 1, 2 HAVING NOT bool_or(gone)""")
def eroded_masks(spark, sf_dir):
    masks = imaging.pixels(tables.vector_frames(spark, sf_dir)).where("v >= 0").select(F.col("frame").alias("image"), "pixel")
    return imaging.eroded(masks, 8, 8).select("image", F.col("pixel").cast("int").alias("pixel"))


@query(f"""WITH RECURSIVE {PX}, a AS (SELECT frame AS image, pixel, pixel % 8 AS x, pixel // 8 AS y FROM px WHERE v >= 0.1),
n AS (SELECT a.image, a.pixel AS p, b.pixel AS q FROM a JOIN a b ON a.image = b.image AND abs(a.x - b.x) <= 1 AND abs(a.y - b.y) <= 1),
r AS (SELECT image, p, q FROM n UNION SELECT r.image, r.p, n.q FROM r JOIN n ON n.image = r.image AND n.p = r.q),
l AS (SELECT image, p AS pixel, min(q) AS blob FROM r GROUP BY 1, 2)
SELECT image, blob::BIGINT AS blob, count(*)::BIGINT AS area, round(avg(pixel % 8), 6) AS x, round(avg(pixel // 8), 6) AS y FROM l GROUP BY 1, 2""")
def mask_blobs(spark, sf_dir):
    masks = imaging.pixels(tables.vector_frames(spark, sf_dir)).where("v >= 0.1").select(F.col("frame").alias("image"), "pixel")
    return imaging.blobs(masks, 8).select("image", "blob", "area", r("x"), r("y"))


@query(f"WITH {NAMES} SELECT col_ord, name, 'mean' AS metric, (col_ord + 1)::INT AS neuron FROM h WHERE name LIKE '%_mean'")
def target_columns(spark, sf_dir):
    """Of two metrics that differ in case the one that sorts last counts."""
    return columns.target_columns(name_table(spark, sf_dir), "MEAN")


@query(f"WITH {NAMES} SELECT col_ord, name FROM h WHERE col_ord BETWEEN 10 AND 150 AND contains(name, 'filt')")
def column_range(spark, sf_dir):
    return columns.column_range(name_table(spark, sf_dir), 10, 150, "filt")


@query(f"WITH {T1}, g AS (SELECT trace, count(*) AS n, sum(CASE WHEN y >= 1 THEN 1 ELSE 0 END) AS k FROM t GROUP BY 1) SELECT count(*)::BIGINT AS traces, sum(CASE WHEN k = 0 THEN 1 ELSE 0 END)::BIGINT AS all_missing, sum(CASE WHEN k > 0 AND k < n THEN 1 ELSE 0 END)::BIGINT AS some_missing FROM g")
def run_summary(spark, sf_dir):
    """Samples below 1 count as missing."""
    return traces.run_summary(tables.event_traces(spark, sf_dir).withColumn("y", F.when(F.col("y") >= 1, F.col("y"))))


@query(f"WITH {NAMES}, p AS (SELECT * FROM h WHERE name <> 'frame' AND name NOT LIKE 'Std%' AND name NOT LIKE 'Int%') SELECT col_ord AS ord, name AS label, (col_ord + 1)::INT AS roi_id FROM p")
def spike_roi_map(spark, sf_dir):
    """Columns to regions by the neuron of their names, as all have one within the regions."""
    labels = columns.signal_columns(name_table(spark, sf_dir)).select(F.col("col_ord").alias("ord"), F.col("name").alias("label"))
    rois = spark.read.parquet(f"{sf_dir}/part.parquet").select(F.col("p_partkey").alias("roi_id"))
    return graph.map_to_rois(labels, rois, leading=False)


@query(f"WITH {T1}, x AS (SELECT frame FROM t WHERE y < 1) SELECT t.trace, t.frame, y FROM t WHERE frame NOT IN (SELECT frame FROM x)")
def complete_frames(spark, sf_dir):
    """Frames in which no trace lacks a sample; samples below 1 count as missing."""
    rows = tables.event_traces(spark, sf_dir)
    return traces.complete_frames(rows.withColumn("y", F.when(F.col("y") >= 1, F.col("y")))).select("trace", "frame", "y")


FULL = "a AS (SELECT frame AS image, pixel, pixel % 8 AS x, pixel // 8 AS y, v, v >= 0.05 AS on FROM px)"
FAR = "d AS (SELECT a.image, a.pixel, a.x, a.y, min((a.x - b.x) ** 2 + (a.y - b.y) ** 2)::BIGINT AS d2 FROM a LEFT JOIN a b ON b.image = a.image AND NOT b.on WHERE a.on GROUP BY 1, 2, 3, 4)"


def _bright(spark, sf_dir) -> DataFrame:
    return imaging.pixels(tables.vector_frames(spark, sf_dir)).select(F.col("frame").alias("image"), F.col("pixel").cast("long").alias("pixel"), "v")


@query(f"WITH {PX}, {FULL}, {FAR} SELECT image, pixel::BIGINT AS pixel, d2 FROM d")
def mask_distances(spark, sf_dir):
    """Squared distances of bright pixels to the nearest dark one of their frame."""
    return segmentation.distances(_bright(spark, sf_dir).where("v >= 0.05"), 8, 8)


@query(f"""WITH {PX}, {FULL}, {FAR} SELECT p.image, p.pixel::BIGINT AS pixel FROM d p WHERE NOT EXISTS
(SELECT 1 FROM d q WHERE q.image = p.image AND abs(p.x - q.x) <= 2 AND abs(p.y - q.y) <= 2 AND coalesce(q.d2, 1000) > coalesce(p.d2, 1000))""")
def distance_peaks(spark, sf_dir):
    """Bright pixels as far from the dark as any within two pixels."""
    return segmentation.peaks(mask_distances(spark, sf_dir), 8, 8, 2)


WIDE = "w AS (SELECT (frame - (SELECT min(frame) FROM px)) * 64 + pixel AS pixel, pixel AS x, frame - (SELECT min(frame) FROM px) AS y FROM px WHERE v >= 0.16)"


@query(f"""WITH RECURSIVE {PX}, {WIDE}, n AS (SELECT a.pixel AS p, b.pixel AS q FROM w a JOIN w b ON b.y BETWEEN a.y - 1 AND a.y + 1 AND abs(a.x - b.x) <= 1),
r AS (SELECT p, q FROM n UNION SELECT r.p, n.q FROM r JOIN n ON n.p = r.q)
SELECT min(q)::BIGINT AS blob, p::BIGINT AS pixel FROM r GROUP BY p""")
def tiled_blobs(spark, sf_dir):
    """Bright parts of one large image, whose rows are the vectors, over its tiles of 16 pixels a side."""
    rows = tables.vector_frames(spark, sf_dir)
    first = rows.agg(F.min("frame").alias("first"))  # one row
    rows = imaging.pixels(rows).where("v >= 0.16").join(F.broadcast(first))
    masks = rows.select(F.lit(0).alias("image"), ((F.col("frame") - F.col("first")) * 64 + F.col("pixel")).alias("pixel"))
    return tiles.labelled(masks, 64, 16).select("blob", "pixel")


@query("""WITH RECURSIVE s AS (SELECT p_partkey AS n, p_partkey * 7 % 4 AS q, p_partkey * 3 % 7 - 3 AS x, p_partkey * 5 % 9 - 4 AS y FROM part),
m AS (SELECT n, [1, 0, -1, 0][q + 1] AS a, [0, -1, 0, 1][q + 1] AS b, x, [0, 1, 0, -1][q + 1] AS c, [1, 0, -1, 0][q + 1] AS d, y FROM s),
r AS (SELECT n, a::BIGINT AS a, b::BIGINT AS b, x::BIGINT AS x, c::BIGINT AS c, d::BIGINT AS d, y::BIGINT AS y FROM m WHERE n = (SELECT min(n) FROM m)
UNION ALL SELECT m.n, r.a * m.a + r.b * m.c, r.a * m.b + r.b * m.d, r.a * m.x + r.b * m.y + r.x, r.c * m.a + r.d * m.c, r.c * m.b + r.d * m.d, r.c * m.x + r.d * m.y + r.y FROM r JOIN m ON m.n = r.n + 1)
SELECT n::BIGINT AS frame, a, b, x, c, d, y FROM r""")
def composed_transforms(spark, sf_dir):
    """Quarter turns and moves of each frame against the one before, composed up to the first."""
    k = F.col("p_partkey")
    pick = lambda *v: F.get(F.array(*map(F.lit, v)), k * 7 % 4)
    m = F.array(pick(1, 0, -1, 0), pick(0, -1, 0, 1), k * 3 % 7 - 3, pick(0, 1, 0, -1), pick(1, 0, -1, 0), k * 5 % 9 - 4).cast("array<double>")
    steps = spark.read.parquet(f"{sf_dir}/part.parquet").select(k.cast("long").alias("frame"), m.alias("m"))
    return registration.composed(steps).select("frame", *[F.get("m", F.lit(i)).cast("long").alias(c) for i, c in enumerate("abxcdy")])


@query()
def split_bodies(spark, sf_dir):
    """Bright parts of each frame split at their necks."""
    rows = _bright(spark, sf_dir)
    return segmentation.split(rows.where("v >= 0.0").select("image", "pixel"), segmentation.scaled(rows), 8, 8, 3)


@query()
def body_shapes(spark, sf_dir):
    """Bright parts of each frame as simplified polygons."""
    masks = _bright(spark, sf_dir).where("v >= 0.0").select("image", "pixel")
    regions = tiles.labelled(masks, 8).select("image", F.col("blob").alias("region"), "pixel")
    return segmentation.shapes(regions, 8, "polygonal", 0, 100, 0.0).select("image", "region", "xs", "ys", r("x"), r("y"), r("area"), r("perimeter"))


@query()
def inpainted_frames(spark, sf_dir):
    """Frames whose outlying pixels are filled from around them."""
    frames = tables.vector_frames(spark, sf_dir)
    masks = imaging.outliers(frames, 2.0).select("image", "pixel")
    return imaging.pixels(inpainting.inpainted(frames, masks, 8, 8)).select("frame", "pixel", r("v"))
