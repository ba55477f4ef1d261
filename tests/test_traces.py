import math
from statistics import median, pstdev

import numpy as np
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from fluora.functions import columns
from fluora.operators import association, filters, graph, imaging, spikes, traces


def frame(spark, series):
    rows = [(k, i, None if v is None else float(v)) for k, ys in series.items() for i, v in enumerate(ys)]
    return spark.createDataFrame(rows, "trace string, frame long, y double")


def test_robust_threshold_and_runs(spark):
    df = frame(spark, {"run": [0, 0, 5, 5, 5, 0, 0, 0, 0], "flat": [2] * 9, "gap": [0, 0, 5, None, 5, 0, 0, 0, 0]})
    limits = {r.trace: r for r in traces.robust(df, 1.0).collect()}
    assert limits["run"].threshold == pytest.approx(pstdev([0, 0, 5, 5, 5, 0, 0, 0, 0]))
    longest = {r.trace: r.longest for r in traces.longest_runs(df, traces.robust(df, 1.0)).collect()}
    assert longest == {"run": 3, "flat": 0, "gap": 1}
    assert {r.trace for r in traces.active(df, 1.0, 3).collect()} == {"run"}


def test_runs_join_across_blocks(spark, monkeypatch):
    monkeypatch.setattr(traces, "BLOCK", 4)
    ys = [0, 1, 1, 1, 1, 1, 1, 1, 1, 1, 0, 1, 1]
    df = frame(spark, {"a": ys, "b": [1] * 13, "c": [0] * 13})
    limit = spark.createDataFrame([(k, 0.5) for k in "abc"], "trace string, threshold double")
    assert {r.trace: r.longest for r in traces.longest_runs(df, limit).collect()} == {"a": 9, "b": 13, "c": 0}


@settings(max_examples=5, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.one_of(st.none(), st.integers(0, 5)), min_size=1, max_size=30))
def test_longest_run_brute_force(spark, ys):
    best = run = 0
    for v in ys:
        run = run + 1 if v is not None and v > 2 else 0
        best = max(best, run)
    limit = spark.createDataFrame([("a", 2.0)], "trace string, threshold double")
    assert traces.longest_runs(frame(spark, {"a": ys}), limit).first().longest == best


def test_gap_fill_zscore_decimate(spark):
    df = frame(spark, {"a": [None, 1, None, None, 4, None], "b": [None] * 3})
    got = {(r.trace, r.frame): r.filled for r in traces.gap_filled(df).collect()}
    assert [got["a", i] for i in range(6)] == [1, 1, 2, 3, 4, 4]
    assert got["b", 0] is None
    z = [r.z for r in traces.zscored(frame(spark, {"a": [1, 2, 3, 4]})).orderBy("frame").collect()]
    assert z[0] == pytest.approx(-1.5 / np.std([1, 2, 3, 4], ddof=1))
    kept = [r.frame for r in traces.decimated(frame(spark, {"a": range(1000)}), 7).orderBy("frame").collect()]
    assert kept == np.linspace(0, 999, 7).astype(int).tolist()


def test_pearson_and_nmi(spark):
    y = [0.0, 1.0, 3.0, 2.0, 5.0, 4.0, 4.5, 1.5]
    df = frame(spark, {"a": y, "b": [2 * v + 1 for v in y], "c": [-v for v in y], "d": [3] * 8})
    got = {(r.i, r.j): r.value for r in association.pearson(df).collect()}
    assert got["a", "b"] == pytest.approx(1) and got["a", "c"] == pytest.approx(-1) and got["a", "d"] == 0
    mi = {(r.i, r.j): r.value for r in association.nmi(df, 8).collect()}
    assert mi["a", "b"] == pytest.approx(1) and mi["a", "d"] == 0
    grid = frame(spark, {"x": [0, 0, 1, 1], "y": [0, 1, 0, 1]})
    assert association.nmi(grid, 2).first().value == pytest.approx(0)
    assert association.auto_bins(100) == 9 and association.auto_bins(10**9) == 64
    gap = frame(spark, {"a": [1, None, 3, 4], "b": [1, 2, 3, 5]})
    assert {r["count"] for r in traces.shared_frames(gap).groupBy("trace").count().collect()} == {3}


def test_spike_triangle_and_edges(spark):
    tri = [0, 0, 0, 0, 0, 1, 2, 3, 2, 1, 0, 0, 0, 0, 0]
    df = frame(spark, {"tri": tri, "edge": [9, 8, 7, *[0] * 9]}).selectExpr("*", "double(frame) AS t")
    got = {r.trace: r for r in spikes.spikes(df, 1.0, 0.5, 3).collect()}
    s = got["tri"]
    assert (s.start_s, s.end_s, s.width_s, s.max_height, s.auc, s.truncated) == (5.5, 8.5, 3.0, 3.0, 6.75, False)
    assert got["edge"].truncated and got["edge"].start_s == 0


def test_als_banded_equals_dense():
    rng = np.random.default_rng(1)
    y = rng.random((3, 60)) + np.linspace(1, 2, 60)
    n, lam = 60, filters.penalty(60, 1e3, 1e-3, 0.2, 0.2)
    d = np.diff(np.eye(n), 2, axis=0)
    for row, got in zip(y, filters.als(y, 1e3, 0.01, 6, 1e-3, 0.2, 0.2), strict=True):
        w = np.ones(n)
        for _ in range(6):
            z = np.linalg.solve(lam[:, None] * (d.T @ d) + np.diag(w), w * row)
            w = np.where(row > z, 0.01, np.where(row < z, 0.99, 0))
        assert np.allclose(z, got, rtol=1e-6)
    assert (filters.als(np.zeros((1, 600)), 1e5, 0.01, 10) == 0).all()
    line = np.arange(1.0, 301)[None]
    assert np.allclose(filters.als(line, 1e5, 0.01, 10), line, rtol=1e-6)


def test_band_pass(spark):
    t = np.arange(300) / 10
    y = 5 + np.sin(2 * np.pi * t)
    got = filters.band_passed(np.array([y]))[0]
    gain = 1 / math.sqrt(1 + (1 / 3) ** 4) / math.sqrt(1 + 0.1**4)
    assert np.abs(got[50:250] - gain * np.sin(2 * np.pi * t)[50:250]).max() < 0.05
    with pytest.raises(ValueError):
        filters.band_passed(np.zeros((1, 9)), fps=4, high=3)
    out = filters.band_pass(frame(spark, {"a": [None] * 5, "b": range(5)})).collect()
    assert {r.filtered is None for r in out if r.trace == "a"} == {True}


def test_column_dialects(spark):
    names = ["Mean7", "7_mean", "baseline_filt_12", "7-mean", "Mean 7", "mean7", "frame"]
    df = spark.createDataFrame(list(enumerate(names)), "col_ord int, name string")
    read = lambda f: [tuple(r.p) if r.p else None for r in df.select(f(df.name).alias("p"), "col_ord").orderBy("col_ord").collect()]
    assert read(columns.dialect_a) == [("Mean", 7), ("mean", 7), ("baseline_filt_", 12), None, None, ("mean", 7), None]
    assert read(columns.dialect_b) == [("Mean", 7), ("mean", 7), None, ("mean", 7), ("Mean", 7), ("mean", 7), None]
    wide = spark.createDataFrame([(0, "StdDev1"), (1, "IntDen1"), (2, "Int1"), (3, "Int 1")], "col_ord int, name string")
    assert [r.name for r in columns.select_metric(wide, "Std").collect()] == ["StdDev1"]
    assert [r.name for r in columns.select_metric(wide, "Int").collect()] == ["Int1"]
    with pytest.raises(ValueError):
        columns.select_metric(wide, "I")
    assert columns.resolve_metrics("MEAN", ["Mean", "mean"]) == ["mean"]
    assert columns.parse_ids("3, 7-5, x, 3") == [3, 5, 6, 7]


def test_graph(spark):
    pairs = spark.createDataFrame([("a", "b", 0.5), ("a", "c", -0.25), ("b", "c", float("nan"))], "i string, j string, value double")
    e = graph.edges(pairs)
    assert {r.id: r.strength for r in graph.strengths(e).collect()} == {"a": 0.75, "b": 0.5, "c": 0.25}
    assert graph.initial_threshold(e, 1).first().threshold == 0.5
    nodes = spark.createDataFrame([("a", 0), ("b", 1)], "id string, ord int")
    raw = spark.createDataFrame([("a", "b", 1.0), ("a", "a", 2.0)], "source string, target string, weight double")
    assert graph.linked_edges(nodes, raw).count() == 2
    assert graph.linked_edges(nodes, raw.union(raw.selectExpr("'a'", "'x'", "3D"))).count() == 1
    rois = spark.createDataFrame([(1,), (2,), (3,)], "roi_id int")
    mapped = lambda names, **k: [r.roi_id for r in graph.map_to_rois(spark.createDataFrame(list(enumerate(names)), "ord int, label string"), rois, **k).orderBy("ord").collect()]
    assert mapped(["1_mean", "3_mean"]) == [1, 3]
    assert mapped(["Mean1", "Mean3"]) == [1, 2] and mapped(["Mean1", "Mean3"], leading=False) == [1, 3]
    assert mapped(["9_mean"]) == [1]


def test_imaging(spark):
    square = spark.createDataFrame([(1, [0.5, 3.5, 3.5, 0.5], [0.5, 0.5, 2.5, 2.5])], "roi_id int, xs array<double>, ys array<double>")
    assert sorted(r.pixel for r in imaging.polygon_pixels(square, 5, 5).collect()) == [6, 7, 8, 11, 12, 13]
    masks = spark.createDataFrame([(0, p) for p in (0, 6, 9, 4)], "image int, pixel long")
    got = sorted((r.blob, r.area) for r in imaging.blobs(masks, 5).collect())
    assert got == [(0, 2), (4, 2)]
    frames = spark.createDataFrame([(0, [1.0, 2.0, 3.0, 4.0])], "frame long, px array<double>")
    m = imaging.roi_metrics(frames, spark.createDataFrame([(1, p) for p in range(4)], "roi_id int, pixel int")).first()
    assert (m["max"], m["mean"], m["int"]) == (4, 2.5, 10) and m["std"] == pytest.approx(1.118, abs=1e-3)
    assert median([1, 2, 3]) == 2


def test_pairs_over_shared_frames(spark, monkeypatch):
    """Traces of unequal length, with missing samples, in several blocks of traces and of frames."""
    from fluora.operators import association

    rng = np.random.default_rng(7)
    spans = {f"t{k}": (int(rng.integers(0, 4)), int(rng.integers(30, 40))) for k in range(11)}
    ys = {k: rng.normal(size=40) for k in spans}
    ys["t3"][:] = 2.0
    rows = [(k, f, None if (k, f) == ("t5", 20) else float(ys[k][f])) for k, (a, b) in spans.items() for f in range(a, b)]
    df = spark.createDataFrame(rows, "trace string, frame long, y double").repartition(3)
    full = [f for f in range(max(a for a, _ in spans.values()), min(b for _, b in spans.values())) if f != 20]
    x = np.array([ys[k][full] for k in spans])
    names = list(spans)
    for block, frames in ((256, 4096), (3, 4096), (3, 7)):
        monkeypatch.setattr(association, "BLOCK", block)
        monkeypatch.setattr(association, "FRAMES", frames)
        got = {(r.i, r.j): r.value for r in association.pearson(df).collect()}
        assert len(got) == 55 and all(i < j for i, j in got)
        for (i, j), v in got.items():
            want = 0.0 if "t3" in (i, j) else np.corrcoef(x[names.index(i)], x[names.index(j)])[0, 1]
            assert v == pytest.approx(want, abs=1e-9)
        mutual = {(r.i, r.j): r.value for r in association.nmi(df, 4).collect()}
        code = {k: np.minimum(3, ((v - v.min()) / ((v.max() - v.min()) or 1) * 4).astype(int)) for k, v in zip(names, x, strict=True)}
        h = lambda c: -sum(n / len(full) * np.log(n / len(full)) for n in np.unique(c, return_counts=True)[1])
        for (i, j), v in mutual.items():
            a, b = h(code[i]), h(code[j])
            want = max(0.0, (a + b - h(code[i] * 4 + code[j])) / np.sqrt(a * b)) if a > 0 and b > 0 else 0.0
            assert v == pytest.approx(want, abs=1e-9)
        assert len(mutual) == 55
    with pytest.raises(ValueError, match="not enough complete rows"):
        association.pearson(df.where("frame < 4 or trace != 't1'"))
    from fluora.plans import modules

    both = df.withColumn("trace", F.concat("trace", F.lit("mean"))).withColumn("trace", F.regexp_replace("trace", "t(\\d+)mean", "$1_mean")).unionByName(df.withColumn("trace", F.regexp_replace("trace", "t", "max")))
    one = modules.pearson_matrix({"traces": both, "metric": "me"})["matrix"]
    assert one.count() == 55 and one.where("not i like '%_mean'").count() == 0


def test_gaps_over_blocks(spark, monkeypatch):
    rng = np.random.default_rng(9)
    series = {f"t{k}": [None if rng.random() < share else float(v) for v in rng.normal(size=50)] for k, share in enumerate((0.2, 0.7, 0.93, 1.0))}
    series["t9"] = [None] * 20 + [1.0] + [None] * 25 + [3.0] + [None] * 9
    df = frame(spark, series)
    for block in (1 << 16, 7, 1):
        monkeypatch.setattr(traces, "BLOCK", block)
        got = {(r.trace, r.frame): r.filled for r in traces.gap_filled(df).collect()}
        for k, ys in series.items():
            at = [i for i, v in enumerate(ys) if v is not None]
            for i in range(len(ys)):
                want = np.interp(i, at, [ys[j] for j in at]) if at else None
                assert got[k, i] == (None if want is None else pytest.approx(want))
    assert traces.gap_filled(df).columns == [*df.columns, "filled"]
