import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from fluora.functions import columns
from fluora.operators import imaging, previews, traces
from fluora.plans import modules
from fluora.plans.pipeline import Context, execute
from fluora.sources import video


def test_pipeline_of_modules(spark, tmp_path):
    rng = np.random.default_rng(2)
    ys = rng.random((4, 80)) * 0.1 + 5
    ys[:2, 30:36] += 3
    ys[:2, 60:66] += 3
    frames = spark.createDataFrame([(i, ys[:, i].tolist()) for i in range(80)], "frame long, px array<double>")
    masks = spark.createDataFrame([(r + 1, r) for r in range(4)], "roi_id int, pixel int")
    ctx = Context()
    names = ["generate_signals", "als_filter", "band_pass_filter", "select_active", "pearson_matrix", "connectivity_graph"]
    log = []
    assert execute(names, modules.registry(), {"generate_signals": {"frames": frames, "masks": masks}}, ctx, log=log.append), log
    assert ctx.get("generate_signals.traces").count() == 4 * 4 * 80
    one = ctx.get("generate_signals.traces").where("trace like '%mean'")
    got = modules.spike_analysis({"traces": one, "k": 3.0})["spikes"].groupBy("trace").count().collect()
    assert {r.trace: r["count"] for r in got} == {"1_mean": 2, "2_mean": 2}
    assert {r.trace for r in modules.select_active({"traces": one})["traces"].select("trace").distinct().collect()} == {"1_mean", "2_mean"}
    assert ctx.get("connectivity_graph.edges").count() > 0
    one.write.parquet(str(tmp_path / "in"))
    modules.main(["select_active", "--input", str(tmp_path / "in"), "--output", str(tmp_path / "out"), "--params", '{"k": 2.5}'])
    assert spark.read.parquet(str(tmp_path / "out")).select("trace").distinct().count() == 2


def test_tiff_round_trip(spark, tmp_path):
    pages = [np.arange(12, dtype=np.uint16).reshape(3, 4) + i for i in range(3)]
    (tmp_path / "a.tif").write_bytes(video.write_tiff(pages))
    got = video.tiff_frames(spark, str(tmp_path / "a.tif"))
    assert [r.px for r in got.orderBy("frame").collect()] == [p.ravel().tolist() for p in pages]
    path = video.write_frames(got, f"file://{tmp_path}/out").first().path
    assert video.tiff_frames(spark, path).where("frame = 2").first().px == pages[2].ravel().tolist()


def test_morphology_and_floaters(spark):
    at = [y * 8 + x for y in range(2, 6) for x in range(2, 6)] + [7]
    masks = spark.createDataFrame([(0, p) for p in at], "image long, pixel long")
    left = {r.pixel for r in imaging.opened(masks, 8, 8).collect()}
    assert 7 not in left and len(left) == 12
    video_ = np.random.default_rng(1).random((9, 64)) * 0.01
    video_[4, [9, 10, 11, 17, 18, 19, 25, 26, 27]] += 5
    frames = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(video_)], "frame long, px array<double>")
    out = modules.remove_floaters({"frames": frames, "width": 8, "height": 8, "k": 1.5})
    hit = {(r.image, r.pixel) for r in out["masks"].collect()}
    assert (4, 18) in hit and {i for i, _ in hit} == {4}
    for fill in ("inpaint", "background"):
        out = modules.remove_floaters({"frames": frames, "width": 8, "height": 8, "k": 1.5, "fill": fill})["frames"].collect()
        new = {(r.frame, p): v for r in out for p, v in enumerate(r.px)}
        assert len(new) == 9 * 64 and max(new[h] for h in hit) < 0.1
        assert all(v == video_[at] for at, v in new.items() if at not in hit)


def test_warp_ovals_steps(spark):
    image = np.arange(16.0).reshape(4, 4)
    assert (imaging.warped(image, np.array([[1, 0, 1], [0, 1, 0]]))[:, :3] == image[:, 1:]).all()
    rois = spark.createDataFrame([(1, 2.0, 2.0, 6.0, 6.0, "oval")], "roi_id int, left double, top double, width double, height double, kind string")
    inside = {r.pixel for r in imaging.oval_pixels(rois, 12, 12).collect()}
    want = {y * 12 + x for y in range(12) for x in range(12) if (x - 5) ** 2 + (y - 5) ** 2 < 8.9}
    assert want <= inside and len(inside - want) <= 4
    steps = spark.createDataFrame([(0, 0, 0), (1, 1, 2), (2, -3, 1)], "frame long, dy int, dx int")
    assert [(r.dy, r.dx) for r in imaging.summed_steps(steps).orderBy("frame").collect()] == [(0, 0), (1, 2), (-2, 3)]


ROI = "roi_id int, name string, xs array<double>, ys array<double>, left double, top double, width double, height double"


def test_spikes_and_graph_have_places(spark):
    rows = [(f"{n}_mean", f, 5.0 if f in (10, 11, 12, 13) else 1.0 + (f % 3) * 0.01) for n in (2, 1) for f in range(40)]
    rows = spark.createDataFrame(rows, "trace string, frame long, y double")
    rois = spark.createDataFrame([(1, "a", [0.0, 4.0, 2.0], [0.0, 0.0, 3.0], None, None, None, None), (2, "b", [], [], 6.0, 2.0, 2.0, 4.0)], ROI)
    times = spark.createDataFrame([(f, 100.0 + f) for f in range(40)], "frame long, t double")
    out = modules.spike_analysis({"traces": rows, "rois": rois, "times": times, "metrics": "MEAN"})
    got = {r.signal: (r.x, r.y, r.spike_time_s) for r in out["spikes"].collect()}
    assert got == {"1_mean": (2.0, 1.0, 110.0), "2_mean": (7.0, 4.0, 110.0)}
    assert tuple(out["summary"].first()) == (2, 2, 0, 0, 0)
    assert {r.spike_time_s for r in modules.spike_analysis({"traces": rows})["spikes"].collect()} == {1.0}
    matrix = spark.createDataFrame([("1", "2", 0.5)], "i string, j string, value double")
    labels = spark.createDataFrame([(0, "1"), (1, "2")], "ord int, label string")
    out = modules.connectivity_graph({"matrix": matrix, "labels": labels, "rois": rois})
    graph = json.loads(out["document"].first().json)["graph"]
    assert graph["type"] == "neuro-connectivity" and [n["metadata"] for n in graph["nodes"]] == [{"x": 2.0, "y": 1.0, "roi_name": "a", "strength": 0.5}, {"x": 7.0, "y": 4.0, "roi_name": "b", "strength": 0.5}]


def test_windowed_background_brute_force(spark, monkeypatch):
    v = np.random.default_rng(5).random((30, 4))
    frames = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "frame long, px array<double>")
    got = {(r.frame, r.pixel): r.median for r in imaging.with_background(frames, 5).collect()}
    assert len(got) == 120 and all(abs(got[i, p] - np.median(v[max(0, i - 2) : i + 3, p])) < 1e-12 for i in range(30) for p in range(4))
    assert {r.median for r in imaging.with_background(frames, 30).where("pixel = 1").collect()} == {np.median(v[:, 1])}


def test_csv_in_and_out_keeps_columns(spark, tmp_path):
    up = [9.0 if f in (4, 5, 6) else 1.0 + f % 2 * 0.1 for f in range(12)]
    lines = ["note,1_mean,2_mean,1_std,time_s"] + [f'"a, ""{f}""",{up[f]},{1.0 + f % 2 * 0.1},{f},{f / 2}' for f in range(12)]
    (tmp_path / "in.csv").write_text("\n".join(lines) + "\n")
    modules.main(["select_active", "--input", str(tmp_path / "in.csv"), "--output", str(tmp_path / "out"), "--params", '{"metrics": "mean"}'])
    text = [line for f in sorted((tmp_path / "out").glob("part-*")) for line in f.read_text().splitlines()]
    assert text[0] == "note,1_mean,1_std,time_s" and text[1] == '"a, ""0""",1.0,0,0.0' and len(text) == 13
    modules.main(["spike_analysis", "--input", str(tmp_path / "in.csv"), "--output", str(tmp_path / "spikes"), "--params", '{"metrics": "mean"}'])
    assert [r.spike_time_s for r in spark.read.option("header", True).csv(str(tmp_path / "spikes")).collect()] == ["2.000000"]


def test_previews(spark):
    up = [9.0 if f in (4, 5, 6) else 1.0 + f % 2 * 0.1 for f in range(20)]
    rows = spark.createDataFrame([(t, f, y) for t, ys in (("a", up), ("b", [1.0 + f % 2 for f in range(20)]), ("c", [None] * 20)) for f, y in enumerate(ys)], "trace string, frame long, y double")
    got = previews.active(rows).groupBy("trace", "series").count().collect()
    assert {(r.trace, r.series): r["count"] for r in got} == {("a", "active"): 20, ("a", "threshold"): 20, ("b", "inactive"): 20, ("b", "threshold"): 20}
    assert previews.series_names(previews.active(rows)) == ["Original", "active", "threshold", "inactive"]
    found = {r.place: r.value for r in previews.spiking(rows).where("trace = 'a' and series = 'detected'").collect()}
    assert found[4] == found[6] == 9.0 and found[10] != 9.0 and len(found) == 20
    assert {r.series for r in previews.als(rows).select("series").distinct().collect()} == {"baseline", "corrected", "smoothed"}
    assert previews.band_pass(rows, most=10).groupBy("trace").count().first()["count"] == 10


def test_column_selection_and_summaries(spark):
    names = ["frame", "1_mean", "2_mean", "2_std", "note"]
    header = spark.createDataFrame(list(enumerate(names)), "col_ord int, name string")
    assert tuple(columns.metrics_and_neurons(header).first()) == (["mean", "std"], [1, 2])
    assert [r.name for r in columns.target_columns(header, "STD").collect()] == ["2_std"]
    assert [r.name for r in columns.column_range(header, 1, 3, "2").collect()] == ["2_mean", "2_std"]
    found, missing = columns.neuron_columns(header, ["std", "mean"], "2, 7")
    assert [r.name for r in found.collect()] == ["2_std", "2_mean"] and [r.neuron for r in missing.collect()] == [7]
    with pytest.raises(ValueError):
        columns.target_columns(header, "max")
    rows = spark.createDataFrame([("a", 0, 1.0), ("a", 1, None), ("b", 0, None)], "trace string, frame long, y double")
    assert tuple(traces.run_summary(rows).first()) == (2, 1, 1)


def test_further_metrics(spark, monkeypatch):
    frames = spark.createDataFrame([(0, [1.0, 2.0, 9.0])], "frame long, px array<double>")
    masks = spark.createDataFrame([(1, 0), (1, 1), (1, 2)], "roi_id int, pixel int")
    monkeypatch.setitem(modules.METRICS, "least", lambda v: F.array_min(v))
    got = {r.trace: r.y for r in modules.generate_signals({"frames": frames, "masks": masks})["traces"].collect()}
    assert got["1_least"] == 1.0 and got["1_max"] == 9.0
