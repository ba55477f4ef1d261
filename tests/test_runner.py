"""Progress and cancelling of running modules, CSV records over line breaks, matrix files."""

import io
import time

import numpy as np
import pandas as pd
import pytest

from fluora.plans.pipeline import Context, Module
from fluora.plans.runner import Run
from fluora.sources import sinks, traces


def slowly(seconds):
    def run(parts):
        import time

        for part in parts:
            time.sleep(seconds)
            yield part

    return run


def test_progress_and_cancel(spark):
    began = []

    def quick(p):
        began.append("quick")
        return {"rows": spark.range(10), "n": 3}

    def slow(p):
        began.append("slow")
        return {"rows": spark.range(64, numPartitions=64).mapInPandas(slowly(0.5), "id long")}

    def late(p):
        began.append("late")
        return {}

    modules = {f.__name__: Module(f.__name__, f) for f in (quick, slow, late)}
    log, ctx = [], Context()
    run = Run(spark, ["quick", "slow", "late"], modules, {}, ctx, log=log.append).start()
    seen = []
    for _ in range(600):
        seen.append(run.progress())
        if seen[-1].module == "slow" and seen[-1].tasks_done > 2:
            break
        time.sleep(0.05)
    assert seen[-1].tasks == 64 and 2 < seen[-1].tasks_done < 64 and 1 / 3 < seen[-1].share < 2 / 3
    assert [p.share for p in seen] == sorted(p.share for p in seen)
    asked = time.time()
    run.cancel()
    assert run.wait(30) is False and time.time() - asked < 2
    assert began == ["quick", "slow"] and ctx.get("quick.rows").count() == 10 and ctx.get("slow.rows") is None
    assert any("slow" in line for line in log) and run.progress().module is None
    assert spark.range(5).count() == 5  # the session goes on
    again = Run(spark, ["quick", "late"], modules, {}).start()
    assert again.wait(60) is True and again.progress().share == 1


@pytest.mark.parametrize("end", ["\n", "\r\n"])
def test_records_over_line_breaks(spark, tmp_path, end):
    rng = np.random.default_rng(3)
    pieces = ["1.5", "", "a", 'say ""so""', "x,y", "two\nlines", "\n\nafter blanks", 'end""', ",\n,", "3"]
    lines = ['"first\nname",b,"c,d",b']
    for _ in range(300):
        cells = [pieces[i] for i in rng.integers(0, len(pieces), 4)]
        lines.append(",".join(f'"{c}"' if any(x in c for x in '",\n') or rng.random() < 0.2 else c for c in cells) + "\n" * int(rng.random() < 0.1))
    text = "\n".join(lines).replace("\n", end) + end
    path = tmp_path / "t.csv"
    path.write_bytes(text.encode())
    want = pd.read_csv(io.BytesIO(text.encode()), dtype=str, keep_default_na=False, header=None, skiprows=0)
    old = spark.conf.get("spark.sql.files.maxPartitionBytes"), spark.conf.get("spark.sql.files.openCostInBytes")
    try:
        for size in ("100", "777", "128m"):  # splits of so many bytes
            spark.conf.set("spark.sql.files.maxPartitionBytes", size)
            spark.conf.set("spark.sql.files.openCostInBytes", "0")
            assert traces.header(spark, str(path)) == [want[0][0], "b", "c,d", "b.1"]
            cells = traces.wide_csv(spark, str(path))
            got = {(r.frame, r.col_ord): r.cell for r in cells.collect()}
            assert got == {(i - 1, c): want[c][i] for i in range(1, len(want)) for c in range(4)}
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old[0])
        spark.conf.set("spark.sql.files.openCostInBytes", old[1])


def test_matrix_file(spark, tmp_path):
    names = ["n10", "n2", 'odd "one", two']
    rows = [(a, b, float(i * 10 + j) / 3) for i, a in enumerate(names) for j, b in enumerate(names)]
    matrix = spark.createDataFrame(rows, "i string, j string, value double").repartition(3)
    labels = spark.createDataFrame([(i, n) for i, n in enumerate(names)], "ord int, label string")
    sinks.write_matrix(matrix, str(tmp_path / "m"), labels)
    text = "".join(p.read_text() for p in sorted((tmp_path / "m").glob("part-*")))
    got = pd.read_csv(io.StringIO(text), index_col=0)
    assert list(got.columns) == names == list(got.index) and got.loc["n2", names[2]] == pytest.approx(4.0, abs=1e-6)
    assert text.splitlines()[1].split(",")[1] == "0.000000"
    back = {(r.i, r.j): r.value for r in traces.matrix_csv(spark, str(tmp_path / "m")).collect()}
    assert back == {(a, b): pytest.approx(v, abs=1e-6) for a, b, v in rows}
    sinks.write_matrix(matrix, str(tmp_path / "n"))
    assert "".join(p.read_text() for p in sorted((tmp_path / "n").glob("part-*"))).splitlines()[0] == ',n10,n2,"odd ""one"", two"'


def test_only_wanted_columns_are_exploded(spark, tmp_path):
    (tmp_path / "t.csv").write_text('a,"b,b",time_s,a\n1,2,3,4\n"x\ny",6,7\n')
    got = {(r.frame, r.name): r.cell for r in traces.wide_csv(spark, str(tmp_path / "t.csv"), ["b,b", "a"]).collect()}
    assert got == {(0, "a"): "1", (0, "b,b"): "2", (1, "a"): "x\ny", (1, "b,b"): "6"}


def test_region_metrics_in_parts(spark, monkeypatch):
    from fluora.operators import imaging

    frames = spark.createDataFrame([(f, [float(f * 10 + p) for p in range(9)]) for f in range(4)], "frame long, px array<double>")
    masks = spark.createDataFrame([(r, (r + k) % 9) for r in range(6) for k in range(r + 1)], "roi_id int, pixel int")
    whole = sorted(tuple(r) for r in imaging.roi_metrics(frames, masks).collect())
    monkeypatch.setattr(imaging, "MASK_PIXELS", 5)
    assert sorted(tuple(r) for r in imaging.roi_metrics(frames, masks).collect()) == whole and len(whole) == 24
