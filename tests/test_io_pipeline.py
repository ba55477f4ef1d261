import io
import zipfile

import pytest

from fluora.plans.pipeline import Context, Module, compacted, configured, effective_links, execute, ordered
from fluora.sources import sinks, traces


def test_wide_csv_round_trip(spark, tmp_path):
    p = tmp_path / "a.csv"
    p.write_text("frame,Mean1,Mean1,1_std,note\n0,1.5,,NA,x\n1,2,3,4,y\n")
    cells = traces.wide_csv(spark, str(p))
    assert traces.header(spark, str(p)) == ["frame", "Mean1", "Mean1.1", "1_std", "note"]
    got = {(r.name, r.frame): r.y for r in cells.collect()}
    assert got["Mean1", 0] == 1.5 and got["Mean1.1", 0] is None and got["1_std", 0] is None and got["1_std", 1] == 4
    assert [r.name for r in traces.numeric_columns(cells).collect()] == ["Mean1", "Mean1.1", "1_std"]
    out = tmp_path / "out"
    sinks.write_traces(cells.where("name like 'Mean%'").select("name", "frame", "y"), ["Mean1", "Mean1.1"], str(out))
    lines = [line for f in sorted(out.glob("part-*")) for line in f.read_text().splitlines()]
    assert sorted(lines[1:]) == ["0,1.5,", "1,2.0,3.0"]


def test_matrix_csv(spark, tmp_path):
    p = tmp_path / "m.csv"
    p.write_text(",1,2\n1,1.0,0.5\n2,0.5,1.0\n")
    rows = traces.matrix_csv(spark, str(p))
    assert {(r.i, r.j): r.value for r in rows.collect()}["1", "2"] == 0.5
    assert [r.line for r in sinks.matrix_lines(rows).orderBy("i").collect()] == ["1,1.000000,0.500000", "2,0.500000,1.000000"]
    p.write_text(",1\n1,1.0\n")
    with pytest.raises(ValueError):
        traces.matrix_csv(spark, str(p))


@pytest.mark.parametrize("text", ['{"graph": %s}', '{"graphs": [%s]}', "%s"])
def test_jgf(spark, text):
    body = '{"nodes": [{"id": "1", "metadata": {"x": 2.5, "y": 1}}, {"id": "2"}], "edges": [{"source": "1", "target": "2", "metadata": {"weight": "oops"}}, {"source": "2", "target": "1", "weight": 0.5}]}'
    nodes, edges = traces.jgf(spark.createDataFrame([(text % body,)], "json string"))
    assert [(r.id, r.x, r.y) for r in nodes.orderBy("ord").collect()] == [("1", 2.5, 1.0), ("2", 1.0, 1.0)]
    assert sorted(r.weight for r in edges.collect()) == [0.0, 0.5]
    keyed = spark.createDataFrame([('{"graph": {"nodes": {"7": {"label": "n"}}, "edges": []}}',)], "json string")
    assert traces.jgf(keyed)[0].first().id == "7"
    with pytest.raises(ValueError):
        traces.jgf(spark.createDataFrame([("{}",)], "json string"))


def test_roi_zip(spark, tmp_path):
    rois = [traces.encode_roi("polygon", [3, 9, 6], [2, 2, 8]), traces.encode_roi("rect", left=1, top=2, width=3, height=4), traces.encode_roi("oval", left=5, top=6, width=7, height=8)]
    buf = io.BytesIO()
    with zipfile.ZipFile(buf, "w") as z:
        for i, r in enumerate(rois, 1):
            z.writestr(f"{i:04d}.roi", r)
    (tmp_path / "r.zip").write_bytes(buf.getvalue())
    got = traces.roi_zip(spark, str(tmp_path / "r.zip")).orderBy("roi_id").collect()
    assert [(r.name, r.kind) for r in got] == [("0001", "polygon"), ("0002", "rect"), ("0003", "oval")]
    assert got[0].xs == [3, 9, 6] and got[0].ys == [2, 2, 8] and (got[2].left, got[2].height) == (5, 8)


def test_pipeline(tmp_path):
    log, ran = [], []
    mods = {
        "a": Module("a", lambda p: {"out": 1, "none": ""}),
        "b": Module("b", lambda p, ctx: ran.append((p["x"], ctx.get("a.out"))) or {"y": 2}, [{"name": "x", "required": True}], {"x": "a.out"}),
        "c": Module("c", lambda p: 1 / 0),
    }
    ctx = Context()
    assert execute(["a", "b"], mods, {}, ctx) and ran == [(1, 1)] and ctx.values["a"] == {"out": 1}
    assert not execute(["a", "c", "b"], mods, {}, Context(), log=log.append) and "c: division" in log[-1]
    assert not execute(["b"], mods, {}, Context(), own_links={"b": {"x": ""}}, log=log.append)
    assert effective_links({"x": "a.out"}, {"x": ""}) == {} and configured(mods["b"], {}, {"x": "a.out"})
    assert not configured(mods["b"], {"x": ""}, {}) and ctx.get("nodot") is None and ctx.get("") is None
    ctx.save(tmp_path / "c.json")
    assert Context.load(tmp_path / "c.json").values == ctx.values
    config = {"a": {"enabled": True, "execution_order": 2}, "b": {"enabled": True, "execution_order": 1}}
    assert ordered(config, mods) == ["b", "a"] and compacted(config, "b")["a"]["execution_order"] == 1
    with pytest.raises(ValueError):
        ordered({"a": {"enabled": True}}, mods)
