import duckdb
import pytest

SF = "/root/testdata/sf0.001"
NAMES = ["active_traces", "gap_filled", "node_strength", "spike_table", "bandpass_traces", "node_positions"]


@pytest.mark.parametrize("name", NAMES)
def test_queries_match_sql(spark, name):
    import __spark_entry__ as e

    got = e.queries()[name](spark, SF).toPandas()
    c = duckdb.connect()
    for t in ("events", "embeddings", "supplier"):
        c.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    want = c.sql(e.oracle_sql()[name]).df()
    cols = sorted(got.columns)
    assert cols == sorted(want.columns) and len(got) == len(want)
    norm = lambda d: d[cols].sort_values(cols).reset_index(drop=True).round(6).astype(str)
    assert (norm(got) == norm(want)).all().all()


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())


def test_entry_without_the_llm_folders(tmp_path):
    """A checkout without them still imports and lists the other queries."""
    import shutil
    import subprocess
    import sys
    from pathlib import Path

    root = Path(__file__).resolve().parents[1]
    shutil.copytree(root / "fluora", tmp_path / "fluora", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(root / "__spark_entry__.py", tmp_path)
    run = subprocess.run([sys.executable, "-c", "import __spark_entry__ as e; print(sorted(e.queries()))"], cwd=tmp_path, env={"PATH": "/usr/bin:/bin"}, capture_output=True, text=True, check=True)
    assert "active_traces" in run.stdout and "op1_mixing" not in run.stdout
