import shutil
import subprocess
import sys
from pathlib import Path

import duckdb
import pytest

import __spark_entry__ as entry

ROOT = Path(__file__).resolve().parents[1]
SMALL = Path("/root/testdata/sf0.001")


def test_oracles_belong_to_queries():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_core_stands_alone(tmp_path):
    """Without the training-data subpackage the rest imports, and its queries are gone."""
    shutil.copytree(ROOT / "lodestrata", tmp_path / "lodestrata", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(ROOT / "__spark_entry__.py", tmp_path)
    out = subprocess.run([sys.executable, "-c", "import __spark_entry__ as e; print(*e.queries())"], cwd=tmp_path, capture_output=True, text=True, env={"PATH": "/usr/bin:/bin"}, check=True)
    names = out.stdout.split()
    assert "p3_found" in names and not any(n.startswith(("p1_", "p2_", "p5_", "p6_", "p7_", "p8_")) for n in names)


def test_nothing_else_imports_it():
    for f in (ROOT / "lodestrata").rglob("*.py"):
        if "llm" not in f.relative_to(ROOT / "lodestrata").parts:
            assert "lodestrata.llm" not in f.read_text()


@pytest.mark.skipif(not SMALL.exists(), reason="no test tables")
@pytest.mark.parametrize("name", ["p3_found", "p3_report", "pr4_last_by_key", "j1_ranked_resolution", "j14_outermost", "a8_pass_rates", "w2_token_budget", "g9_order", "b2_batches", "t5_search", "x8_value_rows"])
def test_against_oracle(spark, name):
    con = duckdb.connect()
    for p in SMALL.glob("*.parquet"):
        con.execute(f"create view {p.stem} as select * from '{p}'")
    df = entry.queries()[name](spark, str(SMALL))
    cur = con.execute(entry.oracle_sql()[name])
    cols = [d[0] for d in cur.description]
    show = lambda v: f"{v:.9g}" if isinstance(v, float) else repr(v)
    assert sorted(cols) == sorted(df.columns)
    assert sorted(tuple(map(show, r)) for r in df.select(*cols).collect()) == sorted(tuple(map(show, r)) for r in cur.fetchall())
