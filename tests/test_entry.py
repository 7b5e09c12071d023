"""Driver contract: entry() on sf0.001; registry and oracle keys; a few
queries compared with their SQL on sf0.001 through DuckDB."""
import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

import __spark_entry__ as e  # noqa: E402
from checks.compare import digest, duck  # noqa: E402
from segmetrics.plans.catalog import QUERIES  # noqa: E402
from tests.conftest import SF001  # noqa: E402


def test_entry_runs(spark):
    df = e.entry(spark)
    assert df.columns == ["location_type", "location_value", "house_type", "tenure", "size_band",
                          "year_built_band", "line_graph", "heatmap_graph", "sale_count"]
    assert df.count() > 0


def test_registry():
    qs, sql = e.queries(), e.oracle_sql()
    assert set(sql) <= set(qs)
    assert len(qs) >= 51
    assert set(QUERIES) <= set(sql)
    assert "reserved_values" in sql


@pytest.mark.parametrize("name", ["clean_sales", "repeat_sales", "line_agg", "heatmap_agg", "dimension_index",
                                  "query_heatmap", "merge_line", "heatmap_grid"])
def test_oracle_small(spark, name):
    df = e.queries()[name](spark, SF001)
    rows = [tuple(r) for r in df.collect()]
    res = duck(SF001).execute(e.oracle_sql()[name])
    drows = res.fetchall()
    dcols = [d[0] for d in res.description]
    assert sorted(df.columns) == sorted(dcols)
    assert digest(rows, df.columns)[0] == digest(drows, dcols)[0]


def test_only_the_absence_of_the_optional_part_passes(tmp_path):
    """Without the two folders the rest registers; a fault inside raises."""
    import shutil
    import subprocess

    here = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    for name in ("segmetrics", "checks"):
        shutil.copytree(f"{here}/{name}", tmp_path / name, ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(f"{here}/__spark_entry__.py", tmp_path)
    run = lambda: subprocess.run([sys.executable, "-c", "import __spark_entry__ as e; print(len(e.queries()))"],
                                 cwd=tmp_path, capture_output=True, text=True)
    assert run().stdout.strip() == str(len(QUERIES))
    if os.path.exists(f"{here}/corpus_pipeline.py"):
        shutil.copy(f"{here}/corpus_pipeline.py", tmp_path)
        assert run().stdout.strip() == str(len(QUERIES))
    (tmp_path / "corpus_pipeline.py").write_text("import no_such_module")
    assert "no_such_module" in run().stderr
