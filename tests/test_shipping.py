"""Code that runs inside tasks must not need the package where the tasks run, nor the rest the training-data operators."""

import os
import shutil
import subprocess
import sys
from pathlib import Path

ROOT = Path(__file__).resolve().parents[1]
SCRIPT = """
import sys
sys.path.append(sys.argv[1])
from tariffspark.session import build_session
spark = build_session("local[2]", "shipping", **{"spark.sql.shuffle.partitions": "2", "spark.ui.enabled": "false", "spark.checkpoint.dir": sys.argv[2]})
import __spark_entry__ as entry
def visible(_):
    import importlib.util
    return [importlib.util.find_spec("tariffspark") is not None]
print("SEEN", spark.sparkContext.parallelize([0], 1).flatMap(visible).collect())
print("ROWS", entry.queries()["price_grid_search"](spark, "/root/testdata/sf0.001").count())
"""


def test_grid_search_runs_where_the_package_is_absent(tmp_path):
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    env["PYSPARK_PYTHON"] = sys.executable
    out = subprocess.run([sys.executable, "-c", SCRIPT, str(ROOT), f"file://{tmp_path}/shared"], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=300)
    assert "ROWS" in out.stdout, out.stderr[-2000:]
    assert "SEEN [False]" in out.stdout


WITHOUT = """
import sys
import __spark_entry__ as entry
assert not entry.EXTRA and "pipeline" not in entry.queries() and not any(name.startswith("op") for name in entry.queries())
print("NAMES", len(entry.queries()), len(entry.oracle_sql()))
"""


def test_the_rest_works_without_the_training_data_operators(tmp_path):
    skip = shutil.ignore_patterns("llm", "__pycache__", ".git")
    for name in ("tariffspark", "tests"):
        shutil.copytree(ROOT / name, tmp_path / name, ignore=skip)
    for name in ("__spark_entry__.py", "corpus_pipeline.py"):
        if (ROOT / name).exists():
            shutil.copy(ROOT / name, tmp_path / name)
    out = subprocess.run([sys.executable, "-c", WITHOUT], cwd=tmp_path, capture_output=True, text=True, timeout=120)
    assert "NAMES" in out.stdout, out.stderr[-2000:]
    found = subprocess.run([sys.executable, "-m", "pytest", "tests", "--collect-only", "-q"], cwd=tmp_path, capture_output=True, text=True, timeout=120)
    assert found.returncode == 0, found.stdout[-2000:]


def test_wide_tables_are_screened_whole(spark):
    from tariffspark.operators.leakage import leakage_watchlist

    columns = [f"x{i}" for i in range(230)]
    rows = [tuple(float((r * 7 + i) % 11) for i in range(230)) + (r % 2,) for r in range(60)]
    df = spark.createDataFrame(rows, ", ".join(f"{c} double" for c in columns) + ", is_claim int")
    assert leakage_watchlist(df).count() == 230


def test_large_contracts_stay_in_the_histogram(spark):
    from tariffspark.operators.profile import contract_size_histogram

    df = spark.createDataFrame([(1,)] * 40 + [(2,)] * 3, "contract_number long")
    assert {(r["bin"], r["n"]) for r in contract_size_histogram(df).collect()} == {(3, 1), (23, 1)}
