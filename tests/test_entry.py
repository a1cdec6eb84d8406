"""The driver's entry module: a few queries against their SQL, and imports without the optional subpackage."""

import os
import shutil
import subprocess
import sys
from pathlib import Path

import duckdb
import pandas as pd
import pytest

ROOT, DATA = Path(__file__).resolve().parents[1], Path("/root/testdata/sf0.001")
NAMES = ("seq_subset_negative", "spectrum_er_norm_k3", "gappy_er_annotated", "mismatch_er_presence", "km_dist_linear", "km_pair_tppk", "predict_linear", "profile_motif", "metrics_multiclass", "cv_folds_grouped")


def test_imports_without_the_subpackage(tmp_path):
    for name in ("__spark_entry__.py", "helixframe"):
        source = ROOT / name
        (shutil.copytree if source.is_dir() else shutil.copy)(source, tmp_path / name)
    shutil.rmtree(tmp_path / "helixframe" / "llm", ignore_errors=True)
    code = "import __spark_entry__ as e; q, o = e.queries(), e.oracle_sql(); assert set(o) <= set(q) and 'km_spectrum' in q; print(len(q))"
    out = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, capture_output=True, text=True, env=os.environ | {"PYTHONPATH": str(tmp_path)})
    assert out.returncode == 0 and int(out.stdout) > 80, out.stderr


@pytest.mark.skipif(not DATA.exists(), reason="the driver's tables aren't here")
@pytest.mark.parametrize("name", NAMES)
def test_query_against_sql(spark, name):
    from helixframe.plans import catalogue

    connection = duckdb.connect()
    for table in ("documents", "benchmark", "labels", "embeddings", "nation", "region"):
        connection.execute(f"CREATE VIEW {table} AS SELECT * FROM '{DATA}/{table}.parquet'")
    got, want = catalogue.QUERIES[name](spark, str(DATA)).toPandas(), connection.execute(catalogue.ORACLES[name]).df()
    columns = sorted(got.columns)
    assert columns == sorted(want.columns) and len(got) == len(want) > 0
    order = lambda df: df[columns].sort_values(columns).reset_index(drop=True)
    pd.testing.assert_frame_equal(order(got), order(want), check_dtype=False)
