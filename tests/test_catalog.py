"""Every query against its SQL on the smallest tables."""

import subprocess
import sys
from pathlib import Path

import duckdb
import numpy as np
import pandas as pd
import pytest

from weatherglass.plans import catalog

ROOT = str(Path(__file__).resolve().parents[1])
DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in ("events", "supplier"):
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return c


def plain(frame):
    out = frame[sorted(frame.columns)].copy()
    for c in out:
        if out[c].dtype == object:
            out[c] = out[c].map(lambda v: None if v is None or isinstance(v, float) and np.isnan(v) else str(v))
    return out.sort_values(list(out.columns), na_position="last").reset_index(drop=True)


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query(spark, con, name):
    got = catalog.QUERIES[name](spark, DATA).toPandas()
    if name in catalog.ORACLES:
        pd.testing.assert_frame_equal(plain(got), plain(con.execute(catalog.ORACLES[name]).df()), check_dtype=False, rtol=0, atol=1e-6)


def test_llm_part_is_optional():
    import __spark_entry__ as entry

    assert set(catalog.QUERIES) <= set(entry.queries()) and set(entry.oracle_sql()) <= set(entry.queries())
    # In an interpreter that can import neither of the optional parts.
    blocked = "import sys; sys.modules.update({'weatherglass.llm': None, 'corpus_pipeline': None}); import __spark_entry__ as e; print(*e.queries()); print(*e.oracle_sql())"
    names, told = subprocess.run([sys.executable, "-c", blocked], cwd=ROOT, capture_output=True, text=True, check=True).stdout.splitlines()[-2:]
    assert names.split() == list(catalog.QUERIES) and told.split() == list(catalog.ORACLES)


def test_tables_are_made_anew_when_their_files_change(spark, tmp_path):
    import shutil

    shutil.copytree(DATA, tmp_path / "in")
    first = catalog.Tables.of(spark, str(tmp_path / "in"))
    assert catalog.Tables.of(spark, str(tmp_path / "in")) is first
    spark.read.parquet(f"{DATA}/events.parquet").limit(10).write.parquet(str(tmp_path / "some"))
    shutil.rmtree(tmp_path / "in" / "events.parquet") if (tmp_path / "in" / "events.parquet").is_dir() else (tmp_path / "in" / "events.parquet").unlink()
    shutil.copytree(tmp_path / "some", tmp_path / "in" / "events.parquet")
    again = catalog.Tables.of(spark, str(tmp_path / "in"))
    assert again is not first and again.readings.count() == 10
