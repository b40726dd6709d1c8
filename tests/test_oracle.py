"""Every registered query with SQL against that SQL in DuckDB, on the smallest tables."""

import glob
import math
import os

import duckdb
import pytest

import __spark_entry__ as entry
from tidewater.plans.registry import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


def plain(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return None
    if isinstance(v, float):
        return round(v, 5)
    return str(v)[:10] if hasattr(v, "year") else v


@pytest.fixture(scope="module")
def db():
    c = duckdb.connect()
    for p in glob.glob(f"{SF}/*.parquet"):
        c.execute(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM '{p}'")
    return c


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_sql(spark, db, name):
    df = QUERIES[name](spark, SF)
    cols = sorted(df.columns)
    got = sorted((tuple(plain(r[c]) for c in cols) for r in df.collect()), key=str)
    res = db.execute(ORACLES[name])
    names = [d[0] for d in res.description]
    assert sorted(names) == cols
    want = sorted((tuple(plain(r[names.index(c)]) for c in cols) for r in res.fetchall()), key=str)
    assert len(got) == len(want)
    for g, w in zip(got, want, strict=True):
        for x, y in zip(g, w, strict=True):
            assert x == y or (isinstance(x, float) and isinstance(y, float) and math.isclose(x, y, rel_tol=1e-6, abs_tol=2e-5)), (g, w)


def test_formatted_levels_of_thousands(spark, tmp_path):
    """Orders so large that monthly levels pass a thousand."""
    c = duckdb.connect()
    c.execute(f"COPY (SELECT * REPLACE (o_totalprice * 6000 AS o_totalprice) FROM '{SF}/orders.parquet') TO '{tmp_path}/orders.parquet'")
    c.execute(f"CREATE VIEW orders AS SELECT * FROM '{tmp_path}/orders.parquet'")
    df = QUERIES["formatted_levels"](spark, str(tmp_path))
    cols = ", ".join(f'"{n}"' for n in df.columns)
    want = c.execute(f"SELECT {cols} FROM ({ORACLES['formatted_levels']})").fetchall()
    got = [tuple(r) for r in df.collect()]
    assert any("," in r[df.columns.index("level")] for r in got)
    assert sorted(got, key=str) == sorted(want, key=str)


def test_scan_reads_its_inputs_once(spark):
    """The detectors read written inputs; the tables that these come from are not read again for each of them."""
    out = QUERIES["scan"](spark, SF)
    assert out.inputFiles() and not any(SF in f for f in out.inputFiles())


def test_entry_and_rows_only_queries(spark):
    assert entry.entry(spark).count() > 0
    for name in ("hac_ols", "pca_loadings", "fama_macbeth", "content_hash"):
        assert QUERIES[name](spark, SF).count() > 0
