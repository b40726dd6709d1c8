"""Operator 11 against whole products of all pairs."""

import math

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from tidewater.llm import norm_buckets
from tidewater.llm.queries import ORACLES, QUERIES

ROWS = "vec_id bigint, embedding array<double>, label string, range int, block string, n int"


def brute(rows, k, every, scale=64):
    """Results by (query, its vector), in whole numbers of any size; scores are held within 64 bits."""
    held = lambda x: max(-(2**63), min(2**63 - 1, x))
    good = {(i, tuple(held(math.floor(x * scale)) for x in v)) for i, v in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)}
    out = []
    for i, v in good:
        if i % every == 0:
            found = sorted((-held(sum(a * b for a, b in zip(v, w, strict=True))), j) for j, w in good if j != i and len(w) == len(v))
            out += [(i, rank, j, -s) for rank, (s, j) in enumerate(found[:k], 1)]
    return sorted(out)


def given(spark, rows):
    return spark.createDataFrame([(i, v, "l", 1, "b", 2) for i, v in rows], ROWS)


def found(spark, rows, k, every):
    out = norm_buckets.search(given(spark, rows).repartition(3), F.col("vec_id") % every == 0, k)
    return sorted((r.query_id, r.rank, r.vec_id, r.score) for r in out.collect())


@pytest.fixture
def small(monkeypatch):
    for name, n in (("BUCKET", 16), ("RANGE", 60), ("QUERIES", 7), ("HEADS", 1)):
        monkeypatch.setattr(norm_buckets, name, n)


def test_against_brute_force(spark, small):
    rng = np.random.default_rng(5)
    clusters = rng.normal(size=(6, 12))
    rows = [(i, (clusters[i % 6] * (1 + i % 5) + 0.05 * rng.normal(size=12)).tolist()) for i in range(300)]
    rows += [(300 + i, (rng.normal(size=12) * 10 ** rng.uniform(-3, 1)).tolist()) for i in range(200)]
    rows += [(600, [0.0] * 12), (601, None), (602, [None] * 12), (603, [math.inf] * 12), (604, [math.nan] * 12), (None, [1.0] * 12)]
    rows += [(700 + i, [1.0, 2.0]) for i in range(40)] + [(800, []), (840, []), (20, rows[20][1]), (40, [1.0] * 12)]
    assert found(spark, rows, 5, 20) == brute(rows, 5, 20)


def test_negative_large_and_few(spark, small):
    """Scores below zero (no length prunes), components beyond 53 and 64 bits, fewer candidates than k."""
    opposed = [(i, [float(-i - 1), 0.0]) for i in range(50)] + [(100, [1.0, 0.0])]
    assert found(spark, opposed, 3, 100) == brute(opposed, 3, 100)
    large = [(i, [10.0 ** (i % 20), -1.0, float(i)]) for i in range(60)]
    assert found(spark, large, 4, 20) == brute(large, 4, 20)
    few = [(20, [1.0, 0.5]), (1, [0.25, 0.25]), (2, [0.25, 0.25])]
    assert found(spark, few, 20, 20) == [(20, 1, 1, 16 * 64 + 16 * 32), (20, 2, 2, 16 * 64 + 16 * 32)]
    assert found(spark, [], 20, 20) == []


def test_both_prunings_occur(monkeypatch):
    """A query near its own direction prunes by coordinates, one without a near vector by length; both are exact."""
    rng = np.random.default_rng(3)
    m = np.floor(64 * rng.normal(size=(400, 16))).astype(np.int64)
    m[0] = 0
    m[0, :3] = (900, -700, 300)
    m[1:30] = m[0] + rng.integers(-3, 4, size=(29, 16))
    m = m[np.argsort(-(m.astype(float) ** 2).sum(1), kind="stable")]
    ids = np.arange(400)
    q = norm_buckets.Queries(ids[:40].copy(), m[:40])
    best = norm_buckets.Best(40, 5)
    for at in range(0, 400, 50):
        norm_buckets.search_bucket(q, best, ids[at : at + 50], m[at : at + 50])
    whole = m[:40] @ m.T
    for i in range(40):
        want = sorted((-int(s), j) for j, s in enumerate(whole[i]) if j != i)[:5]
        mine = best.at == i
        assert sorted(zip(-best.scores[mine].astype(int), best.ids[mine], strict=True)) == want


@pytest.mark.parametrize("sf", ["/root/testdata/sf0.001"])
def test_query_equals_sql(spark, sf):
    c = duckdb.connect()
    c.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{sf}/embeddings.parquet'")
    want = sorted(c.execute(f"SELECT query_id, rank, vec_id, score FROM ({ORACLES['op11_norm_buckets']})").fetchall())
    got = sorted(tuple(r) for r in QUERIES["op11_norm_buckets"](spark, sf).select("query_id", "rank", "vec_id", "score").collect())
    assert got == want and got
