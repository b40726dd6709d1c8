"""Operators that work by blocks, bins or sorted histories against plain definitions."""

import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidewater.operators import align, expanding, panel

DAY = dt.date(1950, 1, 1)


def day(n):
    return DAY + dt.timedelta(int(n))


@pytest.mark.parametrize("kind", ["noise", "ties", "rising", "constant"])
def test_history_stats(kind):
    rng = np.random.default_rng(2)
    x = {"noise": rng.normal(size=300), "ties": rng.integers(0, 4, 300) * 1.0, "rising": np.arange(300.0), "constant": np.full(300, 7.0)}[kind]
    for t, (med, mad, below) in enumerate(expanding.history_stats(x.tolist(), 1), 1):
        h = x[:t]
        assert med == np.median(h) and mad == pytest.approx(np.median(np.abs(h - np.median(h)))) and below == np.mean(h < x[t - 1])


def test_expanding_leaves_missing_out_and_pairs_nothing(spark):
    rows = [("s", day(i), None if i % 5 == 0 else float(i % 7)) for i in range(60)] + [("short", day(i), 1.0) for i in range(10)]
    obs = spark.createDataFrame(rows, "series_id string, date date, value double")
    out = expanding.expanding(obs)
    assert "Join" not in out._jdf.queryExecution().toString()
    got = {r.date: (r.robust_z, r.percentile) for r in out.collect()}
    full = [(d, v) for s, d, v in rows if s == "s" and v is not None]
    assert len(got) == len(full) - 23
    for t in range(23, len(full)):
        h = np.array([v for _, v in full[: t + 1]])
        mad = np.median(np.abs(h - np.median(h)))
        assert got[full[t][0]] == pytest.approx(((h[-1] - np.median(h)) / max(1.4826 * mad, 1e-9), np.mean(h < h[-1])))
    assert expanding.expanding(obs.limit(0)).collect() == []


def test_corr_matrix_by_tiles(spark, monkeypatch):
    """Several tiles of series and of days, gaps, constants, series that never meet."""
    monkeypatch.setattr(panel, "SERIES", 6)
    monkeypatch.setattr(panel, "DAYS", 50)
    rng = np.random.default_rng(0)
    x = np.cumsum(rng.normal(size=(230, 25)), axis=0) + 1e4
    x[rng.random(x.shape) < 0.3] = np.nan
    x[:, 3] = np.where(np.isnan(x[:, 3]), np.nan, 5.0)
    x[:, 4], x[:, 5] = np.where(np.arange(230) < 100, x[:, 4], np.nan), np.where(np.arange(230) >= 100, x[:, 5], np.nan)
    rows = [(f"s{j:02d}", day(i), None if np.isnan(x[i, j]) else float(x[i, j])) for i in range(230) for j in range(25)]
    got = {(r.a, r.b): (r.n, r.correlation) for r in panel.corr_matrix(spark.createDataFrame(rows, "series_id string, date date, value double")).collect()}
    for i in range(25):
        for j in range(i + 1, 25):
            both = ~np.isnan(x[:, i]) & ~np.isnan(x[:, j])
            if not both.any():
                assert (f"s{i:02d}", f"s{j:02d}") not in got
                continue
            n, r = got.pop((f"s{i:02d}", f"s{j:02d}"))
            assert n == both.sum()
            assert r is None if 3 in (i, j) else r == pytest.approx(np.corrcoef(x[both, i], x[both, j])[0, 1], abs=1e-9)
    assert not got


def test_corr_matrix_shuffles_no_pairs(spark, monkeypatch):
    """Many tiles and groups, blocks of dates in one task: rows are exchanged before they become pairs, never after."""
    monkeypatch.setattr(panel, "SERIES", 3)
    monkeypatch.setattr(panel, "DAYS", 20)
    x = np.random.default_rng(1).normal(size=(50, 40))
    obs = spark.createDataFrame([(f"é{j}" if j % 2 else f"z{j}", day(i), float(x[i, j])) for i in range(50) for j in range(40)], "series_id string, date date, value double")
    out = panel.corr_matrix(obs)
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert "MapInArrow" in plan and not any(k in plan[: plan.index("MapInArrow")] for k in ("Repartition", "Aggregate", "Join", "Sort"))
    got = {(r.a, r.b): r.correlation for r in out.collect()}
    name = lambda j: f"é{j}" if j % 2 else f"z{j}"
    assert len(got) == 40 * 39 / 2
    for i in range(40):
        for j in range(i):
            assert got[min(name(i), name(j)), max(name(i), name(j))] == pytest.approx(np.corrcoef(x[:, i], x[:, j])[0, 1], abs=1e-9)
    assert panel.corr_matrix(obs.limit(0)).collect() == []


def shuffled(spark, run):
    """Bytes that run() writes for shuffles."""
    sc = spark.sparkContext
    bus, store, gateway = sc._jsc.sc().listenerBus(), sc._jsc.sc().statusStore(), sc._gateway

    def total():
        bus.waitUntilEmpty(30_000)
        stages = store.stageList(None, False, False, gateway.new_array(gateway.jvm.double, 0), gateway.jvm.java.util.ArrayList())
        return {(s.stageId(), s.attemptId()): s.shuffleWriteBytes() for s in (stages.apply(k) for k in range(stages.size()))}

    before = total()
    run()
    return sum(v for k, v in total().items() if k not in before)


def test_corr_matrix_stores_blocks_once(spark, monkeypatch):
    """Four times the series, so sixteen times the pairs, shuffle about four times the bytes, however few values a block may have."""
    monkeypatch.setattr(panel, "SERIES", 4)
    monkeypatch.setattr(panel, "CELLS", 500)
    x = np.random.default_rng(3).normal(size=(50, 240))
    obs = spark.createDataFrame([(f"s{j:03d}", j, day(i), float(x[i, j])) for i in range(50) for j in range(240)], "series_id string, j int, date date, value double").localCheckpoint()
    made = {}
    few, many = (shuffled(spark, lambda n=n: made.update({n: panel.corr_matrix(obs.filter(F.col("j") < n)).collect()})) for n in (60, 240))
    assert 0 < many < 6 * few
    want = np.corrcoef(x.T)
    for n, got in made.items():
        assert len({(r.a, r.b) for r in got}) == len(got) == n * (n - 1) / 2
        assert all(r.a < r.b and r.n == 50 and r.correlation == pytest.approx(want[int(r.a[1:]), int(r.b[1:])], abs=1e-9) for r in got)


def test_corr_matrix_of_repeated_and_negative_places(spark, monkeypatch):
    """The last by value of a place counts; series that share a few tiles alone; blocks smaller than their series by values."""
    monkeypatch.setattr(panel, "DAYS", 10)
    monkeypatch.setattr(panel, "CELLS", 40)
    rng = np.random.default_rng(4)
    held = {f"s{j}": {int(t): float(v) for t, v in zip(rng.choice(np.arange(-60 + 15 * j, 40 + 15 * j), 30, False), rng.normal(size=30), strict=True)} for j in range(9)}
    rows = [(s, t, v - d) for s, at in held.items() for t, v in at.items() for d in (0.0, 1.0)] + [("s0", None, 1.0), (None, 1, 1.0), ("s1", 500, None), ("lone", 10**6, 1.0)]
    got = {(r.a, r.b): (r.n, r.correlation) for r in panel.corr_matrix(spark.createDataFrame(rows, "name string, place bigint, value double"), "place", "name").collect()}
    for a in held:
        for b in held:
            both = sorted(held[a].keys() & held[b].keys())
            if a < b and both:
                n, r = got.pop((a, b))
                u, v = ([held[s][t] for t in both] for s in (a, b))
                assert n == len(both) and (r is None if n == 1 else r == pytest.approx(np.corrcoef(u, v)[0, 1], abs=1e-9))
    assert not got


def test_within_intervals_of_all_lengths(spark):
    rng = np.random.default_rng(7)
    starts, lengths = rng.integers(-20_000, 40_000, 80), np.r_[rng.integers(0, 3, 30), rng.integers(0, 900, 30), rng.integers(0, 60_000, 20)]
    spans = [(f"i{k}", day(a), day(a + n)) for k, (a, n) in enumerate(zip(starts, lengths, strict=True))] + [("back", day(9), day(3)), ("none", None, day(3))]
    dates = [day(d) for d in rng.integers(-21_000, 60_000, 300)] + [spans[0][1], spans[0][2], None]
    obs = spark.createDataFrame([(n, d, "x") for n, d in enumerate(dates)], "n int, date date, level string")
    out = align.within(obs, spark.createDataFrame(spans, "name string, start_date date, end_date date"))
    got = sorted((r.n, r.name) for r in out.select("n", "name").collect())
    assert got == sorted((n, k) for n, d in enumerate(dates) if d for k, a, b in spans if a and a <= d <= b)
    bins = spark.range(1).select(F.size(align._bins(F.lit(5), F.lit(20_005)))).first()[0]
    assert bins <= 14 * 5


def test_periods_from_each_series_first(spark):
    """2024-01-03 is a Wednesday: two-week periods end on 5 and 19 January for one series and on the 12th and 26th for another."""
    start = dt.date(2024, 1, 3)
    rows = [(s, start + dt.timedelta(off + i), float(i)) for s, off in (("a", 0), ("b", 7)) for i in range(20)] + [("c", dt.date(2024, m, 15), float(m)) for m in range(5, 13)]
    obs = spark.createDataFrame(rows, "series_id string, date date, value double")
    got = {}
    for r in align.downsample(obs, "BW", anchored=True).orderBy("date").collect():
        got.setdefault(r.series_id, []).append((r.date.day, r.value))
    assert got["a"] == [(5, 2.0), (19, 16.0), (2, 19.0)] and got["b"] == [(12, 2.0), (26, 16.0), (9, 19.0)]
    half = sorted((r.date, r.value) for r in align.downsample(obs.filter("series_id = 'c'"), "SA", "mean", anchored=True).collect())
    assert half == [(dt.date(2024, 4, 1), 7.0), (dt.date(2024, 10, 1), 11.0)]
