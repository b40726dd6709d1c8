"""Factor pricing on planted premia, breaks of correlations, and what follows from a scan."""

import datetime as dt
import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidewater.operators import detect, pricing

REGISTRY = "name string, series_id string, how string, scale double"


def month(n):
    return dt.date(1990 + n // 12, n % 12 + 1, 1)


def long(spark, columns):
    rows = [(name, month(i), None if v is None else float(v)) for name, x in columns.items() for i, v in enumerate(x)]
    return spark.createDataFrame(rows, "series_id string, date date, value double")


def test_returns_and_shocks(spark):
    rng = np.random.default_rng(0)
    price, rate, cpi = np.exp(np.cumsum(rng.normal(size=40)) / 10), rng.normal(size=40), 100 + np.cumsum(rng.random(40))
    obs = long(spark, {"p": price, "y": rate, "c": cpi, "neg": -price, "short": price[:24]})
    registry = spark.createDataFrame([("eq", "p", "log", 1.0), ("bond", "y", "diff", -8.5), ("bad", "neg", "log", 1.0), ("new", "short", "log", 1.0)], REGISTRY)
    got = {}
    for r in pricing.asset_returns(obs, registry).collect():
        got.setdefault(r.asset, {})[r.date] = r.ret
    assert sorted(got) == ["bond", "eq"] and len(got["eq"]) == 39
    assert [got["eq"][month(i)] for i in (1, 39)] == pytest.approx([100 * np.log(price[i] / price[i - 1]) for i in (1, 39)])
    assert got["bond"][month(7)] == pytest.approx(-8.5 * (rate[7] - rate[6]))
    shocks = {r.date: r.shock for r in pricing.factor_shocks(obs, spark.createDataFrame([("inf", "c", "surprise", 1.0)], REGISTRY)).collect()}
    change = 100 * (cpi[1:] / cpi[:-1] - 1)
    assert min(shocks) == month(6) and shocks[month(6)] == pytest.approx(change[5] - change[:6].mean())
    assert shocks[month(30)] == pytest.approx(change[29] - change[18:30].mean())


def panel_of(spark, premium, months=120, assets=14, noise=0.2):
    """Assets whose mean return is the premium times their beta; the premium may differ by month."""
    rng = np.random.default_rng(4)
    f, beta = rng.normal(size=months), np.linspace(-1, 2, assets)
    f = f - f.mean()
    rows = [(f"a{k:02d}", month(i), float(beta[k] * (premium(i) + f[i]) + noise * rng.normal()), float(f[i])) for i in range(months) for k in range(assets)]
    return spark.createDataFrame(rows, "asset string, date date, ret double, f double")


def test_planted_premium_and_flip(spark):
    splits = {"early": F.col("date") < F.lit(month(60)), "late": F.col("date") >= F.lit(month(60)), "tiny": F.col("date") < F.lit(month(10))}
    steady = panel_of(spark, lambda i: 0.8)
    prices = {r["sample"]: r for r in pricing.premia(steady, ["f"], splits).collect()}
    assert sorted(prices) == ["early", "full", "late"] and prices["full"].n_obs == 120 and prices["early"].n_obs == 60
    assert prices["full"].premium == pytest.approx(0.8, abs=0.1) and prices["full"].t_shanken > 10
    found = pricing.factor_pricing(steady, ["f"], splits, [("early", "late"), ("early", "tiny")]).collect()
    full = next(r for r in found if r.window == "full")
    assert full.kind == "cross_asset_factor" and full.score == 1.0 and full.date == month(119)
    assert json.loads(full.evidence)["factors"][0]["term"] == "f"
    flip = panel_of(spark, lambda i: 0.8 if i < 60 else -0.8)
    diff = {r.comparison: r for r in pricing.differences(pricing.premia(flip, ["f"], splits), [("early", "late")]).collect()}["early_vs_late"]
    assert diff.premium_a > 0 > diff.premium_b and diff.t_diff > 5
    assert {r.window for r in pricing.factor_pricing(flip, ["f"], splits, [("early", "late")], t=5.0).collect()} == {"early_vs_late"}


def test_panel_keeps_whole_dates(spark):
    returns = spark.createDataFrame([("a", month(1), 1.0), ("b", month(1), 2.0), ("a", month(2), 1.0), ("a", month(3), 1.0), ("b", month(3), 1.0)], "asset string, date date, ret double")
    shocks = spark.createDataFrame([("f", month(1), 1.0), ("g", month(1), 2.0), ("f", month(2), 1.0), ("g", month(2), 1.0), ("f", month(3), 1.0)], "factor string, date date, shock double")
    assert sorted((r.asset, r.date, r.f, r.g) for r in pricing.pricing_panel(returns, shocks, ["f", "g"]).collect()) == [("a", month(1), 1.0, 2.0), ("b", month(1), 1.0, 2.0)]


def test_correlation_breaks_dated(spark):
    """Changes that go together for sixteen years and apart afterwards."""
    rng = np.random.default_rng(6)
    x, e = rng.normal(size=240), rng.normal(size=240)
    a, b = np.cumsum(x), np.cumsum(np.where(np.arange(240) < 195, x, -x) + 0.2 * e)
    p = spark.createDataFrame([("p", month(i), float(a[i]), float(b[i])) for i in range(240)] + [("q", month(i), float(a[i]), float(b[i])) for i in range(30)], "pair_id string, date date, a double, b double")
    hit = detect.correlation_breaks(p, 12).collect()
    assert [r.key for r in hit] == ["p"] and abs((hit[0].date - month(200)).days) < 300 and json.loads(hit[0].evidence)["move"] < -1


def test_one_hit_for_a_curve(spark):
    factors = long(spark, {"level": range(40), "slope": [0.1 * (i % 5) for i in range(40)], "curvature": [1.0] * 38 + [2.0, 1.0]})
    hit = detect.curve_extreme(factors).collect()
    assert [(r.kind, r.key) for r in hit] == [("curve_factor_extreme", "curve")] and "level" in json.loads(hit[0].evidence)["extremes"]
    assert detect.curve_extreme(factors, least=41).collect() == []


def test_follow_ups_by_what_triggers_name(spark):
    found = spark.createDataFrame([("a", "x"), ("a", "x"), ("a", "y"), ("b", "x"), (None, "x")], "kind string, key string")
    triggers = spark.createDataFrame([("both", "a", "x", 3), ("kind", "a", None, 2), ("key", None, "x", 2), ("any", None, None, 9), ("both", "b", "x", 1), ("no", "c", None, 1)], "question string, kind string, key string, priority int")
    got = {r.question: (r.priority, r.raised_by) for r in detect.follow_ups(found, triggers).collect()}
    assert got == {"both": (1, 3), "kind": (2, 3), "key": (2, 4), "any": (9, 5)}


def test_scan_is_followed_through(spark):
    found = detect.notable_move(long(spark, {"s": [*np.sin(np.arange(80)), 9.0]}))
    snapshot = spark.createDataFrame([("s", 9.0, month(80), 5.0, 1.0)], "series_id string, value double, date date, z_full double, pct_10y double")
    triggers = spark.createDataFrame([("why", None, "s", 1)], "question string, kind string, key string, priority int")
    out = detect.follow_through(found, snapshot, triggers, F.lit(dt.date(2024, 1, 1)))
    assert {k: v.count() for k, v in out.items()} == {"hits": 2, "follow_ups": 1, "findings": 2, "seeds": 2, "stats": 2}
