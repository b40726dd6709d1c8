"""Distribution functions against published tables, and estimators against numpy."""

import datetime as dt
from statistics import NormalDist

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidewater.functions import distributions as ds
from tidewater.operators import regression as rg


def month(n):
    return dt.date(1960 + n // 12, n % 12 + 1, 1)


def one(spark, rows, schema, *cols):
    return [tuple(r) for r in spark.createDataFrame(rows, schema).select(*cols).collect()]


def test_f_and_t_tables(spark):
    """Critical values as printed in tables: F at 5 % and 1 %, t at 5 % and 1 % of both tails."""
    f = [(161.4476, 1.0, 1.0, 0.05), (4.964603, 1.0, 10.0, 0.05), (3.708265, 3.0, 10.0, 0.05), (2.866081, 4.0, 20.0, 0.05), (6.552318, 3.0, 10.0, 0.01), (1.955758, 8.0, 150.0, 0.0556)]
    got = one(spark, f, "f double, a double, b double, p double", ds.f_tail(F.col("f"), F.col("a"), F.col("b")), "p")
    assert all(x == pytest.approx(p, abs=1e-6) for x, p in got[:5]) and got[5][0] == pytest.approx(got[5][1], abs=5e-3)
    t = [(12.7062047, 1.0, 0.05), (2.2281389, 10.0, 0.05), (2.7499957, 30.0, 0.01), (-1.9839715, 100.0, 0.05), (1.9599876, 100_000.0, 0.05)]
    got = one(spark, t, "t double, n double, p double", ds.t_tails(F.col("t"), F.col("n")), "p")
    assert all(x == pytest.approx(p, abs=5e-6) for x, p in got)
    ends = one(spark, [(0.0, 2.0, 3.0), (-1.0, 2.0, 3.0), (1e12, 2.0, 3.0), (None, 2.0, 3.0)], "f double, a double, b double", ds.f_tail(F.col("f"), F.col("a"), F.col("b")))
    assert ends[0] == (1.0,) and ends[1] == (1.0,) and ends[2][0] < 1e-12 and ends[3] == (None,)


def test_normal_quantile(spark):
    ps = [1e-9, 0.001, 0.02, 0.025, 0.1, 0.5, 0.84, 0.975, 0.99, 1 - 1e-6]
    got = one(spark, [(p,) for p in ps], "p double", ds.normal_quantile(F.col("p")))
    assert all(x == pytest.approx(NormalDist().inv_cdf(p), abs=1e-6) for (x,), p in zip(got, ps, strict=True))
    assert one(spark, [(0.0,), (1.0,), (None,)], "p double", ds.normal_quantile(F.col("p"))) == [(None,), (None,), (None,)]


def simpson_tail(f, a, b, n=200_000):
    """P(F > f) by numbers: the density of the beta distribution over an angle."""
    top = np.arcsin(np.sqrt(b / (b + a * f)))
    x = np.linspace(0, top, n + 1)
    y = np.sin(x) ** (b - 1) * np.cos(x) ** (a - 1)
    whole = np.linspace(0, np.pi / 2, n + 1)
    z = np.sin(whole) ** (b - 1) * np.cos(whole) ** (a - 1)
    area = lambda v, h: h / 3 * (v[0] + v[-1] + 4 * v[1:-1:2].sum() + 2 * v[2:-1:2].sum())
    return area(y, top / n) / area(z, np.pi / 2 / n)


def test_granger_p_values(spark):
    rng = np.random.default_rng(0)
    b = rng.normal(size=120)
    a = np.r_[0, 0.5 * b[:-1]] + rng.normal(size=120)
    p = spark.createDataFrame([("p", month(i), float(x), float(y)) for i, (x, y) in enumerate(zip(a, b, strict=True))], "pair_id string, date date, a double, b double")
    tests = rg.granger(p, 3)
    rows = {r.lag: r for r in tests.collect()}
    for lag in (1, 2, 3):
        own = [a[lag - k : 120 - k] for k in range(1, lag + 1)]
        other = [b[lag - k : 120 - k] for k in range(1, lag + 1)]
        rss = lambda cols, lag=lag: np.linalg.lstsq(np.c_[np.ones(120 - lag), np.array(cols).T], a[lag:], rcond=None)[1][0]
        full, df2 = rss(own + other), 120 - lag - 2 * lag - 1
        f = (rss(own) - full) / lag / (full / df2)
        assert rows[lag].f == pytest.approx(f) and rows[lag].df2 == df2
        assert rows[lag].p_value == pytest.approx(simpson_tail(f, lag, df2), abs=1e-7)
    least = rg.granger_minima(tests).collect()[0]
    assert least.min_p == min(r.p_value for r in rows.values()) < 0.01


def test_local_projection_rows_and_bands(spark):
    rng = np.random.default_rng(3)
    n = 24
    shock, y = rng.normal(size=n), rng.normal(size=n)
    d = spark.createDataFrame([("s", month(i), float(y[i]), float(shock[i])) for i in range(n)], "series_id string, date date, y double, shock double")
    out = {r.h: r for r in rg.local_projection(d, "y", "shock", horizons=12, lags=4).collect()}
    assert sorted(out) == list(range(13))
    for h, r in out.items():
        rows = [i for i in range(4, n - h)]
        assert r.n == len(rows)
        if len(rows) < 5 + 5:
            assert r.beta is None and r.lower is None
            continue
        x = np.array([[1.0, shock[i], *[y[i - k] for k in range(1, 5)]] for i in rows])
        t = np.array([y[i + h] for i in rows])
        beta = np.linalg.lstsq(x, t, rcond=None)[0]
        u = x * (t - x @ beta)[:, None]
        s = u.T @ u
        for k in range(1, min(12, len(rows) - 1) + 1):
            s += (1 - k / 13) * (u[k:].T @ u[:-k] + u[:-k].T @ u[k:])
        inv = np.linalg.inv(x.T @ x)
        se = np.sqrt((inv @ s @ inv)[1, 1])
        assert r.beta == pytest.approx(beta[1]) and r.se_robust == pytest.approx(se, rel=1e-6)
        assert (r.lower, r.upper) == pytest.approx((beta[1] - 1.959964 * se, beta[1] + 1.959964 * se), rel=1e-5)


def test_var_joint_moments(spark):
    rng = np.random.default_rng(5)
    n = 90
    v = np.zeros((n, 3))
    for i in range(1, n):
        v[i] = 0.5 * v[i - 1] + [0, 0.3 * v[i - 1, 0], 0] + rng.normal(size=3)
    d = spark.createDataFrame([("g", month(i), *map(float, v[i])) for i in range(n)], "panel_id string, date date, x double, y double, z double")
    rows = {(r.equation, r.term): r for r in rg.var_model(d, ["x", "y", "z"], 2).collect()}
    design = np.array([[1.0, *v[i - 1], *v[i - 2]] for i in range(2, n)])
    beta = np.linalg.lstsq(design, v[2:], rcond=None)[0]
    e = v[2:] - design @ beta
    sigma = e.T @ e / (n - 2)
    terms = ["const", *[f"{c}_l{i}" for i in (1, 2) for c in "xyz"]]
    inv = np.linalg.inv(design.T @ design)
    for k, c in enumerate("xyz"):
        for t, name in enumerate(terms):
            r = rows[(c, name)]
            assert r.beta == pytest.approx(beta[t, k]) and r.se == pytest.approx(np.sqrt(inv[t, t] * (e[:, k] @ e[:, k]) / (n - 2 - 7)))
        assert r.aic == pytest.approx(np.log(np.linalg.det(sigma)) + 2 / (n - 2) * 21) and r.n == n - 2
        assert r.forecast == pytest.approx(np.r_[1.0, v[-1], v[-2]] @ beta[:, k])
        assert r.resid_corr == pytest.approx(list(np.corrcoef(e.T)[k]), abs=0.01)


def test_onset_logit_by_key(spark):
    rng = np.random.default_rng(9)
    n = 150
    rows = []
    for key, size in (("a", n), ("b", n), ("short", 40), ("one", n)):
        x, z = rng.normal(size=size), rng.normal(size=size)
        for i in range(size):
            label = None if i >= size - 8 else 0 if key == "one" else int(x[max(i - 1, 0)] + 0.5 * rng.normal() > 0.3)
            rows.append((key, month(i), label, float(x[i]), float(z[i]) if key != "b" or i > n - 30 else None))
    panel = spark.createDataFrame(rows, "series_id string, date date, label int, x double, z double")
    scored = rg.onset_logit(panel, ["x", "z"])
    got = {}
    for r in scored.collect():
        got.setdefault(r.series_id, []).append(r)
    assert sorted(got) == ["a", "b"]
    assert got["b"][0].coefficients[1] is None and got["b"][0].coefficients[0] > 1
    mine = [r for r in rows if r[0] == "a"]
    x = np.array([[r[3], r[4]] for r in mine])[:-1]
    y = np.array([r[2] for r in mine[1:]], object)
    known = np.array([v is not None for v in y])
    z = (x - x[known].mean(0)) / x[known].std(0)
    w = np.array(got["a"][0].coefficients)
    p = {r.date: r.score for r in got["a"]}
    score = np.array([p[r[1]] for r in mine[1:]])
    b = np.log(score / (1 - score)) - z @ w
    assert np.ptp(b) < 1e-8  # the scores are those of the weights
    resid = score[known] - y[known].astype(float)
    assert abs(resid.sum()) < 1e-6 and np.abs(z[known].T @ resid + w).max() < 1e-6  # the gradient of the penalised loss
    s = {r.series_id: r for r in rg.onset_summary(scored).collect()}["a"]
    assert s.n == known.sum() and s.latest == pytest.approx(score[-1]) and s.earlier == pytest.approx(score[-7]) and s.auroc > 0.8
