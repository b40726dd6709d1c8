"""Break search against a whole dynamic program, and on series far beyond what a table of segments would hold."""

import datetime as dt

import numpy as np
import pytest

from tidewater.operators import breaks, detect

DAY = dt.date(1960, 1, 1)


def whole(x, most, least):
    """Sums of squares of the best fits from the table of all segments."""
    n, x = len(x), x - x.mean()
    s, q = np.r_[0, np.cumsum(x)], np.r_[0, np.cumsum(x * x)]
    i, j = np.meshgrid(np.arange(n + 1), np.arange(n + 1), indexing="ij")
    with np.errstate(all="ignore"):
        cost = np.where(j - i >= least, q[j] - q[i] - (s[j] - s[i]) ** 2 / (j - i), np.inf)
    best = cost[0]
    out = [best[n]]
    for _ in range(most):
        best = (best[:, None] + cost).min(0)
        out.append(best[n])
    return out


@pytest.mark.parametrize("kind", ["noise", "walk", "steps", "ties", "trend", "constant"])
def test_search_equals_whole_table(kind):
    rng = np.random.default_rng(len(kind))
    for n, least in ((500, 30), (500, 3), (37, 5), (10, 3)):
        x = rng.normal(size=n)
        x = {"noise": x, "walk": np.cumsum(x), "steps": x + 4 * (np.arange(n) * 7 // n % 3), "ties": np.round(x), "trend": np.arange(n) * 1.0, "constant": np.full(n, 2.5)}[kind]
        got = breaks.segmentations(x, 5, least)
        assert len(got) == min(5, n // least - 1) + 1
        for (rss, starts), want in zip(got, whole(x, 5, least), strict=False):
            ends = [0, *starts, n]
            assert min(np.diff(ends)) >= least
            assert rss == pytest.approx(want, rel=1e-8, abs=1e-8)
            assert sum(((x[a:b] - x[a:b].mean()) ** 2).sum() for a, b in zip(ends, ends[1:], strict=False)) == pytest.approx(want, rel=1e-8, abs=1e-8)


def given(spark, series):
    rows = [(name, DAY + dt.timedelta(i), float(v)) for name, x in series.items() for i, v in enumerate(x)]
    return spark.createDataFrame(rows, "series_id string, date date, value double")


def test_steps_in_long_series_are_dated(spark):
    """1,600 and 15,000 daily rows with one step each: its own date, size and age; a short series and a flat one are left out."""
    rng = np.random.default_rng(1)
    obs = given(spark, {
        "a": 0.5 * rng.normal(size=1600) + 10 * (np.arange(1600) >= 800), "b": rng.normal(size=15_000) + 2 * (np.arange(15_000) >= 12_345),
        "short": [1.0] * 5 + [9.0] * 4, "flat": [3.0] * 50,
    })
    found = {r.key: r for r in detect.structural_break(obs).collect()}
    assert sorted(found) == ["a", "b"]
    assert found["a"].date == DAY + dt.timedelta(800) and abs((found["b"].date - DAY).days - 12_345) < 10
    assert found["a"].score == pytest.approx(10 / 5.02 * (1 - 799 / 365.25 / 15), rel=0.01)
    assert detect.structural_break(obs, least_move=5.0).select("key").collect()[0].key == "a"
    b = breaks.structural_breaks(obs.filter("series_id = 'a'"), n_breaks=1)
    stats = breaks.regime_stats(breaks.regimes(obs, b)).orderBy("regime").collect()
    assert [(r.n, r.since, r.until) for r in stats] == [(800, DAY, DAY + dt.timedelta(799)), (800, DAY + dt.timedelta(800), DAY + dt.timedelta(1599))]
    monthly = breaks.structural_breaks(obs.filter("series_id = 'a'"), 2, resample="M").filter("best").collect()
    assert monthly[0].n == 53 and (DAY + dt.timedelta(800)).replace(day=1) in monthly[0].break_dates


def test_empty(spark):
    assert breaks.structural_breaks(given(spark, {}), 2).collect() == []
    assert detect.structural_break(given(spark, {})).collect() == []
