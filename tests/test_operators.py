"""Hand-computed and invariant cases of the time-series operators: ties, missing values, short series."""

import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidewater.operators import align, breaks, curve, detect, events, ingest, monitor, regression, select, series, text
from tidewater.sources import observations
from tidewater.streaming import refresh

OBS = "series_id string, date date, value double"


def day(n):
    return dt.date(2024, 1, 1) + dt.timedelta(days=n)


def month(n):
    return dt.date(2000 + n // 12, n % 12 + 1, 1)


def obs(spark, values, sid="s", at=month):
    return spark.createDataFrame([(sid, at(i), v) for i, v in enumerate(values)], OBS)


def pairs(spark, a, b):
    return spark.createDataFrame([("p", month(i), float(x), float(y)) for i, (x, y) in enumerate(zip(a, b, strict=True))], "pair_id string, date date, a double, b double")


def rows(df, *by):
    return [r.asDict(recursive=True) for r in df.orderBy(*by).collect()]


def test_merge_revisions_and_counts(spark):
    old = spark.createDataFrame([("s", day(0), 1.0), ("s", day(1), None), ("s", day(2), 3.0), ("t", day(0), 9.0)], OBS)
    new = spark.createDataFrame([("s", day(1), None), ("s", day(2), 4.0), ("s", day(3), 5.0)], OBS)
    got = rows(ingest.merge_revisions(old, new), "series_id", "date")
    assert [r["value"] for r in got] == [1.0, None, 4.0, 5.0, 9.0]
    assert rows(ingest.revision_counts(old, new), "series_id") == [{"series_id": "s", "rows_added": 1, "rows_changed": 1}]
    assert ingest.merge_revisions(old, new.limit(0)).count() == 4


def test_failed_series_stay(spark):
    stored = spark.createDataFrame([("a", day(0), 1.0), ("b", day(0), 2.0)], OBS)
    got = rows(ingest.replace_received(stored, spark.createDataFrame([("a", day(1), 5.0)], OBS)), "series_id")
    assert [(r["series_id"], r["value"]) for r in got] == [("a", 5.0), ("b", 2.0)]


def test_content_hash_ignores_order(spark):
    o = obs(spark, [1.0, None, 3.0])
    assert ingest.content_hash(o).first() == ingest.content_hash(o.orderBy(F.desc("date")).repartition(3)).first()


def test_weekend_points_survive_upsampling(spark):
    o = spark.createDataFrame([("s", dt.date(2024, 5, 31), 1.0), ("s", dt.date(2024, 6, 1), 2.0), ("s", dt.date(2024, 6, 4), 3.0)], OBS)
    got = {r["date"]: r["value"] for r in rows(align.upsample_daily(o), "date")}
    assert got[dt.date(2024, 6, 3)] == 2.0
    strict = {r["date"]: r["value"] for r in rows(align.upsample_daily(o, strict_grid=True), "date")}
    assert strict[dt.date(2024, 6, 3)] == 1.0


def test_nearest_prefers_the_earlier_date(spark):
    o = spark.createDataFrame([("s", day(0), 1.0), ("s", day(2), 3.0)], OBS)
    e = spark.createDataFrame([(day(1),)], "event_date date")
    assert rows(align.nearest(e, o), "event_date")[0]["actual_date"] == day(0)


def test_rolling_corr_matches_numpy(spark):
    rng = np.random.default_rng(1)
    a, b = rng.normal(size=30).round(1), rng.normal(size=30).round(1)
    got = rows(series.rolling_corr(pairs(spark, a, b), 10, "spearman"), "date")

    def ranks(x):
        return np.array([(x < v).sum() + ((x == v).sum() + 1) / 2 for v in x])

    for i, r in enumerate(got):
        if i < 9:
            assert r["correlation"] is None
        else:
            want = np.corrcoef(ranks(a[i - 9 : i + 1]), ranks(b[i - 9 : i + 1]))[0, 1]
            assert r["correlation"] == pytest.approx(want)
    flat = rows(series.rolling_corr(pairs(spark, [1] * 12, range(12)), 10), "date")
    assert all(r["correlation"] is None for r in flat)


def test_lead_lag_finds_the_lead(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=80)
    p = pairs(spark, x[3:], x[:-3])  # a at t is b at t + 3
    assert rows(series.peak_lag(series.lead_lag(p, 6)), "pair_id")[0]["lag"] == 3


def test_breaks_equal_brute_force(spark):
    rng = np.random.default_rng(3)
    v = np.r_[rng.normal(0, 1, 12), rng.normal(6, 1, 10), rng.normal(-3, 1, 9)]
    got = {r["k"]: r for r in rows(breaks.structural_breaks(obs(spark, v.tolist()), 2, 4), "k")}
    n, x = len(v), v - v.mean()
    sse = lambda i, j: ((x[i:j] - x[i:j].mean()) ** 2).sum()
    best1 = min((sse(0, i) + sse(i, n), i) for i in range(4, n - 3))
    best2 = min((sse(0, i) + sse(i, j) + sse(j, n), i, j) for i in range(4, n - 7) for j in range(i + 4, n - 3))
    assert got[1]["rss"] == pytest.approx(best1[0]) and got[2]["rss"] == pytest.approx(best2[0])
    assert got[2]["breaks"] == [best2[1], best2[2]] and got[2]["best"]


def test_jumps_fall_back_to_mad(spark):
    v = np.cumsum([0.0, *[0.0, 1.0] * 40, 30.0]).tolist()
    assert [r["is_recent"] for r in rows(series.jumps(obs(spark, v, at=day), 20), "date")] == [True]
    assert series.jumps(obs(spark, [1.0, None, 2.0]), 20).count() == 0


def test_regime_edge_cases(spark):
    r = rows(series.quantile_regime(obs(spark, [1.0, 1.0, 1.0, None]), [0.3, 0.6], ["a", "b", "c"]), "date")
    assert all(x["regime"] is None for x in r)
    t = rows(series.transitions(series.quantile_regime(obs(spark, [1.0, 5.0, 2.0, 6.0]), [0.5], ["lo", "hi"])), "from_state", "to_state")
    assert [(x["from_state"], x["to_state"], x["n"]) for x in t] == [("hi", "hi", 0), ("hi", "lo", 1), ("lo", "hi", 2), ("lo", "lo", 0)]


def test_pca_is_orthonormal(spark):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(50, 3)) @ rng.normal(size=(3, 3))
    wide = spark.createDataFrame([(i, *map(float, r)) for i, r in enumerate(x)], "i int, a double, b double, c double")
    loadings, scores = series.pca(wide, ["a", "b", "c"], 3)
    m = np.array([r["loading"] for r in rows(loadings, "component", "column")]).reshape(3, 3)
    assert np.allclose(m @ m.T, np.eye(3)) and sum(r["explained"] for r in rows(loadings, "component", "column")[::3]) == pytest.approx(1)
    assert scores.count() == 50


def design(spark, n=60, seed=5):
    rng = np.random.default_rng(seed)
    x1, x2 = rng.normal(size=n) + 100, rng.normal(size=n)
    y = 2 + 0.5 * x1 - 3 * x2 + rng.normal(size=n) * (1 + np.abs(x2))
    df = spark.createDataFrame([("g", month(i), float(y[i]), float(x1[i]), float(x2[i])) for i in range(n)], "g string, date date, y double, x1 double, x2 double")
    return df, np.c_[np.ones(n), x1, x2], y


def test_ols_hac_and_hc3_equal_numpy(spark):
    df, x, y = design(spark)
    inv = np.linalg.inv(x.T @ x)
    beta = inv @ x.T @ y
    e = y - x @ beta
    n, k = x.shape
    by_term = lambda d: {r["term"]: r for r in rows(d, "term")}
    got = by_term(regression.robust_se(df, "y", ["x1", "x2"], ["g"], "date", 4))
    se = np.sqrt(np.diag(inv) * (e @ e) / (n - k))
    u = x * e[:, None]
    s = u.T @ u
    for lag in range(1, 5):
        g = u[lag:].T @ u[:-lag]
        s += (1 - lag / 5) * (g + g.T)
    hac = np.sqrt(np.diag(inv @ s @ inv))
    h = np.einsum("ij,jk,ik->i", x, inv, x)
    w = x * (e / (1 - h))[:, None]
    hc3 = np.sqrt(np.diag(inv @ w.T @ w @ inv))
    other = by_term(regression.robust_se(df, "y", ["x1", "x2"], ["g"], "date", hc3=True))
    for i, t in enumerate(["const", "x1", "x2"]):
        assert got[t]["beta"] == pytest.approx(beta[i], rel=1e-6) and got[t]["se"] == pytest.approx(se[i], rel=1e-6)
        assert got[t]["se_robust"] == pytest.approx(hac[i], rel=1e-5) and other[t]["se_robust"] == pytest.approx(hc3[i], rel=1e-5)
    assert regression.grouped_ols(df.withColumn("x2", F.col("x1") * 2), "y", ["x1", "x2"], ["g"]).count() == 0


def test_granger_var_and_adf(spark):
    rng = np.random.default_rng(6)
    b = rng.normal(size=120)
    a = np.r_[0, 0.9 * b[:-1]] + rng.normal(size=120) * 0.1
    f = {r["lag"]: r["f"] for r in rows(regression.granger(pairs(spark, a, b), 2), "lag")}
    assert f[1] > 100
    v = rows(regression.var_model(pairs(spark, a, b), ["a", "b"], 1, ["pair_id"]), "equation", "term")
    assert next(r["beta"] for r in v if r["equation"] == "a" and r["term"] == "b_l1") == pytest.approx(0.9, abs=0.05)
    walk = np.cumsum(rng.normal(size=200))
    noise = rng.normal(size=200)
    both = obs(spark, walk.tolist(), "walk").unionByName(obs(spark, noise.tolist(), "noise"))
    got = {r["series_id"]: r["stationary"] for r in rows(regression.adf(both), "series_id")}
    assert got == {"walk": False, "noise": True}


def test_fama_macbeth_recovers_premium(spark):
    rng = np.random.default_rng(7)
    f = rng.normal(0.5, 1, size=(80, 1))
    betas = np.linspace(0.2, 2, 12)
    data = [(i, month(t), float(betas[i] * f[t, 0] + rng.normal() * 0.05), float(f[t, 0])) for i in range(12) for t in range(80)]
    got = {r["term"]: r for r in rows(regression.fama_macbeth(spark.createDataFrame(data, "asset int, date date, ret double, f double"), ["f"]), "term")}
    assert got["f"]["premium"] == pytest.approx(f.mean(), abs=0.02)


def test_onset_labels_offset(spark):
    flags = spark.createDataFrame([("s", month(i), int(i in (5, 6))) for i in range(10)], "series_id string, date date, flag int")
    ahead = [r["label"] for r in rows(regression.onset_labels(flags, 2, 0), "date")]
    assert ahead == [0, 0, 0, 0, 1, 1, 0, 0, 0, None]


def test_nelson_siegel_recovers_factors(spark):
    t = np.array([1, 2, 3, 5, 7, 10, 20, 30.0])
    s = (1 - np.exp(-0.5 * t)) / (0.5 * t)
    y = 4 - 2 * s + 1.5 * (s - np.exp(-0.5 * t))
    c = spark.createDataFrame([(int(a), month(0), float(b)) for a, b in zip(t, y, strict=True)] + [(1, month(1), 2.0), (2, month(1), 2.1)], "tenor int, date date, value double")
    got = rows(curve.nelson_siegel(c, 0.5), "date")
    assert len(got) == 1 and [got[0][k] for k in ("level", "slope", "curvature")] == pytest.approx([4, -2, 1.5])
    assert got[0]["rmse_bp"] == pytest.approx(0, abs=1e-6)


def test_dots_are_weighted(spark):
    d = spark.createDataFrame([("m1", "2024", 1.0, 1), ("m1", "2024", 2.0, 3), ("m2", "2024", 3.0, 1)], "meeting_date string, forecast_year string, rate double, participant_count int")
    got = rows(curve.dot_distribution(d), "meeting_date")
    assert got[0]["median"] == 2.0 and got[0]["n"] == 4 and got[1]["shift_bp"] == 100


def test_episodes(spark):
    e = rows(events.threshold_episodes(obs(spark, [1.0, 5.0, 6.0, 5.0, 1.0, 5.0, 1.0, 7.0, 8.0, 9.0]), 4.0, 3), "start_date")
    assert [(x["duration"], x["peak"], x["peak_date"]) for x in e] == [(3, 6.0, month(2)), (3, 9.0, month(9))]
    flags = spark.createDataFrame([("s", month(i), f) for i, f in enumerate([1, 1, 0, 1])], "series_id string, date date, flag int")
    assert [r["n"] for r in rows(events.runs_from_flag(flags), "start_date")] == [2, 1]
    windows = spark.createDataFrame([("in", month(0), month(2)), ("out", month(50), month(51))], "name string, start_date date, end_date date")
    got = {r["name"]: r["n"] for r in rows(events.compare_to_episodes(obs(spark, [1.0, 2.0, 3.0, 4.0]), windows), "name")}
    assert got == {"in": 3, "out": 0}


def test_detectors_fire_on_planted_cases(spark):
    rng = np.random.default_rng(8)
    v = np.r_[rng.normal(size=80), 9.0]
    kinds = {r["kind"] for r in rows(detect.notable_move(obs(spark, v.tolist())), "kind")}
    assert kinds == {"notable_move_level", "notable_move_change"}
    step = np.r_[rng.normal(0, 0.2, 40), rng.normal(5, 0.2, 40)]
    assert rows(detect.structural_break(obs(spark, step.tolist())), "key")[0]["date"] == month(40)
    assert detect.notable_move(obs(spark, [1.0] * 10)).count() == 0
    f = detect.findings(detect.notable_move(obs(spark, v.tolist())))
    assert detect.findings(detect.notable_move(obs(spark, v.tolist())), f).count() == 0


def test_selection(spark):
    as_of = F.lit(day(20)).cast("date")
    f = spark.createDataFrame(
        [("a", "move", "k1", day(19), "new"), ("b", "move", "k2", day(1), "new"), ("c", "break", "k1", day(1), "new"), ("d", "break", "k3", day(2), "used"), ("e", "break", "k4", day(2), "new")],
        "slug string, kind string, key string, discovered date, status string",
    )
    h = spark.createDataFrame([(day(18), "a", "move", "k1"), (day(19), "x", "move", "k9")], "date date, slug string, kind string, key string")
    chosen = lambda found, **o: {r["slug"]: r["tier"] for r in rows(select.eligible(found, h, as_of, data_points=["move"], **o), "slug")}
    assert chosen(f) == {"e": 0}
    assert chosen(f, more=spark.createDataFrame([("k1",)], "key string")) == {"c": 0, "e": 0}
    assert chosen(f.filter("slug <> 'e'")) == {"d": 1}
    assert chosen(f.filter("slug IN ('a', 'b', 'c')")) == {"b": 2, "c": 2}
    assert chosen(f.filter("slug = 'a'")) == {"a": 3}
    got = rows(select.rank_findings(f, h, as_of, ["move", "break"]), "place")
    assert [(r["slug"], r["place"], r["tired"]) for r in got] == [("d", 1, 0), ("e", 2, 0), ("c", 3, 0), ("a", 4, 1), ("b", 5, 1)]
    assert [r["slug"] for r in rows(select.rank_findings(f, h.limit(0), as_of, ["move"]), "place")] == ["a", "b", "d", "e", "c"]
    seeds = spark.createDataFrame([("x", False, day(30), False, 9.0), ("y", False, day(30), True, 1.0), ("z", True, day(30), True, 99.0)], "id string, used boolean, expires date, upcoming boolean, priority_score double")
    assert select.pick_seed(seeds, as_of).first()["id"] == "y"


def test_text(spark):
    docs = spark.createDataFrame([("s", "intro\n## One\nx\n### no\n## Two")], "source string, text string")
    assert [r["header"] for r in rows(text.chunk(docs), "n")] == ["intro", "One", "Two"]
    page = spark.createDataFrame([(1, "<nav>n</nav><table><tr><th>A</th><td>b<b>c</b></td></tr></table><p>x</p>\n\n<p>y</p>")], "page_id int, html string")
    assert [r["text"] for r in rows(text.table_cells(page), "cell")] == ["A", "bc"]
    assert page.select(text.html_to_text(F.col("html"))).first()[0] == "A\nb\nc\nx\ny"


def test_job_health(spark):
    t = dt.datetime(2024, 1, 1)
    runs = spark.createDataFrame([("a", t, True), ("a", t + dt.timedelta(hours=1), False), ("b", t, False), ("b", t, False), ("b", t, False), ("c", t + dt.timedelta(hours=20), True)], "script string, finished_at timestamp, success boolean")
    got = {r["script"]: r["status"] for r in rows(monitor.job_health(runs, F.lit(t + dt.timedelta(hours=40))), "script")}
    assert got == {"a": "warn", "b": "error", "c": "ok"}


def test_sources(spark, tmp_path):
    d = spark.createDataFrame([("2026",), ("2026-05",), ("2026-Q3",), ("2026-S2",), ("2026-W01",), ("2026-05-07",), ("x",)], "p string")
    got = [str(r[0]) for r in d.select(observations.period_start(F.col("p"))).collect()]
    assert got == ["2026-01-01", "2026-05-01", "2026-07-01", "2026-07-01", "2025-12-29", "2026-05-07", "None"]
    assert observations.read_observations(spark, str(tmp_path / "none")).count() == 0
    o = obs(spark, [1.0, 2.0]).withColumn("frequency", F.lit("M"))
    observations.write_observations(o, str(tmp_path / "o"))
    assert observations.read_observations(spark, str(tmp_path / "o"), ["s"]).count() == 2
    (tmp_path / "l.jsonl").write_text('{"a": 1}\nbroken\n{"a": 2}\n')
    assert observations.read_jsonl(spark, str(tmp_path / "l.jsonl"), "a int").count() == 2


def test_stream_replays_to_the_batch_result(spark, tmp_path):
    landing = tmp_path / "landing"
    landing.mkdir()
    slices = [
        [("s", day(0), 1.0, 0), ("s", day(200), 2.0, 0), ("t", day(5), 3.0, 0)],
        [("s", day(200), 2.5, 1), ("s", day(201), 4.0, 1), ("s", day(3), 9.0, 1)],
        [("s", day(201), 4.5, 2), ("s", day(201), 4.4, 1), ("t", day(6), 1.0, 2)],
    ]
    for n, rows_ in enumerate(slices):
        lines = [f'{{"series_id": "{s}", "date": "{d}", "value": {v}, "arrived": "2024-12-0{a + 1} 00:00:00"}}' for s, d, v, a in rows_]
        (landing / f"{n}.json").write_text("\n".join(lines))
        q = refresh.start(spark, str(landing), str(tmp_path / "store"), str(tmp_path / "checkpoint"), late="aside")
        q.awaitTermination(240)
    got = {(r["series_id"], r["date"]): r["value"] for r in rows(refresh.stored(spark, str(tmp_path / "store"), "observations"), "date")}
    assert got == {("s", day(0)): 1.0, ("s", day(200)): 2.5, ("s", day(201)): 4.5, ("t", day(5)): 3.0, ("t", day(6)): 1.0}
    late = refresh.stored(spark, str(tmp_path / "store"), "late")
    assert [(r["date"], r["batch"]) for r in late.collect()] == [(day(3), 1)]


def test_structural_breaks_finds_five(spark):
    level = [0.0, 5.0, -3.0, 8.0, 1.0, 12.0]
    v = [level[i // 14] + 0.1 * (-1) ** i for i in range(84)]
    best = [r for r in rows(breaks.structural_breaks(obs(spark, v)), "k") if r["best"]]
    assert [r["k"] for r in best] == [5] and best[0]["breaks"] == [14, 28, 42, 56, 70]
    hit = rows(detect.structural_break(obs(spark, v)), "key")[0]
    assert hit["date"] == month(70)


def test_html_to_text_whole_or_capped(spark):
    page = spark.createDataFrame([("<p>" + "word " * 4000 + "end</p>",)], "html string")
    whole, capped = page.select(text.html_to_text(F.col("html")), text.html_to_text(F.col("html"), 100)).first()
    assert len(whole) == 20003 and whole.endswith(" end") and capped == whole[:100]


def test_scan_chooses_windows_by_frequency(spark, monkeypatch):
    def stub(kind):
        def hit(pairs, window, *more):
            p = pairs.groupBy("pair_id").agg(F.max("date").alias("date"))
            return detect.hits(p, kind, "pair_id", F.lit(1.0), F.col("date"), str((window, *more)), ["date"])

        return hit

    monkeypatch.setattr(detect, "correlation_shift", stub("correlation_shift"))
    monkeypatch.setattr(detect, "lead_lag_change", stub("lead_lag_change"))
    data = [("d|e", day(i), float(i % 7), float(i % 5)) for i in range(80)] + [("m|n", month(i), float(i % 7), float(i % 5)) for i in range(80)]
    pairs = spark.createDataFrame(data, "pair_id string, date date, a double, b double")
    o = pairs.select(F.col("pair_id").alias("series_id"), "date", F.col("a").alias("value"))
    found = rows(detect.scan(o, pairs, factors=o, parts=o.withColumn("total", 2 * F.col("value")), levels=(o, [(0.0, "low")], "high", ["high"])), "kind")
    assert {(r["kind"], r["key"], r["window"]) for r in found if r["kind"] in ("correlation_shift", "lead_lag_change")} == {
        ("correlation_shift", "d|e", "(252,)"), ("correlation_shift", "m|n", "(36,)"), ("lead_lag_change", "d|e", "(60, 252)"), ("lead_lag_change", "m|n", "(6, 24)"),
    }
    assert {r["key"] for r in found if r["kind"] == "level_regime_cross"} == {"d|e", "m|n"}


def test_written_tables_are_cleared(spark, tmp_path):
    from tidewater.functions.stored import swept, written

    with swept(spark):
        path = written(spark.range(3), "numbers").inputFiles()[0].removeprefix("file:").replace("///", "/")
        assert spark.read.parquet(path).count() >= 0
    import os

    assert not os.path.exists(path)


def test_align_finest_builds_the_grid(spark):
    o = spark.createDataFrame(
        [("p", "q", "Q", month(0), 1.0), ("p", "q", "Q", month(6), 3.0), ("p", "m", "M", month(2), 9.0), ("p", "m", "M", month(8), 8.0), ("z", "only", "Q", month(0), 5.0)],
        "panel_id string, series_id string, freq string, date date, value double",
    )
    got = {(r["series_id"], r["date"]): r["value"] for r in rows(align.align(o, "finest"), "date")}
    assert [got["q", month(i)] for i in (0, 1, 2, 3, 5, 6, 8)] == [1, 1, 1, 1, 1, 3, 3] and ("q", month(7)) not in got
    assert got["m", month(2)] == got["m", month(6)] == 9.0 and ("m", month(1)) not in got and got["only", month(0)] == 5.0
    bare = {(r["series_id"], r["date"]): r["value"] for r in rows(align.align(o, "finest", ffill=False), "date")}
    assert bare["q", month(1)] is None and bare["m", month(8)] == 8.0 and ("m", month(3)) not in bare
    both = rows(align.align(o, "finest", dropna="any"), "date")
    assert min(r["date"] for r in both if r["panel_id"] == "p") == month(2)
    some = rows(align.align(o, "finest", ffill=False, dropna="all"), "date")
    assert {r["date"] for r in some if r["panel_id"] == "p"} == {month(0), month(2), month(6), month(8)}


def test_metadata_and_seed_cooldown(spark):
    meta = spark.createDataFrame([("a", "x"), ("b", "y")], "series_id string, partition string")
    assert observations.series_metadata(meta, "a")["partition"] == "x"
    with pytest.raises(KeyError):
        observations.series_metadata(meta, "none")
    assert observations.available_series(meta).count() == 2 and observations.available_series(meta, "y").count() == 1
    seeds = spark.createDataFrame([("x", "k1", False, day(30), True, 9.0), ("y", "k2", False, day(30), False, 1.0)], "id string, key string, used boolean, expires date, upcoming boolean, priority_score double")
    shown = spark.createDataFrame([("k1",)], "key string")
    assert select.pick_seed(seeds, F.lit(day(1)).cast("date"), shown).first()["id"] == "y"
