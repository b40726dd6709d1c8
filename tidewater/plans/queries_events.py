"""Queries of curves, events, regressions, detectors, selection, text and monitoring."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import distributions as ds
from ..functions.stored import shared_folder, written
from ..operators import align as al
from ..operators import curve as cv
from ..operators import detect as dt
from ..operators import events as ev
from ..operators import monitor as mo
from ..operators import pricing as pr
from ..operators import regression as rg
from ..operators import retrieval as rt
from ..operators import select as sl
from ..operators import series as st
from ..operators import text as tx
from .fixtures import CALENDAR, CURVE, DAILY, DOTS, FLAGS, MONTHLY, PAIRS, PARTS, RUNS, WINDOWS, episodes, fixture, tables
from .queries_series import STEPPED, break_ctes, stats_ctes
from .registry import query

S, D = SparkSession, DataFrame
R = "round({}, 6)".format
X = "-0.0609 * tenor"
LOADED = f"""l AS (SELECT tenor, date, value AS y, (1 - exp({X})) / (0.0609 * tenor) AS s, (1 - exp({X})) / (0.0609 * tenor) - exp({X}) AS c FROM curve)"""


@query("curve_spread", f"""
WITH {CURVE} SELECT concat('7s', b.tenor) AS name, a.date, {R('100 * (a.value - b.value)')} AS value FROM curve a JOIN curve b ON a.date = b.date AND a.tenor = 7 AND b.tenor IN (1, 2)""")
def curve_spread(spark: S, sf: str) -> D:
    obs = fixture(spark, sf, CURVE).select(F.concat(F.lit("T"), "tenor").alias("series_id"), "date", "value")
    legs = spark.createDataFrame([("7s1", "T7", "T1", 100.0), ("7s2", "T7", "T2", 100.0)], "name string, first string, second string, scale double")
    return cv.spread(obs, legs)


@query("sahm_rule", f"""
WITH {MONTHLY} SELECT series_id, date, CASE WHEN count(*) OVER a = 3 AND count(*) OVER b = 12 THEN {R('avg(value) OVER a - min(value) OVER b')} END AS value FROM monthly
WINDOW a AS (PARTITION BY series_id ORDER BY date ROWS BETWEEN 2 PRECEDING AND CURRENT ROW), b AS (PARTITION BY series_id ORDER BY date ROWS BETWEEN 12 PRECEDING AND 1 PRECEDING)""")
def sahm_rule(spark: S, sf: str) -> D:
    return cv.sahm_rule(fixture(spark, sf, MONTHLY))


@query("taylor_rule", f"""
WITH {CURVE} SELECT date, {R('0.5 + i + 0.5 * (i - 2.0) + 0.5 * g')} AS rate FROM (SELECT date, max(CASE WHEN tenor = 1 THEN value END) AS i, max(CASE WHEN tenor = 2 THEN value END) AS g FROM curve GROUP BY 1)""")
def taylor_rule(spark: S, sf: str) -> D:
    w = fixture(spark, sf, CURVE).groupBy("date").pivot("tenor", [1, 2]).agg(F.first("value"))
    return w.select("date", cv.taylor_rule(F.col("1"), F.col("2")).alias("rate"))


RAW = ("ORD.1-URGENT", "ORD.2-HIGH", "ORD.4-NOT SPECIFIED", "ORD.5-LOW")


@query("taylor_from_levels", f"""
WITH {MONTHLY}, {DAILY}, p AS (SELECT date, 100 * (value / lag(value, 12) OVER (ORDER BY date) - 1) AS value FROM monthly WHERE series_id = '{RAW[1]}'),
q AS (SELECT series_id, date, value FROM monthly WHERE series_id IN ('{RAW[2]}', '{RAW[3]}') AND month(date) % 3 = 1), d AS (SELECT date, value FROM daily WHERE series_id = '{RAW[0]}'),
m AS (SELECT last_day(date) AS date, arg_max(value, date) AS policy, NULL AS inflation, NULL AS output, NULL AS potential FROM d GROUP BY 1 UNION ALL SELECT last_day(date), NULL, arg_max(value, date) FILTER (value IS NOT NULL), NULL, NULL FROM p GROUP BY 1
 UNION ALL SELECT last_day(date), NULL, NULL, max(value) FILTER (series_id = '{RAW[2]}'), max(value) FILTER (series_id = '{RAW[3]}') FROM q GROUP BY 1),
w AS (SELECT date, max(policy) AS policy, max(inflation) AS inflation, max(output) AS output, max(potential) AS potential FROM m GROUP BY 1),
g AS (SELECT last_day(CAST(unnest(generate_series(date_trunc('month', min(date)), date_trunc('month', max(date)), INTERVAL 1 MONTH)) AS DATE)) AS date FROM w),
f AS (SELECT g.date, last_value(policy IGNORE NULLS) OVER o AS policy, last_value(inflation IGNORE NULLS) OVER o AS inflation, last_value(output IGNORE NULLS) OVER o AS output, last_value(potential IGNORE NULLS) OVER o AS potential FROM g LEFT JOIN w ON w.date = g.date WINDOW o AS (ORDER BY g.date))
SELECT date, {R('policy')} AS policy, {R('inflation')} AS inflation, {R('100 * (output / potential - 1)')} AS gap, {R('0.5 + inflation + 0.5 * (inflation - 2) + 50 * (output / potential - 1)')} AS rate, {R('policy - (0.5 + inflation + 0.5 * (inflation - 2) + 50 * (output / potential - 1))')} AS excess FROM f""")
def taylor_from_levels(spark: S, sf: str) -> D:
    """A daily rate, monthly prices, quarterly output and potential."""
    m = fixture(spark, sf, MONTHLY)
    one = lambda d, k: d.filter(F.col("series_id") == RAW[k]).select("date", "value")
    quarters = m.filter("month(date) % 3 = 1")
    return cv.taylor_from_levels(one(fixture(spark, sf, DAILY), 0), one(m, 1), one(quarters, 2), one(quarters, 3))


@query("forward_rates", f"""
WITH {CURVE} SELECT CAST(tenor AS BIGINT) AS tenor, date, {R('coalesce((tenor * value - lag(tenor) OVER w * lag(value) OVER w) / (tenor - lag(tenor) OVER w), value)')} AS forward FROM curve WINDOW w AS (PARTITION BY date ORDER BY tenor)""")
def forward_rates(spark: S, sf: str) -> D:
    return cv.forward_rates(fixture(spark, sf, CURVE))


@query("excess_returns", f"""
WITH {CURVE}, a AS (SELECT *, lead(value, 12) OVER (PARTITION BY tenor ORDER BY date) AS ahead FROM curve)
SELECT CAST(a.tenor AS BIGINT) AS tenor, a.date, {R('100 * (-a.tenor * (a.ahead - a.value) / 100 + a.value / 100 - r.value / 100)')} AS rx FROM a JOIN curve r ON r.date = a.date AND r.tenor = 1""")
def excess_returns(spark: S, sf: str) -> D:
    return cv.excess_returns(fixture(spark, sf, CURVE), 1)


@query("cp_factor")
def cp_factor(spark: S, sf: str) -> D:
    return cv.cp_factor(cv.forward_rates(fixture(spark, sf, CURVE)), list(range(1, 8)))


def f_tail_sql(f: str, d1: str, d2: str) -> str:
    """P(F > f) by Simpson's rule over the angle whose squared sine is the argument of the incomplete beta function."""
    a, b, n = f"(({d2}) / 2.0)", f"(({d1}) / 2.0)", 4000
    top = f"asin(sqrt(({d2}) / (({d2}) + ({d1}) * ({f}))))"
    weight = f"CASE WHEN k = 0 OR k = {n} THEN 1 WHEN k % 2 = 1 THEN 4 ELSE 2 END"
    terms = f"list_transform(range(0, {n + 1}), lambda k: {weight} * pow(sin({top} * k / {n}), 2 * {a} - 1) * pow(cos({top} * k / {n}), 2 * {b} - 1))"
    return f"(2 * list_sum({terms}) * {top} / {3 * n} / exp(lgamma({a}) + lgamma({b}) - lgamma({a} + {b})))"


def hac_ctes(source: str, key: str, y: str, x: str, lags: int) -> str:
    """fit (key, term, beta, se, n, r2, rss, se_robust) of y on x for each key with a kernel of so many lags."""
    w = "".join(f", lag(u0, {k}) OVER w AS u0_{k}, lag(u1, {k}) OVER w AS u1_{k}" for k in range(1, lags + 1))
    cross = lambda i, j: " + ".join([f"sum(u{i} * u{j})", *[f"{1 - k / (lags + 1)} * coalesce(sum(u{i} * u{j}_{k} + u{j} * u{i}_{k}), 0)" for k in range(1, lags + 1)]])
    return f"""
hd AS (SELECT {key} AS hk, date, {y} AS y, {x} AS x FROM {source} WHERE {y} IS NOT NULL AND {x} IS NOT NULL),
hf AS (SELECT hk, count(*) AS n, regr_slope(y, x) AS b1, regr_intercept(y, x) AS b0, sum(x) AS sx, sum(x * x) AS sxx, regr_sxx(y, x) AS cxx, regr_r2(y, x) AS r2, avg(x) AS mx FROM hd GROUP BY 1),
hr AS (SELECT hd.hk, date, y - b0 - b1 * x AS u0, x * (y - b0 - b1 * x) AS u1 FROM hd JOIN hf ON hd.hk = hf.hk),
hl AS (SELECT *{w} FROM hr WINDOW w AS (PARTITION BY hk ORDER BY date)),
hs AS (SELECT hk, sum(u0 * u0) AS rss, {cross(0, 0)} AS s00, {cross(0, 1)} AS s01, {cross(1, 1)} AS s11 FROM hl GROUP BY 1),
hv AS (SELECT hf.*, rss, rss / (n - 2) AS s2, n * sxx - sx * sx AS det, s00, s01, s11 FROM hf JOIN hs ON hf.hk = hs.hk),
fit AS (
  SELECT hk, 'const' AS term, b0 AS beta, sqrt(s2 * (1.0 / n + mx * mx / cxx)) AS se, n, r2, rss, sqrt(sxx * sxx * s00 - 2 * sxx * sx * s01 + sx * sx * s11) / det AS se_robust FROM hv
  UNION ALL SELECT hk, 'x', b1, sqrt(s2 / cxx), n, r2, rss, sqrt(sx * sx * s00 - 2 * sx * n * s01 + n * n * s11) / det FROM hv)"""


@query("cp_regression")
def cp_regression(spark: S, sf: str) -> D:
    c = fixture(spark, sf, CURVE)
    d = cv.excess_returns(c, 1).join(cv.cp_factor(cv.forward_rates(c), list(range(1, 8))), "date").filter("tenor > 1")
    return rg.cp_regression(d)


MEAN_FORWARD = """fw AS (SELECT date, coalesce((tenor * value - lag(tenor) OVER w * lag(value) OVER w) / (tenor - lag(tenor) OVER w), value) AS forward FROM curve WINDOW w AS (PARTITION BY date ORDER BY tenor)),
mf AS (SELECT date, avg(forward) AS cp FROM fw GROUP BY 1),
ca AS (SELECT *, lead(value, 12) OVER (PARTITION BY tenor ORDER BY date) AS ahead FROM curve),
rx AS (SELECT a.tenor, a.date, 100 * (-a.tenor * (a.ahead - a.value) / 100 + a.value / 100 - r.value / 100) AS rx, cp FROM ca a JOIN curve r ON r.date = a.date AND r.tenor = 1 JOIN mf ON mf.date = a.date WHERE a.tenor > 1)"""


@query("cp_regression_mean", f"""
WITH {CURVE}, {MEAN_FORWARD}, {hac_ctes("rx", "tenor", "rx", "cp", 12)}
SELECT CAST(hk AS BIGINT) AS tenor, {R('r2')} AS r2, CAST(n AS BIGINT) AS n, {R('beta')} AS coefficient, {R('beta / se_robust')} AS t, {R(f_tail_sql('(beta / se_robust) * (beta / se_robust)', '1', 'n - 2'))} AS f_pvalue FROM fit WHERE term = 'x' AND n >= 30""")
def cp_regression_mean(spark: S, sf: str) -> D:
    """Excess returns on the mean forward rate in the place of the fitted factor."""
    c = fixture(spark, sf, CURVE)
    mean = cv.forward_rates(c).groupBy("date").agg(F.avg("forward").alias("cp"))
    return rg.cp_regression(cv.excess_returns(c, 1).join(mean, "date").filter("tenor > 1"))


@query("cp_snapshot")
def cp_snapshot(spark: S, sf: str) -> D:
    c = fixture(spark, sf, CURVE)
    factor = cv.cp_factor(cv.forward_rates(c), list(range(1, 8)))
    fits = rg.cp_regression(cv.excess_returns(c, 1).join(factor, "date").filter("tenor > 1"))
    return rg.cp_snapshot(factor.select(F.lit("cp").alias("series_id"), "date", F.col("cp").alias("value")), fits, (5, 7))


def _det(m: list[list[str]]) -> str:
    a, b, c = m
    return f"({a[0]}*({b[1]}*{c[2]}-{b[2]}*{c[1]})-{a[1]}*({b[0]}*{c[2]}-{b[2]}*{c[0]})+{a[2]}*({b[0]}*{c[1]}-{b[1]}*{c[0]}))"


_A, _Y = [["n", "s", "c"], ["s", "ss", "sc"], ["c", "sc", "cc"]], ["y", "sy", "cy"]
_SOLVED = ", ".join(f"{_det([[_Y[r] if k == i else _A[r][k] for k in range(3)] for r in range(3)])}/{_det(_A)} AS {n}" for i, n in enumerate(["level", "slope", "curvature"]))


@query("nelson_siegel", f"""
WITH {CURVE}, {LOADED}, m AS (SELECT date, count(*)::DOUBLE AS n, sum(s) AS s, sum(c) AS c, sum(s*s) AS ss, sum(s*c) AS sc, sum(c*c) AS cc, sum(y) AS y, sum(s*y) AS sy, sum(c*y) AS cy FROM l GROUP BY 1),
f AS (SELECT date, {_SOLVED} FROM m WHERE n >= 3)
SELECT f.date, CAST(round(any_value(level), 3) AS DOUBLE) AS level, round(any_value(slope), 3) AS slope, round(any_value(curvature), 3) AS curvature,
 round(100 * sqrt(avg((l.y - level - slope * l.s - curvature * l.c) ** 2)), 3) AS rmse_bp FROM f JOIN l ON l.date = f.date GROUP BY 1""")
def nelson_siegel(spark: S, sf: str) -> D:
    d = cv.nelson_siegel(fixture(spark, sf, CURVE))
    return d.select("date", *[F.round(c, 3).alias(c) for c in ("level", "slope", "curvature", "rmse_bp")])


@query("dot_distribution", f"""
WITH {DOTS}, x AS (SELECT meeting_date, forecast_year, rate FROM dots, range(0, 100000) t(i) WHERE i < participant_count),
g AS (SELECT meeting_date, forecast_year, quantile_cont(rate, 0.5) AS median, 100 * (quantile_cont(rate, 0.75) - quantile_cont(rate, 0.25)) AS iqr_bp, count(*) AS n FROM x GROUP BY 1, 2)
SELECT meeting_date, forecast_year, {R('median')} AS median, {R('iqr_bp')} AS iqr_bp, CAST(n AS BIGINT) AS n, {R('100 * (median - lag(median) OVER (PARTITION BY forecast_year ORDER BY meeting_date))')} AS shift_bp FROM g""")
def dot_distribution(spark: S, sf: str) -> D:
    return cv.dot_distribution(fixture(spark, sf, DOTS))


@query("spread_snapshot", f"""
WITH {CURVE}, s AS (SELECT a.date, a.value - b.value AS v FROM curve a JOIN curve b ON a.date = b.date AND a.tenor = 7 AND b.tenor = 1), l AS (SELECT max(date) AS date, arg_max(v, date) AS v FROM s)
SELECT '7s1' AS name, l.date, {R('any_value(l.v)')} AS value, CAST(count(*) AS BIGINT) AS n, {R('(any_value(l.v) - avg(s.v)) / stddev_samp(s.v)')} AS z, {R('avg(CASE WHEN s.v <= l.v THEN 1.0 ELSE 0.0 END)')} AS percentile,
 CASE WHEN any_value(l.v) < 0 THEN 'inverted' WHEN any_value(l.v) < 0.1 THEN 'flat' ELSE 'steep' END AS regime FROM s, l GROUP BY l.date""")
def spread_snapshot(spark: S, sf: str) -> D:
    obs = fixture(spark, sf, CURVE).select(F.concat(F.lit("T"), "tenor").alias("series_id"), "date", "value")
    legs = spark.createDataFrame([("7s1", "T7", "T1", 1.0)], "name string, first string, second string, scale double")
    return cv.spread_snapshot(cv.spread(obs, legs), [(0.0, "inverted"), (0.1, "flat")], "steep")


@query("decompose", f"""
WITH {CURVE} SELECT date, {R('n')} AS nominal, {R('r')} AS "real", {R('n - r')} AS breakeven, {R('n - r - s')} AS premium FROM (SELECT date, max(CASE WHEN tenor = 7 THEN value END) AS n, max(CASE WHEN tenor = 3 THEN value END) AS r, max(CASE WHEN tenor = 5 THEN value END) AS s FROM curve GROUP BY 1)""")
def decompose(spark: S, sf: str) -> D:
    c = fixture(spark, sf, CURVE)
    return cv.decompose(*[c.filter(F.col("tenor") == t) for t in (7, 3, 5)])


NEAREST = """SELECT e.*, d.series_id, arg_min(d.date, abs(d.date - e.event_date) * 10 + CASE WHEN d.date > e.event_date THEN 1 ELSE 0 END) AS actual_date,
 arg_min(d.v, abs(d.date - e.event_date) * 10 + CASE WHEN d.date > e.event_date THEN 1 ELSE 0 END) AS v"""


@query("event_change_study", f"""
WITH {DAILY}, {CALENDAR}, c AS (SELECT series_id, date, value - lag(value) OVER (PARTITION BY series_id ORDER BY date) AS v FROM daily),
e AS (SELECT date AS event, lag, CAST(date + lag AS DATE) AS event_date FROM calendar, (SELECT CAST(unnest(range(-1, 6)) AS INT) AS lag)),
h AS ({NEAREST} FROM e JOIN c d ON d.v IS NOT NULL AND d.date BETWEEN e.event_date - 1 AND e.event_date + 1 GROUP BY ALL),
g AS (SELECT series_id, lag, count(v) AS n, avg(v) AS mean, stddev_samp(v) AS std FROM h GROUP BY 1, 2)
SELECT series_id, CAST(lag AS BIGINT) AS lag, CAST(n AS BIGINT) AS n, {R('mean')} AS mean, {R('std')} AS std, {R('sum(mean) OVER (PARTITION BY series_id ORDER BY lag)')} AS cum_mean FROM g""")
def event_change_study(spark: S, sf: str) -> D:
    return ev.change_study(fixture(spark, sf, DAILY), fixture(spark, sf, CALENDAR))


@query("event_level_study", f"""
WITH {DAILY}, {CALENDAR}, g AS (SELECT series_id, CAST(unnest(generate_series(min(date), max(date), INTERVAL 1 DAY)) AS DATE) AS date FROM daily GROUP BY 1),
p AS (SELECT g.series_id, g.date, d.value FROM g ASOF JOIN daily d ON g.series_id = d.series_id AND g.date >= d.date),
m AS (SELECT a.series_id, o.k AS "offset", p.value - a.value AS move FROM calendar c JOIN p a ON a.date = c.date, (SELECT CAST(unnest(range(-5, 21)) AS INT) AS k) o JOIN p ON true WHERE p.series_id = a.series_id AND p.date = c.date + o.k)
SELECT series_id, CAST("offset" AS BIGINT) AS "offset", CAST(count(move) AS BIGINT) AS n, {R('avg(move)')} AS mean, {R('quantile_cont(move, 0.5)')} AS median, {R('quantile_cont(move, 0.25)')} AS p25, {R('quantile_cont(move, 0.75)')} AS p75 FROM m GROUP BY 1, 2""")
def event_level_study(spark: S, sf: str) -> D:
    return ev.level_study(fixture(spark, sf, DAILY), fixture(spark, sf, CALENDAR))


@query("event_panel", f"""
WITH {DAILY}, {CALENDAR}, c AS (SELECT series_id, date, value AS v, value - lag(value) OVER (PARTITION BY series_id ORDER BY date) AS change FROM daily),
e AS (SELECT date AS event, lag, CAST(date + lag AS DATE) AS event_date FROM calendar, (SELECT CAST(unnest(range(-1, 2)) AS INT) AS lag)),
h AS ({NEAREST} FROM e JOIN c d ON d.date BETWEEN e.event_date - 3 AND e.event_date + 3 GROUP BY ALL)
SELECT h.event, CAST(h.lag AS BIGINT) AS lag, h.series_id, h.actual_date, {R('h.v')} AS level, {R('c.change')} AS change FROM h JOIN c ON c.series_id = h.series_id AND c.date = h.actual_date""")
def event_panel(spark: S, sf: str) -> D:
    return ev.event_panel(fixture(spark, sf, DAILY), fixture(spark, sf, CALENDAR))


@query("event_calendar", f"WITH {CALENDAR} SELECT date, is_scheduled FROM calendar WHERE is_scheduled AND date >= DATE '1996-01-01'")
def event_calendar(spark: S, sf: str) -> D:
    return fixture(spark, sf, CALENDAR).filter("is_scheduled AND date >= DATE'1996-01-01'")


def _meetings(spark: S, sf: str) -> D:
    p = ev.event_panel(fixture(spark, sf, DAILY), fixture(spark, sf, CALENDAR), 0, 0)
    return ev.meeting_panel(p, "ORD.1-URGENT", "ORD.2-HIGH")


MEETINGS = f"""c AS (SELECT series_id, date, value AS v, value - lag(value) OVER (PARTITION BY series_id ORDER BY date) AS change FROM daily),
e AS (SELECT date AS event, date AS event_date FROM calendar), h AS ({NEAREST} FROM e JOIN c d ON d.date BETWEEN e.event_date - 3 AND e.event_date + 3 GROUP BY ALL),
k AS (SELECT h.event, max(CASE WHEN c.series_id = 'ORD.1-URGENT' THEN c.change END) AS timing, max(CASE WHEN c.series_id = 'ORD.2-HIGH' THEN c.change END) AS other FROM h JOIN c ON c.series_id = h.series_id AND c.date = h.actual_date GROUP BY 1),
mp AS (SELECT event, timing, other - timing AS path, CASE WHEN timing > 0.05 THEN 'tightening' WHEN timing < -0.05 THEN 'easing' WHEN timing IS NOT NULL THEN 'on_hold' END AS direction FROM k)"""


@query("meeting_panel", f"WITH {DAILY}, {CALENDAR}, {MEETINGS} SELECT event, {R('timing')} AS timing, {R('path')} AS path, direction FROM mp")
def meeting_panel(spark: S, sf: str) -> D:
    return _meetings(spark, sf)


@query("era_share", f"""WITH {DAILY}, {CALENDAR}, {WINDOWS}, {MEETINGS}
SELECT name, CAST(count(*) AS BIGINT) AS n, {R('avg(abs(path)) / (avg(abs(path)) + avg(abs(timing)))')} AS path_share FROM mp JOIN windows ON event BETWEEN start_date AND end_date WHERE timing IS NOT NULL AND path IS NOT NULL GROUP BY 1 HAVING count(*) >= 3""")
def era_share(spark: S, sf: str) -> D:
    return ev.era_share(_meetings(spark, sf), episodes(spark), 3)


@query("era_ols")
def era_ols(spark: S, sf: str) -> D:
    d = al.within(fixture(spark, sf, DAILY, MONTHLY, PAIRS), episodes(spark)).withColumn("c", F.month("date").cast("double"))
    return rg.robust_se(d, "b", ["a", "c"], ["name", "pair_id"], "date", hc3=True)


RUNFLAG = """f AS (SELECT *, CASE WHEN flag <> lag(flag) OVER (PARTITION BY series_id ORDER BY date) THEN 1 ELSE 0 END AS step FROM flags), r AS (SELECT *, sum(step) OVER (PARTITION BY series_id ORDER BY date) AS run FROM f)"""


@query("runs_from_flag", f"""WITH {MONTHLY}, {FLAGS}, {RUNFLAG} SELECT series_id, min(date) AS start_date, max(date) AS end_date, CAST(count(*) AS BIGINT) AS n FROM r WHERE flag = 1 GROUP BY series_id, run""")
def runs_from_flag(spark: S, sf: str) -> D:
    return ev.runs_from_flag(fixture(spark, sf, MONTHLY, FLAGS))


LEVEL = "(SELECT series_id AS sid, quantile_cont(value, 0.5) AS med FROM monthly GROUP BY 1)"
EPI = f"""scaled AS (SELECT series_id, date, value / med AS value FROM monthly JOIN {LEVEL} q ON q.sid = series_id),
f AS (SELECT *, CASE WHEN value > 1.0 THEN 1 ELSE 0 END AS above FROM scaled), g AS (SELECT *, CASE WHEN above <> lag(above) OVER w THEN 1 ELSE 0 END AS step FROM f WINDOW w AS (PARTITION BY series_id ORDER BY date)),
r AS (SELECT *, sum(step) OVER (PARTITION BY series_id ORDER BY date) AS run FROM g),
ep AS (SELECT series_id, min(date) AS start_date, max(date) AS end_date, count(*) AS duration, max(value) AS peak, arg_max(date, value) AS peak_date FROM r WHERE above = 1 GROUP BY series_id, run HAVING count(*) >= 2)"""
SCALED = "scaled AS (SELECT series_id, date, value / med AS value FROM monthly JOIN (SELECT series_id AS sid, percentile(value, 0.5) AS med FROM monthly GROUP BY 1) q ON q.sid = series_id)"


def _episodes(spark: S, sf: str) -> D:
    return ev.threshold_episodes(fixture(spark, sf, MONTHLY, SCALED), 1.0, 2)


@query("threshold_episodes", f"WITH {MONTHLY}, {EPI} SELECT series_id, start_date, end_date, CAST(duration AS BIGINT) AS duration, {R('peak')} AS peak, peak_date FROM ep")
def threshold_episodes(spark: S, sf: str) -> D:
    return _episodes(spark, sf)


@query("episode_drivers", f"""WITH {MONTHLY}, {CURVE}, {EPI}, t AS (SELECT date, value FROM curve WHERE tenor = 1)
SELECT ep.series_id, ep.start_date, ep.end_date, CAST(duration AS BIGINT) AS duration, {R('peak')} AS peak, peak_date, {R('b.value - a.value')} AS support_change,
 CASE WHEN b.value - a.value > 0.05 THEN 'rising' WHEN b.value - a.value < -0.05 THEN 'falling' WHEN b.value - a.value IS NOT NULL THEN 'flat' ELSE 'unknown' END AS driver
FROM ep LEFT JOIN t a ON a.date = ep.start_date LEFT JOIN t b ON b.date = ep.end_date""")
def episode_drivers(spark: S, sf: str) -> D:
    return ev.episode_drivers(_episodes(spark, sf), fixture(spark, sf, CURVE).filter("tenor = 1"), 0.05)


@query("episode_real_rates", f"""WITH {MONTHLY}, {CURVE}, {EPI}, t AS (SELECT date, value FROM curve WHERE tenor = 1)
SELECT ep.series_id, ep.start_date, ep.end_date, CAST(any_value(duration) AS BIGINT) AS duration, {R('any_value(peak)')} AS peak, any_value(peak_date) AS peak_date, {R('min(t.value - s.value)')} AS min_real_rate
FROM ep LEFT JOIN scaled s ON s.series_id = ep.series_id AND s.date BETWEEN ep.start_date AND ep.end_date LEFT JOIN t ON t.date = s.date GROUP BY 1, 2, 3""")
def episode_real_rates(spark: S, sf: str) -> D:
    return ev.episode_real_rates(_episodes(spark, sf), fixture(spark, sf, MONTHLY, SCALED), fixture(spark, sf, CURVE).filter("tenor = 1"))


@query("driver_counts", f"""WITH {MONTHLY}, {CURVE}, {EPI}, t AS (SELECT date, value FROM curve WHERE tenor = 1),
d AS (SELECT ep.series_id, CASE WHEN b.value - a.value > 0.05 THEN 'rising' WHEN b.value - a.value < -0.05 THEN 'falling' WHEN b.value - a.value IS NOT NULL THEN 'flat' ELSE 'unknown' END AS driver FROM ep LEFT JOIN t a ON a.date = ep.start_date LEFT JOIN t b ON b.date = ep.end_date)
SELECT series_id, driver, CAST(count(*) AS BIGINT) AS n, {R('count(*) / sum(count(*)) OVER (PARTITION BY series_id)')} AS share FROM d GROUP BY 1, 2""")
def driver_counts(spark: S, sf: str) -> D:
    return ev.driver_counts(ev.episode_drivers(_episodes(spark, sf), fixture(spark, sf, CURVE).filter("tenor = 1"), 0.05))


@query("current_episode", f"WITH {MONTHLY}, {EPI} SELECT series_id, start_date, end_date, CAST(duration AS BIGINT) AS duration, {R('peak')} AS peak, peak_date FROM (SELECT *, row_number() OVER (PARTITION BY series_id ORDER BY end_date DESC) AS k FROM ep) WHERE k = 1 AND end_date >= DATE '2001-02-01'")
def current_episode(spark: S, sf: str) -> D:
    return ev.current_episode(_episodes(spark, sf), "2001-08-01")


@query("episode_distribution", f"""WITH {MONTHLY}, {EPI}, u AS (SELECT series_id, 'duration' AS measure, CAST(duration AS DOUBLE) AS x FROM ep UNION ALL SELECT series_id, 'peak', peak FROM ep)
SELECT series_id, measure, CAST(count(x) AS BIGINT) AS n, {R('quantile_cont(x, 0.5)')} AS median, {R('quantile_cont(x, 0.25)')} AS p25, {R('quantile_cont(x, 0.75)')} AS p75, {R('max(x)')} AS max FROM u GROUP BY 1, 2""")
def episode_distribution(spark: S, sf: str) -> D:
    return ev.episode_distribution(_episodes(spark, sf), ["duration", "peak"], ["series_id"])


@query("compare_to_episodes", f"""WITH {MONTHLY}, {WINDOWS}, l AS (SELECT series_id, arg_max(value, date) AS v FROM monthly GROUP BY 1)
SELECT w.name, l.series_id, CAST(count(m.value) AS BIGINT) AS n, {R('avg(m.value)')} AS mean, {R('min(m.value)')} AS min, {R('max(m.value)')} AS max, {R('any_value(l.v) - avg(m.value)')} AS now_less_mean
FROM l JOIN windows w ON true LEFT JOIN monthly m ON m.series_id = l.series_id AND m.date BETWEEN start_date AND end_date GROUP BY 1, 2""")
def compare_to_episodes(spark: S, sf: str) -> D:
    return ev.compare_to_episodes(fixture(spark, sf, MONTHLY), episodes(spark))


@query("in_interval", f"WITH {MONTHLY}, {WINDOWS} SELECT series_id, date, {R('value')} AS value, EXISTS (SELECT 1 FROM windows WHERE date BETWEEN start_date AND end_date) AS inside FROM monthly")
def in_interval(spark: S, sf: str) -> D:
    return ev.in_interval(fixture(spark, sf, MONTHLY), episodes(spark))


@query("grouped_ols", f"""WITH {MONTHLY}, {PAIRS}, m AS (SELECT pair_id, regr_slope(b, a) AS s, regr_intercept(b, a) AS i, count(*) AS n, regr_r2(b, a) AS r2, regr_sxx(b, a) AS sxx, avg(a) AS ma, regr_syy(b, a) * (1 - regr_r2(b, a)) AS rss FROM pairs GROUP BY 1)
SELECT pair_id, 'a' AS term, {R('s')} AS beta, {R('sqrt(rss / (n - 2) / sxx)')} AS se, CAST(n AS BIGINT) AS n, {R('r2')} AS r2, {R('rss')} AS rss FROM m
UNION ALL SELECT pair_id, 'const', {R('i')}, {R('sqrt(rss / (n - 2) * (1.0 / n + ma * ma / sxx))')}, CAST(n AS BIGINT), {R('r2')}, {R('rss')} FROM m""")
def grouped_ols(spark: S, sf: str) -> D:
    return rg.grouped_ols(fixture(spark, sf, MONTHLY, PAIRS), "b", ["a"], ["pair_id"])


@query("hac_ols", f"""WITH {MONTHLY}, {PAIRS}, {hac_ctes("pairs", "pair_id", "b", "a", 6)}
SELECT hk AS pair_id, CASE term WHEN 'x' THEN 'a' ELSE term END AS term, {R('beta')} AS beta, {R('se')} AS se, CAST(n AS BIGINT) AS n, {R('r2')} AS r2, {R('rss')} AS rss, {R('se_robust')} AS se_robust FROM fit""")
def hac_ols(spark: S, sf: str) -> D:
    return rg.robust_se(fixture(spark, sf, MONTHLY, PAIRS), "b", ["a"], ["pair_id"], "date", 6)


@query("local_projection")
def local_projection(spark: S, sf: str) -> D:
    d = fixture(spark, sf, MONTHLY, PAIRS).withColumn("series_id", F.col("pair_id"))
    return rg.local_projection(d, "b", "a", 6, 2)


@query("local_projection_plain", f"""
WITH {MONTHLY}, {PAIRS}, lp AS (SELECT concat(pair_id, '#', h) AS hk0, pair_id, h, date, a, CASE h {' '.join(f'WHEN {h} THEN lead(b, {h}) OVER w' for h in range(7))} END AS ahead
  FROM pairs, range(7) r(h) WINDOW w AS (PARTITION BY pair_id, h ORDER BY date)), {hac_ctes("lp", "hk0", "ahead", "a", 6)}
SELECT split_part(hk, '#', 1) AS series_id, CAST(split_part(hk, '#', 2) AS BIGINT) AS h, {R('beta')} AS beta, {R('se_robust')} AS se_robust, {R('beta - 1.959963984540054 * se_robust')} AS lower, {R('beta + 1.959963984540054 * se_robust')} AS upper, CAST(n AS BIGINT) AS n
FROM fit WHERE term = 'x'""")
def local_projection_plain(spark: S, sf: str) -> D:
    """Without own lags, where the fit has one regressor."""
    d = fixture(spark, sf, MONTHLY, PAIRS).withColumnRenamed("pair_id", "series_id")
    return rg.local_projection(d, "b", "a", 6, 0)


@query("scatter_fit", f"""WITH {MONTHLY}, {PAIRS} SELECT pair_id, CASE WHEN date < DATE '1998-01-01' THEN 'before' ELSE 'after' END AS side, CAST(count(*) AS BIGINT) AS n, {R('regr_slope(b, a)')} AS slope, {R('regr_intercept(b, a)')} AS intercept FROM pairs GROUP BY 1, 2 HAVING count(*) >= 5""")
def scatter_fit(spark: S, sf: str) -> D:
    return rg.scatter_fit(fixture(spark, sf, MONTHLY, PAIRS), "1998-01-01")


ASSETS = """prices AS (
  SELECT l_suppkey % 13 AS asset, CAST(date_trunc('month', l_shipdate) AS DATE) AS date, ln(CAST(sum(CAST(l_extendedprice AS DECIMAL(18,2))) AS DOUBLE) / count(*)) AS p FROM lineitem GROUP BY 1, 2)"""


def _assets(spark: S, sf: str) -> D:
    from pyspark.sql import Window

    p = fixture(spark, sf, ASSETS)
    r = p.withColumn("ret", F.col("p") - F.lag("p").over(Window.partitionBy("asset").orderBy("date")))
    m = al.returns(fixture(spark, sf, MONTHLY), "diff").groupBy("date").pivot("series_id", ["ORD.1-URGENT", "ORD.2-HIGH"]).agg(F.first("value"))
    return r.join(m.withColumnsRenamed({"ORD.1-URGENT": "f1", "ORD.2-HIGH": "f2"}), "date")


@query("fama_macbeth")
def fama_macbeth(spark: S, sf: str) -> D:
    return rg.fama_macbeth(_assets(spark, sf), ["f1", "f2"], 24)


@query("fama_macbeth_by_regime")
def fama_macbeth_by_regime(spark: S, sf: str) -> D:
    d = _assets(spark, sf).withColumn("regime", F.when(F.year("date") < 1998, "early").otherwise("late"))
    return rg.fama_macbeth(d, ["f1", "f2"], 24, ["regime"])


#: Prices of thirteen groups of suppliers, and the first difference of an order series as the only factor.
PRICED = """lvl AS (
  SELECT concat('G', l_suppkey % 13) AS series_id, CAST(date_trunc('month', l_shipdate) AS DATE) AS date, CAST(sum(CAST(l_extendedprice AS DECIMAL(18,2))) AS DOUBLE) / count(*) AS value FROM lineitem GROUP BY 1, 2)"""
EARLY = "date < DATE '1998-07-01'"


def _priced_sample(name: str, where: str, least: int) -> str:
    """Premium, standard error and t of one factor in closed form."""
    return f"""
{name}b AS (SELECT asset, regr_slope(ret, f) AS beta, avg(ret) AS mean, count(*) AS n FROM pan WHERE {where} GROUP BY 1 HAVING count(*) >= 24),
{name}f AS (SELECT var_samp(f) AS vf, count(*) AS n_obs FROM (SELECT DISTINCT date, f FROM pan WHERE {where})),
{name}2 AS (SELECT count(*) AS n, regr_slope(mean, beta) AS l, regr_sxx(mean, beta) AS sxx, regr_syy(mean, beta) * (1 - regr_r2(mean, beta)) AS rss FROM {name}b),
{name} AS (SELECT l, sqrt(rss / (n - 2) / sxx) * sqrt(greatest(1, 1 + l * l / vf)) AS se FROM {name}2, {name}f WHERE n_obs >= {least} AND n > 2)"""


@query("factor_pricing", f"""WITH {MONTHLY}, {PRICED},
ret0 AS (SELECT series_id AS asset, date, 100 * (ln(value) - ln(lag(value) OVER (PARTITION BY series_id ORDER BY date))) AS ret, count(*) OVER (PARTITION BY series_id) AS n FROM lvl),
ret AS (SELECT * FROM ret0 WHERE ret IS NOT NULL AND n > 24), sh AS (SELECT date, value - lag(value) OVER (ORDER BY date) AS f FROM monthly WHERE series_id = 'ORD.1-URGENT'),
pan0 AS (SELECT asset, ret.date AS date, ret, f FROM ret JOIN sh ON sh.date = ret.date WHERE f IS NOT NULL), pan AS (SELECT * FROM pan0 WHERE date IN (SELECT date FROM pan0 GROUP BY 1 HAVING count(*) = (SELECT count(DISTINCT asset) FROM ret))),
{_priced_sample("fl", "true", 36)}, {_priced_sample("ea", EARLY, 24)}, {_priced_sample("la", f"NOT {EARLY}", 24)},
h AS (SELECT 'full' AS w, l AS premium, l / se AS t FROM fl UNION ALL SELECT 'early_vs_late', ea.l - la.l, (ea.l - la.l) / sqrt(ea.se * ea.se + la.se * la.se) FROM ea, la)
SELECT 'cross_asset_factor' AS kind, 'factors' AS key, w AS "window", {R('least(abs(t) / 4, 1.0)')} AS score, (SELECT max(date) FROM pan) AS date, {R('abs(t)')} AS max_t, round(premium, 4) AS premium FROM h WHERE abs(t) >= 0.05""")
def factor_pricing(spark: S, sf: str) -> D:
    h = pr.factor_pricing(_priced(spark, sf), ["f"], _early_late(), [("early", "late")], 0.05)
    premium = F.get_json_object("evidence", "$.factors[0].premium").cast("double")
    return h.select("kind", "key", "window", "score", "date", F.get_json_object("evidence", "$.max_t").cast("double").alias("max_t"), premium.alias("premium"))


def _early_late() -> dict:
    return {"early": F.expr(EARLY), "late": ~F.expr(EARLY)}


def _priced(spark: S, sf: str) -> D:
    levels = written(fixture(spark, sf, PRICED), "priced")
    assets = levels.select(F.col("series_id").alias("name"), "series_id").distinct().withColumns({"how": F.lit("log"), "scale": F.lit(1.0)})
    factors = spark.createDataFrame([("f", "ORD.1-URGENT", "diff", 1.0)], "name string, series_id string, how string, scale double")
    return pr.pricing_panel(pr.asset_returns(levels, assets), pr.factor_shocks(fixture(spark, sf, MONTHLY), factors), ["f"])


@query("adf_test")
def adf_test(spark: S, sf: str) -> D:
    return rg.adf(fixture(spark, sf, MONTHLY))


@query("engle_granger")
def engle_granger(spark: S, sf: str) -> D:
    return rg.engle_granger(fixture(spark, sf, MONTHLY, PAIRS))


@query("granger")
def granger(spark: S, sf: str) -> D:
    return rg.granger(fixture(spark, sf, MONTHLY, PAIRS), 3)


@query("granger_one_lag", f"""
WITH {MONTHLY}, {PAIRS}, g AS (SELECT pair_id, a AS y, lag(a) OVER w AS x, lag(b) OVER w AS z FROM pairs WINDOW w AS (PARTITION BY pair_id ORDER BY date)),
m AS (SELECT pair_id, count(*) AS n, regr_syy(y, x) AS yy, regr_sxx(y, x) AS xx, regr_sxy(y, x) AS xy, regr_sxx(y, z) AS zz, regr_sxy(y, z) AS zy, regr_sxy(x, z) AS xz FROM g WHERE x IS NOT NULL GROUP BY 1),
r AS (SELECT pair_id, n, yy - xy * xy / xx AS r0, yy - ((xy * zz - zy * xz) * xy + (zy * xx - xy * xz) * zy) / (xx * zz - xz * xz) AS r1 FROM m),
f AS (SELECT pair_id, n - 3 AS df2, (r0 - r1) / (r1 / (n - 3)) AS f FROM r)
SELECT pair_id, CAST(1 AS BIGINT) AS lag, {R('f')} AS f, CAST(1 AS BIGINT) AS df1, CAST(df2 AS BIGINT) AS df2, {R(f_tail_sql('f', '1', 'df2'))} AS p_value FROM f""")
def granger_one_lag(spark: S, sf: str) -> D:
    return rg.granger(fixture(spark, sf, MONTHLY, PAIRS), 1)


@query("granger_minima")
def granger_minima(spark: S, sf: str) -> D:
    return rg.granger_minima(rg.granger(fixture(spark, sf, MONTHLY, PAIRS), 3))


@query("tail_probabilities", f"""
WITH {MONTHLY}, v AS (SELECT series_id, date, abs(value - avg(value) OVER (PARTITION BY series_id)) / stddev_samp(value) OVER (PARTITION BY series_id) AS x, CAST(extract(month FROM date) AS INT) AS m FROM monthly)
SELECT series_id, date, {R(f_tail_sql('x', 'm', '30'))} AS f_p, {R(f_tail_sql('x * x', '1', 'm + 2'))} AS t_p, {R('1 - x / sqrt(2 + x * x)')} AS t2_p, {R('pow(1 + 2 * x / 40, -20)')} AS f2_p FROM v""")
def tail_probabilities(spark: S, sf: str) -> D:
    """Tails of deviations, with degrees of freedom by month; of t with two and of F with two degrees also in closed form."""
    w = Window.partitionBy("series_id")
    x = F.abs(F.col("value") - F.avg("value").over(w)) / F.stddev_samp("value").over(w)
    v = fixture(spark, sf, MONTHLY).withColumns({"x": x, "m": F.month("date")})
    lit = lambda n: F.lit(n)
    return v.select(
        "series_id", "date", ds.f_tail(F.col("x"), F.col("m"), lit(30)).alias("f_p"), ds.t_tails(F.col("x"), F.col("m") + 2).alias("t_p"),
        ds.t_tails(F.col("x"), lit(2)).alias("t2_p"), ds.f_tail(F.col("x"), lit(2), lit(40)).alias("f2_p"),
    )


@query("var_model")
def var_model(spark: S, sf: str) -> D:
    return rg.var_model(fixture(spark, sf, MONTHLY, PAIRS), ["a", "b"], 2, ["pair_id"])


@query("sentiment_bond")
def sentiment_bond(spark: S, sf: str) -> D:
    c = fixture(spark, sf, CURVE).groupBy("date").pivot("tenor", [1, 5, 7]).agg(F.first("value")).withColumnsRenamed({"1": "rf", "5": "slope", "7": "y"})
    return rg.sentiment_bond(c.withColumn("panel_id", F.lit("curve")), ["slope", "rf"])


@query("onset_labels", f"""WITH {MONTHLY}, {FLAGS}, f AS (SELECT series_id, date, CASE WHEN flag = 1 AND lag(flag) OVER (PARTITION BY series_id ORDER BY date) = 0 THEN 1 ELSE 0 END AS flip FROM flags)
SELECT series_id, date, CASE WHEN count(flip) OVER w = 4 THEN CAST(max(flip) OVER w AS BIGINT) END AS label FROM f WINDOW w AS (PARTITION BY series_id ORDER BY date ROWS BETWEEN 4 FOLLOWING AND 7 FOLLOWING)""")
def onset_labels(spark: S, sf: str) -> D:
    return rg.onset_labels(fixture(spark, sf, MONTHLY, FLAGS))


@query("onset_auroc", f"""WITH {MONTHLY}, {FLAGS}, f AS (SELECT series_id, date, CASE WHEN flag = 1 AND lag(flag) OVER (PARTITION BY series_id ORDER BY date) = 0 THEN 1 ELSE 0 END AS flip FROM flags),
l AS (SELECT series_id, date, CASE WHEN count(flip) OVER w = 4 THEN max(flip) OVER w END AS label FROM f WINDOW w AS (PARTITION BY series_id ORDER BY date ROWS BETWEEN 4 FOLLOWING AND 7 FOLLOWING)),
r AS (SELECT l.series_id, label, rank() OVER (PARTITION BY l.series_id ORDER BY m.value) AS r FROM l JOIN monthly m ON m.series_id = l.series_id AND m.date = l.date WHERE label IS NOT NULL),
g AS (SELECT series_id, count(*) AS n, sum(label) AS p, sum(CASE WHEN label = 1 THEN r END) AS s FROM r GROUP BY 1)
SELECT series_id, CAST(n AS BIGINT) AS n, {R('(s - p * (p + 1) / 2.0) / nullif(p * (n - p), 0)')} AS auroc FROM g""")
def onset_auroc(spark: S, sf: str) -> D:
    m = fixture(spark, sf, MONTHLY)
    d = rg.onset_labels(fixture(spark, sf, MONTHLY, FLAGS)).join(m.withColumnRenamed("value", "score"), ["series_id", "date"])
    return rg.auroc(d, ["series_id"])


def _onset_scores(spark: S, sf: str) -> D:
    m = fixture(spark, sf, MONTHLY)
    return rg.onset_logit(rg.onset_labels(fixture(spark, sf, MONTHLY, FLAGS)).join(m, ["series_id", "date"]), ["value"])


@query("onset_logit")
def onset_logit(spark: S, sf: str) -> D:
    return _onset_scores(spark, sf)


@query("onset_summary")
def onset_summary(spark: S, sf: str) -> D:
    return rg.onset_summary(_onset_scores(spark, sf))


@query("contemporaneous", f"""
WITH {CURVE}, w AS (SELECT date, max(CASE WHEN tenor = 1 THEN value END) AS t1, max(CASE WHEN tenor = 3 THEN value END) AS t3, max(CASE WHEN tenor = 7 THEN value END) AS t7 FROM curve GROUP BY 1)
SELECT 'curve' AS panel_id, 't1' AS factor, 't7' AS other, CAST(count(*) AS BIGINT) AS n, {R('corr(t1, t7)')} AS correlation FROM w WHERE t1 + t3 + t7 IS NOT NULL
UNION ALL SELECT 'curve', 't3', 't7', CAST(count(*) AS BIGINT), {R('corr(t3, t7)')} FROM w WHERE t1 + t3 + t7 IS NOT NULL""")
def contemporaneous(spark: S, sf: str) -> D:
    w = fixture(spark, sf, CURVE).groupBy("date").pivot("tenor", [1, 3, 7]).agg(F.first("value")).withColumnsRenamed({"1": "t1", "3": "t3", "7": "t7"})
    return rg.contemporaneous(w.withColumn("panel_id", F.lit("curve")), ["t1", "t3"], ["t7"])


# detectors: thresholds loosened to the short history of the fixtures


def opened(hits: D, **evidence: str) -> D:
    """hits with the given fields of their evidence as columns."""
    fields = [F.get_json_object("evidence", f"$.{k}").cast(t).alias(k) for k, t in evidence.items()]
    return hits.select("kind", "key", "window", "score", "date", *fields)


@query("notable_move", f"""WITH {DAILY}, l AS (SELECT series_id, max(date) AS date, arg_max(value, date) AS v, count(*) AS n FROM daily GROUP BY 1),
p AS (SELECT d.series_id, any_value(l.date) AS date, any_value(l.v) AS v, count(*) AS n, avg(CASE WHEN d.value <= l.v THEN 1.0 ELSE 0.0 END) AS p FROM daily d JOIN l ON d.series_id = l.series_id GROUP BY 1),
c AS (SELECT * FROM (SELECT series_id, date, value - lag(value) OVER (PARTITION BY series_id ORDER BY date) AS c FROM daily) WHERE c IS NOT NULL), m AS (SELECT series_id, quantile_cont(c, 0.5) AS med FROM c GROUP BY 1),
z AS (SELECT c.series_id, max(c.date) AS date, arg_max(c.c, c.date) AS v, count(*) AS n, (arg_max(c.c, c.date) - any_value(m.med)) / (1.4826 * quantile_cont(abs(c.c - m.med), 0.5)) AS z FROM c JOIN m ON c.series_id = m.series_id GROUP BY 1)
SELECT 'notable_move_level' AS kind, series_id AS key, 'full' AS "window", {R('2 * abs(p - 0.5)')} AS score, date, {R('v')} AS value, {R('p')} AS percentile, NULL AS z, CAST(n AS BIGINT) AS n FROM p WHERE p <= 0.3 OR p >= 0.7
UNION ALL SELECT 'notable_move_change', series_id, 'full', {R('abs(z)')}, date, {R('v')}, NULL, {R('z')}, CAST(n AS BIGINT) FROM z WHERE abs(z) >= 0.5""")
def notable_move(spark: S, sf: str) -> D:
    return opened(dt.notable_move(fixture(spark, sf, DAILY), tails=0.3, z=0.5), value="double", percentile="double", z="double", n="bigint")


def _break_hits(kind: str, source: str, shift: float) -> str:
    """Rows of the hits of breaks, after break_ctes() and stats_ctes(); evidence as columns."""
    return f"""
SELECT '{kind}' AS kind, series_id AS key, 'full' AS "window", {R('abs(move) / std * greatest(0.2, 1 - age / 15)')} AS score, since AS date, CAST(k AS BIGINT) AS k, array_to_string(dates, ',') AS break_dates,
       {R('before')} AS before, {R('mean')} AS mean, {R('move')} AS move, {R('age')} AS age_years
FROM (SELECT r.series_id, r.since, r.mean, p.mean AS before, r.mean - p.mean AS move, date_diff('day', r.since, r.until) / 365.25 AS age, t.k, t.dates, d.std FROM rs r JOIN best t ON r.series_id = t.series_id AND t.best AND t.k >= 1 AND r.regime = t.k
  JOIN rs p ON p.series_id = r.series_id AND p.regime = r.regime - 1 JOIN (SELECT series_id, stddev_samp(value) AS std FROM {source} GROUP BY 1) d ON d.series_id = r.series_id)
WHERE age <= 15 AND abs(move) / std >= {shift}"""


BREAK_EVIDENCE = {"k": "bigint", "break_dates": "string", "before": "double", "mean": "double", "move": "double", "age_years": "double"}


DIFFS = "diffs AS (SELECT * FROM (SELECT pair_id, date, a - lag(a) OVER w AS a, b - lag(b) OVER w AS b FROM pairs WINDOW w AS (PARTITION BY pair_id ORDER BY date)) WHERE a IS NOT NULL AND b IS NOT NULL)"


def _ranked(x: str, by: str) -> str:
    return f"rank() OVER (PARTITION BY {by} ORDER BY {x}) + (count(*) OVER (PARTITION BY {by}, {x}) - 1) / 2.0"


def rolling_ctes(source: str, window: int, least_rows: int) -> str:
    """rc (pair_id, date, c): rolling rank correlations of pairs with so many rows."""
    return f"""
rn AS (SELECT *, row_number() OVER (PARTITION BY pair_id ORDER BY date) AS rn, count(*) OVER (PARTITION BY pair_id) AS n FROM {source}),
rm AS (SELECT e.pair_id, e.rn AS spot, n.a, n.b, n.date FROM rn n JOIN rn e ON n.pair_id = e.pair_id AND n.rn BETWEEN e.rn - {window - 1} AND e.rn WHERE e.n >= {least_rows} AND e.rn >= {window}),
rk AS (SELECT pair_id, spot, date, {_ranked('a', 'pair_id, spot')} AS ra, {_ranked('b', 'pair_id, spot')} AS rb FROM rm),
rc AS (SELECT pair_id, max(date) AS date, corr(ra, rb) AS c FROM rk GROUP BY pair_id, spot)"""


@query("correlation_shift", f"""WITH {MONTHLY}, {PAIRS}, {DIFFS}, {rolling_ctes("diffs", 12, 24)},
sn AS (SELECT *, row_number() OVER (PARTITION BY pair_id ORDER BY date) - 1 AS i, count(*) OVER (PARTITION BY pair_id) AS n FROM diffs),
sp AS (SELECT *, CASE WHEN i >= floor(n * 3 / 4.0) THEN 3 WHEN i >= floor(n * 2 / 4.0) THEN 2 WHEN i >= floor(n / 4.0) THEN 1 ELSE 0 END AS part FROM sn),
sf AS (SELECT pair_id, corr(ra, rb) AS c FROM (SELECT pair_id, {_ranked('a', 'pair_id')} AS ra, {_ranked('b', 'pair_id')} AS rb FROM sp) GROUP BY 1),
ss AS (SELECT pair_id, max(c) - min(c) AS spread FROM (SELECT pair_id, part, corr(ra, rb) AS c FROM (SELECT pair_id, part, {_ranked('a', 'pair_id, part')} AS ra, {_ranked('b', 'pair_id, part')} AS rb FROM sp) GROUP BY 1, 2) GROUP BY 1),
o AS (SELECT rc.*, sf.c AS full_corr, spread, abs(rc.c - sf.c) >= 0.2 AS off FROM rc JOIN sf ON rc.pair_id = sf.pair_id JOIN ss ON ss.pair_id = rc.pair_id),
t AS (SELECT *, off AND NOT coalesce(lag(off) OVER (PARTITION BY pair_id ORDER BY date), false) AS turn FROM o),
g AS (SELECT pair_id, max(date) AS date, arg_max(c, date) AS recent, any_value(full_corr) AS full_corr, any_value(spread) AS spread, min(date) FILTER (turn) AS first_crossing, max(date) FILTER (turn) AS last_crossing FROM t GROUP BY 1)
SELECT 'correlation_shift' AS kind, pair_id AS key, '12' AS "window", {R('abs(recent - full_corr)')} AS score, date, {R('recent')} AS recent, {R('full_corr')} AS full_corr, {R('spread')} AS spread, first_crossing, last_crossing
FROM g WHERE abs(recent - full_corr) >= 0.2 AND spread <= 2 AND greatest(abs(recent), abs(full_corr)) >= 0.25""")
def correlation_shift(spark: S, sf: str) -> D:
    h = dt.correlation_shift(fixture(spark, sf, MONTHLY, PAIRS), 12, 0.2, 2.0)
    return opened(h, recent="double", full_corr="double", spread="double", first_crossing="date", last_crossing="date")


@query("correlation_breaks", f"""WITH {MONTHLY}, {PAIRS}, {DIFFS}, {rolling_ctes("diffs", 12, 24)},
rolled AS (SELECT pair_id AS series_id, date, c AS value FROM rc WHERE c IS NOT NULL AND pair_id IN (SELECT pair_id FROM rc WHERE c IS NOT NULL GROUP BY 1 HAVING count(*) >= 24)),
{break_ctes('rolled')}, {stats_ctes('rolled')}, h AS ({_break_hits('correlation_break', 'rolled', 0.0)}) SELECT * REPLACE ('12' AS "window") FROM h WHERE abs(move) >= 0.2""")
def correlation_breaks(spark: S, sf: str) -> D:
    return opened(dt.correlation_breaks(fixture(spark, sf, MONTHLY, PAIRS), 12), **BREAK_EVIDENCE)


def _peaks(where: str, name: str) -> str:
    return f"""
{name}n AS (SELECT *, row_number() OVER (PARTITION BY pair_id ORDER BY date) AS rn FROM cut WHERE {where}),
{name}c AS (SELECT x.pair_id, l.lag, corr(x.a, y.b) AS c, count(*) AS n FROM {name}n x, range(-3, 4) l(lag), {name}n y WHERE y.pair_id = x.pair_id AND y.rn = x.rn + l.lag GROUP BY 1, 2 HAVING count(*) >= 10),
{name} AS (SELECT pair_id, lag, c FROM (SELECT *, row_number() OVER (PARTITION BY pair_id ORDER BY abs(c) DESC, abs(lag), lag) AS k FROM {name}c WHERE c IS NOT NULL) WHERE k = 1)"""


@query("lead_lag_change", f"""WITH {MONTHLY}, {PAIRS}, {DIFFS}, cut AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY pair_id ORDER BY date DESC) AS back, count(*) OVER (PARTITION BY pair_id) AS n FROM diffs) WHERE n >= 60),
{_peaks("back > 15", "p0")}, {_peaks("back <= 15", "p1")}, e AS (SELECT pair_id, max(date) AS date FROM diffs GROUP BY 1)
SELECT 'lead_lag_change' AS kind, o.pair_id AS key, '15' AS "window", {R('abs(w.c - o.c) + abs(w.lag - o.lag) / 3.0')} AS score, date, CAST(o.lag AS BIGINT) AS lag0, {R('o.c')} AS c0, CAST(w.lag AS BIGINT) AS lag1, {R('w.c')} AS c1
FROM p0 o JOIN p1 w ON o.pair_id = w.pair_id JOIN e ON e.pair_id = o.pair_id WHERE (abs(w.lag - o.lag) >= 1 OR abs(w.c - o.c) >= 0.3) AND greatest(abs(o.c), abs(w.c)) >= 0.25""")
def lead_lag_change(spark: S, sf: str) -> D:
    return opened(dt.lead_lag_change(fixture(spark, sf, MONTHLY, PAIRS), 3, 15), lag0="bigint", c0="double", lag1="bigint", c1="double")


@query("regime_transition", f"""WITH {MONTHLY}, q AS (SELECT series_id, quantile_cont(value, 0.33) AS a, quantile_cont(value, 0.67) AS b FROM monthly GROUP BY 1),
g AS (SELECT m.series_id, date, CASE WHEN value <= a THEN 'low' WHEN value <= b THEN 'mid' ELSE 'high' END AS regime FROM monthly m JOIN q ON m.series_id = q.series_id WHERE a <> b),
t AS (SELECT *, CASE WHEN regime <> lag(regime) OVER (PARTITION BY series_id ORDER BY date) THEN 1 ELSE 0 END AS turn FROM g), r AS (SELECT *, sum(turn) OVER (PARTITION BY series_id ORDER BY date) AS run FROM t),
u AS (SELECT series_id, run, min(date) AS since, max(date) AS until, any_value(regime) AS regime, count(*) AS n FROM r GROUP BY 1, 2),
v AS (SELECT *, lag(regime) OVER w AS before, lag(until) OVER w - lag(since) OVER w AS held, sum(n) OVER (PARTITION BY series_id) AS total, max(run) OVER (PARTITION BY series_id) AS last, max(until) OVER (PARTITION BY series_id) AS now FROM u WINDOW w AS (PARTITION BY series_id ORDER BY run))
SELECT 'regime_transition' AS kind, series_id AS key, 'full' AS "window", {R('held / 365.0')} AS score, since AS date, before, regime, CAST(held AS BIGINT) AS held FROM v WHERE run = last AND run > 0 AND total >= 30 AND now - since <= 400""")
def regime_transition(spark: S, sf: str) -> D:
    hits = dt.regime_transition(st.quantile_regime(fixture(spark, sf, MONTHLY), [0.33, 0.67], ["low", "mid", "high"]), 400, 30)
    return opened(hits, before="string", regime="string", held="bigint")


@query("structural_break_hits", f"WITH {MONTHLY}, {break_ctes('monthly')}, {stats_ctes('monthly')} {_break_hits('structural_break', 'monthly', 0.2)}")
def structural_break_hits(spark: S, sf: str) -> D:
    return opened(dt.structural_break(fixture(spark, sf, MONTHLY), 0.2), **BREAK_EVIDENCE)


@query("structural_break_hits_daily", f"WITH {DAILY}, {STEPPED}, {break_ctes('stepped')}, {stats_ctes('stepped')} {_break_hits('structural_break', 'stepped', 0.5)}")
def structural_break_hits_daily(spark: S, sf: str) -> D:
    """Series of some 1,700 days, with a step."""
    return opened(dt.structural_break(fixture(spark, sf, DAILY, STEPPED)), **BREAK_EVIDENCE)


@query("cointegration_break")
def cointegration_break(spark: S, sf: str) -> D:
    """Each a with itself and half of b's deviations, which add up from 1999 on, so that the pairs come apart."""
    p = fixture(spark, sf, MONTHLY, PAIRS)
    late = F.col("date") >= F.lit("1999-01-01").cast("date")
    off = F.col("b") - F.avg("b").over(Window.partitionBy("pair_id"))
    apart = F.sum(F.when(late, off).otherwise(0.0)).over(Window.partitionBy("pair_id").orderBy("date"))
    return dt.cointegration_break(p.withColumn("b", F.col("a") + 0.5 * off + 0.4 * apart), 30)


@query("episode_anomaly", f"""WITH {MONTHLY}, {EPI}, l AS (SELECT *, start_date = max(start_date) OVER (PARTITION BY series_id) AS last FROM ep),
p AS (SELECT series_id, count(*) AS n, quantile_cont(duration, 0.75) AS d75, quantile_cont(peak, 0.75) AS p75 FROM l WHERE NOT last GROUP BY 1 HAVING count(*) >= 4)
SELECT 'episode_anomaly' AS kind, l.series_id AS key, 'episodes' AS "window", {R('(SELECT count(*) FROM l x WHERE NOT x.last AND x.series_id = l.series_id AND x.duration < l.duration) / p.n::DOUBLE')} AS score, start_date AS date,
 CAST(duration AS BIGINT) AS duration, {R('peak')} AS peak, {R('d75')} AS d75, {R('p75')} AS p75, CAST(n AS BIGINT) AS n FROM l JOIN p ON l.series_id = p.series_id WHERE last AND (duration >= d75 OR peak >= p75)""")
def episode_anomaly(spark: S, sf: str) -> D:
    return opened(dt.episode_anomaly(_episodes(spark, sf)), duration="bigint", peak="double", d75="double", p75="double", n="bigint")


@query("robust_z_signal", f"""WITH {MONTHLY}, m AS (SELECT series_id, quantile_cont(value, 0.5) AS med FROM monthly GROUP BY 1),
z AS (SELECT c.series_id, max(c.date) AS date, arg_max(c.value, c.date) AS v, count(*) AS n, (arg_max(c.value, c.date) - any_value(m.med)) / (1.4826 * quantile_cont(abs(c.value - m.med), 0.5)) AS z FROM monthly c JOIN m ON c.series_id = m.series_id GROUP BY 1)
SELECT 'robust_z_signal' AS kind, series_id AS key, 'full' AS "window", {R('abs(z)')} AS score, date, {R('v')} AS value, {R('z')} AS z, CAST(n AS BIGINT) AS n FROM z WHERE abs(z) >= 0.5""")
def robust_z_signal(spark: S, sf: str) -> D:
    return opened(dt.robust_z_signal(fixture(spark, sf, MONTHLY), 0.5), value="double", z="double", n="bigint")


def _factors(spark: S, sf: str) -> D:
    ns = cv.nelson_siegel(written(fixture(spark, sf, CURVE), "curve"))
    return ns.select("date", F.explode(F.create_map(*[x for c in ("level", "slope", "curvature") for x in (F.lit(c), F.col(c))])).alias("series_id", "value"))


NS_STATS = f"""{CURVE}, {LOADED}, nm AS (SELECT date, count(*)::DOUBLE AS n, sum(s) AS s, sum(c) AS c, sum(s*s) AS ss, sum(s*c) AS sc, sum(c*c) AS cc, sum(y) AS y, sum(s*y) AS sy, sum(c*y) AS cy FROM l GROUP BY 1),
nf AS (SELECT date, {_SOLVED} FROM nm WHERE n >= 3), nl AS (SELECT date, 'level' AS series_id, level AS value FROM nf UNION ALL SELECT date, 'slope', slope FROM nf UNION ALL SELECT date, 'curvature', curvature FROM nf),
nx AS (SELECT series_id, max(date) AS date, arg_max(value, date) AS v, count(*) AS n, avg(value) AS m, stddev_samp(value) AS sd FROM nl GROUP BY 1),
ns AS (SELECT nl.series_id, any_value(nx.date) AS date, any_value(v) AS v, any_value(n) AS n, any_value((v - m) / sd) AS z, avg(CASE WHEN value <= v THEN 1.0 ELSE 0.0 END) AS p FROM nl JOIN nx ON nl.series_id = nx.series_id GROUP BY 1)"""


@query("factor_extreme", f"""WITH {NS_STATS} SELECT 'factor_extreme' AS kind, series_id AS key, 'full' AS "window", round(least(abs(z) / 3, 1.0), 3) AS score, date, round(v, 3) AS value, round(z, 3) AS z, {R('p')} AS percentile FROM ns WHERE n >= 36 AND (p <= 0.4 OR p >= 0.6)""")
def factor_extreme(spark: S, sf: str) -> D:
    h = opened(dt.factor_extreme(_factors(spark, sf), tails=0.4), value="double", z="double", percentile="double")
    return h.withColumns({c: F.round(c, 3) for c in ("score", "value", "z")})


@query("curve_extreme", f"""WITH {NS_STATS} SELECT 'curve_factor_extreme' AS kind, 'curve' AS key, 'full' AS "window", round(least(max(abs(z)) / 3, 1.0), 3) AS score, max(date) AS date, round(max(abs(z)), 3) AS max_z, string_agg(series_id, ',' ORDER BY series_id) FILTER (p <= 0.4 OR p >= 0.6) AS extremes, CAST(max(n) AS BIGINT) AS n
FROM ns WHERE n >= 36 HAVING count(*) FILTER (p <= 0.4 OR p >= 0.6) > 0""")
def curve_extreme(spark: S, sf: str) -> D:
    h = opened(dt.curve_extreme(_factors(spark, sf), tails=0.4), max_z="double", extremes="string", n="bigint")
    return h.withColumns({"score": F.round("score", 3), "max_z": F.round("max_z", 3), "extremes": F.array_join(F.from_json("extremes", "array<string>"), ",")})


@query("level_regime_cross", f"""WITH {MONTHLY}, scaled AS (SELECT series_id, date, value / med AS value FROM monthly JOIN {LEVEL} q ON q.sid = series_id),
r AS (SELECT *, CASE WHEN value < 0.95 THEN 'calm' WHEN value < 1.05 THEN 'elevated' ELSE 'stressed' END AS regime FROM scaled), b AS (SELECT *, lag(regime, 3) OVER (PARTITION BY series_id ORDER BY date) AS before FROM r),
l AS (SELECT series_id, max(date) AS date, arg_max(value, date) AS value, arg_max(regime, date) AS regime, arg_max(before, date) AS before, (arg_max(value, date) - avg(value)) / stddev_samp(value) AS z FROM b GROUP BY 1)
SELECT 'level_regime_cross' AS kind, series_id AS key, 'full' AS "window", {R('least(abs(z) / 3, 1.0) + CASE WHEN coalesce(regime <> before, false) THEN 0.15 ELSE 0.0 END')} AS score, date, {R('value')} AS value, regime, before, {R('z')} AS z
FROM l WHERE regime = 'stressed' OR coalesce(regime <> before, false)""")
def level_regime_cross(spark: S, sf: str) -> D:
    hits = dt.level_regime_cross(fixture(spark, sf, MONTHLY, SCALED), [(0.95, "calm"), (1.05, "elevated")], "stressed", ["stressed"])
    return opened(hits, value="double", regime="string", before="string", z="double")


SPREADS = "spreads AS (SELECT pair_id AS series_id, date, a - b AS value FROM pairs)"


@query("spread_extreme", f"""WITH {MONTHLY}, {PAIRS}, {SPREADS}, l AS (SELECT series_id, max(date) AS date, arg_max(value, date) AS v, count(*) AS n FROM spreads GROUP BY 1 HAVING count(*) >= 30),
p AS (SELECT d.series_id, any_value(l.date) AS date, any_value(l.v) AS v, count(*) AS n, avg(CASE WHEN d.value <= l.v THEN 1.0 ELSE 0.0 END) AS p FROM spreads d JOIN l ON d.series_id = l.series_id GROUP BY 1),
e AS (SELECT * FROM (SELECT series_id, date, value - lag(value) OVER (PARTITION BY series_id ORDER BY date) AS c FROM spreads) WHERE c IS NOT NULL), m AS (SELECT series_id, quantile_cont(c, 0.5) AS med FROM e GROUP BY 1),
z AS (SELECT e.series_id, max(e.date) AS date, arg_max(e.c, e.date) AS v, count(*) AS n, (arg_max(e.c, e.date) - any_value(m.med)) / (1.4826 * quantile_cont(abs(e.c - m.med), 0.5)) AS z FROM e JOIN m ON e.series_id = m.series_id GROUP BY 1),
{break_ctes("spreads")}, {stats_ctes("spreads")}, h AS ({_break_hits("spread_break", "spreads", 0.3)})
SELECT 'spread_extreme_level' AS kind, series_id AS key, 'full' AS "window", {R('2 * abs(p - 0.5) + 1')} AS score, date, {R('v')} AS value, {R('p')} AS percentile, NULL AS z, CAST(n AS BIGINT) AS n, NULL AS k, NULL AS break_dates, NULL AS before, NULL AS mean, NULL AS move, NULL AS age_years FROM p WHERE p <= 0.2 OR p >= 0.8
UNION ALL SELECT 'spread_extreme_change', series_id, 'full', {R('abs(z) + 1')}, date, {R('v')}, NULL, {R('z')}, CAST(n AS BIGINT), NULL, NULL, NULL, NULL, NULL, NULL FROM z WHERE abs(z) >= 1.0 AND n >= 29
UNION ALL SELECT kind, key, "window", score, date, NULL, NULL, NULL, NULL, k, break_dates, before, mean, move, age_years FROM h""")
def spread_extreme(spark: S, sf: str) -> D:
    h = dt.spread_extreme(fixture(spark, sf, MONTHLY, PAIRS), 30, 0.2, 1.0)
    return opened(h, value="double", percentile="double", z="double", n="bigint", **BREAK_EVIDENCE)


@query("decomposition_shift", f"""WITH {PARTS}, w AS (SELECT *, sum(value) OVER (PARTITION BY date) AS total FROM parts),
d AS (SELECT series_id, date, value - lag(value) OVER s AS v, total - lag(total) OVER s AS t FROM w WINDOW s AS (PARTITION BY series_id ORDER BY date)), e AS (SELECT *, row_number() OVER (PARTITION BY series_id ORDER BY date DESC) AS back FROM d WHERE v IS NOT NULL AND t IS NOT NULL),
f AS (SELECT *, CASE WHEN back <= 90 THEN 'recent' ELSE 'history' END AS slice FROM e), c AS (SELECT series_id AS sid, slice AS sl, quantile_cont(abs(t), 0.33) AS cut FROM f GROUP BY 1, 2),
g AS (SELECT series_id, slice, avg(least(greatest(v / nullif(t, 0), -2.0), 2.0)) AS share, max(date) AS date FROM f JOIN c ON sid = series_id AND sl = slice WHERE abs(t) > cut GROUP BY 1, 2 HAVING count(*) >= 5),
p AS (SELECT series_id, max(CASE WHEN slice = 'recent' THEN share END) AS recent, max(CASE WHEN slice = 'history' THEN share END) AS history, max(date) AS date FROM g GROUP BY 1)
SELECT 'decomposition_shift' AS kind, series_id AS key, 'recent' AS "window", {R('abs(recent - history) / 0.02 * 3')} AS score, date, {R('recent')} AS recent, {R('history')} AS history FROM p WHERE abs(recent - history) >= 0.02""")
def decomposition_shift(spark: S, sf: str) -> D:
    return opened(dt.decomposition_shift(_parts(spark, sf), 0.02), recent="double", history="double")


def _parts(spark: S, sf: str) -> D:
    p = written(fixture(spark, sf, PARTS), "parts")
    return p.join(p.groupBy("date").agg(F.sum("value").alias("total")), "date")


@query("scan")
def scan(spark: S, sf: str) -> D:
    """All detectors, with the windows of monthly pairs; thresholds as they are."""
    levels = (fixture(spark, sf, MONTHLY, SCALED), [(0.95, "calm"), (1.05, "elevated")], "stressed", ["stressed"])
    cp = cv.cp_factor(cv.forward_rates(written(fixture(spark, sf, CURVE), "curve")), list(range(1, 8))).select(F.lit("cp").alias("series_id"), "date", F.col("cp").alias("value"))
    priced = pr.factor_pricing(written(_priced(spark, sf), "panel"), ["f"], _early_late(), [("early", "late")])
    return dt.scan(fixture(spark, sf, MONTHLY), fixture(spark, sf, MONTHLY, PAIRS), _factors(spark, sf), _parts(spark, sf), _episodes(spark, sf), levels, cp, priced)


@query("scan_skipped", f"WITH {DAILY} SELECT series_id AS key, concat('only ', CAST(count(*) AS VARCHAR), ' rows') AS reason FROM daily GROUP BY 1 HAVING count(*) < 2500")
def scan_skipped(spark: S, sf: str) -> D:
    return dt.skipped(fixture(spark, sf, DAILY), 2500)


HITS = "hits AS (SELECT event_type AS kind, concat('u', CAST(user_id AS VARCHAR(10))) AS key, CAST(ts AS DATE) AS date, value AS score FROM events)"


@query("findings", f"""WITH {HITS}, b AS (SELECT regexp_replace(lower(concat(kind, '-', key, '-', CAST(date AS VARCHAR))), '[^a-z0-9]+', '-', 'g') AS slug, kind, key, date AS discovered, max(score) AS score FROM hits GROUP BY 1, 2, 3, 4)
SELECT slug, concat(upper(kind[1]), kind[2:], ': ', key) AS title, kind, key, discovered, concat(kind, ' on ', key, ' over window full, score ', printf('%.2f', score), '.') AS claim, {R('score')} AS score FROM b
WHERE slug NOT IN (SELECT slug FROM b WHERE key = 'u2')""")
def findings(spark: S, sf: str) -> D:
    found = fixture(spark, sf, HITS).withColumn("window", F.lit("full"))
    return dt.findings(found, dt.findings(found.filter("key = 'u2'")))


@query("follow_ups", f"""WITH {HITS}, t AS (SELECT * FROM (VALUES ('onset', NULL, NULL, 1), ('jumps', 'click', NULL, 2), ('bonds', 'purchase', 'u3', 3)) AS t(question, kind, key, priority))
SELECT question, CAST(min(priority) AS BIGINT) AS priority, CAST(count(*) AS BIGINT) AS raised_by FROM hits h JOIN t ON (t.kind IS NULL OR t.kind = h.kind) AND (t.key IS NULL OR t.key = h.key) GROUP BY 1""")
def follow_ups(spark: S, sf: str) -> D:
    t = spark.createDataFrame([("onset", None, None, 1), ("jumps", "click", None, 2), ("bonds", "purchase", "u3", 3)], "question string, kind string, key string, priority int")
    return dt.follow_ups(fixture(spark, sf, HITS), t)


FIND = "found AS (SELECT concat('s', CAST(event_id AS VARCHAR(20))) AS slug, event_type AS kind, concat('u', CAST(user_id AS VARCHAR(10))) AS key, CAST(ts AS DATE) AS discovered, value AS score, CAST(ts AS DATE) AS date, CASE WHEN event_id % 3 = 0 THEN 'used' ELSE 'new' END AS status FROM events)"


def _as_of(spark: S) -> object:
    return F.lit(spark.sql("SELECT max(CAST(ts AS DATE)) AS d FROM events").first()["d"])


@query("rank_findings", f"""WITH {FIND}, a AS (SELECT max(date) AS d FROM found), h AS (SELECT kind, count(*) AS n FROM found, a WHERE CAST(substr(slug, 2) AS BIGINT) % 10 = 0 AND date >= a.d - 7 GROUP BY 1),
r AS (SELECT f.slug, f.kind, f.discovered, CASE WHEN coalesce(h.n, 0) >= 70 THEN 1 ELSE 0 END AS tired, CASE f.kind WHEN 'click' THEN 0 WHEN 'view' THEN 1 ELSE 99 END AS priority FROM found f LEFT JOIN h ON h.kind = f.kind)
SELECT slug, kind, discovered, CAST(tired AS BIGINT) AS tired, CAST(priority AS BIGINT) AS priority, row_number() OVER (ORDER BY tired, priority, discovered DESC, slug) AS place FROM r""")
def rank_findings(spark: S, sf: str) -> D:
    f = fixture(spark, sf, FIND)
    h = f.filter("CAST(substr(slug, 2) AS BIGINT) % 10 = 0")
    return sl.rank_findings(f, h, _as_of(spark), ["click", "view"], often=70).select("slug", "kind", "discovered", "tired", "priority", "place")


@query("eligible", f"""WITH {FIND}, a AS (SELECT max(date) AS d FROM found), h AS (SELECT * FROM found, a WHERE CAST(substr(slug, 2) AS BIGINT) % 50 = 0 AND date >= a.d - 14),
t AS (SELECT slug, kind, key, slug IN (SELECT slug FROM h) AS s, key IN (SELECT key FROM h WHERE key <> 'u7') AS k, kind = 'click' AND a.d - discovered > 14 AS stale, status FROM found, a),
r AS (SELECT slug, kind, key, status, CASE WHEN NOT s AND NOT k AND NOT stale THEN CASE WHEN status = 'new' THEN 0 ELSE 1 END WHEN NOT s THEN 2 ELSE 3 END AS tier FROM t)
SELECT slug, kind, key, status, CAST(tier AS BIGINT) AS tier FROM r WHERE tier = (SELECT min(tier) FROM r)""")
def eligible(spark: S, sf: str) -> D:
    f = fixture(spark, sf, FIND)
    h = f.filter("CAST(substr(slug, 2) AS BIGINT) % 50 = 0")
    more = spark.createDataFrame([("u7",)], "key string")
    return sl.eligible(f, h, _as_of(spark), data_points=["click"], more=more).select("slug", "kind", "key", "status", "tier")


#: Findings on two series each: the user and one of fifty others.
FIND_SETS = "sets AS (SELECT slug, kind, discovered, date, status, score, [key, concat('o', CAST(CAST(substr(slug, 2) AS BIGINT) % 50 AS VARCHAR(10)))] AS series_ids FROM found)"


def _found_sets(spark: S, sf: str) -> D:
    other = F.concat(F.lit("o"), (F.substring("slug", F.lit(2), F.lit(20)).cast("bigint") % 50).cast("string"))
    return fixture(spark, sf, FIND).withColumn("series_ids", F.array("key", other)).drop("key")


@query("eligible_sets", f"""WITH {FIND}, {FIND_SETS}, a AS (SELECT max(date) AS d FROM found), h AS (SELECT sets.* FROM sets, a WHERE CAST(substr(slug, 2) AS BIGINT) % 997 = 0 AND date >= a.d - 14),
m AS (SELECT unnest(series_ids) AS s FROM sets, a WHERE CAST(substr(slug, 2) AS BIGINT) % 1994 = 0 AND date >= a.d - 7), k AS (SELECT list(s) AS shown FROM (SELECT DISTINCT unnest(series_ids) AS s FROM h) WHERE s NOT IN (SELECT s FROM m)),
t AS (SELECT sets.*, slug IN (SELECT slug FROM h) AS s, list_has_any(series_ids, coalesce(shown, [])) AS k, kind = 'click' AND a.d - discovered > 14 AS stale FROM sets, a, k),
r AS (SELECT slug, kind, series_ids, status, CASE WHEN NOT s AND NOT k AND NOT stale THEN CASE WHEN status = 'new' THEN 0 ELSE 1 END WHEN NOT s THEN 2 ELSE 3 END AS tier FROM t)
SELECT slug, kind, array_to_string(series_ids, ',') AS series, status, CAST(tier AS BIGINT) AS tier FROM r WHERE tier = (SELECT min(tier) FROM r)""")
def eligible_sets(spark: S, sf: str) -> D:
    f = _found_sets(spark, sf)
    at = lambda n: f.filter(f"CAST(substr(slug, 2) AS BIGINT) % {n} = 0")
    out = sl.eligible(f, at(997), _as_of(spark), data_points=["click"], more=at(1994).select("date", "series_ids"))
    return out.select("slug", "kind", F.array_join("series_ids", ",").alias("series"), "status", "tier")


@query("market_snapshot", f"""WITH {DAILY}, {MONTHLY}, mixed AS (SELECT * FROM daily UNION ALL SELECT concat('M.', series_id), date, value FROM monthly), b AS (SELECT *, date - lag(date) OVER (PARTITION BY series_id ORDER BY date) AS gap, row_number() OVER (PARTITION BY series_id ORDER BY date DESC) AS back, value - lag(value) OVER (PARTITION BY series_id ORDER BY date) AS diff FROM mixed),
g AS (SELECT series_id, max(date) AS date, max(CASE WHEN back = 1 THEN value END) AS v, count(*) AS n, quantile_cont(gap, 0.5) <= 7 AND count(*) >= 22 AS ok, stddev_samp(CASE WHEN back <= 252 THEN diff END) AS sd, max(CASE WHEN back = 2 THEN value END) AS t1, max(CASE WHEN back = 6 THEN value END) AS t5, max(CASE WHEN back = 22 THEN value END) AS t21 FROM b GROUP BY 1)
SELECT g.series_id, g.date, {R('any_value(v)')} AS value, CAST(any_value(n) AS BIGINT) AS n, {R('any_value(CASE WHEN ok THEN v - t1 END)')} AS change_1, {R('any_value(CASE WHEN ok THEN v - t1 END / sd)')} AS sigma_1, {R('any_value(CASE WHEN ok THEN v - t5 END)')} AS change_5, {R('any_value(CASE WHEN ok THEN v - t5 END / (sd * sqrt(5)))')} AS sigma_5,
 {R('any_value(CASE WHEN ok THEN v - t21 END)')} AS change_21, {R('any_value(CASE WHEN ok THEN v - t21 END / (sd * sqrt(21)))')} AS sigma_21, {R('avg(CASE WHEN back <= 252 THEN CASE WHEN value <= v THEN 1.0 ELSE 0.0 END END)')} AS pct_252, {R('avg(CASE WHEN back <= 1260 THEN CASE WHEN value <= v THEN 1.0 ELSE 0.0 END END)')} AS pct_1260
FROM g JOIN b ON b.series_id = g.series_id GROUP BY 1, 2""")
def market_snapshot(spark: S, sf: str) -> D:
    monthly = fixture(spark, sf, MONTHLY).withColumn("series_id", F.concat(F.lit("M."), "series_id"))
    return sl.market_snapshot(fixture(spark, sf, DAILY).unionByName(monthly))


@query("series_snapshot", f"""WITH {MONTHLY}, b AS (SELECT *, row_number() OVER (PARTITION BY series_id ORDER BY date DESC) AS back, first_value(value) OVER (PARTITION BY series_id ORDER BY date DESC) AS v FROM monthly)
SELECT series_id, max(date) AS date, min(date) AS start, CAST(count(*) AS BIGINT) AS n, {R('any_value(v)')} AS value, {R('(any_value(v) - avg(value)) / stddev_samp(value)')} AS z_full, {R('avg(CASE WHEN value <= v THEN 1.0 ELSE 0.0 END)')} AS pct_full,
 {R('(any_value(v) - avg(value) FILTER (back <= 120)) / stddev_samp(value) FILTER (back <= 120)')} AS z_10y, {R('avg(CASE WHEN value <= v THEN 1.0 ELSE 0.0 END) FILTER (back <= 120)')} AS pct_10y,
 {R('(any_value(v) - avg(value) FILTER (back <= 60)) / stddev_samp(value) FILTER (back <= 60)')} AS z_5y, {R('avg(CASE WHEN value <= v THEN 1.0 ELSE 0.0 END) FILTER (back <= 60)')} AS pct_5y FROM b GROUP BY 1""")
def series_snapshot(spark: S, sf: str) -> D:
    return sl.series_snapshot(fixture(spark, sf, MONTHLY))


@query("sanity_flags", f"""WITH {MONTHLY}, m AS (SELECT *, abs(value - lag(value) OVER (PARTITION BY series_id ORDER BY date)) AS move FROM monthly)
SELECT series_id, date, {R('value')} AS value, NOT value BETWEEN -1 AND 25 AS out_of_range, coalesce(move > 0.5, false) AS move_over_0, coalesce(move > 1.0, false) AS move_over_1 FROM m""")
def sanity_flags(spark: S, sf: str) -> D:
    return sl.sanity_flags(fixture(spark, sf, MONTHLY))


@query("keyword_to_series", """WITH w AS (SELECT doc_id AS id, unnest(string_split_regex(lower(text), '[^a-z0-9]+')) AS word, generate_subscripts(string_split_regex(lower(text), '[^a-z0-9]+'), 1) AS pos FROM documents),
k AS (SELECT * FROM (VALUES ('the', 'T'), ('of', 'O'), ('und', 'U'), ('les', 'L'), ('que', 'Q')) AS k(word, series_id)), h AS (SELECT id, series_id, min(pos) AS pos FROM w JOIN k ON w.word = k.word GROUP BY 1, 2)
SELECT id, CAST(place AS BIGINT) AS place, series_id FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY pos, series_id) AS place FROM h) WHERE place <= 3""")
def keyword_to_series(spark: S, sf: str) -> D:
    tables(spark, sf, "documents")
    k = spark.createDataFrame([("the", "T"), ("of", "O"), ("und", "U"), ("les", "L"), ("que", "Q")], "word string, series_id string")
    return sl.keyword_to_series(spark.sql("SELECT doc_id AS id, text FROM documents"), k)


@query("text_chunks", """SELECT doc_id AS id, CAST(generate_subscripts(string_split(text, chr(10)), 1) - 1 AS BIGINT) AS n, unnest(string_split(text, chr(10))) AS text FROM documents""")
def text_chunks(spark: S, sf: str) -> D:
    tables(spark, sf, "documents")
    d = spark.sql("SELECT CAST(doc_id AS STRING) AS source, doc_id, regexp_replace(text, '\\n', '\\n## ') AS text FROM documents")
    c = tx.chunk(d.select("source", "text"))
    return c.select(F.col("source").cast("bigint").alias("id"), F.col("n"), F.when(F.col("n") > 0, F.expr("substring(text, 4)")).otherwise(F.col("text")).alias("text"))


QUERY_WORDS = ["theory", "erin", "ening", "moron", "und"]
@query("bm25_search", f"""WITH t AS (SELECT doc_id AS id, list_filter(string_split_regex(lower(text), '[^\\p{{L}}\\p{{N}}]+'), lambda w: length(w) > 1) AS t FROM documents), d AS (SELECT id, t, len(t) AS len FROM t),
s AS (SELECT count(*) AS N, avg(len) AS a FROM d), x AS (SELECT id, len, unnest(t) AS term FROM d), f0 AS (SELECT id, len, term, count(*) AS tf FROM x GROUP BY 1, 2, 3),
i AS (SELECT term, ln(N - count(*) + 0.5) - ln(count(*) + 0.5) AS idf FROM f0, s GROUP BY term, N), j AS (SELECT term, CASE WHEN idf < 0 THEN 0.25 * avg(idf) OVER () ELSE idf END AS idf FROM i), f AS (SELECT * FROM f0 WHERE term IN ({', '.join(f"'{w}'" for w in QUERY_WORDS)}))
SELECT f.id, {R('sum(idf * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * len / s.a)))')} AS score FROM f JOIN j ON f.term = j.term, s GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 25""")
def bm25_search(spark: S, sf: str) -> D:
    tables(spark, sf, "documents")
    return tx.bm25(spark.sql("SELECT doc_id AS id, text FROM documents"), QUERY_WORDS, 25, digits=6)


@query("bm25_boosted", f"""WITH t AS (SELECT doc_id AS id, text, lang, list_filter(string_split_regex(lower(text), '[^\\p{{L}}\\p{{N}}]+'), lambda w: length(w) > 1) AS t FROM documents), d AS (SELECT id, text, lang, t, len(t) AS len FROM t),
s AS (SELECT count(*) AS N, avg(len) AS a FROM d), x AS (SELECT id, len, unnest(t) AS term FROM d), f0 AS (SELECT id, len, term, count(*) AS tf FROM x GROUP BY 1, 2, 3),
i AS (SELECT term, ln(N - count(*) + 0.5) - ln(count(*) + 0.5) AS idf FROM f0, s GROUP BY term, N), j AS (SELECT term, CASE WHEN idf < 0 THEN 0.25 * avg(idf) OVER () ELSE idf END AS idf FROM i), f AS (SELECT * FROM f0 WHERE term IN ({', '.join(f"'{w}'" for w in QUERY_WORDS)})),
r AS (SELECT f.id, sum(idf * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * len / s.a))) AS score FROM f JOIN j ON f.term = j.term, s GROUP BY 1),
b AS (SELECT d.id, text, coalesce(score, 0.0) * CASE WHEN lang = 'en' THEN 1.5 ELSE 1.0 END + CASE WHEN contains(upper(text), 'MORONTH') THEN 5.0 ELSE 0.0 END AS score FROM d LEFT JOIN r ON r.id = d.id ORDER BY score DESC, d.id LIMIT 25)
SELECT id, CASE WHEN length(text) <= 300 THEN text ELSE concat(rtrim(text[1:300]), chr(10), '… [truncated]') END AS text, {R('score')} AS score FROM b""")
def bm25_boosted(spark: S, sf: str) -> D:
    tables(spark, sf, "documents")
    return tx.bm25(spark.sql("SELECT doc_id AS id, text, lang AS source FROM documents"), QUERY_WORDS, 25, boosts={"en": 1.5}, ids=["moronth"], chars=300)



@query("bm25_many", f"""WITH t AS (SELECT doc_id AS id, list_filter(string_split_regex(lower(text), '[^\\p{{L}}\\p{{N}}]+'), lambda w: length(w) > 1) AS t FROM documents), d AS (SELECT id, t, len(t) AS len FROM t),
s AS (SELECT count(*) AS N, avg(len) AS a FROM d), x AS (SELECT id, len, unnest(t) AS term FROM d), f AS (SELECT id, len, term, count(*) AS tf FROM x GROUP BY 1, 2, 3),
i AS (SELECT term, ln(N - count(*) + 0.5) - ln(count(*) + 0.5) AS idf FROM f, s GROUP BY term, N), j AS (SELECT term, CASE WHEN idf < 0 THEN 0.25 * avg(idf) OVER () ELSE idf END AS idf FROM i),
q0 AS (SELECT item_id AS query_id, unnest(list_filter(string_split_regex(lower(text), '[^\\p{{L}}\\p{{N}}]+'), lambda w: length(w) > 1)) AS term FROM benchmark), q AS (SELECT query_id, term, count(*) AS times FROM q0 GROUP BY 1, 2),
r AS (SELECT query_id, id, sum(times * idf * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * len / s.a))) AS score FROM q JOIN j ON q.term = j.term JOIN f ON f.term = q.term, s GROUP BY 1, 2)
SELECT query_id, CAST(place AS BIGINT) AS place, id, {R('score')} AS score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, id) AS place FROM r) WHERE place <= 3""")
def bm25_many(spark: S, sf: str) -> D:
    """All benchmark passages as queries of one search over a stored index."""
    tables(spark, sf, "documents")
    index = rt.write(rt.build(spark.sql("SELECT doc_id AS id, text FROM documents")), f"{shared_folder(spark)}/index-{uuid.uuid4().hex}", 8)
    asked = spark.read.parquet(f"{sf}/benchmark.parquet").select(F.col("item_id").alias("query_id"), "text")
    return rt.top(rt.scores(index, asked), 3)


@query("article_filter", """WITH a AS (SELECT *, split_part(split_part(url, '://', 2), '/', 1) AS source FROM pages WHERE contains(lower(url), 'example') AND page_id % 5 <> 0)
SELECT page_id, url, source FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY url) AS n FROM a WHERE url NOT IN (SELECT url FROM pages WHERE page_id % 5 = 0 AND url IS NOT NULL)) WHERE n <= 5""")
def article_filter(spark: S, sf: str) -> D:
    tables(spark, sf, "pages")
    p = spark.sql("SELECT page_id, url, url AS title, '' AS summary, split_part(split_part(url, '://', 2), '/', 1) AS source FROM pages")
    return tx.article_filter(p.filter("page_id % 5 <> 0"), p.filter("page_id % 5 = 0"), ["Example"]).select("page_id", "url", "source")


@query("catalogue_search", """WITH m AS (SELECT p_name AS title, max(3 * CASE WHEN p_type = 'STANDARD' THEN 1 ELSE 0 END + 2 * CASE WHEN p_brand = 'Brand#1' THEN 1 ELSE 0 END + CASE WHEN contains(lower(p_name), '1') THEN 1 ELSE 0 END + p_size % 5 + 1) AS score
 FROM part WHERE p_type = 'STANDARD' OR p_brand = 'Brand#1' OR contains(lower(p_name), '1') GROUP BY 1) SELECT title, CAST(score AS BIGINT) AS score FROM m ORDER BY score DESC, title LIMIT 20""")
def catalogue_search(spark: S, sf: str) -> D:
    tables(spark, sf, "part")
    p = spark.sql("SELECT p_name AS title, p_brand AS `group`, p_size % 5 + 1 AS relevance, array(p_type) AS key_series FROM part")
    return tx.catalogue_search(p, ["STANDARD"], ["Brand#1"], ["1"], 20)


@query("html_to_text", r"""SELECT page_id, substr(regexp_replace(regexp_replace(regexp_replace(regexp_replace(html, '(?is)<(script|style|nav|footer|header)\b[^>]*>.*?</(script|style|nav|footer|header)>', '', 'g'), '(?s)<[^>]*>', chr(10), 'g'), '[ \t\r]*\n\s*', chr(10), 'g'), '^\n|\n$', '', 'g'), 1, 8000) AS text FROM pages""")
def html_to_text(spark: S, sf: str) -> D:
    tables(spark, sf, "pages")
    return spark.table("pages").select("page_id", tx.html_to_text(F.col("html"), 8000).alias("text"))


@query("html_to_text_whole", r"""SELECT page_id, regexp_replace(regexp_replace(regexp_replace(regexp_replace(html, '(?is)<(script|style|nav|footer|header)\b[^>]*>.*?</(script|style|nav|footer|header)>', '', 'g'), '(?s)<[^>]*>', chr(10), 'g'), '[ \t\r]*\n\s*', chr(10), 'g'), '^\n|\n$', '', 'g') AS text FROM pages""")
def html_to_text_whole(spark: S, sf: str) -> D:
    tables(spark, sf, "pages")
    return spark.table("pages").select("page_id", tx.html_to_text(F.col("html")).alias("text"))


@query("extract_links", """WITH l AS (SELECT page_id, regexp_extract_all(html, 'href="([^"]+)"', 1) AS h FROM pages) SELECT page_id, CAST(generate_subscripts(h, 1) - 1 AS BIGINT) AS n, unnest(h) AS href FROM l""")
def extract_links(spark: S, sf: str) -> D:
    tables(spark, sf, "pages")
    return tx.links(spark.table("pages"))


@query("table_cells", """WITH l AS (SELECT page_id, regexp_extract_all(html, '(?is)<li[^>]*>(.*?)</li>', 1) AS h FROM pages) SELECT page_id, CAST(generate_subscripts(h, 1) - 1 AS BIGINT) AS "row", CAST(0 AS BIGINT) AS cell, trim(regexp_replace(unnest(h), '<[^>]*>', '', 'g')) AS text FROM l""")
def table_cells(spark: S, sf: str) -> D:
    tables(spark, sf, "pages")
    p = spark.table("pages").withColumn("html", F.regexp_replace("html", "(?is)<li([^>]*)>(.*?)</li>", "<tr><td>$2</td></tr>"))
    return tx.table_cells(p)


@query("job_health", f"""WITH {RUNS}, g AS (SELECT script, max(finished_at) AS last_run, max(CASE WHEN success THEN finished_at END) AS last_success, count(*) AS runs FROM runs GROUP BY 1),
f AS (SELECT r.script, count(*) AS f FROM runs r JOIN g ON r.script = g.script WHERE NOT success AND (last_success IS NULL OR finished_at > last_success) GROUP BY 1),
s AS (SELECT g.*, coalesce(f, 0) AS f, (CAST(epoch((SELECT max(finished_at) + INTERVAL 40 HOUR FROM runs)) AS BIGINT) - CAST(floor(epoch(last_run)) AS BIGINT)) / 3600.0 AS hours FROM g LEFT JOIN f ON f.script = g.script)
SELECT script, CAST(floor(epoch(last_run)) AS BIGINT) AS last_run, CAST(floor(epoch(last_success)) AS BIGINT) AS last_success, CAST(runs AS BIGINT) AS runs, CAST(f AS BIGINT) AS trailing_failures,
 CASE WHEN f >= 3 THEN 'error' WHEN f >= 1 OR hours > CASE WHEN script = 'click' THEN 50 ELSE 30 END THEN 'warn' ELSE 'ok' END AS status FROM s""")
def job_health(spark: S, sf: str) -> D:
    r = fixture(spark, sf, RUNS)
    as_of = r.agg(F.max("finished_at") + F.expr("INTERVAL 40 HOURS")).first()[0]
    h = mo.job_health(r, F.lit(as_of), limits={"click": 50})
    return h.withColumns({c: F.unix_timestamp(c) for c in ("last_run", "last_success")})


@query("latest_runs", f"WITH {RUNS} SELECT script, success, event_id, CAST(n AS BIGINT) AS place FROM (SELECT *, row_number() OVER (PARTITION BY script ORDER BY finished_at DESC, event_id DESC) AS n FROM runs) WHERE n <= 3")
def latest_runs(spark: S, sf: str) -> D:
    return mo.latest_runs(fixture(spark, sf, RUNS)).select("script", "success", "event_id", "place")


@query("freshness", """WITH l AS (SELECT user_id, max(CAST(ts AS DATE)) AS d FROM events GROUP BY 1), a AS (SELECT max(d) AS d FROM l)
SELECT CAST(count(*) AS BIGINT) AS series, CAST(count(*) FILTER (a.d - l.d > 1) AS BIGINT) AS stale_1d, CAST(count(*) FILTER (a.d - l.d > 7) AS BIGINT) AS stale_7d, min(l.d) AS oldest, max(l.d) AS newest,
 CASE WHEN count(*) FILTER (a.d - l.d > 7) > 0.3 * count(*) THEN 'error' WHEN count(*) FILTER (a.d - l.d > 7) > 0.1 * count(*) THEN 'warn' ELSE 'ok' END AS status FROM l, a""")
def freshness(spark: S, sf: str) -> D:
    tables(spark, sf, "events")
    return mo.freshness(spark.sql("SELECT user_id AS series_id, CAST(ts AS DATE) AS date FROM events"), _as_of(spark))


@query("backlog", f"""WITH {FIND}, a AS (SELECT max(date) AS d FROM found) SELECT kind, CAST(count(*) AS BIGINT) AS n, CAST(count(*) FILTER (discovered > a.d - 7) AS BIGINT) AS recent, {R('max(score)')} AS top_score FROM found, a GROUP BY 1""")
def backlog(spark: S, sf: str) -> D:
    return mo.backlog(fixture(spark, sf, FIND), _as_of(spark))


@query("health_parts", f"""WITH {FIND}, a AS (SELECT max(date) AS d FROM found), n AS (SELECT 'findings' AS part, count(*) AS total, max(discovered) AS last, count(*) FILTER (discovered >= a.d - 7) AS recent, count(*) FILTER (status = 'new') AS new_unsent, count(*) FILTER (kind = 'click') AS sourced FROM found, a GROUP BY a.d),
l AS (SELECT 'lessons' AS part, count(*) AS total, max(date) AS last, count(*) FILTER (date >= a.d - 7) AS recent, 0 AS new_unsent, 0 AS sourced FROM found, a WHERE date < a.d - 6),
h AS (SELECT 'harvests' AS part, count(*) AS total, max(date) AS last, coalesce(sum(CAST(substr(slug, 2) AS BIGINT) % 5) FILTER (date >= a.d - 7), 0) AS recent, 0 AS new_unsent, 0 AS sourced FROM found, a WHERE kind = 'view')
SELECT part, CAST(total AS BIGINT) AS total, last, CAST(recent AS BIGINT) AS recent, CAST(new_unsent AS BIGINT) AS new_unsent, CAST(sourced AS BIGINT) AS sourced, CASE WHEN part = 'lessons' THEN 'warn' ELSE 'ok' END AS status, 'warn' AS worst FROM (SELECT * FROM n UNION ALL SELECT * FROM l UNION ALL SELECT * FROM h)""")
def health_parts(spark: S, sf: str) -> D:
    """Clicks have a source on the web; lessons ended a week ago; views are harvests of up to four findings."""
    f = fixture(spark, sf, FIND)
    now = _as_of(spark)
    sourced = f.withColumn("sources", F.when(F.col("kind") == "click", F.array(F.lit("https://x/"))).otherwise(F.array().cast("array<string>")))
    harvests = f.filter("kind = 'view'").withColumn("n_findings", F.expr("CAST(substr(slug, 2) AS BIGINT) % 5"))
    parts = {"findings": mo.findings_health(sourced, now), "lessons": mo.lessons_health(f.filter(F.col("date") < F.date_sub(now, 6)), now), "harvests": mo.harvest_health(harvests, now)}
    worst = mo.worst_status(parts).select(F.lit(1).alias("one"), F.col("status").alias("worst"))
    none = F.lit(0).cast("bigint")
    rows = [
        parts["findings"].join(f.agg(F.max("discovered").alias("last"))).select(F.lit("findings").alias("part"), "total", "last", F.col("added").alias("recent"), "new_unsent", "sourced", "status"),
        parts["lessons"].select(F.lit("lessons").alias("part"), "total", F.col("last_sent").alias("last"), F.col("sent").alias("recent"), none.alias("new_unsent"), none.alias("sourced"), "status"),
        parts["harvests"].select(F.lit("harvests").alias("part"), "total", F.col("last_run").alias("last"), F.col("added").alias("recent"), none.alias("new_unsent"), none.alias("sourced"), "status"),
    ]
    all_ = rows[0].unionByName(rows[1]).unionByName(rows[2]).withColumn("one", F.lit(1))
    return all_.join(F.broadcast(worst), "one").drop("one")  # one row


def _level_sql(x: str) -> str:
    return f"CASE WHEN {x} >= 100 THEN format('{{:,.0f}}', {x}) WHEN {x} >= 10 THEN printf('%.1f', {x}) WHEN {x} >= 1 THEN printf('%.2f', {x}) ELSE printf('%.3f', {x}) END"


@query("formatted_levels", f"""WITH {MONTHLY} SELECT series_id, date, {_level_sql('value')} AS level,
 printf('%.2f%%', value) AS percent, printf('%+.0f bp', value * 100) AS bp, printf('%+.1fσ', value) AS z, printf('%+.0f%%', value * 100) AS corr, printf('%+.2f pp', value) AS pp, printf('%.0fth pct', value * 100) AS pct,
 strftime(date, '%b %d, %Y') AS long, strftime(date, '%b %Y') AS ym, {_level_sql('value * 1000')} AS thousands, concat({_level_sql('1 + value / 1000')}, ' – ', {_level_sql('value * 1000')}) AS span FROM monthly""")
def formatted_levels(spark: S, sf: str) -> D:
    v, d = F.col("value"), F.col("date")
    return fixture(spark, sf, MONTHLY).select(
        sl.format_level(v * 1000).alias("thousands"), sl.format_range(1 + v / 1000, v * 1000).alias("span"),
        "series_id", "date", sl.format_level(v).alias("level"), sl.format_percent(v).alias("percent"), sl.format_bp(v).alias("bp"), sl.format_z(v).alias("z"), sl.format_corr(v).alias("corr"),
        sl.format_pp(v).alias("pp"), sl.format_percentile(v).alias("pct"), sl.format_date(d, "long").alias("long"), sl.format_date(d, "ym").alias("ym"),
    )


CAL = """cal AS (SELECT DISTINCT CAST(ascii(o_orderpriority) AS INT) AS release_id, concat('Release ', o_orderpriority) AS release_name, CAST(date_trunc('quarter', o_orderdate) AS DATE) AS release_date FROM orders)"""
TODAY = "2000-03-25"


@query("release_table", f"""WITH {CAL} SELECT DISTINCT release_date, label FROM cal JOIN (VALUES (49, 'Urgent orders'), (50, 'High orders')) AS l(release_id, label) ON l.release_id = cal.release_id WHERE release_date BETWEEN DATE '{TODAY}' AND DATE '{TODAY}' + 10""")
def release_table(spark: S, sf: str) -> D:
    labels = spark.createDataFrame([(49, "Urgent orders"), (50, "High orders")], "release_id int, label string")
    return sl.release_table(fixture(spark, sf, CAL), labels, F.lit(TODAY).cast("date"))


@query("upcoming", f"WITH {CAL} SELECT DISTINCT release_date, release_name FROM cal WHERE release_date >= DATE '{TODAY}' ORDER BY 1, 2 LIMIT 7")
def upcoming(spark: S, sf: str) -> D:
    return mo.upcoming(fixture(spark, sf, CAL), F.lit(TODAY).cast("date"), 7)


@query("release_match", f"""WITH {MONTHLY}, {CAL}, k AS (SELECT DISTINCT concat('ORD.', substr(release_name, 9)) AS key FROM cal WHERE release_date BETWEEN DATE '{TODAY}' AND DATE '{TODAY}' + 10 AND (contains(lower(release_name), 'urgent') OR contains(lower(release_name), 'low')))
SELECT DISTINCT series_id AS key, series_id IN (SELECT key FROM k) AS upcoming FROM monthly""")
def release_match(spark: S, sf: str) -> D:
    cal = fixture(spark, sf, CAL)
    members = cal.select("release_id", F.concat(F.lit("ORD."), F.expr("substring(release_name, 9)")).alias("series_id")).distinct()
    keys = fixture(spark, sf, MONTHLY).select(F.col("series_id").alias("key")).distinct()
    return sl.release_match(keys, cal, members, F.lit(TODAY).cast("date"), ["Urgent", "LOW"], 10)


#: Hits that name the monthly series.
NAMED = "named AS (SELECT kind, series_id AS key, h.date AS date, score FROM hits h JOIN (SELECT DISTINCT series_id FROM monthly) m ON ascii(substr(series_id, 5)) - 49 = CAST(substr(key, 2) AS INT) % 7)"


@query("seeds", f"""WITH {MONTHLY}, {HITS}, {NAMED}, b AS (SELECT kind, key, max(score) AS s FROM named GROUP BY 1, 2), o AS (SELECT *, row_number() OVER (PARTITION BY series_id ORDER BY date DESC) AS back, first_value(value) OVER (PARTITION BY series_id ORDER BY date DESC) AS latest FROM monthly),
k AS (SELECT series_id, any_value(latest) AS value, max(date) AS date, (any_value(latest) - avg(value)) / stddev_samp(value) AS z_full, avg(CASE WHEN back <= 120 THEN CASE WHEN value <= latest THEN 1.0 ELSE 0.0 END END) AS pct_10y FROM o GROUP BY 1)
SELECT regexp_replace(lower(concat(kind, '-', key, '-2024-05-01')), '[^a-z0-9]+', '-', 'g') AS id, kind AS detector, key, {R('value')} AS stat_value, k.date AS stat_date, {R('z_full')} AS stat_z, {R('pct_10y')} AS stat_pct, {R('s')} AS priority_score, DATE '2024-05-01' AS created, DATE '2024-05-08' AS expires, false AS used FROM b JOIN k ON series_id = key""")
def seeds(spark: S, sf: str) -> D:
    snap = sl.series_snapshot(fixture(spark, sf, MONTHLY))
    made = dt.seeds(fixture(spark, sf, MONTHLY, HITS, NAMED), snap, F.lit("2024-05-01").cast("date"))
    stat = F.col("key_stats")[F.col("key")]
    fields = [stat["value"].alias("stat_value"), stat["date"].alias("stat_date"), stat["z_full"].alias("stat_z"), stat["pct_10y"].alias("stat_pct")]
    return made.select("id", "detector", "key", *fields, "priority_score", "created", "expires", "used")


@query("release_match_sets", f"""WITH {MONTHLY}, {CAL}, {PAIRS}, soon AS (SELECT * FROM cal WHERE release_date BETWEEN DATE '{TODAY}' AND DATE '{TODAY}' + 10 AND (contains(lower(release_name), 'urgent') OR contains(lower(release_name), 'low'))),
k AS (SELECT concat('ORD.', substr(release_name, 9)) AS s FROM soon UNION SELECT 'ORD.3-MEDIUM' FROM soon WHERE contains(lower(release_name), 'low'))
SELECT pair_id AS slug, split_part(pair_id, '|', 1) IN (SELECT s FROM k) OR split_part(pair_id, '|', 2) IN (SELECT s FROM k) AS upcoming FROM (SELECT DISTINCT pair_id FROM pairs)""")
def release_match_sets(spark: S, sf: str) -> D:
    """Findings on pairs, and a word whose releases stand for a series of their own."""
    cal = fixture(spark, sf, CAL)
    members = cal.select("release_id", F.concat(F.lit("ORD."), F.expr("substring(release_name, 9)")).alias("series_id")).distinct()
    found = fixture(spark, sf, MONTHLY, PAIRS).select(F.col("pair_id").alias("slug"), F.split("pair_id", r"\|").alias("series_ids")).distinct()
    return sl.release_match(found, cal, members, F.lit(TODAY).cast("date"), ["Urgent", "LOW"], 10, {"Low": ["ORD.3-MEDIUM"]}).select("slug", "upcoming")


@query("pick_seed", f"""WITH {HITS}, b AS (SELECT kind, key, max(score) AS s FROM hits WHERE key <> 'u1' GROUP BY 1, 2)
SELECT regexp_replace(lower(concat(kind, '-', key, '-2024-05-01')), '[^a-z0-9]+', '-', 'g') AS id, {R('s')} AS priority_score FROM b ORDER BY s DESC, id LIMIT 1""")
def pick_seed(spark: S, sf: str) -> D:
    snap = sl.series_snapshot(fixture(spark, sf, MONTHLY))
    made = dt.seeds(fixture(spark, sf, HITS), snap, F.lit("2024-05-01").cast("date"))
    left = dt.mark_used(made, made.filter("key = 'u1'")).withColumn("upcoming", F.lit(False))
    return sl.pick_seed(left, F.lit("2024-05-02").cast("date")).select("id", "priority_score")


@query("factor_pricing_shocks", f"""WITH {MONTHLY}, s AS (SELECT series_id, date, value / nullif(lag(value) OVER w, 0) - 1 AS v FROM monthly WINDOW w AS (PARTITION BY series_id ORDER BY date))
SELECT series_id, date, CASE WHEN count(v) OVER w = 12 THEN {R('v - avg(v) OVER w')} END AS shock FROM s WINDOW w AS (PARTITION BY series_id ORDER BY date ROWS BETWEEN 11 PRECEDING AND CURRENT ROW)""")
def factor_pricing_shocks(spark: S, sf: str) -> D:
    r = st.rolling(al.returns(fixture(spark, sf, MONTHLY)), 12)
    return r.select("series_id", "date", (F.col("value") - F.col("roll_mean")).alias("shock"))
