"""Yield-curve and macro indicators."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .series import latest_stats, pca

#: Decay of the curve factors.
LAMBDA = 0.0609


def spread(obs: DataFrame, legs: DataFrame) -> DataFrame:
    """name, date, value = scale * (first - second) on common dates; legs: name, first, second, scale."""
    first = obs.select(F.col("series_id").alias("first"), "date", F.col("value").alias("x"))
    second = obs.select(F.col("series_id").alias("second"), "date", F.col("value").alias("y"))
    j = first.join(F.broadcast(legs), "first").join(second, ["second", "date"])  # legs: a registry
    return j.select("name", "date", (F.col("scale") * (F.col("x") - F.col("y"))).alias("value"))


def sahm_rule(obs: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """keys, date, value: mean of three rows less the least of the twelve rows before."""
    w = Window.partitionBy(*(keys or ["series_id"])).orderBy("date")
    now, past = w.rowsBetween(-2, 0), w.rowsBetween(-12, -1)
    ok = (F.count("value").over(now) == 3) & (F.count("value").over(past) == 12)
    return obs.withColumn("value", F.when(ok, F.avg("value").over(now) - F.min("value").over(past)))


def taylor_rule(inflation: Column, gap: Column, neutral: float = 0.5, target: float = 2.0) -> Column:
    return F.lit(neutral) + inflation + 0.5 * (inflation - F.lit(target)) + 0.5 * gap


def taylor_from_levels(
    policy: DataFrame, prices: DataFrame, output: DataFrame, potential: DataFrame, neutral: float = 0.5, target: float = 2.0, keys: list[str] | None = None
) -> DataFrame:
    """keys, date (month end), policy, inflation, gap, rate, excess of the rule from raw series (keys, date, value).

    inflation: the change of prices over twelve rows in percent; gap: output over potential in percent. Each month has the
    last value in it, or before it, of each series; excess is the policy rate less the rule. One row a month for each of
    keys (such as countries).
    """
    keys = keys or []
    yoy = Window.partitionBy(*keys).orderBy("date")
    prices = prices.withColumn("value", 100 * (F.col("value") / F.nullif(F.lag("value", 12).over(yoy), F.lit(0.0)) - 1))
    month = F.last_day("date")
    named = {"policy": policy, "inflation": prices, "output": output, "potential": potential}
    parts = [d.select(*keys, month.alias("date"), F.lit(n).alias("name"), "value", F.col("date").alias("at")) for n, d in named.items()]
    last = [F.max_by(F.when(F.col("name") == n, F.col("value")), F.when((F.col("name") == n) & F.col("value").isNotNull(), F.col("at"))).alias(n) for n in named]
    wide = reduce(DataFrame.unionByName, parts).groupBy(*keys, "date").agg(*last)
    span = wide.groupBy(*keys).agg(F.min("date").alias("lo"), F.max("date").alias("hi")) if keys else wide.agg(F.min("date").alias("lo"), F.max("date").alias("hi"))
    months = F.sequence(F.trunc("lo", "MM"), F.trunc("hi", "MM"), F.expr("INTERVAL 1 MONTH"))
    grid = span.select(*keys, F.explode(months).alias("m")).select(*keys, F.last_day("m").alias("date"))
    run = Window.partitionBy(*keys).orderBy("date").rowsBetween(Window.unboundedPreceding, 0)
    full = grid.join(wide.hint("merge"), [*keys, "date"], "left").withColumns({n: F.last(n, ignorenulls=True).over(run) for n in named})
    full = full.withColumn("gap", 100 * (F.col("output") / F.nullif("potential", F.lit(0.0)) - 1))
    full = full.withColumn("rate", taylor_rule(F.col("inflation"), F.col("gap"), neutral, target))
    return full.select(*keys, "date", "policy", "inflation", "gap", "rate", (F.col("policy") - F.col("rate")).alias("excess"))


def forward_rates(curve: DataFrame) -> DataFrame:
    """tenor, date, forward between the tenor before and this one; the first is the yield itself."""
    w = Window.partitionBy("date").orderBy("tenor")
    m, ym = F.lag("tenor").over(w), F.lag("value").over(w)
    f = (F.col("tenor") * F.col("value") - m * ym) / (F.col("tenor") - m)
    return curve.select("tenor", "date", F.coalesce(f, F.col("value")).alias("forward"))


def excess_returns(curve: DataFrame, risk_free: int, horizon: int = 12) -> DataFrame:
    """tenor, date, rx: return in percent of holding a tenor for ``horizon`` months over the short tenor."""
    w = Window.partitionBy("tenor").orderBy("date")
    rf = curve.filter(F.col("tenor") == risk_free).select("date", F.col("value").alias("rf"))
    d = curve.withColumn("ahead", F.lead("value", horizon).over(w)).join(rf, "date")
    y, part = F.col("value"), horizon / 12
    rx = 100 * (-F.col("tenor") * (F.col("ahead") - y) / 100 + y / 100 * part - F.col("rf") / 100 * part)
    return d.select("tenor", "date", rx.alias("rx"))


def cp_factor(forwards: DataFrame, tenors: list[int]) -> DataFrame:
    """date, cp: first principal component of standardised forwards; the longest tenor loads at least 0."""
    wide = forwards.groupBy("date").pivot("tenor", tenors).agg(F.first("forward"))
    wide = wide.select("date", *[F.col(str(t)).alias(f"f{t}") for t in tenors])
    _, scores = pca(wide, [f"f{t}" for t in tenors], 1, sign_by=f"f{max(tenors)}")
    return scores.select("date", F.col("pc1").alias("cp"))


def nelson_siegel(curve: DataFrame, decay: float = LAMBDA, keys: list[str] | None = None, least: int = 3) -> DataFrame:
    """keys, date, level, slope, curvature, rmse_bp of each date's curve by least squares.

    Nine sums of loading products for each date and Cramer's rule: any tenors may be missing, no Python.
    """
    by = [*(keys or []), "date"]
    x = F.col("tenor") * F.lit(decay)
    d = curve.filter("value IS NOT NULL").withColumn("s", (1 - F.exp(-x)) / x)
    d = d.withColumn("c", F.col("s") - F.exp(-x))
    names = {"n": F.lit(1.0), "s": F.col("s"), "c": F.col("c"), "ss": F.col("s") * F.col("s"), "sc": F.col("s") * F.col("c"), "cc": F.col("c") * F.col("c"),
             "y": F.col("value"), "sy": F.col("s") * F.col("value"), "cy": F.col("c") * F.col("value"), "yy": F.col("value") * F.col("value")}
    m = d.groupBy(*by).agg(*[F.sum(v).alias(f"m_{k}") for k, v in names.items()])
    v = lambda k: F.col(f"m_{k}")
    det3 = lambda a: (
        a[0][0] * (a[1][1] * a[2][2] - a[1][2] * a[2][1]) - a[0][1] * (a[1][0] * a[2][2] - a[1][2] * a[2][0]) + a[0][2] * (a[1][0] * a[2][1] - a[1][1] * a[2][0])
    )
    a = [[v("n"), v("s"), v("c")], [v("s"), v("ss"), v("sc")], [v("c"), v("sc"), v("cc")]]
    rhs = [v("y"), v("sy"), v("cy")]
    m = m.withColumn("det", det3(a))
    for i, name in enumerate(["level", "slope", "curvature"]):
        swapped = [[rhs[r] if c == i else a[r][c] for c in range(3)] for r in range(3)]
        m = m.withColumn(name, det3(swapped) / F.nullif(F.col("det"), F.lit(0.0)))
    fit = m.filter(v("n") >= least).select(*by, "level", "slope", "curvature")
    e = d.join(fit, by).withColumn("e", F.col("value") - F.col("level") - F.col("slope") * F.col("s") - F.col("curvature") * F.col("c"))
    rmse = e.groupBy(*by).agg((100 * F.sqrt(F.avg(F.col("e") * F.col("e")))).alias("rmse_bp"))
    return fit.join(rmse, by)


def dot_distribution(dots: DataFrame) -> DataFrame:
    """meeting_date, forecast_year, median, iqr_bp, n, shift_bp (change of the median since the meeting before)."""
    weight = F.col("participant_count")
    q = lambda p: F.percentile("rate", F.lit(p), weight)
    g = dots.groupBy("meeting_date", "forecast_year").agg(q(0.5).alias("median"), (100 * (q(0.75) - q(0.25))).alias("iqr_bp"), F.sum(weight).alias("n"))
    before = F.lag("median").over(Window.partitionBy("forecast_year").orderBy("meeting_date"))
    return g.withColumn("shift_bp", 100 * (F.col("median") - before))


def regime_of(value: Column, cuts: list[tuple[float, str]], otherwise: str) -> Column:
    """The label of the first cut that the value is below."""
    out = F.lit(otherwise)
    for cut, label in reversed(cuts):
        out = F.when(value < cut, label).otherwise(out)
    return F.when(value.isNotNull(), out)


def spread_snapshot(spreads: DataFrame, cuts: list[tuple[float, str]], otherwise: str, lookback: int | None = None) -> DataFrame:
    """name, date, value, regime, z, percentile of the latest value of each spread."""
    s = latest_stats(spreads, lookback, keys=["name"])
    return s.withColumn("regime", regime_of(F.col("value"), cuts, otherwise))


def decompose(nominal: DataFrame, real: DataFrame, survey: DataFrame) -> DataFrame:
    """date, nominal, real, breakeven, premium: nominal = real + breakeven; breakeven = survey + premium."""
    n, r, s = (d.select("date", F.col("value").alias(c)) for d, c in ((nominal, "nominal"), (real, "real"), (survey, "survey")))
    j = n.join(r, "date").join(s, "date", "left").withColumn("breakeven", F.col("nominal") - F.col("real"))
    return j.select("date", "nominal", "real", "breakeven", (F.col("breakeven") - F.col("survey")).alias("premium"))
