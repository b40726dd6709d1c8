"""Statistics of series: rolling and expanding, correlation, breaks, jumps, regimes, principal components."""

from __future__ import annotations

from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.window import WindowSpec


def _rows(keys: list[str], n: int) -> WindowSpec:
    return Window.partitionBy(*keys).orderBy("date").rowsBetween(-(n - 1), 0)


def _corr(a: str, b: str, over: WindowSpec | None = None) -> Column:
    """Pearson correlation; NULL where either side does not vary (the built-in one fails there)."""
    f = (lambda c: c.over(over)) if over is not None else (lambda c: c)
    return f(F.covar_pop(a, b)) / F.nullif(f(F.stddev_pop(a)) * f(F.stddev_pop(b)), F.lit(0.0))


def _mean_rank(x: str, keys: list[str]) -> Column:
    ties = F.count("*").over(Window.partitionBy(*keys, x)) - 1
    return F.rank().over(Window.partitionBy(*keys).orderBy(x)) + ties / 2


def rolling(obs: DataFrame, window: int, min_periods: int | None = None, keys: list[str] | None = None) -> DataFrame:
    """obs with roll_mean, roll_min, roll_max, roll_std over the last so many rows."""
    w = _rows(keys or ["series_id"], window)
    enough = F.count("value").over(w) >= (min_periods or window)
    fs = {"mean": F.avg, "min": F.min, "max": F.max, "std": F.stddev_samp}
    return obs.withColumns({f"roll_{n}": F.when(enough, f("value").over(w)) for n, f in fs.items()})


def rolling_vol(obs: DataFrame, window: int, periods: int, keys: list[str] | None = None) -> DataFrame:
    """Annualised standard deviation of returns over the last so many rows."""
    w = _rows(keys or ["series_id"], window)
    sd = F.when(F.count("value").over(w) >= window, F.stddev_samp("value").over(w))
    return obs.withColumn("vol", sd * float(np.sqrt(periods)))


def _memberships(df: DataFrame, keys: list[str], window: int) -> DataFrame:
    """Each row once for each window of ``window`` rows that it is in: column end, the row number of its last."""
    every = Window.partitionBy(*keys)
    numbered = df.withColumns({"rn": F.row_number().over(every.orderBy("date")), "__rows": F.count("*").over(every)})
    ends = F.sequence(F.col("rn").cast("bigint"), F.least(F.col("rn") + window - 1, F.col("__rows")))
    return numbered.withColumn("end", F.explode(ends)).drop("__rows")


def rolling_corr(pairs: DataFrame, window: int, method: str = "pearson", min_periods: int | None = None, keys: list[str] | None = None) -> DataFrame:
    """keys, date, correlation of a and b over the last so many rows; Spearman ranks inside each window."""
    keys, least = keys or ["pair_id"], min_periods or window
    full = pairs.dropna(subset=["a", "b"])
    if method == "pearson":
        w = _rows(keys, window)
        c = F.when(F.count("a").over(w) >= least, _corr("a", "b", w))
        return full.select(*keys, "date", c.alias("correlation"))
    m = _memberships(full, keys, window)
    inside = [*keys, "end"]
    m = m.withColumns({"ra": _mean_rank("a", inside), "rb": _mean_rank("b", inside)})
    out = m.groupBy(*inside).agg(F.max("date").alias("date"), F.count("*").alias("n"), _corr("ra", "rb").alias("c"))
    return out.select(*keys, "date", F.when(F.col("n") >= least, F.col("c")).alias("correlation"))


def corr_stability(pairs: DataFrame, method: str = "spearman", n_subperiods: int = 4, keys: list[str] | None = None) -> DataFrame:
    """Correlation of all rows and of equal parts of them, and the spread of the latter.

    Keys with fewer than two rows a part are left out.
    """
    keys = keys or ["pair_id"]
    every = Window.partitionBy(*keys)
    d = pairs.dropna(subset=["a", "b"]).withColumns(
        {"rn": F.row_number().over(every.orderBy("date")) - 1, "n": F.count("*").over(every)}
    )
    d = d.filter(F.col("n") >= 2 * n_subperiods)
    part = sum((F.col("rn") >= F.floor(F.col("n") * i / n_subperiods)).cast("int") for i in range(1, n_subperiods))
    d = d.withColumn("part", part)

    def corr(by: list[str], name: str) -> DataFrame:
        r = d
        if method == "spearman":
            r = r.withColumns({"x": _mean_rank("a", by), "y": _mean_rank("b", by)})
        else:
            r = r.withColumns({"x": F.col("a"), "y": F.col("b")})
        return r.groupBy(*by).agg(_corr("x", "y").alias(name))

    parts = corr([*keys, "part"], "c").groupBy(*keys).agg(
        F.max("c").alias("max_corr"), F.min("c").alias("min_corr"), (F.max("c") - F.min("c")).alias("spread")
    )
    return corr(keys, "full_corr").join(parts, keys)


def _scale(obs: DataFrame, keys: list[str], robust: bool) -> DataFrame:
    """keys, center, scale: mean and deviation, or median and 1.4826 times the median absolute deviation."""
    if not robust:
        return obs.groupBy(*keys).agg(F.avg("value").alias("center"), F.stddev_samp("value").alias("scale"))
    med = obs.groupBy(*keys).agg(F.percentile("value", F.lit(0.5)).alias("center"))
    dev = obs.join(med, keys).withColumn("dev", F.abs(F.col("value") - F.col("center")))
    return dev.groupBy(*keys).agg(F.first("center").alias("center"), (1.4826 * F.percentile("dev", F.lit(0.5))).alias("scale"))


def tail(obs: DataFrame, n: int | None, keys: list[str]) -> DataFrame:
    """The last n rows with a value of each key; all if n is None."""
    full = obs.filter(F.col("value").isNotNull())
    if n is None:
        return full
    back = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("date")))
    return full.withColumn("__back", back).filter(F.col("__back") <= n).drop("__back")


def latest_stats(obs: DataFrame, lookback: int | None = None, robust: bool = False, keys: list[str] | None = None) -> DataFrame:
    """keys, date, value, n, z and percentile (share of the history at or below) of the latest value."""
    keys = keys or ["series_id"]
    h = tail(obs, lookback, keys)
    now = h.groupBy(*keys).agg(F.max("date").alias("date"), F.max_by("value", "date").alias("latest"), F.count("*").alias("n"))
    share = h.join(now.drop("date"), keys).groupBy(*keys).agg(F.avg((F.col("value") <= F.col("latest")).cast("double")).alias("percentile"))
    out = now.join(_scale(h, keys, robust), keys).join(share, keys)
    z = F.when((F.col("n") >= 3) & (F.col("scale") > 0), (F.col("latest") - F.col("center")) / F.col("scale"))
    return out.select(*keys, "date", F.col("latest").alias("value"), "n", z.alias("z"), "percentile")


def lead_lag(pairs: DataFrame, max_lag: int, method: str = "pearson", keys: list[str] | None = None, least: int = 10) -> DataFrame:
    """keys, lag, n, correlation of a at t with b at t + lag; a positive lag means that a leads b."""
    keys = keys or ["pair_id"]
    d = pairs.dropna(subset=["a", "b"]).withColumn("rn", F.row_number().over(Window.partitionBy(*keys).orderBy("date")))
    lags = F.explode(F.sequence(F.lit(-max_lag), F.lit(max_lag)))
    left = d.select(*keys, "a", "rn", lags.alias("lag")).withColumn("rn", F.col("rn") + F.col("lag"))
    j = left.join(d.select(*keys, "rn", "b"), [*keys, "rn"])
    by = [*keys, "lag"]
    x, y = "a", "b"
    if method == "spearman":
        j = j.withColumns({"ra": _mean_rank("a", by), "rb": _mean_rank("b", by)})
        x, y = "ra", "rb"
    out = j.groupBy(*by).agg(F.count("*").alias("n"), _corr(x, y).alias("c"))
    return out.select(*by, "n", F.when(F.col("n") >= least, F.col("c")).alias("correlation"))


def peak_lag(xcorr: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """The lag of the largest absolute correlation, ties to the smaller lag."""
    keys = keys or ["pair_id"]
    best = F.min_by(F.struct("lag", "correlation"), F.struct(-F.abs("correlation"), F.abs("lag"), "lag"))
    top = xcorr.dropna(subset=["correlation"]).groupBy(*keys).agg(best.alias("b"))
    return top.select(*keys, "b.lag", "b.correlation")


def quantile_regime(obs: DataFrame, cuts: list[float], labels: list[str], keys: list[str] | None = None) -> DataFrame:
    """obs with regime: the label of the full-history quantile bucket (right-closed); equal cuts give NULL."""
    keys = keys or ["series_id"]
    q = obs.groupBy(*keys).agg(F.percentile("value", F.array(*[F.lit(c) for c in cuts])).alias("q"))
    j = obs.join(q, keys)
    distinct = F.size(F.array_distinct("q")) == len(cuts)
    label = F.lit(labels[-1])
    for i in reversed(range(len(cuts))):
        label = F.when(F.col("value") <= F.col("q")[i], labels[i]).otherwise(label)
    return j.withColumn("regime", F.when(distinct & F.col("value").isNotNull(), label)).drop("q")


def transitions(regimes: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """keys, from_state, to_state, n, probability for every pair of states of a key, absent ones with 0."""
    keys = keys or ["series_id"]
    nxt = F.lead("regime").over(Window.partitionBy(*keys).orderBy("date"))
    moves = regimes.filter("regime IS NOT NULL").withColumn("to_state", nxt).filter("to_state IS NOT NULL")
    n = moves.groupBy(*keys, F.col("regime").alias("from_state"), "to_state").count()
    states = regimes.filter("regime IS NOT NULL").select(*keys, "regime").distinct()
    square = states.withColumnRenamed("regime", "from_state").join(states.withColumnRenamed("regime", "to_state"), keys)
    full = square.join(n, [*keys, "from_state", "to_state"], "left").withColumn("n", F.coalesce("count", F.lit(0).cast("bigint")))
    total = F.sum("n").over(Window.partitionBy(*keys, "from_state"))
    return full.withColumn("probability", F.col("n") / F.nullif(total, F.lit(0))).drop("count")


def rolling_percentile(obs: DataFrame, window: int, keys: list[str] | None = None) -> DataFrame:
    """Share of the earlier rows of the window that are at or below the current one."""
    keys, least = keys or ["series_id"], max(window // 2, 10)
    full = obs.filter(F.col("value").isNotNull())
    m = _memberships(full, keys, window)
    by = [*keys, "end"]
    last = m.groupBy(*by).agg(F.max_by("value", "rn").alias("now"), F.max("date").alias("date"), F.count("*").alias("n"))
    j = m.join(last.select(*by, "now"), by).filter(F.col("rn") < F.col("end"))
    share = j.groupBy(*by).agg(F.avg((F.col("value") <= F.col("now")).cast("double")).alias("share"))
    out = last.join(share, by, "left")
    return out.select(*keys, "date", F.when(F.col("n") >= least, F.col("share")).alias("percentile"))


def rolling_zscore(obs: DataFrame, window: int, keys: list[str] | None = None) -> DataFrame:
    w = _rows(keys or ["series_id"], window)
    sd = F.nullif(F.stddev_samp("value").over(w), F.lit(0.0))
    z = F.when(F.count("value").over(w) >= window, (F.col("value") - F.avg("value").over(w)) / sd)
    return obs.withColumn("z", z)


def jumps(obs: DataFrame, window: int = 60, threshold: float = 4.0, lookback_days: int = 365, keys: list[str] | None = None) -> DataFrame:
    """Changes of at least threshold sigmas; sigma from bipower variation, or from the MAD where that is nil."""
    keys, least = keys or ["series_id"], window // 2
    order = Window.partitionBy(*keys).orderBy("date")
    d = obs.filter(F.col("value").isNotNull()).withColumn("change", F.col("value") - F.lag("value").over(order))
    d = d.filter(F.col("change").isNotNull())
    d = d.withColumn("bipower", F.abs("change") * F.abs(F.lag("change").over(order)))
    w = _rows(keys, window)
    sigma = F.when(F.count("bipower").over(w) >= least, F.sqrt(F.avg("bipower").over(w) * (np.pi / 2)))
    d = d.withColumns({"sigma": sigma, "rn": F.row_number().over(order), "last": F.max("date").over(Window.partitionBy(*keys))})
    nil = d.filter("sigma <= 1e-10").select(*keys, F.col("rn").alias("end"))
    m = _memberships(d.select(*keys, "date", "change"), keys, window).join(nil, [*keys, "end"])
    med = m.groupBy(*keys, "end").agg(F.percentile("change", F.lit(0.5)).alias("med"))
    mad = m.join(med, [*keys, "end"]).groupBy(*keys, F.col("end").alias("rn")).agg((1.4826 * F.percentile(F.abs(F.col("change") - F.col("med")), F.lit(0.5))).alias("mad"))
    d = d.join(mad, [*keys, "rn"], "left").withColumn("sigma", F.when(F.col("sigma") <= 1e-10, F.col("mad")).otherwise(F.col("sigma")))
    d = d.withColumn("z", F.col("change") / F.nullif("sigma", F.lit(0.0))).filter(F.abs("z") >= threshold)
    recent = F.col("date") >= F.date_sub("last", lookback_days)
    return d.select(*keys, "date", "change", "z", recent.alias("is_recent"))


def histogram(obs: DataFrame, bins: int = 50, keys: list[str] | None = None) -> DataFrame:
    """keys, bin (from 1), n over equal-width bins between the least and the largest value."""
    keys = keys or ["series_id"]
    span = obs.groupBy(*keys).agg(F.min("value").alias("lo"), F.max("value").alias("hi"))
    width = F.nullif((F.col("hi") - F.col("lo")) / bins, F.lit(0.0))
    place = F.least(F.coalesce(F.floor((F.col("value") - F.col("lo")) / width), F.lit(0)) + 1, F.lit(bins))
    return obs.filter("value IS NOT NULL").join(span, keys).groupBy(*keys, place.cast("bigint").alias("bin")).agg(F.count("*").alias("n"))


def pca(wide: DataFrame, columns: list[str], n_components: int = 2, sign_by: str | None = None) -> tuple[DataFrame, DataFrame]:
    """Loadings (component, column, loading, explained) and scores (wide with pc1, ...) of standardised columns.

    One aggregate gives the moments; a k x k matrix is solved on the driver; scores are a projection. A
    component's sign makes the loading of sign_by (default: the last column) at least 0.
    """
    full = wide.dropna(subset=columns)
    aggs = [F.avg(c).alias(f"m_{c}") for c in columns] + [F.stddev_pop(c).alias(f"s_{c}") for c in columns]
    aggs += [_corr(a, b).alias(f"r_{i}_{j}") for i, a in enumerate(columns) for j, b in enumerate(columns) if i < j]
    m = full.agg(*aggs).first()
    k = len(columns)
    r = np.eye(k)
    for i in range(k):
        for j in range(i + 1, k):
            v = m[f"r_{i}_{j}"]
            r[i, j] = r[j, i] = 0.0 if v is None else v
    values, vectors = np.linalg.eigh(r)
    order = np.argsort(values)[::-1][:n_components]
    at = columns.index(sign_by) if sign_by else k - 1
    rows, scores = [], {}
    for p, c in enumerate(order, 1):
        v = vectors[:, c] * (1 if vectors[at, c] >= 0 else -1)
        rows += [(p, name, float(x), float(values[c] / k)) for name, x in zip(columns, v, strict=True)]
        z = [(F.col(name) - m[f"m_{name}"]) / (m[f"s_{name}"] or 1.0) * float(x) for name, x in zip(columns, v, strict=True)]
        scores[f"pc{p}"] = reduce(lambda a, b: a + b, z)
    loadings = wide.sparkSession.createDataFrame(rows, "component int, column string, loading double, explained double")
    return loadings, full.withColumns(scores)
