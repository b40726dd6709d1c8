"""Regressions by group: moments by one distributed aggregate, then small solves on one row for each group."""

from __future__ import annotations

from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.distributions import f_tail, normal_quantile

#: Response surfaces of the unit-root critical values, constant only: level, 1/n and 1/n^2 terms.
CRITICAL = {
    1: {"1%": (-3.43035, -6.5393, -16.786), "5%": (-2.86154, -2.8903, -4.234), "10%": (-2.56677, -1.5384, -2.809)},
    2: {"1%": (-3.89644, -10.9519, -22.527), "5%": (-3.33613, -6.1101, -6.823), "10%": (-3.04445, -4.2412, -2.72)},
}


def _solve(y: str, xs: list[str], keys: list[str]):
    k = len(xs)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        rows = []
        for r in pdf.to_dict("records"):
            n = r["n"]
            mx = np.array([r[f"m{i}"] for i in range(k)])
            sxx = np.array([[r[f"c{min(i, j)}_{max(i, j)}"] for j in range(k)] for i in range(k)]) * n
            sxy = np.array([r[f"y{i}"] for i in range(k)]) * n
            syy = r["yy"] * n
            if n <= k + 1 or np.linalg.matrix_rank(sxx) < k:
                continue
            inv = np.linalg.inv(sxx)
            beta = inv @ sxy
            rss = max(syy - beta @ sxy, 0.0)
            s2 = rss / (n - k - 1)
            se = np.sqrt(s2 * np.diag(inv))
            const = r["my"] - beta @ mx
            se0 = np.sqrt(s2 * (1 / n + mx @ inv @ mx))
            r2 = 1 - rss / syy if syy > 0 else np.nan
            for name, b, s in zip(["const", *xs], [const, *beta], [se0, *se], strict=True):
                rows.append({**{c: r[c] for c in keys}, "term": name, "beta": b, "se": s, "n": n, "r2": r2, "rss": rss})
        return pd.DataFrame(rows, columns=[*keys, "term", "beta", "se", "n", "r2", "rss"])

    return run


def grouped_ols(df: DataFrame, y: str, xs: list[str], keys: list[str]) -> DataFrame:
    """keys, term, beta, se, n, r2, rss: least squares with a constant for every group.

    Spark aggregates centred second moments (covariances merge stably); Python sees one row for each group.
    Groups with too few rows or collinear columns are left out.
    """
    d = df.dropna(subset=[y, *xs]).select(*keys, F.col(y).cast("double").alias("__y"), *[F.col(x).cast("double").alias(f"__x{i}") for i, x in enumerate(xs)])
    k = range(len(xs))
    aggs = [F.count("*").alias("n"), F.avg("__y").alias("my"), F.covar_pop("__y", "__y").alias("yy")]
    aggs += [F.avg(f"__x{i}").alias(f"m{i}") for i in k] + [F.covar_pop(f"__x{i}", "__y").alias(f"y{i}") for i in k]
    aggs += [F.covar_pop(f"__x{i}", f"__x{j}").alias(f"c{i}_{j}") for i in k for j in k if i <= j]
    moments = d.groupBy(*keys).agg(*aggs)
    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in df.select(*keys).schema)
    run = _solve(y, xs, keys)
    return moments.mapInPandas(lambda it: (run(p) for p in it), f"{fields}, term string, beta double, se double, n bigint, r2 double, rss double")


def residuals(df: DataFrame, y: str, xs: list[str], keys: list[str], fit: DataFrame | None = None) -> DataFrame:
    """df (rows without missing values) with ``resid``."""
    fit = grouped_ols(df, y, xs, keys) if fit is None else fit
    wide = fit.groupBy(*keys).agg(*[F.max(F.when(F.col("term") == t, F.col("beta"))).alias(f"__b_{t}") for t in ["const", *xs]])
    j = df.dropna(subset=[y, *xs]).join(wide, keys)
    return j.withColumn("resid", F.col(y) - F.col("__b_const") - reduce(lambda a, b: a + b, [F.col(x) * F.col(f"__b_{x}") for x in xs])).drop(*[f"__b_{t}" for t in ["const", *xs]])


def _sandwich(xs: list[str], keys: list[str]):
    names = ["const", *xs]
    k = len(names)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        rows = []
        for r in pdf.to_dict("records"):
            a = np.array([[r[f"a{min(i, j)}_{max(i, j)}"] for j in range(k)] for i in range(k)])
            s = np.array([[r[f"s{i}_{j}"] for j in range(k)] for i in range(k)])
            if np.linalg.matrix_rank(a) < k:
                continue
            inv = np.linalg.inv(a)
            v = inv @ s @ inv
            rows += [{**{c: r[c] for c in keys}, "term": t, "se_robust": np.sqrt(max(v[i, i], 0.0))} for i, t in enumerate(names)]
        return pd.DataFrame(rows, columns=[*keys, "term", "se_robust"])

    return run


def robust_se(df: DataFrame, y: str, xs: list[str], keys: list[str], order: str, lags: int = 0, hc3: bool = False) -> DataFrame:
    """grouped_ols() with se_robust: Newey-West with Bartlett weights over so many rows (0: White), or HC3."""
    fit = grouped_ols(df, y, xs, keys)
    r = residuals(df, y, xs, keys, fit)
    cols = ["__one", *xs]
    r = r.withColumn("__one", F.lit(1.0))
    k = range(len(cols))
    bread = r.groupBy(*keys).agg(*[F.sum(F.col(cols[i]) * F.col(cols[j])).alias(f"a{i}_{j}") for i in k for j in k if i <= j])
    if hc3:
        r = _leverage(r, bread, cols, keys).withColumn("resid", F.col("resid") / (1 - F.col("__h")))
        lags = 0
    r = r.select(*keys, order, *[(F.col(c) * F.col("resid")).alias(f"u{i}") for i, c in enumerate(cols)])
    w = Window.partitionBy(*keys).orderBy(order)
    for lag in range(1, lags + 1):
        r = r.withColumns({f"u{i}_{lag}": F.lag(f"u{i}", lag).over(w) for i in k})
    sums = []
    for i in k:
        for j in k:
            s = F.sum(F.col(f"u{i}") * F.col(f"u{j}"))
            for lag in range(1, lags + 1):
                cross = F.coalesce(F.sum(F.col(f"u{i}") * F.col(f"u{j}_{lag}") + F.col(f"u{j}") * F.col(f"u{i}_{lag}")), F.lit(0.0))
                s = s + (1 - lag / (lags + 1)) * cross
            sums.append(s.alias(f"s{i}_{j}"))
    both = bread.join(r.groupBy(*keys).agg(*sums), keys)
    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in df.select(*keys).schema)
    run = _sandwich(xs, keys)
    se = both.mapInPandas(lambda it: (run(p) for p in it), f"{fields}, term string, se_robust double")
    return fit.join(se, [*keys, "term"])


def _leverage(r: DataFrame, bread: DataFrame, cols: list[str], keys: list[str]) -> DataFrame:
    k = len(cols)

    def invert(pdf: pd.DataFrame) -> pd.DataFrame:
        rows = []
        for x in pdf.to_dict("records"):
            a = np.array([[x[f"a{min(i, j)}_{max(i, j)}"] for j in range(k)] for i in range(k)])
            rows.append({**{c: x[c] for c in keys}, "inv": np.linalg.pinv(a).ravel().tolist()})
        return pd.DataFrame(rows, columns=[*keys, "inv"])

    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in r.select(*keys).schema)
    inv = bread.mapInPandas(lambda it: (invert(p) for p in it), f"{fields}, inv array<double>")
    h = reduce(lambda a, b: a + b, [F.col(cols[i]) * F.col(cols[j]) * F.col("inv")[i * k + j] for i in range(k) for j in range(k)])
    return r.join(inv, keys).withColumn("__h", h).drop("inv")


def local_projection(
    df: DataFrame, y: str, shock: str, horizons: int = 12, lags: int = 4, controls: list[str] | None = None, keys: list[str] | None = None,
    hac: int | None = None, level: float = 0.95,
) -> DataFrame:
    """keys, h, beta, se_robust, lower, upper, n of the response of y at t + h to the shock at t, given own lags and controls.

    hac: lags of the standard errors, by default as many as horizons (the residuals of t + h overlap so far), one at
    least. lower and upper bound the band of the given level. Horizons with fewer rows than regressors and five have
    n alone.
    """
    keys = keys or ["series_id"]
    hac = max(horizons, 1) if hac is None else hac
    w = Window.partitionBy(*keys).orderBy("date")
    own = [f"{y}_l{i}" for i in range(1, lags + 1)]
    design = [shock, *own, *(controls or [])]
    d = df.dropna(subset=[y, shock, *(controls or [])])
    d = d.withColumns({c: F.lag(y, i).over(w) for i, c in enumerate(own, 1)}).dropna(subset=own) if own else d
    leads = F.array(*[F.struct(F.lit(h).alias("h"), F.lead(y, h).over(w).alias("ahead")) for h in range(horizons + 1)])
    d = d.withColumn("__l", leads).select("*", F.explode("__l").alias("__e")).select("*", "__e.h", "__e.ahead").drop("__l", "__e")
    n = d.groupBy(*keys, "h").agg(F.count("ahead").alias("n"))
    fit = robust_se(d, "ahead", design, [*keys, "h"], "date", hac).filter(F.col("term") == shock).drop("n")
    enough = F.col("n") >= len(design) + 5
    z = normal_quantile(F.lit(0.5 + level / 2))
    out = n.join(fit.hint("merge"), [*keys, "h"], "left").withColumns({c: F.when(enough, F.col(c)) for c in ("beta", "se_robust")})
    return out.select(*keys, "h", "beta", "se_robust", (F.col("beta") - z * F.col("se_robust")).alias("lower"), (F.col("beta") + z * F.col("se_robust")).alias("upper"), "n")


def cp_regression(panel: DataFrame, rx: str = "rx", cp: str = "cp", keys: list[str] | None = None, lags: int = 12, least: int = 30) -> DataFrame:
    """keys, r2, n, coefficient, t, f_pvalue of excess returns on the curve factor, with standard errors over ``lags`` rows.

    Keys with fewer than ``least`` rows are left out; the F statistic of one regressor is the square of its t.
    """
    keys = keys or ["tenor"]
    fit = robust_se(panel, rx, [cp], keys, "date", lags).filter((F.col("term") == cp) & (F.col("n") >= least))
    t = F.col("beta") / F.nullif("se_robust", F.lit(0.0))
    fit = fit.withColumn("t", t)
    return fit.select(*keys, "r2", "n", F.col("beta").alias("coefficient"), "t", f_tail(F.col("t") * F.col("t"), F.lit(1), F.col("n") - 2).alias("f_pvalue"))


def cp_snapshot(factor: DataFrame, fits: DataFrame, tenors: tuple[int, ...] = (5, 10)) -> DataFrame:
    """date, value, z, percentile, n of the latest factor (series_id, date, value), with r2_<tenor> of its regressions."""
    from .series import latest_stats

    r2 = fits.agg(*[F.max(F.when(F.col("tenor") == t, F.col("r2"))).alias(f"r2_{t}") for t in tenors])
    now = latest_stats(factor).select(F.lit(1).alias("__one"), "date", "value", "z", "percentile", "n")
    return now.join(F.broadcast(r2.withColumn("__one", F.lit(1))), "__one").drop("__one")  # one row


def scatter_fit(pairs: DataFrame, split: str, keys: list[str] | None = None, least: int = 5) -> DataFrame:
    """keys, side, n, slope, intercept of b on a before and from a date."""
    keys = keys or ["pair_id"]
    side = F.when(F.col("date") < F.lit(split).cast("date"), "before").otherwise("after")
    g = pairs.dropna(subset=["a", "b"]).groupBy(*keys, side.alias("side")).agg(
        F.count("*").alias("n"), F.regr_slope("b", "a").alias("slope"), F.regr_intercept("b", "a").alias("intercept")
    )
    return g.filter(F.col("n") >= least)


def fama_macbeth(returns: DataFrame, factors: list[str], min_obs: int = 60, keys: list[str] | None = None) -> DataFrame:
    """keys, term, premium, se, t_shanken: mean returns of assets on their factor betas.

    returns: keys, asset, date, ret and a column for each factor. First pass: a regression for each asset;
    second pass: one over assets; the correction is 1 + l' inv(S_F) l from the factors' covariances.
    """
    keys = keys or []
    first = grouped_ols(returns, "ret", factors, [*keys, "asset"]).filter(F.col("n") >= min_obs)
    betas = first.groupBy(*keys, "asset").agg(*[F.max(F.when(F.col("term") == f, F.col("beta"))).alias(f) for f in factors])
    mean = returns.dropna(subset=["ret", *factors]).groupBy(*keys, "asset").agg(F.avg("ret").alias("mean_ret"))
    x = betas.join(mean, [*keys, "asset"]).withColumn("__all", F.lit(1))
    second = grouped_ols(x, "mean_ret", factors, [*keys, "__all"])
    dates = returns.select(*keys, "date", *factors).dropna().distinct()
    cov = dates.groupBy(*keys).agg(F.array(*[F.covar_samp(a, b) for a in factors for b in factors]).alias("cov"))
    cov = cov.withColumn("__all", F.lit(1))
    k = len(factors)
    prem = second.groupBy(*keys, "__all").agg(*[F.max(F.when(F.col("term") == f, F.col("beta"))).alias(f"l_{f}") for f in factors])
    one = prem.join(cov, [*keys, "__all"])

    def shanken(it):
        for pdf in it:
            c = [max(1.0, 1 + np.array(l_) @ np.linalg.pinv(np.array(s).reshape(k, k)) @ np.array(l_)) for l_, s in zip(pdf[[f"l_{f}" for f in factors]].to_numpy().tolist(), pdf["cov"], strict=True)]
            yield pdf[[*keys, "__all"]].assign(c=np.array(c, float))

    fields = "".join(f"{f.name} {f.dataType.simpleString()}, " for f in returns.select(*keys).schema)
    c = one.mapInPandas(shanken, f"{fields}__all int, c double")
    out = second.join(c, [*keys, "__all"])
    return out.select(*keys, "term", F.col("beta").alias("premium"), (F.col("se") * F.sqrt("c")).alias("se"), (F.col("beta") / F.nullif("se", F.lit(0.0)) / F.sqrt("c")).alias("t_shanken"), "n")


def adf(obs: DataFrame, max_lag: int = 4, keys: list[str] | None = None, variables: int = 1) -> DataFrame:
    """keys, lag, statistic and critical values of the unit-root test; the lag with the least AIC."""
    keys = keys or ["series_id"]
    w = Window.partitionBy(*keys).orderBy("date")
    d = obs.filter("value IS NOT NULL").withColumns({"level": F.lag("value").over(w), "change": F.col("value") - F.lag("value").over(w)})
    lags = [f"change_l{i}" for i in range(1, max_lag + 1)]
    d = d.withColumns({c: F.lag("change", i).over(w) for i, c in enumerate(lags, 1)}).dropna(subset=["change", "level", *lags])
    fits = []
    for p in range(max_lag + 1):
        f = grouped_ols(d, "change", ["level", *lags[:p]], keys).filter("term = 'level'")
        aic = F.col("n") * F.ln(F.greatest(F.col("rss"), F.lit(1e-300)) / F.col("n")) + 2 * (p + 2)
        fits.append(f.select(*keys, F.lit(p).alias("lag"), (F.col("beta") / F.nullif("se", F.lit(0.0))).alias("statistic"), "n", aic.alias("aic")))
    all_ = reduce(DataFrame.unionByName, fits)
    best = all_.withColumn("__n", F.row_number().over(Window.partitionBy(*keys).orderBy("aic", "lag"))).filter("__n = 1").drop("__n")
    crit = lambda c: F.lit(c[0]) + F.lit(c[1]) / F.col("n") + F.lit(c[2]) / (F.col("n") * F.col("n"))
    values = {f"crit_{q.rstrip('%')}": crit(c) for q, c in CRITICAL[variables].items()}
    return best.withColumns(values).withColumn("stationary", F.col("statistic") < F.col("crit_5"))


def engle_granger(pairs: DataFrame, max_lag: int = 4, keys: list[str] | None = None) -> DataFrame:
    """Cointegration of a and b: the unit-root test on the residual of a on b, with critical values for two."""
    keys = keys or ["pair_id"]
    r = residuals(pairs, "a", ["b"], keys).select(*keys, "date", F.col("resid").alias("value"))
    return adf(r, max_lag, keys, variables=2).withColumnRenamed("stationary", "cointegrated")


def granger(pairs: DataFrame, max_lag: int = 4, keys: list[str] | None = None) -> DataFrame:
    """keys, lag, f, df1, df2, p_value: whether lags of b help to predict a, for every number of lags."""
    keys = keys or ["pair_id"]
    w = Window.partitionBy(*keys).orderBy("date")
    d = pairs.dropna(subset=["a", "b"])
    d = d.withColumns({f"{c}_l{i}": F.lag(c, i).over(w) for c in "ab" for i in range(1, max_lag + 1)})
    out = []
    for p in range(1, max_lag + 1):
        own, other = [f"a_l{i}" for i in range(1, p + 1)], [f"b_l{i}" for i in range(1, p + 1)]
        rows = d.dropna(subset=[*own, *other])
        one = lambda xs, name, rows=rows: grouped_ols(rows, "a", xs, keys).filter("term = 'const'").select(*keys, F.col("rss").alias(name), "n")
        j = one(own, "restricted").drop("n").join(one([*own, *other], "full").hint("merge"), keys)
        df2 = F.col("n") - (2 * p + 1)
        f = (F.col("restricted") - F.col("full")) / p / F.nullif(F.col("full") / df2, F.lit(0.0))
        out.append(j.select(*keys, F.lit(p).alias("lag"), f.alias("f"), F.lit(p).alias("df1"), df2.alias("df2")))
    return reduce(DataFrame.unionByName, out).withColumn("p_value", f_tail(F.col("f"), F.col("df1"), F.col("df2")))


def granger_minima(tests: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """keys, min_p, lag: the least p-value of granger() over its lags, ties to fewer lags."""
    keys = keys or ["pair_id"]
    best = F.min_by(F.struct("p_value", "lag"), F.struct("p_value", "lag"))
    g = tests.dropna(subset=["p_value"]).groupBy(*keys).agg(best.alias("b"))
    return g.select(*keys, F.col("b.p_value").alias("min_p"), "b.lag")


def _joint(columns: list[str], names: list[str], keys: list[str]):
    """All equations of a vector autoregression from the joint moments of a row."""
    k, q = len(columns), len(names)
    cols = [*columns, *names]

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        rows = []
        for r in pdf.to_dict("records"):
            n, mean = r["n"], np.array([r[f"m{i}"] for i in range(k + q)], float)
            c = np.array([[r[f"c{min(i, j)}_{max(i, j)}"] for j in range(k + q)] for i in range(k + q)], float) * n
            xx, xy, yy = c[k:, k:], c[k:, :k], c[:k, :k]
            if n <= q + 1 or np.linalg.matrix_rank(xx) < q:
                continue
            inv = np.linalg.inv(xx)
            beta = inv @ xy
            resid = yy - xy.T @ beta
            sign, logdet = np.linalg.slogdet(resid / n)
            aic = logdet + 2 / n * (k * k * (q // k) + k) if sign > 0 else np.nan
            const = mean[:k] - beta.T @ mean[k:]
            now = np.array([r[f"now_{name}"] for name in names], float)
            corr = resid / np.sqrt(np.outer(np.diag(resid), np.diag(resid)))
            for e, name in enumerate(columns):
                s2 = resid[e, e] / (n - q - 1)
                se = np.sqrt(np.maximum(s2 * np.r_[1 / n + mean[k:] @ inv @ mean[k:], np.diag(inv)], 0))
                ahead = const[e] + beta[:, e] @ now
                own = {**{c: r[c] for c in keys}, "equation": name, "forecast": ahead, "aic": aic, "n": n, "resid_corr": corr[e].tolist()}
                rows += [{**own, "term": t, "beta": b, "se": s} for t, b, s in zip(["const", *names], np.r_[const[e], beta[:, e]], se, strict=True)]
        return pd.DataFrame(rows, columns=[*keys, "equation", "term", "beta", "se", "forecast", "aic", "n", "resid_corr"])

    return run, cols


def var_model(wide: DataFrame, columns: list[str], lags: int = 2, keys: list[str] | None = None) -> DataFrame:
    """keys, equation, term, beta, se, forecast, aic, n, resid_corr: a vector autoregression and its one-step forecast.

    One aggregate gives the joint moments of the columns and their lags; all equations and the covariance of their
    residuals follow from it. aic: the logarithm of the determinant of that covariance (over n) plus
    2 / n for each coefficient. resid_corr: correlations of the equation's residuals with those of each column's.
    """
    keys = keys or ["panel_id"]
    w = Window.partitionBy(*keys).orderBy("date")
    names = [f"{c}_l{i}" for i in range(1, lags + 1) for c in columns]
    full = wide.dropna(subset=columns)
    d = full.withColumns({f"{c}_l{i}": F.lag(c, i).over(w) for i in range(1, lags + 1) for c in columns}).dropna(subset=names)
    run, cols = _joint(columns, names, keys)
    d = d.select(*keys, *[F.col(c).cast("double").alias(f"v{i}") for i, c in enumerate(cols)])
    k = range(len(cols))
    aggs = [F.count("*").alias("n"), *[F.avg(f"v{i}").alias(f"m{i}") for i in k]]
    aggs += [F.covar_pop(f"v{i}", f"v{j}").alias(f"c{i}_{j}") for i in k for j in k if i <= j]
    last = full.withColumn("__back", F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("date")))).filter(F.col("__back") <= lags)
    now = last.groupBy(*keys).agg(*[F.max(F.when(F.col("__back") == i, F.col(c))).alias(f"now_{c}_l{i}") for i in range(1, lags + 1) for c in columns])
    one = d.groupBy(*keys).agg(*aggs).join(now.hint("merge"), keys)
    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in wide.select(*keys).schema)
    return one.mapInPandas(
        lambda it: (run(p) for p in it), f"{fields}, equation string, term string, beta double, se double, forecast double, aic double, n bigint, resid_corr array<double>"
    )


def contemporaneous(wide: DataFrame, factors: list[str], others: list[str], keys: list[str] | None = None) -> DataFrame:
    """keys, factor, other, n, correlation of each factor with each of the others, over rows that have all."""
    from .series import _corr

    keys = keys or ["panel_id"]
    full = wide.dropna(subset=[*factors, *others])
    each = F.array(*[F.struct(F.lit(a).alias("factor"), F.lit(b).alias("other"), F.col(a).cast("double").alias("x"), F.col(b).cast("double").alias("y")) for a in factors for b in others])
    long = full.select(*keys, F.explode(each).alias("e")).select(*keys, "e.*")
    return long.groupBy(*keys, "factor", "other").agg(F.count("*").alias("n"), _corr("x", "y").alias("correlation"))


def onset_labels(flags: DataFrame, horizon: int = 4, offset: int | None = None, keys: list[str] | None = None) -> DataFrame:
    """keys, date, label: 1 if the flag turns on in the rows t + offset to t + offset + horizon - 1.

    The default offset is the horizon; 0 looks at the rows right ahead. Rows whose window is not whole are NULL.
    """
    keys = keys or ["series_id"]
    offset = horizon if offset is None else offset
    w = Window.partitionBy(*keys).orderBy("date")
    flip = ((F.col("flag") == 1) & (F.lag("flag").over(w) == 0)).cast("int")
    ahead = w.rowsBetween(offset, offset + horizon - 1)
    d = flags.withColumn("flip", F.coalesce(flip, F.lit(0)))
    return d.select(*keys, "date", F.when(F.count("flip").over(ahead) == horizon, F.max("flip").over(ahead)).alias("label"))


def auroc(scored: DataFrame, keys: list[str]) -> DataFrame:
    """keys, n, auroc of score for label, from rank sums with ties averaged."""
    every = Window.partitionBy(*keys)
    ties = F.count("*").over(Window.partitionBy(*keys, "score"))
    d = scored.dropna(subset=["score", "label"]).withColumn("r", F.rank().over(every.orderBy("score")) + (ties - 1) / 2)
    g = d.groupBy(*keys).agg(F.count("*").alias("n"), F.sum("label").alias("p"), F.sum(F.when(F.col("label") == 1, F.col("r"))).alias("s"))
    area = (F.col("s") - F.col("p") * (F.col("p") + 1) / 2) / F.nullif(F.col("p") * (F.col("n") - F.col("p")), F.lit(0))
    return g.select(*keys, "n", area.alias("auroc"))


def _logit(x: np.ndarray, y: np.ndarray, c: float) -> np.ndarray:
    """Constant and weights of the logit with penalty |weights|^2 / 2 against c times the log-loss, by Newton's method."""
    z = np.c_[np.ones(len(x)), x]
    ridge = np.r_[0.0, np.full(x.shape[1], 1 / c)]
    w = np.zeros(z.shape[1])

    def loss(w: np.ndarray) -> float:
        u = z @ w
        return float(np.sum(np.logaddexp(0, u) - y * u) + (ridge * w * w).sum() / 2)

    for _ in range(100):
        p = 1 / (1 + np.exp(-z @ w))
        step = np.linalg.solve((z * (p * (1 - p))[:, None]).T @ z + np.diag(ridge + 1e-12), z.T @ (p - y) + ridge * w)
        size, now = 1.0, loss(w)
        while loss(w - size * step) > now and size > 1e-8:
            size /= 2
        w = w - size * step
        if np.abs(size * step).max() < 1e-10:
            break
    return w


def onset_logit(panel: DataFrame, predictors: list[str], c: float = 1.0, least: int = 60, lag: int = 1, keys: list[str] | None = None) -> DataFrame:
    """keys, date, label, score, coefficients: a penalised logit for each key, on predictors standardised and lagged.

    panel: keys, date, label (NULL where it is not known yet) and predictors. The fit takes rows with a label; every row
    whose predictors are there gets a score, so the last ones too. Predictors with fewer than ``least`` values are
    left out of a key's fit (coefficient NULL), and keys with fewer such rows, or one label alone, altogether. A key has a
    row a month, so that a task holds one key's history.
    """
    keys = keys or ["series_id"]
    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in panel.select(*keys).schema)

    def fit(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("date")
        x = pdf[predictors].astype(float).shift(lag)
        use = [p for p in predictors if x[p].notna().sum() >= least - lag]
        none = pd.DataFrame({f: pd.Series([], dtype=object) for f in [*keys, "date", "label", "score", "coefficients"]})
        if not use:
            return none
        ready = x[use].notna().all(axis=1).to_numpy()
        known = ready & pdf.label.notna().to_numpy()
        y = pdf.label[known].to_numpy(float)
        if known.sum() < least or y.min() == y.max():
            return none
        m, s = x[use][known].mean().to_numpy(), x[use][known].std(ddof=0).to_numpy()
        z = (x[use].to_numpy() - m) / np.where(s > 0, s, 1.0)
        w = _logit(z[known], y, c)
        out = pdf[ready][[*keys, "date", "label"]].copy()
        out["score"] = 1 / (1 + np.exp(-(w[0] + z[ready] @ w[1:])))
        weights = dict(zip(use, w[1:], strict=True))
        out["coefficients"] = [[weights.get(p) for p in predictors]] * len(out)
        return out

    typed = panel.select(*keys, "date", F.col("label").cast("double").alias("label"), *[F.col(p).cast("double").alias(p) for p in predictors])
    out = typed.groupBy(*keys).applyInPandas(fit, f"{fields}, date date, label double, score double, coefficients array<double>")
    return out.withColumn("label", F.col("label").cast("int"))


def onset_summary(scored: DataFrame, back: int = 6, keys: list[str] | None = None) -> DataFrame:
    """keys, n, n_onsets, auroc, date, latest, earlier of onset_logit(): labelled rows, and the scores of the last row and
    of the one so many rows before."""
    keys = keys or ["series_id"]
    place = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("date")))
    at = lambda n, c: F.max(F.when(F.col("__back") == n, F.col(c)))
    ends = scored.withColumn("__back", place).filter(F.col("__back") <= back + 1).groupBy(*keys).agg(at(1, "date").alias("date"), at(1, "score").alias("latest"), at(back + 1, "score").alias("earlier"))
    known = scored.filter("label IS NOT NULL")
    onsets = known.groupBy(*keys).agg(F.sum("label").alias("n_onsets"))
    return auroc(known, keys).join(onsets.hint("merge"), keys).join(ends.hint("merge"), keys).select(*keys, "n", "n_onsets", "auroc", "date", "latest", "earlier")


def sentiment_bond(panel: DataFrame, predictors: list[str], duration: float = 8.5, lags: int = 3, least: int = 36, keys: list[str] | None = None) -> DataFrame:
    """keys, term, beta, se_robust, n, implied_bp: next period's excess return (-duration * dy - rf / 12) on predictors."""
    keys = keys or ["panel_id"]
    w = Window.partitionBy(*keys).orderBy("date")
    excess = -duration * (F.col("y") - F.lag("y").over(w)) - F.lag("rf").over(w) / 12
    d = panel.withColumn("excess", excess).withColumn("ahead", F.lead("excess").over(w))
    fit = robust_se(d, "ahead", predictors, keys, "date", lags).filter(F.col("n") >= least)
    now = panel.groupBy(*keys).agg(*[F.max_by(p, "date").alias(p) for p in predictors]).withColumn("const", F.lit(1.0))
    level = F.element_at(F.create_map(*[x for t in ["const", *predictors] for x in (F.lit(t), F.col(t))]), F.col("term"))
    implied = 100 * F.sum(F.col("beta") * level).over(Window.partitionBy(*keys))
    return fit.join(now, keys).select(*keys, "term", "beta", "se_robust", "n", implied.alias("implied_bp"))

