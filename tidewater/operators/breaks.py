"""Breaks in the level of series: the best piecewise-constant fits for every number of breaks.

The search is exact for series of any length. Best fits of the first rows with a break less are extended by a last
segment; a start o of the last segment is kept only while it can still win. With a later start i, the mean m of the rows
between them and their inner sum of squares c, the start o is as good as i for a level u of the last segment only if
``(i - o) * (u - m) ** 2 + c`` is at most the gain of the fit up to i over the one up to o. So each i leaves o an
interval of levels, and when the intervals have no common level, o is dropped for good. Few starts are left at a time, so
a series of 15,000 rows takes seconds where a table of all segments would take its square.

A series is one group of a Python task (two doubles a row); the order of its rows is the search's own order.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .align import downsample

LEAST_ROWS = 10


class _Costs:
    """Sums of squares about the mean of any rows i to j (from i, before j) of x."""

    def __init__(self, x: np.ndarray) -> None:
        x = x - x.mean()
        self.s, self.q = np.concatenate([[0.0], np.cumsum(x)]), np.concatenate([[0.0], np.cumsum(x * x)])

    def of(self, i: np.ndarray | int, j: np.ndarray | int) -> np.ndarray:
        d = self.s[j] - self.s[i]
        return np.maximum(self.q[j] - self.q[i] - d * d / (j - i), 0.0)


def _extended(costs: _Costs, before: np.ndarray, least: int, first: int) -> tuple[np.ndarray, np.ndarray]:
    """For every j: the least of before[i] + the cost of i to j over i from first to j - least, and the smallest such i."""
    n = len(before) - 1
    best, start = np.full(n + 1, np.inf), np.full(n + 1, -1)
    slack = 1e-12 * (costs.q[-1] + 1e-300) * n
    at = np.empty(0, np.int64)
    low, high = np.empty(0), np.empty(0)
    for j in range(first + least, n + 1):
        new = j - least
        if len(at):
            length = new - at
            gain = before[new] - before[at] - costs.of(at, new) + slack
            middle = (costs.s[new] - costs.s[at]) / length
            half = np.sqrt(np.maximum(gain, 0.0) / length)
            low, high = np.maximum(low, middle - half), np.minimum(high, middle + half)
            keep = (gain >= 0) & (low <= high)
            at, low, high = at[keep], low[keep], high[keep]
        at, low, high = np.append(at, new), np.append(low, -np.inf), np.append(high, np.inf)
        total = before[at] + costs.of(at, j)
        least_at = int(total.argmin())
        best[j], start[j] = total[least_at], at[least_at]
    return best, start


def segmentations(x: np.ndarray, most: int, least: int) -> list[tuple[float, list[int]]]:
    """(sum of squares, first rows of the segments after the first) of the best fit with 0, 1, ... breaks.

    Segments have at least so many rows; as many breaks as fit.
    """
    n = len(x)
    costs = _Costs(np.asarray(x, float))
    best = np.full(n + 1, np.inf)
    best[least:] = costs.of(0, np.arange(least, n + 1))
    out, starts = [(float(best[n]), [])], []
    for k in range(1, most + 1):
        if n < (k + 1) * least:
            break
        if k == most:  # only the whole series matters now
            i = np.arange(k * least, n - least + 1)
            total = best[i] + costs.of(i, n)
            at = int(total.argmin())
            starts.append(np.full(n + 1, i[at]))
            whole = float(total[at])
        else:
            best, start = _extended(costs, best, least, k * least)
            starts.append(start)
            whole = float(best[n])
        breaks, end = [], n
        for start in reversed(starts):
            end = int(start[end])
            breaks.append(end)
        out.append((whole, breaks[::-1]))
    return out


def structural_breaks(
    obs: DataFrame, max_breaks: int = 5, min_segment: int | None = None, n_breaks: int | None = None, resample: str | None = None,
    keys: list[str] | None = None,
) -> DataFrame:
    """keys, k, n, rss, bic, breaks, break_dates, best: the best segmentation for every number k of breaks.

    breaks: rows before each break; break_dates: the first date of each segment but the first. best: the k of least BIC,
    or n_breaks if given. Segments have min_segment rows at least: by default an even share for two segments more than
    breaks, but 3. resample: a frequency to take means by first. Series of fewer than ten values are left out.
    """
    keys = keys or ["series_id"]
    full = obs.filter(F.col("value").isNotNull()) if resample is None else downsample(obs, resample, "mean", keys)
    most = max(max_breaks, n_breaks or 0)
    fields = [f for f in full.schema if f.name in keys]
    kinds = {"k": T.IntegerType(), "n": T.LongType(), "rss": T.DoubleType(), "bic": T.DoubleType(), "breaks": T.ArrayType(T.IntegerType()), "break_dates": T.ArrayType(T.DateType()), "best": T.BooleanType()}
    schema = T.StructType([*fields, *[T.StructField(name, kind) for name, kind in kinds.items()]])

    def search(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("date")
        n = len(pdf)
        if n < LEAST_ROWS:
            return pd.DataFrame({f.name: pd.Series([], dtype=object) for f in schema})
        least = max(n // (max_breaks + 2), 3) if min_segment is None else min_segment
        dates = pdf.date.tolist()
        rows = [
            {
                "k": k, "n": n, "rss": rss, "bic": n * np.log(max(rss, 1e-12) / n) + (k + 1) * np.log(n), "breaks": breaks,
                "break_dates": [dates[i] for i in breaks],
            }
            for k, (rss, breaks) in enumerate(segmentations(pdf.value.to_numpy(), most, least))
        ]
        chosen = n_breaks if n_breaks is not None else min(range(len(rows)), key=lambda k: (rows[k]["bic"], k))
        out = pd.DataFrame(rows).assign(best=[r["k"] == chosen for r in rows])
        for key in keys:
            out[key] = pd.Series([pdf[key].iat[0]] * len(out), dtype=pdf[key].dtype)
        return out[[f.name for f in schema]]

    return full.select(*keys, "date", "value").groupBy(*keys).applyInPandas(search, schema)


def regimes(obs: DataFrame, breaks: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """obs (without missing values) with regime: how many breaks of its best segmentation lie at or before the date."""
    keys = keys or ["series_id"]
    best = breaks.filter("best").select(*keys, F.col("break_dates").alias("__breaks"))
    held = obs.filter(F.col("value").isNotNull()).join(best.hint("merge"), keys)
    return held.withColumn("regime", F.size(F.filter("__breaks", lambda b: b <= F.col("date")))).drop("__breaks")


def regime_stats(labelled: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """keys, regime, since, until, n, mean, std of the regimes."""
    keys = keys or ["series_id"]
    return labelled.groupBy(*keys, "regime").agg(
        F.min("date").alias("since"), F.max("date").alias("until"), F.count("*").alias("n"), F.avg("value").alias("mean"),
        F.stddev_samp("value").alias("std"),
    )
