"""Order statistics of each row's own history: running median, median absolute deviation and strict percentile.

A series has one row a date, so its rows are bounded by the dates of its span (some 22,000 in sixty years of days), and a
task holds one series at a time. Its history is kept sorted; the values nearest to the median stand next to each
other in it, so both medians are found by bisection, and no row is paired with the rows before it.
"""

from __future__ import annotations

from bisect import bisect_left, insort

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def _nearest(a: list[float], m: float, k: int) -> float:
    """The (k + 1)-th smallest distance of the sorted values a to m."""
    low, high = 0, len(a) - k - 1
    while low < high:
        mid = (low + high) // 2
        if m - a[mid] > a[mid + k + 1] - m:
            low = mid + 1
        else:
            high = mid
    return max(m - a[low], a[low + k] - m)


def history_stats(values: list[float], min_rows: int) -> list[tuple[float, float, float]]:
    """(median, median absolute deviation, share strictly below the row) of the rows up to each row from min_rows on."""
    a: list[float] = []
    out = []
    for v in values:
        insort(a, v)
        n = len(a)
        if n < min_rows:
            continue
        lo, hi = (n - 1) // 2, n // 2
        med = (a[lo] + a[hi]) / 2
        mad = (_nearest(a, med, lo) + _nearest(a, med, hi)) / 2 if lo != hi else _nearest(a, med, lo)
        out.append((med, mad, bisect_left(a, v) / n))
    return out


def expanding(obs: DataFrame, min_rows: int = 24, floor: float = 1e-9, keys: list[str] | None = None) -> DataFrame:
    """keys, date, robust_z, percentile of every row in its own history, from min_rows rows on.

    robust_z: distance to the median over 1.4826 times the median absolute deviation, which counts as floor at least;
    percentile: the share of the history strictly below the value. Missing values are left out.
    """
    keys = keys or ["series_id"]
    fields = [obs.schema[k] for k in keys]
    schema = T.StructType([*fields, obs.schema["date"], T.StructField("robust_z", T.DoubleType()), T.StructField("percentile", T.DoubleType())])

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("date")
        stats = history_stats(pdf.value.tolist(), min_rows)
        out = pdf.iloc[min_rows - 1 :][[*keys, "date"]].copy()
        now = pdf.value.tolist()[min_rows - 1 :]
        out["robust_z"] = [(v - med) / max(1.4826 * mad, floor) for v, (med, mad, _) in zip(now, stats, strict=True)]
        out["percentile"] = [share for _, _, share in stats]
        return out

    full = obs.filter(F.col("value").isNotNull() & ~F.isnan("value")).select(*keys, "date", "value")
    return full.groupBy(*keys).applyInPandas(run, schema)
