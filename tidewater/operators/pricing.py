"""Factor pricing: asset returns and factor shocks from levels, premia on overlapping samples, their differences, hits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.stored import written
from .align import downsample
from .detect import hits
from .regression import fama_macbeth


def _changed(obs: DataFrame, registry: DataFrame, least: int) -> DataFrame:
    """name, date, value, before, how, scale of the monthly last values of the series in a registry (name, series_id, how,
    scale); series of at most ``least`` months are left out."""
    wanted = obs.join(registry.select("series_id").distinct().hint("merge"), "series_id", "left_semi")
    monthly = downsample(wanted, "M")
    w = Window.partitionBy("series_id")
    d = monthly.withColumns({"before": F.lag("value").over(w.orderBy("date")), "__n": F.count("value").over(w)})
    return d.filter(F.col("__n") > least).drop("__n").join(registry.hint("merge"), "series_id")


def asset_returns(obs: DataFrame, registry: DataFrame, least: int = 24) -> DataFrame:
    """asset, date, ret (percent a month) of the assets of a registry (name, series_id, how, scale).

    how: ``log``, scale times 100 times the log change of a price, for series that are positive throughout; ``diff``,
    scale times the change, as for yields, where scale is less the duration.
    """
    d = _changed(obs, registry, least)
    positive = F.min("value").over(Window.partitionBy("name")) > 0
    d = d.withColumn("__p", positive)
    log = F.when(F.col("__p"), 100 * (F.ln("value") - F.ln("before")))
    ret = F.when(F.col("how") == "log", log).otherwise(F.col("value") - F.col("before")) * F.col("scale")
    return d.select(F.col("name").alias("asset"), "date", ret.alias("ret")).filter("ret IS NOT NULL")


def factor_shocks(obs: DataFrame, registry: DataFrame, least: int = 24, window: int = 12, min_periods: int = 6) -> DataFrame:
    """factor, date, shock of the factors of a registry (name, series_id, how, scale).

    how: ``surprise``, the percentage change less its mean over the last window changes; ``diff``, the change.
    """
    d = _changed(obs, registry, least).filter("before IS NOT NULL")
    d = d.withColumn("change", F.when(F.col("how") == "surprise", 100 * (F.col("value") / F.nullif("before", F.lit(0.0)) - 1)).otherwise(F.col("value") - F.col("before")))
    w = Window.partitionBy("name").orderBy("date").rowsBetween(1 - window, 0)
    mean = F.when(F.count("change").over(w) >= min_periods, F.avg("change").over(w))
    shock = F.when(F.col("how") == "surprise", F.col("change") - mean).otherwise(F.col("change")) * F.col("scale")
    return d.select(F.col("name").alias("factor"), "date", shock.alias("shock")).filter("shock IS NOT NULL")


def pricing_panel(returns: DataFrame, shocks: DataFrame, factors: list[str]) -> DataFrame:
    """asset, date, ret and a column for each factor, on the dates that have all factors and all assets."""
    wide = shocks.groupBy("date").pivot("factor", factors).agg(F.first("shock")).dropna(subset=factors)
    held = returns.join(wide.hint("merge"), "date")
    assets = returns.select("asset").distinct().agg(F.count("*").alias("__all")).withColumn("__one", F.lit(1))
    whole = held.groupBy("date").agg(F.countDistinct("asset").alias("__n")).withColumn("__one", F.lit(1))
    whole = whole.join(F.broadcast(assets), "__one").filter("__n = __all").select("date")  # one row
    return held.join(whole.hint("merge"), "date", "left_semi")


def premia(panel: DataFrame, factors: list[str], splits: dict[str, Column] | None = None, least: int = 36, least_split: int = 24) -> DataFrame:
    """sample, n_obs, term, premium, se, t_shanken, n: Fama-MacBeth over all dates (sample ``full``) and over each split.

    splits: a condition on the panel for each name, whose rows are the sample of that name; samples overlap, and all are
    priced in one pass. Samples with fewer dates than least, or least_split, are left out.
    """
    named = F.array(F.lit("full"), *[F.when(F.coalesce(c, F.lit(False)), F.lit(name)) for name, c in (splits or {}).items()])
    d = panel.withColumn("sample", F.explode(F.array_compact(named)))
    months = d.groupBy("sample").agg(F.countDistinct("date").alias("n_obs"))
    months = months.filter(F.col("n_obs") >= F.when(F.col("sample") == "full", least).otherwise(least_split))
    fits = fama_macbeth(d.join(months.hint("merge"), "sample", "left_semi"), factors, min(least, least_split), ["sample"])
    return fits.filter("term <> 'const'").join(months.hint("merge"), "sample")


def differences(prices: DataFrame, comparisons: list[tuple[str, str]]) -> DataFrame:
    """comparison, term, premium_a, premium_b, diff, t_diff of the premia of two samples that do not overlap."""
    pairs = F.array(*[F.struct(F.lit(f"{a}_vs_{b}").alias("comparison"), F.lit(a).alias("a"), F.lit(b).alias("b")) for a, b in comparisons])
    each = prices.select(F.explode(pairs).alias("p"), "sample", "term", "premium", "se").filter("sample = p.a OR sample = p.b")
    side = lambda s, c: F.max(F.when(F.col("sample") == F.col(f"p.{s}"), F.col(c)))
    g = each.groupBy("p.comparison", "term").agg(side("a", "premium").alias("premium_a"), side("b", "premium").alias("premium_b"), side("a", "se").alias("sa"), side("b", "se").alias("sb"))
    both = F.sqrt(F.col("sa") * F.col("sa") + F.col("sb") * F.col("sb"))
    diff = F.col("premium_a") - F.col("premium_b")
    g = g.withColumns({"diff": diff, "t_diff": F.when(both >= 1e-10, diff / both)})
    return g.select("comparison", "term", "premium_a", "premium_b", "diff", "t_diff").filter("t_diff IS NOT NULL")


def factor_pricing(
    panel: DataFrame, factors: list[str], splits: dict[str, Column] | None = None, comparisons: list[tuple[str, str]] | None = None,
    t: float = 2.0, least: int = 36, least_split: int = 24,
) -> DataFrame:
    """Hits: the full sample, if a factor's corrected t is at least ``t``, and each comparison of two samples, if a
    difference's is. Evidence names these factors in order, with their premia, or differences, and t."""
    panel = written(panel, "panel")
    prices = written(premia(panel, factors, splits, least, least_split), "prices")
    end = panel.agg(F.max("date").alias("date")).withColumn("__one", F.lit(1))

    def hit(d: DataFrame, window: str, stat: str, value: str) -> DataFrame:
        strong = d.filter(F.abs(stat) >= t)
        listed = F.array_sort(F.collect_list(F.struct("term", F.round(value, 4).alias("premium"), F.round(stat, 3).alias("t"))))
        g = strong.groupBy(F.col(window).alias("window")).agg(F.max(F.abs(stat)).alias("max_t"), listed.alias("factors"))
        g = g.withColumn("__one", F.lit(1)).join(F.broadcast(end), "__one")  # one row
        g = g.withColumn("key", F.lit("factors"))
        out = hits(g, "cross_asset_factor", "key", F.least(F.col("max_t") / 4, F.lit(1.0)), F.col("date"), "", ["max_t", "factors", "window"])
        return out.withColumn("window", F.get_json_object("evidence", "$.window"))

    out = hit(prices.filter("sample = 'full'"), "sample", "t_shanken", "premium")
    return out.unionByName(hit(differences(prices, comparisons), "comparison", "t_diff", "diff")) if comparisons else out
