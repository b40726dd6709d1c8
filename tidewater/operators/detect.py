"""Rule-based detectors over all series or pairs at once.

Each gives hits: kind, key, window, score, date, evidence (a JSON string).
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.stored import written
from .align import downsample, infer_frequency, returns
from .breaks import regime_stats, regimes, structural_breaks
from .regression import engle_granger
from .series import _scale, corr_stability, latest_stats, lead_lag, peak_lag, rolling_corr, tail

def hits(df: DataFrame, kind: str | Column, key: str, score: Column, date: Column, window: str, evidence: list[str]) -> DataFrame:
    return df.select(
        (F.lit(kind) if isinstance(kind, str) else kind).alias("kind"), F.col(key).alias("key"), F.lit(window).alias("window"),
        score.cast("double").alias("score"), date.cast("date").alias("date"), F.to_json(F.struct(*evidence)).alias("evidence"),
    )


def notable_move(obs: DataFrame, least: int = 60, tails: float = 0.01, z: float = 2.5, prefix: str = "notable_move", bonus: float = 0.0) -> DataFrame:
    """Levels in the tails of their history, and last changes of at least z robust deviations."""
    s = latest_stats(obs).filter(F.col("n") >= least)
    level = s.filter((F.col("percentile") <= tails) | (F.col("percentile") >= 1 - tails))
    c = latest_stats(returns(obs, "diff"), robust=True).filter((F.col("n") >= least - 1) & (F.abs("z") >= z))
    return hits(level, f"{prefix}_level", "series_id", 2 * F.abs(F.col("percentile") - 0.5) + bonus, F.col("date"), "full", ["value", "percentile", "n"]).unionByName(
        hits(c, f"{prefix}_change", "series_id", F.abs("z") + bonus, F.col("date"), "full", ["value", "z", "n"])
    )


def _diffs(pairs: DataFrame) -> DataFrame:
    w = Window.partitionBy("pair_id").orderBy("date")
    return pairs.dropna(subset=["a", "b"]).withColumns({c: F.col(c) - F.lag(c).over(w) for c in "ab"}).dropna(subset=["a", "b"])


def correlation_shift(pairs: DataFrame, window: int, move: float = 0.4, spread: float = 0.5, least: float = 0.25, cross: float = 0.2) -> DataFrame:
    """Pairs whose recent rolling correlation left a stable full-sample one; first and last crossing dates."""
    d = _diffs(pairs)
    n = d.groupBy("pair_id").agg(F.count("*").alias("n")).filter(F.col("n") >= 2 * window)
    d = d.join(n, "pair_id", "left_semi")
    r = rolling_corr(d, window, "spearman").filter("correlation IS NOT NULL")
    j = r.join(corr_stability(d), "pair_id")
    off = F.abs(F.col("correlation") - F.col("full_corr")) >= cross
    w = Window.partitionBy("pair_id").orderBy("date")
    j = j.withColumn("off", off).withColumn("turn", F.col("off") & ~F.coalesce(F.lag("off").over(w), F.lit(False)))
    g = j.groupBy("pair_id").agg(
        F.max("date").alias("date"), F.max_by("correlation", "date").alias("recent"), F.first("full_corr").alias("full_corr"), F.first("spread").alias("spread"),
        F.min(F.when(F.col("turn"), F.col("date"))).alias("first_crossing"), F.max(F.when(F.col("turn"), F.col("date"))).alias("last_crossing"),
    )
    shift = F.abs(F.col("recent") - F.col("full_corr"))
    g = g.filter((shift >= move) & (F.col("spread") <= spread) & (F.greatest(F.abs("recent"), F.abs("full_corr")) >= least))
    return hits(g, "correlation_shift", "pair_id", shift, F.col("date"), str(window), ["recent", "full_corr", "spread", "first_crossing", "last_crossing"])


def lead_lag_change(pairs: DataFrame, max_lag: int, recent: int, shift: int = 1, move: float = 0.3, least: float = 0.25) -> DataFrame:
    """Pairs whose best lag, or its correlation, differs between the history and the last rows."""
    d = _diffs(pairs)
    back = F.row_number().over(Window.partitionBy("pair_id").orderBy(F.desc("date")))
    n = F.count("*").over(Window.partitionBy("pair_id"))
    d = d.withColumns({"back": back, "n": n}).filter((F.col("n") >= 4 * recent) & (F.lit(recent) >= 4 * max_lag))
    old = peak_lag(lead_lag(d.filter(F.col("back") > recent), max_lag)).withColumnsRenamed({"lag": "lag0", "correlation": "c0"})
    new = peak_lag(lead_lag(d.filter(F.col("back") <= recent), max_lag)).withColumnsRenamed({"lag": "lag1", "correlation": "c1"})
    j = old.join(new, "pair_id").join(d.groupBy("pair_id").agg(F.max("date").alias("date")), "pair_id")
    fires = ((F.abs(F.col("lag1") - F.col("lag0")) >= shift) | (F.abs(F.col("c1") - F.col("c0")) >= move)) & (F.greatest(F.abs("c0"), F.abs("c1")) >= least)
    return hits(j.filter(fires), "lead_lag_change", "pair_id", F.abs(F.col("c1") - F.col("c0")) + F.abs(F.col("lag1") - F.col("lag0")) / max_lag, F.col("date"), str(recent), ["lag0", "c0", "lag1", "c1"])


def regime_transition(regimes: DataFrame, within_days: int = 90, least: int = 100) -> DataFrame:
    """Series whose label changed within the last days; the score is how long the label before had held."""
    w = Window.partitionBy("series_id").orderBy("date")
    d = regimes.filter("regime IS NOT NULL").withColumn("step", F.coalesce((F.col("regime") != F.lag("regime").over(w)).cast("int"), F.lit(1)))
    d = d.withColumn("run", F.sum("step").over(w))
    runs = d.groupBy("series_id", "run").agg(F.min("date").alias("since"), F.max("date").alias("until"), F.first("regime").alias("regime"), F.count("*").alias("rows"))
    by_run = Window.partitionBy("series_id").orderBy("run")
    runs = runs.withColumns({
        "before": F.lag("regime").over(by_run), "held": F.datediff(F.lag("until").over(by_run), F.lag("since").over(by_run)),
        "total": F.sum("rows").over(Window.partitionBy("series_id")), "last": F.max("run").over(Window.partitionBy("series_id")),
        "now": F.max("until").over(Window.partitionBy("series_id")),
    })
    f = runs.filter((F.col("run") == F.col("last")) & (F.col("run") > 1) & (F.col("total") >= least) & (F.datediff("now", "since") <= within_days))
    return hits(f, "regime_transition", "series_id", F.col("held") / 365, F.col("since"), "full", ["before", "regime", "held"])


def structural_break(
    obs: DataFrame, shift: float = 0.5, years: float = 15.0, max_breaks: int = 5, min_segment: int | None = None, least_move: float = 0.0,
    prefix: str = "structural_break", resample: str | None = None,
) -> DataFrame:
    """Series whose last break by BIC is recent enough and moves the mean by ``shift`` deviations of the series and by
    least_move in its own units, at least. The date is that of the break."""
    b = written(structural_breaks(obs, max_breaks, min_segment, resample=resample).filter("best AND k >= 1"), "breaks")
    stats = regime_stats(regimes(obs, b))
    by = Window.partitionBy("series_id").orderBy("regime")
    stats = stats.withColumns({"before": F.lag("mean").over(by), "move": F.col("mean") - F.lag("mean").over(by)})
    last = stats.join(b.select("series_id", "k", "break_dates").hint("merge"), "series_id").filter(F.col("regime") == F.col("k"))
    std = obs.groupBy("series_id").agg(F.stddev_samp("value").alias("__std"))
    f = last.join(std.hint("merge"), "series_id").withColumns({
        "age_years": F.datediff("until", F.element_at("break_dates", -1)) / 365.25, "size": F.abs("move") / F.coalesce(F.nullif("__std", F.lit(0.0)), F.lit(1.0)),
        "break_dates": F.array_join(F.col("break_dates").cast("array<string>"), ","),
    })
    f = f.filter((F.col("age_years") <= years) & (F.col("size") >= shift) & (F.abs("move") >= least_move))
    score = F.col("size") * F.greatest(F.lit(0.2), 1 - F.col("age_years") / years)
    return hits(f, prefix, "series_id", score, F.col("since"), "full", ["k", "break_dates", "before", "mean", "move", "age_years"])


def cointegration_break(pairs: DataFrame, recent: int = 50) -> DataFrame:
    """Pairs cointegrated at 5 % over all rows but not over the last ones."""
    back = F.row_number().over(Window.partitionBy("pair_id").orderBy(F.desc("date")))
    n = F.count("*").over(Window.partitionBy("pair_id"))
    d = pairs.dropna(subset=["a", "b"]).withColumns({"back": back, "n": n}).filter(F.col("n") >= 2 * recent)
    full, new = engle_granger(d.drop("n")), engle_granger(d.drop("n").filter(F.col("back") <= recent))
    j = full.filter("cointegrated").select("pair_id", F.col("statistic").alias("full_stat")).join(new.filter("NOT cointegrated").select("pair_id", F.col("statistic").alias("recent_stat")), "pair_id")
    j = j.join(d.groupBy("pair_id").agg(F.max("date").alias("date")), "pair_id")
    return hits(j, "cointegration_break", "pair_id", F.abs(F.col("recent_stat") - F.col("full_stat")), F.col("date"), str(recent), ["full_stat", "recent_stat"])


def episode_anomaly(episodes: DataFrame, least: int = 4) -> DataFrame:
    """Last episodes that are longer, or higher, than the 75th percentile of the ones before."""
    w = Window.partitionBy("series_id")
    d = episodes.withColumn("last", F.col("start_date") == F.max("start_date").over(w))
    past = d.filter("NOT last").groupBy("series_id").agg(F.count("*").alias("n"), F.percentile("duration", F.lit(0.75)).alias("d75"), F.percentile("peak", F.lit(0.75)).alias("p75"), F.collect_list("duration").alias("durations"))
    j = d.filter("last").join(past.filter(F.col("n") >= least), "series_id")
    share = F.size(F.filter("durations", lambda x: x < F.col("duration"))) / F.col("n")
    f = j.filter((F.col("duration") >= F.col("d75")) | (F.col("peak") >= F.col("p75")))
    return hits(f, "episode_anomaly", "series_id", share, F.col("start_date"), "episodes", ["duration", "peak", "d75", "p75", "n"])


def robust_z_signal(obs: DataFrame, z: float = 2.0, least: int = 60) -> DataFrame:
    s = latest_stats(obs, robust=True).filter((F.col("n") >= least) & (F.abs("z") >= z))
    return hits(s, "robust_z_signal", "series_id", F.abs("z"), F.col("date"), "full", ["value", "z", "n"])


def factor_extreme(factors: DataFrame, least: int = 36, tails: float = 0.1) -> DataFrame:
    """Curve factors (series_id: level, slope or curvature) in the tails of their own history."""
    s = latest_stats(factors).filter((F.col("n") >= least) & ((F.col("percentile") <= tails) | (F.col("percentile") >= 1 - tails)))
    return hits(s, "factor_extreme", "series_id", F.least(F.abs("z") / 3, F.lit(1.0)), F.col("date"), "full", ["value", "z", "percentile"])


def curve_extreme(factors: DataFrame, least: int = 36, tails: float = 0.1, curve: str = "curve") -> DataFrame:
    """One hit for the curve, if any of its factors (see factor_extreme) is in the tails of its history; the score is that
    of the largest deviation of all of them."""
    s = latest_stats(factors).filter(F.col("n") >= least)
    extreme = (F.col("percentile") <= tails) | (F.col("percentile") >= 1 - tails)
    what = F.array_sort(F.collect_list(F.when(extreme, F.col("series_id"))))
    each = F.array_sort(F.collect_list(F.struct("series_id", F.round("value", 4).alias("value"), F.round("percentile", 3).alias("percentile"), F.round("z", 3).alias("z"))))
    g = s.groupBy(F.lit(curve).alias("key")).agg(F.max("date").alias("date"), F.max(F.abs("z")).alias("max_z"), what.alias("extremes"), each.alias("factors"), F.max("n").alias("n"))
    return hits(g.filter(F.size("extremes") > 0), "curve_factor_extreme", "key", F.least(F.col("max_z") / 3, F.lit(1.0)), F.col("date"), "full", ["max_z", "extremes", "factors", "n"])


def correlation_breaks(pairs: DataFrame, window: int, least_move: float = 0.2, least: int = 24, years: float = 15.0) -> DataFrame:
    """Breaks in the level of a pair's rolling rank correlation of changes, by months; pairs with twice the window's rows and
    ``least`` correlations."""
    d = _diffs(pairs)
    n = d.groupBy("pair_id").agg(F.count("*").alias("n")).filter(F.col("n") >= 2 * window)
    r = rolling_corr(d.join(n.hint("merge"), "pair_id", "left_semi"), window, "spearman").filter("correlation IS NOT NULL")
    long = r.groupBy("pair_id").agg(F.count("*").alias("n")).filter(F.col("n") >= least)
    r = r.join(long.hint("merge"), "pair_id", "left_semi")
    monthly = downsample(r.select(F.col("pair_id").alias("series_id"), "date", F.col("correlation").alias("value")), "M", "mean")
    found = structural_break(monthly, 0.0, years, least_move=least_move, prefix="correlation_break")
    return found.withColumn("window", F.lit(str(window)))


def curve_signal(cp: DataFrame, z: float = 1.75, least: int = 60) -> DataFrame:
    """The robust z signal of the curve's return factor (series_id, date, value)."""
    return robust_z_signal(cp, z, least).withColumn("kind", F.lit("curve_signal"))


def level_regime_cross(obs: DataFrame, cuts: list[tuple[float, str]], otherwise: str, stressed: list[str], back: int = 3) -> DataFrame:
    """Levels that are in a stressed regime, or whose regime differs from some rows ago."""
    from .curve import regime_of

    w = Window.partitionBy("series_id").orderBy("date")
    d = obs.withColumn("regime", regime_of(F.col("value"), cuts, otherwise)).withColumn("before", F.lag("regime", back).over(w))
    last = d.withColumn("__n", F.row_number().over(Window.partitionBy("series_id").orderBy(F.desc("date")))).filter("__n = 1")
    j = last.join(latest_stats(obs).select("series_id", "z", "percentile"), "series_id")
    crossed = F.coalesce(F.col("regime") != F.col("before"), F.lit(False))
    f = j.filter(F.col("regime").isin(stressed) | crossed)
    return hits(f, "level_regime_cross", "series_id", F.least(F.abs("z") / 3, F.lit(1.0)) + F.when(crossed, 0.15).otherwise(0.0), F.col("date"), "full", ["value", "regime", "before", "z"])


def spread_extreme(pairs: DataFrame, least: int = 60, tails: float = 0.03, z: float = 2.5) -> DataFrame:
    """Extreme levels, changes and breaks of a - b."""
    s = pairs.select(F.col("pair_id").alias("series_id"), "date", (F.col("a") - F.col("b")).alias("value")).dropna()
    return notable_move(s, least, tails, z, prefix="spread_extreme", bonus=1.0).unionByName(structural_break(s, 0.3, prefix="spread_break"))


def decomposition_shift(parts: DataFrame, move: float = 0.2, days: int = 90) -> DataFrame:
    """Parts whose share of the total's changes moved between the history and the last rows.

    parts: series_id, date, value, total. Changes count where the total's change is above its 33rd percentile.
    """
    w = Window.partitionBy("series_id").orderBy("date")
    gap = infer_frequency(parts.select("series_id", "date")).select("series_id", "median_gap")
    d = parts.withColumns({c: F.col(c) - F.lag(c).over(w) for c in ("value", "total")}).dropna(subset=["value", "total"])
    back = F.row_number().over(Window.partitionBy("series_id").orderBy(F.desc("date")))
    d = d.withColumn("back", back).join(gap, "series_id")
    rows = F.greatest(F.floor(F.lit(days) / F.col("median_gap")), F.lit(10))
    d = d.withColumn("slice", F.when(F.col("back") <= rows, "recent").otherwise("history"))
    cut = d.groupBy("series_id", "slice").agg(F.percentile(F.abs("total"), F.lit(0.33)).alias("cut"))
    share = F.least(F.greatest(F.col("value") / F.nullif("total", F.lit(0.0)), F.lit(-2.0)), F.lit(2.0))
    g = d.join(cut, ["series_id", "slice"]).filter(F.abs("total") > F.col("cut")).groupBy("series_id", "slice").agg(F.avg(share).alias("share"), F.count("*").alias("n"), F.max("date").alias("date"))
    g = g.filter("n >= 5")
    p = g.groupBy("series_id").agg(F.max(F.when(F.col("slice") == "recent", F.col("share"))).alias("recent"), F.max(F.when(F.col("slice") == "history", F.col("share"))).alias("history"), F.max("date").alias("date"))
    size = F.abs(F.col("recent") - F.col("history"))
    return hits(p.filter(size >= move), "decomposition_shift", "series_id", size / move * 3, F.col("date"), "recent", ["recent", "history"])


def scan(
    obs: DataFrame, pairs: DataFrame, factors: DataFrame | None = None, parts: DataFrame | None = None, episodes: DataFrame | None = None,
    levels: tuple[DataFrame, list[tuple[float, str]], str, list[str]] | None = None, cp: DataFrame | None = None, priced: DataFrame | None = None,
    windows: tuple[int, int] = (36, 252), lags: tuple[tuple[int, int], tuple[int, int]] = ((6, 24), (60, 252)), least: int = 60,
) -> DataFrame:
    """Hits of the detectors as one table; those of curve factors, parts of a total, episodes, regimes of levels and the curve's
    return factor (see curve_extreme, decomposition_shift, episode_anomaly, level_regime_cross, curve_signal) where
    their input is given. priced: hits of pricing.factor_pricing to go with them.

    windows, and lags with recent rows, are those of pairs that are monthly or rarer, and of daily and weekly ones.
    All inputs are written once and read by all, so that what they are derived from is read once.
    """
    from .series import quantile_regime

    obs, pairs = written(obs, "obs"), written(pairs, "pairs")
    factors, parts, episodes, cp, priced = (None if d is None else written(d, "given") for d in (factors, parts, episodes, cp, priced))
    levels = levels and (written(levels[0], "levels"), *levels[1:])
    often = infer_frequency(pairs.dropna(subset=["a", "b"]), ["pair_id"]).filter("is_daily").select("pair_id")
    found = [notable_move(obs, least=least), regime_transition(quantile_regime(obs, [0.33, 0.67], ["low", "mid", "high"])), structural_break(obs), robust_z_signal(obs, least=least), spread_extreme(pairs, least=least), cointegration_break(pairs)]
    for how, window, (most, recent) in zip(("left_anti", "left_semi"), windows, lags, strict=True):
        own = pairs.join(often.hint("merge"), "pair_id", how)
        found += [correlation_shift(own, window), lead_lag_change(own, most, recent), correlation_breaks(own, window)]
    if factors is not None:
        found.append(curve_extreme(factors))
    if parts is not None:
        found.append(decomposition_shift(parts))
    if episodes is not None:
        found.append(episode_anomaly(episodes))
    if levels is not None:
        found.append(level_regime_cross(*levels))
    if cp is not None:
        found.append(curve_signal(cp))
    if priced is not None:
        found.append(priced)
    return reduce(DataFrame.unionByName, found)


def follow_through(
    found: DataFrame, snapshot: DataFrame, triggers: DataFrame, created: Column, known_findings: DataFrame | None = None, known_seeds: DataFrame | None = None, label: str = "hits"
) -> dict[str, DataFrame]:
    """What a scan leads to, from hits that are written once: hits, follow_ups, findings, seeds and stats.

    stats: kind, window, n, top_score, last of the hits.
    """
    found = written(found, label)
    stats = found.groupBy("kind", "window").agg(F.count("*").alias("n"), F.max("score").alias("top_score"), F.max("date").alias("last"))
    return {
        "hits": found, "follow_ups": follow_ups(found, triggers), "findings": findings(found, known_findings),
        "seeds": seeds(found, snapshot, created, known=known_seeds), "stats": stats,
    }


def skipped(obs: DataFrame, least: int = 60) -> DataFrame:
    """key, reason of series that are too short or do not vary."""
    g = obs.groupBy("series_id").agg(F.count("value").alias("n"), F.min("value").alias("lo"), F.max("value").alias("hi"))
    reason = F.when(F.col("n") < least, F.concat(F.lit("only "), F.col("n"), F.lit(" rows"))).when(F.col("lo") == F.col("hi"), "constant")
    return g.select(F.col("series_id").alias("key"), reason.alias("reason")).filter("reason IS NOT NULL")


def follow_ups(found: DataFrame, triggers: DataFrame) -> DataFrame:
    """question, priority, raised_by of the questions that hits raise; triggers: question, kind, key, priority (NULL: any).

    Hits are counted by kind and key first; each of the four forms of a trigger then is a join on what it names.
    """
    h = found.groupBy("kind", "key").agg(F.count("*").alias("n"))
    parts = []
    for named in (["kind", "key"], ["kind"], ["key"], []):
        of = triggers
        for c in ("kind", "key"):
            of = of.filter(F.col(c).isNotNull() if c in named else F.col(c).isNull())
        of = of.select("question", "priority", *named, F.lit(1).alias("__any"))
        n = h.groupBy(*named, F.lit(1).alias("__any")).agg(F.sum("n").alias("n"))
        parts.append(of.join(n.hint("merge"), [*named, "__any"]).select("question", "priority", "n"))
    return reduce(DataFrame.unionByName, parts).groupBy("question").agg(F.min("priority").alias("priority"), F.sum("n").alias("raised_by"))


def slug(*parts: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.lower(F.concat_ws("-", *parts)), "[^a-z0-9]+", "-"), "^-|-$", "")


def findings(found: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """slug, title, kind, key, discovered, claim, score of hits; those with a known slug are left out."""
    title = F.concat(F.initcap(F.replace(F.col("kind"), F.lit("_"), F.lit(" "))), F.lit(": "), F.col("key"))
    claim = F.format_string("%s on %s over window %s, score %.2f.", F.replace(F.col("kind"), F.lit("_"), F.lit(" ")), F.col("key"), F.col("window"), F.col("score"))
    f = found.select(slug(F.col("kind"), F.col("key"), F.date_format("date", "yyyy-MM-dd")).alias("slug"), title.alias("title"), "kind", "key", F.col("date").alias("discovered"), claim.alias("claim"), "score")
    w = Window.partitionBy("slug").orderBy(F.desc("score"))
    f = f.withColumn("__n", F.row_number().over(w)).filter("__n = 1").drop("__n")
    return f if known is None else f.join(known.select("slug"), "slug", "left_anti")


def robust_scale(obs: DataFrame, lookback: int | None = None) -> DataFrame:
    """series_id, center, scale: median and scaled MAD over the last rows."""
    return _scale(tail(obs, lookback, ["series_id"]), ["series_id"], True)


def seeds(found: DataFrame, snapshot: DataFrame, created: Column, days: int = 7, known: DataFrame | None = None) -> DataFrame:
    """id, detector, key, key_stats (map of the series' snapshot), priority_score, created, expires, used of hits.

    One seed for each kind, key and day of creation; seeds whose id is known are left out.
    """
    stats = snapshot.select(F.col("series_id").alias("key"), F.map_from_arrays(F.array(F.col("series_id")), F.array(F.struct("value", "date", "z_full", "pct_10y"))).alias("key_stats"))
    best = found.groupBy("kind", "key").agg(F.max("score").alias("priority_score"))
    out = best.join(stats, "key", "left").select(
        slug(F.col("kind"), F.col("key"), F.date_format(created, "yyyy-MM-dd")).alias("id"), F.col("kind").alias("detector"), "key", "key_stats",
        "priority_score", created.alias("created"), F.date_add(created, days).alias("expires"), F.lit(False).alias("used"),
    )
    return out if known is None else out.join(known.select("id"), "id", "left_anti")


def mark_used(stored: DataFrame, ids: DataFrame) -> DataFrame:
    """stored seeds with those of ids used."""
    hit = ids.select("id").distinct().withColumn("__hit", F.lit(True))
    return stored.join(hit, "id", "left").withColumn("used", F.col("used") | F.coalesce("__hit", F.lit(False))).drop("__hit")
