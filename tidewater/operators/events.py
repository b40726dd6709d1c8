"""Event and episode studies."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .align import nearest, within


def change_study(obs: DataFrame, events: DataFrame, pre: int = 1, post: int = 5, tolerance: int = 1) -> DataFrame:
    """series_id, lag, n, mean, std, cum_mean: one-row changes at the row nearest to each event date + lag."""
    w = Window.partitionBy("series_id").orderBy("date")
    change = obs.withColumn("value", F.col("value") - F.lag("value").over(w)).filter("value IS NOT NULL")
    at = events.select(F.col("date").alias("event"), F.explode(F.sequence(F.lit(-pre), F.lit(post))).alias("lag"))
    at = at.withColumn("event_date", F.date_add("event", F.col("lag")))
    hits = nearest(at, change, tolerance)
    g = hits.groupBy("series_id", "lag").agg(F.count("value").alias("n"), F.avg("value").alias("mean"), F.stddev_samp("value").alias("std"))
    run = Window.partitionBy("series_id").orderBy("lag").rowsBetween(Window.unboundedPreceding, 0)
    return g.withColumn("cum_mean", F.sum("mean").over(run))


def level_study(obs: DataFrame, events: DataFrame, pre: int = 5, post: int = 20) -> DataFrame:
    """series_id, offset, n, mean, median, p25, p75 of the daily filled path less its value at the event."""
    span = obs.groupBy("series_id").agg(F.min("date").alias("lo"), F.max("date").alias("hi"))
    grid = span.select("series_id", F.explode(F.sequence("lo", "hi")).alias("date"))
    run = Window.partitionBy("series_id").orderBy("date").rowsBetween(Window.unboundedPreceding, 0)
    path = grid.join(obs, ["series_id", "date"], "left").withColumn("value", F.last("value", ignorenulls=True).over(run))
    base = events.select(F.col("date").alias("event")).join(path.select("series_id", F.col("date").alias("event"), F.col("value").alias("base")), "event")
    at = base.withColumn("offset", F.explode(F.sequence(F.lit(-pre), F.lit(post)))).withColumn("date", F.date_add("event", F.col("offset")))
    d = at.join(path, ["series_id", "date"]).withColumn("move", F.col("value") - F.col("base"))
    q = lambda p: F.percentile("move", F.lit(p))
    return d.groupBy("series_id", "offset").agg(F.count("move").alias("n"), F.avg("move").alias("mean"), q(0.5).alias("median"), q(0.25).alias("p25"), q(0.75).alias("p75"))


def event_panel(obs: DataFrame, events: DataFrame, pre: int = 1, post: int = 1, tolerance: int = 3) -> DataFrame:
    """event, lag, series_id, actual_date, level, change: the row of each series nearest to each event date + lag."""
    w = Window.partitionBy("series_id").orderBy("date")
    d = obs.withColumn("change", F.col("value") - F.lag("value").over(w))
    at = events.select(F.col("date").alias("event"), F.explode(F.sequence(F.lit(-pre), F.lit(post))).alias("lag"))
    hit = nearest(at.withColumn("event_date", F.date_add("event", F.col("lag"))), d.select("series_id", "date", "value"), tolerance)
    j = hit.join(d.select("series_id", F.col("date").alias("actual_date"), "change"), ["series_id", "actual_date"])
    return j.select("event", "lag", "series_id", "actual_date", F.col("value").alias("level"), "change")


def runs_from_flag(flags: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """keys, start_date, end_date, n of each run of rows with flag 1."""
    keys = keys or ["series_id"]
    w = Window.partitionBy(*keys).orderBy("date")
    starts = F.coalesce((F.col("flag") != F.lag("flag").over(w)).cast("int"), F.lit(1))
    d = flags.withColumn("step", starts).withColumn("run", F.sum("step").over(w))
    return d.filter("flag = 1").groupBy(*keys, "run").agg(F.min("date").alias("start_date"), F.max("date").alias("end_date"), F.count("*").alias("n")).drop("run")


def threshold_episodes(obs: DataFrame, threshold: float, min_duration: int = 3, keys: list[str] | None = None) -> DataFrame:
    """keys, start_date, end_date, duration, peak, peak_date of each run of rows above a threshold."""
    keys = keys or ["series_id"]
    w = Window.partitionBy(*keys).orderBy("date")
    d = obs.filter("value IS NOT NULL").withColumn("above", (F.col("value") > threshold).cast("int"))
    d = d.withColumn("step", F.coalesce((F.col("above") != F.lag("above").over(w)).cast("int"), F.lit(1))).withColumn("run", F.sum("step").over(w))
    g = d.filter("above = 1").groupBy(*keys, "run").agg(
        F.min("date").alias("start_date"), F.max("date").alias("end_date"), F.count("*").alias("duration"), F.max("value").alias("peak"),
        F.max_by("date", F.struct("value", -F.datediff("date", F.lit("1970-01-01").cast("date")))).alias("peak_date"),
    )
    return g.filter(F.col("duration") >= min_duration).drop("run")


def episode_drivers(episodes: DataFrame, support: DataFrame, move: float = 0.5) -> DataFrame:
    """episodes with driver: whether a second series rose, fell or was flat over the episode, joined by month."""
    month = lambda c: F.trunc(c, "MM")
    s = support.groupBy(month("date").alias("m")).agg(F.max_by("value", "date").alias("v"))
    j = episodes.withColumns({"m0": month("start_date"), "m1": month("end_date")})
    j = j.join(s.select(F.col("m").alias("m0"), F.col("v").alias("v0")), "m0", "left").join(s.select(F.col("m").alias("m1"), F.col("v").alias("v1")), "m1", "left")
    change = F.col("v1") - F.col("v0")
    driver = F.when(change > move, "rising").when(change < -move, "falling").when(change.isNotNull(), "flat").otherwise("unknown")
    return j.withColumns({"support_change": change, "driver": driver}).drop("m0", "m1", "v0", "v1")


def episode_real_rates(episodes: DataFrame, obs: DataFrame, policy: DataFrame) -> DataFrame:
    """episodes with min_real_rate: the least policy rate less the series' own value in the months of the episode; NULL
    without a month that has both."""
    month = F.trunc("date", "MM")
    last = lambda d, *by: d.filter("value IS NOT NULL").groupBy(*by, month.alias("m")).agg(F.max_by("value", "date").alias("v"))
    real = last(obs, "series_id").join(last(policy).withColumnRenamed("v", "p").hint("merge"), "m").select("series_id", "m", (F.col("p") - F.col("v")).alias("real"))
    own = episodes.select("series_id", "start_date", "end_date").join(real.hint("merge"), "series_id")
    own = own.filter((F.col("m") >= F.trunc("start_date", "MM")) & (F.col("m") <= F.col("end_date")))
    low = own.groupBy("series_id", "start_date").agg(F.min("real").alias("min_real_rate"))
    return episodes.join(low.hint("merge"), ["series_id", "start_date"], "left")


def driver_counts(episodes: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """keys, driver, n, share of the episodes by their driver."""
    keys = keys or ["series_id"]
    g = episodes.groupBy(*keys, "driver").agg(F.count("*").alias("n"))
    return g.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy(*keys)))


def current_episode(episodes: DataFrame, as_of: str, months: int = 6) -> DataFrame:
    """The last episode of each series, if it ended within so many months before as_of."""
    w = Window.partitionBy("series_id").orderBy(F.desc("end_date"))
    last = episodes.withColumn("__n", F.row_number().over(w)).filter("__n = 1").drop("__n")
    return last.filter(F.col("end_date") >= F.add_months(F.lit(as_of).cast("date"), -months))


def episode_distribution(episodes: DataFrame, measures: list[str], keys: list[str]) -> DataFrame:
    """keys, measure, n, median, p25, p75, max."""
    long = episodes.select(*keys, F.explode(F.array(*[F.struct(F.lit(m).alias("measure"), F.col(m).cast("double").alias("x")) for m in measures])).alias("e"))
    q = lambda p: F.percentile("e.x", F.lit(p))
    return long.groupBy(*keys, F.col("e.measure").alias("measure")).agg(F.count("e.x").alias("n"), q(0.5).alias("median"), q(0.25).alias("p25"), q(0.75).alias("p75"), F.max("e.x").alias("max"))


def compare_to_episodes(obs: DataFrame, intervals: DataFrame) -> DataFrame:
    """name, series_id, n, mean, min, max inside each window, and the latest value less the mean; empty ones stay."""
    inside = within(obs, intervals).groupBy("name", "series_id").agg(F.count("value").alias("n"), F.avg("value").alias("mean"), F.min("value").alias("min"), F.max("value").alias("max"))
    now = obs.groupBy("series_id").agg(F.max_by("value", "date").alias("latest"))
    names = intervals.agg(F.collect_set("name").alias("names"))  # a short list of named windows
    every = now.withColumn("one", F.lit(1)).join(F.broadcast(names.withColumn("one", F.lit(1))), "one").withColumn("name", F.explode("names"))
    j = every.join(inside, ["name", "series_id"], "left")
    return j.select("name", "series_id", F.coalesce("n", F.lit(0).cast("bigint")).alias("n"), "mean", "min", "max", (F.col("latest") - F.col("mean")).alias("now_less_mean"))


def in_interval(obs: DataFrame, intervals: DataFrame) -> DataFrame:
    """obs with inside: whether the date lies in any of the intervals."""
    dates = within(obs.select("date").distinct(), intervals).select("date").distinct().withColumn("__in", F.lit(True))
    return obs.join(dates, "date", "left").withColumn("inside", F.coalesce("__in", F.lit(False))).drop("__in")


def meeting_panel(panel: DataFrame, timing: str, path: str, tolerance: float = 0.05) -> DataFrame:
    """event, timing, path (less timing), direction of the surprises on the day, from event_panel() rows."""
    day = panel.filter("lag = 0").groupBy("event").agg(F.max(F.when(F.col("series_id") == timing, F.col("change"))).alias("timing"), F.max(F.when(F.col("series_id") == path, F.col("change"))).alias("other"))
    t = F.col("timing")
    kind = F.when(t > tolerance, "tightening").when(t < -tolerance, "easing").when(t.isNotNull(), "on_hold")
    return day.select("event", "timing", (F.col("other") - t).alias("path"), kind.alias("direction"))


def era_share(meetings: DataFrame, eras: DataFrame, least: int = 5) -> DataFrame:
    """name, n, path_share: mean absolute path surprise as a share of that and the timing surprise."""
    d = within(meetings.withColumnRenamed("event", "date").dropna(subset=["timing", "path"]), eras)
    p, t = F.avg(F.abs("path")), F.avg(F.abs("timing"))
    return d.groupBy("name").agg(F.count("*").alias("n"), (p / F.nullif(p + t, F.lit(0.0))).alias("path_share")).filter(F.col("n") >= least)
