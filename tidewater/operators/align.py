"""Alignment of series of different frequency, and joins on dates.

Inputs are long tables (series_id, date, value); a missing value is NULL. Every operator works on all series
at once, partitioned by its keys.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Frequencies from coarse to fine; the place in the list is the rank.
FREQUENCIES = ["A", "SA", "Q", "M", "BW", "W", "D"]
#: Any Friday, from which two-week buckets are counted.
ANCHOR_FRIDAY = "1970-01-02"


def bucket(date: Column, freq: str) -> Column:
    """Label of the period of a date: week ends on Friday, other periods start at their first day."""
    friday = F.next_day(F.date_sub(date, 1), "FRI")
    if freq == "D":
        return date
    if freq == "W":
        return friday
    if freq == "BW":
        odd = F.pmod(F.datediff(friday, F.lit(ANCHOR_FRIDAY).cast("date")), F.lit(14)) == 7
        return F.when(odd, F.date_add(friday, 7)).otherwise(friday)
    if freq == "SA":
        first = F.trunc(date, "YEAR")
        return F.when(F.month(date) > 6, F.add_months(first, 6)).otherwise(first)
    return F.trunc(date, {"M": "MM", "Q": "QUARTER", "A": "YEAR"}[freq])


def anchored_bucket(date: Column, freq: str, first: Column) -> Column:
    """Label of the period of a date where periods of two weeks, or two quarters, are counted from that of ``first``, the
    first date of a series; other frequencies as bucket() has them."""
    if freq == "BW":
        start = bucket(first, "W")
        return F.date_add(start, (14 * F.ceil(F.datediff(bucket(date, "W"), start) / 14)).cast("int"))
    if freq == "SA":
        start, now = bucket(first, "Q"), bucket(date, "Q")
        quarters = (F.year(now) - F.year(start)) * 4 + F.quarter(now) - F.quarter(start)
        return F.add_months(start, (6 * F.floor(quarters / 2)).cast("int"))
    return bucket(date, freq)


def downsample(obs: DataFrame, freq: str, agg: str = "last", keys: list[str] | None = None, anchored: bool = False) -> DataFrame:
    """One row for each key and period: the last non-null value, or the mean.

    anchored: periods of two weeks or two quarters are counted from each key's first value instead of the calendar.
    """
    keys = keys or ["series_id"]
    value = F.max_by("value", "date") if agg == "last" else F.avg("value")
    filled = obs.filter(F.col("value").isNotNull())
    if anchored and freq in ("BW", "SA"):
        first = filled.groupBy(*keys).agg(F.min("date").alias("__first"))
        filled = filled.join(first.hint("merge"), keys)
        label = anchored_bucket(F.col("date"), freq, F.col("__first"))
    else:
        label = bucket(F.col("date"), freq)
    return filled.groupBy(*keys, label.alias("date")).agg(value.alias("value"))


def upsample_daily(obs: DataFrame, keys: list[str] | None = None, business: bool = True, strict_grid: bool = False) -> DataFrame:
    """Daily rows from the first to the last date of a key, each with the last value at or before it.

    strict_grid: only values dated on a grid day count, so that those of weekends are lost.
    """
    keys = keys or ["series_id"]
    span = obs.groupBy(*keys).agg(F.min("date").alias("lo"), F.max("date").alias("hi"))
    grid = span.select(*keys, F.explode(F.sequence("lo", "hi")).alias("date"))
    grid = grid.filter(F.weekday("date") < 5) if business else grid
    grid = grid.withColumns({"value": F.lit(None).cast("double"), "on": F.lit(1)})
    both = grid.unionByName(obs.select(*keys, "date", "value").withColumn("on", F.lit(0)))
    if strict_grid:
        both = both.filter((F.weekday("date") < 5) | (F.col("on") == 1))
    order = Window.partitionBy(*keys).orderBy("date", "on")
    last = F.last("value", ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, 0))
    return both.withColumn("value", last).filter("on = 1").drop("on")


#: Time between the labels of a frequency's periods.
STEPS = {"A": "1 year", "SA": "6 months", "Q": "3 months", "M": "1 month", "BW": "14 days", "W": "7 days", "D": "1 day"}


def align(obs: DataFrame, how: str = "coarsest", agg: str = "last", ffill: bool = True, dropna: str = "none") -> DataFrame:
    """All series of a panel_id at its coarsest or finest frequency; obs has panel_id and freq as well.

    Rows are long. With "finest", a series that is coarser has a row for every period of the panel's frequency between
    its first and its last; with ffill, each series also has one for every other date of its panel after its first; both
    hold the last value before (without ffill: none). dropna "any" keeps the dates for which all series of the panel have
    a value, "all" those for which any has, "none" all.
    """
    rank = F.array_position(F.array(*[F.lit(f) for f in FREQUENCIES]), F.col("freq"))
    ranked = obs.withColumn("rank", rank)
    best = (F.min if how == "coarsest" else F.max)("rank")
    panel = ranked.groupBy("panel_id").agg(best.alias("best"))
    joined = ranked.join(panel.hint("merge"), "panel_id")
    label = F.lit(None).cast("date")
    for i, f in enumerate(FREQUENCIES, 1):
        label = F.when(F.col("best") == i, bucket(F.col("date"), f)).otherwise(label)
    value = F.max_by("value", "date") if agg == "last" else F.avg("value")
    labelled = joined.filter(F.col("value").isNotNull()).withColumn("label", label)
    full = labelled.groupBy("panel_id", "series_id", F.col("label").alias("date"), "rank", "best").agg(value.alias("value"))
    if how == "finest":
        every = Window.partitionBy("panel_id", "series_id").orderBy("date")
        upto = F.when(F.col("rank") < F.col("best"), F.date_sub(F.lead("date").over(every), 1))  # of coarser series: until the next
        periods = F.lit(None).cast("array<date>")
        for i, f in enumerate(FREQUENCIES, 1):
            periods = F.when(F.col("best") == i, F.sequence("date", "upto", F.expr(f"INTERVAL {STEPS[f]}"))).otherwise(periods)
        full = full.withColumn("upto", F.coalesce(upto, F.col("date"))).withColumn("at", F.explode(periods))
        held = F.when(F.lit(ffill) | (F.col("at") == F.col("date")), F.col("value"))
        full = full.select("panel_id", "series_id", F.col("at").alias("date"), held.alias("value"))
        if ffill:
            since = full.groupBy("panel_id", "series_id").agg(F.min("date").alias("since"))
            dates = full.select("panel_id", "date").distinct()
            grid = dates.join(since.hint("merge"), "panel_id").filter("date >= since").drop("since")
            full = grid.join(full.hint("merge"), ["panel_id", "series_id", "date"], "left")
            full = full.withColumn("value", F.last("value", ignorenulls=True).over(every.rowsBetween(Window.unboundedPreceding, 0)))
    full = full.select("panel_id", "series_id", "date", "value")
    if dropna == "none":
        return full
    if dropna == "all":
        some = full.filter("value IS NOT NULL").select("panel_id", "date").distinct()
        return full.join(some.hint("merge"), ["panel_id", "date"], "left_semi")
    members = obs.groupBy("panel_id").agg(F.count_distinct("series_id").alias("members"))
    whole = full.groupBy("panel_id", "date").agg(F.count("value").alias("there")).join(members.hint("merge"), "panel_id").filter("there = members")
    return full.join(whole.select("panel_id", "date").hint("merge"), ["panel_id", "date"], "left_semi")


def returns(obs: DataFrame, kind: str = "pct", periods: int = 1, keys: list[str] | None = None) -> DataFrame:
    """value becomes the relative ("pct"), logarithmic ("log") or plain ("diff") change over so many rows."""
    order = Window.partitionBy(*(keys or ["series_id"])).orderBy("date")
    before = F.lag("value", periods).over(order)
    x = F.col("value")
    change = {"pct": x / F.nullif(before, F.lit(0.0)) - 1, "log": F.ln(x) - F.ln(before), "diff": x - before}[kind]
    return obs.withColumn("value", change)


def normalize(obs: DataFrame, how: str = "zscore", keys: list[str] | None = None) -> DataFrame:
    """z-score over the whole series, or index with the first value at 100."""
    keys = keys or ["series_id"]
    every = Window.partitionBy(*keys)
    if how == "zscore":
        sd = F.nullif(F.stddev_samp("value").over(every), F.lit(0.0))
        return obs.withColumn("value", (F.col("value") - F.avg("value").over(every)) / sd)
    first = F.first("value", ignorenulls=True).over(every.orderBy("date").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    return obs.withColumn("value", 100 * F.col("value") / F.nullif(first, F.lit(0.0)))


def infer_frequency(obs: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Median gap in days of each key, whether it is daily (at most 7), and rows a year."""
    keys = keys or ["series_id"]
    gap = F.datediff("date", F.lag("date").over(Window.partitionBy(*keys).orderBy("date")))
    g = obs.withColumn("gap", gap).groupBy(*keys).agg(F.percentile("gap", F.lit(0.5)).alias("median_gap"))
    m = F.col("median_gap")
    rows = F.when(m < 5, 252).when(m < 15, 52).when(m < 45, 12).otherwise(4)
    return g.withColumns({"is_daily": m <= 7, "rows_a_year": rows.cast("bigint")})


def nearest(events: DataFrame, obs: DataFrame, tolerance: int = 1) -> DataFrame:
    """events (event_date, ...) with the row of obs nearest within so many days, ties to the earlier date.

    An equi-join on the candidate dates; no range join. Adds series_id, actual_date, value.
    """
    near = F.explode(F.sequence(F.date_sub("event_date", tolerance), F.date_add("event_date", tolerance)))
    hit = events.withColumn("date", near).join(obs, "date")
    best = F.min_by(F.struct("date", "value"), F.struct(F.abs(F.datediff("date", "event_date")), "date"))
    return (
        hit.groupBy(*events.columns, "series_id").agg(best.alias("b"))
        .select(*events.columns, "series_id", F.col("b.date").alias("actual_date"), "b.value")
    )


def asof(left: DataFrame, right: DataFrame, keys: list[str], at: str = "date", value: str = "value") -> DataFrame:
    """left with ``asof_value`` and ``asof_date``: those of the last row of right at or before its date.

    Both sides are merged in one sort by key and date and filled forward.
    """
    a = left.withColumns({"__v": F.lit(None).cast("struct<d:date,v:double>"), "__side": F.lit(1)})
    b = right.select(*keys, at, F.struct(F.col(at).alias("d"), F.col(value).cast("double").alias("v")).alias("__v")).withColumn("__side", F.lit(0))
    order = Window.partitionBy(*keys).orderBy(at, "__side").rowsBetween(Window.unboundedPreceding, 0)
    filled = a.unionByName(b, allowMissingColumns=True).withColumn("__v", F.last("__v", ignorenulls=True).over(order))
    out = filled.filter("__side = 1")
    return out.withColumns({"asof_value": F.col("__v.v"), "asof_date": F.col("__v.d")}).drop("__v", "__side")


#: Bits of a day's number that each level of bins drops, and the parts that a bin of many days is dealt into.
LEVELS, PARTS = (0, 3, 6, 9, 12, 15), 16


def _bins(first: Column, last: Column) -> Column:
    """Array of (level, bin): the aligned ranges of 1, 8, 64, ... days that make up the days first to last.

    Of each size those whole ranges are taken that do not make up a whole one of the next size: at most 14, but for the
    last size.
    """
    first, last = first.cast("bigint"), last.cast("bigint")
    none = F.array().cast("array<struct<level:int,bin:bigint>>")

    def run(low: Column, high: Column, level: int) -> Column:
        made = F.transform(F.sequence(low, high), lambda k: F.struct(F.lit(level).alias("level"), k.alias("bin")))
        return F.when(low <= high, made).otherwise(none)

    def whole(level: int) -> tuple[Column, Column]:
        return F.ceil(first / (1 << level)).cast("bigint"), F.floor((last + 1) / (1 << level)).cast("bigint") - 1

    parts = []
    for level, above in zip(LEVELS, [*LEVELS[1:], None], strict=True):
        low, high = whole(level)
        if above is None:
            parts.append(run(low, high, level))
        else:
            step = 1 << (above - level)
            up, down = whole(above)
            more = up <= down
            parts.append(run(low, F.when(more, up * step - 1).otherwise(high), level))
            parts.append(F.when(more, run((down + 1) * step, high, level)).otherwise(none))
    return F.concat(*parts)


def within(obs: DataFrame, intervals: DataFrame) -> DataFrame:
    """Rows of obs inside each interval (name, start_date, end_date, ...), by bins of several sizes.

    An interval stands in the few bins that make it up, a date looks up one bin of each size, so each pair meets in
    exactly one bin: intervals of a day and of decades go through the same hash join, and nothing is filtered after it. Bins of
    64 days and more are dealt into parts by the date's own number, so that no key holds all rows of a long interval.
    """
    parts = F.when(F.col("__b.level") >= 6, F.lit(PARTS)).otherwise(F.lit(1))
    cut = intervals.filter("start_date <= end_date").withColumn("__b", F.explode(_bins(F.unix_date("start_date"), F.unix_date("end_date"))))
    cut = cut.withColumn("__p", F.explode(F.sequence(F.lit(0), parts - 1))).withColumns({"__level": F.col("__b.level"), "__bin": F.col("__b.bin")}).drop("__b")
    day = F.unix_date("date").cast("bigint")
    looked = F.array(*[F.struct(F.lit(level).alias("level"), F.shiftright(day, level).alias("bin")) for level in LEVELS])
    dated = obs.filter(F.col("date").isNotNull()).withColumn("__b", F.explode(looked))
    part = F.when(F.col("__b.level") >= 6, F.pmod(day, F.lit(PARTS)).cast("int")).otherwise(F.lit(0))
    dated = dated.withColumns({"__level": F.col("__b.level"), "__bin": F.col("__b.bin"), "__p": part}).drop("__b")
    return dated.join(cut.hint("merge"), ["__level", "__bin", "__p"]).drop("__level", "__bin", "__p")
