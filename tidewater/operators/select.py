"""Ranking of findings, seeds, and snapshot tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


#: Order of kinds in rankings, first is most urgent; kinds that are data points and go stale.
KINDS = [
    "harvested_source", "correlation_shift", "cointegration_break", "regime_transition", "lead_lag_change", "structural_break",
    "fomc_event_study", "fomc_sep", "notable_move_change", "spread_extreme", "notable_move_level",
]
DATA_POINTS = ["notable_move_level", "notable_move_change", "spread_extreme"]


def rank_findings(findings: DataFrame, history: DataFrame, as_of: Column, kinds: list[str] | None = None, days: int = 7, often: int = 2) -> DataFrame:
    """findings with place: kinds shown often of late last, then by kind (others last), newest first, then slug.

    Places count on from day to day, so that no task orders all findings.
    """
    kinds = kinds or KINDS
    recent = history.filter((F.col("date") >= F.date_sub(as_of, days)) & (F.col("date") <= as_of)).groupBy("kind").agg(F.count("*").alias("shown"))
    priority = F.array_position(F.array(*[F.lit(k) for k in kinds]), F.col("kind")) - 1
    d = findings.join(recent.hint("merge"), "kind", "left")
    d = d.withColumns({
        "tired": F.coalesce((F.col("shown") >= often).cast("int"), F.lit(0)), "priority": F.when(priority >= 0, priority).otherwise(99),
        "__day": F.coalesce("discovered", F.lit("0001-01-01").cast("date")),
    }).drop("shown")
    by = ["tired", "priority", "__day"]
    order = Window.orderBy("tired", "priority", F.desc("__day")).rowsBetween(Window.unboundedPreceding, -1)  # a row for each kind and day
    days_before = d.groupBy(*by).count().withColumn("__before", F.coalesce(F.sum("count").over(order), F.lit(0))).drop("count")
    place = F.col("__before") + F.row_number().over(Window.partitionBy(*by).orderBy("slug"))
    return d.join(days_before.hint("merge"), by).withColumn("place", place).drop("__day", "__before")


def _sets(df: DataFrame) -> DataFrame:
    """df with series_ids: its own, or key as the only one."""
    return df if "series_ids" in df.columns else df.withColumn("series_ids", F.array("key"))


def overlapping(df: DataFrame, series: DataFrame, flag: str) -> DataFrame:
    """df (slug, series_ids, ...) with flag: whether one of its series is in series (series_id).

    A semi join of the exploded sets, so that neither side is gathered.
    """
    hit = df.select("slug", "series_ids", F.explode(F.array_distinct("series_ids")).alias("series_id")).join(series.select("series_id").distinct().hint("merge"), "series_id", "left_semi")
    hit = hit.select("slug", "series_ids").distinct().withColumn(flag, F.lit(True))
    out = df.join(hit.hint("merge"), ["slug", "series_ids"], "left")
    return out.withColumn(flag, F.coalesce(flag, F.lit(False)))


def eligible(
    findings: DataFrame, history: DataFrame, as_of: Column, days: int = 14, data_points: list[str] | None = None, more: DataFrame | None = None, more_days: int = 7
) -> DataFrame:
    """The findings to choose from, with tier, the first of these that any finding is in: 0 new status, slug and series not
    shown within the last days, no stale data point; 1 the same in any status; 2 slug not shown; 3 all.

    Findings and history have series_ids, sets of series that are shown if one of them is, or key for a single one.
    more: series (series_ids or key) that were asked for again and count as not shown; with a column date, those of the
    last more_days.
    """
    single = "series_ids" not in findings.columns
    findings = _sets(findings)
    within = lambda df, n: df.filter((F.col("date") >= F.date_sub(as_of, n)) & (F.col("date") <= as_of))
    recent = within(_sets(history), days)
    slugs = recent.select("slug").distinct().withColumn("__s", F.lit(1))
    shown = recent.select(F.explode("series_ids").alias("series_id")).distinct()
    if more is not None:
        more = within(more, more_days) if "date" in more.columns else more
        shown = shown.join(_sets(more).select(F.explode("series_ids").alias("series_id")).hint("merge"), "series_id", "left_anti")
    d = overlapping(findings.join(slugs.hint("merge"), "slug", "left"), shown, "__k")
    stale = F.col("kind").isin(data_points or DATA_POINTS) & (F.datediff(as_of, "discovered") > days)
    fits = F.col("__s").isNull() & ~F.col("__k") & ~F.coalesce(stale, F.lit(False))
    tier = F.when(fits & (F.col("status") == "new"), 0).when(fits, 1).when(F.col("__s").isNull(), 2).otherwise(3)
    d = d.withColumn("tier", tier).drop("__s", "__k", *(["series_ids"] if single else []))
    return d.join(F.broadcast(d.agg(F.min("tier").alias("tier"))), "tier")  # one row


def upcoming_series(releases: DataFrame, members: DataFrame, as_of: Column, keywords: list[str], days: int = 2, named: dict[str, list[str]] | None = None) -> DataFrame:
    """series_id, release_id, release_name, release_date of the releases of the next days that a keyword names.

    members: release_id, series_id. named: series of the releases whose name has a word, beside their members (a registry).
    """
    soon = releases.filter((F.col("release_date") >= as_of) & (F.col("release_date") <= F.date_add(as_of, days)))
    words = F.array(*[F.lit(k.lower()) for k in keywords]).cast("array<string>")
    soon = soon.filter(F.exists(words, lambda k: F.contains(F.lower("release_name"), k)))
    cols = ["release_id", "release_name", "release_date"]
    out = soon.join(members.select("release_id", "series_id").hint("merge"), "release_id").select("series_id", *cols)
    if named:
        pairs = F.array(*[F.struct(F.lit(w.lower()).alias("word"), F.lit(s).alias("series_id")) for w, ids in named.items() for s in ids])
        hit = F.filter(pairs, lambda p: F.contains(F.lower("release_name"), p["word"]))
        out = out.unionByName(soon.select(F.explode(hit).alias("p"), *cols).select("p.series_id", *cols))
    return out.distinct()


def release_match(
    findings: DataFrame, releases: DataFrame, members: DataFrame, as_of: Column, keywords: list[str], days: int = 2, named: dict[str, list[str]] | None = None
) -> DataFrame:
    """findings with upcoming: whether one of their series (series_ids or key) is in a release of the next days that a
    keyword names (see upcoming_series)."""
    series = upcoming_series(releases, members, as_of, keywords, days, named)
    if "series_ids" in findings.columns:
        return overlapping(findings, series, "upcoming")
    keys = series.select(F.col("series_id").alias("key")).distinct().withColumn("__u", F.lit(True))
    return findings.join(keys.hint("merge"), "key", "left").withColumn("upcoming", F.coalesce("__u", F.lit(False))).drop("__u")


def pick_seed(seeds: DataFrame, as_of: Column, shown: DataFrame | None = None) -> DataFrame:
    """The one unused seed that has not expired: with an upcoming release first, then by priority and id.

    shown: series (series_ids or key) of the last days; seeds with one of them are left out.
    """
    live = seeds.filter((~F.col("used")) & (F.col("expires") >= as_of))
    if shown is not None and "series_ids" in live.columns:
        live = overlapping(live.withColumn("slug", F.col("id")), _sets(shown).select(F.explode("series_ids").alias("series_id")), "__shown").filter("NOT __shown").drop("slug", "__shown")
    elif shown is not None:
        live = live.join(shown.select("key").distinct().hint("merge"), "key", "left_anti")
    return live.orderBy(F.desc("upcoming"), F.desc("priority_score"), "id").limit(1)



def market_snapshot(obs: DataFrame, steps: tuple[int, ...] = (1, 5, 21)) -> DataFrame:
    """series_id, date, value, change_n and sigma_n for each step, pct_252 and pct_1260 of the latest row.

    Changes are those of daily series (a median gap of seven days at most) of 22 rows or more, else NULL.
    """
    w = Window.partitionBy("series_id")
    d = obs.filter("value IS NOT NULL").withColumn("back", F.row_number().over(w.orderBy(F.desc("date"))))
    d = d.withColumns({"diff": F.col("value") - F.lead("value").over(w.orderBy("back")), "latest": F.first("value").over(w.orderBy("back")), "gap": F.datediff("date", F.lead("date").over(w.orderBy("back")))})
    at = lambda n: F.max(F.when(F.col("back") == n, F.col("value")))
    share = lambda n: F.avg(F.when(F.col("back") <= n, (F.col("value") <= F.col("latest")).cast("double")))
    g = d.groupBy("series_id").agg(
        F.max("date").alias("date"), at(1).alias("value"), F.count("*").alias("n"), F.percentile("gap", F.lit(0.5)).alias("gap"), F.stddev_samp(F.when(F.col("back") <= 252, F.col("diff"))).alias("sd"),
        *[at(n + 1).alias(f"then_{n}") for n in steps], share(252).alias("pct_252"), share(1260).alias("pct_1260"),
    )
    for n in steps:
        change = F.when((F.col("n") >= 22) & (F.col("gap") <= 7), F.col("value") - F.col(f"then_{n}"))
        g = g.withColumns({f"change_{n}": change, f"sigma_{n}": change / F.nullif(F.col("sd") * float(n) ** 0.5, F.lit(0.0))})
    return g.drop("sd", "gap", *[f"then_{n}" for n in steps])


def series_snapshot(obs: DataFrame, per_year: int = 12) -> DataFrame:
    """series_id, value, date, start, n, z and percentile over the full history, ten and five years, in one pass."""
    w = Window.partitionBy("series_id")
    d = obs.filter("value IS NOT NULL").withColumn("back", F.row_number().over(w.orderBy(F.desc("date"))))
    d = d.withColumn("latest", F.first("value").over(w.orderBy("back")))
    aggs = [F.max("date").alias("date"), F.min("date").alias("start"), F.count("*").alias("n"), F.first("latest").alias("value")]
    for name, years in (("full", None), ("10y", 10), ("5y", 5)):
        inside = F.lit(True) if years is None else F.col("back") <= years * per_year
        x = F.when(inside, F.col("value"))
        z = (F.first("latest") - F.avg(x)) / F.nullif(F.stddev_samp(x), F.lit(0.0))
        aggs += [z.alias(f"z_{name}"), F.avg(F.when(inside, (F.col("value") <= F.col("latest")).cast("double"))).alias(f"pct_{name}")]
    return d.groupBy("series_id").agg(*aggs)


def sanity_flags(obs: DataFrame, low: float = -1, high: float = 25, moves: tuple[float, ...] = (0.5, 1.0)) -> DataFrame:
    """obs with out_of_range and move_over_<i> for each limit of a one-row move."""
    w = Window.partitionBy("series_id").orderBy("date")
    move = F.abs(F.col("value") - F.lag("value").over(w))
    return obs.withColumns({"out_of_range": ~F.col("value").between(low, high), **{f"move_over_{i}": F.coalesce(move > m, F.lit(False)) for i, m in enumerate(moves)}})


def release_table(calendar: DataFrame, labels: DataFrame, as_of: Column, days: int = 10) -> DataFrame:
    """release_date, label of the known releases of the next days, each once a day."""
    soon = calendar.filter((F.col("release_date") >= as_of) & (F.col("release_date") <= F.date_add(as_of, days)))
    return soon.join(F.broadcast(labels), "release_id").select("release_date", "label").distinct()  # labels: a registry


def keyword_to_series(texts: DataFrame, keywords: DataFrame, first: int = 3) -> DataFrame:
    """id, place, series_id: the first series that the words of a text imply; keywords: word, series_id."""
    words = texts.select("id", F.posexplode(F.split(F.lower("text"), "[^a-z0-9]+")).alias("at", "word"))
    hit = words.join(keywords, "word").groupBy("id", "series_id").agg(F.min("at").alias("at"))
    place = F.row_number().over(Window.partitionBy("id").orderBy("at", "series_id"))
    return hit.withColumn("place", place).filter(F.col("place") <= first).select("id", F.col("place").cast("bigint").alias("place"), "series_id")


def _or_dash(x: Column, text: Column) -> Column:
    return F.when(x.isNull() | F.isnan(x.cast("double")), F.lit("—")).otherwise(text)


def format_percent(x: Column, digits: int = 2) -> Column:
    """Of a value that is in percent."""
    return _or_dash(x, F.format_string(f"%.{digits}f%%", x))


def format_bp(x: Column, digits: int = 0) -> Column:
    return _or_dash(x, F.format_string(f"%+.{digits}f bp", x * 100))


def format_level(x: Column) -> Column:
    """Three decimals below 1, two below 10, one below 100, none above; thousands with commas."""
    a = F.abs(x)
    by_size = F.when(a >= 100, F.format_string("%,.0f", x)).when(a >= 10, F.format_string("%.1f", x)).when(a >= 1, F.format_string("%.2f", x))
    return _or_dash(x, by_size.otherwise(F.format_string("%.3f", x)))


def format_z(z: Column, digits: int = 1) -> Column:
    return _or_dash(z, F.format_string(f"%+.{digits}fσ", z))


def format_corr(r: Column, digits: int = 0, signed: bool = True) -> Column:
    return _or_dash(r, F.format_string(f"%{'+' if signed else ''}.{digits}f%%", r * 100))


def format_pp(x: Column, digits: int = 2) -> Column:
    return _or_dash(x, F.format_string(f"%+.{digits}f pp", x))


def format_percentile(p: Column, digits: int = 0) -> Column:
    return _or_dash(p, F.format_string(f"%.{digits}fth pct", p * 100))


def format_date(d: Column, style: str = "iso") -> Column:
    pattern = {"iso": "yyyy-MM-dd", "long": "MMM dd, yyyy", "ym": "MMM yyyy"}[style]
    return F.coalesce(F.date_format(d, pattern), F.lit("—"))


def format_range(low: Column, high: Column) -> Column:
    return F.concat(format_level(low), F.lit(" – "), format_level(high))
