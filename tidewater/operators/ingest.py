"""Incremental ingestion: revisions, keyed upserts, derived series, discovery, calendars."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Days that a refresh looks back, by frequency.
LOOK_BACK = {"D": 90, "W": 90, "BW": 90}
OTHER_LOOK_BACK = 730


def _full(existing: DataFrame, incoming: DataFrame) -> DataFrame:
    key = ["series_id", "date"]
    old = existing.select(*key, F.col("value").alias("old"), F.lit(True).alias("had"))
    new = incoming.select(*key, F.col("value").alias("new"), F.lit(True).alias("got"))
    return old.join(new, key, "full_outer")


def merge_revisions(existing: DataFrame, incoming: DataFrame) -> DataFrame:
    """Upsert by (series_id, date); incoming wins, a missing incoming value too."""
    value = F.when(F.col("got"), F.col("new")).otherwise(F.col("old"))
    return _full(existing, incoming).select("series_id", "date", value.alias("value"))


def revision_counts(existing: DataFrame, incoming: DataFrame) -> DataFrame:
    """series_id, rows_added, rows_changed of a merge; missing on both sides is no change."""
    f = _full(existing, incoming).filter("got")
    added, changed = F.col("had").isNull(), F.col("had") & ~F.col("old").eqNullSafe(F.col("new"))
    return f.groupBy("series_id").agg(F.count_if(added).alias("rows_added"), F.count_if(changed).alias("rows_changed"))


def fetch_plan(obs: DataFrame, wanted: DataFrame) -> DataFrame:
    """series_id, frequency, start: last date less the look-back of the frequency; NULL without data."""
    last = obs.groupBy("series_id").agg(F.max("date").alias("last"))
    days = F.lit(OTHER_LOOK_BACK)
    for f, n in LOOK_BACK.items():
        days = F.when(F.col("frequency") == f, n).otherwise(days)
    return wanted.join(last, "series_id", "left").select("series_id", "frequency", F.date_sub("last", days).alias("start"))


def upsert(stored: DataFrame, rows: DataFrame, keys: list[str], order: str) -> DataFrame:
    """stored with rows added; of rows with one key the last by order stays, of equal ones the added."""
    both = stored.withColumn("__new", F.lit(0)).unionByName(rows.withColumn("__new", F.lit(1)), allowMissingColumns=True)
    w = Window.partitionBy(*keys).orderBy(F.desc(order), F.desc("__new"))
    return both.withColumn("__n", F.row_number().over(w)).filter("__n = 1").drop("__n", "__new")


def replace_received(stored: DataFrame, received: DataFrame) -> DataFrame:
    """Rows of series that came in replace those stored; series that were asked for but failed stay."""
    return stored.join(received.select("series_id").distinct(), "series_id", "left_anti").unionByName(received)


def derive_linear(obs: DataFrame, terms: DataFrame) -> DataFrame:
    """derived_id, date, value: signed sums of component series (derived_id, series_id, sign) on common dates."""
    need = terms.groupBy("derived_id").agg(F.count("*").alias("need"))
    j = obs.join(F.broadcast(terms.join(need, "derived_id")), "series_id")  # the registry of derived series
    g = j.groupBy("derived_id", "date", "need").agg(F.sum(F.col("sign") * F.col("value")).alias("value"), F.count("value").alias("n"))
    return g.filter("n = need").select("derived_id", "date", "value")


def universe(found: DataFrame, least_popular: int = 30) -> DataFrame:
    """frequency, series_ids: discovered series once each (highest popularity), without unpopular annual ones."""
    w = Window.partitionBy("series_id").orderBy(F.desc_nulls_last("popularity"), "frequency")
    one = found.withColumn("__n", F.row_number().over(w)).filter("__n = 1")
    one = one.filter((F.col("frequency") != "A") | (F.coalesce("popularity", F.lit(0)) >= least_popular))
    return one.groupBy("frequency").agg(F.sort_array(F.collect_list("series_id")).alias("series_ids"))


def merge_calendar(calendar: DataFrame, static: DataFrame) -> DataFrame:
    """calendar with its static events (negative release_id) replaced, one row for each release and date."""
    both = calendar.filter("release_id >= 0").unionByName(static)
    w = Window.partitionBy("release_id", "release_date").orderBy("release_name")
    return both.withColumn("__n", F.row_number().over(w)).filter("__n = 1").drop("__n")


def row_hash() -> Column:
    return F.xxhash64("date", "value").cast("decimal(38,0)")


def content_hash(obs: DataFrame) -> DataFrame:
    """series_id, n, content_hash of its rows, the same in whatever order they come.

    Sums of row hashes, so that a series need not stand in one place.
    """
    s = obs.groupBy("series_id").agg(F.count("*").alias("n"), F.sum(row_hash()).cast("decimal(38,0)").alias("sum"))
    return s.select("series_id", "n", F.sha2(F.concat_ws(":", "n", "sum"), 256).alias("content_hash"))


def refresh(stored: DataFrame, received: DataFrame, metadata: DataFrame, log: DataFrame, as_of) -> tuple[DataFrame, DataFrame, DataFrame]:  # noqa: ANN001
    """Observations, metadata and update log after a batch: revisions merged, one log row for each series
    that came in (last date and content hash), metadata stamped. Series that did not come in stay as they are."""
    merged = merge_revisions(stored, received)
    came = received.select("series_id").distinct()
    new = merged.join(came, "series_id", "left_semi")
    last = new.groupBy("series_id").agg(F.max("date").alias("last_observation_date"))
    rows = last.join(content_hash(new), "series_id").select("series_id", as_of.alias("last_fetched_at"), "last_observation_date", F.col("content_hash").alias("last_value_hash"))
    stamped = metadata.join(came.withColumn("__came", F.lit(True)), "series_id", "left")
    stamped = stamped.withColumn("last_refreshed", F.when(F.col("__came"), as_of).otherwise(F.col("last_refreshed"))).drop("__came")
    return merged, stamped, log.join(came, "series_id", "left_anti").unionByName(rows)
