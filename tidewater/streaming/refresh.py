"""Refresh from a stream of landed observation files, by micro-batch: only what a batch touches is written again.

The store is a folder of Parquet tables:

* observations (series_id, date, value), partitioned by frequency, bucket (hash of the series) and year;
* sums (rows, hash and last date of each series), in the same partitions;
* metadata (series_id, last_refreshed) and log (last fetched, last observation, rows, hash), partitioned by frequency
  and bucket;
* late, the rows of a batch that are older than the look-back before their series' last date, by batch;
* started and commits, a row for each batch, written first and last.

A batch reads the partitions that its rows fall into, merges them by key and overwrites just those partitions. The content
hash of a series is a sum over its rows, so the log follows from the sums, without the series' other rows.

A batch whose commit is there changes nothing when it is run again. One that broke off is run again whole: its late rows
and counts are those of its start, merges are by key, sums are those of whole partitions and the time stamp is
that of the batch's last arrival, so it writes what it would have written at first.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions.stored import swept, written
from ..operators.ingest import LOOK_BACK, OTHER_LOOK_BACK, merge_revisions, row_hash
from ..sources.observations import OBSERVATIONS

SCHEMA = "series_id string, date date, value double, arrived timestamp"
LOG = "series_id string, last_fetched_at timestamp, last_observation_date date, n bigint, hash decimal(38,0)"
KINDS = {
    "observations": ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in OBSERVATIONS) + ", frequency string, bucket int, year int",
    "sums": "series_id string, n bigint, hash decimal(38,0), last date, frequency string, bucket int, year int",
    "metadata": "series_id string, last_refreshed timestamp, frequency string, bucket int",
    "log": f"{LOG}, frequency string, bucket int",
    "late": f"{SCHEMA}, batch bigint",
    "started": "rows_added bigint, rows_changed bigint, series bigint, partitions bigint, late bigint, batch bigint",
    "commits": "rows_added bigint, rows_changed bigint, series bigint, partitions bigint, late bigint, batch bigint",
}
PARTS = {"observations": ["frequency", "bucket", "year"], "sums": ["frequency", "bucket", "year"], "started": ["batch"], "metadata": ["frequency", "bucket"], "log": ["frequency", "bucket"], "late": ["batch"], "commits": ["batch"]}


def stored(spark: SparkSession, store: str, table: str) -> DataFrame:
    """A table of the store; empty and typed where nothing is stored yet.

    A store with commits but without the table is broken, and reading it fails.
    """
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()

    def there(name: str) -> bool:
        path = jvm.org.apache.hadoop.fs.Path(f"{store}/{name}")
        return path.getFileSystem(conf).exists(path)

    if there(table) or (table in ("observations", "sums", "metadata", "log") and there("commits")):
        return spark.read.schema(KINDS[table]).parquet(f"{store}/{table}")
    return spark.createDataFrame([], KINDS[table])


def update_log(spark: SparkSession, store: str) -> DataFrame:
    """series_id, last_fetched_at, last_observation_date, n, last_value_hash (as content_hash() gives it)."""
    digest = F.sha2(F.concat_ws(":", "n", "hash"), 256)
    return stored(spark, store, "log").select("series_id", "last_fetched_at", "last_observation_date", "n", digest.alias("last_value_hash"))


def latest_arrivals(batch: DataFrame) -> DataFrame:
    """The last arrival for each (series_id, date)."""
    w = Window.partitionBy("series_id", "date").orderBy(F.desc("arrived"), F.desc("value"))
    return batch.withColumn("__n", F.row_number().over(w)).filter("__n = 1").drop("__n")


def late_rows(log: DataFrame, rows: DataFrame, look_back: int) -> DataFrame:
    """Rows older than the look-back before their series' last stored date. log: series_id, last_observation_date."""
    last = log.select("series_id", F.col("last_observation_date").alias("__last"))
    j = rows.join(last.hint("merge"), "series_id")
    return j.filter(F.col("date") < F.date_sub("__last", look_back)).drop("__last")


def _bucket(buckets: int) -> Column:
    return F.pmod(F.xxhash64("series_id"), F.lit(buckets)).cast("int")


def _overwrite(df: DataFrame, store: str, table: str) -> None:
    """Replaces the partitions of the table that df has rows of, and no others."""
    parts = PARTS[table]
    df.hint("rebalance", *parts).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*parts).parquet(f"{store}/{table}")


def merge_batch(batch: DataFrame, number: int, store: str, frequency: str = "D", buckets: int = 64, late: str = "merge") -> None:
    """Merges one batch into the store. late: whether rows beyond the look-back are merged too or only set aside."""
    spark = batch.sparkSession
    if stored(spark, store, "commits").filter(F.col("batch") == number).count():
        return
    with swept(spark):
        bucket = _bucket(buckets)
        rows = written(batch.filter(F.col("series_id").isNotNull() & F.col("date").isNotNull()).withColumn("bucket", bucket), "batch")
        rows = written(latest_arrivals(rows), "latest")
        # at most buckets, and buckets times years
        names = [r.bucket for r in rows.select("bucket").distinct().collect()]
        mine = (F.col("frequency") == frequency) & F.col("bucket").isin(names)
        log, meta = (stored(spark, store, t).filter(mine) for t in ("log", "metadata"))
        start = stored(spark, store, "started").filter(F.col("batch") == number)
        resumed = start.count() > 0
        if resumed:
            old = stored(spark, store, "late").filter(F.col("batch") == number).drop("batch")
        else:
            old = late_rows(log, rows, LOOK_BACK.get(frequency, OTHER_LOOK_BACK)).drop("bucket")
        old = written(old, "late")
        new = rows if late == "merge" else rows.join(old.select("series_id", "date").hint("merge"), ["series_id", "date"], "left_anti")
        new = written(new.withColumn("year", F.year("date")), "new")
        touched = new.select("bucket", "year").distinct()
        places = touched.collect()
        mine_now = mine & F.col("year").isin([p.year for p in places])
        here = lambda table: stored(spark, store, table).filter(mine_now).join(F.broadcast(touched), ["bucket", "year"], "left_semi")
        had = here("observations")
        key = ["series_id", "date"]
        if not resumed:
            both = had.select(*key, F.col("value").alias("old"), F.lit(True).alias("had")).join(new.select(*key, F.col("value").alias("new")).hint("merge"), key, "right")
            changed = F.col("had") & ~F.col("old").eqNullSafe(F.col("new"))
            start = both.agg(F.count_if(F.col("had").isNull()).alias("rows_added"), F.count_if(changed).alias("rows_changed"), F.countDistinct("series_id").alias("series"))
            start = start.withColumns({"partitions": F.lit(len(places)).cast("bigint"), "late": F.lit(old.count()).cast("bigint"), "batch": F.lit(number).cast("bigint")})
        start = written(start, "start")
        merged = written(merge_revisions(had, new).withColumns({"frequency": F.lit(frequency), "bucket": bucket, "year": F.year("date")}), "merged")

        each = [F.sum("n").alias("n"), F.sum("hash").cast("decimal(38,0)").alias("hash"), F.max("last").alias("last")]
        one = merged.select("series_id", "frequency", "bucket", "year", F.lit(1).cast("bigint").alias("n"), row_hash().alias("hash"), F.col("date").alias("last"))
        sums = written(one.groupBy("series_id", "frequency", "bucket", "year").agg(*each), "sums")
        rest = stored(spark, store, "sums").filter(mine).join(F.broadcast(touched), ["bucket", "year"], "left_anti")
        came = written(new.select("series_id").distinct(), "came")
        as_of = rows.agg(F.max("arrived")).first()[0]
        total = sums.unionByName(rest).join(came.hint("merge"), "series_id", "left_semi").groupBy("series_id").agg(*each)
        fresh = total.withColumnRenamed("last", "last_observation_date").withColumn("last_fetched_at", F.lit(as_of).cast("timestamp"))
        fields = [c.split()[0] for c in LOG.split(", ")]
        kept = log.join(came.hint("merge"), "series_id", "left_anti").select(*fields)
        log = written(kept.unionByName(fresh.select(*fields)).withColumns({"frequency": F.lit(frequency), "bucket": bucket}), "log")
        stamped = came.select("series_id", F.lit(as_of).cast("timestamp").alias("last_refreshed"))
        kept = meta.join(came.hint("merge"), "series_id", "left_anti").select("series_id", "last_refreshed")
        meta = written(kept.unionByName(stamped).withColumns({"frequency": F.lit(frequency), "bucket": bucket}), "metadata")

        late_now = old.withColumn("batch", F.lit(number).cast("bigint"))
        for table, df in (("late", late_now), ("started", start), ("observations", merged), ("sums", sums), ("log", log), ("metadata", meta), ("commits", start)):
            _overwrite(df, store, table)


def start(
    spark: SparkSession, landing: str, store: str, checkpoint: str, frequency: str = "D", files: int | None = None, buckets: int = 64,
    late: str = "merge",
) -> StreamingQuery:
    """Watches a folder of JSON lines and keeps the store merged (see merge_batch).

    A revision has the key of the row it revises, so rows are not deduplicated across batches.
    """
    source = spark.readStream.schema(SCHEMA)
    if files:
        source = source.option("maxFilesPerTrigger", files)
    merge = lambda batch, number: merge_batch(batch, number, store, frequency, buckets, late)
    return source.json(landing).writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
