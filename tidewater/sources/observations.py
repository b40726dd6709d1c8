"""Readers and writers of observation tables (series_id, date, value; partitioned by frequency)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

OBSERVATIONS = T.StructType(
    [T.StructField("series_id", T.StringType()), T.StructField("date", T.DateType()), T.StructField("value", T.DoubleType())]
)
SDMX = "struct<dataSets:array<struct<series:map<string,struct<observations:map<string,array<double>>>>>>,structure:struct<dimensions:struct<observation:array<struct<values:array<struct<id:string>>>>>>>"


def read_observations(spark: SparkSession, path: str, series_ids: list[str] | None = None) -> DataFrame:
    """Stored observations, filtered at the scan; an empty typed table where nothing is stored yet."""
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).exists(hadoop):
        return spark.createDataFrame([], OBSERVATIONS)
    df = spark.read.parquet(path)
    return df.filter(F.col("series_id").isin(series_ids)) if series_ids is not None else df


def series_metadata(metadata: DataFrame, series_id: str) -> dict:
    """The stored row of one series; KeyError if there is none."""
    row = metadata.filter(F.col("series_id") == series_id).first()
    if row is None:
        raise KeyError(f"no metadata of series {series_id!r}; refresh first")
    return row.asDict()


def available_series(metadata: DataFrame, partition: str | None = None) -> DataFrame:
    """series_id of the stored series, or of those of one partition."""
    rows = metadata if partition is None else metadata.filter(F.col("partition") == partition)
    return rows.select("series_id")


def keep_last(obs: DataFrame, keys: list[str], order: Column) -> DataFrame:
    """One row for each key: the last by order."""
    w = Window.partitionBy(*keys).orderBy(order.desc())
    return obs.withColumn("__n", F.row_number().over(w)).filter("__n = 1").drop("__n")


def write_observations(obs: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Sorted by series and date within files, one folder for each frequency, so scans skip row groups."""
    obs.repartitionByRange("frequency", "series_id").sortWithinPartitions("frequency", "series_id", "date").write.mode(mode).partitionBy("frequency").parquet(path)


def observations_from_json(raw: DataFrame, column: str = "body") -> DataFrame:
    """series_id, date, value from JSON lists of {date, value}; "." and other non-numbers are missing."""
    items = F.explode(F.from_json(F.col(column), "array<struct<date:string,value:string>>"))
    value = F.expr("try_cast(nullif(i.value, '.') AS DOUBLE)")
    return raw.select("series_id", items.alias("i")).select("series_id", F.expr("try_cast(i.date AS DATE)").alias("date"), value.alias("value"))


def period_start(period: Column) -> Column:
    """First day of 2026, 2026-04, 2026-Q2, 2026-S1, 2026-W05 or of a date."""
    year = F.substring(period, 1, 4)
    n = lambda: F.substring(period, 7, 2).cast("int")
    week1 = F.date_trunc("week", F.to_date(F.concat(year, F.lit("-01-04")))).cast("date")
    month = lambda m: F.make_date(year.cast("int"), m, F.lit(1))
    return (
        F.when(period.rlike(r"^\d{4}$"), F.to_date(F.concat(year, F.lit("-01-01"))))
        .when(period.rlike(r"^\d{4}-Q[1-4]$"), month(n() * 3 - 2))
        .when(period.rlike(r"^\d{4}-S[12]$"), month(n() * 6 - 5))
        .when(period.rlike(r"^\d{4}-W\d{2}$"), F.date_add(week1, (n() - 1) * 7))
        .when(period.rlike(r"^\d{4}-\d{2}$"), F.to_date(F.concat(period, F.lit("-01"))))
        .when(period.rlike(r"^\d{4}-\d{2}-\d{2}$"), F.to_date(period))
    )


def observations_from_sdmx(raw: DataFrame, column: str = "body") -> DataFrame:
    """series_id, date, value from SDMX-JSON messages: observations are keyed by the index of their period."""
    m = raw.select("series_id", F.from_json(column, SDMX).alias("m"))
    periods = F.transform(F.get(F.col("m.structure.dimensions.observation"), F.lit(0))["values"], lambda v: v["id"])
    series = m.select("series_id", periods.alias("periods"), F.explode(F.get(F.col("m.dataSets"), F.lit(0))["series"]).alias("_", "s"))
    rows = series.select("series_id", "periods", F.explode("s.observations").alias("i", "o"))
    return rows.select(
        "series_id", period_start(F.get("periods", F.col("i").cast("int"))).alias("date"), F.get("o", F.lit(0)).alias("value")
    )


def read_jsonl(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """JSON lines; lines that do not parse are dropped."""
    return spark.read.schema(schema).option("mode", "DROPMALFORMED").json(path)
