"""Series derived from the test tables, as DataFrames and as the same SQL for the oracle."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

# An odd scale, so that no figure falls on a tie when it is rounded.
MONTHLY = """monthly AS (
  SELECT concat('ORD.', o_orderpriority) AS series_id, CAST(date_trunc('month', o_orderdate) AS DATE) AS date,
         CAST(sum(CAST(o_totalprice AS DECIMAL(18,2))) AS DOUBLE) / 1234567 AS value
  FROM orders GROUP BY 1, 2)"""
DAILY = """daily AS (
  SELECT concat('ORD.', o_orderpriority) AS series_id, CAST(o_orderdate AS DATE) AS date,
         CAST(sum(CAST(o_totalprice AS DECIMAL(18,2))) AS DOUBLE) / 1234567 AS value
  FROM orders GROUP BY 1, 2)"""
QUARTERLY = """quarterly AS (
  SELECT concat('Q.', o_orderpriority) AS series_id, CAST(date_trunc('quarter', o_orderdate) AS DATE) AS date,
         CAST(sum(CAST(o_totalprice AS DECIMAL(18,2))) AS DOUBLE) / 1234567 AS value
  FROM orders GROUP BY 1, 2)"""
CURVE = """curve AS (
  SELECT CAST(l_linenumber AS INT) AS tenor, CAST(date_trunc('month', l_shipdate) AS DATE) AS date,
         100 * CAST(sum(CAST(l_discount AS DECIMAL(18,2))) AS DOUBLE) / count(*) AS value
  FROM lineitem GROUP BY 1, 2)"""
PARTS = """parts AS (
  SELECT concat('RF.', l_returnflag) AS series_id, CAST(l_shipdate AS DATE) AS date,
         CAST(sum(CAST(l_extendedprice AS DECIMAL(18,2))) AS DOUBLE) / 1234567 AS value
  FROM lineitem GROUP BY 1, 2)"""
#: Pairs of the five priorities, a before b.
PAIRS = """pairs AS (
  SELECT concat(a.series_id, '|', b.series_id) AS pair_id, a.date AS date, a.value AS a, b.value AS b
  FROM monthly a JOIN monthly b ON a.date = b.date AND a.series_id < b.series_id)"""
DOTS = """dots AS (
  SELECT CAST(date_trunc('quarter', o_orderdate) AS DATE) AS meeting_date, o_orderpriority AS forecast_year,
         CAST(floor(o_totalprice / 50000) AS DOUBLE) AS rate, CAST(count(*) AS INT) AS participant_count
  FROM orders GROUP BY 1, 2, 3)"""
CALENDAR = """calendar AS (
  SELECT min(CAST(o_orderdate AS DATE)) AS date,
         (extract(quarter FROM min(o_orderdate)) % 2) = 1 AS is_scheduled
  FROM orders GROUP BY date_trunc('quarter', o_orderdate))"""
FLAGS = """flags AS (
  SELECT series_id, date, CASE WHEN value < avg(value) OVER (PARTITION BY series_id ORDER BY date ROWS BETWEEN 12 PRECEDING AND 1 PRECEDING)
         THEN 1 ELSE 0 END AS flag
  FROM monthly)"""
EPISODES = [
    ("first", "1995-06-01", "1996-02-29"),
    ("middle", "1997-01-01", "1998-06-30"),
    ("late", "1999-03-01", "2000-01-31"),
    ("outside", "2010-01-01", "2010-12-31"),
]
WINDOWS = "windows AS (SELECT * FROM (VALUES {}) AS t(name, start_date, end_date))".format(
    ", ".join(f"('{n}', DATE '{a}', DATE '{b}')" for n, a, b in EPISODES)
)
RUNS = """runs AS (
  SELECT event_type AS script, ts AS finished_at, value < 100 AS success, event_id FROM events)"""

NEEDS = {"orders", "lineitem", "events", "documents", "pages", "part"}


def tables(spark: SparkSession, sf_dir: str, *names: str) -> None:
    for name in names or NEEDS:
        spark.read.parquet(f"{sf_dir}/{name}.parquet").createOrReplaceTempView(name)


def fixture(spark: SparkSession, sf_dir: str, *ctes: str) -> DataFrame:
    """The last of the given fixtures (CTEs), over the tables that they name."""
    text = " ".join(ctes)
    tables(spark, sf_dir, *[t for t in NEEDS if f"FROM {t}" in text or f"JOIN {t}" in text])
    name = ctes[-1].split(" AS")[0].strip()
    return spark.sql(f"WITH {', '.join(ctes)} SELECT * FROM {name}")


def episodes(spark: SparkSession) -> DataFrame:
    return spark.sql(f"WITH {WINDOWS} SELECT * FROM windows")
