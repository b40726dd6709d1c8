"""Queries of relational basics, ingestion, alignment and series statistics."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import scalar
from ..functions.stored import shared_folder
from ..operators import align as al
from ..operators import breaks as br
from ..operators import expanding as ex
from ..operators import ingest as ing
from ..operators import panel as pn
from ..operators import series as st
from ..sources import observations as src
from ..streaming import refresh
from .fixtures import CURVE, DAILY, FLAGS, MONTHLY, PAIRS, PARTS, QUARTERLY, fixture, tables
from .registry import query

S, D = SparkSession, DataFrame
R = "round({}, 6)".format
OLD = """old AS (
  SELECT concat('ORD.', o_orderpriority) AS series_id, CAST(o_orderdate AS DATE) AS date,
         CAST(sum(CAST(o_totalprice AS DECIMAL(18,2))) AS DOUBLE) / 1234567 AS value
  FROM orders WHERE o_orderkey % 10 <> 0 AND o_orderdate < DATE '2001-01-01' GROUP BY 1, 2)"""
NEW = """new AS (SELECT * FROM daily WHERE date >= DATE '2000-10-03')"""


@query("rolling_spearman", f"""
WITH {MONTHLY}, {PAIRS},
n AS (SELECT *, row_number() OVER (PARTITION BY pair_id ORDER BY date) AS rn FROM pairs),
m AS (SELECT e.pair_id, e.rn AS "end", n.a, n.b, n.date FROM n JOIN n e ON n.pair_id = e.pair_id AND n.rn BETWEEN e.rn - 11 AND e.rn),
r AS (SELECT pair_id, "end", date,
        rank() OVER (PARTITION BY pair_id, "end" ORDER BY a) + (count(*) OVER (PARTITION BY pair_id, "end", a) - 1) / 2.0 AS ra,
        rank() OVER (PARTITION BY pair_id, "end" ORDER BY b) + (count(*) OVER (PARTITION BY pair_id, "end", b) - 1) / 2.0 AS rb FROM m)
SELECT pair_id, max(date) AS date, CASE WHEN count(*) >= 12 THEN {R('corr(ra, rb)')} + 0.0 END AS correlation FROM r GROUP BY pair_id, "end" """)
def rolling_spearman(spark: S, sf: str) -> D:
    return st.rolling_corr(fixture(spark, sf, MONTHLY, PAIRS), 12, "spearman")


@query("rolling_pearson", f"""
WITH {MONTHLY}, {PAIRS}
SELECT pair_id, date, CASE WHEN count(*) OVER w >= 12 THEN {R('corr(a, b) OVER w')} END AS correlation
FROM pairs WINDOW w AS (PARTITION BY pair_id ORDER BY date ROWS BETWEEN 11 PRECEDING AND CURRENT ROW)""")
def rolling_pearson(spark: S, sf: str) -> D:
    return st.rolling_corr(fixture(spark, sf, MONTHLY, PAIRS), 12)


@query("load_series", f"""
WITH {DAILY} SELECT series_id, date, {R('value')} AS value FROM daily WHERE series_id IN ('ORD.1-URGENT', 'ORD.5-LOW') AND date BETWEEN DATE '1996-01-01' AND DATE '1997-12-31'""")
def load_series(spark: S, sf: str) -> D:
    obs = fixture(spark, sf, DAILY).filter(F.col("series_id").isin("ORD.1-URGENT", "ORD.5-LOW"))
    return src.keep_last(obs.filter("date BETWEEN DATE'1996-01-01' AND DATE'1997-12-31'"), ["series_id", "date"], F.col("value"))


@query("observations_json", """
SELECT concat('ev.', user_id) AS series_id, CAST(ts AS DATE) AS date, CASE WHEN event_id % 7 <> 0 THEN round(CAST(event_id AS DOUBLE), 6) END AS value FROM events""")
def observations_json(spark: S, sf: str) -> D:
    tables(spark, sf, "events")
    raw = spark.sql("""SELECT concat('ev.', user_id) AS series_id, to_json(array(named_struct('date', date_format(ts, 'yyyy-MM-dd'),
        'value', CASE WHEN event_id % 7 = 0 THEN '.' ELSE CAST(event_id AS STRING) END))) AS body FROM events""")
    return src.observations_from_json(raw)


@query("observations_sdmx", f"""
WITH {QUARTERLY} SELECT series_id, date, {R('value')} AS value FROM quarterly""")
def observations_sdmx(spark: S, sf: str) -> D:
    q = fixture(spark, sf, QUARTERLY)
    period = F.concat(F.year("date"), F.lit("-Q"), F.quarter("date"))
    rows = q.groupBy("series_id").agg(F.sort_array(F.collect_list(F.struct("date", period.alias("id"), "value"))).alias("r"))
    periods = F.transform("r", lambda x: F.struct(x["id"].alias("id")))
    obs = F.map_from_entries(F.transform("r", lambda x, i: F.struct(i.cast("string").alias("key"), F.array(x["value"]).alias("value"))))
    body = F.to_json(F.struct(
        F.array(F.struct(F.create_map(F.lit("0:0"), F.struct(obs.alias("observations"))).alias("series"))).alias("dataSets"),
        F.struct(F.struct(F.array(F.struct(periods.alias("values"))).alias("observation")).alias("dimensions")).alias("structure"),
    ))
    return src.observations_from_sdmx(rows.select("series_id", body.alias("body")))


@query("merge_revisions", f"""
WITH {DAILY}, {OLD}, {NEW}
SELECT coalesce(o.series_id, n.series_id) AS series_id, coalesce(o.date, n.date) AS date, {R('CASE WHEN n.series_id IS NOT NULL THEN n.value ELSE o.value END')} AS value
FROM old o FULL JOIN new n ON o.series_id = n.series_id AND o.date = n.date""")
def merge_revisions(spark: S, sf: str) -> D:
    return ing.merge_revisions(fixture(spark, sf, OLD), fixture(spark, sf, DAILY, NEW))


@query("revision_counts", f"""
WITH {DAILY}, {OLD}, {NEW}
SELECT n.series_id, CAST(count(*) FILTER (o.series_id IS NULL) AS BIGINT) AS rows_added,
       CAST(count(*) FILTER (o.series_id IS NOT NULL AND o.value IS DISTINCT FROM n.value) AS BIGINT) AS rows_changed
FROM new n LEFT JOIN old o ON o.series_id = n.series_id AND o.date = n.date GROUP BY 1""")
def revision_counts(spark: S, sf: str) -> D:
    return ing.revision_counts(fixture(spark, sf, OLD), fixture(spark, sf, DAILY, NEW))


@query("fetch_plan", f"""
WITH {DAILY}, w AS (SELECT DISTINCT series_id, CASE WHEN series_id < 'ORD.3' THEN 'D' ELSE 'M' END AS frequency FROM daily UNION ALL SELECT 'none', 'M')
SELECT w.series_id, w.frequency, CAST(CAST(max(d.date) - CASE WHEN any_value(w.frequency) = 'D' THEN 90 ELSE 730 END AS DATE) AS VARCHAR) AS start FROM w LEFT JOIN daily d ON d.series_id = w.series_id GROUP BY 1, 2""")
def fetch_plan(spark: S, sf: str) -> D:
    obs = fixture(spark, sf, DAILY)
    wanted = obs.select("series_id").distinct().withColumn("frequency", F.when(F.col("series_id") < "ORD.3", "D").otherwise("M"))
    plan = ing.fetch_plan(obs, wanted.unionByName(spark.createDataFrame([("none", "M")], "series_id string, frequency string")))
    return plan.withColumn("start", F.col("start").cast("string"))


@query("append_stats", """
SELECT event_type AS kind, CAST(user_id AS BIGINT) AS user_id, CAST(max(event_id) AS BIGINT) AS event_id, round(arg_max(value, event_id), 6) AS value FROM events GROUP BY 1, 2""")
def append_stats(spark: S, sf: str) -> D:
    tables(spark, sf, "events")
    e = spark.sql("SELECT event_type AS kind, user_id, event_id, value FROM events")
    return ing.upsert(e.filter("event_id % 2 = 0"), e.filter("event_id % 2 = 1"), ["kind", "user_id"], "event_id")


@query("derive_linear", f"""
WITH {PARTS} SELECT 'A-N+R' AS derived_id, date, {R("sum(CASE WHEN series_id = 'RF.N' THEN -value ELSE value END)")} AS value FROM parts GROUP BY date HAVING count(*) = 3""")
def derive_linear(spark: S, sf: str) -> D:
    terms = spark.createDataFrame([("A-N+R", "RF.A", 1), ("A-N+R", "RF.N", -1), ("A-N+R", "RF.R", 1)], "derived_id string, series_id string, sign int")
    return ing.derive_linear(fixture(spark, sf, PARTS), terms)


FOUND = """found AS (SELECT p_brand AS series_id, CAST(p_size AS INT) AS popularity, CASE p_partkey % 4 WHEN 0 THEN 'A' WHEN 1 THEN 'M' WHEN 2 THEN 'Q' ELSE 'D' END AS frequency FROM part)"""


@query("universe", f"""
WITH {FOUND}, one AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY series_id ORDER BY popularity DESC NULLS LAST, frequency) AS n FROM found) WHERE n = 1)
SELECT frequency, string_agg(series_id, ',' ORDER BY series_id) AS series_ids FROM one WHERE frequency <> 'A' OR popularity >= 50 GROUP BY 1""")
def universe(spark: S, sf: str) -> D:
    return ing.universe(fixture(spark, sf, FOUND), 50).withColumn("series_ids", F.array_join("series_ids", ","))


RELEASES = """releases AS (
  SELECT DISTINCT CAST(CASE WHEN o_orderkey % 3 = 0 THEN -1 ELSE ascii(o_orderpriority) END AS INT) AS release_id, concat('Release ', o_orderpriority) AS release_name,
         CAST(date_trunc('quarter', o_orderdate) AS DATE) AS release_date FROM orders)"""


@query("merge_calendar", f"""
WITH {RELEASES}, u AS (SELECT * FROM releases WHERE release_id >= 0 UNION ALL SELECT -2, 'Council', DATE '1996-04-01' UNION ALL SELECT -2, 'Council', DATE '1996-07-01')
SELECT CAST(release_id AS BIGINT) AS release_id, min(release_name) AS release_name, release_date FROM u GROUP BY 1, 3""")
def merge_calendar(spark: S, sf: str) -> D:
    static = spark.sql("SELECT -2 AS release_id, 'Council' AS release_name, explode(array(DATE'1996-04-01', DATE'1996-07-01')) AS release_date")
    return ing.merge_calendar(fixture(spark, sf, RELEASES), static)


@query("content_hash")
def content_hash(spark: S, sf: str) -> D:
    return ing.content_hash(fixture(spark, sf, DAILY))


BUCKETS = {
    "W": "CAST(date + CAST((5 - isodow(date) + 7) % 7 AS INT) AS DATE)",
    "M": "CAST(date_trunc('month', date) AS DATE)",
    "Q": "CAST(date_trunc('quarter', date) AS DATE)",
    "SA": "CAST(CASE WHEN month(date) > 6 THEN date_trunc('year', date) + INTERVAL 6 MONTH ELSE date_trunc('year', date) END AS DATE)",
    "A": "CAST(date_trunc('year', date) AS DATE)",
}


@query("resample", f"WITH {DAILY} " + " UNION ALL ".join(
    f"SELECT '{f}' AS freq, series_id, {b} AS date, {R('arg_max(value, date)')} AS last, {R('avg(value)')} AS mean FROM daily GROUP BY 1, 2, 3" for f, b in BUCKETS.items()))
def resample(spark: S, sf: str) -> D:
    obs, out = fixture(spark, sf, DAILY), None
    for f in BUCKETS:
        g = obs.groupBy(F.lit(f).alias("freq"), "series_id", al.bucket(F.col("date"), f).alias("date")).agg(F.max_by("value", "date").alias("last"), F.avg("value").alias("mean"))
        out = g if out is None else out.unionByName(g)
    return out


@query("downsample_biweekly", f"""
WITH {DAILY}, w AS (SELECT *, {BUCKETS['W']} AS fri FROM daily)
SELECT series_id, CAST(CASE WHEN (fri - DATE '1970-01-02') % 14 = 7 THEN fri + 7 ELSE fri END AS DATE) AS date, {R('arg_max(value, date)')} AS value FROM w GROUP BY 1, 2""")
def downsample_biweekly(spark: S, sf: str) -> D:
    return al.downsample(fixture(spark, sf, DAILY), "BW")


#: Daily series from the tenth of their year on, a different day of the first year for each.
STAGGERED = "staggered AS (SELECT series_id, date, value FROM daily WHERE date >= DATE '1995-01-10' + (ascii(substr(series_id, 5, 1)) - 48) * 23)"


@query("downsample_anchored", f"""
WITH {DAILY}, {STAGGERED}, f AS (SELECT *, min(date) OVER (PARTITION BY series_id) AS first, date + CAST((12 - dayofweek(date)) % 7 AS INT) AS fri FROM staggered),
g AS (SELECT *, first + CAST((12 - dayofweek(first)) % 7 AS INT) AS fri0, date_trunc('quarter', first) AS q0, date_diff('quarter', date_trunc('quarter', first), date_trunc('quarter', date)) AS dq FROM f),
l AS (SELECT series_id, date, value, CAST(fri0 + 14 * CAST(ceil((fri - fri0) / 14.0) AS INT) AS DATE) AS bw, CAST(q0 + to_months(CAST(6 * (dq // 2) AS INT)) AS DATE) AS sa FROM g)
SELECT 'BW' AS freq, series_id, bw AS date, {R('arg_max(value, date)')} AS value FROM l GROUP BY series_id, bw UNION ALL SELECT 'SA', series_id, sa, {R('avg(value)')} FROM l GROUP BY series_id, sa""")
def downsample_anchored(spark: S, sf: str) -> D:
    obs = fixture(spark, sf, DAILY, STAGGERED)
    one = lambda freq, agg: al.downsample(obs, freq, agg, anchored=True).withColumn("freq", F.lit(freq))
    return one("BW", "last").unionByName(one("SA", "mean"))


@query("upsample_daily", f"""
WITH {MONTHLY}, g AS (SELECT series_id, CAST(unnest(generate_series(min(date), max(date), INTERVAL 1 DAY)) AS DATE) AS date FROM monthly GROUP BY 1)
SELECT g.series_id, g.date, {R('m.value')} AS value FROM g ASOF JOIN monthly m ON g.series_id = m.series_id AND g.date >= m.date WHERE isodow(g.date) < 6""")
def upsample_daily(spark: S, sf: str) -> D:
    return al.upsample_daily(fixture(spark, sf, MONTHLY))


PANEL = """panel AS (
  SELECT 'p1' AS panel_id, 'M' AS freq, series_id, date, value FROM monthly WHERE series_id < 'ORD.3'
  UNION ALL SELECT 'p1', 'Q', series_id, date, value FROM quarterly WHERE series_id > 'Q.3'
  UNION ALL SELECT 'p2', 'M', series_id, date, value FROM monthly)"""


@query("align_coarsest", f"""
WITH {MONTHLY}, {QUARTERLY}, {PANEL}
SELECT panel_id, series_id, CAST(CASE WHEN panel_id = 'p1' THEN date_trunc('quarter', date) ELSE date END AS DATE) AS date, {R('arg_max(value, date)')} AS value FROM panel GROUP BY 1, 2, 3""")
def align_coarsest(spark: S, sf: str) -> D:
    return al.align(fixture(spark, sf, MONTHLY, QUARTERLY, PANEL))


@query("align_finest", f"""
WITH {MONTHLY}, {QUARTERLY}, {PANEL}, d AS (SELECT DISTINCT panel_id, date FROM panel), s AS (SELECT DISTINCT panel_id, series_id FROM panel)
SELECT d.panel_id, s.series_id, d.date, {R('p.value')} AS value FROM d JOIN s ON d.panel_id = s.panel_id
ASOF JOIN panel p ON p.panel_id = d.panel_id AND p.series_id = s.series_id AND d.date >= p.date""")
def align_finest(spark: S, sf: str) -> D:
    return al.align(fixture(spark, sf, MONTHLY, QUARTERLY, PANEL), "finest")


@query("align_complete", f"""
WITH {MONTHLY}, {QUARTERLY}, {PANEL}, d AS (SELECT DISTINCT panel_id, date FROM panel), s AS (SELECT DISTINCT panel_id, series_id FROM panel),
f AS (SELECT d.panel_id, s.series_id, d.date, p.value FROM d JOIN s ON d.panel_id = s.panel_id ASOF JOIN panel p ON p.panel_id = d.panel_id AND p.series_id = s.series_id AND d.date >= p.date)
SELECT panel_id, series_id, date, {R('value')} AS value FROM f WHERE (panel_id, date) IN (SELECT (g.panel_id, g.date) FROM f g GROUP BY g.panel_id, g.date HAVING count(*) = (SELECT count(*) FROM s WHERE s.panel_id = g.panel_id))""")
def align_complete(spark: S, sf: str) -> D:
    return al.align(fixture(spark, sf, MONTHLY, QUARTERLY, PANEL), "finest", dropna="any")


@query("available_series", f"WITH {DAILY} SELECT DISTINCT series_id FROM daily WHERE series_id < 'ORD.4'")
def available_series(spark: S, sf: str) -> D:
    meta = fixture(spark, sf, DAILY).groupBy("series_id").agg(F.max("date").alias("last")).withColumn("partition", F.when(F.col("series_id") < "ORD.4", "high").otherwise("low"))
    return src.available_series(meta, "high")


@query("refresh_log", f"""
WITH {DAILY}, {OLD}, {NEW}, m AS (SELECT coalesce(o.series_id, n.series_id) AS series_id, coalesce(o.date, n.date) AS date FROM old o FULL JOIN new n ON o.series_id = n.series_id AND o.date = n.date)
SELECT series_id, max(date) AS last_observation_date, DATE '2024-05-01' AS last_fetched_at, true AS stamped FROM m WHERE series_id IN (SELECT series_id FROM new) GROUP BY 1""")
def refresh_log(spark: S, sf: str) -> D:
    old, new = fixture(spark, sf, OLD), fixture(spark, sf, DAILY, NEW)
    meta = old.select("series_id").distinct().withColumn("last_refreshed", F.lit(None).cast("date"))
    log = spark.createDataFrame([], "series_id string, last_fetched_at date, last_observation_date date, last_value_hash string")
    _, stamped, log = ing.refresh(old, new, meta, log, F.lit("2024-05-01").cast("date"))
    done = stamped.filter("last_refreshed = DATE '2024-05-01'").select("series_id", F.lit(True).alias("stamped"))
    return log.filter("length(last_value_hash) = 64").join(done.hint("merge"), "series_id").drop("last_value_hash")


@query("refresh_stream", f"""
WITH {DAILY}, {OLD}, {NEW}, m AS (SELECT coalesce(o.series_id, n.series_id) AS series_id, coalesce(o.date, n.date) AS date, CASE WHEN n.date IS NOT NULL THEN n.value ELSE o.value END AS value, n.date IS NOT NULL AS came
  FROM old o FULL JOIN new n ON o.series_id = n.series_id AND o.date = n.date)
SELECT series_id, CAST(count(*) AS BIGINT) AS n, {R('sum(value)')} AS total, max(date) AS last_observation_date, CASE WHEN bool_or(came) THEN DATE '2024-05-02' ELSE DATE '2024-05-01' END AS last_fetched_at, true AS whole,
  CAST((SELECT count(*) FROM new n LEFT JOIN old o ON o.series_id = n.series_id AND o.date = n.date WHERE o.date IS NULL) AS BIGINT) AS rows_added,
  CAST((SELECT count(*) FROM new n JOIN old o ON o.series_id = n.series_id AND o.date = n.date WHERE o.value IS DISTINCT FROM n.value) AS BIGINT) AS rows_changed
FROM m GROUP BY 1""")
def refresh_stream(spark: S, sf: str) -> D:
    """Two landed files, of two days, taken by the stream one after the other; whole: the log's hash is that of the stored rows."""
    store = f"{shared_folder(spark)}/refresh-{uuid.uuid4().hex}"
    for at, landed in ((1, fixture(spark, sf, OLD)), (2, fixture(spark, sf, DAILY, NEW))):
        arrived = F.lit(f"2024-05-0{at} 06:00:00").cast("timestamp")
        landed.withColumn("arrived", arrived).write.mode("append").json(f"{store}/landing")
        refresh.start(spark, f"{store}/landing", f"{store}/store", f"{store}/checkpoint", buckets=4).awaitTermination()
    kept = refresh.stored(spark, f"{store}/store", "observations")
    totals = kept.groupBy("series_id").agg(F.sum("value").alias("total"))
    hashes = ing.content_hash(kept).select("series_id", "content_hash")
    log = refresh.update_log(spark, f"{store}/store").join(totals.hint("merge"), "series_id").join(hashes.hint("merge"), "series_id")
    last = refresh.stored(spark, f"{store}/store", "commits").filter("batch = 1").select("rows_added", "rows_changed").first()
    return log.select(
        "series_id", "n", "total", "last_observation_date", F.col("last_fetched_at").cast("date").alias("last_fetched_at"), (F.col("content_hash") == F.col("last_value_hash")).alias("whole"),
        F.lit(last.rows_added).alias("rows_added"), F.lit(last.rows_changed).alias("rows_changed"),
    )


@query("returns", f"""
WITH {MONTHLY} SELECT series_id, date, {R('value / nullif(lag(value) OVER w, 0) - 1')} AS pct, {R('value / nullif(lag(value, 12) OVER w, 0) - 1')} AS yoy,
 {R('ln(value) - ln(lag(value) OVER w)')} AS log, {R('value - lag(value) OVER w')} AS diff FROM monthly WINDOW w AS (PARTITION BY series_id ORDER BY date)""")
def returns(spark: S, sf: str) -> D:
    m = fixture(spark, sf, MONTHLY)
    one = lambda kind, name, n=1: al.returns(m, kind, n).withColumnRenamed("value", name)
    out = one("pct", "pct")
    for kind, name, n in (("pct", "yoy", 12), ("log", "log", 1), ("diff", "diff", 1)):
        out = out.join(one(kind, name, n), ["series_id", "date"])
    return out


@query("normalize", f"""
WITH {MONTHLY} SELECT series_id, date, {R('(value - avg(value) OVER s) / stddev_samp(value) OVER s')} AS z, {R('100 * value / first_value(value) OVER (PARTITION BY series_id ORDER BY date)')} AS idx
FROM monthly WINDOW s AS (PARTITION BY series_id)""")
def normalize(spark: S, sf: str) -> D:
    m = fixture(spark, sf, MONTHLY)
    return al.normalize(m).withColumnRenamed("value", "z").join(al.normalize(m, "index").withColumnRenamed("value", "idx"), ["series_id", "date"])


@query("infer_frequency", f"""
WITH {MONTHLY}, {DAILY}, u AS (SELECT * FROM monthly UNION ALL SELECT concat('D.', series_id), date, value FROM daily),
g AS (SELECT series_id, date - lag(date) OVER (PARTITION BY series_id ORDER BY date) AS gap FROM u), m AS (SELECT series_id, quantile_cont(gap, 0.5) AS m FROM g GROUP BY 1)
SELECT series_id, {R('CAST(m AS DOUBLE)')} AS median_gap, m <= 7 AS is_daily, CAST(CASE WHEN m < 5 THEN 252 WHEN m < 15 THEN 52 WHEN m < 45 THEN 12 ELSE 4 END AS BIGINT) AS rows_a_year FROM m""")
def infer_frequency(spark: S, sf: str) -> D:
    d = fixture(spark, sf, DAILY).withColumn("series_id", F.concat(F.lit("D."), "series_id"))
    return al.infer_frequency(fixture(spark, sf, MONTHLY).unionByName(d))


@query("nearest_join", f"""
WITH {DAILY}, e AS (SELECT DISTINCT CAST(date_trunc('month', date) + INTERVAL 14 DAY AS DATE) AS event_date FROM daily)
SELECT e.event_date, d.series_id, arg_min(d.date, abs(d.date - e.event_date) * 10 + CASE WHEN d.date > e.event_date THEN 1 ELSE 0 END) AS actual_date,
 {R('arg_min(d.value, abs(d.date - e.event_date) * 10 + CASE WHEN d.date > e.event_date THEN 1 ELSE 0 END)')} AS value
FROM e JOIN daily d ON d.date BETWEEN e.event_date - 1 AND e.event_date + 1 GROUP BY 1, 2""")
def nearest_join(spark: S, sf: str) -> D:
    obs = fixture(spark, sf, DAILY)
    e = obs.select(F.date_add(F.trunc("date", "MM"), 14).alias("event_date")).distinct()
    return al.nearest(e, obs)


@query("asof_join", f"""
WITH {MONTHLY}, {DAILY} SELECT d.series_id, d.date, {R('d.value')} AS value, {R('m.value')} AS asof_value, m.date AS asof_date
FROM daily d ASOF LEFT JOIN monthly m ON d.series_id = m.series_id AND d.date >= m.date""")
def asof_join(spark: S, sf: str) -> D:
    return al.asof(fixture(spark, sf, DAILY), fixture(spark, sf, MONTHLY), ["series_id"])


@query("rolling_stats", f"""
WITH {MONTHLY} SELECT series_id, date, {R('value')} AS value, {', '.join(f"CASE WHEN count(*) OVER w >= 6 THEN {R(f + '(value) OVER w')} END AS roll_{n}" for n, f in (('mean', 'avg'), ('min', 'min'), ('max', 'max'), ('std', 'stddev_samp')))}
FROM monthly WINDOW w AS (PARTITION BY series_id ORDER BY date ROWS BETWEEN 11 PRECEDING AND CURRENT ROW)""")
def rolling_stats(spark: S, sf: str) -> D:
    return st.rolling(fixture(spark, sf, MONTHLY), 12, 6)


@query("rolling_vol", f"""
WITH {MONTHLY}, r AS (SELECT series_id, date, ln(value) - ln(lag(value) OVER (PARTITION BY series_id ORDER BY date)) AS value FROM monthly)
SELECT series_id, date, {R('value')} AS value, CASE WHEN count(value) OVER w >= 12 THEN {R('sqrt(12) * stddev_samp(value) OVER w')} END AS vol
FROM r WINDOW w AS (PARTITION BY series_id ORDER BY date ROWS BETWEEN 11 PRECEDING AND CURRENT ROW)""")
def rolling_vol(spark: S, sf: str) -> D:
    return st.rolling_vol(al.returns(fixture(spark, sf, MONTHLY), "log"), 12, 12)


def _avg_rank(x: str, by: str) -> str:
    return f"rank() OVER (PARTITION BY {by} ORDER BY {x}) + (count(*) OVER (PARTITION BY {by}, {x}) - 1) / 2.0"


@query("corr_stability", f"""
WITH {MONTHLY}, {PAIRS}, n AS (SELECT *, row_number() OVER (PARTITION BY pair_id ORDER BY date) - 1 AS rn, count(*) OVER (PARTITION BY pair_id) AS n FROM pairs),
p AS (SELECT *, CASE WHEN rn >= floor(n * 3 / 4.0) THEN 3 WHEN rn >= floor(n * 2 / 4.0) THEN 2 WHEN rn >= floor(n / 4.0) THEN 1 ELSE 0 END AS part FROM n),
f AS (SELECT pair_id, corr(ra, rb) AS c FROM (SELECT pair_id, {_avg_rank('a', 'pair_id')} AS ra, {_avg_rank('b', 'pair_id')} AS rb FROM p) GROUP BY 1),
s AS (SELECT pair_id, part, corr(ra, rb) AS c FROM (SELECT pair_id, part, {_avg_rank('a', 'pair_id, part')} AS ra, {_avg_rank('b', 'pair_id, part')} AS rb FROM p) GROUP BY 1, 2)
SELECT f.pair_id, {R('any_value(f.c)')} AS full_corr, {R('max(s.c)')} AS max_corr, {R('min(s.c)')} AS min_corr, {R('max(s.c) - min(s.c)')} AS spread FROM f JOIN s ON f.pair_id = s.pair_id GROUP BY 1""")
def corr_stability(spark: S, sf: str) -> D:
    return st.corr_stability(fixture(spark, sf, MONTHLY, PAIRS))


def _latest(robust: bool, lookback: int | None) -> str:
    cut = f"WHERE back <= {lookback}" if lookback else ""
    scale = "(SELECT series_id, any_value(med) AS c, 1.4826 * quantile_cont(abs(value - med), 0.5) AS s FROM (SELECT *, (SELECT quantile_cont(value, 0.5) FROM h h2 WHERE h2.series_id = h.series_id) AS med FROM h) GROUP BY 1)" if robust else "(SELECT series_id, avg(value) AS c, stddev_samp(value) AS s FROM h GROUP BY 1)"
    return f"""
WITH {DAILY}, h AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY series_id ORDER BY date DESC) AS back FROM daily) {cut}),
l AS (SELECT series_id, max(date) AS date, arg_max(value, date) AS v, count(*) AS n FROM h GROUP BY 1),
p AS (SELECT h.series_id, avg(CASE WHEN h.value <= l.v THEN 1.0 ELSE 0.0 END) AS p FROM h JOIN l ON h.series_id = l.series_id GROUP BY 1)
SELECT l.series_id, l.date, {R('l.v')} AS value, CAST(l.n AS BIGINT) AS n, {R('(l.v - x.c) / x.s')} AS z, {R('p.p')} AS percentile
FROM l JOIN {scale} x ON l.series_id = x.series_id JOIN p ON l.series_id = p.series_id"""


@query("zscore_latest", _latest(False, 252))
def zscore_latest(spark: S, sf: str) -> D:
    return st.latest_stats(fixture(spark, sf, DAILY), 252)


@query("zscore_latest_robust", _latest(True, None))
def zscore_latest_robust(spark: S, sf: str) -> D:
    return st.latest_stats(fixture(spark, sf, DAILY), robust=True)


LEADLAG = f"""
WITH {MONTHLY}, {PAIRS}, n AS (SELECT *, row_number() OVER (PARTITION BY pair_id ORDER BY date) AS rn FROM pairs), l AS (SELECT unnest(range(-6, 7)) AS lag),
j AS (SELECT x.pair_id, l.lag, x.a, y.b FROM n x JOIN l ON true JOIN n y ON x.pair_id = y.pair_id AND y.rn = x.rn + l.lag)"""


@query("lead_lag", f"{LEADLAG} SELECT pair_id, CAST(lag AS BIGINT) AS lag, CAST(count(*) AS BIGINT) AS n, {R('corr(a, b)')} AS correlation FROM j GROUP BY 1, 2")
def lead_lag(spark: S, sf: str) -> D:
    return st.lead_lag(fixture(spark, sf, MONTHLY, PAIRS), 6)


@query("lead_lag_spearman", f"{LEADLAG}, r AS (SELECT pair_id, lag, {_avg_rank('a', 'pair_id, lag')} AS ra, {_avg_rank('b', 'pair_id, lag')} AS rb FROM j) SELECT pair_id, CAST(lag AS BIGINT) AS lag, CAST(count(*) AS BIGINT) AS n, {R('corr(ra, rb)')} AS correlation FROM r GROUP BY 1, 2")
def lead_lag_spearman(spark: S, sf: str) -> D:
    return st.lead_lag(fixture(spark, sf, MONTHLY, PAIRS), 6, "spearman")


@query("peak_lag", f"{LEADLAG}, c AS (SELECT pair_id, lag, corr(a, b) AS c FROM j GROUP BY 1, 2) SELECT pair_id, CAST(lag AS BIGINT) AS lag, {R('c')} AS correlation FROM (SELECT *, row_number() OVER (PARTITION BY pair_id ORDER BY abs(c) DESC, abs(lag), lag) AS k FROM c) WHERE k = 1")
def peak_lag(spark: S, sf: str) -> D:
    return st.peak_lag(st.lead_lag(fixture(spark, sf, MONTHLY, PAIRS), 6))


REGIMES = f"""
WITH {MONTHLY}, q AS (SELECT series_id, quantile_cont(value, 0.33) AS q1, quantile_cont(value, 0.67) AS q2 FROM monthly GROUP BY 1),
g AS (SELECT m.*, CASE WHEN value <= q1 THEN 'low' WHEN value <= q2 THEN 'mid' ELSE 'high' END AS regime FROM monthly m JOIN q ON m.series_id = q.series_id)"""


def _regimes(spark: S, sf: str) -> D:
    return st.quantile_regime(fixture(spark, sf, MONTHLY), [0.33, 0.67], ["low", "mid", "high"])


@query("quantile_regime", f"{REGIMES} SELECT series_id, date, {R('value')} AS value, regime FROM g")
def quantile_regime(spark: S, sf: str) -> D:
    return _regimes(spark, sf)


@query("transition_matrix", f"""{REGIMES}, m AS (SELECT series_id, regime AS from_state, lead(regime) OVER (PARTITION BY series_id ORDER BY date) AS to_state FROM g),
s AS (SELECT DISTINCT series_id, regime FROM g), c AS (SELECT a.series_id, a.regime AS from_state, b.regime AS to_state, count(m.series_id) AS n FROM s a JOIN s b ON a.series_id = b.series_id
  LEFT JOIN m ON m.series_id = a.series_id AND m.from_state = a.regime AND m.to_state = b.regime GROUP BY 1, 2, 3)
SELECT series_id, from_state, to_state, CAST(n AS BIGINT) AS n, {R('n / nullif(sum(n) OVER (PARTITION BY series_id, from_state), 0)')} AS probability FROM c""")
def transition_matrix(spark: S, sf: str) -> D:
    return st.transitions(_regimes(spark, sf))


@query("rolling_percentile", f"""
WITH {MONTHLY}, n AS (SELECT *, row_number() OVER (PARTITION BY series_id ORDER BY date) AS rn FROM monthly)
SELECT e.series_id, e.date, CASE WHEN count(*) >= 12 THEN {R('avg(CASE WHEN n.value <= e.value THEN 1.0 ELSE 0.0 END) FILTER (n.rn < e.rn)')} END AS percentile
FROM n JOIN n e ON n.series_id = e.series_id AND n.rn BETWEEN e.rn - 23 AND e.rn GROUP BY 1, 2""")
def rolling_percentile(spark: S, sf: str) -> D:
    return st.rolling_percentile(fixture(spark, sf, MONTHLY), 24)


@query("rolling_zscore", f"""
WITH {MONTHLY} SELECT series_id, date, {R('value')} AS value, CASE WHEN count(*) OVER w >= 12 THEN {R('(value - avg(value) OVER w) / nullif(stddev_samp(value) OVER w, 0)')} END AS z
FROM monthly WINDOW w AS (PARTITION BY series_id ORDER BY date ROWS BETWEEN 11 PRECEDING AND CURRENT ROW)""")
def rolling_zscore(spark: S, sf: str) -> D:
    return st.rolling_zscore(fixture(spark, sf, MONTHLY), 12)


@query("expanding_robust", f"""
WITH {MONTHLY}, n AS (SELECT *, row_number() OVER (PARTITION BY series_id ORDER BY date) AS rn FROM monthly),
j AS (SELECT e.series_id, e.date, e.rn, e.value, n.value AS v FROM n e JOIN n ON n.series_id = e.series_id AND n.rn <= e.rn WHERE e.rn >= 24),
m AS (SELECT series_id, rn, quantile_cont(v, 0.5) AS med FROM j GROUP BY 1, 2)
SELECT j.series_id, j.date, {R('(any_value(j.value) - any_value(m.med)) / greatest(1.4826 * quantile_cont(abs(j.v - m.med), 0.5), 1e-9)')} AS robust_z,
 {R('avg(CASE WHEN j.v < j.value THEN 1.0 ELSE 0.0 END)')} AS percentile FROM j JOIN m ON j.series_id = m.series_id AND j.rn = m.rn GROUP BY 1, 2""")
def expanding_robust(spark: S, sf: str) -> D:
    return ex.expanding(fixture(spark, sf, MONTHLY))


@query("expanding_robust_daily", f"""
WITH {DAILY}, n AS (SELECT *, row_number() OVER (PARTITION BY series_id ORDER BY date) AS rn FROM daily),
j AS (SELECT e.series_id, e.date, e.rn, e.value, n.value AS v FROM n e JOIN n ON n.series_id = e.series_id AND n.rn <= e.rn WHERE e.rn >= 24),
m AS (SELECT series_id, rn, quantile_cont(v, 0.5) AS med FROM j GROUP BY 1, 2)
SELECT j.series_id, j.date, {R('(any_value(j.value) - any_value(m.med)) / greatest(1.4826 * quantile_cont(abs(j.v - m.med), 0.5), 1e-9)')} AS robust_z,
 {R('avg(CASE WHEN j.v < j.value THEN 1.0 ELSE 0.0 END)')} AS percentile FROM j JOIN m ON j.series_id = m.series_id AND j.rn = m.rn GROUP BY 1, 2""")
def expanding_robust_daily(spark: S, sf: str) -> D:
    return ex.expanding(fixture(spark, sf, DAILY))


@query("detect_jumps", f"""
WITH {DAILY}, c AS (SELECT series_id, date, value - lag(value) OVER (PARTITION BY series_id ORDER BY date) AS change FROM daily), d AS (SELECT * FROM c WHERE change IS NOT NULL),
b AS (SELECT *, abs(change) * abs(lag(change) OVER (PARTITION BY series_id ORDER BY date)) AS bip, max(date) OVER (PARTITION BY series_id) AS last FROM d),
s AS (SELECT *, CASE WHEN count(bip) OVER w >= 30 THEN sqrt(pi() / 2 * avg(bip) OVER w) END AS sigma FROM b WINDOW w AS (PARTITION BY series_id ORDER BY date ROWS BETWEEN 59 PRECEDING AND CURRENT ROW))
SELECT series_id, date, {R('change')} AS change, {R('change / sigma')} AS z, date >= last - 365 AS is_recent FROM s WHERE abs(change / sigma) >= 2.5""")
def detect_jumps(spark: S, sf: str) -> D:
    return st.jumps(fixture(spark, sf, DAILY), threshold=2.5)


def _levels(most: int) -> str:
    """The best segmentations with up to so many breaks, each from the ones with a break less."""
    step = "SELECT c.series_id, c.j, c.n, min(b.rss + c.cost) AS rss, arg_min(list_append(b.brk, c.i), b.rss + c.cost) AS brk FROM c JOIN b{} b ON b.series_id = c.series_id AND b.j = c.i GROUP BY 1, 2, 3"
    return ", ".join(["b0 AS (SELECT series_id, j, n, cost AS rss, CAST([] AS BIGINT[]) AS brk FROM c WHERE i = 0)", *[f"b{k} AS ({step.format(k - 1)})" for k in range(1, most + 1)]])


def break_ctes(source: str, most: int = 5) -> str:
    """The table ``source`` (series_id, date, value) to best (series_id, k, n, rss, bic, brk, dates, best)."""
    return f"""
bp AS (SELECT series_id, row_number() OVER w AS j, count(*) OVER (PARTITION BY series_id) AS n, sum(x) OVER w AS s1, sum(x * x) OVER w AS s2
  FROM (SELECT series_id, date, value - avg(value) OVER (PARTITION BY series_id) AS x FROM {source}) WINDOW w AS (PARTITION BY series_id ORDER BY date ROWS UNBOUNDED PRECEDING)),
bz AS (SELECT series_id, j AS i, s1 AS t1, s2 AS t2 FROM bp UNION ALL SELECT DISTINCT series_id, 0, 0.0, 0.0 FROM bp),
c AS (SELECT p.series_id, z.i, p.j, p.n, greatest(s2 - t2 - (s1 - t1) * (s1 - t1) / (p.j - z.i), 0) AS cost FROM bp p JOIN bz z ON p.series_id = z.series_id AND p.j - z.i >= greatest(p.n // {most + 2}, 3) WHERE p.n >= 10),
{_levels(most)}, ba AS ({' UNION ALL '.join(f'SELECT {k} AS k, * FROM b{k} WHERE j = n' for k in range(most + 1))}),
br AS (SELECT *, n * ln(greatest(rss, 1e-12) / n) + (k + 1) * ln(n) AS bic FROM ba),
bd AS (SELECT series_id, list(date ORDER BY date) AS d FROM {source} GROUP BY 1),
best AS (SELECT br.*, list_transform(brk, lambda i: CAST(d[i + 1] AS VARCHAR)) AS dates, row_number() OVER (PARTITION BY br.series_id ORDER BY bic, k) = 1 AS best FROM br JOIN bd ON br.series_id = bd.series_id)"""


def stats_ctes(source: str) -> str:
    """After break_ctes(): rs (series_id, regime, since, until, n, mean, std) of the best segmentation."""
    return f"""
rr AS (SELECT series_id, date, value, row_number() OVER (PARTITION BY series_id ORDER BY date) AS rn FROM {source}),
rl AS (SELECT rr.*, len(list_filter(brk, lambda b: b < rn)) AS regime FROM rr JOIN best ON rr.series_id = best.series_id AND best.best),
rs AS (SELECT series_id, regime, min(date) AS since, max(date) AS until, count(*) AS n, avg(value) AS mean, stddev_samp(value) AS std FROM rl GROUP BY 1, 2)"""


#: Daily series with a step in all but one.
STEPPED = """stepped AS (
  SELECT series_id, date, value + CASE WHEN date >= DATE '1998-06-01' AND series_id <> 'ORD.1-URGENT' THEN 0.3 ELSE 0.0 END AS value FROM daily)"""


@query("structural_breaks", f"""
WITH {MONTHLY}, {break_ctes("monthly")}
SELECT series_id, CAST(k AS BIGINT) AS k, CAST(n AS BIGINT) AS n, {R('rss')} AS rss, {R('bic')} AS bic, coalesce(array_to_string(brk, ','), '') AS breaks, coalesce(array_to_string(dates, ','), '') AS break_dates, best FROM best""")
def structural_breaks(spark: S, sf: str) -> D:
    return _shown_breaks(br.structural_breaks(fixture(spark, sf, MONTHLY)))


def _shown_breaks(b: D) -> D:
    return b.withColumns({c: F.array_join(F.col(c).cast("array<string>"), ",") for c in ("breaks", "break_dates")})


@query("structural_breaks_daily", f"""
WITH {DAILY}, {STEPPED}, {break_ctes("stepped", 3)}
SELECT series_id, CAST(k AS BIGINT) AS k, CAST(n AS BIGINT) AS n, {R('rss')} AS rss, {R('bic')} AS bic, coalesce(array_to_string(brk, ','), '') AS breaks, coalesce(array_to_string(dates, ','), '') AS break_dates, best FROM best""")
def structural_breaks_daily(spark: S, sf: str) -> D:
    return _shown_breaks(br.structural_breaks(fixture(spark, sf, DAILY, STEPPED), 3))


@query("break_regimes", f"""
WITH {DAILY}, {STEPPED}, {break_ctes("stepped", 3)}, {stats_ctes("stepped")}
SELECT series_id, CAST(regime AS BIGINT) AS regime, since, until, CAST(n AS BIGINT) AS n, {R('mean')} AS mean, {R('std')} AS std FROM rs""")
def break_regimes(spark: S, sf: str) -> D:
    obs = fixture(spark, sf, DAILY, STEPPED)
    return br.regime_stats(br.regimes(obs, br.structural_breaks(obs, 3)))


@query("corr_matrix", f"""
WITH {MONTHLY} SELECT x.series_id AS a, y.series_id AS b, CAST(count(*) AS BIGINT) AS n, {R('corr(x.value, y.value)')} AS correlation FROM monthly x JOIN monthly y ON x.date = y.date AND x.series_id < y.series_id GROUP BY 1, 2""")
def corr_matrix(spark: S, sf: str) -> D:
    return pn.corr_matrix(fixture(spark, sf, MONTHLY))


#: A series for each supplier and line number: some thousands, most with gaps.
SUPPLIED = """supplied AS (
  SELECT concat('S', l_suppkey, '.', l_linenumber) AS series_id, CAST(date_trunc('month', l_shipdate) AS DATE) AS date,
         CAST(sum(CAST(l_quantity AS DECIMAL(18,2))) AS DOUBLE) AS value
  FROM lineitem GROUP BY 1, 2)"""


@query("corr_matrix_wide", f"""
WITH {SUPPLIED}, m AS (SELECT x.series_id AS a, y.series_id AS b, count(*) AS n, covar_pop(x.value, y.value) AS c, stddev_pop(x.value) AS sx, stddev_pop(y.value) AS sy
  FROM supplied x JOIN supplied y ON x.date = y.date AND x.series_id < y.series_id GROUP BY 1, 2)
SELECT a, b, CAST(n AS BIGINT) AS n, CASE WHEN sx > 1e-9 AND sy > 1e-9 THEN {R('c / (sx * sy)')} END AS correlation FROM m""")
def corr_matrix_wide(spark: S, sf: str) -> D:
    return pn.corr_matrix(fixture(spark, sf, SUPPLIED))


@query("histogram", f"""
WITH {DAILY}, s AS (SELECT series_id, min(value) AS lo, max(value) AS hi FROM daily GROUP BY 1)
SELECT d.series_id, CAST(least(floor((value - lo) / ((hi - lo) / 20)) + 1, 20) AS BIGINT) AS bin, CAST(count(*) AS BIGINT) AS n FROM daily d JOIN s ON d.series_id = s.series_id GROUP BY 1, 2""")
def histogram(spark: S, sf: str) -> D:
    return st.histogram(fixture(spark, sf, DAILY), 20)


@query("pca_loadings")
def pca_loadings(spark: S, sf: str) -> D:
    c = fixture(spark, sf, CURVE)
    wide = c.groupBy("date").pivot("tenor", list(range(1, 8))).agg(F.first("value")).withColumnsRenamed({str(i): f"t{i}" for i in range(1, 8)})
    return st.pca(wide, [f"t{i}" for i in range(1, 8)], 3)[0]


@query("flag_series", f"WITH {MONTHLY}, {FLAGS} SELECT series_id, date, CAST(flag AS BIGINT) AS flag FROM flags")
def flag_series(spark: S, sf: str) -> D:
    return fixture(spark, sf, MONTHLY, FLAGS)


@query("scalar_dates", f"""
WITH {DAILY} SELECT DISTINCT date, CAST(date_trunc('month', date) AS DATE) AS month_start, last_day(date) AS month_end, {BUCKETS['Q']} AS quarter_start, {BUCKETS['A']} AS year_start,
 {BUCKETS['W']} AS week_end, CAST(date + INTERVAL 3 MONTH AS DATE) AS in_three_months FROM daily""")
def scalar_dates(spark: S, sf: str) -> D:
    return scalar.date_parts(fixture(spark, sf, DAILY).select("date").distinct())


@query("scalar_slugs", """SELECT DISTINCT p_name, regexp_replace(regexp_replace(lower(p_name), '[^a-z0-9]+', '-', 'g'), '^-|-$', '', 'g') AS slug,
 CASE WHEN length(p_name) > 12 THEN concat(substr(p_name, 1, 12), '…') ELSE p_name END AS short FROM part""")
def scalar_slugs(spark: S, sf: str) -> D:
    tables(spark, sf, "part")
    return spark.table("part").select("p_name", scalar.slug(F.col("p_name")).alias("slug"), scalar.truncate(F.col("p_name"), 12).alias("short")).distinct()


@query("grouped_quantiles", f"""
WITH {DAILY} SELECT series_id, CAST(count(*) AS BIGINT) AS n, CAST(count(DISTINCT date) AS BIGINT) AS days, {R('avg(value)')} AS mean, {R('min(value)')} AS min, {R('max(value)')} AS max, {R('stddev_samp(value)')} AS std,
 {R('quantile_cont(value, 0.5)')} AS median, {R('quantile_cont(value, 0.25)')} AS p25, {R('quantile_cont(value, 0.75)')} AS p75 FROM daily GROUP BY 1""")
def grouped_quantiles(spark: S, sf: str) -> D:
    q = lambda p: F.percentile("value", F.lit(p))
    return fixture(spark, sf, DAILY).groupBy("series_id").agg(
        F.count("*").alias("n"), F.countDistinct("date").alias("days"), F.avg("value").alias("mean"), F.min("value").alias("min"), F.max("value").alias("max"), F.stddev_samp("value").alias("std"),
        q(0.5).alias("median"), q(0.25).alias("p25"), q(0.75).alias("p75"),
    )


@query("tail_thinned", f"""
WITH {DAILY}, r AS (SELECT *, row_number() OVER (PARTITION BY series_id ORDER BY date DESC) AS back FROM daily)
SELECT series_id, date, {R('value')} AS value FROM r WHERE back <= 250 AND (back - 1) % 5 = 0""")
def tail_thinned(spark: S, sf: str) -> D:
    w = Window.partitionBy("series_id").orderBy(F.desc("date"))
    d = fixture(spark, sf, DAILY).withColumn("back", F.row_number().over(w))
    return d.filter((F.col("back") <= 250) & ((F.col("back") - 1) % 5 == 0)).drop("back")
