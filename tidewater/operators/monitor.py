"""Health of jobs and freshness of data."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def job_health(runs: DataFrame, as_of: Column, stale_hours: int = 30, limits: dict[str, int] | None = None) -> DataFrame:
    """script, last_run, last_success, runs, trailing_failures, status of every job; limits: hours of jobs that have
    other ones than the rest."""
    success = F.when(F.col("success"), F.col("finished_at"))
    g = runs.groupBy("script").agg(F.max("finished_at").alias("last_run"), F.max(success).alias("last_success"), F.count("*").alias("runs"))
    late = runs.join(g.select("script", "last_success"), "script").filter(~F.col("success") & (F.col("last_success").isNull() | (F.col("finished_at") > F.col("last_success"))))
    fails = late.groupBy("script").agg(F.count("*").alias("f"))
    d = g.join(fails, "script", "left").withColumn("trailing_failures", F.coalesce("f", F.lit(0).cast("bigint"))).drop("f")
    hours = (F.unix_timestamp(as_of) - F.unix_timestamp("last_run")) / 3600
    most = F.lit(stale_hours)
    for script, limit in (limits or {}).items():
        most = F.when(F.col("script") == script, limit).otherwise(most)
    status = F.when(F.col("trailing_failures") >= 3, "error").when((F.col("trailing_failures") >= 1) | (hours > most), "warn").otherwise("ok")
    return d.withColumn("status", status)


def freshness(obs: DataFrame, as_of: Column) -> DataFrame:
    """One row: series, stale_1d, stale_7d, oldest, newest, status."""
    last = obs.groupBy("series_id").agg(F.max("date").alias("d"))
    age = F.datediff(as_of, F.col("d"))
    g = last.agg(F.count("*").alias("series"), F.count_if(age > 1).alias("stale_1d"), F.count_if(age > 7).alias("stale_7d"), F.min("d").alias("oldest"), F.max("d").alias("newest"))
    share = F.col("stale_7d") / F.nullif("series", F.lit(0))
    return g.withColumn("status", F.when(share > 0.3, "error").when(share > 0.1, "warn").otherwise("ok"))


def backlog(findings: DataFrame, as_of: Column) -> DataFrame:
    """kind, n, recent (last seven days), worst severity rank of findings."""
    return findings.groupBy("kind").agg(F.count("*").alias("n"), F.count_if(F.col("discovered") > F.date_sub(as_of, 7)).alias("recent"), F.max("score").alias("top_score"))


#: Statuses from good to bad.
SEVERITY = ["ok", "never_run", "no_findings", "warn", "error"]


def findings_health(findings: DataFrame, as_of: Column, days: int = 7) -> DataFrame:
    """One row: total, new_unsent, taught, sourced, added, status of findings (status, discovered, sources)."""
    web = F.exists("sources", lambda s: F.contains(s, F.lit("http")))
    g = findings.agg(
        F.count("*").alias("total"), F.count_if(F.col("status") == "new").alias("new_unsent"), F.count_if(F.startswith("status", F.lit("taught"))).alias("taught"),
        F.count_if(F.coalesce(web, F.lit(False))).alias("sourced"), F.count_if(F.col("discovered") >= F.date_sub(as_of, days)).alias("added"),
    )
    return g.withColumn("status", F.when(F.col("total") > 0, "ok").otherwise("no_findings"))


def lessons_health(lessons: DataFrame, as_of: Column, days: int = 7, silent: int = 5) -> DataFrame:
    """One row: total, last_sent, sent (in the last days), status of lessons (date); warn after so many silent days."""
    g = lessons.agg(F.count("*").alias("total"), F.max("date").alias("last_sent"), F.count_if(F.col("date") >= F.date_sub(as_of, days)).alias("sent"))
    late = F.col("last_sent").isNull() | (F.col("last_sent") < F.date_sub(as_of, silent))
    return g.withColumn("status", F.when(late, "warn").otherwise("ok"))


def harvest_health(harvests: DataFrame, as_of: Column, days: int = 7) -> DataFrame:
    """One row: total, last_run, added (findings of the last days), status of harvests (date, n_findings)."""
    now = F.col("date") >= F.date_sub(as_of, days)
    g = harvests.agg(F.count("*").alias("total"), F.max("date").alias("last_run"), F.coalesce(F.sum(F.when(now, F.col("n_findings"))), F.lit(0)).cast("bigint").alias("added"))
    return g.withColumn("status", F.when(F.col("total") > 0, "ok").otherwise("never_run"))


def worst_status(parts: dict[str, DataFrame]) -> DataFrame:
    """One row: status, the worst of the parts' (each with a column status), and parts, those that have it."""
    rank = lambda c: F.array_position(F.array(*[F.lit(s) for s in SEVERITY]), c)
    every = reduce(DataFrame.unionByName, [d.select(F.lit(name).alias("part"), "status") for name, d in parts.items()])
    g = every.agg(F.max_by("status", rank(F.col("status"))).alias("status"), F.collect_set(F.struct("part", "status")).alias("all"))  # a row for each part
    return g.select("status", F.array_sort(F.transform(F.filter("all", lambda p: p["status"] == F.col("status")), lambda p: p["part"])).alias("parts"))


def upcoming(calendar: DataFrame, as_of: Column, n: int = 5) -> DataFrame:
    return calendar.filter(F.col("release_date") >= as_of).select("release_date", "release_name").distinct().orderBy("release_date", "release_name").limit(n)


def latest_runs(runs: DataFrame, n: int = 3) -> DataFrame:
    """The last runs of each script."""
    w = Window.partitionBy("script").orderBy(F.desc("finished_at"), F.desc("event_id"))
    return runs.withColumn("place", F.row_number().over(w).cast("bigint")).filter(F.col("place") <= n)
