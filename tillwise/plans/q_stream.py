"""Streaming queries: each drains the events feed and reads back the table it wrote."""

from __future__ import annotations

from pyspark.sql import functions as F

from tillwise.functions.core import month_name, rnd, stable_id
from tillwise.plans import bindings as b
from tillwise.plans.catalog import query, r, sql
from tillwise.streaming import feeds


def feed(spark, sf):
    stream = feeds.open_stream(spark, f"{sf}/event[s].parquet", b.table(spark, sf, "events").schema)
    return stream.withColumn("ts", F.col("ts").cast("timestamp"))


@query("stream_obs_dedupe", sql("SELECT event_id, event_type, 'OBS-' || upper(substr(sha256(event_id || '|' || event_type), 1, 24)) AS observation_id FROM events"))
def stream_obs_dedupe(spark, sf):
    """The feed arrives twice; every observation is stored once."""
    rows = feed(spark, sf).withColumn("observation_id", stable_id("OBS-", 24, F.col("event_id"), F.col("event_type")))
    rows = rows.select("observation_id", "event_id", "event_type", "ts")
    folder = feeds.new_folder(spark)
    table = feeds.ingest_once(rows.unionByName(rows), "observation_id", "ts", folder)
    return spark.read.parquet(table).select("event_id", "event_type", "observation_id")


# every event is a value for its type and day, known when it has landed, up to two days later; the feed arrives twice
_FACTS = """SELECT event_type AS indicator_id, CAST(ts AS DATE) AS observed_at, CAST(ts AS TIMESTAMP) + to_days(CAST(event_id % 3 AS INTEGER)) AS known, min(floor(value)) AS v FROM events GROUP BY 1, 2, 3"""
_VINTAGES = f"""SELECT indicator_id, observed_at, v, known AS known_from, lead(known) OVER (PARTITION BY indicator_id, observed_at ORDER BY known) AS known_to FROM (
  SELECT *, lag(v) OVER w AS before, row_number() OVER w AS n FROM ({_FACTS}) WINDOW w AS (PARTITION BY indicator_id, observed_at ORDER BY known)) WHERE n = 1 OR before IS DISTINCT FROM v"""


def observation_vintages(spark, sf):
    rows = feed(spark, sf).select(F.col("event_type").alias("indicator_id"), F.to_date("ts").alias("observed_at"), (F.col("ts") + F.make_dt_interval((F.col("event_id") % 3).cast("int"))).alias("known"), F.floor("value").cast("double").alias("v"))
    table = feeds.ingest_vintages(rows.unionByName(rows), ["indicator_id"], "observed_at", "known", "v", feeds.new_folder(spark))
    return feeds.vintages(spark.read.parquet(table), ["indicator_id"], "observed_at", "known", "v")


@query("stream_vintages", sql(f"SELECT indicator_id, strftime(observed_at, '%Y-%m-%d') AS observed_at, v AS value, strftime(known_from, '%Y-%m-%d %H:%M:%S') AS known_from, strftime(known_to, '%Y-%m-%d %H:%M:%S') AS known_to FROM ({_VINTAGES})"))
def stream_vintages(spark, sf):
    out, shown = observation_vintages(spark, sf), lambda c: F.date_format(c, "yyyy-MM-dd HH:mm:ss")
    return out.select("indicator_id", F.date_format("observed_at", "yyyy-MM-dd").alias("observed_at"), F.col("v").alias("value"), shown("known_from").alias("known_from"), shown("known_to").alias("known_to"))


@query("stream_vintages_as_of", sql(f"""
SELECT indicator_id, strftime(observed_at, '%Y-%m-%d') AS observed_at, v AS value FROM ({_VINTAGES}), (SELECT CAST(max(CAST(ts AS TIMESTAMP)) AS DATE)::TIMESTAMP AS moment FROM events) WHERE known_from <= moment AND (known_to IS NULL OR known_to > moment)"""))
def stream_vintages_as_of(spark, sf):
    moment = b.table(spark, sf, "events").agg(F.to_date(F.max("ts")).cast("timestamp")).scalar()
    return feeds.known_at(observation_vintages(spark, sf), moment).select("indicator_id", F.date_format("observed_at", "yyyy-MM-dd").alias("observed_at"), F.col("v").alias("value"))


@query("stream_monthly", sql(f"""
SELECT 'DAILY_' || upper(event_type) AS indicator_id, strftime(ts, '%Y-%m') AS month, count(*) AS n, {r('sum(CAST(floor(value * 100.0::DOUBLE + 0.5::DOUBLE) AS BIGINT))::DOUBLE / count(*) / 100.0::DOUBLE', 6)} AS value FROM events GROUP BY 1, 2"""))
def stream_monthly(spark, sf):
    rows = feed(spark, sf).select(F.concat(F.lit("DAILY_"), F.upper("event_type")).alias("indicator_id"), "ts", b.cents("value").alias("cents"))
    out = feeds.monthly_stream(rows, "ts", feeds.new_folder(spark))
    return out.select("indicator_id", month_name(F.col("month")).alias("month"), "n", rnd(F.col("cents").cast("double") / F.col("n") / 100.0, 6).alias("value"))


@query("stream_latency", sql("""
SELECT strftime(date_trunc('hour', ts), '%Y-%m-%d %H:%M') AS window_start, event_type AS metric, count(*) AS n, max(value) AS max_value,
  list_sort(list(value))[greatest(1, CAST(ceil(0.5::DOUBLE * count(*)) AS INTEGER))] AS p50, list_sort(list(value))[greatest(1, CAST(ceil(0.95::DOUBLE * count(*)) AS INTEGER))] AS p95
FROM events GROUP BY 1, 2"""))
def stream_latency(spark, sf):
    rows = feed(spark, sf).select(F.col("event_type").alias("metric"), "ts", "value")
    out = feeds.latency_windows(rows, "ts", "1 hour", feeds.new_folder(spark))
    return out.select(F.date_format("w.start", "yyyy-MM-dd HH:mm").alias("window_start"), "metric", "n", "max_value", "p50", "p95")
