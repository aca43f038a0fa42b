import datetime as dt
import math
import random

from pyspark.sql import functions as F

from tillwise.operators import metrics as mt
from tillwise.sources import sinks
from tillwise.streaming import feeds


def feed(spark, tmp_path, parts=3):
    rng = random.Random(6)
    t0 = dt.datetime(2026, 1, 1)
    rows = [(i, rng.choice("abc"), t0 + dt.timedelta(seconds=rng.randint(0, 7200)), rng.choice(["RUNNING", "DONE"]), float(rng.randint(1, 99))) for i in range(120)]
    src = str(tmp_path / "src")
    for k in range(parts):
        spark.createDataFrame(rows[k::parts], "event_id int, k string, ts timestamp, to_state string, value double").coalesce(1).write.mode("append").parquet(src)
    batch = spark.read.parquet(src)
    return batch, feeds.open_stream(spark, src, batch.schema)


def rows_of(df, *cols):
    return sorted(tuple(r[c] for c in cols) for r in df.select(*cols).collect())


def test_state_log_equals_batch(spark, tmp_path):
    batch, stream = feed(spark, tmp_path)
    out = feeds.state_stream(stream, "k", ["ts", "event_id"], str(tmp_path / "o"))
    assert rows_of(out, "k", "state", "transitions") == rows_of(mt.current_state(batch, "k", ["ts", "event_id"]), "k", "state", "transitions")


def test_windows_equal_batch(spark, tmp_path):
    batch, stream = feed(spark, tmp_path)
    out = feeds.keep_latest(feeds.latency_stream(stream.withColumnRenamed("k", "metric"), "ts", "3 hours", "10 minutes"), ["w", "metric"], str(tmp_path / "a"))
    want = batch.groupBy(F.window("ts", "10 minutes").alias("w"), F.col("k").alias("metric")).agg(F.count("*").alias("n"), F.max("value").alias("max_value"))
    assert rows_of(out, "w", "metric", "n", "max_value") == rows_of(want, "w", "metric", "n", "max_value")
    rate = feeds.keep_latest(feeds.rate_stream(stream, "k", "ts", "3 hours"), ["w", "k"], str(tmp_path / "b"))
    want = batch.groupBy(F.window("ts", "60 seconds", "10 seconds").alias("w"), "k").agg(F.count("*").alias("n"))
    assert rows_of(rate, "w", "k", "n") == rows_of(want, "w", "k", "n")


def test_percentiles_of_a_hot_window_are_exact(spark, tmp_path):
    rng, t0 = random.Random(7), dt.datetime(2026, 1, 1)
    values = [("hot", rng.choice([-1, 1]) * rng.lognormvariate(3, 2)) for _ in range(30_000)] + [("few", float(v)) for v in (5, 1, 3)]
    values += [("hot", None), ("none", None), (None, 2.0), (None, 1.0), ("hot", float("nan"))]
    rows = [(k, t0 + dt.timedelta(seconds=rng.randint(0, 3599)), v) for k, v in values]
    rng.shuffle(rows)
    src, schema = str(tmp_path / "src"), "metric string, ts timestamp, value double"
    for part in (rows[::2], rows[1::2]):
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(src)
    stream = lambda: feeds.open_stream(spark, src, spark.read.parquet(src).schema)
    want = {}
    for k in {k for k, _ in values}:
        held = sorted((v for m, v in values if m == k and v is not None), key=lambda v: (v != v, v))
        want[k] = (sum(m == k for m, _ in values), *([held[max(1, math.ceil(p * len(held))) - 1] for p in (0.5, 0.95)] if held else (None, None)))
    got = feeds.latency_windows(stream(), "ts", "1 hour", str(tmp_path / "a")).collect()
    assert {r.metric: (r.n, r.p50, r.p95) for r in got} == want and len(got) == len(want)
    got = feeds.keep_latest(feeds.latency_stream(stream(), "ts", "1 hour", "1 hour"), ["w", "metric"], str(tmp_path / "b")).collect()
    assert {r.metric: (r.n, *r.p) for r in got} == want


def test_corpus_reader(spark, tmp_path):
    from tillwise.sources.landed import read_corpus

    (tmp_path / "c.json").write_text('[{"case_id": "1",\n "body_text": "가"}, {"case_id": "2", "body_text": "b"}]', encoding="utf-8")
    assert rows_of(read_corpus(spark, str(tmp_path / "c.json"), "case_id string, body_text string"), "case_id", "body_text") == [("1", "가"), ("2", "b")]


def test_closed_sessions_equal_batch(spark, tmp_path):
    batch, stream = feed(spark, tmp_path, parts=1)
    late = spark.createDataFrame([(999, "z", dt.datetime(2026, 1, 9), "RUNNING", 1.0)], batch.schema)
    late.coalesce(1).write.mode("append").parquet(str(tmp_path / "src"))
    table = str(tmp_path / "t")
    feeds.drain(feeds.session_stream(stream, "k", "ts", "1 hour", "5 minutes"), lambda b, n: b.write.mode("append").parquet(table), str(tmp_path / "o"))
    want = batch.filter("k <> 'z'").groupBy(F.session_window("ts", "5 minutes").alias("w"), "k").agg(F.count("*").alias("n"))
    assert rows_of(spark.read.parquet(table), "w", "k", "n") == rows_of(want, "w", "k", "n")


def test_rows_of_any_age_reach_the_tables_over_two_triggers(spark, tmp_path):
    day = lambda m, d: dt.datetime(2026, m, d)
    src, schema = str(tmp_path / "src"), "id string, indicator_id string, ts timestamp, cents bigint"
    put = lambda rows: spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(src)
    put([("a", "I", day(3, 1), 5), ("b", "I", day(3, 20), 7)])
    stream = lambda: feeds.open_stream(spark, src, spark.read.parquet(src).schema)
    table = feeds.ingest_once(stream(), "id", "ts", str(tmp_path / "in"))
    feeds.monthly_stream(stream(), "ts", str(tmp_path / "m"))
    put([("c", "I", day(1, 2), 1), ("a", "I", day(3, 1), 5)])  # months late, and a repeat
    assert feeds.ingest_once(stream(), "id", "ts", str(tmp_path / "in")) == table
    assert sorted(r.id for r in spark.read.parquet(table).collect()) == ["a", "b", "c"]
    months = feeds.monthly_stream(stream().filter("id <> 'a' or ts is not null"), "ts", str(tmp_path / "m2")).collect()
    assert {(r.month.month, r.cents, r.n, r.last_cents) for r in months} == {(1, 1, 1, 1), (3, 17, 3, 7)}


def test_revisions_become_vintages_and_old_dates_keep_what_they_knew(spark, tmp_path):
    src, schema = str(tmp_path / "src"), "indicator_id string, observed_at date, known timestamp, value double"
    at = lambda d, h=0: dt.datetime(2026, 5, d, h)
    obs = lambda d: dt.date(2026, 4, d)
    put = lambda rows: spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(src)
    folder = str(tmp_path / "v")

    def run():
        stream = feeds.open_stream(spark, src, spark.read.parquet(src).schema)
        table = feeds.ingest_vintages(stream, ["indicator_id"], "observed_at", "known", "value", folder)
        return feeds.vintages(spark.read.parquet(table), ["indicator_id"], "observed_at", "known", "value")

    seen = lambda moment, table: sorted((r.indicator_id, r.observed_at.day, r.value) for r in feeds.known_at(table, F.lit(moment)).collect())
    put([("A", obs(1), at(2), 1.0), ("A", obs(2), at(3), 5.0), ("B", obs(1), at(2), 9.0)])
    first = run()
    assert seen(at(4), first) == [("A", 1, 1.0), ("A", 2, 5.0), ("B", 1, 9.0)]
    old = seen(at(4), first)
    put([("A", obs(1), at(6), 2.0), ("A", obs(1), at(7), 2.0), ("A", obs(2), at(3), 7.0), ("A", obs(1), at(2), 1.0), ("0", dt.date(2025, 1, 1), at(6), None)])  # a revision, its repeat, another value under a known key, a replay, a null long ago
    table = run()
    assert seen(at(4), table) == old
    assert seen(at(8), table) == [("0", 1, None), ("A", 1, 2.0), ("A", 2, 5.0), ("B", 1, 9.0)]
    assert sorted((r.value, r.known_from.day, r.known_to and r.known_to.day) for r in table.where("indicator_id = 'A' and observed_at = '2026-04-01'").collect()) == [(1.0, 2, 6), (2.0, 6, None)]
    assert run().count() == table.count()  # nothing new arrived


def test_append_reads_only_the_days_that_arrive(spark, tmp_path):
    path, schema = str(tmp_path / "t"), "id int, day date, v int"
    for rows in ([(1, dt.date(2026, 1, 1), 1), (2, dt.date(2026, 1, 2), 1), (9, None, 1)], [(1, dt.date(2026, 1, 1), 5), (3, dt.date(2026, 1, 1), 1), (9, None, 4)]):
        sinks.append_once(spark.createDataFrame(rows, schema), path, ["id", "day"], ["v"], "day")
    assert rows_of(spark.read.parquet(path).fillna({"v": 0}), "id", "v") == [(1, 1), (2, 1), (3, 1), (9, 1), (9, 4)]  # a null day meets nothing, as null keys do


def test_versions_are_stored_once(spark, tmp_path):
    path, schema = str(tmp_path / "t"), "result string, request string, x int"
    store = lambda rows: {(r.result, r.request): r.version for r in sinks.store_versions(spark.createDataFrame(rows, schema), path, ["result"], "request").collect()}
    assert store([("r", "a", 1), ("s", "a", 1)]) == {("r", "a"): 1, ("s", "a"): 1}
    assert store([("r", "a", 1)]) == {("r", "a"): 1}
    assert store([("r", "c", 1), ("r", "b", 1), ("r", "a", 1), ("r", "b", 1)]) == {("r", "a"): 1, ("r", "b"): 2, ("r", "c"): 3}
    latest = sinks.latest_version(spark.read.parquet(path), ["result"]).collect()
    assert {(r.result, r.version, r.request) for r in latest} == {("r", 3, "c"), ("s", 1, "a")}


def test_idempotent_append_keeps_every_new_observation(spark):
    from tillwise.plans import bindings as b
    from tillwise.plans.registry import QUERIES

    folder = "/root/testdata/sf0.001"
    fresh = b.observations(spark, folder).where("vintage_id <> 'VNT-0'")
    assert QUERIES["idempotent_append"](spark, folder).count() == fresh.count() > 0


def test_retention_drops_rows_before_the_period(spark):
    rows = spark.sql("SELECT explode(sequence(DATE '2001-08-25', DATE '2001-08-31')) AS day")
    kept = sinks.within_retention(rows, F.col("day"), F.lit("2001-08-31").cast("date"), 3)
    assert [r["day"].day for r in kept.orderBy("day").collect()] == [28, 29, 30, 31]
