"""Streams whose final tables equal the batch jobs over the same rows.

Every job writes through foreachBatch, a batch in its own folder or behind an anti join, so a batch that
is replayed after a lost executor changes nothing. What may come late without limit (ingest, calendar
months, current states) keeps no watermark and loses no row."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tillwise.functions.core import last_by
from tillwise.functions.stages import shared_folder
from tillwise.operators import metrics as mt
from tillwise.sources.sinks import append_once

STATE_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def open_stream(spark: SparkSession, path: str, schema) -> DataFrame:
    """Parquet files as a stream; `path` may be a folder or a glob."""
    return spark.readStream.schema(schema).parquet(path)


def drain(stream: DataFrame, write: Callable[[DataFrame, int], None], folder: str, mode: str = "append") -> None:
    """Run a stream over everything that has arrived and stop."""
    stream.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", STATE_STORE)
    query = (stream.writeStream.outputMode(mode).foreachBatch(write).option("checkpointLocation", f"{folder}/offsets")
             .trigger(availableNow=True).start())
    query.awaitTermination()


def new_folder(spark: SparkSession) -> str:
    return f"{shared_folder(spark)}/stream-{uuid.uuid4().hex}"


def ingest_once(stream: DataFrame, key: str, ts: str, folder: str) -> str:
    """Idempotent ingest of rows whose time never changes under a key: the sink's anti join drops repeats, however
    late; a row that comes late for the first time is stored like any other. The table is partitioned by day, and a
    batch reads only the days that it brings. Returns the table's path."""
    table = f"{folder}/table"
    dated = stream.withColumn("day", F.to_date(ts))
    drain(dated, lambda batch, _: append_once(batch, table, [key, "day"], [ts], "day"), folder)
    return table


def ingest_vintages(stream: DataFrame, series: list[str], observed: str, known: str, value: str, folder: str) -> str:
    """A feed of observations that may be revised: every (series, observed, known) is one fact, stored once in the
    partition of its observed month. `known` is when the value could first be used, landing included, so that facts
    that arrive later never change what an earlier date knew. Of rows with equal keys in one batch the least value is
    kept, over batches the first. Returns the table's path."""
    table = f"{folder}/table"
    dated = stream.withColumn("month", F.trunc(observed, "month"))
    drain(dated, lambda batch, _: append_once(batch, table, [*series, observed, known, "month"], [value], "month"), folder)
    return table


def vintages(facts: DataFrame, series: list[str], observed: str, known: str, value: str) -> DataFrame:
    """(series, observed, value, known_from, known_to): the values of each observation and when each was the known one,
    known_to open for the last. A fact that repeats the value known before it starts no vintage."""
    own = Window.partitionBy(*series, observed).orderBy(known)  # the facts of one observation
    before = F.lag(F.struct(value)).over(own)
    changed = facts.withColumn("_before", before).where(F.col("_before").isNull() | ~F.col(f"_before.{value}").eqNullSafe(F.col(value)))
    return changed.select(*series, observed, value, F.col(known).alias("known_from"), F.lead(known).over(own).alias("known_to"))


def known_at(intervals: DataFrame, moment: Column) -> DataFrame:
    """What was known at a moment: one vintage per observation at most."""
    return intervals.where((F.col("known_from") <= moment) & (F.col("known_to").isNull() | (F.col("known_to") > moment)))


def merge_batches(stream: DataFrame, partial: Callable[[DataFrame], DataFrame], merge: Callable[[DataFrame], DataFrame], folder: str) -> DataFrame:
    """An aggregate without state: each micro-batch writes its own partial aggregate, and the table is their
    merge. Late rows count in whatever batch brings them."""
    table = f"{folder}/table"

    def write(batch: DataFrame, number: int) -> None:
        partial(batch).write.mode("overwrite").parquet(f"{table}/part={number}")

    drain(stream, write, folder)
    return merge(stream.sparkSession.read.parquet(table).drop("part"))


def keep_latest(stream: DataFrame, keys: list[str], folder: str) -> DataFrame:
    """Updates of an aggregate, written per micro-batch; the last one per key is the result."""
    spark = stream.sparkSession
    table = f"{folder}/table"

    def write(batch: DataFrame, number: int) -> None:
        batch.withColumn("batch_id", F.lit(number)).write.mode("overwrite").parquet(f"{table}/part={number}")

    drain(stream, write, folder, "update")
    rows = spark.read.parquet(table).drop("part")
    rest = [c for c in rows.columns if c not in (*keys, "batch_id")]
    return rows.groupBy(*keys).agg(last_by(F.struct(*rest), F.col("batch_id")).alias("x")).select(*keys, "x.*")


def monthly_stream(stream: DataFrame, ts: str, folder: str) -> DataFrame:
    """Daily feed to calendar months."""
    keys = ["month", "indicator_id"]

    def partial(batch: DataFrame) -> DataFrame:
        months = batch.withColumn("month", F.date_trunc("month", F.col(ts).cast("timestamp")))
        return months.groupBy(*keys).agg(F.sum("cents").alias("cents"), F.count("*").alias("n"), F.max(F.struct(F.col(ts).alias("at"), "cents")).alias("last"))

    return merge_batches(stream, partial, lambda rows: rows.groupBy(*keys).agg(
        F.sum("cents").alias("cents"), F.sum("n").alias("n"), F.max("last").alias("last")).withColumn("last_cents", F.col("last.cents")).drop("last"), folder)


def latency_stream(stream: DataFrame, ts: str, delay: str, width: str) -> DataFrame:
    """Tumbling latency windows per metric, with exact percentiles p while a window is open. The state holds the
    distinct values of the open windows; `latency_windows` needs none."""
    return stream.withWatermark(ts, delay).groupBy(F.window(ts, width).alias("w"), "metric").agg(
        F.count("*").alias("n"), F.max("value").alias("max_value"),
        F.array(*[F.expr(f"percentile_disc({p}D) WITHIN GROUP (ORDER BY value)") for p in (0.5, 0.95)]).alias("p"))


def latency_windows(stream: DataFrame, ts: str, width: str, folder: str) -> DataFrame:
    """(w, metric, n, max_value, p50, p95) of tumbling windows: each micro-batch counts its distinct values, and
    exact percentiles are taken from the merged counts. Late rows count, however late."""
    keys = ["w", "metric"]
    return mt.counted_percentiles(merge_batches(
        stream, lambda batch: batch.groupBy(F.window(ts, width).alias("w"), "metric", "value").agg(F.count("*").alias("c")),
        lambda rows: rows.groupBy(*keys, "value").agg(F.sum("c").alias("c")), folder), keys)


def rate_stream(stream: DataFrame, client: str, ts: str, delay: str, width: str = "60 seconds", slide: str = "10 seconds") -> DataFrame:
    """Sliding request counts per client."""
    return stream.withWatermark(ts, delay).groupBy(F.window(ts, width, slide).alias("w"), client).agg(F.count("*").alias("n"))


def state_stream(stream: DataFrame, key: str, order: list[str], folder: str) -> DataFrame:
    """Current state per candidate from its transition log."""
    latest = F.struct(*order, "to_state")
    return merge_batches(
        stream, lambda batch: batch.groupBy(key).agg(F.max(latest).alias("last"), F.count("*").alias("transitions")),
        lambda rows: rows.groupBy(key).agg(F.max("last").alias("last"), F.sum("transitions").alias("transitions")).select(
            key, F.col("last.to_state").alias("state"), "transitions"), folder)


def session_stream(stream: DataFrame, key: str, ts: str, delay: str, gap: str) -> DataFrame:
    """Runs as sessions: a silent gap longer than the limit ends one."""
    return stream.withWatermark(ts, delay).groupBy(F.session_window(ts, gap).alias("w"), key).agg(F.count("*").alias("n"), F.max(ts).alias("last_event"))
