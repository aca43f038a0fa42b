"""Idempotent and versioned parquet sinks; an append is an anti join against what is there."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tillwise.functions.core import first_by, last_by


def new_rows(incoming: DataFrame, existing: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Incoming rows whose key is not stored yet, one per key (the first by `order`)."""
    rest = [c for c in incoming.columns if c not in keys]
    once = incoming.groupBy(*keys).agg(first_by(F.struct(*rest), *[F.col(c) for c in order]).alias("x")).select(*keys, "x.*")
    return once.join(existing.select(*keys), keys, "left_anti").select(*incoming.columns)


def stored_at(spark: SparkSession, path: str) -> DataFrame | None:
    """The parquet table at `path`, or None where nothing was written yet."""
    try:
        return spark.read.parquet(path)
    except Exception as exc:
        if "PATH_NOT_FOUND" not in str(exc) and "UNABLE_TO_INFER_SCHEMA" not in str(exc):
            raise
        return None


def append_once(incoming: DataFrame, path: str, keys: list[str], order: list[str], partition: str | None = None) -> None:
    """Append to the parquet table at `path`, writing each key once however often it arrives.

    With `partition`, a date that the keys imply (a day or month), the table is partitioned by it and only the dates that
    arrive are read: their list is as short as the calendar."""
    stored = stored_at(incoming.sparkSession, path)
    if stored is not None and partition:
        days = [r[0] for r in incoming.select(partition).distinct().collect()]
        stored = stored.where(F.col(partition).isin([d for d in days if d is not None]) | (F.lit(None in days) & F.col(partition).isNull()))
    fresh = new_rows(incoming, incoming.limit(0) if stored is None else stored, keys, order)
    writer = fresh.write.mode("append")
    (writer.partitionBy(partition) if partition else writer).parquet(path)


def within_retention(rows: DataFrame, day: Column, as_of: Column, days: int) -> DataFrame:
    """Rows still inside the retention period; on a table partitioned by day this prunes files."""
    return rows.filter(day >= F.date_sub(as_of, days))


def store_versions(requests: DataFrame, path: str, keys: list[str], fingerprint: str) -> DataFrame:
    """Stores each request under the next version of its key and returns what the store then holds for the requests:
    keys, version, fingerprint and the request's own columns.

    A request whose fingerprint its key already has is not stored again, so a replay adds nothing; versions count up from
    1 in order of fingerprint where several arrive at once. Nothing stored is ever changed."""
    spark = requests.sparkSession
    stored = stored_at(spark, path)
    fresh = requests.dropDuplicates([*keys, fingerprint])
    top = None
    if stored is not None:
        fresh = fresh.join(stored.select(*keys, fingerprint), [*keys, fingerprint], "left_anti")
        top = stored.groupBy(*keys).agg(F.max("version").alias("_top"))
    fresh = fresh.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(fingerprint)))  # the new versions of one result
    fresh = fresh.join(top, keys, "left") if top is not None else fresh.withColumn("_top", F.lit(None).cast("int"))
    fresh = fresh.withColumn("version", F.coalesce("_top", F.lit(0)) + F.col("_n")).drop("_n", "_top")
    fresh.write.mode("append").parquet(path)
    return spark.read.parquet(path).join(requests.select(*keys).distinct(), keys, "left_semi")


def latest_version(results: DataFrame, keys: list[str], order: list[str] | None = None) -> DataFrame:
    """The newest stored version of each key; tables without a stored number are numbered by `order`."""
    rest = [c for c in results.columns if c not in (*keys, "version")]
    if "version" in results.columns:
        return results.groupBy(*keys).agg(F.max("version").alias("version"), last_by(F.struct(*rest), F.col("version")).alias("x")).select(*keys, "version", "x.*")
    return results.groupBy(*keys).agg(
        F.count("*").alias("version"), last_by(F.struct(*rest), *[F.col(c) for c in order]).alias("x")).select(*keys, "version", "x.*")


def upsert_status(existing: DataFrame, incoming: DataFrame, key: str, fingerprint: str) -> DataFrame:
    """INSERT, UPDATE, KEPT or IDENTITY_COLLISION per key of either side."""
    a = existing.select(key, F.col(fingerprint).alias("old"))
    b = incoming.select(key, F.col(fingerprint).alias("new"))
    status = (
        F.when(F.col("old").isNull(), "INSERT").when(F.col("new").isNull(), "KEPT")
        .when(F.col("old") == F.col("new"), "UPDATE").otherwise("IDENTITY_COLLISION"))
    return a.join(b, key, "full").select(key, status.alias("status"))
