"""Local session for tests and the bench; on a cluster the submitter's session is used as is."""

from __future__ import annotations

from pyspark.sql import SparkSession


def local_session(cores: str = "8", partitions: str = "8", memory: str = "12g") -> SparkSession:
    spark = (
        SparkSession.builder.master(f"local[{cores}]").appName("tillwise")
        .config("spark.sql.shuffle.partitions", partitions).config("spark.ui.enabled", "false")
        .config("spark.driver.memory", memory).config("spark.sql.session.timeZone", "UTC")
        # plan building is the larger part of a small job: skip the Python call-site capture
        .config("spark.python.sql.dataFrameDebugging.enabled", "false").getOrCreate())
    spark.sparkContext.setLogLevel("ERROR")
    return spark
