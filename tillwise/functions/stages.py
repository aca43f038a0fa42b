"""Intermediate tables in the cluster's shared checkpoint folder.

A derived table that several branches of one plan read is written once and read back, so that its sources
are scanned once and a lost executor costs no recomputation of them. Nothing outlives the plan that is being
built: another query or another run writes its own tables from its own inputs."""

from __future__ import annotations

import contextlib
import contextvars
import uuid
from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, SparkSession

_PLAN: contextvars.ContextVar[dict[str, DataFrame] | None] = contextvars.ContextVar("stages_of_the_plan", default=None)


def shared_folder(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir. Where that is unset, a folder inside the warehouse, which
    driver and executors share too."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        folder = f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/_checkpoints"
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


@contextlib.contextmanager
def one_plan() -> Iterator[None]:
    """While a plan is built, a stage that several of its parts ask for is written once."""
    token = _PLAN.set({})
    try:
        yield
    finally:
        _PLAN.reset(token)


def new_stage(frame: DataFrame, name: str) -> DataFrame:
    """The frame written to the shared folder and read back: cuts the lineage of rounds that build on each other."""
    path = f"{shared_folder(frame.sparkSession)}/{name}-{uuid.uuid4().hex}"
    frame.write.parquet(path)
    return frame.sparkSession.read.schema(frame.schema).parquet(path)


def staged(spark: SparkSession, key: str, build: Callable[[], DataFrame]) -> DataFrame:
    """The table `key` of the plan in hand, written on first use."""
    known = _PLAN.get()
    if known is not None and key in known:
        return known[key]
    table = new_stage(build(), "tillwise")
    if known is not None:
        known[key] = table
    return table
