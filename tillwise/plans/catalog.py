"""Query registry and shared SQL fragments."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tillwise.functions.stages import one_plan

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
CTES: dict[str, tuple[list[str], str]] = {}

SESSION_DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
}


def configure(spark: SparkSession) -> SparkSession:
    for key, value in SESSION_DEFAULTS.items():
        spark.conf.set(key, value)
    return spark


def query(name: str, oracle: str | None = None):
    def register(fn):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            with one_plan():
                return fn(configure(spark), sf_dir)

        QUERIES[name] = run
        if oracle:
            ORACLES[name] = oracle
        return fn

    return register


def cte(name: str, body: str, *deps: str) -> None:
    CTES[name] = (list(deps), body)


def sql(body: str, *names: str) -> str:
    """Assemble a statement from the named CTEs and what they depend on."""
    order: list[str] = []

    def visit(key: str) -> None:
        if key in order:
            return
        for dep in CTES[key][0]:
            visit(dep)
        order.append(key)

    for key in names:
        visit(key)
    if not order:
        return body
    parts = [k + " AS (" + CTES[k][1] + ")" for k in order]
    recursive = any(k.endswith("sched") for k in order)
    head = "WITH RECURSIVE " if recursive else "WITH "
    tail = body.strip()
    if tail.upper().startswith("WITH "):
        return head + ",\n".join(parts) + ",\n" + tail[5:]
    return head + ",\n".join(parts) + "\n" + tail


def r(expr: str, digits: int) -> str:
    scale = f"{float(10**digits):.1f}"
    return f"(floor(({expr})*{scale}+0.5)/{scale})"
