"""Result packaging: statements, trace ids, hashes, statuses, data-quality invariants."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tillwise.functions.core import month_name
from tillwise.functions.skew import salted_join


def summary_statements(ledger: DataFrame, keys: list[str]) -> DataFrame:
    """One deterministic sentence per key: first forecast revenue and last ending cash."""
    won = lambda c: F.floor(c + 0.5).cast("bigint").cast("string")
    out = ledger.groupBy(*keys).agg(
        F.min("month").alias("first"), F.min_by("revenue", "month_index").alias("revenue"),
        F.max("month").alias("last"), F.max_by("ending_cash", "month_index").alias("cash"))
    return out.select(*keys, F.concat(
        F.lit("First forecast month "), month_name(F.col("first")), F.lit(" revenue "), won(F.col("revenue")),
        F.lit("; last month "), month_name(F.col("last")), F.lit(" ends with "), won(F.col("cash"))).alias("statement"))


def trace_manifest(ids: DataFrame, keys: list[str]) -> DataFrame:
    """ids(keys…, kind, id), each once, with the number of ids of its kind.

    The manifest stays a long table: a result that cites a third of all ids is still many rows
    on many tasks."""
    rows = ids.select(*keys, "kind", F.col("id").cast("string").alias("id")).distinct()
    counts = rows.groupBy(*keys, "kind").agg(F.count("*").alias("id_count"))
    return salted_join(rows, counts, [*keys, "kind"], F.col("id"))


def citation_gaps(statements: DataFrame, trace: DataFrame, keys: list[str]) -> DataFrame:
    """Citations of statements that the trace does not know."""
    cited = statements.select(*keys, "statement_id", F.explode("citation_ids").alias("id"))
    return cited.join(trace.select(*keys, "id"), [*keys, "id"], "left_anti")


def result_hash(rows: DataFrame, keys: list[str], ignore: list[str]) -> DataFrame:
    """Content hash per key, blind to row order and to run-time fields.

    Row hashes are summed (as five words of 48 bits), so no key's rows meet in one place."""
    names = sorted(c for c in rows.columns if c not in (*keys, *ignore))
    digest = F.sha2(F.to_json(F.struct(*names)), 256)
    word = lambda i: F.conv(F.substring(digest, 1 + 12 * i, 12), 16, 10).cast("decimal(20,0)")
    sums = rows.groupBy(*keys).agg(F.count("*").alias("row_count"), *[F.sum(word(i)).alias(f"w{i}") for i in range(5)])
    return sums.select(*keys, "row_count", F.sha2(F.concat_ws("|", "row_count", *[f"w{i}" for i in range(5)]), 256).alias("result_hash"))


# Sections that decide a run's status.
SECTIONS = ["OFFICIAL_DATA", "BASELINE", "RESEARCH", "FINANCE", "POLICIES"]


def run_status(sections: DataFrame) -> DataFrame:
    """sections(run_id, section, status) to the run's overall status."""
    broken = (F.col("section") == "FINANCE") & F.col("status").isin("FAILED", "SKIPPED")
    soft = F.col("section").isin(SECTIONS) & F.col("status").isin("PARTIAL", "FAILED")
    out = sections.groupBy("run_id").agg(
        F.max(broken).alias("broken"), F.max(soft).alias("soft"),
        F.array_join(F.array_sort(F.collect_set(F.when(F.col("status").isin("PARTIAL", "FAILED"), F.col("section")))), ",").alias("incomplete"))
    status = F.when(F.col("broken"), "FAILED").when(F.col("soft"), "PARTIAL").otherwise("COMPLETED")
    return out.select("run_id", status.alias("status"), "incomplete")


def lifecycle_invariants(candidates: DataFrame, outcomes: DataFrame, key: str, run: str) -> DataFrame:
    """Violation counts per run: unresolved, resolved twice, both accepted and rejected, unknown."""
    seen = outcomes.groupBy(run, key).agg(
        F.count("*").alias("n"), F.max(F.col("status") == "ACCEPTED").alias("yes"), F.max(F.col("status") != "ACCEPTED").alias("no"))
    asked = candidates.select(run, key).distinct().withColumn("asked", F.lit(True))
    both = asked.join(seen, [run, key], "full")
    return both.groupBy(run).agg(
        F.count_if(F.col("n").isNull()).alias("unresolved"), F.count_if(F.col("asked").isNull()).alias("unknown"),
        F.count_if(F.col("n") > 1).alias("resolved_twice"), F.count_if(F.col("yes") & F.col("no")).alias("accepted_and_rejected"),
        F.count_if(F.col("yes")).alias("accepted"), F.count_if(F.col("asked")).alias("candidates"))

