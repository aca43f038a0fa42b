"""Store-history CSV files: every column read as text, checked, never interpolated."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tillwise.functions.core import union_all

SCHEMA_VERSION = "store_history.v1"
REQUIRED = ["month", "revenue_krw", "variable_costs_krw", "fixed_costs_krw"]
VARIABLE = ["ingredients_krw", "platform_fee_krw", "payment_fee_krw"]
FIXED = ["rent_krw", "labor_krw", "utilities_krw", "other_fixed_krw"]
OPTIONAL = ["schema_version", "annual_interest_rate", "interest_rate_unit"]
MONTH = r"^[0-9]{4}-(0[1-9]|1[0-2])$"
MONEY = "decimal(28,8)"


def read_ledger_csv(spark: SparkSession, path: str) -> DataFrame:
    """Files with a header; `store_id` and `row_index` are columns of the landed files."""
    return spark.read.option("header", True).option("inferSchema", False).csv(path)


def missing_headers(rows: DataFrame) -> list[str]:
    return [c for c in REQUIRED if c not in rows.columns]


def _blank(name: str) -> Column:
    return F.coalesce(F.trim(F.col(name)), F.lit("")) == ""


def _amount(name: str) -> Column:
    return F.expr(f"try_cast(trim(replace({name}, ',', '')) AS {MONEY})")


def _check(name: str, required: bool) -> Column:
    """NULL, or the step that a money column fails."""
    value = _amount(name)
    bad = F.when(value.isNull(), "DATA_TYPE").when(value < 0, "RANGE_CHECK")
    return F.when(_blank(name), F.lit("REQUIRED_VALUE") if required else F.lit(None)).otherwise(bad)


def _good(name: str) -> Column:
    return F.when(~_blank(name) & (_amount(name) >= 0), _amount(name))


def validate_ledger(rows: DataFrame) -> DataFrame:
    """Findings (store_id, row_index, severity, step, column, detail, n).

    rows(store_id, row_index, text columns). Row findings name their row; duplicate months and
    gaps are counted per month from one row per (store, month), so repeated rows of a store
    collapse before they meet."""
    absent = missing_headers(rows)
    if absent:
        return rows.groupBy("store_id").agg(F.lit(1)).select(
            "store_id", F.lit(None).cast("bigint").alias("row_index"), F.lit("ERROR").alias("severity"),
            F.lit("SCHEMA_HEADER").alias("step"), F.explode(F.array(*[F.lit(c) for c in absent])).alias("column"),
            F.lit(None).cast("string").alias("detail"), F.lit(1).cast("bigint").alias("n"))
    for name in [*VARIABLE, *FIXED, *OPTIONAL]:
        if name not in rows.columns:
            rows = rows.withColumn(name, F.lit(None).cast("string"))
    month = F.trim("month")
    bad_month = ~F.coalesce(month.rlike(MONTH), F.lit(False))
    item = lambda when, severity, step, column: F.when(
        when, F.struct(F.lit(severity).alias("severity"), step.alias("step"), F.lit(column).alias("column")))
    money = [(c, True) for c in REQUIRED[1:]] + [(c, False) for c in [*VARIABLE, *FIXED]]
    parsed = [item(_check(c, need).isNotNull(), "ERROR", _check(c, need), c) for c, need in money]
    have = lambda names: [_good(c).isNotNull() for c in names]
    every = lambda flags: _fold(flags, lambda a, b: a & b)
    some = lambda flags: _fold(flags, lambda a, b: a | b)
    off = lambda names, total: every(have(names)) & _good(total).isNotNull() & (
        F.abs(_fold([_good(c) for c in names], lambda a, b: a + b) - _good(total)) > 1)
    complete = every(have(VARIABLE)) & _good("variable_costs_krw").isNotNull()
    rate, unit = F.col("annual_interest_rate"), F.upper(F.coalesce("interest_rate_unit", F.lit("")))
    has_rate = F.coalesce(rate, F.lit("")) != ""
    known_unit = unit.isin("DECIMAL", "PERCENT")
    checks = parsed + [
        item(off(VARIABLE, "variable_costs_krw"), "ERROR", F.lit("ACCOUNTING_SUM"), "variable_costs_krw"),
        item(~complete & some(have(VARIABLE)), "ERROR", F.lit("ACCOUNTING_SUM"), "variable_cost_details"),
        item(~some(have(VARIABLE)), "WARNING", F.lit("MISSING_OPTIONAL_DETAIL"), "variable_cost_details"),
        item(off(FIXED, "fixed_costs_krw"), "ERROR", F.lit("ACCOUNTING_SUM"), "fixed_costs_krw"),
        item(has_rate & _check("annual_interest_rate", True).isNotNull(), "ERROR", _check("annual_interest_rate", True), "annual_interest_rate"),
        item(has_rate & ~known_unit, "ERROR", F.lit("UNIT"), "interest_rate_unit"),
        item(has_rate & (unit == "DECIMAL") & (_good("annual_interest_rate") > 1), "ERROR", F.lit("RANGE_CHECK"), "annual_interest_rate"),
    ]
    found = F.when(bad_month, F.array(item(F.lit(True), "ERROR", F.lit("DATA_TYPE"), "month"))).otherwise(F.array_compact(F.array(*checks)))
    by_row = rows.select("store_id", F.col("row_index").cast("bigint").alias("row_index"), F.explode(found).alias("f")).select(
        "store_id", "row_index", "f.*", F.lit(None).cast("string").alias("detail"), F.lit(1).cast("bigint").alias("n"))
    months = rows.filter(~bad_month).groupBy("store_id", month.alias("month")).agg(F.count("*").alias("copies"))
    level = lambda df, severity, step, column, detail, n: df.select(
        "store_id", F.lit(None).cast("bigint").alias("row_index"), F.lit(severity).alias("severity"),
        F.lit(step).alias("step"), F.lit(column).alias("column"), detail.alias("detail"), n.cast("bigint").alias("n"))
    repeated = level(months.filter("copies > 1"), "ERROR", "TIMESERIES_CONTINUITY", "month",
                     F.concat(F.lit("duplicate "), F.col("month")), F.col("copies") - 1)
    index = F.substring("month", 1, 4).cast("int") * 12 + F.substring("month", 6, 2).cast("int")
    before = Window.partitionBy("store_id").orderBy("month")
    steps = months.withColumn("i", index).withColumn("prev", F.lag(F.struct("month", "i")).over(before))
    gaps = level(steps.filter(F.col("i") != F.col("prev.i") + 1), "ERROR", "TIMESERIES_CONTINUITY", "month",
                 F.concat(F.lit("missing between "), F.col("prev.month"), F.lit(" and "), F.col("month")), F.lit(1))
    given = F.when(~_blank("schema_version"), F.trim("schema_version"))
    versions = rows.groupBy("store_id").agg(F.count(given).alias("named"), F.max(given != SCHEMA_VERSION).alias("foreign"))
    unnamed = level(versions.filter("named = 0"), "WARNING", "SCHEMA_VERSION", "schema_version", F.lit(None).cast("string"), F.lit(1))
    foreign = level(versions.filter("foreign"), "ERROR", "SCHEMA_VERSION", "schema_version", F.lit(None).cast("string"), F.lit(1))
    return union_all([by_row, repeated, gaps, unnamed, foreign])


def valid_rows(rows: DataFrame, findings: DataFrame) -> DataFrame:
    """Rows of the stores without any error."""
    return rows.join(findings.filter(F.col("severity") == "ERROR").select("store_id").distinct(), "store_id", "left_anti")


def _fold(items, op):
    out = items[0]
    for item in items[1:]:
        out = op(out, item)
    return out
