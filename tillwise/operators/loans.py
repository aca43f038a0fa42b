"""Loan repayment tables in closed form: one row per loan, rate change and forecast month.

Whether a month pays, waits or is in grace depends on the calendar alone, and a rate changes at
most once (at renewal). So the balance after any number of payments has a formula and no month
needs the month before it; the whole table is one generated projection."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tillwise.functions.core import d, month_gap
from tillwise.functions.skew import salted_join

TERMS = ["principal", "annual_rate", "rate_type", "repayment_type", "remaining_months", "next_payment_date", "grace_end_date",
         "renewal_month", "custom"]


def _annuity_share(rate: Column, total: Column, paid: Column) -> Column:
    """Share of the balance left after `paid` of `total` level payments at a monthly rate."""
    growth = lambda n: F.expm1(n * F.log1p(rate))
    level = 1 - F.try_divide(paid.cast("double"), total.cast("double"))
    return F.when(paid >= total, d(0)).when(rate == 0, level).otherwise(
        (growth(total) - growth(paid)) / growth(total))


def _terms(loans: DataFrame, forecast_start: Column | None, grace_months: Column | None) -> DataFrame:
    """Adds what depends on the loan alone, so that it is worked out once however many rate changes and months it meets: wait, grace
    and paying periods, the balance at renewal, and what a custom schedule has repaid after 0, 1, 2 … entries behind its grace."""
    grace = F.lit(0) if grace_months is None else F.coalesce(grace_months, F.lit(0))
    remaining = F.col("remaining_months")
    if forecast_start is None:
        wait, deferred = F.lit(0), F.lit(0)
    else:
        wait = F.greatest(F.lit(0), F.coalesce(month_gap(F.col("next_payment_date"), forecast_start), F.lit(0)))
        deferred = F.coalesce(month_gap(F.col("grace_end_date"), forecast_start) + 1, F.lit(0))
    out = loans.withColumns({"_wait": wait, "_r1": F.greatest(d(0), F.col("annual_rate")), "_switch": F.coalesce("renewal_month", F.lit(1))})
    out = out.withColumn("_grace", F.least(remaining, F.greatest(F.lit(0), grace, deferred - F.col("_wait"))))
    out = out.withColumn("_periods", remaining - F.col("_grace"))
    # paying periods that fall before the renewal
    out = out.withColumn("_k1", F.greatest(F.lit(0), F.least(
        F.least(F.col("_switch") - F.col("_wait") - 1, remaining) - F.col("_grace"), F.col("_periods"))))
    out = out.withColumn("_b1", F.col("principal") * _annuity_share(F.col("_r1") / 12, F.col("_periods"), F.col("_k1")))
    listed = F.slice("custom", F.greatest(F.col("_grace"), F.lit(0)) + 1, F.size("custom"))
    sums = F.aggregate(listed, F.array(d(0)), lambda acc, x: F.array_append(acc, F.element_at(acc, -1) + x["principal"].cast("double")))
    return out.withColumn("_repaid", F.when((F.col("repayment_type") == "CUSTOM_SCHEDULE") & F.col("custom").isNotNull(), sums).otherwise(F.array(d(0))))


def loan_schedule(loans: DataFrame, horizon: Column | None, forecast_start: Column | None = None,
                  rate_delta: Column | None = None, grace_months: Column | None = None,
                  keep: list[str] | None = None) -> DataFrame:
    """Rows (…keep, month_index, opening, interest, principal, closing, rate, status).

    loans(loan_id, principal, annual_rate, rate_type, repayment_type, remaining_months,
    next_payment_date, grace_end_date, renewal_month, custom). `status` is
    CUSTOM_SCHEDULE_MISSING once a custom schedule runs out and UNSUPPORTED_REPAYMENT for an
    unknown type; such rows carry null payments and leave the balance alone. Input that already
    names its `month_index` gets that month alone."""
    keep = [c for c in keep or loans.columns if c not in TERMS and c != "month_index"]
    return _table(_terms(loans, forecast_start, grace_months), horizon, rate_delta, keep)


def _balance(terms: DataFrame, name: str, active: Column) -> DataFrame:
    """Adds the balance once active period `active` is over. In steps that the planner keeps apart, as a single expression for
    both ends of a month is a method too long for the JVM to compile."""
    kind, remaining = F.col("repayment_type"), F.col("remaining_months")
    out = terms.withColumn("_period", F.least(active, remaining))
    out = out.withColumn("_paid", F.greatest(F.lit(0), F.col("_period") - F.col("_grace")))
    early = F.col("_paid") <= F.col("_k1")
    of = lambda first, later: F.when(early, first).otherwise(later)
    out = out.withColumn("_leg", F.struct(
        of(F.col("principal"), F.col("_b1")).alias("of"), (of(F.col("_r1"), F.col("_r2")) / 12).alias("rate"),
        (F.col("_periods") - of(F.lit(0), F.col("_k1"))).alias("total"), (F.col("_paid") - of(F.lit(0), F.col("_k1"))).alias("paid")))
    level = F.col("_leg.of") * _annuity_share(F.col("_leg.rate"), F.col("_leg.total"), F.col("_leg.paid"))
    repaid = F.get("_repaid", F.least(F.col("_paid"), F.size("_repaid") - 1))
    through = (F.col("_period") >= remaining) & (F.col("_periods") > 0)
    return out.withColumn(name, (
        F.when(kind == "BULLET", F.when(through, d(0)).otherwise(F.col("principal")))
        .when(kind == "EQUAL_PRINCIPAL", F.greatest(d(0), F.col("principal") - F.col("_paid") * (F.col("principal") / remaining)))
        .when(kind == "AMORTIZING", F.when(F.col("_periods") <= 0, F.col("principal")).otherwise(level))
        .when(kind == "CUSTOM_SCHEDULE", F.greatest(d(0), F.col("principal") - repaid))
        .otherwise(F.col("principal")))).drop("_period", "_paid", "_leg")


def _table(terms: DataFrame, horizon: Column | None, rate_delta: Column | None, keep: list[str]) -> DataFrame:
    """The rows of loan_schedule from the loans with their terms. No expression is evaluated element by element, so that
    the whole table is generated code."""
    rate_delta = d(0) if rate_delta is None else rate_delta
    kind, remaining = F.col("repayment_type"), F.col("remaining_months")
    variable = F.col("rate_type") == "VARIABLE"
    after = F.greatest(d(0), F.col("annual_rate") + F.when(variable, rate_delta).otherwise(d(0)))
    out = terms.withColumn("_r2", after)
    if "month_index" not in terms.columns:
        out = out.withColumn("month_index", F.explode(F.sequence(F.lit(1), horizon)))
    out = out.withColumn("_active", F.col("month_index") - F.col("_wait"))
    opening = F.greatest(F.lit(0), F.col("_active") - 1)
    out = _balance(_balance(out, "opening", opening), "closing", F.greatest(F.lit(0), F.col("_active")))

    rate = F.when(F.col("month_index") >= F.col("_switch"), F.col("_r2")).otherwise(F.col("_r1"))
    out = out.withColumn("rate", rate)
    paying = (F.col("opening") > 0) & (F.col("_active") >= 1) & (F.col("_active") <= remaining)
    entry = F.get("custom", F.col("_active") - 1)
    known = kind.isin("BULLET", "EQUAL_PRINCIPAL", "AMORTIZING", "CUSTOM_SCHEDULE")
    status = (
        F.when(paying & ~known, "UNSUPPORTED_REPAYMENT")
        .when(paying & (kind == "CUSTOM_SCHEDULE") & entry.isNull(), "CUSTOM_SCHEDULE_MISSING").otherwise("OK"))
    out = out.withColumn("status", status)
    good = F.col("status") == "OK"
    # a missing entry pays nothing during grace as well, as the entry is read first
    interest = F.when(~paying, d(0)).when(kind == "CUSTOM_SCHEDULE", entry["interest"].cast("double")).otherwise(
        F.col("opening") * (F.col("rate") / 12))
    return out.select(*keep, "month_index", "opening", F.when(good, interest).alias("interest"),
                      F.when(good, F.when(paying, F.col("opening") - F.col("closing")).otherwise(d(0))).alias("principal"),
                      "closing", "rate", "status")


def debt_service(loans: DataFrame, needed: DataFrame, keys: list[str], forecast_start: Column | None = None) -> DataFrame:
    """Interest and principal per (keys, rate_delta, month_index), summed over a store's loans.

    `needed` names the months in which each rate change applies: a month reads its own change's
    table, so only that row of it is worked out. A store may own any number of loans, so its
    loans are spread by loan id."""
    months = needed.select(*keys, "rate_delta", "month_index").distinct()
    grace = F.col("grace_months") if "grace_months" in loans.columns else None
    terms = _terms(loans, forecast_start, grace).drop("next_payment_date", "grace_end_date", "renewal_month")
    runs = salted_join(terms, months, keys, F.col("loan_id"))
    rows = _table(runs, None, F.col("rate_delta"), [*keys, "rate_delta"])
    return rows.groupBy(*keys, "rate_delta", "month_index").agg(
        F.sum("interest").alias("interest"), F.sum("principal").alias("principal"))
