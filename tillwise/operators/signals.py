"""Store signals from accepted events and the scenario adjustments they add up to."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tillwise.functions.core import clip, d, first_by, lookup, month_gap, rnd, stable_id
from tillwise.functions.geo import geo_exposure
from tillwise.functions.places import signal_relevance
from tillwise.functions.skew import salted_join
from tillwise.operators.events import month_overlap
from tillwise.sources.registry import COEFFICIENTS, SEVERITY_V1, TIER_WEIGHT

DECAY_PER_MONTH = 0.15


def evidence_score(tier: Column, quote: Column | float = 1.0, temporal: Column | float = 1.0, conflict: Column | float = 1.0) -> Column:
    return rnd(clip(lookup(TIER_WEIGHT, tier, d(0)) * quote * temporal * conflict, 0.0, 1.0), 4)


def schedule_overlap(event_from: Column, event_to: Column, open_from: Column, open_to: Column) -> Column:
    """Share of the opening hours that the event's hours cover; 1 when either is unknown."""
    begin, end = F.greatest(event_from, open_from), F.least(event_to, open_to)
    unknown = event_from.isNull() | event_to.isNull() | open_from.isNull() | open_to.isNull()
    return F.when(unknown, d(1)).when(begin >= end, d(0)).when(open_to - open_from <= 0, d(1)).otherwise(
        rnd((end - begin) / (open_to - open_from), 4))


def store_signals(events: DataFrame, stores: DataFrame, found_by: DataFrame, forecast_start: Column, months: int) -> DataFrame:
    """Signals per (event, store, month, axis), before causes are deduplicated.

    `found_by(store_id, event_id)` says which events a store's research found; events are the
    accepted ones with their registry severity. A month without overlap keeps a zero row."""
    live = events.filter("signal_enabled")
    pairs = salted_join(found_by, live, ["event_id"], F.col("store_id"))
    pairs = salted_join(pairs, stores, ["store_id"], F.col("event_id"))
    geo = F.when(F.col("domain") == "LOCAL", geo_exposure(F.col("store_lat"), F.col("store_lon"), F.col("lat"), F.col("lon"))["exposure"]).otherwise(d(1))
    pairs = pairs.withColumns({
        "evidence": evidence_score(F.col("source_tier")), "geo": geo,
        "relevance": signal_relevance(F.col("business_type_code"), F.col("industries")),
        "schedule": schedule_overlap(F.col("event_from"), F.col("event_to"), F.col("open_from"), F.col("open_to"))})
    rows = pairs.withColumn("month_index", F.explode(F.sequence(F.lit(1), F.lit(months))))
    rows = rows.withColumn("month", F.add_months(forecast_start, F.col("month_index") - 1)).withColumn("impact", F.explode("impacts"))
    exposure = F.col("geo") * month_overlap(F.col("start_date"), F.col("end_date"), F.col("month")) * F.col("relevance") * F.col("schedule")
    decay = 1.0 / (1.0 + DECAY_PER_MONTH * F.greatest(F.lit(0), month_gap(F.col("month"), F.col("start_date"))))
    direction = F.when(F.col("impact.direction") == "INCREASE", 1).when(F.col("impact.direction") == "DECREASE", -1).otherwise(0)
    exposed = F.when((F.col("impact.axis") == "INTEREST_COST") & ~F.col("variable_debt"), d(0)).otherwise(d(1))
    rows = rows.withColumns({"exposure": exposure, "decay": decay, "direction": direction})
    raw = F.col("direction") * F.col("evidence") * F.col("exposure") * F.col("severity") * F.col("decay") * exposed
    return rows.select(
        stable_id("SIG-", 20, F.col("event_id"), F.col("store_id"), F.date_format("month", "yyyy-MM"), F.col("impact.axis")).alias("signal_id"),
        "store_id", "event_id", "month", F.col("impact.axis").alias("axis"), "direction", "evidence", "exposure", "severity", "decay",
        raw.alias("raw"), "cause_group_id", "source_tier")


def dedupe_causes(signals: DataFrame) -> DataFrame:
    """Strongest signal per (store, month, axis, cause); the first event wins a tie."""
    keys = ["store_id", "month", "axis", "cause"]
    rows = signals.withColumn("cause", F.coalesce("cause_group_id", F.col("event_id").cast("string")))
    rest = [c for c in rows.columns if c not in keys]
    strongest = first_by(F.struct(*rest), (-F.abs("raw")).alias("size"), F.col("event_id"))
    return rows.groupBy(*keys).agg(strongest.alias("x")).select(*keys, "x.*")


def scenario_adjustments(signals: DataFrame, scaffold: DataFrame) -> DataFrame:
    """Adjustment per (store, scenario, month). `scaffold(store_id, month)` makes empty months
    neutral; BASELINE is neutral but counts the month's signals."""
    sums = []
    for scenario, table in COEFFICIENTS.items():
        for axis, (beta, _, _) in table.items():
            sums.append(F.sum(F.when(F.col("axis") == axis, F.col("raw") * beta)).alias(f"{scenario}__{axis}"))
    months = signals.groupBy("store_id", "month").agg(
        F.count("*").alias("signal_count"), F.count_distinct("event_id").alias("event_count"), *sums)
    rows = scaffold.join(months, ["store_id", "month"], "left")

    def adjust(scenario: str) -> Column:
        if scenario == "BASELINE":
            return F.struct(F.lit(scenario).alias("scenario"), d(1).alias("revenue_multiplier"), d(1).alias("variable_cost_multiplier"),
                            d(1).alias("fixed_cost_multiplier"), d(0).alias("rate_delta"))
        table = COEFFICIENTS[scenario]
        shock = lambda axis: F.coalesce(F.col(f"{scenario}__{axis}"), d(0))
        lift = lambda value, axis: rnd(F.exp(clip(value, table[axis][1], table[axis][2])), 6)
        demand = shock("REVENUE_DEMAND") - shock("COMPETITION") - F.abs(shock("UNCERTAINTY"))
        return F.struct(
            F.lit(scenario).alias("scenario"), lift(demand, "REVENUE_DEMAND").alias("revenue_multiplier"),
            (lift(shock("INGREDIENT_COST"), "INGREDIENT_COST") * lift(shock("PLATFORM_COST"), "PLATFORM_COST")).alias("variable_cost_multiplier"),
            lift(shock("OPERATING_COST"), "OPERATING_COST").alias("fixed_cost_multiplier"), F.greatest(d(0), shock("INTEREST_COST")).alias("rate_delta"))

    rows = rows.withColumn("_a", F.explode(F.array(*[adjust(s) for s in ("BASELINE", *COEFFICIENTS)])))
    return rows.select("store_id", "month", "_a.*", F.coalesce("signal_count", F.lit(0)).alias("signal_count"), F.coalesce("event_count", F.lit(0)).alias("event_count"))


def mean_adjustment(adjustments: DataFrame) -> DataFrame:
    """One adjustment per store and scenario: the mean over months."""
    return adjustments.groupBy("store_id", "scenario").agg(
        *[F.avg(c).alias(c) for c in ("revenue_multiplier", "variable_cost_multiplier", "fixed_cost_multiplier", "rate_delta")],
        F.sum("signal_count").alias("signal_count"))


def signal_multiplier(signals: DataFrame, keys: list[str], beta: float = -0.05, low: float = -0.30, high: float = 0.30) -> DataFrame:
    """Version-1 multiplier: exp of the clipped weighted sum, to four digits."""
    return signals.groupBy(*keys).agg(rnd(F.exp(clip(F.sum(F.col("raw") * beta), low, high)), 4).alias("multiplier"))


def severity_v1(event_type: Column) -> Column:
    return lookup(SEVERITY_V1, event_type, d(0.5))
