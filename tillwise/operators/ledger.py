"""Cash ledger, break-even, burn date and scenario runs for every store at once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tillwise.functions.core import d, last_by, month_gap
from tillwise.functions.skew import merge_join
from tillwise.operators.loans import debt_service

COMPONENTS = ["revenue", "variable_cost", "fixed_cost", "interest", "principal", "tax", "capex"]


def last_ledger_month(history: DataFrame) -> DataFrame:
    """The last month of every store; costs of all forecast months start from it."""
    fields = [c for c in history.columns if c not in ("store_id",)]
    return history.groupBy("store_id").agg(last_by(F.struct(*fields), F.col("month")).alias("m")).select("store_id", "m.*")


def net_cash_flow() -> Column:
    other = F.coalesce(F.col("other_inflow"), d(0))
    return (F.col("revenue") - F.col("variable_cost") - F.col("fixed_cost") - F.col("interest")
            - F.col("principal") - F.col("tax") - F.col("capex") + other)


def cash_ledger(flows: DataFrame, keys: list[str], opening: Column) -> DataFrame:
    """Adds net, begin and end cash; a key has one row per forecast month."""
    if "other_inflow" not in flows.columns:
        flows = flows.withColumn("other_inflow", d(0))
    order = Window.partitionBy(*keys).orderBy("month_index")
    running = order.rowsBetween(Window.unboundedPreceding, 0)
    flows = flows.withColumn("net", net_cash_flow())
    flows = flows.withColumn("ending_cash", opening + F.sum("net").over(running))
    return flows.withColumn("beginning_cash", F.coalesce(F.lag("ending_cash").over(order), opening))


def break_even(flows: DataFrame) -> DataFrame:
    """Operating, financial and cash break-even; UNATTAINABLE at a non-positive margin."""
    ratio = F.when(F.col("revenue") <= 0, d(1)).otherwise(F.try_divide(F.col("variable_cost"), F.col("revenue")))
    out = flows.withColumn("variable_cost_ratio", ratio)
    out = out.withColumn("margin_ratio", F.when(F.col("revenue") <= 0, d(0)).otherwise(1 - F.col("variable_cost_ratio")))
    at = lambda amount: F.when(F.col("margin_ratio") > 0, F.try_divide(amount, F.col("margin_ratio")))
    financial = F.col("fixed_cost") + F.col("interest")
    return (
        out.withColumn("operating_bep", at(F.col("fixed_cost")))
        .withColumn("financial_bep", at(financial))
        .withColumn("cash_bep", at(financial + F.col("principal") + F.col("tax") + F.col("capex")))
        .withColumn("bep_status", F.when(F.col("margin_ratio") > 0, "NORMAL").otherwise("UNATTAINABLE"))
    )


def cash_burn(ledger: DataFrame, keys: list[str], minimum_cash: Column) -> DataFrame:
    """First month out of cash and first month below the minimum, with the burn day."""
    short = ledger.withColumn("_min", minimum_cash)
    pick = F.struct("month", "month_index", "beginning_cash", "net")
    order = F.struct("month_index")
    out = short.groupBy(*keys).agg(
        F.min_by(F.when(F.col("ending_cash") <= 0, pick),
                 F.when(F.col("ending_cash") <= 0, order)).alias("b"),
        F.min(F.when(F.col("ending_cash") <= F.col("_min"), F.col("month"))).alias("liquidity_risk_month"),
    )
    days = F.day(F.last_day("b.month")).cast("double")
    begin, drain = F.col("b.beginning_cash"), F.abs("b.net")
    to_burn = F.when(begin <= 0, d(1)).when(drain > 0, days * begin / drain).otherwise(days)
    burn_day = F.when(begin <= 0, F.lit(1)).when(
        drain > 0, F.greatest(F.lit(1), F.least(days.cast("int"), F.floor(days * begin / drain).cast("int")))
    ).otherwise(days.cast("int"))
    return out.select(
        *keys,
        F.when(F.col("b").isNull(), "NO_BURN_WITHIN_HORIZON").otherwise("BURN_WITHIN_HORIZON").alias("horizon_status"),
        F.col("b.month_index").alias("burn_month_index"),
        F.when(F.col("b").isNotNull(), to_burn).alias("days_to_burn"),
        F.when(F.col("b").isNotNull(), F.date_add(F.col("b.month"), burn_day - 1)).alias("burn_date"),
        F.col("liquidity_risk_month").alias("liquidity_risk_date"),
    )


def apply_fixed_overrides(fixed: DataFrame, overrides: DataFrame) -> DataFrame:
    """fixed(store_id, month, category, amount); a later override of a category wins."""
    last = overrides.groupBy("store_id", "month", "category").agg(last_by(F.col("amount"), F.col("seq")).alias("override"))
    return merge_join(fixed, last, ["store_id", "month", "category"], "left").withColumn(
        "amount", F.coalesce("override", "amount"))


def fixed_by_month(last: DataFrame, months: DataFrame, overrides: DataFrame | None) -> DataFrame:
    """Fixed cost per (store, month) after overrides."""
    rows = merge_join(
        months.select("store_id", "month").distinct(),
        last.select("store_id", F.explode(F.array(*[
            F.struct(F.lit(c).alias("category"), F.col(c).alias("amount"))
            for c in ("rent", "labor", "utilities", "other")])).alias("f")).select("store_id", "f.*"), ["store_id"])
    if overrides is not None:
        rows = apply_fixed_overrides(rows, overrides)
    return rows.groupBy("store_id", "month").agg(F.sum("amount").alias("fixed_base"))


def has_variable_debt(stores: DataFrame, loans: DataFrame) -> DataFrame:
    """store_id, variable_debt: some loan floats and the declared variable share is positive."""
    floating = loans.groupBy("store_id").agg(F.max(F.col("rate_type") == "VARIABLE").alias("floating"))
    return merge_join(stores, floating, ["store_id"], "left").select(
        "store_id", (F.coalesce("floating", F.lit(False)) & (F.col("variable_debt_share") > 0)).alias("variable_debt"))


def every_month(adjustments: DataFrame, keys: list[str], horizon: int, forecast_start: Column) -> DataFrame:
    """The adjustments of each run for every forecast month, neutral where there is none. Two rows for one
    month of a run are an error: Spark refuses a map with a key twice."""
    neutral = {"revenue_multiplier": 1, "variable_cost_multiplier": 1, "fixed_cost_multiplier": 1, "rate_delta": 0}
    by_month = adjustments.groupBy(*keys).agg(F.map_from_entries(F.collect_list(F.struct("month", F.struct(*neutral)))).alias("_by_month"))
    months = F.explode(F.transform(F.sequence(F.lit(0), F.lit(horizon - 1)), lambda i: F.add_months(forecast_start, i)))
    rows = by_month.withColumn("month", months)
    found = F.try_element_at("_by_month", F.col("month"))
    return rows.select(*keys, "month", *[F.coalesce(found[c], d(v)).alias(c) for c, v in neutral.items()])


def alignment_issues(adjustments: DataFrame, stores: DataFrame, keys: list[str], horizon: int, forecast_start: Column) -> DataFrame:
    """(keys…, month, code): where adjustments and forecast months do not meet one to one. MONTH_OUTSIDE_HORIZON, MONTH_REPEATED
    and MONTH_MISSING for a run and a month; RUN_MISSING for a store without any run (its other keys and month are null)."""
    last = F.add_months(forecast_start, horizon - 1)
    counted = adjustments.groupBy(*keys, "month").agg(F.count("*").alias("_n"))
    inside = F.col("month").between(forecast_start, last) & (F.col("month") == F.trunc("month", "month"))
    code = F.when(~F.coalesce(inside, F.lit(False)), "MONTH_OUTSIDE_HORIZON").when(F.col("_n") > 1, "MONTH_REPEATED")
    odd = counted.select(*keys, "month", code.alias("code")).where("code is not null")
    months = F.explode(F.transform(F.sequence(F.lit(0), F.lit(horizon - 1)), lambda i: F.add_months(forecast_start, i)))
    due = counted.select(*keys).distinct().withColumn("month", months)
    missing = due.join(counted.select(*keys, "month"), [*keys, "month"], "left_anti").withColumn("code", F.lit("MONTH_MISSING"))
    alone = stores.select("store_id").join(counted.select("store_id").distinct(), "store_id", "left_anti")
    kinds = dict(odd.dtypes)
    alone = alone.select("store_id", *[F.lit(None).cast(kinds[c]).alias(c) for c in (*keys[1:], "month")], F.lit("RUN_MISSING").alias("code"))
    return odd.unionByName(missing).unionByName(alone)


def monthly_scenario(stores: DataFrame, history: DataFrame, forecasts: DataFrame, adjustments: DataFrame,
                     loans: DataFrame, horizon: int, forecast_start: Column, keys: list[str],
                     features: DataFrame | None = None, overrides: DataFrame | None = None) -> DataFrame:
    """Ledger of every (keys…) run: keys start with store_id and name the scenario or policy.

    forecasts(store_id, month_index, month, point); adjustments(keys…, month, revenue_multiplier,
    variable_cost_multiplier, fixed_cost_multiplier, rate_delta); a month without an adjustment
    row is neutral. features(month, …) has one row per forecast month. `loans` may carry the
    extra keys (a policy's modified loans) or only store_id."""
    last = last_ledger_month(history)
    debt = has_variable_debt(stores, loans.select("store_id", "rate_type"))
    # rate changes come from the adjustments alone, so the loan runs do not wait for forecasts
    plan = merge_join(every_month(adjustments, keys, horizon, forecast_start), debt, ["store_id"])
    if features is not None:
        # one row per forecast month; Spark broadcasts it once it has measured its size
        plan = plan.join(features.select(
            "month", "domestic_multiplier", "imported_multiplier", "interest_rate_delta"), "month", "left")
        mix = F.coalesce((1 - F.col("imported_share")) * F.col("domestic_multiplier")
                         + F.col("imported_share") * F.col("imported_multiplier"), d(1))
        official_delta = F.coalesce("interest_rate_delta", d(0))
    else:
        mix, official_delta = d(1), d(0)
    plan = plan.withColumn("rate_delta", F.when(F.col("variable_debt"), F.col("rate_delta") + official_delta).otherwise(d(0)))
    loan_keys = [k for k in keys if k in loans.columns]
    plan = plan.withColumn("_month_index", (month_gap(F.col("month"), forecast_start) + 1).cast("int"))
    needed = plan.filter(F.col("_month_index").between(1, horizon)).select(*loan_keys, "rate_delta", F.col("_month_index").alias("month_index"))
    service = debt_service(loans, needed, loan_keys, forecast_start)
    plan = plan.drop("_month_index")
    points = forecasts.filter(F.col("point").isNotNull()).select("store_id", "month_index", "month", "point")
    ratio = lambda c: F.when(F.col("l.revenue") > 0, F.try_divide(F.col("l." + c), F.col("l.revenue"))).otherwise(d(0))
    base = merge_join(stores.alias("s"), last.alias("l"), ["store_id"]).select(
        "store_id", F.col("s.current_cash").alias("current_cash"), F.col("s.min_cash").alias("min_cash"),
        F.col("s.imported_share").alias("imported_share"), ratio("ingredients").alias("ingredient_ratio"),
        (ratio("platform_fee") + ratio("payment_fee")).alias("other_ratio"), F.col("l.tax").alias("tax"), F.col("l.capex").alias("capex"),
        (F.col("l.rent") + F.col("l.labor") + F.col("l.utilities") + F.col("l.other")).alias("fixed_base"))
    rows = merge_join(points, base, ["store_id"])
    if overrides is not None:
        changed = fixed_by_month(last, overrides.select("store_id", "month"), overrides)
        rows = merge_join(rows, changed.withColumnRenamed("fixed_base", "fixed_changed"), ["store_id", "month"], "left") \
            .withColumn("fixed_base", F.coalesce("fixed_changed", "fixed_base")).drop("fixed_changed")
    rows = merge_join(merge_join(rows, plan, ["store_id", "month"]), service, [*loan_keys, "rate_delta", "month_index"], "left")
    revenue = F.col("point") * F.col("revenue_multiplier")
    rows = rows.withColumn("revenue", revenue).withColumns({
        "ingredient_cost": F.col("revenue") * F.col("ingredient_ratio") * mix * F.col("variable_cost_multiplier"),
        "other_variable_cost": F.col("revenue") * F.col("other_ratio") * F.col("variable_cost_multiplier"),
        "fixed_cost": F.col("fixed_base") * F.col("fixed_cost_multiplier"),
        "interest": F.coalesce("interest", d(0)), "principal": F.coalesce("principal", d(0))})
    rows = rows.withColumn("variable_cost", F.col("ingredient_cost") + F.col("other_variable_cost"))
    return cash_ledger(rows, keys, F.col("current_cash"))


def scenario_rows(scenarios: list[tuple]) -> Column:
    """Literal scenarios (name, revenue, variable, fixed multiplier, rate change) as an array."""
    return F.array(*[
        F.struct(F.lit(name).alias("scenario"), d(rev).alias("revenue_multiplier"),
                 d(var).alias("variable_cost_multiplier"), d(fix).alias("fixed_cost_multiplier"),
                 d(rate).alias("rate_delta"))
        for name, rev, var, fix, rate in scenarios
    ])


def request_adjustments(requests: DataFrame, horizon: int, forecast_start: Column) -> DataFrame:
    """What-if requests (store_id, scenario, revenue_multiplier, variable_cost_multiplier, fixed_cost_multiplier, rate_delta)
    as adjustments of every forecast month; a request that arrives twice counts once."""
    months = F.explode(F.transform(F.sequence(F.lit(0), F.lit(horizon - 1)), lambda i: F.add_months(forecast_start, i)))
    return requests.distinct().withColumn("month", months)


def request_key(requests: DataFrame) -> DataFrame:
    """Adds `request_hash`, the idempotency key of a request: equal for equal stores, names and changes."""
    parts = ["store_id", "scenario", "revenue_multiplier", "variable_cost_multiplier", "fixed_cost_multiplier", "rate_delta"]
    return requests.withColumn("request_hash", F.sha2(F.concat_ws("|", *[F.col(c).cast("string") for c in parts]), 256))


def flat_scenario(stores: DataFrame, history: DataFrame, scenarios: list[tuple], loans: DataFrame,
                  horizon: int) -> DataFrame:
    """Version-1 run: the last month repeated under constant multipliers, one run per literal
    scenario of `scenario_rows`."""
    last = last_ledger_month(history)
    base = merge_join(stores.select("store_id", "current_cash", "min_cash"), last, ["store_id"])
    rows = base.withColumn("_s", F.explode(scenario_rows(scenarios))).select("*", "_s.*").drop("_s")
    rows = rows.withColumn("month_index", F.explode(F.sequence(F.lit(1), F.lit(horizon))))
    rows = rows.withColumn("start_month", F.add_months("month", 1)).withColumn("month", F.add_months("month", F.col("month_index")))
    variable = F.col("ingredients") + F.col("platform_fee") + F.col("payment_fee")
    fixed = F.col("rent") + F.col("labor") + F.col("utilities") + F.col("other")
    rows = (
        rows.withColumn("variable_cost", variable * F.col("variable_cost_multiplier"))
        .withColumn("fixed_cost", fixed * F.col("fixed_cost_multiplier"))
        .withColumn("revenue", F.col("revenue") * F.col("revenue_multiplier"))
    )
    service = debt_service(loans, rows, ["store_id"])
    rows = merge_join(rows, service, ["store_id", "rate_delta", "month_index"], "left")
    rows = rows.withColumn("interest", F.coalesce("interest", d(0))).withColumn("principal", F.coalesce("principal", d(0)))
    return cash_ledger(rows, ["store_id", "scenario"], F.col("current_cash"))


def funding_gap(ledger: DataFrame, keys: list[str]) -> DataFrame:
    """Cash needed so that the worst month still ends at the store's minimum."""
    out = ledger.groupBy(*keys).agg(F.min("ending_cash").alias("min_ending_cash"), F.max("min_cash").alias("min_cash"))
    return out.withColumn("required_funding", F.greatest(d(0), F.col("min_cash") - F.col("min_ending_cash")))


def layer_delta(ledger: DataFrame, pairs: list[tuple[str, str]]) -> DataFrame:
    """Month-by-month difference of two layers of one store, signed so that plus helps cash."""
    cols = ["revenue", "ingredient_cost", "other_variable_cost", "fixed_cost", "interest", "principal", "tax",
            "capex", "other_inflow", "ending_cash"]
    left = ledger.select("store_id", "month", F.col("scenario").alias("from_layer"),
                         *[F.col(c).alias("a_" + c) for c in cols])
    left = left.withColumn("to_layer", F.explode(F.array_compact(F.array(*[
        F.when(F.col("from_layer") == a, F.lit(b)) for a, b in pairs]))))
    right = ledger.select("store_id", "month", F.col("scenario").alias("to_layer"), *cols)
    out = merge_join(left, right, ["store_id", "month", "to_layer"])
    sign = {"revenue": 1.0, "other_inflow": 1.0, "ending_cash": 1.0}
    return out.select("store_id", "month", "from_layer", "to_layer",
                      *[((F.col(c) - F.col("a_" + c)) * sign.get(c, -1.0)).alias(c + "_effect") for c in cols])


def attribution(delta: DataFrame) -> DataFrame:
    """Sum over months of each component's signed effect."""
    parts = [c for c in delta.columns if c.endswith("_effect") and c != "ending_cash_effect"]
    stacked = delta.select("store_id", "from_layer", "to_layer", F.explode(F.array(*[
        F.struct(F.lit(c[:-7].upper()).alias("component"), F.col(c).alias("effect")) for c in parts])).alias("x"))
    return stacked.groupBy("store_id", "from_layer", "to_layer", F.col("x.component").alias("component")).agg(
        F.sum("x.effect").alias("effect"))


def primary_driver(attrib: DataFrame) -> DataFrame:
    """Non-zero component with the largest absolute effect, name breaking ties."""
    nonzero = attrib.filter(F.abs("effect") > 1e-6)
    return nonzero.groupBy("store_id", "from_layer", "to_layer").agg(
        F.min_by(F.struct("component", "effect"), F.struct((-F.abs("effect")).alias("size"), F.col("component"))).alias("p")
    ).select("store_id", "from_layer", "to_layer", "p.component", "p.effect")
