"""Loan, ledger, scenario and attribution queries."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from tillwise.functions.core import d, day_name, month_name, month_scaffold, rnd, whole_won
from tillwise.functions.stages import new_stage, shared_folder, staged
from tillwise.operators import forecast as fc
from tillwise.operators import ledger as lg
from tillwise.operators import smoothing
from tillwise.operators.loans import debt_service as service_of
from tillwise.operators.loans import loan_schedule as schedule_of
from tillwise.plans import bindings as b
from tillwise.plans import q_forecast  # noqa: F401  (its CTEs)
from tillwise.plans.catalog import cte, query, r, sql
from tillwise.plans.q_forecast import fits
from tillwise.plans.q_official import features
from tillwise.sources import sinks

MONEY = ["revenue", "variable_cost", "fixed_cost", "interest", "principal", "net", "ending_cash"]

# name, revenue, variable and fixed multiplier, rate change
SCENARIOS = [("BASELINE", 1.0, 1.0, 1.0, 0.0), ("LOW_IMPACT", 0.97, 1.02, 1.01, 0.002), ("HIGH_IMPACT", 0.92, 1.05, 1.03, 0.005)]
FLAT_SCENARIOS = [("BASELINE", 1.0, 1.0, 1.0, 0.0), ("LOW_IMPACT", 0.95, 1.0, 1.0, 0.0), ("HIGH_IMPACT", 0.90, 1.0, 1.0, 0.01)]
WHAT_IFS = [("RENT_CUT", 1.0, 1.0, 0.9, 0.0), ("PRICE_UP", 1.05, 1.0, 1.0, 0.0), ("COST_SHOCK", 1.0, 1.2, 1.0, 0.01),
            ("RATE_UP", 1.0, 1.0, 1.0, 0.02)]


def values(rows):
    return "(VALUES " + ", ".join(f"('{n}', {v}::DOUBLE, {w}::DOUBLE, {x}::DOUBLE, {y}::DOUBLE)" for n, v, w, x, y in rows) \
        + ") a(scenario, revenue_multiplier, variable_cost_multiplier, fixed_cost_multiplier, rate_base)"


# ---- loans ---------------------------------------------------------------------------------

cte("dated_sched", b.schedule_sql("loans", "dated_sched"), "loans")


@query("loan_schedule", sql(f"""
SELECT store_id, loan_id, m AS month_index, {r('opening', 2)} AS opening, {r('interest', 3)} AS interest, {r('paid', 2)} AS principal,
  {r('bal', 2)} AS closing, {r('rate', 6)} AS rate, status FROM dated_sched WHERE m > 0""", "dated_sched"))
def loan_schedule(spark, sf):
    out = schedule_of(b.loans(spark, sf), F.lit(b.HORIZON), b.start(), d(0.01))
    return out.select("store_id", "loan_id", "month_index", rnd(F.col("opening"), 2).alias("opening"), rnd(F.col("interest"), 3).alias("interest"),
                      rnd(F.col("principal"), 2).alias("principal"), rnd(F.col("closing"), 2).alias("closing"), rnd(F.col("rate"), 6).alias("rate"), "status")


cte("debt_runs", "SELECT l.*, v.rate_delta FROM loans l, (VALUES (0.0::DOUBLE), (0.01::DOUBLE)) v(rate_delta)", "loans")
cte("debt_sched", b.schedule_sql("debt_runs", "debt_sched", "rate_delta", extra=("rate_delta",)), "debt_runs")


@query("debt_service", sql(f"""
SELECT store_id, rate_delta, m AS month_index, {r('sum(interest)', 2)} AS interest, {r('sum(paid)', 2)} AS principal
FROM debt_sched WHERE m > 0 GROUP BY store_id, rate_delta, m""", "debt_sched"))
def debt_service(spark, sf):
    needed = b.stores(spark, sf).select("store_id", F.explode(F.array(d(0), d(0.01))).alias("rate_delta"))
    needed = needed.withColumn("month_index", F.explode(F.sequence(F.lit(1), F.lit(b.HORIZON))))
    out = service_of(b.loans(spark, sf), needed, ["store_id"], b.start())
    return out.select("store_id", "rate_delta", "month_index", rnd(F.col("interest"), 2).alias("interest"), rnd(F.col("principal"), 2).alias("principal"))


# ---- oracle ledgers ------------------------------------------------------------------------

cte("variable_debt", """
SELECT s.store_id, s.variable_debt_share > 0 AND coalesce(bool_or(l.rate_type = 'VARIABLE'), false) AS variable_debt
FROM stores s LEFT JOIN loans l USING (store_id) GROUP BY s.store_id, s.variable_debt_share""", "stores", "loans")
cte("override_last", "SELECT store_id, month, category, max_by(amount, seq) AS amount FROM overrides GROUP BY 1, 2, 3", "overrides")


def ledger_ctes(prefix: str, scenarios, with_features: bool, with_overrides: bool, alternate: bool = False) -> None:
    """CTEs `<prefix>_ledger` with the running cash of every store and scenario."""
    fixed = "l.rent + l.labor + l.utilities + l.other"
    if with_overrides:
        fixed = " + ".join(f"coalesce((SELECT o.amount FROM override_last o WHERE o.store_id = b.store_id AND o.month = b.month AND o.category = '{c}'), l.{c})"
                           for c in ("rent", "labor", "utilities", "other"))
    point = "b.point * f.revenue_index_multiplier" if with_features else "b.point"
    mix = "((1 - s.imported_share) * f.domestic_multiplier + s.imported_share * f.imported_multiplier)" if with_features else "1.0::DOUBLE"
    official = "f.interest_rate_delta" if with_features else "0.0::DOUBLE"
    rate = "a.rate_base * (b.month_index % 2)" if alternate else "a.rate_base"
    join = "JOIN features f ON f.month_index = b.month_index" if with_features else ""
    deps = ["baseline", "last_month", "stores", "variable_debt"] + (["features"] if with_features else []) + (["override_last"] if with_overrides else [])
    cte(f"{prefix}_flows", f"""
SELECT b.store_id, a.scenario, b.month_index, b.month, CASE WHEN v.variable_debt THEN {rate} + {official} ELSE 0.0::DOUBLE END AS rate_delta,
  {point} * a.revenue_multiplier AS revenue, {point} * a.revenue_multiplier * (l.ingredients / l.revenue) * {mix} * a.variable_cost_multiplier AS ingredient_cost,
  {point} * a.revenue_multiplier * (l.platform_fee / l.revenue + l.payment_fee / l.revenue) * a.variable_cost_multiplier AS other_variable_cost,
  ({fixed}) * a.fixed_cost_multiplier AS fixed_cost, l.tax, l.capex, s.current_cash, s.min_cash
FROM baseline b JOIN last_month l USING (store_id) JOIN stores s USING (store_id) JOIN variable_debt v USING (store_id) {join} CROSS JOIN {values(scenarios)}
WHERE b.point IS NOT NULL""", *deps)
    cte(f"{prefix}_runs", f"SELECT l.*, r.rate_delta FROM loans l JOIN (SELECT DISTINCT store_id, rate_delta FROM {prefix}_flows) r USING (store_id)",
        "loans", f"{prefix}_flows")
    cte(f"{prefix}_sched", b.schedule_sql(f"{prefix}_runs", f"{prefix}_sched", "rate_delta", extra=("rate_delta",)), f"{prefix}_runs")
    cte(f"{prefix}_ledger", f"""
SELECT *, current_cash + sum(net) OVER (PARTITION BY store_id, scenario ORDER BY month_index) AS ending_cash,
  current_cash + coalesce(sum(net) OVER (PARTITION BY store_id, scenario ORDER BY month_index ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0::DOUBLE) AS beginning_cash
FROM (SELECT *, revenue - variable_cost - fixed_cost - interest - principal - tax - capex AS net FROM (
  SELECT f.*, ingredient_cost + other_variable_cost AS variable_cost, coalesce(d.interest, 0.0::DOUBLE) AS interest, coalesce(d.principal, 0.0::DOUBLE) AS principal
  FROM {prefix}_flows f LEFT JOIN (SELECT store_id, rate_delta, m AS month_index, sum(interest) AS interest, sum(paid) AS principal FROM {prefix}_sched WHERE m > 0 GROUP BY 1, 2, 3) d
    USING (store_id, rate_delta, month_index)))""", f"{prefix}_flows", f"{prefix}_sched")


ledger_ctes("base", SCENARIOS[:1], False, False)
ledger_ctes("scen", SCENARIOS, True, True, alternate=True)
ledger_ctes("what", WHAT_IFS, True, False)
ledger_ctes("offi", SCENARIOS, True, False)
cte("layers", """
SELECT 'TREND' AS layer, * EXCLUDE (scenario) FROM base_ledger
UNION ALL SELECT CASE scenario WHEN 'BASELINE' THEN 'OFFICIAL' ELSE scenario END, * EXCLUDE (scenario) FROM offi_ledger""", "base_ledger", "offi_ledger")


# ---- spark ledgers -------------------------------------------------------------------------

def forecasts(spark, sf, official=False):
    """Baseline forecasts, written once: every ledger of a run reads the same ones."""
    build = lambda: fc.baseline_forecast(b.stores(spark, sf), b.history(spark, sf), b.start(), b.HORIZON,
                                         features(spark, sf) if official else None)
    return staged(spark, f"forecasts:{official}:{sf}", build)


def adjustments(stores, scenarios, alternate=False):
    """One constant adjustment per literal scenario and month; odd months only when alternating."""
    rows = month_scaffold(stores.select("store_id"), b.start(), F.lit(b.HORIZON))
    rows = rows.withColumn("_s", F.explode(lg.scenario_rows(scenarios))).select("*", "_s.*").drop("_s")
    rate = F.col("rate_delta") * (F.col("month_index") % 2) if alternate else F.col("rate_delta")
    return rows.withColumn("rate_delta", rate).drop("month_index")


def ledger(spark, sf, scenarios, with_features, with_overrides=False, alternate=False):
    feats = features(spark, sf) if with_features else None
    points, stores = forecasts(spark, sf, with_features), b.stores(spark, sf)
    return lg.monthly_scenario(
        stores, b.history(spark, sf), points, adjustments(stores, scenarios, alternate), b.loans(spark, sf), b.HORIZON,
        b.start(), ["store_id", "scenario"], feats, b.overrides(spark, sf) if with_overrides else None)


def base_ledger(spark, sf):
    """Baseline ledger, written once: burn, break-even, funding and benefits read the same one."""
    return staged(spark, "ledger:" + sf, lambda: ledger(spark, sf, SCENARIOS[:1], False))


def layers(spark, sf):
    return staged(spark, "layers:" + sf, lambda: derive_layers(spark, sf))


def derive_layers(spark, sf):
    trend = base_ledger(spark, sf).withColumn("scenario", F.lit("TREND"))
    official = ledger(spark, sf, SCENARIOS, True).withColumn(
        "scenario", F.when(F.col("scenario") == "BASELINE", "OFFICIAL").otherwise(F.col("scenario")))
    return trend.unionByName(official, allowMissingColumns=True)


def shown(df, *extra):
    return df.select("store_id", "scenario", month_name(F.col("month")).alias("month"), *extra, *[rnd(F.col(c), 2).alias(c) for c in MONEY])


SHOWN_SQL = "store_id, scenario, strftime(month, '%Y-%m') AS month, " + ", ".join(f"{r(c, 2)} AS {c}" for c in MONEY)


@query("baseline_forecast", sql(f"""
SELECT b.store_id, status, model, strftime(b.month, '%Y-%m') AS month, {r('point * f.revenue_index_multiplier', 2)} AS point,
  {r('greatest(0.0::DOUBLE, point * f.revenue_index_multiplier - width * f.revenue_index_multiplier)', 2)} AS lower,
  {r('point * f.revenue_index_multiplier + width * f.revenue_index_multiplier', 2)} AS upper, is_assumption_range
FROM contest_baseline b LEFT JOIN features f USING (month_index)""", "contest_baseline", "features"))
def baseline_forecast(spark, sf):
    smooth = fits(spark, sf)
    out = fc.baseline_forecast(b.stores(spark, sf), b.history(spark, sf), b.start(), b.HORIZON, features(spark, sf), extra_metrics=smoothing.ets_metrics(smooth), extra_points=smoothing.ets_points(smooth))
    return out.select("store_id", "status", "model", month_name(F.col("month")).alias("month"), rnd(F.col("point"), 2).alias("point"),
                      rnd(F.col("lower"), 2).alias("lower"), rnd(F.col("upper"), 2).alias("upper"), "is_assumption_range")


@query("cash_ledger", sql(f"SELECT {SHOWN_SQL}, {r('beginning_cash', 2)} AS beginning_cash FROM base_ledger", "base_ledger"))
def cash_ledger(spark, sf):
    return shown(ledger(spark, sf, SCENARIOS[:1], False), rnd(F.col("beginning_cash"), 2).alias("beginning_cash"))


@query("monthly_scenario", sql(f"SELECT {SHOWN_SQL}, {r('rate_delta', 8)} AS rate_delta, CAST(round(CAST(ending_cash AS DECIMAL(28,8)), 0) AS BIGINT) AS ending_cash_won FROM scen_ledger", "scen_ledger"))
def monthly_scenario(spark, sf):
    out = ledger(spark, sf, SCENARIOS, True, True, alternate=True)
    return shown(out, rnd(F.col("rate_delta"), 8).alias("rate_delta"), whole_won(F.col("ending_cash")).cast("bigint").alias("ending_cash_won"))


# adjustments with faults: stores without any, months left out, repeated and beyond the horizon
@query("scenario_alignment", sql("""
WITH a AS (SELECT store_id, s.scenario, m.m, CASE WHEN store_id % 11 = 0 AND m.m = 2 THEN 2 ELSE 1 END AS n FROM stores, (VALUES ('BASELINE'), ('LOW_IMPACT')) s(scenario), range(1, 8) m(m)
  WHERE store_id % 7 <> 0 AND NOT (store_id % 5 = 0 AND m.m = 3 AND s.scenario = 'BASELINE') AND (m.m < 7 OR store_id % 3 = 0))
SELECT store_id, scenario, strftime(DATE '2001-09-01' + to_months(CAST(m - 1 AS INTEGER)), '%Y-%m') AS month, CASE WHEN m > 6 THEN 'MONTH_OUTSIDE_HORIZON' ELSE 'MONTH_REPEATED' END AS code FROM a WHERE m > 6 OR n > 1
UNION ALL SELECT store_id, 'BASELINE', '2001-11', 'MONTH_MISSING' FROM stores WHERE store_id % 7 <> 0 AND store_id % 5 = 0
UNION ALL SELECT store_id, NULL, NULL, 'RUN_MISSING' FROM stores WHERE store_id % 7 = 0""", "stores"))
def scenario_alignment(spark, sf):
    s, m = F.col("store_id"), F.col("m")
    rows = b.stores(spark, sf).select("store_id", F.explode(F.array(F.lit("BASELINE"), F.lit("LOW_IMPACT"))).alias("scenario")).withColumn("m", F.explode(F.sequence(F.lit(1), F.lit(7))))
    rows = rows.where((s % 7 != 0) & ~((s % 5 == 0) & (m == 3) & (F.col("scenario") == "BASELINE")) & ((m < 7) | (s % 3 == 0)))
    rows = rows.withColumn("month", F.add_months(b.start(), m - 1)).withColumn("copy", F.explode(F.sequence(F.lit(1), F.when((s % 11 == 0) & (m == 2), 2).otherwise(1))))
    out = lg.alignment_issues(rows, b.stores(spark, sf), ["store_id", "scenario"], b.HORIZON, b.start())
    return out.select("store_id", "scenario", month_name(F.col("month")).alias("month"), "code")


@query("what_if_grid", sql(f"SELECT {SHOWN_SQL} FROM what_ledger", "what_ledger"))
def what_if_grid(spark, sf):
    return shown(ledger(spark, sf, WHAT_IFS, True))


# stores ask for some of the what-ifs, each twice, in two rounds; every answer is stored once under its store's next version
_ASKED = " UNION ALL ".join(f"SELECT {i} AS i, '{n}' AS scenario, '{float(a)}|{float(v)}|{float(f)}|{float(x)}' AS changes" for i, (n, a, v, f, x) in enumerate(WHAT_IFS))


@query("what_if_versions", sql(f"""
SELECT l.store_id, l.scenario, q.request_hash, q.version, {r('l.ending_cash', 2)} AS ending_cash FROM what_ledger l
JOIN (SELECT store_id, scenario, request_hash, row_number() OVER (PARTITION BY store_id ORDER BY later, request_hash)::INTEGER AS version FROM (
  SELECT store_id, scenario, i >= 2 AS later, sha256(store_id || '|' || scenario || '|' || changes) AS request_hash FROM stores, ({_ASKED}) WHERE (store_id + i) % 3 <> 0)) q USING (store_id, scenario)
WHERE l.month = DATE '2002-02-01'""", "what_ledger", "stores"))
def what_if_versions(spark, sf):
    offers = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(n).alias("scenario"), d(a).alias("revenue_multiplier"), d(v).alias("variable_cost_multiplier"), d(f).alias("fixed_cost_multiplier"), d(x).alias("rate_delta"))
                       for i, (n, a, v, f, x) in enumerate(WHAT_IFS)])
    asked = b.stores(spark, sf).select("store_id", F.explode(offers).alias("o")).select("store_id", "o.*").where((F.col("store_id") + F.col("i")) % 3 != 0)
    asked = lg.request_key(asked.unionByName(asked))
    adjusted = lg.request_adjustments(asked.drop("i", "request_hash"), b.HORIZON, b.start())
    out = lg.monthly_scenario(b.stores(spark, sf), b.history(spark, sf), forecasts(spark, sf, True), adjusted, b.loans(spark, sf), b.HORIZON, b.start(), ["store_id", "scenario"], features(spark, sf))
    last = out.where(F.col("month") == F.add_months(b.start(), b.HORIZON - 1)).select("store_id", "scenario", "ending_cash")
    answers = new_stage(asked.select("store_id", "scenario", "request_hash", "i").distinct().join(last, ["store_id", "scenario"]), "what-if")
    path = f"{shared_folder(spark)}/what-if-versions-{uuid.uuid4().hex}"
    for part in (answers.where("i < 2"), answers.where("i < 2"), answers):  # a replay, and a second round that repeats the first
        stored = sinks.store_versions(part.drop("i"), path, ["store_id"], "request_hash")
    return stored.select("store_id", "scenario", "request_hash", "version", rnd(F.col("ending_cash"), 2).alias("ending_cash"))


BEP = ["operating_bep", "financial_bep", "cash_bep"]


@query("break_even", sql(f"""
SELECT store_id, strftime(month, '%Y-%m') AS month, {r('ratio', 6)} AS variable_cost_ratio, {r('margin', 6)} AS margin_ratio,
  CASE WHEN margin > 0 THEN {r('fixed_cost / margin', 2)} END AS operating_bep, CASE WHEN margin > 0 THEN {r('(fixed_cost + interest) / margin', 2)} END AS financial_bep,
  CASE WHEN margin > 0 THEN {r('(fixed_cost + interest + principal + tax + capex) / margin', 2)} END AS cash_bep, CASE WHEN margin > 0 THEN 'NORMAL' ELSE 'UNATTAINABLE' END AS bep_status
FROM (SELECT *, CASE WHEN revenue <= 0 THEN 0.0::DOUBLE ELSE 1 - ratio END AS margin FROM (
  SELECT *, CASE WHEN revenue <= 0 THEN 1.0::DOUBLE ELSE variable_cost / revenue END AS ratio FROM base_ledger))""", "base_ledger"))
def break_even(spark, sf):
    out = lg.break_even(base_ledger(spark, sf))
    return out.select("store_id", month_name(F.col("month")).alias("month"), rnd(F.col("variable_cost_ratio"), 6).alias("variable_cost_ratio"),
                      rnd(F.col("margin_ratio"), 6).alias("margin_ratio"), *[rnd(F.col(c), 2).alias(c) for c in BEP], "bep_status")


def burn_sql(ledger_name: str, keys: str) -> str:
    return f"""
SELECT {keys}, CASE WHEN b IS NULL THEN 'NO_BURN_WITHIN_HORIZON' ELSE 'BURN_WITHIN_HORIZON' END AS horizon_status, b.month_index AS burn_month_index,
  CASE WHEN b IS NOT NULL THEN CASE WHEN b.beginning_cash <= 0 THEN 1.0::DOUBLE WHEN abs(b.net) > 0 THEN dim * b.beginning_cash / abs(b.net) ELSE dim::DOUBLE END END AS days_to_burn,
  CASE WHEN b IS NOT NULL THEN b.month + CAST(CASE WHEN b.beginning_cash <= 0 THEN 0 WHEN abs(b.net) > 0 THEN greatest(1, least(dim, floor(dim * b.beginning_cash / abs(b.net)))) - 1 ELSE dim - 1 END AS INTEGER) END AS burn_date,
  liquidity AS liquidity_risk_date
FROM (SELECT *, day(last_day(b.month)) AS dim FROM (
  SELECT {keys}, min_by({{'month': month, 'month_index': month_index, 'beginning_cash': beginning_cash, 'net': net}}, month_index) FILTER (ending_cash <= 0) AS b,
    min(month) FILTER (ending_cash <= min_cash) AS liquidity FROM {ledger_name} GROUP BY {keys}))"""


cte("burn", burn_sql("base_ledger", "store_id"), "base_ledger")


@query("cash_burn", sql(f"""
SELECT b.store_id, horizon_status, burn_month_index, {r('days_to_burn', 4)} AS days_to_burn, strftime(burn_date, '%Y-%m-%d') AS burn_date,
  strftime(liquidity_risk_date, '%Y-%m-%d') AS liquidity_risk_date, {r('e.cash_bep', 2)} AS first_month_cash_bep
FROM burn b LEFT JOIN (SELECT store_id, CASE WHEN 1 - variable_cost / revenue > 0 THEN (fixed_cost + interest + principal + tax + capex) / (1 - variable_cost / revenue) END AS cash_bep
  FROM base_ledger WHERE month_index = 1) e USING (store_id)""", "burn", "base_ledger"))
def cash_burn(spark, sf):
    out = lg.break_even(base_ledger(spark, sf))
    burn = lg.cash_burn(out, ["store_id"], F.col("min_cash"))
    first = out.groupBy("store_id").agg(F.min_by("cash_bep", "month_index").alias("bep"))
    return burn.join(first, "store_id").select(
        "store_id", "horizon_status", "burn_month_index", rnd(F.col("days_to_burn"), 4).alias("days_to_burn"), day_name(F.col("burn_date")).alias("burn_date"),
        day_name(F.col("liquidity_risk_date")).alias("liquidity_risk_date"), rnd(F.col("bep"), 2).alias("first_month_cash_bep"))


@query("funding_gap", sql(f"""
SELECT g.store_id, {r('min_ending_cash', 2)} AS min_ending_cash, {r('greatest(0.0::DOUBLE, min_cash - min_ending_cash)', 2)} AS required_funding,
  CASE WHEN l.store_id IS NULL THEN 'WORKING_CAPITAL' ELSE 'WORKING_CAPITAL,INTEREST_REDUCTION' END AS purposes
FROM (SELECT store_id, min(ending_cash) AS min_ending_cash, max(min_cash) AS min_cash FROM base_ledger GROUP BY store_id) g
LEFT JOIN (SELECT DISTINCT store_id FROM loans) l USING (store_id)""", "base_ledger", "loans"))
def funding_gap(spark, sf):
    gap = lg.funding_gap(base_ledger(spark, sf), ["store_id"])
    borrowers = b.loans(spark, sf).select("store_id", F.lit(True).alias("borrows")).distinct()
    return gap.join(borrowers, "store_id", "left").select(
        "store_id", rnd(F.col("min_ending_cash"), 2).alias("min_ending_cash"), rnd(F.col("required_funding"), 2).alias("required_funding"),
        F.when(F.col("borrows"), "WORKING_CAPITAL,INTEREST_REDUCTION").otherwise("WORKING_CAPITAL").alias("purposes"))


@query("fixed_cost_override", sql("""
SELECT m.store_id, strftime(m.month, '%Y-%m') AS month, c.category, coalesce(o.amount, c.amount) AS amount
FROM (SELECT DISTINCT store_id, month FROM overrides) m JOIN (UNPIVOT (SELECT store_id, rent, labor, utilities, other FROM last_month) ON rent, labor, utilities, other INTO NAME category VALUE amount) c USING (store_id)
LEFT JOIN override_last o ON o.store_id = m.store_id AND o.month = m.month AND o.category = c.category""", "overrides", "last_month", "override_last"))
def fixed_cost_override(spark, sf):
    over = b.overrides(spark, sf)
    last = lg.last_ledger_month(b.history(spark, sf))
    parts = last.select("store_id", F.explode(F.create_map(*[x for c in ("rent", "labor", "utilities", "other") for x in (F.lit(c), F.col(c))])).alias("category", "amount"))
    fixed = over.select("store_id", "month").distinct().join(parts, "store_id")
    return lg.apply_fixed_overrides(fixed, over).select("store_id", month_name(F.col("month")).alias("month"), "category", "amount")


# ---- version-1 flat run --------------------------------------------------------------------

cte("flat_runs", f"SELECT l.*, a.rate_base AS rate_delta FROM loans l, (SELECT DISTINCT rate_base FROM {values(FLAT_SCENARIOS)}) a", "loans")
cte("flat_sched", b.schedule_sql("flat_runs", "flat_sched", "rate_delta", dated=False, extra=("rate_delta",)), "flat_runs")


@query("flat_scenario", sql(f"""
SELECT store_id, scenario, strftime(month, '%Y-%m') AS month, {', '.join(r(c, 2) + ' AS ' + c for c in MONEY[:-1])},
  {r('current_cash + sum(net) OVER (PARTITION BY store_id, scenario ORDER BY month_index)', 2)} AS ending_cash
FROM (SELECT *, revenue - variable_cost - fixed_cost - interest - principal - tax - capex AS net FROM (
  SELECT s.store_id, a.scenario, h.h AS month_index, CAST(l.month + to_months(CAST(h.h AS INTEGER)) AS DATE) AS month, l.revenue * a.revenue_multiplier AS revenue,
    (l.ingredients + l.platform_fee + l.payment_fee) * a.variable_cost_multiplier AS variable_cost, (l.rent + l.labor + l.utilities + l.other) * a.fixed_cost_multiplier AS fixed_cost,
    coalesce(d.interest, 0.0::DOUBLE) AS interest, coalesce(d.principal, 0.0::DOUBLE) AS principal, l.tax, l.capex, s.current_cash
  FROM stores s JOIN last_month l USING (store_id) CROSS JOIN range(1, 7) h(h) CROSS JOIN {values(FLAT_SCENARIOS)}
  LEFT JOIN (SELECT store_id, rate_delta, m, sum(interest) AS interest, sum(paid) AS principal FROM flat_sched WHERE m > 0 GROUP BY 1, 2, 3) d
    ON d.store_id = s.store_id AND d.rate_delta = a.rate_base AND d.m = h.h))""", "stores", "last_month", "flat_sched"))
def flat_scenario(spark, sf):
    return shown(lg.flat_scenario(b.stores(spark, sf), b.history(spark, sf), FLAT_SCENARIOS, b.loans(spark, sf), b.HORIZON))


# ---- layers --------------------------------------------------------------------------------

PAIRS = [("TREND", "OFFICIAL"), ("OFFICIAL", "LOW_IMPACT"), ("OFFICIAL", "HIGH_IMPACT")]
EFFECTS = ["revenue", "ingredient_cost", "other_variable_cost", "fixed_cost", "interest", "principal", "tax", "capex", "ending_cash"]
cte("layer_delta", f"""
SELECT a.store_id, a.month, p.f AS from_layer, p.t AS to_layer, {', '.join(f"(c.{e} - a.{e}) * {1 if e in ('revenue', 'ending_cash') else -1} AS {e}_effect" for e in EFFECTS)}
FROM (VALUES {', '.join(f"('{x}', '{y}')" for x, y in PAIRS)}) p(f, t) JOIN layers a ON a.layer = p.f JOIN layers c ON c.layer = p.t AND c.store_id = a.store_id AND c.month = a.month""", "layers")
cte("attributed", " UNION ALL ".join(
    f"SELECT store_id, from_layer, to_layer, '{e.upper()}' AS component, sum({e}_effect) AS effect FROM layer_delta GROUP BY 1, 2, 3" for e in EFFECTS[:-1])
    + " UNION ALL SELECT DISTINCT store_id, from_layer, to_layer, 'OTHER_INFLOW', 0.0::DOUBLE FROM layer_delta", "layer_delta")


@query("layer_delta", sql(f"""
SELECT store_id, strftime(month, '%Y-%m') AS month, from_layer, to_layer, {', '.join(f"{r(e + '_effect', 2)} AS {e}_effect" for e in EFFECTS)} FROM layer_delta""", "layer_delta"))
def layer_delta(spark, sf):
    out = lg.layer_delta(layers(spark, sf), PAIRS)
    return out.select("store_id", month_name(F.col("month")).alias("month"), "from_layer", "to_layer", *[rnd(F.col(e + "_effect"), 2).alias(e + "_effect") for e in EFFECTS])


@query("attribution", sql(f"SELECT store_id, from_layer, to_layer, component, {r('effect', 2)} AS effect FROM attributed", "attributed"))
def attribution(spark, sf):
    out = lg.attribution(lg.layer_delta(layers(spark, sf), PAIRS))
    return out.withColumn("effect", rnd(F.col("effect"), 2))


@query("primary_driver", sql(f"""
SELECT store_id, from_layer, to_layer, component, {r('effect', 2)} AS effect FROM (
  SELECT *, row_number() OVER (PARTITION BY store_id, from_layer, to_layer ORDER BY abs(effect) DESC, component) AS rn FROM attributed WHERE abs(effect) > 1e-6::DOUBLE) WHERE rn = 1""", "attributed"))
def primary_driver(spark, sf):
    out = lg.primary_driver(lg.attribution(lg.layer_delta(layers(spark, sf), PAIRS)))
    return out.withColumn("effect", rnd(F.col("effect"), 2))


@query("summary_facts", sql("""
SELECT store_id, 'First forecast month ' || strftime(min(month), '%Y-%m') || ' revenue ' || CAST(CAST(floor(min_by(revenue, month_index) + 0.5::DOUBLE) AS BIGINT) AS VARCHAR)
  || '; last month ' || strftime(max(month), '%Y-%m') || ' ends with ' || CAST(CAST(floor(max_by(ending_cash, month_index) + 0.5::DOUBLE) AS BIGINT) AS VARCHAR) AS statement
FROM base_ledger GROUP BY store_id""", "base_ledger"))
def summary_facts(spark, sf):
    from tillwise.operators.results import summary_statements

    return summary_statements(base_ledger(spark, sf), ["store_id"])
