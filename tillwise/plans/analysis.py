"""The whole analysis as one job: every store, every month, every scenario, every policy."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tillwise.functions.core import month_scaffold
from tillwise.functions.stages import one_plan, staged
from tillwise.operators import events as ev
from tillwise.operators import forecast as fc
from tillwise.operators import ledger as lg
from tillwise.operators import official as of
from tillwise.operators import policies as po
from tillwise.operators import signals as sg
from tillwise.operators import smoothing

LAYERS = [("TREND", "OFFICIAL"), ("OFFICIAL", "LOW_IMPACT"), ("OFFICIAL", "HIGH_IMPACT")]


def run_analysis(run_id: str, tables: dict[str, DataFrame], as_of: Column, forecast_start: Column, forecast_end: Column, horizon: int) -> dict[str, DataFrame]:
    """tables: stores, history, loans, observations, events, found_events, policies, found_policies,
    and optionally decisions (bridging events) and fixed_cost_overrides. Returns one DataFrame per
    result table. Stages that several results read are written once in each call; a later call with the
    same run id reads its own tables."""
    with one_plan():
        return _analyse(run_id, tables, as_of, forecast_start, forecast_end, horizon)


def _analyse(run_id: str, tables: dict[str, DataFrame], as_of: Column, forecast_start: Column, forecast_end: Column, horizon: int) -> dict[str, DataFrame]:
    stores, history, loans = tables["stores"], tables["history"], tables["loans"]
    spark = stores.sparkSession
    keep = lambda name, build: staged(spark, f"{run_id}:{name}", build)
    known = of.mark_stale(of.accepted_as_of(tables["observations"], as_of), as_of)
    if "decisions" in tables:
        bridged = of.bridge_events(tables["decisions"], known, as_of)
        known = of.apply_bridge(known, bridged)
    projected = of.project_indicators(known, forecast_start, horizon)
    features = keep("features", lambda: of.monthly_features(projected))
    fits = keep("smoothing", lambda: smoothing.fit_damped(history, horizon))
    contest = {"extra_metrics": smoothing.ets_metrics(fits), "extra_points": smoothing.ets_points(fits)}
    trend = keep("trend", lambda: fc.baseline_forecast(stores, history, forecast_start, horizon, **contest))
    official = keep("official", lambda: fc.baseline_forecast(stores, history, forecast_start, horizon, features, **contest))

    live = tables["events"].filter(ev.overlaps(F.col("start_date"), F.col("end_date"), forecast_start, forecast_end))
    debt = lg.has_variable_debt(stores, loans.select("store_id", "rate_type"))
    homes = stores.join(debt, "store_id").withColumnsRenamed({"lat": "store_lat", "lon": "store_lon"})
    signals = keep("signals", lambda: sg.dedupe_causes(sg.store_signals(live, homes, tables["found_events"], forecast_start, horizon)))
    months = month_scaffold(stores.select("store_id"), forecast_start, F.lit(horizon)).drop("month_index")
    adjustments = keep("adjustments", lambda: sg.scenario_adjustments(signals, months))

    keys, over = ["store_id", "scenario"], tables.get("fixed_cost_overrides")
    run = lambda points, adj, feats: lg.monthly_scenario(stores, history, points, adj, loans, horizon, forecast_start, keys, feats, over)
    neutral = adjustments.filter(F.col("scenario") == "BASELINE")
    layer = F.when(F.col("scenario") == "BASELINE", "OFFICIAL").otherwise(F.col("scenario"))
    ledger = keep("ledger", lambda: run(trend, neutral, None).withColumn("scenario", F.lit("TREND")).unionByName(
        run(official, adjustments, features).withColumn("scenario", layer), allowMissingColumns=True))
    base = ledger.filter(F.col("scenario") == "OFFICIAL")
    gaps = lg.funding_gap(base, ["store_id"])

    judged = po.policy_status(tables["policies"], as_of)
    declared = ["business_type_code", "region_code", "annual_revenue", "employee_count", "declared_revenue", "business_start_date", "owner_age", "credit_band"]
    pairs = po.meet(tables["found_policies"], stores.select("store_id", *[c for c in declared if c in stores.columns]), judged)
    eligibility = keep("eligibility", lambda: po.eligibility(pairs, as_of).drop("conditions", "rules", "regions", "region_ids", "include", "exclude"))
    benefits = keep("benefits", lambda: po.policy_benefit(
        eligibility.filter(F.col("status") == "ELIGIBLE_ON_DECLARED_RULES"), base, loans, gaps, horizon, forecast_start))
    delta = lg.layer_delta(ledger, LAYERS)
    return {
        "features": features, "indicator_contributions": of.contributions(projected), "trend_forecasts": trend, "official_forecasts": official,
        "signals": signals, "adjustments": adjustments, "ledger": ledger, "break_even": lg.break_even(ledger),
        "cash_burn": lg.cash_burn(ledger, keys, F.col("min_cash")), "layer_delta": delta, "attribution": lg.attribution(delta),
        "alignment": lg.alignment_issues(adjustments, stores, keys, horizon, forecast_start), "funding_gap": gaps, "eligibility": eligibility, "benefits": benefits, "ranked_policies": po.rank_policies(benefits, judged),
        "stage_counts": po.stage_counts(judged, eligibility)}
