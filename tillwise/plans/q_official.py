"""Official-data queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from tillwise.functions.core import day_name, month_name, rnd
from tillwise.functions.stages import staged
from tillwise.operators import events as ev
from tillwise.operators import official as of
from tillwise.plans import bindings as b
from tillwise.plans.catalog import cte, query, r, sql
from tillwise.sources import landed, ledger_csv, sinks

DAY = lambda c: f"strftime({c}, '%Y-%m-%d')"

cte("gated", """
SELECT *, CASE WHEN released_at IS NULL THEN 'MISSING_RELEASE_METADATA'
  WHEN observed_at > DATE '2001-08-31' OR released_at > DATE '2001-08-31' OR coalesce(available_at, released_at) > DATE '2001-08-31'
  THEN 'NOT_AVAILABLE_AS_OF_ANALYSIS_DATE' ELSE 'ACCEPTED' END AS gate FROM obs""", "obs")
cte("known", "SELECT * EXCLUDE (gate) FROM gated WHERE gate = 'ACCEPTED'", "gated")


def known(spark, sf):
    return of.accepted_as_of(b.observations(spark, sf), b.as_of())


@query("as_of_gate", sql("SELECT observation_id, indicator_id, strftime(observed_at, '%Y-%m-%d') AS observed_at, gate FROM gated", "gated"))
def as_of_gate(spark, sf):
    return of.gate_as_of(b.observations(spark, sf), b.as_of()).select(
        "observation_id", "indicator_id", day_name(F.col("observed_at")).alias("observed_at"), "gate")


cte("fresh", """
SELECT indicator_id, max(observed_at) AS latest_observed_at, datediff('day', max(observed_at), DATE '2001-08-31') AS age_days,
  CASE WHEN indicator_id IN ('BASE_RATE', 'USD_KRW') THEN 90 ELSE 120 END AS max_age_days FROM known GROUP BY indicator_id""", "known")


@query("freshness", sql("""
SELECT indicator_id, strftime(latest_observed_at, '%Y-%m-%d') AS latest_observed_at, age_days,
  max_age_days, age_days > max_age_days AS is_stale FROM fresh""", "fresh"))
def freshness(spark, sf):
    return of.freshness(known(spark, sf), b.as_of()).withColumn("latest_observed_at", day_name(F.col("latest_observed_at")))


cte("latest_two", """
SELECT indicator_id, max(CASE WHEN rn = 1 THEN observation_id END) AS latest_id, max(CASE WHEN rn = 2 THEN observation_id END) AS previous_id,
  max(CASE WHEN rn = 1 THEN value END) AS latest_value, max(CASE WHEN rn = 2 THEN value END) AS previous_value,
  max(CASE WHEN rn = 1 THEN unit END) AS unit, max(CASE WHEN rn = 1 THEN observed_at END) AS latest_observed_at, max(n) AS n
FROM (SELECT *, row_number() OVER (PARTITION BY indicator_id ORDER BY observed_at DESC, available_at DESC, observation_id DESC) AS rn,
  count(*) OVER (PARTITION BY indicator_id) AS n FROM known) GROUP BY indicator_id""", "known")


@query("indicator_summary", sql(f"""
SELECT t.indicator_id, n AS observation_count, latest_id AS latest_observation_id, previous_id AS previous_observation_id,
  {r('latest_value', 6)} AS latest_value, {r('previous_value', 6)} AS previous_value, {r('latest_value - previous_value', 6)} AS absolute_change,
  {r('(latest_value - previous_value) / abs(previous_value)', 6)} AS percentage_change, f.age_days,
  CASE WHEN f.age_days > f.max_age_days THEN 'STALE' ELSE 'VALID' END AS freshness_status
FROM latest_two t JOIN fresh f USING (indicator_id)""", "latest_two", "fresh"))
def indicator_summary(spark, sf):
    out = of.indicator_summary(known(spark, sf), b.as_of()).drop("latest_observed_at")
    for c in ("latest_value", "previous_value", "absolute_change", "percentage_change"):
        out = out.withColumn(c, rnd(F.col(c), 6))
    return out


@query("asof_latest", sql(f"""
SELECT indicator_id, latest_id AS observation_id, {r('latest_value', 6)} AS value, strftime(latest_observed_at, '%Y-%m-%d') AS observed_at
FROM latest_two""", "latest_two"))
def asof_latest(spark, sf):
    return of.latest_as_of(b.observations(spark, sf), b.as_of()).select(
        "indicator_id", "observation_id", rnd(F.col("value"), 6).alias("value"), day_name(F.col("observed_at")).alias("observed_at"))


METHOD = {"DAILY_CLICK": "AVERAGE", "DAILY_VIEW": "VOLATILITY", "DAILY_ERROR": "AVERAGE"}


@query("daily_to_monthly", sql(f"""
SELECT indicator_id, strftime(observed_at, '%Y-%m') AS month, frequency, {r('value', 6)} AS value FROM (
  SELECT indicator_id, observed_at, frequency, value FROM obs_monthly
  UNION ALL
  SELECT indicator_id, CAST(date_trunc('month', observed_at) AS DATE), 'MONTHLY', CASE indicator_id WHEN 'DAILY_CLICK' THEN avg(value) WHEN 'DAILY_ERROR' THEN avg(value)
    WHEN 'DAILY_VIEW' THEN stddev_pop(value) ELSE max_by(value, observed_at) END
  FROM obs_daily GROUP BY 1, 2, 3)""", "obs_monthly", "obs_daily"))
def daily_to_monthly(spark, sf):
    method = F.coalesce(*[F.when(F.col("indicator_id") == k, F.lit(v)) for k, v in METHOD.items()], F.lit("LAST"))
    return of.to_monthly(b.observations(spark, sf), method).select(
        "indicator_id", month_name(F.col("observed_at")).alias("month"), "frequency", rnd(F.col("value"), 6).alias("value"))


@query("union_observations", sql(f"""
SELECT indicator_id, {DAY('observed_at')} AS observed_at, observation_id, frequency FROM obs""", "obs"))
def union_observations(spark, sf):
    return b.monthly_observations(spark, sf).unionByName(b.daily_observations(spark, sf)).select(
        "indicator_id", day_name(F.col("observed_at")).alias("observed_at"), "observation_id", "frequency")


# requests: one run per calendar month, asking for every series and two that nobody delivers
cte("requests", """
SELECT strftime(m.month, '%Y-%m') AS run_id, i.indicator_id, i.indicator_id IN ('BASE_RATE', 'GHOST_REQUIRED') AS required
FROM (SELECT DISTINCT observed_at AS month FROM obs_monthly) m,
  (SELECT DISTINCT indicator_id FROM obs_monthly UNION ALL VALUES ('GHOST_REQUIRED'), ('GHOST_OPTIONAL')) i""", "obs_monthly")


def requests(spark, sf):
    """Every month's run asks for the six series and two that nobody delivers."""
    months = b.monthly_observations(spark, sf).select("observed_at").distinct()
    names = [v[0] for v in b.SERIES.values()] + ["GHOST_REQUIRED", "GHOST_OPTIONAL"]
    out = months.select(month_name(F.col("observed_at")).alias("run_id"), F.explode(F.array(*[F.lit(n) for n in names])).alias("indicator_id"))
    return out.withColumn("required", F.col("indicator_id").isin("BASE_RATE", "GHOST_REQUIRED"))


@query("missing_indicators", sql("""
SELECT run_id, indicator_id, required FROM requests q WHERE NOT EXISTS (SELECT 1 FROM known k WHERE k.indicator_id = q.indicator_id)""",
                                 "requests", "known"))
def missing_indicators(spark, sf):
    return of.missing_indicators(requests(spark, sf), known(spark, sf)).select("run_id", "indicator_id", "required")


@query("bundle_status", sql("""
SELECT q.run_id, count(k.indicator_id) AS delivered,
  CASE WHEN bool_or(q.required AND k.indicator_id IS NULL) AND count(k.indicator_id) = 0 THEN 'FAILED'
    WHEN bool_or(k.indicator_id IS NULL) OR coalesce(max(e.n), 0) > 0 THEN 'PARTIAL' ELSE 'COMPLETED' END AS status
FROM requests q LEFT JOIN (SELECT DISTINCT strftime(observed_at, '%Y-%m') AS run_id, indicator_id FROM known) k USING (run_id, indicator_id)
LEFT JOIN (SELECT strftime(observed_at, '%Y-%m') AS run_id, count(*) AS n FROM gated WHERE gate <> 'ACCEPTED' AND frequency = 'MONTHLY' GROUP BY 1) e USING (run_id)
WHERE NOT (q.indicator_id LIKE 'GHOST%' AND CAST(substr(q.run_id, 6, 2) AS INTEGER) % 2 = 0)
GROUP BY q.run_id""", "requests", "known", "gated"))
def bundle_status(spark, sf):
    obs = of.gate_as_of(b.observations(spark, sf), b.as_of()).withColumn("run_id", month_name(F.col("observed_at")))
    asked = requests(spark, sf).filter(~(F.col("indicator_id").startswith("GHOST") & (F.substring("run_id", 6, 2).cast("int") % 2 == 0)))
    errors = obs.filter((F.col("gate") != "ACCEPTED") & (F.col("frequency") == "MONTHLY"))
    runs = asked.select("run_id").distinct()
    out = of.bundle_status(asked, obs.filter(F.col("gate") == "ACCEPTED"), errors.select("run_id", F.col("gate").alias("code")))
    return out.join(runs, "run_id", "left_semi")


# every request is a call; some fail in each of the known ways, and what they asked for is not delivered
cte("calls", """
SELECT *, CASE n WHEN 0 THEN 401 WHEN 1 THEN 429 WHEN 2 THEN 503 ELSE 200 END AS http_status, CASE n WHEN 3 THEN 'timeout' WHEN 4 THEN 'malformed' WHEN 5 THEN 'error' ELSE 'ok' END AS outcome,
  CASE n WHEN 0 THEN 'AUTHENTICATION_FAILED' WHEN 1 THEN 'RATE_LIMITED' WHEN 2 THEN 'HTTP_503' WHEN 3 THEN 'TIMEOUT' WHEN 4 THEN 'MALFORMED_RESPONSE' WHEN 5 THEN 'PROVIDER_FAILURE' END AS code
FROM (SELECT *, (CAST(substr(run_id, 6, 2) AS INTEGER) * 7 + length(indicator_id)) % 19 AS n FROM requests)""", "requests")


def calls(spark, sf):
    n = (F.substring("run_id", 6, 2).cast("int") * 7 + F.length("indicator_id")) % 19
    return requests(spark, sf).withColumns({
        "http_status": F.when(n == 0, 401).when(n == 1, 429).when(n == 2, 503).otherwise(200), "outcome": F.when(n == 3, "timeout").when(n == 4, "malformed").when(n == 5, "error").otherwise("ok")})


@query("provider_failures", sql("SELECT run_id, indicator_id, code FROM calls WHERE code IS NOT NULL", "calls"))
def provider_failures(spark, sf):
    return landed.provider_errors(calls(spark, sf))


@query("bundle_status_of_calls", sql("""
SELECT q.run_id, count(k.indicator_id) AS delivered, CASE WHEN bool_or(q.required AND k.indicator_id IS NULL) AND count(k.indicator_id) = 0 THEN 'FAILED' WHEN bool_or(k.indicator_id IS NULL) OR count(q.code) > 0 THEN 'PARTIAL' ELSE 'COMPLETED' END AS status
FROM calls q LEFT JOIN (SELECT DISTINCT strftime(observed_at, '%Y-%m') AS run_id, indicator_id FROM known) k ON k.run_id = q.run_id AND k.indicator_id = q.indicator_id AND q.code IS NULL GROUP BY q.run_id""", "calls", "known"))
def bundle_status_of_calls(spark, sf):
    asked = calls(spark, sf)
    failed = landed.provider_errors(asked)
    obs = of.accepted_as_of(b.observations(spark, sf), b.as_of()).select(month_name(F.col("observed_at")).alias("run_id"), "indicator_id").distinct()
    obs = obs.join(failed.select("run_id", "indicator_id"), ["run_id", "indicator_id"], "left_anti")
    out = of.bundle_status(asked, obs, failed.select("run_id", "code"))
    return out.join(asked.select("run_id").distinct(), "run_id", "left_semi")


cte("projection", """
SELECT t.*, h.h AS month_index, CAST(DATE '2001-09-01' + to_months(CAST(h.h - 1 AS INTEGER)) AS DATE) AS month,
  coalesce(latest_value - previous_value, 0.0::DOUBLE) AS delta,
  coalesce(CASE WHEN previous_value <> 0 THEN (latest_value - previous_value) / abs(previous_value) END, 0.0::DOUBLE) AS relative_change,
  greatest(-0.05::DOUBLE, least(0.05::DOUBLE, relative_change)) AS capped_change, (1 - pow(0.65::DOUBLE, h.h)) / (1 - 0.65::DOUBLE) AS decay,
  CASE indicator_id WHEN 'USD_KRW' THEN 'IMPORTED_INGREDIENT_COST' WHEN 'IMPORT_PRICE_INDEX_USD' THEN 'IMPORTED_INGREDIENT_COST'
    WHEN 'CONSUMER_PRICE_INDEX' THEN 'DOMESTIC_INGREDIENT_COST' WHEN 'BASE_RATE' THEN 'INTEREST_RATE' ELSE 'REVENUE_DEMAND' END AS feature_role,
  CASE feature_role WHEN 'REVENUE_DEMAND' THEN 0.10::DOUBLE WHEN 'DOMESTIC_INGREDIENT_COST' THEN 0.08::DOUBLE WHEN 'IMPORTED_INGREDIENT_COST' THEN 0.12::DOUBLE
    WHEN 'INTEREST_RATE' THEN 0.02::DOUBLE ELSE 0.05::DOUBLE END AS cap,
  greatest(-cap, least(cap, capped_change * decay)) AS cumulative_change,
  CASE WHEN feature_role = 'INTEREST_RATE' AND previous_value IS NOT NULL THEN greatest(-0.02::DOUBLE, least(0.02::DOUBLE, delta * decay * 0.01::DOUBLE)) END AS interest_delta,
  greatest(0.0::DOUBLE, CASE WHEN feature_role = 'INTEREST_RATE' AND previous_value IS NOT NULL THEN latest_value + delta * decay ELSE latest_value * (1 + cumulative_change) END) AS projected_value
FROM latest_two t CROSS JOIN range(1, 7) h(h)""", "latest_two")
cte("features", """
SELECT month_index, month,
  greatest(0.90::DOUBLE, least(1.10::DOUBLE, 1 + coalesce(avg(cumulative_change) FILTER (feature_role = 'REVENUE_DEMAND'), 0.0::DOUBLE))) AS revenue_index_multiplier,
  greatest(0.85::DOUBLE, least(1.15::DOUBLE, 1 + coalesce(avg(cumulative_change) FILTER (feature_role IN ('DOMESTIC_INGREDIENT_COST', 'IMPORTED_INGREDIENT_COST')), 0.0::DOUBLE))) AS ingredient_multiplier,
  greatest(0.92::DOUBLE, least(1.08::DOUBLE, 1 + coalesce(avg(cumulative_change) FILTER (feature_role = 'DOMESTIC_INGREDIENT_COST'), 0.0::DOUBLE))) AS domestic_multiplier,
  greatest(0.88::DOUBLE, least(1.12::DOUBLE, 1 + coalesce(avg(cumulative_change) FILTER (feature_role = 'IMPORTED_INGREDIENT_COST'), 0.0::DOUBLE))) AS imported_multiplier,
  coalesce(avg(interest_delta), 0.0::DOUBLE) AS interest_rate_delta, count(*) AS indicator_count
FROM projection GROUP BY month_index, month""", "projection")


def projected(spark, sf):
    return of.project_indicators(known(spark, sf), b.start(), b.HORIZON)


def features(spark, sf):
    """Monthly features, written once: every forecast and ledger of a run reads the same ones."""
    return staged(spark, "features:" + sf, lambda: of.monthly_features(projected(spark, sf)))


@query("indicator_projection", sql(f"""
SELECT indicator_id, feature_role, strftime(month, '%Y-%m') AS month, latest_id AS latest_observation_id, {r('relative_change', 6)} AS relative_change,
  {r('cumulative_change', 6)} AS cumulative_change, {r('interest_delta', 8)} AS interest_delta, {r('projected_value', 5)} AS projected_value,
  {r("CASE feature_role WHEN 'INTEREST_RATE' THEN coalesce(interest_delta, 0.0::DOUBLE) WHEN 'UNMAPPED' THEN 0.0::DOUBLE ELSE cumulative_change END / count(*) OVER (PARTITION BY feature_role, month_index)", 8)} AS contribution
FROM projection""", "projection"))
def indicator_projection(spark, sf):
    out = of.contributions(projected(spark, sf))
    return out.select(
        "indicator_id", "feature_role", month_name(F.col("month")).alias("month"), "latest_observation_id",
        rnd(F.col("relative_change"), 6).alias("relative_change"), rnd(F.col("cumulative_change"), 6).alias("cumulative_change"),
        rnd(F.col("interest_delta"), 8).alias("interest_delta"), rnd(F.col("projected_value"), 5).alias("projected_value"),
        rnd(F.col("contribution"), 8).alias("contribution"))


FEATURE_COLUMNS = ["revenue_index_multiplier", "ingredient_multiplier", "domestic_multiplier", "imported_multiplier", "interest_rate_delta"]


@query("official_features", sql(f"""
SELECT strftime(month, '%Y-%m') AS month, indicator_count, {', '.join(r(c, 8) + ' AS ' + c for c in FEATURE_COLUMNS)} FROM features""", "features"))
def official_features(spark, sf):
    out = of.monthly_features(projected(spark, sf))
    return out.select(month_name(F.col("month")).alias("month"), "indicator_count", *[rnd(F.col(c), 8).alias(c) for c in FEATURE_COLUMNS])


# ---- rate decisions against the official series --------------------------------------------

cte("decisions", """
SELECT o_orderkey AS event_id, CASE o_orderkey % 3 WHEN 0 THEN 'BASE_RATE_INCREASE' WHEN 1 THEN 'BASE_RATE_DECREASE' ELSE 'BASE_RATE_HOLD' END AS event_type,
  CAST(o_orderdate AS DATE) + CAST(CASE WHEN o_orderkey % 7 = 0 THEN 120 ELSE 0 END AS INTEGER) AS start_date,
  CASE WHEN o_orderpriority IN ('1-URGENT', '2-HIGH') THEN 'OFFICIAL_PRIMARY' ELSE 'MAJOR_NEWS' END AS source_tier,
  CASE WHEN o_custkey % 10 = 0 THEN 'Federal Reserve' ELSE 'ORG-BOK' END AS actor,
  CASE WHEN o_orderkey % 13 = 0 THEN 'USD_KRW' ELSE 'BASE_RATE' END AS declared_indicator,
  CASE WHEN o_orderkey % 17 <> 0 THEN 1.0::DOUBLE + (o_orderkey % 16) * 0.25::DOUBLE END AS value,
  CASE WHEN o_orderkey % 19 = 0 THEN 'INDEX' ELSE 'PERCENT' END AS unit, o_orderkey % 23 <> 0 AS evidenced
FROM orders""")


def decisions(spark, sf):
    k = F.col("o_orderkey")
    return b.table(spark, sf, "orders").select(
        k.alias("event_id"),
        F.when(k % 3 == 0, "BASE_RATE_INCREASE").when(k % 3 == 1, "BASE_RATE_DECREASE").otherwise("BASE_RATE_HOLD").alias("event_type"),
        F.date_add(F.to_date("o_orderdate"), F.when(k % 7 == 0, 120).otherwise(0)).alias("start_date"),
        F.when(F.col("o_orderpriority").isin("1-URGENT", "2-HIGH"), "OFFICIAL_PRIMARY").otherwise("MAJOR_NEWS").alias("source_tier"),
        F.when(F.col("o_custkey") % 10 == 0, "Federal Reserve").otherwise("ORG-BOK").alias("actor"),
        F.when(k % 13 == 0, "USD_KRW").otherwise("BASE_RATE").alias("declared_indicator"),
        F.when(k % 17 != 0, 1.0 + (k % 16) * 0.25).alias("value"),
        F.when(k % 19 == 0, "INDEX").otherwise("PERCENT").alias("unit"), (k % 23 != 0).alias("evidenced"))


# the applied decisions are exactly the first unblocked decision of each day after the series ends
cte("bridge_base", """
SELECT d.*, s.observed_at AS s_at, s.value AS s_value,
  CASE WHEN source_tier <> 'OFFICIAL_PRIMARY' THEN 'SOURCE_NOT_OFFICIAL_PRIMARY' WHEN actor = 'Federal Reserve' THEN 'ACTOR_NOT_AUTHORIZED_FOR_BASE_RATE'
    WHEN declared_indicator <> 'BASE_RATE' THEN 'INDICATOR_MISMATCH' WHEN d.value IS NULL OR NOT evidenced THEN 'VALUE_OR_UNIT_NOT_EXPLICITLY_EVIDENCED'
    WHEN d.unit <> s.unit THEN 'UNIT_MISMATCH' END AS blocked
FROM (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY actor, declared_indicator, start_date, event_type, value, unit ORDER BY event_id) AS rn FROM decisions) WHERE rn = 1) d,
  (SELECT indicator_id, latest_observed_at AS observed_at, latest_value AS value, unit FROM latest_two WHERE indicator_id = 'BASE_RATE') s""",
    "decisions", "latest_two")
cte("bridge_applied", """
SELECT start_date, min(event_id) AS event_id, min_by(value, event_id) AS value FROM bridge_base
WHERE blocked IS NULL AND start_date > s_at AND start_date <= DATE '2001-08-31' GROUP BY start_date""", "bridge_base")


@query("event_bridge", sql(f"""
SELECT event_id, strftime(start_date, '%Y-%m-%d') AS effective_date, strftime(l_at, '%Y-%m-%d') AS latest_official_observed_at, {r('l_value', 6)} AS latest_official_value,
  reason AS reason_code, CASE reason WHEN 'OFFICIAL_SERIES_CAUGHT_UP' THEN 'EXPIRED' WHEN 'NEWER_OFFICIAL_EVENT_BRIDGES_STALE_SERIES' THEN 'APPLIED' ELSE 'INELIGIBLE' END AS status
FROM (SELECT b.*, coalesce(a.start_date, b.s_at) AS l_at, coalesce(a.value, b.s_value) AS l_value,
    CASE WHEN blocked IS NOT NULL THEN blocked WHEN b.start_date <= coalesce(a.start_date, b.s_at) THEN 'OFFICIAL_SERIES_CAUGHT_UP'
      WHEN b.start_date > DATE '2001-08-31' THEN 'EVENT_NOT_EFFECTIVE_AS_OF_ANALYSIS' ELSE 'NEWER_OFFICIAL_EVENT_BRIDGES_STALE_SERIES' END AS reason
  FROM (SELECT b.*, (SELECT max(a.start_date) FROM bridge_applied a WHERE a.start_date < b.start_date OR (a.start_date = b.start_date AND a.event_id < b.event_id)) AS a_at FROM bridge_base b) b
  LEFT JOIN bridge_applied a ON a.start_date = b.a_at)""", "bridge_base", "bridge_applied"))
def event_bridge(spark, sf):
    out = of.bridge_events(decisions(spark, sf), known(spark, sf), b.as_of())
    return out.select("event_id", day_name(F.col("effective_date")).alias("effective_date"),
                      day_name(F.col("latest_official_observed_at")).alias("latest_official_observed_at"),
                      rnd(F.col("latest_official_value"), 6).alias("latest_official_value"), "reason_code", "status")


@query("quarantine_conflicts", sql(f"""
SELECT d.event_id AS claim_id, d.declared_indicator AS indicator_id, {r('d.value', 4)} AS value, {r('t.latest_value', 6)} AS official_value,
  CASE WHEN t.latest_value IS NOT NULL AND abs(d.value - t.latest_value) > 1e-9::DOUBLE THEN 'BOK_RATE_OFFICIAL_DATA_CONFLICT' ELSE 'RETAINED' END AS status
FROM decisions d LEFT JOIN latest_two t ON t.indicator_id = d.declared_indicator""", "decisions", "latest_two"))
def quarantine_conflicts(spark, sf):
    claims = decisions(spark, sf).select(F.col("event_id").alias("claim_id"), F.col("declared_indicator").alias("indicator_id"), "value")
    out = of.quarantine_conflicts(claims, known(spark, sf), b.as_of())
    return out.select("claim_id", "indicator_id", rnd(F.col("value"), 4).alias("value"), rnd(F.col("official_value"), 6).alias("official_value"), "status")


@query("value_direction_check", sql(f"""
SELECT event_id, {r('new_value', 4)} AS new_value, {r('old_value', 4)} AS previous_value, CASE WHEN event_id % 13 = 0 THEN 'OK' WHEN new_value IS NULL THEN 'OFFICIAL_NUMERIC_UNIT_INVALID'
  WHEN event_type = 'BASE_RATE_INCREASE' AND new_value <= old_value OR event_type = 'BASE_RATE_DECREASE' AND new_value >= old_value THEN 'OFFICIAL_VALUE_DIRECTION_CONTRADICTION'
  ELSE 'OK' END AS status
FROM (SELECT event_id, event_type, CASE WHEN event_id % 13 <> 0 THEN value END AS new_value, 1.0::DOUBLE + (event_id % 9) * 0.5::DOUBLE AS old_value FROM decisions)""", "decisions"))
def value_direction_check(spark, sf):
    text = lambda v: F.concat(F.format_number(v, 2), F.lit(" %"))
    rows = decisions(spark, sf).select("event_id", "event_type", F.when(F.col("event_id") % 26 == 0, "").when(F.col("event_id") % 13 != 0, F.coalesce(text(F.col("value")), F.lit("n/a"))).alias("new_raw"),
                                       text(1.0 + (F.col("event_id") % 9) * 0.5).alias("old_raw"))
    return ev.value_direction(rows).select(
        "event_id", rnd(F.col("new_value"), 4).alias("new_value"), rnd(F.col("previous_value"), 4).alias("previous_value"), "status")


# ---- landed payloads -----------------------------------------------------------------------

SERIES_CODES = {"LARGE": ("722Y001", "0101000", ""), "PROMO": ("731Y004", "0000001", "0000100"), "SMALL": ("401Y015", "*AA", "D")}


@query("obs_from_json_rows", sql(f"""
SELECT s.indicator_id, strftime(month, '%Y-%m') AS month, {r('price::DOUBLE / 100.0::DOUBLE', 2)} AS value,
  strftime(last_day(month) + CASE s.indicator_id WHEN 'IMPORT_PRICE_INDEX_USD' THEN 20 ELSE 10 END, '%Y-%m-%d') AS available_at,
  CASE s.indicator_id WHEN 'BASE_RATE' THEN 'SRC-ECOS-722Y001-0101000' WHEN 'USD_KRW' THEN 'SRC-ECOS-731Y004-0000001-0000100' ELSE 'SRC-ECOS-401Y015-ALLAA-D' END AS source_id
FROM monthly_prices JOIN series s USING (p_type) WHERE p_type IN ('LARGE', 'PROMO', 'SMALL')""", "monthly_prices", "series"))
def obs_from_json_rows(spark, sf):
    code = lambda i: F.create_map(*[F.lit(x) for k, v in SERIES_CODES.items() for x in (k, v[i])])
    row = F.struct(F.coalesce(code(0)[F.col("p_type")], F.lit("999Z999")).alias("STAT_CODE"),
                   code(1)[F.col("p_type")].alias("ITEM_CODE1"), code(2)[F.col("p_type")].alias("ITEM_CODE2"),
                   F.date_format("month", "yyyyMM").alias("TIME"), (F.col("price").cast("double") / 100.0).cast("decimal(20,2)").cast("string").alias("DATA_VALUE"))
    payload = F.to_json(F.struct(F.struct(F.array(row).alias("row")).alias("StatisticSearch")))
    out = landed.bank_observations(b.monthly_prices(spark, sf).select(payload.alias("payload")))
    return out.select("indicator_id", month_name(F.col("observed_at")).alias("month"), rnd(F.col("value"), 2).alias("value"),
                      day_name(F.col("available_at")).alias("available_at"), "source_id")


@query("obs_last_change_availability", sql(f"""
SELECT 'CONSUMER_PRICE_INDEX' AS indicator_id, strftime(month, '%Y-%m') AS month, p_type AS region, {r('price::DOUBLE / 100.0::DOUBLE', 2)} AS value,
  strftime(last_day(month) + CAST(qty % 20 AS INTEGER), '%Y-%m-%d') AS available_at
FROM monthly_prices WHERE p_type = 'MEDIUM' AND qty % 7 <> 0""", "monthly_prices"))
def obs_last_change_availability(spark, sf):
    m = b.monthly_prices(spark, sf)
    rows = m.select(
        F.lit("101").alias("ORG_ID"), F.lit("DT_1J22003").alias("TBL_ID"), F.lit("T").alias("ITM_ID"),
        F.when(F.col("p_type") == "MEDIUM", landed.NATIONAL_LABEL).otherwise(F.col("p_type")).alias("C1_NM"), F.lit("M").alias("PRD_SE"),
        F.date_format("month", "yyyyMM").alias("PRD_DE"), F.when(F.col("qty") % 7 == 0, "2015=100").otherwise("2020 = 100").alias("UNIT_NM"),
        (F.col("price").cast("double") / 100.0).cast("decimal(20,2)").cast("string").alias("DT"),
        day_name(F.date_add(F.last_day("month"), (F.col("qty") % 20).cast("int"))).alias("LST_CHN_DE"))
    out = landed.statistics_observations(rows)
    return out.select("indicator_id", month_name(F.col("observed_at")).alias("month"), F.lit("MEDIUM").alias("region"),
                      rnd(F.col("value"), 2).alias("value"), day_name(F.col("available_at")).alias("available_at"))


@query("unit_price_unpivot", sql(f"""
SELECT f.name || p_type AS indicator_id, f.unit, strftime(month, '%Y-%m') AS month, {r('f.value', 4)} AS value, strftime(last_day(month) + 25, '%Y-%m-%d') AS available_at
FROM (SELECT *, price::DOUBLE / 100.0::DOUBLE AS v, CASE WHEN qty % 5 = 0 THEN 0.0::DOUBLE ELSE qty::DOUBLE END AS w FROM monthly_prices),
LATERAL (SELECT * FROM (VALUES ('CUSTOMS_IMPORT_VALUE_USD_HS', 'USD', v), ('CUSTOMS_IMPORT_WEIGHT_KG_HS', 'KG', w),
  ('CUSTOMS_IMPORT_UNIT_PRICE_USD_PER_KG_HS', 'USD_PER_KG', CASE WHEN w > 0 THEN v / w END)) x(name, unit, value)) f
WHERE f.value IS NOT NULL""", "monthly_prices"))
def unit_price_unpivot(spark, sf):
    m = b.monthly_prices(spark, sf)
    rows = m.select(F.col("p_type").alias("hsCode"), F.date_format("month", "yyyy.MM").alias("year"),
                    F.format_number((F.col("price") / 100.0).cast("decimal(20,2)"), 2).alias("impDlr"),
                    F.when(F.col("qty") % 5 == 0, "0").otherwise(F.format_number("qty", 0)).alias("impWgt"))
    totals = rows.select(F.lit("-").alias("hsCode"), F.lit(landed.TOTAL_LABEL).alias("year"), "impDlr", "impWgt")
    out = landed.customs_observations(rows.unionByName(totals))
    return out.select("indicator_id", "unit", month_name(F.col("observed_at")).alias("month"), rnd(F.col("value"), 4).alias("value"),
                      day_name(F.col("available_at")).alias("available_at"))


@query("registry_normalize", sql("""
SELECT business_id, business_name, CASE WHEN business_name IS NULL THEN 'MISSING_REQUIRED_FIELD' WHEN k % 13 = 0 THEN 'MISSING_REFERENCE_MONTH'
  WHEN k % 17 = 0 OR k % 19 = 0 THEN 'COORDINATES_INVALID' WHEN k % 23 = 0 THEN 'ADDRESS_MISSING' ELSE 'ACCEPTED' END AS status,
  CASE WHEN k % 13 <> 0 THEN '2001-08' END AS reference_month
FROM (SELECT c_custkey AS k, CAST(c_custkey AS VARCHAR) AS business_id, CASE WHEN c_custkey % 11 <> 0 THEN c_name END AS business_name FROM customer)"""))
def registry_normalize(spark, sf):
    k = F.col("c_custkey")
    rows = b.table(spark, sf, "customer").select(
        k.cast("string").alias("bizesId"), F.when(k % 11 != 0, F.col("c_name")).alias("bizesNm"),
        F.when(k % 13 == 0, "2001").otherwise("200108").alias("stdrYm"),
        F.when(k % 17 == 0, "n/a").when(k % 19 == 0, "97.5").otherwise((37.45 + (k % 1000) / 10000.0).cast("string")).alias("lat"),
        (126.95 + (k % 700) / 10000.0).cast("string").alias("lon"),
        F.when(k % 23 == 0, " ").otherwise(F.concat(F.lit("Road "), k.cast("string"))).alias("rdnmAdr"), F.lit("").alias("lnoAdr"))
    out = landed.registry_records(rows)
    return out.select("business_id", "business_name", "status", month_name(F.col("reference_month")).alias("reference_month"))


# ---- sinks ---------------------------------------------------------------------------------

@query("idempotent_append", sql(f"""
SELECT o.observation_id, o.indicator_id, {DAY('o.observed_at')} AS observed_at FROM obs o
WHERE o.vintage_id <> 'VNT-0' AND o.observed_at >= DATE '2024-01-31' - 36500""", "obs"))
def idempotent_append(spark, sf):
    """Two deliveries overlap; only rows not stored before, one per id, inside the retention."""
    obs = b.observations(spark, sf)
    stored = obs.filter(F.col("vintage_id") == "VNT-0")
    fresh = sinks.new_rows(obs.unionByName(obs.filter(F.col("frequency") == "DAILY")), stored, ["observation_id"], ["available_at"])
    kept = sinks.within_retention(fresh, F.col("observed_at"), F.lit("2024-01-31").cast("date"), 36500)
    return kept.select("observation_id", "indicator_id", day_name(F.col("observed_at")).alias("observed_at"))


@query("latest_version", sql(f"""
SELECT store_id, count(*) AS version, max_by(loan_id, (rate, loan_id)) AS result_id, {r('max(rate)', 4)} AS rate
FROM (SELECT store_id, loan_id, annual_rate AS rate FROM loans) GROUP BY store_id""", "loans"))
def latest_version(spark, sf):
    results = b.loans(spark, sf).select("store_id", F.col("loan_id").alias("result_id"), F.col("annual_rate").alias("rate"))
    return sinks.latest_version(results, ["store_id"], ["rate", "result_id"]).select("store_id", "version", "result_id", rnd(F.col("rate"), 4).alias("rate"))


@query("latest_event_version", sql("""
SELECT event_id, version_key, source_tier, versions, source_id
FROM (SELECT o_custkey AS event_id, max(o_orderkey) AS version_key, max_by(o_orderpriority, (CAST(o_orderdate AS DATE), o_orderkey)) AS source_tier, count(*) AS versions FROM orders GROUP BY 1)
JOIN (SELECT DISTINCT o_custkey AS event_id, CAST(o_orderkey % 7 AS VARCHAR) AS source_id FROM orders) USING (event_id)"""))
def latest_event_version(spark, sf):
    rows = b.table(spark, sf, "orders").select(
        F.col("o_custkey").alias("event_id"), F.col("o_orderkey").alias("version_key"), F.to_date("o_orderdate").alias("created_at"),
        F.col("o_orderpriority").alias("source_tier"), F.array((F.col("o_orderkey") % 7).cast("string")).alias("source_ids"))
    latest = sinks.latest_version(rows, ["event_id"], ["created_at", "version_key"])
    links = rows.select("event_id", F.explode("source_ids").alias("source_id")).distinct()  # long rows: an event may have any number of sources
    top = rows.groupBy("event_id").agg(F.max("version_key").alias("version_key"))
    return latest.select("event_id", "source_tier", F.col("version").alias("versions")).join(links, "event_id").join(top, "event_id")


# ---- ledger upload check -------------------------------------------------------------------

cte("upload", """
SELECT store_id, rn AS row_index, CASE WHEN (store_id * 31 + rn) % 23 = 0 THEN strftime(month, '%Y/%m') ELSE strftime(month, '%Y-%m') END AS month,
  CASE WHEN (store_id * 31 + rn) % 17 = 0 THEN 'abc' WHEN (store_id * 31 + rn) % 19 = 0 THEN '-5' WHEN (store_id * 31 + rn) % 13 = 0 THEN CAST(v AS VARCHAR) || ',000' ELSE CAST(v AS VARCHAR) END AS revenue_krw,
  CAST(i + p + q + CASE WHEN (store_id * 31 + rn) % 11 = 0 THEN 5 ELSE 0 END AS VARCHAR) AS variable_costs_krw, CAST(f + 60000 AS VARCHAR) AS fixed_costs_krw,
  CASE WHEN (store_id * 31 + rn) % 5 = 0 THEN '' ELSE CAST(i AS VARCHAR) END AS ingredients_krw,
  CASE WHEN (store_id * 31 + rn) % 10 = 0 THEN NULL ELSE CAST(p AS VARCHAR) END AS platform_fee_krw,
  CASE WHEN (store_id * 31 + rn) % 10 = 0 THEN '' ELSE CAST(q AS VARCHAR) END AS payment_fee_krw,
  CAST(f AS VARCHAR) AS rent_krw, '40000' AS labor_krw, '15000' AS utilities_krw,
  CASE WHEN (store_id * 31 + rn) % 7 = 0 THEN '' WHEN (store_id * 31 + rn) % 29 = 0 THEN '9999' ELSE '5000' END AS other_fixed_krw,
  CASE store_id % 9 WHEN 0 THEN NULL WHEN 1 THEN 'store_history.v0' ELSE 'store_history.v1' END AS schema_version,
  CASE (store_id * 31 + rn) % 4 WHEN 0 THEN '0.05' WHEN 1 THEN '5' END AS annual_interest_rate,
  CASE (store_id * 31 + rn) % 3 WHEN 0 THEN 'decimal' WHEN 1 THEN 'PERCENT' ELSE 'RATIO' END AS interest_rate_unit
FROM (SELECT store_id, month, row_number() OVER (PARTITION BY store_id ORDER BY month) AS rn, CAST(floor(revenue) AS BIGINT) AS v, CAST(floor(ingredients) AS BIGINT) AS i,
  CAST(floor(platform_fee) AS BIGINT) AS p, CAST(floor(payment_fee) AS BIGINT) AS q, CAST(rent AS BIGINT) AS f FROM history)""", "history")
cte("uploaded", """SELECT * FROM upload UNION ALL SELECT * REPLACE (row_index + 1000 AS row_index) FROM upload WHERE (store_id * 31 + row_index) % 37 = 0""", "upload")


def uploaded(spark, sf):
    from pyspark.sql import Window

    h = b.history(spark, sf).withColumn("rn", F.row_number().over(Window.partitionBy("store_id").orderBy("month")))
    z = F.col("store_id") * 31 + F.col("rn")
    whole = lambda c: F.floor(c).cast("bigint")
    text = lambda c: c.cast("string")
    v, i, p, q, f = whole("revenue"), whole("ingredients"), whole("platform_fee"), whole("payment_fee"), F.col("rent").cast("bigint")
    k = F.col("store_id")
    rows = h.select(
        "store_id", F.col("rn").alias("row_index"),
        F.when(z % 23 == 0, F.date_format("month", "yyyy/MM")).otherwise(F.date_format("month", "yyyy-MM")).alias("month"),
        F.when(z % 17 == 0, "abc").when(z % 19 == 0, "-5").when(z % 13 == 0, F.concat(text(v), F.lit(",000"))).otherwise(text(v)).alias("revenue_krw"),
        text(i + p + q + F.when(z % 11 == 0, 5).otherwise(0)).alias("variable_costs_krw"), text(f + 60000).alias("fixed_costs_krw"),
        F.when(z % 5 == 0, "").otherwise(text(i)).alias("ingredients_krw"), F.when(z % 10 != 0, text(p)).alias("platform_fee_krw"),
        F.when(z % 10 == 0, "").otherwise(text(q)).alias("payment_fee_krw"), text(f).alias("rent_krw"), F.lit("40000").alias("labor_krw"),
        F.lit("15000").alias("utilities_krw"), F.when(z % 7 == 0, "").when(z % 29 == 0, "9999").otherwise("5000").alias("other_fixed_krw"),
        F.when(k % 9 == 0, None).when(k % 9 == 1, "store_history.v0").otherwise("store_history.v1").alias("schema_version"),
        F.when(z % 4 == 0, "0.05").when(z % 4 == 1, "5").alias("annual_interest_rate"),
        F.when(z % 3 == 0, "decimal").when(z % 3 == 1, "PERCENT").otherwise("RATIO").alias("interest_rate_unit"))
    # some rows come twice; repeated in place, as a union would number the months twice and bring whole branches into one task
    again = F.explode(F.when((k * 31 + F.col("row_index")) % 37 == 0, F.array(F.lit(0), F.lit(1000))).otherwise(F.array(F.lit(0))))
    return rows.withColumn("_again", again).withColumn("row_index", F.col("row_index") + F.col("_again")).drop("_again")


def _num(c):
    return f"CASE WHEN trim(coalesce({c}, '')) <> '' AND TRY_CAST(trim(replace({c}, ',', '')) AS DECIMAL(28,8)) >= 0 THEN TRY_CAST(trim(replace({c}, ',', '')) AS DECIMAL(28,8)) END"


def _step(c, required):
    blank = "'REQUIRED_VALUE'" if required else "NULL"
    num = f"TRY_CAST(trim(replace({c}, ',', '')) AS DECIMAL(28,8))"
    return f"CASE WHEN trim(coalesce({c}, '')) = '' THEN {blank} WHEN {num} IS NULL THEN 'DATA_TYPE' WHEN {num} < 0 THEN 'RANGE_CHECK' END"


_CHECKS = [(f"{_step(c, c in ledger_csv.REQUIRED)}", "ERROR", c) for c in ledger_csv.REQUIRED[1:] + ledger_csv.VARIABLE + ledger_csv.FIXED]
_V = [_num(c) for c in ledger_csv.VARIABLE]
_FX = [_num(c) for c in ledger_csv.FIXED]
_ALLV = " AND ".join(f"({x}) IS NOT NULL" for x in _V)
_ANYV = " OR ".join(f"({x}) IS NOT NULL" for x in _V)
_ALLF = " AND ".join(f"({x}) IS NOT NULL" for x in _FX)
_TV, _TF = _num("variable_costs_krw"), _num("fixed_costs_krw")
_CHECKS += [
    (f"CASE WHEN {_ALLV} AND ({_TV}) IS NOT NULL AND abs({' + '.join('(' + x + ')' for x in _V)} - ({_TV})) > 1 THEN 'ACCOUNTING_SUM' END", "ERROR", "variable_costs_krw"),
    (f"CASE WHEN NOT ({_ALLV} AND ({_TV}) IS NOT NULL) AND ({_ANYV}) THEN 'ACCOUNTING_SUM' END", "ERROR", "variable_cost_details"),
    (f"CASE WHEN NOT ({_ANYV}) THEN 'MISSING_OPTIONAL_DETAIL' END", "WARNING", "variable_cost_details"),
    (f"CASE WHEN {_ALLF} AND ({_TF}) IS NOT NULL AND abs({' + '.join('(' + x + ')' for x in _FX)} - ({_TF})) > 1 THEN 'ACCOUNTING_SUM' END", "ERROR", "fixed_costs_krw"),
    ("CASE WHEN coalesce(annual_interest_rate, '') <> '' AND upper(coalesce(interest_rate_unit, '')) NOT IN ('DECIMAL', 'PERCENT') THEN 'UNIT' END", "ERROR", "interest_rate_unit"),
    ("CASE WHEN coalesce(annual_interest_rate, '') <> '' AND upper(interest_rate_unit) = 'DECIMAL' AND TRY_CAST(annual_interest_rate AS DECIMAL(28,8)) > 1 THEN 'RANGE_CHECK' END", "ERROR", "annual_interest_rate"),
]
_GOOD_MONTH = "regexp_full_match(trim(month), '[0-9]{4}-(0[1-9]|1[0-2])')"
_LEDGER_SQL = " UNION ALL ".join(
    [f"SELECT store_id, row_index, '{sev}' AS severity, {expr} AS step, '{col}' AS \"column\", NULL::VARCHAR AS detail, 1 AS n FROM uploaded WHERE {_GOOD_MONTH} AND ({expr}) IS NOT NULL"
     for expr, sev, col in _CHECKS]
    + [f"SELECT store_id, row_index, 'ERROR', 'DATA_TYPE', 'month', NULL, 1 FROM uploaded WHERE NOT {_GOOD_MONTH}",
       f"SELECT store_id, NULL, 'ERROR', 'TIMESERIES_CONTINUITY', 'month', 'duplicate ' || month, count(*) - 1 FROM uploaded WHERE {_GOOD_MONTH} GROUP BY store_id, month HAVING count(*) > 1",
       f"""SELECT store_id, NULL, 'ERROR', 'TIMESERIES_CONTINUITY', 'month', 'missing between ' || prev || ' and ' || month, 1 FROM (
        SELECT *, lag(month) OVER (PARTITION BY store_id ORDER BY month) AS prev FROM (SELECT DISTINCT store_id, month FROM uploaded WHERE {_GOOD_MONTH}))
        WHERE CAST(month || '-01' AS DATE) <> CAST(CAST(prev || '-01' AS DATE) + INTERVAL 1 MONTH AS DATE)""",
       "SELECT store_id, NULL, 'WARNING', 'SCHEMA_VERSION', 'schema_version', NULL, 1 FROM uploaded GROUP BY store_id HAVING count(schema_version) = 0",
       "SELECT store_id, NULL, 'ERROR', 'SCHEMA_VERSION', 'schema_version', NULL, 1 FROM uploaded GROUP BY store_id HAVING bool_or(schema_version <> 'store_history.v1')"])


@query("ledger_valid_rows", sql(f"""SELECT store_id, row_index, month FROM uploaded WHERE store_id NOT IN (SELECT store_id FROM ({_LEDGER_SQL}) WHERE severity = 'ERROR')""", "uploaded"))
def ledger_valid_rows(spark, sf):
    rows = staged(spark, "uploaded:" + sf, lambda: uploaded(spark, sf))
    return ledger_csv.valid_rows(rows, ledger_csv.validate_ledger(rows)).select("store_id", "row_index", "month")


@query("ledger_validate", sql(_LEDGER_SQL, "uploaded"))
def ledger_validate(spark, sf):
    return ledger_csv.validate_ledger(staged(spark, "uploaded:" + sf, lambda: uploaded(spark, sf)))

