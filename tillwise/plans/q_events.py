"""Event candidates, signals and scenario adjustments."""

from __future__ import annotations

from pyspark.sql import functions as F

from tillwise.functions.core import day_name, month_name, month_scaffold, rnd
from tillwise.functions.geo import geo_exposure as exposure_of
from tillwise.functions.geo import haversine_m
from tillwise.functions.stages import staged
from tillwise.operators import events as ev
from tillwise.operators import results as rs
from tillwise.operators import signals as sg
from tillwise.operators.spatial import radius_points, radius_summary
from tillwise.plans import bindings as b
from tillwise.plans import q_finance  # noqa: F401  (its CTEs)
from tillwise.plans.catalog import cte, query, r, sql
from tillwise.sources.registry import COEFFICIENTS, TIER_WEIGHT, event_types

def hav(lat1, lon1, lat2, lon2):
    a = (f"(pow(sin(radians({lat2} - {lat1}) / 2.0::DOUBLE), 2) + cos(radians({lat1})) * cos(radians({lat2})) * pow(sin(radians({lon2} - {lon1}) / 2.0::DOUBLE), 2))")
    return f"(6371000.0::DOUBLE * (2.0::DOUBLE * atan2(sqrt({a}), sqrt(1.0::DOUBLE - {a}))))"


def present(*pairs):
    """SQL list of the codes whose condition holds."""
    return "list_filter([" + ", ".join(f"CASE WHEN {c} THEN '{v}' END" for c, v in pairs) + "], lambda x: x IS NOT NULL)"


def sorted_codes(expr):
    return f"array_to_string(list_sort(list_distinct({expr})), ',')"


# ---- checks of raw rows --------------------------------------------------------------------

cte("raw_events", """
SELECT o_orderkey AS k, CASE WHEN o_orderkey % 29 = 0 THEN ' ' ELSE CAST(o_orderkey AS VARCHAR) END AS event_id,
  CASE o_orderkey % 13 WHEN 0 THEN 'SPACE' WHEN 1 THEN 'local' ELSE 'MACRO' END AS domain, CASE WHEN o_orderkey % 31 <> 0 THEN 'FX_MARKET' END AS event_family,
  'KRW_DEPRECIATION' AS event_type, CASE o_orderkey % 7 WHEN 0 THEN 'UP' WHEN 1 THEN '-1' ELSE 'positive' END AS direction,
  CASE WHEN o_orderkey % 17 = 0 THEN 'soon' ELSE strftime(o_orderdate, '%Y-%m-%d') || 'T00:00' END AS start_date,
  CASE o_orderkey % 5 WHEN 0 THEN NULL WHEN 1 THEN strftime(o_orderdate - INTERVAL 3 DAY, '%Y-%m-%d') ELSE strftime(o_orderdate + INTERVAL 3 DAY, '%Y-%m-%d') END AS end_date FROM orders""")


@query("event_schema_check", sql("""
SELECT k, array_to_string(CASE WHEN len(miss) > 0 THEN miss ELSE rest END, ',') AS errors FROM (SELECT k, """
    + present(*[(f"trim(coalesce({c}, '')) = ''", "MISSING:" + c) for c in ev.REQUIRED]) + " AS miss, "
    + present(("upper(domain) NOT IN ('MACRO', 'INDUSTRY', 'LOCAL', 'POLICY')", "INVALID_DOMAIN"),
              ("upper(direction) NOT IN ('POSITIVE', 'NEGATIVE', 'NEUTRAL', '-1', '0', '1')", "INVALID_DIRECTION"),
              ("TRY_CAST(substr(start_date, 1, 10) AS DATE) IS NULL", "INVALID_DATE_FORMAT"),
              ("TRY_CAST(substr(start_date, 1, 10) AS DATE) > TRY_CAST(end_date AS DATE)", "INVALID_DATE_ORDER")) + " AS rest FROM raw_events)", "raw_events"))
def event_schema_check(spark, sf):
    k, day = F.col("o_orderkey"), F.to_date("o_orderdate")
    rows = b.table(spark, sf, "orders").select(
        k.alias("k"), F.when(k % 29 == 0, " ").otherwise(k.cast("string")).alias("event_id"),
        F.when(k % 13 == 0, "SPACE").when(k % 13 == 1, "local").otherwise("MACRO").alias("domain"),
        F.when(k % 31 != 0, "FX_MARKET").alias("event_family"), F.lit("KRW_DEPRECIATION").alias("event_type"),
        F.when(k % 7 == 0, "UP").when(k % 7 == 1, "-1").otherwise("positive").alias("direction"),
        F.when(k % 17 == 0, "soon").otherwise(F.concat(day_name(day), F.lit("T00:00"))).alias("start_date"),
        F.when(k % 5 == 0, None).when(k % 5 == 1, day_name(F.date_sub(day, 3))).otherwise(day_name(F.date_add(day, 3))).alias("end_date"))
    return ev.schema_errors(rows).select("k", F.array_join("errors", ",").alias("errors"))


cte("candidates", f"""
SELECT n.*, CASE WHEN event_id % 31 = 0 THEN 'WRONG' ELSE family END AS c_family, CASE WHEN event_id % 37 = 0 THEN 'PLATFORM_COST' ELSE axis END AS c_axis,
  CASE WHEN event_id % 41 = 0 THEN 'WRONG' ELSE mechanism END AS c_mechanism, event_id % 29 <> 0 AS has_attributes,
  event_id % (SELECT 2 * count(*) FROM supplier) AS store_id
FROM notices n""", "notices")
REGISTRY_CODES = present(
    ("c_family <> family", "ENUM_NOT_ALLOWED"), ("c_axis <> axis", "DIRECTION_MECHANISM_NOT_ALLOWED"), ("c_mechanism <> mechanism", "MECHANISM_NOT_SUPPORTED"),
    ("required_attribute IS NOT NULL AND NOT has_attributes", "MISSING_REQUIRED_FIELD"))


def candidates(spark, sf):
    n = b.notices(spark, sf)
    k = F.col("event_id")
    impact = F.struct(F.when(k % 37 == 0, "PLATFORM_COST").otherwise(F.col("impacts")[0]["axis"]).alias("axis"),
                      F.col("impacts")[0]["direction"].alias("direction"),
                      F.when(k % 41 == 0, "WRONG").otherwise(F.col("impacts")[0]["mechanism"]).alias("mechanism"))
    names = F.create_map(*[F.lit(x) for x in ("platform_name", "p", "closure_scope", "c", "business_type", "b")])
    return n.select(
        "event_id", "event_type", "domain", F.when(k % 31 == 0, "WRONG").otherwise(F.col("family")).alias("family"), F.array(impact).alias("impacts"),
        F.when(k % 29 != 0, names).otherwise(F.create_map().cast("map<string,string>")).alias("attributes"), "start_date", "end_date", "source_tier", "lat", "lon", "industries",
        (k % b.store_count(spark, sf)).alias("store_id"))


@query("registry_check", sql(f"""
SELECT event_id, {sorted_codes(REGISTRY_CODES)} AS codes FROM candidates JOIN (SELECT event_type, required_attribute FROM registry) USING (event_type)""", "candidates", "registry"))
def registry_check(spark, sf):
    out = ev.registry_errors(candidates(spark, sf), event_types(spark))
    return out.select("event_id", F.array_join("registry_codes", ",").alias("codes"))


# one store's request per candidate; every gate is hit by some key
cte("gate_input", f"""
SELECT c.*, required_attribute, s.business_type_code, {hav('s.lat', 's.lon', 'c.lat', 'c.lon')} AS distance_m, k % 43 = 0 AS bad_number, k % 47 = 0 AS source_missing, k % 53 = 0 AS injected,
  c.source_tier = 'OTHER' AS all_other, k % 59 = 0 AS no_quote, k % 61 = 0 AS bad_offset, k % 67 = 0 AS paths_missing, k % 71 = 0 AS start_failed, k % 73 = 0 AS end_failed,
  k % 2 = 0 AS ongoing, k % 79 = 0 AS two_venues, k % 83 = 0 AS vague, k % 89 = 0 AS no_point,
  CASE WHEN ind = 2 AND s.business_type_code = 'RETAIL' OR ind = 0 AND s.business_type_code = 'FNB_CAFE' OR ind = 1 AND s.business_type_code = 'FNB_RESTAURANT' THEN 1.0::DOUBLE
    WHEN ind <> 2 AND s.business_type_code LIKE 'FNB%' THEN 0.7::DOUBLE ELSE 0.0::DOUBLE END AS relevance
FROM (SELECT *, event_id AS k FROM candidates) c JOIN stores s USING (store_id) JOIN (SELECT event_type, required_attribute FROM registry) USING (event_type)""", "candidates", "stores", "registry")
_EARLY = present(("all_other", "SOURCE_UNTRUSTED"), ("no_quote", "QUOTE_NOT_FOUND"), ("bad_offset", "OFFSET_MISMATCH"), ("paths_missing", "MISSING_REQUIRED_FIELD"))
_OUT = "(end_used < DATE '2001-09-01' OR start_date > DATE '2002-02-28')"
_DATED = present(("start_date > end_used", "DATE_RANGE_INVALID"), (_OUT, "FORECAST_WINDOW_NOT_OVERLAPPED"))
_PLACE = present(("relevance = 0", "INDUSTRY_NOT_RELEVANT"), ("domain = 'LOCAL' AND (two_venues OR vague)", "LOCATION_AMBIGUOUS"),
                 ("geo_policy = 'LOCATION_REQUIRED' AND no_point", "GEO_NOT_FOUND"), ("geo_policy = 'LOCATION_REQUIRED' AND NOT no_point AND distance_m > 5000", "OUTSIDE_SEARCH_RADIUS"))
_GATE = f"""CASE WHEN bad_number THEN 'NUMERIC' WHEN injected THEN 'SECURITY' WHEN source_missing THEN 'SOURCE' WHEN len(reg) > 0 THEN 'REGISTRY'
  WHEN start_failed OR end_failed THEN 'DATE' WHEN event_type LIKE 'WHOLESALE%' AND start_date < DATE '2001-08-31' - 180 THEN 'HISTORY'
  WHEN end_used IS NULL THEN 'ONGOING' WHEN {_OUT} THEN 'WINDOW' WHEN len(early) + len(dated) + len(place) > 0 THEN 'FINAL' ELSE 'ACCEPTED' END"""
cte("validated", f"""
SELECT *, CASE gate WHEN 'NUMERIC' THEN ['OFFICIAL_NUMERIC_UNIT_INVALID'] WHEN 'SECURITY' THEN ['PROMPT_INJECTION_DETECTED'] WHEN 'SOURCE' THEN ['SOURCE_UNAVAILABLE'] WHEN 'REGISTRY' THEN reg
    WHEN 'DATE' THEN early || ['DATE_PARSE_FAILED'] WHEN 'HISTORY' THEN early || ['HISTORICAL_CONTEXT_ONLY'] WHEN 'ONGOING' THEN early || ['MISSING_ONGOING_EVIDENCE']
    WHEN 'WINDOW' THEN early || dated WHEN 'FINAL' THEN early || dated || place ELSE [] END AS found,
  CASE gate WHEN 'NUMERIC' THEN 'RETRYABLE' WHEN 'SECURITY' THEN 'REJECTED' WHEN 'SOURCE' THEN 'REJECTED' WHEN 'REGISTRY' THEN 'RETRYABLE' WHEN 'DATE' THEN 'RETRYABLE' WHEN 'HISTORY' THEN 'REFERENCE_ONLY'
    WHEN 'ONGOING' THEN 'REFERENCE_ONLY' WHEN 'WINDOW' THEN 'REJECTED' WHEN 'FINAL' THEN CASE WHEN list_contains(early, 'SOURCE_UNTRUSTED') THEN 'REFERENCE_ONLY'
      WHEN list_has_any(dated || place, ['OUTSIDE_SEARCH_RADIUS', 'INDUSTRY_NOT_RELEVANT']) THEN 'REJECTED' ELSE 'RETRYABLE' END ELSE 'ACCEPTED' END AS status
FROM (SELECT *, {_GATE} AS gate FROM (SELECT *, {_EARLY} AS early, {_DATED} AS dated, {_PLACE} AS place, {REGISTRY_CODES} AS reg
  FROM (SELECT *, coalesce(end_date, CASE WHEN temporal_policy <> 'BOUNDED' AND ongoing THEN DATE '2002-02-28' END) AS end_used FROM gate_input)))""", "gate_input")
STAGES_SQL = """'DISCOVERED,EXTRACTED' || CASE gate WHEN 'HISTORY' THEN ',VALIDATION_ATTEMPTED,EVIDENCE_VALIDATED,HISTORICAL_CONTEXT_RETAINED'
  WHEN 'ONGOING' THEN ',VALIDATION_ATTEMPTED,EVIDENCE_VALIDATED,TEMPORAL_EVIDENCE_INSUFFICIENT' WHEN 'WINDOW' THEN ',VALIDATION_ATTEMPTED,EVIDENCE_VALIDATED,TEMPORAL_VALIDATED,OUTSIDE_FORECAST_WINDOW'
  WHEN 'FINAL' THEN ',VALIDATION_ATTEMPTED,EVIDENCE_VALIDATED' || CASE WHEN status = 'REFERENCE_ONLY' THEN ',SOURCE_UNTRUSTED' WHEN list_contains(found, 'OUTSIDE_SEARCH_RADIUS') THEN ',TEMPORAL_VALIDATED,GEO_VALIDATED,EXCLUDED_BY_DISTANCE'
    ELSE ',TEMPORAL_VALIDATED,VALIDATION_FAILED' END WHEN 'ACCEPTED' THEN ',VALIDATION_ATTEMPTED,EVIDENCE_VALIDATED,TEMPORAL_VALIDATED,GEO_VALIDATED,INSTANCE_ELIGIBLE' ELSE '' END"""


def validated(spark, sf):
    c = ev.registry_errors(candidates(spark, sf), event_types(spark))
    s = b.stores(spark, sf).select("store_id", F.col("business_type_code").alias("store_code"), F.col("lat").alias("s_lat"), F.col("lon").alias("s_lon"))
    k = F.col("event_id")
    every = lambda n: k % n == 0
    text = lambda x: F.array(F.lit(x))
    none = F.array().cast("array<string>")
    rows = c.join(s, "store_id").withColumns({
        "numeric_code": F.when(every(43), "OFFICIAL_NUMERIC_UNIT_INVALID"), "source_missing": every(47), "injected": every(53),
        "all_other": F.col("source_tier") == "OTHER",
        "evidence_codes": F.concat(F.when(every(59), text("QUOTE_NOT_FOUND")).otherwise(none), F.when(every(61), text("OFFSET_MISMATCH")).otherwise(none)),
        "paths_missing": every(67), "start_failed": every(71), "end_failed": every(73), "start": F.col("start_date"), "end": F.col("end_date"),
        "published": F.col("start_date"), "next_decision": F.lit(None).cast("date"),
        "quotes": F.when(every(2), text("The measure remains in effect until lifted")).otherwise(text("Plain notice text")),
        "venues": F.when(every(79), F.array(F.lit("A"), F.lit("B"))).otherwise(text("A")), "venue_instance": F.lit(None).cast("string"),
        "address": F.when(~every(83), F.lit("1 Main Street")), "area": F.when(every(83), F.lit("Gangnam area")),
        "distance_m": haversine_m(F.col("s_lat"), F.col("s_lon"), F.col("lat"), F.col("lon")), "radius_m": F.lit(5000)})
    rows = rows.withColumn("lat", F.when(~every(89), F.col("lat")))
    return ev.validate_candidates(rows, b.start(), b.window_end(), b.as_of())


@query("validate_candidates", sql(f"SELECT event_id, store_id, status, {sorted_codes('found')} AS failure_codes, {STAGES_SQL} AS stages FROM validated", "validated"))
def validate_candidates(spark, sf):
    return validated(spark, sf).select("event_id", "store_id", "status", F.array_join("failure_codes", ",").alias("failure_codes"), F.array_join("stages", ",").alias("stages"))


@query("window_overlap_filter", sql("""
SELECT event_id, strftime(start_date, '%Y-%m-%d') AS start_date FROM notices WHERE coalesce(end_date, DATE '2002-02-28') >= DATE '2001-09-01' AND start_date <= DATE '2002-02-28'""", "notices"))
def window_overlap_filter(spark, sf):
    n = b.notices(spark, sf)
    return n.filter(ev.overlaps(F.col("start_date"), F.col("end_date"), b.start(), b.window_end())).select("event_id", day_name(F.col("start_date")).alias("start_date"))


@query("radius_join", sql(f"""
SELECT s.store_id, {r('p.lat', 4)} AS lat, {r('p.lon', 4)} AS lon, p.event_count, {r(hav('s.lat', 's.lon', 'p.lat', 'p.lon'), 3)} AS distance_m
FROM stores s, (SELECT lat, lon, count(*) AS event_count FROM notices GROUP BY lat, lon) p WHERE {hav('s.lat', 's.lon', 'p.lat', 'p.lon')} <= 1500""", "stores", "notices"))
def radius_join(spark, sf):
    out = radius_points(b.stores(spark, sf), b.notices(spark, sf))
    return out.select("store_id", rnd(F.col("lat"), 4).alias("lat"), rnd(F.col("lon"), 4).alias("lon"), "event_count", rnd(F.col("distance_m"), 3).alias("distance_m"))


@query("radius_summary", sql(f"""
SELECT s.store_id, coalesce(sum(p.event_count), 0)::BIGINT AS event_count, {r("min(" + hav('s.lat', 's.lon', 'p.lat', 'p.lon') + ")", 3)} AS nearest_m
FROM stores s LEFT JOIN (SELECT lat, lon, count(*) AS event_count FROM notices GROUP BY lat, lon) p ON {hav('s.lat', 's.lon', 'p.lat', 'p.lon')} <= 1500 GROUP BY 1""", "stores", "notices"))
def radius_summary_query(spark, sf):
    out = radius_summary(b.stores(spark, sf), b.notices(spark, sf))
    return out.select("store_id", "event_count", rnd(F.col("nearest_m"), 3).alias("nearest_m"))


OVERLAP_SQL = """CASE WHEN greatest(m.month, n.start_date) > least(last_day(m.month), coalesce(n.end_date, last_day(m.month))) THEN 0.0::DOUBLE
  ELSE (datediff('day', greatest(m.month, n.start_date), least(last_day(m.month), coalesce(n.end_date, last_day(m.month)))) + 1)::DOUBLE / day(last_day(m.month)) END"""
cte("months", "SELECT CAST(DATE '2001-09-01' + to_months(CAST(i AS INTEGER)) AS DATE) AS month, i + 1 AS month_index FROM range(0, 6) t(i)")


@query("event_month_overlap", sql(f"""
SELECT event_id, strftime(m.month, '%Y-%m') AS month, {r(OVERLAP_SQL, 4)} AS overlap FROM notices n, months m WHERE {OVERLAP_SQL} > 0""", "notices", "months"))
def event_month_overlap(spark, sf):
    n = b.notices(spark, sf).filter(ev.overlaps(F.col("start_date"), F.col("end_date"), b.start(), b.window_end()))
    first = F.greatest(F.trunc("start_date", "month"), b.start())
    last = F.least(F.trunc(F.coalesce("end_date", b.window_end()), "month"), F.trunc(b.window_end(), "month"))
    rows = n.withColumn("month", F.explode(F.sequence(first, last, F.expr("interval 1 month"))))
    return rows.select("event_id", month_name(F.col("month")).alias("month"), rnd(ev.month_overlap(F.col("start_date"), F.col("end_date"), F.col("month")), 4).alias("overlap"))


@query("geo_exposure", sql(f"""
SELECT event_id, store_id, CASE WHEN lat2 IS NULL THEN 'EXCLUDED_DUE_TO_MISSING_GEO' WHEN lat2 > 90 THEN 'EXCLUDED_DUE_TO_INVALID_GEO' ELSE 'CALCULATED' END AS status,
  CASE WHEN lat2 <= 90 THEN {r(hav('s_lat', 's_lon', 'lat2', 'lon'), 2)} END AS distance_m,
  coalesce(CASE WHEN lat2 <= 90 THEN {r('exp(-' + hav('s_lat', 's_lon', 'lat2', 'lon') + ' / 500.0::DOUBLE)', 6)} END, 0.0::DOUBLE) AS exposure
FROM (SELECT f.*, s.lat AS s_lat, s.lon AS s_lon, n.lon, CASE WHEN event_id % 29 = 0 THEN NULL WHEN event_id % 31 = 0 THEN 95.0::DOUBLE ELSE n.lat END AS lat2
  FROM found_by f JOIN notices n USING (event_id) JOIN stores s USING (store_id))""", "found_by", "notices", "stores"))
def geo_exposure(spark, sf):
    n = b.notices(spark, sf).select("event_id", F.when(F.col("event_id") % 29 == 0, None).when(F.col("event_id") % 31 == 0, 95.0).otherwise(F.col("lat")).alias("lat"), "lon")
    pairs = b.found_by(spark, sf).join(n, "event_id").join(b.stores(spark, sf).select("store_id", F.col("lat").alias("s_lat"), F.col("lon").alias("s_lon")), "store_id")
    out = pairs.withColumn("g", exposure_of(F.col("s_lat"), F.col("s_lon"), F.col("lat"), F.col("lon")))
    return out.select("event_id", "store_id", F.col("g.status").alias("status"), rnd(F.col("g.distance_m"), 2).alias("distance_m"), rnd(F.col("g.exposure"), 6).alias("exposure"))


SCHEDULE_SQL = """CASE WHEN greatest(event_from, open_from) >= least(event_to, open_to) THEN 0.0::DOUBLE ELSE floor((least(event_to, open_to) - greatest(event_from, open_from))::DOUBLE / (open_to - open_from) * 10000.0::DOUBLE + 0.5::DOUBLE) / 10000.0::DOUBLE END"""


@query("schedule_overlap", sql(f"""
SELECT event_id, store_id, {SCHEDULE_SQL} AS overlap FROM (SELECT f.*, n.event_from, n.event_to, 9 + store_id % 3 AS open_from, 18 + store_id % 5 AS open_to FROM found_by f JOIN notices n USING (event_id))""", "found_by", "notices"))
def schedule_overlap(spark, sf):
    pairs = b.found_by(spark, sf).join(b.notices(spark, sf).select("event_id", "event_from", "event_to"), "event_id")
    k = F.col("store_id")
    return pairs.select("event_id", "store_id", sg.schedule_overlap(F.col("event_from"), F.col("event_to"), 9 + k % 3, 18 + k % 5).alias("overlap"))


# ---- signals -------------------------------------------------------------------------------

cte("caused", """
SELECT *, 'CAUSE-' || upper(substr(sha256(CASE axis WHEN 'INTEREST_COST' THEN 'INTEREST_RATE' WHEN 'INGREDIENT_COST' THEN 'FX_IMPORT_INGREDIENT' ELSE CAST(event_id AS VARCHAR) END), 1, 16)) AS cause_group_id,
  axis = 'INTEREST_COST' OR axis = 'INGREDIENT_COST' AND mechanism NOT IN ('SUPPLY_DISRUPTION', 'SUPPLY_RECOVERY') AS covered FROM notices""", "notices")
INDICATORS = ["BASE_RATE", "USD_KRW", "IMPORT_PRICE_INDEX_USD", "CONSUMER_PRICE_INDEX"]


def caused(spark, sf):
    return ev.assign_cause_groups(b.notices(spark, sf), F.array(*[F.lit(i) for i in INDICATORS]))


@query("cause_groups", sql("""
SELECT event_id, cause_group_id, covered, signal_enabled AND NOT covered AS signal_enabled,
  CASE WHEN axis = 'INGREDIENT_COST' THEN 'CAUSE_GRP_FX_INGREDIENT' WHEN axis = 'INTEREST_COST' OR family = 'MONETARY_POLICY' THEN 'CAUSE_GRP_INTEREST_RATE' ELSE 'CAUSE_GRP_' || event_id END AS cause_group_v1 FROM caused""", "caused"))
def cause_groups(spark, sf):
    return caused(spark, sf).select("event_id", "cause_group_id", "covered", "signal_enabled",
                                    ev.cause_group_v1(F.col("impacts")[0]["axis"], F.col("family"), F.col("event_id")).alias("cause_group_v1"))


_TIER = "CASE source_tier " + " ".join(f"WHEN '{k}' THEN {v}::DOUBLE" for k, v in TIER_WEIGHT.items()) + " ELSE 0.0::DOUBLE END"
cte("raw_signals", f"""
SELECT 'SIG-' || upper(substr(sha256(event_id || '|' || store_id || '|' || strftime(month, '%Y-%m') || '|' || axis), 1, 20)) AS signal_id, store_id, event_id, month, axis, cause_group_id, source_tier,
  direction * evidence * (geo * overlap * relevance * schedule) * severity * decay * exposed AS raw, geo * overlap * relevance * schedule AS exposure, decay
FROM (SELECT f.store_id, n.event_id, m.month, n.axis, n.cause_group_id, n.source_tier, n.severity, CASE n.direction WHEN 'INCREASE' THEN 1 WHEN 'DECREASE' THEN -1 ELSE 0 END AS direction, {_TIER} AS evidence,
    CASE WHEN n.domain = 'LOCAL' THEN exp(-{hav('s.lat', 's.lon', 'n.lat', 'n.lon')} / 500.0::DOUBLE) ELSE 1.0::DOUBLE END AS geo, {OVERLAP_SQL} AS overlap,
    CASE WHEN n.ind = 2 AND s.business_type_code = 'RETAIL' OR n.ind = 0 AND s.business_type_code = 'FNB_CAFE' OR n.ind = 1 AND s.business_type_code = 'FNB_RESTAURANT' THEN 1.0::DOUBLE
      WHEN n.ind <> 2 AND s.business_type_code LIKE 'FNB%' THEN 0.7::DOUBLE ELSE 0.3::DOUBLE END AS relevance,
    {SCHEDULE_SQL.replace('open_from', '(9 + f.store_id % 3)').replace('open_to', '(18 + f.store_id % 5)')} AS schedule,
    1.0::DOUBLE / (1.0::DOUBLE + 0.15::DOUBLE * greatest(0, (year(m.month) - year(n.start_date)) * 12 + month(m.month) - month(n.start_date))) AS decay,
    CASE WHEN n.axis = 'INTEREST_COST' AND NOT v.variable_debt THEN 0.0::DOUBLE ELSE 1.0::DOUBLE END AS exposed
  FROM found_by f JOIN caused n USING (event_id) JOIN stores s USING (store_id) JOIN variable_debt v USING (store_id) CROSS JOIN months m
  WHERE n.signal_enabled AND NOT n.covered AND coalesce(n.end_date, DATE '2002-02-28') >= DATE '2001-09-01' AND n.start_date <= DATE '2002-02-28')""",
    "found_by", "caused", "stores", "variable_debt", "months")
cte("signals", """
SELECT * EXCLUDE (rn) FROM (SELECT *, row_number() OVER (PARTITION BY store_id, month, axis, cause_group_id ORDER BY abs(raw) DESC, event_id) AS rn FROM raw_signals) WHERE rn = 1""", "raw_signals")


def derive_signals(spark, sf):
    live = caused(spark, sf).filter(ev.overlaps(F.col("start_date"), F.col("end_date"), b.start(), b.window_end()))
    return sg.store_signals(live, b.signal_stores(spark, sf), b.found_by(spark, sf), b.start(), b.HORIZON)


def raw_signals(spark, sf):
    """Signals of all stores, written once: deduplication, adjustments and lifecycles read them."""
    return staged(spark, "signals:" + sf, lambda: derive_signals(spark, sf))


@query("store_signals", sql(f"""
SELECT signal_id, store_id, event_id, strftime(month, '%Y-%m') AS month, axis, {r('raw', 8)} AS raw, {r('exposure', 8)} AS exposure, {r('decay', 6)} AS decay FROM raw_signals""", "raw_signals"))
def store_signals(spark, sf):
    return derive_signals(spark, sf).select(
        "signal_id", "store_id", "event_id", month_name(F.col("month")).alias("month"), "axis", rnd(F.col("raw"), 8).alias("raw"),
        rnd(F.col("exposure"), 8).alias("exposure"), rnd(F.col("decay"), 6).alias("decay"))


@query("dedupe_causes", sql(f"SELECT store_id, strftime(month, '%Y-%m') AS month, axis, cause_group_id AS cause, event_id, {r('raw', 8)} AS raw FROM signals", "signals"))
def dedupe_causes(spark, sf):
    return sg.dedupe_causes(raw_signals(spark, sf)).select("store_id", month_name(F.col("month")).alias("month"), "axis", "cause", "event_id", rnd(F.col("raw"), 8).alias("raw"))


def _adjust_sql(scenario):
    t = COEFFICIENTS[scenario]
    shock = lambda a: f"coalesce(sum(CASE WHEN axis = '{a}' THEN raw * {t[a][0]}::DOUBLE END), 0.0::DOUBLE)"
    lift = lambda v, a: r(f"exp(greatest({t[a][1]}::DOUBLE, least({t[a][2]}::DOUBLE, {v})))", 6)
    demand = f"({shock('REVENUE_DEMAND')} - {shock('COMPETITION')} - abs({shock('UNCERTAINTY')}))"
    return f"""SELECT store_id, month, '{scenario}' AS scenario, {lift(demand, 'REVENUE_DEMAND')} AS revenue_multiplier,
  {lift(shock('INGREDIENT_COST'), 'INGREDIENT_COST')} * {lift(shock('PLATFORM_COST'), 'PLATFORM_COST')} AS variable_cost_multiplier,
  {lift(shock('OPERATING_COST'), 'OPERATING_COST')} AS fixed_cost_multiplier, greatest(0.0::DOUBLE, {shock('INTEREST_COST')}) AS rate_delta, count(event_id) AS signal_count
FROM (SELECT s.store_id, m.month, g.event_id, g.axis, g.raw FROM stores s CROSS JOIN months m LEFT JOIN signals g ON g.store_id = s.store_id AND g.month = m.month) GROUP BY store_id, month"""


cte("adjusted", " UNION ALL ".join(_adjust_sql(s) for s in COEFFICIENTS) + """ UNION ALL
SELECT s.store_id, m.month, 'BASELINE', 1.0::DOUBLE, 1.0::DOUBLE, 1.0::DOUBLE, 0.0::DOUBLE, count(g.event_id) FROM stores s CROSS JOIN months m LEFT JOIN signals g ON g.store_id = s.store_id AND g.month = m.month GROUP BY 1, 2""",
    "stores", "months", "signals")
MULTIPLIERS = ["revenue_multiplier", "variable_cost_multiplier", "fixed_cost_multiplier", "rate_delta"]


def adjusted(spark, sf):
    scaffold = month_scaffold(b.stores(spark, sf).select("store_id"), b.start(), F.lit(b.HORIZON)).drop("month_index")
    return sg.scenario_adjustments(sg.dedupe_causes(raw_signals(spark, sf)), scaffold)


@query("scenario_adjustments", sql(f"SELECT store_id, scenario, strftime(month, '%Y-%m') AS month, signal_count, {', '.join(r(c, 8) + ' AS ' + c for c in MULTIPLIERS)} FROM adjusted", "adjusted"))
def scenario_adjustments(spark, sf):
    return adjusted(spark, sf).select("store_id", "scenario", month_name(F.col("month")).alias("month"), "signal_count", *[rnd(F.col(c), 8).alias(c) for c in MULTIPLIERS])


@query("mean_adjustment", sql(f"SELECT store_id, scenario, CAST(sum(signal_count) AS BIGINT) AS signal_count, {', '.join(r(f'avg({c})', 7) + ' AS ' + c for c in MULTIPLIERS)} FROM adjusted GROUP BY 1, 2", "adjusted"))
def mean_adjustment(spark, sf):
    return sg.mean_adjustment(adjusted(spark, sf)).select("store_id", "scenario", "signal_count", *[rnd(F.col(c), 7).alias(c) for c in MULTIPLIERS])


@query("signal_multiplier", sql(f"""
SELECT store_id, axis, {r('exp(greatest(-0.30::DOUBLE, least(0.30::DOUBLE, sum(raw * -0.05::DOUBLE))))', 4)} AS multiplier FROM signals GROUP BY store_id, axis""", "signals"))
def signal_multiplier(spark, sf):
    return sg.signal_multiplier(sg.dedupe_causes(raw_signals(spark, sf)), ["store_id", "axis"])


# ---- duplicates and lifecycles -------------------------------------------------------------

@query("dedupe_events", sql("""
SELECT substr(sha256(family || '|' || event_type || '|' || strftime(start_date, '%Y-%m') || '|' || place_id % 50), 1, 24) AS fingerprint, min(event_id) AS event_id, count(*) AS independent_source_count FROM notices GROUP BY 1""", "notices"))
def dedupe_events(spark, sf):
    n = b.notices(spark, sf).withColumn("fingerprint", ev.event_fingerprint(F.col("family"), F.col("event_type"), month_name(F.col("start_date")), F.col("place_id") % 50))
    return ev.deduplicate(n.select("fingerprint", "event_id", "event_type"), ["event_id"]).select("fingerprint", "event_id", "independent_source_count")


cte("reports", """
SELECT *, row_number() OVER (PARTITION BY fingerprint ORDER BY event_id) AS rn FROM (
  SELECT event_id, substr(sha256(event_type || '|' || year(start_date) || '|' || place_id % 10), 1, 24) AS fingerprint, date_trunc('quarter', start_date) AS place,
    CASE WHEN source_tier IN ('OFFICIAL_PRIMARY', 'OFFICIAL_LOCAL_GOV') THEN 5 WHEN source_tier IN ('OFFICIAL_SECONDARY', 'FINANCIAL_INSTITUTION') THEN 4 WHEN source_tier = 'MAJOR_NEWS' THEN 2 ELSE 0 END AS rank, event_type = 'BASE_RATE_INCREASE' AND event_id % 2 = 0 AS exempt
  FROM notices)""", "notices")
cte("reports_sched", """
SELECT fingerprint, rn, event_id, event_id AS base, place, rank, exempt, CAST(NULL AS BIGINT) AS met, false AS same FROM reports WHERE rn = 1
UNION ALL
SELECT fingerprint, rn, event_id, CASE WHEN takes THEN event_id ELSE base END, CASE WHEN takes THEN p2 ELSE place END, CASE WHEN takes THEN r2 ELSE rank END, CASE WHEN takes THEN x2 ELSE exempt END,
  CASE WHEN takes THEN NULL ELSE base END, same2 FROM (
  SELECT f.fingerprint, e.rn, e.event_id, f.base, f.place, f.rank, f.exempt, e.place AS p2, e.rank AS r2, e.exempt AS x2, f.place = e.place OR f.exempt AND e.exempt AS same2, NOT same2 AND e.rank > f.rank AS takes
  FROM reports_sched f JOIN reports e ON e.fingerprint = f.fingerprint AND e.rn = f.rn + 1)""", "reports")


@query("reconcile_events", sql("""
SELECT event_id, fingerprint, CASE WHEN met IS NULL THEN final ELSE met END AS base_id,
  CASE WHEN met IS NULL THEN CASE WHEN event_id <> final THEN 'REFERENCE_ONLY' WHEN contest THEN 'CONFLICTED' ELSE 'ACCEPTED' END WHEN NOT same AND mine = held THEN 'CONFLICTED' ELSE 'REFERENCE_ONLY' END AS status,
  CASE WHEN met IS NULL THEN CASE WHEN event_id <> final OR contest THEN 'SOURCE_CONFLICT' END WHEN same THEN 'DUPLICATE_EVENT' ELSE 'SOURCE_CONFLICT' END AS code,
  CASE WHEN met IS NULL AND event_id = final THEN merged END AS merged_reports
FROM (SELECT s.*, t.final, e.rank AS mine, s.rank AS held,
    coalesce(bool_or(s.met = t.final AND NOT s.same AND e.rank = s.rank) OVER (PARTITION BY s.fingerprint), false) AS contest,
    1 + count(CASE WHEN s.met = t.final AND s.same THEN 1 END) OVER (PARTITION BY s.fingerprint) AS merged
  FROM reports_sched s JOIN (SELECT fingerprint, max_by(base, rn) AS final FROM reports_sched GROUP BY 1) t USING (fingerprint) JOIN reports e USING (event_id))""", "reports", "reports_sched"))
def reconcile_events(spark, sf):
    n = b.notices(spark, sf)
    rows = n.select(
        "event_id", ev.event_fingerprint(F.col("event_type"), F.year("start_date"), F.col("place_id") % 10).alias("fingerprint"),
        F.trunc("start_date", "quarter").alias("start_date"), F.lit(None).cast("date").alias("end_date"), F.lit("place").alias("address"), "source_tier",
        ((F.col("event_type") == "BASE_RATE_INCREASE") & (F.col("event_id") % 2 == 0)).alias("exempt"))
    return ev.reconcile(rows)


cte("life_days", "SELECT place_id % 20 AS place, start_date, min(event_id) AS first_id FROM notices GROUP BY 1, 2", "notices")
cte("life_next", "SELECT *, lead(start_date) OVER (PARTITION BY place ORDER BY start_date) AS later_start, lead(first_id) OVER (PARTITION BY place ORDER BY start_date) AS later_id FROM life_days", "life_days")
cte("life", """
SELECT n.place_id % 20 AS place, n.event_id, n.start_date, n.end_date, l.later_start, l.later_id, c.event_id AS current_id FROM notices n JOIN life_next l ON l.place = n.place_id % 20 AND l.start_date = n.start_date
LEFT JOIN (SELECT place_id % 20 AS place, max_by(event_id, (start_date, event_id)) AS event_id FROM notices WHERE start_date <= DATE '2001-06-30' GROUP BY 1) c ON c.place = n.place_id % 20""", "notices", "life_next")


def lifecycle(spark, sf):
    n = b.notices(spark, sf).select((F.col("place_id") % 20).alias("place"), "event_id", "start_date", "end_date")
    return ev.decision_lifecycle(n, ["place"], F.lit("2001-06-30").cast("date"))


@query("supersede_chain", sql("SELECT event_id, place, CASE WHEN event_id IS DISTINCT FROM current_id THEN later_id END AS superseded_by FROM life", "life"))
def supersede_chain(spark, sf):
    return lifecycle(spark, sf).select("event_id", "place", "superseded_by")


@query("decision_lifecycle", sql("""
SELECT event_id, place, CASE WHEN event_id = current_id THEN 'CURRENT_OFFICIAL_DECISION' WHEN later_id IS NOT NULL THEN 'SUPERSEDED_BY_LATER_DECISION' ELSE 'FUTURE_OFFICIAL_DECISION' END AS lifecycle_status,
  strftime(CASE WHEN event_id IS DISTINCT FROM current_id AND later_id IS NOT NULL THEN later_start - 1 ELSE end_date END, '%Y-%m-%d') AS end_date,
  CASE WHEN event_id IS DISTINCT FROM current_id THEN later_id END AS superseded_by, event_id IS NOT DISTINCT FROM current_id AS signal_enabled, CASE WHEN event_id IS NOT DISTINCT FROM current_id THEN NULL WHEN later_id IS NOT NULL THEN 'SUPERSEDED' ELSE 'NOT_EFFECTIVE_YET' END AS signal_reason FROM life""", "life"))
def decision_lifecycle(spark, sf):
    return lifecycle(spark, sf).select("event_id", "place", "lifecycle_status", day_name(F.col("end_date")).alias("end_date"), "superseded_by", "signal_enabled", "signal_reason")


cte("signal_counts", "SELECT event_id, count(*) AS signals, count(*) FILTER (raw <> 0) AS nonzero FROM raw_signals GROUP BY event_id", "raw_signals")


@query("event_lifecycle", sql(f"""
SELECT v.event_id, CASE WHEN status <> 'ACCEPTED' THEN CASE WHEN list_contains(found, 'OUTSIDE_SEARCH_RADIUS') THEN 'EXCLUDED_BY_DISTANCE' ELSE status END
    WHEN NOT on_ THEN 'VALIDATED_REFERENCE_ONLY' WHEN coalesce(c.signals, 0) = 0 THEN 'INSTANCE_ELIGIBLE' WHEN c.nonzero > 0 THEN 'FINANCIALLY_APPLIED' ELSE 'SIGNAL_GENERATED' END AS terminal_status,
  CASE WHEN status <> 'ACCEPTED' THEN CASE WHEN list_contains(found, 'OUTSIDE_SEARCH_RADIUS') THEN 'OUTSIDE_SEARCH_RADIUS' ELSE list_sort(list_distinct(found))[1] END
    WHEN NOT on_ THEN 'SIGNAL_DISABLED_EVENT_TYPE' WHEN c.signals > 0 AND c.nonzero = 0 THEN CASE WHEN v.axis = 'INTEREST_COST' AND NOT d.variable_debt THEN 'NO_VARIABLE_RATE_DEBT_EXPOSURE' ELSE 'RELEVANT' END END AS primary_exclusion_reason
FROM (SELECT x.*, x.signal_enabled AND NOT k.covered AS on_ FROM validated x JOIN (SELECT event_id, covered FROM caused) k USING (event_id)) v LEFT JOIN signal_counts c USING (event_id) JOIN variable_debt d USING (store_id)""",
                              "validated", "caused", "signal_counts", "variable_debt"))
def event_lifecycle(spark, sf):
    counts = raw_signals(spark, sf).groupBy("event_id").agg(F.count("*").alias("signals"), F.count_if(F.col("raw") != 0).alias("nonzero"))
    on = caused(spark, sf).select("event_id", F.col("signal_enabled").alias("on_"))
    rows = validated(spark, sf).drop("signal_enabled").join(on, "event_id").join(counts, "event_id", "left").join(b.signal_stores(spark, sf).select("store_id", "variable_debt"), "store_id")
    rows = rows.withColumns({"signal_enabled": F.col("on_"), "signals": F.coalesce("signals", F.lit(0)), "nonzero": F.coalesce("nonzero", F.lit(0)),
                             "interest_only": F.forall("impacts", lambda i: i["axis"] == "INTEREST_COST")})
    return ev.event_lifecycle(rows).select("event_id", "terminal_status", "primary_exclusion_reason")


@query("no_signal_reasons", sql(f"""
SELECT run_id, array_to_string(list_sort(list_distinct(list(code))), ',') AS reason_codes FROM (
  SELECT DISTINCT store_id AS run_id, unnest(found || CASE WHEN NOT signal_enabled THEN ['SIGNAL_DISABLED_EVENT_TYPE'] ELSE [] END) AS code FROM validated WHERE status <> 'ACCEPTED'
  UNION SELECT store_id, 'NO_VALIDATED_SIGNAL_ELIGIBLE_EVENT' FROM stores UNION SELECT store_id, 'SOURCE_ACCESS_FAILURES' FROM stores WHERE store_id % 4 > 0) GROUP BY run_id""", "validated", "stores"))
def no_signal_reasons(spark, sf):
    rejected = validated(spark, sf).filter(F.col("status") != "ACCEPTED").select(F.col("store_id").alias("run_id"), "failure_codes", "signal_enabled")
    runs = b.stores(spark, sf).select(F.col("store_id").alias("run_id"), (F.col("store_id") % 4).alias("access_failures"))
    return ev.no_signal_reasons(rejected, runs)


@query("lifecycle_invariants", sql("""
SELECT c.store_id AS run_id, count(*) FILTER (v.event_id % 97 = 0) AS unresolved, 0 AS unknown, count(*) FILTER (v.event_id % 101 = 0 AND v.event_id % 97 <> 0) AS resolved_twice,
  count(*) FILTER (v.event_id % 101 = 0 AND v.event_id % 97 <> 0 AND v.status = 'ACCEPTED') AS accepted_and_rejected, count(*) FILTER (v.status = 'ACCEPTED' AND v.event_id % 97 <> 0) AS accepted, count(*) AS candidates
FROM candidates c JOIN validated v USING (event_id) GROUP BY c.store_id""", "candidates", "validated"))
def lifecycle_invariants(spark, sf):
    v = validated(spark, sf).select("store_id", "event_id", "status")
    kept = v.filter(F.col("event_id") % 97 != 0)
    again = kept.filter(F.col("event_id") % 101 == 0).withColumn("status", F.lit("REJECTED"))
    out = rs.lifecycle_invariants(v.select("store_id", "event_id"), kept.unionByName(again), "event_id", "store_id")
    return out.withColumnRenamed("store_id", "run_id")

