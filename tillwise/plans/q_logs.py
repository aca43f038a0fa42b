"""Logs, ids, traces, places."""

from __future__ import annotations

from pyspark.sql import functions as F

from tillwise.functions.core import rnd, stable_id
from tillwise.functions.places import industry_codes, industry_relevance, signal_relevance
from tillwise.functions.text import organisation_id
from tillwise.operators import metrics as mt
from tillwise.operators import places as pl
from tillwise.operators import results as rs
from tillwise.operators.signals import severity_v1
from tillwise.plans import bindings as b
from tillwise.plans.catalog import cte, query, r, sql
from tillwise.plans.q_events import hav

CENTS = "CAST(floor(value * 100.0::DOUBLE + 0.5::DOUBLE) AS BIGINT)"


@query("usage_summary", sql(f"""
SELECT user_id % 10 AS run_id, event_type AS agent, count(*) AS model_call_count, count(DISTINCT event_id % 500) AS query_count, count(DISTINCT event_id % 200) AS document_count,
  CAST(sum({CENTS}) AS BIGINT) AS input_tokens, CAST(sum({CENTS} % 97) AS BIGINT) AS output_tokens, CAST(sum({CENTS} // 10) AS BIGINT) AS total_latency_ms,
  string_agg(DISTINCT 'P' || event_id % 3, ',' ORDER BY 'P' || event_id % 3) AS providers, string_agg(DISTINCT 'M' || event_id % 4, ',' ORDER BY 'M' || event_id % 4) AS models
FROM events GROUP BY 1, 2"""))
def usage_summary(spark, sf):
    k, c = F.col("event_id"), b.cents("value")
    log = b.table(spark, sf, "events").select(
        (F.col("user_id") % 10).alias("run_id"), F.col("event_type").alias("agent"), (k % 500).alias("query_id"), (k % 200).alias("document_id"),
        c.alias("tokens_in"), (c % 97).alias("tokens_out"), F.floor(c / 10).alias("latency_ms"),
        F.concat(F.lit("P"), (k % 3).cast("string")).alias("provider"), F.concat(F.lit("M"), (k % 4).cast("string")).alias("model"))
    return mt.usage_summary(log, ["run_id", "agent"])


RATES = {"user": (0.3, 2.5, 0.03), "assistant": (0.0, 0.0, 0.0)}


@query("token_cost", sql(f"""
SELECT conv_id, turn, role AS model, CASE role WHEN 'user' THEN 'ESTIMATED' WHEN 'assistant' THEN 'RATE_NOT_CONFIGURED' ELSE 'MODEL_RATE_NOT_CONFIGURED' END AS cost_status,
  CASE WHEN role = 'user' THEN {r('((n - n // 10) * 0.3::DOUBLE + (n // 4) * 2.5::DOUBLE + (n // 10) * 0.03::DOUBLE) / 1e6::DOUBLE', 8)} END AS cost_usd
FROM (SELECT *, length(text) // 4 AS n FROM conversations)"""))
def token_cost(spark, sf):
    n = F.floor(F.length("text") / 4)
    log = b.table(spark, sf, "conversations").select("conv_id", "turn", F.col("role").alias("model"), n.alias("input_tokens"),
                                                     F.floor(n / 4).alias("output_tokens"), F.floor(n / 10).alias("cached_tokens"))
    return mt.token_cost(log, RATES).select("conv_id", "turn", "model", "cost_status", "cost_usd")


@query("latency_percentiles", sql("""
SELECT event_type, len(v) AS sample_count, v[1 + CAST(floor((len(v) - 1) * 0.5::DOUBLE) AS INTEGER)] AS p50, v[1 + CAST(floor((len(v) - 1) * 0.95::DOUBLE) AS INTEGER)] AS p95
FROM (SELECT event_type, list_sort(list(value)) AS v FROM events GROUP BY event_type)"""))
def latency_percentiles(spark, sf):
    return mt.latency_percentiles(b.table(spark, sf, "events").select("event_type", "value"), "event_type")


@query("timeout_counts", sql("""
SELECT code, count(*) AS timeout_count FROM (SELECT user_id, min_by(CASE WHEN event_id % 2 = 0 THEN 'DOCUMENT_FETCH_TIMEOUT' ELSE 'ATTACHMENT_FETCH_TIMEOUT' END, event_id) AS code
FROM events WHERE event_type = 'error' GROUP BY user_id) GROUP BY code"""))
def timeout_counts(spark, sf):
    k = F.col("event_id")
    code = F.when(F.col("event_type") != "error", "OK").when(k % 2 == 0, "DOCUMENT_FETCH_TIMEOUT").otherwise("ATTACHMENT_FETCH_TIMEOUT")
    rows = b.table(spark, sf, "events").select(F.col("user_id").alias("source_id"), k.alias("event_id"), F.array(F.lit("SEEN"), code).alias("reason_codes"))
    return mt.timeout_counts(rows, ["event_id"])


@query("sliding_rate_flags", sql("""
SELECT event_id, user_id, c AS window_count, c > 1 AS over_limit FROM (SELECT *, count(*) OVER (PARTITION BY user_id ORDER BY epoch_us(ts) RANGE BETWEEN 3599999999 PRECEDING AND CURRENT ROW) AS c FROM events)"""))
def sliding_rate_flags(spark, sf):
    rows = b.table(spark, sf, "events").select("event_id", "user_id", "ts")
    return mt.sliding_counts(rows, "user_id", "ts", 3600, 1).drop("ts")


@query("candidate_state", sql("SELECT user_id AS candidate_id, max_by(event_type, (ts, event_id)) AS state, count(*) AS transitions FROM events GROUP BY user_id"))
def candidate_state(spark, sf):
    rows = b.table(spark, sf, "events").select(F.col("user_id").alias("candidate_id"), F.col("event_type").alias("to_state"), "ts", "event_id")
    return mt.current_state(rows, "candidate_id", ["ts", "event_id"])


@query("run_timeouts", sql("""
SELECT user_id, day, elapsed_seconds, last_state, CASE WHEN last_state IN ('purchase', 'signup') THEN 'FINISHED' WHEN elapsed_seconds > 1800 THEN 'ANALYSIS_JOB_TIMEOUT' ELSE 'RUNNING' END AS status
FROM (SELECT user_id, strftime(ts, '%Y-%m-%d') AS day, CAST(floor(epoch(max(ts))) AS BIGINT) - CAST(floor(epoch(min(ts))) AS BIGINT) AS elapsed_seconds, max_by(event_type, (ts, event_id)) AS last_state FROM events GROUP BY 1, 2)"""))
def run_timeouts(spark, sf):
    rows = b.table(spark, sf, "events").select("user_id", F.date_format("ts", "yyyy-MM-dd").alias("day"), "ts", "event_id", F.col("event_type").alias("to_state"))
    return mt.run_deadlines(rows, ["user_id", "day"], 1800, ["purchase", "signup"])


@query("candidate_evidence_view", sql("""
SELECT c.candidate_id, coalesce(s.st, 'EXTRACTED') AS validation_status, coalesce(s.codes, '') AS failure_codes, coalesce(d.n, 0) AS source_count, d.first_source
FROM (SELECT DISTINCT user_id AS candidate_id FROM events) c
LEFT JOIN (SELECT user_id AS candidate_id, max_by(event_type, (ts, event_id)) AS st, string_agg(DISTINCT CASE WHEN event_type = 'error' THEN 'CODE_' || event_id % 5 END, ',' ORDER BY CASE WHEN event_type = 'error' THEN 'CODE_' || event_id % 5 END) AS codes
  FROM events GROUP BY 1) s USING (candidate_id)
LEFT JOIN (SELECT candidate_id, count(*) AS n, min(source) AS first_source FROM (SELECT DISTINCT user_id AS candidate_id, event_id % (SELECT count(*) FROM documents) AS doc_id FROM events) JOIN documents USING (doc_id) GROUP BY 1) d USING (candidate_id)"""))
def candidate_evidence_view(spark, sf):
    e = b.table(spark, sf, "events").withColumn("candidate_id", F.col("user_id"))
    code = F.when(F.col("event_type") == "error", F.concat(F.lit("CODE_"), (F.col("event_id") % 5).cast("string")))
    log = e.select("candidate_id", F.col("event_type").alias("to_state"), "ts", "event_id", code.alias("failure_code"))
    return mt.candidate_view(e.select("candidate_id").distinct(), log, e.select("candidate_id", (F.col("event_id") % b.table(spark, sf, "documents").agg(F.count("*")).scalar()).alias("doc_id")), b.table(spark, sf, "documents"))


# ---- ids and traces ------------------------------------------------------------------------

@query("citation_check", sql("""
SELECT run_id, statement_id, id FROM (SELECT o_custkey AS run_id, o_orderkey AS statement_id, unnest([o_orderkey % 50, o_orderkey % 77]) AS id FROM orders) s
WHERE NOT EXISTS (SELECT 1 FROM orders t WHERE t.o_custkey = s.run_id AND t.o_orderkey % 50 = s.id)"""))
def citation_check(spark, sf):
    k = F.col("o_orderkey")
    o = b.table(spark, sf, "orders").select(F.col("o_custkey").alias("run_id"), k.alias("statement_id"), F.array(k % 50, k % 77).alias("citation_ids"), (k % 50).alias("id"))
    return rs.citation_gaps(o.select("run_id", "statement_id", "citation_ids"), o.select("run_id", "id").distinct(), ["run_id"])


@query("trace_manifest", sql("""
SELECT run_id, kind, id, count(*) OVER (PARTITION BY run_id, kind) AS id_count FROM (
  SELECT DISTINCT o_custkey AS run_id, CASE o_orderkey % 3 WHEN 0 THEN 'EVENT' WHEN 1 THEN 'SOURCE' ELSE 'POLICY' END AS kind, CAST(o_orderkey % 40 AS VARCHAR) AS id FROM orders)"""))
def trace_manifest(spark, sf):
    k = F.col("o_orderkey")
    ids = b.table(spark, sf, "orders").select(F.col("o_custkey").alias("run_id"), F.when(k % 3 == 0, "EVENT").when(k % 3 == 1, "SOURCE").otherwise("POLICY").alias("kind"), (k % 40).alias("id"))
    return rs.trace_manifest(ids, ["run_id"])


@query("stable_ids", sql("""
SELECT o_orderkey, 'OBS-' || upper(substr(sha256(o_orderkey || '|' || o_custkey), 1, 24)) AS observation_id, 'EVT-' || upper(substr(sha256(o_orderstatus || '|' || strftime(o_orderdate, '%Y-%m-%d')), 1, 20)) AS event_id,
  'POL-' || upper(substr(sha256(o_orderpriority || '|' || o_custkey), 1, 24)) AS policy_id, CASE o_orderkey % 4 WHEN 0 THEN 1.0::DOUBLE WHEN 1 THEN 0.7::DOUBLE WHEN 2 THEN 0.4::DOUBLE ELSE 0.5::DOUBLE END AS severity FROM orders"""))
def stable_ids(spark, sf):
    k = F.col("o_orderkey")
    kind = F.when(k % 4 == 0, "PEDESTRIAN_FULL_CLOSURE").when(k % 4 == 1, "PEDESTRIAN_PARTIAL_CLOSURE").when(k % 4 == 2, "VEHICLE_ONLY_RESTRICTION").otherwise("ANYTHING")
    return b.table(spark, sf, "orders").select(
        "o_orderkey", stable_id("OBS-", 24, k, F.col("o_custkey")).alias("observation_id"),
        stable_id("EVT-", 20, F.col("o_orderstatus"), F.date_format("o_orderdate", "yyyy-MM-dd")).alias("event_id"),
        stable_id("POL-", 24, F.col("o_orderpriority"), F.col("o_custkey")).alias("policy_id"), severity_v1(kind).alias("severity"))


@query("org_ids", sql("""
SELECT k, CASE WHEN t = '' THEN NULL WHEN k % 5 < 3 THEN 'ORG-BOK' ELSE 'ORG-' || upper(substr(sha256(t), 1, 12)) END AS org_id,
  CASE WHEN t = '' THEN 'ORGANIZATION_EMPTY_V1' WHEN k % 5 IN (0, 2) THEN 'ORGANIZATION_ALIAS_V1' WHEN k % 5 = 1 THEN 'ORGANIZATION_BANK_OF_KOREA_ALIAS_V1' ELSE 'ORGANIZATION_STABLE_HASH_V1' END AS rule
FROM (SELECT o_orderkey AS k, CASE o_orderkey % 5 WHEN 0 THEN 'Bank of Korea' WHEN 1 THEN 'B.O.K.' WHEN 2 THEN '한국은행' WHEN 3 THEN '' ELSE 'Clerk ' || o_custkey END AS t FROM orders)"""))
def org_ids(spark, sf):
    k = F.col("o_orderkey")
    name = F.when(k % 5 == 0, "Bank  of Korea ").when(k % 5 == 1, "b.O.K.").when(k % 5 == 2, "한국은행").when(k % 5 == 3, " ").otherwise(F.concat(F.lit("Clerk  "), F.col("o_custkey").cast("string")))
    return b.table(spark, sf, "orders").select(k.alias("k"), organisation_id(name).alias("o")).select("k", "o.*")


@query("industry_relevance", sql("""
SELECT o_orderkey AS k, CASE o_orderkey % 4 WHEN 0 THEN 'FNB,FNB_CAFE' WHEN 1 THEN 'FNB,FNB_CAFE,FNB_RESTAURANT' WHEN 2 THEN 'FNB' ELSE '' END AS codes,
  CASE WHEN o_orderkey % 4 = 3 THEN 1.0::DOUBLE WHEN o_custkey % 3 = 0 AND o_orderkey % 4 < 2 THEN 1.0::DOUBLE WHEN o_custkey % 3 < 2 THEN 0.7::DOUBLE ELSE 0.0::DOUBLE END AS relevance,
  CASE WHEN o_custkey % 3 = 0 AND o_orderkey % 4 < 2 THEN 1.0::DOUBLE WHEN o_custkey % 3 < 2 AND o_orderkey % 4 < 3 THEN 0.7::DOUBLE ELSE 0.3::DOUBLE END AS signal_relevance FROM orders"""))
def industry_relevance_query(spark, sf):
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    raw = F.when(k % 4 == 0, F.array(F.lit("동네 카페"))).when(k % 4 == 1, F.array(F.lit("커피"), F.lit("분식 식당"))).when(k % 4 == 2, F.array(F.lit("all fnb shops"))).otherwise(F.array(F.lit("metal works")))
    code = F.when(c % 3 == 0, "FNB_CAFE").when(c % 3 == 1, "FNB_BAKERY").otherwise("RETAIL")
    rows = b.table(spark, sf, "orders").select(k.alias("k"), code.alias("code"), industry_codes(raw).alias("found"))
    return rows.select("k", F.array_join("found", ",").alias("codes"), industry_relevance(F.col("code"), F.col("found")).alias("relevance"), signal_relevance(F.col("code"), F.col("found")).alias("signal_relevance"))


_ROW_JSON = """'{"o_orderkey":' || o_orderkey || ',"o_orderpriority":"' || o_orderpriority || '","o_orderstatus":"' || o_orderstatus || '","o_totalprice":' || o_totalprice || '}'"""
_WORDS = ", ".join(f"sum(('0x' || substr(h, {1 + 12 * i}, 12))::UBIGINT)::VARCHAR AS w{i}" for i in range(5))


@query("result_hash", sql(f"""
SELECT run_id, row_count, sha256(concat_ws('|', row_count::VARCHAR, w0, w1, w2, w3, w4)) AS result_hash
FROM (SELECT run_id, count(*) AS row_count, {_WORDS} FROM (SELECT o_custkey AS run_id, sha256({_ROW_JSON}) AS h FROM orders) GROUP BY 1)"""))
def result_hash(spark, sf):
    return rs.result_hash(b.table(spark, sf, "orders").withColumnRenamed("o_custkey", "run_id"), ["run_id"], ["o_orderdate"])


# ---- places --------------------------------------------------------------------------------

cte("responses", f"""
SELECT f.store_id AS query_id, c.c_custkey AS place_id, 'HOUSEHOLD Plaza ' || (100 + f.store_id % 40) AS query, 'District ' || (10 + f.store_id % 7) AS area, c.c_mktsegment || ' Plaza ' || (100 + c.c_custkey % 40) AS place_name,
  'Road ' || c.c_nationkey || ' District ' || (10 + c.c_custkey % 7) AS address, CASE c.c_mktsegment WHEN 'FURNITURE' THEN 'shopping' WHEN 'HOUSEHOLD' THEN 'public' WHEN 'MACHINERY' THEN 'park' WHEN 'BUILDING' THEN 'office' ELSE 'cafe' END AS category,
  37.45::DOUBLE + (c.c_custkey % 1000) / 10000.0::DOUBLE AS lat, 126.95::DOUBLE + ((c.c_custkey * 7) % 1000) / 10000.0::DOUBLE AS lon, s.lat AS s_lat, s.lon AS s_lon
FROM (SELECT DISTINCT store_id, place_id FROM found_by JOIN notices USING (event_id)) f JOIN customer c ON c.c_custkey = f.place_id JOIN stores s USING (store_id)""", "found_by", "notices", "stores")
cte("venue_scores", f"""
SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, distance_m, place_id) AS rn FROM (
  SELECT *, overlap * 12.0::DOUBLE + 0.0::DOUBLE + CASE WHEN contains(t, lower(area)) THEN 30.0::DOUBLE ELSE 0.0::DOUBLE END + CASE WHEN category IN ('public', 'park') THEN 8.0::DOUBLE ELSE 0.0::DOUBLE END + greatest(0.0::DOUBLE, 6.0::DOUBLE - distance_m / 1000.0::DOUBLE) AS score
  FROM (SELECT *, contains(t, 'household')::INT + contains(t, 'plaza')::INT + contains(t, CAST(100 + query_id % 40 AS VARCHAR))::INT AS overlap, {hav('s_lat', 's_lon', 'lat', 'lon')} AS distance_m
    FROM (SELECT *, lower(address || ' ' || place_name || ' ' || category) AS t FROM responses)) WHERE category NOT IN ('shopping', 'cafe') AND overlap > 0)""", "responses")
cte("venue_best", """
SELECT q.query_id, CASE WHEN a.score IS NULL THEN 'NOT_FOUND' WHEN b.score IS NOT NULL AND a.score - b.score < 2 THEN 'AMBIGUOUS' ELSE 'SUCCESS' END AS status, a.place_id, a.score, a.distance_m
FROM (SELECT DISTINCT query_id FROM responses) q LEFT JOIN venue_scores a ON a.query_id = q.query_id AND a.rn = 1 LEFT JOIN venue_scores b ON b.query_id = q.query_id AND b.rn = 2""", "responses", "venue_scores")


def responses(spark, sf):
    pairs = b.found_by(spark, sf).join(b.notices(spark, sf).select("event_id", "place_id"), "event_id").select("store_id", "place_id").distinct()
    c = b.table(spark, sf, "customer")
    k, q = F.col("c_custkey"), F.col("store_id")
    text = lambda x: x.cast("string")
    rows = pairs.join(c, F.col("place_id") == k).join(b.stores(spark, sf).select("store_id", F.col("lat").alias("store_lat"), F.col("lon").alias("store_lon")), "store_id")
    seg = F.col("c_mktsegment")
    return rows.select(
        q.alias("query_id"), "place_id", F.concat(F.lit("HOUSEHOLD Plaza "), text(100 + q % 40)).alias("query"), F.concat(F.lit("District "), text(10 + q % 7)).alias("area"),
        F.concat(seg, F.lit(" Plaza "), text(100 + k % 40)).alias("place_name"), F.concat(F.lit("Road "), text(F.col("c_nationkey")), F.lit(" District "), text(10 + k % 7)).alias("address"),
        F.when(seg == "FURNITURE", "shopping").when(seg == "HOUSEHOLD", "public").when(seg == "MACHINERY", "park").when(seg == "BUILDING", "office").otherwise("cafe").alias("category"),
        (37.45 + (k % 1000) / 10000.0).alias("lat"), (126.95 + ((k * 7) % 1000) / 10000.0).alias("lon"), "store_lat", "store_lon", F.lit("").alias("context"))


@query("gazetteer_match", sql(f"""
SELECT query_id, status, CASE WHEN status = 'SUCCESS' THEN place_id END AS place_id, CASE WHEN status = 'SUCCESS' THEN {r('score', 6)} END AS score FROM venue_best""", "venue_best"))
def gazetteer_match(spark, sf):
    return pl.match_venues(responses(spark, sf)).select("query_id", "status", "place_id", rnd(F.col("score"), 6).alias("score"))


# stores ask for lots, named plazas, unknown names with and without an area, and names whose search or address failed
_GAZ = """SELECT c_custkey AS place_id, c_mktsegment || ' Plaza ' || (100 + c_custkey % 40) AS place_name, 'Road ' || c_nationkey || ' District ' || (10 + c_custkey % 7) AS address, 'Lot ' || (c_custkey - c_custkey % 10) || '-' || least(c_custkey % 10, 8) AS lot_address,
  CASE c_mktsegment WHEN 'FURNITURE' THEN 'shopping' WHEN 'HOUSEHOLD' THEN 'public' WHEN 'MACHINERY' THEN 'park' WHEN 'BUILDING' THEN 'office' ELSE 'cafe' END AS category,
  CASE WHEN c_custkey % 50 = 3 THEN 97.0::DOUBLE ELSE 37.45::DOUBLE + (c_custkey % 1000) / 10000.0::DOUBLE END AS lat, 126.95::DOUBLE + ((c_custkey * 7) % 1000) / 10000.0::DOUBLE AS lon FROM customer"""
cte("gazetteer", _GAZ)
cte("place_requests", """
SELECT store_id AS query_id, lat AS s_lat, lon AS s_lon, store_id % 9 AS kind, CASE store_id % 9 WHEN 0 THEN 'Lot ' || (k - k % 10) || '-' || k % 10 WHEN 1 THEN 'BUILDING Plaza ' || (100 + k % 40) WHEN 2 THEN 'Nowhere Xyz' WHEN 3 THEN 'Nowhere Xyz' WHEN 4 THEN 'Nowhere Xyz'
  WHEN 5 THEN 'Blank Hall, MACHINERY Plaza ' || (100 + k % 40) WHEN 6 THEN ' ' WHEN 7 THEN 'Lot ' || (k - k % 10) || '-' || k % 10 ELSE 'Road 3' END AS address,
  CASE store_id % 9 WHEN 2 THEN 'Lot ' || (k - k % 10) || '-' || k % 10 WHEN 3 THEN 'District 12' END AS area, store_id % 9 <> 3 AS allowed, CASE store_id % 9 WHEN 4 THEN 'KEYWORD' WHEN 7 THEN 'ADDRESS' END AS down
FROM (SELECT *, (store_id * 7) % (SELECT count(*) FROM customer) + 1 AS k FROM stores)""", "stores")
cte("place_searches", """
SELECT query_id, s_lat, s_lon, area, step, text, list_distinct(regexp_extract_all(lower(text), '[0-9a-z]{2,}')) AS words FROM (
  SELECT *, 1 AS step, trim(address) AS text FROM place_requests UNION ALL SELECT *, 2, trim(split_part(address, ',', 1)) FROM place_requests WHERE contains(address, ',')
  UNION ALL SELECT *, 1000, trim(replace(address, ', ', ' ')) FROM place_requests UNION ALL SELECT *, 1001, area FROM place_requests WHERE allowed AND area IS NOT NULL) WHERE trim(address) <> ''""", "place_requests")
cte("place_rarest", """
WITH df AS (SELECT word, count(*) AS n FROM (SELECT place_id, unnest(list_distinct(regexp_extract_all(lower(address || ' ' || place_name || ' ' || category), '[0-9a-z]{2,}'))) AS word FROM gazetteer) GROUP BY 1)
SELECT query_id, step, list(word) AS rarest FROM (SELECT query_id, step, word, n, min(n) OVER (PARTITION BY query_id, step) AS least FROM (SELECT query_id, step, unnest(words) AS word FROM place_searches) JOIN df USING (word)) WHERE n = least GROUP BY 1, 2""", "place_searches", "gazetteer")
cte("place_scores", f"""
SELECT *, row_number() OVER (PARTITION BY query_id, step ORDER BY score DESC, distance_m, place_id) AS rn FROM (
  SELECT *, overlap * 12.0::DOUBLE + CASE WHEN area IS NOT NULL AND contains(t, lower(area)) THEN 30.0::DOUBLE ELSE 0.0::DOUBLE END + CASE WHEN category IN ('public', 'park') THEN 8.0::DOUBLE ELSE 0.0::DOUBLE END + greatest(0.0::DOUBLE, 6.0::DOUBLE - distance_m / 1000.0::DOUBLE) AS score
  FROM (SELECT q.*, g.*, len(list_filter(words, lambda w: contains(t, w))) AS overlap, {hav('s_lat', 's_lon', 'lat', 'lon')} AS distance_m
    FROM place_searches q JOIN place_rarest USING (query_id, step) JOIN (SELECT *, lower(address || ' ' || place_name || ' ' || category) AS t FROM gazetteer) g ON list_has_any(rarest, regexp_extract_all(t, '[0-9a-z]{{2,}}')))
  WHERE category NOT IN ('shopping', 'cafe') AND lat <= 90)""", "place_searches", "gazetteer", "place_rarest")
cte("place_tried", """
SELECT q.query_id, 0 AS step, CASE WHEN r.down = 'ADDRESS' THEN 'PROVIDER_ERROR' WHEN n = 1 AND lat > 90 THEN 'PROVIDER_ERROR' WHEN n = 1 THEN 'SUCCESS' WHEN n > 1 THEN 'AMBIGUOUS' ELSE 'NOT_FOUND' END AS status, place_id, 'EXACT_LOT_ADDRESS' AS match_type,
  CASE WHEN r.down = 'ADDRESS' THEN 'KAKAO_TIMEOUT' WHEN n = 1 AND lat > 90 THEN 'INVALID_COORDINATES' END AS reason
FROM (SELECT DISTINCT query_id FROM place_searches) q JOIN place_requests r USING (query_id) LEFT JOIN (SELECT lot_address, count(*) AS n, min(place_id) AS place_id, min(lat) AS lat FROM gazetteer GROUP BY 1) g ON g.lot_address = trim(r.address)
UNION ALL
SELECT s.query_id, s.step, CASE WHEN r.down = 'KEYWORD' AND s.step <> 1001 THEN 'PROVIDER_ERROR' WHEN a.score IS NULL THEN 'NOT_FOUND' WHEN b.score IS NOT NULL AND a.score - b.score < 2 THEN 'AMBIGUOUS' ELSE 'SUCCESS' END, a.place_id,
  CASE s.step WHEN 1001 THEN 'ADMINISTRATIVE_AREA_FALLBACK' ELSE 'KEYWORD' END, CASE WHEN r.down = 'KEYWORD' AND s.step <> 1001 THEN 'KAKAO_RATE_LIMITED' END
FROM place_searches s JOIN place_requests r USING (query_id) LEFT JOIN place_scores a ON a.query_id = s.query_id AND a.step = s.step AND a.rn = 1 LEFT JOIN place_scores b ON b.query_id = s.query_id AND b.step = s.step AND b.rn = 2""", "place_searches", "place_requests", "gazetteer", "place_scores")


def gazetteer(spark, sf):
    k, seg = F.col("c_custkey"), F.col("c_mktsegment")
    text = lambda x: x.cast("string")
    return b.table(spark, sf, "customer").select(
        k.alias("place_id"), F.concat(seg, F.lit(" Plaza "), text(100 + k % 40)).alias("place_name"), F.concat(F.lit("Road "), text(F.col("c_nationkey")), F.lit(" District "), text(10 + k % 7)).alias("address"),
        F.concat(F.lit("Lot "), text(k - k % 10), F.lit("-"), text(F.least(k % 10, F.lit(8)))).alias("lot_address"),
        F.when(seg == "FURNITURE", "shopping").when(seg == "HOUSEHOLD", "public").when(seg == "MACHINERY", "park").when(seg == "BUILDING", "office").otherwise("cafe").alias("category"),
        F.when(k % 50 == 3, F.lit(97.0)).otherwise(37.45 + (k % 1000) / 10000.0).alias("lat"), (126.95 + ((k * 7) % 1000) / 10000.0).alias("lon"))


def place_requests(spark, sf):
    q = F.col("store_id")
    k = (q * 7) % b.table(spark, sf, "customer").agg(F.count("*")).scalar() + 1
    lot = F.concat(F.lit("Lot "), (k - k % 10).cast("string"), F.lit("-"), (k % 10).cast("string"))
    number = (100 + k % 40).cast("string")
    kind = q % 9
    address = (F.when(kind.isin(0, 7), lot).when(kind == 1, F.concat(F.lit("BUILDING  Plaza "), number)).when(kind.isin(2, 3, 4), "Nowhere Xyz").when(kind == 5, F.concat(F.lit("Blank Hall, MACHINERY Plaza "), number))
               .when(kind == 6, " ").otherwise("Road 3"))
    areas = F.when(kind == 2, F.array(lot)).when(kind == 3, F.array(F.lit("District 12"))).otherwise(F.array().cast("array<string>"))
    return b.stores(spark, sf).select(q.alias("query_id"), address.alias("address"), areas.alias("areas"), F.lit(None).cast("string").alias("context"), F.col("lat").alias("store_lat"), F.col("lon").alias("store_lon"),
                                      (kind != 3).alias("allow_fallback"), F.when(kind == 4, "KEYWORD").when(kind == 7, "ADDRESS").alias("down"))


@query("place_resolution", sql("""
SELECT r.query_id, coalesce(x.status, 'FAILED') AS status, x.step, x.place_id, x.match_type, CASE WHEN x.status IS NULL THEN 'EMPTY_ADDRESS' WHEN x.status = 'PROVIDER_ERROR' THEN x.codes ELSE '' END AS failure_codes
FROM place_requests r LEFT JOIN (
  SELECT query_id, CASE WHEN hit IS NOT NULL THEN 'SUCCESS' WHEN ambiguous THEN 'AMBIGUOUS' WHEN broken THEN 'PROVIDER_ERROR' ELSE 'NOT_FOUND' END AS status, hit.step AS step, hit.place_id AS place_id, hit.match_type AS match_type, codes FROM (
    SELECT query_id, first({'step': step, 'place_id': place_id, 'match_type': match_type} ORDER BY step) FILTER (status = 'SUCCESS') AS hit, bool_or(status = 'AMBIGUOUS') AS ambiguous, bool_or(status = 'PROVIDER_ERROR') AS broken,
      array_to_string(list_sort(list_distinct(list(reason) FILTER (reason IS NOT NULL))), ',') AS codes
    FROM place_tried t WHERE step <> 1001 OR EXISTS (SELECT 1 FROM place_tried p WHERE p.query_id = t.query_id AND p.step = 1000 AND p.status = 'NOT_FOUND') GROUP BY 1)) x USING (query_id)""", "place_requests", "place_tried"))
def place_resolution(spark, sf):
    asked = place_requests(spark, sf)
    reason = F.when(F.col("down") == "ADDRESS", "KAKAO_TIMEOUT").otherwise("KAKAO_RATE_LIMITED")
    outages = asked.where("down is not null").select("query_id", F.col("down").alias("kind"), reason.alias("reason"))
    return pl.resolve_ladder(asked.drop("down"), gazetteer(spark, sf), outages).withColumn("failure_codes", F.array_join("failure_codes", ","))
