"""Policy queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from tillwise.functions.core import day_name, rnd
from tillwise.functions.places import regions_match
from tillwise.functions.stages import staged
from tillwise.operators import ledger as lg
from tillwise.operators import policies as po
from tillwise.plans import bindings as b
from tillwise.plans.catalog import cte, query, r, sql
from tillwise.plans.q_events import present, sorted_codes
from tillwise.plans.q_finance import base_ledger, burn_sql
from tillwise.sources import sinks

_HARD = present(("source_missing", "POLICY_SOURCE_MISSING"), ("set_mismatch", "POLICY_SOURCE_SET_MISMATCH"), ("unavailable", "POLICY_SOURCE_UNAVAILABLE"), ("security", "POLICY_SOURCE_SECURITY_REJECTED"),
                ("untrusted", "POLICY_SOURCE_UNTRUSTED"), ("no_quote", "POLICY_QUOTE_NOT_FOUND"))
cte("policy_state", f"""
SELECT *, CASE WHEN len(hard) > 0 THEN 'REJECTED' WHEN shut THEN 'CLOSED' WHEN ambiguous THEN 'PARTIALLY_VALIDATED' ELSE 'VALIDATED' END AS validation_status,
  CASE WHEN shut THEN 'CLOSED' WHEN fallback THEN 'STATUS_UNCONFIRMED' WHEN budget_status = 'EXHAUSTED' THEN 'BUDGET_EXHAUSTED' WHEN app_start > DATE '2001-08-31' THEN 'SCHEDULED'
    WHEN app_start <= DATE '2001-08-31' AND app_end >= DATE '2001-08-31' THEN 'OPEN' ELSE 'STATUS_UNCONFIRMED' END AS application_status
FROM (SELECT *, {_HARD} AS hard, notice_kind = 'TERMINATION' OR explicitly_closed OR coalesce(app_end < DATE '2001-08-31', false) AS shut FROM policies)""", "policies")


def policies(spark, sf):
    return po.policy_status(b.policies(spark, sf), b.as_of())


@query("policy_status", sql(f"""
SELECT policy_id, application_status, validation_status, {sorted_codes("hard || CASE WHEN ambiguous THEN ['POLICY_NUMERIC_UNIT_AMBIGUOUS'] ELSE [] END")} AS failure_codes, {sorted_codes(present(
    ("application_status = 'CLOSED'", "POLICY_CLOSED"), ("application_status = 'BUDGET_EXHAUSTED'", "POLICY_BUDGET_EXHAUSTED"), ("application_status = 'SCHEDULED'", "POLICY_NOT_YET_OPEN"),
    ("application_status = 'STATUS_UNCONFIRMED'", "POLICY_STATUS_UNCONFIRMED"), ("budget_status = 'UNKNOWN'", "POLICY_BUDGET_UNKNOWN")))} AS recommendation_codes FROM policy_state""", "policy_state"))
def policy_status(spark, sf):
    return policies(spark, sf).select("policy_id", "application_status", "validation_status", F.array_join("failure_codes", ",").alias("failure_codes"), F.array_join("recommendation_codes", ",").alias("recommendation_codes"))


@query("policy_term_evidence", sql("SELECT policy_id, " + "array_to_string(list_sort(list_distinct(" + present(
    ("limit_krw IS NULL", "POLICY_FIELD_VALUE_MISSING"), ("limit_krw IS NOT NULL AND policy_id % 2 = 1", "POLICY_FIELD_EVIDENCE_MISMATCH"), ("limit_krw IS NOT NULL AND policy_id % 2 = 1", "POLICY_FIELD_VALUE_OR_UNIT_MISMATCH"),
    ("discount_pp IS NULL OR grace_months IS NULL OR maturity_months IS NULL OR collateral IS NULL", "POLICY_REQUIRED_TERM_MISSING"), ("grace_months IS NOT NULL AND policy_id % 3 = 0", "POLICY_NUMERIC_UNIT_AMBIGUOUS"),
    ("maturity_months::DOUBLE / 12 * 12 <> maturity_months", "POLICY_FIELD_EVIDENCE_MISMATCH"), ("maturity_months::DOUBLE / 12 * 12 <> maturity_months", "POLICY_FIELD_VALUE_OR_UNIT_MISMATCH"),
    ("app_start IS NULL", "POLICY_APPLICATION_STATUS_UNRESOLVED"), ("collateral IS NOT NULL AND policy_id % 5 = 0", "POLICY_FIELD_EVIDENCE_MISMATCH"),
    ("policy_id % 16 = 0 AND budget_status <> 'EXHAUSTED'", "POLICY_BUDGET_STATUS_MISMATCH")) + ")), ',') AS codes, policy_id % 22 = 0 AND policy_id % 16 <> 0 AS explicitly_closed FROM policies", "policies"))
def policy_term_evidence(spark, sf):
    p = b.policies(spark, sf)
    k = F.col("policy_id")
    say = lambda c: F.coalesce(c.cast("string"), F.lit("n/a"))
    quotes = F.create_map(
        F.lit("limit_krw"), F.concat(F.lit("up to KRW "), say(F.when(k % 2 == 0, F.col("limit_krw")).otherwise(5))), F.lit("discount_pp"), F.concat(F.lit("cut by "), say(F.col("discount_pp")), F.lit(" %p")),
        F.lit("grace_months"), F.concat(F.lit("grace of "), say(F.col("grace_months")), F.when(k % 3 == 0, " ").otherwise(" months")), F.lit("maturity_months"), F.concat(say(F.col("maturity_months") / 12), F.lit(" years")),
        F.lit("app_start"), F.concat(F.lit("opens "), say(F.col("app_start"))), F.lit("remark"), F.when(k % 16 == 0, "open until funds are exhausted").when(k % 22 == 0, "Applications are closed").otherwise("none"), F.lit("collateral"), F.when(k % 5 == 0, "lien").otherwise("no collateral"))
    out = po.term_evidence(p.drop("semantic_codes", "explicitly_closed").withColumn("quotes", quotes))
    return out.select("policy_id", F.array_join("semantic_codes", ",").alias("codes"), "explicitly_closed")


@query("context_check", sql("""
SELECT policy_id, CASE WHEN policy_id % 11 = 0 THEN 'CONTEXT_MISMATCH' WHEN policy_id % 13 = 0 OR policy_id % 7 = 0 OR d.doc_id IS NULL THEN 'SOURCE_REVISION_MISMATCH' ELSE 'OK' END AS code
FROM policies p LEFT JOIN documents d ON d.doc_id = CASE WHEN policy_id % 7 = 0 THEN -1 ELSE policy_id END""", "policies"))
def context_check(spark, sf):
    k = F.col("policy_id")
    rows = b.policies(spark, sf).select("policy_id", F.lit("R1").alias("run_id"), F.when(k % 11 == 0, "R2").otherwise("R1").alias("asked_run_id"),
                                        F.when(k % 7 == 0, -1).otherwise(k).cast("bigint").alias("source_id"), F.when(k % 13 == 0, "v0").otherwise("v1").alias("revision_id"))
    docs = b.table(spark, sf, "documents").select(F.col("doc_id").alias("source_id"), F.lit("v1").alias("revision_id"))
    return po.context_check(rows, docs)


@query("policy_identity", sql("""
SELECT policy_id, lower(replace(provider, '#', '')) AS provider_key, lower(p_type) || p_size AS name_key, '' AS years, CASE policy_id % 3 WHEN 0 THEN 'CREDIT_GUARANTEE' WHEN 1 THEN 'WORKING_CAPITAL' ELSE 'DEBT_RELIEF,INTEREST_REDUCTION' END AS purposes,
  CASE policy_id % 2 WHEN 0 THEN 'LOAN_SUPPORT' ELSE 'Odd Type' END AS type_name FROM policies JOIN part ON p_partkey = policy_id""", "policies"))
def policy_identity(spark, sf):
    k = F.col("policy_id")
    purpose = F.when(k % 3 == 0, "A credit guarantee").when(k % 3 == 1, "Working Capital").otherwise("Interest on debt")
    return b.policies(spark, sf).select(
        "policy_id", po.provider_key(F.concat("provider", F.lit(" Foundation"))).alias("provider_key"), po.name_key(F.concat(F.col("name"), F.lit(" 지원"))).alias("name_key"), po.program_years(F.col("name")).alias("years"),
        po.purpose_key(purpose).alias("purposes"), po.policy_type(F.when(k % 2 == 0, "Loan-Program").otherwise("Odd Type")).alias("type_name"))


@query("policy_upsert", sql("""
SELECT coalesce(o.policy_id, n.policy_id) AS policy_id, CASE WHEN o.policy_id IS NULL THEN 'INSERT' WHEN n.policy_id IS NULL THEN 'KEPT' WHEN o.f = n.f THEN 'UPDATE' ELSE 'IDENTITY_COLLISION' END AS status
FROM (SELECT policy_id, sha256(provider || name) AS f FROM policies WHERE policy_id % 3 <> 0) o FULL JOIN (SELECT policy_id, sha256(provider || name || CASE WHEN policy_id % 5 = 0 THEN '!' ELSE '' END) AS f FROM policies WHERE policy_id % 4 <> 0) n ON o.policy_id = n.policy_id""", "policies"))
def policy_upsert(spark, sf):
    p = b.policies(spark, sf)
    k = F.col("policy_id")
    old = p.filter(k % 3 != 0).select("policy_id", F.sha2(F.concat("provider", "name"), 256).alias("f"))
    new = p.filter(k % 4 != 0).select("policy_id", F.sha2(F.concat("provider", "name", F.when(k % 5 == 0, "!").otherwise("")), 256).alias("f"))
    return sinks.upsert_status(old, new, "policy_id", "f")


# ---- eligibility ---------------------------------------------------------------------------

REGION_SQL = """CASE WHEN p.policy_id % 3 = 0 THEN true WHEN p.policy_id % 13 = 0 THEN NULL ELSE s.region_code IN ('KR-' || (10 + p.policy_id % 25), 'KR-' || (10 + (p.policy_id + 1) % 25), 'KR-20') END"""
COND_SQL = """CASE p.policy_id % 4 WHEN 0 THEN CASE WHEN s.employee_count IS NULL THEN 'NEEDS_INFORMATION' WHEN s.employee_count <= 8 + p.policy_id % 12 THEN 'PASSED' ELSE 'FAILED' END
  WHEN 1 THEN CASE WHEN s.annual_revenue <= 400000 + p.policy_id % 700000 THEN 'PASSED' ELSE 'FAILED' END
  WHEN 2 THEN CASE WHEN greatest(0, (2001 - year(s.business_start_date)) * 12 + 8 - month(s.business_start_date)) >= p.policy_id % 150 THEN 'PASSED' ELSE 'FAILED' END ELSE 'INVALID_RULE' END"""
cte("pairs", f"""
SELECT p.*, s.store_id, s.business_type_code AS btype, {REGION_SQL} AS region_ok, {COND_SQL} AS c1, CASE p.policy_id % 3 WHEN 0 THEN CASE WHEN s.business_type_code = 'RETAIL' THEN 'FAILED' ELSE 'PASSED' END
    WHEN 1 THEN CASE WHEN s.owner_age IS NULL THEN 'NEEDS_INFORMATION' WHEN s.owner_age >= 20 + p.policy_id % 30 THEN 'PASSED' ELSE 'FAILED' END
    ELSE CASE WHEN s.credit_band IS NULL THEN 'NEEDS_INFORMATION' WHEN s.credit_band IN ('A', 'B') THEN 'PASSED' ELSE 'FAILED' END END AS c2, (['business_type_code', 'owner_age', 'store_profile.credit_band'])[p.policy_id % 3 + 1] AS f2,
  (['employee_count', 'store.annual_revenue', 'business_age_months', 'shoe_size'])[p.policy_id % 4 + 1] AS f1
FROM policy_pairs q JOIN policy_state p USING (policy_id) JOIN stores s USING (store_id)""", "policy_pairs", "policy_state", "stores")
cte("eligible_pairs", """
SELECT *, CASE WHEN validation_status = 'CLOSED' THEN 'CLOSED' WHEN validation_status <> 'VALIDATED' THEN 'NOT_VALIDATED' WHEN application_status IN ('BUDGET_EXHAUSTED', 'SCHEDULED', 'STATUS_UNCONFIRMED') THEN application_status
    WHEN budget_status = 'UNKNOWN' THEN 'BUDGET_UNKNOWN' WHEN app_end < DATE '2001-08-31' THEN 'CLOSED' WHEN app_start > DATE '2001-08-31' THEN 'NOT_OPEN' ELSE rule END AS status,
  CASE WHEN validation_status = 'CLOSED' THEN 'PROGRAM_CLOSED' WHEN validation_status <> 'VALIDATED' THEN 'EVIDENCE' WHEN application_status IN ('BUDGET_EXHAUSTED', 'SCHEDULED', 'STATUS_UNCONFIRMED') THEN 'APPLICATION_STATUS'
    WHEN budget_status = 'UNKNOWN' THEN 'BUDGET' WHEN app_end < DATE '2001-08-31' THEN 'PERIOD_ENDED' WHEN app_start > DATE '2001-08-31' THEN 'PERIOD_NOT_STARTED' ELSE why END AS reason
FROM (SELECT *, CASE WHEN region_ok IS NULL THEN 'NEEDS_INFORMATION' WHEN NOT region_ok OR policy_id % 19 = 0 AND btype = 'FNB_BAKERY' OR policy_id % 17 = 0 AND btype <> 'FNB_CAFE' OR c1 = 'FAILED' THEN 'INELIGIBLE'
    WHEN c1 <> 'PASSED' THEN 'NEEDS_INFORMATION' WHEN c2 = 'FAILED' THEN 'INELIGIBLE' WHEN c2 <> 'PASSED' THEN 'NEEDS_INFORMATION' ELSE 'ELIGIBLE_ON_DECLARED_RULES' END AS rule,
  CASE WHEN region_ok IS NULL THEN 'REGION_UNKNOWN' WHEN NOT region_ok THEN 'REGION' WHEN policy_id % 19 = 0 AND btype = 'FNB_BAKERY' THEN 'INDUSTRY_EXCLUDED' WHEN policy_id % 17 = 0 AND btype <> 'FNB_CAFE' THEN 'INDUSTRY_NOT_INCLUDED'
    WHEN c1 <> 'PASSED' THEN f1 WHEN c2 <> 'PASSED' THEN f2 ELSE 'ALL_PASSED' END AS why FROM pairs)""", "pairs")


def pairs(spark, sf):
    s = b.stores(spark, sf).select("store_id", "business_type_code", "region_code", "annual_revenue", "employee_count", "declared_revenue", "business_start_date", "owner_age", "credit_band")
    return po.meet(b.policy_pairs(spark, sf), s, policies(spark, sf), b.policy_finds(spark, sf))


@query("region_match", sql("SELECT store_id, policy_id, region_ok AS matches FROM pairs", "pairs"))
def region_match(spark, sf):
    return pairs(spark, sf).select("store_id", "policy_id", regions_match(F.col("region_code"), F.col("regions")).alias("matches"))


@query("eligibility_rules", sql("""
SELECT store_id, policy_id, CASE WHEN c1 <> 'PASSED' THEN c1 WHEN c2 <> 'PASSED' THEN c2 ELSE 'PASSED' END AS status, CASE WHEN c1 <> 'PASSED' THEN f1 WHEN c2 <> 'PASSED' THEN f2 END AS field FROM pairs""", "pairs"))
def eligibility_rules(spark, sf):
    rows = pairs(spark, sf)
    numbers, texts = po.store_maps(b.as_of(), rows.columns)
    out = rows.withColumn("c", po.evaluate_prepared(F.col("rules"), numbers, texts))
    return out.select("store_id", "policy_id", F.coalesce("c.status", F.lit("PASSED")).alias("status"), F.col("c.field").alias("field"))


def results(spark, sf):
    return po.eligibility(pairs(spark, sf), b.as_of())


def eligible(spark, sf):
    """The eligible pairs with the terms that a benefit reads, written once."""
    return staged(spark, "eligible:" + sf, lambda: results(spark, sf).filter(F.col("status") == "ELIGIBLE_ON_DECLARED_RULES").select(
        "store_id", "policy_id", "policy_type", "limit_krw", "discount_pp", "annual_rate_percent", "grace_months", "maturity_months", "method"))


@query("eligibility", sql("SELECT store_id, policy_id, status, reason FROM eligible_pairs", "eligible_pairs"))
def eligibility(spark, sf):
    return results(spark, sf).select("store_id", "policy_id", "status", "reason")


@query("policy_stage_counts", sql("""
SELECT * FROM (SELECT count(*) AS extracted, count(*) FILTER (validation_status = 'VALIDATED') AS validated, count(*) FILTER (validation_status = 'CLOSED') AS closed FROM policy_state),
  (SELECT count(*) AS evaluated, count(*) FILTER (status = 'ELIGIBLE_ON_DECLARED_RULES') AS eligible FROM eligible_pairs)""", "policy_state", "eligible_pairs"))
def policy_stage_counts(spark, sf):
    return po.stage_counts(policies(spark, sf), results(spark, sf))


# ---- benefit -------------------------------------------------------------------------------

cte("gain_pairs", """
SELECT e.store_id, e.policy_id, e.app_start, e.collateral, e.grace_months, coalesce(discount_pp, 0.0::DOUBLE) / 100.0::DOUBLE AS discount, CASE WHEN policy_type = 'REPAYMENT_DEFERRAL' THEN coalesce(grace_months, 0) ELSE 0 END AS deferral,
  CASE WHEN drawn THEN funding ELSE 0.0::DOUBLE END AS draw, CASE WHEN drawn OR policy_type = 'GRANT' THEN greatest(0.0::DOUBLE, funding) ELSE 0.0::DOUBLE END AS cash_in, annual_rate_percent, maturity_months, method
FROM (SELECT e.*, least(coalesce(limit_krw, 0.0::DOUBLE), g.required_funding) AS funding, coalesce(policy_type = 'LOAN_SUPPORT' AND least(coalesce(limit_krw, 0.0::DOUBLE), g.required_funding) > 0 AND annual_rate_percent IS NOT NULL AND maturity_months > 0, false) AS drawn
  FROM eligible_pairs e JOIN (SELECT store_id, greatest(0.0::DOUBLE, max(min_cash) - min(ending_cash)) AS required_funding FROM base_ledger GROUP BY store_id) g USING (store_id) WHERE e.status = 'ELIGIBLE_ON_DECLARED_RULES') e""", "eligible_pairs", "base_ledger")
cte("gain_runs", "SELECT l.* REPLACE (greatest(0.0::DOUBLE, l.annual_rate - t.discount) AS annual_rate), t.discount, t.deferral FROM loans l JOIN (SELECT DISTINCT store_id, discount, deferral FROM gain_pairs) t USING (store_id)", "loans", "gain_pairs")
cte("gain_sched", b.schedule_sql("gain_runs", "gain_sched", "0.0::DOUBLE", grace="deferral", extra=("discount", "deferral")), "gain_runs")
cte("draw_runs", """SELECT store_id, policy_id AS loan_id, draw AS principal, greatest(0.0::DOUBLE, annual_rate_percent / 100.0::DOUBLE - discount) AS annual_rate, 'FIXED' AS rate_type, method AS repayment_type, maturity_months AS remaining_months,
  NULL::DATE AS next_payment_date, NULL::DATE AS grace_end_date, NULL::INTEGER AS renewal_month, NULL::INTEGER AS custom_n, NULL::DOUBLE AS custom_principal, NULL::DOUBLE AS custom_interest, coalesce(grace_months, 0) AS new_grace FROM gain_pairs WHERE draw > 0""", "gain_pairs")
cte("draw_sched", b.schedule_sql("draw_runs", "draw_sched", "0.0::DOUBLE", grace="new_grace", extra=("new_grace",)), "draw_runs")
cte("gain_ledger", """
SELECT *, current_cash + cash_in + sum(net) OVER (PARTITION BY store_id, policy_id ORDER BY month_index) AS ending_cash,
  current_cash + cash_in + coalesce(sum(net) OVER (PARTITION BY store_id, policy_id ORDER BY month_index ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0::DOUBLE) AS beginning_cash
FROM (SELECT p.store_id, p.policy_id, b.month, b.month_index, b.current_cash, b.min_cash, p.cash_in, b.interest AS base_interest, coalesce(s.interest, 0.0::DOUBLE) + coalesce(n.interest, 0.0::DOUBLE) AS sim_interest,
    b.revenue - b.variable_cost - b.fixed_cost - (coalesce(s.interest, 0.0::DOUBLE) + coalesce(n.interest, 0.0::DOUBLE)) - (coalesce(s.principal, 0.0::DOUBLE) + coalesce(n.paid, 0.0::DOUBLE)) - b.tax - b.capex AS net
  FROM gain_pairs p JOIN base_ledger b USING (store_id)
  LEFT JOIN (SELECT store_id, discount, deferral, m, sum(interest) AS interest, sum(paid) AS principal FROM gain_sched WHERE m > 0 GROUP BY 1, 2, 3, 4) s ON s.store_id = p.store_id AND s.discount = p.discount AND s.deferral = p.deferral AND s.m = b.month_index
  LEFT JOIN draw_sched n ON n.store_id = p.store_id AND n.loan_id = p.policy_id AND n.m = b.month_index)""", "gain_pairs", "base_ledger", "gain_sched", "draw_sched")
cte("gain_burn", burn_sql("gain_ledger", "store_id, policy_id"), "gain_ledger")
cte("benefit", """
SELECT g.store_id, g.policy_id, b.burn_date AS original_burn, g.burn_date AS simulated_burn, greatest(0, CASE WHEN b.burn_date IS NOT NULL THEN datediff('day', b.burn_date, coalesce(g.burn_date, t.last_month + 27)) ELSE 0 END) AS runway_extension_days,
  greatest(0.0::DOUBLE, t.bi - t.si) AS interest_savings
FROM gain_burn g JOIN burn b USING (store_id) JOIN (SELECT store_id, policy_id, sum(base_interest) AS bi, sum(sim_interest) AS si, max(month) AS last_month FROM gain_ledger GROUP BY 1, 2) t USING (store_id, policy_id)""", "gain_burn", "burn", "gain_ledger")


def benefits(spark, sf):
    """Benefits of all eligible pairs, written once for the ranking."""
    return staged(spark, "benefits:" + sf, lambda: derive_benefits(spark, sf))


def derive_benefits(spark, sf):
    base = base_ledger(spark, sf)
    return po.policy_benefit(eligible(spark, sf), base, b.loans(spark, sf), lg.funding_gap(base, ["store_id"]), b.HORIZON, b.start())


@query("policy_benefit", sql(f"""
SELECT store_id, policy_id, strftime(original_burn, '%Y-%m-%d') AS original_burn, strftime(simulated_burn, '%Y-%m-%d') AS simulated_burn, runway_extension_days, {r('interest_savings', 3)} AS interest_savings FROM benefit""", "benefit"))
def policy_benefit(spark, sf):
    out = derive_benefits(spark, sf)
    return out.select("store_id", "policy_id", day_name(F.col("original_burn")).alias("original_burn"), day_name(F.col("simulated_burn")).alias("simulated_burn"),
                      "runway_extension_days", rnd(F.col("interest_savings"), 3).alias("interest_savings"))


@query("policy_rank", sql(f"""
SELECT store_id, policy_id, {r('score', 4)} AS score, row_number() OVER (PARTITION BY store_id ORDER BY round(score, 6) DESC, policy_id) AS rank FROM (
  SELECT e.store_id, e.policy_id, 100.0::DOUBLE + CASE WHEN original_burn IS NOT NULL AND (p.app_start IS NULL OR p.app_start <= original_burn) THEN 20.0::DOUBLE ELSE 0.0::DOUBLE END + least(30.0::DOUBLE, runway_extension_days / 3.0::DOUBLE)
    + least(20.0::DOUBLE, interest_savings / 100000.0::DOUBLE) - CASE WHEN p.collateral THEN 10.0::DOUBLE ELSE 0.0::DOUBLE END + least(10.0::DOUBLE, coalesce(p.grace_months, 0)::DOUBLE) AS score
  FROM benefit e JOIN policies p USING (policy_id))""", "benefit", "policies"))
def policy_rank(spark, sf):
    out = po.rank_policies(benefits(spark, sf), b.policies(spark, sf))
    return out.select("store_id", "policy_id", rnd(F.col("score"), 4).alias("score"), "rank")
