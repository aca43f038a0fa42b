"""Programs: identity, grouping, merging, lineage and conflicts of policy notices."""

from __future__ import annotations

from pyspark.sql import functions as F

from tillwise.functions.stages import staged
from tillwise.operators import programs as pg
from tillwise.plans import bindings as b
from tillwise.plans.catalog import cte, query, sql
from tillwise.plans.q_policy import policies

HOST = "visitgangnam.net"

# ---- the notices: spelled differently, partly stated, with pages as their sources ---------------

_pick = lambda values, i: F.element_at(F.array(*[F.lit(v) for v in values]), (i + 1).cast("int"))


def notices(spark, sf):
    k = F.col("policy_id")
    text = lambda c: c.cast("string")
    none = F.array().cast("array<string>")
    base = policies(spark, sf).select("policy_id", "provider", "name", "notice_kind", "application_status", "validation_status", "failure_codes", "recommendation_codes", "budget_status", "method", "collateral",
                                      "app_start", "app_end", "conditions")
    word = F.substring_index("name", " ", 1)
    cond = F.array_compact(F.array(
        F.when(k % 3 == 0, F.struct(F.lit("employee_count").alias("field"), F.lit("LE").alias("op"), text(5 + k % 2).alias("expected"))),
        F.when(k % 4 == 1, F.struct(F.lit("Owner_Age ").alias("field"), F.lit("ge").alias("op"), F.lit("19").alias("expected"))),
        F.when(k % 15 == 0, F.struct(F.lit("EMPLOYEE_COUNT").alias("field"), F.lit("LE").alias("op"), F.lit("9").alias("expected")))))
    return base.withColumns({
        "provider": F.concat("provider", _pick(["", " Foundation", " AGENCY"], k % 3)),
        "name": F.concat(_pick(["2001 ", "", "", "", "2002 "], k % 5), word, _pick([" support program", " Special Policy", " 지원"], k % 3)),
        "policy_type": _pick(["Loan-Program", "grant"], k % 2), "purposes": F.when(k % 3 == 1, none).otherwise(F.array(F.lit("Working capital"), _pick(["interest", "repayment"], F.floor(k / 7) % 2))),
        "regions": F.when(k % 4 == 0, F.array(F.lit("KR-11"), F.lit("서초구"))).when(k % 4 == 1, F.array(F.lit("서초구"), F.lit("kr-11"), F.lit("nowhere"))).otherwise(none),
        "include": F.when(k % 5 == 0, F.array(F.lit("Cafe"), F.lit("  bakery"))).otherwise(none), "exclude": F.when(k % 6 == 0, F.array(F.lit("PUB"))).otherwise(none),
        "app_start": F.when(k % 2 == 0, F.lit("2001-08-01").cast("date")), "app_end": F.when(k % 3 == 0, F.when(k % 11 == 0, F.lit("2001-12-30").cast("date")).otherwise(F.lit("2001-12-31").cast("date"))),
        "limit_krw": F.when(k % 3 != 0, 10000 * (1 + F.floor(k / 5) % 2)), "annual_rate_percent": F.when(k % 6 == 1, F.lit(2.5)), "discount_pp": F.when(k % 5 == 2, 0.5 * (1 + F.floor(k / 10) % 2)),
        "coverage_ratio": F.when(k % 7 == 3, F.lit(0.9)), "fee_percent": F.when(k % 8 == 3, F.lit(1.5)), "grace_months": F.when(k % 4 == 3, (6 * (1 + F.floor(k / 9) % 2)).cast("int")),
        "maturity_months": F.when(k % 9 == 4, F.lit(36)), "conditions": cond,
        "source_ids": F.when(k % 5 == 0, F.array(text(k % 40))).when(k % 5 == 1, F.array(text(k % 40), text(k % 40 + 11))).when(k % 5 == 2, F.array(F.lit("none"), text(11 * (k % 4)))).otherwise(none),
        "quotes": F.when(k % 10 == 3, F.array(F.lit("for 2001"), F.lit("from 2002 on"))).otherwise(F.array(F.lit("no year")))})


def sources(spark, sf):
    k = F.col("page_id")
    return b.table(spark, sf, "pages").where(k >= 0).select(
        k.cast("string").alias("source_id"), F.when(k % 11 == 0, F.lit(f"https://www.{HOST}/x")).otherwise(F.regexp_replace("url", "(?i)^(https?://)[^/?#]+", F.concat(F.lit("$1site"), (k % 3).cast("string"), F.lit(".example.org")))).alias("url"),
        F.when(k % 7 == 0, F.lit("Notice of 2001")).otherwise(F.lit("Notice")).alias("title"), F.when(k % 2 == 0, "OFFICIAL_PRIMARY").otherwise("OTHER").alias("source_type"),
        F.date_add(F.lit("2001-01-01").cast("date"), (k % 50).cast("int")).cast("timestamp").alias("published_at"))


cte("notices", """
SELECT policy_id, notice_kind, application_status, validation_status, codes AS failure_codes, budget_status, method, collateral, policy_id AS k,
  lower(replace(provider, '#', '')) AS provider_key, lower(split_part(name, ' ', 1)) AS name_key, CASE k % 2 WHEN 0 THEN 'LOAN_SUPPORT' ELSE 'GRANT' END AS policy_type,
  CASE k % 5 WHEN 0 THEN ['2001'] WHEN 4 THEN ['2002'] ELSE [] END AS name_years, CASE WHEN k % 10 = 3 THEN ['2001', '2002'] ELSE [] END AS quote_years, CASE WHEN k % 10 = 3 THEN 2 ELSE 1 END AS evidence_count,
  CASE WHEN k % 3 <> 1 THEN CASE (k // 7) % 2 WHEN 0 THEN 'INTEREST_REDUCTION,WORKING_CAPITAL' ELSE 'DEBT_RELIEF,WORKING_CAPITAL' END END AS purpose,
  CASE WHEN k % 4 < 2 THEN 'KR-11,KR-11650' END AS region, CASE WHEN k % 5 = 0 THEN 'bakery,cafe' END AS industry_inclusions, CASE WHEN k % 6 = 0 THEN 'pub' END AS industry_exclusions,
  CASE WHEN application_status IN ('CLOSED', 'BUDGET_EXHAUSTED') OR notice_kind = 'TERMINATION' THEN 'CLOSED' WHEN application_status IN ('OPEN', 'SCHEDULED') THEN application_status END AS status_class,
  CASE WHEN k % 2 = 0 THEN DATE '2001-08-01' END AS app_start, CASE WHEN k % 3 = 0 THEN CASE WHEN k % 11 = 0 THEN DATE '2001-12-30' ELSE DATE '2001-12-31' END END AS app_end,
  CASE WHEN k % 3 <> 0 THEN 10000 * (1 + (k // 5) % 2) END AS limit_krw, CASE WHEN k % 6 = 1 THEN 2.5::DOUBLE END AS annual_rate_percent, CASE WHEN k % 5 = 2 THEN 0.5::DOUBLE * (1 + (k // 10) % 2) END AS discount_pp,
  CASE WHEN k % 7 = 3 THEN 0.9::DOUBLE END AS coverage_ratio, CASE WHEN k % 8 = 3 THEN 1.5::DOUBLE END AS fee_percent, CASE WHEN k % 4 = 3 THEN (6 * (1 + (k // 9) % 2))::INTEGER END AS grace_months, CASE WHEN k % 9 = 4 THEN 36 END AS maturity_months,
  CASE WHEN k % 15 = 0 THEN 'le:9' WHEN k % 3 = 0 THEN 'le:' || (5 + k % 2) END AS employee_count, CASE WHEN k % 4 = 1 THEN 'ge:19' END AS owner_age,
  CASE k % 5 WHEN 0 THEN [(k % 40)::VARCHAR] WHEN 1 THEN [(k % 40)::VARCHAR, (k % 40 + 11)::VARCHAR] WHEN 2 THEN ['none', (11 * (k % 4))::VARCHAR] ELSE [] END AS source_ids
FROM (SELECT *, policy_id AS k, list_sort(list_distinct(list_concat(hard, CASE WHEN ambiguous THEN ['POLICY_NUMERIC_UNIT_AMBIGUOUS'] ELSE [] END))) AS codes FROM policy_state)""", "policy_state")
_TERMS = [("program_year", "nullif(array_to_string(years, ','), '')"), ("region", "region"), ("purpose", "purpose"), ("industry_inclusions", "industry_inclusions"), ("industry_exclusions", "industry_exclusions"),
          ("application_status", "status_class"), ("application_start", "app_start::VARCHAR"), ("application_end", "app_end::VARCHAR"), ("limit_krw", "limit_krw::VARCHAR"), ("interest_terms.annual_rate_percent", "annual_rate_percent::VARCHAR"),
          ("interest_terms.rate_discount_percentage_points", "discount_pp::VARCHAR"), ("guarantee_terms.coverage_ratio", "coverage_ratio::VARCHAR"), ("guarantee_terms.guarantee_fee_percent", "fee_percent::VARCHAR"),
          ("repayment_terms.principal_grace_months", "grace_months::VARCHAR"), ("repayment_terms.maturity_months", "maturity_months::VARCHAR"), ("condition:employee_count", "employee_count"), ("condition:owner_age", "owner_age")]
cte("notice_sources", """
SELECT page_id::VARCHAR AS source_id, CASE WHEN page_id % 11 = 0 THEN 'gangnamgokr' END AS body, CASE WHEN page_id % 11 = 0 THEN 'www.visitgangnam.net' ELSE 'site' || page_id % 3 || '.example.org' END AS host,
  CASE WHEN page_id % 7 = 0 THEN ['2001'] ELSE [] END AS named, CASE WHEN page_id % 2 = 0 THEN 1 ELSE 0 END AS official, page_id % 50 AS published FROM pages""")
cte("identified", f"""
SELECT *, map_from_entries(list_filter([{', '.join(f"{{'key': '{k}', 'value': {v}}}" for k, v in _TERMS)}], lambda t: t.value IS NOT NULL)) AS terms,
  authority || '|' || name_key || '|' || policy_type AS block FROM (
  SELECT n.*, CASE WHEN b0 = b1 THEN b0 WHEN h0 = h1 THEN 'host:' || h0 ELSE provider_key END AS authority, coalesce(off, 0) AS official_sources, pub,
    list_sort(CASE WHEN len(pre) > 0 THEN pre ELSE quote_years END) AS years, len(pre) > 0 AS year_named
  FROM (SELECT n.*, f.* EXCLUDE (policy_id), list_distinct(list_concat(name_years, coalesce(titles, []))) AS pre FROM notices n LEFT JOIN (
    SELECT policy_id, min(body) AS b0, max(body) AS b1, min(host) AS h0, max(host) AS h1, list_distinct(flatten(list(named))) AS titles, sum(official) AS off, max(published) AS pub
    FROM (SELECT policy_id, unnest(source_ids) AS source_id FROM notices) JOIN notice_sources USING (source_id) GROUP BY 1) f ON f.policy_id = n.policy_id) n)""", "notices", "notice_sources")
# first fit as a fold over the notices of a block in id order
cte("fitted", """
SELECT block, ids, list_reduce(list_transform(ts, lambda t: {'p': [t], 'g': [1]}), lambda s, x: CASE WHEN at_of(s.p, x.p[1]) = 0
    THEN {'p': list_concat(s.p, x.p), 'g': list_append(s.g, (len(s.p) + 1)::INTEGER)}
    ELSE {'p': list_transform(s.p, lambda p, i: CASE WHEN i = at_of(s.p, x.p[1]) THEN map_concat(p, x.p[1]) ELSE p END), 'g': list_append(s.g, at_of(s.p, x.p[1])::INTEGER)} END) AS fit
FROM (SELECT block, list(policy_id ORDER BY policy_id) AS ids, list(terms ORDER BY policy_id) AS ts FROM identified GROUP BY 1)""".replace(
    "at_of(s.p, x.p[1])", "coalesce(list_position(list_transform(s.p, lambda q: len(list_filter(map_keys(x.p[1]), lambda k: coalesce(q[k] <> x.p[1][k], false))) = 0), true), 0)"), "identified")
cte("grouped", "SELECT i.*, min(i.policy_id) OVER (PARTITION BY i.block, g) AS group_id FROM (SELECT block, unnest(ids) AS policy_id, unnest(fit.g) AS g FROM fitted) f JOIN identified i USING (policy_id)", "fitted", "identified")


def identified(spark, sf):
    return staged(spark, "identified:" + sf, lambda: pg.with_identity(notices(spark, sf), sources(spark, sf)))


def groups(spark, sf):
    return staged(spark, "program-groups:" + sf, lambda: pg.group_programs(identified(spark, sf)))


def grouped(spark, sf):
    return identified(spark, sf).join(groups(spark, sf), "policy_id")


@query("program_identity", sql("""SELECT policy_id, authority, name_key, policy_type, array_to_string(years, ',') AS years, year_named, official_sources::INTEGER AS official_sources,
  array_to_string(list_sort(list_transform(map_entries(terms), lambda t: t.key || '=' || t.value)), ';') AS terms FROM identified""", "identified"))
def program_identity(spark, sf):
    text = F.array_join(F.array_sort(F.transform("terms", lambda t: F.concat_ws("=", t["key"], t["value"]))), ";")
    return identified(spark, sf).select("policy_id", "authority", "name_key", "policy_type", F.array_join("years", ",").alias("years"), "year_named", F.col("official_sources").cast("int").alias("official_sources"), text.alias("terms"))


@query("program_groups", sql("SELECT policy_id, group_id FROM grouped", "grouped"))
def program_groups(spark, sf):
    return pg.group_programs(pg.with_identity(notices(spark, sf), sources(spark, sf)))


_CONTESTED = """
SELECT DISTINCT policy_id, CASE WHEN t.key LIKE 'condition:%' OR t.key = 'industry_inclusions' THEN 'eligible_business_category' ELSE t.key END AS field
FROM (SELECT policy_id, authority, name_key, unnest(list_append(map_entries(terms), {'key': 'policy_type', 'value': policy_type})) AS t FROM identified) x
WHERE t.key NOT IN ('purpose', 'industry_exclusions') AND EXISTS (SELECT 1 FROM (SELECT authority, name_key, unnest(list_append(map_entries(terms), {'key': 'policy_type', 'value': policy_type})) AS t FROM identified) y
  WHERE y.authority = x.authority AND y.name_key = x.name_key AND y.t.key = x.t.key AND y.t.value <> x.t.value)"""
cte("contested", _CONTESTED, "identified")


@query("policy_conflict_pairs", sql("SELECT policy_id, string_agg(field, ',' ORDER BY field) AS conflicting_fields FROM contested GROUP BY 1", "contested"))
def policy_conflict_pairs(spark, sf):
    return pg.conflict_fields(identified(spark, sf)).groupBy("policy_id").agg(F.array_join(F.array_sort(F.collect_list("field")), ",").alias("conflicting_fields"))


_SCALARS = ["app_start", "app_end", "limit_krw", "annual_rate_percent", "discount_pp", "coverage_ratio", "fee_percent", "grace_months", "maturity_months", "method", "collateral"]
_SET = lambda e: f"coalesce(array_to_string(list_sort(list_distinct(list({e}) FILTER ({e} IS NOT NULL))), ','), '')"
_SPLIT = lambda e: f"coalesce(array_to_string(list_sort(list_distinct(flatten(list(string_split({e}, ',')) FILTER ({e} IS NOT NULL)))), ','), '')"
_MATERIAL = " || '|' || ".join([_SET("authority"), _SET("name_key"), _SET("policy_type"), _SPLIT("nullif(array_to_string(years, ','), '')"), _SPLIT("region"), _SPLIT("purpose"), _SPLIT("industry_inclusions"), _SPLIT("industry_exclusions"),
                                _SET("coalesce(status_class, 'UNKNOWN')"), _SET("app_start::VARCHAR"), _SET("app_end::VARCHAR"), _SET("limit_krw::VARCHAR"), _SET("annual_rate_percent::VARCHAR"), _SET("discount_pp::VARCHAR"),
                                _SET("coverage_ratio::VARCHAR"), _SET("fee_percent::VARCHAR"), _SET("collateral::VARCHAR"), _SET("grace_months::VARCHAR"), _SET("maturity_months::VARCHAR"), _SET("method"),
                                "coalesce(array_to_string(list_sort(list_distinct(list_filter(list_concat(list('employee_count:' || employee_count), list('owner_age:' || owner_age)), lambda x: x IS NOT NULL))), ','), '')"])
cte("merged_notices", f"""
SELECT group_id, members, primary_id, CASE WHEN members > 1 THEN 'POL-' || upper(substr(fp, 1, 24)) ELSE primary_id::VARCHAR END AS program_id, CASE WHEN members > 1 THEN 'PMG-' || upper(substr(fp, 1, 20)) END AS merge_group, {', '.join(_SCALARS)},
  coalesce(budget, own.b) AS budget_status, coalesce(application, own.a) AS application_status, signatures > 1 AS mixed,
  CASE WHEN signatures > 1 AND soft THEN 'PARTIALLY_VALIDATED' WHEN signatures > 1 THEN 'CONFLICTED' ELSE own.v END AS validation_status
FROM (SELECT group_id, count(*) AS members, first(policy_id ORDER BY year_named DESC, official_sources DESC, evidence_count DESC, coalesce(pub, -10000) DESC, policy_id) AS primary_id,
    first({{'b': budget_status, 'a': application_status, 'v': validation_status}} ORDER BY year_named DESC, official_sources DESC, evidence_count DESC, coalesce(pub, -10000) DESC, policy_id) AS own,
    {', '.join(f'first({c} ORDER BY policy_id) FILTER ({c} IS NOT NULL) AS {c}' for c in _SCALARS)}, sha256({_MATERIAL}) AS fp,
    first(budget_status ORDER BY policy_id) FILTER (budget_status NOT IN ('UNKNOWN', 'BUDGET_UNKNOWN')) AS budget, first(application_status ORDER BY policy_id) FILTER (application_status NOT IN ('UNKNOWN', 'STATUS_UNCONFIRMED')) AS application,
    count(DISTINCT validation_status || '|' || array_to_string(failure_codes, ',')) AS signatures, bool_and(validation_status IN ('VALIDATED', 'PARTIALLY_VALIDATED')) AS soft
  FROM grouped WHERE notice_kind NOT IN ('CORRECTION', 'TERMINATION') GROUP BY 1)""", "grouped")
cte("revisions", """
SELECT g.*, coalesce(lag(g.policy_id) OVER (PARTITION BY g.group_id ORDER BY coalesce(g.app_start, g.app_end, DATE '0001-01-01'), g.policy_id)::VARCHAR, m.program_id) AS supersedes
FROM grouped g LEFT JOIN merged_notices m USING (group_id) WHERE g.notice_kind IN ('CORRECTION', 'TERMINATION')""", "grouped", "merged_notices")


@query("notice_lineage", sql("SELECT policy_id, group_id, notice_kind, supersedes FROM revisions", "revisions"))
def notice_lineage(spark, sf):
    rows = grouped(spark, sf)
    return pg.lineage(rows, pg.merged_originals(rows)).select("policy_id", "group_id", "notice_kind", "supersedes")


_HEAD = ["program_id", "group_id", "notice_kind", "members", "primary_id", "supersedes", "merge_group", *[c for c in _SCALARS if c not in ("app_start", "app_end")], "budget_status", "application_status"]
cte("program_rows", f"""
SELECT * FROM (SELECT group_id, NULL::BIGINT AS rev, 'ORIGINAL' AS notice_kind, program_id, members, primary_id, NULL::VARCHAR AS supersedes, merge_group, mixed, validation_status, {', '.join(_SCALARS)}, budget_status, application_status FROM merged_notices
UNION ALL SELECT group_id, policy_id, notice_kind, policy_id::VARCHAR, 1, policy_id, supersedes, NULL, false, CASE WHEN notice_kind = 'TERMINATION' AND len(failure_codes) = 0 THEN 'CLOSED' ELSE validation_status END, {', '.join(_SCALARS)}, budget_status, application_status FROM revisions)""", "merged_notices", "revisions")
cte("row_members", "SELECT group_id, CASE WHEN notice_kind IN ('CORRECTION', 'TERMINATION') THEN policy_id END AS rev, policy_id, source_ids, failure_codes FROM grouped", "grouped")
cte("source_conflicts", "SELECT DISTINCT source_id, field FROM (SELECT policy_id, unnest(source_ids) AS source_id FROM identified) JOIN contested USING (policy_id)", "identified", "contested")


@query("merge_policies", sql(f"""
SELECT {', '.join('p.' + c for c in _HEAD)}, strftime(app_start, '%Y-%m-%d') AS app_start, strftime(app_end, '%Y-%m-%d') AS app_end, coalesce(fields, '') AS conflicting_fields,
  CASE WHEN fields IS NOT NULL THEN 'CONFLICTED' ELSE validation_status END AS validation_status,
  array_to_string(list_sort(list_distinct(list_concat(coalesce(codes, []), CASE WHEN mixed OR fields IS NOT NULL THEN ['SOURCE_CONFLICT'] ELSE [] END))), ',') AS failure_codes
FROM program_rows p
LEFT JOIN (SELECT group_id, rev, string_agg(DISTINCT field, ',' ORDER BY field) AS fields FROM (SELECT group_id, rev, unnest(source_ids) AS source_id FROM row_members) JOIN source_conflicts USING (source_id) GROUP BY 1, 2) c
  ON c.group_id = p.group_id AND c.rev IS NOT DISTINCT FROM p.rev
LEFT JOIN (SELECT group_id, rev, flatten(list(failure_codes)) AS codes FROM row_members GROUP BY 1, 2) f ON f.group_id = p.group_id AND f.rev IS NOT DISTINCT FROM p.rev""", "program_rows", "row_members", "source_conflicts"))
def merge_policies(spark, sf):
    out = pg.reconciled(identified(spark, sf), groups(spark, sf))
    return out.select(*_HEAD, F.date_format("app_start", "yyyy-MM-dd").alias("app_start"), F.date_format("app_end", "yyyy-MM-dd").alias("app_end"), F.array_join("conflicting_fields", ",").alias("conflicting_fields"),
                      "validation_status", F.array_join("failure_codes", ",").alias("failure_codes"))


cte("originals", """
SELECT *, list_sort(list_filter([CASE application_status WHEN 'CLOSED' THEN 'POLICY_CLOSED' WHEN 'BUDGET_EXHAUSTED' THEN 'POLICY_BUDGET_EXHAUSTED' WHEN 'SCHEDULED' THEN 'POLICY_NOT_YET_OPEN' WHEN 'STATUS_UNCONFIRMED' THEN 'POLICY_STATUS_UNCONFIRMED' END,
  CASE WHEN budget_status = 'UNKNOWN' THEN 'POLICY_BUDGET_UNKNOWN' END], lambda x: x IS NOT NULL)) AS recommendations FROM grouped WHERE notice_kind NOT IN ('CORRECTION', 'TERMINATION')""", "grouped")


@query("program_lists", sql("""
SELECT group_id, field, value, first(policy_id ORDER BY policy_id, pos) AS first_id, first(pos ORDER BY policy_id, pos)::INTEGER AS first_at FROM (
  SELECT group_id, policy_id, field, unnest(vs) AS value, unnest(range(0, len(vs))) AS pos FROM (
    SELECT group_id, policy_id, 'purposes' AS field, CASE WHEN k % 3 <> 1 THEN ['Working capital', CASE (k // 7) % 2 WHEN 0 THEN 'interest' ELSE 'repayment' END] ELSE [] END AS vs FROM g
    UNION ALL SELECT group_id, policy_id, 'regions', CASE k % 4 WHEN 0 THEN ['KR-11', '서초구'] WHEN 1 THEN ['서초구', 'kr-11', 'nowhere'] ELSE [] END FROM g
    UNION ALL SELECT group_id, policy_id, 'include', CASE WHEN k % 5 = 0 THEN ['Cafe', '  bakery'] ELSE [] END FROM g
    UNION ALL SELECT group_id, policy_id, 'exclude', CASE WHEN k % 6 = 0 THEN ['PUB'] ELSE [] END FROM g
    UNION ALL SELECT group_id, policy_id, 'conditions', list_filter([CASE WHEN k % 3 = 0 THEN 'employee_count:le:' || (5 + k % 2) END, CASE WHEN k % 4 = 1 THEN 'owner_age:ge:19' END, CASE WHEN k % 15 = 0 THEN 'employee_count:le:9' END], lambda x: x IS NOT NULL) FROM g
    UNION ALL SELECT group_id, policy_id, 'source_ids', source_ids FROM g UNION ALL SELECT group_id, policy_id, 'failure_codes', failure_codes FROM g
    UNION ALL SELECT group_id, policy_id, 'recommendation_codes', recommendations FROM g)) GROUP BY group_id, field, value""".replace("FROM g ", "FROM originals ").replace("FROM g\n", "FROM originals\n").replace("FROM g)", "FROM originals)"), "originals"))
def program_lists(spark, sf):
    return pg.list_unions(grouped(spark, sf))
