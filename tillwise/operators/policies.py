"""Relief policies: validation, identity, merging, eligibility, benefit and rank."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tillwise.functions.core import codes, d, lookup, month_gap
from tillwise.functions.places import region_codes_match, region_id, region_ids
from tillwise.functions.skew import dealt_join, merge_join, salted_join, spread_rank, tie_safe
from tillwise.functions.text import fold_space
from tillwise.functions.units import NUMBERS_IN_TEXT, normalize_number
from tillwise.operators.ledger import cash_burn, cash_ledger
from tillwise.operators.loans import debt_service, loan_schedule

# ---- identity ------------------------------------------------------------------------------

# Provider suffixes, name aliases and fillers, purpose words, type spellings.
PROVIDER_TAILS = ["foundation", "corporation", "agency", "office", "재단", "공단", "공사", "주식회사"]
NAME_ALIASES = [("creditguaranteesupport", "creditguarantee"), ("specialcreditguarantee", "creditguarantee"), ("특별신용보증지원", "신용보증"),
                ("신용보증지원", "신용보증"), ("신용보증제도", "신용보증")]
NAME_FILLERS = "program|policy|support|special|강남구|서울특별시|서울시|중소기업|소상공인|특별|사업|지원"
PURPOSES = [("CREDIT_GUARANTEE", "credit guarantee|guarantee|신용보증|보증서"), ("DEBT_RELIEF", "debt|repayment|채무|상환"),
            ("FACILITY", "facility|equipment|시설자금|설비"), ("INTEREST_REDUCTION", "interest|rate subsidy|이자|금리"),
            ("WORKING_CAPITAL", "working capital|운전자금")]
TYPE_ALIASES = {
    "loan": "LOAN_SUPPORT", "loan_support": "LOAN_SUPPORT", "loan_program": "LOAN_SUPPORT", "credit_guarantee": "CREDIT_GUARANTEE",
    "credit_guarantee_support": "CREDIT_GUARANTEE", "guarantee": "CREDIT_GUARANTEE", "interest_subsidy": "INTEREST_SUBSIDY",
    "interest_support": "INTEREST_SUBSIDY", "loan_interest_subsidy": "INTEREST_SUBSIDY", "loan_interest_support": "INTEREST_SUBSIDY",
    "grant": "GRANT", "repayment_deferral": "REPAYMENT_DEFERRAL", "tax_relief": "TAX_RELIEF"}


def compact(text: Column) -> Column:
    return F.regexp_replace(F.lower(fold_space(text)), "[^0-9a-z가-힣]+", "")


def provider_key(text: Column) -> Column:
    out = compact(text)
    for tail in PROVIDER_TAILS:
        out = F.regexp_replace(out, tail + "$", "")
    return out


def name_key(text: Column) -> Column:
    out = compact(text)
    for a, b in NAME_ALIASES:
        out = F.replace(out, F.lit(a), F.lit(b))
    return F.regexp_replace(F.regexp_replace(out, "20[0-9]{2}", ""), NAME_FILLERS, "")


def purpose_key(text: Column) -> Column:
    return F.array_join(codes(*[(F.lower(text).rlike(p), k) for k, p in PURPOSES]), ",")


def program_years(text: Column) -> Column:
    return F.array_join(F.array_sort(F.array_distinct(F.regexp_extract_all(text, F.lit("(20[0-9]{2})"), F.lit(1)))), ",")


def policy_type(raw: Column) -> Column:
    key = F.replace(F.replace(F.lower(F.trim(raw)), F.lit("-"), F.lit("_")), F.lit(" "), F.lit("_"))
    return lookup(TYPE_ALIASES, key, raw)


def status_class(status: Column, notice: Column) -> Column:
    return F.when(status.isin("CLOSED", "BUDGET_EXHAUSTED") | (notice == "TERMINATION"), "CLOSED").when(
        status.isin("OPEN", "SCHEDULED"), status).otherwise("UNKNOWN")


# ---- validation ----------------------------------------------------------------------------


def policy_status(rows: DataFrame, as_of: Column) -> DataFrame:
    """rows(source_missing, set_mismatch, unavailable, security, untrusted, evidence_codes,
    semantic_codes, notice_kind, explicitly_closed, fallback, budget_status, app_start, app_end)
    with application status, recommendation codes, failure codes and validation status."""
    ended = F.coalesce(F.col("app_end") < as_of, F.lit(False))
    shut = (F.col("notice_kind") == "TERMINATION") | F.col("explicitly_closed") | ended
    budget = F.upper("budget_status")
    status = (
        F.when(shut, "CLOSED").when(F.col("fallback"), "STATUS_UNCONFIRMED").when(budget.isin("EXHAUSTED", "BUDGET_EXHAUSTED", "CLOSED"), "BUDGET_EXHAUSTED")
        .when(F.col("app_start") > as_of, "SCHEDULED").when((F.col("app_start") <= as_of) & (F.col("app_end") >= as_of), "OPEN").otherwise("STATUS_UNCONFIRMED"))
    hard = F.concat(codes(
        (F.col("source_missing"), "POLICY_SOURCE_MISSING"), (F.col("set_mismatch"), "POLICY_SOURCE_SET_MISMATCH"), (F.col("unavailable"), "POLICY_SOURCE_UNAVAILABLE"),
        (F.col("security"), "POLICY_SOURCE_SECURITY_REJECTED"), (F.col("untrusted"), "POLICY_SOURCE_UNTRUSTED")), F.col("evidence_codes"))
    rows = rows.withColumns({"application_status": status, "_hard": hard, "_shut": shut})
    named = {"CLOSED": "POLICY_CLOSED", "BUDGET_EXHAUSTED": "POLICY_BUDGET_EXHAUSTED", "SCHEDULED": "POLICY_NOT_YET_OPEN", "STATUS_UNCONFIRMED": "POLICY_STATUS_UNCONFIRMED"}
    advice = codes(*[(F.col("application_status") == k, v) for k, v in named.items()], (budget.isin("UNKNOWN", "BUDGET_UNKNOWN"), "POLICY_BUDGET_UNKNOWN"))
    valid = F.when(F.size("_hard") > 0, "REJECTED").when(F.col("_shut"), "CLOSED").when(F.size("semantic_codes") > 0, "PARTIALLY_VALIDATED").otherwise("VALIDATED")
    return rows.withColumns({
        "validation_status": valid, "recommendation_codes": F.array_sort(advice),
        "failure_codes": F.array_sort(F.array_distinct(F.concat("_hard", "semantic_codes")))}).drop("_hard", "_shut")


# Numeric terms, their unit and the code of a quoted but absent value.
TERMS = [("limit_krw", "KRW", "POLICY_FIELD_VALUE_MISSING"), ("annual_rate_percent", "PERCENT", "POLICY_REQUIRED_TERM_MISSING"),
         ("discount_pp", "PERCENTAGE_POINT", "POLICY_REQUIRED_TERM_MISSING"), ("grace_months", "MONTHS", "POLICY_REQUIRED_TERM_MISSING"),
         ("maturity_months", "MONTHS", "POLICY_REQUIRED_TERM_MISSING")]
CLOSED_WORDS = r"(?i)\b(?:applications? (?:are )?closed|application closed|closed program)\b|접수\s*마감"
EXHAUSTED_WORDS = r"(?i)\b(?:until funds? (?:are )?exhausted|budget exhausted)\b|예산소진시"


def term_evidence(rows: DataFrame) -> DataFrame:
    """rows(policy columns, quotes MAP<field, text>): codes of terms whose own quote does not carry the same number and
    unit. Won may stand before the number; years count as twelve months; numbers without a unit do not count."""
    token = lambda t: normalize_number(F.regexp_replace(F.trim(t), r"(?i)^krw\s*(.*)$", "$1 KRW"))
    quoted = lambda name: F.transform(F.regexp_extract_all(F.try_element_at("quotes", F.lit(name)), F.lit(NUMBERS_IN_TEXT), F.lit(0)), token)
    columns = rows.columns
    # the policies of a small file are one task's otherwise, and every code would read its numbers anew
    rows = rows.repartition("policy_id").withColumns({f"_{name}": F.filter(quoted(name), lambda n: n["value"].isNotNull()) for name, _, _ in TERMS})
    found = []
    for name, unit, missing in TERMS:
        quote, value, numbers = F.try_element_at("quotes", F.lit(name)), F.col(name), F.col(f"_{name}")
        same = (lambda n, u=unit, v=value: ((n["unit"] == u) & (n["value"] == v)) | (F.lit(u == "MONTHS") & (n["unit"] == "YEARS") & (n["value"] * 12 == v)))
        found += [(quote.isNotNull() & value.isNull(), missing), (quote.isNotNull() & value.isNotNull() & (F.size(numbers) == 0), "POLICY_NUMERIC_UNIT_AMBIGUOUS"),
                  *[(quote.isNotNull() & value.isNotNull() & (F.size(numbers) > 0) & ~_exists(numbers, same), code) for code in ("POLICY_FIELD_EVIDENCE_MISMATCH", "POLICY_FIELD_VALUE_OR_UNIT_MISMATCH")]]
    for name in ("app_start", "app_end"):
        quote = F.try_element_at("quotes", F.lit(name))
        found += [(quote.isNotNull() & F.col(name).isNull(), "POLICY_APPLICATION_STATUS_UNRESOLVED"),
                  (quote.isNotNull() & ~quote.contains(F.date_format(name, "yyyy-MM-dd")), "POLICY_FIELD_EVIDENCE_MISMATCH")]
    lien = F.try_element_at("quotes", F.lit("collateral"))
    found += [(lien.isNotNull() & F.col("collateral").isNull(), "POLICY_REQUIRED_TERM_MISSING"),
              (lien.isNotNull() & F.col("collateral").isNotNull() & ~lien.contains("collateral"), "POLICY_FIELD_EVIDENCE_MISMATCH")]
    everything = F.array_join(F.map_values("quotes"), "\n")
    found += [(everything.rlike(EXHAUSTED_WORDS) & ~F.col("budget_status").isin("EXHAUSTED", "UNTIL_EXHAUSTED", "CLOSED"), "POLICY_BUDGET_STATUS_MISMATCH")]
    return rows.withColumn("semantic_codes", F.array_sort(F.array_distinct(codes(*found)))).withColumn("explicitly_closed", everything.rlike(CLOSED_WORDS)).select(*columns, "semantic_codes", "explicitly_closed")


def _exists(arr: Column, test) -> Column:
    return F.exists(arr, lambda n: test(n))


def context_check(rows: DataFrame, documents: DataFrame) -> DataFrame:
    """rows(policy_id, run_id, source_id, revision_id, asked_run_id) against the documents they
    were taken from."""
    out = rows.join(documents.select("source_id", F.col("revision_id").alias("stored")), "source_id", "left")
    code = F.when(F.col("run_id") != F.col("asked_run_id"), "CONTEXT_MISMATCH").when(
        F.col("stored").isNull() | (F.col("stored") != F.col("revision_id")), "SOURCE_REVISION_MISMATCH").otherwise("OK")
    return out.select("policy_id", code.alias("code"))


# ---- eligibility ---------------------------------------------------------------------------

# Comparable store fields, operators, business-size words.
NUMERIC_FIELDS = ["annual_revenue", "employee_count", "owner_age", "declared_revenue", "business_age_months"]
TEXT_FIELDS = ["store_id", "business_type_code", "business_start_date", "credit_band"]
OPERATORS = ["EQ", "NE", "IN", "NOT_IN", "GE", "GT", "LE", "LT", "EXISTS"]
SIZE_WORDS = ["sme", "smes", "small business", "small businesses", "micro business", "microenterprise", "중소기업", "소상공인"]


def prepare_conditions(conditions: Column) -> Column:
    """Conditions with everything that does not depend on the store worked out: done once per
    policy, before it meets its stores."""

    def ready(c: Column) -> Column:
        field, op = F.regexp_replace(c["field"], "^(store_profile\\.|store\\.)", ""), F.upper(c["op"])
        number = c["expected"].try_cast("double")
        numeric = field.isin(NUMERIC_FIELDS)
        broken = ~op.isin(OPERATORS) | (numeric & ~op.isin("IN", "NOT_IN", "EXISTS") & number.isNull())
        return F.struct(
            c["field"].alias("name"), field.alias("field"), op.alias("op"), c["expected"].alias("expected"), number.alias("number"), numeric.alias("numeric"),
            (~field.isin([*NUMERIC_FIELDS, *TEXT_FIELDS])).alias("unknown"), broken.alias("broken"),
            F.transform(F.split(c["expected"], ","), lambda x: F.trim(x)).alias("listed"),
            F.coalesce(~F.lower(c["expected"]).isin("false", "0", ""), F.lit(True)).alias("wanted"))

    return F.transform(conditions, ready)


def evaluate_conditions(conditions: Column, numbers: Column, texts: Column) -> Column:
    """struct(status, field) of the first condition that does not pass, in declared order.

    conditions ARRAY<STRUCT<field, op, expected>>; numbers/texts are maps of the store's fields."""
    return evaluate_prepared(prepare_conditions(conditions), numbers, texts)


def evaluate_prepared(rules: Column, numbers: Column, texts: Column) -> Column:
    def judge(c: Column) -> Column:
        number, text = F.try_element_at(numbers, c["field"]), F.try_element_at(texts, c["field"])
        missing = F.when(c["numeric"], number.isNull()).otherwise(text.isNull())
        op = c["op"]
        inside = F.when(c["numeric"], F.exists(c["listed"], lambda x: F.coalesce(x.try_cast("double") == number, F.lit(False)))).otherwise(F.array_contains(c["listed"], text))
        pick = lambda a, b: (
            F.when(op == "EQ", a == b).when(op == "NE", a != b).when(op == "GE", a >= b).when(op == "GT", a > b).when(op == "LE", a <= b).when(op == "LT", a < b))
        passed = F.when(op == "EXISTS", missing != c["wanted"]).when(op == "IN", inside).when(op == "NOT_IN", ~inside).when(
            c["numeric"], pick(number, c["number"])).otherwise(pick(text, c["expected"]))
        status = F.when(c["unknown"], "INVALID_RULE").when(missing & (op != "EXISTS"), "NEEDS_INFORMATION").when(c["broken"], "INVALID_RULE").when(
            F.coalesce(passed, F.lit(False)), "PASSED").otherwise("FAILED")
        return F.struct(status.alias("status"), c["name"].alias("field"))

    return F.get(F.filter(F.transform(rules, judge), lambda x: x["status"] != "PASSED"), F.lit(0))


def prepare_policies(policies: DataFrame) -> DataFrame:
    """Adds what eligibility needs of a policy alone: rules, region codes, trade lists."""
    trade = lambda c: F.filter(c, lambda x: ~F.replace(F.lower(fold_space(x)), F.lit("_"), F.lit(" ")).isin(SIZE_WORDS))
    return policies.withColumns({"rules": prepare_conditions(F.col("conditions")), "region_ids": region_ids(F.col("regions")),
                                 "include": trade("include"), "exclude": trade("exclude")})


def meet(found: DataFrame, stores: DataFrame, policies: DataFrame, counted: DataFrame | None = None) -> DataFrame:
    """Every found pair (store_id, policy_id) with its store's fields and its prepared policy. The store's few fields travel
    to the policies: rules, regions and trades are wide, and no pair carries them through a shuffle. `counted` has the
    keys of all pairs where those are cheaper to get, repeats included."""
    counted = found if counted is None else counted
    homes = dealt_join(found, stores, ["store_id"], F.col("policy_id"), counted)
    return dealt_join(homes, prepare_policies(policies), ["policy_id"], F.col("store_id"), counted)


def business_age_months(opened: Column, as_of: Column) -> Column:
    return F.greatest(F.lit(0), month_gap(as_of, opened))


def store_maps(as_of: Column, known: list[str]) -> tuple[Column, Column]:
    """A store's fields for its rules; owner_age and credit_band where the stores have them."""
    number = lambda c: c.cast("double")
    optional = lambda c: {c: F.col(c)} if c in known else {}
    numbers = F.create_map(*[x for k, v in {
        "annual_revenue": F.col("annual_revenue"), "employee_count": F.col("employee_count"), "declared_revenue": F.col("declared_revenue"),
        **optional("owner_age"), "business_age_months": business_age_months(F.col("business_start_date"), as_of)}.items() for x in (F.lit(k), number(v))])
    texts = F.create_map(*[x for k, v in {
        "store_id": F.col("store_id").cast("string"), "business_type_code": F.col("business_type_code"), **optional("credit_band"),
        "business_start_date": F.date_format("business_start_date", "yyyy-MM-dd")}.items() for x in (F.lit(k), v)])
    return numbers, texts


def eligibility(pairs: DataFrame, as_of: Column) -> DataFrame:
    """First rule that decides each (store, policy) pair.

    pairs carry the store's fields, and of a policy out of `prepare_policies`: validation_status,
    application_status, budget_status, regions, region_ids, include, exclude, rules, app_start,
    app_end."""
    numbers, texts = store_maps(as_of, pairs.columns)
    match = region_codes_match(region_id(F.col("region_code")), F.col("regions"), F.col("region_ids"))
    pairs = pairs.select("*", F.explode(F.array(F.struct(evaluate_prepared(F.col("rules"), numbers, texts).alias("c"), match.alias("region")))).alias("_x"))
    pairs = pairs.withColumns({"_c": F.col("_x.c"), "_region": F.col("_x.region")}).drop("_x")
    shut_out = F.array_contains("exclude", F.col("business_type_code"))
    left_out = (F.size("include") > 0) & ~F.array_contains("include", F.col("business_type_code"))
    out = lambda status, reason: F.struct(F.lit(status).alias("status"), reason.alias("reason"))
    say = lambda status, reason: out(status, F.lit(reason))
    rule = (
        F.when(F.col("_region").isNull(), say("NEEDS_INFORMATION", "REGION_UNKNOWN")).when(~F.col("_region"), say("INELIGIBLE", "REGION"))
        .when(shut_out, say("INELIGIBLE", "INDUSTRY_EXCLUDED")).when(left_out, say("INELIGIBLE", "INDUSTRY_NOT_INCLUDED"))
        .when(F.col("_c.status") == "FAILED", out("INELIGIBLE", F.col("_c.field"))).when(F.col("_c").isNotNull(), out("NEEDS_INFORMATION", F.col("_c.field")))
        .otherwise(say("ELIGIBLE_ON_DECLARED_RULES", "ALL_PASSED")))
    app = F.col("application_status")
    result = (
        F.when(F.col("validation_status") == "CLOSED", say("CLOSED", "PROGRAM_CLOSED")).when(F.col("validation_status") != "VALIDATED", say("NOT_VALIDATED", "EVIDENCE"))
        .when(app.isin("BUDGET_EXHAUSTED", "SCHEDULED", "STATUS_UNCONFIRMED"), out_of(app)).when(F.upper("budget_status").isin("UNKNOWN", "BUDGET_UNKNOWN"), say("BUDGET_UNKNOWN", "BUDGET"))
        .when(F.col("app_end") < as_of, say("CLOSED", "PERIOD_ENDED")).when(F.col("app_start") > as_of, say("NOT_OPEN", "PERIOD_NOT_STARTED")).otherwise(rule))
    return pairs.select("*", F.explode(F.array(result)).alias("_e")).withColumn("status", F.col("_e.status")).withColumn("reason", F.col("_e.reason")).drop("_c", "_e", "_region")


def out_of(status: Column) -> Column:
    return F.struct(status.alias("status"), F.lit("APPLICATION_STATUS").alias("reason"))


# ---- benefit and rank ----------------------------------------------------------------------

METHODS = ["BULLET", "EQUAL_PRINCIPAL", "AMORTIZING"]


def policy_benefit(eligible: DataFrame, base: DataFrame, loans: DataFrame, gaps: DataFrame, horizon: int, forecast_start: Column) -> DataFrame:
    """Rerun of the baseline ledger under each eligible policy of a store.

    eligible(store_id, policy_id, policy_type, limit_krw, discount_pp, annual_rate_percent,
    grace_months, maturity_months, method, …); base is the store's baseline ledger, gaps its
    required_funding. Existing loans depend on a policy only through (discount, deferral), so
    they are repriced once per distinct pair of those and store, not once per policy."""
    deferral = F.col("policy_type") == "REPAYMENT_DEFERRAL"
    pairs = eligible.join(gaps.select("store_id", "required_funding"), "store_id")
    funding = F.least(F.coalesce("limit_krw", d(0)), F.col("required_funding"))
    drawn = (F.col("policy_type") == "LOAN_SUPPORT") & (funding > 0) & F.col("annual_rate_percent").isNotNull() & (F.col("maturity_months") > 0) & F.col("method").isin(METHODS)
    pairs = pairs.withColumns({
        "discount": F.coalesce("discount_pp", d(0)) / 100.0, "deferral": F.when(deferral, F.coalesce("grace_months", F.lit(0))).otherwise(F.lit(0)),
        "draw": F.when(drawn, funding).otherwise(d(0)), "cash_in": F.when(drawn | (F.col("policy_type") == "GRANT"), F.greatest(d(0), funding)).otherwise(d(0))})
    keys = ["store_id", "discount", "deferral"]
    terms = pairs.select(*keys).distinct()
    priced = salted_join(loans, terms, ["store_id"], F.col("loan_id"))
    priced = priced.withColumn("annual_rate", F.greatest(d(0), F.col("annual_rate") - F.col("discount"))).withColumn("grace_months", F.col("deferral"))
    needed = terms.join(base.select("store_id", "rate_delta", "month_index").distinct(), "store_id")
    service = debt_service(priced, needed, keys, forecast_start)
    fresh = pairs.filter("draw > 0").select(
        "store_id", "policy_id", F.col("draw").alias("principal"), F.greatest(d(0), F.col("annual_rate_percent") / 100.0 - F.col("discount")).alias("annual_rate"),
        F.lit("FIXED").alias("rate_type"), F.col("method").alias("repayment_type"), F.col("maturity_months").alias("remaining_months"), F.lit(None).cast("date").alias("next_payment_date"),
        F.lit(None).cast("date").alias("grace_end_date"), F.lit(None).cast("int").alias("renewal_month"), F.lit(None).cast("array<struct<principal:double,interest:double>>").alias("custom"),
        F.coalesce("grace_months", F.lit(0)).alias("new_grace"))
    new_loan = loan_schedule(fresh, F.lit(horizon), forecast_start, None, F.col("new_grace"), keep=["store_id", "policy_id"]).select(
        "store_id", "policy_id", "month_index", F.col("interest").alias("new_interest"), F.col("principal").alias("new_principal"))
    flows = base.select("store_id", "month_index", "month", "revenue", "variable_cost", "fixed_cost", "tax", "capex", "rate_delta", "current_cash", "min_cash",
                        F.col("interest").alias("base_interest"))
    rows = dealt_join(pairs.select("store_id", "policy_id", "discount", "deferral", "cash_in"), flows, ["store_id"], F.col("policy_id"), eligible)
    rows = rows.join(service, [*keys, "rate_delta", "month_index"], "left").join(new_loan, ["store_id", "policy_id", "month_index"], "left")
    total = lambda a, b: F.coalesce(a, d(0)) + F.coalesce(b, d(0))
    rows = rows.withColumns({"interest": total("interest", "new_interest"), "principal": total("principal", "new_principal")})
    ledger = cash_ledger(rows, ["store_id", "policy_id"], F.col("current_cash") + F.col("cash_in"))
    burn = cash_burn(ledger, ["store_id", "policy_id"], F.col("min_cash")).select("store_id", "policy_id", F.col("burn_date").alias("simulated_burn"))
    totals = ledger.groupBy("store_id", "policy_id").agg(
        F.sum("base_interest").alias("base_interest"), F.sum("interest").alias("simulated_interest"), F.max("month").alias("last_month"))
    base_burn = cash_burn(base, ["store_id"], F.col("min_cash")).select("store_id", F.col("burn_date").alias("original_burn"))
    out = totals.join(burn, ["store_id", "policy_id"]).join(base_burn, "store_id")
    days = F.when(F.col("original_burn").isNotNull(), F.datediff(F.coalesce("simulated_burn", F.date_add("last_month", 27)), "original_burn")).otherwise(0)
    return out.select("store_id", "policy_id", "original_burn", "simulated_burn", F.greatest(F.lit(0), days).alias("runway_extension_days"),
                      F.greatest(d(0), F.col("base_interest") - F.col("simulated_interest")).alias("interest_savings"))


def rank_policies(benefits: DataFrame, policies: DataFrame) -> DataFrame:
    """Score and rank per store. policies(policy_id, app_start, collateral, grace_months)."""
    rows = merge_join(benefits, policies.select("policy_id", "app_start", "collateral", "grace_months"), ["policy_id"])
    early = F.col("original_burn").isNotNull() & (F.col("app_start").isNull() | (F.col("app_start") <= F.col("original_burn")))
    score = (
        100.0 + F.when(early, d(20)).otherwise(d(0)) + F.least(d(30), F.col("runway_extension_days") / 3.0) + F.least(d(20), F.col("interest_savings") / 100000.0)
        - F.when(F.col("collateral"), d(10)).otherwise(d(0)) + F.least(d(10), F.coalesce(F.col("grace_months").cast("double"), d(0))))
    rows = rows.withColumn("score", score)
    rows = tie_safe(rows.withColumn("_s", F.round("score", 6)), ["store_id"], -F.floor(F.col("_s") * 100), F.col("_s"), F.col("policy_id"))
    return spread_rank(rows, ["store_id"], F.col("_fine"), [F.col("_s").desc(), F.col("policy_id")], "rank").drop("_s", "_fine")


def stage_counts(policies: DataFrame, results: DataFrame) -> DataFrame:
    """Counts per stage over all policies and all (store, policy) results."""
    tagged = policies.select(F.lit("P").alias("k"), F.col("validation_status").alias("s")).unionByName(results.select(F.lit("R").alias("k"), F.col("status").alias("s")))
    of = lambda k, s=None: F.count_if((F.col("k") == k) if s is None else (F.col("k") == k) & (F.col("s") == s))
    return tagged.agg(of("P").alias("extracted"), of("P", "VALIDATED").alias("validated"), of("P", "CLOSED").alias("closed"), of("R").alias("evaluated"),
                      of("R", "ELIGIBLE_ON_DECLARED_RULES").alias("eligible"))
