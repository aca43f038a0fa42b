"""Event candidates: checks, ordered validation gates, reconciliation, lifecycle."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tillwise.functions.core import code_list, codes, first_by, last_by, lookup, stable_id
from tillwise.functions.places import industry_relevance
from tillwise.functions.skew import neighbour, salted_join
from tillwise.functions.units import normalize_number
from tillwise.sources.registry import TIER_RANK

# Allowed domains and directions of a raw event row.
DOMAINS = ["MACRO", "INDUSTRY", "LOCAL", "POLICY"]
DIRECTIONS = ["POSITIVE", "NEGATIVE", "NEUTRAL", "-1", "0", "1"]
REQUIRED = ["event_id", "domain", "event_family", "event_type", "direction", "start_date"]


def value_direction(rows: DataFrame) -> DataFrame:
    """rows(event_type, new_raw, old_raw, …, and optionally unit_raw): parsed values and whether they
    contradict the type. A candidate that states neither value nor unit has nothing to check."""
    out = rows.withColumn("_n", normalize_number(F.col("new_raw"))).withColumn("_o", normalize_number(F.col("old_raw")))
    new, old = F.col("_n.value"), F.col("_o.value")
    bad_old = F.col("old_raw").isNotNull() & (F.col("old_raw") != "") & old.isNull()
    contradiction = ((F.col("event_type") == "BASE_RATE_INCREASE") & (new <= old)) | (
        (F.col("event_type") == "BASE_RATE_DECREASE") & (new >= old))
    blank = lambda c: F.col(c).isNull() | (F.trim(c) == "")
    silent = blank("new_raw") & (blank("unit_raw") if "unit_raw" in rows.columns else F.lit(True))
    status = F.when(silent, "OK").when(new.isNull() | bad_old, "OFFICIAL_NUMERIC_UNIT_INVALID").when(
        contradiction, "OFFICIAL_VALUE_DIRECTION_CONTRADICTION").otherwise("OK")
    return out.withColumn("new_value", new).withColumn("previous_value", old).withColumn("status", status).drop("_n", "_o")


def schema_errors(rows: DataFrame) -> DataFrame:
    """Raw event rows (all text) with `errors`, the list of failed checks; missing fields stop."""
    blank = lambda c: F.coalesce(F.trim(F.col(c).cast("string")), F.lit("")) == ""
    missing = codes(*[(blank(c), "MISSING:" + c) for c in REQUIRED])
    day = lambda c: F.try_to_date(F.substring(F.trim(F.col(c)), 1, 10), "yyyy-MM-dd")
    end_given = ~blank("end_date")
    bad_date = day("start_date").isNull() | (end_given & day("end_date").isNull())
    rest = codes(
        (~F.upper("domain").isin(DOMAINS), "INVALID_DOMAIN"), (~F.upper("direction").isin(DIRECTIONS), "INVALID_DIRECTION"),
        (bad_date, "INVALID_DATE_FORMAT"), (~bad_date & end_given & (day("start_date") > day("end_date")), "INVALID_DATE_ORDER"))
    return rows.withColumn("errors", F.when(F.size(missing) > 0, missing).otherwise(rest))


def registry_errors(candidates: DataFrame, registry: DataFrame) -> DataFrame:
    """candidates(event_type, domain, family, impacts, attributes, …) with `registry_codes`.

    The registry is a fixed dimension of under a hundred rows."""
    out = candidates.join(registry, "event_type", "left")
    unknown = F.col("reg_domain").isNull()
    wrong_axis = F.exists("impacts", lambda i: (i["axis"] != F.col("reg_axis")))
    wrong_way = F.exists("impacts", lambda i: (i["axis"] != F.col("reg_axis")) | (i["direction"] != F.col("reg_direction")))
    wrong_mechanism = F.exists("impacts", lambda i: i["mechanism"] != F.col("reg_mechanism"))
    attribute = F.try_element_at(F.col("attributes"), F.col("required_attribute"))
    found = codes(
        ((F.col("family") != F.col("reg_family")) | (F.col("domain") != F.col("reg_domain")), "ENUM_NOT_ALLOWED"),
        (wrong_axis | wrong_way, "DIRECTION_MECHANISM_NOT_ALLOWED"), (wrong_mechanism, "MECHANISM_NOT_SUPPORTED"),
        (F.col("required_attribute").isNotNull() & (F.coalesce(attribute, F.lit("")) == ""), "MISSING_REQUIRED_FIELD"))
    return out.withColumn("registry_codes", F.when(unknown, F.array(F.lit("ENUM_NOT_ALLOWED"))).otherwise(F.array_sort(F.array_distinct(found))))


def overlaps(start: Column, end: Column, window_start: Column, window_end: Column) -> Column:
    return (F.coalesce(end, window_end) >= window_start) & (start <= window_end)


def month_overlap(start: Column, end: Column, month: Column) -> Column:
    """Share of the month's days that the event covers; an open end covers the rest."""
    first = F.greatest(month, start)
    last = F.least(F.last_day(month), F.coalesce(end, F.last_day(month)))
    return F.when(first > last, F.lit(0.0)).otherwise((F.datediff(last, first) + 1) / F.day(F.last_day(month)))


# Gate constants.
TERMINAL = ["PROMPT_INJECTION_DETECTED", "SOURCE_UNAVAILABLE", "FORECAST_WINDOW_NOT_OVERLAPPED", "OUTSIDE_SEARCH_RADIUS",
            "INDUSTRY_NOT_RELEVANT"]
PRICE_TYPES = ["WHOLESALE_PRICE_INCREASE", "WHOLESALE_PRICE_DECREASE"]
PRICE_CONTEXT_DAYS = 180
ONGOING = (r"(?i)\b(?:ongoing|remains? (?:in )?effect|still active|until further notice|currently active|effective immediately"
           r"|effective from)\b|현재\s*(?:진행|유지|시행)|계속\s*(?:진행|적용)|별도\s*해제시")
NEXT_DECISION = "(?i)next monetary[- ]policy decision"
BROAD_AREAS = "gangnam area|major tourist attractions|강남 일대|주요 관광지|강남 지역"
BASE_STAGES = ["DISCOVERED", "EXTRACTED"]


def validate_candidates(rows: DataFrame, window_start: Column, window_end: Column, as_of: Column) -> DataFrame:
    """The ordered gates over one wide row per candidate.

    rows: candidate columns plus what the gates need, already joined: numeric_code,
    source_missing, injected, registry_codes, all_other, evidence_codes, paths_missing, start,
    end (dates or NULL), start_failed, end_failed, published, quotes, next_decision, store_code,
    industries, domain, venues, venue_instance, address, area, lat, lon, distance_m, radius_m,
    geo_policy, temporal_policy. Gates that stop are tested first to last; the codes of the
    others add up."""
    quote_like = lambda pattern: F.exists("quotes", lambda q: q.rlike(pattern))
    hold_needs_next = F.col("end").isNull() & (F.col("event_type") == "BASE_RATE_HOLD") & quote_like(NEXT_DECISION)
    open_ok = (F.col("temporal_policy") != "BOUNDED") & quote_like(ONGOING)
    end = F.coalesce("end", F.when(hold_needs_next, F.col("next_decision")).when(open_ok, window_end))
    rows = rows.withColumn("end_used", end).withColumn("relevance", industry_relevance(F.col("store_code"), F.col("industries")))
    early = F.array_distinct(F.concat(
        codes((F.col("all_other"), "SOURCE_UNTRUSTED")), F.col("evidence_codes"), codes((F.col("paths_missing"), "MISSING_REQUIRED_FIELD"))))
    outside = (F.col("end_used") < window_start) | (F.col("start") > window_end)
    dated = codes((F.col("start") > F.col("end_used"), "DATE_RANGE_INVALID"), (outside, "FORECAST_WINDOW_NOT_OVERLAPPED"))
    located = F.col("lat").isNotNull() & F.col("lon").isNotNull()
    needs_place = F.col("geo_policy") == "LOCATION_REQUIRED"
    ambiguous = (F.col("domain") == "LOCAL") & (
        ((F.size("venues") > 1) & (F.coalesce("venue_instance", F.lit("")) == ""))
        | ((F.coalesce("address", F.lit("")) == "") & F.lower(F.coalesce("area", F.lit(""))).rlike(BROAD_AREAS)))
    place = codes(
        (F.col("relevance") == 0, "INDUSTRY_NOT_RELEVANT"), (ambiguous, "LOCATION_AMBIGUOUS"),
        (needs_place & ~located, "GEO_NOT_FOUND"),
        (needs_place & located & (F.col("distance_m") > F.col("radius_m")), "OUTSIDE_SEARCH_RADIUS"))
    one = lambda code: F.array(F.lit(code))
    plus = lambda code: F.concat(F.col("_early"), one(code))
    historic = F.col("event_type").isin(PRICE_TYPES) & (F.greatest("start", "published") < F.date_sub(as_of, PRICE_CONTEXT_DAYS))
    # a generator of one row keeps the optimizer from copying these lists into every later test
    lists = F.struct(early.alias("_early"), dated.alias("_dated"), F.concat(early, dated, place).alias("_all"))
    rows = rows.select("*", F.inline(F.array(lists)))
    step = lambda gate, status, found: F.struct(F.lit(gate).alias("gate"), status.alias("status"), found.alias("codes"))
    retry, reject, reference = F.lit("RETRYABLE"), F.lit("REJECTED"), F.lit("REFERENCE_ONLY")
    terminal = F.arrays_overlap("_all", F.array(*[F.lit(t) for t in TERMINAL]))
    late_status = F.when(F.array_contains("_all", "SOURCE_UNTRUSTED"), reference).when(terminal, reject).otherwise(retry)
    outcome = (
        F.when(F.col("numeric_code").isNotNull(), step("NUMERIC", retry, F.array("numeric_code")))
        .when(F.col("injected"), step("SECURITY", reject, one("PROMPT_INJECTION_DETECTED")))
        .when(F.col("source_missing"), step("SOURCE", reject, one("SOURCE_UNAVAILABLE")))
        .when(F.size("registry_codes") > 0, step("REGISTRY", retry, F.col("registry_codes")))
        .when(F.col("start_failed") | F.col("start").isNull() | F.col("end_failed"), step("DATE", retry, plus("DATE_PARSE_FAILED")))
        .when(historic, step("HISTORY", reference, plus("HISTORICAL_CONTEXT_ONLY")))
        .when(hold_needs_next & F.col("next_decision").isNull(), step("HOLD", reference, plus("BOK_BOUNDED_PERIOD_NEXT_DECISION_UNVERIFIED")))
        .when(F.col("end_used").isNull(), step("ONGOING", reference, plus("MISSING_ONGOING_EVIDENCE")))
        .when(outside, step("WINDOW", reject, F.concat("_early", "_dated")))
        .when(F.size("_all") > 0, step("FINAL", late_status, F.col("_all")))
        .otherwise(step("ACCEPTED", F.lit("ACCEPTED"), F.array().cast("array<string>"))))
    stage = lambda *names: F.array(*[F.lit(n) for n in (*BASE_STAGES, *names)])
    checked = ("VALIDATION_ATTEMPTED", "EVIDENCE_VALIDATED")
    gate = F.col("_o.gate")
    stages = (
        F.when(gate == "HISTORY", stage(*checked, "HISTORICAL_CONTEXT_RETAINED"))
        .when(gate == "ONGOING", stage(*checked, "TEMPORAL_EVIDENCE_INSUFFICIENT"))
        .when(gate == "WINDOW", stage(*checked, "TEMPORAL_VALIDATED", "OUTSIDE_FORECAST_WINDOW"))
        .when((gate == "FINAL") & (F.col("_o.status") == "REFERENCE_ONLY"), stage(*checked, "SOURCE_UNTRUSTED"))
        .when((gate == "FINAL") & F.array_contains("_o.codes", "OUTSIDE_SEARCH_RADIUS"), stage(*checked, "TEMPORAL_VALIDATED", "GEO_VALIDATED", "EXCLUDED_BY_DISTANCE"))
        .when(gate == "FINAL", stage(*checked, "TEMPORAL_VALIDATED", "VALIDATION_FAILED"))
        .when(gate == "ACCEPTED", stage(*checked, "TEMPORAL_VALIDATED", "GEO_VALIDATED", "INSTANCE_ELIGIBLE")).otherwise(stage()))
    out = rows.select("*", F.explode(F.array(outcome)).alias("_o")).withColumn("stages", stages)
    return out.withColumn("status", F.col("_o.status")).withColumn("failure_codes", F.array_sort(F.array_distinct("_o.codes"))) \
        .drop("_early", "_dated", "_all", "_o")


def event_fingerprint(*parts: Column) -> Column:
    return F.substring(F.sha2(F.concat_ws("|", *[F.coalesce(p.cast("string"), F.lit("")) for p in parts]), 256), 1, 24)


def deduplicate(events: DataFrame, order: list[str]) -> DataFrame:
    """First event per fingerprint with the number of independent reports; combines map-side."""
    rest = [c for c in events.columns if c != "fingerprint"]
    return events.groupBy("fingerprint").agg(
        first_by(F.struct(*rest), *[F.col(c) for c in order]).alias("x"), F.count("*").alias("independent_source_count")
    ).select("fingerprint", "x.*", "independent_source_count")


def reconcile(events: DataFrame) -> DataFrame:
    """Outcome per report of merging the reports of one fingerprint.

    events(event_id, fingerprint, start_date, end_date, address, source_tier, exempt). In id
    order each report meets the current base: same dates and place, or both exempt, merge, a
    higher tier takes over, an equal one conflicts, a lower one is set aside.

    A base changes only when a report of a higher rank disagrees, and there are four ranks; so a
    group has at most four bases. They are found by as many rounds of one aggregate, over the
    groups that disagree at all; then every report looks up its base. No task holds a group."""
    rank = lookup(TIER_RANK, F.col("source_tier"), F.lit(0))
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    place = F.concat_ws("|", text("start_date"), text("end_date"), text("address"))
    rows = events.select("event_id", "fingerprint", rank.alias("rank"), place.alias("place"), F.coalesce("exempt", F.lit(False)).alias("exempt"))
    entry = F.struct("event_id", "place", "rank", "exempt")
    differs = (F.col("place") != F.col("base.place")) & ~(F.col("exempt") & F.col("base.exempt"))
    groups = rows.groupBy("fingerprint").agg(F.min_by(entry, "event_id").alias("base"), (F.min("place") == F.max("place")).alias("same"), F.min("exempt").alias("all_exempt"))
    mixed = groups.filter("not same and not all_exempt").select("fingerprint", "base", F.array("base").alias("chain"))
    contested = salted_join(rows, mixed.select("fingerprint"), ["fingerprint"], F.col("event_id"))
    for _ in range(len(set(TIER_RANK.values())) - 1):
        met = salted_join(contested, mixed.select("fingerprint", "base"), ["fingerprint"], F.col("event_id"))
        over = differs & (F.col("rank") > F.col("base.rank")) & (F.col("event_id") > F.col("base.event_id"))
        after = met.filter(over).groupBy("fingerprint").agg(F.min_by(entry, "event_id").alias("next"))
        mixed = mixed.join(after, "fingerprint", "left").select(
            "fingerprint", F.coalesce("next", "base").alias("base"),
            F.when(F.col("next").isNull(), F.col("chain")).otherwise(F.concat("chain", F.array("next"))).alias("chain"))
    chains = groups.filter("same or all_exempt").select("fingerprint", F.array("base").alias("chain")).unionByName(mixed.select("fingerprint", "chain"))
    met = salted_join(rows, chains, ["fingerprint"], F.col("event_id"))
    mine = F.element_at(F.filter("chain", lambda c: c["event_id"] <= F.col("event_id")), -1)
    met = met.withColumn("base", mine).withColumn("final", F.element_at("chain", -1)["event_id"])
    is_base = F.col("event_id") == F.col("base.event_id")
    split = met.withColumn("is_base", is_base).withColumn("tie", differs & (F.col("rank") == F.col("base.rank")))
    contest = split.filter("tie and base.event_id = final").select("fingerprint").distinct().withColumn("contest", F.lit(True))
    merged = split.filter(~differs & (F.col("base.event_id") == F.col("final"))).groupBy("fingerprint").agg(F.count("*").alias("merged_reports"))
    bases = split.filter("is_base").join(contest, "fingerprint", "left").join(merged, "fingerprint", "left")
    base_rows = bases.select(
        "event_id", "fingerprint", F.col("final").alias("base_id"),
        F.when(F.col("event_id") != F.col("final"), "REFERENCE_ONLY").when(F.col("contest"), "CONFLICTED").otherwise("ACCEPTED").alias("status"),
        F.when((F.col("event_id") != F.col("final")) | F.col("contest"), "SOURCE_CONFLICT").alias("code"),
        F.when(F.col("event_id") == F.col("final"), F.col("merged_reports")).alias("merged_reports"))
    others = split.filter("not is_base").select(
        "event_id", "fingerprint", F.col("base.event_id").alias("base_id"),
        F.when(F.col("tie"), "CONFLICTED").otherwise("REFERENCE_ONLY").alias("status"),
        F.when(differs, "SOURCE_CONFLICT").otherwise("DUPLICATE_EVENT").alias("code"), F.lit(None).cast("bigint").alias("merged_reports"))
    return base_rows.unionByName(others)


def decision_lifecycle(decisions: DataFrame, keys: list[str], as_of: Column) -> DataFrame:
    """Current, superseded (until the day before the next distinct start) or future decision; only the current one
    emits signals.

    decisions(keys…, event_id, start_date, end_date). Works on one row per key and start date;
    a series' dates are few, its reports need not be."""
    days = decisions.groupBy(*keys, "start_date").agg(F.min("event_id").alias("day_first"), F.max("event_id").alias("day_last"))
    days = neighbour(days, keys, ["start_date"], F.year("start_date"), F.struct("start_date", "day_first"), "later", after=True)
    current = days.filter(F.col("start_date") <= as_of).groupBy(*keys).agg(last_by(F.col("day_last"), F.col("start_date")).alias("current_id"))
    out = decisions.join(days.select(*keys, "start_date", "later"), [*keys, "start_date"]).join(current, keys, "left")
    is_current = F.col("event_id") == F.col("current_id")
    status = F.when(is_current, "CURRENT_OFFICIAL_DECISION").when(F.col("later").isNotNull(), "SUPERSEDED_BY_LATER_DECISION") \
        .otherwise("FUTURE_OFFICIAL_DECISION")
    superseded = status == "SUPERSEDED_BY_LATER_DECISION"
    return out.select(
        *keys, "event_id", "start_date", F.when(superseded, F.date_sub("later.start_date", 1)).otherwise(F.col("end_date")).alias("end_date"),
        status.alias("lifecycle_status"), F.when(superseded, F.col("later.day_first")).alias("superseded_by"), is_current.eqNullSafe(True).alias("signal_enabled"),
        F.when(superseded, "SUPERSEDED").when(status == "FUTURE_OFFICIAL_DECISION", "NOT_EFFECTIVE_YET").alias("signal_reason"))


def assign_cause_groups(events: DataFrame, indicators: Column) -> DataFrame:
    """Cause group and whether an official indicator (array of ids) already covers the cause."""
    axis = F.col("impacts")[0]["axis"]
    key = F.when(axis == "INTEREST_COST", "INTEREST_RATE").when(axis == "INGREDIENT_COST", "FX_IMPORT_INGREDIENT").otherwise(F.col("event_id").cast("string"))
    supply = F.exists("impacts", lambda i: i["mechanism"].isin("SUPPLY_DISRUPTION", "SUPPLY_RECOVERY"))
    covered = ((key == "INTEREST_RATE") & F.exists(indicators, lambda x: x.contains("RATE"))) | (
        (key == "FX_IMPORT_INGREDIENT") & ~supply & F.exists(indicators, lambda x: x.rlike("FX|IMPORT_PRICE")))
    return events.withColumn("cause_group_id", stable_id("CAUSE-", 16, key)).withColumn("covered", covered) \
        .withColumn("signal_enabled", F.col("signal_enabled") & ~F.col("covered"))


def cause_group_v1(axis: Column, family: Column, event_id: Column) -> Column:
    """Version-1 cause groups by axis and family."""
    return F.when(axis.isin("INGREDIENT_COST", "IMPORT_COST") | (family == "EXCHANGE_RATE"), "CAUSE_GRP_FX_INGREDIENT").when(
        (axis == "INTEREST_COST") | (family == "MONETARY_POLICY"), "CAUSE_GRP_INTEREST_RATE").otherwise(
        F.concat(F.lit("CAUSE_GRP_"), F.coalesce(event_id.cast("string"), F.lit("UNKNOWN"))))


def event_lifecycle(events: DataFrame) -> DataFrame:
    """Terminal status and exclusion reason per candidate.

    events(candidate_id, status, failure_codes, stages, signal_enabled, signals, nonzero,
    interest_only, variable_debt)."""
    accepted = F.col("status") == "ACCEPTED"
    exposure = F.when(F.col("interest_only") & ~F.col("variable_debt"), "NO_VARIABLE_RATE_DEBT_EXPOSURE").otherwise("RELEVANT")
    far = F.array_contains("failure_codes", "OUTSIDE_SEARCH_RADIUS")
    terminal = (
        F.when(~accepted, F.when(far, "EXCLUDED_BY_DISTANCE").otherwise(F.col("status")))
        .when(~F.col("signal_enabled"), "VALIDATED_REFERENCE_ONLY").when(F.col("signals") == 0, "INSTANCE_ELIGIBLE")
        .when(F.col("nonzero") > 0, "FINANCIALLY_APPLIED").otherwise("SIGNAL_GENERATED"))
    reason = (
        F.when(~accepted, F.when(far, "OUTSIDE_SEARCH_RADIUS").otherwise(F.get("failure_codes", F.lit(0))))
        .when(~F.col("signal_enabled"), "SIGNAL_DISABLED_EVENT_TYPE")
        .when((F.col("signals") > 0) & (F.col("nonzero") == 0), exposure))
    add = lambda cond, name: F.when(cond, F.array(F.lit(name))).otherwise(F.array().cast("array<string>"))
    on = accepted & F.col("signal_enabled")
    base = F.array(*[F.lit(x) for x in (*BASE_STAGES, "VALIDATION_ATTEMPTED", "EVIDENCE_VALIDATED", "TEMPORAL_VALIDATED", "GEO_VALIDATED")])
    stages = F.when(accepted, F.concat(
        base, add(~F.col("signal_enabled"), "VALIDATED_REFERENCE_ONLY"), add(on, "INSTANCE_ELIGIBLE"),
        add(on & (F.col("signals") > 0), "SIGNAL_GENERATED"), add(on & (F.col("nonzero") > 0), "FINANCIALLY_APPLIED"))).otherwise(F.col("stages"))
    return events.withColumn("lifecycle_stages", stages).withColumn("terminal_status", terminal).withColumn("primary_exclusion_reason", reason)


def no_signal_reasons(rejected: DataFrame, runs: DataFrame) -> DataFrame:
    """Reason codes per run without any signal: the codes of its rejects plus the general one.

    rejected(run_id, failure_codes, signal_enabled); runs(run_id, access_failures)."""
    found = rejected.select("run_id", F.explode(F.concat("failure_codes", codes((~F.col("signal_enabled"), "SIGNAL_DISABLED_EVENT_TYPE")))).alias("code")).distinct()
    per_run = found.groupBy("run_id").agg(F.collect_list("code").alias("codes"))
    out = runs.join(per_run, "run_id", "left")
    extra = codes((F.lit(True), "NO_VALIDATED_SIGNAL_ELIGIBLE_EVENT"), (F.col("access_failures") > 0, "SOURCE_ACCESS_FAILURES"))
    return out.select("run_id", code_list(F.concat(extra, F.coalesce("codes", F.array().cast("array<string>")))).alias("reason_codes"))
