"""Programs behind policy notices: identity, grouping of equivalent notices, merging, lineage and conflicts.

A notice states some of a program's terms. Two notices of one block (source authority, name key, policy type) are
equivalent if no term that both state differs. Terms travel as a sorted array of (key, value), so that any number of
conditions can be compared like the fixed fields, and equal statements are placed once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tillwise.functions.core import codes, let
from tillwise.functions.places import region_ids
from tillwise.functions.skew import neighbour, salted_join
from tillwise.functions.stages import new_stage
from tillwise.functions.text import fold_space
from tillwise.functions.urls import governing_authority, host_of
from tillwise.operators.policies import compact, name_key, policy_type, provider_key, purpose_key, status_class

#: (term, column) of the fields that are compared as they are stated
FIELDS = [("application_start", "app_start"), ("application_end", "app_end"), ("limit_krw", "limit_krw"),
          ("interest_terms.annual_rate_percent", "annual_rate_percent"), ("interest_terms.rate_discount_percentage_points", "discount_pp"),
          ("guarantee_terms.coverage_ratio", "coverage_ratio"), ("guarantee_terms.guarantee_fee_percent", "fee_percent"),
          ("repayment_terms.principal_grace_months", "grace_months"), ("repayment_terms.maturity_months", "maturity_months")]
#: terms made from lists and labels
DERIVED = ["program_year", "region", "purpose", "industry_inclusions", "industry_exclusions", "application_status"]
CONDITION = "condition:"
BLOCK = ["authority", "name_key", "policy_type"]
OFFICIAL = ["OFFICIAL_PRIMARY", "OFFICIAL_SECONDARY", "OFFICIAL_LOCAL_GOV"]
REVISIONS = ["CORRECTION", "TERMINATION"]
#: list fields whose values are united, and the columns they come from
LISTS = ["purposes", "regions", "include", "exclude", "conditions", "source_ids", "failure_codes", "recommendation_codes"]
#: distinct statements of a sub-block that one row may hold
FOLD = 256


def _years(text: Column) -> Column:
    return F.array_sort(F.array_distinct(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit("(20[0-9]{2})"), F.lit(1))))


def _folded(values: Column) -> Column:
    names = F.transform(values, lambda v: F.lower(fold_space(v)))
    return F.array_sort(F.array_distinct(F.filter(names, lambda v: v != "")))


def condition_text(c: Column) -> Column:
    fold = lambda x: F.lower(fold_space(F.coalesce(x, F.lit(""))))
    return F.concat_ws(":", fold(c["field"]), fold(c["op"]), fold(c["expected"]))


def stated_terms(years: Column) -> Column:
    """The terms of a notice, sorted by key. An empty list, an unknown status and a null are not stated; of
    repeated conditions on one field the last counts."""
    listed = lambda values: F.nullif(F.array_join(values, ","), F.lit(""))
    status = status_class(F.upper("application_status"), F.col("notice_kind"))
    derived = [listed(years), listed(F.array_sort(region_ids(F.col("regions")))), F.nullif(purpose_key(F.array_join("purposes", " ")), F.lit("")),
               listed(_folded(F.col("include"))), listed(_folded(F.col("exclude"))), F.nullif(status, F.lit("UNKNOWN"))]
    fixed = [*zip(DERIVED, derived), *[(name, F.col(c).cast("string")) for name, c in FIELDS]]
    pairs = F.array(*[F.when(v.isNotNull(), F.struct(F.lit(k).alias("key"), v.alias("value"))) for k, v in fixed])
    split = F.transform("conditions", lambda c: let(condition_text(c), lambda t: F.struct(
        F.concat(F.lit(CONDITION), F.substring_index(t, ":", 1)).alias("key"), F.regexp_replace(t, "^[^:]*:", "").alias("value"))))
    last = let(split, lambda all_: F.filter(all_, lambda c, i: ~F.exists(F.slice(all_, i + 2, F.size(all_)), lambda later: later["key"] == c["key"])))
    return F.array_sort(F.concat(F.array_compact(pairs), F.coalesce(last, F.array().cast("array<struct<key:string,value:string>>"))))


def with_identity(policies: DataFrame, documents: DataFrame) -> DataFrame:
    """Adds authority, name_key, policy_type, years, terms and what ranks a notice among its equals: whether it names
    a year, its official sources and its latest publication.

    policies(policy_id, provider, name, policy_type, source_ids, quotes, ...); documents(source_id, url, title,
    source_type, published_at). The authority is that of the sources where they agree on one; then their only host;
    then the provider's key. Years come from the name and titles, or from the quotes where those name none. A source is
    often shared by many notices, so the documents' side is narrow and the join salted."""
    link = policies.select("policy_id", F.explode("source_ids").alias("source_id"))
    host = host_of(F.col("url"))
    docs = documents.select("source_id", F.nullif(compact(governing_authority(host)), F.lit("")).alias("_body"), F.nullif(host, F.lit("")).alias("_host"), _years(F.col("title")).alias("_named"),
                            F.col("source_type").isin(OFFICIAL).cast("int").alias("_official"), "published_at")
    found = salted_join(link, docs, ["source_id"], F.col("policy_id")).groupBy("policy_id").agg(
        F.min("_body").alias("_b0"), F.max("_body").alias("_b1"), F.min("_host").alias("_h0"), F.max("_host").alias("_h1"),
        F.array_distinct(F.flatten(F.collect_set("_named"))).alias("_named"), F.sum("_official").alias("official_sources"), F.max("published_at").alias("latest_published"))
    out = policies.join(found, "policy_id", "left")
    authority = F.when(F.col("_b0") == F.col("_b1"), F.col("_b0")).when(F.col("_h0") == F.col("_h1"), F.concat(F.lit("host:"), "_h0")).otherwise(provider_key(F.col("provider")))
    preferred = F.array_sort(F.array_distinct(F.concat(_years(F.col("name")), F.coalesce("_named", F.array().cast("array<string>")))))
    out = out.withColumns({
        "authority": authority, "name_key": name_key(F.col("name")), "policy_type": policy_type(F.col("policy_type")),
        "years": F.when(F.size(preferred) > 0, preferred).otherwise(_years(F.array_join("quotes", "\n"))),
        "year_named": F.size(preferred) > 0, "official_sources": F.coalesce("official_sources", F.lit(0)), "evidence_count": F.size("quotes")})
    return out.withColumn("terms", stated_terms(F.col("years"))).drop("_b0", "_b1", "_h0", "_h1", "_named")


# ---- grouping --------------------------------------------------------------------------------


def _compatible(profile: Column, terms: Column) -> Column:
    """No key of the map `terms` has another value in the map `profile`."""
    return F.size(F.map_filter(terms, lambda k, v: F.coalesce(F.try_element_at(profile, k) != v, F.lit(False)))) == 0


def _extended(profile: Column, terms: Column) -> Column:
    return F.map_concat(profile, F.map_filter(terms, lambda k, v: F.try_element_at(profile, k).isNull()))


def _fold(combos: DataFrame) -> DataFrame:
    """(sub, sig, group_id): first fit in one expression per sub-block of at most FOLD statements."""
    rows = combos.groupBy("sub").agg(F.array_sort(F.collect_list(F.struct("first_id", "sig", "terms"))).alias("list"))

    def place(state: Column, c: Column) -> Column:
        terms = F.map_from_entries(c["terms"])
        fits = let(terms, lambda t: F.array_position(F.transform(state["profiles"], lambda p: _compatible(p, t)), True))
        return let(F.struct(fits.alias("at"), terms.alias("t")), lambda x: F.struct(
            F.when(x["at"] == 0, F.array_append(state["profiles"], x["t"])).otherwise(
                F.transform(state["profiles"], lambda p, i: F.when(i == x["at"] - 1, _extended(p, x["t"])).otherwise(p))).alias("profiles"),
            F.array_append(state["picks"], F.when(x["at"] == 0, F.size(state["profiles"]) + 1).otherwise(x["at"].cast("int"))).alias("picks")))

    start = F.struct(F.array().cast("array<map<string,string>>").alias("profiles"), F.array().cast("array<int>").alias("picks"))
    rows = rows.withColumn("picks", F.aggregate("list", start, place, lambda s: s["picks"]))
    out = rows.select("sub", F.explode(F.arrays_zip("list", "picks")).alias("x")).select("sub", F.col("x.list.sig").alias("sig"), F.col("x.list.first_id").alias("first_id"), F.col("x.picks").alias("pick"))
    heads = out.groupBy("sub", "pick").agg(F.min("first_id").alias("group_id"))
    return out.join(heads, ["sub", "pick"]).select("sub", "sig", "group_id")


def _waves(combos: DataFrame) -> tuple[DataFrame | None, DataFrame]:
    """Places statements of the sub-blocks that hold more than FOLD of them, by rounds of aggregates, until no
    sub-block has more than FOLD left; what is left can only join later groups.

    Each sub-block works on its first unfinished group, known by the union of its terms. In a round all statements
    that the group already says join it; of those that it does not contradict the one with the smallest id
    extends it, as first fit would. Where none extends it, it is finished and the smallest id left starts the next."""
    left = new_stage(combos, "programs-left")
    placed = profiles = None
    while True:
        large = left.groupBy("sub").agg(F.count("*").alias("n"), F.min_by(F.struct("first_id", "terms"), "first_id").alias("seed")).where(F.col("n") > FOLD)
        groups = large.select("sub", F.col("seed.first_id").alias("group_id"), F.map_from_entries("seed.terms").alias("profile"))
        if profiles is not None:  # groups in the making go on, whatever is left; other sub-blocks start a group
            groups = groups.join(profiles.select("sub"), "sub", "left_anti").unionByName(profiles)
        groups = new_stage(groups, "programs-groups")
        if not groups.limit(1).count():
            return placed, left
        terms = F.map_from_entries("terms")
        met = left.join(groups, "sub").withColumn("fits", _compatible(F.col("profile"), terms)).withColumn("adds", F.size(_extended(F.col("profile"), terms)) > F.size("profile"))
        met = new_stage(met.where("fits").select("sub", "sig", "first_id", "terms", "group_id", "profile", "adds"), "programs-met")
        now = met.where("not adds").select("sub", "sig", "group_id")
        placed = now if placed is None else placed.unionByName(now)
        left = new_stage(left.join(now.select("sub", "sig"), ["sub", "sig"], "left_anti"), "programs-left")
        grown = met.where("adds").groupBy("sub").agg(F.min_by(F.struct("group_id", "profile", "terms"), "first_id").alias("x"))
        profiles = new_stage(grown.select("sub", F.col("x.group_id").alias("group_id"), _extended(F.col("x.profile"), F.map_from_entries("x.terms")).alias("profile")), "programs-profiles")


def group_programs(rows: DataFrame) -> DataFrame:
    """(policy_id, group_id): rows(policy_id, authority, name_key, policy_type, terms), each placed in id order in
    the first group of its block none of whose members contradicts it; group_id is the group's smallest policy id.

    Members never contradict each other, so a group is known by the union of its terms, and only distinct statements
    are placed. Terms that every statement of a block has split the block outright. Sub-blocks of at most FOLD
    statements are folded in one expression; larger ones shrink by rounds of aggregates first."""
    block = F.concat_ws("\x1f", *[F.coalesce(c, F.lit("")) for c in BLOCK])
    keyed = rows.select("policy_id", block.alias("block"), "terms").withColumn("sig", F.sha2(F.to_json(F.struct("block", "terms")), 256))
    combos = keyed.groupBy("sig").agg(F.first("block").alias("block"), F.first("terms").alias("terms"), F.min("policy_id").alias("first_id"))
    names = [*DERIVED, *[name for name, _ in FIELDS]]
    said = F.map_from_entries("terms")
    always = combos.groupBy("block").agg(*[F.min(F.try_element_at(said, F.lit(n)).isNotNull()).alias(f"_all_{i}") for i, n in enumerate(names)])
    always = always.select("block", F.array_compact(F.array(*[F.when(F.col(f"_all_{i}"), F.lit(n)) for i, n in enumerate(names)])).alias("always"))
    combos = salted_join(combos, always, ["block"], F.col("sig"))
    parts = F.to_json(F.filter("terms", lambda t: F.array_contains(F.col("always"), t["key"])))
    combos = combos.select(F.sha2(F.concat_ws("\x1f", "block", parts), 256).alias("sub"), "sig", "first_id", "terms")
    placed, left = _waves(combos)
    found = _fold(left)
    found = found if placed is None else placed.unionByName(found)
    return salted_join(keyed.select("policy_id", "sig"), found.select("sig", "group_id"), ["sig"], F.col("policy_id")).select("policy_id", "group_id")


# ---- merging ---------------------------------------------------------------------------------


def list_unions(rows: DataFrame) -> DataFrame:
    """(group_id, field, value, first_id, first_at): the ordered unique values of the list fields of each group's
    originals, ordered by the policy and position that state them first. A long table: a list may be as long as
    a group is large."""
    texts = [F.transform(F.col(c), condition_text) if c == "conditions" else F.col(c).cast("array<string>") for c in LISTS]

    def placed(name: str, values: Column) -> Column:
        found = F.transform(values, lambda v, i: F.struct(F.lit(name).alias("field"), v.alias("value"), i.alias("at")))
        return F.coalesce(found, F.array().cast("array<struct<field:string,value:string,at:int>>"))

    every = F.flatten(F.array(*[placed(c, t) for c, t in zip(LISTS, texts)]))
    long = rows.where(~F.col("notice_kind").isin(REVISIONS)).select("group_id", "policy_id", F.explode(every).alias("x"))
    first = F.min(F.struct("policy_id", "x.at")).alias("first")
    return long.groupBy("group_id", F.col("x.field").alias("field"), F.col("x.value").alias("value")).agg(first).select(
        "group_id", "field", "value", F.col("first.policy_id").alias("first_id"), F.col("first.at").alias("first_at"))


def _fingerprint(rows: DataFrame) -> DataFrame:
    """(group_id, fingerprint): a hash of what the originals of a group say together, whatever their order."""
    named = rows.select(
        "group_id", F.explode(F.filter(F.concat(
            F.array(*[F.struct(F.lit(n).alias("part"), F.col(c).cast("string").alias("value")) for n, c in
                      (("00", "authority"), ("01", "name_key"), ("02", "policy_type"), ("16", "collateral"), ("19", "method"))],
                    F.when(~F.exists("terms", lambda t: t["key"] == "application_status"), F.struct(F.lit("08").alias("part"), F.lit("UNKNOWN").alias("value")))),
            F.flatten(F.transform("terms", lambda t: let(F.get(F.array_compact(F.array(*[F.when(t["key"] == n, F.lit(p)) for n, p in _PARTS.items()])), F.lit(0)), lambda part: F.when(
                part.isin(_LISTED), F.transform(F.split(t["value"], ","), lambda v: F.struct(part.alias("part"), v.alias("value")))).otherwise(F.array(F.struct(
                    F.coalesce(part, F.lit("20")).alias("part"), F.when(part.isNull(), F.concat_ws(":", F.regexp_replace(t["key"], "^" + CONDITION, ""), t["value"])).otherwise(t["value"]).alias("value")))))))),
            lambda x: F.coalesce(x["value"], F.lit("")) != "")).alias("x"))
    parts = named.select("group_id", "x.part", "x.value").distinct().groupBy("group_id", "part").agg(F.array_join(F.array_sort(F.collect_list("value")), ",").alias("text"))
    texts = parts.groupBy("group_id").agg(F.map_from_entries(F.collect_list(F.struct("part", "text"))).alias("m"))
    material = F.concat_ws("|", *[F.coalesce(F.try_element_at("m", F.lit(f"{i:02d}")), F.lit("")) for i in range(21)])
    return texts.select("group_id", F.sha2(material, 256).alias("fingerprint"))


# place of each term in the fingerprint; those of lists count value by value
_PARTS = {"program_year": "03", "region": "04", "purpose": "05", "industry_inclusions": "06", "industry_exclusions": "07", "application_status": "08", "application_start": "09",
          "application_end": "10", "limit_krw": "11", "interest_terms.annual_rate_percent": "12", "interest_terms.rate_discount_percentage_points": "13",
          "guarantee_terms.coverage_ratio": "14", "guarantee_terms.guarantee_fee_percent": "15", "repayment_terms.principal_grace_months": "17", "repayment_terms.maturity_months": "18"}
_LISTED = ["03", "04", "05", "06", "07"]


def merged_originals(rows: DataFrame) -> DataFrame:
    """One row per group that has originals: rows are policies with identity and group_id.

    Scalar fields take the first value stated in id order (statuses the first that is known, else the primary's).
    The primary is the notice that names a year, has most official sources, most evidence, the latest
    publication and the smallest id. Differing validations leave SOURCE_CONFLICT and a softened status."""
    rows = rows.where(~F.col("notice_kind").isin(REVISIONS))
    key = F.col("policy_id")
    best = F.struct((~F.col("year_named")).alias("a"), (-F.col("official_sources")).alias("b"), (-F.col("evidence_count")).alias("c"),
                    (-F.coalesce(F.unix_timestamp("latest_published"), F.lit(0))).alias("d"), key.alias("e"))

    def first(c: str, unknown: list[str]) -> Column:
        known = F.col(c).isNotNull() & ~F.upper(F.col(c).cast("string")).isin(unknown) if unknown else F.col(c).isNotNull()
        return F.min_by(F.when(known, F.col(c)), F.when(known, key)).alias(c)

    signature = F.concat_ws("|", "validation_status", F.array_join(F.array_sort("failure_codes"), ","))
    soft = F.col("validation_status").isin("VALIDATED", "PARTIALLY_VALIDATED")
    scalars = [c for _, c in FIELDS] + ["method", "collateral"]
    out = rows.groupBy("group_id").agg(
        F.count("*").alias("members"), F.min_by("policy_id", best).alias("primary_id"), *[first(c, []) for c in scalars],
        first("budget_status", ["UNKNOWN", "BUDGET_UNKNOWN"]), first("application_status", ["UNKNOWN", "STATUS_UNCONFIRMED"]),
        F.min_by(F.struct("budget_status", "application_status", "validation_status"), best).alias("_own"),
        F.min(signature).alias("_s0"), F.max(signature).alias("_s1"), F.min(soft).alias("_soft"))
    mixed = F.col("_s0") != F.col("_s1")
    out = out.join(_fingerprint(rows), "group_id").withColumns({
        "budget_status": F.coalesce("budget_status", "_own.budget_status"), "application_status": F.coalesce("application_status", "_own.application_status"),
        "program_id": F.when(F.col("members") > 1, F.concat(F.lit("POL-"), F.upper(F.substring("fingerprint", 1, 24)))).otherwise(F.col("primary_id").cast("string")),
        "merge_group": F.when(F.col("members") > 1, F.concat(F.lit("PMG-"), F.upper(F.substring("fingerprint", 1, 20)))), "mixed": mixed,
        "validation_status": F.when(mixed & F.col("_soft"), "PARTIALLY_VALIDATED").when(mixed, "CONFLICTED").otherwise(F.col("_own.validation_status"))})
    return out.drop("_own", "_s0", "_s1", "_soft")


def lineage(rows: DataFrame, originals: DataFrame) -> DataFrame:
    """Corrections and terminations of each group in order of day (undated first) and id, each superseding the one
    before it and the first the merged program, where there is one: (policy_id, group_id, notice_kind, supersedes).

    The order is spread by (day, range of ids), so a group of any size, dated or not, is many small tasks."""
    day = F.coalesce("app_start", "app_end", F.lit("0001-01-01").cast("date"))
    revisions = rows.where(F.col("notice_kind").isin(REVISIONS)).withColumn("_day", day)
    out = neighbour(revisions, ["group_id"], ["_day", "policy_id"], F.struct("_day", F.floor(F.col("policy_id") / 4096).alias("part")), F.col("policy_id"), "_previous", after=False)
    out = salted_join(out, originals.select("group_id", "program_id"), ["group_id"], F.col("policy_id"), "left")
    return out.withColumn("supersedes", F.coalesce(F.col("_previous").cast("string"), "program_id")).drop("_previous", "_day", "program_id")


# ---- conflicts -------------------------------------------------------------------------------


def conflict_fields(rows: DataFrame) -> DataFrame:
    """(policy_id, field): the material fields in which another notice of the same authority and name states something
    else. A term is contested where its smallest and largest stated values differ, so no pairs are formed."""
    long = rows.select("policy_id", "authority", "name_key", F.explode(F.array_append("terms", F.struct(F.lit("policy_type").alias("key"), F.col("policy_type").alias("value")))).alias("t"))
    long = long.select("policy_id", F.sha2(F.concat_ws("\x1f", "authority", "name_key", "t.key"), 256).alias("at"), "t.key", "t.value").where(~F.col("key").isin("purpose", "industry_exclusions"))
    open_ = long.groupBy("at").agg(F.min("value").alias("lo"), F.max("value").alias("hi")).where("lo <> hi").select("at")
    named = F.when(F.col("key").startswith(CONDITION) | (F.col("key") == "industry_inclusions"), "eligible_business_category").otherwise(F.col("key"))
    # few rows per key on the right: a hot term is spread by policy
    return salted_join(long, open_, ["at"], F.col("policy_id")).select("policy_id", named.alias("field")).distinct()


def reconciled(rows: DataFrame, groups: DataFrame) -> DataFrame:
    """All programs and revisions after merging: (program_id, group_id, notice_kind, members, primary_id, supersedes,
    validation_status, failure_codes, conflicting_fields, ...terms). Codes and fields are sorted arrays.

    A row whose sources appear in any notice with conflicting terms is CONFLICTED, whichever notice that was."""
    rows = new_stage(rows.join(groups, "policy_id"), "programs-rows")
    merged = new_stage(merged_originals(rows), "programs-merged")
    none = F.array().cast("array<string>")
    revised = lineage(rows, merged)
    closed = (F.col("notice_kind") == "TERMINATION") & (F.size("failure_codes") == 0)
    terms = [c for _, c in FIELDS] + ["method", "collateral", "budget_status", "application_status"]
    head = ["program_id", "group_id", "notice_kind", "members", "primary_id", "supersedes", "merge_group", "validation_status", *terms]
    one = merged.withColumns({"notice_kind": F.lit("ORIGINAL"), "supersedes": F.lit(None).cast("string")}).select(*head, "mixed")
    two = revised.withColumns({"program_id": F.col("policy_id").cast("string"), "members": F.lit(1).cast("long"), "primary_id": F.col("policy_id"), "merge_group": F.lit(None).cast("string"),
                               "validation_status": F.when(closed, "CLOSED").otherwise(F.col("validation_status")), "mixed": F.lit(False)}).select(*head, "mixed")
    out = one.unionByName(two)
    # what each row of the result is made of: all originals of the group, or the revision itself
    original = ~F.col("notice_kind").isin(REVISIONS)
    member = rows.select(F.when(original, F.lit(None)).otherwise(F.col("policy_id")).alias("_rev"), "group_id", "policy_id", "source_ids", "failure_codes")
    contested = rows.select("policy_id", F.explode("source_ids").alias("source_id")).join(conflict_fields(rows), "policy_id").select("source_id", "field").distinct()
    touched = salted_join(member.select("_rev", "group_id", F.explode("source_ids").alias("source_id")).distinct(), contested, ["source_id"], F.col("group_id")).groupBy("group_id", "_rev").agg(
        F.array_sort(F.collect_set("field")).alias("conflicting_fields"))
    failed = member.select("_rev", "group_id", F.explode("failure_codes").alias("code")).groupBy("group_id", "_rev").agg(F.collect_set("code").alias("_codes"))
    none_yet = touched.select("group_id", "_rev", "conflicting_fields", F.lit(None).cast("array<string>").alias("_codes"))
    facts = none_yet.unionByName(failed.withColumn("conflicting_fields", F.lit(None).cast("array<string>"))).groupBy(F.col("group_id").alias("_group"), "_rev").agg(
        F.max("conflicting_fields").alias("conflicting_fields"), F.max("_codes").alias("_codes"))
    own = F.when(F.col("notice_kind").isin(REVISIONS), F.col("primary_id"))
    out = out.join(facts, (F.col("group_id") == F.col("_group")) & own.eqNullSafe(F.col("_rev")), "left")
    clash = F.size(F.coalesce("conflicting_fields", none)) > 0
    all_codes = F.concat(F.coalesce("_codes", none), codes((F.col("mixed") | clash, "SOURCE_CONFLICT")))
    return out.withColumns({
        "validation_status": F.when(clash, "CONFLICTED").otherwise(F.col("validation_status")), "failure_codes": F.array_sort(F.array_distinct(all_codes)),
        "conflicting_fields": F.coalesce("conflicting_fields", none)}).drop("_group", "_rev", "_codes", "mixed")
