"""Official indicator observations: as-of control, frequency change, features, event bridge."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tillwise.functions.core import clip, d, day_name, first_by, last_by, lookup, stable_id
from tillwise.sources.registry import INDICATORS

# Role tokens in order of test, decay, caps per period and per horizon, role clips.
REVENUE_TOKENS = "RETAIL|SERVICE|CONSUM|SALES|CSI|CARD"
IMPORTED_TOKENS = "IMPORT|CUSTOMS|FX|USD_KRW"
DOMESTIC_TOKENS = "FOOD|INGREDIENT|CPI|PPI"
INTEREST_TOKENS = "RATE|COFIX|CD_|KORIBOR"
DECAY = 0.65
PERIOD_CAP = 0.05
HORIZON_CAPS = {"REVENUE_DEMAND": 0.10, "DOMESTIC_INGREDIENT_COST": 0.08, "IMPORTED_INGREDIENT_COST": 0.12,
                "INTEREST_RATE": 0.02, "UNMAPPED": 0.05}
ROLE_CLIPS = {"revenue": (0.90, 1.10), "ingredient": (0.85, 1.15), "domestic": (0.92, 1.08), "imported": (0.88, 1.12)}

ORDER = ("observed_at", "available_at", "observation_id")


def gate_as_of(observations: DataFrame, as_of: Column) -> DataFrame:
    """Adds `gate`: ACCEPTED, MISSING_RELEASE_METADATA or NOT_AVAILABLE_AS_OF_ANALYSIS_DATE.

    Dates are the feed's own local dates, stored at ingest, so no offset is lost here."""
    available = F.coalesce("available_at", "released_at")
    late = (F.col("observed_at") > as_of) | (F.col("released_at") > as_of) | (available > as_of)
    return observations.withColumn(
        "gate", F.when(F.col("released_at").isNull(), "MISSING_RELEASE_METADATA")
        .when(late, "NOT_AVAILABLE_AS_OF_ANALYSIS_DATE").otherwise("ACCEPTED"))


def accepted_as_of(observations: DataFrame, as_of: Column) -> DataFrame:
    return gate_as_of(observations, as_of).filter(F.col("gate") == "ACCEPTED").drop("gate")


def max_age(indicator: Column, default: int) -> Column:
    return lookup({k: v[4] for k, v in INDICATORS.items()}, indicator, F.lit(default))


def freshness(observations: DataFrame, as_of: Column, default_age: int = 120) -> DataFrame:
    """Per indicator: newest observation, its age, and whether the whole series is stale."""
    out = observations.groupBy("indicator_id").agg(F.max("observed_at").alias("latest_observed_at"))
    age = F.datediff(as_of, "latest_observed_at")
    limit = max_age(F.col("indicator_id"), default_age)
    return out.select("indicator_id", "latest_observed_at", age.alias("age_days"), limit.alias("max_age_days"),
                      (age > limit).alias("is_stale"))


def mark_stale(observations: DataFrame, as_of: Column, default_age: int = 120) -> DataFrame:
    stale = freshness(observations, as_of, default_age).filter("is_stale").select("indicator_id", F.lit(True).alias("_s"))
    return observations.join(stale, "indicator_id", "left").withColumn(
        "quality_status", F.when(F.col("_s"), "STALE").otherwise(F.col("quality_status"))).drop("_s")


def to_monthly(observations: DataFrame, method: Column) -> DataFrame:
    """Daily rows become one row per indicator and month; other rows pass through.

    `method` (a column over indicator_id) is LAST, AVERAGE or VOLATILITY."""
    daily = observations.filter(F.col("frequency") == "DAILY").withColumn("method", F.upper(method))
    fields = [c for c in observations.columns if c not in ("indicator_id", "value", "frequency", "observed_at", "observation_id")]
    months = daily.groupBy("indicator_id", F.trunc("observed_at", "month").alias("month"), "method").agg(
        F.count("*").alias("days"), F.avg("value").alias("avg"), F.stddev_pop("value").alias("dev"),
        last_by(F.struct("value", "observation_id", *fields), *[F.col(c) for c in ORDER]).alias("last"))
    value = F.when(F.col("method") == "AVERAGE", F.col("avg")).when(F.col("method") == "VOLATILITY", F.col("dev")) \
        .otherwise(F.col("last.value"))
    made = months.select(
        stable_id("OBS-", 24, F.col("indicator_id"), day_name(F.col("month")), F.col("method"), F.col("days"),
                  F.col("last.observation_id")).alias("observation_id"),
        "indicator_id", value.alias("value"), F.lit("MONTHLY").alias("frequency"), F.col("month").alias("observed_at"),
        *[F.col("last." + c).alias(c) for c in fields])
    return observations.filter(F.col("frequency") != "DAILY").unionByName(made)


def latest_two(observations: DataFrame) -> DataFrame:
    """Per indicator the newest and the one before, by (observed, available, id).

    The rank filter is pushed below the shuffle, so each task forwards two rows per indicator."""
    newest = Window.partitionBy("indicator_id").orderBy(*[F.col(c).desc() for c in ORDER])
    ranked = observations.withColumn("_r", F.row_number().over(newest)).filter(F.col("_r") <= 2)
    pick = lambda n: F.max(F.when(F.col("_r") == n, F.struct("value", "observation_id", "observed_at", "available_at", "unit")))
    return ranked.groupBy("indicator_id").agg(pick(1).alias("latest"), pick(2).alias("previous"))


def latest_as_of(observations: DataFrame, as_of: Column) -> DataFrame:
    """As-of join side: the newest observation known on `as_of`, per indicator."""
    known = accepted_as_of(observations, as_of)
    best = last_by(F.struct("observation_id", "value", "unit", "observed_at", "available_at"), *[F.col(c) for c in ORDER])
    return known.groupBy("indicator_id").agg(best.alias("x")).select("indicator_id", "x.*")


def indicator_summary(observations: DataFrame, as_of: Column, default_age: int = 120) -> DataFrame:
    counts = observations.groupBy("indicator_id").agg(F.count("*").alias("observation_count"))
    change = F.col("latest.value") - F.col("previous.value")
    two = latest_two(observations)
    return two.join(counts, "indicator_id").join(freshness(observations, as_of, default_age), "indicator_id").select(
        "indicator_id", "observation_count", F.col("latest.observation_id").alias("latest_observation_id"),
        F.col("previous.observation_id").alias("previous_observation_id"), F.col("latest.value").alias("latest_value"),
        F.col("previous.value").alias("previous_value"), change.alias("absolute_change"),
        F.try_divide(change, F.abs("previous.value")).alias("percentage_change"), "latest_observed_at", "age_days",
        F.when(F.col("is_stale"), "STALE").otherwise("VALID").alias("freshness_status"))


def missing_indicators(requests: DataFrame, observations: DataFrame) -> DataFrame:
    """Requested and not delivered."""
    return requests.join(observations.select("indicator_id").distinct(), "indicator_id", "left_anti")


def bundle_status(requests: DataFrame, observations: DataFrame, errors: DataFrame) -> DataFrame:
    """Status per run. requests(run_id, indicator_id, required); errors(run_id, code)."""
    have = observations.select("run_id", "indicator_id").distinct().withColumn("_have", F.lit(True))
    asked = requests.join(have, ["run_id", "indicator_id"], "left").groupBy("run_id").agg(
        F.max(F.col("required") & F.col("_have").isNull()).alias("required_missing"),
        F.max(F.col("_have").isNull()).alias("missing"), F.count("_have").alias("delivered"))
    failed = errors.groupBy("run_id").agg(F.count("*").alias("error_count"))
    out = asked.join(failed, "run_id", "full")
    status = (
        F.when(F.col("missing").isNull(), "SKIPPED")
        .when(F.col("required_missing") & (F.col("delivered") == 0), "FAILED")
        .when(F.col("missing") | (F.coalesce("error_count", F.lit(0)) > 0), "PARTIAL").otherwise("COMPLETED"))
    return out.select("run_id", F.coalesce("delivered", F.lit(0)).alias("delivered"), status.alias("status"))


def role(indicator: Column) -> Column:
    name = F.upper(indicator)
    by_token = (
        F.when(name.rlike(REVENUE_TOKENS), "REVENUE_DEMAND").when(name.rlike(IMPORTED_TOKENS), "IMPORTED_INGREDIENT_COST")
        .when(name.rlike(DOMESTIC_TOKENS), "DOMESTIC_INGREDIENT_COST").when(name.rlike(INTEREST_TOKENS), "INTEREST_RATE")
        .otherwise("UNMAPPED"))
    return lookup({k: v[5] for k, v in INDICATORS.items()}, indicator, by_token)


def project_indicators(observations: DataFrame, forecast_start: Column, months: int) -> DataFrame:
    """Decayed, capped projection per (indicator, forecast month) from the last two valid values."""
    two = latest_two(observations.filter(F.col("quality_status") == "VALID")).withColumn("feature_role", role(F.col("indicator_id")))
    latest, prev = F.col("latest.value"), F.col("previous.value")
    delta = F.coalesce(latest - prev, d(0))
    raw = F.coalesce(F.try_divide(delta, F.abs(prev)), d(0))
    rows = (
        two.withColumn("delta", delta).withColumn("relative_change", raw)
        .withColumn("capped_change", clip(raw, -PERIOD_CAP, PERIOD_CAP))
        .withColumn("month_index", F.explode(F.sequence(F.lit(1), F.lit(months))))
        .withColumn("month", F.add_months(forecast_start, F.col("month_index") - 1))
    )
    decay = (1 - F.pow(d(DECAY), F.col("month_index"))) / (1 - DECAY)
    cap = lookup(HORIZON_CAPS, F.col("feature_role"))
    cumulative = F.greatest(-cap, F.least(cap, F.col("capped_change") * decay))
    is_rate = (F.col("feature_role") == "INTEREST_RATE") & F.col("previous").isNotNull()
    unit = F.upper("latest.unit")
    scale = F.when(unit.contains("PERCENT") | unit.isin("%", "PCT"), d(0.01)).otherwise(d(1))
    rate_cap = HORIZON_CAPS["INTEREST_RATE"]
    rows = rows.withColumn("cumulative_change", cumulative).withColumn(
        "interest_delta", F.when(is_rate, clip(F.col("delta") * decay * scale, -rate_cap, rate_cap)))
    rows = rows.withColumn(
        "projected_value", F.greatest(d(0), F.when(is_rate, latest + F.col("delta") * decay)
                                      .otherwise(latest * (1 + F.col("cumulative_change")))))
    return rows.select(
        "indicator_id", "feature_role", "month_index", "month", latest.alias("latest_value"), prev.alias("previous_value"),
        F.col("latest.observation_id").alias("latest_observation_id"),
        F.col("previous.observation_id").alias("previous_observation_id"), "delta", "relative_change", "capped_change",
        "cumulative_change", "interest_delta", "projected_value")


def contributions(projected: DataFrame) -> DataFrame:
    """Adds each indicator's share of its role's monthly change; every indicator of the role
    counts in the divisor, also one without a previous value."""
    per_role = Window.partitionBy("feature_role", "month_index")
    value = F.when(F.col("feature_role") == "INTEREST_RATE", F.coalesce("interest_delta", d(0))) \
        .when(F.col("feature_role") == "UNMAPPED", d(0)).otherwise(F.col("cumulative_change"))
    return projected.withColumn("contribution", value / F.count("*").over(per_role))


def monthly_features(projected: DataFrame) -> DataFrame:
    """One row per forecast month: multipliers per role and the interest delta."""
    mean = lambda *roles: F.coalesce(F.avg(F.when(F.col("feature_role").isin(*roles), F.col("cumulative_change"))), d(0))
    bounded = lambda name, *roles: clip(1 + mean(*roles), *ROLE_CLIPS[name])
    domestic, imported = "DOMESTIC_INGREDIENT_COST", "IMPORTED_INGREDIENT_COST"
    return projected.groupBy("month_index", "month").agg(
        bounded("revenue", "REVENUE_DEMAND").alias("revenue_index_multiplier"),
        bounded("ingredient", domestic, imported).alias("ingredient_multiplier"),
        bounded("domestic", domestic).alias("domestic_multiplier"),
        bounded("imported", imported).alias("imported_multiplier"),
        F.coalesce(F.avg("interest_delta"), d(0)).alias("interest_rate_delta"),
        F.count("*").alias("indicator_count"))


# Event types that restate an indicator.
BRIDGED = {"BASE_RATE_INCREASE": "BASE_RATE", "BASE_RATE_DECREASE": "BASE_RATE", "BASE_RATE_HOLD": "BASE_RATE"}
FOREIGN_ACTORS = "fomc|federal reserve|미국 연방"


def bridge_events(events: DataFrame, observations: DataFrame, as_of: Column) -> DataFrame:
    """Decision per bridged event: APPLIED, EXPIRED or INELIGIBLE with a reason.

    events(event_id, event_type, start_date, source_tier, actor, declared_indicator, value, unit,
    evidenced). A bridged value becomes the newest one for later events, which is the running
    maximum of earlier appliable start dates; it is carried per day, so that no task sees more
    than one row per indicator and day."""
    mapped = lookup(BRIDGED, F.col("event_type"))
    rows = events.withColumn("indicator_id", mapped).filter(F.col("indicator_id").isNotNull())
    identity = ["actor", "declared_indicator", "start_date", "event_type", "value", "unit"]
    fields = [c for c in rows.columns if c not in identity]
    rows = rows.groupBy(*identity).agg(first_by(F.struct(*fields), F.col("event_id")).alias("x")).select(*identity, "x.*")
    series = observations.filter(F.col("quality_status").isin("VALID", "REVISED")).groupBy("indicator_id").agg(
        last_by(F.struct("observed_at", "value", "unit"), *[F.col(c) for c in ORDER]).alias("s"))
    rows = rows.join(series, "indicator_id", "left")
    blocked = (
        F.when(F.col("source_tier") != "OFFICIAL_PRIMARY", "SOURCE_NOT_OFFICIAL_PRIMARY")
        .when(F.lower(F.coalesce("actor", F.lit(""))).rlike(FOREIGN_ACTORS), "ACTOR_NOT_AUTHORIZED_FOR_BASE_RATE")
        .when(F.coalesce("declared_indicator", "indicator_id") != F.col("indicator_id"), "INDICATOR_MISMATCH")
        .when(F.col("value").isNull() | F.col("unit").isNull() | ~F.col("evidenced"), "VALUE_OR_UNIT_NOT_EXPLICITLY_EVIDENCED")
        .when(F.col("s").isNull(), "NO_OFFICIAL_BASELINE_OBSERVATION")
        .when(F.upper("s.unit") != F.upper("unit"), "UNIT_MISMATCH"))
    rows = rows.withColumn("blocked", blocked)
    can_apply = F.col("blocked").isNull() & (F.col("start_date") > F.col("s.observed_at")) & (F.col("start_date") <= as_of)
    rows = rows.withColumn("can_apply", can_apply)
    # first appliable event of a day wins the day; later ones of the same day have caught up
    firsts = rows.filter("can_apply").groupBy("indicator_id", "start_date").agg(
        F.min("event_id").alias("day_first"), first_by(F.col("value"), F.col("event_id")).alias("day_value"))
    before = Window.partitionBy("indicator_id").orderBy("start_date")
    days = rows.groupBy("indicator_id", "start_date").agg(F.count("*").alias("_n")).join(
        firsts, ["indicator_id", "start_date"], "left")
    carried = F.last(F.when(F.col("day_first").isNotNull(), F.struct("start_date", "day_value")), ignorenulls=True)
    days = days.withColumn("prior", carried.over(before.rowsBetween(Window.unboundedPreceding, -1))).drop("_n")
    rows = rows.join(days, ["indicator_id", "start_date"], "left")
    taken = F.col("day_first").isNotNull() & (F.col("event_id") > F.col("day_first"))
    latest_at = F.when(taken, F.col("start_date")).otherwise(F.coalesce("prior.start_date", "s.observed_at"))
    latest_value = F.when(taken, F.col("day_value")).otherwise(F.coalesce("prior.day_value", "s.value"))
    reason = (
        F.when(F.col("blocked").isNotNull(), F.col("blocked"))
        .when(F.col("start_date") <= latest_at, "OFFICIAL_SERIES_CAUGHT_UP")
        .when(F.col("start_date") > as_of, "EVENT_NOT_EFFECTIVE_AS_OF_ANALYSIS")
        .otherwise("NEWER_OFFICIAL_EVENT_BRIDGES_STALE_SERIES"))
    status = F.when(reason == "OFFICIAL_SERIES_CAUGHT_UP", "EXPIRED") \
        .when(reason == "NEWER_OFFICIAL_EVENT_BRIDGES_STALE_SERIES", "APPLIED").otherwise("INELIGIBLE")
    return rows.select(
        "event_id", "indicator_id", F.col("start_date").alias("effective_date"), "value", "unit",
        latest_at.alias("latest_official_observed_at"), latest_value.alias("latest_official_value"),
        status.alias("status"), reason.alias("reason_code"),
        F.when(status == "APPLIED", stable_id("OVR-", 20, F.col("event_id"), F.col("indicator_id"),
                                              day_name(F.col("start_date")), F.col("value"), F.col("unit")))
        .alias("synthetic_observation_id"))


def apply_bridge(observations: DataFrame, decisions: DataFrame) -> DataFrame:
    """Adds the temporary observations of the APPLIED decisions."""
    made = decisions.filter(F.col("status") == "APPLIED").select(
        F.col("synthetic_observation_id").alias("observation_id"), "indicator_id", "value", "unit",
        F.lit("DAILY").alias("frequency"), F.col("effective_date").alias("observed_at"),
        F.col("effective_date").alias("released_at"), F.col("effective_date").alias("available_at"),
        F.concat(F.lit("EVENT-"), F.col("event_id").cast("string")).alias("vintage_id"), F.lit("VALID").alias("quality_status"))
    return observations.unionByName(made, allowMissingColumns=True)


def quarantine_conflicts(claims: DataFrame, observations: DataFrame, as_of: Column) -> DataFrame:
    """Text-derived values that disagree with the newest official one.

    claims(claim_id, indicator_id, value)."""
    valid = observations.filter(~F.col("quality_status").isin("REJECTED", "STALE"))
    latest = valid.filter(F.col("observed_at") <= as_of).groupBy("indicator_id").agg(
        last_by(F.struct("value", "observation_id"), *[F.col(c) for c in ORDER]).alias("o"))
    out = claims.join(latest, "indicator_id", "left")
    conflict = F.col("o.value").isNotNull() & (F.abs(F.col("value") - F.col("o.value")) > 1e-9)
    return out.select("claim_id", "indicator_id", "value", F.col("o.value").alias("official_value"),
                      F.when(conflict, "BOK_RATE_OFFICIAL_DATA_CONFLICT").otherwise("RETAINED").alias("status"))

