"""Fixed registries: event types, coefficients, tiers, indicators, aliases."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

# Event type, domain, family, axis, mechanism, direction, required attribute,
# temporal policy, geo policy, severity, may emit signals.
EVENT_TYPES = [
    ("BASE_RATE_INCREASE", "MACRO", "MONETARY_POLICY", "INTEREST_COST", "POLICY_RATE_TRANSMISSION", "INCREASE", None, "BOUNDED_OR_ONGOING", "NATIONAL", 0.8, False),
    ("BASE_RATE_DECREASE", "MACRO", "MONETARY_POLICY", "INTEREST_COST", "POLICY_RATE_TRANSMISSION", "DECREASE", None, "BOUNDED_OR_ONGOING", "NATIONAL", 0.8, False),
    ("BASE_RATE_HOLD", "MACRO", "MONETARY_POLICY", "UNCERTAINTY", "POLICY_RATE_HOLD", "HOLD", None, "BOUNDED_OR_ONGOING", "NATIONAL", 0.8, False),
    ("KRW_DEPRECIATION", "MACRO", "FX_MARKET", "INGREDIENT_COST", "FX_IMPORT_COST_TRANSMISSION", "INCREASE", None, "BOUNDED_OR_ONGOING", "NATIONAL", 0.6, False),
    ("KRW_APPRECIATION", "MACRO", "FX_MARKET", "INGREDIENT_COST", "FX_IMPORT_COST_TRANSMISSION", "DECREASE", None, "BOUNDED_OR_ONGOING", "NATIONAL", 0.6, False),
    ("FX_VOLATILITY_ALERT", "MACRO", "FX_MARKET", "UNCERTAINTY", "FX_VOLATILITY", "INCREASE", None, "BOUNDED_OR_ONGOING", "NATIONAL", 0.6, True),
    ("IMPORT_INPUT_PRICE_INCREASE", "MACRO", "INPUT_MARKET", "INGREDIENT_COST", "IMPORT_PRICE_TRANSMISSION", "INCREASE", None, "BOUNDED_OR_ONGOING", "NATIONAL", 0.6, False),
    ("IMPORT_INPUT_PRICE_DECREASE", "MACRO", "INPUT_MARKET", "INGREDIENT_COST", "IMPORT_PRICE_TRANSMISSION", "DECREASE", None, "BOUNDED_OR_ONGOING", "NATIONAL", 0.6, False),
    ("INPUT_SUPPLY_DISRUPTION", "MACRO", "INPUT_MARKET", "INGREDIENT_COST", "SUPPLY_DISRUPTION", "INCREASE", None, "BOUNDED_OR_ONGOING", "NATIONAL", 0.6, True),
    ("INPUT_SUPPLY_RECOVERY", "MACRO", "INPUT_MARKET", "INGREDIENT_COST", "SUPPLY_RECOVERY", "DECREASE", None, "BOUNDED_OR_ONGOING", "NATIONAL", 0.6, True),
    ("OFFICIAL_OUTLOOK_UPGRADE", "MACRO", "MACRO_DEMAND", "REVENUE_DEMAND", "OFFICIAL_DEMAND_OUTLOOK", "INCREASE", None, "BOUNDED_OR_ONGOING", "NATIONAL", 0.4, True),
    ("OFFICIAL_OUTLOOK_DOWNGRADE", "MACRO", "MACRO_DEMAND", "REVENUE_DEMAND", "OFFICIAL_DEMAND_OUTLOOK", "DECREASE", None, "BOUNDED_OR_ONGOING", "NATIONAL", 0.4, True),
    ("FNB_DEMAND_INCREASE", "INDUSTRY", "INDUSTRY_DEMAND", "REVENUE_DEMAND", "INDUSTRY_DEMAND_CHANGE", "INCREASE", None, "BOUNDED_OR_ONGOING", "NATIONAL", 0.5, True),
    ("FNB_DEMAND_DECREASE", "INDUSTRY", "INDUSTRY_DEMAND", "REVENUE_DEMAND", "INDUSTRY_DEMAND_CHANGE", "DECREASE", None, "BOUNDED_OR_ONGOING", "NATIONAL", 0.5, True),
    ("INGREDIENT_SHORTAGE", "INDUSTRY", "INGREDIENT_SUPPLY", "INGREDIENT_COST", "SUPPLY_DISRUPTION", "INCREASE", None, "BOUNDED_OR_ONGOING", "NATIONAL", 0.7, True),
    ("INGREDIENT_SUPPLY_RECOVERY", "INDUSTRY", "INGREDIENT_SUPPLY", "INGREDIENT_COST", "SUPPLY_RECOVERY", "DECREASE", None, "BOUNDED_OR_ONGOING", "NATIONAL", 0.7, True),
    ("WHOLESALE_PRICE_INCREASE", "INDUSTRY", "INGREDIENT_SUPPLY", "INGREDIENT_COST", "WHOLESALE_PRICE_CHANGE", "INCREASE", None, "BOUNDED_OR_ONGOING", "NATIONAL", 0.7, False),
    ("WHOLESALE_PRICE_DECREASE", "INDUSTRY", "INGREDIENT_SUPPLY", "INGREDIENT_COST", "WHOLESALE_PRICE_CHANGE", "DECREASE", None, "BOUNDED_OR_ONGOING", "NATIONAL", 0.7, False),
    ("PLATFORM_FEE_INCREASE", "INDUSTRY", "PLATFORM_TERMS", "PLATFORM_COST", "PLATFORM_FEE_CHANGE", "INCREASE", "platform_name", "BOUNDED_OR_ONGOING", "NATIONAL", 0.7, True),
    ("PLATFORM_FEE_DECREASE", "INDUSTRY", "PLATFORM_TERMS", "PLATFORM_COST", "PLATFORM_FEE_CHANGE", "DECREASE", "platform_name", "BOUNDED_OR_ONGOING", "NATIONAL", 0.7, True),
    ("PLATFORM_TERMS_TIGHTEN", "INDUSTRY", "PLATFORM_TERMS", "PLATFORM_COST", "PLATFORM_TERMS_CHANGE", "INCREASE", "platform_name", "BOUNDED_OR_ONGOING", "NATIONAL", 0.7, True),
    ("PLATFORM_TERMS_EASE", "INDUSTRY", "PLATFORM_TERMS", "PLATFORM_COST", "PLATFORM_TERMS_CHANGE", "DECREASE", "platform_name", "BOUNDED_OR_ONGOING", "NATIONAL", 0.7, True),
    ("PLATFORM_SERVICE_OUTAGE", "INDUSTRY", "PLATFORM_TERMS", "REVENUE_DEMAND", "PLATFORM_OUTAGE", "DECREASE", "platform_name", "BOUNDED_OR_ONGOING", "NATIONAL", 0.7, True),
    ("REGULATION_TIGHTEN", "INDUSTRY", "INDUSTRY_REGULATION", "OPERATING_COST", "REGULATORY_COMPLIANCE_CHANGE", "INCREASE", None, "BOUNDED_OR_ONGOING", "NATIONAL", 0.6, True),
    ("REGULATION_EASE", "INDUSTRY", "INDUSTRY_REGULATION", "OPERATING_COST", "REGULATORY_COMPLIANCE_CHANGE", "DECREASE", None, "BOUNDED_OR_ONGOING", "NATIONAL", 0.6, True),
    ("PRODUCT_RECALL", "INDUSTRY", "INDUSTRY_REGULATION", "INGREDIENT_COST", "PRODUCT_RECALL", "INCREASE", "product_name", "BOUNDED_OR_ONGOING", "NATIONAL", 0.6, True),
    ("SALES_RESTRICTION", "INDUSTRY", "INDUSTRY_REGULATION", "REVENUE_DEMAND", "SALES_RESTRICTION", "DECREASE", None, "BOUNDED_OR_ONGOING", "NATIONAL", 0.6, True),
    ("PEDESTRIAN_FULL_CLOSURE", "LOCAL", "ACCESSIBILITY", "REVENUE_DEMAND", "PEDESTRIAN_ACCESS_RESTRICTION", "DECREASE", "closure_scope", "BOUNDED_OR_ONGOING", "LOCATION_REQUIRED", 1.0, True),
    ("PEDESTRIAN_PARTIAL_CLOSURE", "LOCAL", "ACCESSIBILITY", "REVENUE_DEMAND", "PEDESTRIAN_ACCESS_RESTRICTION", "DECREASE", "closure_scope", "BOUNDED_OR_ONGOING", "LOCATION_REQUIRED", 0.7, True),
    ("VEHICLE_ONLY_RESTRICTION", "LOCAL", "ACCESSIBILITY", "REVENUE_DEMAND", "VEHICLE_ACCESS_RESTRICTION", "DECREASE", "closure_scope", "BOUNDED_OR_ONGOING", "LOCATION_REQUIRED", 0.4, True),
    ("ROAD_FULL_CLOSURE", "LOCAL", "ACCESSIBILITY", "REVENUE_DEMAND", "ROAD_ACCESS_RESTRICTION", "DECREASE", "closure_scope", "BOUNDED_OR_ONGOING", "LOCATION_REQUIRED", 1.0, True),
    ("ROAD_PARTIAL_CLOSURE", "LOCAL", "ACCESSIBILITY", "REVENUE_DEMAND", "ROAD_ACCESS_RESTRICTION", "DECREASE", "closure_scope", "BOUNDED_OR_ONGOING", "LOCATION_REQUIRED", 0.7, True),
    ("PARKING_RESTRICTION", "LOCAL", "ACCESSIBILITY", "REVENUE_DEMAND", "PARKING_ACCESS_RESTRICTION", "DECREASE", "closure_scope", "BOUNDED_OR_ONGOING", "LOCATION_REQUIRED", 0.5, True),
    ("TRANSIT_SERVICE_DISRUPTION", "LOCAL", "TRANSIT", "REVENUE_DEMAND", "TRANSIT_ACCESS_CHANGE", "DECREASE", None, "BOUNDED_OR_ONGOING", "LOCATION_REQUIRED", 0.7, True),
    ("TRANSIT_SERVICE_IMPROVEMENT", "LOCAL", "TRANSIT", "REVENUE_DEMAND", "TRANSIT_ACCESS_CHANGE", "INCREASE", None, "BOUNDED_OR_ONGOING", "LOCATION_REQUIRED", 0.7, True),
    ("NEW_STATION_OPENING", "LOCAL", "TRANSIT", "REVENUE_DEMAND", "NEW_TRANSIT_ACCESS", "INCREASE", None, "BOUNDED_OR_ONGOING", "LOCATION_REQUIRED", 0.7, True),
    ("LOCAL_FESTIVAL", "LOCAL", "LOCAL_EVENT", "REVENUE_DEMAND", "LOCAL_FOOT_TRAFFIC_CHANGE", "INCREASE", None, "BOUNDED", "LOCATION_REQUIRED", 0.6, True),
    ("LARGE_GATHERING_EVENT", "LOCAL", "LOCAL_EVENT", "REVENUE_DEMAND", "LOCAL_FOOT_TRAFFIC_CHANGE", "INCREASE", None, "BOUNDED", "LOCATION_REQUIRED", 0.6, True),
    ("EVENT_CANCELLED", "LOCAL", "LOCAL_EVENT", "REVENUE_DEMAND", "LOCAL_FOOT_TRAFFIC_CHANGE", "DECREASE", None, "BOUNDED", "LOCATION_REQUIRED", 0.6, True),
    ("CONSTRUCTION_START", "LOCAL", "CONSTRUCTION", "REVENUE_DEMAND", "CONSTRUCTION_ACCESS_IMPACT", "DECREASE", None, "BOUNDED_OR_ONGOING", "LOCATION_REQUIRED", 0.7, True),
    ("CONSTRUCTION_SCOPE_EXPANSION", "LOCAL", "CONSTRUCTION", "REVENUE_DEMAND", "CONSTRUCTION_ACCESS_IMPACT", "DECREASE", None, "BOUNDED_OR_ONGOING", "LOCATION_REQUIRED", 0.9, True),
    ("CONSTRUCTION_END", "LOCAL", "CONSTRUCTION", "REVENUE_DEMAND", "CONSTRUCTION_ACCESS_RECOVERY", "INCREASE", None, "BOUNDED_OR_ONGOING", "LOCATION_REQUIRED", 0.5, True),
    ("MAJOR_FACILITY_OPENING", "LOCAL", "LOCAL_FACILITY", "REVENUE_DEMAND", "LOCAL_FOOT_TRAFFIC_CHANGE", "INCREASE", None, "ONGOING", "LOCATION_REQUIRED", 0.6, True),
    ("MAJOR_FACILITY_CLOSURE", "LOCAL", "LOCAL_FACILITY", "REVENUE_DEMAND", "LOCAL_FOOT_TRAFFIC_CHANGE", "DECREASE", None, "ONGOING", "LOCATION_REQUIRED", 0.6, True),
    ("COMPETITOR_OPENING", "LOCAL", "COMPETITION", "COMPETITION", "COMPETITOR_COUNT_CHANGE", "INCREASE", "business_type", "ONGOING", "LOCATION_REQUIRED", 0.5, True),
    ("COMPETITOR_CLOSURE", "LOCAL", "COMPETITION", "COMPETITION", "COMPETITOR_COUNT_CHANGE", "DECREASE", "business_type", "ONGOING", "LOCATION_REQUIRED", 0.5, True),
    ("DISASTER_WARNING", "LOCAL", "DISASTER", "UNCERTAINTY", "DISASTER_AREA_IMPACT", "INCREASE", None, "BOUNDED_OR_ONGOING", "ADMINISTRATIVE_AREA", 0.5, True),
    ("EVACUATION_ORDER", "LOCAL", "DISASTER", "REVENUE_DEMAND", "DISASTER_AREA_IMPACT", "DECREASE", None, "BOUNDED_OR_ONGOING", "ADMINISTRATIVE_AREA", 1.0, True),
    ("ACCESS_RESTRICTION", "LOCAL", "DISASTER", "REVENUE_DEMAND", "DISASTER_AREA_IMPACT", "DECREASE", None, "BOUNDED_OR_ONGOING", "ADMINISTRATIVE_AREA", 0.9, True),
    ("RECOVERY_DECLARED", "LOCAL", "DISASTER", "REVENUE_DEMAND", "DISASTER_RECOVERY", "INCREASE", None, "BOUNDED_OR_ONGOING", "ADMINISTRATIVE_AREA", 0.5, True),
    ("MINIMUM_WAGE_INCREASE", "POLICY", "POLICY_REGULATION", "OPERATING_COST", "REGULATORY_COST_CHANGE", "INCREASE", None, "ONGOING", "NATIONAL", 0.8, False),
    ("TAX_OR_FEE_INCREASE", "POLICY", "POLICY_REGULATION", "OPERATING_COST", "REGULATORY_COST_CHANGE", "INCREASE", None, "ONGOING", "NATIONAL", 0.8, False),
    ("TAX_OR_FEE_DECREASE", "POLICY", "POLICY_REGULATION", "OPERATING_COST", "REGULATORY_COST_CHANGE", "DECREASE", None, "ONGOING", "NATIONAL", 0.8, False),
    ("OPERATING_RESTRICTION", "POLICY", "POLICY_REGULATION", "REVENUE_DEMAND", "OPERATING_RESTRICTION", "DECREASE", None, "ONGOING", "NATIONAL", 0.8, False),
    ("OPERATING_RESTRICTION_EASE", "POLICY", "POLICY_REGULATION", "REVENUE_DEMAND", "OPERATING_RESTRICTION", "INCREASE", None, "ONGOING", "NATIONAL", 0.8, False),
]
EVENT_TYPE_COLUMNS = ("event_type string, reg_domain string, reg_family string, reg_axis string, reg_mechanism string, "
                      "reg_direction string, required_attribute string, temporal_policy string, geo_policy string, "
                      "severity double, signal_enabled boolean")

# Axis -> (beta, lower bound, upper bound) per scenario.
COEFFICIENTS = {
    "LOW_IMPACT": {
        "REVENUE_DEMAND": (0.03, -0.10, 0.10), "INGREDIENT_COST": (0.02, -0.08, 0.08),
        "PLATFORM_COST": (0.02, -0.08, 0.08), "OPERATING_COST": (0.02, -0.08, 0.08),
        "COMPETITION": (0.02, -0.08, 0.08), "UNCERTAINTY": (0.01, 0.0, 0.05), "INTEREST_COST": (0.002, -0.005, 0.005),
    },
    "HIGH_IMPACT": {
        "REVENUE_DEMAND": (0.08, -0.15, 0.15), "INGREDIENT_COST": (0.06, -0.15, 0.15),
        "PLATFORM_COST": (0.06, -0.15, 0.15), "OPERATING_COST": (0.05, -0.12, 0.12),
        "COMPETITION": (0.05, -0.12, 0.12), "UNCERTAINTY": (0.03, 0.0, 0.08), "INTEREST_COST": (0.005, -0.01, 0.01),
    },
}

# Evidence weight of a source tier, and its rank when notices disagree.
TIER_WEIGHT = {
    "OFFICIAL_PRIMARY": 1.0, "OFFICIAL_LOCAL_GOV": 1.0, "OFFICIAL_SECONDARY": 0.9, "FINANCIAL_INSTITUTION": 0.85,
    "MAJOR_NEWS_WITH_PRIMARY_CITATION": 0.75, "MULTIPLE_INDEPENDENT_NEWS": 0.65, "MAJOR_NEWS": 0.4,
    "INDUSTRY_ASSOCIATION": 0.5, "SINGLE_NEWS": 0.4, "COMMUNITY_OR_UNKNOWN": 0.0, "OTHER": 0.0,
}
TIER_RANK = {"OFFICIAL_PRIMARY": 5, "OFFICIAL_LOCAL_GOV": 5, "OFFICIAL_SECONDARY": 4, "FINANCIAL_INSTITUTION": 4,
             "MAJOR_NEWS": 2, "OTHER": 0}

# Version-1 severities, everything else 0.5.
SEVERITY_V1 = {"PEDESTRIAN_FULL_CLOSURE": 1.0, "PEDESTRIAN_PARTIAL_CLOSURE": 0.7, "VEHICLE_ONLY_RESTRICTION": 0.4,
               "EVENT_WITHOUT_DIRECT_MECHANISM": 0.0}

# Registered indicators (provider, series, unit, lag days, longest age, role).
INDICATORS = {
    "CUSTOMS_IMPORT_UNIT_PRICE_USD_PER_KG_HS0901110000": ("CUSTOMS", "ITEMTRADE:090111", "USD_PER_KG", 25, 120, "IMPORTED_INGREDIENT_COST"),
    "BASE_RATE": ("ECOS", "722Y001:0101000", "PERCENT", 10, 90, "INTEREST_RATE"),
    "USD_KRW": ("ECOS", "731Y004:0000001:0000100", "KRW_PER_USD", 10, 90, "IMPORTED_INGREDIENT_COST"),
    "IMPORT_PRICE_INDEX_USD": ("ECOS", "401Y015:*AA:D", "INDEX_2020_100", 20, 120, "IMPORTED_INGREDIENT_COST"),
    "CONSUMER_PRICE_INDEX": ("KOSIS", "101:DT_1J22003:T:NATIONAL", "INDEX_2020_100", 0, 120, "DOMESTIC_INGREDIENT_COST"),
}

# Organisation aliases.
ORGANISATIONS = {
    "한국은행": "ORG-BOK", "한은": "ORG-BOK", "Bank of Korea": "ORG-BOK", "The Bank of Korea": "ORG-BOK", "BOK": "ORG-BOK",
    "Monetary Policy Board of the Bank of Korea": "ORG-BOK", "통계청": "ORG-KOSTAT", "서울특별시": "ORG-SEOUL",
    "서울시": "ORG-SEOUL", "소상공인시장진흥공단": "ORG-SEMAS", "소진공": "ORG-SEMAS",
}
ORGANISATIONS_FOLDED = ["bank of korea", "the bank of korea", "b.o.k.", "bok",
                        "monetary policy board of the bank of korea", "한국은행", "한국 은행"]

# Industry words and the codes they stand for.
INDUSTRIES = {
    "음식점": ["FNB", "FNB_RESTAURANT"], "식당": ["FNB", "FNB_RESTAURANT"], "카페": ["FNB", "FNB_CAFE"],
    "커피": ["FNB", "FNB_CAFE"], "제과점": ["FNB", "FNB_BAKERY"], "FNB": ["FNB"],
}


def event_types(spark: SparkSession) -> DataFrame:
    """Event-type dimension: a fixed registry of under a hundred rows, safe to broadcast."""
    return spark.createDataFrame(EVENT_TYPES, EVENT_TYPE_COLUMNS)


def event_types_sql() -> str:
    """The same registry as a VALUES list for the oracle."""
    def lit(x):
        if x is None:
            return "NULL"
        if isinstance(x, bool):
            return "true" if x else "false"
        return f"'{x}'" if isinstance(x, str) else f"{x}::DOUBLE"

    rows = ", ".join("(" + ", ".join(lit(x) for x in t) + ")" for t in EVENT_TYPES)
    names = ", ".join(c.split()[0] for c in EVENT_TYPE_COLUMNS.split(", "))
    return f"SELECT * FROM (VALUES {rows}) t({names})"
