"""Landed provider payloads to canonical rows: central-bank JSON, statistics JSON, customs XML,
public business registry. Nothing is guessed: a row that fails a check keeps a reject code."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tillwise.functions.core import lookup
from tillwise.sources.registry import INDICATORS

BANK_SCHEMA = ("struct<StatisticSearch:struct<row:array<struct<STAT_CODE:string,ITEM_CODE1:string,ITEM_CODE2:string,"
               "TIME:string,DATA_VALUE:string>>>,RESULT:struct<CODE:string>>")
STATISTICS_SCHEMA = ("array<struct<ORG_ID:string,TBL_ID:string,ITM_ID:string,C1_NM:string,PRD_SE:string,PRD_DE:string,"
                     "UNIT_NM:string,DT:string,LST_CHN_DE:string>>")

# The whole-country label, the total-row label and the unit label of the price index.
NATIONAL_LABEL = "전국"
TOTAL_LABEL = "총계"
PRICE_INDEX_UNIT_LABEL = "2020=100"
CUSTOMS_LAG_DAYS = 25


def period_month(text: Column) -> Column:
    """`YYYYMM` to the first of the month, NULL when malformed."""
    return F.when(text.rlike("^[0-9]{6}$"), F.try_to_date(F.concat(text, F.lit("01")), "yyyyMMdd"))


def month_end_plus(month: Column, days) -> Column:
    """Availability rule: the month's last day plus a lag, as the feed's local date."""
    return F.date_add(F.last_day(month), days)


def content_revision(prefix: str, period: Column, *fields: Column) -> Column:
    digest = F.sha2(F.to_json(F.struct(*fields)), 256)
    return F.concat(F.lit(prefix), period, F.lit("-"), F.upper(F.substring(digest, 1, 16)))


def _series(provider: str, position: int) -> dict:
    return {v[1]: (k if position < 0 else v[position]) for k, v in INDICATORS.items() if v[0] == provider}


def _first_code(*pairs: tuple[Column, str]) -> Column:
    """Code of the first condition that does not hold, null if all do."""
    return F.coalesce(*[F.when(~F.coalesce(ok, F.lit(False)), code) for ok, code in pairs])


def rejects(judged: DataFrame) -> DataFrame:
    """The rows of a judged feed that became no observation, with their `code`."""
    return judged.filter(F.col("code").isNotNull())


def judged_bank_rows(payloads: DataFrame) -> DataFrame:
    """payloads(payload STRING) of central-bank responses, one row per record with the `code` of what is
    wrong with it: an unknown series, a malformed period or a value that is no number."""
    rows = payloads.select(F.from_json("payload", BANK_SCHEMA).alias("p")) \
        .select(F.explode("p.StatisticSearch.row").alias("r")).select("r.*")
    series = F.concat_ws(":", *[F.when(F.col(c) != "", F.col(c)) for c in ("STAT_CODE", "ITEM_CODE1", "ITEM_CODE2")])
    rows = rows.withColumn("series", series).withColumn("indicator_id", lookup(_series("ECOS", -1), F.col("series")))
    rows = rows.withColumn("observed_at", period_month(F.col("TIME"))).withColumn("value", F.expr("try_cast(DATA_VALUE AS double)"))
    return rows.withColumn("code", _first_code(
        (F.col("indicator_id").isNotNull(), "SERIES_UNKNOWN"), (F.col("observed_at").isNotNull(), "PERIOD_INVALID"), (F.col("value").isNotNull(), "VALUE_INVALID")))


def bank_observations(payloads: DataFrame) -> DataFrame:
    """Observations of central-bank responses; `rejects(judged_bank_rows(…))` has the other records."""
    rows = judged_bank_rows(payloads).filter(F.col("code").isNull())
    lag = lookup(_series("ECOS", 3), F.col("series")).cast("int")
    available = month_end_plus(F.col("observed_at"), lag)
    names = sorted(["STAT_CODE", "ITEM_CODE1", "ITEM_CODE2", "TIME", "DATA_VALUE"])
    return rows.select(
        "indicator_id", "value", lookup(_series("ECOS", 2), F.col("series")).alias("unit"), F.lit("MONTHLY").alias("frequency"),
        "observed_at", available.alias("released_at"), available.alias("available_at"),
        F.concat(F.lit("SRC-ECOS-"), F.replace(F.replace(F.col("series"), F.lit(":"), F.lit("-")), F.lit("*"), F.lit("ALL"))).alias("source_id"),
        content_revision("ECOS-", F.col("TIME"), *[F.col(c) for c in names]).alias("source_revision_id"))


def judged_statistics_rows(rows: DataFrame) -> DataFrame:
    """Rows of the statistics office with the `code` of what is wrong with them."""
    region = F.when(F.trim("C1_NM") == NATIONAL_LABEL, "NATIONAL").otherwise("OTHER")
    series = F.concat_ws(":", "ORG_ID", "TBL_ID", "ITM_ID", region)
    digits = F.regexp_replace("LST_CHN_DE", "[^0-9]", "")
    squeeze = lambda c: F.regexp_replace(c, r"\s+", "")
    out = rows.withColumn("indicator_id", lookup(_series("KOSIS", -1), series)) \
        .withColumn("observed_at", period_month(F.col("PRD_DE"))) \
        .withColumn("available_at", F.when(F.length(digits) >= 8, F.try_to_date(F.substring(digits, 1, 8), "yyyyMMdd"))) \
        .withColumn("value", F.expr("try_cast(DT AS double)"))
    return out.withColumn("code", _first_code(
        (F.col("indicator_id").isNotNull(), "SERIES_UNKNOWN"), (F.col("PRD_SE") == "M", "FREQUENCY_UNKNOWN"), (squeeze(F.col("UNIT_NM")) == PRICE_INDEX_UNIT_LABEL, "UNIT_UNKNOWN"),
        (F.col("observed_at").isNotNull(), "PERIOD_INVALID"), (F.col("available_at").isNotNull(), "AVAILABILITY_MISSING"), (F.col("value").isNotNull(), "VALUE_INVALID")))


def statistics_observations(rows: DataFrame) -> DataFrame:
    """Observations of the statistics office; the last-change date is the availability date."""
    return judged_statistics_rows(rows).filter(F.col("code").isNull()).select(
        "indicator_id", "value", F.lit("INDEX_2020_100").alias("unit"), F.lit("MONTHLY").alias("frequency"), "observed_at",
        F.col("available_at").alias("released_at"), "available_at")


def read_customs_xml(spark: SparkSession, path: str) -> DataFrame:
    """Customs response files, one row per `item`, every field as text."""
    schema = "hsCode string, year string, impDlr string, impWgt string, expDlr string, expWgt string"
    return spark.read.format("xml").option("rowTag", "item").schema(schema).load(path)


def read_corpus(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Labelled or replay corpora: whole JSON documents under an explicit schema."""
    return spark.read.schema(schema).option("multiLine", True).json(path)


def judged_customs_rows(rows: DataFrame) -> DataFrame:
    """Customs rows with the `code` of what is wrong with them; totals are TOTAL_ROW."""
    number = lambda c: F.expr(f"try_cast(replace({c}, ',', '') AS double)")
    period = F.regexp_replace("year", "[.\\-]", "")
    code = F.trim("hsCode")
    out = rows.withColumn("observed_at", period_month(F.trim(period))).withColumn("v", number("impDlr")).withColumn("w", number("impWgt"))
    return out.withColumn("code", _first_code(
        (F.trim("year") != TOTAL_LABEL, "TOTAL_ROW"), ((code != "") & (code != "-"), "COMMODITY_MISSING"), (F.col("observed_at").isNotNull(), "PERIOD_INVALID"),
        (F.col("v") >= 0, "VALUE_INVALID"), (F.col("w") >= 0, "WEIGHT_INVALID")))


def customs_observations(rows: DataFrame) -> DataFrame:
    """Import value, weight and (for a positive weight) unit price per commodity and month."""
    out = judged_customs_rows(rows).filter(F.col("code").isNull())
    code = F.trim("hsCode")
    item = lambda name, unit, value: F.struct(F.concat(F.lit(name), code).alias("indicator_id"), value.alias("value"),
                                              F.lit(unit).alias("unit"))
    facts = F.array_compact(F.array(
        item("CUSTOMS_IMPORT_VALUE_USD_HS", "USD", F.col("v")),
        item("CUSTOMS_IMPORT_WEIGHT_KG_HS", "KG", F.col("w")),
        F.when(F.col("w") > 0, item("CUSTOMS_IMPORT_UNIT_PRICE_USD_PER_KG_HS", "USD_PER_KG", F.try_divide("v", "w")))))
    available = month_end_plus(F.col("observed_at"), CUSTOMS_LAG_DAYS)
    return out.select("observed_at", available.alias("available_at"), F.explode(facts).alias("f")).select(
        "f.*", F.lit("MONTHLY").alias("frequency"), "observed_at", F.col("available_at").alias("released_at"), "available_at")


def registry_records(rows: DataFrame) -> DataFrame:
    """Public business registry rows (all text) with `status` ACCEPTED or the first reject code."""
    lat, lon = F.expr("try_cast(lat AS double)"), F.expr("try_cast(lon AS double)")
    blank = lambda c: F.coalesce(F.trim(c), F.lit("")) == ""
    month = period_month(F.col("stdrYm"))
    code = (
        F.when(blank("bizesId") | blank("bizesNm"), "MISSING_REQUIRED_FIELD")
        .when(month.isNull(), "MISSING_REFERENCE_MONTH")
        .when(lat.isNull() | lon.isNull() | ~lat.between(-90, 90) | ~lon.between(-180, 180), "COORDINATES_INVALID")
        .when(blank("rdnmAdr") & blank("lnoAdr"), "ADDRESS_MISSING").otherwise("ACCEPTED"))
    return rows.select(
        F.col("bizesId").alias("business_id"), F.col("bizesNm").alias("business_name"), lat.alias("latitude"),
        lon.alias("longitude"), F.nullif(F.trim("rdnmAdr"), F.lit("")).alias("road_address"),
        F.nullif(F.trim("lnoAdr"), F.lit("")).alias("lot_address"), month.alias("reference_month"), code.alias("status"))


def provider_failure_code(http_status: Column, outcome: Column) -> Column:
    """Failure code of a landed response log row; NULL when the call succeeded."""
    return (
        F.when(http_status.isin(401, 403), "AUTHENTICATION_FAILED").when(http_status == 429, "RATE_LIMITED")
        .when(http_status != 200, F.concat(F.lit("HTTP_"), http_status.cast("string")))
        .when(outcome == "timeout", "TIMEOUT").when(outcome == "malformed", "MALFORMED_RESPONSE")
        .when(outcome == "error", "PROVIDER_FAILURE"))


def provider_errors(calls: DataFrame) -> DataFrame:
    """(run_id, indicator_id, code) of the calls that failed, for the status of their bundle. calls(run_id,
    indicator_id, http_status, outcome)."""
    found = calls.select("run_id", "indicator_id", provider_failure_code(F.col("http_status"), F.col("outcome")).alias("code"))
    return found.where("code is not null")
