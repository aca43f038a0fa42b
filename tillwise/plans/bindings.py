"""How the test tables play the engine's inputs, in Spark and (as CTE text) in the oracle."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tillwise.functions.core import d
from tillwise.functions.stages import staged
from tillwise.plans.catalog import cte
from tillwise.sources import registry

HORIZON = 6
START = "2001-09-01"
AS_OF = "2001-08-31"


_SCHEMAS: dict = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A test table; its schema is read from the footers once per process."""
    path = f"{sf_dir}/{name}.parquet"
    if path not in _SCHEMAS:
        _SCHEMAS[path] = spark.read.parquet(path).schema
    return spark.read.schema(_SCHEMAS[path]).parquet(path)


def start() -> Column:
    return F.lit(START).cast("date")


def as_of() -> Column:
    return F.lit(AS_OF).cast("date")


def cents(c: str) -> Column:
    return F.floor(F.col(c) * 100.0 + 0.5).cast("bigint")


def store_count(spark: SparkSession, sf_dir: str) -> Column:
    return table(spark, sf_dir, "supplier").agg(2 * F.count("*")).scalar()


def store_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two stores for each supplier: 2k + 1 has its latest ledger months, 2k all earlier ones."""
    both = F.explode(F.array(F.lit(0), F.lit(1)))
    return table(spark, sf_dir, "supplier").select("s_suppkey", "s_acctbal", both.alias("_part")).select((2 * F.col("s_suppkey") + F.col("_part")).alias("store_key"), "s_acctbal")


# ---- stores and monthly ledger -------------------------------------------------------------

def stores(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("store_key")
    return store_keys(spark, sf_dir).select(
        k.alias("store_id"),
        F.element_at(F.array(*[F.lit(x) for x in ("FNB_CAFE", "FNB_RESTAURANT", "FNB_BAKERY", "RETAIL")]),
                     (k % 4 + 1).cast("int")).alias("business_type_code"),
        F.concat(F.lit("KR-"), (k % 25 + 10).cast("string")).alias("region_code"),
        (37.45 + ((k * 37) % 1000) / 10000.0).alias("lat"),
        (126.95 + ((k * 91) % 1000) / 10000.0).alias("lon"),
        (300000.0 + 50.0 * F.col("s_acctbal")).alias("current_cash"),
        d(100000).alias("min_cash"),
        F.when(k % 10 == 5, d(500000)).alias("declared_revenue"),
        ((k % 10) / 10.0).alias("imported_share"),
        ((k % 3) * 0.35).alias("variable_debt_share"),
        (F.col("s_acctbal") * 120.0).alias("annual_revenue"),
        F.when(k % 9 != 0, (k % 20).cast("int")).alias("employee_count"),
        F.date_add(F.lit("1990-01-01").cast("date"), ((k * 37) % 3000).cast("int")).alias("business_start_date"),
        F.when(k % 8 != 0, (19 + (k * 5) % 60).cast("int")).alias("owner_age"),
        F.when(k % 6 != 0, F.element_at(F.array(*[F.lit(x) for x in "ABC"]), (k % 3 + 1).cast("int"))).alias("credit_band"),
    )


cte("store_keys", "SELECT 2 * s_suppkey + part AS store_key, s_acctbal FROM supplier, (VALUES (0), (1)) v(part)")
cte("stores", """
SELECT store_key AS store_id,
  CASE store_key % 4 WHEN 0 THEN 'FNB_CAFE' WHEN 1 THEN 'FNB_RESTAURANT' WHEN 2 THEN 'FNB_BAKERY' ELSE 'RETAIL' END AS business_type_code,
  'KR-' || CAST(store_key % 25 + 10 AS VARCHAR) AS region_code,
  37.45::DOUBLE + ((store_key * 37) % 1000) / 10000.0::DOUBLE AS lat, 126.95::DOUBLE + ((store_key * 91) % 1000) / 10000.0::DOUBLE AS lon,
  300000.0::DOUBLE + 50.0::DOUBLE * s_acctbal AS current_cash, 100000.0::DOUBLE AS min_cash,
  CASE WHEN store_key % 10 = 5 THEN 500000.0::DOUBLE END AS declared_revenue,
  (store_key % 10) / 10.0::DOUBLE AS imported_share, (store_key % 3) * 0.35::DOUBLE AS variable_debt_share,
  s_acctbal * 120.0::DOUBLE AS annual_revenue,
  CASE WHEN store_key % 9 <> 0 THEN store_key % 20 END AS employee_count,
  DATE '1990-01-01' + CAST((store_key * 37) % 3000 AS INTEGER) AS business_start_date,
  CASE WHEN store_key % 8 <> 0 THEN 19 + (store_key * 5) % 60 END AS owner_age, CASE WHEN store_key % 6 <> 0 THEN (['A', 'B', 'C'])[store_key % 3 + 1] END AS credit_band
FROM store_keys""", "store_keys")


def history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Monthly ledger of every store, derived from the sales lines once per application."""
    return staged(spark, "history:" + sf_dir, lambda: derive_history(spark, sf_dir))


def derive_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every ledger month belongs to one history: a supplier's latest 3 to 42 months are one store's, so that
    every history length occurs, and all earlier ones another's."""
    li = table(spark, sf_dir, "lineitem").filter(F.col("l_shipdate") < F.lit(START).cast("timestamp"))
    disc = cents("l_discount")
    monthly = li.select(
        F.col("l_suppkey").alias("store_id"), F.trunc("l_shipdate", "month").alias("month"),
        (cents("l_extendedprice") * (100 - disc)).alias("net"), (cents("l_extendedprice") * disc).alias("off"),
        (cents("l_extendedprice") * cents("l_tax")).alias("tax"), F.col("l_quantity").cast("bigint").alias("qty"),
    ).groupBy("store_id", "month").agg(
        F.sum("net").alias("net"), F.sum("off").alias("off"), F.sum("tax").alias("tax"), F.sum("qty").alias("qty"),
        F.count("*").alias("tx_count"))
    latest = Window.partitionBy("store_id").orderBy(F.col("month").desc())
    keep = F.element_at(F.array(*[F.lit(x) for x in (3, 10, 14, 24, 42)]), (F.col("store_id") % 5 + 1).cast("int"))
    recent = F.row_number().over(latest) <= keep
    kept = monthly.withColumn("_part", recent.cast("int")).withColumn("store_id", 2 * F.col("store_id") + F.col("_part"))
    k = F.col("store_id")
    revenue = F.col("net").cast("double") / 10000.0
    return kept.select(
        "store_id", "month", revenue.alias("revenue"),
        (0.30 * revenue + 10.0 * F.col("qty")).alias("ingredients"),
        (F.col("off").cast("double") / 10000.0).alias("platform_fee"),
        (0.5 * (F.col("tax").cast("double") / 10000.0)).alias("payment_fee"),
        (60000.0 + (k % 10) * 25000.0).alias("rent"), d(40000).alias("labor"), d(15000).alias("utilities"),
        d(5000).alias("other"), (2000.0 + (k % 7) * 500.0).alias("tax"), ((k % 4) * 1000.0).alias("capex"), "tx_count")


cte("ledger_months", """
SELECT store_id, month, SUM(cents * (100 - disc))::BIGINT AS net, SUM(cents * disc)::BIGINT AS off_, SUM(cents * taxp)::BIGINT AS taxed,
  SUM(qty)::BIGINT AS qty, COUNT(*) AS tx_count
FROM (SELECT l_suppkey AS store_id, CAST(date_trunc('month', l_shipdate) AS DATE) AS month,
        CAST(floor(l_extendedprice * 100.0::DOUBLE + 0.5::DOUBLE) AS BIGINT) AS cents,
        CAST(floor(l_discount * 100.0::DOUBLE + 0.5::DOUBLE) AS BIGINT) AS disc,
        CAST(floor(l_tax * 100.0::DOUBLE + 0.5::DOUBLE) AS BIGINT) AS taxp, CAST(l_quantity AS BIGINT) AS qty
      FROM lineitem WHERE l_shipdate < TIMESTAMP '2001-09-01')
GROUP BY store_id, month""")
cte("history", """
SELECT store_id, month, net::DOUBLE / 10000.0::DOUBLE AS revenue,
  0.30::DOUBLE * (net::DOUBLE / 10000.0::DOUBLE) + 10.0::DOUBLE * qty AS ingredients,
  off_::DOUBLE / 10000.0::DOUBLE AS platform_fee, 0.5::DOUBLE * (taxed::DOUBLE / 10000.0::DOUBLE) AS payment_fee,
  60000.0::DOUBLE + (store_id % 10) * 25000.0::DOUBLE AS rent, 40000.0::DOUBLE AS labor, 15000.0::DOUBLE AS utilities,
  5000.0::DOUBLE AS other, 2000.0::DOUBLE + (store_id % 7) * 500.0::DOUBLE AS tax, (store_id % 4) * 1000.0::DOUBLE AS capex, tx_count
FROM (SELECT * REPLACE (2 * store_id + CAST(rn <= CASE store_id % 5 WHEN 0 THEN 3 WHEN 1 THEN 10 WHEN 2 THEN 14 WHEN 3 THEN 24 ELSE 42 END AS INTEGER) AS store_id)
      FROM (SELECT *, row_number() OVER (PARTITION BY store_id ORDER BY month DESC) AS rn FROM ledger_months))""", "ledger_months")
cte("last_month", """
SELECT * EXCLUDE (rn) FROM (SELECT *, row_number() OVER (PARTITION BY store_id ORDER BY month DESC) AS rn FROM history) WHERE rn = 1""",
    "history")


def overrides(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fixed-cost overrides, two entries per store and month so that the later one must win."""
    rows = store_keys(spark, sf_dir).select(
        F.col("store_key").alias("store_id"), F.explode(F.sequence(F.lit(0), F.lit(1))).alias("seq"))
    k = F.col("store_id")
    return rows.select(
        "store_id", "seq", F.add_months(start(), (k % 6).cast("int")).alias("month"),
        F.when(k % 2 == 0, "rent").otherwise("labor").alias("category"),
        (30000.0 + 1000.0 * (k % 11) + 500.0 * F.col("seq")).alias("amount"))


cte("overrides", """
SELECT store_key AS store_id, seq, CAST(DATE '2001-09-01' + to_months(CAST(store_key % 6 AS INTEGER)) AS DATE) AS month,
  CASE WHEN store_key % 2 = 0 THEN 'rent' ELSE 'labor' END AS category,
  30000.0::DOUBLE + 1000.0::DOUBLE * (store_key % 11) + 500.0::DOUBLE * seq AS amount
FROM store_keys, (VALUES (0), (1)) v(seq)""", "store_keys")


# ---- loans ---------------------------------------------------------------------------------

def loans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every order is a loan of one store."""
    k = F.col("o_orderkey")
    pay = F.struct((F.col("o_totalprice") * 0.000987182818).alias("principal"), (F.col("o_totalprice") * 0.000110971828).alias("interest"))
    return table(spark, sf_dir, "orders").select(
        (k % store_count(spark, sf_dir)).alias("store_id"), k.alias("loan_id"),
        (F.col("o_totalprice") * 0.010314159265).alias("principal"), (0.03 + (k % 7) / 100.0).alias("annual_rate"),
        F.when(F.col("o_orderstatus").isin("P", "O"), "VARIABLE").otherwise("FIXED").alias("rate_type"),
        F.element_at(F.array(*[F.lit(x) for x in ("BULLET", "EQUAL_PRINCIPAL", "AMORTIZING", "CUSTOM_SCHEDULE")]),
                     (k % 4 + 1).cast("int")).alias("repayment_type"),
        (3 + k % 30).cast("int").alias("remaining_months"),
        F.when(k % 5 == 0, F.date_add(start(), (k % 90).cast("int"))).alias("next_payment_date"),
        F.when(k % 11 == 0, F.date_add(start(), (k % 120).cast("int"))).alias("grace_end_date"),
        F.when(k % 3 != 0, (1 + k % 4).cast("int")).alias("renewal_month"),
        F.when(k % 4 == 3, F.array_repeat(pay, (2 + k % 8).cast("int"))).alias("custom"))


cte("loans", """
SELECT o_orderkey % (SELECT 2 * count(*) FROM supplier) AS store_id, o_orderkey AS loan_id, o_totalprice * 0.010314159265::DOUBLE AS principal,
  0.03::DOUBLE + (o_orderkey % 7) / 100.0::DOUBLE AS annual_rate,
  CASE WHEN o_orderstatus IN ('P','O') THEN 'VARIABLE' ELSE 'FIXED' END AS rate_type,
  CASE o_orderkey % 4 WHEN 0 THEN 'BULLET' WHEN 1 THEN 'EQUAL_PRINCIPAL' WHEN 2 THEN 'AMORTIZING' ELSE 'CUSTOM_SCHEDULE' END AS repayment_type,
  CAST(3 + o_orderkey % 30 AS INTEGER) AS remaining_months,
  CASE WHEN o_orderkey % 5 = 0 THEN DATE '2001-09-01' + CAST(o_orderkey % 90 AS INTEGER) END AS next_payment_date,
  CASE WHEN o_orderkey % 11 = 0 THEN DATE '2001-09-01' + CAST(o_orderkey % 120 AS INTEGER) END AS grace_end_date,
  CASE WHEN o_orderkey % 3 <> 0 THEN CAST(1 + o_orderkey % 4 AS INTEGER) END AS renewal_month,
  CASE WHEN o_orderkey % 4 = 3 THEN CAST(2 + o_orderkey % 8 AS INTEGER) END AS custom_n,
  o_totalprice * 0.000987182818::DOUBLE AS custom_principal, o_totalprice * 0.000110971828::DOUBLE AS custom_interest
FROM orders""")


LOAN_COLUMNS = ["store_id", "loan_id", "principal", "annual_rate", "rate_type", "repayment_type", "remaining_months",
                "next_payment_date", "grace_end_date", "renewal_month", "custom_n", "custom_principal", "custom_interest"]


def schedule_sql(source: str, name: str, delta: str = "0.01::DOUBLE", grace: str = "0", dated: bool = True,
                 extra: tuple[str, ...] = ()) -> str:
    """Recursive oracle of the repayment table over `source`, one level per forecast month."""
    fixed = ", ".join([*LOAN_COLUMNS, *extra])
    month = "strftime(DATE '2001-09-01' + to_months(CAST(m AS INTEGER)), '%Y-%m')"
    wait = f"coalesce({month} < strftime(next_payment_date, '%Y-%m'), false)" if dated else "false"
    held = f"coalesce({month} <= strftime(grace_end_date, '%Y-%m'), false)" if dated else "false"
    return f"""
SELECT {fixed}, 0 AS m, principal AS bal, 0 AS active, 0.0::DOUBLE AS opening, 0.0::DOUBLE AS interest, 0.0::DOUBLE AS paid,
  0.0::DOUBLE AS rate, 'OK' AS status FROM {source}
UNION ALL
SELECT {fixed}, m2, greatest(0.0::DOUBLE, bal - coalesce(paid2, 0.0::DOUBLE)), active2, greatest(0.0::DOUBLE, bal), interest2, paid2, rate2, status2
FROM (
  SELECT *, m + 1 AS m2, {wait} AS wait2, {held} AS held2,
    greatest(0.0::DOUBLE, annual_rate + CASE WHEN rate_type = 'VARIABLE' AND m2 >= coalesce(renewal_month, 1) THEN {delta} ELSE 0.0::DOUBLE END) AS rate2,
    (bal > 0 AND NOT wait2) AS live2, active + CAST(live2 AS INTEGER) AS active2, (live2 AND active2 <= remaining_months) AS pays2,
    rate2 / 12 AS mrate2, remaining_months - active2 + 1 AS left2, active2 = remaining_months AS last2,
    CASE repayment_type WHEN 'BULLET' THEN CASE WHEN last2 THEN bal ELSE 0.0::DOUBLE END
      WHEN 'EQUAL_PRINCIPAL' THEN least(bal, principal / remaining_months)
      WHEN 'AMORTIZING' THEN CASE WHEN last2 OR NOT pays2 THEN bal WHEN mrate2 = 0 THEN bal / left2
        ELSE least(bal, bal * mrate2 / (pow(1 + mrate2, left2) - 1)) END
      ELSE CASE WHEN active2 <= custom_n THEN custom_principal END END AS owed2,
    CASE WHEN NOT pays2 THEN 0.0::DOUBLE WHEN repayment_type = 'CUSTOM_SCHEDULE' THEN CASE WHEN active2 <= custom_n THEN custom_interest END
      ELSE bal * mrate2 END AS interest2,
    CASE WHEN NOT pays2 THEN 0.0::DOUBLE WHEN active2 <= {grace} OR held2 THEN owed2 * 0
      WHEN owed2 IS NOT NULL THEN least(owed2, bal) END AS paid2,
    CASE WHEN pays2 AND repayment_type = 'CUSTOM_SCHEDULE' AND active2 > custom_n THEN 'CUSTOM_SCHEDULE_MISSING' ELSE 'OK' END AS status2
  FROM {name} WHERE m < {HORIZON})"""


# ---- official observations -----------------------------------------------------------------

# product type -> indicator it stands for, unit, divisor of the price per piece
SERIES = {
    "ECONOMY": ("RETAIL_SALES_ECONOMY", "INDEX", 1.0), "STANDARD": ("CARD_SPEND_STANDARD", "INDEX", 1.0),
    "PROMO": ("USD_KRW", "KRW_PER_USD", 1.0), "SMALL": ("IMPORT_PRICE_INDEX_USD", "INDEX_2020_100", 10.0),
    "MEDIUM": ("CONSUMER_PRICE_INDEX", "INDEX_2020_100", 10.0), "LARGE": ("BASE_RATE", "PERCENT", 500.0),
}


def series_field(position: int, key: Column) -> Column:
    return F.create_map(*[F.lit(x) for k, v in SERIES.items() for x in (k, v[position])])[key]


def monthly_prices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Price and pieces by product type and month, derived once per application."""
    return staged(spark, "prices:" + sf_dir, lambda: derive_monthly_prices(spark, sf_dir))


def derive_monthly_prices(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem").select(
        "l_partkey", F.trunc("l_shipdate", "month").alias("month"), cents("l_extendedprice").alias("price"),
        F.col("l_quantity").cast("bigint").alias("qty"))
    per_part = li.groupBy("l_partkey", "month").agg(F.sum("price").alias("price"), F.sum("qty").alias("qty"))
    part = table(spark, sf_dir, "part").select("p_partkey", "p_type")
    return per_part.join(part, F.col("l_partkey") == F.col("p_partkey")).groupBy("p_type", "month").agg(
        F.sum("price").alias("price"), F.sum("qty").alias("qty"))


cte("monthly_prices", """
SELECT p_type, CAST(date_trunc('month', l_shipdate) AS DATE) AS month,
  SUM(CAST(floor(l_extendedprice * 100.0::DOUBLE + 0.5::DOUBLE) AS BIGINT))::BIGINT AS price, SUM(CAST(l_quantity AS BIGINT))::BIGINT AS qty
FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1, 2""")
cte("series", "SELECT * FROM (VALUES " + ", ".join(
    f"('{k}', '{i}', '{u}', {f}::DOUBLE)" for k, (i, u, f) in SERIES.items()) + ") t(p_type, indicator_id, unit, divisor)")


def monthly_observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = monthly_prices(spark, sf_dir)
    name = series_field(0, F.col("p_type"))
    late = F.date_add(F.last_day("month"), 10 * (1 + F.length(name) % 3))
    missing = (F.month("month") == 7) & (F.year("month") % 2 == 1)
    return m.select(
        F.concat(F.lit("OBS-"), F.upper(F.substring(F.sha2(F.concat_ws("|", name, F.date_format("month", "yyyy-MM-dd")), 256), 1, 24))).alias("observation_id"),
        name.alias("indicator_id"),
        (F.col("price").cast("double") / F.col("qty") / 100.0 / series_field(2, F.col("p_type"))).alias("value"),
        series_field(1, F.col("p_type")).alias("unit"), F.lit("MONTHLY").alias("frequency"), F.col("month").alias("observed_at"),
        F.when(~missing, late).alias("released_at"), late.alias("available_at"),
        F.concat(F.lit("VNT-"), (F.month("month") % 2).cast("string")).alias("vintage_id"), F.lit("VALID").alias("quality_status"))


def daily_observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    ev = table(spark, sf_dir, "events").groupBy("event_type", F.to_date("ts").alias("day")).agg(
        F.sum(cents("value")).alias("v"), F.count("*").alias("n"))
    name = F.concat(F.lit("DAILY_"), F.upper("event_type"))
    late = F.date_add("day", 1)
    return ev.select(
        F.concat(F.lit("OBS-"), F.upper(F.substring(F.sha2(F.concat_ws("|", name, F.date_format("day", "yyyy-MM-dd")), 256), 1, 24))).alias("observation_id"),
        name.alias("indicator_id"), (F.col("v").cast("double") / F.col("n") / 100.0).alias("value"), F.lit("INDEX").alias("unit"),
        F.lit("DAILY").alias("frequency"), F.col("day").alias("observed_at"), late.alias("released_at"), late.alias("available_at"),
        F.lit("VNT-D").alias("vintage_id"), F.lit("VALID").alias("quality_status"))


def observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return monthly_observations(spark, sf_dir).unionByName(daily_observations(spark, sf_dir))


cte("obs_monthly", """
SELECT 'OBS-' || upper(substr(sha256(indicator_id || '|' || strftime(month, '%Y-%m-%d')), 1, 24)) AS observation_id, indicator_id,
  price::DOUBLE / qty / 100.0::DOUBLE / divisor AS value, unit, 'MONTHLY' AS frequency, month AS observed_at,
  CASE WHEN NOT (month(month) = 7 AND year(month) % 2 = 1) THEN last_day(month) + CAST(10 * (1 + length(indicator_id) % 3) AS INTEGER) END AS released_at,
  last_day(month) + CAST(10 * (1 + length(indicator_id) % 3) AS INTEGER) AS available_at,
  'VNT-' || CAST(month(month) % 2 AS VARCHAR) AS vintage_id, 'VALID' AS quality_status
FROM monthly_prices JOIN series USING (p_type)""", "monthly_prices", "series")
cte("obs_daily", """
SELECT 'OBS-' || upper(substr(sha256('DAILY_' || upper(event_type) || '|' || strftime(day, '%Y-%m-%d')), 1, 24)) AS observation_id,
  'DAILY_' || upper(event_type) AS indicator_id, v::DOUBLE / n / 100.0::DOUBLE AS value, 'INDEX' AS unit, 'DAILY' AS frequency, day AS observed_at,
  day + 1 AS released_at, day + 1 AS available_at, 'VNT-D' AS vintage_id, 'VALID' AS quality_status
FROM (SELECT event_type, CAST(ts AS DATE) AS day, SUM(CAST(floor(value * 100.0::DOUBLE + 0.5::DOUBLE) AS BIGINT))::BIGINT AS v, COUNT(*) AS n
  FROM events GROUP BY 1, 2)""")
cte("obs", "SELECT * FROM obs_monthly UNION ALL SELECT * FROM obs_daily", "obs_monthly", "obs_daily")


# ---- dated notices -------------------------------------------------------------------------

NOTICE_TYPES = ["BASE_RATE_INCREASE", "FX_VOLATILITY_ALERT", "INPUT_SUPPLY_DISRUPTION", "OFFICIAL_OUTLOOK_DOWNGRADE", "PLATFORM_FEE_INCREASE",
                "REGULATION_TIGHTEN", "PEDESTRIAN_FULL_CLOSURE", "LOCAL_FESTIVAL", "COMPETITOR_OPENING", "WHOLESALE_PRICE_INCREASE"]
TIERS = {"1-URGENT": "OFFICIAL_PRIMARY", "2-HIGH": "OFFICIAL_LOCAL_GOV", "3-MEDIUM": "MAJOR_NEWS", "4-NOT SPECIFIED": "OFFICIAL_SECONDARY", "5-LOW": "OTHER"}
WINDOW_END = "2002-02-28"


def window_end() -> Column:
    return F.lit(WINDOW_END).cast("date")


def notices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every order is one dated notice; registry fields come by broadcast of a fixed dimension."""
    k = F.col("o_orderkey")
    rows = table(spark, sf_dir, "orders").select(
        k.alias("event_id"), F.element_at(F.array(*[F.lit(t) for t in NOTICE_TYPES]), (k % 10 + 1).cast("int")).alias("event_type"),
        F.to_date("o_orderdate").alias("start_date"),
        F.when(k % 11 != 0, F.date_add(F.to_date("o_orderdate"), (k % 240).cast("int"))).alias("end_date"),
        F.create_map(*[F.lit(x) for kv in TIERS.items() for x in kv])[F.col("o_orderpriority")].alias("source_tier"),
        (37.45 + ((k * 53) % 1000) / 10000.0).alias("lat"), (126.95 + ((k * 71) % 1000) / 10000.0).alias("lon"),
        F.when(k % 3 == 0, F.array(F.lit("FNB"), F.lit("FNB_CAFE"))).when(k % 3 == 1, F.array(F.lit("FNB"), F.lit("FNB_RESTAURANT")))
        .otherwise(F.array(F.lit("RETAIL"))).alias("industries"),
        (8 + k % 6).cast("int").alias("event_from"), (14 + k % 9).cast("int").alias("event_to"), F.col("o_custkey").alias("place_id"))
    reg = registry.event_types(spark)
    rows = rows.join(F.broadcast(reg), "event_type")
    return rows.select(
        "event_id", "event_type", F.col("reg_domain").alias("domain"), F.col("reg_family").alias("family"), "start_date", "end_date", "source_tier",
        "lat", "lon", "industries", "event_from", "event_to", "place_id", "severity", "signal_enabled", "temporal_policy", "geo_policy",
        F.array(F.struct(F.col("reg_axis").alias("axis"), F.col("reg_direction").alias("direction"), F.col("reg_mechanism").alias("mechanism"))).alias("impacts"))


cte("registry", registry.event_types_sql())
cte("notices", f"""
SELECT n.*, r.reg_domain AS domain, r.reg_family AS family, r.reg_axis AS axis, r.reg_direction AS direction, r.reg_mechanism AS mechanism,
  r.severity, r.signal_enabled, r.temporal_policy, r.geo_policy
FROM (SELECT o_orderkey AS event_id, ([{', '.join("'" + t + "'" for t in NOTICE_TYPES)}])[o_orderkey % 10 + 1] AS event_type, CAST(o_orderdate AS DATE) AS start_date,
    CASE WHEN o_orderkey % 11 <> 0 THEN CAST(o_orderdate AS DATE) + CAST(o_orderkey % 240 AS INTEGER) END AS end_date,
    CASE o_orderpriority {' '.join(f"WHEN '{a}' THEN '{t}'" for a, t in TIERS.items())} END AS source_tier,
    37.45::DOUBLE + ((o_orderkey * 53) % 1000) / 10000.0::DOUBLE AS lat, 126.95::DOUBLE + ((o_orderkey * 71) % 1000) / 10000.0::DOUBLE AS lon,
    o_orderkey % 3 AS ind, 8 + o_orderkey % 6 AS event_from, 14 + o_orderkey % 9 AS event_to, o_custkey AS place_id FROM orders) n
JOIN registry r USING (event_type)""", "registry")


def found_by(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which notices a store's research found: the store sold an item of that order."""
    return table(spark, sf_dir, "lineitem").select((2 * F.col("l_suppkey") + 1).alias("store_id"), F.col("l_orderkey").alias("event_id")).distinct()


cte("found_by", "SELECT DISTINCT 2 * l_suppkey + 1 AS store_id, l_orderkey AS event_id FROM lineitem")


def signal_stores(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tillwise.operators.ledger import has_variable_debt

    s = stores(spark, sf_dir)
    debt = has_variable_debt(s, loans(spark, sf_dir).select("store_id", "rate_type"))
    return s.join(debt, "store_id").select(
        "store_id", "business_type_code", F.col("lat").alias("store_lat"), F.col("lon").alias("store_lon"), "variable_debt",
        (9 + F.col("store_id") % 3).cast("int").alias("open_from"), (18 + F.col("store_id") % 5).cast("int").alias("open_to"))


# ---- policies ------------------------------------------------------------------------------

POLICY_TYPES = ["GRANT", "LOAN_SUPPORT", "INTEREST_SUBSIDY", "REPAYMENT_DEFERRAL"]


def policies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every part is one policy notice; some terms are unstated."""
    k, size = F.col("p_partkey"), F.col("p_size")
    text = lambda x: x.cast("string")
    pick = lambda values, i: F.element_at(F.array(*[F.lit(v) for v in values]), (i + 1).cast("int"))
    region = F.concat(F.lit("KR-"), text(10 + k % 25))
    cond = F.struct(
        pick(["employee_count", "store.annual_revenue", "business_age_months", "shoe_size"], k % 4).alias("field"), pick(["LE", "LE", "GE", "EQ"], k % 4).alias("op"),
        F.when(k % 4 == 0, text(8 + k % 12)).when(k % 4 == 1, text(400000 + k % 700000)).when(k % 4 == 2, text(k % 150)).otherwise("1").alias("expected"))
    second = F.struct(pick(["business_type_code", "owner_age", "store_profile.credit_band"], k % 3).alias("field"), pick(["NOT_IN", "GE", "IN"], k % 3).alias("op"),
                      F.when(k % 3 == 0, "RETAIL, PUB").when(k % 3 == 1, text(20 + k % 30)).otherwise("A, B").alias("expected"))
    return table(spark, sf_dir, "part").select(
        k.alias("policy_id"), F.col("p_brand").alias("provider"), F.concat(F.col("p_type"), F.lit(" support program "), text(size)).alias("name"),
        pick(POLICY_TYPES, k % 4).alias("policy_type"), F.when(k % 3 != 0, F.col("p_retailprice") * 100.123).alias("limit_krw"),
        F.when(k % 5 != 0, (size % 5) / 2.0).alias("discount_pp"), F.when(k % 6 != 0, 2.0 + size % 4).alias("annual_rate_percent"),
        F.when(k % 7 != 0, (size % 7).cast("int")).alias("grace_months"), F.when(k % 11 != 0, (12 + size).cast("int")).alias("maturity_months"),
        pick(["BULLET", "EQUAL_PRINCIPAL", "AMORTIZING"], k % 3).alias("method"), F.when(k % 8 != 0, k % 3 == 0).alias("collateral"),
        F.when(k % 9 != 0, F.date_sub(as_of(), (k % 60).cast("int"))).alias("app_start"), F.when(k % 10 != 0, F.date_add(as_of(), (k % 90 - 10).cast("int"))).alias("app_end"),
        pick(["OPEN", "OPEN", "OPEN", "UNKNOWN", "EXHAUSTED"], k % 5).alias("budget_status"), pick(["ORIGINAL", "ORIGINAL", "ORIGINAL", "CORRECTION", "TERMINATION"], (k % 50) % 5 * F.when(k % 50 < 10, 1).otherwise(0)).alias("notice_kind"),
        F.when(k % 3 == 0, F.array().cast("array<string>")).when(k % 13 == 0, F.array(F.lit("nowhere"))).otherwise(F.array(region, F.concat(F.lit("kr-"), text(10 + (k + 1) % 25)), F.lit("KR-20"))).alias("regions"),
        F.when(k % 17 == 0, F.array(F.lit("FNB_CAFE"))).otherwise(F.array(F.lit("Small_Business"))).alias("include"),
        F.when(k % 19 == 0, F.array(F.lit("FNB_BAKERY"))).otherwise(F.array().cast("array<string>")).alias("exclude"), F.array(cond, second).alias("conditions"),
        (k % 23 == 0).alias("source_missing"), (k % 29 == 0).alias("set_mismatch"), (k % 31 == 0).alias("unavailable"), (k % 37 == 0).alias("security"), (k % 41 == 0).alias("untrusted"),
        F.when(k % 43 == 0, F.array(F.lit("POLICY_QUOTE_NOT_FOUND"))).otherwise(F.array().cast("array<string>")).alias("evidence_codes"),
        F.when(k % 47 == 0, F.array(F.lit("POLICY_NUMERIC_UNIT_AMBIGUOUS"))).otherwise(F.array().cast("array<string>")).alias("semantic_codes"),
        (k % 53 == 0).alias("explicitly_closed"), (k % 59 == 0).alias("fallback"))


cte("policies", """
SELECT k AS policy_id, p_brand AS provider, p_type || ' support program ' || p_size AS name, (['GRANT', 'LOAN_SUPPORT', 'INTEREST_SUBSIDY', 'REPAYMENT_DEFERRAL'])[k % 4 + 1] AS policy_type,
  CASE WHEN k % 3 <> 0 THEN p_retailprice * 100.123::DOUBLE END AS limit_krw, CASE WHEN k % 5 <> 0 THEN (p_size % 5) / 2.0::DOUBLE END AS discount_pp, CASE WHEN k % 6 <> 0 THEN 2.0::DOUBLE + p_size % 4 END AS annual_rate_percent,
  CASE WHEN k % 7 <> 0 THEN p_size % 7 END AS grace_months, CASE WHEN k % 11 <> 0 THEN 12 + p_size END AS maturity_months, (['BULLET', 'EQUAL_PRINCIPAL', 'AMORTIZING'])[k % 3 + 1] AS method,
  CASE WHEN k % 8 <> 0 THEN k % 3 = 0 END AS collateral, CASE WHEN k % 9 <> 0 THEN DATE '2001-08-31' - CAST(k % 60 AS INTEGER) END AS app_start, CASE WHEN k % 10 <> 0 THEN DATE '2001-08-31' + CAST(k % 90 - 10 AS INTEGER) END AS app_end,
  (['OPEN', 'OPEN', 'OPEN', 'UNKNOWN', 'EXHAUSTED'])[k % 5 + 1] AS budget_status, CASE WHEN k % 50 < 10 THEN (['ORIGINAL', 'ORIGINAL', 'ORIGINAL', 'CORRECTION', 'TERMINATION'])[k % 5 + 1] ELSE 'ORIGINAL' END AS notice_kind,
  k % 23 = 0 AS source_missing, k % 29 = 0 AS set_mismatch, k % 31 = 0 AS unavailable, k % 37 = 0 AS security, k % 41 = 0 AS untrusted, k % 43 = 0 AS no_quote, k % 47 = 0 AS ambiguous, k % 53 = 0 AS explicitly_closed, k % 59 = 0 AS fallback
FROM (SELECT *, p_partkey AS k FROM part)""")


def policy_finds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every time a store's research found a policy: the store sold that part."""
    return table(spark, sf_dir, "lineitem").select((2 * F.col("l_suppkey") + 1).alias("store_id"), F.col("l_partkey").alias("policy_id"))


def policy_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which policies a store's research found."""
    return policy_finds(spark, sf_dir).distinct()


cte("policy_pairs", "SELECT DISTINCT 2 * l_suppkey + 1 AS store_id, l_partkey AS policy_id FROM lineitem")
