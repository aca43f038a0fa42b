"""Back-tested monthly revenue forecasts for a table of stores.

Every model's one-step prediction is a window over the preceding months, so a whole back-test
is one pass over one shuffle on `store_id`; a store has at most a few hundred months."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tillwise.functions.core import d

# Model name, version, shortest history, tie priority.
MODELS = [
    ("SEASONAL_NAIVE", "seasonal_naive.v1", 12, 0),
    ("DAMPED_TREND", "damped_trend.v1", 8, 1),
    ("RECENT_MEAN", "recent_mean.v1", 2, 2),
    ("RECENT_TREND", "recent_trend.v1", 4, 3),
    ("ETS_DAMPED", "ets_damped.v1", 18, 4),
    ("SARIMA", "sarima_101_011.v1", 24, 5),
]
VERSION = {m[0]: m[1] for m in MODELS}
MIN_HISTORY = {m[0]: m[2] for m in MODELS}
PRIORITY = {m[0]: m[3] for m in MODELS}
DAMPING = 0.8
INTERVAL_Z = 1.96
BACKTEST_WINDOWS = 12

CLOSED_FORM = ["RECENT_MEAN", "RECENT_TREND", "DAMPED_TREND", "SEASONAL_NAIVE"]


def candidate_models(n: Column) -> Column:
    """Models tried for a history of `n` months."""
    arr = lambda *names: F.array(*[F.lit(x) for x in names])
    return (
        F.when(n < 6, F.array().cast("array<string>"))
        .when(n < 12, arr("RECENT_MEAN", "RECENT_TREND"))
        .when(n < 24, arr("RECENT_MEAN", "SEASONAL_NAIVE", "DAMPED_TREND"))
        .otherwise(arr("RECENT_MEAN", "SEASONAL_NAIVE", "ETS_DAMPED", "SARIMA"))
    )


def number_months(history: DataFrame) -> DataFrame:
    """Adds `idx` (1-based position of the month) and `n` (months of the store)."""
    by_month = Window.partitionBy("store_id").orderBy("month")
    whole = Window.partitionBy("store_id")
    return history.withColumn("idx", F.row_number().over(by_month)).withColumn("n", F.count("*").over(whole))


def one_step_predictions(history: DataFrame) -> DataFrame:
    """history(store_id, month, revenue) plus each closed-form model's forecast of that month
    from the months before it; NULL where the history is too short."""
    by_month = Window.partitionBy("store_id").orderBy("month")
    six, twelve = by_month.rowsBetween(-6, -1), by_month.rowsBetween(-12, -1)
    before = F.col("idx") - 1
    k6, k12 = F.least(before, F.lit(6)), F.least(before, F.lit(12))
    last = F.lag("revenue").over(by_month)
    trend = last + (last - F.first("revenue").over(six)) / (k6 - 1)
    damped = last + (last - F.first("revenue").over(twelve)) / (k12 - 1) * DAMPING
    enough = lambda name, value: F.when(before >= MIN_HISTORY[name], F.greatest(d(0), value))
    return (
        number_months(history)
        .withColumn("prev_revenue", last)
        .withColumn("recent_mean", enough("RECENT_MEAN", F.sum("revenue").over(six) / k6))
        .withColumn("recent_trend", enough("RECENT_TREND", trend))
        .withColumn("damped_trend", enough("DAMPED_TREND", damped))
        .withColumn("seasonal_naive", enough("SEASONAL_NAIVE", F.lag("revenue", 12).over(by_month)))
    )


def backtest_metrics(history: DataFrame, windows: int = BACKTEST_WINDOWS, all_models: bool = False) -> DataFrame:
    """Rolling one-step metrics per (store, candidate model).

    Candidates without a fold keep null metrics; models with no closed form are listed with
    `failed` set unless their metrics are added by the caller."""
    wide = one_step_predictions(history)
    models = F.array(*[F.lit(m) for m in CLOSED_FORM]) if all_models else candidate_models(F.col("n"))
    long = wide.withColumn("model", F.explode(models))
    pred = F.coalesce(*[F.when(F.col("model") == m, F.col(m.lower())) for m in CLOSED_FORM])
    min_history = F.coalesce(*[F.when(F.col("model") == m, F.lit(MIN_HISTORY[m])) for m in MIN_HISTORY])
    start = F.greatest(min_history, F.lit(4), F.col("n") - max(1, windows))
    failed = ~F.col("model").isin(CLOSED_FORM)
    in_fold = (F.col("idx") - 1 >= start) & ~failed
    long = long.select("store_id", "model", "n", "revenue", "prev_revenue", failed.alias("failed"),
                       F.when(in_fold, pred).alias("pred"))
    err = F.abs(F.col("revenue") - F.col("pred"))
    scale = F.abs("revenue") + F.abs("pred")
    per_model = Window.partitionBy("store_id", "model")
    long = long.withColumn("err", err).withColumn("mae_", F.avg("err").over(per_model))
    hit = F.signum(F.col("pred") - F.col("prev_revenue")) == F.signum(F.col("revenue") - F.col("prev_revenue"))
    return long.groupBy("store_id", "model").agg(
        F.max("n").alias("n"),
        F.count("pred").alias("folds"),
        F.max("failed").alias("failed"),
        F.max("mae_").alias("mae"),
        F.avg(F.when(F.col("pred").isNotNull(), F.when(scale == 0, d(0)).otherwise(2 * F.col("err") / scale)))
        .alias("smape"),
        F.avg(F.when(F.col("pred").isNotNull(), hit.cast("double"))).alias("directional_accuracy"),
        F.avg(F.when(F.col("pred").isNotNull(), (F.col("err") <= F.col("mae_") * INTERVAL_Z).cast("double")))
        .alias("interval_coverage"),
    )


def with_models(metrics: DataFrame, extra: DataFrame) -> DataFrame:
    """The metrics with those of models without a closed form in place of their `failed` rows."""
    named = extra.select(F.col("store_id").alias("_store"), F.col("model").alias("_model"))
    rest = metrics.join(named, (F.col("store_id") == F.col("_store")) & (F.col("model") == F.col("_model")), "left_anti")
    return rest.unionByName(extra)


def select_models(metrics: DataFrame, min_improvement: float = 0.0) -> DataFrame:
    """One row per store: the chosen model, its metrics and the fallback note."""
    ok = metrics.filter(~F.col("failed"))
    key = F.struct(
        F.col("smape").isNull().alias("no_smape"), F.col("smape"),
        F.col("mae").isNull().alias("no_mae"), F.col("mae"),
        F.coalesce(*[F.when(F.col("model") == m, F.lit(p)) for m, p in PRIORITY.items()]).alias("priority"),
    )
    best = F.min_by(F.struct("model", "smape", "mae", "folds"), key)
    simple = F.max(F.when(F.col("model") == "RECENT_MEAN", F.struct("model", "smape", "mae", "folds")))
    grouped = ok.groupBy("store_id").agg(F.max("n").alias("n"), best.alias("best"), simple.alias("simple"))
    threshold = F.col("simple.smape") * (1.0 - min_improvement)
    miss = (
        (F.col("best.model") != "RECENT_MEAN") & F.col("simple.smape").isNotNull()
        & (F.col("best.smape").isNull() | (F.col("best.smape") > threshold))
    )
    chosen = F.when(miss, F.col("simple")).otherwise(F.col("best"))
    return grouped.withColumn("chosen", chosen).select(
        "store_id", "n",
        F.col("chosen.model").alias("model"), F.col("chosen.smape").alias("smape"),
        F.col("chosen.mae").alias("mae"), F.col("chosen.folds").alias("folds"),
        F.when(miss, F.lit("IMPROVEMENT_NOT_MET")).alias("fallback"),
        (F.col("chosen.smape") <= threshold).alias("beats_simple_baseline"),
    )


def last_frame(history: DataFrame) -> DataFrame:
    """Per store: the numbers every closed-form model needs, from its last twelve months."""
    numbered = number_months(history)
    tail = numbered.filter(F.col("idx") > F.col("n") - 12)
    back = lambda k: F.max(F.when(F.col("idx") == F.col("n") - k, F.col("revenue")))
    season = F.array_sort(F.collect_list(F.struct("idx", "revenue")))
    return tail.groupBy("store_id").agg(
        F.max("n").alias("n"),
        back(0).alias("last"),
        F.avg(F.when(F.col("idx") > F.col("n") - 6, F.col("revenue"))).alias("mean6"),
        F.max(F.when(F.col("idx") == F.greatest(F.lit(1), F.col("n") - 5), F.col("revenue"))).alias("first6"),
        F.max(F.when(F.col("idx") == F.greatest(F.lit(1), F.col("n") - 11), F.col("revenue"))).alias("first12"),
        F.transform(season, lambda x: x["revenue"]).alias("season"),
    )


def model_points(frame: DataFrame, horizon: int, models: list[str] | None = None) -> DataFrame:
    """Point forecasts (store_id, model, month_index, point) of every model with enough history."""
    models = models or CLOSED_FORM
    h = F.col("month_index")
    k6, k12 = F.least(F.col("n"), F.lit(6)), F.least(F.col("n"), F.lit(12))
    decay = DAMPING * (1 - F.pow(d(DAMPING), h)) / (1 - DAMPING)
    value = {
        "RECENT_MEAN": F.col("mean6"),
        "RECENT_TREND": F.col("last") + (F.col("last") - F.col("first6")) / F.greatest(k6 - 1, F.lit(1)) * h,
        "DAMPED_TREND": F.col("last") + (F.col("last") - F.col("first12")) / F.greatest(k12 - 1, F.lit(1)) * decay,
        "SEASONAL_NAIVE": F.get(F.col("season"), F.pmod(h - 1, F.lit(12))),
    }
    out = frame.withColumn("month_index", F.explode(F.sequence(F.lit(1), F.lit(horizon))))
    out = out.withColumn("model", F.explode(F.array(*[F.lit(m) for m in models])))
    point = F.coalesce(*[
        F.when((F.col("model") == m) & (F.col("n") >= MIN_HISTORY[m]), F.greatest(d(0), value[m])) for m in models
    ])
    return out.select("store_id", "n", "model", "month_index", point.alias("point")).filter(F.col("point").isNotNull())


def fallback_forecast(stores: DataFrame, history: DataFrame) -> DataFrame:
    """Stores with fewer than six months: declared revenue, else the last month, else no data."""
    seen = history.groupBy("store_id").agg(
        F.count("*").alias("n"), F.max_by("revenue", "month").alias("last_revenue"),
        F.avg("revenue").alias("mean_revenue"), F.max("month").alias("training_end"),
    )
    out = stores.select("store_id", "declared_revenue").join(seen, "store_id", "left")
    out = out.withColumn("n", F.coalesce("n", F.lit(0))).filter(F.col("n") < 6)
    point = F.coalesce("declared_revenue", "last_revenue")
    return out.select(
        "store_id", "n",
        F.when(point.isNull(), "INSUFFICIENT_DATA").otherwise("PARTIAL").alias("status"),
        F.when(point.isNull(), None).when(F.col("declared_revenue").isNotNull(), "DECLARED_BASELINE")
        .otherwise("LAST_OBSERVED_ASSUMPTION").alias("model"),
        point.alias("point"), (point * 0.20).alias("width"),
    )


def baseline_forecast(stores: DataFrame, history: DataFrame, forecast_start: Column, horizon: int,
                      features: DataFrame | None = None, windows: int = BACKTEST_WINDOWS,
                      extra_metrics: DataFrame | None = None, extra_points: DataFrame | None = None,
                      min_improvement: float = 0.0) -> DataFrame:
    """Forecast rows (store_id, month, point, lower, upper) for every store.

    `features(month, revenue_index_multiplier)` scales point and width; `extra_*` bring models
    without a closed form into the contest."""
    metrics = backtest_metrics(history, windows)
    points = model_points(last_frame(history), horizon)
    if extra_metrics is not None:
        metrics, points = with_models(metrics, extra_metrics), points.unionByName(extra_points)
    mean = history.groupBy("store_id").agg(F.avg("revenue").alias("mean_revenue"))
    picked = select_models(metrics, min_improvement).join(mean, "store_id")
    width = F.coalesce("mae", d(0)) * INTERVAL_Z
    picked = picked.withColumn("width", F.when(width == 0, F.col("mean_revenue") * 0.05).otherwise(width))
    modelled = picked.join(points.drop("n"), ["store_id", "model"]).select(
        "store_id", "n", F.lit("COMPLETED").alias("status"), "model", "month_index", "point", "width")
    short = fallback_forecast(stores, history)
    short = short.withColumn(
        "month_index",
        F.explode_outer(F.when(F.col("point").isNotNull(), F.sequence(F.lit(1), F.lit(horizon)))))
    rows = modelled.unionByName(short.select(*modelled.columns))
    rows = rows.withColumn("month", F.add_months(forecast_start, F.col("month_index") - 1))
    if features is not None:
        # one row per forecast month (at most twelve): bounded by the horizon, not by the data
        rows = rows.join(features.select("month", "revenue_index_multiplier"), "month", "left")
        factor = F.coalesce("revenue_index_multiplier", d(1))
    else:
        factor = d(1)
    point, half = F.col("point") * factor, F.col("width") * factor
    return rows.select(
        "store_id", "n", "status", "model", "month_index", "month", point.alias("point"),
        F.greatest(d(0), point - half).alias("lower"), (point + half).alias("upper"),
        (F.col("status") == "PARTIAL").alias("is_assumption_range"),
    )


def cost_forecast(rows: DataFrame, base_ratio: float = 0.4, imported_share: float = 0.25,
                  fx_change: float = 0.0, pass_through: float = 0.8, wage_change: float = 0.0) -> DataFrame:
    """Version-1 costs: a flat ratio moved by the exchange rate, labour moved by the wage."""
    factor = 1.0 + imported_share * pass_through * fx_change
    return rows.withColumn("variable_cost", F.col("point") * base_ratio * factor).withColumn(
        "fixed_cost", F.col("rent") + F.col("labor") * (1.0 + wage_change) + F.col("utilities") + F.col("other"))
