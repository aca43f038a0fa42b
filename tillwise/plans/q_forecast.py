"""Forecast queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from tillwise.functions.core import month_name, rnd
from tillwise.functions.stages import staged
from tillwise.operators import forecast as fc
from tillwise.operators import smoothing
from tillwise.plans import bindings as b
from tillwise.plans.catalog import CTES, cte, query, r, sql

cte("numbered", """
SELECT store_id, month, revenue, row_number() OVER (PARTITION BY store_id ORDER BY month) AS idx,
  count(*) OVER (PARTITION BY store_id) AS n FROM history""", "history")
cte("predicted", """
SELECT *, idx - 1 AS split,
  CASE WHEN idx - 1 >= 2 THEN greatest(0.0::DOUBLE, sum6 / least(idx - 1, 6)) END AS recent_mean,
  CASE WHEN idx - 1 >= 4 THEN greatest(0.0::DOUBLE, prev + (prev - first6) / (least(idx - 1, 6) - 1)) END AS recent_trend,
  CASE WHEN idx - 1 >= 8 THEN greatest(0.0::DOUBLE, prev + (prev - first12) / (least(idx - 1, 12) - 1) * 0.8::DOUBLE) END AS damped_trend,
  CASE WHEN idx - 1 >= 12 THEN greatest(0.0::DOUBLE, back12) END AS seasonal_naive
FROM (SELECT *, lag(revenue) OVER w AS prev, lag(revenue, 12) OVER w AS back12,
    sum(revenue) OVER (w ROWS BETWEEN 6 PRECEDING AND 1 PRECEDING) AS sum6,
    first_value(revenue) OVER (w ROWS BETWEEN 6 PRECEDING AND 1 PRECEDING) AS first6,
    first_value(revenue) OVER (w ROWS BETWEEN 12 PRECEDING AND 1 PRECEDING) AS first12
  FROM numbered WINDOW w AS (PARTITION BY store_id ORDER BY month))""", "numbered")
cte("metrics", """
SELECT store_id, model, n, count(pred) AS folds, bool_or(failed) AS failed, max(mae_) AS mae,
  avg(CASE WHEN pred IS NOT NULL THEN CASE WHEN abs(revenue) + abs(pred) = 0 THEN 0.0::DOUBLE ELSE 2 * err / (abs(revenue) + abs(pred)) END END) AS smape,
  avg(CASE WHEN pred IS NOT NULL THEN CAST(sign(pred - prev) = sign(revenue - prev) AS INTEGER) END) AS directional_accuracy,
  avg(CASE WHEN pred IS NOT NULL THEN CAST(err <= mae_ * 1.96::DOUBLE AS INTEGER) END) AS interval_coverage
FROM (SELECT *, abs(revenue - pred) AS err, avg(abs(revenue - pred)) OVER (PARTITION BY store_id, model) AS mae_ FROM (
  SELECT p.store_id, p.n, p.revenue, p.prev, m.model, m.pred_failed AS failed,
    CASE WHEN NOT m.pred_failed AND p.split >= greatest(m.min_history, 4, p.n - 12) THEN
      CASE m.model WHEN 'RECENT_MEAN' THEN recent_mean WHEN 'RECENT_TREND' THEN recent_trend WHEN 'DAMPED_TREND' THEN damped_trend ELSE seasonal_naive END END AS pred
  FROM predicted p, (VALUES ('RECENT_MEAN', 2, false, 6, 999), ('RECENT_TREND', 4, false, 6, 11), ('SEASONAL_NAIVE', 12, false, 12, 999),
    ('DAMPED_TREND', 8, false, 12, 23), ('ETS_DAMPED', 18, true, 24, 999), ('SARIMA', 24, true, 24, 999)) m(model, min_history, pred_failed, lo, hi)
  WHERE p.n BETWEEN m.lo AND m.hi))
GROUP BY store_id, model, n""", "predicted")
cte("ranked_models", """
SELECT *, row_number() OVER (PARTITION BY store_id ORDER BY smape ASC NULLS LAST, mae ASC NULLS LAST,
  CASE model WHEN 'SEASONAL_NAIVE' THEN 0 WHEN 'DAMPED_TREND' THEN 1 WHEN 'RECENT_MEAN' THEN 2 ELSE 3 END) AS rk,
  max(CASE WHEN model = 'RECENT_MEAN' THEN smape END) OVER (PARTITION BY store_id) AS simple_smape
FROM metrics WHERE NOT failed""", "metrics")
cte("selected", """
SELECT store_id, n, model, smape, mae, folds, CAST(NULL AS VARCHAR) AS fallback, smape <= simple_smape AS beats_simple_baseline
FROM ranked_models WHERE rk = 1""", "ranked_models")
cte("tail", """
SELECT store_id, max(n) AS n, max(CASE WHEN idx = n THEN revenue END) AS last,
  avg(CASE WHEN idx > n - 6 THEN revenue END) AS mean6, max(CASE WHEN idx = greatest(1, n - 5) THEN revenue END) AS first6,
  max(CASE WHEN idx = greatest(1, n - 11) THEN revenue END) AS first12
FROM numbered GROUP BY store_id""", "numbered")
cte("points", """
SELECT t.store_id, t.n, m.model, h.h AS month_index, greatest(0.0::DOUBLE, CASE m.model WHEN 'RECENT_MEAN' THEN mean6
  WHEN 'RECENT_TREND' THEN last + (last - first6) / greatest(least(t.n, 6) - 1, 1) * h.h
  WHEN 'DAMPED_TREND' THEN last + (last - first12) / greatest(least(t.n, 12) - 1, 1) * (0.8::DOUBLE * (1 - pow(0.8::DOUBLE, h.h)) / (1 - 0.8::DOUBLE))
  ELSE s.revenue END) AS point
FROM tail t CROSS JOIN range(1, 7) h(h)
CROSS JOIN (VALUES ('RECENT_MEAN', 2), ('RECENT_TREND', 4), ('DAMPED_TREND', 8), ('SEASONAL_NAIVE', 12)) m(model, lo)
LEFT JOIN numbered s ON s.store_id = t.store_id AND s.idx = t.n - 12 + h.h
WHERE t.n >= m.lo""", "tail", "numbered")


def _points(spark, sf, model):
    out = fc.model_points(fc.last_frame(b.history(spark, sf)), b.HORIZON, [model])
    return out.select("store_id", "month_index", rnd(F.col("point"), 3).alias("point"))


def _points_sql(model):
    return sql(f"SELECT store_id, month_index, {r('point', 3)} AS point FROM points WHERE model = '{model}'", "points")


for _name, _model in [("fc_recent_mean", "RECENT_MEAN"), ("fc_recent_trend", "RECENT_TREND"),
                      ("fc_damped_trend", "DAMPED_TREND"), ("fc_seasonal_naive", "SEASONAL_NAIVE")]:
    query(_name, _points_sql(_model))(lambda spark, sf, m=_model: _points(spark, sf, m))


# damped smoothing: every grid point runs over a store's months; t counts the months seen, fit predicts the last of them
cte("ets_sched", """
SELECT s.*, g.*, 0 AS t, NULL::DOUBLE AS fit, 0.0::DOUBLE AS before, 0.0::DOUBLE AS sse,
  CASE WHEN seasonal THEN list_sum(ys[1:12]) / 12 ELSE ys[1] END AS level,
  CASE WHEN seasonal THEN (list_sum(ys[13:24]) / 12 - list_sum(ys[1:12]) / 12) / 12 ELSE ys[2] - ys[1] END AS trend,
  CASE WHEN seasonal THEN list_transform(ys[1:12], lambda y: y - list_sum(ys[1:12]) / 12) ELSE list_transform(range(12), lambda y: 0.0::DOUBLE) END AS season
FROM (SELECT store_id, n, list(revenue ORDER BY idx) AS ys FROM numbered WHERE n >= 18 GROUP BY ALL) s
JOIN (SELECT a.a::DOUBLE AS alpha, b.b::DOUBLE AS beta, g.g::DOUBLE AS gamma, p.p::DOUBLE AS phi, g.g > 0 AS seasonal FROM (VALUES (0.2), (0.5), (0.8)) a(a), (VALUES (0.05), (0.2)) b(b), (VALUES (0.0), (0.1), (0.3)) g(g), (VALUES (0.9), (0.98)) p(p)) g
  ON CASE WHEN seasonal THEN n >= 24 ELSE n < 36 END
UNION ALL
SELECT store_id, n, ys, alpha, beta, gamma, phi, seasonal, t + 1, fit2, sse, sse + (y - fit2) * (y - fit2), level2, beta * (level2 - level) + (1 - beta) * phi * trend,
  CASE WHEN seasonal THEN list_transform(season, lambda v, i: CASE WHEN i = t % 12 + 1 THEN gamma * (y - (level + phi * trend)) + (1 - gamma) * v ELSE v END) ELSE season END
FROM (SELECT *, alpha * (y - season[t % 12 + 1]) + (1 - alpha) * (level + phi * trend) AS level2, level + phi * trend + season[t % 12 + 1] AS fit2 FROM (SELECT *, ys[t + 1] AS y FROM ets_sched WHERE t < n))""", "numbered")
cte("ets_best", """
SELECT * FROM ets_sched WHERE t = n AND seasonal = (n >= 24) QUALIFY row_number() OVER (PARTITION BY store_id ORDER BY sse, alpha, beta, gamma, phi) = 1""", "ets_sched")
cte("ets_points", """
SELECT store_id, n, 'ETS_DAMPED' AS model, h.h AS month_index, greatest(0.0::DOUBLE, level + trend * phi * (1 - pow(phi, h.h)) / (1 - phi) + season[(n + h.h - 1) % 12 + 1]) AS point FROM ets_best, range(1, 7) h(h)""", "ets_best")
cte("ets_folds", """
SELECT store_id, n, ys[t] AS y, ys[t - 1] AS prev, greatest(0.0::DOUBLE, fit) AS pred FROM ets_sched WHERE t - 1 >= greatest(18, n - 12) AND t >= 1 AND seasonal = (t - 1 >= 24)
QUALIFY row_number() OVER (PARTITION BY store_id, t ORDER BY before, alpha, beta, gamma, phi) = 1""", "ets_sched")
cte("contest_metrics", """
SELECT * FROM metrics WHERE model <> 'ETS_DAMPED' UNION ALL
SELECT store_id, 'ETS_DAMPED', n, count(*), false, max(mae), avg(CASE WHEN abs(y) + abs(pred) = 0 THEN 0.0::DOUBLE ELSE 2 * abs(y - pred) / (abs(y) + abs(pred)) END),
  avg(CAST(sign(pred - prev) = sign(y - prev) AS INTEGER)), avg(CAST(abs(y - pred) <= mae * 1.96::DOUBLE AS INTEGER))
FROM (SELECT *, avg(abs(y - pred)) OVER (PARTITION BY store_id) AS mae FROM ets_folds WHERE n >= 24) GROUP BY store_id, n""", "metrics", "ets_folds")
cte("contest_ranked", CTES["ranked_models"][1].replace("FROM metrics", "FROM contest_metrics").replace("ELSE 3 END", "WHEN 'RECENT_TREND' THEN 3 ELSE 4 END"), "contest_metrics")
cte("contest_selected", CTES["selected"][1].replace("ranked_models", "contest_ranked"), "contest_ranked")
cte("contest_points", "SELECT * FROM points UNION ALL SELECT * FROM ets_points", "points", "ets_points")


def fits(spark, sf):
    return staged(spark, "smoothing:" + sf, lambda: smoothing.fit_damped(b.history(spark, sf), b.HORIZON))


def contest_metrics(spark, sf):
    return fc.with_models(fc.backtest_metrics(b.history(spark, sf)), smoothing.ets_metrics(fits(spark, sf)))


@query("backtest_metrics", sql(f"""
SELECT store_id, model, folds, failed, {r('mae', 3)} AS mae, {r('smape', 6)} AS smape,
  {r('directional_accuracy', 6)} AS directional_accuracy, {r('interval_coverage', 6)} AS interval_coverage FROM contest_metrics""", "contest_metrics"))
def backtest_metrics(spark, sf):
    return contest_metrics(spark, sf).select(
        "store_id", "model", "folds", "failed", rnd(F.col("mae"), 3).alias("mae"), rnd(F.col("smape"), 6).alias("smape"),
        rnd(F.col("directional_accuracy"), 6).alias("directional_accuracy"),
        rnd(F.col("interval_coverage"), 6).alias("interval_coverage"))


@query("model_selection", sql(f"""
SELECT store_id, n, model, folds, fallback, beats_simple_baseline, {r('mae', 3)} AS mae, {r('smape', 6)} AS smape FROM contest_selected""",
                              "contest_selected"))
def model_selection(spark, sf):
    return fc.select_models(contest_metrics(spark, sf)).select(
        "store_id", "n", "model", "folds", "fallback", "beats_simple_baseline", rnd(F.col("mae"), 3).alias("mae"),
        rnd(F.col("smape"), 6).alias("smape"))


cte("fallback", """
SELECT s.store_id, coalesce(h.n, 0) AS n, CASE WHEN p.point IS NULL THEN 'INSUFFICIENT_DATA' ELSE 'PARTIAL' END AS status,
  CASE WHEN p.point IS NULL THEN NULL WHEN s.declared_revenue IS NOT NULL THEN 'DECLARED_BASELINE' ELSE 'LAST_OBSERVED_ASSUMPTION' END AS model,
  p.point, p.point * 0.20::DOUBLE AS width
FROM stores s LEFT JOIN (SELECT store_id, count(*) AS n, max_by(revenue, month) AS last_revenue FROM history GROUP BY store_id) h USING (store_id),
  LATERAL (SELECT coalesce(s.declared_revenue, h.last_revenue) AS point) p
WHERE coalesce(h.n, 0) < 6""", "stores", "history")


@query("fc_fallback", sql(f"SELECT store_id, n, status, model, {r('point', 3)} AS point, {r('width', 3)} AS width FROM fallback",
                          "fallback"))
def fc_fallback(spark, sf):
    return fc.fallback_forecast(b.stores(spark, sf), b.history(spark, sf)).select(
        "store_id", "n", "status", "model", rnd(F.col("point"), 3).alias("point"), rnd(F.col("width"), 3).alias("width"))


cte("baseline", """
SELECT q.store_id, q.n, q.status, q.model, q.month_index, CAST(DATE '2001-09-01' + to_months(CAST(q.month_index - 1 AS INTEGER)) AS DATE) AS month,
  q.point, greatest(0.0::DOUBLE, q.point - q.width) AS lower, q.point + q.width AS upper, q.status = 'PARTIAL' AS is_assumption_range, q.width
FROM (
  SELECT s.store_id, s.n, 'COMPLETED' AS status, s.model, p.month_index, p.point,
    CASE WHEN coalesce(s.mae, 0.0::DOUBLE) * 1.96::DOUBLE = 0 THEN a.mean_revenue * 0.05::DOUBLE ELSE s.mae * 1.96::DOUBLE END AS width
  FROM selected s JOIN points p USING (store_id, model) JOIN (SELECT store_id, avg(revenue) AS mean_revenue FROM history GROUP BY store_id) a USING (store_id)
  UNION ALL
  SELECT f.store_id, f.n, f.status, f.model, h.h, f.point, f.width FROM fallback f LEFT JOIN range(1, 7) h(h) ON f.point IS NOT NULL
) q""", "selected", "points", "history", "fallback")


cte("contest_baseline", CTES["baseline"][1].replace("FROM selected", "FROM contest_selected").replace("JOIN points", "JOIN contest_points"), "contest_selected", "contest_points", "history", "fallback")


@query("fc_ets_grid", sql(f"""
SELECT p.store_id, p.n, p.month_index, {r('p.point', 3)} AS point, alpha, beta, gamma, phi, {r('sse / b.n', 2)} AS mean_square FROM ets_points p JOIN ets_best b USING (store_id)""", "ets_points", "ets_best"))
def fc_ets_grid(spark, sf):
    found = smoothing.fit_damped(b.history(spark, sf), b.HORIZON)
    rows = found.select("store_id", "n", "params.*", rnd(F.col("sse") / F.col("n"), 2).alias("mean_square"), F.posexplode("points").alias("i", "point"))
    return rows.select("store_id", "n", (F.col("i") + 1).alias("month_index"), rnd(F.col("point"), 3).alias("point"), "alpha", "beta", "gamma", "phi", "mean_square")


@query("ets_backtest", sql(f"SELECT store_id, y AS revenue, prev AS prev_revenue, {r('pred', 3)} AS pred FROM ets_folds", "ets_folds"))
def ets_backtest(spark, sf):
    rows = smoothing.fit_damped(b.history(spark, sf), b.HORIZON).select("store_id", F.explode("folds").alias("f"))
    return rows.select("store_id", F.col("f.y").alias("revenue"), F.col("f.prev").alias("prev_revenue"), rnd(F.col("f.pred"), 3).alias("pred"))


@query("cost_forecast", sql(f"""
SELECT b.store_id, strftime(b.month, '%Y-%m') AS month, {r('b.point * 0.4::DOUBLE * 1.01::DOUBLE', 3)} AS variable_cost,
  {r('l.rent + l.labor * 1.03::DOUBLE + l.utilities + l.other', 3)} AS fixed_cost
FROM baseline b JOIN last_month l USING (store_id) WHERE b.point IS NOT NULL""", "baseline", "last_month"))
def cost_forecast(spark, sf):
    from tillwise.operators.ledger import last_ledger_month

    history = b.history(spark, sf)
    rows = fc.baseline_forecast(b.stores(spark, sf), history, b.start(), b.HORIZON).filter(F.col("point").isNotNull())
    last = last_ledger_month(history).select("store_id", "rent", "labor", "utilities", "other")
    out = fc.cost_forecast(rows.join(last, "store_id"), fx_change=0.05, wage_change=0.03)
    return out.select("store_id", month_name(F.col("month")).alias("month"),
                      rnd(F.col("variable_cost"), 3).alias("variable_cost"), rnd(F.col("fixed_cost"), 3).alias("fixed_cost"))
