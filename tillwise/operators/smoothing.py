"""Damped exponential smoothing on a fixed parameter grid, for all stores at once.

Spark deals the stores over the tasks; inside a task the recursion runs in NumPy over Arrow batches, one step for all grid
points of several hundred stores. The back-test chooses grid points by the months before each predicted one, the forecast
by all months."""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tillwise.functions.core import d
from tillwise.operators.forecast import BACKTEST_WINDOWS, INTERVAL_Z, MIN_HISTORY

# Grid of level, trend and season weights and of the damping factor.
ALPHA = [0.2, 0.5, 0.8]
BETA = [0.05, 0.2]
GAMMA = [0.1, 0.3]
PHI = [0.9, 0.98]
PERIOD = 12
#: months from which the recursion has seasons
SEASONAL_FROM = 24
#: stores that take a step together: their states stay in a core's cache
TOGETHER = 256
_PARAMS = ["alpha", "beta", "gamma", "phi"]
_FITTED = ("sse double, params struct<alpha:double,beta:double,gamma:double,phi:double>, level double, trend double, season array<double>, "
           "folds array<struct<y:double,prev:double,pred:double>>")


def _grid(seasonal: bool) -> np.ndarray:
    """The grid points in ascending order, one row each."""
    return np.array(list(itertools.product(ALPHA, BETA, GAMMA if seasonal else [0.0], PHI)))


def _least(errors: np.ndarray) -> np.ndarray:
    """Position of each row's smallest error, the first of equal ones; NaN counts as larger than any number."""
    best = np.argmin(np.where(np.isnan(errors), np.inf, errors), axis=1)
    rows = np.arange(len(errors))
    return np.where(np.isfinite(errors[rows, best]), best, np.argmin(np.isnan(errors), axis=1))


def _fold(ys: np.ndarray, n: np.ndarray, first: np.ndarray, seasonal: bool, pred: np.ndarray) -> tuple[np.ndarray, ...]:
    """Run the recursion for every grid point over `ys` (months by stores, stores by falling length `n`), and put the best
    point's prediction of each month from `first` on into `pred`; `ys` may end before the stores do. Gives the best point over all
    months, its squared error, level, trend and seasons (the next month's in front)."""
    points = _grid(seasonal)
    alpha, beta, gamma, phi = points.T
    total = lambda months: sum(months, np.zeros(ys.shape[1])) / PERIOD
    shape = (ys.shape[1], len(points))
    season = np.zeros((PERIOD, *shape))
    if seasonal:
        level0 = total(ys[:PERIOD])
        trend0 = (total(ys[PERIOD:2 * PERIOD]) - level0) / PERIOD
        season += (ys[:PERIOD] - level0)[:, :, None]
    else:
        level0, trend0 = ys[0], ys[1] - ys[0]
    level, trend, sse = np.repeat(level0[:, None], shape[1], 1), np.repeat(trend0[:, None], shape[1], 1), np.zeros(shape)
    for t in range(len(ys)):
        live = int(np.searchsorted(-n, -t))  # stores with more than t months
        y, old, before, slope = ys[t, :live, None], season[t % PERIOD, :live], level[:live], trend[:live]
        ahead = before + phi * slope
        fit = ahead + old
        if (t >= SEASONAL_FROM) == seasonal and (due := np.flatnonzero(first[:live] <= t)).size:
            pred[t, due] = fit[due, _least(sse[due])]
        new = alpha * (y - old) + (1 - alpha) * ahead
        trend[:live] = beta * (new - before) + (1 - beta) * phi * slope
        if seasonal:
            season[t % PERIOD, :live] = gamma * (y - ahead) + (1 - gamma) * old
        level[:live] = new
        sse[:live] += (y - fit) * (y - fit)
    best, rows = _least(sse), np.arange(shape[0])
    turned = (np.minimum(n, len(ys))[:, None] + np.arange(PERIOD)) % PERIOD
    return points[best], sse[rows, best], level[rows, best], trend[rows, best], season[turned, rows[:, None], best[:, None]]


def _fit(ys: np.ndarray, n: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, ...]:
    """Of several stores by falling length: best points, squared errors, levels, trends, seasons, predictions (months by stores)."""
    pred = np.full(ys.shape, np.nan)
    many = int(np.searchsorted(-n, -SEASONAL_FROM, "right"))  # stores with seasons
    found = []
    if many:
        found.append(_fold(ys[:, :many], n[:many], first[:many], True, pred[:, :many]))
        _fold(ys[:SEASONAL_FROM, :many], n[:many], first[:many], False, pred[:, :many])
    if many < len(n):
        found.append(_fold(ys[:n[many], many:], n[many:], first[many:], False, pred[:, many:]))
    return (*[np.concatenate(x) for x in zip(*found)], pred)


def _fit_batch(batch: pa.RecordBatch, windows: int) -> pa.RecordBatch:
    """store_id, n and the fields of _FITTED for the batch's store_id, n, ys."""
    flat = batch.column("ys").flatten()
    value, missing = flat.to_numpy(zero_copy_only=False), flat.is_null().to_numpy(zero_copy_only=False)
    n = batch.column("n").to_numpy()
    start, size = np.cumsum(n) - n, len(n)
    first = np.maximum(MIN_HISTORY["ETS_DAMPED"], n - max(1, windows))
    folds = np.maximum(n - first, 0)
    at = np.cumsum(folds) - folds
    owner = np.repeat(np.arange(size), folds)
    month = start[owner] + first[owner] + np.arange(len(owner)) - at[owner]  # of each fold, in `value`
    params, sse, level, trend, season = np.empty((size, 4)), np.empty(size), np.empty(size), np.empty(size), np.empty((size, PERIOD))
    pred = np.empty(len(value))
    order = np.argsort(-n, kind="stable")
    for some in (order[i:i + TOGETHER] for i in range(0, size, TOGETHER)):
        inside = np.arange(n[some[0]])[:, None] < n[some]
        cell = (start[some] + np.arange(n[some[0]])[:, None])[inside]
        ys = np.full(inside.shape, np.nan)
        ys[inside] = value[cell]
        with np.errstate(all="ignore"):  # months may be NaN, infinite or huge
            params[some], sse[some], level[some], trend[some], season[some], out = _fit(ys, n[some], first[some])
        pred[cell] = out[inside]
    # after a month without revenue nothing is known: no error, level or trend, and predictions of zero
    lost = np.concatenate([[0], np.cumsum(missing)])
    known = np.where((lost[:-1] > lost[np.repeat(start, n)]) | (pred <= 0), 0.0, pred)
    void = lost[start + n] > lost[start]
    cast = lambda x, mask=None: pa.array(x, pa.float64(), mask=mask, from_pandas=False)
    lists = lambda ends, values: pa.ListArray.from_arrays(pa.array(np.concatenate([[0], ends]), pa.int32()), values)
    told = pa.StructArray.from_arrays([cast(value[month], missing[month]), cast(value[month - 1], missing[month - 1]), cast(known[month])], ["y", "prev", "pred"])
    return pa.RecordBatch.from_arrays(
        [batch.column("store_id"), batch.column("n"), cast(sse, void), pa.StructArray.from_arrays([cast(c) for c in params.T.copy()], _PARAMS), cast(level, void),
         cast(trend, void), lists(PERIOD * np.arange(1, size + 1), cast(season.ravel())), lists(np.cumsum(folds), told)],
        ["store_id", "n", "sse", "params", "level", "trend", "season", "folds"])


def fit_damped(history: DataFrame, horizon: int, windows: int = BACKTEST_WINDOWS) -> DataFrame:
    """One row per store with at least MIN_HISTORY months: (store_id, n, params, sse, points, folds).

    `params` is the grid point with the smallest squared one-step error over all months and `points` its forecasts.
    `folds` (y, prev, pred) is the rolling back-test: month t is predicted by the grid point that was best over the
    months before t, seasonally where those are 24 or more. The recursion only looks back, so one run per grid
    point has every prefix: its errors before t and its prediction of t. A store is one short array, worked out after one shuffle."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                yield _fit_batch(batch, windows)

    months = F.array_sort(F.collect_list(F.struct("month", F.col("revenue").cast("double").alias("revenue"))))
    series = history.groupBy("store_id").agg(months.alias("_months")).select(
        "store_id", F.size("_months").cast("long").alias("n"), F.transform("_months", lambda x: x["revenue"]).alias("ys"))
    series = series.filter(F.col("n") >= MIN_HISTORY["ETS_DAMPED"])
    fitted = series.mapInArrow(run, f"store_id {series.schema['store_id'].dataType.simpleString()}, n long, {_FITTED}")
    phi = F.col("params.phi")
    point = lambda h: F.greatest(d(0), F.col("level") + F.col("trend") * phi * (1 - F.pow(phi, h)) / (1 - phi) + F.col("season")[F.pmod(h - 1, F.lit(PERIOD))])
    return fitted.select("store_id", "n", "params", "sse", F.transform(F.sequence(F.lit(1), F.lit(horizon)), point).alias("points"), "folds")


def ets_metrics(fits: DataFrame) -> DataFrame:
    """Rolling errors in the shape of the back-test metrics, for the stores in whose contest the model takes part."""
    size = F.nullif(F.size("folds"), F.lit(0))
    mean = lambda value: F.aggregate("folds", d(0), lambda acc, x: acc + value(x)) / size
    scale = lambda x: F.abs(x["y"]) + F.abs(x["pred"])
    hit = lambda x: F.signum(x["pred"] - x["prev"]) == F.signum(x["y"] - x["prev"])
    out = fits.filter(F.col("n") >= SEASONAL_FROM).withColumn("mae", mean(lambda x: F.abs(x["y"] - x["pred"])))
    return out.select(
        "store_id", F.lit("ETS_DAMPED").alias("model"), "n", F.size("folds").cast("long").alias("folds"), F.lit(False).alias("failed"), "mae",
        mean(lambda x: F.when(scale(x) == 0, d(0)).otherwise(2 * F.abs(x["y"] - x["pred"]) / scale(x))).alias("smape"),
        mean(lambda x: hit(x).cast("double")).alias("directional_accuracy"),
        mean(lambda x: (F.abs(x["y"] - x["pred"]) <= F.col("mae") * INTERVAL_Z).cast("double")).alias("interval_coverage"))


def ets_points(fits: DataFrame) -> DataFrame:
    return fits.select("store_id", "n", F.lit("ETS_DAMPED").alias("model"), F.posexplode("points").alias("i", "point")) \
        .select("store_id", "n", "model", (F.col("i") + 1).alias("month_index"), "point")
