import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from tillwise.operators import forecast as fc
from tillwise.operators import smoothing


def predict(name, v):
    if name == "RECENT_MEAN":
        w = v[-6:]
        return max(0.0, sum(w) / len(w))
    if name == "RECENT_TREND":
        w = v[-6:]
        return max(0.0, w[-1] + sum(b - a for a, b in zip(w, w[1:])) / (len(w) - 1))
    if name == "DAMPED_TREND":
        w = v[-12:]
        return max(0.0, w[-1] + (w[-1] - w[0]) / (len(w) - 1) * 0.8)
    return max(0.0, v[-12])


def history(spark, series):
    rows = [(s, dt.date(2020 + i // 12, i % 12 + 1, 1), v) for s, vs in series.items() for i, v in enumerate(vs)]
    return spark.createDataFrame(rows, "store_id int, month date, revenue double")


def test_backtest_equals_refitting_each_split(spark):
    rng = random.Random(3)
    series = {s: [rng.uniform(0, 100) for _ in range(rng.choice([6, 9, 12, 17, 23, 30]))] for s in range(25)}
    got = {(r.store_id, r.model): r for r in fc.backtest_metrics(history(spark, series)).collect()}
    for s, vs in series.items():
        n = len(vs)
        names = ["RECENT_MEAN", "RECENT_TREND"] if n < 12 else ["RECENT_MEAN", "SEASONAL_NAIVE"] + (["DAMPED_TREND"] if n < 24 else [])
        for name in names:
            splits = range(max(fc.MIN_HISTORY[name], 4, n - 12), n)
            pairs = [(predict(name, vs[:i]), vs[i], vs[i - 1]) for i in splits]
            r = got[(s, name)]
            assert r.folds == len(pairs)
            if not pairs:
                assert r.mae is None and r.smape is None
                continue
            mae = sum(abs(a - p) for p, a, _ in pairs) / len(pairs)
            assert r.mae == pytest.approx(mae)
            assert r.smape == pytest.approx(sum(2 * abs(a - p) / (a + p) if a + p else 0 for p, a, _ in pairs) / len(pairs))
            sign = lambda x: (x > 0) - (x < 0)
            assert r.directional_accuracy == pytest.approx(sum(sign(p - b) == sign(a - b) for p, a, b in pairs) / len(pairs))
            assert r.interval_coverage == pytest.approx(sum(abs(a - p) <= mae * 1.96 for p, a, _ in pairs) / len(pairs))


def test_short_history_is_not_modelled(spark):
    stores = spark.createDataFrame([(1, None), (2, 50.0), (3, None)], "store_id int, declared_revenue double")
    h = history(spark, {1: [10.0, 20.0], 2: [10.0]})
    rows = {r.store_id: r for r in fc.fallback_forecast(stores, h).collect()}
    assert (rows[1].model, rows[1].point) == ("LAST_OBSERVED_ASSUMPTION", 20.0)
    assert (rows[2].model, rows[2].width) == ("DECLARED_BASELINE", 10.0)
    assert rows[3].status == "INSUFFICIENT_DATA" and rows[3].point is None


def run(vs, seasonal, a, b, g, p):
    """(fits, squared errors before each month, level, trend, seasons) of one grid point."""
    level = sum(vs[:12]) / 12 if seasonal else vs[0]
    season = [v - level for v in vs[:12]] if seasonal else [0.0] * 12
    trend = (sum(vs[12:24]) / 12 - level) / 12 if seasonal else vs[1] - vs[0]
    fits, before, sse = [], [], 0.0
    for t, y in enumerate(vs):
        ahead, old = level + p * trend, season[t % 12]
        fits.append(ahead + old)
        before.append(sse)
        sse += (y - ahead - old) ** 2
        new = a * (y - old) + (1 - a) * ahead
        trend = b * (new - level) + (1 - b) * p * trend
        if seasonal:
            season[t % 12] = g * (y - ahead) + (1 - g) * old
        level = new
    return fits, before + [sse], level, trend, season


def grid(seasonal):
    return [(a, b, g, p) for a in smoothing.ALPHA for b in smoothing.BETA for g in (smoothing.GAMMA if seasonal else [0.0]) for p in smoothing.PHI]


def test_smoothing_never_sees_the_month_it_predicts(spark):
    """Every fold is fitted anew on its prefix alone; the forecast on all months."""
    rng = random.Random(5)
    series = {n: [50 + 3 * i + 20 * (i % 12 == 3) + rng.uniform(-9, 9) for i in range(n)] for n in (17, 18, 19, 23, 24, 25, 30, 47)}
    got = {r.store_id: r for r in smoothing.fit_damped(history(spark, series), 3).collect()}
    assert 17 not in got
    metrics = {r.store_id: r for r in smoothing.ets_metrics(smoothing.fit_damped(history(spark, series), 3)).collect()}
    assert set(metrics) == {24, 25, 30, 47}
    for n, vs in series.items():
        if n == 17:
            continue
        want = []
        for t in range(max(18, n - 12), n):
            seasonal = t >= 24
            prefix = vs[:t]
            best = min((run(prefix, seasonal, *point)[1][-1], point) for point in grid(seasonal))[1]
            _, _, level, trend, season = run(prefix, seasonal, *best)
            want.append((vs[t], vs[t - 1], max(0.0, level + best[3] * trend + season[t % 12])))
        assert [tuple(f) for f in got[n].folds] == [pytest.approx(w) for w in want]
        best = min((run(vs, n >= 24, *point)[1][-1], point) for point in grid(n >= 24))
        assert (got[n].sse, tuple(got[n].params)) == (pytest.approx(best[0]), best[1])
        _, _, level, trend, season = run(vs, n >= 24, *best[1])
        phi = best[1][3]
        assert got[n].points == pytest.approx([max(0.0, level + trend * sum(phi**k for k in range(1, h + 1)) + season[(n + h - 1) % 12]) for h in (1, 2, 3)])
        if n in metrics:
            errors = [abs(y - p) for y, _, p in want]
            assert metrics[n].folds == len(want) and metrics[n].mae == pytest.approx(sum(errors) / len(errors))
            assert metrics[n].interval_coverage == pytest.approx(sum(e <= 1.96 * metrics[n].mae for e in errors) / len(errors))


def test_ets_can_win_the_contest(spark):
    vs = [100.0 + (i % 12) * 5 + i * 2 for i in range(36)]
    h = history(spark, {1: vs})
    stores = spark.createDataFrame([(1, None)], "store_id int, declared_revenue double")
    fits = smoothing.fit_damped(h, 6)
    out = fc.baseline_forecast(stores, h, F.lit("2023-01-01").cast("date"), 6, extra_metrics=smoothing.ets_metrics(fits), extra_points=smoothing.ets_points(fits))
    rows = out.collect()
    assert len(rows) == 6 and {r.model for r in rows} == {"ETS_DAMPED"}


def test_smoothing_takes_many_stores_a_step(spark):
    """No fold row by row; stores of all lengths, months without revenue and NaN do not disturb each other."""
    rng = random.Random(9)
    series = {s: [rng.uniform(0, 500) + 9 * (i % 12) for i in range(18 + s % 40)] for s in range(2 * smoothing.TOGETHER + 3)}
    series[7][20], series[8][3] = None, float("nan")
    fits = smoothing.fit_damped(history(spark, series), 3)
    plan = fits._jdf.queryExecution().optimizedPlan().toString()
    assert "MapInArrow" in plan and "aggregate(" not in plan
    got = {r.store_id: r for r in fits.collect()}
    assert set(got) == set(series)
    assert got[7].sse is None and got[7].points == [0.0] * 3 and [f.pred for f in got[7].folds if f.y is not None][-1] == 0.0
    assert got[8].sse != got[8].sse
    alone = [5, 6, 9, 39, 300]
    for s in alone:
        assert smoothing.fit_damped(history(spark, {s: series[s]}), 3).collect() == [got[s]]
