import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from tillwise.functions.geo import geo_exposure, haversine_m
from tillwise.functions.skew import neighbour, spread_rank
from tillwise.operators import events as ev
from tillwise.operators import metrics as mt
from tillwise.operators import official as of
from tillwise.operators import signals as sg
from tillwise.operators.spatial import radius_points
from tillwise.sources.registry import TIER_RANK


def test_one_degree_at_the_equator(spark):
    r = spark.range(1).select(haversine_m(*[F.lit(x) for x in (0.0, 0.0, 0.0, 1.0)]).alias("m")).first()
    assert r.m == pytest.approx(111_194.9266, abs=1e-3)


def test_missing_place_has_no_exposure(spark):
    r = spark.range(1).select(geo_exposure(F.lit(1.0), F.lit(1.0), F.lit(None).cast("double"), F.lit(1.0)).alias("a"), geo_exposure(F.lit(1.0), F.lit(1.0), F.lit(99.0), F.lit(1.0)).alias("b")).first()
    assert (r.a.status, r.a.exposure, r.b.status) == ("EXCLUDED_DUE_TO_MISSING_GEO", 0.0, "EXCLUDED_DUE_TO_INVALID_GEO")


def fold(group):
    """Reports of one fingerprint, one after the other."""
    out, base = {}, None
    for e in sorted(group, key=lambda x: x[0]):
        if base is None:
            base, status, code = e, "ACCEPTED", None
            continue
        if (base[5] and e[5]) or base[2:4] == e[2:4]:
            out[e[0]] = ("REFERENCE_ONLY", "DUPLICATE_EVENT")
            continue
        left, right = TIER_RANK[base[4]], TIER_RANK[e[4]]
        if left == right:
            status, code = "CONFLICTED", "SOURCE_CONFLICT"
            out[e[0]] = (status, code)
        elif right > left:
            out[base[0]] = ("REFERENCE_ONLY", "SOURCE_CONFLICT")
            base, status, code = e, "ACCEPTED", None
        else:
            out[e[0]] = ("REFERENCE_ONLY", "SOURCE_CONFLICT")
    out[base[0]] = (status, code)
    return out


def test_reconcile_equals_the_sequential_fold(spark):
    rng = random.Random(11)
    rows = [(i, f"F{rng.randint(0, 25)}", dt.date(2026, 1, rng.randint(1, 3)), rng.choice(["a", "b"]), rng.choice(list(TIER_RANK)), False) for i in range(400)]
    rows += [(1000 + i, "BOK", dt.date(2026, 2, i % 5 + 1), "x", rng.choice(list(TIER_RANK)), True) for i in range(20)]
    rows += [(2000 + i, f"M{i % 9}", dt.date(2026, 3, rng.randint(1, 2)), "y", rng.choice(list(TIER_RANK)), rng.random() < 0.5) for i in range(120)]
    df = spark.createDataFrame(rows, "event_id int, fingerprint string, start_date date, address string, source_tier string, exempt boolean").withColumn("end_date", F.lit(None).cast("date"))
    got = {r.event_id: (r.status, r.code) for r in ev.reconcile(df).collect()}
    want = {}
    for f in {r[1] for r in rows}:
        want.update(fold([r for r in rows if r[1] == f]))
    assert got == want


def test_bridge_equals_the_sequential_one(spark):
    rng = random.Random(2)
    base, as_of = dt.date(2026, 3, 1), dt.date(2026, 6, 30)
    obs = spark.createDataFrame([("O1", "BASE_RATE", 3.0, "PERCENT", base, base, "VALID")], "observation_id string, indicator_id string, value double, unit string, observed_at date, available_at date, quality_status string")
    rows = [(i, "BASE_RATE_INCREASE", base + dt.timedelta(days=rng.randint(-20, 150)), rng.choice(["OFFICIAL_PRIMARY", "OFFICIAL_PRIMARY", "OTHER"]), "ORG-BOK", "BASE_RATE", float(i), "PERCENT", True) for i in range(60)]
    events = spark.createDataFrame(rows, "event_id int, event_type string, start_date date, source_tier string, actor string, declared_indicator string, value double, unit string, evidenced boolean")
    got = {r.event_id: (r.status, r.latest_official_value) for r in of.bridge_events(events, obs, F.lit(as_of)).collect()}
    latest, want = (base, 3.0), {}
    for e in sorted(rows, key=lambda x: (x[2], x[0])):
        known = latest[1]
        if e[3] != "OFFICIAL_PRIMARY":
            status = "INELIGIBLE"
        elif e[2] <= latest[0]:
            status = "EXPIRED"
        elif e[2] > as_of:
            status = "INELIGIBLE"
        else:
            status, latest = "APPLIED", (e[2], e[6])
        want[e[0]] = (status, known)
    assert got == want


def test_features_ignore_stale_and_cap_changes(spark):
    day = lambda m: dt.date(2026, m, 1)
    rows = [("a1", "USD_KRW", 1000.0, day(1)), ("a2", "USD_KRW", 2000.0, day(2)), ("b1", "BASE_RATE", 3.0, day(1)), ("b2", "BASE_RATE", 3.5, day(2)), ("c1", "FOOD_INDEX", 5.0, day(2))]
    obs = spark.createDataFrame([(i, k, v, "PERCENT" if k == "BASE_RATE" else "X", d, d, "VALID") for i, k, v, d in rows], "observation_id string, indicator_id string, value double, unit string, observed_at date, available_at date, quality_status string")
    f = {r.month_index: r for r in of.monthly_features(of.project_indicators(obs, F.lit(day(3)), 6)).collect()}
    assert f[1].imported_multiplier == pytest.approx(1.05) and f[6].imported_multiplier == pytest.approx(1.12)
    assert f[1].interest_rate_delta == pytest.approx(0.005) and f[1].domestic_multiplier == 1.0
    # both ingredient indicators count in the mean, also the one without a previous value
    assert f[1].ingredient_multiplier == pytest.approx(1.025)


def test_signal_multiplier_golden(spark):
    s = spark.createDataFrame([(1, -1.0), (1, -1.0)], "k int, raw double")
    assert sg.signal_multiplier(s, ["k"]).first().multiplier == 1.1052


def test_radius_search_equals_brute_force(spark):
    rng = random.Random(4)
    pts = [(round(rng.uniform(37, 37.1), 4), round(rng.uniform(127, 127.1), 4)) for _ in range(300)] * 2
    stores = [(i, round(rng.uniform(37, 37.1), 4), round(rng.uniform(127, 127.1), 4)) for i in range(20)]
    s = spark.createDataFrame(stores, "store_id int, lat double, lon double")
    e = spark.createDataFrame(pts, "lat double, lon double")
    want = s.select("store_id", F.col("lat").alias("a"), F.col("lon").alias("b")).join(e.groupBy("lat", "lon").count(), haversine_m(F.col("a"), F.col("b"), F.col("lat"), F.col("lon")) <= 1500)
    got = radius_points(s, e, 1500.0)
    key = lambda df, n: sorted((r.store_id, r.lat, r.lon, r[n]) for r in df.collect())
    assert key(got, "event_count") == key(want, "count")


def test_bucketed_neighbours_and_ranks(spark):
    rng = random.Random(9)
    rows = [(rng.choice("ab"), i, dt.date(2020, 1, 1) + dt.timedelta(days=rng.randint(0, 2000))) for i in range(200)]
    df = spark.createDataFrame(rows, "k string, id int, day date")
    for after in (True, False):
        got = {r.id: r.n for r in neighbour(df, ["k"], ["day", "id"], F.year("day"), F.col("id"), "n", after).collect()}
        for k in "ab":
            ids = [r[1] for r in sorted((r for r in rows if r[0] == k), key=lambda r: (r[2], r[1]))]
            for i, x in enumerate(ids):
                j = i + 1 if after else i - 1
                assert got[x] == (ids[j] if 0 <= j < len(ids) else None)
    ranks = {r.id: r.rank for r in spread_rank(df, ["k"], F.year("day"), [F.col("day"), F.col("id")], "rank").collect()}
    for k in "ab":
        ids = [r[1] for r in sorted((r for r in rows if r[0] == k), key=lambda r: (r[2], r[1]))]
        assert [ranks[i] for i in ids] == list(range(1, len(ids) + 1))


def test_sliding_counts_equal_brute_force(spark):
    rng = random.Random(8)
    t0 = dt.datetime(2026, 1, 1)
    rows = [(i, rng.choice("ab"), t0 + dt.timedelta(seconds=rng.randint(0, 600))) for i in range(150)]
    df = spark.createDataFrame(rows, "id int, c string, ts timestamp")
    got = {r.id: r.window_count for r in mt.sliding_counts(df, "c", "ts", 60, 3).collect()}
    for i, c, t in rows:
        assert got[i] == sum(1 for _, c2, t2 in rows if c2 == c and dt.timedelta(0) <= t - t2 < dt.timedelta(seconds=60))


def test_percentile_takes_the_lower_index(spark):
    df = spark.createDataFrame([("m", i, float(i)) for i in range(1, 11)], "k string, ts int, value double")
    r = mt.latency_percentiles(df, "k").first()
    assert (r.p50, r.p95) == (5.0, 9.0)


def test_percentiles_take_all_samples(spark):
    rng = random.Random(3)
    rows = [(k, float(rng.choice([0, 1, 2, 5, 80, -3, 1000, rng.randint(0, 9999)]))) for k in "ab" for _ in range(2500)] + [("a", None)]
    got = {r.k: r for r in mt.latency_percentiles(spark.createDataFrame(rows, "k string, value double"), "k").collect()}
    for k in "ab":
        v = sorted(x for key, x in rows if key == k and x is not None)
        assert (got[k].sample_count, got[k].p50, got[k].p95) == (2500, v[int(2499 * 0.5)], v[int(2499 * 0.95)])


def test_blank_official_value_passes(spark):
    rows = spark.createDataFrame([(1, None, None), (2, "", None), (3, "n/a", None), (4, None, "%")], "id int, new_raw string, unit_raw string").withColumns(
        {"event_type": F.lit("BASE_RATE_INCREASE"), "old_raw": F.lit(None).cast("string")})
    got = {r.id: r.status for r in ev.value_direction(rows).collect()}
    assert got == {1: "OK", 2: "OK", 3: "OFFICIAL_NUMERIC_UNIT_INVALID", 4: "OFFICIAL_NUMERIC_UNIT_INVALID"}
    assert [r.status for r in ev.value_direction(rows.drop("unit_raw").filter("id < 4")).orderBy("id").collect()] == ["OK", "OK", "OFFICIAL_NUMERIC_UNIT_INVALID"]
