import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from tillwise.functions.core import whole_won
from tillwise.functions.stages import one_plan
from tillwise.operators import ledger as lg
from tillwise.operators.loans import loan_schedule

LOAN = ("store_id bigint, loan_id bigint, principal double, annual_rate double, rate_type string, repayment_type string, remaining_months int, "
        "next_payment_date date, grace_end_date date, renewal_month int, custom array<struct<principal:double,interest:double>>, grace_months int, delta double")


def loan(i, kind, principal, rate, months, rate_type="FIXED", nxt=None, grace_end=None, renewal=None, custom=None, grace=0, delta=0.0):
    return (1, i, float(principal), rate, rate_type, kind, months, nxt, grace_end, renewal, custom, grace, delta)


def by_month(row, horizon, start):
    """Month-by-month repayment, the slow way."""
    (_, _, principal, rate, rate_type, kind, remaining, nxt, grace_end, renewal, custom, grace, delta) = row
    out, balance, active = [], principal, 0
    for i in range(1, horizon + 1):
        month = start.year * 12 + start.month - 1 + i - 1
        r = max(0.0, rate + (delta if rate_type == "VARIABLE" and i >= (renewal or 1) else 0.0))
        if balance <= 0 or (nxt and month < nxt.year * 12 + nxt.month - 1):
            out.append((i, max(balance, 0.0), 0.0, 0.0, "OK"))
            continue
        active += 1
        if active > remaining:
            out.append((i, balance, 0.0, 0.0, "OK"))
            continue
        m, interest = r / 12, balance * r / 12
        last = active == remaining
        if kind == "BULLET":
            paid = balance if last else 0.0
        elif kind == "EQUAL_PRINCIPAL":
            paid = min(balance, principal / remaining)
        elif kind == "AMORTIZING":
            left = remaining - active + 1
            paid = balance if last else balance / left if m == 0 else min(balance, balance * m / ((1 + m) ** left - 1))
        else:
            if not custom or len(custom) < active:
                out.append((i, balance, None, None, "CUSTOM_SCHEDULE_MISSING"))
                continue
            paid, interest = custom[active - 1]
        if active <= grace or (grace_end and month <= grace_end.year * 12 + grace_end.month - 1):
            paid = 0.0
        paid = min(paid, balance)
        out.append((i, balance, interest, paid, "OK"))
        balance -= paid
    return out


def test_known_payments(spark):
    rows = [loan(1, "BULLET", 12e6, 0.12, 12), loan(2, "EQUAL_PRINCIPAL", 6e6, 0.12, 6)]
    df = loan_schedule(spark.createDataFrame(rows, LOAN), F.lit(6)).orderBy("loan_id", "month_index").collect()
    assert [round(r.interest) for r in df[:6]] == [120000] * 6
    assert [round(r.interest) for r in df[6:]] == [60000, 50000, 40000, 30000, 20000, 10000]
    assert round(df[-1].closing, 6) == 0


def test_long_amortization_closes(spark):
    df = loan_schedule(spark.createDataFrame([loan(1, "AMORTIZING", 1e8, 0.065, 120)], LOAN), F.lit(120))
    assert df.agg(F.min_by("closing", -F.col("month_index"))).first()[0] == 0
    assert abs(df.agg(F.sum("principal")).first()[0] - 1e8) < 1e-4


def test_closed_form_equals_month_by_month(spark):
    rng = random.Random(7)
    start = dt.date(2026, 8, 1)
    rows = []
    for i in range(300):
        kind = rng.choice(["BULLET", "EQUAL_PRINCIPAL", "AMORTIZING", "CUSTOM_SCHEDULE"])
        custom = [(rng.uniform(0, 3e5), rng.uniform(0, 1e4)) for _ in range(rng.randint(1, 14))] if kind == "CUSTOM_SCHEDULE" else None
        day = lambda: dt.date(2026 + rng.randint(0, 1), rng.randint(1, 12), rng.randint(1, 28))
        rows.append(loan(i, kind, rng.uniform(1e5, 1e6), rng.choice([0.0, 0.01, 0.07]), rng.randint(1, 18), rng.choice(["FIXED", "VARIABLE"]),
                         rng.choice([None, day()]), rng.choice([None, day()]), rng.choice([None, 1, 3, 9]), custom, rng.choice([0, 0, 2, 30]), rng.choice([0.0, 0.02, -0.05])))
    df = loan_schedule(spark.createDataFrame(rows, LOAN), F.lit(14), F.lit("2026-08-01").cast("date"), F.col("delta"), F.col("grace_months"), keep=["loan_id"])
    got = {(r.loan_id, r.month_index): r for r in df.collect()}
    for row in rows:
        for i, opening, interest, paid, status in by_month(row, 14, start):
            r = got[(row[1], i)]
            assert r.status == status, (row, i)
            assert r.opening == pytest.approx(opening, abs=1e-5), (row, i)
            assert (r.principal is None) == (paid is None) and (paid is None or r.principal == pytest.approx(paid, abs=1e-5)), (row, i)
            assert interest is None or r.interest == pytest.approx(interest, abs=1e-5), (row, i)


def flows(spark, rows):
    return spark.createDataFrame(rows, "store_id int, month_index int, month date, revenue double, variable_cost double, fixed_cost double, interest double, principal double, tax double, capex double")


def test_break_even_levels(spark):
    r = lg.break_even(flows(spark, [(1, 1, dt.date(2026, 8, 1), 30e6, 12e6, 12e6, 1.2e6, 2e6, 0.2e6, 0.2e6), (2, 1, dt.date(2026, 8, 1), 10.0, 12.0, 5.0, 0.0, 0.0, 0.0, 0.0)]))
    a, b = r.orderBy("store_id").collect()
    assert [round(x) for x in (a.operating_bep, a.financial_bep, a.cash_bep)] == [20_000_000, 22_000_000, 26_000_000]
    assert b.bep_status == "UNATTAINABLE" and b.cash_bep is None


@pytest.mark.parametrize("month,begin,out,day", [("2026-08-01", 5e6, 10e6, "2026-08-15"), ("2028-02-01", 5e6, 12e6, "2028-02-12"), ("2026-08-01", 0.0, 1e6, "2026-08-01")])
def test_burn_day(spark, month, begin, out, day):
    f = flows(spark, [(1, 1, dt.date.fromisoformat(month), 0.0, 0.0, out, 0.0, 0.0, 0.0, 0.0)])
    led = lg.cash_ledger(f, ["store_id"], F.lit(begin)).withColumn("m", F.lit(1e6))
    r = lg.cash_burn(led, ["store_id"], F.col("m")).first()
    assert str(r.burn_date) == day and str(r.liquidity_risk_date) == month


def test_ledger_is_continuous(spark):
    f = flows(spark, [(1, i, dt.date(2026, i, 1), 10.0 * i, 1.0, 2.0, 0.5, 0.5, 0.0, 0.0) for i in range(1, 7)])
    rows = lg.cash_ledger(f, ["store_id"], F.lit(100.0)).orderBy("month_index").collect()
    assert rows[0].beginning_cash == 100.0
    assert all(abs(a.ending_cash - b.beginning_cash) < 1e-9 for a, b in zip(rows, rows[1:]))


def test_won_rounds_half_away(spark):
    r = spark.range(1).select(whole_won(F.lit(2.5)).alias("a"), whole_won(F.lit(-2.5)).alias("b")).first()
    assert (int(r.a), int(r.b)) == (3, -3)


def test_month_without_adjustment_is_neutral(spark):
    start = F.lit("2026-09-01").cast("date")
    runs = spark.createDataFrame([(1, "BASE", dt.date(2026, m, 1), 2.0, 1.0, 1.0, 0.01) for m in (9, 11)],
                                 "store_id int, scenario string, month date, revenue_multiplier double, variable_cost_multiplier double, fixed_cost_multiplier double, rate_delta double")
    got = {r.month.month: (r.revenue_multiplier, r.rate_delta) for r in lg.every_month(runs, ["store_id", "scenario"], 4, start).collect()}
    assert got == {9: (2.0, 0.01), 10: (1.0, 0.0), 11: (2.0, 0.01), 12: (1.0, 0.0)}
    with pytest.raises(Exception, match="(?i)duplicate"):
        lg.every_month(runs.unionByName(runs), ["store_id", "scenario"], 4, start).collect()


def test_uploaded_rows_are_numbered_once(spark):
    from tillwise.plans.registry import QUERIES

    plan = QUERIES["ledger_validate"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert "row_number" not in plan  # the checks read the stored rows; no check numbers a store's months again


def test_rate_changes_meet_loans_whose_terms_are_worked_out(spark):
    """Above the join of loans and rate changes nothing runs entry by entry, and the terms are columns, not computed again for each row."""
    from tillwise.operators.loans import debt_service

    custom = [(1000.0 * i, 10.0 * i) for i in range(1, 5)]
    rows = [loan(1, "CUSTOM_SCHEDULE", 9000, 0.1, 6, custom=custom, grace=1), loan(2, "AMORTIZING", 6e6, 0.12, 8, "VARIABLE", renewal=3), loan(3, "BULLET", 5e5, 0.06, 4, "VARIABLE")]
    loans = spark.createDataFrame(rows, LOAN).drop("delta")
    needed = spark.createDataFrame([(1, x, m) for x in (0.0, 0.02) for m in range(1, 7)], "store_id bigint, rate_delta double, month_index int")
    start = dt.date(2024, 1, 1)
    out = debt_service(loans, needed, ["store_id"], F.lit(start))
    above = out._jdf.queryExecution().optimizedPlan().toString().split("Join Inner")[0]
    assert "aggregate(" not in above and "slice(" not in above and "next_payment_date" not in above
    got = {(r.rate_delta, r.month_index): (r.interest, r.principal) for r in out.collect()}
    for delta in (0.0, 0.02):
        tables = [by_month((*row[:-1], delta), 6, start) for row in rows]
        for m in range(6):
            want = [sum(t[m][i] or 0.0 for t in tables) for i in (2, 3)]
            assert got[delta, m + 1] == pytest.approx(want)


@pytest.mark.parametrize("overrides", [False, True])
def test_ledger_of_stores_broadcasts_no_store(spark, overrides):
    """Stores, months and scenarios grow with the input: no join of theirs may go through the driver, however small they look."""
    from tillwise.plans.q_finance import PAIRS, SCENARIOS, ledger

    with one_plan():
        runs = ledger(spark, "/root/testdata/sf0.001", SCENARIOS, False, overrides)
    for out in (runs, lg.primary_driver(lg.attribution(lg.layer_delta(runs, PAIRS)))):
        plan = out._jdf.queryExecution().executedPlan().toString()
        assert "BroadcastHashJoin" not in plan and "SortMergeJoin" in plan
