import datetime as dt
import json

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from tillwise.operators.results import result_hash
from tillwise.sources import ledger_csv
from tillwise.sources.sinks import append_once
from tillwise.streaming import feeds

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
# a spread over every query module; tools/check.py runs all of them
SAMPLE = ["model_selection", "official_features", "event_bridge", "loan_schedule", "cash_burn", "dedupe_causes", "eligibility", "evidence_check", "quality_gate", "sliding_rate_flags",
          "evidence_repair", "page_class", "local_quality_gate", "policy_term_evidence", "merge_policies", "program_lists", "ets_backtest", "radius_summary", "scenario_alignment", "stream_vintages", "bundle_status_of_calls"]


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return con


def plain(rows, columns):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    cell = lambda v: round(float(v), 9) if isinstance(v, (int, float)) and not isinstance(v, bool) else v
    return sorted((tuple(cell(r[i]) for i in order) for r in rows), key=repr)


def test_every_oracle_belongs_to_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.parametrize("name", SAMPLE)
def test_query_equals_its_oracle(spark, duck, name):
    df = entry.queries()[name](spark, SF)
    cur = duck.execute(entry.oracle_sql()[name])
    columns = [c[0] for c in cur.description]
    assert plain(df.collect(), df.columns) == plain(cur.fetchall(), columns)


def test_entry_runs(spark):
    assert len(entry.entry(spark).collect()) > 0


def test_result_does_not_depend_on_partitioning(spark):
    df = spark.range(500).select((F.col("id") % 3).alias("k"), "id", F.rand(1).alias("noise"))
    a = result_hash(df.repartition(7), ["k"], ["noise"]).collect()
    b = result_hash(df.orderBy(F.desc("id")).coalesce(1), ["k"], ["noise"]).collect()
    assert {r.k: r.result_hash for r in a} == {r.k: r.result_hash for r in b}


def test_appending_twice_stores_once(spark, tmp_path):
    path = str(tmp_path / "t")
    df = spark.createDataFrame([(1, "a"), (1, "b"), (2, "c")], "id int, v string")
    append_once(df, path, ["id"], ["v"])
    append_once(df.union(spark.createDataFrame([(3, "d")], df.schema)), path, ["id"], ["v"])
    assert sorted((r.id, r.v) for r in spark.read.parquet(path).collect()) == [(1, "a"), (2, "c"), (3, "d")]


def test_late_and_repeated_rows_reach_the_table_once(spark, tmp_path):
    day = lambda d: dt.datetime(2026, 1, d)
    src = str(tmp_path / "src")
    schema = "id string, ts timestamp"
    for rows in ([("a", day(1)), ("b", day(2))], [("a", day(1)), ("c", day(9))], [("b", day(2)), ("d", day(3))]):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(src)
    table = feeds.ingest_once(feeds.open_stream(spark, src, spark.read.parquet(src).schema), "id", "ts", str(tmp_path / "out"))
    assert sorted(r.id for r in spark.read.parquet(table).collect()) == ["a", "b", "c", "d"]


def test_ledger_csv_findings(spark, tmp_path):
    head = "store_id,row_index,month,revenue_krw,variable_costs_krw,fixed_costs_krw\n"
    (tmp_path / "a.csv").write_text(head + "1,0,2026-01,\"1,000\",1,1\n1,1,2026-03,-1,1,1\n1,2,2026-03,5,x,1\n1,3,03/2026,5,1,1\n")
    out = ledger_csv.validate_ledger(ledger_csv.read_ledger_csv(spark, str(tmp_path)))
    found = {(r.step, r.column, r.detail) for r in out.filter("severity = 'ERROR'").collect()}
    assert found == {("RANGE_CHECK", "revenue_krw", None), ("DATA_TYPE", "variable_costs_krw", None), ("DATA_TYPE", "month", None),
                     ("TIMESERIES_CONTINUITY", "month", "duplicate 2026-03"), ("TIMESERIES_CONTINUITY", "month", "missing between 2026-01 and 2026-03")}
    bare = spark.createDataFrame([("1", "0", "2026-01")], "store_id string, row_index string, month string")
    assert {r.column for r in ledger_csv.validate_ledger(bare).collect()} == {"revenue_krw", "variable_costs_krw", "fixed_costs_krw"}


def test_whole_analysis(spark):
    from tillwise.plans import bindings as b
    from tillwise.plans.analysis import run_analysis
    from tillwise.plans.q_events import caused

    stores = b.stores(spark, SF).withColumns({"open_from": F.lit(9), "open_to": F.lit(20)})
    tables = {"stores": stores, "history": b.history(spark, SF), "loans": b.loans(spark, SF), "observations": b.monthly_observations(spark, SF), "events": caused(spark, SF),
              "found_events": b.found_by(spark, SF), "policies": b.policies(spark, SF), "found_policies": b.policy_pairs(spark, SF), "fixed_cost_overrides": b.overrides(spark, SF)}
    out = run_analysis("RUN-1", tables, b.as_of(), b.start(), b.window_end(), b.HORIZON)
    n = stores.count()
    ledger = out["ledger"]
    assert ledger.count() == n * b.HORIZON * 4
    # every month ends where the next begins, and effects add up to the change in net cash
    gap = out["attribution"].groupBy("store_id", "from_layer", "to_layer").agg(F.sum("effect").alias("e"))
    net = ledger.groupBy("store_id", "scenario").agg(F.sum("net").alias("net"))
    a, c = net.selectExpr("store_id", "scenario as from_layer", "net as n0"), net.selectExpr("store_id", "scenario as to_layer", "net as n1")
    assert gap.join(a, ["store_id", "from_layer"]).join(c, ["store_id", "to_layer"]).filter("abs(e - (n1 - n0)) > 1e-3").count() == 0
    assert out["cash_burn"].count() == n * 4 and out["ranked_policies"].filter("rank = 1").count() <= n


def test_stages_belong_to_one_plan(spark):
    from tillwise.functions.stages import one_plan, staged

    def run(n):
        with one_plan():
            first = staged(spark, "RUN-1:rows", lambda: spark.range(n))
            assert staged(spark, "RUN-1:rows", lambda: spark.range(99)) is first
            return first

    assert [run(1).count(), run(5).count()] == [1, 5]
    assert staged(spark, "RUN-1:rows", lambda: spark.range(3)).count() == 3


def test_bad_provider_rows_stay_rows_with_a_code(spark):
    from tillwise.sources import landed

    record = lambda **x: {"STAT_CODE": "722Y001", "ITEM_CODE1": "0101000", "ITEM_CODE2": "", "TIME": "200105", "DATA_VALUE": "4.0", **x}
    body = json.dumps({"StatisticSearch": {"row": [record(), record(STAT_CODE="zzz"), record(TIME="2001"), record(DATA_VALUE="-")]}})
    payloads = spark.createDataFrame([(body,)], "payload string")
    assert landed.bank_observations(payloads).count() == 1
    assert sorted(r.code for r in landed.rejects(landed.judged_bank_rows(payloads)).collect()) == ["PERIOD_INVALID", "SERIES_UNKNOWN", "VALUE_INVALID"]
    rows = spark.createDataFrame([("090111", "2001.05", "10", "2"), ("-", "2001.05", "1", "1"), ("090111", "2001.05", "-3", "2"), ("090111", "x", "1", "1")], "hsCode string, year string, impDlr string, impWgt string")
    assert landed.customs_observations(rows).count() == 3
    assert sorted(r.code for r in landed.rejects(landed.judged_customs_rows(rows)).collect()) == ["COMMODITY_MISSING", "PERIOD_INVALID", "VALUE_INVALID"]
