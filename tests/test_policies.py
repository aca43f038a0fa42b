import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from tillwise.operators import policies as po
from tillwise.operators import programs as pg

def compatible(x, y):
    return all(x[k] == y[k] for k in x.keys() & y.keys())


def statements(spark, seed, n=150, blocks=4, names=("limit_krw", "region", "condition:a", "condition:b"), full=()):
    """Notices with random terms of few values; `full` are stated by all."""
    rng = random.Random(seed)
    rows = [(i, f"A{rng.randrange(blocks)}", "name", "GRANT", sorted((k, str(rng.randrange(2))) for k in names if k in full or rng.random() < 0.6)) for i in range(n)]
    return rows, spark.createDataFrame(rows, "policy_id bigint, authority string, name_key string, policy_type string, terms array<struct<key:string,value:string>>")


@pytest.mark.parametrize("fold, full", [(256, ()), (256, ("limit_krw",)), (1, ()), (3, ("region",))])
def test_grouping_equals_greedy_first_fit(spark, monkeypatch, fold, full):
    """With a small FOLD most statements are placed by rounds of aggregates."""
    monkeypatch.setattr(pg, "FOLD", fold)
    rows, df = statements(spark, 1 + fold, full=full)
    got = {r.policy_id: r.group_id for r in pg.group_programs(df.repartition(3)).collect()}
    for block in {r[1] for r in rows}:
        groups = []
        for r in sorted(x for x in rows if x[1] == block):
            home = next((g for g in groups if all(compatible(dict(r[4]), dict(m[4])) for m in g)), None)
            groups.append([r]) if home is None else home.append(r)
        for g in groups:
            assert {got[m[0]] for m in g} == {g[0][0]}


def test_conflicts_equal_all_pairs(spark):
    rows, df = statements(spark, 5)
    got = {(r.policy_id, r.field) for r in pg.conflict_fields(df).collect()}
    named = lambda k: "eligible_business_category" if k.startswith("condition:") else k
    want = {(x[0], named(k)) for x in rows for y in rows if y[1] == x[1] for k, v in x[4] if dict(y[4]).get(k, v) != v}
    assert got == want


NOTICE = ("policy_id bigint, provider string, name string, policy_type string, purposes array<string>, regions array<string>, include array<string>, exclude array<string>, application_status string, notice_kind string, "
          "app_start date, app_end date, limit_krw bigint, annual_rate_percent double, discount_pp double, coverage_ratio double, fee_percent double, grace_months int, maturity_months int, "
          "conditions array<struct<field:string,op:string,expected:string>>, source_ids array<string>, quotes array<string>, validation_status string, failure_codes array<string>, recommendation_codes array<string>, "
          "budget_status string, method string, collateral boolean")


def notice(i, **kw):
    base = dict(policy_id=i, provider="City Foundation", name="Cafe support program", policy_type="grant", purposes=[], regions=[], include=[], exclude=[], application_status="UNKNOWN", notice_kind="ORIGINAL", app_start=None,
                app_end=None, limit_krw=None, annual_rate_percent=None, discount_pp=None, coverage_ratio=None, fee_percent=None, grace_months=None, maturity_months=None, conditions=[], source_ids=[], quotes=["q"],
                validation_status="VALIDATED", failure_codes=[], recommendation_codes=[], budget_status="UNKNOWN", method=None, collateral=None)
    return tuple({**base, **kw}[c.split()[0]] for c in NOTICE.replace("field:string,op:string,expected:string", "").split(", "))


def programs(spark, rows, documents=()):
    docs = spark.createDataFrame(list(documents), "source_id string, url string, title string, source_type string, published_at timestamp")
    known = pg.with_identity(spark.createDataFrame(rows, NOTICE), docs)
    return {r.program_id: r for r in pg.reconciled(known, pg.group_programs(known)).collect()}, known


def test_equal_programs_of_two_spellings_merge(spark):
    out, known = programs(spark, [notice(1, provider="CITY", source_ids=["s1"]), notice(2, name="2001 Cafe 지원", limit_krw=5, source_ids=["s2"], regions=["KR-11"]), notice(3, limit_krw=5, budget_status="OPEN")])
    (one,) = out.values()
    assert (one.members, one.primary_id, one.limit_krw, one.budget_status, one.group_id) == (3, 2, 5, "OPEN", 1)
    assert one.program_id.startswith("POL-") and one.merge_group.startswith("PMG-") and one.validation_status == "VALIDATED"
    lists = {(r.field, r.value): (r.first_id, r.first_at) for r in pg.list_unions(known.join(pg.group_programs(known), "policy_id")).collect()}
    assert lists == {("source_ids", "s1"): (1, 0), ("source_ids", "s2"): (2, 0), ("regions", "KR-11"): (2, 0)}


def test_sources_decide_the_authority(spark):
    docs = [("a", "https://x.example.org/1", "T 2001", "OTHER", None), ("b", "https://x.example.org/2", "T", "OFFICIAL_PRIMARY", None), ("c", "https://www.visitgangnam.net/", "T", "OTHER", None), ("d", "https://y.example.org/", "T", "OTHER", None)]
    _, known = programs(spark, [notice(1, source_ids=["a", "b"]), notice(2, source_ids=["a", "c"]), notice(3, source_ids=["a", "d"]), notice(4, source_ids=["gone"])], docs)
    got = {r.policy_id: (r.authority, r.years, r.official_sources) for r in known.collect()}
    assert got == {1: ("host:x.example.org", ["2001"], 1), 2: ("gangnamgokr", ["2001"], 0), 3: ("city", ["2001"], 0), 4: ("city", [], 0)}


def test_conflicts_reach_every_row_of_the_sources(spark):
    """Differing limits stay apart and mark both; a third program that shares a source is marked too."""
    out, _ = programs(spark, [notice(1, limit_krw=1, source_ids=["s"]), notice(2, limit_krw=2, source_ids=["t"]), notice(3, name="Other", source_ids=["t"]), notice(4, name="Third", source_ids=["u"])])
    assert {r.primary_id: (r.validation_status, r.conflicting_fields, r.failure_codes) for r in out.values()} == {
        1: ("CONFLICTED", ["limit_krw"], ["SOURCE_CONFLICT"]), 2: ("CONFLICTED", ["limit_krw"], ["SOURCE_CONFLICT"]), 3: ("CONFLICTED", ["limit_krw"], ["SOURCE_CONFLICT"]), 4: ("VALIDATED", [], [])}


def test_corrections_and_terminations_follow_the_program(spark):
    day = dt.date(2001, 5, 1)
    rows = [notice(1), notice(2, notice_kind="TERMINATION", app_start=day), notice(3, notice_kind="CORRECTION"), notice(4, notice_kind="TERMINATION", app_start=day, failure_codes=["X"]), notice(5, name="Alone", notice_kind="CORRECTION")]
    out, _ = programs(spark, rows)
    assert {i: (r.supersedes, r.validation_status) for i, r in out.items()} == {"1": (None, "VALIDATED"), "3": ("1", "VALIDATED"), "2": ("3", "CLOSED"), "4": ("2", "VALIDATED"), "5": (None, "VALIDATED")}


def test_empty_notices(spark):
    known = pg.with_identity(spark.createDataFrame([], NOTICE), spark.createDataFrame([], "source_id string, url string, title string, source_type string, published_at timestamp"))
    assert pg.reconciled(known, pg.group_programs(known)).count() == 0 and pg.conflict_fields(known).count() == 0


def test_condition_rules(spark):
    numbers = F.create_map(F.lit("employee_count"), F.lit(5.0), F.lit("annual_revenue"), F.lit(None).cast("double"))
    texts = F.create_map(F.lit("business_type_code"), F.lit("FNB_CAFE"), F.lit("credit_band"), F.lit(None).cast("string"))
    cases = [("employee_count", "LE", "5", None), ("store.employee_count", "GT", "5", "FAILED"), ("annual_revenue", "GE", "1", "NEEDS_INFORMATION"), ("annual_revenue", "EXISTS", None, "FAILED"),
             ("annual_revenue", "EXISTS", "false", None), ("business_type_code", "IN", "RETAIL, FNB_CAFE", None), ("business_type_code", "NOT_IN", "FNB_CAFE", "FAILED"), ("shoe", "EQ", "1", "INVALID_RULE"),
             ("employee_count", "LIKE", "5", "INVALID_RULE"), ("employee_count", "EQ", "five", "INVALID_RULE"), ("employee_count", "IN", "4,5", None)]
    df = spark.createDataFrame([(i, [(f, o, e)]) for i, (f, o, e, _) in enumerate(cases)], "i int, conditions array<struct<field:string,op:string,expected:string>>")
    got = {r.i: r.s for r in df.select("i", po.evaluate_conditions(F.col("conditions"), numbers, texts)["status"].alias("s")).collect()}
    assert [got[i] for i in range(len(cases))] == [c[3] for c in cases]


def test_first_failing_condition_decides(spark):
    df = spark.createDataFrame([([("employee_count", "LE", "9"), ("employee_count", "LE", "1"), ("shoe", "EQ", "1")],)], "conditions array<struct<field:string,op:string,expected:string>>")
    r = df.select(po.evaluate_conditions(F.col("conditions"), F.create_map(F.lit("employee_count"), F.lit(5.0)), F.create_map(F.lit("x"), F.lit("y"))).alias("c")).first()
    assert (r.c.status, r.c.field) == ("FAILED", "employee_count")


def test_differing_validations_leave_a_conflict(spark):
    for status, want in (("REJECTED", "CONFLICTED"), ("PARTIALLY_VALIDATED", "PARTIALLY_VALIDATED")):
        out, _ = programs(spark, [notice(1), notice(2, validation_status=status, failure_codes=["X"])])
        (one,) = out.values()
        assert (one.validation_status, one.failure_codes) == (want, ["SOURCE_CONFLICT", "X"])

def test_rules_on_large_numbers_and_optional_fields(spark):
    rule = lambda field, op, expected: F.array(F.struct(F.lit(field).alias("field"), F.lit(op).alias("op"), F.lit(expected).alias("expected")))
    store = spark.createDataFrame([(1, "CAFE", dt.date(2020, 1, 1), 5.0e7, 3, None, 40, "A")],
                                  "store_id int, business_type_code string, business_start_date date, annual_revenue double, employee_count int, declared_revenue double, owner_age int, credit_band string")
    numbers, texts = po.store_maps(F.lit("2026-01-01").cast("date"), store.columns)
    judge = lambda *r: store.select(po.evaluate_conditions(rule(*r), numbers, texts).alias("x")).first().x
    assert judge("annual_revenue", "IN", "50000000, 7") is None and judge("annual_revenue", "NOT_IN", "50000000").status == "FAILED"
    assert judge("owner_age", "GE", "39") is None and judge("credit_band", "EQ", "B").status == "FAILED"


def test_term_evidence_spreads_the_rows_of_one_file(spark):
    rows = spark.sql("""SELECT id AS policy_id, 50000000D AS limit_krw, 2.5D AS annual_rate_percent, CAST(NULL AS DOUBLE) AS discount_pp, 6 AS grace_months, 60 AS maturity_months, DATE '2001-09-01' AS app_start,
        CAST(NULL AS DATE) AS app_end, false AS collateral, 'OPEN' AS budget_status,
        map('limit_krw', 'up to KRW 50,000,000', 'annual_rate_percent', '3 %', 'maturity_months', '5 years', 'grace_months', '6') AS quotes FROM range(0, 8, 1, 1)""")
    out = po.term_evidence(rows)
    assert out.columns == [*rows.columns, "semantic_codes", "explicitly_closed"]
    assert {tuple(r["semantic_codes"]) for r in out.collect()} == {("POLICY_FIELD_EVIDENCE_MISMATCH", "POLICY_FIELD_VALUE_OR_UNIT_MISMATCH", "POLICY_NUMERIC_UNIT_AMBIGUOUS")}
    assert "hashpartitioning(policy_id" in out._jdf.queryExecution().executedPlan().toString()
