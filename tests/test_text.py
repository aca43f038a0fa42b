import datetime as dt

from pyspark.sql import functions as F

from tillwise.functions.dates import normalize_date
from tillwise.functions.places import regions_match, venue_forms
from tillwise.functions.text import norm_text
from tillwise.functions.units import normalize_number
from tillwise.functions.urls import canonical_url, source_class, source_trust
from tillwise.operators import documents as dc
from tillwise.operators import html_pages as hp
from tillwise.sources.landed import customs_observations, provider_failure_code, read_customs_xml


def one(spark, *cols):
    return spark.range(1).select(*cols).first()


def test_folding_is_nfkc(spark):
    df = spark.createDataFrame([("Ａ  ｂ\n①",), (None,)], "t string")
    assert [r[0] for r in df.select(norm_text("t")).collect()] == ["A b 1", None]


def test_dates(spark):
    pub = F.lit("2026-08-03").cast("date")
    cases = {"2026-07-05T09:00": ("2026-07-05", "ISO_DATE_V1"), "‘26.7.5": ("2026-07-05", "KO_DATE_TWO_DIGIT_YEAR_V1"), "8월 9일부터": ("2026-08-09", "KO_DATE_YEAR_FROM_PUBLISHED_AT_V1"),
             "어제": ("2026-08-02", "KO_DATE_RELATIVE_PUBLISHED_AT_V1"), "2026년 2월 30일": ("None", None), "later": ("None", None)}
    for raw, want in cases.items():
        r = one(spark, normalize_date(F.lit(raw), pub).alias("d")).d
        assert (str(r.date), r.rule) == want, raw


def test_numbers(spark):
    for raw, unit, want in [("3.25 %", None, (3.25, "PERCENT")), ("1,500만원", None, (15e6, "KRW")), ("2", "years", (2.0, "YEARS")), ("7", None, (None, None)), ("0.5 %p", None, (0.5, "PERCENTAGE_POINT"))]:
        r = one(spark, normalize_number(F.lit(raw), F.lit(unit) if unit else None).alias("n")).n
        assert (r.value, r.unit) == want, raw


def test_urls(spark):
    u = lambda x: one(spark, canonical_url(F.lit(x)).alias("u")).u
    assert u("HTTPS://Ex.com:443?b=2&utm_x=1&a=%7E1#t") == "https://ex.com/?a=~1&b=2"
    assert u("http://ex.com:8080/p?gclid=1") == "http://ex.com:8080/p" and u("ftp://x") is None
    r = one(spark, source_class(F.lit("bok.or.kr.evil.com")).alias("a"), source_trust(F.lit("x.go.kr")).alias("b"), source_class(F.lit("abc.go.kr"), F.lit("강남구청")).alias("c"))
    assert (r.a, r.b, r.c) == ("OTHER", "OFFICIAL_TRUSTED", "OFFICIAL_LOCAL_GOV")


def test_region_rule_is_three_valued(spark):
    m = lambda s, *p: one(spark, regions_match(F.lit(s), F.array(*[F.lit(x) for x in p]).cast("array<string>")).alias("m")).m
    assert m("11680", "강남구") is True and m("11680", "11650") is False and m("11680", "mars") is None and m("11680") is True
    assert m("11680", "11") is False  # a broader code does not match its districts by default


def test_venue_forms(spark):
    r = one(spark, venue_forms(F.lit("COEX Mall, 2F 일대"), F.array(F.lit("서울특별시 강남구"))).alias("f")).f
    assert r[0] == "COEX Mall, 2F" and r[1] == "coex" and r[2] == "coex 서울특별시 강남구"


def test_page_parser(spark):
    html = ("<html><head><title>Festival list</title><meta property='og:site_name' content='City'></head><body><nav><a href='/menu'>m</a></nav><main><h1>Hi</h1>"
            "<ul><li>Street festival on 2026-08-09 in the park <a href='/event/1?utm_a=1'>go</a></li></ul><a href='plan.pdf'>p</a></main></body></html>")
    df = spark.createDataFrame([(1, "https://c.go.kr/list/", html)], "page_id bigint, url string, html string")
    r = dc.page_links(hp.extract_pages(df)).first()
    assert (r.title, r.publisher, r.detail_urls, r.attachment_urls, len(r.event_rows)) == ("Festival list", "City", ["/event/1?utm_a=1"], ["plan.pdf"], 1)
    assert "m" not in r.body.split("\n")
    t = dc.detail_targets(hp.extract_pages(df), F.lit(2026)).first()
    assert (t.target, t.score) == ("https://c.go.kr/event/1", 10)


def test_freshness(spark):
    f = lambda t: one(spark, dc.reference_freshness(F.lit(t), F.lit("2026-08-01").cast("date")).alias("f")).f.status
    assert f("rule was withdrawn") == "SUPERSEDED" and f("a proposal of 2020-01-01") == "STALE_PROPOSAL" and f("proposal adopted") == "CURRENT_CONFIRMED"
    assert f("road closure") == "TEMPORAL_EVIDENCE_MISSING" and f("festival ended 2026-01-02") == "EXPIRED" and f("festival on 2026-09-02") == "CURRENT_OR_TIME_INVARIANT"


def test_rate_decisions(spark):
    texts = ["2026-07-10. The Monetary Policy Board decided to hold the base rate at 2.50%. Growth was 1. 3 percent.", "2026-07-10 The Board decided to raise the base rate from 2.25% to 2.50%.",
             "2026-07-10 The Board decided to hold the base rate at 2.50%, 2.75% or 3%.", "2026-07-10 nothing", "The Board decided to hold the base rate at 2.50%.", "2026-07-10 The Board decided to hold the base rate at 3.00%."]
    df = spark.createDataFrame([(i, "", t, 2.5) for i, t in enumerate(texts)], "doc_id int, title string, body string, official_rate double")
    r = {x.doc_id: x for x in dc.rate_decisions(df).collect()}
    assert (r[0].decision_type, r[0].current_rate, r[0].reason_codes, texts[0][r[0].evidence_start:].strip()[:3]) == ("HOLD", "2.50", [], "The")
    assert (r[1].decision_type, r[1].previous_rate, r[1].current_rate, r[1].reason_codes) == ("INCREASE", "2.25", "2.50", [])
    assert [r[i].reason_codes[0] for i in (2, 3, 4, 5)] == ["BOK_CURRENT_RATE_AMBIGUOUS", "BOK_DECISION_LANGUAGE_MISSING", "BOK_DECISION_DATE_MISSING", "BOK_RATE_OFFICIAL_DATA_CONFLICT"]


def test_customs_xml(spark, tmp_path):
    item = "<item><hsCode>{}</hsCode><year>{}</year><impDlr>{}</impDlr><impWgt>{}</impWgt></item>"
    (tmp_path / "a.xml").write_text("<r><items>" + item.format("090111", "2026.05", "1,000", "250") + item.format("-", "총계", "1", "1") + item.format("090111", "2026.06", "5", "0") + "</items></r>", encoding="utf-8")
    rows = {(r.indicator_id[:24], str(r.observed_at)): r for r in customs_observations(read_customs_xml(spark, str(tmp_path))).collect()}
    assert len(rows) == 5 and rows[("CUSTOMS_IMPORT_UNIT_PRIC", "2026-05-01")].value == 4.0
    assert rows[("CUSTOMS_IMPORT_VALUE_USD", "2026-05-01")].available_at == dt.date(2026, 6, 25)


def test_failure_codes(spark):
    df = spark.createDataFrame([(401, "ok"), (429, "ok"), (500, "ok"), (200, "malformed"), (200, "ok")], "s int, o string")
    assert [r[0] for r in df.select(provider_failure_code(F.col("s"), F.col("o"))).collect()] == ["AUTHENTICATION_FAILED", "RATE_LIMITED", "HTTP_500", "MALFORMED_RESPONSE", None]


def test_detail_pages_are_no_lists(spark):
    menu = "\n".join(["home"] * 40)
    rows = spark.createDataFrame([(1, "EVENT_DETAIL_PAGE"), (2, "UNKNOWN")], "id int, page_type string").withColumns({
        "url": F.lit("https://c.go.kr/"), "title": F.lit("Festival"), "body": F.lit(menu), "query_terms": F.array().cast("array<string>"), "published": F.lit(None).cast("date"),
        "trust": F.lit("OFFICIAL_TRUSTED"), "injected": F.lit(False), "detail_links": F.lit(0), "attachments": F.lit(0), "traversable": F.lit(False)})
    got = {r.id: (r.disposition, r.reason_codes) for r in dc.quality_gate(rows, F.lit("2026-08-01").cast("date")).collect()}
    assert got == {1: ("EXTRACT", ["NAVIGATION_OR_LIST_PAGE"]), 2: ("REFERENCE_ONLY", ["NAVIGATION_OR_LIST_PAGE"])}


def test_no_link_or_row_is_cut_off(spark):
    items = "".join(f"<li>Street festival number {i} on 2026-08-09 <a href='/event/{i}'>go</a></li>" for i in range(80)) + "<li>Exam of 2026 and training here <a href='/event/exam'>x</a></li>"
    df = spark.createDataFrame([(1, "https://c.go.kr/list/", f"<html><body><main><ul>{items}</ul></main></body></html>")], "page_id bigint, url string, html string")
    parsed = hp.extract_pages(df)
    r = dc.page_links(parsed).first()
    assert len(r.detail_urls) == 81 and len(r.event_rows) >= 80
    got = dc.detail_targets(parsed, F.lit(2026), 6).collect()
    assert len(got) == 81 and sum(x.reason == "DETAIL_BUDGET_EXHAUSTED" for x in got) == 74
    assert [(x.rank, x.reason) for x in got if x.target.endswith("exam")] == [(None, "LOCAL_IRRELEVANT_NOTICE")]


def test_rate_with_spaced_digits(spark):
    text = "2026-07-10. The Monetary Policy Board decided to hold the base rate at 2. 50 %. Done."
    df = spark.createDataFrame([(1, "", text, 2.5), (2, "", text.replace("2. 50 %", "２.５０％").replace("rate", "ra\u00adte"), 2.5)], "doc_id int, title string, body string, official_rate double")
    assert {(r.current_rate, tuple(r.reason_codes), r.decision_type) for r in dc.rate_decisions(df).collect()} == {("2.50", (), "HOLD")}


def test_region_code_inside_a_longer_number_or_hash_is_no_region(spark):
    head = "Program: Interest subsidy\nInterest subsidy for shops.\n"
    tails = {1: "4116801234567890", 2: "token d116805f", 3: "code 11680, see there", 4: "KR-11680", 5: "seoul 4031092311680865"}
    docs = spark.createDataFrame([(k, "", head + t, True) for k, t in tails.items()], "doc_id bigint, title string, body string, trusted boolean")
    got = {r["doc_id"]: r["region_code"] for r in dc.policy_facts(docs).collect()}
    assert got == {1: None, 2: None, 3: "11680", 4: "11680", 5: "11"}
