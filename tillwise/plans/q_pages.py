"""Pages with planted content, so that SQL knows what a reader has to find in them."""

from __future__ import annotations

from pyspark.sql import functions as F

from tillwise.functions.stages import staged
from tillwise.functions.urls import host_of, source_class
from tillwise.operators import documents as dc
from tillwise.operators import html_pages as hp
from tillwise.plans import bindings as b
from tillwise.plans.catalog import cte, query, sql
from tillwise.plans.q_events import present

# one page for each row of pages: content under one of six kinds of element, sometimes beside a longer or shorter article
OPENERS = ["<main>", "<ARTICLE>", '<div role="main">', '<div id="content">', '<section class="box board-view">', '<div id="other">']
CLOSERS = ["</main>", "</article>", "</div>", "</div>", "</section>", "</div>"]
PATHS = ["/board/list", "/event/view.do", "/news", "/notice/detail", "/f.pdf", "/plain", ""]
PLACES = ["https://www.seoul.go.kr", "https://www.bok.or.kr", "https://site.example.org"]
EVENT_ROW = "Street festival on 2001-07-1"
PLACE_ROW = " in Main Street"
OTHER_ROW = "Recruit notice of 2001 for all of us"
SHORT_ROW = "Too short 2001"

_pick = lambda values, n: F.element_at(F.array(*[F.lit(v) for v in values]), (n + 1).cast("int"))


def planted(spark, sf):
    """Pages (page_id, url, html) built from the keys of pages."""
    k = F.col("page_id")
    text = k.cast("string")
    digest = F.md5(text.cast("binary"))
    when = lambda cond, *parts: F.when(cond, F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])).otherwise("")
    rows = when(k % 4 != 2, "<ul><li>" + EVENT_ROW, (k % 10).cast("string"), PLACE_ROW + ' <a href="/event/', text, '">more</a></li><li class="x">' + OTHER_ROW + '</li><li>' + SHORT_ROW + "</li></ul>")
    card = when(k % 8 == 2, '<div class="card event-card">Open evening 5/11 for&nbsp;everyone<a href="/event/card">card</a></div>')
    content = F.concat(_pick(OPENERS, k % 6), F.lit("<script>var x = '<p>no</p>';</script><h1>Head "), text, F.lit("</h1>\n<p>Body  text "), digest, F.lit(" ３%</p>"), rows, card,
                       when(k % 3 == 0, '<p><a href=" /files/', text, '.pdf ">file</a></p>'), F.lit('<a href="#top">top</a><a href="javascript:go()">go</a>'), _pick(CLOSERS, k % 6))
    side = when(k % 2 == 0, '<article class="news"><p>Side ', F.when(k % 7 == 0, F.repeat(F.concat(digest, F.lit(" ")), 12)).otherwise(digest), '</p><a href="/notice/side">side</a></article>')
    html = F.concat(
        F.lit("<!DOCTYPE html><html><head>"), when(k % 8 != 7, "<title> Page&#32;", text, " </title>"), F.lit('<meta property="og:site_name" content=" Site 1 ">'), when(k % 3 == 1, '<meta name="datePublished" content="2001-05-01">'),
        when(k % 5 == 4, '<meta property="article:published_time" content="2001-06-06">'), F.lit('</head><body><header><main>Far longer than anything else on this page, but a header'), F.repeat(F.lit(" filler"), 200),
        F.lit('</main></header><nav><a href="/menu">Menu</a></nav>'), side, content, when(k % 4 == 1, '<time datetime="2001-08-08T00:00">Updated</time>'), F.lit('<footer>2001 notice board <a href="/foot">foot</a></footer></body></html>'))
    url = F.concat(_pick(PLACES, k % 3), _pick(PATHS, k % 7))
    return b.table(spark, sf, "pages").select("page_id", url.alias("url"), html.alias("html"))


def read(spark, sf):
    return staged(spark, "planted:" + sf, lambda: hp.extract_pages(planted(spark, sf)))


_ROWS = f"""CASE WHEN k % 4 <> 2 THEN ['{EVENT_ROW}' || k % 10 || '{PLACE_ROW}' || chr(10) || 'more', '{OTHER_ROW}', '{SHORT_ROW}'] WHEN k % 8 = 2 THEN ['Open evening 5/11 for everyone' || chr(10) || 'card'] ELSE [] END"""
cte("planted", f"""
SELECT *, array_to_string(lines, chr(10)) AS body, list_filter(rows, lambda r: length(r) >= 20) AS event_rows FROM (
  SELECT page_id, url, title, publisher, published_at, CASE WHEN at_side THEN [side, 'side'] WHEN k % 6 = 5 AND k % 4 = 1 THEN list_append(content, 'Updated') ELSE content END AS lines,
    CASE WHEN at_side THEN ['/notice/side'] ELSE links END AS links, CASE WHEN at_side THEN [] ELSE rows END AS rows, CASE WHEN at_side OR k % 3 <> 0 THEN 0 ELSE 1 END AS files,
    CASE WHEN at_side THEN 1 ELSE len(links) - CASE WHEN k % 3 = 0 THEN 1 ELSE 0 END END AS details
  FROM (SELECT *, k % 2 = 0 AND (k % 6 = 5 OR length(side) + 5 > list_sum(list_transform(content, lambda x: length(x) + 1)) - 1) AS at_side FROM (
    SELECT page_id, page_id AS k, (['{"', '".join(PLACES)}'])[page_id % 3 + 1] || (['{"', '".join(PATHS)}'])[page_id % 7 + 1] AS url, CASE WHEN page_id % 8 <> 7 THEN 'Page ' || page_id ELSE '' END AS title, 'Site 1' AS publisher,
      CASE WHEN page_id % 5 = 4 THEN '2001-06-06' WHEN page_id % 3 = 1 THEN '2001-05-01' WHEN page_id % 4 = 1 THEN '2001-08-08T00:00' END AS published_at,
      'Side ' || CASE WHEN page_id % 7 = 0 THEN rtrim(repeat(md5(page_id::VARCHAR) || ' ', 12)) ELSE md5(page_id::VARCHAR) END AS side,
      flatten([['Head ' || k, 'Body text ' || md5(k::VARCHAR) || ' 3%'], string_split_lines(array_to_string({_ROWS}, chr(10))), CASE WHEN k % 3 = 0 THEN ['file'] ELSE [] END, ['top', 'go']]) AS content,
      flatten([CASE WHEN k % 4 <> 2 THEN ['/event/' || k] WHEN k % 8 = 2 THEN ['/event/card'] ELSE [] END, CASE WHEN k % 3 = 0 THEN ['/files/' || k || '.pdf'] ELSE [] END]) AS links, {_ROWS} AS rows
    FROM (SELECT *, page_id AS k FROM pages))))""".replace("string_split_lines(array_to_string(" + _ROWS + ", chr(10)))", f"list_filter(string_split(array_to_string({_ROWS}, chr(10)), chr(10)), lambda x: x <> '')"))


@query("page_extract", sql("""
SELECT page_id, title, body, publisher, published_at, array_to_string(links, ' ') AS links, array_to_string(rows, '|') AS list_rows, len(event_rows) AS event_rows, details AS detail_count, files AS attachment_count FROM planted""", "planted"))
def page_extract(spark, sf):
    out = dc.page_links(hp.extract_pages(planted(spark, sf)))
    return out.select("page_id", "title", "body", "publisher", "published_at", F.array_join(F.transform("links", lambda x: x["href"]), " ").alias("links"), F.array_join(F.transform("rows", lambda r: r["text"]), "|").alias("list_rows"),
                      F.size("event_rows").alias("event_rows"), F.size("detail_urls").alias("detail_count"), F.size("attachment_urls").alias("attachment_count"))


@query("page_extract_raw")
def page_extract_raw(spark, sf):
    """The same over the raw pages; tests compare it with a tree."""
    out = dc.page_links(hp.extract_pages(b.table(spark, sf, "pages")))
    return out.select("page_id", "title", F.length("body").alias("body_characters"), F.size("links").alias("link_count"), F.size("detail_urls").alias("detail_count"),
                      F.size("attachment_urls").alias("attachment_count"), F.size("event_rows").alias("row_count"))


_M = lambda text, pattern: f"regexp_matches({text}, '{pattern}')"
_DATE = r"(?:20[0-9]{2}|[0-9]{2})\s*[./\-년]\s*[0-9]{1,2}\s*[./\-월]\s*[0-9]{1,2}|[0-9]{1,2}\s*월\s*[0-9]{1,2}\s*일"
_PLACE = r"(?i)\b(?:venue|location|place|hall|park|station|road|street|square)\b"
_STATUS = r"(?i)\b(?:open|ongoing|scheduled|closed|registration|notice|event|festival|construction|closure)\b"
cte("page_flags", f"""
SELECT *, {present(("title <> ''", "TITLE"), (_M("t", _DATE), "DATE"), (_M("t", _PLACE), "LOCATION"), (_M("t", _STATUS), "STATUS"), ("details > 0", "DETAIL_LINK"), ("page_id % 3 = 0", "OFFICIAL_ORGANIZER"))} AS flags,
  len(list_filter(event_rows, lambda r: {_M("r", _DATE)} AND {_M("r", _PLACE)})) AS dated, page_id % 9 = 0 AS parent, lower((['{"', '".join(PATHS)}'])[page_id % 7 + 1]) AS path
FROM (SELECT *, concat_ws(chr(10), title, body) AS t FROM planted)""", "planted")


def classified(spark, sf):
    dated = F.size(F.filter("event_rows", lambda x: x["text"].rlike(dc.LOCAL_DATE) & x["text"].rlike(dc.LOCAL_PLACE)))
    rows = dc.page_links(read(spark, sf)).select(
        "page_id", "url", "title", "body", F.size("detail_urls").alias("detail_links"), F.size("attachment_urls").alias("attachments"), F.size("event_rows").alias("row_count"),
        dated.alias("dated_rows"), (F.col("page_id") % 9 == 0).alias("has_parent"), source_class(host_of(F.col("url"))).alias("source_type"))
    return dc.classify_pages(rows)


_PDF, _INNER = "parent AND path LIKE '%.pdf'", _M("path", "(?i)view[.]do|detail|board|notice|event|festival")
cte("page_kinds", f"""
SELECT *, CASE branch WHEN 0 THEN 'EVENT_ATTACHMENT' WHEN 1 THEN list_type WHEN 2 THEN CASE WHEN noticey THEN 'LOCAL_NOTICE_DETAIL' ELSE 'EVENT_DETAIL_PAGE' END WHEN 3 THEN list_type WHEN 4 THEN 'STRUCTURED_EVENT_LIST' WHEN 5 THEN 'NAVIGATION_ONLY' ELSE 'UNKNOWN' END AS page_type,
  branch IN (1, 3, 4) AS traversable, CASE WHEN branch = 0 THEN ['ATTACHMENT_CONTENT'] ELSE list_concat(list_transform(flags, lambda f: 'LOCAL_CLASSIFICATION_' || f), CASE branch WHEN 1 THEN ['LOCAL_STRUCTURED_LIST_QUALIFIED'] WHEN 3 THEN ['LOCAL_ROUTING_LINKS_DISCOVERED']
    WHEN 4 THEN ['LOCAL_STRUCTURED_LIST_QUALIFIED'] ELSE [] END) END AS why
FROM (SELECT *, CASE WHEN {_PDF} THEN 0 WHEN listy AND NOT inner_page AND len(flags) >= 2 AND event THEN 1 WHEN {_INNER} OR parent THEN 2 WHEN details > 0 OR files > 0 THEN 3 WHEN len(flags) >= 2 AND event AND dated > 0 THEN 4
    WHEN page_id % 3 = 0 AND (len(flags) < 2 OR NOT event) THEN 5 ELSE 6 END AS branch
  FROM (SELECT *, details >= 2 OR len(event_rows) >= 2 OR {_M("path", "(?i)[^a-z](list|board|search)($|[^a-z])")} AS listy, {_M("path", "(?i)[^a-z](notice|board)($|[^a-z])")} AS noticey, parent OR path LIKE '%view.do%' OR path LIKE '%detail%' AS inner_page,
    list_has_any(flags, ['DATE', 'LOCATION', 'STATUS', 'DETAIL_LINK']) AS event, CASE WHEN {_M("path", "(?i)[^a-z](notice|board)($|[^a-z])")} THEN 'LOCAL_NOTICE_LIST' ELSE 'STRUCTURED_EVENT_LIST' END AS list_type FROM page_flags))""", "page_flags")


@query("page_class", sql("SELECT page_id, page_type, traversable, array_to_string(flags, ',') AS flags, array_to_string(why, ',') AS reasons, traversable AND dated > 0 AS rows_sufficient FROM page_kinds", "page_kinds"))
def page_class(spark, sf):
    return classified(spark, sf).select("page_id", "page_type", "traversable", F.array_join("flags", ",").alias("flags"), F.array_join("classification_reasons", ",").alias("reasons"), "rows_sufficient")


# pages of trusted hosts are routed by their class, others and one in five unclassified; one in 13 holds an injection, one in 17 nothing
cte("routed", f"""
SELECT page_id, trim(CASE WHEN page_id % 17 = 0 THEN '' WHEN page_id % 4 = 2 AND page_id % 8 <> 2 THEN 'Menu here' || chr(10) || 'Login' || chr(10) || body ELSE body END, ' ') AS body, title, path, page_id % 3 < 2 AND page_id % 5 > 0 AS known, page_id % 3 < 2 AS trusted, details, files, page_type, why,
  page_id % 3 < 2 AND page_id % 5 > 0 AND traversable AS go, page_id % 13 = 0 AS injected, page_id % 11 = 0 AS old FROM page_kinds""", "page_kinds")
_NAV_LINES = "list_filter(list_transform(string_split(body, chr(10)), lambda x: trim(x)), lambda x: x <> '')"
_SENT = lambda x: f"(regexp_matches({x}, '[.!?。]$') OR length({x}) >= 80)"
_MENU = lambda x: f"(regexp_matches(lower({x}), 'copyright|menu|login') AND NOT {_SENT(x)})"
_SIGNAL = r"regexp_matches(x, '20[0-9]{2}')"


@query("local_quality_gate", sql(f"""
SELECT page_id, disposition, array_to_string(reasons, ',') AS reason_codes, array_to_string(hard, ',') AS hard_rejections, sub AS substantive FROM (
SELECT *, CASE WHEN len(hard) > 0 THEN 'REJECT' WHEN go THEN 'TRAVERSE_LIST' WHEN details > 0 AND sub THEN 'EXTRACT_AND_TRAVERSE' WHEN details > 0 THEN 'ROUTE_TO_DETAIL' WHEN files > 0 AND sub THEN 'EXTRACT_AND_TRAVERSE' WHEN files > 0 THEN 'FETCH_ATTACHMENTS'
  WHEN NOT trusted THEN 'LOW_PRIORITY_EXTRACT' WHEN list_has_any(reasons, ['NAVIGATION_ONLY', 'NAVIGATION_OR_LIST_PAGE']) AND NOT (known AND page_type IN ('EVENT_DETAIL_PAGE', 'LOCAL_NOTICE_DETAIL', 'EVENT_ATTACHMENT')) THEN 'REFERENCE_ONLY'
  WHEN list_has_any(reasons, ['QUERY_IRRELEVANT', 'STALE_SOURCE', 'INSUFFICIENT_CONTENT']) THEN 'LOW_PRIORITY_EXTRACT' ELSE 'EXTRACT' END AS disposition
FROM (SELECT *, size >= 80 AND ratio < 0.66 AND NOT list_contains(reasons, 'NAVIGATION_OR_LIST_PAGE') AS sub FROM (
  SELECT *, list_concat({present(("NOT go AND size < 80", "INSUFFICIENT_CONTENT"), ("NOT go AND ratio >= 0.66", "NAVIGATION_ONLY"), ("NOT go AND NOT contains(lower(concat_ws(chr(10), title, body)), 'festival') AND NOT contains(lower(concat_ws(chr(10), title, body)), 'body t')", "QUERY_IRRELEVANT"), ("NOT go AND path = '' AND size < 2000", "NAVIGATION_OR_LIST_PAGE"))},
      CASE WHEN known THEN why ELSE [] END, {present(("old", "STALE_SOURCE"), ("NOT trusted", "UNVERIFIED_SOURCE_TIER"))}) AS reasons, {present(("size = 0", "EMPTY_EXTRACTION"), ("injected", "SECURITY_POLICY_VIOLATION"))} AS hard
  FROM (SELECT *, length(body) AS size, CASE WHEN len(ls) = 0 THEN 1.0::DOUBLE ELSE len(list_filter(ls, lambda x: {_MENU("x")}))::DOUBLE / greatest(1, len(list_filter(ls, lambda x: {_MENU("x")})) + len(list_filter(ls, lambda x: NOT {_MENU("x")} AND ({_SENT("x")} OR {_SIGNAL})))) END AS ratio
    FROM (SELECT *, {_NAV_LINES} AS ls FROM routed)))))""", "routed"))
def local_quality_gate(spark, sf):
    k = F.col("page_id")
    known = k % 5 > 0
    rows = classified(spark, sf)
    rows = rows.withColumns({
        "trust": F.when(k % 3 < 2, "OFFICIAL_TRUSTED").otherwise("UNVERIFIED"), "injected": k % 13 == 0, "published": F.when(k % 11 == 0, F.lit("1999-01-01")).otherwise(F.lit("2001-08-01")).cast("date"),
        "query_terms": F.array(F.lit("festival"), F.lit("body t")), "page_type": F.when((k % 3 < 2) & known, F.col("page_type")), "traversable": F.col("traversable") & (k % 3 < 2) & known,
        "classification_reasons": F.when((k % 3 < 2) & known, F.col("classification_reasons")),
        "body": F.when(k % 17 == 0, "").when((k % 4 == 2) & (k % 8 != 2), F.concat(F.lit("Menu here\nLogin\n"), "body")).otherwise(F.col("body"))})
    out = dc.quality_gate(rows, b.as_of())
    return out.select("page_id", "disposition", F.array_join("reason_codes", ",").alias("reason_codes"), F.array_join("hard_rejection_reasons", ",").alias("hard_rejections"), "substantive")
