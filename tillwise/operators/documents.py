"""Documents and pages: evidence checks, freshness, quality routing, ranking, crawl frontier."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tillwise.functions.core import codes, d, stable_id
from tillwise.functions.dates import safe_date
from tillwise.functions.text import LIST_MARKERS, fold_space, navigation_ratio, norm_text, tokens, unique_tokens
from tillwise.functions.units import CURRENCY
from tillwise.functions.urls import canonical_url, path_of

# ---- freshness of reference text -----------------------------------------------------------

# Wording that decides whether reference text still applies.
PROPOSAL = r"(?i)\b(?:proposal|proposed|consultation|public comment|draft rule)\b|입법예고|행정예고|의견\s*수렴|공고안|제안"
FINAL = r"(?i)\b(?:adopted|enacted|implemented|implementation notice|final rule|in force)\b|확정|공포|시행\s*중|시행하기로|최종\s*결정"
SUPERSEDED = r"(?i)\b(?:superseded|replaced|withdrawn|revoked)\b|폐기|철회|대체|폐지|이\s*공고는\s*폐지"
STILL_ON = (r"(?i)\b(?:remains? in (?:force|effect)|currently effective|continues? to apply|until (?:funds? are )?exhausted|ongoing)\b"
            r"|현행|유효|계속\s*적용|시행\s*중|예산\s*소진\s*시까지|다음\s*결정\s*시까지")
TIME_BOUND = (r"(?i)\b(?:closure|closed|construction|event|festival|application period|tariff|quota|restriction|consultation|public comment"
              r"|proposal|temporary)\b|통제|공사|행사|축제|신청\s*기간|관세|할당관세|제한|의견\s*수렴|예고|임시")
ENDED = r"(?i)\b(?:ended|expired|closed on|through|until)\b|종료|마감|만료|종료일"
ISO_DAY = r"(?<![0-9])(20[0-9]{2})[./-]([0-9]{1,2})[./-]([0-9]{1,2})(?![0-9])"
KOREAN_DAY = r"(?<![0-9])(20[0-9]{2})\s*년\s*([0-9]{1,2})\s*월\s*([0-9]{1,2})\s*일"
YEAR_ONLY = r"(?<![0-9])(20[0-9]{2})(?![0-9])"


def explicit_days(text: Column) -> Column:
    """Every full date written in the text."""
    def days(pattern: str) -> Column:
        part = lambda i: F.regexp_extract_all(text, F.lit(pattern), F.lit(i))
        return F.transform(F.arrays_zip(part(1).alias("y"), part(2).alias("m"), part(3).alias("d")), lambda x: safe_date(x["y"], x["m"], x["d"]))

    return F.array_compact(F.concat(days(ISO_DAY), days(KOREAN_DAY)))


def claim_boundary(text: Column) -> Column:
    years = F.regexp_extract_all(text, F.lit(YEAR_ONLY), F.lit(1))
    return F.coalesce(F.array_max(explicit_days(text)), F.to_date(F.concat(F.array_max(years), F.lit("-12-31"))))


def reference_freshness(text: Column, forecast_start: Column) -> Column:
    """struct(status, codes); superseded, then proposals, then confirmed, then time-bound text."""
    edge = claim_boundary(text)
    out = lambda status, *found: F.struct(F.lit(status).alias("status"), F.array(*[F.lit(c) for c in found]).cast("array<string>").alias("codes"))
    past = edge < forecast_start
    final, ongoing = text.rlike(FINAL), text.rlike(STILL_ON)
    stale = text.rlike(PROPOSAL) & ~final
    bound = text.rlike(TIME_BOUND)
    return (
        F.when(text.rlike(SUPERSEDED), out("SUPERSEDED", "REFERENCE_SUPERSEDED"))
        .when(stale & (edge.isNull() | past), out("STALE_PROPOSAL", "REFERENCE_STALE_PROPOSAL", "REFERENCE_IMPLEMENTATION_UNCONFIRMED"))
        .when(stale, out("STALE_PROPOSAL", "REFERENCE_IMPLEMENTATION_UNCONFIRMED"))
        .when(ongoing | final, out("CURRENT_CONFIRMED"))
        .when(bound & edge.isNull(), out("TEMPORAL_EVIDENCE_MISSING", "REFERENCE_NO_ONGOING_RELEVANCE"))
        .when(bound & past & text.rlike(ENDED), out("EXPIRED", "REFERENCE_EXPIRED", "REFERENCE_NO_ONGOING_RELEVANCE"))
        .when(bound & past, out("STALE", "REFERENCE_STALE", "REFERENCE_NO_ONGOING_RELEVANCE"))
        .otherwise(out("CURRENT_OR_TIME_INVARIANT")))


# Boilerplate words and the sizes a finding needs.
BOILERPLATE = ["menu", "login", "sitemap", "contact", "copyright", "navigation"]
MIN_QUOTE, MIN_TOKENS, MIN_TERMS, MIN_SHARED = 40, 5, 3, 2


def finding_gate(rows: DataFrame) -> DataFrame:
    """rows(trust, disposition, reasons, body, quote, summary, …) with `gate`: PROMOTED or a code."""
    words = sum((F.size(F.split(F.lower("body"), w)) - 1 for w in BOILERPLATE), F.lit(0))
    terms = unique_tokens(F.coalesce("summary", F.lit("")))
    shared = F.size(F.array_intersect(terms, unique_tokens(F.coalesce("quote", F.lit("")))))
    thin = (F.length(fold_space(F.col("quote"))) < MIN_QUOTE) | (F.size(tokens(F.col("quote"))) < MIN_TOKENS)
    weak = F.col("reasons")
    gate = (
        F.when(F.coalesce("summary", F.lit("")) == "", "REFERENCE_SUMMARY_MISSING").when(F.col("quote").isNull(), "REFERENCE_EVIDENCE_MISSING")
        .when(~F.col("trust").isin("OFFICIAL_TRUSTED", "INSTITUTIONAL_TRUSTED", "VERIFIED_MEDIA"), "REFERENCE_SOURCE_UNTRUSTED")
        .when(words >= 3, "REFERENCE_CONTENT_NOT_SUBSTANTIVE").when(F.array_contains(weak, "QUERY_IRRELEVANT"), "REFERENCE_QUERY_IRRELEVANT")
        .when(F.arrays_overlap(weak, F.array(F.lit("STALE_SOURCE"), F.lit("INSUFFICIENT_CONTENT"))) | F.col("disposition").isin("REJECT", "REFERENCE_ONLY"), "REFERENCE_CONTENT_NOT_SUBSTANTIVE")
        .when(~F.col("body").contains(F.col("quote")), "REFERENCE_QUOTE_NOT_FOUND")
        .when(thin | (F.size(terms) < MIN_TERMS) | (shared < MIN_SHARED), "REFERENCE_CONTENT_NOT_SUBSTANTIVE").otherwise("PROMOTED"))
    return rows.withColumn("gate", gate)


def merge_findings(findings: DataFrame) -> DataFrame:
    """One finding per (revisions, reason, folded title) with what it merges.

    findings(finding_id, revision_key, reason, title, source_id, evidence_id). Sources and
    evidence stay as counts here; `finding_links` lists them in long form, so a finding copied
    to a third of all documents is never one row."""
    key = ["revision_key", "reason", "folded_title"]
    rows = findings.withColumn("folded_title", F.lower(fold_space(F.col("title"))))
    return rows.groupBy(*key).agg(F.min("finding_id").alias("finding_id"), F.count_distinct("source_id").alias("source_count"),
                                  F.count_distinct("evidence_id").alias("evidence_count"))


def finding_links(findings: DataFrame) -> DataFrame:
    """(merge key, source_id, evidence_id) pairs behind the merged findings, each once."""
    return findings.select("revision_key", "reason", F.lower(fold_space(F.col("title"))).alias("folded_title"), "source_id", "evidence_id").distinct()


def snapshot_fingerprint(*fields: str) -> Column:
    return F.sha2(F.to_json(F.struct(*sorted(fields))), 256)


def dedupe_snapshots(documents: DataFrame, key: str, *fields: str) -> DataFrame:
    """First document per content fingerprint and the number of copies it stands for."""
    return documents.groupBy(snapshot_fingerprint(*fields).alias("fingerprint")).agg(F.min(key).alias(key), F.count("*").alias("copies"))


# ---- ranking -------------------------------------------------------------------------------

SUBSTANTIVE = ["effective", "application", "decision", "support", "공고", "신청", "결정", "지원"]


def extraction_score(trusted: Column, detail: Column, title: Column, body: Column, query: Column) -> Column:
    """100 trusted + 30 detail page + 5 per query term + 3 per substantive word, whole text."""
    text = F.lower(F.concat_ws("\n", title, body))
    terms = F.size(F.filter(unique_tokens(query), lambda t: text.contains(t)))
    words = sum((text.contains(w).cast("int") for w in SUBSTANTIVE), F.lit(0))
    return trusted.cast("int") * 100 + detail.cast("int") * 30 + terms * 5 + words * 3


def top_per_group(rows: DataFrame, key: str, group: str, order: list[Column], budget: DataFrame, code: str) -> DataFrame:
    """Marks rows within their group's budget; the rest carry `code`.

    budget(group, budget) is a small dimension; ranks above its largest budget are cut below the shuffle, so a
    crowded group sends few rows."""
    most = budget.agg(F.coalesce(F.max("budget"), F.lit(0))).first()[0]
    best = Window.partitionBy(group).orderBy(*order)
    kept = rows.withColumn("_r", F.row_number().over(best)).filter(F.col("_r") <= most)
    kept = kept.join(budget, group).filter(F.col("_r") <= F.col("budget")).select(key, F.col("_r").alias("rank"))
    return rows.join(kept, key, "left").withColumn("reason", F.when(F.col("rank").isNull(), F.lit(code)))


# ---- pages ---------------------------------------------------------------------------------

# Link and row patterns.
ATTACHMENT = r"(?i)\.(?:pdf|hwp|hwpx|txt)(?:$|[?#])"
DETAIL = r"(?i)view\.do|detail|board|notice|event|festival"
ROW_DATE = r"20[0-9]{2}|[0-9]{1,2}[./-][0-9]{1,2}"


def page_links(extracted: DataFrame, detail_pattern: str = DETAIL) -> DataFrame:
    """Adds all detail_urls, attachment_urls and event_rows of the page."""
    hrefs = F.transform("links", lambda x: x["href"])
    attachments = F.array_distinct(F.filter(hrefs, lambda h: h.rlike(ATTACHMENT)))
    details = F.array_distinct(F.filter(hrefs, lambda h: ~h.rlike(ATTACHMENT) & h.rlike(detail_pattern)))
    rows = F.filter("rows", lambda r: (F.length(r["text"]) >= 20) & r["text"].rlike(ROW_DATE))
    return extracted.withColumns({"detail_urls": details, "attachment_urls": attachments, "event_rows": rows})


def absolute_url(base: Column, href: Column) -> Column:
    """Resolve an href against its page's scheme and host, canonically."""
    root = F.regexp_extract(base, r"(?i)^(https?://[^/?#]+)", 1)
    folder = F.regexp_replace(F.regexp_extract(base, r"(?i)^(https?://[^?#]*)", 1), "[^/]*$", "")
    full = F.when(href.rlike("(?i)^https?://"), href).when(href.startswith("//"), F.concat(F.regexp_extract(base, "(?i)^(https?:)", 1), href)) \
        .when(href.startswith("/"), F.concat(root, href)).otherwise(F.concat(folder, href))
    return canonical_url(full)


# Quality gate constants.
DETAIL_TYPES = ["EVENT_DETAIL_PAGE", "LOCAL_NOTICE_DETAIL", "EVENT_ATTACHMENT"]
STALE_DAYS, NAVIGATION_LIMIT, SHORT_TEXT, LIST_TEXT = 550, 0.66, 80, 2000


def quality_gate(rows: DataFrame, as_of: Column) -> DataFrame:
    """rows(url, title, body, query_terms, published, trust, injected, detail_links, attachments, traversable, and
    optionally source_type, page_type and classification_reasons of pages that were classified) with reasons, hard
    rejections, disposition, score and priority.

    A list worth traversing keeps none of the reasons that only speak of lists; detail pages and attachments keep
    them but are not put aside as mere reference for them."""
    optional = lambda c, kind: F.col(c) if c in rows.columns else F.lit(None).cast(kind)
    source_type, page_type, local = optional("source_type", "string"), optional("page_type", "string"), optional("classification_reasons", "array<string>")
    body = F.trim("body")
    size = F.length(body)
    rows = rows.withColumn("navigation_ratio", navigation_ratio(body))
    text = F.lower(F.concat_ws("\n", "title", body))
    matches = F.size(F.filter("query_terms", lambda t: text.contains(t)))
    path = F.trim(path_of(F.col("url")), F.lit("/"))
    specific = (path != "") & ~path.isin("index.do", "main.do", "index.html") & ~F.lower("title").rlike(LIST_MARKERS)
    trusted = (F.col("trust") == "OFFICIAL_TRUSTED") | F.coalesce(source_type.isin("OFFICIAL_PRIMARY", "OFFICIAL_LOCAL_GOV"), F.lit(False))
    nav, listing = F.col("navigation_ratio"), ~F.col("traversable")
    reasons = F.concat(
        codes((listing & (size < SHORT_TEXT), "INSUFFICIENT_CONTENT"), (listing & (nav >= NAVIGATION_LIMIT), "NAVIGATION_ONLY"),
              (listing & (F.size("query_terms") > 0) & (matches == 0), "QUERY_IRRELEVANT"), (listing & ~specific & (size < LIST_TEXT), "NAVIGATION_OR_LIST_PAGE")),
        F.coalesce(local, F.array().cast("array<string>")),
        codes((F.datediff(as_of, "published") > STALE_DAYS, "STALE_SOURCE"), (~trusted, "UNVERIFIED_SOURCE_TIER")))
    hard = codes((size == 0, "EMPTY_EXTRACTION"), (F.col("injected"), "SECURITY_POLICY_VIOLATION"))
    rows = rows.withColumns({"body_characters": size, "query_term_matches": matches, "specific": specific, "reasons": reasons, "hard_rejection_reasons": hard})
    has = lambda c: F.array_contains("reasons", c)
    rows = rows.withColumn("substantive", (F.col("body_characters") >= SHORT_TEXT) & (nav < NAVIGATION_LIMIT) & ~has("NAVIGATION_OR_LIST_PAGE"))
    good, detail = F.col("substantive"), F.coalesce(page_type.isin(DETAIL_TYPES), F.lit(False))
    route = (
        F.when(F.size("hard_rejection_reasons") > 0, "REJECT").when(F.col("traversable"), "TRAVERSE_LIST")
        .when((F.col("detail_links") > 0) & good, "EXTRACT_AND_TRAVERSE").when(F.col("detail_links") > 0, "ROUTE_TO_DETAIL")
        .when((F.col("attachments") > 0) & good, "EXTRACT_AND_TRAVERSE").when(F.col("attachments") > 0, "FETCH_ATTACHMENTS")
        .when(F.lower("url").contains("topis"), "RESOLVE_DYNAMIC_SOURCE").when(has("UNVERIFIED_SOURCE_TIER"), "LOW_PRIORITY_EXTRACT")
        .when((has("NAVIGATION_ONLY") | has("NAVIGATION_OR_LIST_PAGE")) & ~detail, "REFERENCE_ONLY")
        .when(has("QUERY_IRRELEVANT") | has("STALE_SOURCE") | has("INSUFFICIENT_CONTENT"), "LOW_PRIORITY_EXTRACT").otherwise("EXTRACT"))
    rows = rows.select("*", F.explode(F.array(route)).alias("disposition"))
    usable = F.col("disposition").isin("EXTRACT", "EXTRACT_AND_TRAVERSE")
    score = F.greatest(F.lit(0), 100 - F.floor(nav * 40) - F.when(has("UNVERIFIED_SOURCE_TIER"), 25).otherwise(0))
    return rows.withColumns({
        "usable": usable, "quality_score": score.cast("double"),
        "priority": F.when(F.col("disposition") == "EXTRACT", 100).when(F.col("disposition") == "LOW_PRIORITY_EXTRACT", 70).otherwise(40),
        "reason_codes": F.col("reasons")}).drop("reasons")


# Signals of a local page.
LOCAL_DATE = r"(?:20[0-9]{2}|['‘’]?[0-9]{2})\s*[./\-년]\s*[0-9]{1,2}\s*[./\-월]\s*[0-9]{1,2}|[0-9]{1,2}\s*월\s*[0-9]{1,2}\s*일"
LOCAL_PLACE = r"(?i)\b(?:venue|location|place|hall|park|station|road|street|square)\b|[가-힣]+(?:특별시|광역시|시|군|구|동|로|길|광장|공원|역|센터)"
LOCAL_STATUS = r"(?i)\b(?:open|ongoing|scheduled|closed|registration|notice|event|festival|construction|closure)\b|진행|예정|접수|공사|통제|행사|축제|공고"
LISTY = r"(?i)\b(?:list|board|search)\b|목록|게시판|검색결과"
NOTICEY = r"(?i)\b(?:notice|board)\b|공고|알림|게시"


def classify_pages(rows: DataFrame) -> DataFrame:
    """rows(url, title, body, detail_links, attachments, row_count, dated_rows, has_parent,
    source_type) with page_type, evidence flags and whether the list is worth traversing."""
    text = F.concat_ws("\n", "title", "body")
    path = F.lower(path_of(F.col("url")))
    local = F.col("source_type") == "OFFICIAL_LOCAL_GOV"
    flags = {"TITLE": F.trim("title") != "", "DATE": text.rlike(LOCAL_DATE), "LOCATION": text.rlike(LOCAL_PLACE), "STATUS": text.rlike(LOCAL_STATUS),
             "DETAIL_LINK": F.col("detail_links") > 0, "OFFICIAL_ORGANIZER": local}
    rows = rows.withColumn("flags", codes(*[(v, k) for k, v in flags.items()]))
    has = lambda k: F.array_contains("flags", k)
    score, event = F.size("flags"), has("DATE") | has("LOCATION") | has("STATUS") | has("DETAIL_LINK")
    listy = (F.col("detail_links") >= 2) | (F.col("row_count") >= 2) | path.rlike(LISTY) | F.col("title").rlike(LISTY)
    noticey = path.rlike(NOTICEY) | F.col("title").rlike(NOTICEY)
    inner = F.col("has_parent") | path.contains("view.do") | path.contains("detail")
    list_type = F.when(noticey, "LOCAL_NOTICE_LIST").otherwise("STRUCTURED_EVENT_LIST")
    said = F.transform("flags", lambda f: F.concat(F.lit("LOCAL_CLASSIFICATION_"), f))
    none = F.array().cast("array<string>")

    def page(name, go: bool, last: str | None = None, alone: str | None = None) -> Column:
        """Type, whether to traverse, and the signals with a last code, or one code where no signal spoke."""
        reasons = F.concat(said, F.array(F.lit(last))) if last else F.when(F.size(said) > 0, said).otherwise(F.array(F.lit(alone)) if alone else none)
        return F.struct((F.lit(name) if isinstance(name, str) else name).alias("t"), F.lit(go).alias("go"), reasons.alias("why"))

    only = lambda name, code: F.struct(F.lit(name).alias("t"), F.lit(False).alias("go"), F.array(F.lit(code)).alias("why"))
    kind = (
        F.when(F.trim(text) == "", only("UNUSABLE_CONTENT", "EMPTY_BODY"))
        .when(F.col("has_parent") & path.rlike(ATTACHMENT), only("EVENT_ATTACHMENT", "ATTACHMENT_CONTENT"))
        .when(listy & ~inner & (score >= 2) & event, page(list_type, True, "LOCAL_STRUCTURED_LIST_QUALIFIED"))
        .when(path.rlike(DETAIL) | F.col("has_parent"), page(F.when(noticey, "LOCAL_NOTICE_DETAIL").otherwise("EVENT_DETAIL_PAGE"), False, alone="LOCAL_DETAIL_URL_PATTERN"))
        .when((F.col("detail_links") > 0) | (F.col("attachments") > 0), page(list_type, True, "LOCAL_ROUTING_LINKS_DISCOVERED"))
        .when((score >= 2) & event & (F.col("dated_rows") > 0), page("STRUCTURED_EVENT_LIST", True, "LOCAL_STRUCTURED_LIST_QUALIFIED"))
        .when(local & ((score < 2) | ~event), page("NAVIGATION_ONLY", False, alone="LOCAL_NAVIGATION_NO_EVENT_EVIDENCE")).otherwise(page("UNKNOWN", False)))
    rows = rows.select("*", F.explode(F.array(kind)).alias("_k"))
    return rows.withColumns({"page_type": F.col("_k.t"), "traversable": F.col("_k.go"), "classification_reasons": F.col("_k.why"),
                             "rows_sufficient": F.col("_k.go") & (F.col("dated_rows") > 0)}).drop("_k")


# Words that make a listing row relevant or not.
ROW_SKIP = "recruit|appointment|civil service|exam|training|administrative rule|채용|임용|시험|교육|고시|훈령|규칙"
ROW_WORDS = ["construction", "road work", "traffic control", "transit", "pedestrian", "festival", "event", "closure", "redevelopment", "commercial",
             "safety", "public works", "공사", "교통", "통제", "보행", "축제", "행사", "폐쇄", "재개발", "상권", "안전"]
DETAILS_PER_PAGE = 6  # budget of a page; rows beyond it keep their rank and get a code


def row_relevance(text: Column, start_year: Column) -> Column:
    """struct(score, reason): stale and irrelevant rows carry a reason."""
    low = F.lower(text)
    years = F.transform(F.regexp_extract_all(text, F.lit(r"\b(20[0-9]{2})\b"), F.lit(1)), lambda y: y.cast("int"))
    score = sum((low.contains(w).cast("int") * 10 for w in ROW_WORDS), F.lit(0))
    reason = F.when(F.array_max(years) < start_year - 1, "STALE_LISTING_ROW").when(low.rlike(ROW_SKIP), "LOCAL_IRRELEVANT_NOTICE")
    return F.struct(F.when(low.rlike(ROW_SKIP), -100).otherwise(score).alias("score"), reason.alias("reason"))


def detail_targets(extracted: DataFrame, start_year: Column, budget: int = DETAILS_PER_PAGE) -> DataFrame:
    """All distinct detail URLs of a page's rows: those of relevant rows ranked, beyond `budget` with
    DETAIL_BUDGET_EXHAUSTED; those of stale or irrelevant rows only with that reason and no rank."""
    rows = extracted.select("page_id", "url", F.explode("rows").alias("r")).withColumn("rel", row_relevance(F.col("r.text"), start_year))
    urls = rows.select("page_id", F.col("rel.score").alias("score"), F.col("rel.reason").alias("reason"), F.explode("r.hrefs").alias("href"), "url")
    urls = urls.select("page_id", "score", "reason", absolute_url(F.col("url"), F.col("href")).alias("target")).filter(F.col("target").isNotNull())
    relevant = F.col("reason").isNull()
    best = urls.groupBy("page_id", "target").agg(
        F.max(relevant).alias("_relevant"), F.max(F.when(relevant, F.col("score"))).alias("_score"), F.max("score").alias("score"), F.min("reason").alias("reason"))
    best = best.withColumn("score", F.coalesce("_score", "score"))
    # a page's own links: bounded by one page
    order = Window.partitionBy("page_id", "_relevant").orderBy(F.col("score").desc(), "target")
    rank = F.when(F.col("_relevant"), F.row_number().over(order))
    best = best.withColumn("rank", rank)
    return best.withColumn("reason", F.when(F.col("rank") > budget, "DETAIL_BUDGET_EXHAUSTED").when(~F.col("_relevant"), F.col("reason"))).drop("_relevant", "_score")


def detail_outcomes(scheduled: DataFrame, landed: DataFrame) -> DataFrame:
    """scheduled(parent, target) against landed(target, access_status): outcome per URL."""
    out = scheduled.join(landed, "target", "left")
    outcome = (
        F.when(F.col("access_status").isNull(), "DETAIL_FETCH_FAILED").when(F.col("access_status") == "OK", "DETAIL_FETCHED")
        .when(F.col("access_status") == "DOMAIN_NOT_ALLOWED", "DETAIL_DOMAIN_NOT_ALLOWED").otherwise("DETAIL_FETCH_FAILED"))
    return out.select("parent", "target", outcome.alias("outcome"))


# ---- text jobs -----------------------------------------------------------------------------

# Wording of a rate decision.
CLAUSE_BREAK = r"(?<=[!?])(?=\s)|(?<=[^0-9]\.)(?=\s)|(?<=[0-9]\.)(?=\s+[^0-9\s])|(?=[□■◆])"
BASE_RATE = r"(?i)\b(?:base|policy)\s+rate\b|기준\s*금리"
DECIDED = r"(?i)\b(?:decided|decision|monetary\s+policy\s+board)\b|금융\s*통화\s*위원회|결정|운용하기로|통화\s*정책\s*방향"
MOVES = {"HOLD": r"(?i)\b(?:hold|held|maintain|maintained|keep|kept|unchanged)\b|동결|유지|현\s*수준",
         "INCREASE": r"(?i)\b(?:raise|raised|increase|increased|hike|hiked)\b|인상|상향",
         "DECREASE": r"(?i)\b(?:lower|lowered|decrease|decreased|cut)\b|인하|하향"}
RATE = r"(?<![0-9])([0-9]+(?:\.[0-9]+)?)\s*%"
CONNECTED = [r"(?i)(?:base|policy)\s+rate.{0,45}?(?:at|of|to)\s*([0-9]+(?:\.[0-9]+)?)\s*%",
             r"(?i)(?:hold|held|maintain|maintained|keep|kept).{0,45}?(?:base|policy)\s+rate.{0,35}?([0-9]+(?:\.[0-9]+)?)\s*%",
             r"기준\s*금리.{0,55}?([0-9]+(?:\.[0-9]+)?)\s*%.{0,30}?(?:유지|동결|인상|인하)"]
CHANGES = [r"(?i)\bfrom\s+([0-9]+(?:\.[0-9]+)?)\s*%\s+to\s+([0-9]+(?:\.[0-9]+)?)\s*%",
           r"([0-9]+(?:\.[0-9]+)?)\s*%\s*(?:에서|로부터)\s*([0-9]+(?:\.[0-9]+)?)\s*%\s*로"]
DECISION_DATE = (r"(?i)20[0-9]{2}[./-]\s*[0-9]{1,2}[./-]\s*[0-9]{1,2}|(?:january|february|march|april|may|june|july|august|september|october"
                 r"|november|december)\s+[0-9]{1,2},?\s+20[0-9]{2}|20[0-9]{2}년\s*[0-9]{1,2}월\s*[0-9]{1,2}일")


def rate_decisions(documents: DataFrame) -> DataFrame:
    """documents(doc_id, title, body, official_rate): one row per document with the decision it states, or all the
    reasons why none can be told; the facts of a decision that only contradicts the official rate stay.

    Clauses with decision wording are found first; offsets are worked out for those alone. Soft hyphens and
    zero-width signs are dropped, compatibility forms composed and numbers such as `2. 50` closed up inside
    a clause, after its offset in the body as it stands is known."""
    pieces = F.split("body", CLAUSE_BREAK)
    plain = lambda c: F.regexp_replace(c, "[\u00ad\u200b\u200c\u200d\ufeff]", "")
    wanted = lambda c: plain(c).rlike(BASE_RATE) & plain(c).rlike(DECIDED)
    marked = F.filter(F.transform(pieces, lambda c, i: F.struct(c.alias("c"), i.alias("i"))), lambda x: wanted(x["c"]))
    base = documents.withColumn("pieces", pieces).withColumn("hits", marked)
    at = F.aggregate(F.slice("pieces", 1, F.col("h.i")), F.lit(0), lambda n, p: n + F.length(p))
    rows = base.select("doc_id", "title", "body", "official_rate", "pieces", F.explode_outer("hits").alias("h"))
    clause = F.regexp_replace(norm_text(plain(F.col("h.c"))), r"(?<=[0-9])\s*\.\s+(?=[0-9]+\s*%)", ".")
    rows = rows.withColumns({"clause": clause, "start": at})
    moves = codes(*[(F.col("clause").rlike(p), k) for k, p in MOVES.items()])
    every = lambda p, i=1: F.regexp_extract_all("clause", F.lit(p), F.lit(i))
    rates = F.array_distinct(every(RATE))
    connected = F.array_distinct(F.concat(*[every(p) for p in CONNECTED]))
    pairs = F.array_distinct(F.concat(*[F.arrays_zip(every(p, 1).alias("a"), every(p, 2).alias("b")) for p in CHANGES]))
    rows = rows.withColumns({"moves": moves, "rates": rates, "connected": connected, "pairs": pairs})
    move = F.when(F.size("moves") == 1, F.get("moves", F.lit(0)))
    hold = move == "HOLD"
    one = lambda a: F.get(a, F.lit(0))
    current = F.when(hold & (F.size("rates") == 1), F.coalesce(F.when(F.size("connected") == 1, one("connected")), one("rates"))) \
        .when(~hold & (F.size("pairs") == 1), one("pairs")["b"])
    failure = (
        F.when(move.isNull(), None).when(hold & (F.size("rates") == 0), "BOK_CURRENT_RATE_MISSING").when(hold & (F.size("rates") > 1), "BOK_CURRENT_RATE_AMBIGUOUS")
        .when(hold, None).when(F.size("pairs") == 1, None).when(F.size("pairs") > 1, "BOK_RATE_CHANGE_VALUES_AMBIGUOUS")
        .when(F.size("rates") < 2, "BOK_RATE_CHANGE_VALUES_INCOMPLETE").otherwise("BOK_RATE_CHANGE_VALUES_AMBIGUOUS"))
    rows = rows.withColumns({"move": move, "current": current, "previous": F.when(~hold & (F.size("pairs") == 1), one("pairs")["a"]), "failure": failure})
    good = F.col("current").isNotNull() & F.col("move").isNotNull()
    fact = F.struct("move", "current", "previous", "clause", "start")
    out = rows.groupBy("doc_id").agg(
        F.min_by(F.when(good, fact), F.when(good, F.col("start"))).alias("f"),
        F.count_distinct(F.when(good, F.concat_ws("|", "move", "current", F.coalesce("previous", F.lit(""))))).alias("identities"),
        F.max(good & (F.col("move") != "HOLD")).alias("changes"), F.max(F.col("h").isNotNull()).alias("spoken"),
        F.array_sort(F.collect_list(F.when(F.col("failure").isNotNull(), F.struct("start", "failure")))).alias("failures"), F.max(F.regexp_extract(F.concat_ws("\n", "title", "body"), DECISION_DATE, 0)).alias("day"),
        F.max("official_rate").alias("official_rate"))
    none = F.array().cast("array<string>")
    found = F.when(F.col("f").isNotNull(), none).when(F.size("failures") > 0, F.transform("failures", lambda x: x["failure"])).otherwise(F.array(F.lit("BOK_CURRENT_RATE_MISSING")))
    many = F.col("identities") > 1
    reasons = F.array_distinct(F.concat(
        codes((F.col("day") == "", "BOK_DECISION_DATE_MISSING"), (~F.col("spoken"), "BOK_DECISION_LANGUAGE_MISSING")), found,
        codes((many & F.col("changes"), "BOK_RATE_CHANGE_VALUES_AMBIGUOUS"), (many & ~F.col("changes"), "BOK_CURRENT_RATE_AMBIGUOUS"))))
    out = out.withColumn("reasons", reasons)
    clear = F.size("reasons") == 0
    clash = clear & F.coalesce(F.abs(F.col("f.current").cast("double") - F.col("official_rate")) > 1e-9, F.lit(False))
    fact = lambda value: F.when(clear, value)
    return out.select("doc_id", (clear & ~clash).alias("usable"), F.when(clash, F.array(F.lit("BOK_RATE_OFFICIAL_DATA_CONFLICT"))).otherwise(F.col("reasons")).alias("reason_codes"),
                      fact(F.col("f.move")).alias("decision_type"), fact(F.nullif("day", F.lit(""))).alias("decision_date"), fact(F.col("f.current")).alias("current_rate"),
                      fact(F.col("f.previous")).alias("previous_rate"), fact(F.col("f.start")).alias("evidence_start"))


# Policy wording.
POLICY_TYPES = [("CREDIT_GUARANTEE", r"(?i)credit[- ]?guarantee|신용보증"),
                ("INTEREST_SUBSIDY", r"(?i)interest (?:rate )?(?:subsidy|support)|loan interest|대출이자|이차보전|이자지원"),
                ("LOAN_SUPPORT", r"(?i)loan (?:support|program)|working capital loan|대출지원|융자")]
LIMIT = r"(?i)(?:up to|maximum|limit|최대|한도)\s*(?:KRW\s*)?([0-9,]+(?:\.[0-9]+)?)\s*(KRW|억원|백만원|만원|원)"
DISCOUNT = r"(?i)([0-9.]+)\s*(?:%p|percentage\s*points?|퍼센트\s*포인트)"
ANNUAL = r"(?i)(?:interest\s*rate|rate|금리)[^0-9]{0,20}([0-9.]+)\s*%"
TERM = r"(?i)(repayment|maturity|grace|상환|거치)[^0-9]{0,20}([0-9]+)\s*(months?|개월|years?|년)"
APPLICATION = r"(?is)(?:application|apply|신청|접수).{0,180}"  # proximity rule: dates this near to the word are its period
SHUT = r"(?i)applications? (?:are )?closed|접수\s*마감|종료"
NAMED = r"(?i)(?:program|policy|project|사업명|지원사업)\s*[:：]\s*([^\n]{2,})"
GANGNAM = r"(?<![0-9a-z])11680(?![0-9a-z])|gangnam[- ]gu|강남구"  # the code by itself, not digits inside a card number or a hash
ELIGIBLE = r"(?i)(?:eligible(?:\s+(?:businesses|applicants))?|eligibility|지원대상|신청대상)\s*[:：]\s*([^\n.]{2,})"


def policy_facts(documents: DataFrame) -> DataFrame:
    """Plainly stated policy facts of trusted texts; no row without a support type and a name.

    documents(doc_id, title, body, trusted)."""
    body, title = F.col("body"), F.trim("title")
    kind = F.coalesce(*[F.when(body.rlike(p), F.lit(k)) for k, p in POLICY_TYPES])
    titled = F.coalesce(*[F.when((F.col("policy_type") == k) & title.rlike(p), title) for k, p in POLICY_TYPES])
    named = F.nullif(F.trim(F.regexp_extract(body, NAMED, 1), F.lit(" .")), F.lit(""))
    line = lambda p: F.get(F.filter(F.transform(F.split(body, "\n"), lambda x: F.trim(x)), lambda x: (F.length(x) >= 3) & x.rlike(p)), F.lit(0))
    by_line = F.coalesce(*[F.when(F.col("policy_type") == k, line(p)) for k, p in POLICY_TYPES])
    amount = F.nullif(F.regexp_replace(F.regexp_extract(body, LIMIT, 1), ",", ""), F.lit("")).cast("double")
    unit = F.regexp_extract(body, LIMIT, 2)
    scale = F.coalesce(*[F.when(unit == k, d(v)) for k, v in CURRENCY.items()], d(1))
    number = lambda p: F.nullif(F.regexp_extract(body, p, 1), F.lit("")).try_cast("double")
    months = F.nullif(F.regexp_extract(body, TERM, 2), F.lit("")).cast("int") * F.when(F.lower(F.regexp_extract(body, TERM, 3)).rlike("year|년"), 12).otherwise(1)
    grace = F.lower(F.regexp_extract(body, TERM, 1)).isin("grace", "거치")
    days = explicit_days(F.regexp_extract(body, APPLICATION, 0))
    text = F.concat_ws("\n", "title", "body")
    region = F.when(F.lower(text).rlike(GANGNAM), "11680").when(F.lower(text).rlike("seoul|서울특별시|서울시"), "11")
    rows = documents.filter("trusted").withColumn("policy_type", kind).filter(F.col("policy_type").isNotNull())
    return rows.select(
        "doc_id", "policy_type", F.coalesce(titled, named, by_line).alias("name"), (amount * scale).alias("limit_krw"), number(DISCOUNT).alias("discount_pp"),
        F.when(number(DISCOUNT).isNull(), number(ANNUAL)).alias("annual_rate_percent"), F.when(grace, months).alias("grace_months"),
        F.when(~grace, months).alias("maturity_months"), F.get(days, F.lit(0)).alias("application_start"), F.get(days, F.lit(1)).alias("application_end"),
        F.when(body.rlike(SHUT), "CLOSED").otherwise("STATUS_UNCONFIRMED").alias("application_status"), region.alias("region_code"),
        F.nullif(F.trim(F.regexp_extract(body, ELIGIBLE, 1)), F.lit("")).alias("eligibility")).filter(F.col("name").isNotNull())


# ---- agent runs ----------------------------------------------------------------------------


def research_funnel(outcomes: DataFrame, run: str, agent: str) -> DataFrame:
    """Counts per agent, per run and overall. outcomes(run, agent, source_id, usable, fetched,
    navigation_only, access_failed, candidates, accepted, tokens)."""
    per = outcomes.rollup(run, agent).agg(
        F.count_distinct("source_id").alias("document_count"), F.count_distinct(F.when(F.col("usable"), F.col("source_id"))).alias("usable_document_count"),
        F.count_if("fetched").alias("fetched_document_count"), F.count_if("navigation_only").alias("navigation_only_count"),
        F.count_if("access_failed").alias("access_failure_count"), F.sum("candidates").alias("candidate_count"), F.sum("accepted").alias("accepted_event_count"),
        F.sum("tokens").alias("tokens"))
    share = lambda a: F.coalesce(F.try_divide(F.col(a).cast("double"), F.col("document_count").cast("double")), d(0))
    return per.withColumns({"usable_document_ratio": share("usable_document_count"), "navigation_only_ratio": share("navigation_only_count"),
                            "tokens_per_candidate": F.try_divide(F.col("tokens").cast("double"), F.col("candidate_count").cast("double"))}).drop("tokens")


def seed_outcomes(seeds: DataFrame, outcomes: DataFrame) -> DataFrame:
    """Flags per seed URL. seeds(url, source_id, fetched); outcomes(source_id, attempted,
    candidates, status, reason_codes, policy_failed)."""
    per = outcomes.groupBy("source_id").agg(
        F.max("attempted").alias("extraction_attempted"), F.max(F.col("candidates") > 0).alias("candidate_produced"),
        F.max(F.col("status") == "SOURCE_CONTENT_UNUSABLE").alias("rejected_by_quality"), F.max("policy_failed").alias("policy_validation_failed"))
    named = outcomes.select("source_id", F.explode("reason_codes").alias("code")).distinct().groupBy("source_id").agg(
        F.array_join(F.array_sort(F.collect_list("code")), ",").alias("reason_codes"))
    out = seeds.join(per, "source_id", "left").join(named, "source_id", "left")
    no = lambda c: F.coalesce(c, F.lit(False)).alias(c)
    return out.select("url", "source_id", "fetched", no("extraction_attempted"), no("candidate_produced"), no("rejected_by_quality"),
                      no("policy_validation_failed"), F.coalesce("reason_codes", F.lit("")).alias("reason_codes"))


def no_result_reasons(runs: DataFrame) -> DataFrame:
    """runs(hits, fetched, usable, failures, findings, candidates, cut_short, …) with reasons and
    whether the run is only partial."""
    arr = lambda *x: F.array(*[F.lit(i) for i in x])
    reasons = (
        F.when(F.col("candidates") > 0, F.array().cast("array<string>")).when(F.col("hits") == 0, arr("NO_EVENT_FOUND", "NO_RELEVANT_SEARCH_RESULTS"))
        .when(F.col("cut_short") & (F.col("fetched") == 0), arr("DOCUMENT_COLLECTION_INCOMPLETE")).when(F.col("fetched") == 0, arr("SEARCH_RESULTS_FETCH_FAILED"))
        .when(F.col("usable") == 0, arr("NO_USABLE_SOURCES", "DOCUMENTS_REJECTED_BY_QUALITY")).when(F.col("failures") > 0, arr("EXTRACTION_DEGRADED"))
        .when(F.col("findings") > 0, arr("REFERENCE_FINDINGS_ONLY")).otherwise(arr("NO_DISCRETE_EVENT", "EXTRACTION_NO_CANDIDATES")))
    return runs.withColumn("no_result_reasons", F.array_join(reasons, ",")).withColumn("partial", (F.col("failures") > 0) | (F.col("usable") == 0))


def finding_id(*parts: Column) -> Column:
    return stable_id("FND-", 20, *parts)

