"""Dates in notices: ISO, Korean, two-digit year, relative words, month plus document year."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tillwise.functions.core import lookup

# Patterns, relative words, month names and the words that mark a document's year.
QUOTES = "'‘’"
DAY = rf"(?:([{QUOTES}]?[0-9]{{2,4}})\s*[년./-]\s*)?([0-9]{{1,2}})\s*[월./-]\s*([0-9]{{1,2}})\s*일?"
RELATIVE = [("오늘", 0), ("금일", 0), ("내일", 1), ("익일", 1), ("어제", -1), ("전일", -1)]
MONTHS = {m: i + 1 for i, m in enumerate(
    "january february march april may june july august september october november december".split())}
REPORT_WORDS = r"(?i)report(?:ing)?\s+period|fiscal\s+year|\bfy\b|report|보고서|기준년도"
PUBLISHED_WORDS = r"(?i)published|publication date|게재일|발행일|작성일"
YEAR = r"\b(19[0-9]{2}|20[0-9]{2})\b"
YEAR_WINDOW = 48  # proximity rule: a word this near to a year names it


def safe_date(year: Column, month: Column, day: Column) -> Column:
    """Date from text parts, NULL for an impossible one."""
    pad = lambda c, n: F.lpad(c.cast("string"), n, "0")
    return F.try_to_date(F.concat_ws("-", pad(year, 4), pad(month, 2), pad(day, 2)), "yyyy-MM-dd")


def normalize_date(raw: Column, published: Column) -> Column:
    """struct(date, rule). `rule` is NULL when the text is not a date."""
    value = F.ltrim(F.trim(raw), F.lit(QUOTES))
    head = F.substring(value, 1, 10)
    iso = F.when(head.rlike(r"^[0-9]{4}-[0-9]{2}-[0-9]{2}$"), F.try_to_date(head, "yyyy-MM-dd")).when(
        head.rlike(r"^[0-9]{8}$"), F.try_to_date(head, "yyyyMMdd"))
    part = lambda i: F.nullif(F.regexp_extract(value, DAY, i), F.lit(""))
    year_text = F.ltrim(part(1), F.lit(QUOTES))
    short = F.length(year_text) == 2
    year = F.when(short, F.concat(F.lit("20"), year_text)).otherwise(F.coalesce(year_text, F.year(published).cast("string")))
    dated = F.when(part(2).isNotNull(), safe_date(year, part(2), part(3)))
    dated_rule = F.when(short, "KO_DATE_TWO_DIGIT_YEAR_V1").when(year_text.isNotNull(), "KO_DATE_ABSOLUTE_V1").otherwise(
        "KO_DATE_YEAR_FROM_PUBLISHED_AT_V1")
    shift = F.coalesce(*[F.when(value.contains(word), F.lit(n)) for word, n in RELATIVE])
    relative = F.when(part(2).isNull(), F.date_add(published, shift))
    blank = raw.isNull() | (raw == "")
    found = F.coalesce(iso, dated, relative)
    rule = (
        F.when(blank, "KO_DATE_EMPTY_V1").when(iso.isNotNull(), "ISO_DATE_V1").when(dated.isNotNull(), dated_rule)
        .when(relative.isNotNull(), "KO_DATE_RELATIVE_PUBLISHED_AT_V1"))
    return F.struct(F.when(~blank, found).alias("date"), rule.alias("rule"))


def month_only(raw: Column) -> Column:
    """Month number of text that names nothing but a month."""
    text = F.trim(raw)
    english = lookup(MONTHS, F.lower(F.regexp_extract(text, r"^([A-Za-z]+)\.?$", 1)))
    korean = F.nullif(F.regexp_extract(text, r"^([0-9]{1,2})\s*월$", 1), F.lit("")).cast("int")
    return F.coalesce(english, F.when(korean.between(1, 12), korean))


def anchored_year(text: Column, words: str) -> Column:
    """First four-digit year with one of `words` within 48 characters of it."""
    pieces = F.split(text, YEAR)
    years = F.regexp_extract_all(text, F.lit(YEAR), F.lit(1))
    before = lambda i: F.aggregate(F.slice(pieces, 1, i + 1), F.lit(0), lambda n, p: n + F.length(p)) + i * 4
    near = lambda i: F.substring(text, F.greatest(F.lit(1), before(i) - YEAR_WINDOW + 1),
                                 F.least(before(i), F.lit(YEAR_WINDOW)) + 4 + YEAR_WINDOW)
    hits = F.filter(years, lambda y, i: near(i).rlike(words))
    return F.get(hits, F.lit(0)).cast("int")


def anchored_month(raw: Column, title: Column, body: Column, published: Column) -> Column:
    """struct(date, source): a bare month dated by the document's own year, else NULLs."""
    choices = [
        (anchored_year(title, REPORT_WORDS), "DOCUMENT_TITLE_REPORT_PERIOD"),
        (anchored_year(body, REPORT_WORDS), "DOCUMENT_HEADER_REPORT_PERIOD"),
        (anchored_year(body, PUBLISHED_WORDS), "DOCUMENT_BODY_PUBLICATION_DATE"),
        (F.year(published), "SOURCE_DOCUMENT_PUBLISHED_AT"),
    ]
    pick = F.coalesce(*[F.when(y.isNotNull(), F.struct(y.alias("year"), F.lit(s).alias("source"))) for y, s in choices])
    month = month_only(raw)
    return F.struct(safe_date(pick["year"], month, F.lit(1)).alias("date"), F.when(month.isNotNull(), pick["source"]).alias("source"))
