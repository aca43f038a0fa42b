"""Numbers with units in text: one canonical unit, currency words scaled to won."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tillwise.functions.core import lookup

# Unit spellings and currency multipliers.
UNITS = {
    "%": "PERCENT", "percent": "PERCENT", "percentage": "PERCENT", "퍼센트": "PERCENT",
    "%p": "PERCENTAGE_POINT", "percentage point": "PERCENTAGE_POINT", "percentage points": "PERCENTAGE_POINT",
    "원": "KRW", "만원": "KRW", "백만원": "KRW", "억원": "KRW", "krw": "KRW", "krw/usd": "KRW_PER_USD",
    "days": "DAYS", "months": "MONTHS", "month": "MONTHS", "개월": "MONTHS", "달": "MONTHS",
    "year": "YEARS", "years": "YEARS", "년": "YEARS",
}
CURRENCY = {"원": 1.0, "만원": 1e4, "백만원": 1e6, "억원": 1e8}
UNIT_WORDS = (r"%\s*[pP]?|percentage\s+points?|percent(?:age)?|퍼센트|백만원|만원|억원|원|KRW(?:/USD)?"
              r"|months?|개월|달|years?|년|days?")
NUMBER = r"(?i)^([+-]?[0-9]+(?:\.[0-9]+)?)\s*(" + UNIT_WORDS + r")?$"
NUMBERS_IN_TEXT = r"(?i)(?:KRW\s*)?[+-]?[0-9]+(?:,[0-9]{3})*(?:\.[0-9]+)?\s*(?:" + UNIT_WORDS + ")?"

# Indicator spellings.
INDICATOR_ALIASES = {"baserate": "BASE_RATE", "기준금리": "BASE_RATE", "한국은행기준금리": "BASE_RATE", "bokbaserate": "BASE_RATE"}


def fold_unit(raw: Column) -> Column:
    text = F.lower(F.trim(F.regexp_replace(raw, r"\s+", " ")))
    return lookup(UNITS, F.replace(text, F.lit("% p"), F.lit("%p")))


def normalize_number(raw: Column, unit: Column | None = None) -> Column:
    """struct(value, unit); both NULL when the number or its unit cannot be told."""
    text = F.replace(F.trim(raw), F.lit(","), F.lit(""))
    found = F.nullif(F.regexp_replace(F.regexp_extract(text, NUMBER, 2), r"\s+", ""), F.lit(""))
    value = F.nullif(F.regexp_extract(text, NUMBER, 1), F.lit("")).cast("double")
    known = fold_unit(found) if unit is None else F.coalesce(fold_unit(found), fold_unit(unit))
    scaled = value * F.coalesce(lookup(CURRENCY, found), F.lit(1.0))
    return F.struct(F.when(known.isNotNull(), scaled).alias("value"), F.when(value.isNotNull(), known).alias("unit"))


def indicator_name(raw: Column) -> Column:
    key = F.regexp_replace(F.lower(raw), r"[\s_\-]+", "")
    return F.when(key != "", lookup(INDICATOR_ALIASES, key, F.upper(F.trim(raw))))


def indicator_unit(raw: Column) -> Column:
    text = F.trim(raw)
    percent = {k: "PERCENT" for k in ("%", "percent", "percentage", "퍼센트")}
    return F.when(text != "", lookup(percent, F.regexp_replace(F.lower(text), r"[\s_\-]+", ""), F.upper(text)))
