"""Text folding, organisation ids, injection flags, navigation share."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from tillwise.functions.core import lookup, stable_id
from tillwise.sources.registry import ORGANISATIONS, ORGANISATIONS_FOLDED


@F.pandas_udf(StringType())
def norm_text(text: pd.Series) -> pd.Series:
    """NFKC plus whitespace fold; the one text rule that Spark has no expression for."""
    return text.map(lambda t: None if t is None else " ".join(unicodedata.normalize("NFKC", t).split()))


def fold_space(text: Column) -> Column:
    """Whitespace fold for text that is already composed (all ASCII, for one)."""
    return F.trim(F.regexp_replace(text, r"\s+", " "))


def register(spark: SparkSession) -> None:
    """Make the text rule callable from SQL."""
    spark.udf.register("norm_text", norm_text)


def organisation_id(name: Column) -> Column:
    """struct(org_id, rule) of a folded organisation name."""
    text = F.nullif(fold_space(name), F.lit(""))
    alias = lookup(ORGANISATIONS, text)
    bank = F.lower(text).isin(ORGANISATIONS_FOLDED)
    org = F.when(text.isNotNull(), F.coalesce(alias, F.when(bank, F.lit("ORG-BOK")), stable_id("ORG-", 12, text)))
    rule = (
        F.when(text.isNull(), "ORGANIZATION_EMPTY_V1").when(alias.isNotNull(), "ORGANIZATION_ALIAS_V1")
        .when(bank, "ORGANIZATION_BANK_OF_KOREA_ALIAS_V1").otherwise("ORGANIZATION_STABLE_HASH_V1"))
    return F.struct(org.alias("org_id"), rule.alias("rule"))


# Patterns that mark text addressing a machine reader.
INJECTION = [
    r"(?i)ignore\s+(all\s+)?previous\s+instructions", r"(?i)system\s+prompt", r"(?i)developer\s+message",
    r"(?i)execute\s+(this\s+)?command", r"(?i)read\s+.*(?:api[_ -]?key|password|secret)", r"이전\s*지시.*무시",
    r"시스템\s*프롬프트", r"명령(?:어)?\s*실행",
]


def injection_flags(text: Column) -> Column:
    return F.array_compact(F.array(*[
        F.when(text.rlike(p), F.lit(f"PROMPT_INJECTION_PATTERN_{i + 1}")) for i, p in enumerate(INJECTION)]))


# Menu words, list markers, date and place signals.
MENU_WORDS = "메뉴|홈|로그인|검색|전체메뉴|사이트맵|이전|다음|목록|바로가기|개인정보처리방침|copyright|menu|login"
LIST_MARKERS = "목록|검색 결과|게시판|전체보기|list|search"
SENTENCE_END = r"[.!?。]$"
DATED = r"20[0-9]{2}[./년-]\s*[0-9]{1,2}|20[0-9]{2}"
PLACE_SIGNAL = "시|군|구|동|행사|축제|공사|공고"


def navigation_ratio(text: Column) -> Column:
    """Menu-like lines over menu-like plus content lines; 1 for an empty page."""
    lines = F.filter(F.transform(F.split(text, r"\r\n|[\n\r]"), lambda x: F.trim(x)), lambda x: x != "")
    sentence = lambda x: x.rlike(SENTENCE_END) | (F.length(x) >= 80)
    menu = lambda x: F.lower(x).rlike(MENU_WORDS) & ~sentence(x)
    content = lambda x: ~menu(x) & (sentence(x) | x.rlike(DATED) | x.rlike(PLACE_SIGNAL))
    nav, body = F.size(F.filter(lines, menu)), F.size(F.filter(lines, content))
    return F.when(F.size(lines) == 0, F.lit(1.0)).otherwise(nav / F.greatest(F.lit(1), nav + body))


# Words and tokens of two or more letters or digits.
TOKEN = "[0-9A-Za-z가-힣]{2,}"


def tokens(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(f"({TOKEN})"), F.lit(1))


def unique_tokens(text: Column) -> Column:
    return F.array_distinct(tokens(F.lower(text)))
