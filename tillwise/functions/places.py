"""Regions, industries, addresses and venue names."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tillwise.functions.core import d, lookup
from tillwise.functions.text import fold_space
from tillwise.sources.registry import INDUSTRIES

# Region spellings and display names.
REGION_ALIASES = {
    "11": "KR-11", "서울특별시 강남구": "KR-11680", "서울 강남구": "KR-11680", "강남구": "KR-11680", "seoul gangnam-gu": "KR-11680",
    "seoul gangnam gu": "KR-11680", "서울특별시 서초구": "KR-11650", "서울 서초구": "KR-11650", "서초구": "KR-11650",
    "서울특별시 송파구": "KR-11710", "서울 송파구": "KR-11710", "송파구": "KR-11710",
}
REGION_NAMES = {"KR-11": "서울특별시", "KR-11680": "서울특별시 강남구", "KR-11650": "서울특별시 서초구", "KR-11710": "서울특별시 송파구"}


def region_id(value: Column) -> Column:
    """Canonical region code, NULL when unknown."""
    key = F.lower(fold_space(value))
    digits = F.nullif(F.regexp_extract(key, "^(?:kr-)?([0-9]{2,10})$", 1), F.lit(""))
    return lookup(REGION_ALIASES, key, F.concat(F.lit("KR-"), digits))


def region_ids(values: Column) -> Column:
    """Distinct canonical codes of a list of region names."""
    return F.array_distinct(F.filter(F.transform(values, region_id), lambda x: x.isNotNull()))


def regions_match(store_region: Column, policy_regions: Column, hierarchical: bool = False) -> Column:
    """True, False or NULL (unknown). A broader region does not match its districts unless
    `hierarchical` is set, which is how the compared codes behave."""
    return region_codes_match(region_id(store_region), policy_regions, region_ids(policy_regions), hierarchical)


def region_codes_match(mine: Column, declared: Column, theirs: Column, hierarchical: bool = False) -> Column:
    """The same for codes worked out before a store and a policy meet."""
    nested = (lambda t: mine.startswith(t)) if hierarchical else (
        lambda t: mine.startswith(F.concat(t, F.lit("-"))) | t.startswith(F.concat(mine, F.lit("-"))))
    open_to_all = declared.isNull() | (F.size(declared) == 0)
    unknown = mine.isNull() | (F.size(theirs) == 0)
    return F.when(open_to_all, True).when(unknown, None).otherwise(F.array_contains(theirs, mine) | F.exists(theirs, nested))


def industry_codes(raw: Column) -> Column:
    """Sorted codes of every industry word contained in the raw labels (array of text)."""
    def named(word: str):
        return lambda x: F.lower(x).contains(word.lower())

    none = F.array().cast("array<string>")
    per_word = [F.when(F.exists(raw, named(w)), F.array(*[F.lit(c) for c in found])).otherwise(none) for w, found in INDUSTRIES.items()]
    return F.array_sort(F.array_distinct(F.flatten(F.array(*per_word))))


def industry_relevance(store_code: Column, found: Column) -> Column:
    """Validation relevance: 1 direct or unstated, 0.7 same family, 0 unrelated."""
    return F.when((F.size(found) == 0) | F.array_contains(found, store_code), d(1)).when(
        store_code.startswith("FNB") & F.array_contains(found, "FNB"), d(0.7)).otherwise(d(0))


def signal_relevance(store_code: Column, found: Column) -> Column:
    """Signal relevance: 1 direct, 0.7 same family, else 0.3."""
    family = store_code.startswith("FNB") & F.exists(found, lambda c: c.startswith("FNB"))
    return F.when(F.array_contains(found, store_code), d(1)).when(family, d(0.7)).otherwise(d(0.3))


# Province spellings at the head of an address, generic venue tails, venue spellings.
PROVINCES = {
    "서울": "서울특별시", "서울시": "서울특별시", "부산시": "부산광역시", "대구시": "대구광역시", "인천시": "인천광역시",
    "광주시": "광주광역시", "대전시": "대전광역시", "울산시": "울산광역시", "세종시": "세종특별자치시", "제주도": "제주특별자치도",
}
VENUE_TAIL = r"\s*(?:및\s*)?(?:주요\s*)?(?:관광명소|행사장소|주요장소|일대)\s*$"
VENUE_SEPARATOR = r"\s*(?:,|/|;|·|및)\s*"
VENUES = {"코엑스몰": "코엑스", "코엑스 앞 특설무대": "코엑스", "coex mall": "coex", "coex special stage": "coex"}


def normalize_address(value: Column) -> Column:
    text = fold_space(F.regexp_replace(value, "[,;]+", " "))
    head = F.substring_index(text, " ", 1)
    return F.concat(lookup(PROVINCES, head, head), F.substring(text, F.length(head) + 1, F.length(text)))


def normalize_venue(value: Column) -> Column:
    text = F.trim(F.regexp_replace(fold_space(value), VENUE_TAIL, ""), F.lit(" ,;/·"))
    return lookup(VENUES, F.lower(text), text)


def venue_forms(value: Column, areas: Column, context: Column | None = None) -> Column:
    """Search forms in order: cleaned name, its first part, that part with each area."""
    cleaned = normalize_venue(value)
    pieces = F.filter(F.transform(F.split(cleaned, VENUE_SEPARATOR), normalize_venue), lambda x: x != "")
    core = F.coalesce(F.get(pieces, F.lit(0)), cleaned)
    local = core.rlike("[가-힣]") | F.lower(core).contains("coex")
    with_area = F.when(local, F.transform(areas, lambda a: F.concat(core, F.lit(" "), a))).otherwise(F.array().cast("array<string>"))
    forms = F.concat(F.array(cleaned, core), with_area)
    if context is not None:
        text = normalize_venue(context)
        forms = F.concat(forms, F.when(text != "", F.array(F.concat(core, F.lit(" "), text)))
                         .otherwise(F.array().cast("array<string>")))
    return F.array_distinct(F.filter(forms, lambda x: x != ""))
