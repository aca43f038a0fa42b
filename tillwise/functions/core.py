"""Small column helpers: rounding, months, ids, aggregates that replace windows."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def rnd(value: Column, digits: int) -> Column:
    """Round half up through floor, so every engine does the same arithmetic."""
    scale = float(10**digits)
    return F.floor(value * F.lit(scale) + F.lit(0.5)) / F.lit(scale)


def whole_won(value: Column) -> Column:
    """Money as whole won, half away from zero."""
    return F.round(value.cast("decimal(28,8)"), 0).cast("decimal(24,0)")


def clip(value: Column, low: float, high: float) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), value))


def d(value: float) -> Column:
    return F.lit(float(value))


def month_name(value: Column) -> Column:
    return F.date_format(value, "yyyy-MM")


def day_name(value: Column) -> Column:
    return F.date_format(value, "yyyy-MM-dd")


def month_gap(later: Column, earlier: Column) -> Column:
    """Calendar months from `earlier` to `later`."""
    return (F.year(later) - F.year(earlier)) * 12 + F.month(later) - F.month(earlier)


def stable_id(prefix: str, length: int, *parts: Column) -> Column:
    """Prefix plus the upper-case head of a sha-256 over `|`-joined parts."""
    joined = F.concat_ws("|", *[F.coalesce(p.cast("string"), F.lit("")) for p in parts])
    return F.concat(F.lit(prefix), F.upper(F.substring(F.sha2(joined, 256), 1, length)))


def codes(*pairs: tuple[Column, str]) -> Column:
    """Array of the codes whose condition holds, in the order given."""
    return F.array_compact(F.array(*[F.when(cond, F.lit(code)) for cond, code in pairs]))


def code_list(arr: Column) -> Column:
    """Sorted distinct codes as one comma-joined string."""
    return F.array_join(F.array_sort(F.array_distinct(arr)), ",")


def let(value: Column, body) -> Column:
    """Bind `value` once inside a higher-order expression."""
    return F.transform(F.array(value), body)[0]


def first_by(value: Column, *order: Column) -> Column:
    """Value of the row with the smallest order key (combines map-side, unlike a window)."""
    return F.min_by(value, F.struct(*order))


def last_by(value: Column, *order: Column) -> Column:
    return F.max_by(value, F.struct(*order))


def lookup(mapping: dict, key: Column, default: Column | None = None) -> Column:
    """Literal dimension lookup; the mapping is a fixed registry, never data."""
    table = F.create_map(*[F.lit(x) for pair in mapping.items() for x in pair])
    hit = F.try_element_at(table, key)
    return hit if default is None else F.coalesce(hit, default)


def month_scaffold(df: DataFrame, start: Column, months: Column, index: str = "month_index",
                   month: str = "month") -> DataFrame:
    """One row per forecast month, numbered from 1."""
    out = df.withColumn(index, F.explode(F.sequence(F.lit(1), months)))
    return out.withColumn(month, F.add_months(start, F.col(index) - 1))


def union_all(frames: Iterable[DataFrame]) -> DataFrame:
    frames = list(frames)
    out = frames[0]
    for frame in frames[1:]:
        out = out.unionByName(frame)
    return out
