"""Joins and neighbour lookups that survive one key holding a third of the rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SALTS = 16
#: `dealt_join`: rows of one key that stay together, and the classes of keys in which they are counted
TOGETHER, CLASSES = 16_384, 65_536


def merge_join(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """Equi join of two sides that both grow with the input, as a merge by hint.

    The planner sizes months and scenarios of a store by the file of the stores they were made from, or by how
    well they compress, and would send such a side whole through the driver to broadcast it."""
    return left.join(right.hint("merge"), keys, how)


def salted_join(big: DataFrame, small: DataFrame, keys: list[str], spread: Column, how: str = "inner",
                salts: int = SALTS) -> DataFrame:
    """Equi join where `big` may have hot keys: rows of a key are spread by `spread` over
    `salts` partitions and `small` (few rows per key) is repeated once per salt.

    The join is a merge by hint: the planner takes the repeated side for as small as it was before the repeats, and
    would send it whole through the driver to broadcast it."""
    left = big.withColumn("_salt", F.pmod(F.xxhash64(spread), F.lit(salts)).cast("int"))
    right = small.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1)))).hint("merge")
    return left.join(right, keys + ["_salt"], how).drop("_salt")


def _class(big: DataFrame, keys: list[str]) -> Column:
    """Class of a row's keys, hashed in the types they have in `big`, as equal numbers of two types hash apart."""
    kinds = {k: big.schema[k].dataType for k in keys}
    return F.pmod(F.xxhash64(*[F.col(k).try_cast(kinds[k]) for k in keys]), F.lit(CLASSES)).cast("int")


def crowded_parts(counted: DataFrame, big: DataFrame, keys: list[str], together: int) -> DataFrame:
    """(_class, _parts) of the classes with more than `together` rows."""
    parts = F.ceil(F.count("*") / together).cast("int").alias("_parts")
    return counted.groupBy(_class(big, keys).alias("_class")).agg(parts).where(F.col("_parts") > 1)


def dealt_join(big: DataFrame, small: DataFrame, keys: list[str], spread: Column, counted: DataFrame | None = None, together: int = TOGETHER) -> DataFrame:
    """Inner equi join as `salted_join`, for a long or wide `small`: only its rows whose key may have more than `together`
    rows in `big` are repeated, once for each so many rows.

    `counted` has the keys of all rows of `big`, where those are cheaper to get. They are counted by a hash of the key,
    which combines before the shuffle; the table of crowded hashes has at most CLASSES rows. A key that shares a
    crowded hash is repeated too."""
    counted = big if counted is None else counted
    crowded = crowded_parts(counted, big, keys, together)
    known = lambda side: side.withColumn("_class", _class(big, keys)).join(F.broadcast(crowded), "_class", "left").drop("_class")
    parts = F.coalesce("_parts", F.lit(1))
    left = known(big).withColumn("_salt", F.pmod(F.xxhash64(spread), parts).cast("int")).drop("_parts")
    right = known(small).withColumn("_salt", F.explode(F.sequence(F.lit(0), parts - 1))).drop("_parts")
    return merge_join(left, right, [*keys, "_salt"]).drop("_salt")


def neighbour(df: DataFrame, keys: list[str], order: list[str], bucket: Column, value: Column, name: str,
              after: bool) -> DataFrame:
    """lead/lag of `value` within `keys`, ordered by `order`, without one task per key.

    `bucket` is a monotone function of the first order column. Inside a bucket a plain window
    answers; at a bucket's edge the answer is the first (last) row of the next (previous)
    non-empty bucket, taken from a table with one row per key and bucket."""
    order_key = F.struct(*order)
    base = df.withColumn("_bucket", bucket).withColumn("_value", value)
    pick = F.min_by if after else F.max_by
    edges = base.groupBy(*keys, "_bucket").agg(pick("_value", order_key).alias("_edge"))
    across = Window.partitionBy(*keys).orderBy("_bucket")
    shift = F.lead if after else F.lag
    edges = edges.select(*keys, "_bucket", shift(F.struct("_edge")).over(across).alias("_next"))
    within = Window.partitionBy(*keys, "_bucket").orderBy(*order)
    local = base.withColumn("_local", shift(F.struct("_value")).over(within))
    joined = local.join(edges, [*keys, "_bucket"], "left")
    return joined.withColumn(
        name, F.when(F.col("_local").isNotNull(), F.col("_local._value")).otherwise(F.col("_next._edge"))
    ).drop("_bucket", "_value", "_local", "_next")


def spread_rank(df: DataFrame, keys: list[str], bucket: Column, order: list[Column], name: str) -> DataFrame:
    """row_number within `keys` in `order`, without one task per key.

    `bucket` is a non-decreasing function of the order. Ranks inside a bucket are local; the
    rows of earlier buckets are counted on one row per key and bucket."""
    base = df.withColumn("_bucket", bucket)
    before = Window.partitionBy(*keys).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = base.groupBy(*keys, "_bucket").agg(F.count("*").alias("_n"))
    offsets = offsets.withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0))).drop("_n")
    local = base.withColumn("_local", F.row_number().over(Window.partitionBy(*keys, "_bucket").orderBy(*order)))
    return local.join(offsets, [*keys, "_bucket"]).withColumn(name, F.col("_before") + F.col("_local")).drop("_bucket", "_before", "_local")


def tie_safe(df: DataFrame, keys: list[str], bucket: Column, score: Column, number: Column, most: int = 4096) -> DataFrame:
    """Adds `_fine`, a bucket for `spread_rank` in the order (score descending, number ascending) that holds at most about `most` rows, and
    as many rows of one score only where their numbers lie within `most` of each other: where the plain bucket holds more,
    it is split by score and by ranges of the number, so that equal scores are spread too."""
    counts = df.groupBy(*keys, bucket.alias("_coarse")).agg(F.count("*").alias("_rows")).where(F.col("_rows") > most)
    joined = salted_join(df.withColumn("_coarse", bucket), counts, [*keys, "_coarse"], number, "left")
    large = F.col("_rows").isNotNull()
    fine = F.struct(F.col("_coarse").alias("a"), F.when(large, -score).alias("b"), F.when(large, F.floor(number / most)).alias("c"))
    return joined.withColumn("_fine", fine).drop("_coarse", "_rows")
