"""Byte-balanced shards of indivisible groups by Karmarkar-Karp differencing."""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tillwise.llm.common import text_or_empty, written

#: items that one differencing run takes: groups of at least total / ITEMS bytes each (so fewer than ITEMS of
#: them) and as many bins of smaller groups. The bound holds at any input size.
ITEMS = 4096
#: parts into which the rows of a shard are dealt to be numbered
SLOT_PARTS = 64


def difference(sizes: np.ndarray, shards: int) -> np.ndarray:
    """Shard of each item. Every item starts as a partial partition of its own; the two partial partitions
    with the largest spread are combined again and again, the fullest part of one with the emptiest of the
    other. Ties go by item number, so the result is the same in every run."""
    n = len(sizes)
    if not n:
        return np.zeros(0, dtype=np.int64)
    # a partial partition: part sizes in descending order, and for each part a linked list of its items
    following = np.full(n, -1, dtype=np.int64)
    heap = []
    for i, size in enumerate(sizes.tolist()):
        parts = [(size, i, i)] + [(0, -1, -1)] * (shards - 1)
        heap.append((-size, i, parts))
    heapq.heapify(heap)
    while len(heap) > 1:
        _, a, left = heapq.heappop(heap)
        _, b, right = heapq.heappop(heap)
        joined = []
        for (x, head, tail), (y, other, end) in zip(left, reversed(right)):
            if head < 0:
                head, tail = other, end
            elif other >= 0:
                following[tail], tail = other, end
            joined.append((x + y, head, tail))
        joined.sort(key=lambda p: (-p[0], p[1]))
        heapq.heappush(heap, (joined[-1][0] - joined[0][0], min(a, b), joined))
    out = np.zeros(n, dtype=np.int64)
    for shard, (_, item, _) in enumerate(heap[0][2]):
        while item >= 0:
            out[item] = shard
            item = following[item]
    return out


def assign_groups(groups: DataFrame, shards: int) -> DataFrame:
    """(group, shard) for rows (group, bytes): one shard for each group, with sizes as near equal as
    differencing makes them.

    Groups of at least total / ITEMS bytes are items by themselves; the others are dealt by hash into ITEMS
    bins first. So the differencing, in one task, takes under 2 x ITEMS rows however large the input is."""
    total = groups.agg(F.sum("bytes")).first()[0] or 0
    marked = groups.withColumn(
        "item", F.when(F.col("bytes") * ITEMS >= total, F.concat(F.lit("g"), F.col("group"))).otherwise(
            F.concat(F.lit("b"), F.pmod(F.xxhash64("group"), F.lit(ITEMS)).cast("string"))))
    items = marked.groupBy("item").agg(F.sum("bytes").alias("bytes"))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        kept = [f for f in frames if len(f)]
        if kept:
            rows = pd.concat(kept).sort_values(["bytes", "item"], ascending=[False, True], ignore_index=True)
            yield pd.DataFrame({"item": rows["item"], "shard": difference(rows["bytes"].to_numpy(), shards).astype("int32")})

    dealt = items.coalesce(1).mapInPandas(run, "item string, shard int")
    # at most 2 x ITEMS rows, by the rule above
    return marked.join(F.broadcast(dealt), "item").select("group", "shard")


def number_rows(df: DataFrame, shard: str, order: str, name: str) -> DataFrame:
    """Gapless numbers from 0 within each shard. Rows are dealt by hash into SLOT_PARTS parts of a shard,
    numbered there, and moved by the sizes of the parts before; no shard lies in one task."""
    parts = df.withColumn("_part", F.pmod(F.xxhash64(order), F.lit(SLOT_PARTS)))
    local = parts.withColumn("_at", F.row_number().over(Window.partitionBy(shard, "_part").orderBy(order, "_row")) - 1)
    before = Window.partitionBy(shard).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    sizes = parts.groupBy(shard, "_part").agg(F.count("*").alias("_n"))
    sizes = sizes.select(shard, "_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    # shards x SLOT_PARTS rows
    return local.join(F.broadcast(sizes), [shard, "_part"]).withColumn(name, F.col("_before") + F.col("_at")).drop("_part", "_before", "_at")


def shard_rows(df: DataFrame, group: Column, size: Column, shards: int, id_col: str = "doc_id",
               keep: dict[str, Column] | None = None) -> DataFrame:
    """(id, size, kept columns, shard, slot): every row of `df` in one of `shards` shards, rows of equal `group`
    together, shard sizes near equal, slots gapless from 0.

    Null groups count as the group of the empty string, null sizes as 0; null ids and repeated rows get
    slots of their own; an empty table gives no rows. Only the columns named are read."""
    rows = df.select(F.col(id_col), F.coalesce(group.cast("string"), F.lit("")).alias("_group"),
                     F.coalesce(size.cast("long"), F.lit(0)).alias("size"), *[c.alias(n) for n, c in (keep or {}).items()])
    rows = written(rows, "shard-rows")
    groups = rows.groupBy(F.col("_group").alias("group")).agg(F.sum("size").alias("bytes"))
    placed = assign_groups(written(groups.select("group", "bytes"), "shard-groups"), shards)
    found = rows.join(placed.withColumnRenamed("group", "_group"), "_group").withColumn("_row", F.monotonically_increasing_id())
    return number_rows(found, "shard", id_col, "slot").drop("_group", "_row")


def document_shards(df: DataFrame, shards: int = 16, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Documents in shards of near equal bytes; equal texts stay together. Size: UTF-8 bytes plus 1; a null
    text counts as empty. Returns (id, size, text_crc32, law, shard, slot, grown_shard)."""
    text = text_or_empty(text_col)
    placed = shard_rows(df, F.sha2(text, 256), F.octet_length(text) + 1, shards, id_col, {"text_crc32": F.crc32(text.cast("binary"))})
    return placed.select(id_col, "size", "text_crc32", F.lit("bytes").alias("law"), "shard", F.col("slot").cast("long").alias("slot"),
                         F.lit(None).cast("int").alias("grown_shard"))
