"""Near-duplicate vectors by iterative quantisation, multi-index Hamming tables and an exact rerank."""

from __future__ import annotations

import functools
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tillwise.llm.common import mix, written
from tillwise.llm.components import components

#: vectors, picked by a hash of their id, that the rotations are learned from; every vector is indexed
SAMPLE = 20_000
#: codes of one bit for each dimension, each with a rotation of its own, and tables for each code at least. A pair
#: is found if one of the ROTATIONS x tables parts differs in at most one bit
ROTATIONS, TABLES, ROUNDS = 3, 3, 30
#: bits of a part at most, as it is one 64-bit number
PART_BITS = 64
#: expected share of the pairs at the limit that are found, at least; where TABLES do not reach it there are more
RECALL = 0.999
#: vectors of a length, for each dimension, that rotations are learned from at least; with fewer they are random
LEARNED = 4


def learn_rotations(sample: np.ndarray, count: int = ROTATIONS, rounds: int = ROUNDS) -> tuple[np.ndarray, list[np.ndarray]]:
    """Mean and `count` orthogonal matrices that turn centred unit vectors so that signs lose little:
    sign codes and rotation are fitted in turns (iterative quantisation), from different random starts."""
    dims = sample.shape[1]
    mean = sample.mean(axis=0)
    centred = sample - mean
    _, axes = np.linalg.eigh(centred.T @ centred)
    principal = centred @ axes
    out = []
    for seed in range(count):
        turn, _ = np.linalg.qr(np.random.default_rng(seed).normal(size=(dims, dims)))
        for _ in range(rounds):
            code = np.where(principal @ turn >= 0, 1.0, -1.0)
            u, _, v = np.linalg.svd(principal.T @ code)
            turn = u @ v
        out.append(axes @ turn)
    return mean, out


def expected_recall(dims: int, tables: int, least: float, rotations: int = ROTATIONS) -> float:
    """The chance that a pair at cosine `least` agrees in all bits but one of some part, where each bit differs
    with acos(least) / pi."""
    p, missed = math.acos(min(1.0, max(-1.0, least))) / math.pi, 1.0
    for part in np.array_split(np.arange(dims), tables):
        missed *= (1 - (1 - p) ** len(part) - len(part) * p * (1 - p) ** (len(part) - 1)) ** rotations
    return 1 - missed


@functools.lru_cache(maxsize=1024)
def tables_for(dims: int, least: float) -> int:
    """The fewest parts of a code, TABLES at least, whose expected recall reaches RECALL. Parts of one bit find
    every pair, so there always are."""
    tables = min(max(TABLES, -(-dims // PART_BITS)), dims)
    while tables < dims and expected_recall(dims, tables, least) < RECALL:
        tables += 1
    return tables


@functools.lru_cache(maxsize=16)
def random_rotations(dims: int, count: int = ROTATIONS) -> tuple[np.ndarray, list[np.ndarray]]:
    """As `learn_rotations`, for a length that too few vectors have: the same in every task, about zero."""
    return np.zeros(dims), [np.linalg.qr(np.random.default_rng([dims, seed]).normal(size=(dims, dims)))[0] for seed in range(count)]


def learn_models(sample: pa.Array) -> dict[int, tuple[np.ndarray, list[np.ndarray]]]:
    """Dimensions to mean and rotations, for each length that enough vectors of the sample have."""
    dims = np.asarray(pc.binary_length(sample)) // 8
    return {int(d): learn_rotations(_units(sample.filter(pa.array(dims == d)))) for d in np.unique(dims) if (dims == d).sum() >= LEARNED * d}


def by_length(batch: pa.RecordBatch, column: str, most: int = 2000) -> Iterator[tuple[int, pa.RecordBatch]]:
    """(dimensions, rows of that many), `most` rows at once."""
    dims = np.asarray(pc.binary_length(batch.column(column))) // 8
    for d in np.unique(dims):
        some = batch.filter(pa.array(dims == d))
        for at in range(0, some.num_rows, most):
            yield int(d), some.slice(at, most)


def table_codes(units: np.ndarray, mean: np.ndarray, rotations: list[np.ndarray], tables: int = TABLES) -> list[tuple[np.ndarray, int]]:
    """For each rotation and table: the bits of all vectors as one number, and how many bits those are."""
    out = []
    for turn in rotations:
        bits = ((units - mean) @ turn) >= 0
        for part in np.array_split(np.arange(bits.shape[1]), min(tables, bits.shape[1])):
            weight = np.uint64(1) << np.arange(len(part), dtype=np.uint64)
            out.append(((bits[:, part] * weight).sum(axis=1).astype(np.uint64), len(part)))
    return out


def look_up_keys(labels: np.ndarray, codes: list[tuple[np.ndarray, int]], probes: bool) -> np.ndarray:
    """n x keys: the key of each table's code or, with `probes`, also those of all codes one bit away."""
    columns = []
    for number, (code, bits) in enumerate(codes):
        flips = np.concatenate([np.zeros(1, dtype=np.uint64), np.uint64(1) << np.arange(bits, dtype=np.uint64)]) if probes else np.zeros(1, dtype=np.uint64)
        space = mix(labels.astype(np.int64).view(np.uint64) + np.uint64((number + 1) * 0x9E3779B97F4A7C15 % 2**64))
        columns.append(mix((code[:, None] ^ flips[None, :]) + space[:, None]))
    return np.concatenate(columns, axis=1).view(np.int64)


def _checked(df: DataFrame, id_col: str, vector_col: str, label_col: str) -> DataFrame:
    """(id, label, vector): vectors as bytes of doubles; null where they link with nothing."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            labels = batch.column("label").to_pylist()
            out = []
            for label, cell in zip(labels, batch.column("vector")):
                values = cell.values if cell.is_valid else None
                if label is None or values is None or not len(values) or values.null_count:
                    out.append(None)
                    continue
                v = np.asarray(values, dtype=np.float64)
                out.append(v.tobytes() if np.isfinite(v).all() and v.any() else None)
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("label"), pa.array(out, pa.binary())], ["id", "label", "vector"])

    rows = df.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("long").alias("label"), F.col(vector_col).cast("array<double>").alias("vector"))
    return rows.mapInArrow(run, "id long, label long, vector binary")


def _units(column: pa.Array) -> np.ndarray:
    rows = np.frombuffer(b"".join(column.to_pylist()), dtype=np.float64).reshape(len(column), -1)
    scaled = rows / np.abs(rows).max(axis=1, keepdims=True)
    return scaled / np.linalg.norm(scaled, axis=1, keepdims=True)


def _keys(classes: DataFrame, models: dict[int, tuple[np.ndarray, list[np.ndarray]]], least: float, probes: bool) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for dims, part in by_length(batch, "vector"):
                spaces = mix(np.asarray(part.column("label")).astype(np.int64).view(np.uint64) ^ mix(np.array([dims], dtype=np.uint64))).view(np.int64)
                mean, rotations = models.get(dims) or random_rotations(dims)
                keys = look_up_keys(spaces, table_codes(_units(part.column("vector")), mean, rotations, tables_for(dims, least)), probes)
                yield pa.RecordBatch.from_arrays([pa.array(keys.ravel()), pa.array(np.repeat(np.asarray(part.column("id")), keys.shape[1]))], ["key", "id"])

    return classes.select("id", "label", "vector").mapInArrow(run, "key long, id long")


def _reranked(pairs: DataFrame, classes: DataFrame, least: float) -> DataFrame:
    """The pairs (a, b) with equal labels and a cosine of at least `least` in double precision."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, part in by_length(batch, "va"):
                x, y = _units(part.column("va")), _units(part.column("vb"))
                ok = pa.array(((x * y).sum(axis=1) >= least) & (np.asarray(part.column("la")) == np.asarray(part.column("lb"))))
                yield pa.RecordBatch.from_arrays([part.column("a").filter(ok), part.column("b").filter(ok)], ["a", "b"])

    one, two = (classes.select(F.col("id").alias(n), F.col("label").alias(f"l{n}"), F.col("vector").alias(f"v{n}")) for n in "ab")
    return pairs.join(one, "a").join(two, "b").where(F.octet_length("va") == F.octet_length("vb")).mapInArrow(run, "a long, b long")


def near_vectors(df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", least: float = 0.98) -> DataFrame:
    """(id, n_links, component_id, kept) of every vector; vectors with equal labels and lengths link at a cosine
    of at least `least`.

    Equal vectors are one class and are indexed once. The rotations of each length are learned on the driver
    from those of at most SAMPLE classes that have it; every class is indexed, retrieved through the Hamming tables and reranked with its
    original vector. At a cosine of 0.98 a bit differs with probability 0.064 for a random rotation, so at 64
    dimensions all nine parts of 21 bits differ in two bits or more with about 2e-4. More dimensions or a lower
    `least` have more parts, so that RECALL is expected at the limit (`tables_for`).

    Null labels, null, empty or zero vectors, vectors with null or non-finite components, and null ids link
    with nothing and are kept. Rows with the same id are one node. An empty table gives no rows; other columns are not read."""
    checked = written(_checked(df, id_col, vector_col, label_col), "vectors")
    valid = F.col("vector").isNotNull() & F.col("id").isNotNull()
    rows = checked.withColumn("c1", F.when(valid, F.xxhash64("label", "vector"))).withColumn("c2", F.when(valid, F.xxhash64("vector", "label")))
    classes = written(rows.where("c1 is not null").groupBy("c1", "c2", "label", "vector").agg(F.min("id").alias("id"), F.count("*").alias("n")), "vector-classes")
    sample = classes.orderBy(F.xxhash64("id"), "id").limit(SAMPLE).select("vector").toArrow().column("vector").combine_chunks()
    if len(sample):
        models = learn_models(sample)
        index, probes = _keys(classes, models, least, False), _keys(classes, models, least, True)
        found = index.withColumnRenamed("id", "a").join(probes.withColumnRenamed("id", "b"), "key").where("a < b").select("a", "b").distinct()
        links = _reranked(found, classes, least)
    else:
        links = classes.select(F.col("id").alias("a"), F.col("id").alias("b"))
    links = written(links, "vector-links")
    roots = components(links)
    size = classes.select(F.col("id").alias("b"), F.col("n").alias("_n"))
    both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    degree = both.join(size, "b").groupBy(F.col("a").alias("_node")).agg(F.sum("_n").alias("_linked"))
    done = (classes.drop("vector").join(degree, F.col("id") == F.col("_node"), "left").join(roots, F.col("id") == F.col("node"), "left")
            .select(F.col("c1").alias("_c1"), F.col("c2").alias("_c2"), (F.col("n") - 1 + F.coalesce("_linked", F.lit(0))).alias("n_links"),
                    F.coalesce("root", "id").alias("component_id")))
    done = written(done, "vector-classes")
    out = rows.drop("vector").join(done, (F.col("c1") == F.col("_c1")) & (F.col("c2") == F.col("_c2")), "left")
    return out.select(F.col("id").alias(id_col), F.coalesce("n_links", F.lit(0)).alias("n_links"), F.coalesce("component_id", "id").alias("component_id")).withColumn(
        "kept", F.coalesce(F.col(id_col) == F.col("component_id"), F.lit(True)))
