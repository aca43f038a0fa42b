"""Packing along a space-filling curve: near documents share sequences, and nothing is padded but the end."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tillwise.llm.bpe import word_encoder
from tillwise.llm.common import mix, no_cycles, slices, text_or_empty, written

#: id put after each document
END_ID = 2
#: buckets of the hashed document vector, dimensions it is projected to, bits of each on the curve
BUCKETS, DIMS, BITS = 1024, 3, 16


def projection(vocabulary: int = 1 << 16) -> np.ndarray:
    """Row i: what token id i adds to the projected vector. An id is hashed to one of BUCKETS signed buckets,
    and the bucket vector is projected by a fixed Gaussian matrix."""
    code = mix(np.arange(vocabulary, dtype=np.uint64) + np.uint64(1))
    sign = np.where(code >> np.uint64(63), 1.0, -1.0)
    table = np.random.default_rng(7).normal(size=(BUCKETS, DIMS))
    return (sign[:, None] * table[(code % np.uint64(BUCKETS)).astype(np.int64)]).astype(np.float32)


def hilbert_key(points: np.ndarray, bits: int = BITS) -> np.ndarray:
    """Position along the Hilbert curve of integer points (n x dims, each below 2 ** bits), by the bitwise
    transposition method (Skilling 2004), for all points at once."""
    x = points.astype(np.uint64).T.copy()
    dims = len(x)
    q = 1 << (bits - 1)
    while q > 1:
        p, bit = np.uint64(q - 1), np.uint64(q)
        for i in range(dims):
            set_ = (x[i] & bit) != 0
            swap = np.where(set_, np.uint64(0), (x[0] ^ x[i]) & p)
            x[0] ^= np.where(set_, p, swap)
            if i:
                x[i] ^= swap
        q >>= 1
    for i in range(1, dims):
        x[i] ^= x[i - 1]
    fold = np.zeros(x.shape[1], dtype=np.uint64)
    q = 1 << (bits - 1)
    while q > 1:
        fold ^= np.where((x[dims - 1] & np.uint64(q)) != 0, np.uint64(q - 1), np.uint64(0))
        q >>= 1
    x ^= fold
    key = np.zeros(x.shape[1], dtype=np.uint64)
    for b in range(bits - 1, -1, -1):
        for i in range(dims):
            key = (key << np.uint64(1)) | ((x[i] >> np.uint64(b)) & np.uint64(1))
    return key.astype(np.int64)


def curve_keys(ids: list[bytes], table: np.ndarray) -> np.ndarray:
    """Hilbert key of each document from its token ids; a document without tokens lies at the centre."""
    size = np.array([len(i) // 2 for i in ids], dtype=np.int64)
    total = np.zeros((len(ids), DIMS))
    some = np.flatnonzero(size)
    if len(some):
        at = np.concatenate([[0], np.cumsum(size[some])])[:-1]
        total[some] = np.add.reduceat(table[np.frombuffer(b"".join(ids), dtype="<u2")], at, axis=0, dtype=np.float64)
    mean = total / np.maximum(size, 1)[:, None]
    spread = 0.5 + np.arctan(4 * mean) / np.pi
    return hilbert_key(np.minimum((spread * (1 << BITS)).astype(np.int64), (1 << BITS) - 1))


def encoded(df: DataFrame, tokenizer: str, id_col: str, text_col: str) -> DataFrame:
    """(id, key, n_tokens, ids): ids with END_ID after them, as little-endian uint16. A map over the rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, table, end = word_encoder(tokenizer), projection(), np.array([END_ID], dtype="<u2").tobytes()
        for batch in batches:
            for part in slices(batch, "_text", 4 << 20):
                with no_cycles():
                    ids = encoder.encode(part.column("_text").to_pylist())
                yield pa.RecordBatch.from_arrays([
                    part.column("_id"), pa.array(curve_keys(ids, table), pa.int64()), pa.array([len(i) // 2 + 1 for i in ids], pa.int64()),
                    pa.array([i + end for i in ids], pa.binary())], ["_id", "key", "n_tokens", "ids"])

    kind = df.schema[id_col].dataType.simpleString()
    rows = df.select(F.col(id_col).alias("_id"), text_or_empty(text_col).alias("_text"))
    return rows.mapInArrow(run, f"_id {kind}, key long, n_tokens long, ids binary")


def curve_starts(rows: DataFrame) -> DataFrame:
    """(row, start): the position of each row's first token when all rows of (row, key, n_tokens) lie one
    after another in order of (key, row).

    The rows are range-partitioned by both columns, so documents with one key do not meet in one task. Each
    part adds up its own tokens; the parts' totals, one row for each partition, move them to their place."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, at = TaskContext.get().partitionId(), 0
        for batch in batches:
            size = np.asarray(batch.column("n_tokens"))
            start = at + np.cumsum(size) - size
            at += int(size.sum())
            yield pa.RecordBatch.from_arrays(
                [batch.column("row"), pa.array(np.full(len(size), part), pa.int32()), pa.array(start, pa.int64()), batch.column("n_tokens")],
                ["row", "part", "local", "n_tokens"])

    ordered = rows.repartitionByRange("key", "row").sortWithinPartitions("key", "row")
    # written, because the partition numbers must be the same for both readers
    local = written(ordered.mapInArrow(run, "row long, part int, local long, n_tokens long"), "packing-order")
    totals = local.groupBy("part").agg(F.sum("n_tokens").alias("n")).withColumnRenamed("part", "_part")
    # one row for each partition of the range exchange
    earlier = Window.partitionBy(F.lit(0)).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    before = totals.select(F.col("_part").alias("part"), F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("before"))
    return local.join(F.broadcast(before), "part").select("row", (F.col("before") + F.col("local")).alias("start"))


def pack(df: DataFrame, tokenizer: str, length: int = 4096, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Pieces (id, start, length, ids, doc_tokens, sequence_id, offset) of all documents in sequences of
    `length` tokens; only the last sequence of all is shorter.

    Documents are ordered along the Hilbert curve and cut where a sequence is full. A null or empty text is
    its END_ID alone; null ids and repeated rows are packed like others; other columns are not read; an
    empty table gives no pieces. `ids` are little-endian unsigned 32-bit."""
    tokens = encoded(df, tokenizer, id_col, text_col).withColumn("row", F.monotonically_increasing_id())
    tokens = written(tokens, "packing-tokens")
    starts = curve_starts(tokens.select("row", "key", "n_tokens"))
    placed = tokens.drop("key").join(starts.withColumnRenamed("start", "at"), "row")
    kind = df.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [id_col, "start", "length", "ids", "doc_tokens", "sequence_id", "offset"]
        for batch in batches:
            for part in slices(batch, "ids", 2 << 20):
                at, size = np.asarray(part.column("at")), np.asarray(part.column("n_tokens"))
                first, last = at // length, (at + size - 1) // length
                pieces = last - first + 1
                doc = np.repeat(np.arange(len(at)), pieces)
                sequence = np.arange(len(doc)) - np.repeat(np.cumsum(pieces) - pieces, pieces) + first[doc]
                begin = np.maximum(sequence * length, at[doc])
                stop = np.minimum((sequence + 1) * length, (at + size)[doc])
                ids = [np.frombuffer(b.as_buffer(), dtype="<u2").astype("<u4") for b in part.column("ids")]
                cut = [ids[d][a:b].tobytes() for d, a, b in zip(doc.tolist(), (begin - at[doc]).tolist(), (stop - at[doc]).tolist())]
                yield pa.RecordBatch.from_arrays([
                    part.column("_id").take(pa.array(doc)), pa.array(begin - at[doc], pa.int64()), pa.array(stop - begin, pa.int64()), pa.array(cut, pa.binary()),
                    pa.array(size[doc], pa.int64()), pa.array(sequence, pa.int64()), pa.array(begin - sequence * length, pa.int64())], names)

    return placed.mapInArrow(run, f"`{id_col}` {kind}, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long")


def sequences(pieces: DataFrame) -> DataFrame:
    """(sequence_id, ids): the packed sequences themselves; a sequence has at most its length in pieces."""
    parts = F.array_sort(F.collect_list(F.struct("offset", "ids")))
    return pieces.groupBy("sequence_id").agg(parts.alias("parts")).select(
        "sequence_id", F.aggregate("parts", F.lit(b""), lambda s, p: F.concat(s, p["ids"])).alias("ids"))


def with_crc(pieces: DataFrame) -> DataFrame:
    """The pieces with `ids_crc32` (unsigned) in place of their ids."""
    return pieces.withColumn("ids_crc32", F.crc32("ids")).drop("ids")
