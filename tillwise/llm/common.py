"""Helpers shared by the training-data operators: shared tables, batches, words and their hashes."""

from __future__ import annotations

import contextlib
import functools
import gc
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: a word is a run of characters other than space and \t \n \v \f \r
WORD_BREAK = r"[\x20\x09-\x0D]+"
#: bytes of text that one numpy step takes at once; a longer text is taken alone and whole
SLICE_BYTES = 1 << 20

_GAP = np.zeros(256, dtype=bool)
_GAP[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_BYTE = np.random.default_rng(20240501).integers(1, 2**63, 256, dtype=np.uint64)
_STEP = np.uint64(0x9E3779B97F4A7C15)


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share, from spark.checkpoint.dir. Where that is unset,
    as in tests, a folder inside the warehouse is set."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        folder = f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/_checkpoints"
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """Write a table to the shared folder and read it back: cuts lineage, so that a lost executor
    costs no more than the tasks that follow."""
    path = new_path(df.sparkSession, name)
    df.write.parquet(path)
    table = df.sparkSession.read.schema(df.schema).parquet(path)
    table.written_path = path
    return table


def forget(*tables: DataFrame) -> None:
    """Delete tables that `written` made and that no later step reads, nor any result in hand."""
    for table in tables:
        spark = table.sparkSession
        where = spark._jvm.org.apache.hadoop.fs.Path(table.written_path)
        where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def session(spark: SparkSession) -> SparkSession:
    """Adaptive execution splits hot join keys; the settings are those that the operators rely on."""
    for key, value in (("spark.sql.adaptive.enabled", "true"), ("spark.sql.adaptive.skewJoin.enabled", "true"),
                       ("spark.sql.adaptive.forceOptimizeSkewedJoin", "true")):
        spark.conf.set(key, value)
    return spark


def text_or_empty(name: str = "text") -> Column:
    return F.coalesce(F.col(name).cast("string"), F.lit(""))


@contextlib.contextmanager
def no_cycles() -> Iterator[None]:
    """Pause the search for reference cycles while a task builds many small lists, which hold none."""
    on = gc.isenabled()
    gc.disable()
    try:
        yield
    finally:
        if on:
            gc.enable()


def slices(batch: pa.RecordBatch, column: str, budget: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut a batch so that `column` holds at most `budget` bytes in a slice, one row at least."""
    sizes = np.asarray(pc.binary_length(batch.column(column)).fill_null(0), dtype=np.int64)
    first, total = 0, 0
    for row, size in enumerate(sizes):
        if row > first and total + size > budget:
            yield batch.slice(first, row - first)
            first, total = row, 0
        total += int(size)
    if first < len(sizes):
        yield batch.slice(first)


class Words:
    """The words of a column of texts as arrays: bytes, start and end of each word, row of each word.
    `gap` marks the bytes that stand between words."""

    def __init__(self, texts: pa.Array, gap: np.ndarray = _GAP):
        texts = texts.cast(pa.large_binary()) if not pa.types.is_large_binary(texts.type) else texts
        texts = texts.fill_null(b"")
        offsets = np.frombuffer(texts.buffers()[1], dtype=np.int64)[texts.offset:texts.offset + len(texts) + 1]
        raw = texts.buffers()[2]
        whole = np.frombuffer(raw, dtype=np.uint8) if raw is not None else np.zeros(0, dtype=np.uint8)
        self.data = whole[offsets[0]:offsets[-1]] if len(offsets) else whole[:0]
        self.bounds = (offsets - offsets[0]) if len(offsets) else np.zeros(1, dtype=np.int64)
        solid = ~gap[self.data]
        before = np.zeros(len(solid), dtype=bool)
        before[1:] = solid[:-1]
        edges = self.bounds[1:-1]
        before[edges[edges < len(solid)]] = False
        after = np.zeros(len(solid), dtype=bool)
        after[:-1] = solid[1:]
        after[edges[edges > 0] - 1] = False
        self.start = np.flatnonzero(solid & ~before)
        self.end = np.flatnonzero(solid & ~after) + 1
        self.row = np.searchsorted(self.bounds, self.start, side="right") - 1
        self.count = np.bincount(self.row, minlength=len(texts)).astype(np.int64)
        self.first = np.concatenate([[0], np.cumsum(self.count)])

    def hashes(self, lower: bool = False) -> np.ndarray:
        """A 64-bit hash of each word's bytes, the same in every task; lower folds A-Z first."""
        if not len(self.start):
            return np.zeros(0, dtype=np.uint64)
        data = self.data
        if lower:
            data = np.where((data >= 65) & (data <= 90), data + 32, data)
        size = self.end - self.start
        at = np.concatenate([[0], np.cumsum(size)])
        inside = np.arange(at[-1]) - np.repeat(at[:-1], size)
        value = _BYTE[data[np.repeat(self.start, size) + inside]]
        value *= powers(int(size.max()))[inside]
        return mix(np.add.reduceat(value, at[:-1]) + size.astype(np.uint64))


    def prefix_hashes(self, size: int) -> tuple[np.ndarray, np.ndarray]:
        """Words of `size` bytes at least, and a hash of their first `size` bytes, A-Z folded."""
        some = np.flatnonzero(self.end - self.start >= size)
        code = np.zeros(len(some), dtype=np.uint64)
        for i in range(size):
            byte = self.data[self.start[some] + i]
            byte = np.where((byte >= 65) & (byte <= 90), byte + 32, byte)
            code = mix(code + _BYTE[byte] + np.uint64(size))
        return some, code


@functools.lru_cache(maxsize=4)
def powers(n: int) -> np.ndarray:
    n = 1 << max(6, (n - 1).bit_length())
    out = np.full(n, np.uint64(0xD6E8FEB86659FD93), dtype=np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


def mix(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finisher: spreads every input bit over the word."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def grams(hashes: np.ndarray, n: int) -> np.ndarray:
    """Hash of the n words from each position on; only whole n-grams, and rows are not minded."""
    size = max(0, len(hashes) - n + 1)
    out = np.zeros(size, dtype=np.uint64)
    for i in range(n):
        out = mix(out * _STEP + hashes[i:i + size] + np.uint64(i + 1))
    return out


def inside_rows(words: Words, n: int) -> np.ndarray:
    """Positions at which n words of one and the same row start."""
    size = max(0, len(words.row) - n + 1)
    return np.flatnonzero(words.row[:size] == words.row[n - 1:n - 1 + size]) if size else np.zeros(0, dtype=np.int64)
