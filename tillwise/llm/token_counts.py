"""Token counts of whole texts by rank-synchronous array merging (see bpe.py)."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tillwise.llm.bpe import word_encoder
from tillwise.llm.common import slices, text_or_empty


def encode_texts(df: DataFrame, id_col: str, text_col: str, tokenizer: str) -> DataFrame:
    """(id, ids): `ids` holds a text's token ids as little-endian uint16. One map over the rows, no shuffle.

    A null text counts as empty and has no ids. Repeated rows stay as they are, other columns are dropped."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = word_encoder(tokenizer)
        for batch in batches:
            for part in slices(batch, "_text", 4 << 20):
                ids = encoder.encode(part.column("_text").to_pylist())
                yield pa.RecordBatch.from_arrays([part.column("_id"), pa.array(ids, pa.binary())], ["_id", "ids"])

    kind = df.schema[id_col].dataType.simpleString()
    got = df.select(F.col(id_col).alias("_id"), text_or_empty(text_col).alias("_text")).mapInArrow(run, f"_id {kind}, ids binary")
    return got.withColumnRenamed("_id", id_col)


def token_counts(df: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", limit: int = 2048) -> DataFrame:
    """(id, n_bytes, n_tokens, over_limit) for every row; `n_bytes` is the text's length in UTF-8.

    Null and empty texts have 0 bytes and 0 tokens; an empty table gives an empty result; rows with the same
    id or text are counted one by one; a null id is kept; columns beyond id and text are not read."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = word_encoder(tokenizer)
        for batch in batches:
            for part in slices(batch, "_text", 4 << 20):
                counts = [len(ids) // 2 for ids in encoder.encode(part.column("_text").to_pylist())]
                yield pa.RecordBatch.from_arrays(
                    [part.column("_id"), part.column("n_bytes"), pa.array(counts, pa.int64())], ["_id", "n_bytes", "n_tokens"])

    kind = df.schema[id_col].dataType.simpleString()
    text = text_or_empty(text_col)
    rows = df.select(F.col(id_col).alias("_id"), F.octet_length(text).cast("long").alias("n_bytes"), text.alias("_text"))
    counted = rows.mapInArrow(run, f"_id {kind}, n_bytes long, n_tokens long")
    return counted.select(F.col("_id").alias(id_col), "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
