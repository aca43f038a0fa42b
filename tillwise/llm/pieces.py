"""SentencePiece encoding and decoding through a table of distinct chunks."""

from __future__ import annotations

import functools
import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tillwise.llm.common import no_cycles, slices, text_or_empty

#: distinct chunks whose ids a task remembers; beyond, the older half goes, so memory is bounded
TABLE_CHUNKS = 600_000
MARK = "▁"


class PieceTable:
    """Whole-text encoding for a model none of whose pieces holds a white-space marker after another
    character, or a line break beside another one. Such a text falls apart into chunks (markers and what
    follows them, or a line break and what follows it) that segment alone; each distinct chunk is
    segmented once by the library, and a text's ids are its chunks' ids joined by position."""

    def __init__(self, path: str):
        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        pieces = [self.model.id_to_piece(i) for i in range(self.model.get_piece_size())]
        if any(MARK in p.lstrip(MARK) for p in pieces):
            raise ValueError("pieces of this model cross white-space markers")
        if any("\n" in p for p in pieces):
            self.chunk = re.compile(f"{MARK}+[^{MARK}]*|[^{MARK}]+")
        else:
            self.chunk = re.compile(f"{MARK}+[^{MARK}\n]*|\n[^{MARK}\n]*|[^{MARK}\n]+")
        blank = self.model.encode("a")
        self.prefixed = self.model.id_to_piece(blank[0]).startswith(MARK)
        if not self.prefixed or self.model.encode("a  a ") == self.model.encode("a a"):
            raise ValueError("the model must add a leading marker and keep white space as it is")
        self.mark_id = self.model.piece_to_id(MARK)
        self.table: dict[str, tuple[str, str]] = {}
        self.older: dict[str, tuple[str, str]] = {}

    def segment(self, chunks: list[str]) -> list[tuple[str, str]]:
        """Of each chunk as it stands inside a text: its decimal ids joined by commas, and its decoded form.

        The library puts a marker before what it is given: that replaces a chunk's first marker; before a
        line break it stays apart and is cut off. Decoding drops the leading marker, which is put back."""
        marked = [c[1:].replace(MARK, " ") if c[0] == MARK else c for c in chunks]
        found = self.model.encode(marked, num_threads=1)
        ids = [[self.mark_id] if c == MARK else i if c[0] == MARK else i[1:] for c, i in zip(chunks, found)]
        whole = [i if c[0] == MARK else [self.mark_id, *i] for c, i in zip(chunks, ids)]
        back = self.model.decode(whole, num_threads=1)
        return [(",".join(map(str, i)), " " + t if c[0] == MARK else t) for c, i, t in zip(chunks, ids, back)]

    def rows(self, texts: list[str]) -> list[list[tuple[str, str]]]:
        """The table's entries for the chunks of each text, in order."""
        with no_cycles():
            return self._rows(texts)

    def _rows(self, texts: list[str]) -> list[list[tuple[str, str]]]:
        find = self.chunk.findall
        rows = [find(MARK + t.replace(" ", MARK)) if t else [] for t in texts]
        if len(self.table) > TABLE_CHUNKS // 2:
            self.older, self.table = self.table, {}
        fresh = set().union(*rows).difference(self.table)
        known = fresh.intersection(self.older)
        self.table.update(zip(known, map(self.older.__getitem__, known)))
        if new := list(fresh - known):
            self.table.update(zip(new, self.segment(new)))
        get = self.table.__getitem__
        return [list(map(get, row)) for row in rows]

    def encode(self, texts: list[str]) -> list[str]:
        """Decimal ids of each text, joined by commas."""
        return [",".join([ids for ids, _ in row]) for row in self.rows(texts)]


@functools.lru_cache(maxsize=2)
def piece_table(path: str) -> PieceTable:
    return PieceTable(path)


def encode_pieces(df: DataFrame, model: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, ids array<int>) of whole texts; one map, no shuffle. Null and empty texts have no ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = piece_table(model)
        for batch in batches:
            for part in slices(batch, "_text", 4 << 20):
                found = table.encode(part.column("_text").to_pylist())
                ids = pa.array([np.array(i.split(",") if i else [], dtype=np.int32) for i in found], pa.list_(pa.int32()))
                yield pa.RecordBatch.from_arrays([part.column("_id"), ids], ["_id", "ids"])

    kind = df.schema[id_col].dataType.simpleString()
    rows = df.select(F.col(id_col).alias("_id"), text_or_empty(text_col).alias("_text"))
    return rows.mapInArrow(run, f"_id {kind}, ids array<int>").withColumnRenamed("_id", id_col)


def decode_pieces(df: DataFrame, model: str, id_col: str = "doc_id") -> DataFrame:
    """(id, text) of rows (id, ids); null or empty ids give an empty text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = piece_table(model)
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                texts = table.model.decode([x or [] for x in part.column("ids").to_pylist()], num_threads=1)
                yield pa.RecordBatch.from_arrays([part.column("_id"), pa.array(texts, pa.string())], ["_id", "text"])

    kind = df.schema[id_col].dataType.simpleString()
    rows = df.select(F.col(id_col).alias("_id"), F.col("ids").cast("array<int>").alias("ids"))
    return rows.mapInArrow(run, f"_id {kind}, text string").withColumnRenamed("_id", id_col)


def piece_digests(df: DataFrame, model: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encode and decode every row and return (id, n_tokens, ids_sha256, decoded_sha256): the digests of the
    decimal ids joined by commas and of the decoded text in UTF-8.

    Null and empty texts have 0 tokens and the digests of nothing. Rows with the same id or text are
    handled one by one, null ids are kept, other columns are not read, an empty table gives no rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = piece_table(model)
        sha = hashlib.sha256
        for batch in batches:
            for part in slices(batch, "_text", 4 << 20):
                rows = table.rows(part.column("_text").to_pylist())
                ids = [",".join([i for i, _ in row]) for row in rows]
                texts = ["".join([t for _, t in row])[1:] for row in rows]
                yield pa.RecordBatch.from_arrays([
                    part.column("_id"), pa.array([i.count(",") + 1 if i else 0 for i in ids], pa.int64()),
                    pa.array([sha(i.encode()).hexdigest() for i in ids], pa.string()),
                    pa.array([sha(t.encode()).hexdigest() for t in texts], pa.string()),
                ], ["_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    kind = df.schema[id_col].dataType.simpleString()
    rows = df.select(F.col(id_col).alias("_id"), text_or_empty(text_col).alias("_text"))
    made = rows.mapInArrow(run, f"_id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string")
    return made.withColumnRenamed("_id", id_col)
