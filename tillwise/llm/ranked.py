"""Ranked lexical search by NRA: impact-sorted reads with lower and upper score bounds, in blocks of documents."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tillwise.llm.common import Words, slices, text_or_empty, written

#: bytes of item texts that one pass over the documents answers; more items take more passes
ITEM_BYTES = 16 << 20
#: postings that a task holds at once; their lists are made, read and forgotten
POSTINGS = 4_000_000
#: documents x lists whose bounds are kept at once
CELLS = 1 << 23
#: entries of each list that the first read takes; every further read takes twice as many
FIRST_READ = 256
#: parts in which the best documents of all tasks are merged first
SLOTS = 256

# terms are made of 0-9, A-Z, a-z and all bytes of characters beyond ASCII
_GAP = np.zeros(256, dtype=bool)
for _low, _high in ((0x00, 0x2F), (0x3A, 0x40), (0x5B, 0x60), (0x7B, 0x7F)):
    _GAP[_low:_high + 1] = True


def item_terms(items: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(item, term): the distinct terms of each item, as 64-bit hashes of their folded bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                words = Words(part.column("text"), _GAP)
                yield pa.RecordBatch.from_arrays([part.column("item").take(pa.array(words.row)), pa.array(words.hashes(lower=True).view(np.int64))], ["item", "term"])

    rows = items.where(F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("item"), text_or_empty(text_col).alias("text"))
    return rows.mapInArrow(run, "item long, term long").distinct()


def term_counts(docs: DataFrame, id_col: str, text_col: str, vocabulary: np.ndarray) -> DataFrame:
    """(doc, n, terms, counts) of every document with a term: the number of its terms, and those of the sorted
    vocabulary, by index, with how often they occur."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                words = Words(part.column("text"), _GAP)
                code = words.hashes(lower=True).view(np.int64)
                at = np.minimum(np.searchsorted(vocabulary, code), max(len(vocabulary) - 1, 0))
                known = np.flatnonzero(vocabulary[at] == code) if len(vocabulary) else np.zeros(0, dtype=np.int64)
                pair, times = np.unique(words.row[known] * len(vocabulary) + at[known], return_counts=True)
                row = pair // max(len(vocabulary), 1)
                bounds = np.searchsorted(row, np.arange(part.num_rows + 1))
                term, times = (pair - row * len(vocabulary)).astype(np.uint32), times.astype(np.uint32)
                some = np.flatnonzero(words.count)
                yield pa.RecordBatch.from_arrays([
                    part.column("doc").take(pa.array(some)), pa.array(words.count[some]),
                    pa.array([term[bounds[i]:bounds[i + 1]].tobytes() for i in some], pa.binary()),
                    pa.array([times[bounds[i]:bounds[i + 1]].tobytes() for i in some], pa.binary())], ["doc", "n", "terms", "counts"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc"), text_or_empty(text_col).alias("text"))
    return rows.mapInArrow(run, "doc long, n long, terms binary, counts binary")


def document_frequencies(counts: DataFrame, size: int) -> np.ndarray:
    """How many documents hold each term of the vocabulary; a task adds its documents up before the shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size, dtype=np.int64)
        for batch in batches:
            total += np.bincount(np.frombuffer(b"".join(batch.column("terms").to_pylist()), dtype=np.uint32), minlength=size)
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[some])], ["term", "docs"])

    out = np.zeros(size, dtype=np.int64)
    found = counts.select("terms").mapInArrow(run, "term long, docs long").groupBy("term").agg(F.sum("docs").alias("docs")).toArrow()
    out[np.asarray(found.column("term"))] = np.asarray(found.column("docs"))
    return out


def resolve(lists: list[tuple[np.ndarray, np.ndarray]], docs: int, most: int, floor: int) -> tuple[np.ndarray, np.ndarray]:
    """Documents (0 to docs - 1) and scores among which the `most` best are, scores below `floor` left out.

    `lists` holds (document, impact) of each term by falling impact. A document's lower bound is the sum of what
    was read of it; its upper bound adds, for each list in which it was not seen, that list's next impact. Lists
    are read on, side by side, until no document that could reach the `most`-th lower bound has an open interval:
    then membership, ties and scores of the best are final. Nothing is looked up out of turn."""
    lower = np.zeros(docs, dtype=np.int64)
    unseen = np.ones((docs, len(lists)), dtype=np.float64)
    at, size = 0, FIRST_READ
    while True:
        heads = np.zeros(len(lists))
        for j, (rows, impacts) in enumerate(lists):
            read = rows[at:at + size]
            lower[read] += impacts[at:at + size]
            unseen[read, j] = 0.0
            if at + size < len(rows):
                heads[j] = impacts[at + size]
        at, size = at + size, 2 * size
        gap = unseen @ heads  # whole numbers far below 2^53, so exact
        least = max(floor, int(np.partition(lower, docs - most)[docs - most]) if docs >= most else floor)
        if not ((gap > 0) & (lower + gap >= least)).any():
            best = np.flatnonzero(lower >= least)
            return best, lower[best]


class Block:
    """Impact-sorted lists of a bounded number of documents."""

    def __init__(self, n: np.ndarray, terms: np.ndarray, times: np.ndarray, sizes: np.ndarray, total_docs: int, total_terms: int):
        self.docs = len(n)
        row = np.repeat(np.arange(self.docs, dtype=np.int64), sizes)
        length = 100 - 50 + (50 * n.astype(np.int64) * total_docs) // total_terms
        tf = times.astype(np.int64)
        part = (1_000_000_000 * tf) // (1000 * tf + 20 * length[row])  # below 2^20
        key = (terms.astype(np.int64) << 20) | ((1 << 20) - 1 - part)
        order = np.argsort(key, kind="stable")
        self.row, self.part = row[order], part[order]
        self.term, self.first = np.unique(key[order] >> 20, return_index=True)
        self.end = np.append(self.first[1:], len(order))

    def best(self, terms: np.ndarray, weight: np.ndarray, most: int, floor: int) -> tuple[np.ndarray, np.ndarray]:
        at = np.searchsorted(self.term, terms)
        here = np.flatnonzero((at < len(self.term)) & (self.term[np.minimum(at, len(self.term) - 1)] == terms) & (weight[terms] > 0)) if len(self.term) else []
        lists = [(self.row[self.first[at[i]]:self.end[at[i]]], self.part[self.first[at[i]]:self.end[at[i]]] * weight[terms[i]]) for i in here]
        if not lists:
            return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
        step = max(1, CELLS // len(lists))
        if step >= self.docs:
            return resolve(lists, self.docs, most, floor)
        rows, scores = [], []
        for low in range(0, self.docs, step):
            inside = [(rows_ >= low) & (rows_ < low + step) for rows_, _ in lists]
            found = resolve([(r[k] - low, s[k]) for (r, s), k in zip(lists, inside)], min(step, self.docs - low), most, floor)
            rows.append(found[0] + low)
            scores.append(found[1])
        return np.concatenate(rows), np.concatenate(scores)


def _task_best(counts: DataFrame, items: dict[int, np.ndarray], weight: np.ndarray, total_docs: int, total_terms: int, most: int) -> DataFrame:
    """(item, doc, score): the `most` best documents of each task's share for each item."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        held: list[pa.RecordBatch] = []
        postings = 0

        def settle() -> None:
            table = pa.Table.from_batches(held)
            raw = [table.column(c).to_pylist() for c in ("terms", "counts")]
            sizes = np.array([len(t) // 4 for t in raw[0]], dtype=np.int64)
            terms, times = (np.frombuffer(b"".join(r), dtype=np.uint32) for r in raw)
            ids = np.asarray(table.column("doc"))
            block = Block(np.asarray(table.column("n")), terms, times, sizes, total_docs, total_terms)
            for item, wanted in items.items():
                old = best.get(item)
                floor = int(old[1][-1]) if old is not None and len(old[1]) == most else 1
                rows, scores = block.best(wanted, weight, most, floor)
                if len(rows):
                    ids_, scores = (ids[rows], scores) if old is None else (np.concatenate([old[0], ids[rows]]), np.concatenate([old[1], scores]))
                    order = np.lexsort((ids_, -scores))[:most]
                    best[item] = ids_[order], scores[order]

        for batch in batches:
            held.append(batch)
            postings += sum(len(t) // 4 for t in batch.column("terms").to_pylist())
            if postings >= POSTINGS:
                settle()
                held, postings = [], 0
        if postings:
            settle()
        for item, (ids, scores) in best.items():
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(ids), item)), pa.array(ids), pa.array(scores)], ["item", "doc", "score"])

    return counts.where("doc is not null").select("doc", "n", "terms", "counts").mapInArrow(run, "item long, doc long, score long")


def _ranked(found: DataFrame, keys: list[str], most: int) -> DataFrame:
    order = Window.partitionBy(*keys).orderBy(F.desc("score"), "doc")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= most)


def _block_of_items(docs: DataFrame, id_col: str, text_col: str, terms: DataFrame, most: int) -> DataFrame:
    """The best documents for items of bounded size, whose terms travel to every task."""
    pairs = terms.toArrow()
    vocabulary = np.unique(np.asarray(pairs.column("term"), dtype=np.int64))
    at = np.searchsorted(vocabulary, np.asarray(pairs.column("term"), dtype=np.int64))
    item = np.asarray(pairs.column("item"), dtype=np.int64)
    order = np.lexsort((at, item))
    names, first = np.unique(item[order], return_index=True)
    wanted = dict(zip(names.tolist(), np.split(at[order], first[1:])))
    counts = written(term_counts(docs, id_col, text_col, vocabulary), "ranked-counts")
    n, total = counts.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
    docs_with = document_frequencies(counts, len(vocabulary))
    weight = np.array([math.floor(1000 * math.log((2 * n + 2) / (2 * d + 1))) for d in docs_with.tolist()], dtype=np.int64)
    return written(_task_best(counts, wanted, weight, n, max(total, 1), most), "ranked-best")


def ranked_search(docs: DataFrame, items: DataFrame, most: int = 50, id_col: str = "doc_id", text_col: str = "text",
                  item_col: str = "item_id", item_text_col: str = "text", item_bytes: int = ITEM_BYTES) -> DataFrame:
    """(item, rank, doc, score): the `most` highest-scoring documents of each item with a score above 0, equal
    scores by ascending id.

    Terms are runs of ASCII letters, digits and characters beyond ASCII, only A-Z folded. With N documents that have
    a term, L terms in all of them, n in one, a term's weight is floor(1000 ln((2N + 2) / (2df + 1))) and it adds
    weight * (10^9 tf div (1000 tf + 20 m)), where m = 50 + 50 n N div L. All but the weight is whole numbers.

    Every task reads its own documents' lists by NRA (see resolve) and returns at most `most` documents an item;
    these are merged in two steps. Items are answered in blocks of about `item_bytes` of text, one pass over the
    documents each, so what travels to the tasks is bounded. Terms are compared by a 64-bit hash.

    Null texts have no terms. Documents without an id count in N, L and df but are not ranked; rows that share an id
    are ranked each by itself. Items without an id are left out; rows of one item id are one item with all their
    terms. Items without terms, and empty tables, give no rows. Other columns are not read."""
    size = items.agg(F.coalesce(F.sum(F.octet_length(text_or_empty(item_text_col))), F.lit(0))).first()[0]
    number = max(1, -(-int(size) // item_bytes))
    terms = written(item_terms(items, item_col, item_text_col), "ranked-items")
    found = None
    for block in range(number):
        here = _block_of_items(docs, id_col, text_col, terms.where(F.pmod(F.xxhash64("item"), F.lit(number)) == block), most)
        found = here if found is None else found.unionByName(here)
    few = _ranked(found.withColumn("slot", F.pmod(F.xxhash64("doc"), F.lit(SLOTS))), ["item", "slot"], most)
    return _ranked(few.drop("slot", "rank"), ["item"], most).select(F.col("item").alias(item_col), "rank", F.col("doc").alias(id_col), "score")
