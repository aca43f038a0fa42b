"""Repeated passages by suffix automata of reference shards and matching statistics."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tillwise.llm.common import Words, grams, mix, slices, text_or_empty, written

#: words of a window, and of the anchors inside it
WINDOW, ANCHOR = 13, 5
#: words that one suffix automaton is built from; a longer reference is cut into more shards
SHARD_WORDS = 50_000


class SuffixAutomaton:
    """Suffix automaton over the words of passages; no match runs across the end of a passage."""

    def __init__(self, passages: list[list[bytes]]):
        self.next: list[dict[bytes | int, int]] = [{}]
        self.link, self.length = [-1], [0]
        last = 0
        for number, passage in enumerate(passages):
            for word in passage:
                last = self._extend(last, word)
            last = self._extend(last, number)  # a number is no word: it parts the passages

    def _extend(self, last: int, symbol: bytes | int) -> int:
        nxt, link, length = self.next, self.link, self.length
        new = len(nxt)
        nxt.append({})
        length.append(length[last] + 1)
        link.append(0)
        at = last
        while at >= 0 and symbol not in nxt[at]:
            nxt[at][symbol] = new
            at = link[at]
        if at >= 0:
            to = nxt[at][symbol]
            if length[at] + 1 == length[to]:
                link[new] = to
            else:
                copy = len(nxt)
                nxt.append(dict(nxt[to]))
                length.append(length[at] + 1)
                link.append(link[to])
                link[to] = link[new] = copy
                while at >= 0 and nxt[at].get(symbol) == to:
                    nxt[at][symbol] = copy
                    at = link[at]
        return new

    def matching(self, words: list[bytes]) -> list[int]:
        """For each word, the length of the longest run ending there that occurs in the passages."""
        nxt, link, length = self.next, self.link, self.length
        state = size = 0
        out = []
        for word in words:
            to = nxt[state].get(word)
            while to is None and state:
                state = link[state]
                size = length[state]
                to = nxt[state].get(word)
            if to is not None:
                state, size = to, size + 1
            out.append(size)
        return out


def spans(matched: list[int], least: int) -> list[tuple[int, int]]:
    """Maximal runs of words covered by matches of at least `least` words."""
    out: list[list[int]] = []
    for i, size in enumerate(matched):
        if size >= least:
            if out and i - size + 1 <= out[-1][1]:
                out[-1][1] = i + 1
            else:
                out.append([i - size + 1, i + 1])
    return [(a, b) for a, b in out]


def window_anchors(hashes: np.ndarray, window: int, anchor: int) -> np.ndarray:
    """The anchor of each window of words: the smallest hash among its `anchor`-word runs. It depends on the
    window's words only, so equal windows have equal anchors wherever they stand."""
    code = grams(hashes, anchor)
    size = max(0, len(hashes) - window + 1)
    low = code[:size].copy()
    for i in range(1, window - anchor + 1):
        np.minimum(low, code[i:i + size], out=low)
    return low


def _windows(words: Words, window: int) -> np.ndarray:
    size = max(0, len(words.row) - window + 1)
    return np.flatnonzero(words.row[:size] == words.row[window - 1:window - 1 + size]) if size else np.zeros(0, dtype=np.int64)


def _rows(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return df.select(F.col(id_col).cast("long").alias("id"), text_or_empty(text_col).alias("_text"))


def _anchors(rows: DataFrame, window: int, anchor: int) -> DataFrame:
    """(h, id): the anchors of each text, once for each stretch of windows that share one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "_text"):
                words = Words(part.column("_text"))
                at = _windows(words, window)
                low, row = window_anchors(words.hashes(), window, anchor)[at], words.row[at]
                new = np.ones(len(at), dtype=bool)
                new[1:] = (low[1:] != low[:-1]) | (row[1:] != row[:-1])
                row, low = row[new], low[new]
                order = np.lexsort((low, row))
                row, low = row[order], low[order]
                new = np.ones(len(row), dtype=bool)
                new[1:] = (low[1:] != low[:-1]) | (row[1:] != row[:-1])
                ids = part.column("id").take(pa.array(row[new]))
                yield pa.RecordBatch.from_arrays([pa.array(low[new].view(np.int64)), ids], ["h", "id"])

    return rows.where("id is not null").mapInArrow(run, "h long, id long")


def _passages(routed: DataFrame, window: int, anchor: int, shard_words: int) -> DataFrame:
    """(owner, id, start, words, reference): stretches of windows by the owner of their anchor. Those that a
    text owns itself are its reference shards, one passage a line; the others are to be looked up."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "_text"):
                words = Words(part.column("_text"))
                hashes, at = words.hashes(), _windows(words, window)
                low = window_anchors(hashes, window, anchor)
                row_of = words.row[at]
                data = words.data.tobytes()
                out: list[list] = [[], [], [], [], []]
                for row in range(part.num_rows):
                    me = part.column("id")[row].as_py()
                    known = np.asarray(part.column("hs")[row].values, dtype=np.int64).view(np.uint64)
                    owners = np.asarray(part.column("owners")[row].values, dtype=np.int64)
                    order = np.argsort(known)
                    known, owners = known[order], owners[order]
                    mine = at[np.searchsorted(row_of, row):np.searchsorted(row_of, row + 1)]
                    place = np.minimum(np.searchsorted(known, low[mine]), len(known) - 1)
                    shared = known[place] == low[mine]
                    mine, owner = mine[shared], owners[place[shared]]
                    order = np.lexsort((mine, owner))
                    mine, owner = mine[order], owner[order]
                    cut = np.flatnonzero((owner[1:] != owner[:-1]) | (mine[1:] - mine[:-1] > window)) + 1
                    first, last = mine[np.concatenate([[0], cut])] if len(mine) else mine, mine[np.concatenate([cut - 1, [-1]]).astype(int)] if len(mine) else mine
                    base = words.first[row]
                    own: list[bytes] = []
                    count = 0

                    def put(who: int, begin: int, text: bytes, reference: bool) -> None:
                        for column, value in zip(out, (who, me, begin, text, reference)):
                            column.append(value)

                    for who, a, b in zip(owner[np.concatenate([[0], cut]).astype(int)].tolist() if len(mine) else [], first.tolist(), (last + window).tolist()):
                        if who != me:
                            put(who, a - int(base), b" ".join(data[words.start[a]:words.end[b - 1]].split()), False)
                            continue
                        for begin in range(a, max(a + 1, b - window + 1), shard_words):
                            end = min(b, begin + shard_words + window - 1)
                            if count and count + end - begin > shard_words:
                                put(me, 0, b"\n".join(own), True)
                                own, count = [], 0
                            own.append(b" ".join(data[words.start[begin]:words.end[end - 1]].split()))
                            count += end - begin
                    if own:
                        put(me, 0, b"\n".join(own), True)
                kinds = (pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.bool_())
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, kinds)], ["owner", "id", "start", "words", "reference"])

    return routed.mapInArrow(run, "owner long, id long, start long, words binary, reference boolean")


def _matched(pairs: DataFrame, window: int) -> DataFrame:
    """(id, start, stop, w1, w2): spans found in the owner's shard; and, with codes, windows not found there."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        owner, shard, automaton = None, None, None
        for batch in batches:
            for part in slices(batch, "words"):
                words = Words(part.column("words"))
                hashes = words.hashes()
                w1, w2 = grams(hashes, window), grams(mix(hashes ^ np.uint64(0x5555)), window)
                out: list[list] = [[], [], [], [], []]
                for i, who in enumerate(part.column("owner").to_pylist()):
                    reference = part.column("reference")[i].as_buffer().to_pybytes()
                    if who != owner or reference != shard:
                        owner, shard = who, reference
                        automaton = SuffixAutomaton([line.split(b" ") for line in reference.split(b"\n")])
                    me, start = part.column("id")[i].as_py(), part.column("start")[i].as_py()
                    size = automaton.matching(part.column("words")[i].as_py().split(b" "))
                    for a, b in spans(size, window):
                        for column, value in zip(out, (me, start + a, start + b, None, None)):
                            column.append(value)
                    base = int(words.first[i])
                    for j in range(len(size) - window + 1):
                        if size[j + window - 1] < window:
                            for column, value in zip(out, (me, start + j, start + j + window, int(w1[base + j]), int(w2[base + j]))):
                                column.append(value)
                code = [pa.array(np.array([v or 0 for v in c], dtype=np.uint64).view(np.int64), pa.int64(), mask=np.array([v is None for v in c], dtype=bool)) for c in out[3:]]
                yield pa.RecordBatch.from_arrays([*(pa.array(c, pa.int64()) for c in out[:3]), *code], ["id", "start", "stop", "w1", "w2"])

    return pairs.mapInArrow(run, "id long, start long, stop long, w1 long, w2 long")


def repeated_spans(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, anchor: int = ANCHOR,
                   shard_words: int = SHARD_WORDS) -> DataFrame:
    """(id, start, stop): word spans whose windows of `window` words also start in a text with a smaller id.

    1. Equal texts: only the first is searched further; the others are returned as one span each.
    2. Each window has an anchor, its smallest run of `anchor` words. An anchor that several texts hold is
       owned by the smallest of them.
    3. The windows that a text owns make its reference shards. Windows of later texts are routed to the
       owner's shards only, so the work follows the shared text and not texts x shards: broadcasting each
       shard to all texts would grow with the square of the input.
    4. The task that receives a shard builds its suffix automaton and streams the passages through it;
       matching statistics of `window` words or more are spans.
    5. A routed window that its owner does not hold may still lie in another earlier text that holds the
       anchor. Such windows meet by their 128-bit code, and all but the first text lose them."""
    rows = _rows(df, id_col, text_col)
    codes = rows.where("id is not null").select("id", F.xxhash64("_text").alias("c1"), F.xxhash64(F.lit(1), "_text").alias("c2"))
    firsts = codes.groupBy("c1", F.col("c2").alias("_c2")).agg(F.min("id").alias("first"), F.max("c2").alias("d2"))
    copies = written(codes.join(firsts.drop("_c2"), "c1").where("c2 = d2 and id <> first").select("id"), "substring-copies")

    # worked out twice, as that costs less than to keep one row for about every fifth word on disk
    anchors = _anchors(rows, window, anchor)
    # the second grouping column follows from the first: the join then shuffles both sides anew and adaptive
    # execution can split a hot anchor
    shared = anchors.groupBy("h", F.shiftright("h", 32).alias("_high")).agg(F.min("id").alias("owner"), F.max("id").alias("_last")).where("owner <> _last")
    hits = anchors.join(shared.select("h", "owner"), "h").join(copies, "id", "left_anti")
    by_text = hits.groupBy("id").agg(F.collect_list("h").alias("hs"), F.collect_list("owner").alias("owners"))
    passages = written(_passages(rows.join(by_text, "id"), window, anchor, shard_words), "substring-passages")
    references = passages.where("reference").select("owner", F.col("words").alias("reference"))
    pairs = passages.where("not reference").drop("reference").join(references, "owner")
    found = written(_matched(pairs, window), "substring-matches")
    open_ = found.where("w1 is not null")
    earliest = open_.groupBy("w1", F.col("w2").alias("_w2")).agg(F.min("id").alias("_first"), F.max("w2").alias("_code")).drop("_w2")
    late = open_.join(earliest, "w1").where("w2 = _code and id <> _first")
    whole = copies.select("id", F.lit(0).cast("long").alias("start"), F.lit(2**62).cast("long").alias("stop"))
    return found.where("w1 is null").select("id", "start", "stop").unionByName(late.select("id", "start", "stop")).unionByName(whole)


def _cut(rows: DataFrame, found: DataFrame, window: int, keep_text: bool) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "_text"):
                out: list[list] = [[], [], [], []]
                texts = part.column("_text").to_pylist()
                for text, spans_ in zip(texts, part.column("spans").to_pylist()):
                    words = text.encode().split()
                    gone = np.zeros(len(words) + 1, dtype=np.int64)
                    for s in spans_ or ():
                        if len(words) >= window:
                            gone[s["start"]] += 1
                            gone[min(s["stop"], len(words))] -= 1
                    gone = np.cumsum(gone)[:-1] > 0
                    lost = int(gone.sum())
                    kept = b" ".join([w for w, g in zip(words, gone.tolist()) if not g]) if lost else b" ".join(words)
                    out[0].append(len(words))
                    out[1].append(lost)
                    out[2].append(hashlib.sha256(kept).hexdigest())
                    out[3].append((kept.decode() if lost else text) if keep_text else None)
                yield pa.RecordBatch.from_arrays([
                    part.column("id"), pa.array(out[0], pa.int64()), pa.array(out[1], pa.int64()), pa.array(out[2], pa.string()), pa.array(out[3], pa.string())],
                    ["id", "n_words", "n_removed", "kept_sha256", "kept_text"])

    by_text = found.groupBy("id").agg(F.collect_set(F.struct("start", "stop")).alias("spans"))
    joined = rows.join(by_text, "id", "left").select("id", "_text", "spans")
    return joined.mapInArrow(run, "id long, n_words long, n_removed long, kept_sha256 string, kept_text string")


def remove_repeats(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, keep_text: bool = False) -> DataFrame:
    """(id, n_words, n_removed, kept_sha256[, kept_text]) of every row after each word is removed that a
    repeated window covers. Kept words are joined by one space; a text that loses nothing keeps its form.

    Null and empty texts have no words; null ids lose nothing and are no reference; rows with the same id do
    not count as earlier than one another. An empty table gives no rows; other columns are not read."""
    out = _cut(_rows(df, id_col, text_col), repeated_spans(df, id_col, text_col, window), window, keep_text).withColumnRenamed("id", id_col)
    return out if keep_text else out.drop("kept_text")
