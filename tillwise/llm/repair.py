"""Conversation repair: cheapest edits to a legal turn order, by Four-Russians block tables over row symbols."""

from __future__ import annotations

import functools
import hashlib
from collections.abc import Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tillwise.llm.common import written

#: a text of these alone is blank; the last character that is none of them tells whether it is cut off
BLANK = " \t\n\x0b\x0c\r"
#: cost of each edit, and of a row that is kept though it is cut off
KEEP, REROLE, DELETE, INSERT, CUT = 0, 1, 2, 5, 5
#: what the last kept turn was: none yet, system, user, assistant; a conversation may end in none or assistant
NONE, SYSTEM, USER, ASSISTANT = range(4)
#: the state after a user or assistant turn is added, by state
NEXT = (USER, USER, ASSISTANT, USER)
#: a row's symbol: 0 has to go; otherwise 1 + initial (s, u, a, other), plus 4 if it is cut off
INITIALS = "sua"
SYMBOLS = 9
FAR = 1 << 20


def kept_state(state: int, symbol: int) -> int | None:
    """The state after the row is kept as it is, or None where the order forbids that."""
    target = (symbol - 1) % 4 + 1
    if not symbol or target > ASSISTANT:
        return None
    return target if target == NEXT[state] or (state, target) == (NONE, SYSTEM) else None


def inserts(cost: list[int]) -> tuple[int, ...]:
    """Costs of the ends where turns may still be inserted; a second look is enough, as two turns lead back."""
    for _ in range(2):
        cost = [min(c, INSERT + cost[NEXT[state]]) for state, c in enumerate(cost)]
    return tuple(cost)


def step(after: tuple[int, ...], symbol: int) -> tuple[int, ...]:
    """From the cost of the rest for each state after a row, that for each state before it."""
    cost = []
    for state in range(4):
        best = DELETE + after[state]
        if symbol:
            cut = CUT * (symbol > 4)
            best = min(best, REROLE + cut + after[NEXT[state]])
            kept = kept_state(state, symbol)
            if kept is not None:
                best = min(best, KEEP + cut + after[kept])
        cost.append(best)
    return inserts(cost)


END = inserts([0, FAR, FAR, 0])


class Blocks:
    """Transitions of normalised cost vectors for every block of `width` symbols.

    A vector less its least entry is one of few; `vectors` lists all that can be reached from the end.
    `ahead[v, code]` is the vector before a block, given the vector v after it, and `cost[v, code]` what its
    least entry gained. Tables of one symbol are put together to those of a block."""

    def __init__(self, width: int = 4):
        self.width, self.vectors, number, moves = width, [], {}, []

        def known(vector: tuple[int, ...]) -> tuple[int, int]:
            low = min(vector)
            vector = tuple(x - low for x in vector)
            if vector not in number:
                number[vector] = len(self.vectors)
                self.vectors.append(vector)
            return number[vector], low

        self.end, self.end_cost = known(END)
        while len(moves) < len(self.vectors):
            moves.append([known(step(self.vectors[len(moves)], s)) for s in range(SYMBOLS)])
        one = np.array(moves, dtype=np.int64)
        self.ahead, self.cost = [None, one[:, :, 0]], [None, one[:, :, 1]]
        for _ in range(1, width):
            # a code is read left to right, so the new symbol stands in front and meets the vector of the rest
            rest, cost = self.ahead[-1], self.cost[-1]
            self.ahead.append(np.stack([one[rest, s, 0] for s in range(SYMBOLS)], axis=1).reshape(len(one), -1))
            self.cost.append(np.stack([cost + one[rest, s, 1] for s in range(SYMBOLS)], axis=1).reshape(len(one), -1))
        self.trace = functools.lru_cache(maxsize=1 << 16)(self._trace)

    def _trace(self, after: int, block: bytes, state: int) -> tuple[str, int]:
        """The cheapest edits of a block entered in `state`, and the state behind it: its vectors are worked out
        backward, then edits taken forward, of equal costs the letter that is first in ASCII (D, I, K, R). Each
        letter leads to one state, so this is the least of all cheapest strings."""
        vectors = [self.vectors[after]]
        for symbol in reversed(block):
            vectors.append(step(vectors[-1], symbol))
        letters = []
        for i, symbol in enumerate(block):
            here, behind = vectors[len(block) - i], vectors[len(block) - i - 1]
            cut, done = CUT * (symbol > 4), False
            while not done:
                kept = kept_state(state, symbol)
                if here[state] == DELETE + behind[state]:
                    letter, done = "D", True
                elif here[state] == INSERT + here[NEXT[state]]:
                    letter, state = "I", NEXT[state]
                elif kept is not None and here[state] == KEEP + cut + behind[kept]:
                    letter, state, done = "K", kept, True
                else:
                    letter, state, done = "R", NEXT[state], True
                letters.append(letter)
        return "".join(letters), state

    def solve(self, symbols: bytes) -> tuple[int, str]:
        """Cost and edits of a conversation: one look-up a block from the end to the start, where the vectors at
        block bounds are kept, then one look-up a block back to the end."""
        n, at, cost = len(symbols), self.end, self.end_cost
        head = n % self.width
        bounds = list(range(head, n, self.width))
        kept = {}
        for start in ([0] if head else []) + bounds:
            kept[start] = None
        for start in reversed(kept):
            block = symbols[start:head if start == 0 and head else start + self.width]
            kept[start] = (at, block)
            code = functools.reduce(lambda c, s: c * SYMBOLS + s, block, 0)
            cost += int(self.cost[len(block)][at, code])
            at = int(self.ahead[len(block)][at, code])
        cost += self.vectors[at][NONE]
        letters, state = [], NONE
        for start in kept:
            text, state = self.trace(*kept[start], state)
            letters.append(text)
        while state in (SYSTEM, USER):
            letters.append("I")
            state = NEXT[state]
        return cost, "".join(letters)


@functools.lru_cache(maxsize=1)
def blocks() -> Blocks:
    return Blocks()


def turn_rows(df: DataFrame, conv_col: str, turn_col: str, role_col: str, text_col: str, copies: Column) -> DataFrame:
    """(conv, turn, role, text, copies): equal rows of a conversation are one row with a count, added up before
    the shuffle. Null roles and texts are one space. Rows with no copies only tell that their conversation is there."""
    blank = F.lit(" ")
    conv = F.col(conv_col).cast("long" if df.schema[conv_col].dataType.typeName() in ("byte", "short", "integer", "long") else "string")
    rows = df.select(conv.alias("conv"), F.col(turn_col).cast("long").alias("turn"), F.coalesce(F.col(role_col).cast("string"), blank).alias("role"),
                     F.coalesce(F.col(text_col).cast("string"), blank).alias("text"), copies.cast("long").alias("copies"))
    return rows.groupBy("conv", "turn", "role", "text").agg(F.sum("copies").alias("copies"))


def with_symbols(rows: DataFrame) -> DataFrame:
    """Adds `initial`, `fault` (blank, duplicate, truncated or null) of the first copy, all further copies being
    duplicates or blank, and `code`, a 128-bit hash of role and text."""
    rows = rows.withColumns({"h1": F.xxhash64("role", "text"), "h2": F.xxhash64(F.lit(1), "role", "text")})
    said = rows.where("copies > 0").groupBy("conv", "h1", "h2").agg(F.count("*").alias("times"), F.count("turn").alias("dated"), F.min("turn").alias("first")).where("times > 1")
    said = said.select(F.col("conv").alias("_conv"), F.col("h1").alias("_h1"), F.col("h2").alias("_h2"), F.when(F.col("times") == F.col("dated"), F.col("first")).alias("first"))
    joined = rows.join(said, rows["conv"].eqNullSafe(said["_conv"]) & (rows["h1"] == said["_h1"]) & (rows["h2"] == said["_h2"]), "left")
    bare = F.rtrim(F.col("text"), F.lit(BLANK))
    again = F.col("_h1").isNotNull() & ~F.col("turn").eqNullSafe(F.col("first"))
    fault = F.when(bare == "", "blank").when(again, "duplicate").when(~F.substring(bare, -1, 1).isin(".", "!", "?"), "truncated")
    return joined.select("conv", "turn", "role", "text", "copies", F.substring("role", 1, 1).alias("initial"), fault.alias("fault"))


COUNTS = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]
LEGAL = {"su", "ua", "au"}


class _Audit:
    """One conversation as its rows stream by: a byte for each row, and counts."""

    def __init__(self):
        self.symbols, self.count, self.last = bytearray(), dict.fromkeys(COUNTS, 0), None
        self.low = self.high = None
        self.turns = 0

    def add(self, turn: int | None, initial: str, fault: str | None, copies: int) -> None:
        if not copies:
            return
        count = self.count
        if turn is not None:
            self.turns += turn != self.high
            self.low, self.high = (turn if self.low is None else self.low), turn
        if self.last is not None:
            count["illegal"] += self.last + initial not in LEGAL
        count["illegal"] += (copies - 1) * (initial + initial not in LEGAL)
        self.last = initial
        if fault:
            count[fault] += 1
        count["blank" if fault == "blank" else "duplicate"] += copies - 1
        kind = INITIALS.index(initial) if initial and initial in INITIALS else 3
        self.symbols.append(0 if fault in ("blank", "duplicate") else 1 + kind + 4 * (fault == "truncated"))
        self.symbols.extend(bytes(copies - 1))

    def result(self) -> dict:
        if self.low is not None:
            self.count["gaps"] = self.high - self.low + 1 - self.turns
        self.count["cost"], audit = blocks().solve(bytes(self.symbols))
        return {**self.count, "audit": audit}


def _grouped(batches: Iterator[pa.RecordBatch], columns: list[str]) -> Iterator[tuple]:
    for batch in batches:
        yield from zip(*(batch.column(c).to_pylist() for c in columns))


def _emit(rows: Iterator[dict], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    held = []
    for row in rows:
        held.append(row)
        if len(held) == 2048:
            yield pa.RecordBatch.from_pylist(held, schema)
            held = []
    if held:
        yield pa.RecordBatch.from_pylist(held, schema)


def audits(symbols: DataFrame) -> DataFrame:
    """(conv, counts, audit): conversations stream through their tasks in turn order and leave one byte a row."""
    kind = symbols.schema["conv"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def each() -> Iterator[dict]:
            for conv, rows in groupby(_grouped(batches, ["conv", "turn", "initial", "fault", "copies"]), key=lambda r: r[0]):
                audit = _Audit()
                for row in rows:
                    audit.add(*row[1:])
                yield {"conv": conv, **audit.result()}

        return _emit(each(), out)

    out = pa.schema([("conv", pa.int64() if kind == "bigint" else pa.string()), *[(c, pa.int64()) for c in COUNTS], ("audit", pa.string())])
    rows = symbols.select("conv", "turn", "role", "text", "initial", "fault", "copies").repartition("conv").sortWithinPartitions("conv", "turn", "role", "text")
    return rows.drop("role", "text").mapInArrow(run, f"conv {kind}, " + ", ".join(f"{c} long" for c in COUNTS) + ", audit string")


def repaired(rows: Iterator[tuple[str, str, int]], audit: str) -> Iterator[tuple[str, str]]:
    """The turns (role, text) that the edits leave of a conversation's rows (role, text, copies)."""
    state, edits = NONE, iter(audit)
    named = {USER: "user", ASSISTANT: "assistant"}
    for role, text, copies in rows:
        for _ in range(copies):
            for edit in edits:
                if edit == "D":
                    break
                if edit == "K":
                    state = INITIALS.index(role[0]) + 1
                    yield role, text
                    break
                state = NEXT[state]
                yield named[state], "" if edit == "I" else text
                if edit == "R":
                    break
    for _ in edits:
        state = NEXT[state]
        yield named[state], ""


def repair(rows: DataFrame, digests_only: bool = True) -> DataFrame:
    """Repairs conversations given as turn_rows: with digests_only one row for each, (conv, gaps, blank,
    duplicate, truncated, illegal, cost, audit, repaired_sha256); otherwise their repaired turns (conv, turn_no, role, text).

    Rows of a conversation are taken by turn (nulls first), then role and text. Nulls of conv are one conversation.
    Texts stream by in that order and only the running hash is held, so the longest conversation takes a byte a row:
    its edits, which are a value of the result. No rows: no edits, no turns. An empty table gives no rows."""
    symbols = written(with_symbols(rows), "repair-symbols")
    found = written(audits(symbols), "repair-audits")
    kind = symbols.schema["conv"].dataType.simpleString()
    conv_type = pa.int64() if kind == "bigint" else pa.string()
    # a conversation's edits stand in front of its rows
    texts = symbols.select("conv", F.lit(1).alias("place"), "turn", "role", "text", "copies", *[F.lit(None).cast("long").alias(c) for c in COUNTS], F.lit(None).cast("string").alias("audit"))
    heads = found.select("conv", F.lit(0).alias("place"), F.lit(None).cast("long").alias("turn"), F.lit("").alias("role"), F.lit("").alias("text"), F.lit(0).cast("long").alias("copies"), *COUNTS, "audit")
    stream = heads.unionByName(texts).repartition("conv").sortWithinPartitions("conv", "place", "turn", "role", "text").drop("place", "turn")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def each() -> Iterator[dict]:
            for conv, rows in groupby(_grouped(batches, ["conv", *COUNTS, "audit", "role", "text", "copies"]), key=lambda r: r[0]):
                head = next(rows)
                turns = repaired((r[-3:] for r in rows), head[7])
                if digests_only:
                    code = hashlib.sha256()
                    for i, (role, text) in enumerate(turns):
                        code.update((("\n" if i else "") + f"{role}:{text}").encode())
                    yield dict(zip(["conv", *COUNTS, "audit"], head)) | {"repaired_sha256": code.hexdigest()}
                else:
                    for i, (role, text) in enumerate(turns):
                        yield {"conv": conv, "turn_no": i, "role": role, "text": text}

        return _emit(each(), out)

    if digests_only:
        out = pa.schema([("conv", conv_type), *[(c, pa.int64()) for c in COUNTS], ("audit", pa.string()), ("repaired_sha256", pa.string())])
        return stream.mapInArrow(run, f"conv {kind}, " + ", ".join(f"{c} long" for c in COUNTS) + ", audit string, repaired_sha256 string")
    out = pa.schema([("conv", conv_type), ("turn_no", pa.int64()), ("role", pa.string()), ("text", pa.string())])
    return stream.mapInArrow(run, f"conv {kind}, turn_no long, role string, text string")


def damaged(df: DataFrame) -> DataFrame:
    """The table conversations with faults put in, as turn_rows: the CRC of `conv_id:turn` (nulls: one space)
    modulo 20 decides whether a row goes (0), loses its text (1) or its full stops (2), comes twice (3) or becomes
    a user's (4)."""
    blank = F.lit(" ")
    case = F.crc32(F.concat(F.coalesce(F.col("conv_id").cast("string"), blank), F.lit(":"), F.coalesce(F.col("turn").cast("string"), blank)).cast("binary")) % 20
    text = F.coalesce(F.col("text"), blank)
    rows = df.select(
        "conv_id", "turn", case.alias("case"), F.when(case == 4, "user").otherwise(F.coalesce("role", blank)).alias("role"),
        F.when(case == 1, "").when(case == 2, F.regexp_replace(text, "[.!?]", "")).otherwise(text).alias("text"))
    return turn_rows(rows, "conv_id", "turn", "role", "text", F.when(F.col("case") == 0, 0).when(F.col("case") == 3, 2).otherwise(1))
