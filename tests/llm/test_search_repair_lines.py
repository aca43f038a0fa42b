"""Ranked search, conversation repair and line dedup against brute force."""

import hashlib
import heapq
import itertools
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from tillwise.llm import lines, queries, ranked, repair

CLASH = ["doc", "mark", "pos", "h1", "h2", "slice", "id", "lines", "drops", "conv", "copies", "n", "terms", "counts", "item", "slot", "rank", "score", "first", "times", "place"]
DOCS = "doc_id long, text string"
SPACE = " \t\n\x0b\x0c\r"


def frame(spark, rows, schema):
    df = spark.createDataFrame(rows, schema)
    return df.withColumns({c: F.lit("clash") for c in CLASH if c not in df.columns}).repartition(3)


def collected(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


# --- line dedup -----------------------------------------------------------------------------------------------

def line_cases():
    rng = random.Random(13)
    common = [f"A common line of the licence, number {i}." for i in range(6)]
    rows = [(None, "\n".join(common)), (1, None), (2, ""), (3, "\n\n"), (4, "short\nshort"), (5, "short"), (6, "short")]
    for i in range(7, 60):
        body = []
        for _ in range(rng.randrange(1, 12)):
            line = rng.choice([*common, "own line of document %d, no other has it" % i, "ÄÖÜ läßt Zeilen mit ÄÖÜ stehen", "x" * 19, "y" * 20, ""])
            body.append(rng.choice(["", " ", "\t\r", "\x0b"]) + rng.choice([line, line.lower() if line.isascii() else line, line.upper() if line.isascii() else line]) + rng.choice(["", "  ", "\x0c"]))
        rows.append((i, "\n".join(body)))
    rows += [(60, rows[20][1]), (60, rows[20][1]), (61, rows[21][1]), (61, rows[22][1]), (62, "\n".join(common * 4000)), (63, "only twice, over twenty characters"), (64, "only twice, over twenty characters")]
    return rows


def brute_lines(rows, least=20, least_docs=3):
    def key(line):
        return "".join(c.lower() if c.isascii() else c for c in line.strip(SPACE))

    holders = defaultdict(set)
    for doc, text in rows:
        if doc is not None:
            for line in (text or "").split("\n"):
                holders[key(line)].add(doc)
    out = []
    for doc, text in rows:
        all_ = (text or "").split("\n")
        kept = [x for x in all_ if doc is None or len(key(x)) < least or len(holders[key(x)]) < least_docs or max(holders[key(x)]) == doc]
        out.append((doc, len(all_), len(all_) - len(kept), "\n".join(kept)))
    return sorted(out, key=repr)


@pytest.mark.parametrize("parts", [1, 4096])
def test_lines(spark, monkeypatch, parts):
    """With 1 part no key is hot, with 4096 nearly all are, in slices."""
    monkeypatch.setattr(lines, "SLICES", parts)
    rows = line_cases()
    assert collected(lines.without_common_lines(frame(spark, rows, DOCS))) == brute_lines(rows)
    assert lines.without_common_lines(spark.createDataFrame([], DOCS)).collect() == []


def test_line_bitmaps_are_runs(spark):
    rows = [(1, "a line that all of them have\nown\na line that all of them have\na line that all of them have"), (2, "a line that all of them have"), (3, "A LINE that all of them have ")]
    found = {r.doc: [tuple(d) for d in r.drops] for r in lines.keep_bitmaps(frame(spark, rows, DOCS)).collect()}
    assert found == {1: [(0, 1), (2, 2)], 2: [(0, 1)]}


def test_line_query_is_native(spark):
    df = lines.without_common_lines(frame(spark, line_cases(), DOCS))
    plan = df._jdf.queryExecution().toString()
    assert "InArrow" not in plan and "Python" not in plan


# --- ranked search --------------------------------------------------------------------------------------------

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def terms_of(text):
    return ["".join(c.lower() if c.isascii() else c for c in t) for t in TERM.findall(text or "")]


def brute_search(docs, items, most):
    counted = [(i, Counter(terms_of(t))) for i, t in docs]
    live = [(i, c) for i, c in counted if c]
    n_docs, total = len(live), sum(sum(c.values()) for _, c in live)
    df = Counter(t for _, c in live for t in c)
    wanted = defaultdict(set)
    for item, text in items:
        if item is not None:
            wanted[item] |= set(terms_of(text))
    out = []
    for item, terms in wanted.items():
        scores = []
        for doc, c in live:
            m = 50 + (50 * sum(c.values()) * n_docs) // total
            s = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * ((10**9 * c[t]) // (1000 * c[t] + 20 * m)) for t in terms if c[t])
            if s > 0 and doc is not None:
                scores.append((-s, doc))
        out += [(item, rank, doc, -s) for rank, (s, doc) in enumerate(sorted(scores)[:most], 1)]
    return sorted(out, key=repr)


def search_cases():
    rng = random.Random(11)
    vocabulary = [f"t{i}" for i in range(60)] + ["İstanbul", "ẞ", "naïve"]
    text = lambda n: " ".join(rng.choice(vocabulary[:1 + int(len(vocabulary) * rng.random() ** 2)]) for _ in range(n))
    docs = [(i, text(rng.randrange(1, 60))) for i in range(150)]
    docs += [(200 + i, "t1 t2 t2 same, SAME; t3") for i in range(30)]  # ties
    docs += [(300, None), (301, ""), (302, " .,;!"), (None, "t1 t2 t3"), (303, text(20_000)), (7, "t1 t2"), (7, "t1 t2")]
    items = [(i, text(rng.randrange(1, 25))) for i in range(12)] + [(50, "T2 same"), (51, None), (52, ""), (53, "absent words"), (None, "t1"), (54, "t1"), (54, "t5 t6"), (55, "t0")]
    return docs, items


@pytest.mark.parametrize("settings", [{}, {"POSTINGS": 300, "FIRST_READ": 2, "CELLS": 200, "item_bytes": 300}])
def test_search(spark, monkeypatch, settings):
    """The second setting makes many small blocks of documents and items, and reads lists in small steps."""
    settings = dict(settings)
    size = settings.pop("item_bytes", ranked.ITEM_BYTES)
    for name, value in settings.items():
        monkeypatch.setattr(ranked, name, value)
    docs, items = search_cases()
    found = ranked.ranked_search(frame(spark, docs, DOCS), frame(spark, items, "item_id long, text string"), most=10, item_bytes=size)
    assert found.columns == ["item_id", "rank", "doc_id", "score"]
    assert collected(found) == brute_search(docs, items, 10)


def test_search_of_empty_tables(spark):
    docs, items = search_cases()
    none_docs, none_items = spark.createDataFrame([], DOCS), spark.createDataFrame([], "item_id long, text string")
    assert ranked.ranked_search(none_docs, frame(spark, items, "item_id long, text string")).collect() == []
    assert ranked.ranked_search(frame(spark, docs, DOCS), none_items).collect() == []


def test_bounds_stop_early_and_are_exact(monkeypatch):
    rng = np.random.default_rng(2)
    lists = []
    for _ in range(8):
        rows = rng.permutation(5000)[:3000]
        lists.append((rows, np.sort(rng.integers(1, 50, 3000))[::-1].astype(np.int64)))
    rows = np.arange(10)
    lists = [(np.concatenate([rows, r[r >= 10]]), np.concatenate([np.full(10, 10_000 - 100 * j), s[r >= 10]])) for j, (r, s) in enumerate(lists)]
    whole = np.zeros(5000, dtype=np.int64)
    for r, s in lists:
        whole[r] += s
    reads = []
    monkeypatch.setattr(ranked, "FIRST_READ", 16)

    class Counted(np.ndarray):
        def __getitem__(self, key):
            if isinstance(key, slice):
                reads.append(key)
            return super().__getitem__(key)

    best, scores = ranked.resolve([(r.view(Counted), s) for r, s in lists], 5000, 10, 1)
    assert sorted(best.tolist()) == list(range(10)) and (scores == whole[best]).all()
    assert len(reads) == 8  # ten documents lead every list: one read of each settles them


# --- conversation repair --------------------------------------------------------------------------------------

def damage(conv, turn, role, text):
    role, text = role if role is not None else " ", text if text is not None else " "
    case = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
    if case == 0:
        return []
    if case == 1:
        text = ""
    if case == 2:
        text = re.sub(r"[.!?]", "", text)
    if case == 4:
        role = "user"
    return [(turn, role, text)] * (2 if case == 3 else 1)


def brute_repair(rows):
    """rows (turn, role, text) after damage: cheapest edits by Dijkstra over (row, state), least audit by comparing strings."""
    rows = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), r[2].encode()))
    seen, faults = set(), []
    for _, role, text in rows:
        bare = text.strip(SPACE)
        faults.append("blank" if not bare else "duplicate" if (role, text) in seen else "truncated" if bare[-1] not in ".!?" else None)
        seen.add((role, text))
    legal = {"": "su", "s": "u", "u": "a", "a": "u"}
    heap, done = [(0, "", 0, "", ())], set()
    while heap:
        cost, audit, i, state, turns = heapq.heappop(heap)
        if (i, state) in done:
            continue
        done.add((i, state))
        if i == len(rows) and state in ("", "a"):
            break
        for new in legal[state]:
            if new != "s":
                heapq.heappush(heap, (cost + 5, audit + "I", i, new, turns + (({"u": "user", "a": "assistant"}[new], ""),)))
        if i < len(rows):
            heapq.heappush(heap, (cost + 2, audit + "D", i + 1, state, turns))
            if faults[i] not in ("blank", "duplicate"):
                cut = 5 * (faults[i] == "truncated")
                for new in legal[state]:
                    if rows[i][1][:1] == new:
                        heapq.heappush(heap, (cost + cut, audit + "K", i + 1, new, turns + (rows[i][1:],)))
                    if new != "s":
                        heapq.heappush(heap, (cost + 1 + cut, audit + "R", i + 1, new, turns + (({"u": "user", "a": "assistant"}[new], rows[i][2]),)))
    dated = {t for t, _, _ in rows if t is not None}
    gaps = max(dated) - min(dated) + 1 - len(dated) if dated else 0
    illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in itertools.pairwise(rows))
    kinds = Counter(faults)
    digest = hashlib.sha256("\n".join(f"{r}:{t}" for r, t in turns).encode()).hexdigest()
    return (gaps, kinds["blank"], kinds["duplicate"], kinds["truncated"], illegal, cost, audit, digest)


def conversation_cases():
    rng = random.Random(12)
    texts = ["Yes.", "No!", "Why?", "cut off", "also cut ", "", " \t", None, "Done. \x0c", "Zeile ohne Ende…", "same text."]
    roles = ["user", "assistant", "user", "assistant", "system", "tool", "", None, "supervisor"]
    rows = []
    for conv in range(150):
        for turn in range(rng.randrange(1, 14)):
            rows.append((conv, rng.choice([turn, turn, turn, turn + 3, None]), rng.choice(roles[:2 + 7 * (conv % 2)]), rng.choice(texts)))
    rows += [(None, 0, "user", "Hi."), (None, None, None, None), (900, None, "user", "a."), (901, 5, "user", "x" * 200_000 + ".")]
    rows += [(902, i, "user" if i % 2 == 0 else "assistant", f"turn {i}.") for i in range(3001)] + [(903, 1, "user", "Same.")] * 40
    return rows


def test_repair(spark):
    rows = conversation_cases()
    after = defaultdict(list)
    for conv, *row in rows:
        after[conv] += damage(conv, *row)
    want = sorted(((conv, *brute_repair(found)) for conv, found in after.items() if conv not in (902,)), key=repr)
    table = frame(spark, rows, "conv_id long, turn long, role string, text string")
    found = repair.repair(repair.damaged(table)).collect()
    assert sorted((tuple(r) for r in found if r.conv != 902), key=repr) == want
    long = next(r for r in found if r.conv == 902)
    assert (long.cost, long.audit) == brute_repair(after[902])[5:7]
    none = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert repair.repair(repair.damaged(none)).collect() == []


def test_dropped_conversation_stays(spark):
    conv = next(i for i in range(1000) if zlib.crc32(f"{i}:0".encode()) % 20 == 0)
    found = repair.repair(repair.damaged(spark.createDataFrame([(conv, 0, "user", "Hi.")], "conv_id long, turn long, role string, text string"))).collect()
    assert [tuple(r) for r in found] == [(conv, 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())]


def test_repaired_turns(spark):
    rows = [("c", 0, "system", "Be kind."), ("c", 1, "user", "Hello?"), ("c", 2, "user", "Anyone?"), ("c", 3, "assistant", "Yes.")]
    table = repair.turn_rows(spark.createDataFrame(rows, "c string, t int, r string, x string"), "c", "t", "r", "x", F.lit(1))
    assert collected(repair.repair(table, digests_only=False)) == [("c", 0, "system", "Be kind."), ("c", 1, "user", "Anyone?"), ("c", 2, "assistant", "Yes.")]


def test_block_tables_equal_single_steps():
    rng = random.Random(3)
    for width in (1, 2, 3, 4):
        table = repair.Blocks(width)
        for _ in range(300):
            symbols = bytes(rng.randrange(repair.SYMBOLS) for _ in range(rng.randrange(0, 14)))
            vector = repair.END
            for symbol in reversed(symbols):
                vector = repair.step(vector, symbol)
            assert table.solve(symbols)[0] == vector[repair.NONE]


@pytest.mark.parametrize("name", ["op11_ranked", "op12_repair", "op13_lines"])
def test_queries_on_the_small_tables(spark, name):
    sf_dir = "/root/testdata/sf0.001"
    found = queries.QUERIES[name](spark, sf_dir)
    rows = collected(found)
    if name == "op11_ranked":
        docs = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()]
        items = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").select("item_id", "text").collect()]
        assert rows == brute_search(docs, items, 50)
    elif name == "op13_lines":
        docs = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()]
        assert rows == sorted(((d, n, m, hashlib.sha256(t.encode()).hexdigest()) for d, n, m, t in brute_lines(docs)), key=repr)
    else:
        after = defaultdict(list)
        for conv, *row in spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text").collect():
            after[conv] += damage(conv, *row)
        assert rows == sorted(((c, *brute_repair(r)) for c, r in after.items()), key=repr)
