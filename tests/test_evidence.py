"""Quotes against documents, beside a plain restatement of the rules."""

import random
import unicodedata

import duckdb
import pytest

from tillwise.operators import evidence as evd
from tillwise.plans.registry import ORACLES, QUERIES

EVIDENCE = "evidence_id bigint, source_id bigint, revision_id string, quote string, start int, end int, row_text string"
DOCUMENTS = "source_id bigint, revision_id string, access_status string, fetched_at int, body string"


def fold(t):
    return " ".join(unicodedata.normalize("NFKC", t).split())


def cases():
    rng = random.Random(21)
    words = ["café", "Grant", "ｇｒａｎｔ", "①", "rate", "2.5 %", "é", "é", "  ", "\n", "지원"]
    body = lambda n: " ".join(rng.choice(words) for _ in range(n))
    documents = []
    for source in range(12):
        text = body(rng.randrange(3, 60))
        documents.append((source, "r1", "OK" if source % 4 else "FAILED", 1, text))
        if source % 3 == 0:
            documents.append((source, "r2", "OK", 2, "New: " + text + body(5)))
    documents += [(20, "r1", "OK", 1, ""), (21, "r1", "OK", 1, None)]
    evidence = []
    for i in range(600):
        source, revision, _, _, text = rng.choice(documents)
        text = text or "none"
        a = rng.randrange(len(text))
        b = rng.randrange(a, min(len(text), a + 30) + 1)
        quote = rng.choice([text[a:b], text[a:b], text[a:b], fold(text[a:b]), "absent", "", None])
        shift = rng.choice([0, 0, 0, 1, -200])
        row = text[a // 2:] if i % 5 == 0 else None
        start = a - a // 2 if row else a
        evidence.append((i, rng.choice([source, source, source, source, 99]), rng.choice([revision, revision, "r1", "r2", "r9", None]), quote, start + shift, start + shift + b - a if i % 11 else None, row))
    return evidence, documents


def moved(row, body):
    _, _, _, quote, start, end, bound = row
    if bound and end is not None:
        at = body.find(bound)
        if at >= 0 and body[at + start:at + end] == (quote or ""):
            return at + start, at + end
    return start, end


@pytest.mark.parametrize("many, bucket", [(6, 512), (1, 7), (10**6, 3)])
def test_check_and_repair(spark, monkeypatch, many, bucket):
    monkeypatch.setattr(evd, "MANY", many)
    monkeypatch.setattr(evd, "BUCKET", bucket)
    evidence, documents = cases()
    ev, docs = spark.createDataFrame(evidence, EVIDENCE).repartition(4), spark.createDataFrame(documents, DOCUMENTS)
    got = {r.evidence_id: r.codes for r in evd.check_evidence(ev, docs).collect()}
    stored = {(s, r): b for s, r, status, _, b in documents if status == "OK" and b}
    want = {}
    for row in evidence:
        i, source, revision, quote, *_ = row
        body = stored.get((source, revision))
        if body is None:
            want[i] = ["SOURCE_UNAVAILABLE"]
        elif not quote:
            want[i] = ["EMPTY_QUOTE"]
        else:
            start, end = moved(row, body)
            good = end is not None and 0 <= start < end <= len(body) and fold(body[start:end]) == fold(quote)
            want[i] = ([] if good else ["OFFSET_MISMATCH"]) + ([] if fold(quote) in fold(body) else ["QUOTE_NOT_FOUND"])
    assert got == want

    newest = {}
    for s, r, _, t, b in documents:
        if s not in newest or t > newest[s][2]:
            newest[s] = (r, b, t)
    for r in evd.repair_evidence(ev, docs).collect():
        row = evidence[r.evidence_id]
        _, source, revision, quote, *_ = row
        name, body, _ = newest.get(source, (None, None, 0))
        if not body:
            assert (r.code, r.start, r.end) == ("POLICY_EVIDENCE_SOURCE_MISSING", row[4], row[5])
            continue
        start, end = moved(row, body)
        quote = quote or ""
        first = body.find(quote)
        unique = bool(quote) and first >= 0 and body.find(quote, first + 1) < 0
        exact = end is not None and 0 <= start < end <= len(body) and body[start:end] == quote
        if revision != name and not unique:
            code = "POLICY_REVISION_MISMATCH"
        elif not exact and not unique:
            code = "POLICY_QUOTE_NOT_FOUND" if first < 0 else "POLICY_OFFSET_AMBIGUOUS"
        else:
            code = "POLICY_EVIDENCE_OFFSET_REPAIRED" if not exact else "POLICY_REVISION_REBOUND_TO_STORED_SOURCE" if revision != name else "OK"
        place = (first, first + len(quote)) if not exact and unique else (start, end)
        assert (r.code, r.start, r.end, r.revision_id) == (code, *place, name if revision != name and unique else revision)


def test_two_revisions_give_one_verdict_each(spark):
    docs = spark.createDataFrame([(1, "r1", "OK", 1, "old words here"), (1, "r2", "OK", 2, "new words here")], DOCUMENTS)
    ev = spark.createDataFrame([(1, 1, "r1", "old words", 0, 9, None), (2, 1, "r2", "old words", 0, 9, None), (3, 1, "r3", "old words", 0, 9, None)], EVIDENCE)
    assert sorted((r.evidence_id, r.codes) for r in evd.check_evidence(ev, docs).collect()) == [(1, []), (2, ["OFFSET_MISMATCH", "QUOTE_NOT_FOUND"]), (3, ["SOURCE_UNAVAILABLE"])]


def test_empty_tables(spark):
    none, docs = spark.createDataFrame([], EVIDENCE), spark.createDataFrame([], DOCUMENTS)
    assert evd.check_evidence(none, docs).count() == 0 and evd.repair_evidence(none, docs).count() == 0


def test_empty_body_is_stored_text_when_asked_for(spark):
    docs = spark.createDataFrame([(1, "r1", "OK", 1, ""), (2, "r1", "OK", 1, None)], DOCUMENTS)
    rows = [(1, 1, "r1", "words", 0, 5, None), (2, 1, "r1", "", 0, 0, None), (3, 1, "r2", "words", 0, 5, None), (4, 2, "r1", "words", 0, 5, None), (5, 1, "r1", None, None, None, "row")]
    ev = spark.createDataFrame(rows, EVIDENCE)
    gone = ["SOURCE_UNAVAILABLE"]
    assert {r.evidence_id: r.codes for r in evd.check_evidence(ev, docs, blank=True).collect()} == {
        1: ["OFFSET_MISMATCH", "QUOTE_NOT_FOUND"], 2: ["EMPTY_QUOTE"], 3: gone, 4: gone, 5: ["EMPTY_QUOTE"]}
    assert {r.evidence_id: (r.code, r.start, r.end, r.revision_id) for r in evd.repair_evidence(ev, docs, blank=True).collect()} == {
        1: ("POLICY_QUOTE_NOT_FOUND", 0, 5, "r1"), 2: ("POLICY_OFFSET_AMBIGUOUS", 0, 0, "r1"), 3: ("POLICY_REVISION_MISMATCH", 0, 5, "r2"),
        4: ("POLICY_EVIDENCE_SOURCE_MISSING", 0, 5, "r1"), 5: ("POLICY_OFFSET_AMBIGUOUS", None, None, "r1")}


@pytest.mark.parametrize("name", ["evidence_check", "evidence_repair", "rejection_shares"])
def test_queries_agree_with_their_sql_on_empty_and_short_texts(spark, tmp_path, name):
    texts = ["", None, " ", "\n", "a", "ab ab ab", "é", "words " * 60, "", "x" * 90]
    spark.createDataFrame([(i, texts[i % 10]) for i in range(200)], "doc_id bigint, text string").coalesce(1).write.parquet(str(tmp_path / "documents.parquet"))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    out = QUERIES[name](spark, str(tmp_path))
    want = con.execute(f"SELECT {', '.join(chr(34) + c + chr(34) for c in out.columns)} FROM ({ORACLES[name]})").fetchall()
    assert sorted(map(repr, map(tuple, out.collect()))) == sorted(map(repr, want))
