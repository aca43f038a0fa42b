"""Quotes against the documents they were taken from.

Evidence goes to its document, not the document to its evidence: the quotes of a document travel in buckets of bounded
size, and a body is read once for all quotes of a bucket, which one automaton finds in one pass."""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tillwise.functions.core import codes
from tillwise.functions.skew import salted_join

#: pieces of evidence that meet one copy of a body
BUCKET = 512
#: from so many quotes on an automaton is built
MANY = 6

_ITEM = "struct<evidence_id:bigint,revision_id:string,quote:string,start:int,end:int,row_text:string>"
_FACTS = [("evidence_id", pa.int64(), "bigint"), ("revision_id", pa.string(), "string"), ("empty", pa.bool_(), "boolean"), ("start", pa.int32(), "int"), ("end", pa.int32(), "int"), ("size", pa.int32(), "int"),
          ("in_range", pa.bool_(), "boolean"), ("same", pa.bool_(), "boolean"), ("same_folded", pa.bool_(), "boolean"), ("folded_found", pa.bool_(), "boolean"), ("first", pa.int32(), "int"), ("times", pa.int32(), "int")]


def fold(text: str) -> str:
    """Composed form (NFKC) with white space folded."""
    return " ".join(unicodedata.normalize("NFKC", text).split())


def occurrences(quotes: set[str], text: str) -> dict[str, tuple[int, int]]:
    """(first position, times up to 2) of the quotes that occur in the text, overlapping ones included."""
    if len(quotes) < MANY:
        found = {}
        for quote in quotes:
            first = text.find(quote)
            if first >= 0:
                found[quote] = (first, 1 if text.find(quote, first + 1) < 0 else 2)
        return found
    automaton = ahocorasick.Automaton()
    for quote in quotes:
        automaton.add_word(quote, quote)
    automaton.make_automaton()
    found = {}
    for end, quote in automaton.iter(text):
        first, times = found.get(quote, (end - len(quote) + 1, 0))
        found[quote] = (first, min(2, times + 1))
    return found


def _facts(body: str, items: list[dict]) -> Iterator[tuple]:
    folded = fold(body)
    raw = occurrences({i["quote"] for i in items if i["quote"]}, body)
    quotes = {i["quote"]: fold(i["quote"]) for i in items if i["quote"]}
    composed = occurrences({q for q in quotes.values() if q}, folded)
    rows = {t: body.find(t) for t in {i["row_text"] for i in items if i["row_text"]}}
    for i in items:
        quote, start, end = i["quote"] or "", i["start"], i["end"]
        shift = rows.get(i["row_text"], -1)
        if shift >= 0 and None not in (start, end) and body[shift + start:shift + end] == quote:
            start, end = shift + start, shift + end
        inside = None not in (start, end) and 0 <= start < end <= len(body)
        piece = body[start:end] if inside else None
        first, times = raw.get(quote, (-1, 0))
        yield (i["evidence_id"], i["revision_id"], quote == "", start, end, len(quote), inside, inside and piece == quote, inside and fold(piece) == quotes.get(quote, ""),
               quote != "" and (quotes[quote] == "" or quotes[quote] in composed), first, times)


def located(evidence: DataFrame, documents: DataFrame, keys: list[str], blank: bool = False) -> DataFrame:
    """What the body of each piece of evidence says about it; `found` is false where there is no body: no document of
    its keys, a null body or, unless `blank`, an empty one.

    evidence(evidence_id, revision_id, quote, start, end, row_text, *keys); documents(*keys, body), one row a key.
    Offsets that hold within row_text are shifted by its place in the body where the shifted piece is the quote."""
    sizes = evidence.groupBy(*keys).agg(F.ceil(F.count("*") / BUCKET).alias("_buckets"))
    # null keys meet no size and no body; their evidence is dealt as thinly as it can be
    dealt = salted_join(evidence, sizes, keys, F.col("evidence_id"), "left")
    dealt = dealt.withColumn("_bucket", F.coalesce(F.pmod(F.xxhash64("evidence_id"), F.col("_buckets")), F.col("evidence_id")))
    item = F.struct(*[F.col(c).cast(t).alias(c) for c, t in (x.split(":") for x in _ITEM[7:-1].split(","))])
    packed = dealt.groupBy(*keys, "_bucket").agg(F.collect_list(item).alias("items"))
    met = packed.join(documents.select(*keys, "body"), keys, "left").select(*keys, "body", "items")
    kinds = {f.name: f.dataType.simpleString() for f in met.schema}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                one = batch.slice(row, 1)
                items = one.column("items")[0].as_py()
                body = one.column("body")[0].as_py()
                there = body is not None and (blank or body != "")
                if there:
                    facts = list(_facts(body, items))
                else:
                    facts = [(i["evidence_id"], i["revision_id"], not i["quote"], i["start"], i["end"], len(i["quote"] or ""), False, False, False, False, -1, 0) for i in items]
                columns = [pa.array(list(values), kind) for values, (_, kind, _) in zip(zip(*facts), _FACTS)]
                names = [name for name, _, _ in _FACTS]
                same = [pa.concat_arrays([one.column(k)] * len(facts)) for k in keys]
                yield pa.RecordBatch.from_arrays([*same, pa.array([there] * len(facts)), *columns], [*keys, "found", *[n if n not in keys else "_" + n for n in names]])

    schema = [f"{k} {kinds[k]}" for k in keys] + ["found boolean"] + [f"`{n if n not in keys else '_' + n}` {t}" for n, _, t in _FACTS]
    return met.mapInArrow(run, ", ".join(schema))


def check_evidence(evidence: DataFrame, documents: DataFrame, blank: bool = False) -> DataFrame:
    """(evidence_id, source_id, revision_id, codes): the quote has to stand at its place, and somewhere, in the very
    revision it was taken from, which has to be stored with access OK; otherwise SOURCE_UNAVAILABLE.

    documents(source_id, revision_id, access_status, body). Quotes and bodies are compared in composed form. A null
    quote is an empty one; offsets may be null; a body that is null or empty is not there. With `blank` an empty body
    is a stored text of no characters, in which no quote stands."""
    there = documents.where("access_status = 'OK'")
    rows = located(evidence, there, ["source_id", "revision_id"], blank)
    stated = F.col("found") & ~F.col("empty")
    found = codes((~F.col("found"), "SOURCE_UNAVAILABLE"), (F.col("found") & F.col("empty"), "EMPTY_QUOTE"), (stated & ~F.col("same_folded"), "OFFSET_MISMATCH"), (stated & ~F.col("folded_found"), "QUOTE_NOT_FOUND"))
    return rows.select("evidence_id", "source_id", "revision_id", found.alias("codes"))


def stored_revisions(documents: DataFrame) -> DataFrame:
    """The newest stored revision of each source, by time of fetch and then by name."""
    newest = documents.groupBy("source_id").agg(F.max(F.struct("fetched_at", "revision_id")).alias("_top"))
    top = newest.select(F.col("source_id").alias("_source"), F.col("_top.revision_id").alias("_revision"))
    return documents.join(top, (F.col("source_id") == F.col("_source")) & (F.col("revision_id") == F.col("_revision"))).drop("_source", "_revision")


def repair_evidence(evidence: DataFrame, documents: DataFrame, blank: bool = False) -> DataFrame:
    """(evidence_id, source_id, start, end, revision_id, code): a wrong offset or revision is bound anew to the stored
    document, the newest of its source, when the quote occurs there exactly once.

    documents(source_id, revision_id, fetched_at, body); an empty body is there only with `blank`."""
    stored = stored_revisions(documents)
    rows = located(evidence, stored, ["source_id"], blank)
    names = stored.select(F.col("source_id").alias("_source"), F.col("revision_id").alias("stored"))
    rows = salted_join(rows.withColumnRenamed("source_id", "_source"), names, ["_source"], F.col("evidence_id"), "left").withColumnRenamed("_source", "source_id")
    unique = ~F.col("empty") & (F.col("times") == 1)
    moved = ~F.col("revision_id").eqNullSafe(F.col("stored"))
    exact = F.col("same")
    code: Column = (
        F.when(~F.col("found"), "POLICY_EVIDENCE_SOURCE_MISSING").when(moved & ~unique, "POLICY_REVISION_MISMATCH").when(~exact & ~F.col("empty") & (F.col("times") == 0), "POLICY_QUOTE_NOT_FOUND")
        .when(~exact & ~unique, "POLICY_OFFSET_AMBIGUOUS").when(~exact, "POLICY_EVIDENCE_OFFSET_REPAIRED").when(moved, "POLICY_REVISION_REBOUND_TO_STORED_SOURCE").otherwise("OK"))
    fixed = F.col("found") & ~exact & unique
    return rows.select("evidence_id", "source_id", F.when(fixed, F.col("first")).otherwise(F.col("start")).alias("start"), F.when(fixed, F.col("first") + F.col("size")).otherwise(F.col("end")).alias("end"),
                       F.when(F.col("found") & moved & unique, F.col("stored")).otherwise(F.col("revision_id")).alias("revision_id"), code.alias("code"))
