"""WARC archives without repeated payloads: revisit records are resolved by payload digest."""

from __future__ import annotations

import hashlib
import re
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: fixed values of the format
VERSION = "WARC/1.1"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
END = "\r\n\r\n"
#: payload bytes that one archive is to hold, before compression
ARCHIVE_BYTES = 16 << 20
#: payloads below this size are not worth a revisit record
LEAST_BYTES = 1000


def payload_headers(pages: DataFrame, id_col: str, uri_col: str, payload_col: str) -> DataFrame:
    """(id, uri, digest, bytes) of each row's payload in UTF-8; a null payload is empty. A map over the rows."""
    payload = F.coalesce(F.col(payload_col).cast("string"), F.lit(""))
    return pages.select(F.col(id_col).alias("id"), F.col(uri_col).cast("string").alias("uri"), F.sha1(payload.cast("binary")).alias("digest"),
                        F.octet_length(payload).cast("long").alias("bytes"))


def resolve(headers: DataFrame, least_bytes: int = LEAST_BYTES) -> DataFrame:
    """(id, digest, refers_to, refers_uri): the record that each header revisits, null for responses.

    Only headers are shuffled. Of equal payloads of at least `least_bytes` bytes, that with the largest id is
    the response. Originals are grouped by digest and size, of which the first decides the second: so the
    join shuffles both sides anew and adaptive execution can split a payload that a third of the rows share.
    Rows with one and the same id and payload are one record; a null id revisits the largest that is known."""
    large = headers.where(F.col("bytes") >= least_bytes)
    originals = large.groupBy("digest", "bytes").agg(F.max("id").alias("original"), F.max_by("uri", "id").alias("original_uri"), F.count("*").alias("n"))
    originals = originals.where(F.col("n") > 1).select(F.col("digest").alias("_digest"), F.col("bytes").alias("_bytes"), "original", "original_uri")
    found = headers.join(originals, (F.col("digest") == F.col("_digest")) & (F.col("bytes") >= least_bytes), "left")
    other = F.col("original").isNotNull() & ~F.col("original").eqNullSafe(F.col("id"))
    return found.select("id", "digest", F.when(other, F.col("original")).alias("refers_to"), F.when(other, F.col("original_uri")).alias("refers_uri")).distinct()


def _record_id(key: Column, digest: Column) -> Column:
    code = F.md5(F.concat_ws(":", F.lit("record"), key.cast("string"), digest))
    return F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", *[F.substring(code, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))]), F.lit(">"))


def _field(name: str, value: Column) -> Column:
    """A header line; line breaks in a value would end it and become spaces. Null: no line."""
    return F.concat(F.lit(f"{name}: "), F.regexp_replace(value.cast("string"), "[\r\n]+", " "))


def write_archives(pages: DataFrame, path: str, id_col: str, uri_col: str, payload_col: str, least_bytes: int = LEAST_BYTES,
                   archive_bytes: int = ARCHIVE_BYTES) -> None:
    """Write one WARC record for each row of `pages` as gzip archives in the folder `path`: a response with
    its payload, or a revisit without one that names the response with an equal payload.

    The number of archives follows the payload bytes, so that none grows with the input. Spark's text writer
    commits whole files, so a lost task leaves no half archive; its line separator ends each record."""
    headers = payload_headers(pages, id_col, uri_col, payload_col)
    total = headers.agg(F.sum("bytes")).first()[0] or 0
    archives = int(total // archive_bytes) + 1
    plan = resolve(headers, least_bytes).select(F.col("id").alias("_id"), F.col("digest").alias("_digest"), "refers_to", "refers_uri")
    payload = F.coalesce(F.col(payload_col).cast("string"), F.lit(""))
    rows = pages.select(F.col(id_col).alias("id"), F.col(uri_col).cast("string").alias("uri"), payload.alias("payload"))
    rows = rows.withColumn("digest", F.sha1(F.col("payload").cast("binary")))
    # a null id takes part as a key of its own
    left = rows.withColumn("_key", F.concat_ws(":", "digest", F.col("id").cast("string"))).repartition(archives, "_key")
    right = plan.withColumn("_key", F.concat_ws(":", "_digest", F.col("_id").cast("string"))).drop("_id", "_digest").repartition(archives, "_key")
    rows = left.join(right, "_key", "left")
    revisit = F.col("refers_to").isNotNull()
    size = F.octet_length("payload")
    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), size.cast("string"), F.lit(END))
    block = F.when(revisit, http).otherwise(F.concat(http, "payload"))
    record = F.concat_ws(
        "\r\n", F.lit(VERSION), _field("WARC-Type", F.when(revisit, "revisit").otherwise("response")),
        _field("WARC-Record-ID", _record_id(F.col("id"), F.col("digest"))),
        _field("WARC-Date", F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss'Z'")), _field("WARC-Target-URI", F.col("uri")),
        _field("Content-Type", F.lit("application/http; msgtype=response")), _field("WARC-Payload-Digest", F.concat(F.lit("sha1:"), "digest")),
        F.when(revisit, _field("WARC-Profile", F.lit(PROFILE))), F.when(revisit, _field("WARC-Refers-To", _record_id(F.col("refers_to"), F.col("digest")))),
        F.when(revisit, _field("WARC-Refers-To-Target-URI", F.col("refers_uri"))), _field("X-Key", F.col("id")),
        F.when(revisit, _field("X-Refers-To-Key", F.col("refers_to"))), _field("X-Payload-Length", size),
        _field("Content-Length", F.octet_length("_block")))
    done = rows.withColumn("_block", block).select(F.concat(record, F.lit(END), "_block").alias("value"))
    done.write.option("lineSep", END).option("compression", "gzip").text(path)


_HEADER = re.compile(rb"([^:\r\n]+): ?([^\r\n]*)")


def parse_archive(data: bytes) -> Iterator[dict[str, str | bytes]]:
    """Records of an unpacked archive: header fields by lower-case name, and `payload` for responses."""
    at = 0
    while at < len(data):
        if not data.startswith(VERSION.encode(), at):
            raise ValueError(f"no record at byte {at}")
        head = data.index(b"\r\n\r\n", at)
        fields: dict[str, str | bytes] = {k.decode().lower(): v.decode() for k, v in _HEADER.findall(data, at + len(VERSION), head)}
        end = head + 4 + int(fields["content-length"])
        if fields["warc-type"] == "response":
            body = data.index(b"\r\n\r\n", head + 4) + 4
            fields["payload"] = data[body:end]
        if data[end:end + 4] != b"\r\n\r\n":
            raise ValueError(f"the record at byte {at} does not end where its length says")
        at = end + 4
        yield fields


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """(id, payload_bytes, payload_digest, record_type, refers_to, uri) of each record in the archives.
    The digest of every stored payload is computed again and must agree with its header."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["id", "payload_bytes", "payload_digest", "record_type", "refers_to", "uri"]
        kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string()]
        for batch in batches:
            for value in batch.column("content"):
                rows = []
                packed = value.as_buffer()
                for f in parse_archive(zlib.decompress(packed, 31) if packed.size else b""):
                    digest, size = f["warc-payload-digest"].removeprefix("sha1:"), int(f["x-payload-length"])
                    if "payload" in f and (len(f["payload"]) != size or hashlib.sha1(f["payload"]).hexdigest() != digest):
                        raise ValueError(f"payload of {f['warc-record-id']} does not agree with its header")
                    key, to = f.get("x-key"), f.get("x-refers-to-key")
                    rows.append((int(key) if key else None, size, digest, f["warc-type"], int(to) if to else None, f.get("warc-target-uri")))
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows) if rows else [[]] * 6, kinds)], names)

    files = spark.read.format("binaryFile").load(path).select("content")
    return files.mapInArrow(run, "id long, payload_bytes long, payload_digest string, record_type string, refers_to long, uri string")
