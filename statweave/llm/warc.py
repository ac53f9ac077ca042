"""A content-addressed WARC archive.

Payload bytes are stored once, compressed, under their SHA-256. Each record's exact WARC and HTTP headers
are kept beside, with that address. Reading joins headers to payloads, puts the original records together byte
for byte, and reads them as any WARC stream is read: by their headers and lengths, with all digests checked. A
record that doesn't check stops the read.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from statweave.llm.common import attach_group, bound_batches, materialise, sliced_batches

#: Payloads of fewer bytes are always written as responses.
REVISIT_BYTES = 1000
DATE = "2020-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


#: Rows that are left out of the payloads' scan by a broadcast, at most.
BROADCAST_ROWS = 200_000


@dataclass
class Archive:
    """payloads: address, packed. records: rid, address, kind, warc, http."""

    payloads: DataFrame
    records: DataFrame
    total: int


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in sliced_batches(batches, "html"):
        data = [(x or "").encode("utf-8") for x in batch.column("html").to_pylist()]
        arrays = [batch.column("rid"), batch.column("page_id"), batch.column("url"), pa.array([len(x) for x in data], pa.int64()), pa.array([hashlib.sha256(x).digest() for x in data], pa.binary()), pa.array([hashlib.sha1(x).hexdigest() for x in data], pa.string())]
        yield pa.RecordBatch.from_arrays(arrays, names=["rid", "page_id", "url", "size", "address", "sha1"])


def _payloads(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    seen: set[bytes] = set()
    for batch in sliced_batches(batches, "html"):
        rows = {}
        for x in batch.column("html").to_pylist():
            data = (x or "").encode("utf-8")
            address = hashlib.sha256(data).digest()
            if address not in seen:
                seen.add(address)
                rows[address] = zlib.compress(data, 6)
        if len(seen) > 1_000_000:  # the grouping that follows removes what comes again
            seen.clear()
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(list(rows), pa.binary()), pa.array(list(rows.values()), pa.binary())], names=["address", "packed"])


def write_archive(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", revisit_bytes: int = REVISIT_BYTES, hot_groups: int = 1000) -> Archive:
    """Writes one record for each row of pages, the html its payload.

    Of records with equal payloads of at least revisit_bytes, that with the largest id (of repeated rows the
    first) is a response and the others revisit it. Null html is an empty payload, a null id is less than any
    other, a null url is empty; an empty table makes an empty archive; other columns are ignored.
    """
    bound_batches(pages.sparkSession)
    source = pages.select(F.col(f"`{id_col}`").cast("long").alias("page_id"), F.col(f"`{url_col}`").cast("string").alias("url"), F.col(f"`{html_col}`").cast("string").alias("html"))
    source = source.withColumn("rid", F.monotonically_increasing_id())
    rows = source.mapInArrow(_digests, "rid long, page_id long, url string, size long, address binary, sha1 string")
    rows = materialise(rows, "digests")
    total = rows.count()
    best = F.max(F.struct("page_id", F.bitwise_not("rid").alias("row"))).alias("best")
    groups = materialise(rows.groupBy("address").agg(F.count(F.lit(1)).alias("group"), best), "groups")
    known = attach_group(rows, groups, "address", "group", total, hot_groups)
    revisit = (F.col("size") >= revisit_bytes) & (F.bitwise_not("best.row") != F.col("rid"))
    clean = F.regexp_replace(F.coalesce("url", F.lit("")), "[\\r\\n]", "")
    name = lambda c: F.concat(F.lit("<urn:page:"), F.coalesce(c.cast("string"), F.lit("")), F.lit(">"))
    http = F.when(~F.col("revisit"), F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.col("size"), F.lit("\r\n\r\n"))).otherwise("")
    lines = [
        F.lit("WARC/1.1"),
        F.concat(F.lit("WARC-Type: "), F.when(F.col("revisit"), "revisit").otherwise("response")),
        F.concat(F.lit("WARC-Record-ID: "), name(F.col("page_id"))),
        F.lit(f"WARC-Date: {DATE}"),
        F.concat(F.lit("WARC-Target-URI: "), clean),
        F.concat(F.lit("WARC-Payload-Digest: sha1:"), F.col("sha1")),
        F.when(F.col("revisit"), F.concat(F.lit(f"WARC-Profile: {PROFILE}\r\nWARC-Refers-To: "), name(F.col("best.page_id")))),
        F.lit("Content-Type: application/http; msgtype=response"),
        F.concat(F.lit("Content-Length: "), F.when(F.col("revisit"), 0).otherwise(F.octet_length(http) + F.col("size"))),
    ]
    records = known.withColumn("revisit", revisit).select("rid", "address", F.when(F.col("revisit"), "revisit").otherwise("response").alias("kind"), F.concat(F.concat_ws("\r\n", *lines), F.lit("\r\n\r\n")).alias("warc"), http.alias("http"))
    records = materialise(records, "records")
    again = materialise(known.where(F.bitwise_not("best.row") != F.col("rid")).select("rid"), "again")
    return Archive(_stored(source, again, groups.count()), records, total)


def _stored(source: DataFrame, again: DataFrame, distinct: int) -> DataFrame:
    """The payloads, each once. Rows whose payload another row brings are left out of the scan, so that nothing moves,
    if they are few enough for a broadcast. More of them, or a source whose rows have other numbers when it is read
    again, which the number of payloads shows, take a shuffle of the payloads by address."""
    kinds = "address binary, packed binary"
    if again.count() <= BROADCAST_ROWS:
        payloads = materialise(source.join(F.broadcast(again), "rid", "left_anti").select("html").mapInArrow(_payloads, kinds), "payloads")
        held = payloads.agg(F.count(F.lit(1)), F.count_distinct("address")).first()
        if tuple(held) == (distinct, distinct):
            return payloads
    return materialise(source.select("html").mapInArrow(_payloads, kinds).groupBy("address").agg(F.first("packed").alias("packed")), "payloads")


_FIELD = re.compile(r"^([^:\r\n]+): ?(.*?)\r?$", re.MULTILINE)


def parse_header(text: str) -> dict[str, str]:
    if not text.startswith("WARC/1.1\r\n"):
        raise ValueError("not a WARC record")
    return {m[1].lower(): m[2] for m in _FIELD.finditer(text)}


def parse_stream(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """The header fields and the block of each record of a WARC stream."""
    at = 0
    while at < len(data):
        head = data.find(b"\r\n\r\n", at)
        if head < 0:
            raise ValueError("a WARC header without an end")
        field = parse_header(data[at : head + 2].decode("utf-8"))
        at = head + 4 + int(field["content-length"])
        if data[at : at + 4] != b"\r\n\r\n":
            raise ValueError(f"record {field.get('warc-record-id')} has another length than it says")
        yield field, data[head + 4 : at]
        at += 4


def payload_of(field: dict[str, str], block: bytes) -> bytes:
    """The payload of a response, checked against the lengths and the digest in its headers."""
    http, _, data = block.partition(b"\r\n\r\n")
    length = re.search(rb"^Content-Length: (\d+)\r?$", http, re.MULTILINE)
    if length is None or int(length[1]) != len(data) or field["warc-payload-digest"] != f"sha1:{hashlib.sha1(data).hexdigest()}":
        raise ValueError(f"record {field['warc-record-id']} doesn't match its payload")
    return data


def _page(urn: str | None) -> int | None:
    number = (urn or "").removeprefix("<urn:page:").removesuffix(">")
    return int(number) if number else None


def _checked(address: bytes, packed: bytes) -> bytes:
    data = zlib.decompress(packed)
    if hashlib.sha256(data).digest() != address:
        raise ValueError("a stored payload doesn't match its address")
    return data


RECORD = "address binary, page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, record binary"
_KINDS = (pa.binary(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.binary())
_NAMES = [x.split()[0] for x in RECORD.split(", ")]


def _rebuilt(with_bytes: bool):
    """Headers and payloads to records: the record's bytes are put together, and all columns are read from them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced_batches(batches, "packed"):
            out = []
            for address, warc, http, packed in zip(*(batch.column(c).to_pylist() for c in ("address", "warc", "http", "packed")), strict=True):
                record = warc.encode() + http.encode() + _checked(address, packed) + b"\r\n\r\n"
                for field, block in parse_stream(record):
                    data = payload_of(field, block)
                    out.append((address, _page(field["warc-record-id"]), len(data), field["warc-payload-digest"].removeprefix("sha1:"), field["warc-type"], None, record if with_bytes else None))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), _KINDS, strict=True)], names=_NAMES)

    return run


def _revisits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Headers of revisits, with the size and digest that the response's payload was found to have, to records."""
    for batch in batches:
        out = []
        for address, warc, size, sha1 in zip(*(batch.column(c).to_pylist() for c in ("address", "warc", "size", "sha1")), strict=True):
            record = warc.encode() + b"\r\n\r\n"
            for field, block in parse_stream(record):
                if block or field["warc-payload-digest"] != f"sha1:{sha1}":
                    raise ValueError(f"record {field['warc-record-id']} doesn't match its payload")
                out.append((address, _page(field["warc-record-id"]), size, sha1, field["warc-type"], _page(field.get("warc-refers-to")), record))
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), _KINDS, strict=True)], names=_NAMES)


def read_archive(archive: Archive, with_bytes: bool = True) -> DataFrame:
    """Every record, rebuilt and checked: page_id, payload_bytes, payload_digest (SHA-1), record_type,
    refers_to, and record, its original bytes, which without with_bytes are rebuilt and read all the same, but not
    returned for responses.

    Only payloads too short for revisits can serve many responses; the most used of those are broadcast, at
    most a thousand of under REVISIT_BYTES each, so no payload makes a hot key."""
    bound_batches(archive.records.sparkSession)
    responses, revisits = (archive.records.where(F.col("kind") == k) for k in ("response", "revisit"))
    uses = responses.groupBy("address").agg(F.count(F.lit(1)).alias("uses"))
    often = materialise(uses.where(F.col("uses") > max(archive.total // 1000, 1000)).select("address"), "often")
    common = archive.payloads.join(F.broadcast(often), "address", "left_semi")
    marked = responses.join(F.broadcast(common), "address", "left")
    heavy = marked.where("packed is not null")
    light = marked.where("packed is null").drop("packed").join(archive.payloads.join(F.broadcast(often), "address", "left_anti"), "address")
    whole = heavy.unionByName(light).select("address", "warc", "http", "packed")
    read = materialise(whole.mapInArrow(_rebuilt(False), RECORD).drop("record"), "read")
    rebuilt = whole.mapInArrow(_rebuilt(True), RECORD) if with_bytes else read.withColumn("record", F.lit(None).cast("binary"))
    # a payload that is revisited has one response
    needed = revisits.groupBy("address").agg(F.count(F.lit(1)).alias("times"))
    meta = read.select("address", F.col("payload_bytes").alias("size"), F.col("payload_digest").alias("sha1")).join(needed, "address")
    again = attach_group(revisits.select("address", "warc"), materialise(meta, "meta"), "address", "times", archive.total).select("address", "warc", "size", "sha1").mapInArrow(_revisits, RECORD)
    return rebuilt.unionByName(again).drop("address")


def warc_round_trip(pages: DataFrame, **options: object) -> DataFrame:
    """Writes pages to an archive and returns what a checked read of all records' bytes gives, without the bytes."""
    return read_archive(write_archive(pages, **options), with_bytes=False).drop("record")


ORACLE = """
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS payload FROM pages),
     d AS (SELECT page_id, octet_length(payload) AS payload_bytes, sha1(payload) AS payload_digest, max(page_id) OVER (PARTITION BY payload) AS last FROM p)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN payload_bytes >= 1000 AND page_id <> last THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN payload_bytes >= 1000 AND page_id <> last THEN last END AS refers_to
FROM d
"""
