"""WARC archives: written with revisits, segments and chunked bodies, and read back.

Writing: of records with equal payloads of at least `revisit_bytes` bytes the
one with the smallest page_id is the response, the others refer to it. The
HTTP block of a response is chunked; a block above `segment_bytes` is cut into
a first record and continuations. Records are rows of Spark's text sink, so
archives are plain WARC files in any store that Spark writes.

Reading: Spark's text source splits archives at the version line, also inside
large files. (The writer puts a chunk boundary into any version mark within a
payload, so that it can't be taken for one.) Records without continuation are
decoded where they are read. The rest are grouped by origin, ordered by
segment number, and their total length is verified before the chunks are
decoded; a task holds one page.

Edge cases: null html is an empty payload; null url an empty one; rows that
repeat the smallest page_id are responses all; a null page_id is a response
only where no row with that payload has an id; other columns are not read, whatever
their names; a very long page is a value of one task; an empty table gives an
empty archive; a missing segment or a wrong length gives complete = false and no
payload.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelforge.llm.common import checked_join, shared_dir, table, written

VERSION = b"WARC/1.1\r\n"
CHUNK = 8192
_MARK = re.compile(rb"WARC/1\.1")
HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nTransfer-Encoding: chunked\r\n\r\n"
SCHEMA = "page_id long, url string, record_type string, refers_to long, payload binary, payload_bytes long, payload_digest string, complete boolean"


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def chunked(payload: bytes) -> bytes:
    """Chunked transfer framing, with a boundary inside each version mark."""
    cuts = sorted({*range(0, len(payload), CHUNK), *(m.start() + 4 for m in _MARK.finditer(payload)), len(payload)})
    out = [b"%x\r\n%b\r\n" % (b - a, payload[a:b]) for a, b in zip(cuts, cuts[1:], strict=False)]
    return b"".join(out) + b"0\r\n\r\n"


def unchunked(body: bytes) -> bytes:
    out, at = [], 0
    while True:
        end = body.index(b"\r\n", at)
        size = int(body[at:end].split(b";")[0], 16)
        if size == 0:
            return b"".join(out)
        out.append(body[end + 2 : end + 2 + size])
        if len(out[-1]) != size or body[end + 2 + size : end + 4 + size] != b"\r\n":
            raise ValueError("broken chunk")
        at = end + 4 + size


def record(fields: list[tuple[str, object]], block: bytes) -> bytes:
    """A record but for the last byte of its ending, which the text sink writes as its line separator."""
    head = b"".join(f"{k}: {re.sub(r'[\x00-\x1f]', ' ', str(v))}\r\n".encode("utf-8", "surrogatepass") for k, v in [*fields, ("Content-Length", len(block))] if v is not None)
    return VERSION + _MARK.sub(b"WARC/1%2E1", head) + b"\r\n" + block + b"\r\n\r"


def page_records(page_id: int | None, url: str, payload: bytes, first: int | None, name: str, segment_bytes: int) -> Iterator[bytes]:
    """The records of one page; first: the page_id that a revisit refers to."""
    own = [("WARC-Record-ID", name), ("WARC-Date", "1970-01-01T00:00:00Z"), ("WARC-Target-URI", url), ("WARC-Payload-Digest", f"sha1:{digest(payload)}"), ("Page-Id", page_id), ("Payload-Length", len(payload))]
    if first is not None:
        yield record([("WARC-Type", "revisit"), *own, ("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"), ("Refers-To-Page-Id", first), ("Content-Type", "application/http;msgtype=response")], HTTP)
        return
    block = HTTP + chunked(payload)
    cuts = range(0, len(block), segment_bytes)
    for n, at in enumerate(cuts, 1):
        piece = block[at : at + segment_bytes]
        segment = [("WARC-Segment-Number", n if len(cuts) > 1 else None), ("WARC-Segment-Origin-ID", name if n > 1 else None), ("WARC-Segment-Total-Length", len(block) if n == len(cuts) > 1 else None)]
        if n == 1:
            yield record([("WARC-Type", "response"), *own, *segment, ("Content-Type", "application/http;msgtype=response")], piece)
        else:
            yield record([("WARC-Type", "continuation"), ("WARC-Record-ID", f"{name[:-1]}-{n}>"), *own[1:3], *segment], piece)


def write_archives(pages: DataFrame, path: str, segment_bytes: int = 32_768, revisit_bytes: int = 0) -> None:
    """Archives of pages (page_id, url, html) in a new folder."""
    payload = F.coalesce(F.col("html"), F.lit("")).cast("binary")
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.coalesce("url", F.lit("")).alias("url"), payload.alias("payload"), F.sha1(payload).alias("hash"))
    again = rows.where(F.octet_length("payload") >= revisit_bytes).groupBy("hash").agg(F.min("page_id").alias("first"), F.count("*").alias("n"))
    again = written(again.where("n > 1 AND first IS NOT NULL").select("hash", "first"), "warc-equal")
    rows = checked_join(rows, again, ["hash"], "left", again.count())
    rows = rows.withColumn("first", F.when(~F.col("page_id").eqNullSafe(F.col("first")), F.col("first")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, part = 0, TaskContext.get().partitionId()
        for b in batches:
            for page_id, url, body, first in zip(*(c.to_pylist() for c in b.columns), strict=True):
                n += 1
                name = f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{path}/{part}/{n}')}>"
                yield pa.RecordBatch.from_arrays([pa.array(list(page_records(page_id, url, body, first, name, segment_bytes)), pa.binary())], ["value"])

    rows.select("page_id", "url", "payload", "first").mapInArrow(run, "value binary").select(F.col("value").cast("string")).write.text(path, lineSep="\n")


def _parsed(raw: bytes) -> tuple[dict[str, str], bytes, bool]:
    head, _, rest = raw.partition(b"\r\n\r\n")
    fields = {}
    for line in head.split(b"\r\n"):
        k, _, v = line.partition(b":")
        fields[k.decode("utf-8", "replace").lower()] = v.strip().decode("utf-8", "replace")
    size = int(fields.get("content-length", -1))
    return fields, rest[:size], len(rest) == size + 4 and rest.endswith(b"\r\n\r\n")


def _page(fields: dict[str, str], block: bytes | None, good: bool) -> dict:
    number = lambda k: int(fields[k]) if k in fields else None
    out = {"page_id": number("page-id"), "url": fields.get("warc-target-uri"), "record_type": fields.get("warc-type"), "refers_to": number("refers-to-page-id"), "payload": None, "payload_bytes": number("payload-length"), "payload_digest": fields.get("warc-payload-digest", "").removeprefix("sha1:"), "complete": good}
    if out["record_type"] == "response":
        body = None
        if good and block is not None:
            head, _, body = block.partition(b"\r\n\r\n")
            try:
                body = unchunked(body) if b"transfer-encoding: chunked" in head.lower() else body
            except ValueError:
                body = None
        found = None if body is None else digest(body)
        good = found is not None and found == out["payload_digest"]
        out |= {"payload": body if good else None, "payload_bytes": len(body) if good else None, "payload_digest": found, "complete": good}
    return out


_ARROW = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("payload", pa.binary()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("complete", pa.bool_())])


def _batches(rows: Iterator[dict], payload: bool = True) -> Iterator[pa.RecordBatch]:
    held, size = [], 0
    for r in rows:
        size += len(r["payload"] or b"")
        held.append(r if payload else r | {"payload": None})
        if size > 4_000_000 or len(held) >= 1000:
            yield pa.RecordBatch.from_pylist(held, schema=_ARROW)
            held, size = [], 0
    if held:
        yield pa.RecordBatch.from_pylist(held, schema=_ARROW)


def read_archives(spark: SparkSession, path: str, payload: bool = True) -> DataFrame:
    """Pages of archives, one row each; payload null for revisits, or altogether if not asked for."""
    raw = spark.read.text(path, lineSep=VERSION.decode()).where(F.length("value") > 0)
    raw = raw.select(F.col("value").cast("binary").alias("value"))
    head = F.substring_index(F.col("value").cast("string"), "\r\n\r\n", 1)
    number = F.regexp_extract(head, r"(?i)(?:^|\r\n)WARC-Segment-Number: *(\d+)", 1)
    origin = F.regexp_extract(head, r"(?i)(?:^|\r\n)WARC-Segment-Origin-ID: *([^\r]*)", 1)
    name = F.regexp_extract(head, r"(?i)(?:^|\r\n)WARC-Record-ID: *([^\r]*)", 1)
    raw = raw.select("value", F.when(number != "", number.cast("long")).alias("segment"), F.when(origin != "", origin).otherwise(name).alias("origin"))

    def single(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from _batches((_page(*_parsed(v)) for b in batches for v in b.column(0).to_pylist()), payload)

    def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        now, fields, blocks, good, total = None, {}, [], True, None

        def page() -> dict:
            block = b"".join(blocks)
            return _page(fields, block, good and total == len(block))

        for b in batches:
            for origin, segment, value in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if origin != now:
                    if fields:
                        yield page()
                    now, fields, blocks, good, total = origin, {}, [], True, None
                own, block, whole = _parsed(value)
                good = good and whole and segment == len(blocks) + 1
                blocks.append(block)
                fields = fields or own
                total = int(own["warc-segment-total-length"]) if "warc-segment-total-length" in own else total
        if fields:
            yield page()

    alone = raw.where("segment IS NULL").select("value").mapInArrow(single, SCHEMA)
    parts = raw.where("segment IS NOT NULL").repartition("origin").sortWithinPartitions("origin", "segment").select("origin", "segment", "value")
    return alone.unionByName(parts.mapInArrow(lambda batches: _batches(joined(batches), payload), SCHEMA))


def op7_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A record for every page, written as archives and read back."""
    path = f"{shared_dir(spark)}/warc-{uuid.uuid4().hex}"
    write_archives(table(spark, sf_dir, "pages"), path)
    return read_archives(spark, path, payload=False).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "complete")


OP7_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS body FROM pages),
f AS (SELECT body, min(page_id) AS first, sha1(encode(body)) AS hex FROM p GROUP BY body),
b AS (SELECT *, array_to_string(list_transform(range(1, 41), lambda i: substr('0000000100100011010001010110011110001001101010111100110111101111', (1 + 4 * ('0x' || substr(hex, i, 1))::INTEGER)::BIGINT, 4)), '') AS bits FROM f),
d AS (SELECT *, array_to_string(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
        1 + 16 * substr(bits, 5 * i + 1, 1)::BIGINT + 8 * substr(bits, 5 * i + 2, 1)::BIGINT + 4 * substr(bits, 5 * i + 3, 1)::BIGINT + 2 * substr(bits, 5 * i + 4, 1)::BIGINT + substr(bits, 5 * i + 5, 1)::BIGINT, 1)), '') AS digest FROM b)
SELECT page_id, strlen(p.body)::BIGINT AS payload_bytes, digest AS payload_digest,
       CASE WHEN page_id IS NOT DISTINCT FROM first THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id IS DISTINCT FROM first THEN first END AS refers_to, true AS complete
FROM p JOIN d ON p.body = d.body
"""
