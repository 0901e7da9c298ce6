"""WARC archives: records in segments, written and read back by Spark.

Payloads travel as HTTP messages with chunked transfer framing. Blocks above a segment size are cut into a first
record and continuations that name it. Reading groups the segments by the record they belong to, orders them by
segment number, checks the total length and takes the framing off.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.ordering import number_rows
from ..session import durable

VERSION = "WARC/1.1"
SAME = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
# Records end with this; Spark's text writer puts it behind every row.
RECORD_END = "\r\n\r\n"


@dataclass(frozen=True)
class WarcParams:
    segment_bytes: int = 16_384
    chunk_bytes: int = 4_096
    file_bytes: int = 16_000_000
    date: str = "2024-01-01T00:00:00Z"


def chunked(payload: bytes, size: int) -> bytes:
    parts = [b"%x\r\n%b\r\n" % (len(p), p) for i in range(0, len(payload), size) for p in (payload[i: i + size],)]
    return b"".join([*parts, b"0\r\n\r\n"])


def unchunked(body: bytes) -> bytes:
    """The payload of a chunked body; trailers and chunk extensions are allowed, a cut body is an error."""
    out, at = [], 0
    while True:
        end = body.index(b"\r\n", at)
        size = int(body[at:end].split(b";")[0], 16)
        if size == 0:
            return b"".join(out)
        at = end + 2 + size
        if body[at: at + 2] != b"\r\n":
            raise ValueError("a chunk does not end where its size says")
        out.append(body[end + 2: at])
        at += 2


def base32_digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record_id(page: str, segment: int) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{page}/{segment}')}>"


def record(fields: list[tuple[str, object]], block: bytes) -> bytes:
    head = "".join(f"{k}: {v}\r\n" for k, v in [*fields, ("Content-Length", len(block))])
    return f"{VERSION}\r\n{head}\r\n".encode() + block


def page_name(key: int | None, sha1: str, copy: int = 1) -> str:
    """What the record ids of a row are made of: its key, its payload, and a number among rows that share both."""
    return f"{'' if key is None else key}/{sha1}/{copy}"


def records(key: int | None, copy: int, url: str, payload: bytes, sha1: str, original: int | None, params: WarcParams) -> Iterator[bytes]:
    """The records of one page, without their ends."""
    name, digest = page_name(key, sha1, copy), base64.b32encode(bytes.fromhex(sha1)).decode()
    url = "".join(c if c > " " else f"%{ord(c):02X}" for c in url)
    own = [("WARC-Date", params.date), ("WARC-Target-URI", url), ("WARC-Payload-Digest", f"sha1:{digest}"), *([] if key is None else [("WARC-Page-Key", key)]), ("Content-Type", "application/http;msgtype=response")]
    head = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nTransfer-Encoding: chunked\r\n\r\n"
    if original is not None:
        yield record([("WARC-Type", "revisit"), ("WARC-Record-ID", record_id(name, 1)), ("WARC-Profile", SAME), ("WARC-Refers-To", record_id(page_name(original, sha1), 1)), *own], head)
        return
    block = head + chunked(payload, params.chunk_bytes)
    parts = [block[i: i + params.segment_bytes] for i in range(0, len(block), params.segment_bytes)]
    for n, part in enumerate(parts, 1):
        if n == 1:
            extra = [("WARC-Segment-Number", 1)] if len(parts) > 1 else []
            yield record([("WARC-Type", "response"), ("WARC-Record-ID", record_id(name, 1)), *own, *extra], part)
        else:
            last = [("WARC-Segment-Total-Length", len(block))] if n == len(parts) else []
            yield record([("WARC-Type", "continuation"), ("WARC-Record-ID", record_id(name, n)), ("WARC-Date", params.date), ("WARC-Segment-Number", n), ("WARC-Segment-Origin-ID", record_id(name, 1)), *last], part)


def prepared(pages: DataFrame) -> DataFrame:
    """(key, url, payload, sha1) of every row."""
    payload = F.coalesce(F.col("html").cast("string"), F.lit("")).cast("binary")
    rows = pages.select(F.col("page_id").cast("long").alias("key"), F.coalesce(F.col("url").cast("string"), F.lit("")).alias("url"), payload.alias("payload"))
    return rows.withColumn("sha1", F.sha1("payload"))


def numbered(rows: DataFrame) -> DataFrame:
    """rows with original, the key of the response that a row repeats or null, and copy, counting rows of one key and payload.

    Only sums are gathered per key and payload, and only payloads that repeat are joined back. Rows move a second time
    only where a key repeats with its payload, which is asked first.
    """
    sums = durable(rows.groupBy("sha1", "key").agg(F.count("*").alias("n")))
    again = sums.groupBy("sha1").agg(F.max("key").alias("original"), F.sum("n").alias("all")).filter("all > 1").select("sha1", "original")
    later = F.col("key").isNull() | (F.col("original") > F.col("key"))
    linked = rows.join(again, "sha1", "left").withColumn("original", F.when(later, F.col("original")))
    twice = sums.filter("n > 1").select(F.col("sha1").alias("s"), F.col("key").alias("k"))
    if not twice.limit(1).count():
        return linked.withColumn("copy", F.lit(1).cast("long"))
    same = (F.col("sha1") == F.col("s")) & F.col("key").eqNullSafe(F.col("k"))
    some = linked.join(twice, same, "left_semi").withColumn("at", F.monotonically_increasing_id())
    copies = number_rows(some, ["sha1", "key"], [F.col("url"), F.col("at")], "copy").withColumn("copy", F.col("copy").cast("long")).drop("at")
    return linked.join(twice, same, "left_anti").withColumn("copy", F.lit(1).cast("long")).unionByName(copies)


def write(pages: DataFrame, folder: str, params: WarcParams = WarcParams()) -> None:
    """Writes one record, or its segments, per row of pages (page_id, url, html) to gzip files in folder.

    Of rows with equal payloads the one with the largest page_id is the response; the others are revisits that
    refer to it. Rows that repeat that page_id are responses too, with record ids of their own; revisits refer to the
    first. Records of rows without a page_id have no key; they are revisits where a row with one holds the payload.
    """
    linked = numbered(prepared(pages))

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in zip(*(batch.column(c).to_pylist() for c in ("key", "copy", "url", "payload", "sha1", "original"))):
                yield pa.record_batch([pa.array(list(records(*row, params)), pa.binary())], names=["value"])

    built = linked.mapInArrow(build, "value binary").select(F.col("value").cast("string").alias("value"))
    per_file = max(1, params.file_bytes // (params.segment_bytes + 1024))
    built.write.option("lineSep", RECORD_END).option("compression", "gzip").option("maxRecordsPerFile", per_file).text(folder)


FIELDS = ("WARC-Type", "WARC-Record-ID", "WARC-Segment-Origin-ID", "WARC-Segment-Number", "WARC-Segment-Total-Length", "WARC-Refers-To", "WARC-Payload-Digest", "WARC-Page-Key", "WARC-Target-URI")
NAMES = ("kind", "id", "origin", "segment", "total", "refers", "digest", "key", "url")


def parse(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """Headers and block of every record; a record that its length does not fit is an error."""
    at = 0
    while at < len(data):
        end = data.index(b"\r\n\r\n", at)
        first, *lines = data[at:end].decode().split("\r\n")
        if not first.startswith("WARC/"):
            raise ValueError(f"no record starts at byte {at}")
        fields = dict(line.split(": ", 1) for line in lines)
        at = end + 4 + int(fields["Content-Length"])
        if data[at: at + 4] != RECORD_END.encode():
            raise ValueError("a record does not end where its length says")
        yield fields, data[end + 4: at]
        at += 4


def read_records(spark: SparkSession, folder: str) -> DataFrame:
    """One row per stored record: its named fields and its block. Files are small by construction and read whole."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column("content"):
                rows: list[list] = []
                size = 0
                for fields, block in parse(gzip.decompress(content.as_py())):
                    rows.append([*(fields.get(f) for f in FIELDS), block])
                    size += len(block)
                    if size > 4_000_000:
                        yield batch_of(rows)
                        rows, size = [], 0
                if rows:
                    yield batch_of(rows)

    def batch_of(rows: list[list]) -> pa.RecordBatch:
        columns = list(zip(*rows))
        return pa.record_batch([*(pa.array(c, pa.string()) for c in columns[:-1]), pa.array(columns[-1], pa.binary())], names=[*NAMES, "block"])

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.gz").load(folder).select("content")
    kinds = ", ".join(f"{n} string" for n in NAMES)
    return files.mapInArrow(run, f"{kinds}, block binary").withColumns({"segment": F.col("segment").cast("long"), "total": F.col("total").cast("long"), "key": F.col("key").cast("long")})


def reassembled(stored: DataFrame) -> DataFrame:
    """One row per record with its whole block: records without segments pass, the others meet by origin."""
    whole = stored.filter("segment is null").select("kind", "id", "refers", "digest", "key", "block")
    head = lambda c: F.max(F.when(F.col("segment") == 1, F.col(c))).alias(c)
    parts = stored.filter("segment is not null").groupBy(F.coalesce("origin", "id").alias("id")).agg(
        *(head(c) for c in ("kind", "refers", "digest", "key")), F.max("total").alias("total"), F.max("segment").alias("last"), F.count("*").alias("n"),
        F.array_sort(F.collect_list(F.struct("segment", "block"))).alias("parts"))
    # Joined as strings, whose bytes Spark takes as they are: one copy, whatever the number of segments.
    joined = F.array_join(F.transform("parts", lambda p: p["block"].cast("string")), "").cast("binary")
    parts = parts.withColumn("block", joined)
    checked = F.when((F.length("block") == F.col("total")) & (F.col("last") == F.col("n")), F.col("block")).otherwise(F.raise_error(F.concat(F.lit("segments missing of "), "id")).cast("binary"))
    return whole.unionByName(parts.select("kind", "id", "refers", "digest", "key", checked.alias("block")))


def payloads(messages: DataFrame) -> DataFrame:
    """(kind, id, refers, digest, key, payload_bytes, payload_digest) with the figures of the decoded payload."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, digests = [], []
            for kind, block in zip(batch.column("kind").to_pylist(), batch.column("block")):
                head, _, body = block.as_py().partition(b"\r\n\r\n")
                if kind == "revisit":
                    sizes.append(None)
                    digests.append(None)
                    continue
                payload = unchunked(body) if b"\r\ntransfer-encoding: chunked" in head.lower() else body
                sizes.append(len(payload))
                digests.append(base32_digest(payload))
            kept = [batch.column(c) for c in ("kind", "id", "refers", "digest", "key")]
            yield pa.record_batch([*kept, pa.array(sizes, pa.int64()), pa.array(digests, pa.string())], names=["kind", "id", "refers", "digest", "key", "payload_bytes", "payload_digest"])

    return messages.select("kind", "id", "refers", "digest", "key", "block").mapInArrow(run, "kind string, id string, refers string, digest string, key long, payload_bytes long, payload_digest string")


def read(spark: SparkSession, folder: str) -> DataFrame:
    """(page_id, payload_bytes, payload_digest, record_type, refers_to) of every response and revisit in folder.

    A payload whose digest differs from its header, a missing segment or a wrong length is an error. The figures of the
    records, without their blocks, are stored, so that archives are read once for responses and revisits.
    """
    found = durable(payloads(reassembled(read_records(spark, folder))))
    same = F.concat(F.lit("sha1:"), "payload_digest") == F.col("digest")
    checked = F.when(same, F.col("payload_digest")).otherwise(F.raise_error(F.concat(F.lit("digest differs in "), "id")).cast("string"))
    response = found.filter("kind = 'response'").select("id", F.col("key").alias("page_id"), "payload_bytes", checked.alias("payload_digest"))
    revisit = found.filter("kind = 'revisit'").select(F.col("refers").alias("id"), F.col("key").alias("again"))
    told = revisit.join(response, "id").select(F.col("again").alias("page_id"), "payload_bytes", "payload_digest", F.lit("revisit").alias("record_type"), F.col("page_id").alias("refers_to"))
    return response.select("page_id", "payload_bytes", "payload_digest", F.lit("response").alias("record_type"), F.lit(None).cast("long").alias("refers_to")).union(told)
