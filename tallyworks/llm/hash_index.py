"""Exact copies by an extendible-hash index on shared files.

Log. Every task normalises its texts, compares equal ones among themselves byte by byte, and writes one small row per
document; the row that opens an entry also carries its code and bytes. A text that a third of all rows hold thus enters
the index once per task and buffer, not once per row.

Directory. The first bits of a code choose a bucket. All cells (the finest slots) start in few buckets; a bucket that
holds too much is split by its next bit, which doubles the directory where the bucket already has all its bits. The
directory has at most 2^CELL_BITS cells whatever the table, as buckets may hold more in larger tables. A single code
that alone holds more than a bucket can't be split by bits: its chain is cut into pages, each reduced by itself to one
entry per different text, and what is left goes into the next round.

Owners. A task owns one bucket, a range of keys, or one page. It reads the entries in order of their codes, chains
those of one code and compares their bytes; codes only choose who is compared, so codes that collide are harmless. In
memory it holds the different texts of one code. Documents meet again only as sums.

Null texts count as empty. The longest original stays, then the smallest doc_id; a missing doc_id comes last, and of
rows that still tie the first one stored stays. Every row is answered, repeated rows too, one row of a group being kept.
Groups of rows without any doc_id have a null keep_id. An empty table gives no rows. Other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import durable
from .common import SPACES, release

CELL_BITS = 16
DROPPED = SPACES.encode()
ENTRY_BYTES = 64


def sha_code(digest: bytes) -> int:
    return int.from_bytes(digest[:8], "big", signed=True)


@dataclass(frozen=True)
class IndexParams:
    bucket_bytes: int = 8_000_000
    # Texts a task holds to compare with later ones; beyond it the next copy opens an entry of its own.
    buffer_bytes: int = 16_000_000
    code: Callable[[bytes], int] = sha_code


def code_points(text: bytes) -> int:
    """Code points of UTF-8 bytes: all bytes but continuations."""
    return len(text) if text.isascii() else int(np.count_nonzero((np.frombuffer(text, np.uint8) & 0xC0) != 0x80))


LOG = "doc_id long, size long, row long, entry long, code long, digest binary, body binary"
LOG_TYPES = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.binary())


def log(docs: DataFrame, params: IndexParams) -> DataFrame:
    """(doc_id, size, row, entry) of every document, and (code, digest, body) on the row that opens its entry.

    row is a number of its own for each row; an entry has the number of the row that opens it.
    """
    text = F.col("text").cast("string").cast("binary")
    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"), F.monotonically_increasing_id().alias("row"))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        opened: dict[bytes, list[tuple[bytes, int]]] = {}
        held = 0
        rows: list[tuple] = []
        waiting = 0

        def flush() -> pa.RecordBatch:
            columns = [pa.array(c, t) for c, t in zip(zip(*rows), LOG_TYPES)]
            return pa.record_batch(columns, names=["doc_id", "size", "row", "entry", "code", "digest", "body"])

        for batch in batches:
            for doc_id, raw, row in zip(batch.column("doc_id").to_pylist(), batch.column("text"), batch.column("row").to_pylist()):
                original = raw.as_py() or b""
                body = original.translate(None, DROPPED)
                digest = hashlib.sha256(body).digest()
                chain = opened.setdefault(digest, [])
                known = next((e for same, e in chain if same == body), None)
                if known is None:
                    chain.append((body, row))
                    held += len(body) + ENTRY_BYTES
                    waiting += len(body)
                    rows.append((doc_id, code_points(original), row, row, params.code(digest), digest, body))
                else:
                    rows.append((doc_id, code_points(original), row, known, None, None, None))
                if held > params.buffer_bytes:
                    opened, held = {}, 0
                if waiting > params.buffer_bytes // 4 or len(rows) >= 4096:
                    yield flush()
                    rows, waiting = [], 0
        if rows:
            yield flush()
        release()

    return slim.mapInArrow(read, LOG)


@dataclass(frozen=True)
class Directory:
    """Where codes are owned: (cell, owner) of cells, (code, first owner, pages) of codes that are pages."""

    cells: DataFrame
    heavy: DataFrame
    owners: int
    pages: int


def cell(code: str = "code"):
    return F.expr(f"shiftrightunsigned({code}, {64 - CELL_BITS})")


def directory(entries: DataFrame, params: IndexParams) -> Directory:
    """The directory over entries (code, body), doubled until no bucket that can be split holds too much."""
    codes = durable(entries.groupBy("code").agg(F.sum(F.octet_length("body") + ENTRY_BYTES).alias("bytes")))
    total = codes.agg(F.coalesce(F.sum("bytes"), F.lit(0))).first()[0]
    room = max(params.bucket_bytes, total >> (CELL_BITS - 2))
    heavy = codes.filter(F.col("bytes") > room)
    # No more than total / room codes are heavy, fewer than 2^CELL_BITS.
    pages = F.ceil(F.col("bytes") / room).cast("long")
    heavy = durable(heavy.select("code", pages.alias("pages"), (F.sum(pages).over(Window.orderBy("code")) - pages).alias("before")))
    cells = durable(codes.filter(F.col("bytes") <= room).groupBy(cell().alias("cell")).agg(F.sum("bytes").alias("bytes")))
    # As many doublings at once as evenly spread codes need.
    cells = cells.withColumn("depth", F.lit(min(CELL_BITS, max(0, (total // room).bit_length() - 1))))
    bucket = F.expr(f"shiftright(cell, {CELL_BITS} - depth)")
    while True:
        held = F.sum("bytes").over(Window.partitionBy("depth", "bucket"))
        sized = durable(cells.withColumn("bucket", bucket).withColumn("split", (held > room) & (F.col("depth") < CELL_BITS)))
        if not sized.filter("split").limit(1).count():
            break
        cells = sized.select("cell", "bytes", (F.col("depth") + F.col("split").cast("int")).alias("depth"))
    first = F.expr(f"shiftleft(bucket, {CELL_BITS} - depth)")
    cells = durable(sized.select("cell", (F.dense_rank().over(Window.orderBy(first)) - 1).cast("long").alias("owner")))
    buckets = cells.agg(F.coalesce(F.max("owner") + 1, F.lit(0))).first()[0]
    chained = heavy.agg(F.coalesce(F.sum("pages"), F.lit(0))).first()[0]
    return Directory(cells, heavy.withColumn("first", F.col("before") + buckets), buckets + chained, chained)


def compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(entry, class) of entries that come in order of their codes; a class is the first entry with the same bytes."""
    at, chain = None, {}
    for batch in batches:
        found = []
        entries = batch.column("entry").to_pylist()
        for code, entry, body in zip(batch.column("code").to_pylist(), entries, batch.column("body")):
            if code != at:
                at, chain = code, {}
            found.append(chain.setdefault(body.as_py(), entry))
        yield pa.record_batch([pa.array(entries, pa.int64()), pa.array(found, pa.int64())], names=["entry", "class"])
    release()


def owned(entries: DataFrame, held: Directory) -> DataFrame:
    """(entry, class) after every owner compared what it owns. Broadcast: at most 2^CELL_BITS rows each."""
    placed = entries.withColumn("cell", cell()).join(F.broadcast(held.cells), "cell", "left")
    owner = F.col("owner")
    if held.pages:
        placed = placed.join(F.broadcast(held.heavy.select("code", "pages", "first")), "code", "left")
        owner = F.when(F.col("pages").isNotNull(), F.col("first") + F.pmod(F.xxhash64("entry"), F.col("pages"))).otherwise(owner)
    dealt = placed.select(F.coalesce(owner, F.lit(0)).cast("int").alias("owner"), "code", "entry", "body").repartitionById(max(1, held.owners), F.col("owner"))
    return dealt.sortWithinPartitions("code", "entry").select("code", "entry", "body").mapInArrow(compared, "entry long, class long")


def classes(entries: DataFrame, params: IndexParams) -> DataFrame:
    """(entry, class): the smallest entry with the same bytes."""
    held = directory(entries, params)
    found = durable(owned(entries, held))
    while held.pages:
        # What the pages of heavy codes left: one entry per page and text.
        leaders = found.join(entries.select(F.col("entry").alias("class"), "code").join(F.broadcast(held.heavy.select("code")), "code"), "class").select("class", "code").distinct()
        left = durable(entries.join(leaders.select(F.col("class").alias("entry")), "entry"))
        before, held = held.pages, directory(left, params)
        if held.pages >= before:
            # Different texts behind one code: pages can't make them fewer, so the first owner compares them all.
            held = Directory(held.cells, held.heavy, held.owners, 0)
        again = durable(owned(left, held)).select(F.col("entry").alias("class"), F.col("class").alias("further"))
        found = durable(found.join(again, "class", "left").select("entry", F.coalesce("further", "class").alias("class")))
    return found


def groups(docs: DataFrame, params: IndexParams = IndexParams()) -> DataFrame:
    """(doc_id, keep_id, group_size, kept, text_sha256) of every document."""
    stored = durable(log(docs, params))
    entries = stored.filter("body is not null").select("code", "entry", "body")
    found = classes(entries, params)
    order = F.struct((-F.col("size")).alias("shorter"), F.col("doc_id").isNull().alias("without"), "doc_id", "row")
    # Rows of an entry come from one task, so this sums before it moves anything.
    per_entry = stored.groupBy("entry").agg(F.min(order).alias("best"), F.count(F.lit(1)).alias("n"), F.max("digest").alias("digest"))
    per_entry = durable(per_entry.join(found, "entry"))
    per_class = per_entry.groupBy("class").agg(F.min("best").alias("keeper"), F.sum("n").alias("group_size"))
    facts = per_entry.select("entry", "class", "digest").join(per_class, "class").select("entry", "digest", "keeper", "group_size")
    return stored.select("doc_id", "row", "entry").join(facts, "entry").select(
        "doc_id", F.col("keeper.doc_id").alias("keep_id"), "group_size", (F.col("row") == F.col("keeper.row")).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"),
    )
