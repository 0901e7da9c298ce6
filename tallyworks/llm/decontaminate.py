"""Benchmark passages in documents, with edits: pigeonhole pieces, exact hits, bit-parallel verification.

An item with an error budget of k edits is split into k + 1 pieces; a passage within the budget holds at least one
piece unchanged. Hits of the pieces give diagonals, and Myers' bit-parallel distance decides every diagonal.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import text_column

# Items are broadcast in blocks of about so many characters; each block reads all documents once.
BLOCK_CHARS = 4_000_000


@dataclass(frozen=True)
class MatchParams:
    error_percent: int = 8

    def budget(self, length: int) -> int:
        return length * self.error_percent // 100


def normalised(text: str) -> str:
    """Lower case, white space as single spaces."""
    return " ".join(text.lower().split())


def distance(masks: dict[str, int], m: int, text: str) -> tuple[int, int]:
    """(least edit distance of the pattern to a part of text, end of the first such part)."""
    ones, top = (1 << m) - 1, 1 << (m - 1)
    plus, minus, score = ones, 0, m
    best, end = m, 0
    get = masks.get
    for i, c in enumerate(text, 1):
        eq = get(c, 0)
        x = eq | minus
        d = ((((x & plus) + plus) ^ plus) | x) & ones
        up, down = minus | (~(d | plus) & ones), plus & d
        if up & top:
            score += 1
        elif down & top:
            score -= 1
        up, down = (up << 1) & ones, (down << 1) & ones
        # The first row is 0 everywhere: a part of text may start anywhere.
        plus, minus = down | (~(d | up) & ones), up & d
        if score < best:
            best, end = score, i
    return best, end


class Matcher:
    """Items of one block, ready to be looked for in texts."""

    def __init__(self, items: list[tuple[int, str]], params: MatchParams) -> None:
        self.items, self.masks = [], {}
        pieces: dict[str, list[tuple[int, int]]] = defaultdict(list)
        for item_id, text in items:
            text = normalised(text)
            if not text:
                continue
            k = params.budget(len(text))
            cuts = [len(text) * j // (k + 1) for j in range(k + 2)]
            for a, b in zip(cuts, cuts[1:]):
                pieces[text[a:b]].append((len(self.items), a))
            self.items.append((item_id, text, k))
        self.automaton = ahocorasick.Automaton()
        for piece, owners in pieces.items():
            self.automaton.add_word(piece, (len(piece), owners))
        if pieces:
            self.automaton.make_automaton()

    def mask(self, at: int) -> dict[str, int]:
        if at not in self.masks:
            own: dict[str, int] = defaultdict(int)
            for i, c in enumerate(self.items[at][1]):
                own[c] |= 1 << i
            self.masks[at] = dict(own)
        return self.masks[at]

    def __call__(self, text: str) -> list[tuple[int, int, int]]:
        """(item_id, distance, end in the normalised text) of every item within its budget, at its best place."""
        if not self.items:
            return []
        text = normalised(text)
        diagonals: dict[int, set[int]] = defaultdict(set)
        for end, (size, owners) in self.automaton.iter(text):
            for at, offset in owners:
                diagonals[at].add(end + 1 - size - offset)
        found = []
        for at, starts in diagonals.items():
            item_id, item, k = self.items[at]
            m = len(item)
            if (whole := min((s for s in starts if s >= 0 and text.startswith(item, s)), default=None)) is not None:
                found.append((item_id, 0, whole + m))
                continue
            best = (m + 1, 0)
            for a, b in merged(sorted(starts), k):
                a, b = max(0, a - k), b + m + k
                d, end = distance(self.mask(at), m, text[a:b])
                best = min(best, (d, a + end))
            if best[0] <= k:
                found.append((item_id, *best))
        return found


def merged(starts: list[int], k: int) -> Iterator[tuple[int, int]]:
    """Runs of starts not more than k apart, as (first, last)."""
    first = last = starts[0]
    for s in starts[1:]:
        if s - last > k:
            yield first, last
            first = s
        last = s
    yield first, last


def matchers(items: DataFrame, params: MatchParams) -> Iterator[Callable]:
    """For each block of items, a function that builds its matcher on an executor."""
    spark = items.sparkSession
    known = items.filter("item_id is not null and text is not null").select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text")).distinct()
    chars = known.agg(F.sum(F.length("text"))).first()[0] or 0
    blocks = -(-chars // BLOCK_CHARS) or 1
    for b in range(blocks):
        own = spark.sparkContext.broadcast([tuple(r) for r in known.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == b).collect()])
        yield lambda own=own: Matcher(own.value, params)


def contamination(docs: DataFrame, items: DataFrame, params: MatchParams = MatchParams()) -> DataFrame:
    """(doc_id, item_id, distance, match_end): every item found in every row of docs within its error budget.

    Case and white space are levelled first. Null or empty texts hold nothing, empty items are held by nothing.
    Repeated rows match as often as they stand; of ties the first place counts. Other columns are not read.
    """
    def scan(build):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            match = build()
            for batch in batches:
                rows = [(d, *hit) for d, t in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()) if t for hit in match(t)]
                if rows:
                    yield pa.record_batch([pa.array(c, pa.int64()) for c in zip(*rows)], names=["doc_id", "item_id", "distance", "match_end"])
        return run

    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_column().alias("text"))
    out = None
    for build in matchers(items, params):
        part = source.mapInArrow(scan(build), "doc_id long, item_id long, distance long, match_end long")
        out = part if out is None else out.union(part)
    return out


def clean_documents(docs: DataFrame, items: DataFrame, params: MatchParams = MatchParams()) -> DataFrame:
    """The rows of docs, all columns, that hold no item."""
    def keep(build):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            match = build()
            for batch in batches:
                yield batch.filter(pa.array([not (t and match(t)) for t in batch.column(at).to_pylist()], pa.bool_()))
        return run

    at, schema = docs.columns.index("text"), docs.schema
    for build in matchers(items, params):
        docs = docs.mapInArrow(keep(build), schema)
    return docs
