"""Helpers the operators share: word boundaries, hashing of words in bulk, batches of texts, components."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import durable

# Fixed by the task: words are runs of anything but these six characters.
SPACE_CODES = (0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D)
SPACES = "".join(map(chr, SPACE_CODES))
BREAK = r"[\x20\x09-\x0D]+"

CHUNK_CHARS = 1 << 18
UNICODE = 0x110000

_ODD = np.uint64(0x9E3779B97F4A7C15)
_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_BASE = 0xD1342543DE82EF95


def mix(x: np.ndarray) -> np.ndarray:
    """Scrambles 64-bit values one to one."""
    with np.errstate(over="ignore"):
        x = (x + _ODD).astype(np.uint64)
        x = (x ^ (x >> np.uint64(30))) * _M1
        x = (x ^ (x >> np.uint64(27))) * _M2
        return x ^ (x >> np.uint64(31))


def text_column(name: str = "text") -> Column:
    return F.coalesce(F.col(name).cast("string"), F.lit(""))


def words(text: Column) -> Column:
    """Words of a text; an empty array without any."""
    return F.filter(F.split(text, BREAK, -1), lambda w: w != "")


class Powers:
    """Powers of an odd base and of its inverse, as far as asked for so far."""

    def __init__(self) -> None:
        self.up = self.down = np.ones(1, np.uint64)

    def upto(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            with np.errstate(over="ignore"):
                size = max(n, 1 << 16)
                for name, base in (("up", _BASE), ("down", pow(_BASE, -1, 1 << 64))):
                    steps = np.full(size, base, np.uint64)
                    steps[0] = 1
                    setattr(self, name, np.multiply.accumulate(steps))
        return self.up, self.down


class WordHasher:
    """Hashes the words of many texts at once.

    fold maps a code point to the one hashed in its place and to 0 where it breaks words; words are then the runs
    of other code points. Equal words have equal hashes wherever they stand.
    """

    def __init__(self, fold: np.ndarray) -> None:
        self.breaks = fold == 0
        self.values = mix(fold.astype(np.uint64))
        self.values[self.breaks] = 0
        self.powers = Powers()

    def __call__(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(hash, text number, start, end) of every word; starts and ends count from the start of the joined texts."""
        lengths = np.fromiter((len(t) + 1 for t in texts), np.int64, len(texts))
        codes = np.frombuffer("\n".join([*texts, ""]).encode("utf-32-le", "surrogatepass"), np.uint32)
        edge = np.diff(np.concatenate(([1], self.breaks[codes], [1])).astype(np.int8))
        starts, ends = np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)
        up, down = self.powers.upto(len(codes) + 1)
        with np.errstate(over="ignore"):
            sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(self.values[codes] * up[: len(codes)], dtype=np.uint64)))
            hashes = mix((sums[ends] - sums[starts]) * down[starts])
        return hashes, np.searchsorted(np.cumsum(lengths), starts, side="right"), starts, ends


def plain_words() -> np.ndarray:
    """fold for words between SPACES with A-Z lower-cased."""
    fold = np.arange(UNICODE, dtype=np.uint32) + 1
    fold[65:91] += 32
    fold[list(SPACE_CODES)] = 0
    return fold


def release() -> None:
    """Gives freed memory back, as workers live on between tasks."""
    pa.default_memory_pool().release_unused()
    pa.system_memory_pool().release_unused()


def chunks(batches: Iterator[pa.RecordBatch], column: str = "text") -> Iterator[tuple[pa.RecordBatch, list[str]]]:
    """Slices of Arrow batches with about CHUNK_CHARS characters each, or one longer text; null texts are empty."""
    for batch in batches:
        texts = batch.column(column)
        sizes = np.nan_to_num(np.asarray(pc.cast(pc.binary_length(texts), pa.float64()).to_numpy(zero_copy_only=False)))
        first = size = 0
        for i, n in enumerate([*sizes.tolist(), None]):
            if n is None or i > first and size + n > CHUNK_CHARS:
                if i > first:
                    yield batch.slice(first, i - first), [t or "" for t in texts.slice(first, i - first).to_pylist()]
                first, size = i, 0
            size += n or 0
    release()


def hash_sample(df: DataFrame, code: Column, tie: str, rows: int) -> DataFrame:
    """At most ``rows`` distinct rows, those with the smallest codes of a share of the codes that holds them.

    The share, four times what is asked for, is cut off before anything moves, so that tasks pass on few rows each,
    however many tasks there are.
    """
    share = min(1.0, 4 * rows / max(1, df.count()))
    return df.filter(code.bitwiseAND(F.lit((1 << 40) - 1)) <= int(share * (1 << 40))).distinct().orderBy(code, tie).limit(rows)


def bounded_sample(docs: DataFrame, labels: DataFrame, label: Column, rows: int) -> DataFrame:
    """(doc_id, label, text) of at most ``rows`` labelled documents, taken in hash order of doc_id.

    The ids are chosen from labels (doc_id, label) alone, so that only the chosen texts move; being bounded, they
    are broadcast. ``label`` decides between several labels of an id, the smallest text between several rows.
    """
    known = labels.filter("label is not null and doc_id is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(label.cast("int").alias("label"))
    chosen = hash_sample(known, F.xxhash64("doc_id"), "doc_id", rows)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_column().alias("text")).join(F.broadcast(chosen), "doc_id")
    return texts.groupBy("doc_id", "label").agg(F.min("text").alias("text"))


def components(edges: DataFrame, a: str = "a", b: str = "b", label: str = "component") -> DataFrame:
    """(node, component) of every node with an edge; component is the smallest node reachable.

    Each round every node takes the smallest label among itself and its neighbours, then the label of that label.
    Rounds end when no label changes; labels are written to the shared folder after each. A node with very many
    edges is only aggregated, never gathered.
    """
    both = durable(edges.filter(F.col(a) != F.col(b)).select(F.col(a).alias("u"), F.col(b).alias("v")).union(
        edges.filter(F.col(a) != F.col(b)).select(F.col(b), F.col(a))).distinct())
    labels = durable(both.groupBy(F.col("u").alias("node")).agg(F.least(F.min("v"), F.col("u")).alias("l")))
    while True:
        near = both.join(labels, F.col("v") == F.col("node")).groupBy("u").agg(F.min("l").alias("m"))
        step = labels.join(near, F.col("node") == F.col("u")).select("node", "l", F.least("l", "m").alias("m"))
        jump = labels.select(F.col("node").alias("at"), F.col("l").alias("further"))
        step = durable(step.join(jump, F.col("m") == F.col("at")).select("node", F.least("m", "further").alias("new"), "l"))
        if not step.filter(F.col("new") != F.col("l")).limit(1).count():
            return step.select("node", F.col("new").alias(label))
        labels = step.select("node", F.col("new").alias("l"))
