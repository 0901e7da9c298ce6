"""Toxicity by FTRL-proximal logistic regression over hashed word n-grams and skip-grams.

Every coordinate has its own learning rate; L1 keeps most weights at exactly 0, so a few thousand (index, weight)
pairs are broadcast. Training reads a bounded sample of labelled rows, scoring every whole text.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import durable
from .common import UNICODE, WordHasher, bounded_sample, chunks, mix, text_column


@dataclass(frozen=True)
class FtrlParams:
    """sample bounds the labelled rows that train the model; bits gives 2 ** bits coordinates."""

    sample: int = 12000
    bits: int = 20
    alpha: float = 0.3
    beta: float = 1.0
    l1: float = 12.0
    l2: float = 1.0
    epochs: int = 5
    seen_in: int = 3


@lru_cache(1)
def letters() -> np.ndarray:
    """fold for words of letters, lower-cased."""
    fold = np.zeros(UNICODE, np.uint32)
    for i in range(UNICODE):
        if (c := chr(i)).isalpha():
            fold[i] = ord(low) if len(low := c.lower()) == 1 else i
    return fold


@lru_cache(1)
def hasher() -> WordHasher:
    return WordHasher(letters())


def grams(texts: list[str], bits: int) -> tuple[np.ndarray, np.ndarray]:
    """(text number, coordinate) of every word, pair of neighbours and pair with one word between; repeats included."""
    h, doc, _, _ = hasher()(texts)
    at, codes = [doc], [h]
    for gap in (1, 2):
        if len(h) > gap:
            same = doc[gap:] == doc[:-gap]
            with np.errstate(over="ignore"):
                codes.append(mix(mix(h[:-gap] + np.uint64(gap)) + h[gap:])[same])
            at.append(doc[gap:][same])
    return np.concatenate(at), (np.concatenate(codes) >> np.uint64(64 - bits)).astype(np.int64)


def distinct_grams(texts: list[str], bits: int, among: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """The distinct pairs of grams(), sorted by text; among keeps the marked coordinates only."""
    at, code = grams(texts, bits)
    if among is not None:
        kept = among[code]
        at, code = at[kept], code[kept]
    both = np.unique(at.astype(np.int64) << bits | code)
    return both >> bits, both & (1 << bits) - 1


@dataclass(frozen=True)
class Weights:
    bias: float
    index: np.ndarray
    value: np.ndarray


def fit(rows: list[tuple[np.ndarray, int]], params: FtrlParams) -> Weights:
    """FTRL-proximal over (coordinates, label) rows in the order given, epoch after epoch."""
    size = (1 << params.bits) + 1
    z, n = np.zeros(size), np.zeros(size)
    counts = np.zeros(size, np.int32)
    for x, _ in rows:
        counts[x] += 1
    rows = [(np.append(x[counts[x] >= params.seen_in], size - 1), y) for x, y in rows]

    def weights(at) -> np.ndarray:
        shrunk = np.sign(z[at]) * np.maximum(np.abs(z[at]) - np.where(at == size - 1, 0.0, params.l1), 0)
        return -shrunk / ((params.beta + np.sqrt(n[at])) / params.alpha + params.l2)

    for _ in range(params.epochs):
        for x, y in rows:
            w = weights(x)
            g = 1 / (1 + np.exp(-np.clip(w.sum(), -35, 35))) - y
            rate = (np.sqrt(n[x] + g * g) - np.sqrt(n[x])) / params.alpha
            z[x] += g - rate * w
            n[x] += g * g
    w = weights(np.arange(size))
    kept = np.flatnonzero(w[:-1])
    return Weights(float(w[-1]), kept, w[kept])


def train(docs: DataFrame, labels: DataFrame, params: FtrlParams = FtrlParams()) -> Weights:
    """Weights from labels (doc_id, label); rows are taken in hash order up to params.sample. Without labels all are 0.

    Coordinates that fewer than params.seen_in of these rows hold have no weight; they are counted and left out before
    the rows reach the driver, which gets at most 2^bits coordinates a row whatever the length of a text.
    """
    some = bounded_sample(docs, labels, F.max("label"), params.sample)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in chunks(batches):
            at, code = distinct_grams(texts, params.bits)
            offsets = np.searchsorted(at, np.arange(len(texts) + 1))
            yield pa.record_batch([batch.column("doc_id"), batch.column("label"), pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(code.astype(np.int32)))], names=["doc_id", "label", "x"])

    listed = durable(some.mapInArrow(run, "doc_id long, label int, x array<int>"))
    often = listed.select(F.explode("x").alias("code")).groupBy("code").count().filter(F.col("count") >= params.seen_in).select("code").toArrow()
    among = np.zeros(1 << params.bits, bool)
    among[np.asarray(often["code"])] = True

    def frequent(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = [c[among[c]] for c in (np.asarray(v.values) for v in batch.column("x"))]
            yield pa.record_batch([batch.column("doc_id"), batch.column("label"), pa.array(x, pa.list_(pa.int32()))], names=["doc_id", "label", "x"])

    got = listed.mapInArrow(frequent, "doc_id long, label int, x array<int>").toArrow()
    order = np.argsort(mix(np.asarray(got["doc_id"]).astype(np.uint64)), kind="stable")
    x, y = got["x"].combine_chunks(), got["label"].to_pylist()
    return fit([(np.asarray(x[int(i)].values), y[i]) for i in order], params)


def scored(docs: DataFrame, weights: Weights, params: FtrlParams = FtrlParams()) -> DataFrame:
    """(doc_id, score) of every row of docs; null and empty texts have the score of the bias, repeated rows repeat."""
    held = docs.sparkSession.sparkContext.broadcast(weights)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w = np.zeros(1 << params.bits, np.float32)
        w[held.value.index] = held.value.value
        used = w != 0
        for batch, texts in chunks(batches):
            at, code = distinct_grams(texts, params.bits, used)
            total = held.value.bias + np.bincount(at, w[code], minlength=len(texts))
            yield pa.record_batch([batch.column("doc_id"), pa.array(1 / (1 + np.exp(-np.clip(total, -35, 35))))], names=["doc_id", "score"])

    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_column().alias("text"))
    return source.mapInArrow(run, "doc_id long, score double")
