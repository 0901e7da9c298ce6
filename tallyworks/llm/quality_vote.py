"""Quality by nearest-neighbour voting among labelled documents in a latent-semantic space.

Terms of a document are its words, hashed and weighted by their rarity, trigrams of its character-shape runs, its
repetitions and its length. A truncated SVD of a bounded sample of labelled rows gives the latent axes. The sample's
unit vectors are broadcast; every document is compared with all of them in blocks of exact cosine products, and its
nearest ones vote with their similarity.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import UNICODE, WordHasher, bounded_sample, chunks, mix, plain_words, text_column

SHAPES = 16
TRIGRAMS = SHAPES ** 3
# Repeated words, repeated neighbours, repeated windows, repeated lines, then the logarithm of the length in steps.
REPEATS, LENGTHS = 4, 16
FORMS = TRIGRAMS + REPEATS + LENGTHS
# Words fall on this many terms by hash, so that no text and no vocabulary makes a longer list.
WORD_TERMS = 1 << 13
TERMS = FORMS + WORD_TERMS


@dataclass(frozen=True)
class VoteParams:
    """sample bounds the labelled rows; axes the latent dimensions, nearest the voters of a document.

    forms and words weigh the two groups of terms against each other; with 0 a group has no part.
    """

    sample: int = 4096
    axes: int = 48
    forms: float = 1.0
    words: float = 1.0
    nearest: int = 24
    power: float = 8.0
    block: int = 512
    seed: int = 11


@lru_cache(1)
def shapes() -> np.ndarray:
    """Class of every code point: spaces, letters by case and script, digits, single marks, the rest."""
    table = np.full(UNICODE, 15, np.uint8)
    for i in range(128, 0x3000):
        c = chr(i)
        table[i] = 3 if c.isupper() else 2 if c.isalpha() else 15
    table[0x3000:0xD800] = 2
    table[97:123], table[65:91], table[48:58] = 1, 3, 4
    for cls, chars in ((0, " \t\x0b\x0c\r"), (5, "\n"), (6, ".,;:"), (7, "!?"), (8, "|"), (9, "#"), (10, "$"), (11, "%"), (12, "&*"), (13, "<>{}[]()="), (14, "'\"-_/\\@+")):
        table[[ord(c) for c in chars]] = cls
    table[97:123] = 2
    return table


@lru_cache(1)
def hasher() -> WordHasher:
    return WordHasher(plain_words())


def repeats(doc: np.ndarray, values: np.ndarray, n: int) -> np.ndarray:
    """How many values of each text stand earlier in it."""
    if not len(values):
        return np.zeros(n)
    order = np.lexsort((values, doc))
    d, v = doc[order], values[order]
    again = np.concatenate(([False], (d[1:] == d[:-1]) & (v[1:] == v[:-1])))
    return np.bincount(d[again], minlength=n).astype(float)


def terms(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text number, term, weight): square roots of the shares of each text, so that every group of terms has norm 1 or less."""
    n = len(texts)
    lengths = np.fromiter((len(t) + 1 for t in texts), np.int64, n)
    codes = np.frombuffer("\n".join([*texts, ""]).encode("utf-32-le", "surrogatepass"), np.uint32)
    cls = shapes()[codes]
    edge = np.concatenate(([True], cls[1:] != cls[:-1]))
    # A text that starts with a line break does not go on with the break behind the text before it.
    edge[np.cumsum(lengths)[:-1]] = True
    run = np.flatnonzero(edge)
    kind, owner = cls[run].astype(np.int64), np.searchsorted(np.cumsum(lengths), run, side="right")
    tri = kind[:-2] * SHAPES * SHAPES + kind[1:-1] * SHAPES + kind[2:]
    same = owner[2:] == owner[:-2]
    key, count = np.unique(owner[:-2][same] * TRIGRAMS + tri[same], return_counts=True)
    at, term = key // TRIGRAMS, key % TRIGRAMS
    total = np.bincount(at, count, minlength=n)
    h, doc, start, _ = hasher()(texts)
    words = np.bincount(doc, minlength=n)
    near = np.bincount(doc[1:][(h[1:] == h[:-1]) & (doc[1:] == doc[:-1])], minlength=n)
    five = h.copy()
    with np.errstate(over="ignore"):
        for j in range(1, 5):
            five[: len(h) - j] = mix(five[: len(h) - j]) + h[j:]
    whole = doc[4:] == doc[:-4] if len(h) > 4 else np.zeros(0, bool)
    line_of = np.searchsorted(np.flatnonzero(codes == 10), start)
    with np.errstate(over="ignore"):
        first = np.flatnonzero(np.concatenate(([True], line_of[1:] != line_of[:-1]))) if len(h) else np.zeros(0, np.int64)
        lines = np.add.reduceat(mix(h + (start - start[first][np.searchsorted(first, np.arange(len(h)), side="right") - 1]).astype(np.uint64)), first) if len(h) else h
    counts = np.stack((repeats(doc, h, n), near.astype(float), repeats(doc[: len(whole)][whole], five[: len(whole)][whole], n), repeats(doc[first], lines, n)))
    base = np.stack((words, words, words, np.maximum(np.bincount(doc[first], minlength=n), 1))).astype(float)
    share = np.sqrt(counts / np.maximum(base, 1))
    r, d = np.nonzero(share)
    size = np.minimum(np.log2(words + 1).astype(np.int64), LENGTHS - 1)
    held, times = np.unique(doc * WORD_TERMS + (h % np.uint64(WORD_TERMS)).astype(np.int64), return_counts=True)
    by, word = held // WORD_TERMS, held % WORD_TERMS
    return (np.concatenate((at, d, np.arange(n), by)), np.concatenate((term, TRIGRAMS + r, TRIGRAMS + REPEATS + size, FORMS + word)),
            np.concatenate((np.sqrt(count / total[at]), share[r, d], np.full(n, 0.3), np.sqrt(times / words[by]))).astype(np.float32))


@dataclass(frozen=True)
class Space:
    axes: np.ndarray
    vectors: np.ndarray
    labels: np.ndarray


def unit(v: np.ndarray) -> np.ndarray:
    return v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-12)


def projected(texts: list[str], axes: np.ndarray) -> np.ndarray:
    at, term, weight = terms(texts)
    order = np.argsort(at, kind="stable")
    at, rows = at[order], axes[term[order]] * weight[order][:, None]
    return unit(np.add.reduceat(rows, np.searchsorted(at, np.arange(len(texts))), axis=0))


def scales(x: np.ndarray, params: VoteParams) -> np.ndarray:
    """Factor of every term: that of its group, for words times their rarity (1 where two rows hold it, 0 where all or fewer do)."""
    rows = len(x)
    held = np.count_nonzero(x[:, FORMS:], axis=0)
    rarity = np.where(held > 1, np.log(rows / np.maximum(held, 1)) / max(np.log(rows / 2), 1e-9), 0)
    return np.concatenate((np.full(FORMS, params.forms), params.words * rarity)).astype(np.float32)


def fit(x: np.ndarray, labels: np.ndarray, params: VoteParams) -> Space:
    """Truncated SVD by seeded random projections and two power steps; the axes hold the scales of the terms. Changes x."""
    scale = scales(x, params)
    x *= scale
    k = min(params.axes, *x.shape)
    q = np.random.default_rng(params.seed).standard_normal((x.shape[1], min(k + 16, *x.shape))).astype(np.float32)
    for _ in range(3):
        q, _ = np.linalg.qr(x.T @ (x @ q))
    _, _, v = np.linalg.svd(x @ q, full_matrices=False)
    axes = (q @ v[:k].T).astype(np.float32)
    return Space(axes * scale[:, None], unit(x @ axes), labels.astype(np.float32))


def train(docs: DataFrame, labels: DataFrame, params: VoteParams = VoteParams()) -> Space | None:
    """The space of labels (doc_id, label), rows taken in hash order up to params.sample; None without labels.

    Lists of terms are gathered, no texts: at most TERMS entries for a text of any length.
    """
    some = bounded_sample(docs, labels, F.min("label"), params.sample)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in chunks(batches):
            at, term, weight = terms(texts)
            order = np.argsort(at, kind="stable")
            offsets = pa.array(np.searchsorted(at[order], np.arange(len(texts) + 1)).astype(np.int32))
            lists = [pa.ListArray.from_arrays(offsets, pa.array(v[order])) for v in (term.astype(np.int32), weight)]
            yield pa.record_batch([batch.column("doc_id"), batch.column("label"), *lists], names=["doc_id", "label", "term", "weight"])

    got = some.mapInArrow(run, "doc_id long, label int, term array<int>, weight array<float>").toArrow()
    if not got.num_rows:
        return None
    term, weight = got["term"].combine_chunks(), got["weight"].combine_chunks()
    order = np.argsort(np.asarray(got["doc_id"]), kind="stable")
    x = np.zeros((got.num_rows, TERMS), np.float32)
    for row, i in enumerate(order.tolist()):
        x[row, np.asarray(term[i].values)] = np.asarray(weight[i].values)
    return fit(x, np.asarray(got["label"])[order], params)


# Products of blocks of other shapes differ in digits behind these.
COSINE_DIGITS = 5


def nearest(near: np.ndarray, k: int) -> np.ndarray:
    """Column numbers of the k largest rounded cosines of every row, ascending; of ties the smaller numbers."""
    n = near.shape[1]
    k = min(k, n)
    # One whole number per cell that no other cell of the row has: the cosine, then the column counted backwards.
    order = np.rint(near * 10**COSINE_DIGITS).astype(np.int64) * n + np.arange(n - 1, -1, -1)
    return np.sort(np.argpartition(-order, k - 1, axis=1)[:, :k], axis=1)


def scored(docs: DataFrame, space: Space | None, params: VoteParams = VoteParams()) -> DataFrame:
    """(doc_id, score) of every row of docs: the share of label 1 in the votes of its nearest labelled rows.

    Null and empty texts have a length term only and vote like all others; repeated rows repeat. Cosines count with
    COSINE_DIGITS digits, and ties among equally near rows go to the smaller doc_id. Without labels every score is 0.5.
    """
    held = docs.sparkSession.sparkContext.broadcast(space)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        s = held.value
        for batch, texts in chunks(batches):
            scores = []
            for first in range(0, len(texts), params.block):
                part = texts[first: first + params.block]
                if s is None:
                    scores.append(np.full(len(part), 0.5))
                    continue
                near = np.round(projected(part, s.axes) @ s.vectors.T, COSINE_DIGITS)
                top = nearest(near, params.nearest)
                vote = np.clip(np.take_along_axis(near, top, axis=1), 0, None).astype(float) ** params.power
                scores.append((vote * s.labels[top] + 1e-9 * s.labels[top]).sum(axis=1) / (vote + 1e-9).sum(axis=1))
            yield pa.record_batch([batch.column("doc_id"), pa.array(np.clip(np.concatenate(scores), 0, 1))], names=["doc_id", "score"])

    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_column().alias("text"))
    return source.mapInArrow(run, "doc_id long, score double")
