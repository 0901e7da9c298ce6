"""Personal data by fixed patterns and a skip-chain conditional random field.

Patterns give the base spans. Number-like and address-like stretches that no pattern takes are open. Base and open
stretches of a document form the graph of the field: neighbours are joined in a chain, stretches with equal cores
(last digits, address name) by skip edges, however far apart. Base labels are observed; loopy message passing
decides the open ones, and those taken for an entity are added to the spans.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import durable
from .common import chunks, hash_sample, text_column

KINDS = ("email", "ip", "card", "phone")
NONE = len(KINDS)

# Fixed by the task.
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
DOTTED = re.compile(r"[0-9][0-9.]*\.[0-9.]*[0-9]")

MAYBE = re.compile(r"[0-9@]")
NUMBER = re.compile(r"[0-9](?:[0-9().\x20/-]*[0-9])?")
AROUND = re.compile(r"@[A-Za-z0-9.-]*")
CUES = ("tel", "phone", "call", "fax", "mobile", "mail", "card", "visa", "account", "host", "server", "addr", "version", "date")


@dataclass(frozen=True)
class FieldParams:
    """sample bounds the documents whose base spans train the field, units the stretches taken from them."""

    sample: int = 3000
    units: int = 60_000
    rounds: int = 12
    damping: float = 0.5
    certainty: float = 0.6
    steps: int = 300


def emails(text: str) -> Iterator[tuple[int, int]]:
    end, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > end and text[start - 1] in LOCAL:
            start -= 1
        if start < at and (m := DOMAIN.match(text, at + 1)):
            end = m.end()
            yield start, end
            at = text.find("@", end)
        else:
            at = text.find("@", at + 1)


def addresses(text: str) -> Iterator[tuple[int, int]]:
    for m in DOTTED.finditer(text):
        parts, at, i = m.group().split("."), m.start(), 0
        while i + 3 < len(parts):
            four = parts[i: i + 4]
            if all(four):
                size = sum(map(len, four)) + 3
                if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in four):
                    yield at, at + size
                at, i = at + size + 1, i + 4
            else:
                at, i = at + len(parts[i]) + 1, i + 1


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def digits_of(text: str) -> str:
    return "".join(c for c in text if "0" <= c <= "9")


def cards(text: str) -> Iterator[tuple[int, int]]:
    for m in CARD.finditer(text):
        if 16 <= m.end() - m.start() and 16 <= len(d := digits_of(m.group())) <= 19 and luhn(d):
            yield m.span()


def phones(text: str) -> Iterator[tuple[int, int]]:
    for m in PHONE.finditer(text):
        if 8 <= len(digits_of(m.group())) <= 15:
            yield m.span()


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(kind, start, end), kind by kind, then by start."""
    if not MAYBE.search(text):
        return []
    return [(k, a, b) for k, find in enumerate((emails, addresses, cards, phones)) for a, b in find(text)]


def open_spans(text: str, base: list[tuple[int, int, int]]) -> list[tuple[int, int]]:
    """Stretches with 7 digits or more, and those around an @, that no base span meets."""
    taken = np.array(sorted((a, b) for _, a, b in base), np.int64).reshape(-1, 2)
    ends = np.maximum.accumulate(taken[:, 1]) if len(taken) else taken[:, 1]

    def free(a: int, b: int) -> bool:
        i = int(np.searchsorted(taken[:, 0], b))
        return i == 0 or ends[i - 1] <= a

    found = [m.span() for m in NUMBER.finditer(text) if m.end() - m.start() >= 7 and len(digits_of(m.group())) >= 7]
    last = 0
    for m in AROUND.finditer(text):
        a = m.start()
        while a > last and text[a - 1] in LOCAL:
            a -= 1
        last = m.end()
        if last - a > 1:
            found.append((a, last))
    return sorted({(a, b) for a, b in found if free(a, b)})


def core(text: str) -> str:
    """What similar stretches have in common: the last seven digits, or the name before an @."""
    if "@" in text:
        return text.partition("@")[0].lower()
    return digits_of(text)[-7:]


def figures(text: str, a: int, b: int) -> list[float]:
    s = text[a:b]
    n = len(digits_of(s))
    before, after = text[max(0, a - 24): a].lower(), text[b: b + 8]
    return [1.0, "@" in s, s.count(".") == 3, s.count(".") > 0, s[:1] == "+", "(" in s, "-" in s, " " in s,
            n < 8, 8 <= n <= 12, 13 <= n <= 15, 16 <= n <= 19, n > 19, n == len(s), any(c.isalpha() for c in s),
            a > 0 and text[a - 1].isalnum(), after[:1].isalnum(), "\"" in before[-2:], *(c in before for c in CUES)]


@dataclass
class Graph:
    """Stretches of several texts; label NONE + 1 is open. chain and skip hold edges between them."""

    doc: np.ndarray
    span: np.ndarray
    label: np.ndarray
    x: np.ndarray
    chain: np.ndarray
    skip: np.ndarray


NEAR = 200


def graph(texts: list[str], bases: list[list[tuple[int, int, int]]]) -> Graph:
    doc, span, label, x, chain, skip = [], [], [], [], [], []
    for i, (text, base) in enumerate(zip(texts, bases)):
        if not base and not MAYBE.search(text):
            continue
        units = sorted([(a, b, k) for k, a, b in base] + [(a, b, NONE + 1) for a, b in open_spans(text, base)])
        first: dict[str, int] = {}
        last: dict[str, int] = {}
        for j, (a, b, k) in enumerate(units):
            at = len(doc)
            if j and a - units[j - 1][1] <= NEAR:
                chain.append((at - 1, at))
            name = core(text[a:b])
            if name in last:
                skip.append((last[name], at))
                if first[name] != last[name]:
                    skip.append((first[name], at))
            first.setdefault(name, at)
            last[name] = at
            doc.append(i)
            span.append((a, b))
            label.append(k)
            x.append(figures(text, a, b))
    pairs = lambda e: np.array(e, np.int64).reshape(-1, 2)
    width = len(figures("0", 0, 1))
    return Graph(np.array(doc, np.int64), pairs(span), np.array(label, np.int64), np.array(x, float).reshape(-1, width), pairs(chain), pairs(skip))


@dataclass(frozen=True)
class Field:
    unary: np.ndarray
    chain: np.ndarray
    skip: np.ndarray


def neutral() -> Field:
    k = NONE + 1
    unary = np.zeros((len(figures("0", 0, 1)), k))
    unary[0, NONE] = 2.0
    return Field(unary, np.zeros((k, k)), np.eye(k))


def fit(g: Graph, params: FieldParams) -> Field:
    """Pseudo-likelihood: every stretch given its neighbours' labels. Open stretches count as none, except those with
    a base stretch of the same core, which are left out."""
    k = NONE + 1
    alike = np.zeros(len(g.label), bool)
    for a, b in ((0, 1), (1, 0)):
        alike[g.skip[g.label[g.skip[:, b]] < NONE, a]] = True
    known = (g.label < NONE) | ~alike
    y = np.minimum(g.label, NONE)
    if not (y < NONE).any():
        return neutral()
    def sums(edges: np.ndarray, a: int, b: int) -> np.ndarray:
        """One-hot labels of the neighbours on one side of the edges whose ends are known."""
        out = np.zeros((len(y), k))
        e = edges[known[edges[:, 0]] & known[edges[:, 1]]]
        np.add.at(out, (e[:, a], y[e[:, b]]), 1.0)
        return out
    left, right = sums(g.chain, 1, 0), sums(g.chain, 0, 1)
    same = sums(g.skip, 0, 1) + sums(g.skip, 1, 0)
    f = neutral()
    u, c, s = f.unary.copy(), f.chain.copy(), np.ones(k)
    hot = np.eye(k)[y]
    n = max(1, known.sum())
    for _ in range(params.steps):
        score = g.x @ u + left @ c + right @ c.T + same * s
        p = np.exp(score - score.max(axis=1, keepdims=True))
        d = (hot - p / p.sum(axis=1, keepdims=True)) * known[:, None] / n
        u += 4.0 * (g.x.T @ d - 1e-4 * u)
        c += 1.0 * (left.T @ d + d.T @ right - 1e-3 * c)
        s += 1.0 * ((same * d).sum(axis=0) - 1e-3 * (s - 1))
    return Field(u, c, np.diag(np.clip(s, 0.5, 6.0)))


def beliefs(g: Graph, f: Field, params: FieldParams) -> np.ndarray:
    """Label probabilities of every stretch after params.rounds of damped loopy messages over all edges at once."""
    k = NONE + 1
    own = g.x @ f.unary
    seen = g.label < NONE
    own[seen] = -25.0
    own[np.flatnonzero(seen), g.label[seen]] = 0.0
    edges = np.concatenate((g.chain, g.skip))
    weight = np.concatenate((np.repeat(f.chain[None], len(g.chain), 0), np.repeat(f.skip[None], len(g.skip), 0)))
    ahead, back = np.zeros((len(edges), k)), np.zeros((len(edges), k))
    a, b = edges[:, 0], edges[:, 1]

    def total() -> np.ndarray:
        out = own.copy()
        np.add.at(out, b, ahead)
        np.add.at(out, a, back)
        return out

    def message(state: np.ndarray, w: np.ndarray) -> np.ndarray:
        joint = state[:, :, None] + w
        top = joint.max(axis=1)
        out = top + np.log(np.exp(joint - top[:, None, :]).sum(axis=1))
        return out - out.max(axis=1, keepdims=True)

    for _ in range(params.rounds if len(edges) else 0):
        sum_ = total()
        new_ahead, new_back = message(sum_[a] - back, weight), message(sum_[b] - ahead, weight.transpose(0, 2, 1))
        ahead = params.damping * ahead + (1 - params.damping) * new_ahead
        back = params.damping * back + (1 - params.damping) * new_back
    out = total()
    p = np.exp(out - out.max(axis=1, keepdims=True))
    return p / p.sum(axis=1, keepdims=True)


def train(docs: DataFrame, params: FieldParams = FieldParams()) -> Field:
    """A field from the base spans of at most params.sample documents with digits or an @, taken in hash order.

    Documents are taken until they have more than params.units stretches; the last one is taken whole. What that cuts
    off never reaches the driver.
    """
    told = docs.select(text_column().alias("text")).filter(F.col("text").rlike("[0-9@]"))
    some = hash_sample(told, F.xxhash64("text"), "text", params.sample)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in chunks(batches):
            for code, text in zip(batch.column("code").to_pylist(), texts):
                g = graph([text], [base_spans(text)])
                flat = lambda v, t=pa.int64(): pa.array([v.ravel().tolist()], pa.list_(t))
                yield pa.record_batch([pa.array([code], pa.int64()), pa.array([len(g.label)], pa.int64()), flat(g.label), flat(g.x, pa.float64()), flat(g.chain), flat(g.skip)], names=["code", "n", "label", "x", "chain", "skip"])

    graphs = durable(some.withColumn("code", F.xxhash64("text")).mapInArrow(run, "code long, n long, label array<long>, x array<double>, chain array<long>, skip array<long>"))
    units, last = 0, None
    for r in graphs.select("code", "n").orderBy("code", "n").collect():
        units, last = units + r.n, r.code
        if units > params.units:
            break
    rows = [] if last is None else graphs.filter(F.col("code") <= last).toArrow().to_pylist()
    parts, shift, width = [], 0, len(figures("0", 0, 1))
    for r in sorted(rows, key=lambda r: r["code"]):
        n = len(r["label"])
        edges = lambda e: np.array(e, np.int64).reshape(-1, 2) + shift  # noqa: E731,B023
        parts.append((np.array(r["label"], np.int64), np.array(r["x"], float).reshape(n, width), edges(r["chain"]), edges(r["skip"])))
        shift += n
    parts = [p for p in parts if len(p[0])]
    if not parts:
        return neutral()
    label, x, chain, skip = (np.concatenate(c) for c in zip(*parts))
    return fit(Graph(np.zeros(0, np.int64), np.zeros((0, 2), np.int64), label, x, chain, skip), params)


def spans(docs: DataFrame, field: Field, params: FieldParams = FieldParams()) -> DataFrame:
    """(doc_id, base, added) of every row of docs: arrays of (kind, start, end) in code points, by kind, then start.

    Null and empty texts have none; repeated rows repeat; other columns are not read. A stretch is added when one
    kind is at least params.certainty likely.
    """
    held = docs.sparkSession.sparkContext.broadcast(field)
    item = pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in chunks(batches):
            bases = [base_spans(t) for t in texts]
            added: list[list] = [[] for _ in texts]
            g = graph(texts, bases)
            if len(g.label):
                p = beliefs(g, held.value, params)
                best = p.argmax(axis=1)
                for u in np.flatnonzero((g.label > NONE) & (best < NONE) & (p.max(axis=1) >= params.certainty)).tolist():
                    added[g.doc[u]].append((int(best[u]), *g.span[u].tolist()))
            named = lambda rows: pa.array([[{"kind": KINDS[k], "start": a, "end": b} for k, a, b in sorted(r)] for r in rows], pa.list_(item))
            yield pa.record_batch([batch.column("doc_id"), named(bases), named(added)], names=["doc_id", "base", "added"])

    kind = "array<struct<kind: string, start: long, end: long>>"
    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_column().alias("text"))
    return source.mapInArrow(run, f"doc_id long, base {kind}, added {kind}")
