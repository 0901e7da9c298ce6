"""Jaccard join on word n-grams by token-combination prefixes.

1. `profiles`: set size and 128-bit fingerprint of every row's shingle set; shingles that many rows of a batch hold.
   Equal sets are one node from here on.
2. `shared_tokens`: shingle hashes travel in packed blocks, dealt by hash range; those of one node only stay behind.
   Every node gets back its shared shingles with their frequencies. Nodes with too few of them link with nothing.
3. `signatures`: tokens in order of frequency, rare first. Rare tokens of the prefix are indexed singly, frequent
   ones by pairs within their class; each class in a prefix extends it by one token, so that linked nodes share a
   signature (pigeonhole).
4. `links`: first every holder of a signature meets one leader; holders that then still differ in component from
   the signature's largest component meet all of the others. All candidates are verified on the shared tokens.
   Holders in one component need no further pairs, which keeps large groups of near copies linear.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import durable
from .common import WordHasher, chunks, components, mix, plain_words, release, text_column

# Text per hash range, and tokens a task holds before it passes them on.
RANGE_CHARS, HELD_TOKENS = 16_000_000, 800_000
HEAVY_SHARE, HEAVY_LEAST = 500, 16
# Bits for every row that bitmaps mark, bits at most (16 MB), and bits of one bitmap of bitmap_construct_agg.
MARK_BITS, MARK_MOST, MARK_EACH = 32, 1 << 27, 1 << 15
TABLE = pa.schema([("part", pa.int32()), ("fp1", pa.binary()), ("fp2", pa.binary()), ("n", pa.binary()), ("at", pa.binary()),
                   ("low", pa.binary()), ("high", pa.binary()), ("freq", pa.binary())])


@dataclass(frozen=True)
class JoinParams:
    words: int = 4
    percent: int = 85
    rare: int = 32
    class_tokens: int = 4


def shingles(hasher: WordHasher, texts: list[str], k: int) -> tuple[np.ndarray, np.ndarray]:
    """(sorted distinct shingle hashes of all texts one after another, how many each text has)."""
    h, doc, _, _ = hasher(texts)
    first = np.searchsorted(doc, np.arange(len(texts) + 1))
    counts = np.diff(first)
    with np.errstate(over="ignore"):
        rolled = h.copy()
        for j in range(1, k):
            rolled[: len(h) - j] = mix(rolled[: len(h) - j]) + h[j:]
        rolled = mix(rolled)
    sets, sizes = [], np.zeros(len(texts), np.int64)
    for i, n in enumerate(counts):
        if n == 0:
            continue
        if n < k:
            own = np.uint64(n)
            with np.errstate(over="ignore"):
                for x in h[first[i]: first[i + 1]]:
                    own = mix(np.array([own + x]))[0]
            sets.append(np.array([own], np.uint64))
        else:
            s = np.sort(rolled[first[i]: first[i + 1] - k + 1])
            sets.append(s[np.concatenate(([True], s[1:] != s[:-1]))])
        sizes[i] = len(sets[-1])
    return (np.concatenate(sets) if sets else np.zeros(0, np.uint64)), sizes


def fingerprints(tokens: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two 64-bit sums over every set; empty sets have 0."""
    out = []
    for salt in (0x51ED270B, 0x2545F491):
        with np.errstate(over="ignore"):
            total = np.concatenate((np.zeros(1, np.uint64), np.cumsum(mix(tokens ^ np.uint64(salt)), dtype=np.uint64)))
        ends = np.cumsum(sizes)
        with np.errstate(over="ignore"):
            out.append((total[ends] - total[ends - sizes]).view(np.int64))
    return out[0], out[1]


def profiles(docs: DataFrame, params: JoinParams, code: Column) -> DataFrame:
    """(doc_id, code, n, fp1, fp2) of every row, and rows with `heavy` tokens: hashes that at least one in HEAVY_SHARE sets of a batch holds."""
    k = params.words

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = WordHasher(plain_words())
        held, sets = [], 0

        def heavy() -> pa.RecordBatch | None:
            if not held:
                return None
            u, c = np.unique(np.concatenate(held), return_counts=True)
            often = c >= max(HEAVY_LEAST, sets // HEAVY_SHARE)
            if not often.any():
                return None
            none = pa.nulls(often.sum(), pa.int64())
            return pa.record_batch([none, none, pa.array(c[often]), pa.array(u[often].view(np.int64)), none, pa.array([True] * int(often.sum()))], names=names)

        names = ["doc_id", "code", "n", "fp1", "fp2", "heavy"]
        seen: set = set()
        for batch, texts in chunks(batches):
            tokens, sizes = shingles(hasher, texts, k)
            fp1, fp2 = fingerprints(tokens, sizes)
            yield pa.record_batch([batch.column("doc_id"), batch.column("code"), pa.array(sizes), pa.array(fp1), pa.array(fp2), pa.array([False] * len(texts))], names=names)
            new = np.array([(key not in seen, seen.add(key))[0] for key in zip(fp1.tolist(), fp2.tolist())])
            held.append(tokens[np.repeat(new, sizes)])
            sets += int(new.sum())
            if sum(map(len, held)) > HELD_TOKENS:
                if (rows := heavy()) is not None:
                    yield rows
                held, sets, seen = [], 0, set()
        if (rows := heavy()) is not None:
            yield rows

    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), code.alias("code"), text_column().alias("text"))
    return source.mapInArrow(run, "doc_id long, code long, n long, fp1 long, fp2 long, heavy boolean")


def pack(part: np.ndarray, parts: int, tokens: np.ndarray, node: np.ndarray, fp1: np.ndarray, fp2: np.ndarray, n: np.ndarray, freq: np.ndarray | None) -> pa.RecordBatch | None:
    """One row for each part: its nodes once, then hash differences (low 32 bits apart from the rest) with node numbers."""
    order = np.lexsort((tokens, part))
    part, tokens, node = part[order], tokens[order], node[order]
    edges = np.searchsorted(part, np.arange(parts + 1))
    rows: dict[str, list] = {name: [] for name in TABLE.names}
    for p in np.flatnonzero(np.diff(edges)):
        a, b = edges[p], edges[p + 1]
        own, at = np.unique(node[a:b], return_inverse=True)
        step = np.diff(tokens[a:b], prepend=np.uint64(0))
        high = step >> np.uint64(32)
        rows["part"].append(p)
        rows["fp1"].append(fp1[own].tobytes())
        rows["fp2"].append(fp2[own].tobytes())
        rows["n"].append(n[own].astype(np.int32).tobytes())
        rows["at"].append(at.astype(np.uint16 if len(own) <= 1 << 16 else np.uint32).tobytes())
        rows["low"].append((step & np.uint64(0xFFFFFFFF)).astype(np.uint32).tobytes())
        rows["high"].append(high[:1].tobytes() + high[1:].astype(np.uint16 if not len(high) > 1 or high[1:].max() < 1 << 16 else np.uint32).tobytes())
        rows["freq"].append(b"" if freq is None else freq[order][a:b].astype(np.int32).tobytes())
    if not rows["part"]:
        return None
    return pa.record_batch([pa.array(rows[f.name], f.type) for f in TABLE], schema=TABLE)


def unpack(table: pa.Table) -> tuple[np.ndarray, ...]:
    """(tokens, node number, fp1, fp2, n, freq) of all rows; nodes that came in several rows are one."""
    tokens, node, fps, ns, freqs, shift = [], [], [], [], [], 0
    for at_row in range(table.num_rows):
        r = {name: table.column(name)[at_row].as_py() for name in TABLE.names[1:]}
        low = np.frombuffer(r["low"], np.uint32)
        own = np.stack((np.frombuffer(r["fp1"], np.int64), np.frombuffer(r["fp2"], np.int64)))
        first, rest = np.frombuffer(r["high"][:8], np.uint64), r["high"][8:]
        high = np.concatenate((first, np.frombuffer(rest, np.uint16 if len(rest) == 2 * (len(low) - 1) else np.uint32).astype(np.uint64)))
        tokens.append(np.cumsum((high << np.uint64(32)) | low, dtype=np.uint64))
        at = np.frombuffer(r["at"], np.uint16 if len(r["at"]) == 2 * len(low) else np.uint32)
        node.append(at.astype(np.int32) + np.int32(shift))
        fps.append(own)
        ns.append(np.frombuffer(r["n"], np.int32))
        freqs.append(np.frombuffer(r["freq"], np.int32))
        shift += own.shape[1]
    fp = np.concatenate(fps, axis=1)
    order = np.lexsort((fp[1], fp[0]))
    new = np.concatenate(([True], (np.diff(fp[:, order]) != 0).any(axis=0)))
    number = np.empty(shift, np.int32)
    number[order] = np.cumsum(new, dtype=np.int32) - 1
    kept = order[new]
    return np.concatenate(tokens), number[np.concatenate(node)], fp[0, kept], fp[1, kept], np.concatenate(ns)[kept], np.concatenate(freqs)


HOT = (1 << 31) - 1
BITMAP = ("b0", "b1", "b2", "b3")


def shared_tokens(docs: DataFrame, heavy: np.ndarray, parts: int, params: JoinParams) -> DataFrame:
    """(fp1, fp2, n, tokens, freqs) of nodes that hold enough shared tokens to link; tokens by frequency, then hash."""
    k, percent = params.words, params.percent
    kind = "part int, fp1 binary, fp2 binary, n binary, at binary, low binary, high binary, freq binary"

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = WordHasher(plain_words())
        tokens, sizes, fps, seen = [], [], [], set()

        def flush() -> Iterator[pa.RecordBatch]:
            if not tokens:
                return
            t, n, fp = np.concatenate(tokens), np.concatenate(sizes), np.concatenate(fps, axis=1)
            node = np.repeat(np.arange(len(n), dtype=np.int32), n)
            often = np.zeros(len(t), bool)
            if len(heavy):
                at = np.minimum(np.searchsorted(heavy, t), len(heavy) - 1)
                often = heavy[at] == t
            part = ((t >> np.uint64(32)) * np.uint64(parts) >> np.uint64(32)).astype(np.int32)
            for some, owner, freq in ((~often, part, None), (often, (fp[0].view(np.uint64) % np.uint64(parts)).astype(np.int32)[node], np.full(len(t), HOT))):
                if some.any() and (rows := pack(owner[some] + (0 if freq is None else parts), 2 * parts, t[some], node[some], fp[0], fp[1], n, None if freq is None else freq[some])) is not None:
                    yield rows

        for _, texts in chunks(batches):
            t, n = shingles(hasher, texts, k)
            fp = np.stack(fingerprints(t, n))
            new = np.array([size > 0 and (key not in seen, seen.add(key))[0] for size, *key2 in zip(n.tolist(), *fp.tolist()) for key in (tuple(key2),)], bool)
            tokens.append(t[np.repeat(new, n)])
            sizes.append(n[new])
            fps.append(fp[:, new])
            if sum(map(len, tokens)) > HELD_TOKENS:
                yield from flush()
                tokens, sizes, fps, seen = [], [], [], set()
        yield from flush()

    def count(table: pa.Table) -> pa.Table:
        """Of one hash range: tokens of two nodes or more, dealt by node. Rows that are dealt by node pass."""
        if table.column("part")[0].as_py() >= parts:
            return table
        release()
        t, node, fp1, fp2, n, _ = unpack(table)
        order = np.lexsort((node, t))
        t, node = t[order], node[order]
        new = np.concatenate(([True], (t[1:] != t[:-1]) | (node[1:] != node[:-1])))
        t, node = t[new], node[new]
        start = np.concatenate(([True], t[1:] != t[:-1]))
        freq = np.diff(np.append(np.flatnonzero(start), len(t)))[np.cumsum(start) - 1]
        many = freq > 1
        owner = (fp1.view(np.uint64) % np.uint64(parts)).astype(np.int32)
        rows = pack(owner[node[many]] + parts, 2 * parts, t[many], node[many], fp1, fp2, n, freq[many])
        return TABLE.empty_table() if rows is None else pa.Table.from_batches([rows])

    def gather(table: pa.Table) -> pa.Table:
        release()
        t, node, fp1, fp2, n, freq = unpack(table)
        order = np.lexsort((t, freq, node))
        t, node, freq = t[order], node[order], freq[order]
        new = np.concatenate(([True], (t[1:] != t[:-1]) | (node[1:] != node[:-1])))
        t, node, freq = t[new], node[new], freq[new]
        edges = np.searchsorted(node, np.arange(len(n) + 1))
        enough = np.diff(edges) * 100 >= percent * n.astype(np.int64)
        keep = np.repeat(enough, np.diff(edges))
        offsets = pa.array(np.concatenate(([0], np.cumsum(np.diff(edges)[enough]))).astype(np.int32))
        lists = [pa.ListArray.from_arrays(offsets, pa.array(v[keep])) for v in (t.view(np.int64), freq.astype(np.int32))]
        return pa.table([pa.array(fp1[enough]), pa.array(fp2[enough]), pa.array(n[enough].astype(np.int64)), *lists], names=["fp1", "fp2", "n", "tokens", "freqs"])

    source = docs.select(text_column().alias("text"))
    counted = source.mapInArrow(cut, kind).groupBy("part").applyInArrow(count, kind)
    return counted.groupBy("part").applyInArrow(gather, "fp1 long, fp2 long, n long, tokens array<long>, freqs array<int>")


def band(n: float, percent: int) -> int:
    return math.floor(math.log(n) / -math.log(percent / 100))


def node_signatures(tokens: np.ndarray, freqs: np.ndarray, n: int, params: JoinParams) -> np.ndarray:
    """Signatures of one node under every size band in which it can meet a partner.

    A prefix leaves out at most need - 1 - e tokens, need the least overlap with any partner and e the classes of
    pairs in the prefix. Of two linked nodes, the one whose prefix ends first shares e + 1 tokens of its prefix with
    the other's, hence a rare token or two tokens of a class.
    """
    m, need = len(tokens), -(-params.percent * n // 100)
    out = []
    for b in range(band(n * (1 - 1e-9), params.percent), band(n * (100 / params.percent) * (1 + 1e-9), params.percent) + 1):
        typical = (100 / params.percent) ** b * (100 - params.percent) / 100
        classes = int(typical / params.class_tokens)
        paired = freqs > params.rare if classes else np.zeros(m, bool)
        cls = (mix(tokens) % np.uint64(max(classes, 1))).astype(np.int64)
        first = np.zeros(m, bool)
        at = np.flatnonzero(paired)
        first[at[np.unique(cls[at], return_index=True)[1]]] = True
        length = np.arange(m + 1)
        spared = length - np.concatenate(([0], np.cumsum(first)))
        q = int(np.searchsorted(spared, m - need + 1))
        if q > m:
            paired, q = np.zeros(m, bool), m - need + 1
        head, pairs = tokens[:q], paired[:q]
        out.append(head[~pairs])
        with np.errstate(over="ignore"):
            for c in np.unique(cls[:q][pairs]):
                own = np.sort(head[pairs & (cls[:q] == c)])
                i, j = np.triu_indices(len(own), 1)
                out.append(mix(mix(own[i]) + own[j] + np.uint64(b)))
    return np.unique(np.concatenate(out)) if out else np.zeros(0, np.uint64)


def signatures(nodes: DataFrame, params: JoinParams) -> DataFrame:
    """(sig, node, n, u, b0..b3) for every signature; u counts the tokens no other node holds, b0..b3 are a bitmap.

    A bit of the bitmap is the parity of the shared tokens that fall on it, so that two bitmaps differ in no more
    bits than the sets in tokens.
    """
    names = ["sig", "node", "n", "u", *BITMAP]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                t = np.asarray(batch.column("tokens")[i].values).view(np.uint64)
                n = batch.column("n")[i].as_py()
                sigs = node_signatures(t, np.asarray(batch.column("freqs")[i].values), n, params).view(np.int64)
                if len(sigs):
                    same = lambda v: pa.array(np.full(len(sigs), v, np.int64))  # noqa: E731,B023
                    bits = np.packbits(np.bincount((t >> np.uint64(56)).astype(np.int64), minlength=256) & 1).view(np.int64)
                    yield pa.record_batch([pa.array(sigs), same(batch.column("node")[i].as_py()), same(n), same(n - len(t)), *map(same, bits)], names=names)

    return nodes.select("node", "n", "tokens", "freqs").mapInArrow(run, ", ".join(f"{c} long" for c in names))


def possible(a: str, b: str, percent: int):
    """Whether sizes, unshared tokens and bitmaps of two nodes leave room for a link."""
    c = lambda s, x: F.col(f"{s}.{x}")
    both = c(a, "n") + c(b, "n")
    room = F.least(c(a, "n") - c(a, "u"), c(b, "n") - c(b, "u"))
    apart = c(a, "u") + c(b, "u") + reduce(lambda x, y: x + y, (F.bit_count(c(a, x).bitwiseXOR(c(b, x))) for x in BITMAP))
    return (100 * F.least(c(a, "n"), c(b, "n")) >= percent * F.greatest(c(a, "n"), c(b, "n"))) & ((100 + percent) * room >= percent * both) & ((100 + percent) * (both - apart) >= 2 * percent * both)


def verified(pairs: DataFrame, nodes: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) of nodes that link."""
    side = lambda x: nodes.select(F.col("node").alias(x), F.col("n").alias(f"n{x}"), F.col("tokens").alias(f"t{x}"))
    both = pairs.join(side("a"), "a").join(side("b"), "b").withColumn("common", F.size(F.array_intersect("ta", "tb")))
    return both.filter(100 * F.col("common") >= percent * (F.col("na") + F.col("nb") - F.col("common"))).select("a", "b")


def links(nodes: DataFrame, params: JoinParams) -> DataFrame:
    """Links between nodes that connect just the nodes that all links would connect."""
    held = durable(signatures(nodes, params))
    leader = held.groupBy("sig").agg(F.min(F.struct("u", "node", "n", *BITMAP)).alias("lead"), F.count("*").alias("held")).filter("held > 1")
    leader = leader.select("sig", "lead.*")
    pair = lambda x, y: (F.least(f"{x}.node", f"{y}.node").alias("a"), F.greatest(f"{x}.node", f"{y}.node").alias("b"))
    close = possible("x", "y", params.percent)
    first = held.alias("x").join(leader.alias("y"), "sig").filter((F.col("x.node") != F.col("y.node")) & close).select(*pair("x", "y")).distinct()
    found = durable(verified(first, nodes, params.percent))
    label = components(found)
    named = held.join(label, "node", "left").withColumn("component", F.coalesce("component", "node"))
    open_ = named.groupBy("sig", "component").agg(F.count("*").alias("c"))
    largest = open_.groupBy("sig").agg(F.max(F.struct("c", "component")).alias("top"), F.count("*").alias("k")).filter("k > 1").select("sig", F.col("top.component").alias("top"))
    rest = durable(named.join(largest, "sig"))
    apart = rest.filter("component != top").alias("x").join(rest.alias("y"), "sig").filter(
        (F.col("x.component") != F.col("y.component")) & ((F.col("y.component") == F.col("y.top")) | (F.col("x.node") < F.col("y.node"))) & close)
    second = apart.select(*pair("x", "y")).distinct()
    return found.union(verified(second, nodes, params.percent))


def grouped(docs: DataFrame, params: JoinParams, code: Column, first: Column) -> tuple[DataFrame, DataFrame]:
    """(doc_id, code, n, fp1, fp2) of every row, and (fp1, fp2, c) of every set that is not empty.

    c is the least of ``first``, an expression on the rows, over all rows that links reach.
    """
    seen = durable(profiles(docs, params, code))
    rows = seen.filter(~F.col("heavy")).drop("heavy")
    sets = rows.agg(F.count("*")).first()[0]
    # At most 2 * HEAVY_SHARE times the mean set size: the sum of a token's counts is at least this share of all sets.
    often = seen.filter("heavy").groupBy("fp1").agg(F.sum("n").alias("n")).filter(F.col("n") >= max(HEAVY_LEAST, sets // (2 * HEAVY_SHARE)))
    heavy = np.sort(np.array([r[0] for r in often.select("fp1").collect()], np.int64).view(np.uint64))
    chars = docs.agg(F.sum(F.length(text_column()))).first()[0] or 0
    nodes = durable(shared_tokens(docs, heavy, max(4, -(-chars // RANGE_CHARS)), params))
    nodes = durable(nodes.withColumn("node", F.monotonically_increasing_id()))
    label = components(links(nodes.select("node", "n", "tokens", "freqs"), params))
    keys = rows.filter("n > 0").groupBy("fp1", "fp2").agg(F.min(first).alias("least"))
    linked = keys.join(nodes.join(label, "node").select("fp1", "fp2", "component"), ["fp1", "fp2"], "left")
    least = linked.filter("component is not null").groupBy("component").agg(F.min("least").alias("c"))
    return rows, linked.join(least, "component", "left").select("fp1", "fp2", F.coalesce("c", "least").alias("c"))


def join_components(docs: DataFrame, params: JoinParams = JoinParams()) -> DataFrame:
    """(doc_id, n_shingles, component_id) of every row of docs.

    component_id is the smallest doc_id that links reach. Rows without words or text have no shingles and stand
    alone, as do rows without a doc_id (component null). Rows that repeat a doc_id are rows of their own. Other
    columns of docs are not read; an empty table gives no rows. Shingles compare by 64-bit hashes.
    """
    rows, keys = grouped(docs, params, F.lit(0).cast("long"), F.col("doc_id"))
    return rows.join(keys, ["fp1", "fp2"], "left").select(
        "doc_id", F.col("n").alias("n_shingles"),
        F.when(F.col("n") == 0, F.col("doc_id")).when(F.col("doc_id").isNotNull(), F.col("c")).alias("component_id"),
    )


def marked(docs: DataFrame, code: Column, keys: DataFrame, key_code: Column) -> DataFrame:
    """docs with `_marked`: true wherever a row of keys has the same code, and on few other rows.

    Bitmaps of the codes are broadcast, so that docs stay where they are. Their size is bounded: with more than
    MARK_MOST / MARK_BITS rows of keys, more of the other rows are marked, never fewer of the right ones.
    """
    bits = min(MARK_MOST, max(MARK_EACH, MARK_BITS * keys.count()))
    run, at = (lambda c: F.floor(F.pmod(c, F.lit(bits)) / MARK_EACH)), (lambda c: F.pmod(c, F.lit(bits)) % MARK_EACH)
    maps = keys.groupBy(run(key_code).alias("_run")).agg(F.bitmap_construct_agg(at(key_code)).alias("_bits"))
    byte = F.conv(F.hex(F.substring("_bits", (F.floor(at(code) / 8) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
    known = docs.join(F.broadcast(maps), run(code) == F.col("_run"), "left")
    return known.withColumn("_marked", F.coalesce(F.getbit(byte, (at(code) % 8).cast("int")) == 1, F.lit(False))).drop("_run", "_bits")


def one_of_each(docs: DataFrame, params: JoinParams = JoinParams()) -> DataFrame:
    """One row of docs for every component, and all rows without words.

    The row with the smallest doc_id stays (none counts as largest), of equal ids the one with the smaller hash of its
    text, of rows equal in both the one with the smallest other columns. So a text that shares its id with a copy of
    another stays, and copies without an id and repeated rows go. Columns are those of docs; an empty table gives none.
    """
    text_hash = F.xxhash64(text_column())
    place = F.struct(F.col("doc_id").isNull().alias("without"), "doc_id", "code")
    rows, keys = grouped(docs, params, text_hash, place)
    # Rows of one id and text are in one component, so that what happens to them is decided once for all.
    alike = rows.filter("n > 0").groupBy("fp1", "fp2", "doc_id", "code").agg(F.count("*").alias("times"))
    decided = alike.join(keys, ["fp1", "fp2"]).withColumn("stays", place == F.col("c")).filter(~F.col("stays") | (F.col("times") > 1))
    decided = durable(decided.select(F.col("doc_id").alias("_of_id"), F.col("code").alias("_of_text"), F.col("stays").alias("_stays")))
    names = docs.columns
    either = marked(docs, F.xxhash64(F.col("doc_id").cast("long"), text_hash), decided, F.xxhash64("_of_id", "_of_text"))
    # Rows without a mark stay unseen by any join: their texts do not move.
    some = either.filter("_marked").drop("_marked")
    same = some["doc_id"].cast("long").eqNullSafe(F.col("_of_id")) & (text_hash == F.col("_of_text"))
    once = either.filter(~F.col("_marked")).drop("_marked").union(some.join(decided, same, "left_anti"))
    if not decided.filter("_stays").limit(1).count():
        return once
    repeated = some.join(decided.filter("_stays"), same).groupBy("_of_id", "_of_text").agg(F.min(F.struct(*names)).alias("_row"))
    return once.unionByName(repeated.select("_row.*"))
