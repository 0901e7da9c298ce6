"""Copies, proofs and clusters against plain versions, on random and awkward tables."""

import hashlib
import random
import zlib

import pytest
from pyspark.sql import functions as F

from tallyworks.llm import bisector_clusters, hash_index, merkle_manifest
from tallyworks.llm.bisector_clusters import ClusterParams

from .cases import SCHEMA, clashing, frame, rows


def sha(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def listed(df):
    return sorted(map(repr, (tuple(r) for r in df.collect())))


# Exact copies

BLANK = str.maketrans("", "", " \t\n\v\f\r")


def plain_groups(data):
    """(doc_id, keep_id, size, text_sha256) of (doc_id, text) rows, and the number of groups."""
    groups = {}
    for doc_id, text in data:
        groups.setdefault((text or "").translate(BLANK), []).append((-len(text or ""), doc_id is None, doc_id or 0, doc_id))
    out = []
    for doc_id, text in data:
        body = (text or "").translate(BLANK)
        out.append((doc_id, min(groups[body])[3], len(groups[body]), sha(body)))
    return sorted(map(repr, out)), len(groups)


def check_groups(df, data, params=hash_index.IndexParams()):
    got = hash_index.groups(df, params).collect()
    want, groups = plain_groups(data)
    assert sorted(repr((r.doc_id, r.keep_id, r.group_size, r.text_sha256)) for r in got) == want
    assert sum(r.kept for r in got) == groups
    assert all(r.doc_id == r.keep_id for r in got if r.kept)


def test_copies_of_awkward_rows(spark):
    data = [(r[0], r[1]) for r in rows()]
    check_groups(frame(spark), data)
    assert listed(hash_index.groups(clashing(frame(spark)))) == listed(hash_index.groups(frame(spark)))
    assert hash_index.groups(frame(spark, [])).collect() == []


@pytest.mark.parametrize("code", [hash_index.sha_code, lambda d: d[0] % 3 - 1])
def test_copies_under_colliding_codes_and_tiny_buckets(spark, code):
    r = random.Random(5)
    texts = ["".join(r.choice("ab \n") for _ in range(r.randrange(9))) for _ in range(150)] + ["hot text " * 40] * 120 + ["hot\ttext " * 40 + " "] * 40
    r.shuffle(texts)
    data = [(r.randrange(200), t) for t in texts]
    df = spark.createDataFrame(data, "doc_id long, text string").repartition(9)
    check_groups(df, data, hash_index.IndexParams(bucket_bytes=300, buffer_bytes=500, code=code))


def test_directory_splits_until_buckets_fit(spark):
    entries = spark.range(3000).select(F.xxhash64("id").alias("code"), F.lit(b"x" * 100).alias("body"))
    # A third of the codes share their first bits.
    entries = entries.union(spark.range(1500).select((F.col("id") * (1 << 46)).alias("code"), F.lit(b"x" * 100).alias("body")))
    held = hash_index.directory(entries, hash_index.IndexParams(bucket_bytes=20_000))
    sizes = entries.withColumn("cell", hash_index.cell()).join(held.cells, "cell").groupBy("owner").agg((F.count("*") * 164).alias("bytes")).collect()
    assert held.pages == 0 and held.owners == len(sizes)
    assert max(s.bytes for s in sizes) <= 20_000
    assert {s.owner for s in sizes} == set(range(held.owners))


# Manifest


def plain_tree(hashes):
    """All levels, the leaves first."""
    levels = [hashes]
    while len(levels[-1]) > 1:
        below = levels[-1]
        levels.append([sha("".join(below[i: i + 2])) for i in range(0, len(below), 2)])
    return levels


def plain_proof(levels, at):
    """[(sibling or empty, whether it stands left)] from a leaf to the top."""
    out = []
    for level in levels[:-1]:
        out.append((level[at ^ 1] if (at ^ 1) < len(level) else "", at % 2 == 1))
        at //= 2
    return out


def plain_manifest(data):
    def leaf(row, add=0):
        doc_id, text, lang, source, n = row
        fields = (doc_id, source, lang, None if n is None else n + add, text)
        return sha("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in fields))

    groups = {}
    for row in data:
        groups.setdefault(row[2], []).append(row)
    order = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    trees = {}
    for g in order:
        groups[g].sort(key=lambda row: (row[0] is not None, row[0] or 0, leaf(row)))
        trees[g] = plain_tree([leaf(row) for row in groups[g]])
    top = plain_tree([trees[g][-1][0] for g in order])
    out = []
    for i, g in enumerate(order):
        for at, row in enumerate(groups[g]):
            path = plain_proof(trees[g], at) + plain_proof(top, i)
            acc = leaf(row, int(row[0] is not None and zlib.crc32(str(row[0]).encode()) % 7 == 0))
            for other, left in path:
                acc = sha(other + acc if left else acc + other)
            out.append((row[0], leaf(row), trees[g][-1][0], top[-1][0], sha("".join(o for o, _ in path)), acc, acc == top[-1][0]))
    return sorted(map(repr, out))


def test_manifest_of_awkward_rows(spark):
    assert listed(merkle_manifest.proofs(frame(spark))) == plain_manifest(rows())
    assert listed(merkle_manifest.proofs(clashing(frame(spark)))) == plain_manifest(rows())
    assert merkle_manifest.proofs(frame(spark, [])).collect() == []


@pytest.mark.parametrize("sizes", [[64], [1, 3, 63, 129], [4097, 5], [1] * 70])
def test_manifest_of_trees_of_many_shapes(spark, sizes):
    r = random.Random(len(sizes))
    data = [(r.randrange(10_000), f"text {i}", None if g == 1 else f"l{g:03}", None, i) for g, n in enumerate(sizes) for i in range(n)]
    got = merkle_manifest.proofs(spark.createDataFrame(data, SCHEMA))
    assert listed(got) == plain_manifest(data)
    assert any(not x.verified for x in got.collect()) or len(data) < 70


def test_manifest_joins_where_nothing_is_small(spark, monkeypatch):
    monkeypatch.setattr(merkle_manifest, "SMALL_ROWS", -1)
    data = [(i, f"text {i}", f"l{i % 3}", "s", i) for i in range(400)]
    assert listed(merkle_manifest.proofs(spark.createDataFrame(data, SCHEMA))) == plain_manifest(data)


# Clusters


def plain_clusters(data, p):
    kept = []
    for vec_id, v in data:
        if v is not None and len(v) == p.size and all(c is not None and c == c and abs(c) * p.scale < 2**53 for c in v):
            kept.append((vec_id, [int(c * p.scale // 1) for c in v]))
    if not kept:
        return []
    seeds = sorted(kept, key=lambda r: (r[0] is None, sha(f"{p.seed}:{r[0]}") if r[0] is not None else "", r[1]))
    centroids = [list(v) for _, v in seeds[: p.clusters]]
    away = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b))
    nearest = lambda v: min(range(len(centroids)), key=lambda c: (away(v, centroids[c]), c))
    for _ in range(p.rounds):
        won = {}
        for _, v in kept:
            won.setdefault(nearest(v), []).append(v)
        for c, members in won.items():
            centroids[c] = [sum(col) // len(members) for col in zip(*members)]
    found = [(vec_id, nearest(v), away(v, centroids[nearest(v)])) for vec_id, v in kept]
    long = lambda x: x if x < 2**63 else None
    return sorted(repr((i, c, long(d), long(sum(e for _, b, e in found if b == c)), long(sum(e for *_, e in found)), sha(",".join(map(str, centroids[c]))))) for i, c, d in found)


def vectors(spark, data):
    return spark.createDataFrame(data, "vec_id long, embedding array<double>, label int")


@pytest.mark.parametrize("spread", [0.02, 3e7, 1e12])
def test_clusters_at_every_magnitude(spark, spread):
    r = random.Random(11)
    p = ClusterParams(size=3, clusters=7, rounds=3)
    data = [(i, [round(r.uniform(-spread, spread), 3) for _ in range(3)]) for i in range(120)]
    data += [(i, list(v)) for i, v in data[:20]] + [(None, [0.0, 0.0, 0.0]), (500, [0.0, 0.0, 0.0])]
    got = bisector_clusters.clustered(vectors(spark, [(*d, 1) for d in data]), p)
    assert listed(got) == plain_clusters(data, p)


def test_clusters_drop_what_is_no_vector(spark):
    p = ClusterParams(size=2, clusters=4, rounds=2)
    data = [(1, [0.5, 0.5]), (2, None), (3, []), (4, [1.0]), (5, [1.0, None]), (6, [float("nan"), 1.0]), (7, [float("inf"), 1.0]),
            (8, [1.0, 2.0, 3.0]), (9, [0.5, -0.5]), (None, [3.0, 3.0]), (1, [0.5, 0.5]), (10, [-1e-9, 1e300])]
    df = vectors(spark, [(*d, None) for d in data])
    assert listed(bisector_clusters.clustered(df, p)) == plain_clusters(data, p)
    more = df.select("*", *[F.lit("own").alias(c) for c in ("x", "cluster", "distance", "n", "total")])
    assert listed(bisector_clusters.clustered(more, p)) == plain_clusters(data, p)
    assert bisector_clusters.clustered(df.filter("vec_id = 2"), p).collect() == []


def test_ties_go_to_the_smaller_number():
    import numpy as np

    planes = bisector_clusters.Bisectors([[0, 0], [2, 0], [0, 0], [4, 0]], 9)
    x = np.array([[1.0, 5.0], [3.0, 0.0], [0.0, 0.0], [9.0, 9.0]])
    assert planes.nearest(x).tolist() == [0, 1, 0, 3]
    assert planes.distance(x, planes.nearest(x)).tolist() == [26, 1, 0, 106]
