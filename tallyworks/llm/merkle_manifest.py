"""Merkle manifest of a table: one tree per group, one tree over the groups' roots, and a proof for every row.

Trees are built in runs of RUN consecutive nodes, SPAN levels at a time, so a table of n rows takes log(n) / SPAN
exchanges, each of a 64th of the rows before it, and no task ever sees more than RUN nodes of a tree at once, however
large a group is. Every node then points to the top of its run and holds the segment of siblings up to it. Pointer
jumping does the rest: each self-join of the nodes appends to a segment the segment of the node it points to, which
doubles the distance, until all point past the root; leaves make the last jump.

Rows are ordered by their key, rows of one key by their hash; null keys come first. Null fields count as ``-``. Equal
rows are leaves of their own with equal hashes. An empty table gives no rows and has no root. Columns that are not
among the fields are not read. A tampered row without n_chars is left as it is, so it verifies.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.ordering import SLICE_ROWS, number_rows
from ..session import durable

SPAN = 6
RUN = 1 << SPAN
# Tables of at most this many rows are sent to every task: group sizes, and nodes with their segments.
SMALL_ROWS = 20_000
# The tree over the groups' roots; groups count from 0.
TOP = -1


@dataclass(frozen=True)
class ManifestParams:
    fields: tuple[str, ...] = ("doc_id", "source", "lang", "n_chars", "text")
    group: str = "lang"
    key: str = "doc_id"
    counter: str = "n_chars"
    every: int = 7


def digest(*hexes: Column) -> Column:
    """Lower-case hex of the hash of hex texts put together."""
    return F.sha2(F.concat(*hexes), 256)


def to_hex(raw: Column) -> Column:
    return F.lower(F.hex(raw))


def leaf_hash(fields: list[Column]) -> Column:
    """Hash of a row: every field as its length in bytes and its value, nulls as a dash."""
    texts = [f.cast("string") for f in fields]
    return digest(*[F.coalesce(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t), F.lit("-")) for t in texts])


def small(df: DataFrame, rows: int) -> DataFrame:
    return F.broadcast(df) if rows <= SMALL_ROWS else df


def leaves(rows: DataFrame, params: ManifestParams) -> DataFrame:
    """(grp, key, h, forged) of every row; forged is the hash after tampering, null where the row is left alone."""
    fields = [F.col(f) for f in params.fields]
    changed = [F.col(f) + 1 if f == params.counter else F.col(f) for f in params.fields]
    key = F.col(params.key).cast("long")
    tampered = F.crc32(key.cast("string")) % params.every == 0
    return rows.select(
        F.col(params.group).cast("string").alias("grp"), key.alias("key"), F.unhex(leaf_hash(fields)).alias("h"),
        F.when(tampered, F.unhex(leaf_hash(changed))).alias("forged"),
    )


def slices(df: DataFrame, rows: int) -> int:
    return max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-rows // SLICE_ROWS))


def placed(rows: DataFrame, params: ManifestParams) -> tuple[DataFrame, int, int]:
    """Leaves with their tree, position and tree size; number of trees; size of the largest."""
    hashed = durable(leaves(rows, params))
    numbered = durable(number_rows(hashed, ["grp"], [F.col("key"), F.col("h")], "at", slices=slices(hashed, hashed.count())))
    sizes = durable(numbered.groupBy("grp").agg(F.count(F.lit(1)).alias("n")))
    trees, most = sizes.agg(F.count(F.lit(1)), F.coalesce(F.max("n"), F.lit(0))).first()
    ordered = durable(number_rows(sizes, [], [F.col("grp")], "tree", slices=slices(sizes, trees)).withColumn("tree", F.col("tree") - 1))
    known = small(ordered.withColumnRenamed("grp", "_grp"), trees)
    found = numbered.join(known, numbered["grp"].eqNullSafe(known["_grp"]))
    return found.select("tree", "n", (F.col("at") - 1).alias("pos"), "key", "h", "forged"), trees, most


def level_above(below: Column) -> Column:
    """Hashes of every two consecutive nodes, of the last one alone where their number is odd."""
    pair = lambda j: F.unhex(digest(to_hex(F.get(below, 2 * j)), F.coalesce(to_hex(F.get(below, 2 * j + 1)), F.lit(""))))
    return F.transform(F.sequence(F.lit(0), F.shiftright(F.size(below) - 1, 1)), pair)


def runs(nodes: DataFrame, *payload: str) -> DataFrame:
    """Runs of RUN nodes: (tree, run, n, members, levels, top); levels[i] are the hashes i levels up, top the last."""
    member = F.struct("pos", "h", *payload)
    grouped = nodes.groupBy("tree", F.shiftright("pos", SPAN).alias("run"), "n").agg(F.array_sort(F.collect_list(member)).alias("members"))
    # A run below others is reduced through all its levels, even when it is the last and shorter; a whole tree until one node is left.
    height = sum((F.col("n") > (1 << i)).cast("int") for i in range(SPAN))
    out = grouped.withColumn("height", height).withColumn("l0", F.col("members.h"))
    for i in range(SPAN):
        out = out.withColumn(f"l{i + 1}", F.when(F.col("height") > i, level_above(F.col(f"l{i}"))).otherwise(F.col(f"l{i}")))
    return out.select(
        "tree", "run", "n", "members", F.array(*[F.slice(f"l{i}", 1, F.when(F.col("height") > i, F.size(f"l{i}")).otherwise(0)) for i in range(SPAN)]).alias("levels"),
        "height", F.col(f"l{SPAN}")[0].alias("top"),
    )


def segment(at: Column) -> Column:
    """Siblings of member ``at`` (its index in the run) up to the top of the run; h is null where there is none."""
    steps = []
    for i in range(SPAN):
        here = F.shiftright(at, i)
        steps.append(F.struct(F.get(F.get("levels", F.lit(i)), here.bitwiseXOR(F.lit(1))).alias("h"), (here.bitwiseAND(F.lit(1)) == 1).alias("left")))
    return F.slice(F.array(*steps), F.lit(1), F.col("height"))


def ancestor(level: int) -> list[Column]:
    """(up_tree, up_level, up_pos, subroot): the node a run ends in. The root of a group's tree is a leaf of the top tree."""
    inside, group = F.col("n") > RUN, F.col("tree") != TOP
    return [
        F.when(inside, F.col("tree")).when(group, F.lit(TOP)).cast("long").alias("up_tree"),
        F.when(inside, F.lit(level + 1)).when(group, F.lit(0)).cast("int").alias("up_level"),
        F.when(inside, F.col("run")).when(group, F.col("tree")).cast("long").alias("up_pos"),
        F.when(~inside & group, F.col("top")).alias("subroot"),
    ]


def tops(stored: DataFrame) -> DataFrame:
    """The tops of runs as nodes of the next level."""
    return stored.filter(F.col("n") > RUN).select("tree", F.ceil(F.col("n") / RUN).cast("long").alias("n"), F.col("run").alias("pos"), F.col("top").alias("h"))


def depth(n: int) -> int:
    """Levels of runs of a tree with n leaves."""
    levels = 1
    while n > RUN:
        n, levels = -(-n // RUN), levels + 1
    return levels


def pointers(stored: DataFrame, level: int) -> DataFrame:
    """Every member of the runs as a node with its pointer and segment."""
    rows = stored.select("*", F.posexplode("members").alias("i", "member"))
    return rows.select("tree", F.lit(level).alias("level"), F.col("member.pos").alias("pos"), *ancestor(level), F.col("top"), segment(F.col("i")).alias("path"))


def jumped(nodes: DataFrame, far: DataFrame, *keep: str) -> DataFrame:
    """nodes whose pointer is replaced by the pointer of the node it shows, and whose segment grows by that one's."""
    to = far.select(*[F.col(c).alias(f"_{c}") for c in far.columns])
    match = (F.col("up_tree") == F.col("_tree")) & (F.col("up_level") == F.col("_level")) & (F.col("up_pos") == F.col("_pos"))
    return nodes.join(to, match, "left").select(
        *keep, F.col("_up_tree").alias("up_tree"), F.col("_up_level").alias("up_level"), F.col("_up_pos").alias("up_pos"),
        F.coalesce("subroot", "_subroot").alias("subroot"), F.coalesce("_top", "top").alias("top"),
        F.concat("path", F.coalesce("_path", F.slice("path", 1, 0))).alias("path"),
    )


def inner_nodes(lowest: DataFrame, trees: int, most: int) -> DataFrame:
    """All nodes above the leaves, each with its segment up to the root."""
    found, level, stored = [], 0, lowest
    for level in range(1, depth(most)):
        stored = durable(runs(tops(stored)))
        found.append((stored, level))
        lowest = lowest.select("tree", "n", "top").unionByName(stored.select("tree", "n", "top"))
    subroots = lowest.filter(F.col("n") <= RUN).select(F.lit(TOP).cast("long").alias("tree"), F.lit(trees).cast("long").alias("n"), F.col("tree").alias("pos"), F.col("top").alias("h"))
    stored = durable(runs(subroots))
    found.append((stored, 0))
    for level in range(1, depth(trees)):
        stored = durable(runs(tops(stored)))
        found.append((stored, level))
    nodes = None
    for stored, level in found:
        part = pointers(stored, level)
        nodes = part if nodes is None else nodes.unionByName(part)
    nodes = durable(nodes)
    reach = 1
    while reach < depth(most) - 1 + depth(trees):
        nodes = durable(jumped(nodes, small(nodes, nodes.count()), "tree", "level", "pos"))
        reach *= 2
    return nodes


def folded(start: Column, path: Column) -> Column:
    """The root that a leaf and its siblings give."""
    def step(acc: Column, s: Column) -> Column:
        other = F.coalesce(to_hex(s["h"]), F.lit(""))
        return F.when(s["left"], digest(other, acc)).otherwise(digest(acc, other))

    return F.aggregate(path, start, step)


def manifest(rows: DataFrame, params: ManifestParams = ManifestParams()) -> DataFrame:
    """(key, leaf, subroot, root, path, forged) of every row; path has the siblings from leaf to root."""
    placed_rows, trees, most = placed(rows, params)
    lowest = durable(runs(placed_rows, "key", "forged"))
    nodes = inner_nodes(lowest, trees, most)
    # Runs, not leaves, are joined to the node above them: one row stands for up to RUN leaves, so no key is hot.
    pointing = lowest.select("members", "levels", "height", *ancestor(0), "top", F.array().cast(nodes.schema["path"].dataType).alias("path"))
    rooted = jumped(pointing, small(nodes, nodes.count()), "members", "levels", "height")
    leaf = F.posexplode("members").alias("i", "member")
    return rooted.select("*", leaf).select(
        F.col("member.key").alias("key"), to_hex(F.col("member.h")).alias("leaf"), to_hex(F.col("subroot")).alias("subroot"),
        to_hex(F.col("top")).alias("root"), F.concat(segment(F.col("i")), F.col("path")).alias("path"), to_hex(F.col("member.forged")).alias("forged"),
    )


def proofs(rows: DataFrame, params: ManifestParams = ManifestParams()) -> DataFrame:
    """(key, leaf, subroot, root, proof_sha256, folded_root, verified) of every row."""
    siblings = F.filter(F.transform("path", lambda s: to_hex(s["h"])), lambda h: h.isNotNull())
    found = manifest(rows, params).withColumn("folded_root", folded(F.coalesce("forged", "leaf"), F.col("path")))
    return found.select("key", "leaf", "subroot", "root", F.sha2(F.array_join(siblings, ""), 256).alias("proof_sha256"), "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"))
