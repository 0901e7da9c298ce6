"""Sliced numbering against brute force, with a key and a value that hold most of the rows."""

import random

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tallyworks.functions.ordering import number_rows, percent_rank, tile, with_global_order


def rows(n=600):
    rng = random.Random(7)
    return [("hot" if i % 3 else f"k{rng.randrange(9)}", rng.choice([None, 1.0, 1.0, 1.0, rng.randrange(50) * 1.0]), i) for i in range(n)]


def test_number_rows_with_a_hot_key(spark):
    data = rows()
    df = spark.createDataFrame(data, "k string, v double, id long")
    got = {r.id: (r.seq, r.head) for r in number_rows(
        df, ["k"], [F.col("v").isNull(), F.col("v"), F.col("id")], "seq", {"head": "id"}, slices=7).collect()}
    for key in {d[0] for d in data}:
        mine = sorted((d for d in data if d[0] == key), key=lambda d: (d[1] is None, d[1] or 0, d[2]))
        assert [got[d[2]] for d in mine] == [(i + 1, mine[0][2]) for i in range(len(mine))]


def test_global_order_with_ties_across_slices(spark):
    data = rows()
    df = spark.createDataFrame(data, "k string, v double, id long")
    out = with_global_order(df, [F.col("v").isNull(), F.col("v")], [F.col("id")], "pos", rank="rank", total="n", slices=9)
    got = {r.id: r for r in out.select("*", tile(F.col("pos"), F.col("n"), 7).alias("t"), percent_rank(F.col("rank"), F.col("n")).alias("p")).collect()}
    ordered = sorted(data, key=lambda d: (d[1] is None, d[1] or 0, d[2]))
    n, base, extra = len(data), len(data) // 7, len(data) % 7
    sizes = [base + (i < extra) for i in range(7)]
    tiles = [i + 1 for i, s in enumerate(sizes) for _ in range(s)]
    first = {}
    for i, d in enumerate(ordered):
        first.setdefault(d[1], i + 1)
        assert got[d[2]].pos == i + 1 and got[d[2]].t == tiles[i]
        assert got[d[2]].rank == first[d[1]] and got[d[2]].p == (first[d[1]] - 1) / (n - 1)


@settings(max_examples=5, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(st.sampled_from("ab"), st.integers(0, 3)), min_size=1, max_size=40), st.integers(2, 6))
def test_number_rows_property(spark, data, slices):
    data = [(k, v, i) for i, (k, v) in enumerate(data)]
    df = spark.createDataFrame(data, "k string, v long, id long")
    got = {r.id: r.seq for r in number_rows(df, ["k"], [F.col("v"), F.col("id")], "seq", slices=slices).collect()}
    for key in "ab":
        mine = sorted((d for d in data if d[0] == key), key=lambda d: d[1:])
        assert [got[d[2]] for d in mine] == list(range(1, len(mine) + 1))


def test_small_tables_and_one_row(spark):
    df = spark.createDataFrame([(1.0, 1)], "v double, id long")
    row = with_global_order(df, [F.col("v")], [F.col("id")], "pos", rank="rank", total="n").select(
        tile(F.col("pos"), F.col("n"), 5).alias("t"), percent_rank(F.col("rank"), F.col("n")).alias("p")).collect()[0]
    assert (row.t, row.p) == (1, 0.0)
