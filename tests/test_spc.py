"""Run rules against a direct evaluation, block borders and capability edges."""

import random
from datetime import date

import pytest
from pyspark.sql import functions as F

from tallyworks.operators import spc as op

LIMITS_DDL = "param string, n int, cl double, ucl double, lcl double, s double, rbar double, rucl double, rlcl double, sigma double"


def stats(spark, means, ranges=None):
    rows = [("p", i + 1, date(2026, 6, 1), 4, float(m), float((ranges or [1.0] * len(means))[i])) for i, m in enumerate(means)]
    return spark.createDataFrame(rows, "param string, subgroup long, date date, n long, mean double, range double")


def unit_limits(spark):
    return spark.createDataFrame([("p", 4, 0.0, 3.0, -3.0, 1.0, 1.0, 2.282, 0.0, 0.5)], LIMITS_DDL)


def hits(spark, means, ranges=None, **kw):
    rows = op.nelson(stats(spark, means, ranges), unit_limits(spark), **kw).orderBy("subgroup").collect()
    return [r.hits for r in rows], [r.range_hit for r in rows]


def brute(z):
    out = []
    for i, v in enumerate(z):
        found = []
        back = lambda k: z[i - k + 1:i + 1] if i >= k - 1 else []  # noqa: E731,B023
        if abs(v) > 3:
            found.append(1)
        nine = back(9)
        if nine and (min(nine) > 0 or max(nine) < 0):
            found.append(2)
        six = back(6)
        steps = [b - a for a, b in zip(six, six[1:])]
        if steps and (min(steps) > 0 or max(steps) < 0):
            found.append(3)
        for rule, k, need, far in ((5, 3, 2, 2), (6, 5, 4, 1)):
            last = back(k)
            if last and abs(v) > far and (sum(x > far for x in last) >= need or sum(x < -far for x in last) >= need):
                found.append(rule)
        out.append(found)
    return out


@pytest.mark.parametrize("block", [8, 9, 16, 4096])
def test_rules_equal_direct_evaluation_at_any_block(spark, block):
    rng = random.Random(block)
    z = [round(rng.gauss(0, 1.3), 1) + (1.5 if 40 < i < 70 else 0) + (i - 100) * 0.1 * (100 < i < 130) for i in range(180)]
    assert hits(spark, z, block=block)[0] == brute(z)


def test_rule_edges(spark):
    assert hits(spark, [3.0, 3.1])[0] == [[], [1]]
    assert 2 not in hits(spark, [0.5] * 8 + [0.0])[0][8] and 2 in hits(spark, [0.5] * 9)[0][8]
    assert 3 not in hits(spark, [0, .1, .2, .3, .3, .4])[0][5] and 3 in hits(spark, [0, .1, .2, .3, .4, .5])[0][5]
    assert hits(spark, [2.5, 2.5, 0.0])[0][2] == []
    assert 5 in hits(spark, [2.5, 2.5, -2.1])[0][2]
    assert hits(spark, [0, 0], [2.282, 2.283])[1] == [False, True]
    assert hits(spark, [4.0, 4.0], rules=(2, 3))[0] == [[], []]
    with pytest.raises(ValueError):
        hits(spark, [1.0], rules=(4,))


def test_zero_sigma(spark):
    flat = spark.createDataFrame([("p", 4, 1.0, 1.0, 1.0, 0.0, 0.0, 0.0, 0.0, 0.0)], LIMITS_DDL)
    rows = op.nelson(stats(spark, [1.0, 1.5]), flat).orderBy("subgroup").collect()
    assert rows[0].hits == [] and 1 in rows[1].hits


def test_capability_sides_and_flat_process(spark):
    params = spark.createDataFrame([("p", 4, None, 10.0, "u")], "param string, n int, lsl double, usl double, unit string")
    row = op.capability(stats(spark, [4.0] * 3, [2.059] * 3), params).collect()[0]
    assert row.cp is None and row.cpk == pytest.approx(2.0)
    none = spark.createDataFrame([("p", 4, None, None, "u")], params.schema)
    row = op.capability(stats(spark, [4.0], [0.0]), none).select("cpk", op.cpk_class(F.col("cpk")).alias("c")).collect()[0]
    assert row.cpk is None and row.c is None


def test_short_subgroups_set_no_limits(spark):
    params = spark.createDataFrame([("p", 4, None, 10.0, "u")], "param string, n int, lsl double, usl double, unit string")
    full = stats(spark, [1.0, 3.0])
    short = full.filter("subgroup = 1").withColumns({"subgroup": F.lit(3).cast("bigint"), "n": F.lit(2).cast("bigint"), "mean": F.lit(500.0)})
    assert op.control_limits(full.unionByName(short), params).collect() == op.control_limits(full, params).collect()


def test_other_subgroup_sizes_are_rejected(spark):
    params = spark.createDataFrame([("p", 6, None, 10.0, "u")], "param string, n int, lsl double, usl double, unit string")
    with pytest.raises(Exception, match="no chart constants"):
        op.control_limits(stats(spark, [1.0]).withColumn("n", F.lit(6)), params).collect()


def test_histogram_edges(spark):
    df = spark.createDataFrame([("a", float(v)) for v in range(15)] + [("flat", 2.0)] * 3, "k string, v double")
    got = {(r.k, r.bin): r.n for r in op.histogram(df, "k", "v").collect()}
    assert got[("a", 13)] == 2 and got[("a", 0)] == 1 and got[("flat", 0)] == 3 and len(got) == 28


def test_working_days_and_labels(spark):
    days = [r.date for r in op.working_day_spine(spark, "2026-06-01", 40).orderBy("position").collect()]
    assert days[0] == date(2026, 6, 1) and days[-1] == date(2026, 7, 24) and all(d.weekday() < 5 for d in days)
    weekend = [r.date for r in op.working_day_spine(spark, "2026-06-06", 2).orderBy("position").collect()]
    assert weekend == [date(2026, 6, 8), date(2026, 6, 9)]
    row = spark.range(1).select(op.subgroup_label(F.lit(7)).alias("a"), op.subgroup_label(F.lit(123)).alias("b")).collect()[0]
    assert (row.a, row.b) == ("SG-07", "SG-123")


def test_intervals(spark):
    points = spark.createDataFrame([("p", i) for i in (1, 4, 5, 9, 10, 300)], "param string, subgroup long")
    causes = spark.createDataFrame([("p", 5, 9, "late"), ("p", 4, 5, "early")], "param string, from_subgroup long, to_subgroup long, text string")
    got = {r.subgroup: r.cause for r in op.interval_text(points, causes, "none", block=3).collect()}
    assert got == {1: "none", 4: "early", 5: "early", 9: "late", 10: "none", 300: "none"}
