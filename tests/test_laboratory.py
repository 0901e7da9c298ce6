"""Cleaning rules on hand-made rows."""

import random
from datetime import date, datetime, timedelta

from pyspark.sql import Row
from pyspark.sql import functions as F

from tallyworks.operators import laboratory as op
from tallyworks.sources import projection as src


def test_minutes(spark):
    texts = ["2025-04-05 09:59:59.999999786", "2025-04-05 08:00:00.000000213", "2025-04-05 08:00:30", "2025-04-05 08:01:30", "soon", None]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    got = [r.t for r in op.round_to_minute(df, ("t",)).orderBy("i").collect()]
    day = lambda h, m: datetime(2025, 4, 5, h, m)
    assert got == [day(10, 0), day(8, 0), day(8, 0), day(8, 2), None, None]


def test_limits(spark):
    df = spark.createDataFrame([(1.0,), (5.0,), (12.0,), (None,), (0.0,)], "r double")
    rules = op.limit_status(F.col("r"), F.lit(5.0), F.lit(12.0))
    got = [(r.Result_Status, r.Is_OOS, r.Is_Alert, r.Is_Zero_Count) for r in df.select(*[c.alias(n) for n, c in rules.items()]).collect()]
    within = ("Within Limits", False, False, False)
    assert got == [within, ("Alert", False, True, False), ("OOS / Action", True, False, False), within, ("Within Limits", False, False, True)]
    equal = op.limit_status(F.col("r"), F.lit(5.0), F.lit(5.0))
    assert not any(r[0] for r in df.select(equal["Is_Alert"]).collect())


def test_turnaround_uses_unrounded_days(spark):
    start = datetime(2025, 1, 1)
    rows = [(start, datetime(2025, 1, 5), datetime(2025, 1, 5)), (start, datetime(2025, 1, 5, 0, 1, 30), datetime(2025, 1, 5))]
    df = spark.createDataFrame(rows, "a timestamp_ntz, b timestamp_ntz, d timestamp_ntz")
    rules = op.turnaround(F.col("a"), F.col("b"), F.col("d"))
    got = [tuple(r) for r in df.select(*[c.alias(n) for n, c in rules.items()]).collect()]
    assert got == [(4.0, False, False), (4.0, True, True)]


def test_duplicates_keys_and_nulls(spark):
    df = spark.createDataFrame([(1, "a"), (1, "a"), (2, "b"), (2, "c"), (3, None)], "k int, v string")
    assert tuple(op.duplicates_removed(df).collect()[0]) == (5, 4, 1)
    assert [r.k for r in op.key_violations(op.dedupe_exact(df), ["k"]).collect()] == [2]
    assert tuple(op.structural_null_counts(df, {"v": "none"}).collect()[0]) == ("v", "none", 1)


def test_missing_test_and_flipped_flag(spark):
    raw = src.laboratory_tables(spark, "/root/testdata/sf0.001")
    raw["TEST"] = raw["TEST"].filter("TEST_NUMBER <> 17")
    cleaned = op.clean_tables(raw)
    fact = op.result_fact(cleaned)
    checks = op.join_checks(cleaned, fact).collect()
    assert all(r.ok for r in checks)
    orphan = fact.filter("Sample_ID = 17").collect()[0]
    assert orphan.Result_ID is None and orphan.Result_Status == "Within Limits" and not orphan.Is_OOS
    flags = cleaned["flagged_results"].withColumn("Flag_TAT_Breach", (F.col("SAMPLE_NUMBER") == 23) != F.col("Flag_TAT_Breach"))
    got = {r.flag: r.mismatches for r in op.flag_reconcile(fact.filter("Sample_ID <> 17"), flags).collect()}
    assert got == {"Is_OOS": 0, "Is_Alert": 0, "TAT_Breach_4d_SLA": 1}


def test_dead_columns(spark):
    df = spark.createDataFrame([(1, "A", None, 1, 2.0), (2, "A", None, 2, 2.5), (3, None, None, 3, 2.0)],
                               "id int, s string, e string, copy int, v double")
    got = {tuple(r) for r in op.dead_columns(df).collect()}
    assert got == {("e", "empty", None), ("copy", "copy", "id")}


def test_copies_among_three_hundred_columns(spark):
    columns = [((F.col("id") * (i + 1)) % 97).alias(f"c{i}") for i in range(290)]
    df = spark.range(500).select(
        *columns, F.col("id").alias("n0"), F.lit(None).cast("bigint").alias("blank"), F.lit(None).cast("bigint").alias("blank2"),
        F.when(F.col("id") != 77, F.col("id")).alias("n0 but one"), ((F.col("id") * 3) % 97).alias("c2 again"), F.lit(5).cast("bigint").alias("five"),
        ((F.col("id") * 3) % 97).alias("c2 third"), ((F.col("id") * 3) % 97).cast("string").alias("c2 text"), F.reverse(F.col("id").cast("string")).cast("bigint").alias("mixed"))
    # The same values in another order are no copy.
    got = sorted(map(tuple, op.dead_columns(df).collect()), key=str)
    want = [(f"c{i}", "copy", f"c{i % 97}") for i in range(97, 290)] + [("c2 again", "copy", "c2"), ("c2 third", "copy", "c2")]
    want += [("blank", "empty", None), ("blank2", "empty", None), *((c, "constant", None) for c in ("c96", "c193", "five"))]
    assert got == sorted(want, key=str)


def test_colliding_fingerprints_are_compared(spark, monkeypatch):
    monkeypatch.setattr(op, "_column_facts", lambda df: [3, *(Row(filled=3, flat=False, sum=0, xor=0) for _ in df.columns)])
    df = spark.createDataFrame([(1, 2, 1, 2, 2), (2, 1, 2, 1, 1), (3, 3, 3, 3, 3)], "a int, b int, c int, d int, e int")
    assert sorted(map(tuple, op.dead_columns(df).collect())) == [("c", "copy", "a"), ("d", "copy", "b"), ("e", "copy", "b")]


def test_value_lists_of_any_length_give_the_same(spark, monkeypatch):
    df = spark.createDataFrame([(i % 7, f"v{i % 5}") for i in range(60)] + [(None, "v0")], "a int, b string")
    short = sorted(map(tuple, op.dimension_values(df, ("a", "b")).collect()))
    monkeypatch.setattr(op, "LIST_ROWS", 0)
    assert sorted(map(tuple, op.dimension_values(df, ("a", "b")).collect())) == short
    assert [x[2] for x in short] == [*range(7), *range(5)]


def test_profile_counts_every_kind_of_column(spark, monkeypatch):
    r = random.Random(8)
    kinds = "dense bigint, below int, sparse bigint, edge bigint, day date, yes boolean, text string, ratio double, none int, one int"
    rows = [(r.randrange(300), r.randrange(-70_000, 70_000) if i % 3 else None, r.choice((-(2**63), 2**63 - 1, 5, None)), 32768 * r.randrange(-2, 3),
             date(2020, 1, 1) + timedelta(r.randrange(90)), r.choice((True, None)), r.choice(("a", " a", "b ")), r.choice((0.5, 1.5)), None, 7) for i in range(400)]
    df = spark.createDataFrame(rows, kinds).repartition(5)
    want = {f.name: (400, sum(x[i] is None for x in rows), len({x[i] for x in rows} - {None})) for i, f in enumerate(df.schema.fields)}
    for least, per_bucket in ((1_000_000, 64), (1, 64), (1, 1), (1, 10**9)):
        monkeypatch.setattr(op, "BITMAP_ROWS", least)
        monkeypatch.setattr(op, "ROWS_PER_BUCKET", per_bucket)
        assert {x.column: (x.rows, x.nulls, x["distinct"]) for x in op.column_profile(df).collect()} == want
    assert {x["distinct"] for x in op.column_profile(df.limit(0)).collect()} == {0}
