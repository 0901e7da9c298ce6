"""Boundary rows of the retention operators and published test arithmetic."""

from datetime import datetime

import pytest
from pyspark.sql import functions as F

from tallyworks.functions.stats import two_prop_z
from tallyworks.operators import retention as op

P = op.RetentionParams(min_category_buyers=1)


def sales(spark, rows):
    """(buyer, order id, time, value) rows as delivered orders."""
    data = [(b, i, datetime.fromisoformat(t), v, "cat") for b, i, t, v in rows]
    df = spark.createDataFrame(data, "customer_unique_id string, order_id long, purchased_at timestamp_ntz, gmv double, main_category string")
    return df.withColumn("purchase_month", F.trunc(F.to_date("purchased_at"), "month"))


ROWS = [
    ("same_day", 1, "2017-01-10T08:00:00", 10.0), ("same_day", 2, "2017-01-10T20:00:00", 10.0),
    ("next_day", 3, "2017-01-10T23:59:00", 10.0), ("next_day", 4, "2017-01-11T00:01:00", 10.0),
    ("edge", 5, "2017-01-10T08:00:00", 10.0), ("edge", 6, "2017-07-09T08:00:00", 10.0),
    ("past", 7, "2017-01-10T08:00:00", 10.0), ("past", 8, "2017-07-09T08:00:01", 10.0),
    ("at_cutoff", 9, "2017-07-13T12:00:00", 10.0), ("after_cutoff", 10, "2017-07-13T12:00:01", 10.0),
    ("last", 11, "2018-01-09T12:00:00", None),
]


def test_return_window(spark):
    rows = {r[0]: r for r in op.first_orders(sales(spark, ROWS), P, keep=[]).select(
        "customer_unique_id", "return_at", "eligible_180", "repeat_180").collect()}
    assert rows["same_day"].return_at is None and not rows["same_day"].repeat_180
    assert rows["next_day"].repeat_180
    assert rows["edge"].repeat_180 and not rows["past"].repeat_180
    assert rows["past"].return_at is not None
    assert rows["at_cutoff"].eligible_180 and not rows["after_cutoff"].eligible_180


def test_sequence_and_cohort(spark):
    rows = {r.order_id: r for r in op.customer_orders(sales(spark, ROWS)).collect()}
    assert [rows[i].order_seq for i in (1, 2, 3, 4, 9)] == [1, 2, 1, 2, 1]
    assert rows[6].cohort_month == rows[5].cohort_month


def test_ranks_put_null_value_last(spark):
    ranked = {r[0]: r.m_pct for r in op.rfm_customers(sales(spark, ROWS), P).collect()}
    assert ranked["last"] == 1.0 and ranked["at_cutoff"] == ranked["after_cutoff"] == 0.0


def test_gap_buckets(spark):
    start = datetime(2017, 1, 1)
    rows = []
    for n, days in enumerate((1, 30, 31, 60, 61, 90, 91, 180, 181)):
        later = datetime.fromordinal(start.toordinal() + days)
        rows += [(f"b{n}", 2 * n, start.isoformat(), 1.0), (f"b{n}", 2 * n + 1, later.isoformat(), 1.0)]
    got = {r.gap: r.buyers for r in op.return_gap(sales(spark, rows), P).collect()}
    assert got == {"1 to 30 days": 2, "31 to 60 days": 2, "61 to 90 days": 2, "91 to 180 days": 2, "Over 180 days": 1}


def test_lateness_buckets(spark):
    df = spark.createDataFrame([(d, 5) for d in (-3, 0, 1, 3, 4, 7, 8, 14, 15)], "days_late int, review_score int")
    got = {r.bucket_order: r.orders for r in op.late_vs_review(df).collect()}
    assert got == {0: 2, 1: 2, 2: 2, 3: 2, 4: 1}


def test_latest_review_and_main_item(spark):
    reviews = spark.createDataFrame(
        [("a", 1, "x", datetime(2020, 1, 1), datetime(2020, 1, 5)), ("a", 5, "y", datetime(2020, 1, 2), datetime(2020, 1, 5)),
         ("a", 3, "z", datetime(2020, 1, 3), datetime(2020, 1, 4))],
        "order_id string, review_score int, review_comment_message string, review_creation_date timestamp_ntz, review_answer_timestamp timestamp_ntz")
    assert op.review_latest(reviews).collect()[0].review_score == 5
    items = spark.createDataFrame(
        [("o", 2, "p2", "s2", 9.99, 1.0), ("o", 1, "p1", "s1", 9.99, 1.0), ("q", 1, "p3", "s3", 5.0, 0.5)],
        "order_id string, order_item_id int, product_id string, seller_id string, price double, freight_value double")
    products = spark.createDataFrame([("p1", "raw"), ("p2", "other"), ("p3", None)], "product_id string, product_category_name string")
    names = spark.createDataFrame([("other", "Other")], "product_category_name string, product_category_name_english string")
    rows = {r.order_id: r for r in op.order_items_agg(items, products, names).collect()}
    assert (rows["o"].main_seller_id, rows["o"].main_category, rows["o"].sellers) == ("s1", "raw", 2)
    assert rows["o"].gmv == pytest.approx(21.98, abs=0) and rows["q"].main_category == "unknown"


# Published counts (level a, level b as returned, buyers) and their published test results.
PUBLISHED = [
    ((1040, 51872, 61, 3775), (0.39, 1.66, 0.0975)), ((879, 43091, 122, 7314), (0.37, 2.11, 0.0351)),
    ((402, 18616, 699, 37031), (0.27, 2.17, 0.0298)), ((235, 11129, 234, 11130), (0.01, 0.05, 0.962)),
]


def test_published_tests(spark):
    df = spark.createDataFrame([c for c, _ in PUBLISHED], "x1 long, n1 long, x2 long, n2 long")
    test = two_prop_z(*[F.col(c) for c in ("x1", "n1", "x2", "n2")])
    assert [tuple(r) for r in df.select(*[c.alias(n) for n, c in test.items()]).collect()] == [r for _, r in PUBLISHED]


def test_no_returns_gives_null(spark):
    df = spark.createDataFrame([(0, 10, 0, 10)], "x1 long, n1 long, x2 long, n2 long")
    row = df.select(*[c.alias(n) for n, c in two_prop_z(*[F.col(c) for c in df.columns]).items()]).collect()[0]
    assert row.z is None and row.p is None
