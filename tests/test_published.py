"""Published report tables, replayed on inputs made to have their counts."""

from datetime import date

from pyspark.sql import functions as F

from tallyworks.operators import retention as op

P = op.RetentionParams()
GAPS = ((12, 598), (45, 305), (80, 202), (150, 423), (250, 477))
# Buyers and returned buyers of the first-order table.
ON_TIME, LATE = (51_872, 1_040), (3_775, 61)
SEGMENT_BUYERS = (1_459, 546, 3_437, 14_526, 7_030, 30_255, 6_969, 28_874)


def orders(spark, rows):
    """(buyers, first day, later day or None, lateness) groups as delivered orders; values rise from buyer to buyer."""
    parts, first = [], 0
    for n, start, later, late in rows:
        ids = spark.range(first, first + n).select(F.col("id").cast("string").alias(op.BUYER), (F.col("id") * 2).alias("order_id"), F.col("id").cast("double").alias("gmv"))
        for extra, when in enumerate([start] + ([later] if later else [])):
            parts.append(ids.select(op.BUYER, (F.col("order_id") + extra).alias("order_id"), (F.col("gmv") / 2 if later else F.col("gmv")).alias("gmv"),
                                    F.lit(when).cast("timestamp_ntz").alias("purchased_at"), F.lit(late).alias("is_late")))
        first += n
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.withColumns({"review_score": F.lit(None).cast("int"), "customer_state": F.lit(None).cast("string"), "main_seller_state": F.lit(None).cast("string"),
                            "purchase_month": F.trunc(F.to_date("purchased_at"), "month")})


def test_return_gaps(spark):
    start = date(2017, 1, 10)
    sales = orders(spark, [(n, start, date.fromordinal(start.toordinal() + d), False) for d, n in GAPS])
    got = op.return_gap(sales, P).collect()
    assert [r.buyers for r in got] == [n for _, n in GAPS] and [r.bucket_order for r in got] == [1, 2, 3, 4, 5]
    assert op.return_gap_cum(op.return_gap(sales, P)).collect()[-1].cum_share == 1.0


def test_first_order_levels_and_value_tiles(spark):
    start, later = date(2017, 1, 10), date(2017, 2, 1)
    sales = orders(spark, [(ON_TIME[1], start, later, False), (ON_TIME[0] - ON_TIME[1], start, None, False), (LATE[1], start, later, True),
                           (LATE[0] - LATE[1], start, None, True), (1, date(2018, 8, 1), None, False)])
    got = {(r.factor, r.level): (r.buyers, r.returned) for r in op.repeat_by_first(sales, P).collect()}
    assert got["Delivery", "On time"] == ON_TIME and got["Delivery", "Late"] == LATE
    assert [got["First order value", f"Quintile {i}"][0] for i in range(1, 6)] == [11_130, 11_130, 11_129, 11_129, 11_129]


def test_segments(spark):
    end, days = date(2018, 8, 29), lambda n: date.fromordinal(date(2018, 8, 29).toordinal() - n)
    active, lapsed, new_high, new, cooling_high, cooling, lost_high, lost = SEGMENT_BUYERS
    # Lowest values first; the top fifth is the high-value buyers and as many repeat buyers as it takes.
    total = sum(SEGMENT_BUYERS)
    top = total - -(-(total - 1) * 8 // 10)
    in_top = top - (new_high + cooling_high + lost_high)
    sales = orders(spark, [
        (new, end, None, False), (cooling, days(200), None, False), (lost, days(400), None, False),
        (active + lapsed - in_top, days(100), days(50), False) if active + lapsed - in_top <= active else (active, days(100), days(50), False),
        (active - min(active, active + lapsed - in_top), days(100), days(50), False), (lapsed, days(500), days(400), False),
        (new_high, end, None, False), (cooling_high, days(200), None, False), (lost_high, days(400), None, False)])
    got = {r.segment: r.buyers for r in op.rfm(op.rfm_customers(sales, P)).collect()}
    assert tuple(got[s] for s in op.SEGMENTS) == SEGMENT_BUYERS
