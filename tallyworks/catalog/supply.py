"""Supply queries Q1, Q4 and Q5."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import supply as op
from ..sources import projection as src
from .registry import big, query, rnd


@query("Q1_cause_rollup", f"""WITH m AS (SELECT CASE WHEN p_type IN ('STANDARD', 'ECONOMY') THEN 'Process' WHEN p_type IN ('LARGE', 'SMALL', 'MEDIUM') THEN 'Design' ELSE 'Other' END AS category
  FROM lineitem LEFT JOIN part ON p_partkey = l_partkey)
SELECT category, COUNT(*) AS count, {rnd('COUNT(*) / SUM(COUNT(*)) OVER ()', 6)} AS share FROM m GROUP BY 1""")
def cause_rollup(spark, folder):
    part = src.star(spark, folder, "part").select("p_partkey", F.col("p_type").alias("cause"))
    records = src.star(spark, folder, "lineitem").select("l_partkey").join(part, F.col("l_partkey") == F.col("p_partkey"), "left")
    mapping = part.select("cause").distinct().select(
        "cause", F.when(F.col("cause").isin("STANDARD", "ECONOMY"), "Process").when(
            F.col("cause").isin("LARGE", "SMALL", "MEDIUM"), "Design").alias("category"))
    return op.cause_rollup(records, mapping)


@query("Q4_vendor_scorecard", f"""SELECT l_suppkey AS vendor, COUNT(*) AS orders, COUNT(*) FILTER (WHERE l_quantity <= 25) AS on_time,
{rnd('COUNT(*) FILTER (WHERE l_quantity <= 25) / COUNT(*)', 6)} AS on_time_rate, {rnd('CAST(SUM(CAST(l_quantity AS BIGINT)) AS DOUBLE) / COUNT(*)', 4)} AS mean_lead_days,
COUNT(*) FILTER (WHERE l_quantity <= 25) / COUNT(*) < CAST(0.5 AS DOUBLE) AS at_risk FROM lineitem GROUP BY 1""")
def vendor_scorecard(spark, folder):
    received = F.to_date("l_shipdate")
    ordered = F.date_sub(received, F.col("l_quantity").cast("int"))
    orders = src.star(spark, folder, "lineitem").select(
        F.col("l_suppkey").alias("vendor"), ordered.alias("ordered"), received.alias("received"),
        F.date_add(ordered, 25).alias("due"))
    return op.vendor_scorecard(orders, 0.5)


@query("Q5_expiry", """SELECT l_orderkey AS lot, l_partkey AS item, CAST(l_shipdate AS DATE) + 365 AS expires,
CAST(l_shipdate AS DATE) + 365 - DATE '2001-06-30' AS days_left, CAST(l_shipdate AS DATE) + 365 < DATE '2001-06-30' AS expired,
CAST(l_shipdate AS DATE) + 365 - DATE '2001-06-30' BETWEEN 0 AND 30 AS near_expiry FROM lineitem""")
def expiry(spark, folder):
    lots = src.star(spark, folder, "lineitem").select(
        F.col("l_orderkey").alias("lot"), F.col("l_partkey").alias("item"), F.date_add(F.to_date("l_shipdate"), 365).alias("expires"))
    return op.expiry_flags(lots, "2001-06-30")


@query("Q5_reorder", f"""WITH u AS (SELECT l_partkey AS item, CAST(SUM(CAST(l_quantity AS DECIMAL(18,2))) AS DOUBLE) / 365 AS daily_use FROM lineitem GROUP BY 1),
p AS (SELECT p_partkey AS item, {big('p_size * 2')} AS on_hand, {rnd('COALESCE(daily_use, 0) * 21', 2)} AS reorder_point FROM part LEFT JOIN u ON item = p_partkey)
SELECT *, on_hand < reorder_point AS below FROM p""")
def reorder(spark, folder):
    items = src.star(spark, folder, "part").select(F.col("p_partkey").alias("item"), (F.col("p_size") * 2).alias("on_hand"))
    usage = src.star(spark, folder, "lineitem").select(F.col("l_partkey").alias("item"), F.col("l_quantity").alias("quantity"))
    return op.reorder_flags(items, usage, 365)
