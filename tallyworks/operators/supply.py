"""Cause roll-up, vendor scores, expiry and reorder checks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.numeric import count_where, exact_mean, rate, rounded


def cause_rollup(records: DataFrame, mapping: DataFrame, label: str = "cause", default: str = "Other") -> DataFrame:
    """Share of each category of raw labels; labels are counted before they are mapped."""
    raw = records.groupBy(label).agg(F.count(F.lit(1)).alias("_n"))
    named = raw.join(mapping.select(label, "category"), label, "left")
    total = F.sum("count").over(Window.partitionBy())
    return named.groupBy(F.coalesce("category", F.lit(default)).alias("category")).agg(F.sum("_n").alias("count")).withColumn(
        "share", rounded(F.col("count") / total, 6))


def vendor_scorecard(orders: DataFrame, cutoff: float = 0.8) -> DataFrame:
    """On-time share and lead time per vendor; below the cutoff a vendor is at risk."""
    on_time = F.col("received") <= F.col("due")
    scored = orders.groupBy("vendor").agg(
        F.count(F.lit(1)).alias("orders"), count_where(on_time).alias("on_time"), rate(on_time).alias("_rate"),
        rounded(exact_mean(F.datediff("received", "ordered")), 4).alias("mean_lead_days"))
    return scored.select(
        "vendor", "orders", "on_time", rounded(F.col("_rate"), 6).alias("on_time_rate"), "mean_lead_days",
        (F.col("_rate") < cutoff).alias("at_risk"))


def expiry_flags(lots: DataFrame, asof: str, warn_days: int = 30) -> DataFrame:
    """Days left per lot, expired and near-expiry flags."""
    left: Column = F.datediff("expires", F.lit(asof).cast("date"))
    return lots.withColumn("days_left", left).withColumn("expired", F.col("days_left") < 0).withColumn(
        "near_expiry", F.col("days_left").between(0, warn_days))


def reorder_flags(items: DataFrame, usage: DataFrame, days: int, lead_days: int = 14, safety_days: int = 7) -> DataFrame:
    """Reorder point = daily use x (lead + safety days); flags items whose stock is below it."""
    daily = usage.groupBy("item").agg((F.sum(F.col("quantity").cast("decimal(18,2)")).cast("double") / days).alias("daily_use"))
    point = rounded(F.coalesce("daily_use", F.lit(0.0)) * (lead_days + safety_days), 2)
    return items.join(daily, "item", "left").select("item", "on_hand", point.alias("reorder_point")).withColumn(
        "below", F.col("on_hand") < F.col("reorder_point"))
