"""Environmental monitoring: results against alert and action limits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.dates import month_index
from ..functions.numeric import count_where, exact_mean, first_match, rate, rounded
from .deviations import has_text, register_filter

LEVELS = ("Pass", "Alert", "Action")
NO_CAUSE = "No cause recorded"


def em_result(samples: DataFrame) -> DataFrame:
    """Mean and number of the readings of an event."""
    return samples.groupBy("room", "test", "month").agg(
        exact_mean(F.col("value")).alias("value"), F.count("value").alias("n_samples"))


def level(value: Column, alert: Column, action: Column, direction: Column) -> Column:
    """Upper limits count when reached, floors only when undercut."""
    low = direction == "low"
    act = F.when(low, value < action).otherwise(value >= action)
    warn = F.when(low, value < alert).otherwise(value >= alert)
    return first_match([(act, "Action"), (warn, "Alert")], "Pass")


def severity(value: Column) -> Column:
    return first_match([(value == name, rank) for rank, name in enumerate(LEVELS)])


def em_classify(events: DataFrame, limits: DataFrame, keys: tuple[str, ...] = ("test",)) -> DataFrame:
    """Adds limits and ``level``; ``keys`` may include the ISO class."""
    side = limits.select(*keys, "alert", "action", "direction")
    return events.join(side, list(keys), "left").withColumn(
        "level", level(F.col("value"), F.col("alert"), F.col("action"), F.col("direction")))


def em_trend(classified: DataFrame) -> DataFrame:
    """Monthly mean per test with its limits and the number of action results."""
    return classified.groupBy("test", "month").agg(
        F.count(F.lit(1)).alias("events"), rounded(exact_mean(F.col("value")), 6).alias("mean_value"),
        F.max("alert").alias("alert"), F.max("action").alias("action"),
        count_where(F.col("level") == "Action").alias("actions")).orderBy("test", "month")


def worst_by_month(classified: DataFrame) -> DataFrame:
    """Worst level per room and month."""
    worst = F.max(severity(F.col("level")))
    name = first_match([(F.col("_w") == rank, text) for rank, text in enumerate(LEVELS)])
    return classified.groupBy("room", "month").agg(worst.alias("_w")).select("room", "month", name.alias("worst"))


def months_between(first: str, last: str) -> list[tuple[int, int]]:
    """(year, month) from first to last, both given as yyyy-MM."""
    a, b = (int(x[:4]) * 12 + int(x[5:7]) - 1 for x in (first, last))
    return [(i // 12, i % 12 + 1) for i in range(a, b + 1)]


def facility_matrix(classified: DataFrame, first: str | None = None, last: str | None = None) -> DataFrame:
    """Worst level per room, one column per month from first to last (yyyy-MM), gaps included.

    Bounds that are not given are the earliest and the latest month of the rows, read by one aggregate, so that no
    event falls outside. Without any month there are only the rooms.
    """
    if first is None or last is None:
        text = lambda c: F.date_format(c, "yyyy-MM")
        low, high = classified.agg(text(F.min("month")), text(F.max("month"))).first()
        first, last = first or low, last or high
    rank, months = severity(F.col("level")), months_between(first, last) if first and last else []
    name = lambda y, m: f"m{y}{m:02d}"
    grid = classified.groupBy("room").agg(F.count(F.lit(1)).alias("_events"), *[
        F.max(F.when((F.year("month") == y) & (F.month("month") == m), rank)).alias(name(y, m)) for y, m in months])
    named = [first_match([(F.col(name(y, m)) == r, t) for r, t in enumerate(LEVELS)]).alias(name(y, m)) for y, m in months]
    return grid.select("room", *named)


def excursion(classified: DataFrame) -> DataFrame:
    return classified.filter(F.col("level") != "Pass")


def em_pareto(classified: DataFrame, cut: float = 0.8) -> DataFrame:
    """Causes of excursions in falling order; ``in_cut`` marks those needed to reach the cut-off.

    Excursions without a cause have a label of their own, so that the counts add up to all excursions.
    """
    cause = F.coalesce("root_cause", F.lit(NO_CAUSE)).alias("root_cause")
    counts = excursion(classified).groupBy(cause).agg(F.count(F.lit(1)).alias("count"))
    falling = Window.orderBy(F.desc("count"), "root_cause").rowsBetween(Window.unboundedPreceding, 0)
    total, running = F.sum("count").over(Window.partitionBy()), F.sum("count").over(falling)
    return counts.select(
        "root_cause", "count", rounded(F.col("count") / total, 6).alias("share"), rounded(running / total, 6).alias("cum_share"),
        (running - F.col("count") < F.lit(cut) * total).alias("in_cut")).orderBy(F.desc("count"), "root_cause")


def causes_to_cut(classified: DataFrame, cut: float = 0.8) -> DataFrame:
    return em_pareto(classified, cut).agg(F.count(F.lit(1)).alias("causes"), count_where(F.col("in_cut")).alias("causes_to_cut"))


def em_summary(classified: DataFrame) -> DataFrame:
    """Rooms, events, pass rate, open CAPAs and mean days to close."""
    return classified.agg(
        F.count_distinct("room").alias("rooms"), F.count(F.lit(1)).alias("events"),
        rounded(rate(F.col("level") == "Pass"), 6).alias("pass_rate"),
        count_where(F.col("capa_status") == "Open").alias("open_capas"),
        rounded(exact_mean(F.col("days_to_close")), 4).alias("mean_days_to_close"))


def audit_log(
    classified: DataFrame, chosen: dict[str, list[str]] | None = None, between: tuple[str, str, str] | None = None,
    text: str | None = None,
) -> DataFrame:
    """Every event with limits, corrective action, cause and people, filtered and searched."""
    columns = ("room", "suite", "test", "month", "value", "n_samples", "alert", "action", "level", "capa", "capa_status",
               "days_to_close", "root_cause", "analyst", "qa_reviewer")
    return register_filter(classified.select(*columns), chosen, between, text)


def consecutive_runs(classified: DataFrame, min_months: int = 2) -> DataFrame:
    """Runs of consecutive months at alert or action per room; at most one row per room and month is ordered."""
    months = excursion(classified).groupBy("room", "month").agg(F.max(severity(F.col("level"))).alias("_w"))
    position = F.row_number().over(Window.partitionBy("room").orderBy("month"))
    islands = months.withColumn("_island", month_index(F.col("month")) - position)
    return islands.groupBy("room", "_island").agg(
        F.min("month").alias("first_month"), F.max("month").alias("last_month"), F.count(F.lit(1)).alias("months"),
        count_where(F.col("_w") == 2).alias("action_months")).drop("_island").filter(F.col("months") >= min_months)


def capa_on_action(classified: DataFrame) -> DataFrame:
    """Action results without a corrective action."""
    return classified.filter((F.col("level") == "Action") & ~has_text(F.col("capa"))).select("room", "test", "month", "value")


def excursion_rate(classified: DataFrame) -> DataFrame:
    return classified.agg(
        F.count(F.lit(1)).alias("events"), count_where(F.col("level") != "Pass").alias("excursions"),
        count_where(F.col("level") == "Action").alias("actions"),
        rounded(rate(F.col("level") != "Pass"), 6).alias("excursion_rate"))


def rolling_rate_ratio(readings: DataFrame, asof: str, recent_days: int = 30, baseline_days: int = 90) -> DataFrame:
    """Excursion rate of the last days against the baseline days before them, per room."""
    age = F.datediff(F.lit(asof).cast("date"), F.col("day"))
    recent, before = age.between(0, recent_days - 1), age.between(recent_days, recent_days + baseline_days - 1)
    rates = readings.filter(age.between(0, recent_days + baseline_days - 1)).groupBy("room").agg(
        count_where(recent).alias("recent_results"), count_where(before).alias("baseline_results"),
        rate(F.when(recent, F.col("excursion"))).alias("r"), rate(F.when(before, F.col("excursion"))).alias("b"))
    return rates.select(
        "room", "recent_results", "baseline_results", rounded(F.col("r"), 6).alias("recent_rate"),
        rounded(F.col("b"), 6).alias("baseline_rate"), rounded(F.try_divide(F.col("r"), F.col("b")), 6).alias("ratio"))


def repeat_excursions(readings: DataFrame, window_days: int = 30) -> DataFrame:
    """Each excursion day with the excursion day before it in the same room and test, inside the window."""
    days = readings.filter("excursion").groupBy("room", "test", "day").agg(F.count(F.lit(1)).alias("excursions"))
    previous = F.lag("day").over(Window.partitionBy("room", "test").orderBy("day"))
    gap = F.datediff("day", "previous_day")
    return days.withColumn("previous_day", previous).withColumn("gap_days", gap).filter(F.col("gap_days") <= window_days)
