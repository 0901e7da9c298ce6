"""Deviation and corrective-action (CAPA) tracking.

Repeats and effectiveness are range questions on (asset, cause) over days. They
are answered on a timeline with one row per asset, cause and calendar day, so a
pair that owns most of the records still has no more rows than there are days.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.dates import day_number, month_start
from ..functions.numeric import count_where, first_match, guarded_ratio, rounded
from ..session import durable


@dataclass(frozen=True)
class DeviationParams:
    asof: str
    target: int = 30
    warn: int = 20
    capa_due: int = 90
    repeat_window: int = 180
    effect_window: int = 180
    recent_days: int = 90
    prior_days: int = 270

    def asof_day(self) -> Column:
        return F.lit(self.asof).cast("date")


# Labels of the register and the earliest accepted date.
BUCKETS = ((30, "0-30"), (60, "31-60"), (90, "61-90"))
LAST_BUCKET = "90+"
SEVERITIES = ("Critical", "Major", "Minor")
EARLIEST_DATE = "2000-01-01"

PAIR = ["asset", "cause"]


# ------------------------------------------------------------- row formulas


def has_text(value: Column) -> Column:
    """True for non-empty text, false for blank or null."""
    return F.coalesce(F.length(value) > 0, F.lit(False))


def is_open() -> Column:
    return F.col("closed").isNull()


def status() -> Column:
    return F.when(is_open(), "Open").otherwise("Closed")


def days_open(p: DeviationParams) -> Column:
    """Age of an open record, time to close of a closed one."""
    return F.datediff(F.coalesce(F.col("closed"), p.asof_day()), F.col("opened"))


def overdue(p: DeviationParams) -> Column:
    return is_open() & (days_open(p) > p.target)


def due_soon(p: DeviationParams) -> Column:
    """Past the warning age but not yet overdue."""
    return is_open() & (days_open(p) > p.warn) & ~overdue(p)


def aging_bucket(p: DeviationParams) -> Column:
    """Age class of open records, null for closed ones."""
    age = days_open(p)
    return F.when(is_open(), first_match([(age <= cut, text) for cut, text in BUCKETS], LAST_BUCKET))


def capa_due(p: DeviationParams) -> Column:
    return F.when(has_text(F.col("capa")) & F.col("closed").isNotNull(), F.date_add("closed", p.capa_due))


def capa_status(p: DeviationParams) -> Column:
    return first_match([
        (~has_text(F.col("capa")), "Not required"),
        (F.col("capa_closed").isNotNull(), "Closed"),
        (is_open(), "Awaiting dev. close"),
        (p.asof_day() > capa_due(p), "Overdue"),
    ], "Open")


def close_days_recent(p: DeviationParams) -> Column:
    since = F.datediff(p.asof_day(), F.col("closed"))
    return F.when(since <= p.recent_days, days_open(p))


def close_days_prior(p: DeviationParams) -> Column:
    since = F.datediff(p.asof_day(), F.col("closed"))
    return F.when((since > p.recent_days) & (since <= p.prior_days), days_open(p))


def effectiveness(p: DeviationParams, recurred: Column) -> Column:
    """Null until the CAPA is closed; ``recurred`` says whether the pair came back inside the window."""
    return F.when(F.col("capa_closed").isNotNull(), first_match([
        (recurred, "Ineffective"),
        (F.datediff(p.asof_day(), F.col("capa_closed")) >= p.effect_window, "Effective"),
    ], "Check pending"))


# ---------------------------------------------------------------- timeline


def pair_timeline(devs: DataFrame, p: DeviationParams) -> DataFrame:
    """Per asset, cause and day: records opened, CAPAs closed, whether the pair was open
    in the window before, and its next opening in the window after."""
    marks = F.array(
        F.struct(F.col("opened").alias("day"), F.lit(1).alias("o"), F.lit(0).alias("c")),
        F.struct(F.col("capa_closed").alias("day"), F.lit(0).alias("o"), F.lit(1).alias("c")),
    )
    daily = (
        devs.select(*PAIR, F.explode(marks).alias("m")).select(*PAIR, "m.*").filter(F.col("day").isNotNull())
        .groupBy(*PAIR, "day").agg(F.sum("o").alias("n_opened"), F.sum("c").alias("n_capa_closed"))
    )
    axis = Window.partitionBy(*PAIR).orderBy(day_number(F.col("day")))
    before = axis.rangeBetween(-p.repeat_window, -1)
    after = axis.rangeBetween(1, p.effect_window)
    return daily.select(
        *PAIR, "day", "n_opened", "n_capa_closed",
        (F.coalesce(F.sum("n_opened").over(before), F.lit(0)) > 0).alias("seen_before"),
        F.min(F.when(F.col("n_opened") > 0, F.col("day"))).over(after).alias("next_opened"),
    )


def _with_repeat(devs: DataFrame, timeline: DataFrame) -> DataFrame:
    seen = timeline.select(*PAIR, F.col("day").alias("opened"), "seen_before")
    return devs.join(seen, [*PAIR, "opened"], "left").withColumn(
        "repeat", F.coalesce("seen_before", F.lit(False))).drop("seen_before")


def _with_recurrence(devs: DataFrame, timeline: DataFrame) -> DataFrame:
    nxt = timeline.filter("n_capa_closed > 0").select(
        *PAIR, F.col("day").alias("capa_closed"), F.col("next_opened").alias("recurred_on"))
    return devs.join(nxt, [*PAIR, "capa_closed"], "left")


def with_repeat(devs: DataFrame, p: DeviationParams) -> DataFrame:
    """Adds ``repeat``: same asset and cause opened in the window before, the same day excluded."""
    return _with_repeat(devs, pair_timeline(devs, p))


def with_effectiveness(devs: DataFrame, p: DeviationParams) -> DataFrame:
    """Adds ``recurred_on`` and ``effectiveness`` of closed CAPAs."""
    joined = _with_recurrence(devs, pair_timeline(devs, p))
    return joined.withColumn("effectiveness", effectiveness(p, F.col("recurred_on").isNotNull()))


def register(devs: DataFrame, p: DeviationParams) -> DataFrame:
    """The deviation log with every calculated column; both look-ups read one stored timeline."""
    timeline = durable(pair_timeline(devs, p))
    full = _with_recurrence(_with_repeat(devs, timeline), timeline)
    return full.select(
        *devs.columns, status().alias("status"), days_open(p).alias("days_open"), overdue(p).alias("overdue"),
        due_soon(p).alias("due_soon"), aging_bucket(p).alias("aging_bucket"), "repeat",
        capa_due(p).alias("capa_due"), capa_status(p).alias("capa_status"),
        effectiveness(p, F.col("recurred_on").isNotNull()).alias("effectiveness"),
        month_start(F.col("opened")).alias("opened_month"), month_start(F.col("closed")).alias("closed_month"),
        close_days_recent(p).alias("close_days_recent"), close_days_prior(p).alias("close_days_prior"),
    )


# --------------------------------------------------------------- summaries


def dev_kpis(devs: DataFrame, p: DeviationParams) -> DataFrame:
    """Thirteen figures in one row. Repeats and effectiveness are counted on the
    timeline, so no record is joined back."""
    settled = F.datediff(p.asof_day(), F.col("day")) >= p.effect_window
    came_back = F.col("next_opened").isNotNull()
    history = pair_timeline(devs, p).agg(F.struct(
        F.coalesce(F.sum(F.when(F.col("seen_before"), F.col("n_opened"))), F.lit(0)).alias("repeats"),
        F.coalesce(F.sum(F.when(came_back | settled, F.col("n_capa_closed"))), F.lit(0)).alias("judged"),
        F.coalesce(F.sum(F.when(came_back, F.col("n_capa_closed"))), F.lit(0)).alias("ineffective"),
    )).scalar()
    head = devs.agg(
        F.count("id").alias("total"), count_where(is_open()).alias("open"), count_where(overdue(p)).alias("overdue"),
        count_where(is_open() & (F.col("sev") == "Critical")).alias("critical_open"),
        F.median(close_days_recent(p)).alias("median_close_90d"), F.median(close_days_prior(p)).alias("median_close_prior"),
        count_where(has_text(F.col("capa"))).alias("capas_raised"),
        count_where(capa_status(p) == "Overdue").alias("capas_overdue"),
    ).withColumn("h", history)
    return head.select(
        "total", "open", "overdue", "critical_open", "median_close_90d", "median_close_prior",
        F.col("h.repeats").alias("repeats"),
        rounded(guarded_ratio(F.col("h.repeats"), F.col("total")), 6).alias("repeat_rate"),
        "capas_raised", "capas_overdue", F.col("h.judged").alias("capas_judged"),
        F.col("h.ineffective").alias("capas_ineffective"),
        rounded(guarded_ratio(F.col("h.judged") - F.col("h.ineffective"), F.col("h.judged")), 6).alias("effectiveness_rate"),
    )


def aging_grid(devs: DataFrame, p: DeviationParams) -> DataFrame:
    """Open records by severity and age class, with an All row and a Total column."""
    labels = [text for _, text in BUCKETS] + [LAST_BUCKET]
    cells = [count_where(F.col("b") == text).alias(text) for text in labels]
    grid = devs.filter(is_open()).select("sev", aging_bucket(p).alias("b")).rollup("sev").agg(
        F.grouping("sev").alias("is_total"), *cells, F.count(F.lit(1)).alias("Total")
    )
    named = grid.select(F.when(F.col("is_total") == 1, "All").otherwise(F.col("sev")).alias("severity"), *labels, "Total")
    rows = devs.sparkSession.createDataFrame([(s,) for s in (*SEVERITIES, "All")], "severity string")
    return rows.join(named, "severity", "left").select(
        "severity", *[F.coalesce(F.col(f"`{c}`"), F.lit(0)).alias(c) for c in (*labels, "Total")]
    )


def area_summary(devs: DataFrame, areas: DataFrame, p: DeviationParams) -> DataFrame:
    """Counts per listed area, listed areas without records included."""
    counts = with_repeat(devs, p).groupBy("area").agg(
        F.count(F.lit(1)).alias("total"), count_where(is_open()).alias("open"), count_where(overdue(p)).alias("overdue"),
        count_where(F.col("repeat")).alias("repeats"), count_where(F.col("sev") == "Critical").alias("critical"),
    )
    values = [F.coalesce(c, F.lit(0)).alias(c) for c in ("total", "open", "overdue", "repeats", "critical")]
    return areas.join(counts, "area", "left").select("area", *values)


def closeout_trend(devs: DataFrame, p: DeviationParams, first_month: str | None = None) -> DataFrame:
    """Opened, closed, median days to close and open records at the end of every month up to the as-of date."""
    marks = F.array(
        F.struct(month_start(F.col("opened")).alias("month"), F.lit(1).alias("o"), F.lit(None).cast("int").alias("d")),
        F.struct(month_start(F.col("closed")).alias("month"), F.lit(0).alias("o"), days_open(p).alias("d")),
    )
    monthly = devs.select(F.explode(marks).alias("m")).select("m.*").filter(F.col("month").isNotNull()).groupBy("month").agg(
        F.sum("o").alias("opened"), F.sum(1 - F.col("o")).alias("closed"), F.median("d").alias("median_days")
    )
    start = month_start(F.lit(first_month).cast("date")) if first_month else devs.select(
        month_start(F.min("opened"))).scalar()
    spine = devs.sparkSession.range(1).select(
        F.explode(F.sequence(start, month_start(p.asof_day()), F.expr("INTERVAL 1 MONTH"))).alias("month"))
    # Months before the spine stay in until the running count is taken.
    filled = monthly.join(spine.withColumn("listed", F.lit(True)), "month", "full")
    moves = F.coalesce("opened", F.lit(0)) - F.coalesce("closed", F.lit(0))
    return filled.withColumn("open_at_month_end", F.sum(moves).over(Window.orderBy("month"))).filter("listed").select(
        "month", F.coalesce("opened", F.lit(0)).alias("opened"), F.coalesce("closed", F.lit(0)).alias("closed"),
        F.col("median_days").alias("median_days_to_close"), F.lit(p.target).alias("target"), "open_at_month_end",
    ).orderBy("month")


def pareto(counts: DataFrame, label: str, count: str = "count") -> DataFrame:
    """Adds share and cumulative share in falling order of count; one row per label."""
    falling = Window.orderBy(F.desc(count), label).rowsBetween(Window.unboundedPreceding, 0)
    total = F.sum(count).over(Window.partitionBy())
    return counts.select(
        label, count, rounded(guarded_ratio(F.col(count), total), 6).alias("share"),
        rounded(guarded_ratio(F.sum(count).over(falling), total), 6).alias("cum_share"),
    ).orderBy(F.desc(count), label)


def root_cause_pareto(devs: DataFrame, causes: DataFrame) -> DataFrame:
    """Records per listed cause, causes without records at the end."""
    counts = devs.groupBy("cause").agg(F.count(F.lit(1)).alias("n"))
    full = causes.join(counts, "cause", "full").select("cause", F.coalesce("n", F.lit(0)).alias("count"))
    return pareto(full, "cause")


def pair_flag() -> Column:
    return first_match([
        (F.col("capas_ineffective") > 0, "CAPA ineffective"), (F.col("capas_open") > 0, "CAPA open"),
        (F.col("capas_raised") == 0, "No CAPA yet"),
    ], "Check pending")


def repeat_pairs(devs: DataFrame, p: DeviationParams) -> DataFrame:
    """(area, asset, cause) groups with two openings on different days inside the repeat window."""
    days = devs.groupBy("area", *PAIR, "opened").agg(F.count(F.lit(1)).alias("_n"))
    previous = F.lag("opened").over(Window.partitionBy("area", *PAIR).orderBy("opened"))
    repeating = days.withColumn("gap", F.datediff("opened", previous)).filter(
        F.col("gap") <= p.repeat_window).select("area", *PAIR).distinct()
    raised, done = has_text(F.col("capa")), capa_status(p) == "Closed"
    timeline = pair_timeline(devs, p)
    history = timeline.groupBy(*PAIR).agg(
        F.sum(F.when(F.col("seen_before"), F.col("n_opened")).otherwise(0)).alias("repeats"),
        F.sum(F.when(F.col("next_opened").isNotNull(), F.col("n_capa_closed")).otherwise(0)).alias("capas_ineffective"),
    )
    counts = devs.groupBy(*PAIR).agg(
        F.count(F.lit(1)).alias("records"), F.min("opened").alias("first_opened"), F.max("opened").alias("last_opened"),
        count_where(raised).alias("capas_raised"), count_where(raised & ~done).alias("capas_open"),
    )
    return repeating.join(counts, PAIR).join(history, PAIR).select(
        "area", *PAIR, "records", "repeats", "first_opened", "last_opened", "capas_raised", "capas_ineffective",
        "capas_open", pair_flag().alias("flag"),
    ).orderBy(F.desc("capas_ineffective"), F.desc("records"), "area", *PAIR)


def domain_lists(devs: DataFrame, columns: tuple[str, ...] = ("area", "sev", "cause", "owner")) -> DataFrame:
    """(list, value): the sorted distinct values of each column."""
    pairs = F.array(*[F.struct(F.lit(c).alias("list"), F.col(c).cast("string").alias("value")) for c in columns])
    return devs.select(F.explode(pairs).alias("e")).select("e.*").filter(F.col("value").isNotNull()).distinct().orderBy(
        "list", "value")


def validity_checks(devs: DataFrame, domains: DataFrame, warn_only: tuple[str, ...] = ("owner",)) -> DataFrame:
    """(id, field, value, level) for values outside their list and dates not after the earliest one."""
    listed = ("area", "sev", "cause", "owner")
    dated = ("opened", "closed", "capa_closed")
    text = F.array(*[F.struct(F.lit(c).alias("list"), F.col(c).cast("string").alias("value")) for c in listed])
    unlisted = devs.select("id", F.explode(text).alias("e")).select("id", "e.*").filter(has_text(F.col("value"))).join(
        domains.select("list", "value"), ["list", "value"], "left_anti")
    when = F.array(*[F.struct(F.lit(c).alias("list"), F.col(c).alias("d")) for c in dated])
    early = devs.select("id", F.explode(when).alias("e")).select("id", "e.*").filter(
        F.col("d") <= F.lit(EARLIEST_DATE).cast("date")).select("id", "list", F.col("d").cast("string").alias("value"))
    level = F.when(F.col("list").isin(*warn_only), "warning").otherwise("error")
    return unlisted.select("id", "list", "value").unionByName(early).select(
        "id", F.col("list").alias("field"), "value", level.alias("level"))


def oldest_open(devs: DataFrame, p: DeviationParams) -> DataFrame:
    """The open record with the earliest date, lowest id on ties."""
    first = F.min(F.struct("opened", "id", F.struct(*[c for c in devs.columns if c not in ("opened", "id")]).alias("r")))
    picked = devs.filter(is_open()).agg(first.alias("m")).filter(F.col("m").isNotNull())
    return picked.select(F.col("m.id").alias("id"), F.col("m.opened").alias("opened"), "m.r.*").withColumn(
        "days_open", days_open(p))


def register_filter(
    registered: DataFrame, chosen: dict[str, list[str]] | None = None, between: tuple[str, str, str] | None = None,
    text: str | None = None,
) -> DataFrame:
    """Rows by set membership, date range and case-blind text over all columns."""
    out = registered
    for column, values in (chosen or {}).items():
        out = out.filter(F.col(column).isin(*values))
    if between:
        column, start, end = between
        out = out.filter(F.col(column).between(F.lit(start).cast("date"), F.lit(end).cast("date")))
    if text:
        line = F.lower(F.concat_ws(" ", *[F.col(c).cast("string") for c in registered.columns]))
        out = out.filter(line.contains(text.lower()))
    return out


def repeat_rate(devs: DataFrame, p: DeviationParams) -> DataFrame:
    """Total records, repeats and their share."""
    daily = pair_timeline(devs, p)
    return daily.agg(
        F.sum("n_opened").alias("total"), F.coalesce(F.sum(F.when(F.col("seen_before"), F.col("n_opened"))), F.lit(0)).alias("repeats")
    ).withColumn("repeat_rate", rounded(guarded_ratio(F.col("repeats"), F.col("total")), 6))


def failure_gap(devs: DataFrame, p: DeviationParams) -> DataFrame:
    """Days from the close of each ineffective CAPA to the first recurrence."""
    return with_effectiveness(devs, p).filter(F.col("effectiveness") == "Ineffective").select(
        "id", "capa", "capa_closed", "recurred_on", F.datediff("recurred_on", "capa_closed").alias("days_to_recurrence"))


def capa_required(devs: DataFrame, p: DeviationParams) -> DataFrame:
    """Major and Critical records and repeating Minor ones that have no CAPA."""
    needs = F.col("sev").isin("Major", "Critical") | F.col("repeat")
    return with_repeat(devs, p).filter(~has_text(F.col("capa")) & needs).select("id", "sev", *PAIR, "opened", "repeat")
