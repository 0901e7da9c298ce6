"""Customer retention: order model, cohorts, return rates and segments.

A buyer may own any share of the orders, so nothing here numbers or collects a
buyer's rows in one task: first and next orders come from per-day minima
(combined before the shuffle, and never more rows per buyer than calendar
days), and full sequences use the sliced numbering of functions.ordering.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.dates import day, month_index, month_start
from ..functions.numeric import (
    bucketed, count_where, exact_mean, exact_sum, first_match, flag, rate, rounded,
)
from ..functions.ordering import number_rows, percent_rank, tile, with_global_order
from ..functions.stats import two_prop_z


@dataclass(frozen=True)
class RetentionParams:
    delivered_status: str = "delivered"
    first_month: str = "2017-01-01"
    last_month: str = "2018-08-01"
    return_days: int = 180
    max_offset: int = 12
    value_tiles: int = 5
    min_category_buyers: int = 800
    top_categories: int = 15
    high_value_rank: float = 0.8
    active_days: int = 90
    lapsed_days: int = 270


# Labels and cut-offs of the report tables.
LATENESS = ([(0, "On time or early"), (3, "1 to 3 days late"), (7, "4 to 7 days late"), (14, "8 to 14 days late")],
            "15+ days late")
RETURN_GAP = ([(30, "1 to 30 days"), (60, "31 to 60 days"), (90, "61 to 90 days"), (180, "91 to 180 days")],
              "Over 180 days")
SEGMENTS = ("Repeat, active", "Repeat, lapsed", "New, high value", "New", "One-time, high value, cooling",
            "One-time, cooling", "One-time, high value, lost", "One-time, lost")
COMPARISONS = (("Delivery", "On time", "Late"), ("Review", "4 or 5 stars", "1 or 2 stars"),
               ("Route", "Same state", "Interstate"), ("First order value", "Quintile 5", "Quintile 1"))

BUYER = "customer_unique_id"


def days_ahead(days: int) -> Column:
    return F.make_dt_interval(F.lit(days))


# -------------------------------------------------------------------- model


def review_latest(reviews: DataFrame, ties: tuple[Column, ...] = ()) -> DataFrame:
    """One review per order: latest answer, then latest creation, then ``ties`` descending."""
    body = F.struct("review_score", "review_comment_message")
    newest = F.max(F.struct("review_answer_timestamp", "review_creation_date", *ties, body.alias("body")))
    return reviews.groupBy("order_id").agg(newest.alias("m")).select("order_id", "m.body.*")


def category_names(products: DataFrame, translation: DataFrame) -> DataFrame:
    """(product_id, category): translated name, else raw name, else 'unknown'."""
    return products.join(translation, "product_category_name", "left").select(
        "product_id",
        F.coalesce("product_category_name_english", "product_category_name", F.lit("unknown")).alias("category"),
    )


ITEM_TOTALS = ("items", "item_value", "freight_value", "gmv", "sellers")


def _totals() -> list[Column]:
    price, freight = F.col("price"), F.col("freight_value")
    reading = lambda c: c.cast("decimal(30,12)")  # noqa: E731 - their sum keeps all 12 digits
    return [
        F.count(F.lit(1)).alias("items"), exact_sum(price).cast("double").alias("item_value"),
        exact_sum(freight).cast("double").alias("freight_value"), exact_sum(reading(price) + reading(freight)).cast("double").alias("gmv"),
        F.count_distinct("seller_id").alias("sellers"),
    ]


def item_totals(items: DataFrame) -> DataFrame:
    """Counts and values per order; everything stays in hash aggregation."""
    return items.groupBy("order_id").agg(*_totals())


def _dearest(ties: tuple[str, ...]) -> Column:
    price = F.col("price")
    best = F.struct(
        price.isNull().alias("unpriced"), (-price).alias("falling"),
        *[F.col(t).alias(f"t{i}") for i, t in enumerate(ties)], F.col("product_id").alias("p"), F.col("seller_id").alias("s"),
    )
    return F.min(best).alias("m")


def main_items(items: DataFrame, ties: tuple[str, ...] = ("order_item_id",), totals: bool = False) -> DataFrame:
    """Product and seller of the highest-priced item of every order, with ``totals`` the counts and values too.

    Both come from one pass over the items and one exchange of them.
    """
    named = items.groupBy("order_id").agg(*(_totals() if totals else []), _dearest(ties))
    return named.select(
        "order_id", *(ITEM_TOTALS if totals else []), F.col("m.p").alias("product_id"), F.col("m.s").alias("main_seller_id"))


def with_category(mains: DataFrame, products: DataFrame, translation: DataFrame) -> DataFrame:
    """Adds ``main_category``; the lookup joins one row per order, not one per item."""
    return mains.join(category_names(products, translation), "product_id", "left").withColumn(
        "main_category", F.coalesce("category", F.lit("unknown"))).drop("category")


def order_items_agg(
    items: DataFrame, products: DataFrame, translation: DataFrame, ties: tuple[str, ...] = ("order_item_id",)
) -> DataFrame:
    """Totals per order with the category and seller of its highest-priced item."""
    whole = with_category(main_items(items, ties, totals=True), products, translation)
    return whole.select("order_id", *ITEM_TOTALS, "main_category", "main_seller_id")


def order_fact(
    orders: DataFrame, customers: DataFrame, parts: list[DataFrame], sellers: DataFrame | None = None,
    added: tuple[str, ...] = (),
) -> DataFrame:
    """One row per order with buyer and delivery timing, and whatever the per-order ``parts`` add.

    ``parts`` (item totals, main items, latest reviews) share the key order_id and stand
    next to each other, so the orders are exchanged once for all of them; ``added`` names further columns they bring.
    """
    bought, arrived, promised = (
        F.col(c) for c in ("order_purchase_timestamp", "order_delivered_customer_date", "order_estimated_delivery_date")
    )
    joined = orders
    for part in parts:
        joined = joined.join(part, "order_id", "left")
    joined = joined.join(customers, "customer_id")
    if sellers is not None:
        named = sellers.select(F.col("seller_id").alias("main_seller_id"), F.col("seller_state").alias("main_seller_state"))
        joined = joined.join(named, "main_seller_id", "left")
    extra = [c for c in (*ITEM_TOTALS, "main_category", "main_seller_state", "review_score") if c in joined.columns]
    return joined.select(
        "order_id", BUYER, "customer_state", "order_status",
        bought.alias("purchased_at"), month_start(bought).alias("purchase_month"),
        arrived.alias("delivered_at"), promised.alias("promised_at"),
        F.datediff(arrived, bought).alias("days_to_deliver"),
        F.datediff(arrived, promised).alias("days_late"),
        (day(arrived) > day(promised)).alias("is_late"), *extra, *added,
    )


def delivered(facts: DataFrame, params: RetentionParams) -> DataFrame:
    """Delivered orders of the analysis window.

    The window is stated on the month and, for the scan, on the timestamp itself.
    """
    first, last = F.lit(params.first_month).cast("date"), F.lit(params.last_month).cast("date")
    bought = F.col("purchased_at")
    pushed = (bought >= F.trunc(first, "month").cast("timestamp_ntz")) & (
        bought < F.add_months(F.trunc(last, "month"), 1).cast("timestamp_ntz"))
    return facts.filter(
        (F.col("order_status") == params.delivered_status) & F.col("delivered_at").isNotNull()
        & F.col("purchase_month").between(first, last) & pushed)


def build_facts(
    t: dict[str, DataFrame], item_ties: tuple[str, ...] = ("order_item_id",), columns: tuple[str, ...] | None = None,
    more: DataFrame | None = None,
) -> DataFrame:
    """Order facts from the raw tables, joining only what ``columns`` (default all) need.

    The skipped joins are left joins on a unique key, so they change no rows. ``more`` adds its columns by order_id,
    next to the other parts.
    """
    need = set(columns if columns is not None else (*ITEM_TOTALS, "main_category", "main_seller_state", "review_score"))
    parts = [] if more is None else [more]
    added = () if more is None else tuple(c for c in more.columns if c != "order_id")
    totals = bool(need & set(ITEM_TOTALS))
    if totals and not need & {"main_category", "main_seller_state"}:
        parts.append(item_totals(t["order_items"]))
    if need & {"main_category", "main_seller_state"}:
        mains = main_items(t["order_items"], item_ties, totals)
        parts.append(with_category(mains, t["products"], t["category_translation"]) if "main_category" in need else mains)
    if "review_score" in need:
        parts.append(review_latest(t["order_reviews"]).select("order_id", "review_score"))
    facts = order_fact(t["orders"], t["customers"], parts, t["sellers"] if "main_seller_state" in need else None, added)
    optional = (*ITEM_TOTALS, "main_category", "main_seller_state", "review_score")
    base = [c for c in facts.columns if c not in (*optional, *added)]
    return facts.select(*base, *[c for c in facts.columns if c in need], *added)


def build_model(
    tables: dict[str, DataFrame], params: RetentionParams, item_ties: tuple[str, ...] = ("order_item_id",),
    columns: tuple[str, ...] | None = None, more: DataFrame | None = None,
) -> DataFrame:
    """Delivered orders straight from the raw tables."""
    return delivered(build_facts(tables, item_ties, columns, more), params)


def order_sequence(sales: DataFrame) -> DataFrame:
    """(order_id, order_seq, cohort_month) of every delivered order, from keys and times alone."""
    keys = sales.select("order_id", BUYER, "purchased_at", "purchase_month")
    numbered = number_rows(keys, [BUYER], [F.col("purchased_at"), F.col("order_id")], "order_seq", firsts={"cohort_month": "purchase_month"})
    return numbered.select("order_id", "order_seq", "cohort_month")


def customer_orders(sales: DataFrame) -> DataFrame:
    """Order sequence and cohort month of every delivered order.

    Numbered are keys only. Where sales come from ``build_model``, its ``more`` takes ``order_sequence`` as one more
    part, on the exchange it has anyway.
    """
    return sales.join(order_sequence(sales), "order_id").select(*sales.columns, "order_seq", "cohort_month")


def newest(sales: DataFrame) -> Column:
    """Time of the latest order, as a scalar."""
    return sales.select(F.max("purchased_at")).scalar()


def first_orders(
    sales: DataFrame, params: RetentionParams, keep: list[str] | None = None, latest: Column | None = None
) -> DataFrame:
    """First order per buyer and the first order of the next later day, if any.

    ``keep`` names the order columns to carry; the order id and time always are. ``latest`` is the time of the newest
    order, where it can be had for less than from ``sales``: a model without columns joins neither items nor reviews.
    """
    keep = [c for c in (keep or sales.columns) if c not in (BUYER, "purchased_at", "order_id")]
    # Earliest order of each buyer and day; partial minima run before the shuffle.
    heads = sales.groupBy(BUYER, day(F.col("purchased_at")).alias("_day")).agg(
        F.min(F.struct("purchased_at", "order_id", F.struct(*keep).alias("rest") if keep else F.lit(0).alias("rest"))).alias("head")
    )
    days = Window.partitionBy(BUYER).orderBy("_day")
    paired = heads.select(
        BUYER, "head", F.row_number().over(days).alias("_n"), F.lead("head").over(days).alias("next")
    ).filter("_n = 1")
    cutoff = newest(sales) if latest is None else latest
    bought, back = F.col("head.purchased_at"), F.col("next.purchased_at")
    return paired.select(
        BUYER, F.col("head.order_id").alias("order_id"), bought.alias("purchased_at"),
        *[F.col(f"head.rest.{c}").alias(c) for c in keep],
        back.alias("return_at"),
        *([F.col("next.rest.main_category").alias("next_category")] if "main_category" in keep else []),
        (bought <= cutoff - days_ahead(params.return_days)).alias("eligible_180"),
        (back.isNotNull() & (back <= bought + days_ahead(params.return_days))).alias("repeat_180"),
    )


def _buyer_days(sales: DataFrame) -> DataFrame:
    """Orders, value and latest time per buyer and day."""
    return sales.groupBy(BUYER, day(F.col("purchased_at")).alias("_day")).agg(
        F.count(F.lit(1)).alias("_orders"), exact_sum(F.col("gmv")).alias("_gmv"),
    )


def _buyers(sales: DataFrame) -> DataFrame:
    return _buyer_days(sales).groupBy(BUYER).agg(
        F.sum("_orders").alias("orders"), F.count(F.lit(1)).alias("order_days"),
        F.max("_day").alias("last_day"), F.sum("_gmv").cast("double").alias("monetary"),
    )


# ----------------------------------------------------------------- analysis


def kpis(sales: DataFrame, params: RetentionParams, latest: Column | None = None) -> DataFrame:
    """Headline figures in one row, from three aggregates read as scalars."""
    firsts = first_orders(sales, params, keep=["gmv"], latest=latest)
    buyers = _buyers(sales).agg(F.struct(
        F.count(F.lit(1)).alias("buyers"),
        rate(F.col("orders") > 1).alias("naive"), rate(F.col("order_days") > 1).alias("any_return"),
    )).scalar()
    first = firsts.agg(F.struct(
        count_where(F.col("eligible_180")).alias("eligible"),
        F.sum(F.when(F.col("eligible_180"), flag(F.col("repeat_180")))).alias("returned"),
        rate(F.when(F.col("eligible_180"), F.col("repeat_180"))).alias("rate"),
        exact_sum(F.col("gmv")).alias("gmv"),
    )).scalar()
    head = sales.agg(
        F.count(F.lit(1)).alias("orders"), exact_sum(F.col("gmv")).alias("total"),
        exact_mean(F.col("gmv")).alias("aov"), rate(F.col("is_late")).alias("late"),
        exact_mean(F.col("review_score")).alias("review"),
        F.min("purchased_at").alias("lo"), F.max("purchased_at").alias("hi"),
    )
    return head.withColumns({"b": buyers, "f": first}).select(
        "orders", F.col("b.buyers").alias("buyers"), F.round("total", 2).cast("double").alias("gmv"),
        rounded(F.col("aov"), 2).alias("avg_order_value"), rounded(F.col("late"), 4).alias("late_rate"),
        rounded(F.col("review"), 2).alias("avg_review"), rounded(F.col("b.naive"), 4).alias("naive_repeat_rate"),
        rounded(F.col("b.any_return"), 4).alias("any_return_rate"),
        F.col("f.eligible").alias("eligible_buyers"), F.col("f.returned").alias("returned_180"),
        rounded(F.col("f.rate"), 4).alias("repeat_180_rate"),
        rounded(F.try_divide(F.col("f.gmv").cast("double"), F.col("total").cast("double")), 4).alias("first_order_gmv_share"),
        F.to_date("lo").alias("data_start"), F.to_date("hi").alias("data_end"),
    )


def monthly(sales: DataFrame, params: RetentionParams, latest: Column | None = None) -> DataFrame:
    """Orders per month; first orders are counted from the buyers' first orders, so no row is numbered."""
    starts = first_orders(sales, params, keep=["purchase_month"], latest=latest).groupBy("purchase_month").agg(
        F.count(F.lit(1)).alias("first_orders")
    )
    by_month = sales.groupBy("purchase_month").agg(
        F.count(F.lit(1)).alias("orders"), exact_sum(F.col("gmv")).alias("gmv"),
        rate(F.col("is_late")).alias("late"), exact_mean(F.col("review_score")).alias("review"),
    )
    first = F.coalesce("first_orders", F.lit(0))
    return by_month.join(starts, "purchase_month", "left").select(
        F.col("purchase_month").alias("month"), "orders", F.round("gmv", 2).cast("double").alias("gmv"),
        first.alias("first_orders"), (F.col("orders") - first).alias("repeat_orders"),
        rounded(F.col("late"), 4).alias("late_rate"), rounded(F.col("review"), 2).alias("avg_review"),
    ).orderBy("month")


def cohort(sales: DataFrame, params: RetentionParams) -> DataFrame:
    """Share of each month's new buyers active 1..max_offset months later.

    One row per buyer and month first, so distinct buyers are plain counts and a
    buyer has at most one row per month.
    """
    active = sales.groupBy(BUYER, "purchase_month").agg(F.count(F.lit(1)).alias("_n"))
    marked = active.withColumn("cohort_month", F.min("purchase_month").over(Window.partitionBy(BUYER)))
    offset = (month_index(F.col("purchase_month")) - month_index(F.col("cohort_month"))).cast("bigint")
    cells = marked.groupBy("cohort_month", offset.alias("month_offset")).agg(F.count(F.lit(1)).alias("active_buyers"))
    # Offset 0 holds every buyer of the cohort once: it is the cohort size.
    size = F.max(F.when(F.col("month_offset") == 0, F.col("active_buyers"))).over(Window.partitionBy("cohort_month"))
    return cells.withColumn("buyers", size).filter(F.col("month_offset").between(1, params.max_offset)).select(
        "cohort_month", "buyers", "month_offset", "active_buyers",
        rounded(F.col("active_buyers") / F.col("buyers"), 5).alias("retention"),
    ).orderBy("cohort_month", "month_offset")


def late_vs_review(sales: DataFrame) -> DataFrame:
    """Review scores by lateness bucket, reviewed orders only."""
    order, label = bucketed(F.col("days_late"), *LATENESS)
    score = F.col("review_score")
    return sales.filter(score.isNotNull()).groupBy(order.alias("bucket_order"), label.alias("bucket")).agg(
        F.count(F.lit(1)).alias("orders"), rounded(exact_mean(score), 2).alias("avg_review"),
        rounded(rate(score <= 2), 4).alias("negative_share"), rounded(rate(score == 5), 4).alias("five_star_share"),
    ).orderBy("bucket_order")


def late_by_state(sales: DataFrame) -> DataFrame:
    """Lateness, delivery time and review per buyer state."""
    return sales.groupBy(F.col("customer_state").alias("state")).agg(
        F.count(F.lit(1)).alias("orders"), rounded(rate(F.col("is_late")), 4).alias("late_rate"),
        rounded(F.median("days_to_deliver"), 1).alias("median_days_to_deliver"),
        rounded(exact_mean(F.col("review_score")), 2).alias("avg_review"),
        rounded(rate(F.col("customer_state") != F.col("main_seller_state")), 4).alias("interstate_share"),
    ).orderBy(F.desc("late_rate"), "state")


def _route() -> Column:
    same = F.col("customer_state") == F.col("main_seller_state")
    return F.when(same, "Same state").otherwise("Interstate")


def late_by_route(sales: DataFrame) -> DataFrame:
    """Same-state against interstate orders with a known seller state."""
    return sales.filter(F.col("main_seller_state").isNotNull()).groupBy(_route().alias("route")).agg(
        F.count(F.lit(1)).alias("orders"), rounded(rate(F.col("is_late")), 4).alias("late_rate"),
        rounded(F.median("days_to_deliver"), 1).alias("median_days_to_deliver"),
        rounded(exact_mean(F.col("review_score")), 2).alias("avg_review"),
    ).orderBy("route")


def repeat_by_first(sales: DataFrame, params: RetentionParams) -> DataFrame:
    """Return rate of eligible buyers by delivery, review, route and value tile of the first order."""
    columns = ["gmv", "is_late", "review_score", "customer_state", "main_seller_state"]
    eligible = first_orders(sales, params, keep=columns).filter("eligible_180")
    placed = with_global_order(
        eligible, [F.col("gmv").isNull(), F.col("gmv")], [F.col("order_id")], "_pos", total="_all"
    )
    score = F.col("review_score")
    quintile = tile(F.col("_pos"), F.col("_all"), params.value_tiles).cast("string")
    # One level per factor; a null level means the buyer is outside that factor.
    levels = [
        ("Delivery", 1, F.when(F.col("is_late"), "Late").otherwise("On time")),
        ("Review", 2, F.when(score >= 4, "4 or 5 stars").when(score <= 2, "1 or 2 stars").when(score.isNotNull(), "3 stars")),
        ("Route", 3, F.when(F.col("main_seller_state").isNotNull(), _route())),
        ("First order value", 4, F.concat(F.lit("Quintile "), quintile)),
    ]
    entry = F.array(*[
        F.struct(F.lit(f).alias("factor"), F.lit(o).alias("level_order"), lvl.alias("level")) for f, o, lvl in levels
    ])
    return placed.select(F.explode(entry).alias("e"), flag(F.col("repeat_180")).alias("r")).select("e.*", "r").filter(
        F.col("level").isNotNull()
    ).groupBy("factor", "level_order", "level").agg(
        F.count(F.lit(1)).alias("buyers"), F.sum("r").alias("returned"), rounded(F.avg("r"), 5).alias("repeat_rate")
    ).orderBy("level_order", "level")


def repeat_by_category(sales: DataFrame, params: RetentionParams) -> DataFrame:
    """Return rate by category of the first order, categories with enough buyers only."""
    firsts = first_orders(sales, params, keep=["gmv", "main_category"]).filter("eligible_180")
    same = F.when(F.col("repeat_180"), F.col("next_category") == F.col("main_category"))
    return firsts.groupBy(F.col("main_category").alias("category")).agg(
        F.count(F.lit(1)).alias("buyers"), F.sum(flag(F.col("repeat_180"))).alias("returned"),
        rounded(rate(F.col("repeat_180")), 5).alias("repeat_rate"),
        rounded(exact_mean(F.col("gmv")), 2).alias("avg_first_order_value"),
        rounded(rate(same), 4).alias("same_category_share"),
    ).filter(F.col("buyers") >= params.min_category_buyers).orderBy(F.desc("repeat_rate"), "category")


def return_gap(sales: DataFrame, params: RetentionParams) -> DataFrame:
    """Returning buyers by days until the first return, at any distance."""
    gap = F.datediff("return_at", "purchased_at")
    order, label = bucketed(gap, *RETURN_GAP)
    return first_orders(sales, params, keep=[]).filter(F.col("return_at").isNotNull()).groupBy(
        (order + 1).alias("bucket_order"), label.alias("gap")
    ).agg(F.count(F.lit(1)).alias("buyers")).orderBy("bucket_order")


def rfm_customers(sales: DataFrame, params: RetentionParams) -> DataFrame:
    """Frequency, recency, monetary, percent rank of monetary and segment per buyer."""
    end = sales.select(F.to_date(F.max("purchased_at"))).scalar()
    base = _buyers(sales).select(
        BUYER, F.col("order_days").alias("frequency"), F.datediff(end, F.col("last_day")).alias("recency_days"), "monetary"
    )
    ranked = with_global_order(
        base, [F.col("monetary").isNull(), F.col("monetary")], [F.col(BUYER)], "_pos", rank="_rank", total="_all"
    )
    scored = ranked.withColumn("m_pct", percent_rank(F.col("_rank"), F.col("_all")))
    repeat, high = F.col("frequency") >= 2, F.col("m_pct") >= params.high_value_rank
    recent, warm = F.col("recency_days") <= params.active_days, F.col("recency_days") <= params.lapsed_days
    tests = [repeat & warm, repeat, recent & high, recent, warm & high, warm, high]
    segment = first_match(list(zip(tests, SEGMENTS)), SEGMENTS[-1])
    return scored.select(BUYER, "frequency", "recency_days", "monetary", "m_pct", segment.alias("segment"))


def rfm(customers: DataFrame) -> DataFrame:
    """Segment summary in report order; the windows run over at most eight rows."""
    grouped = customers.groupBy("segment").agg(
        F.count(F.lit(1)).alias("buyers"), exact_sum(F.col("monetary")).alias("_gmv"),
        exact_mean(F.col("recency_days")).alias("_recency"), exact_mean(F.col("frequency")).alias("_frequency"),
        exact_mean(F.col("monetary")).alias("_spend"),
    )
    every = Window.partitionBy()
    rank = first_match([(F.col("segment") == s, i) for i, s in enumerate(SEGMENTS)])
    return grouped.select(
        "segment", "buyers",
        rounded(F.col("buyers") / F.sum("buyers").over(every), 4).alias("buyer_share"),
        F.round("_gmv", 2).cast("double").alias("gmv"),
        rounded(F.try_divide(F.col("_gmv").cast("double"), F.sum("_gmv").over(every).cast("double")), 4).alias("gmv_share"),
        rounded(F.col("_recency"), 0).alias("avg_recency_days"), rounded(F.col("_frequency"), 2).alias("avg_frequency"),
        rounded(F.col("_spend"), 2).alias("avg_spend"),
    ).orderBy(rank)


def categories(sales: DataFrame, params: RetentionParams) -> DataFrame:
    """Largest categories by value."""
    return sales.groupBy(F.col("main_category").alias("category")).agg(
        F.count(F.lit(1)).alias("orders"), F.round(exact_sum(F.col("gmv")), 2).cast("double").alias("gmv"),
        rounded(exact_mean(F.col("gmv")), 2).alias("avg_order_value"), rounded(rate(F.col("is_late")), 4).alias("late_rate"),
        rounded(exact_mean(F.col("review_score")), 2).alias("avg_review"),
    ).orderBy(F.desc_nulls_last("gmv"), "category").limit(params.top_categories)


def avg_cohort_curve(cohorts: DataFrame) -> DataFrame:
    """Unweighted mean retention over the cohorts that reached an offset."""
    return cohorts.groupBy("month_offset").agg(
        F.count(F.lit(1)).alias("cohorts"), rounded(exact_mean(F.col("retention")), 6).alias("avg_retention")
    ).orderBy("month_offset")


def same_day_repeat_share(sales: DataFrame) -> DataFrame:
    """Share of buyers with several orders whose orders all fall on one day."""
    return _buyers(sales).agg(
        count_where(F.col("orders") > 1).alias("naive_repeats"), count_where(F.col("order_days") > 1).alias("later_day_repeats")
    ).withColumn(
        "same_day_share",
        rounded(1 - F.try_divide(F.col("later_day_repeats").cast("double"), F.col("naive_repeats").cast("double")), 6),
    )


def late_first_review(sales: DataFrame, params: RetentionParams, latest: Column | None = None) -> DataFrame:
    """Share of 1 and 2 star reviews among late and on-time first orders."""
    firsts = first_orders(sales, params, keep=["is_late", "review_score"], latest=latest)
    return firsts.filter(F.col("review_score").isNotNull() & F.col("is_late").isNotNull()).groupBy("is_late").agg(
        F.count(F.lit(1)).alias("buyers"), rounded(rate(F.col("review_score") <= 2), 6).alias("negative_share")
    )


def return_gap_cum(gaps: DataFrame) -> DataFrame:
    """Cumulative share of returning buyers; at most five rows."""
    every = Window.partitionBy()
    running = F.sum("buyers").over(Window.orderBy("bucket_order"))
    return gaps.select(
        "bucket_order", "gap", "buyers", rounded(running / F.sum("buyers").over(every), 6).alias("cum_share")
    )


def identity_check(orders: DataFrame, customers: DataFrame) -> DataFrame:
    """Repeat rate when orders are keyed by the per-order id and by the person."""
    linked = orders.select("customer_id").join(customers.select("customer_id", BUYER), "customer_id")
    ids = F.array(*[
        F.struct(F.lit(name).alias("identity"), F.col(name).cast("string").alias("id")) for name in ("customer_id", BUYER)
    ])
    per_id = linked.select(F.explode(ids).alias("e")).groupBy("e.identity", "e.id").agg(F.count(F.lit(1)).alias("n"))
    return per_id.groupBy("identity").agg(F.count(F.lit(1)).alias("ids"), rounded(rate(F.col("n") > 1), 6).alias("repeat_rate"))


def return_value_estimate(sales: DataFrame, params: RetentionParams, points: float = 1.0) -> DataFrame:
    """Yearly value of ``points`` of return rate: new buyers of the last 365 days x points/100 x order value."""
    end = sales.select(F.max("purchased_at")).scalar()
    aov = sales.agg(exact_mean(F.col("gmv"))).scalar()
    firsts = first_orders(sales, params, keep=[])
    return firsts.agg(count_where(F.col("purchased_at") > end - days_ahead(365)).alias("new_buyers")).withColumn(
        "avg_order_value", rounded(aov, 2)
    ).withColumn("amount", rounded(F.col("new_buyers") * F.lit(points / 100) * F.col("avg_order_value"), 2))


def significance(by_first: DataFrame, by_category: DataFrame) -> DataFrame:
    """Two-proportion tests of the two ends of every factor, and of the best against the worst category."""
    a = first_match([(F.col("factor") == f, x) for f, x, _ in COMPARISONS])
    b = first_match([(F.col("factor") == f, y) for f, _, y in COMPARISONS])
    sides = by_first.select("factor", "level", "buyers", "returned", a.alias("a"), b.alias("b")).groupBy("factor", "a", "b").agg(*[
        F.max(F.when(F.col("level") == F.col(side), F.col(value))).alias(f"{side}_{value}")
        for side in ("a", "b") for value in ("buyers", "returned")
    ])
    ends = by_category.agg(
        F.max_by(F.struct("category", "buyers", "returned"), F.struct("repeat_rate", "category")).alias("top"),
        F.min_by(F.struct("category", "buyers", "returned"), F.struct("repeat_rate", "category")).alias("low"),
    ).filter(F.col("top").isNotNull()).select(
        F.lit("Category").alias("factor"), F.col("top.category").alias("a"), F.col("low.category").alias("b"),
        F.col("top.buyers").alias("a_buyers"), F.col("top.returned").alias("a_returned"),
        F.col("low.buyers").alias("b_buyers"), F.col("low.returned").alias("b_returned"),
    )
    test = two_prop_z(F.col("a_returned"), F.col("a_buyers"), F.col("b_returned"), F.col("b_buyers"))
    return sides.unionByName(ends).select("factor", "a", "b", *[c.alias(n) for n, c in test.items()])


def bonferroni(tests: DataFrame, alpha: float = 0.05) -> DataFrame:
    """Marks the tests that stay below alpha divided by their number; one row per test."""
    bar = F.lit(alpha) / F.count(F.lit(1)).over(Window.partitionBy())
    return tests.withColumn("threshold", rounded(bar, 6)).withColumn("significant", F.col("p") < bar)
