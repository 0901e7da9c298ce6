"""Model inputs derived from the star-schema test tables.

Each function reads only the columns it needs and adds no rows of its own.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.ordering import number_rows
from .readers import star



def plus_days(start: Column, days: Column) -> Column:
    return start + F.make_dt_interval(days.cast("int"))


def plus_hours(start: Column, hours: Column) -> Column:
    return start + F.make_dt_interval(F.lit(0), hours.cast("int"))


# ---------------------------------------------------------------- retention


def retention_tables(spark: SparkSession, folder: str) -> dict[str, DataFrame]:
    """orders, customers, order_items, order_reviews, products, sellers, category_translation."""
    orders, lines = star(spark, folder, "orders"), star(spark, folder, "lineitem")
    shipped = lines.groupBy(F.col("l_orderkey").alias("order_id")).agg(F.max("l_quantity").alias("_days"))
    head = orders.select(
        F.col("o_orderkey").alias("order_id"),
        F.col("o_orderkey").alias("customer_id"),
        F.col("o_orderstatus").alias("order_status"),
        F.col("o_orderdate").alias("order_purchase_timestamp"),
    )
    full = head.join(shipped, "order_id", "left").select(
        "order_id", "customer_id", "order_status", "order_purchase_timestamp",
        plus_days(F.col("order_purchase_timestamp"), F.coalesce("_days", F.lit(20))).alias("order_delivered_customer_date"),
        plus_days(F.col("order_purchase_timestamp"), F.lit(45)).alias("order_estimated_delivery_date"),
    )
    customer = star(spark, folder, "customer").select("c_custkey", "c_nationkey")
    people = orders.join(customer, orders["o_custkey"] == customer["c_custkey"]).select(
        F.col("o_orderkey").alias("customer_id"),
        F.col("o_custkey").alias("customer_unique_id"),
        F.col("c_nationkey").alias("customer_state"),
    )
    items = lines.select(
        F.col("l_orderkey").alias("order_id"),
        F.col("l_linenumber").alias("order_item_id"),
        F.col("l_partkey").alias("product_id"),
        F.col("l_suppkey").alias("seller_id"),
        F.col("l_extendedprice").alias("price"),
        F.col("l_quantity").alias("freight_value"),
        F.col("l_shipdate").alias("shipping_limit_date"),
    )
    scored = orders.filter(F.col("o_orderkey") % 50 != 0).select(
        F.col("o_orderkey").alias("order_id"),
        F.substring("o_orderpriority", 1, 1).cast("int").alias("review_score"),
        F.lit(None).cast("string").alias("review_comment_message"),
        F.col("o_orderdate").alias("review_creation_date"),
        F.col("o_orderdate").alias("review_answer_timestamp"),
    )
    # Every seventh order also has an earlier review, which the model must ignore.
    earlier = scored.filter(F.col("order_id") % 7 == 0).select(
        "order_id", F.lit(1).alias("review_score"), "review_comment_message", "review_creation_date",
        (F.col("review_answer_timestamp") - F.make_dt_interval(F.lit(1))).alias("review_answer_timestamp"),
    )
    part = star(spark, folder, "part")
    products = part.select(
        F.col("p_partkey").alias("product_id"),
        F.when(F.col("p_partkey") % 50 != 0, F.col("p_type")).alias("product_category_name"),
    )
    translation = part.filter(F.col("p_type") != "ECONOMY").select(
        F.col("p_type").alias("product_category_name"),
        F.initcap("p_type").alias("product_category_name_english"),
    ).distinct()
    sellers = star(spark, folder, "supplier").select(
        F.col("s_suppkey").alias("seller_id"), F.col("s_nationkey").alias("seller_state")
    )
    return {
        "orders": full, "customers": people, "order_items": items, "order_reviews": scored.unionByName(earlier),
        "products": products, "sellers": sellers, "category_translation": translation,
    }


def line_reviews(spark: SparkSession, folder: str) -> DataFrame:
    """Line items read as reviews: several per order, with a total tie-break."""
    return star(spark, folder, "lineitem").select(
        F.col("l_orderkey").alias("order_id"),
        F.col("l_linenumber").alias("review_score"),
        F.col("l_returnflag").alias("review_comment_message"),
        F.col("l_shipdate").alias("review_answer_timestamp"),
        F.col("l_partkey").alias("review_creation_date"),
        F.col("l_suppkey").alias("tie1"),
        F.col("l_extendedprice").alias("tie2"),
    )


# --------------------------------------------------------------- deviations

# After the last record, so that no record is left out.
DEVIATION_ASOF = "2001-08-31"


def deviations(spark: SparkSession, folder: str, asof: str = DEVIATION_ASOF) -> DataFrame:
    """Orders read as deviation records, with closures up to the as-of date."""
    asof_day = F.lit(asof).cast("date")
    customer = star(spark, folder, "customer").select("c_custkey", "c_mktsegment", "c_nationkey")
    orders = star(spark, folder, "orders")
    opened = F.to_date("o_orderdate")
    closed = F.date_add(opened, (1 + F.col("o_orderkey") % 120).cast("int"))
    capa_closed = F.date_add(F.col("closed"), (20 + F.col("id") % 70).cast("int"))
    base = orders.join(customer, orders["o_custkey"] == customer["c_custkey"]).select(
        F.col("o_orderkey").alias("id"),
        opened.alias("opened"),
        F.col("c_mktsegment").alias("area"),
        F.col("o_custkey").alias("asset"),
        F.when(F.col("o_orderstatus") == "F", "Minor").when(F.col("o_orderstatus") == "O", "Major")
        .otherwise("Critical").alias("sev"),
        F.col("o_orderpriority").alias("cause"),
        F.concat(F.lit("Owner "), (F.col("c_nationkey") % 7).cast("string")).alias("owner"),
        F.when(closed <= asof_day, closed).alias("closed"),
    )
    return base.withColumn(
        "capa", F.when(F.col("sev") != "Minor", F.concat(F.lit("CAPA-"), F.col("id").cast("string")))
    ).withColumn("capa_closed", F.when(F.col("capa").isNotNull() & (capa_closed <= asof_day), capa_closed))


# --------------------------------------------------------------- laboratory


def _event_frame(spark: SparkSession, folder: str) -> DataFrame:
    location = F.col("user_id") % 4
    return star(spark, folder, "events").select(
        "event_id", "ts", "event_type", "user_id",
        location.alias("loc"),
        F.floor(F.col("value") / 10).cast("double").alias("result"),
        F.when(location == 0, 5.0).otherwise(6.0).alias("alert"),
        F.when(location == 0, 5.0).otherwise(12.0).alias("action"),
        plus_hours(F.col("ts"), F.col("event_id") % 120).alias("completed"),
        plus_days(F.col("ts"), F.when(F.col("event_type").isin("click", "view"), 3).otherwise(5)).alias("due"),
        F.concat(F.lit("user"), (F.col("user_id") % 6).cast("string")).alias("entered_by"),
        F.when(F.col("event_id") % 997 != 0, F.concat(F.lit("user"), (F.col("event_id") % 6).cast("string"))).alias("reviewed_by"),
    )


def laboratory_tables(spark: SparkSession, folder: str) -> dict[str, DataFrame]:
    """The ten laboratory source tables, derived from events."""
    e = _event_frame(spark, folder)
    is_em = F.col("event_type").isin("click", "view")
    sample = e.select(
        F.col("event_id").alias("SAMPLE_NUMBER"), F.col("ts").alias("LOGIN_DATE"), F.col("completed").alias("CHANGED_ON"),
        F.col("due").alias("DUE_DATE"), F.col("ts").alias("DATE_RECEIVED"), F.col("completed").alias("DATE_COMPLETED"),
        plus_hours(F.col("completed"), F.lit(5)).alias("DATE_REVIEWED"),
        F.when(F.col("event_type") == "click", "EM_SURFACE").when(F.col("event_type") == "view", "EM_AIR")
        .when(F.col("event_type") == "purchase", "BIOBURDEN").otherwise("ENDOTOXIN").alias("SAMPLE_TYPE"),
        F.concat(F.lit("CR-10"), F.col("loc").cast("string")).alias("LOCATION"),
        F.when(is_em, F.substring(F.lit("ABCD"), (F.col("loc") + 1).cast("int"), F.lit(1))).alias("PRODUCT_GRADE"),
        F.when(is_em, F.concat(F.lit("site_"), (F.col("user_id") % 11).cast("string"))).alias("SAMPLING_POINT"),
        F.when(~is_em, F.concat(F.lit("P"), (F.col("event_id") % 3).cast("string"))).alias("PRODUCT"),
        F.when(~is_em, F.concat(F.lit("L"), (F.col("event_id") % 80).cast("string"))).alias("LOT"),
        F.when(F.col("event_id") % 83 == 0, F.lit(None)).when(F.col("event_id") % 5 == 0, F.col("entered_by"))
        .otherwise(F.col("reviewed_by")).alias("REVIEWER"),
    )
    test = e.select(
        F.col("event_id").alias("TEST_NUMBER"), F.col("event_id").alias("SAMPLE_NUMBER"),
        F.when(F.col("event_id") % 2 == 0, F.concat(F.lit("INS-"), (F.col("user_id") % 9).cast("string"))).alias("INSTRUMENT"),
        F.col("ts").alias("DATE_STARTED"),
    )
    result = e.select(
        F.col("event_id").alias("RESULT_NUMBER"), F.col("event_id").alias("TEST_NUMBER"),
        F.when(F.col("event_type") == "click", "SETTLE_PLATE_TSA").when(F.col("event_type") == "view", "VIABLE_AIR_USP")
        .when(F.col("event_type") == "purchase", "BIOBURDEN_USP61").otherwise("LAL_KINETIC").alias("NAME"),
        F.col("result").alias("NUMERIC_ENTRY"),
        F.when(F.col("event_type") == "click", "CFU/plate").when(F.col("event_type") == "view", "CFU/m3")
        .when(F.col("event_type") == "purchase", "CFU/device").otherwise("EU/device").alias("UNITS"),
        F.col("alert").alias("ALERT_LIMIT"), F.col("action").alias("MAX_LIMIT"),
        F.col("entered_by").alias("ENTERED_BY"), F.col("completed").alias("ENTERED_ON"),
        F.col("reviewed_by").alias("REVIEWED_BY"), plus_hours(F.col("completed"), F.lit(5)).alias("REVIEWED_ON"),
    )
    loaded_twice = result.filter(F.col("RESULT_NUMBER") % 1000 == 0)
    oos = F.col("result") >= F.col("action")
    flags = e.select(
        F.col("event_id").alias("SAMPLE_NUMBER"), oos.alias("Flag_OOS"),
        (~oos & (F.col("result") >= F.col("alert"))).alias("Flag_Alert"),
        (F.col("event_id") % 50 == 3).alias("Flag_OOT"),
        (F.col("event_id") % 120 > 96).alias("Flag_TAT_Breach"),
    )
    lots = sample.filter(F.col("LOT").isNotNull()).groupBy(F.col("LOT").alias("LOT_NUMBER")).agg(
        F.min("PRODUCT").alias("PRODUCT"), F.min("LOGIN_DATE").alias("MFG_DATE"), F.max("DATE_COMPLETED").alias("_last")
    )
    number = F.substring("LOT_NUMBER", 2, 10).cast("int")
    # Lots whose number ends in 9 get a sibling without samples.
    untested = lots.filter(number % 10 == 9).withColumn("LOT_NUMBER", F.concat(F.lit("U"), F.col("LOT_NUMBER")))
    lot = lots.unionByName(untested).select(
        "LOT_NUMBER", "PRODUCT", "MFG_DATE",
        F.when(F.col("LOT_NUMBER").endswith("3"), F.lit(None)).otherwise(plus_days(F.col("_last"), F.lit(10))).alias("RELEASED_ON"),
        F.when(~F.col("LOT_NUMBER").endswith("3"), "RELEASED").alias("DISPOSITION"),
    )
    investigation = e.filter(oos & (F.col("event_id") % 3 == 0)).select(
        (F.col("event_id") + 700000).alias("INV_ID"), F.col("event_id").alias("RESULT_NUMBER"),
        F.when(F.col("event_id") % 2 == 0, "Phase I").otherwise("Phase II").alias("PHASE"),
        F.col("completed").alias("OPENED"), plus_hours(F.col("completed"), 24 + F.col("event_id") % 500).alias("CLOSED"),
        F.when(F.col("event_id") % 2 == 1, F.concat(F.lit("CAPA-"), F.col("event_id").cast("string"))).alias("CAPA_ID"),
    )
    spec = result.select("NAME", "UNITS", "MAX_LIMIT").groupBy("NAME", "MAX_LIMIT").agg(F.count(F.lit(1)).alias("_n")).select(
        (F.ascii("NAME") * 100 + F.col("MAX_LIMIT")).cast("bigint").alias("SPEC_ID"),
        F.when(F.col("NAME").isin("BIOBURDEN_USP61", "LAL_KINETIC"), "P0").alias("PRODUCT"),
        F.when(F.col("MAX_LIMIT") == 5, "A").alias("PRODUCT_GRADE"),
        F.when(F.col("MAX_LIMIT") == 5, "CR-100").alias("SAMPLING_POINT"),
        F.when((F.col("NAME") == "LAL_KINETIC") & (F.col("MAX_LIMIT") == 12), "WATER_BIOBURDEN").otherwise(F.col("NAME")).alias("ANALYSIS"),
        F.lit("ACTION").alias("SPEC_TYPE"), F.lit(0.0).alias("MIN_VALUE"), F.col("MAX_LIMIT").alias("MAX_VALUE"),
    )
    instruments = e.groupBy((F.col("user_id") % 12).alias("k")).agg(F.min("ts").alias("t")).select(
        F.concat(F.lit("INS-"), F.col("k").cast("string")).alias("NAME"),
        F.when(F.col("k") < 6, "Incubator").otherwise("Air sampler").alias("TYPE"),
        F.date_format(F.date_add(F.to_date("t"), 365), "yyyy-MM-dd").alias("CALIB_DUE"),
    )
    users = e.select("entered_by").distinct().filter(F.col("entered_by") != "user5").select(
        F.col("entered_by").alias("USER_NAME"),
        F.concat(F.lit("Analyst "), F.upper(F.substring("entered_by", 5, 1))).alias("FULL_NAME"),
    )
    audit = e.filter(F.col("event_id") % 47 == 0).select(
        F.col("event_id").alias("RECORD_KEY"), F.lit("RESULT").alias("TABLE_NAME"), F.lit("NUMERIC_ENTRY").alias("FIELD"),
        (F.col("result") - 1).cast("int").alias("OLD_VALUE"), F.col("result").cast("int").alias("NEW_VALUE"),
        F.col("entered_by").alias("CHANGED_BY"), plus_hours(F.col("completed"), F.col("event_id") % 31).alias("CHANGED_ON"),
        F.lit("Typing error").alias("REASON"),
    )
    return {
        "SAMPLE": sample, "TEST": test, "RESULT": result.unionByName(loaded_twice), "flagged_results": flags, "LOT": lot,
        "INVESTIGATION": investigation, "PRODUCT_SPEC": spec, "INSTRUMENTS": instruments, "LIMS_USERS": users,
        "AUDIT_TRAIL": audit,
    }


# ---------------------------------------------------------------------- SPC


def measures(spark: SparkSession, folder: str) -> DataFrame:
    """Events numbered per type and cut into subgroups of four, with special causes laid over them.

    The last subgroup of a type may have fewer values.
    """
    events = star(spark, folder, "events").select("event_type", "ts", "event_id", "value")
    numbered = number_rows(events, ["event_type"], [F.col("ts"), F.col("event_id")], "rn")
    sub = (F.floor((F.col("rn") - 1) / 4) + 1).cast("bigint")
    rep = ((F.col("rn") - 1) % 4 + 1).cast("int")
    param = F.col("event_type")
    special = (
        F.when((param == "click") & (F.col("subgroup") >= 31), 25)
        .when((param == "view") & F.col("subgroup").between(26, 45), 6 * (F.col("subgroup") - 25))
        .when((param == "error") & F.col("subgroup").between(30, 35) & (F.col("rep") == 1), 200).otherwise(0)
    )
    return numbered.withColumn("subgroup", sub).withColumn("rep", rep).select(
        param.alias("param"), "subgroup", F.to_date("ts").alias("date"), "rep",
        (F.col("value").cast("decimal(18,2)") + special).cast("double").alias("value"),
    )


def parameters(spark: SparkSession, folder: str) -> DataFrame:
    """Replicates and spec limits per event type; signup has no lower limit and view none at all."""
    kinds = star(spark, folder, "events").select(F.col("event_type").alias("param")).distinct()
    return kinds.select(
        "param", F.lit(4).alias("n"),
        F.when(~F.col("param").isin("signup", "view"), 0.0).alias("lsl"),
        F.when(F.col("param") != "view", 100.0).alias("usl"),
        F.lit("units").alias("unit"),
    )


def cause_intervals(spark: SparkSession, folder: str) -> DataFrame:
    """Known cause intervals by subgroup index."""
    kinds = star(spark, folder, "events").select(F.col("event_type").alias("param")).distinct()
    return kinds.filter(F.col("param").isin("click", "view", "error")).select(
        "param",
        F.when(F.col("param") == "click", 31).when(F.col("param") == "view", 26).otherwise(30).cast("bigint").alias("from_subgroup"),
        F.when(F.col("param") == "click", 100000000).when(F.col("param") == "view", 45).otherwise(35).cast("bigint").alias("to_subgroup"),
        F.concat(F.lit("Known cause on "), F.col("param")).alias("text"),
    )


# --------------------------------------------------------------- monitoring


def monitoring_samples(spark: SparkSession, folder: str) -> DataFrame:
    """Order lines read as single readings; in some rooms and months they drift up or down so that limits are met."""
    number, month = F.col("l_suppkey") % 17, F.trunc(F.to_date("l_shipdate"), "month")
    turn = (F.year(month) * 12 + F.month(month) + number) % 9
    drift = F.when(turn == 0, 22).when(turn == 1, -12).when(turn == 2, -18).otherwise(0)
    return star(spark, folder, "lineitem").select(
        F.concat(F.lit("R"), F.lpad(number.cast("string"), 2, "0")).alias("room"),
        F.col("l_returnflag").alias("test"), month.alias("month"), (F.col("l_quantity") + drift).alias("value"),
    )


def monitoring_context(events: DataFrame) -> DataFrame:
    """Adds the descriptive columns and the corrective action of each event."""
    index = F.year("month") * 12 + F.month("month") + F.substring("room", 2, 2).cast("int")
    # The check compares every action result with its record, so one in 23 lacks it.
    has_capa = (F.col("level") == "Action") & (index % 23 != 0)
    return events.select(
        "*",
        F.concat(F.lit("Suite "), (F.substring("room", 2, 2).cast("int") % 4).cast("string")).alias("suite"),
        F.when(has_capa, F.concat_ws("-", F.lit("CAPA"), "room", "test", F.date_format("month", "yyyyMM"))).alias("capa"),
        F.when(has_capa, F.when(index % 3 == 0, "Open").otherwise("Closed")).alias("capa_status"),
        F.when(has_capa & (index % 3 != 0), 10 + index % 50).alias("days_to_close"),
        F.when((F.col("level") != "Pass") & (index % 29 != 0), F.concat(F.lit("Cause "), (index % 13).cast("string"))).alias("root_cause"),
        F.concat(F.lit("Analyst "), (index % 5).cast("string")).alias("analyst"),
        F.concat(F.lit("Reviewer "), (index % 3).cast("string")).alias("qa_reviewer"),
    )


def monitoring_limits(spark: SparkSession, folder: str) -> DataFrame:
    """Upper limits 27/45 for A and R, a floor of 15/8 for N."""
    tests = star(spark, folder, "lineitem").select(F.col("l_returnflag").alias("test")).distinct()
    floor = F.col("test") == "N"
    return tests.select(
        "test", F.when(floor, 8.0).otherwise(45.0).alias("action"), F.when(floor, 15.0).otherwise(27.0).alias("alert"),
        F.when(floor, "low").otherwise("high").alias("direction"),
    )
