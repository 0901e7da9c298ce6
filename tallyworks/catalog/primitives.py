"""Relational building blocks S, F, J, G, W, O and X, each as one query over the test tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import dates, numeric
from ..functions.ordering import number_rows, percent_rank, tile, with_global_order
from ..functions.stats import ERF_A, ERF_P, erfc
from ..operators import deviations as dev
from ..operators import laboratory as lab
from ..operators import spc
from ..operators.retention import LATENESS
from ..session import durable
from ..sources import projection as src
from ..sources import readers, sinks
from . import deviations as dev_sql
from . import laboratory as lab_sql
from . import spc as spc_sql
from .laboratory import even
from .registry import big, davg, drate, dsum, query, rnd

Tables = Callable[[str], DataFrame]
one = lambda: F.count(F.lit(1))


def add(name: str, sql: str, build: Callable[[Tables], DataFrame]) -> None:
    """Register ``build``, which gets a loader of test tables."""

    @query(name, sql)
    def run(spark, folder):
        return build(lambda table: src.star(spark, folder, table))


# ------------------------------------------------------- sources and sinks

ORDERS_DDL = "o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_totalprice double, o_orderdate timestamp_ntz, o_orderpriority string"


@query("S1_csv_scan", "SELECT o_orderstatus, COUNT(*) AS n, MIN(o_orderdate) AS first_at, MAX(o_totalprice) AS top FROM orders GROUP BY 1")
def csv_scan(spark, folder):
    path = sinks.scratch_path(spark, "csv")
    sinks.write_csv(src.star(spark, folder, "orders"), path)
    orders = readers.read_csv_tables(spark, {"orders": path}, {"orders": ORDERS_DDL})["orders"]
    return orders.groupBy("o_orderstatus").agg(
        one().alias("n"), F.min("o_orderdate").alias("first_at"), F.max("o_totalprice").alias("top"))


@query("S2_load_row_audit", """SELECT 'orders' AS "table", COUNT(*) AS rows FROM orders UNION ALL SELECT 'customer', COUNT(*) FROM customer
UNION ALL SELECT 'lineitem', COUNT(*) FROM lineitem""")
def load_row_audit(spark, folder):
    return readers.row_counts(readers.read_tables(spark, folder, ("orders", "customer", "lineitem")))


@query("S3_json_scan", f"WITH {dev_sql.DEVS} SELECT area, 'Area ' || area AS area_name, cause, 'Cause ' || cause AS cause_name, COUNT(*) AS n, COUNT(closed) AS closed, MIN(opened) AS first_opened, MAX(capa_closed) AS last_closed FROM devs GROUP BY ALL")
def json_scan(spark, folder):
    text = src.deviations(spark, folder).select(
        *[F.col(c).cast("string").alias(c) for c in ("id", "opened", "area", "asset", "sev", "cause", "owner", "closed", "capa")],
        F.col("capa_closed").cast("string").alias("capaClosed"))
    # Documents of at most 500 records: ids are unique, so no group grows with the table.
    path = sinks.scratch_path(spark, "json")
    named = lambda c, value: F.map_from_entries(F.collect_set(F.struct(F.col(c), value)))
    area_name, cause_name = F.concat(F.lit("Area "), "area"), F.array(F.concat(F.lit("Cause "), "cause"), F.lit("process"))
    text.groupBy(F.floor(F.col("id").cast("bigint") / 500).alias("part")).agg(
        F.collect_list(F.struct(*text.columns)).alias("recs"), named("area", area_name).alias("areas"), named("cause", cause_name).alias("causes"),
    ).select("recs", "areas", "causes", F.lit(src.DEVIATION_ASOF).alias("asof")).write.json(path)
    records, documents = readers.deviations_from_json(spark, path, multi_line=False)
    areas = documents.select(F.explode("areas").alias("area", "area_name")).distinct()
    causes = documents.select(F.explode("causes").alias("cause", "texts")).select("cause", F.get("texts", F.lit(0)).alias("cause_name")).distinct()
    return records.join(areas, "area").join(causes, "cause").groupBy("area", "area_name", "cause", "cause_name").agg(
        one().alias("n"), F.count("closed").alias("closed"), F.min("opened").alias("first_opened"), F.max("capa_closed").alias("last_closed"))


@query("S4_multi_table_source", "SELECT n_name AS nation, COUNT(*) AS customers FROM nation JOIN customer ON c_nationkey = n_nationkey GROUP BY 1")
def multi_table_source(spark, folder):
    t = readers.read_tables(spark, folder, ("nation", "customer"))
    return t["customer"].join(t["nation"], F.col("c_nationkey") == F.col("n_nationkey")).groupBy(
        F.col("n_name").alias("nation")).agg(one().alias("customers"))


@query("S5_materialize", "SELECT l_returnflag, COUNT(DISTINCT l_orderkey) AS orders FROM lineitem GROUP BY 1")
def materialize(spark, folder):
    pairs = src.star(spark, folder, "lineitem").select("l_returnflag", "l_orderkey").distinct()
    stored = sinks.materialize(pairs, sinks.scratch_path(spark, "table"))
    return stored.groupBy("l_returnflag").agg(one().alias("orders"))


@query("S6_csv_sink", f"SELECT CAST(DATE_TRUNC('month', o_orderdate) AS DATE) AS month, COUNT(*) AS orders, {dsum('o_totalprice')} AS gmv FROM orders GROUP BY 1")
def csv_sink(spark, folder):
    monthly = src.star(spark, folder, "orders").groupBy(dates.month_start(F.col("o_orderdate")).alias("month")).agg(
        one().alias("orders"), numeric.exact_sum(F.col("o_totalprice")).cast("double").alias("gmv"))
    path = sinks.scratch_path(spark, "csv")
    sinks.write_csv(monthly, path)
    return readers.read_csv_tables(spark, {"m": path}, {"m": "month date, orders bigint, gmv double"})["m"]


@query("S7_json_sink", f"""SELECT 'flags' AS "table", l_returnflag AS name, STRFTIME(MAX(l_shipdate), '%Y-%m-%d') AS last_day, {dsum('l_extendedprice')} AS total FROM lineitem GROUP BY 2
UNION ALL SELECT 'status', o_orderstatus, STRFTIME(MAX(o_orderdate), '%Y-%m-%d'), {dsum('o_totalprice')} FROM orders GROUP BY 2""")
def json_sink(spark, folder):
    flags = src.star(spark, folder, "lineitem").groupBy(F.col("l_returnflag").alias("name")).agg(
        F.max("l_shipdate").alias("last_day"), numeric.exact_sum(F.col("l_extendedprice")).alias("total"))
    status = src.star(spark, folder, "orders").groupBy(F.col("o_orderstatus").alias("name")).agg(
        F.max("o_orderdate").alias("last_day"), numeric.exact_sum(F.col("o_totalprice")).alias("total"))
    path = sinks.scratch_path(spark, "json")
    sinks.write_json_records({"flags": flags, "status": status}, path)
    stored = spark.read.schema("value string, `table` string").text(path)
    return stored.select("table", F.from_json("value", "name string, last_day string, total double").alias("r")).select("table", "r.*")


@query("S7_json_document", f"""SELECT name, total FROM (SELECT l_returnflag AS name, {dsum('l_extendedprice')} AS total FROM lineitem GROUP BY 1)
UNION ALL SELECT 'all', {dsum('l_extendedprice')} FROM lineitem""")
def json_document(spark, folder):
    lines = src.star(spark, folder, "lineitem")
    total = numeric.exact_sum(F.col("l_extendedprice")).alias("total")
    doc = sinks.json_document({
        "all": lines.agg(F.lit("all").alias("name"), total), "flags": lines.groupBy(F.col("l_returnflag").alias("name")).agg(total),
    }, {"flags": ["name"]}, single=("all",))
    path = sinks.scratch_path(spark, "document")
    doc.select("line").write.text(path)
    # Every record is a line of its own; the others open and close the lists.
    stored = spark.read.text(path).filter("value like '{\"name%'")
    return stored.select(F.from_json(F.rtrim(F.col("value"), F.lit(",")), "name string, total double").alias("r")).select("r.*")


def _fixed(value: str, places: int) -> str:
    return f"CAST(CAST({value} AS DECIMAL(38,{places})) AS VARCHAR)"


_REPS = ", ".join(f"{_fixed(f'MAX(CASE WHEN rep = {j} THEN value END)', 2)} AS rep{j}" for j in range(1, 5))


@query("S8_spc_csv_export", f"""WITH {spc_sql.MEASURES}, r AS (SELECT param, subgroup, {_REPS} FROM measures GROUP BY 1, 2)
SELECT param, subgroup, CAST(date AS VARCHAR) AS date, rep1, rep2, rep3, rep4, {_fixed('mean', 4)} AS mean, {_fixed('range', 4)} AS range
FROM stats JOIN r USING (param, subgroup)""")
def spc_csv_export(spark, folder):
    wide = spc.replicate_columns(src.measures(spark, folder), 4)
    path = sinks.scratch_path(spark, "spc")
    sinks.write_csv(sinks.spc_table(wide, 4, 2), path)
    ddl = "param string, subgroup bigint, date string, rep1 string, rep2 string, rep3 string, rep4 string, mean string, range string"
    return readers.read_csv_tables(spark, {"x": path}, {"x": ddl})["x"]


@query("S9_compact_export", """SELECT COUNT(*) AS rows, COUNT(DISTINCT event_id) AS ids,
CAST(SUM(CASE WHEN event_id % 47 = 0 THEN 1 ELSE 0 END) AS BIGINT) AS corrected FROM events""")
def compact_export(spark, folder):
    results = durable(lab.result_fact(lab.clean_tables(src.laboratory_tables(spark, folder))).select(*lab.COMPACT))
    path = sinks.scratch_path(spark, "compact")
    sinks.write_compact(lab.compact_tables(results), path)
    stored = readers.read_compact(spark, path, lab.DIMS, ("rows",))["rows"]
    return stored.agg(one().alias("rows"), F.count_distinct("id").alias("ids"),
                      numeric.count_where(F.col("flags").bitwiseAND(128) > 0).alias("corrected"))


_FLAG_LIST = ", ".join(f'"{f}"' for f in lab.FLAGS)
_DIM_LIST = ", ".join(f'"{d}"' for d in lab.DIMS)


@query("S9_compact_decoded", f"""WITH {lab_sql.RES}, low AS (SELECT DATE_TRUNC('day', MIN("Login_Date")) AS start FROM res)
SELECT "Result_ID", start + TO_SECONDS(CAST(ROUND({even("DATE_DIFF('second', start, Login_Date) / 86400", 2)} * 86400) AS BIGINT)) AS "Login_Date",
       {_DIM_LIST}, "Result", CAST("Alert_Limit" AS DOUBLE) AS "Alert_Limit", CAST("Action_Limit" AS DOUBLE) AS "Action_Limit", "TAT_Days",
       {_FLAG_LIST}, "Audit_Corrections" > 0 AS "Corrected", "Units", MIN("Cleanroom_Grade") OVER (PARTITION BY "Location") AS "Cleanroom_Grade"
FROM res CROSS JOIN low""")
def compact_decoded(spark, folder):
    results = durable(lab.result_fact(lab.clean_tables(src.laboratory_tables(spark, folder))).select(*lab.COMPACT))
    path = sinks.scratch_path(spark, "compact")
    sinks.write_compact(lab.compact_tables(results), path)
    return lab.dictionary_decode(readers.read_compact(spark, path, lab.DIMS, ("rows", "dims", "start", "units", "grades")))


@query("S9_compact_side_tables", f"""WITH {lab_sql.INV},
{lab_sql.AUDIT.removeprefix(lab_sql.RES).lstrip(', ' + chr(10))},
lg AS ({lab_sql.LOG_SQL})
SELECT 'start' AS part, CAST(CAST(MIN("Login_Date") AS DATE) AS VARCHAR) AS a, NULL AS b, NULL AS c, NULL AS d, NULL AS e FROM res
UNION ALL SELECT 'units', "Analysis", MIN("Units"), NULL, NULL, NULL FROM res GROUP BY "Analysis"
UNION ALL SELECT 'grades', "Location", MIN("Cleanroom_Grade"), NULL, NULL, NULL FROM res GROUP BY "Location"
UNION ALL SELECT 'investigations', CAST("Investigation_ID" AS VARCHAR), CAST("Result_ID" AS VARCHAR), CAST(CAST("Opened" AS DATE) AS VARCHAR), CAST(CAST("Investigation_Days" * 10 AS BIGINT) AS VARCHAR), NULLIF("CAPA_ID", 'None') FROM inv
UNION ALL SELECT 'audit', CAST("Result_ID" AS VARCHAR), CAST(CAST("Old_Value" AS BIGINT) AS VARCHAR), CAST(CAST("New_Value" AS BIGINT) AS VARCHAR), "Changed_By", CAST(CAST("Changed_On" AS DATE) AS VARCHAR) FROM aud
UNION ALL SELECT 'log', category, action, CAST(rows_affected AS VARCHAR), NULL, NULL FROM lg""")
def compact_side_tables(spark, folder):
    raw = src.laboratory_tables(spark, folder)
    keep = tuple(dict.fromkeys((*lab.COMPACT, *lab.COUNTED, "Investigation_Days")))
    model = lab.laboratory_model(raw, keep=lambda results: durable(results.select(*keep)))
    path = sinks.scratch_path(spark, "compact")
    sinks.write_compact(lab.compact_tables(
        model["Results"], model["Investigations"], model["Audit_Trail"], lab.cleaning_log(raw, model, left_out=4)), path)
    t = readers.read_compact(spark, path, lab.DIMS, ("start", "units", "grades", "investigations", "audit", "log"))
    whole = lambda c: F.rint(c).cast("bigint")
    columns = {
        "start": ["start"], "units": ["Analysis", "Units"], "grades": ["Location", "Cleanroom_Grade"],
        "investigations": ["Investigation_ID", "Result_ID", "Opened", whole(F.col("Investigation_Days") * 10), "CAPA_ID"],
        "audit": ["Result_ID", whole(F.col("Old_Value")), whole(F.col("New_Value")), "Changed_By", "Changed_On"],
        "log": ["category", "action", "rows_affected"],
    }
    out = None
    for name, chosen in columns.items():
        cells = [F.col(c) if isinstance(c, str) else c for c in chosen] + [F.lit(None)] * (5 - len(chosen))
        part = t[name].select(F.lit(name).alias("part"), *[c.cast("string").alias(x) for c, x in zip(cells, "abcde")])
        out = part if out is None else out.unionByName(part)
    return out


@query("S10_filtered_export", "SELECT o_orderkey, o_custkey, o_orderpriority FROM orders WHERE o_orderstatus = 'P' AND o_totalprice > 300000")
def filtered_export(spark, folder):
    path = sinks.scratch_path(spark, "filtered")
    wanted = (F.col("o_orderstatus") == "P") & (F.col("o_totalprice") > 300000)
    sinks.write_filtered_csv(src.star(spark, folder, "orders"), wanted, path)
    return readers.read_csv_tables(spark, {"o": path}, {"o": ORDERS_DDL})["o"].select("o_orderkey", "o_custkey", "o_orderpriority")


# ------------------------------------------- projections, filters, predicates

add("F1_filter_between", """SELECT o_orderkey, o_orderdate FROM orders WHERE o_orderstatus = 'F' AND o_orderpriority IS NOT NULL
AND o_orderdate BETWEEN TIMESTAMP '1996-01-01' AND TIMESTAMP '2000-12-31'""",
    lambda t: t("orders").filter(
        (F.col("o_orderstatus") == "F") & F.col("o_orderpriority").isNotNull()
        & F.col("o_orderdate").between(F.lit("1996-01-01").cast("timestamp_ntz"), F.lit("2000-12-31").cast("timestamp_ntz"))
    ).select("o_orderkey", "o_orderdate"))

add("F2_boolean_filter", "SELECT l_orderkey, l_partkey FROM lineitem WHERE l_discount > 0.05",
    lambda t: t("lineitem").withColumn("cheap", F.col("l_discount") > 0.05).filter("cheap").select("l_orderkey", "l_partkey"))


def _lateness(t):
    late = F.datediff(F.col("l_shipdate"), F.lit("1998-06-01").cast("date"))
    order, label = numeric.bucketed(late, *LATENESS)
    return t("lineitem").groupBy(order.alias("bucket_order"), label.alias("bucket")).agg(one().alias("n"))


add("F3_case_buckets", f"""SELECT {big('CASE WHEN d <= 0 THEN 0 WHEN d <= 3 THEN 1 WHEN d <= 7 THEN 2 WHEN d <= 14 THEN 3 ELSE 4 END')} AS bucket_order,
CASE WHEN d <= 0 THEN 'On time or early' WHEN d <= 3 THEN '1 to 3 days late' WHEN d <= 7 THEN '4 to 7 days late' WHEN d <= 14 THEN '8 to 14 days late' ELSE '15+ days late' END AS bucket,
COUNT(*) AS n FROM (SELECT DATE_DIFF('day', TIMESTAMP '1998-06-01', l_shipdate) AS d FROM lineitem) GROUP BY 1, 2""", _lateness)

add("F4_first_match", """SELECT event_id, CASE WHEN value >= 80 THEN 'high' WHEN value >= 20 THEN 'middle' ELSE 'low' END AS level FROM events""",
    lambda t: t("events").select("event_id", numeric.first_match(
        [(F.col("value") >= 80, "high"), (F.col("value") >= 20, "middle")], "low").alias("level")))

add("F5_nested_if", """SELECT o_orderkey, CASE WHEN o_orderstatus <> 'O' THEN NULL WHEN o_totalprice <= 100000 THEN 'S' WHEN o_totalprice <= 300000 THEN 'M' ELSE 'L' END AS size FROM orders""",
    lambda t: t("orders").select("o_orderkey", F.when(F.col("o_orderstatus") == "O", numeric.first_match(
        [(F.col("o_totalprice") <= 100000, "S"), (F.col("o_totalprice") <= 300000, "M")], "L")).alias("size")))

add("F6_prefix", "SELECT p_partkey, p_brand FROM part WHERE p_brand LIKE 'Brand#1%'",
    lambda t: t("part").filter(F.col("p_brand").startswith("Brand#1")).select("p_partkey", "p_brand"))

add("F7_having", "SELECT o_custkey, COUNT(*) AS orders FROM orders GROUP BY 1 HAVING COUNT(*) >= 12",
    lambda t: t("orders").groupBy("o_custkey").agg(one().alias("orders")).filter(F.col("orders") >= 12))

# One row per key by an aggregate: unlike a window it combines before the shuffle.
add("F8_qualify_first", "SELECT o_custkey, o_orderkey, o_totalprice FROM orders QUALIFY ROW_NUMBER() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) = 1",
    lambda t: t("orders").groupBy("o_custkey").agg(F.min(F.struct("o_orderdate", "o_orderkey", "o_totalprice")).alias("m"))
    .select("o_custkey", "m.o_orderkey", "m.o_totalprice"))

add("F9_blank_to_null", "SELECT c_custkey, NULLIF(CASE WHEN c_acctbal < 0 THEN '' ELSE c_mktsegment END, '') AS segment FROM customer",
    lambda t: readers.blank_to_null(t("customer").select(
        "c_custkey", F.when(F.col("c_acctbal") < 0, "").otherwise(F.col("c_mktsegment")).alias("segment"))))

add("F10_rename_select", "SELECT s_name AS supplier, s_suppkey AS id, s_acctbal AS balance FROM supplier",
    lambda t: t("supplier").withColumnRenamed("s_name", "supplier").withColumnsRenamed({"s_suppkey": "id", "s_acctbal": "balance"})
    .select("supplier", "id", "balance"))

add("F11_drop", "SELECT o_orderkey, o_custkey, o_totalprice FROM orders",
    lambda t: t("orders").drop("o_orderstatus", "o_orderdate", "o_orderpriority"))

@query("F12_text_criteria", f"""WITH {dev_sql.DEVS}
SELECT id FROM devs WHERE LENGTH(capa) > 0 AND CAST(capa_closed AS VARCHAR) IS DISTINCT FROM '2001-06-29'""")
def text_criteria(spark, folder):
    devs = src.deviations(spark, folder)
    return devs.filter(dev.has_text(F.col("capa")) & ~F.col("capa_closed").cast("string").eqNullSafe("2001-06-29")).select("id")


add("F13_page_filters", """SELECT o_orderkey FROM orders WHERE o_orderstatus IN ('O', 'P') AND CAST(o_orderdate AS DATE) BETWEEN DATE '1997-01-01' AND DATE '1999-12-31'
AND LOWER(CONCAT_WS(' ', o_orderstatus, o_orderpriority)) LIKE '%high%'""",
    lambda t: dev.register_filter(
        t("orders").select("o_orderkey", "o_orderstatus", F.to_date("o_orderdate").alias("day"), "o_orderpriority"),
        {"o_orderstatus": ["O", "P"]}, ("day", "1997-01-01", "1999-12-31"), "High").select("o_orderkey"))

add("F14_point_lookup", "SELECT o_orderkey, o_custkey, o_totalprice FROM orders WHERE o_orderkey = 977",
    lambda t: t("orders").filter(F.col("o_orderkey") == 977).select("o_orderkey", "o_custkey", "o_totalprice"))

add("F15_optional_bounds", """SELECT event_id FROM events WHERE COALESCE(value > 100, false)
OR COALESCE(value < CASE WHEN event_type = 'view' THEN NULL ELSE 5 END, false)""",
    lambda t: t("events").filter(numeric.outside_limits(
        F.col("value"), F.when(F.col("event_type") != "view", 5.0), F.lit(100.0))).select("event_id"))

# ------------------------------------------------------------------- joins

add("J1_inner_equi", "SELECT o_orderkey, c_mktsegment FROM orders JOIN customer ON c_custkey = o_custkey",
    lambda t: t("orders").join(t("customer"), F.col("c_custkey") == F.col("o_custkey")).select("o_orderkey", "c_mktsegment"))

add("J2_left_chain", f"""SELECT o_orderkey, c_name, {big('c_nationkey')} AS c_nationkey, n_name, r_name FROM orders LEFT JOIN customer ON c_custkey = o_custkey
LEFT JOIN nation ON n_nationkey = c_nationkey LEFT JOIN region ON r_regionkey = n_regionkey""",
    lambda t: t("orders").join(t("customer"), F.col("c_custkey") == F.col("o_custkey"), "left")
    .join(t("nation"), F.col("n_nationkey") == F.col("c_nationkey"), "left")
    .join(t("region"), F.col("r_regionkey") == F.col("n_regionkey"), "left")
    .select("o_orderkey", "c_name", "c_nationkey", "n_name", "r_name"))

add("J3_left_lookup", "SELECT l_orderkey, l_partkey, p_type FROM lineitem LEFT JOIN part ON p_partkey = l_partkey",
    lambda t: t("lineitem").join(t("part"), F.col("p_partkey") == F.col("l_partkey"), "left").select("l_orderkey", "l_partkey", "p_type"))

# Earliest later day per customer: a per-day minimum and one step ahead replace the self join.
add("J4_self_theta", """SELECT a.o_custkey, CAST(a.d AS DATE) AS d, CAST(MIN(b.o_orderdate) AS DATE) AS next_day FROM (SELECT DISTINCT o_custkey, o_orderdate AS d FROM orders) a
JOIN orders b ON b.o_custkey = a.o_custkey AND b.o_orderdate > a.d GROUP BY 1, 2""",
    lambda t: t("orders").select("o_custkey", F.to_date("o_orderdate").alias("d")).distinct()
    .withColumn("next_day", F.lead("d").over(Window.partitionBy("o_custkey").orderBy("d"))).filter(F.col("next_day").isNotNull()))

add("J5_one_row_scalar", "SELECT o_orderkey, o_orderdate <= (SELECT MAX(o_orderdate) FROM orders) - INTERVAL 180 DAY AS eligible FROM orders",
    lambda t: t("orders").select("o_orderkey", (
        F.col("o_orderdate") <= t("orders").select(F.max("o_orderdate")).scalar() - F.make_dt_interval(F.lit(180))).alias("eligible")))

add("J6_two_key_pick", f"""SELECT l_orderkey, l_suppkey, {big('MIN(l_linenumber)')} AS first_line FROM lineitem GROUP BY 1, 2""",
    lambda t: t("lineitem").groupBy("l_orderkey", "l_suppkey").agg(F.min(F.struct("l_linenumber", "l_partkey"))["l_linenumber"].alias("first_line")))

add("J7_scalar_subqueries", f"""SELECT (SELECT COUNT(*) FROM orders) AS orders, (SELECT COUNT(DISTINCT o_custkey) FROM orders) AS buyers,
(SELECT {dsum('l_extendedprice')} FROM lineitem) AS value, (SELECT COUNT(*) FROM customer) AS customers""",
    lambda t: t("orders").agg(one().alias("orders"), F.count_distinct("o_custkey").alias("buyers")).select(
        "orders", "buyers", t("lineitem").agg(numeric.exact_sum(F.col("l_extendedprice")).cast("double")).scalar().alias("value"),
        t("customer").agg(one()).scalar().alias("customers")))


def _validated_join(t):
    left, right = t("orders"), t("customer")
    joined = left.join(right, left["o_custkey"] == right["c_custkey"], "left")
    repeated = lab.key_violations(right, ["c_custkey"]).agg(one()).scalar()
    return joined.agg(one().alias("rows")).select(
        "rows", left.agg(one()).scalar().alias("expected"), repeated.alias("repeated_keys"))


add("J8_validated_left", "SELECT COUNT(*) AS rows, (SELECT COUNT(*) FROM orders) AS expected, CAST(0 AS BIGINT) AS repeated_keys FROM orders LEFT JOIN customer ON c_custkey = o_custkey",
    _validated_join)

add("J9_left_other_names", "SELECT s_suppkey, n_name FROM supplier LEFT JOIN nation ON n_nationkey = s_nationkey AND n_regionkey > 1",
    lambda t: t("supplier").join(t("nation").filter("n_regionkey > 1"), F.col("n_nationkey") == F.col("s_nationkey"), "left").select("s_suppkey", "n_name"))

STATUS = {"F": "Finished", "O": "Open"}
add("J10_dictionary_lookup", "SELECT o_orderkey, CASE o_orderstatus WHEN 'F' THEN 'Finished' WHEN 'O' THEN 'Open' END AS status FROM orders",
    lambda t: t("orders").select("o_orderkey", lab.labels(STATUS, F.col("o_orderstatus")).alias("status")))

add("J11_align", """SELECT COALESCE(o_custkey, l_suppkey) AS key, COALESCE(o.n, 0) AS orders, COALESCE(l.n, 0) AS lines
FROM (SELECT o_custkey, COUNT(*) AS n FROM orders GROUP BY 1) o FULL JOIN (SELECT l_suppkey, COUNT(*) AS n FROM lineitem GROUP BY 1) l ON l_suppkey = o_custkey""",
    lambda t: t("orders").groupBy(F.col("o_custkey").alias("key")).agg(one().alias("a"))
    .join(t("lineitem").groupBy(F.col("l_suppkey").alias("key")).agg(one().alias("b")), "key", "full")
    .select("key", F.coalesce("a", F.lit(0)).alias("orders"), F.coalesce("b", F.lit(0)).alias("lines")))


def _timeline(spark, folder):
    return dev.pair_timeline(src.deviations(spark, folder), dev_sql.P)


_DAYS = "d AS (SELECT asset, cause, opened AS day, COUNT(*) AS n_opened FROM devs GROUP BY 1, 2, 3)"


@query("J12_interval_before", f"""WITH {dev_sql.DEVS}, {_DAYS}
SELECT asset, cause, day, EXISTS (SELECT 1 FROM devs e WHERE e.asset = d.asset AND e.cause = d.cause AND e.opened >= d.day - 180 AND e.opened < d.day) AS seen_before FROM d""")
def interval_before(spark, folder):
    return _timeline(spark, folder).filter("n_opened > 0").select("asset", "cause", "day", "seen_before")


@query("J13_interval_after", f"""WITH {dev_sql.DEVS}, c AS (SELECT DISTINCT asset, cause, capa_closed AS day FROM devs WHERE capa_closed IS NOT NULL)
SELECT asset, cause, day, (SELECT MIN(e.opened) FROM devs e WHERE e.asset = c.asset AND e.cause = c.cause AND e.opened > c.day AND e.opened <= c.day + 180) AS next_opened FROM c""")
def interval_after(spark, folder):
    return _timeline(spark, folder).filter("n_capa_closed > 0").select("asset", "cause", "day", "next_opened")


@query("J14_point_in_interval", f"""WITH {spc_sql.MEASURES}
SELECT param, subgroup, CASE WHEN (param = 'click' AND subgroup >= 31) OR (param = 'view' AND subgroup BETWEEN 26 AND 45) OR (param = 'error' AND subgroup BETWEEN 30 AND 35)
THEN 'Known cause on ' || param ELSE 'none' END AS cause FROM stats""")
def point_in_interval(spark, folder):
    points = src.measures(spark, folder).select("param", "subgroup").distinct()
    return spc.interval_text(points, src.cause_intervals(spark, folder), "none", block=64)


add("J15_anti", "SELECT c_custkey, c_name FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_totalprice > 400000)",
    lambda t: t("customer").join(t("orders").filter("o_totalprice > 400000"), F.col("o_custkey") == F.col("c_custkey"), "left_anti").select("c_custkey", "c_name"))


def _spine_join(t):
    day = F.to_date("o_orderdate")
    span = t("orders").agg(dates.month_start(F.min("o_orderdate")).alias("a"), dates.month_start(F.max("o_orderdate")).alias("b"))
    spine = span.select(F.explode(F.sequence("a", "b", F.expr("INTERVAL 1 MONTH"))).alias("month"))
    facts = t("orders").filter((F.col("o_orderpriority") == "1-URGENT") & (F.dayofmonth(day) == 31)).groupBy(
        dates.month_start(F.col("o_orderdate")).alias("month")).agg(one().alias("n"))
    return spine.join(facts, "month", "left").select("month", F.coalesce("n", F.lit(0)).alias("n"))


add("J16_spine_left", """WITH s AS (SELECT CAST(UNNEST(GENERATE_SERIES((SELECT DATE_TRUNC('month', MIN(o_orderdate))::TIMESTAMP FROM orders), (SELECT DATE_TRUNC('month', MAX(o_orderdate))::TIMESTAMP FROM orders), INTERVAL 1 MONTH)) AS DATE) AS month)
SELECT month, (SELECT COUNT(*) FROM orders WHERE o_orderpriority = '1-URGENT' AND DAY(o_orderdate) = 31 AND CAST(DATE_TRUNC('month', o_orderdate) AS DATE) = month) AS n FROM s""", _spine_join)

add("J17_semi", "SELECT o_orderkey FROM orders WHERE EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_quantity >= 49)",
    lambda t: t("orders").join(t("lineitem").filter("l_quantity >= 49"), F.col("l_orderkey") == F.col("o_orderkey"), "left_semi").select("o_orderkey"))

# ------------------------------------------------------------ aggregations

add("G1_basic", f"""SELECT l_returnflag, COUNT(*) AS n, {dsum('l_extendedprice')} AS total, {davg('l_quantity')} AS mean_quantity,
MIN(l_shipdate) AS first_day, MAX(l_shipdate) AS last_day FROM lineitem GROUP BY 1""",
    lambda t: t("lineitem").groupBy("l_returnflag").agg(
        one().alias("n"), numeric.exact_sum(F.col("l_extendedprice")).cast("double").alias("total"),
        numeric.exact_mean(F.col("l_quantity")).alias("mean_quantity"), F.min("l_shipdate").alias("first_day"), F.max("l_shipdate").alias("last_day")))

add("G2_count_distinct", "SELECT l_returnflag, COUNT(DISTINCT l_orderkey) AS orders, COUNT(DISTINCT l_suppkey) AS suppliers FROM lineitem GROUP BY 1",
    lambda t: t("lineitem").groupBy("l_returnflag").agg(F.count_distinct("l_orderkey").alias("orders"), F.count_distinct("l_suppkey").alias("suppliers")))

add("G3_rate", f"SELECT l_returnflag, {drate('l_discount > 0.05')} AS share FROM lineitem GROUP BY 1",
    lambda t: t("lineitem").groupBy("l_returnflag").agg(numeric.rate(F.col("l_discount") > 0.05).alias("share")))

add("G4_filtered_aggregate", f"SELECT o_orderpriority, COUNT(*) FILTER (WHERE o_orderstatus = 'F') AS finished, {dsum('CASE WHEN o_orderstatus = ' + chr(39) + 'O' + chr(39) + ' THEN o_totalprice END')} AS open_value FROM orders GROUP BY 1",
    lambda t: t("orders").groupBy("o_orderpriority").agg(
        numeric.count_where(F.col("o_orderstatus") == "F").alias("finished"),
        numeric.exact_sum(F.when(F.col("o_orderstatus") == "O", F.col("o_totalprice"))).cast("double").alias("open_value")))

add("G5_conditional_pick", "SELECT l_orderkey, ARG_MIN(l_suppkey, (-l_extendedprice, l_partkey, l_suppkey)) AS main_supplier FROM lineitem GROUP BY 1",
    lambda t: t("lineitem").groupBy("l_orderkey").agg(F.min(F.struct(-F.col("l_extendedprice"), "l_partkey", "l_suppkey"))["l_suppkey"].alias("main_supplier")))

add("G6_median", "SELECT l_returnflag, MEDIAN(l_quantity) AS median_quantity FROM lineitem GROUP BY 1",
    lambda t: t("lineitem").groupBy("l_returnflag").agg(F.median("l_quantity").alias("median_quantity")))

add("G7_conditional_median", "SELECT l_returnflag, MEDIAN(CASE WHEN l_discount > 0.05 THEN l_quantity END) AS median_quantity FROM lineitem GROUP BY 1",
    lambda t: t("lineitem").groupBy("l_returnflag").agg(F.median(F.when(F.col("l_discount") > 0.05, F.col("l_quantity"))).alias("median_quantity")))

add("G8_conditional_count", "SELECT COUNT(*) FILTER (WHERE o_orderstatus = 'O') AS a, COUNT(*) FILTER (WHERE o_orderstatus = 'O' AND o_orderpriority = '5-LOW') AS b FROM orders",
    lambda t: t("orders").agg(numeric.count_where(F.col("o_orderstatus") == "O").alias("a"),
                              numeric.count_where((F.col("o_orderstatus") == "O") & (F.col("o_orderpriority") == "5-LOW")).alias("b")))

add("G9_conditional_min_max", "SELECT o_custkey, MIN(o_orderdate) FILTER (WHERE o_orderstatus = 'F') AS first_at, MAX(o_orderdate) FILTER (WHERE o_orderstatus = 'F') AS last_at FROM orders GROUP BY 1",
    lambda t: t("orders").groupBy("o_custkey").agg(*[
        f(F.when(F.col("o_orderstatus") == "F", F.col("o_orderdate"))).alias(n) for f, n in ((F.min, "first_at"), (F.max, "last_at"))]))

add("G10_global", f"SELECT COUNT(*) AS n, {dsum('o_totalprice')} AS total, MIN(o_orderdate) AS first_at FROM orders",
    lambda t: t("orders").agg(one().alias("n"), numeric.exact_sum(F.col("o_totalprice")).cast("double").alias("total"), F.min("o_orderdate").alias("first_at")))

add("G11_size_first", "SELECT l_orderkey, COUNT(*) AS n, ARG_MIN(l_partkey, (l_shipdate, l_partkey)) AS first_part FROM lineitem GROUP BY 1",
    lambda t: t("lineitem").groupBy("l_orderkey").agg(one().alias("n"), F.min_by("l_partkey", F.struct("l_shipdate", "l_partkey")).alias("first_part")))

add("G12_value_counts", "SELECT p_type, COUNT(*) AS count FROM part GROUP BY 1",
    lambda t: t("part").groupBy("p_type").count().orderBy(F.desc("count"), "p_type"))


def _grid(t):
    cells = [numeric.count_where(F.col("o_orderstatus") == s).alias(s) for s in ("F", "O", "P")]
    grid = t("orders").rollup("o_orderpriority").agg(F.grouping("o_orderpriority").alias("g"), *cells, one().alias("total"))
    return grid.select(F.when(F.col("g") == 1, "All").otherwise(F.col("o_orderpriority")).alias("priority"), "F", "O", "P", "total")


add("G13_grid_totals", """SELECT COALESCE(o_orderpriority, 'All') AS priority, COUNT(*) FILTER (WHERE o_orderstatus = 'F') AS "F", COUNT(*) FILTER (WHERE o_orderstatus = 'O') AS "O",
COUNT(*) FILTER (WHERE o_orderstatus = 'P') AS "P", COUNT(*) AS total FROM orders GROUP BY ROLLUP (o_orderpriority)""", _grid)

add("G14_nunique_flags", f"SELECT COUNT(DISTINCT o_custkey) AS buyers, BOOL_OR(o_totalprice > 499000) AS any_large, {drate('o_totalprice > 400000')} AS large_share FROM orders",
    lambda t: t("orders").agg(F.count_distinct("o_custkey").alias("buyers"), F.bool_or(F.col("o_totalprice") > 499000).alias("any_large"),
                              numeric.rate(F.col("o_totalprice") > 400000).alias("large_share")))

add("G15_horizontal", "SELECT l_orderkey, l_partkey, (l_quantity + l_discount + l_tax) / 3 AS mean3, GREATEST(l_quantity, l_discount, l_tax) - LEAST(l_quantity, l_discount, l_tax) AS range3 FROM lineitem",
    lambda t: t("lineitem").withColumn("v", F.array("l_quantity", "l_discount", "l_tax")).select(
        "l_orderkey", "l_partkey", (F.aggregate("v", F.lit(0.0), lambda a, x: a + x) / F.size("v")).alias("mean3"),
        (F.array_max("v") - F.array_min("v")).alias("range3")))

add("G16_histogram", f"""WITH s AS (SELECT event_type, MIN(value) AS b0, (MAX(value) - MIN(value)) / 14 AS w FROM events GROUP BY 1),
b AS (SELECT e.event_type, LEAST(13, FLOOR((value - b0) / w)) AS bin FROM events e JOIN s USING (event_type))
SELECT s.event_type, {big('g.bin')} AS bin, b0 + w * (g.bin + CAST(0.5 AS DOUBLE)) AS mid, (SELECT COUNT(*) FROM b WHERE b.event_type = s.event_type AND b.bin = g.bin) AS n
FROM s, (SELECT UNNEST(RANGE(14)) AS bin) g""",
    lambda t: spc.histogram(t("events").select("event_type", "value"), "event_type", "value"))

add("G17_mean_of_means", f"""SELECT event_type, {dsum('m')} / COUNT(*) AS mean_of_means, {dsum('r')} / COUNT(*) AS mean_range
FROM (SELECT event_type, user_id, {dsum('value')} / COUNT(*) AS m, MAX(value) - MIN(value) AS r FROM events GROUP BY 1, 2) GROUP BY 1""",
    lambda t: t("events").groupBy("event_type", "user_id").agg(
        numeric.exact_mean(F.col("value")).alias("m"), (F.max("value") - F.min("value")).alias("r"))
    .groupBy("event_type").agg(numeric.exact_mean(F.col("m")).alias("mean_of_means"), numeric.exact_mean(F.col("r")).alias("mean_range")))

# ----------------------------------------------------------------- windows

add("W1_keep_latest", "SELECT o_custkey, o_orderkey, o_orderstatus FROM orders QUALIFY ROW_NUMBER() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) = 1",
    lambda t: t("orders").groupBy("o_custkey").agg(F.max(F.struct("o_orderdate", "o_orderkey", "o_orderstatus")).alias("m"))
    .select("o_custkey", "m.o_orderkey", "m.o_orderstatus"))

add("W2_sequence", "SELECT o_orderkey, ROW_NUMBER() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS seq FROM orders",
    lambda t: number_rows(t("orders").select("o_orderkey", "o_custkey", "o_orderdate"), ["o_custkey"],
                          [F.col("o_orderdate"), F.col("o_orderkey")], "seq", stored=True).select("o_orderkey", "seq"))

add("W3_first_value", "SELECT o_orderkey, FIRST_VALUE(o_orderpriority) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS first_priority FROM orders",
    lambda t: number_rows(t("orders").select("o_orderkey", "o_custkey", "o_orderdate", "o_orderpriority"), ["o_custkey"],
                          [F.col("o_orderdate"), F.col("o_orderkey")], "seq", {"first_priority": "o_orderpriority"}, stored=True).select("o_orderkey", "first_priority"))


def _ordered(t):
    spend = t("lineitem").select(
        "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_shipdate", "l_extendedprice",
        F.when(F.col("l_discount") != 0.05, F.col("l_quantity")).alias("q"))
    ties = [F.col(c) for c in ("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_shipdate", "l_extendedprice")]
    return with_global_order(spend, [F.col("q").isNull(), F.col("q")], ties, "pos", rank="rank", total="n", stored=True)


_LINE_ORDER = "CASE WHEN l_discount <> 0.05 THEN l_quantity END ASC NULLS LAST, l_orderkey, l_partkey, l_suppkey, l_linenumber, l_shipdate, l_extendedprice"
add("W4_global_ntile", f"SELECT l_orderkey, l_partkey, l_extendedprice, NTILE(7) OVER (ORDER BY {_LINE_ORDER}) AS tile FROM lineitem",
    lambda t: _ordered(t).select("l_orderkey", "l_partkey", "l_extendedprice", tile(F.col("pos"), F.col("n"), 7).alias("tile")))

add("W5_percent_rank", "SELECT l_orderkey, l_partkey, l_extendedprice, PERCENT_RANK() OVER (ORDER BY CASE WHEN l_discount <> 0.05 THEN l_quantity END ASC NULLS LAST) AS pct FROM lineitem",
    lambda t: _ordered(t).select("l_orderkey", "l_partkey", "l_extendedprice", percent_rank(F.col("rank"), F.col("n")).alias("pct")))

add("W6_share_of_total", f"SELECT l_returnflag, COUNT(*) AS n, {rnd('COUNT(*) / SUM(COUNT(*)) OVER ()', 6)} AS share FROM lineitem GROUP BY 1",
    lambda t: t("lineitem").groupBy("l_returnflag").agg(one().alias("n")).withColumn(
        "share", numeric.rounded(F.col("n") / F.sum("n").over(Window.partitionBy()), 6)))


def _months(t):
    return t("orders").groupBy(dates.month_start(F.col("o_orderdate")).alias("month")).agg(one().alias("n"))


_MONTHS = "m AS (SELECT CAST(DATE_TRUNC('month', o_orderdate) AS DATE) AS month, COUNT(*) AS n FROM orders GROUP BY 1)"

add("W7_running_total", f"WITH {_MONTHS} SELECT month, n, {big('SUM(n) OVER (ORDER BY month)')} AS running FROM m",
    lambda t: _months(t).withColumn("running", F.sum("n").over(Window.orderBy("month").rowsBetween(Window.unboundedPreceding, 0))))


def _frames(t):
    w = Window.orderBy("month")
    return _months(t).select("month", *[
        F.when(F.count(F.lit(1)).over(w.rowsBetween(1 - k, 0)) == k, F.sum("n").over(w.rowsBetween(1 - k, 0))).alias(f"last{k}") for k in (3, 5, 6, 9)])


_FRAME = ", ".join(
    f"CASE WHEN COUNT(*) OVER (ORDER BY month ROWS {k - 1} PRECEDING) = {k} THEN {big(f'SUM(n) OVER (ORDER BY month ROWS {k - 1} PRECEDING)')} END AS last{k}" for k in (3, 5, 6, 9))
add("W8_trailing_frames", f"WITH {_MONTHS} SELECT month, {_FRAME} FROM m", _frames)

add("W9_lag", f"WITH {_MONTHS} SELECT month, n - LAG(n) OVER (ORDER BY month) AS change, COALESCE(n > LAG(n) OVER (ORDER BY month), false) AS rising FROM m",
    lambda t: _months(t).select("month", (F.col("n") - F.lag("n").over(Window.orderBy("month"))).alias("change"),
                                F.coalesce(F.col("n") > F.lag("n").over(Window.orderBy("month")), F.lit(False)).alias("rising")))


def _day_counts(t):
    return t("orders").groupBy("o_custkey", F.to_date("o_orderdate").alias("day")).agg(one().alias("n"))


def _range_sum(t, low, high):
    axis = Window.partitionBy("o_custkey").orderBy(dates.day_number(F.col("day"))).rangeBetween(low, high)
    return _day_counts(t).withColumn("around", F.coalesce(F.sum("n").over(axis), F.lit(0)))


_DAY = "d AS (SELECT o_custkey, CAST(o_orderdate AS DATE) AS day, COUNT(*) AS n FROM orders GROUP BY 1, 2)"
add("W10_range_back", f"WITH {_DAY} SELECT o_custkey, day, n, (SELECT COUNT(*) FROM orders o WHERE o.o_custkey = d.o_custkey AND CAST(o_orderdate AS DATE) BETWEEN day - 180 AND day - 1) AS around FROM d",
    lambda t: _range_sum(t, -180, -1))
add("W11_range_ahead", f"WITH {_DAY} SELECT o_custkey, day, n, (SELECT COUNT(*) FROM orders o WHERE o.o_custkey = d.o_custkey AND CAST(o_orderdate AS DATE) BETWEEN day + 1 AND day + 180) AS around FROM d",
    lambda t: _range_sum(t, 1, 180))


_TREND = dev_sql.trend_sql("(SELECT CAST(MIN(opened_month) AS TIMESTAMP) FROM log)")


@query("W12_open_as_of", f"SELECT month, open_at_month_end FROM ({_TREND})")
def open_as_of(spark, folder):
    return dev.closeout_trend(src.deviations(spark, folder), dev_sql.P).select("month", "open_at_month_end")


# ------------------------------------ sorts, limits, set operations, dedupe

add("O1_multi_key_sort", "SELECT n_regionkey::BIGINT AS region, n_name AS nation FROM nation ORDER BY 1 DESC, 2",
    lambda t: t("nation").select(F.col("n_regionkey").alias("region"), F.col("n_name").alias("nation")).orderBy(F.desc("region"), "nation"))

add("O2_case_sort", "SELECT o_orderstatus, COUNT(*) AS n FROM orders GROUP BY 1",
    lambda t: t("orders").groupBy("o_orderstatus").agg(one().alias("n")).orderBy(numeric.first_match(
        [(F.col("o_orderstatus") == "P", 1), (F.col("o_orderstatus") == "O", 2)], 3)))

add("O3_top_k", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 15",
    lambda t: t("orders").select("o_orderkey", "o_totalprice").orderBy(F.desc("o_totalprice"), "o_orderkey").limit(15))

add("O4_mixed_sort", "SELECT o_custkey, COUNT(*) AS n, MAX(o_totalprice) AS top FROM orders GROUP BY 1",
    lambda t: t("orders").groupBy("o_custkey").agg(one().alias("n"), F.max("o_totalprice").alias("top")).orderBy(F.desc("n"), F.desc("top"), "o_custkey"))

add("O5_first_and_last", "SELECT ARG_MAX(o_orderkey, (o_totalprice, o_orderkey)) AS top, ARG_MIN(o_orderkey, (o_totalprice, o_orderkey)) AS bottom FROM orders",
    lambda t: t("orders").agg(F.max_by("o_orderkey", F.struct("o_totalprice", "o_orderkey")).alias("top"),
                              F.min_by("o_orderkey", F.struct("o_totalprice", "o_orderkey")).alias("bottom")))

add("O6_first_match_in_order", "SELECT event_type, MIN(event_id) FILTER (WHERE value > 60) AS first_high FROM events GROUP BY 1",
    lambda t: t("events").groupBy("event_type").agg(F.min(F.when(F.col("value") > 60, F.col("event_id"))).alias("first_high")))

# Several groupings with literal tags in one pass over the table.
add("O7_union_of_aggregates", """SELECT 'Status' AS factor, o_orderstatus AS level, COUNT(*) AS n FROM orders GROUP BY 2
UNION ALL SELECT 'Priority', o_orderpriority, COUNT(*) FROM orders GROUP BY 2 UNION ALL SELECT 'Size', CASE WHEN o_totalprice > 250000 THEN 'large' ELSE 'small' END, COUNT(*) FROM orders GROUP BY 2""",
    lambda t: t("orders").select(F.explode(F.array(*[F.struct(F.lit(n).alias("factor"), c.alias("level")) for n, c in (
        ("Status", F.col("o_orderstatus")), ("Priority", F.col("o_orderpriority")),
        ("Size", F.when(F.col("o_totalprice") > 250000, "large").otherwise("small")))])).alias("e")).groupBy("e.factor", "e.level").agg(one().alias("n")))

add("O8_exact_dedupe", "SELECT COUNT(*) AS rows_before, COUNT(DISTINCT (l_suppkey, l_returnflag, l_quantity)) AS rows_after, COUNT(*) - COUNT(DISTINCT (l_suppkey, l_returnflag, l_quantity)) AS removed FROM lineitem",
    lambda t: lab.duplicates_removed(t("lineitem").select("l_suppkey", "l_returnflag", "l_quantity")))

add("O9_distinct", "SELECT DISTINCT l_suppkey, l_returnflag FROM lineitem",
    lambda t: t("lineitem").select("l_suppkey", "l_returnflag").distinct())

add("O10_distinct_list", "SELECT DISTINCT p_type AS value FROM part ORDER BY 1",
    lambda t: t("part").select(F.col("p_type").alias("value")).distinct().orderBy("value"))

add("O11_append_missing", "SELECT n_name, COUNT(s_suppkey) AS suppliers FROM nation LEFT JOIN supplier ON s_nationkey = n_nationkey AND s_acctbal > 9000 GROUP BY 1",
    lambda t: t("nation").join(t("supplier").filter("s_acctbal > 9000").groupBy("s_nationkey").agg(one().alias("n")),
                               F.col("s_nationkey") == F.col("n_nationkey"), "left").select("n_name", F.coalesce("n", F.lit(0)).alias("suppliers")))

# -------------------------------------------------------- scalar functions

add("X1_coalesce", "SELECT event_id, COALESCE(CASE WHEN value > 50 THEN 'big' END, CASE WHEN user_id < 50 THEN 'early' END, 'none') AS tag FROM events",
    lambda t: t("events").select("event_id", F.coalesce(F.when(F.col("value") > 50, "big"), F.when(F.col("user_id") < 50, "early"), F.lit("none")).alias("tag")))

add("X2_month", "SELECT event_id, CAST(DATE_TRUNC('month', ts) AS DATE) AS month FROM events",
    lambda t: t("events").select("event_id", dates.month_start(F.col("ts")).alias("month")))

add("X3_day_difference", "SELECT event_id, DATE_DIFF('day', TIMESTAMP '2023-12-31 23:59:00', ts) AS days FROM events",
    lambda t: t("events").select("event_id", F.datediff("ts", F.lit("2023-12-31 23:59:00").cast("timestamp_ntz")).alias("days")))

add("X4_month_difference", "SELECT o_orderkey, DATE_DIFF('month', DATE '1995-01-01', o_orderdate) AS months FROM orders",
    lambda t: t("orders").select("o_orderkey", (dates.month_index(F.col("o_orderdate")) - (1995 * 12 + 1)).alias("months")))

add("X5_elapsed", "SELECT event_id, CAST(DATE_DIFF('second', TIMESTAMP '2024-01-01', DATE_TRUNC('second', ts)) AS DOUBLE) / 86400 AS days, CAST(DATE_DIFF('second', TIMESTAMP '2024-01-01', DATE_TRUNC('second', ts)) AS DOUBLE) / 3600 AS hours FROM events",
    lambda t: t("events").select("event_id", *[
        f(F.lit("2024-01-01").cast("timestamp_ntz"), F.col("ts")).alias(n) for f, n in ((dates.elapsed_days, "days"), (dates.elapsed_hours, "hours"))]))

add("X6_interval_compare", "SELECT o_orderkey, o_orderdate + INTERVAL 180 DAY AS until, o_orderdate + INTERVAL 180 DAY >= TIMESTAMP '2000-01-01' AS reaches FROM orders",
    lambda t: t("orders").withColumn("until", F.col("o_orderdate") + F.make_dt_interval(F.lit(180))).select(
        "o_orderkey", "until", (F.col("until") >= F.lit("2000-01-01").cast("timestamp_ntz")).alias("reaches")))

add("X7_round_to_minute", "SELECT event_id, MAKE_TIMESTAMP(CAST(ROUND_EVEN(EPOCH_US(ts) / 60000000, 0) AS BIGINT) * 60000000) AS minute FROM events",
    lambda t: t("events").select("event_id", dates.to_minute(F.col("ts")).alias("minute")))

add("X8_lenient_dates", "SELECT event_id, CAST(ts AS DATE) AS day, TRY_CAST(CASE WHEN event_type = 'view' THEN 'never' ELSE CAST(ts AS VARCHAR) END AS TIMESTAMP) AS parsed FROM events",
    lambda t: t("events").select("event_id", F.to_date("ts").alias("day"), F.try_to_timestamp(
        F.when(F.col("event_type") == "view", "never").otherwise(F.col("ts").cast("string"))).cast("timestamp_ntz").alias("parsed")))

add("X9_month_end", "SELECT o_orderkey, LAST_DAY(o_orderdate) AS month_end, MAKE_DATE(YEAR(o_orderdate), MONTH(o_orderdate), 1) AS month_first FROM orders",
    lambda t: t("orders").select("o_orderkey", F.last_day("o_orderdate").alias("month_end"), F.make_date(F.year("o_orderdate"), F.month("o_orderdate"), F.lit(1)).alias("month_first")))

add("X10_date_text", "SELECT o_orderkey, STRFTIME(o_orderdate, '%Y-%m') AS month_text, STRFTIME(o_orderdate, '%Y-%m-%d') AS iso FROM orders",
    lambda t: t("orders").select("o_orderkey", F.date_format("o_orderdate", "yyyy-MM").alias("month_text"), F.date_format("o_orderdate", "yyyy-MM-dd").alias("iso")))

add("X11_rounding", f"SELECT event_id, {rnd('value', 1)} AS half_up, ROUND_EVEN(value / 8, 2) AS half_even FROM events",
    lambda t: t("events").select("event_id", numeric.rounded(F.col("value"), 1).alias("half_up"), numeric.rounded_even(F.col("value") / 8, 2).alias("half_even")))

_POLY = "CAST(0.0 AS DOUBLE)"
for _a in reversed(ERF_A):
    _POLY = f"(({_POLY} + CAST({_a} AS DOUBLE)) * t)"
add("X12_math", f"""SELECT event_id, SQRT(value) AS root, ABS(value - 50) AS distance, {rnd(f'({_POLY}) * EXP(-(x * x))', 6)} AS tail FROM
(SELECT *, CAST(1.0 AS DOUBLE) / (CAST(1.0 AS DOUBLE) + CAST({ERF_P} AS DOUBLE) * x) AS t FROM (SELECT *, value / 100 AS x FROM events))""",
    lambda t: t("events").select("event_id", F.sqrt("value").alias("root"), F.abs(F.col("value") - 50).alias("distance"),
                                 numeric.rounded(erfc(F.col("value") / 100), 6).alias("tail")))

add("X13_text", "SELECT p_partkey, 'Type ' || p_type AS label, REPLACE(p_brand, '#', ' ') AS brand, UPPER(SUBSTR(p_type, 1, 1)) || LOWER(SUBSTR(p_type, 2)) AS title FROM part",
    lambda t: t("part").select("p_partkey", F.concat(F.lit("Type "), "p_type").alias("label"), F.replace("p_brand", F.lit("#"), F.lit(" ")).alias("brand"), F.initcap("p_type").alias("title")))

add("X14_zero_pad", "SELECT n_nationkey::BIGINT AS key, 'SG-' || LPAD(CAST(n_nationkey AS VARCHAR), 2, '0') AS label FROM nation",
    lambda t: t("nation").select(F.col("n_nationkey").alias("key"), spc.subgroup_label(F.col("n_nationkey")).alias("label")))

add("X15_guarded_divide", "SELECT event_id, COALESCE(value / NULLIF(user_id, 0), 0) AS ratio FROM events",
    lambda t: t("events").select("event_id", numeric.guarded_ratio(F.col("value"), F.col("user_id")).alias("ratio")))

add("X16_boolean_to_int", f"SELECT o_orderkey, {big('CAST(o_orderstatus = ' + chr(39) + 'F' + chr(39) + ' AS INT)')} AS finished FROM orders",
    lambda t: t("orders").select("o_orderkey", numeric.flag(F.col("o_orderstatus") == "F").alias("finished")))

add("X17_pack_bits", f"SELECT event_id, {big('CASE WHEN value > 50 THEN 1 ELSE 0 END + CASE WHEN user_id > 75 THEN 2 ELSE 0 END + CASE WHEN event_type = ' + chr(39) + 'view' + chr(39) + ' THEN 4 ELSE 0 END')} AS flags FROM events",
    lambda t: t("events").select("event_id", numeric.pack_bits([F.col("value") > 50, F.col("user_id") > 75, F.col("event_type") == "view"]).alias("flags")))

add("X18_least_skips_null", "SELECT event_id, LEAST(CASE WHEN value > 20 THEN value END, CAST(user_id AS DOUBLE)) AS lowest FROM events",
    lambda t: t("events").select("event_id", F.least(F.when(F.col("value") > 20, F.col("value")), F.col("user_id").cast("double")).alias("lowest")))

add("X19_array_functions", f"""SELECT l_orderkey, l_partkey, LIST_SUM([l_quantity * 2, l_discount * 2, l_tax * 2]) AS doubled,
{big('LEN(LIST_FILTER([l_quantity, l_discount, l_tax], lambda x: x > 0.03))')} AS above, l_quantity > 0 AND l_discount > 0 AND l_tax > 0 AS every FROM lineitem""",
    lambda t: t("lineitem").withColumn("v", F.array("l_quantity", "l_discount", "l_tax")).select(
        "l_orderkey", "l_partkey", F.aggregate(F.transform("v", lambda x: x * 2), F.lit(0.0), lambda a, x: a + x).alias("doubled"),
        F.size(F.filter("v", lambda x: x > 0.03)).alias("above"), F.forall("v", lambda x: x > 0).alias("every")))

add("X20_json_text", """SELECT o_orderkey, '{"key":' || o_orderkey || ',"status":"' || o_orderstatus || '","note":null}' AS doc FROM orders""",
    lambda t: t("orders").select("o_orderkey", F.to_json(F.struct(
        F.col("o_orderkey").alias("key"), F.col("o_orderstatus").alias("status"), F.lit(None).cast("string").alias("note")), {"ignoreNullFields": "false"}).alias("doc")))

add("X21_null_equality", """SELECT event_id, COALESCE(a = b, false) AS eq, a IS DISTINCT FROM b AS ne FROM (SELECT event_id, CASE WHEN event_id % 3 <> 0 THEN user_id % 2 END AS a, CASE WHEN event_id % 5 <> 0 THEN event_id % 2 END AS b FROM events)""",
    lambda t: t("events").select("event_id", F.when(F.col("event_id") % 3 != 0, F.col("user_id") % 2).alias("a"), F.when(F.col("event_id") % 5 != 0, F.col("event_id") % 2).alias("b"))
    .select("event_id", F.coalesce(F.col("a") == F.col("b"), F.lit(False)).alias("eq"), (~F.col("a").eqNullSafe(F.col("b"))).alias("ne")))
