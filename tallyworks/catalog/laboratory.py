"""Laboratory queries L1..L35."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import laboratory as op
from ..session import durable
from ..sources import projection as src
from ..sources.readers import blank_to_null
from .registry import big, davg, drate, query, rnd

SAMPLE_REVIEWER = "CASE WHEN e.event_id % 83 = 0 THEN NULL WHEN e.event_id % 5 = 0 THEN e.entered ELSE e.reviewed END"

_MINUTE = "MAKE_TIMESTAMP(CAST(ROUND_EVEN(EPOCH_US({0}) / 60000000, 0) AS BIGINT) * 60000000)"


def minute(value: str) -> str:
    return _MINUTE.format(value)


def even(value: str, places: int) -> str:
    return f"CAST(ROUND_EVEN({value}, {places}) AS DOUBLE)"


EV = f"""ev AS (
  SELECT *, user_id % 4 AS loc, FLOOR(value / 10) AS result, CAST(CASE WHEN user_id % 4 = 0 THEN 5 ELSE 6 END AS DOUBLE) AS alert,
         CAST(CASE WHEN user_id % 4 = 0 THEN 5 ELSE 12 END AS DOUBLE) AS action, ts + TO_HOURS(event_id % 120) AS completed,
         ts + TO_DAYS(CASE WHEN event_type IN ('click', 'view') THEN 3 ELSE 5 END) AS due, 'user' || (user_id % 6) AS entered,
         CASE WHEN event_id % 997 <> 0 THEN 'user' || (event_id % 6) END AS reviewed, event_type IN ('click', 'view') AS em
  FROM events
),
people AS (SELECT DISTINCT 'user' || (user_id % 6) AS u, 'Analyst ' || (user_id % 6) AS n FROM events WHERE user_id % 6 <> 5),
investigation AS (
  SELECT event_id, event_id + 700000 AS inv_id, CASE WHEN event_id % 2 = 0 THEN 'Phase I' ELSE 'Phase II' END AS phase,
         {minute('completed')} AS opened, {minute('completed + TO_HOURS(24 + event_id % 500)')} AS closed,
         CASE WHEN event_id % 2 = 1 THEN 'CAPA-' || event_id END AS capa
  FROM ev WHERE result >= action AND event_id % 3 = 0
),
audit AS (
  SELECT event_id, CAST(result - 1 AS BIGINT) AS old_value, CAST(result AS BIGINT) AS new_value, entered,
         {minute('completed + TO_HOURS(event_id % 31)')} AS changed_on
  FROM ev WHERE event_id % 47 = 0
)"""

RES = EV + f""",
res AS (
  SELECT e.event_id AS "Result_ID", e.event_id AS "Sample_ID", e.event_id AS "Test_ID", {minute('ts')} AS "Login_Date",
    CAST(DATE_TRUNC('month', {minute('ts')}) AS DATE) AS "Login_Month", {minute('due')} AS "Due_Date",
    {minute('completed')} AS "Date_Completed", {minute('completed + TO_HOURS(5)')} AS "Date_Reviewed",
    CASE WHEN em THEN 'Environmental Monitoring' ELSE 'Product Release' END AS "Sample_Category",
    CASE event_type WHEN 'click' THEN 'EM - Surface' WHEN 'view' THEN 'EM - Air' WHEN 'purchase' THEN 'Product - Bioburden' ELSE 'Product - Endotoxin' END AS "Sample_Type",
    CASE event_type WHEN 'click' THEN 'Settle Plate (TSA)' WHEN 'view' THEN 'Active Air Sample' WHEN 'purchase' THEN 'Bioburden' ELSE 'Endotoxin (Kinetic LAL)' END AS "Analysis",
    CASE event_type WHEN 'click' THEN 'SETTLE_PLATE_TSA' WHEN 'view' THEN 'VIABLE_AIR_USP' WHEN 'purchase' THEN 'BIOBURDEN_USP61' ELSE 'LAL_KINETIC' END AS "Analysis_Code",
    'CR-10' || loc AS "Location",
    CASE WHEN em THEN CASE loc WHEN 0 THEN 'Grade A (ISO 5)' WHEN 1 THEN 'Grade B (ISO 5/7)' WHEN 2 THEN 'Grade C (ISO 7)' ELSE 'Grade D (ISO 8)' END ELSE 'N/A (QC Lab)' END AS "Cleanroom_Grade",
    CASE WHEN em THEN 'Site ' || (user_id % 11) ELSE 'N/A (Product Sample)' END AS "Sampling_Point",
    CASE WHEN em THEN 'N/A (EM Sample)' ELSE 'P' || (e.event_id % 3) END AS "Product",
    CASE WHEN em THEN 'N/A (EM Sample)' ELSE 'L' || (e.event_id % 80) END AS "Lot",
    CASE WHEN e.event_id % 2 = 0 THEN 'INS-' || (user_id % 9) ELSE 'Not Recorded' END AS "Instrument",
    result AS "Result",
    CASE event_type WHEN 'click' THEN 'CFU/plate' WHEN 'view' THEN 'CFU/m3' WHEN 'purchase' THEN 'CFU/device' ELSE 'EU/device' END AS "Units",
    alert AS "Alert_Limit", action AS "Action_Limit", {even('result / action', 3)} AS "Pct_of_Action_Limit",
    CASE WHEN result >= action THEN 'OOS / Action' WHEN result >= alert THEN 'Alert' ELSE 'Within Limits' END AS "Result_Status",
    result >= action AS "Is_OOS", result >= alert AND result < action AS "Is_Alert", result = 0 AS "Is_Zero_Count",
    e.event_id % 50 = 3 AS "Is_OOT", {even('(e.event_id % 120) / 24', 2)} AS "TAT_Days", e.event_id % 120 > 96 AS "TAT_Breach_4d_SLA",
    e.event_id % 120 > CASE WHEN em THEN 72 ELSE 120 END AS "Past_Due_Date",
    COALESCE(pr.n, 'MISSING') AS "Result_Reviewer", pa.n AS "Analyst", ps.n AS "Sample_Reviewer",
    reviewed IS NULL AS "Missing_Reviewer", COALESCE(e.entered = reviewed, false) AS "Self_Reviewed",
    reviewed IS NOT NULL AND reviewed IS DISTINCT FROM {SAMPLE_REVIEWER} AS "Reviewer_Conflict",
    {big('CASE WHEN a.event_id IS NULL THEN 0 ELSE 1 END')} AS "Audit_Corrections", a.old_value AS "Original_Entry_Before_Correction",
    i.inv_id AS "Investigation_ID", i.capa AS "CAPA_ID", {even("DATE_DIFF('second', i.opened, i.closed) / 86400", 1)} AS "Investigation_Days"
  FROM ev e LEFT JOIN people pa ON pa.u = e.entered LEFT JOIN people pr ON pr.u = e.reviewed
  LEFT JOIN people ps ON ps.u = {SAMPLE_REVIEWER}
  LEFT JOIN audit a ON a.event_id = e.event_id LEFT JOIN investigation i ON i.event_id = e.event_id
)"""

LOTS = RES + f""",
lot0 AS (SELECT "Lot" AS lot, MIN("Product") AS product, MIN("Login_Date") AS mfg, MAX("Date_Completed") AS last_done FROM res WHERE "Lot" LIKE 'L%' GROUP BY 1),
lot1 AS (SELECT * FROM lot0 UNION ALL SELECT 'U' || lot, product, mfg, last_done FROM lot0 WHERE lot LIKE '%9'),
per_lot AS (SELECT "Lot" AS lot, COUNT(*) AS n, COUNT(*) FILTER (WHERE "Is_OOS") AS oos, MAX("Login_Date") AS last_login FROM res WHERE "Lot" LIKE 'L%' GROUP BY 1),
lots AS (
  SELECT l.lot AS "Lot", product AS "Product", mfg AS "Mfg_Date", released AS "Released_On",
         CASE WHEN released IS NULL THEN 'NOT RELEASED' ELSE 'RELEASED' END AS "Disposition",
         {even("DATE_DIFF('second', mfg, released) / 86400", 1)} AS "Mfg_to_Release_Days", COALESCE(n, 0) AS "Samples_Tested",
         COALESCE(oos, 0) AS "OOS_Results", last_login AS "Last_Sample_Login",
         {even("DATE_DIFF('second', last_login, released) / 86400", 1)} AS "Last_Sample_to_Release_Days"
  FROM (SELECT *, CASE WHEN lot NOT LIKE '%3' THEN last_done + TO_DAYS(10) END AS released FROM lot1) l LEFT JOIN per_lot p ON p.lot = l.lot
)"""

INV = RES + """,
inv AS (
  SELECT inv_id AS "Investigation_ID", event_id AS "Result_ID", phase AS "Phase", opened AS "Opened", closed AS "Closed", r."Investigation_Days",
         capa IS NOT NULL AS "CAPA_Raised", COALESCE(capa, 'None') AS "CAPA_ID", r."Login_Date", r."Location", r."Cleanroom_Grade", r."Analysis",
         r."Result", r."Action_Limit", r."Units"
  FROM investigation JOIN res r ON r."Result_ID" = event_id
)"""

AUDIT = RES + f""",
aud AS (
  SELECT a.event_id AS "Result_ID", 'RESULT' AS "Table", 'NUMERIC_ENTRY' AS "Field", old_value AS "Old_Value", new_value AS "New_Value",
         p.n AS "Changed_By", changed_on AS "Changed_On", 'Typing error' AS "Reason", old_value < 0 AS "Negative_Value_Corrected",
         r."Date_Completed", r."Location", r."Analysis", {even("DATE_DIFF('second', r.Date_Completed, changed_on) / 3600", 1)} AS "Hours_After_Entry"
  FROM audit a JOIN res r ON r."Result_ID" = a.event_id LEFT JOIN people p ON p.u = a.entered
)"""

SPECS = EV + """,
spec0 AS (SELECT DISTINCT CASE event_type WHEN 'click' THEN 'SETTLE_PLATE_TSA' WHEN 'view' THEN 'VIABLE_AIR_USP' WHEN 'purchase' THEN 'BIOBURDEN_USP61'
          ELSE 'LAL_KINETIC' END AS name, action FROM ev),
specs AS (SELECT *, CASE WHEN name = 'LAL_KINETIC' AND action = 12 THEN 'WATER_BIOBURDEN' ELSE name END AS code FROM spec0)"""

INSTR = RES + """,
ins0 AS (SELECT user_id % 12 AS k, MIN(ts) AS t FROM events GROUP BY 1),
ins AS (
  SELECT 'INS-' || k AS "Instrument", CASE WHEN k < 6 THEN 'Incubator' ELSE 'Air sampler' END AS "Type",
         CAST(t AS DATE) + 365 AS "Calibration_Due", (SELECT COUNT(*) FROM res WHERE "Instrument" = 'INS-' || k) AS "Results_Recorded"
  FROM ins0
)"""


def _raw(spark, folder):
    return src.laboratory_tables(spark, folder)


def _model(spark, folder, stored=False):
    return op.laboratory_model(_raw(spark, folder), keep=_counted if stored else None)


def _results(spark, folder):
    return op.result_fact(op.clean_tables(_raw(spark, folder)))


def _counted(results):
    """The columns that the reports count, written once."""
    return durable(results.select(*op.COUNTED))


@query("L1_blank_to_null", "SELECT event_id, NULLIF(CASE WHEN event_id % 3 = 0 THEN '' ELSE event_type END, '') AS kind, props FROM events")
def blank(spark, folder):
    events = src.star(spark, folder, "events")
    return blank_to_null(events.select(
        "event_id", F.when(F.col("event_id") % 3 == 0, "").otherwise(F.col("event_type")).alias("kind"), "props"))


@query("L2_dedupe_exact", """SELECT COUNT(*) + COUNT(*) FILTER (WHERE event_id % 1000 = 0) AS rows_before, COUNT(*) AS rows_after,
COUNT(*) FILTER (WHERE event_id % 1000 = 0) AS removed FROM events""")
def dedupe_counts(spark, folder):
    return op.duplicates_removed(_raw(spark, folder)["RESULT"])


@query("L2_dedupe_rows", "SELECT DISTINCT l_orderkey, CAST(l_linenumber AS BIGINT) AS l_linenumber, l_returnflag FROM lineitem")
def dedupe_rows(spark, folder):
    return op.dedupe_exact(src.star(spark, folder, "lineitem").select("l_orderkey", "l_linenumber", "l_returnflag"))


@query("L3_assert_unique_key", "SELECT l_orderkey, CAST(l_linenumber AS BIGINT) AS l_linenumber, COUNT(*) AS rows FROM lineitem GROUP BY 1, 2 HAVING COUNT(*) > 1")
def unique_key(spark, folder):
    return op.key_violations(src.star(spark, folder, "lineitem"), ["l_orderkey", "l_linenumber"])


@query("L4_round_to_minute", f"SELECT event_id, {minute('ts')} AS ts, CASE WHEN event_id % 9 <> 0 THEN {minute('ts')} END AS noted FROM events")
def round_to_minute(spark, folder):
    text = F.when(F.col("event_id") % 9 == 0, "no date").otherwise(F.date_format("ts", "yyyy-MM-dd HH:mm:ss.SSSSSS"))
    return op.round_to_minute(src.star(spark, folder, "events").select("event_id", "ts", text.alias("noted")), ("ts", "noted"))


@query("L5_decode_codes", f"""WITH {RES} SELECT "Result_ID", "Analysis", "Sample_Type", "Cleanroom_Grade", "Analyst" FROM res""")
def decode_codes(spark, folder):
    return _results(spark, folder).select("Result_ID", "Analysis", "Sample_Type", "Cleanroom_Grade", "Analyst")


FILL = {"PRODUCT": op.NO_PRODUCT, "LOT": op.NO_PRODUCT, "SAMPLING_POINT": op.NO_POINT}


@query("L6_structural_nulls", f"""WITH {RES}
SELECT 'PRODUCT' AS column, 'N/A (EM Sample)' AS label, COUNT(*) AS replaced FROM res WHERE "Product" = 'N/A (EM Sample)'
UNION ALL SELECT 'LOT', 'N/A (EM Sample)', COUNT(*) FROM res WHERE "Lot" = 'N/A (EM Sample)'
UNION ALL SELECT 'SAMPLING_POINT', 'N/A (Product Sample)', COUNT(*) FROM res WHERE "Sampling_Point" = 'N/A (Product Sample)'""")
def structural_nulls(spark, folder):
    return op.structural_null_counts(_raw(spark, folder)["SAMPLE"], FILL)


@query("L6_structural_labels", f"""WITH {RES} SELECT "Sample_ID", "Product", "Lot" FROM res""")
def structural_labels(spark, folder):
    return op.structural_nulls(_raw(spark, folder)["SAMPLE"], FILL).select(
        F.col("SAMPLE_NUMBER").alias("Sample_ID"), F.col("PRODUCT").alias("Product"), F.col("LOT").alias("Lot"))


@query("L7_result_fact", f"WITH {RES} SELECT * FROM res")
def result_fact(spark, folder):
    return _results(spark, folder)


@query("L7_join_checks", """WITH n AS (SELECT COUNT(*) AS n FROM events)
SELECT 'fact rows equal sample rows' AS "check", n AS expected, n AS actual, true AS ok FROM n
UNION ALL SELECT 'repeated TEST_NUMBER in TEST', 0, 0, true UNION ALL SELECT 'repeated RESULT_NUMBER in RESULT', 0, 0, true
UNION ALL SELECT 'repeated TEST_NUMBER in RESULT', 0, 0, true UNION ALL SELECT 'repeated SAMPLE_NUMBER in trend flags', 0, 0, true""")
def join_checks(spark, folder):
    t = op.clean_tables(_raw(spark, folder))
    return op.join_checks(t, op.result_fact(t))


@query("L8_audit_rollup", """SELECT l_orderkey AS "RECORD_KEY", COUNT(*) AS "Audit_Corrections",
ARG_MIN(l_linenumber, (l_shipdate, l_linenumber))::BIGINT AS "Original_Entry" FROM lineitem GROUP BY 1""")
def audit_rollup(spark, folder):
    changes = src.star(spark, folder, "lineitem").select(
        F.col("l_orderkey").alias("RECORD_KEY"), F.col("l_shipdate").alias("CHANGED_ON"), F.col("l_linenumber").alias("OLD_VALUE"))
    return op.audit_rollup(changes)


@query("L9_oot_flag_dim", """SELECT event_id AS "SAMPLE_NUMBER", event_id % 50 = 3 AS "Flag_OOT" FROM events""")
def oot_flag_dim(spark, folder):
    return op.oot_flag_dim(_raw(spark, folder)["flagged_results"])


@query("L10_limit_status", f"""WITH {RES} SELECT "Result_ID", "Result_Status", "Is_OOS", "Is_Alert", "Is_Zero_Count" FROM res""")
def limit_status(spark, folder):
    rules = op.limit_status(F.col("NUMERIC_ENTRY"), F.col("ALERT_LIMIT"), F.col("MAX_LIMIT"))
    result = op.dedupe_exact(_raw(spark, folder)["RESULT"])
    return result.select(F.col("RESULT_NUMBER").alias("Result_ID"), *[c.alias(n) for n, c in rules.items()])


@query("L11_pct_of_action", f"""WITH {RES} SELECT "Result_ID", "Pct_of_Action_Limit" FROM res""")
def pct_of_action(spark, folder):
    return op.dedupe_exact(_raw(spark, folder)["RESULT"]).select(
        F.col("RESULT_NUMBER").alias("Result_ID"),
        op.pct_of_action(F.col("NUMERIC_ENTRY"), F.col("MAX_LIMIT")).alias("Pct_of_Action_Limit"))


@query("L12_turnaround", f"""WITH {RES} SELECT "Sample_ID", "TAT_Days", "TAT_Breach_4d_SLA", "Past_Due_Date" FROM res""")
def turnaround(spark, folder):
    sample = op.clean_tables(_raw(spark, folder))["SAMPLE"]
    rules = op.turnaround(F.col("LOGIN_DATE"), F.col("DATE_COMPLETED"), F.col("DUE_DATE"))
    return sample.select(F.col("SAMPLE_NUMBER").alias("Sample_ID"), *[c.alias(n) for n, c in rules.items()])


@query("L13_reviewer_integrity", f"""WITH {RES} SELECT "Result_ID", "Missing_Reviewer", "Self_Reviewed", "Reviewer_Conflict" FROM res""")
def reviewer_integrity(spark, folder):
    return _results(spark, folder).select("Result_ID", "Missing_Reviewer", "Self_Reviewed", "Reviewer_Conflict")


@query("L14_flag_reconcile", """WITH n AS (SELECT COUNT(*) AS n, COUNT(*) FILTER (WHERE event_id % 101 = 0) AS bad FROM events)
SELECT 'Is_OOS' AS flag, 0 AS mismatches, n AS rows FROM n UNION ALL SELECT 'Is_Alert', bad, n FROM n UNION ALL SELECT 'TAT_Breach_4d_SLA', 0, n FROM n""")
def flag_reconcile(spark, folder):
    t = op.clean_tables(_raw(spark, folder))
    # One source flag in 101 is turned over, so the check has something to find.
    flags = t["flagged_results"].withColumn("Flag_Alert", (F.col("SAMPLE_NUMBER") % 101 == 0) != F.col("Flag_Alert"))
    return op.flag_reconcile(op.result_fact(t), flags)


@query("L15_lots_enriched", f"WITH {LOTS} SELECT * FROM lots")
def lots_enriched(spark, folder):
    return _model(spark, folder)["Lots"]


@query("L15_untested_lots", f"""WITH {LOTS} SELECT "Lot" FROM lots WHERE "Samples_Tested" = 0""")
def untested_lots(spark, folder):
    t = op.clean_tables(_raw(spark, folder))
    return op.untested_lots(t["LOT"], op.result_fact(t))


@query("L16_investigations_enriched", f"WITH {INV} SELECT * FROM inv")
def investigations_enriched(spark, folder):
    return _model(spark, folder)["Investigations"]


@query("L17_audit_enriched", f"WITH {AUDIT} SELECT * FROM aud")
def audit_enriched(spark, folder):
    return _model(spark, folder)["Audit_Trail"]


@query("L18_specs_clean", f"""WITH {SPECS}
SELECT {big('ASCII(name) * 100 + action')} AS "Spec_ID", CASE WHEN name IN ('BIOBURDEN_USP61', 'LAL_KINETIC') THEN 'P0' ELSE 'N/A (EM)' END AS "Product",
       CASE WHEN action = 5 THEN 'Grade A (ISO 5)' ELSE 'N/A' END AS "Grade", CASE WHEN action = 5 THEN 'CR-100' ELSE 'N/A' END AS "Location",
       code AS "Analysis_Code", 'ACTION' AS "Limit_Type", CAST(0 AS DOUBLE) AS "Min_Value", action AS "Max_Value",
       CASE code WHEN 'SETTLE_PLATE_TSA' THEN 'Settle Plate (TSA)' WHEN 'VIABLE_AIR_USP' THEN 'Active Air Sample' WHEN 'BIOBURDEN_USP61' THEN 'Bioburden'
            WHEN 'LAL_KINETIC' THEN 'Endotoxin (Kinetic LAL)' ELSE 'Water Bioburden' END AS "Analysis", code <> 'WATER_BIOBURDEN' AS "In_Use"
FROM specs""")
def specs_clean(spark, folder):
    return op.specs_clean(_raw(spark, folder)["PRODUCT_SPEC"])


@query("L19_instrument_usage", f"WITH {INSTR} SELECT * FROM ins")
def instrument_usage(spark, folder):
    return _model(spark, folder)["Instruments"]


LOG_SQL = f"""WITH {LOTS}, ins AS (SELECT DISTINCT 'INS-' || (user_id % 12) AS name FROM events),
x AS (SELECT COUNT(*) AS n, COUNT(*) FILTER (WHERE "Missing_Reviewer") AS miss, COUNT(*) FILTER (WHERE "Self_Reviewed") AS self,
             COUNT(*) FILTER (WHERE "Reviewer_Conflict") AS conflict, COUNT(*) FILTER (WHERE "Past_Due_Date") AS late,
             COUNT(*) FILTER (WHERE "Product" = 'N/A (EM Sample)') + COUNT(*) FILTER (WHERE "Sampling_Point" = 'N/A (Product Sample)')
               + COUNT(*) FILTER (WHERE "Instrument" = 'Not Recorded') AS blanks FROM res),
sp AS (SELECT COUNT(*) FILTER (WHERE action = 5) AS located, COUNT(*) FILTER (WHERE et = 'e' AND action = 12) AS unused
       FROM (SELECT DISTINCT CASE WHEN event_type IN ('click', 'view', 'purchase') THEN event_type ELSE 'e' END AS et, action FROM ev))
SELECT {big(1)} AS step, 'Scope' AS category, 'Model' AS "table", 'Left out tables without source data' AS action, {big(4)} AS rows_affected
UNION ALL SELECT 2, 'Duplicates', 'RESULT', 'Removed exact duplicate rows', (SELECT COUNT(*) FROM events WHERE event_id % 1000 = 0)
UNION ALL SELECT 3, 'Formatting', 'All', 'Rounded timestamps to the minute', n * 6 FROM x
UNION ALL SELECT 4, 'Modeling', 'Results', 'Joined the source tables into one row per result', n FROM x
UNION ALL SELECT 5, 'Dropped columns', 'SAMPLE / TEST / RESULT', 'Removed constant and copied columns', n FROM x
UNION ALL SELECT 6, 'Dropped columns', 'TEST / INVESTIGATION', 'Removed empty columns', n + (SELECT COUNT(*) FROM investigation) FROM x
UNION ALL SELECT 7, 'Decoding', 'Results', 'Replaced codes with labels', n FROM x
UNION ALL SELECT 8, 'Nulls', 'Results', 'Labelled structural blanks', blanks FROM x
UNION ALL SELECT 9, 'Derived fields', 'Results', 'Added analysis fields', n FROM x
UNION ALL SELECT 10, 'Flagged - not changed', 'Results', 'No result reviewer', miss FROM x
UNION ALL SELECT 11, 'Flagged - not changed', 'Results', 'Reviewed by the analyst who entered the result', self FROM x
UNION ALL SELECT 12, 'Flagged - not changed', 'Results', 'Sample and result reviewer differ', conflict FROM x
UNION ALL SELECT 13, 'Flagged - not changed', 'Results', 'Completed after the due date', late FROM x
UNION ALL SELECT 14, 'Flagged - not changed', 'Audit_Trail', 'Corrected a negative value', (SELECT COUNT(*) FROM audit WHERE old_value < 0)
UNION ALL SELECT 15, 'Nulls', 'Lots', 'Labelled blank dispositions', (SELECT COUNT(*) FROM lots WHERE "Disposition" = 'NOT RELEASED')
UNION ALL SELECT 16, 'Flagged - not changed', 'Lots', 'No test samples', (SELECT COUNT(*) FROM lots WHERE "Samples_Tested" = 0)
UNION ALL SELECT 17, 'Renaming', 'Specs', 'Renamed the column that holds locations', located FROM sp
UNION ALL SELECT 18, 'Flagged - not changed', 'Specs', 'Specification not in use', unused FROM sp
UNION ALL SELECT 19, 'Flagged - not changed', 'Instruments', 'No results linked', (SELECT COUNT(*) FROM ins WHERE name NOT IN (SELECT "Instrument" FROM res))"""


@query("L20_cleaning_log", LOG_SQL)
def cleaning_log(spark, folder):
    raw = _raw(spark, folder)
    return op.cleaning_log(raw, op.laboratory_model(raw, keep=_counted), left_out=4)


def _share(part: str, whole: str) -> str:
    return rnd(f"CAST({part} AS DOUBLE) / {whole}", 6)


@query("L21_quality_summary", f"""WITH {LOTS},
x AS (SELECT COUNT(*) AS n, COUNT(DISTINCT "Sample_ID") AS samples, COUNT(*) FILTER (WHERE "Is_OOS") AS oos, COUNT(*) FILTER (WHERE "Is_Alert") AS alert,
             COUNT(*) FILTER (WHERE "Is_OOT") AS oot, COUNT(*) FILTER (WHERE NOT ("Is_OOS" OR "Is_Alert" OR "Is_OOT")) AS fine, MEDIAN("TAT_Days") AS tat,
             COUNT(*) FILTER (WHERE "TAT_Breach_4d_SLA") AS breach, COUNT(*) FILTER (WHERE "Past_Due_Date") AS late,
             COUNT(*) FILTER (WHERE "Self_Reviewed") AS self FROM res),
i AS (SELECT COUNT(*) AS n, COUNT(capa) AS capa FROM investigation),
l AS (SELECT COUNT(*) AS n, COUNT(*) FILTER (WHERE "Disposition" = 'RELEASED') AS out FROM lots),
a AS (SELECT COUNT(*) AS n, COUNT(*) FILTER (WHERE old_value < 0) AS neg FROM audit)
SELECT 'Results (clean)' AS metric, CAST(n AS DOUBLE) AS value, CAST(NULL AS DOUBLE) AS share FROM x
UNION ALL SELECT 'Samples', samples, NULL FROM x UNION ALL SELECT 'OOS results', oos, {_share('oos', 'n')} FROM x
UNION ALL SELECT 'Alert results', alert, {_share('alert', 'n')} FROM x UNION ALL SELECT 'OOT results', oot, {_share('oot', 'n')} FROM x
UNION ALL SELECT 'Right-first-time', fine, {_share('fine', 'n')} FROM x UNION ALL SELECT 'Median TAT (days)', {rnd('tat', 2)}, NULL FROM x
UNION ALL SELECT 'TAT breach', breach, {_share('breach', 'n')} FROM x UNION ALL SELECT 'Past due date', late, {_share('late', 'n')} FROM x
UNION ALL SELECT 'Investigations', n, NULL FROM i UNION ALL SELECT 'Investigations with CAPA', capa, {_share('capa', 'n')} FROM i
UNION ALL SELECT 'Lots released', out, {_share('out', 'n')} FROM l UNION ALL SELECT 'Self-reviewed results', self, {_share('self', 'n')} FROM x
UNION ALL SELECT 'Audit-trail corrections', n, NULL FROM a UNION ALL SELECT 'Negative values corrected', neg, {_share('neg', 'n')} FROM a""")
def quality_summary(spark, folder):
    return op.quality_summary(_model(spark, folder, stored=True))


@query("L22_data_dictionary", f"""WITH {AUDIT},
lens AS (SELECT COUNT(*) AS n, COUNT(p.n) AS named FROM ev LEFT JOIN people p ON p.u = ev.entered)
SELECT 'Audit_Trail' AS "table", v.field, v.type, '' AS description, v.filled FROM (SELECT COUNT(*) AS n, COUNT("Changed_By") AS by_n FROM aud) c,
LATERAL (SELECT UNNEST(['Result_ID', 'Table', 'Field', 'Old_Value', 'New_Value', 'Changed_By', 'Changed_On', 'Reason', 'Negative_Value_Corrected',
  'Date_Completed', 'Location', 'Analysis', 'Hours_After_Entry']) AS field,
  UNNEST(['Whole number', 'Text', 'Text', 'Whole number', 'Whole number', 'Text', 'Date/Time', 'Text', 'TRUE/FALSE', 'Date/Time', 'Text', 'Text', 'Decimal']) AS type,
  UNNEST([n, n, n, n, n, by_n, n, n, n, n, n, n, n]) AS filled) v
UNION ALL SELECT 'Users', UNNEST(['Username', 'Full_Name']), 'Text', '', (SELECT COUNT(*) FROM people)""")
def data_dictionary(spark, folder):
    model = _model(spark, folder)
    return op.data_dictionary({name: model[name] for name in ("Audit_Trail", "Users")})


def _described(table: str, source: str) -> str:
    """Fields, types and filled values of a relation; types are read off the relation itself."""
    return f"""SELECT '{table}' AS "table", f.field, CASE WHEN t.kind = 'BOOLEAN' THEN 'TRUE/FALSE' WHEN t.kind IN ('DATE', 'TIMESTAMP') THEN 'Date/Time'
  WHEN t.kind IN ('INTEGER', 'BIGINT') THEN 'Whole number' WHEN t.kind = 'DOUBLE' THEN 'Decimal' ELSE 'Text' END AS type,
  COALESCE((SELECT d.text FROM described d WHERE d.field = f.field AND '{table}' = 'Results'), '') AS description, f.filled
FROM (UNPIVOT (SELECT COUNT(COLUMNS('(.*)')) AS "\\1" FROM {source}) ON COLUMNS(*) INTO NAME field VALUE filled) f
JOIN (UNPIVOT (SELECT TYPEOF(ANY_VALUE(COLUMNS('(.*)'))) AS "\\1" FROM {source}) ON COLUMNS(*) INTO NAME field VALUE kind) t ON t.field = f.field"""


_TEXTS = ", ".join("('{}', '{}')".format(k, v.replace("'", "''")) for k, v in op.DESCRIPTIONS.items())
_SPEC_FIELDS = """specs_out AS (
  SELECT CAST(ASCII(name) * 100 + action AS BIGINT) AS "Spec_ID", CASE WHEN name IN ('BIOBURDEN_USP61', 'LAL_KINETIC') THEN 'P0' ELSE 'N/A (EM)' END AS "Product",
         CASE action WHEN 5 THEN 'Grade A (ISO 5)' ELSE 'N/A' END AS "Grade", CASE action WHEN 5 THEN 'CR-100' ELSE 'N/A' END AS "Location", code AS "Analysis_Code",
         'ACTION' AS "Limit_Type", CAST(0 AS DOUBLE) AS "Min_Value", action AS "Max_Value", code AS "Analysis", code <> 'WATER_BIOBURDEN' AS "In_Use" FROM specs
)"""
_PEOPLE_FIELDS = """users_out AS (SELECT u AS "Username", n AS "Full_Name" FROM people)"""
_ALL_TABLES = (("Results", "res"), ("Lots", "lots"), ("Investigations", "inv"), ("Audit_Trail", "aud"), ("Specs", "specs_out"), ("Instruments", "ins"), ("Users", "users_out"))


def _after(sql: str, base: str) -> str:
    """What a chain of relations adds to the one it starts with."""
    return sql.removeprefix(base)


_ALL = RES + "".join(_after(x, RES) for x in (LOTS, INV, AUDIT, INSTR)) + _after(SPECS, EV) + f""",
{_SPEC_FIELDS},
{_PEOPLE_FIELDS},
described(field, text) AS (VALUES {_TEXTS})"""


@query("L22_data_dictionary_all", f"WITH {_ALL} " + " UNION ALL ".join(_described(t, c) for t, c in _ALL_TABLES))
def data_dictionary_all(spark, folder):
    return op.data_dictionary(op.laboratory_model(_raw(spark, folder), keep=durable))


_DIM = " UNION ".join(f"""SELECT '{d}' AS dim, "{d}" AS value FROM res""" for d in op.DIMS)


@query("L23_dimension_values", f"""WITH {RES}, d AS ({_DIM})
SELECT dim, value, ROW_NUMBER() OVER (PARTITION BY dim ORDER BY value) - 1 AS index FROM d WHERE value IS NOT NULL""")
def dimension_values(spark, folder):
    return op.dimension_values(_results(spark, folder))


_IDX = ", ".join(f"""(SELECT index FROM x WHERE dim = '{d}' AND value = r."{d}") AS "{d}_index" """ for d in op.DIMS)
_BITS = " + ".join(f"""CAST("{f}" AS INT) * {1 << i}""" for i, f in enumerate(op.FLAGS))


@query("L23_dictionary_encode", f"""WITH {RES}, d AS ({_DIM}),
x AS (SELECT dim, value, ROW_NUMBER() OVER (PARTITION BY dim ORDER BY value) - 1 AS index FROM d WHERE value IS NOT NULL)
SELECT "Result_ID" AS id, {even("DATE_DIFF('second', (SELECT DATE_TRUNC('day', MIN(Login_Date)) FROM res), Login_Date) / 86400", 2)} AS day, {_IDX},
       "Result" AS result, "Alert_Limit" AS alert, "Action_Limit" AS action,
       {big(_BITS + ' + CASE WHEN "Audit_Corrections" > 0 THEN 128 ELSE 0 END')} AS flags, "TAT_Days" AS tat
FROM res r""")
def dictionary_encode(spark, folder):
    results = durable(_results(spark, folder).select("Result_ID", "Login_Date", "Result", "Alert_Limit", "Action_Limit", "TAT_Days", "Audit_Corrections", *op.DIMS, *op.FLAGS))
    return op.dictionary_encode(results, op.dimension_values(results))


@query("L24_group_first", f"""WITH {RES} SELECT "Analysis", MIN("Units") AS "Units", COUNT(DISTINCT "Units") AS n_values FROM res GROUP BY 1""")
def group_first(spark, folder):
    return op.group_first(_results(spark, folder), "Analysis", "Units")


@query("L24_grade_of_location", f"""WITH {RES}
SELECT "Location", MIN("Cleanroom_Grade") AS "Cleanroom_Grade", COUNT(DISTINCT "Cleanroom_Grade") AS n_values FROM res GROUP BY 1""")
def grade_of_location(spark, folder):
    return op.group_first(_results(spark, folder), "Location", "Cleanroom_Grade")


def _profile_sql(column: str) -> str:
    return f"""SELECT '{column}' AS "column", COUNT(*) AS rows, COUNT(*) - COUNT({column}) AS nulls, COUNT(DISTINCT {column}) AS "distinct",
COUNT(*) FILTER (WHERE CAST({column} AS VARCHAR) <> TRIM(CAST({column} AS VARCHAR))) AS padded, CAST(MIN({column}) AS VARCHAR) AS low,
CAST(MAX({column}) AS VARCHAR) AS high, COUNT(DISTINCT {column}) = 1 AS one_value FROM t"""


_PROFILED = ("event_id", "event_type", "user_id", "props", "pad", "gap", "k", "day")


@query("L25_column_profile", f"""WITH t AS (SELECT event_id, event_type, user_id, props, CASE WHEN event_id % 4 = 0 THEN ' x' ELSE event_type END AS pad,
CASE WHEN event_id % 5 <> 0 THEN user_id END AS gap, 'same' AS k, CAST(ts AS DATE) AS day FROM events)
{' UNION ALL '.join(_profile_sql(c) for c in _PROFILED)}""")
def column_profile(spark, folder):
    events = src.star(spark, folder, "events").select(
        "event_id", "event_type", "user_id", "props",
        F.when(F.col("event_id") % 4 == 0, " x").otherwise(F.col("event_type")).alias("pad"),
        F.when(F.col("event_id") % 5 != 0, F.col("user_id")).alias("gap"), F.lit("same").alias("k"), F.to_date("ts").alias("day"))
    return op.column_profile(events)


@query("L25_date_order", f"""WITH {RES}
SELECT 'Login_Date' AS earlier, 'Date_Completed' AS later, COUNT(*) AS compared, COUNT(*) FILTER (WHERE "Date_Completed" < "Login_Date") AS reversed FROM res
UNION ALL SELECT 'Date_Completed', 'Due_Date', COUNT(*), COUNT(*) FILTER (WHERE "Due_Date" < "Date_Completed") FROM res""")
def date_order(spark, folder):
    return op.date_order(_results(spark, folder), [("Login_Date", "Date_Completed"), ("Date_Completed", "Due_Date")])


@query("L26_dead_columns", """WITH n AS (SELECT COUNT(*) AS n FROM events)
SELECT 'STATUS' AS "column", 'constant' AS reason, CAST(NULL AS VARCHAR) AS other FROM n WHERE n > 0
UNION ALL SELECT 'RETEST_OF', 'empty', NULL UNION ALL SELECT 'TEXT_ID', 'copy', 'event_id' UNION ALL SELECT 'LOGIN_BY', 'copy', 'user_id'""")
def dead_columns(spark, folder):
    events = src.star(spark, folder, "events").select(
        "event_id", "ts", "user_id", "event_type", "value", F.lit("A").alias("STATUS"), F.lit(None).cast("string").alias("RETEST_OF"),
        F.col("event_id").alias("TEXT_ID"), F.col("user_id").alias("LOGIN_BY"))
    return op.dead_columns(events)


@query("L27_monthly_excursions", f"""WITH {RES} SELECT "Login_Month", COUNT(*) AS results, COUNT(*) FILTER (WHERE "Is_OOS") AS oos,
COUNT(*) FILTER (WHERE "Is_Alert") AS alerts FROM res GROUP BY 1""")
def monthly_excursions(spark, folder):
    return op.monthly_excursions(_results(spark, folder))


@query("L28_tat_by_type", f"""WITH {RES} SELECT "Sample_Type", COUNT(*) AS results, {rnd('MEDIAN("TAT_Days")', 4)} AS median_tat,
{rnd(davg('"TAT_Days"'), 4)} AS mean_tat, {rnd(drate('"TAT_Breach_4d_SLA"'), 6)} AS breach_rate, CAST(4 AS DOUBLE) AS sla FROM res GROUP BY 1""")
def tat_by_type(spark, folder):
    return op.tat_by_type(_results(spark, folder))


@query("L29_inv_capa_by_month", f"""WITH {INV} SELECT CAST(DATE_TRUNC('month', "Opened") AS DATE) AS month, COUNT(*) AS investigations,
COUNT(*) FILTER (WHERE "CAPA_Raised") AS capas, {rnd(drate('"CAPA_Raised"'), 6)} AS capa_rate FROM inv GROUP BY 1""")
def inv_capa_by_month(spark, folder):
    return op.inv_capa_by_month(_model(spark, folder)["Investigations"])


@query("L30_results_by_type", f"""WITH {RES} SELECT "Sample_Type", COUNT(*) AS results FROM res GROUP BY 1""")
def results_by_type(spark, folder):
    return op.results_by_type(_results(spark, folder))


@query("L30_excursions_by_grade", f"""WITH {RES} SELECT "Cleanroom_Grade", COUNT(*) FILTER (WHERE "Is_OOS") AS oos,
COUNT(*) FILTER (WHERE "Is_Alert") AS alerts FROM res GROUP BY 1""")
def excursions_by_grade(spark, folder):
    return op.excursions_by_grade(_results(spark, folder))


@query("L30_on_time_rate", f"""WITH {RES} SELECT COUNT(*) AS results, {rnd(drate('NOT "Past_Due_Date"'), 6)} AS on_time_rate FROM res""")
def on_time_rate(spark, folder):
    return op.on_time_rate(_results(spark, folder))


@query("L31_self_review_by_analyst", f"""WITH {RES} SELECT "Analyst", COUNT(*) AS results, COUNT(*) FILTER (WHERE "Self_Reviewed") AS self_reviewed,
{rnd(drate('"Self_Reviewed"'), 6)} AS self_review_rate FROM res GROUP BY 1""")
def self_review_by_analyst(spark, folder):
    return op.self_review_by_analyst(_results(spark, folder))


@query("L32_corrections_over_time", f"""WITH {AUDIT} SELECT CAST(DATE_TRUNC('month', "Changed_On") AS DATE) AS month, COUNT(*) AS corrections,
COUNT(*) FILTER (WHERE "Negative_Value_Corrected") AS negative FROM aud GROUP BY 1""")
def corrections_over_time(spark, folder):
    return op.corrections_over_time(_model(spark, folder)["Audit_Trail"])


@query("L33_tat_distribution", f"""WITH {RES}, s AS (SELECT MIN("TAT_Days") AS b0, (MAX("TAT_Days") - MIN("TAT_Days")) / 14 AS w FROM res),
b AS (SELECT LEAST(13, FLOOR(("TAT_Days" - b0) / w)) AS bin FROM res, s)
SELECT {big('g.bin')} AS bin, b0 + w * (g.bin + CAST(0.5 AS DOUBLE)) AS mid, (SELECT COUNT(*) FROM b WHERE b.bin = g.bin) AS n
FROM s, (SELECT UNNEST(RANGE(14)) AS bin) g""")
def tat_distribution(spark, folder):
    return op.tat_distribution(_results(spark, folder))


@query("L34_late_definitions", f"""WITH {RES} SELECT "TAT_Breach_4d_SLA", "Past_Due_Date", COUNT(*) AS results FROM res GROUP BY 1, 2""")
def late_definitions(spark, folder):
    return op.late_definitions(_results(spark, folder))


@query("L35_negative_corrections", f"WITH {EV} SELECT COUNT(*) AS corrections, COUNT(*) FILTER (WHERE old_value < 0) AS negative FROM audit")
def negative_corrections(spark, folder):
    return op.negative_corrections(_raw(spark, folder)["AUDIT_TRAIL"])
