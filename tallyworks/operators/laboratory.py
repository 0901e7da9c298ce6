"""Laboratory result cleaning, integrity checks and summaries."""

from __future__ import annotations

from collections.abc import Callable, Mapping
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.dates import elapsed_days, elapsed_hours, elapsed_seconds, month_start, to_minute
from ..functions.numeric import count_where, exact_mean, pack_bits, rate, rounded, rounded_even
from ..functions.ordering import number_rows
from ..session import durable
from .spc import histogram

SLA_DAYS = 4

# Code labels and the labels that stand for explained blanks.
ANALYSIS = {
    "SETTLE_PLATE_TSA": "Settle Plate (TSA)", "VIABLE_AIR_USP": "Active Air Sample", "BIOBURDEN_USP61": "Bioburden",
    "LAL_KINETIC": "Endotoxin (Kinetic LAL)", "WATER_BIOBURDEN": "Water Bioburden",
}
SAMPLE_TYPE = {
    "EM_SURFACE": "EM - Surface", "EM_AIR": "EM - Air", "BIOBURDEN": "Product - Bioburden",
    "ENDOTOXIN": "Product - Endotoxin",
}
GRADE = {"A": "Grade A (ISO 5)", "B": "Grade B (ISO 5/7)", "C": "Grade C (ISO 7)", "D": "Grade D (ISO 8)"}
NO_GRADE = "N/A (QC Lab)"
NO_POINT = "N/A (Product Sample)"
NO_PRODUCT = "N/A (EM Sample)"
NO_INSTRUMENT = "Not Recorded"
NO_REVIEWER = "MISSING"
NO_DISPOSITION = "NOT RELEASED"
UNUSED_ANALYSIS = "WATER_BIOBURDEN"
FLAGS = ("Is_OOS", "Is_Alert", "Is_OOT", "TAT_Breach_4d_SLA", "Past_Due_Date", "Self_Reviewed", "Missing_Reviewer")
DIMS = ("Location", "Sample_Type", "Sampling_Point", "Analysis", "Analyst")
TIME_COLUMNS = {
    "SAMPLE": ("LOGIN_DATE", "CHANGED_ON", "DUE_DATE", "DATE_RECEIVED", "DATE_COMPLETED", "DATE_REVIEWED"),
    "RESULT": ("ENTERED_ON", "REVIEWED_ON"), "TEST": ("DATE_STARTED",), "LOT": ("MFG_DATE", "RELEASED_ON"),
    "INVESTIGATION": ("OPENED", "CLOSED"), "AUDIT_TRAIL": ("CHANGED_ON",),
}
DESCRIPTIONS = {
    "Result_ID": "Number of the result, unique", "Sample_ID": "Number of the sample", "Test_ID": "Number of the test",
    "Login_Date": "Time the sample was registered", "Login_Month": "First day of the month of registration",
    "Due_Date": "Time the sample is due", "Date_Completed": "Time the test was finished", "Date_Reviewed": "Time of the review",
    "Sample_Category": "Monitoring of rooms, or release of products", "Sample_Type": "Kind of sample as a label",
    "Analysis": "Name of the test", "Analysis_Code": "Code of the test in the source", "Location": "Room or laboratory",
    "Cleanroom_Grade": "Grade of the room with its ISO class", "Sampling_Point": "Place inside the room",
    "Product": "Product of a release sample", "Lot": "Lot of a release sample", "Instrument": "Instrument, where one is recorded",
    "Result": "Measured value; only values of one analysis have a common unit", "Units": "Unit of the value",
    "Alert_Limit": "Value from which a result is an alert", "Action_Limit": "Value from which a result is out of specification",
    "Pct_of_Action_Limit": "Result divided by the action limit", "Result_Status": "OOS / Action, Alert or Within Limits",
    "Is_OOS": "The action limit is reached", "Is_Alert": "The alert limit is reached, the action limit is not",
    "Is_OOT": "Trend flag of the source", "Is_Zero_Count": "Nothing was counted", "TAT_Days": "Days from login to completion",
    "TAT_Breach_4d_SLA": "Turnaround above the service level", "Past_Due_Date": "Completed after the due date",
    "Analyst": "Person who entered the result", "Result_Reviewer": "Person who reviewed the result, MISSING without one",
    "Sample_Reviewer": "Person who reviewed the sample", "Missing_Reviewer": "No reviewer recorded",
    "Self_Reviewed": "Entered and reviewed by the same person", "Reviewer_Conflict": "The sample's reviewer is not the result's",
    "Audit_Corrections": "Number of audit trail changes", "Original_Entry_Before_Correction": "Value before the first change",
    "Investigation_ID": "Investigation of the result", "CAPA_ID": "Corrective action of the investigation",
    "Investigation_Days": "Days from opening to closing the investigation",
}
# Result columns that the log and the summary count, and those the tables they count are built from.
COUNTED = ("Result_ID", "Sample_ID", "Login_Date", "Date_Completed", "Location", "Cleanroom_Grade", "Analysis", "Result", "Action_Limit",
           "Units", "Lot", "Instrument", "TAT_Days", "Reviewer_Conflict", *FLAGS)


# ----------------------------------------------------------------- cleaning


def dedupe_exact(df: DataFrame) -> DataFrame:
    """Exact duplicate rows kept once."""
    return df.dropDuplicates()


def duplicates_removed(df: DataFrame) -> DataFrame:
    """Rows before and after exact deduplication."""
    copies = df.groupBy(*df.columns).agg(F.count(F.lit(1)).alias("_n"))
    return copies.agg(F.coalesce(F.sum("_n"), F.lit(0)).alias("rows_before"), F.count(F.lit(1)).alias("rows_after")).withColumn(
        "removed", F.col("rows_before") - F.col("rows_after"))


def key_violations(df: DataFrame, key: list[str]) -> DataFrame:
    """Keys that occur more than once."""
    return df.groupBy(*key).agg(F.count(F.lit(1)).alias("rows")).filter(F.col("rows") > 1)


def round_to_minute(df: DataFrame, columns: tuple[str, ...]) -> DataFrame:
    """Date-time columns on the nearest minute; text that cannot be read becomes null."""
    kinds = dict(df.dtypes)
    return df.withColumns({c: to_minute(F.col(c), text=kinds[c] == "string") for c in columns})


def labels(mapping: Mapping[str, str], code: Column) -> Column:
    """Label of a code by a fixed dictionary, null when unknown."""
    pairs = [F.lit(x) for pair in mapping.items() for x in pair]
    return F.try_element_at(F.create_map(*pairs), code)


def decode(df: DataFrame, column: str, dim: DataFrame, key: str, label: str, into: str) -> DataFrame:
    """Adds ``into``, the label of ``column`` in a dimension table, null when unknown."""
    names = dim.select(F.col(key).alias("_key"), F.col(label).alias(into))
    return df.join(names, df[column] == names["_key"], "left").drop("_key")


def structural_nulls(df: DataFrame, fill: Mapping[str, str]) -> DataFrame:
    """Explained blanks get their label."""
    return df.withColumns({c: F.coalesce(F.col(c), F.lit(text)) for c, text in fill.items()})


def structural_null_counts(df: DataFrame, fill: Mapping[str, str]) -> DataFrame:
    """(column, label, replaced) of the blanks that ``structural_nulls`` fills."""
    row = df.agg(*[count_where(F.col(c).isNull()).alias(c) for c in fill])
    entries = F.array(*[
        F.struct(F.lit(c).alias("column"), F.lit(text).alias("label"), F.col(c).alias("replaced")) for c, text in fill.items()
    ])
    return row.select(F.explode(entries).alias("e")).select("e.*")


def clean_tables(tables: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """Deduplicated tables with their date-times on the minute."""
    out = dict(tables)
    for name in ("RESULT", "flagged_results"):
        out[name] = dedupe_exact(out[name])
    for name, columns in TIME_COLUMNS.items():
        out[name] = round_to_minute(out[name], columns)
    out["INSTRUMENTS"] = out["INSTRUMENTS"].withColumn("CALIB_DUE", F.to_date("CALIB_DUE"))
    return out


# ------------------------------------------------------------ result rules


def limit_status(result: Column, alert: Column, action: Column) -> dict[str, Column]:
    """Status text and flags; a missing result is within limits."""
    out = F.coalesce(result >= action, F.lit(False))
    warned = F.coalesce(result >= alert, F.lit(False))
    return {
        "Result_Status": F.when(out, "OOS / Action").when(warned, "Alert").otherwise("Within Limits"),
        "Is_OOS": out, "Is_Alert": warned & F.coalesce(result < action, F.lit(False)),
        "Is_Zero_Count": F.coalesce(result == 0, F.lit(False)),
    }


def pct_of_action(result: Column, action: Column) -> Column:
    return rounded_even(F.try_divide(result, action), 3)


def turnaround(login: Column, completed: Column, due: Column, sla: float = SLA_DAYS) -> dict[str, Column]:
    """Days (2 dp), breach of the service level by the unrounded days, and lateness against the due date."""
    days = elapsed_days(login, completed)
    return {
        "TAT_Days": rounded_even(days, 2), "TAT_Breach_4d_SLA": F.coalesce(days > sla, F.lit(False)),
        "Past_Due_Date": F.coalesce(completed > due, F.lit(False)),
    }


def reviewer_integrity(entered: Column, reviewed: Column, sample_reviewer: Column) -> dict[str, Column]:
    """Missing reviewer, self review, and a result reviewer that the sample reviewer, or its absence, does not match."""
    return {
        "Missing_Reviewer": reviewed.isNull(), "Self_Reviewed": F.coalesce(entered == reviewed, F.lit(False)),
        "Reviewer_Conflict": reviewed.isNotNull() & ~reviewed.eqNullSafe(sample_reviewer),
    }


def audit_rollup(audit: DataFrame) -> DataFrame:
    """Corrections per record and the value before the first one."""
    return audit.groupBy("RECORD_KEY").agg(
        F.count(F.lit(1)).alias("Audit_Corrections"),
        F.min(F.when(F.col("OLD_VALUE").isNotNull(), F.struct("CHANGED_ON", "OLD_VALUE")))["OLD_VALUE"].alias("Original_Entry"),
    )


def oot_flag_dim(flags: DataFrame) -> DataFrame:
    return flags.select("SAMPLE_NUMBER", "Flag_OOT").distinct()


def result_fact(t: dict[str, DataFrame], sla: float = SLA_DAYS) -> DataFrame:
    """One row per sample with its test, result, trend flag, investigation and audit history.

    Joins that share a key stand next to each other, so each side is exchanged once per key.
    """
    investigations = t["INVESTIGATION"].select(
        F.col("RESULT_NUMBER").alias("_r"), "INV_ID", "CAPA_ID",
        rounded_even(elapsed_days(F.col("OPENED"), F.col("CLOSED")), 1).alias("Investigation_Days"))
    history = audit_rollup(t["AUDIT_TRAIL"]).withColumnRenamed("RECORD_KEY", "_r")
    joined = (
        t["SAMPLE"]
        .join(t["TEST"].select("TEST_NUMBER", "SAMPLE_NUMBER", "INSTRUMENT", "DATE_STARTED"), "SAMPLE_NUMBER", "left")
        .join(oot_flag_dim(t["flagged_results"]), "SAMPLE_NUMBER", "left")
        .join(t["RESULT"], "TEST_NUMBER", "left")
        .withColumn("_r", F.col("RESULT_NUMBER"))
        .join(investigations, "_r", "left").join(history, "_r", "left")
    )
    users = t["LIMS_USERS"]
    for column, into in (("ENTERED_BY", "Analyst"), ("REVIEWED_BY", "_reviewer"), ("REVIEWER", "Sample_Reviewer")):
        joined = decode(joined, column, users, "USER_NAME", "FULL_NAME", into)
    value, alert, action = F.col("NUMERIC_ENTRY"), F.col("ALERT_LIMIT"), F.col("MAX_LIMIT")
    status = limit_status(value, alert, action)
    timing = turnaround(F.col("LOGIN_DATE"), F.col("DATE_COMPLETED"), F.col("DUE_DATE"), sla)
    review = reviewer_integrity(F.col("ENTERED_BY"), F.col("REVIEWED_BY"), F.col("REVIEWER"))
    category = F.when(F.col("SAMPLE_TYPE").startswith("EM"), "Environmental Monitoring").otherwise("Product Release")
    columns = {
        "Result_ID": F.col("RESULT_NUMBER"), "Sample_ID": F.col("SAMPLE_NUMBER"), "Test_ID": F.col("TEST_NUMBER"),
        "Login_Date": F.col("LOGIN_DATE"), "Login_Month": month_start(F.col("LOGIN_DATE")), "Due_Date": F.col("DUE_DATE"),
        "Date_Completed": F.col("DATE_COMPLETED"), "Date_Reviewed": F.col("DATE_REVIEWED"), "Sample_Category": category,
        "Sample_Type": labels(SAMPLE_TYPE, F.col("SAMPLE_TYPE")), "Analysis": labels(ANALYSIS, F.col("NAME")),
        "Analysis_Code": F.col("NAME"), "Location": F.col("LOCATION"),
        "Cleanroom_Grade": F.coalesce(labels(GRADE, F.col("PRODUCT_GRADE")), F.lit(NO_GRADE)),
        "Sampling_Point": F.coalesce(F.initcap(F.replace("SAMPLING_POINT", F.lit("_"), F.lit(" "))), F.lit(NO_POINT)),
        "Product": F.coalesce("PRODUCT", F.lit(NO_PRODUCT)), "Lot": F.coalesce("LOT", F.lit(NO_PRODUCT)),
        "Instrument": F.coalesce("INSTRUMENT", F.lit(NO_INSTRUMENT)),
        "Result": value, "Units": F.col("UNITS"), "Alert_Limit": alert, "Action_Limit": action,
        "Pct_of_Action_Limit": pct_of_action(value, action), **status,
        "Is_OOT": F.coalesce("Flag_OOT", F.lit(False)), **timing,
        "Result_Reviewer": F.coalesce("_reviewer", F.lit(NO_REVIEWER)), "Analyst": F.col("Analyst"),
        "Sample_Reviewer": F.col("Sample_Reviewer"), **review,
        "Audit_Corrections": F.coalesce("Audit_Corrections", F.lit(0)),
        "Original_Entry_Before_Correction": F.col("Original_Entry"),
        "Investigation_ID": F.col("INV_ID"), "CAPA_ID": F.col("CAPA_ID"), "Investigation_Days": F.col("Investigation_Days"),
    }
    return joined.select(*[c.alias(n) for n, c in columns.items()])


def join_checks(t: dict[str, DataFrame], fact: DataFrame) -> DataFrame:
    """(check, expected, actual, ok) for the one-to-one joins and the row count of the fact table."""
    samples = t["SAMPLE"].agg(F.count(F.lit(1)).alias("n"))
    rows = fact.agg(F.count(F.lit(1)).alias("n"))
    checks = [("fact rows equal sample rows", samples.scalar(), rows)]
    for name, key in (("TEST", "TEST_NUMBER"), ("RESULT", "RESULT_NUMBER"), ("RESULT", "TEST_NUMBER")):
        repeats = key_violations(t[name], [key]).agg(F.count(F.lit(1)).alias("n"))
        checks.append((f"repeated {key} in {name}", F.lit(0).cast("bigint"), repeats))
    oot = key_violations(oot_flag_dim(t["flagged_results"]), ["SAMPLE_NUMBER"]).agg(F.count(F.lit(1)).alias("n"))
    checks.append(("repeated SAMPLE_NUMBER in trend flags", F.lit(0).cast("bigint"), oot))
    parts = [
        df.select(F.lit(name).alias("check"), expected.alias("expected"), F.col("n").alias("actual"))
        for name, expected, df in checks
    ]
    return reduce(DataFrame.unionByName, parts).withColumn("ok", F.col("expected") == F.col("actual"))


def flag_reconcile(results: DataFrame, flags: DataFrame) -> DataFrame:
    """(flag, mismatches, rows): rebuilt flags against the source flags on every row."""
    pairs = {"Is_OOS": "Flag_OOS", "Is_Alert": "Flag_Alert", "TAT_Breach_4d_SLA": "Flag_TAT_Breach"}
    joined = results.select("Sample_ID", *pairs).join(
        flags.select(F.col("SAMPLE_NUMBER").alias("Sample_ID"), *pairs.values()), "Sample_ID", "left")
    row = joined.agg(F.count(F.lit(1)).alias("rows"), *[
        count_where(~F.col(ours).eqNullSafe(F.col(theirs))).alias(ours) for ours, theirs in pairs.items()])
    entries = F.array(*[F.struct(F.lit(f).alias("flag"), F.col(f).alias("mismatches")) for f in pairs])
    return row.select("rows", F.explode(entries).alias("e")).select("e.*", "rows")


# ------------------------------------------------------- supporting tables


def lots_enriched(lots: DataFrame, results: DataFrame) -> DataFrame:
    """Lots with tests, OOS results, release times and disposition."""
    per_lot = results.filter(F.col("Lot").startswith("L")).groupBy("Lot").agg(
        F.count(F.lit(1)).alias("Samples_Tested"), count_where(F.col("Is_OOS")).alias("OOS_Results"),
        F.max("Login_Date").alias("Last_Sample_Login"))
    named = lots.select(
        F.col("LOT_NUMBER").alias("Lot"), F.col("PRODUCT").alias("Product"), F.col("MFG_DATE").alias("Mfg_Date"),
        F.col("RELEASED_ON").alias("Released_On"), F.coalesce("DISPOSITION", F.lit(NO_DISPOSITION)).alias("Disposition"))
    return named.join(per_lot, "Lot", "left").select(
        *named.columns, rounded_even(elapsed_days(F.col("Mfg_Date"), F.col("Released_On")), 1).alias("Mfg_to_Release_Days"),
        F.coalesce("Samples_Tested", F.lit(0)).alias("Samples_Tested"), F.coalesce("OOS_Results", F.lit(0)).alias("OOS_Results"),
        "Last_Sample_Login",
        rounded_even(elapsed_days(F.col("Last_Sample_Login"), F.col("Released_On")), 1).alias("Last_Sample_to_Release_Days"))


def untested_lots(lots: DataFrame, results: DataFrame) -> DataFrame:
    return lots.select(F.col("LOT_NUMBER").alias("Lot")).join(results.select("Lot").distinct(), "Lot", "left_anti")


def investigations_enriched(investigations: DataFrame, results: DataFrame) -> DataFrame:
    """Investigations with the context of their result."""
    context = results.select(
        "Result_ID", "Login_Date", "Location", "Cleanroom_Grade", "Analysis", "Result", "Action_Limit", "Units")
    return investigations.withColumnRenamed("RESULT_NUMBER", "Result_ID").join(context, "Result_ID", "left").select(
        F.col("INV_ID").alias("Investigation_ID"), "Result_ID", F.col("PHASE").alias("Phase"), F.col("OPENED").alias("Opened"),
        F.col("CLOSED").alias("Closed"), rounded_even(elapsed_days(F.col("OPENED"), F.col("CLOSED")), 1).alias("Investigation_Days"),
        F.col("CAPA_ID").isNotNull().alias("CAPA_Raised"), F.coalesce("CAPA_ID", F.lit("None")).alias("CAPA_ID"),
        "Login_Date", "Location", "Cleanroom_Grade", "Analysis", "Result", "Action_Limit", "Units")


def audit_enriched(audit: DataFrame, users: DataFrame, results: DataFrame) -> DataFrame:
    """Audit rows with names, result context and the delay after entry."""
    context = results.select("Result_ID", "Date_Completed", "Location", "Analysis")
    named = decode(audit, "CHANGED_BY", users, "USER_NAME", "FULL_NAME", "Changed_By_Name")
    return named.withColumnRenamed("RECORD_KEY", "Result_ID").join(context, "Result_ID", "left").select(
        "Result_ID", F.col("TABLE_NAME").alias("Table"), F.col("FIELD").alias("Field"), F.col("OLD_VALUE").alias("Old_Value"),
        F.col("NEW_VALUE").alias("New_Value"), F.col("Changed_By_Name").alias("Changed_By"),
        F.col("CHANGED_ON").alias("Changed_On"), F.col("REASON").alias("Reason"),
        F.coalesce(F.col("OLD_VALUE") < 0, F.lit(False)).alias("Negative_Value_Corrected"), "Date_Completed", "Location", "Analysis",
        rounded_even(elapsed_hours(F.col("Date_Completed"), F.col("CHANGED_ON")), 1).alias("Hours_After_Entry"))


def specs_clean(specs: DataFrame) -> DataFrame:
    """Specifications with the mislabelled location column renamed and codes decoded."""
    return specs.select(
        F.col("SPEC_ID").alias("Spec_ID"), F.coalesce("PRODUCT", F.lit("N/A (EM)")).alias("Product"),
        F.coalesce(labels(GRADE, F.col("PRODUCT_GRADE")), F.lit("N/A")).alias("Grade"),
        F.coalesce("SAMPLING_POINT", F.lit("N/A")).alias("Location"), F.col("ANALYSIS").alias("Analysis_Code"),
        F.col("SPEC_TYPE").alias("Limit_Type"), F.col("MIN_VALUE").alias("Min_Value"), F.col("MAX_VALUE").alias("Max_Value"),
        labels(ANALYSIS, F.col("ANALYSIS")).alias("Analysis"),
        (~F.coalesce(F.col("ANALYSIS") == UNUSED_ANALYSIS, F.lit(False))).alias("In_Use"))


def instrument_usage(instruments: DataFrame, results: DataFrame) -> DataFrame:
    """Results per instrument, unused instruments included."""
    used = results.groupBy("Instrument").agg(F.count(F.lit(1)).alias("_n"))
    return instruments.select(
        F.col("NAME").alias("Instrument"), F.col("TYPE").alias("Type"), F.col("CALIB_DUE").alias("Calibration_Due")
    ).join(used, "Instrument", "left").withColumn("Results_Recorded", F.coalesce("_n", F.lit(0))).drop("_n")


def users_clean(users: DataFrame) -> DataFrame:
    return users.select(F.col("USER_NAME").alias("Username"), F.col("FULL_NAME").alias("Full_Name"))


def laboratory_model(
    raw: dict[str, DataFrame], sla: float = SLA_DAYS, keep: Callable[[DataFrame], DataFrame] | None = None
) -> dict[str, DataFrame]:
    """The seven clean tables; ``keep`` may store the fact table before the others read it."""
    t = clean_tables(raw)
    results = result_fact(t, sla)
    results = keep(results) if keep else results
    return {
        "Results": results, "Lots": lots_enriched(t["LOT"], results),
        "Investigations": investigations_enriched(t["INVESTIGATION"], results),
        "Audit_Trail": audit_enriched(t["AUDIT_TRAIL"], t["LIMS_USERS"], results), "Specs": specs_clean(t["PRODUCT_SPEC"]),
        "Instruments": instrument_usage(t["INSTRUMENTS"], results), "Users": users_clean(t["LIMS_USERS"]),
    }


# -------------------------------------------------------- log and summaries


def cleaning_log(raw: dict[str, DataFrame], model: dict[str, DataFrame], left_out: int = 0) -> DataFrame:
    """(step, category, table, action, rows_affected) of every cleaning step, counted in one aggregate per table.

    ``left_out`` is the number of tables of the source that hold no source data.
    """
    one = F.count(F.lit(1))
    blank = lambda c: count_where(F.col(c).isNull())
    sample = raw["SAMPLE"].agg((one * len(TIME_COLUMNS["SAMPLE"])).alias("a"), (blank("PRODUCT") + blank("SAMPLING_POINT")).alias("b"))
    test = raw["TEST"].agg(one.alias("a"), blank("INSTRUMENT").alias("b"))
    inv = raw["INVESTIGATION"].agg(one.alias("a"))
    results = model["Results"].agg(
        one.alias("a"), count_where(F.col("Missing_Reviewer")).alias("b"), count_where(F.col("Self_Reviewed")).alias("c"),
        count_where(F.col("Reviewer_Conflict")).alias("d"), count_where(F.col("Past_Due_Date")).alias("e"))
    audit = raw["AUDIT_TRAIL"].agg(count_where(F.col("OLD_VALUE") < 0).alias("a"))
    lots = raw["LOT"].agg(blank("DISPOSITION").alias("a"))
    untested = model["Lots"].agg(count_where(F.col("Samples_Tested") == 0).alias("a"))
    specs = raw["PRODUCT_SPEC"].agg(F.count("SAMPLING_POINT").alias("a"), count_where(F.col("ANALYSIS") == UNUSED_ANALYSIS).alias("b"))
    idle = model["Instruments"].agg(count_where(F.col("Results_Recorded") == 0).alias("a"))
    scope = raw["RESULT"].sparkSession.range(1).select(F.lit(left_out).alias("a"))
    duplicates = duplicates_removed(raw["RESULT"]).select(F.col("removed").alias("a"))
    # Blanks of the fact table sit in two source tables, so their counts are added.
    blanks = sample.select("b").withColumn("t", test.select("b").scalar()).select((F.col("b") + F.col("t")).alias("a"))
    dropped = test.select("a").withColumn("i", inv.scalar()).select((F.col("a") + F.col("i")).alias("a"))
    steps: list[tuple[str, str, str, DataFrame, str]] = [
        ("Scope", "Model", "Left out tables without source data", scope, "a"),
        ("Duplicates", "RESULT", "Removed exact duplicate rows", duplicates, "a"),
        ("Formatting", "All", "Rounded timestamps to the minute", sample, "a"),
        ("Modeling", "Results", "Joined the source tables into one row per result", results, "a"),
        ("Dropped columns", "SAMPLE / TEST / RESULT", "Removed constant and copied columns", results, "a"),
        ("Dropped columns", "TEST / INVESTIGATION", "Removed empty columns", dropped, "a"),
        ("Decoding", "Results", "Replaced codes with labels", results, "a"),
        ("Nulls", "Results", "Labelled structural blanks", blanks, "a"),
        ("Derived fields", "Results", "Added analysis fields", results, "a"),
        ("Flagged - not changed", "Results", "No result reviewer", results, "b"),
        ("Flagged - not changed", "Results", "Reviewed by the analyst who entered the result", results, "c"),
        ("Flagged - not changed", "Results", "Sample and result reviewer differ", results, "d"),
        ("Flagged - not changed", "Results", "Completed after the due date", results, "e"),
        ("Flagged - not changed", "Audit_Trail", "Corrected a negative value", audit, "a"),
        ("Nulls", "Lots", "Labelled blank dispositions", lots, "a"),
        ("Flagged - not changed", "Lots", "No test samples", untested, "a"),
        ("Renaming", "Specs", "Renamed the column that holds locations", specs, "a"),
        ("Flagged - not changed", "Specs", "Specification not in use", specs, "b"),
        ("Flagged - not changed", "Instruments", "No results linked", idle, "a"),
    ]
    # Group the steps by counted frame, so a frame with several counts is read once.
    frames: dict[int, tuple[DataFrame, list]] = {}
    for step, (category, table, action, frame, column) in enumerate(steps, 1):
        frames.setdefault(id(frame), (frame, []))[1].append(F.struct(
            F.lit(step).alias("step"), F.lit(category).alias("category"), F.lit(table).alias("table"),
            F.lit(action).alias("action"), F.col(column).cast("bigint").alias("rows_affected")))
    parts = [frame.select(F.explode(F.array(*rows)).alias("e")).select("e.*") for frame, rows in frames.values()]
    return reduce(DataFrame.unionByName, parts).orderBy("step")


def quality_summary(model: dict[str, DataFrame]) -> DataFrame:
    """(metric, value, share) headline list; four one-row aggregates read as scalars."""
    res = model["Results"].agg(
        F.count(F.lit(1)).alias("n"), F.count_distinct("Sample_ID").alias("samples"),
        *[count_where(F.col(c)).alias(c) for c in FLAGS],
        count_where(~(F.col("Is_OOS") | F.col("Is_Alert") | F.col("Is_OOT"))).alias("right"),
        F.median("TAT_Days").alias("tat"))
    inv = model["Investigations"].agg(F.struct(F.count(F.lit(1)).alias("n"), count_where(F.col("CAPA_Raised")).alias("capa"))).scalar()
    lots = model["Lots"].agg(F.struct(F.count(F.lit(1)).alias("n"), count_where(F.col("Disposition") == "RELEASED").alias("out"))).scalar()
    audit = model["Audit_Trail"].agg(F.struct(
        F.count(F.lit(1)).alias("n"), count_where(F.col("Negative_Value_Corrected")).alias("negative"))).scalar()
    row = res.withColumns({"i": inv, "l": lots, "a": audit})
    n = F.col("n")
    metrics: list[tuple[str, Column, Column | None]] = [
        ("Results (clean)", n, None), ("Samples", F.col("samples"), None), ("OOS results", F.col("Is_OOS"), n),
        ("Alert results", F.col("Is_Alert"), n), ("OOT results", F.col("Is_OOT"), n), ("Right-first-time", F.col("right"), n),
        ("Median TAT (days)", F.col("tat"), None), ("TAT breach", F.col("TAT_Breach_4d_SLA"), n),
        ("Past due date", F.col("Past_Due_Date"), n), ("Investigations", F.col("i.n"), None),
        ("Investigations with CAPA", F.col("i.capa"), F.col("i.n")), ("Lots released", F.col("l.out"), F.col("l.n")),
        ("Self-reviewed results", F.col("Self_Reviewed"), n), ("Audit-trail corrections", F.col("a.n"), None),
        ("Negative values corrected", F.col("a.negative"), F.col("a.n")),
    ]
    entries = F.array(*[
        F.struct(F.lit(name).alias("metric"), rounded(value, 2).alias("value"),
                 (rounded(F.try_divide(value.cast("double"), base.cast("double")), 6) if base is not None
                  else F.lit(None).cast("double")).alias("share"))
        for name, value, base in metrics
    ])
    return row.select(F.explode(entries).alias("e")).select("e.*")


def type_class(kind: T.DataType) -> str:
    """Reader-facing type of a column."""
    if isinstance(kind, T.BooleanType):
        return "TRUE/FALSE"
    if isinstance(kind, (T.DateType, T.TimestampType, T.TimestampNTZType)):
        return "Date/Time"
    if isinstance(kind, T.IntegralType):
        return "Whole number"
    if isinstance(kind, (T.FractionalType, T.DecimalType)):
        return "Decimal"
    return "Text"


def data_dictionary(model: dict[str, DataFrame], descriptions: Mapping[str, str] = DESCRIPTIONS) -> DataFrame:
    """(table, field, type, description, filled) for every column, with its number of non-null values."""
    parts = []
    for name, df in model.items():
        row = df.agg(*[F.count(f"`{c}`").alias(c) for c in df.columns])
        entries = F.array(*[
            F.struct(F.lit(name).alias("table"), F.lit(f.name).alias("field"), F.lit(type_class(f.dataType)).alias("type"),
                     F.lit(descriptions.get(f.name, "") if name == "Results" else "").alias("description"),
                     F.col(f.name).alias("filled")) for f in df.schema.fields])
        parts.append(row.select(F.explode(entries).alias("e")).select("e.*"))
    return reduce(DataFrame.unionByName, parts)


# ------------------------------------------------------- encoding, profiling


# Value lists of at most this many rows are numbered by one window and sent to every task; longer ones are cut into
# slices and joined.
LIST_ROWS = 100_000


def dimension_values(results: DataFrame, dims: tuple[str, ...] = DIMS) -> DataFrame:
    """(dim, value, index): position of every distinct value in its sorted list, from 0.

    The distinct values are stored and counted first: short lists need no range sort.
    """
    pairs = F.array(*[F.struct(F.lit(d).alias("dim"), F.col(d).cast("string").alias("value")) for d in dims])
    distinct = durable(results.select(F.explode(pairs).alias("e")).select("e.*").filter(F.col("value").isNotNull()).distinct())
    if distinct.count() <= LIST_ROWS:
        numbered = distinct.withColumn("_n", F.row_number().over(Window.partitionBy("dim").orderBy("value")).cast("bigint"))
    else:
        numbered = number_rows(distinct, ["dim"], [F.col("value")], "_n", stored=True)
    return numbered.select("dim", "value", (F.col("_n") - 1).alias("index"))


def _looked_up(rows: DataFrame, values: DataFrame, dims: tuple[str, ...], by: str, into: str) -> DataFrame:
    """rows with, per dimension, the other side of its value list; short lists are sent to every task, in one pass."""
    short = values.count() <= LIST_ROWS
    for d in dims:
        side = values.filter(F.col("dim") == d).select(F.col(by).alias(d if by == "value" else f"{d}_index"), F.col(into).alias(f"{d}_index" if by == "value" else d))
        rows = rows.join(F.broadcast(side) if short else side, d if by == "value" else f"{d}_index", "left")
    return rows


def start_day(results: DataFrame) -> DataFrame:
    """One row with the day of the first login."""
    return results.agg(F.to_date(F.min("Login_Date")).alias("start"))


def dictionary_encode(results: DataFrame, values: DataFrame, dims: tuple[str, ...] = DIMS) -> DataFrame:
    """Compact rows: value indexes, day offset from the first login day (2 dp) and eight flags in one number."""
    start = start_day(results).scalar().cast("timestamp_ntz")
    out = results.withColumn("day", rounded_even(elapsed_seconds(start, F.col("Login_Date")) / 86400, 2)).withColumn(
        "flags", pack_bits([*[F.col(c) for c in FLAGS], F.col("Audit_Corrections") > 0]))
    return _looked_up(out, values, dims, "value", "index").select(
        F.col("Result_ID").alias("id"), "day", *[f"{d}_index" for d in dims], F.col("Result").alias("result"),
        F.col("Alert_Limit").alias("alert"), F.col("Action_Limit").alias("action"), "flags", F.col("TAT_Days").alias("tat"))


# What the compact form and its decoder read of the fact table.
COMPACT = ("Result_ID", "Login_Date", "Result", "Alert_Limit", "Action_Limit", "TAT_Days", "Audit_Corrections", "Units", "Cleanroom_Grade", *DIMS, *FLAGS)


def compact_tables(
    results: DataFrame, investigations: DataFrame | None = None, audit: DataFrame | None = None, log: DataFrame | None = None
) -> dict[str, DataFrame]:
    """The compact export: encoded rows, value lists, start day, units, grades and the side tables that are given.

    ``results`` is read five times and should be a stored table.
    """
    dims = dimension_values(results)
    out = {
        "rows": dictionary_encode(results, dims), "dims": dims, "start": start_day(results),
        "units": group_first(results, "Analysis", "Units").select("Analysis", "Units"),
        "grades": group_first(results, "Location", "Cleanroom_Grade").select("Location", "Cleanroom_Grade"),
    }
    if investigations is not None:
        out["investigations"] = investigations.select("Investigation_ID", "Result_ID", "Opened", "Investigation_Days", F.nullif("CAPA_ID", F.lit("None")).alias("CAPA_ID"))
    if audit is not None:
        out["audit"] = audit.select("Result_ID", "Old_Value", "New_Value", "Changed_By", "Changed_On")
    if log is not None:
        out["log"] = log.select("category", "action", "rows_affected")
    return out


def dictionary_decode(t: dict[str, DataFrame], dims: tuple[str, ...] = DIMS) -> DataFrame:
    """The fact columns that a compact export holds, from its tables as read back.

    Indexes become values, the day offset a time (to a hundredth of a day), bits become flags; units and grades come
    from the lists of analyses and locations.
    """
    start = t["start"].select(F.col("start").cast("timestamp_ntz")).scalar()
    rows = _looked_up(t["rows"], t["dims"], dims, "index", "value")
    bit = lambda i: F.getbit("flags", F.lit(i)) == 1
    login = F.timestamp_add("SECOND", F.rint(F.col("day") * 86400).cast("bigint"), start)
    named = rows.join(t["units"], "Analysis", "left").join(t["grades"], "Location", "left")
    return named.select(
        F.col("id").alias("Result_ID"), login.alias("Login_Date"), *dims, F.col("result").alias("Result"),
        F.col("alert").alias("Alert_Limit"), F.col("action").alias("Action_Limit"), F.col("tat").alias("TAT_Days"),
        *[bit(i).alias(f) for i, f in enumerate(FLAGS)], bit(len(FLAGS)).alias("Corrected"), "Units", "Cleanroom_Grade")


def group_first(df: DataFrame, key: str, value: str) -> DataFrame:
    """Smallest non-null value of each key, and how many different ones there are (one is expected)."""
    return df.groupBy(key).agg(F.min(value).alias(value), F.count_distinct(value).alias("n_values"))


# Whole numbers within fewer buckets of this many values than a column has rows per ROWS_PER_BUCKET are counted in bitmaps,
# where there are rows enough for one more pass over a column to pay.
BUCKET_VALUES, ROWS_PER_BUCKET, BITMAP_ROWS = 1 << 15, 64, 1_000_000


def _counting_number(kind: T.DataType, column: Column) -> Column | None:
    """A column of whole numbers, days or booleans as a long; None for other types."""
    if isinstance(kind, T.IntegralType):
        return column.cast("bigint")
    if isinstance(kind, T.DateType):
        return F.unix_date(column).cast("bigint")
    return column.cast("int").cast("bigint") if isinstance(kind, T.BooleanType) else None


def _distinct_in_bitmaps(df: DataFrame, number: Column, low: int) -> DataFrame:
    """One row with the exact number of different values, from bitmaps that merge before the shuffle; one column is read."""
    place = number - F.lit(low)
    buckets = df.filter(number.isNotNull()).groupBy(F.bitmap_bucket_number(place).alias("_b")).agg(
        F.bitmap_count(F.bitmap_construct_agg(F.bitmap_bit_position(place))).alias("_n"))
    return buckets.agg(F.coalesce(F.sum("_n"), F.lit(0)).alias("distinct"))


def column_profile(df: DataFrame) -> DataFrame:
    """One row per column: rows, nulls, exact distinct values, values with outer blanks, range, whether one value only.

    Ranges are those of the column's type, numbers by size and dates by time, and are given as text. All but the
    distinct counts come from one aggregate that moves no values. Whole numbers, days and booleans that lie close enough
    are counted in bitmaps, of which a task sends one per bucket; the other columns on (column, value) pairs, which
    combine before the shuffle, so that a value that fills a third of a column costs one row per task. df is evaluated
    once for the aggregate, once per column of bitmaps, reading that column only, and once for the pairs.
    """
    name = lambda c: F.col(f"`{c}`")
    text = lambda c: name(c).cast("string")
    fields = df.schema.fields
    numbers = {i: n for i, f in enumerate(fields) if (n := _counting_number(f.dataType, name(f.name))) is not None}
    entry = [F.struct(
        F.lit(f.name).alias("column"), F.count(F.lit(1)).alias("rows"), count_where(name(f.name).isNull()).alias("nulls"),
        count_where(text(f.name) != F.trim(text(f.name))).alias("padded"), F.min(name(f.name)).cast("string").alias("low"),
        F.max(name(f.name)).cast("string").alias("high"),
        F.coalesce(F.min(name(f.name)) == F.max(name(f.name)), F.lit(False)).alias("one_value"),
        *[(f(numbers[i]) if i in numbers else F.lit(None).cast("bigint")).alias(a) for f, a in ((F.min, "first"), (F.max, "last"))],
    ).alias(f"c{i}") for i, f in enumerate(fields)]
    facts = list(df.agg(*entry).first()) if fields else []
    many = bool(facts) and facts[0].rows >= BITMAP_ROWS
    near = {i for i in numbers if many and facts[i].first is not None and (facts[i].last - facts[i].first) // BUCKET_VALUES <= facts[i].rows // ROWS_PER_BUCKET}
    rest = [i for i in range(len(fields)) if i not in near]
    parts = [_distinct_in_bitmaps(df, numbers[i], facts[i].first).select(F.lit(i).alias("i"), "distinct") for i in sorted(near)]
    if rest:
        pairs = F.array(*[F.struct(F.lit(i).alias("i"), text(fields[i].name).alias("value")) for i in rest])
        parts.append(df.select(F.explode(pairs).alias("e")).select("e.*").filter("value is not null").distinct().groupBy("i").agg(F.count(F.lit(1)).alias("distinct")))
    known = "i int, `column` string, `rows` bigint, nulls bigint, padded bigint, low string, high string, one_value boolean"
    wide = df.sparkSession.createDataFrame([(i, *x[:7]) for i, x in enumerate(facts)], known)
    counts = reduce(DataFrame.unionByName, parts) if parts else wide.select("i", F.lit(0).cast("bigint").alias("distinct")).limit(0)
    return wide.join(counts, "i", "left").withColumn("distinct", F.coalesce("distinct", F.lit(0))).drop("i")


def date_order(df: DataFrame, pairs: list[tuple[str, str]]) -> DataFrame:
    """(earlier, later, compared, reversed): rows in which a time that should come later comes first."""
    entry = [F.struct(
        F.lit(a).alias("earlier"), F.lit(b).alias("later"), count_where(F.col(a).isNotNull() & F.col(b).isNotNull()).alias("compared"),
        count_where(F.col(b) < F.col(a)).alias("reversed")).alias(f"p{i}") for i, (a, b) in enumerate(pairs)]
    return df.agg(*entry).select(F.explode(F.array(*[F.col(f"p{i}") for i in range(len(pairs))])).alias("e")).select("e.*")


# Bits of a row's hash that are added up, so that a sum holds 2^39 rows.
SUM_BITS = 24


def _column_facts(df: DataFrame) -> list:
    """Per column (filled, flat, sum, xor); the last two are its fingerprint.

    Every cell is hashed together with its whole row, so equal columns have equal fingerprints in any order of the
    rows, and a plan for c columns has c entries.
    """
    name = lambda f: F.col(f"`{f.name}`")
    cell = lambda f: F.xxhash64("_row", F.coalesce(F.xxhash64(name(f)), F.lit(0)), name(f).isNull())
    whole = df.select("*", F.xxhash64(*[name(f) for f in df.schema.fields]).alias("_row"))
    facts = [F.struct(
        F.count(name(f)).alias("filled"), F.min(name(f)).eqNullSafe(F.max(name(f))).alias("flat"),
        F.sum(cell(f).bitwiseAND(F.lit((1 << SUM_BITS) - 1))).alias("sum"), F.bit_xor(cell(f)).alias("xor")).alias(f"c{i}")
        for i, f in enumerate(df.schema.fields)]
    return list(whole.agg(F.count(F.lit(1)).alias("n"), *facts).first())


def dead_columns(df: DataFrame) -> DataFrame:
    """(column, reason, other): empty, constant, or an exact copy of an earlier column, of which the first is named.

    One aggregate finds columns of one type with equal fingerprints. Only these are compared cell by cell, each with
    the first of its group; those that differ from it (their fingerprints collide) are compared among themselves.
    """
    fields = df.schema.fields
    rows, *facts = _column_facts(df)
    found, groups = [], {}
    for f, s in zip(fields, facts):
        if s.filled == 0:
            found.append((f.name, "empty", None))
            continue
        if s.filled == rows and s.flat:
            found.append((f.name, "constant", None))
        groups.setdefault((f.dataType.json(), s.filled, s.sum, s.xor), []).append(f.name)
    open_ = [g for g in groups.values() if len(g) > 1]
    while open_:
        pairs = [(g[0], c) for g in open_ for c in g[1:]]
        same = df.agg(*[F.bool_and(F.col(f"`{a}`").eqNullSafe(F.col(f"`{b}`"))).alias(f"p{i}") for i, (a, b) in enumerate(pairs)]).first()
        found += [(b, "copy", a) for (a, b), equal in zip(pairs, same) if equal]
        other = {b for (_, b), equal in zip(pairs, same) if not equal}
        open_ = [left for g in open_ if len(left := [c for c in g if c in other]) > 1]
    return df.sparkSession.createDataFrame(found, "column string, reason string, other string")


# ------------------------------------------------------------ report tables


def monthly_excursions(results: DataFrame) -> DataFrame:
    return results.groupBy("Login_Month").agg(
        F.count(F.lit(1)).alias("results"), count_where(F.col("Is_OOS")).alias("oos"),
        count_where(F.col("Is_Alert")).alias("alerts")).orderBy("Login_Month")


def tat_by_type(results: DataFrame, sla: float = SLA_DAYS) -> DataFrame:
    """Turnaround by sample type against the service level."""
    return results.groupBy("Sample_Type").agg(
        F.count(F.lit(1)).alias("results"), rounded(F.median("TAT_Days"), 4).alias("median_tat"),
        rounded(exact_mean(F.col("TAT_Days")), 4).alias("mean_tat"),
        rounded(rate(F.col("TAT_Breach_4d_SLA")), 6).alias("breach_rate")).withColumn("sla", F.lit(float(sla)))


def inv_capa_by_month(investigations: DataFrame) -> DataFrame:
    return investigations.groupBy(month_start(F.col("Opened")).alias("month")).agg(
        F.count(F.lit(1)).alias("investigations"), count_where(F.col("CAPA_Raised")).alias("capas"),
        rounded(rate(F.col("CAPA_Raised")), 6).alias("capa_rate")).orderBy("month")


def results_by_type(results: DataFrame) -> DataFrame:
    return results.groupBy("Sample_Type").agg(F.count(F.lit(1)).alias("results"))


def excursions_by_grade(results: DataFrame) -> DataFrame:
    return results.groupBy("Cleanroom_Grade").agg(
        count_where(F.col("Is_OOS")).alias("oos"), count_where(F.col("Is_Alert")).alias("alerts"))


def on_time_rate(results: DataFrame) -> DataFrame:
    return results.agg(F.count(F.lit(1)).alias("results"), rounded(rate(~F.col("Past_Due_Date")), 6).alias("on_time_rate"))


def self_review_by_analyst(results: DataFrame) -> DataFrame:
    return results.groupBy("Analyst").agg(
        F.count(F.lit(1)).alias("results"), count_where(F.col("Self_Reviewed")).alias("self_reviewed"),
        rounded(rate(F.col("Self_Reviewed")), 6).alias("self_review_rate"))


def corrections_over_time(audit: DataFrame) -> DataFrame:
    return audit.groupBy(month_start(F.col("Changed_On")).alias("month")).agg(
        F.count(F.lit(1)).alias("corrections"), count_where(F.col("Negative_Value_Corrected")).alias("negative")).orderBy("month")


def tat_distribution(results: DataFrame, bins: int = 14) -> DataFrame:
    """Histogram of turnaround days."""
    return histogram(results.select(F.lit("all").alias("scope"), "TAT_Days"), "scope", "TAT_Days", bins).drop("scope")


def late_definitions(results: DataFrame) -> DataFrame:
    """The two definitions of late against each other."""
    return results.groupBy("TAT_Breach_4d_SLA", "Past_Due_Date").agg(F.count(F.lit(1)).alias("results"))


def negative_corrections(audit: DataFrame) -> DataFrame:
    return audit.agg(F.count(F.lit(1)).alias("corrections"), count_where(F.col("OLD_VALUE") < 0).alias("negative"))
