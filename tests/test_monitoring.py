"""Limit edges, Pareto cut-off and runs of months."""

from datetime import date

from pyspark.sql import functions as F

from tallyworks.operators import monitoring as op


def test_levels(spark):
    rows = [("u", 26.9), ("u", 27.0), ("u", 45.0), ("dp", 0.030), ("dp", 0.0299), ("dp", 0.020), ("dp", 0.0199)]
    events = spark.createDataFrame(rows, "test string, value double")
    limits = spark.createDataFrame([("u", 45.0, 27.0, "high"), ("dp", 0.020, 0.030, "low")], "test string, action double, alert double, direction string")
    got = {(r.test, r.value): r.level for r in op.em_classify(events, limits).collect()}
    assert [got[r] for r in rows] == ["Pass", "Alert", "Action", "Pass", "Alert", "Alert", "Action"]


def test_cut_off_at_exactly_eighty_percent(spark):
    rows = [("a", "Alert")] * 5 + [("b", "Action")] * 3 + [("c", "Alert")] * 2 + [("c", "Pass")]
    df = spark.createDataFrame(rows, "root_cause string, level string")
    assert [(r.root_cause, r.in_cut) for r in op.em_pareto(df).orderBy(F.desc("count")).collect()] == [("a", True), ("b", True), ("c", False)]
    assert tuple(op.causes_to_cut(df).collect()[0]) == (3, 2)


def test_runs_break_on_gaps_and_cross_years(spark):
    months = [date(2025, 11, 1), date(2025, 12, 1), date(2026, 1, 1), date(2026, 3, 1), date(2026, 4, 1)]
    df = spark.createDataFrame([("R", m, "Action" if m.month == 12 else "Alert") for m in months], "room string, month date, level string")
    got = sorted((r.first_month, r.last_month, r.months, r.action_months) for r in op.consecutive_runs(df).collect())
    assert got == [(date(2025, 11, 1), date(2026, 1, 1), 3, 1), (date(2026, 3, 1), date(2026, 4, 1), 2, 0)]


def test_matrix_takes_its_months_from_the_rows(spark):
    rows = [("R1", date(1969, 11, 1), "Alert"), ("R1", date(1970, 2, 1), "Pass"), ("R2", date(1970, 2, 1), "Action"), ("R2", date(1970, 2, 1), "Alert")]
    df = spark.createDataFrame(rows, "room string, month date, level string")
    got = op.facility_matrix(df)
    assert got.columns == ["room", "m196911", "m196912", "m197001", "m197002"]
    assert sorted(map(tuple, got.collect()), key=str) == [("R1", "Alert", None, None, "Pass"), ("R2", None, None, None, "Action")]
    assert op.facility_matrix(df, "1970-01", "1970-02").columns == ["room", "m197001", "m197002"]
    assert op.facility_matrix(df.filter("false")).collect() == []
