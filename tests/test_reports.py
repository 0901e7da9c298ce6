"""Whole report jobs write every table, and the tables agree with each other."""

import json
from pathlib import Path

from pyspark.sql import functions as F

from tallyworks.catalog import retention as cat
from tallyworks.plans import reports
from tallyworks.session import scratch_path
from tallyworks.sources import projection as src
from tallyworks.sources import sinks

FOLDER = "/root/testdata/sf0.001"


def test_retention_report(spark):
    store = scratch_path(spark, "report")
    params = cat.op.RetentionParams(delivered_status="F", first_month="1996-01-01", last_month="2001-06-01", min_category_buyers=1)
    report = reports.retention_report(src.retention_tables(spark, FOLDER), params, store, cat.TIES)
    reports.write_retention_report(report, f"{store}/out")
    parts = sorted(Path(f"{store}/out/dashboard".removeprefix("file:")).glob("part-*"))
    doc = json.loads("".join(p.read_text() for p in parts))
    assert set(doc) == set(reports.RETENTION_EXPORTS) | {"tests"}
    kpis, monthly = doc["kpis"], doc["monthly"]
    assert kpis["orders"] == sum(m["orders"] for m in monthly) == sum(s["orders"] for s in doc["late_by_state"])
    assert kpis["buyers"] == sum(m["first_orders"] for m in monthly) == sum(s["buyers"] for s in doc["rfm"])
    returned = sum(s["buyers"] for s in doc["rfm"] if s["segment"].startswith("Repeat"))
    assert returned == sum(g["buyers"] for g in doc["return_gap"])
    assert monthly == sorted(monthly, key=lambda m: m["month"]) and len(monthly[0]["month"]) == 10
    back = spark.read.option("header", True).csv(f"{store}/out/cohort")
    assert back.count() == len(doc["cohort"])


def test_laboratory_report(spark):
    store = scratch_path(spark, "report")
    report = reports.laboratory_report(src.laboratory_tables(spark, FOLDER), store)
    reports.write_laboratory_report(report, f"{store}/out")
    rows = spark.read.json(f"{store}/out/compact/rows")
    assert rows.count() == report["Results"].count()
    bits = rows.agg(F.sum(F.col("flags").bitwiseAND(1))).collect()[0][0]
    assert bits == report["Results"].filter("Is_OOS").count()


def test_other_reports(spark):
    store = scratch_path(spark, "report")
    found = reports.spc_report(src.measures(spark, FOLDER), src.parameters(spark, FOLDER), src.cause_intervals(spark, FOLDER), store)
    assert found["summary"].count() == found["limits"].count() == 5
    devs = src.deviations(spark, FOLDER)
    areas, causes = devs.select("area").distinct(), devs.select("cause").distinct()
    out = reports.deviation_report(devs, areas, causes, reports.dev.DeviationParams(asof=src.DEVIATION_ASOF))
    assert out["areas"].agg(F.sum("total")).collect()[0][0] == devs.count()
    events = reports.mon.em_classify(reports.mon.em_result(src.monitoring_samples(spark, FOLDER)), src.monitoring_limits(spark, FOLDER))
    mon = reports.monitoring_report(src.monitoring_context(events))
    assert mon["rate"].collect()[0].events == events.count()


def test_document_of_many_rows(spark, tmp_path):
    n = 120_000
    big = spark.range(n).select((F.col("id") % 7).alias("k"), F.col("id").alias("v"))
    one, none = spark.range(1).select(F.lit("x").alias("a")), spark.range(0).select(F.lit("x").alias("a"))
    sinks.json_document({"big": big, "one": one, "none": none, "empty": none}, {"big": ["k", "-v"]}, single=("one", "none")).select("line").write.text(str(tmp_path / "d"))
    parts = sorted((tmp_path / "d").glob("part-*"))
    document = json.loads("".join(p.read_text() for p in parts))
    assert [(r["k"], r["v"]) for r in document["big"]] == sorted(((i % 7, i) for i in range(n)), key=lambda x: (x[0], -x[1]))
    assert document["one"] == {"a": "x"} and document["none"] is None and document["empty"] == []
