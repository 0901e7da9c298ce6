"""Whole report jobs: build the shared tables once, derive every report table, write them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import deviations as dev
from ..operators import laboratory as lab
from ..operators import monitoring as mon
from ..operators import retention as ret
from ..operators import spc
from ..sources import sinks

# The exported retention tables, in export order.
RETENTION_EXPORTS = ("kpis", "monthly", "cohort", "late_vs_review", "late_by_state", "late_by_route",
                     "repeat_by_first", "repeat_by_category", "return_gap", "rfm", "categories")
RETENTION_ORDER = {
    "monthly": ["month"], "cohort": ["cohort_month", "month_offset"], "late_vs_review": ["bucket_order"],
    "late_by_state": ["-late_rate", "state"], "late_by_route": ["route"], "repeat_by_first": ["level_order", "level"],
    "repeat_by_category": ["-repeat_rate", "category"], "return_gap": ["bucket_order"],
    "rfm": ["array_position(array({}), segment)".format(", ".join(f"'{s}'" for s in ret.SEGMENTS))],
    "categories": ["-gmv", "category"], "tests": ["factor"],
}


def retention_report(
    tables: dict[str, DataFrame], params: ret.RetentionParams, store: str, item_ties: tuple[str, ...] = ("order_item_id",)
) -> dict[str, DataFrame]:
    """Every retention table. Delivered orders are written once under ``store`` and read back by each of them."""
    sales = sinks.materialize(ret.build_model(tables, params, item_ties), f"{store}/delivered")
    by_first, by_category = ret.repeat_by_first(sales, params), ret.repeat_by_category(sales, params)
    return {
        "kpis": ret.kpis(sales, params), "monthly": ret.monthly(sales, params), "cohort": ret.cohort(sales, params),
        "late_vs_review": ret.late_vs_review(sales), "late_by_state": ret.late_by_state(sales),
        "late_by_route": ret.late_by_route(sales), "repeat_by_first": by_first, "repeat_by_category": by_category,
        "return_gap": ret.return_gap(sales, params), "rfm": ret.rfm(ret.rfm_customers(sales, params)),
        "categories": ret.categories(sales, params),
        "tests": ret.bonferroni(ret.significance(by_first, by_category)),
    }


def write_retention_report(report: dict[str, DataFrame], path: str) -> None:
    """One CSV folder per export and one JSON document with all tables."""
    for name in RETENTION_EXPORTS:
        sinks.write_csv(report[name], f"{path}/{name}")
    sinks.json_document(report, RETENTION_ORDER, single=("kpis",)).select("line").write.mode("overwrite").text(f"{path}/dashboard")


def laboratory_report(raw: dict[str, DataFrame], store: str) -> dict[str, DataFrame]:
    """Clean tables plus summary, dictionary and cleaning log; the fact table is written once."""
    model = lab.laboratory_model(raw, keep=lambda df: sinks.materialize(df, f"{store}/results"))
    extra = {
        "Summary": lab.quality_summary(model), "Data_Dictionary": lab.data_dictionary(model),
        "Cleaning_Log": lab.cleaning_log(raw, model),
    }
    return {**model, **extra}


def write_laboratory_report(report: dict[str, DataFrame], path: str) -> None:
    """Every table as parquet, and the compact encoded form of the results."""
    for name, df in report.items():
        df.write.mode("overwrite").parquet(f"{path}/{name}")
    sinks.write_compact(lab.compact_tables(report["Results"], report["Investigations"], report["Audit_Trail"], report["Cleaning_Log"]), f"{path}/compact")


def deviation_report(
    devs: DataFrame, areas: DataFrame, causes: DataFrame, params: dev.DeviationParams, first_month: str | None = None
) -> dict[str, DataFrame]:
    """Register, key figures, grid, area and month tables, Pareto and repeating pairs."""
    return {
        "register": dev.register(devs, params), "kpis": dev.dev_kpis(devs, params), "aging": dev.aging_grid(devs, params),
        "areas": dev.area_summary(devs, areas, params), "trend": dev.closeout_trend(devs, params, first_month),
        "pareto": dev.root_cause_pareto(devs, causes), "pairs": dev.repeat_pairs(devs, params),
    }


def spc_report(
    measures: DataFrame, parameters: DataFrame, causes: DataFrame, store: str, basis: str = "base",
    rules: tuple[int, ...] = spc.RULES,
) -> dict[str, DataFrame]:
    """Limits, flags, capability, signal log and histogram; subgroup figures are written once."""
    stats = sinks.materialize(spc.subgroup_stats(measures), f"{store}/subgroups")
    limits = spc.control_limits(stats, parameters, basis)
    flagged = spc.nelson(stats, limits, rules)
    return {
        "limits": limits, "flagged": flagged, "summary": spc.ooc_summary(flagged),
        "capability": spc.capability(stats, parameters).withColumn("class", spc.cpk_class(F.col("cpk"))),
        "signals": spc.signal_log(flagged, causes), "histogram": spc.histogram(measures, "param", "value"),
        "out_of_spec": spc.out_of_spec(measures, parameters),
    }


def monitoring_report(classified: DataFrame) -> dict[str, DataFrame]:
    """Summary, trend, Pareto, worst results, runs and missing actions."""
    return {
        "summary": mon.em_summary(classified), "trend": mon.em_trend(classified), "pareto": mon.em_pareto(classified),
        "worst": mon.worst_by_month(classified), "runs": mon.consecutive_runs(classified),
        "missing_capa": mon.capa_on_action(classified), "rate": mon.excursion_rate(classified),
    }
