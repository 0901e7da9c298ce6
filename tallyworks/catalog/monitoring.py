"""Monitoring queries E1..E10, Q2 and Q3."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import monitoring as op
from ..sources import projection as src
from .registry import dsum, drate, query, rnd

EVENTS = f"""readings AS (
  SELECT 'R' || LPAD(CAST(l_suppkey % 17 AS VARCHAR), 2, '0') AS room, l_returnflag AS test, CAST(DATE_TRUNC('month', l_shipdate) AS DATE) AS month,
         l_quantity + CASE (YEAR(l_shipdate) * 12 + MONTH(l_shipdate) + l_suppkey % 17) % 9 WHEN 0 THEN 22 WHEN 1 THEN -12 WHEN 2 THEN -18 ELSE 0 END AS reading
  FROM lineitem
),
em0 AS (
  SELECT room, test, month, {dsum('reading')} / COUNT(*) AS value, COUNT(*) AS n_samples
  FROM readings GROUP BY 1, 2, 3
)"""
CLASSIFIED = EVENTS + """,
em1 AS (
  SELECT *, CAST(CASE WHEN test = 'N' THEN 15 ELSE 27 END AS DOUBLE) AS alert, CAST(CASE WHEN test = 'N' THEN 8 ELSE 45 END AS DOUBLE) AS action,
         CASE WHEN test = 'N' THEN 'low' ELSE 'high' END AS direction FROM em0
),
em AS (
  SELECT *, CASE WHEN test = 'N' THEN CASE WHEN value < 8 THEN 'Action' WHEN value < 15 THEN 'Alert' ELSE 'Pass' END
                 ELSE CASE WHEN value >= 45 THEN 'Action' WHEN value >= 27 THEN 'Alert' ELSE 'Pass' END END AS level FROM em1
)"""
CONTEXT = CLASSIFIED + """,
ctx0 AS (SELECT *, YEAR(month) * 12 + MONTH(month) + CAST(SUBSTR(room, 2, 2) AS INT) AS i FROM em),
ctx1 AS (SELECT *, level = 'Action' AND i % 23 <> 0 AS has_capa FROM ctx0),
ctx AS (
  SELECT room, test, month, value, n_samples, alert, action, direction, level, 'Suite ' || (CAST(SUBSTR(room, 2, 2) AS INT) % 4) AS suite,
         CASE WHEN has_capa THEN 'CAPA-' || room || '-' || test || '-' || STRFTIME(month, '%Y%m') END AS capa,
         CASE WHEN has_capa THEN CASE WHEN i % 3 = 0 THEN 'Open' ELSE 'Closed' END END AS capa_status,
         CASE WHEN has_capa AND i % 3 <> 0 THEN 10 + i % 50 END AS days_to_close,
         CASE WHEN level <> 'Pass' AND i % 29 <> 0 THEN 'Cause ' || (i % 13) END AS root_cause, 'Analyst ' || (i % 5) AS analyst, 'Reviewer ' || (i % 3) AS qa_reviewer
  FROM ctx1
)"""


def _events(spark, folder):
    return op.em_result(src.monitoring_samples(spark, folder))


def _classified(spark, folder):
    return op.em_classify(_events(spark, folder), src.monitoring_limits(spark, folder))


def _context(spark, folder):
    return src.monitoring_context(_classified(spark, folder))


@query("E1_em_result", f"WITH {EVENTS} SELECT * FROM em0")
def em_result(spark, folder):
    return _events(spark, folder)


@query("E2_em_classify", f"WITH {CLASSIFIED} SELECT * FROM em")
def em_classify(spark, folder):
    return _classified(spark, folder)


@query("E3_em_trend", f"""WITH {CLASSIFIED}
SELECT test, month, COUNT(*) AS events, {rnd(f"{dsum('value')} / COUNT(*)", 6)} AS mean_value, MAX(alert) AS alert, MAX(action) AS action,
       COUNT(*) FILTER (WHERE level = 'Action') AS actions FROM em GROUP BY 1, 2""")
def em_trend(spark, folder):
    return op.em_trend(_classified(spark, folder))


_RANK = "MAX(CASE level WHEN 'Action' THEN 2 WHEN 'Alert' THEN 1 ELSE 0 END)"


@query("E4_worst_by_month", f"""WITH {CLASSIFIED}
SELECT room, month, CASE {_RANK} WHEN 2 THEN 'Action' WHEN 1 THEN 'Alert' ELSE 'Pass' END AS worst FROM em GROUP BY 1, 2""")
def worst_by_month(spark, folder):
    return op.worst_by_month(_classified(spark, folder))


# One column per month of the rows, those without events too.
@query("E4_facility_matrix", f"""PIVOT (
  WITH {CLASSIFIED}, worst AS (SELECT room, month, {_RANK} AS w FROM em GROUP BY 1, 2),
  spine AS (SELECT UNNEST(RANGE(MIN(month), MAX(month) + INTERVAL 1 MONTH, INTERVAL 1 MONTH)) AS month FROM worst)
  SELECT r.room, STRFTIME(s.month, 'm%Y%m') AS name, CASE w WHEN 2 THEN 'Action' WHEN 1 THEN 'Alert' WHEN 0 THEN 'Pass' END AS level
  FROM (SELECT DISTINCT room FROM worst) r CROSS JOIN spine s LEFT JOIN worst w ON w.room = r.room AND w.month = s.month
) ON name USING MAX(level) GROUP BY room""")
def facility_matrix(spark, folder):
    return op.facility_matrix(_classified(spark, folder))


_PARETO = CONTEXT + """,
causes AS (SELECT COALESCE(root_cause, 'No cause recorded') AS root_cause, COUNT(*) AS count FROM ctx WHERE level <> 'Pass' GROUP BY 1),
running AS (SELECT *, SUM(count) OVER (ORDER BY count DESC, root_cause ROWS UNBOUNDED PRECEDING) AS upto, SUM(count) OVER () AS total FROM causes)"""


@query("E5_em_pareto", f"""WITH {_PARETO}
SELECT root_cause, count, {rnd('count / total', 6)} AS share, {rnd('upto / total', 6)} AS cum_share, upto - count < 0.8 * total AS in_cut FROM running""")
def em_pareto(spark, folder):
    return op.em_pareto(_context(spark, folder))


@query("E5_causes_to_cut", f"WITH {_PARETO} SELECT COUNT(*) AS causes, COUNT(*) FILTER (WHERE upto - count < 0.8 * total) AS causes_to_cut FROM running")
def causes_to_cut(spark, folder):
    return op.causes_to_cut(_context(spark, folder))


@query("E6_em_summary", f"""WITH {CONTEXT}
SELECT COUNT(DISTINCT room) AS rooms, COUNT(*) AS events, {rnd(drate("level = 'Pass'"), 6)} AS pass_rate,
       COUNT(*) FILTER (WHERE capa_status = 'Open') AS open_capas, {rnd('CAST(SUM(days_to_close) AS DOUBLE) / COUNT(days_to_close)', 4)} AS mean_days_to_close FROM ctx""")
def em_summary(spark, folder):
    return op.em_summary(_context(spark, folder))


@query("E7_audit_log", f"""WITH {CONTEXT}
SELECT room, suite, test, month, value, n_samples, alert, action, level, capa, capa_status, days_to_close, root_cause, analyst, qa_reviewer FROM ctx
WHERE suite IN ('Suite 1', 'Suite 2') AND level IN ('Alert', 'Action') AND month BETWEEN DATE '1997-01-01' AND DATE '1999-12-01'
  AND (root_cause ILIKE '%cause 1%' )""")
def audit_log(spark, folder):
    return op.audit_log(_context(spark, folder), {"suite": ["Suite 1", "Suite 2"], "level": ["Alert", "Action"]},
                        ("month", "1997-01-01", "1999-12-01"), "Cause 1")


@query("E8_consecutive_runs", f"""WITH {CLASSIFIED},
m AS (SELECT room, month, BOOL_OR(level = 'Action') AS act FROM em WHERE level <> 'Pass' GROUP BY 1, 2),
g AS (SELECT *, YEAR(month) * 12 + MONTH(month) - ROW_NUMBER() OVER (PARTITION BY room ORDER BY month) AS island FROM m)
SELECT room, MIN(month) AS first_month, MAX(month) AS last_month, COUNT(*) AS months, COUNT(*) FILTER (WHERE act) AS action_months
FROM g GROUP BY room, island HAVING COUNT(*) >= 2""")
def consecutive_runs(spark, folder):
    return op.consecutive_runs(_classified(spark, folder))


@query("E9_capa_on_action", f"WITH {CONTEXT} SELECT room, test, month, value FROM ctx WHERE level = 'Action' AND capa IS NULL")
def capa_on_action(spark, folder):
    return op.capa_on_action(_context(spark, folder))


@query("E10_excursion_rate", f"""WITH {CLASSIFIED}
SELECT COUNT(*) AS events, COUNT(*) FILTER (WHERE level <> 'Pass') AS excursions, COUNT(*) FILTER (WHERE level = 'Action') AS actions,
       {rnd(drate("level <> 'Pass'"), 6)} AS excursion_rate FROM em""")
def excursion_rate(spark, folder):
    return op.excursion_rate(_classified(spark, folder))


def _readings(spark, folder):
    lines = src.star(spark, folder, "lineitem")
    return lines.select(
        (F.col("l_suppkey") % 17).alias("room"), F.col("l_returnflag").alias("test"), F.to_date("l_shipdate").alias("day"),
        (F.col("l_quantity") >= 48).alias("excursion"))


READINGS = """r AS (SELECT l_suppkey % 17 AS room, l_returnflag AS test, CAST(l_shipdate AS DATE) AS day, l_quantity >= 48 AS excursion FROM lineitem)"""


@query("Q2_rolling_rate_ratio", f"""WITH {READINGS}, a AS (SELECT *, DATE '2001-06-30' - day AS age FROM r),
w AS (SELECT room, COUNT(*) FILTER (WHERE age BETWEEN 0 AND 29) AS recent_results, COUNT(*) FILTER (WHERE age BETWEEN 30 AND 119) AS baseline_results,
  COUNT(*) FILTER (WHERE age BETWEEN 0 AND 29 AND excursion) AS x, COUNT(*) FILTER (WHERE age BETWEEN 30 AND 119 AND excursion) AS y
  FROM a WHERE age BETWEEN 0 AND 119 GROUP BY 1)
SELECT room, recent_results, baseline_results, {rnd('x / NULLIF(recent_results, 0)', 6)} AS recent_rate, {rnd('y / NULLIF(baseline_results, 0)', 6)} AS baseline_rate,
       {rnd('(x / NULLIF(recent_results, 0)) / NULLIF(y / NULLIF(baseline_results, 0), 0)', 6)} AS ratio FROM w""")
def rolling_rate_ratio(spark, folder):
    return op.rolling_rate_ratio(_readings(spark, folder), "2001-06-30")


@query("Q3_repeat_excursions", f"""WITH {READINGS}, d AS (SELECT room, test, day, COUNT(*) AS excursions FROM r WHERE excursion GROUP BY 1, 2, 3),
g AS (SELECT *, LAG(day) OVER (PARTITION BY room, test ORDER BY day) AS previous_day FROM d)
SELECT *, day - previous_day AS gap_days FROM g WHERE day - previous_day <= 10""")
def repeat_excursions(spark, folder):
    return op.repeat_excursions(_readings(spark, folder), 10)
