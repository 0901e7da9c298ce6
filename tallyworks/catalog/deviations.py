"""Deviation and CAPA queries D1..D23."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import deviations as op
from ..sources import projection as src
from .registry import big, query, rnd

P = op.DeviationParams(asof=src.DEVIATION_ASOF)
ASOF = f"DATE '{src.DEVIATION_ASOF}'"

DEVS = f"""devs0 AS (
  SELECT o_orderkey AS id, CAST(o_orderdate AS DATE) AS opened, c_mktsegment AS area, o_custkey AS asset,
         CASE o_orderstatus WHEN 'F' THEN 'Minor' WHEN 'O' THEN 'Major' ELSE 'Critical' END AS sev,
         o_orderpriority AS cause, 'Owner ' || (c_nationkey % 7) AS owner,
         CAST(o_orderdate AS DATE) + CAST(1 + o_orderkey % 120 AS INT) AS closed0
  FROM orders JOIN customer ON c_custkey = o_custkey
),
devs1 AS (
  SELECT id, opened, area, asset, sev, cause, owner, CASE WHEN closed0 <= {ASOF} THEN closed0 END AS closed,
         CASE WHEN sev <> 'Minor' THEN 'CAPA-' || id END AS capa FROM devs0
),
devs AS (
  SELECT *, CASE WHEN capa IS NOT NULL AND closed + CAST(20 + id % 70 AS INT) <= {ASOF}
                 THEN closed + CAST(20 + id % 70 AS INT) END AS capa_closed FROM devs1
)"""


def log_cte(target: int = 30, warn: int = 20, due: int = 90, win: int = 180, eff: int = 180) -> str:
    return DEVS + f""",
log0 AS (
  SELECT *, CASE WHEN closed IS NULL THEN 'Open' ELSE 'Closed' END AS status,
         CASE WHEN closed IS NULL THEN {ASOF} - opened ELSE closed - opened END AS days_open,
         CASE WHEN capa IS NOT NULL AND closed IS NOT NULL THEN closed + {due} END AS capa_due,
         EXISTS (SELECT 1 FROM devs e WHERE e.asset = d.asset AND e.cause = d.cause
                  AND e.opened >= d.opened - {win} AND e.opened < d.opened) AS repeat,
         (SELECT MIN(e.opened) FROM devs e WHERE e.asset = d.asset AND e.cause = d.cause
           AND e.opened > d.capa_closed AND e.opened <= d.capa_closed + {eff}) AS recurred_on
  FROM devs d
),
log AS (
  SELECT id, opened, area, asset, sev, cause, owner, closed, capa, capa_closed, status, days_open,
         status = 'Open' AND days_open > {target} AS overdue,
         status = 'Open' AND days_open > {warn} AND NOT days_open > {target} AS due_soon,
         CASE WHEN status = 'Open' THEN CASE WHEN days_open <= 30 THEN '0-30' WHEN days_open <= 60 THEN '31-60'
              WHEN days_open <= 90 THEN '61-90' ELSE '90+' END END AS aging_bucket,
         repeat, capa_due,
         CASE WHEN capa IS NULL THEN 'Not required' WHEN capa_closed IS NOT NULL THEN 'Closed'
              WHEN closed IS NULL THEN 'Awaiting dev. close' WHEN {ASOF} > capa_due THEN 'Overdue' ELSE 'Open' END AS capa_status,
         CASE WHEN capa_closed IS NULL THEN NULL WHEN recurred_on IS NOT NULL THEN 'Ineffective'
              WHEN {ASOF} - capa_closed >= {eff} THEN 'Effective' ELSE 'Check pending' END AS effectiveness,
         CAST(DATE_TRUNC('month', opened) AS DATE) AS opened_month, CAST(DATE_TRUNC('month', closed) AS DATE) AS closed_month,
         CASE WHEN {ASOF} - closed <= 90 THEN days_open END AS close_days_recent,
         CASE WHEN {ASOF} - closed > 90 AND {ASOF} - closed <= 270 THEN days_open END AS close_days_prior,
         recurred_on
  FROM log0
)"""


LOG = log_cte()


def _devs(spark, folder):
    return src.deviations(spark, folder)


def _row_formula(name, column, make):
    @query(name, f"WITH {LOG} SELECT id, {column} FROM log")
    def build(spark, folder):
        return _devs(spark, folder).select("id", make().alias(column))

    return build


_row_formula("D1_dev_status", "status", op.status)
_row_formula("D2_days_open", "days_open", lambda: op.days_open(P))
_row_formula("D4_aging_bucket", "aging_bucket", lambda: op.aging_bucket(P))
_row_formula("D6_capa_due", "capa_due", lambda: op.capa_due(P))
_row_formula("D7_capa_status", "capa_status", lambda: op.capa_status(P))


@query("D3_overdue_due_soon", f"WITH {LOG} SELECT id, overdue, due_soon FROM log")
def overdue(spark, folder):
    return _devs(spark, folder).select("id", op.overdue(P).alias("overdue"), op.due_soon(P).alias("due_soon"))


@query("D5_repeat_flag", f"WITH {LOG} SELECT id, repeat FROM log")
def repeat_flag(spark, folder):
    return op.with_repeat(_devs(spark, folder), P).select("id", "repeat")


@query("D8_capa_effectiveness", f"WITH {LOG} SELECT id, recurred_on, effectiveness FROM log")
def capa_effectiveness(spark, folder):
    return op.with_effectiveness(_devs(spark, folder), P).select("id", "recurred_on", "effectiveness")


@query("D9_period_close_days", f"WITH {LOG} SELECT id, close_days_recent, close_days_prior FROM log")
def period_close_days(spark, folder):
    return _devs(spark, folder).select(
        "id", op.close_days_recent(P).alias("close_days_recent"), op.close_days_prior(P).alias("close_days_prior"))


REGISTER_COLUMNS = """id, opened, area, asset, sev, cause, owner, closed, capa, capa_closed, status, days_open, overdue, due_soon,
aging_bucket, repeat, capa_due, capa_status, effectiveness, opened_month, closed_month, close_days_recent, close_days_prior"""


@query("D_register", f"WITH {LOG} SELECT {REGISTER_COLUMNS} FROM log")
def register(spark, folder):
    return op.register(_devs(spark, folder), P)


@query("D10_dev_kpis", f"""WITH {LOG}
SELECT COUNT(*) AS total, COUNT(*) FILTER (WHERE status = 'Open') AS open, COUNT(*) FILTER (WHERE overdue) AS overdue,
       COUNT(*) FILTER (WHERE sev = 'Critical' AND status = 'Open') AS critical_open,
       MEDIAN(close_days_recent) AS median_close_90d, MEDIAN(close_days_prior) AS median_close_prior,
       COUNT(*) FILTER (WHERE repeat) AS repeats, {rnd('COUNT(*) FILTER (WHERE repeat) / COUNT(*)', 6)} AS repeat_rate,
       COUNT(capa) AS capas_raised, COUNT(*) FILTER (WHERE capa_status = 'Overdue') AS capas_overdue,
       COUNT(*) FILTER (WHERE effectiveness IN ('Effective', 'Ineffective')) AS capas_judged,
       COUNT(*) FILTER (WHERE effectiveness = 'Ineffective') AS capas_ineffective,
       {rnd("COALESCE(COUNT(*) FILTER (WHERE effectiveness = 'Effective') / NULLIF(COUNT(*) FILTER (WHERE effectiveness IN ('Effective', 'Ineffective')), 0), 0)", 6)} AS effectiveness_rate
FROM log""")
def dev_kpis(spark, folder):
    return op.dev_kpis(_devs(spark, folder), P)


_CELLS = ", ".join(f"COUNT(*) FILTER (WHERE aging_bucket = '{b}') AS \"{b}\"" for b in ("0-30", "31-60", "61-90", "90+"))


@query("D11_aging_grid", f"""WITH {LOG}, rows(severity) AS (VALUES ('Critical'), ('Major'), ('Minor'), ('All'))
SELECT severity, {_CELLS}, COUNT(aging_bucket) AS "Total"
FROM rows LEFT JOIN log ON (severity = 'All' OR severity = sev) GROUP BY 1""")
def aging_grid(spark, folder):
    return op.aging_grid(_devs(spark, folder), P)


@query("D12_area_summary", f"""WITH {LOG}, areas AS (SELECT DISTINCT c_mktsegment AS area FROM customer UNION ALL SELECT DISTINCT r_name FROM region)
SELECT a.area, COUNT(id) AS total, COUNT(*) FILTER (WHERE status = 'Open') AS open, COUNT(*) FILTER (WHERE overdue) AS overdue,
       COUNT(*) FILTER (WHERE repeat) AS repeats, COUNT(*) FILTER (WHERE sev = 'Critical') AS critical
FROM areas a LEFT JOIN log USING (area) GROUP BY 1""")
def area_summary(spark, folder):
    areas = src.star(spark, folder, "customer").select(F.col("c_mktsegment").alias("area")).distinct().unionByName(
        src.star(spark, folder, "region").select(F.col("r_name").alias("area")))
    return op.area_summary(_devs(spark, folder), areas, P)


def trend_sql(first: str) -> str:
    return f"""WITH {LOG}, spine AS (
  SELECT CAST(m AS DATE) AS month FROM (SELECT UNNEST(GENERATE_SERIES({first}, DATE_TRUNC('month', {ASOF}), INTERVAL 1 MONTH)) AS m))
SELECT month, (SELECT COUNT(*) FROM log WHERE opened_month = month) AS opened,
       (SELECT COUNT(*) FROM log WHERE closed_month = month) AS closed,
       (SELECT MEDIAN(days_open) FROM log WHERE closed_month = month) AS median_days_to_close, {big(30)} AS target,
       (SELECT COUNT(*) FROM log WHERE opened <= LAST_DAY(month)) - (SELECT COUNT(*) FROM log WHERE closed <= LAST_DAY(month)) AS open_at_month_end
FROM spine"""


@query("D13_closeout_trend", trend_sql("TIMESTAMP '1996-01-01'"))
def closeout_trend(spark, folder):
    return op.closeout_trend(_devs(spark, folder), P, first_month="1996-01-01")


@query("D13_closeout_trend_all", trend_sql("(SELECT CAST(MIN(opened_month) AS TIMESTAMP) FROM log)"))
def closeout_trend_all(spark, folder):
    return op.closeout_trend(_devs(spark, folder), P)


@query("D14_root_cause_pareto", f"""WITH {LOG}, causes AS (SELECT DISTINCT o_orderpriority AS cause FROM orders UNION ALL SELECT r_name FROM region),
n AS (SELECT c.cause, COUNT(id) AS count FROM causes c LEFT JOIN log USING (cause) GROUP BY 1)
SELECT cause, count, {rnd('count / SUM(count) OVER ()', 6)} AS share,
       {rnd('SUM(count) OVER (ORDER BY count DESC, cause ROWS UNBOUNDED PRECEDING) / SUM(count) OVER ()', 6)} AS cum_share FROM n""")
def root_cause_pareto(spark, folder):
    causes = src.star(spark, folder, "orders").select(F.col("o_orderpriority").alias("cause")).distinct().unionByName(
        src.star(spark, folder, "region").select(F.col("r_name").alias("cause")))
    return op.root_cause_pareto(_devs(spark, folder), causes)


PAIRS = LOG + """,
gaps AS (SELECT area, asset, cause, opened - LAG(opened) OVER (PARTITION BY area, asset, cause ORDER BY opened) AS gap
         FROM (SELECT DISTINCT area, asset, cause, opened FROM log)),
keys AS (SELECT DISTINCT area, asset, cause FROM gaps WHERE gap <= 180),
pairs0 AS (
  SELECT k.area, k.asset, k.cause, COUNT(*) AS records, COUNT(*) FILTER (WHERE repeat) AS repeats,
         MIN(opened) AS first_opened, MAX(opened) AS last_opened, COUNT(capa) AS capas_raised,
         COUNT(*) FILTER (WHERE effectiveness = 'Ineffective') AS capas_ineffective,
         COUNT(*) FILTER (WHERE capa IS NOT NULL AND capa_status <> 'Closed') AS capas_open
  FROM keys k JOIN log l ON l.asset = k.asset AND l.cause = k.cause GROUP BY 1, 2, 3
),
pairs AS (
  SELECT *, CASE WHEN capas_ineffective > 0 THEN 'CAPA ineffective' WHEN capas_open > 0 THEN 'CAPA open'
                 WHEN capas_raised = 0 THEN 'No CAPA yet' ELSE 'Check pending' END AS flag FROM pairs0
)"""


@query("D15_repeat_pairs", f"WITH {PAIRS} SELECT * FROM pairs")
def repeat_pairs(spark, folder):
    return op.repeat_pairs(_devs(spark, folder), P)


@query("D16_pair_flag", f"WITH {PAIRS} SELECT flag, COUNT(*) AS pairs FROM pairs GROUP BY 1")
def pair_flag(spark, folder):
    return op.repeat_pairs(_devs(spark, folder), P).groupBy("flag").agg(F.count(F.lit(1)).alias("pairs"))


@query("D17_settings", f"""WITH {log_cte(45, 10, 60, 90, 120)}
SELECT overdue, due_soon, repeat, capa_status, effectiveness, COUNT(*) AS records FROM log GROUP BY ALL""")
def settings(spark, folder):
    other = op.DeviationParams(
        asof=src.DEVIATION_ASOF, target=45, warn=10, capa_due=60, repeat_window=90, effect_window=120)
    return op.register(_devs(spark, folder), other).groupBy(
        "overdue", "due_soon", "repeat", "capa_status", "effectiveness").agg(F.count(F.lit(1)).alias("records"))


@query("D18_domain_lists", f"""WITH {DEVS}
SELECT DISTINCT 'area' AS list, area AS value FROM devs UNION ALL SELECT DISTINCT 'sev', sev FROM devs
UNION ALL SELECT DISTINCT 'cause', cause FROM devs UNION ALL SELECT DISTINCT 'owner', owner FROM devs""")
def domain_lists(spark, folder):
    return op.domain_lists(_devs(spark, folder))


@query("D19_validity_checks", f"""WITH {DEVS}
SELECT id, 'area' AS field, area AS value, 'error' AS level FROM devs WHERE area = 'MACHINERY'
UNION ALL SELECT id, 'owner', owner, 'warning' FROM devs WHERE owner = 'Owner 3'
UNION ALL SELECT id, 'opened', CAST(opened AS VARCHAR), 'error' FROM devs WHERE opened <= DATE '2000-01-01'
UNION ALL SELECT id, 'closed', CAST(closed AS VARCHAR), 'error' FROM devs WHERE closed <= DATE '2000-01-01'
UNION ALL SELECT id, 'capa_closed', CAST(capa_closed AS VARCHAR), 'error' FROM devs WHERE capa_closed <= DATE '2000-01-01'""")
def validity_checks(spark, folder):
    devs = _devs(spark, folder)
    accepted = op.domain_lists(devs).filter(~F.col("value").isin("MACHINERY", "Owner 3"))
    return op.validity_checks(devs, accepted)


@query("D20_oldest_open", f"""WITH {LOG}
SELECT id, opened, area, asset, sev, cause, owner, closed, capa, capa_closed, days_open
FROM log WHERE status = 'Open' ORDER BY opened, id LIMIT 1""")
def oldest_open(spark, folder):
    return op.oldest_open(_devs(spark, folder), P)


@query("D21_register_filter", f"""WITH {LOG}
SELECT {REGISTER_COLUMNS} FROM log
WHERE area IN ('BUILDING', 'HOUSEHOLD') AND sev IN ('Major', 'Critical') AND opened BETWEEN DATE '1997-01-01' AND DATE '2000-12-31'
  AND effectiveness ILIKE '%ineffective%'""")
def register_filter(spark, folder):
    return op.register_filter(
        op.register(_devs(spark, folder), P), {"area": ["BUILDING", "HOUSEHOLD"], "sev": ["Major", "Critical"]},
        ("opened", "1997-01-01", "2000-12-31"), "INEFFECTIVE")


@query("D22_repeat_rate", f"""WITH {LOG} SELECT COUNT(*) AS total, COUNT(*) FILTER (WHERE repeat) AS repeats,
{rnd('COUNT(*) FILTER (WHERE repeat) / COUNT(*)', 6)} AS repeat_rate FROM log""")
def repeat_rate(spark, folder):
    return op.repeat_rate(_devs(spark, folder), P)


@query("D22_failure_gap", f"""WITH {LOG} SELECT id, capa, capa_closed, recurred_on, recurred_on - capa_closed AS days_to_recurrence
FROM log WHERE effectiveness = 'Ineffective'""")
def failure_gap(spark, folder):
    return op.failure_gap(_devs(spark, folder), P)


@query("D23_capa_required", f"""WITH {LOG} SELECT id, sev, asset, cause, opened, repeat FROM log
WHERE capa IS NULL AND (sev IN ('Major', 'Critical') OR repeat)""")
def capa_required(spark, folder):
    return op.capa_required(_devs(spark, folder), P)
