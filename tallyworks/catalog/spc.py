"""Process control queries P1..P19."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import spc as op
from ..session import durable
from ..sources import projection as src
from .registry import big, dsum, query

MEASURES = f"""numbered AS (
  SELECT *, ROW_NUMBER() OVER (PARTITION BY event_type ORDER BY ts, event_id) AS rn FROM events
),
sub AS (SELECT *, (rn - 1) // 4 + 1 AS subgroup, (rn - 1) % 4 + 1 AS rep FROM numbered),
measures AS (
  SELECT event_type AS param, subgroup, CAST(ts AS DATE) AS date, rep,
         CAST(CAST(value AS DECIMAL(18,2)) + CASE WHEN event_type = 'click' AND subgroup >= 31 THEN 25
              WHEN event_type = 'view' AND subgroup BETWEEN 26 AND 45 THEN 6 * (subgroup - 25)
              WHEN event_type = 'error' AND subgroup BETWEEN 30 AND 35 AND rep = 1 THEN 200 ELSE 0 END AS DOUBLE) AS value
  FROM sub
),
params AS (SELECT DISTINCT event_type AS param, CAST(CASE WHEN event_type NOT IN ('signup', 'view') THEN 0 END AS DOUBLE) AS lsl,
                  CAST(CASE WHEN event_type <> 'view' THEN 100 END AS DOUBLE) AS usl FROM events),
stats AS (
  SELECT param, subgroup, MIN(date) AS date, COUNT(*) AS n, {dsum('value')} / COUNT(*) AS mean,
         MAX(value) - MIN(value) AS range
  FROM measures GROUP BY 1, 2
)"""
CENTRE = f"{dsum('mean')} / COUNT(*) AS {{0}}, {dsum('range')} / COUNT(*) AS rbar"
A2, D4, D2 = ("CAST(0.729 AS DOUBLE)", "CAST(2.282 AS DOUBLE)", "CAST(2.059 AS DOUBLE)")


def limits_cte(basis: str, name: str = "limits") -> str:
    where = "WHERE n = 4 AND subgroup <= 20" if basis == "base" else "WHERE n = 4"
    return f"""{name} AS (
  SELECT param, {big(4)} AS n, cl, cl + {A2} * rbar AS ucl, cl - {A2} * rbar AS lcl, {A2} * rbar / 3 AS s, rbar,
         {D4} * rbar AS rucl, CAST(0 AS DOUBLE) * rbar AS rlcl, rbar / {D2} AS sigma
  FROM (SELECT param, {CENTRE.format('cl')} FROM stats {where} GROUP BY 1)
)"""


def flags_cte(limits: str = "limits", name: str = "flagged") -> str:
    def run(cond: str, k: int) -> str:
        return f"COUNT(*) FILTER (WHERE {cond}) OVER (PARTITION BY param ORDER BY subgroup ROWS BETWEEN {k - 1} PRECEDING AND CURRENT ROW)"

    return f"""{name}0 AS (
  SELECT st.*, (mean - cl) / s AS z, rucl, rlcl, LAG(mean) OVER (PARTITION BY st.param ORDER BY subgroup) AS prev
  FROM stats st JOIN {limits} l ON l.param = st.param
),
{name} AS (
  SELECT param, subgroup, date, n, mean, range, z,
         ABS(z) > 3 AS r1,
         {run('z > 0', 9)} = 9 OR {run('z < 0', 9)} = 9 AS r2,
         subgroup >= 6 AND ({run('mean > prev', 5)} = 5 OR {run('mean < prev', 5)} = 5) AS r3,
         subgroup >= 3 AND ABS(z) > 2 AND ({run('z > 2', 3)} >= 2 OR {run('z < -2', 3)} >= 2) AS r5,
         subgroup >= 5 AND ABS(z) > 1 AND ({run('z > 1', 5)} >= 4 OR {run('z < -1', 5)} >= 4) AS r6,
         range > rucl OR range < rlcl AS rr,
         CASE WHEN subgroup <= 20 THEN 'Baseline' ELSE 'Monitoring' END AS phase
  FROM {name}0
)"""


BASE = f"{MEASURES}, {limits_cte('base')}"
FLAGGED = f"{BASE}, {flags_cte()}"
ANY = "(r1 OR r2 OR r3 OR r5 OR r6 OR rr)"
XHIT = "(r1 OR r2 OR r3 OR r5 OR r6)"


def rule_list(rules: tuple[int, ...] = op.RULES, prefix: str = "", sep: str = ",", ranged: bool = False) -> str:
    parts = [f"CASE WHEN r{r} THEN '{prefix}{r}' END" for r in rules]
    if ranged:
        parts.append("CASE WHEN rr THEN 'R R1' END")
    return f"CONCAT_WS('{sep}', {', '.join(parts)})"


def _parts(spark, folder):
    measures = src.measures(spark, folder)
    return measures, op.subgroup_stats(measures), src.parameters(spark, folder)


def _stored(spark, folder):
    """Like ``_parts`` with the subgroup figures written once, for queries that read them several times."""
    measures, stats, params = _parts(spark, folder)
    return measures, durable(stats), params


def _flagged(spark, folder, rules=op.RULES):
    _, stats, params = _stored(spark, folder)
    return op.nelson(stats, op.control_limits(stats, params), rules, block=64)


@query("P1_subgroup_stats", f"WITH {MEASURES} SELECT * FROM stats")
def subgroup_stats(spark, folder):
    return _parts(spark, folder)[1]


@query("P2_control_limits", f"WITH {BASE} SELECT * FROM limits")
def control_limits(spark, folder):
    _, stats, params = _parts(spark, folder)
    return op.control_limits(stats, params)


@query("P2_control_limits_all", f"WITH {MEASURES}, {limits_cte('all')} SELECT * FROM limits")
def control_limits_all(spark, folder):
    _, stats, params = _parts(spark, folder)
    return op.control_limits(stats, params, "all")


def _single_rule(name: str, rule: int):
    @query(name, f"WITH {FLAGGED} SELECT param, subgroup, r{rule} AS hit FROM flagged")
    def build(spark, folder):
        return _flagged(spark, folder, (rule,)).select("param", "subgroup", op.mean_hit().alias("hit"))

    return build


for _name, _rule in (("P3_nelson_1", 1), ("P4_nelson_2", 2), ("P5_nelson_3", 3), ("P6_nelson_5", 5), ("P7_nelson_6", 6)):
    _single_rule(_name, _rule)


@query("P8_range_rule_1", f"WITH {FLAGGED} SELECT param, subgroup, rr AS hit FROM flagged")
def range_rule(spark, folder):
    return _flagged(spark, folder).select("param", "subgroup", F.col("range_hit").alias("hit"))


@query("P9_rule_subset", f"WITH {FLAGGED} SELECT param, subgroup, {rule_list((1, 3, 6))} AS rules FROM flagged")
def rule_subset(spark, folder):
    return _flagged(spark, folder, (1, 3, 6)).select(
        "param", "subgroup", F.array_join(F.col("hits").cast("array<string>"), ",").alias("rules"))


@query("P10_ooc_summary", f"""WITH {FLAGGED}
SELECT param, COUNT(*) FILTER (WHERE {XHIT}) AS ooc_mean, COUNT(*) FILTER (WHERE rr) AS ooc_range,
       COUNT(*) FILTER (WHERE {XHIT}) + COUNT(*) FILTER (WHERE rr) AS ooc_total,
       MIN(subgroup) FILTER (WHERE {ANY}) AS first_subgroup, ARG_MIN(date, subgroup) FILTER (WHERE {ANY}) AS first_date,
       ARG_MIN(phase, subgroup) FILTER (WHERE {ANY}) AS first_phase
FROM flagged GROUP BY 1""")
def ooc_summary(spark, folder):
    return op.ooc_summary(_flagged(spark, folder))


CAPABILITY = f"""{MEASURES}, cap AS (
  SELECT param, phase, mu, s, (usl - mu) / (3 * s) AS cpu, (mu - lsl) / (3 * s) AS cpl, (usl - lsl) / (6 * s) AS cp,
         LEAST((usl - mu) / (3 * s), (mu - lsl) / (3 * s)) AS cpk
  FROM (SELECT *, rbar / {D2} AS s FROM (
    SELECT param, CASE WHEN subgroup <= 20 THEN 'Baseline' ELSE 'Monitoring' END AS phase, {CENTRE.format('mu')} FROM stats WHERE n = 4 GROUP BY 1, 2))
  JOIN params USING (param)
)"""


@query("P11_capability", f"WITH {CAPABILITY} SELECT * FROM cap")
def capability(spark, folder):
    _, stats, params = _parts(spark, folder)
    return op.capability(stats, params)


@query("P12_cpk_class", f"""WITH {CAPABILITY} SELECT param, phase, cpk,
CASE WHEN cpk >= 1.33 THEN 'pass' WHEN cpk >= 1 THEN 'alert' WHEN cpk IS NOT NULL THEN 'action' END AS class FROM cap""")
def cpk_class(spark, folder):
    _, stats, params = _parts(spark, folder)
    return op.capability(stats, params).select("param", "phase", "cpk", op.cpk_class(F.col("cpk")).alias("class"))


LABEL = "'SG-' || CASE WHEN subgroup < 10 THEN '0' ELSE '' END || subgroup"


@query("P13_signal_log", f"""WITH {FLAGGED}
SELECT param, subgroup, {LABEL} AS label, date, {rule_list(prefix='X-bar R', sep=', ', ranged=True)} AS rules, mean, range, phase,
       CASE WHEN (param = 'click' AND subgroup >= 31) OR (param = 'view' AND subgroup BETWEEN 26 AND 45)
              OR (param = 'error' AND subgroup BETWEEN 30 AND 35) THEN 'Known cause on ' || param ELSE '{op.NO_CAUSE}' END AS cause
FROM flagged WHERE {ANY}""")
def signal_log(spark, folder):
    return op.signal_log(_flagged(spark, folder), src.cause_intervals(spark, folder))


@query("P14_histogram", f"""WITH {MEASURES},
span AS (SELECT param, MIN(value) AS b0, (MAX(value) - MIN(value)) / 14 AS w FROM measures GROUP BY 1),
binned AS (SELECT param, LEAST(13, FLOOR((value - b0) / w)) AS bin FROM measures JOIN span USING (param))
SELECT s.param, {big('g.bin')} AS bin, b0 + w * (g.bin + CAST(0.5 AS DOUBLE)) AS mid,
       (SELECT COUNT(*) FROM binned b WHERE b.param = s.param AND b.bin = g.bin) AS n
FROM span s, (SELECT UNNEST(RANGE(14)) AS bin) g""")
def histogram(spark, folder):
    return op.histogram(_parts(spark, folder)[0], "param", "value")


@query("P15_out_of_spec", f"""WITH {MEASURES}
SELECT param, COUNT(*) FILTER (WHERE value > usl OR value < lsl) AS out_of_spec, COUNT(*) AS n_values
FROM measures JOIN params USING (param) GROUP BY 1""")
def out_of_spec(spark, folder):
    measures, _, params = _parts(spark, folder)
    return op.out_of_spec(measures, params)


REPS = ", ".join(f"MAX(CASE WHEN rep = {j} THEN value END) AS rep{j}" for j in range(1, 5))


@query("P16_subgroup_register", f"""WITH {FLAGGED}, reps AS (SELECT param, subgroup, {REPS} FROM measures GROUP BY 1, 2)
SELECT param, subgroup, {LABEL} AS label, date, rep1, rep2, rep3, rep4, mean, range,
       {rule_list(prefix='X-bar R', sep=', ', ranged=True)} AS flags, phase
FROM flagged JOIN reps USING (param, subgroup)""")
def subgroup_register(spark, folder):
    measures, stats, params = _stored(spark, folder)
    flagged = op.nelson(stats, op.control_limits(stats, params), block=64)
    return op.subgroup_register(measures, flagged, 4)


@query("P17_phase_label", f"""WITH {MEASURES}
SELECT param, CASE WHEN subgroup <= 20 THEN 'Baseline' ELSE 'Monitoring' END AS phase, COUNT(*) AS subgroups FROM stats GROUP BY 1, 2""")
def phase_label(spark, folder):
    return _parts(spark, folder)[1].groupBy("param", op.phase_label(F.col("subgroup")).alias("phase")).agg(
        F.count(F.lit(1)).alias("subgroups"))


_COUNTS = f"param, COUNT(*) FILTER (WHERE {XHIT}) AS ooc_mean, COUNT(*) FILTER (WHERE rr) AS ooc_range, COUNT(*) FILTER (WHERE {XHIT}) + COUNT(*) FILTER (WHERE rr) AS n"


@query("P18_basis_compare", f"""WITH {FLAGGED}, {limits_cte('all', 'limits_all')}, {flags_cte('limits_all', 'flagged_all')}
SELECT 'base' AS basis, {_COUNTS} FROM flagged GROUP BY param
UNION ALL SELECT 'all', {_COUNTS} FROM flagged_all GROUP BY param""")
def basis_compare(spark, folder):
    _, stats, params = _stored(spark, folder)
    return op.basis_compare(stats, params)


@query("P19_working_day_spine", f"""WITH {MEASURES},
days AS (SELECT CAST(d AS DATE) AS date, ROW_NUMBER() OVER (ORDER BY d) AS position FROM (
  SELECT UNNEST(GENERATE_SERIES((SELECT CAST(MIN(date) AS TIMESTAMP) FROM stats),
    (SELECT CAST(MIN(date) + CAST(2 * MAX(subgroup) + 7 AS INT) AS TIMESTAMP) FROM stats), INTERVAL 1 DAY)) AS d) WHERE DAYOFWEEK(d) BETWEEN 1 AND 5)
SELECT param, subgroup, days.date AS date FROM stats JOIN days ON days.position = subgroup""")
def working_day_spine(spark, folder):
    stats = _parts(spark, folder)[1]
    start = stats.select(F.min("date")).scalar()
    return stats.select("param", "subgroup", op.working_day(start, F.col("subgroup") - 1).alias("date"))
