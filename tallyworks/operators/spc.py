"""Statistical process control: limits, run rules, capability and signal logs.

There may be few parameters and very many subgroups, so the run rules are not
evaluated in one window per parameter. Subgroups are cut into blocks and each
block also receives the last eight subgroups of the one before, the longest
look-back of any rule; every block is then an independent window.

``subgroup`` is the 1-based position of a subgroup within its parameter.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.numeric import count_where, exact_mean, first_match, outside_limits
from ..session import durable

BASE = 20
BLOCK = 4096
LOOK_BACK = 8

# Shewhart control chart constants by subgroup size.
CONSTANTS = {
    2: {"A2": 1.880, "D3": 0.0, "D4": 3.267, "d2": 1.128},
    3: {"A2": 1.023, "D3": 0.0, "D4": 2.574, "d2": 1.693},
    4: {"A2": 0.729, "D3": 0.0, "D4": 2.282, "d2": 2.059},
    5: {"A2": 0.577, "D3": 0.0, "D4": 2.114, "d2": 2.326},
}
RULES = (1, 2, 3, 5, 6)
# Fixed value: output text of signals without a cause.
NO_CAUSE = "No assignable cause found. Common-cause variation; no action, continue monitoring."


def constant(n: Column, name: str) -> Column:
    """Chart constant for a subgroup size; other sizes are an error."""
    cases = [(n == size, F.lit(values[name])) for size, values in CONSTANTS.items()]
    return first_match(cases, F.raise_error(F.concat(F.lit("no chart constants for n = "), n.cast("string"))).cast("double"))


def phase_label(subgroup: Column, base: int = BASE) -> Column:
    return F.when(subgroup <= base, "Baseline").otherwise("Monitoring")


def subgroup_label(subgroup: Column) -> Column:
    """SG-07 style label; longer numbers keep all digits."""
    text = subgroup.cast("string")
    return F.concat(F.lit("SG-"), F.when(F.length(text) < 2, F.lpad(text, 2, "0")).otherwise(text))


def subgroup_stats(measures: DataFrame) -> DataFrame:
    """Mean and range of the replicates of every subgroup."""
    return measures.groupBy("param", "subgroup").agg(
        F.min("date").alias("date"), F.count("value").alias("n"), exact_mean(F.col("value")).alias("mean"),
        (F.max("value") - F.min("value")).alias("range"),
    )


def full_subgroups(stats: DataFrame, parameters: DataFrame) -> DataFrame:
    """Subgroups with all replicates; the others count as points and values but set no limits."""
    return stats.join(parameters.select("param", F.col("n").alias("_size")), "param").filter(F.col("n") == F.col("_size")).drop("_size")


def control_limits(stats: DataFrame, parameters: DataFrame, basis: str = "base", base: int = BASE) -> DataFrame:
    """Centre lines, limits and sigmas per parameter from the baseline or from all subgroups."""
    if basis not in ("base", "all"):
        raise ValueError("basis is 'base' or 'all'")
    used = full_subgroups(stats.filter(F.col("subgroup") <= base) if basis == "base" else stats, parameters)
    centre = used.groupBy("param").agg(
        exact_mean(F.col("mean")).alias("cl"), exact_mean(F.col("range")).alias("rbar"))
    n, cl, rbar = F.col("n"), F.col("cl"), F.col("rbar")
    spread = constant(n, "A2") * rbar
    return centre.join(parameters.select("param", "n"), "param").select(
        "param", "n", "cl", (cl + spread).alias("ucl"), (cl - spread).alias("lcl"), (spread / 3).alias("s"), "rbar",
        (constant(n, "D4") * rbar).alias("rucl"), (constant(n, "D3") * rbar).alias("rlcl"),
        (rbar / constant(n, "d2")).alias("sigma"),
    )


def z_score(value: Column, centre: Column, sigma: Column) -> Column:
    """Distance from the centre in sigmas; infinite off centre and zero on it when sigma is zero."""
    d = value - centre
    flat = F.when(d > 0, F.lit(float("inf"))).when(d < 0, F.lit(float("-inf"))).otherwise(F.lit(0.0))
    return F.when(sigma == 0, flat).otherwise(d / F.nullif(sigma, F.lit(0.0)))


def _with_look_back(df: DataFrame, block: int) -> DataFrame:
    """Copies the last rows of each block into the next one; ``_home`` is the own block."""
    home = F.floor((F.col("subgroup") - 1) / block)
    inside = (F.col("subgroup") - 1) % block
    blocks = F.when(inside >= block - LOOK_BACK, F.array(home, home + 1)).otherwise(F.array(home))
    return df.withColumn("_home", home).withColumn("_block", F.explode(blocks))


def nelson(
    stats: DataFrame, limits: DataFrame, rules: tuple[int, ...] = RULES, block: int = BLOCK, base: int = BASE
) -> DataFrame:
    """Subgroups with the run rules their mean breaks (``hits``), the range rule and the phase."""
    unknown = set(rules) - set(RULES)
    if unknown:
        raise ValueError(f"unknown rules {sorted(unknown)}")
    placed = stats.join(limits.drop("n"), "param").withColumn("z", z_score(F.col("mean"), F.col("cl"), F.col("s")))
    spread = _with_look_back(placed, block)
    order = Window.partitionBy("param", "_block").orderBy("subgroup")

    def last(rows: int) -> Window:
        return order.rowsBetween(1 - rows, 0)

    def hits_of(condition: Column, rows: int) -> Column:
        return count_where(condition).over(last(rows))

    z, previous = F.col("z"), F.col("_previous")
    stepped = spread.withColumn("_previous", F.lag("mean").over(order))
    seen = {rows: F.count(F.lit(1)).over(last(rows)) for rows in (3, 5, 6, 9)}
    tests = {
        1: F.abs(z) > 3,
        2: (hits_of(z > 0, 9) == 9) | (hits_of(z < 0, 9) == 9),
        3: (seen[6] == 6) & ((hits_of(F.col("mean") > previous, 5) == 5) | (hits_of(F.col("mean") < previous, 5) == 5)),
        5: (seen[3] == 3) & (F.abs(z) > 2) & ((hits_of(z > 2, 3) >= 2) | (hits_of(z < -2, 3) >= 2)),
        6: (seen[5] == 5) & (F.abs(z) > 1) & ((hits_of(z > 1, 5) >= 4) | (hits_of(z < -1, 5) >= 4)),
    }
    marks = F.array_compact(F.array(*[F.when(tests[r], r) for r in RULES if r in rules])) if rules else F.array().cast("array<int>")
    ranged = (F.col("range") > F.col("rucl")) | (F.col("range") < F.col("rlcl"))
    return stepped.withColumn("hits", marks).filter(F.col("_block") == F.col("_home")).select(
        "param", "subgroup", "date", "n", "mean", "range", "z", "hits", ranged.alias("range_hit"),
        phase_label(F.col("subgroup"), base).alias("phase"),
    )


def mean_hit() -> Column:
    return F.size("hits") > 0


def any_hit() -> Column:
    return mean_hit() | F.col("range_hit")


def flag_text() -> Column:
    """Broken rules as text, means first."""
    means = F.transform("hits", lambda r: F.concat(F.lit("X-bar R"), r.cast("string")))
    return F.array_join(F.concat(means, F.when(F.col("range_hit"), F.array(F.lit("R R1"))).otherwise(F.array().cast("array<string>"))), ", ")


def ooc_summary(flagged: DataFrame) -> DataFrame:
    """Out-of-control points per parameter and the first signal."""
    first = F.min(F.when(any_hit(), F.struct("subgroup", "date", "phase")))
    return flagged.groupBy("param").agg(
        count_where(mean_hit()).alias("ooc_mean"), count_where(F.col("range_hit")).alias("ooc_range"), first.alias("f")
    ).select(
        "param", "ooc_mean", "ooc_range", (F.col("ooc_mean") + F.col("ooc_range")).alias("ooc_total"),
        F.col("f.subgroup").alias("first_subgroup"), F.col("f.date").alias("first_date"), F.col("f.phase").alias("first_phase"),
    )


def capability(stats: DataFrame, parameters: DataFrame, base: int = BASE) -> DataFrame:
    """Process mean, sigma, Cp and Cpk per parameter and phase; one-sided specs have no Cp."""
    grouped = full_subgroups(stats, parameters).groupBy("param", phase_label(F.col("subgroup"), base).alias("phase")).agg(
        exact_mean(F.col("mean")).alias("mu"), exact_mean(F.col("range")).alias("rbar"))
    mu, s, lsl, usl = (F.col(c) for c in ("mu", "s", "lsl", "usl"))
    joined = grouped.join(parameters.select("param", "n", "lsl", "usl"), "param").withColumn(
        "s", F.col("rbar") / constant(F.col("n"), "d2"))
    sided = joined.withColumn("cpu", F.try_divide(usl - mu, 3 * s)).withColumn("cpl", F.try_divide(mu - lsl, 3 * s))
    return sided.select(
        "param", "phase", "mu", "s", "cpu", "cpl", F.try_divide(usl - lsl, 6 * s).alias("cp"),
        F.least("cpu", "cpl").alias("cpk"),
    )


def cpk_class(cpk: Column) -> Column:
    return F.when(cpk.isNotNull(), first_match([(cpk >= 1.33, "pass"), (cpk >= 1, "alert")], "action"))


def interval_text(points: DataFrame, intervals: DataFrame, default: str, block: int = BLOCK) -> DataFrame:
    """Adds ``cause``: the text of the interval that covers the subgroup, else the default.

    Intervals are clipped to the points present and cut into blocks, so the match is
    an equi join on (param, block). The earliest covering interval wins.
    """
    reach = points.groupBy("param").agg(F.min("subgroup").alias("_lo"), F.max("subgroup").alias("_hi"))
    clipped = intervals.join(reach, "param").select(
        "param", "from_subgroup", "to_subgroup", "text",
        F.greatest("from_subgroup", "_lo").alias("_from"), F.least("to_subgroup", "_hi").alias("_to"),
    ).filter(F.col("_from") <= F.col("_to"))
    pieces = clipped.withColumn("_block", F.explode(F.sequence(F.floor(F.col("_from") / block), F.floor(F.col("_to") / block))))
    keyed = points.select("param", "subgroup").withColumn("_block", F.floor(F.col("subgroup") / block))
    covered = keyed.join(pieces, ["param", "_block"]).filter(F.col("subgroup").between(F.col("_from"), F.col("_to")))
    chosen = covered.groupBy("param", "subgroup").agg(
        F.min_by("text", F.struct("from_subgroup", "to_subgroup", "text")).alias("_text"))
    return points.join(chosen, ["param", "subgroup"], "left").withColumn(
        "cause", F.coalesce("_text", F.lit(default))).drop("_text")


def signal_log(flagged: DataFrame, causes: DataFrame) -> DataFrame:
    """One row per flagged subgroup with its rules and investigation outcome.

    The signals are few and read three times by the interval match, so they are stored first.
    """
    signals = durable(flagged.filter(any_hit()))
    return interval_text(signals, causes, NO_CAUSE).select(
        "param", "subgroup", subgroup_label(F.col("subgroup")).alias("label"), "date", flag_text().alias("rules"),
        "mean", "range", "phase", "cause",
    )


def histogram(values: DataFrame, key: str, value: str, bins: int = 14) -> DataFrame:
    """Equal bins over the observed span of every key; the maximum falls in the last bin, empty bins are kept."""
    span = values.groupBy(key).agg(F.min(value).alias("_b0"), F.max(value).alias("_b1")).withColumn(
        "_w", (F.col("_b1") - F.col("_b0")) / bins)
    spine = span.select(key, "_b0", "_w", F.explode(F.sequence(F.lit(0), F.lit(bins - 1))).alias("bin"))
    at = F.least(F.lit(bins - 1), F.floor(F.coalesce(F.try_divide(F.col(value) - F.col("_b0"), F.col("_w")), F.lit(0.0))))
    counts = values.filter(F.col(value).isNotNull()).join(span, key).groupBy(key, at.cast("int").alias("bin")).agg(
        F.count(F.lit(1)).alias("n"))
    return spine.join(counts, [key, "bin"], "left").select(
        key, "bin", (F.col("_b0") + F.col("_w") * (F.col("bin") + 0.5)).alias("mid"), F.coalesce("n", F.lit(0)).alias("n"))


def out_of_spec(measures: DataFrame, parameters: DataFrame) -> DataFrame:
    """Individual values beyond the limits that exist, and all values, per parameter."""
    beyond = outside_limits(F.col("value"), F.col("lsl"), F.col("usl"))
    return measures.join(parameters.select("param", "lsl", "usl"), "param").groupBy("param").agg(
        count_where(beyond).alias("out_of_spec"), F.count("value").alias("n_values"))


def replicate_columns(measures: DataFrame, replicates: int) -> DataFrame:
    """Replicates of a subgroup side by side, with mean and range."""
    reps = [F.max(F.when(F.col("rep") == j, F.col("value"))).alias(f"rep{j}") for j in range(1, replicates + 1)]
    return measures.groupBy("param", "subgroup").agg(
        F.min("date").alias("date"), *reps, exact_mean(F.col("value")).alias("mean"),
        (F.max("value") - F.min("value")).alias("range"),
    )


def subgroup_register(measures: DataFrame, flagged: DataFrame, replicates: int) -> DataFrame:
    """All subgroups with replicate columns, broken rules and phase."""
    marks = flagged.select("param", "subgroup", flag_text().alias("flags"), "phase")
    return replicate_columns(measures, replicates).join(marks, ["param", "subgroup"]).withColumn(
        "label", subgroup_label(F.col("subgroup")))


def basis_compare(stats: DataFrame, parameters: DataFrame, base: int = BASE) -> DataFrame:
    """Flagged points per parameter under baseline limits and under limits from all data.

    Subgroup figures are read four times here; pass a stored table when they are costly.
    """
    parts = [
        ooc_summary(nelson(stats, control_limits(stats, parameters, basis, base), base=base)).select(
            "param", F.lit(basis).alias("basis"), "ooc_mean", "ooc_range", F.col("ooc_total").alias("n"))
        for basis in ("base", "all")
    ]
    return parts[0].unionByName(parts[1])


def working_day(start: Column, index: Column) -> Column:
    """The index-th weekday (from 0) on or after ``start``, without building a calendar."""
    weekday = F.weekday(start)
    monday = F.date_sub(start, weekday)
    # A start on a weekend counts from the Monday after it.
    steps = F.when(weekday > 4, F.lit(5)).otherwise(weekday) + index
    return F.date_add(monday, (F.floor(steps / 5) * 7 + steps % 5).cast("int"))


def working_day_spine(spark, start: str, n: int) -> DataFrame:
    """(position, date) of the first n weekdays from a date."""
    return spark.range(n).select(
        (F.col("id") + 1).alias("position"), working_day(F.lit(start).cast("date"), F.col("id")).alias("date"))
