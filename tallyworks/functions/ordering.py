"""Row numbers, ranks and tiles without a single-task window.

A plain window numbers all rows of a group in one task. Here the rows are range
partitioned on (keys, order): because the order is total, even one key that
holds most of the table is cut into even slices. The slice number is written
down with the rows (a stored table, so every later pass sees the same slices);
rows are numbered inside their slice and shifted by what the same key has in
earlier slices. A key can continue from an earlier slice only as the first key
of a slice, so the shift table has at most one row per slice and is safe to
broadcast whatever the size of the data.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import durable

_SLICE = "_slice"


# Rows a slice holds at most, so that the work of a task does not grow with the table.
SLICE_ROWS = 2_000_000


def _planned(df: DataFrame, slices: int | None, stored: bool) -> tuple[DataFrame, int]:
    """The rows, stored so that they are computed once, and the number of slices they need.

    Rows that are ``stored`` already are not written again: counting them and sampling their range bounds reads
    footers and the ordering columns.
    """
    if slices:
        return df, slices
    rows = df if stored else durable(df)
    return rows, max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-rows.count() // SLICE_ROWS))


def number_rows(
    df: DataFrame,
    keys: list[str],
    order: list[Column],
    seq: str,
    firsts: dict[str, str] | None = None,
    slices: int | None = None,
    stored: bool = False,
) -> DataFrame:
    """Add ``seq``, the 1-based position within ``keys`` by ``order`` (which must be total).

    ``firsts`` maps a new column to an existing one and takes its value from the
    first row of the key. ``stored`` says that df only reads tables and so may be evaluated more than once.
    """
    firsts = firsts or {}
    df, slices = _planned(df, slices, stored)
    ranged = df.repartitionByRange(slices, *[F.col(k) for k in keys], *order)
    cut = durable(ranged.withColumn(_SLICE, F.spark_partition_id()))
    per_slice = cut.groupBy(_SLICE, *keys).agg(
        F.count(F.lit(1)).alias("_n"),
        *[F.min_by(F.struct(F.col(src)), F.struct(*order)).alias(f"_first_{new}") for new, src in firsts.items()],
    )
    runs = Window.partitionBy(*keys).orderBy(_SLICE)
    carry = (
        per_slice.withColumn("_before", F.sum("_n").over(runs.rowsBetween(Window.unboundedPreceding, -1)))
        .select(_SLICE, *keys, "_before", *[F.first(f"_first_{new}").over(runs).alias(f"_first_{new}") for new in firsts])
        .filter(F.col("_before") > 0)
    )
    shift = carry.select(
        F.col(_SLICE).alias("_s"), *[F.col(k).alias(f"_k_{k}") for k in keys], "_before", *[f"_first_{n}" for n in firsts]
    )
    match = cut[_SLICE] == shift["_s"]
    for k in keys:
        match = match & cut[k].eqNullSafe(shift[f"_k_{k}"])
    local = Window.partitionBy(_SLICE, *keys).orderBy(*order)
    numbered = cut.join(F.broadcast(shift), match, "left")
    for new, src in firsts.items():
        here = F.first(F.struct(F.col(src))).over(local)
        numbered = numbered.withColumn(new, F.coalesce(F.col(f"_first_{new}"), here)[src])
    numbered = numbered.withColumn(seq, F.row_number().over(local) + F.coalesce("_before", F.lit(0)))
    return numbered.select(*df.columns, *firsts, seq)


def with_global_order(
    df: DataFrame,
    order: list[Column],
    ties: list[Column],
    position: str,
    rank: str | None = None,
    total: str | None = None,
    slices: int | None = None,
    stored: bool = False,
) -> DataFrame:
    """Positions over the whole table by ``order`` then ``ties``; ``rank`` gives equal ``order`` values one rank.

    Slices are stored in sorted order with the row index of each row, so a position needs
    no further exchange: the index plus what the earlier slices hold. ``stored`` as in number_rows.
    """
    df, slices = _planned(df, slices, stored)
    ranged = df.repartitionByRange(slices, *order, *ties).sortWithinPartitions(*order, *ties)
    cut = durable(ranged.withColumns({_SLICE: F.spark_partition_id(), "_at": F.monotonically_increasing_id()}))
    sizes = cut.groupBy(_SLICE).agg(F.count(F.lit(1)).alias("_n"))
    steps = Window.orderBy(_SLICE)
    shift = sizes.select(
        F.col(_SLICE).alias("_s"),
        (F.sum("_n").over(steps) - F.col("_n")).alias("_before"),
        F.sum("_n").over(Window.partitionBy()).alias("_total"),
    )
    local = Window.partitionBy(_SLICE)
    placed = cut.join(F.broadcast(shift), cut[_SLICE] == shift["_s"])
    # The low 33 bits of the generated id are the row index inside its partition.
    index = F.col("_at").bitwiseAND(F.lit((1 << 33) - 1))
    out = placed.withColumn(position, index + 1 + F.col("_before"))
    if rank:
        value = F.struct(*[c.alias(f"v{i}") for i, c in enumerate(order)])
        out = out.withColumn("_v", value).withColumn("_r", F.rank().over(local.orderBy(*order)) + F.col("_before"))
        # A tie group that crosses slices starts in the earliest slice that holds it.
        ends = out.groupBy(_SLICE).agg(
            F.min("_v").alias("lo"), F.max("_v").alias("hi"), F.min("_r").alias("lo_r"), F.max("_r").alias("hi_r")
        )
        starts = (
            ends.select(F.explode(F.array(F.struct(F.col("lo").alias("v"), F.col("lo_r").alias("r")),
                                          F.struct(F.col("hi").alias("v"), F.col("hi_r").alias("r")))).alias("e"))
            .groupBy(F.col("e.v").alias("_edge")).agg(F.min("e.r").alias("_edge_r"))
        )
        out = out.join(F.broadcast(starts), out["_v"].eqNullSafe(starts["_edge"]), "left")
        out = out.withColumn(rank, F.coalesce("_edge_r", "_r"))
    if total:
        out = out.withColumn(total, F.col("_total"))
    return out.select(*df.columns, position, *([rank] if rank else []), *([total] if total else []))


def tile(position: Column, total: Column, tiles: int) -> Column:
    """NTILE from a position and the row count; the remainder goes to the first tiles."""
    base = F.floor(total / tiles)
    extra = total % tiles
    wide = extra * (base + 1)
    in_wide = F.floor((position - 1) / (base + 1)) + 1
    in_narrow = extra + F.floor((position - wide - 1) / F.nullif(base, F.lit(0))) + 1
    return F.when(position <= wide, in_wide).otherwise(in_narrow)


def percent_rank(rank: Column, total: Column) -> Column:
    return F.when(total <= 1, F.lit(0.0)).otherwise((rank - 1).cast("double") / F.nullif(total - 1, F.lit(0)).cast("double"))
