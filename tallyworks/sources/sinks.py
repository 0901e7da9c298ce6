"""Sinks. Every writer is a distributed write; nothing passes through the driver."""

from __future__ import annotations

from collections.abc import Mapping
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.ordering import with_global_order
from ..session import durable, scratch_path  # noqa: F401 - scratch_path is part of this module's interface

_END = (1 << 63) - 1


def materialize(df: DataFrame, path: str) -> DataFrame:
    """Replace the stored table at ``path`` and continue from what was written."""
    return durable(df, path)


def plain(df: DataFrame) -> DataFrame:
    """Decimals as doubles; dates and timestamps as ten-character ISO text."""
    out = []
    for field in df.schema.fields:
        kind, column = field.dataType.typeName(), F.col(f"`{field.name}`")
        if kind.startswith("decimal"):
            column = column.cast("double")
        elif kind in ("date", "timestamp", "timestamp_ntz"):
            column = F.date_format(column, "yyyy-MM-dd")
        out.append(column.alias(field.name))
    return df.select(*out)


def write_csv(df: DataFrame, path: str) -> None:
    """CSV with a header row."""
    df.write.mode("overwrite").option("header", True).option("escape", '"').csv(path)


def write_filtered_csv(df: DataFrame, predicate: Column, path: str) -> None:
    """Only the rows that pass the filter."""
    write_csv(df.filter(predicate), path)


def record_text(df: DataFrame) -> Column:
    return F.to_json(F.struct(*[F.col(f"`{c}`") for c in df.columns]), {"ignoreNullFields": "false"})


def json_records(tables: Mapping[str, DataFrame]) -> DataFrame:
    """(table, record): every row of every table as one JSON object."""
    parts = [plain(df).select(F.lit(name).alias("table"), record_text(df).alias("record")) for name, df in tables.items()]
    return reduce(DataFrame.unionByName, parts)


def write_json_records(tables: Mapping[str, DataFrame], path: str) -> None:
    """JSON lines, one folder per table; fits tables of any size."""
    json_records(tables).write.mode("overwrite").partitionBy("table").text(path)


def json_document(
    tables: Mapping[str, DataFrame], order: Mapping[str, list[str]] | None = None, single: tuple[str, ...] = (),
) -> DataFrame:
    """(table, record, line): the lines of one JSON document that holds tables as lists of records, in order.

    ``single`` tables are one object, or null without a row. ``order`` holds SQL sort expressions per table; rows that
    are equal in them are ordered by their text. Lines are numbered in range slices and sorted by ranges, so tables of
    any size pass through many tasks; written as text, the parts in name order are the document.
    """
    order = order or {}
    spark = next(iter(tables.values())).sparkSession
    lines = []
    for number, (name, df) in enumerate(tables.items()):
        last = number == len(tables) - 1
        one, opens = name in single, ("{" if number == 0 else "") + f'"{name}":'
        ready = plain(df)
        rows = ready.select(*[F.expr(c).alias(f"k{i}") for i, c in enumerate(order.get(name, []))], record_text(ready).alias("text"))
        keys = [F.col(f"k{i}") for i in range(len(rows.columns) - 1)] or [F.col("text")]
        placed = with_global_order(rows, keys, [F.col("text")], "at", total="of")
        comma = F.when(F.col("at") < F.col("of"), ",").otherwise("")
        lines.append(placed.select(F.lit(number).alias("table"), F.col("at").cast("bigint").alias("record"), F.concat("text", comma).alias("line")))
        closes = ("null" if one and not ready.limit(1).count() else "") + ("" if one else "]") + ("}" if last else ",")
        lines.append(spark.range(1).select(F.lit(number).alias("table"), F.lit(0).cast("bigint").alias("record"), F.lit(opens + ("" if one else "[")).alias("line")))
        lines.append(spark.range(1).select(F.lit(number).alias("table"), F.lit(_END).alias("record"), F.lit(closes).alias("line")))
    return reduce(DataFrame.unionByName, lines).orderBy("table", "record")


def fixed_text(value: Column, places: int) -> Column:
    """Number with a fixed count of decimals."""
    return value.cast(f"decimal(38,{places})").cast("string")


def spc_table(wide: DataFrame, replicates: int, places: int) -> DataFrame:
    """Subgroup rows as exported: index, ISO date, replicates at the given decimals, mean and range with two more."""
    reps = [fixed_text(F.col(f"rep{j}"), places).alias(f"rep{j}") for j in range(1, replicates + 1)]
    return wide.select(
        "param", "subgroup", F.date_format("date", "yyyy-MM-dd").alias("date"), *reps,
        fixed_text(F.col("mean"), places + 2).alias("mean"), fixed_text(F.col("range"), places + 2).alias("range"))


def write_compact(tables: Mapping[str, DataFrame], path: str) -> None:
    """The tables of a compact export as JSON lines in sibling folders."""
    for name, df in tables.items():
        plain(df).write.mode("overwrite").json(f"{path}/{name}")
