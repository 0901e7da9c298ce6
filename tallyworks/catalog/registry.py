"""Query registration and the SQL fragments the oracle statements share."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import configure

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}

_WHOLE = ("byte", "short", "integer")


def conform(df: DataFrame) -> DataFrame:
    """Whole numbers as bigint, decimals as double, timestamps without zone."""
    out = []
    for field in df.schema.fields:
        kind, column = field.dataType.typeName(), F.col(f"`{field.name}`")
        if kind in _WHOLE:
            column = column.cast("bigint")
        elif kind.startswith("decimal") or kind == "float":
            column = column.cast("double")
        elif kind == "timestamp":
            column = column.cast("timestamp_ntz")
        out.append(column.alias(field.name))
    return df.select(*out)


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    """Register a query under its inventory id, with the oracle statement when there is one."""

    def register(build: Query) -> Query:
        if name in QUERIES:
            raise ValueError(f"{name} is registered twice")

        def run(spark: SparkSession, folder: str) -> DataFrame:
            return conform(build(configure(spark), folder))

        QUERIES[name] = run
        if sql is not None:
            ORACLE[name] = sql
        return build

    return register


def dsum(value: str) -> str:
    """Sum of the decimal readings; texts stand between, so that no double rounds on the way."""
    return f"CAST(CAST(SUM(CAST(CAST({value} AS VARCHAR) AS DECIMAL(38,12))) AS VARCHAR) AS DOUBLE)"


def davg(value: str) -> str:
    return f"({dsum(value)} / COUNT({value}))"


def drate(condition: str) -> str:
    return f"(CAST(SUM(CAST(({condition}) AS INT)) AS DOUBLE) / COUNT({condition}))"


def rnd(value: str, places: int) -> str:
    return f"CAST(ROUND(CAST({value} AS DECIMAL(38,12)), {places}) AS DOUBLE)"


def big(value: str) -> str:
    return f"CAST({value} AS BIGINT)"
