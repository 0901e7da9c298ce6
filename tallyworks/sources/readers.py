"""Readers. Schemas are declared, so no file is scanned twice to guess types."""

from __future__ import annotations

from collections.abc import Iterable, Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import schemas


def read_csv_tables(
    spark: SparkSession, paths: Mapping[str, str], ddl: Mapping[str, str], multi_line: tuple[str, ...] = ("order_reviews",)
) -> dict[str, DataFrame]:
    """Named CSV files with a header row, each with its declared schema.

    Only the tables in ``multi_line`` may hold line breaks inside quotes; the files of
    all others stay splittable.
    """
    return {
        name: spark.read.schema(ddl[name]).option("header", True).option("enforceSchema", False).option("escape", '"')
        .option("multiLine", name in multi_line).csv(path)
        for name, path in paths.items()
    }


def read_tables(spark: SparkSession, folder: str, names: Iterable[str], fmt: str = "parquet") -> dict[str, DataFrame]:
    """A fixed list of source tables of one folder; anything else in the folder is left alone."""
    return {name: spark.read.format(fmt).load(f"{folder}/{name}.{fmt}") for name in names}


def star(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """One of the star-schema test tables."""
    if name not in schemas.STAR_TABLES:
        raise ValueError(f"unknown table {name}")
    reader = spark.read.schema(schemas.STAR[name]) if name in schemas.STAR else spark.read
    return reader.parquet(f"{folder}/{name}.parquet")


def row_counts(tables: Mapping[str, DataFrame]) -> DataFrame:
    """(table, rows) for every loaded table."""
    counts = [
        df.agg(F.count(F.lit(1)).alias("rows")).select(F.lit(name).alias("table"), "rows") for name, df in tables.items()
    ]
    out = counts[0]
    for other in counts[1:]:
        out = out.unionByName(other)
    return out


def deviations_from_json(spark: SparkSession, path: str, multi_line: bool = True) -> tuple[DataFrame, DataFrame]:
    """(records, document settings) of nested deviation documents; ISO text becomes a date, null stays null.

    ``multi_line`` reads one document per file; without it each line is a document,
    which lets Spark split large files.
    """
    document = spark.read.schema(schemas.DEVIATION_DOCUMENT).option("multiLine", multi_line).json(path)
    record = document.select(F.explode("recs").alias("r")).select("r.*")
    return deviation_dates(record), document.select(F.to_date("asof").alias("asof"), "areas", "causes")


def deviation_dates(records: DataFrame) -> DataFrame:
    """Typed deviation rows from text records."""
    return records.select(
        "id", F.to_date("opened").alias("opened"), "area", "asset", "sev", "cause", "owner",
        F.to_date("closed").alias("closed"), "capa", F.to_date("capaClosed").alias("capa_closed"),
    )


def blank_to_null(df: DataFrame) -> DataFrame:
    """Empty text becomes null in every text column."""
    text = {f.name for f in df.schema.fields if f.dataType.typeName() in ("string", "varchar", "char")}
    return df.select(*[F.nullif(F.col(c), F.lit("")).alias(c) if c in text else F.col(c) for c in df.columns])


def read_compact(spark: SparkSession, path: str, dims: tuple[str, ...], tables: tuple[str, ...] = tuple(schemas.COMPACT)) -> dict[str, DataFrame]:
    """The tables of a compact export under ``path``."""
    indexes = "".join(f", {d}_index bigint" for d in dims)
    ddl = {t: schemas.COMPACT[t] + (indexes if t == "rows" else "") for t in tables}
    return {t: spark.read.schema(ddl[t]).json(f"{path}/{t}") for t in tables}
