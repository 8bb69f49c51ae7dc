"""Reading the clinical tables, and small helpers for tables that are kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import schemas


def load_clinical(
    spark: SparkSession, root: str, names=None, fmt: str = "parquet", **options
) -> dict[str, DataFrame]:
    """The clinical tables under `root`, one directory or file per table.

    The schema is always given, so a scan reads only the columns a plan needs and
    never infers types.
    """
    wanted = names or schemas.CLINICAL
    return {
        name: spark.read.format(fmt)
        .options(**options)
        .schema(schemas.CLINICAL[name])
        .load(f"{root.rstrip('/')}/{name}")
        for name in wanted
    }


def clinical_from_catalog(
    spark: SparkSession, tables: dict[str, str]
) -> dict[str, DataFrame]:
    """The clinical tables from catalog names, cast to the schemas used here."""
    loaded = {}
    for name, table in tables.items():
        columns = [part.strip().split(" ") for part in schemas.CLINICAL[name].split(",")]
        loaded[name] = spark.table(table).select(
            *[F.col(column).cast(kind).alias(column) for column, kind in columns]
        )
    return loaded


def stage(df: DataFrame, name: str, table: bool = False) -> DataFrame:
    """Give a staged set a name: a session view, or a table when it must be kept."""
    if table:
        df.write.mode("overwrite").saveAsTable(name)
        return df.sparkSession.table(name)
    df.createOrReplaceTempView(name)
    return df.sparkSession.table(name)


def write_wide(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    df.write.mode(mode).parquet(path)
