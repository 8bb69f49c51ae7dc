"""Attaching staged sets to a keyed table, and appending to one."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def set_flag(df: DataFrame, keys: DataFrame, key: str, column: str) -> DataFrame:
    """`column` is 1 for the rows whose key is in `keys`, else 0."""
    marked = keys.select(key).distinct().withColumn("_hit", F.lit(1))
    return (
        df.join(marked, key, "left")
        .withColumn(column, F.coalesce("_hit", F.lit(0)).cast("int"))
        .drop("_hit")
    )


def set_count(df: DataFrame, values: DataFrame, key: str, column: str) -> DataFrame:
    """`column` taken from `values`, one row per key there; 0 where there is none."""
    found = values.select(key, F.col(column).alias("_n"))
    return (
        df.join(found, key, "left")
        .withColumn(column, F.coalesce("_n", F.lit(0)))
        .drop("_n")
    )


def insert_if_absent(existing: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """`existing` plus the rows of `new` whose key it does not hold yet.

    `new` must hold each key once. A repeated key would have to lose rows, and which
    of them is for the caller to say.
    """
    return existing.unionByName(new.join(existing.select(key), key, "left_anti"))
