"""What the operators share: tables, saved intermediate results, words."""

from __future__ import annotations

from collections.abc import Callable, Iterator

from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.workspace import scratch

#: A word: a run of anything but these six ASCII white-space characters.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def saved(df: DataFrame, label: str, compression: str = "snappy") -> DataFrame:
    """The frame, written to the shared folder and read back: its lineage ends there.

    A lost executor costs only the tasks that were running on it.
    """
    spark = df.sparkSession
    path = scratch(spark, label)
    df.write.parquet(path, compression=compression)
    return spark.read.schema(df.schema).parquet(path)


def shipped(spark: SparkSession, value) -> Callable:
    """A function that gives the value in a task, anew at each call.

    A broadcast alone pickles classes by reference, and a worker would have to import them.
    Its bytes are made as functions are: by value where the package is registered so.
    """
    held = spark.sparkContext.broadcast(cloudpickle.dumps(value))
    return lambda: cloudpickle.loads(held.value)


def or_empty(text: Column) -> Column:
    return F.coalesce(text, F.lit(""))


def fresh(df: DataFrame, name: str) -> str:
    """A column name that the frame does not have yet."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def chunks(sizes: list[int], limit: int) -> Iterator[tuple[int, int]]:
    """Consecutive index ranges whose sizes sum to about `limit`, one item at least."""
    start = total = 0
    for i, n in enumerate(sizes):
        if i > start and total + n > limit:
            yield start, i
            start, total = i, 0
        total += n
    if start < len(sizes):
        yield start, len(sizes)


def in_parts(batches: Iterator, rows: int = 500) -> Iterator:
    """Series in shorter ones: what is made of their texts at a time stays small."""
    for batch in batches:
        for k in range(0, len(batch), rows):
            yield batch.iloc[k : k + rows]
