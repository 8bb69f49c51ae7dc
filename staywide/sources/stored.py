"""A keyed table on disk that is changed in place, bucket by bucket.

A row lies in the bucket of its keys' hash. A merge reads and writes only the buckets that
hold a changed key; the files of all others stay. Which folder holds a bucket stands in a
manifest, one small file per version, written after the data: a merge that dies leaves the
table as it was, and one version is read as a whole. One writer at a time.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

_MANIFEST = "bucket INT, folder STRING, keys ARRAY<STRING>, buckets INT, `schema` STRING, version INT"


def _bucket(keys: Sequence[str], buckets: int) -> Column:
    return F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("int")


def _commit(spark: SparkSession, path: str, rows: list[tuple], version: int) -> None:
    # A row per bucket; a single file, so its rename makes the version visible at once.
    frame = spark.createDataFrame([(*row, version) for row in rows], _MANIFEST).coalesce(1)
    frame.write.mode("append").partitionBy("version").parquet(f"{path}/manifest")


def _latest(spark: SparkSession, path: str) -> list:
    found = spark.read.schema(_MANIFEST).parquet(f"{path}/manifest")
    version = found.agg(F.max("version")).first()[0]
    return found.where(F.col("version") == version).collect()


def _write(df: DataFrame, path: str, keys: Sequence[str], buckets: int) -> str:
    """The rows in a new folder, one partition directory per bucket."""
    folder = uuid.uuid4().hex
    spread = df.withColumn("_bucket", _bucket(keys, buckets)).repartition(buckets, "_bucket")
    spread.write.partitionBy("_bucket").parquet(f"{path}/data/{folder}")
    return folder


def _folders(spark: SparkSession, path: str, folder: str) -> list[int]:
    """The buckets that a written folder holds: read from its directories, not its rows."""
    found = spark.read.schema("_bucket INT").parquet(f"{path}/data/{folder}")
    return [r[0] for r in found.select("_bucket").distinct().collect()]


def _read(spark: SparkSession, path: str, manifest: list) -> DataFrame:
    schema = StructType.fromJson(json.loads(manifest[0]["schema"]))
    held = [f"{path}/data/{m['folder']}/_bucket={m['bucket']}" for m in manifest if m["folder"]]
    if not held:
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(*held)


def buckets_for(df: DataFrame, bytes_each: int = 256 * 1024 * 1024, least: int = 8) -> int:
    """A number of buckets after the plan's own estimate of the table's size."""
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return max(least, -(-size // bytes_each))


def create(df: DataFrame, path: str, keys: Sequence[str], buckets: int = 64) -> None:
    """Store `df`. `buckets` should make a bucket a few files of ordinary size; it stays."""
    spark = df.sparkSession
    folder = _write(df, path, keys, buckets)
    full = set(_folders(spark, path, folder))
    rows = [(b, folder if b in full else None, list(keys), buckets, df.schema.json()) for b in range(buckets)]
    _commit(spark, path, rows, 1)


def read(spark: SparkSession, path: str) -> DataFrame:
    return _read(spark, path, _latest(spark, path))


def merge(spark: SparkSession, path: str, changes: DataFrame, update: bool = True, insert: bool = True) -> list[int]:
    """Apply `changes`, the keys and any of the columns; the rewritten buckets are returned.

    With `update`, rows whose keys are in `changes` take its columns, NULL too, and keep
    their others. With `insert`, keys that the table does not hold become new rows, NULL
    where `changes` has no column. NULL keys meet NULL keys. A key must be in `changes`
    once; a repeated one is an error and leaves the table as it was.
    """
    manifest = _latest(spark, path)
    keys, buckets = list(manifest[0]["keys"]), manifest[0]["buckets"]
    own = [c for c in changes.columns if c not in keys]
    twice = F.raise_error(F.concat(F.lit("repeated key: "), F.to_json(F.struct(*keys)))).cast("boolean")
    once = changes.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"), F.first(F.struct(F.lit(True).alias("_hit"), *own)).alias("_new"))
    once = once.select(*(F.col(k).alias(f"_k_{k}") for k in keys), F.when(F.col("_n") > 1, twice).otherwise(True).alias("_once"), "_new")

    # At most one row per bucket comes to the driver.
    touched = changes.select(_bucket(keys, buckets).alias("b")).distinct().collect()
    touched = sorted(r["b"] for r in touched)
    if not touched:
        return []
    parts = [m for m in manifest if m["bucket"] in set(touched)]
    old = _read(spark, path, parts).withColumn("_old", F.lit(True))
    same = [old[k].eqNullSafe(once[f"_k_{k}"]) for k in keys]
    condition = same[0]
    for more in same[1:]:
        condition = condition & more
    both = old.join(once, condition, "full" if insert else "left")
    both = both.where(F.coalesce("_once", F.lit(True)))
    taken = F.col("_new._hit") & (F.lit(update) | F.col("_old").isNull())
    columns = []
    for name in old.columns[:-1]:
        if name in keys:
            columns.append(F.when(F.col("_old").isNull(), F.col(f"_k_{name}")).otherwise(F.col(name)).alias(name))
        elif name in own:
            columns.append(F.when(taken, F.col(f"_new.{name}").cast(old.schema[name].dataType)).otherwise(F.col(name)).alias(name))
        else:
            columns.append(F.col(name))
    folder = _write(both.select(*columns), path, keys, buckets)
    full = set(_folders(spark, path, folder))
    rows = []
    for m in manifest:
        held = (folder if m["bucket"] in full else None) if m["bucket"] in set(touched) else m["folder"]
        rows.append((m["bucket"], held, keys, buckets, m["schema"]))
    _commit(spark, path, rows, manifest[0]["version"] + 1)
    return touched
