"""Records of CSV files that span lines, read in byte ranges.

Whether a line begins a record depends on all quotes before it. Spark's text source cuts
files into ranges of lines; a range only has to know how many lines with an odd number of
quotes stand before it in its file, which is one small row per range and a running sum.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .workspace import broadcast_if_small, scratch

_RANGE = ["path", "start", "length"]


def _lines(spark: SparkSession, path) -> DataFrame:
    """(path, start, length, id, line, odd): `id` orders the lines of a range."""
    found = spark.read.schema("value STRING").option("lineSep", "\n").text(path)
    quotes = F.length("value") - F.length(F.replace("value", F.lit('"')))
    return found.select(
        F.col("_metadata.file_path").alias("path"),
        F.col("_metadata.file_block_start").alias("start"),
        F.col("_metadata.file_block_length").alias("length"),
        F.monotonically_increasing_id().alias("id"),
        F.col("value").alias("line"),
        (quotes % 2).alias("odd"),
    )


def _bare(text: Column) -> Column:
    """Without the carriage return of a line end."""
    return F.regexp_replace(text, r"\r$", "")


def ranges(spark: SparkSession, path) -> DataFrame:
    """(path, start, length, before, head): a row per range of a file.

    `before` counts the lines with an odd number of quotes in earlier ranges of the file,
    `head` is the first line of the first range, else null. Written once: a range is a part
    of a file as large as a task reads, so these rows are few.
    """
    per = _lines(spark, path).groupBy(*_RANGE).agg(
        F.sum("odd").alias("n"), F.min_by("line", "id").alias("first"), F.min_by("odd", "id").alias("open")
    )
    spans = F.raise_error(F.concat(F.lit("the head spans lines: "), "path")).cast("string")
    earlier = Window.partitionBy("path").orderBy("start").rowsBetween(Window.unboundedPreceding, -1)
    found = per.select(
        *_RANGE,
        F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("before"),
        F.row_number().over(Window.partitionBy("path").orderBy("start")).alias("place"),
        "first",
        "open",
    )
    head = F.when(F.col("place") == 1, F.when(F.col("open") == 1, spans).otherwise(_bare(F.col("first"))))
    found = found.select(*_RANGE, "before", head.alias("head"))
    place = scratch(spark, "csv-ranges")
    found.write.parquet(place)
    return spark.read.schema(found.schema).parquet(place)


def records(spark: SparkSession, path) -> tuple[DataFrame, DataFrame]:
    """(path, head) of every file, and (path, head, record) of every record behind the heads.

    A file also has one row with a null record, which stands for its head. Empty lines
    between records are skipped. A head is one line. Line breaks within quotes stay as they
    are; the order of the records does not. A quote that is never closed takes the rest of
    its file into one record, as any CSV reader does.
    """
    known = ranges(spark, path)
    heads = known.where(F.col("head").isNotNull()).select("path", "head")
    # The ranges of both reads must be the same: a range that was not counted is an error.
    lines = _lines(spark, path).join(broadcast_if_small(known.drop("head")), _RANGE, "left")
    lost = F.raise_error(F.concat(F.lit("the file changed or was cut in other ranges: "), "path")).cast("long")
    within = Window.partitionBy(*_RANGE).orderBy("id")
    lines = lines.select(
        *_RANGE,
        "id",
        "line",
        "odd",
        (F.coalesce("before", lost) + F.sum("odd").over(within) - F.col("odd")).alias("toggles"),
        (F.row_number().over(within) == 1).alias("leads"),
    )
    # The first line of a file is its head, the first of any other range is not.
    first = known.where(F.col("head").isNotNull()).select(*_RANGE, F.lit(True).alias("top"))
    lines = lines.join(broadcast_if_small(first), _RANGE, "left")
    lines = lines.withColumn("is_head", F.col("leads") & F.coalesce("top", F.lit(False)))

    # A line without an open quote before or behind it is a record of its own. The others
    # come in runs from one odd line to the next, and only these runs are gathered.
    alone = (F.col("toggles") % 2 == 0) & (F.col("odd") == 0)
    single = lines.where(alone).select("path", F.when(~F.col("is_head"), _bare(F.col("line"))).alias("record"))
    run = lines.where(~alone).groupBy("path", F.floor(F.col("toggles") / 2).alias("run")).agg(
        F.array_sort(F.collect_list(F.struct("start", "id", "line"))).alias("m")
    )
    text = F.array_join(F.transform("m", lambda part: part["line"]), "\n")
    found = single.unionByName(run.select("path", _bare(text).alias("record")))
    found = found.where(F.col("record").isNull() | (F.col("record") != ""))
    return heads, found.join(broadcast_if_small(heads), "path")


def fields(record: str, width: int, options: dict) -> Column:
    """The first `width` fields of a record as texts, null behind its end."""
    schema = ", ".join(f"f{i} STRING" for i in range(width))
    parsed = F.from_csv(F.col(record), F.lit(schema), {k: str(v).lower() if isinstance(v, bool) else v for k, v in options.items()})
    return F.array(*(parsed[f"f{i}"] for i in range(width)))
