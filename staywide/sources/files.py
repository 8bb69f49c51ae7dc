"""Case files, result files, checkpoints, reports and prompt templates.

Parquet is the form for large sets. CSV stands at the border; `records` cuts it into its
records, so that a large file whose records span lines is read by many tasks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DataType, IntegralType, StructType

from . import schemas
from .records import fields, records

# Stands for a quoted empty field while a file is read.
EMPTY = "\0"
# Answers span lines and hold quotes, so quotes are doubled and records may wrap. Nothing
# is trimmed. NULL is an empty field, an empty text a quoted one.
_WHITE = {"ignoreLeadingWhiteSpace": False, "ignoreTrailingWhiteSpace": False}
_READ = {"escape": '"', "quote": '"', "nullValue": "", "emptyValue": EMPTY} | _WHITE
_WRITE = {"header": True, "escape": '"', "quote": '"', "nullValue": "", "emptyValue": '""'} | _WHITE
# Whole numbers, also as they are written once their column has a gap: 3.0.
_WHOLE = r"^[ \t]*[+-]?[0-9]+(\.0*)?[ \t]*$"


def struct_of(spark: SparkSession, ddl: str) -> StructType:
    return StructType.fromDDL(ddl)


def read_value(text: Column, kind: DataType, name: str) -> Column:
    """The value of a CSV field. What is neither missing nor of the kind is an error.

    A whole number may carry a fraction of zeros; 2.7 is no whole number.
    """
    if kind.simpleString() == "string":
        return F.when(text == EMPTY, "").otherwise(text)
    bare = F.btrim(text, F.lit(" \t"))
    if isinstance(kind, IntegralType):
        value = F.when(text.rlike(_WHOLE), F.regexp_replace(bare, r"\..*$", "")).try_cast(kind)
    else:
        value = bare.try_cast(kind)
    told = F.concat(F.lit(f"{name}: no {kind.simpleString()}: "), text)
    return F.when(text.isNull() | bare.isin("", EMPTY), F.lit(None).cast(kind)).when(value.isNotNull(), value).otherwise(
        F.raise_error(told).cast(kind)
    )


def _typed(rows: DataFrame, schema: StructType, more=()) -> DataFrame:
    return rows.select(*(read_value(F.col(f.name), f.dataType, f.name).alias(f.name) for f in schema), *more)


def _parsed(spark: SparkSession, path, schema: StructType, exact: bool, run: Column | None = None) -> DataFrame:
    """The typed columns of CSV files whose first line names them.

    With `exact` a file must have these columns in this order; else they are found by name
    in every file, which may have others and any order.
    """
    heads, rows = records(spark, path)
    wanted = [f.name for f in schema]
    width = len(wanted) + 1
    if not exact:
        # A comma within a name only makes the bound larger.
        width = heads.agg(F.max(F.length("head") - F.length(F.replace("head", F.lit(","))) + 1)).first()[0] or 1
        absent = F.array_except(F.array(*map(F.lit, wanted)), fields("head", width, _READ))
        bad = heads.select("path", absent.alias("absent")).where(F.size("absent") > 0).orderBy("path").first()
        if bad:
            raise ValueError(f"{bad['path']} has no column {', '.join(bad['absent'])}")
    rows = rows.withColumn("_head", fields("head", width, _READ)).withColumn("_got", fields("record", width, _READ))
    has_text = F.col("record").isNotNull()
    if exact:
        # A file that is a head only is looked at too: the head comes as a record without text.
        told = F.concat("path", F.lit(": the header has the columns "), "head", F.lit(", not " + ", ".join(wanted)))
        fits = F.array_compact("_head") == F.array(*map(F.lit, wanted))
        rows = rows.where(F.when(fits, has_text).otherwise(F.raise_error(told).cast("boolean")))
        column = {name: F.col("_got")[i] for i, name in enumerate(wanted)}
    else:
        rows = rows.where(has_text)
        column = {name: F.element_at("_got", F.array_position("_head", name).cast("int")) for name in wanted}
    texts = rows.select(*(column[name].alias(name) for name in wanted), *([] if run is None else [run.alias("run_name")]))
    return _typed(texts, schema, [] if run is None else ["run_name"])


def read_csv(spark: SparkSession, path, ddl: str) -> DataFrame:
    """CSV with a header that must be the given schema: a file with other columns
    is refused instead of being read by position. Files are read in ranges."""
    return _parsed(spark, path, struct_of(spark, ddl), exact=True)


def write_csv(df: DataFrame, path: str, mode: str = "error") -> None:
    df.write.options(**_WRITE).mode(mode).csv(path)


def read_cases(spark: SparkSession, path, ddl: str = schemas.CASES) -> DataFrame:
    return read_csv(spark, path, ddl)


def with_case_ids(cases: DataFrame, key: str = "case_id") -> DataFrame:
    """The cases with a text id that no two rows share.

    The id is a hash of the row and its rank among equal rows, so it stays the same from
    run to run. Rows of one hash are equal but for the rank; only copies of one row meet.
    An id column that is there is kept under `given_id`.
    """
    if key in cases.columns:
        cases = cases.withColumnRenamed(key, "given_id")
    row = F.to_json(F.struct(*cases.columns), {"ignoreNullFields": "false"})
    hashed = cases.withColumn("_row", F.sha2(row, 256))
    # Copies of one row are interchangeable; they are numbered apart from all others.
    spread = hashed.groupBy("_row").agg(F.count(F.lit(1)).alias("_n"), *(F.first(c).alias(c) for c in cases.columns))
    numbered = spread.withColumn("_rank", F.explode(F.sequence(F.lit(1).cast("long"), "_n")))
    return numbered.select(F.concat_ws("-", "_row", "_rank").alias(key), *cases.columns)


def read_instructions(
    spark: SparkSession, path, ddl: str = schemas.INSTRUCTIONS, fmt: str = "csv"
) -> DataFrame:
    if fmt == "csv":
        return read_csv(spark, path, ddl)
    return spark.read.format(fmt).schema(ddl).load(path)


def run_name(model: str, run_ts: str) -> str:
    """Name of a run: last part of the model name and the time stamp."""
    return f"{model.rstrip('/').rsplit('/', 1)[-1]}_{run_ts}"


def write_results(
    df: DataFrame, base: str, model: str, run_ts: str, fmt: str = "parquet"
) -> str:
    """Write one run into the result set; the run name is a partition column.

    A run that is written again replaces its earlier rows.
    """
    name = run_name(model, run_ts)
    write_runs(df.withColumn("run_name", F.lit(name)), base, fmt)
    return name


def write_runs(df: DataFrame, base: str, fmt: str = "parquet") -> None:
    """Write rows of any number of runs, one directory per `run_name`.

    Runs in `df` replace what is there under their names; all others stay.
    """
    writer = df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("run_name")
    if fmt == "csv":
        writer = writer.options(**_WRITE)
    writer.format(fmt).save(base)


def _unescaped(name: Column) -> Column:
    return F.url_decode(F.replace(name, F.lit("+"), F.lit("%2B")))


def _run_of_folder() -> Column:
    """The value of the `run_name` directory a file lies in, else an empty text."""
    held = F.regexp_extract("path", r"/run_name=([^/]*)/[^/]*$", 1)
    # The path is escaped as an address, the name in it as a partition value.
    return _unescaped(_unescaped(held))


def read_runs(
    spark: SparkSession, path, ddl: str, fmt: str = "csv", flat: bool = False
) -> DataFrame:
    """All runs below `path` as one frame keyed by `run_name`.

    A result set written here carries the run name as partition directory. With
    `flat` the path is a glob of single files, and the file name is the run name; files
    may have further columns and any order, as in `read_flat_runs`.
    """
    if flat:
        return read_flat_runs(spark, path, ddl)
    if fmt == "csv":
        return _parsed(spark, path, struct_of(spark, ddl), exact=True, run=_run_of_folder())
    return spark.read.format(fmt).schema(f"{ddl}, run_name STRING").load(path)


def read_flat_runs(spark: SparkSession, path, ddl: str) -> DataFrame:
    """The named columns of CSV files of any layout, keyed by file name.

    The head of a file tells where its columns stand; a file without one of them is an
    error. Heads are found in one distributed job and joined to the records, so one glob
    may hold any number of files and of layouts. A file in a `run_name` directory belongs to
    that run, any other to the run of its own name.
    """
    stem = F.regexp_replace(_unescaped(F.regexp_extract("path", r"([^/]*)$", 1)), r"\.[^.]*$", "")
    held = _run_of_folder()
    run = F.when(held == "", stem).otherwise(held)
    return _parsed(spark, path, struct_of(spark, ddl), exact=False, run=run)


def write_checkpoint(df: DataFrame, path: str) -> None:
    """Append one finished batch of cases."""
    df.write.mode("append").parquet(path)


def read_checkpoint(spark: SparkSession, path: str, ddl: str) -> DataFrame:
    return spark.read.schema(ddl).parquet(path)


def write_report(metrics: DataFrame, path: str, mode: str = "overwrite") -> None:
    """One CSV file: a report has a row per run, nothing that grows with the cases."""
    write_csv(metrics.coalesce(1), path, mode)


def write_templates(templates: DataFrame, path: str) -> None:
    """Rows of name and value as text files, one directory per name."""
    templates.write.partitionBy("name").text(path)


def read_templates(spark: SparkSession, path: str) -> DataFrame:
    """Prompt templates: one row per file, with the whole file as `text`.

    `name` is the partition directory if there is one, else the file name without its
    extension. The templates stay a frame: `plans.prompts.with_template` joins them to the
    rows they are for.
    """
    found = spark.read.text(path, wholetext=True)
    stem = F.regexp_replace(F.col("_metadata.file_name"), r"\.[^.]*$", "")
    return found.select(
        F.col("name") if "name" in found.columns else stem.alias("name"),
        F.col("value").alias("text"),
        F.col("_metadata.file_size").alias("bytes"),
    )
