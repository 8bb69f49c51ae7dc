"""Scoring case files as they arrive, each once.

The long loop that saves its table after every case becomes a file stream: finished
files are recorded in the checkpoint, and a run that stops goes on where it was.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession


def score_new_files(
    spark: SparkSession,
    source: str,
    ddl: str,
    target: str,
    checkpoint: str,
    model_pass: Callable[[DataFrame], DataFrame],
    fmt: str = "parquet",
    files_per_batch: int = 64,
    **options,
) -> None:
    """Answer every case file under `source` that no earlier call has answered.

    Both folders must be shared by all executors. The file sink and the checkpoint
    together write each batch exactly once, also after a failure.
    """
    cases = (
        spark.readStream.format(fmt)
        .schema(ddl)
        .options(**options)
        .option("maxFilesPerTrigger", files_per_batch)
        .load(source)
    )
    query = (
        model_pass(cases)
        .writeStream.format("parquet")
        .option("path", target)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .outputMode("append")
        .start()
    )
    query.awaitTermination()
