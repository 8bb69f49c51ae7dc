"""Applying a model to a column of prompts, with retries.

This is the only operator that runs Python code. The model is any callable, made once
per partition by `load`. It gets a list of prompts and the number of the attempt, and
returns one reply per prompt; a reply that is an exception stands for a failed row.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

MAX_ATTEMPTS = 5
FAILED_LEVEL = -1


def growing_wait(attempt: int) -> float:
    """Seconds to wait after the given failed attempt: 30, 60, 90, 120."""
    return 30.0 * attempt


def fixed_wait(attempt: int) -> float:
    return 5.0


def no_wait(attempt: int) -> float:
    return 0.0


def _call(model, prompts: list[str], attempt: int) -> list:
    """Replies or exceptions, one per prompt.

    If the model raises for several prompts at once they are tried one by one, so a bad
    row cannot fail its neighbours.
    """
    try:
        replies = list(model(prompts, attempt))
        if len(replies) != len(prompts):
            raise ValueError(f"{len(replies)} replies for {len(prompts)} prompts")
        return replies
    except Exception as problem:
        if len(prompts) == 1:
            return [problem]
        return [_call(model, [prompt], attempt)[0] for prompt in prompts]


def _answer(model, prompts, max_attempts, wait, batch_size):
    """(response, attempts, error) per prompt.

    The model gets slices of `batch_size`; all failed rows are tried again together, after
    one wait per attempt.
    """
    responses = [None] * len(prompts)
    attempts = [0] * len(prompts)
    errors = [None] * len(prompts)
    open_rows = [i for i, prompt in enumerate(prompts) if prompt is not None]
    for attempt in range(1, max_attempts + 1):
        if not open_rows:
            break
        failed = []
        for start in range(0, len(open_rows), batch_size):
            part = open_rows[start : start + batch_size]
            for i, reply in zip(part, _call(model, [prompts[i] for i in part], attempt)):
                attempts[i] = attempt
                if isinstance(reply, Exception):
                    errors[i] = f"{type(reply).__name__}: {reply}"
                    failed.append(i)
                else:
                    responses[i], errors[i] = reply, None
        open_rows = failed
        if open_rows and attempt < max_attempts:
            time.sleep(wait(attempt))
    return responses, attempts, errors


def apply_model(
    df: DataFrame,
    prompt_col: str,
    load: Callable[[], Callable[[list[str], int], list]],
    max_attempts: int = MAX_ATTEMPTS,
    wait: Callable[[int], float] = growing_wait,
    on_failure: str = "sentinel",
    batch_size: int = 32,
    partitions: int | None = None,
) -> DataFrame:
    """`df` with `response`, `attempts`, `error` and `final_pred`.

    A row whose attempts are used up keeps a NULL response and the last error.
    `on_failure` is "sentinel", which marks it -1 in `final_pred`, or "null", which adds
    no such column, so that a later pass can pick the row up. A NULL prompt is not sent.

    Model calls cost far more than a shuffle of their prompts: `partitions` spreads the
    rows evenly when the input files do not.
    """
    if on_failure not in ("sentinel", "null"):
        raise ValueError(on_failure)
    taken = {"response", "attempts", "error", "final_pred"} & set(df.columns)
    if taken:
        raise ValueError(f"the input already has the columns {sorted(taken)}")
    reply = T.StructType(
        [
            T.StructField("response", T.StringType()),
            T.StructField("attempts", T.IntegerType()),
            T.StructField("error", T.StringType()),
        ]
    )

    # Only the prompt enters Python; a model call must not be repeated by the optimizer.
    @F.pandas_udf(reply)
    def answer(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        model = load()
        for batch in batches:
            prompts = batch.astype(object).where(batch.notna(), None).tolist()
            responses, attempts, errors = _answer(model, prompts, max_attempts, wait, batch_size)
            yield pd.DataFrame(
                {
                    "response": pd.Series(responses, dtype=object),
                    "attempts": pd.Series(attempts, dtype="int32"),
                    "error": pd.Series(errors, dtype=object),
                }
            )

    source = df if partitions is None else df.repartition(partitions)
    answered = source.withColumn("_reply", answer.asNondeterministic()(F.col(prompt_col)))
    answered = answered.select(*df.columns, "_reply.response", "_reply.attempts", "_reply.error")
    if on_failure == "null":
        return answered
    return answered.withColumn(
        "final_pred", F.when(F.col("response").isNull(), FAILED_LEVEL).cast("int")
    )


def _written(spark: SparkSession, path: str) -> bool:
    """Whether a folder was written to its end."""
    mark = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    return mark.getFileSystem(spark._jsc.hadoopConfiguration()).exists(mark)


def apply_model_in_waves(
    df: DataFrame,
    prompt_col: str,
    load: Callable[[], Callable[[list[str], int], list]],
    path: str,
    max_attempts: int = MAX_ATTEMPTS,
    wait: Callable[[int], float] = growing_wait,
    on_failure: str = "sentinel",
    batch_size: int = 32,
    partitions: int | None = None,
) -> DataFrame:
    """As `apply_model`, but no task waits: every attempt is a job over the open rows.

    The first wave asks for all rows, each later one for those that failed in the wave
    before; between two waves the driver waits and no core is held. A wave is written below
    `path`, a folder all executors share, and a run that was killed goes on behind its last
    whole wave when it is started again with the same folder, so no answered row is asked
    twice. The rows of `df` are read in the first wave only.
    """
    if on_failure not in ("sentinel", "null"):
        raise ValueError(on_failure)
    spark = df.sparkSession
    added = ("response", "attempts", "error")
    kinds = T.StructType([*df.schema.fields, T.StructField("response", T.StringType()), T.StructField("attempts", T.IntegerType()), T.StructField("error", T.StringType())])
    open_rows, waves = df, []
    for attempt in range(1, max_attempts + 1):
        folder = f"{path}/wave-{attempt}"
        if not _written(spark, folder):
            if attempt > 1:
                time.sleep(wait(attempt - 1))

            def load_for(attempt=attempt):
                model = load()
                return lambda prompts, _: model(prompts, attempt)

            asked = apply_model(
                open_rows, prompt_col, load_for, max_attempts=1, on_failure="null", batch_size=batch_size, partitions=partitions
            )
            tried = F.when(F.col("attempts") > 0, F.lit(attempt)).otherwise(F.col("attempts")).cast("int")
            asked.withColumn("attempts", tried).write.mode("overwrite").parquet(folder)
        done = spark.read.schema(kinds).parquet(folder)
        last = attempt == max_attempts
        waves.append(done if last else done.where(F.col("error").isNull()))
        failed = done.where(F.col("error").isNotNull())
        if last or failed.isEmpty():
            break
        open_rows = failed.drop(*added)
    answered = waves[0]
    for wave in waves[1:]:
        answered = answered.unionByName(wave)
    if on_failure == "null":
        return answered
    return answered.withColumn(
        "final_pred", F.when(F.col("response").isNull(), FAILED_LEVEL).cast("int")
    )


def pending(cases: DataFrame, done: DataFrame, key: str = "case_id") -> DataFrame:
    """The cases that have no answer yet in the checkpoint."""
    answered = done.where(F.col("response").isNotNull()).select(key)
    return cases.join(answered, key, "left_anti")


def resume(previous: DataFrame, model_pass: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Answer the rows without a response again and keep the others as they are.

    `model_pass` takes rows without answer columns and returns them answered.
    """
    added = ("response", "attempts", "error")
    kept = previous.where(F.col("response").isNotNull())
    again = previous.where(F.col("response").isNull()).drop(*added)
    return kept.unionByName(model_pass(again).select(*previous.columns))
