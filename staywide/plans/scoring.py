"""From cases to levels: one model step, or views with two steps and a cascade or a vote."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.parsing import (
    esi_cascade,
    is_json,
    parse_json_number,
    parse_json_result,
    parse_level,
    parse_true,
)
from ..functions.vocabulary import FAILED_LEVEL
from ..operators.model_batch import apply_model
from ..operators.voting import majority
from .prompts import fan_out, render_prompt


def one_step(
    cases: DataFrame, text_col: str, instruction: str, load, labelled: bool = False, **options
) -> DataFrame:
    """One call per case, and the level in its reply: `response`, `attempts`, `error`, `final_pred`.

    A failed call has a NULL response and level -1, and so has a reply without a level.
    """
    asked = render_prompt(cases, instruction, text_col)
    answered = apply_model(asked, "prompt", load, on_failure="null", **options).drop("prompt")
    level = parse_level(F.col("response"), labelled)
    failed = F.col("response").isNull()
    return answered.withColumn("final_pred", F.when(failed, FAILED_LEVEL).otherwise(level).cast("int"))


def chain(
    cases: DataFrame,
    text_col: str,
    analysis: dict[int, str],
    formats: dict[int, str],
    load_analysis,
    load_format,
    save=None,
    **options,
) -> DataFrame:
    """Every case under every view: an analysis, then a format reply on that analysis.

    A failure in either step leaves `result` NULL and its message in `error`. `save`
    may write the analyses and read them back, so that a lost executor does not cost
    the first model's calls again; it takes and returns a frame.
    """
    asked = render_prompt(fan_out(cases, analysis), F.col("instruction"), text_col)
    first = apply_model(asked, "prompt", load_analysis, on_failure="null", **options)
    first = first.drop("prompt", "instruction").withColumnsRenamed(
        {"response": "analysis", "attempts": "analysis_attempts", "error": "analysis_error"}
    )
    if save:
        first = save(first)
    format_of = F.create_map(*[F.lit(x) for pair in formats.items() for x in pair])
    second_prompt = render_prompt(first, format_of[F.col("view")], "analysis").withColumn(
        "prompt", F.when(F.col("analysis").isNotNull(), F.col("prompt"))
    )
    # The rows are spread already; the second step stays in the tasks of the first.
    options.pop("partitions", None)
    second = apply_model(
        second_prompt, "prompt", load_format, on_failure="null", **options
    )
    return second.drop("prompt").withColumnsRenamed({"response": "result"}).withColumn(
        "error", F.coalesce("analysis_error", "error")
    )


def to_cases(answers: DataFrame, keys) -> DataFrame:
    """One row per case with the answers and results of its three views.

    The keys must name one case each; `sources.files.with_case_ids` makes such an id. Cases
    that share one are refused, not merged.
    """
    view = F.col("view")
    columns = []
    for number in (1, 2, 3):
        of_view = view == number
        columns += [
            F.max(F.when(of_view, F.col("analysis"))).alias(f"llm{number}_resp"),
            F.max(F.when(of_view, F.col("result"))).alias(f"llm{number}_result"),
        ]
    lost = F.count_if(F.col("analysis").isNull() | F.col("result").isNull())
    most = F.greatest(*(F.count_if(view == number) for number in (1, 2, 3)))
    lost = F.when(most > 1, F.raise_error(F.lit("a case id stands for several cases")).cast("long")).otherwise(lost)
    return answers.groupBy(*keys).agg(*columns, lost.alias("lost_answers"))


def levels(
    df: DataFrame,
    first: str = "llm1_result",
    second: str = "llm2_result",
    third: str = "llm3_result",
    json_views: bool = False,
) -> DataFrame:
    """`final_pred` from three format replies.

    Views 1 and 2 answer with the word True, or with a JSON object when `json_views` is
    set; view 3 answers with a number. A case that lost an answer (`lost_answers`, from
    `to_cases`) fails: its level is -1.
    """
    parse = parse_json_result if json_views else parse_true
    number = F.col(third)
    level = esi_cascade(
        parse(F.col(first)),
        parse(F.col(second)),
        parse_json_number(number),
        is_json(number),
    )
    if "lost_answers" in df.columns:
        level = F.when(F.col("lost_answers") > 0, FAILED_LEVEL).otherwise(level).cast("int")
    return df.withColumn("final_pred", level)


def voting(answers: DataFrame, keys) -> DataFrame:
    """One row per case with its three results and their majority as `final_pred`.

    Takes the answers of `chain`, which saves them per batch if it is given a `save`. The
    vote is text, as the replies are. It waits for all three views: a case that lost an
    answer has a NULL vote, so that a later pass picks it up.
    """
    cases = to_cases(answers, keys)
    vote = majority(*(F.col(f"llm{number}_result") for number in (1, 2, 3)))
    return cases.withColumn("final_pred", F.when(F.col("lost_answers") == 0, vote))
