"""Prompts, requests and training texts as columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.workspace import broadcast_if_small
from ..functions import vocabulary as V

# Column names of the instruction data sets.
INSTRUCTION_COLUMNS = ("instruction", "input", "output")
QUESTION_COLUMNS = ("question", "note", "answer")


def _text(value: Column | str) -> Column:
    """A piece of a template; a missing value is written as `None`."""
    column = F.lit(value) if isinstance(value, str) else value
    return F.coalesce(column.cast("string"), F.lit("None"))


def three_section(instruction, input, output, tail: str = "") -> Column:
    """Instruction, input and response in one text.

    `tail` is what follows the response hole: nothing, or the padded ending of some runs.
    """
    return F.concat(
        F.lit(V.PROMPT_INTRO + V.PROMPT_INSTRUCTION_HEAD),
        _text(instruction),
        F.lit(V.PROMPT_INPUT_HEAD),
        _text(input),
        F.lit(V.PROMPT_RESPONSE_HEAD),
        _text(output),
        F.lit(tail),
    )


def render_prompt(
    df: DataFrame,
    instruction: Column | str,
    input_col: str,
    tail: str = V.PROMPT_PADDED_TAIL,
    name: str = "prompt",
) -> DataFrame:
    """The prompt of each row, with an empty response to be filled in."""
    return df.withColumn(name, three_section(instruction, F.col(input_col), "", tail))


def fan_out(df: DataFrame, views: dict[int, str], name: str = "view") -> DataFrame:
    """Each case once per view, with the instruction of the view.

    The views are literals in an array, so the rows multiply in place without a join.
    """
    listed = F.array(
        *[
            F.struct(F.lit(view).alias(name), F.lit(text).alias("instruction"))
            for view, text in views.items()
        ]
    )
    return df.withColumn("_v", F.explode(listed)).select(*df.columns, "_v.*")


def with_template(df: DataFrame, templates: DataFrame, key: Column, name: str = "instruction") -> DataFrame:
    """Each row with the template that `key` names; NULL where there is none.

    Templates (name, text) are a frame of any size, joined on their name.
    """
    named = templates.select(F.col("name").alias("_template"), F.col("text").alias(name))
    return df.join(broadcast_if_small(named), key == F.col("_template"), "left").drop("_template")


def format_sft(df: DataFrame, eos: str, columns=INSTRUCTION_COLUMNS) -> DataFrame:
    """Training text of each instruction row: filled template and end token."""
    instruction, input, output = (F.col(c) for c in columns)
    return df.withColumn("text", three_section(instruction, input, output, eos))


def format_cpt(df: DataFrame, text_col: str, eos: str) -> DataFrame:
    """Plain training text: the whole note and the end token."""
    return df.withColumn("text", F.concat(F.col(text_col), F.lit(eos)))


def chat_request(
    messages: Column, model: str = V.CHAT_MODEL, max_tokens: int = V.CHAT_MAX_TOKENS
) -> Column:
    """A chat request around an array of role and content pairs."""
    settings = [F.lit(value).alias(key) for key, value in V.CHAT_SETTINGS.items()]
    return F.struct(
        F.lit(model).alias("model"),
        messages.alias("messages"),
        *settings,
        F.lit(max_tokens).alias("max_tokens"),
    )


def message(role: str, content: Column | str) -> Column:
    text = F.lit(content) if isinstance(content, str) else content
    return F.struct(F.lit(role).alias("role"), text.alias("content"))


def build_chat_request(
    df: DataFrame,
    system: Column | str,
    user_col: str,
    model: str = V.CHAT_MODEL,
    max_tokens: int = V.CHAT_MAX_TOKENS,
) -> DataFrame:
    """`request`: a system and a user message with the sampling settings."""
    messages = F.array(message("system", system), message("user", F.col(user_col)))
    return df.withColumn("request", chat_request(messages, model, max_tokens))


def build_query_request(df: DataFrame, query_col: str) -> DataFrame:
    """`request`: a single query in a service envelope."""
    request = F.struct(
        F.create_map().cast("map<string,string>").alias("inputs"),
        F.col(query_col).alias("query"),
        F.lit(V.QUERY_RESPONSE_MODE).alias("response_mode"),
        F.lit("").alias("conversation_id"),
        F.lit(V.QUERY_USER).alias("user"),
    )
    return df.withColumn("request", request)


def as_json(request: Column) -> Column:
    """The payload text; NULL contents are kept as JSON null."""
    return F.to_json(request, {"ignoreNullFields": "false"})


def render_case_prompt(
    df: DataFrame, instruction: str, fields, name: str = "prompt"
) -> DataFrame:
    """Case-writing prompt: the instruction, then the named fields, one per line."""
    lines = [
        F.concat(F.lit(f"{label}: "), F.coalesce(value.cast("string"), F.lit("unknown")))
        for label, value in fields
    ]
    return df.withColumn(name, F.concat_ws("\n", F.lit(instruction), *lines))
