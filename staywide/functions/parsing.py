"""Reading levels, booleans and numbers out of model answers.

The parsers are Catalyst expressions over whole answers. A parser that can fail
returns NULL for a failed answer, so the caller decides what a failure means.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import vocabulary as V
from .predicates import any_of

# The JSON grammar of a number; a plain cast would also take "1d", "+1" or ".5".
_JSON_NUMBER = r"^[ \t\r\n]*-?(0|[1-9][0-9]*)(\.[0-9]+)?([eE][+-]?[0-9]+)?[ \t\r\n]*$"


def last_level(answer: Column) -> Column:
    """The last digit 1-5 of the answer, else -1.

    What follows the last occurrence of a digit is shortest for the digit that comes
    last. These are plain byte searches from the end of the text, without a regular
    expression; a digit that does not occur leaves the whole text.
    """
    ranked = F.least(
        *[
            F.octet_length(F.substring_index(answer, str(digit), -1)).cast("long") * 10 + digit
            for digit in range(1, 6)
        ]
    )
    found = ranked < F.octet_length(answer).cast("long") * 10
    return F.when(found, (ranked % 10).cast("int")).otherwise(V.FAILED_LEVEL)


def _level_after(answer: Column, label: str) -> Column:
    rest = F.substring_index(F.lower(answer), label, -1)
    first = F.regexp_extract(rest, r"^[\s\p{Z}]*([^\s\p{Z}])", 1)
    return F.when(first.rlike("^[1-5]$"), first.cast("int")).otherwise(V.FAILED_LEVEL)


def labelled_level(answer: Column) -> Column:
    """The level after the last label; the last digit only when no label occurs."""
    level = last_level(answer)
    for label in reversed(V.LEVEL_LABELS):
        level = F.when(
            F.lower(answer).contains(label), _level_after(answer, label)
        ).otherwise(level)
    return level


def parse_level(answer: Column, labelled: bool = False) -> Column:
    return labelled_level(answer) if labelled else last_level(answer)


def parse_true(answer: Column) -> Column:
    """Only the exact string `True` is true; everything else, NULL included, is false."""
    return F.coalesce(answer == "True", F.lit(False))


def _json_value(answer: Column) -> Column:
    """The answer as a variant, NULL unless the whole of it is one JSON value.

    The parser ignores what follows a value. Inside an array and inside an object
    nothing but a single value is valid in both.
    """
    in_array = F.try_parse_json(F.concat(F.lit("["), answer, F.lit("]")))
    in_object = F.try_parse_json(F.concat(F.lit('{"v":'), answer, F.lit("}")))
    return F.when(in_array.isNotNull(), F.try_variant_get(in_object, "$.v", "variant"))


def is_json(answer: Column) -> Column:
    return _json_value(answer).isNotNull()


def parse_json_result(answer: Column) -> Column:
    """`{"result": true}` -> true. NULL when the text or the key is missing or broken.

    A result that is present but is not the boolean true counts as false.
    """
    result = F.try_variant_get(_json_value(answer), "$.result", "variant")
    is_true = (F.schema_of_variant(result) == "BOOLEAN") & F.coalesce(
        F.try_variant_get(result, "$", "boolean"), F.lit(False)
    )
    return F.when(result.isNotNull(), is_true)


def parse_json_number(answer: Column) -> Column:
    """A JSON number, or true/false as 1/0; NULL for anything else."""
    bare = F.btrim(answer, F.lit(" \t\r\n"))
    return (
        F.when(answer.rlike(_JSON_NUMBER), bare.try_cast("double"))
        .when(bare == "true", F.lit(1.0))
        .when(bare == "false", F.lit(0.0))
    )


def esi_cascade(
    immediate: Column,
    high_risk: Column,
    resources: Column,
    parsed: Column | None = None,
) -> Column:
    """Level 1-5 from the three answers, -1 when one of them failed to parse.

    `parsed` tells whether the resource answer could be read at all. By default
    that is the same as having a number. With it, an answer that was readable but
    no number fails only when the first two views do not decide.
    """
    readable = resources.isNotNull() if parsed is None else parsed
    failed = any_of([immediate.isNull(), high_risk.isNull(), ~F.coalesce(readable, F.lit(False))])
    return (
        F.when(failed, V.FAILED_LEVEL)
        .when(immediate, 1)
        .when(high_risk, 2)
        .when(resources.isNull(), V.FAILED_LEVEL)
        .when(resources > 1, 3)
        .when(resources == 1, 4)
        .otherwise(5)
        .cast("int")
    )


def extract_case(answer: Column) -> Column:
    """The text after the last case heading, without surrounding white space."""
    body = F.substring_index(answer, V.CASE_HEADING, -1)
    return F.btrim(body, F.lit(" \t\n\v\f\r"))


def chat_reply(payload: Column) -> Column:
    return F.get_json_object(payload, "$.choices[0].message.content")


def query_reply(payload: Column) -> Column:
    return F.get_json_object(payload, "$.answer")
