"""Majority vote over the answers of one case."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def majority_of_three(first: Column, second: Column, third: Column) -> Column:
    """The most frequent answer that is there; the first one wins a tie."""
    return F.coalesce(F.when(second == third, second), first, second, third)


def majority(*answers: Column) -> Column:
    """The same for any number of voters, within the row.

    Each answer is ranked by how often it occurs and then by how early it does.
    """
    if len(answers) == 3:
        return majority_of_three(*answers)
    cast = F.array_compact(F.array(*answers))
    ranked = F.transform(
        cast,
        lambda answer, position: F.struct(
            F.size(F.filter(cast, lambda other: other == answer)).alias("votes"),
            (-position).alias("early"),
            answer.alias("answer"),
        ),
    )
    return F.array_max(ranked)["answer"]


def majority_rows(
    answers: DataFrame, keys: Sequence[str], answer: str = "answer", position: str = "position", name: str = "final_pred"
) -> DataFrame:
    """(keys, `name`): the vote over rows of one answer each, any number of voters.

    The most frequent answer wins, of several the one with the smallest position, then the
    smallest answer. A NULL answer is no vote; a case of NULL answers only has a NULL vote,
    and rows with NULL keys are a case as well. Both steps combine before they shuffle, so
    a case with very many voters costs a row per distinct answer and task.
    """
    counted = answers.groupBy(*keys, F.col(answer).alias("_answer")).agg(
        F.count(answer).alias("_votes"), F.min(position).alias("_early")
    )
    order = F.struct(-F.col("_votes"), "_early", "_answer")
    return counted.groupBy(*keys).agg(F.min_by("_answer", order).alias(name))
