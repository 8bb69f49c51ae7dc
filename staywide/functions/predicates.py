"""Conditions and column expressions shared by the features, counts and scores.

Conditions on the raw tables are SQL text over a column name, the rest are columns. All
of them are built-in Spark expressions: they stay inside code generation and never
cross into Python.
"""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import vocabulary as V


def any_of(conditions) -> Column:
    return reduce(or_, conditions)


def text_list(values) -> str:
    """SQL string literals, separated by commas."""
    return ", ".join("'" + value.replace("'", "''") + "'" for value in values)


def one_of(column: str, values) -> str:
    return f"{column} IN ({text_list(values)})"


def contains_any(column: str, words) -> str:
    """SQL condition: case-blind "contains one of"."""
    tests = [f"contains(lower({column}), {text_list([w.lower()])})" for w in words]
    return "(" + " OR ".join(tests) + ")"


def equals_any(column: str, values) -> str:
    """SQL condition: case-blind "is one of"."""
    return one_of(f"lower({column})", [value.lower() for value in values])


def is_tier1(name: str = "name") -> str:
    return contains_any(name, V.TIER1_CONTAINS)


def is_tier2(name: str = "name") -> str:
    contains, equals = contains_any(name, V.TIER2_CONTAINS), equals_any(name, V.TIER2_EQUALS)
    return f"({contains} OR {equals})"


def is_tier3(name: str = "name") -> str:
    return contains_any(name, V.TIER3_CONTAINS)


def is_tier4(name: str = "name") -> str:
    return contains_any(name, V.TIER4_CONTAINS)


def is_psychotropic(name: str = "name") -> str:
    pairs = [
        f"({contains_any(name, [drug])} AND {contains_any(name, [form])})"
        for drug, form in V.PSYCHOTROPIC_PAIRS
    ]
    return "(" + " OR ".join(pairs) + ")"


def age_at(when: Column, anchor_age: Column, anchor_year: Column) -> Column:
    """Age in the calendar year of `when`, counted from an anchor year."""
    return anchor_age + (F.year(when) - anchor_year)


def day_between(value: Column, first: Column, last: Column) -> Column:
    """Calendar-day comparison, both ends included."""
    return F.to_date(value).between(F.to_date(first), F.to_date(last))


def zero_if_null(value: Column) -> Column:
    return F.coalesce(value, F.lit(0))


def any_positive(*counts: Column) -> Column:
    return any_of([count > 0 for count in counts])


def flag(condition: Column) -> Column:
    """A condition as 0/1; an unknown condition is 0."""
    return F.when(condition, 1).otherwise(0).cast("int")


def ratio(part: Column, whole: Column) -> Column:
    """`part / whole`, and 0.0 when there is nothing to divide by."""
    return F.when(whole > 0, part / whole).otherwise(F.lit(0.0))


def ensure_columns(df: DataFrame, types: dict[str, str]) -> DataFrame:
    """Add the missing columns as typed NULLs and leave the present ones alone."""
    missing = {
        name: F.lit(None).cast(kind)
        for name, kind in types.items()
        if name not in df.columns
    }
    return df.withColumns(missing) if missing else df


def with_default(df: DataFrame, name: str, default, replace: bool = False) -> DataFrame:
    """Add a constant column unless it is there; `replace` drops the old one first."""
    if replace:
        df = df.drop(name)
    return df if name in df.columns else df.withColumn(name, F.lit(default))
