"""The wide stay table and its quality totals."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from ..functions.predicates import any_positive, zero_if_null
from ..sources.clinical import write_wide
from .features import FEATURES, ICU_WITHIN_HOUR, counts_of, with_counts
from .resources import RESOURCES, ROUTE_COLUMNS, WithRoutes, count_columns

STAY_COLUMNS = (
    "subject_id",
    "stay_id",
    "hadm_id",
    "intime",
    "outtime",
    "gender",
    "race",
    "arrival_transport",
    "disposition",
)
TRIAGE_COLUMNS = (
    "temperature",
    "heartrate",
    "resprate",
    "o2sat",
    "sbp",
    "dbp",
    "pain",
    "acuity",
    "chiefcomplaint",
)
FLAG_COLUMNS = tuple(f.column for f in FEATURES)
COUNT_COLUMNS = tuple(RESOURCES)


def base_stays(clinical) -> DataFrame:
    """Every stay with its triage record, if it has one."""
    return (
        clinical["edstays"]
        .join(clinical["triage"], ["subject_id", "stay_id"], "left")
        .select(*STAY_COLUMNS, *TRIAGE_COLUMNS)
    )


def wide_table(clinical, with_icu_within_hour: bool = False) -> DataFrame:
    """One row per stay: 18 base columns, 21 flags and 10 counts.

    All flags and counts come out of one aggregation by stay, so the base table is
    joined once instead of once per column.
    """
    features = [*FEATURES, ICU_WITHIN_HOUR] if with_icu_within_hour else list(FEATURES)
    counts = [*counts_of(features), *RESOURCES.values()]
    counted = with_counts(base_stays(clinical), WithRoutes(clinical), counts)
    return counted.selectExpr(
        *STAY_COLUMNS,
        *TRIAGE_COLUMNS,
        *[f.value() for f in features],
        *count_columns(RESOURCES),
    )


def feature_totals(wide: DataFrame) -> DataFrame:
    """feature, total: number of flagged stays, all columns in one pass."""
    totals = wide.agg(*[F.expr(f"sum({c}) AS {c}") for c in FLAG_COLUMNS])
    return totals.unpivot([], list(FLAG_COLUMNS), "feature", "total").select(
        "feature", zero_if_null(F.col("total")).alias("total")
    )


def _positive_measures() -> dict:
    """resource -> condition: every count of its own, and any drug route."""
    singles = [c for c in COUNT_COLUMNS if c not in ROUTE_COLUMNS]
    measured = {c: F.col(c) > 0 for c in singles}
    measured["drug_routes"] = any_positive(*[F.col(c) for c in ROUTE_COLUMNS])
    return measured


def positive_counts(wide: DataFrame) -> DataFrame:
    """resource, stays: stays with a positive count, and with any drug route."""
    measured = _positive_measures()
    totals = wide.agg(*[F.count_if(v).alias(k) for k, v in measured.items()])
    return totals.unpivot([], list(measured), "resource", "stays")


def write_with_totals(wide: DataFrame, path: str) -> DataFrame:
    """Write the wide table; kind (feature or resource), name, total, taken while it is written.

    The totals are metrics of the write itself, so the table is neither computed nor read again.
    """
    seen = Observation()
    flags = [F.coalesce(F.sum(c), F.lit(0)).cast("long").alias(f"feature.{c}") for c in FLAG_COLUMNS]
    counts = [F.count_if(v).alias(f"resource.{k}") for k, v in _positive_measures().items()]
    write_wide(wide.observe(seen, *flags, *counts), path)
    rows = [(*name.split(".", 1), total) for name, total in seen.get.items()]
    return wide.sparkSession.createDataFrame(rows, "kind string, name string, total long")
