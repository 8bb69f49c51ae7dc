"""Scores of predicted levels against expert levels, for any number of runs at once.

The cases are folded into one row per run, true level and predicted level before
anything else happens. Every metric is computed from these cells.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.predicates import ratio
from ..functions.vocabulary import FAILED_LEVEL

TRUE, PREDICTED = "acuity", "final_pred"
HIGH_RISK, MODERATE, NON_URGENT = (1, 2), 3, (4, 5)

METRICS = (
    "accuracy",
    "macro_precision",
    "macro_recall",
    "macro_f1",
    "high_risk_recall",
    "moderate_f1",
    "non_urgent_precision",
    "failed_predictions",
    "over_triage_rate",
    "under_triage_rate",
    "over_triage_count",
    "under_triage_count",
)
# Column names of the report file.
REPORT_NAMES = {
    "accuracy": "Overall Accuracy",
    "macro_precision": "Macro Precision",
    "macro_recall": "Macro Recall",
    "macro_f1": "Macro F1 Score",
    "high_risk_recall": "Recall for High-Risk (ESI-1 & ESI-2)",
    "moderate_f1": "F1 for Moderate (ESI-3)",
    "non_urgent_precision": "Precision for Non-Urgent (ESI-4 & ESI-5)",
    "failed_predictions": "Failed Predictions Count",
    "over_triage_rate": "Over-Triage Rate",
    "under_triage_rate": "Under-Triage Rate",
    "over_triage_count": "Over-Triage Count",
    "under_triage_count": "Under-Triage Count",
}


def _cells(df: DataFrame, keys) -> DataFrame:
    """Rows per run, true and predicted level; `valid` when both levels can be scored."""
    failed = F.col(PREDICTED) == FAILED_LEVEL
    both = F.col(TRUE).isNotNull() & F.col(PREDICTED).isNotNull()
    return (
        df.groupBy(*keys, TRUE, PREDICTED)
        .agg(F.count("*").alias("n"))
        .withColumn("failed", F.coalesce(failed, F.lit(False)))
        .withColumn("valid", both & ~F.coalesce(failed, F.lit(False)))
    )


def _classes(cells: DataFrame, keys) -> DataFrame:
    """Hits and misses per class; the classes are those that occur on either side.

    Each valid cell is read once for its true and once for its predicted class. A cell
    that is not valid belongs to no class and only carries the totals of the run.
    """
    sides = F.when(
        F.col("valid"),
        F.array(
            F.struct(F.col(TRUE).alias("class"), F.lit(True).alias("truth")),
            F.struct(F.col(PREDICTED).alias("class"), F.lit(False).alias("truth")),
        ),
    ).otherwise(
        F.array(F.struct(F.lit(None).cast("int").alias("class"), F.lit(True).alias("truth")))
    )
    hit = F.col(TRUE) == F.col(PREDICTED)
    truth, n, valid = F.col("side.truth"), F.col("n"), F.col("valid")

    def total(condition):
        return F.sum(F.when(truth & condition, n).otherwise(0))

    def scored(condition):
        return total(valid & condition)

    true_high, pred_high = F.col(TRUE).isin(*HIGH_RISK), F.col(PREDICTED).isin(*HIGH_RISK)
    true_low, pred_low = F.col(TRUE).isin(*NON_URGENT), F.col(PREDICTED).isin(*NON_URGENT)
    return (
        cells.withColumn(TRUE, F.col(TRUE).cast("int"))
        .withColumn(PREDICTED, F.col(PREDICTED).cast("int"))
        .withColumn("side", F.explode(sides))
        .groupBy(*keys, F.col("side.class").alias("class"))
        .agg(
            scored(hit).alias("tp"),
            F.sum(F.when(valid & ~truth & ~hit, n).otherwise(0)).alias("fp"),
            scored(~hit).alias("fn"),
            scored(F.lit(True)).alias("scored"),
            total(F.col("failed")).alias("failed"),
            scored(true_high).alias("true_high"),
            scored(true_high & pred_high).alias("hit_high"),
            scored(pred_low).alias("pred_low"),
            scored(true_low & pred_low).alias("hit_low"),
            scored(F.col(PREDICTED) < F.col(TRUE)).alias("over"),
            scored(F.col(PREDICTED) > F.col(TRUE)).alias("under"),
        )
    )


def confusion(df: DataFrame, keys=()) -> DataFrame:
    """class, tp, fp, fn over the valid predictions of each run."""
    classes = _classes(_cells(df, keys), keys)
    return classes.where(F.col("class").isNotNull()).select(*keys, "class", "tp", "fp", "fn")


def _f1(precision, recall):
    return ratio(2 * precision * recall, precision + recall)


def evaluate(df: DataFrame, keys=()) -> DataFrame:
    """One row of metrics per run, or one row in all without keys.

    A row is valid when both levels are present and the prediction is not -1. Every
    ratio without a denominator is 0.
    """
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    is_class = F.col("class").isNotNull()
    precision, recall = ratio(tp, tp + fp), ratio(tp, tp + fn)

    def macro(value):
        return F.coalesce(F.avg(F.when(is_class, value)), F.lit(0.0))

    def of_moderate(column):
        hits = F.sum(F.when(F.col("class") == MODERATE, F.col(column)).otherwise(0))
        return F.coalesce(hits, F.lit(0))

    folded = (
        _classes(_cells(df, keys), keys)
        .groupBy(*keys)
        .agg(
            macro(precision).alias("macro_precision"),
            macro(recall).alias("macro_recall"),
            macro(_f1(precision, recall)).alias("macro_f1"),
            *[of_moderate(c).alias(f"mod_{c}") for c in ("tp", "fp", "fn")],
            *[
                F.coalesce(F.sum(c), F.lit(0)).alias(c)
                for c in (
                    "tp",
                    "scored",
                    "failed",
                    "true_high",
                    "hit_high",
                    "pred_low",
                    "hit_low",
                    "over",
                    "under",
                )
            ],
        )
    )
    c = F.col
    mod_precision = ratio(c("mod_tp"), c("mod_tp") + c("mod_fp"))
    mod_recall = ratio(c("mod_tp"), c("mod_tp") + c("mod_fn"))
    values = {
        "accuracy": ratio(c("tp"), c("scored")),
        "macro_precision": c("macro_precision"),
        "macro_recall": c("macro_recall"),
        "macro_f1": c("macro_f1"),
        "high_risk_recall": ratio(c("hit_high"), c("true_high")),
        "moderate_f1": _f1(mod_precision, mod_recall),
        "non_urgent_precision": ratio(c("hit_low"), c("pred_low")),
        "failed_predictions": c("failed"),
        "over_triage_rate": ratio(c("over"), c("scored")),
        "under_triage_rate": ratio(c("under"), c("scored")),
        "over_triage_count": c("over"),
        "under_triage_count": c("under"),
    }
    return folded.select(*keys, *[values[m].alias(m) for m in METRICS])


def report(metrics: DataFrame) -> DataFrame:
    """The metrics under the column names of the report file."""
    return metrics.withColumnsRenamed(REPORT_NAMES)
