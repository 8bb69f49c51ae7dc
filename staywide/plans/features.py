"""Intervention flags of a stay, as rows of a table.

A feature names what it needs: how many events of which kind in which span of the
stay, or a condition on the stay itself. `feature` evaluates one of them, `wide`
evaluates all of them in one fused plan.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import predicates as P
from ..functions import vocabulary as V
from ..operators import spans as S
from ..operators.spans import EventSource, Measure, SpanCount, count_in_spans

SUBJECT = ("subject_id",)
ADMISSION = ("subject_id", "hadm_id")
STAY = ("stay_id",)
SUBJECT_STAY = ("subject_id", "stay_id")


@dataclass(frozen=True)
class Feature:
    """A 0/1 column: every count in `needs` must exceed its bound.

    A feature without counts is a SQL condition on the stay, `on_stay`.
    """

    column: str
    needs: tuple[tuple[SpanCount, int], ...] = ()
    on_stay: str | None = None

    def value(self) -> str:
        """The flag as SQL over a stay row that carries its counts."""
        met = self.on_stay or " AND ".join(
            f"coalesce(`{count.name}`, 0) > {bound}" for count, bound in self.needs
        )
        return f"CASE WHEN {met} THEN 1 ELSE 0 END AS {self.column}"


VENTILATOR = Measure(
    "ventilator", "poe", P.one_of("order_subtype", [V.VENTILATOR_ORDER])
)
NON_INVASIVE = Measure(
    "non_invasive", "poe", P.one_of("order_subtype", V.NON_INVASIVE_ORDERS)
)
EARLY_TRANSFUSION = Measure(
    "early_transfusion", "poe", P.one_of("order_subtype", V.EARLY_TRANSFUSION_ORDERS)
)
LATE_TRANSFUSION = Measure(
    "late_transfusion", "poe", P.one_of("order_subtype", V.LATE_TRANSFUSION_ORDERS)
)
# The rule counts order ids, so an order without an id does not count.
RED_CELLS = Measure(
    "red_cells",
    "poe",
    P.one_of("order_subtype", [V.RED_CELL_ORDER]) + " AND poe_id IS NOT NULL",
)
SURGERY_MOVE = Measure("surgery_move", "transfers", P.one_of("careunit", V.SURGERY_UNITS))
ICU_MOVE = Measure("icu_move", "transfers", P.one_of("careunit", V.ICU_UNITS))
ANY_PROCEDURE = Measure("any_procedure", "procedures_icd", "TRUE")
INTRAOSSEOUS = Measure(
    "intraosseous", "procedures_icd", P.one_of("icd_code", V.INTRAOSSEOUS_CODES)
)
CRITICAL = Measure(
    "critical", "procedures_icd", P.one_of("icd_code", V.CRITICAL_PROCEDURE_CODES)
)
TIER1 = Measure("tier1", "pyxis", P.is_tier1())
TIER2 = Measure("tier2", "pyxis", P.is_tier2())
TIER3 = Measure("tier3", "pyxis", P.is_tier3())
TIER4 = Measure("tier4", "pyxis", P.is_tier4())
PSYCHOTROPIC = Measure("psychotropic", "pyxis", P.is_psychotropic())
KNOWN_PATIENT = Measure("known_patient", "patients", "TRUE")


def _count(measure: Measure, keys, span) -> SpanCount:
    level = "_".join(keys).replace("_id", "")
    return SpanCount(
        f"n_{measure.name}__{level}__{span.name if span else 'ever'}", measure, keys, span
    )


def _events(column: str, measure: Measure, keys, span, more_than: int = 0) -> Feature:
    return Feature(column, ((_count(measure, keys, span), more_than),))


def _surgery(column: str, move_span, procedure_span) -> Feature:
    """A move to a surgery unit and any procedure of the same admission.

    The two conditions are independent, so each is counted on its own and the product
    of moves and procedures is never built.
    """
    return Feature(
        column,
        (
            (_count(SURGERY_MOVE, ADMISSION, move_span), 0),
            (_count(ANY_PROCEDURE, ADMISSION, procedure_span), 0),
        ),
    )


_LATE = "outtime > intime + INTERVAL '1' HOUR"
_TRANSFERRED = f"disposition = '{V.TRANSFER_DISPOSITION}'"
_EXPIRED = f"disposition = '{V.EXPIRED_DISPOSITION}'"

# The columns of the wide table, in their order there.
FEATURES = (
    _events("invasive_ventilation", VENTILATOR, SUBJECT, S.FIRST_HOUR),
    _events(
        "invasive_ventilation_beyond_1h", VENTILATOR, SUBJECT, S.AFTER_HOUR_IN_STAY
    ),
    _events("non_invasive_ventilation", NON_INVASIVE, SUBJECT, S.IN_STAY),
    _surgery("transfer2surgeryin1h", S.FIRST_HOUR_SAME_DAYS, S.STAY_DAYS),
    _surgery("transfer_to_surgery_beyond_1h", S.PAST_HOUR, S.IN_STAY),
    _events("transfer_to_ICU_beyond_1h", ICU_MOVE, ADMISSION, S.PAST_HOUR_IN_STAY),
    Feature(
        "transfer_within_1h",
        on_stay=f"{_TRANSFERRED} AND outtime BETWEEN intime AND {S.HOUR_LATER}",
    ),
    Feature("transfer_beyond_1h", on_stay=f"{_TRANSFERRED} AND {_LATE}"),
    Feature("expired_within_1h", on_stay=f"{_EXPIRED} AND outtime <= {S.HOUR_LATER}"),
    Feature("expired_beyond_1h", on_stay=f"{_EXPIRED} AND {_LATE}"),
    _events("tier1_med_usage_1h", TIER1, STAY, S.FIRST_HOUR),
    _events("tier1_med_usage_beyond_1h", TIER1, STAY, S.AFTER_HOUR_IN_STAY),
    _events("tier2_med_usage", TIER2, STAY, None),
    _events("tier3_med_usage", TIER3, STAY, None),
    _events("tier4_med_usage", TIER4, STAY, None),
    Feature(
        "psychotropic_med_within_120min",
        (
            (_count(PSYCHOTROPIC, SUBJECT_STAY, S.FIRST_TWO_HOURS), 0),
            (_count(KNOWN_PATIENT, SUBJECT, None), 0),
        ),
    ),
    _events("transfusion_within_1h", EARLY_TRANSFUSION, SUBJECT, S.FIRST_HOUR),
    _events("transfusion_beyond_1h", LATE_TRANSFUSION, SUBJECT, S.WEEK_AFTER_HOUR),
    _events(
        "red_cell_order_more_than_1", RED_CELLS, ADMISSION, S.WEEK_AFTER_HOUR, more_than=1
    ),
    _events("intraosseous_line_placed", INTRAOSSEOUS, SUBJECT, S.WEEK),
    _events("critical_procedure", CRITICAL, SUBJECT, S.STAY_DAYS_PLUS_ONE),
)

# Staged on its own; the wide table carries it only on request.
ICU_WITHIN_HOUR = _events("icu_within_1h", ICU_MOVE, ADMISSION, S.FIRST_HOUR_SAME_DAYS)

# Second definitions of five features, with other spans.
VARIANTS = (
    _events("non_invasive_ventilation", NON_INVASIVE, SUBJECT, None),
    _surgery("transfer_to_surgery_beyond_1h", S.PAST_HOUR_SAME_DAYS, S.STAY_DAYS),
    _events("transfer_to_ICU_beyond_1h", ICU_MOVE, ADMISSION, S.PAST_HOUR_SAME_DAYS),
    _events("red_cell_order_more_than_1", RED_CELLS, ADMISSION, S.WEEK, more_than=1),
    _events("critical_procedure", CRITICAL, SUBJECT, S.WEEK),
)

# When the events of a table happen.
EVENT_TIME = {
    "poe": "ordertime",
    "transfers": "intime",
    "procedures_icd": "CAST(chartdate AS TIMESTAMP_NTZ)",
    "pyxis": "charttime",
    "labevents": "charttime",
    "microbiologyevents": "charttime",
    "radiology": "charttime",
    "patients": None,
}


def event_sources(clinical, counts) -> dict[str, EventSource]:
    """The event tables a list of counts reads."""
    names = {c.measure.source for c in counts}
    return {
        name: EventSource(clinical[name], EVENT_TIME[name]) for name in names
    }


def counts_of(features) -> list[SpanCount]:
    return list(dict.fromkeys(count for f in features for count, _ in f.needs))


def with_counts(stays: DataFrame, clinical, counts: list[SpanCount]) -> DataFrame:
    """The stays with one column per count; NULL where nothing was found."""
    if not counts:
        return stays
    found = count_in_spans(clinical["edstays"], event_sources(clinical, counts), counts)
    return stays.join(found, "stay_id", "left")


def feature_flags(clinical, features) -> DataFrame:
    """stay_id and one 0/1 column per feature, for every stay."""
    stays = clinical["edstays"]
    counted = with_counts(stays, clinical, counts_of(features))
    return counted.selectExpr("stay_id", *[f.value() for f in features])


def feature(clinical, definition: Feature) -> DataFrame:
    return feature_flags(clinical, [definition])


def critical_procedure_codes(clinical) -> DataFrame:
    """stay_id and one critical procedure code: the smallest of the stay.

    The smallest code of each subject and day is found first, then of each block of days. A
    stay reads as many rows as it has blocks.
    """
    per_day = (
        clinical["procedures_icd"]
        .where(CRITICAL.where)
        .selectExpr("subject_id", f"{S.bucket_of('chartdate')} AS day", "icd_code")
        .groupBy("subject_id", "day")
        .agg(F.min("icd_code").alias("icd_code"))
    )
    return S.fold_days(
        clinical["edstays"], per_day, ["subject_id"], S.STAY_DAYS_PLUS_ONE, "icd_code", "min"
    )


def red_cell_orders(clinical) -> DataFrame:
    """stay_id and order_count of the stays with more than one red cell order."""
    count = counts_of([f for f in FEATURES if f.column == "red_cell_order_more_than_1"])
    found = with_counts(clinical["edstays"], clinical, count)
    return found.where(F.col(count[0].name) > 1).select(
        "stay_id", F.col(count[0].name).alias("order_count")
    )
