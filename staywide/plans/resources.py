"""Resource counts of a stay."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import vocabulary as V
from ..functions.predicates import any_positive, zero_if_null
from ..operators import spans as S
from ..operators.spans import Measure, SpanCount
from ..sources.workspace import broadcast_if_small
from .features import ANY_PROCEDURE, STAY, SUBJECT, with_counts

LABS = Measure("labs", "labevents", "labevent_id IS NOT NULL")
MICROBIOLOGY = Measure(
    "microbiology", "microbiologyevents", "microevent_id IS NOT NULL"
)
EXAMS = Measure("exams", "radiology", "note_id IS NOT NULL")
CONSULTS = Measure(
    "consults",
    "poe",
    f"order_type = '{V.CONSULT_ORDER_TYPE}' AND poe_id IS NOT NULL",
)


def _route(column: str) -> Measure:
    return Measure(column, "pyxis", f"{column} > 0", amount=column)


ROUTE_COLUMNS = tuple(column for _, column in V.ROUTES)

# Column of the wide table -> count, in their order there.
RESOURCES = {
    "lab_event_count": SpanCount("lab_event_count", LABS, SUBJECT, S.IN_STAY),
    "microbio_event_count": SpanCount(
        "microbio_event_count", MICROBIOLOGY, SUBJECT, S.IN_STAY
    ),
    "exam_count": SpanCount("exam_count", EXAMS, SUBJECT, S.IN_STAY),
    **{
        column: SpanCount(f"n_{column}", _route(column), STAY, S.IN_STAY)
        for column in ROUTE_COLUMNS
    },
    "consults_count": SpanCount("consults_count", CONSULTS, SUBJECT, S.IN_STAY),
    "procedure_count": SpanCount(
        "procedure_count", ANY_PROCEDURE, SUBJECT, S.STAY_DAYS_PLUS_ONE
    ),
}

# A listed drug counts even if its route has no column of its own.
LISTED_DRUG = SpanCount(
    "n_listed_drug", Measure("listed_drug", "pyxis", "listed"), STAY, S.IN_STAY
)


def routes_per_drug(routes: DataFrame) -> DataFrame:
    """One row per drug: how often each route is listed for it.

    A drug listed with two routes counts in both, and joining this table to dispenses
    does not multiply their rows.
    """
    return routes.groupBy(F.col("drug_name").alias("_drug")).agg(
        *[
            F.count_if(F.col("admin_method") == route).alias(column)
            for route, column in V.ROUTES
        ],
        F.lit(True).alias("listed"),
    )


def with_routes(pyxis: DataFrame, routes: DataFrame, how: str = "left") -> DataFrame:
    """Dispenses with the route columns of their drug."""
    per_drug = broadcast_if_small(routes_per_drug(routes))
    joined = pyxis.join(per_drug, F.col("name") == F.col("_drug"), how)
    return joined.drop("_drug")


class WithRoutes(dict):
    """The clinical tables, with route columns on the dispenses."""

    def __init__(self, clinical):
        super().__init__()
        self._clinical = clinical

    def __missing__(self, name):
        table = self._clinical[name]
        if name == "pyxis":
            table = with_routes(table, self._clinical["pyxis_admin_method"])
        self[name] = table
        return table


def count_columns(columns) -> list[str]:
    """The counts as SQL over stay rows that carry them; 0 when nothing was found."""
    return [f"coalesce(`{RESOURCES[c].name}`, 0) AS {c}" for c in columns]


def resource_counts(clinical, columns) -> DataFrame:
    """stay_id and the named counts, for every stay; 0 when nothing was found."""
    counts = [RESOURCES[column] for column in columns]
    counted = with_counts(clinical["edstays"], WithRoutes(clinical), counts)
    return counted.selectExpr("stay_id", *count_columns(columns))


def stays_with(clinical, column: str) -> DataFrame:
    """The stays with at least one event behind a count."""
    return resource_counts(clinical, [column]).where(F.col(column) > 0).select("stay_id")


def exam_counts(clinical) -> DataFrame:
    """stay_id and exam_count of every stay with a radiology note in it.

    A note without an id makes the stay appear but does not count.
    """
    noted = SpanCount(
        "n_notes", Measure("notes", "radiology", "TRUE"), SUBJECT, S.IN_STAY
    )
    counted = with_counts(
        clinical["edstays"], clinical, [noted, RESOURCES["exam_count"]]
    )
    return counted.where(F.col("n_notes") > 0).select("stay_id", "exam_count")


def drug_route_counts(clinical) -> DataFrame:
    """stay_id and five route counts of every stay with a listed drug in it."""
    counts = [RESOURCES[column] for column in ROUTE_COLUMNS]
    counted = with_counts(
        clinical["edstays"], WithRoutes(clinical), [*counts, LISTED_DRUG]
    )
    return counted.where(F.col(LISTED_DRUG.name) > 0).select(
        "stay_id", *[F.col(f"n_{column}").alias(column) for column in ROUTE_COLUMNS]
    )


def drug_counts(clinical) -> DataFrame:
    """stay_id, drug_name and the number of dispenses during the stay."""
    pyxis = clinical["pyxis"].select("stay_id", "charttime", F.col("name").alias("drug_name"))
    stays = clinical["edstays"].select("stay_id", "intime", "outtime")
    return (
        S.interval_join(stays, pyxis, ["stay_id"], "charttime", S.IN_STAY)
        .groupBy("stay_id", "drug_name")
        .agg(F.count("*").alias("count"))
    )


def drug_routes(clinical) -> DataFrame:
    """Dispense counts with every listed route of the drug; one row per route."""
    routes = broadcast_if_small(clinical["pyxis_admin_method"])
    return drug_counts(clinical).join(routes, "drug_name").select(
        "stay_id", "drug_name", "count", "admin_method"
    )


def consult_counts(clinical) -> DataFrame:
    counted = with_counts(clinical["edstays"], clinical, [RESOURCES["consults_count"]])
    return counted.select(
        "stay_id",
        "subject_id",
        "intime",
        "outtime",
        zero_if_null(F.col("consults_count")).alias("consults_count"),
    )


def stay_procedures(clinical) -> DataFrame:
    """One row per procedure on a day from arrival to the day after departure."""
    stays = clinical["edstays"].select("stay_id", "subject_id", "intime", "outtime")
    procedures = clinical["procedures_icd"].select(
        "subject_id",
        F.col("chartdate").cast("timestamp_ntz").alias("_charted"),
        F.col("icd_code").alias("procedures_icd"),
        "icd_version",
    )
    pairs = S.interval_join(stays, procedures, ["subject_id"], "_charted", S.STAY_DAYS_PLUS_ONE)
    return pairs.select("stay_id", "subject_id", "intime", "outtime", "procedures_icd", "icd_version")


def procedures_by_day(clinical) -> DataFrame:
    """stay_id and procedure_count of every stay with a procedure, from daily counts.

    Procedures are counted per subject and day, and days per block, before they meet the
    stays, so a stay reads one row per block of its days instead of one row per procedure.
    """
    per_day = (
        clinical["procedures_icd"]
        .selectExpr("subject_id", f"{S.bucket_of('chartdate')} AS day")
        .groupBy("subject_id", "day")
        .agg(F.count("*").alias("procedure_count"))
    )
    return S.fold_days(
        clinical["edstays"], per_day, ["subject_id"], S.STAY_DAYS_PLUS_ONE, "procedure_count", "sum"
    )


def resource_type_count(wide: DataFrame) -> DataFrame:
    """stay_id and the number of resource types a stay used, not of single events.

    Laboratory and microbiology are one type, and so are injected and nebulized drugs.
    Oral drugs are not a resource.
    """
    c = F.col
    kinds = [
        any_positive(c("lab_event_count"), c("microbio_event_count")),
        c("exam_count") > 0,
        c("intravenous_fluids") > 0,
        any_positive(c("intravenous"), c("intramuscular"), c("nebulized_medications")),
        c("consults_count") > 0,
        c("procedure_count") > 0,
    ]
    total = sum((kind.cast("int") for kind in kinds[1:]), kinds[0].cast("int"))
    return wide.select("stay_id", total.alias("resource_type_count"))
