"""DuckDB statements for the registered queries.

They follow the definitions literally: plain joins of stays and events, one feature at a
time. None of them uses the buckets, running totals or fused passes of the Spark side.
"""

from __future__ import annotations

from ..functions import vocabulary as V
from . import texts as T
from .fixtures import with_views


def _quoted(values) -> str:
    return ", ".join("'" + v.replace("'", "''") + "'" for v in values)


def _literal(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _like_any(column: str, words) -> str:
    return " OR ".join(f"{column} ILIKE '%{w}%'" for w in words)


HOUR = "e.intime + INTERVAL '1' HOUR"
FIRST_HOUR = f"BETWEEN e.intime AND {HOUR}"
AFTER_HOUR = f"BETWEEN {HOUR} AND e.outtime"
IN_STAY = "BETWEEN e.intime AND e.outtime"
DAYS_OF_STAY = "BETWEEN CAST(e.intime AS DATE) AND CAST(e.outtime AS DATE)"
DAYS_PLUS_ONE = (
    "BETWEEN CAST(e.intime AS DATE) AND CAST(e.outtime + INTERVAL '1' DAY AS DATE)"
)

TIER1 = _like_any("p.name", V.TIER1_CONTAINS)
TIER2 = (
    _like_any("p.name", V.TIER2_CONTAINS)
    + " OR "
    + " OR ".join(f"p.name ILIKE '{v}'" for v in V.TIER2_EQUALS)
)
TIER3 = _like_any("p.name", V.TIER3_CONTAINS)
TIER4 = _like_any("p.name", V.TIER4_CONTAINS)
PSYCHOTROPIC = " OR ".join(
    f"(p.name ILIKE '%{drug}%' AND p.name ILIKE '%{form}%')"
    for drug, form in V.PSYCHOTROPIC_PAIRS
)


def _poe(condition: str, when: str, key: str = "p.subject_id = e.subject_id"):
    time = f" AND p.ordertime {when}" if when else ""
    return ["fx_edstays", "fx_poe"], (
        f"SELECT DISTINCT e.stay_id FROM fx_edstays e JOIN fx_poe p ON {key}"
        f" WHERE {condition}{time}"
    )


def _pyxis(condition: str, when: str):
    time = f" AND p.charttime {when}" if when else ""
    return ["fx_edstays", "fx_pyxis"], (
        "SELECT DISTINCT e.stay_id FROM fx_edstays e JOIN fx_pyxis p"
        f" ON p.stay_id = e.stay_id WHERE ({condition}){time}"
    )


def _icu(when: str):
    return ["fx_edstays", "fx_transfers"], (
        "SELECT DISTINCT e.stay_id FROM fx_edstays e JOIN fx_transfers t"
        " ON t.subject_id = e.subject_id AND t.hadm_id = e.hadm_id"
        f" WHERE t.careunit IN ({_quoted(V.ICU_UNITS)}) AND {when}"
    )


def _surgery(when: str):
    return ["fx_edstays", "fx_transfers", "fx_procedures_icd"], (
        "SELECT DISTINCT e.stay_id FROM fx_edstays e JOIN fx_transfers t"
        " ON t.subject_id = e.subject_id AND t.hadm_id = e.hadm_id"
        " JOIN fx_procedures_icd p ON p.subject_id = e.subject_id AND p.hadm_id = e.hadm_id"
        f" WHERE t.careunit IN ({_quoted(V.SURGERY_UNITS)}) AND {when}"
    )


def _procedures(codes, when: str):
    return ["fx_edstays", "fx_procedures_icd"], (
        "SELECT DISTINCT e.stay_id FROM fx_edstays e JOIN fx_procedures_icd p"
        " ON p.subject_id = e.subject_id"
        f" WHERE p.icd_code IN ({_quoted(codes)}) AND {when}"
    )


def _stays(condition: str):
    return ["fx_edstays"], f"SELECT e.stay_id FROM fx_edstays e WHERE {condition}"


def _red_cells(start: str):
    return ["fx_edstays", "fx_poe"], (
        "SELECT e.stay_id, COUNT(p.poe_id) AS order_count FROM fx_edstays e"
        " JOIN fx_poe p ON p.subject_id = e.subject_id AND p.hadm_id = e.hadm_id"
        f" WHERE p.order_subtype = '{V.RED_CELL_ORDER}'"
        f" AND p.ordertime BETWEEN {start} AND e.intime + INTERVAL '7' DAY"
        " GROUP BY e.stay_id HAVING COUNT(p.poe_id) > 1"
    )


_VENTILATOR = f"p.order_subtype = '{V.VENTILATOR_ORDER}'"
_NON_INVASIVE = f"p.order_subtype IN ({_quoted(V.NON_INVASIVE_ORDERS)})"

# Column -> the set of flagged stays.
FLAGGED = {
    "invasive_ventilation": _poe(_VENTILATOR, FIRST_HOUR),
    "invasive_ventilation_beyond_1h": _poe(_VENTILATOR, AFTER_HOUR),
    "non_invasive_ventilation": _poe(_NON_INVASIVE, IN_STAY),
    "transfer2surgeryin1h": _surgery(
        f"CAST(t.intime AS DATE) {DAYS_OF_STAY} AND t.intime {FIRST_HOUR}"
        f" AND p.chartdate {DAYS_OF_STAY}"
    ),
    "transfer_to_surgery_beyond_1h": _surgery(
        f"t.intime > {HOUR} AND p.chartdate {IN_STAY}"
    ),
    "transfer_to_ICU_beyond_1h": _icu(f"t.intime {IN_STAY} AND t.intime > {HOUR}"),
    "transfer_within_1h": _stays(f"e.disposition = 'TRANSFER' AND e.outtime {FIRST_HOUR}"),
    "transfer_beyond_1h": _stays(f"e.disposition = 'TRANSFER' AND e.outtime > {HOUR}"),
    "expired_within_1h": _stays(f"e.disposition = 'EXPIRED' AND e.outtime <= {HOUR}"),
    "expired_beyond_1h": _stays(f"e.disposition = 'EXPIRED' AND e.outtime > {HOUR}"),
    "tier1_med_usage_1h": _pyxis(TIER1, FIRST_HOUR),
    "tier1_med_usage_beyond_1h": _pyxis(TIER1, AFTER_HOUR),
    "tier2_med_usage": _pyxis(TIER2, ""),
    "tier3_med_usage": _pyxis(TIER3, ""),
    "tier4_med_usage": _pyxis(TIER4, ""),
    "psychotropic_med_within_120min": (
        ["fx_edstays", "fx_pyxis", "fx_patients"],
        "SELECT DISTINCT e.stay_id FROM fx_edstays e"
        " JOIN fx_patients a ON a.subject_id = e.subject_id"
        " JOIN fx_pyxis p ON p.subject_id = e.subject_id AND p.stay_id = e.stay_id"
        f" WHERE ({PSYCHOTROPIC})"
        " AND p.charttime BETWEEN e.intime AND e.intime + INTERVAL '120' MINUTE",
    ),
    "transfusion_within_1h": _poe(
        f"p.order_subtype IN ({_quoted(V.EARLY_TRANSFUSION_ORDERS)})", FIRST_HOUR
    ),
    "transfusion_beyond_1h": _poe(
        f"p.order_subtype IN ({_quoted(V.LATE_TRANSFUSION_ORDERS)})",
        f"BETWEEN {HOUR} AND e.intime + INTERVAL '7' DAY",
    ),
    "red_cell_order_more_than_1": _red_cells(HOUR),
    "intraosseous_line_placed": _procedures(
        V.INTRAOSSEOUS_CODES,
        "p.chartdate BETWEEN e.intime AND e.intime + INTERVAL '7' DAY",
    ),
    "critical_procedure": _procedures(
        V.CRITICAL_PROCEDURE_CODES, f"p.chartdate {DAYS_PLUS_ONE}"
    ),
}
ICU_WITHIN_HOUR = _icu(f"CAST(t.intime AS DATE) {DAYS_OF_STAY} AND t.intime {FIRST_HOUR}")
VARIANTS = {
    "non_invasive_ventilation": _poe(_NON_INVASIVE, ""),
    "transfer_to_surgery_beyond_1h": _surgery(
        f"CAST(t.intime AS DATE) {DAYS_OF_STAY} AND t.intime > {HOUR}"
        f" AND p.chartdate {DAYS_OF_STAY}"
    ),
    "transfer_to_ICU_beyond_1h": _icu(
        f"CAST(t.intime AS DATE) {DAYS_OF_STAY} AND t.intime > {HOUR}"
    ),
    "red_cell_order_more_than_1": _red_cells("e.intime"),
    "critical_procedure": _procedures(
        V.CRITICAL_PROCEDURE_CODES,
        "p.chartdate BETWEEN e.intime AND e.intime + INTERVAL '7' DAY",
    ),
}


def _flag_sql(column: str, flagged) -> str:
    views, rows = flagged
    return with_views(
        views,
        f"""WITH hit AS ({rows})
        SELECT e.stay_id, CAST(CASE WHEN h.stay_id IS NOT NULL THEN 1 ELSE 0 END AS INT)
               AS {column}
        FROM fx_edstays e LEFT JOIN hit h ON h.stay_id = e.stay_id""",
    )


def _counted(table: str, column: str, when: str = "charttime"):
    return (
        f"SELECT e.stay_id, COUNT(x.{column}) AS n FROM fx_edstays e JOIN {table} x"
        f" ON x.subject_id = e.subject_id AND x.{when} {IN_STAY} GROUP BY e.stay_id"
    )


DRUG_COUNTS = (
    "SELECT p.stay_id, p.name AS drug_name, COUNT(*) AS n FROM fx_pyxis p"
    f" JOIN fx_edstays e ON e.stay_id = p.stay_id WHERE p.charttime {IN_STAY}"
    " GROUP BY p.stay_id, p.name"
)
ROUTE_SUMS = ", ".join(
    f"CAST(SUM(CASE WHEN m.admin_method = '{route}' THEN c.n ELSE 0 END) AS BIGINT) AS {column}"
    for route, column in V.ROUTES
)
DRUG_ROUTES = (
    f"SELECT c.stay_id, {ROUTE_SUMS} FROM ({DRUG_COUNTS}) c"
    " JOIN fx_pyxis_admin_method m ON m.drug_name = c.drug_name GROUP BY c.stay_id"
)
ROUTE_VIEWS = ["fx_edstays", "fx_pyxis", "fx_pyxis_admin_method"]
CONSULTS = (
    "SELECT e.stay_id, COUNT(p.poe_id) AS n FROM fx_edstays e JOIN fx_poe p"
    f" ON p.subject_id = e.subject_id AND p.order_type = 'Consults' AND p.ordertime {IN_STAY}"
    " GROUP BY e.stay_id"
)
STAY_PROCEDURES = (
    "SELECT e.stay_id, e.subject_id, e.intime, e.outtime, p.icd_code AS procedures_icd,"
    " p.icd_version FROM fx_edstays e JOIN fx_procedures_icd p"
    f" ON p.subject_id = e.subject_id AND p.chartdate {DAYS_PLUS_ONE}"
)
PROCEDURE_COUNTS = f"SELECT stay_id, COUNT(*) AS n FROM ({STAY_PROCEDURES}) GROUP BY stay_id"
LABS = _counted("fx_labevents", "labevent_id")
MICROBIOLOGY = _counted("fx_microbiologyevents", "microevent_id")
EXAMS = _counted("fx_radiology", "note_id")


def _count_sql(views, rows: str, column: str) -> str:
    return with_views(
        ["fx_edstays", *views],
        f"""WITH c AS ({rows})
        SELECT e.stay_id, COALESCE(c.n, 0) AS {column}
        FROM fx_edstays e LEFT JOIN c ON c.stay_id = e.stay_id""",
    )


ALL_CLINICAL = [
    "fx_edstays",
    "fx_triage",
    "fx_poe",
    "fx_transfers",
    "fx_procedures_icd",
    "fx_patients",
    "fx_pyxis",
    "fx_pyxis_admin_method",
    "fx_labevents",
    "fx_microbiologyevents",
    "fx_radiology",
]
BASE_COLUMNS = (
    "e.subject_id, e.stay_id, e.hadm_id, e.intime, e.outtime, e.gender, e.race,"
    " e.arrival_transport, e.disposition, t.temperature, t.heartrate, t.resprate, t.o2sat,"
    " t.sbp, t.dbp, t.pain, t.acuity, t.chiefcomplaint"
)
BASE_FROM = (
    "FROM fx_edstays e LEFT JOIN fx_triage t"
    " ON t.subject_id = e.subject_id AND t.stay_id = e.stay_id"
)
COUNT_SETS = {
    "lab_event_count": LABS,
    "microbio_event_count": MICROBIOLOGY,
    "exam_count": EXAMS,
    "consults_count": CONSULTS,
    "procedure_count": PROCEDURE_COUNTS,
}


def _wide() -> tuple[str, str]:
    """The wide table as CTE list and final select."""
    ctes = [f"f_{name} AS ({rows})" for name, (_, rows) in FLAGGED.items()]
    ctes += [f"c_{name} AS ({rows})" for name, rows in COUNT_SETS.items()]
    ctes.append(f"c_routes AS ({DRUG_ROUTES})")
    columns = [
        f"CAST(CASE WHEN f_{n}.stay_id IS NOT NULL THEN 1 ELSE 0 END AS INT) AS {n}"
        for n in FLAGGED
    ]
    columns += [f"COALESCE(c_{n}.n, 0) AS {n}" for n in COUNT_SETS]
    columns += [f"COALESCE(c_routes.{c}, 0) AS {c}" for _, c in V.ROUTES]
    joins = [f"LEFT JOIN f_{n} ON f_{n}.stay_id = e.stay_id" for n in FLAGGED]
    joins += [f"LEFT JOIN c_{n} ON c_{n}.stay_id = e.stay_id" for n in COUNT_SETS]
    joins.append("LEFT JOIN c_routes ON c_routes.stay_id = e.stay_id")
    select = f"SELECT {BASE_COLUMNS}, {', '.join(columns)} {BASE_FROM} {' '.join(joins)}"
    return ", ".join(ctes), select


_WIDE_CTES, _WIDE_SELECT = _wide()


def _over_wide(body: str) -> str:
    return with_views(
        ALL_CLINICAL, f"WITH {_WIDE_CTES}, wide AS ({_WIDE_SELECT}) {body}"
    )


WIDE = with_views(ALL_CLINICAL, f"WITH {_WIDE_CTES} {_WIDE_SELECT}")
QC_FLAGS = _over_wide(
    " UNION ALL ".join(
        f"SELECT '{c}' AS feature, CAST(SUM({c}) AS BIGINT) AS total FROM wide"
        for c in FLAGGED
    )
)
QC_COUNTS = _over_wide(
    " UNION ALL ".join(
        f"SELECT '{c}' AS resource, COUNT(*) AS stays FROM wide WHERE {c} > 0"
        for c in COUNT_SETS
    )
    + " UNION ALL SELECT 'drug_routes', COUNT(*) FROM wide WHERE "
    + " OR ".join(f"{c} > 0" for _, c in V.ROUTES)
)
RESOURCE_TYPES = _over_wide(
    """SELECT stay_id, CAST(
        (lab_event_count > 0 OR microbio_event_count > 0)::INT + (exam_count > 0)::INT
        + (intravenous_fluids > 0)::INT
        + (intravenous > 0 OR intramuscular > 0 OR nebulized_medications > 0)::INT
        + (consults_count > 0)::INT + (procedure_count > 0)::INT AS INT)
        AS resource_type_count FROM wide"""
)


def _prompt_sql(instruction: str, input: str, output: str, tail: str) -> str:
    def text(expr):
        return f"COALESCE(CAST({expr} AS VARCHAR), 'None')"

    return " || ".join(
        [
            _literal(V.PROMPT_INTRO + V.PROMPT_INSTRUCTION_HEAD),
            text(instruction),
            _literal(V.PROMPT_INPUT_HEAD),
            text(input),
            _literal(V.PROMPT_RESPONSE_HEAD),
            text(output),
            _literal(tail),
        ]
    )


LAST_LEVEL = "COALESCE(CAST(list_last(regexp_extract_all({c}, '[1-5]')) AS INT), -1)"
_ARGS = {"c": "response"}
LABELLED = (
    "CASE WHEN contains(lower(response), 'esi level:') THEN "
    "COALESCE(TRY_CAST(nullif(regexp_extract(list_last(string_split(lower(response),"
    " 'esi level:')), '^\\s*([1-5])', 1), '') AS INT), -1) "
    "WHEN contains(lower(response), 'esi:') THEN "
    "COALESCE(TRY_CAST(nullif(regexp_extract(list_last(string_split(lower(response),"
    " 'esi:')), '^\\s*([1-5])', 1), '') AS INT), -1) "
    "ELSE " + LAST_LEVEL.format(**_ARGS) + " END"
)
CASCADE = (
    "CAST(CASE WHEN {n} IS NULL THEN -1 WHEN {a} THEN 1 WHEN {b} THEN 2"
    " WHEN {n} > 1 THEN 3 WHEN {n} = 1 THEN 4 ELSE 5 END AS INT)"
)


def _cascade(a: str, b: str, n: str) -> str:
    return CASCADE.format(a=f"COALESCE({a} = 'True', FALSE)", b=f"COALESCE({b} = 'True', FALSE)", n=f"TRY_CAST({n} AS DOUBLE)")


OUTPUTS = ["fx_llm_outputs"]
PREDICTIONS = ["fx_predictions"]
VALID = "acuity IS NOT NULL AND final_pred IS NOT NULL AND final_pred <> -1"


def _ratio(part: str, whole: str) -> str:
    return f"CASE WHEN ({whole}) > 0 THEN CAST({part} AS DOUBLE) / ({whole}) ELSE 0.0 END"


def _eval(keys: str, body: str) -> str:
    """Metrics over `p`, the prediction rows with a grouping column `k`."""
    return with_views(PREDICTIONS, f"WITH p AS (SELECT {keys} AS k, * FROM fx_predictions), {body}")


PER_CLASS = f"""
valid AS (SELECT * FROM p WHERE {VALID}),
runs AS (SELECT DISTINCT k FROM p),
labels AS (SELECT k, acuity AS class FROM valid UNION SELECT k, final_pred FROM valid),
conf AS (
  SELECT l.k, l.class,
         SUM(CASE WHEN v.acuity = l.class AND v.final_pred = l.class THEN 1 ELSE 0 END) AS tp,
         SUM(CASE WHEN v.acuity <> l.class AND v.final_pred = l.class THEN 1 ELSE 0 END) AS fp,
         SUM(CASE WHEN v.acuity = l.class AND v.final_pred <> l.class THEN 1 ELSE 0 END) AS fn
  FROM labels l JOIN valid v ON v.k = l.k GROUP BY l.k, l.class),
pr AS (SELECT *, {_ratio('tp', 'tp + fp')} AS precision, {_ratio('tp', 'tp + fn')} AS recall
       FROM conf),
prf AS (SELECT *, {_ratio('2 * precision * recall', 'precision + recall')} AS f1 FROM pr),
macro AS (SELECT k, AVG(precision) AS macro_precision, AVG(recall) AS macro_recall,
                 AVG(f1) AS macro_f1 FROM prf GROUP BY k),
moderate AS (SELECT k, f1 AS moderate_f1 FROM prf WHERE class = 3),
flat AS (
  SELECT k, COUNT(*) AS n, COUNT(*) FILTER (acuity = final_pred) AS hits,
         COUNT(*) FILTER (acuity IN (1, 2)) AS high,
         COUNT(*) FILTER (acuity IN (1, 2) AND final_pred IN (1, 2)) AS high_hit,
         COUNT(*) FILTER (final_pred IN (4, 5)) AS low,
         COUNT(*) FILTER (acuity IN (4, 5) AND final_pred IN (4, 5)) AS low_hit,
         COUNT(*) FILTER (final_pred < acuity) AS over_n,
         COUNT(*) FILTER (final_pred > acuity) AS under_n
  FROM valid GROUP BY k),
failed AS (SELECT k, COUNT(*) FILTER (final_pred = -1) AS failed FROM p GROUP BY k),
metrics AS (
  SELECT r.k,
    round({_ratio('f.hits', 'f.n')}, 9) AS accuracy,
    round(COALESCE(m.macro_precision, 0.0), 9) AS macro_precision,
    round(COALESCE(m.macro_recall, 0.0), 9) AS macro_recall,
    round(COALESCE(m.macro_f1, 0.0), 9) AS macro_f1,
    round({_ratio('f.high_hit', 'f.high')}, 9) AS high_risk_recall,
    round(COALESCE(o.moderate_f1, 0.0), 9) AS moderate_f1,
    round({_ratio('f.low_hit', 'f.low')}, 9) AS non_urgent_precision,
    b.failed AS failed_predictions,
    round({_ratio('f.over_n', 'f.n')}, 9) AS over_triage_rate,
    round({_ratio('f.under_n', 'f.n')}, 9) AS under_triage_rate,
    f.over_n AS over_triage_count, f.under_n AS under_triage_count
  FROM runs r LEFT JOIN flat f ON f.k = r.k LEFT JOIN macro m ON m.k = r.k
  LEFT JOIN moderate o ON o.k = r.k LEFT JOIN failed b ON b.k = r.k)
"""


def _metrics(columns: str) -> str:
    return _eval("1", f"{PER_CLASS} SELECT {columns} FROM metrics")


REPORT_COLUMNS = (
    "accuracy, macro_precision, macro_recall, macro_f1, high_risk_recall, moderate_f1,"
    " non_urgent_precision, failed_predictions, over_triage_rate, under_triage_rate,"
    " over_triage_count, under_triage_count"
)

CASE_TEXT = T.CASE_TEXT_SQL
CASE_FROM = "FROM fx_edstays e LEFT JOIN fx_triage t ON t.stay_id = e.stay_id AND t.subject_id = e.subject_id"


def _views_sql(views: dict[int, str]) -> str:
    return ", ".join(f"({n}, {_literal(t)})" for n, t in views.items())


# The stub models of the batch queries, as SQL over the case number.
def _stub_reply(text: str, fails: str) -> str:
    return f"CASE WHEN {fails} THEN NULL ELSE {text} END"


def oracle_sql() -> dict[str, str]:
    q: dict[str, str] = {}

    # Scans and sinks
    for name in ALL_CLINICAL:
        q[f"scan_{name[3:]}"] = with_views([name], f"SELECT * FROM {name}")
    q["csv_roundtrip_cases"] = with_views(
        ["fx_edstays", "fx_triage"],
        f"SELECT e.stay_id AS case_id, {CASE_TEXT} AS triage_text, t.acuity {CASE_FROM}",
    )
    q["result_sink_roundtrip"] = with_views(
        PREDICTIONS, "SELECT case_id, acuity, final_pred, 'model_20240101000000' AS run_name FROM fx_predictions"
    )
    q["prompt_templates"] = with_views(
        OUTPUTS,
        f"SELECT o.case_id, v.view, v.instruction || chr(10) || COALESCE(o.response, 'None') AS prompt"
        f" FROM fx_llm_outputs o, (VALUES {_views_sql(T.ANALYSIS)}) AS v(view, instruction)",
    )
    q["report_roundtrip"] = _metrics(REPORT_COLUMNS)
    q["eval_all_runs"] = _eval(
        "run_name", f"{PER_CLASS} SELECT k AS run_name, {REPORT_COLUMNS} FROM metrics"
    )
    q["checkpoint_resume"] = with_views(
        OUTPUTS,
        f"SELECT case_id, 'seen: ' || COALESCE(response, '') AS response,"
        f" CASE WHEN {T.FAILS_SQL} THEN 2 ELSE 1 END AS pass FROM fx_llm_outputs",
    )

    # Predicates and expressions
    q["pred_category"] = with_views(
        ["fx_transfers"],
        "SELECT transfer_id, careunit AS unit,"
        f" careunit IN ({_quoted(V.SURGERY_UNITS)}) AS surgery,"
        f" careunit IN ({_quoted(V.ICU_UNITS)}) AS icu FROM fx_transfers"
        f" WHERE careunit <> 'Emergency Department'",
    )
    q["pred_time_range"] = with_views(
        ["fx_edstays"],
        f"SELECT e.stay_id, e.outtime {FIRST_HOUR} AS out_first_hour, e.outtime > {HOUR} AS out_later,"
        " e.intime + INTERVAL '7' DAY AS week_end, e.intime + INTERVAL '120' MINUTE AS two_hours"
        " FROM fx_edstays e",
    )
    q["pred_calendar_day"] = with_views(
        ["fx_edstays"],
        "SELECT stay_id, CAST(intime AS DATE) AS day_in, CAST(outtime AS DATE) AS day_out,"
        " CAST(outtime + INTERVAL '1' DAY AS DATE) AS day_after,"
        " CAST(intime AS DATE) = CAST(outtime AS DATE) AS same_day FROM fx_edstays",
    )
    q["pred_date_vs_timestamp"] = with_views(
        ["fx_edstays"],
        "SELECT stay_id, CAST(outtime AS DATE) BETWEEN intime AND outtime AS day_out_inside,"
        " CAST(intime AS DATE) BETWEEN intime AND outtime AS day_in_inside FROM fx_edstays",
    )
    q["pred_ilike"] = with_views(
        ["fx_pyxis"],
        f"SELECT p.stay_id, p.charttime, p.name, ({TIER1}) AS tier1, ({TIER2}) AS tier2, ({TIER3}) AS tier3,"
        f" ({TIER4}) AS tier4, ({PSYCHOTROPIC}) AS psychotropic,"
        " p.name ILIKE '%dextrose 50%%' AS dextrose, p.name ILIKE 'Labetalol' AS labetalol"
        " FROM fx_pyxis p",
    )
    q["expr_age"] = with_views(
        ["fx_edstays", "fx_patients"],
        "SELECT e.stay_id, CAST(a.anchor_age + (year(e.intime) - a.anchor_year) AS INT) AS age"
        " FROM fx_edstays e JOIN fx_patients a ON a.subject_id = e.subject_id",
    )
    q["expr_case_coalesce"] = with_views(
        ["fx_edstays", "fx_triage"],
        "SELECT e.stay_id, COALESCE(t.acuity, 0) AS acuity,"
        " CASE WHEN e.arrival_transport = 'AMBULANCE' THEN 1 ELSE 0 END AS by_ambulance"
        f" {CASE_FROM}",
    )
    q["ensure_columns"] = with_views(
        ["fx_triage"],
        "SELECT stay_id, acuity, CAST(NULL AS INT) AS final_pred, CAST(NULL AS VARCHAR) AS llm_resp,"
        " 0 AS flag FROM fx_triage",
    )
    q["pred_any_positive"] = with_views(
        ROUTE_VIEWS,
        f"SELECT stay_id, ({' OR '.join(f'{c} > 0' for _, c in V.ROUTES)}) AS any_route"
        f" FROM ({DRUG_ROUTES})",
    )

    # Joins
    q["base_stay_triage"] = with_views(
        ["fx_edstays", "fx_triage"], f"SELECT {BASE_COLUMNS} {BASE_FROM}"
    )
    q["interval_join_subject"] = with_views(
        ["fx_edstays", "fx_poe"],
        "SELECT e.stay_id, p.poe_id, p.ordertime, p.order_type FROM fx_edstays e JOIN fx_poe p"
        f" ON p.subject_id = e.subject_id AND p.ordertime {IN_STAY}",
    )
    q["interval_join_admission"] = with_views(
        ["fx_edstays", "fx_transfers"],
        "SELECT e.stay_id, t.transfer_id, t.careunit FROM fx_edstays e JOIN fx_transfers t"
        " ON t.subject_id = e.subject_id AND t.hadm_id = e.hadm_id"
        f" AND t.intime > {HOUR} AND t.intime <= e.outtime",
    )
    q["interval_join_stay"] = with_views(
        ["fx_edstays", "fx_pyxis"],
        "SELECT e.stay_id, p.charttime, p.name FROM fx_edstays e JOIN fx_pyxis p"
        f" ON p.stay_id = e.stay_id AND p.charttime {IN_STAY}",
    )
    q["two_event_semi"] = with_views(
        FLAGGED["transfer_to_surgery_beyond_1h"][0],
        FLAGGED["transfer_to_surgery_beyond_1h"][1],
    )
    q["lookup_fanout"] = with_views(
        ROUTE_VIEWS,
        f'SELECT c.stay_id, c.drug_name, c.n AS "count", m.admin_method FROM ({DRUG_COUNTS}) c'
        " JOIN fx_pyxis_admin_method m ON m.drug_name = c.drug_name",
    )
    views, rows = FLAGGED["tier1_med_usage_1h"]
    q["flag_update"] = with_views(
        views,
        f"SELECT e.*, CAST(CASE WHEN h.stay_id IS NOT NULL THEN 1 ELSE 0 END AS INT) AS tier1_med_usage_1h"
        f" FROM fx_edstays e LEFT JOIN ({rows}) h ON h.stay_id = e.stay_id",
    )
    q["count_update"] = with_views(
        ["fx_edstays", "fx_labevents"],
        f"SELECT e.*, COALESCE(c.n, 0) AS lab_event_count FROM fx_edstays e"
        f" LEFT JOIN ({LABS}) c ON c.stay_id = e.stay_id",
    )
    q["scalar_count"] = with_views(
        ["fx_edstays", "fx_procedures_icd"],
        f"WITH sp AS ({STAY_PROCEDURES}) SELECT e.stay_id,"
        " (SELECT COUNT(*) FROM sp WHERE sp.stay_id = e.stay_id) AS procedure_count"
        " FROM fx_edstays e",
    )
    q["existence_filter"] = with_views(
        ["fx_edstays", "fx_patients"],
        "SELECT e.stay_id, e.subject_id FROM fx_edstays e JOIN fx_patients a"
        " ON a.subject_id = e.subject_id",
    )
    q["zero_count_keep"] = with_views(
        ["fx_edstays", "fx_microbiologyevents"],
        "SELECT e.stay_id, e.intime, COALESCE(c.n, 0) AS microbio_event_count"
        f" FROM fx_edstays e LEFT JOIN ({MICROBIOLOGY}) c ON c.stay_id = e.stay_id",
    )
    q["semi_stays"] = with_views(
        ["fx_edstays", "fx_labevents"],
        "SELECT DISTINCT e.stay_id FROM fx_edstays e JOIN fx_labevents x"
        f" ON x.subject_id = e.subject_id AND x.charttime {IN_STAY}",
    )
    q["insert_if_absent"] = with_views(
        ["fx_edstays", "fx_labevents", "fx_microbiologyevents"],
        f"WITH l AS ({LABS}), m AS ({MICROBIOLOGY})"
        " SELECT stay_id, n FROM l UNION ALL"
        " SELECT stay_id, n FROM m WHERE stay_id NOT IN (SELECT stay_id FROM l)",
    )

    # Aggregations
    q["distinct_stays"] = with_views(
        ["fx_pyxis"], "SELECT DISTINCT stay_id FROM fx_pyxis"
    )
    q["drug_counts"] = with_views(
        ["fx_edstays", "fx_pyxis"], f'SELECT stay_id, drug_name, n AS "count" FROM ({DRUG_COUNTS})'
    )
    q["drug_route_pivot"] = with_views(ROUTE_VIEWS, DRUG_ROUTES)
    q["qc_feature_totals"] = QC_FLAGS
    q["qc_positive_counts"] = QC_COUNTS
    views, rows = FLAGGED["critical_procedure"]
    q["critical_procedure_code"] = with_views(
        views,
        rows.replace("SELECT DISTINCT e.stay_id", "SELECT e.stay_id, MIN(p.icd_code) AS icd_code")
        + " GROUP BY e.stay_id",
    )
    views, rows = FLAGGED["red_cell_order_more_than_1"]
    q["red_cell_order_counts"] = with_views(views, rows)
    # Votes are counted and ranked; of equals the earliest voter's answer comes first.
    q["majority_vote"] = with_views(
        OUTPUTS,
        """WITH v AS (SELECT case_id, unnest([1, 2, 3]) AS place,
                          unnest([llm1_format, llm2_format, llm3_format]) AS answer FROM fx_llm_outputs),
             n AS (SELECT case_id, answer, COUNT(*) AS votes, MIN(place) AS early FROM v
                   WHERE answer IS NOT NULL GROUP BY case_id, answer),
             r AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY case_id ORDER BY votes DESC, early) AS k FROM n)
        SELECT o.case_id, r.answer AS final_pred FROM fx_llm_outputs o
        LEFT JOIN r ON r.case_id = o.case_id AND r.k = 1""",
    )

    # Features
    for column, flagged in FLAGGED.items():
        q[f"feature_{column}"] = _flag_sql(column, flagged)
    q["feature_icu_within_1h"] = _flag_sql("icu_within_1h", ICU_WITHIN_HOUR)
    for column, flagged in VARIANTS.items():
        q[f"feature_{column}__count"] = _flag_sql(column, flagged)

    # Resources and the wide table
    q["count_lab_event"] = _count_sql(["fx_labevents"], LABS, "lab_event_count")
    q["count_microbio_event"] = _count_sql(
        ["fx_microbiologyevents"], MICROBIOLOGY, "microbio_event_count"
    )
    q["count_exam"] = with_views(
        ["fx_edstays", "fx_radiology"], f"SELECT stay_id, n AS exam_count FROM ({EXAMS})"
    )
    q["count_drug_routes"] = with_views(ROUTE_VIEWS, DRUG_ROUTES)
    q["count_consults"] = with_views(
        ["fx_edstays", "fx_poe"],
        f"SELECT e.stay_id, e.subject_id, e.intime, e.outtime, COALESCE(c.n, 0) AS consults_count"
        f" FROM fx_edstays e LEFT JOIN ({CONSULTS}) c ON c.stay_id = e.stay_id",
    )
    q["stay_procedures"] = with_views(["fx_edstays", "fx_procedures_icd"], STAY_PROCEDURES)
    q["count_procedures"] = _count_sql(
        ["fx_procedures_icd"], PROCEDURE_COUNTS, "procedure_count"
    )
    q["wide_sink_roundtrip"] = WIDE
    q["wide_table"] = WIDE
    q["wide_sink_totals"] = (
        f"SELECT 'feature' AS kind, feature AS name, CAST(total AS BIGINT) AS total FROM ({q['qc_feature_totals']})"
        f" UNION ALL SELECT 'resource', resource, CAST(stays AS BIGINT) FROM ({q['qc_positive_counts']})"
    )
    q["resource_type_count"] = RESOURCE_TYPES

    # Texts and model batches
    q["render_prompt"] = with_views(
        OUTPUTS,
        f"SELECT case_id, {_prompt_sql(_literal(T.ONE_STEP), 'response', _literal(''), V.PROMPT_PADDED_TAIL)}"
        " AS prompt FROM fx_llm_outputs",
    )
    q["prompt_fan_out"] = with_views(
        OUTPUTS,
        f"SELECT o.case_id, v.view, {_prompt_sql('v.instruction', 'o.response', _literal(''), '')} AS prompt"
        f" FROM fx_llm_outputs o, (VALUES {_views_sql(T.ANALYSIS)}) AS v(view, instruction)",
    )
    sft = _prompt_sql("instruction", "input", "output", T.EOS)
    q["format_sft"] = with_views(
        ["fx_instructions"], f"SELECT conv_id, turn, {sft} AS text FROM fx_instructions"
    )
    q["format_sft_file"] = f"SELECT text FROM ({q['format_sft']})"
    q["format_sft_qa"] = q["format_sft"]
    q["format_cpt"] = f"SELECT doc_id, text || {_literal(T.EOS)} AS text FROM documents"
    q["chat_request"] = (
        f"SELECT conv_id, turn, 'gpt-4o' AS model, 'system' AS role_1, {_literal(T.SYSTEM)} AS content_1,"
        " 'user' AS role_2, text AS content_2, 0 AS temperature, 2048 AS max_tokens, 1 AS top_p,"
        " 0 AS frequency_penalty, 0 AS presence_penalty FROM conversations"
    )
    q["query_request"] = (
        "SELECT conv_id, turn, text AS query, 'blocking' AS response_mode, '' AS conversation_id,"
        ' \'system\' AS "user" FROM conversations'
    )
    q["extract_reply"] = (
        "SELECT conv_id, turn, text AS chat_content, text AS query_answer FROM conversations"
    )
    q["apply_model_stub"] = with_views(
        OUTPUTS,
        f"""SELECT case_id, CASE WHEN {T.FAILS_SQL} THEN NULL ELSE 'seen: ' || COALESCE(response, '') END AS response,
        CAST(CASE WHEN {T.FAILS_SQL} THEN 5 WHEN {T.SLOW_SQL} THEN 3 ELSE 1 END AS INT) AS attempts,
        CASE WHEN {T.FAILS_SQL} THEN 'ValueError: refused' END AS error,
        CAST(CASE WHEN {T.FAILS_SQL} THEN -1 END AS INT) AS final_pred FROM fx_llm_outputs""",
    )
    q["apply_model_null"] = with_views(
        OUTPUTS,
        f"""SELECT case_id, CASE WHEN {T.FAILS_SQL} THEN NULL ELSE 'seen: ' || COALESCE(response, '') END AS response,
        CAST(CASE WHEN {T.FAILS_SQL} THEN 5 WHEN {T.SLOW_SQL} THEN 3 ELSE 1 END AS INT) AS attempts,
        CASE WHEN {T.FAILS_SQL} THEN 'ValueError: refused' END AS error FROM fx_llm_outputs""",
    )
    q["parse_level"] = with_views(
        OUTPUTS,
        f"SELECT case_id, {LAST_LEVEL.format(c='response')} AS level FROM fx_llm_outputs",
    )
    q["parse_level_documents"] = (
        f"SELECT doc_id, {LAST_LEVEL.format(c='text')} AS level FROM documents"
    )
    q["parse_level_labelled"] = with_views(
        OUTPUTS, f"SELECT case_id, {LABELLED} AS level FROM fx_llm_outputs"
    )
    q["parse_true"] = with_views(
        OUTPUTS,
        "SELECT case_id, COALESCE(llm1_format = 'True', FALSE) AS view1,"
        " COALESCE(llm2_format = 'True', FALSE) AS view2 FROM fx_llm_outputs",
    )
    q["parse_json_result"] = with_views(
        OUTPUTS,
        "SELECT case_id, CASE WHEN llm2_format IS NULL THEN NULL ELSE llm2_format = 'True' END AS result,"
        " CASE WHEN llm1_format = 'true' THEN NULL ELSE llm1_format = 'True' END AS bare"
        " FROM fx_llm_outputs",
    )
    q["parse_json_number"] = with_views(
        OUTPUTS, "SELECT case_id, TRY_CAST(llm3_format AS DOUBLE) AS number FROM fx_llm_outputs"
    )
    q["esi_cascade"] = with_views(
        OUTPUTS,
        f"SELECT case_id, {_cascade('llm1_format', 'llm2_format', 'llm3_format')} AS final_pred"
        " FROM fx_llm_outputs",
    )
    q["render_case_prompt"] = with_views(
        ["fx_edstays", "fx_triage"],
        f"SELECT e.stay_id, {_literal(T.WRITE_CASE)} || chr(10) || {T.CASE_LINES_SQL} AS prompt {CASE_FROM}",
    )
    q["extract_case"] = (
        "SELECT doc_id, trim(text, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13))"
        " AS case_text FROM documents"
    )
    step = "CASE WHEN {fail} THEN NULL ELSE {reply} END"
    r1, r2, r3 = (step.format(fail=T.CHAIN_FAILS_SQL[v], reply=T.CHAIN_REPLIES_SQL[v]) for v in (1, 2, 3))
    q["two_step_chain"] = with_views(
        OUTPUTS,
        f"""WITH r AS (SELECT case_id, {r1} AS llm1_result, {r2} AS llm2_result, {r3} AS llm3_result
                       FROM fx_llm_outputs)
        SELECT *, CASE WHEN llm1_result IS NULL OR llm2_result IS NULL OR llm3_result IS NULL THEN -1
                       ELSE {_cascade('llm1_result', 'llm2_result', 'llm3_result')} END AS final_pred
        FROM r""",
    )

    # The first two results say True or False; where they differ the third, a number, ties with both.
    q["voting_run"] = with_views(
        OUTPUTS,
        f"""WITH r AS (SELECT case_id, {r1} AS llm1_result, {r2} AS llm2_result, {r3} AS llm3_result
                       FROM fx_llm_outputs),
             v AS (SELECT case_id, unnest([1, 2, 3]) AS place,
                          unnest([llm1_result, llm2_result, llm3_result]) AS answer FROM r),
             n AS (SELECT case_id, answer, COUNT(*) AS votes, MIN(place) AS early FROM v GROUP BY case_id, answer),
             k AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY case_id ORDER BY votes DESC, early) AS k FROM n)
        SELECT r.*, CASE WHEN r.llm1_result IS NULL OR r.llm2_result IS NULL OR r.llm3_result IS NULL THEN NULL
                         ELSE k.answer END AS final_pred
        FROM r JOIN k ON k.case_id = r.case_id AND k.k = 1""",
    )
    seen = "('seen: ' || response)"
    q["one_step_run"] = with_views(
        OUTPUTS,
        f"""SELECT case_id, CASE WHEN {T.FAILS_SQL} THEN NULL ELSE {seen} END AS response,
        CAST(CASE WHEN {T.FAILS_SQL} THEN 5 WHEN {T.SLOW_SQL} THEN 3 ELSE 1 END AS INT) AS attempts,
        CAST(CASE WHEN {T.FAILS_SQL} THEN -1 ELSE {LAST_LEVEL.format(c=seen)} END AS INT) AS final_pred
        FROM fx_llm_outputs""",
    )

    # Evaluation
    q["eval_failed_count"] = with_views(
        PREDICTIONS,
        f"""SELECT COUNT(*) FILTER ({VALID}) AS valid_predictions,
        COUNT(*) FILTER (final_pred = -1) AS failed_predictions FROM fx_predictions""",
    )
    q["eval_accuracy"] = _metrics("accuracy")
    q["eval_macro"] = _metrics("macro_precision, macro_recall, macro_f1")
    q["eval_risk_groups"] = _metrics("high_risk_recall, moderate_f1, non_urgent_precision")
    q["eval_triage_rates"] = _metrics(
        "over_triage_rate, under_triage_rate, over_triage_count, under_triage_count"
    )
    q["eval_confusion"] = _eval(
        "run_name",
        f"{PER_CLASS} SELECT k AS run_name, class, CAST(tp AS BIGINT) AS tp, CAST(fp AS BIGINT) AS fp,"
        " CAST(fn AS BIGINT) AS fn FROM conf",
    )
    q["eval_report"] = _metrics(REPORT_COLUMNS)
    
    # The same rows by another way: stored tables, flat files, votes over rows, waves.
    q["stored_flag_update"] = q["flag_update"]
    q["stored_count_update"] = q["count_update"]
    q["stored_insert_if_absent"] = q["insert_if_absent"]
    q["eval_flat_runs"] = q["eval_all_runs"]
    q["majority_vote_rows"] = q["majority_vote"]
    q["apply_model_waves"] = q["apply_model_stub"]
    q["wide_table_upkeep"] = q["wide_table"]
    return q
