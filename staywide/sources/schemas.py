"""Explicit schemas of the clinical tables and of the case and result files."""

from __future__ import annotations

# Clinical tables. Times carry no zone, ids and counts are BIGINT, codes are text.
CLINICAL = {
    "edstays": (
        "stay_id BIGINT, subject_id BIGINT, hadm_id BIGINT, intime TIMESTAMP_NTZ, "
        "outtime TIMESTAMP_NTZ, gender STRING, race STRING, arrival_transport STRING, "
        "disposition STRING"
    ),
    "triage": (
        "stay_id BIGINT, subject_id BIGINT, temperature DOUBLE, heartrate DOUBLE, "
        "resprate DOUBLE, o2sat DOUBLE, sbp DOUBLE, dbp DOUBLE, pain STRING, "
        "acuity INT, chiefcomplaint STRING"
    ),
    "pyxis": "subject_id BIGINT, stay_id BIGINT, charttime TIMESTAMP_NTZ, name STRING",
    "pyxis_admin_method": "drug_name STRING, admin_method STRING",
    "poe": (
        "poe_id STRING, subject_id BIGINT, hadm_id BIGINT, ordertime TIMESTAMP_NTZ, "
        "order_type STRING, order_subtype STRING"
    ),
    "transfers": (
        "transfer_id BIGINT, subject_id BIGINT, hadm_id BIGINT, intime TIMESTAMP_NTZ, "
        "careunit STRING"
    ),
    "procedures_icd": (
        "subject_id BIGINT, hadm_id BIGINT, chartdate DATE, icd_code STRING, "
        "icd_version INT"
    ),
    "patients": "subject_id BIGINT, anchor_age INT, anchor_year INT",
    "labevents": "labevent_id BIGINT, subject_id BIGINT, charttime TIMESTAMP_NTZ",
    "microbiologyevents": (
        "microevent_id BIGINT, subject_id BIGINT, charttime TIMESTAMP_NTZ"
    ),
    "radiology": "note_id STRING, subject_id BIGINT, charttime TIMESTAMP_NTZ",
}

# Case and result files.
CASES = "case_id BIGINT, triage_text STRING, acuity INT"
ONE_STEP = {"final_pred": "int", "llm_resp": "string"}
LOCAL_ONE_STEP = {"model_response": "string", "esi_prediction": "int"}
THREE_STEP = {
    "final_pred": "int",
    "llm1_resp": "string",
    "llm2_resp": "string",
    "llm3_resp": "string",
    "llm1_result": "string",
    "llm2_result": "string",
    "llm3_result": "string",
}
INSTRUCTIONS = "instruction STRING, input STRING, output STRING"
QUESTIONS = "question STRING, note STRING, answer STRING"


def ddl(columns: dict[str, str]) -> str:
    return ", ".join(f"{name} {kind}" for name, kind in columns.items())


def result_ddl(case_ddl: str, added: dict[str, str]) -> str:
    """Schema of a result file: the case columns followed by the added ones."""
    return f"{case_ddl}, {ddl(added)}"
