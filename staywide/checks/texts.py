"""Prompt texts and stub models of the registered text queries, with their SQL twins."""

from __future__ import annotations

EOS = "<|end|>"
SYSTEM = "You sort emergency cases."
ONE_STEP = "State the severity level of this case, 1 to 5."
ANALYSIS = {
    1: "View 1: does the case need life-saving care at once?",
    2: "View 2: is the case a high-risk situation?",
    3: "View 3: how many kinds of resources does the case need?",
}
FORMATS = {
    1: "Format 1: answer True or False.",
    2: "Format 2: answer True or False.",
    3: "Format 3: answer with a number.",
}
WRITE_CASE = "Write one practice case from this record. Do not state its level."

# Fields of a case text: label, stay or triage column.
CASE_FIELDS = (
    ("Gender", "gender"),
    ("Race", "race"),
    ("Arrival", "arrival_transport"),
    ("Complaint", "chiefcomplaint"),
    ("Temperature", "temperature"),
    ("Heart rate", "heartrate"),
    ("Respiration", "resprate"),
    ("Oxygen", "o2sat"),
    ("Systolic", "sbp"),
    ("Diastolic", "dbp"),
    ("Pain", "pain"),
)
_STAY = {"gender", "race", "arrival_transport"}


def _sql_lines() -> str:
    lines = []
    for label, column in CASE_FIELDS:
        side = "e" if column in _STAY else "t"
        lines.append(f"'{label}: ' || COALESCE(CAST({side}.{column} AS VARCHAR), 'unknown')")
    return " || chr(10) || ".join(lines)


CASE_LINES_SQL = _sql_lines()
# A text with quotes, commas and a line break, to try the CSV files with.
CASE_TEXT_SQL = (
    "'Says \"' || COALESCE(t.chiefcomplaint, 'nothing') || '\", came by '"
    " || COALESCE(e.arrival_transport, '') || ',' || chr(10) || 'pain ' || COALESCE(t.pain, '?')"
)


def input_of(prompt: str) -> str:
    """The input section of a three-section prompt."""
    return prompt.split("### Input:\n", 1)[1].rsplit("\n\n### Response:\n", 1)[0]


# Stub model: refuses a case without text, and answers some cases at the third attempt.
FAILS_SQL = "response IS NULL"
SLOW_SQL = "response LIKE 'ESI: 3%'"


def _one_reply(text: str, attempt: int):
    if text == "None":
        return ValueError("refused")
    if text.startswith("ESI: 3") and attempt < 3:
        return TimeoutError("try again")
    return f"seen: {text}"


def load_stub():
    return lambda prompts, attempt: [_one_reply(input_of(p), attempt) for p in prompts]


def load_patient_stub():
    """Answers everything, also a case without text."""
    return lambda prompts, attempt: [
        "seen: " + ("" if input_of(p) == "None" else input_of(p)) for p in prompts
    ]


# Stub models of the two-step chain.
CHAIN_FAILS_SQL = {
    1: "(response IS NULL OR contains(response, 'Rated 9'))",
    2: "(response IS NULL OR contains(response, 'No level'))",
    3: "(response IS NULL OR contains(response, 'level: 6'))",
}
CHAIN_REPLIES_SQL = {
    1: "CASE WHEN contains(response, 'ESI level') THEN 'True' ELSE 'False' END",
    2: "CASE WHEN contains(response, 'esi LEVEL') THEN 'True' ELSE 'False' END",
    3: (
        "CASE WHEN contains(response, '2024') THEN '2'"
        " WHEN contains(response, 'No level') THEN '1' ELSE '0' END"
    ),
}


def _format_reply(prompt: str):
    text = input_of(prompt)
    if "Format 1" in prompt:
        return str("ESI level" in text)
    if "Format 2" in prompt:
        return str("esi LEVEL" in text)
    if "level: 6" in text:
        return ValueError("no such level")
    return "2" if "2024" in text else "1" if "No level" in text else "0"


def _analysis(prompt: str):
    """Fails all views of an empty case, view 1 alone of one text and view 2 alone of another."""
    text = input_of(prompt)
    if text == "None" or ("View 1" in prompt and "Rated 9" in text) or ("View 2" in prompt and "No level" in text):
        return ValueError("no analysis")
    return f"Case: {text}"


def load_analysis_stub():
    return lambda prompts, attempt: [_analysis(p) for p in prompts]


def load_format_stub():
    return lambda prompts, attempt: [_format_reply(p) for p in prompts]
