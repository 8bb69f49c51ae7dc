"""The clinical and model-output tables, derived from the driver's test tables.

One text per view serves Spark and DuckDB. Names in braces are the tables a view reads.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

# The view texts.
VIEWS = {
    "fx_edstays": """
        SELECT event_id AS stay_id, user_id AS subject_id,
               CASE WHEN event_id % 4 = 0 THEN NULL ELSE user_id * 10 + CAST(floor(day(ts) / 10) AS INT) END AS hadm_id,
               ts AS intime, ts + (30 + event_id % 600) * INTERVAL '1' MINUTE AS outtime,
               CASE WHEN event_id % 2 = 0 THEN 'F' ELSE 'M' END AS gender,
               CASE event_id % 3 WHEN 0 THEN 'WHITE' WHEN 1 THEN 'ASIAN' ELSE 'OTHER' END AS race,
               CASE event_id % 3 WHEN 0 THEN 'AMBULANCE' WHEN 1 THEN 'WALK IN' ELSE 'UNKNOWN' END AS arrival_transport,
               CASE CAST(regexp_extract(props, '[0-9]+', 0) AS INT) % 10
                    WHEN 0 THEN 'EXPIRED' WHEN 1 THEN 'TRANSFER' WHEN 2 THEN 'ADMITTED' ELSE 'HOME' END AS disposition
        FROM {events} WHERE event_type = 'signup'
    """,
    "fx_triage": """
        SELECT stay_id, subject_id, CAST(96 + stay_id % 8 AS DOUBLE) AS temperature, CAST(60 + stay_id % 80 AS DOUBLE) AS heartrate,
               CAST(12 + stay_id % 15 AS DOUBLE) AS resprate, CAST(88 + stay_id % 12 AS DOUBLE) AS o2sat, CAST(90 + stay_id % 90 AS DOUBLE) AS sbp,
               CAST(50 + stay_id % 50 AS DOUBLE) AS dbp,
               CASE WHEN stay_id % 13 = 0 THEN 'unable' ELSE CAST(stay_id % 11 AS VARCHAR(10)) END AS pain,
               CASE WHEN stay_id % 29 = 0 THEN NULL ELSE CAST(stay_id % 5 + 1 AS INT) END AS acuity,
               CASE stay_id % 4 WHEN 0 THEN 'Chest pain' WHEN 1 THEN 'Abd pain, N/V' WHEN 2 THEN 'Dyspnea' ELSE 'Fall' END AS chiefcomplaint
        FROM {fx_edstays} WHERE stay_id % 10 <> 0
    """,
    "fx_poe": """
        SELECT CAST(user_id AS VARCHAR(20)) || '-' || CAST(event_id AS VARCHAR(20)) AS poe_id, user_id AS subject_id, user_id * 10 + CAST(floor(day(ts) / 10) AS INT) AS hadm_id, ts AS ordertime,
               CASE WHEN event_id % 5 = 0 THEN 'Consults' WHEN event_id % 5 = 1 THEN 'Respiratory' ELSE 'Blood Bank' END AS order_type,
               CASE event_id % 8 WHEN 0 THEN 'Mechanical Ventilation' WHEN 1 THEN 'BiPAP' WHEN 2 THEN 'CPAP for OSA'
                    WHEN 3 THEN 'Red Cell Product Order' WHEN 4 THEN 'Platelet Product Order' WHEN 5 THEN 'Frozen Plasma Product Order'
                    WHEN 6 THEN 'Cryoprecipitate Product Order' ELSE NULL END AS order_subtype
        FROM {events} WHERE event_type <> 'signup'
    """,
    "fx_transfers": """
        SELECT event_id AS transfer_id, user_id AS subject_id, user_id * 10 + CAST(floor(day(ts) / 10) AS INT) AS hadm_id, ts AS intime,
               CASE event_id % 6 WHEN 0 THEN 'Medical Intensive Care Unit (MICU)' WHEN 1 THEN 'Trauma SICU (TSICU)' WHEN 2 THEN 'Med/Surg'
                    WHEN 3 THEN 'Cardiac Surgery' WHEN 4 THEN 'Neuro Stepdown' ELSE 'Emergency Department' END AS careunit
        FROM {events} WHERE event_type IN ('view', 'error')
    """,
    "fx_procedures_icd": """
        SELECT user_id AS subject_id, user_id * 10 + CAST(floor(day(ts) / 10) AS INT) AS hadm_id, CAST(ts AS DATE) AS chartdate,
               CASE event_id % 7 WHEN 0 THEN '4192' WHEN 1 THEN '07HT33Z' WHEN 2 THEN '3893' WHEN 3 THEN '0W9G30Z'
                    WHEN 4 THEN '00JU3ZZ' ELSE '9999' END AS icd_code,
               CASE WHEN event_id % 7 IN (0, 2) THEN 9 ELSE 10 END AS icd_version
        FROM {events} WHERE event_type = 'click'
    """,
    "fx_patients": """
        SELECT DISTINCT user_id AS subject_id, CAST(18 + user_id % 70 AS INT) AS anchor_age, CAST(2020 + user_id % 4 AS INT) AS anchor_year
        FROM {events} WHERE user_id % 7 <> 0
    """,
    "fx_pyxis": """
        SELECT s.subject_id, s.stay_id, s.intime + (r.r_regionkey * 40 + s.stay_id % 50) * INTERVAL '1' MINUTE AS charttime,
               CASE (s.stay_id + r.r_regionkey * 7) % 20
                    WHEN 0 THEN 'EPINEPHrine 1mg/mL' WHEN 1 THEN 'Norepinephrine 4mg' WHEN 2 THEN 'Phenylephrine 10mg' WHEN 3 THEN 'Alteplase 100mg'
                    WHEN 4 THEN 'labetalol' WHEN 5 THEN 'Labetalol 200mg TAB' WHEN 6 THEN 'NITROGLYCERIN SL' WHEN 7 THEN 'Dextrose 50% 50mL SYR'
                    WHEN 8 THEN 'Naloxone 0.4mg' WHEN 9 THEN 'Heparin 5000u' WHEN 10 THEN 'Insulin REGULAR' WHEN 11 THEN 'Albuterol NEB'
                    WHEN 12 THEN 'Ketamine 500mg' WHEN 13 THEN 'Propofol 10mg' WHEN 14 THEN 'Haloperidol 5mg/1mL 1mL VIAL'
                    WHEN 15 THEN 'LORazepam 2mg/1mL 1mL SYR' WHEN 16 THEN 'Lorazepam 1mg TAB' WHEN 17 THEN 'OLANZapine 10mg VIAL'
                    WHEN 18 THEN 'Acetaminophen 325mg TAB' ELSE 'Sodium Chloride 0.9% 1000mL' END AS name
        FROM {fx_edstays} s JOIN {region} r ON r.r_regionkey < s.stay_id % 5
    """,
    "fx_pyxis_admin_method": """
        SELECT DISTINCT p.name AS drug_name, t.admin_method FROM {fx_pyxis} p JOIN (VALUES ('Sodium Chloride 0.9% 1000mL', 'intravenous fluids'), ('Heparin 5000u', 'intravenous'),
          ('Insulin REGULAR', 'intravenous'), ('Insulin REGULAR', 'intramuscular'), ('Haloperidol 5mg/1mL 1mL VIAL', 'intramuscular'),
          ('Albuterol NEB', 'nebulized medications'), ('Acetaminophen 325mg TAB', 'oral medications'),
          ('Lorazepam 1mg TAB', 'oral medications'), ('NITROGLYCERIN SL', 'sublingual')) AS t(drug_name, admin_method)
          ON t.drug_name = p.name
    """,
    "fx_labevents": """
        SELECT event_id AS labevent_id, user_id AS subject_id, CASE WHEN event_id % 11 = 0 THEN NULL ELSE ts END AS charttime
        FROM {events} WHERE event_type IN ('error', 'click')
    """,
    "fx_microbiologyevents": """
        SELECT event_id AS microevent_id, user_id AS subject_id, ts AS charttime FROM {events} WHERE event_type = 'view'
    """,
    "fx_radiology": """
        SELECT CASE WHEN event_id % 9 = 0 THEN NULL ELSE 'RR-' || CAST(event_id AS VARCHAR(20)) END AS note_id, user_id AS subject_id, ts AS charttime
        FROM {events} WHERE event_type = 'purchase'
    """,
    "fx_predictions": """
        SELECT o_orderkey AS case_id, 'run_' || o_orderstatus AS run_name, CAST(o_orderkey % 5 + 1 AS INT) AS acuity,
               CAST(CASE WHEN o_orderkey % 17 = 0 THEN -1 WHEN o_orderkey % 3 = 0 THEN (o_orderkey * 7) % 5 + 1
                    WHEN o_orderkey % 11 = 0 THEN least(5, o_orderkey % 5 + 2) ELSE o_orderkey % 5 + 1 END AS INT) AS final_pred
        FROM {orders}
    """,
    "fx_llm_outputs": """
        SELECT o_orderkey AS case_id,
               CASE o_orderkey % 6 WHEN 0 THEN 'Two labs, 1 ECG. ESI level: ' || CAST(o_orderkey % 7 AS VARCHAR(10)) WHEN 1 THEN 'No level given.'
                    WHEN 2 THEN 'ESI: 3 (was seen in 2024 at 10:45)' WHEN 3 THEN 'esi LEVEL: 2. Rated 9/10' WHEN 4 THEN NULL ELSE '' END AS response,
               CASE WHEN o_orderkey % 5 = 0 THEN 'True' WHEN o_orderkey % 5 = 1 THEN 'true' ELSE 'False' END AS llm1_format,
               CASE WHEN o_orderkey % 3 = 0 THEN 'True' WHEN o_orderkey % 3 = 1 THEN 'False' ELSE NULL END AS llm2_format,
               CASE o_orderkey % 7 WHEN 0 THEN '0' WHEN 1 THEN '1' WHEN 2 THEN '2' WHEN 3 THEN '4' WHEN 4 THEN '1.5' WHEN 5 THEN 'three' ELSE NULL END AS llm3_format
        FROM {orders}
    """,
    "fx_instructions": """
        SELECT u.conv_id, u.turn, 'Answer the user.' AS instruction, u.text AS input, a.text AS output
        FROM {conversations} u JOIN {conversations} a ON a.conv_id = u.conv_id AND a.turn = u.turn + 1
        WHERE u.role = 'user' AND a.role = 'assistant'
    """,
}

# The dispenses again, for Spark: the comparison of region keys becomes an equality on
# the keys a stay reaches, so that the view is a hash join like every other one.
SPARK_VIEWS = {
    "fx_pyxis": VIEWS["fx_pyxis"].replace(
        "FROM {fx_edstays} s JOIN {region} r ON r.r_regionkey < s.stay_id % 5",
        "FROM (SELECT *, explode(filter(array(0, 1, 2, 3), k -> k < stay_id % 5)) AS k"
        " FROM {fx_edstays}) s JOIN {region} r ON r.r_regionkey = s.k",
    )
}


def reads(name: str) -> list[str]:
    """Tables a view reads, in order of first use."""
    return list(dict.fromkeys(re.findall(r"\{(\w+)\}", VIEWS[name])))


class Fixtures(dict):
    """Tables of a test-data folder by name, made on first use.

    `edstays` and the other clinical names give the derived views.
    """

    def __init__(self, spark: SparkSession, sf_dir: str):
        super().__init__()
        self.spark = spark
        self.sf_dir = sf_dir.rstrip("/")

    def __missing__(self, name: str) -> DataFrame:
        view = name if name in VIEWS else f"fx_{name}"
        if view in VIEWS:
            inputs = {table: self[table] for table in reads(view)}
            frame = self.spark.sql(SPARK_VIEWS.get(view, VIEWS[view]), **inputs)
        else:
            frame = self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")
        self[name] = frame
        return frame


def with_views(names, body: str) -> str:
    """`body` as one DuckDB statement over the named views and all they read."""
    ordered: list[str] = []

    def add(name: str) -> None:
        for table in reads(name):
            if table in VIEWS:
                add(table)
        if name not in ordered:
            ordered.append(name)

    for name in names:
        add(name)
    plain = {table: table for name in ordered for table in reads(name)}
    views = [f"{name} AS ({VIEWS[name].format(**plain).strip()})" for name in ordered]
    body = body.strip()
    if body.upper().startswith("WITH "):
        return "WITH " + ",\n".join(views) + ",\n" + body[5:]
    return "WITH " + ",\n".join(views) + "\n" + body if views else body
