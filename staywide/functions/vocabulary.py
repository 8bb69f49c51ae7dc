"""The drug, unit, order, procedure and prompt vocabularies.

Everything in this module is a fixed value that results depend on. Rows of the
raw tables are compared with these strings exactly as they are written here.
"""

# Drugs found anywhere in a dispensed name, any letter case.
TIER1_CONTAINS = (
    "epinephrine",
    "norepinephrine",
    "vasopressin",
    "dopamine",
    "dobutamine",
    "phenylephrine",
    "isoproterenol",
    "atropine",
    "tenecteplase",
    "alteplase",
)
TIER2_CONTAINS = (
    "nicardipine",
    "sodium nitroprusside",
    "esmolol",
    "milrinone",
    "dextrose 50",
    "naloxone",
    "calcium gluconate",
    "calcium chloride",
    "sodium bicarbonate",
)
# Tier 2 names that must be the whole dispensed name, any letter case.
TIER2_EQUALS = (
    "Labetalol",
    "Labetalol 100mg/20mL 20mL VIAL",
    "Nitroglycerin",
    "Nitroglycerin SL",
    "Nitroglycerin SL 0.3mg BTL",
    "Nitroglycerin SL 0.4mg BTL",
)
TIER3_CONTAINS = (
    "procainamide",
    "amiodarone",
    "ibutilide",
    "heparin",
    "insulin",
    "albuterol",
)
TIER4_CONTAINS = (
    "etomidate",
    "ketamine",
    "propofol",
    "metoprolol",
    "diltiazem",
    "adenosine",
    "digoxin",
    "hydralazine",
    "labetalol",
    "nitroglycerin",
)
# Drug and dose form that must both occur in the dispensed name.
PSYCHOTROPIC_PAIRS = (
    ("haloperidol", "5mg/1mL 1mL VIAL"),
    ("lorazepam", "2mg/1mL 1mL SYR"),
    ("olanzapine", "10mg VIAL"),
)

# Care units.
SURGERY_UNITS = (
    "Cardiac Surgery",
    "Cardiology Surgery Intermediate",
    "Medical/Surgical (Gynecology)",
    "Surgery",
    "Surgery/Pancreatic/Biliary/Bariatric",
    "Surgery/Trauma",
    "Thoracic Surgery",
    "Med/Surg",
    "Med/Surg/GYN",
    "Med/Surg/Trauma",
)
ICU_UNITS = (
    "Cardiac Vascular Intensive Care Unit (CVICU)",
    "Coronary Care Unit (CCU)",
    "Medical Intensive Care Unit (MICU)",
    "Medical/Surgical Intensive Care Unit (MICU/SICU)",
    "Neuro Intermediate",
    "Neuro Stepdown",
    "Neuro Surgical Intensive Care Unit (Neuro SICU)",
    "Surgical Intensive Care Unit (SICU)",
    "Trauma SICU (TSICU)",
)

# Order types and subtypes.
VENTILATOR_ORDER = "Mechanical Ventilation"
NON_INVASIVE_ORDERS = ("BiPAP", "CPAP for OSA")
RED_CELL_ORDER = "Red Cell Product Order"
EARLY_TRANSFUSION_ORDERS = (
    "Frozen Plasma Product Order",
    "Platelet Product Order",
    "Red Cell Product Order",
)
LATE_TRANSFUSION_ORDERS = (
    "Frozen Plasma Product Order",
    "Platelet Product Order",
    "Red Cell Product Order",
    "Cryoprecipitate Product Order",
)
CONSULT_ORDER_TYPE = "Consults"

# Dispositions.
TRANSFER_DISPOSITION = "TRANSFER"
EXPIRED_DISPOSITION = "EXPIRED"

# Administration route of a drug -> count column of a stay.
ROUTES = (
    ("intravenous fluids", "intravenous_fluids"),
    ("intravenous", "intravenous"),
    ("intramuscular", "intramuscular"),
    ("nebulized medications", "nebulized_medications"),
    ("oral medications", "oral_medications"),
)

# Procedure codes of an intraosseous line.
INTRAOSSEOUS_CODES = ("4192", "07HT33Z", "07HT03Z")

# Procedure codes of the critical procedures.
CRITICAL_PROCEDURE_CODES = (
    # central line, ICD-9
    "3893", "3895", "3897", "8962",
    # central line, ICD-10
    "05H503Z", "05H50DZ", "05H533Z", "05H53DZ", "05H543Z", "05H54DZ",
    "05H603Z", "05H60DZ", "05H633Z", "05H63DZ", "05H643Z", "05H64DZ",
    "05H703Z", "05H70DZ", "05H733Z", "05H73DZ", "05H743Z", "05H74DZ",
    "05H803Z", "05H80DZ", "05H833Z", "05H83DZ", "05H843Z", "05H84DZ",
    "05HB03Z", "05HB0DZ", "05HB33Z", "05HB3DZ", "05HB43Z", "05HB4DZ",
    "05HC03Z", "05HC0DZ", "05HC33Z", "05HC3DZ", "05HC43Z", "05HC4DZ",
    "05HD03Z", "05HD0DZ", "05HD33Z", "05HD3DZ", "05HD43Z", "05HD4DZ",
    "05HF03Z", "05HF0DZ", "05HF33Z", "05HF3DZ", "05HF43Z", "05HF4DZ",
    "05HM03Z", "05HM0DZ", "05HM33Z", "05HM3DZ", "05HM43Z", "05HM4DZ",
    "05HN03Z", "05HN0DZ", "05HN33Z", "05HN3DZ", "05HN43Z", "05HN4DZ",
    "05HP03Z", "05HP0DZ", "05HP33Z", "05HP3DZ", "05HP43Z", "05HP4DZ",
    "05HQ03Z", "05HQ0DZ", "05HQ33Z", "05HQ3DZ", "05HQ43Z", "05HQ4DZ",
    "06H003Z", "06H00DZ", "06H033Z", "06H03DZ", "06H043Z", "06H04DZ",
    # arterial line, ICD-9
    "3891", "8960", "8961",
    # paracentesis, ICD-10
    "0W9G00Z", "0W9G0ZX", "0W9G0ZZ", "0W9G30Z", "0W9G3ZX", "0W9G3ZZ",
    "0W9G40Z", "0W9G4ZX", "0W9G4ZZ",
    # thoracentesis, ICD-10
    "0W993ZX", "0W993ZZ", "0W994ZX", "0W994ZZ", "0W9B3ZX", "0W9B3ZZ",
    "0W9B4ZX", "0W9B4ZZ",
    # tube thoracostomy, ICD-10
    "0W9900Z", "0W9930Z", "0W9940Z", "0W9B00Z", "0W9B30Z", "0W9B40Z",
    # lumbar puncture, ICD-10
    "00JU0ZZ", "00JU3ZZ", "00JU4ZZ",
)

# The three-section instruction template, as prefix and separators.
PROMPT_INTRO = (
    "Below is an instruction that describes a task, paired with an input that "
    "provides further context. Write a response that appropriately completes the "
    "request."
)
PROMPT_INSTRUCTION_HEAD = "\n\n### Instruction:\n"
PROMPT_INPUT_HEAD = "\n\n### Input:\n"
PROMPT_RESPONSE_HEAD = "\n\n### Response:\n"
# Fixed value: some runs end the template with a line break and four blanks.
PROMPT_PADDED_TAIL = "\n    "

# Fixed value: heading of a generated practice case.
CASE_HEADING = "### ESI Triage Practice"

# Labels in front of a stated level, in order of preference.
LEVEL_LABELS = ("esi level:", "esi:")

# Sampling settings of a chat request.
CHAT_SETTINGS = {
    "temperature": 0,
    "top_p": 1,
    "frequency_penalty": 0,
    "presence_penalty": 0,
}
CHAT_MODEL = "gpt-4o"
CHAT_MAX_TOKENS = 2048
# Envelope of a single-query request.
QUERY_RESPONSE_MODE = "blocking"
QUERY_USER = "system"

# Fixed value: the prediction of a case whose answers could not be used.
FAILED_LEVEL = -1
