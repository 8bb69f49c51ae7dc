"""The registered queries: each takes a session and a test-data folder."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import predicates as P
from ..functions import vocabulary as V
from ..functions.parsing import (
    chat_reply,
    esi_cascade,
    extract_case,
    parse_json_number,
    parse_json_result,
    parse_level,
    parse_true,
    query_reply,
)
from ..operators import evaluate as E
from ..operators import spans as S
from ..operators.model_batch import apply_model, apply_model_in_waves, no_wait, pending
from ..operators.tables import insert_if_absent, set_count, set_flag
from ..operators.voting import majority, majority_rows
from ..plans import features as features_plan
from ..plans import prompts as PR
from ..plans import resources as R
from ..plans import scoring, upkeep, wide
from ..sources import clinical, files, stored
from ..sources.workspace import scratch
from . import texts as T
from .fixtures import Fixtures

Query = Callable[[SparkSession, str], DataFrame]
REGISTRY: dict[str, Query] = {}


def query(name: str):
    def register(build: Callable[[Fixtures], DataFrame]):
        REGISTRY[name] = lambda spark, sf_dir: build(Fixtures(spark, sf_dir))
        return build

    return register


def c(name: str):
    return F.col(name)


# ---------------------------------------------------------------- scans and sinks


def _scan(table: str):
    query(f"scan_{table}")(lambda fx: fx[table])


for _table in (
    "edstays",
    "triage",
    "poe",
    "transfers",
    "procedures_icd",
    "patients",
    "pyxis",
    "pyxis_admin_method",
    "labevents",
    "microbiologyevents",
    "radiology",
):
    _scan(_table)


def _cases(fx: Fixtures) -> DataFrame:
    """Case rows whose text holds quotes, commas and line breaks."""
    text = F.concat(
        F.lit('Says "'),
        F.coalesce("chiefcomplaint", F.lit("nothing")),
        F.lit('", came by '),
        F.coalesce("arrival_transport", F.lit("")),
        F.lit(",\npain "),
        F.coalesce("pain", F.lit("?")),
    )
    return wide.base_stays(fx).select(
        c("stay_id").alias("case_id"), text.alias("triage_text"), "acuity"
    )


@query("csv_roundtrip_cases")
def _(fx):
    path = scratch(fx.spark, "cases")
    files.write_csv(_cases(fx), path)
    return files.read_cases(fx.spark, path)


@query("result_sink_roundtrip")
def _(fx):
    base = scratch(fx.spark, "results")
    rows = fx["fx_predictions"].select("case_id", "acuity", "final_pred")
    files.write_results(rows, base, "models/model", "20240101000000")
    ddl = "case_id BIGINT, acuity INT, final_pred INT"
    return files.read_runs(fx.spark, base, ddl, fmt="parquet")


@query("report_roundtrip")
def _(fx):
    path = scratch(fx.spark, "report")
    metrics = _rounded(E.evaluate(fx["fx_predictions"]))
    files.write_report(metrics, path)
    ddl = ", ".join(f"{name} {kind}" for name, kind in metrics.dtypes)
    return files.read_csv(fx.spark, path, ddl)


@query("prompt_templates")
def _(fx):
    path = scratch(fx.spark, "templates")
    named = [(f"view_{view}", text) for view, text in T.ANALYSIS.items()]
    files.write_templates(fx.spark.createDataFrame(named, "name STRING, value STRING"), path)
    rows = fx["fx_llm_outputs"].select("case_id", "response", F.explode(F.array(*map(F.lit, T.ANALYSIS))).alias("view"))
    fanned = PR.with_template(rows, files.read_templates(fx.spark, path), F.concat(F.lit("view_"), "view"))
    prompt = F.concat("instruction", F.coalesce("response", F.lit("None")))
    return fanned.select("case_id", "view", prompt.alias("prompt"))


@query("checkpoint_resume")
def _(fx):
    path = scratch(fx.spark, "checkpoint")
    cases = _stub_cases(fx)

    def answer(rows, load, number):
        done = apply_model(
            rows,
            "prompt",
            load,
            wait=no_wait,
            on_failure="null",
            partitions=_model_tasks(fx),
        )
        return done.select("case_id", "response", F.lit(number).alias("pass"))

    files.write_checkpoint(answer(cases, T.load_stub, 1), path)
    ddl = "case_id BIGINT, response STRING, pass INT"
    left = pending(cases, files.read_checkpoint(fx.spark, path, ddl))
    files.write_checkpoint(answer(left, T.load_patient_stub, 2), path)
    return files.read_checkpoint(fx.spark, path, ddl).where(c("response").isNotNull())


@query("eval_all_runs")
def _(fx):
    base = scratch(fx.spark, "runs")
    files.write_runs(
        fx["fx_predictions"].select("case_id", "acuity", "final_pred", "run_name"), base, "csv"
    )
    runs = files.read_runs(fx.spark, base, "case_id BIGINT, acuity INT, final_pred INT")
    return _rounded(E.evaluate(runs, ["run_name"]))


@query("eval_flat_runs")
def _(fx):
    base = scratch(fx.spark, "flat-runs")
    rows = fx["fx_predictions"]
    files.write_runs(rows.where("case_id % 2 = 0").select("case_id", "acuity", "final_pred", "run_name"), f"{base}/one", "csv")
    more = rows.where("case_id % 2 <> 0").withColumn("llm1_resp", F.lit('says "3",\nno more'))
    files.write_runs(more.select("final_pred", "llm1_resp", "acuity", "case_id", "run_name"), f"{base}/three", "csv")
    runs = files.read_runs(fx.spark, f"{base}/*/*/*.csv", "case_id BIGINT, acuity INT, final_pred INT", flat=True)
    return _rounded(E.evaluate(runs, ["run_name"]))


# ------------------------------------------------------- predicates and expressions


@query("pred_category")
def _(fx):
    unit = c("careunit")
    return (
        fx["transfers"]
        .where(unit != "Emergency Department")
        .select(
            "transfer_id",
            unit.alias("unit"),
            unit.isin(*V.SURGERY_UNITS).alias("surgery"),
            unit.isin(*V.ICU_UNITS).alias("icu"),
        )
    )


@query("pred_time_range")
def _(fx):
    return fx["edstays"].selectExpr(
        "stay_id",
        f"{S.FIRST_HOUR.holds('outtime')} AS out_first_hour",
        f"{S.PAST_HOUR.holds('outtime')} AS out_later",
        f"{S.WEEK.end} AS week_end",
        f"{S.FIRST_TWO_HOURS.end} AS two_hours",
    )


@query("pred_calendar_day")
def _(fx):
    day_in, day_out = F.to_date("intime"), F.to_date("outtime")
    after = F.to_date(F.expr("outtime + INTERVAL '1' DAY"))
    return fx["edstays"].select(
        "stay_id",
        day_in.alias("day_in"),
        day_out.alias("day_out"),
        after.alias("day_after"),
        P.day_between(c("outtime"), c("intime"), c("intime")).alias("same_day"),
    )


@query("pred_date_vs_timestamp")
def _(fx):
    return fx["edstays"].select(
        "stay_id",
        F.to_date("outtime").between(c("intime"), c("outtime")).alias("day_out_inside"),
        F.to_date("intime").between(c("intime"), c("outtime")).alias("day_in_inside"),
    )


@query("pred_ilike")
def _(fx):
    name = c("name")
    return fx["pyxis"].select(
        "stay_id",
        "charttime",
        name,
        F.expr(P.is_tier1()).alias("tier1"),
        F.expr(P.is_tier2()).alias("tier2"),
        F.expr(P.is_tier3()).alias("tier3"),
        F.expr(P.is_tier4()).alias("tier4"),
        F.expr(P.is_psychotropic()).alias("psychotropic"),
        name.ilike("%dextrose 50%%").alias("dextrose"),
        name.ilike("Labetalol").alias("labetalol"),
    )


@query("expr_age")
def _(fx):
    age = P.age_at(c("intime"), c("anchor_age"), c("anchor_year"))
    return fx["edstays"].join(fx["patients"], "subject_id").select("stay_id", age.alias("age"))


@query("expr_case_coalesce")
def _(fx):
    return wide.base_stays(fx).select(
        "stay_id",
        P.zero_if_null(c("acuity")).alias("acuity"),
        F.when(c("arrival_transport") == "AMBULANCE", 1).otherwise(0).alias("by_ambulance"),
    )


@query("ensure_columns")
def _(fx):
    rows = fx["triage"].select("stay_id", "acuity")
    rows = P.ensure_columns(rows, {"acuity": "int", "final_pred": "int", "llm_resp": "string"})
    return P.with_default(rows, "flag", 0)


@query("pred_any_positive")
def _(fx):
    any_route = P.any_positive(*[c(name) for name in R.ROUTE_COLUMNS])
    return R.drug_route_counts(fx).select("stay_id", any_route.alias("any_route"))


# ------------------------------------------------------------------------- joins


@query("base_stay_triage")
def _(fx):
    return wide.base_stays(fx)


@query("interval_join_subject")
def _(fx):
    stays = fx["edstays"].select("stay_id", "subject_id", "intime", "outtime")
    orders = fx["poe"].select("subject_id", "poe_id", "ordertime", "order_type")
    pairs = S.interval_join(stays, orders, ["subject_id"], "ordertime", S.IN_STAY)
    return pairs.select("stay_id", "poe_id", "ordertime", "order_type")


@query("interval_join_admission")
def _(fx):
    stays = fx["edstays"].select("stay_id", "subject_id", "hadm_id", "intime", "outtime")
    moves = fx["transfers"].select(
        "subject_id", "hadm_id", "transfer_id", "careunit", c("intime").alias("moved")
    )
    keys = ["subject_id", "hadm_id"]
    pairs = S.interval_join(stays, moves, keys, "moved", S.PAST_HOUR_IN_STAY)
    return pairs.select("stay_id", "transfer_id", "careunit")


@query("interval_join_stay")
def _(fx):
    stays = fx["edstays"].select("stay_id", "intime", "outtime")
    dispensed = fx["pyxis"].select("stay_id", "charttime", "name")
    pairs = S.interval_join(stays, dispensed, ["stay_id"], "charttime", S.IN_STAY)
    return pairs.select("stay_id", "charttime", "name")


def _feature(fx, column: str, among=None) -> DataFrame:
    chosen = [f for f in among or features_plan.FEATURES if f.column == column]
    return features_plan.feature(fx, chosen[0])


def _flagged(fx, column: str) -> DataFrame:
    return _feature(fx, column).where(c(column) == 1).select("stay_id")


@query("two_event_semi")
def _(fx):
    return _flagged(fx, "transfer_to_surgery_beyond_1h")


@query("lookup_fanout")
def _(fx):
    return R.drug_routes(fx)


@query("flag_update")
def _(fx):
    column = "tier1_med_usage_1h"
    return set_flag(fx["edstays"], _flagged(fx, column), "stay_id", column)


@query("count_update")
def _(fx):
    column = "lab_event_count"
    counts = R.resource_counts(fx, [column]).where(c(column) > 0)
    return set_count(fx["edstays"], counts, "stay_id", column)


@query("scalar_count")
def _(fx):
    stays = fx["edstays"].select("stay_id")
    return set_count(stays, R.procedures_by_day(fx), "stay_id", "procedure_count")


@query("existence_filter")
def _(fx):
    known = fx["patients"].select("subject_id")
    return fx["edstays"].join(known, "subject_id", "left_semi").select("stay_id", "subject_id")


@query("zero_count_keep")
def _(fx):
    counts = [R.RESOURCES["microbio_event_count"]]
    counted = features_plan.with_counts(fx["edstays"], fx, counts)
    n = P.zero_if_null(c("microbio_event_count")).alias("microbio_event_count")
    return counted.select("stay_id", "intime", n)


@query("semi_stays")
def _(fx):
    return R.stays_with(fx, "lab_event_count")


@query("insert_if_absent")
def _(fx):
    def counts(column):
        found = R.resource_counts(fx, [column]).where(c(column) > 0)
        return found.withColumnRenamed(column, "n")

    return insert_if_absent(
        counts("lab_event_count"), counts("microbio_event_count"), "stay_id"
    )


def _store(df: DataFrame, key: str) -> str:
    path = scratch(df.sparkSession, "stored")
    stored.create(df, path, [key], stored.buckets_for(df))
    return path


@query("stored_flag_update")
def _(fx):
    column = "tier1_med_usage_1h"
    path = _store(fx["edstays"].withColumn(column, F.lit(0)), "stay_id")
    hits = _flagged(fx, column).select("stay_id", F.lit(1).alias(column)).distinct()
    stored.merge(fx.spark, path, hits, insert=False)
    return stored.read(fx.spark, path)


@query("stored_count_update")
def _(fx):
    column = "lab_event_count"
    path = _store(fx["edstays"].withColumn(column, F.lit(0).cast("long")), "stay_id")
    counts = R.resource_counts(fx, [column]).where(c(column) > 0)
    stored.merge(fx.spark, path, counts.select("stay_id", column), insert=False)
    return stored.read(fx.spark, path)


@query("stored_insert_if_absent")
def _(fx):
    def counts(column):
        found = R.resource_counts(fx, [column]).where(c(column) > 0)
        return found.withColumnRenamed(column, "n")

    path = _store(counts("lab_event_count"), "stay_id")
    stored.merge(fx.spark, path, counts("microbio_event_count"), update=False)
    return stored.read(fx.spark, path)


# ------------------------------------------------------------------ aggregations


@query("distinct_stays")
def _(fx):
    return fx["pyxis"].select("stay_id").distinct()


@query("drug_counts")
def _(fx):
    return R.drug_counts(fx)


@query("drug_route_pivot")
def _(fx):
    """The five sums over the fanned-out rows, as the definition states them."""
    sums = [
        F.sum(F.when(c("admin_method") == route, c("count")).otherwise(0)).alias(column)
        for route, column in V.ROUTES
    ]
    return R.drug_routes(fx).groupBy("stay_id").agg(*sums)


@query("qc_feature_totals")
def _(fx):
    return wide.feature_totals(wide.wide_table(fx))


@query("qc_positive_counts")
def _(fx):
    return wide.positive_counts(wide.wide_table(fx))


@query("critical_procedure_code")
def _(fx):
    return features_plan.critical_procedure_codes(fx)


@query("red_cell_order_counts")
def _(fx):
    return features_plan.red_cell_orders(fx)


@query("majority_vote")
def _(fx):
    vote = majority(c("llm1_format"), c("llm2_format"), c("llm3_format"))
    return fx["fx_llm_outputs"].select("case_id", vote.alias("final_pred"))


@query("majority_vote_rows")
def _(fx):
    views = F.posexplode(F.array("llm1_format", "llm2_format", "llm3_format")).alias("position", "answer")
    return majority_rows(fx["fx_llm_outputs"].select("case_id", views), ["case_id"])


# ----------------------------------------------------------- features, resources


def _register_features():
    for f in [*features_plan.FEATURES, features_plan.ICU_WITHIN_HOUR]:
        query(f"feature_{f.column}")(lambda fx, f=f: features_plan.feature(fx, f))
    for f in features_plan.VARIANTS:
        query(f"feature_{f.column}__count")(lambda fx, f=f: features_plan.feature(fx, f))


_register_features()


def _register_counts():
    for name, column in {
        "count_lab_event": "lab_event_count",
        "count_microbio_event": "microbio_event_count",
        "count_procedures": "procedure_count",
    }.items():
        query(name)(lambda fx, column=column: R.resource_counts(fx, [column]))


_register_counts()


@query("count_exam")
def _(fx):
    return R.exam_counts(fx)


@query("count_drug_routes")
def _(fx):
    return R.drug_route_counts(fx)


@query("count_consults")
def _(fx):
    return R.consult_counts(fx)


@query("stay_procedures")
def _(fx):
    return R.stay_procedures(fx)


@query("wide_table")
def _(fx):
    return wide.wide_table(fx)


@query("wide_sink_roundtrip")
def _(fx):
    path = scratch(fx.spark, "wide")
    clinical.write_wide(wide.wide_table(fx), path)
    return fx.spark.read.parquet(path)


@query("wide_sink_totals")
def _(fx):
    return wide.write_with_totals(wide.wide_table(fx), scratch(fx.spark, "wide"))


@query("wide_table_upkeep")
def _(fx):
    # An eighth of the stays, and of the events of each kind, arrives after the table was stored.
    late = {"edstays": c("stay_id") % 8 == 0, "triage": c("stay_id") % 8 == 0}
    for name, when in {"pyxis": "charttime", "poe": "ordertime", "transfers": "intime", "procedures_icd": "chartdate",
                       "labevents": "charttime", "microbiologyevents": "charttime", "radiology": "charttime"}.items():
        late[name] = F.pmod(F.xxhash64("subject_id", F.to_date(when)), F.lit(8)) == 0
    before = {name: fx[name] for name in ("patients", "pyxis_admin_method")}
    before |= {name: fx[name].where(~F.coalesce(is_late, F.lit(False))) for name, is_late in late.items()}
    path = scratch(fx.spark, "wide-kept")
    upkeep.create(before, path)
    upkeep.refresh(fx.spark, fx, {name: fx[name].where(is_late) for name, is_late in late.items()}, path)
    return stored.read(fx.spark, path)


@query("resource_type_count")
def _(fx):
    counts = R.resource_counts(fx, list(R.RESOURCES))
    return R.resource_type_count(counts)


# ------------------------------------------------------------ texts, model batches


@query("render_prompt")
def _(fx):
    return PR.render_prompt(fx["fx_llm_outputs"], T.ONE_STEP, "response").select(
        "case_id", "prompt"
    )


@query("prompt_fan_out")
def _(fx):
    fanned = PR.fan_out(fx["fx_llm_outputs"].select("case_id", "response"), T.ANALYSIS)
    rendered = PR.render_prompt(fanned, c("instruction"), "response", tail="")
    return rendered.select("case_id", "view", "prompt")


@query("format_sft")
def _(fx):
    return PR.format_sft(fx["fx_instructions"], T.EOS).select("conv_id", "turn", "text")


@query("format_sft_file")
def _(fx):
    path = scratch(fx.spark, "instructions")
    files.write_csv(fx["fx_instructions"].select("instruction", "input", "output"), path)
    return PR.format_sft(files.read_instructions(fx.spark, path), T.EOS).select("text")


@query("format_sft_qa")
def _(fx):
    renamed = fx["fx_instructions"].withColumnsRenamed(
        dict(zip(PR.INSTRUCTION_COLUMNS, PR.QUESTION_COLUMNS))
    )
    return PR.format_sft(renamed, T.EOS, PR.QUESTION_COLUMNS).select("conv_id", "turn", "text")


@query("format_cpt")
def _(fx):
    return PR.format_cpt(fx["documents"], "text", T.EOS).select("doc_id", "text")


@query("chat_request")
def _(fx):
    built = PR.build_chat_request(fx["conversations"], T.SYSTEM, "text")
    first, second = c("request.messages")[0], c("request.messages")[1]
    return built.select(
        "conv_id",
        "turn",
        "request.model",
        first["role"].alias("role_1"),
        first["content"].alias("content_1"),
        second["role"].alias("role_2"),
        second["content"].alias("content_2"),
        *[c(f"request.{name}").alias(name) for name in (*V.CHAT_SETTINGS, "max_tokens")],
    )


@query("query_request")
def _(fx):
    built = PR.build_query_request(fx["conversations"], "text")
    names = ("query", "response_mode", "conversation_id", "user")
    return built.select("conv_id", "turn", *[c(f"request.{n}").alias(n) for n in names])


@query("extract_reply")
def _(fx):
    message = F.struct(PR.message("assistant", c("text")).alias("message"))
    chat = F.to_json(F.struct(F.array(message).alias("choices")))
    answer = F.to_json(F.struct(c("text").alias("answer")))
    return fx["conversations"].select(
        "conv_id",
        "turn",
        chat_reply(chat).alias("chat_content"),
        query_reply(answer).alias("query_answer"),
    )


def _stub_cases(fx: Fixtures) -> DataFrame:
    rows = fx["fx_llm_outputs"].select("case_id", "response")
    rendered = PR.render_prompt(rows, T.ONE_STEP, "response", tail="")
    return rendered.select("case_id", "prompt")


def _model_tasks(fx: Fixtures) -> int:
    """Model calls are the costly part, so their rows are spread over all cores."""
    return fx.spark.sparkContext.defaultParallelism


def _apply_stub(fx: Fixtures, on_failure: str) -> DataFrame:
    done = apply_model(
        _stub_cases(fx),
        "prompt",
        T.load_stub,
        wait=no_wait,
        on_failure=on_failure,
        partitions=_model_tasks(fx),
    )
    return done.drop("prompt")


@query("apply_model_stub")
def _(fx):
    return _apply_stub(fx, "sentinel")


@query("apply_model_null")
def _(fx):
    return _apply_stub(fx, "null")


@query("apply_model_waves")
def _(fx):
    path = scratch(fx.spark, "waves")
    done = apply_model_in_waves(_stub_cases(fx), "prompt", T.load_stub, path, wait=no_wait, partitions=_model_tasks(fx))
    return done.drop("prompt")


@query("parse_level")
def _(fx):
    return fx["fx_llm_outputs"].select("case_id", parse_level(c("response")).alias("level"))


@query("parse_level_documents")
def _(fx):
    return fx["documents"].select("doc_id", parse_level(c("text")).alias("level"))


@query("parse_level_labelled")
def _(fx):
    level = parse_level(c("response"), labelled=True)
    return fx["fx_llm_outputs"].select("case_id", level.alias("level"))


@query("parse_true")
def _(fx):
    return fx["fx_llm_outputs"].select(
        "case_id",
        parse_true(c("llm1_format")).alias("view1"),
        parse_true(c("llm2_format")).alias("view2"),
    )


@query("parse_json_result")
def _(fx):
    def payload(name, broken):
        text = F.concat(F.lit('{"result": '), F.lower(name), F.lit("}"))
        return F.when(broken, F.lit("The answer is true")).otherwise(text)

    rows = fx["fx_llm_outputs"].select(
        "case_id",
        payload("llm2_format", F.lit(False)).alias("with_null"),
        payload("llm1_format", c("llm1_format") == "true").alias("with_broken"),
    )
    return rows.select(
        "case_id",
        parse_json_result(c("with_null")).alias("result"),
        parse_json_result(c("with_broken")).alias("bare"),
    )


@query("parse_json_number")
def _(fx):
    number = parse_json_number(c("llm3_format"))
    return fx["fx_llm_outputs"].select("case_id", number.alias("number"))


@query("esi_cascade")
def _(fx):
    level = esi_cascade(
        parse_true(c("llm1_format")),
        parse_true(c("llm2_format")),
        parse_json_number(c("llm3_format")),
    )
    return fx["fx_llm_outputs"].select("case_id", level.alias("final_pred"))


@query("render_case_prompt")
def _(fx):
    fields = [(label, c(column)) for label, column in T.CASE_FIELDS]
    rendered = PR.render_case_prompt(wide.base_stays(fx), T.WRITE_CASE, fields)
    return rendered.select("stay_id", "prompt")


@query("extract_case")
def _(fx):
    generated = F.concat(F.lit(f"Step 4 is done.\n{V.CASE_HEADING}\n"), c("text"))
    return fx["documents"].select("doc_id", extract_case(generated).alias("case_text"))


def _chain_answers(fx) -> DataFrame:
    cases = fx["fx_llm_outputs"].select("case_id", c("response").alias("triage_text"))
    return scoring.chain(
        cases,
        "triage_text",
        T.ANALYSIS,
        T.FORMATS,
        T.load_analysis_stub,
        T.load_format_stub,
        wait=no_wait,
        partitions=_model_tasks(fx),
    )


@query("two_step_chain")
def _(fx):
    rows = scoring.levels(scoring.to_cases(_chain_answers(fx), ["case_id"]))
    return rows.select("case_id", "llm1_result", "llm2_result", "llm3_result", "final_pred")


@query("voting_run")
def _(fx):
    rows = scoring.voting(_chain_answers(fx), ["case_id"])
    return rows.select("case_id", "llm1_result", "llm2_result", "llm3_result", "final_pred")


@query("one_step_run")
def _(fx):
    cases = fx["fx_llm_outputs"].select("case_id", c("response").alias("triage_text"))
    rows = scoring.one_step(
        cases, "triage_text", T.ONE_STEP, T.load_stub, wait=no_wait, partitions=_model_tasks(fx)
    )
    return rows.select("case_id", "response", "attempts", "final_pred")


# --------------------------------------------------------------------- evaluation


def _rounded(metrics: DataFrame) -> DataFrame:
    return metrics.select(
        *[
            F.round(name, 9).alias(name) if kind == "double" else F.col(name)
            for name, kind in metrics.dtypes
        ]
    )


def _register_metrics():
    for name, columns in {
        "eval_accuracy": ["accuracy"],
        "eval_macro": ["macro_precision", "macro_recall", "macro_f1"],
        "eval_risk_groups": ["high_risk_recall", "moderate_f1", "non_urgent_precision"],
        "eval_triage_rates": [
            "over_triage_rate",
            "under_triage_rate",
            "over_triage_count",
            "under_triage_count",
        ],
        "eval_report": list(E.METRICS),
    }.items():
        query(name)(
            lambda fx, columns=columns: _rounded(E.evaluate(fx["fx_predictions"])).select(*columns)
        )


_register_metrics()


@query("eval_failed_count")
def _(fx):
    failed = c("final_pred") == V.FAILED_LEVEL
    valid = c("acuity").isNotNull() & (c("final_pred") != V.FAILED_LEVEL)
    return fx["fx_predictions"].agg(
        F.count_if(valid).alias("valid_predictions"),
        F.count_if(failed).alias("failed_predictions"),
    )


@query("eval_confusion")
def _(fx):
    return E.confusion(fx["fx_predictions"], ["run_name"])
