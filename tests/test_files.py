"""Sources and sinks: case files, results, reports, templates, catalog, file stream."""

import os

import pytest
from pyspark.sql import functions as F

from staywide.checks.fixtures import Fixtures
from staywide.operators import evaluate as E
from staywide.operators.model_batch import apply_model, no_wait, pending
from staywide.operators.tables import insert_if_absent, set_count, set_flag
from staywide.plans import wide as W
from staywide.sources import clinical, files, schemas
from staywide.sources.workspace import broadcast_if_small, scratch, shared_dir
from staywide.streaming.incremental import score_new_files

TEXTS = ['He said "no", then\nleft.', "plain", 'a,"b",c', None]


def test_clinical_tables_round_trip(spark, tmp_path):
    fx = Fixtures(spark, "/root/testdata/sf0.001")
    for name in schemas.CLINICAL:
        fx[name].write.parquet(str(tmp_path / name))
    loaded = clinical.load_clinical(spark, str(tmp_path))
    assert set(loaded) == set(schemas.CLINICAL)
    got = {r["stay_id"]: r for r in W.wide_table(loaded).collect()}
    want = {r["stay_id"]: r for r in W.wide_table(fx).collect()}
    assert got == want


def test_scan_reads_only_the_needed_columns(spark, tmp_path):
    fx = Fixtures(spark, "/root/testdata/sf0.001")
    fx["poe"].write.parquet(str(tmp_path / "poe"))
    poe = clinical.load_clinical(spark, str(tmp_path), ["poe"])["poe"]
    df = poe.where("order_subtype = 'BiPAP'").select("subject_id", "ordertime")
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(order_subtype,BiPAP)" in plan
    schema = plan[plan.index("ReadSchema") :]
    assert "order_type" not in schema and "hadm_id" not in schema


def test_clinical_tables_from_catalog(spark):
    rows = spark.createDataFrame([(1, "40", 2020)], "subject_id INT, anchor_age STRING, anchor_year INT")
    rows.createOrReplaceTempView("some_patients")
    loaded = clinical.clinical_from_catalog(spark, {"patients": "some_patients"})
    assert loaded["patients"].dtypes == [
        ("subject_id", "bigint"),
        ("anchor_age", "int"),
        ("anchor_year", "int"),
    ]


def test_stage_view_and_table(spark):
    df = spark.range(3)
    assert clinical.stage(df, "staged_ids").count() == 3
    assert clinical.stage(df, "staged_ids_kept", table=True).count() == 3
    assert clinical.stage(spark.range(2), "staged_ids_kept", table=True).count() == 2
    spark.sql("DROP TABLE staged_ids_kept")


def test_wide_sink(spark, tmp_path):
    path = str(tmp_path / "wide")
    for _ in range(2):
        clinical.write_wide(spark.range(5), path)
    assert spark.read.parquet(path).count() == 5


def test_case_csv_keeps_quotes_and_line_breaks(spark, tmp_path):
    path = str(tmp_path / "cases")
    rows = [(i, t, 3) for i, t in enumerate(TEXTS)]
    files.write_csv(spark.createDataFrame(rows, schemas.CASES), path)
    got = {r["case_id"]: r["triage_text"] for r in files.read_cases(spark, path).collect()}
    assert got == dict(enumerate(TEXTS))


def test_file_with_other_columns_is_refused(spark, tmp_path):
    path = tmp_path / "cases.csv"
    path.write_text("acuity,case_id,triage_text\n1,2,x\n")
    with pytest.raises(Exception, match="(?i)header|CSV"):
        files.read_cases(spark, str(path)).collect()


def test_flat_result_files_are_keyed_by_name(spark, tmp_path):
    for name, pred in (("exp1_a", 1), ("exp1_b", 2)):
        (tmp_path / f"{name}.csv").write_text(f'acuity,final_pred\n1,{pred}\n1,-1\n')
    runs = files.read_runs(
        spark, str(tmp_path / "exp*.csv"), "acuity INT, final_pred INT", flat=True
    )
    got = {r["run_name"]: r for r in E.evaluate(runs, ["run_name"]).collect()}
    assert got["exp1_a"]["accuracy"] == 1.0 and got["exp1_b"]["accuracy"] == 0.0
    assert got["exp1_b"]["failed_predictions"] == 1


def test_results_of_several_runs(spark, tmp_path):
    base = str(tmp_path / "results")
    df = spark.createDataFrame([(1, "a\nb")], "case_id BIGINT, llm_resp STRING")
    assert files.write_results(df, base, "org/model/", "20240101", "csv") == "model_20240101"
    files.write_results(df, base, "other", "20240102", "csv")
    runs = files.read_runs(spark, base, "case_id BIGINT, llm_resp STRING")
    assert {(r["run_name"], r["llm_resp"]) for r in runs.collect()} == {
        ("model_20240101", "a\nb"),
        ("other_20240102", "a\nb"),
    }


def test_report_file_and_templates(spark, tmp_path):
    df = spark.createDataFrame([(1, 1), (2, 3)], "acuity INT, final_pred INT")
    path = str(tmp_path / "report")
    files.write_report(E.report(E.evaluate(df)), path)
    parts = [p for p in os.listdir(path) if p.endswith(".csv")]
    assert len(parts) == 1
    (tmp_path / "prompts").mkdir()
    (tmp_path / "prompts" / "one.txt").write_text("line 1\nline 2\n")
    (tmp_path / "prompts" / "two.txt").write_text("x")
    loaded = {r["name"]: r["text"] for r in files.read_templates(spark, str(tmp_path / "prompts")).collect()}
    assert loaded == {"one": "line 1\nline 2\n", "two": "x"}


def test_values_that_are_no_numbers(spark, tmp_path):
    path = tmp_path / "cases.csv"
    path.write_text('case_id,triage_text,acuity\n1,"",3.0\n2,,\n3,"\n  padded \n",""\n')
    got = [tuple(r) for r in files.read_cases(spark, str(path)).orderBy("case_id").collect()]
    assert got == [(1, "", 3), (2, None, None), (3, "\n  padded \n", None)]
    path.write_text("case_id,triage_text,acuity\n1,x,2.7\n")
    with pytest.raises(Exception, match="acuity: no int: 2.7"):
        files.read_cases(spark, str(path)).collect()


def test_csv_keeps_white_space_and_empty_texts(spark, tmp_path):
    rows = [(1, " \n answer 3 \n", 3), (2, "", None), (3, None, 1)]
    files.write_csv(spark.createDataFrame(rows, schemas.CASES), str(tmp_path / "c"))
    assert sorted(map(tuple, files.read_cases(spark, str(tmp_path / "c")).collect())) == rows


def test_a_run_that_is_written_again_counts_once(spark, tmp_path):
    base = str(tmp_path / "runs")
    df = spark.createDataFrame([(1, 1)], "acuity INT, final_pred INT")
    for model in ("a", "b", "a"):
        files.write_results(df, base, model, "1")
    assert files.read_runs(spark, base, "acuity INT, final_pred INT", "parquet").count() == 2


def test_flat_files_of_different_layouts(spark, tmp_path):
    (tmp_path / "exp1.csv").write_text("triage_text,acuity,final_pred,llm_resp\nx,3.0,3,y\n")
    (tmp_path / "exp2.csv").write_text("final_pred,llm1_resp,acuity\n-1,z,2\n")
    runs = files.read_runs(spark, str(tmp_path / "exp*.csv"), "acuity INT, final_pred INT", flat=True)
    assert sorted(map(tuple, runs.collect())) == [(2, -1, "exp2"), (3, 3, "exp1")]
    (tmp_path / "exp3.csv").write_text("acuity\n1\n")
    with pytest.raises(ValueError, match="final_pred"):
        files.read_runs(spark, str(tmp_path / "exp*.csv"), "acuity INT, final_pred INT", flat=True)


def test_case_ids_tell_equal_rows_apart(spark):
    cases = spark.createDataFrame([("x", 1), ("x", 1), (None, 2), ("y", None)], "triage_text STRING, acuity INT")
    got = files.with_case_ids(cases)
    assert got.count() == got.select("case_id").distinct().count() == 4
    assert sorted(r["case_id"] for r in got.collect()) == sorted(r["case_id"] for r in files.with_case_ids(cases).collect())


def test_instructions(spark, tmp_path):
    path = str(tmp_path / "instructions")
    rows = spark.createDataFrame([("i", 'in "x"\ny', "o")], schemas.INSTRUCTIONS)
    files.write_csv(rows, path)
    assert files.read_instructions(spark, path).collect() == rows.collect()


def test_tables(spark):
    base = spark.createDataFrame([(1,), (2,)], "id INT")
    hits = spark.createDataFrame([(2,), (2,)], "id INT")
    assert {r["id"]: r["f"] for r in set_flag(base, hits, "id", "f").collect()} == {1: 0, 2: 1}
    counts = spark.createDataFrame([(1, 5)], "id INT, n INT")
    assert {r["id"]: r["n"] for r in set_count(base, counts, "id", "n").collect()} == {1: 5, 2: 0}
    new = spark.createDataFrame([(1, 9), (3, 9)], "id INT, n INT")
    assert {tuple(r) for r in insert_if_absent(counts, new, "id").collect()} == {(1, 5), (3, 9)}


def test_broadcast_only_below_the_bound(spark, tmp_path):
    path = str(tmp_path / "side")
    spark.range(1000).write.parquet(path)
    side = spark.read.parquet(path)
    hinted = broadcast_if_small(side)._jdf.queryExecution().logical().toString()
    plain = broadcast_if_small(side, max_bytes=10)._jdf.queryExecution().logical().toString()
    assert "broadcast" in hinted.lower() and "broadcast" not in plain.lower()


def test_shared_folder_comes_from_the_session(spark):
    named = spark.conf.get("spark.checkpoint.dir")
    assert shared_dir(spark) == named
    assert scratch(spark, "x").startswith(named + "/x-")


def _answer(rows):
    load = lambda: lambda prompts, attempt: [p.upper() for p in prompts]
    return apply_model(rows, "p", load, wait=no_wait, on_failure="null")


def test_file_stream_answers_each_file_once(spark, tmp_path):
    source, target, state = (str(tmp_path / d) for d in ("in", "out", "state"))
    ddl = "case_id BIGINT, p STRING"

    def add(*ids):
        rows = [(i, f"case {i}") for i in ids]
        spark.createDataFrame(rows, ddl).coalesce(1).write.mode("append").parquet(source)

    def run():
        score_new_files(spark, source, ddl, target, state, _answer)
        return sorted(r["response"] for r in spark.read.parquet(target).collect())

    add(1, 2)
    assert run() == ["CASE 1", "CASE 2"]
    add(3)
    assert run() == ["CASE 1", "CASE 2", "CASE 3"]
    assert run() == ["CASE 1", "CASE 2", "CASE 3"]


def test_checkpoint_leaves_the_open_cases(spark, tmp_path):
    path = str(tmp_path / "done")
    cases = spark.createDataFrame([(1,), (2,), (3,)], "case_id BIGINT")
    ddl = "case_id BIGINT, response STRING"
    files.write_checkpoint(spark.createDataFrame([(1, "x"), (2, None)], ddl), path)
    done = files.read_checkpoint(spark, path, ddl)
    assert {r["case_id"] for r in pending(cases, done).collect()} == {2, 3}
    assert done.where(F.col("response").isNull()).count() == 1
