"""Parsers, cascade, vote, model batches and scores on hand-made rows."""

import json

import pytest
from pyspark.sql import functions as F

from staywide.checks import texts as T
from staywide.functions import parsing as X
from staywide.functions import predicates as P
from staywide.functions import vocabulary as V
from staywide.operators import evaluate as E
from staywide.operators.model_batch import (
    apply_model,
    fixed_wait,
    growing_wait,
    no_wait,
    resume,
)
from staywide.operators.voting import majority
from staywide.plans import prompts as PR
from staywide.plans import scoring


def mapped(spark, values, expression, kind="STRING"):
    rows = [(i, v) for i, v in enumerate(values)]
    df = spark.createDataFrame(rows, f"i INT, v {kind}")
    found = {r["i"]: r["x"] for r in df.select("i", expression(F.col("v")).alias("x")).collect()}
    return [found[i] for i in range(len(values))]


def test_last_level(spark):
    cases = {
        "Level 3, or 2": 2,
        "seen in 2024 at 10": 1,
        "7 8 9 0": -1,
        "": -1,
        None: -1,
        "first 1\nthen 5\n\nend": 5,
        "é5ü": 5,
        "5": 5,
        "15": 5,
        "51 ": 1,
        "x" * 100_000 + "4" + "y" * 100_000: 4,
    }
    assert mapped(spark, list(cases), X.parse_level) == list(cases.values())


def test_labelled_level(spark):
    cases = {
        "ESI level: 2 of 5": 2,
        "ESI: 4, then 1": 4,
        "esi LEVEL:\n\t3": 3,
        "ESI level: 1 ... ESI level: 2": 2,
        "ESI: 5. ESI level: 1": 1,
        "ESI level: seven, not 3": -1,
        "ESI level:": -1,
        "ESI level: 6": -1,
        "no label, 2": 2,
        None: -1,
    }
    got = mapped(spark, list(cases), lambda c: X.parse_level(c, labelled=True))
    assert got == list(cases.values())


def test_booleans(spark):
    assert mapped(spark, ["True", "true", "True ", None, ""], X.parse_true) == [
        True,
        False,
        False,
        False,
        False,
    ]
    cases = {
        '{"result": true}': True,
        '{"result": false}': False,
        ' {"result": true, "why": "x"} ': True,
        '{"result": "true"}': False,
        '{"result": 1}': False,
        '{"result": null}': False,
        '{"other": true}': None,
        '{"result": true} and more': None,
        '[{"result": true}]': None,
        "true": None,
        "": None,
        None: None,
    }
    assert mapped(spark, list(cases), X.parse_json_result) == list(cases.values())


def test_numbers(spark):
    cases = {
        "2": 2.0,
        " 1.5\n": 1.5,
        "-0.5e1": -5.0,
        "true": 1.0,
        "01": None,
        "+1": None,
        ".5": None,
        "1d": None,
        "three": None,
        "null": None,
        '"3"': None,
        "": None,
        None: None,
    }
    assert mapped(spark, list(cases), X.parse_json_number) == list(cases.values())


def test_cascade(spark):
    rows = [
        ("True", "True", "9", 1),
        ("False", "True", "9", 2),
        ("False", "False", "1.5", 3),
        ("False", "False", "1", 4),
        ("False", "False", "0", 5),
        ("False", "False", "0.5", 5),
        ("True", "True", "many", -1),
        ("True", "False", None, -1),
        # JSON that is no number fails only if the first two views do not decide.
        ("True", "False", "null", 1),
        ("False", None, "null", -1),
        ("False", "False", "true", 4),
    ]
    df = spark.createDataFrame(
        [r[:3] for r in rows], "llm1_result STRING, llm2_result STRING, llm3_result STRING"
    )
    got = [r["final_pred"] for r in scoring.levels(df).collect()]
    assert got == [r[3] for r in rows]
    json_rows = [('{"result": true}', "x", "1"), ('{"result": false}', '{"result": true}', "1")]
    df = spark.createDataFrame(json_rows, df.schema)
    assert [r["final_pred"] for r in scoring.levels(df, json_views=True).collect()] == [-1, 2]


def test_majority(spark):
    rows = [
        ("a", "b", "b", "b"),
        ("a", "b", "c", "a"),
        ("a", "a", "b", "a"),
        (None, "b", "c", "b"),
        (None, None, "c", "c"),
        (None, None, None, None),
        ("a", None, "a", "a"),
    ]
    df = spark.createDataFrame(rows, "a STRING, b STRING, c STRING, want STRING")
    for r in df.select("want", majority(F.col("a"), F.col("b"), F.col("c")).alias("x")).collect():
        assert r["x"] == r["want"]
    four = [("a", "b", "b", "a", "a"), ("a", "b", "c", "c", "c"), (None, "x", None, "y", "x")]
    df = spark.createDataFrame(four, "a STRING, b STRING, c STRING, d STRING, want STRING")
    voted = majority(*[F.col(c) for c in "abcd"])
    for r in df.select("want", voted.alias("x")).collect():
        assert r["x"] == r["want"]


def test_waits():
    assert [growing_wait(n) for n in (1, 2, 3, 4)] == [30, 60, 90, 120]
    assert fixed_wait(3) == 5


def test_a_raising_batch_costs_only_the_bad_row(spark):
    def load():
        def model(prompts, attempt):
            if "bad" in prompts:
                raise RuntimeError("cannot")
            return [p.upper() for p in prompts]

        return model

    df = spark.createDataFrame([(1, "a"), (2, "bad"), (3, None), (4, "c")], "id INT, p STRING")
    rows = {r["id"]: r for r in apply_model(df, "p", load, wait=no_wait).collect()}
    assert rows[1]["response"] == "A" and rows[4]["response"] == "C"
    assert rows[2]["attempts"] == 5 and rows[2]["final_pred"] == -1
    assert rows[2]["error"] == "RuntimeError: cannot"
    assert rows[3]["attempts"] == 0 and rows[3]["final_pred"] == -1
    with pytest.raises(ValueError):
        apply_model(df.withColumn("response", F.lit("x")), "p", load)


def test_wait_is_called_between_attempts(spark, tmp_path):
    log = str(tmp_path / "waits")

    def wait(attempt):
        with open(log, "a") as f:
            f.write(f"{attempt} ")
        return 0.0

    def load():
        return lambda prompts, attempt: [ValueError("no") for _ in prompts]

    df = spark.createDataFrame([(1, "a")], "id INT, p STRING")
    apply_model(df, "p", load, max_attempts=3, wait=wait, on_failure="null").collect()
    assert open(log).read().split() == ["1", "2"]


def test_resume_keeps_answers(spark):
    ddl = "id INT, p STRING, response STRING, attempts INT, error STRING"
    previous = spark.createDataFrame(
        [(1, "a", "kept", 1, None), (2, "b", None, 5, "late")], ddl
    )

    def model_pass(rows):
        load = lambda: lambda prompts, attempt: [f"new {p}" for p in prompts]
        return apply_model(rows, "p", load, wait=no_wait, on_failure="null")

    got = {r["id"]: r["response"] for r in resume(previous, model_pass).collect()}
    assert got == {1: "kept", 2: "new b"}


def test_chain_saves_the_first_step(spark, tmp_path):
    path = str(tmp_path / "analyses")

    def save(df):
        df.write.parquet(path)
        return spark.read.parquet(path)

    cases = spark.createDataFrame([(1, "ESI level: 1"), (2, None)], "case_id INT, t STRING")
    answers = scoring.chain(
        cases,
        "t",
        T.ANALYSIS,
        T.FORMATS,
        T.load_analysis_stub,
        T.load_format_stub,
        save=save,
        wait=no_wait,
    )
    rows = {r["case_id"]: r for r in scoring.to_cases(answers, ["case_id"]).collect()}
    assert rows[1]["llm1_result"] == "True" and rows[1]["lost_answers"] == 0
    assert rows[2]["lost_answers"] == 3 and rows[2]["llm1_resp"] is None


def scores(spark, pairs, keys=()):
    rows = [("r", t, p) if len(x) == 2 else x for x in pairs for t, p in [x[-2:]]]
    df = spark.createDataFrame(rows, "run_name STRING, acuity INT, final_pred INT")
    return E.evaluate(df, list(keys)).collect()


def test_scores_by_hand(spark):
    pairs = [(1, 1), (1, 2), (2, 2), (3, 3), (3, 2), (4, 5), (5, 5), (5, 3), (2, -1), (None, 3)]
    (r,) = scores(spark, pairs)
    assert r["accuracy"] == pytest.approx(4 / 8)
    assert r["failed_predictions"] == 1
    # class:       1    2    3    4    5
    precision = [1.0, 1 / 3, 1 / 2, 0.0, 1 / 2]
    recall = [1 / 2, 1.0, 1 / 2, 0.0, 1 / 2]
    f1 = [2 * p * q / (p + q) if p + q else 0 for p, q in zip(precision, recall)]
    assert r["macro_precision"] == pytest.approx(sum(precision) / 5)
    assert r["macro_recall"] == pytest.approx(sum(recall) / 5)
    assert r["macro_f1"] == pytest.approx(sum(f1) / 5)
    assert r["high_risk_recall"] == 1.0
    assert r["moderate_f1"] == pytest.approx(1 / 2)
    assert r["non_urgent_precision"] == 1.0
    assert (r["over_triage_count"], r["under_triage_count"]) == (2, 2)
    assert r["over_triage_rate"] == pytest.approx(2 / 8)


def test_class_that_only_occurs_in_predictions(spark):
    (r,) = scores(spark, [(1, 1), (1, 4)])
    assert r["macro_recall"] == pytest.approx(0.25)
    assert r["macro_precision"] == pytest.approx(0.5)


def test_runs_without_valid_predictions_and_no_rows(spark):
    rows = {
        r["run_name"]: r
        for r in scores(spark, [("a", 1, -1), ("a", 2, -1), ("b", 3, 3)], ["run_name"])
    }
    assert rows["a"]["failed_predictions"] == 2
    assert all(rows["a"][m] == 0 for m in E.METRICS if m != "failed_predictions")
    assert rows["b"]["accuracy"] == 1.0
    empty = spark.createDataFrame([], "acuity INT, final_pred INT")
    (r,) = E.evaluate(empty).collect()
    assert all(r[m] == 0 for m in E.METRICS)


def test_report_has_twelve_named_columns(spark):
    df = spark.createDataFrame([(1, 1)], "acuity INT, final_pred INT")
    columns = E.report(E.evaluate(df)).columns
    assert len(columns) == 12 and columns[0] == "Overall Accuracy"


def test_requests_as_json(spark):
    df = spark.createDataFrame([("hi",), (None,)], "q STRING")
    chat = PR.build_chat_request(df, "sys", "q").select(PR.as_json(F.col("request")).alias("j"))
    first, second = [json.loads(r["j"]) for r in chat.collect()]
    assert first == {
        "model": "gpt-4o",
        "messages": [
            {"role": "system", "content": "sys"},
            {"role": "user", "content": "hi"},
        ],
        "temperature": 0,
        "top_p": 1,
        "frequency_penalty": 0,
        "presence_penalty": 0,
        "max_tokens": 2048,
    }
    assert second["messages"][1]["content"] is None
    query = PR.build_query_request(df, "q").select(PR.as_json(F.col("request")).alias("j"))
    assert json.loads(query.first()["j"]) == {
        "inputs": {},
        "query": "hi",
        "response_mode": "blocking",
        "conversation_id": "",
        "user": "system",
    }


def test_replies(spark):
    payload = json.dumps({"choices": [{"message": {"content": "a\n\"b\""}}]})
    assert mapped(spark, [payload, "{}", "oops"], X.chat_reply) == ['a\n"b"', None, None]
    assert mapped(spark, ['{"answer": "x"}', "{}"], X.query_reply) == ["x", None]


def test_prompt_text(spark):
    df = spark.createDataFrame([("case",), (None,)], "t STRING")
    rows = PR.render_prompt(df, "do it", "t").collect()
    assert rows[0]["prompt"].endswith(
        "### Instruction:\ndo it\n\n### Input:\ncase\n\n### Response:\n\n    "
    )
    assert "### Input:\nNone\n" in rows[1]["prompt"]
    plain = PR.render_prompt(df, "do it", "t", tail="").first()["prompt"]
    assert plain.endswith("### Response:\n")


def test_extract_case(spark):
    text = f"steps\n{V.CASE_HEADING}\n draft\n{V.CASE_HEADING}\n\n final case \n"
    assert mapped(spark, [text, " bare ", None], X.extract_case) == ["final case", "bare", None]


def test_columns_with_defaults(spark):
    df = spark.createDataFrame([(1, 7)], "a INT, b INT")
    assert P.with_default(df, "b", 0).first()["b"] == 7
    assert P.with_default(df, "b", 0, replace=True).first()["b"] == 0
    assert P.ensure_columns(df, {"b": "int", "c": "string"}).columns == ["a", "b", "c"]


def test_the_procedure_list_has_111_codes():
    assert len(set(V.CRITICAL_PROCEDURE_CODES)) == len(V.CRITICAL_PROCEDURE_CODES) == 111
