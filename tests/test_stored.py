"""Stored tables that change, CSV read in ranges, votes over rows, retries in waves."""

import csv
import glob
import random

import pytest
from pyspark.sql import functions as F

from staywide.operators.model_batch import apply_model, apply_model_in_waves, no_wait
from staywide.operators.voting import majority, majority_rows
from staywide.plans import upkeep
from staywide.sources import files, stored
from staywide.sources.records import ranges


def held_files(path):
    return set(glob.glob(f"{path}/data/*/_bucket=*/*.parquet"))


def rows(spark, path):
    return sorted(map(tuple, stored.read(spark, path).collect()), key=str)


def test_merge_changes_only_the_buckets_of_its_keys(spark, tmp_path):
    path = str(tmp_path / "t")
    base = spark.range(200).select(F.col("id"), (F.col("id") * 2).alias("n"), F.lit("a").alias("s"))
    stored.create(base, path, ["id"], 16)
    before = held_files(path)
    changes = spark.createDataFrame([(3, None), (500, 7)], "id long, n long")
    touched = stored.merge(spark, path, changes)
    want = {(i, None if i == 3 else 2 * i, "a") for i in range(200)} | {(500, 7, None)}
    assert set(map(tuple, stored.read(spark, path).collect())) == want
    assert 1 <= len(touched) <= 2
    # All old files are there, and untouched buckets are still read from them.
    assert before <= held_files(path)
    read = {f.split("/_bucket=")[1] for f in stored.read(spark, path).inputFiles()}
    assert len(read & {f.split("/_bucket=")[1] for f in before}) >= 14


def test_merge_updates_or_inserts_alone(spark, tmp_path):
    path = str(tmp_path / "t")
    stored.create(spark.createDataFrame([(1, 1), (None, 2)], "id long, n long"), path, ["id"], 4)
    changes = spark.createDataFrame([(1, 10), (None, 20), (2, 30)], "id long, n long")
    stored.merge(spark, path, changes, insert=False)
    assert rows(spark, path) == [(1, 10), (None, 20)]
    stored.merge(spark, path, changes.withColumn("n", F.col("n") + 1), update=False)
    assert rows(spark, path) == [(1, 10), (2, 30 + 1), (None, 20)]
    assert stored.merge(spark, path, changes.limit(0)) == []


def test_repeated_change_leaves_the_table(spark, tmp_path):
    path = str(tmp_path / "t")
    stored.create(spark.createDataFrame([(1, 1)], "id long, n long"), path, ["id"], 4)
    twice = spark.createDataFrame([(1, 2), (1, 3)], "id long, n long")
    with pytest.raises(Exception, match="repeated key"):
        stored.merge(spark, path, twice)
    assert rows(spark, path) == [(1, 1)]


def test_empty_stored_table_takes_rows(spark, tmp_path):
    path = str(tmp_path / "t")
    empty = spark.createDataFrame([], "id long, more string, n long")
    stored.create(empty, path, ["id", "more"], 4)
    assert rows(spark, path) == []
    stored.merge(spark, path, spark.createDataFrame([(1, "x", 5)], "id long, more string, n long"))
    assert rows(spark, path) == [(1, "x", 5)]


@pytest.fixture
def small_ranges(spark):
    old = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    spark.conf.set("spark.sql.files.maxPartitionBytes", "300")
    spark.conf.set("spark.sql.files.openCostInBytes", "1")
    yield
    for k, v in old.items():
        spark.conf.set(k, v)


def test_ranges_cut_inside_quotes(spark, tmp_path, small_ranges):
    rng = random.Random(4)
    bits = ["a", ",", '"', "\n", "\n\n", "ü", " ", "long " * 30, '""', "\r\n"]
    cases = [(i, "x" + "".join(rng.choice(bits) for _ in range(rng.randrange(8))), i % 5 or None) for i in range(200)]
    path = tmp_path / "cases.csv"
    with open(path, "w", newline="") as out:
        writer = csv.writer(out, lineterminator="\r\n")
        writer.writerow(["case_id", "triage_text", "acuity"])
        writer.writerows(cases)
    assert ranges(spark, str(path)).count() > 20
    found = files.read_cases(spark, str(path)).collect()
    assert sorted(map(tuple, found)) == cases


def test_files_of_one_line_and_of_none(spark, tmp_path):
    (tmp_path / "a.csv").write_text("case_id,triage_text,acuity\n")
    (tmp_path / "b.csv").write_text("")
    (tmp_path / "c.csv").write_text('case_id,triage_text,acuity\n1,"open\nend",3')
    assert list(map(tuple, files.read_cases(spark, str(tmp_path / "*.csv")).collect())) == [(1, "open\nend", 3)]
    (tmp_path / "d.csv").write_text("case_id,acuity,triage_text\n")
    with pytest.raises(Exception, match="header"):
        files.read_cases(spark, str(tmp_path / "*.csv")).collect()


def test_a_head_that_spans_lines_is_refused(spark, tmp_path):
    (tmp_path / "a.csv").write_text('case_id,triage_text,"acu\nity"\n1,"x",3\n')
    with pytest.raises(Exception, match="head"):
        files.read_cases(spark, str(tmp_path / "a.csv")).collect()
    with pytest.raises(Exception, match="head"):
        files.read_runs(spark, str(tmp_path / "a.csv"), "case_id INT", flat=True).collect()


def test_many_flat_files_take_few_jobs(spark, tmp_path):
    for i in range(40):
        head, row = ("acuity,final_pred", f"{i},1") if i % 2 else ("final_pred,x,acuity", f'1,"a\nb",{i}')
        (tmp_path / f"run {i}+.csv").write_text(f"{head}\n{row}\n")
    runs = files.read_runs(spark, str(tmp_path / "*.csv"), "acuity INT, final_pred INT", flat=True)
    assert {tuple(r) for r in runs.collect()} == {(i, 1, f"run {i}+") for i in range(40)}


def test_votes_over_rows_are_those_over_columns(spark):
    rng = random.Random(1)
    cases = [(i, *(rng.choice(["1", "2", "3", None]) for _ in range(5))) for i in range(200)] + [(None, "1", "2", "2", None, "1")]
    names = [f"v{k}" for k in range(5)]
    frame = spark.createDataFrame(cases, "case_id long, " + ", ".join(f"{n} string" for n in names))
    wide = frame.select("case_id", majority(*map(F.col, names)).alias("final_pred"))
    long = frame.select("case_id", F.posexplode(F.array(*names)).alias("position", "answer"))
    by_rows = majority_rows(long, ["case_id"])
    assert sorted(map(tuple, by_rows.collect()), key=str) == sorted(map(tuple, wide.collect()), key=str)


def test_waves_answer_as_retries_do(spark, tmp_path):
    def load_flaky():
        # One row in ten fails three times, one in fifty always.
        def model(prompts, attempt):
            out = []
            for p in prompts:
                n = int(p)
                bad = n % 50 == 7 or (n % 10 == 0 and attempt <= 3)
                out.append(ValueError("no") if bad else f"{p}/{attempt}")
            return out

        return model

    frame = spark.range(300).select("id", F.col("id").cast("string").alias("prompt"))
    frame = frame.unionByName(spark.createDataFrame([(-1, None)], "id long, prompt string"))
    plain = apply_model(frame, "prompt", load_flaky, wait=no_wait)
    waits = []

    def wait(attempt):
        waits.append(attempt)
        return 0.0

    path = str(tmp_path / "waves")
    waves = apply_model_in_waves(frame, "prompt", load_flaky, path, wait=wait)
    want = sorted(map(tuple, plain.collect()))
    assert sorted(map(tuple, waves.collect())) == want and waits == [1, 2, 3, 4]

    # A killed run: the last wave is not whole. Earlier ones are not asked again.
    (tmp_path / "waves" / "wave-5" / "_SUCCESS").unlink()
    waits.clear()
    again = apply_model_in_waves(frame, "prompt", load_flaky, path, wait=wait)
    assert sorted(map(tuple, again.collect())) == want and waits == [4]


def test_only_stays_with_new_rows_are_affected(spark):
    stays = spark.createDataFrame([(1, 10, 100), (2, 10, None), (3, 20, 300), (4, None, 400), (5, 30, 500)], "stay_id long, subject_id long, hadm_id long")
    added = {
        "labevents": spark.createDataFrame([(10,), (None,), (99,)], "subject_id long"),
        "poe": spark.createDataFrame([(None, 400)], "subject_id long, hadm_id long"),
        "pyxis": spark.createDataFrame([(None, 5), (None, 5)], "subject_id long, stay_id long"),
    }
    found = upkeep.affected_stays({"edstays": stays}, added).collect()
    assert sorted(r["stay_id"] for r in found) == [1, 2, 4, 5]
    with pytest.raises(ValueError, match="lookup"):
        upkeep.affected_stays({"edstays": stays}, {"pyxis_admin_method": spark.createDataFrame([("a",)], "drug_name string")})


def test_only_stays_with_new_rows_in_their_time_are_changed(spark):
    # Stays of one patient ten days apart; the last one is without an end.
    text = "stay_id long, subject_id long, hadm_id long, intime string, outtime string"
    days = ["01", "11", "21"]
    stays = [(i, 10, 100, f"2024-03-{d} 08:00:00", f"2024-03-{d} 12:00:00") for i, d in enumerate(days, 1)]
    stays += [(4, 10, None, "2024-03-30 08:00:00", None), (5, 20, 200, "2024-03-11 08:00:00", "9900-01-01 00:00:00")]
    stays = spark.createDataFrame(stays, text).withColumns({c: F.col(c).cast("timestamp_ntz") for c in ("intime", "outtime")})

    def events(rows, names):
        return spark.createDataFrame(rows, names).withColumn(names.split()[-2], F.col(names.split()[-2]).cast("timestamp_ntz"))

    lab = "subject_id long, labevent_id long, charttime string"
    order = "poe_id string, subject_id long, hadm_id long, order_type string, order_subtype string, ordertime string"
    cases = [
        ({"labevents": events([(10, 1, "2024-03-11 09:00:00")], lab)}, [2]),
        ({"labevents": events([(10, 1, "2024-03-16 09:00:00")], lab)}, []),
        ({"labevents": events([(20, 1, "2031-03-16 09:00:00")], lab)}, [5]),
        ({"poe": events([("a", 10, 100, "Blood Bank", "Red Cell Product Order", "2024-03-17 09:00:00")], order)}, [2]),
        ({"poe": events([("a", 10, 100, "Consults", None, "2024-03-17 09:00:00")], order)}, []),
        ({"transfers": events([(10, 100, "Cardiac Surgery", "2024-03-15 09:00:00")], "subject_id long, hadm_id long, careunit string, intime string")}, [1, 2]),
        ({"pyxis": spark.createDataFrame([(10, 3)], "subject_id long, stay_id long")}, [3]),
        ({"patients": spark.createDataFrame([(10,)], "subject_id long")}, [1, 2, 3, 4]),
    ]
    for added, want in cases:
        found = upkeep.changed_stays({"edstays": stays}, added).collect()
        assert sorted(r["stay_id"] for r in found) == want, (list(added), found)
