"""Edges of the time spans, uneven keys, and agreement of the counting paths."""

import datetime as dt
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from staywide.checks.fixtures import Fixtures
from staywide.operators import spans as S
from staywide.plans import features as P
from staywide.plans import resources as R
from staywide.plans import wide as W
from staywide.sources import schemas

T0 = dt.datetime(2024, 3, 10, 22, 30)
HOUR = dt.timedelta(hours=1)
TICK = dt.timedelta(microseconds=1)
STAY_FIELDS = ("F", "WHITE", "AMBULANCE")


def clinical(spark, **tables):
    """All clinical tables, empty unless rows are given."""
    return {
        name: spark.createDataFrame(tables.get(name, []), ddl)
        for name, ddl in schemas.CLINICAL.items()
    }


def stay(stay_id, start=T0, hours=4.0, subject=1, hadm=10, disposition="HOME"):
    end = None if hours is None else start + dt.timedelta(hours=hours)
    return (stay_id, subject, hadm, start, end, *STAY_FIELDS, disposition)


def flags(tables, column, among=P.FEATURES):
    chosen = [f for f in [*among, P.ICU_WITHIN_HOUR] if f.column == column][0]
    return {r["stay_id"]: r[column] for r in P.feature(tables, chosen).collect()}


def order(number, when, subtype, subject=1, hadm=10, kind="Respiratory"):
    return (number, subject, hadm, when, kind, subtype)


def test_event_exactly_at_one_hour_is_in_both_closed_spans(spark):
    t = clinical(
        spark,
        edstays=[stay(1)],
        poe=[order(1, T0 + HOUR, "Mechanical Ventilation")],
    )
    assert flags(t, "invasive_ventilation") == {1: 1}
    assert flags(t, "invasive_ventilation_beyond_1h") == {1: 1}


@pytest.mark.parametrize(
    "when,first,later",
    [
        (T0 - TICK, 0, 0),
        (T0, 1, 0),
        (T0 + HOUR - TICK, 1, 0),
        (T0 + HOUR + TICK, 0, 1),
        (T0 + 4 * HOUR, 0, 1),
        (T0 + 4 * HOUR + TICK, 0, 0),
    ],
)
def test_ends_of_closed_spans(spark, when, first, later):
    t = clinical(
        spark, edstays=[stay(1)], poe=[order(1, when, "Mechanical Ventilation")]
    )
    assert flags(t, "invasive_ventilation") == {1: first}
    assert flags(t, "invasive_ventilation_beyond_1h") == {1: later}


def test_event_exactly_at_one_hour_is_not_past_the_hour(spark):
    unit = "Medical Intensive Care Unit (MICU)"
    t = clinical(
        spark,
        edstays=[stay(1), stay(2, subject=2, hadm=20)],
        transfers=[(1, 1, 10, T0 + HOUR, unit), (2, 2, 20, T0 + HOUR + TICK, unit)],
    )
    assert flags(t, "transfer_to_ICU_beyond_1h") == {1: 0, 2: 1}
    assert flags(t, "icu_within_1h") == {1: 1, 2: 0}


def test_departure_exactly_after_one_hour(spark):
    t = clinical(spark, edstays=[stay(1, hours=1.0, disposition="TRANSFER")])
    assert flags(t, "transfer_within_1h") == {1: 1}
    assert flags(t, "transfer_beyond_1h") == {1: 0}


def test_departure_before_arrival(spark):
    t = clinical(
        spark,
        edstays=[
            stay(1, hours=-2.0, disposition="EXPIRED"),
            stay(2, hours=-2.0, disposition="TRANSFER"),
        ],
        poe=[order(1, T0 - HOUR, "BiPAP"), order(2, T0, "BiPAP")],
        labevents=[(1, 1, T0 - HOUR)],
    )
    assert flags(t, "expired_within_1h") == {1: 1, 2: 0}
    assert flags(t, "transfer_within_1h") == {1: 0, 2: 0}
    assert flags(t, "non_invasive_ventilation") == {1: 0, 2: 0}
    counts = R.resource_counts(t, ["lab_event_count"]).collect()
    assert {r["lab_event_count"] for r in counts} == {0}


def test_missing_departure_and_missing_admission(spark):
    unit = "Surgery"
    t = clinical(
        spark,
        edstays=[stay(1, hours=None), stay(2, hadm=None)],
        transfers=[(1, 1, 10, T0, unit), (2, 1, None, T0, unit)],
        procedures_icd=[(1, 10, T0.date(), "9999", 9), (1, None, T0.date(), "9999", 9)],
        poe=[order(1, T0, "Mechanical Ventilation", hadm=None)],
    )
    assert flags(t, "transfer2surgeryin1h") == {1: 0, 2: 0}
    assert flags(t, "invasive_ventilation") == {1: 1, 2: 1}


def test_surgery_needs_both_events_and_stops_at_the_last_day(spark):
    unit, late = "Surgery", dt.datetime(2024, 3, 10, 23, 40)
    after_midnight = dt.datetime(2024, 3, 11, 0, 10)
    t = clinical(
        spark,
        edstays=[
            stay(1, late, 0.25, subject=1, hadm=1),
            stay(2, late, 0.75, subject=2, hadm=2),
            stay(3, late, 0.75, subject=3, hadm=3),
        ],
        transfers=[(s, s, s, after_midnight, unit) for s in (1, 2, 3)],
        procedures_icd=[(1, 1, late.date(), "x", 9), (2, 2, late.date(), "x", 9)],
    )
    # Stay 1 ended on the day before the move, stay 3 has no procedure.
    assert flags(t, "transfer2surgeryin1h") == {1: 0, 2: 1, 3: 0}


def test_procedure_date_is_midnight(spark):
    midnight = dt.datetime(2024, 3, 10)
    t = clinical(
        spark,
        edstays=[stay(1), stay(2, midnight, subject=2)],
        procedures_icd=[(s, 10, T0.date(), "4192", 9) for s in (1, 2)],
    )
    assert flags(t, "intraosseous_line_placed") == {1: 0, 2: 1}


def test_critical_procedure_reaches_the_day_after_departure(spark):
    # Arrival at 22:30 and four hours: departure on the 11th, last day is the 12th.
    days = {1: 9, 2: 10, 3: 12, 4: 13}
    t = clinical(
        spark,
        edstays=[stay(s, subject=s) for s in days],
        procedures_icd=[(s, 1, dt.date(2024, 3, d), "3893", 9) for s, d in days.items()]
        + [(3, 1, dt.date(2024, 3, 11), "00JU0ZZ", 10)],
    )
    assert flags(t, "critical_procedure") == {1: 0, 2: 1, 3: 1, 4: 0}
    codes = {r["stay_id"]: r["icd_code"] for r in P.critical_procedure_codes(t).collect()}
    assert codes == {2: "3893", 3: "00JU0ZZ"}


def test_one_red_cell_order_is_not_enough(spark):
    red = "Red Cell Product Order"
    t = clinical(
        spark,
        edstays=[stay(1, subject=1, hadm=1), stay(2, subject=2, hadm=2)],
        poe=[order(1, T0 + HOUR, red, 1, 1), order(2, T0 + 2 * HOUR, red, 2, 2)]
        + [order(3, T0 + 7 * 24 * HOUR, red, 2, 2), order(None, T0 + 3 * HOUR, red, 1, 1)],
    )
    assert flags(t, "red_cell_order_more_than_1") == {1: 0, 2: 1}
    assert [tuple(r) for r in P.red_cell_orders(t).collect()] == [(2, 2)]


def test_drug_with_two_routes_counts_in_both(spark):
    t = clinical(
        spark,
        edstays=[stay(1), stay(2, subject=2)],
        pyxis=[(1, 1, T0, "A"), (1, 1, T0 + HOUR, "A"), (1, 1, T0 + 5 * HOUR, "A")]
        + [(2, 2, T0, "B"), (2, 2, T0, "C")],
        pyxis_admin_method=[("A", "intravenous"), ("A", "intramuscular"), ("B", "patch")],
    )
    rows = {r["stay_id"]: r for r in R.drug_route_counts(t).collect()}
    assert rows[1]["intravenous"] == rows[1]["intramuscular"] == 2
    assert set(rows) == {1, 2} and rows[2]["intravenous"] == 0


def test_psychotropic_needs_known_patient_and_own_subject(spark):
    drug = "LORazepam 2mg/1mL 1mL SYR"
    t = clinical(
        spark,
        edstays=[stay(1, subject=1), stay(2, subject=2), stay(3, subject=3)],
        patients=[(1, 40, 2020), (3, 40, 2020)],
        pyxis=[
            (1, 1, T0 + 2 * HOUR, drug),
            (2, 2, T0, drug),
            (9, 3, T0, drug),
        ],
    )
    assert flags(t, "psychotropic_med_within_120min") == {1: 1, 2: 0, 3: 0}


def test_tier_flags_ignore_the_time(spark):
    t = clinical(
        spark,
        edstays=[stay(1)],
        pyxis=[(1, 1, None, "HEPARIN 5000u"), (1, 1, T0 + 99 * HOUR, "labetalol")],
    )
    assert flags(t, "tier3_med_usage") == {1: 1}
    assert flags(t, "tier2_med_usage") == {1: 1}
    assert flags(t, "tier4_med_usage") == {1: 1}
    assert flags(t, "tier1_med_usage_1h") == {1: 0}


def test_running_counts_equal_brute_force_with_a_dominant_subject(spark):
    rng = random.Random(5)

    def subject():
        return 1 if rng.random() < 0.4 else rng.randint(2, 6)

    def moment():
        # Few distinct minutes, so that events, starts and ends often coincide.
        return T0 + dt.timedelta(minutes=30 * rng.randint(0, 700))

    stays = [
        stay(i, moment(), rng.choice([0.5, 1.0, 3.5, 30.0, 200.0, -1.0]), subject())
        for i in range(120)
    ]
    labs = [(i, subject(), moment()) for i in range(900)]
    orders = [
        order(i, moment(), rng.choice(["BiPAP", "Red Cell Product Order", None]), subject())
        for i in range(600)
    ]
    t = clinical(spark, edstays=stays, labevents=labs, poe=orders)
    got = {r["stay_id"]: r["lab_event_count"] for r in R.resource_counts(t, ["lab_event_count"]).collect()}
    want = {
        s[0]: sum(1 for _, who, when in labs if who == s[1] and s[3] <= when <= s[4])
        for s in stays
    }
    assert got == want
    late = {
        s[0]: int(
            any(
                o[1] == s[1]
                and o[5] == "Red Cell Product Order"
                and s[3] + HOUR <= o[3] <= s[3] + 168 * HOUR
                for o in orders
            )
        )
        for s in stays
    }
    assert flags(t, "transfusion_beyond_1h") == late
    pairs = S.interval_join(
        t["edstays"].select("stay_id", "subject_id", "intime", "outtime"),
        t["labevents"],
        ["subject_id"],
        "charttime",
        S.IN_STAY,
    )
    assert Counter(r["stay_id"] for r in pairs.collect()) == Counter(
        {k: v for k, v in want.items() if v}
    )


def test_fused_plan_equals_single_features(spark):
    fx = Fixtures(spark, "/root/testdata/sf0.001")
    wide = W.wide_table(fx, with_icu_within_hour=True)
    assert "icu_within_1h" in wide.columns
    fused = {r["stay_id"]: r for r in wide.collect()}
    for f in (*P.FEATURES[:6], P.FEATURES[15], P.FEATURES[20], P.ICU_WITHIN_HOUR):
        for row in P.feature(fx, f).collect():
            assert fused[row["stay_id"]][f.column] == row[f.column], f.column


def test_flags_are_zero_or_one_and_counts_are_not_negative(spark):
    wide = W.wide_table(Fixtures(spark, "/root/testdata/sf0.01"))
    bad = [F.count_if(~F.col(c).isin(0, 1)).alias(c) for c in W.FLAG_COLUMNS]
    bad += [F.count_if(F.col(c) < 0).alias(c) for c in W.COUNT_COLUMNS]
    bad += [F.count_if(F.col(c).isNull()).alias(f"null_{c}") for c in W.COUNT_COLUMNS]
    assert set(wide.agg(*bad).first()) == {0}
    assert len(W.FLAG_COLUMNS) == 21 and len(W.COUNT_COLUMNS) == 10


def test_running_counts_plan_has_no_join_of_events_and_stays(spark):
    fx = Fixtures(spark, "/root/testdata/sf0.001")
    counts = [R.RESOURCES["lab_event_count"], R.RESOURCES["consults_count"]]
    found = S.count_in_spans(fx["edstays"], P.event_sources(fx, counts), counts)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan
    assert plan.count("Window") == 1


def test_very_long_stay_counts_days_by_blocks(spark):
    stays = [
        stay(1, hours=24 * 365 * 7900.0),
        stay(2, hours=24 * 64.0),
        stay(3, hours=24 * 65.0),
        stay(4, hours=24 * 3000.0, start=T0 + HOUR),
    ]
    rng = random.Random(3)
    whens = [T0 + dt.timedelta(hours=rng.randrange(-60, 24 * 3100), seconds=rng.randrange(3600)) for _ in range(400)]
    whens += [T0 - TICK, T0, T0 + 24 * 65 * HOUR, T0 + 24 * 65 * HOUR + TICK, dt.datetime(9900, 1, 1)]
    t = clinical(spark, edstays=stays, labevents=[(i, 1, w) for i, w in enumerate(whens)])
    counts = {r["stay_id"]: r["lab_event_count"] for r in R.resource_counts(t, ["lab_event_count"]).collect()}
    assert counts == {s[0]: sum(s[3] <= w <= s[4] for w in whens) for s in stays}
    points = S._points(t["edstays"], S._passes([R.RESOURCES["lab_event_count"]]), 1, 1).count()
    assert points < 4000


def test_one_day_of_one_subject_is_split_by_hour(spark):
    start = dt.datetime(2024, 3, 10)
    stays = [stay(i, start=start + i * HOUR / 4) for i in range(40)]
    whens = [start + dt.timedelta(seconds=7 * i) for i in range(12000)]
    t = clinical(spark, edstays=stays, labevents=[(i, 1, w) for i, w in enumerate(whens)])
    counts = {r["stay_id"]: r["lab_event_count"] for r in R.resource_counts(t, ["lab_event_count"]).collect()}
    assert counts == {s[0]: sum(s[3] <= w <= s[4] for w in whens) for s in stays}
    source = P.event_sources(t, [R.RESOURCES["lab_event_count"]])["labevents"]
    rows = S._measured(source, "labevents", S._passes([R.RESOURCES["lab_event_count"]]), 1)
    folded = rows.groupBy("pass", "k0", "level", "slot", "pos", "t").count().groupBy("level", "slot").count()
    assert max(r["count"] for r in folded.collect()) <= 3600 / 7 + 1


FAR = dt.datetime(9900, 1, 1)


def test_blocks_cover_every_day_once(spark):
    rng = random.Random(4)
    starts = [rng.randrange(-3000, 40000) for _ in range(300)]
    spans = [(i, a, a + rng.choice([0, 1, 2, 3, 5, 30, 400])) for i, a in enumerate(starts)]
    days = "date_add(DATE'1970-01-01', {0})"
    df = spark.createDataFrame(spans, "i int, a int, b int").selectExpr("i", "a", "b", f"{days.format('a')} AS s", f"{days.format('b')} AS e")
    found = {i: [] for i, *_ in spans}
    for r in S.with_blocks(df, "s", "e").collect():
        size = 4 ** r["_level"]
        found[r["i"]] += range(r["_block"] * size, (r["_block"] + 1) * size)
    for i, a, b in spans:
        assert sorted(found[i]) == list(range(a, b + 1))


def test_a_stay_to_the_year_9900_is_a_few_blocks(spark):
    t = clinical(spark, edstays=[stay(1), (2, 1, 10, T0, FAR, *STAY_FIELDS, "HOME"), stay(3, hours=-2), stay(4, hours=None)])
    for end in (S.IN_STAY.end, None):
        counts = Counter(r["stay_id"] for r in S.with_blocks(t["edstays"], "intime", end).collect())
        assert counts[2] < 100 and max(counts.values()) < 100
        assert set(counts) == ({1, 2} if end else {1, 2, 3, 4})


@pytest.mark.parametrize("span", [S.IN_STAY, S.PAST_HOUR_IN_STAY, S.PAST_HOUR, S.WEEK, S.STAY_DAYS_PLUS_ONE])
def test_interval_join_equals_brute_force_with_far_departures(spark, span):
    rng = random.Random(8)
    stays = []
    for i in range(60):
        start = T0 + rng.randrange(-3000, 3000) * HOUR
        end = rng.choice([start + rng.randrange(-5, 90) * HOUR, start + rng.randrange(500, 9000) * HOUR, FAR, None])
        stays.append((i, rng.choice([1, 1, 2, 3, None]), 10, start, end, *STAY_FIELDS, "HOME"))
    events = [(i, rng.choice([1, 1, 2, 4, None]), rng.choice([None, FAR, T0 + rng.randrange(-4000, 9000) * HOUR, T0 + HOUR])) for i in range(400)]
    # The ends of spans are events too.
    events += [(1000 + i, s[1], s[3] + k * HOUR + d) for i, s in enumerate(stays) for k, d in ((0, TICK), (0, -TICK), (1, 0 * HOUR), (1, TICK))]
    left = clinical(spark, edstays=stays)["edstays"].select("stay_id", "subject_id", "intime", "outtime")
    right = spark.createDataFrame(events, "event int, subject_id long, at timestamp_ntz")
    found = S.interval_join(left, right, ["subject_id"], "at", span)
    assert set(found.columns) == {"stay_id", "subject_id", "intime", "outtime", "event", "at"}
    left.crossJoin(right.withColumnRenamed("subject_id", "who")).createOrReplaceTempView("all_pairs")
    want = spark.sql(f"SELECT stay_id, event FROM all_pairs WHERE subject_id = who AND {span.holds('at')}")
    assert sorted(map(tuple, found.select("stay_id", "event").collect())) == sorted(map(tuple, want.collect()))


def test_one_subject_and_day_is_split_by_the_join(spark):
    """A third of all events on one subject and day: the join reads that partition in pieces."""
    settings = {
        "spark.sql.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "64k",
        "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "1.2",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "32k",
        "spark.sql.shuffle.partitions": "16",
    }
    before = {k: spark.conf.get(k, None) for k in settings}
    try:
        for k, v in settings.items():
            spark.conf.set(k, v)
        stays = spark.range(3000).selectExpr("id AS stay_id", "id % 900 AS subject_id", f"TIMESTAMP_NTZ'{T0}' + make_dt_interval(CAST(id % 20 AS INT)) AS intime").selectExpr("*", "intime + INTERVAL '20' HOUR AS outtime")
        events = spark.range(0, 90000, 1, 12).selectExpr("id AS event", "if(id % 3 = 0, 7, id % 900) AS subject_id", f"TIMESTAMP_NTZ'{T0}' + make_dt_interval(if(id % 3 = 0, 7, CAST(id % 20 AS INT))) + INTERVAL '1' HOUR AS at")
        pairs = S.interval_join(stays, events, ["subject_id"], "at", S.IN_STAY)
        n = len(pairs.collect())
        plan = pairs._jdf.queryExecution().executedPlan().toString()
        assert "skew=true" in plan
        stays.join(events, "subject_id").createOrReplaceTempView("met")
        assert n == spark.sql(f"SELECT count(*) FROM met WHERE {S.IN_STAY.holds('at')}").first()[0] > 30000
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def test_days_folded_to_blocks_equal_the_pairs(spark):
    rng = random.Random(11)
    stays = []
    for i in range(80):
        start = T0 + rng.randrange(-3000, 3000) * HOUR
        end = rng.choice([start + rng.randrange(-40, 90) * HOUR, start + rng.randrange(500, 9000) * HOUR, FAR, None])
        stays.append((i, rng.choice([1, 1, 2, None]), 10, start, end, *STAY_FIELDS, "HOME"))
    codes = sorted(P.V.CRITICAL_PROCEDURE_CODES)[:5] + ["none"]
    done = [(rng.choice([1, 2, 3, None]), 10, rng.choice([None, (T0 + rng.randrange(-4000, 9000) * HOUR).date()]), rng.choice(codes), 9) for _ in range(120)]
    t = clinical(spark, edstays=stays, procedures_icd=done)
    pairs = R.stay_procedures(t).collect()
    assert len(pairs) > 100
    least, number = {}, Counter(r["stay_id"] for r in pairs)
    for r in pairs:
        if r["procedures_icd"] != "none":
            least[r["stay_id"]] = min(r["procedures_icd"], least.get(r["stay_id"], "~"))
    assert {r["stay_id"]: r["icd_code"] for r in P.critical_procedure_codes(t).collect()} == least
    assert {r["stay_id"]: r["procedure_count"] for r in R.procedures_by_day(t).collect()} == number


def test_counts_by_stay_do_not_spread_the_stay(spark):
    stays = [(i, 1, 10, T0, FAR, *STAY_FIELDS, "HOME") for i in range(50)]
    given = [(1, i, T0 + k * 1000 * HOUR, "Epinephrine") for i in range(50) for k in (0, 1, 2)]
    t = clinical(spark, edstays=stays, pyxis=given, pyxis_admin_method=[("Epinephrine", "Intravenous")])
    plan = P.feature(t, [f for f in P.FEATURES if f.column == "tier1_med_usage_beyond_1h"][0])._jdf.queryExecution().optimizedPlan().toString()
    assert "sequence" not in plan and "Generate" not in plan
    wide = W.wide_table(t).collect()
    assert len(wide) == 50 and {r["intravenous"] for r in wide} | {r["procedure_count"] for r in wide} <= {0, 3}
