import pytest
from pyspark.sql import functions as F

from ambulo.plans import cohort, scoring
from ambulo.sources import loaders as L
from ambulo.sources import reference as P


def test_visit_names_of_exports(spark):
    names = ["Baseline Visit (T1)", "Follow-up (T2) 6 months", "Follow-up (T3)", "Follow-up (T4)", "Follow-up (T5)", "Follow-up (T6)", "Unscheduled Visit", "Screening", None]
    rows = spark.createDataFrame([(i, n) for i, n in enumerate(names)], "i int, n string").orderBy("i")
    assert [r.v for r in rows.select("i", L.visit_name(F.col("n")).alias("v")).orderBy("i").collect()] == ["T1", "T2", "T3", "T4", "T5", "T6", "UV", None, None]


def test_maps(spark):
    report = spark.createDataFrame([("p1", "7", "Baseline Visit"), ("p1", "7", "Baseline Visit"), ("p2", "8", "Follow-up (T3)")], "participants string, results_id string, visit string")
    assert sorted(map(tuple, L.measurement_ids(report).collect())) == [("p1", "T1", 7), ("p2", "T3", 8)]
    mapping = spark.createDataFrame([("p1", "A", 1), ("p2", "B", 2)], "`Local.Participant` string, `Participant.Site` string, other int")
    assert sorted(map(tuple, L.site_of_participants(mapping, {"A": "Europe/Berlin"}).collect())) == [("p1", "A", "Europe/Berlin"), ("p2", "B", None)]


def test_validation_results(spark, tmp_path):
    keys = L.RESULT_KEYS["laboratory"]
    for name, extra in (("one", "n_wbs"), ("two", "error")):
        folder = tmp_path / "laboratory" / name
        folder.mkdir(parents=True)
        (folder / "single_results.csv").write_text(",".join([*keys, "recall", extra]) + "\n" + ",".join(["HA", "001", "T1", "t", "1", "n", "N", "0.5", "7"]) + "\n")
    rows = L.read_validation_results(spark, str(tmp_path), "laboratory", ["one", "two"]).orderBy("algorithm").collect()
    assert [(r.algorithm, r.participant_id, r.recall, r.n_wbs, r.error) for r in rows] == [("one", "001", 0.5, 7.0, None), ("two", "001", 0.5, None, 7.0)]
    with pytest.raises(ValueError):
        L.read_validation_results(spark, str(tmp_path), "street", ["one"])


def test_clinical_table(spark):
    header = [("", "ID"), ("", "Cohort"), ("Demographics", "Sex"), ("Demographics", "Age"), ("Demographics", "Height (cm)"), ("Demographics", "Weight (kg)"), ("Demographics", "BMI (kg/m2)"), ("Scores", "H&Y"), ("Scores", "Fall History")]
    raw = spark.createDataFrame([("1.0", "HA", "Male", "70", "180", "81", "N/A", "2", "yes"), ("2", "PD", "Female", "N.A.", "160", "64", "25", "N.A", "No"), (None, None, None, "70", "170", None, None, None, None)], ", ".join(f"`{n}` string" for _, n in header))
    rows = {r.participant_id: r for r in L.clinical_table(raw).collect()}
    assert rows.keys() == {"1", "2"}
    assert (rows["1"].sex, rows["1"].age, rows["1"].height_m, rows["1"].fall_history, rows["1"].h_and_y) == ("male", 70, 1.8, True, "2")
    assert rows["1"].bmi_kgpm2 == pytest.approx(25) and rows["2"].bmi_kgpm2 == 25 and rows["2"].age is None and rows["2"].h_and_y is None and rows["2"].fall_history is False
    groups = L.clinical_groups(header)
    assert groups == {"demographics": ["sex", "age", "height_m", "weight_kg", "bmi_kgpm2"], "scores": ["h_and_y", "fall_history"]}
    assert L.clinical_view(L.clinical_table(raw), groups, "scores").columns == ["cohort", "participant_id", "h_and_y", "fall_history"]


def test_missing_sensors(spark):
    tests = spark.createDataFrame([("a", ["LowerBack"]), ("b", [])], "t string, available_sensors array<string>")
    assert L.sensors_of(tests, ["LowerBack"], "ignore").count() == 2 and [r.t for r in L.sensors_of(tests, ["LowerBack"], "skip").collect()] == ["a"]
    assert {r.t: r.sensor_warning for r in L.sensors_of(tests, ["LowerBack"], "warn").collect()} == {"a": None, "b": "sensors are missing: LowerBack"}
    with pytest.raises(Exception, match="sensors are missing"):
        L.sensors_of(tests, ["LowerBack"]).collect()
    with pytest.raises(ValueError):
        L.sensors_of(tests, ["LowerBack"], "later")


def test_test_lists_round_trip(spark, tmp_path):
    rows = [(["TimeMeasure1", "Test5"], [["LowerBack", "acc"]], ["Mat"])]
    L.write_test_list(spark.createDataFrame(rows, "key array<string>, available_sensors array<array<string>>, available_reference_systems array<string>"), str(tmp_path / "list"))
    found = L.read_test_list(spark, str(tmp_path / "list")).collect()
    assert [tuple(r)[:3] for r in found] == rows and "list" in found[0].source


def bout(**more):
    base = dict.fromkeys("Start End NumberStrides Duration Length WalkingSpeed Cadence AverageStrideLength TerminationReason InitialContact_Event InitialContact_LeftRight Turn_Start Turn_End Turn_Duration Turn_Angle Stride_InitialContacts Stride_Duration Stride_Length Stride_Speed Stance_Duration Swing_Duration".split())
    return base | more


@pytest.mark.parametrize("unit", ["samples", "seconds"])
def test_reference_parameters(spark, unit):
    nan = float("nan")
    scale = 50 if unit == "samples" else 1
    first = bout(
        Start=1.0, End=4.0, NumberStrides=2.0, Duration=3.0, Length=nan, Cadence=100.0, InitialContact_Event=[1.0, 1.5, 1.5, 2.0, 2.0, nan, 4.2], InitialContact_LeftRight=["Left", "Right", "Right", "Left", "Right", "Left", "Left"],
        Turn_Start=[1.2], Turn_End=[1.8], Turn_Duration=[0.6], Turn_Angle=[-40.0], Stride_InitialContacts=[[1.0 * scale, 2.0 * scale], [1.5 * scale, 3.0 * scale], [nan, 2.0]], Stride_Duration=[1.0, nan], Stride_Length=[],
    )
    second = bout(Start=10.0, End=12.0, NumberStrides=nan, TerminationReason="turn", InitialContact_Event=[10.5], InitialContact_LeftRight=["Right"], Turn_Start=[], Stride_InitialContacts=[])
    rows = spark.createDataFrame([("r", [first, second]), ("empty", [])], f"rec string, wb {P.WB}")
    found = P.reference_parameters(rows, ["rec"], 100, 50)
    bouts = {r.wb_id: r for r in found.bouts.collect()}
    assert {k: (r.start, r.end, r.n_strides, r.length_m, r.termination_reason) for k, r in bouts.items()} == {0: (99, 400, 2, None, "Not Specified"), 1: (999, 1200, None, None, "turn")}
    contacts = sorted((r.wb_id, r.step_id, r.ic, r.lr_label) for r in found.contacts.collect())
    assert contacts == [(0, 0, 99, "left"), (0, 1, 149, "right"), (0, 3, 199, None), (1, 0, 1049, "right")]
    assert [tuple(r)[1:] for r in found.turns.collect()] == [(0, 0, 119, 180, 0.6, -40.0, "right")]
    strides = sorted((r.s_id, r.start, r.end, r.duration_s, r.length_m, r.lr_label) for r in found.strides.collect())
    assert strides == [(0, 99, 200, 1.0, None, "left"), (1, 149, 300, None, None, "right")]
    moved = P.reference_parameters(rows, ["rec"], 100, 50, relative_to_bout=True)
    assert sorted(r.ic for r in moved.contacts.collect()) == [0, 50, 50, 100] and sorted((r.start, r.end) for r in moved.strides.collect()) == [(0, 101), (50, 201)]


def test_strides_off_the_contacts_are_an_error(spark):
    wrong = bout(Start=1.0, End=4.0, InitialContact_Event=[1.0], InitialContact_LeftRight=["Left"], Stride_InitialContacts=[[7.7, 9.0]])
    rows = spark.createDataFrame([("r", [wrong])], f"rec string, wb {P.WB}")
    with pytest.raises(Exception, match="no initial contact"):
        P.reference_parameters(rows, ["rec"], 100, 50).strides.collect()


def test_study_tables_and_their_export(spark, tmp_path):
    schema = "visit_type string, participant_id string, measurement_date string, duration_s double, stride_length_m double, n_turns long"
    days = [("T1", "p", f"2024-01-0{d}") for d in range(1, 6)]
    bouts = spark.createDataFrame([(*k, 40.0 + i, 1.23456, 3) for i, k in enumerate(days) for _ in range(2)], schema)
    wear = spark.createDataFrame([(*k, h, h) for k, h in zip(days, (13.0, 14.0, 15.0, 2.0, None), strict=True)], "visit_type string, participant_id string, measurement_date string, total_worn_h double, total_worn_during_waking_h double")
    tables = cohort.study_tables(bouts, wear)
    assert {n: t.count() for n, t in tables.items()} == {"daily_agg_all": 5, "daily_agg_filtered": 3, "weekly_agg_all": 1, "weekly_agg_filtered": 1, "daily_weartime": 5, "missing_weartime": 1}
    week = tables["weekly_agg_filtered"].first()
    assert (week.n_days_w, week.walkdur_all_sum_w, week.wb_60_sum_w, week.strlen_30_avg_w) == (3, 1.0, 0.0, 123.456)
    cohort.export(tables, str(tmp_path / "out"))
    assert spark.read.csv(str(tmp_path / "out/daily_agg_all"), header=True).columns[3].endswith("_d")


def test_orientation_scores_and_emulation(spark):
    rows = spark.createDataFrame([("a", "up", "up"), ("a", "up", "down"), ("b", "down", "down"), ("b", "down", None)], "rec string, label string, prediction string")
    single, combined, matrix = scoring.orientation_scores(rows, ["rec"], ["up", "down"])
    assert {r.rec: r.accuracy for r in single.collect()} == {"a": 0.5, "b": 0.5} and combined.first()[0] == 0.5
    assert {r.label: (r.up, r.down) for r in matrix.collect()} == {"up": (1, 1), "down": (0, 1)}
    assert scoring.overall(single, ["rec"]).first()[0] == 0.5
    samples = spark.createDataFrame([("a", i, float(i)) for i in range(100)], "rec string, sample long, v double")
    bouts = spark.createDataFrame([("a", 0, 10, 20), ("a", 1, 15, 40)], "rec string, wb_id long, start long, end long")
    stage = lambda inside, b, by: inside.groupBy(*by).agg(F.min("sample").alias("first"), F.max("v").alias("v"))
    assert sorted(map(tuple, scoring.emulate(samples, bouts, ["rec"], stage).collect())) == [("a", 0, 0, 19.0), ("a", 1, 0, 39.0)]


def test_study_tables_round_halves_to_the_even_digit(spark):
    # the sum of the first day is 71.67 s = 1.1945 min and a little more by its rounding errors; the weeks' means are 1.5 and a little less
    schema = "visit_type string, participant_id string, measurement_date string, duration_s double"
    durations = {"p": [[9.3, 0.51, 31.57, 8.18, 22.11]] * 3, "q": [[9.12], [20.64], [240.24]]}
    bouts = spark.createDataFrame([("T1", p, f"2024-01-0{i}", x) for p, days in durations.items() for i, day in enumerate(days, 1) for x in day], schema).coalesce(1)
    wear = bouts.select("visit_type", "participant_id", "measurement_date").distinct().selectExpr("*", "13d AS total_worn_h", "13d AS total_worn_during_waking_h")
    tables = cohort.study_tables(bouts, wear)
    assert {r.walkdur_all_sum_d for r in tables["daily_agg_all"].where("participant_id = 'p'").collect()} == {1.194}
    assert tables["weekly_agg_filtered"].where("participant_id = 'q'").first().walkdur_all_sum_w == 2.0
