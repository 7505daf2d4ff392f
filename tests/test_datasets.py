import json

import pandas as pd
import pytest
from pyspark.sql import functions as F

from ambulo.functions.columns import GRAVITY_MS2
from ambulo.sources import datasets as S


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    root = tmp_path_factory.mktemp("study")
    for cohort, who in (("HA", "001"), ("HA", "002"), ("MS", "003")):
        rows = [("T1", test, "Trial1", i, float(i) if i else float("nan")) for test in ("Test5", "Test12") for i in range(4)]
        spark.createDataFrame(rows, "time_measure string, test string, trial string, sample long, acc_x double").coalesce(1).write.parquet(str(root / cohort / who / "Laboratory"))
        (root / cohort / who / "info.json").write_text(json.dumps({"height_m": 1.8, "cohort": cohort}))
    return str(root)


def test_folders_are_a_catalogue(spark, folder):
    data = S.Dataset.from_folders(spark, folder, ("cohort", "participant_id", None), S.LEVELS["laboratory"])
    assert data.keys == ("cohort", "participant_id", "time_measure", "test", "trial")
    index = data.index().collect()
    assert len(index) == 6 and {(r.test_name, r.test_name_pretty) for r in index} == {("WalkComfortable", "Straight Walk Comfortable"), ("Test12", "Test12")}
    part = data.subset(cohort="HA", test=["Test5"])
    assert {(r.participant_id, r.test) for r in part.index().collect()} == {("001", "Test5"), ("002", "Test5")}
    assert part.samples().where("acc_x is null").count() == 2
    with pytest.raises(ValueError, match="exactly one"):
        part.single()
    assert part.subset(participant_id="001").single().count() == 4
    assert data.within(part.index()).index().count() == 2
    with pytest.raises(ValueError):
        data.subset(colour="red")


def test_tables_in_memory(spark):
    tables = {("a", "1"): pd.DataFrame({"sample": [0, 1], "acc_x": [1.0, 2.0]}), ("b", "1"): pd.DataFrame({"sample": [0], "acc_x": [3.0]})}
    data = S.Dataset.in_memory(spark, tables, ("participant_id", "recording"))
    assert data.index().count() == 2 and data.subset(participant_id="b").single().first().acc_x == 3.0
    with pytest.raises(ValueError):
        S.Dataset.in_memory(spark, {("a",): tables[("a", "1")]}, ("participant_id", "recording"))
    with pytest.raises(ValueError):
        S.Dataset.in_memory(spark, {}, ("participant_id",))


def test_one_rate_and_units(spark):
    tests = spark.createDataFrame([("a", [100.0, 100.0])], "t string, sampling_rates array<double>")
    assert S.one_sampling_rate(tests, ["t"]).first().sampling_rate_hz == 100
    bad = spark.createDataFrame([("b", [100.0, 50.0])], "t string, sampling_rates array<double>")
    with pytest.raises(Exception, match="different sampling rates: b"):
        S.one_sampling_rate(bad, ["t"]).collect()
    raw = spark.createDataFrame([("a", [1.0, 0.5], [0.0, 0.0], [0.0, 0.0], [7.0, 8.0])], "t string, acc_x array<double>, acc_y array<double>, acc_z array<double>, gyr_x array<double>")
    rows = S.sensor_samples(raw, ["t"]).orderBy("sample").collect()
    assert [(r.sample, r.acc_x, r.gyr_x) for r in rows] == [(0, GRAVITY_MS2, 7.0), (1, GRAVITY_MS2 / 2, 8.0)]


def test_nested_tests_and_metadata(spark, folder):
    nested = spark.createDataFrame([("r", {"T1": {"Test5": {"n": 1}, "Test6": {"n": 2}}})], "rec string, d map<string, map<string, map<string, int>>>")
    rows = S.tests_of(nested, ["rec"], "d", ("time_measure", "test")).collect()
    assert {(r.time_measure, r.test, r.test_data["n"]) for r in rows} == {("T1", "Test5", 1), ("T1", "Test6", 2)}
    people = S.participants(spark, f"{folder}/*/*/info.json")
    assert {(r.participant_id, r.cohort) for r in people.collect()} == {("001", "HA"), ("002", "HA"), ("003", "MS")}
    project = spark.createDataFrame([("CTRL",), ("MS",)], "cohort string")
    assert {(r.cohort, r.height_m, r.sensor_height_m) for r in S.controls_as_healthy(project, 2.0).collect()} == {("HA", 2.0, 1.06), ("MS", 2.0, 1.06)}
    assert S.controls_as_healthy(project).where("height_m is null and sensor_height_m is null").count() == 2


def test_regions(spark):
    regions = spark.createDataFrame([("a", 0, 0, 10)], "rec string, gs_id long, start long, end long")
    lengths = spark.createDataFrame([("a", 10)], "rec string, n_samples long")
    assert S.checked_regions(regions, lengths, ["rec"]).columns == regions.columns and S.checked_regions(regions, lengths, ["rec"]).count() == 1
    for start, end in ((-1, 5), (6, 5), (0, 11)):
        wrong = regions.withColumn("start", F.lit(start)).withColumn("end", F.lit(end))
        with pytest.raises(Exception, match="within its recording"):
            S.checked_regions(wrong, lengths, ["rec"]).collect()
    assert S.id_column(regions, ["rec"]) == "gs_id" and S.id_column(regions.withColumn("wb_id", F.lit(1)), ["rec"]) == "wb_id"
    assert S.id_column(regions.withColumnRenamed("gs_id", "part"), ["rec"]) == "part" and S.id_column(regions, ["rec"], "x") == "x"
    with pytest.raises(ValueError):
        S.id_column(regions.withColumnRenamed("gs_id", "part").withColumn("other", F.lit(1)), ["rec"])
