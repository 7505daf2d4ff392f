import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from ambulo.operators import stages
from ambulo.plans import walking
from ambulo.streaming import bouts as streaming

FS = 100


def walk(seconds=40, rest=10, pace=1.8, seed=0):
    """Samples of standing, walking at ``pace`` steps a second, standing."""
    rng = np.random.default_rng(seed)
    t = np.arange(int((seconds + 2 * rest) * FS)) / FS
    on = ((t >= rest) & (t < rest + seconds)).astype(float)
    wave = np.sin(2 * np.pi * pace * t)
    noise = lambda: rng.normal(0, 0.02, len(t))
    columns = {
        "acc_is": 9.81 + 2.5 * on * wave + noise(), "acc_ml": on * np.sin(np.pi * pace * t) + noise(), "acc_pa": 1.8 * on * np.cos(2 * np.pi * pace * t) + noise(),
        "gyr_is": 30 * on * np.sin(np.pi * pace * t + 0.4) + noise(), "gyr_ml": noise(), "gyr_pa": noise(),
    }
    return [(int(i), *[float(c[i]) for c in columns.values()]) for i in range(len(t))], list(columns)


@pytest.fixture(scope="module")
def samples(spark):
    rows, names = walk()
    df = spark.createDataFrame([("r1", *r) for r in rows] + [("r2", *r) for r in rows], "rec string, sample long, " + ", ".join(f"{n} double" for n in names))
    return df.cache()


@pytest.fixture(scope="module")
def recordings(spark):
    schema = "rec string, participant_id string, measurement_date string, cohort string, height_m double, sensor_height_m double"
    return spark.createDataFrame([("r1", "p1", "2024-01-01", "HA", 1.75, 0.95), ("r2", "p2", "2024-01-01", "PD", 1.7, 0.9)], schema)


def test_gait_sequences_cover_the_walk(samples):
    found = stages.gait_sequences(samples, ["rec"], FS).collect()
    assert len(found) == 2
    assert all(abs(r.start - 10 * FS) <= 3 * FS and abs(r.end - 50 * FS) <= 3 * FS for r in found)


def test_contacts_come_at_the_pace(samples):
    walking_part = samples.where("sample >= 1000 and sample < 5000 and rec = 'r1'").withColumn("sample", F.col("sample") - 1000)
    for detect in (stages.initial_contacts, stages.initial_contacts_by_crossings):
        ics = sorted(r.ic for r in detect(walking_part, ["rec"], FS).collect())
        gaps = np.diff(ics)[2:-2]
        assert abs(len(ics) - 72) <= 4 and gaps == pytest.approx(np.full(len(gaps), FS / 1.8), abs=4)


def test_whole_plan(samples, recordings):
    r = walking.analyse(samples.where("rec = 'r1'"), recordings.where("rec = 'r1'"), ["rec"], FS)
    pace = [x.cadence_spm for x in r.per_second.collect() if x.cadence_spm is not None]
    assert np.median(pace) == pytest.approx(108, abs=3)
    labels = [x.lr_label for x in r.contacts.orderBy("ic").collect()]
    assert np.mean([a != b for a, b in zip(labels, labels[1:], strict=False)]) > 0.9
    bouts = r.per_bout.collect()
    assert len(bouts) == 1 and bouts[0].n_strides > 50 and 30 < bouts[0].duration_s < 45
    day = r.daily.first()
    assert (day.participant_id, day.wb_all_sum, day.wb_30_sum, day.wb_60_sum) == ("p1", 1, 1, 0)


def test_cohorts_choose_their_settings(samples, recordings):
    days = {r.participant_id: r for r in walking.by_cohort(samples, recordings, ["rec"], FS).collect()}
    assert days.keys() == {"p1", "p2"}
    with pytest.raises(ValueError):
        walking.by_cohort(samples, recordings, ["rec"], FS, settings=(walking.REGULAR, walking.REGULAR))
    with pytest.raises(Exception, match="no setting"):
        walking.by_cohort(samples, recordings.withColumn("cohort", F.lit("??")), ["rec"], FS)


def test_orientations_are_unit_quaternions(spark):
    df = spark.createDataFrame([("a", i, 0.0, 0.0, 9.81, 0.0, 0.0, 90.0) for i in range(100)], "rec string, sample long, acc_x double, acc_y double, acc_z double, gyr_x double, gyr_y double, gyr_z double")
    last = stages.orientations(df, ["rec"], FS).where("sample = 99").first().orientation
    assert last == pytest.approx([0, 0, math.sin(math.pi / 4), math.cos(math.pi / 4)], abs=1e-3)


def test_streamed_bouts_and_days(spark, tmp_path):
    rows = [("p", f"2024-01-01 10:00:{s:02d}", 1.0) for s in (0, 1, 2, 3, 4, 20, 21, 22, 23)] + [("p", "2024-01-01 11:00:00", 1.0)]
    source = spark.createDataFrame(rows, "participant_id string, at string, duration_s double").select("participant_id", F.to_timestamp("at").alias("event_time"), "duration_s")
    source.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(source.schema).parquet(str(tmp_path / "in"))
    bouts = streaming.session_bouts(stream, ["participant_id"], late="1 minute")
    query = bouts.writeStream.format("memory").queryName("bouts").outputMode("append").start()
    query.processAllAvailable()
    query.stop()
    assert sorted(r.n_strides for r in spark.table("bouts").collect()) == [4, 5]

    batches = spark.createDataFrame([("p", "d1", 20.0, 2), ("p", "d1", 40.0, 3), ("q", "d1", 5.0, 0)], "participant_id string, day string, duration_s double, n_turns long")
    for i in range(2):
        batches.coalesce(1).write.mode("append").parquet(str(tmp_path / "days"))
        daily = spark.readStream.schema(batches.schema).parquet(str(tmp_path / "days"))
        run = streaming.write_daily(daily, ("participant_id", "day"), str(tmp_path / "out"), str(tmp_path / "check")).trigger(availableNow=True).start()
        run.awaitTermination()
        found = streaming.latest_daily(spark.read.parquet(str(tmp_path / "out/daily")), ("participant_id", "day"))
        assert {r.participant_id: r.wb_all_sum for r in found.collect()} == {"p": 2 * (i + 1), "q": i + 1}


def test_other_detectors_agree_with_the_walk(samples):
    one = samples.where("rec = 'r1'")
    for threshold in (0.1, None):
        found = stages.gait_sequences_by_pulses(one, ["rec"], FS, threshold_g=threshold).collect()
        assert found and min(r.start for r in found) <= 12 * FS and max(r.end for r in found) >= 48 * FS
    part = one.where("sample >= 1000 and sample < 5000").withColumn("sample", F.col("sample") - 1000)
    assert abs(stages.initial_contacts_by_morphology(part, ["rec"], FS).count() - 72) <= 6


def test_pulse_trains():
    at = np.array([0, 10, 20, 30, 100, 110, 121, 130, 140, 300])
    assert stages.pulse_trains(at, 35, 15, 4) == [(0, 30), (100, 140)]
    assert stages.pulse_trains(at, 5, 15, 2) == []
    assert stages.common_spans([(0, 30), (50, 90)], [(20, 60)]).tolist() == [[20, 30], [50, 60]]


def test_turned_sensors_are_put_right(samples):
    from ambulo.operators.evaluation import ORIENTATIONS, misoriented, one_orientation

    part = samples.where("rec = 'r1' and sample >= 1500 and sample < 4500")
    # this walk's forward acceleration leads the vertical one, as it should
    turned = misoriented(part)
    assert turned.count() == part.count() * len(ORIENTATIONS) == part.count() * 8
    fixed = stages.reorient(turned, ["rec", "orientation"], FS, mode="full").cache()
    seen = {r.orientation: r.detected_orientation for r in fixed.select("orientation", "detected_orientation").distinct().collect()}
    truth = {r.sample: (r.acc_is, r.acc_ml, r.acc_pa, r.gyr_is) for r in part.collect()}
    assert seen == {n: n for n in ORIENTATIONS}
    for r in fixed.where("sample % 50 = 7").collect():
        assert (r.acc_is, r.acc_ml, r.acc_pa, r.gyr_is) == pytest.approx(truth[r.sample])
    assert stages.orientations_of(fixed, ["rec", "orientation"]).count() == 8
    trusted = stages.reorient(one_orientation(part, "pa_flipped__rot_pa_0"), ["rec"], FS).first()
    assert (trusted.detected_orientation, trusted.family, trusted.phase) == ("identity", "is_up", None)
    flat = part.withColumn("acc_is", F.col("acc_is") * 0)
    assert stages.reorient(flat, ["rec"], FS).select("family", "detected_orientation").distinct().collect() == [(None, "unknown")]
    with pytest.raises(Exception, match="no axis holds gravity"):
        stages.reorient(flat, ["rec"], FS, errors="raise").collect()


def test_harness(spark):
    from ambulo.operators import evaluation as E

    df = spark.createDataFrame([(i, i % 3, float(i)) for i in range(30)], "id long, g long, v double")
    folded = E.with_folds(df, ["id"], 3)
    assert {r.fold for r in folded.collect()} == {0, 1, 2}
    scores = E.cross_validate(folded, 3, lambda t: t.agg(F.avg("v")).first()[0], lambda m, t: t.agg(F.avg(F.abs(F.col("v") - m)).alias("error")))
    assert scores.count() == 3
    long = E.aggregate_long(df, ["g"], {"mean": F.avg("v"), "n": F.count("v")})
    assert {(r.g, r.aggregation, r.value) for r in long.where("g = 1").collect()} == {(1, "mean", 14.5), (1, "n", 10.0)}
    assert "w" in E.add_columns(df, {"w": (["v"], lambda v: v * 2), "x": (["none"], lambda v: v)}, "ignore").columns
    with pytest.raises(ValueError):
        E.add_columns(df, {"x": (["none"], lambda v: v)})
    assert {(r.g, r.id) for r in E.best_in_group(df, ["g"], "v").collect()} == {(0, 27), (1, 28), (2, 29)}
    assert df.limit(1).select(E.with_range(F.lit(1.234), F.lit(1.0), F.lit(2.0))).first()[0] == "1.23 [1.00, 2.00]"


def test_left_right_machine(spark):
    from ambulo.operators import evaluation as E

    rows = [("a", i, math.sin(i / 20), math.cos(i / 20)) for i in range(600)]
    samples = spark.createDataFrame(rows, "rec string, sample long, v_is double, v_pa double")
    contacts = spark.createDataFrame([("a", i, "right" if math.sin(i / 20) > 0 else "left") for i in range(5, 590, 7)], "rec string, ic long, lr_label string")
    features = E.pendulum_features(samples, contacts, ["rec"], FS)
    model = E.train_laterality(features)
    truth = {r.ic: r.lr_label for r in contacts.collect()}
    assert np.mean([truth[r.ic] == r.lr_label for r in E.predict_laterality(model, features).collect()]) > 0.95
    tuned = E.tune_laterality(E.with_folds(features, ["ic"], 2), shrinks=(1e-3,), folds=2)
    assert np.mean([truth[r.ic] == r.lr_label for r in E.predict_laterality(tuned, features).collect()]) > 0.95


def test_lists_of_results(spark):
    from ambulo.operators import evaluation as E

    rows = spark.createDataFrame([(0, [1.0, 2.0], ["a", "b"]), (1, [], [])], "fold int, score array<double>, name array<string>")
    assert sorted(map(tuple, E.explode_lists(rows, ["score", "name"]).collect())) == [(0, 0, 1.0, "a"), (0, 1, 2.0, "b")]


def test_pulse_trains_start_behind_the_last_one():
    two = np.array([*range(0, 100, 20), *range(200, 300, 20)])
    assert stages.pulse_trains(two, 140, 60, 3) == [(0, 80), (200, 280)]
    assert stages.pulse_trains(np.array([0, 140, 280]), 140, 60, 2) == []
    assert stages.pulse_trains(np.array([0, 139, 400]), 140, 60, 2) == [(0, 139)]
    assert stages.pulse_trains(np.array([5]), 140, 60, 1) == stages.pulse_trains(np.array([]), 140, 60, 1) == []


def test_adaptive_threshold_and_crossing_counts_find_the_walk(samples):
    one = samples.where("rec = 'r1'")
    for found in (stages.gait_sequences_by_pulses(one, ["rec"], FS, threshold_g=None), stages.gait_sequences(one, ["rec"], FS, by_crossings=True)):
        covered = sum(r.end - r.start for r in found.collect())
        assert 30 * FS < covered < 52 * FS


def test_stretches_give_the_same_walk(samples):
    whole = stages.gait_sequences(samples, ["rec"], FS).collect()
    parts = stages.in_stretches(samples, ["rec"], lambda s, by: stages.gait_sequences(s, by, FS), 15 * FS, 6 * FS).collect()
    for rec in ("r1", "r2"):
        a, b = ([r for r in rows if r.rec == rec] for rows in (whole, parts))
        assert len(a) == len(b) == 1
        assert abs(a[0].start - b[0].start) <= 3 * FS and abs(a[0].end - b[0].end) <= 3 * FS


def test_cadence_with_its_own_detector(spark, samples):
    regions = spark.createDataFrame([("r1", 0, 60 * FS), ("r2", 0, 60 * FS)], "rec string, start long, end long")
    rows = stages.cadence_with_detector(samples, regions, ["rec"], FS, stages.initial_contacts_by_crossings).where("sec_center_samples between 1500 and 4500").collect()
    assert len(rows) > 50 and np.median([r.cadence_spm for r in rows if r.cadence_spm]) == pytest.approx(108, abs=4)


def test_stages_on_the_bouts_of_the_reference(spark, samples):
    from ambulo.operators.evaluation import ORIENTATIONS
    from ambulo.plans import scoring

    bouts = spark.createDataFrame([("r1", 0, 1500, 4500), ("r2", 0, 2000, 4000)], "rec string, wb_id long, start long, end long")
    contacts = scoring.emulated_contacts(samples, bouts, ["rec"], FS).cache()
    assert 50 <= contacts.where("rec = 'r1' and ic between 1500 and 4500").count() <= 58
    feet = contacts.withColumn("lr_label", F.lit("left"))
    labelled = scoring.emulated_laterality(samples, bouts, feet, ["rec"], FS)
    assert labelled.count() == contacts.count() and {r.lr_label__detected for r in labelled.collect()} == {"left", "right"}
    strides = spark.createDataFrame([("r1", 0, i, 2000 + 111 * i, 2111 + 111 * i, 1.11, 1.2) for i in range(15)], "rec string, wb_id long, id long, start long, end long, duration_s double, length_m double")
    paced = scoring.emulated_cadence(bouts, contacts, strides, ["rec"], FS)
    assert paced.count() == 15 and min(r.start for r in paced.collect()) == 2000
    own = spark.createDataFrame([("r1", 0, 108.0, 1.2)], "rec string, wb_id long, avg_cadence_spm double, avg_stride_length_m double")
    score = scoring.cadence_scores(paced, own, ["rec"]).first()
    assert abs(score.stride__rel_error) < 0.03 and abs(score.wb__error) < 4 and score.stride__reference == pytest.approx(120 / 1.11)
    tall = samples.withColumn("sensor_height_m", F.lit(0.9))
    long = scoring.emulated_stride_length(tall, bouts, contacts, strides, ["rec"], FS)
    score = scoring.stride_length_scores(long, own, ["rec"]).first()
    assert 0.2 < score.stride__detected < 2 and score.stride__reference == pytest.approx(1.2)
    seen = scoring.emulated_orientations(samples, bouts, ["rec"], FS)
    single, combined, matrix = scoring.orientation_scores(seen, ["rec"], list(ORIENTATIONS))
    assert combined.first()[0] == 1.0 and matrix.count() == 8
