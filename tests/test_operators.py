import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from ambulo.functions import columns as C
from ambulo.operators import bouts as B
from ambulo.operators import dmo as D
from ambulo.operators import intervals as I
from ambulo.operators import rules as W
from ambulo.operators import scores as S
from ambulo.operators import series as R
from ambulo.sources import loaders as L


def iv(spark, *rows):
    return spark.createDataFrame([(1, i, a, b) for i, (a, b) in enumerate(rows)], "rec long, id long, start long, end long")


def ev(spark, *positions):
    return spark.createDataFrame([(1, i, p) for i, p in enumerate(positions)], "rec long, id long, ic long")


def test_mutual_nearest_events_prefer_the_lower_one(spark):
    found = I.match_nearest(ev(spark, 10, 20, 40, 50), ev(spark, 15, 30, 45), ["rec"], "ic", 10).where("match_type = 'tp'")
    assert sorted((r.id_detected, r.id_reference) for r in found.collect()) == [(0, 0), (2, 2)]


@pytest.mark.parametrize("seed", range(3))
def test_nearest_events_equal_brute_force(spark, seed):
    rng = np.random.default_rng(seed)
    a, b = np.unique(rng.integers(0, 400, 60)).tolist(), np.unique(rng.integers(0, 400, 50)).tolist()
    found = I.match_nearest(ev(spark, *a), ev(spark, *b), ["rec"], "ic", 6).where("match_type = 'tp'").collect()
    near = lambda x, ys: min(range(len(ys)), key=lambda j: (abs(ys[j] - x), j))
    truth = {(i, j) for i, x in enumerate(a) if (j := near(x, b)) is not None and near(b[j], a) == i and abs(b[j] - x) <= 6}
    assert {(r.id_detected, r.id_reference) for r in found} == truth


@pytest.mark.parametrize("seed", range(3))
def test_samplewise_categories_equal_boolean_arrays(spark, seed):
    rng = np.random.default_rng(seed)

    def lists():
        edges = np.sort(rng.choice(299, 16, replace=False)) + 1
        return [(int(a), int(b)) for a, b in edges.reshape(-1, 2) if b > a]

    d, r = lists(), lists()
    found = I.categorize_per_sample(iv(spark, *d), iv(spark, *r), ["rec"], spark.createDataFrame([(1, 400)], "rec long, n_samples long")).collect()
    mask = lambda xs: np.isin(np.arange(399), [i for a, b in xs for i in range(a, b)])
    kind = np.where(mask(d) & mask(r), "tp", np.where(mask(d), "fp", np.where(mask(r), "fn", "tn")))
    mine = np.full(399, "--")
    for x in found:
        mine[x.start : x.end] = x.match_type
    assert (mine == kind).all()


def test_overlap_matches_with_and_without_buckets(spark):
    d, r = iv(spark, (0, 100), (200, 300), (400, 500), (600, 610)), iv(spark, (5, 100), (240, 300), (401, 505), (900, 950))
    plain = I.match_overlap(d, r, ["rec"])
    assert sorted(map(str, plain.collect())) == sorted(map(str, I.match_overlap(d, r, ["rec"], bucket=37).collect()))
    assert {(x.id_detected, x.id_reference) for x in plain.where("match_type = 'tp'").collect()} == {(0, 0), (2, 2)}
    with pytest.raises(ValueError):
        I.match_overlap(d, r, ["rec"], threshold=0.5)


def test_merge_and_intersect(spark):
    assert [(r.start, r.end) for r in I.merge(iv(spark, (0, 5), (6, 9), (20, 30), (22, 25)), ["rec"], 1).orderBy("start").collect()] == [(0, 9), (20, 30)]
    assert [(r.start, r.end) for r in I.intersect(iv(spark, (0, 5), (10, 20)), iv(spark, (3, 12), (15, 40)), ["rec"]).orderBy("start").collect()] == [(3, 5), (10, 12), (15, 20)]


def test_stride_selection_names_the_first_failing_rule(spark):
    rows = spark.createDataFrame([(0, 10, 1.0), (0, 1000, 0.1), (0, 100, 0.1), (0, 100, None), (0, 300, 1.0)], "start long, end long, stride_length_m double")
    found = [r.exclusion_reason for r in B.select_strides(rows, 100).collect()]
    assert found == ["stride_duration_thres", "stride_duration_thres", "stride_length_thres", "stride_length_thres", None]
    with pytest.raises(ValueError):
        B.select_strides(rows.drop("stride_length_m"), 100)
    assert B.select_strides(rows.drop("stride_length_m"), 100, incompatible="skip").where("exclusion_reason is null").count() == 3


def strides(spark, *starts):
    return spark.createDataFrame([(1, i, s, s + 100, "left" if i % 2 else "right") for i, s in enumerate(starts)], "rec long, s_id long, start long, end long, lr_label string")


def test_bouts_by_windows_equal_bouts_by_rules(spark):
    rows = strides(spark, *range(0, 500, 100), 900, 1000, 1100, *range(1600, 2200, 120))
    fast = B.assemble_bouts(rows, ["rec"], 100).select("s_id", "wb_id").toPandas().sort_values("s_id").reset_index(drop=True)
    slow = W.assemble_by_rules(rows, ["rec"], {"few": W.MinStrides(4), "break": W.MaxBreak(3)}, 100).select("s_id", "wb_id").toPandas().sort_values("s_id").reset_index(drop=True)
    pd.testing.assert_frame_equal(fast, slow, check_dtype=False)
    assert fast.wb_id.max() == 1 and fast.wb_id.isna().sum() == 3
    twice = W.assemble_by_rules(rows.withColumn("lr_label", F.lit("left")), ["rec"], {"foot": W.Alternating()}, 100)
    assert twice.select("wb_id").distinct().count() == rows.count()


def test_a_break_of_exactly_the_limit_stays_together(spark):
    rows = strides(spark, 0, 100, 500, 600)
    assert B.assemble_bouts(rows, ["rec"], 100).where("wb_id = 0").count() == 4
    assert B.assemble_bouts(rows, ["rec"], 100, max_break_s=2.99).where("wb_id is null").count() == 4


def test_thresholds_fill_from_the_rows_below(spark):
    row = next(r for r in D.threshold_rows() if (r["dmo"], r["cohort"]) == ("stride_duration_s", "PFF"))
    assert (row["literature_min"], row["literature_max"], row["global_min"], row["global_max"]) == (0.14, 0.98, 0.46, 3.0)


def test_mask_cascades(spark):
    schema = "wb_id long, duration_s double, stride_length_m double, cadence_spm double, walking_speed_mps double, n_turns long"
    bouts = spark.createDataFrame([(i, 20.0, 1.0, 100.0, 1.0, 2) for i in range(4)], schema)
    mask = spark.createDataFrame([(0, True, True, True, True), (1, False, True, True, True), (2, True, False, True, True), (3, None, None, None, None)], "wb_id long, duration_s boolean, stride_length_m boolean, cadence_spm boolean, walking_speed_mps boolean")
    found = {r.wb_id: r for r in D.mask_bouts(bouts, mask, ["wb_id"]).collect()}
    assert found[0].walking_speed_mps == found[3].walking_speed_mps == 1.0
    assert found[1].n_turns is None and found[1].cadence_spm is None
    assert found[2].walking_speed_mps is None and found[2].stride_length_m is None and found[2].cadence_spm == 100
    with pytest.raises(Exception, match="no row in the mask"):
        D.mask_bouts(bouts, mask.where("wb_id < 2"), ["wb_id"]).collect()


def test_counts_without_long_bouts(spark):
    bouts = spark.createDataFrame([("a", 5.0, 3), ("a", 6.0, None)], "participant_id string, duration_s double, n_turns long")
    r = D.Aggregator(("participant_id",))(bouts).first()
    assert (r.wb_all_sum, r.wb_10_sum, r.wb_60_sum, r.wb_1030_sum, r.turns_all_sum) == (2, 0, 0, None, 3)
    assert r.walkdur_all_sum == pytest.approx(11 / 60) and "ws_30_avg" not in r.asDict()


def test_longest_stride(spark):
    leg = 0.53 * 1.8
    rise = 0.038 * 9.80665 * leg
    assert spark.range(1).select(C.longest_stride(F.lit(1.8))).first()[0] == pytest.approx(4 * math.sqrt(2 * leg * rise - rise**2))


def test_icc_equals_mean_squares(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(10, 3, 30)
    y = x + rng.normal(0.5, 1, 30)
    n, m = 30, np.stack([x, y], axis=1)
    rows, cols, all_ = m.mean(axis=1), m.mean(axis=0), m.mean()
    msr, msc = 2 * ((rows - all_) ** 2).sum() / (n - 1), n * ((cols - all_) ** 2).sum()
    mse = ((m - rows[:, None] - cols + all_) ** 2).sum() / (n - 1)
    df = spark.createDataFrame([(float(a), float(b)) for a, b in m] + [(1.0, None)], "r double, d double")
    assert S.icc(df, [], "r", "d").first().icc == pytest.approx((msr - mse) / (msr + mse + 2 * (msc - mse) / n))
    assert S.icc(df, [], "r", "d", "icc3").first().icc == pytest.approx((msr - mse) / (msr + mse))


def test_groups_without_partners_get_empty_frames(spark):
    a = spark.createDataFrame([(1, 2.0), (2, 3.0)], "k long, v double")
    b = spark.createDataFrame([(2, 5.0), (3, 7.0)], "k long, v double")
    f = lambda x, y: pd.DataFrame({"k": [x.k.iloc[0]], "n": [len(y)]})
    assert sorted(map(tuple, S.apply_with(a, b, ["k"], f, "k long, n long").collect())) == [(1, 0), (2, 1)]


def test_seconds_to_regions_by_hand(spark):
    secs = spark.createDataFrame([(1, 50, 1.0), (1, 150, 3.0), (1, 250, 5.0)], "rec long, sec_center_samples long, v double")
    regions = spark.createDataFrame([(1, 0, 0, 100), (1, 1, 50, 150), (1, 2, 0, 300), (1, 3, 200, 400)], "rec long, id long, start long, end long")
    found = {r.id: r.v for r in R.seconds_to_regions(regions, secs, ["rec"], ["v"], 100).collect()}
    assert (found[0], found[1], found[2], found[3]) == (1.0, 2.0, 3.0, None)


def test_turns_of_a_constant_rotation(spark):
    rate = [0.0] * 100 + [60 * math.sin(math.pi * i / 200) for i in range(200)] + [0.0] * 100
    rows = spark.createDataFrame([(1, i, v) for i, v in enumerate(rate)], "rec long, sample long, gyr double")
    r = R.turns(rows, ["rec"], "sample", "gyr", 100).collect()
    assert len(r) == 1 and r[0].direction == "left" and r[0].angle_deg == pytest.approx(60 * 2 * 2 / math.pi, rel=0.02)


def test_frames_round_trip(spark):
    names = [f"{s}_{a}" for s in ("acc", "gyr") for a in "xyz"]
    df = spark.createDataFrame([(1.0, 2.0, 3.0, 4.0, 5.0, 6.0)], ", ".join(f"{n} double" for n in names))
    assert C.to_body_frame(df).columns == ["acc_is", "acc_ml", "acc_pa", "gyr_is", "gyr_ml", "gyr_pa"]
    assert C.to_sensor_frame(C.to_body_frame(df)).first() == df.first()
    turned = C.rotate(df.withColumn("q", C.quaternion_about((0, 0, 1), F.lit(math.pi / 2))), "q").first()
    assert (turned.acc_gx, turned.acc_gy, turned.acc_gz) == pytest.approx((-2, 1, 3))
    with pytest.raises(ValueError):
        C.flip(df, [[1, 1, 0], [0, 1, 0], [0, 0, 1]])


def test_nan_becomes_null(spark):
    assert C.nan_to_null(spark.createDataFrame([(float("nan"), "x")], "a double, b string")).first() == (None, "x")


def test_export_dates_follow_the_site(spark):
    raw = spark.createDataFrame([("p1", "7", "1704063600", "12.5", "1", "Follow-up (T2) somewhere")], "participantid string, wb_id string, visit_date string, duration string, duration_flag string, visit_number string")
    for c in list(L.EXPORT_COLUMNS)[1:]:
        raw = raw.withColumn(c, F.lit("1"))
    sites = spark.createDataFrame([("p1", "Europe/Berlin")], "participant_id string, timezone string")
    r = L.export_bouts(raw, sites, "T2").first()
    assert (r.measurement_date, r.duration_s, r.wb_id) == ("2024-01-01", 12.5, 7) and r["duration_s__ok"]
    assert L.export_bouts(raw, sites, "T1").count() == 0


def test_conflicting_labels_become_null(spark):
    df = spark.createDataFrame([(1, 5, "left"), (1, 5, "right"), (1, 9, "left"), (1, 9, "left")], "rec long, ic long, lr_label string")
    assert {(r.ic, r.lr_label) for r in L.clean_contacts(df, ["rec"]).collect()} == {(5, None), (9, "left")}


def test_thresholds_on_a_million_bouts(spark):
    rows = spark.range(1_000_000).selectExpr("id AS wb_id", "'HA' AS cohort", "30 + id % 150 AS cadence_spm", "0.05 + (id % 250) / 100 AS walking_speed_mps", "0.1 + (id % 300) / 100 AS stride_length_m", "0.3 + (id % 40) / 10 AS stride_duration_s")
    mask = D.apply_thresholds(rows, D.threshold_table(spark), "free_living", keys=["wb_id"])
    counts = mask.agg(*[F.sum(F.col(d).cast("int")).alias(d) for d in D.CHECKED]).first()
    # plausible: 35.75 to 172.9 steps a minute, 0.0815 to 2.22 m/s, 0.1505 to 2.19 m, 0.46 to 3.2544 s
    assert counts.cadence_spm == pytest.approx(1e6 * 137 / 150, rel=0.001) and counts.walking_speed_mps == pytest.approx(1e6 * 214 / 250, rel=0.001)
    assert counts.stride_length_m == pytest.approx(1e6 * 204 / 300, rel=0.001) and counts.stride_duration_s == pytest.approx(1e6 * 28 / 40, rel=0.001)


def test_laterality_of_contacts_at_one_position(spark):
    rows = [(1, 0, 10, "left", "left"), (1, 1, 20, "left", "right"), (1, 2, 20, "right", "right"), (1, 3, 20, "left", "left"), (1, 4, 30, "right", "left")]
    for order in (rows, rows[::-1]):
        labels = spark.createDataFrame(order, "rec long, id long, ic long, ref string, det string").coalesce(1)
        found = S.laterality_scores(labels, ["rec"], "ic", "ref", "det", "id").first()
        assert (found.accuracy, found.accuracy_pairwise) == (0.6, 0.25)
    found = {S.laterality_scores(spark.createDataFrame(o, "rec long, id long, ic long, ref string, det string").coalesce(1), ["rec"], "ic", "ref", "det").first().accuracy_pairwise for o in (rows, rows[::-1])}
    assert len(found) == 1


def test_strides_of_contacts_at_one_position(spark):
    rows = [(1, 0, 10, "left"), (1, 1, 20, "left"), (1, 2, 20, "left"), (1, 3, 20, "right"), (1, 4, 30, "left")]
    for order in (rows, rows[::-1]):
        contacts = spark.createDataFrame(order, "rec long, id long, ic long, lr_label string").coalesce(1)
        found = B.strides_per_foot(contacts, ["rec"], ident="id").collect()
        assert sorted((r.id, r.start, r.end) for r in found) == [(0, 10, 20), (1, 20, 20), (2, 20, 30)]


def test_turns_of_no_angle_have_no_direction(spark):
    # a turn of -5.99 degrees and, right behind it, one whose sum is zero but for -9e-16
    rates = [0.0, 0.0, -17.9, -32.9, -18.2, -0.5, 27.4, -43.7, 33.1, 0.0, 0.0]
    rows = spark.createDataFrame([(1, i, x) for i, x in enumerate(rates)], "rec long, sample long, gyr double").coalesce(1)
    found = R.turns(rows, ["rec"], "sample", "gyr", 10, duration_s=(0, 10), angle=(0, 360)).collect()
    assert sorted((r.start, r.end, r.angle_deg, r.direction) for r in found) == [(1, 5, -5.99, "right"), (5, 9, 0.0, "none")]
