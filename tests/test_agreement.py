"""Published numbers of a small example of matched walking bouts, and statistics with known values."""

import numpy as np
import pytest

from ambulo.functions import distributions as dist
from ambulo.operators import intervals as I
from ambulo.operators import scores as S

COLUMNS = ["duration_s", "n_steps", "cadence_spm", "walking_speed_mps", "stride_length_m", "stride_duration_s", "n_turns"]
DETECTED = """
0 5 5.130314548730255 8 100.23243170852102 2.0616591596667155 2.9073425098352352 2.3848070176743406 1
10 15 5.436671579183576 7 101.67789628166972 2.7220358731020764 2.46969148423548 2.4394190543081713 1
20 25 9.140575746636733 12 87.48432903013381 2.2559309823260016 2.572194541963909 3.4728692239540875 3
30 35 17.204984562574136 28 92.09696175539189 1.1413493900364107 1.5955332354120522 3.507586917606629 1
40 45 6.21722816147205 9 93.98894140488451 2.5481554328149456 2.3382232273329056 3.313119782927305 0
50 55 3.5212953002685086 8 99.42581963580541 1.8208205902608423 2.8827426208622926 2.388743194969087 0
60 65 14.034648704701393 17 87.42888020285385 2.783120273366206 3.309130680003269 2.6274958316528165 1
70 75 8.296355872830782 12 86.37270008781569 2.2404910427856244 2.7218437933329125 1.6536039639585605 1
"""
REFERENCE = """
0 4 4.74702 8 99.82188 1.16079 2.51885 1.58675 0
15 19 5.1315 7 101.16429 2.57881 1.57243 1.46537 0
20 24 8.52727 12 86.53527 1.60044 1.66305 2.56092 2
35 39 16.24554 27 91.49977 0.95558 0.88961 3.14549 1
40 44 6.09907 8 93.69895 2.3323 1.95969 2.35295 0
55 59 3.25806 7 99.33525 1.14732 2.37307 1.81262 0
60 64 13.5208 17 87.09312 2.09538 2.41782 2.00582 1
75 79 7.4983 12 85.96436 2.23757 1.89026 1.55788 0
80 84 8.21455 10 75.12352 0.59915 2.16121 2.3116 0
95 99 6.84377 9 76.61402 2.22903 1.03362 3.17821 0
"""
#: measure: correlation, its interval (two digits), mean error, standard deviation of the error
EXPECTED = {
    "cadence_spm": (0.9958926841, (0.74, 1.0), 0.4963405866, 0.3058756638), "duration_s": (0.9935228258, (0.53, 1.0), 0.4071517904, 0.2144529247),
    "n_steps": (0.9927710843, (0.93, 1.0), 0.25, 0.5), "n_turns": (0.8125, (0.01, 0.99), 0.5, 0.5773502692),
    "stride_duration_s": (0.3855260209, (-0.02, 0.92), 0.8229629641, 0.1504228279), "stride_length_m": (0.3424394975, (-0.09, 0.91), 0.6418702398, 0.2984419218),
    "walking_speed_mps": (0.3983503092, (-0.09, 0.92), 0.614988962, 0.2874996977),
}


@pytest.fixture(scope="module")
def matched(spark):
    schema = "rec string, id long, start long, end long, " + ", ".join(f"{c} double" for c in COLUMNS)
    tables = []
    for text in (DETECTED, REFERENCE):
        rows = [line.split() for line in text.strip().splitlines()]
        tables.append(spark.createDataFrame([("a", i, int(r[0]), int(r[1]), *map(float, r[2:])) for i, r in enumerate(rows)], schema))
    matches = I.match_overlap(*tables, ["rec"])
    assert {r.id_detected for r in matches.where("match_type = 'tp'").collect()} == {0, 2, 4, 6}
    return I.side_by_side(matches, *tables, ["rec"])


def test_default_statistics_of_the_example(spark, matched):
    found = {(r.measure, r.origin, r.statistic): r.value for r in S.default_error_statistics(matched, []).collect()}
    assert found["all", "all", "n_datapoints"] == 4
    for name, (value, interval, mean, std) in EXPECTED.items():
        assert found[name, "all", "icc"] == pytest.approx(value, abs=1e-9)
        assert (found[name, "all", "icc_ci_lower"], found[name, "all", "icc_ci_upper"]) == pytest.approx(interval, abs=0.00501)
        assert found[name, "error", "mean"] == pytest.approx(mean, abs=1e-9)
        assert found[name, "error", "loa_upper"] == pytest.approx(mean + 1.96 * std, abs=1e-8)
    assert not any(m == "n_strides" for m, *_ in found)


def test_interval_is_null_for_perfect_agreement(spark):
    rows = spark.createDataFrame([(1.0, 1.0), (2.0, 2.0), (4.0, 4.0)], "r double, d double")
    found = S.icc(rows, [], "r", "d", interval=True).first()
    assert found.icc == 1 and found.icc_ci_lower is None and found.icc_ci_upper is None
    assert S.icc(rows.limit(1), [], "r", "d", interval=True).first().icc_ci_lower is None


def test_distributions_have_their_table_values():
    # quantiles and p values as in printed tables
    assert dist.f_quantile(0.975, 3, 3) == pytest.approx(15.4392, abs=1e-3)
    assert dist.f_quantile(0.95, 10, 20) == pytest.approx(2.3479, abs=1e-4)
    assert dist.f_quantile(0.95, 1, 1) == pytest.approx(161.4476, abs=1e-3)
    assert dist.t_two_sided(2.228139, 10) == pytest.approx(0.05, abs=1e-6)
    assert dist.t_two_sided(-12.7062, 1) == pytest.approx(0.05, abs=1e-6)
    assert dist.t_two_sided(1.959964, 1e7) == pytest.approx(0.05, abs=1e-5)
    assert dist.t_two_sided(None, 3) is dist.t_two_sided(1, None) is None
    grid = (np.arange(200_000) + 0.5) / 200_000
    density = grid**1.5 * (1 - grid) ** 3.25
    assert dist.beta_share(2.5, 4.25, 0.3) == pytest.approx(density[grid < 0.3].sum() / density.sum(), abs=1e-6)


def test_pairwise_tests_are_students_for_equal_sizes(spark):
    rows = [("ref", v) for v in (1.0, 2.0, 3.0, 4.0)] + [("same", v) for v in (2.0, 4.0, 6.0, 9.0)] + [("few", v) for v in (5.0, 6.0, 9.0)] + [("few", None)]
    df = spark.createDataFrame(rows, "version string, x double")
    found = {r.version: r for r in S.pairwise_tests(df, "version", "x", "ref").collect()}
    assert found.keys() == {"same", "few"}
    a, b = np.array([1, 2, 3, 4.0]), np.array([2, 4, 6, 9.0])
    pooled = (a.var(ddof=1) + b.var(ddof=1)) / 2
    assert found["same"].t == pytest.approx((a.mean() - b.mean()) / np.sqrt(pooled / 2)) and found["same"].dof == 6
    assert found["same"].p == pytest.approx(dist.t_two_sided(found["same"].t, 6))
    assert found["few"].dof == pytest.approx(3.14576, abs=1e-4) and found["few"].p == pytest.approx(0.0519, abs=1e-4)
    assert S.pairwise_tests(df, "version", "x", "none").count() == 0
