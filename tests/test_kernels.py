import numpy as np
import pytest

from ambulo.functions import kernels as K

T = np.arange(1000) / 100


def response(sections, hertz, fs):
    z = np.exp(-2j * np.pi * hertz / fs)
    h = 1.0
    for b, a in sections:
        h = h * np.polyval(b[::-1], z) / np.polyval(a[::-1], z)
    return abs(h)


@pytest.mark.parametrize("order", [1, 2, 3, 4, 5])
def test_butterworth_responses(order):
    for kind, cutoff, passed, stopped in (("lowpass", 5, 0, 50), ("highpass", 5, 50, 0)):
        sections = K.butterworth(order, cutoff, 100, kind)
        assert response(sections, passed, 100) == pytest.approx(1, abs=1e-9)
        assert response(sections, cutoff, 100) == pytest.approx(np.sqrt(0.5), rel=1e-9)
        assert response(sections, stopped, 100) == pytest.approx(0, abs=1e-9)
    band = K.butterworth(order, (2, 8), 100, "bandpass")
    assert response(band, 2, 100) == pytest.approx(np.sqrt(0.5), rel=1e-6) and response(band, 8, 100) == pytest.approx(np.sqrt(0.5), rel=1e-6)
    assert response(band, 0, 100) == pytest.approx(0, abs=1e-9) and response(band, 50, 100) == pytest.approx(0, abs=1e-9)


def test_zero_phase_filters_keep_slow_and_drop_fast_waves():
    slow, fast = np.sin(2 * np.pi * 0.5 * T), np.sin(2 * np.pi * 20 * T)
    assert K.butterworth_filter(slow + fast, 4, 5, 100)[100:-100] == pytest.approx(slow[100:-100], abs=0.01)
    assert K.fir_design_filter(slow + fast, 100, 5, 100)[300:-300] == pytest.approx(slow[300:-300], abs=0.02)
    assert np.ptp(K.butterworth_filter(np.full(300, 7.0), 4, 5, 100)) < 1e-9
    with pytest.raises(ValueError, match="padlen"):
        K.butterworth_filter(np.ones(5), 4, 5, 100)


def test_fir_gain():
    assert K.fir_taps(100, 5, 100).sum() == pytest.approx(1)
    taps = K.fir_taps(100, (0.5, 3), 100, "bandpass")
    assert abs((taps * np.exp(-2j * np.pi * np.arange(101) * 1.75 / 100)).sum()) == pytest.approx(1)


def test_gait_band_needs_its_rate_and_is_symmetric():
    with pytest.raises(ValueError):
        K.gait_band(np.ones(1000), 100)
    impulse = np.zeros(1001)
    impulse[500] = 1
    y = K.gait_band(impulse, 40)
    assert y[300:701] == pytest.approx(y[300:701][::-1], abs=1e-12)


def test_smoothers_keep_polynomials_and_means():
    x = 2 + 3 * T - 0.5 * T**2
    assert K.savgol(x, 0.21, 0.1, 100)[20:-20] == pytest.approx(x[20:-20])
    assert K.gaussian(np.full(200, 3.0), 0.05, 100) == pytest.approx(np.full(200, 3.0))


def test_resample_pad_crop():
    wave = np.sin(2 * np.pi * T)
    y, fs = K.resample(40)(wave, 100)
    assert fs == 40 and len(y) == 400 and y == pytest.approx(np.sin(2 * np.pi * np.arange(400) / 40), abs=1e-9)
    z, _ = K.chain(K.pad(0.5), K.crop(0.5))(wave, 100)
    assert (z == wave).all()


def test_hampel():
    x = np.sin(T)
    x[500] = 50
    assert abs(K.hampel(x, 3)[500] - np.sin(T[500])) < 0.05
    assert np.isnan(K.hampel(np.full(5, np.nan), 2)).all()


def test_wavelet_answers_most_at_its_frequency():
    power = [np.std(K.gaus2_cwt(np.sin(2 * np.pi * f * T), 20)) for f in (0.2, 1.0, 1.5, 5, 20)]
    assert max(power) == power[1] or max(power) == power[2]


def test_madgwick_turns_with_the_gyroscope_and_levels_out():
    gyro = np.zeros((100, 3))
    gyro[:, 2] = np.pi / 2
    q = K.madgwick(gyro, np.tile([0, 0, 9.81], (100, 1)), 100)
    assert len(q) == 101 and q[-1] == pytest.approx([0, 0, np.sin(np.pi / 4), np.cos(np.pi / 4)], abs=1e-3)
    tilted = K.madgwick(np.zeros((3000, 3)), np.tile([0, 9.81, 0.0], (3000, 1)), 100, beta=0.5)
    assert abs(tilted[-1][0]) == pytest.approx(np.sin(np.pi / 4), abs=0.01)


def slow_section(x, b, a, start):
    """Sample by sample, as the filter is defined."""
    level = b.sum() / a.sum()
    s1, s2 = (level - b[0]) * start, (b[2] - a[2] * level) * start
    out = []
    for v in x:
        y = b[0] * v + s1
        s1, s2 = b[1] * v - a[1] * y + s2, b[2] * v - a[2] * y
        out.append(y)
    return np.array(out)


@pytest.mark.parametrize("shape", [(1,), (7,), (256,), (1000,), (2500, 3)])
def test_filters_in_blocks_equal_the_recursion(shape):
    x = np.random.default_rng(1).normal(5, 2, shape)
    for kind, cutoff in (("lowpass", 0.1), ("highpass", 0.1), ("bandpass", (0.5, 2)), ("lowpass", 30)):
        for b, a in K.butterworth(4, cutoff, 100, kind):
            assert K._section(x, b, a, x[0]) == pytest.approx(slow_section(x, b, a, x[0]), rel=1e-9, abs=1e-9)


def test_a_day_of_samples_filters_in_seconds():
    import time

    x = np.random.default_rng(2).normal(0, 1, 8_640_000)
    began = time.perf_counter()
    y = K.butterworth_filter(x, 4, (0.5, 2), 100, "bandpass")
    assert len(y) == len(x) and time.perf_counter() - began < 60


def test_madgwick_keeps_gravity_and_turns():
    n = 500
    still = K.madgwick(np.zeros((n, 3)), np.tile([0.0, 0.0, 9.81], (n, 1)), 100)
    assert still[-1] == pytest.approx([0, 0, 0, 1])
    turned = K.madgwick(np.tile([0.0, 0.0, np.pi / 2], (100, 1)), np.zeros((100, 3)), 100, beta=0)
    assert abs(turned[-1]) == pytest.approx([0, 0, np.sin(np.pi / 4), np.cos(np.pi / 4)], abs=1e-4)
    tilted = K.madgwick(np.zeros((3000, 3)), np.tile([0.0, 9.81 * np.sin(0.3), 9.81 * np.cos(0.3)], (3000, 1)), 100)
    assert 2 * np.arcsin(abs(tilted[-1][0])) == pytest.approx(0.3, abs=0.01)


def test_runs_of_two():
    assert K.runs_of_two(np.array([0, 0, 1, 0, 0, 1, 1, 0, 0, 1, 1, 1, 0, 0, 1, 0])).tolist() == [[5, 6], [9, 11]]
    assert K.runs_of_two(np.zeros(0)).tolist() == K.runs_of_two(np.array([1, 0, 1])).tolist() == []
    assert K.runs_of_two(np.ones(4)).tolist() == [[0, 3]]


def test_peaks_between_crossings():
    t = np.arange(300) / 100
    wave = np.sin(2 * np.pi * 2 * t)
    assert K.count_peaks_by_crossings(wave, 0.5, 5) == 6 or K.count_peaks_by_crossings(wave, 0.5, 5) == 5
    assert K.count_peaks_by_crossings(wave, 2, 5) == K.count_peaks_by_crossings(np.zeros(50), 0.1, 5) == K.count_peaks_by_crossings(np.zeros(0), 0.1, 5) == 0
    assert K.count_peaks_by_crossings(wave, 0.5, 1000) == 0


def test_active_regions_hold_the_active_part():
    t = np.arange(4000) / 40
    on = (t > 30) & (t < 70)
    x = np.where(on, np.sin(2 * np.pi * 2 * t), 0.0) + np.random.default_rng(4).normal(0, 0.01, len(t))
    found = K.active_regions(x, 40, 40)
    assert found[on].mean() > 0.9 and found[t < 28].mean() == 0 and found[t > 72].mean() == 0
    assert not K.active_regions(np.zeros(200), 40, 40).any() and not K.active_regions(np.ones(10), 40, 40).any()
