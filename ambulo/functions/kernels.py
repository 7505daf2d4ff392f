"""Signal kernels in numpy: each maps one array (samples along axis 0) to another.

They run inside one grouped map per recording or region; ``chain`` composes
them so that a signal crosses to Python once.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce
from math import sqrt

import numpy as np

from ambulo.functions.gait_taps import RATE_HZ, TAPS

#: Samples that a recursive filter takes at a time.
BLOCK = 256

Kernel = Callable[[np.ndarray, float], tuple[np.ndarray, float]]


def chain(*kernels: Kernel) -> Kernel:
    """One kernel that applies all in order; each gets and returns (signal, sampling rate)."""
    return lambda x, fs: reduce(lambda state, k: k(*state), kernels, (x, fs))


def lift(f: Callable[..., np.ndarray], **options) -> Kernel:
    """A kernel that leaves the sampling rate as it is; f may take it as ``fs``."""
    takes_rate = "fs" in f.__code__.co_varnames[: f.__code__.co_argcount + f.__code__.co_kwonlyargcount]
    return lambda x, fs: (f(x, **options, **({"fs": fs} if takes_rate else {})), fs)


def identity(x: np.ndarray, fs: float) -> tuple[np.ndarray, float]:
    """The kernel that changes nothing."""
    return x, fs


def butterworth(order: int, cutoff: float | tuple[float, float], fs: float, kind: str = "lowpass") -> list[tuple[np.ndarray, np.ndarray]]:
    """Sections (b, a) of a digital Butterworth filter, from the analog prototype by the bilinear transform."""
    edges = np.atleast_1d(np.asarray(cutoff, float))
    warped = 2 * fs * np.tan(np.pi * edges / fs)
    poles = np.exp(1j * np.pi * (2 * np.arange(1, order + 1) + order - 1) / (2 * order))
    if kind == "lowpass":
        poles, zeros, gain = poles * warped[0], np.zeros(0), warped[0] ** order
    elif kind == "highpass":
        poles, zeros, gain = warped[0] / poles, np.zeros(order), 1.0
    elif kind == "bandpass":
        width, centre = warped[1] - warped[0], np.sqrt(warped[0] * warped[1])
        half = poles * width / 2
        root = np.sqrt(half**2 - centre**2 + 0j)
        poles, zeros, gain = np.concatenate([half + root, half - root]), np.zeros(order), width**order
    else:
        raise ValueError(f"no such filter type: {kind}")
    fast = 2 * fs
    gain = gain * np.real(np.prod(fast - zeros) / np.prod(fast - poles))
    z = np.concatenate([(fast + zeros) / (fast - zeros), -np.ones(len(poles) - len(zeros))])
    p = (fast + poles) / (fast - poles)
    pairs = sorted([q for q in p if q.imag > 1e-12], key=abs) + sorted([q for q in p if abs(q.imag) <= 1e-12], key=abs)
    z = list(np.sort(z.real))
    sections = []
    while pairs:
        q = pairs.pop(0)
        if abs(q.imag) > 1e-12:
            a = np.array([1, -2 * q.real, abs(q) ** 2])
        else:
            other = pairs.pop(0) if pairs else None
            a = np.array([1, -q.real, 0]) if other is None else np.array([1, -(q + other).real, (q * other).real])
        zs = [z.pop(0) for _ in range(1 if a[2] == 0 and len(z) == 1 else min(1, len(z)))]
        if a[2] != 0 and z:
            zs.append(z.pop(-1))
        b = np.poly(zs) if zs else np.array([1.0])
        sections.append((np.concatenate([b, np.zeros(3 - len(b))]), a))
    sections[0] = (sections[0][0] * gain, sections[0][1])
    return sections


def _section(x: np.ndarray, b: np.ndarray, a: np.ndarray, start: np.ndarray | float) -> np.ndarray:
    """One second-order section along axis 0, in the steady state of the value ``start``.

    In state-space form, BLOCK samples at a time: a block's output is a matrix
    times its input plus another one times the state that it begins with, so
    only the states go from block to block one by one.
    """
    n, level = len(x), b.sum() / a.sum()
    flat = np.asarray(x, float).reshape(n, -1)
    begin = np.broadcast_to(np.asarray(start, float), x.shape[1:]).reshape(1, -1)
    state = np.concatenate([(level - b[0]) * begin, (b[2] - a[2] * level) * begin])
    size = min(BLOCK, n)
    step, entry = np.array([[-a[1], 1.0], [-a[2], 0.0]]), np.array([b[1] - a[1] * b[0], b[2] - a[2] * b[0]])
    powers = [np.eye(2)]
    for _ in range(size):
        powers.append(step @ powers[-1])
    seen = np.array([p[0] for p in powers[:size]])
    entered = np.array([p @ entry for p in powers[:size]])[::-1].T
    impulse = np.concatenate([[b[0]], seen[:-1] @ entry])
    lag = np.subtract.outer(np.arange(size), np.arange(size))
    answer = np.where(lag >= 0, impulse[np.maximum(lag, 0)], 0.0)
    blocks = np.concatenate([flat, np.zeros((-n % size, flat.shape[1]))]).reshape(-1, size, flat.shape[1])
    moved, whole = entered @ blocks, powers[size]
    states = np.empty_like(moved)
    for i in range(len(blocks)):
        states[i] = state
        state = whole @ state + moved[i]
    return (answer @ blocks + seen @ states).reshape(-1, flat.shape[1])[:n].reshape(x.shape)


def sos_filter(x: np.ndarray, sections: list[tuple[np.ndarray, np.ndarray]], steady: bool = False) -> np.ndarray:
    y = np.asarray(x, float)
    for b, a in sections:
        y = _section(y, b, a, y[0] if steady else np.zeros_like(y[0]))
    return y


def odd_extension(x: np.ndarray, n: int) -> np.ndarray:
    """n samples more at both ends, mirrored at the end points."""
    if n < 1:
        return x
    if len(x) <= n:
        raise ValueError(f"the signal must have over {n} samples for this padlen")
    return np.concatenate([2 * x[:1] - x[n:0:-1], x, 2 * x[-1:] - x[-2 : -n - 2 : -1]])


def butterworth_filter(x: np.ndarray, order: int, cutoff, fs: float, kind: str = "lowpass", zero_phase: bool = True) -> np.ndarray:
    """Butterworth filter, forward and backward if zero_phase."""
    sections = butterworth(order, cutoff, fs, kind)
    x = np.asarray(x, float)
    if not zero_phase:
        return sos_filter(x, sections)
    flat = sum(int(a[2] == 0) for _, a in sections)
    flat_zeros = sum(int(b[2] == 0) for b, _ in sections)
    n = 3 * (2 * len(sections) + 1 - min(flat, flat_zeros))
    y = sos_filter(odd_extension(x, n), sections, steady=True)
    return sos_filter(y[::-1], sections, steady=True)[::-1][n:-n]


def fir_taps(order: int, cutoff, fs: float, kind: str = "lowpass") -> np.ndarray:
    """order + 1 taps by the window method (Hamming), unit gain in the pass band."""
    edges = np.atleast_1d(np.asarray(cutoff, float)) / (fs / 2)
    bands = {"lowpass": [(0.0, edges[0])], "highpass": [(edges[0], 1.0)], "bandpass": [(edges[0], edges[-1])], "bandstop": [(0.0, edges[0]), (edges[-1], 1.0)]}[kind]
    n = np.arange(order + 1) - order / 2
    taps = sum(high * np.sinc(high * n) - low * np.sinc(low * n) for low, high in bands) * np.hamming(order + 1)
    low, high = bands[0]
    at = 0.0 if low == 0 else 1.0 if high == 1 else (low + high) / 2
    return taps / (taps * np.cos(np.pi * n * at)).sum()


def fir_filter(x: np.ndarray, taps: np.ndarray, zero_phase: bool = True) -> np.ndarray:
    """Convolve along axis 0; forward and backward over an odd extension of three filter lengths if zero_phase."""
    x = np.asarray(x, float)
    if x.ndim > 1:
        return np.stack([fir_filter(c, taps, zero_phase) for c in x.T], axis=1)
    if not zero_phase:
        return np.convolve(x, taps)[: len(x)]
    n = 3 * len(taps)
    y = odd_extension(x, n)
    for _ in range(2):
        y = np.convolve(np.concatenate([np.full(len(taps) - 1, y[0]), y]), taps, "valid")[::-1]
    return y[n:-n]


def fir_design_filter(x: np.ndarray, order: int, cutoff, fs: float, kind: str = "lowpass", zero_phase: bool = True) -> np.ndarray:
    return fir_filter(x, fir_taps(order, cutoff, fs, kind), zero_phase)


def _needs_gait_rate(fs: float) -> None:
    if fs != RATE_HZ:
        raise ValueError(f"this filter is made for {RATE_HZ} Hz")


def dedrift(x: np.ndarray, fs: float, pole: float = 0.9748, zero_phase: bool = True) -> np.ndarray:
    """First-order drift removal, y[n] = x[n] - x[n-1] + pole * y[n-1], for 40 Hz."""
    _needs_gait_rate(fs)
    section = [(np.array([1.0, -1.0, 0.0]), np.array([1.0, -pole, 0.0]))]
    x = np.asarray(x, float)
    if not zero_phase:
        return sos_filter(x, section)
    n = 6
    y = sos_filter(odd_extension(x, n), section, steady=True)
    return sos_filter(y[::-1], section, steady=True)[::-1][n:-n]


def gait_band(x: np.ndarray, fs: float, zero_phase: bool = True) -> np.ndarray:
    """The gait band filter for 40 Hz."""
    _needs_gait_rate(fs)
    return fir_filter(x, TAPS, zero_phase)


def dedrifted_gait_band(x: np.ndarray, fs: float, zero_phase: bool = True) -> np.ndarray:
    return gait_band(dedrift(x, fs, zero_phase=zero_phase), fs, zero_phase)


def hampel(x: np.ndarray, half_window: int, n_sigmas: float = 3.0) -> np.ndarray:
    """Outliers become the median of their window, which is cut at the ends; NaN is left out."""
    x = np.asarray(x, float)
    padded = np.concatenate([np.full(half_window, np.nan), x, np.full(half_window, np.nan)])
    near = np.lib.stride_tricks.sliding_window_view(padded, 2 * half_window + 1)
    with np.errstate(all="ignore"):
        mid = np.nanmedian(near, axis=1)
        spread = np.nanmedian(np.abs(near - mid[:, None]), axis=1)
    return np.where(np.abs(x - mid) > n_sigmas * 1.4826 * spread, mid, x)


def savgol(x: np.ndarray, window_s: float, poly_rel: float, fs: float) -> np.ndarray:
    """Savitzky-Golay smoothing with mirrored ends; the window is made odd, the order is a share of it."""
    n = round(window_s * fs)
    n += 1 - n % 2
    t = np.arange(n) - n // 2
    taps = np.linalg.pinv(np.vander(t, round(poly_rel * n) + 1, increasing=True).astype(float))[0]
    return np.convolve(np.pad(np.asarray(x, float), n // 2, mode="reflect"), taps[::-1], "valid")


def gaussian(x: np.ndarray, sigma_s: float, fs: float, truncate: float = 4.0) -> np.ndarray:
    """Gaussian smoothing with reflected ends (the end sample is repeated)."""
    sigma = sigma_s * fs
    r = int(truncate * sigma + 0.5)
    taps = np.exp(-0.5 * (np.arange(-r, r + 1) / sigma) ** 2)
    return np.convolve(np.pad(np.asarray(x, float), r, mode="symmetric"), taps / taps.sum(), "valid")


def pad(seconds: float, mode: str = "wrap") -> Kernel:
    return lambda x, fs: (np.pad(x, [(round(seconds * fs),) * 2] + [(0, 0)] * (np.ndim(x) - 1), mode=mode), fs)


def crop(seconds: float) -> Kernel:
    def run(x: np.ndarray, fs: float):
        n = round(seconds * fs)
        return x[n : len(x) - n], fs

    return run


def resample(target_hz: float) -> Kernel:
    """Resample along axis 0 by cutting or padding the spectrum."""
    def run(x: np.ndarray, fs: float):
        x = np.asarray(x, float)
        n, m = len(x), round(len(x) * target_hz / fs)
        spectrum = np.fft.rfft(x, axis=0)
        k = min(n, m)
        kept = spectrum[: k // 2 + 1].copy()
        if k % 2 == 0 and n != m:
            kept[k // 2] *= 2 if m < n else 0.5
        return np.fft.irfft(kept, m, axis=0) * (m / n), target_hz

    return run


def gaus2_cwt(x: np.ndarray, scale: float) -> np.ndarray:
    """Wavelet transform at one scale with the second derivative of a Gaussian, through its running integral."""
    points = 1024
    t = np.linspace(-5, 5, points)
    psi = -(1 - 2 * t**2) * np.exp(-(t**2)) * 2 / np.sqrt(3 * np.sqrt(np.pi / 2))
    integral = np.cumsum(psi) * (t[1] - t[0])
    j = (np.arange(scale * 10 + 1) / (scale * (t[1] - t[0]))).astype(int)
    taps = integral[j[j < points]][::-1]
    y = -np.sqrt(scale) * np.diff(np.convolve(np.asarray(x, float), taps))
    d = (len(y) - len(x)) / 2
    return y[int(np.floor(d)) : len(y) - int(np.ceil(d))]


def integrate(x: np.ndarray, fs: float) -> np.ndarray:
    """Running trapezoid integral that starts at 0."""
    x = np.asarray(x, float)
    return np.concatenate([[0.0], np.cumsum((x[1:] + x[:-1]) / 2)]) / fs


def madgwick(gyro_rad: np.ndarray, acc: np.ndarray, fs: float, start=(0.0, 0.0, 0.0, 1.0), beta: float = 0.2) -> np.ndarray:
    """Orientations (x, y, z, w), one more than samples: gyroscope integration with a gradient step towards gravity.

    Each sample depends on the one before; plain numbers are many times as
    fast here as arrays of four.
    """
    x, y, z, w = map(float, start)
    out = [(x, y, z, w)]
    for (gx, gy, gz), (ax, ay, az) in zip(gyro_rad.tolist(), acc.tolist(), strict=True):
        rw, rx = (-x * gx - y * gy - z * gz) / 2, (w * gx + y * gz - z * gy) / 2
        ry, rz = (w * gy - x * gz + z * gx) / 2, (w * gz + x * gy - y * gx) / 2
        size = sqrt(ax * ax + ay * ay + az * az)
        if beta > 0 and size > 0:
            # how far gravity lies off, and the slope of half its square
            mx = 2 * (x * z - w * y) - ax / size
            my = 2 * (w * x + y * z) - ay / size
            mz = 1 - 2 * (x * x + y * y) - az / size
            sw, sx = 2 * (x * my - y * mx), 2 * (z * mx + w * my) - 4 * x * mz
            sy, sz = 2 * (z * my - w * mx) - 4 * y * mz, 2 * (x * mx + y * my)
            length = sqrt(sw * sw + sx * sx + sy * sy + sz * sz)
            gain = beta / length if length else beta
            rw, rx, ry, rz = rw - gain * sw, rx - gain * sx, ry - gain * sy, rz - gain * sz
        w, x, y, z = w + rw / fs, x + rx / fs, y + ry / fs, z + rz / fs
        length = sqrt(w * w + x * x + y * y + z * z)
        w, x, y, z = w / length, x / length, y / length, z / length
        out.append((x, y, z, w))
    return np.array(out)


def moving_average(x: np.ndarray, n: int) -> np.ndarray:
    return np.convolve(np.asarray(x, float), np.ones(n) / n, "same")


def analytic_envelope(x: np.ndarray) -> np.ndarray:
    """Magnitude of the analytic signal."""
    n = len(x)
    weight = np.zeros(n)
    weight[0] = 1
    weight[1 : (n + 1) // 2] = 2
    if n % 2 == 0:
        weight[n // 2] = 1
    return np.abs(np.fft.ifft(np.fft.fft(x) * weight))


def active_regions(x: np.ndarray, smooth: int, duration: int) -> np.ndarray:
    """Samples that begin a stretch of ``duration`` in which the smoothed envelope stays over an adaptive level.

    The level starts at four times the mean of the centred, scaled envelope;
    each stretch wholly over it moves it halfway from the noise (the mean of
    the last quiet stretch, or of all noise so far) to a tenth of its own mean.
    """
    env = moving_average(analytic_envelope(np.asarray(x, float)), smooth)
    env = env - env.mean()
    found = np.zeros(len(env), bool)
    if len(env) < duration or not env.any():
        return found
    env = env / env.max()
    windows = np.lib.stride_tricks.sliding_window_view(env, duration)
    lowest, means = windows.min(axis=1).tolist(), windows.mean(axis=1).tolist()
    level, signal, noise = 4 * float(env.mean()), float(env.mean()), float(env.mean()) / 3
    past, any_noise, met = 0.0, False, False
    for i, (low, mean) in enumerate(zip(lowest, means, strict=True)):
        if low > level:
            found[i] = True
            signal, met = 0.1 * mean, True
        elif mean < level:
            noise = mean
        elif any_noise:
            # entries not reached yet count as zero
            noise = past / len(lowest)
        past += noise
        any_noise = any_noise or noise != 0
        if met:
            level = noise + 0.5 * abs(signal - noise)
    return found


def runs_of_two(flags: np.ndarray) -> np.ndarray:
    """(first, last) of the runs of at least two true values, both ends included."""
    edges = np.flatnonzero(np.diff(np.concatenate([[0], np.asarray(flags, bool).astype(np.int8), [0]])))
    spans = np.stack([edges[::2], edges[1::2] - 1], axis=1)
    return spans[spans[:, 1] > spans[:, 0]]


def count_peaks_by_crossings(x: np.ndarray, least: float, distance: float) -> int:
    """Highest points over ``least`` of the stretches between every other zero crossing of the centred signal.

    Only crossings with more than ``distance`` to the next one count, the last
    one never; the last stretch ends with the signal.
    """
    x = np.asarray(x, float)
    if not len(x) or x.max() < least:
        return 0
    x = x - x.mean()
    cross = np.flatnonzero(np.sign(x[1:]) != np.sign(x[:-1]))
    cross = cross[:-1][np.diff(cross) > distance][::2]
    if not len(cross):
        return 0
    if len(x) > cross[-1] + 2:
        cross = np.append(cross, len(x))
    return sum(int(x[a + 1 : b - 1].max() > least) for a, b in zip(cross[:-1], cross[1:], strict=True) if b - 1 > a + 1)


def cross_phase(x: np.ndarray, z: np.ndarray, fs: float, band: tuple[float, float] = (0.5, 2.5)) -> float | None:
    """Phase by which z leads x in a band, weighted by the power of x; None if the signals are too short or it is about zero.

    Both are band-passed (FIR, 101 taps); spectra are means over windows of
    256 samples at most, half overlapping, centred, under a periodic Hann window.
    """
    try:
        x, z = (fir_design_filter(v, 100, band, fs, "bandpass") for v in (x, z))
    except ValueError:
        return None
    n = min(256, len(x) // 2)
    if len(x) < 4 or n < 2:
        return None
    hann = 0.5 - 0.5 * np.cos(2 * np.pi * np.arange(n) / n)

    def spectra(v: np.ndarray) -> np.ndarray:
        parts = np.lib.stride_tricks.sliding_window_view(v, n)[:: n - n // 2]
        return np.fft.rfft((parts - parts.mean(axis=1, keepdims=True)) * hann, axis=1)

    a, b = spectra(x), spectra(z)
    hertz = np.fft.rfftfreq(n, 1 / fs)
    inside = (hertz >= band[0]) & (hertz <= band[1])
    power = (np.abs(a[:, inside]) ** 2).mean(axis=0)
    if not power.sum() > 0:
        return None
    phase = float(np.average(np.angle((np.conj(a[:, inside]) * b[:, inside]).mean(axis=0)), weights=power))
    return None if abs(phase) <= 1e-8 else phase
