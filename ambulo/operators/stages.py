"""Detection stages: one numpy kernel per recording or region over Spark's grouped map.

Input rows are samples with keys ``by`` and ``sample``; a task holds one group.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ambulo.functions import kernels as K
from ambulo.functions.columns import GRAVITY_MS2


def per_group(samples: DataFrame, by: list[str], columns: list[str], kernel: Callable[[pd.DataFrame], pd.DataFrame], schema: str, order: str = "sample") -> DataFrame:
    """Run a kernel on the ordered samples of each group; only the named columns go to Python."""
    keys = [f"{b} {samples.schema[b].dataType.simpleString()}" for b in by]
    names = [f.split()[0] for f in schema.split(", ")]

    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        out = kernel(rows.sort_values(order, kind="stable").reset_index(drop=True))
        for name, value in zip(by, key, strict=True):
            out[name] = value
        return out[[*by, *names]]

    return samples.select(*by, order, *[c for c in columns if c != order]).groupBy(*by).applyInPandas(run, ", ".join([*keys, schema]))


def unite(intervals: np.ndarray, gap: int = 0) -> np.ndarray:
    """Merge sorted intervals that overlap or stand up to gap apart."""
    if not len(intervals):
        return intervals.reshape(0, 2)
    intervals = intervals[np.argsort(intervals[:, 0], kind="stable")]
    reach = np.maximum.accumulate(intervals[:, 1])
    first = np.flatnonzero(np.concatenate([[True], intervals[1:, 0] > reach[:-1] + gap]))
    return np.stack([intervals[first, 0], reach[np.append(first[1:], len(reach)) - 1]], axis=1)


def count_peaks(x: np.ndarray, least: float, distance: int) -> int:
    """Local maxima of at least ``least``; of two within distance the larger stays."""
    at = np.flatnonzero((x[1:-1] > x[:-2]) & (x[1:-1] >= x[2:]) & (x[1:-1] >= least)) + 1
    kept: list[int] = []
    for i in at[np.argsort(-x[at], kind="stable")]:
        if all(abs(i - j) >= distance for j in kept):
            kept.append(int(i))
    return len(kept)


def gait_sequences(samples: DataFrame, by: list[str], fs: float, *, window_s: float = 3, least_s: float = 5, thresholds_g: tuple[float, float] = (0.4 / 128, 0.4 / 128), steps_per_s: tuple[float, float] = (2 / 3, 3), change: float = 0.15, by_crossings: bool = False) -> DataFrame:
    """(by, start, end): windows with upright activity and a plausible number of steps on two axes, merged.

    by_crossings counts peaks between zero crossings at least 0.1 s apart
    instead of peaks at the distance of the fastest steps.
    """
    count, apart = (K.count_peaks_by_crossings, round(fs / 10)) if by_crossings else (count_peaks, max(1, int(fs / steps_per_s[1])))

    def kernel(rows: pd.DataFrame) -> pd.DataFrame:
        vertical, forward = rows["acc_is"].to_numpy(float), rows["acc_pa"].to_numpy(float)
        n = round(window_s * fs)
        step = n - round(n / 2)
        try:
            smooth = K.fir_design_filter(vertical, 100, (0.5, 3), fs, "bandpass")
        except ValueError:
            return pd.DataFrame({"start": [], "end": []}, dtype="int64")
        if len(vertical) < max(n, round(least_s * fs)):
            return pd.DataFrame({"start": [], "end": []}, dtype="int64")
        windows = lambda x: np.lib.stride_tricks.sliding_window_view(x, n)[::step]
        raw = windows(vertical)
        good = (windows(smooth).std(axis=1, ddof=1) > 0.01 * GRAVITY_MS2) & (raw.mean(axis=1) > 0.5 * GRAVITY_MS2)
        sine = np.sin(np.linspace(0, 2 * np.pi, round(fs / 2))) / fs
        second = round(fs)
        for x, least in ((vertical - GRAVITY_MS2, thresholds_g[0]), (forward, thresholds_g[1])):
            shaped = windows(np.convolve(x, sine, "same"))
            for k in np.flatnonzero(good):
                peaks = count(shaped[k], least * GRAVITY_MS2, apart)
                good[k] = steps_per_s[0] * window_s < peaks <= steps_per_s[1] * window_s
        begin = raw[:, :second].mean(axis=1)
        good &= np.abs((begin - raw[:, -second:].mean(axis=1)) / begin) <= change
        start = np.flatnonzero(good) * step
        found = np.clip(unite(np.stack([start, start + n + 1], axis=1)), 0, len(vertical))
        found = found[(found[:, 1] - found[:, 0]) / fs >= least_s]
        return pd.DataFrame(found, columns=["start", "end"])

    return per_group(samples, by, ["acc_is", "acc_pa"], kernel, "start long, end long")


def in_stretches(samples: DataFrame, by: list[str], detect: Callable[[DataFrame, list[str]], DataFrame], stretch: int, overlap: int) -> DataFrame:
    """Intervals of long recordings, detected in stretches of ``stretch`` samples, each with ``overlap`` more on both sides.

    detect(samples, by) gives (by, start, end).  Of each stretch only what lies
    in its core counts; intervals that meet at its ends are united.  So a task
    holds one stretch, however long the recording.  Thresholds that adapt to a
    recording adapt to a stretch here.
    """
    from ambulo.operators.intervals import merge

    core = F.floor(F.col("sample") / stretch)
    near = F.array_distinct(F.array(core, F.floor((F.col("sample") - overlap) / stretch), F.floor((F.col("sample") + overlap) / stretch)))
    parts = samples.withColumn("stretch__", F.explode(near)).where("stretch__ >= 0")
    first = F.greatest(F.col("stretch__") * stretch - overlap, F.lit(0))
    parts = parts.withColumn("sample", (F.col("sample") - first).cast("long"))
    found = detect(parts, [*by, "stretch__"])
    low, high = F.col("stretch__") * stretch, (F.col("stretch__") + 1) * stretch
    found = found.withColumn("start", F.greatest(F.col("start") + first, low)).withColumn("end", F.least(F.col("end") + first, high)).where("end > start")
    return merge(found.select(*by, "start", "end"), by)


def cadence_with_detector(samples: DataFrame, regions: DataFrame, by: list[str], fs: float, detect: Callable[[DataFrame, list[str], float], DataFrame], max_gap_s: int = 3) -> DataFrame:
    """Cadence of each region from contacts that ``detect`` finds in its own samples; contacts found elsewhere play no part."""
    return cadence(detect(samples, by, fs), regions, by, fs, max_gap_s)


def initial_contacts(samples: DataFrame, by: list[str], fs: float, width: float = 9) -> DataFrame:
    """(by, ic): minima of the wavelet-smoothed integral of vertical acceleration between its zero crossings."""
    def kernel(rows: pd.DataFrame) -> pd.DataFrame:
        x, rate = K.resample(40)(rows["acc_is"].to_numpy(float), fs)
        n = 404
        x = K.dedrifted_gait_band(np.pad(x, n, "wrap"), rate)[n - 1 : -n]
        y = K.gaus2_cwt(K.integrate(x, rate), width)
        y = y - y.mean()
        cross = np.flatnonzero((y[1:] < 0) != (y[:-1] < 0)) + 1
        at = [a + int(np.argmin(y[a:b])) for a, b in zip(cross[:-1], cross[1:], strict=True) if y[a] < 0]
        return pd.DataFrame({"ic": np.rint(np.array(at, float) * fs / rate).astype("int64")})

    return per_group(samples, by, ["acc_is"], kernel, "ic long")


def initial_contacts_by_crossings(samples: DataFrame, by: list[str], fs: float) -> DataFrame:
    """(by, ic): upward zero crossings of the smoothed acceleration norm."""
    def kernel(rows: pd.DataFrame) -> pd.DataFrame:
        norm = np.sqrt((rows[["acc_is", "acc_ml", "acc_pa"]].to_numpy(float) ** 2).sum(axis=1))
        chain = K.chain(K.resample(40), K.pad(4), K.lift(K.savgol, window_s=0.525, poly_rel=0.3), K.lift(K.dedrifted_gait_band), K.crop(4))
        x, rate = chain(norm, fs)
        x = K.gaussian(K.gaus2_cwt(x, 6), 0.05, rate)
        up = np.flatnonzero((x[:-1] < 0) & (x[1:] >= 0))
        return pd.DataFrame({"ic": np.rint(up * fs / rate).astype("int64")})

    return per_group(samples, by, ["acc_is", "acc_ml", "acc_pa"], kernel, "ic long")


def filtered(samples: DataFrame, by: list[str], value: str, kernel: K.Kernel, fs: float, out: str = "filtered") -> DataFrame:
    """(by, sample, out): a kernel's output for each sample; the kernel keeps the number of samples."""
    def run(rows: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"sample": rows["sample"], out: kernel(rows[value].to_numpy(float), fs)[0]})

    return per_group(samples, by, [value], run, f"sample long, {out} double")


def laterality_by_rate(samples: DataFrame, contacts: DataFrame, by: list[str], fs: float, axis: str = "combined") -> DataFrame:
    """contacts with lr_label: left where the band-passed angular rate isn't positive."""
    rate = {"is": F.col("gyr_is"), "pa": -F.col("gyr_pa"), "combined": F.col("gyr_is") - F.col("gyr_pa")}[axis]
    band = filtered(samples.withColumn("rate", rate), by, "rate", K.lift(K.butterworth_filter, order=4, cutoff=(0.5, 2), kind="bandpass"), fs)
    at = band.select(*by, F.col("sample").alias("ic"), "filtered")
    return contacts.drop("lr_label").join(at, [*by, "ic"]).withColumn("lr_label", F.when(F.col("filtered") <= 0, "left").otherwise("right")).drop("filtered")


def laterality_by_sway(samples: DataFrame, contacts: DataFrame, by: list[str], fs: float, cutoff: float = 1.0) -> DataFrame:
    """contacts with lr_label: right where the slope of the low-passed sideways acceleration isn't positive."""
    from ambulo.operators.series import gradient

    low = filtered(samples, by, "acc_ml", K.lift(K.butterworth_filter, order=4, cutoff=cutoff), fs)
    at = gradient(low, by, "sample", "filtered").select(*by, F.col("sample").alias("ic"), "gradient")
    return contacts.drop("lr_label").join(at, [*by, "ic"]).withColumn("lr_label", F.when(F.col("gradient") <= 0, "right").otherwise("left")).drop("gradient")


def seconds_from_steps(at_s: np.ndarray, value: np.ndarray, n_seconds: int, max_gap: int, half_window: int = 2) -> np.ndarray:
    """Outlier-filtered step values as second means, short inner gaps filled by straight lines."""
    value = K.hampel(value, half_window)
    out = np.full(n_seconds, np.nan)
    for s in range(n_seconds):
        inside = value[(at_s >= s) & (at_s <= s + 1)]
        if len(inside) and not np.isnan(inside).all():
            out[s] = np.nanmean(inside)
    out = K.hampel(out, half_window)
    known = np.flatnonzero(~np.isnan(out))
    for a, b in zip(known[:-1], known[1:], strict=True):
        if 1 < b - a <= max_gap + 1:
            out[a + 1 : b] = np.interp(np.arange(a + 1, b), [a, b], out[[a, b]])
    return out


def cadence(contacts: DataFrame, regions: DataFrame, by: list[str], fs: float, max_gap_s: int = 3) -> DataFrame:
    """(by, sec_center_samples, cadence_spm) of each region from its contacts (counted from the region's start)."""
    spans = regions.select(*by, F.ceil((F.col("end") - F.col("start")) / fs).cast("int").alias("n_seconds"))

    def kernel(rows: pd.DataFrame) -> pd.DataFrame:
        n, at = int(rows["n_seconds"].iloc[0]), rows["ic"].to_numpy(float) / fs
        centre = ((np.arange(n) + 0.5) * fs).astype("int64")
        if len(at) < 2:
            return pd.DataFrame({"sec_center_samples": centre, "cadence_spm": np.full(n, np.nan)})
        step = np.diff(at)
        return pd.DataFrame({"sec_center_samples": centre, "cadence_spm": 60 / seconds_from_steps(at, np.append(step, step[-1]), n, max_gap_s)})

    found = per_group(contacts.join(spans, by), by, ["ic", "n_seconds"], kernel, "sec_center_samples long, cadence_spm double", order="ic")
    return found.withColumn("cadence_spm", F.nanvl("cadence_spm", F.lit(None)))


def stride_length(samples: DataFrame, contacts: DataFrame, by: list[str], fs: float, height: str = "sensor_height_m", factor: float = 1.0, max_gap_s: int = 3) -> DataFrame:
    """(by, sec_center_samples, stride_length_m) from the rise of the body in each step, an inverted pendulum.

    samples: by, sample (from the region's start), acc_is and the sensor height.
    """
    listed = contacts.groupBy(*by).agg(F.sort_array(F.collect_list("ic")).alias("ics"))

    def kernel(rows: pd.DataFrame) -> pd.DataFrame:
        n = int(np.ceil(len(rows) / fs))
        centre, ics = ((np.arange(n) + 0.5) * fs).astype("int64"), np.asarray(rows["ics"].iloc[0], int)
        out = np.full(n, np.nan)
        if len(ics) > 1:
            try:
                acc = K.butterworth_filter(rows["acc_is"].to_numpy(float), 4, 0.1, fs, "highpass")
                speed = K.butterworth_filter(-np.cumsum(acc) / fs, 4, 1.0, fs, "highpass")
            except ValueError:
                return pd.DataFrame({"sec_center_samples": centre, "stride_length_m": out})
            place, high = np.cumsum(speed) / fs, float(rows[height].iloc[0])
            rise = np.array([np.ptp(place[a:b]) if b > a else 0.0 for a, b in zip(ics[:-1], ics[1:], strict=True)])
            length = factor * 2 * np.sqrt(np.abs(2 * high * rise - rise**2))
            out = 2 * seconds_from_steps(ics / fs, np.append(length, length[-1]), n, max_gap_s)
        return pd.DataFrame({"sec_center_samples": centre, "stride_length_m": out})

    found = per_group(samples.join(listed, by), by, ["acc_is", height, "ics"], kernel, "sec_center_samples long, stride_length_m double")
    return found.withColumn("stride_length_m", F.nanvl("stride_length_m", F.lit(None)))


def orientations(samples: DataFrame, by: list[str], fs: float, beta: float = 0.2) -> DataFrame:
    """(by, sample, orientation): a quaternion (x, y, z, w) for each sample, after its update."""
    def kernel(rows: pd.DataFrame) -> pd.DataFrame:
        gyro = np.deg2rad(rows[["gyr_x", "gyr_y", "gyr_z"]].to_numpy(float))
        q = K.madgwick(gyro, rows[["acc_x", "acc_y", "acc_z"]].to_numpy(float), fs, beta=beta)[1:]
        return pd.DataFrame({"sample": rows["sample"], "orientation": list(q)})

    return per_group(samples, by, [f"{s}_{a}" for s in ("acc", "gyr") for a in "xyz"], kernel, "sample long, orientation array<double>")


def pulse_trains(at: np.ndarray, first_gap: float, margin: float, least: int) -> list[tuple[int, int]]:
    """(first, last) positions of trains of pulses: the next gap may exceed the mean gap so far by ``margin``.

    A train starts with a gap under first_gap and the next one is looked for
    from the pulse behind it; one of fewer than least pulses is left out.
    """
    out, i = [], 0
    while i < len(at) - 1:
        if at[i + 1] - at[i] >= first_gap:
            i += 1
            continue
        j = i + 1
        while j + 1 < len(at) and at[j + 1] - at[j] <= (at[j] - at[i]) / (j - i) + margin:
            j += 1
        if j - i + 1 >= least:
            out.append((int(at[i]), int(at[j])))
        i = j + 1
    return out


def peaks_of(x: np.ndarray, least: float = -np.inf) -> np.ndarray:
    """Positions of local maxima of at least ``least``."""
    return np.flatnonzero((x[1:-1] > x[:-2]) & (x[1:-1] >= x[2:]) & (x[1:-1] >= least)) + 1


def active_peak_level(x: np.ndarray, rate: float, least_s: float = 3, smooth_s: float = 1) -> float | None:
    """5 % quantile of the heights of maxima and minima in active parts of over least_s; None without such a part."""
    n = round(smooth_s * rate)
    edges = np.flatnonzero(np.diff(np.concatenate([[0], K.active_regions(x, n, n).astype(np.int8), [0]])))
    spans = [(a, b) for a, b in zip(edges[::2], edges[1::2], strict=True) if b - a > round(least_s * rate)]
    if not spans:
        return None
    part = np.concatenate([x[a:b] for a, b in spans])
    heights = np.concatenate([part[peaks_of(part, 0)], -part[peaks_of(-part, 0)]])
    return float(np.percentile(heights, 5)) if len(heights) else None


def common_spans(a: list[tuple[int, int]], b: list[tuple[int, int]]) -> np.ndarray:
    """Overlaps of two lists of spans, merged."""
    found = [(max(s, u), min(e, v)) for s, e in a for u, v in b if s < v and u < e]
    return unite(np.array(found, int).reshape(-1, 2))


def gait_sequences_by_pulses(samples: DataFrame, by: list[str], fs: float, *, threshold_g: float | None = 0.1, fallback_g: float = 0.15, least_steps: int = 5, first_gap_s: float = 3.5, margin_s: float = 1.5, padding_s: float = 0.75, max_gap_s: float = 3.5) -> DataFrame:
    """(by, start, end): trains of steps in both the maxima and the minima of the smoothed acceleration norm.

    threshold_g: least height of an extremum; None takes the 5 % quantile of
    the extrema in active parts of a signal that is smoothed more, or, without
    such parts, fallback_g and the signal smoothed less.
    """
    def kernel(rows: pd.DataFrame) -> pd.DataFrame:
        norm = np.sqrt((rows[["acc_is", "acc_ml", "acc_pa"]].to_numpy(float) ** 2).sum(axis=1))
        chain = K.chain(K.resample(40), K.pad(4), K.lift(K.savgol, window_s=0.525, poly_rel=0.3), K.lift(K.dedrifted_gait_band), K.crop(4))
        x, rate = chain(norm, fs)
        x, least = K.gaussian(K.gaus2_cwt(x, 10), 0.05, rate), fallback_g * GRAVITY_MS2
        if threshold_g is not None:
            least = threshold_g * GRAVITY_MS2
        else:
            smooth = x
            for samples_wide in (2, 2, 3, 2):
                smooth = K.gaussian(smooth, samples_wide / rate, rate)
            level = active_peak_level(smooth, rate)
            if level is not None:
                x, least = smooth, level
        high, low = peaks_of(x), peaks_of(-x)
        trains = [pulse_trains(at, first_gap_s * rate, margin_s * rate, least_steps) for at in (high[x[high] > least], low[x[low] < -least])]
        spans = common_spans(*trains)
        wide = np.stack([spans[:, 0] - padding_s * rate, spans[:, 1] + padding_s * rate], axis=1).astype(int) if len(spans) else spans
        spans = unite(wide, round(max_gap_s * rate))
        spans = np.clip(np.rint(spans * fs / rate).astype(int), 0, len(norm))
        return pd.DataFrame(spans, columns=["start", "end"])

    return per_group(samples, by, ["acc_is", "acc_ml", "acc_pa"], kernel, "start long, end long")


def opened(x: np.ndarray, width: int) -> np.ndarray:
    """Grey opening: sliding minimum, then maximum, with repeated ends."""
    half = (width // 2, width - 1 - width // 2)
    slide = lambda v, f: f(np.lib.stride_tricks.sliding_window_view(np.pad(v, half, mode="edge"), width), axis=1)
    return slide(slide(x, np.min), np.max)


def closed(x: np.ndarray, width: int) -> np.ndarray:
    return -opened(-x, width)


def initial_contacts_by_morphology(samples: DataFrame, by: list[str], fs: float) -> DataFrame:
    """(by, ic): the peak of each positive run of closing minus opening of the smoothed acceleration norm, at 120 Hz."""
    def kernel(rows: pd.DataFrame) -> pd.DataFrame:
        norm = np.sqrt((rows[["acc_is", "acc_ml", "acc_pa"]].to_numpy(float) ** 2).sum(axis=1))
        chain = K.chain(K.resample(40), K.pad(4), K.lift(K.savgol, window_s=0.525, poly_rel=0.3), K.lift(K.dedrifted_gait_band), K.crop(4))
        x, rate = chain(norm, fs)
        x, rate = K.resample(120)(K.gaussian(K.gaus2_cwt(x, 6), 0.05, rate), rate)
        shape = closed(x, 32)
        top = shape - opened(shape, 18)
        edges = np.flatnonzero(np.diff(np.concatenate([[0], (top > 0).astype(int), [0]])))
        at = [a + int(np.argmax(top[a:b])) for a, b in zip(edges[::2], edges[1::2], strict=True) if b - a > 1]
        return pd.DataFrame({"ic": np.rint(np.array(at, float) * fs / rate).astype("int64")})

    return per_group(samples, by, ["acc_is", "acc_ml", "acc_pa"], kernel, "ic long")


#: Turns that put gravity upright, by where it points, as rows of (vertical, sideways, forward) in old axes (fixed values).
UPRIGHT_TURNS = {
    "is_up": np.eye(3), "is_down": np.diag([-1.0, -1.0, 1.0]),
    "ml_up": np.array([[0.0, 1.0, 0.0], [-1.0, 0.0, 0.0], [0.0, 0.0, 1.0]]), "ml_down": np.array([[0.0, -1.0, 0.0], [1.0, 0.0, 0.0], [0.0, 0.0, 1.0]]),
}
#: Names of the eight ways to wear a sensor, by where gravity points: for a positive and a negative phase once it is upright (fixed values).
WORN = {
    "is_up": ("identity", "pa_flipped__rot_pa_0"), "is_down": ("pa_normal__rot_pa_180", "pa_flipped__rot_pa_180"),
    "ml_up": ("pa_normal__rot_pa_pos90", "pa_flipped__rot_pa_pos90"), "ml_down": ("pa_normal__rot_pa_neg90", "pa_flipped__rot_pa_neg90"),
}


def gravity_family(means: np.ndarray, threshold: float) -> str | None:
    """Which of the vertical and sideways axes holds gravity, and its sign."""
    for name, value in zip(("is", "ml"), means, strict=False):
        if abs(value) >= threshold:
            return f"{name}_{'up' if value > 0 else 'down'}"
    return None


def reorient(samples: DataFrame, by: list[str], fs: float, threshold: float = 6.37, mode: str = "trust_gravity", errors: str = "ignore") -> DataFrame:
    """(by, sample, acc_is .. gyr_pa, family, phase, detected_orientation) with the axes of a walking region put right.

    The vertical or sideways axis whose mean reaches the threshold holds
    gravity (family), which is turned upright.  The phase between vertical and
    forward acceleration in the gait band then tells front from back: a
    negative one turns by half about the vertical axis.  mode trust_gravity
    leaves data as it is whose gravity is upright already; full looks for
    front and back there too.

    detected_orientation names the way the sensor was worn, ``unknown`` where
    no axis holds gravity or the phase can't be told; such data is returned
    with its gravity upright, if that is known.  errors="raise" makes that an
    error.
    """
    if mode not in ("full", "trust_gravity") or errors not in ("raise", "ignore"):
        raise ValueError("mode is full or trust_gravity, errors is raise or ignore")
    axes = ("is", "ml", "pa")

    def kernel(rows: pd.DataFrame) -> pd.DataFrame:
        acc, gyr = (rows[[f"{s}_{a}" for a in axes]].to_numpy(float) for s in ("acc", "gyr"))
        family = gravity_family(acc.mean(axis=0), threshold)
        phase, label = None, "unknown"
        if family is not None:
            acc, gyr = acc @ UPRIGHT_TURNS[family].T, gyr @ UPRIGHT_TURNS[family].T
            if mode == "trust_gravity" and family == "is_up":
                label = "identity"
            else:
                phase = K.cross_phase(acc[:, 0], acc[:, 2], fs)
                back = phase is not None and phase < 0
                if phase is not None:
                    label = WORN[family][back]
                if back:
                    acc, gyr = acc * [1, -1, -1], gyr * [1, -1, -1]
        if label == "unknown" and errors == "raise":
            raise ValueError("no axis holds gravity" if family is None else "front and back can't be told apart")
        out = pd.DataFrame({"sample": rows["sample"]})
        for sensor, values in (("acc", acc), ("gyr", gyr)):
            for i, a in enumerate(axes):
                out[f"{sensor}_{a}"] = values[:, i]
        out["family"] = pd.Series([family] * len(out), dtype=object)
        out["phase"] = np.nan if phase is None else phase
        out["detected_orientation"] = label
        return out

    columns = [f"{s}_{a}" for s in ("acc", "gyr") for a in axes]
    found = per_group(samples, by, columns, kernel, ", ".join(["sample long", *[f"{c} double" for c in columns], "family string", "phase double", "detected_orientation string"]))
    return found.withColumn("phase", F.nanvl("phase", F.lit(None)))


def orientations_of(reoriented: DataFrame, by: list[str]) -> DataFrame:
    """One row a region: (by, family, phase, detected_orientation) of what reorient found; unknown ones are left out."""
    return reoriented.where("detected_orientation <> 'unknown'").select(*by, "family", "phase", "detected_orientation").distinct()
