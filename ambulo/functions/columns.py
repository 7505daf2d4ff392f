"""Column expressions: missing values, thresholds, unit and frame changes, errors."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Standard gravity (a fixed value).
GRAVITY_MS2 = 9.80665

#: Axis names of the coordinate frames (fixed values).
SENSOR, BODY, GLOBAL, GLOBAL_BODY = ("x", "y", "z"), ("is", "ml", "pa"), ("gx", "gy", "gz"), ("gis", "gml", "gpa")


def require(df: DataFrame, *names: str) -> None:
    missing = [n for n in names if n not in df.columns]
    if missing:
        raise ValueError(f"missing columns: {missing}")


def nan_to_null(df: DataFrame) -> DataFrame:
    """NULL for every NaN, so that aggregates skip it and comparisons with it don't hold."""
    floats = {n for n, t in df.dtypes if t in ("double", "float")}
    return df.select(*[F.nanvl(n, F.lit(None)).alias(n) if n in floats else F.col(n) for n in df.columns])


def as_samples(seconds: Column, sampling_rate_hz: float) -> Column:
    """Seconds as samples, halves to the even number."""
    return F.rint(seconds * sampling_rate_hz).cast("long")


def within(value: Column, lower: float | None = None, upper: float | None = None, inclusive: tuple[bool, bool] = (False, True)) -> Column:
    """Whether a value lies between thresholds, open at the lower and closed at the upper end unless told; NULL doesn't."""
    if lower is None and upper is None:
        raise ValueError("give a lower or an upper threshold")
    if lower is not None and upper is not None and lower >= upper:
        raise ValueError("the lower threshold must be below the upper one")
    test = F.lit(True)
    if lower is not None:
        test = test & ((value >= lower) if inclusive[0] else (value > lower))
    if upper is not None:
        test = test & ((value <= upper) if inclusive[1] else (value < upper))
    return F.coalesce(test, F.lit(False))


def frame_of(df: DataFrame) -> str:
    """Name of the first frame whose acc and gyr columns a table has."""
    for name, axes in (("sensor", SENSOR), ("body", BODY), ("global", GLOBAL), ("global_body", GLOBAL_BODY)):
        if all(f"{s}_{a}" in df.columns for s in ("acc", "gyr") for a in axes):
            return name
    raise ValueError("the table has the columns of no known frame")


def _renamed(df: DataFrame, old: tuple[str, ...], new: tuple[str, ...], sensors: tuple[str, ...] = ("acc", "gyr"), negate: str = "") -> DataFrame:
    names = {f"{s}_{a}": (f"{s}_{b}", a == negate or b == negate) for s in sensors for a, b in zip(old, new, strict=True)}
    return df.select(*[(-F.col(n) if names[n][1] else F.col(n)).alias(names[n][0]) if n in names else F.col(n) for n in df.columns])


def to_body_frame(df: DataFrame) -> DataFrame:
    """x, y, z as is, ml, pa; global gz, gy, gx as gis, gml (negated), gpa."""
    if frame_of(df) == "sensor":
        return _renamed(df, SENSOR, BODY)
    if frame_of(df) == "global":
        return _renamed(df, ("gz", "gy", "gx"), GLOBAL_BODY, negate="gml")
    raise ValueError("only sensor or global frames turn to a body frame")


def to_sensor_frame(df: DataFrame) -> DataFrame:
    """The way back from to_body_frame."""
    if frame_of(df) == "body":
        return _renamed(df, BODY, SENSOR)
    if frame_of(df) == "global_body":
        return _renamed(df, GLOBAL_BODY, ("gz", "gy", "gx"), negate="gml")
    raise ValueError("only body frames turn to a sensor frame")


def rotate(df: DataFrame, quaternion: str, sensors: tuple[str, ...] = ("acc", "gyr"), axes: tuple[str, ...] = SENSOR, out: tuple[str, ...] = GLOBAL) -> DataFrame:
    """Rotate each sample by its quaternion (array x, y, z, w); plain arithmetic on columns."""
    x, y, z, w = (F.get(quaternion, i) for i in range(4))
    rows = (
        (1 - 2 * (y * y + z * z), 2 * (x * y - z * w), 2 * (x * z + y * w)),
        (2 * (x * y + z * w), 1 - 2 * (x * x + z * z), 2 * (y * z - x * w)),
        (2 * (x * z - y * w), 2 * (y * z + x * w), 1 - 2 * (x * x + y * y)),
    )
    new = {f"{s}_{o}": sum((m * F.col(f"{s}_{a}") for m, a in zip(row, axes, strict=True)), F.lit(0.0)) for s in sensors for o, row in zip(out, rows, strict=True)}
    return df.withColumns(new).drop(*[f"{s}_{a}" for s in sensors for a in axes])


def quaternion_about(axis: tuple[float, float, float], angle_rad: Column) -> Column:
    """Quaternion (x, y, z, w) of a turn about an axis."""
    norm = math.sqrt(sum(a * a for a in axis))
    return F.array(*[F.sin(angle_rad / 2) * (a / norm) for a in axis], F.cos(angle_rad / 2))


def flip(df: DataFrame, matrix: list[list[int]], sensors: tuple[str, ...] = ("acc", "gyr"), axes: tuple[str, ...] = SENSOR) -> DataFrame:
    """Turn by multiples of 90 degrees: a permutation of the axes with signs."""
    if any(sorted(map(abs, line)) != [0, 0, 1] for line in [*matrix, *zip(*matrix, strict=True)]):
        raise ValueError("only rotations by multiples of 90 degrees can be a flip")
    new = {}
    for s in sensors:
        for a, row in zip(axes, matrix, strict=True):
            k = next(i for i, v in enumerate(row) if v)
            new[f"{s}_{a}"] = F.col(f"{s}_{axes[k]}") * row[k]
    return df.select(*[new.get(n, F.col(n)).alias(n) for n in df.columns])


def errors(reference: Column, detected: Column) -> dict[str, Column]:
    """error, rel_error, abs_error and abs_rel_error; relative ones are NULL for a zero reference."""
    error = detected - reference
    return {"error": error, "rel_error": F.try_divide(error, reference), "abs_error": F.abs(error), "abs_rel_error": F.abs(F.try_divide(error, reference))}


def walking_speed(stride_length_m: Column, cadence_spm: Column) -> Column:
    return stride_length_m * cadence_spm / 120


def longest_stride(height_m: Column) -> Column:
    """Longest plausible stride of a body height, from an inverted pendulum at a Froude number of 1."""
    leg = height_m * 0.53
    rise = GRAVITY_MS2 * leg * 0.038
    return 4 * F.sqrt(2 * leg * rise - rise * rise)
