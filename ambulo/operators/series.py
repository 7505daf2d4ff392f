"""Ordered series: per-second parameters, filters, crossings, windows, turns.

A series has one row a sample; ``by`` names its recording or region, ``position``
orders it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ambulo.operators.intervals import merge


def array_median(a: Column) -> Column:
    """Median of an array of doubles without NULLs; NULL if empty."""
    s, n = F.array_sort(a), F.size(a)
    return F.when(n > 0, (F.get(s, F.floor((n - 1) / 2).cast("int")) + F.get(s, F.floor(n / 2).cast("int"))) / 2)


def hampel(series: DataFrame, by: list[str], position: str, value: str, half_window: int, n_sigmas: float = 3.0, out: str = "filtered") -> DataFrame:
    """Replace outliers by the median of their window of 2 * half_window + 1 samples, cut at the ends.

    An outlier lies over n_sigmas times 1.4826 median absolute deviations away.
    """
    near = Window.partitionBy(*by).orderBy(position).rowsBetween(-half_window, half_window)
    rows = series.withColumn("near__", F.collect_list(value).over(near))
    rows = rows.withColumn("mid__", array_median(F.col("near__")))
    spread = array_median(F.transform("near__", lambda x: F.abs(x - F.col("mid__"))))
    far = F.abs(F.col(value) - F.col("mid__")) > n_sigmas * 1.4826 * spread
    return rows.withColumn(out, F.when(far, F.col("mid__")).otherwise(F.col(value))).drop("near__", "mid__")


def interpolate_gaps(series: DataFrame, by: list[str], position: str, value: str, max_gap: int, out: str = "filled") -> DataFrame:
    """Fill NULLs between two values by straight lines where at most max_gap samples in a row are missing."""
    w = Window.partitionBy(*by).orderBy(position)
    known = F.when(F.col(value).isNotNull(), F.struct(F.col(position).alias("p"), F.col(value).alias("v")))
    rows = series.withColumn("prev__", F.last(known, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    rows = rows.withColumn("next__", F.first(known, ignorenulls=True).over(w.rowsBetween(0, Window.unboundedFollowing)))
    p0, v0, p1, v1 = (F.col(f"{c}__.{f}") for c in ("prev", "next") for f in ("p", "v"))
    line = v0 + (v1 - v0) * (F.col(position) - p0) / F.nullif(p1 - p0, F.lit(0))
    return rows.withColumn(out, F.coalesce(F.col(value), F.when(p1 - p0 - 1 <= max_gap, line))).drop("prev__", "next__")


def seconds_of(events: DataFrame, by: list[str], position: str, value: str, sampling_rate_hz: float) -> DataFrame:
    """Mean of event values in each second, with its centre; a value on a boundary counts in both seconds."""
    second = F.floor(F.col(position) / sampling_rate_hz)
    both = F.when(F.pmod(F.col(position), F.lit(sampling_rate_hz)) == 0, F.array(second - 1, second)).otherwise(F.array(second))
    rows = events.withColumn("second", F.explode(both)).where("second >= 0")
    return rows.groupBy(*by, "second").agg(F.avg(value).alias(value)).withColumn("sec_center_samples", ((F.col("second") + 0.5) * sampling_rate_hz).cast("long"))


def seconds_to_regions(regions: DataFrame, seconds: DataFrame, by: list[str], values: list[str], sampling_rate_hz: float, ident: str = "id", center: str = "sec_center_samples") -> DataFrame:
    """Mean of per-second values over each region, as the difference of their running integral.

    The seconds of a group follow each other without a gap; a NULL makes every
    later integral of its group NULL.  Ends are found by index arithmetic, so
    both lookups are equi joins.  Regions that leave the covered time get NULL.
    """
    w = Window.partitionBy(*by).orderBy(center)
    before = w.rowsBetween(Window.unboundedPreceding, -1)
    base = F.first(center).over(w) - 0.5 * sampling_rate_hz
    table = seconds.withColumn("k__", F.row_number().over(w) - 1).withColumn("base__", base).withColumn("n__", F.count("*").over(Window.partitionBy(*by)))
    for v in values:
        lost = F.sum(F.col(v).isNull().cast("int")).over(before)
        table = table.withColumn(f"{v}__upto", F.when(F.coalesce(lost, F.lit(0)) == 0, F.coalesce(F.sum(v).over(before), F.lit(0.0))))
    spans = table.groupBy(*by).agg(F.first("base__").alias("base__"), F.first("n__").alias("n__"))
    ends = regions.join(spans, by, "left")
    for name in ("start", "end"):
        place = (F.col(name) - F.col("base__")) / sampling_rate_hz
        k = F.least(F.floor(place), F.col("n__") - 1)
        inside = (place >= -1) & (place <= F.col("n__"))
        ends = ends.withColumn(f"{name}_k", F.when(inside, F.greatest(k, F.lit(0)))).withColumn(f"{name}_part", place - F.greatest(k, F.lit(0)))
        side = table.select(*by, F.col("k__").cast("long").alias(f"{name}_k"), *[F.col(v).alias(f"{v}_{name}") for v in values], *[F.col(f"{v}__upto").alias(f"{v}_{name}_upto") for v in values])
        ends = ends.join(side, [*by, f"{name}_k"], "left")
    point = lambda v, e: F.col(f"{v}_{e}_upto") + F.col(f"{e}_part") * F.col(f"{v}_{e}")
    means = [((point(v, "end") - point(v, "start")) * sampling_rate_hz / F.nullif(F.col("end") - F.col("start"), F.lit(0))).alias(v) for v in values]
    return ends.select(*[c for c in regions.columns], *means)


def zero_crossings(series: DataFrame, by: list[str], position: str, value: str, mode: str = "both") -> DataFrame:
    """Sign changes to the next sample, 0 counting as positive, with the crossing on the straight line between."""
    w = Window.partitionBy(*by).orderBy(position)
    nxt, x = F.lead(value).over(w), F.col(value)
    rows = series.withColumns({"next__": nxt}).where(F.col("next__").isNotNull())
    rising, falling = (x < 0) & (F.col("next__") >= 0), (x >= 0) & (F.col("next__") < 0)
    kinds = {"both": rising | falling, "negative_to_positive": rising, "positive_to_negative": falling}
    return rows.where(kinds[mode]).select(*by, (F.col(position) + F.abs(x / (x - F.col("next__")))).alias("crossing"), rising.alias("rising"))


def minima_between_crossings(series: DataFrame, by: list[str], position: str, value: str) -> DataFrame:
    """Position of the smallest value in each negative run that a crossing opens and another one closes."""
    w = Window.partitionBy(*by).orderBy(position)
    neg = (F.col(value) < 0).cast("int")
    rows = series.withColumn("neg__", neg).withColumn("new__", (F.col("neg__") != F.lag("neg__").over(w)).cast("int"))
    rows = rows.withColumn("run__", F.coalesce(F.sum("new__").over(w), F.lit(0)))
    ends = rows.withColumn("last__", F.max("run__").over(Window.partitionBy(*by)))
    inner = ends.where("neg__ = 1 and run__ > 0 and run__ < last__")
    return inner.groupBy(*by, "run__").agg(F.min_by(position, F.struct(value, position)).alias("ic")).drop("run__")


def gradient(series: DataFrame, by: list[str], position: str, value: str, out: str = "gradient") -> DataFrame:
    """Central differences, one-sided at both ends."""
    w = Window.partitionBy(*by).orderBy(position)
    back, ahead, x = F.lag(value).over(w), F.lead(value).over(w), F.col(value)
    return series.withColumn(out, F.coalesce((ahead - back) / 2, ahead - x, x - back))


def sign_labels(series: DataFrame, value: str, positive: str, other: str) -> Column:
    return F.when(F.col(value) > 0, positive).otherwise(other)


def gravity_axis(series: DataFrame, by: list[str], axes: tuple[str, str, str] = ("acc_x", "acc_y", "acc_z"), threshold: float = 6.37) -> DataFrame:
    """Axis whose mean acceleration exceeds the threshold and its sign; NULL if none does."""
    means = series.groupBy(*by).agg(*[F.avg(a).alias(a) for a in axes])
    return means.withColumn("gravity", F.coalesce(*[F.when(F.abs(a) > threshold, F.concat(F.when(F.col(a) > 0, "+").otherwise("-"), F.lit(a))) for a in axes]))


def turns(series: DataFrame, by: list[str], position: str, rate: str, sampling_rate_hz: float, peak: float = 15, low: float = 5, max_gap_s: float = 0.05, duration_s: tuple[float, float] = (0.5, 10), angle: tuple[float, float] = (45, float("inf"))) -> DataFrame:
    """Turns from a smoothed angular rate in degrees a second: start, end, duration_s, angle_deg, direction.

    Around each local maximum of the absolute rate of at least ``peak`` the
    turn reaches to the crossings of ``low``; turns of one direction up to
    max_gap_s apart are united; then durations and angles are filtered.
    Angles have nine digits, so that one of zero has no direction by what the
    sums leave behind them.
    """
    w = Window.partitionBy(*by).orderBy(position)
    a = F.abs(F.col(rate))
    rows = series.select(*by, F.col(position).alias("pos"), F.col(rate).alias("rate"), a.alias("a"))
    w = Window.partitionBy(*by).orderBy("pos")
    trapezoid = F.coalesce((F.col("rate") + F.lag("rate").over(w)) / (2 * sampling_rate_hz), F.lit(0.0))
    rows = rows.withColumn("step__", trapezoid).withColumn("yaw", F.sum("step__").over(w))
    crosses = (F.col("a") < low) != (F.lead("a").over(w) < low)
    rows = rows.withColumn("cross", F.when(crosses, F.col("pos"))).withColumn("last", F.max("pos").over(Window.partitionBy(*by))).withColumn("any", F.max("cross").over(Window.partitionBy(*by)))
    rows = rows.withColumn("from", F.coalesce(F.last("cross", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.min("pos").over(Window.partitionBy(*by))))
    rows = rows.withColumn("to", F.coalesce(F.first("cross", ignorenulls=True).over(w.rowsBetween(0, Window.unboundedFollowing)), F.col("last")) + 1)
    is_peak = (F.col("a") >= peak) & (F.col("a") > F.lag("a").over(w)) & (F.col("a") > F.lead("a").over(w))
    peaks = rows.withColumn("is_peak", is_peak).where("is_peak and any is not null").select(*by, F.col("from").alias("start"), F.col("to").alias("end"))
    yaw = rows.select(*by, "pos", "yaw")

    def measured(t: DataFrame) -> DataFrame:
        for name, at in (("yaw0", F.col("start")), ("yaw1", F.col("end") - 1)):
            t = t.withColumn("pos", at).join(yaw.withColumnRenamed("yaw", name), [*by, "pos"]).drop("pos")
        t = t.withColumn("angle_deg", F.round(F.col("yaw1") - F.col("yaw0"), 9)).drop("yaw0", "yaw1")
        return t.withColumns({"duration_s": (F.col("end") - F.col("start")) / sampling_rate_hz, "direction": F.when(F.col("angle_deg") > 0, "left").when(F.col("angle_deg") < 0, "right").otherwise("none")})

    united = merge(measured(peaks), [*by, "direction"], round(max_gap_s * sampling_rate_hz)).drop("direction")
    size = F.abs("angle_deg")
    return measured(united).where(F.col("duration_s").between(*duration_s) & (size >= angle[0]) & (size <= angle[1]))


def windowed_gates(windows: DataFrame, by: list[str], value: str, least_std: float) -> DataFrame:
    """Mean and spread of each sliding window and whether it is active."""
    stats = windows.groupBy(*by, "window").agg(F.avg(value).alias("mean"), F.stddev_pop(value).alias("std"), F.count("*").alias("n"))
    return stats.withColumn("active", F.col("std") > least_std)
