"""Strides and walking bouts: construction, selection and assembly."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ambulo.functions.columns import require, within


def strides_per_foot(contacts: DataFrame, by: list[str], position: str = "ic", foot: str = "lr_label", ident: str | None = None) -> DataFrame:
    """Stride from each initial contact to the next one of the same foot; the last one of a foot makes none.

    Contacts at one position come in the order of ident, without it in any order.
    """
    w = Window.partitionBy(*by, foot).orderBy(position, *([ident] if ident else []))
    return contacts.withColumn("start", F.col(position)).withColumn("end", F.lead(position).over(w)).where("end is not null")


def refine_regions(contacts: DataFrame, by: list[str], position: str = "ic") -> DataFrame:
    """From the first to just behind the last contact of each region, with the contacts counted from there."""
    return contacts.groupBy(*by).agg(F.min(position).alias("start"), (F.max(position) + 1).alias("end"))


@dataclass(frozen=True)
class ParameterRule:
    """A parameter between two thresholds."""

    parameter: str
    lower: float | None = None
    upper: float | None = None
    inclusive: tuple[bool, bool] = (False, True)

    def columns(self) -> list[str]:
        return [self.parameter]

    def column(self, sampling_rate_hz: float) -> Column:
        return within(F.col(self.parameter), self.lower, self.upper, self.inclusive)


@dataclass(frozen=True)
class DurationRule:
    """The length of an interval in seconds between two thresholds."""

    lower: float | None = None
    upper: float | None = None
    inclusive: tuple[bool, bool] = (False, True)

    def columns(self) -> list[str]:
        return ["start", "end"]

    def column(self, sampling_rate_hz: float) -> Column:
        return within((F.col("end") - F.col("start")) / sampling_rate_hz, self.lower, self.upper, self.inclusive)


#: Default stride rules (fixed values).
STRIDE_RULES = {"stride_duration_thres": DurationRule(0.2, 3.0), "stride_length_thres": ParameterRule("stride_length_m", lower=0.15)}


def select_strides(strides: DataFrame, sampling_rate_hz: float, rules: dict | None = None, incompatible: str = "raise") -> DataFrame:
    """strides with column exclusion_reason: the name of the first rule that fails, NULL for strides that pass all.

    incompatible: what happens to rules whose columns are missing: raise or skip.
    """
    checks = []
    for name, rule in (STRIDE_RULES if rules is None else rules).items():
        if incompatible == "skip" and not set(rule.columns()) <= set(strides.columns):
            continue
        require(strides, *rule.columns())
        checks.append(F.when(~rule.column(sampling_rate_hz), F.lit(name)))
    return strides.withColumn("exclusion_reason", F.coalesce(*checks) if checks else F.lit(None).cast("string"))


def assemble_bouts(strides: DataFrame, by: list[str], sampling_rate_hz: float, max_break_s: float = 3, min_strides: int = 4, ident: str = "s_id", drop_last: bool = False) -> DataFrame:
    """Number the walking bouts of strides: a break over max_break_s ends one, too few strides void it.

    Breaks are counted from the end of the stride before in (start, end)
    order.  Adds pre_bout (number of the bout before any is voided), wb_id
    (NULL in voided bouts) and bout_reason.  drop_last leaves out the last
    stride before each break.
    """
    w = Window.partitionBy(*by).orderBy("start", "end", ident)
    pause = (F.col("start") - F.lag("end").over(w)) / sampling_rate_hz
    rows = strides.withColumn("new__", F.coalesce((pause > max_break_s).cast("int"), F.lit(0)))
    if drop_last:
        rows = rows.withColumn("next__", F.coalesce(F.lead("new__").over(w), F.lit(0)))
    rows = rows.withColumn("pre_bout", F.sum("new__").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    if drop_last:
        rows = rows.where("next__ = 0").drop("next__")
    rows = rows.withColumn("size__", F.count("*").over(Window.partitionBy(*by, "pre_bout")))
    kept = F.col("size__") >= min_strides
    number = F.dense_rank().over(Window.partitionBy(*by).orderBy(F.when(kept, 0).otherwise(1), "pre_bout")) - 1
    return rows.withColumn("wb_id", F.when(kept, number)).withColumn("bout_reason", F.when(~kept, "min_strides")).drop("new__", "size__")


def bout_summary(strides: DataFrame, by: list[str], sampling_rate_hz: float, contacts: DataFrame | None = None, position: str = "ic", means: tuple[str, ...] = ()) -> DataFrame:
    """Start, end, duration, number of strides and means of the strides of each bout, and its raw contacts (both ends included)."""
    from ambulo.operators.intervals import count_points

    require(strides, *by, "wb_id", "start", "end", *means)
    bouts = strides.where("wb_id is not null").groupBy(*by, "wb_id").agg(
        F.min("start").alias("start"), F.max("end").alias("end"), F.count("*").alias("n_strides"), *[F.avg(m).alias(m) for m in means]
    ).withColumn("duration_s", (F.col("end") - F.col("start")) / sampling_rate_hz)
    if contacts is None:
        return bouts
    points = count_points(bouts, contacts, by, position, "wb_id").withColumnRenamed("n_points", "n_raw_initial_contacts")
    return bouts.join(points, [*by, "wb_id"])


def regions_of(samples: DataFrame, regions: DataFrame, by: list[str], ident: str = "wb_id", position: str = "sample", bucket: int = 6000) -> DataFrame:
    """Samples of each half-open region, with their position in it: the input of a kernel per region.

    Regions may overlap; a sample comes once for each region that holds it.
    Regions are dealt out to the stretches of ``bucket`` positions that they
    touch, so a sample meets only those of its own stretch, and a long
    recording is spread over tasks.
    """
    r = regions.where("end > start").select(*by, F.col(ident), F.col("start").alias("from__"), F.col("end").alias("to__"))
    r = r.withColumn("stretch__", F.explode(F.sequence(F.floor(F.col("from__") / bucket), F.floor((F.col("to__") - 1) / bucket))))
    joined = samples.withColumn("stretch__", F.floor(F.col(position) / bucket)).join(r, [*by, "stretch__"])
    offset = F.col(position) - F.col("from__")
    inside = joined.withColumn("offset", offset).where((F.col("offset") >= 0) & (F.col(position) < F.col("to__")))
    return inside.select(*samples.columns, ident, "offset")
