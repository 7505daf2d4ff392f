"""From raw samples to daily outcomes: one plan over all recordings.

Every step is keyed by recording and gait sequence, so there is no loop over
recordings; only the signal kernels cross to Python, with the columns they need.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ambulo.functions.columns import walking_speed
from ambulo.operators import bouts, dmo, intervals, series, stages
from ambulo.plans.lineage import settled


@dataclass(frozen=True)
class Settings:
    """What differs between walking patterns."""

    cohorts: tuple[str, ...]
    contacts: str = "wavelet"
    stride_factor: float = 1.0
    cadence_gap_s: int = 3
    bout_break_s: float = 3
    min_strides: int = 4


REGULAR = Settings(("HA", "COPD", "CHF"))
IMPAIRED = Settings(("PD", "MS", "PFF", "stroke"), contacts="crossings")


@dataclass(frozen=True)
class Results:
    sequences: DataFrame
    contacts: DataFrame
    turns: DataFrame
    per_second: DataFrame
    strides: DataFrame
    per_bout: DataFrame
    mask: DataFrame
    daily: DataFrame
    names: tuple[str, ...] = field(default=("sequences", "contacts", "turns", "per_second", "strides", "per_bout", "mask", "daily"))


def analyse(samples: DataFrame, recordings: DataFrame, by: list[str], fs: float, settings: Settings = REGULAR, condition: str = "free_living", keys: tuple[str, ...] = ("participant_id", "measurement_date"), stretch_s: float = 3600, overlap_s: float = 60) -> Results:
    """All results of recordings.

    samples: by, sample, acc_is, acc_ml, acc_pa, gyr_is, gyr_ml, gyr_pa.
    recordings: by, cohort, height_m, sensor_height_m and the keys of the daily
    outcomes, one row a recording.  A sequence with fewer than two contacts is
    left out.  Sequences are looked for in stretches of stretch_s seconds, with
    overlap_s more on both sides, so that no task holds a whole long recording;
    both should be multiples of 1.5.  Per-second values are kept per sequence, contacts, turns and
    strides are counted from the recording's start.
    """
    if missing := [b for b in by if b not in recordings.columns]:
        raise ValueError(f"missing columns: {missing}")
    gs = [*by, "gs_id"]
    # windows start every 1.5 s; stretches that are multiples of that leave their grid as it is
    found = stages.in_stretches(samples, by, lambda rows, keys_: stages.gait_sequences(rows, keys_, fs), round(stretch_s * fs), round(overlap_s * fs))
    numbered = settled(found.withColumn("gs_id", F.row_number().over(series.Window.partitionBy(*by).orderBy("start")).cast("long")))
    inside = bouts.regions_of(samples, numbered, by, "gs_id").drop("sample").withColumnRenamed("offset", "sample")
    detect = stages.initial_contacts if settings.contacts == "wavelet" else stages.initial_contacts_by_crossings
    contacts = settled(stages.laterality_by_rate(inside, detect(inside, gs, fs), gs, fs))
    turned = stages.filtered(inside, gs, "gyr_is", stages.K.lift(stages.K.butterworth_filter, order=4, cutoff=0.5), fs)
    turns = settled(series.turns(settled(turned), gs, "sample", "filtered", fs))

    refined = bouts.refine_regions(contacts, gs).where("end - start > 1")
    moved = intervals.relative_to(contacts.join(refined.select(*gs), gs, "left_semi"), refined, gs, ["ic"])
    extra = recordings.select(*by, "sensor_height_m")
    region = bouts.regions_of(inside, refined.withColumn("r", F.lit(0)), gs, "r").drop("sample", "r").withColumnRenamed("offset", "sample").join(extra, by)
    pace = stages.cadence(moved, refined, gs, fs, settings.cadence_gap_s)
    length = stages.stride_length(region, moved, gs, fs, factor=settings.stride_factor)
    seconds = pace.join(length, [*gs, "sec_center_samples"], "full").join(refined.select(*gs, F.col("start").alias("at")), gs)
    seconds = seconds.withColumn("sec_center_samples", F.col("sec_center_samples") + F.col("at")).drop("at")
    seconds = settled(seconds.withColumn("walking_speed_mps", walking_speed(F.col("stride_length_m"), F.col("cadence_spm"))))

    strides = bouts.strides_per_foot(contacts, gs).withColumn("s_id", F.xxhash64(*gs, "start", "lr_label"))
    values = ["cadence_spm", "stride_length_m", "walking_speed_mps"]
    strides = series.seconds_to_regions(strides, seconds, gs, values, fs, "s_id")
    offset = numbered.select(*gs, F.col("start").alias("gs_start"))
    lift = lambda df, *cols: df.join(offset, gs).select(*[(F.col(c) + F.col("gs_start")).alias(c) if c in cols else F.col(c) for c in df.columns])
    strides = lift(strides, "start", "end", "ic").withColumn("stride_duration_s", (F.col("end") - F.col("start")) / fs)
    contacts, turns = lift(contacts, "ic"), lift(turns, "start", "end")
    picked = bouts.select_strides(strides, fs)
    assembled = settled(bouts.assemble_bouts(picked.where("exclusion_reason is null"), by, fs, settings.bout_break_s, settings.min_strides))
    per_bout = bouts.bout_summary(assembled, by, fs, contacts, means=("stride_duration_s", *values))
    middle = turns.select(*by, ((F.col("start") + F.col("end")) / 2).cast("long").alias("centre"))
    n_turns = intervals.count_points(per_bout, middle, by, "centre", "wb_id").withColumnRenamed("n_points", "n_turns")
    per_bout = settled(per_bout.join(n_turns, [*by, "wb_id"]).join(recordings.drop("sensor_height_m"), by))
    mask = dmo.apply_thresholds(per_bout, dmo.threshold_table(samples.sparkSession), condition, keys=[*by, "wb_id"], height="height_m")
    daily = dmo.Aggregator(keys)(dmo.mask_bouts(per_bout, mask, [*by, "wb_id"]))
    return Results(numbered, contacts, turns, seconds, assembled, per_bout, mask, daily)


def by_cohort(samples: DataFrame, recordings: DataFrame, by: list[str], fs: float, settings: tuple[Settings, ...] = (REGULAR, IMPAIRED), **options) -> DataFrame:
    """Daily outcomes with the settings of each recording's cohort; a cohort must be named by one setting at most."""
    names = [c for s in settings for c in s.cohorts]
    if len(names) != len(set(names)):
        raise ValueError("a cohort is named by more than one setting")
    if recordings.where(~F.coalesce(F.col("cohort").isin(names), F.lit(False))).limit(1).count():
        raise ValueError("a recording's cohort has no setting")
    parts = []
    for s in settings:
        own = recordings.where(F.col("cohort").isin(list(s.cohorts)))
        parts.append(analyse(samples.join(own.select(*by), by, "left_semi"), own, by, fs, s, **options).daily)
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out
