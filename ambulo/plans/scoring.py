"""Scorers of whole stages: a stage runs on the reference's own bouts and strides, and its values are set against theirs.

Each gives one row a recording (``by``); ``overall`` then gives their means.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ambulo.operators import intervals as I
from ambulo.operators import scores as S
from ambulo.operators import series as R
from ambulo.operators import stages
from ambulo.operators.bouts import regions_of
from ambulo.operators.evaluation import misoriented

PARTS = ("detected", "reference", "error", "rel_error", "abs_error", "abs_rel_error")


def inside_bouts(samples: DataFrame, bouts: DataFrame, by: list[str]) -> DataFrame:
    """Samples of the reference's bouts (by, wb_id, start, end), counted from the start of the bout."""
    return regions_of(samples, bouts, by).drop("sample").withColumnRenamed("offset", "sample")


def emulate(samples: DataFrame, bouts: DataFrame, by: list[str], stage: Callable[[DataFrame, DataFrame, list[str]], DataFrame]) -> DataFrame:
    """Run a stage on the reference's bouts: stage(samples in a bout, bouts, by + wb_id), times from the start of the bout."""
    return stage(inside_bouts(samples, bouts, by), bouts, [*by, "wb_id"])


def _from_start(rows: DataFrame, bouts: DataFrame, by: list[str], *columns: str, back: bool = False) -> DataFrame:
    """Columns counted from the start of the bout; back: from the start of the recording again."""
    starts = bouts.select(*by, "wb_id", F.col("start").alias("from__"))
    sign = 1 if back else -1
    return rows.join(starts, [*by, "wb_id"]).withColumns({c: F.col(c) + sign * F.col("from__") for c in columns}).drop("from__")


def emulated_contacts(samples: DataFrame, bouts: DataFrame, by: list[str], fs: float, detect: Callable[[DataFrame, list[str], float], DataFrame] = stages.initial_contacts) -> DataFrame:
    """(by, wb_id, ic) that a detector finds in the reference's bouts, counted from the start of the recording."""
    found = emulate(samples, bouts, by, lambda rows, _, keys: detect(rows, keys, fs))
    return _from_start(found, bouts, by, "ic", back=True)


def emulated_laterality(samples: DataFrame, bouts: DataFrame, contacts: DataFrame, by: list[str], fs: float, label: Callable[[DataFrame, DataFrame, list[str], float], DataFrame] = stages.laterality_by_rate) -> DataFrame:
    """The reference's contacts (by, wb_id, ic, lr_label) with lr_label__reference and the label that a stage gives them, lr_label__detected."""
    keys = [*by, "wb_id"]
    given = _from_start(contacts.select(*keys, "ic", F.col("lr_label").alias("lr_label__reference")), bouts, by, "ic")
    found = emulate(samples, bouts, by, lambda rows, _, k: label(rows, given, k, fs)).withColumnRenamed("lr_label", "lr_label__detected")
    return _from_start(found, bouts, by, "ic", back=True)


def emulated_cadence(bouts: DataFrame, contacts: DataFrame, strides: DataFrame, by: list[str], fs: float) -> DataFrame:
    """The reference's strides (by, wb_id, start, end, ...) with cadence_spm, computed from its contacts."""
    keys = [*by, "wb_id"]
    per_second = stages.cadence(_from_start(contacts.select(*keys, "ic"), bouts, by, "ic"), bouts.select(*keys, "start", "end"), keys, fs)
    found = values_per_stride(per_second, _from_start(strides, bouts, by, "start", "end"), by, "cadence_spm", fs)
    return _from_start(found, bouts, by, "start", "end", back=True)


def emulated_stride_length(samples: DataFrame, bouts: DataFrame, contacts: DataFrame, strides: DataFrame, by: list[str], fs: float, height: str = "sensor_height_m", factor: float = 1.0) -> DataFrame:
    """The reference's strides with stride_length_m from its bouts and contacts; samples carry the sensor's height."""
    keys = [*by, "wb_id"]
    given = _from_start(contacts.select(*keys, "ic"), bouts, by, "ic")
    per_second = emulate(samples, bouts, by, lambda rows, _, k: stages.stride_length(rows, given, k, fs, height, factor))
    found = values_per_stride(per_second, _from_start(strides, bouts, by, "start", "end"), by, "stride_length_m", fs)
    return _from_start(found, bouts, by, "start", "end", back=True)


def emulated_orientations(samples: DataFrame, bouts: DataFrame, by: list[str], fs: float, mode: str = "full") -> DataFrame:
    """(by, wb_id, label, prediction): every bout with the sensor worn in each way, and what re-orientation takes it for."""

    def stage(rows: DataFrame, _: DataFrame, keys: list[str]) -> DataFrame:
        turned = stages.reorient(misoriented(rows), [*keys, "orientation"], fs, mode=mode)
        return turned.select(*keys, F.col("orientation").alias("label"), F.col("detected_orientation").alias("prediction")).distinct()

    return emulate(samples, bouts, by, stage)


def values_per_stride(per_second: DataFrame, strides: DataFrame, by: list[str], value: str, sampling_rate_hz: float) -> DataFrame:
    """strides (by, wb_id, id, start, end from the start of the bout) with the mean of a second's values over each."""
    return R.seconds_to_regions(strides, per_second, [*by, "wb_id"], [value], sampling_rate_hz)


def _means(rows: DataFrame, by: list[str], value: str, prefix: str) -> DataFrame:
    return rows.groupBy(*by).agg(*[F.avg(f"{value}__{p}").alias(f"{prefix}__{p}") for p in PARTS])


def stride_and_bout_scores(strides: DataFrame, bouts: DataFrame, by: list[str], value: str) -> DataFrame:
    """Means of both sides and of their errors, over strides (stride__...) and over bouts (wb__...).

    strides: by, wb_id, <value>__detected, <value>__reference.  bouts: by,
    wb_id, <value>__reference, which is the reference's own mean and isn't
    computed anew; the detected one is the mean of the bout's strides.
    """
    own = strides.groupBy(*by, "wb_id").agg(F.avg(f"{value}__detected").alias(f"{value}__detected"))
    joined = own.join(bouts.select(*by, "wb_id", f"{value}__reference"), [*by, "wb_id"], "left")
    return _means(S.with_errors(strides, value), by, value, "stride").join(_means(S.with_errors(joined, value), by, value, "wb"), by)


def cadence_scores(strides: DataFrame, bouts: DataFrame, by: list[str]) -> DataFrame:
    """Scores of cadence.  strides: by, wb_id, cadence_spm (detected), duration_s (of the reference, NULL ones are left out); bouts: by, wb_id, avg_cadence_spm."""
    rows = strides.where("duration_s is not null").withColumn("cadence_spm__detected", F.col("cadence_spm")).withColumn("cadence_spm__reference", F.try_divide(F.lit(120.0), F.col("duration_s")))
    return stride_and_bout_scores(rows, bouts.withColumnRenamed("avg_cadence_spm", "cadence_spm__reference"), by, "cadence_spm")


def stride_length_scores(strides: DataFrame, bouts: DataFrame, by: list[str]) -> DataFrame:
    """Scores of stride length.  strides: by, wb_id, stride_length_m (detected), length_m (of the reference, NULL ones are left out); bouts: by, wb_id, avg_stride_length_m."""
    rows = strides.where("length_m is not null").withColumn("stride_length_m__detected", F.col("stride_length_m")).withColumn("stride_length_m__reference", F.col("length_m"))
    return stride_and_bout_scores(rows, bouts.withColumnRenamed("avg_stride_length_m", "stride_length_m__reference"), by, "stride_length_m")


#: Parameters of a whole pipeline's score (fixed values).
PARAMETERS = ("walking_speed_mps", "stride_length_m", "cadence_spm")


def pipeline_scores(detected: DataFrame, reference: DataFrame, by: list[str], ident: str = "wb_id", parameters: tuple[str, ...] = PARAMETERS, threshold: float = 0.8) -> DataFrame:
    """Scores of bouts with parameters: combined__ from the medians of a recording, matched__ as means over matched bouts.

    detected and reference: by, ident, start, end and the parameters.  A
    recording without detected bouts has NULL errors and no matched bout.
    """
    middle = lambda df, side: df.groupBy(*by).agg(*[F.median(p).alias(f"{p}__{side}") for p in parameters])
    both = S.with_errors(middle(reference, "reference").join(middle(detected, "detected"), by, "full"), *parameters)
    combined = both.select(*by, *[F.col(f"{p}__{k}").alias(f"combined__{p}__{k}") for p in parameters for k in PARTS])
    columns = [*by, ident, "start", "end", *parameters]
    d, r = detected.select(*columns), reference.select(*columns)
    matched = S.with_errors(I.side_by_side(I.match_overlap(d, r, by, threshold, ident), d, r, by, ident), *parameters)
    means = matched.groupBy(*by).agg(F.count("*").alias("matched__n_matched_wbs"), *[F.avg(f"{p}__{k}").alias(f"matched__{p}__{k}") for p in parameters for k in PARTS])
    return combined.join(means, by, "left").fillna(0, ["matched__n_matched_wbs"])


def label_accuracy(predictions: DataFrame, by: list[str], truth: str = "label", predicted: str = "prediction") -> DataFrame:
    """Share of right labels; a missing prediction is wrong."""
    return predictions.groupBy(*by).agg(F.avg(F.col(truth).eqNullSafe(F.col(predicted)).cast("double")).alias("accuracy"))


def orientation_scores(predictions: DataFrame, by: list[str], labels: list[str]) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Accuracy by recording and over all bouts, and the confusion matrix, of predictions (by, label, prediction)."""
    return label_accuracy(predictions, by), label_accuracy(predictions, []).withColumnRenamed("accuracy", "combined__accuracy"), S.confusion(predictions, "label", "prediction", labels)


def overall(scores: DataFrame, by: list[str]) -> DataFrame:
    """Means of all scores over the recordings."""
    return scores.agg(*[F.avg(n).alias(n) for n, t in scores.dtypes if n not in by and t in ("double", "bigint", "int")])

