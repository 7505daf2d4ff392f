"""Evaluation harness: derived columns, aggregates in long form, folds, turned sensors, left/right machines."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.ml import Pipeline
from pyspark.ml.classification import LinearSVC
from pyspark.ml.evaluation import MulticlassClassificationEvaluator
from pyspark.ml.feature import MinMaxScaler, VectorAssembler
from pyspark.ml.tuning import CrossValidator, ParamGridBuilder
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Eight ways to wear a sensor: new (vertical, sideways, forward) axes as signed places, 1 to 3, of the old ones (fixed values).
ORIENTATIONS = {
    "identity": (1, 2, 3), "pa_normal__rot_pa_pos90": (-2, 1, 3), "pa_normal__rot_pa_180": (-1, -2, 3), "pa_normal__rot_pa_neg90": (2, -1, 3),
    "pa_flipped__rot_pa_0": (1, -2, -3), "pa_flipped__rot_pa_pos90": (2, 1, -3), "pa_flipped__rot_pa_180": (-1, 2, -3), "pa_flipped__rot_pa_neg90": (-2, -1, -3),
}


def add_columns(df: DataFrame, new: dict[str, tuple[list[str], Callable[..., Column]]], missing: str = "raise") -> DataFrame:
    """Add columns made by functions of named columns, in one projection; missing: raise, or ignore such columns."""
    found = {}
    for name, (inputs, make) in new.items():
        lacking = [c for c in inputs if c not in df.columns]
        if lacking and missing == "raise":
            raise ValueError(f"{name} needs missing columns: {lacking}")
        if not lacking:
            found[name] = make(*map(F.col, inputs))
    return df.withColumns(found)


def aggregate_long(df: DataFrame, by: list[str], aggregates: dict[str, Column]) -> DataFrame:
    """Aggregates as rows (by..., aggregation, value), all from one pass."""
    wide = df.groupBy(*by).agg(*[c.cast("double").alias(n) for n, c in aggregates.items()])
    return wide.unpivot(by, list(aggregates), "aggregation", "value") if by else wide.unpivot([], list(aggregates), "aggregation", "value")


def with_folds(df: DataFrame, keys: list[str], k: int, seed: int = 0) -> DataFrame:
    """A fold number from 0 to k - 1 for each row; rows of equal keys share it."""
    return df.withColumn("fold", F.pmod(F.xxhash64(*keys, F.lit(seed)), F.lit(k)).cast("int"))


def cross_validate(df: DataFrame, k: int, fit: Callable[[DataFrame], object], score: Callable[[object, DataFrame], DataFrame]) -> DataFrame:
    """Scores of each fold by what was fitted on the others; df has the column fold."""
    parts = [score(fit(df.where(F.col("fold") != i)), df.where(F.col("fold") == i)).withColumn("fold", F.lit(i)) for i in range(k)]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def misoriented(samples: DataFrame, axes: tuple[str, str, str] = ("is", "ml", "pa"), sensors: tuple[str, ...] = ("acc", "gyr"), orientations: dict[str, tuple[int, int, int]] | None = None) -> DataFrame:
    """Each sample once for every way to wear the sensor, named by column orientation."""
    chosen = ORIENTATIONS if orientations is None else orientations
    rows = samples.withColumn("orientation", F.explode(F.array(*map(F.lit, chosen))))
    new = {}
    for s in sensors:
        for k, a in enumerate(axes):
            old = lambda place, s=s: F.col(f"{s}_{axes[abs(place) - 1]}") * (1 if place > 0 else -1)
            new[f"{s}_{a}"] = F.coalesce(*[F.when(F.col("orientation") == name, old(turn[k])) for name, turn in chosen.items()])
    return rows.withColumns(new)


def one_orientation(samples: DataFrame, orientation: str, axes: tuple[str, str, str] = ("is", "ml", "pa"), sensors: tuple[str, ...] = ("acc", "gyr")) -> DataFrame:
    """Samples of a recording as if the sensor had been worn one way."""
    return misoriented(samples, axes, sensors, {orientation: ORIENTATIONS[orientation]})


def pendulum_features(samples: DataFrame, contacts: DataFrame, by: list[str], fs: float) -> DataFrame:
    """contacts with the value, slope and curvature of two smoothed angular rates (v_is, v_pa) at each contact."""
    w = Window.partitionBy(*by).orderBy("sample")
    rows = samples
    for name in ("v_is", "v_pa"):
        for source, out in ((name, f"{name}_slope"), (f"{name}_slope", f"{name}_curve")):
            back, ahead, x = F.lag(source).over(w), F.lead(source).over(w), F.col(source)
            rows = rows.withColumn(out, F.coalesce((ahead - back) / 2, ahead - x, x - back) * fs)
    names = [f"{n}{s}" for n in ("v_is", "v_pa") for s in ("", "_slope", "_curve")]
    return contacts.join(rows.select(*by, F.col("sample").alias("ic"), *names), [*by, "ic"])


FEATURES = [f"{n}{s}" for n in ("v_is", "v_pa") for s in ("", "_slope", "_curve")]


def train_laterality(features: DataFrame, label: str = "lr_label"):
    """Scaled features and a linear support vector machine for left (0) and right (1)."""
    rows = features.withColumn("label", (F.col(label) == "right").cast("double"))
    steps = [VectorAssembler(inputCols=FEATURES, outputCol="raw"), MinMaxScaler(inputCol="raw", outputCol="features"), LinearSVC(maxIter=50, regParam=1e-3)]
    return Pipeline(stages=steps).fit(rows)


def tune_laterality(features: DataFrame, label: str = "lr_label", shrinks: tuple[float, ...] = (1e-4, 1e-3, 1e-2, 1e-1), folds: int = 3):
    """The machine of train_laterality with the strength of regularisation that does best in cross-validation, fitted on all rows.

    With a column fold (see with_folds) its folds are kept.
    """
    rows = features.withColumn("label", (F.col(label) == "right").cast("double"))
    machine = LinearSVC(maxIter=50)
    steps = Pipeline(stages=[VectorAssembler(inputCols=FEATURES, outputCol="raw"), MinMaxScaler(inputCol="raw", outputCol="features"), machine])
    grid = ParamGridBuilder().addGrid(machine.regParam, list(shrinks)).build()
    kept = {"foldCol": "fold", "numFolds": folds} if "fold" in features.columns else {"numFolds": folds, "seed": 0}
    return CrossValidator(estimator=steps, estimatorParamMaps=grid, evaluator=MulticlassClassificationEvaluator(metricName="accuracy"), **kept).fit(rows).bestModel


def explode_lists(results: DataFrame, lists: list[str]) -> DataFrame:
    """One row for each place of the array columns ``lists``, which are as long as each other; other columns are repeated."""
    others = [c for c in results.columns if c not in lists]
    rows = results.select(*others, F.posexplode(F.arrays_zip(*lists)).alias("place", "v"))
    return rows.select(*others, "place", *[F.col(f"v.{c}").alias(c) for c in lists])


def predict_laterality(model, features: DataFrame) -> DataFrame:
    rows = model.transform(features.drop("lr_label"))
    return rows.withColumn("lr_label", F.when(F.col("prediction") > 0.5, "right").otherwise("left")).drop("raw", "features", "rawPrediction", "prediction", *FEATURES)


def best_in_group(df: DataFrame, by: list[str], value: str, best: str = "max") -> DataFrame:
    """The row with the best value of each group; ties by the smallest row."""
    others = [c for c in df.columns if c not in by]
    sign = F.col(value) if best == "max" else -F.col(value)
    order = Window.partitionBy(*by).orderBy(sign.desc_nulls_last(), *others)
    return df.withColumn("rank__", F.row_number().over(order)).where("rank__ = 1").drop("rank__")


def with_range(value: Column, low: Column, high: Column, digits: int = 2) -> Column:
    """"m [low, high]" as text."""
    return F.format_string(f"%.{digits}f [%.{digits}f, %.{digits}f]", value, low, high)


def agreement_points(reference: Column, detected: Column) -> dict[str, Column]:
    """Coordinates of a difference plot: the mean of both raters and their difference."""
    return {"x": (reference + detected) / 2, "difference": detected - reference}


def meets_threshold(value: Column, threshold: float, higher_is_better: bool = True) -> Column:
    return value >= threshold if higher_is_better else value <= threshold
