"""Scores of matches, error statistics and agreement."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ambulo.functions.columns import errors
from ambulo.functions.distributions import f_quantile, t_two_sided


def _ratio(a: Column, b: Column, zero: float = 0.0) -> Column:
    return F.when(b == 0, F.lit(zero)).otherwise(a / b)


def _scores(tp: Column, fp: Column, fn: Column, tn: Column | None, zero: float) -> dict[str, Column]:
    precision, recall = _ratio(tp, tp + fp, zero), _ratio(tp, tp + fn, zero)
    # precision and recall inside f1 always use 0 for an empty denominator
    p0, r0 = _ratio(tp, tp + fp), _ratio(tp, tp + fn)
    found = {"precision": precision, "recall": recall, "f1_score": _ratio(2 * p0 * r0, p0 + r0, zero)}
    if tn is not None:
        found |= {"specificity": _ratio(tn, tn + fp, zero), "accuracy": _ratio(tp + tn, tp + fp + fn + tn, zero), "npv": _ratio(tn, tn + fn, zero)}
    return found


def interval_scores(matches: DataFrame, by: list[str], zero: float = 0.0) -> DataFrame:
    """Samples of each kind (both ends counted) and the six scores of categorized intervals."""
    size = F.col("end") - F.col("start") + 1
    sums = matches.groupBy(*by).agg(*[F.coalesce(F.sum(F.when(F.col("match_type") == k, size)), F.lit(0)).cast("double").alias(f"{k}_samples") for k in ("tp", "fp", "fn", "tn")])
    tp, fp, fn, tn = (F.col(f"{k}_samples") for k in ("tp", "fp", "fn", "tn"))
    return sums.withColumns(_scores(tp, fp, fn, tn, zero))


def event_scores(matches: DataFrame, by: list[str], zero: float = 0.0) -> DataFrame:
    """Counts of tp, fp and fn rows with precision, recall and f1."""
    sums = matches.groupBy(*by).agg(*[F.count(F.when(F.col("match_type") == k, 1)).cast("double").alias(k) for k in ("tp", "fp", "fn")])
    return sums.withColumns(_scores(F.col("tp"), F.col("fp"), F.col("fn"), None, zero))


def unmatched_totals(detected: DataFrame, reference: DataFrame, by: list[str], sampling_rate_hz: float) -> DataFrame:
    """Durations and counts of both interval lists of each group with their errors; log errors are log(1 + x)."""
    def totals(df: DataFrame, tag: str) -> DataFrame:
        return df.groupBy(*by).agg((F.sum(F.col("end") - F.col("start")) / sampling_rate_hz).alias(f"{tag}_duration_s"), F.count("*").alias(f"{tag}_n"))

    both = totals(detected, "detected").join(totals(reference, "reference"), by, "full")
    both = both.fillna(0, [c for c in both.columns if c not in by])
    d, r = F.col("detected_duration_s"), F.col("reference_duration_s")
    dn, rn = F.col("detected_n"), F.col("reference_n")
    e, en = errors(r, d), errors(rn, dn)
    new = {f"duration_{k}": v for k, v in e.items()} | {"duration_abs_rel_error_log": F.log1p(e["abs_rel_error"])}
    return both.withColumns(new | {f"n_{k}": v for k, v in en.items()} | {"n_abs_rel_error_log": F.when(r != 0, F.log1p(en["abs_rel_error"]))})


def with_errors(matched: DataFrame, *metrics: str) -> DataFrame:
    """Adds <metric>__error, __rel_error, __abs_error and __abs_rel_error to matched rows."""
    return matched.withColumns({f"{m}__{k}": c for m in metrics for k, c in errors(F.col(f"{m}__reference"), F.col(f"{m}__detected")).items()})


def quantile_pair(x: Column, lower: float = 0.05, upper: float = 0.95) -> tuple[Column, Column]:
    return F.percentile(x, lower), F.percentile(x, upper)


def limits_of_agreement(x: Column, z: float = 1.96) -> tuple[Column, Column]:
    return F.avg(x) - z * F.stddev_samp(x), F.avg(x) + z * F.stddev_samp(x)


def confidence_interval(x: Column, z: float = 1.96) -> tuple[Column, Column]:
    """Of the mean; missing values count for the number of rows."""
    half = z * F.stddev_samp(x) / F.sqrt(F.count(F.lit(1)))
    return F.avg(x) - half, F.avg(x) + half


def error_statistics(df: DataFrame, by: list[str], column: str) -> DataFrame:
    """Mean, 5 % and 95 % quantiles, limits of agreement, confidence interval and number of rows of a column."""
    x = F.col(column)
    pairs = {"quantile": quantile_pair(x), "loa": limits_of_agreement(x), "ci": confidence_interval(x)}
    return df.groupBy(*by).agg(F.avg(x).alias("mean"), *[c.alias(f"{k}_{end}") for k, p in pairs.items() for end, c in zip(("lower", "upper"), p, strict=True)], F.count(F.lit(1)).alias("n_datapoints"))


def icc(df: DataFrame, by: list[str], reference: str, detected: str, kind: str = "icc2", interval: bool = False) -> DataFrame:
    """Intraclass correlation of two raters from sums: icc1 (one way), icc2 (random raters) or icc3 (fixed raters).

    Rows with a missing value are left out; under two rows it is NULL.  With
    interval, icc_ci_lower and icc_ci_upper are its 95 % confidence interval,
    computed for the one row of each group; NULL where it isn't defined, as for
    perfect agreement.
    """
    rows = df.where(F.col(reference).isNotNull() & F.col(detected).isNotNull())
    d, r = F.col(detected), F.col(reference)
    n = F.col("n")
    sums = rows.groupBy(*by).agg(F.count("*").alias("n"), F.sum(d).alias("sd"), F.sum(r).alias("sr"), F.sum(d * d + r * r).alias("sq"), F.sum((d + r) * (d + r)).alias("sp"))
    total = F.col("sd") + F.col("sr")
    mean = total * total / (2 * n)
    rows_ss, raters_ss = F.col("sp") / 2 - mean, (F.col("sd") * F.col("sd") + F.col("sr") * F.col("sr")) / n - mean
    rest_ss = F.col("sq") - mean - rows_ss - raters_ss
    msr, msc, mse = F.try_divide(rows_ss, n - 1), raters_ss, F.try_divide(rest_ss, n - 1)
    msw = F.try_divide(raters_ss + rest_ss, n)
    value = {"icc1": F.try_divide(msr - msw, msr + msw), "icc2": F.try_divide(msr - mse, msr + mse + 2 * (msc - mse) / n), "icc3": F.try_divide(msr - mse, msr + mse)}[kind]
    found = sums.select(*by, n, value.alias("icc"), msr.alias("msr"), msc.alias("msc"), mse.alias("mse"), msw.alias("msw"))
    if not interval:
        return found.select(*by, "n", "icc")
    bounds = F.udf(lambda *x: _icc_bounds(kind, *x), "struct<low: double, high: double>")("n", "icc", "msr", "msc", "mse", "msw")
    return found.withColumn("b", bounds).select(*by, "n", "icc", F.col("b.low").alias("icc_ci_lower"), F.col("b.high").alias("icc_ci_upper"))


def _icc_bounds(kind: str, n: int, value: float | None, msr: float | None, msc: float | None, mse: float | None, msw: float | None) -> tuple[float, float] | None:
    """95 % confidence interval of an intraclass correlation of two raters (McGraw and Wong); None where it isn't defined."""
    if value is None or mse is None or n < 2:
        return None
    rows = n - 1
    if kind in ("icc1", "icc3"):
        other, rest = (msw, n) if kind == "icc1" else (mse, rows)
        if not other:
            return None
        ratio = msr / other
        low, high = ratio / f_quantile(0.975, rows, rest), ratio * f_quantile(0.975, rest, rows)
        return (low - 1) / (low + 1), (high - 1) / (high + 1)
    if not mse:
        return None
    tilt, flat = 2 * value * msc / mse, n * (1 + value) - 2 * value
    top, bottom = rows * (tilt + flat) ** 2, rows * tilt**2 + flat**2
    if not bottom or not top:
        return None
    dof = top / bottom
    up, down = f_quantile(0.975, rows, dof), f_quantile(0.975, dof, rows)
    if up is None or down is None:
        return None
    common = 2 * msc + (n - 2) * mse
    return n * (msr - up * mse) / (up * common + n * msr), n * (down * msr - mse) / (common + n * down * msr)


def timing_errors(contacts: DataFrame, matches: DataFrame, by: list[str], bout: str, sampling_rate_hz: float, position: str = "ic") -> DataFrame:
    """Mean error of matched contacts in seconds and relative to their bout's mean reference step time.

    matches: by, bout, ic__detected, ic__reference; contacts: by, bout, position.
    """
    step = F.col(position) - F.lag(position).over(Window.partitionBy(*by, bout).orderBy(position))
    steps = contacts.withColumn("step__", step).groupBy(*by, bout).agg((F.avg("step__") / sampling_rate_hz).alias("step_s"))
    gap = F.abs(F.col(f"{position}__detected") - F.col(f"{position}__reference")) / sampling_rate_hz
    return matches.join(steps, [*by, bout], "left").groupBy(*by).agg(F.coalesce(F.avg(gap), F.lit(0.0)).alias("tp_absolute_timing_error_s"), F.coalesce(F.avg(F.try_divide(gap, F.col("step_s"))), F.lit(0.0)).alias("tp_relative_timing_error"))


def laterality_scores(labels: DataFrame, by: list[str], position: str, reference: str, detected: str, ident: str | None = None) -> DataFrame:
    """Share of right left/right labels, and of right changes from one contact to the next.

    Contacts at one position come in the order of ident, without it in that of
    their labels.
    """
    w = Window.partitionBy(*by).orderBy(position, *([ident] if ident else []), reference, detected)
    change = lambda c: F.col(c) != F.lag(c).over(w)
    rows = labels.withColumn("same__", (change(reference) == change(detected)).cast("double"))
    return rows.groupBy(*by).agg(F.avg((F.col(reference) == F.col(detected)).cast("double")).alias("accuracy"), F.avg("same__").alias("accuracy_pairwise"))


def macro_and_micro(matches: DataFrame, recording: str) -> DataFrame:
    """Scores of interval matches pooled over all rows (combined) and as means over recordings (single)."""
    names = ["precision", "recall", "f1_score", "specificity", "accuracy", "npv"]
    single = interval_scores(matches, [recording]).agg(*[F.avg(n).alias(n) for n in names]).withColumn("weighting", F.lit("single"))
    combined = interval_scores(matches, []).select(*names).withColumn("weighting", F.lit("combined"))
    return single.unionByName(combined)


def confusion(df: DataFrame, truth: str, predicted: str, labels: list[str]) -> DataFrame:
    """Counts of each pair of labels, one column a predicted label."""
    return df.groupBy(truth).pivot(predicted, labels).count().fillna(0, labels)


def pairwise_welch(df: DataFrame, between: str, value: str, reference: str) -> DataFrame:
    """Welch's t and its degrees of freedom of each group against the reference group."""
    stats = df.groupBy(between).agg(F.avg(value).alias("m"), F.var_samp(value).alias("v"), F.count(value).alias("n"))
    ref = stats.where(F.col(between) == reference).select(F.col("m").alias("m0"), F.col("v").alias("v0"), F.col("n").alias("n0"))
    a, b = F.col("v") / F.col("n"), F.col("v0") / F.col("n0")
    # one row of the reference group joins every group
    both = stats.where(F.col(between) != reference).join(F.broadcast(ref))
    t = F.try_divide(F.col("m0") - F.col("m"), F.sqrt(a + b))
    dof = F.try_divide((a + b) * (a + b), a * a / (F.col("n") - 1) + b * b / (F.col("n0") - 1))
    return both.select(between, t.alias("t"), dof.alias("dof"))


def pairwise_tests(df: DataFrame, between: str, value: str, reference: str) -> DataFrame:
    """t, degrees of freedom and two-sided p of each group against the reference group.

    Student's test for groups of one size, Welch's otherwise.  Without the
    reference group there are no rows.  p is computed for the one row of each
    group.
    """
    stats = df.where(F.col(value).isNotNull()).groupBy(between).agg(F.avg(value).alias("m"), F.var_samp(value).alias("v"), F.count(value).alias("n"))
    ref = stats.where(F.col(between) == reference).select(F.col("m").alias("m0"), F.col("v").alias("v0"), F.col("n").alias("n0"))
    # one row of the reference group joins every group
    both = stats.where(F.col(between) != reference).join(F.broadcast(ref))
    a, b = F.col("v") / F.col("n"), F.col("v0") / F.col("n0")
    welch = F.try_divide((a + b) * (a + b), a * a / (F.col("n") - 1) + b * b / (F.col("n0") - 1))
    # with equal sizes both tests have the same t
    dof = F.when(F.col("n") == F.col("n0"), (F.col("n") + F.col("n0") - 2).cast("double")).otherwise(welch)
    p = F.udf(t_two_sided, "double")
    found = both.select(between, F.try_divide(F.col("m0") - F.col("m"), F.sqrt(a + b)).alias("t"), dof.alias("dof"))
    return found.withColumn("p", p("t", "dof"))


#: Measures that the default statistics cover, where a table has them (fixed values).
DEFAULT_MEASURES = ("cadence_spm", "duration_s", "n_steps", "n_strides", "n_turns", "stride_duration_s", "stride_length_m", "walking_speed_mps")


def default_error_statistics(matched: DataFrame, by: list[str], measures: tuple[str, ...] = DEFAULT_MEASURES) -> DataFrame:
    """The default statistics of matched rows, long: (by, measure, origin, statistic, value).

    matched: by, <measure>__detected and <measure>__reference of some of the
    measures.  Means and 5 % and 95 % quantiles of both sides and of the
    absolute errors, means and limits of agreement of the errors, the
    intraclass correlation with its interval, and the number of rows.
    """
    names = [m for m in measures if f"{m}__detected" in matched.columns and f"{m}__reference" in matched.columns]
    rows = with_errors(matched, *names)
    aggs: dict[tuple[str, str, str], Column] = {("all", "all", "n_datapoints"): F.count(F.lit(1)).cast("double")}
    for m in names:
        for origin in ("detected", "reference", "abs_error", "abs_rel_error", "error", "rel_error"):
            x = F.col(f"{m}__{origin}")
            ends, tag = (limits_of_agreement(x), "loa") if origin in ("error", "rel_error") else (quantile_pair(x), "quantile")
            aggs |= {(m, origin, "mean"): F.avg(x), (m, origin, f"{tag}_lower"): ends[0], (m, origin, f"{tag}_upper"): ends[1]}
    wide = rows.groupBy(*by).agg(*[c.cast("double").alias("|".join(k)) for k, c in aggs.items()])
    entries = F.array(*[F.struct(*[F.lit(x).alias(n) for x, n in zip(k, ("measure", "origin", "statistic"), strict=True)], F.col("|".join(k)).alias("value")) for k in aggs])
    long = wide.select(*by, F.explode(entries).alias("e")).select(*by, "e.*")
    for m in names:
        agreement = icc(rows, by, f"{m}__reference", f"{m}__detected", interval=True)
        kinds = F.array(*[F.struct(F.lit(m).alias("measure"), F.lit("all").alias("origin"), F.lit(k).alias("statistic"), F.col(k).alias("value")) for k in ("icc", "icc_ci_lower", "icc_ci_upper")])
        long = long.unionByName(agreement.select(*by, F.explode(kinds).alias("e")).select(*by, "e.*"))
    return long


def multilevel(df: DataFrame, groupings: list[tuple[list[str], list[Column]]]) -> DataFrame:
    """Aggregates of several groupings side by side, joined on the keys of the finest (the first)."""
    (keys, aggs), *rest = groupings
    out = df.groupBy(*keys).agg(*aggs)
    for other, more in rest:
        if not set(other) <= set(keys):
            raise ValueError("the keys of the first grouping must contain those of the others")
        out = out.join(df.groupBy(*other).agg(*more), other)
    return out


def apply_with(primary: DataFrame, secondary: DataFrame, by: list[str], function, schema: str) -> DataFrame:
    """function(rows, other rows) for each group of primary; other rows are empty where secondary has none."""
    def run(left, right):
        import pandas as pd

        names = [f.split()[0] for f in schema.split(",")]
        return function(left, right)[names] if len(left) else pd.DataFrame({n: [] for n in names})

    return primary.groupBy(*by).cogroup(secondary.groupBy(*by)).applyInPandas(run, schema)
