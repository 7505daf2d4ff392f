"""Walking-bout outcomes: plausibility mask and aggregates per group."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ambulo.functions.columns import longest_stride, require

MEASURES = ["duration_s", "stride_duration_s", "n_raw_initial_contacts", "n_turns", "walking_speed_mps", "stride_length_m", "cadence_spm"]
CHECKED = ["cadence_spm", "walking_speed_mps", "stride_length_m", "stride_duration_s"]

#: Plausible ranges by outcome and cohort; an empty field is missing.
THRESHOLDS = """\
dmo,cohort,free_living_min,free_living_max,laboratory_min,laboratory_max,literature_min,literature_max,global_min,global_max
cadence_spm,CHF,40.5947698,167.94292992,53.61770278,122.65715836,36.2,150.9,,
cadence_spm,COPD,38.88048357,151.55871844,59.45100369,164.96976428,71.2,154.8,,
cadence_spm,HA,35.751898,156.94695478,60.17664439,146.30939262,90.4,169.2,,
cadence_spm,MS,38.44321135,155.394496,44.01614905,140.9395966,45.6,164.4,,
cadence_spm,PD,40.9579695,142.12194686,47.68157571,147.05484915,33.8,77.6,,
cadence_spm,PFF,42.19171892,157.61366515,46.83940415,133.12927576,42.9,172.9,,
cadence_spm,ALL,,,,,,,40,172.9
walking_speed_mps,CHF,0.11247848,1.7571035,0.27340101,1.52891291,0.63,1.83,,
walking_speed_mps,COPD,0.09073083,1.64177345,0.15968929,1.91814618,0.6,1.84,,
walking_speed_mps,HA,0.09741348,1.96572761,0.20788692,1.58377888,0.78,2.22,,
walking_speed_mps,MS,0.08591825,1.92026174,0.2032134,1.87769052,0.52,1.74,,
walking_speed_mps,PD,0.08151492,1.73534762,0.13965396,1.93969682,0.56,2.1,,
walking_speed_mps,PFF,0.10454679,1.55318618,0.14372351,1.62738331,0.11,1.59,,
walking_speed_mps,ALL,,,,,,,0.08151492,2.22
stride_length_m,CHF,0.18530811,2.16664608,0.44404121,1.56858321,0.53,1.86,,
stride_length_m,COPD,0.17640257,1.71164461,0.22353705,1.62373302,1.03,2.19,,
stride_length_m,HA,0.15512643,2.02469363,0.29028303,1.6696087,0.87,1.98,,
stride_length_m,MS,0.19109908,1.94053714,0.36300351,1.72132196,0.72,2.1,,
stride_length_m,PD,0.1505232,1.98292594,0.25306851,1.77253583,0.56,1.62,,
stride_length_m,PFF,0.20678713,1.69725122,0.23345999,1.5871435,0.71,1.93,,
stride_length_m,ALL,,,,,,,0.1505232,2.19
stride_duration_s,CHF,0.702,3.03085714,0.98,2.27454545,0.46,1.32,,
stride_duration_s,COPD,0.77,3,0.7275,2.16,0.68,1.41,,
stride_duration_s,HA,0.73543463,3.2544,0.82909091,2.142,0.69,2.304,,
stride_duration_s,MS,0.77559664,3.05775,0.855,2.73166667,0.69,2.304,,
stride_duration_s,PD,0.83625316,2.928,0.81857143,2.522,0.76,1.69,,
stride_duration_s,PFF,0.744,2.769,0.90272727,2.58454545,,,,
stride_duration_s,ALL,,,,,,,0.46,3
step_duration_s,CHF,0.376,1.5045,0.498,1.14416667,0.14,0.98,,
step_duration_s,COPD,0.3904,1.788,0.366,1.18142857,0.16,0.92,,
step_duration_s,HA,0.36797183,1.7304,0.41,1.1375,0.25,1.04,,
step_duration_s,MS,0.38808368,1.905,0.43285714,1.36,0.25,1.09,,
step_duration_s,PD,0.417216,1.6056,0.415,1.45,0.19,1.1,,
step_duration_s,PFF,0.37142857,2.124,0.43,1.32,0.35,1.1,,
step_duration_s,ALL,,,,,,,0.14,2.124
"""


def threshold_rows(text: str = THRESHOLDS) -> list[dict]:
    """Rows of a threshold table; a missing value is filled from the next row that has it, then ALL rows go."""
    head, *lines = [line.split(",") for line in text.strip().splitlines()]
    rows = [dict(zip(head, line, strict=True)) for line in lines]
    follow: dict[str, float | None] = dict.fromkeys(head[2:])
    for row in reversed(rows):
        for name in head[2:]:
            follow[name] = float(row[name]) if row[name] else follow[name]
            row[name] = follow[name]
    return [r for r in rows if r["cohort"] != "ALL"]


def threshold_table(spark: SparkSession, text: str = THRESHOLDS) -> DataFrame:
    rows = threshold_rows(text)
    names = list(rows[0])
    return spark.createDataFrame([tuple(r[n] for n in names) for r in rows], ", ".join(f"{n} {'string' if i < 2 else 'double'}" for i, n in enumerate(names)))


def envelope(thresholds: DataFrame, condition: str, against: tuple[str, ...] = ("literature", "global")) -> DataFrame:
    """(cohort, <dmo>_min, <dmo>_max ...): the widest range of the named conditions, one row a cohort."""
    names = [*against, condition]
    require(thresholds, "dmo", "cohort", *[f"{n}_{e}" for n in names for e in ("min", "max")])
    low = F.least(*[F.col(f"{n}_min") for n in names])
    high = F.greatest(*[F.col(f"{n}_max") for n in names])
    aggs = [f.alias(f"{d}_{e}") for d in CHECKED for e, f in (("min", F.min(F.when(F.col("dmo") == d, low))), ("max", F.max(F.when(F.col("dmo") == d, high))))]
    return thresholds.groupBy("cohort").agg(*aggs)


def apply_thresholds(bouts: DataFrame, thresholds: DataFrame, condition: str, *, keys: list[str], cohort: str = "cohort", height: str | None = None) -> DataFrame:
    """Mask of bouts: for each checked outcome whether it lies in its cohort's range, ends included.

    NULL stays NULL: not checked.  A body height can only widen the longest
    stride.  The thresholds have one row a cohort and outcome, a fixed table.
    """
    require(bouts, *keys, cohort, *CHECKED)
    ranges = envelope(thresholds, condition).withColumnRenamed("cohort", "cohort__")
    joined = bouts.join(F.broadcast(ranges), F.col(cohort) == F.col("cohort__"), "left")
    most = {d: F.col(f"{d}_max") for d in CHECKED}
    if height:
        most["stride_length_m"] = F.greatest(most["stride_length_m"], longest_stride(F.col(height)))
    return joined.select(*keys, *[F.col(d).between(F.col(f"{d}_min"), most[d]).alias(d) for d in CHECKED])


def mask_bouts(bouts: DataFrame, mask: DataFrame, keys: list[str]) -> DataFrame:
    """NULL where the mask says no; a NULL mask passes.

    A bad duration voids the whole bout, a bad stride length or cadence the
    walking speed.  mask has the same keys and any of the measures; a bout
    without a mask row is an error at run time.
    """
    names = [m for m in MEASURES if m in bouts.columns]
    checks = [m for m in names if m in mask.columns]
    flags = mask.select(*keys, *[F.col(m).alias(f"{m}__ok") for m in checks], F.lit(True).alias("known__"))
    joined = bouts.join(flags, keys, "left")
    known = F.when(F.col("known__"), True).otherwise(F.raise_error(F.lit("a bout has no row in the mask")).cast("boolean"))
    ok = {m: F.coalesce(F.col(f"{m}__ok"), F.lit(True)) for m in checks}
    true = F.lit(True)
    whole = ok.get("duration_s", true)
    keep = {m: known & whole & ok.get(m, true) for m in names}
    if "walking_speed_mps" in keep:
        keep["walking_speed_mps"] = keep["walking_speed_mps"] & ok.get("stride_length_m", true) & ok.get("cadence_spm", true)
    return joined.select(*[F.when(keep[c], F.col(c)).alias(c) if c in keep else F.col(c) for c in bouts.columns])


@dataclass(frozen=True)
class Outcome:
    name: str
    long_name: str
    measure: str
    how: str
    over: float | None = None
    upto: float | None = None


def _outcomes() -> list[Outcome]:
    avg, p90, var = "avg", "p90", "var"
    strata = {
        ("all", "all", None, None): [("wb", "duration_s", "count"), ("walkdur", "duration_s", "minutes"), ("wbsteps", "n_raw_initial_contacts", "sum"), ("turns", "n_turns", "sum"), ("wbdur", "duration_s", "median"), ("wbdur", "duration_s", p90), ("wbdur", "duration_s", var), ("cadence", "cadence_spm", avg), ("strdur", "stride_duration_s", avg), ("cadence", "cadence_spm", var), ("strdur", "stride_duration_s", var)],
        ("1030", "10_30", 10, 30): [("wb", "duration_s", "count"), ("ws", "walking_speed_mps", avg), ("strlen", "stride_length_m", avg)],
        ("10", "10", 10, None): [("wb", "duration_s", "count"), ("ws", "walking_speed_mps", p90)],
        ("30", "30", 30, None): [("wb", "duration_s", "count"), ("ws", "walking_speed_mps", avg), ("strlen", "stride_length_m", avg), ("cadence", "cadence_spm", avg), ("strdur", "stride_duration_s", avg), ("ws", "walking_speed_mps", p90), ("cadence", "cadence_spm", p90), ("ws", "walking_speed_mps", var), ("strlen", "stride_length_m", var)],
        ("60", "60", 60, None): [("wb", "duration_s", "count")],
    }
    short = {"count": "sum", "minutes": "sum", "median": "avg"}
    out = []
    for (tag, label, over, upto), rows in strata.items():
        for prefix, measure, how in rows:
            suffix = short.get(how, how)
            long_name = f"wb_{label}__count" if how == "count" else "total_walking_duration_min" if how == "minutes" else f"wb_{label}__{measure}__{suffix}"
            out.append(Outcome(f"{prefix}_{tag}_{suffix}", long_name, measure, how, over, upto))
    return out


OUTCOMES = _outcomes()
#: Counts that are 0, not NULL, in a group without such bouts.  wb_1030_sum is none of them.
FILLED = {"wb_10_sum", "wb_30_sum", "wb_60_sum", "wb_all_sum", "turns_all_sum"}


def outcome_column(o: Outcome, accuracy: int | None = None) -> Column:
    """accuracy: of medians and percentiles, as percentile_approx takes it; None computes them exactly."""
    value = F.col(o.measure)
    share = (lambda q: F.percentile(value, q)) if accuracy is None else (lambda q: F.percentile_approx(value, q, accuracy))
    if o.over is not None:
        stratum = F.col("duration_s") > o.over
        value = F.when(stratum & (F.col("duration_s") <= o.upto) if o.upto is not None else stratum, value)
    if o.how == "count":
        counted = F.count(value)
        return counted if o.name in FILLED else F.when(counted > 0, counted)
    sums = {
        "sum": lambda: F.coalesce(F.sum(value), F.lit(0)),
        "minutes": lambda: F.coalesce(F.sum(value), F.lit(0.0)) / 60,
        "avg": lambda: F.avg(value),
        "median": lambda: share(0.5),
        "p90": lambda: share(0.9),
        "var": lambda: F.try_divide(F.stddev_samp(value), F.avg(value)),
    }
    return sums[o.how]()


@dataclass(frozen=True)
class Aggregator:
    """Outcomes of bouts for each group: one pass, one shuffle on the keys.

    Strata are conditional inputs of the same aggregation.  Outcomes whose
    measure is missing are left out, strata need duration_s.  Without keys all
    bouts make one group named all_wbs.  Rows with a NULL key are dropped.
    Exact medians and percentiles count a group's distinct values in one task;
    for one group of very many bouts an accuracy (say 10,000) bounds that.
    """

    keys: tuple[str, ...] = ()
    original_names: bool = True
    names: tuple[str, ...] = field(default=())
    accuracy: int | None = None

    def __call__(self, bouts: DataFrame) -> DataFrame:
        chosen = [o for o in OUTCOMES if o.measure in bouts.columns and (o.over is None or "duration_s" in bouts.columns) and (not self.names or o.name in self.names)]
        aggs = [outcome_column(o, self.accuracy).alias(o.name if self.original_names else o.long_name) for o in chosen]
        if not self.keys:
            return bouts.groupBy(F.lit("all_wbs").alias("group")).agg(*aggs)
        require(bouts, *self.keys)
        return bouts.dropna(subset=list(self.keys)).groupBy(*self.keys).agg(*aggs)


DAILY = Aggregator(("visit_type", "participant_id", "measurement_date"))
SINGLE_RECORDING = Aggregator((), original_names=False)


def duplicate_keys(bouts: DataFrame, keys: list[str]) -> DataFrame:
    """Keys that more than one row has, with their count."""
    return bouts.groupBy(*keys).count().where("count > 1")


def half_even(c: Column, digits: int) -> Column:
    """Rounded to digits with halves to the even one; what sums of doubles add behind the ninth digit makes no half uneven."""
    return F.bround(F.round(c, 9), digits)


def report_units(daily: DataFrame) -> DataFrame:
    """Stride lengths in cm, variations in percent, three digits, without wb_1030_sum."""
    def unit(name: str) -> Column:
        c = F.col(name)
        if name.startswith("strlen") and name.endswith("avg"):
            return c * 100
        return c * 100 if name.endswith("_var") else c

    floats = {n for n, t in daily.dtypes if t == "double"}
    return daily.select(*[half_even(unit(n), 3).alias(n) if n in floats else F.col(n) for n in daily.columns if n != "wb_1030_sum"])


def weekly(daily: DataFrame, weartime: DataFrame, *, keys: tuple[str, str, str] = ("visit_type", "participant_id", "measurement_date"), least_hours: float = 12, least_days: int = 3) -> DataFrame:
    """Means of the days with enough waking wear time, for visits with enough such days."""
    visit, who, day = keys
    days = daily.join(weartime.select(*keys, "total_worn_during_waking_h"), list(keys)).where(F.col("total_worn_during_waking_h") > least_hours)
    numbers = [n for n, t in days.dtypes if n not in keys and t in ("double", "bigint", "int")]
    means = days.groupBy(visit, who).agg(*[F.avg(n).alias(n) for n in numbers], F.count("walkdur_all_sum").alias("n_days"))
    return means.where(F.col("n_days") >= least_days)


def visit_spans(daily: DataFrame, *, keys: tuple[str, str, str] = ("visit_type", "participant_id", "measurement_date"), most_days: int = 7) -> DataFrame:
    """First and last day, number of days and span of each visit; flagged if there are too many or they lie too far apart."""
    visit, who, day = keys
    spans = daily.groupBy(visit, who).agg(F.min(day).alias("first_day"), F.max(day).alias("last_day"), F.count("*").alias("n_days"))
    spans = spans.withColumn("span_days", F.datediff("last_day", "first_day"))
    return spans.withColumns({"too_many": F.col("n_days") > most_days, "too_long": F.col("span_days") > most_days - 1})


def keep_last(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The last row of each key."""
    last = F.row_number().over(Window.partitionBy(*keys).orderBy(*[c.desc() for c in order]))
    return df.withColumn("rank__", last).where("rank__ = 1").drop("rank__")
