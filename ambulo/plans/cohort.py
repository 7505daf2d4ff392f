"""From bouts of a study to its daily and weekly tables, with checks, and their export."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ambulo.operators import dmo

KEYS = ("visit_type", "participant_id", "measurement_date")
#: Weekly outcomes that are given as whole numbers (fixed values).
WHOLE = ("walkdur_all_sum", "turns_all_sum", "wb_all_sum", "wb_10_sum", "wb_30_sum", "wb_60_sum")


def rounded_weeks(weekly: DataFrame, keys: tuple[str, ...] = KEYS[:2]) -> DataFrame:
    """Whole numbers for WHOLE, three digits for all others; halves go to the even digit."""

    def cut(name: str, kind: str) -> Column:
        if name in keys or kind not in ("double", "float"):
            return F.col(name)
        return dmo.half_even(F.col(name), 0 if name in WHOLE else 3).alias(name)

    return weekly.select(*[cut(n, t) for n, t in weekly.dtypes])


def suffixed(df: DataFrame, suffix: str, keys: tuple[str, ...]) -> DataFrame:
    """Every column but the keys with a suffix."""
    return df.select(*[F.col(c) if c in keys else F.col(c).alias(f"{c}{suffix}") for c in df.columns])


def study_tables(bouts: DataFrame, weartime: DataFrame, least_hours: float = 12, least_days: int = 3) -> dict[str, DataFrame]:
    """The six tables of a study.

    bouts: masked, with KEYS.  weartime: KEYS, total_worn_h,
    total_worn_during_waking_h (NULL where it is missing).  daily_agg_all and
    weekly_agg_all hold all, the filtered ones days with enough waking wear
    time and visits with enough such days; daily_weartime; missing_weartime
    (keys only).
    """
    day, week = list(KEYS), list(KEYS[:2])
    daily = dmo.report_units(dmo.DAILY(bouts))
    worn = weartime.select(*day, "total_worn_h", "total_worn_during_waking_h")
    with_wear = daily.join(worn, day, "left")
    enough = with_wear.where(F.col("total_worn_during_waking_h") > least_hours)
    numbers = [n for n, t in daily.dtypes if n not in day and t in ("double", "bigint", "int")]
    weekly = rounded_weeks(enough.groupBy(*week).agg(*[F.avg(n).alias(n) for n in numbers], F.count("walkdur_all_sum").alias("n_days")))
    return {
        "daily_agg_all": suffixed(with_wear, "_d", KEYS),
        "daily_agg_filtered": suffixed(enough, "_d", KEYS),
        "weekly_agg_all": suffixed(weekly, "_w", KEYS[:2]),
        "weekly_agg_filtered": suffixed(weekly.where(F.col("n_days") >= least_days), "_w", KEYS[:2]),
        "daily_weartime": worn,
        "missing_weartime": worn.where("total_worn_h is null").select(*day),
    }


def export(tables: dict[str, DataFrame], folder: str, kind: str = "csv") -> None:
    """Each table to folder/<name>."""
    from ambulo.sources.loaders import write_results

    for name, table in tables.items():
        write_results(table, f"{folder}/{name}", kind)
