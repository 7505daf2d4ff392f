"""Reference parameters, stored per walking bout, as four typed relations.

Input: one row a recording with keys ``by`` and an array ``wb`` of structs, as
reference systems export them: numbers of a bout and arrays of its contacts,
turns and strides.  Times become samples of the recording, counted from 0.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ambulo.functions.columns import as_samples

#: Type of the array of bouts (names are those of the exports, fixed values).
WB = (
    "array<struct<Start: double, End: double, NumberStrides: double, Duration: double, Length: double, WalkingSpeed: double, Cadence: double, AverageStrideLength: double, TerminationReason: string, "
    "InitialContact_Event: array<double>, InitialContact_LeftRight: array<string>, "
    "Turn_Start: array<double>, Turn_End: array<double>, Turn_Duration: array<double>, Turn_Angle: array<double>, "
    "Stride_InitialContacts: array<array<double>>, Stride_Duration: array<double>, Stride_Length: array<double>, Stride_Speed: array<double>, Stance_Duration: array<double>, Swing_Duration: array<double>>>"
)


class Reference(NamedTuple):
    bouts: DataFrame
    contacts: DataFrame
    turns: DataFrame
    strides: DataFrame


def _missing(c: Column) -> Column:
    return F.when(~F.isnan(c), c)


def _listed(bouts: DataFrame, by: list[str], ident: str, columns: dict[str, str]) -> DataFrame:
    """One row for each place of the first column's array, with the same place of the others; NULL where one is shorter or missing."""
    first = next(iter(columns.values()))
    rows = bouts.select(*by, "wb_id", "w", F.posexplode(f"w.{first}").alias(ident, "at__"))
    return rows.select(*by, "wb_id", F.col(ident).cast("long").alias(ident), *[F.get(f"w.{c}", F.col(ident)).alias(n) for n, c in columns.items()])


def reference_parameters(recordings: DataFrame, by: list[str], data_rate_hz: float, reference_rate_hz: float, relative_to_bout: bool = False) -> Reference:
    """Bouts, contacts, turns and strides of the ``wb`` arrays of recordings.

    Bouts are numbered by their place.  Contacts without time or foot go;
    repeats within a bout go; of two feet at one time the foot is NULL; those
    behind the end of the bout go.  Strides without start or end go; their
    other missing values stay.  Stride times are taken as samples of the
    reference system if all of a recording's rounded starts are contacts, else
    as seconds; starts that are no contact even so are an error at run time.
    A stride has the foot of the contact that it starts with.  Starts and
    contacts count from 0, ends are exclusive.  With relative_to_bout, times
    of contacts, turns and strides count from the start of their bout.
    """
    rows = recordings.select(*by, F.posexplode("wb").alias("wb_id", "w")).withColumn("wb_id", F.col("wb_id").cast("long"))
    text = {"n_strides": "NumberStrides", "duration_s": "Duration", "length_m": "Length", "avg_walking_speed_mps": "WalkingSpeed", "avg_cadence_spm": "Cadence", "avg_stride_length_m": "AverageStrideLength"}
    bouts = rows.select(
        *by, "wb_id", as_samples(F.col("w.Start"), data_rate_hz).alias("start"), as_samples(F.col("w.End"), data_rate_hz).alias("end"),
        *[_missing(F.col(f"w.{c}")).cast("long" if n == "n_strides" else "double").alias(n) for n, c in text.items()],
        F.coalesce("w.TerminationReason", F.lit("Not Specified")).alias("termination_reason"),
    )
    ends = bouts.select(*by, "wb_id", F.col("end").alias("bout_end"))

    listed = _listed(rows, by, "step_id", {"ic": "InitialContact_Event", "lr_label": "InitialContact_LeftRight"})
    listed = listed.withColumn("ic", as_samples(_missing(F.col("ic")), data_rate_hz)).withColumn("lr_label", F.lower("lr_label")).where("ic is not null and lr_label is not null")
    contacts = listed.groupBy(*by, "wb_id", "ic").agg(F.min("step_id").alias("step_id"), F.when(F.count_distinct("lr_label") == 1, F.min("lr_label")).alias("lr_label"))
    contacts = contacts.join(ends, [*by, "wb_id"]).where("ic <= bout_end").select(*by, "wb_id", "step_id", "ic", "lr_label")

    turns = _listed(rows, by, "turn_id", {"start": "Turn_Start", "end": "Turn_End", "duration_s": "Turn_Duration", "angle_deg": "Turn_Angle"})
    turns = turns.select(
        *by, "wb_id", "turn_id", as_samples(F.col("start"), data_rate_hz).alias("start"), as_samples(F.col("end"), data_rate_hz).alias("end"), "duration_s", "angle_deg",
        F.when(F.col("angle_deg") > 0, "left").when(F.col("angle_deg") < 0, "right").alias("direction"),
    )

    named = {"duration_s": "Stride_Duration", "length_m": "Stride_Length", "speed_mps": "Stride_Speed", "stance_time_s": "Stance_Duration", "swing_time_s": "Swing_Duration"}
    strides = _listed(rows, by, "s_id", {"both": "Stride_InitialContacts"} | named)
    strides = strides.select(*by, "wb_id", "s_id", _missing(F.get("both", F.lit(0))).alias("a"), _missing(F.get("both", F.lit(1))).alias("b"), *[_missing(F.col(n)).alias(n) for n in named])
    strides = strides.where("a is not null and b is not null")
    scale = data_rate_hz / reference_rate_hz
    # the foot at a time, of the first bout that has a contact there
    feet = contacts.groupBy(*by, F.col("ic").alias("at")).agg(F.min_by(F.struct("lr_label"), "wb_id").alias("foot"))
    whole = Window.partitionBy(*by)
    for unit, factor in (("samples", scale), ("seconds", data_rate_hz)):
        known = feet.select(*by, F.col("at").alias(f"{unit}_a"), F.col("foot.lr_label").alias(f"{unit}_foot"), F.lit(True).alias(f"{unit}_known"))
        strides = strides.withColumn(f"{unit}_a", as_samples(F.col("a"), factor)).withColumn(f"{unit}_b", as_samples(F.col("b"), factor)).join(known, [*by, f"{unit}_a"], "left")
    strides = strides.withColumn("in_samples", F.min(F.coalesce("samples_known", F.lit(False))).over(whole))
    lost = ~F.col("in_samples") & F.col("seconds_known").isNull()
    fail = F.raise_error(F.lit("a stride starts at no initial contact, neither in samples nor in seconds")).cast("boolean")
    strides = strides.where(F.when(lost, fail).otherwise(True))
    pick = lambda n: F.when(F.col("in_samples"), F.col(f"samples_{n}")).otherwise(F.col(f"seconds_{n}"))
    strides = strides.select(*by, "wb_id", "s_id", pick("a").alias("start"), pick("b").alias("end"), *named, pick("foot").alias("lr_label"))

    shift = lambda df, c: df.withColumn(c, F.col(c) - 1)
    found = Reference(shift(bouts, "start"), shift(contacts, "ic"), shift(turns, "start"), shift(strides, "start"))
    if not relative_to_bout:
        return found
    starts = found.bouts.select(*by, "wb_id", F.col("start").alias("from__"))
    move = lambda df, *names: df.join(starts, [*by, "wb_id"]).withColumns({n: F.col(n) - F.col("from__") for n in names}).drop("from__")
    return Reference(found.bouts, move(found.contacts, "ic"), move(found.turns, "start", "end"), move(found.strides, "start", "end"))
