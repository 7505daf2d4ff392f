"""Readers and writers for study tables: outcomes, wear time, recordings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Outcome columns of an export and their names here (fixed values).
EXPORT_COLUMNS = {
    "duration": "duration_s", "initialcontact_event_number": "n_raw_initial_contacts", "turn_number_so": "n_turns", "averagecadence": "cadence_spm",
    "averagestridespeed": "walking_speed_mps", "averagestridelength": "stride_length_m", "averagestrideduration": "stride_duration_s",
}
KEYS = ["visit_type", "participant_id", "measurement_date", "wb_id"]


def read_export(spark: SparkSession, path: str, sites: DataFrame, visit_type: str) -> DataFrame:
    """Bouts of one visit from a CSV export, dated in the time zone of the participant's site.

    sites: (participant_id, timezone), one row a participant.  Returns the
    keys, the outcomes and one boolean <outcome>__ok for each _flag column.
    """
    raw = spark.read.csv(path, header=True)
    return export_bouts(raw, sites, visit_type)


def export_bouts(raw: DataFrame, sites: DataFrame, visit_type: str) -> DataFrame:
    when = F.timestamp_seconds(F.col("visit_date").cast("double"))
    rows = raw.withColumnRenamed("participantid", "participant_id").join(sites.select("participant_id", "timezone"), "participant_id", "left")
    local = F.date_format(F.from_utc_timestamp(when, F.coalesce("timezone", F.lit("UTC"))), "yyyy-MM-dd")
    values = [F.col(a).cast("double").alias(b) for a, b in EXPORT_COLUMNS.items()]
    flags = [(F.col(f"{a}_flag").cast("int") == 1).alias(f"{b}__ok") for a, b in EXPORT_COLUMNS.items() if f"{a}_flag" in raw.columns]
    rows = rows.where(visit_name(F.col("visit_number")) == visit_type) if "visit_number" in raw.columns else rows
    return rows.select(F.lit(visit_type).alias("visit_type"), "participant_id", local.alias("measurement_date"), F.col("wb_id").cast("long"), *values, *flags)


#: First 14 characters of the long names of visits (fixed values).
VISITS = {
    "Baseline Visit": "T1", "Follow-up (T2)": "T2", "Follow-up (T3)": "T3", "Follow-up (T4)": "T4", "Follow-up (T5)": "T5", "Follow-up (T6)": "T6",
    "Unscheduled Vi": "UV",
}


def visit_name(raw: Column) -> Column:
    """T1 to T6 or UV from the first 14 characters of a visit's long name; NULL for any other."""
    known = F.create_map(*[F.lit(x) for pair in VISITS.items() for x in pair])
    return F.try_element_at(known, F.substring(raw, 1, 14))


def measurement_ids(compliance: DataFrame) -> DataFrame:
    """(participant_id, visit_type, measurement_id) from rows (participants, results_id, visit) of a compliance report."""
    rows = compliance.select(F.col("participants").cast("string").alias("participant_id"), visit_name(F.col("visit")).alias("visit_type"), F.col("results_id").cast("long").alias("measurement_id"))
    return rows.distinct()


def site_of_participants(mapping: DataFrame, timezones: dict[str, str]) -> DataFrame:
    """(participant_id, site, timezone) from rows (Local.Participant, Participant.Site) of a site map; NULL for an unknown site's time zone."""
    zone = F.create_map(*[F.lit(x) for pair in timezones.items() for x in pair])
    site = F.col("`Participant.Site`").cast("string")
    return mapping.select(F.col("`Local.Participant`").cast("string").alias("participant_id"), site.alias("site"), F.try_element_at(zone, site).alias("timezone"))


#: Key columns of validation results by condition (fixed values).
RESULT_KEYS = {
    "free_living": ["cohort", "participant_id", "time_measure", "recording", "recording_name", "recording_name_pretty"],
    "laboratory": ["cohort", "participant_id", "time_measure", "test", "trial", "test_name", "test_name_pretty"],
}


def read_validation_results(spark: SparkSession, folder: str, condition: str, algorithms: list[str], kind: str = "single") -> DataFrame:
    """Results of validated algorithms from folder/condition/algorithm/<kind>_results.csv, with column algorithm.

    kind: single or aggregated.  The key columns of the condition come first,
    as text; all other columns become numbers where they are.
    """
    if condition not in RESULT_KEYS or kind not in ("single", "aggregated"):
        raise ValueError("condition is free_living or laboratory, kind is single or aggregated")
    out = None
    for name in algorithms:
        rows = spark.read.csv(f"{folder}/{condition}/{name}/{kind}_results.csv", header=True)
        keys = [c for c in RESULT_KEYS[condition] if c in rows.columns]
        rows = rows.select(F.lit(name).alias("algorithm"), *keys, *[F.expr(f"try_cast(`{c}` AS double)").alias(c) for c in rows.columns if c not in keys])
        out = rows if out is None else out.unionByName(rows, allowMissingColumns=True)
    return out


#: Columns of a clinical table that get another name, after lower-casing (fixed values).
CLINICAL_NAMES = {
    "updrsiii": "updrs3", "6mwt_distancewalked": "6mwt_distance_walked", "h&y": "h_and_y", "dominant_hand_l_or_r___wrist_sensor_worn_on_non_dominant_hand": "handedness",
    "height_cm": "height_m", "sensor_height_cm": "sensor_height_m", "lab_based_assessment": "walking_aid_used_laboratory",
    "real_world_outdoors": "walking_aid_used_free_living", "real_world_indoors": "walking_aid_used_free_living_indoors",
}
MISSING = ("N/A", "N.A.", "N.A")


def clinical_name(raw: str) -> str:
    name = raw.lower().replace("(", "").replace(")", "").replace(" ", "_").replace("-", "_").replace("/", "p")
    return CLINICAL_NAMES.get(name, name)


def clinical_table(raw: DataFrame) -> DataFrame:
    """One row a participant, keyed (cohort, participant_id), from an export with one header row.

    The first two columns are the id and the cohort; rows without an id are
    summaries and go.  Names are unified, heights come in m, sex and hand in
    words, the fall history as boolean, a missing body mass index from weight
    and height.
    """
    who, cohort, *rest = raw.columns
    text = lambda c: F.when(F.trim(F.col(f"`{c}`").cast("string")).isin(*MISSING), None).otherwise(F.col(f"`{c}`").cast("string"))
    rows = raw.where(text(who).isNotNull()).select(text(cohort).alias("cohort"), F.regexp_replace(text(who), r"\.0$", "").alias("participant_id"), *[text(c).alias(clinical_name(c)) for c in rest])
    number = lambda c: F.expr(f"try_cast(`{c}` AS double)")
    new: dict[str, Column] = {c: number(c) / 100 for c in ("height_m", "sensor_height_m") if c in rows.columns}
    new |= {c: number(c) for c in ("weight_kg", "bmi_kgpm2") if c in rows.columns} | ({"age": number("age").cast("int")} if "age" in rows.columns else {})
    if "handedness" in rows.columns:
        hand = F.regexp_replace("handedness", "^[ ']+|[ ']+$", "")
        new["handedness"] = F.when(hand.isin("R", "right"), "right").when(hand.isin("L", "left"), "left")
    if "sex" in rows.columns:
        new["sex"] = F.lower("sex")
    if "fall_history" in rows.columns:
        new["fall_history"] = F.when(F.lower("fall_history") == "yes", True).when(F.lower("fall_history") == "no", False)
    rows = rows.withColumns(new)
    if {"bmi_kgpm2", "weight_kg", "height_m"} <= set(rows.columns):
        rows = rows.withColumn("bmi_kgpm2", F.coalesce("bmi_kgpm2", F.try_divide(F.col("weight_kg"), F.col("height_m") * F.col("height_m"))))
    return rows


def clinical_groups(header: list[tuple[str, str]]) -> dict[str, list[str]]:
    """Unified column names by group, from a two-row header (group, name); the ids (the first two) are left out."""
    out: dict[str, list[str]] = {}
    for group, name in header[2:]:
        out.setdefault(clinical_name(group), []).append(clinical_name(name))
    return out


def clinical_view(clinical: DataFrame, groups: dict[str, list[str]], group: str) -> DataFrame:
    """The columns of one group, with the keys."""
    return clinical.select("cohort", "participant_id", *[c for c in groups[group] if c in clinical.columns])


def daily_weartime(minutes: DataFrame, by: list[str], waking: tuple[int, int] = (7, 22), start: str = "interval_starttime", worn: str = "DUR_total_worn") -> DataFrame:
    """Hours worn a day, and within waking hours [from, to), from minute rows."""
    second = F.hour(start) * 3600 + F.minute(start) * 60 + F.second(start)
    awake = (second >= waking[0] * 3600) & (second < waking[1] * 3600)
    day = F.to_date(start).alias("measurement_date")
    return minutes.groupBy(*by, day).agg((F.coalesce(F.sum(worn), F.lit(0.0)) / 3600).alias("total_worn_h"), (F.coalesce(F.sum(F.when(awake, F.col(worn))), F.lit(0.0)) / 3600).alias("total_worn_during_waking_h"))


def read_weartime(spark: SparkSession, paths: list[str], waking: tuple[int, int] = (7, 22)) -> DataFrame:
    """Daily wear time of many minute files; the file name without ending is the measurement id."""
    raw = spark.read.schema("interval_starttime timestamp, DUR_total_worn double").csv(paths, sep=";", header=True, enforceSchema=False)
    named = raw.withColumn("measurement_id", F.regexp_extract(F.col("_metadata.file_name"), r"^(.*?)\.[^.]*$", 1))
    return daily_weartime(named, ["measurement_id"], waking)


def weartime_for(index: DataFrame, weartime: DataFrame, keys: list[str], order: str) -> DataFrame:
    """The last wear time row of each key of index, three digits; NULL where there is none."""
    last = F.row_number().over(Window.partitionBy(*keys).orderBy(F.col(order).desc()))
    one = weartime.withColumn("rank__", last).where("rank__ = 1").drop("rank__", order)
    return index.join(one, keys, "left").select(*[F.bround(c, 3).alias(c) if t == "double" else F.col(c) for c, t in index.join(one, keys, "left").dtypes])


def recordings(spark: SparkSession, path: str, levels: list[str]) -> DataFrame:
    """Catalogue of recordings below path: one row a file, its parent folders as metadata columns."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", "length")
    parts = F.split("path", "/")
    return files.select("path", "length", *[F.element_at(parts, -(len(levels) - i) - 1).alias(n) for i, n in enumerate(levels)])


def read_imu(spark: SparkSession, path: str) -> DataFrame:
    """Samples of recordings from Parquet: keys, sample, acc_x .. gyr_z; NaN becomes NULL."""
    from ambulo.functions.columns import nan_to_null

    return nan_to_null(spark.read.parquet(path))


def sensors_of(tests: DataFrame, expected: list[str], missing: str = "raise") -> DataFrame:
    """Check the array column available_sensors; missing: raise, warn (adds sensor_warning), ignore or skip such tests."""
    lacking = F.array_except(F.array(*map(F.lit, expected)), F.col("available_sensors"))
    said = F.concat(F.lit("sensors are missing: "), F.array_join(lacking, ", "))
    if missing == "skip":
        return tests.where(F.size(lacking) == 0)
    if missing == "warn":
        return tests.withColumn("sensor_warning", F.when(F.size(lacking) > 0, said))
    if missing == "ignore":
        return tests
    if missing != "raise":
        raise ValueError("missing is raise, warn, ignore or skip")
    return tests.where(F.when(F.size(lacking) > 0, F.raise_error(said).cast("boolean")).otherwise(True))


def write_test_list(tests: DataFrame, path: str) -> None:
    """Keep a catalogue of tests (key columns, available_sensors, available_reference_systems ...) so that it needn't be scanned again."""
    tests.write.mode("overwrite").json(path)


def read_test_list(spark: SparkSession, path: str, schema: str = "key array<string>, available_sensors array<array<string>>, available_reference_systems array<string>") -> DataFrame:
    """A catalogue written before; path may name files of many participants, whose folders are kept as column source."""
    return spark.read.schema(schema).json(path).withColumn("source", F.col("_metadata.file_path"))


def clean_contacts(contacts: DataFrame, keys: list[str], position: str = "ic", foot: str = "lr_label") -> DataFrame:
    """One row a contact; its label is NULL where rows disagree."""
    return contacts.groupBy(*keys, position).agg(F.when(F.count_distinct(foot) == 1, F.min(foot)).alias(foot))


def write_results(df: DataFrame, path: str, kind: str = "parquet") -> None:
    """Write a result as parquet, csv (with header) or json."""
    writer = df.write.mode("overwrite")
    writer.option("header", True).csv(path) if kind == "csv" else writer.format(kind).save(path)
