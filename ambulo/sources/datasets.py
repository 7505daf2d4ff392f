"""Recordings of a study: a lazy catalogue of folders, its metadata, its samples.

Samples lie as Parquet below folders that carry the metadata in their names
(``root/cohort/participant_id/...``), with the test levels as columns.
"""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ambulo.functions.columns import GRAVITY_MS2, nan_to_null, require

#: Levels below a file by kind of study (fixed values).
LEVELS = {"laboratory": ("time_measure", "test", "trial"), "free_living": ("time_measure", "recording")}
#: Short and long names of tests and recordings (fixed values).
SHORT_NAMES = {"Test4": "TimedUpGo", "Test5": "WalkComfortable", "Test6": "WalkSlow", "Test7": "WalkFast", "Test8": "L", "Test9": "Surface", "Test10": "Halway", "Test11": "DailyActivities", "Recording4": "2.5h"}
LONG_NAMES = {
    "Test4": "TUG", "Test5": "Straight Walk Comfortable", "Test6": "Straight Walk Slow", "Test7": "Straight Walk Fast", "Test8": "L-Test", "Test9": "Surface Test", "Test10": "Hallway Test",
    "Test11": "Simulated Daily Activities", "Recording4": "Free Living 2.5h",
}
#: Sensor height by body height where only that is known.
SENSOR_SHARE = 0.53


@dataclass(frozen=True)
class Dataset:
    """Recordings with an index: one row for each combination of ``keys``.

    rows holds the samples with the keys as columns; nothing is read before
    the index or the samples are asked for, and a subset prunes the folders.
    """

    rows: DataFrame
    keys: tuple[str, ...]

    @classmethod
    def from_folders(cls, spark: SparkSession, root: str, parents: tuple[str, ...], levels: tuple[str, ...] = ()) -> Dataset:
        """Parquet files below root; parents name the folders above each file, from left to right."""
        rows = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", "*.parquet").parquet(root)
        parts = F.split(F.col("_metadata.file_path"), "/")
        named = {n: F.element_at(parts, -(len(parents) - i) - 1) for i, n in enumerate(parents) if n}
        return cls(rows.select("*", *[c.alias(n) for n, c in named.items()]), (*named, *levels))

    @classmethod
    def in_memory(cls, spark: SparkSession, samples: dict[tuple[str, ...], object], keys: tuple[str, ...]) -> Dataset:
        """From pandas tables by key: {(values of the keys): samples}; small studies and tests."""
        out = None
        for values, table in samples.items():
            if len(values) != len(keys):
                raise ValueError(f"{values} doesn't name {keys}")
            part = spark.createDataFrame(table).select("*", *[F.lit(v).alias(k) for k, v in zip(keys, values, strict=True)])
            out = part if out is None else out.unionByName(part)
        if out is None:
            raise ValueError("a dataset needs at least one table")
        return cls(out, keys)

    def index(self) -> DataFrame:
        """The distinct keys, with test_name and test_name_pretty (or recording_name ...) where there are such levels."""
        found = self.rows.select(*self.keys).distinct()
        for level in ("test", "recording"):
            if level in self.keys:
                for suffix, names in (("_name", SHORT_NAMES), ("_name_pretty", LONG_NAMES)):
                    known = F.create_map(*[F.lit(x) for pair in names.items() for x in pair])
                    found = found.withColumn(f"{level}{suffix}", F.coalesce(F.try_element_at(known, F.col(level)), F.col(level)))
        return found

    def subset(self, **values: str | list[str]) -> Dataset:
        """The recordings whose keys have one of the given values."""
        rows = self.rows
        for key, wanted in values.items():
            if key not in self.keys:
                raise ValueError(f"{key} is no key of {self.keys}")
            rows = rows.where(F.col(key).isin([wanted] if isinstance(wanted, str) else wanted))
        return replace(self, rows=rows)

    def within(self, index: DataFrame) -> Dataset:
        """The recordings of an index table."""
        keys = [k for k in self.keys if k in index.columns]
        return replace(self, rows=self.rows.join(index.select(*keys).distinct(), keys, "left_semi"))

    def samples(self) -> DataFrame:
        """All samples with their keys; NaN becomes NULL."""
        return nan_to_null(self.rows)

    def single(self) -> DataFrame:
        """The samples of the one recording that is left; others are an error."""
        if self.rows.select(*self.keys).distinct().limit(2).count() != 1:
            raise ValueError("this needs a dataset of exactly one recording; make a subset first")
        return self.samples()


def one_sampling_rate(tests: DataFrame, keys: list[str], rates: str = "sampling_rates") -> DataFrame:
    """tests with sampling_rate_hz, the one rate that all sensors in the array column share; different rates are an error at run time."""
    several = F.size(F.array_distinct(rates)) != 1
    said = F.concat(F.lit("the sensors of a test have different sampling rates: "), F.concat_ws("/", *[F.col(k).cast("string") for k in keys]))
    return tests.withColumn("sampling_rate_hz", F.when(several, F.raise_error(said).cast("double")).otherwise(F.get(rates, F.lit(0)).cast("double")))


def sensor_samples(raw: DataFrame, keys: list[str]) -> DataFrame:
    """Samples from arrays: raw has keys and arrays acc_x, acc_y, acc_z (in g), gyr_x, gyr_y, gyr_z (deg/s); acc comes out in m/s2."""
    names = [f"{s}_{a}" for s in ("acc", "gyr") for a in "xyz" if f"{s}_{a}" in raw.columns]
    require(raw, *keys, "acc_x", "acc_y", "acc_z")
    rows = raw.select(*keys, F.posexplode(F.arrays_zip(*names)).alias("sample", "v"))
    return rows.select(*keys, F.col("sample").cast("long").alias("sample"), *[(F.col(f"v.{n}") * (GRAVITY_MS2 if n.startswith("acc") else 1)).alias(n) for n in names])


def tests_of(structure: DataFrame, keys: list[str], column: str, levels: tuple[str, ...]) -> DataFrame:
    """Walk nested maps down to the tests: one row a test, its level names as columns, what lies there as column test_data.

    column: map<string, map<string, ... struct>> with as many maps as levels.
    """
    rows = structure.select(*keys, F.col(column).alias("test_data"))
    for i, level in enumerate(levels):
        rows = rows.select(*keys, *levels[:i], F.explode("test_data").alias(level, "test_data"))
    return rows


def participants(spark: SparkSession, path: str) -> DataFrame:
    """Participants' metadata from JSON files; participant_id is the folder's name where a file has none."""
    rows = spark.read.option("multiLine", "true").json(path)
    folder = F.element_at(F.split(F.col("_metadata.file_path"), "/"), -2)
    return rows.withColumn("participant_id", F.coalesce(F.col("participant_id").cast("string"), folder) if "participant_id" in rows.columns else folder)


def controls_as_healthy(metadata: DataFrame, height_m: float | None = None) -> DataFrame:
    """Cohort CTRL becomes HA; all have the given height and the sensor at SENSOR_SHARE of it, NULL without one."""
    tall = F.lit(height_m).cast("double")
    return metadata.withColumns({"cohort": F.when(F.col("cohort") == "CTRL", "HA").otherwise(F.col("cohort")), "height_m": tall, "sensor_height_m": tall * SENSOR_SHARE})


def id_column(regions: DataFrame, keys: list[str], ident: str | None = None) -> str:
    """The column that names a region: the given one, else wb_id, else gs_id, else the only other key."""
    if ident:
        return ident
    for name in ("wb_id", "gs_id"):
        if name in regions.columns:
            return name
    others = [k for k in regions.columns if k not in (*keys, "start", "end")]
    if len(others) == 1:
        return others[0]
    raise ValueError("which column names a region? give it as ident")


def checked_regions(regions: DataFrame, lengths: DataFrame, by: list[str]) -> DataFrame:
    """regions as they are; one that starts before 0, ends before it starts or ends behind its recording is an error at run time.

    lengths: by, n_samples.
    """
    wrong = (F.col("start") < 0) | (F.col("end") < F.col("start")) | (F.col("end") > F.col("n_samples"))
    fail = F.raise_error(F.lit("a region doesn't lie within its recording")).cast("boolean")
    return regions.join(lengths.select(*by, "n_samples"), by, "left").where(F.when(wrong, fail).otherwise(True)).select(*regions.columns)
