"""Streaming forms: bouts as session windows, daily outcomes by micro-batch."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter

from ambulo.operators.dmo import Aggregator


def session_bouts(strides: DataFrame, by: list[str], *, time: str = "event_time", duration_s: str = "duration_s", max_break_s: float = 3, min_strides: int = 4, late: str = "10 minutes") -> DataFrame:
    """Bouts of a stream of strides: a session stays open for a stride's duration and max_break_s behind its start.

    Rows later than ``late`` behind the newest are dropped.  A break of exactly
    max_break_s splits here, unlike in batch, as session ends are exclusive.
    """
    gap = F.concat((F.col(duration_s) * 1000 + max_break_s * 1000).cast("long").cast("string"), F.lit(" milliseconds"))
    sessions = strides.withWatermark(time, late).groupBy(*by, F.session_window(time, gap).alias("session"))
    bouts = sessions.agg(F.count("*").alias("n_strides"), F.min(time).alias("start"), F.max(F.col(time) + F.make_dt_interval(secs=F.col(duration_s).cast("decimal(18,6)"))).alias("end"))
    return bouts.where(F.col("n_strides") >= min_strides).drop("session")


def write_daily(bouts: DataFrame, keys: tuple[str, ...], path: str, checkpoint: str) -> DataStreamWriter:
    """Keep the daily outcomes of a stream of bouts at path, days of changed keys computed anew.

    Medians and percentiles can't be merged, so each micro-batch adds its bouts
    to path/bouts and recomputes the days it touches from there.  The last key
    is the day; bouts are stored by it, and only the folders of days in the
    batch are read.  A batch that runs again replaces its own files.
    """
    day = keys[-1]

    def run(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        batch = batch.withColumn("day__", F.coalesce(F.col(day).cast("string"), F.lit("none")))
        # a batch's folder of its own makes a repeat harmless; the day's folders below it prune what is read
        batch.write.mode("overwrite").partitionBy("day__").parquet(f"{path}/bouts/batch={number}")
        written = spark.read.parquet(f"{path}/bouts/batch={number}")
        touched = [r[0] for r in written.select("day__").distinct().collect()]  # days of one micro-batch
        stored = spark.read.schema(batch.drop("day__").schema.add("day__", "string")).parquet(f"{path}/bouts").where(F.col("day__").isin(touched))
        stored = stored.join(written.select(*keys).distinct(), list(keys), "left_semi").drop("day__")
        Aggregator(keys)(stored).withColumn("version", F.lit(number)).write.mode("overwrite").parquet(f"{path}/daily/batch={number}")

    return bouts.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint)


def latest_daily(daily: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    """The newest version of each day."""
    from ambulo.operators.dmo import keep_last

    return keep_last(daily, list(keys), [F.col("version")]).drop("version", "batch")
