"""Interval and event operators.  Every one works within the groups of ``by``.

Intervals are rows with start and end.  Windows are partitioned by recording or
group keys, so a task holds the intervals of one group at a time.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _tag(df: DataFrame, by: list[str], tag: str, *names: str) -> DataFrame:
    return df.select(*by, *[F.col(n).alias(f"{n}__{tag}") for n in names])


def merge(intervals: DataFrame, by: list[str], gap: int = 0) -> DataFrame:
    """Unite intervals that overlap or stand at most ``gap`` apart."""
    w = Window.partitionBy(*by).orderBy("start", "end")
    reach = F.max("end").over(w.rowsBetween(Window.unboundedPreceding, -1))
    opened = intervals.withColumn("new__", F.coalesce((F.col("start") > reach + gap).cast("int"), F.lit(1)))
    islands = opened.withColumn("island__", F.sum("new__").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return islands.groupBy(*by, "island__").agg(F.min("start").alias("start"), F.max("end").alias("end")).drop("island__")


def runs_of(samples: DataFrame, by: list[str], flag: str, position: str = "sample") -> DataFrame:
    """Half-open intervals of the runs of TRUE in consecutive samples."""
    w = Window.partitionBy(*by).orderBy(position)
    hits = samples.where(F.col(flag)).withColumn("group__", F.col(position) - F.row_number().over(w))
    return hits.groupBy(*by, "group__").agg(F.min(position).alias("start"), (F.max(position) + 1).alias("end")).drop("group__")


def samples_of(intervals: DataFrame, by: list[str]) -> DataFrame:
    """One row for each sample of half-open intervals."""
    return intervals.where("end > start").select(*by, F.explode(F.sequence("start", F.col("end") - 1)).alias("sample"))


def coverage(detected: DataFrame, reference: DataFrame, by: list[str]) -> DataFrame:
    """Segments between boundaries with the number of intervals of each side over them: one sweep, no range join."""
    edges = None
    for df, side in ((detected, "det"), (reference, "ref")):
        for name, step in (("start", 1), ("end", -1)):
            part = df.where("end > start").select(*by, F.col(name).alias("pos"), F.lit(step if side == "det" else 0).alias("det"), F.lit(step if side == "ref" else 0).alias("ref"))
            edges = part if edges is None else edges.unionByName(part)
    edges = edges.groupBy(*by, "pos").agg(F.sum("det").alias("det"), F.sum("ref").alias("ref"))
    w = Window.partitionBy(*by).orderBy("pos")
    upto = w.rowsBetween(Window.unboundedPreceding, 0)
    return edges.select(*by, F.col("pos").alias("start"), F.lead("pos").over(w).alias("end"), F.sum("det").over(upto).alias("det"), F.sum("ref").over(upto).alias("ref")).where("end is not null")


def intersect(a: DataFrame, b: DataFrame, by: list[str]) -> DataFrame:
    """Where both lists have an interval, as merged intervals."""
    return merge(coverage(a, b, by).where("det > 0 and ref > 0").select(*by, "start", "end"), by)


def categorize_per_sample(detected: DataFrame, reference: DataFrame, by: list[str], n_samples: DataFrame | None = None) -> DataFrame:
    """tp, fp and fn segments of two interval lists, and tn up to each group's n_samples - 1 if given.

    n_samples: (by..., n_samples).  Ends of true negatives are shared with
    their neighbours, as the samples are counted with both ends.
    """
    kind = F.when((F.col("det") > 0) & (F.col("ref") > 0), "tp").when(F.col("det") > 0, "fp").when(F.col("ref") > 0, "fn")
    parts = coverage(detected, reference, by).select(*by, "start", "end", kind.alias("match_type")).where("match_type is not null")
    w = Window.partitionBy(*by).orderBy("start")
    new = F.coalesce((F.lag("end").over(w) != F.col("start")) | (F.lag("match_type").over(w) != F.col("match_type")), F.lit(True))
    parts = parts.withColumn("new__", new.cast("int")).withColumn("island__", F.sum("new__").over(w))
    parts = parts.groupBy(*by, "island__", "match_type").agg(F.min("start").alias("start"), F.max("end").alias("end")).select(*by, "start", "end", "match_type")
    if n_samples is None:
        return parts
    both = merge(detected.select(*by, "start", "end").unionByName(reference.select(*by, "start", "end")), by)
    ends = n_samples.select(*by, F.lit(0).cast("long").alias("start"), F.lit(0).cast("long").alias("end")).unionByName(n_samples.select(*by, (F.col("n_samples") - 1).alias("start"), (F.col("n_samples") - 1).alias("end")))
    gaps = both.unionByName(ends).withColumn("reach__", F.max("end").over(Window.partitionBy(*by).orderBy("start", "end").rowsBetween(Window.unboundedPreceding, -1)))
    tn = gaps.where("start > reach__").select(*by, F.col("reach__").alias("start"), F.col("start").alias("end"), F.lit("tn").alias("match_type"))
    return parts.unionByName(tn)


def match_overlap(detected: DataFrame, reference: DataFrame, by: list[str], threshold: float = 0.8, ident: str = "id", bucket: int = 100_000) -> DataFrame:
    """One-to-one matches of intervals whose overlap is at least threshold of both, as tp, fp and fn rows.

    threshold over 0.5 makes matches unique if no list overlaps itself.  An
    interval goes to each bucket of positions that it touches and meets the
    others there, so that one long recording is spread over tasks; a pair
    counts in the bucket in which its overlap starts.
    """
    if not 0.5 < threshold <= 1:
        raise ValueError("threshold must be over 0.5 and at most 1")
    d, r = _tag(detected, by, "d", ident, "start", "end"), _tag(reference, by, "r", ident, "start", "end")
    spread = lambda df, t: df.withColumn("bucket__", F.explode(F.sequence(F.floor(F.col(f"start__{t}") / bucket), F.floor(F.col(f"end__{t}") / bucket))))
    low, high = F.greatest("start__d", "start__r"), F.least("end__d", "end__r")
    share = high - low
    pairs = spread(d, "d").join(spread(r, "r"), [*by, "bucket__"]).where(F.col("bucket__") == F.floor(low / bucket))
    pairs = pairs.where((share >= threshold * (F.col("end__d") - F.col("start__d"))) & (share >= threshold * (F.col("end__r") - F.col("start__r"))) & (share > 0))
    pairs = pairs.select(*by, F.col(f"{ident}__d").alias("id_detected"), F.col(f"{ident}__r").alias("id_reference"))
    return _with_unmatched(pairs, detected, reference, by, ident)


def _with_unmatched(pairs: DataFrame, detected: DataFrame, reference: DataFrame, by: list[str], ident: str) -> DataFrame:
    """Full outer join of one-to-one pairs to both lists."""
    d, r = detected.select(*by, F.col(ident).alias("id_detected")), reference.select(*by, F.col(ident).alias("id_reference"))
    only_d = d.join(pairs, [*by, "id_detected"], "left_anti").select(*by, "id_detected", F.lit(None).cast("long").alias("id_reference"), F.lit("fp").alias("match_type"))
    only_r = r.join(pairs, [*by, "id_reference"], "left_anti").select(*by, F.lit(None).cast("long").alias("id_detected"), "id_reference", F.lit("fn").alias("match_type"))
    return pairs.withColumn("match_type", F.lit("tp")).unionByName(only_d).unionByName(only_r)


def match_nearest(detected: DataFrame, reference: DataFrame, by: list[str], position: str, tolerance: int, ident: str = "id") -> DataFrame:
    """Pairs of events that are each other's nearest within tolerance, as tp, fp and fn rows.

    Of two equally near events the earlier one counts, of events at one
    position the one with the smaller id.
    """
    rows = detected.select(*by, F.col(position).alias("pos"), F.col(ident).alias("id"), F.lit("d").alias("side")).unionByName(
        reference.select(*by, F.col(position).alias("pos"), F.col(ident).alias("id"), F.lit("r").alias("side"))
    )
    back = Window.partitionBy(*by).orderBy("pos").rangeBetween(Window.unboundedPreceding, 0)
    ahead = Window.partitionBy(*by).orderBy("pos").rangeBetween(0, Window.unboundedFollowing)
    near = {}
    for side, other in (("d", "r"), ("r", "d")):
        mine = F.when(F.col("side") == other, F.struct(F.col("pos"), (-F.col("id")).alias("neg")))
        theirs = F.when(F.col("side") == other, F.struct(F.col("pos"), F.col("id")))
        near[side] = (F.max(mine).over(back), F.min(theirs).over(ahead))
    choose = lambda i: F.when(F.col("side") == "d", near["d"][i]).otherwise(near["r"][i])
    # struct field names differ between the two windows; read them apart
    rows = rows.select(*by, "pos", "id", "side", near["d"][0].alias("db"), near["d"][1].alias("da"), near["r"][0].alias("rb"), near["r"][1].alias("ra"))
    side = F.col("side") == "d"
    before_pos, before_id = F.when(side, F.col("db.pos")).otherwise(F.col("rb.pos")), -F.when(side, F.col("db.neg")).otherwise(F.col("rb.neg"))
    after_pos, after_id = F.when(side, F.col("da.pos")).otherwise(F.col("ra.pos")), F.when(side, F.col("da.id")).otherwise(F.col("ra.id"))
    nearer = after_pos.isNull() | (F.col("pos") - before_pos <= after_pos - F.col("pos"))
    first = before_pos.isNotNull() & nearer
    found = rows.select(*by, "side", "id", F.when(first, before_id).otherwise(after_id).alias("other"), F.when(first, F.col("pos") - before_pos).otherwise(after_pos - F.col("pos")).alias("far")).where(F.col("far") <= tolerance)
    d = found.where("side = 'd'").select(*by, F.col("id").alias("id_detected"), F.col("other").alias("id_reference"))
    r = found.where("side = 'r'").select(*by, F.col("other").alias("id_detected"), F.col("id").alias("id_reference"))
    return _with_unmatched(d.join(r, [*by, "id_detected", "id_reference"]), detected, reference, by, ident)


def side_by_side(matches: DataFrame, detected: DataFrame, reference: DataFrame, by: list[str], ident: str = "id") -> DataFrame:
    """Common columns of matched rows as <name>__detected and <name>__reference."""
    common = [c for c in detected.columns if c in reference.columns and c not in by and c != ident]
    d = detected.select(*by, F.col(ident).alias("id_detected"), *[F.col(c).alias(f"{c}__detected") for c in common])
    r = reference.select(*by, F.col(ident).alias("id_reference"), *[F.col(c).alias(f"{c}__reference") for c in common])
    return matches.where("match_type = 'tp'").drop("match_type").join(d, [*by, "id_detected"]).join(r, [*by, "id_reference"])


def count_points(intervals: DataFrame, points: DataFrame, by: list[str], position: str, ident: str = "id") -> DataFrame:
    """Points within each interval, both ends included, from prefix counts over one ordered stream."""
    stream = points.select(*by, F.col(position).alias("pos"), F.lit(1).alias("n"), F.lit(None).cast("long").alias("id"), F.lit(1).alias("turn"))
    for name, turn in (("start", 0), ("end", 2)):
        stream = stream.unionByName(intervals.select(*by, F.col(name).alias("pos"), F.lit(0).alias("n"), F.col(ident).alias("id"), F.lit(turn).alias("turn")))
    upto = F.sum("n").over(Window.partitionBy(*by).orderBy("pos", "turn").rowsBetween(Window.unboundedPreceding, 0))
    counted = stream.withColumn("upto", upto).where("turn <> 1")
    return counted.groupBy(*by, "id").agg((F.max(F.when(F.col("turn") == 2, F.col("upto"))) - F.max(F.when(F.col("turn") == 0, F.col("upto")))).alias("n_points")).withColumnRenamed("id", ident)


def overlapping_bins(df: DataFrame, column: str, bins: dict[str, tuple[float, float]]) -> DataFrame:
    """One row for each (lower, upper] bin that holds the value: a single pass, no join."""
    marks = F.array(*[F.when((F.col(column) > low) & (F.col(column) <= high), F.lit(name)) for name, (low, high) in bins.items()])
    return df.select("*", F.explode(F.filter(marks, lambda m: m.isNotNull())).alias("bin"))


def relative_to(events: DataFrame, regions: DataFrame, by: list[str], columns: list[str]) -> DataFrame:
    """Event columns as offsets from the start of their region."""
    starts = regions.select(*by, F.col("start").alias("start__"))
    joined = events.join(starts, by)
    return joined.select(*[(F.col(c) - F.col("start__")).alias(c) if c in columns else F.col(c) for c in events.columns])


def interval_mean(intervals: DataFrame, values: DataFrame, by: list[str], position: str, value: str, ident: str = "id") -> DataFrame:
    """Mean of the values at positions within each interval, both ends included; NULL without any.

    Sums and counts up to both ends of an interval come from one ordered
    stream of values and ends, so that intervals and values never meet in pairs.
    """
    nothing = F.lit(None).cast("long")
    stream = values.where(F.col(value).isNotNull()).select(*by, F.col(position).alias("pos"), F.col(value).cast("double").alias("v"), nothing.alias("id"), F.lit(1).alias("turn"))
    for name, turn in (("start", 0), ("end", 2)):
        stream = stream.unionByName(intervals.select(*by, F.col(name).alias("pos"), F.lit(None).cast("double").alias("v"), F.col(ident).alias("id"), F.lit(turn).alias("turn")))
    upto = Window.partitionBy(*by).orderBy("pos", "turn").rowsBetween(Window.unboundedPreceding, 0)
    summed = stream.withColumn("s", F.coalesce(F.sum("v").over(upto), F.lit(0.0))).withColumn("n", F.count("v").over(upto)).where("turn <> 1")
    between = lambda c: F.max(F.when(F.col("turn") == 2, F.col(c))) - F.max(F.when(F.col("turn") == 0, F.col(c)))
    ends = summed.groupBy(*by, "id").agg(between("s").alias("s"), between("n").alias("n"))
    return ends.select(*by, F.col("id").alias(ident), F.when(F.col("n") > 0, F.col("s") / F.col("n")).alias(f"{value}_mean"))


def window_ids(position: Column, size: int, step: int) -> Column:
    """Array of the numbers of all sliding windows that hold a position (window k: [k * step, k * step + size))."""
    first = F.greatest(F.lit(0).cast("long"), F.floor((position - size) / step) + 1)
    last = F.floor(position / step)
    return F.when(first <= last, F.sequence(first, last)).otherwise(F.array().cast("array<bigint>"))


def sliding_windows(samples: DataFrame, by: list[str], position: str, size: int, overlap: int) -> DataFrame:
    """Each sample once for every complete window of ``size`` samples that holds it; an incomplete tail is dropped."""
    step = size - overlap
    last = F.max(position).over(Window.partitionBy(*by))
    rows = samples.withColumn("last__", last).withColumn("window", F.explode(window_ids(F.col(position), size, step)))
    return rows.where(F.col("window") * step + size - 1 <= F.col("last__")).drop("last__")
