"""Mixing sources to target weights by a low-discrepancy slot schedule.

All words of the mix are dealt out in slots of equal size.  Slot i takes the
point frac(i * golden ratio), in exact 32-bit arithmetic; the source whose stretch of the cumulative
weights holds the point fills the slot.  Slots are ranked per source, each
source's shuffled documents are laid end to end and repeated as one stream,
and its slot of rank r takes the stream's r-th block.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ambulo.llm.common import cut_lineage

#: 2**32 divided by the square of the golden ratio, rounded to an odd number (a fixed value).
GOLDEN = 1640531527
#: Words in a slot.
SLOT_WORDS = 1024
#: A source's words in the mix are at most so many times its own.
MOST_REPEATS = 3
#: Hexadecimal digits that split the shuffle order into ranges (4096 a source), and slots whose ranks are counted together.
RANGE_DIGITS, SLOT_RANGE = 3, 1 << 12


def word_count(text: Column) -> Column:
    """Runs of characters other than ASCII white space; 0 for null."""
    # With one more word in front the text can't be empty nor start with white space.
    line = F.rtrim(F.concat(F.lit("x "), F.translate(text, "\t\n\x0b\x0c\r", "     ")))
    return F.coalesce((F.size(F.split(line, " +")) - 1).cast("long"), F.lit(0).cast("long"))


def source_targets(sizes: DataFrame) -> DataFrame:
    """Target words of each source of sizes (source, size).

    Sources in code point order, null last, weigh 1, 2, 3, 1, ...  They share
    the words of all by weight; a source stops at MOST_REPEATS times its own
    and the rest is shared by the others.  Returns source, source_size, share
    order (place long) and target double.  The table has one row a source; its
    running sums are taken in one task.
    """
    own = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    own = own.withColumn("place", F.row_number().over(by_name).cast("long")).withColumn("weight", (F.col("place") - 1) % 3 + 1)
    own = own.withColumn("most", F.col("source_size") * MOST_REPEATS)
    # With sources ordered by most / weight, those before some place stop at their most and the others share evenly.
    fill = Window.orderBy(F.col("most") / F.col("weight"), "place")
    all_rows = Window.partitionBy(F.lit(1))
    own = own.withColumn("total", F.sum("source_size").over(all_rows)).withColumn("all_weight", F.sum("weight").over(all_rows))
    before = fill.rowsBetween(Window.unboundedPreceding, -1)
    level = (F.col("total") - F.coalesce(F.sum("most").over(before), F.lit(0))) / (F.col("all_weight") - F.coalesce(F.sum("weight").over(before), F.lit(0)))
    own = own.withColumn("level", level)
    holds = F.when(F.col("level") * F.col("weight") <= F.col("most"), F.col("level"))
    own = own.withColumn("level", F.first(holds, ignorenulls=True).over(fill.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
    target = F.least(F.col("most").cast("double"), F.col("level") * F.col("weight"))
    return own.select("source", "source_size", "place", F.coalesce(target, F.col("most").cast("double")).alias("target"))


def running(df: DataFrame, keys: list[str], part: str, order: list[Column], value: Column, name: str) -> DataFrame:
    """Sum of value over the rows before, per keys, in two steps: over parts, then within a part.

    part: column that follows the order; its number of values per key is
    bounded, so no task takes all rows of a key.
    """
    sums = df.groupBy(*keys, part).agg(F.sum(value).alias("sum__"))
    by_part = Window.partitionBy(*keys).orderBy(part).rowsBetween(Window.unboundedPreceding, -1)
    bases = sums.select(*[F.col(k).alias(f"{k}__") for k in keys], F.col(part).alias("part__"), F.coalesce(F.sum("sum__").over(by_part), F.lit(0)).cast("long").alias("base__"))
    same = F.col(part) == F.col("part__")
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"{k}__"))
    inside = Window.partitionBy(*keys, part).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    within = F.coalesce(F.sum(value).over(inside), F.lit(0)).cast("long")
    return df.withColumn(name, within).join(bases, same).withColumn(name, F.col(name) + F.col("base__")).drop("base__", "part__", *[f"{k}__" for k in keys])


def slots(targets: DataFrame, total: int, slot_words: int) -> DataFrame:
    """(place, rank, slot): which block of which source fills each slot.

    Every source gets ceil(target / slot_words) slots.  What the schedule dealt
    it beyond is left out; what it lacks (a few slots at most) follows at the end.
    """
    spark = targets.sparkSession
    n = -(-total // slot_words)
    by_place = Window.orderBy("place")
    bounds = targets.withColumn("upto", F.sum("target").over(by_place)).withColumn("all", F.sum("target").over(Window.partitionBy(F.lit(1))))
    bounds = bounds.select("place", F.try_divide(F.coalesce(F.lag("upto").over(by_place), F.lit(0.0)), F.col("all")).alias("low"), F.try_divide(F.col("upto"), F.col("all")).alias("high"), F.ceil(F.col("target") / slot_words).alias("need"))
    # Points meet weights by thousandths: a stretch and a point share one, and the exact bounds decide.
    cells = bounds.select("*", F.explode(F.sequence(F.floor(F.col("low") * 1000), F.floor(F.col("high") * 1000))).alias("cell"))
    point = F.pmod(F.pmod("slot", F.lit(1 << 32)) * GOLDEN, F.lit(1 << 32)) / F.lit(2.0**32)
    points = spark.range(n).withColumnRenamed("id", "slot").withColumn("point", point).withColumn("cell", F.floor(F.col("point") * 1000))
    dealt = points.join(cells, "cell").where("point >= low and point < high").select("slot", "place", "need", F.floor(F.col("slot") / SLOT_RANGE).alias("stretch"))
    ranked = running(dealt, ["place"], "stretch", [F.col("slot")], F.lit(1), "rank").where("rank < need").select("place", "rank", "slot")
    had = ranked.groupBy("place").agg(F.count("*").alias("had"))
    short = bounds.join(had, "place", "left").select("place", "need", F.coalesce("had", F.lit(0)).alias("had")).where("need > had")
    # a few slots a source
    closing = F.row_number().over(Window.orderBy(F.col("rank") - F.col("had"), "place"))
    last = short.select("place", "had", F.explode(F.sequence(F.col("had"), F.col("need") - 1)).alias("rank")).select("place", "rank", (closing + F.lit(n - 1)).cast("long").alias("slot"))
    return ranked.unionByName(last)


def mix(docs: DataFrame, seed: int = 42, slot_words: int = SLOT_WORDS) -> tuple[DataFrame, DataFrame]:
    """Mix the documents of docs (doc_id, text, source, ...) to their sources' targets.

    Returns two tables.  The first has one row a document: doc_id, size
    (words), source_size, target, place (of its source), at (offset of its
    words in that source's stream).  The second is the mix: slot, place, rank,
    at, doc_id, first_word, words, offset: what each slot of slot_words words
    takes of which document, in stream order of offsets.

    Null sources are one source, the last.  A null text and one without words
    have size 0 and are never taken.  Documents are shuffled by a digest of
    seed, doc_id and size; rows that are equal in these may swap, which
    changes nothing but which of two like rows is taken.  An empty table gives
    empty results.  Other columns are ignored.
    """
    sized = cut_lineage(docs.select(F.col("doc_id").cast("long"), F.col("source").cast("string"), word_count(F.col("text")).alias("size")))
    targets = cut_lineage(source_targets(sized))
    total = sized.agg(F.sum("size")).first()[0] or 0
    digest = F.md5(F.concat_ws(":", F.lit(str(seed)), F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.col("size").cast("string")).cast("binary"))
    hashed = sized.withColumn("h", digest).withColumn("range", F.substring("h", 1, RANGE_DIGITS))
    # one row for each source; joined by size as Spark sees fit
    placed = hashed.join(targets, hashed["source"].eqNullSafe(targets["source"])).select("doc_id", "size", "source_size", "target", "place", "h", "range")
    placed = running(placed, ["place"], "range", [F.col("h"), F.col("doc_id"), F.col("size")], F.col("size"), "at")
    placed = cut_lineage(placed.select("doc_id", "size", "source_size", "target", "place", "at"))

    # Copies of a document in the repeated stream that begin before the target, cut to blocks.
    goal = F.round("target").cast("long")
    begins = placed.where("size > 0").withColumn("goal", goal).select(
        "place", "at", "doc_id", "size", "goal", F.explode(F.sequence(F.lit(0), F.lit(MOST_REPEATS - 1))).alias("repeat"), "source_size"
    ).withColumn("begin", F.col("at") + F.col("repeat") * F.col("source_size")).where("begin < goal")
    end = F.least(F.col("begin") + F.col("size"), F.col("goal"))
    first, final = F.floor(F.col("begin") / slot_words), F.floor((end - 1) / slot_words)
    blocks = begins.withColumn("end", end).select("*", F.explode(F.sequence(first, final)).alias("rank"))
    low = F.greatest(F.col("begin"), F.col("rank") * slot_words)
    high = F.least(F.col("end"), (F.col("rank") + 1) * slot_words)
    blocks = blocks.select("place", "rank", "at", "doc_id", (low - F.col("begin")).alias("first_word"), (high - low).alias("words"), low.alias("offset"))
    return placed, blocks.join(slots(targets, total, slot_words), ["place", "rank"]).select("slot", "place", "rank", "at", "doc_id", "first_word", "words", "offset")


def mix_report(docs: DataFrame, seed: int = 42, slot_words: int = SLOT_WORDS) -> DataFrame:
    """(doc_id, size, source_size, target, taken, slots, first_slot) of each document.

    taken sums up the mix's pieces of it, slots counts them and first_slot is
    the first slot of the schedule that takes some (-1 if none does).
    """
    placed, pieces = mix(docs, seed, slot_words)
    words = pieces.groupBy("place", "at").agg(F.sum("words").alias("taken"), F.count("*").alias("slots"), F.min("slot").alias("first_slot"))
    # Of the rows at one offset only one has words; the others take none.
    joined = placed.where("size > 0").join(words, ["place", "at"], "left")
    joined = joined.unionByName(placed.where("size = 0"), allowMissingColumns=True)
    none = F.lit(0).cast("long")
    return joined.select("doc_id", "size", "source_size", "target", F.coalesce("taken", none).cast("long").alias("taken"), F.coalesce("slots", none).alias("slots"), F.coalesce("first_slot", F.lit(-1)).cast("long").alias("first_slot"))
