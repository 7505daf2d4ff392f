"""Benchmark decontamination with Spark expressions only.

Windows of a document that are as long as a benchmark item get a SimHash
fingerprint.  Items and windows meet in multi-index Hamming blocks: of eight
blocks of eight bits at least one differs in at most two bits if the
fingerprints differ in at most 23, so every pair in the radius is met.  Of
those pairs the weighted similarity of the shingles is computed.

Which windows get a fingerprint is decided first, by a join on word shingles:
only those that set an item's shingle on its place in the item.  A window that
shares no shingle has similarity 0; that the windows between the selected ones
are never the best is tested against all windows, not proven.  So the shingle
join selects, and the guarantee of the blocks is that of the filter behind it:
no pair within the radius is lost there.  Without that selection each word
would start a window of every item length (43 lengths in the benchmark at
hand), each with a fingerprint.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ambulo.llm.common import once, written

#: Hamming radius and the blocks that guarantee it: BLOCKS * (NEAR_BITS + 1) - 1.
BLOCKS, BLOCK_BITS, NEAR_BITS = 8, 8, 2
RADIUS = BLOCKS * (NEAR_BITS + 1) - 1
#: Shingles of the benchmark that are broadcast at a time (some 50 bytes each).
SHINGLES_AT_ONCE = 200_000


def words(text: Column) -> Column:
    """Lower-cased words of letters and digits."""
    return F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda w: w != "")


def shingle_hashes(hashes: str, width: int) -> Column:
    """Hash of each run of ``width`` entries of an array of word hashes."""
    return F.when(F.size(hashes) >= width, F.transform(F.sequence(F.lit(0), F.size(hashes) - width), lambda i: F.xxhash64(*[F.get(hashes, i + j) for j in range(width)])))


def simhash(shingles: str) -> Column:
    """Majority of each of 64 bits over an array of hashes, repeats included."""
    votes = f"size(filter({shingles}, h -> (shiftright(h, j) & 1) = 1)) * 2 > size({shingles})"
    return F.expr(f"aggregate(sequence(0, 63), 0L, (fp, j) -> fp | if({votes}, shiftleft(1L, j), 0L))")


def with_blocks(df: DataFrame, fp: str) -> DataFrame:
    """One row for each of the eight bytes of a fingerprint, with columns block and value."""
    rows = df.select("*", F.explode(F.sequence(F.lit(0), F.lit(BLOCKS - 1))).alias("block"))
    return rows.withColumn("value", F.expr(f"cast(shiftrightunsigned({fp}, block * {BLOCK_BITS}) & 255 as int)"))


def near_values() -> list[int]:
    """All 8-bit masks of at most NEAR_BITS bits."""
    return [m for m in range(1 << BLOCK_BITS) if m.bit_count() <= NEAR_BITS]


def common_count(a: str, b: str) -> Column:
    """Size of the multiset intersection of two arrays.

    Values held by both count once; what either repeats beyond that, mostly
    nothing, is counted value by value.
    """

    def repeats(x: str) -> Column:
        order = F.sort_array(x)
        return F.when(F.size(F.array_distinct(x)) < F.size(x), F.filter(order, lambda v, i: (i > 0) & (v == F.get(order, i - 1)))).otherwise(F.slice(x, 1, 0))

    more, other = repeats(a), repeats(b)
    count = lambda x, v: F.size(F.filter(x, lambda h: h == v))
    rest = F.aggregate(F.array_intersect(more, other), F.lit(0), lambda acc, v: acc + F.least(count(more, v), count(other, v)))
    return F.size(F.array_intersect(a, b)) + F.when((F.size(more) > 0) & (F.size(other) > 0), rest).otherwise(0)


def decontaminate(docs: DataFrame, benchmark: DataFrame, width: int = 5, similarity: float = 0.8) -> DataFrame:
    """Benchmark items that documents hold.

    docs: (doc_id, text, ...), benchmark: (item_id, text, ...).  Returns for
    each document and item that match: doc_id, item_id, start_word (of the
    best window; words as ``words`` makes them), n_words (the window's) and
    similarity, the weighted similarity of the shingles of ``width`` words of
    window and item, at least ``similarity``.

    A window is as long as the item, or the whole document if that is shorter,
    and stands where a shingle of both coincides.  Items under ``width`` words
    are compared as one shingle of all their words; items without words, null
    texts and documents shorter than a shingle never match.  Repeated items
    match each by itself, rows with the same doc_id count as one document, a
    null doc_id or item_id is an id like any other.  Empty tables give an
    empty result; other columns are ignored.

    The benchmark is the query set: its shingles are broadcast in groups of at
    most SHINGLES_AT_ONCE.  With several groups the documents' word hashes are
    written once and read for each.
    """
    hashed = F.transform(words(F.col("text")), lambda w: F.xxhash64(w))
    items = benchmark.select("item_id", hashed.alias("w")).where("size(w) > 0").distinct()
    items = items.withColumn("own_width", F.least(F.size("w"), F.lit(width)))
    widths = [r[0] for r in items.select("own_width").distinct().orderBy("own_width").collect()]  # at most ``width`` values
    docs_w = once(docs.select("doc_id", "text"), "w", hashed).drop("text")
    groups_of = []
    for own in widths:
        with_shingles = once(items.where(F.col("own_width") == own), "s", shingle_hashes("w", own))
        n = with_shingles.agg(F.sum(F.size("s"))).first()[0]
        groups = -(-n // SHINGLES_AT_ONCE)
        for group in range(groups):
            part = with_shingles.where(F.pmod(F.xxhash64("item_id", "s"), F.lit(groups)) == group)
            groups_of.append((part, own))
    if not groups_of:
        empty = docs.select("doc_id").join(benchmark.select("item_id").limit(0), F.lit(True)).limit(0)
        return empty.select("doc_id", "item_id", F.lit(0).alias("start_word"), F.lit(0).alias("n_words"), F.lit(0.0).alias("similarity"))
    if len(groups_of) > 1:
        docs_w = written(docs_w)
    pairs = reduce(DataFrame.unionByName, [_windows_in(docs_w, part, own, similarity) for part, own in groups_of])
    best = F.max_by(F.struct("start_word", "n_words", "similarity"), F.struct("similarity", -F.col("start_word"))).alias("best")
    return pairs.groupBy("doc_id", "item_id").agg(best).select("doc_id", "item_id", "best.start_word", "best.n_words", "best.similarity")


def _windows_in(docs_w: DataFrame, items: DataFrame, width: int, similarity: float) -> DataFrame:
    """Matches of documents with one group of items whose shingles can be broadcast."""
    listed = items.select("item_id", F.size("s").alias("m"), "s", F.posexplode("s").alias("off", "shingle"))
    # A run of common shingles stands for its first: prev is what the shingle before would be.
    listed = listed.select("shingle", "m", "off", F.when(F.col("off") > 0, F.get("s", F.col("off") - 1)).alias("prev")).distinct()
    in_docs = once(docs_w, "s", shingle_hashes("w", width)).select("doc_id", "s", F.posexplode("s").alias("pos", "shingle"))
    start = F.greatest(F.lit(0), F.least(F.col("pos") - F.col("off"), F.size("s") - F.col("m")))
    hits = in_docs.join(F.broadcast(listed), "shingle").where(F.col("prev").isNull() | (F.col("pos") == 0) | (F.get("s", F.col("pos") - 1) != F.col("prev")))
    windows = hits.select("doc_id", start.alias("start"), "m", F.slice("s", start + 1, F.col("m")).alias("window"))
    by_block = with_blocks(once(windows.distinct(), "fp", simhash("window")), "fp")

    masks = F.array(*[F.lit(m) for m in near_values()])
    keyed = items.select(F.xxhash64("item_id", "s").alias("item_key"), "item_id", F.size("s").alias("m"), F.col("s").alias("item"))
    prints = with_blocks(once(keyed, "item_fp", simhash("item")).drop("item", "item_id"), "item_fp")
    # 8 blocks and 37 masks for each item of a group, without its text: bounded like its shingles
    prints = prints.select("item_key", "m", "item_fp", "block", F.explode(F.transform(masks, lambda m: F.col("value").bitwiseXOR(m))).alias("value"))
    met = by_block.join(prints, ["m", "block", "value"])
    gap = F.bit_count(F.col("fp").bitwiseXOR(F.col("item_fp")))
    # Of the blocks in which a pair meets only the first counts.
    earlier = F.expr(f"exists(sequence(0, {BLOCKS - 1}), i -> i < block and bit_count(shiftrightunsigned(fp ^ item_fp, i * {BLOCK_BITS}) & 255) <= {NEAR_BITS})")
    met = met.where((gap <= RADIUS) & ~earlier).select("doc_id", "start", "window", "item_key").join(keyed.drop("m"), "item_key")
    met = once(met, "common", common_count("window", "item"))
    met = met.withColumn("similarity", F.col("common") / (F.size("window") + F.size("item") - F.col("common")))
    return met.where(F.col("similarity") >= similarity).select("doc_id", "item_id", F.col("start").alias("start_word"), (F.size("window") + width - 1).alias("n_words"), "similarity")
