"""Matched places of two documents, their texts side by side, and the passages made of them."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ambulo.llm.common import BYTE_BASE, Powers, cut_lineage, parts_of, small, with_ids, word_hashes, word_spans

#: (start, end, kept_doc_id, kept_text_hash, kept_start, similarity) of one alignment.
Piece = tuple[int, int, int, int, int, float]
#: Rows of one key that a task takes.
ROWS_AT_ONCE = 1000
PAIR = ["doc_id", "text_hash", "kept_doc_id", "kept_text_hash"]
PASSAGE = "doc_id long, text_hash long, start_word int, end_word int, kept_doc_id long, kept_text_hash long, kept_start int, similarity double, n_pieces int"


def first_holders(rows: DataFrame, key: str) -> DataFrame:
    """(key, first) of each key that rows of several doc_ids hold: the smallest of them."""
    ends = rows.groupBy(key).agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last"))
    return cut_lineage(ends.where("first < last").drop("last"))


def matches_with_first(held: DataFrame, key: str, position: str = "pos") -> DataFrame:
    """Each row of held (key, first, doc_id, text_hash, n_words, position) with the place of its key in the first holder.

    Of that document's places the first one counts (smallest text_hash, then position).
    """
    at = held.where("doc_id = first").groupBy(key).agg(F.min(F.struct("text_hash", position)).alias("at"))
    at = cut_lineage(at.select(key, F.col("at.text_hash").alias("kept_text_hash"), F.col(f"at.{position}").alias("other_pos")))
    found = held.where("doc_id <> first").join(at, key)
    return found.select("doc_id", "text_hash", "n_words", F.col("first").alias("kept_doc_id"), "kept_text_hash", F.col(position).alias("pos"), "other_pos")


def match_array(value: pa.Scalar) -> np.ndarray:
    both = value.values
    return np.stack([both.field(0).to_numpy(), both.field(1).to_numpy()], axis=1).astype(np.int64)


def beside(texts: DataFrame, rows: DataFrame, keys: list[str], salt: Column | None = None) -> DataFrame:
    """One stream in which each text comes right before the rows of its key, instead of with each of them.

    texts: keys, text; rows: keys and others.  Sorted by keys within
    partitions; text is NULL in the rows.  With a ``salt`` (a hash), keys of
    over ROWS_AT_ONCE rows are dealt out to several tasks, each with the text
    once; without one, a key's rows are bounded by its text.
    """
    if salt is None:
        texts, rows = (df.withColumn("part__", F.lit(0)) for df in (texts, rows))
    else:
        # a row for every ROWS_AT_ONCE of the table, at most
        hot = rows.groupBy(*keys).count().where(F.col("count") > ROWS_AT_ONCE).select(*keys, F.ceil(F.col("count") / ROWS_AT_ONCE).cast("int").alias("parts__"))
        hot = small(cut_lineage(hot))
        rows = rows.join(hot, keys, "left").withColumn("part__", F.coalesce(F.pmod(salt, "parts__").cast("int"), F.lit(0))).drop("parts__")
        texts = texts.join(hot, keys, "left").withColumn("part__", F.explode(F.sequence(F.lit(0), F.coalesce("parts__", F.lit(1)) - 1))).drop("parts__")
    both = rows.unionByName(texts, allowMissingColumns=True)
    order = [*keys, "part__"]
    return both.repartition(*order).sortWithinPartitions(*order, F.col("text").isNull()).drop("part__")


def _cut_out(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For each row the words of the kept text, which came before it, that an alignment with the other document can reach."""
    data, starts, ends = b"", None, None
    for batch in parts_of(batches):
        keep, first_words, slices = [], [], []
        texts, sizes, matches = batch.column("text").cast(pa.binary()), batch.column("n_words"), batch.column("matches")
        for i in range(batch.num_rows):
            if texts[i].is_valid:
                data = texts[i].as_py()
                starts, ends = word_spans(np.frombuffer(data, np.uint8))
                continue
            places, n = match_array(matches[i]), sizes[i].as_py()
            # of a piece that counts, what either side skips is at most a quarter of the other
            low = max(0, int((places[:, 1] - places[:, 0]).min()) - n // 4 - 8)
            high = min(len(starts), int((places[:, 1] + n - places[:, 0]).max()) + n // 4 + 8)
            keep.append(i)
            first_words.append(low)
            slices.append(data[starts[low] : ends[high - 1]])
        if keep:
            rows = batch.select([*PAIR, "matches"]).take(pa.array(keep))
            yield pa.record_batch([*rows.columns, pa.array(first_words, pa.int32()), pa.array(slices, pa.binary())], [*PAIR, "matches", "first_word", "words"])


def unite(pieces: set[Piece]) -> list[tuple]:
    """Unions of overlapping pieces: (start, end, place of the longest one, lowest similarity, number)."""
    out: list[list] = []
    for s, e, kept, kept_hash, at, similarity in sorted(pieces):
        size = (e - s, -kept, -kept_hash, -at)
        if out and s <= out[-1][1]:
            now = out[-1]
            now[1], now[5], now[6] = max(now[1], e), min(now[5], similarity), now[6] + 1
            if size > now[7]:
                now[2:5], now[7] = [kept, kept_hash, at], size
        else:
            out.append([s, e, kept, kept_hash, at, similarity, 1, size])
    return [tuple(x[:7]) for x in out]


def passages_of(found: DataFrame, texts: DataFrame, compare: Callable[[np.ndarray, np.ndarray, np.ndarray], list[tuple[int, int, int, float]]]) -> DataFrame:
    """The passages (PASSAGE) of each document that matched places lead to.

    found: PAIR, n_words (of the document), pos, other_pos (word offsets in
    both).  texts: doc_id, text_hash, text, distinct.  compare(matches, x, y)
    gets the word hashes of both documents and gives (start, end, start in y,
    similarity) of the pieces that one kept document holds.

    The document that keeps a passage, of which many others may hold a copy,
    is met first, and only the part of its text in reach of the matches goes
    on to the other one.  Both times a text comes once before all its rows.
    """
    pairs = cut_lineage(found.groupBy(*PAIR).agg(F.max("n_words").alias("n_words"), F.collect_list(F.struct("pos", "other_pos")).alias("matches")))
    kept = with_ids(texts, pairs.select(F.col("kept_doc_id").alias("doc_id"))).toDF("kept_doc_id", "kept_text_hash", "text")
    near = beside(kept, pairs, PAIR[2:], F.xxhash64(*PAIR[:2]))
    near = near.mapInArrow(_cut_out, "doc_id long, text_hash long, kept_doc_id long, kept_text_hash long, matches array<struct<pos:int,other_pos:int>>, first_word int, words binary")
    both = beside(with_ids(texts, pairs.select("doc_id")), near, PAIR[:2])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        powers, key, x, pieces, rows = Powers(BYTE_BASE), None, None, set(), []
        for batch in parts_of(batches):
            ids, hashes, kept, kept_hash, lows = (batch.column(n).to_pylist() for n in (*PAIR, "first_word"))
            texts, words, matches = batch.column("text").cast(pa.binary()), batch.column("words"), batch.column("matches")
            for i in range(batch.num_rows):
                if texts[i].is_valid:
                    rows += [(*key, *p) for p in unite(pieces)] if pieces else []
                    key, pieces, x = (ids[i], hashes[i]), set(), texts[i].as_py()
                    continue
                if isinstance(x, bytes):  # the filter by doc_id lets some texts pass that have no rows
                    x = word_hashes(x, powers)
                low = lows[i]
                for s, e, at, similarity in compare(match_array(matches[i]) - [0, low], x, word_hashes(words[i].as_py(), powers)):
                    pieces.add((s, e, kept[i], kept_hash[i], at + low, similarity))
            if rows:
                yield _passage_batch(rows)
                rows = []
        if pieces:
            yield _passage_batch([(*key, *p) for p in unite(pieces)])

    return islands(both.mapInArrow(run, PASSAGE))


def _passage_batch(rows: list[tuple]) -> pa.RecordBatch:
    types = {"long": pa.int64(), "int": pa.int32(), "double": pa.float64()}
    fields = [x.split() for x in PASSAGE.split(", ")]
    return pa.record_batch([pa.array(c, types[t]) for c, (_, t) in zip(zip(*rows, strict=True), fields, strict=True)], [n for n, _ in fields])


def islands(pieces: DataFrame) -> DataFrame:
    """Unite the overlapping passages of a document that came from different tasks or batches.

    A document's passages are its own, so the window is bounded by the document.
    """
    by_start = Window.partitionBy("doc_id", "text_hash").orderBy("start_word", "end_word", "kept_doc_id", "kept_text_hash", "kept_start")
    before = F.max("end_word").over(by_start.rowsBetween(Window.unboundedPreceding, -1))
    opened = F.sum(F.when(F.col("start_word") <= F.col("before"), 0).otherwise(1)).over(by_start)
    longest: Column = F.max_by(F.struct("kept_doc_id", "kept_text_hash", "kept_start"), F.struct(F.col("end_word") - F.col("start_word"), -F.col("kept_doc_id"), -F.col("kept_text_hash"), -F.col("kept_start")))
    united = pieces.withColumn("before", before).withColumn("island", opened).groupBy("doc_id", "text_hash", "island").agg(
        F.min("start_word").alias("start_word"), F.max("end_word").alias("end_word"), longest.alias("kept"), F.min("similarity").alias("similarity"), F.sum("n_pieces").cast("int").alias("n_pieces")
    )
    return united.select("doc_id", "text_hash", "start_word", "end_word", "kept.kept_doc_id", "kept.kept_text_hash", "kept.kept_start", "similarity", "n_pieces")
