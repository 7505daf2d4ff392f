"""Exact repeated passages by a sparse suffix array.

Suffixes are kept at minimiser positions only, each as a hash of its first
``head`` words.  Where several documents share a head, the runs of
``least_words`` words that the head can belong to are matched against the first
document that holds them, all at once or one by one, so any shared run meets.  Matches are
extended word by word to both sides.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ambulo.llm.common import BYTE_BASE, WORD_BASE, Powers, byte_rows, distinct_texts, minimisers, parts_of, span_hashes, with_ids, word_hashes, written
from ambulo.llm.passages import first_holders, matches_with_first, passages_of
from ambulo.llm.substrings import run_length

OWNER = ["doc_id", "text_hash"]


def sparse_suffixes(texts: DataFrame, least_words: int, k: int, window: int) -> DataFrame:
    """(doc_id, text_hash, n_words, pos, start, head, chunk) of the suffixes at minimisers with a whole head.

    chunk is the hash of all words of the runs that start up to window - 1
    words before the suffix, start where it begins.
    """
    size = least_words - window - 2

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of_bytes, of_words = Powers(BYTE_BASE), Powers(WORD_BASE)
        for batch in parts_of(batches):
            columns = []
            for doc, text_hash, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), byte_rows(batch, 2), strict=True):
                words = word_hashes(text, of_bytes)
                n = len(words)
                if n < least_words:
                    continue
                at = np.arange(n - k + 1)
                pos = minimisers(span_hashes(words, at, at + k, of_words), window, equal=True)
                start = np.maximum(pos - window + 1, 0)
                whole = (pos + size <= n) & (start + least_words <= n)
                pos, start = pos[whole], start[whole]
                heads = span_hashes(words, pos, pos + size, of_words).view(np.int64)
                chunks = span_hashes(words, start, np.minimum(pos + least_words, n), of_words).view(np.int64)
                owner = [np.full(len(pos), v, np.int64) for v in (doc, text_hash)]
                columns.append([*owner, np.full(len(pos), n, np.int32), pos.astype(np.int32), start.astype(np.int32), heads, chunks])
            if columns:
                yield pa.record_batch([pa.array(np.concatenate(c)) for c in zip(*columns, strict=True)], ["doc_id", "text_hash", "n_words", "pos", "start", "head", "chunk"])

    return texts.mapInArrow(run, "doc_id long, text_hash long, n_words int, pos int, start int, head long, chunk long")


def runs_at(places: DataFrame, texts: DataFrame, least_words: int, window: int) -> DataFrame:
    """(doc_id, text_hash, n_words, start, run): hashes of all runs of least_words words that start up to window - 1 words before one of (doc_id, text_hash, pos)."""
    places = written(places.groupBy(*OWNER).agg(F.collect_list("pos").alias("places")))
    texts = with_ids(texts, places.select("doc_id"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of_bytes, of_words = Powers(BYTE_BASE), Powers(WORD_BASE)
        for batch in parts_of(batches):
            columns = []
            for doc, text_hash, text, heads in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), byte_rows(batch, 2), batch.column(3), strict=True):
                words = word_hashes(text, of_bytes)
                starts = np.unique(heads.values.to_numpy()[:, None] - np.arange(window))
                starts = starts[(starts >= 0) & (starts + least_words <= len(words))]
                owner = [np.full(len(starts), v, np.int64) for v in (doc, text_hash)]
                columns.append([*owner, np.full(len(starts), len(words), np.int32), starts.astype(np.int32), span_hashes(words, starts, starts + least_words, of_words).view(np.int64)])
            if columns:
                yield pa.record_batch([pa.array(np.concatenate(c)) for c in zip(*columns, strict=True)], ["doc_id", "text_hash", "n_words", "start", "run"])

    return texts.join(places, OWNER).select(*OWNER, "text", "places").mapInArrow(run, "doc_id long, text_hash long, n_words int, start int, run long")


def shared_runs(texts: DataFrame, least_words: int, k: int, window: int) -> DataFrame:
    """Matches (see passages_of) of runs of least_words words with the first document that holds them.

    Chunks around shared heads are matched first.  A chunk that an earlier
    document holds stands for its runs, as that one holds them all; only the
    runs of other chunks are hashed one by one, in the chunk's first holder.
    """
    suffixes = written(sparse_suffixes(texts, least_words, k, window))
    near = suffixes.join(first_holders(suffixes, "head"), "head").drop("head", "first")
    near = written(near.join(first_holders(near, "chunk"), "chunk", "left"))
    found = matches_with_first(near.where("first is not null"), "chunk", "start")
    runs = written(runs_at(near.where("first is null or doc_id = first").select(*OWNER, "pos"), texts, least_words, window))
    held = written(runs.join(first_holders(runs, "run"), "run"))
    return found.unionByName(matches_with_first(held, "run", "start"))


def exact_matches(matches: np.ndarray, x: np.ndarray, y: np.ndarray, least_words: int) -> list[tuple[int, int, int, float]]:
    """(start, end, start in y, 1.0) of the maximal runs, of least_words at least, around matches that no run before them holds."""
    found, reach = [], 0
    for a, b in matches[np.lexsort((matches[:, 1], matches[:, 0]))].tolist():
        if a + least_words <= reach:
            continue
        left = run_length(x[:a][::-1], y[:b][::-1])
        right = run_length(x[a:], y[b:])
        if left + right >= least_words:
            found.append((a - left, a + right, b - left, 1.0))
            reach = max(reach, a + right)
    return found


def repeated_substrings(docs: DataFrame, least_words: int = 50, k: int = 8, window: int = 20) -> DataFrame:
    """Passages of at least least_words words that another document repeats word by word.

    docs: (doc_id, text, ...).  Words are runs of other bytes than ASCII white
    space.  Returns for each passage of the document with the larger doc_id:
    doc_id, text_hash (xxhash64 of the text that holds it), start_word,
    end_word (half open), kept_doc_id, kept_text_hash and kept_start (the
    longest match among the documents that are the first to hold a run of
    least_words words of it), similarity (1.0) and n_pieces (matches that
    overlap to make up the passage).

    A shared run of least_words words has a kept suffix in its first ``window``
    words, with a whole head of least_words - window - 2 words behind it, so
    the head has several holders and the run is hashed in all of them.  The
    spans are those of brute force, however many documents share a head.

    Null doc_id or text and short texts have none.  Rows with equal doc_id and
    text count once; different texts of one doc_id are searched each by itself,
    and what they share with each other doesn't count.  An empty table gives an
    empty result; other columns are ignored.
    """
    texts = distinct_texts(docs)
    return passages_of(shared_runs(texts, least_words, k, window), texts, lambda matches, x, y: exact_matches(matches, x, y, least_words))
