"""Fuzzy repeated passages by collinear chaining of shared k-mer seeds.

Seeds are the minimisers among the hashes of k words; two that follow each
other in a document make a link.  Every seed and every link that several
documents hold is matched against its first holder (smallest doc_id), so n
holders make n - 1 matches, and a text pieced together of frequent lines meets
the first text that joins them in the same way.  For each pair of documents the
matches are merged to diagonal segments, chained with gap costs through a
Fenwick tree, and the chains are aligned word by word and extended.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ambulo.llm.common import BYTE_BASE, WORD_BASE, Powers, byte_rows, distinct_texts, minimisers, mix64, parts_of, span_hashes, word_hashes, word_spans, written
from ambulo.llm.passages import first_holders, matches_with_first, passages_of

#: Words between two seeds on one diagonal that still count as one segment.
SEGMENT_GAP = 32
#: Words of a run that is matched inside a pair of documents.
ANCHOR = 4
#: Words that must agree after an edit for an alignment to go on.
AFTER_EDIT = 4
#: Gap cost for each word skipped on either side.
GAP_COST = 0.5


def seeds(texts: DataFrame, k: int = 8, window: int = 12, least_words: int = 50) -> DataFrame:
    """(doc_id, text_hash, n_words, pos, seed, link) of each minimiser; texts under least_words have none.

    link is the hash of the seed, the next one and the words between their
    starts, null for the last seed.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of_bytes, of_words = Powers(BYTE_BASE), Powers(WORD_BASE)
        for batch in parts_of(batches):
            places, values, links, counts, sizes = [], [], [], [], []
            for text in byte_rows(batch, 2):
                words = word_hashes(text, of_bytes)
                if len(words) < max(k, least_words):
                    counts.append(0)
                    sizes.append(0)
                    continue
                at = np.arange(len(words) - k + 1)
                h = span_hashes(words, at, at + k, of_words)
                pos = minimisers(h, window)
                h = h[pos]
                link = np.zeros(len(pos), np.uint64)
                link[:-1] = mix64(h[:-1] * np.uint64(BYTE_BASE) + h[1:] * np.uint64(WORD_BASE) + np.diff(pos).astype(np.uint64))
                places.append(pos.astype(np.int32))
                values.append(h.view(np.int64))
                links.append(link.view(np.int64))
                counts.append(len(pos))
                sizes.append(len(words))
            if places:
                last = np.zeros(sum(counts), bool)
                last[np.cumsum([c for c in counts if c]) - 1] = True
                per_doc = [np.repeat(c, counts) for c in (batch.column(0).to_numpy(zero_copy_only=False), batch.column(1).to_numpy(zero_copy_only=False), np.array(sizes, np.int32))]
                columns = [*per_doc, np.concatenate(places), np.concatenate(values)]
                yield pa.record_batch([*map(pa.array, columns), pa.array(np.concatenate(links), mask=last)], ["doc_id", "text_hash", "n_words", "pos", "seed", "link"])

    return texts.mapInArrow(run, "doc_id long, text_hash long, n_words int, pos int, seed long, link long")


def segments(pos: np.ndarray, other: np.ndarray, k: int) -> list[tuple[int, int, int]]:
    """(start, end, start in the other) of the runs of matches on one diagonal, by start."""
    shift = other - pos
    order = np.lexsort((pos, shift))
    pos, shift = pos[order], shift[order]
    new = np.ones(len(pos), bool)
    new[1:] = (np.diff(shift) != 0) | (np.diff(pos) > SEGMENT_GAP)
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(pos)) - 1
    found = zip(pos[first].tolist(), (pos[last] + k).tolist(), (pos[first] + shift[first]).tolist(), strict=True)
    return sorted(found)


class PrefixBest:
    """Fenwick tree over coordinates: the best (score, index) at or below one."""

    def __init__(self, coordinates: list[int]):
        self.rank = {y: i + 1 for i, y in enumerate(sorted(set(coordinates)))}
        self.best = [(-1e18, -1)] * (len(self.rank) + 1)

    def put(self, y: int, item: tuple[float, int]) -> None:
        i = self.rank[y]
        while i < len(self.best):
            if item > self.best[i]:
                self.best[i] = item
            i += i & -i

    def upto(self, y: int) -> tuple[float, int]:
        i, found = self.rank[y], (-1e18, -1)
        while i:
            if self.best[i] > found:
                found = self.best[i]
            i -= i & -i
        return found


def chains(parts: list[tuple[int, int, int]]) -> list[list[tuple[int, int, int]]]:
    """Disjoint collinear chains of segments, the best first."""
    if len(parts) == 1:
        return [parts]
    ends = [b + e - a for a, e, b in parts]
    tree = PrefixBest([b for _, _, b in parts] + ends)
    events = sorted([(a, 1, i) for i, (a, _, _) in enumerate(parts)] + [(e, 0, i) for i, (_, e, _) in enumerate(parts)])
    score, before = [0.0] * len(parts), [-1] * len(parts)
    for x, opens, i in events:
        a, e, b = parts[i]
        if opens:
            best, j = tree.upto(b)
            gain = best - GAP_COST * (x + b)
            score[i] = e - a + max(0.0, gain)
            before[i] = j if gain > 0 else -1
        else:
            tree.put(ends[i], (score[i] + GAP_COST * (x + ends[i]), i))
    used, out = set(), []
    for i in sorted(range(len(parts)), key=lambda i: (-score[i], i)):
        chain = []
        while i >= 0 and i not in used:
            used.add(i)
            chain.append(parts[i])
            i = before[i]
        if chain:
            out.append(chain[::-1])
    return out


def run_length(x: np.ndarray, y: np.ndarray) -> int:
    """Words at the front that agree."""
    n, done, step = min(len(x), len(y)), 0, 64
    while done < n:
        unlike = x[done : done + step][: n - done] != y[done : done + step][: n - done]
        if unlike.any():
            return done + int(unlike.argmax())
        done, step = done + step, 2 * step
    return n


def without_nested(parts: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """Segments, by start, without those that another one on the same diagonal covers."""
    out, reach = [], {}
    for a, end, b in sorted(parts, key=lambda p: (p[0], -p[1])):
        if end > reach.get(b - a, -1):
            out.append((a, end, b))
            reach[b - a] = end
    return out


def extend(x: np.ndarray, y: np.ndarray) -> tuple[int, int, int]:
    """(words of x, words of y, words that agree) of a greedy alignment from the front.

    An edit of one or two words goes on if AFTER_EDIT words agree behind it.
    """
    i = j = same = 0
    while True:
        n = run_length(x[i:], y[j:])
        i, j, same = i + n, j + n, same + n
        for di, dj in ((1, 1), (1, 0), (0, 1), (2, 2), (2, 1), (1, 2), (2, 0), (0, 2)):
            a, b = x[i + di : i + di + AFTER_EDIT], y[j + dj : j + dj + AFTER_EDIT]
            if len(a) == len(b) == AFTER_EDIT and (a == b).all():
                i, j = i + di, j + dj
                break
        else:
            return i, j, same


def common_words(x: np.ndarray, y: np.ndarray) -> int:
    """Words that agree in the best alignment of two gaps, row by row of the shorter one."""
    if len(x) > len(y):
        x, y = y, x
    if not len(x):
        return 0
    row = np.zeros(len(y) + 1, np.int32)
    for w in x[np.isin(x, y)]:
        step = row.copy()
        np.maximum(step[1:], row[:-1] + (y == w), out=step[1:])
        row = np.maximum.accumulate(step)
    return int(row[-1])


def align(chain: list[tuple[int, int, int]], x: np.ndarray, y: np.ndarray) -> tuple[int, int, int, int, int]:
    """(start, end, start in y, end in y, words that agree) of a chain, extended at both ends."""
    a, end, b = chain[0]
    left = extend(x[:a][::-1], y[:b][::-1])
    start, other, same = a - left[0], b - left[1], left[2]
    i, j = a, b
    for a, end, b in chain:
        same += common_words(x[i:a], y[j:b])
        n = end - a
        same += int((x[a:end] == y[b : b + n]).sum())
        i, j = end, b + n
    right = extend(x[i:], y[j:])
    return start, i + right[0], other, j + right[1], same + right[2]


def exact_blocks(chain: list[tuple[int, int, int]], x: np.ndarray, y: np.ndarray) -> list[tuple[int, int, int]]:
    """The runs of agreeing words in the segments of a chain."""
    out = []
    for a, end, b in chain:
        same = np.zeros(end - a + 2, np.int8)
        same[1:-1] = x[a:end] == y[b : b + end - a]
        edges = np.flatnonzero(np.diff(same)).tolist()
        out += [(a + s, a + e, b + s) for s, e in zip(edges[::2], edges[1::2], strict=True)]
    return out


def sub_chains(chain: list[tuple[int, int, int]], x: np.ndarray, y: np.ndarray, k: int, similarity: float) -> list[tuple[int, int, int, int, int]]:
    """Alignments of the maximal parts of a chain that agree enough, cut at mismatches or gaps, of k words at least."""
    blocks = exact_blocks(chain, x, y)
    if not blocks:
        return []
    a, end, b = np.array(blocks).T
    other = b + end - a
    between = [common_words(x[end[i] : a[i + 1]], y[other[i] : b[i + 1]]) for i in range(len(blocks) - 1)]
    # words that agree before each block
    before = np.concatenate(([0], np.cumsum(end[:-1] - a[:-1] + np.array(between, np.int64))))
    found, reach = [], -1
    for i in range(len(blocks)):
        size = np.maximum(end[i:] - a[i], other[i:] - b[i])
        same = before[i:] - before[i] + end[i:] - a[i:]
        good = np.flatnonzero((same >= similarity * size) & (size >= k))
        if len(good) and i + good[-1] > reach:
            reach = i + int(good[-1])
            piece = align(blocks[i : reach + 1], x, y)
            if piece[4] < similarity * max(piece[1] - piece[0], piece[3] - piece[2]):
                piece = (int(a[i]), int(end[reach]), int(b[i]), int(other[reach]), int(same[good[-1]]))
            found.append(piece)
    return found


def anchors(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Places (in x, in y) of the runs of ANCHOR words that each of two documents holds exactly once."""
    powers, sides = Powers(WORD_BASE), []
    for words in (x, y):
        at = np.arange(len(words) - ANCHOR + 1)
        value, first, count = np.unique(span_hashes(words, at, at + ANCHOR, powers), return_index=True, return_counts=True)
        sides.append((value[count == 1], first[count == 1]))
    (a, at), (b, other) = sides
    _, i, j = np.intersect1d(a, b, assume_unique=True, return_indices=True)
    return np.stack([at[i], other[j]], axis=1)


def pieces_of(matches: np.ndarray, x: np.ndarray, y: np.ndarray, k: int, similarity: float) -> list[tuple[int, int, int, int, int]]:
    """Alignments of two documents with enough agreeing words, by start; of nested ones the outer.

    Seeds bring two documents together; between them shorter words runs that
    occur once in both are matched too, so that a chain goes on through edits.
    """
    found = []
    parts = segments(matches[:, 0], matches[:, 1], k)
    if min(len(x), len(y)) >= ANCHOR and len(close := anchors(x, y)):
        parts = without_nested(sorted({*parts, *segments(close[:, 0], close[:, 1], ANCHOR)}))
    for chain in chains(parts):
        if any(s <= chain[0][0] and chain[-1][1] <= e for s, e, *_ in found):
            continue
        piece = align(chain, x, y)
        if piece[4] < similarity * max(piece[1] - piece[0], piece[3] - piece[2]):
            # the ends may run on beyond the segments
            (a, _, b), (_, end, at) = chain[0], chain[-1]
            left, right = run_length(x[:a][::-1], y[:b][::-1]), run_length(x[end:], y[at + end - chain[-1][0] :])
            edge = [(a - left, a, b - left)] if left else []
            tail = [(end, end + right, at + end - chain[-1][0])] if right else []
            found += sub_chains([*edge, *chain, *tail], x, y, k, similarity)
            for part in chain if len(chain) > 1 else []:  # one that its extension lifts over the threshold as a whole
                piece = align([part], x, y)
                if piece[4] >= similarity * max(piece[1] - piece[0], piece[3] - piece[2]):
                    found.append(piece)
            continue
        found.append(piece)
    return sorted(set(found))


def repeated_passages(docs: DataFrame, least_words: int = 50, similarity: float = 0.8, k: int = 8, window: int = 12) -> DataFrame:
    """Passages of at least least_words words that an earlier document holds too.

    docs: (doc_id, text, ...).  Words are runs of other bytes than ASCII white
    space, as they stand.  Returns doc_id, text_hash (xxhash64 of the text that
    holds the passage), start_word, end_word (word offsets, half open),
    kept_doc_id, kept_text_hash and kept_start (the place in a document with a
    smaller doc_id, which keeps the passage), similarity (agreeing words by the
    longer side) and n_pieces.

    Each piece has at least least_words words, of which a single kept document
    holds ``similarity``; pieces that overlap are united to one passage, with
    the place of the longest and the lowest similarity.  A shared run of
    k + window - 1 exact words always gives a seed; edited passages are found
    if a seed outlives the edits.

    Null doc_id or text and texts under least_words have no passages.  Rows
    with equal doc_id and text count once; different texts of one doc_id are
    searched each by itself, and what they share with each other doesn't count,
    nor do repeats inside one text.  An empty table gives an empty result;
    other columns are ignored.
    """
    texts = distinct_texts(docs)
    all_seeds = written(seeds(texts, k, window, least_words))
    held = written(all_seeds.join(first_holders(all_seeds, "seed"), "seed"))
    found = matches_with_first(held, "seed")
    linked = held.withColumnRenamed("first", "seed_first").where("link is not null")
    linked = written(linked.join(first_holders(linked, "link"), "link").where("first <> seed_first").drop("seed", "seed_first"))
    found = found.unionByName(matches_with_first(linked, "link"))

    def compare(matches: np.ndarray, x: np.ndarray, y: np.ndarray) -> list[tuple[int, int, int, float]]:
        pieces = pieces_of(matches, x, y, k, similarity)
        return [(s, e, t, same / max(e - s, u - t)) for s, e, t, u, same in pieces if e - s >= least_words]

    return passages_of(found, texts, compare)


def cut_passages(docs: DataFrame, passages: DataFrame) -> DataFrame:
    """docs without the given word spans; n_chars, where there is one, is the new length.

    passages: (doc_id, text_hash, start_word, end_word).  White space between
    the words that stay is kept as it is, that behind a cut word goes with it.
    A document of which nothing but white space stays is left out.  Documents
    without passages, null ids and null texts stay as they are.
    """
    spans = passages.groupBy(F.col("doc_id").alias("id__"), F.col("text_hash").alias("hash__")).agg(F.sort_array(F.collect_list(F.struct(F.col("start_word").cast("int").alias("s"), F.col("end_word").cast("int").alias("e")))).alias("spans__"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in parts_of(batches):
            out, stays = [], []
            for text, spans in zip(batch.column("text").cast(pa.binary()), batch.column("spans__"), strict=True):
                data = text.as_py()
                if data is None or not spans.is_valid:
                    out.append(data)
                    stays.append(True)
                    continue
                starts, _ = word_spans(np.frombuffer(data, np.uint8))
                edges = np.append(starts, len(data))
                kept, at = [], 0
                for span in spans.as_py():
                    kept.append(data[at : edges[min(span["s"], len(starts))]])
                    at = max(at, int(edges[min(span["e"], len(starts))]))
                out.append(b"".join(kept) + data[at:])
                stays.append(len(word_spans(np.frombuffer(out[-1], np.uint8))[0]) > 0)
            columns = [pa.array(out, pa.binary()).cast(pa.string()) if n == "text" else c for n, c in zip(batch.schema.names[:-1], batch.columns, strict=False)]
            columns.append(pc.is_valid(batch.column("spans__")))
            yield pa.record_batch(columns, [*batch.schema.names[:-1], "cut__"]).filter(pa.array(stays))

    cut = docs.join(spans, (docs["doc_id"] == F.col("id__")) & (F.xxhash64(docs["text"]) == F.col("hash__")), "left").select(*docs.columns, "spans__")
    after = cut.mapInArrow(run, T.StructType([*docs.schema.fields, T.StructField("cut__", T.BooleanType())]))
    if "n_chars" in docs.columns:
        after = after.withColumn("n_chars", F.when(F.col("cut__"), F.length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars")))
    return after.drop("cut__")
