"""Quality scores from supervised subword embeddings.

Every word and every character n-gram inside the words (3 to 5 bytes, with
edge marks) has a learned vector, found by hash.  A document is the mean of its
vectors; a softmax layer gives the class.  Vectors and layer are trained
together by stochastic gradient descent in numpy.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ambulo.llm.common import BYTE_BASE, Powers, byte_rows, span_hashes, word_spans
from ambulo.llm.labelled import held_out, label_sample

BITS = 15
GRAMS = (3, 4, 5)


def slots(text: bytes, powers: Powers, bits: int = BITS) -> np.ndarray:
    """Hash slots of all words and of the n-grams within them, repeats included."""
    data = np.frombuffer(b" " + text + b" ", np.uint8)
    starts, ends = word_spans(data)
    if not len(starts):
        return np.zeros(0, np.int64)
    found = [span_hashes(data, starts, ends, powers)]
    plain = np.where((data < 9) | ((data > 13) & (data != 32)), data, 32).astype(np.uint64)
    gap = np.concatenate(([0], np.cumsum(plain == 32)))
    for n in GRAMS:
        if len(data) < n:
            continue
        gram = np.full(len(data) - n + 1, n, np.uint64)
        for i in range(n):
            gram = gram * np.uint64(257) + plain[i : len(plain) - n + 1 + i]
        # white space may stand at the edges only
        inner = gap[n - 1 : len(data)] - gap[1 : len(data) - n + 2] == 0
        found.append(gram[inner] * np.uint64(0xD6E8FEB86659FD93))
    return (np.concatenate(found) >> np.uint64(64 - bits)).astype(np.int64)


@dataclass
class QualityModel:
    vectors: np.ndarray  # slot, dimension
    layer: np.ndarray  # class, dimension
    bias: np.ndarray

    def per_slot(self) -> np.ndarray:
        """What one slot adds to the difference of the two class scores."""
        return self.vectors @ (self.layer[1] - self.layer[0])


def train(rows: list[tuple[int, np.ndarray, np.ndarray]], dim: int = 12, epochs: int = 8, rate: float = 0.5, bits: int = BITS) -> QualityModel:
    """Fit on (label, slots, counts) rows; both classes weigh the same in all."""
    order = np.random.default_rng(11)
    model = QualityModel(order.uniform(-1 / dim, 1 / dim, (1 << bits, dim)).astype(np.float32), order.uniform(-0.5, 0.5, (2, dim)).astype(np.float32), np.zeros(2, np.float32))
    held = [max(1, sum(label == c for label, *_ in rows)) for c in (0, 1)]
    steps, at = epochs * max(1, len(rows)), 0
    for _ in range(epochs):
        for r in order.permutation(len(rows)):
            label, slot, count = rows[r]
            at += 1
            if not len(slot):
                continue
            share = (count / count.sum()).astype(np.float32)
            hidden = share @ model.vectors[slot]
            z = model.layer @ hidden + model.bias
            p = np.exp(z - z.max())
            p /= p.sum()
            error = -p
            error[label] += 1
            error *= rate * (1 - at / steps) * min(5.0, len(rows) / (2 * held[label]))
            back = error @ model.layer
            model.layer += np.outer(error, hidden)
            model.bias += 0.1 * error
            # the mean's gradient is spread by share; scaled up so that frequent words move in a few epochs
            model.vectors[slot] += np.outer(np.sqrt(share), back).astype(np.float32)
    return model


def fit(docs: DataFrame, labels: DataFrame, per_label: int = 1000) -> QualityModel | None:
    """Learn from at most per_label documents of each label that aren't held out."""
    marks = labels.where("doc_id is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.min("quality").alias("label")).where("label in (0, 1)")
    marks = label_sample(marks.where(~held_out("doc_id", 3, 1)), per_label, 2 * per_label)
    # at most two labels' samples: rows of a proven bound
    labelled = docs.select(F.col("doc_id").cast("long"), "text").join(F.broadcast(marks), "doc_id").select("label", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        powers = Powers(BYTE_BASE)
        for batch in batches:
            for i in range(0, batch.num_rows, 64):
                part = batch.slice(i, 64)
                rows = [np.unique(slots(t, powers), return_counts=True) for t in byte_rows(part, 1)]
                yield pa.record_batch([part.column(0).cast(pa.int32()), pa.array([a.astype(np.uint16).tobytes() for a, _ in rows], pa.binary()), pa.array([b.astype(np.int32).tobytes() for _, b in rows], pa.binary())], ["label", "slot", "n"])

    rows = labelled.mapInArrow(run, "label int, slot binary, n binary").collect()
    if not rows:
        return None
    rows.sort(key=lambda r: (r.label, r.slot, r.n))
    return train([(r.label, np.frombuffer(r.slot, np.uint16), np.frombuffer(r.n, np.int32)) for r in rows])


def score_quality(docs: DataFrame, labels: DataFrame, model: QualityModel | None = None, per_label: int = 1000) -> DataFrame:
    """Score every whole text of docs (doc_id, text, ...) as labels (doc_id, quality) mark it.

    Returns doc_id, held_out, score (0 to 1, higher: label 1 is likelier) and
    predicted (1 from score 0.5 on).  Only the text enters a score.  Null and
    empty texts get the score of no evidence, 0.5 if nothing was learned.  The
    model, if none is given, comes from at most per_label documents of each
    label whose crc32(doc_id) mod 3 isn't 1; other labels than 0 and 1 are
    ignored, a document with both counts as 0, a null doc_id isn't held out.
    Repeated rows get equal scores; an empty table an empty result; other
    columns are ignored.
    """
    model = model or fit(docs, labels, per_label)
    gain = model.per_slot().astype(np.float64) if model else np.zeros(1 << BITS)
    start = float(model.bias[1] - model.bias[0]) if model else 0.0

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        powers = Powers(BYTE_BASE)
        for batch in batches:
            scores = np.empty(batch.num_rows)
            for i, text in enumerate(byte_rows(batch, 2)):
                found = slots(text, powers)
                scores[i] = start + (gain[found].mean() if len(found) else 0.0)
            scores = 1 / (1 + np.exp(-np.clip(scores, -30, 30)))
            yield pa.record_batch([batch.column(0), batch.column(1), pa.array(scores), pa.array((scores >= 0.5).astype(np.int32))], ["doc_id", "held_out", "score", "predicted"])

    rows = docs.select(F.col("doc_id").cast("long"), held_out("doc_id", 3, 1).alias("held_out"), "text")
    return rows.mapInArrow(run, "doc_id long, held_out boolean, score double, predicted int")
