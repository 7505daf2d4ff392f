"""Language identification in two steps: the family, then pairs within it.

Hashed character n-grams (bytes of the lower-cased UTF-8 text) of a whole text
make a normalised frequency vector.  Linear support vector machines, one
against the rest, choose the language family; one-versus-one machines then
decide between the languages of that family by votes.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ambulo.llm.labelled import held_out, label_sample

#: Families of some languages (ISO 639-1).  A language that isn't listed is a family of its own.
FAMILIES = {
    "germanic": "en de nl sv da no nb nn is af fy lb yi".split(),
    "romance": "fr es it pt ro ca gl oc la".split(),
    "slavic": "ru uk be pl cs sk bg sr hr sl mk bs".split(),
    "uralic": "fi et hu".split(),
    "turkic": "tr az kk uz".split(),
}
FAMILY_OF = {code: family for family, codes in FAMILIES.items() for code in codes}
BITS = 12


def features(text: bytes, bits: int = BITS) -> np.ndarray | None:
    """Unit vector of the square roots of n-gram counts (n = 1 to 3); None without a letter.

    Only letters count, as lower case; any other characters become one space,
    so that digits, marks and layout have no say.
    """
    line = text.decode("utf-8", "replace").lower()
    if line.isascii():
        data = np.frombuffer(line.encode(), np.uint8)
        letter = (data >= 97) & (data <= 122)
    else:
        line = "".join(c if c.isalpha() else " " for c in line)
        data = np.frombuffer(line.encode(), np.uint8)
        letter = data != 32
    if not letter.any():
        return None
    keep = letter.copy()
    keep[1:] |= letter[:-1]
    data = np.where(letter, data, 32).astype(np.uint32)[keep]
    data = np.concatenate([np.array([32], np.uint32), data])
    counts = np.zeros(1 << bits, np.float32)
    gram = np.zeros(len(data), np.uint32)
    for n in range(1, 4):
        gram = gram[: len(data) - n + 1] * np.uint32(256) + data[n - 1 :]
        slot = ((gram + np.uint32(n << 24)) * np.uint32(0x9E3779B1)) >> np.uint32(32 - bits)
        counts += np.bincount(slot, minlength=1 << bits)
    counts = np.sqrt(counts)
    return counts / np.linalg.norm(counts)


def train_svm(x: np.ndarray, y: np.ndarray, epochs: int = 12, rate: float = 0.1, shrink: float = 1e-4) -> tuple[np.ndarray, float]:
    """Linear support vector machine for y in {-1, 1} by averaged subgradient steps on the hinge loss.

    Both classes weigh the same whatever their counts; the order is fixed.
    """
    w, b = np.zeros(x.shape[1], np.float32), 0.0
    total, bias, steps = np.zeros_like(w), 0.0, 0
    weight = np.where(y > 0, len(y) / (2 * max(1, (y > 0).sum())), len(y) / (2 * max(1, (y < 0).sum())))
    order = np.random.default_rng(7)
    for epoch in range(epochs):
        for batch in np.array_split(order.permutation(len(y)), max(1, len(y) // 16)):
            step = 16 * rate / np.sqrt(1 + epoch)
            wrong = (x[batch] @ w + b) * y[batch] < 1
            push = (y[batch] * weight[batch] * wrong).astype(np.float32) / len(batch)
            w = (1 - step * shrink) * w + step * (push @ x[batch])
            b += step * 0.1 * float(push.sum())
            total, bias, steps = total + w, bias + b, steps + 1
    return total / steps, bias / steps


@dataclass
class LanguageModel:
    languages: list[str]
    families: list[str]
    family_w: np.ndarray
    family_b: np.ndarray
    pairs: dict[str, list[tuple[int, int, int]]]  # family -> (language, other language, row of pair_w)
    pair_w: np.ndarray
    pair_b: np.ndarray

    def predict(self, x: np.ndarray) -> tuple[str, float]:
        """Language and a score from 0 to 1: the product of the squashed margins."""
        margins = self.family_w @ x + self.family_b
        k = int(np.argmax(margins))
        family = self.families[k]
        rest = np.delete(margins, k)
        score = squash(float(margins[k] - rest.max()) if len(rest) else 4.0)
        inside = [i for i, code in enumerate(self.languages) if FAMILY_OF.get(code, code) == family]
        votes, least = {i: (0, 0.0) for i in inside}, {i: np.inf for i in inside}
        for i, j, row in self.pairs.get(family, ()):
            m = float(self.pair_w[row] @ x + self.pair_b[row])
            for lang, own in ((i, m), (j, -m)):
                votes[lang] = (votes[lang][0] + (own > 0), votes[lang][1] + own)
                least[lang] = min(least[lang], own)
        best = max(inside, key=lambda i: (votes[i], -i))
        return self.languages[best], score * (squash(2 * least[best]) if np.isfinite(least[best]) else 1.0)


def squash(margin: float) -> float:
    return float(1 / (1 + np.exp(-2 * np.clip(margin, -20, 20))))


def train(languages_of: list[str], x: np.ndarray) -> LanguageModel | None:
    """Fit all machines on the languages and feature vectors of a sample; None without any."""
    if not languages_of:
        return None
    labels = np.array(languages_of)
    languages = sorted(set(labels.tolist()))
    family = np.array([FAMILY_OF.get(c, c) for c in labels])
    families = sorted(set(family.tolist()))
    one_against_rest = [train_svm(x, np.where(family == f, 1.0, -1.0)) for f in families] if len(families) > 1 else [(np.zeros(x.shape[1], np.float32), 0.0)]
    pairs: dict[str, list[tuple[int, int, int]]] = {}
    machines = []
    for f in families:
        for a, b in combinations([c for c in languages if FAMILY_OF.get(c, c) == f], 2):
            rows = (labels == a) | (labels == b)
            pairs.setdefault(f, []).append((languages.index(a), languages.index(b), len(machines)))
            machines.append(train_svm(x[rows], np.where(labels[rows] == a, 1.0, -1.0)))
    machines = machines or [(np.zeros(x.shape[1], np.float32), 0.0)]
    stack = lambda m: (np.stack([w for w, _ in m]), np.array([b for _, b in m], np.float32))
    return LanguageModel(languages, families, *stack(one_against_rest), pairs, *stack(machines))


def fit(docs: DataFrame, per_language: int = 500, most_rows: int = 10_000) -> LanguageModel | None:
    """Learn from at most per_language rows of each language, most_rows in all, that aren't held out."""
    labelled = docs.where(~held_out("doc_id", 4, 2) & F.col("text").isNotNull()).select("doc_id", F.col("lang").cast("string").alias("label"), "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, 256):
                part = batch.slice(i, 256)
                rows = [(a, x) for a, t in zip(part.column(0).to_pylist(), part.column(1).cast(pa.binary()), strict=True) if (x := features(t.as_py())) is not None]
                yield pa.record_batch([pa.array([a for a, _ in rows], pa.string()), pa.array([x.astype(np.float16).tobytes() for _, x in rows], pa.binary())], ["label", "x"])

    rows = label_sample(labelled, per_language, most_rows).select("label", "text").mapInArrow(run, "label string, x binary").collect()
    if not rows:
        return None
    rows.sort(key=lambda r: (r.label, r.x))
    x = np.frombuffer(b"".join(r.x for r in rows), np.float16).reshape(len(rows), -1).astype(np.float32)
    return train([r.label for r in rows], x)


def identify(docs: DataFrame, model: LanguageModel | None = None, per_language: int = 500, most_rows: int = 10_000) -> DataFrame:
    """Predict the language of every whole text of docs (doc_id, text, lang, ...).

    Returns doc_id, held_out, lang_pred and score.  lang_pred is ``und`` with
    score 0 where the text is null or has no letter, or nothing could be
    learned.  Only the text enters a prediction.  The model, if none is given,
    comes from at most per_language rows of each language, and most_rows in
    all, whose crc32(doc_id) mod 4 isn't 2; a null doc_id isn't held out.  Repeated rows
    get equal predictions; an empty table an empty result; other columns are
    ignored.
    """
    model = model or fit(docs, per_language, most_rows)
    return with_language(docs.select(F.col("doc_id").cast("long"), held_out("doc_id", 4, 2).alias("held_out"), "text"), model).drop("text")


def with_language(docs: DataFrame, model: LanguageModel | None, names: tuple[str, str] = ("lang_pred", "score")) -> DataFrame:
    """docs with the prediction and its score for each row's text in two columns behind their own, whose names must be new."""
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for text in batch.column(at).cast(pa.binary()):
                x = features(text.as_py()) if model and text.is_valid else None
                out.append(("und", 0.0) if x is None else model.predict(x))
            langs, scores = zip(*out, strict=True) if out else ((), ())
            yield pa.record_batch([*batch.columns, pa.array(langs, pa.string()), pa.array(scores, pa.float64())], [*batch.schema.names, *names])

    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, T.StructField(names[0], T.StringType()), T.StructField(names[1], T.DoubleType())]))
