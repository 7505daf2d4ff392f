"""Recall and precision of fuzzy passages against word-by-word alignment."""

import random

import pytest

from ambulo.llm.substrings import repeated_passages


def prose(rng, n):
    return ["".join(rng.choice("abcdefghij") for _ in range(rng.randint(3, 8))) for _ in range(n)]


def edited(rng, words, similarity):
    """words with so many of them replaced, left out or preceded by another that the share of words that stay is similarity."""
    out, hit = [], set(rng.sample(range(len(words)), round(len(words) * (1 - similarity))))
    for i, w in enumerate(words):
        kind = rng.random()
        if i not in hit:
            out.append(w)
        elif kind < 0.6:
            out += prose(rng, 1)
        elif kind < 0.8:
            out += [*prose(rng, 1), w]
    return out


def common(x, y):
    """Words of the longest common subsequence."""
    row = [0] * (len(y) + 1)
    for w in x:
        last = 0
        for j, v in enumerate(y):
            row[j + 1], last = (last + 1 if w == v else max(row[j], row[j + 1])), row[j + 1]
    return row[-1]


@pytest.mark.parametrize(("words", "similarity", "least"), [(60, 0.95, 0.98), (60, 0.9, 0.85), (100, 0.9, 0.97), (100, 0.85, 0.85), (200, 0.85, 0.97), (200, 0.82, 0.9)])
def test_recall_and_precision(spark, words, similarity, least):
    rng, rows, truth = random.Random(words), [], {}
    for i in range(80):
        passage = prose(rng, words)
        again = edited(rng, passage, similarity)
        front = prose(rng, rng.randint(5, 60))
        rows.append((2 * i, prose(rng, 40) + passage + prose(rng, 30)))
        rows.append((2 * i + 1, front + again + prose(rng, 30)))
        truth[2 * i + 1] = range(len(front), len(front) + len(again))
    texts = dict(rows)
    docs = spark.createDataFrame([(i, " ".join(w)) for i, w in rows], "doc_id long, text string")
    found = repeated_passages(docs).collect()
    hit = {r.doc_id for r in found if len(set(range(r.start_word, r.end_word)) & set(truth.get(r.doc_id, ()))) >= 0.5 * words}
    assert len(hit) >= least * len(truth)
    for r in found:
        mine, kept = texts[r.doc_id][r.start_word : r.end_word], texts[r.kept_doc_id]
        assert r.doc_id == r.kept_doc_id + 1 and len(mine) >= 50 and r.similarity >= 0.8
        # the kept place is that of the longest of the overlapping pieces that make up a passage
        kept = kept[r.kept_start :][: len(mine) * 5 // 4 + 1] if r.n_pieces == 1 else kept
        assert common(mine, kept) >= 0.8 * len(mine) - 1
