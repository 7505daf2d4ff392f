import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from ambulo.llm.substrings import chains, common_words, cut_passages, repeated_passages
from ambulo.llm.suffixes import repeated_substrings

SCHEMA = "doc_id long, text string, seed string, pos string, matches int, n_chars long"


def prose(rng, n):
    return ["".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 7))) for _ in range(n)]


def planted(seed=1):
    """(rows, {doc_id: (start, end)} of passages held by an earlier document)."""
    rng = random.Random(seed)
    shared = {n: prose(rng, n) for n in (52, 70, 120)}
    rows, truth = [], {}
    for doc in range(60):
        words = prose(rng, rng.randint(60, 200))
        if doc % 3 == 0:
            passage = shared[(52, 70, 120)[doc // 3 % 3]]
            at = rng.randint(0, len(words))
            words[at:at] = passage
            if doc >= 9:
                truth[doc] = (at, at + len(passage))
        rows.append((doc, " ".join(words)))
    return rows, truth


def slow_exact(rows, least):
    """Word spans covered by runs of ``least`` words that a smaller doc_id holds."""
    seen, out = {}, {}
    for doc, text in sorted(rows):
        words = text.split()
        grams = [tuple(words[i : i + least]) for i in range(len(words) - least + 1)]
        hits = [i for i, g in enumerate(grams) if seen.get(g, doc) != doc]
        covered = sorted({j for i in hits for j in range(i, i + least)})
        if covered:
            out[doc] = covered
        for g in grams:
            seen.setdefault(g, doc)
    return out


def covered(found):
    out = {}
    for r in found:
        out.setdefault(r.doc_id, set()).update(range(r.start_word, r.end_word))
    return {k: sorted(v) for k, v in out.items()}


@pytest.mark.parametrize("operator", [repeated_passages, repeated_substrings])
def test_planted_passages(spark, operator):
    rows, truth = planted()
    found = operator(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r.doc_id for r in found} == set(truth)
    for r in found:
        start, end = truth[r.doc_id]
        assert abs(r.start_word - start) <= 4 and abs(r.end_word - end) <= 4
        assert r.kept_doc_id < r.doc_id


def test_exact_runs_equal_brute_force_on_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    found = covered(repeated_substrings(docs).collect())
    assert found == slow_exact([tuple(r) for r in docs.collect()], 50)
    assert found


def test_fuzzy_passages_cover_exact_ones(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    found = covered(repeated_passages(docs).collect())
    for doc, words in slow_exact([tuple(r) for r in docs.collect()], 51).items():
        assert set(words) <= set(found.get(doc, ()))


def test_edited_passage_is_found_and_clean_text_is_not(spark):
    rng = random.Random(4)
    passage = prose(rng, 120)
    edited = passage[:]
    edited[30], edited[75:76] = "CHANGED", ["two", "more"]
    del edited[100]
    rows = [(1, " ".join(prose(rng, 50) + passage)), (2, " ".join(prose(rng, 80) + edited + prose(rng, 40))), (3, " ".join(prose(rng, 300)))]
    found = repeated_passages(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert [(r.doc_id, r.kept_doc_id) for r in found] == [(2, 1)]
    assert abs(found[0].start_word - 80) <= 2 and abs(found[0].end_word - 200) <= 2 and 0.9 < found[0].similarity < 1


def test_many_holders_make_linear_rows(spark):
    rng = random.Random(9)
    passage = prose(rng, 60)
    rows = [(i, " ".join(prose(rng, 30) + passage)) for i in range(80)]
    for operator in (repeated_passages, repeated_substrings):
        found = operator(spark.createDataFrame(rows, "doc_id long, text string")).collect()
        assert sorted(r.doc_id for r in found) == list(range(1, 80))


def test_chain_prefers_collinear_segments():
    parts = [(0, 20, 0), (10, 18, 400), (25, 60, 26), (62, 80, 61)]
    best = chains(parts)[0]
    assert best == [(0, 20, 0), (25, 60, 26), (62, 80, 61)]


@pytest.mark.parametrize("operator", [repeated_passages, repeated_substrings])
def test_nulls_empty_tables_and_clashing_names(spark, operator):
    assert operator(spark.createDataFrame([], SCHEMA)).collect() == []
    words = " ".join(prose(random.Random(2), 60))
    same = "again " * 500
    rows = [(None, words, "s", "p", 1, 0), (1, words, "s", "p", 1, 0), (1, words, "s", "p", 1, 0), (2, None, "s", "p", 1, 0), (3, "", "s", "p", 1, 0), (4, "short text", None, None, None, None), (5, same, "s", "p", 1, 0), (6, same, "s", "p", 1, 0), (7, words + "\x0b" + words, "", "", 0, 0)]
    found = operator(spark.createDataFrame(rows, SCHEMA)).collect()
    assert {(r.doc_id, r.kept_doc_id) for r in found} == {(6, 5), (7, 1)}
    assert [(r.start_word, r.end_word) for r in found if r.doc_id == 6] == [(0, 500)]


def test_cutting(spark):
    docs = spark.createDataFrame([(1, "a  b\tc d e", "s", "p", 1, 9), (2, " x y ", "s", "p", 1, 5), (3, None, "", "", 0, None), (None, "q r", "", "", 0, 3), (4, "k l", "", "", 0, 3)], SCHEMA)
    spans = spark.createDataFrame([(1, 1, 2), (1, 3, 4), (2, 0, 2), (9, 0, 1)], "doc_id long, start_word int, end_word int")
    spans = spans.join(docs.select("doc_id", F.xxhash64("text").alias("text_hash")), "doc_id")
    found = {(r.doc_id, r.text, r.n_chars) for r in cut_passages(docs, spans).collect()}
    assert found == {(1, "a  c e", 6), (3, None, None), (None, "q r", 3), (4, "k l", 3)}


@pytest.mark.parametrize("operator", [repeated_passages, repeated_substrings])
@pytest.mark.parametrize("swapped", [False, True])
def test_two_texts_of_one_id(spark, operator, swapped):
    rng = random.Random(12)
    passage, long = prose(rng, 80), prose(rng, 400)
    rows = [(1, " ".join(passage)), (2, "short"), (2, " ".join(long + passage)), (2, " ".join(passage[5:])), (2, " ".join(passage[5:]))]
    rows = rows[::-1] if swapped else rows
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(2)
    found = operator(docs)
    spans = {(r.text, r.start_word, r.end_word, r.kept_doc_id) for r in found.join(docs.distinct().withColumn("text_hash", F.xxhash64("text")), ["doc_id", "text_hash"]).collect()}
    assert spans == {(" ".join(long + passage), 400, 480, 1), (" ".join(passage[5:]), 0, 75, 1)}
    left = cut_passages(docs, found).collect()
    assert sorted(r.text for r in left) == sorted([" ".join(passage), "short", " ".join(long) + " "])


def test_pieces_of_different_documents_are_no_passage(spark):
    rng = random.Random(13)
    phrases = [prose(rng, 20) for _ in range(4)]
    rows = [(i, " ".join(prose(rng, 60) + p + prose(rng, 40))) for i, p in enumerate(phrases)]
    rows.append((9, " ".join(prose(rng, 100) + sum(phrases, []) + prose(rng, 30))))
    assert repeated_passages(spark.createDataFrame(rows, "doc_id long, text string")).collect() == []


@pytest.mark.parametrize("between", [0, 3, 6])
def test_passage_of_two_frequent_lines_meets_the_text_that_joins_them(spark, between):
    rng = random.Random(14 + between)
    rows = []
    for _ in range(30):
        lines = [prose(rng, 30), prose(rng, 30)]
        own = prose(rng, between)
        rows += [(len(rows) + i, " ".join(prose(rng, 25) + line + prose(rng, 25))) for i, line in enumerate(lines)]
        rows += [(len(rows) + i, " ".join(prose(rng, 25) + lines[0] + own + lines[1] + prose(rng, 25))) for i in range(2)]
    found = repeated_passages(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert covered(found) == {i: list(range(25, 85 + between)) for i in range(3, 120, 4)}
    assert all(r.kept_doc_id == r.doc_id - 1 for r in found)


def test_gaps_of_any_size_are_aligned_alike():
    rng = np.random.default_rng(3)
    for size in (5, 200):
        x, y = rng.integers(0, 50, size), rng.integers(0, 50, size + 7)
        table = np.zeros((len(x) + 1, len(y) + 1), int)
        for i, a in enumerate(x):
            for j, b in enumerate(y):
                table[i + 1, j + 1] = table[i, j] + 1 if a == b else max(table[i, j + 1], table[i + 1, j])
        assert common_words(x, y) == common_words(y, x) == table[-1, -1]


@pytest.mark.parametrize("operator", [repeated_passages, repeated_substrings])
def test_many_rows_of_one_kept_document_are_dealt_out(spark, operator, monkeypatch):
    from ambulo.llm import passages

    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    copies = spark.createDataFrame([(1000 + i, " ".join(["own", str(i)] + [f"w{j}" for j in range(80)])) for i in range(40)], "doc_id long, text string")
    docs = docs.unionByName(copies)
    whole = sorted(map(tuple, operator(docs).collect()))
    monkeypatch.setattr(passages, "ROWS_AT_ONCE", 3)
    assert sorted(map(tuple, operator(docs).collect())) == whole and len(whole) >= 39


def test_tables_are_removed(spark):
    from pathlib import Path

    from ambulo.llm import common

    repeated_passages(spark.createDataFrame([(1, "a b")], "doc_id long, text string")).collect()
    left = [Path(p.removeprefix("file:")) for p in common._TABLES]
    assert left and all(p.exists() for p in left)
    common.remove_written(spark)
    assert not common._TABLES and not any(p.exists() for p in left)
