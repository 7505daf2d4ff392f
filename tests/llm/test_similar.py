import random

import numpy as np
import pytest

import corpus_pipeline
from ambulo.llm import simhash
from ambulo.llm.simhash import fingerprint, similar_documents, sketch

SCHEMA = "doc_id long, text string, node string, first_id int, size string"


def prose(rng, n):
    return ["".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 7))) for _ in range(n)]


def shingles(words):
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))}


def similarity(a, b):
    x, y = shingles(a.split()), shingles(b.split())
    return len(x & y) / len(x | y)


def near_copies(seed=2, n=40, size=(80, 600)):
    """Rows of n texts, each followed by a copy with a few changed words."""
    rng, rows = random.Random(seed), []
    for i in range(n):
        words = prose(rng, rng.randint(*size))
        other = words[:]
        for at in rng.sample(range(len(words)), max(1, len(words) * (i % 4) // 100)):
            other[at] = "changed"
        rows += [(2 * i, " ".join(words)), (2 * i + 1, " ".join(other).upper())]
    return rows


def many_copies(n=60):
    """One text with another word changed in each copy."""
    words = prose(random.Random(6), 200)
    return [(1000 + i, " ".join([*words[:i], "changed", *words[i + 1 :]])) for i in range(n)]


def test_near_copies_are_one_group_and_others_are_not(spark):
    rows = near_copies()
    first = {r.doc_id: r.first_id for r in similar_documents(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    texts = dict(rows)
    for i in range(0, 80, 2):
        if similarity(texts[i], texts[i + 1].lower()) >= 0.83:
            assert first[i] == first[i + 1] == i
    assert all(first[i] == i for i in range(0, 80, 2))


def test_groups_follow_brute_force_on_documents(spark):
    table = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    rows = [(r.doc_id, (r.text or "").lower()) for r in table.collect()]
    first = {r.doc_id: r.first_id for r in similar_documents(table).collect()}
    sets = [shingles(t.split()) for _, t in rows]
    holders = {}
    for i, s in enumerate(sets):
        for g in s:
            holders.setdefault(g, []).append(i)
    pairs = {(a, b) for h in holders.values() for j, b in enumerate(h) for a in h[:j]}
    alike = {(a, b): len(sets[a] & sets[b]) / len(sets[a] | sets[b]) for a, b in pairs}
    close = [p for p, s in alike.items() if s >= 0.8]
    found = [first[rows[a][0]] == first[rows[b][0]] for a, b in close]
    assert len(close) > 20 and np.mean(found) >= 0.95
    groups = {}
    for i, (doc, _) in enumerate(rows):
        groups.setdefault(first[doc], []).append(i)
    # every member of a group is close to another one
    assert all(len(g) == 1 or max(len(sets[a] & sets[b]) / len(sets[a] | sets[b]) for b in g if b != a) >= 0.7 for g in groups.values() for a in g)


def test_shards_and_blocks_change_nothing(spark, monkeypatch):
    docs = spark.createDataFrame(near_copies(5, 120, (5, 200)) + many_copies(), "doc_id long, text string")
    plain = {r.doc_id: r.first_id for r in similar_documents(docs).collect()}
    links = simhash.sketch_links
    monkeypatch.setattr(simhash, "sketch_links", lambda n, s, r: links(n, s, r, shard_size=3))
    assert {r.doc_id: r.first_id for r in similar_documents(docs.repartition(3)).collect()} == plain
    assert all(plain[1000 + i] == 1000 for i in range(60))


def test_sketch_begins_with_the_fingerprint():
    text = ("one two three four five six " * 3000).encode()
    n, wide, least = sketch(text, 5)
    assert n == 17_996 and len(wide) == 64 and len(least) == 4 and int.from_bytes(wide[:8], "little") == fingerprint(text, 5)
    assert sketch(b" \t", 5) == (0, bytes(64), [0, 0, 0, 0])


def test_nulls_empty_tables_ties_and_clashing_names(spark):
    assert similar_documents(spark.createDataFrame([], SCHEMA)).collect() == []
    long = "word " * 40_000
    rows = [(None, None, "", 0, ""), (3, "", "", 0, ""), (5, "a b", "", 0, ""), (5, "a b", "", 0, ""), (4, "A B", "", 0, ""), (5, "c d", "", 0, ""), (None, "x y z", "", 0, ""), (7, long, "", 0, ""), (6, long, "", 0, "")]
    found = similar_documents(spark.createDataFrame(rows, SCHEMA)).collect()
    assert sorted((str(r.doc_id), str(r.first_id)) for r in found) == sorted([("None", "3"), ("3", "3"), ("5", "4"), ("5", "4"), ("4", "4"), ("5", "5"), ("None", "None"), ("7", "6"), ("6", "6")])


@pytest.mark.parametrize("parts", [1, 5])
def test_stage_keeps_one_row_of_each_group(spark, parts):
    schema = "doc_id long, text string, lang string"
    words = " ".join(prose(random.Random(1), 60))
    rows = [(1, words, "a"), (1, words, "a"), (1, words, "b"), (2, words, "c"), (1, "other text", "d"), (None, "own text of no id", "e"), (None, words, "f"), (3, None, "g"), (4, "", "h")]
    docs = spark.createDataFrame(rows, schema).repartition(parts)
    found = sorted(map(tuple, corpus_pipeline.one_of_each_group(spark, docs, "").collect()), key=str)
    assert found == sorted([(1, words, "a"), (1, "other text", "d"), (None, "own text of no id", "e"), (3, None, "g")], key=str)
