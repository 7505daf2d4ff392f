import random
import re
from collections import Counter

from ambulo.llm.decontamination import decontaminate

DOCS, ITEMS = "doc_id long, text string, item_id string, w int, s int", "item_id long, text string, doc_id int, m int"


def slow(docs, items, width=5, least=0.8):
    """Best similarity of any item-sized window, for each document and item that reach ``least``."""
    words = lambda t: re.findall(r"[^\W_]+", (t or "").lower())
    grams = lambda w, k: [tuple(w[i : i + k]) for i in range(len(w) - k + 1)]
    out = {}
    for item_id, item in items:
        w = words(item)
        k = min(width, len(w))
        if not w:
            continue
        own, n = Counter(grams(w, k)), len(w) - k + 1
        for doc_id, text in docs:
            g = grams(words(text), k)
            if not set(g) & set(own):
                continue
            for i in range(max(1, len(g) - n + 1)):
                there = Counter(g[i : i + n])
                sim = sum((own & there).values()) / sum((own | there).values())
                if sim >= least:
                    out[doc_id, item_id] = max(sim, out.get((doc_id, item_id), 0))
    return out


def test_equals_brute_force_over_all_windows(spark):
    docs, items = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "benchmark"))
    found = {(r.doc_id, r.item_id): r.similarity for r in decontaminate(docs, items).collect()}
    truth = slow([(r.doc_id, r.text) for r in docs.collect()], [tuple(r) for r in items.collect()])
    assert found.keys() == truth.keys() and len(found) > 5
    assert all(abs(found[k] - truth[k]) < 1e-9 for k in truth)


def test_edited_items(spark):
    rng = random.Random(8)
    prose = lambda n: ["".join(rng.choice("abcdefghijkl") for _ in range(rng.randint(3, 8))) for _ in range(n)]
    items, docs = [], []
    for i in range(12):
        item = prose(rng.randint(12, 80))
        items.append((i, " ".join(item), 1, 1))
        for j in range(6):
            body = item[:]
            for _ in range(j):
                at = rng.randrange(len(body))
                body[at : at + 1] = rng.choice([[], prose(1), [body[at], *prose(1)]])
            docs.append((i * 10 + j, " ".join(prose(40) + body + prose(30)).upper(), "x", 1, 1))
    found = {(r.doc_id, r.item_id): r.similarity for r in decontaminate(spark.createDataFrame(docs, DOCS), spark.createDataFrame(items, ITEMS)).collect()}
    truth = slow([d[:2] for d in docs], [x[:2] for x in items])
    assert found.keys() == truth.keys()


def test_edges(spark):
    docs = spark.createDataFrame([(1, None, "", 0, 0), (2, "", "", 0, 0), (3, "Yes, sir!", "", 0, 0), (4, "one two three four five", "", 0, 0), (4, "one two three four five", "", 0, 0), (None, "a one two three four five", "", 0, 0), (6, "la " * 30_000, "", 0, 0)], DOCS)
    items = spark.createDataFrame([(1, "yes SIR", 0, 0), (2, None, 0, 0), (3, "?!", 0, 0), (4, "one two three four five", 0, 0), (5, "one two three four five", 0, 0), (None, "sir", 0, 0), (7, "la la la la la la la la", 0, 0)], ITEMS)
    found = {(r.doc_id, r.item_id, r.start_word, r.n_words) for r in decontaminate(docs, items).collect()}
    assert found == {(3, 1, 0, 2), (3, None, 1, 1), (4, 4, 0, 5), (4, 5, 0, 5), (None, 4, 1, 5), (None, 5, 1, 5), (6, 7, 0, 8)}
    assert decontaminate(docs.limit(0), items).collect() == [] and decontaminate(docs, items.limit(0)).collect() == []


def test_many_groups_of_items_give_the_same(spark, monkeypatch):
    from ambulo.llm import decontamination

    docs, items = (spark.read.parquet(f"/root/testdata/sf0.001/{t}.parquet") for t in ("documents", "benchmark"))
    whole = sorted(map(tuple, decontaminate(docs, items).collect()))
    monkeypatch.setattr(decontamination, "SHINGLES_AT_ONCE", 4000)
    assert sorted(map(tuple, decontaminate(docs, items).collect())) == whole and whole


def test_counts_of_repeated_values(spark):
    from pyspark.sql import functions as F

    from ambulo.llm.decontamination import common_count

    rng, rows = random.Random(3), []
    for _ in range(200):
        a, b = ([rng.randint(0, rng.choice([3, 40])) for _ in range(rng.randint(0, 30))] for _ in range(2))
        rows.append((a, b, sum((Counter(a) & Counter(b)).values())))
    df = spark.createDataFrame(rows, "a array<long>, b array<long>, n int")
    assert df.where(common_count("a", "b") != F.col("n")).count() == 0
