import re

import numpy as np
import pytest
import xxhash

from ambulo.llm.components import connected_components
from ambulo.llm.simhash import Forest, fingerprint, link_in_shard, near_duplicates, route, top_tree

SCHEMA = "doc_id long, text string, fp string, component_id string, root int"


def slow_fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def slow_components(rows, radius=4):
    """rows: (doc_id, fp) -> doc_id -> smallest reachable doc_id."""
    fps = sorted({fp for _, fp in rows})
    parent = {fp: fp for fp in fps}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, a in enumerate(fps):
        for b in fps[:i]:
            if (a ^ b).bit_count() <= radius:
                parent[find(a)] = find(b)
    least = {}
    for doc, fp in rows:
        r = find(fp)
        least[r] = min(least.get(r, doc), doc)
    return {doc: least[find(fp)] for doc, fp in rows}


@pytest.mark.parametrize("text", ["", " \t\n", "One", "a b c", "a b c d", "A b\x0bC\x0cd e", "Ünïcode ÄB straße ß x y", "nbsp word x two three four five", "q " * 300])
def test_fingerprint(text):
    assert fingerprint(text.encode()) == slow_fingerprint(text)


def clustered(n, seed=3):
    """Random fingerprints with chains, a dense ball and exact repeats."""
    rng = np.random.default_rng(seed)
    base = rng.integers(0, 2**63, n, dtype=np.uint64)
    flip = lambda x, k: x ^ np.bitwise_or.reduce(np.uint64(1) << rng.choice(64, k, replace=False).astype(np.uint64))
    near = [flip(x, int(rng.integers(1, 7))) for x in base[: n // 2]]
    ball = [flip(base[0], int(rng.integers(1, 3))) for _ in range(n // 4)]
    return np.unique(np.concatenate([base, np.array(near), np.array(ball)]))


def test_links_equal_brute_force():
    fps = clustered(900)
    everyone = np.arange(len(fps))
    forest = link_in_shard(fps, everyone, everyone, 4, leaf=16)
    truth = Forest(len(fps))
    a, b = np.nonzero(np.bitwise_count(fps[:, None] ^ fps[None, :]) <= 4)
    truth.unite(a, b)
    assert (forest.find(everyone) == truth.find(everyone)).all()


def test_every_close_pair_meets_in_a_shard():
    fps = clustered(600, seed=5)
    vantage, sphere = top_tree(fps[::3], 4, 4)
    index, shard, home = route(fps, vantage, sphere, 4)
    assert (np.sort(index[home]) == np.arange(len(fps))).all()
    at_home = np.empty(len(fps), int)
    at_home[index[home]] = shard[home]
    visits = set(zip(index.tolist(), shard.tolist(), strict=True))
    a, b = np.nonzero(np.bitwise_count(fps[:, None] ^ fps[None, :]) <= 4)
    for i, j in zip(a.tolist(), b.tolist(), strict=True):
        assert (i, at_home[j]) in visits or (j, at_home[i]) in visits


def test_components_of_chains_hubs_and_loops(spark):
    edges = [(i, i + 1) for i in range(60)] + [(1000, i) for i in range(1001, 1040)] + [(7, 7), (5000, 5000), (None, 3), (2000, 60)]
    found = {r.node: r.root for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert found == {i: 0 for i in [*range(61), 2000]} | {i: 1000 for i in range(1000, 1040)}
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_operator_equals_brute_force(spark):
    table = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    odd = [(9001, None), (9002, ""), (9003, "\t"), (9004, "One"), (9004, "One"), (9005, "word " * 40_000)]
    docs = table.unionByName(spark.createDataFrame(odd, "doc_id long, text string"))
    found = near_duplicates(docs).collect()
    rows = [(r.doc_id, slow_fingerprint(r.text)) for r in docs.collect()]
    assert sorted((r.doc_id, r.fp % 2**64) for r in found) == sorted(rows)
    truth = slow_components(rows)
    assert all(r.component_id == truth[r.doc_id] for r in found)
    assert len(set(truth.values())) < len(truth)


def test_shards_and_query_blocks_change_nothing(spark, monkeypatch):
    from ambulo.llm import simhash

    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    links = simhash.fingerprint_links
    plain = {r.doc_id: r.component_id for r in near_duplicates(docs).collect()}
    monkeypatch.setattr(simhash, "fingerprint_links", lambda p, radius: links(p, radius, shard_size=16, block=20))
    assert {r.doc_id: r.component_id for r in near_duplicates(docs).collect()} == plain


def test_nulls_empty_tables_and_clashing_names(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert near_duplicates(empty).collect() == []
    docs = spark.createDataFrame([(None, None, "x", "y", 1), (None, "a b c d", "x", "y", 2), (4, "", "x", "y", 3), (2, None, None, None, None)], SCHEMA)
    found = sorted(((r.doc_id, r.fp == 0, r.component_id) for r in near_duplicates(docs).collect()), key=str)
    assert found == sorted([(None, True, 2), (None, False, None), (4, True, 2), (2, True, 2)], key=str)
