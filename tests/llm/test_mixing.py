from collections import defaultdict

import pytest

from ambulo.llm.mixing import mix, mix_report, source_targets
from pyspark.sql import functions as F

SCHEMA = "doc_id long, text string, source string, size string, place int"


def slow_targets(sizes):
    """sizes: source -> words; shares are handed out again until none is above its most."""
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: i % 3 + 1 for i, s in enumerate(order)}
    target, left, free = {}, float(sum(sizes.values())), set(order)
    while free:
        level = left / sum(weight[s] for s in free)
        over = {s for s in free if level * weight[s] > 3 * sizes[s]}
        if not over:
            target |= {s: level * weight[s] for s in free}
            break
        target |= {s: 3.0 * sizes[s] for s in over}
        left -= sum(3 * sizes[s] for s in over)
        free -= over
    return target


@pytest.mark.parametrize("sizes", [{"a": 100, "b": 100, "c": 100}, {"a": 1000, "b": 1, "c": 2, None: 3}, {"z": 5}, {"a": 0, "b": 9}, {f"s{i}": i * i for i in range(40)} | {"é": 3, "Z": 10_000}])
def test_targets_equal_repeated_sharing(spark, sizes):
    rows = spark.createDataFrame([(s, n) for s, n in sizes.items()], "source string, size long")
    found = {r.source: r.target for r in source_targets(rows).collect()}
    assert found == pytest.approx(slow_targets(sizes))


def test_mix_of_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = mix_report(docs).join(docs.select("doc_id", "source", "text"), "doc_id").collect()
    assert len(rows) == docs.count()
    taken, sizes, target = defaultdict(int), defaultdict(int), {}
    for r in rows:
        assert r.size == len([w for w in r.text.replace("\xa0", "x").translate({i: " " for i in (9, 10, 11, 12, 13)}).split(" ") if w])
        assert 0 <= r.taken <= 3 * r.size
        taken[r.source] += r.taken
        sizes[r.source] += r.size
        target[r.source] = r.target
    assert target == pytest.approx(slow_targets(sizes))
    assert all(abs(taken[s] - target[s]) <= 0.5 for s in taken)
    assert all(r.source_size == sizes[r.source] for r in rows)
    again = {r.doc_id: r.taken for r in mix_report(docs.repartition(7)).collect()}
    assert again == {r.doc_id: r.taken for r in rows}


def test_slots_interleave_sources_evenly(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    _, pieces = mix(docs, slot_words=4)
    rows = pieces.groupBy("slot").agg(F.first("place").alias("place"), F.count_distinct("place").alias("n"), F.sum("words").alias("words")).orderBy("slot").collect()
    assert all(r.n == 1 for r in rows)
    half = rows[: len(rows) // 2]
    for place in {r.place for r in rows}:
        whole = sum(r.words for r in rows if r.place == place)
        assert sum(r.words for r in half if r.place == place) == pytest.approx(whole / 2, rel=0.02, abs=40)


def test_nulls_empty_tables_and_repeated_rows(spark):
    assert mix_report(spark.createDataFrame([], SCHEMA)).collect() == []
    rows = [(1, None, "a", "s", 1), (2, "", "a", "s", 1), (3, " \t\x0b", None, "s", 1)]
    assert {(r.doc_id, r.size, r.taken, r.target) for r in mix_report(spark.createDataFrame(rows, SCHEMA)).collect()} == {(1, 0, 0, 0.0), (2, 0, 0, 0.0), (3, 0, 0, 0.0)}
    rows += [(None, "x y z", None, "", 0), (5, "p q", "b", "", 0), (5, "p q", "b", "", 0), (6, "w " * 30_000, "c", "", 0), (6, "\xa0  ", "b", "", 0)]
    found = mix_report(spark.createDataFrame(rows, SCHEMA)).collect()
    assert len(found) == len(rows) and all(0 <= r.taken <= 3 * r.size for r in found)
    assert {r.doc_id: r.size for r in found if r.doc_id != 6} == {1: 0, 2: 0, 3: 0, None: 3, 5: 2}
    assert sum(r.taken for r in found) == pytest.approx(sum(r.size for r in found), abs=2)
