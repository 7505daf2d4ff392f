import random

import pytest
from test_passages import covered, prose, slow_exact

from ambulo.llm.suffixes import repeated_substrings


def around_frequent(rng, own, frequent, pairs, others):
    """Rows of which the last ``pairs`` repeat the first in a frequent run with own words on both sides, in other surroundings between."""
    line = prose(rng, frequent)
    shared = [prose(rng, own) + line + prose(rng, own) for _ in range(pairs)]
    texts = [*shared, *(prose(rng, own) + line + prose(rng, own) for _ in range(others)), *shared]
    return [(i, " ".join(prose(rng, rng.randint(5, 60)) + x + prose(rng, rng.randint(5, 60)))) for i, x in enumerate(texts)]


def test_passages_around_a_frequent_run_equal_brute_force(spark):
    rng, rows = random.Random(7), []
    for own, frequent in ((6, 40), (3, 45), (10, 40), (1, 49)):
        rows += [(len(rows) + i, text) for i, text in around_frequent(rng, own, frequent, 12, 20)]
    # a run of one word, longer in front of the passage than in the other document
    tail = prose(rng, 30)
    rows += [(len(rows) + i, " ".join(["again"] * n + tail)) for i, n in enumerate((90, 25))]
    found = covered(repeated_substrings(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert found == slow_exact(rows, 50)
    assert len(found) >= 49


@pytest.mark.parametrize("parts", ["2", "7", "200"])
def test_the_number_of_partitions_does_not_matter(spark, parts):
    rows = around_frequent(random.Random(3), 10, 40, 30, 60)
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    try:
        found = covered(repeated_substrings(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert found == slow_exact(rows, 50)
    assert set(found) >= set(range(90, 120))
