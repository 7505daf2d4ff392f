"""Connected components of an edge table by alternating star contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ambulo.llm.common import cut_lineage


def connected_components(edges: DataFrame) -> DataFrame:
    """Component of every node that an edge names.

    edges: (a long, b long), any direction, repeats and loops allowed; rows
    with a null end are ignored.  Returns (node long, root long) with the
    smallest node of the component as root, one row for each node that has an
    edge to another.  No edge: no row.

    Each round sends the larger neighbours of a node to its smallest one, then
    the smaller ones (after Kiveris et al., "Connected Components in MapReduce
    and Beyond").  Only minima are aggregated, and the fan-out is a join, so
    that a hub isn't gathered in one task.  Every round ends in a checkpoint.
    """
    star = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    star = cut_lineage(star.where("a <> b and a is not null and b is not null").distinct())
    while True:
        both = star.unionAll(star.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = large.where("a <> b").distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        small = small.unionAll(least.select("a", F.col("m").alias("b"))).where("a <> b").distinct()
        star = cut_lineage(small)
        inner = star.select(F.col("b").alias("a")).distinct().join(star, "a", "left_semi").limit(1).count()
        if not inner and not star.groupBy("a").count().where("count > 1").limit(1).count():
            return star.select(F.col("a").alias("node"), F.col("b").alias("root")).unionAll(
                star.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct()
            )
