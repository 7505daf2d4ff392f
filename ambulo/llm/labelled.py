"""A bounded, repeatable sample of labelled documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ambulo.llm.common import cut_lineage


def held_out(doc_id: str, modulus: int, remainder: int) -> Column:
    """Whether crc32 of the id as text leaves the remainder; a null id counts as empty text."""
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")) % modulus == remainder


def label_sample(labelled: DataFrame, per_label: int, most_rows: int) -> DataFrame:
    """Rows of every label: those with the smallest hash of their id.

    labelled: (doc_id, label, ...).  Each label gets per_label rows, or its
    even share of most_rows if that is less: the two bound the result whatever
    the number of labels, and no label is left out.  More labels than most_rows
    are an error.  Null labels are left out.

    Hashes spread evenly, so rows below a bound by the label's count hold the
    smallest ones with some to spare; only these are sorted.  Where many rows
    share an id they may hold fewer rows than allowed, never more.
    """
    labelled = labelled.where("label is not null")
    counts = cut_lineage(labelled.groupBy("label").agg(F.count("*").alias("n__")))
    n = counts.count()
    if n > most_rows:
        raise ValueError(f"{n} labels, but at most {most_rows} rows to learn from")
    each = max(1, min(per_label, most_rows // max(1, n)))
    hashed = F.xxhash64("doc_id")
    # at most most_rows labels
    near = labelled.join(F.broadcast(counts), "label").where(F.shiftrightunsigned(hashed, 11) / F.lit(2.0**53) < (2 * each + 20) / F.col("n__")).drop("n__")
    by_hash = Window.partitionBy("label").orderBy(hashed, *[F.col(c) for c in labelled.columns if c != "label"])
    return near.withColumn("rank__", F.row_number().over(by_hash)).where(F.col("rank__") <= each).drop("rank__")
