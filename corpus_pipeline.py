"""A training corpus from the documents table, in five stages.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is
written as Parquet and read again as the next one's docs.  All but the last
return the columns of docs.  Null doc_ids, repeated ids and repeated rows go
through every stage; only the near-duplicate stage drops copies.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ambulo.llm import decontamination, languages, mixing, simhash, substrings
from ambulo.llm.common import cut_lineage, remove, remove_written, shared_folder, small, tables_written, written

#: Score from which a predicted language counts.
LEAST_SCORE = 0.5

#: SQL for run()'s rows: the stages train models and align texts, which SQL can't express.
ORACLE_SQL = None


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep texts whose language can be told: predicted with a score of LEAST_SCORE; a null lang becomes the prediction."""
    told = languages.with_language(docs, languages.fit(docs), ("pred__", "score__")).where((F.col("pred__") != "und") & (F.col("score__") >= LEAST_SCORE))
    return told.withColumn("lang", F.coalesce("lang", "pred__")).select(*docs.columns)


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one document of each group of near copies (shingles of five words, similarity 0.8).

    It is the one with the smallest doc_id, of its texts the one with the
    smallest hash; of rows equal in both the first by the other columns.  Null
    doc_ids come last.
    """
    groups = simhash.similar_documents(docs).select(F.col("first_id").alias("id__"), F.col("first_hash").alias("hash__")).distinct()
    text_hash = F.xxhash64(docs["text"])
    kept = docs.join(groups, docs["doc_id"].eqNullSafe(F.col("id__")) & (text_hash == F.col("hash__")))
    others = [F.col(c) for c in docs.columns if c not in ("doc_id", "text")]
    by_row = Window.partitionBy("id__", "hash__").orderBy(*(others or ["id__"]))
    return kept.withColumn("rank__", F.row_number().over(by_row)).where("rank__ = 1").select(*docs.columns)


def without_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cut passages that an earlier document holds too."""
    return substrings.cut_passages(docs, written(substrings.repeated_passages(docs)))


def without_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents that hold a benchmark item; all rows of such a doc_id, null being an id like any other."""
    benchmark = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    leaks = small(cut_lineage(decontamination.decontaminate(docs, benchmark).select(F.col("doc_id").alias("id__")).distinct()))
    return docs.join(leaks, docs["doc_id"].eqNullSafe(F.col("id__")), "left_anti")


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The words that a mix to the sources' targets takes of each document."""
    return mixing.mix_report(docs)


STAGES = [
    ("language", known_language),
    ("near-duplicates", one_of_each_group),
    ("substrings", without_repeats),
    ("decontamination", without_leaks),
    ("mixing", mixed),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents table, each written to the shared folder and read again.

    Tables that a stage made on the way and the folders of earlier stages are removed.
    """
    folder = f"{shared_folder(spark)}/corpus-{uuid.uuid4().hex}"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (_, stage) in enumerate(STAGES):
        before = tables_written()
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{i}")
        remove_written(spark, before)
        docs = spark.read.parquet(f"{folder}/{i}")
        if i:
            remove(spark, f"{folder}/{i - 1}")
    return docs
