import random
import zlib

import pytest

from ambulo.llm.languages import identify
from ambulo.llm.quality import score_quality
from ambulo.llm.tokens import Counter, count_tokens, vocabulary

FOLDER = "/root/testdata/sf0.01"
PIECES = "/opt/tokenizers/piece_bpe_32k.model"


def test_language_held_out_accuracy(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    rows = identify(docs).join(docs.select("doc_id", "lang"), "doc_id").collect()
    assert len(rows) == docs.count()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in rows)
    held = [r for r in rows if r.held_out]
    assert sum(r.lang == r.lang_pred for r in held) >= 0.97 * len(held)
    assert all(0 <= r.score <= 1 for r in rows)


def test_language_edges(spark):
    schema = "doc_id long, text string, lang string, label string, score int, held_out string"
    assert identify(spark.createDataFrame([], schema)).collect() == []
    rows = [(i, f"{'the house is here and there' if i % 2 else 'la maison est ici et encore'} {i}", "en" if i % 2 else "fr", "x", 1, "y") for i in range(40)]
    rows += [(101, None, "en", "", 0, ""), (102, "", "fr", "", 0, ""), (103, "1234 !!", None, "", 0, ""), (None, "the house", None, "", 0, ""), (7, rows[7][1], "en", "x", 1, "y"), (104, "the house " * 50_000, "en", "", 0, "")]
    found = {r.doc_id: r for r in identify(spark.createDataFrame(rows, schema)).collect()}
    assert [found[i].lang_pred for i in (101, 102, 103, None, 7, 104)] == ["und", "und", "und", "en", "en", "en"]
    assert found[101].score == 0 and found[None].held_out is False
    nothing = identify(spark.createDataFrame([(1, "the house", None, "", 0, "")], schema)).collect()
    assert [(r.lang_pred, r.score) for r in nothing] == [("und", 0.0)]


def test_quality_held_out_accuracy(spark):
    docs, labels = (spark.read.parquet(f"{FOLDER}/{t}.parquet") for t in ("documents", "labels"))
    scored = score_quality(docs, labels)
    assert scored.count() == docs.count()
    held = scored.join(labels, "doc_id").where("held_out").collect()
    good = [r.predicted == r.quality for r in held]
    assert sum(good) >= 0.95 * len(good)
    bad = [r.predicted == 0 for r in held if r.quality == 0]
    assert bad and sum(bad) >= 0.9 * len(bad)


def test_quality_edges(spark):
    docs = spark.createDataFrame([(1, None, 5), (2, "", 5), (3, "some words", 5), (3, "some words", 5), (None, "x", 5), (4, "w" * 100_000, 5)], "doc_id long, text string, quality int")
    none = spark.createDataFrame([], "doc_id long, quality int, text string")
    rows = score_quality(docs, none).collect()
    assert len(rows) == 6 and all(r.score == 0.5 and r.predicted == 1 for r in rows)
    labels = spark.createDataFrame([(3, 1, ""), (4, 0, ""), (9, 1, ""), (None, 0, ""), (2, None, ""), (2, 7, "")], "doc_id long, quality int, text string")
    rows = score_quality(docs, labels).collect()
    assert len(rows) == 6 and all(0 <= r.score <= 1 for r in rows)
    assert score_quality(docs.limit(0), labels).collect() == []


@pytest.fixture(scope="module")
def reference():
    from tokenizers import Tokenizer, models, pre_tokenizers

    t = Tokenizer(models.Unigram(vocabulary(PIECES), 0, True))
    t.pre_tokenizer = pre_tokenizers.Metaspace("▁", "always", True)
    return t


def test_token_counts_equal_a_unigram_tokenizer(spark, reference):
    texts = [r.text for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()]
    texts += ["", " ", "   ", "a", " a", "a ", "a  b", "x\ny\tz", "日本語 and 𝄞𝄞 clefs", "☃", "ééé ﬁ", "aaaaaaaaaaaaaaaa", "<s> </s> <0x41>", "▁▁ x▁y", "\x00\x01", "🙂🙂🙂 zz"]
    counter = Counter(vocabulary(PIECES))
    wrong = [(t[:60], counter.text(t), len(reference.encode(t).tokens)) for t in texts if counter.text(t) != len(reference.encode(t).tokens)]
    assert not wrong


def test_ties_go_to_the_piece_that_starts_first():
    from tokenizers import Tokenizer, models

    pieces = [("<unk>", 0.0), ("▁", 0.0), ("a", -1.0), ("aa", -2.0), ("b", -1.0), ("aab", -3.0), ("ab", -2.0)]
    plain = Tokenizer(models.Unigram(pieces, 0, False))
    counter = Counter(pieces)
    for text in ("aab", "aaab", "abab", "aaaab", "ba", "c", "cca", "acc", "caac"):
        assert counter.word(text) == len(plain.encode(text).tokens), text


def test_token_edges(spark):
    docs = spark.createDataFrame([(1, None, 1), (2, "", 1), (None, "word", 1), (3, "word", 1), (3, "word", 1)], "doc_id long, text string, n_tokens int")
    found = count_tokens(docs, PIECES).collect()
    assert [(r.n_chars, r.n_tokens) for r in found[:2]] == [(0, 0), (0, 0)] and len(found) == 5
    assert len({r.n_tokens for r in found[2:]}) == 1
    assert count_tokens(docs.limit(0), PIECES).collect() == []


def test_many_labels_all_take_part(spark):
    from pyspark.sql import functions as F

    from ambulo.llm.labelled import label_sample

    rows = spark.range(9000).select(F.col("id").alias("doc_id"), F.concat(F.lit("l"), (F.col("id") % 300).cast("string")).alias("label"), F.lit("x").alias("text"))
    found = label_sample(rows, 20, 10_000).groupBy("label").count().collect()
    assert len(found) == 300 and {r["count"] for r in found} == {20}
    few = label_sample(rows, 20, 900).groupBy("label").count().collect()
    assert len(few) == 300 and {r["count"] for r in few} == {3}
    with pytest.raises(ValueError, match="300 labels"):
        label_sample(rows, 20, 299)
    # one id on a third of the rows, repeated rows, null labels and ids
    same = rows.withColumn("doc_id", F.when(F.col("doc_id") % 3 == 0, 7).otherwise(F.col("doc_id"))).withColumn("label", F.when(F.col("doc_id") % 50 != 0, F.lit("one")))
    assert label_sample(same.unionByName(same.withColumn("doc_id", F.lit(None).cast("long"))), 100, 1000).count() <= 100
    assert label_sample(rows.limit(0), 5, 10).count() == 0


def test_three_hundred_languages_can_be_learned(spark):
    from ambulo.llm.languages import identify

    rng = random.Random(5)
    rows = []
    for k in range(300):
        letters = rng.sample("abcdefghijklmnopqrstuvwxyz", 6)
        for j in range(6):
            rows.append((len(rows), " ".join("".join(rng.choice(letters) for _ in range(5)) for _ in range(60)), f"x{k:03d}"))
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    found = identify(docs, per_language=4).join(docs.select("doc_id", "lang"), "doc_id").collect()
    assert len({r.lang_pred for r in found}) > 280 and sum(r.lang_pred == r.lang for r in found) > 0.8 * len(found)
