from pyspark.sql import functions as F

import corpus_pipeline
from ambulo.llm import decontamination, languages, mixing, simhash, substrings

FOLDER = "/root/testdata/sf0.001"


def test_each_stage_applies_its_operator(spark, tmp_path):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    columns, before = docs.columns, docs
    for i, (name, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, before, FOLDER).write.parquet(str(tmp_path / str(i)))
        after = spark.read.parquet(str(tmp_path / str(i)))
        old, new = {r.doc_id: r for r in before.collect()}, {r.doc_id: r for r in after.collect()}
        assert after.count() == len(new)
        if name != "mixing":
            assert after.columns == columns
        if name == "language":
            told = {r.doc_id: r.lang_pred for r in languages.identify(before).where("lang_pred <> 'und' and score >= 0.5").collect()}
            assert new.keys() == told.keys() and len(new) > 0.95 * len(old)
            assert all(r.lang == (old[k].lang or told[k]) for k, r in new.items())
        if name == "near-duplicates":
            groups = {}
            for r in simhash.similar_documents(before).collect():
                groups.setdefault(r.first_id, set()).add(r.doc_id)
            assert all(g & new.keys() == {first} for first, g in groups.items()) and len(new) < len(old)
        if name == "substrings":
            hit = {r.doc_id for r in substrings.repeated_passages(before).collect()}
            assert {k for k in old if k not in new or new[k].text != old[k].text} == hit
            assert all(new[k].n_chars == len(new[k].text) for k in hit & new.keys())
        if name == "decontamination":
            leaks = {r.doc_id for r in decontamination.decontaminate(before, spark.read.parquet(f"{FOLDER}/benchmark.parquet")).collect()}
            assert new.keys() == old.keys() - leaks
        if name == "mixing":
            assert new == {r.doc_id: r for r in mixing.mix_report(before).collect()}
        before = after


def test_run_equals_the_stages(spark):
    assert corpus_pipeline.run(spark, FOLDER).columns == ["doc_id", "size", "source_size", "target", "taken", "slots", "first_slot"]
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language", "near-duplicates", "substrings", "decontamination", "mixing"]


def test_stages_take_nulls_repeated_ids_and_empty_tables(spark, tmp_path):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    texts = [r.text for r in docs.where("length(text) > 600").orderBy("doc_id").limit(3).collect()]
    rows = [(None, texts[0], None), (None, None, None), (1, texts[1], None), (1, texts[1], "x"), (1, "", None), (2, texts[1] + " " + texts[2], "en"), (2, texts[2], None)]
    odd = spark.createDataFrame(rows, "doc_id long, text string, lang string").selectExpr("doc_id", "text", "lang", "'s' AS source", "CAST(length(text) AS BIGINT) AS n_chars")
    clashing = [F.lit(i).alias(n) for i, n in enumerate(("score", "lang_pred", "text_hash", "node", "item_id", "size", "start", "seed", "label"))]
    for start in (docs.unionByName(odd).select("*", *clashing), docs.limit(0)):
        now = start
        for name, stage in corpus_pipeline.STAGES:
            folder = str(tmp_path / f"{name}{start is now}{id(start)}")
            stage(spark, now, FOLDER).write.parquet(folder)
            now = spark.read.parquet(folder)
            if name == "language":
                assert now.where("lang is null").count() == 0
                assert now.where("doc_id is null").count() == (start.where("doc_id is null and text is not null").count())
            if name == "near-duplicates":
                assert now.groupBy("doc_id", "text").count().where("count > 1").count() == 0
        assert now.count() <= start.count()
