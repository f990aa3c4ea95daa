from __future__ import annotations

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from emberlake.llm import pieces, queries


@pytest.fixture(scope="module")
def steps(spark):
    sf = "/root/testdata/sf0.001"
    docs, out = spark.read.parquet(f"{sf}/documents.parquet"), []
    for _, stage in corpus_pipeline.STAGES:
        out.append((docs, after := stage(spark, docs, sf).cache()))
        docs = after
    return out


def test_stages_are_the_five(steps):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality rules", "line dedup", "simhash near-dedup", "mixing sources", "sentencepiece encoding"]
    for before, after in steps[:-1]:
        assert after.columns == before.columns


def test_rejected_documents_go(spark, steps):
    before, after = steps[0]
    kept = queries.op7_quality_rules(spark, "/root/testdata/sf0.001").filter("kept").select("doc_id")
    assert sorted(after.select("doc_id").collect()) == sorted(kept.collect())
    assert 0 < after.count() < before.count()


def test_line_dedup_keeps_documents(steps):
    before, after = steps[1]
    assert sorted(before.select("doc_id").collect()) == sorted(after.select("doc_id").collect())
    assert after.filter("length(trim(text)) = 0").count() == 0
    assert after.filter(F.length("text") != F.col("n_chars")).count() == 0


def test_one_of_each_group_stays(steps):
    before, after = steps[2]
    assert after.count() == after.select("text").distinct().count()
    texts = before.groupBy("text").agg(F.min("doc_id").alias("doc_id"))
    assert after.join(texts, ["doc_id", "text"]).count() == after.count()


def test_mix_takes_its_share(steps):
    before, after = steps[3]
    tokens = lambda df: sum(len(r["text"].split()) for r in df.collect())
    assert 0.5 * tokens(before) < tokens(after) <= corpus_pipeline.SHARE * tokens(before)
    assert after.count() == after.select("doc_id").distinct().count()


def test_pieces_give_the_texts_back(steps):
    before, after = steps[4]
    back = {r["id"]: r["text"] for r in pieces.decode(after.withColumnRenamed("doc_id", "id")).collect()}
    assert back == {r["doc_id"]: r["text"] for r in before.collect()}
    assert after.filter(F.size("piece_ids") != F.col("n_pieces")).count() == 0
