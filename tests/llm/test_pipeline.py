from __future__ import annotations

import corpus_pipeline

from voxtally.llm.queries import ORACLES, QUERIES

TINY = "/root/testdata/sf0.001"


def test_one_query_for_each_operator():
    for n in range(1, 14):
        assert sum(name.startswith(f"op{n}_") for name in QUERIES) == 1
    assert set(ORACLES) <= set(QUERIES)


def test_stages_keep_the_columns_and_take_effect(spark):
    docs = spark.read.parquet(f"{TINY}/documents.parquet")
    columns = docs.columns
    counts = [docs.count()]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = corpus_pipeline.settle(stage(spark, docs, TINY), name)
        assert docs.columns == columns
        assert docs.where("n_chars <> length(text)").count() == 0
        counts.append(docs.count())
    assert counts[2] == counts[1]
    assert counts[4] == counts[3]
    assert counts[0] >= counts[1] > 0
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, TINY)
    assert packed.select("doc_id").distinct().count() == docs.select("doc_id").distinct().count()


def test_run_is_the_stages_one_after_the_other(spark):
    docs = spark.read.parquet(f"{TINY}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES:
        docs = corpus_pipeline.settle(stage(spark, docs, TINY), name)
    assert sorted(map(tuple, docs.collect())) == sorted(map(tuple, corpus_pipeline.run(spark, TINY).collect()))


def test_odd_documents_pass_through(spark, documents, odd_rows):
    docs = documents(odd_rows, extra=())
    for name, stage in corpus_pipeline.STAGES:
        docs = corpus_pipeline.settle(stage(spark, docs, TINY), name)
    assert docs.where("doc_id = 2").count() == 1


def test_an_empty_table_and_clashing_columns_pass_through(documents, spark, odd_rows):
    empty = documents([(1, "x")], extra=()).limit(0)
    for name, stage in corpus_pipeline.STAGES[1:]:
        empty = corpus_pipeline.settle(stage(spark, empty, TINY), name)
    assert empty.count() == 0
    docs = documents(odd_rows)
    columns = docs.columns
    for name, stage in corpus_pipeline.STAGES[1:]:
        docs = corpus_pipeline.settle(stage(spark, docs, TINY), name)
        assert name == "best_fit_packing" or docs.columns == columns
    assert docs.where("doc_id = 2").count() == 1


def test_very_long_texts_pass_through(documents, spark):
    rows = [(1, "w" * 1_500_000), (2, " " * 1_500_000), (3, "\n" * 300_000), (4, " ".join(f"word{k}" for k in range(200_000))), (5, "short text of a few words")]
    docs = documents(rows, extra=())
    for name, stage in corpus_pipeline.STAGES[1:]:
        docs = corpus_pipeline.settle(stage(spark, docs, TINY), name)
    assert docs.select("doc_id").distinct().count() >= 3
