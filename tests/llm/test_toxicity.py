from __future__ import annotations

import random
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from voxtally.llm import toxicity


def corpus(n=1500):
    rng = random.Random(1)
    rows, labels = [], []
    for i in range(n):
        words = [f"w{min(int(rng.expovariate(0.02)), 400)}" for _ in range(rng.randrange(5, 120))]
        toxic = rng.random() < 0.15
        if toxic:
            for _ in range(3):
                words.insert(rng.randrange(len(words)), rng.choice(["vile", "Filthy,", "rotten!"]))
        rows.append((i, " ".join(words)))
        if rng.random() < 0.6:
            labels.append((i, 1, int(toxic)))
    return rows, labels


def test_held_out_accuracy(spark, documents):
    rows, labels = corpus()
    known = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    got = toxicity.classify(documents(rows), known).toPandas()
    assert len(got) == len(rows)
    assert got.score.between(0, 1).all()
    assert (got.predicted == (got.score >= 0.5)).all()
    assert (got.held_out == got.doc_id.map(lambda i: zlib.crc32(str(i).encode()) % 5 == 0)).all()
    test = got[got.held_out].merge(known.toPandas(), on="doc_id")
    assert (test.predicted == test.toxic).mean() > 0.95


def test_scores_do_not_read_held_out_labels(spark, documents):
    rows, labels = corpus(600)
    flipped = [(i, q, 1 - t if zlib.crc32(str(i).encode()) % 5 == 0 else t) for i, q, t in labels]
    schema = "doc_id long, quality int, toxic int"
    a = toxicity.fit(documents(rows), spark.createDataFrame(labels, schema))
    b = toxicity.fit(documents(rows), spark.createDataFrame(flipped, schema))
    assert (a.buckets == b.buckets).all()
    assert np.array_equal(a.weights, b.weights)


def test_odd_rows_and_no_labels(spark, documents, odd_rows):
    none = spark.createDataFrame([(1, 1, None), (None, 0, 1)], "doc_id long, quality int, toxic int")
    got = toxicity.classify(documents(odd_rows), none)
    assert got.count() == len(odd_rows)
    assert got.where("score is null or score < 0 or score > 1").count() == 0
    assert toxicity.classify(documents(odd_rows).where(F.lit(False)), none).count() == 0


def test_word_sets_do_not_depend_on_neighbours():
    texts = ["One, two; two", "", None, "two one"]
    buckets, sizes = toxicity.word_sets(pa.array(texts, pa.string()))
    assert sizes.tolist() == [2, 0, 0, 2]
    assert buckets[:2].tolist() == buckets[2:].tolist()
