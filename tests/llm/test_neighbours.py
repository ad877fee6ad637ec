from __future__ import annotations

import numpy as np
import pytest

from voxtally.llm import neighbours


def frame(spark, ids, vectors):
    return spark.createDataFrame([(None if i is None else int(i), v, 0) for i, v in zip(ids, vectors, strict=True)], "vec_id long, embedding array<float>, score int")


@pytest.mark.parametrize("settings", [{}, {"block": 100, "query_block": 7}])
def test_recall_and_exact_scores(spark, settings):
    rng = np.random.default_rng(0)
    vectors = rng.normal(size=(700, 16)).astype(np.float32)
    df = frame(spark, range(700), vectors.tolist())
    got = neighbours.neighbours(df, df.where("vec_id % 20 = 0"), "vec_id", "embedding", **settings).toPandas()
    exact = vectors.astype(float) @ vectors.astype(float).T
    hits = 0
    for q in range(0, 700, 20):
        mine = got[got.query_id == q].sort_values("rank")
        score = exact[q].copy()
        score[q] = -np.inf
        hits += len(set(np.argsort(-score)[:20]) & set(mine.vec_id))
        assert mine["rank"].tolist() == list(range(1, 21))
        assert np.allclose(mine.score, exact[q][mine.vec_id], atol=1e-12)
        assert mine.score.is_monotonic_decreasing
    assert hits / (35 * 20) >= 0.9


@pytest.mark.parametrize("sigma", [0.0, 0.25, 0.5, 1.0])
@pytest.mark.parametrize("settings", [{}, {"block": 512}, {"exact": True, "pool": 1.0}])
def test_recall_at_even_and_uneven_lengths(spark, sigma, settings):
    rng = np.random.default_rng(1)
    vectors = rng.normal(size=(3000, 64))
    vectors *= rng.lognormal(0, sigma, size=(3000, 1)) / np.linalg.norm(vectors, axis=1, keepdims=True)
    df = frame(spark, range(3000), vectors.tolist())
    got = neighbours.neighbours(df, df.where("vec_id % 20 = 0"), "vec_id", "embedding", **settings).toPandas()
    exact = vectors.astype(np.float32).astype(float) @ vectors.astype(np.float32).astype(float).T
    hits = 0
    for q in range(0, 3000, 20):
        score = exact[q].copy()
        score[q] = -np.inf
        hits += len(set(np.argsort(-score)[:20]) & set(got[got.query_id == q].vec_id))
    assert hits == 150 * 20 if "exact" in settings else hits >= 0.9 * 150 * 20


def test_ties_go_to_smaller_ids_and_bad_vectors_take_no_part(spark):
    same = [1.0, 2.0]
    rows = [(i, same) for i in range(60)] + [(100, None), (101, [0.0, 0.0]), (102, [None, 1.0]), (103, [float("nan"), 1.0]), (104, [float("inf"), 1.0]), (None, same), (105, [1.0]), (7, same)]
    df = frame(spark, *zip(*rows, strict=True))
    got = neighbours.neighbours(df, df.where("vec_id in (20, 101, 103)"), "vec_id", "embedding", k=5, block=16).orderBy("rank").collect()
    assert [(r["query_id"], r["vec_id"], r["score"]) for r in got] == [(20, i, 5.0) for i in range(5)]


def test_fewer_candidates_than_asked_and_empty_table(spark):
    df = frame(spark, [1, 2, 3], [[1.0, 0.0], [0.5, 0.0], [-1.0, 0.0]])
    got = neighbours.neighbours(df, df.where("vec_id = 1"), "vec_id", "embedding").orderBy("rank").collect()
    assert [(r["rank"], r["vec_id"]) for r in got] == [(1, 2), (2, 3)]
    assert neighbours.neighbours(df.limit(0), df.limit(0), "vec_id", "embedding").count() == 0
    assert neighbours.neighbours(df, df.limit(0), "vec_id", "embedding").count() == 0


@pytest.mark.parametrize("window", [1, 2, 3, 9])
def test_footrule_within_a_window(window):
    orders = np.array([[0, 1, 2], [2, 1, 0], [3, 4, 5], [0, 3, 1]], dtype=np.int16)
    files = neighbours.InvertedFiles(orders, 6)
    for query in [*orders, np.array([1, 5], dtype=np.int16)]:
        want = []
        for row in orders.tolist():
            apart = [abs(at - row.index(p)) if p in row else window for at, p in enumerate(query.tolist())]
            want.append(sum(min(window, d) for d in apart))
        assert files.footrule(query, window).tolist() == want


def test_alike_lengths_are_dealt_into_blocks(spark):
    rows = spark.range(1000).selectExpr("id", "if(id < 900, 1.0D, id / 100.0D) as square")
    sizes = [r["count"] for r in neighbours.length_blocks(rows, 1000, 100).groupBy("at").count().collect()]
    assert sum(sizes) == 1000 and max(sizes) < 150
