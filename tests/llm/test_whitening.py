from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from voxtally.llm import whitening

SCHEMA = "vec_id long, embedding array<double>"


def frame(spark, vectors, first=0):
    rows = [(first + i, [float(c) for c in v]) for i, v in enumerate(vectors)]
    return spark.createDataFrame(rows, SCHEMA)


def expected(vectors):
    """x, n, S, eigenvalues and eigenvectors of the distinct grid vectors' covariance."""
    x = np.floor(64 * np.asarray(vectors, dtype=float)).astype(np.int64) + 1_000_000
    fit = np.unique(x, axis=0)
    n, sums = len(fit), fit.sum(0)
    values, directions = np.linalg.eigh(np.atleast_2d(np.cov((fit - sums / n).T, bias=True)))
    return x, n, sums, values[::-1], directions[:, ::-1]


@pytest.mark.parametrize(("rows", "width"), [(400, 24), (300, 5)])
def test_whitened_rows_are_those_of_numpy(spark, rows, width):
    rng = np.random.default_rng(rows)
    vectors = rng.normal(size=(rows, width)) @ np.diag(np.linspace(0.2, 30, width)) @ rng.normal(size=(width, width))
    vectors = np.concatenate([vectors, vectors[:1].repeat(200, 0), vectors[5:30] + 1e-9])
    x, n, sums, values, directions = expected(vectors)
    got = whitening.whiten(frame(spark, vectors)).toPandas().sort_values(["vec_id", "component"])
    k = min(16, width)
    assert len(got) == len(vectors) * k and (got.n == n).all()
    mine = got.whitened.to_numpy().reshape(-1, k)
    want = ((x - sums / n) @ directions[:, :k]) / np.sqrt(values[:k])
    want *= np.sign((want * mine).sum(0))
    assert np.abs(mine - want).max() < 1e-7
    share = got.explained.to_numpy().reshape(-1, k)
    assert np.allclose(share, values[:k] / values.sum(), rtol=1e-9)
    exact = [sum((n * int(c) - int(s)) ** 2 for c, s in zip(row, sums, strict=True)) for row in x]
    assert got.deviation.to_numpy().reshape(-1, k)[:, 0].tolist() == exact
    assert 0 <= got.identity_error.iloc[0] < 1e-10 and got.identity_error.nunique() == 1


def test_narrow_and_wide_spreads_stay_exact(spark):
    rng = np.random.default_rng(4)
    vectors = rng.normal(size=(500, 6)) * [1e6, 1e4, 1e2, 1, 1, 0.1]
    _, n, _, values, _ = expected(vectors)
    got = whitening.whiten(frame(spark, vectors))
    share = {r["component"]: r["explained"] for r in got.select("component", "explained").distinct().collect()}
    assert np.allclose([share[k] for k in range(1, 7)], values / values.sum(), rtol=1e-4)
    assert got.first()["identity_error"] < 1e-8


def test_flat_directions_have_no_whitened_value(spark):
    rng = np.random.default_rng(2)
    base = rng.normal(size=(60, 2)) * 10
    vectors = np.column_stack([base, base[:, 0], np.full(60, 3.0)])
    got = whitening.whiten(frame(spark, vectors)).toPandas()
    assert got[got.component <= 2].whitened.notna().all()
    assert got[got.component > 2].whitened.isna().all()
    assert (got[got.component > 2].explained == 0).all()
    assert got.identity_error.max() < 1e-10
    same = whitening.whiten(frame(spark, [[1.0, 2.0]] * 5)).toPandas()
    assert len(same) == 10 and same.whitened.isna().all() and same.explained.isna().all() and (same.deviation == 0).all() and (same.n == 1).all()


def test_odd_vectors(spark):
    fine = [[1.0, 2.0], [2.0, 1.0], [0.5, 0.25]]
    rows = [(i, v) for i, v in enumerate(fine)] + [(9, None), (10, []), (11, [1.0]), (12, [None, 1.0]), (13, [float("nan"), 1.0]), (14, [float("inf"), 1.0]), (None, fine[0]), (1, fine[1])]
    df = spark.createDataFrame(rows, SCHEMA)
    for name in ("x", "id", "n", "component", "whitened", "part", "cell"):
        df = df.withColumn(name, F.lit("clash"))
    got = whitening.whiten(df).toPandas()
    assert sorted(got.vec_id.fillna(-1)) == [-1, -1, 0, 0, 1, 1, 1, 1, 2, 2]
    assert (got.n == 3).all()
    assert whitening.whiten(df.limit(0)).count() == 0
    assert whitening.whiten(df.where("vec_id in (9, 10)")).count() == 0
    huge = whitening.whiten(spark.createDataFrame([(1, [1e300, 0.0]), (2, [-1e300, 1.0])], SCHEMA)).toPandas()
    assert len(huge) == 4 and huge.deviation.isna().all()


def test_differences_are_exact_beyond_64_bits():
    x = np.array([[1 << 40, 3], [-(1 << 40), 4]], dtype=np.int64)
    n, sums = 1 << 30, [(1 << 30) * 7 + 1, -5]
    assert whitening.deviations(x, n, sums).tolist() == [[n * int(a) - s for a, s in zip(row, sums, strict=True)] for row in x]
