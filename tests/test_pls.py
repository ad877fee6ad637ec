"""Decompositions against numpy on one machine."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from voxtally.operators import pls as L
from voxtally.operators.stats import Matrix


def cases(spark, sizes=(9, 8, 7), n_x=5, n_y=2, seed=0):
    rng = np.random.default_rng(seed)
    n = sum(sizes)
    x = rng.normal(size=(n, n_x)) + 100
    x[: sizes[0]] += [3, 0, -2, 0, 1]
    y = x @ rng.normal(size=(n_x, n_y)) + rng.normal(size=(n, n_y))
    group = np.repeat(np.arange(len(sizes)), sizes)
    return group, x, y


def test_small_svd_matches_numpy(spark):
    m = np.random.default_rng(1).normal(size=(4, 30))
    rows = spark.createDataFrame([(r, f"f{c:02d}", float(v)) for (r, c), v in np.ndenumerate(m)], "row int, feature string, value double")
    singular, _, left = L.svd_small(rows, 4)
    found = {r["lv"]: r["singular_value"] for r in singular.collect()}
    expected = np.linalg.svd(m, compute_uv=False)
    assert [found[k] for k in sorted(found)] == pytest.approx(expected.tolist())
    vectors = left.toPandas()
    value = next(c for c in vectors.columns if c not in ("lv", "feature"))
    table = vectors.pivot(index="feature", columns="lv", values=value).to_numpy()
    assert np.allclose(table.T @ table, np.eye(4), atol=1e-8)


def test_mean_centred_pls_matches_numpy(spark):
    sizes = (9, 8, 7)
    group, x, _ = cases(spark, sizes)
    rows = spark.createDataFrame([(i, int(g), v.tolist()) for i, (g, v) in enumerate(zip(group, x))], "animal_id long, group int, x array<double>")
    matrix = Matrix(rows.withColumn("cond", F.col("group").cast("string")), [f"f{i}" for i in range(5)], ["a", "b", "c"], list(sizes))
    result = L.meancentered_pls(matrix, n_perm=0, n_boot=0, seed=1)
    means = np.array([x[group == g].mean(axis=0) for g in range(3)])
    centred = means - means.mean(axis=0)
    u, d, _ = np.linalg.svd(centred.T, full_matrices=False)
    weights = result["weights"].toPandas().pivot(index="acronym", columns="lv", values="weight").to_numpy()
    for k in range(2):
        assert abs(weights[:, k] @ u[:, k]) == pytest.approx(1, abs=1e-8)
    assert np.linalg.norm(centred) == pytest.approx(np.sqrt((d**2).sum()))


def test_full_rank_simpls_is_least_squares(spark):
    group, x, y = cases(spark)
    rows = spark.createDataFrame([(i, int(g), [*a, *b]) for i, (g, a, b) in enumerate(zip(group, x.tolist(), y.tolist()))], "animal_id long, group int, x array<double>")
    result = L.simpls(rows, [f"f{i}" for i in range(5)], ["p", "q"], 5)
    mse = result["mse"].toPandas()
    xc, yc = x - x.mean(0), y - y.mean(0)
    fit = xc @ np.linalg.lstsq(xc, yc, rcond=None)[0]
    want = ((yc - fit) ** 2).sum() / len(x)
    start = (yc**2).sum() / len(x)
    column = [c for c in mse.columns if "y" in c.lower() and mse[c].dtype == float][0]
    values = mse.sort_values(mse.columns[0])[column].tolist()
    assert values[0] == pytest.approx(start, rel=1e-6)
    assert values[-1] == pytest.approx(want, rel=1e-6)
    assert values == sorted(values, reverse=True)
