"""Group statistics, resampling and decompositions against numpy on one machine."""

from __future__ import annotations

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from voxtally.functions import draws, special
from voxtally.functions.columns import draw62, natural_key
from voxtally.functions.special import beta_cdf, f_tail, t_tail2
from voxtally.operators import ordering, resample, stats


def plan_text(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_tails():
    assert f_tail(13.5, 1, 4) == pytest.approx(0.0213116411, abs=1e-9)
    assert t_tail2(np.sqrt(13.5), 4) == pytest.approx(0.0213116411, abs=1e-9)
    assert beta_cdf(0.5, 2, 2) == pytest.approx(0.5)
    assert t_tail2(1.96, 1e6) == pytest.approx(0.05, abs=1e-4)


def results(spark, rows):
    return spark.createDataFrame(rows, "acronym string, cond string, animal_id int, val double")


def test_anova_of_two_groups(spark):
    df = results(spark, [("A", c, i, float(v)) for i, (c, v) in enumerate(zip("aaabbb", range(1, 7)))])
    row = stats.anova(df, "cond", "val").first()
    assert row["F"] == pytest.approx(13.5)
    assert row["p"] == pytest.approx(0.0213116411, abs=1e-9)
    assert row["reject"]


def corrected(p, method):
    p = np.asarray(p)
    order = np.argsort(p, kind="stable")
    s, m = p[order], len(p)
    i = np.arange(1, m + 1)
    if method == "bonferroni":
        q = s * m
    elif method == "sidak":
        q = 1 - (1 - s) ** m
    elif method == "holm":
        q = np.maximum.accumulate(s * (m - i + 1))
    elif method == "holm-sidak":
        q = np.maximum.accumulate(1 - (1 - s) ** (m - i + 1))
    elif method == "simes-hochberg":
        q = np.minimum.accumulate((s * (m - i + 1))[::-1])[::-1]
    else:
        q = s * m / i * ((1 / i).sum() if method == "fdr_by" else 1)
        q = np.minimum.accumulate(q[::-1])[::-1]
    out = np.empty(m)
    out[order] = np.minimum(q, 1)
    return out


@pytest.mark.parametrize("method", stats.METHODS)
def test_corrections_match_numpy(spark, method):
    rng = np.random.default_rng(1)
    p = np.concatenate([rng.random(40) ** 3, [0.2, 0.3]])
    df = spark.createDataFrame([(i, i % 1, float(v)) for i, v in enumerate(p)] + [(100, 0, None)], "i int, fam int, p double")
    for family in ((), ("fam",)):
        got = stats.adjust_pvalues(df, family=family, method=method).orderBy("i").collect()
        assert [r["p_corrected"] for r in got[:-1]] == pytest.approx(corrected(p, method).tolist())
        assert got[-1]["p_corrected"] is None


def test_the_sum_of_reciprocals_takes_the_same_work_for_any_family(spark):
    sizes = [1, 2, 31, 32, 33, 34, 100, 12_345, 1_000_000]
    found = spark.createDataFrame([(m,) for m in [*sizes, 10**12]], "m long").select("m", special.harmonic(F.col("m")).alias("h"))
    got = dict(found.collect())
    assert [got[m] for m in sizes] == pytest.approx([math.fsum(1 / i for i in range(1, m + 1)) for m in sizes], rel=1e-14)
    assert got[10**12] == pytest.approx(math.log(10**12) + 0.5772156649015329 + 5e-13, rel=1e-14)
    many = spark.range(200_000).select(((F.col("id") + 1) / F.lit(200_001.0)).alias("p"))
    assert stats.adjust_pvalues(many, method="fdr_by").agg(F.min("p_corrected")).first()[0] == 1.0


def test_tied_p_values_share_a_corrected_value(spark):
    df = spark.createDataFrame([(0.01,), (0.01,), (0.5,)], "p double")
    got = [r["p_corrected"] for r in stats.adjust_pvalues(df).orderBy("p").collect()]
    assert got == pytest.approx([0.015, 0.015, 0.5])


def test_correction_reads_its_input_twice_at_most(spark, tmp_path):
    spark.range(10).select(F.rand(1).alias("p")).write.parquet(str(tmp_path / "p"))
    for method in stats.METHODS:
        assert plan_text(stats.adjust_pvalues(spark.read.parquet(str(tmp_path / "p")), method=method)).count("Relation") <= 2


def test_draws_agree_with_numpy_and_stay_short(spark):
    df = spark.range(500).select("id", draw62(7, F.col("id") % 5, F.col("id")).alias("d"))
    assert len(plan_text(df)) < 40_000
    i = np.arange(500)
    assert [r["d"] for r in df.orderBy("id").collect()] == draws.draw62(7, i % 5, i).tolist()


def test_natural_order(spark):
    names = ["a10", "A2", "a1b10", "a1b9", "b", "a" + "9" * 30, "a" + "1" + "0" * 30, "a02x"]
    rows = spark.createDataFrame([(n,) for n in names], "n string").orderBy(natural_key(F.col("n")), "n").collect()
    assert [r["n"] for r in rows] == ["a1b9", "a1b10", "A2", "a02x", "a10", "a" + "9" * 30, "a1" + "0" * 30, "b"]


@pytest.mark.parametrize("ranges", [1, 4, 64])
def test_ranks_do_not_depend_on_ranges(spark, ranges):
    rng = np.random.default_rng(2)
    rows = [(int(k), float(v), i) for i, (k, v) in enumerate(zip(rng.integers(0, 3, 300), rng.integers(0, 40, 300)))]
    df = spark.createDataFrame(rows, "k int, v double, i int")
    got = {r["i"]: r["rank"] for r in ordering.with_rank(df, ["k"], F.col("v"), [F.col("v"), F.col("i")], ranges=ranges).collect()}
    for key in range(3):
        mine = sorted((v, i) for k, v, i in rows if k == key)
        assert [got[i] for _, i in mine] == list(range(1, len(mine) + 1))


def sample_rows(spark, sizes, width=2):
    rng = np.random.default_rng(3)
    rows = [(int(1000 * g + i), g, rng.normal(size=width).tolist()) for g, n in enumerate(sizes) for i in range(n)]
    return spark.createDataFrame(rows, "animal_id long, group int, x array<double>")


@pytest.mark.parametrize("block", [8, 10, 4096])
def test_bootstrap_weights_have_exact_group_sizes(spark, block):
    sizes = [20, 33]
    blocks = resample.make_blocks(sample_rows(spark, sizes), sizes, block)
    plan = resample.bootstrap_plan(blocks, 12, 5).groupBy("resample", "group").agg(F.sum("weight").alias("n")).collect()
    assert len(plan) == 24
    assert all(r["n"] == sizes[r["group"]] for r in plan)


@pytest.mark.parametrize("block", [8, 4096])
def test_bootstrap_sums_are_the_moments_of_the_plan(spark, block):
    sizes = [20, 33]
    rows = sample_rows(spark, sizes)
    blocks = resample.make_blocks(rows, sizes, block)
    sums = {(r["resample"], r["cell"], r["k"]): r["v"] for r in resample.bootstrap_sums(blocks, 6, 5).collect()}
    values = {r["sid"]: r["x"] for r in blocks.rows.select("sid", "x").collect()}
    want = {}
    for r in resample.bootstrap_plan(blocks, 6, 5).collect():
        for k, v in enumerate([1.0, *values[r["sid"]]]):
            key = (r["resample"], r["group"], k)
            want[key] = want.get(key, 0.0) + r["weight"] * v
    assert {k: sums[k] for k in want} == pytest.approx(want)


def test_permutations_keep_group_sizes(spark):
    sizes = [7, 9, 4]
    blocks = resample.make_blocks(sample_rows(spark, sizes), sizes, 5)
    plan = resample.permutation_plan(blocks, 8, 3)
    counts = plan.groupBy("perm", "new_group").count().collect()
    assert len(counts) == 24 and all(r["count"] == sizes[r["new_group"]] for r in counts)
    stays = plan.where("group = new_group").groupBy("perm", "group").count().collect()
    assert all(r["count"] < sizes[r["group"]] for r in stays)
