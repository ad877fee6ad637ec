"""Permutations, bootstraps and halves against numpy with the same draws."""

from __future__ import annotations

import itertools

import numpy as np
import pytest
from pyspark.sql import functions as F

from voxtally.functions import draws as D
from voxtally.operators import network as N
from voxtally.operators import pls as L
from voxtally.operators import resample as RS
from voxtally.operators.stats import Matrix

SIZES, SEED, BLOCK = (9, 8, 7), 3, 4
GROUP = np.repeat(np.arange(3), SIZES)


def numbers(n_x=5, n_y=2, conditions=1):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(sum(SIZES), n_x * conditions)) + 10
    x[: SIZES[0]] += 1.5
    return x, x[:, :n_x] @ rng.normal(size=(n_x, n_y)) + 2 * rng.normal(size=(sum(SIZES), n_y))


def table(spark, x):
    rows = [(100 + i, int(g), v) for i, (g, v) in enumerate(zip(GROUP, x.tolist(), strict=True))]
    return spark.createDataFrame(rows, "animal_id long, group int, x array<double>")


def matrix(spark, x, features):
    rows = table(spark, x).withColumn("cond", F.col("group").cast("string"))
    return Matrix(rows, [f"f{i}" for i in range(features)], ["a", "b", "c"], list(SIZES))


def permuted(r, conditions=1):
    """(new groups, condition order) of a candidate."""
    sid = np.arange(len(GROUP))
    rank = np.argsort(np.argsort(D.draw62(RS.stream(SEED, RS.PERMUTATION_STREAM), np.array(r), sid)))
    return GROUP[rank], RS.permuted_conditions(SEED, r, sid, conditions)


def expected_ids(n, conditions=1):
    seen, out = set(), []
    for r in itertools.count():
        new, order = permuted(r, conditions)
        what = (tuple(new), order.tobytes())
        if what not in seen and not any((new[GROUP == g] == g).all() for g in range(3)):
            out.append(r)
        seen.add(what)
        if len(out) == n:
            return out


def shuffled(x, order, conditions):
    cube = x.reshape(len(x), conditions, -1)
    return np.take_along_axis(cube, order[:, :, None], axis=1).reshape(len(x), -1)


def cell_cross(x, group, conditions=1, mode=0):
    means = np.stack([x[group == g].mean(axis=0).reshape(conditions, -1) for g in range(3)])
    centre = means.mean(axis=1, keepdims=True) if mode == 0 else means.mean(axis=0, keepdims=True)
    return (means - centre).reshape(3 * conditions, -1)


@pytest.mark.parametrize("conditions", [1, 2])
def test_plan_is_the_order_of_the_draws(spark, conditions):
    blocks = RS.make_blocks(table(spark, numbers()[0]), SIZES, BLOCK)
    ids = expected_ids(30, conditions)
    got = RS.permutation_plan(blocks, 30, SEED, conditions).toPandas()
    assert len(got) == 30 * len(GROUP)
    for perm, r in enumerate(ids):
        mine = got[got.perm == perm].sort_values("sid")
        new, order = permuted(r, conditions)
        assert mine.new_group.tolist() == new.tolist() and mine.group.tolist() == GROUP.tolist()
        if conditions > 1:
            assert [list(v) for v in mine.conditions] == order.tolist()


def test_repeated_and_unmixed_sequences_are_passed_over(spark):
    rows = spark.createDataFrame([(i, i // 2, [float(i)]) for i in range(4)], "animal_id long, group int, x array<double>")
    blocks = RS.make_blocks(rows, [2, 2], 3)
    got = RS.permutation_plan(blocks, 5, 1).toPandas()
    sequences = {tuple(g.sort_values("sid").new_group) for _, g in got.groupby("perm")}
    assert len(sequences) == 5 and (0, 0, 1, 1) not in sequences
    with pytest.warns(UserWarning, match="only 5 of 9"):
        again = RS.permutation_plan(blocks, 9, 1).toPandas()
    assert again.perm.nunique() == 9


def test_bootstraps_of_few_subjects_are_left_out_and_repeats_come_last(spark):
    rows = spark.createDataFrame([(i, i // 5, [float(i)]) for i in range(10)], "animal_id long, group int, x array<double>")
    blocks = RS.make_blocks(rows, [5, 5], 8)
    n, seen, order = 60, set(), []
    for r in range(2 * (n + 10)):  # of n + 10 too few are fine
        draws = [(g, tuple(np.sort(D.draw62(RS.stream(SEED, RS.IN_BLOCK_STREAM), np.array(r * 2 + g), np.arange(5)) % 5))) for g in range(2)]
        order.append((any(len(set(d)) < 3 for _, d in draws), any(d in seen for d in draws), r, draws))
        seen.update(draws)
    assert sum(few for few, *_ in order[: n + 10]) > 10 and any(repeat for few, repeat, *_ in order if not few)
    order = sorted(order)[:n]
    assert not any(few for few, *_ in order)
    got = RS.bootstrap_plan(blocks, n, SEED).toPandas()
    for place, (*_, draws) in enumerate(order):
        mine = got[got["resample"] == place].sort_values("sid")
        assert np.repeat(mine.sid, mine.weight).tolist() == [g * 5 + v for g, d in draws for v in d]
    assert got["resample"].nunique() == n


@pytest.mark.parametrize("conditions", [1, 2])
def test_mean_centred_permutation_pvalues(spark, conditions):
    x, _ = numbers(conditions=conditions)
    mode = 1 if conditions == 1 else 0
    result = L.meancentered_pls(matrix(spark, x, 5), conditions, mode, n_perm=25, n_boot=0, seed=SEED, block_size=BLOCK)
    u, d, v = L.decompose(cell_cross(x, GROUP, conditions, mode))
    above = np.ones(len(d))
    for r in expected_ids(25, conditions):
        new, order = permuted(r, conditions)
        _, dp, vp = L.decompose(cell_cross(shuffled(x, order, conditions), new, conditions, mode))
        above += np.sqrt((L.align(v, vp, dp) ** 2).sum(axis=0)) > d
    got = {r["lv"]: r["p"] for r in result["singular"].collect()}
    live = d > 1e-8 * d.max()
    assert [got[k + 1] for k in range(len(d)) if live[k]] == pytest.approx((above / 26)[live].tolist())


def halves(family, new, n_split, counts_group):
    """(splits x samples) first halves, block by block; ``counts_group`` are the groups that blocks are made of."""
    sid = np.arange(len(new))
    number = np.concatenate([g * 10 + np.arange(n) // BLOCK for g, n in enumerate(SIZES)])
    labels = np.unique(number)
    counts = np.array([[(new[number == b] == g).sum() for g in range(3)] for b in labels])
    shares = RS.half_shares(counts, RS.split_sizes(SIZES, n_split, SEED, 0.5), SEED, family)
    out = np.zeros((n_split, len(new)), dtype=bool)
    for b, share in zip(labels, shares, strict=True):
        inside = number == b
        drawn = D.draw62(RS.stream(SEED, RS.SPLIT_STREAM), family * n_split + np.arange(n_split)[:, None], sid[inside][None, :])
        for g in range(3):
            own = np.flatnonzero(new[inside] == g)
            for s in range(n_split):
                out[s, np.flatnonzero(inside)[own[np.argsort(drawn[s, own])[: share[s, g]]]]] = True
    return out


def test_halves_have_their_exact_sizes():
    sizes = RS.split_sizes(SIZES, 12, SEED, 0.5)
    for family in range(4):
        new = GROUP if not family else permuted(family)[0]
        first = halves(family, new, 12, GROUP)
        assert all((first[s] & (new == g)).sum() == sizes[s, g] for s in range(12) for g in range(3))


def correlations(parts, cross, u, d, v):
    ud, vd = u * L.safe_inverse(d), v * L.safe_inverse(d)
    uc, vc = [], []
    for first in parts:
        d1, d2 = cross(first), cross(~first)
        uc.append(L.column_correlation(d1.T @ vd, d2.T @ vd))
        vc.append(L.column_correlation(d1 @ ud, d2 @ ud))
    with np.errstate(all="ignore"):
        return np.nanmean(uc, axis=0), np.nanmean(vc, axis=0)


def check_split(split, observed, drawn, live):
    got = split.toPandas().sort_values("lv")
    for k, side in enumerate(("ucorr", "vcorr")):
        own, perms = observed[k], np.array([v[k] for v in drawn])
        assert np.allclose(got[side][live], own[live])
        assert np.allclose(got[f"{side}_p"][live], (((perms > own).sum(axis=0) + 1) / (len(perms) + 1))[live])
        assert np.allclose(got[f"{side}_ll"][live], np.percentile(perms, 2.5, axis=0)[live])
        assert np.allclose(got[f"{side}_ul"][live], np.percentile(perms, 97.5, axis=0)[live])


def test_split_halves_of_mean_centred_pls(spark):
    x, _ = numbers()
    n_perm, n_split = 20, 10
    result = L.meancentered_pls(matrix(spark, x, 5), 1, 1, n_perm=n_perm, n_boot=0, n_split=n_split, seed=SEED, block_size=BLOCK)

    def of(new):
        return lambda mask: cell_cross(x[mask], new[mask], 1, 1)

    u, d, v = L.decompose(cell_cross(x, GROUP, 1, 1))
    observed = correlations(halves(0, GROUP, n_split, GROUP), of(GROUP), u, d, v)
    drawn = []
    for k, r in enumerate(expected_ids(n_perm)):
        new = permuted(r)[0]
        up, dp, vp = L.decompose(cell_cross(x, new, 1, 1))
        drawn.append(correlations(halves(k + 1, new, n_split, GROUP), of(new), up, dp, vp))
    check_split(result["split"], observed, drawn, d > 1e-8 * d.max())


def test_first_halves_are_those_of_the_smallest_draws(monkeypatch):
    rng = np.random.default_rng(2)
    sid, new, full = np.arange(50, 450), rng.integers(0, 4, 400), rng.normal(size=(400, 3))
    new[new == 2] = 1
    counts = np.bincount(new, minlength=4)
    shares = np.stack([rng.integers(0, c + 1, 9) for c in counts], axis=1)
    shares[0], shares[1] = 0, counts
    want = np.zeros((10, 4, 3))
    for g in range(4):
        inside = np.flatnonzero(new == g)
        want[0, g] = full[inside].sum(axis=0)
        for s in range(9):
            drawn = D.draw62(5, np.array(7 * 9 + s), sid[inside])
            want[1 + s, g] = full[inside[np.argsort(drawn)[: shares[s, g]]]].sum(axis=0)
    assert RS.half_moments(5, 7, sid, new, shares, full) == pytest.approx(want)
    monkeypatch.setattr(D, "high_word", lambda *v: (D.draw62(*v) >> 57).astype(np.uint32))  # leading words that tie
    assert RS.half_moments(5, 7, sid, new, shares, full) == pytest.approx(want)


def test_blocks_of_a_bundle_are_summed_before_the_shuffle(spark, monkeypatch):
    x, _ = numbers()
    found = []
    for most in (16, 2):
        monkeypatch.setattr(RS, "HALF_BUNDLES", most)
        result = L.meancentered_pls(matrix(spark, x, 5), 1, 1, n_perm=4, n_boot=0, n_split=10, seed=SEED, block_size=BLOCK)
        found.append(result["split"].toPandas().sort_values("lv"))
        blocks = RS.make_blocks(table(spark, x), SIZES, BLOCK)
        sums = RS.half_sums(blocks, blocks.rows, 2, 10, SEED, lambda p, sid, g: np.full((len(p), len(sid)), g), lambda left: lambda p: np.ones((len(left), 1)), 5)
        assert sorted(len(r["v"]) for r in sums.collect()) == [11 * 3 * 8] * 2
    live = found[0].lv <= 2
    assert np.allclose(found[0][live], found[1][live], equal_nan=True)


def behaviour_cross(x, y, group):
    def corr(a, b):
        a, b = a - a.mean(axis=0), b - b.mean(axis=0)
        return (b.T @ a) / np.sqrt(np.outer((b**2).sum(axis=0), (a**2).sum(axis=0)))

    return np.vstack([corr(x[group == g], y[group == g]) for g in range(3)])


def paired(n):
    """Where each permutation brings the samples, for the first ``n`` that mix every group."""
    out = []
    for r in itertools.count():
        to = np.argsort(np.argsort(D.draw62(RS.stream(SEED, RS.PERMUTATION_STREAM), np.array(r), np.arange(len(GROUP)))))
        if not any((GROUP[to[GROUP == g]] == g).all() for g in range(3)):
            out.append(to)
        if len(out) == n:
            return out


def accepted(blocks, sizes, n_boot):
    """The bootstraps as (sid, weight) rows, and the candidates used: none with few subjects, repeats last."""
    count = n_boot + max(10, n_boot // 20)
    plan = RS.bootstrap_plan(blocks, count, SEED).toPandas()
    seen, order = set(), []
    for r in range(count):
        draws = [(g, tuple(sorted(zip(own.sid, own.weight, strict=True)))) for g, own in plan[plan["resample"] == r].groupby("group")]
        few = any(len(d) < np.ceil(min(sizes) / 2) for _, d in draws)
        order.append((few, any(d in seen for d in draws), r))
        seen.update(draws)
    assert not any(few for few, _, _ in sorted(order)[:n_boot])
    return plan, [r for _, _, r in sorted(order)[:n_boot]]


def test_behavioural_pls(spark):
    x, y = numbers()
    n_perm, n_boot, n_split = 20, 30, 10
    rows = table(spark, np.hstack([x, y]))
    result = L.behavioral_pls(
        rows, SIZES, [f"f{i}" for i in range(5)], ["p", "q"], ["a", "b", "c"], n_perm=n_perm, n_boot=n_boot, n_split=n_split,
        test_split=None, seed=SEED, block_size=BLOCK)
    u, d, v = L.decompose(behaviour_cross(x, y, GROUP))
    live = d > 1e-8 * d.max()
    singular = result["singular"].toPandas().sort_values("lv")
    assert np.allclose(singular.singular_value, d)
    above, drawn = np.ones(len(d)), []
    for k, to in enumerate(paired(n_perm)):
        moved = np.empty_like(y)
        moved[to] = y
        cross = behaviour_cross(x, moved, GROUP)
        up, dp, vp = L.decompose(cross)
        above += np.sqrt((L.align(v, vp, dp) ** 2).sum(axis=0)) > d
        first = halves(k + 1, GROUP, n_split, GROUP)
        drawn.append(correlations(first, lambda m, moved=moved: behaviour_cross(x[m], moved[m], GROUP[m]), up, dp, vp))
    assert np.allclose(singular.p[live], (above / (n_perm + 1))[live])
    observed = correlations(halves(0, GROUP, n_split, GROUP), lambda m: behaviour_cross(x[m], y[m], GROUP[m]), u, d, v)
    check_split(result["split"], observed, drawn, live)
    # bootstraps: the same multiplicities serve the vectors and the loadings
    blocks = RS.make_blocks(rows, SIZES, BLOCK)
    plan, kept = accepted(blocks, SIZES, n_boot)
    vectors, loads = [], []
    scores = x @ L.unit_columns(u)
    for r in kept:
        own = plan[plan["resample"] == r]
        at = np.repeat(own.sid.to_numpy(), own.weight.to_numpy())
        ub, db, _ = L.decompose(behaviour_cross(x[at], y[at], GROUP[at]))
        vectors.append(L.align(u, ub, db))
        loads.append(behaviour_cross(scores[at], y[at], GROUP[at]))
    base = u * d
    everything = np.array([*vectors, base])
    se = np.sqrt(np.abs((everything**2).sum(axis=0) - everything.sum(axis=0) ** 2 / (n_boot + 1)) / n_boot)
    weights = result["weights"].toPandas().pivot(index="acronym", columns="lv", values="ratio").to_numpy()
    assert np.allclose(weights[:, live[: weights.shape[1]]], (base / se)[:, live], rtol=1e-6)
    loading = result["y_loadings"].toPandas()
    low, high = np.percentile(loads, [2.5, 97.5], axis=0)
    for i, (g, b) in enumerate(itertools.product("abc", "pq")):
        mine = loading[(loading.condition == g) & (loading.behaviour == b)].sort_values("lv")
        assert np.allclose(mine.loading, behaviour_cross(scores, y, GROUP)[i])
        assert np.allclose(mine.ll, low[i]) and np.allclose(mine.ul, high[i])


@pytest.mark.parametrize("numbers_held", [1 << 22, 30])
def test_paired_sums_are_those_of_the_paired_rows(spark, monkeypatch, numbers_held):
    x, y = numbers()
    monkeypatch.setattr(RS, "PLACE_NUMBERS", numbers_held)  # one range of draws, or several
    blocks = RS.make_blocks(table(spark, np.hstack([x, y])), SIZES, BLOCK)
    pairs = L.xcorr_indices(5, 2)
    sums, of_y = RS.paired_sums(blocks, 12, SEED, 5, 2, pairs)
    assert "Window" not in sums._jdf.queryExecution().optimizedPlan().toString().split("InMemoryRelation")[0]
    got = sums.toPandas()
    for k, to in enumerate(paired(12)):
        moved = np.empty_like(y)
        moved[to] = y
        for g in range(3):
            whole = RS.products(np.hstack([x, moved])[GROUP == g], (pairs[0][of_y], pairs[1][of_y])).sum(axis=0)
            mine = got[(got["resample"] == k) & (got.cell == g)].sort_values("k")
            assert mine.v.to_numpy() == pytest.approx(whole[1 + 5:])


def test_paired_permutations_of_few_samples_repeat_last(spark):
    rows = spark.createDataFrame([(i, 0, [float(i), float(i * i)]) for i in range(3)], "animal_id long, group int, x array<double>")
    blocks = RS.make_blocks(rows, [3], 2)
    with pytest.warns(UserWarning, match="only 6 of 9"):
        sums, _ = RS.paired_sums(blocks, 9, 1, 1, 1, (np.array([0]), np.array([1])))
    with pytest.warns(UserWarning, match="only 6 of 9"):
        moved = RS.paired_ids(blocks, 9, 1).toPandas()
    products = sums.filter("k = 1").toPandas().set_index("resample").v.sort_index()
    for perm, own in moved.groupby("perm"):
        assert products[perm] == (own.to * own.sid**2).sum()
    assert sorted(set(products[:6])) == sorted({sum(t * s * s for s, t in enumerate(p)) for p in itertools.permutations(range(3))})


def simpls_share(x, y, components):
    return L.simpls_from_moments(full_moments(x, y), x.shape[1], y.shape[1], components)


def full_moments(x, y):
    z = np.hstack([x, y])
    i, j = L.regression_indices(x.shape[1], y.shape[1])
    return RS.products(z, (i, j)).sum(axis=0)


@pytest.mark.parametrize("depth", [1, 3])
def test_pls_regression(spark, depth):
    x, y = numbers()
    rng = np.random.default_rng(4)
    deep = y[:, :, None] + rng.normal(size=(*y.shape, depth)) if depth > 1 else y[:, :, None]
    rows = table(spark, np.hstack([x, deep.reshape(len(x), -1)])).drop("group")
    n_perm, n_boot = 15, 20
    result = L.pls_regression(rows, [f"f{i}" for i in range(5)], ["p", "q"], 2, depth=depth, n_perm=n_perm, n_boot=n_boot, seed=SEED, block_size=BLOCK)
    flat = deep.mean(axis=-1)
    fit = simpls_share(x, flat, 2)
    singular = result["singular"].toPandas().sort_values("lv")
    assert np.allclose(singular.varexp, fit.pctvar[1])
    above = np.ones(2)
    for r in range(n_perm):
        to = np.argsort(np.argsort(D.draw62(RS.stream(SEED, RS.PERMUTATION_STREAM), np.array(r), np.arange(len(x)))))
        moved = np.empty_like(flat)
        moved[to] = flat
        above += simpls_share(x, moved, 2).pctvar[1] > fit.pctvar[1]
    assert np.allclose(singular.p, above / (n_perm + 1))
    blocks = RS.make_blocks(rows.select("animal_id", F.lit(0).alias("group"), "x"), [len(x)], BLOCK)
    plan, kept = accepted(blocks, [len(x)], n_boot)
    weights, loads = [], []
    for r in kept:
        own = plan[plan["resample"] == r]
        at = np.repeat(own.sid.to_numpy(), own.weight.to_numpy())
        which = D.draw62(RS.stream(SEED, RS.CONDITION_STREAM), np.array(r), np.arange(depth)) % depth
        yb = deep[at][:, :, which].mean(axis=-1) if depth > 1 else flat[at]
        b = simpls_share(x[at], yb, 2)
        flip = np.sign(L.column_correlation(b.x_weights, fit.x_weights))
        weights.append(b.x_weights * flip)
        loads.append((yb - flat.mean(axis=0)).T @ (x[at] - x.mean(axis=0)) @ weights[-1])
    everything = np.array([*weights, fit.x_weights])
    se = np.sqrt(np.abs((everything**2).sum(axis=0) - everything.sum(axis=0) ** 2 / (n_boot + 1)) / n_boot)
    got = result["weights"].toPandas().pivot(index="acronym", columns="lv", values="se").to_numpy()
    assert np.allclose(got, se, rtol=1e-5)
    loading = result["y_loadings"].toPandas().sort_values(["behaviour", "lv"])
    assert np.allclose(loading.ll, np.percentile(loads, 2.5, axis=0).ravel(), rtol=1e-5)
    assert np.allclose(loading.ul, np.percentile(loads, 97.5, axis=0).ravel(), rtol=1e-5)


def test_cross_validation(spark):
    x, y = numbers()
    blocks = RS.make_blocks(table(spark, np.hstack([x, y])), SIZES, BLOCK)
    got = L.cross_validate(blocks, SIZES, 5, 2, False, 6, 0.25, SEED, ["p", "q"]).toPandas()
    plan = RS.split_plan(blocks, 6, SEED, 0.25).toPandas()
    for s in range(6):
        train = plan[plan.split == s].sort_values("sid")["first"].to_numpy(bool)
        u, _, v = L.decompose(behaviour_cross(x[train], y[train], GROUP[train]))
        predicted = np.full_like(y, np.nan)
        for g in range(3):
            own, rest = train & (GROUP == g), ~train & (GROUP == g)
            z = (x[rest] - x[own].mean(axis=0)) / x[own].std(axis=0, ddof=1)
            predicted[rest] = z @ u @ v[g * 2:(g + 1) * 2].T + y[own].mean(axis=0)
        for b, name in enumerate("pq"):
            a, p = y[~train, b], predicted[~train, b]
            mine = got[(got.split == s) & (got.behaviour == name)].iloc[0]
            assert mine.pearson_r == pytest.approx(np.corrcoef(a, p)[0, 1])
            assert mine.r_squared == pytest.approx(1 - ((a - p) ** 2).sum() / ((a - a.mean()) ** 2).sum())


def test_simpls_residuals_and_scores(spark):
    x, y = numbers()
    rows = table(spark, np.hstack([x, y])).drop("group")
    result = L.simpls(rows, [f"f{i}" for i in range(5)], ["p", "q"], 2, block_size=BLOCK)
    fit = simpls_share(x, y, 2)
    scores = (x - x.mean(axis=0)) @ fit.x_weights
    left = np.hstack([x - x.mean(axis=0) - scores @ fit.x_loadings.T, y - y.mean(axis=0) - scores @ fit.y_loadings.T])
    got = result["residuals"].toPandas().pivot(index="animal_id", columns="variable", values="residual")
    assert np.allclose(got[[*(f"f{i}" for i in range(5)), "p", "q"]].to_numpy(), left, atol=1e-8)
    assert np.allclose(scores.T @ scores, np.eye(2), atol=1e-8)
    table_ = result["scores"].toPandas().pivot(index="animal_id", columns="component", values="x_score").to_numpy()
    assert np.allclose(table_, scores, atol=1e-8)


def network_numbers(n=60, width=11):
    rng = np.random.default_rng(6)
    x = rng.normal(size=(n, width)) + rng.normal(size=(n, 1))
    x[rng.random(x.shape) < 0.2] = np.nan
    x[:, 4] = 2.5
    x[2:, 7] = np.nan
    return x


def pair_correlation(x, i, j):
    own = ~np.isnan(x[:, i]) & ~np.isnan(x[:, j])
    a, b = x[own, i], x[own, j]
    if own.sum() < 2 or a.std() < 1e-12 or b.std() < 1e-12:
        return own.sum(), np.nan
    return own.sum(), np.corrcoef(a, b)[0, 1]


@pytest.mark.parametrize("tile", [4, 32])
def test_pair_blocks_give_every_correlation_and_count(spark, tile):
    x = network_numbers()
    rows = spark.createDataFrame([(i, [None if np.isnan(v) else float(v) for v in r]) for i, r in enumerate(x)], "animal_id long, x array<double>")
    blocks = N.network_blocks(rows, len(x), x.shape[1], 25)
    got = {(r["i"], r["j"]): (r["n"], r["r"]) for r in N.correlation(blocks, x.shape[1], tile=tile).collect()}
    assert len(got) == 55
    for (i, j), (n, r) in got.items():
        want_n, want = pair_correlation(x, i, j)
        assert n == want_n
        assert r is None if want_n < 3 or np.isnan(want) else r == pytest.approx(want)
    n_boot = 25
    observed = N.correlation(blocks, x.shape[1], tile=tile)
    counts = {(r["i"], r["j"]): r["exceed"] for r in N.edge_bootstrap(blocks, x.shape[1], observed, n_boot, SEED, tile=tile).collect()}
    plan = RS.bootstrap_plan(blocks, n_boot, SEED).toPandas()
    order = blocks.rows.toPandas().sort_values("sid").animal_id.to_numpy()
    want = dict.fromkeys(got, 0)
    for r in range(n_boot):
        own = plan[plan["resample"] == r]
        z = x[order][np.repeat(own.sid.to_numpy(), own.weight.to_numpy())]
        for i, j in got:
            value = pair_correlation(z, i, j)[1]
            want[i, j] += 0 if np.isnan(value) else abs(value) > abs(got[i, j][1] or 0) + 1e-12
    assert counts == want


def test_a_thousand_structures_never_meet_in_one_group(spark):
    rows = spark.createDataFrame([(i, [float((i * 7919 + k * 31) % 101) for k in range(1000)]) for i in range(12)], "animal_id long, x array<double>")
    sums = N.pair_sums(N.network_blocks(rows, 12, 1000), 1000)
    sizes = sums.select(F.length("v").alias("n")).agg(F.max("n").alias("n"), F.count("*").alias("rows")).first()
    assert sizes["n"] == 6 * N.TILE**2 * 8 and sizes["rows"] == len(N.tile_pairs(1000))
