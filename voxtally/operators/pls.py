"""Partial least squares on subjects x structures, by distributed moments.

Everything the decompositions need are weighted moments of the subjects (see ``resample``); a task
or the driver only ever sees matrices of (groups x conditions x behaviours) by structures, whose
size is set by the design and the atlas, never by the number of subjects.

Signs of singular vectors are fixed: the largest magnitude of each structure vector is positive.
A latent variable whose singular value is numerically zero is reported without p-value and ratio."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass, field

from statistics import NormalDist

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from voxtally.functions import draws as D
from voxtally.functions.columns import number
from voxtally.operators import resample as RS
from voxtally.operators.resample import Blocks
from voxtally.operators.stats import Matrix

NULL_LV = 1e-8  # relative size below which a singular value counts as zero


# ------------------------------------------------------------------ small matrices
def decompose(cross: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows x features -> (feature vectors U, singular values d, row vectors V)."""
    u, d, vt = np.linalg.svd(cross.T, full_matrices=False)
    sign = np.sign(u[np.abs(u).argmax(axis=0), np.arange(u.shape[1])])
    sign[sign == 0] = 1.0
    return u * sign, d, (vt.T * sign)


def align(original: np.ndarray, resampled: np.ndarray, d: np.ndarray) -> np.ndarray:
    """Rotate resampled vectors, scaled by their singular values, onto the original ones."""
    n, _, pt = np.linalg.svd(original.T @ resampled, full_matrices=False)
    return (resampled * d) @ (pt.T @ n.T)


def unit_columns(m: np.ndarray) -> np.ndarray:
    norm = np.linalg.norm(m, axis=0, keepdims=True)
    return np.divide(m, norm, out=np.zeros_like(m), where=norm > 0)


def safe_inverse(d: np.ndarray) -> np.ndarray:
    live = d > NULL_LV * max(d.max(initial=0.0), 1e-300)
    return np.where(live, 1.0 / np.where(live, d, 1.0), 0.0)


def column_correlation(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    az, bz = a - a.mean(axis=0), b - b.mean(axis=0)
    scale = np.sqrt((az**2).sum(axis=0) * (bz**2).sum(axis=0))
    r = np.divide((az * bz).sum(axis=0), scale, out=np.full(a.shape[1], np.nan), where=scale > 0)
    return np.clip(r, -1.0, 1.0)


def centre_means(means: np.ndarray, counts: np.ndarray, n_cond: int, mode: int) -> np.ndarray:
    """Remove from cell means (cells x features): 0 the group mean over its conditions, 1 the unweighted
    mean of the groups per condition, 2 the mean of all rows."""
    cube = means.reshape(-1, n_cond, means.shape[1])
    if mode == 0:
        centre = np.broadcast_to(cube.mean(axis=1, keepdims=True), cube.shape)
    elif mode == 1:
        centre = np.broadcast_to(cube.mean(axis=0, keepdims=True), cube.shape)
    elif mode == 2:
        overall = (means * counts[:, None]).sum(axis=0) / counts.sum()
        centre = np.broadcast_to(overall, cube.shape)
    else:
        raise ValueError("mean centring mode must be 0, 1 or 2")
    return means - centre.reshape(means.shape)


def dense(pdf: pd.DataFrame, cells: int, width: int) -> np.ndarray:
    """Long (cell, k, v) of one resample -> cells x width."""
    out = np.zeros((cells, width))
    out[pdf["cell"].to_numpy(), pdf["k"].to_numpy()] = pdf["v"].to_numpy()
    return out


def frame(spark: SparkSession, rows: list, schema: str) -> DataFrame:
    return spark.createDataFrame(rows, schema)


# ------------------------------------------------------------------ result tables
@dataclass
class PLSResult:
    """Named result tables; ``arrays`` keeps the small matrices of the decomposition."""

    tables: dict[str, DataFrame]
    arrays: dict[str, np.ndarray] = field(default_factory=dict)

    def __getitem__(self, name: str) -> DataFrame:
        return self.tables[name]


def project_rows(blocks: Blocks, weights: np.ndarray, name: str = "score", offset: np.ndarray | None = None) -> DataFrame:
    """(animal_id, sid, group, lv, score): row vectors times weights, as Column expressions."""
    columns = []
    for l in range(weights.shape[1]):
        w = F.array(*[number(v) for v in weights[:, l]])
        shift = 0.0 if offset is None else float(offset[l])
        total = F.aggregate(F.zip_with("x", w, lambda a, b: a * b), number(-shift), lambda s, v: s + v)
        columns.append(F.struct(F.lit(l + 1).alias("lv"), total.alias(name)))
    return blocks.rows.select("animal_id", "sid", "group", F.inline(F.array(*columns)))


def singular_table(spark, d: np.ndarray, pvalues: DataFrame | None = None) -> DataFrame:
    share = d**2 / max((d**2).sum(), 1e-300)
    live = d > NULL_LV * max(d.max(initial=0.0), 1e-300)
    rows = [(i + 1, float(d[i]), float(share[i]), bool(live[i])) for i in range(len(d))]
    table = frame(spark, rows, "lv int, singular_value double, varexp double, live boolean")
    if pvalues is None:
        return table.withColumn("p", F.lit(None).cast("double"))
    return table.join(pvalues, "lv", "left").withColumn("p", F.when(F.col("live"), F.col("p")))


def permutation_pvalue(draws: DataFrame, original: DataFrame) -> DataFrame:
    """(#permuted above the original + 1) / (P + 1) per lv: ``draws(resample, lv, v)`` against
    ``original(lv, v)``."""
    joined = draws.join(original.select("lv", F.col("v").alias("_o")), "lv")
    return joined.groupBy("lv").agg(
        ((F.count_if(F.col("v") > F.col("_o")) + 1) / (F.count(F.lit(1)) + 1)).alias("p")
    )


def bootstrap_ratio(draws: DataFrame, keys: Sequence[str], original: DataFrame, extra: bool = False) -> DataFrame:
    """ratio = original / standard error, from the sums of ``draws(keys, v)`` and their squares.
    ``extra`` counts the ``original(keys, v)`` itself as one more draw."""
    sums = draws.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("_n"), F.sum("v").alias("_s"), F.sum(F.col("v") * F.col("v")).alias("_q")
    )
    o = F.col("_o")
    n = F.col("_n") + (1 if extra else 0)
    s = F.col("_s") + (o if extra else number(0))
    q = F.col("_q") + (o * o if extra else number(0))
    se = F.sqrt(F.try_divide(F.abs(q - F.try_divide(s * s, n.cast("double"))), (n - 1).cast("double")))
    return original.select(*keys, F.col("v").alias("_o")).join(sums, list(keys)).select(
        *keys, o.alias("original"), F.try_divide(o, se).alias("ratio"), se.alias("se")
    )


def bootstrap_interval(draws: DataFrame, keys: Sequence[str], ci: float = 95.0) -> DataFrame:
    """Percentile interval with linear interpolation."""
    low = (100.0 - ci) / 200.0
    return draws.groupBy(*keys).agg(F.percentile("v", F.array(F.lit(low), F.lit(1.0 - low))).alias("_ci")).select(
        *keys, F.get("_ci", F.lit(0)).alias("ll"), F.get("_ci", F.lit(1)).alias("ul")
    )


def variance_explained(singular: DataFrame) -> DataFrame:
    """d^2 over the sum of d^2; ``singular(lv, singular_value)`` has one row per latent variable."""
    square = F.col("singular_value") * F.col("singular_value")
    total = singular.agg(F.sum(square)).scalar()
    return singular.select("lv", F.try_divide(square, total).alias("varexp"))


# ------------------------------------------------------------------ operators on long tables
def group_means(long: DataFrame, keys: Sequence[str]) -> DataFrame:
    return long.groupBy(*keys, "feature").agg(F.avg("value").alias("mean"))


def mean_center(long: DataFrame, mode: int, means: bool = True) -> DataFrame:
    """``long(sample, group, cond, feature, value)``; the centred cell means, or the centred rows."""
    cells = long.groupBy("group", "cond", "feature").agg(F.avg("value").alias("mean"))
    if mode == 0:
        keys, centre = ["group", "feature"], long.groupBy("group", "feature").agg(F.avg("value").alias("_c"))
    elif mode == 1:
        keys, centre = ["cond", "feature"], cells.groupBy("cond", "feature").agg(F.avg("mean").alias("_c"))
    elif mode == 2:
        keys, centre = ["feature"], long.groupBy("feature").agg(F.avg("value").alias("_c"))
    else:
        raise ValueError("mean centring mode must be 0, 1 or 2")
    target, value = (cells, "mean") if means else (long, "value")
    return target.join(centre, keys).withColumn(value, F.col(value) - F.col("_c")).drop("_c").select(*target.columns)


def normalize_columns(long: DataFrame, column: Sequence[str], value: str = "value") -> DataFrame:
    """Unit Euclidean norm per column; a zero column stays zero.  The norms, a number per column, go to every
    task, as a merge would bring all values of a column into one."""
    norms = long.groupBy(*column).agg(F.sqrt(F.sum(F.col(value) * F.col(value))).alias("_n"))
    return long.join(F.broadcast(norms), list(column)).withColumn(
        value, F.coalesce(F.try_divide(F.col(value), F.col("_n")), number(0))
    ).drop("_n")


def column_corr(pairs: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Correlation of matched columns of ``pairs(keys, a, b)``, clipped to -1..1.  NULL when
    a side is constant."""
    a, b = F.col("a"), F.col("b")
    means = pairs.groupBy(*keys).agg(F.avg(a).alias("_ma"), F.avg(b).alias("_mb"))
    da, db = a - F.col("_ma"), b - F.col("_mb")
    r = F.try_divide(F.sum(da * db), F.sqrt(F.sum(da * da) * F.sum(db * db)))
    clipped = F.greatest(F.least(r, number(1)), number(-1))
    return pairs.join(means, list(keys)).groupBy(*keys).agg(
        F.when(r.isNotNull(), clipped).alias("r")
    )


def svd_small(cross: DataFrame, n_rows: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Singular triplets of ``cross(row, feature, value)`` with few rows and any number of features:
    the row Gram matrix is a distributed sum and only its n_rows x n_rows numbers reach the driver.
    Returns (lv, singular_value), (row, lv, value) and (feature, lv, value)."""
    spark = cross.sparkSession
    other = cross.select(F.col("row").alias("_r"), "feature", F.col("value").alias("_v"))
    gram = np.zeros((n_rows, n_rows))
    for i, j, v in (
        cross.join(other, "feature").groupBy("row", "_r").agg(F.sum(F.col("value") * F.col("_v"))).collect()
    ):
        gram[i, j] = v
    values, vectors = np.linalg.eigh(gram)
    order = np.argsort(values)[::-1]
    d, v = np.sqrt(np.maximum(values[order], 0.0)), vectors[:, order]
    inv = safe_inverse(d)
    right = frame(
        spark, [(r, l + 1, float(v[r, l]), float(inv[l])) for r in range(n_rows) for l in range(n_rows)],
        "row int, lv int, value double, inv double",
    )
    left = (
        cross.withColumnRenamed("value", "_c")
        .join(right, "row")
        .groupBy("feature", "lv").agg(F.sum(F.col("_c") * F.col("value") * F.col("inv")).alias("value"))
    )
    peak = left.groupBy("lv").agg(F.max_by("value", F.struct(F.abs(F.col("value")), F.col("feature"))).alias("_p"))
    sign = F.when(F.col("_p") < 0, number(-1)).otherwise(number(1))
    fix = lambda t: t.join(peak, "lv").withColumn("value", F.col("value") * sign).drop("_p", "inv")
    singular = frame(spark, [(l + 1, float(d[l])) for l in range(n_rows)], "lv int, singular_value double")
    return singular, fix(right).select("row", "lv", "value"), fix(left).select("feature", "lv", "value")


def xcorr_indices(n_x: int, n_y: int) -> tuple[np.ndarray, np.ndarray]:
    """Product pairs (x_i, y_j), j-major, then all squares; features are [x | y]."""
    i = np.concatenate([np.tile(np.arange(n_x), n_y), np.arange(n_x + n_y)])
    j = np.concatenate([np.repeat(n_x + np.arange(n_y), n_x), np.arange(n_x + n_y)])
    return i, j


def cross_from_moments(m: np.ndarray, n_x: int, n_y: int, covariance: bool) -> np.ndarray:
    """One cell's moments [n | sums | xy products | squares] -> (behaviours x features) matrix."""
    n, sums = m[0], m[1:1 + n_x + n_y]
    xy = m[1 + n_x + n_y:1 + n_x + n_y + n_x * n_y].reshape(n_y, n_x)
    squares = m[1 + n_x + n_y + n_x * n_y:][: n_x + n_y]
    centred = xy - np.outer(sums[n_x:], sums[:n_x]) / n
    if covariance:
        return centred / (n - 1)
    ss = np.maximum(squares - sums**2 / n, 0.0)
    scale = np.sqrt(np.outer(ss[n_x:], ss[:n_x]))
    return np.divide(centred, scale, out=np.zeros_like(centred), where=scale > 1e-12)


def xcorr(rows: DataFrame, sizes: Sequence[int], n_x: int, n_y: int, covariance: bool = False) -> DataFrame:
    """Per group cross-correlation (or covariance) of ``rows(animal_id, group, x = [x | y])``:
    (group, behaviour, feature, value), indices from 0."""
    blocks = RS.make_blocks(rows, sizes)
    pairs = xcorr_indices(n_x, n_y)
    width = 1 + n_x + n_y + len(pairs[0])

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        g = int(pdf["cell"].iloc[0])
        c = cross_from_moments(dense(pdf.assign(cell=0), 1, width)[0], n_x, n_y, covariance)
        y, x = np.indices(c.shape)
        return pd.DataFrame({"group": g, "behaviour": y.ravel(), "feature": x.ravel(), "value": c.ravel()})

    return RS.plain_sums(blocks, pairs).groupBy("cell").applyInPandas(
        one, "group int, behaviour int, feature int, value double"
    )


def row_mask(rows: DataFrame, x: str = "x", y: str = "y") -> DataFrame:
    """Drop samples whose x or whose y numbers are all missing."""
    some = lambda c: F.exists(c, lambda v: v.isNotNull() & ~F.isnan(v))
    return rows.filter(some(x) & some(y))


# ------------------------------------------------------------------ mean-centred PLS
def effective_mode(mode: int, n_groups: int, n_cond: int) -> int:
    """One condition cannot be centred within groups, nor one group across groups."""
    if n_cond == 1 and n_groups == 1:
        raise ValueError("one group and one condition: nothing to compare")
    if n_cond == 1 and mode == 0:
        return 1
    if n_groups == 1 and mode == 1:
        return 0
    return mode


def cell_means(moments: np.ndarray, n_cond: int) -> tuple[np.ndarray, np.ndarray]:
    """Group moments [n | sums of n_cond x features] -> (cells x features means, rows per cell)."""
    n = moments[:, 0]
    width = (moments.shape[1] - 1) // n_cond
    means = (moments[:, 1:] / np.maximum(n, 1.0)[:, None]).reshape(len(n) * n_cond, width)
    return means, np.repeat(n, n_cond)


def meancentered_pls(
    matrix: Matrix,
    n_cond: int = 1,
    mode: int = 0,
    n_perm: int = 1000,
    n_boot: int = 1000,
    n_split: int | None = None,
    rotate: bool = True,
    ci: float = 95.0,
    seed: int = 0,
    block_size: int = RS.BLOCK_SIZE,
) -> PLSResult:
    """``matrix.rows.x`` holds n_cond blocks of features per subject.  Tables: singular, weights,
    x_scores, y_scores, contrast and, when asked for, split."""
    spark = matrix.rows.sparkSession
    groups, width = len(matrix.groups), len(matrix.features)
    mode = effective_mode(mode, groups, n_cond)
    blocks = RS.make_blocks(matrix.rows, matrix.sizes, block_size)
    cells, n_moments = groups * n_cond, 1 + n_cond * width

    def cross(moments: np.ndarray) -> np.ndarray:
        means, counts = cell_means(moments[:, :n_moments], n_cond)
        return centre_means(means, counts, n_cond, mode)

    observed = dense(RS.plain_sums(blocks).toPandas(), groups, n_moments)  # groups x features numbers
    base = cross(observed)
    u, d, v = decompose(base)
    lvs = len(d)
    arrays = {"cross": base, "u": u, "d": d, "v": v}

    ids = thresholds = pvalues = None
    if n_perm > 0:
        ids, thresholds = RS.permutation_ids(blocks, n_perm, seed, n_cond)

        def one_permutation(pdf: pd.DataFrame) -> pd.DataFrame:
            _, dp, vp = decompose(cross(dense(pdf, groups, n_moments)))
            size = np.sqrt((align(v, vp, dp) ** 2).sum(axis=0)) if rotate else dp
            return pd.DataFrame({"resample": pdf["resample"].iloc[0], "lv": np.arange(lvs) + 1, "v": size})

        permuted = RS.permutation_sums(blocks, ids, seed, thresholds, n_cond).groupBy("resample").applyInPandas(
            one_permutation, "resample int, lv int, v double"
        )
        original = frame(spark, [(l + 1, float(d[l])) for l in range(lvs)], "lv int, v double")
        pvalues = permutation_pvalue(permuted, original)

    cell_labels = [(g, c) for g in matrix.groups for c in range(n_cond)]
    scaled = [(f, l + 1, float(u[f, l] * d[l])) for f in range(width) for l in range(lvs)]
    original_u = frame(spark, scaled, "feature int, lv int, v double")
    estimate = base @ u
    contrast = frame(
        spark,
        [(i, g, c, l + 1, float(estimate[i, l])) for i, (g, c) in enumerate(cell_labels) for l in range(lvs)],
        "cell int, condition string, cond int, lv int, estimate double",
    )
    weights = frame(
        spark, [(f, matrix.features[f], l + 1, float(u[f, l])) for f in range(width) for l in range(lvs)],
        "feature int, acronym string, lv int, weight double",
    )
    if n_boot > 0:
        boot, kept, _ = RS.drawn_until(
            n_boot, lambda n: RS.bootstrap_sums(blocks, n, seed), lambda s: RS.accepted_bootstraps(s, matrix.sizes, n_moments, n_boot)
        )
        unit_u = unit_columns(u)

        def one_bootstrap(pdf: pd.DataFrame) -> pd.DataFrame:
            r = cross(dense(pdf, groups, n_moments + RS.MARKS))
            ub, db, _ = decompose(r)
            turned, est = align(u, ub, db), r @ unit_u
            frames = []
            for kind, m in (("u", turned), ("c", est)):
                i, l = np.indices(m.shape)
                frames.append(pd.DataFrame({"kind": kind, "i": i.ravel(), "lv": l.ravel() + 1, "v": m.ravel()}))
            return pd.concat(frames)

        draws = (
            boot.join(kept, "resample", "left_semi").groupBy("resample")
            .applyInPandas(one_bootstrap, "kind string, i int, lv int, v double").persist()
        )
        ratios = bootstrap_ratio(
            draws.filter("kind = 'u'").withColumnRenamed("i", "feature"), ["feature", "lv"], original_u
        ).select("feature", "lv", "ratio", "se")
        weights = weights.join(ratios, ["feature", "lv"])
        interval = bootstrap_interval(
            draws.filter("kind = 'c'").withColumnRenamed("i", "cell"), ["cell", "lv"], ci
        )
        contrast = contrast.join(interval, ["cell", "lv"])
    else:
        nothing = F.lit(None).cast("double")
        weights = weights.withColumn("ratio", nothing).withColumn("se", nothing)
        contrast = contrast.withColumn("ll", nothing).withColumn("ul", nothing)
    live = frame(
        spark,
        [(l + 1, bool(d[l] > NULL_LV * max(d.max(initial=0.0), 1e-300))) for l in range(lvs)],
        "lv int, live boolean",
    )
    weights = weights.join(live, "lv").withColumn("ratio", F.when(F.col("live"), F.col("ratio"))).drop("live", "feature")
    y_weights = frame(
        spark, [(g, c, l + 1, float(v[i, l])) for i, (g, c) in enumerate(cell_labels) for l in range(lvs)],
        "condition string, cond int, lv int, weight double",
    )
    tables = {
        "singular": singular_table(spark, d, pvalues),
        "weights": weights,
        "y_weights": y_weights,
        "contrast": contrast.drop("cell"),
        "x_scores": _scores(blocks, u, n_cond, width),
    }
    if n_split:
        tables["split"] = _split_half(blocks, n_cond, cross, u, d, v, ids, thresholds, n_split, seed, ci)
    return PLSResult(tables, arrays)


def _scores(blocks: Blocks, u: np.ndarray, n_cond: int, width: int) -> DataFrame:
    """(animal_id, group, cond, lv, score)."""
    out = None
    for c in range(n_cond):
        padded = np.zeros((n_cond * width, u.shape[1]))
        padded[c * width:(c + 1) * width] = u
        part = project_rows(blocks, padded).select("animal_id", "group", F.lit(c).alias("cond"), "lv", "score")
        out = part if out is None else out.unionByName(part)
    return out


def _split_half(
    blocks: Blocks, n_cond: int, cross: Callable, u, d, v, ids: np.ndarray | None, thresholds: np.ndarray | None,
    n_split: int, seed: int, ci: float,
) -> DataFrame:
    """Split halves of the data (family 0) and of the permutations ``ids`` (families 1, ...), stratified by
    the permuted groups."""
    n = 1 + (0 if ids is None else len(ids))
    permuted = None if ids is None else RS.assignment(blocks, seed, thresholds, n_cond)

    def at(families: np.ndarray, sid: np.ndarray, group: int) -> np.ndarray:
        out = np.full((len(families), len(sid)), group)
        if families.any():
            out[families > 0] = permuted(ids[families[families > 0] - 1], sid)[0]
        return out

    def moments(left: pd.DataFrame) -> Callable[[int], np.ndarray]:
        sid, z = RS._stack(left)
        own = RS.products(z, RS.NO_PAIRS)

        def numbers(family: int) -> np.ndarray:
            order = permuted(ids[[family - 1]], sid)[1] if family and n_cond > 1 else None
            return own if order is None else RS.products(RS.in_order(z, order[0], n_cond), RS.NO_PAIRS)

        return numbers

    sums = RS.half_sums(blocks, blocks.rows.select("sid", "group", "block", "x"), n, n_split, seed, at, moments, u.shape[0] * n_cond)
    return _half_correlations(sums, cross, u, d, v, len(blocks.sizes), n_split, ci)


def _half_correlations(sums: DataFrame, cross: Callable, u, d, v, groups: int, n_split: int, ci: float) -> DataFrame:
    """Mean correlation of the projected halves per lv, with permutation p-value and interval.

    Each permutation's halves are projected on its own decomposition."""
    inv = safe_inverse(d)
    lvs = len(d)

    def one_slab(pdf: pd.DataFrame) -> pd.DataFrame:
        perm = int(pdf["perm"].iloc[0])
        numbers = np.frombuffer(pdf["v"].iloc[0], dtype="<f8")
        splits = min(RS.SLAB, n_split - int(pdf["slab"].iloc[0]) * RS.SLAB)
        m = numbers.reshape(1 + splits, groups, -1)
        if perm == 0:
            ud, vd = u * inv, v * inv
        else:
            up, dp, vp = decompose(cross(m[0]))
            ud, vd = up * safe_inverse(dp), vp * safe_inverse(dp)
        uc, vc = [], []
        for first in m[1:]:
            d1, d2 = cross(first), cross(m[0] - first)
            uc.append(column_correlation(d1.T @ vd, d2.T @ vd))
            vc.append(column_correlation(d1 @ ud, d2 @ ud))
        uc, vc = np.array(uc), np.array(vc)
        fine = ~np.isnan(uc), ~np.isnan(vc)
        return pd.DataFrame(
            {
                "perm": perm, "lv": np.arange(lvs) + 1,
                "us": np.nansum(uc, axis=0), "un": fine[0].sum(axis=0), "vs": np.nansum(vc, axis=0), "vn": fine[1].sum(axis=0),
            }
        )

    per_slab = sums.groupBy("perm", "slab").applyInPandas(one_slab, "perm int, lv int, us double, un long, vs double, vn long")
    corr = per_slab.groupBy("perm", "lv").agg(
        F.try_divide(F.sum("us"), F.sum("un").cast("double")).alias("ucorr"),
        F.try_divide(F.sum("vs"), F.sum("vn").cast("double")).alias("vcorr"),
    ).persist()
    out = corr.filter("perm = 0").select("lv", "ucorr", "vcorr")
    for side in ("ucorr", "vcorr"):
        draws = corr.filter("perm > 0").select(F.col("perm").alias("resample"), "lv", F.col(side).alias("v"))
        original = corr.filter("perm = 0").select("lv", F.col(side).alias("v"))
        p = permutation_pvalue(draws, original).withColumnRenamed("p", f"{side}_p")
        interval = bootstrap_interval(draws, ["lv"], ci).withColumnsRenamed({"ll": f"{side}_ll", "ul": f"{side}_ul"})
        out = out.join(p, "lv", "left").join(interval, "lv", "left")
    return out


# ------------------------------------------------------------------ behavioural PLS
def behavioral_pls(
    rows: DataFrame,
    sizes: Sequence[int],
    features: Sequence[str],
    behaviours: Sequence[str],
    groups: Sequence[str],
    covariance: bool = False,
    n_perm: int = 1000,
    n_boot: int = 1000,
    n_split: int | None = None,
    test_split: int | None = 100,
    test_size: float = 0.25,
    rotate: bool = True,
    ci: float = 95.0,
    seed: int = 0,
    block_size: int = RS.BLOCK_SIZE,
) -> PLSResult:
    """Cross-correlation PLS of ``rows(animal_id, group, x = [features | behaviours])``.

    Ratios and loading intervals come from one set of bootstraps: the candidates that pass the rules
    are drawn again over the scores.  With ``n_split`` the table split has p-values and intervals over
    the permutations."""
    spark = rows.sparkSession
    n_x, n_y, n_g = len(features), len(behaviours), len(groups)
    blocks = RS.make_blocks(rows, sizes, block_size)
    pairs = xcorr_indices(n_x, n_y)
    width = 1 + n_x + n_y + len(pairs[0])

    def cross(moments: np.ndarray) -> np.ndarray:
        return np.vstack([cross_from_moments(m[:width], n_x, n_y, covariance) for m in moments])

    observed = dense(RS.plain_sums(blocks, pairs).toPandas(), n_g, width)
    base = cross(observed)
    u, d, v = decompose(base)
    lvs = len(d)
    row_labels = [(g, b) for g in groups for b in behaviours]
    pvalues = paired = None
    if n_perm > 0:
        paired = RS.with_permuted(blocks, n_perm, seed, n_x).persist() if n_split else None
        sums, of_y = RS.paired_sums(blocks, n_perm, seed, n_x, n_y, pairs)

        def one_permutation(pdf: pd.DataFrame) -> pd.DataFrame:
            _, dp, vp = decompose(cross(RS.moments_with(observed, dense(pdf, n_g, n_y + len(of_y)), n_x, of_y)))
            size = np.sqrt((align(v, vp, dp) ** 2).sum(axis=0)) if rotate else dp
            return pd.DataFrame({"resample": pdf["resample"].iloc[0], "lv": np.arange(lvs) + 1, "v": size})

        draws = sums.groupBy("resample").applyInPandas(one_permutation, "resample int, lv int, v double")
        pvalues = permutation_pvalue(draws, frame(spark, [(l + 1, float(d[l])) for l in range(lvs)], "lv int, v double"))

    # y loadings: correlation of the scores with the behaviours, in every bootstrap as well
    scored = _with_scores(blocks, unit_columns(u), n_x)
    load_pairs = xcorr_indices(lvs, n_y)
    load_width = 1 + lvs + n_y + len(load_pairs[0])

    def loadings(moments: np.ndarray) -> np.ndarray:
        return np.vstack([cross_from_moments(m[:load_width], lvs, n_y, covariance) for m in moments])

    load = loadings(dense(RS.plain_sums(scored, load_pairs).toPandas(), n_g, load_width))
    weights = frame(
        spark, [(f, features[f], l + 1, float(u[f, l])) for f in range(n_x) for l in range(lvs)],
        "feature int, acronym string, lv int, weight double",
    )
    loading_table = frame(
        spark, [(i, g, b, l + 1, float(load[i, l])) for i, (g, b) in enumerate(row_labels) for l in range(lvs)],
        "cell int, condition string, behaviour string, lv int, loading double",
    )
    if n_boot > 0:
        boot, kept, candidates = RS.drawn_until(
            n_boot, lambda n: RS.bootstrap_sums(blocks, n, seed, pairs), lambda s: RS.accepted_bootstraps(s, sizes, width, n_boot)
        )

        def one_bootstrap(pdf: pd.DataFrame) -> pd.DataFrame:
            ub, db, _ = decompose(cross(dense(pdf, n_g, width + RS.MARKS)))
            m = align(u, ub, db)
            i, l = np.indices(m.shape)
            return pd.DataFrame({"feature": i.ravel(), "lv": l.ravel() + 1, "v": m.ravel()})

        draws = boot.join(kept, "resample", "left_semi").groupBy("resample").applyInPandas(
            one_bootstrap, "feature int, lv int, v double"
        )
        original = frame(spark, [(f, l + 1, float(u[f, l] * d[l])) for f in range(n_x) for l in range(lvs)], "feature int, lv int, v double")
        weights = weights.join(
            bootstrap_ratio(draws, ["feature", "lv"], original, extra=True).select("feature", "lv", "ratio", "se"), ["feature", "lv"]
        )

        def one_loading(pdf: pd.DataFrame) -> pd.DataFrame:
            m = loadings(dense(pdf, n_g, load_width + RS.MARKS))
            i, l = np.indices(m.shape)
            return pd.DataFrame({"cell": i.ravel(), "lv": l.ravel() + 1, "v": m.ravel()})

        load_draws = (
            RS.bootstrap_sums(scored, candidates, seed, load_pairs).join(kept, "resample", "left_semi")
            .groupBy("resample").applyInPandas(one_loading, "cell int, lv int, v double")
        )
        loading_table = loading_table.join(bootstrap_interval(load_draws, ["cell", "lv"], ci), ["cell", "lv"])
    tables = {
        "singular": singular_table(spark, d, pvalues),
        "weights": weights.drop("feature"),
        "y_weights": frame(
            spark, [(g, b, l + 1, float(v[i, l])) for i, (g, b) in enumerate(row_labels) for l in range(lvs)],
            "condition string, behaviour string, lv int, weight double",
        ),
        "y_loadings": loading_table.drop("cell"),
        "x_scores": project_rows(blocks, np.vstack([u, np.zeros((n_y, lvs))])).select("animal_id", "group", "lv", "score"),
    }
    if test_split and test_size > 0:
        tables["crossval"] = cross_validate(blocks, sizes, n_x, n_y, covariance, test_split, test_size, seed, behaviours)
    if n_split:
        tables["split"] = _behaviour_split_half(blocks, paired, cross, u, d, v, n_x, pairs, n_perm, n_split, seed, ci)
    return PLSResult(tables, {"cross": base, "u": u, "d": d, "v": v, "y_loadings": load})


def _with_scores(blocks: Blocks, unit_u: np.ndarray, n_x: int) -> Blocks:
    """The same blocks with ``x = [scores | behaviours]``."""
    scores = [
        F.aggregate(
            F.zip_with(F.slice("x", 1, n_x), F.array(*[number(w) for w in unit_u[:, l]]), lambda a, b: a * b),
            number(0), lambda s, x: s + x,
        )
        for l in range(unit_u.shape[1])
    ]
    rows = blocks.rows.withColumn("x", F.concat(F.array(*scores), F.slice("x", n_x + 1, F.size("x"))))
    return Blocks(rows, blocks.sizes, blocks.block_size)


def _split_masks(blocks: Blocks, sizes, n_split: int, seed: int, test_size: float) -> Callable:
    """Row masks of the first part of each split, recomputed in the tasks from the cut points."""
    own = blocks.rows.select(F.lit(0).alias("perm"), "sid", "group")
    cuts = RS.split_cuts(own, 1, sizes, n_split, seed, test_size)
    limits = RS.threshold_array(cuts, (1, n_split, len(sizes), 1), ["perm", "split", "group"])[0, :, :, 0]
    code = RS.stream(seed, RS.SPLIT_STREAM)

    def mask(sid: np.ndarray, group: int) -> np.ndarray:
        drawn = D.draw62(code, np.arange(n_split)[:, None], sid[None, :])
        return drawn <= limits[:, group][:, None]

    return mask


def _split_sums(blocks: Blocks, mask: Callable, n_split: int, pairs) -> DataFrame:
    """Moments per split and (group, part); cell = 2 * group + part, part 0 is the first."""

    def one(key, left: pd.DataFrame) -> pd.DataFrame:
        group = int(key[0])
        sid, z = RS._stack(left)
        first = mask(sid, group)
        ids = np.arange(n_split)
        return pd.concat(
            [
                RS._long(ids, group * 2 + part, RS.weighted_moments(m.astype(float), z, pairs))
                for part, m in ((0, first), (1, ~first))
            ]
        )

    return RS._sum_cells(blocks.rows.groupBy("group", "block").applyInPandas(one, RS.SUMS_SCHEMA))


def _behaviour_split_half(blocks, paired, cross, u, d, v, n_x, pairs, n_perm, n_split, seed, ci) -> DataFrame:
    """Split halves of the data and of each paired permutation, stratified by group."""

    def at(families: np.ndarray, sid: np.ndarray, group: int) -> np.ndarray:
        return np.full((len(families), len(sid)), group)

    def moments(left: pd.DataFrame) -> Callable[[int], np.ndarray]:
        z = np.array(left["x"].tolist(), dtype=float).reshape(len(left), -1)
        py = np.array(left["py"].tolist(), dtype=float).reshape(len(left), n_perm, -1) if n_perm else None
        return lambda family: RS.products(np.hstack([z[:, :n_x], py[:, family - 1]]) if family else z, pairs)

    rows = blocks.rows.withColumn("py", F.array().cast("array<double>")) if paired is None else paired
    sums = RS.half_sums(blocks, rows.select("sid", "group", "block", "x", "py"), 1 + n_perm, n_split, seed, at, moments, n_x + len(v) // len(blocks.sizes) * (1 + n_perm))
    return _half_correlations(sums, cross, u, d, v, len(blocks.sizes), n_split, ci)


def cross_validate(
    blocks: Blocks, sizes: Sequence[int], n_x: int, n_y: int, covariance: bool, n_split: int,
    test_size: float, seed: int, behaviours: Sequence[str],
) -> DataFrame:
    """(split, behaviour, pearson_r, r_squared) of the test rows.

    The first pass gives the training moments of every split, from which a linear predictor per group
    follows; the second pass takes the moments of prediction and truth over the test rows."""
    spark = blocks.rows.sparkSession
    pairs = xcorr_indices(n_x, n_y)
    width, n_g = 1 + n_x + n_y + len(pairs[0]), len(sizes)
    mask = _split_masks(blocks, sizes, n_split, seed, test_size)
    sums = _split_sums(blocks, mask, n_split, pairs)

    def predictor(pdf: pd.DataFrame) -> pd.DataFrame:
        train = dense(pdf, n_g * 2, width)[0::2]
        cross = np.vstack([cross_from_moments(m, n_x, n_y, covariance) for m in train])
        u, _, v = decompose(cross)
        out = []
        for g, m in enumerate(train):
            n = m[0]
            mean = m[1:1 + n_x + n_y] / n
            squares = m[-(n_x + n_y):][:n_x]
            sd = np.sqrt(np.maximum(squares - n * mean[:n_x] ** 2, 0.0) / max(n - 1, 1.0))
            inv = np.divide(1.0, sd, out=np.zeros_like(sd), where=sd > 1e-12)
            beta = (u @ v[g * n_y:(g + 1) * n_y].T) * inv[:, None]
            shift = mean[n_x:] - mean[:n_x] @ beta
            out.append({"split": pdf["resample"].iloc[0], "group": g, "coef": np.vstack([shift, beta]).ravel()})
        return pd.DataFrame(out)

    coefficients = sums.groupBy("resample").applyInPandas(predictor, "split int, group int, coef array<double>")
    beta = np.zeros((n_split, n_g, 1 + n_x, n_y))  # splits x groups x features: set by the design
    for row in coefficients.collect():
        beta[row["split"], row["group"]] = np.array(row["coef"]).reshape(1 + n_x, n_y)

    def scores(key, left: pd.DataFrame) -> pd.DataFrame:
        group = int(key[0])
        sid, z = RS._stack(left)
        test = (~mask(sid, group)).astype(float)
        y = z[:, n_x:]
        ones = np.hstack([np.ones((len(z), 1)), z[:, :n_x]])
        out = []
        for s in range(n_split):
            p = ones @ beta[s, group]
            m = np.hstack([np.ones((len(z), 1)), y, p, y * y, p * p, y * p, (y - p) ** 2])
            out.append(test[s] @ m)
        return RS._long(np.arange(n_split), 0, np.array(out))

    totals = RS._sum_cells(blocks.rows.groupBy("group", "block").applyInPandas(scores, RS.SUMS_SCHEMA))
    names = list(behaviours)

    def finish(pdf: pd.DataFrame) -> pd.DataFrame:
        m = dense(pdf, 1, 1 + 6 * n_y)[0]
        n, (sy, sp, syy, spp, syp, res) = m[0], m[1:].reshape(6, n_y)
        vy, vp, c = syy - sy**2 / n, spp - sp**2 / n, syp - sy * sp / n
        scale = np.sqrt(np.maximum(vy, 0) * np.maximum(vp, 0))
        r = np.clip(np.divide(c, scale, out=np.full(n_y, np.nan), where=scale > 0), -1, 1)
        r2 = 1.0 - np.divide(res, vy, out=np.full(n_y, np.nan), where=vy > 0)
        return pd.DataFrame({"split": pdf["resample"].iloc[0], "behaviour": names, "pearson_r": r, "r_squared": r2})

    return totals.groupBy("resample").applyInPandas(
        finish, "split int, behaviour string, pearson_r double, r_squared double"
    )


# ------------------------------------------------------------------ PLS regression
def regression_indices(n_x: int, n_y: int) -> tuple[np.ndarray, np.ndarray]:
    """Upper triangle of x products, then (x_i, y_j) j-major, then the y squares."""
    i, j = np.triu_indices(n_x)
    return (
        np.concatenate([i, np.tile(np.arange(n_x), n_y), n_x + np.arange(n_y)]),
        np.concatenate([j, np.repeat(n_x + np.arange(n_y), n_x), n_x + np.arange(n_y)]),
    )


@dataclass
class Simpls:
    x_weights: np.ndarray
    x_loadings: np.ndarray
    y_loadings: np.ndarray
    beta: np.ndarray
    pctvar: np.ndarray
    mse: np.ndarray
    mean: np.ndarray
    n: float


def simpls_from_moments(m: np.ndarray, n_x: int, n_y: int, n_components: int) -> Simpls:
    """The deflation needs only the centred Gram and cross matrices, so subjects never meet here."""
    n, sums = m[0], m[1:1 + n_x + n_y]
    rest = m[1 + n_x + n_y:]
    iu, n_tri = np.triu_indices(n_x), n_x * (n_x + 1) // 2
    gram = np.zeros((n_x, n_x))
    gram[iu] = rest[:n_tri]
    gram = gram + np.triu(gram, 1).T
    mean = sums / n
    gram = gram - n * np.outer(mean[:n_x], mean[:n_x])
    cov0 = rest[n_tri:n_tri + n_x * n_y].reshape(n_y, n_x).T - n * np.outer(mean[:n_x], mean[n_x:])
    yy = rest[n_tri + n_x * n_y:][:n_y] - n * mean[n_x:] ** 2
    weights, loads, y_loads, basis = (np.zeros((n_x, n_components)), np.zeros((n_x, n_components)),
                                      np.zeros((n_y, n_components)), np.zeros((n_x, n_components)))
    cov = cov0.copy()
    for c in range(n_components):
        direction = np.linalg.svd(cov, full_matrices=False)[0][:, 0]
        direction = direction * (np.sign(direction[np.abs(direction).argmax()]) or 1.0)
        length = np.sqrt(max(direction @ gram @ direction, 1e-300))
        weights[:, c] = direction / length
        loads[:, c] = gram @ weights[:, c]
        y_loads[:, c] = cov0.T @ weights[:, c]
        fresh = loads[:, c].copy()
        for _ in range(2):
            fresh -= basis[:, :c] @ (basis[:, :c].T @ fresh)
        basis[:, c] = fresh / max(np.linalg.norm(fresh), 1e-300)
        done = basis[:, :c + 1]
        for _ in range(2):
            cov = cov - done @ (done.T @ cov)
    slope = weights @ y_loads.T
    beta = np.vstack([mean[n_x:] - mean[:n_x] @ slope, slope])
    total = np.array([np.trace(gram), yy.sum()])
    explained = np.array([(loads**2).sum(axis=0), (y_loads**2).sum(axis=0)])
    # scores are orthonormal, so each component removes its squared loadings from the residual
    left = np.hstack([total[:, None], total[:, None] - np.cumsum(explained, axis=1)])
    return Simpls(weights, loads, y_loads, beta, explained / np.maximum(total, 1e-300)[:, None],
                  np.maximum(left, 0.0) / n, mean, n)


def globally_centred_cross(m: np.ndarray, mean: np.ndarray, n_x: int, n_y: int) -> np.ndarray:
    """Sum of (y - mean_y)(x - mean_x) over a resample, with the means of the original data."""
    n, sums = m[0], m[1:1 + n_x + n_y]
    start = 1 + n_x + n_y + n_x * (n_x + 1) // 2
    xy = m[start:start + n_x * n_y].reshape(n_y, n_x)
    mx, my = mean[:n_x], mean[n_x:]
    return xy - np.outer(my, sums[:n_x]) - np.outer(sums[n_x:], mx) + n * np.outer(my, mx)


def score_expressions(fit: Simpls, n_x: int, n_y: int) -> tuple[list[Column], list[Column]]:
    """x scores t_c and y scores (each orthogonal to the earlier x scores) as Column expressions."""
    def dot(start: int, length: int, w: np.ndarray, mean: np.ndarray) -> Column:
        return F.aggregate(
            F.zip_with(F.slice("x", start + 1, length), F.array(*[number(v) for v in w]), lambda a, b: a * b),
            number(-float(w @ mean)), lambda s, v: s + v,
        )

    xs = [dot(0, n_x, fit.x_weights[:, c], fit.mean[:n_x]) for c in range(fit.x_weights.shape[1])]
    ys = []
    for c in range(len(xs)):
        u = dot(n_x, n_y, fit.y_loadings[:, c], fit.mean[n_x:])
        for j in range(c):
            u = u - number(float(fit.y_loadings[:, j] @ fit.y_loadings[:, c])) * xs[j]
        ys.append(u)
    return xs, ys


def simpls(rows: DataFrame, features: Sequence[str], behaviours: Sequence[str], n_components: int | None = None,
           block_size: int = RS.BLOCK_SIZE) -> PLSResult:
    """PLS regression of ``rows(animal_id, x = [features | behaviours])``: weights, loadings, betas,
    explained variance, mean squared error, and per subject scores, residual norms and T2."""
    spark = rows.sparkSession
    n = rows.count()
    n_x, n_y = len(features), len(behaviours)
    n_components = n_components or min(n - 1, n_x)
    if n_components > min(n - 1, n_x):
        raise ValueError(f"n_components cannot exceed {min(n - 1, n_x)}")
    blocks = RS.make_blocks(rows.select("animal_id", F.lit(0).alias("group"), "x"), [n], block_size)
    pairs = regression_indices(n_x, n_y)
    width = 1 + n_x + n_y + len(pairs[0])
    fit = simpls_from_moments(dense(RS.plain_sums(blocks, pairs).toPandas(), 1, width)[0], n_x, n_y, n_components)
    xs, ys = score_expressions(fit, n_x, n_y)
    t2 = sum((t * t for t in xs[1:]), xs[0] * xs[0]) * number(n - 1)
    scores = blocks.rows.select(
        "animal_id", t2.alias("t2"),
        F.inline(F.array(*[F.struct(F.lit(c + 1).alias("component"), x.alias("x_score"), y.alias("y_score"))
                           for c, (x, y) in enumerate(zip(xs, ys))])),
    )
    names, fitted_by = [*features, *behaviours], np.vstack([fit.x_loadings, fit.y_loadings])

    def residuals(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            if len(pdf):
                z = np.array(pdf["x"].tolist(), dtype=float) - fit.mean
                left = z - (z[:, :n_x] @ fit.x_weights) @ fitted_by.T
                yield pd.DataFrame({"animal_id": np.repeat(pdf["animal_id"].to_numpy(), len(names)), "variable": names * len(pdf), "residual": left.ravel()})

    id_type = rows.schema["animal_id"].dataType.simpleString()
    comp = range(n_components)
    tables = {
        "x_weights": frame(spark, [(features[f], c + 1, float(fit.x_weights[f, c])) for f in range(n_x) for c in comp], "acronym string, component int, weight double"),
        "x_loadings": frame(spark, [(features[f], c + 1, float(fit.x_loadings[f, c])) for f in range(n_x) for c in comp], "acronym string, component int, loading double"),
        "y_loadings": frame(spark, [(behaviours[b], c + 1, float(fit.y_loadings[b, c])) for b in range(n_y) for c in comp], "behaviour string, component int, loading double"),
        "beta": frame(spark, [(n_, behaviours[b], float(fit.beta[i, b])) for i, n_ in enumerate(["(intercept)", *features]) for b in range(n_y)], "term string, behaviour string, beta double"),
        "pctvar": frame(spark, [(c + 1, float(fit.pctvar[0, c]), float(fit.pctvar[1, c])) for c in comp], "component int, x double, y double"),
        "mse": frame(spark, [(c, float(fit.mse[0, c]), float(fit.mse[1, c])) for c in range(n_components + 1)], "components int, x double, y double"),
        "scores": scores,
        "residuals": blocks.rows.select("animal_id", "x").mapInPandas(residuals, f"animal_id {id_type}, variable string, residual double"),
    }
    return PLSResult(tables, {"fit": fit})


AGGREGATES: dict[str, Callable] = {"mean": np.mean, "median": np.median, "sum": np.sum}


def pls_regression(
    rows: DataFrame,
    features: Sequence[str],
    behaviours: Sequence[str],
    n_components: int | None = None,
    depth: int = 1,
    aggfunc: str | Callable = "mean",
    n_perm: int = 1000,
    n_boot: int = 1000,
    rotate: bool = True,
    ci: float = 95.0,
    seed: int = 0,
    block_size: int = RS.BLOCK_SIZE,
) -> PLSResult:
    """SIMPLS with permutation and bootstrap inference.

    ``rows(animal_id, x)`` holds the features and then, per behaviour, ``depth`` repeats that are
    condensed by ``aggfunc``; with depth > 1 a bootstrap also redraws the repeats.  Samples without
    any feature or behaviour must be removed first (``row_mask``)."""
    spark = rows.sparkSession
    if isinstance(aggfunc, str):
        if aggfunc not in AGGREGATES:
            raise ValueError(f"aggfunc must be callable or one of {sorted(AGGREGATES)}")
        condense = AGGREGATES[aggfunc]
    else:
        condense = aggfunc
    n_x, n_y = len(features), len(behaviours)

    def condensed(z: np.ndarray, which: np.ndarray | None = None) -> np.ndarray:
        cube = z[:, n_x:].reshape(len(z), n_y, depth)
        if which is not None:
            cube = cube[:, :, which]
        return np.hstack([z[:, :n_x], condense(cube, axis=-1)])

    n = rows.count()
    n_components = n_components or min(n - 1, n_x)
    if n_components > min(n - 1, n_x):
        raise ValueError(f"n_components cannot exceed {min(n - 1, n_x)}")
    raw = RS.make_blocks(rows.select("animal_id", F.lit(0).alias("group"), "x"), [n], block_size)
    blocks = raw
    if depth > 1:
        def flatten(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for pdf in frames:
                z = np.array(pdf["x"].tolist(), dtype=float).reshape(len(pdf), -1)
                yield pdf.assign(x=list(condensed(z))) if len(pdf) else pdf

        blocks = Blocks(raw.rows.mapInPandas(flatten, raw.rows.schema).persist(), [n], block_size)
    pairs = regression_indices(n_x, n_y)
    width = 1 + n_x + n_y + len(pairs[0])
    fit_of = lambda m: simpls_from_moments(m, n_x, n_y, n_components)
    observed = dense(RS.plain_sums(blocks, pairs).toPandas(), 1, width)[0]
    fit = fit_of(observed)
    w, explained = fit.x_weights, fit.pctvar[1]
    pvalues = None
    if n_perm > 0:
        sums, of_y = RS.paired_sums(blocks, n_perm, seed, n_x, n_y, pairs)

        def one_permutation(pdf: pd.DataFrame) -> pd.DataFrame:
            m = RS.moments_with(observed[None], dense(pdf, 1, n_y + len(of_y)), n_x, of_y)
            share = fit_of(m[0]).pctvar[1]  # sign flips leave it unchanged
            return pd.DataFrame({"resample": pdf["resample"].iloc[0], "lv": np.arange(n_components) + 1, "v": share})

        draws = sums.groupBy("resample").applyInPandas(one_permutation, "resample int, lv int, v double")
        pvalues = permutation_pvalue(
            draws, frame(spark, [(l + 1, float(explained[l])) for l in range(n_components)], "lv int, v double")
        )
    table = frame(spark, [(l + 1, float(explained[l])) for l in range(n_components)], "lv int, varexp double")
    table = table.join(pvalues, "lv", "left") if pvalues is not None else table.withColumn("p", F.lit(None).cast("double"))
    weights = frame(
        spark, [(f, features[f], l + 1, float(w[f, l])) for f in range(n_x) for l in range(n_components)],
        "feature int, acronym string, lv int, weight double",
    )
    loads = frame(
        spark, [(b, behaviours[b], l + 1, float(fit.y_loadings[b, l])) for b in range(n_y) for l in range(n_components)],
        "cell int, behaviour string, lv int, loading double",
    )
    if n_boot > 0:
        repeats = None
        if depth > 1:
            code = RS.stream(seed, RS.CONDITION_STREAM)
            repeats = RS.Prepare(
                lambda r: tuple((D.draw62(code, np.array(r), np.arange(depth)) % depth).tolist()),
                lambda which, z: condensed(z, np.array(which)),
            )
        boot, kept, _ = RS.drawn_until(
            n_boot, lambda count: RS.bootstrap_sums(raw if depth > 1 else blocks, count, seed, pairs, repeats),
            lambda s: RS.accepted_bootstraps(s, [n], width, n_boot),
        )

        def one_bootstrap(pdf: pd.DataFrame) -> pd.DataFrame:
            m = dense(pdf, 1, width + RS.MARKS)[0][:width]
            b = fit_of(m)
            flip = np.sign(column_correlation(b.x_weights, w))
            flip[~(np.abs(flip) > 0)] = 1.0
            bw = b.x_weights * flip
            bl = globally_centred_cross(m, fit.mean, n_x, n_y) @ bw
            frames = []
            for kind, x in (("w", bw), ("y", bl)):
                i, l = np.indices(x.shape)
                frames.append(pd.DataFrame({"kind": kind, "i": i.ravel(), "lv": l.ravel() + 1, "v": x.ravel()}))
            return pd.concat(frames)

        draws = boot.join(kept, "resample", "left_semi").groupBy("resample").applyInPandas(
            one_bootstrap, "kind string, i int, lv int, v double"
        ).persist()
        original = frame(spark, [(f, l + 1, float(w[f, l])) for f in range(n_x) for l in range(n_components)], "feature int, lv int, v double")
        ratios = bootstrap_ratio(draws.filter("kind = 'w'").withColumnRenamed("i", "feature"), ["feature", "lv"], original, extra=True)
        weights = weights.join(ratios.select("feature", "lv", "ratio", "se"), ["feature", "lv"])
        loads = loads.join(bootstrap_interval(draws.filter("kind = 'y'").withColumnRenamed("i", "cell"), ["cell", "lv"], ci), ["cell", "lv"])
    xs, ys = score_expressions(fit, n_x, n_y)
    scores = blocks.rows.select(
        "animal_id",
        F.inline(F.array(*[F.struct(F.lit(c + 1).alias("lv"), x.alias("x_score"), y.alias("y_score"))
                           for c, (x, y) in enumerate(zip(xs, ys))])),
    )
    return PLSResult(
        {"singular": table, "weights": weights.drop("feature"), "y_loadings": loads.drop("cell"), "scores": scores},
        {"fit": fit},
    )


# ------------------------------------------------------------------ reports
def lv_pvalues(result: PLSResult) -> DataFrame:
    return result["singular"].select("lv", F.col("p").alias("p_value"))


def lv_estimate(result: PLSResult, lv: int = 1) -> DataFrame:
    """Estimate and half interval width of one latent variable per condition."""
    return result["contrast"].filter(F.col("lv") == lv).select(
        "condition", "cond", "lv", "estimate", (F.abs(F.col("ul") - F.col("ll")) / number(2)).alias("stderr")
    )


def salience(result: PLSResult, lv: int = 1, alpha: float = 0.05) -> DataFrame:
    """Bootstrap ratio and standard error per structure, with the two-sided significance flag."""
    table = result["weights"].filter(F.col("lv") == lv).withColumn("_limit", number(NormalDist().inv_cdf(1.0 - alpha / 2.0)))
    return table.select(
        "acronym", "lv", F.col("ratio").alias("salience"), F.col("se").alias("stderr"),
        (F.abs(F.col("ratio")) > F.col("_limit")).alias("significant"),
    )


def contrast_table(
    result: PLSResult, group_labels: dict[str, str] | None = None, condition_labels: Sequence[str] | None = None,
    group_order: Sequence[str] | None = None,
) -> DataFrame:
    """One row per (lv, group, condition) with estimate and limits, labelled and in a chosen order."""
    table = result["contrast"]
    label = F.col("condition")
    if group_labels:
        pairs = [F.lit(v) for kv in group_labels.items() for v in kv]
        label = F.coalesce(F.create_map(*pairs)[label], label)
    cond = F.col("cond").cast("string")
    if condition_labels:
        cond = F.get(F.array(*[F.lit(c) for c in condition_labels]), F.col("cond"))
    order = F.array_position(F.array(*[F.lit(g) for g in group_order]), F.col("condition")) if group_order else F.col("condition")
    return table.select(
        "lv", label.alias("group"), cond.alias("condition"), F.col("estimate").alias("Estimate"),
        F.col("ul").alias("UL"), F.col("ll").alias("LL"), order.alias("place"),
    ).orderBy("lv", "place", "condition")


def pls_sheets(result: PLSResult, values: DataFrame, lv: int = 1) -> dict[str, DataFrame]:
    """The four sheets of the app report."""
    return {
        "values": values,
        "lv_p_value": lv_pvalues(result),
        f"estimated_lv{lv}": lv_estimate(result, lv),
        "pls_salience": salience(result, lv),
    }
