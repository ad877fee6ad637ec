"""Group statistics: multiplicity correction, ANOVA, post-hoc tests and the analysis matrix."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from voxtally.functions.columns import col, number
from voxtally.functions.special import f_pvalue, harmonic, t_pvalue
from voxtally.operators.cells import gray_matter_leaves, in_conditions, require_rows
from voxtally.session import ensure_checkpoint_dir

METHODS = ("bonferroni", "sidak", "holm", "holm-sidak", "simes-hochberg", "fdr_bh", "fdr_by")


def adjust_pvalues(
    df: DataFrame,
    p: str = "p",
    family: Sequence[str] = (),
    method: str | None = "fdr_bh",
    alpha: float = 0.05,
    out: str = "p_corrected",
) -> DataFrame:
    """Add the corrected p-value and ``reject``.  NULL p-values are outside the family.

    Equal p-values share a corrected value.  A family is one window partition; it holds at most one
    p-value per structure, pair or both, whatever the number of animals."""
    if method is None:
        return df.withColumn(out, F.col(p)).withColumn("reject", F.col(p) <= number(alpha))
    if method not in METHODS:
        raise ValueError(f"unsupported correction method {method!r}; use one of {METHODS}")
    keys = list(family) or ["_family"]
    tagged = df if family else df.withColumn("_family", F.lit(1))
    family_of = Window.partitionBy(*keys)
    up, down = family_of.orderBy("_p"), family_of.orderBy(F.col("_p").desc())  # frames that take in ties
    pv, last = F.col("_p"), F.col("_last")
    ranked = tagged.withColumn("_p", F.col(p)).withColumns({
        "_m": F.count("_p").over(family_of), "_last": F.count("_p").over(up), "_c": F.count("_p").over(Window.partitionBy(*keys, "_p")),
    })
    m, first = F.col("_m").cast("double"), last - F.col("_c")  # ranks before this p-value
    if method == "bonferroni":
        adjusted = pv * m
    elif method == "sidak":
        adjusted = -F.expm1(m * F.log1p(-pv))
    elif method == "holm":
        adjusted = F.max(pv * (m - first)).over(up)
    elif method == "holm-sidak":
        adjusted = F.max(-F.expm1((m - first) * F.log1p(-pv))).over(up)
    elif method == "simes-hochberg":
        adjusted = F.min(pv * (m - last + number(1))).over(down)
    else:
        raw = pv * m / F.greatest(last, F.lit(1))
        if method == "fdr_by":
            raw = raw * harmonic(F.greatest("_m", F.lit(1)))
        adjusted = F.min(raw).over(down)
    corrected = ranked.withColumn(out, F.when(pv.isNotNull(), F.least(adjusted, number(1))))
    return corrected.withColumn("reject", F.col(out) <= number(alpha)).select(*df.columns, out, "reject")


def group_moments(results: DataFrame, keys: Sequence[str], values: str) -> DataFrame:
    """n, mean and the centred sum of squares of the non-null values per key (mergeable)."""
    v = col(values).cast("double")
    return results.groupBy(*keys).agg(
        F.count(v).alias("n"),
        F.avg(v).alias("mean"),
        (F.coalesce(F.var_pop(v), number(0)) * F.count(v)).alias("m2"),
    )


def condition_moments(results: DataFrame, condition: str, values: str) -> DataFrame:
    """The moments per structure and condition, kept: one pass over the results serves every test."""
    ensure_checkpoint_dir(results.sparkSession)
    return group_moments(results, ["acronym", condition], values).checkpoint()


def anova(
    results: DataFrame,
    condition: str,
    values: str,
    min_group_size: int = 1,
    alpha: float = 0.05,
    method: str | None = "fdr_bh",
    moments: DataFrame | None = None,
) -> DataFrame:
    """One-way ANOVA per structure: acronym, F, p, p_corrected, reject.

    A structure is tested when every condition of the table occurs for it and its smallest
    non-null group has ``min_group_size`` values.  ``moments`` are those of ``condition_moments``,
    if they are there already."""
    moments = condition_moments(results, condition, values) if moments is None else moments
    moments = moments.filter(F.col(condition).isNotNull())
    n_conditions = moments.agg(F.count_distinct(condition)).scalar()
    per_structure = moments.groupBy("acronym").agg(
        F.count(F.lit(1)).alias("k"),
        F.min("n").alias("smallest"),
        F.sum("n").alias("total"),
        F.try_divide(F.sum(F.col("n") * F.col("mean")), F.sum("n").cast("double")).alias("grand"),
        F.sum("m2").alias("within"),
        F.collect_list(F.struct("n", "mean")).alias("groups"),
    )
    tested = per_structure.filter(
        (F.col("k") == n_conditions) & (F.col("smallest") >= max(int(min_group_size), 1))
    )
    between = F.aggregate(
        "groups", number(0),
        lambda s, g: s + g["n"] * (g["mean"] - F.col("grand")) * (g["mean"] - F.col("grand")),
    )
    df1, df2 = (F.col("k") - 1).cast("double"), (F.col("total") - F.col("k")).cast("double")
    ratio = F.try_divide(F.try_divide(F.col("between"), df1), F.try_divide(F.col("within"), df2))
    scored = tested.withColumn("between", between).select(
        "acronym",
        F.when((F.col("within") == 0) & (F.col("between") > 0) & (df2 > 0), F.lit(float("inf")))
        .otherwise(ratio).alias("F"),
        df1.alias("_df1"), df2.alias("_df2"),
    )
    with_p = scored.withColumn("p", f_pvalue("F", "_df1", "_df2")).drop("_df1", "_df2")
    return adjust_pvalues(with_p, "p", (), method, alpha)


def posthoc_long(
    results: DataFrame,
    anova_table: DataFrame,
    condition: str,
    values: str,
    pairs: DataFrame,
    method: str | None = "fdr_bh",
    moments: DataFrame | None = None,
) -> DataFrame:
    """Pooled two-sample t per rejected structure and pair(a, b): acronym, a, b, t, p,
    p_corrected.  All structure x pair p-values form one correction family."""
    rejected = anova_table.filter("reject").select("acronym")
    moments = condition_moments(results, condition, values) if moments is None else moments
    moments = moments.join(rejected, "acronym", "left_semi")
    side = lambda tag: moments.select(
        "acronym", F.col(condition).alias(tag), *[F.col(c).alias(f"{c}_{tag}") for c in ("n", "mean", "m2")]
    )
    both = pairs.join(side("a"), "a").join(side("b"), ["acronym", "b"])
    df = (F.col("n_a") + F.col("n_b") - 2).cast("double")
    pooled = F.try_divide(F.col("m2_a") + F.col("m2_b"), df)
    se = F.sqrt(pooled * (number(1) / F.col("n_a") + number(1) / F.col("n_b")))
    both = both.filter((F.col("n_a") > 0) & (F.col("n_b") > 0) & (df > 0))
    tested = both.select(
        "acronym", "a", "b",
        F.try_divide(F.col("mean_a") - F.col("mean_b"), se).alias("t"), df.alias("_df"),
    )
    with_p = tested.withColumn("p", t_pvalue("t", "_df")).drop("_df")
    return adjust_pvalues(with_p, "p", (), method).drop("reject")


def posthoc(
    results: DataFrame,
    anova_table: DataFrame,
    condition: str,
    values: str,
    pairs: Sequence[tuple[str, str]],
    method: str | None = "fdr_bh",
    moments: DataFrame | None = None,
) -> DataFrame:
    """The wide sheet: one 'a-b' column of corrected p-values per pair of condition values."""
    spark = results.sparkSession
    table = spark.createDataFrame([tuple(p) for p in pairs], "a string, b string")
    long = posthoc_long(results, anova_table, condition, values, table, method, moments)
    return (
        long.withColumn("_pair", F.concat_ws("-", "a", "b"))
        .groupBy("acronym").pivot("_pair", [f"{a}-{b}" for a, b in pairs]).agg(F.max("p_corrected"))
    )


def contrast(
    results: DataFrame,
    condition: str,
    values: str,
    pairs: Sequence[tuple[str, str]],
    min_group_size: int = 1,
    alpha: float = 0.05,
    method: str | None = "fdr_bh",
) -> tuple[DataFrame, DataFrame]:
    """Gray-matter leaves -> ANOVA -> post-hoc."""
    leaves = gray_matter_leaves(results)
    moments = condition_moments(leaves, condition, values)
    table = anova(leaves, condition, values, min_group_size, alpha, method, moments)
    return table, posthoc(leaves, table, condition, values, pairs, method, moments)


# ------------------------------------------------------------------ analysis matrix
def columns_with_coverage(results: DataFrame, condition: str, values: str, minimum: int) -> DataFrame:
    """Acronyms with at least ``minimum`` non-null values in every condition of the table."""
    counts = results.groupBy("acronym", condition).agg(F.count(col(values)).alias("n"))
    n_conditions = counts.agg(F.count_distinct(condition)).scalar()
    return (
        counts.filter(F.col("n") >= minimum)
        .groupBy("acronym").agg(F.count(F.lit(1)).alias("k"))
        .filter((F.col("k") == n_conditions) | F.lit(minimum <= 0))
        .select("acronym")
    )


@dataclass
class Matrix:
    """Subjects x structures.  ``rows(animal_id, group, x)`` stays distributed; the driver holds
    only the names, whose number is bounded by the atlas, and the group labels and sizes."""

    rows: DataFrame
    features: list[str]
    groups: list[str]
    sizes: list[int]


def animal_values(results: DataFrame, values: str, condition: str) -> DataFrame:
    """(animal_id, condition, _v): one row per (animal, condition) with its values by acronym, kept, so
    that the results are gone through once.  A duplicate (animal, condition, acronym) fails the job."""
    present = results.select("animal_id", condition, "acronym", col(values).cast("double").alias("v"))
    ensure_checkpoint_dir(results.sparkSession)
    return present.groupBy("animal_id", condition).agg(
        F.map_from_entries(F.collect_list(F.struct("acronym", "v"))).alias("_v")
    ).checkpoint()


def values_long(wide: DataFrame, condition: str) -> DataFrame:
    return wide.select("animal_id", condition, F.explode("_v").alias("acronym", "v"))


def matrix_rows(wide: DataFrame, condition: str, features: Sequence[str]) -> DataFrame:
    """``animal_values`` as rows with ``x`` in the order of ``features``, missing values filled with the
    condition mean."""
    wanted = values_long(wide, condition).filter(F.col("acronym").isin(*features))
    means = (
        wanted.groupBy(condition, "acronym").agg(F.avg("v").alias("m"))
        .groupBy(condition).agg(F.map_from_entries(F.collect_list(F.struct("acronym", "m"))).alias("_means"))
    )
    names = F.array(*[F.lit(f) for f in features])
    filled = F.transform(names, lambda f: F.coalesce(F.col("_v")[f], F.col("_means")[f]))
    # a row per condition; a merge would bring all animals of a condition into one task
    return wide.join(F.broadcast(means), condition, "left").select("animal_id", condition, filled.alias("x"))


def analysis_filter(
    results: DataFrame, condition: str, conditions: Sequence[str] | None
) -> DataFrame:
    return gray_matter_leaves(in_conditions(results, condition, conditions))


def build_matrix(
    results: DataFrame,
    values: str,
    condition: str,
    min_per_group: int,
    conditions: Sequence[str] | None = None,
) -> Matrix:
    leaves = analysis_filter(results, condition, conditions)
    wide = animal_values(leaves, values, condition)
    kept = columns_with_coverage(values_long(wide, condition), condition, "v", min_per_group)
    features = sorted(r[0] for r in kept.collect())  # bounded by the number of atlas structures
    if not features:
        raise ValueError("no structure has enough gray-matter values in every condition")
    rows = matrix_rows(wide, condition, features).persist()
    counts = rows.groupBy(condition).count().collect()  # one row per condition value
    sizes = dict(sorted((r[0], r[1]) for r in counts))
    labels = list(sizes)
    index = F.array_position(F.array(*[F.lit(g) for g in labels]), F.col(condition)) - 1
    return Matrix(
        rows.select("animal_id", condition, index.cast("int").alias("group"), "x"),
        features, labels, [sizes[g] for g in labels],
    )


def group_sizes(results: DataFrame, condition: str) -> DataFrame:
    """Samples per condition."""
    return (
        results.select("animal_id", condition).distinct()
        .groupBy(condition).agg(F.count(F.lit(1)).alias("n"))
    )


def matrix_long(matrix: Matrix, condition: str) -> DataFrame:
    names = F.array(*[F.lit(f) for f in matrix.features])
    return matrix.rows.select("animal_id", condition, F.posexplode("x").alias("_k", "value")).select(
        "animal_id", condition, F.get(names, F.col("_k")).alias("acronym"), "value"
    )


def pivot_animals(results: DataFrame, condition: str, values: str, acronyms: Sequence[str]) -> DataFrame:
    """(animal, condition) x acronym sheet.  A duplicate (animal, condition, acronym) fails."""
    single = F.when(F.count(F.lit(1)) > 1, F.raise_error("duplicate value in pivot").cast("double")).otherwise(
        F.max(col(values).cast("double"))
    )
    unique = results.groupBy("animal_id", condition, "acronym").agg(single.alias("v"))
    return unique.groupBy("animal_id", condition).pivot("acronym", list(acronyms)).agg(F.max("v"))


def impute_by_condition_mean(results: DataFrame, condition: str, values: str) -> DataFrame:
    """Long form of the filled matrix: every animal x every acronym of its condition."""
    v = col(values).cast("double")
    base = results.select("animal_id", condition, "acronym", v.alias("v"))
    means = base.groupBy(condition, "acronym").agg(F.avg("v").alias("_m"))
    lists = means.groupBy(condition).agg(F.collect_list(F.struct("acronym", "_m")).alias("_l"))
    grid = base.select("animal_id", condition).distinct().join(lists, condition).select(
        "animal_id", condition, F.inline("_l")
    )
    return grid.join(base, ["animal_id", condition, "acronym"], "left").select(
        "animal_id", condition, "acronym", F.coalesce("v", "_m").alias("value")
    )
