"""Queries over the results table: tests, matrix, network and partial least squares."""

from __future__ import annotations

import itertools

import numpy as np
from pyspark.sql import functions as F

from voxtally.functions import special
from voxtally.functions.columns import number
from voxtally.operators import analysis as A
from voxtally.operators import network as N
from voxtally.operators import pls as L
from voxtally.operators import regions as G
from voxtally.operators import resample as RS
from voxtally.operators import stats as T
from voxtally.operators import slices as S
from voxtally.operators.cells import gray_matter_leaves
from voxtally.plans import project as P
from voxtally.plans.registry import RESULTS, STRUCTURES, VOXELS, R, draw_ctes, query, rounded

SEED = 7
CONDITIONS = ("AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY")
PAIRS = tuple(itertools.combinations(CONDITIONS, 2))
# Structures without gray-matter cells everywhere are dropped by coverage, so a small minimum is enough.
MIN_PER_GROUP = 2

# Every kind of analysis works on the counts per animal and leaf structure.
FILTERED = f"""{RESULTS},
kept AS (SELECT acronym FROM (SELECT acronym, condition, count(cells) AS n FROM leaves GROUP BY 1, 2)
  WHERE n >= {MIN_PER_GROUP} GROUP BY 1 HAVING count(*) = (SELECT count(DISTINCT condition) FROM leaves)),
animals AS (SELECT DISTINCT animal_id, condition FROM leaves),
filled AS (SELECT a.animal_id, a.condition, k.acronym,
    coalesce(CAST(l.cells AS DOUBLE), avg(CAST(l.cells AS DOUBLE)) OVER (PARTITION BY a.condition, k.acronym)) AS v
  FROM animals a CROSS JOIN kept k LEFT JOIN leaves l ON l.animal_id = a.animal_id AND l.acronym = k.acronym)"""

ANOVA = f"""{RESULTS},
mom AS (SELECT acronym, condition, count(cells) AS n, avg(cells) AS mean, count(cells) * var_pop(cells) AS m2 FROM leaves GROUP BY 1, 2),
tot AS (SELECT acronym, count(*) AS k, sum(n) AS total, sum(n * mean) / sum(n) AS grand, sum(m2) AS within FROM mom
  GROUP BY 1 HAVING min(n) >= 2 AND count(*) = (SELECT count(DISTINCT condition) FROM leaves)),
fstat AS (SELECT acronym, k, total, (sum(n * (mean - grand) * (mean - grand)) / (k - 1)) / (within / (total - k)) AS f
  FROM mom JOIN tot USING (acronym) GROUP BY acronym, k, total, within),
pval AS (SELECT acronym, f, pow(x, a) * (1 + a * (1 - x)) AS p FROM (
  SELECT acronym, f, (total - k) / CAST(2 AS DOUBLE) AS a, (total - k) / ((total - k) + 4 * f) AS x FROM fstat)),
anova AS (SELECT acronym, f, p, least(min(p * m / rk) OVER (ORDER BY p ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING), 1) AS p_corrected
  FROM (SELECT *, count(*) OVER () AS m, row_number() OVER (ORDER BY p) AS rk FROM pval))"""

# Two-sided t tail by Simpson's rule on the angle arctan(t / sqrt(df)).
T_TAIL = """
  tnode AS (SELECT *, atan(abs(t) / sqrt(df)) AS a0, least(pi() / 2, atan(abs(t) / sqrt(df)) + 12 / sqrt(df)) AS a1 FROM tin),
  tail AS (SELECT {keys}, t, df,
    2 * exp(lgamma((df + 1) / 2) - lgamma(df / 2)) / sqrt(pi()) * (a1 - a0) / 6000
      * sum(CASE WHEN i = 0 OR i = 2000 THEN 1 WHEN i % 2 = 1 THEN 4 ELSE 2 END
        * pow(greatest(cos(a0 + (a1 - a0) * i / 2000), 0), df - 1)) AS p
    FROM tnode CROSS JOIN (SELECT unnest(range(2001)) AS i) GROUP BY {keys}, t, df, a0, a1)"""


def _leaves(spark, sf):
    return gray_matter_leaves(P.results(spark, sf))


def _matrix(spark, sf):
    return T.build_matrix(P.results(spark, sf), "cells", "condition", MIN_PER_GROUP)


# ---------------------------------------------------------------- tests
@query("anova", f"""WITH {ANOVA} SELECT acronym, {R("f")} AS "F", {R("p")} AS p, {R("p_corrected")} AS p_corrected,
  p_corrected <= CAST(0.05 AS DOUBLE) AS reject FROM anova""")
def anova(spark, sf):
    return rounded(T.anova(_leaves(spark, sf), "condition", "cells", 2))


POSTHOC = f"""{ANOVA},
tin AS (SELECT p.acronym, p.condition AS a, q.condition AS b, (p.mean - q.mean)
    / sqrt((p.m2 + q.m2) / (p.n + q.n - 2) * (1 / CAST(p.n AS DOUBLE) + 1 / CAST(q.n AS DOUBLE))) AS t,
    CAST(p.n + q.n - 2 AS DOUBLE) AS df
  FROM mom p JOIN mom q ON p.acronym = q.acronym AND p.condition < q.condition
  JOIN anova ON anova.acronym = p.acronym AND anova.p_corrected <= CAST(0.9 AS DOUBLE)),
{T_TAIL.format(keys="acronym, a, b")},
post AS (SELECT acronym, a, b, t, p, least(min(p * m / rk) OVER (ORDER BY p ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING), 1) AS p_corrected
  FROM (SELECT *, count(*) OVER () AS m, row_number() OVER (ORDER BY p) AS rk FROM tail))"""


@query("posthoc", f"""WITH {POSTHOC} SELECT acronym, a, b, {R("t")} AS t, {R("p")} AS p, {R("p_corrected")} AS p_corrected FROM post""")
def posthoc(spark, sf):
    leaves = _leaves(spark, sf)
    moments = T.condition_moments(leaves, "condition", "cells")
    table = T.anova(leaves, "condition", "cells", 2, alpha=0.9, moments=moments)
    pairs = S.possible_contrasts(moments)
    return rounded(T.posthoc_long(leaves, table, "condition", "cells", pairs, moments=moments))


@query("contrast", f"""WITH {POSTHOC} SELECT acronym, {", ".join(
    f'''{R(f"max(CASE WHEN a = '{a}' AND b = '{b}' THEN p_corrected END)")} AS "{a}-{b}"''' for a, b in PAIRS)} FROM post GROUP BY 1""")
def contrast(spark, sf):
    return rounded(T.contrast(P.results(spark, sf), "condition", "cells", PAIRS, 2, 0.9)[1])


def _adjust_sql() -> str:
    parts = []
    body = """p AS (SELECT l_shipdate AS family, l_orderkey AS id, l_linenumber AS line, l_suppkey AS s, (l_partkey * 7919 % 10007 + 1) / CAST(10008 AS DOUBLE) AS p FROM lineitem),
      r AS (SELECT *, count(*) OVER (PARTITION BY family) AS m, rank() OVER w AS r0,
        rank() OVER w + count(*) OVER (PARTITION BY family, p) - 1 AS r1 FROM p WINDOW w AS (PARTITION BY family ORDER BY p))"""
    up = "max({e}) OVER (PARTITION BY family ORDER BY p)"
    down = "min({e}) OVER (PARTITION BY family ORDER BY p DESC)"
    forms = {
        "bonferroni": "p * m",
        "sidak": "1 - pow(1 - p, m)",
        "holm": up.format(e="p * (m - r0 + 1)"),
        "holm-sidak": up.format(e="1 - pow(1 - p, m - r0 + 1)"),
        "simes-hochberg": down.format(e="p * (m - r1 + 1)"),
        "fdr_bh": down.format(e="p * m / r1"),
        "fdr_by": down.format(e="p * m / r1 * list_sum(list_transform(range(1, m + 1), lambda i: 1 / CAST(i AS DOUBLE)))"),
    }
    for name, e in forms.items():
        parts.append(f"SELECT '{name}' AS method, id, line, s, {R('p')} AS p, {R(f'least({e}, 1)')} AS p_corrected FROM r")
    return f"WITH {body} " + " UNION ALL ".join(parts)


@query("adjust_pvalues", _adjust_sql())
def adjust_pvalues(spark, sf):
    """Every correction method on one p-value per line item, families by ship date."""
    source = P.table(spark, sf, "lineitem").select(
        F.col("l_shipdate").alias("family"), F.col("l_orderkey").alias("id"), F.col("l_linenumber").alias("line"),
        F.col("l_suppkey").alias("s"),
        (((F.col("l_partkey") * 7919) % 10007 + 1).cast("double") / number(10008)).alias("p"),
    )
    out = None
    for method in T.METHODS:
        part = T.adjust_pvalues(source, "p", ["family"], method).select(
            F.lit(method).alias("method"), "id", "line", "s", "p", "p_corrected"
        )
        out = part if out is None else out.unionByName(part)
    return rounded(out)


@query("paint_f", f"""WITH {ANOVA}, {VOXELS} SELECT z, y, x, struct_id, {R("coalesce(f, 0)")} AS value FROM voxels
  LEFT JOIN (SELECT s.id, f FROM anova JOIN structures s USING (acronym) WHERE p_corrected <= CAST(0.9 AS DOUBLE)) q ON q.id = struct_id""")
def paint_f(spark, sf):
    table = T.anova(_leaves(spark, sf), "condition", "cells", 2, alpha=0.9).filter("reject")
    return rounded(G.paint(P.voxels(spark, sf), table, P.structures(spark, sf), "F"))


def _horner(coefficients, x: str) -> str:
    total = f"CAST({coefficients[0]!r} AS DOUBLE)"
    for c in coefficients[1:]:
        total = f"({total} * {x} + CAST({c!r} AS DOUBLE))"
    return total


_Q, _S = "(CAST(0.5 AS DOUBLE) - p)", "sqrt(-2 * ln(least(p, 1 - p)))"
_OUTER = f"{_horner(special.QUANTILE_C, _S)} / {_horner(special.QUANTILE_D, _S)}"
# The quantile of 1 - p.
UPPER_QUANTILE = f"""CASE WHEN p = 0 THEN CAST('inf' AS DOUBLE) WHEN p = 1 THEN CAST('-inf' AS DOUBLE) WHEN p > 1 - {special.QUANTILE_TAIL} THEN {_OUTER}
  WHEN p < {special.QUANTILE_TAIL} THEN -({_OUTER}) ELSE {_horner(special.QUANTILE_A, f'({_Q} * {_Q})')} * {_Q} / {_horner(special.QUANTILE_B, f'({_Q} * {_Q})')} END"""


@query("paint_z", f"""WITH {POSTHOC}, {VOXELS}, z AS (SELECT acronym, {UPPER_QUANTILE} AS z FROM (SELECT acronym, p_corrected AS p FROM post WHERE a = 'AUTOMOBILE' AND b = 'BUILDING'))
  SELECT z, y, x, struct_id, {R("coalesce(q.score, 0)", 4)} AS value FROM voxels LEFT JOIN (SELECT s.id, z.z AS score FROM z JOIN structures s USING (acronym)) q ON q.id = struct_id""")
def paint_z(spark, sf):
    """z = quantile of 1 - p on the voxels of each structure, p the corrected post-hoc p of one pair."""
    leaves = _leaves(spark, sf)
    moments = T.condition_moments(leaves, "condition", "cells")
    table = T.anova(leaves, "condition", "cells", 2, alpha=0.9, moments=moments)
    every = T.posthoc_long(leaves, table, "condition", "cells", S.possible_contrasts(moments), moments=moments)
    scored = every.filter((F.col("a") == "AUTOMOBILE") & (F.col("b") == "BUILDING")).select("acronym", special.normal_quantile(number(1) - F.col("p_corrected")).alias("z_score"))
    return rounded(G.paint(P.voxels(spark, sf), scored, P.structures(spark, sf), "z_score"), 4)


# ---------------------------------------------------------------- matrix
@query("group_sizes", f"WITH {RESULTS} SELECT condition, count(DISTINCT animal_id) AS n FROM leaves GROUP BY 1")
def group_sizes(spark, sf):
    return T.group_sizes(_leaves(spark, sf), "condition")


@query("columns_with_coverage", f"WITH {FILTERED} SELECT acronym FROM kept")
def columns_with_coverage(spark, sf):
    return T.columns_with_coverage(_leaves(spark, sf), "condition", "cells", MIN_PER_GROUP)


@query("impute_by_condition_mean", f"""WITH {RESULTS}, g AS (SELECT DISTINCT condition, acronym FROM leaves),
  m AS (SELECT condition, acronym, avg(CAST(cells AS DOUBLE)) AS m FROM leaves GROUP BY 1, 2),
  a AS (SELECT DISTINCT animal_id, condition FROM leaves)
  SELECT a.animal_id, condition, acronym, {R("coalesce(CAST(cells AS DOUBLE), m)")} AS value
  FROM a JOIN g USING (condition) JOIN m USING (condition, acronym) LEFT JOIN leaves USING (animal_id, condition, acronym)""")
def impute_by_condition_mean(spark, sf):
    return rounded(T.impute_by_condition_mean(_leaves(spark, sf), "condition", "cells"))


ALL_LEAVES = [f"N{i}" for i in range(25)]


@query("pivot_animals", f"""WITH {RESULTS} SELECT animal_id, condition, {", ".join(
    f'''CAST(max(CASE WHEN acronym = '{a}' THEN cells END) AS DOUBLE) AS "{a}"''' for a in ALL_LEAVES)} FROM leaves GROUP BY 1, 2""")
def pivot_animals(spark, sf):
    return T.pivot_animals(_leaves(spark, sf), "condition", "cells", ALL_LEAVES)


@query("pls_matrix", f"WITH {FILTERED} SELECT animal_id, condition, acronym, {R('v')} AS value FROM filled")
def pls_matrix(spark, sf):
    return rounded(T.matrix_long(_matrix(spark, sf), "condition"))


# ---------------------------------------------------------------- network
CORRELATION = f"""{FILTERED},
z AS (SELECT animal_id, acronym, v - avg(v) OVER (PARTITION BY acronym) AS v FROM filled),
pairs AS (SELECT p.acronym AS a, q.acronym AS b, count(*) AS n,
  sum(p.v * q.v) / sqrt(sum(p.v * p.v) * sum(q.v * q.v)) AS r
  FROM z p JOIN z q ON p.animal_id = q.animal_id AND p.acronym < q.acronym GROUP BY 1, 2)"""


def _network_blocks(spark, sf):
    m = _matrix(spark, sf)
    return m, N.network_blocks(m.rows, sum(m.sizes), len(m.features))


def _named(df, features):
    names = F.array(*[F.lit(f) for f in features])
    rest = [c for c in df.columns if c not in ("i", "j")]
    return df.select(F.get(names, F.col("i")).alias("a"), F.get(names, F.col("j")).alias("b"), *rest)


@query("correlation", f"WITH {CORRELATION} SELECT a, b, n, {R('r')} AS r FROM pairs")
def correlation(spark, sf):
    m, blocks = _network_blocks(spark, sf)
    return rounded(_named(N.correlation(blocks, len(m.features)), m.features))


@query("region_pairs", f"""WITH {RESULTS} SELECT p.acronym AS a, q.acronym AS b, count(*) AS n_animals
  FROM leaves p JOIN leaves q ON p.animal_id = q.animal_id AND p.acronym < q.acronym GROUP BY 1, 2""")
def region_pairs(spark, sf):
    return N.region_pairs(_leaves(spark, sf))


EDGES = f"""{CORRELATION},
tin AS (SELECT a, b, r, r * sqrt(df / (1 - r * r)) AS t, df
  FROM (SELECT *, CAST((SELECT count(*) FROM animals) - 2 AS DOUBLE) AS df FROM pairs)),
{T_TAIL.format(keys="a, b, r")},
edges AS (SELECT a, b, r, p, least(min(p * m / rk) OVER (ORDER BY p ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING), 1) AS pvalue
  FROM (SELECT *, count(*) OVER () AS m, row_number() OVER (ORDER BY p) AS rk FROM tail))"""


@query("edge_pvalues", f"WITH {EDGES} SELECT a, b, {R('r')} AS r, {R('p')} AS p, {R('pvalue')} AS pvalue FROM edges")
def edge_pvalues(spark, sf):
    m, blocks = _network_blocks(spark, sf)
    edges = N.edge_pvalues(N.correlation(blocks, len(m.features)), sum(m.sizes))
    return rounded(_named(edges, m.features).drop("n"))


N_BOOT = 1000
BOOT_DRAWS = f"""
ordered AS (SELECT animal_id, condition, row_number() OVER (ORDER BY animal_id) - 1 AS pos FROM animals),
size AS (SELECT count(*) AS n FROM animals)"""


# Weights of every bootstrap, its correlations, and the share with a larger absolute value, corrected over all pairs.
BOOTSTRAP = f"""{EDGES},{BOOT_DRAWS}, f AS (SELECT r, unnest(range((SELECT n FROM size))) AS slot FROM (SELECT unnest(range({N_BOOT})) AS r)),
  {draw_ctes("f", "d", RS.stream(SEED, RS.IN_BLOCK_STREAM), "r", "slot", "draw")},
  w AS (SELECT r, draw % (SELECT n FROM size) AS pos, CAST(count(*) AS DOUBLE) AS w FROM d GROUP BY ALL),
  wide AS (SELECT w.r, w.w, z.acronym, z.v, w.pos FROM w JOIN ordered o USING (pos) JOIN z USING (animal_id)),
  rb AS (SELECT p.r, p.acronym AS a, q.acronym AS b, (sum(p.w) * sum(p.w * p.v * q.v) - sum(p.w * p.v) * sum(p.w * q.v))
      / sqrt((sum(p.w) * sum(p.w * p.v * p.v) - pow(sum(p.w * p.v), 2)) * (sum(p.w) * sum(p.w * q.v * q.v) - pow(sum(p.w * q.v), 2))) AS rb
    FROM wide p JOIN wide q ON p.r = q.r AND p.pos = q.pos AND p.acronym < q.acronym GROUP BY 1, 2, 3),
  ex AS (SELECT a, b, count(*) FILTER (abs(rb.rb) > abs(pairs.r)) AS exceed, count(*) AS n FROM rb JOIN pairs USING (a, b) GROUP BY 1, 2),
  rk AS (SELECT a, b, exceed, exceed / CAST(n AS DOUBLE) AS null_p, count(*) OVER () AS m, rank() OVER (ORDER BY exceed) + count(*) OVER (PARTITION BY exceed) - 1 AS r1 FROM ex),
  boot AS (SELECT a, b, exceed, null_p, least(min(null_p * m / r1) OVER (ORDER BY null_p DESC), 1) AS null_pvalue FROM rk)"""


@query("edge_bootstrap", f"WITH {BOOTSTRAP} SELECT a, b, exceed, {R('null_p')} AS null_p, {R('null_pvalue')} AS null_pvalue FROM boot")
def edge_bootstrap(spark, sf):
    m, blocks = _network_blocks(spark, sf)
    pairs = N.correlation(blocks, len(m.features))
    return rounded(_named(N.edge_bootstrap(blocks, len(m.features), pairs, N_BOOT, SEED), m.features))


@query("network_edges", f"""WITH {BOOTSTRAP}, idx AS (SELECT acronym, CAST(row_number() OVER (ORDER BY acronym) - 1 AS INTEGER) AS i FROM kept)
  SELECT p.i AS source, q.i AS target, {R('e.r')} AS weight, {R('e.pvalue')} AS pvalue, {R('b.null_pvalue')} AS null_pvalue
  FROM edges e JOIN boot b USING (a, b) JOIN idx p ON p.acronym = e.a JOIN idx q ON q.acronym = e.b""")
def network_edges(spark, sf):
    m = _matrix(spark, sf)
    nodes, edges = N.network(m, N_BOOT, SEED)
    return rounded(edges)


@query("network_graphml")
def network_graphml(spark, sf):
    m = _matrix(spark, sf)
    nodes, edges = N.network(m, N_BOOT, SEED)
    return N.graphml_lines(nodes, rounded(edges))


@query("matrix_to_graph", f"""WITH {CORRELATION} SELECT a, b, {R('r')} AS weight FROM pairs WHERE r <> 0""")
def matrix_to_graph(spark, sf):
    m, blocks = _network_blocks(spark, sf)
    square = N.correlation(blocks, len(m.features)).select("i", "j", F.col("r").alias("weight"))
    return rounded(_named(N.matrix_to_graph(square), m.features))


# ---------------------------------------------------------------- resampling plans
POSITIONS = f"""
grp AS (SELECT animal_id, condition, dense_rank() OVER (ORDER BY condition) - 1 AS grp,
  row_number() OVER (ORDER BY condition, animal_id) - 1 AS sid FROM animals),
bounds AS (SELECT grp, max(sid) + 1 AS upto, count(*) AS n, min(sid) AS start FROM grp GROUP BY 1)"""
# The operators' own defaults.
N_PERM = N_BOOT_PLS = 1000
N_SPLIT = 100


def _candidates(n: int) -> int:
    return n + max(10, n // 20)


def _permutations_sql(n_cond: int) -> str:
    """The first N_PERM candidates that map no group onto itself and repeat no earlier sequence."""
    ordered = ""
    what = "CAST(new_group AS VARCHAR)"
    if n_cond > 1:
        ordered = f"""w AS (SELECT perm, sid, grp, new_group, c, sid * {n_cond} + c AS slot FROM p CROSS JOIN (SELECT unnest(range({n_cond})) AS c)),
  {draw_ctes("w", "v", RS.stream(SEED, RS.CONDITION_STREAM), "perm", "slot", "draw")},
  a AS (SELECT perm, sid, grp, new_group, string_agg(CAST(c AS VARCHAR), ',' ORDER BY draw, c) AS conditions FROM v GROUP BY perm, sid, grp, new_group),"""
        what += " || ':' || conditions"
    return f"""WITH {FILTERED},{POSITIONS}, f AS (SELECT * FROM grp CROSS JOIN (SELECT unnest(range({_candidates(N_PERM)})) AS perm)),
  {draw_ctes("f", "d", RS.stream(SEED, RS.PERMUTATION_STREAM), "perm", "sid", "draw")},
  k AS (SELECT *, row_number() OVER (PARTITION BY perm ORDER BY draw) - 1 AS rk FROM d),
  p AS (SELECT perm, sid, k.grp, b.grp AS new_group FROM k JOIN bounds b ON rk >= b.start AND rk < b.upto),
  {ordered or "a AS (SELECT * FROM p),"}
  unmixed AS (SELECT perm FROM a GROUP BY perm, grp HAVING bool_and(grp = new_group)),
  seqs AS (SELECT perm, row_number() OVER (PARTITION BY seq ORDER BY perm) AS nth FROM (SELECT perm, md5(string_agg({what}, ',' ORDER BY sid)) AS seq FROM a GROUP BY perm)),
  fine AS (SELECT perm, row_number() OVER (ORDER BY perm) - 1 AS place FROM seqs WHERE nth = 1 AND perm NOT IN (SELECT perm FROM unmixed))
  SELECT CAST(place AS INTEGER) AS perm, sid, CAST(grp AS INTEGER) AS grp, CAST(new_group AS INTEGER) AS new_group{", conditions" if n_cond > 1 else ""}
  FROM a JOIN fine USING (perm) WHERE place < {N_PERM}"""


def _blocks(spark, sf):
    m = _matrix(spark, sf)
    return m, RS.make_blocks(m.rows, m.sizes)


@query("group_index", f"WITH {FILTERED},{POSITIONS} SELECT animal_id, CAST(grp AS INTEGER) AS grp, sid FROM grp")
def group_index(spark, sf):
    _, blocks = _blocks(spark, sf)
    return blocks.rows.select("animal_id", F.col("group").alias("grp"), "sid")


@query("permutation_plan", _permutations_sql(1))
def permutation_plan(spark, sf):
    _, blocks = _blocks(spark, sf)
    plan = RS.permutation_plan(blocks, N_PERM, SEED)
    return plan.select("perm", "sid", F.col("group").alias("grp"), "new_group")


@query("permutation_plan_conditions", _permutations_sql(2))
def permutation_plan_conditions(spark, sf):
    """Two conditions per subject: subjects change groups and the conditions places within them."""
    _, blocks = _blocks(spark, sf)
    plan = RS.permutation_plan(blocks, N_PERM, SEED, 2)
    return plan.select("perm", "sid", F.col("group").alias("grp"), "new_group", F.concat_ws(",", F.col("conditions").cast("array<string>")).alias("conditions"))


@query("bootstrap_plan", f"""WITH {FILTERED},{POSITIONS}, j AS (SELECT DISTINCT grp, n, start FROM bounds),
  f AS (SELECT grp, n, start, r, unnest(range(n)) AS slot FROM j CROSS JOIN (SELECT unnest(range({_candidates(N_BOOT_PLS)})) AS r)),
  g AS (SELECT *, r * (SELECT count(*) FROM j) + grp AS key FROM f),
  {draw_ctes("g", "d", RS.stream(SEED, RS.IN_BLOCK_STREAM), "key", "slot", "draw")},
  w AS (SELECT r, start + draw % n AS sid, grp, count(*) AS weight FROM d GROUP BY ALL),
  m AS (SELECT r, grp, count(*) < (SELECT ceil(min(n) / CAST(2 AS DOUBLE)) FROM j) AS few, md5(string_agg(sid || ':' || weight, ',' ORDER BY sid)) AS seq FROM w GROUP BY ALL),
  fine AS (SELECT r, row_number() OVER (ORDER BY bool_or(few), max(nth) > 1, r) - 1 AS place
    FROM (SELECT *, row_number() OVER (PARTITION BY grp, seq ORDER BY r) AS nth FROM m) GROUP BY r)
  SELECT CAST(place AS INTEGER) AS resample, sid, CAST(grp AS INTEGER) AS grp, CAST(weight AS INTEGER) AS weight
  FROM w JOIN fine USING (r) WHERE place < {N_BOOT_PLS}""")
def bootstrap_plan(spark, sf):
    _, blocks = _blocks(spark, sf)
    return RS.bootstrap_plan(blocks, N_BOOT_PLS, SEED).withColumnRenamed("group", "grp")


@query("split_plan", f"""WITH {FILTERED},{POSITIONS}, f AS (SELECT * FROM grp CROSS JOIN (SELECT unnest(range({N_SPLIT})) AS split)),
  {draw_ctes("f", "d", RS.stream(SEED, RS.SPLIT_STREAM), "split", "sid", "draw")},
  c AS (SELECT grp, n, split FROM bounds CROSS JOIN (SELECT unnest(range({N_SPLIT})) AS split)),
  {draw_ctes("c", "e", RS.stream(SEED, RS.SPLIT_STREAM + 1), "split", "grp", "coin")},
  t AS (SELECT grp, split, CASE WHEN (coin >> 40) % 2 = 0 THEN ceil(n / CAST(2 AS DOUBLE)) ELSE floor(n / CAST(2 AS DOUBLE)) END AS k FROM e)
  SELECT CAST(d.split AS INTEGER) AS split, sid, CAST(d.grp AS INTEGER) AS grp,
    row_number() OVER (PARTITION BY d.split, d.grp ORDER BY draw) <= k AS first FROM d JOIN t ON t.grp = d.grp AND t.split = d.split""")
def split_plan(spark, sf):
    _, blocks = _blocks(spark, sf)
    return RS.split_plan(blocks, N_SPLIT, SEED).withColumnRenamed("group", "grp")


# ---------------------------------------------------------------- PLS pieces
LONG = f"""{FILTERED}, long AS (SELECT animal_id AS sample, condition AS grp, CASE WHEN animal_id % 2 = 0 THEN 0 ELSE 1 END AS cond,
  acronym AS feature, v AS value FROM filled), cellm AS (SELECT grp, cond, feature, avg(value) AS mean FROM long GROUP BY 1, 2, 3)"""


def _long(spark, sf):
    return T.matrix_long(_matrix(spark, sf), "condition").select(
        F.col("animal_id").alias("sample"), F.col("condition").alias("group"),
        F.pmod("animal_id", F.lit(2)).cast("int").alias("cond"), F.col("acronym").alias("feature"), "value",
    )


@query("group_means", f"WITH {LONG} SELECT grp, cond, feature, {R('mean')} AS mean FROM cellm")
def group_means(spark, sf):
    return rounded(L.group_means(_long(spark, sf), ["group", "cond"]).withColumnRenamed("group", "grp"))


@query("mean_center", f"""WITH {LONG}
  SELECT 0 AS mode, grp, cond, feature, {R("mean - (SELECT avg(value) FROM long l WHERE l.grp = c.grp AND l.feature = c.feature)")} AS mean FROM cellm c
  UNION ALL SELECT 1, grp, cond, feature, {R("mean - avg(mean) OVER (PARTITION BY cond, feature)")} FROM cellm
  UNION ALL SELECT 2, grp, cond, feature, {R("mean - (SELECT avg(value) FROM long l WHERE l.feature = c.feature)")} FROM cellm c""")
def mean_center(spark, sf):
    long = _long(spark, sf)
    parts = [L.mean_center(long, m).select(F.lit(m).alias("mode"), F.col("group").alias("grp"), "cond", "feature", "mean") for m in (0, 1, 2)]
    return rounded(parts[0].unionByName(parts[1]).unionByName(parts[2]))


@query("mean_center_rows", f"""WITH {LONG} SELECT sample, grp, cond, feature,
  {R("value - (SELECT avg(mean) FROM cellm c WHERE c.cond = l.cond AND c.feature = l.feature)")} AS value FROM long l""")
def mean_center_rows(spark, sf):
    return rounded(L.mean_center(_long(spark, sf), 1, means=False).withColumnRenamed("group", "grp"))


@query("normalize_columns", f"""WITH {LONG} SELECT sample, grp, cond, feature,
  {R("coalesce(value / nullif(sqrt(sum(value * value) OVER (PARTITION BY feature)), 0), 0)", 8)} AS value FROM long""")
def normalize_columns(spark, sf):
    return rounded(L.normalize_columns(_long(spark, sf), ["feature"]).withColumnRenamed("group", "grp"), 8)


@query("column_corr", f"""WITH {RESULTS}, p AS (SELECT acronym, CAST(cells AS DOUBLE) AS a, CAST(total_area_um2 AS DOUBLE) AS b FROM results),
  m AS (SELECT *, a - avg(a) OVER (PARTITION BY acronym) AS da, b - avg(b) OVER (PARTITION BY acronym) AS db FROM p)
  SELECT acronym, {R("sum(da * db) / sqrt(sum(da * da) * sum(db * db))")} AS r FROM m GROUP BY 1""")
def column_corr(spark, sf):
    pairs = P.results(spark, sf).select(
        "acronym", F.col("cells").cast("double").alias("a"), F.col("total_area_um2").cast("double").alias("b"))
    return rounded(L.column_corr(pairs, ["acronym"]))


def _behaviour_rows(spark, sf):
    """x = [structures | account balance, number of slices] per animal."""
    m = _matrix(spark, sf)
    y = P.table(spark, sf, "customer").select(
        F.col("c_custkey").alias("animal_id"), F.col("c_acctbal").alias("b0"))
    n = P.slices(spark, sf).groupBy("animal_id").agg(F.count(F.lit(1)).cast("double").alias("b1"))
    rows = m.rows.join(y, "animal_id").join(n, "animal_id").select(
        "animal_id", "group", F.concat("x", F.array("b0", "b1")).alias("x"))
    return m, rows


BEHAVIOUR = f"""{FILTERED}, ys AS (SELECT c_custkey AS animal_id, 0 AS behaviour, c_acctbal AS y FROM customer
  UNION ALL SELECT o_custkey, 1, CAST(count(*) AS DOUBLE) FROM orders GROUP BY 1),
  feat AS (SELECT acronym, row_number() OVER (ORDER BY acronym) - 1 AS feature FROM kept),
  cn AS (SELECT DISTINCT condition, dense_rank() OVER (ORDER BY condition) - 1 AS grp FROM animals),
  xy AS (SELECT grp, behaviour, feature, v - avg(v) OVER w AS dx, y - avg(y) OVER w AS dy
    FROM filled JOIN ys USING (animal_id) JOIN feat USING (acronym) JOIN cn USING (condition) WINDOW w AS (PARTITION BY grp, behaviour, feature))"""


@query("xcorr", f"""WITH {BEHAVIOUR} SELECT CAST(grp AS INTEGER) AS grp, behaviour, CAST(feature AS INTEGER) AS feature,
  {R("sum(dx * dy) / sqrt(sum(dx * dx) * sum(dy * dy))")} AS value FROM xy GROUP BY 1, 2, 3""")
def xcorr(spark, sf):
    m, rows = _behaviour_rows(spark, sf)
    return rounded(L.xcorr(rows, m.sizes, len(m.features), 2).withColumnRenamed("group", "grp"))


@query("xcov", f"""WITH {BEHAVIOUR} SELECT CAST(grp AS INTEGER) AS grp, behaviour, CAST(feature AS INTEGER) AS feature,
  {R("sum(dx * dy) / (count(*) - 1)", 4)} AS value FROM xy GROUP BY 1, 2, 3""")
def xcov(spark, sf):
    m, rows = _behaviour_rows(spark, sf)
    return rounded(L.xcorr(rows, m.sizes, len(m.features), 2, covariance=True).withColumnRenamed("group", "grp"), 4)


@query("svd_small")
def svd_small(spark, sf):
    """Singular values of the centred condition means, and the structure vectors."""
    long = _long(spark, sf)
    labels = F.array(*[F.lit(c) for c in CONDITIONS])
    centred = L.mean_center(long.withColumn("cond", F.lit(0)), 1).select(
        (F.array_position(labels, F.col("group")) - 1).cast("int").alias("row"), "feature", F.col("mean").alias("value"))
    singular, _, left = L.svd_small(centred, len(CONDITIONS))
    keep = singular.filter(F.col("singular_value") > 1e-6)
    return rounded(keep.join(left, "lv"), 5)


@query("pls_lv_pvalues")
def pls_lv_pvalues(spark, sf):
    return rounded(L.lv_pvalues(L.meancentered_pls(_matrix(spark, sf), n_perm=N_PERM, n_boot=0, seed=SEED)))


@query("pls_salience")
def pls_salience(spark, sf):
    return rounded(L.salience(L.meancentered_pls(_matrix(spark, sf), n_perm=0, n_boot=N_BOOT_PLS, seed=SEED)), 5)


@query("pls_estimated_lv")
def pls_estimated_lv(spark, sf):
    return rounded(L.lv_estimate(L.meancentered_pls(_matrix(spark, sf), n_perm=0, n_boot=N_BOOT_PLS, seed=SEED)), 5)


@query("pls_contrast_table")
def pls_contrast_table(spark, sf):
    result = L.meancentered_pls(_matrix(spark, sf), n_perm=0, n_boot=N_BOOT_PLS, seed=SEED)
    return rounded(L.contrast_table(result, {"BUILDING": "builders"}, ["all"], list(reversed(CONDITIONS))), 5)


@query("pls_scores")
def pls_scores(spark, sf):
    return rounded(L.meancentered_pls(_matrix(spark, sf), n_perm=0, n_boot=0, seed=SEED)["x_scores"], 5)


@query("pls_split_half")
def pls_split_half(spark, sf):
    result = L.meancentered_pls(_matrix(spark, sf), n_perm=N_PERM, n_boot=0, n_split=N_SPLIT, seed=SEED)
    return rounded(result["split"], 5)


@query("behavioral_pls")
def behavioral_pls(spark, sf):
    m, rows = _behaviour_rows(spark, sf)
    result = L.behavioral_pls(
        rows, m.sizes, m.features, ["balance", "slices"], m.groups, n_perm=N_PERM, n_boot=N_BOOT_PLS, test_split=None, seed=SEED)
    return rounded(result["weights"], 5)


@query("behavioral_loadings")
def behavioral_loadings(spark, sf):
    m, rows = _behaviour_rows(spark, sf)
    result = L.behavioral_pls(
        rows, m.sizes, m.features, ["balance", "slices"], m.groups, n_perm=0, n_boot=N_BOOT_PLS, test_split=None, seed=SEED)
    return rounded(result["y_loadings"], 5)


@query("cross_validate")
def cross_validate(spark, sf):
    m, rows = _behaviour_rows(spark, sf)
    blocks = RS.make_blocks(rows, m.sizes)
    return rounded(L.cross_validate(blocks, m.sizes, len(m.features), 2, False, N_SPLIT, 0.25, SEED, ["balance", "slices"]), 5)


@query("simpls_scores")
def simpls_scores(spark, sf):
    m, rows = _behaviour_rows(spark, sf)
    return rounded(L.simpls(rows, m.features, ["balance", "slices"], 3)["scores"], 5)


@query("simpls_mse")
def simpls_mse(spark, sf):
    m, rows = _behaviour_rows(spark, sf)
    return rounded(L.simpls(rows, m.features, ["balance", "slices"], 3)["mse"], 3)


@query("pls_regression")
def pls_regression(spark, sf):
    m, rows = _behaviour_rows(spark, sf)
    result = L.pls_regression(rows, m.features, ["balance", "slices"], 2, n_perm=N_PERM, n_boot=N_BOOT_PLS, seed=SEED)
    return rounded(result["weights"], 6)


@query("row_mask", f"""WITH {FILTERED} SELECT animal_id FROM animals JOIN customer ON c_custkey = animal_id WHERE c_acctbal >= 0""")
def row_mask(spark, sf):
    m, rows = _behaviour_rows(spark, sf)
    y = F.when(F.get("x", F.lit(len(m.features))) >= 0, F.get("x", F.lit(len(m.features))))
    return L.row_mask(rows.withColumn("y", F.array(y))).select("animal_id")


@query("pls_regression_repeats")
def pls_regression_repeats(spark, sf):
    """Three repeats of each behaviour, redrawn in every bootstrap."""
    m, rows = _behaviour_rows(spark, sf)
    n = len(m.features)
    repeats = F.flatten(F.transform(F.slice("x", n + 1, 2), lambda v: F.array(v, v * number(1.1) + number(1), v * number(0.95) - number(2))))
    deep = rows.withColumn("x", F.concat(F.slice("x", 1, n), repeats))
    result = L.pls_regression(deep, m.features, ["balance", "slices"], 2, depth=3, n_perm=N_PERM, n_boot=N_BOOT_PLS, seed=SEED)
    return rounded(result["weights"], 6)


@query("project_pls")
def project_pls(spark, sf):
    """The report sheets of a project whose valid slices are all registered, as rows."""
    docs = P.slice_documents(spark, sf)
    docs = docs.join(S.missing_params(docs).select("slice_id"), "slice_id", "left_anti")
    sheets = A.project_pls(docs, P.subjects(spark, sf), P.results(spark, sf), "condition", "cells", MIN_PER_GROUP, subject_condition="segment", n_perm=N_PERM, n_boot=N_BOOT_PLS, seed=SEED)
    none = F.lit(None).cast("string")
    parts = [
        sheets["lv_p_value"].select(F.lit("lv_p_value").alias("sheet"), none.alias("name"), "lv", F.col("p_value").alias("value"), F.lit(None).cast("double").alias("stderr")),
        sheets["estimated_lv1"].select(F.lit("estimated_lv1"), "condition", "lv", "estimate", "stderr"),
        sheets["pls_salience"].select(F.lit("pls_salience"), "acronym", "lv", "salience", "stderr"),
    ]
    return rounded(parts[0].union(parts[1]).union(parts[2]), 5)


@query("normal_cdf", f"""WITH z AS (SELECT l_orderkey, l_linenumber, (l_partkey % 2001 - 1000) / CAST(200 AS DOUBLE) AS z FROM lineitem),
  d AS (SELECT DISTINCT z FROM z), s AS (SELECT unnest(range(401)) AS i),
  area AS (SELECT z, 0.5 + z / 1200 / sqrt(2 * pi()) * sum(CASE WHEN i = 0 OR i = 400 THEN 1 WHEN i % 2 = 1 THEN 4 ELSE 2 END * exp(-pow(z * i / 400, 2) / 2)) AS p FROM d, s GROUP BY z)
  SELECT l_orderkey, l_linenumber, {R('p', 5)} AS p FROM z JOIN area USING (z)""")
def normal_cdf(spark, sf):
    """The share of a standard normal below each point; the twin integrates by Simpson's rule."""
    line = P.table(spark, sf, "lineitem")
    return rounded(line.select("l_orderkey", "l_linenumber", special.normal_cdf((F.col("l_partkey") % 2001 - 1000).cast("double") / number(200)).alias("p")), 5)
