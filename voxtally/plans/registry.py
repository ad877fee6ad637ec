"""Registered queries with their equivalent SQL text, and the shared SQL views."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from voxtally.functions.columns import MIX_MULTIPLIER, MIX_RESAMPLE, MIX_SAMPLE, MIX_SEED, col

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    """Register ``name``; ``sql`` is the same query for a plain SQL engine."""

    def add(fn: Query) -> Query:
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return add


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Round every DOUBLE so that summation order cannot show in the result."""
    return df.select(
        *[
            (F.round(col(n), digits) + F.lit(0.0)).alias(n) if t in ("double", "float") else col(n)
            for n, t in df.dtypes
        ]
    )


def R(expr: str, digits: int = 6) -> str:
    return f"(round(CAST({expr} AS DOUBLE), {digits}) + CAST(0 AS DOUBLE))"


STRUCTURES = """
structures AS (
  SELECT 1 AS id, CAST(NULL AS INTEGER) AS parent_id, 'root' AS acronym, 'root' AS name, [1] AS path
  UNION ALL SELECT 2, 1, 'GM', 'gray matter', [1, 2]
  UNION ALL SELECT 3, 1, 'WM', 'white matter', [1, 3]
  UNION ALL SELECT 10 + r_regionkey, CASE WHEN r_regionkey < 3 THEN 2 ELSE 3 END,
    'R' || r_regionkey, r_name, [1, CASE WHEN r_regionkey < 3 THEN 2 ELSE 3 END, 10 + r_regionkey] FROM region
  UNION ALL SELECT 100 + n_nationkey, 10 + n_regionkey, 'N' || n_nationkey, n_name,
    [1, CASE WHEN n_regionkey < 3 THEN 2 ELSE 3 END, 10 + n_regionkey, 100 + n_nationkey] FROM nation),
closure AS (SELECT id, unnest(path) AS ancestor_id FROM structures),
facts AS (
  SELECT id, acronym, name,
    id IN (SELECT parent_id FROM structures WHERE parent_id IS NOT NULL) AS is_parent_structure,
    (list_contains(path, 2) AND id <> 2) AS is_gray_matter FROM structures)"""

SUBJECTS = """
subjects AS (SELECT c_custkey AS animal_id, c_mktsegment AS condition,
  CAST(c_nationkey AS VARCHAR) AS nation FROM customer)"""

SLICES = """
slices AS (SELECT o_orderkey AS slice_id, o_custkey AS animal_id, o_totalprice / 1000 AS ap,
  o_orderpriority = '5-LOW' AS ignore FROM orders)"""

CELLS = """
cells AS (
  SELECT l_orderkey AS slice_id, 100 + s_nationkey AS struct_id,
    (l_partkey % 97) / CAST(97 AS DOUBLE) AS x, (l_suppkey % 89) / CAST(89 AS DOUBLE) AS y,
    CASE WHEN l_orderkey % 50 = 0 AND l_linenumber = 1 THEN NULL ELSE l_quantity END AS area_um,
    4 * l_quantity AS area_pixels, l_extendedprice AS mean_intensity,
    l_returnflag = 'R' AS la, l_linestatus = 'O' AS lb, l_discount >= CAST(0.05 AS DOUBLE) AS lc
  FROM lineitem JOIN supplier ON l_suppkey = s_suppkey)"""

AREAS = """
slice_areas AS (
  SELECT l_orderkey AS slice_id,
    CASE WHEN l_tax > CAST(0.02 AS DOUBLE) THEN CAST(100 + l_partkey % 25 AS INTEGER) ELSE 0 END AS struct_id,
    CAST(count(*) * 600 AS DOUBLE) AS area FROM lineitem GROUP BY 1, 2)"""

PIXELS = """
pixels AS (
  SELECT vec_id AS image_id, CAST(k // 8 AS INTEGER) AS y, CAST(k % 8 AS INTEGER) AS x, CAST(v AS DOUBLE) AS v
  FROM (SELECT vec_id, unnest(range(64)) AS k, unnest(embedding) AS v FROM embeddings))"""

VOXELS = """
voxels AS (
  SELECT z, y, x, CAST(100 + (z * 31 + y * 7 + x) % 25 AS INTEGER) AS struct_id, ref,
    CASE WHEN x < 8 THEN 2 ELSE 1 END AS hemi
  FROM (SELECT CAST(p_partkey // 256 AS INTEGER) AS z, CAST((p_partkey // 16) % 16 AS INTEGER) AS y,
               CAST(p_partkey % 16 AS INTEGER) AS x, p_retailprice AS ref FROM part))"""

# Direct counts and areas per (animal, structure) of valid slices, rolled up the tree.
DIRECT = """
direct AS (
  SELECT animal_id, struct_id, sum(n) AS n, sum(a) AS a, sum(b) AS b, sum(c) AS c, sum(area) AS area FROM (
    SELECT slice_id, struct_id, count(x) AS n, count_if(la) AS a, count_if(lb) AS b, count_if(lc) AS c,
      CAST(0 AS DOUBLE) AS area FROM cells GROUP BY ALL
    UNION ALL
    SELECT slice_id, struct_id, 0, 0, 0, 0, area FROM slice_areas
    WHERE slice_id IN (SELECT slice_id FROM cells)) m
  JOIN slices USING (slice_id) WHERE NOT ignore GROUP BY ALL),
rolled AS (
  SELECT animal_id, ancestor_id AS struct_id, sum(n) AS n, sum(a) AS a, sum(b) AS b, sum(c) AS c, sum(area) AS area
  FROM direct JOIN closure ON direct.struct_id = closure.id GROUP BY ALL)"""

RESULTS = f"""{STRUCTURES},{SUBJECTS},{SLICES},{CELLS},{AREAS},{DIRECT},
results AS (
  SELECT condition, animal_id, acronym, name, is_parent_structure, is_gray_matter,
    CAST(area AS BIGINT) AS total_area_um2, CAST(n AS BIGINT) AS cells
  FROM rolled JOIN facts ON rolled.struct_id = facts.id JOIN subjects USING (animal_id)),
leaves AS (SELECT * FROM results WHERE NOT is_parent_structure AND is_gray_matter)"""

_WORD = 4294967296


def _mix_ctes(source: str, column: str, tag: str) -> tuple[list[str], str]:
    """CTEs that apply the 32-bit mix to ``column`` of ``source``."""
    ctes, src = [], source
    for i in range(2):
        ctes.append(f"{tag}{i}x AS (SELECT *, xor({column}, {column} >> 16) AS {column}_{i} FROM {src})")
        ctes.append(
            f"{tag}{i} AS (SELECT * EXCLUDE ({column}, {column}_{i}), ({column}_{i} * {MIX_MULTIPLIER}) % {_WORD}"
            f" AS {column} FROM {tag}{i}x)"
        )
        src = f"{tag}{i}"
    ctes.append(f"{tag} AS (SELECT * EXCLUDE ({column}), xor({column}, {column} >> 16) AS {column} FROM {src})")
    return ctes, tag


def draw_ctes(source: str, tag: str, seed: int, resample: str, sample: str, out: str) -> str:
    """CTE text ending in a table ``tag`` = ``source`` plus the draw column ``out``."""
    parts = [
        f"{tag}_s AS (SELECT *, ((CAST({resample} AS BIGINT) % {_WORD}) * {MIX_RESAMPLE} + {(seed * MIX_SEED) % _WORD})"
        f" % {_WORD} AS k_ FROM {source})"
    ]
    more, src = _mix_ctes(f"{tag}_s", "k_", f"{tag}_k")
    parts += more
    parts.append(
        f"{tag}_f AS (SELECT *, (((CAST({sample} AS BIGINT) % {_WORD}) * {MIX_SAMPLE}) % {_WORD} + k_) % {_WORD}"
        f" AS f_ FROM {src})"
    )
    more, src = _mix_ctes(f"{tag}_f", "f_", f"{tag}_g")
    parts += more
    parts.append(f"{tag}_h AS (SELECT *, xor((f_ + k_ * 5 + 7) % {_WORD}, k_) AS h_ FROM {src})")
    more, src = _mix_ctes(f"{tag}_h", "h_", f"{tag}_i")
    parts += more
    parts.append(f"{tag}_l AS (SELECT *, (h_ + k_ * 3 + 1) % {_WORD} AS l_ FROM {src})")
    more, src = _mix_ctes(f"{tag}_l", "l_", f"{tag}_m")
    parts += more
    parts.append(
        f"{tag} AS (SELECT * EXCLUDE (k_, f_, h_, l_), h_ * {1 << 30} + (l_ >> 2) AS {out} FROM {src})"
    )
    return ",\n".join(parts)
