"""Queries over cells, regions and slices."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from voxtally.functions.columns import natural_key, number, preview_box, resize_dims, rgb_from_packed, structs_equal
from voxtally.operators import cells as C
from voxtally.operators import regions as G
from voxtally.operators import slices as S
from voxtally.plans import project as P
from voxtally.plans.registry import (
    AREAS, CELLS, DIRECT, RESULTS, SLICES, STRUCTURES, SUBJECTS, VOXELS, R, query, rounded,
)

LABELS = 'la AS "LABEL-a", lb AS "LABEL-b", lc AS "LABEL-c"'
CELL_ROW = f"slice_id, struct_id, {R('x')} AS x, {R('y')} AS y, area_um, area_pixels, mean_intensity, {LABELS}"


def _labels(spark, sf):
    return P.subjects(spark, sf).select("animal_id", "condition")


def _combo(expr_a: bool, expr_b: bool, expr_c: bool) -> str:
    return " AND ".join(f"{'' if s else 'NOT '}{n}" for n, s in zip(("la", "lb", "lc"), (expr_a, expr_b, expr_c)))


COMBOS = [(a, b, c) for a in (False, True) for b in (False, True) for c in (False, True)]
COMBO_NAMES = ["".join(n + ("+" if s else "-") for n, s in zip("abc", t)) for t in COMBOS]
MEASURES = ["cells", "a+", "b+", "c+", *COMBO_NAMES]


# ---------------------------------------------------------------- flagship
def _summary_sql(grain: str, density_side: float | None, size: tuple | None, min_side: float | None) -> str:
    slice_grain = grain == "slice"
    names = MEASURES
    conds = ["x IS NOT NULL", "la", "lb", "lc", *[_combo(*t) for t in COMBOS]]
    aggs = ", ".join(f'count_if({c}) AS "{n}"' for n, c in zip(names, conds))
    zeros = ", ".join("0" for _ in names)
    sums = ", ".join(f'sum("{n}") AS "{n}"' for n in names)
    keys = "animal_id, slice_id" if slice_grain else "animal_id"
    if size:
        source = f"""sized AS (
          SELECT cells.* FROM cells JOIN (SELECT slice_id, bool_or(area_um IS NULL) AS px FROM cells GROUP BY 1) u
          USING (slice_id) WHERE CASE WHEN px THEN area_pixels ELSE area_um END BETWEEN {size[0]} AND {size[1]})"""
    else:
        source = "sized AS (SELECT * FROM cells)"
    if density_side:
        out = [f'{R(f"""CAST("{n}" AS DOUBLE) / nullif(area, 0) * {density_side ** 2}""")} AS "{n}"' for n in names]
        out += [f'CAST("{n}" AS BIGINT) AS "{n} (not normalized)"' for n in names]
    else:
        out = [f'CAST("{n}" AS BIGINT) AS "{n}"' for n in names]
    where = f"WHERE area >= {min_side ** 2}" if min_side is not None else ""
    extra = ", slice_id, ap" if slice_grain else ""
    join_ap = "JOIN (SELECT slice_id, ap FROM slices) USING (slice_id)" if slice_grain else ""
    return f"""WITH {STRUCTURES},{SUBJECTS},{SLICES},{CELLS},{AREAS},
    {source},
    direct AS (
      SELECT {keys}, struct_id, {sums}, sum(area) AS area FROM (
        SELECT slice_id, struct_id, {aggs}, CAST(0 AS DOUBLE) AS area FROM sized GROUP BY ALL
        UNION ALL SELECT slice_id, struct_id, {zeros}, area FROM slice_areas
        WHERE slice_id IN (SELECT slice_id FROM cells)) m
      JOIN slices USING (slice_id) WHERE NOT ignore GROUP BY ALL),
    total AS (SELECT {keys}, ancestor_id, {sums}, sum(area) AS area
      FROM direct JOIN closure ON direct.struct_id = closure.id GROUP BY ALL)
    SELECT condition, animal_id, acronym, name, is_parent_structure, is_gray_matter,
      CAST(floor(area) AS BIGINT) AS total_area_um2, {", ".join(out)}{extra}
    FROM total JOIN facts ON ancestor_id = facts.id JOIN subjects USING (animal_id) {join_ap} {where}"""


def _summarise(spark, sf, **options):
    return G.summarise(
        P.cells(spark, sf), P.slice_areas(spark, sf), P.valid_slices(spark, sf), _labels(spark, sf),
        P.structures(spark, sf), **options,
    )


@query("region_summary", _summary_sql("subject", None, (5, 40), 0))
def region_summary(spark, sf):
    return _summarise(spark, sf, min_cell_size=5, max_cell_size=40, min_area_side=0)


@query("region_summary_density", _summary_sql("subject", 250.0, None, 40.0))
def region_summary_density(spark, sf):
    return rounded(_summarise(spark, sf, per_area_side=250.0, min_area_side=40.0))


@query("region_summary_per_slice", _summary_sql("slice", None, None, None))
def region_summary_per_slice(spark, sf):
    return _summarise(spark, sf, row_per="slice", slice_columns=("ap",))


def _sheets_sql() -> str:
    sheet = lambda name, side: f"""SELECT '{name}' AS sheet, condition, animal_id, acronym, {", ".join(f'CAST("{n}" AS DOUBLE) AS "{n}"' for n in MEASURES)}
      FROM ({_summary_sql("subject", side, None, None)})"""
    return f"{sheet('counts', None)} UNION ALL {sheet('density', 250.0)}"


@query("count_and_density_sheets", _sheets_sql())
def count_and_density_sheets(spark, sf):
    raw, dense = G.count_and_density_sheets(
        P.cells(spark, sf), P.slice_areas(spark, sf), P.valid_slices(spark, sf), _labels(spark, sf), P.structures(spark, sf), per_area_side=250.0,
    )
    pick = lambda df, name: df.select(
        F.lit(name).alias("sheet"), "condition", "animal_id", "acronym", *[F.col(f"`{n}`").cast("double").alias(n) for n in MEASURES]
    )
    return rounded(pick(raw, "counts").unionByName(pick(dense, "density")))


@query("results_table", f"WITH {RESULTS} SELECT * FROM results")
def results_table(spark, sf):
    return P.results(spark, sf).drop("a+", "b+", "c+", *COMBO_NAMES)


# ---------------------------------------------------------------- counts, areas, roll-up
@query("cell_counts", f"""WITH {CELLS} SELECT slice_id, struct_id, count(x) AS cells,
  count_if(la)::BIGINT AS "LABEL-a", count_if(lb)::BIGINT AS "LABEL-b", count_if(lc)::BIGINT AS "LABEL-c"
  FROM cells GROUP BY 1, 2""")
def cell_counts(spark, sf):
    return G.cell_counts(P.cells(spark, sf), ["slice_id"])


@query("region_areas", f"WITH {AREAS} SELECT * FROM slice_areas")
def region_areas(spark, sf):
    return P.slice_areas(spark, sf)


@query("merge_areas", f"""WITH {AREAS},{SLICES} SELECT animal_id, struct_id, sum(area) AS area
  FROM slice_areas JOIN slices USING (slice_id) GROUP BY 1, 2""")
def merge_areas(spark, sf):
    owned = P.slice_areas(spark, sf).join(P.slices(spark, sf).select("slice_id", "animal_id"), "slice_id")
    return G.merge_areas(owned, ["animal_id"])


@query("rollup_counts", f"""WITH {STRUCTURES},{CELLS} SELECT slice_id, ancestor_id AS struct_id,
  CAST(count(x) AS BIGINT) AS cells FROM cells JOIN closure ON struct_id = id GROUP BY 1, 2""")
def rollup_counts(spark, sf):
    counts = G.cell_counts(P.cells(spark, sf), ["slice_id"]).select("slice_id", "struct_id", "cells")
    return G.rollup_counts(counts, P.structures(spark, sf), ["slice_id"])


@query("rollup_areas", f"""WITH {STRUCTURES},{AREAS} SELECT slice_id,
  coalesce(ancestor_id, struct_id) AS struct_id, sum(area) AS area
  FROM slice_areas LEFT JOIN closure ON struct_id = id GROUP BY 1, 2""")
def rollup_areas(spark, sf):
    return G.rollup_areas(P.slice_areas(spark, sf), P.structures(spark, sf), ["slice_id"])


@query("density", f"""WITH {RESULTS} SELECT animal_id, acronym,
  {R("CAST(cells AS DOUBLE) / nullif(total_area_um2, 0) * 10000")} AS density FROM results""")
def density(spark, sf):
    return rounded(P.results(spark, sf).select(
        "animal_id", "acronym", G.density(F.col("cells"), F.col("total_area_um2"), 100.0).alias("density")
    ))


@query("densities", f"""WITH {CELLS},{AREAS} SELECT slice_id, struct_id, area,
  {R("count(x) / area * 62500")} AS cells FROM cells JOIN slice_areas USING (slice_id, struct_id)
  GROUP BY slice_id, struct_id, area""")
def densities(spark, sf):
    counts = G.cell_counts(P.cells(spark, sf), ["slice_id"]).select("slice_id", "struct_id", "cells")
    return rounded(G.densities(counts, P.slice_areas(spark, sf), ["slice_id"], 250.0))


@query("min_region_area", f"WITH {AREAS} SELECT * FROM slice_areas WHERE area >= 30 * 30")
def min_region_area(spark, sf):
    return G.min_region_area(P.slice_areas(spark, sf), 30.0)


@query("attach_structure", f"""WITH {STRUCTURES},{CELLS},n AS (SELECT struct_id, count(x) AS cells FROM cells GROUP BY 1)
  SELECT struct_id, cells, acronym, name, is_parent_structure, is_gray_matter FROM n JOIN facts ON struct_id = id""")
def attach_structure(spark, sf):
    counts = G.cell_counts(P.cells(spark, sf)).select("struct_id", "cells")
    return G.attach_structure(counts, P.structures(spark, sf))


@query("in_tree", f"""WITH {STRUCTURES},{AREAS} SELECT struct_id, sum(area) AS area FROM slice_areas
  WHERE struct_id IN (SELECT id FROM structures) GROUP BY 1""")
def in_tree(spark, sf):
    return G.in_tree(G.merge_areas(P.slice_areas(spark, sf), []), P.structures(spark, sf))


@query("union_cells", f"""WITH {CELLS} SELECT slice_id, struct_id, la AS "LABEL-a", NULL::BOOLEAN AS "LABEL-b"
  FROM cells WHERE slice_id % 2 = 0
  UNION ALL SELECT slice_id, struct_id, NULL, lb FROM cells WHERE slice_id % 2 = 1""")
def union_cells(spark, sf):
    cells = P.cells(spark, sf)
    even = cells.filter("slice_id % 2 = 0").select("slice_id", "struct_id", "LABEL-a")
    odd = cells.filter("slice_id % 2 = 1").select("slice_id", "struct_id", "LABEL-b")
    return C.union_cells(even, odd)


@query("co_labels", f"""WITH {CELLS} SELECT slice_id, struct_id, {LABELS}, {", ".join(
    f'({_combo(*t)}) AS "COLABEL-{n}"' for t, n in zip(COMBOS, COMBO_NAMES))} FROM cells""")
def co_labels(spark, sf):
    return C.with_co_labels(P.cells(spark, sf).select("slice_id", "struct_id", "LABEL-a", "LABEL-b", "LABEL-c"))


@query("format_columns", f"""WITH {CELLS} SELECT struct_id, count(x) AS cells, count_if(la)::BIGINT AS "a+",
  count_if(lb)::BIGINT AS "b+", count_if(lc)::BIGINT AS "c+" FROM cells GROUP BY 1""")
def format_columns(spark, sf):
    return G.format_columns(G.cell_counts(P.cells(spark, sf)))


# ---------------------------------------------------------------- tree
@query("structure_closure", f"WITH {STRUCTURES} SELECT * FROM closure")
def structure_closure(spark, sf):
    return G.closure(P.structures(spark, sf))


@query("structure_closure_recursive", f"WITH {STRUCTURES} SELECT id, array_to_string(path, '/') AS path FROM structures")
def structure_closure_recursive(spark, sf):
    paths = G.tree_paths(spark, P.structures(spark, sf).select("id", "parent_id"))
    return paths.select("id", F.array_join(F.transform("path", lambda v: v.cast("string")), "/").alias("path"))


@query("ancestors", f"""WITH {STRUCTURES}, p AS (SELECT id, len(path) AS n, unnest(path) AS ancestor_id,
  unnest(range(len(path))) AS k FROM structures)
  SELECT id, ancestor_id, CAST(n - 1 - k AS INTEGER) AS distance FROM p WHERE k < n - 1""")
def ancestors(spark, sf):
    return G.ancestors(P.structures(spark, sf))


@query("is_descendant", f"WITH {STRUCTURES} SELECT id, acronym, is_gray_matter AS is_descendant FROM facts")
def is_descendant(spark, sf):
    return G.is_descendant(P.structures(spark, sf), "GM")


@query("branch_leaves", f"""WITH {STRUCTURES} SELECT s.acronym AS branch, c.id FROM closure c
  JOIN structures s ON s.id = c.ancestor_id JOIN facts f ON f.id = c.id
  WHERE s.acronym IN ('GM', 'R4') AND (NOT f.is_parent_structure OR c.id = c.ancestor_id)""")
def branch_leaves(spark, sf):
    return G.branch_leaves(P.structures(spark, sf), ["GM", "R4"])


ACRONYMS = "acr AS (SELECT DISTINCT 'N' || (l_partkey % 40) AS acronym FROM lineitem)"


def _acronyms(spark, sf):
    return P.table(spark, sf, "lineitem").select(
        F.concat(F.lit("N"), (F.col("l_partkey") % 40).cast("string")).alias("acronym")
    ).distinct()


@query("acronym_to_id", f"WITH {STRUCTURES},{ACRONYMS} SELECT acronym, id FROM acr JOIN structures USING (acronym)")
def acronym_to_id(spark, sf):
    return G.acronym_to_id(_acronyms(spark, sf), P.structures(spark, sf))


@query("unknown_acronyms", f"""WITH {STRUCTURES},{ACRONYMS} SELECT acronym FROM acr
  WHERE acronym NOT IN (SELECT acronym FROM structures)""")
def unknown_acronyms(spark, sf):
    return G.unknown_acronyms(_acronyms(spark, sf), P.structures(spark, sf))


@query("struct_colors", f"""WITH {AREAS} SELECT DISTINCT struct_id,
  {R("CASE WHEN struct_id = 0 THEN 0 ELSE (struct_id * 7) % 256 END / CAST(255 AS DOUBLE)")} AS r,
  {R("CASE WHEN struct_id = 0 THEN 0 ELSE (struct_id * 13) % 256 END / CAST(255 AS DOUBLE)")} AS g,
  {R("CASE WHEN struct_id = 0 THEN 0 ELSE (struct_id * 29) % 256 END / CAST(255 AS DOUBLE)")} AS b,
  CAST(1 AS DOUBLE) AS alpha FROM slice_areas""")
def struct_colors(spark, sf):
    colours = G.struct_colors(P.slice_areas(spark, sf), P.structures(spark, sf))
    return rounded(colours.select("struct_id", *[F.get("rgba", F.lit(i)).alias(n) for i, n in enumerate(["r", "g", "b", "alpha"])]))


# ---------------------------------------------------------------- lookups
@query("struct_at_voxel", f"""WITH {CELLS}, {VOXELS},
  p AS (SELECT slice_id, x * 17 AS x, y * 17 AS y, (slice_id % 9) * CAST(0.5 AS DOUBLE) AS z FROM cells)
  SELECT slice_id, {R("p.x")} AS x, {R("p.y")} AS y, {R("p.z")} AS z, coalesce(v.struct_id, 0) AS struct_id
  FROM p LEFT JOIN voxels v ON v.z = round_even(p.z, 0) AND v.y = round_even(p.y, 0) AND v.x = round_even(p.x, 0)""")
def struct_at_voxel(spark, sf):
    points = P.cells(spark, sf).select(
        "slice_id", (F.col("x") * number(17)).alias("x"), (F.col("y") * number(17)).alias("y"),
        ((F.col("slice_id") % 9).cast("double") * number(0.5)).alias("z"),
    )
    return rounded(G.struct_at_voxel(points, P.voxels(spark, sf)))


GRID = """grid AS (SELECT DISTINCT l_orderkey AS slice_id, CAST(l_suppkey % 4 AS INTEGER) AS y,
  CAST(l_partkey % 4 AS INTEGER) AS x FROM lineitem),
  annotated AS (SELECT *, CAST(100 + (slice_id + y * 5 + x) % 25 AS INTEGER) AS struct_id FROM grid),
  placed AS (SELECT slice_id, x * 5 AS x, y * 5 AS y FROM cells)"""


def _grid(spark, sf):
    grid = P.table(spark, sf, "lineitem").select(
        F.col("l_orderkey").alias("slice_id"), (F.col("l_suppkey") % 4).cast("int").alias("y"),
        (F.col("l_partkey") % 4).cast("int").alias("x"),
    ).distinct()
    return grid.withColumn(
        "struct_id", (F.lit(100) + (F.col("slice_id") + F.col("y") * 5 + F.col("x")) % 25).cast("int")
    )


def _placed(spark, sf):
    return P.cells(spark, sf).select(
        "slice_id", (F.col("x") * number(5)).alias("x"), (F.col("y") * number(5)).alias("y")
    )


@query("struct_at_slice_pixel", f"""WITH {CELLS},{GRID} SELECT p.slice_id, {R("p.x")} AS x, {R("p.y")} AS y,
  coalesce(a.struct_id, 0) AS struct_id FROM placed p LEFT JOIN annotated a
  ON a.slice_id = p.slice_id AND a.x = round_even(p.x, 0) AND a.y = round_even(p.y, 0)""")
def struct_at_slice_pixel(spark, sf):
    return rounded(G.struct_at_slice_pixel(_placed(spark, sf), _grid(spark, sf)))


@query("points_on_mask", f"""WITH {CELLS},{GRID}
  SELECT p.slice_id, {R("p.x")} AS x, {R("p.y")} AS y, (a.struct_id IS NOT NULL AND p.x < 4 AND p.y < 4) AS on_mask
  FROM placed p LEFT JOIN annotated a ON a.slice_id = p.slice_id AND a.x = trunc(p.x) AND a.y = trunc(p.y)""")
def points_on_mask(spark, sf):
    sizes = P.slices(spark, sf).select("slice_id", F.lit(4).alias("height"), F.lit(4).alias("width"))
    return rounded(C.points_on_mask(_placed(spark, sf), _grid(spark, sf), sizes, ignore_outliers=True))


@query("slices_with_structures", f"""WITH {CELLS},{GRID} SELECT DISTINCT slice_id FROM annotated
  WHERE struct_id IN (101, 105, 110)""")
def slices_with_structures(spark, sf):
    return G.slices_with_structures(_grid(spark, sf), [101, 105, 110])


@query("points_in_box", f"""WITH {CELLS}, boxes AS (SELECT o_orderkey AS slice_id, o_custkey AS box_id,
  CAST(0.1 AS DOUBLE) AS x0, CAST(0.2 AS DOUBLE) AS y0, CAST(0.6 AS DOUBLE) AS x1, CAST(0.7 AS DOUBLE) AS y1 FROM orders)
  SELECT box_id, c.slice_id, {R("c.x - x0")} AS x, {R("c.y - y0")} AS y FROM cells c JOIN boxes b
  ON c.slice_id = b.slice_id AND c.x BETWEEN x0 AND x1 AND c.y BETWEEN y0 AND y1""")
def points_in_box(spark, sf):
    boxes = P.table(spark, sf, "orders").select(
        F.col("o_orderkey").alias("slice_id"), F.col("o_custkey").alias("box_id"),
        number(0.1).alias("x0"), number(0.2).alias("y0"), number(0.6).alias("x1"), number(0.7).alias("y1"),
    )
    return rounded(C.points_in_box(P.cells(spark, sf).select("slice_id", "x", "y"), boxes))


# ---------------------------------------------------------------- row filters
@query("filter_by_size", f"""WITH {CELLS} SELECT {CELL_ROW} FROM cells JOIN
  (SELECT slice_id, bool_or(area_um IS NULL) AS px FROM cells GROUP BY 1) u USING (slice_id)
  WHERE CASE WHEN px THEN area_pixels ELSE area_um END BETWEEN 5 AND 40""")
def filter_by_size(spark, sf):
    return rounded(C.filter_by_size(P.cells(spark, sf), 5, 40))


@query("with_label", f"WITH {CELLS} SELECT slice_id, struct_id, {R('x')} AS x, {R('y')} AS y FROM cells WHERE la")
def with_label(spark, sf):
    return rounded(C.with_label(P.cells(spark, sf), "a").select("slice_id", "struct_id", "x", "y"))


@query("threshold_label", f"""WITH {CELLS} SELECT slice_id, mean_intensity,
  mean_intensity > 30000 AS "LABEL-bright" FROM cells""")
def threshold_label(spark, sf):
    return C.threshold_label(P.cells(spark, sf).select("slice_id", "mean_intensity"), "mean_intensity", 30000, "bright")


@query("scale_points", f"""WITH {CELLS} SELECT slice_id, {R("x * 640")} AS px, {R("y * 480")} AS py,
  {R("x * 640 / 1024")} AS fx, {R("y * 480 / 768")} AS fy FROM cells""")
def scale_points(spark, sf):
    px = C.to_pixels(P.cells(spark, sf).select("slice_id", "x", "y"), number(640), number(480))
    kept = px.withColumn("px", F.col("x")).withColumn("py", F.col("y"))
    return rounded(C.to_fraction(kept, number(1024), number(768)).select(
        "slice_id", "px", "py", F.col("x").alias("fx"), F.col("y").alias("fy")))


@query("gray_matter_leaves", f"WITH {RESULTS} SELECT animal_id, acronym, cells FROM leaves")
def gray_matter_leaves(spark, sf):
    return C.gray_matter_leaves(P.results(spark, sf)).select("animal_id", "acronym", "cells")


@query("in_conditions", f"""WITH {RESULTS} SELECT condition, animal_id, acronym, cells FROM results
  WHERE condition IN ('BUILDING', 'MACHINERY')""")
def in_conditions(spark, sf):
    return C.in_conditions(P.results(spark, sf), "condition", ["BUILDING", "MACHINERY"]).select(
        "condition", "animal_id", "acronym", "cells")


OBJECTS = f"""objects AS (SELECT l_orderkey AS slice_id, l_linenumber * 1000000 + l_partkey AS label,
  l_quantity AS area FROM lineitem)"""


def _objects(spark, sf):
    return P.table(spark, sf, "lineitem").select(
        F.col("l_orderkey").alias("slice_id"),
        (F.col("l_linenumber") * 1000000 + F.col("l_partkey")).alias("label"),
        F.col("l_quantity").alias("area"),
    )


@query("large_components", f"""WITH {OBJECTS}, m AS (SELECT *, max(area) OVER (PARTITION BY slice_id) AS mx FROM objects)
  SELECT slice_id, label, area, row_number() OVER (PARTITION BY slice_id ORDER BY area DESC, label) AS rank
  FROM m WHERE area >= mx * CAST(0.3 AS DOUBLE)""")
def large_components(spark, sf):
    return C.large_components(_objects(spark, sf), 0.3)


@query("drop_area_outliers", f"""WITH {OBJECTS}, m AS (SELECT slice_id, avg(area) AS mu, stddev_samp(area) AS sd
  FROM objects GROUP BY 1) SELECT slice_id, label, area FROM objects JOIN m USING (slice_id)
  WHERE NOT coalesce(area < mu - CAST(1.5 AS DOUBLE) * sd OR area > mu + CAST(1.5 AS DOUBLE) * sd, false)""")
def drop_area_outliers(spark, sf):
    return C.drop_area_outliers(_objects(spark, sf), 1.5)


LABELLED = """labelled AS (SELECT l_orderkey AS slice_id, l_suppkey % 50 AS y, l_partkey % 60 AS x,
  l_linenumber - 1 AS label, l_extendedprice AS v FROM lineitem)"""


def _labelled(spark, sf):
    return P.table(spark, sf, "lineitem").select(
        F.col("l_orderkey").alias("slice_id"), (F.col("l_suppkey") % 50).alias("y"),
        (F.col("l_partkey") % 60).alias("x"), (F.col("l_linenumber") - 1).alias("label"),
        F.col("l_extendedprice").alias("v"),
    )


@query("region_props", f"""WITH {LABELLED} SELECT slice_id, label, {R("trunc(avg(x)) / 60")} AS x,
  {R("trunc(avg(y)) / 50")} AS y, count(*) AS area_pixels, {R("count(*) * CAST(0.5 AS DOUBLE)")} AS area_um,
  CAST(trunc(avg(v)) AS BIGINT) AS mean_intensity FROM labelled WHERE label > 0 GROUP BY 1, 2""")
def region_props(spark, sf):
    sizes = P.slices(spark, sf).select("slice_id", F.lit(50).alias("height"), F.lit(60).alias("width"))
    return rounded(C.region_props(_labelled(spark, sf), sizes, (0.5, 1.0)))


@query("object_points", f"""WITH {LABELLED} SELECT slice_id, label, CAST(round_even(avg(x), 0) AS INTEGER) AS x,
  CAST(round_even(avg(y), 0) AS INTEGER) AS y FROM labelled WHERE label > 0 GROUP BY 1, 2""")
def object_points(spark, sf):
    return C.object_points(_labelled(spark, sf))


@query("filter_objects_by_size", f"""WITH {LABELLED}, n AS (SELECT slice_id, label, count(*) * 2 AS size
  FROM labelled WHERE label > 0 GROUP BY 1, 2)
  SELECT slice_id, y, x, CASE WHEN size BETWEEN 2 AND 3 THEN l.label ELSE 0 END AS label, v
  FROM labelled l LEFT JOIN n USING (slice_id, label)""")
def filter_objects_by_size(spark, sf):
    return C.filter_objects_by_size(_labelled(spark, sf), (2, 3), (2.0, 1.0))


# ---------------------------------------------------------------- slices
@query("valid_slices", f"WITH {SLICES} SELECT * FROM slices WHERE NOT ignore")
def valid_slices(spark, sf):
    return P.valid_slices(spark, sf)


@query("slices_where", f"WITH {SLICES} SELECT * FROM slices WHERE NOT ignore AND ap > 200")
def slices_where(spark, sf):
    return S.where(P.valid_slices(spark, sf), F.col("ap") > 200)


@query("with_detections", f"WITH {SLICES},{CELLS} SELECT * FROM slices WHERE slice_id IN (SELECT slice_id FROM cells)")
def with_detections(spark, sf):
    return S.with_detections(P.slices(spark, sf), P.cells(spark, sf))


@query("missing_detections", f"WITH {SLICES},{CELLS} SELECT * FROM slices WHERE slice_id NOT IN (SELECT slice_id FROM cells)")
def missing_detections(spark, sf):
    return S.missing_detections(P.slices(spark, sf), P.cells(spark, sf))


@query("select_slices", f"""WITH {SLICES} SELECT 'subject' AS mode, * FROM slices WHERE animal_id = 7
  UNION ALL SELECT 'slice', * FROM slices WHERE slice_id = 42 UNION ALL SELECT 'all', * FROM slices""")
def select_slices(spark, sf):
    slices = P.slices(spark, sf)
    tag = lambda df, m: df.select(F.lit(m).alias("mode"), "*")
    return (
        tag(S.select_slices(slices, "subject", animal_id=7), "subject")
        .unionByName(tag(S.select_slices(slices, "slice", slice_id=42), "slice"))
        .unionByName(tag(S.select_slices(slices, "all"), "all"))
    )


@query("first_n_subjects", f"""WITH {SUBJECTS} SELECT animal_id, condition FROM subjects
  WHERE condition = 'BUILDING' ORDER BY animal_id LIMIT 10""")
def first_n_subjects(spark, sf):
    chosen = P.subjects(spark, sf).filter(F.col("conditions")["segment"] == "BUILDING")
    return S.first_n_subjects(chosen.select("animal_id", "condition"), 10)


@query("subjects_of", f"WITH {SLICES},{SUBJECTS} SELECT animal_id, slice_id, condition FROM slices JOIN subjects USING (animal_id)")
def subjects_of(spark, sf):
    return S.subjects_of(P.slices(spark, sf), _labels(spark, sf), strict=True).select("animal_id", "slice_id", "condition")


@query("count_valid_images", f"WITH {SLICES} SELECT count(*) AS n_images FROM slices WHERE NOT ignore")
def count_valid_images(spark, sf):
    return S.count_valid_images(P.slices(spark, sf))


@query("order_by_subject_ap", f"WITH {SLICES} SELECT animal_id, slice_id, ap FROM slices ORDER BY animal_id, ap")
def order_by_subject_ap(spark, sf):
    return P.slices(spark, sf).select("animal_id", "slice_id", "ap").orderBy("animal_id", "ap")


@query("evenly_space_ap", f"""WITH {SLICES}, v AS (SELECT *, row_number() OVER w AS i, count(*) OVER (PARTITION BY animal_id) AS n,
    first_value(ap) OVER f AS a0, last_value(ap) OVER f AS a1 FROM slices WHERE NOT ignore
    WINDOW w AS (PARTITION BY animal_id ORDER BY slice_id),
      f AS (PARTITION BY animal_id ORDER BY slice_id ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING))
  SELECT slice_id, animal_id, {R("CASE WHEN n <= 2 THEN ap ELSE a0 + (i - 1) * (a1 - a0) / (n - 1) END", 9)} AS ap FROM v
  UNION ALL SELECT slice_id, animal_id, {R("ap", 9)} FROM slices WHERE ignore""")
def evenly_space_ap(spark, sf):
    docs = P.slice_documents(spark, sf)
    ap = P.slices(spark, sf).select("slice_id", "ap")
    full = docs.join(ap, "slice_id").withColumn(
        "params",
        F.col("params").withField("atlas", F.struct(
            F.col("ap"), number(0).alias("rot_frontal"), number(0).alias("rot_horizontal"), number(0).alias("rot_sagittal"))),
    ).drop("ap")
    return rounded(S.evenly_space_ap(full).select("slice_id", "animal_id", F.col("params.atlas.ap").alias("ap")), 9)


DOCS = f"""docs AS (SELECT o_orderkey AS slice_id, o_custkey AS animal_id, o_orderkey AS pos,
  o_orderpriority = '5-LOW' AS ignore, '/images/' || o_custkey || '/slice' || o_orderkey || '.czi' AS filename,
  'slice' || o_orderkey AS stem, CASE WHEN o_orderkey % 3 <> 0 THEN o_orderkey % 3 END AS scene,
  o_orderkey % 7 <> 0 AS has_atlas, o_orderkey % 11 <> 0 AS has_tps, o_totalprice / 1000 AS ap, (o_orderkey % 5)::DOUBLE AS rot_horizontal,
  (o_orderkey % 4)::DOUBLE AS rot_sagittal FROM orders)"""
SLICE_STRING = "filename || CASE WHEN scene IS NULL THEN '' ELSE ' [Scene #' || scene || ']' END"


@query("path_strings", f"""WITH {DOCS} SELECT slice_id, {SLICE_STRING} AS slice,
  stem || ' [' || CASE WHEN scene IS NULL THEN '' ELSE 'Scene #' || scene || ' ' END || 'Channel #2].jpg' AS thumbnail,
  stem || '.czi' || CASE WHEN scene IS NULL THEN '' ELSE ' [Scene #' || scene || ']' END || '.csv' AS detections FROM docs""")
def path_strings(spark, sf):
    return S.path_strings(P.slice_documents(spark, sf), 2)


@query("slice_locations", f"""WITH {DOCS},{SUBJECTS} SELECT animal_id, condition AS segment, nation, {SLICE_STRING} AS slice,
  CASE WHEN has_atlas THEN CAST(round_even(ap * 25, 0) AS BIGINT) END AS ap_um,
  CASE WHEN has_atlas THEN CAST(0 AS DOUBLE) END AS rot_frontal, CASE WHEN has_atlas THEN rot_horizontal END AS rot_horizontal,
  CASE WHEN has_atlas THEN rot_sagittal END AS rot_sagittal FROM docs JOIN subjects USING (animal_id)""")
def slice_locations(spark, sf):
    return S.slice_locations(P.slice_documents(spark, sf), P.subjects(spark, sf), ["segment", "nation"], 25.0)


@query("set_rotation", f"""WITH {DOCS} SELECT slice_id, CASE WHEN has_atlas THEN CAST(3 AS DOUBLE) END AS h,
  CASE WHEN has_atlas THEN CAST(4 AS DOUBLE) END AS s FROM docs""")
def set_rotation(spark, sf):
    turned = S.set_rotation(P.slice_documents(spark, sf), 3.0, 4.0)
    return turned.select("slice_id", F.col("params.atlas.rot_horizontal").alias("h"), F.col("params.atlas.rot_sagittal").alias("s"))


@query("move_images_root", f"""WITH {DOCS} SELECT slice_id, CASE WHEN slice_id % 4 = 0
  THEN '/moved/' || animal_id || '/slice' || slice_id || '.czi' ELSE filename END AS filename FROM docs""")
def move_images_root(spark, sf):
    docs = P.slice_documents(spark, sf)
    files = docs.filter("slice_id % 4 = 0").select(
        F.concat(F.lit("/moved/"), F.col("animal_id").cast("string"), F.lit("/slice"), F.col("slice_id").cast("string"), F.lit(".czi")).alias("path"))
    return S.move_images_root(docs, files, "/moved", "/images").select("slice_id", F.col("path.filename").alias("filename"))


@query("next_missing_param", f"""WITH {DOCS} SELECT animal_id, slice_id, pos, CASE WHEN NOT has_atlas THEN 'atlas' ELSE 'tps' END AS missing FROM docs
  WHERE NOT ignore AND NOT (has_atlas AND has_tps) ORDER BY animal_id, pos LIMIT 1""")
def next_missing_param(spark, sf):
    return S.next_missing_param(P.slice_documents(spark, sf))


@query("can_calculate_results", f"WITH {DOCS} SELECT count(*) = 0 AS ready FROM docs WHERE NOT ignore AND NOT (has_atlas AND has_tps)")
def can_calculate_results(spark, sf):
    return S.can_calculate_results(P.slice_documents(spark, sf))


@query("can_calculate_contrast", f"""WITH {SUBJECTS}, {DOCS}, c AS (SELECT count(*) = 0 AS complete FROM docs WHERE NOT ignore AND NOT (has_atlas AND has_tps))
  SELECT count(DISTINCT condition) >= 2 AND bool_and(condition IS NOT NULL) AND bool_and(complete) AS ready, bool_and(complete) AS params_complete,
  bool_and(condition IS NOT NULL) AS all_have_condition, count(DISTINCT condition) AS n_values FROM subjects, c""")
def can_calculate_contrast(spark, sf):
    return S.can_calculate_contrast(P.slice_documents(spark, sf), P.subjects(spark, sf), "segment")


@query("possible_contrasts", f"""WITH {SUBJECTS}, v AS (SELECT DISTINCT condition AS c FROM subjects)
  SELECT p.c AS a, q.c AS b FROM v p JOIN v q ON p.c < q.c""")
def possible_contrasts(spark, sf):
    return S.possible_contrasts(P.subjects(spark, sf))


@query("natural_sort", """WITH names AS (SELECT CASE WHEN c_custkey % 2 = 0 THEN 'Slice ' ELSE 'slice ' END || (c_custkey * 7919 % 100003) || ' of ' || c_nationkey AS name,
    c_custkey * 7919 % 100003 AS n, c_nationkey AS m FROM customer)
  SELECT name, CAST(m AS BIGINT) AS batch, rank() OVER (PARTITION BY m ORDER BY n) AS place FROM names""")
def natural_sort(spark, sf):
    number = F.col("c_custkey") * 7919 % 100003
    word = F.when(F.col("c_custkey") % 2 == 0, F.lit("Slice ")).otherwise(F.lit("slice "))
    names = P.table(spark, sf, "customer").select(
        F.concat(word, number.cast("string"), F.lit(" of "), F.col("c_nationkey").cast("string")).alias("name"), F.col("c_nationkey").cast("long").alias("batch"))
    keyed = S.natural_sort(names, "name")
    place = F.rank().over(Window.partitionBy("batch").orderBy("sort_key"))
    return keyed.select("name", "batch", place.cast("long").alias("place"))


@query("grid_layout", """WITH g AS (SELECT o_custkey AS subject, o_orderkey AS image_id, o_totalprice AS ap,
    o_orderkey % 50 + 10 AS width, o_custkey % 40 + 10 AS height FROM orders),
  p AS (SELECT *, coalesce(sum(width) OVER (PARTITION BY subject ORDER BY ap, image_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS gx FROM g),
  h AS (SELECT subject, max(height) AS h FROM g GROUP BY 1),
  r AS (SELECT subject, max(h) OVER (ORDER BY subject) AS run FROM h),
  y AS (SELECT subject, coalesce(sum(run) OVER (ORDER BY subject ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS gy FROM r)
  SELECT subject, image_id, CAST(gx AS BIGINT) AS grid_x, CAST(gy AS BIGINT) AS grid_y, width, height FROM p JOIN y USING (subject)""")
def grid_layout(spark, sf):
    images = P.table(spark, sf, "orders").select(
        F.col("o_custkey").alias("subject"), F.col("o_orderkey").alias("image_id"), F.col("o_totalprice").alias("ap"),
        (F.col("o_orderkey") % 50 + 10).alias("width"), (F.col("o_custkey") % 40 + 10).alias("height"),
    )
    return S.grid_layout(images)


@query("condition_values", f"WITH {SUBJECTS} SELECT DISTINCT condition FROM subjects WHERE condition IS NOT NULL")
def condition_values(spark, sf):
    return P.subjects(spark, sf).select("condition").distinct().filter(F.col("condition").isNotNull())


@query("condition_columns", f"WITH {SUBJECTS} SELECT animal_id, condition AS segment, nation FROM subjects")
def condition_columns(spark, sf):
    return P.subjects(spark, sf).select(
        "animal_id", *[F.element_at("conditions", k).alias(k) for k in ("segment", "nation")])


@query("resize_dims", f"""WITH d AS (SELECT p_partkey AS id, CAST(p_size * 37 AS BIGINT) AS h, CAST(p_size * 23 + 5 AS BIGINT) AS w FROM part)
  SELECT id, CAST(round_even(h / greatest(h / CAST(1024 AS DOUBLE), w / CAST(1024 AS DOUBLE)), 0) AS BIGINT) AS out_h,
    CAST(round_even(w / greatest(h / CAST(1024 AS DOUBLE), w / CAST(1024 AS DOUBLE)), 0) AS BIGINT) AS out_w FROM d""")
def resize_query(spark, sf):
    sizes = P.table(spark, sf, "part").select(
        F.col("p_partkey").alias("id"), (F.col("p_size") * 37).cast("long").alias("h"), (F.col("p_size") * 23 + 5).cast("long").alias("w"))
    h, w = resize_dims(F.col("h"), F.col("w"), size=(1024, 1024), keep_aspect=True)
    return sizes.select("id", h.alias("out_h"), w.alias("out_w"))


@query("rgb_from_packed", f"""SELECT p_partkey AS id, {R("((p_partkey * 7919) >> 16 & 255) / CAST(255 AS DOUBLE)")} AS r,
  {R("((p_partkey * 7919) >> 8 & 255) / CAST(255 AS DOUBLE)")} AS g, {R("((p_partkey * 7919) & 255) / CAST(255 AS DOUBLE)")} AS b FROM part""")
def rgb_query(spark, sf):
    rgb = rgb_from_packed(F.col("p_partkey") * 7919)
    return rounded(P.table(spark, sf, "part").select(
        F.col("p_partkey").alias("id"), *[F.get(rgb, F.lit(i)).alias(n) for i, n in enumerate("rgb")]))


@query("preview_box", f"""WITH {CELLS}, p AS (SELECT slice_id, CAST(trunc(x * 640) AS BIGINT) AS cx, CAST(trunc(y * 480) AS BIGINT) AS cy FROM cells)
  SELECT slice_id, greatest(0, least(cx - 50, 540)) AS x0, greatest(0, least(cy - 50, 380)) AS y0,
    least(greatest(0, least(cx - 50, 540)) + 100, 640) AS x1, least(greatest(0, least(cy - 50, 380)) + 100, 480) AS y1 FROM p""")
def preview_query(spark, sf):
    box = preview_box(F.col("x") * number(640), F.col("y") * number(480), 100, F.lit(640).cast("long"), F.lit(480).cast("long"))
    return P.cells(spark, sf).select("slice_id", box.alias("b")).select("slice_id", "b.*")


@query("struct_equality", f"WITH {DOCS} SELECT slice_id, NOT has_atlas AS same FROM docs")
def struct_equality(spark, sf):
    docs = P.slice_documents(spark, sf)
    empty = F.lit(None).cast(docs.schema["params"].dataType["atlas"].dataType)
    return docs.select("slice_id", structs_equal(F.col("params.atlas"), empty).alias("same"))
