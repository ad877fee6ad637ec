"""Queries over points, planes and pixels."""

from __future__ import annotations

from pyspark.sql import functions as F

from voxtally.functions.columns import number
from voxtally.operators import cells as C
from voxtally.operators import geometry as T
from voxtally.operators import raster as J
from voxtally.operators import regions as G
from voxtally.plans import project as P
from voxtally.plans.registry import R, query, rounded

HEIGHT, WIDTH = 480, 640
SHAPE = (20, 32, 32)

# The registration parameters of a slice, as SQL.
PARAMS = """
params AS (SELECT o_orderkey AS slice_id, o_orderpriority = '5-LOW' AS ignore, o_orderkey % 7 <> 0 AS has_atlas,
  radians(CAST(o_orderkey % 30 AS DOUBLE)) AS a, CAST(o_orderkey % 11 AS DOUBLE) AS tx, CAST(o_orderkey % 13 AS DOUBLE) AS ty,
  CAST(1 AS DOUBLE) + CAST(o_orderkey % 5 AS DOUBLE) / 10 AS sx, CAST(1 AS DOUBLE) + CAST(o_orderkey % 4 AS DOUBLE) / 10 AS sy,
  o_totalprice / CAST(1000 AS DOUBLE) AS ap, radians(CAST(o_orderkey % 4 AS DOUBLE)) AS rx, radians(CAST(o_orderkey % 5 AS DOUBLE)) AS ry FROM orders)"""
POINTS = f"""
points AS (SELECT l_orderkey AS slice_id, l_linenumber AS n, CAST(l_partkey % 97 AS DOUBLE) / 97 * {WIDTH} AS x,
  CAST(l_suppkey % 89 AS DOUBLE) / 89 * {HEIGHT} AS y FROM lineitem)"""
CX, CY = (WIDTH - 1) // 2, (HEIGHT - 1) // 2
AFFINE = f"""
moved AS (SELECT p.slice_id, p.n, q.ignore, q.has_atlas, q.ap, q.rx, q.ry,
  {CX} + q.sx * (cos(q.a) * (p.x - {CX}) - sin(q.a) * (p.y - {CY})) + q.tx AS x,
  {CY} + q.sy * (sin(q.a) * (p.x - {CX}) + cos(q.a) * (p.y - {CY})) + q.ty AS y FROM points p JOIN params q USING (slice_id))"""
DEPTH = f"""
turned AS (SELECT *, sqrt(rx * rx + ry * ry) AS th FROM moved),
axes AS (SELECT *, CASE WHEN th = 0 THEN 0 ELSE rx / th END AS kx, CASE WHEN th = 0 THEN 0 ELSE ry / th END AS ky,
  x - {SHAPE[2] // 2} AS dx, y - {SHAPE[1] // 2} AS dy, ap - {SHAPE[0] // 2} AS dz FROM turned),
atlas AS (SELECT slice_id, n, ignore,
  CASE WHEN has_atlas THEN {SHAPE[2] // 2} + (cos(th) + (1 - cos(th)) * kx * kx) * dx + (1 - cos(th)) * kx * ky * dy + sin(th) * ky * dz ELSE x END AS x,
  CASE WHEN has_atlas THEN {SHAPE[1] // 2} + (1 - cos(th)) * kx * ky * dx + (cos(th) + (1 - cos(th)) * ky * ky) * dy - sin(th) * kx * dz ELSE y END AS y,
  CASE WHEN has_atlas THEN {SHAPE[0] // 2} - sin(th) * ky * dx + sin(th) * kx * dy + cos(th) * dz END AS z FROM axes)"""
PIXELS = """
pixels AS (SELECT image_id, CAST(k // 8 AS INTEGER) AS y, CAST(k % 8 AS INTEGER) AS x, CAST(v AS DOUBLE) AS v
  FROM (SELECT vec_id AS image_id, generate_subscripts(embedding, 1) - 1 AS k, unnest(embedding) AS v FROM embeddings))"""


def documents(spark, sf):
    """Slices registered without a spline."""
    docs = P.slice_documents(spark, sf)
    plain = F.col("params").withField("tps", F.lit(None).cast(docs.schema["params"].dataType["tps"].dataType))
    return docs.withColumns({"params": plain, "lowres_height": F.lit(HEIGHT), "lowres_width": F.lit(WIDTH)})


def points(spark, sf):
    return P.table(spark, sf, "lineitem").select(
        F.col("l_orderkey").alias("slice_id"), F.col("l_linenumber").alias("n"),
        ((F.col("l_partkey") % 97).cast("double") / number(97) * WIDTH).alias("x"),
        ((F.col("l_suppkey") % 89).cast("double") / number(89) * HEIGHT).alias("y"),
    )


@query("affine2d", f"WITH {PARAMS}, {POINTS}, {AFFINE} SELECT slice_id, n, {R('x')} AS x, {R('y')} AS y FROM moved")
def affine2d(spark, sf):
    return rounded(T.to_atlas(points(spark, sf), documents(spark, sf), SHAPE, until="affine").select("slice_id", "n", "x", "y"))


@query("affine_inverse", f"WITH {POINTS} SELECT slice_id, n, {R('x')} AS x, {R('y')} AS y FROM points")
def affine_inverse(spark, sf):
    """There and back again."""
    forward = T.to_atlas(points(spark, sf), documents(spark, sf), SHAPE, until="affine")
    affine = documents(spark, sf).select("slice_id", F.col("params.affine").alias("_a"))
    back = T.affine_inverse(T.affine_matrix(F.col("_a"), number(CX), number(CY)))
    x, y = T.apply_affine(back, F.col("x"), F.col("y"))
    return rounded(forward.join(affine, "slice_id").select("slice_id", "n", x.alias("x"), y.alias("y")))


@query("to_atlas", f"WITH {PARAMS}, {POINTS}, {AFFINE}, {DEPTH} SELECT slice_id, n, {R('x')} AS x, {R('y')} AS y, {R('z')} AS z FROM atlas")
def to_atlas(spark, sf):
    return rounded(T.to_atlas(points(spark, sf), documents(spark, sf), SHAPE))


@query("cells_on_atlas", f"""WITH {PARAMS}, {POINTS}, {AFFINE}, {DEPTH}
  SELECT slice_id, n, {R('x')} AS x, {R('y')} AS y, {R('z')} AS z FROM atlas WHERE NOT ignore""")
def cells_on_atlas(spark, sf):
    cells = points(spark, sf).withColumns({"x": F.col("x") / WIDTH, "y": F.col("y") / HEIGHT})
    return rounded(T.cells_on_atlas(cells, documents(spark, sf), SHAPE))


@query("depth", f"""WITH {PARAMS}, {POINTS}, moved AS (SELECT p.*, q.ignore, q.has_atlas, q.ap, q.rx, q.ry FROM points p JOIN params q USING (slice_id)), {DEPTH}
  SELECT slice_id, n, {R('x')} AS x, {R('y')} AS y, {R('z')} AS z FROM atlas WHERE z IS NOT NULL""")
def depth(spark, sf):
    atlas = documents(spark, sf).select("slice_id", F.col("params.atlas").alias("_a")).filter(F.col("_a").isNotNull())
    x, y, z = T.depth_point(F.col("x"), F.col("y"), F.col("_a.ap"), F.col("_a.rot_sagittal"), F.col("_a.rot_horizontal"), SHAPE)
    return rounded(points(spark, sf).join(atlas, "slice_id").select("slice_id", "n", x.alias("x"), y.alias("y"), z.alias("z")))


@query("tps", f"""WITH k AS (SELECT o_orderkey AS slice_id, generate_series AS i FROM orders, generate_series(0, 8))
  SELECT slice_id, i, {R('i % 3 * 100 + (slice_id * 7 + i * 3) % 11', 3)} AS x, {R('i // 3 * 90 + (slice_id * 5 + i) % 7', 3)} AS y FROM k""")
def tps(spark, sf):
    """The spline of nine control points, at these points: where it must meet their targets."""
    i = F.sequence(F.lit(0), F.lit(8))
    key = F.col("o_orderkey")
    src = F.transform(i, lambda k: F.array((k % 3 * 100).cast("double"), (F.floor(k / 3) * 90).cast("double")))
    dst = F.transform(i, lambda k: F.array((k % 3 * 100 + (key * 7 + k * 3) % 11).cast("double"), (F.floor(k / 3) * 90 + (key * 5 + k) % 7).cast("double")))
    control = P.table(spark, sf, "orders").select(key.alias("slice_id"), src.alias("points_src"), dst.alias("points_dst"))
    splines = T.fit_splines(control)
    at = control.select("slice_id", F.posexplode("points_src").alias("i", "p")).join(splines.hint("merge"), "slice_id")
    x, y = T.apply_spline(F.col("knots"), F.col("flat"), F.col("p")[0], F.col("p")[1])
    return rounded(at.select("slice_id", F.col("i").cast("long").alias("i"), x.alias("x"), y.alias("y")), 3)


BOXES = f"""{PIXELS}, sized AS (SELECT image_id, max(x) + 1 AS w, max(y) + 1 AS h FROM pixels GROUP BY 1),
lit AS (SELECT image_id, min(x) AS x0, max(x) AS x1, min(y) AS y0, max(y) AS y1 FROM pixels WHERE v > 0.2 GROUP BY 1),
boxes AS (SELECT s.image_id, coalesce(x0, 0) AS x, coalesce(y0, 0) AS y, coalesce(x1 + 1 - x0, s.w) AS w, coalesce(y1 + 1 - y0, s.h) AS h FROM sized s LEFT JOIN lit USING (image_id))"""


def boxes(spark, sf):
    return J.nonzero_bbox(P.pixels(spark, sf), F.col("v") > number(0.2))


@query("nonzero_bbox", f"WITH {BOXES} SELECT * FROM boxes")
def nonzero_bbox(spark, sf):
    return boxes(spark, sf)


@query("fit_box_affine", f"""WITH {BOXES} SELECT image_id, CAST(0 AS DOUBLE) AS angle, {R('4 - (x + w / CAST(2 AS DOUBLE))')} AS tx,
  {R('5 - (y + h / CAST(2 AS DOUBLE))')} AS ty, {R('6 / CAST(w AS DOUBLE)')} AS sx, {R('8 / CAST(h AS DOUBLE)')} AS sy,
  {R('x + w / CAST(2 AS DOUBLE)')} AS cx, {R('y + h / CAST(2 AS DOUBLE)')} AS cy FROM boxes""")
def fit_box_affine(spark, sf):
    target = F.struct(*[F.lit(v).alias(k) for k, v in (("x", 1), ("y", 1), ("w", 6), ("h", 8))])
    fitted = T.fit_box_affine(F.struct("x", "y", "w", "h"), target)
    return rounded(boxes(spark, sf).select("image_id", fitted.alias("p")).select("image_id", "p.*"))


@query("padded_box", f"""WITH {BOXES}, p AS (SELECT *, CAST(trunc(w * CAST(0.3 AS DOUBLE)) AS INTEGER) AS px, CAST(trunc(h * CAST(0.3 AS DOUBLE)) AS INTEGER) AS py FROM boxes)
  SELECT image_id, greatest(x - px, 0) AS x0, greatest(y - py, 0) AS y0, least(x + w + px, 8) AS x1, least(y + h + py, 8) AS y1 FROM p""")
def padded_box(spark, sf):
    box = J.padded_box(F.struct("x", "y", "w", "h"), F.lit(8), F.lit(8), 0.3)
    return boxes(spark, sf).select("image_id", box.alias("b")).select("image_id", "b.*")


@query("control_grid", f"""WITH {BOXES}, k AS (SELECT *, generate_series AS i FROM boxes, generate_series(0, 23))
  SELECT image_id, i, {R('x + w * (i % 6) / CAST(5 AS DOUBLE)')} AS px, {R('y + h * (i // 6) / CAST(3 AS DOUBLE)')} AS py FROM k""")
def control_grid(spark, sf):
    grid = T.control_grid(boxes(spark, sf)).select("image_id", F.posexplode("points_src").alias("i", "p"))
    return rounded(grid.select("image_id", F.col("i").cast("long").alias("i"), F.col("p")[0].alias("px"), F.col("p")[1].alias("py")))


PLANES = """planes AS (SELECT c_custkey AS plane, CAST(c_custkey % 7 AS DOUBLE) AS ap, radians(CAST(c_custkey % 4 AS DOUBLE)) AS f,
  radians(CAST(c_custkey % 5 AS DOUBLE)) AS h, radians(CAST(c_custkey % 3 AS DOUBLE)) AS s FROM customer),
grid AS (SELECT planes.*, CAST(y.generate_series AS INTEGER) AS y, CAST(x.generate_series AS INTEGER) AS x FROM planes, generate_series(0, 7) y, generate_series(0, 7) x),
r0 AS (SELECT *, cos(f) * (y - CAST(3.5 AS DOUBLE)) - sin(f) * (x - CAST(3.5 AS DOUBLE)) AS b1, sin(f) * (y - CAST(3.5 AS DOUBLE)) + cos(f) * (x - CAST(3.5 AS DOUBLE)) AS b2 FROM grid),
coords AS (SELECT plane, y, x, cos(s) * (-sin(h) * b2) - sin(s) * b1 + ap AS c0, sin(s) * (-sin(h) * b2) + cos(s) * b1 + 8 AS c1, cos(h) * b2 + 8 AS c2 FROM r0)"""
VOXELS = """voxels AS (SELECT CAST(p_partkey // 256 AS INTEGER) AS z, CAST(p_partkey // 16 % 16 AS INTEGER) AS y, CAST(p_partkey % 16 AS INTEGER) AS x,
  CAST(100 + (p_partkey // 256 * 31 + p_partkey // 16 % 16 * 7 + p_partkey % 16) % 25 AS INTEGER) AS struct_id FROM part)"""


def coordinates(spark, sf):
    key = F.col("c_custkey")
    planes = P.table(spark, sf, "customer").select(
        key.alias("plane"), (key % 7).cast("double").alias("ap"), number(8).alias("si"), number(8).alias("lr"),
        (key % 4).cast("double").alias("rot_frontal"), (key % 5).cast("double").alias("rot_horizontal"), (key % 3).cast("double").alias("rot_sagittal"),
    )
    return T.slice_coordinates(planes, 8, 8).select("plane", "y", "x", "c0", "c1", "c2")


@query("slice_coordinates", f"WITH {PLANES} SELECT plane, y, x, {R('c0')} AS c0, {R('c1')} AS c1, {R('c2')} AS c2 FROM coords")
def slice_coordinates(spark, sf):
    return rounded(coordinates(spark, sf))


# Coordinates are rounded first, so that a pixel half way between two voxels rounds alike in both engines.
@query("slice_volume_nearest", f"""WITH {PLANES}, {VOXELS}, pt AS (SELECT plane, y, x, CAST(round_even({R('c0')}, 0) AS INTEGER) AS z0,
    CAST(round_even({R('c1')}, 0) AS INTEGER) AS y0, CAST(round_even({R('c2')}, 0) AS INTEGER) AS x0 FROM coords)
  SELECT pt.plane, pt.y, pt.x, coalesce(v.struct_id, 0) AS struct_id FROM pt LEFT JOIN voxels v ON v.z = z0 AND v.y = y0 AND v.x = x0""")
def slice_volume_nearest(spark, sf):
    return T.slice_volume(P.voxels(spark, sf), rounded(coordinates(spark, sf)), "struct_id").select("plane", "y", "x", "struct_id")


@query("slice_volume_linear", f"""WITH {PLANES}, {VOXELS}, c AS (SELECT plane, y, x, {R('c0')} AS c0, {R('c1')} AS c1, {R('c2')} AS c2 FROM coords),
  b AS (SELECT * FROM (VALUES (0), (1)) t(b)),
  k AS (SELECT plane, c.y, c.x, CAST(floor(c0) + p.b AS INTEGER) AS z0, CAST(floor(c1) + q.b AS INTEGER) AS y0, CAST(floor(c2) + r.b AS INTEGER) AS x0,
    (CASE p.b WHEN 1 THEN c0 - floor(c0) ELSE 1 - c0 + floor(c0) END) * (CASE q.b WHEN 1 THEN c1 - floor(c1) ELSE 1 - c1 + floor(c1) END) * (CASE r.b WHEN 1 THEN c2 - floor(c2) ELSE 1 - c2 + floor(c2) END) AS w
    FROM c, b p, b q, b r)
  SELECT plane, k.y, k.x, {R('sum(coalesce(v.struct_id, 0) * w)', 4)} AS struct_id FROM k LEFT JOIN voxels v ON v.z = z0 AND v.y = y0 AND v.x = x0 GROUP BY ALL""")
def slice_volume_linear(spark, sf):
    sampled = T.slice_volume(P.voxels(spark, sf), rounded(coordinates(spark, sf)), "struct_id", "linear")
    return rounded(sampled.select("plane", "y", "x", "struct_id"), 4)


@query("registered_values", f"""WITH {PARAMS}, g AS (SELECT slice_id, CAST(y.generate_series AS INTEGER) AS iy, CAST(x.generate_series AS INTEGER) AS ix, a, tx, ty, sx, sy
    FROM params, generate_series(0, 5) y, generate_series(0, 7) x),
  low AS (SELECT *, floor(ix * 4 / 8) AS x, floor(iy * 3 / 6) AS y FROM g),
  pt AS (SELECT slice_id, iy, ix, CAST(round_even(1 + sx * (cos(a) * (x - 1) - sin(a) * (y - 1)) + tx, 0) AS INTEGER) AS x,
    CAST(round_even(1 + sy * (sin(a) * (x - 1) + cos(a) * (y - 1)) + ty, 0) AS INTEGER) AS y FROM low),
  plane AS (SELECT l_orderkey AS slice_id, CAST(l_linenumber % 4 AS INTEGER) AS y, CAST(l_linenumber AS INTEGER) AS x, 100 + l_partkey % 25 AS value FROM lineitem)
  SELECT pt.slice_id, iy AS y, ix AS x, CAST(coalesce(p.value, 0) AS BIGINT) AS value FROM pt LEFT JOIN plane p ON p.slice_id = pt.slice_id AND p.y = pt.y AND p.x = pt.x""")
def registered_values(spark, sf):
    docs = documents(spark, sf).withColumns({"lowres_height": F.lit(3), "lowres_width": F.lit(4)})
    plane = P.table(spark, sf, "lineitem").select(
        F.col("l_orderkey").alias("slice_id"), (F.col("l_linenumber") % 4).cast("int").alias("y"), F.col("l_linenumber").cast("int").alias("x"),
        (F.lit(100) + F.col("l_partkey") % 25).alias("value"))
    return T.registered_values(docs, plane, SHAPE, 6, 8)


def _places_sql(resolution: tuple[float, float, float]) -> str:
    """Each image pixel's pixel (x, y) of the slice's plane, and where that lies in the volume."""
    depth, height, width = SHAPE
    ma, mb = (height - 1) / 2, (width - 1) / 2
    places = {
        "c0": f"cos(rx) * (-sin(ry) * (x - {mb})) - sin(rx) * (y - {ma}) + ap",
        "c1": f"sin(rx) * (-sin(ry) * (x - {mb})) + cos(rx) * (y - {ma}) + {height // 2}",
        "c2": f"cos(ry) * (x - {mb}) + {width // 2}",
    }
    inside = f"x BETWEEN 0 AND {width - 1} AND y BETWEEN 0 AND {height - 1}"
    columns = ", ".join(f"CAST(CASE WHEN {inside} THEN round_even(({e}) * CAST({u} AS DOUBLE), 0) ELSE 0 END AS BIGINT) AS {c}" for (c, e), u in zip(places.items(), resolution))
    return f"""WITH {PARAMS}, g AS (SELECT params.*, CAST(y.generate_series AS INTEGER) AS iy, CAST(x.generate_series AS INTEGER) AS ix
    FROM params, generate_series(0, 5) y, generate_series(0, 7) x WHERE has_atlas),
  low AS (SELECT *, floor(ix * 4 / 8) AS lx, floor(iy * 3 / 6) AS ly FROM g),
  pt AS (SELECT slice_id, iy, ix, ap, rx, ry, CAST(round_even(1 + sx * (cos(a) * (lx - 1) - sin(a) * (ly - 1)) + tx, 0) AS INTEGER) AS x,
    CAST(round_even(1 + sy * (sin(a) * (lx - 1) + cos(a) * (ly - 1)) + ty, 0) AS INTEGER) AS y FROM low)
  SELECT slice_id, iy AS y, ix AS x, {columns} FROM pt"""


MICRONS = (50.0, 25.0, 25.0)


def _places(spark, sf, resolution=None):
    docs = documents(spark, sf).withColumns({"lowres_height": F.lit(3), "lowres_width": F.lit(4)})
    return T.registered_coordinates(docs, SHAPE, 6, 8, resolution)


@query("registered_pixel_coordinates", _places_sql((1.0, 1.0, 1.0)))
def registered_pixel_coordinates(spark, sf):
    return _places(spark, sf)


@query("registered_micron_coordinates", _places_sql(MICRONS))
def registered_micron_coordinates(spark, sf):
    return _places(spark, sf, MICRONS)


def small_documents(spark, sf):
    key = F.col("vec_id")
    affine = F.struct((key % 9).cast("double").alias("angle"), (key % 3).cast("double").alias("tx"), number(1).alias("ty"), number(1.25).alias("sx"), number(1).alias("sy"))
    return P.table(spark, sf, "embeddings").select(key.alias("slice_id"), F.struct(affine.alias("affine")).alias("params"), F.lit(8).alias("lowres_height"), F.lit(8).alias("lowres_width"))


@query("warp_image", f"""WITH {PIXELS}, p AS (SELECT vec_id AS image_id, radians(CAST(vec_id % 9 AS DOUBLE)) AS t, CAST(vec_id % 3 AS DOUBLE) AS tx FROM embeddings),
  g AS (SELECT p.*, oy.generate_series AS oy, ox.generate_series AS ox, (ox.generate_series - 3 - tx) / CAST(1.25 AS DOUBLE) AS u, oy.generate_series - 3 - 1 AS w
    FROM p, generate_series(0, 7) oy, generate_series(0, 7) ox),
  s AS (SELECT image_id, oy, ox, 3 + cos(t) * u + sin(t) * w AS sx, 3 - sin(t) * u + cos(t) * w AS sy FROM g), b AS (SELECT * FROM (VALUES (0), (1)) t(b)),
  k AS (SELECT image_id, oy, ox, CAST(floor(sy) + p.b AS INTEGER) AS y, CAST(floor(sx) + q.b AS INTEGER) AS x,
    (CASE p.b WHEN 1 THEN sy - floor(sy) ELSE 1 - sy + floor(sy) END) * (CASE q.b WHEN 1 THEN sx - floor(sx) ELSE 1 - sx + floor(sx) END) AS w FROM s, b p, b q)
  SELECT k.image_id AS slice_id, CAST(oy AS INTEGER) AS y, CAST(ox AS INTEGER) AS x, {R('sum(coalesce(i.v, 0) * k.w)')} AS v
  FROM k LEFT JOIN pixels i ON i.image_id = k.image_id AND i.y = k.y AND i.x = k.x GROUP BY ALL""")
def warp_image(spark, sf):
    pixels = P.pixels(spark, sf).withColumnRenamed("image_id", "slice_id")
    return rounded(T.warp_image(pixels, small_documents(spark, sf), 8, 8))


@query("warp_image_nearest", f"""WITH {PIXELS}, p AS (SELECT vec_id AS image_id, radians(CAST(vec_id % 9 AS DOUBLE)) AS t, CAST(vec_id % 3 AS DOUBLE) AS tx FROM embeddings),
  g AS (SELECT p.*, oy.generate_series AS oy, ox.generate_series AS ox, (ox.generate_series - 3 - tx) / CAST(1.25 AS DOUBLE) AS u, oy.generate_series - 3 - 1 AS w
    FROM p, generate_series(0, 7) oy, generate_series(0, 7) ox),
  s AS (SELECT image_id, oy, ox, CAST(round_even(3 + cos(t) * u + sin(t) * w, 0) AS INTEGER) AS x, CAST(round_even(3 - sin(t) * u + cos(t) * w, 0) AS INTEGER) AS y FROM g)
  SELECT s.image_id AS slice_id, CAST(oy AS INTEGER) AS y, CAST(ox AS INTEGER) AS x, {R('coalesce(i.v, 0)')} AS v
  FROM s LEFT JOIN pixels i ON i.image_id = s.image_id AND i.y = s.y AND i.x = s.x""")
def warp_image_nearest(spark, sf):
    pixels = P.pixels(spark, sf).withColumnRenamed("image_id", "slice_id")
    return rounded(T.warp_image(pixels, small_documents(spark, sf), 8, 8, "nearest"))


@query("warp_image_spline")
def warp_image_spline(spark, sf):
    """Through the inverse of a spline of nine control points, then that of the affine part."""
    i, key = F.sequence(F.lit(0), F.lit(8)), F.col("slice_id")
    src = F.transform(i, lambda k: F.array((k % 3 * 4).cast("double"), (F.floor(k / 3) * 4).cast("double")))
    dst = F.transform(i, lambda k: F.array(k % 3 * 4 + (key + k) % 3 / number(4), F.floor(k / 3) * 4 + (key * 5 + k) % 4 / number(4)))
    docs = small_documents(spark, sf).withColumn("params", F.struct("params.affine", F.struct(src.alias("points_src"), dst.alias("points_dst")).alias("tps")))
    pixels = P.pixels(spark, sf).withColumnRenamed("image_id", "slice_id")
    return rounded(T.warp_image(pixels, docs, 8, 8))


# ------------------------------------------------------------------ pixels
@query("normalize_minmax", f"""WITH {PIXELS}, e AS (SELECT image_id, min(v) AS a, max(v) AS b FROM pixels GROUP BY 1)
  SELECT image_id, y, x, {R('(v - a) / (b - a)')} AS v FROM pixels JOIN e USING (image_id)""")
def normalize_minmax(spark, sf):
    return rounded(J.normalize(P.pixels(spark, sf)))


@query("normalize_quantile", f"""WITH {PIXELS}, e AS (SELECT image_id, quantile_cont(v, 0.01) AS a, quantile_cont(v, 0.998) AS b FROM pixels GROUP BY 1)
  SELECT image_id, y, x, {R('(greatest(least(v, b), a) - a) / (b - a)')} AS v FROM pixels JOIN e USING (image_id)""")
def normalize_quantile(spark, sf):
    return rounded(J.normalize(P.pixels(spark, sf), quantiles=(0.01, 0.998)))


@query("normalize_range", f"WITH {PIXELS} SELECT image_id, y, x, {R('(greatest(least(v, CAST(0.2 AS DOUBLE)), CAST(-0.1 AS DOUBLE)) + CAST(0.1 AS DOUBLE)) / CAST(0.3 AS DOUBLE)')} AS v FROM pixels")
def normalize_range(spark, sf):
    return rounded(J.normalize(P.pixels(spark, sf), limits=(-0.1, 0.2)))


HISTOGRAM = f"""{PIXELS}, e AS (SELECT image_id, min(v) AS a, max(v) AS b, (max(v) - min(v)) / CAST(64 AS DOUBLE) AS bw FROM pixels GROUP BY 1),
h AS (SELECT image_id, a, bw, CAST(least(floor((v - a) / bw), 63) AS INTEGER) AS k, count(*) AS n FROM pixels JOIN e USING (image_id) GROUP BY ALL),
f AS (SELECT *, coalesce(sum(n) FILTER (k = 0) OVER w, 0) > coalesce(sum(n) FILTER (k = 1) OVER w, 0) AS f0,
  coalesce(sum(n) FILTER (k = 63) OVER w, 0) > coalesce(sum(n) FILTER (k = 62) OVER w, 0) AS f1 FROM h WINDOW w AS (PARTITION BY image_id)),
c AS (SELECT * FROM f WHERE NOT (k = 0 AND f0) AND NOT (k = 63 AND f1)),
s AS (SELECT *, sum(n) OVER (PARTITION BY image_id) * CAST(0.05 AS DOUBLE) - coalesce(sum(n) OVER (PARTITION BY image_id ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS u,
  sum(n) OVER (PARTITION BY image_id) * CAST(0.05 AS DOUBLE) - coalesce(sum(n) OVER (PARTITION BY image_id ORDER BY k DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS d FROM c),
limits AS (SELECT image_id, min(a + (k + u / n) * bw) FILTER (u >= 0 AND u < n) AS low, max(a + (k + 1 - d / n) * bw) FILTER (d >= 0 AND d < n) AS high FROM s GROUP BY 1)"""


@query("saturation_limits", f"WITH {HISTOGRAM} SELECT image_id, {R('low')} AS low, {R('high')} AS high FROM limits")
def saturation_limits(spark, sf):
    return rounded(J.saturation_limits(P.pixels(spark, sf), 0.05, 64))


@query("to_uint8_saturated", f"""WITH {HISTOGRAM}, k AS (SELECT image_id, y, x, greatest(least(v, high), low) AS v FROM pixels JOIN limits USING (image_id)),
  m AS (SELECT image_id, min(v) AS a, max(v) AS b FROM k GROUP BY 1)
  SELECT image_id, y, x, CAST(round_even((v - a) / (b - a) * 255, 0) AS INTEGER) AS v FROM k JOIN m USING (image_id)""")
def to_uint8_saturated(spark, sf):
    return J.to_uint8_saturated(P.pixels(spark, sf), 0.05, 64)


@query("shrink", f"WITH {PIXELS} SELECT image_id, CAST(y // 3 AS INTEGER) AS y, CAST(x // 3 AS INTEGER) AS x, {R('avg(v)')} AS v FROM pixels WHERE y < 6 AND x < 6 GROUP BY ALL")
def shrink(spark, sf):
    return rounded(J.shrink(P.pixels(spark, sf), 3))


@query("resize", f"""WITH {PIXELS}, g AS (SELECT vec_id AS image_id, oy.generate_series AS oy, ox.generate_series AS ox,
    greatest(least((oy.generate_series + CAST(0.5 AS DOUBLE)) * 8 / 5 - CAST(0.5 AS DOUBLE), 7), 0) AS sy, greatest(least((ox.generate_series + CAST(0.5 AS DOUBLE)) * 8 / 6 - CAST(0.5 AS DOUBLE), 7), 0) AS sx
    FROM embeddings, generate_series(0, 4) oy, generate_series(0, 5) ox), b AS (SELECT * FROM (VALUES (0), (1)) t(b)),
  k AS (SELECT image_id, oy, ox, CAST(least(floor(sy) + p.b, 7) AS INTEGER) AS y, CAST(least(floor(sx) + q.b, 7) AS INTEGER) AS x,
    (CASE p.b WHEN 1 THEN sy - floor(sy) ELSE 1 - sy + floor(sy) END) * (CASE q.b WHEN 1 THEN sx - floor(sx) ELSE 1 - sx + floor(sx) END) AS w FROM g, b p, b q)
  SELECT k.image_id, CAST(oy AS INTEGER) AS y, CAST(ox AS INTEGER) AS x, {R('sum(i.v * k.w)')} AS v
  FROM k JOIN pixels i ON i.image_id = k.image_id AND i.y = k.y AND i.x = k.x GROUP BY ALL""")
def resize(spark, sf):
    return rounded(J.resize(P.pixels(spark, sf), 5, 6))


MASK = f"""{PIXELS}, lv AS (SELECT image_id, v, count(*) AS n FROM pixels GROUP BY 1, 2),
su AS (SELECT image_id, v, sum(n) OVER u AS n0, sum(v * n) OVER u AS s0, sum(n) OVER w AS nt, sum(v * n) OVER w AS st FROM lv
  WINDOW u AS (PARTITION BY image_id ORDER BY v ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), w AS (PARTITION BY image_id)),
be AS (SELECT image_id, v, round(n0 * (nt - n0) * power(s0 / n0 - (st - s0) / (nt - n0), 2), 6) AS b FROM su WHERE nt > n0),
cut AS (SELECT image_id, arg_min(v, row(-b, v)) AS cut FROM be GROUP BY 1),
mask AS (SELECT p.*, coalesce(p.v > c.cut, false) AS mask FROM pixels p LEFT JOIN cut c USING (image_id))"""


@query("two_class_mask", f"WITH {MASK} SELECT image_id, y, x, mask FROM mask")
def two_class_mask(spark, sf):
    return J.two_class_mask(P.pixels(spark, sf)).select("image_id", "y", "x", "mask")


@query("filter_on_tissue", f"""WITH {MASK} SELECT l_orderkey AS cell, l_linenumber AS n FROM lineitem JOIN mask m
  ON m.image_id = l_orderkey % 500 AND m.mask AND m.x = CAST(floor(CAST(l_partkey % 97 AS DOUBLE) / 97 * 8) AS INTEGER) AND m.y = CAST(floor(CAST(l_suppkey % 89 AS DOUBLE) / 89 * 8) AS INTEGER)""")
def filter_on_tissue(spark, sf):
    cells = points(spark, sf).select(F.col("slice_id").alias("cell"), "n", (F.col("slice_id") % 500).alias("slice_id"), (F.col("x") / WIDTH).alias("x"), (F.col("y") / HEIGHT).alias("y"))
    return C.filter_on_tissue(cells, P.pixels(spark, sf)).select("cell", "n")


@query("contrast_limits", f"""WITH {PIXELS} SELECT image_id, {R('quantile_cont(v, 0.01)')} AS low, {R('quantile_cont(v, 0.98) + CAST(1e-8 AS DOUBLE)')} AS high,
  {R('min(v)')} AS range_low, {R('max(v) + CAST(1e-8 AS DOUBLE)')} AS range_high FROM pixels WHERE v > 0 GROUP BY image_id""")
def contrast_limits(spark, sf):
    return rounded(J.contrast_limits(P.pixels(spark, sf)))


def blobs(spark, sf):
    return J.connected_components(P.pixels(spark, sf).withColumn("mask", F.col("v") > 0))


@query("connected_components")
def connected_components(spark, sf):
    return blobs(spark, sf)


@query("component_boxes")
def component_boxes(spark, sf):
    return J.component_boxes(blobs(spark, sf), 2.5)


@query("tissue_mask")
def tissue_mask(spark, sf):
    return J.tissue_mask(P.pixels(spark, sf))


@query("outline", f"""WITH {PIXELS}, s AS (SELECT image_id, y, x, CAST(floor(v * 5) AS INTEGER) AS v FROM pixels),
  d AS (SELECT image_id, y, x, coalesce(lead(v) OVER r, v) <> coalesce(lag(v) OVER r, v) OR coalesce(lead(v) OVER c, v) <> coalesce(lag(v) OVER c, v) AS d FROM s
    WINDOW r AS (PARTITION BY image_id, y ORDER BY x), c AS (PARTITION BY image_id, x ORDER BY y))
  SELECT image_id, y, x, CASE WHEN d THEN 255 ELSE 0 END AS v FROM d""")
def outline(spark, sf):
    return J.outline(P.pixels(spark, sf).withColumn("v", F.floor(F.col("v") * 5)))


@query("gradient_norm", f"""WITH {PIXELS}, n AS (SELECT *, lag(v) OVER r AS l, lead(v) OVER r AS m, lag(v) OVER c AS t, lead(v) OVER c AS b FROM pixels
    WINDOW r AS (PARTITION BY image_id, y ORDER BY x), c AS (PARTITION BY image_id, x ORDER BY y)),
  g AS (SELECT *, CASE WHEN l IS NULL THEN m - v WHEN m IS NULL THEN v - l ELSE (m - l) / 2 END AS gx, CASE WHEN t IS NULL THEN b - v WHEN b IS NULL THEN v - t ELSE (b - t) / 2 END AS gy FROM n)
  SELECT image_id, y, x, {R('sqrt(power(least(gx, 0.1::DOUBLE), 2) + power(least(gy, 0.1::DOUBLE), 2))')} AS grad FROM g""")
def gradient_norm(spark, sf):
    return rounded(J.gradient_norm(P.pixels(spark, sf), 0.1).select("image_id", "y", "x", "grad"))


@query("sharpness")
def sharpness(spark, sf):
    return rounded(J.sharpness(P.pixels(spark, sf)))


@query("opening", f"""WITH {PIXELS}, m AS (SELECT image_id, y, x, CASE WHEN v > CAST(-0.15 AS DOUBLE) THEN 1 ELSE 0 END AS m FROM pixels),
  e AS (SELECT a.image_id, a.y, a.x, min(b.m) AS m FROM m a JOIN m b ON a.image_id = b.image_id AND abs(a.y - b.y) <= 1 AND abs(a.x - b.x) <= 1 GROUP BY ALL)
  SELECT a.image_id, a.y, a.x, max(b.m) = 1 AS mask FROM e a JOIN e b ON a.image_id = b.image_id AND abs(a.y - b.y) <= 1 AND abs(a.x - b.x) <= 1 GROUP BY ALL""")
def opening(spark, sf):
    return J.opening(P.pixels(spark, sf).withColumn("mask", F.col("v") > number(-0.15)), 3)


@query("opening_disk", f"""WITH {PIXELS}, m AS (SELECT image_id, y, x, CASE WHEN v > CAST(-0.15 AS DOUBLE) THEN 1 ELSE 0 END AS m FROM pixels),
  e AS (SELECT a.image_id, a.y, a.x, min(b.m) AS m FROM m a JOIN m b ON a.image_id = b.image_id AND (a.y - b.y) * (a.y - b.y) + (a.x - b.x) * (a.x - b.x) <= 4 GROUP BY ALL)
  SELECT a.image_id, a.y, a.x, max(b.m) = 1 AS mask FROM e a JOIN e b ON a.image_id = b.image_id AND (a.y - b.y) * (a.y - b.y) + (a.x - b.x) * (a.x - b.x) <= 4 GROUP BY ALL""")
def opening_disk(spark, sf):
    return J.opening(P.pixels(spark, sf).withColumn("mask", F.col("v") > number(-0.15)), 2, "disk")


ANNOTATED = "abs(x - 7 - z % 2) + abs(y - 8) < 5 + z % 4 OR (x = 15 AND y < 3)"


@query("plane_bbox", f"""WITH {VOXELS}, m AS (SELECT z, y, x, CASE WHEN {ANNOTATED} THEN 1 ELSE 0 END AS m FROM voxels),
  e AS (SELECT a.z, a.y, a.x, min(b.m) AS m FROM m a JOIN m b ON a.z = b.z AND abs(a.y - b.y) <= 2 AND abs(a.x - b.x) <= 2 GROUP BY ALL),
  d AS (SELECT a.z, a.y, a.x, max(b.m) AS m FROM e a JOIN e b ON a.z = b.z AND abs(a.y - b.y) <= 2 AND abs(a.x - b.x) <= 2 GROUP BY ALL),
  lit AS (SELECT z, min(x) AS x0, max(x) AS x1, min(y) AS y0, max(y) AS y1 FROM d WHERE m = 1 GROUP BY z)
  SELECT s.z, coalesce(x0, 0) AS x, coalesce(y0, 0) AS y, coalesce(x1 + 1 - x0, w) AS w, coalesce(y1 + 1 - y0, h) AS h
  FROM (SELECT z, max(x) + 1 AS w, max(y) + 1 AS h FROM voxels GROUP BY z) s LEFT JOIN lit USING (z)""")
def plane_bbox(spark, sf):
    """The box of each atlas plane's annotation."""
    voxels = P.voxels(spark, sf).withColumn("struct_id", F.when(F.expr(ANNOTATED), F.col("struct_id")).otherwise(F.lit(0)))
    return J.plane_bbox(voxels)


@query("outline_wide", f"""WITH s AS (SELECT o_orderkey // 1200 AS image_id, CAST(o_orderkey % 1200 AS INTEGER) AS x, CAST(y.generate_series AS INTEGER) AS y, (o_orderkey + y.generate_series * 7) // 90 % 3 AS v
    FROM orders, generate_series(0, 3) y),
  d AS (SELECT image_id, y, x, CASE WHEN coalesce(lead(v) OVER r, v) <> coalesce(lag(v) OVER r, v) OR coalesce(lead(v) OVER c, v) <> coalesce(lag(v) OVER c, v) THEN 255 ELSE 0 END AS v FROM s
    WINDOW r AS (PARTITION BY image_id, y ORDER BY x), c AS (PARTITION BY image_id, x ORDER BY y)),
  k AS (SELECT image_id, (max(x) + 1) // 512 AS k FROM s GROUP BY 1),
  a AS (SELECT image_id, y, x, v, max(v) OVER (PARTITION BY image_id, y ORDER BY x ROWS BETWEEN 1 PRECEDING AND CURRENT ROW) AS w FROM d),
  b AS (SELECT image_id, y, x, v, max(w) OVER (PARTITION BY image_id, x ORDER BY y ROWS BETWEEN 1 PRECEDING AND CURRENT ROW) AS w FROM a)
  SELECT image_id, y, x, CASE WHEN k > 1 THEN w ELSE v END AS v FROM b JOIN k USING (image_id)""")
def outline_wide(spark, sf):
    """Planes of 1200 pixels, whose outlines are widened, and a narrower one."""
    key = F.col("o_orderkey")
    rows = P.table(spark, sf, "orders").select(F.floor(key / 1200).alias("image_id"), (key % 1200).cast("int").alias("x"), F.explode(F.sequence(F.lit(0), F.lit(3))).alias("y"), key.alias("k"))
    return J.outline(rows.select("image_id", "y", "x", (F.floor((F.col("k") + F.col("y") * 7) / 90) % 3).alias("v")))


@query("filter_on_annotation", f"""WITH {POINTS}, {PARAMS}, {AFFINE},
  plane AS (SELECT DISTINCT l_orderkey AS slice_id, CAST(l_linenumber * 60 + b.generate_series AS INTEGER) AS y, CAST(l_partkey % 16 * 40 + c.generate_series AS INTEGER) AS x
    FROM lineitem, generate_series(0, 5) b, generate_series(0, 5) c)
  SELECT m.slice_id, m.n FROM moved m JOIN plane p ON p.slice_id = m.slice_id AND p.y = CAST(trunc(m.y) AS INTEGER) AND p.x = CAST(trunc(m.x) AS INTEGER)
  WHERE m.x >= 0 AND m.x < {WIDTH} AND m.y >= 0 AND m.y < {HEIGHT}""")
def filter_on_annotation(spark, sf):
    """Cells whose place on the registered slice is annotated."""
    cells = points(spark, sf).withColumn("cell_id", F.concat_ws(" ", "slice_id", "n", "x", "y"))
    on_slice = T.to_atlas(cells, documents(spark, sf), SHAPE, until="affine").select("cell_id", "slice_id", "x", "y")
    square = F.sequence(F.lit(0), F.lit(5))
    plane = P.table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("slice_id"), (F.col("l_linenumber") * 60).alias("_y"), (F.col("l_partkey") % 16 * 40).alias("_x"))
    plane = G.together(plane, ["slice_id"])  # before it grows into pixels
    plane = plane.withColumn("b", F.explode(square)).withColumn("c", F.explode(square))
    plane = plane.select("slice_id", (F.col("_y") + F.col("b")).alias("y"), (F.col("_x") + F.col("c")).alias("x"), F.lit(1).alias("struct_id"))
    sizes = documents(spark, sf).select("slice_id", F.lit(HEIGHT).alias("height"), F.lit(WIDTH).alias("width"))
    return C.filter_on_annotation(cells, on_slice, plane, sizes).select("slice_id", "n")
