from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from voxtally.functions.columns import number
from voxtally.operators import geometry as T


def points(spark, rows):
    return spark.createDataFrame(rows, "slice_id long, x double, y double")


def affine(spark, angle=0.0, tx=0.0, ty=0.0, sx=1.0, sy=1.0):
    return F.struct(*[number(v).alias(k) for k, v in (("angle", angle), ("tx", tx), ("ty", ty), ("sx", sx), ("sy", sy))])


def moved(spark, params, x, y, cx, cy):
    m = T.affine_matrix(params, number(cx), number(cy))
    nx, ny = T.apply_affine(m, number(x), number(y))
    row = spark.range(1).select(nx.alias("x"), ny.alias("y")).first()
    return row["x"], row["y"]


def test_affine_translation_and_scale_about_a_centre(spark):
    assert moved(spark, affine(spark, tx=1), 0, 0, 0, 0) == (1, 0)
    assert moved(spark, affine(spark, sx=0.5, sy=0.5), 1, 2, 1, 2) == (1, 2)
    assert moved(spark, affine(spark, sx=0.5, sy=0.5), 0, 0, 1, 2) == (0.5, 1)


def test_affine_inverse_goes_back(spark):
    m = T.affine_matrix(affine(spark, 10, 10, 20, 1.5, 2), number(4), number(7))
    x, y = T.apply_affine(m, F.col("x"), F.col("y"))
    df = points(spark, [(1, float(i), float(3 * i - 5)) for i in range(10)]).select(F.col("x").alias("x0"), F.col("y").alias("y0"), x.alias("x"), y.alias("y"))
    bx, by = T.apply_affine(T.affine_inverse(m), F.col("x"), F.col("y"))
    for r in df.select("x0", "y0", bx.alias("x"), by.alias("y")).collect():
        assert r["x"] == pytest.approx(r["x0"]) and r["y"] == pytest.approx(r["y0"], abs=1e-9)


def test_spline_is_exact_at_control_points_and_its_inverse_goes_back(spark):
    rng = np.random.default_rng(0)
    src, dst = rng.uniform(0, 100, (5, 2)), rng.uniform(0, 100, (5, 2))
    control = spark.createDataFrame([(1, src.tolist(), dst.tolist()), (2, None, None)], "slice_id long, points_src array<array<double>>, points_dst array<array<double>>")
    forward, back = T.fit_splines(control), T.fit_splines(control, inverse=True)
    assert forward.count() == 1
    for splines, start, end in ((forward, src, dst), (back, dst, src)):
        df = points(spark, [(1, *p) for p in start.tolist()]).join(splines, "slice_id")
        x, y = T.apply_spline(F.col("knots"), F.col("flat"), F.col("x"), F.col("y"))
        got = {(round(r["x"], 6), round(r["y"], 6)): (r["nx"], r["ny"]) for r in df.select("x", "y", x.alias("nx"), y.alias("ny")).collect()}
        for a, b in zip(start, end):
            assert got[tuple(np.round(a, 6))] == pytest.approx(tuple(b), abs=1e-3)


def test_depth_moves_along_z(spark):
    x, y, z = T.depth_point(number(0), number(0), number(1), number(0), number(0), (10, 10, 10))
    assert tuple(spark.range(1).select(x, y, z).first()) == (0, 0, 1)


def test_missing_parameters_are_identity(spark):
    docs = spark.sql("""SELECT 1L AS slice_id, false AS ignore, 10 AS lowres_height, 10 AS lowres_width, named_struct(
        'atlas', CAST(NULL AS STRUCT<ap: DOUBLE, rot_horizontal: DOUBLE, rot_sagittal: DOUBLE>),
        'affine', CAST(NULL AS STRUCT<angle: DOUBLE, tx: DOUBLE, ty: DOUBLE, sx: DOUBLE, sy: DOUBLE>),
        'tps', CAST(NULL AS STRUCT<points_src: ARRAY<ARRAY<DOUBLE>>, points_dst: ARRAY<ARRAY<DOUBLE>>>)) AS params""")
    for until in T.UNTIL:
        row = T.to_atlas(points(spark, [(1, 3.0, 4.0), (2, 0.0, 0.0)]), docs, (5, 5, 5), until).collect()
        assert [(r["x"], r["y"], r["z"]) for r in row] == [(3.0, 4.0, None)]
    with pytest.raises(ValueError):
        T.to_atlas(points(spark, []), docs, (5, 5, 5), "somewhere")


def plane(spark, ap, si, lr, frontal=0.0):
    return spark.createDataFrame([(1, ap, si, lr, frontal, 0.0, 0.0)], "plane int, ap double, si double, lr double, rot_frontal double, rot_horizontal double, rot_sagittal double")


@pytest.mark.parametrize("mode", ["nearest", "linear"])
@pytest.mark.parametrize("side", [3, 5])
def test_identity_plane_frontal_turn_and_outside(spark, mode, side):
    rng = np.random.default_rng(side)
    volume = rng.integers(1, 100, (side,) * 3)
    voxels = spark.createDataFrame([(*map(int, k), int(v)) for k, v in np.ndenumerate(volume) for k in [k]], "z int, y int, x int, v int")

    def sampled(ap, frontal=0.0):
        c = T.slice_coordinates(plane(spark, ap, float(side // 2), float(side // 2), frontal), side, side)
        out = np.zeros((side, side))
        for r in T.slice_volume(voxels, c, "v", mode).collect():
            out[r["y"], r["x"]] = r["v"]
        return out

    assert np.allclose(sampled(1.0), volume[1])
    assert np.allclose(sampled(1.0, 90.0), np.rot90(volume[1], -1)) or np.allclose(sampled(1.0, 90.0), np.rot90(volume[1]))
    assert (sampled(100.0) == 0).all()


def test_registered_values_of_a_turned_image(spark):
    side = 9
    annotation = np.arange(side * side).reshape(side, side)
    plane_ = spark.createDataFrame([(1, y, x, int(v)) for (y, x), v in np.ndenumerate(annotation)], "slice_id long, y int, x int, value long")
    docs = spark.sql(f"""SELECT 1L AS slice_id, {side} AS lowres_height, {side} AS lowres_width, named_struct(
        'affine', named_struct('angle', 90D, 'tx', 0D, 'ty', 0D, 'sx', 1D, 'sy', 1D),
        'tps', CAST(NULL AS STRUCT<points_src: ARRAY<ARRAY<DOUBLE>>, points_dst: ARRAY<ARRAY<DOUBLE>>>)) AS params""")
    got = np.zeros((2 * side, 2 * side), dtype=int)
    for r in T.registered_values(docs, plane_, (5, side, side), 2 * side, 2 * side).collect():
        got[r["y"], r["x"]] = r["value"]
    small = got[::2, ::2]
    assert (got == np.repeat(np.repeat(small, 2, 0), 2, 1)).all()
    assert (small == np.rot90(annotation)).all() or (small == np.rot90(annotation, -1)).all()


def test_images_are_pulled_back_through_spline_and_affine(spark):
    rng = np.random.default_rng(3)
    height, width = 12, 14
    image = rng.normal(size=(height, width))
    src = np.array([[x, y] for x in (0.0, 7.0, 13.0) for y in (0.0, 6.0, 11.0)])
    dst = src + rng.normal(scale=0.7, size=src.shape)
    row = (1, {"affine": {"angle": 7.0, "tx": 1.5, "ty": -0.5, "sx": 1.2, "sy": 0.9}, "tps": {"points_src": src.tolist(), "points_dst": dst.tolist()}}, height, width)
    schema = (
        "slice_id long, params struct<affine struct<angle double, tx double, ty double, sx double, sy double>,"
        " tps struct<points_src array<array<double>>, points_dst array<array<double>>>>, lowres_height int, lowres_width int")
    docs = spark.createDataFrame([row], schema)
    pixels = spark.createDataFrame([(1, y, x, float(v)) for (y, x), v in np.ndenumerate(image)], "slice_id long, y int, x int, v double")

    def radial(p, q):
        r2 = ((p[:, None] - q[None]) ** 2).sum(-1)
        return np.where(r2 > 0, r2 * np.log(np.where(r2 > 0, r2, 1)), 0)

    n = len(dst)
    plane = np.hstack([np.ones((n, 1)), dst])
    system = np.block([[radial(dst, dst), plane], [plane.T, np.zeros((3, 3))]])
    weights = np.linalg.solve(system, np.vstack([src, np.zeros((3, 2))]))
    out = np.array([[x, y] for y in range(height) for x in range(width)], dtype=float)
    back = radial(out, dst) @ weights[:n] + np.hstack([np.ones((len(out), 1)), out]) @ weights[n:]
    a, centre = np.radians(7.0), np.array([(width - 1) // 2, (height - 1) // 2])
    turn = np.diag([1.2, 0.9]) @ np.array([[np.cos(a), -np.sin(a)], [np.sin(a), np.cos(a)]])
    at = (back - centre - [1.5, -0.5]) @ np.linalg.inv(turn).T + centre

    def value(y, x):
        return image[y, x] if 0 <= y < height and 0 <= x < width else 0.0

    linear, nearest = [], []
    for x, y in at:
        fy, fx = int(np.floor(y)), int(np.floor(x))
        linear.append(sum(value(fy + b, fx + c) * abs(1 - b - (y - fy)) * abs(1 - c - (x - fx)) for b in (0, 1) for c in (0, 1)))
        nearest.append(value(int(np.rint(y)), int(np.rint(x))))
    for mode, want in (("bilinear", linear), ("nearest", nearest)):
        got = T.warp_image(pixels, docs, height, width, mode).orderBy("y", "x").toPandas().v
        assert np.allclose(got, want, atol=1e-6)
    # the image frame's pixels lie where the forward transforms take them
    corners = spark.createDataFrame([(1, float(x), float(y)) for x, y in src], "slice_id long, x double, y double")
    moved = T.to_atlas(corners, docs, (4, height, width), until="tps")
    assert moved.count() == n


def test_registered_coordinates_are_the_planes_places(spark):
    shape, size = (9, 10, 12), (10, 12)
    schema = (
        "slice_id long, params struct<atlas struct<ap double, rot_frontal double, rot_horizontal double, rot_sagittal double>,"
        " affine struct<angle double, tx double, ty double, sx double, sy double>,"
        " tps struct<points_src array<array<double>>, points_dst array<array<double>>>>, lowres_height int, lowres_width int")
    docs = spark.createDataFrame([(1, {"atlas": {"ap": 4.0, "rot_frontal": 0.0, "rot_horizontal": 0.0, "rot_sagittal": 0.0}, "affine": {"angle": 0.0, "tx": 2.0, "ty": 0.0, "sx": 1.0, "sy": 1.0}, "tps": None}, *size)], schema)
    for resolution, unit in ((None, (1, 1, 1)), ((50.0, 25.0, 20.0), (50, 25, 20))):
        got = T.registered_coordinates(docs, shape, *size, resolution).collect()
        assert len(got) == 120
        for r in got:
            x, y = r["x"] + 2, r["y"]
            want = (4.0, y - 4.5 + 5, x - 5.5 + 6) if x < 12 else (0, 0, 0)
            assert (r["c0"], r["c1"], r["c2"]) == tuple(int(np.rint(w * u)) for w, u in zip(want, unit))
