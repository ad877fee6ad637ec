"""Registration: image points to atlas coordinates, and atlas planes.

Every transform is a pair or triple of Column expressions over parameters joined by slice, so points
of all slices go through one job.  Only the spline is solved in Python, once per slice and on its
control points; its coefficients are then evaluated as an expression."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from voxtally.functions.columns import number

UNTIL = ("affine", "tps", "atlas")


def rotation(angle_degrees: Column) -> tuple[Column, Column]:
    """Cosine and sine of an angle in degrees."""
    radians = F.radians(angle_degrees)
    return F.cos(radians), F.sin(radians)


def image_centre(size: Column) -> Column:
    """The default centre of an axis of that many pixels."""
    return F.floor((size - 1) / 2).cast("double")


def affine_matrix(params: Column, cx: Column, cy: Column, scale: float | None = None) -> list[Column]:
    """Six coefficients (a, b, c, d, e, f): x' = a x + b y + c and y' = d x + e y + f.

    A point is turned about the centre, then scaled about it and moved, then all of it is
    scaled about the origin."""
    cos, sin = rotation(params["angle"])
    sx, sy, k = params["sx"], params["sy"], number(1.0 if scale is None else scale)
    a, b, d, e = sx * cos, -sx * sin, sy * sin, sy * cos
    c = cx + params["tx"] - a * cx - b * cy
    f = cy + params["ty"] - d * cx - e * cy
    return [k * v for v in (a, b, c, d, e, f)]


def affine_inverse(m: Sequence[Column]) -> list[Column]:
    """Coefficients of the inverse; NULL where there is none."""
    a, b, c, d, e, f = m
    det = a * e - b * d
    part = lambda v: F.try_divide(v, det)
    return [part(e), part(-b), part(b * f - c * e), part(-d), part(a), part(c * d - a * f)]


def apply_affine(m: Sequence[Column], x: Column, y: Column) -> tuple[Column, Column]:
    a, b, c, d, e, f = m
    return a * x + b * y + c, d * x + e * y + f


def fit_box_affine(box1: Column, box2: Column, rot_frontal: Column | None = None) -> Column:
    """Parameters that take box1 (x, y, w, h) onto box2, about the centre of box1."""
    cx, cy = box1["x"] + box1["w"] / number(2), box1["y"] + box1["h"] / number(2)
    return F.struct(
        (number(0) if rot_frontal is None else rot_frontal).alias("angle"),
        (box2["x"] + box2["w"] / number(2) - cx).alias("tx"),
        (box2["y"] + box2["h"] / number(2) - cy).alias("ty"),
        F.try_divide(box2["w"].cast("double"), box1["w"].cast("double")).alias("sx"),
        F.try_divide(box2["h"].cast("double"), box1["h"].cast("double")).alias("sy"),
        cx.alias("cx"),
        cy.alias("cy"),
    )


# ------------------------------------------------------------------ thin-plate spline
def _radial(r2: np.ndarray) -> np.ndarray:
    return np.where(r2 > 0, r2 * np.log(np.where(r2 > 0, r2, 1.0)), 0.0)


def spline_coefficients(src: np.ndarray, dst: np.ndarray) -> np.ndarray:
    """(..., n + 3, 2) weights of the interpolating splines of (..., n, 2) points: n radial ones, then 1, x, y."""
    n, many = src.shape[-2], src.shape[:-2]
    kernel = _radial(((src[..., :, None, :] - src[..., None, :, :]) ** 2).sum(axis=-1))
    poly = np.concatenate([np.ones((*many, n, 1)), src], axis=-1)
    zeros = np.zeros((*many, 3, 3))
    system = np.concatenate([np.concatenate([kernel, poly], axis=-1), np.concatenate([np.swapaxes(poly, -1, -2), zeros], axis=-1)], axis=-2)
    inverse = np.linalg.pinv(system, rcond=np.finfo(float).eps * (n + 3))  # least squares where points coincide
    return inverse @ np.concatenate([dst, zeros[..., :2]], axis=-2)


SPLINE_BATCH = 256  # splines of one number of points that are solved at once


def fit_splines(control: DataFrame, inverse: bool = False) -> DataFrame:
    """``control(slice_id, points_src, points_dst)`` to (slice_id, knots, flat).  The inverse swaps the
    two point lists.  A NULL or empty list gives no row, which means identity."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            for length, part in pdf.groupby(pdf["a"].map(len)):
                step = max(1, SPLINE_BATCH * 1024 // max(1024, length * length))
                for first in range(0, len(part), step):
                    some = part.iloc[first:first + step]
                    a, b = (np.stack([np.asarray(v, dtype=float) for v in some[c]]).reshape(len(some), -1, 2) for c in ("a", "b"))
                    w = spline_coefficients(a, b)
                    n = a.shape[1]
                    knots = np.concatenate([a, w[:, :n]], axis=2).reshape(len(some), -1)
                    yield pd.DataFrame({"slice_id": some["slice_id"].to_numpy(), "knots": list(knots), "flat": list(w[:, n:].reshape(len(some), -1))})

    usable = control.filter(F.col("points_src").isNotNull() & (F.size("points_src") > 0))
    ends = ("points_dst", "points_src") if inverse else ("points_src", "points_dst")
    points = usable.select(F.col("slice_id").cast("long").alias("slice_id"), *[F.flatten(c).cast("array<double>").alias(n) for c, n in zip(ends, "ab")])
    fitted = points.mapInPandas(run, "slice_id long, knots array<double>, flat array<double>")
    at = lambda i, k: F.get("knots", 4 * i + k)
    knot = lambda i: F.struct(*[at(i, k).alias(n) for k, n in enumerate(("x", "y", "wx", "wy"))])
    places = F.sequence(F.lit(0), (F.size("knots") / 4).cast("int") - 1)
    return fitted.select("slice_id", F.transform(places, knot).alias("knots"), "flat")


def apply_spline(knots: Column, flat: Column, x: Column, y: Column) -> tuple[Column, Column]:
    """The spline at a point; without knots the point itself."""

    def weighted(weight: str, at: int) -> Column:
        def term(total: Column, k: Column) -> Column:
            r2 = (x - k["x"]) * (x - k["x"]) + (y - k["y"]) * (y - k["y"])
            return total + F.when(r2 > 0, k[weight] * r2 * F.ln(r2)).otherwise(number(0))

        plane = F.get(flat, F.lit(at)) + F.get(flat, F.lit(2 + at)) * x + F.get(flat, F.lit(4 + at)) * y
        return F.aggregate(knots, plane, term)

    return F.coalesce(weighted("wx", 0), x), F.coalesce(weighted("wy", 1), y)


# ------------------------------------------------------------------ depth
def depth_point(x: Column, y: Column, ap: Column, rot_sagittal: Column, rot_horizontal: Column, shape: Sequence[int]) -> tuple[Column, Column, Column]:
    """Slice point (x, y) to atlas (x, y, z): moved by ap along depth and turned about the centre of
    the volume (depth, height, width) around the axis (sagittal, horizontal, 0)."""
    cx, cy, cz = (number(v // 2) for v in (shape[2], shape[1], shape[0]))
    rx, ry = F.radians(rot_sagittal), F.radians(rot_horizontal)
    theta = F.sqrt(rx * rx + ry * ry)
    kx, ky = F.coalesce(F.try_divide(rx, theta), number(0)), F.coalesce(F.try_divide(ry, theta), number(0))
    cos, sin = F.cos(theta), F.sin(theta)
    rest = number(1) - cos
    dx, dy, dz = x - cx, y - cy, ap - cz
    return (
        cx + (cos + rest * kx * kx) * dx + rest * kx * ky * dy + sin * ky * dz,
        cy + rest * kx * ky * dx + (cos + rest * ky * ky) * dy - sin * kx * dz,
        cz - sin * ky * dx + sin * kx * dy + cos * dz,
    )


def to_atlas(
    points: DataFrame, documents: DataFrame, shape: Sequence[int], until: str = "atlas", scale: float | None = None
) -> DataFrame:
    """``points(slice_id, x, y, ...)`` through affine, spline and depth; z is NULL before depth.

    ``documents(slice_id, params, lowres_height, lowres_width)``.  A missing parameter leaves the point as
    it is.  Points of slices without a document are dropped."""
    if until not in UNTIL:
        raise ValueError(f"unknown step {until!r}; use one of {UNTIL}")
    slim = documents.select("slice_id", F.col("params").alias("_p"), F.col("lowres_height").alias("_h"), F.col("lowres_width").alias("_w"))
    joined = points.join(slim.hint("merge"), "slice_id")  # grids of pixels look as small as the slices they come from
    affine = F.col("_p.affine")
    names = affine_fields(documents)
    cx = F.coalesce(affine["cx"], image_centre(F.col("_w"))) if "cx" in names else image_centre(F.col("_w"))
    cy = F.coalesce(affine["cy"], image_centre(F.col("_h"))) if "cy" in names else image_centre(F.col("_h"))
    ax, ay = apply_affine(affine_matrix(affine, cx, cy, scale), F.col("x"), F.col("y"))
    out = joined.withColumns({"_ax": F.coalesce(ax, F.col("x")), "_ay": F.coalesce(ay, F.col("y"))})
    if until != "affine":
        control = documents.select("slice_id", "params.tps.points_src", "params.tps.points_dst")
        splines = fit_splines(control).withColumnRenamed("slice_id", "_sid")
        out = out.join(splines.hint("merge"), F.col("slice_id") == F.col("_sid"), "left")
        tx, ty = apply_spline(F.col("knots"), F.col("flat"), F.col("_ax"), F.col("_ay"))
        out = out.withColumns({"_tx": tx, "_ty": ty}).drop("_ax", "_ay", "knots", "flat", "_sid").withColumnsRenamed({"_tx": "_ax", "_ty": "_ay"})
    z = F.lit(None).cast("double")
    x, y = F.col("_ax"), F.col("_ay")
    if until == "atlas":
        atlas = F.col("_p.atlas")
        dx, dy, dz = depth_point(x, y, atlas["ap"], atlas["rot_sagittal"], atlas["rot_horizontal"], shape)
        out = out.withColumns({"_dx": F.coalesce(dx, x), "_dy": F.coalesce(dy, y), "_dz": dz})
        x, y, z = F.col("_dx"), F.col("_dy"), F.col("_dz")
    kept = [c for c in points.columns if c not in ("x", "y", "z")]
    return out.select(*kept, x.alias("x"), y.alias("y"), z.alias("z"))


def affine_fields(documents: DataFrame) -> list[str]:
    return documents.schema["params"].dataType["affine"].dataType.names


def cells_on_atlas(cells: DataFrame, documents: DataFrame, shape: Sequence[int]) -> DataFrame:
    """Cells at fractions of their valid slices' images to 3-D atlas coordinates."""
    valid = documents.filter(~F.col("ignore"))
    sized = cells.join(valid.select("slice_id", "lowres_height", "lowres_width"), "slice_id")
    scaled = sized.withColumns({"x": F.col("x") * F.col("lowres_width"), "y": F.col("y") * F.col("lowres_height")})
    return to_atlas(scaled.drop("lowres_height", "lowres_width"), valid, shape)


# ------------------------------------------------------------------ planes of the atlas
def slice_coordinates(planes: DataFrame, height: int, width: int) -> DataFrame:
    """(plane columns, y, x, c0, c1, c2): where each pixel of a plane lies in the volume.

    ``planes`` holds ap, si, lr and the three rotations in degrees; the grid is centred, turned
    (frontal, horizontal, sagittal) and moved.  Planes are spread before they grow into their pixels, as a
    file of many planes may be one small split."""
    parts = int(planes.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    grid = planes.repartition(parts).withColumn("y", F.explode(F.sequence(F.lit(0), F.lit(height - 1)))).withColumn(
        "x", F.explode(F.sequence(F.lit(0), F.lit(width - 1)))
    )
    c0, c1, c2 = plane_point(F.col("y"), F.col("x"), height, width, {c: F.col(c) for c in PLANE_COLUMNS})
    return grid.select(*planes.columns, "y", "x", c0.alias("c0"), c1.alias("c1"), c2.alias("c2"))


PLANE_COLUMNS = ("ap", "si", "lr", "rot_frontal", "rot_horizontal", "rot_sagittal")


def plane_point(y: Column, x: Column, height: int, width: int, plane: dict[str, Column]) -> tuple[Column, Column, Column]:
    """Where the pixel (y, x) of a plane of this size lies in the volume."""
    a1, a2 = y - number((height - 1) / 2), x - number((width - 1) / 2)
    c0, s0 = rotation(plane["rot_frontal"])
    c1, s1 = rotation(plane["rot_horizontal"])
    c2, s2 = rotation(plane["rot_sagittal"])
    b1, b2 = c0 * a1 - s0 * a2, s0 * a1 + c0 * a2
    d0, d2 = -s1 * b2, c1 * b2
    return c2 * d0 - s2 * b1 + plane["ap"], s2 * d0 + c2 * b1 + plane["si"], d2 + plane["lr"]


def slice_volume(voxels: DataFrame, coordinates: DataFrame, value: str, mode: str = "nearest") -> DataFrame:
    """``coordinates`` with the volume's ``value`` there: 0 outside.  ``voxels(z, y, x, value)``."""
    grid = voxels.select(F.col("z").alias("_0"), F.col("y").alias("_1"), F.col("x").alias("_2"), F.col(value).alias("_v"))
    axes = ("c0", "c1", "c2")
    if mode == "nearest":
        at = coordinates.select("*", *[F.rint(c).cast("int").alias(f"_{i}") for i, c in enumerate(axes)])
        found = at.join(grid, ["_0", "_1", "_2"], "left").drop("_0", "_1", "_2")
        return found.withColumn(value, F.coalesce("_v", F.lit(0))).drop("_v")
    if mode != "linear":
        raise ValueError(f"unknown mode {mode!r}; use nearest or linear")
    corners = F.array(*[F.struct(*[F.lit(bit).alias(f"b{i}") for i, bit in enumerate(bits)]) for bits in np.ndindex(2, 2, 2)])
    near = coordinates.withColumn("_corner", F.explode(corners))
    weight = number(1)
    for i, c in enumerate(axes):
        part = F.col(c) - F.floor(c)
        near = near.withColumn(f"_{i}", (F.floor(c) + F.col(f"_corner.b{i}")).cast("int"))
        weight = weight * F.when(F.col(f"_corner.b{i}") == 1, part).otherwise(number(1) - part)
    joined = near.join(grid, ["_0", "_1", "_2"], "left")
    return joined.groupBy(*coordinates.columns).agg(F.sum(F.coalesce(F.col("_v").cast("double"), number(0)) * weight).alias(value))


def hemisphere(voxels: DataFrame, width: int) -> DataFrame:
    """``voxels`` with hemi: 2 left of the middle, 1 right of it."""
    return voxels.withColumn("hemi", F.when(F.col("x") < width // 2, F.lit(2)).otherwise(F.lit(1)))


def _plane_pixels(documents: DataFrame, shape: Sequence[int], image_height: int, image_width: int) -> DataFrame:
    """(slice_id, iy, ix, y, x): the pixel of the atlas plane on which each pixel of the full image lies."""
    pixels = documents.select("slice_id", "lowres_height", "lowres_width").withColumn(
        "iy", F.explode(F.sequence(F.lit(0), F.lit(image_height - 1)))
    ).withColumn("ix", F.explode(F.sequence(F.lit(0), F.lit(image_width - 1))))
    low = pixels.select(
        "slice_id", "iy", "ix",
        F.floor(F.col("ix") * F.col("lowres_width") / image_width).cast("double").alias("x"),
        F.floor(F.col("iy") * F.col("lowres_height") / image_height).cast("double").alias("y"),
    )
    return to_atlas(low, documents, shape, until="tps").select("slice_id", "iy", "ix", F.rint("y").cast("int").alias("y"), F.rint("x").cast("int").alias("x"))


def registered_coordinates(
    documents: DataFrame, shape: Sequence[int], image_height: int, image_width: int, resolution: Sequence[float] | None = None
) -> DataFrame:
    """(slice_id, y, x, c0, c1, c2): for every pixel of the full image the place in the volume, rounded.

    The places are voxels, or microns with a voxel's ``resolution``.  They come from the slice's plane of
    the volume ``shape``, by its atlas parameters; a pixel outside the plane is at 0, 0, 0."""
    height, width = shape[1], shape[2]
    moved = _plane_pixels(documents, shape, image_height, image_width)
    atlas = documents.select("slice_id", F.col("params.atlas").alias("_a"))
    plane = {"si": number(height // 2), "lr": number(width // 2)} | {c: F.col(f"_a.{c}") for c in ("ap", "rot_frontal", "rot_horizontal", "rot_sagittal")}
    inside = F.col("y").between(0, height - 1) & F.col("x").between(0, width - 1)
    found = moved.join(atlas.filter("_a is not null").hint("merge"), "slice_id")
    units = resolution or (1.0, 1.0, 1.0)
    places = [
        F.when(inside, F.rint(c * number(unit)).cast("long")).otherwise(F.lit(0).cast("long")).alias(f"c{k}")
        for k, (c, unit) in enumerate(zip(plane_point(F.col("y"), F.col("x"), height, width, plane), units))
    ]
    return found.select("slice_id", F.col("iy").alias("y"), F.col("ix").alias("x"), *places)


def registered_values(
    documents: DataFrame, annotation: DataFrame, shape: Sequence[int], image_height: int, image_width: int
) -> DataFrame:
    """(slice_id, y, x, value): for every pixel of the full image the atlas annotation that it lies on.

    ``annotation(slice_id, y, x, value)`` is the slice's atlas plane.  A pixel is taken to the low-resolution
    image, through affine and spline, and to the nearest pixel of the plane; outside is 0."""
    moved = _plane_pixels(documents, shape, image_height, image_width)
    found = moved.join(annotation.select("slice_id", "y", "x", "value").hint("merge"), ["slice_id", "y", "x"], "left")
    return found.select("slice_id", F.col("iy").alias("y"), F.col("ix").alias("x"), F.coalesce(F.rint("value").cast("long"), F.lit(0)).alias("value"))


def warp_image(pixels: DataFrame, documents: DataFrame, height: int, width: int, mode: str = "bilinear") -> DataFrame:
    """(slice_id, y, x, v): the image ``pixels(slice_id, y, x, v)`` in the atlas frame; 0 outside.

    An output pixel is pulled back by the inverse spline, which runs from the target points to the
    sources, then by the inverse of the affine part, and takes the ``bilinear`` or ``nearest`` value there."""
    if mode not in ("bilinear", "nearest"):
        raise ValueError(f"unknown mode {mode!r}; use bilinear or nearest")
    affine = F.col("params.affine")
    matrix = affine_inverse(affine_matrix(affine, image_centre(F.col("lowres_width")), image_centre(F.col("lowres_height"))))
    grid = documents.select("slice_id", *[m.alias(f"_m{i}") for i, m in enumerate(matrix)]).withColumn(
        "oy", F.explode(F.sequence(F.lit(0), F.lit(height - 1)))
    ).withColumn("ox", F.explode(F.sequence(F.lit(0), F.lit(width - 1))))
    grid = grid.withColumns({"_x": F.col("ox").cast("double"), "_y": F.col("oy").cast("double")})
    if "tps" in documents.schema["params"].dataType.names:
        control = documents.select("slice_id", "params.tps.points_src", "params.tps.points_dst")
        splines = fit_splines(control, inverse=True).withColumnRenamed("slice_id", "_sid")
        grid = grid.join(splines.hint("merge"), F.col("slice_id") == F.col("_sid"), "left")
        x, y = apply_spline(F.col("knots"), F.col("flat"), F.col("_x"), F.col("_y"))
        grid = grid.withColumns({"_tx": x, "_ty": y}).drop("_x", "_y", "knots", "flat", "_sid").withColumnsRenamed({"_tx": "_x", "_ty": "_y"})
    sx, sy = apply_affine([F.col(f"_m{i}") for i in range(6)], F.col("_x"), F.col("_y"))
    at = grid.select("slice_id", "oy", "ox", F.coalesce(sx, F.col("_x")).alias("sx"), F.coalesce(sy, F.col("_y")).alias("sy"))
    image = pixels.select("slice_id", "y", "x", "v").hint("merge")  # either side looks as small as the images it comes from
    if mode == "nearest":
        keyed = at.select("slice_id", "oy", "ox", F.rint("sy").cast("int").alias("y"), F.rint("sx").cast("int").alias("x"))
        found = keyed.join(image, ["slice_id", "y", "x"], "left")
        return found.select("slice_id", F.col("oy").alias("y"), F.col("ox").alias("x"), F.coalesce(F.col("v"), F.lit(0)).alias("v"))
    corners = at.withColumn("_dy", F.explode(F.array(F.lit(0), F.lit(1)))).withColumn("_dx", F.explode(F.array(F.lit(0), F.lit(1))))
    py, px = F.col("sy") - F.floor("sy"), F.col("sx") - F.floor("sx")
    weight = F.when(F.col("_dy") == 1, py).otherwise(number(1) - py) * F.when(F.col("_dx") == 1, px).otherwise(number(1) - px)
    keyed = corners.select("slice_id", "oy", "ox", weight.alias("_w"), (F.floor("sy") + F.col("_dy")).cast("int").alias("y"), (F.floor("sx") + F.col("_dx")).cast("int").alias("x"))
    joined = keyed.join(image, ["slice_id", "y", "x"], "left")
    return joined.groupBy("slice_id", F.col("oy").alias("y"), F.col("ox").alias("x")).agg(F.sum(F.coalesce(F.col("v"), number(0)) * F.col("_w")).alias("v"))


def control_grid(boxes: DataFrame, both_hemispheres: bool = True) -> DataFrame:
    """Default control points on the reference box (x, y, w, h): 6 x 4, or 3 x 4 for one hemisphere."""
    nx, ny = (6 if both_hemispheres else 3), 4
    at = lambda start, size, i, n: start + size * i / number(n - 1)
    points = F.flatten(F.transform(
        F.sequence(F.lit(0), F.lit(ny - 1)),
        lambda j: F.transform(
            F.sequence(F.lit(0), F.lit(nx - 1)),
            lambda i: F.array(at(F.col("x").cast("double"), F.col("w"), i, nx), at(F.col("y").cast("double"), F.col("h"), j, ny)),
        ),
    ))
    return boxes.withColumns({"points_src": points, "points_dst": points})
