"""Filters and projections on the cell table and on object and pixel tables."""

from __future__ import annotations

from collections.abc import Sequence
from itertools import product

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from voxtally.functions.columns import (
    COLABEL_PREFIX,
    LABEL_PREFIX,
    col,
    label_columns,
    number,
    truncated,
)
from voxtally.operators.ordering import with_rank


def to_pixels(cells: DataFrame, width: Column, height: Column) -> DataFrame:
    return cells.withColumn("x", F.col("x") * width).withColumn("y", F.col("y") * height)


def to_fraction(cells: DataFrame, width: Column, height: Column) -> DataFrame:
    return cells.withColumn("x", F.try_divide(F.col("x"), width)).withColumn(
        "y", F.try_divide(F.col("y"), height)
    )


def filter_by_size(cells: DataFrame, min_size: float | None = None, max_size: float | None = None) -> DataFrame:
    """Inclusive bounds; 0 or None is no bound.  A slice with any NULL area in micrometres is
    filtered on pixels as a whole; a table with pixel areas only is filtered on pixels."""
    if not (min_size or max_size):
        return cells
    has_um, has_px = "area_um" in cells.columns, "area_pixels" in cells.columns
    if not (has_um or has_px):
        return cells

    def keep(size: Column) -> Column:
        ok = size.isNotNull()
        if min_size:
            ok = ok & (size >= number(min_size))
        if max_size:
            ok = ok & (size <= number(max_size))
        return ok

    if not has_um:
        return cells.filter(keep(F.col("area_pixels")))
    uncalibrated = (
        cells.filter(F.col("area_um").isNull()).select("slice_id").distinct().withColumn("_px", F.lit(True))
    )
    size = F.when(F.col("_px"), F.col("area_pixels")).otherwise(F.col("area_um")) if has_px else F.col("area_um")
    return cells.join(uncalibrated, "slice_id", "left").filter(keep(size)).drop("_px")


# A tile of eight by eight pixels is one number of 64 bits.
_TILE = {"_ty": "shiftright(_y, 3)", "_tx": "shiftright(_x, 3)"}
_IN_TILE = "CAST((_y & 7) * 8 + (_x & 7) AS INT)"


def mask_tiles(mask: DataFrame) -> DataFrame:
    """(slice_id, _ty, _tx, _bits): the true pixels of ``mask(slice_id, y, x)``, a row per tile that has any."""
    places = mask.select("slice_id", F.col("y").cast("long").alias("_y"), F.col("x").cast("long").alias("_x"))
    return places.groupBy("slice_id", *[F.expr(c).alias(n) for n, c in _TILE.items()]).agg(
        F.bit_or(F.expr(f"shiftleft(1L, {_IN_TILE})")).alias("_bits")
    )


def points_on_mask(
    cells: DataFrame, mask: DataFrame, sizes: DataFrame, ignore_outliers: bool = False
) -> DataFrame:
    """Add ``on_mask`` by truncated (x, y) lookup in ``mask(slice_id, y, x)``, which lists the true
    pixels.  ``sizes(slice_id, height, width)`` bounds the image: outliers are false, or fail the
    job when not ignored."""
    tiles = mask_tiles(mask)
    inside = (
        (F.col("x") >= 0) & (F.col("x") < F.col("width")) & (F.col("y") >= 0) & (F.col("y") < F.col("height"))
    )
    located = cells.join(sizes, "slice_id").withColumn("_y", truncated(F.col("y"))).withColumn(
        "_x", truncated(F.col("x"))
    )
    hit = F.coalesce(F.expr(f"shiftright(_bits, {_IN_TILE}) & 1 = 1"), F.lit(False))
    if ignore_outliers:
        flag = inside & hit
    else:
        flag = F.when(inside, hit).otherwise(F.raise_error("point outside the mask").cast("boolean"))
    return (
        located.withColumns({n: F.expr(c) for n, c in _TILE.items()}).join(tiles, ["slice_id", *_TILE], "left")
        .withColumn("on_mask", flag)
        .drop("_y", "_x", "_bits", *_TILE, "height", "width")
    )


def filter_on_mask(cells: DataFrame, mask: DataFrame, sizes: DataFrame, ignore_outliers: bool = False) -> DataFrame:
    return points_on_mask(cells, mask, sizes, ignore_outliers).filter("on_mask").drop("on_mask")


def filter_on_tissue(cells: DataFrame, pixels: DataFrame) -> DataFrame:
    """Keep cells (fractions of the image) on the brighter of two intensity classes of their
    slice image ``pixels(image_id = slice_id, y, x, v)``."""
    from voxtally.operators.raster import image_sizes, two_class_mask

    sizes = image_sizes(pixels).withColumnRenamed("image_id", "slice_id")
    tissue = two_class_mask(pixels).filter("mask").select(F.col("image_id").alias("slice_id"), "y", "x")
    scaled = (
        cells.join(sizes, "slice_id")
        .withColumn("_fx", F.col("x")).withColumn("_fy", F.col("y"))
        .withColumn("x", F.col("x") * F.col("width")).withColumn("y", F.col("y") * F.col("height"))
        .drop("width", "height")
    )
    kept = filter_on_mask(scaled, tissue, sizes)
    return kept.withColumn("x", F.col("_fx")).withColumn("y", F.col("_fy")).drop("_fx", "_fy")


def filter_on_annotation(
    cells: DataFrame, on_slice: DataFrame, annotation: DataFrame, sizes: DataFrame, key: str = "cell_id"
) -> DataFrame:
    """Keep cells whose registered position ``on_slice(cell_id, slice_id, x, y)`` has a positive
    annotation; positions outside the plane are dropped."""
    positive = annotation.filter(F.col("struct_id") > 0)
    hits = filter_on_mask(on_slice, positive, sizes, ignore_outliers=True)
    return cells.join(hits.select(key), key, "left_semi")


def with_label(cells: DataFrame, name: str) -> DataFrame:
    return cells.filter(col(LABEL_PREFIX + name))


def class_in(detections: DataFrame, classes: Sequence[str] = ("Positive", "Negative")) -> DataFrame:
    return detections.filter(F.col("Class").isin(*classes))


def drop_missing_points(cells: DataFrame, any_column: bool = False) -> DataFrame:
    return cells.dropna("any") if any_column else cells.dropna("any", subset=["x", "y"])


def threshold_label(df: DataFrame, column: str, threshold: float, name: str) -> DataFrame:
    """LABEL-name is true strictly above the threshold."""
    return df.withColumn(LABEL_PREFIX + name, col(column) > number(threshold))


def with_co_labels(cells: DataFrame) -> DataFrame:
    """One flag per +/- combination of k >= 2 labels, minus first.  A row with a NULL label is in
    no combination."""
    labels = label_columns(cells.columns)
    if len(labels) < 2:
        return cells
    combos = []
    for signs in product((False, True), repeat=len(labels)):
        flag = F.lit(True)
        for label, sign in zip(labels, signs):
            flag = flag & col(label).eqNullSafe(F.lit(sign))
        title = "".join(c[len(LABEL_PREFIX):] + ("+" if s else "-") for c, s in zip(labels, signs))
        combos.append(flag.alias(COLABEL_PREFIX + title))
    return cells.select("*", *combos)


def union_cells(*tables: DataFrame) -> DataFrame:
    """Concatenate cell tables whose labels differ; a missing label is NULL."""
    out = tables[0]
    for t in tables[1:]:
        out = out.unionByName(t, allowMissingColumns=True)
    return out


def gray_matter_leaves(results: DataFrame) -> DataFrame:
    """Leaf structures in gray matter; an unknown gray-matter flag is filtered out."""
    return results.filter(~F.col("is_parent_structure") & F.col("is_gray_matter"))


def require_rows(df: DataFrame, message: str) -> DataFrame:
    """The same table, or a clear error when a filter left nothing."""
    if df.isEmpty():
        raise ValueError(message)
    return df


def in_conditions(results: DataFrame, column: str, values: Sequence[str] | None) -> DataFrame:
    return results.filter(F.col(column).isin(*values)) if values else results


def points_in_box(cells: DataFrame, boxes: DataFrame) -> DataFrame:
    """Range join on the slice key; inclusive on all sides, coordinates become box-relative.
    ``boxes(slice_id, box_id, x0, y0, x1, y1)``."""
    c, b = cells.alias("c"), boxes.alias("b")
    hit = (
        (F.col("c.slice_id") == F.col("b.slice_id"))
        & F.col("c.x").between(F.col("b.x0"), F.col("b.x1"))
        & F.col("c.y").between(F.col("b.y0"), F.col("b.y1"))
    )
    moved = {"x": F.col("c.x") - F.col("b.x0"), "y": F.col("c.y") - F.col("b.y0")}
    kept = [moved.get(n, F.col(f"c.`{n}`")).alias(n) for n in cells.columns]
    return c.join(b, hit).select(F.col("b.box_id").alias("box_id"), *kept)


def large_components(objects: DataFrame, ratio: float = 0.3) -> DataFrame:
    """Objects of at least ``ratio`` of the largest in their slice, ranked largest first."""
    largest = objects.groupBy("slice_id").agg(F.max("area").alias("_max"))
    kept = objects.join(largest, "slice_id").filter(F.col("area") >= F.col("_max") * number(ratio)).drop("_max")
    return with_rank(
        kept, ["slice_id"], -F.col("area"), [F.col("area").desc(), F.col("label")], name="rank"
    )


def drop_area_outliers(objects: DataFrame, sigmas: float = 3.0) -> DataFrame:
    """Remove objects outside mean +/- sigmas sample standard deviations of their slice."""
    stats = objects.groupBy("slice_id").agg(
        F.avg("area").alias("_m"), F.stddev_samp("area").alias("_s")
    )
    low, high = F.col("_m") - number(sigmas) * F.col("_s"), F.col("_m") + number(sigmas) * F.col("_s")
    outside = F.coalesce((F.col("area") < low) | (F.col("area") > high), F.lit(False))
    return objects.join(stats, "slice_id").filter(~outside).drop("_m", "_s")


def region_props(pixels: DataFrame, sizes: DataFrame, pixel_um: tuple[float, float] | None = None) -> DataFrame:
    """Objects of ``pixels(slice_id, y, x, label, v)`` as a cell table: integer-truncated centroid,
    area and mean intensity, centroid as a fraction of the image."""
    objects = (
        pixels.filter(F.col("label") > 0)
        .groupBy("slice_id", "label")
        .agg(F.avg("y").alias("_y"), F.avg("x").alias("_x"), F.count(F.lit(1)).alias("area_pixels"), F.avg("v").alias("_v"))
        .join(sizes, "slice_id")
    )
    um = F.lit(None).cast("double") if pixel_um is None else F.col("area_pixels") * number(pixel_um[0] * pixel_um[1])
    return objects.select(
        "slice_id", "label",
        F.try_divide(truncated(F.col("_x")).cast("double"), F.col("width").cast("double")).alias("x"),
        F.try_divide(truncated(F.col("_y")).cast("double"), F.col("height").cast("double")).alias("y"),
        "area_pixels",
        um.alias("area_um"),
        truncated(F.col("_v")).alias("mean_intensity"),
    )


def object_points(pixels: DataFrame) -> DataFrame:
    """Half-even rounded centroid (x, y) of each labelled object."""
    return (
        pixels.filter(F.col("label") > 0)
        .groupBy("slice_id", "label")
        .agg(F.rint(F.avg("x")).cast("int").alias("x"), F.rint(F.avg("y")).cast("int").alias("y"))
    )


def filter_objects_by_size(
    pixels: DataFrame, size_range: tuple[float, float], pixel_um: tuple[float, float] | None = None
) -> DataFrame:
    """Zero the label of objects outside a size range (square micrometres when calibrated, else
    pixels); a bound of 0 is off.  Background pixels stay 0."""
    unit = 1.0 if pixel_um is None else pixel_um[0] * pixel_um[1]
    sizes = pixels.filter(F.col("label") > 0).groupBy("slice_id", "label").agg(
        (F.count(F.lit(1)) * number(unit)).alias("_size")
    )
    ok = F.lit(True)
    if size_range[0] > 0:
        ok = ok & (F.col("_size") >= number(size_range[0]))
    if size_range[1] > 0:
        ok = ok & (F.col("_size") <= number(size_range[1]))
    kept = sizes.filter(ok).select("slice_id", "label", F.lit(True).alias("_kept"))
    return (
        pixels.join(kept, ["slice_id", "label"], "left")
        .withColumn("label", F.when(F.col("_kept"), F.col("label")).otherwise(F.lit(0)))
        .drop("_kept")
        .select(*pixels.columns)
    )
