"""Per-image raster operators over pixel tables (image_id, y, x, v).

Neighbourhoods are windows or joins on pixel keys, so images of any number spread over the cluster.
Connected components are labelled tile by tile; only links across tile borders are joined, so an
image of any size is many tasks."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from voxtally.session import ensure_checkpoint_dir
from voxtally.functions.columns import clip, min_max_scale, number, to_uint8

IMAGE = "image_id"
TILE = 64  # side of the square that a task labels at once
PIXEL_CODE = 1 << 31  # a pixel's code is y * PIXEL_CODE + x
OUTLINE_SIDE = 512  # a plane n times as long has its outline widened by a square of n


def image_sizes(pixels: DataFrame) -> DataFrame:
    return pixels.groupBy(IMAGE).agg((F.max("y") + 1).alias("height"), (F.max("x") + 1).alias("width"))


def normalize(pixels: DataFrame, quantiles: tuple[float, float] | None = None, limits: tuple[float, float] | None = None) -> DataFrame:
    """v scaled to 0..1: by the image's extremes, by its quantiles, or by fixed limits; clipped.
    A constant image gives NULL."""
    if limits is not None:
        low, high = number(limits[0]), number(limits[1])
        return pixels.withColumn("v", min_max_scale(clip(F.col("v"), low, high), low, high))
    if quantiles is None:
        ends = pixels.groupBy(IMAGE).agg(F.min("v").alias("_low"), F.max("v").alias("_high"))
    else:
        ends = pixels.groupBy(IMAGE).agg(*[F.percentile("v", F.lit(q)).alias(n) for q, n in zip(quantiles, ("_low", "_high"))])
    scaled = min_max_scale(clip(F.col("v"), F.col("_low"), F.col("_high")), F.col("_low"), F.col("_high"))
    return pixels.join(ends, IMAGE).withColumn("v", scaled).drop("_low", "_high")


def saturation_limits(pixels: DataFrame, saturation: float = 0.001, bins: int = 1024) -> DataFrame:
    """(image_id, low, high): display limits that leave the given share of pixels out at either end.

    A first or last bin that holds more than its neighbour is left out of the histogram first."""
    ends = pixels.groupBy(IMAGE).agg(F.min("v").alias("_a"), F.max("v").alias("_b"))
    width = (F.col("_b") - F.col("_a")) / number(bins)
    at = F.least(F.floor(F.try_divide(F.col("v") - F.col("_a"), width)), F.lit(bins - 1))
    counts = pixels.join(ends, IMAGE).withColumn("_bin", F.coalesce(at, F.lit(0)).cast("int")).groupBy(IMAGE, "_a", "_b", "_bin").agg(F.count(F.lit(1)).alias("_n"))
    seen = lambda k: F.sum(F.when(F.col("_bin") == k, F.col("_n")).otherwise(0)).over(Window.partitionBy(IMAGE))
    flagged = counts.withColumns({"_first": (seen(0) > seen(1)).cast("int"), "_last": (seen(bins - 1) > seen(bins - 2)).cast("int")})
    kept = flagged.filter((F.col("_bin") >= F.col("_first")) & (F.col("_bin") < bins - F.col("_last")))
    up = Window.partitionBy(IMAGE).orderBy("_bin").rowsBetween(Window.unboundedPreceding, -1)
    down = Window.partitionBy(IMAGE).orderBy(F.col("_bin").desc()).rowsBetween(Window.unboundedPreceding, -1)
    left = F.sum("_n").over(Window.partitionBy(IMAGE)) * number(saturation)
    walked = kept.withColumns({"_up": left - F.coalesce(F.sum("_n").over(up), F.lit(0)), "_down": left - F.coalesce(F.sum("_n").over(down), F.lit(0))})
    inside = lambda c: (F.col(c) >= 0) & (F.col(c) < F.col("_n"))
    low = F.col("_a") + (F.col("_bin") + F.col("_up") / F.col("_n")) * width
    high = F.col("_a") + (F.col("_bin") + 1 - F.col("_down") / F.col("_n")) * width
    return walked.groupBy(IMAGE).agg(
        F.min(F.when(inside("_up"), low)).alias("low"), F.max(F.when(inside("_down"), high)).alias("high")
    )


def to_uint8_saturated(pixels: DataFrame, saturation: float = 0.001, bins: int = 1024) -> DataFrame:
    limits = saturation_limits(pixels, saturation, bins)
    clipped = pixels.join(limits, IMAGE).withColumn("v", clip(F.col("v"), F.col("low"), F.col("high"))).drop("low", "high")
    return normalize(clipped).withColumn("v", to_uint8(F.col("v")))


def shrink(pixels: DataFrame, factor: int) -> DataFrame:
    """Block means of factor x factor pixels; incomplete blocks at the far edges are left out."""
    sizes = image_sizes(pixels).select(IMAGE, F.expr(f"height DIV {factor}").alias("_h"), F.expr(f"width DIV {factor}").alias("_w"))
    block = pixels.groupBy(IMAGE, F.expr(f"CAST(y DIV {factor} AS INT)").alias("y"), F.expr(f"CAST(x DIV {factor} AS INT)").alias("x")).agg(F.avg("v").alias("v"))
    return block.join(sizes, IMAGE).filter((F.col("y") < F.col("_h")) & (F.col("x") < F.col("_w"))).drop("_h", "_w")


def resize(pixels: DataFrame, height: int, width: int) -> DataFrame:
    """Bilinear resize with pixel centres aligned; halved by block means while twice as large."""
    sizes = image_sizes(pixels).withColumnsRenamed({"height": "_h", "width": "_w"})
    grid = sizes.withColumn("y", F.explode(F.sequence(F.lit(0), F.lit(height - 1)))).withColumn("x", F.explode(F.sequence(F.lit(0), F.lit(width - 1))))
    place = lambda c, n, size: F.greatest(F.least((F.col(c) + number(0.5)) * F.col(size) / number(n) - number(0.5), F.col(size) - number(1)), number(0))
    at = grid.select(IMAGE, "y", "x", "_h", "_w", place("y", height, "_h").alias("_sy"), place("x", width, "_w").alias("_sx"))
    corner = at.withColumn("_dy", F.explode(F.array(F.lit(0), F.lit(1)))).withColumn("_dx", F.explode(F.array(F.lit(0), F.lit(1))))
    py, px = F.col("_sy") - F.floor("_sy"), F.col("_sx") - F.floor("_sx")
    weight = F.when(F.col("_dy") == 1, py).otherwise(number(1) - py) * F.when(F.col("_dx") == 1, px).otherwise(number(1) - px)
    keyed = corner.select(IMAGE, F.col("y").alias("_oy"), F.col("x").alias("_ox"), weight.alias("_k"),
                          F.least(F.floor("_sy") + F.col("_dy"), F.col("_h") - 1).cast("int").alias("y"),
                          F.least(F.floor("_sx") + F.col("_dx"), F.col("_w") - 1).cast("int").alias("x"))
    joined = keyed.join(pixels.select(IMAGE, "y", "x", "v").hint("merge"), [IMAGE, "y", "x"])  # either side looks as small as the images
    return joined.groupBy(IMAGE, F.col("_oy").alias("y"), F.col("_ox").alias("x")).agg(F.sum(F.col("v") * F.col("_k")).alias("v"))


def two_class_mask(pixels: DataFrame) -> DataFrame:
    """``pixels`` with mask: the brighter of the two intensity classes with the least variance inside.

    The split of the ordered intensities with the largest variance between the classes is the
    optimum of 2-means in one dimension.  A constant image has an empty mask."""
    levels = pixels.groupBy(IMAGE, "v").agg(F.count(F.lit(1)).alias("_n"))
    upto = Window.partitionBy(IMAGE).orderBy("v").rowsBetween(Window.unboundedPreceding, 0)
    whole = Window.partitionBy(IMAGE)
    sums = levels.select(
        IMAGE, "v",
        F.sum("_n").over(upto).alias("_n0"), F.sum(F.col("v") * F.col("_n")).over(upto).alias("_s0"),
        F.sum("_n").over(whole).alias("_nt"), F.sum(F.col("v") * F.col("_n")).over(whole).alias("_st"),
    )
    n1, s1 = F.col("_nt") - F.col("_n0"), F.col("_st") - F.col("_s0")
    gap = F.col("_s0") / F.col("_n0") - F.try_divide(s1, n1)
    cuts = sums.filter(n1 > 0).withColumn("_between", F.col("_n0") * n1 * gap * gap)
    best = cuts.groupBy(IMAGE).agg(F.min_by("v", F.struct(-F.round("_between", 6), F.col("v"))).alias("_cut"))
    return pixels.join(best, IMAGE, "left").withColumn("mask", F.coalesce(F.col("v") > F.col("_cut"), F.lit(False))).drop("_cut")


def nonzero_bbox(pixels: DataFrame, on: Column | None = None) -> DataFrame:
    """(image_id, x, y, w, h) of the pixels that are not 0; the whole image if all are."""
    on = F.col("v") != 0 if on is None else on
    seen = lambda c: F.when(on, F.col(c))
    ends = pixels.groupBy(IMAGE).agg(
        F.min(seen("x")).alias("_x0"), F.max(seen("x")).alias("_x1"), F.min(seen("y")).alias("_y0"), F.max(seen("y")).alias("_y1"),
        (F.max("x") + 1).alias("_w"), (F.max("y") + 1).alias("_h"),
    )
    return ends.select(
        IMAGE, F.coalesce("_x0", F.lit(0)).alias("x"), F.coalesce("_y0", F.lit(0)).alias("y"),
        F.coalesce(F.col("_x1") + 1 - F.col("_x0"), F.col("_w")).alias("w"), F.coalesce(F.col("_y1") + 1 - F.col("_y0"), F.col("_h")).alias("h"),
    )


def contrast_limits(pixels: DataFrame, low: float = 0.01, high: float = 0.98) -> DataFrame:
    """(image_id, low, high, range_low, range_high) over positive pixels; images without any are left out."""
    q = lambda p, name: F.percentile("v", F.lit(p)).alias(name)
    found = pixels.filter(F.col("v") > 0).groupBy(IMAGE).agg(q(low, "low"), q(high, "high"), q(0.0, "range_low"), q(1.0, "range_high"))
    return found.withColumns({"high": F.col("high") + number(1e-8), "range_high": F.col("range_high") + number(1e-8)})


# ------------------------------------------------------------------ components
def _label(mask: np.ndarray) -> np.ndarray:
    """4-neighbour labels from 1, in reading order of their first pixels; 0 off the mask."""
    height, width = mask.shape
    labels = np.where(mask, np.arange(1, mask.size + 1).reshape(mask.shape), 0)
    while True:
        before = labels.copy()
        for axis in (0, 1):
            for flip in (False, True):
                view = np.flip(labels, axis) if flip else labels
                on = np.flip(mask, axis) if flip else mask
                run = np.cumsum(~on, axis=axis) * (mask.size + 1)
                view[...] = np.where(on, np.minimum.accumulate(np.where(on, view, mask.size + 1) - run, axis=axis) + run, 0)
        if (before == labels).all():
            break
    _, dense = np.unique(labels, return_inverse=True)
    return dense.reshape(height, width) + (0 if (labels == 0).any() else 1)


def _tile_roots(masked: DataFrame, tile: int) -> DataFrame:
    """(image_id, y, x, root) of the pixels on the mask: the code of the first pixel of its part in its tile."""
    schema = f"{IMAGE} {masked.schema[IMAGE].dataType.simpleString()}, y int, x int, root long"
    tiled = masked.filter("mask").select(IMAGE, "y", "x", F.floor(F.col("y") / tile).alias("_ty"), F.floor(F.col("x") / tile).alias("_tx"))

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        y0, x0 = int(pdf["_ty"].iloc[0]) * tile, int(pdf["_tx"].iloc[0]) * tile
        y, x = pdf["y"].to_numpy() - y0, pdf["x"].to_numpy() - x0
        grid = np.zeros((tile, tile), dtype=bool)
        grid[y, x] = True
        label = _label(grid)
        fy, fx = np.divmod(np.flatnonzero(grid), tile)
        first = np.zeros(label.max() + 1, dtype=np.int64)
        first[label[fy, fx][::-1]] = ((fy + y0) * PIXEL_CODE + fx + x0)[::-1]
        return pdf[[IMAGE, "y", "x"]].assign(root=first[label[y, x]])

    return tiled.groupBy(IMAGE, "_ty", "_tx").applyInPandas(one, schema)


def _border_links(roots: DataFrame, tile: int) -> DataFrame:
    """(image_id, a, b): parts of two tiles that have neighbouring pixels."""
    links = None
    for axis, other in (("x", "y"), ("y", "x")):
        last = roots.filter(F.col(axis) % tile == tile - 1).select(IMAGE, F.col(other).alias("_o"), (F.col(axis) + 1).alias("_n"), F.col("root").alias("a"))
        first = roots.filter(F.col(axis) % tile == 0).select(IMAGE, F.col(other).alias("_o"), F.col(axis).alias("_n"), F.col("root").alias("b"))
        part = last.join(first, [IMAGE, "_o", "_n"]).select(IMAGE, "a", "b")
        links = part if links is None else links.unionByName(part)
    return links.distinct()


def _united(links: DataFrame) -> DataFrame:
    """(image_id, node, least): the smallest node that links lead to from each node of ``links``.

    In each round every node moves to the first of its neighbours and itself in an order that hashing
    draws anew; links between moved nodes are left.  Rounds follow the logarithm of the longest chain."""
    ensure_checkpoint_dir(links.sparkSession)
    links = links.checkpoint()
    labels, turn = None, 0
    while not links.isEmpty():
        turn += 1
        ways = links.unionByName(links.select(IMAGE, F.col("b").alias("a"), F.col("a").alias("b")))
        rank = lambda c: F.struct(F.xxhash64(c, F.lit(turn)).alias("h"), F.col(c).alias("n"))  # noqa: B023
        near = ways.groupBy(IMAGE, "a").agg(F.min(rank("b")).alias("_near"))
        moves = near.select(IMAGE, F.col("a").alias("node"), F.least(rank("a"), F.col("_near"))["n"].alias("to")).checkpoint()
        left = moves.select(IMAGE, F.col("node").alias("a"), F.col("to").alias("_x"))
        right = moves.select(IMAGE, F.col("node").alias("b"), F.col("to").alias("_y"))
        moved = links.join(left, [IMAGE, "a"]).join(right, [IMAGE, "b"]).filter("_x <> _y")
        links = moved.select(IMAGE, F.least("_x", "_y").alias("a"), F.greatest("_x", "_y").alias("b")).distinct().checkpoint()
        if labels is None:
            labels = moves.select(IMAGE, "node", F.col("to").alias("_at"))
        else:
            step = moves.select(IMAGE, F.col("node").alias("_at"), "to")
            labels = labels.join(step, [IMAGE, "_at"], "left").select(IMAGE, "node", F.coalesce("to", "_at").alias("_at")).checkpoint()
    if labels is None:
        return links.select(IMAGE, F.col("a").alias("node"), F.col("b").alias("least"))
    least = labels.groupBy(IMAGE, "_at").agg(F.min("node").alias("least"))
    return labels.join(least, [IMAGE, "_at"]).select(IMAGE, "node", "least")


def connected_components(masked: DataFrame, tile: int = TILE) -> DataFrame:
    """(image_id, y, x, label) of ``masked(image_id, y, x, mask)``: 4-neighbour labels from 1 in reading
    order of their first pixels, 0 off the mask.

    Tiles are labelled in tasks, parts that meet at a border are united, and only parts are ranked."""
    ensure_checkpoint_dir(masked.sparkSession)
    roots = _tile_roots(masked, tile).checkpoint()
    united = _united(_border_links(roots, tile)).withColumnsRenamed({"node": "root"})
    parts = roots.select(IMAGE, "root").distinct().join(united, [IMAGE, "root"], "left").withColumn("least", F.coalesce("least", "root"))
    ranked = parts.select(IMAGE, "root", F.dense_rank().over(Window.partitionBy(IMAGE).orderBy("least")).cast("int").alias("label"))
    found = roots.join(ranked, [IMAGE, "root"]).select(IMAGE, "y", "x", "label")
    return masked.select(IMAGE, "y", "x").join(found, [IMAGE, "y", "x"], "left").select(
        IMAGE, F.col("y").cast("int").alias("y"), F.col("x").cast("int").alias("x"), F.coalesce("label", F.lit(0)).alias("label"))


def tissue_mask(pixels: DataFrame, top: float = 0.85, speckle: float = 0.01) -> DataFrame:
    """(image_id, y, x, mask): intensities are capped at a quantile and split in two; components below
    a share of the image go, then those at the edge that are below half the largest."""
    cap = pixels.groupBy(IMAGE).agg(F.percentile("v", F.lit(top)).alias("_cap"))
    split = two_class_mask(pixels.join(cap, IMAGE).withColumn("v", F.least("v", "_cap")).drop("_cap"))
    labels = connected_components(split)
    sizes = image_sizes(pixels)
    area = F.col("height") * F.col("width")
    edge = (F.col("y") == 0) | (F.col("x") == 0) | (F.col("y") == F.col("height") - 1) | (F.col("x") == F.col("width") - 1)
    parts = labels.join(sizes, IMAGE).filter(F.col("label") > 0).groupBy(IMAGE, "label").agg(
        F.count(F.lit(1)).alias("_n"), F.max(edge).alias("_edge"), F.max(area).alias("_area")
    ).filter(F.col("_n") >= F.col("_area") * number(speckle))
    largest = F.max("_n").over(Window.partitionBy(IMAGE))
    good = parts.withColumn("_max", largest).filter(~F.col("_edge") | (F.col("_n") >= F.col("_max") * number(0.5))).select(IMAGE, "label", F.lit(True).alias("_good"))
    return labels.join(good, [IMAGE, "label"], "left").select(IMAGE, "y", "x", F.coalesce("_good", F.lit(False)).alias("mask"))


def component_boxes(labels: DataFrame, ratio: float = 1.0) -> DataFrame:
    """(image_id, label, x0, y0, x1, y1) of each component at full resolution."""
    at = lambda c: (c * number(ratio)).cast("long")
    return labels.filter(F.col("label") > 0).groupBy(IMAGE, "label").agg(
        at(F.min("x")).alias("x0"), at(F.min("y")).alias("y0"), at(F.max("x") + 1).alias("x1"), at(F.max("y") + 1).alias("y1")
    )


# ------------------------------------------------------------------ neighbourhoods
def _axes() -> list[Window]:
    return [Window.partitionBy(IMAGE, "y").orderBy("x"), Window.partitionBy(IMAGE, "x").orderBy("y")]


def outline(pixels: DataFrame) -> DataFrame:
    """v = 255 where the value before and behind differ along a row or a column, else 0; borders repeat.

    The outline of a plane of 1024 pixels or more a side is widened by a square that grows with it."""
    differs = F.lit(False)
    for axis in _axes():
        differs = differs | (F.coalesce(F.lead("v").over(axis), F.col("v")) != F.coalesce(F.lag("v").over(axis), F.col("v")))
    lines = pixels.select(IMAGE, "y", "x", differs.cast("int").alias("v"))
    side = F.floor(F.greatest("height", "width") / OUTLINE_SIDE).cast("int")
    sizes = image_sizes(pixels).select(IMAGE, F.greatest(side, F.lit(1)).alias("_side"))
    out = None
    for k in sorted(r["_side"] for r in sizes.select("_side").distinct().collect()):  # a few different sizes
        part = lines.join(sizes.filter(F.col("_side") == k), IMAGE, "left_semi")
        for axis in _axes() if k > 1 else []:
            part = part.withColumn("v", F.max("v").over(axis.rowsBetween(-(k // 2), k - k // 2 - 1)))
        out = part if out is None else out.unionByName(part)
    out = lines if out is None else out
    return out.select(IMAGE, "y", "x", (F.col("v") * 255).alias("v"))


def gradient_norm(pixels: DataFrame, most: float | None = 100) -> DataFrame:
    """``pixels`` with grad: central differences, one-sided at the borders, each at most ``most``."""
    squares = number(0)
    for axis in _axes():
        before, after = F.lag("v").over(axis), F.lead("v").over(axis)
        step = F.when(before.isNull(), after - F.col("v")).when(after.isNull(), F.col("v") - before).otherwise((after - before) / number(2))
        step = step if most is None else F.least(step, number(most))
        squares = squares + F.coalesce(step * step, number(0))
    return pixels.withColumn("grad", F.sqrt(squares))


def sharpness(pixels: DataFrame, scales: int = 3, most: float | None = 100) -> DataFrame:
    """(image_id, sharpness): mean over halved scales of the mean gradient on the bright class."""
    masked = two_class_mask(pixels)
    image, mask = pixels, masked.select(IMAGE, "y", "x", F.col("mask").cast("double").alias("v"))
    parts = []
    for k in range(scales):
        if k:
            image, mask = shrink(image, 2), shrink(mask, 2).withColumn("v", F.rint("v"))
        both = gradient_norm(image, most).join(mask.withColumnRenamed("v", "_m"), [IMAGE, "y", "x"])
        parts.append(both.groupBy(IMAGE).agg(F.try_divide(F.sum(F.col("grad") * F.col("_m")), F.sum("_m")).alias("s")))
    all_ = parts[0]
    for part in parts[1:]:
        all_ = all_.unionByName(part)
    return all_.groupBy(IMAGE).agg(F.try_divide(F.sum("s"), F.lit(scales)).alias("sharpness"))


def opening(masked: DataFrame, size: int = 5, shape: str = "square") -> DataFrame:
    """Erosion, then dilation of ``masked(image_id, y, x, mask)`` by a size x size square, or by a disk of
    the radius ``size``; outside counts as set for the erosion and as unset for the dilation."""
    if shape not in ("square", "disk"):
        raise ValueError(f"unknown shape {shape!r}; use square or disk")
    found = masked.select(IMAGE, "y", "x", F.col("mask").cast("int").alias("mask"))
    row, column = _axes()
    for pick, join in ((F.min, F.least), (F.max, F.greatest)):
        if shape == "square":
            half = size // 2
            for axis in (row, column):
                found = found.withColumn("mask", pick("mask").over(axis.rangeBetween(-half, half)))
            continue
        # a disk does not separate: each of its rows is a run of its own, met by rows above and below
        runs = {dy: int((size * size - dy * dy) ** 0.5) for dy in range(size + 1)}
        found = found.withColumns({f"_r{w}": pick("mask").over(row.rangeBetween(-w, w)) for w in sorted(set(runs.values()))})
        met = [F.col(f"_r{runs[0]}")]
        for dy in range(1, size + 1):
            near = F.col(f"_r{runs[dy]}")
            met += [pick(near).over(column.rangeBetween(k, k)) for k in (-dy, dy)]
        found = found.select(IMAGE, "y", "x", join(*met).alias("mask"))  # rows outside are null and do not count
    return found.withColumn("mask", F.col("mask") == 1)


def remove_outer_speckles(pixels: DataFrame, radius: int = 3, above: float = 10) -> DataFrame:
    """v set to 0 where the opening of the bright pixels by a disk has none."""
    kept = opening(pixels.withColumn("mask", F.col("v") > number(above)), radius, "disk")
    return pixels.join(kept, [IMAGE, "y", "x"]).withColumn("v", F.when(F.col("mask"), F.col("v")).otherwise(F.lit(0).cast(pixels.schema["v"].dataType))).drop("mask")


def plane_bbox(voxels: DataFrame, value: str = "struct_id", size: int = 5) -> DataFrame:
    """(z, x, y, w, h): the box of what an opening leaves of each plane's annotated voxels ``voxels(z, y, x, value)``."""
    planes = voxels.select(F.col("z").alias(IMAGE), "y", "x", (F.col(value) > 0).alias("mask"))
    kept = opening(planes, size).withColumn("v", F.col("mask").cast("int"))
    return nonzero_bbox(kept.drop("mask")).withColumnRenamed(IMAGE, "z")


def padded_box(box: Column, height: Column, width: Column, share: float = 0.1) -> Column:
    """A box (x, y, w, h) with padding, inside the image; struct(x0, y0, x1, y1)."""
    w, h = F.greatest(box["w"], F.lit(1)), F.greatest(box["h"], F.lit(1))
    px, py = (w * number(share)).cast("int"), (h * number(share)).cast("int")
    return F.struct(
        F.greatest(box["x"] - px, F.lit(0)).alias("x0"), F.greatest(box["y"] - py, F.lit(0)).alias("y0"),
        F.least(box["x"] + w + px, width).alias("x1"), F.least(box["y"] + h + py, height).alias("y1"),
    )
