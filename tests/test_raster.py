from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from voxtally.operators import raster as J


def pixels(spark, *images):
    rows = [(k, int(y), int(x), float(v)) for k, image in enumerate(images) for (y, x), v in np.ndenumerate(np.asarray(image))]
    return spark.createDataFrame(rows, "image_id long, y int, x int, v double")


def image(df, column, shape, k=0):
    out = np.zeros(shape)
    for r in df.where(F.col("image_id") == k).collect():
        out[r["y"], r["x"]] = r[column]
    return out


def test_outline_of_halves(spark):
    left = np.repeat([[0, 0, 1, 1, 1]], 5, axis=0)
    expected = np.zeros((5, 5))
    expected[:, 1:3] = 255
    assert (image(J.outline(pixels(spark, left)), "v", (5, 5)) == expected).all()


def test_two_classes_and_constant_image(spark):
    rng = np.random.default_rng(0)
    bright = np.where(rng.random((12, 12)) < 0.4, rng.normal(10, 1, (12, 12)), rng.normal(0, 1, (12, 12)))
    df = J.two_class_mask(pixels(spark, bright, np.ones((4, 4))))
    assert (image(df, "mask", (12, 12)) == (bright > 5)).all()
    assert not image(df, "mask", (4, 4), 1).any()


def components(mask):
    labels = np.zeros(mask.shape, dtype=int)
    for start in zip(*np.nonzero(mask)):
        if labels[start]:
            continue
        todo, n = [start], labels.max() + 1
        while todo:
            y, x = todo.pop()
            if 0 <= y < mask.shape[0] and 0 <= x < mask.shape[1] and mask[y, x] and not labels[y, x]:
                labels[y, x] = n
                todo += [(y + 1, x), (y - 1, x), (y, x + 1), (y, x - 1)]
    return labels


@pytest.mark.parametrize("share", [0.3, 0.5, 0.65, 1.0])
def test_connected_components_match_flood_fill(spark, share):
    mask = np.random.default_rng(int(share * 10)).random((17, 23)) < share
    df = J.connected_components(pixels(spark, mask).withColumn("mask", F.col("v") > 0))
    assert (image(df, "label", mask.shape) == components(mask)).all()


def test_boxes(spark):
    mask = np.zeros((6, 8))
    mask[1:3, 2:5] = 1
    df = pixels(spark, mask, np.zeros((6, 8)))
    boxes = {r["image_id"]: tuple(r)[1:] for r in J.nonzero_bbox(df).collect()}
    assert boxes == {0: (2, 1, 3, 2), 1: (0, 0, 8, 6)}
    labels = J.connected_components(df.withColumn("mask", F.col("v") > 0))
    assert [tuple(r)[2:] for r in J.component_boxes(labels, 2.5).collect()] == [(5, 2, 12, 7)]
    box = J.padded_box(F.struct(F.lit(1).alias("x"), F.lit(2).alias("y"), F.lit(20).alias("w"), F.lit(0).alias("h")), F.lit(10), F.lit(22))
    assert tuple(spark.range(1).select(box.alias("b")).first()["b"]) == (0, 2, 22, 3)


def test_tissue_mask_drops_speckles_and_edge_parts(spark):
    grid = np.zeros((40, 40))
    grid[10:30, 10:30] = 9
    grid[2, 2] = 9
    grid[0:5, 35:40] = 9
    got = image(J.tissue_mask(pixels(spark, grid), top=1.0), "mask", grid.shape)
    expected = np.zeros((40, 40))
    expected[10:30, 10:30] = 1
    assert (got == expected).all()


def test_saturation_limits_match_a_walk_over_the_histogram(spark):
    values = np.random.default_rng(4).normal(size=(20, 30))
    hist, edges = np.histogram(values, bins=32)
    hist, edges = (hist[1:], edges[1:]) if hist[0] > hist[1] else (hist, edges)
    hist, edges = (hist[:-1], edges[:-1]) if hist[-1] > hist[-2] else (hist, edges)
    out = hist.sum() * 0.05
    before = np.cumsum(hist) - hist
    i = np.flatnonzero((out - before >= 0) & (out - before < hist))[0]
    behind = hist.sum() - np.cumsum(hist)
    j = np.flatnonzero((out - behind >= 0) & (out - behind < hist))[-1]
    width = edges[1] - edges[0]
    row = J.saturation_limits(pixels(spark, values), 0.05, 32).first()
    assert row["low"] == pytest.approx(edges[i] + (out - before[i]) / hist[i] * width)
    assert row["high"] == pytest.approx(edges[j + 1] - (out - behind[j]) / hist[j] * width)


def test_sharpness_matches_numpy(spark):
    values = np.random.default_rng(5).integers(0, 200, (16, 16)).astype(float)
    df = pixels(spark, values)
    mask = image(J.two_class_mask(df), "mask", values.shape)
    found, img = [], values
    for k in range(3):
        if k:
            half = lambda a: a.reshape(a.shape[0] // 2, 2, a.shape[1] // 2, 2).mean(axis=(1, 3))
            img, mask = half(img), np.rint(half(mask))
        gy, gx = np.gradient(img)
        norm = np.sqrt(np.minimum(gx, 100) ** 2 + np.minimum(gy, 100) ** 2)
        if mask.sum():
            found.append((norm * mask).sum() / mask.sum())
    assert J.sharpness(df).first()["sharpness"] == pytest.approx(sum(found) / 3)


def test_opening_removes_thin_parts(spark):
    mask = np.zeros((9, 9))
    mask[2:7, 2:7] = 1
    mask[4, :] = 1
    got = image(J.opening(pixels(spark, mask).withColumn("mask", F.col("v") > 0), 3), "mask", mask.shape)
    assert got[2:7, 2:7].all() and got.sum() == 25


@pytest.mark.parametrize("tile", [4, 7, 16])
@pytest.mark.parametrize("share", [0.45, 0.6, 0.75])
def test_components_across_tiles_match_flood_fill(spark, tile, share):
    masks = [np.random.default_rng(int(share * 100) + k).random((23, 31)) < share for k in range(2)]
    spiral = np.zeros((23, 31), dtype=bool)
    spiral[::2] = True
    spiral[1::4, -1] = True
    spiral[3::4, 0] = True
    df = pixels(spark, *masks, spiral).withColumn("mask", F.col("v") > 0)
    got = J.connected_components(df, tile).toPandas()
    for k, mask in enumerate([*masks, spiral]):
        grid = np.zeros(mask.shape, dtype=int)
        own = got[got.image_id == k]
        grid[own.y, own.x] = own.label
        assert (grid == components(mask)).all()


def test_no_task_labels_more_than_a_tile(spark):
    mask = np.ones((130, 70))
    roots = J._tile_roots(pixels(spark, mask).withColumn("mask", F.col("v") > 0), J.TILE)
    assert roots.select("root").distinct().count() == 3 * 2


def dilated(mask, offsets):
    out = np.zeros_like(mask)
    for dy, dx in offsets:
        moved = np.zeros_like(mask)
        h, w = mask.shape
        moved[max(0, dy):h + min(0, dy), max(0, dx):w + min(0, dx)] = mask[max(0, -dy):h + min(0, -dy), max(0, -dx):w + min(0, -dx)]
        out |= moved
    return out


@pytest.mark.parametrize("radius", [1, 2, 3])
def test_opening_by_a_disk(spark, radius):
    mask = np.random.default_rng(radius).random((25, 19)) < 0.9
    offsets = [(y, x) for y in range(-radius, radius + 1) for x in range(-radius, radius + 1) if y * y + x * x <= radius * radius]
    want = dilated(~dilated(~mask, offsets), offsets)
    got = J.opening(pixels(spark, mask).withColumn("mask", F.col("v") > 0), radius, "disk")
    assert (image(got, "mask", mask.shape) == want).all()
    bright = np.where(mask, 50.0, 3.0)
    cleaned = J.remove_outer_speckles(pixels(spark, bright), radius)
    assert (image(cleaned, "v", mask.shape) == np.where(want, bright, 0)).all()


def test_wide_outlines_are_widened(spark):
    grid = np.zeros((3, 1600))
    grid[:, 700:] = 1
    got = image(J.outline(pixels(spark, grid)), "v", grid.shape)
    for row in got:
        assert row.nonzero()[0].tolist() == [698, 699, 700, 701]
