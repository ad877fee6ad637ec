"""Joins of exploded tables are not broadcast, however small the tables they come from look."""

from __future__ import annotations

import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from voxtally.operators import geometry as T
from voxtally.operators import raster as J
from voxtally.sources import readers


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_resize_broadcasts_no_grid(spark):
    pixels = spark.createDataFrame([(1, y, x, float(y * 2 + x)) for y in range(2) for x in range(2)], "image_id long, y int, x int, v double")
    small = J.resize(pixels, 1, 1)
    assert "Broadcast" not in plan_of(small)
    assert [r["v"] for r in small.collect()] == [1.5]


def test_matching_files_broadcasts_no_parts_of_names(spark):
    files = spark.createDataFrame([("slice1.czi - scene 1.txt",)], "name string")
    slices = spark.createDataFrame([(1, ("/a/slice1.czi", 1))], "slice_id long, path struct<filename: string, scene: int>")
    found = readers.match_detection_files(files, slices, "qupath")
    assert "Broadcast" not in plan_of(found)
    assert [tuple(r) for r in found.collect()] == [(1, "slice1.czi - scene 1.txt", 1)]


def slices(spark):
    return spark.createDataFrame(
        [(1, ((0.0, 0.0, 0.0, 1.0, 1.0), (5.0, 0.0, 0.0, 0.0), None), 3, 4)],
        "slice_id long, params struct<affine: struct<angle: double, tx: double, ty: double, sx: double, sy: double>,"
        "atlas: struct<ap: double, rot_frontal: double, rot_horizontal: double, rot_sagittal: double>,"
        "tps: struct<points_src: array<array<double>>, points_dst: array<array<double>>>>, lowres_height int, lowres_width int")


def test_registered_pixels_are_not_broadcast(spark):
    places = T.registered_coordinates(slices(spark), (20, 32, 32), 6, 8)
    assert "Broadcast" not in plan_of(places)
    assert places.count() == 48
    plane = spark.createDataFrame([(1, 0, 0, 7)], "slice_id long, y int, x int, value long")
    values = T.registered_values(slices(spark), plane, (20, 32, 32), 6, 8)
    assert "Broadcast" not in plan_of(values)
    assert values.filter("value = 7").count() == 4


def test_splines_of_several_lengths_are_solved_together(spark):
    rng = np.random.default_rng(1)
    rows = [(k, rng.uniform(0, 9, (n, 2)).tolist(), rng.uniform(0, 9, (n, 2)).tolist()) for k, n in enumerate((4, 6, 4, 3))]
    control = spark.createDataFrame(rows, "slice_id long, points_src array<array<double>>, points_dst array<array<double>>")
    fitted = {r["slice_id"]: r for r in T.fit_splines(control).collect()}
    for key, src, dst in rows:
        w = T.spline_coefficients(np.array(src), np.array(dst))
        assert [len(fitted[key]["knots"]), len(fitted[key]["flat"])] == [len(src), 6]
        assert fitted[key]["flat"] == pytest.approx(w[len(src):].ravel(), abs=1e-6)


def test_the_tps_query_broadcasts_no_points(spark, tmp_path):
    from voxtally.plans.image_queries import tps

    spark.range(3).select(F.col("id").alias("o_orderkey")).write.parquet(f"{tmp_path}/orders.parquet")
    found = tps(spark, str(tmp_path))
    assert "Broadcast" not in plan_of(found)
    assert found.count() == 27


def test_planes_are_spread_before_their_pixels(spark):
    planes = spark.createDataFrame([(k, *[0.0] * 6) for k in range(8)], "plane long, ap double, si double, lr double, rot_frontal double, rot_horizontal double, rot_sagittal double")
    spread = T.slice_coordinates(planes.coalesce(1), 2, 2)
    assert spread.count() == 32
    assert spread.rdd.getNumPartitions() == int(spark.conf.get("spark.sql.shuffle.partitions"))


def test_the_results_are_gone_through_once(spark):
    from voxtally.operators import stats

    passes = spark.sparkContext.accumulator(0)

    def seen(frames):
        for pdf in frames:
            passes.add(len(pdf))
            yield pdf

    rows = [(f"{c}{i}", c, a, False, True, i) for c in "pq" for i in range(3) for a in ("A", "B")]
    schema = "animal_id string, condition string, acronym string, is_parent_structure boolean, is_gray_matter boolean, cells long"
    results = spark.createDataFrame(rows, schema).mapInPandas(seen, schema)
    matrix = stats.build_matrix(results, "cells", "condition", 2)
    assert matrix.sizes == [3, 3] and matrix.rows.count() == 6
    assert passes.value == len(rows)
    stats.contrast(results, "condition", "cells", [("p", "q")])[1].collect()
    assert passes.value == 2 * len(rows)


def test_counts_by_slice_are_spread_before_counting(spark):
    from voxtally.operators import regions

    cells = spark.createDataFrame([(s, 1, 0.5) for s in (1, 1, 2)], "slice_id long, struct_id int, x double")
    counts = regions.cell_counts(cells, ["slice_id"])
    assert plan_of(counts).count("Exchange hashpartitioning") == 1
    assert "Exchange hashpartitioning(slice_id" in plan_of(counts)
    assert sorted((r["slice_id"], r["cells"]) for r in counts.collect()) == [(1, 2), (2, 1)]


def test_tails_of_many_degrees_of_freedom():
    from math import erfc

    from voxtally.functions.special import t_tail2

    t = np.linspace(0.001, 4, 300)
    normal = [erfc(v / 2**0.5) for v in t]
    for df in (1e5, 3.6e5, 2e6):
        assert t_tail2(t, np.full(300, df)) == pytest.approx(normal, abs=1e-5)


def test_masks_are_shuffled_as_tiles(spark):
    from voxtally.operators import cells

    true = [(s, y, x) for s in (1, 2) for y in range(-9, 20, s) for x in range(-3, 70, 3 - s)]
    mask = spark.createDataFrame([*true, *true[::2], (1, None, 3), (None, 1, 1)], "slice_id long, y int, x int")
    sizes = spark.createDataFrame([(1, 20, 60), (2, 20, 60)], "slice_id long, height int, width int")
    points = [(s, y + 0.5, x + 0.5) for s in (1, 2) for y in range(-12, 24) for x in range(-6, 64, 3)]
    placed = spark.createDataFrame([*points, *points[:5], (1, None, 3.0)], "slice_id long, y double, x double")
    found = cells.points_on_mask(placed, mask, sizes, ignore_outliers=True)
    assert not re.search(r"hashpartitioning\(slice_id#\d+L?, _y#", plan_of(found))  # no pixels
    assert cells.mask_tiles(mask.filter("slice_id = 1 AND y IS NOT NULL")).count() == 5 * 10
    lit = {p for p in true if 0 <= p[1] < 20 and 0 <= p[2] < 60}
    for r in found.collect():
        assert r["on_mask"] == (r["y"] is not None and (r["slice_id"], int(r["y"] // 1), int(r["x"] // 1)) in lit)
    assert found.count() == len(points) + 6


def test_annotated_squares_are_spread_before_their_pixels(spark, tmp_path):
    from voxtally.plans.image_queries import filter_on_annotation

    spark.sql("SELECT 1L AS o_orderkey, 1L AS o_custkey, 9.0D AS o_totalprice, '5-LOW' AS o_orderpriority").write.parquet(f"{tmp_path}/orders.parquet")
    lines = spark.sql("SELECT 1L AS l_orderkey, CAST(id AS INT) AS l_linenumber, id * 7 AS l_partkey, id * 5 AS l_suppkey FROM range(40)")
    lines.write.parquet(f"{tmp_path}/lineitem.parquet")
    found = filter_on_annotation(spark, str(tmp_path))
    below = plan_of(found).split("Generate explode")
    assert len(below) == 3 and "Exchange hashpartitioning(slice_id" in below[2].split("FileScan")[0]


def test_new_groups_come_from_the_leading_words_and_ties_from_whole_draws():
    from voxtally.functions import draws as D
    from voxtally.operators import resample as RS

    sid, ids = np.arange(5, 3000), np.arange(60)
    drawn = D.draw62(3, ids[:, None], sid[None, :])
    assert (D.high_word(3, ids[:, None], sid[None, :]) == drawn >> 30).all()
    limits = np.sort(drawn, axis=1)[:, [0, 700, 701, 2994]]  # draws themselves, so that leading words tie
    limits[7, 3] = np.iinfo(np.int64).max
    for cuts in (limits, limits - 1):
        assert (RS.permuted_cells(3, ids, sid, cuts) == (drawn[:, :, None] > cuts[:, None, :]).sum(axis=2)).all()


def rows_out_of_python(df):
    """Rows that the Python tasks of a collected plan returned."""
    found, todo = [], [df._jdf.queryExecution().executedPlan()]
    while todo:
        node = todo.pop()
        name = node.nodeName()
        todo += [node.finalPhysicalPlan()] if name == "AdaptiveSparkPlan" else [node.plan()] if "QueryStage" in name else []
        todo += [node.children().apply(k) for k in range(node.children().size())]
        if name in ("MapInPandas", "MapInArrow"):
            found.append(node.metrics().apply("pythonNumRowsReceived").value())
    return found


def test_draws_of_a_task_are_counted_together(spark):
    from voxtally.operators import resample as RS

    rows = spark.range(400).select(F.col("id").alias("animal_id"), F.lit(0).alias("group"), F.array(F.lit(1.0)).alias("x"))
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "20")
    try:
        blocks = RS.make_blocks(rows.coalesce(1), [400], block_size=100)
        blocks.rows = blocks.rows.coalesce(1)
        slots = RS.bootstrap_slots(blocks, 5, 1)
        assert sorted({r["_block"] for r in slots.collect()}) == [0, 1, 2, 3]
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert rows_out_of_python(slots) == [5 * 4]
    assert {r["n"] for r in slots.groupBy("resample").agg(F.sum("slots").alias("n")).collect()} == {400}
    assert "MapInArrow" in plan_of(RS.permutation_plan(blocks, 3, 1))


def test_larger_tables_are_counted_in_more_tasks(spark, monkeypatch):
    from voxtally.operators import regions

    cells = spark.range(200).select(F.col("id").alias("slice_id"), F.lit(2).alias("struct_id"), F.lit(0.5).alias("x"))
    areas = spark.range(200).select(F.col("id").alias("slice_id"), F.lit(3).alias("struct_id"), F.lit(True).alias("on_tissue"))
    slices = spark.range(400).select(F.col("id").alias("slice_id"), (F.col("id") % 2).alias("animal_id"))
    subjects = spark.createDataFrame([(0, "p"), (1, "q")], "animal_id long, condition string")
    tree = spark.createDataFrame([(1, None, "root", "r", [1]), (2, 1, "GM", "g", [1, 2]), (3, 1, "WM", "w", [1, 3])], "id int, parent_id int, acronym string, name string, path array<int>")
    monkeypatch.setattr(regions, "ROWS_PER_TASK", 20)
    assert regions.cell_counts(cells, ["slice_id"]).rdd.getNumPartitions() == 10
    found = regions.summarise(cells, regions.region_areas(areas, 2.0, ["slice_id"]), slices, subjects, tree)
    spread = re.findall(r"Exchange hashpartitioning\((\w+)#\d+L?, (\d+)\), REPARTITION_BY_NUM", plan_of(found))
    assert spread == [("animal_id", "10"), *[("slice_id", "10")] * 3]
    assert {r["total_area_um2"]: r["cells"] for r in found.filter("acronym <> 'root'").collect()} == {0: 100, 200: 0}
    monkeypatch.setattr(regions, "ROWS_PER_TASK", 500_000)
    assert regions.tasks_for(cells) == int(spark.conf.get("spark.sql.shuffle.partitions"))


def test_means_and_norms_go_to_the_rows(spark):
    from voxtally.operators import pls, stats

    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        wide = spark.createDataFrame([(k, "p" if k else None, {"A": float(k), "B": None if k == 1 else 4.0}) for k in range(4)], "animal_id long, condition string, _v map<string, double>")
        rows = stats.matrix_rows(wide, "condition", ["A", "B"])
        assert "SortMergeJoin" not in plan_of(rows)
        assert sorted((r["animal_id"], r["x"]) for r in rows.collect()) == [(0, [0.0, 4.0]), (1, [1.0, 4.0]), (2, [2.0, 4.0]), (3, [3.0, 4.0])]
        long = spark.createDataFrame([(1, "a", 3.0), (2, "a", 4.0), (1, "b", 0.0)], "sample long, feature string, value double")
        units = pls.normalize_columns(long, ["feature"])
        assert "SortMergeJoin" not in plan_of(units)
        assert sorted(r["value"] for r in units.collect()) == pytest.approx([0.0, 0.6, 0.8])
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
