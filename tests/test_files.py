from __future__ import annotations

import json
import re

import pytest
from pyspark.sql import functions as F

from voxtally.sources import readers, writers
from voxtally.streaming import counts as S

SLICE = {"path": {"filename": "/img/a.czi", "scene": 0, "channel": 1}, "image_size": [10, 20], "lowres_image_size": [5, 10], "ignore": False,
         "params": {"atlas": {"ap": 5.0}, "cell": {"diameter": 3}}}


def test_projects_and_subjects(spark, tmp_path):
    (tmp_path / "p.bwp").write_text(json.dumps({"atlas": "A", "channel": "0", "condition_names": ["c"], "version": "1"}))
    assert readers.read_project(spark, str(tmp_path / "p.bwp")).first()["atlas"] == "A"
    with pytest.raises(ValueError):
        readers.read_project(spark, str(tmp_path / "p.json"))
    for name in ("s2", "s10", "S1"):
        (tmp_path / name).mkdir()
        (tmp_path / name / "data.bws").write_text(json.dumps({"subject_info": {"name": name, "conditions": {"c": "x"}}, "slice_infos": [SLICE, {**SLICE, "ignore": True}]}))
    subjects, slices = readers.read_subjects(spark, str(tmp_path))
    assert [r["name"] for r in subjects.orderBy("place").collect()] == ["S1", "s2", "s10"]
    assert [(r["subject"], r["pos"], r["ignore"]) for r in slices.where("subject = 's2'").orderBy("pos").collect()] == [("s2", 0, False), ("s2", 1, True)]


def test_upgrade_keeps_slices_without_spline(spark):
    old = spark.createDataFrame([(1, json.dumps(SLICE)), (2, json.dumps(SLICE | {"version": "0.1.5", "physical_pixel_sizes": [2.0, 3.0]}))], "id int, doc string")
    rows = readers.upgrade_schema(old).orderBy("id").collect()
    assert [(r["was"], r["physical_pixel_sizes"], r["params"]["atlas"]["ap"]) for r in rows] == [("0.1.1", [1.0, 1.0], 5.0), ("0.1.5", [2.0, 3.0], 5.0)]
    assert "cell" not in rows[0]["params"].asDict()


def slices(spark, *images):
    rows = [(k, {"filename": f"/img/{name}", "scene": scene}, False, 100, 200, 1.0, 2.0) for k, (name, scene) in enumerate(images)]
    return spark.createDataFrame(rows, "slice_id long, path struct<filename: string, scene: int>, ignore boolean, image_height int, image_width int, pixel_height double, pixel_width double")


@pytest.mark.parametrize("names, expected", [
    (["a.b.czi - 3.txt"], "a.b.czi - 3.txt"),
    (["a.b.czi - 10.txt", "a.b.czi - _10.txt"], None),
    ([], None),
    (["x a.b.czi_0_.txt", "a.b.czi 10", "a.b.czi_10"], "x a.b.czi_0_.txt"),
    (["a.b.czi 0", "a.b.czi_0"], None),
])
def test_matching_of_exported_files(spark, names, expected):
    files = spark.createDataFrame([(n,) for n in names], "name string")
    got = readers.match_detection_files(files, slices(spark, ("a.b.czi", 0)), "qupath").first()
    assert got["file"] == expected
    assert got["candidates"] == len(names)


def test_images_are_found_wherever_a_name_holds_them(spark, monkeypatch):
    images = ["noext", "a.czi", "b.h5", "c.ome.tif", "d", "e-1_x", "été.tif", "g (1).t-f", None, "a.czi", "4.h5"]
    scenes = [None, 0, 3, 1, 2, 5, 1, 1, 1, 3, 3]
    names = ["noext 3", "a.czi2 0.txt", "a.czi_0", "b.h53 x", "b.h53_3.txt", "pre c.ome.tiff1", "c.ome.tif-1", "d2", "xe-1_x5", "été.tif 1.txt", "g (1).t-f1", "d d 2", None, "4.h54.h5-3", "4.h53"]
    files = spark.createDataFrame([(n,) for n in [*names, *names[:4]]], "name string")
    wanted = slices(spark, *zip(images, scenes, strict=True)).withColumn("path", F.when(F.col("path.filename") != "/img/None", F.col("path")))
    want = {}
    for k, (image, scene) in enumerate(zip(images, scenes, strict=True)):
        held = [n for n in names if image and n and image in n]
        fit = [n for n in held if re.search(f"{re.escape(image)}.*(?<!\\d){scene}(?!\\d)", n)]
        want[k] = (held[0] if len(held) == 1 else fit[0] if len(fit) == 1 else None, len(held))
    for most in (20_000, 6, 2):  # names of every shape, and of lengths alone
        monkeypatch.setattr(readers, "MAX_SHAPES", most)
        got = {r["slice_id"]: (r["file"], r["candidates"]) for r in readers.match_detection_files(files, wanted, "qupath").collect()}
        assert got == want


def test_only_parts_that_images_are_shaped_like_are_shuffled(spark):
    files = spark.createDataFrame([(f"copy of slice{k}.czi - scene {k % 3}.v1.txt",) for k in range(90, 110)], "name string")
    images = spark.createDataFrame([(f"slice{k}.czi",) for k in range(80, 120)], "_image string")
    held = readers.held_images(files.withColumnRenamed("name", "file"), images).collect()
    assert [r["_image"] for r in held] == [f"slice{k}.czi" for k in range(90, 110)]


def test_centroids_in_pixels_or_fractions(spark):
    rows = spark.createDataFrame([(0, 50.0, 0.5, True), (0, 0.5, 100.0, False), (1, 0.25, 0.75, True)], "slice_id long, `centroid-0` double, `centroid-1` double, `LABEL-a` boolean")
    got = readers.centroid_cells(rows, slices(spark, ("a.czi", 0), ("b.czi", 0))).collect()
    assert sorted((r["slice_id"], r["x"], r["y"]) for r in got) == [(0, 0.0025, 0.5), (0, 0.5, 0.005), (1, 0.75, 0.25)]


def test_import_reports_slices_without_a_file(spark):
    rows = spark.createDataFrame([("a_scene0.csv", 0.5, 0.25)], "file string, `centroid-0` double, `centroid-1` double")
    files = spark.createDataFrame([("a_scene0.csv",)], "name string")
    cells, missing = readers.import_cells("centroid", rows, files, slices(spark, ("a.czi", 0), ("b.czi", 1)))
    assert [(r["slice_id"], r["x"], r["y"]) for r in cells.collect()] == [(0, 0.25, 0.5)]
    assert [r["slice_id"] for r in missing.collect()] == [1]
    with pytest.raises(ValueError):
        readers.import_cells("other", rows, files, slices(spark, ("a.czi", 0)))


def test_detections_outside_the_image_fail(spark):
    rows = spark.createDataFrame([(0, "Positive", 500.0, 5.0, 1.0)], "slice_id long, Class string, `Centroid X µm` double, `Centroid Y µm` double, `Subcellular: Channel 1: Num single spots` double")
    with pytest.raises(Exception, match="outside"):
        readers.qupath_cells(rows, slices(spark, ("a.czi", 0)), [0]).collect()
    fine = rows.withColumn("Centroid X µm", F.lit(40.0)).unionByName(rows.withColumn("Class", F.lit("Other"))).unionByName(rows.withColumn("Centroid X µm", F.lit(float("nan"))))
    got = readers.qupath_cells(fine, slices(spark, ("a.czi", 0)), [0]).collect()
    assert [(r["x"], r["y"], r["LABEL-Channel-1"]) for r in got] == [(0.1, 0.05, True)]


def test_listing_and_cells(spark, tmp_path):
    (tmp_path / "in").mkdir()
    for name in ("a.csv", "b.csv", "c.txt"):
        (tmp_path / "in" / name).write_text("x,y\n0.5,0.25\n")
    done = spark.createDataFrame([("a",)], "stem string")
    assert [r["name"] for r in readers.list_files(spark, str(tmp_path / "in"), "*.csv", done=done).collect()] == ["b.csv"]
    assert sorted(r["file"] for r in readers.read_cells(spark, str(tmp_path / "in"), "x double, y double").collect()) == ["a", "b", "c"]


def test_results_and_sheets(spark, tmp_path):
    df = spark.createDataFrame([(1, "a")], "n int, s string")
    path = writers.write_results(df, str(tmp_path / "r"))
    assert path.endswith("r.parquet") and readers.read_results(spark, path).collect() == df.collect()
    assert writers.write_results(df, str(tmp_path / "r"), kind="csv").endswith(".csv")
    with pytest.raises(FileNotFoundError):
        readers.read_results(spark, str(tmp_path / "none")).collect()
    names = writers.write_contrast(str(tmp_path), "c", "v", df, df)
    assert [n.rsplit("/", 2)[1:] for n in names] == [["contrast-c-v", "ANOVA.parquet"], ["contrast-c-v", "Posthoc.parquet"]]
    assert len(writers.write_pls(str(tmp_path), "c", "v", {"values": df, "salience": df})) == 2


def test_graph_text_is_in_order(spark, tmp_path):
    nodes = spark.createDataFrame([(0, "a<b"), (1, "c")], "id int, name string")
    edges = spark.createDataFrame([(0, 1, 0.5, 0.1, None)], "source int, target int, weight double, pvalue double, null_pvalue double")
    writers.write_graph(nodes, edges, str(tmp_path / "g"))
    text = "".join(p.read_text() for p in sorted((tmp_path / "g/graphml").glob("part-*")))
    assert text.index("<graph ") < text.index("a&lt;b") < text.index("<edge") < text.index("</graph>")


def test_masks(spark, tmp_path):
    mask = spark.createDataFrame([(1, y, x, v) for y, row in enumerate([[1, 2], [3, 4]]) for x, v in enumerate(row)], "slice_id long, y int, x int, value int")
    writers.write_mask(mask, str(tmp_path / "m"))
    assert spark.read.parquet(str(tmp_path / "m")).count() == 4
    writers.write_mask(mask, str(tmp_path / "c"), "csv")
    assert "".join(p.read_text() for p in (tmp_path / "c/slice_id=1").glob("part-*")) == "1,2\n3,4\n"
    with pytest.raises(ValueError):
        writers.write_mask(mask.withColumn("value", F.array("value")), str(tmp_path / "x"), "csv")


def test_project_and_subject_round_trip(spark, tmp_path):
    settings = spark.createDataFrame([("A", "0")], "atlas string, channel string")
    path = writers.create_project(settings, str(tmp_path / "p"))
    assert spark.read.json(path).first()["atlas"] == "A"
    with pytest.raises(FileExistsError):
        writers.create_project(settings, str(tmp_path / "p"))
    subjects = spark.createDataFrame([("s1", {"c": "x"}, None), ("s2", {"c": "y"}, [1.0, 2.0])], "name string, conditions map<string,string>, rotation array<double>")
    slices_ = spark.createDataFrame([("s1", 1, "b"), ("s1", 0, "a")], "subject string, pos int, file string")
    root = str(tmp_path / "subjects")
    writers.save_subjects(subjects, slices_, root)
    got = {r["name"]: [s["file"] for s in r["slice_infos"]] for r in spark.read.schema("slice_infos array<struct<file: string>>, name string").json(root).collect()}
    assert got == {"s1": ["a", "b"], "s2": []}
    with pytest.raises(Exception):
        writers.save_subjects(subjects, slices_, root)
    with pytest.raises(FileExistsError):
        writers.add_subject(root, subjects, subjects.where("name = 's1'"), slices_)
    writers.add_subject(root, subjects, subjects.where("name = 's1'").withColumn("name", F.lit("s3")), slices_)
    assert spark.read.json(root).select("name").distinct().count() == 3


def test_clearing_one_slice(spark, tmp_path):
    path = str(tmp_path / "cells")
    writers.write_cells(spark.createDataFrame([(1, 0.5), (2, 0.5)], "slice_id long, x double"), path)
    writers.write_cells(spark.createDataFrame([(2, 0.75), (2, 0.8)], "slice_id long, x double"), path)
    assert sorted((r["slice_id"], r["x"]) for r in spark.read.parquet(path).collect()) == [(1, 0.5), (2, 0.75), (2, 0.8)]
    writers.clear_detections(spark, path, 2)
    assert [r["slice_id"] for r in spark.read.parquet(path).collect()] == [1]


def test_atlas_without_excluded_structures(spark):
    voxels = spark.createDataFrame([(0, 0, 0, 76, 5.0), (0, 0, 1, 9, 10.0)], "z int, y int, x int, struct_id int, ref double")
    assert sorted((r["struct_id"], r["ref"]) for r in readers.read_atlas(voxels).collect()) == [(0, 0.0), (9, 1.0)]


def test_streamed_counts_equal_the_batch(spark, tmp_path):
    schema = "animal_id long, struct_id int"
    closure = spark.createDataFrame([(1, 1), (10, 10), (10, 1), (11, 11), (11, 1)], "id int, ancestor_id int")
    rows = [(a, s) for a in (1, 2) for s in (10, 11, 11)]
    seen = []
    for k in range(2):
        seen += rows
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = S.stream_detections(spark, str(tmp_path / "in"), schema)
        S.keep_counts(S.stream_region_counts(stream, closure), str(tmp_path / "out"), str(tmp_path / "state")).awaitTermination()
        batch = S.stream_region_counts(spark.createDataFrame(seen, schema), closure)
        assert sorted(map(tuple, S.latest_counts(spark, str(tmp_path / "out")).collect())) == sorted(map(tuple, batch.collect()))
