from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from voxtally.operators import cells as C
from voxtally.operators import regions as G
from voxtally.operators import slices as S


@pytest.fixture
def structures(spark):
    rows = [(1, None, "root", "root", [1]), (10, 1, "TEST", "test_region", [1, 10]), (11, 1, "TEST2", "test_region2", [1, 11])]
    return spark.createDataFrame(rows, "id int, parent_id int, acronym string, name string, path array<int>")


@pytest.fixture
def labelled(spark):
    rows = [(10, 0.1, 0.1, a, b) for a, b in ((False, False), (False, True), (True, False), (True, True))]
    return spark.createDataFrame(rows, "struct_id int, x double, y double, `LABEL-a` boolean, `LABEL-b` boolean")


def test_each_combination_of_labels_is_one_cell(labelled):
    flags = C.with_co_labels(labelled)
    combinations = [c for c in flags.columns if c.startswith("COLABEL-")]
    assert sorted(combinations) == sorted(f"COLABEL-a{p}b{q}" for p in "+-" for q in "+-")
    counts = flags.agg(*[F.count_if(F.col(f"`{c}`")).alias(c) for c in combinations]).first()
    assert list(counts) == [1, 1, 1, 1]


def test_a_null_label_is_in_no_combination(spark):
    df = spark.createDataFrame([(None, True), (True, True)], "`LABEL-a` boolean, `LABEL-b` boolean")
    flags = C.with_co_labels(df)
    total = sum(flags.agg(*[F.count_if(F.col(f"`{c}`")) for c in flags.columns if c.startswith("COLABEL-")]).first())
    assert total == 1


def summary(spark, labelled, structures, area, **options):
    areas = spark.createDataFrame([(10, area)], "struct_id int, area double")
    return {r["acronym"]: r.asDict() for r in G.region_summary(labelled, areas, structures, **options).collect()}


def test_summary_rolls_up_the_tree(spark, labelled, structures):
    rows = summary(spark, labelled, structures, 1.0)
    assert set(rows) == {"TEST", "root"}
    for row in rows.values():
        assert (row["cells"], row["a+"], row["b+"], row["total_area_um2"]) == (4, 2, 2, 1)
        assert [v for k, v in row.items() if k.startswith("a") and "b" in k] == [1, 1, 1, 1]


def test_density_beside_the_counts(spark, labelled, structures):
    row = summary(spark, labelled, structures, 16.0, per_area_side=32**0.5)["TEST"]
    assert row["cells"] == pytest.approx(8) and row["a+"] == pytest.approx(4)
    assert row["cells" + G.NOT_NORMALISED] == 4 and row["a+" + G.NOT_NORMALISED] == 2


def test_sizes_fall_back_to_pixels(spark):
    sizes = [(1, 1.0, None), (1, 10.0, None), (1, 15.0, None)]
    for rows, column in ((sizes, "area_um"), ([(1, None, a) for _, a, _ in sizes], "area_pixels")):
        df = spark.createDataFrame(rows, "slice_id int, area_um double, area_pixels double")
        pick = lambda **k: sorted(r[column] for r in C.filter_by_size(df, **k).collect())
        assert pick(min_size=5, max_size=10) == [10]
        assert pick(min_size=10) == [10, 15]
        assert pick(max_size=10) == [1, 10]
        assert pick() == [1, 10, 15]


def test_evenly_spaced_slices(spark):
    def spaced(aps):
        rows = [("s", i, i, False, ({"ap": float(a)},)) for i, a in enumerate(aps)]
        df = spark.createDataFrame(rows, "animal_id string, slice_id long, pos long, ignore boolean, params struct<atlas: struct<ap: double>>")
        df = df.withColumn("params", F.struct(F.struct(F.col("params.atlas.ap").alias("ap"), *[F.lit(0.0).alias(f"rot_{r}") for r in ("frontal", "horizontal", "sagittal")]).alias("atlas")))
        return [r["ap"] for r in S.evenly_space_ap(df).orderBy("pos").select("params.atlas.ap").collect()]

    assert spaced([10, 20, 30, 40, 50]) == pytest.approx([10, 20, 30, 40, 50])
    assert spaced([10, 100, 90, 80, 50]) == pytest.approx([10, 20, 30, 40, 50])
    assert spaced([10, 40]) == pytest.approx([10, 40])
