"""The project tables (structures, subjects, slices, cells, annotation pixels, images, ...)
read from the TPC-H-like parquet tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from voxtally.functions.columns import number
from voxtally.operators import slices as slice_ops

# Fixed values of the project mapping.
PIXEL_AREA_UM2 = 600.0
ROOT_ID, GM_ID, WM_ID = 1, 2, 3
IMAGE_SIDE = 8


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def structures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id, parent_id, acronym, name, path, rgb; a four-level tree, leaves are nations."""
    region = table(spark, sf_dir, "region")
    nation = table(spark, sf_dir, "nation")
    roots = spark.sql(
        "SELECT * FROM VALUES (1, CAST(NULL AS INT), 'root', 'root', array(1)),"
        " (2, 1, 'GM', 'gray matter', array(1, 2)), (3, 1, 'WM', 'white matter', array(1, 3))"
        " AS t(id, parent_id, acronym, name, path)"
    )
    kind = lambda key: F.when(key < 3, F.lit(GM_ID)).otherwise(F.lit(WM_ID))
    regions = region.select(
        (F.lit(10) + F.col("r_regionkey")).alias("id"),
        kind(F.col("r_regionkey")).alias("parent_id"),
        F.concat(F.lit("R"), F.col("r_regionkey").cast("string")).alias("acronym"),
        F.col("r_name").alias("name"),
    ).withColumn("path", F.array(F.lit(ROOT_ID), F.col("parent_id"), F.col("id")))
    leaves = nation.select(
        (F.lit(100) + F.col("n_nationkey")).alias("id"),
        (F.lit(10) + F.col("n_regionkey")).alias("parent_id"),
        F.concat(F.lit("N"), F.col("n_nationkey").cast("string")).alias("acronym"),
        F.col("n_name").alias("name"),
        F.array(
            F.lit(ROOT_ID), kind(F.col("n_regionkey")), F.lit(10) + F.col("n_regionkey"),
            F.lit(100) + F.col("n_nationkey"),
        ).alias("path"),
    )
    return (
        roots.unionByName(regions)
        .unionByName(leaves)
        .withColumn("rgb", F.array(*[F.pmod(F.col("id") * k, F.lit(256)) for k in (7, 13, 29)]))
    )


def subjects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """animal_id, condition, nation and the same two as a map."""
    return table(spark, sf_dir, "customer").select(
        F.col("c_custkey").alias("animal_id"),
        F.col("c_mktsegment").alias("condition"),
        F.col("c_nationkey").cast("string").alias("nation"),
        F.create_map(
            F.lit("segment"), F.col("c_mktsegment"),
            F.lit("nation"), F.col("c_nationkey").cast("string"),
        ).alias("conditions"),
    )


def slices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """slice_id, animal_id, ap, ignore, has_atlas (every seventh slice has no atlas position)."""
    return table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("slice_id"),
        F.col("o_custkey").alias("animal_id"),
        (F.col("o_totalprice") / number(1000)).alias("ap"),
        (F.col("o_orderpriority") == "5-LOW").alias("ignore"),
    )


def _corners(shift: Column) -> Column:
    """The corners of an eight by eight image, moved by ``shift``."""
    return F.array(*[F.array(number(x) + shift, number(y) + shift) for x in (0, 8) for y in (0, 8)])


def slice_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Slices with nested path, sizes and registration parameters, one row per slice."""
    return table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("slice_id"),
        F.col("o_custkey").alias("animal_id"),
        F.col("o_orderkey").alias("pos"),
        (F.col("o_orderpriority") == "5-LOW").alias("ignore"),
        F.struct(
            F.concat(
                F.lit("/images/"), F.col("o_custkey").cast("string"), F.lit("/slice"),
                F.col("o_orderkey").cast("string"), F.lit(".czi"),
            ).alias("filename"),
            F.when(
                F.col("o_orderkey") % 3 != 0, (F.col("o_orderkey") % 3).cast("int")
            ).alias("scene"),
            F.lit(None).cast("int").alias("channel"),
        ).alias("path"),
        F.struct(
            F.when(
                F.col("o_orderkey") % 7 != 0,
                F.struct(
                    (F.col("o_totalprice") / number(1000)).alias("ap"),
                    number(0).alias("rot_frontal"),
                    (F.col("o_orderkey") % 5).cast("double").alias("rot_horizontal"),
                    (F.col("o_orderkey") % 4).cast("double").alias("rot_sagittal"),
                ),
            ).alias("atlas"),
            F.struct(
                (F.col("o_orderkey") % 30).cast("double").alias("angle"),
                (F.col("o_orderkey") % 11).cast("double").alias("tx"),
                (F.col("o_orderkey") % 13).cast("double").alias("ty"),
                (number(1) + (F.col("o_orderkey") % 5).cast("double") / number(10)).alias("sx"),
                (number(1) + (F.col("o_orderkey") % 4).cast("double") / number(10)).alias("sy"),
            ).alias("affine"),
            F.when(
                F.col("o_orderkey") % 11 != 0,
                F.struct(_corners(number(0)).alias("points_src"), _corners((F.col("o_orderkey") % 9).cast("double")).alias("points_dst")),
            ).alias("tps"),
        ).alias("params"),
    )


def cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The fact table: one row per detected cell, keyed by slice."""
    line = table(spark, sf_dir, "lineitem")
    supplier = table(spark, sf_dir, "supplier").select("s_suppkey", "s_nationkey")
    return line.join(supplier, F.col("l_suppkey") == F.col("s_suppkey")).select(
        F.col("l_orderkey").alias("slice_id"),
        (F.lit(100) + F.col("s_nationkey")).alias("struct_id"),
        ((F.col("l_partkey") % 97).cast("double") / number(97)).alias("x"),
        ((F.col("l_suppkey") % 89).cast("double") / number(89)).alias("y"),
        F.when(
            ~((F.col("l_orderkey") % 50 == 0) & (F.col("l_linenumber") == 1)), F.col("l_quantity")
        ).alias("area_um"),
        (number(4) * F.col("l_quantity")).alias("area_pixels"),
        F.col("l_extendedprice").alias("mean_intensity"),
        (F.col("l_returnflag") == "R").alias("LABEL-a"),
        (F.col("l_linestatus") == "O").alias("LABEL-b"),
        (F.col("l_discount") >= number(0.05)).alias("LABEL-c"),
    )


def annotation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per annotated pixel of a slice: struct_id and tissue mask."""
    return table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("slice_id"),
        (F.lit(100) + F.col("l_partkey") % 25).cast("int").alias("struct_id"),
        (F.col("l_tax") > number(0.02)).alias("on_tissue"),
    )


def slice_areas(spark: SparkSession, sf_dir: str) -> DataFrame:
    from voxtally.operators import regions

    return regions.region_areas(annotation(spark, sf_dir), PIXEL_AREA_UM2, keys=("slice_id",))


def valid_slices(spark: SparkSession, sf_dir: str) -> DataFrame:
    return slice_ops.valid_slices(slices(spark, sf_dir))


def pixels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """image_id, y, x, v: the 64 numbers of an embedding as an 8 x 8 image."""
    return (
        table(spark, sf_dir, "embeddings")
        .select(F.col("vec_id").alias("image_id"), F.posexplode("embedding").alias("k", "v"))
        .select(
            "image_id",
            F.expr("CAST(k DIV 8 AS INT)").alias("y"),
            (F.col("k") % 8).cast("int").alias("x"),
            F.col("v").cast("double").alias("v"),
        )
    )


def voxels(spark: SparkSession, sf_dir: str, side: int = 16) -> DataFrame:
    """z, y, x, struct_id, ref, hemi: one voxel per part, in planes of side x side."""
    key = F.col("p_partkey")
    z, y, x = (F.expr(f"p_partkey DIV {side * side}"), F.expr(f"(p_partkey DIV {side}) % {side}"), key % side)
    return table(spark, sf_dir, "part").select(
        z.cast("int").alias("z"), y.cast("int").alias("y"), x.cast("int").alias("x"),
        (F.lit(100) + (z * 31 + y * 7 + x) % 25).cast("int").alias("struct_id"),
        F.col("p_retailprice").alias("ref"),
        F.when(x < side // 2, F.lit(2)).otherwise(F.lit(1)).alias("hemi"),
    )


def results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The per-subject results table that every statistic starts from."""
    from voxtally.operators import regions

    summary = regions.summarise(
        cells(spark, sf_dir),
        slice_areas(spark, sf_dir),
        valid_slices(spark, sf_dir),
        subjects(spark, sf_dir).select("animal_id", "condition"),
        structures(spark, sf_dir),
    )
    return summary
