"""Results, projects and masks to files.  Every table is written by its tasks; nothing is collected."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from voxtally.operators.network import graphml_lines
from voxtally.sources.readers import PROJECT_SUFFIX, basename

DEFAULT_NAMES = {"subject": "cell_count", "slice": "cell_count_per_slice"}


def write_results(df: DataFrame, path: str | None = None, rows: str = "subject", kind: str = "parquet") -> str:
    """The results sheet, named by its rows unless a path is given; returns the path with its suffix."""
    if kind not in ("parquet", "csv"):
        raise ValueError(f"unknown kind {kind!r}; use parquet or csv")
    target = path or DEFAULT_NAMES[rows]
    target = target if target.endswith(f".{kind}") else f"{target}.{kind}"
    writer = df.write.mode("overwrite")
    writer.parquet(target) if kind == "parquet" else writer.option("header", True).csv(target)
    return target


def write_sheets(sheets: dict[str, DataFrame], root: str) -> list[str]:
    """One table per sheet under one prefix."""
    return [write_results(df, f"{root}/{name}") for name, df in sheets.items()]


def write_contrast(root: str, condition: str, values: str, anova: DataFrame, posthoc: DataFrame) -> list[str]:
    return write_sheets({"ANOVA": anova, "Posthoc": posthoc}, f"{root}/contrast-{condition}-{values}")


def write_pls(root: str, condition: str, values: str, sheets: dict[str, DataFrame]) -> list[str]:
    return write_sheets(sheets, f"{root}/pls-{condition}-{values}")


def write_graph(nodes: DataFrame, edges: DataFrame, path: str) -> None:
    """Nodes and edges as tables, and as GraphML lines in their order over the part files."""
    nodes.write.mode("overwrite").parquet(f"{path}/nodes")
    edges.write.mode("overwrite").parquet(f"{path}/edges")
    lines = graphml_lines(nodes, edges).repartitionByRange("part", "a", "b").sortWithinPartitions("part", "a", "b")
    lines.select("line").write.mode("overwrite").text(f"{path}/graphml")


def write_slice_locations(locations: DataFrame, path: str) -> str:
    return write_results(locations, path, kind="csv")


def mask_rows(mask: DataFrame) -> DataFrame:
    """(slice_id, y, row): the values of each image row, separated by commas; a row is one image line."""
    cells = F.array_sort(F.collect_list(F.struct("x", F.col("value").cast("string").alias("v"))))
    return mask.groupBy("slice_id", "y").agg(F.concat_ws(",", F.transform(cells, lambda c: c["v"])).alias("row"))


def write_mask(mask: DataFrame, path: str, kind: str = "parquet") -> None:
    """A registered mask ``(slice_id, y, x, value)``, one directory per slice.  A CSV grid holds plain
    structure ids only, not coordinates."""
    if kind == "parquet":
        mask.write.mode("overwrite").partitionBy("slice_id").parquet(path)
    elif kind == "csv":
        if dict(mask.dtypes)["value"].startswith(("array", "struct")):
            raise ValueError("a CSV mask holds one number per pixel; write coordinates as parquet")
        rows = mask_rows(mask).repartition("slice_id").sortWithinPartitions("slice_id", "y")
        rows.select("slice_id", "row").write.mode("overwrite").partitionBy("slice_id").text(path)
    else:
        raise ValueError(f"unknown kind {kind!r}; use parquet or csv")


# ------------------------------------------------------------------ projects
def subject_rows(subjects: DataFrame, slices: DataFrame) -> DataFrame:
    """(name, subject_info, slice_infos): one nested document per subject, slices in their order."""
    fields = [c for c in slices.columns if c not in ("subject", "pos")]
    nested = slices.groupBy(F.col("subject").alias("name")).agg(
        F.array_sort(F.collect_list(F.struct("pos", F.struct(*fields).alias("s")))).alias("_s")
    )
    info = F.struct("name", "conditions", "rotation")
    joined = subjects.select("name", info.alias("subject_info")).join(nested, "name", "left")
    return joined.select("name", "subject_info", F.coalesce(F.transform("_s", lambda e: e["s"]), F.array()).alias("slice_infos"))


def save_subjects(subjects: DataFrame, slices: DataFrame, root: str, mode: str = "errorifexists") -> None:
    """One directory per subject with its document as JSON."""
    rows = subject_rows(subjects, slices)
    rows.write.mode(mode).partitionBy("name").json(root)


def save_project(settings: DataFrame, path: str) -> None:
    if not path.endswith(PROJECT_SUFFIX):
        raise ValueError(f"a project file ends in {PROJECT_SUFFIX}: {path}")
    settings.coalesce(1).write.mode("errorifexists").json(path)


def is_empty_directory(spark: SparkSession, path: str) -> bool:
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    fs = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return not fs.exists(where) or len(fs.listStatus(where)) == 0


def create_project(settings: DataFrame, root: str, name: str = "project") -> str:
    """A new project in a directory that must be new or empty."""
    if not is_empty_directory(settings.sparkSession, root):
        raise FileExistsError(f"the project directory is not empty: {root}")
    path = f"{root}/{name}{PROJECT_SUFFIX}"
    save_project(settings, path)
    return path


def add_subject(root: str, known: DataFrame, subject: DataFrame, slices: DataFrame) -> None:
    """Append one subject; one that is already in ``known(name)`` is refused."""
    if not subject.join(known.select("name"), "name", "left_semi").isEmpty():
        raise FileExistsError("the subject is already in the project")
    save_subjects(subject, slices, root, mode="append")


def training_labels(slices: DataFrame, channels: Column) -> DataFrame:
    """The manifest of slice images per channel, with the registration of valid slices."""
    atlas, valid = F.col("params.atlas"), ~F.col("ignore")
    seen = lambda c: F.when(valid, c)
    return slices.withColumn("channel", F.explode(channels)).select(
        F.concat(F.col("animal_id").cast("string"), F.lit("/"), basename(F.col("path.filename")), F.lit(" "), F.col("channel"), F.lit(".tif")).alias("filename"),
        "animal_id", F.col("slice_id").alias("image_id"), seen(atlas["ap"]).alias("ap"), seen(-F.col("params.affine.angle")).alias("rot_frontal"),
        seen(atlas["rot_horizontal"]).alias("rot_horizontal"), seen(atlas["rot_sagittal"]).alias("rot_sagittal"),
        F.when(valid, F.lit("yes")).otherwise(F.lit("no")).alias("valid"), "channel",
    )


def write_training_labels(slices: DataFrame, channels: Column, path: str) -> str:
    return write_results(training_labels(slices, channels), path, kind="csv")


def write_cells(cells: DataFrame, path: str) -> None:
    """Detections by slice; slices in ``cells`` replace theirs, others stay."""
    cells.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("slice_id").parquet(path)


def clear_detections(spark: SparkSession, path: str, slice_id) -> None:
    """Delete one slice's detections: its partition directory."""
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(f"{path}/slice_id={slice_id}")
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)
