"""Project files, detection files and atlas tables as DataFrames.

Reading is Spark's; what the rows mean is in ``DataFrame -> DataFrame`` functions, so that tables from
any source go through the same code."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from voxtally.functions.columns import LABEL_PREFIX, col, label_columns, natural_key, null_if_nan, number
from voxtally.operators.cells import class_in, drop_missing_points, threshold_label

PROJECT_SCHEMA = (
    "atlas string, channel string, condition_names array<string>, version string, default_cell_detector_params"
    " struct<normalizer: string, normalizer_range: array<double>, cell_size_range: array<double>>"
)
ATLAS_PARAMS = "struct<ap: double, rot_frontal: double, rot_horizontal: double, rot_sagittal: double, hemisphere: string, confidence: double>"
AFFINE_PARAMS = "struct<angle: double, tx: double, ty: double, sx: double, sy: double, cx: double, cy: double>"
TPS_PARAMS = "struct<points_src: array<array<double>>, points_dst: array<array<double>>>"
SLICE_SCHEMA = (
    "path struct<filename: string, scene: int, channel: int>, image_size array<int>, lowres_image_size array<int>,"
    f" params struct<atlas: {ATLAS_PARAMS}, affine: {AFFINE_PARAMS}, tps: {TPS_PARAMS}>, ignore boolean, physical_pixel_sizes array<double>"
)
SUBJECT_SCHEMA = (
    "subject_info struct<name: string, conditions: map<string, string>, rotation: array<double>>,"
    f" slice_infos array<struct<{SLICE_SCHEMA}>>"
)
PROJECT_SUFFIX = ".bwp"
SUBJECT_SUFFIX = ".bws"
# Atlas structures that a project leaves out by default.
EXCLUDED_STRUCTURES = (76, 42, 41)


# ------------------------------------------------------------------ projects
def read_project(spark: SparkSession, path: str) -> DataFrame:
    """The settings of one project file, one row."""
    if not path.endswith(PROJECT_SUFFIX):
        raise ValueError(f"a project file ends in {PROJECT_SUFFIX}: {path}")
    return spark.read.schema(PROJECT_SCHEMA).option("multiLine", True).json(path)


def subject_documents(raw: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``raw(directory, subject_info, slice_infos)`` to subjects and slices; ``place`` is the natural order
    of the directories, ``pos`` the position of a slice in its subject."""
    keyed = raw.withColumn("place", natural_key(F.col("directory")))
    subjects = keyed.select("directory", "place", "subject_info.*")
    slices = keyed.select("directory", "place", F.col("subject_info.name").alias("subject"), F.posexplode("slice_infos").alias("pos", "s"))
    return subjects, slices.select("directory", "place", "subject", "pos", "s.*")


def read_subjects(spark: SparkSession, root: str) -> tuple[DataFrame, DataFrame]:
    raw = (
        spark.read.schema(SUBJECT_SCHEMA).option("multiLine", True).option("recursiveFileLookup", True)
        .option("pathGlobFilter", f"*{SUBJECT_SUFFIX}").json(root)
    )
    directory = F.regexp_extract(F.col("_metadata.file_path"), r"([^/]+)/[^/]+$", 1)
    return subject_documents(raw.withColumn("directory", directory))


def upgrade_schema(documents: DataFrame, column: str = "doc") -> DataFrame:
    """JSON slice documents of any earlier version in today's form: (version, was, slice fields).

    A document without version is of 0.1.1.  Old ``cell`` parameters are dropped, a missing pixel size is
    1 x 1, and slices without a spline are kept."""
    parsed = F.from_json(F.col(column), f"version string, {SLICE_SCHEMA}")
    rows = documents.withColumn("_d", parsed)
    sizes = F.coalesce(F.col("_d.physical_pixel_sizes"), F.array(number(1), number(1)))
    others = [c for c in documents.columns if c != column]
    return rows.select(
        *others, F.coalesce("_d.version", F.lit("0.1.1")).alias("was"), F.col("_d.path").alias("path"),
        F.col("_d.image_size").alias("image_size"), F.col("_d.lowres_image_size").alias("lowres_image_size"),
        F.col("_d.params").alias("params"), F.coalesce("_d.ignore", F.lit(False)).alias("ignore"), sizes.alias("physical_pixel_sizes"),
    )


def read_results(spark: SparkSession, path: str) -> DataFrame:
    """The results sheet that every analysis starts from; a missing one is an error that says so."""
    try:
        return spark.read.parquet(path)
    except Exception as error:
        if "PATH_NOT_FOUND" in str(error):
            raise FileNotFoundError(f"no results at {path}: calculate results first") from error
        raise


# ------------------------------------------------------------------ files
def list_files(spark: SparkSession, root: str, pattern: str = "*", recursive: bool = True, done: DataFrame | None = None) -> DataFrame:
    """(path, name, stem, length, modified) of the files under ``root``; without those whose stem is in
    ``done(stem)``.  No file's content is read."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", recursive).load(root)
    name = F.regexp_extract("path", r"([^/]+)$", 1)
    listed = files.select("path", name.alias("name"), F.regexp_replace(name, r"\.[^.]*$", "").alias("stem"), "length", F.col("modificationTime").alias("modified"))
    return listed if done is None else listed.join(done.select("stem").distinct(), "stem", "left_anti")


def read_cells(spark: SparkSession, root: str, schema: str) -> DataFrame:
    """The detection CSV files of a project, one per slice, with the file's stem."""
    rows = spark.read.option("header", True).schema(schema).csv(root)
    return rows.withColumn("file", F.regexp_replace(F.col("_metadata.file_name"), r"\.[^.]*$", ""))


def basename(path: Column) -> Column:
    return F.regexp_extract(path, r"([^/]*)$", 1)


SHAPE_ENDS = ((3, 4), (1, 2), (0, 0))  # characters at the start and end of an image's name that tasks know, by its length
MAX_SHAPES = 20_000


def image_shapes(images: DataFrame) -> tuple[int, set[tuple[int, str, str]]]:
    """Lengths, first and last characters of all names of ``images(_image)``, and how many last ones; of
    fewer characters where there are too many kinds, at last of the lengths alone."""
    named = images.filter(F.col("_image").isNotNull())
    for head, tail in SHAPE_ENDS:
        kinds = named.select(F.length("_image"), F.left("_image", F.lit(head)), F.right("_image", F.lit(tail))).distinct()
        found = (kinds.limit(MAX_SHAPES + 1) if head else kinds).collect()
        if len(found) <= MAX_SHAPES:
            break
    return tail, {tuple(r) for r in found}


def held_images(names: DataFrame, images: DataFrame) -> DataFrame:
    """(file, _image, _end): every part of ``names(file)`` that may be one of ``images(_image)``, and where it ends.

    Only parts of a shape that an image has are sent, so each image in a name is, and little else."""
    tail, shapes = image_shapes(images)
    lengths: dict[str, set[int]] = {}
    for length, first, _ in shapes:
        lengths.setdefault(first, set()).add(length)
    widths = sorted({len(first) for first in lengths})
    schema = pa.schema([("file", pa.string()), ("_image", pa.string()), ("_end", pa.int32())])

    def parts(name: str) -> Iterator[tuple[str, int]]:
        for at in range(len(name) + 1):
            for width in widths:
                first = name[at:at + width]
                for length in lengths.get(first, ()):
                    end = at + length
                    if end <= len(name) and (length or not at) and (length, first, name[max(at, end - tail):end]) in shapes:
                        yield name[at:end], end

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for few in (batch.slice(at, 500) for batch in batches for at in range(0, batch.num_rows, 500)):
            rows = [(name, *part) for name in few.column(0).to_pylist() if name is not None for part in parts(name)]
            yield pa.RecordBatch.from_pylist([dict(zip(schema.names, row)) for row in rows], schema)

    return names.mapInArrow(find, "file string, _image string, _end int")


def match_detection_files(files: DataFrame, slices: DataFrame, mode: str) -> DataFrame:
    """(slice_id, file, candidates): the detection file of each slice, or NULL if none or several fit.

    ``files(name)``; ``slices(slice_id, path)``.  'centroid' wants ``stem_sceneN.csv`` and 'spots' wants
    ``name Detections.txt``.  'qupath' wants the image name, whatever it is made of, in the file name; if several
    files have it, the one that also has the scene number, not touching other digits, behind it."""
    image = basename(F.col("path.filename"))
    wanted = slices.select("slice_id", image.alias("_image"), F.col("path.scene").alias("_scene"))
    names = files.select(F.col("name").alias("file")).distinct()
    if mode in ("centroid", "spots"):
        stem = F.regexp_replace("_image", r"\.[^.]*$", "")
        target = F.concat(stem, F.lit("_scene"), F.coalesce(F.col("_scene").cast("string"), F.lit("None")), F.lit(".csv"))
        target = target if mode == "centroid" else F.concat("_image", F.lit(" Detections.txt"))
        joined = wanted.withColumn("_target", target).join(names, F.col("_target") == F.col("file"), "left")
        return joined.select("slice_id", "file", F.col("file").isNotNull().cast("int").alias("candidates"))
    if mode != "qupath":
        raise ValueError(f"unknown detection files {mode!r}; use one of {sorted(IMPORTERS)}")
    held = held_images(names, wanted).repartition("_image").distinct()
    both = wanted.join(held.hint("merge"), "_image", "left")  # what a file's name holds looks as small as the names
    behind = F.when(F.col("_end") > 0, F.substr("file", F.col("_end"))).otherwise(F.concat(F.lit(" "), "file"))  # from the image's last character
    scene = F.coalesce(F.col("_scene").cast("string"), F.lit("None"))
    scene = F.rlike(behind, F.concat(F.lit(r"(?d)^[\s\S].*(?<!\p{Nd})"), scene, F.lit(r"(?!\p{Nd})")))
    pairs = both.select("slice_id", "file", scene.alias("_fits")).repartition("slice_id").groupBy("slice_id", "file").agg(F.max("_fits").alias("_fits"))
    one = F.when(F.col("_fits"), F.col("file"))
    found = pairs.groupBy("slice_id").agg(
        F.count("file").cast("int").alias("candidates"), F.max("file").alias("_only"), F.count(one).alias("_n"), F.max(one).alias("_one"),
    )
    file = F.when(F.col("candidates") == 1, F.col("_only")).when((F.col("candidates") > 1) & (F.col("_n") == 1), F.col("_one"))
    return found.select("slice_id", file.alias("file"), "candidates")


# ------------------------------------------------------------------ detections
def centroid_cells(rows: DataFrame, slices: DataFrame) -> DataFrame:
    """``rows(slice_id, centroid-0, centroid-1, LABEL-*)`` to cells at fractions of the image.

    If any number of a slice's file, labels included, exceeds 1, the file is in pixels."""
    labels = label_columns(rows.columns)
    largest = F.greatest(col("centroid-0"), col("centroid-1"), *[col(c).cast("double") for c in labels])
    pixels = rows.groupBy("slice_id").agg((F.max(largest) > 1).alias("_pixels"))
    sized = rows.join(pixels, "slice_id").join(slices.select("slice_id", F.col("image_height").alias("_h"), F.col("image_width").alias("_w")), "slice_id")
    scaled = lambda c, size: F.when(F.col("_pixels"), col(c) / F.col(size)).otherwise(col(c))
    return sized.select("slice_id", scaled("centroid-1", "_w").alias("x"), scaled("centroid-0", "_h").alias("y"), *[col(c) for c in labels])


def _micron_cells(rows: DataFrame, slices: DataFrame) -> DataFrame:
    """x and y as fractions of the image's size in micrometres; one at or beyond the edge fails the job."""
    sized = rows.join(
        slices.select("slice_id", (F.col("image_width") * F.col("pixel_width")).alias("_w"), (F.col("image_height") * F.col("pixel_height")).alias("_h")), "slice_id"
    )
    inside = lambda c: F.when(c >= 1, F.raise_error("a detection lies outside its image").cast("double")).otherwise(c)
    x, y = null_if_nan(col("Centroid X µm") / F.col("_w")), null_if_nan(col("Centroid Y µm") / F.col("_h"))
    return sized.withColumns({"x": inside(x), "y": inside(y)})


def qupath_cells(rows: DataFrame, slices: DataFrame, thresholds: Sequence[float]) -> DataFrame:
    """Exported detections to cells: ``LABEL-Channel-i`` is more spots than the i-th threshold, unless that
    is negative.  Rows without a position are dropped; a Class column, if any, must be positive or negative."""
    kept = class_in(rows) if "Class" in rows.columns else rows
    cells = drop_missing_points(_micron_cells(kept, slices))
    names = []
    for i, threshold in enumerate(thresholds, 1):
        if threshold >= 0:
            cells = threshold_label(cells, f"Subcellular: Channel {i}: Num single spots", threshold, f"Channel-{i}")
            names.append(f"{LABEL_PREFIX}Channel-{i}")
    return cells.select("slice_id", "x", "y", *[F.coalesce(col(n), F.lit(False)).alias(n) for n in names])


# Channel numbers of the four spot labels.
SPOT_CHANNELS = {"cFos": 5, "Drd1": 2, "Drd2": 3, "Oxtr": 4}


def spots_cells(rows: DataFrame, slices: DataFrame, thresholds: dict[str, float]) -> DataFrame:
    """The same with four fixed labels and a Class column that must be there."""
    cells = _micron_cells(class_in(rows), slices)
    for name, channel in SPOT_CHANNELS.items():
        spots = f"Subcellular: Channel {channel}: Num single spots"
        cells = cells.withColumn(LABEL_PREFIX + name, F.coalesce(col(spots) > number(thresholds[name]), F.lit(False)))
    return drop_missing_points(cells.select("slice_id", "x", "y", *[col(LABEL_PREFIX + n) for n in SPOT_CHANNELS]), any_column=True)


Importer = Callable[..., DataFrame]
IMPORTERS: dict[str, Importer] = {"centroid": centroid_cells, "qupath": qupath_cells, "spots": spots_cells}


def import_cells(kind: str, rows: DataFrame, files: DataFrame, slices: DataFrame, **options) -> tuple[DataFrame, DataFrame]:
    """Cells of all valid slices and the slices left without a file.

    ``rows(file, ...)`` are the parsed lines of all detection files and ``files(name)`` their names."""
    if kind not in IMPORTERS:
        raise ValueError(f"unknown importer {kind!r}; use one of {sorted(IMPORTERS)}")
    valid = slices.filter(~F.col("ignore"))
    matched = match_detection_files(files, valid, kind)
    missing = matched.filter(F.col("file").isNull()).select("slice_id", "candidates")
    owned = rows.join(matched.filter(F.col("file").isNotNull()).select("slice_id", "file"), "file").drop("file")
    return IMPORTERS[kind](owned, valid, **options), missing


# ------------------------------------------------------------------ atlas
def read_atlas(voxels: DataFrame, exclude: Sequence[int] = EXCLUDED_STRUCTURES) -> DataFrame:
    """``voxels(z, y, x, struct_id, ref)``: excluded structures are 0, and the reference is divided by its
    maximum and 0 where there is no structure."""
    top = voxels.agg(F.max("ref")).scalar()
    struct = F.when(F.col("struct_id").isin(*exclude), F.lit(0)).otherwise(F.col("struct_id"))
    return voxels.withColumn("struct_id", struct).withColumn(
        "ref", F.when(F.col("struct_id") == 0, number(0)).otherwise(F.try_divide(F.col("ref").cast("double"), top.cast("double")))
    )
