"""Slice bookkeeping: which slices count, how they are spaced, named and located."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from voxtally.functions.columns import half_even, natural_key, number
from voxtally.operators.ordering import with_rank


def valid_slices(slices: DataFrame) -> DataFrame:
    """Slices not marked as ignored; the original position column is untouched."""
    return slices.filter(~F.col("ignore"))


def where(slices: DataFrame, predicate: Column | None) -> DataFrame:
    """Optional user predicate; only an exact FALSE removes a slice."""
    return slices if predicate is None else slices.filter(F.coalesce(predicate, F.lit(True)))


def with_detections(slices: DataFrame, cells: DataFrame) -> DataFrame:
    return slices.join(cells.select("slice_id"), "slice_id", "left_semi")


def missing_detections(slices: DataFrame, cells: DataFrame) -> DataFrame:
    """The report behind the 'please run cell detection' warning."""
    return slices.join(cells.select("slice_id"), "slice_id", "left_anti")


def select_slices(
    slices: DataFrame, mode: str, animal_id=None, slice_id=None
) -> DataFrame:
    """``mode`` is 'slice', 'subject' or 'all'."""
    if mode == "slice":
        return slices.filter(F.col("slice_id") == F.lit(slice_id))
    if mode == "subject":
        return slices.filter(F.col("animal_id") == F.lit(animal_id))
    if mode == "all":
        return slices
    raise ValueError(f"unknown slice selection {mode!r}")


def first_n_subjects(subjects: DataFrame, n: int, order: str = "animal_id") -> DataFrame:
    """The n first subjects of an already filtered table."""
    return subjects.orderBy(order).limit(n)


def subjects_of(slices: DataFrame, subjects: DataFrame, strict: bool = False) -> DataFrame:
    """The owner of each slice.  ``strict`` makes a slice without owner fail the job."""
    if not strict:
        return slices.join(subjects, "animal_id")
    owned = slices.join(subjects.withColumn("_owner", F.lit(1)), "animal_id", "left")
    return owned.filter(
        F.when(
            F.col("_owner").isNull(),
            F.raise_error(F.concat(F.lit("slice without subject: "), F.col("slice_id").cast("string"))).cast("boolean"),
        ).otherwise(F.lit(True))
    ).drop("_owner")


def count_valid_images(slices: DataFrame) -> DataFrame:
    return valid_slices(slices).agg(F.count(F.lit(1)).alias("n_images"))


def evenly_space_ap(slices: DataFrame, subjects: DataFrame | None = None) -> DataFrame:
    """Linear AP between the first and last valid slice of each subject (nested ``params``).

    Subjects with at most two valid slices are unchanged.  A subject whose first or last valid
    slice lacks atlas parameters fails the job.  Missing parameters are created with the
    subject's rotation (``subjects`` with columns animal_id, rot_horizontal, rot_sagittal)."""
    valid = valid_slices(slices)
    ranked = with_rank(
        valid, ["animal_id"], F.col("pos"), [F.col("pos")], name="_i"
    )
    ends = valid.groupBy("animal_id").agg(
        F.count(F.lit(1)).alias("_n"),
        F.min_by(F.col("params.atlas.ap"), F.col("pos")).alias("_first"),
        F.max_by(F.col("params.atlas.ap"), F.col("pos")).alias("_last"),
    )
    spaced = ranked.join(ends, "animal_id")
    if subjects is not None:
        spaced = spaced.join(
            subjects.select(
                "animal_id",
                F.col("rot_horizontal").alias("_h"),
                F.col("rot_sagittal").alias("_s"),
            ),
            "animal_id",
            "left",
        )
    else:
        spaced = spaced.withColumn("_h", number(0)).withColumn("_s", number(0))
    new_ap = F.col("_first") + (F.col("_i") - 1) * (F.col("_last") - F.col("_first")) / F.greatest(
        F.col("_n") - 1, F.lit(1)
    )
    checked = F.when(
        F.col("_first").isNull() | F.col("_last").isNull(),
        F.raise_error("first and last slices must have atlas parameters").cast("double"),
    ).otherwise(new_ap)
    atlas = F.col("params.atlas")
    fresh = F.struct(
        checked.alias("ap"),
        number(0).alias("rot_frontal"),
        F.coalesce(F.col("_h"), number(0)).alias("rot_horizontal"),
        F.coalesce(F.col("_s"), number(0)).alias("rot_sagittal"),
    )
    moved = F.when(atlas.isNull(), fresh).otherwise(atlas.withField("ap", checked))
    out = spaced.withColumn(
        "params",
        F.when(F.col("_n") <= 2, F.col("params")).otherwise(F.col("params").withField("atlas", moved)),
    ).select(*slices.columns)
    return out.unionByName(slices.filter(F.col("ignore")))


def slice_string(path: Column) -> Column:
    """'file [Scene #s Channel #c]' with only the parts that are set."""
    suffix = F.concat_ws(
        " ",
        F.when(path["scene"].isNotNull(), F.concat(F.lit("Scene #"), path["scene"].cast("string"))),
        F.when(path["channel"].isNotNull(), F.concat(F.lit("Channel #"), path["channel"].cast("string"))),
    )
    return F.when(suffix == "", path["filename"]).otherwise(
        F.concat(path["filename"], F.lit(" ["), suffix, F.lit("]"))
    )


def _basename(path: Column) -> Column:
    return F.regexp_extract(path, r"([^/\\]*)$", 1)


def _stem(path: Column) -> Column:
    return F.regexp_replace(_basename(path), r"(?<=.)\.[^.]*$", "")


def thumbnail_name(path: Column, channel) -> Column:
    suffix = F.concat_ws(
        " ",
        F.when(path["scene"].isNotNull(), F.concat(F.lit("Scene #"), path["scene"].cast("string"))),
        F.lit(f"Channel #{channel}"),
    )
    return F.concat(_stem(path["filename"]), F.lit(" ["), suffix, F.lit("].jpg"))


def detections_name(path: Column) -> Column:
    return F.concat(_basename(slice_string(path)), F.lit(".csv"))


def path_strings(slices: DataFrame, channel=0) -> DataFrame:
    path = F.col("path")
    return slices.select(
        "slice_id",
        slice_string(path).alias("slice"),
        thumbnail_name(path, channel).alias("thumbnail"),
        detections_name(path).alias("detections"),
    )


def slice_locations(
    slices: DataFrame, subjects: DataFrame, condition_names: Sequence[str], ap_resolution_um: float
) -> DataFrame:
    """Where each slice lies: AP in micrometres and three rotations, NULL when unregistered."""
    atlas = F.col("params.atlas")
    return slices.join(subjects.select("animal_id", "conditions"), "animal_id").select(
        "animal_id",
        *[F.element_at("conditions", name).alias(name) for name in condition_names],
        slice_string(F.col("path")).alias("slice"),
        half_even(atlas["ap"] * number(ap_resolution_um)).alias("ap_um"),
        atlas["rot_frontal"].alias("rot_frontal"),
        atlas["rot_horizontal"].alias("rot_horizontal"),
        atlas["rot_sagittal"].alias("rot_sagittal"),
    )


def set_rotation(slices: DataFrame, horizontal: float, sagittal: float) -> DataFrame:
    """New rotation on the slices that already have atlas parameters."""
    atlas = F.col("params.atlas")
    turned = atlas.withField("rot_horizontal", number(horizontal)).withField("rot_sagittal", number(sagittal))
    return slices.withColumn(
        "params", F.when(atlas.isNull(), F.col("params")).otherwise(F.col("params").withField("atlas", turned))
    )


def set_subject_rotation(subjects: DataFrame, horizontal: float, sagittal: float) -> DataFrame:
    return subjects.withColumn(
        "rotation", F.struct(number(horizontal).alias("h"), number(sagittal).alias("s"))
    )


def move_images_root(
    slices: DataFrame, files: DataFrame, new_root: str, old_root: str | None = None
) -> DataFrame:
    """Re-root image paths; a path whose new target is not in ``files(path)`` keeps the old one."""
    name = F.col("path.filename")
    root = new_root.rstrip("/") + "/"
    if old_root is None:
        target = F.concat(F.lit(root), _basename(name))
    else:
        prefix = old_root.rstrip("/") + "/"
        target = F.when(
            name.startswith(prefix), F.concat(F.lit(root), F.substr(name, F.lit(len(prefix) + 1)))
        )
    known = files.select(F.col("path").alias("_target")).distinct().withColumn("_known", F.lit(True))
    return (
        slices.withColumn("_target", target)
        .join(known, "_target", "left")
        .withColumn(
            "path",
            F.when(F.col("_known"), F.col("path").withField("filename", F.col("_target"))).otherwise(F.col("path")),
        )
        .select(*slices.columns)
    )


PARAM_STEPS = ("atlas", "affine", "tps")


def missing_params(slices: DataFrame, steps: Sequence[str] = PARAM_STEPS) -> DataFrame:
    """Valid slices with a registration step missing, and the first such step."""
    first = F.coalesce(*[F.when(F.col(f"params.{s}").isNull(), F.lit(s)) for s in steps])
    return valid_slices(slices).withColumn("missing", first).filter(F.col("missing").isNotNull())


def next_missing_param(slices: DataFrame, steps: Sequence[str] = PARAM_STEPS) -> DataFrame:
    return (
        missing_params(slices, steps)
        .select("animal_id", "slice_id", "pos", "missing")
        .orderBy("animal_id", "pos", "slice_id")
        .limit(1)
    )


def can_calculate_results(slices: DataFrame, steps: Sequence[str] = PARAM_STEPS) -> DataFrame:
    """One row, true when every valid slice has every registration step."""
    return missing_params(slices, steps).agg((F.count(F.lit(1)) == 0).alias("ready"))


def can_calculate_contrast(
    slices: DataFrame, subjects: DataFrame, condition: str, steps: Sequence[str] = PARAM_STEPS
) -> DataFrame:
    """One row: parameters complete, every subject has the condition, two or more values."""
    value = F.element_at("conditions", condition)
    checks = subjects.agg(
        F.coalesce(F.bool_and(value.isNotNull()), F.lit(False)).alias("all_have_condition"),
        F.count_distinct(value).alias("n_values"),
    )
    ready = can_calculate_results(slices, steps).scalar()
    return checks.withColumn("ready", ready).select(
        (F.col("ready") & F.col("all_have_condition") & (F.col("n_values") >= 2)).alias("ready"),
        F.col("ready").alias("params_complete"),
        "all_have_condition",
        "n_values",
    )


def possible_contrasts(subjects: DataFrame, condition: str = "condition") -> DataFrame:
    """Sorted unordered pairs of condition values.  Works on the distinct values only."""
    values = subjects.filter(F.col(condition).isNotNull()).select(condition).distinct()
    ordered = values.agg(F.array_sort(F.collect_set(condition)).alias("v"))
    first = ordered.select("v", F.posexplode("v").alias("i", "a"))
    return first.select(
        "a", F.explode(F.slice("v", F.col("i") + 2, F.size("v"))).alias("b")
    )


def natural_sort(names: DataFrame, column: str) -> DataFrame:
    """Adds the sort key and orders by it."""
    return names.withColumn("sort_key", natural_key(F.col(column))).orderBy("sort_key", column)


def grid_layout(images: DataFrame) -> DataFrame:
    """Positions of images laid out in one row per subject, ordered by (subject, ap, image_id).

    x is the running width inside the subject.  y grows at each subject change by the largest
    height met so far in the whole grid, as the reference layout does."""
    ranked = with_rank(
        images,
        ["subject"],
        F.col("ap"),
        [F.col("ap"), F.col("image_id")],
        name="_i",
    )
    row = Window.partitionBy("subject").orderBy("_i").rowsBetween(Window.unboundedPreceding, -1)
    placed = ranked.withColumn("grid_x", F.coalesce(F.sum("width").over(row), F.lit(0)))
    heights = images.groupBy("subject").agg(F.max("height").alias("_h"))
    rows = with_subject_offsets(heights)
    return placed.join(rows, "subject").select(
        "subject", "image_id", "grid_x", F.col("_y").alias("grid_y"), "width", "height"
    )


def _order_key(df: DataFrame, column: str) -> Column:
    """A number that orders like the column as far as it goes: a string's first seven bytes."""
    if dict(df.dtypes)[column] != "string":
        return F.col(column)
    head = F.rpad(F.hex(F.substring(F.col(column).cast("binary"), 1, 7)), 14, "0")
    return F.conv(head, 16, 10).cast("long")


def with_subject_offsets(heights: DataFrame) -> DataFrame:
    """Row offset of each subject: sum over the earlier subjects of the running maximum height.

    The running maximum over an unbounded list of subjects is a two-level scan: subjects are cut
    into ranges, scanned inside each range, and the ranges joined by their entry maximum."""
    heights = heights.withColumn("_key", _order_key(heights, "subject"))
    ranges = 256
    cuts = F.array(*[F.lit(i / ranges) for i in range(1, ranges)])
    bounds = heights.agg(F.array_distinct(F.percentile_approx("_key", cuts, F.lit(20_000))).alias("_b"))
    parted = heights.withColumn("_b", bounds.scalar()).withColumn(
        "_range", F.size(F.filter("_b", lambda b: b < F.col("_key")))
    ).drop("_b")
    before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    entry = (
        parted.groupBy("_range").agg(F.max("_h").alias("_m"))
        .select("_range", F.coalesce(F.max("_m").over(before), F.lit(0)).alias("_entry"))
    )
    inner = Window.partitionBy("_range").orderBy("subject").rowsBetween(Window.unboundedPreceding, 0)
    running = parted.join(entry, "_range").withColumn(
        "_run", F.greatest(F.max("_h").over(inner), F.col("_entry"))
    )
    local = Window.partitionBy("_range").orderBy("subject").rowsBetween(Window.unboundedPreceding, -1)
    sums = running.withColumn("_local", F.coalesce(F.sum("_run").over(local), F.lit(0)))
    totals = (
        running.groupBy("_range").agg(F.sum("_run").alias("_t"))
        .select("_range", F.coalesce(F.sum("_t").over(before), F.lit(0)).alias("_offset"))
    )
    return sums.join(totals, "_range").select("subject", (F.col("_local") + F.col("_offset")).alias("_y"))
