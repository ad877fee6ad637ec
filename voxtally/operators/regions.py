"""From cells to regions: structure lookup, direct counts, tree roll-up, areas and densities.

An ancestor's total is the sum of the *direct* counts of its descendants and itself.  Counts and
areas are unioned as measures of one table, so one grouping replaces a full outer join, and direct
counts are aggregated before the roll-up multiplies rows by the tree depth."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from voxtally.functions.columns import (
    COLABEL_PREFIX,
    LABEL_PREFIX,
    col,
    flag_columns,
    half_even,
    label_columns,
    number,
)
from voxtally.operators.cells import with_co_labels

NOT_NORMALISED = " (not normalized)"
ROWS_PER_TASK = 500_000  # cells or annotated pixels that one task counts


# ------------------------------------------------------------------ structure tree
def closure(structures: DataFrame) -> DataFrame:
    """(id, ancestor_id) for every structure and each of its ancestors and itself."""
    return structures.select("id", F.explode("path").alias("ancestor_id"))


def ancestors(structures: DataFrame) -> DataFrame:
    """(id, ancestor_id, distance): parents up to the root, nearest first, self excluded."""
    return structures.select(
        "id", F.size("path").alias("_n"), F.posexplode("path").alias("_k", "ancestor_id")
    ).filter(F.col("_k") < F.col("_n") - 1).select(
        "id", "ancestor_id", (F.col("_n") - 1 - F.col("_k")).alias("distance")
    )


def tree_paths(spark, edges: DataFrame) -> DataFrame:
    """``path`` from (id, parent_id) edges, by a recursive query."""
    return spark.sql(
        """
        WITH RECURSIVE up(id, ancestor_id, depth) AS (
          SELECT id, id, 0 FROM {edges}
          UNION ALL
          SELECT u.id, e.parent_id, u.depth + 1
          FROM up u JOIN {edges} e ON e.id = u.ancestor_id WHERE e.parent_id IS NOT NULL)
        SELECT id, transform(reverse(array_sort(collect_list(struct(depth, ancestor_id)))),
                             s -> s.ancestor_id) AS path
        FROM up GROUP BY id
        """,
        edges=edges,
    )


def structure_facts(structures: DataFrame, gray_matter: str = "GM") -> DataFrame:
    """acronym, name, is_parent_structure and is_gray_matter (NULL if the tree has no such node;
    the gray-matter node itself is not its own descendant)."""
    parents = structures.filter(F.col("parent_id").isNotNull()).select(F.col("parent_id").alias("id")).distinct()
    gm = structures.filter(F.col("acronym") == gray_matter).agg(F.min("id").alias("_gm"))
    gray = F.when(F.col("_gm").isNotNull(), F.array_contains("path", F.col("_gm")) & (F.col("id") != F.col("_gm")))
    return (
        structures.join(parents.withColumn("_p", F.lit(True)), "id", "left")
        .withColumn("_gm", gm.scalar())
        .select(
            "id", "acronym", "name",
            F.col("_p").isNotNull().alias("is_parent_structure"),
            gray.alias("is_gray_matter"),
        )
    )


def is_descendant(structures: DataFrame, ancestor: str) -> DataFrame:
    """Every structure with a flag: does it lie strictly under the named structure."""
    return structure_facts(structures, ancestor).select(
        "id", "acronym", F.col("is_gray_matter").alias("is_descendant")
    )


def branch_leaves(structures: DataFrame, acronyms: Sequence[str]) -> DataFrame:
    """Each named structure with itself and the leaves below it."""
    facts = structure_facts(structures)
    named = structures.filter(F.col("acronym").isin(*acronyms)).select(
        F.col("id").alias("ancestor_id"), F.col("acronym").alias("branch")
    )
    return (
        closure(structures)
        .join(named, "ancestor_id")
        .join(facts.select("id", "is_parent_structure"), "id")
        .filter(~F.col("is_parent_structure") | (F.col("id") == F.col("ancestor_id")))
        .select("branch", "id")
    )


def acronym_to_id(acronyms: DataFrame, structures: DataFrame) -> DataFrame:
    """Unknown acronyms are skipped; see ``unknown_acronyms`` for the report."""
    return acronyms.join(structures.select("acronym", "id"), "acronym")


def unknown_acronyms(acronyms: DataFrame, structures: DataFrame) -> DataFrame:
    return acronyms.join(structures.select("acronym"), "acronym", "left_anti")


def struct_colors(cells: DataFrame, structures: DataFrame) -> DataFrame:
    """RGBA in 0..1 per structure id of the input; id 0 is opaque black."""
    ids = cells.select("struct_id").distinct()
    rgba = F.concat(F.col("rgb"), F.array(F.lit(255)))
    return ids.join(structures.select(F.col("id").alias("struct_id"), "rgb"), "struct_id", "left").select(
        "struct_id",
        F.transform(
            F.when(F.col("struct_id") == 0, F.array(*[F.lit(v) for v in (0, 0, 0, 255)])).otherwise(rgba),
            lambda v: v.cast("double") / number(255),
        ).alias("rgba"),
    )


# ------------------------------------------------------------------ lookups
def struct_at_voxel(cells: DataFrame, voxels: DataFrame) -> DataFrame:
    """Structure at the half-even rounded (z, y, x); 0 outside the volume."""
    keys = ["_z", "_y", "_x"]
    grid = voxels.select(
        F.col("z").cast("long").alias("_z"), F.col("y").cast("long").alias("_y"),
        F.col("x").cast("long").alias("_x"), F.col("struct_id").alias("_s"),
    )
    located = cells
    for axis in ("z", "y", "x"):
        located = located.withColumn(f"_{axis}", half_even(F.col(axis)))
    return (
        located.join(grid, keys, "left")
        .withColumn("struct_id", F.coalesce(F.col("_s"), F.lit(0)))
        .drop("_s", *keys)
    )


def struct_at_slice_pixel(cells: DataFrame, annotation: DataFrame) -> DataFrame:
    """Structure of the registered slice at the rounded (x, y); unmatched is 0."""
    keys = ["slice_id", "_y", "_x"]
    grid = annotation.select(
        "slice_id", F.col("y").cast("long").alias("_y"), F.col("x").cast("long").alias("_x"),
        F.col("struct_id").alias("_s"),
    )
    return (
        cells.withColumn("_y", half_even(F.col("y"))).withColumn("_x", half_even(F.col("x")))
        .join(grid, keys, "left")
        .withColumn("struct_id", F.coalesce(F.col("_s"), F.lit(0)))
        .drop("_s", "_y", "_x")
    )


def slices_with_structures(annotation: DataFrame, ids: Sequence[int]) -> DataFrame:
    return annotation.filter(F.col("struct_id").isin(*ids)).select("slice_id").distinct()


def paint(voxels: DataFrame, stats: DataFrame, structures: DataFrame, value: str) -> DataFrame:
    """Write a per-acronym statistic onto the voxels of its structure, 0 elsewhere."""
    by_id = stats.join(structures.select("acronym", F.col("id").alias("struct_id")), "acronym").select(
        "struct_id", F.col(value).alias("_v")
    )
    return voxels.join(by_id, "struct_id", "left").select(
        "z", "y", "x", "struct_id", F.coalesce(F.col("_v"), number(0)).alias("value")
    )


# ------------------------------------------------------------------ counts and areas
def tasks_for(rows: DataFrame) -> int:
    """Tasks to count ``rows`` in: ``spark.sql.shuffle.partitions``, and more for a larger table, as a task
    that holds very many groups spills them.  The rows are gone through once more to be counted."""
    return max(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-rows.count() // ROWS_PER_TASK))


def together(rows: DataFrame, keys: Sequence[str], tasks: int | None = None) -> DataFrame:
    """Rows of one first key in one task.  Counting per key and structure before the shuffle would hold
    nearly every row of an input split in memory and leave little less to shuffle.  The number of tasks
    is given, as tasks merged by their compressed bytes would hold many more rows."""
    if not keys:
        return rows
    return rows.repartition(tasks or int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), keys[0])


def cell_counts(cells: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Per (keys, struct_id): non-null cells and the true flags of every label column."""
    return _counted(together(cells, keys, tasks_for(cells) if keys else None), keys)


def _counted(cells: DataFrame, keys: Sequence[str]) -> DataFrame:
    return cells.groupBy(*keys, "struct_id").agg(
        F.count("x").alias("cells"),
        *[F.count_if(col(c)).alias(c) for c in flag_columns(cells.columns)],
    )


def region_areas(annotation: DataFrame, pixel_area_um2: float, keys: Sequence[str] = ()) -> DataFrame:
    """Area per structure; pixels off the tissue mask belong to id 0."""
    masked = F.when(F.col("on_tissue"), F.col("struct_id")).otherwise(F.lit(0))
    return (
        together(annotation, keys, tasks_for(annotation) if keys else None).groupBy(*keys, masked.alias("struct_id"))
        .agg((F.count(F.lit(1)) * number(pixel_area_um2)).alias("area"))
    )


def merge_areas(areas: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Key-wise sum of slice areas at a coarser grain."""
    return areas.groupBy(*keys, "struct_id").agg(F.sum("area").alias("area"))


def rollup(direct: DataFrame, structures: DataFrame, keys: Sequence[str], measures: Sequence[str]) -> DataFrame:
    """Sum of direct measures over descendants-or-self.  Ids outside the tree (background) stay
    as they are: they have no ancestors."""
    return _rolled(direct, structures, keys, measures)


def _rolled(direct: DataFrame, structures: DataFrame, keys: Sequence[str], measures: Sequence[str]) -> DataFrame:
    """``rollup`` of a table that lies by its last key already."""
    up = closure(structures).withColumnRenamed("id", "struct_id")
    return (
        direct.join(up, "struct_id", "left")
        .withColumn("struct_id", F.coalesce(F.col("ancestor_id"), F.col("struct_id")))
        .groupBy(*keys, "struct_id")
        .agg(*[F.sum(col(m)).alias(m) for m in measures])
    )


def rollup_counts(counts: DataFrame, structures: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    measures = [c for c in counts.columns if c not in (*keys, "struct_id")]
    return rollup(counts, structures, keys, measures)


def rollup_areas(areas: DataFrame, structures: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    return rollup(areas, structures, keys, ["area"])


def output_name(column: str) -> str:
    """LABEL-a becomes a+, COLABEL-x becomes x."""
    if column.startswith(LABEL_PREFIX):
        return column[len(LABEL_PREFIX):] + "+"
    if column.startswith(COLABEL_PREFIX):
        return column[len(COLABEL_PREFIX):]
    return column


def format_columns(counts: DataFrame) -> DataFrame:
    return counts.withColumnsRenamed({c: output_name(c) for c in counts.columns})


def density(counts: Column, area: Column, unit_side: float) -> Column:
    """Count per unit square of the given side; NULL on zero area."""
    return F.try_divide(counts.cast("double"), area) * number(unit_side * unit_side)


def min_region_area(areas: DataFrame, side: float | None, area: str = "area") -> DataFrame:
    """Keep regions of at least side x side."""
    return areas if side is None else areas.filter(F.col(area) >= number(side * side))


def attach_structure(table: DataFrame, structures: DataFrame) -> DataFrame:
    """Name columns by structure id.  Ids outside the tree are dropped."""
    return table.join(structure_facts(structures).withColumnRenamed("id", "struct_id"), "struct_id")


def in_tree(table: DataFrame, structures: DataFrame) -> DataFrame:
    return table.join(structures.select(F.col("id").alias("struct_id")), "struct_id", "left_semi")


def _size_filtered_counts(
    cells: DataFrame, min_size: float | None, max_size: float | None
) -> DataFrame:
    """Direct counts per (slice, structure) after the size filter.

    A slice with any NULL area in micrometres is filtered on pixels.  Both versions are counted in
    one pass over ``cells`` spread by slice, and the slice picks its version from at most one row
    per structure, so no row-level window or join back is needed."""
    flags = flag_columns(cells.columns)
    has_um, has_px = "area_um" in cells.columns, "area_pixels" in cells.columns
    if not (min_size or max_size) or not (has_um or has_px):
        return _counted(cells, ["slice_id"])

    def keep(size: Column) -> Column:
        ok = size.isNotNull()
        if min_size:
            ok = ok & (size >= number(min_size))
        if max_size:
            ok = ok & (size <= number(max_size))
        return ok

    variants = {}
    if has_um:
        variants["um"] = keep(F.col("area_um"))
    if has_px:
        variants["px"] = keep(F.col("area_pixels"))
    aggs = []
    for tag, ok in variants.items():
        aggs.append(F.count_if(ok & F.col("x").isNotNull()).alias(f"cells|{tag}"))
        aggs += [F.count_if(ok & col(c)).alias(f"{c}|{tag}") for c in flags]
        aggs.append(F.count_if(ok).alias(f"_rows|{tag}"))
    missing = F.max(F.col("area_um").isNull()) if has_um else F.lit(True)
    both = cells.groupBy("slice_id", "struct_id").agg(missing.alias("_missing"), *aggs)
    per_slice = both.groupBy("slice_id").agg(F.max("_missing").alias("_pixels"))
    picked = both.drop("_missing").join(per_slice, "slice_id")

    def pick(name: str) -> Column:
        if len(variants) == 1:
            return col(f"{name}|{next(iter(variants))}")
        return F.when(F.col("_pixels"), col(f"{name}|px")).otherwise(col(f"{name}|um"))

    return picked.filter(pick("_rows") > 0).select(
        "slice_id", "struct_id", pick("cells").alias("cells"), *[pick(c).alias(c) for c in flags]
    )


def summarise(
    cells: DataFrame,
    slice_areas: DataFrame,
    slices: DataFrame,
    subjects: DataFrame,
    structures: DataFrame,
    row_per: str = "subject",
    min_area_side: float | None = None,
    per_area_side: float | None = None,
    min_cell_size: float | None = None,
    max_cell_size: float | None = None,
    slice_columns: Sequence[str] = (),
) -> DataFrame:
    """Cells per structure for all subjects (or all slices) in one job.

    ``cells(slice_id, struct_id, x, LABEL-*, area_*)``, ``slice_areas(slice_id, struct_id, area)``,
    valid ``slices(slice_id, animal_id, ...)`` and ``subjects(animal_id, <condition columns>)``.
    Every structure with a count or an area, and each of its ancestors, gives a row."""
    if row_per not in ("subject", "slice"):
        raise ValueError("row_per must be 'subject' or 'slice'")
    grain = ["animal_id"] if row_per == "subject" else ["animal_id", "slice_id"]
    tasks = tasks_for(cells)
    # rows are spread before the flags of combinations make them wide; of x it only counts that it is there
    spread = together(cells.withColumn("x", F.when(F.col("x").isNotNull(), F.lit(True))), ["slice_id"], tasks)
    counts = _size_filtered_counts(with_co_labels(spread), min_cell_size, max_cell_size)
    measures = ["cells", *flag_columns(counts.columns)]
    owners = slices.select("slice_id", "animal_id")  # joined to both parts, which lie by slice already
    detected = owners.join(together(cells.select("slice_id"), ["slice_id"], tasks), "slice_id", "left_semi")
    areas = slice_areas.select(
        "slice_id", "struct_id", "area", *[F.lit(0).cast("long").alias(m) for m in measures]
    ).join(detected, "slice_id")
    parts = counts.withColumn("area", number(0)).join(owners, "slice_id").unionByName(areas)
    direct = (
        together(parts, grain[-1:], tasks)
        .groupBy(*grain, "struct_id")
        .agg(*[F.sum(col(m)).alias(m) for m in (*measures, "area")])
    )
    total = _rolled(direct, structures, grain, [*measures, "area"])
    total = min_region_area(total, min_area_side)
    named = attach_structure(total, structures).join(subjects, "animal_id")
    conditions = [c for c in subjects.columns if c != "animal_id"]
    if per_area_side:
        values = [density(col(m), F.col("area"), per_area_side).alias(output_name(m)) for m in measures]
        values += [col(m).alias(output_name(m) + NOT_NORMALISED) for m in measures]
    else:
        values = [col(m).alias(output_name(m)) for m in measures]
    extra = []
    if row_per == "slice":
        extra = ["slice_id"]
        if slice_columns:
            named = named.join(slices.select("slice_id", *slice_columns), "slice_id")
            extra += list(slice_columns)
    return named.select(
        *conditions, "animal_id", "acronym", "name", "is_parent_structure", "is_gray_matter",
        F.col("area").cast("long").alias("total_area_um2"), *values, *extra,
    )


def region_summary(
    cells: DataFrame,
    areas: DataFrame,
    structures: DataFrame,
    keys: Sequence[str] = (),
    min_area_side: float | None = None,
    per_area_side: float | None = None,
) -> DataFrame:
    """The same summary for cells and areas already at one grain ``keys`` (no slice tables)."""
    counts = cell_counts(with_co_labels(cells), keys)
    measures = ["cells", *flag_columns(counts.columns)]
    padded = areas.select(*keys, "struct_id", "area", *[F.lit(0).cast("long").alias(m) for m in measures])
    direct = counts.withColumn("area", number(0)).unionByName(padded)
    total = min_region_area(rollup(direct, structures, keys, [*measures, "area"]), min_area_side)
    named = attach_structure(total, structures)
    if per_area_side:
        values = [density(col(m), F.col("area"), per_area_side).alias(output_name(m)) for m in measures]
        values += [col(m).alias(output_name(m) + NOT_NORMALISED) for m in measures]
    else:
        values = [col(m).alias(output_name(m)) for m in measures]
    return named.select(
        *keys, "acronym", "name", "is_parent_structure", "is_gray_matter",
        F.col("area").cast("long").alias("total_area_um2"), *values,
    )


def densities(counts: DataFrame, areas: DataFrame, keys: Sequence[str], unit_side: float) -> DataFrame:
    """Counts joined to areas by structure, per unit square."""
    measures = [c for c in counts.columns if c not in (*keys, "struct_id")]
    joined = counts.join(areas, [*keys, "struct_id"])
    return joined.select(
        *keys, "struct_id", "area", *[density(col(m), F.col("area"), unit_side).alias(m) for m in measures]
    )


def count_and_density_sheets(*args, per_area_side: float, **kwargs) -> tuple[DataFrame, DataFrame]:
    """Raw and per-area versions of one summary: two projections of it, both from the exact area."""
    both = summarise(*args, per_area_side=per_area_side, **kwargs)
    measures = [c.removesuffix(NOT_NORMALISED) for c in both.columns if c.endswith(NOT_NORMALISED)]
    dense = [c for c in both.columns if not c.endswith(NOT_NORMALISED)]
    raw = both.select(*[col(c + NOT_NORMALISED).alias(c) if c in measures else col(c) for c in dense])
    return raw, both.select(*[col(c) for c in dense])
