"""Queries over the contents of project and detection files, written out from the given tables."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from voxtally.functions.columns import number
from voxtally.plans import project as P
from voxtally.plans.registry import R, STRUCTURES, query, rounded
from voxtally.session import ensure_checkpoint_dir
from voxtally.sources import readers, writers
from voxtally.streaming.counts import keep_counts, latest_counts, stream_region_counts

IMAGE_HEIGHT, IMAGE_WIDTH, PIXEL = 480, 640, 2.0


def sized_slices(spark, sf):
    return P.slice_documents(spark, sf).withColumns({
        "image_height": F.lit(IMAGE_HEIGHT), "image_width": F.lit(IMAGE_WIDTH), "pixel_height": number(PIXEL), "pixel_width": number(PIXEL)})


def parsed(lines, schema, sep):
    """Text lines of detection files as rows."""
    return lines.select("slice_id", F.from_csv("line", schema, {"sep": sep}).alias("r")).select("slice_id", "r.*")


# Every third slice's file is in fractions, the others in pixels.
@query("import_centroid_csv", f"""WITH c AS (SELECT l_orderkey AS slice_id, CASE WHEN l_orderkey % 3 = 0 THEN CAST(l_partkey % 97 AS DOUBLE) / 100 ELSE CAST(l_partkey % 97 + 2 AS DOUBLE) END AS x,
    CASE WHEN l_orderkey % 3 = 0 THEN CAST(l_suppkey % 89 AS DOUBLE) / 100 ELSE CAST(l_suppkey % 89 AS DOUBLE) END AS y, l_returnflag = 'R' AS a FROM lineitem)
  SELECT slice_id, {R(f'CASE WHEN slice_id % 3 = 0 THEN x ELSE x / {IMAGE_WIDTH} END', 9)} AS x, {R(f'CASE WHEN slice_id % 3 = 0 THEN y ELSE y / {IMAGE_HEIGHT} END', 9)} AS y, a AS "LABEL-a" FROM c""")
def import_centroid_csv(spark, sf):
    third = F.col("l_orderkey") % 3 == 0
    x = F.when(third, (F.col("l_partkey") % 97).cast("double") / number(100)).otherwise((F.col("l_partkey") % 97 + 2).cast("double"))
    y = F.when(third, (F.col("l_suppkey") % 89).cast("double") / number(100)).otherwise((F.col("l_suppkey") % 89).cast("double"))
    lines = P.table(spark, sf, "lineitem").select(
        F.col("l_orderkey").alias("slice_id"), F.concat_ws(",", y.cast("string"), x.cast("string"), (F.col("l_returnflag") == "R").cast("string")).alias("line"))
    rows = parsed(lines, "`centroid-0` double, `centroid-1` double, `LABEL-a` boolean", ",")
    return rounded(readers.centroid_cells(rows, sized_slices(spark, sf)), 9)


SPOT_SCHEMA = "Name string, Class string, `Centroid X µm` double, `Centroid Y µm` double, " + ", ".join(f"`Subcellular: Channel {i}: Num single spots` double" for i in range(2, 6))


def spot_rows(spark, sf):
    """Tab-separated detections: every 11th has no position, and a tenth is of another class."""
    x = F.when(F.col("l_partkey") % 11 == 0, F.lit("NaN")).otherwise((F.col("l_partkey") % 97 * 13).cast("double").cast("string"))
    kind = F.when(F.col("l_partkey") % 10 == 0, F.lit("Other")).when(F.col("l_partkey") % 2 == 0, F.lit("Positive")).otherwise(F.lit("Negative"))
    spots = [(F.col("l_quantity") % (i + 2)).cast("double").cast("string") for i in range(2, 6)]
    lines = P.table(spark, sf, "lineitem").select(
        F.col("l_orderkey").alias("slice_id"),
        F.concat_ws("\t", F.lit("PathDetection"), kind, x, (F.col("l_suppkey") % 89 * 10).cast("double").cast("string"), *spots).alias("line"))
    return parsed(lines, SPOT_SCHEMA, "\t")


SPOTS = f"""spots AS (SELECT l_orderkey AS slice_id, CAST(l_partkey % 97 * 13 AS DOUBLE) / {IMAGE_WIDTH * PIXEL} AS x, CAST(l_suppkey % 89 * 10 AS DOUBLE) / {IMAGE_HEIGHT * PIXEL} AS y,
  CAST(l_quantity % 4 AS DOUBLE) AS c2, CAST(l_quantity % 5 AS DOUBLE) AS c3, CAST(l_quantity % 6 AS DOUBLE) AS c4, CAST(l_quantity % 7 AS DOUBLE) AS c5
  FROM lineitem WHERE l_partkey % 11 <> 0 AND l_partkey % 10 <> 0)"""


@query("import_qupath_tsv", f"""WITH {SPOTS} SELECT slice_id, {R('x')} AS x, {R('y')} AS y, c2 > 1 AS "LABEL-Channel-2", c4 > 2 AS "LABEL-Channel-4" FROM spots""")
def import_qupath_tsv(spark, sf):
    return rounded(readers.qupath_cells(spot_rows(spark, sf), sized_slices(spark, sf), [-1, 1, -1, 2]))


@query("import_spots_tsv", f"""WITH {SPOTS} SELECT slice_id, {R('x')} AS x, {R('y')} AS y, c5 > 3 AS "LABEL-cFos", c2 > 1 AS "LABEL-Drd1", c3 > 2 AS "LABEL-Drd2", c4 > 4 AS "LABEL-Oxtr" FROM spots""")
def import_spots_tsv(spark, sf):
    return rounded(readers.spots_cells(spot_rows(spark, sf), sized_slices(spark, sf), {"cFos": 3, "Drd1": 1, "Drd2": 2, "Oxtr": 4}))


def file_names(spark, sf):
    """Per slice by its key modulo 5: none, one, one of another name, two scenes, or twice the same scene."""
    key = F.col("o_orderkey")
    image = F.concat(F.lit("slice"), key.cast("string"), F.lit(".czi"))
    scene = F.when(key % 3 != 0, (key % 3).cast("string")).otherwise(F.lit("None"))
    one = F.concat(image, F.lit(" - scene "), scene, F.lit(".txt"))
    other = F.concat(image, F.lit(" - scene 7.txt"))
    names = (F.when(key % 5 == 0, F.array().cast("array<string>")).when(key % 5 == 1, F.array(one)).when(key % 5 == 2, F.array(other))
             .when(key % 5 == 3, F.array(one, other)).otherwise(F.array(one, F.concat(F.lit("copy of "), one))))
    return P.table(spark, sf, "orders").select(F.explode(names).alias("name"))


@query("match_detection_files", """WITH o AS (SELECT o_orderkey AS slice_id, 'slice' || o_orderkey || '.czi' AS image, CASE WHEN o_orderkey % 3 = 0 THEN 'None' ELSE CAST(o_orderkey % 3 AS VARCHAR) END AS scene FROM orders)
  SELECT slice_id, CASE WHEN slice_id % 5 IN (1, 3) THEN image || ' - scene ' || scene || '.txt' WHEN slice_id % 5 = 2 THEN image || ' - scene 7.txt' END AS file,
    CAST(CASE slice_id % 5 WHEN 0 THEN 0 WHEN 1 THEN 1 WHEN 2 THEN 1 ELSE 2 END AS INTEGER) AS candidates FROM o""")
def match_detection_files(spark, sf):
    return readers.match_detection_files(file_names(spark, sf), P.slice_documents(spark, sf), "qupath")


@query("match_centroid_files", """SELECT o_orderkey AS slice_id, CASE WHEN o_orderkey % 2 = 0 THEN 'slice' || o_orderkey || '_scene' || CASE WHEN o_orderkey % 3 = 0 THEN 'None' ELSE CAST(o_orderkey % 3 AS VARCHAR) END || '.csv' END AS file,
  CAST(o_orderkey % 2 = 0 AS INTEGER) AS candidates FROM orders""")
def match_centroid_files(spark, sf):
    key = F.col("o_orderkey")
    scene = F.when(key % 3 != 0, (key % 3).cast("string")).otherwise(F.lit("None"))
    names = P.table(spark, sf, "orders").filter(key % 2 == 0).select(F.concat(F.lit("slice"), key.cast("string"), F.lit("_scene"), scene, F.lit(".csv")).alias("name"))
    return readers.match_detection_files(names, P.slice_documents(spark, sf), "centroid")


@query("read_atlas", f"""WITH v AS (SELECT p_partkey, (p_partkey // 256 * 31 + p_partkey // 16 % 16 * 7 + p_partkey % 16) % 25 + 100 AS s, p_retailprice AS ref FROM part)
  SELECT CAST(p_partkey // 256 AS INTEGER) AS z, CAST(p_partkey // 16 % 16 AS INTEGER) AS y, CAST(p_partkey % 16 AS INTEGER) AS x,
    CAST(CASE WHEN s IN (103, 107) THEN 0 ELSE s END AS INTEGER) AS struct_id, {R('CASE WHEN s IN (103, 107) THEN 0 ELSE ref / (SELECT max(ref) FROM v) END')} AS ref FROM v""")
def read_atlas(spark, sf):
    return rounded(readers.read_atlas(P.voxels(spark, sf), (103, 107)).select("z", "y", "x", "struct_id", "ref"))


@query("upgrade_schema", """SELECT o_orderkey AS slice_id, CASE WHEN o_orderkey % 2 = 0 THEN '0.1.5' ELSE '0.1.1' END AS was, 'slice' || o_orderkey || '.czi' AS filename, o_orderpriority = '5-LOW' AS ignore,
  CASE WHEN o_orderkey % 2 = 0 THEN CAST(2 AS DOUBLE) ELSE CAST(1 AS DOUBLE) END AS pixel, CAST(o_orderkey % 40 AS DOUBLE) AS ap FROM orders""")
def upgrade_schema(spark, sf):
    """Old documents: without version, pixel sizes and, if not ignored, the flag; with cell parameters."""
    key, even = F.col("o_orderkey"), F.col("o_orderkey") % 2 == 0
    params = F.struct(F.struct((key % 40).cast("double").alias("ap")).alias("atlas"), F.struct(F.lit(1).alias("diameter")).alias("cell"))
    doc = F.to_json(F.struct(
        F.when(even, F.lit("0.1.5")).alias("version"),
        F.struct(F.concat(F.lit("slice"), key.cast("string"), F.lit(".czi")).alias("filename")).alias("path"),
        params.alias("params"), F.when(F.col("o_orderpriority") == "5-LOW", F.lit(True)).alias("ignore"),
        F.when(even, F.array(number(2), number(2))).alias("physical_pixel_sizes")))
    new = readers.upgrade_schema(P.table(spark, sf, "orders").select(key.alias("slice_id"), doc.alias("doc")))
    return new.select("slice_id", "was", F.col("path.filename").alias("filename"), "ignore", F.col("physical_pixel_sizes")[0].alias("pixel"), F.col("params.atlas.ap").alias("ap"))


@query("training_labels", """WITH s AS (SELECT *, o_orderpriority <> '5-LOW' AS ok, o_orderkey % 7 <> 0 AS reg FROM orders), c AS (SELECT unnest(['DAPI', 'cFos']) AS channel)
  SELECT o_custkey || '/slice' || o_orderkey || '.czi ' || channel || '.tif' AS filename, o_custkey AS animal_id, o_orderkey AS image_id,
    CASE WHEN ok AND reg THEN o_totalprice / CAST(1000 AS DOUBLE) END AS ap, CASE WHEN ok THEN -CAST(o_orderkey % 30 AS DOUBLE) + CAST(0 AS DOUBLE) END AS rot_frontal,
    CASE WHEN ok AND reg THEN CAST(o_orderkey % 5 AS DOUBLE) END AS rot_horizontal, CASE WHEN ok AND reg THEN CAST(o_orderkey % 4 AS DOUBLE) END AS rot_sagittal,
    CASE WHEN ok THEN 'yes' ELSE 'no' END AS valid, channel FROM s, c""")
def training_labels(spark, sf):
    labels = writers.training_labels(P.slice_documents(spark, sf), F.array(F.lit("DAPI"), F.lit("cFos")))
    return labels.withColumn("rot_frontal", F.col("rot_frontal") + number(0))


@query("mask_rows", """SELECT l_orderkey AS slice_id, CAST(l_linenumber % 2 AS INTEGER) AS y, string_agg(CAST(100 + l_partkey % 25 AS VARCHAR), ',' ORDER BY l_linenumber, CAST(100 + l_partkey % 25 AS VARCHAR)) AS "row" FROM lineitem GROUP BY ALL""")
def mask_rows(spark, sf):
    mask = P.table(spark, sf, "lineitem").select(
        F.col("l_orderkey").alias("slice_id"), (F.col("l_linenumber") % 2).cast("int").alias("y"), F.col("l_linenumber").alias("x"), (F.col("l_partkey") % 25 + 100).alias("value"))
    return writers.mask_rows(mask)


@query("subject_rows", """SELECT c_custkey AS name, c_mktsegment AS segment, CAST(count(o_orderkey) AS INTEGER) AS n_slices, coalesce(string_agg(CAST(o_orderkey AS VARCHAR), ',' ORDER BY o_orderkey), '') AS slices
  FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY ALL""")
def subject_rows(spark, sf):
    subjects = P.subjects(spark, sf).select(F.col("animal_id").alias("name"), "conditions", F.lit(None).cast("array<double>").alias("rotation"))
    slices = P.slice_documents(spark, sf).select(F.col("animal_id").alias("subject"), "pos", "slice_id", "ignore")
    rows = writers.subject_rows(subjects, slices)
    ids = F.transform("slice_infos", lambda s: s["slice_id"].cast("string"))
    return rows.select("name", F.element_at("subject_info.conditions", "segment").alias("segment"), F.size("slice_infos").alias("n_slices"), F.array_join(ids, ",").alias("slices"))


EVENT_COUNTS = f"""WITH {STRUCTURES} SELECT user_id AS animal_id, c.ancestor_id AS struct_id, count(*) AS cells
  FROM events JOIN closure c ON c.id = 100 + event_id % 25 GROUP BY ALL"""


@query("region_counts_of_events", EVENT_COUNTS)
def region_counts_of_events(spark, sf):
    """The batch form of the streamed counts."""
    detections = P.table(spark, sf, "events").select(F.col("user_id").alias("animal_id"), (F.col("event_id") % 25 + 100).cast("int").alias("struct_id"))
    return stream_region_counts(detections, P.structures(spark, sf).select("id", F.explode("path").alias("ancestor_id")))


@query("region_counts_stream", EVENT_COUNTS)
def region_counts_stream(spark, sf):
    """The same counts by a stream over the event files, whose state and batches are in the checkpoint folder."""
    folder = f"{ensure_checkpoint_dir(spark)}/events-{uuid.uuid4().hex}"
    path = f"{sf}/events.parquet"
    schema = spark.read.parquet(path).schema
    reader = spark.readStream.schema(schema)
    if spark.read.parquet(path).inputFiles()[0].endswith("/events.parquet"):  # one file, of which a stream sees the folder
        events = reader.option("pathGlobFilter", "events.parquet").parquet(sf)
    else:
        events = reader.parquet(path)
    detections = events.select(F.col("user_id").alias("animal_id"), (F.col("event_id") % 25 + 100).cast("int").alias("struct_id"))
    counts = stream_region_counts(detections, P.structures(spark, sf).select("id", F.explode("path").alias("ancestor_id")))
    keep_counts(counts, f"{folder}/counts", f"{folder}/state").awaitTermination()
    return latest_counts(spark, f"{folder}/counts")
