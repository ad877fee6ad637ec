"""Region counts that follow new detection files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def stream_detections(spark: SparkSession, root: str, schema: str, kind: str = "parquet", files_per_batch: int = 1000) -> DataFrame:
    """New detection files under ``root``, each picked up once by the query's checkpoint."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).format(kind).load(root)


def stream_region_counts(detections: DataFrame, closure: DataFrame) -> DataFrame:
    """Detections per animal and structure, rolled up the tree: (animal_id, struct_id, cells).

    ``detections(animal_id, struct_id)`` may be a stream; ``closure(id, ancestor_id)`` is a table.  The state is
    one number per animal and structure, whatever the number of detections."""
    up = closure.select(F.col("id").alias("struct_id"), "ancestor_id")
    return detections.join(up, "struct_id").groupBy("animal_id", F.col("ancestor_id").alias("struct_id")).agg(F.count(F.lit(1)).alias("cells"))


def keep_counts(counts: DataFrame, path: str, checkpoint: str):
    """Run until the files there are are counted; ``path`` holds the changed counts of each batch, and a
    batch that runs again after a failure replaces its own."""

    def save(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={number}")

    return counts.writeStream.outputMode("update").option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(save).start()


def latest_counts(spark: SparkSession, path: str) -> DataFrame:
    """The counts after the last batch that changed them."""
    rows = spark.read.parquet(path)
    return rows.groupBy("animal_id", "struct_id").agg(F.max_by("cells", "batch").alias("cells"))
