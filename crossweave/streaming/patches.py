"""Reviewing patches as they arrive in a folder: each micro-batch is a corpus."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import Options
from ..plans.review import review
from ..sources.patch import versions_of_patches


def patch_stream(spark: SparkSession, folder: str) -> DataFrame:
    """Patch files as ``change_id, text``; each file is one change."""
    raw = spark.readStream.schema("value string").format("text").option("wholetext", "true").load(folder)
    return raw.select(F.substring_index(F.col("_metadata.file_path"), "/", -1).alias("change_id"), F.col("value").alias("text"))


def review_stream(patches: DataFrame, findings_path: str, checkpoint: str, opts: Options = Options()):
    """Starts a stream that writes each batch's findings, once per batch.

    A batch that runs again after a failure overwrites its own folder.
    """
    def one(batch: DataFrame, batch_id: int) -> None:
        found = review(versions_of_patches(batch), opts).findings
        found.write.mode("overwrite").parquet(f"{findings_path}/batch={batch_id}")
    return patches.writeStream.foreachBatch(one).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
