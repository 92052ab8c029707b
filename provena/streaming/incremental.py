"""Incremental scans: new files only, each distinct content once."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from provena.functions import text as ft


def stream_files(spark: SparkSession, folder: str, schema: str, files_per_trigger: int | None = None) -> DataFrame:
    """New Parquet files of a folder as a stream."""
    reader = spark.readStream.schema(schema)
    return (reader.option("maxFilesPerTrigger", files_per_trigger) if files_per_trigger else reader).parquet(folder)


def new_contents(files: DataFrame, text_col: str = "text", time_col: str | None = None, late: str = "1 hour") -> DataFrame:
    """files with sha256, the first of each content; the state is the hashes seen, bounded by ``late`` when there is a time."""
    told = files.withColumn("sha256", ft.sha256_hex(ft.normalize(F.col(text_col))))
    if time_col is None:
        return told.dropDuplicates(["sha256"])
    return told.withWatermark(time_col, late).dropDuplicatesWithinWatermark(["sha256"])


def scan_available(files: DataFrame, target: str, checkpoint: str, text_col: str = "text"):
    """Runs the scan over what is there and stops; a later call with the same checkpoint takes up where this one ended.

    What was seen is what the target holds: each batch is joined with the target's hashes, so no state grows with the
    stream, and a batch that is run again after a failure adds nothing twice.
    """
    spark = files.sparkSession
    seen = spark.createDataFrame([], "sha256 string")

    def take(batch: DataFrame, _: int) -> None:
        told = batch.withColumn("sha256", ft.sha256_hex(ft.normalize(F.col(text_col)))).dropDuplicates(["sha256"])
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(target)
        there = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(path)
        held = spark.read.parquet(target).select("sha256") if there else seen
        told.join(held, "sha256", "left_anti").write.mode("append").parquet(target)

    query = files.writeStream.foreachBatch(take).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return query
