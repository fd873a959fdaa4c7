"""Stream sources and runners."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, types as T

from spanops.session import scratch_path
from spanops.sources.otlp import parse_otlp


def stream_parquet(
    spark: SparkSession, path: str, schema: T.StructType, pattern: str | None = None, files_per_trigger: int | None = None
) -> DataFrame:
    """Files of a folder as a stream; ``pattern`` picks files by name."""
    reader = spark.readStream.schema(schema).format("parquet")
    if pattern is not None:
        reader = reader.option("pathGlobFilter", pattern)
    if files_per_trigger is not None:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return reader.load(path)


def stream_otlp(spark: SparkSession, path: str, signal: str, files_per_trigger: int | None = None) -> DataFrame:
    """Export files as they arrive, as records of one signal."""
    reader = spark.readStream.format("text")
    if files_per_trigger is not None:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return parse_otlp(reader.load(path), signal)


def run_available(stream: DataFrame, mode: str = "complete", path: str | None = None) -> DataFrame:
    """Process everything that is there, then stop; returns the written result.

    ``append`` goes through the exactly-once file sink. ``complete`` rewrites the whole result with
    every batch. Output and state lie in the shared folder, never on the driver.
    """
    spark = stream.sparkSession
    path = path or scratch_path(spark, "stream")
    writer = stream.writeStream.outputMode(mode).trigger(availableNow=True)
    writer = writer.option("checkpointLocation", scratch_path(spark, "state"))
    if mode == "append":
        query = writer.format("parquet").start(path)
    else:
        spark.createDataFrame([], stream.schema).write.parquet(path)

        def replace(batch: DataFrame, _: int) -> None:
            batch.write.mode("overwrite").parquet(path)

        query = writer.foreachBatch(replace).start()
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(path)
