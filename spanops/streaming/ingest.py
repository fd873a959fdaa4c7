"""Stream to partitioned table, and reports recomputed over that table."""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime

from pyspark.sql import DataFrame, functions as F
from pyspark.sql.streaming import StreamingQuery

from spanops import schema as S
from spanops.functions.predicates import latest
from spanops.functions.scalars import interval
from spanops.operators.latency import latency_drift
from spanops.sources.tables import partition_columns, promote_attributes, with_bucket_start, with_partitions


def st_ingest(
    rows: DataFrame,
    path: str,
    checkpoint: str,
    *,
    every: str | None = "5 seconds",
    name: str | None = None,
    hourly: bool = True,
) -> StreamingQuery:
    """Append a stream to the partitioned table; late rows are kept, in the partition of their event time.

    ``every=None`` takes what is there and stops.
    """
    prepared = with_partitions(rows, hourly)
    if "attributes_string" in rows.columns and not set(S.PROMOTED.values()) <= set(rows.columns):
        prepared = promote_attributes(prepared)
    if "duration_nano" in rows.columns:
        prepared = with_bucket_start(prepared)
    writer = prepared.writeStream.format("parquet").outputMode("append").partitionBy(*partition_columns(hourly))
    writer = writer.option("path", path).option("checkpointLocation", checkpoint)
    writer = writer.trigger(availableNow=True) if every is None else writer.trigger(processingTime=every)
    return (writer.queryName(name) if name else writer).start()


def recompute(
    table: str, report: str, build: Callable[[DataFrame, object], DataFrame], hourly: bool = True
) -> Callable[[DataFrame, int], None]:
    """``foreachBatch`` writer: add the batch to the span table, rebuild a report over the table.

    A batch has its own folder below the table, so a repeated batch replaces itself.
    """

    def write(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        dated = with_partitions(batch, hourly)
        dated.write.mode("overwrite").partitionBy(*partition_columns(hourly)).parquet(f"{table}/batch={number}")
        spans = spark.read.option("basePath", table).parquet(table)
        newest = latest(spans)
        if newest is not None:
            build(spans, newest).write.mode("overwrite").parquet(report)

    return write


def st_drift(
    spans: DataFrame,
    table: str,
    report: str,
    checkpoint: str,
    *,
    every: str | None = "5 seconds",
    hourly: bool = True,
    baseline: str = "2 hours",
    **options: object,
) -> StreamingQuery:
    """Latency drift kept current: live tiers against the trailing fleet baseline.

    Both sides look at the same spans over different times, which a stream-stream join cannot state,
    so the batch report runs over the stored spans with every trigger: rows of the baseline's days are
    read, and the whole table is looked at for its newest time.
    """

    def build(rows: DataFrame, newest: datetime) -> DataFrame:
        since = F.to_date(F.lit(newest).cast("timestamp") - interval(baseline))
        held = rows.where(F.col("dt") >= since)
        return latency_drift(held, as_of=newest, baseline=baseline, **options)

    writer = spans.writeStream.foreachBatch(recompute(table, report, build, hourly)).option("checkpointLocation", checkpoint)
    writer = writer.trigger(availableNow=True) if every is None else writer.trigger(processingTime=every)
    return writer.start()
