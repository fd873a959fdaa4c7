"""Trace locator: an index from trace id to the partitions and the time that the trace takes up.

Spans are stored by time, so a trace id alone says nothing about where its spans are. The locator has one row per trace, hour and
write: ``trace_id, dt, hour, first, last, spans``. It is partitioned by a hash of the id and sorted by id within files, so one id
opens one partition, and of that only the row groups that may hold it. Writes append; nothing is rewritten. A trace that gets
more spans later has more rows, which are combined when they are read.
"""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from spanops.operators.explore import trace_details
from spanops.sources.tables import partition_range, read_logs, read_spans, write_telemetry

# Partitions of the locator. The number belongs to the table: readers must use the one it was written with.
PARTITIONS = 64


class Located(NamedTuple):
    """Where a trace is: its first and last start of a span, the hours that hold any, and the number of spans written."""

    first: datetime
    last: datetime
    hours: list[tuple[object, int]]
    spans: int


def _part(trace_id: Column, partitions: int) -> Column:
    return F.pmod(F.xxhash64(trace_id), F.lit(partitions)).cast("int")


def locator_rows(spans: DataFrame) -> DataFrame:
    """One row per trace and hour of event time, combined before the shuffle; spans without a trace are left out."""
    at = F.col("timestamp").cast("timestamp")
    known = spans.where(F.col("trace_id").isNotNull() & (F.col("trace_id") != "") & at.isNotNull())
    return known.groupBy("trace_id", F.to_date(at).alias("dt"), F.hour(at).alias("hour")).agg(
        F.min(at).alias("first"), F.max(at).alias("last"), F.count(F.lit(1)).alias("spans")
    )


def write_locator(spans: DataFrame, path: str, partitions: int = PARTITIONS, mode: str = "append") -> None:
    """Add the traces of these spans to the locator."""
    rows = locator_rows(spans).withColumn("part", _part(F.col("trace_id"), partitions))
    rows = rows.hint("rebalance", F.col("part")).sortWithinPartitions("part", "trace_id")
    rows.write.mode(mode).partitionBy("part").option("parquet.bloom.filter.enabled#trace_id", "true").parquet(path)


def write_located(spans: DataFrame, path: str, locator: str, hourly: bool = True, partitions: int = PARTITIONS) -> None:
    """Append spans to their table and to the locator, the locator first: it may name an hour in vain, but never miss one."""
    write_locator(spans, locator, partitions)
    write_telemetry(spans, path, hourly=hourly)


def locating(locator: str, partitions: int = PARTITIONS) -> Callable[[DataFrame, int], None]:
    """``foreachBatch`` writer that keeps the locator of a stream; a repeated batch replaces its own rows."""

    def write(batch: DataFrame, number: int) -> None:
        rows = locator_rows(batch).withColumn("part", _part(F.col("trace_id"), partitions)).withColumn("batch", F.lit(number))
        ordered = rows.hint("rebalance", F.col("part")).sortWithinPartitions("part", "trace_id")
        writer = ordered.write.mode("overwrite").partitionBy("part", "batch").option("partitionOverwriteMode", "dynamic")
        writer.option("parquet.bloom.filter.enabled#trace_id", "true").parquet(locator)

    return write


_SCHEMA = "trace_id string, dt date, hour int, first timestamp, last timestamp, spans bigint, part int"


def locate(spark: SparkSession, locator: str, trace_id: str, partitions: int = PARTITIONS) -> Located | None:
    """Where a trace is, or None. One partition of the locator is opened; the driver gets a row per hour of the trace."""
    part = spark.range(1).select(_part(F.lit(trace_id), partitions)).first()[0]
    rows = spark.read.schema(_SCHEMA).parquet(locator).where((F.col("part") == part) & (F.col("trace_id") == trace_id))
    hours = rows.groupBy("dt", "hour").agg(F.min("first").alias("first"), F.max("last").alias("last"), F.sum("spans").alias("spans")).collect()
    if not hours:
        return None
    return Located(
        min(r["first"] for r in hours), max(r["last"] for r in hours), sorted((r["dt"], r["hour"]) for r in hours), sum(r["spans"] for r in hours)
    )


def _held(found: Located, hourly: bool) -> Column:
    """Condition on the partitions that hold spans of the trace."""
    out = F.lit(False)
    for day in sorted({d for d, _ in found.hours}):
        here = F.col("dt") == F.lit(day)
        out = out | (here & F.col("hour").isin([h for d, h in found.hours if d == day]) if hourly else here)
    return out


def trace_spans(
    spark: SparkSession, path: str, locator: str, trace_id: str, hourly: bool = True, partitions: int = PARTITIONS
) -> DataFrame:
    """The spans of one trace; only the partitions that hold some are opened."""
    found = locate(spark, locator, trace_id, partitions)
    if found is None:
        return read_spans(spark, path, hourly=hourly).where(F.lit(False))
    rows = read_spans(spark, path, hourly=hourly).where(_held(found, hourly))
    at = F.col("timestamp").between(F.lit(found.first), F.lit(found.last))
    return rows.where(at & (F.col("trace_id") == trace_id))


def located_trace_details(
    spark: SparkSession,
    path: str,
    locator: str,
    trace_id: str,
    logs: str | None = None,
    after: str = "1 hour",
    hourly: bool = True,
    partitions: int = PARTITIONS,
) -> DataFrame:
    """``trace_details`` over stored tables: the hours of the trace, and of the logs those until ``after`` its last span started."""
    spans = trace_spans(spark, path, locator, trace_id, hourly, partitions)
    entries = None
    if logs is not None:
        found = locate(spark, locator, trace_id, partitions)
        entries = read_logs(spark, logs, hourly=hourly).where(F.lit(False))
        if found is not None:
            end = spark.range(1).select(F.lit(found.last) + F.expr(f"INTERVAL {after}")).first()[0]
            within = F.col("timestamp").between(F.lit(found.first), F.lit(end))
            # Naive times of the session's zone, which is UTC.
            entries = read_logs(spark, logs, hourly=hourly).where(partition_range(found.first, end, hourly) & within)
    return trace_details(spans, trace_id, entries)
