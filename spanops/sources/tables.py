"""Partitioned parquet tables of spans, logs and metric points.

Layout: ``dt`` and ``hour`` partitions of event time (``dt`` alone for thin tables), rows of a file sorted by name and time, the
tier stored as a column of its own, and a bloom filter on the trace id.
"""

from __future__ import annotations

from datetime import datetime, timezone

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from spanops import schema as S
from spanops.functions.predicates import bucket_prune
from spanops.functions.scalars import field

_DAY, _HOUR = T.StructField("dt", T.DateType()), T.StructField("hour", T.IntegerType())
_PROMOTED = [T.StructField(name, T.StringType()) for name in S.PROMOTED.values()]


def partition_columns(hourly: bool) -> list[str]:
    return ["dt", "hour"] if hourly else ["dt"]


def promote_attributes(rows: DataFrame) -> DataFrame:
    """Copy promoted attributes into columns, so that filters on them reach the scan."""
    out = rows
    for key, column in S.PROMOTED.items():
        out = out.withColumn(column, F.col("attributes_string")[key])
    return out


def with_partitions(rows: DataFrame, hourly: bool = True) -> DataFrame:
    at = F.col("timestamp").cast("timestamp")
    dated = rows.withColumn("dt", F.to_date(at))
    return dated.withColumn("hour", F.hour(at)) if hourly else dated


def with_bucket_start(rows: DataFrame) -> DataFrame:
    seconds = F.unix_seconds(F.col("timestamp").cast("timestamp"))
    return rows.withColumn("ts_bucket_start", seconds - seconds % S.BUCKET_SECONDS)


def _moment(value: datetime | str) -> datetime:
    moment = datetime.fromisoformat(value) if isinstance(value, str) else value
    return moment.replace(tzinfo=timezone.utc) if moment.tzinfo is None else moment.astimezone(timezone.utc)


def partition_range(start: datetime | str | None, end: datetime | str | None, hourly: bool = True) -> Column:
    """Condition on ``dt`` and ``hour`` implied by a time range; the planner does not derive it itself."""
    out = F.lit(True)
    if start is not None:
        low = _moment(start)
        day = F.lit(low.date())
        out = out & (F.col("dt") >= day)
        if hourly:
            out = out & ((F.col("dt") > day) | (F.col("hour") >= low.hour))
    if end is not None:
        high = _moment(end)
        day = F.lit(high.date())
        out = out & (F.col("dt") <= day)
        if hourly:
            out = out & ((F.col("dt") < day) | (F.col("hour") <= high.hour))
    return out


def _read(
    spark: SparkSession,
    path: str,
    fields: list[T.StructField],
    start: datetime | str | None,
    end: datetime | str | None,
    hourly: bool,
) -> DataFrame:
    schema = T.StructType([*fields, _DAY, *([_HOUR] if hourly else [])])
    rows = spark.read.schema(schema).parquet(path)
    if start is None and end is None:
        return rows
    rows = rows.where(partition_range(start, end, hourly))
    if start is not None:
        rows = rows.where(F.col("timestamp") >= F.lit(_moment(start)))
    if end is not None:
        rows = rows.where(F.col("timestamp") <= F.lit(_moment(end)))
    return rows


def read_spans(
    spark: SparkSession,
    path: str,
    start: datetime | str | None = None,
    end: datetime | str | None = None,
    hourly: bool = True,
) -> DataFrame:
    """Spans of a time range, inclusive at both ends; other partitions are not opened."""
    rows = _read(spark, path, S.SPANS.fields + _PROMOTED, start, end, hourly)
    if start is not None and end is not None:
        rows = rows.where(bucket_prune(rows, _moment(start), _moment(end)))
    return rows


def read_logs(
    spark: SparkSession,
    path: str,
    start: datetime | str | None = None,
    end: datetime | str | None = None,
    hourly: bool = True,
) -> DataFrame:
    return _read(spark, path, S.LOGS.fields + _PROMOTED, start, end, hourly)


def read_metrics(
    spark: SparkSession,
    path: str,
    start: datetime | str | None = None,
    end: datetime | str | None = None,
    hourly: bool = True,
) -> DataFrame:
    return _read(spark, path, S.METRIC_POINTS.fields, start, end, hourly)


def write_telemetry(rows: DataFrame, path: str, mode: str = "append", hourly: bool = True) -> None:
    """Write spans, logs or metric points in the layout above.

    Rebalancing sizes the files of each partition by its rows: a hot hour is split over tasks, small
    hours share one.
    """
    prepared = with_partitions(rows, hourly)
    if "attributes_string" in rows.columns and not set(S.PROMOTED.values()) <= set(rows.columns):
        prepared = promote_attributes(prepared)
    if "duration_nano" in rows.columns and "ts_bucket_start" not in rows.columns:
        prepared = with_bucket_start(prepared)
    parts = partition_columns(hourly)
    order = [c for c in (*parts, "name", "metric_name", "timestamp") if c in prepared.columns]
    balanced = prepared.hint("rebalance", *[F.col(c) for c in parts]).sortWithinPartitions(*order)
    writer = balanced.write.mode(mode).partitionBy(*parts)
    if "trace_id" in prepared.columns:
        writer = writer.option("parquet.bloom.filter.enabled#trace_id", "true")
    writer.parquet(path)


def rollup_latency(spans: DataFrame, step: str = "1 minute", dim: str = S.TIER_KEY) -> DataFrame:
    """Counts and a mergeable duration sketch per bucket, service, activity and tier, to be stored."""
    keys = [F.window("timestamp", step).alias("w"), "serviceName", "name", field(spans, dim).alias("tier")]
    return spans.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("spans"),
        F.count_if(F.coalesce("has_error", F.lit(False))).alias("errors"),
        F.kll_sketch_agg_bigint("duration_nano").alias("sketch"),
    ).select(F.col("w.start").alias("ts"), "serviceName", "name", "tier", "spans", "errors", "sketch")


def rollup_quantile(rollup: DataFrame, keys: list[str], quantile: float) -> DataFrame:
    """Quantile over whole buckets of a stored rollup, in ms, without going back to the spans."""
    merged = rollup.groupBy(*keys).agg(
        F.sum("spans").alias("spans"), F.sum("errors").alias("errors"), F.kll_merge_agg_bigint("sketch").alias("sketch")
    )
    value = F.kll_sketch_get_quantile_bigint("sketch", F.lit(float(quantile))) / F.lit(1000000)
    return merged.select(*keys, "spans", "errors", F.round(value, 2).alias("quantile_ms"))


def rollup_workflows(spans: DataFrame, step: str = "1 minute", lg_k: int = 12) -> DataFrame:
    """A mergeable sketch of the distinct workflows per bucket and activity, to be stored; works on streams as well.

    The relative error of an estimate is about 1.04 / sqrt(2^lg_k): 1.6 % at 12.
    """
    known = spans.where("trace_id != ''")
    counted = known.groupBy(F.window("timestamp", step).alias("w"), "name").agg(F.hll_sketch_agg("trace_id", F.lit(lg_k)).alias("sketch"))
    return counted.select(F.col("w.start").alias("ts"), "name", "sketch")


def rollup_distinct(rollup: DataFrame, keys: list[str]) -> DataFrame:
    """Distinct workflows over whole buckets of a stored rollup; a workflow in several buckets counts once."""
    merged = rollup.groupBy(*keys).agg(F.hll_union_agg("sketch").alias("sketch"))
    return merged.select(*keys, F.hll_sketch_estimate("sketch").alias("workflows"))
