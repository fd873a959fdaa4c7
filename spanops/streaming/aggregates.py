"""Windowed aggregates over span streams.

Every function maps a stream to a stream and leaves sink, trigger and output mode to the caller.
State is one row per open window and group; quantiles keep a bounded sketch.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, functions as F

from spanops import schema as S
from spanops.functions.predicates import attr_nonempty, select_spans
from spanops.functions.quantiles import sketch_quantiles
from spanops.functions.scalars import field, ns_to_ms, rate_pct
from spanops.operators import latency, slo

# Spans arrive when they end, and activities end within 30 s.
WATERMARK = "2 minutes"


def watermarked(rows: DataFrame, delay: str = WATERMARK) -> DataFrame:
    """Event time as a zoned timestamp, which watermarks require, with the lateness allowed."""
    return rows.withColumn("timestamp", F.col("timestamp").cast("timestamp")).withWatermark("timestamp", delay)


def _failed():
    return F.coalesce(F.col("has_error"), F.lit(False))


def st_dedup(spans: DataFrame, delay: str = WATERMARK) -> DataFrame:
    """Spans delivered again within the watermark are dropped."""
    return watermarked(spans, delay).dropDuplicatesWithinWatermark(["trace_id", "span_id"])


def st_traffic(spans: DataFrame, *, step: str = "1 minute", dim: str = S.TIER_KEY, delay: str = WATERMARK, **base) -> DataFrame:
    rows = select_spans(watermarked(spans, delay), **base).where(attr_nonempty(spans, dim))
    counted = rows.groupBy(F.window("timestamp", step).alias("w"), field(spans, dim).alias("tier"))
    return counted.agg(F.count(F.lit(1)).alias("requests")).select(F.col("w.start").alias("ts"), "tier", "requests")


def st_burn_rate(
    spans: DataFrame,
    *,
    step: str = "5 minutes",
    dim: str = S.TIER_KEY,
    targets: Mapping[str, float] = S.SLO_TARGETS,
    default_target: float = S.DEFAULT_SLO_TARGET,
    delay: str = WATERMARK,
    **base,
) -> DataFrame:
    rows = select_spans(watermarked(spans, delay), **base).where(attr_nonempty(spans, dim))
    counted = rows.groupBy(F.window("timestamp", step).alias("w"), field(spans, dim).alias("tier")).agg(
        F.count(F.lit(1)).alias("total"), F.count_if(_failed()).alias("errors")
    )
    burn = slo.burn_pct(targets, default_target).alias("burn_rate_pct")
    return counted.select(F.col("w.start").alias("ts"), "tier", burn)


def st_p99(
    spans: DataFrame,
    *,
    step: str = "1 minute",
    by: str = "name",
    accuracy: int = 10000,
    delay: str = WATERMARK,
    **base,
) -> DataFrame:
    """P99 in ms per window and activity (or tier), from a bounded sketch."""
    rows = select_spans(watermarked(spans, delay), **base)
    key = field(spans, by)
    p99 = sketch_quantiles(F.col("duration_nano"), {"p99": 0.99}, "approx", accuracy)
    stats = rows.where(key != "").groupBy(F.window("timestamp", step).alias("w"), key.alias("series")).agg(*p99)
    return stats.select(F.col("w.start").alias("ts"), "series", F.round(ns_to_ms(F.col("p99")), 2).alias("p99_ms"))


def st_error_rate(spans: DataFrame, *, step: str = "5 minutes", delay: str = WATERMARK, **base) -> DataFrame:
    rows = select_spans(watermarked(spans, delay), **base)
    counted = rows.groupBy(F.window("timestamp", step).alias("w"), F.col("name").alias("activity")).agg(
        F.count(F.lit(1)).alias("total_spans"),
        F.count_if(_failed()).alias("error_spans"),
        F.round(rate_pct(_failed()), 2).alias("error_rate_pct"),
    )
    return counted.where("error_spans > 0").select(
        F.col("w.start").alias("ts"), "activity", "total_spans", "error_spans", "error_rate_pct"
    )


def st_sliding_budget(
    spans: DataFrame,
    *,
    window: str = "1 hour",
    slide: str = "5 minutes",
    dim: str = S.TIER_KEY,
    targets: Mapping[str, float] = S.SLO_TARGETS,
    default_target: float = S.DEFAULT_SLO_TARGET,
    delay: str = WATERMARK,
    **base,
) -> DataFrame:
    """The budget report of the last window, evaluated again with every slide."""
    rows = select_spans(watermarked(spans, delay), **base).where(attr_nonempty(spans, dim))
    counted = rows.groupBy(F.window("timestamp", window, slide).alias("w"), field(spans, dim).alias("tier")).agg(
        F.count(F.lit(1)).alias("total_requests"), F.count_if(_failed()).alias("failures")
    )
    return counted.select(F.col("w.end").alias("as_of"), "tier", *slo.budget_columns(targets, default_target))


def st_anomaly(
    spans: DataFrame,
    *,
    window: str = "1 hour",
    slide: str = "5 minutes",
    min_count: int = 10,
    accuracy: int = 10000,
    delay: str = WATERMARK,
    **base,
) -> DataFrame:
    """Anomaly scores over the last window, evaluated again with every slide."""
    rows = select_spans(watermarked(spans, delay), **base)
    quantiles = sketch_quantiles(F.col("duration_nano"), latency.ANOMALY_QUANTILES, "approx", accuracy)
    stats = rows.groupBy(F.window("timestamp", window, slide).alias("w"), F.col("name").alias("activity")).agg(
        *latency.moment_aggregates(), *quantiles
    )
    rounded = stats.where(F.col("executions") >= min_count).select(
        F.col("w.end").alias("as_of"), "activity", "executions", *latency.rounded_moments()
    )
    return rounded.select("as_of", "activity", "executions", "p50_ms", "p95_ms", "p99_ms", *latency.anomaly_columns())


def st_workflows(spans: DataFrame, *, step: str = "1 hour", error: float = 0.02, delay: str = WATERMARK, **base) -> DataFrame:
    """Distinct workflows per window; exact distinct counts are not available on streams."""
    rows = select_spans(watermarked(spans, delay), name=S.VALIDATE_ORDER, **base)
    counted = rows.groupBy(F.window("timestamp", step).alias("w")).agg(
        F.approx_count_distinct("trace_id", error).alias("workflows")
    )
    return counted.select(F.col("w.start").alias("ts"), "workflows")
