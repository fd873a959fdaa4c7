"""Bucketed series, gap filling and the wide form used for charts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from spanops import schema as S
from spanops.functions.predicates import attr_exists, attr_nonempty, select_spans
from spanops.functions.quantiles import group_stats
from spanops.functions.scalars import bucket_start, field, interval, ns_to_ms, rate_pct

DURATION = "duration_nano"


def traffic_ts(
    spans: DataFrame,
    *,
    as_of: object | None = None,
    window: str | None = "30 minutes",
    step: str = "1 minute",
    dim: str = S.TIER_KEY,
    **base: object,
) -> DataFrame:
    """Spans per bucket and tier."""
    rows = select_spans(spans, as_of=as_of, window=window, **base).where(attr_nonempty(spans, dim))
    counted = rows.groupBy(F.window("timestamp", step).alias("w"), field(spans, dim).alias("tier"))
    out = counted.agg(F.count(F.lit(1)).alias("requests")).select(F.col("w.start").alias("ts"), "tier", "requests")
    return out.orderBy("ts", "tier")


def p99_trend_ts(
    spans: DataFrame,
    *,
    as_of: object | None = None,
    window: str | None = "30 minutes",
    step: str = "1 minute",
    quantile_mode: str = "exact",
    **base: object,
) -> DataFrame:
    """P99 per bucket and activity, in ms."""
    rows = select_spans(spans, as_of=as_of, window=window, **base)
    rows = rows.select(bucket_start(F.col("timestamp"), step).alias("ts"), F.col("name").alias("activity"), DURATION)
    keys = {"ts": F.col("ts"), "activity": F.col("activity")}
    stats = group_stats(rows, keys, F.col(DURATION), {"p99": 0.99}, mode=quantile_mode)
    out = stats.select("ts", "activity", F.round(ns_to_ms(F.col("p99")), 2).alias("p99_ms"))
    return out.orderBy("ts", "activity")


def step_breakdown_ts(
    spans: DataFrame,
    *,
    as_of: object | None = None,
    window: str | None = "30 minutes",
    step: str = "1 minute",
    **base: object,
) -> DataFrame:
    """Mean duration per bucket and activity, in ms."""
    rows = select_spans(spans, as_of=as_of, window=window, **base)
    counted = rows.groupBy(F.window("timestamp", step).alias("w"), F.col("name").alias("activity"))
    mean = F.round(ns_to_ms(F.avg(DURATION)), 2).alias("avg_ms")
    return counted.agg(mean).select(F.col("w.start").alias("ts"), "activity", "avg_ms").orderBy("ts", "activity")


def error_rate_ts(
    spans: DataFrame,
    *,
    as_of: object | None = None,
    window: str | None = "1 hour",
    step: str = "5 minutes",
    error: Column | None = None,
    **base: object,
) -> DataFrame:
    """Error share per bucket and activity, for buckets with any error."""
    failed = F.coalesce(F.col("has_error") if error is None else error, F.lit(False))
    rows = select_spans(spans, as_of=as_of, window=window, **base)
    counted = rows.groupBy(F.window("timestamp", step).alias("w"), F.col("name").alias("activity")).agg(
        F.count(F.lit(1)).alias("total_spans"),
        F.count_if(failed).alias("error_spans"),
        F.round(rate_pct(failed), 2).alias("error_rate_pct"),
    )
    out = counted.where("error_spans > 0").select(
        F.col("w.start").alias("ts"), "activity", "total_spans", "error_spans", "error_rate_pct"
    )
    return out.orderBy(F.desc("ts"), F.desc("error_rate_pct"), "activity")


def p99_by_tier_ts(
    spans: DataFrame,
    *,
    start: object | None = None,
    end: object | None = None,
    name: str = S.CHECK_FRAUD,
    step: str = "1 minute",
    dim: str = S.TIER_KEY,
    quantile_mode: str = "exact",
) -> DataFrame:
    """P99 of one activity per bucket and tier, in nanoseconds, over any service.

    Spans with an empty tier count; spans without the key do not.
    """
    rows = select_spans(spans, start=start, end=end, name=name, service=None).where(attr_exists(spans, dim))
    rows = rows.select(
        bucket_start(F.col("timestamp"), step).alias("ts"), field(spans, dim).alias("customer_tier"), DURATION
    )
    keys = {"ts": F.col("ts"), "customer_tier": F.col("customer_tier")}
    stats = group_stats(rows, keys, F.col(DURATION), {"value": 0.99}, mode=quantile_mode)
    return stats.orderBy("ts", "customer_tier")


def gap_fill(
    series: DataFrame,
    *,
    keys: Sequence[str],
    value: str,
    step: str,
    ts: str = "ts",
    start: object | None = None,
    end: object | None = None,
    fill: object = 0,
) -> DataFrame:
    """Every bucket of the range for every series; missing ones hold ``fill``, a NULL that is there stays one.

    Each row also emits the empty buckets up to the next row of its series, so nothing is joined.
    ``start`` and ``end`` may lie anywhere in a bucket; where absent they are the ends of the data.
    """
    kind = series.schema[ts].dataType
    width = interval(step)

    ordered = Window.partitionBy(*keys).orderBy(ts)
    placed = series.select(
        *keys,
        ts,
        value,
        F.lag(ts).over(ordered).isNull().alias("_first"),
        F.lead(ts).over(ordered).alias("_next"),
    )
    if start is None or end is None:
        ends = series.agg(F.struct(F.min(ts).alias("low"), F.max(ts).alias("high")).alias("ends")).scalar()
        placed = placed.withColumn("_ends", ends)
    placed = placed.select(
        "*",
        (F.col("_ends.low") if start is None else bucket_start(F.lit(start).cast(kind), step)).alias("_start"),
        (F.col("_ends.high") if end is None else F.lit(end).cast(kind)).alias("_end"),
    )
    first = F.when(F.col("_first"), F.least("_start", ts)).otherwise(F.col(ts))
    last = F.coalesce(F.col("_next") - width, F.greatest("_end", ts))
    grid = placed.withColumn("_at", F.explode(F.sequence(first, last, width)))
    own = F.col("_at") == F.col(ts)
    filled = F.when(own, F.col(value)).otherwise(F.lit(fill)).cast(series.schema[value].dataType)
    out = grid.select(F.col("_at").alias(ts), *keys, filled.alias(value))
    return out.orderBy(ts, *keys)


def series_pivot(series: DataFrame, *, key: str, value: str, values: Sequence[str], ts: str = "ts") -> DataFrame:
    """Long series to one column per named series; of several values in a bucket the largest."""
    return series.groupBy(ts).pivot(key, list(values)).agg(F.max(value)).orderBy(ts)
