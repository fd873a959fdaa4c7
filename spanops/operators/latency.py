"""Latency statistics: anomaly scores, drift against a baseline, peers and silent failures."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from spanops import schema as S
from spanops.functions.predicates import attr_nonempty, lookback, select_spans, settled, slower_than
from spanops.functions.quantiles import group_stats, match_groups
from spanops.functions.scalars import epoch_nanos, field, ns_to_ms, rate_pct, ratio, threshold_label
from spanops.session import materialize

DURATION = "duration_nano"


def _ms(column: str) -> Column:
    return F.round(ns_to_ms(F.col(column)), 2)


def anomaly_columns(icons: bool = False) -> list[Column]:
    """Scores over rows with avg_ms, stddev_ms and p50/p95/p99_ms, all already rounded; also for streams."""
    z = ratio(F.col("p99_ms") - F.col("avg_ms"), F.col("stddev_ms"))
    tail = ratio(F.col("p95_ms") - F.col("p50_ms"), F.col("p50_ms"))
    health = threshold_label(
        [(z > 3.0, "🔴", "ANOMALOUS"), (z > 2.0, "🟡", "WARNING"), (tail > 1.0, "🟠", "LONG TAIL")],
        ("🟢", "NORMAL"),
        icons,
    )
    return [
        F.round(z, 2).alias("z_score"),
        F.round(tail * 100, 1).alias("tail_spread_pct"),
        health.alias("health"),
    ]


def moment_aggregates() -> list[Column]:
    return [
        F.count(F.lit(1)).alias("executions"),
        F.avg(DURATION).alias("_avg"),
        F.stddev_pop(DURATION).alias("_std"),
    ]


ANOMALY_QUANTILES = {"_p50": 0.50, "_p95": 0.95, "_p99": 0.99}


def rounded_moments() -> list[Column]:
    names = {"_avg": "avg_ms", "_std": "stddev_ms", "_p50": "p50_ms", "_p95": "p95_ms", "_p99": "p99_ms"}
    return [_ms(source).alias(name) for source, name in names.items()]


def zscore_anomaly(
    spans: DataFrame,
    *,
    as_of: object | None = None,
    window: str | None = "1 hour",
    min_count: int = 10,
    quantile_mode: str = "exact",
    icons: bool = False,
    **base: object,
) -> DataFrame:
    """How far each activity's P99 lies above its mean, in standard deviations, and its tail spread."""
    rows = select_spans(spans, as_of=as_of, window=window, **base)
    stats = group_stats(
        rows, {"activity": F.col("name")}, F.col(DURATION), ANOMALY_QUANTILES, moment_aggregates(), quantile_mode
    )
    stats = stats.where(F.col("executions") >= min_count).select("activity", "executions", *rounded_moments())
    out = stats.select("activity", "executions", "p50_ms", "p95_ms", "p99_ms", *anomaly_columns(icons))
    return out.orderBy(F.desc_nulls_last("z_score"), "activity")


def drift_columns(icons: bool = False) -> list[Column]:
    """Drift over rows with a rounded ``p99_ms`` and an unrounded ``_baseline_ms``."""
    drift = ratio(F.col("p99_ms") - F.col("_baseline_ms"), F.col("_baseline_ms"))
    status = threshold_label(
        [
            (drift > 1.0, "🔴", "CRITICAL"),
            (drift > 0.5, "🟡", "DRIFTING"),
            (drift > 0.1, "🟠", "ELEVATED"),
            (drift < -0.1, "🔵", "UNDER-BASELINE"),
        ],
        ("🟢", "HEALTHY"),
        icons,
    )
    return [
        F.round("_baseline_ms", 2).alias("baseline_p99_ms"),
        F.round(drift * 100, 1).alias("drift_pct"),
        status.alias("status"),
    ]


def global_baseline(rows: DataFrame, quantile_mode: str = "exact", at_most: int | None = None) -> Column:
    """P99 of all rows in ms, as a scalar subquery to be used in any other frame."""
    base = group_stats(rows, {}, F.col(DURATION), {"p99": 0.99}, mode=quantile_mode, at_most=at_most)
    return base.select(ns_to_ms(F.col("p99")).alias("baseline_ms")).scalar()


def latency_drift(
    spans: DataFrame,
    *,
    as_of: object | None = None,
    live: str | None = "30 minutes",
    baseline: str | None = "2 hours",
    dim: str = S.TIER_KEY,
    min_count: int = 5,
    error: Column | None = None,
    quantile_mode: str = "exact",
    icons: bool = False,
    **base: object,
) -> DataFrame:
    """P99 per tier in the live window against the P99 of every span in the longer baseline window."""
    as_of = settled(spans, as_of)
    failed = F.coalesce(F.col("has_error") if error is None else error, F.lit(False))
    fleet = select_spans(spans, as_of=as_of, window=baseline, **base)
    now = select_spans(spans, as_of=as_of, window=live, **base).where(attr_nonempty(spans, dim))
    at_most = None
    if quantile_mode == "exact":
        # One count bounds both sides.
        times = [F.lit(True) if w is None else lookback(spans, w, as_of) for w in (live, baseline)]
        at_most = select_spans(spans, **base).where(times[0] | times[1]).count()
    aggregates = [F.count(F.lit(1)).alias("total_spans"), F.round(rate_pct(failed), 2).alias("error_rate_pct")]
    tiers = group_stats(
        now, {"tier": field(spans, dim)}, F.col(DURATION), {"_p99": 0.99}, aggregates, quantile_mode, at_most=at_most
    ).where(F.col("total_spans") >= min_count)
    compared = tiers.withColumn("p99_ms", _ms("_p99")).withColumn(
        "_baseline_ms", global_baseline(fleet, quantile_mode, at_most)
    )
    baseline_ms, drift, status = drift_columns(icons)
    out = compared.select("tier", "p99_ms", baseline_ms, drift, "error_rate_pct", "total_spans", status)
    return out.orderBy(F.desc_nulls_last("drift_pct"), "tier")


def rolling_drift(
    spans: DataFrame,
    *,
    as_of: object | None = None,
    window: str | None = "24 hours",
    slot: str = "30 minutes",
    baseline: str = "2 hours",
    dim: str = S.TIER_KEY,
    min_count: int = 5,
    quantile_mode: str = "exact",
    icons: bool = False,
    **base: object,
) -> DataFrame:
    """Drift as a series: each slot's P99 per tier against the P99 of the trailing window ending with it.

    The rows behind the trailing windows reach back by ``baseline`` beyond ``window``, so the first slots compare with whole ones.
    """
    as_of = settled(spans, as_of)
    rows = select_spans(spans, as_of=as_of, window=window, **base)
    behind = select_spans(spans, **base)
    if window is not None:
        behind = behind.where(lookback(spans, window, as_of, slack=baseline))
    slot_end = F.window("timestamp", slot).getField("end")
    live = group_stats(
        rows.where(attr_nonempty(spans, dim)).withColumn("_end", slot_end),
        {"_end": F.col("_end"), "tier": field(spans, dim)},
        F.col(DURATION),
        {"_p99": 0.99},
        [F.count(F.lit(1)).alias("total_spans")],
        quantile_mode,
    ).where(F.col("total_spans") >= min_count)
    trailing = behind.select(F.window("timestamp", baseline, slot).getField("end").alias("_end"), DURATION)
    fleet = group_stats(trailing, {"_end": F.col("_end")}, F.col(DURATION), {"_fleet": 0.99}, mode=quantile_mode)
    joined = live.join(fleet, "_end").withColumn("p99_ms", _ms("_p99"))
    joined = joined.withColumn("_baseline_ms", ns_to_ms(F.col("_fleet")))
    out = joined.select(F.col("_end").alias("slot_end"), "tier", "total_spans", "p99_ms", *drift_columns(icons))
    return out.orderBy("slot_end", F.desc_nulls_last("drift_pct"), "tier")


def peer_latency_ratio(
    spans: DataFrame,
    *,
    as_of: object | None = None,
    window: str | None = "1 hour",
    quantile_mode: str = "exact",
    **base: object,
) -> DataFrame:
    """P99 of each activity over the median P99 of the other activities.

    The median without one member is one of two neighbouring order statistics of the full list, so
    three of these answer for every activity and no activity is paired with any other.
    """
    rows = select_spans(spans, as_of=as_of, window=window, **base)
    return _peer_ratios(rows, quantile_mode).orderBy(F.desc_nulls_last("peer_ratio"), "activity")


def _peer_ratios(rows: DataFrame, quantile_mode: str, at_most: int | None = None) -> DataFrame:
    keys = {"activity": F.col("name")}
    p99 = group_stats(rows, keys, F.col(DURATION), {"p99": 0.99}, mode=quantile_mode, at_most=at_most)
    # One number per activity name.
    ordered = p99.agg(F.sort_array(F.collect_list("p99")).alias("v")).scalar()
    listed = p99.withColumn("_v", ordered).withColumn("_m", F.size("_v") - 1)

    def order_statistic(rank: Column) -> Column:
        at = F.get(F.col("_v"), rank)
        return F.when(F.col("p99") > at, at).otherwise(F.get(F.col("_v"), rank + 1))

    lower = F.floor((F.col("_m") - 1) / 2).cast("int")
    upper = F.floor(F.col("_m") / 2).cast("int")
    peers = F.when(F.col("_m") > 0, (order_statistic(lower) + order_statistic(upper)) / 2)
    return listed.withColumn("_peers", peers).select(
        "activity",
        _ms("p99").alias("p99_ms"),
        _ms("_peers").alias("peer_median_p99_ms"),
        F.round(ratio(F.col("p99"), F.col("_peers")), 2).alias("peer_ratio"),
    )


def silent_failure(
    spans: DataFrame,
    *,
    as_of: object | None = None,
    window: str | None = "1 hour",
    ceiling_ms: float = 1000,
    dim: str = S.TIER_KEY,
    max_spread_pct: float = 2.0,
    min_peer_ratio: float = 10.0,
    quantile_mode: str = "exact",
    error: Column | None = None,
    **base: object,
) -> DataFrame:
    """Activities with slow spans that report no error, and whether every tier is hit alike.

    ``SYSTEMIC``: far slower than its peers with the same P99 in every tier. ``SLOW``: far slower only.
    """
    rows = select_spans(spans, as_of=as_of, window=window, **base)
    silent = slower_than(ceiling_ms) & ~F.coalesce(F.col("has_error") if error is None else error, F.lit(False))
    counted = rows.groupBy(F.col("name").alias("activity")).agg(
        F.count(F.lit(1)).alias("executions"),
        F.count_if(silent).alias("silent_spans"),
        F.round(rate_pct(silent), 2).alias("silent_pct"),
    )
    at_most = rows.count() if quantile_mode == "exact" else None
    tiers = group_stats(
        rows.where(attr_nonempty(spans, dim)),
        {"activity": F.col("name"), "tier": field(spans, dim)},
        F.col(DURATION),
        {"p99": 0.99},
        mode=quantile_mode,
        at_most=at_most,
    )
    spread = tiers.groupBy("activity").agg(
        F.round(ratio(F.max("p99") - F.min("p99"), F.max("p99")) * 100, 2).alias("tier_spread_pct")
    )
    peers = _peer_ratios(rows, quantile_mode, at_most).select("activity", "p99_ms", "peer_ratio")
    joined = match_groups(match_groups(counted, peers, ["activity"]), spread, ["activity"])
    slow = F.col("peer_ratio") >= min_peer_ratio
    verdict = F.when(slow & (F.col("tier_spread_pct") < max_spread_pct), "SYSTEMIC").when(slow, "SLOW").otherwise("OK")
    return joined.withColumn("verdict", verdict).orderBy(F.desc_nulls_last("peer_ratio"), "activity")


def latency_histogram(
    spans: DataFrame,
    *,
    as_of: object | None = None,
    window: str | None = "1 hour",
    width_ms: float = 100,
    **base: object,
) -> DataFrame:
    """Spans per duration bucket and activity."""
    rows = select_spans(spans, as_of=as_of, window=window, **base)
    bucket = F.floor(ns_to_ms(F.col(DURATION)) / F.lit(width_ms)) * F.lit(width_ms)
    counted = rows.groupBy(F.col("name").alias("activity"), bucket.cast("double").alias("bucket_ms"))
    return counted.agg(F.count(F.lit(1)).alias("spans")).orderBy("activity", "bucket_ms")


def workflow_latency(
    spans: DataFrame,
    *,
    as_of: object | None = None,
    window: str | None = "1 hour",
    longest: str = "1 hour",
    dim: str = S.TIER_KEY,
    quantile_mode: str = "exact",
    **base: object,
) -> DataFrame:
    """End-to-end time per workflow, first start to last end, summarised by tier.

    Workflows count by their start, which must lie in ``window``; their spans are read from ``longest`` before it on, so a
    workflow that began earlier is neither cut nor counted.
    """
    as_of = settled(spans, as_of)
    rows = select_spans(spans, **base)
    if window is not None:
        rows = rows.where(lookback(spans, window, as_of, slack=longest))
    start = epoch_nanos(F.col("timestamp"))
    traces = rows.groupBy("trace_id").agg(
        F.max(field(spans, dim)).alias("tier"),
        (F.max(start + F.col(DURATION)) - F.min(start)).alias("total_nano"),
        F.min("timestamp").alias("timestamp"),
    )
    if window is not None:
        traces = traces.where(lookback(spans, window, as_of))
    traces = traces.drop("timestamp")
    # One short row per workflow, written once: the quantiles look at it more than once.
    traces = materialize(traces, "workflows")
    stats = group_stats(
        traces,
        {"tier": F.coalesce("tier", F.lit(""))},
        F.col("total_nano"),
        {"_p50": 0.50, "_p95": 0.95, "_p99": 0.99},
        [F.count(F.lit(1)).alias("workflows"), F.max("total_nano").alias("_max")],
        quantile_mode,
    )
    columns = [_ms(f"_{q}").alias(f"{q}_ms") for q in ("p50", "p95", "p99", "max")]
    return stats.select("tier", "workflows", *columns).orderBy("tier")
