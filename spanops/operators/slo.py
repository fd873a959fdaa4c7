"""Error budgets: consumption, burn rate over time, remaining share and forecast."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Window, functions as F

from spanops import schema as S
from spanops.functions.predicates import attr_nonempty, select_spans, slower_than
from spanops.functions.scalars import field, interval, rate_pct, ratio, slo_target, threshold_label


def _error(error: Column | None) -> Column:
    return F.coalesce(F.col("has_error") if error is None else error, F.lit(False))


def by_trace(spans: DataFrame, dim: str = S.TIER_KEY, error: Column | None = None) -> DataFrame:
    """One row per workflow in place of one per span: failed where any of its spans failed, whether that span has a tier or not."""
    return spans.groupBy("trace_id").agg(
        F.max(field(spans, dim)).alias(S.PROMOTED.get(dim, dim)), F.max(_error(error)).alias("has_error"),
        F.min("timestamp").alias("timestamp"),
    )


def budget_columns(targets: Mapping[str, float], default_target: float, icons: bool = False) -> list[Column]:
    """Budget report over rows with ``tier``, ``total_requests`` and ``failures``; also used on streams."""
    target = slo_target(F.col("tier"), targets, default_target)
    total, failed = F.col("total_requests"), F.col("failures")
    allowed = (F.lit(1) - target) * total
    burn = ratio(failed, allowed)
    status = threshold_label(
        [
            (burn > 1.0, "🔴", "BUDGET EXHAUSTED"),
            (burn > 0.7, "🟡", "BUDGET AT RISK"),
            (burn > 0.4, "🟠", "BURNING FAST"),
        ],
        ("🟢", "WITHIN BUDGET"),
        icons,
    )
    return [
        total,
        failed,
        (target * 100).alias("slo_target_pct"),
        F.round((F.lit(1) - ratio(failed, total)) * 100, 3).alias("actual_uptime_pct"),
        F.round(allowed, 1).alias("error_budget"),
        failed.alias("budget_consumed"),
        F.round(burn * 100, 1).alias("budget_burn_pct"),
        status.alias("status"),
    ]


def slo_budget(
    spans: DataFrame,
    *,
    as_of: object | None = None,
    window: str | None = "1 hour",
    dim: str = S.TIER_KEY,
    targets: Mapping[str, float] = S.SLO_TARGETS,
    default_target: float = S.DEFAULT_SLO_TARGET,
    error: Column | None = None,
    grain: str = "span",
    icons: bool = False,
    **base: object,
) -> DataFrame:
    """Budget consumed against budget allowed per tier. ``grain='trace'`` counts workflows, not spans."""
    rows = select_spans(spans, as_of=as_of, window=window, **base)
    if grain == "trace":
        rows, error = by_trace(rows, dim, error), None
    rows = rows.where(attr_nonempty(rows, dim))
    counted = rows.groupBy(field(rows, dim).alias("tier")).agg(
        F.count(F.lit(1)).alias("total_requests"), F.count_if(_error(error)).alias("failures")
    )
    out = counted.select("tier", *budget_columns(targets, default_target, icons))
    return out.orderBy(F.desc_nulls_last("budget_burn_pct"), "tier")


def burn_pct(targets: Mapping[str, float], default_target: float) -> Column:
    """Failures in percent of the budget, over rows with ``tier``, ``total`` and ``errors``."""
    target = slo_target(F.col("tier"), targets, default_target)
    return F.round(ratio(F.col("errors") * F.lit(100.0), (F.lit(1) - target) * F.col("total")), 1)


def burn_rate_ts(
    spans: DataFrame,
    *,
    as_of: object | None = None,
    window: str | None = "1 hour",
    step: str = "5 minutes",
    dim: str = S.TIER_KEY,
    targets: Mapping[str, float] = S.SLO_TARGETS,
    default_target: float = S.DEFAULT_SLO_TARGET,
    error: Column | None = None,
    **base: object,
) -> DataFrame:
    """Burn rate per bucket and tier; over 100 the bucket used more than its share."""
    rows = select_spans(spans, as_of=as_of, window=window, **base).where(attr_nonempty(spans, dim))
    counted = rows.groupBy(F.window("timestamp", step).alias("w"), field(spans, dim).alias("tier")).agg(
        F.count(F.lit(1)).alias("total"), F.count_if(_error(error)).alias("errors")
    )
    out = counted.select(
        F.col("w.start").alias("ts"), "tier", burn_pct(targets, default_target).alias("burn_rate_pct")
    )
    return out.orderBy("ts", "tier")


def budget_remaining(
    spans: DataFrame,
    *,
    tier: str = "enterprise",
    as_of: object | None = None,
    window: str | None = "1 hour",
    dim: str = S.TIER_KEY,
    target: float | None = None,
    error: Column | None = None,
    **base: object,
) -> DataFrame:
    """Remaining budget of one tier in percent; negative once overspent, NULL without traffic."""
    goal = S.SLO_TARGETS.get(tier, S.DEFAULT_SLO_TARGET) if target is None else target
    rows = select_spans(spans, as_of=as_of, window=window, **base).where(field(spans, dim) == tier)
    counted = rows.agg(F.count(F.lit(1)).alias("n"), F.count_if(_error(error)).alias("errors"))
    used = ratio(F.col("errors") * F.lit(100.0), (F.lit(1) - F.lit(goal)) * F.col("n"))
    return counted.select(F.round(F.lit(100) - used, 1).alias("value"))


def timeout_rate(
    spans: DataFrame,
    *,
    name: str = S.CHECK_FRAUD,
    limit_ms: float = 1000,
    as_of: object | None = None,
    window: str | None = "1 hour",
    **base: object,
) -> DataFrame:
    """Share of one activity's spans over a duration limit, in percent; one row, NULL without spans."""
    rows = select_spans(spans, as_of=as_of, window=window, name=name, **base)
    return rows.agg(F.round(rate_pct(slower_than(limit_ms)), 1).alias("value"))


def workflows_processed(
    spans: DataFrame,
    *,
    name: str = S.VALIDATE_ORDER,
    as_of: object | None = None,
    window: str | None = "1 hour",
    **base: object,
) -> DataFrame:
    """Distinct workflows that reached one activity."""
    rows = select_spans(spans, as_of=as_of, window=window, name=name, **base)
    return rows.agg(F.countDistinct("trace_id").alias("value"))


def budget_forecast(
    spans: DataFrame,
    *,
    as_of: object | None = None,
    window: str | None = "30 days",
    step: str = "1 hour",
    recent: int = 6,
    dim: str = S.TIER_KEY,
    targets: Mapping[str, float] = S.SLO_TARGETS,
    default_target: float = S.DEFAULT_SLO_TARGET,
    error: Column | None = None,
    **base: object,
) -> DataFrame:
    """Budget left after each bucket of the compliance window, and buckets until none is left.

    The recent rate is failures per bucket over the last ``recent`` buckets, empty ones included.
    ``eta_buckets`` is NULL at a zero rate and 0 once the budget is spent. The windows run over one
    row per tier and bucket.
    """
    rows = select_spans(spans, as_of=as_of, window=window, **base).where(attr_nonempty(spans, dim))
    counted = rows.groupBy(F.window("timestamp", step).alias("w"), field(spans, dim).alias("tier")).agg(
        F.count(F.lit(1)).alias("n"), F.count_if(_error(error)).alias("failed")
    )
    buckets = counted.select(F.col("w.start").alias("ts"), "tier", "n", "failed")
    so_far = Window.partitionBy("tier").orderBy("ts").rowsBetween(Window.unboundedPreceding, 0)
    # Range frame in bucket numbers, so that buckets without traffic count as such.
    width = F.unix_seconds((F.lit("1970-01-01").cast("timestamp_ntz") + interval(step)).cast("timestamp"))
    number = F.floor(F.unix_seconds(F.col("ts").cast("timestamp")) / width)
    lately = Window.partitionBy("tier").orderBy("_number").rangeBetween(-(recent - 1), 0)
    target = slo_target(F.col("tier"), targets, default_target)
    running = buckets.withColumn("_number", number).select(
        "ts",
        "tier",
        "n",
        "failed",
        F.sum("n").over(so_far).alias("total_n"),
        F.sum("failed").over(so_far).alias("total_failed"),
        (F.sum("failed").over(lately) / F.lit(float(recent))).alias("recent_rate"),
    )
    budget = (F.lit(1) - target) * F.col("total_n")
    left = budget - F.col("total_failed")
    eta = F.when(left <= 0, F.lit(0.0)).otherwise(ratio(left, F.col("recent_rate")))
    return running.select(
        "ts",
        "tier",
        "n",
        "failed",
        "total_failed",
        F.round(budget, 3).alias("budget"),
        F.round(left, 3).alias("remaining"),
        F.round("recent_rate", 4).alias("recent_rate"),
        F.round(eta, 2).alias("eta_buckets"),
    ).orderBy("tier", "ts")
