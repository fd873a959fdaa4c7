"""The ten-panel service level dashboard as DataFrames and as tables."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession, functions as F

from spanops import schema as S
from spanops.functions.predicates import instant, select_spans, settled
from spanops.functions.scalars import field, interval
from spanops.operators import latency, slo, timeseries

# Panel names in layout order, with the lookback each one shows.
PANEL_WINDOWS = {
    "value-fraud-timeout": "1 hour",
    "value-enterprise-budget": "1 hour",
    "value-workflows-processed": "1 hour",
    "ts-traffic-by-tier": "30 minutes",
    "ts-burn-rate": "1 hour",
    "ts-p99-trend": "30 minutes",
    "ts-step-breakdown": "30 minutes",
    "table-zscore": "1 hour",
    "table-drift": "30 minutes",
    "table-slo-budget": "1 hour",
}
BASELINE_WINDOW = "2 hours"


@contextmanager
def tag_query(spark: SparkSession, comment: str) -> Iterator[None]:
    """Attach a comment to every job run inside the block, as job description and as a tag."""
    tag = comment.replace(",", ";")
    spark.sparkContext.setJobDescription(comment)
    spark.addTag(tag)
    try:
        yield
    finally:
        spark.removeTag(tag)
        spark.sparkContext.setJobDescription(None)


def panel_base(spans: DataFrame, as_of: object | None, window: str | None = BASELINE_WINDOW) -> DataFrame:
    """The columns and rows any panel needs: the widest lookback, narrowed to seven columns."""
    rows = select_spans(spans, as_of=as_of, window=window)
    return rows.select(
        "timestamp",
        "trace_id",
        "name",
        "serviceName",
        "duration_nano",
        "has_error",
        field(spans, S.TIER_KEY).alias(S.PROMOTED[S.TIER_KEY]),
    )


def panel_pack(
    spans: DataFrame,
    *,
    as_of: object | None = None,
    windows: dict[str, str | None] | None = None,
    baseline: str | None = BASELINE_WINDOW,
    burn_step: str = "5 minutes",
    series_step: str = "1 minute",
    quantile_mode: str = "exact",
    icons: bool = True,
) -> dict[str, DataFrame]:
    """Panel name to DataFrame, in layout order, all as of the same instant. ``spans`` may be a cached ``panel_base``."""
    as_of = settled(spans, as_of)
    shown = PANEL_WINDOWS | (windows or {})
    mode = {"quantile_mode": quantile_mode}

    def filled() -> DataFrame:
        window = shown["ts-step-breakdown"]
        series = timeseries.step_breakdown_ts(spans, as_of=as_of, window=window, step=series_step)
        if window is None:
            return timeseries.gap_fill(series, keys=["activity"], value="avg_ms", step=series_step)
        end = instant(spans, as_of)
        first, last = (F.window(at, series_step).getField("start") for at in (end - interval(window), end))
        edges = spans.sparkSession.range(1).select(first.alias("first"), last.alias("last"))
        start_at, end_at = (edges.select(name).scalar() for name in ("first", "last"))
        return timeseries.gap_fill(
            series, keys=["activity"], value="avg_ms", step=series_step, start=start_at, end=end_at
        )

    builders: dict[str, Callable[[str | None], DataFrame]] = {
        "value-fraud-timeout": lambda w: slo.timeout_rate(spans, as_of=as_of, window=w),
        "value-enterprise-budget": lambda w: slo.budget_remaining(spans, as_of=as_of, window=w),
        "value-workflows-processed": lambda w: slo.workflows_processed(spans, as_of=as_of, window=w),
        "ts-traffic-by-tier": lambda w: timeseries.traffic_ts(spans, as_of=as_of, window=w, step=series_step),
        "ts-burn-rate": lambda w: slo.burn_rate_ts(spans, as_of=as_of, window=w, step=burn_step),
        "ts-p99-trend": lambda w: timeseries.p99_trend_ts(spans, as_of=as_of, window=w, step=series_step, **mode),
        "ts-step-breakdown": lambda w: filled(),
        "table-zscore": lambda w: latency.zscore_anomaly(spans, as_of=as_of, window=w, icons=icons, **mode),
        "table-drift": lambda w: latency.latency_drift(
            spans, as_of=as_of, live=w, baseline=baseline, icons=icons, **mode
        ),
        "table-slo-budget": lambda w: slo.slo_budget(spans, as_of=as_of, window=w, icons=icons),
    }
    return {panel: builders[panel](window) for panel, window in shown.items()}


def sink_panels(
    spans: DataFrame,
    path: str,
    *,
    as_of: object,
    mode: str = "overwrite",
    base_window: str | None = BASELINE_WINDOW,
    **options: object,
) -> list[str]:
    """Write every panel as a parquet table below ``path``; the base frame is read once and shared.

    ``base_window`` is the widest lookback of any panel, ``None`` where one has no time bound.
    """
    spark = spans.sparkSession
    base = panel_base(spans, as_of, base_window).persist(StorageLevel.MEMORY_AND_DISK)
    try:
        panels = panel_pack(base, as_of=as_of, **options)
        for name, frame in panels.items():
            with tag_query(spark, f"panel {name}"):
                frame.write.mode(mode).parquet(f"{path}/{name}")
    finally:
        base.unpersist()
    return list(panels)


def long_panels(panels: dict[str, DataFrame]) -> DataFrame:
    """All panels in one long frame: panel, row label, time, measure and its number or word."""
    parts = []
    for name, frame in panels.items():
        types = dict(frame.dtypes)
        label = next((f"coalesce({c}, '')" for c in ("tier", "activity") if c in types), "''")
        at = "cast(ts AS timestamp_ntz)" if "ts" in types else "cast(NULL AS timestamp_ntz)"
        measures = ", ".join(
            f"'{c}', cast(NULL AS double), {c}" if kind == "string" else f"'{c}', cast({c} AS double), cast(NULL AS string)"
            for c, kind in types.items()
            if c not in ("tier", "activity", "ts")
        )
        count = sum(c not in ("tier", "activity", "ts") for c in types)
        parts.append(
            frame.selectExpr(
                f"'{name}' AS panel", f"{label} AS label", f"{at} AS ts", f"stack({count}, {measures}) AS (measure, number, word)"
            )
        )
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out
