"""Stream joins and sessions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from spanops import schema as S
from spanops.functions.scalars import interval
from spanops.operators.correlate import BAD_SEVERITIES
from spanops.operators.workflow import outcome_aggregates, outcome_columns
from spanops.streaming.aggregates import WATERMARK, watermarked


def st_trace_log_join(
    spans: DataFrame, logs: DataFrame, *, delay: str = WATERMARK, within: str = "1 minute"
) -> DataFrame:
    """Spans with the ERROR/WARN logs of their trace and span that follow within a bounded time.

    Left outer, append mode: a span without such a log is emitted once the bound has passed.
    """
    left = watermarked(spans, delay)
    right = watermarked(logs, delay).where(F.col("severity_text").isin(*BAD_SEVERITIES)).select(
        F.col("trace_id").alias("log_trace_id"),
        F.col("span_id").alias("log_span_id"),
        F.col("timestamp").alias("log_timestamp"),
        "severity_text",
        "body",
    )
    condition = (
        (F.col("trace_id") == F.col("log_trace_id"))
        & (F.col("span_id") == F.col("log_span_id"))
        & (F.col("log_timestamp") >= F.col("timestamp"))
        & (F.col("log_timestamp") <= F.col("timestamp") + interval(within))
    )
    joined = left.join(right, condition, "left_outer")
    return joined.select("timestamp", "trace_id", "span_id", "name", "has_error", "log_timestamp", "severity_text", "body")


def st_span_logs(
    spans: DataFrame, logs: DataFrame, *, delay: str = WATERMARK, within: str = "1 minute"
) -> DataFrame:
    """``st_trace_log_join`` that also takes logs without a span: such a log goes to the first span of its trace that started up to
    ``within`` before it (equal starts: the smaller id).

    Three stateful steps follow each other, in append mode: those logs meet the spans of their trace; the first is chosen once the
    watermark has passed the log, equal logs counting once; then all logs meet their spans, left outer. The same function over
    stored tables is the batch report.
    """
    bad = watermarked(logs, delay).where(F.col("severity_text").isin(*BAD_SEVERITIES)).select(
        F.col("trace_id").alias("log_trace_id"),
        F.col("span_id").alias("log_span_id"),
        F.col("timestamp").alias("log_timestamp"),
        "severity_text",
        "body",
    )
    named = F.coalesce(F.col("log_span_id") != "", F.lit(False))
    starts = watermarked(spans, delay).select("trace_id", "span_id", "timestamp")
    before = (F.col("timestamp") <= F.col("log_timestamp")) & (F.col("timestamp") >= F.col("log_timestamp") - interval(within))
    met = bad.where(~named).drop("log_span_id").join(starts, (F.col("trace_id") == F.col("log_trace_id")) & before)
    first = met.groupBy("log_trace_id", "log_timestamp", "severity_text", "body").agg(F.min(F.struct("timestamp", "span_id")).alias("s"))
    placed = first.select("log_trace_id", F.col("s.span_id").alias("log_span_id"), "log_timestamp", "severity_text", "body")
    right = bad.where(named).unionByName(placed)
    left = watermarked(spans, delay)
    condition = (
        (F.col("trace_id") == F.col("log_trace_id"))
        & (F.col("span_id") == F.col("log_span_id"))
        & (F.col("log_timestamp") >= F.col("timestamp"))
        & (F.col("log_timestamp") <= F.col("timestamp") + interval(within))
    )
    joined = left.join(right, condition, "left_outer")
    return joined.select("timestamp", "trace_id", "span_id", "name", "has_error", "log_timestamp", "severity_text", "body")


def st_workflow_outcome(
    spans: DataFrame, *, gap: str = "10 minutes", dim: str = S.TIER_KEY, delay: str = WATERMARK, error: Column | None = None
) -> DataFrame:
    """Outcome of each workflow once it has been quiet for ``gap``; one session per workflow."""
    rows = watermarked(spans, delay).where("trace_id != ''")
    sessions = rows.groupBy(F.session_window("timestamp", gap).alias("w"), "trace_id")
    closed = sessions.agg(*outcome_aggregates(spans, dim, error))
    return closed.select(F.col("w.end").alias("closed_at"), *outcome_columns())
