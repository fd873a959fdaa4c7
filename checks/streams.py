"""Streaming forms, run over a stream of the given tables until nothing is left."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks import views
from checks.registry import ORACLES, over, register, spans
from checks.reports import (
    BASE, BURN_SQL, DAY, ERROR_RATE_SQL, OUTCOME_SQL, TIERED, TRAFFIC_SQL, _budget_select, _drift_sql,
)
from spanops import schema as S
from spanops.functions.predicates import select_spans
from spanops.functions.scalars import bucket_start
from spanops.session import scratch_path
from spanops.streaming import aggregates, ingest, joins, panes, workflows
from spanops.streaming.run import run_available, stream_parquet


def _spans(spark, sf_dir):
    return views.spans(views.stream(spark, sf_dir, "events"))


def _with_closing(spark, sf_dir, kind, key, column, build, after: str = "60 days", number: int = -1, **other):
    """The view that ``build`` makes of a table's stream, with one more row long after all others.

    That row repeats the newest one under a key of its own (and with ``other`` values); it moves the watermark past every window and
    timer, and stays open itself.
    """
    table = views.table(spark, sf_dir, kind)
    last = table.orderBy(F.desc(column), *table.columns).limit(1)
    last = last.withColumn(column, F.col(column) + F.expr(f"INTERVAL {after}")).withColumn(key, F.lit(number).cast("bigint"))
    last = last.withColumns({name: F.lit(value) for name, value in other.items()})
    path = scratch_path(spark, "closing")
    build(last).limit(1).write.parquet(path)
    stream = build(views.stream(spark, sf_dir, kind))
    return stream.unionByName(stream_parquet(spark, path, build(last).schema).select(*stream.columns))


@register("st_ingest", over("spans", body="""
SELECT timestamp, trace_id, span_id, name, duration_nano, has_error, tier AS customer_tier, CAST(timestamp AS DATE)::VARCHAR AS day FROM spans"""))
def st_ingest(spark, sf_dir):
    stream = _spans(spark, sf_dir).withColumn("timestamp", F.col("timestamp").cast("timestamp"))
    path = scratch_path(spark, "ingested")
    ingest.st_ingest(stream, path, scratch_path(spark, "state"), every=None, hourly=False).awaitTermination()
    found = spark.read.parquet(path)
    return found.select(
        "timestamp", "trace_id", "span_id", "name", "duration_nano", "has_error", "customer_tier", F.col("dt").cast("string").alias("day")
    )


@register("st_dedup", over("spans", body=" SELECT timestamp, trace_id, span_id, name, duration_nano FROM spans"))
def st_dedup(spark, sf_dir):
    """Every span is delivered twice; one of each is kept."""
    twice = views.stream(spark, sf_dir, "events").withColumn("copy", F.explode(F.array(F.lit(1), F.lit(2))))
    kept = aggregates.st_dedup(views.spans(twice))
    return run_available(kept.select("timestamp", "trace_id", "span_id", "name", "duration_nano"), "append")


@register("st_traffic", over("spans", body=TRAFFIC_SQL))
def st_traffic(spark, sf_dir):
    return run_available(aggregates.st_traffic(_spans(spark, sf_dir), step="1 day"))


@register("st_burn_rate", over("spans", body=BURN_SQL))
def st_burn_rate(spark, sf_dir):
    return run_available(aggregates.st_burn_rate(_spans(spark, sf_dir), step="1 day"))


@register("st_p99", over("spans", body=f"""
SELECT {DAY} AS ts, name AS series, round(quantile_disc(duration_nano, 0.99) / 1000000, 2) AS p99_ms
FROM spans WHERE {BASE} GROUP BY 1, 2"""))
def st_p99(spark, sf_dir):
    return run_available(aggregates.st_p99(_spans(spark, sf_dir), step="1 day"))


@register("st_error_rate", over("spans", body=ERROR_RATE_SQL))
def st_error_rate(spark, sf_dir):
    return run_available(aggregates.st_error_rate(_spans(spark, sf_dir), step="1 day"))


def _sliding(days: int) -> str:
    """The end of every sliding window with a slide of one day, next to each of its spans."""
    return f"""
, ends AS (SELECT DISTINCT {DAY} AS day FROM spans),
window_ends AS (SELECT DISTINCT day + to_days(CAST(i AS INTEGER)) AS as_of FROM ends, generate_series(1, {days}) g(i)),
slid AS (SELECT w.as_of, s.* FROM window_ends w JOIN spans s ON s.timestamp >= w.as_of - INTERVAL {days} DAY AND s.timestamp < w.as_of)"""


@register("st_sliding_budget", over("spans", body=_sliding(7) + f"""
, counted AS (SELECT as_of, tier, count(*) AS total_requests, count(*) FILTER (WHERE has_error) AS failures
  FROM slid WHERE {TIERED} GROUP BY 1, 2)
SELECT as_of, tier, {_budget_select()} FROM counted"""))
def st_sliding_budget(spark, sf_dir):
    return run_available(aggregates.st_sliding_budget(_spans(spark, sf_dir), window="7 days", slide="1 day"))


@register("st_anomaly", over("spans", body=_sliding(7) + f"""
, stats AS (SELECT as_of, name AS activity, count(*) AS executions, round(avg(duration_nano) / 1000000, 2) AS avg_ms,
    round(stddev_pop(duration_nano) / 1000000, 2) AS std_ms, round(quantile_disc(duration_nano, 0.50) / 1000000, 2) AS p50_ms,
    round(quantile_disc(duration_nano, 0.95) / 1000000, 2) AS p95_ms, round(quantile_disc(duration_nano, 0.99) / 1000000, 2) AS p99_ms
  FROM slid WHERE {BASE} GROUP BY 1, 2 HAVING count(*) >= 10),
scored AS (SELECT *, (p99_ms - avg_ms) / nullif(std_ms, 0) AS z, (p95_ms - p50_ms) / nullif(p50_ms, 0) AS tail FROM stats)
SELECT as_of, activity, executions, p50_ms, p95_ms, p99_ms, round(z, 2) AS z_score, round(tail * 100, 1) AS tail_spread_pct,
  CASE WHEN z > 3 THEN 'ANOMALOUS' WHEN z > 2 THEN 'WARNING' WHEN tail > 1 THEN 'LONG TAIL' ELSE 'NORMAL' END AS health FROM scored"""))
def st_anomaly(spark, sf_dir):
    return run_available(aggregates.st_anomaly(_spans(spark, sf_dir), window="7 days", slide="1 day"))


@register("st_drift", over("spans", body=_drift_sql(7, 28)))
def st_drift(spark, sf_dir):
    stream = _spans(spark, sf_dir).select(
        "timestamp", "trace_id", "span_id", "name", "serviceName", "duration_nano", "has_error", "customer_tier"
    )
    table, report = scratch_path(spark, "drift-spans"), scratch_path(spark, "drift")
    query = ingest.st_drift(
        stream, table, report, scratch_path(spark, "state"), every=None, hourly=False, live="7 days", baseline="28 days"
    )
    query.awaitTermination()
    return spark.read.parquet(report)


@register("st_workflows", over("spans", body=f"""
 SELECT {DAY} AS ts, true AS within FROM spans WHERE name = 'activity.validate_order' AND serviceName = 'temporal-worker' GROUP BY 1"""))
def st_workflows(spark, sf_dir):
    """Whether the estimate of each window is within a tenth of the exact number of workflows."""
    guess = run_available(aggregates.st_workflows(_spans(spark, sf_dir), step="1 day"))
    rows = select_spans(spans(spark, sf_dir), name=S.VALIDATE_ORDER)
    exact = rows.groupBy(bucket_start(F.col("timestamp"), "1 day").alias("ts")).agg(F.count_distinct("trace_id").alias("n"))
    at = guess.withColumn("ts", F.col("ts").cast("timestamp_ntz"))
    return exact.withColumn("ts", F.col("ts").cast("timestamp_ntz")).join(at, "ts").select("ts", (F.abs(F.col("workflows") - F.col("n")) <= 0.1 * F.col("n") + 1).alias("within"))


@register("st_trace_log_join", over("spans", "logs", body="""
SELECT s.timestamp, s.trace_id, s.span_id, s.name, s.has_error, l.timestamp AS log_timestamp, l.severity_text, l.body
FROM spans s JOIN logs l ON l.trace_id = s.trace_id AND l.span_id = s.span_id
WHERE l.severity_text IN ('ERROR', 'WARN') AND l.timestamp BETWEEN s.timestamp AND s.timestamp + INTERVAL 1 MINUTE"""))
def st_trace_log_join(spark, sf_dir):
    """The matched side of the outer join; spans without a log stay open until their bound has passed."""
    logs = views.logs(views.stream(spark, sf_dir, "events"))
    joined = joins.st_trace_log_join(_spans(spark, sf_dir), logs)
    return run_available(joined, "append").where("log_timestamp IS NOT NULL")


@register("st_workflow_outcome", over("workflow", body=OUTCOME_SQL + """
SELECT trace_id, tier, spans, status, total_charged, fraud_score, shipping_eta, last_at + INTERVAL 10 MINUTE AS closed_at FROM outcome"""))
def st_workflow_outcome(spark, sf_dir):
    stream = views.workflow_spans(views.stream(spark, sf_dir, "orders"))
    return run_available(joins.st_workflow_outcome(stream))


@register("st_workflow_close", over("workflow", body=OUTCOME_SQL + """
, shipped AS (SELECT trace_id, max(timestamp) FILTER (WHERE place = 5 AND NOT has_error) AS shipped_at FROM spans GROUP BY 1)
SELECT trace_id, tier, spans, status, total_charged, fraud_score, shipping_eta, 1 AS revision,
  CASE WHEN status = 'completed' THEN shipped_at + INTERVAL 30 SECOND ELSE last_at + INTERVAL 10 MINUTE END AS closed_at
FROM outcome JOIN shipped USING (trace_id)"""))
def st_workflow_close(spark, sf_dir):
    """Every workflow is closed; one row long after the others moves the watermark."""
    stream = _with_closing(spark, sf_dir, "orders", "o_orderkey", "o_orderdate", views.workflow_spans)
    with workflows.state_store(spark):
        return run_available(workflows.st_workflow_close(stream), "append")


@register("st_sliding_budget_panes", ORACLES["st_sliding_budget"])
def st_sliding_budget_panes(spark, sf_dir):
    stream = _with_closing(spark, sf_dir, "events", "event_id", "ts", views.spans, event_type="signup", user_id=0)
    return run_available(panes.budget_panes(stream, window="7 days", slide="1 day"), "append")


@register("st_anomaly_panes", ORACLES["st_anomaly"])
def st_anomaly_panes(spark, sf_dir):
    """With sketches large enough to be exact on the given tables."""
    stream = _with_closing(spark, sf_dir, "events", "event_id", "ts", views.spans, event_type="signup", user_id=0)
    return run_available(panes.anomaly_panes(stream, window="7 days", slide="1 day", sketch_k=32768), "append")


_LAST_DAY = "(SELECT max(time_bucket(INTERVAL '1 day', timestamp)) + INTERVAL 1 DAY FROM spans)"


@register("st_drift_view", over("spans", body=f"""
, fleet AS (SELECT quantile_disc(duration_nano, 0.99) / 1000000 AS g FROM spans WHERE {BASE} AND timestamp >= {_LAST_DAY} - INTERVAL 28 DAY),
live AS (
  SELECT tier, count(*) AS total_spans, round(quantile_disc(duration_nano, 0.99) / 1000000, 2) AS p99_ms,
    round(count(*) FILTER (WHERE has_error) * CAST(100 AS DOUBLE) / count(*), 2) AS error_rate_pct
  FROM spans WHERE {TIERED} AND timestamp >= {_LAST_DAY} - INTERVAL 7 DAY GROUP BY tier HAVING count(*) >= 5),
compared AS (SELECT *, (p99_ms - g) / nullif(g, 0) AS drift FROM live, fleet)
SELECT {_LAST_DAY} AS as_of, tier, p99_ms, round(g, 2) AS baseline_p99_ms, round(drift * 100, 1) AS drift_pct, error_rate_pct, total_spans,
  CASE WHEN drift > 1.0 THEN 'CRITICAL' WHEN drift > 0.5 THEN 'DRIFTING' WHEN drift > 0.1 THEN 'ELEVATED'
    WHEN drift < -0.1 THEN 'UNDER-BASELINE' ELSE 'HEALTHY' END AS status
FROM compared"""))
def st_drift_view(spark, sf_dir):
    """Panes of a day; sketches large enough to be exact on the given tables."""
    store, report = scratch_path(spark, "panes"), scratch_path(spark, "drift-view")
    panes.st_drift_view(
        _spans(spark, sf_dir), store, report, scratch_path(spark, "state"), every=None, pane="1 day", live="7 days", baseline="28 days",
        sketch_k=65535,
    ).awaitTermination()
    return spark.read.parquet(report)


@register("st_span_logs", over("spans", "logs", body="""
, bad AS (SELECT * FROM logs WHERE severity_text IN ('ERROR', 'WARN')),
placed AS (
  SELECT l.trace_id, arg_min(s.span_id, (s.timestamp, s.span_id)) AS span_id, l.timestamp, l.severity_text, l.body
  FROM bad l JOIN spans s ON s.trace_id = l.trace_id AND s.timestamp BETWEEN l.timestamp - INTERVAL 1 MINUTE AND l.timestamp
  WHERE l.span_id IS NULL GROUP BY l.trace_id, l.timestamp, l.severity_text, l.body),
every AS (SELECT trace_id, span_id, timestamp, severity_text, body FROM bad WHERE span_id IS NOT NULL UNION ALL SELECT * FROM placed)
SELECT s.timestamp, s.trace_id, s.span_id, s.name, s.has_error, l.timestamp AS log_timestamp, l.severity_text, l.body
FROM spans s LEFT JOIN every l ON l.trace_id = s.trace_id AND l.span_id = s.span_id AND l.timestamp BETWEEN s.timestamp AND s.timestamp + INTERVAL 1 MINUTE"""))
def st_span_logs(spark, sf_dir):
    """Both sides of the outer join: every span closes, as one span and one log without a span id come long after all others."""
    # A key whose log is an error without a span id, so that it waits for a watermark that never comes.
    closing = {"number": 159 * 10_000_000 + 3, "event_type": "signup"}
    rows = _with_closing(spark, sf_dir, "events", "event_id", "ts", views.spans, **closing)
    entries = _with_closing(spark, sf_dir, "events", "event_id", "ts", views.logs, **closing)
    return run_available(joins.st_span_logs(rows, entries), "append")
