"""The service level reports, series and workflow reconstructions."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks.registry import ORACLES, TARGET, logs, metric_points, over, register, spans, workflow_spans
from spanops.functions.predicates import latest
from spanops.operators import correlate, latency, slo, timeseries, workflow
from spanops.plans import panels
from spanops.session import materialize, scratch_path

NEWEST = "(SELECT max(timestamp) FROM spans)"
BASE = "name LIKE 'activity.%' AND serviceName = 'temporal-worker'"
TIERED = BASE + " AND tier <> ''"
ERRORS = "count(*) FILTER (WHERE has_error)"
DAY = "time_bucket(INTERVAL '1 day', timestamp)"


def recent(days: int) -> str:
    return f"timestamp >= {NEWEST} - INTERVAL {days} DAY AND timestamp <= {NEWEST}"


def _zscore_sql(where: str, icons: bool = False, p: str = "quantile_cont") -> str:
    a, w, l, n = ("🔴 ", "🟡 ", "🟠 ", "🟢 ") if icons else ("", "", "", "")
    return f"""
, stats AS (
  SELECT name AS activity, count(*) AS executions, round(avg(duration_nano) / 1000000, 2) AS avg_ms,
    round(stddev_pop(duration_nano) / 1000000, 2) AS std_ms,
    round({p}(duration_nano, 0.50) / 1000000, 2) AS p50_ms,
    round({p}(duration_nano, 0.95) / 1000000, 2) AS p95_ms,
    round({p}(duration_nano, 0.99) / 1000000, 2) AS p99_ms
  FROM spans WHERE {BASE} AND {where} GROUP BY name HAVING count(*) >= 10),
scored AS (SELECT *, (p99_ms - avg_ms) / nullif(std_ms, 0) AS z, (p95_ms - p50_ms) / nullif(p50_ms, 0) AS tail FROM stats)
SELECT activity, executions, p50_ms, p95_ms, p99_ms, round(z, 2) AS z_score, round(tail * 100, 1) AS tail_spread_pct,
  CASE WHEN z > 3 THEN '{a}ANOMALOUS' WHEN z > 2 THEN '{w}WARNING' WHEN tail > 1 THEN '{l}LONG TAIL' ELSE '{n}NORMAL' END AS health
FROM scored"""


def _drift_sql(live: int, base: int, icons: bool = False) -> str:
    c, d, e, u, h = ("🔴 ", "🟡 ", "🟠 ", "🔵 ", "🟢 ") if icons else ("",) * 5
    return f"""
, fleet AS (SELECT quantile_cont(duration_nano, 0.99) / 1000000 AS g FROM spans WHERE {BASE} AND {recent(base)}),
live AS (
  SELECT tier, count(*) AS total_spans, round(quantile_cont(duration_nano, 0.99) / 1000000, 2) AS p99_ms,
    round({ERRORS} * CAST(100 AS DOUBLE) / count(*), 2) AS error_rate_pct
  FROM spans WHERE {TIERED} AND {recent(live)} GROUP BY tier HAVING count(*) >= 5),
compared AS (SELECT *, (p99_ms - g) / nullif(g, 0) AS drift FROM live, fleet)
SELECT tier, p99_ms, round(g, 2) AS baseline_p99_ms, round(drift * 100, 1) AS drift_pct, error_rate_pct, total_spans,
  CASE WHEN drift > 1.0 THEN '{c}CRITICAL' WHEN drift > 0.5 THEN '{d}DRIFTING' WHEN drift > 0.1 THEN '{e}ELEVATED'
    WHEN drift < -0.1 THEN '{u}UNDER-BASELINE' ELSE '{h}HEALTHY' END AS status
FROM compared"""


def _budget_select(icons: bool = False) -> str:
    x, r, b, w = ("🔴 ", "🟡 ", "🟠 ", "🟢 ") if icons else ("",) * 4
    return f"""total_requests, failures, {TARGET} * 100 AS slo_target_pct,
  round((1 - CAST(failures AS DOUBLE) / nullif(total_requests, 0)) * 100, 3) AS actual_uptime_pct,
  round((1 - {TARGET}) * total_requests, 1) AS error_budget, failures AS budget_consumed,
  round(CAST(failures AS DOUBLE) / nullif((1 - {TARGET}) * total_requests, 0) * 100, 1) AS budget_burn_pct,
  CASE WHEN CAST(failures AS DOUBLE) / nullif((1 - {TARGET}) * total_requests, 0) > 1.0 THEN '{x}BUDGET EXHAUSTED'
    WHEN CAST(failures AS DOUBLE) / nullif((1 - {TARGET}) * total_requests, 0) > 0.7 THEN '{r}BUDGET AT RISK'
    WHEN CAST(failures AS DOUBLE) / nullif((1 - {TARGET}) * total_requests, 0) > 0.4 THEN '{b}BURNING FAST'
    ELSE '{w}WITHIN BUDGET' END AS status"""


def _budget_sql(where: str = "true", icons: bool = False) -> str:
    return f"""
, counted AS (SELECT tier, count(*) AS total_requests, {ERRORS} AS failures FROM spans WHERE {TIERED} AND {where} GROUP BY tier)
SELECT tier, {_budget_select(icons)} FROM counted"""


TIMEOUT_SQL = f"""
SELECT round(count(*) FILTER (WHERE duration_nano / 1000000 > 1000) * CAST(100 AS DOUBLE) / nullif(count(*), 0), 1) AS value
FROM spans WHERE name = 'activity.check_fraud' AND serviceName = 'temporal-worker'"""
REMAINING_SQL = f"""
SELECT round(100 - {ERRORS} * CAST(100 AS DOUBLE) / nullif((1 - CAST(0.999 AS DOUBLE)) * count(*), 0), 1) AS value
FROM spans WHERE {BASE} AND tier = 'enterprise'"""
PROCESSED_SQL = """
SELECT count(DISTINCT trace_id) AS value FROM spans WHERE name = 'activity.validate_order' AND serviceName = 'temporal-worker'"""
BURN_SQL = f"""
, counted AS (SELECT {DAY} AS ts, tier, count(*) AS n, {ERRORS} AS errors FROM spans WHERE {TIERED} GROUP BY 1, 2)
SELECT ts, tier, round(errors * CAST(100 AS DOUBLE) / nullif((1 - {TARGET}) * n, 0), 1) AS burn_rate_pct FROM counted"""
TRAFFIC_SQL = f"""
SELECT {DAY} AS ts, tier, count(*) AS requests FROM spans WHERE {TIERED} GROUP BY 1, 2"""
P99_SQL = f"""
SELECT {DAY} AS ts, name AS activity, round(quantile_cont(duration_nano, 0.99) / 1000000, 2) AS p99_ms
FROM spans WHERE {BASE} GROUP BY 1, 2"""
STEPS_SQL = f"""
SELECT {DAY} AS ts, name AS activity, round(avg(duration_nano) / 1000000, 2) AS avg_ms FROM spans WHERE {BASE} GROUP BY 1, 2"""
ERROR_RATE_SQL = f"""
SELECT {DAY} AS ts, name AS activity, count(*) AS total_spans, {ERRORS} AS error_spans,
  round({ERRORS} * CAST(100 AS DOUBLE) / count(*), 2) AS error_rate_pct
FROM spans WHERE {BASE} GROUP BY 1, 2 HAVING {ERRORS} > 0"""


@register("zscore_anomaly", over("spans", body=_zscore_sql(recent(14))))
def zscore_anomaly(spark, sf_dir):
    s = spans(spark, sf_dir)
    return latency.zscore_anomaly(s, as_of=latest(s), window="14 days")


@register("latency_drift", over("spans", body=_drift_sql(7, 28)))
def latency_drift(spark, sf_dir):
    s = spans(spark, sf_dir)
    return latency.latency_drift(s, as_of=latest(s), live="7 days", baseline="28 days")


@register("slo_budget", over("spans", body=_budget_sql()))
def slo_budget(spark, sf_dir):
    return slo.slo_budget(spans(spark, sf_dir), window=None)


@register("slo_budget_by_trace", over("spans", body=f"""
, traces AS (SELECT max(tier) AS tier, trace_id, bool_or(has_error) AS has_error FROM spans WHERE {BASE} GROUP BY trace_id),
counted AS (SELECT tier, count(*) AS total_requests, {ERRORS} AS failures FROM traces WHERE tier <> '' GROUP BY tier)
SELECT tier, {_budget_select()} FROM counted"""))
def slo_budget_by_trace(spark, sf_dir):
    return slo.slo_budget(spans(spark, sf_dir), window=None, grain="trace")


@register("timeout_rate", over("spans", body=TIMEOUT_SQL))
def timeout_rate(spark, sf_dir):
    return slo.timeout_rate(spans(spark, sf_dir), window=None)


@register("budget_remaining", over("spans", body=REMAINING_SQL))
def budget_remaining(spark, sf_dir):
    return slo.budget_remaining(spans(spark, sf_dir), window=None)


@register("workflows_processed", over("spans", body=PROCESSED_SQL))
def workflows_processed(spark, sf_dir):
    return slo.workflows_processed(spans(spark, sf_dir), window=None)


@register("burn_rate_ts", over("spans", body=BURN_SQL))
def burn_rate_ts(spark, sf_dir):
    return slo.burn_rate_ts(spans(spark, sf_dir), window=None, step="1 day")


@register("traffic_ts", over("spans", body=TRAFFIC_SQL))
def traffic_ts(spark, sf_dir):
    return timeseries.traffic_ts(spans(spark, sf_dir), window=None, step="1 day")


@register("p99_trend_ts", over("spans", body=P99_SQL))
def p99_trend_ts(spark, sf_dir):
    return timeseries.p99_trend_ts(spans(spark, sf_dir), window=None, step="1 day")


@register("step_breakdown_ts", over("spans", body=f"""
, series AS (SELECT {DAY} AS ts, name AS activity, round(avg(duration_nano) / 1000000, 2) AS avg_ms FROM spans WHERE {BASE} GROUP BY 1, 2),
grid AS (SELECT unnest(generate_series((SELECT min(ts) FROM series), (SELECT max(ts) FROM series), INTERVAL '1 day')) AS ts)
SELECT g.ts, a.activity, coalesce(s.avg_ms, 0) AS avg_ms
FROM grid g, (SELECT DISTINCT activity FROM series) a LEFT JOIN series s ON s.ts = g.ts AND s.activity = a.activity"""))
def step_breakdown_ts(spark, sf_dir):
    series = timeseries.step_breakdown_ts(spans(spark, sf_dir), window=None, step="1 day")
    return timeseries.gap_fill(series, keys=["activity"], value="avg_ms", step="1 day")


@register("error_rate_ts", over("spans", body=ERROR_RATE_SQL))
def error_rate_ts(spark, sf_dir):
    return timeseries.error_rate_ts(spans(spark, sf_dir), window=None, step="1 day")


@register("p99_by_tier_ts", over("spans", body=f"""
SELECT {DAY} AS ts, tier AS customer_tier, round(quantile_cont(duration_nano, 0.99), 2) AS value FROM spans
WHERE timestamp BETWEEN TIMESTAMP '2024-01-05 00:00:00' AND TIMESTAMP '2024-01-20 12:00:00'
  AND ts_bucket_start BETWEEN epoch(TIMESTAMP '2024-01-05 00:00:00') - 1800 AND epoch(TIMESTAMP '2024-01-20 12:00:00')
  AND name = 'activity.check_fraud' AND tier IS NOT NULL GROUP BY 1, 2"""))
def p99_by_tier_ts(spark, sf_dir):
    out = timeseries.p99_by_tier_ts(
        spans(spark, sf_dir), start="2024-01-05 00:00:00", end="2024-01-20 12:00:00", step="1 day"
    )
    return out.withColumn("value", F.round("value", 2))


@register("latency_histogram", over("spans", body=f"""
SELECT name AS activity, floor(duration_nano / 1000000 / CAST(100 AS DOUBLE)) * 100 AS bucket_ms, count(*) AS spans
FROM spans WHERE {BASE} GROUP BY 1, 2"""))
def latency_histogram(spark, sf_dir):
    return latency.latency_histogram(spans(spark, sf_dir), window=None)


@register("gap_fill", over("spans", body=f"""
, series AS (SELECT time_bucket(INTERVAL '6 hours', timestamp) AS ts, name AS activity, {ERRORS} AS errors FROM spans
  GROUP BY 1, 2 HAVING {ERRORS} > 0),
grid AS (SELECT unnest(generate_series((SELECT min(ts) FROM series), (SELECT max(ts) FROM series), INTERVAL '6 hours')) AS ts)
SELECT g.ts, a.activity, coalesce(s.errors, 0) AS errors
FROM grid g, (SELECT DISTINCT activity FROM series) a LEFT JOIN series s ON s.ts = g.ts AND s.activity = a.activity"""))
def gap_fill(spark, sf_dir):
    s = spans(spark, sf_dir)
    counted = s.groupBy(F.window("timestamp", "6 hours").alias("w"), F.col("name").alias("activity")).agg(
        F.count_if("has_error").alias("errors")
    )
    series = counted.where("errors > 0").select(F.col("w.start").alias("ts"), "activity", "errors")
    return timeseries.gap_fill(series, keys=["activity"], value="errors", step="6 hours")


@register("series_pivot", over("spans", body=f"""
SELECT {DAY} AS ts, nullif(count(*) FILTER (WHERE tier = 'enterprise'), 0) AS enterprise,
  nullif(count(*) FILTER (WHERE tier = 'pro'), 0) AS pro, nullif(count(*) FILTER (WHERE tier = 'free'), 0) AS free
FROM spans WHERE {TIERED} GROUP BY 1"""))
def series_pivot(spark, sf_dir):
    series = timeseries.traffic_ts(spans(spark, sf_dir), window=None, step="1 day")
    return timeseries.series_pivot(series, key="tier", value="requests", values=["enterprise", "pro", "free"])


@register("rolling_drift", over("spans", body=f"""
, live AS (SELECT {DAY} + INTERVAL '1 day' AS slot_end, tier, count(*) AS total_spans,
    round(quantile_cont(duration_nano, 0.99) / 1000000, 2) AS p99_ms
  FROM spans WHERE {TIERED} GROUP BY 1, 2 HAVING count(*) >= 5),
ends AS (SELECT DISTINCT slot_end FROM live),
fleet AS (SELECT e.slot_end, quantile_cont(s.duration_nano, 0.99) / 1000000 AS g
  FROM ends e JOIN spans s ON s.timestamp >= e.slot_end - INTERVAL '4 days' AND s.timestamp < e.slot_end
  WHERE {BASE} GROUP BY 1),
compared AS (SELECT *, (p99_ms - g) / nullif(g, 0) AS drift FROM live JOIN fleet USING (slot_end))
SELECT slot_end, tier, total_spans, p99_ms, round(g, 2) AS baseline_p99_ms, round(drift * 100, 1) AS drift_pct,
  CASE WHEN drift > 1.0 THEN 'CRITICAL' WHEN drift > 0.5 THEN 'DRIFTING' WHEN drift > 0.1 THEN 'ELEVATED'
    WHEN drift < -0.1 THEN 'UNDER-BASELINE' ELSE 'HEALTHY' END AS status
FROM compared"""))
def rolling_drift(spark, sf_dir):
    return latency.rolling_drift(spans(spark, sf_dir), window=None, slot="1 day", baseline="4 days")


@register("budget_forecast", over("spans", body=f"""
, counted AS (SELECT {DAY} AS ts, tier, count(*) AS n, {ERRORS} AS failed FROM spans WHERE {TIERED} AND {recent(30)} GROUP BY 1, 2),
running AS (SELECT *, CAST(sum(n) OVER (PARTITION BY tier ORDER BY ts) AS BIGINT) AS total_n,
    CAST(sum(failed) OVER (PARTITION BY tier ORDER BY ts) AS BIGINT) AS total_failed,
    CAST(sum(failed) OVER (PARTITION BY tier ORDER BY ts RANGE BETWEEN INTERVAL '5 days' PRECEDING AND CURRENT ROW) AS DOUBLE) / 6 AS rate
  FROM counted),
budgeted AS (SELECT *, (1 - {TARGET}) * total_n AS budget FROM running)
SELECT ts, tier, n, failed, total_failed, round(budget, 3) AS budget, round(budget - total_failed, 3) AS remaining,
  round(rate, 4) AS recent_rate,
  round(CASE WHEN budget - total_failed <= 0 THEN 0 ELSE (budget - total_failed) / nullif(rate, 0) END, 2) AS eta_buckets
FROM budgeted"""))
def budget_forecast(spark, sf_dir):
    s = spans(spark, sf_dir)
    return slo.budget_forecast(s, as_of=latest(s), window="30 days", step="1 day", recent=6)


PEERS_SQL = f"""
, p AS (SELECT name AS activity, quantile_cont(duration_nano, 0.99) AS p99 FROM spans WHERE {BASE} GROUP BY name),
m AS (SELECT a.activity, any_value(a.p99) AS p99, quantile_cont(b.p99, 0.5) AS peers
  FROM p a JOIN p b ON a.activity <> b.activity GROUP BY a.activity),
peer AS (SELECT activity, round(p99 / 1000000, 2) AS p99_ms, round(peers / 1000000, 2) AS peer_median_p99_ms,
  round(p99 / nullif(peers, 0), 2) AS peer_ratio FROM m)"""


@register("peer_latency_ratio", over("spans", body=PEERS_SQL + " SELECT * FROM peer"))
def peer_latency_ratio(spark, sf_dir):
    return latency.peer_latency_ratio(spans(spark, sf_dir), window=None)


@register("silent_failure", over("spans", body=PEERS_SQL + f"""
, counted AS (SELECT name AS activity, count(*) AS executions,
    count(*) FILTER (WHERE duration_nano / 1000000 > 1000 AND NOT has_error) AS silent_spans,
    round(count(*) FILTER (WHERE duration_nano / 1000000 > 1000 AND NOT has_error) * CAST(100 AS DOUBLE) / count(*), 2) AS silent_pct
  FROM spans WHERE {BASE} GROUP BY name),
tiers AS (SELECT name AS activity, tier, quantile_cont(duration_nano, 0.99) AS q FROM spans WHERE {TIERED} GROUP BY 1, 2),
spread AS (SELECT activity, round((max(q) - min(q)) / nullif(max(q), 0) * 100, 2) AS tier_spread_pct FROM tiers GROUP BY 1)
SELECT c.*, p99_ms, peer_ratio, tier_spread_pct,
  CASE WHEN peer_ratio >= 10 AND tier_spread_pct < 2 THEN 'SYSTEMIC' WHEN peer_ratio >= 10 THEN 'SLOW' ELSE 'OK' END AS verdict
FROM counted c LEFT JOIN peer USING (activity) LEFT JOIN spread USING (activity)"""))
def silent_failure(spark, sf_dir):
    return latency.silent_failure(spans(spark, sf_dir), window=None)


OUTCOME_SQL = """
, ranked AS (SELECT *, row_number() OVER (PARTITION BY trace_id ORDER BY place DESC, timestamp DESC, span_id DESC) AS rn
  FROM spans WHERE place <= 5),
furthest AS (SELECT trace_id, place, name, has_error FROM ranked WHERE rn = 1),
facts AS (SELECT trace_id, max(tier) AS tier, count(*) AS spans,
    max(CASE WHEN place = 2 AND NOT has_error THEN score END) AS fraud_score,
    bool_or(place = 3) AS tried,
    max(CASE WHEN place = 3 AND NOT has_error THEN amount * CAST(1.08 AS DOUBLE) END) AS charged,
    max(CASE WHEN place = 5 AND NOT has_error THEN strftime(timestamp + CASE t WHEN 'enterprise' THEN INTERVAL 24 HOUR
      WHEN 'pro' THEN INTERVAL 48 HOUR ELSE INTERVAL 120 HOUR END, '%Y-%m-%d') END) AS shipping_eta,
    max(timestamp) AS last_at
  FROM spans GROUP BY trace_id),
outcome AS (SELECT trace_id, tier, spans,
  CASE WHEN place = 5 AND NOT has_error THEN 'completed' WHEN fraud_score > 0.8 AND NOT tried THEN 'rejected_fraud'
    WHEN has_error THEN 'failed:' || split_part(name, '.', 2) ELSE 'in_flight' END AS status,
  round(charged, 2) AS total_charged, round(fraud_score, 4) AS fraud_score, shipping_eta, last_at
FROM facts JOIN furthest USING (trace_id))"""


@register("workflow_outcome", over("workflow", body=OUTCOME_SQL + " SELECT * EXCLUDE (last_at) FROM outcome"))
def workflow_outcome(spark, sf_dir):
    return workflow.workflow_outcome(workflow_spans(spark, sf_dir))


@register("workflow_latency", over("workflow", body="""
, traces AS (SELECT trace_id, max(tier) AS tier,
    max(epoch_us(timestamp) * 1000 + duration_nano) - min(epoch_us(timestamp) * 1000) AS total FROM spans GROUP BY 1)
SELECT tier, count(*) AS workflows, round(quantile_cont(total, 0.5) / 1000000, 2) AS p50_ms,
  round(quantile_cont(total, 0.95) / 1000000, 2) AS p95_ms, round(quantile_cont(total, 0.99) / 1000000, 2) AS p99_ms,
  round(max(total) / 1000000, 2) AS max_ms FROM traces GROUP BY tier"""))
def workflow_latency(spark, sf_dir):
    return latency.workflow_latency(workflow_spans(spark, sf_dir), window=None)


@register("retry_attempts", over("workflow", body="""
, steps AS (SELECT trace_id, name, count(*) AS attempts, arg_max(has_error, attempt) AS last_failed, any_value(t) AS tier
  FROM spans WHERE place <= 5 GROUP BY 1, 2),
allowed AS (SELECT *, CASE tier WHEN 'enterprise' THEN 5 WHEN 'pro' THEN 3 ELSE 2 END AS most FROM steps)
SELECT tier, name AS activity, count(*) AS workflows, CAST(sum(attempts) AS BIGINT) AS attempts, max(attempts) AS most_attempts,
  CAST(max(most) AS BIGINT) AS max_attempts, count(*) FILTER (WHERE attempts > 1) AS retried,
  count(*) FILTER (WHERE last_failed AND attempts >= most) AS exhausted,
  round(count(*) FILTER (WHERE last_failed AND attempts >= most) / CAST(count(*) AS DOUBLE) * 100, 2) AS exhausted_pct
FROM allowed GROUP BY 1, 2"""))
def retry_attempts(spark, sf_dir):
    return workflow.retry_attempts(workflow_spans(spark, sf_dir))


@register("failure_reasons", over("workflow", body="""
SELECT name AS activity, reason, coalesce(tier, '') AS tier, count(*) AS failures FROM spans
WHERE reason IS NOT NULL GROUP BY 1, 2, 3"""))
def failure_reasons(spark, sf_dir):
    return workflow.failure_reasons(workflow_spans(spark, sf_dir))


@register("compensation_audit", over("workflow", body="""
, flags AS (SELECT trace_id, coalesce(arg_max(has_error, attempt) FILTER (WHERE place = 4), false) AS inv,
    coalesce(arg_max(has_error, attempt) FILTER (WHERE place = 5), false) AS ship,
    bool_or(place = 6) AS refunded, bool_or(place = 3 AND NOT has_error) AS paid FROM spans GROUP BY 1),
audited AS (SELECT trace_id, CASE WHEN inv AND refunded THEN 'refunded' WHEN inv THEN 'missing_refund'
    WHEN refunded THEN 'refund_without_failure' WHEN ship AND paid THEN 'charged_not_refunded' END AS audit, paid FROM flags)
SELECT * FROM audited WHERE audit IS NOT NULL"""))
def compensation_audit(spark, sf_dir):
    return workflow.compensation_audit(workflow_spans(spark, sf_dir))


@register("tier_backfill", over("spans", body="""
, tiers AS (SELECT trace_id, max(tier) AS known FROM spans WHERE tier <> '' GROUP BY 1)
SELECT span_id, name, coalesce(tier, known) AS tier FROM spans LEFT JOIN tiers USING (trace_id)"""))
def tier_backfill(spark, sf_dir):
    return correlate.tier_backfill(spans(spark, sf_dir)).select("span_id", "name", "tier")


_PANEL_SQL = {
    "value-fraud-timeout": (TIMEOUT_SQL, ["value"]),
    "value-enterprise-budget": (REMAINING_SQL, ["value"]),
    "value-workflows-processed": (PROCESSED_SQL, ["value"]),
    "ts-traffic-by-tier": (TRAFFIC_SQL, ["requests"]),
    "ts-burn-rate": (BURN_SQL, ["burn_rate_pct"]),
    "ts-p99-trend": (P99_SQL, ["p99_ms"]),
    "ts-step-breakdown": (STEPS_SQL, ["avg_ms"]),
    "table-zscore": (
        _zscore_sql(recent(14), icons=True),
        ["executions", "p50_ms", "p95_ms", "p99_ms", "z_score", "tail_spread_pct", "health"],
    ),
    "table-drift": (
        _drift_sql(7, 28, icons=True),
        ["p99_ms", "baseline_p99_ms", "drift_pct", "error_rate_pct", "total_spans", "status"],
    ),
    "table-slo-budget": (
        _budget_sql(icons=True),
        ["total_requests", "failures", "slo_target_pct", "actual_uptime_pct", "error_budget", "budget_consumed",
         "budget_burn_pct", "status"],
    ),
}
_WORDS = ("health", "status")
_PANEL_WINDOWS = dict.fromkeys(_PANEL_SQL, None) | {"table-zscore": "14 days", "table-drift": "7 days"}


def _panels_sql() -> str:
    """Every panel's own SQL, turned long."""
    parts = []
    for panel, (sql, values) in _PANEL_SQL.items():
        label = "tier" if "tier" in panel or panel in ("ts-burn-rate", "table-drift", "table-slo-budget") else "activity"
        label = f"coalesce({label}, '')" if panel[:5] != "value" else "''"
        at = "ts" if panel[:2] == "ts" else "CAST(NULL AS TIMESTAMP)"
        inner = over("spans", body=sql)
        for value in values:
            number = "CAST(NULL AS DOUBLE)" if value in _WORDS else f"CAST({value} AS DOUBLE)"
            text = value if value in _WORDS else "CAST(NULL AS VARCHAR)"
            parts.append(
                f"SELECT '{panel}' AS panel, {label} AS label, {at} AS ts, '{value}' AS measure, {number} AS number, "
                f"{text} AS word FROM ({inner})"
            )
    return " UNION ALL ".join(parts)


def _pack(spark, sf_dir):
    s = spans(spark, sf_dir)
    return s, {
        "as_of": latest(s),
        "windows": _PANEL_WINDOWS,
        "baseline": "28 days",
        "burn_step": "1 day",
        "series_step": "1 day",
    }


@register("panel_pack", _panels_sql())
def panel_pack(spark, sf_dir):
    s, options = _pack(spark, sf_dir)
    return panels.long_panels(panels.panel_pack(s, **options))


@register("sink_panels", _panels_sql())
def sink_panels(spark, sf_dir):
    s, options = _pack(spark, sf_dir)
    path = scratch_path(spark, "panels")
    names = panels.sink_panels(s, path, base_window=None, **options)
    return panels.long_panels({name: spark.read.parquet(f"{path}/{name}") for name in names})


@register("tag_query", over("spans", body=TRAFFIC_SQL))
def tag_query(spark, sf_dir):
    frame = timeseries.traffic_ts(spans(spark, sf_dir), window=None, step="1 day")
    with panels.tag_query(spark, "traffic by tier | whole table"):
        return materialize(frame, "tagged")


@register("cross_baseline", over("spans", body="""
, g AS (SELECT count(*) AS all_spans, round(avg(duration_nano) / 1e6, 3) AS all_avg_ms FROM spans)
SELECT name, count(*) AS n, any_value(all_spans) AS all_spans, any_value(all_avg_ms) AS all_avg_ms FROM spans, g GROUP BY name"""))
def cross_baseline(spark, sf_dir):
    s = spans(spark, sf_dir)
    grouped = s.groupBy("name").agg(F.count("*").alias("n"))
    total = s.agg(F.count("*").alias("all_spans"), F.round(F.avg("duration_nano") / 1e6, 3).alias("all_avg_ms"))
    return correlate.cross_baseline(grouped, total, ["all_spans", "all_avg_ms"])


@register("trace_log_correlation", over("spans", "logs", body=f"""
, bad AS (SELECT * FROM logs WHERE severity_text IN ('ERROR', 'WARN')),
rows_ AS (SELECT timestamp, trace_id, span_id, name, has_error FROM spans WHERE {BASE}),
own AS (SELECT trace_id, span_id, count(*) AS c, min(body) AS body FROM bad WHERE span_id <> '' GROUP BY 1, 2),
loose AS (SELECT trace_id, count(*) AS c, min(body) AS body FROM bad WHERE span_id IS NULL GROUP BY 1),
firsts AS (SELECT trace_id, arg_min(span_id, timestamp) AS span_id FROM rows_ GROUP BY 1),
placed AS (SELECT * FROM own UNION ALL SELECT trace_id, span_id, c, body FROM firsts JOIN loose USING (trace_id)),
combined AS (SELECT trace_id, span_id, sum(c) AS c, min(body) AS body FROM placed GROUP BY 1, 2),
joined AS (SELECT r.*, coalesce(c.c, 0) AS c, c.body FROM rows_ r LEFT JOIN combined c USING (trace_id, span_id))
SELECT {DAY} AS ts, name AS activity, count(*) AS total_spans, {ERRORS} AS error_spans, CAST(sum(c) AS BIGINT) AS bad_logs,
  count(*) FILTER (WHERE NOT has_error AND c > 0) AS logged_without_error, min(body) AS sample_body
FROM joined GROUP BY 1, 2 HAVING {ERRORS} > 0 OR sum(c) > 0"""))
def trace_log_correlation(spark, sf_dir):
    return correlate.trace_log_correlation(spans(spark, sf_dir), logs(spark, sf_dir), window=None, step="1 day")


@register("error_logs_for_failed", over("spans", "logs", body="""
SELECT timestamp, trace_id, severity_text, body FROM logs WHERE severity_text IN ('ERROR', 'WARN')
  AND trace_id IN (SELECT trace_id FROM spans WHERE has_error)"""))
def error_logs_for_failed(spark, sf_dir):
    found = correlate.error_logs_for_failed(spans(spark, sf_dir), logs(spark, sf_dir))
    return found.select("timestamp", "trace_id", "severity_text", "body")


@register("unlogged_failures", over("spans", "logs", body="""
SELECT timestamp, trace_id, span_id, name FROM spans WHERE has_error
  AND trace_id NOT IN (SELECT trace_id FROM logs WHERE severity_text IN ('ERROR', 'WARN'))"""))
def unlogged_failures(spark, sf_dir):
    found = correlate.unlogged_failures(spans(spark, sf_dir), logs(spark, sf_dir))
    return found.select("timestamp", "trace_id", "span_id", "name")


@register("metric_trace_link", over("spans", "metrics", body=f"""
, m AS (SELECT {DAY} AS ts, serviceName, count(*) AS points, round(avg(gauge), 4) AS metric_avg FROM metric_points GROUP BY 1, 2),
t AS (SELECT {DAY} AS ts, serviceName, count(*) AS total_spans, {ERRORS} AS error_spans,
  count(*) FILTER (WHERE duration_nano > 1000000000) AS slow_spans FROM spans GROUP BY 1, 2)
SELECT ts, serviceName, points, metric_avg, coalesce(total_spans, 0) AS total_spans, coalesce(error_spans, 0) AS error_spans,
  coalesce(slow_spans, 0) AS slow_spans FROM m LEFT JOIN t USING (ts, serviceName)"""))
def metric_trace_link(spark, sf_dir):
    return correlate.metric_trace_link(
        metric_points(spark, sf_dir), spans(spark, sf_dir), metric="queue.depth", step="1 day"
    )


@register("parent_child", over("spans", body="""
, kids AS (SELECT trace_id, parent_span_id AS span_id, count(*) AS child_count, sum(duration_nano) AS child_nano
  FROM spans WHERE parent_span_id IS NOT NULL GROUP BY 1, 2)
SELECT s.trace_id, s.span_id, s.parent_span_id, s.name, p.name AS parent_name, s.timestamp, s.duration_nano,
  CAST(CASE s.event_id % 5 WHEN 0 THEN 0 WHEN 1 THEN 1 WHEN 2 THEN 1 ELSE 2 END AS BIGINT) AS depth,
  coalesce(k.child_count, 0) AS child_count,
  CAST(greatest(s.duration_nano - coalesce(k.child_nano, 0), 0) AS BIGINT) AS self_nano
FROM spans s LEFT JOIN spans p ON p.trace_id = s.trace_id AND p.span_id = s.parent_span_id
LEFT JOIN kids k ON k.trace_id = s.trace_id AND k.span_id = s.span_id"""))
def parent_child(spark, sf_dir):
    return correlate.parent_child(spans(spark, sf_dir))


# The same workflows as their activities report them: no span status, only the attribute that states the failure.
def _unflagged(spark, sf_dir):
    flagged = workflow_spans(spark, sf_dir)
    stated = F.map_concat(F.map_filter("attributes_string", lambda k, _: k != "inventory.failure"), F.create_map(F.lit("inventory.failure"), F.lit("stated")))
    attributes = F.when(F.col("has_error"), stated).otherwise(F.col("attributes_string"))
    return flagged.withColumn("attributes_string", attributes).withColumn("has_error", F.lit(False))


@register("workflow_outcome_unflagged", over("workflow", body=OUTCOME_SQL + " SELECT * EXCLUDE (last_at) FROM outcome"))
def workflow_outcome_unflagged(spark, sf_dir):
    return workflow.workflow_outcome(_unflagged(spark, sf_dir), error=correlate.attribute_error())


@register("compensation_audit_unflagged", ORACLES["compensation_audit"])
def compensation_audit_unflagged(spark, sf_dir):
    return workflow.compensation_audit(_unflagged(spark, sf_dir), error=correlate.attribute_error())


@register("retry_attempts_unflagged", ORACLES["retry_attempts"])
def retry_attempts_unflagged(spark, sf_dir):
    return workflow.retry_attempts(_unflagged(spark, sf_dir), error=correlate.attribute_error())


@register("parent_child_redelivered", ORACLES["parent_child"])
def parent_child_redelivered(spark, sf_dir):
    """Every span delivered twice; the result is that of one delivery."""
    once = spans(spark, sf_dir)
    return correlate.parent_child(once.unionByName(once))
