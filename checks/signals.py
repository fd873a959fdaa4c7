"""Sources and sinks, discovery and search, and metrics."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks import views
from checks.registry import ORACLES, logs, metric_points, orders_in, over, register, spans
from spanops import schema as S
from spanops.functions.predicates import latest
from spanops.operators import explore, metrics
from spanops.session import scratch_path
from spanops.sources import locator, otlp, tables
from spanops.sources.orders import parse_orders

DAY = "time_bucket(INTERVAL '1 day', timestamp)"


def _stored(spark, rows, kind):
    path = scratch_path(spark, kind)
    tables.write_telemetry(rows, path, hourly=False)
    return path


def _ends(rows):
    return rows.agg(F.min("timestamp"), F.max("timestamp")).first()


@register("scan_spans", over("spans", body="""
SELECT timestamp, ts_bucket_start, trace_id, span_id, name, serviceName, duration_nano, has_error, tier AS customer_tier FROM spans"""))
def scan_spans(spark, sf_dir):
    rows = spans(spark, sf_dir)
    start, end = _ends(rows)
    path = _stored(spark, rows.withColumn("timestamp", F.col("timestamp").cast("timestamp")), "spans")
    found = tables.read_spans(spark, path, start, end, hourly=False)
    return found.select(
        "timestamp", "ts_bucket_start", "trace_id", "span_id", "name", "serviceName", "duration_nano", "has_error", "customer_tier"
    )


@register("scan_logs", over("spans", "logs", body=" SELECT timestamp, trace_id, span_id, severity_text, body FROM logs"))
def scan_logs(spark, sf_dir):
    rows = logs(spark, sf_dir).withColumn("timestamp", F.col("timestamp").cast("timestamp"))
    found = tables.read_logs(spark, _stored(spark, rows, "logs"), hourly=False)
    return found.select("timestamp", "trace_id", "span_id", "severity_text", "body")


@register("scan_metrics", over("metrics", body="""
SELECT timestamp, 'orders.processed' AS metric_name, serviceName, counter AS value FROM metric_points
UNION ALL SELECT timestamp, 'queue.depth', serviceName, gauge FROM metric_points
UNION ALL SELECT timestamp, 'request.latency', serviceName, NULL FROM metric_points"""))
def scan_metrics(spark, sf_dir):
    rows = metric_points(spark, sf_dir).withColumn("timestamp", F.col("timestamp").cast("timestamp"))
    found = tables.read_metrics(spark, _stored(spark, rows, "metrics"), hourly=False)
    return found.select("timestamp", "metric_name", "serviceName", "value")


@register("latency_rollup", over("spans", body=f"""
SELECT {DAY} AS ts, serviceName, name, tier, count(*) AS spans, count(*) FILTER (WHERE has_error) AS errors
FROM spans GROUP BY 1, 2, 3, 4"""))
def latency_rollup(spark, sf_dir):
    return tables.rollup_latency(spans(spark, sf_dir), "1 day").drop("sketch")


@register("latency_rollup_quantile")
def latency_rollup_quantile(spark, sf_dir):
    rollup = tables.rollup_latency(spans(spark, sf_dir), "1 hour")
    return tables.rollup_quantile(rollup, ["serviceName", "name"], 0.99)


_VALUE_TYPES = {"stringValue": "string", "doubleValue": "double", "intValue": "string", "boolValue": "boolean"}


def _attributes(*entries: tuple[str, str, str]) -> str:
    """SQL for an attribute list; fields that are NULL are left out of the JSON."""

    def value(kind: str, sql: str) -> str:
        fields = (f"'{k}', cast({sql if k == kind else 'NULL'} AS {t})" for k, t in _VALUE_TYPES.items())
        return "named_struct(" + ", ".join(fields) + ")"

    return "array(" + ", ".join(f"named_struct('key', '{k}', 'value', {value(t, v)})" for k, t, v in entries) + ")"


def _request(top: str, scope: str, records: str, record: str) -> str:
    """SQL that wraps one record of each row into an export request and prints it as JSON."""
    resource = _attributes(("service.name", "stringValue", "serviceName"), ("deployment.environment", "stringValue", "'staging'"))
    return (
        f"to_json(named_struct('{top}', array(named_struct('resource', named_struct('attributes', {resource}), "
        f"'{scope}', array(named_struct('{records}', array({record}))))))) AS value"
    )


@register("ingest_otlp_json", over("spans", body="""
SELECT timestamp, ts_bucket_start, trace_id, span_id, parent_span_id, name, kind, serviceName, duration_nano, has_error,
  customer_id, tier AS customer_tier, value AS amount, event_id AS number, event_type = 'view' AS flag, 'production' AS environment
FROM (SELECT *, 'Internal' AS kind FROM spans)"""))
def ingest_otlp_json(spark, sf_dir):
    events = views.table(spark, sf_dir, "events")
    known = spans(spark, sf_dir).selectExpr("*", "cast(substring(span_id, 2) AS bigint) AS event_id")
    rows = known.join(events.select("event_id", "value", "event_type"), "event_id").selectExpr(
        "*", "unix_micros(cast(timestamp AS timestamp)) * 1000 AS at", "attributes_string['customer.id'] AS customer_id"
    )
    attributes = _attributes(
        ("customer.id", "stringValue", "customer_id"),
        ("customer.tier", "stringValue", "customer_tier"),
        ("order.amount", "doubleValue", "value"),
        ("order.number", "intValue", "cast(event_id AS string)"),
        ("is.view", "boolValue", "event_type = 'view'"),
    )
    record = (
        "named_struct('traceId', trace_id, 'spanId', span_id, 'parentSpanId', coalesce(parent_span_id, ''), 'name', name, "
        "'kind', 1, 'startTimeUnixNano', cast(at AS string), 'endTimeUnixNano', cast(at + duration_nano AS string), "
        f"'attributes', {attributes}, 'status', named_struct('code', if(has_error, 2, 0)))"
    )
    lines = rows.selectExpr(_request("resourceSpans", "scopeSpans", "spans", record))
    parsed = otlp.parse_otlp(lines, "traces")
    return parsed.selectExpr(
        "timestamp", "ts_bucket_start", "trace_id", "span_id", "parent_span_id", "name", "kind", "serviceName",
        "duration_nano", "has_error", "attributes_string['customer.id'] AS customer_id",
        "attributes_string['customer.tier'] AS customer_tier", "attributes_number['order.amount'] AS amount",
        "cast(attributes_number['order.number'] AS bigint) AS number", "attributes_bool['is.view'] AS flag",
        "resource['deployment.environment'] AS environment",
    )


@register("ingest_otlp_nested", over("spans", body="""
SELECT span_id, trace_id, user_id AS user_number, event_type || '|' || name AS tags, value AS nested_value, event_id % 3 = 0 AS nested_flag,
  event_type AS nested_kind, event_id || '|' || (event_id + 1) AS deep, 'AQID' AS raw, '["' || event_type || '","' || name || '"]' AS tags_text
FROM spans"""))
def ingest_otlp_nested(spark, sf_dir):
    """Lists, maps and bytes as attributes: as VARIANT, and as text among the string attributes."""
    known = spans(spark, sf_dir).selectExpr("*", "cast(substring(span_id, 2) AS bigint) AS event_id")
    rows = known.join(views.table(spark, sf_dir, "events").select("event_id", "user_id", "value", "event_type"), "event_id")
    text = lambda c: f"named_struct('stringValue', {c})"
    number = lambda c: f"named_struct('intValue', cast({c} AS string))"
    entry = lambda key, value: f"concat('{{\"key\":\"{key}\",\"value\":', to_json({value}), '}}')"
    listed = lambda *values: "concat('{\"arrayValue\":{\"values\":[', concat_ws(',', " + ", ".join(f"to_json({v})" for v in values) + "), ']}}')"
    mapped = (
        "concat('{\"kvlistValue\":{\"values\":[', concat_ws(',', "
        + ", ".join([entry("value", "named_struct('doubleValue', value)"), entry("flag", "named_struct('boolValue', event_id % 3 = 0)"), entry("kind", text("event_type"))])
        + ", concat('{\"key\":\"deep\",\"value\":', " + listed(number("event_id"), number("event_id + 1")) + ", '}')), ']}}')"
    )
    attributes = (
        "concat_ws(',', " + entry("user.number", number("user_id"))
        + ", concat('{\"key\":\"tags\",\"value\":', " + listed(text("event_type"), text("name")) + ", '}')"
        + ", concat('{\"key\":\"order\",\"value\":', " + mapped + ", '}')"
        + ", " + entry("raw", "named_struct('bytesValue', 'AQID')") + ")"
    )
    line = (
        "concat('{\"resourceSpans\":[{\"scopeSpans\":[{\"spans\":[{\"traceId\":\"', trace_id, '\",\"spanId\":\"', span_id, "
        f"'\",\"startTimeUnixNano\":\"1704067200000000000\",\"attributes\":[', {attributes}, ']}}]}}]}}]}}') AS value"
    )
    parsed = otlp.parse_otlp(rows.selectExpr(line), "traces", nested=True)
    return parsed.selectExpr(
        "span_id", "trace_id", "variant_get(attributes, '$[\"user.number\"]', 'bigint') AS user_number",
        "array_join(variant_get(attributes, '$.tags', 'array<string>'), '|') AS tags", "variant_get(attributes, '$.order.value', 'double') AS nested_value",
        "variant_get(attributes, '$.order.flag', 'boolean') AS nested_flag", "variant_get(attributes, '$.order.kind', 'string') AS nested_kind",
        "array_join(variant_get(attributes, '$.order.deep', 'array<string>'), '|') AS deep", "variant_get(attributes, '$.raw', 'string') AS raw",
        "attributes_string['tags'] AS tags_text",
    )


@register("ingest_otlp_rejects", over("spans", body="""
SELECT CASE WHEN event_id % 50 = 3 THEN '{"resourceSpans": [{bad ' || event_id WHEN event_id % 50 = 17 THEN '{"resourceLogs":[],"n":' || event_id || '}'
    ELSE '[' || event_id || ']' END AS line,
  CASE WHEN event_id % 50 = 3 THEN 'malformed' WHEN event_id % 50 = 17 THEN 'no resourceSpans' ELSE 'malformed' END AS reason, NULL AS span_id
FROM spans WHERE event_id % 50 IN (3, 17, 29)
UNION ALL SELECT NULL, NULL, span_id FROM spans WHERE event_id % 50 NOT IN (3, 17, 29)"""))
def ingest_otlp_rejects(spark, sf_dir):
    """Every line of an export is a record or a reject: cut lines, other signals, other JSON."""
    line = (
        "CASE event_id % 50 WHEN 3 THEN concat('{\"resourceSpans\": [{bad ', event_id) "
        "WHEN 17 THEN concat('{\"resourceLogs\":[],\"n\":', event_id, '}') WHEN 29 THEN concat('[', event_id, ']') "
        "ELSE concat('{\"resourceSpans\":[{\"scopeSpans\":[{\"spans\":[{\"spanId\":\"s', event_id, '\",\"startTimeUnixNano\":\"1\"}]}]}]}') END"
    )
    path = scratch_path(spark, "export")
    views.table(spark, sf_dir, "events").selectExpr(f"{line} AS value").write.text(path)
    records, rejects = otlp.read_otlp(spark, path, "traces")
    none = F.lit(None).cast("string")
    return rejects.select("line", "reason", none.alias("span_id")).unionByName(records.select(none.alias("line"), none.alias("reason"), "span_id"))


@register("ingest_otlp_logs", over("spans", "logs", body="""
SELECT timestamp, trace_id, span_id, severity_text, body, serviceName, 'production' AS environment FROM logs"""))
def ingest_otlp_logs(spark, sf_dir):
    record = (
        "named_struct('timeUnixNano', cast(unix_micros(cast(timestamp AS timestamp)) * 1000 AS string), 'severityNumber', "
        "severity_number, 'severityText', severity_text, 'body', named_struct('stringValue', body), 'attributes', "
        + _attributes(("trace_id", "stringValue", "trace_id"))
        + ", 'spanId', span_id)"
    )
    lines = logs(spark, sf_dir).selectExpr(_request("resourceLogs", "scopeLogs", "logRecords", record))
    parsed = otlp.parse_otlp(lines, "logs")
    return parsed.selectExpr(
        "timestamp", "trace_id", "span_id", "severity_text", "body", "serviceName",
        "resource['deployment.environment'] AS environment",
    )


@register("ingest_otlp_metrics", over("metrics", body="""
SELECT timestamp, 'orders.processed' AS metric_name, 'sum' AS metric_type, serviceName, event_type, counter AS value,
  'cumulative' AS temporality FROM metric_points"""))
def ingest_otlp_metrics(spark, sf_dir):
    points = metric_points(spark, sf_dir).where("metric_name = 'orders.processed'")
    labelled = points.selectExpr("*", "attributes['event.type'] AS event_type")
    point = (
        "named_struct('attributes', " + _attributes(("event.type", "stringValue", "event_type"))
        + ", 'timeUnixNano', cast(unix_micros(cast(timestamp AS timestamp)) * 1000 AS string), 'asDouble', value)"
    )
    record = f"named_struct('name', metric_name, 'sum', named_struct('dataPoints', array({point}), 'aggregationTemporality', 2))"
    lines = labelled.selectExpr(_request("resourceMetrics", "scopeMetrics", "metrics", record))
    parsed = otlp.parse_otlp(lines, "metrics")
    return parsed.selectExpr(
        "timestamp", "metric_name", "metric_type", "serviceName", "attributes['event.type'] AS event_type", "value", "temporality"
    )


@register("workflows_rollup", over("spans", body="""
, weeks AS (SELECT time_bucket(INTERVAL '7 days', timestamp) AS week, name, count(DISTINCT trace_id) AS exact FROM spans GROUP BY 1, 2)
SELECT week, name, exact, true AS within FROM weeks"""))
def workflows_rollup(spark, sf_dir):
    """Weekly distinct workflows merged from stored daily sketches: the exact number, and whether the estimate is within 5 % of it."""
    s = spans(spark, sf_dir)
    path = scratch_path(spark, "rollup")
    tables.rollup_workflows(s, "1 day").write.parquet(path)
    week = lambda c: F.window(c, "7 days", startTime="4 days").getField("start")  # noqa: E731  weeks start on Monday
    guess = tables.rollup_distinct(spark.read.parquet(path).withColumn("week", week("ts")), ["week", "name"])
    exact = s.groupBy(week("timestamp").alias("week"), "name").agg(F.count_distinct("trace_id").alias("exact"))
    close = (F.abs(F.col("workflows") - F.col("exact")) <= 0.05 * F.col("exact") + 1).alias("within")
    return exact.join(guess, ["week", "name"]).select("week", "name", "exact", close)


@register("parse_orders", over("orders_in", body="""
SELECT CASE WHEN CAST(order_id AS BIGINT) % 97 = 13 THEN NULL ELSE order_id END AS order_id,
  CASE WHEN CAST(order_id AS BIGINT) % 97 <> 13 THEN 'order-' || order_id END AS workflow_id,
  CASE WHEN CAST(order_id AS BIGINT) % 97 <> 13 THEN customer_tier END AS customer_tier,
  CASE WHEN CAST(order_id AS BIGINT) % 97 <> 13 THEN round(amount, 4) END AS amount,
  CASE WHEN CAST(order_id AS BIGINT) % 97 <> 13 THEN items END AS items,
  CASE WHEN CAST(order_id AS BIGINT) % 97 = 13 THEN '{bad ' || order_id END AS rejected FROM orders_in"""))
def parse(spark, sf_dir):
    lines = orders_in(spark, sf_dir).selectExpr(
        "CASE WHEN cast(order_id AS bigint) % 97 = 13 THEN concat('{bad ', order_id) ELSE to_json(struct(*)) END AS value"
    )
    orders, rejects = parse_orders(lines)
    kept = orders.select(
        "order_id", "workflow_id", "customer_tier", F.round("amount", 4).alias("amount"), "items",
        F.lit(None).cast("string").alias("rejected"),
    )
    return kept.unionByName(rejects.select(F.col("line").alias("rejected")), allowMissingColumns=True)


@register("list_services", over("spans", body="""
SELECT serviceName AS service, count(*) AS spans,
  round(count(*) FILTER (WHERE has_error) * CAST(100 AS DOUBLE) / count(*), 2) AS error_rate_pct,
  round(quantile_cont(duration_nano, 0.99) / 1000000, 2) AS p99_ms FROM spans GROUP BY 1"""))
def list_services(spark, sf_dir):
    return explore.list_services(spans(spark, sf_dir))


@register("top_operations", over("spans", body="""
SELECT name AS operation, count(*) AS calls, count(*) FILTER (WHERE has_error) AS errors,
  round(quantile_cont(duration_nano, 0.5) / 1000000, 2) AS p50_ms, round(quantile_cont(duration_nano, 0.95) / 1000000, 2) AS p95_ms,
  round(quantile_cont(duration_nano, 0.99) / 1000000, 2) AS p99_ms
FROM spans WHERE serviceName = 'temporal-worker' GROUP BY 1 ORDER BY calls DESC, operation LIMIT 3"""))
def top_operations(spark, sf_dir):
    return explore.top_operations(spans(spark, sf_dir), "temporal-worker", 3)


def _key_sql(context: str, key: str, kind: str, condition: str = "true") -> str:
    return f"SELECT '{context}' AS context, '{key}' AS \"key\", '{kind}' AS data_type, count(*) AS rows FROM spans WHERE {condition}"


@register("field_keys", over("spans", body=" " + " UNION ALL ".join([
    _key_sql("span", "timestamp", "timestamp_ntz"), _key_sql("span", "ts_bucket_start", "bigint"),
    _key_sql("span", "trace_id", "string"), _key_sql("span", "span_id", "string"),
    _key_sql("span", "parent_span_id", "string", "parent_span_id IS NOT NULL"), _key_sql("span", "name", "string"),
    _key_sql("span", "kind", "string"), _key_sql("span", "serviceName", "string"),
    _key_sql("span", "duration_nano", "bigint"), _key_sql("span", "has_error", "boolean"),
    _key_sql("attribute", "customer.id", "string"), _key_sql("attribute", "customer.tier", "string", "tier IS NOT NULL"),
    _key_sql("attribute", "validation.failure_reason", "string", "reason IS NOT NULL AND event_type = 'signup'"),
    _key_sql("attribute", "payment.failure_reason", "string", "reason IS NOT NULL AND event_type = 'click'"),
    _key_sql("attribute", "inventory.failure", "string", "reason IS NOT NULL AND event_type = 'error'"),
    _key_sql("attribute", "order.amount", "double", "amount IS NOT NULL"),
    _key_sql("attribute", "fraud.score", "double", "fraud_score IS NOT NULL"),
    _key_sql("attribute", "validation.passed", "boolean", "event_type = 'signup' AND reason IS NULL"),
    _key_sql("resource", "service.name", "string"),
    _key_sql("resource", "deployment.environment", "string", "user_id % 2 = 1"),
])))
def field_keys(spark, sf_dir):
    return explore.field_keys(spans(spark, sf_dir))


@register("field_values", over("spans", body="""
SELECT tier AS value, count(*) AS rows FROM spans WHERE tier IS NOT NULL GROUP BY 1"""))
def field_values(spark, sf_dir):
    return explore.field_values(spans(spark, sf_dir), S.TIER_KEY, "attribute")


@register("search_traces", over("spans", body="""
SELECT timestamp, trace_id, span_id, name, serviceName, duration_nano FROM spans
WHERE name LIKE '%check_fraud%' AND timestamp >= (SELECT max(timestamp) FROM spans) - INTERVAL 7 DAY
ORDER BY timestamp DESC, span_id DESC LIMIT 5"""))
def search_traces(spark, sf_dir):
    s = spans(spark, sf_dir)
    found = explore.search_traces(s, "name LIKE '%check_fraud%'", window="7 days", as_of=latest(s), limit=5)
    return found.select("timestamp", "trace_id", "span_id", "name", "serviceName", "duration_nano")


@register("aggregate_traces", over("spans", body="""
SELECT tier AS customer_tier, round(quantile_cont(duration_nano, 0.99), 2) AS value FROM spans
WHERE name = 'activity.check_fraud' AND serviceName = 'temporal-worker' GROUP BY 1"""))
def aggregate_traces(spark, sf_dir):
    out = explore.aggregate_traces(
        spans(spark, sf_dir), "p99", "duration_nano", where="name = 'activity.check_fraud'",
        group_by=["customer.tier"], service="temporal-worker",
    )
    return out.withColumn("value", F.round("value", 2))


@register("aggregate_traces_series", over("spans", body=f"""
SELECT {DAY} AS ts, name, count(DISTINCT trace_id) AS value FROM spans GROUP BY 1, 2"""))
def aggregate_traces_series(spark, sf_dir):
    return explore.aggregate_traces(
        spans(spark, sf_dir), "count_distinct", "trace_id", group_by=["name"], request_type="time_series", step="1 day"
    )


@register("search_logs", over("spans", "logs", body="""
SELECT timestamp, trace_id, severity_text, body FROM logs WHERE body LIKE '%payment failed%' AND severity_text IN ('ERROR', 'WARN')
ORDER BY timestamp DESC LIMIT 20"""))
def search_logs(spark, sf_dir):
    found = explore.search_logs(logs(spark, sf_dir), "payment failed", severity=["ERROR", "WARN"], limit=20)
    return found.select("timestamp", "trace_id", "severity_text", "body")


@register("aggregate_logs", over("spans", "logs", body="""
SELECT severity_text, regexp_replace(body, '[0-9]+', '<n>', 'g') AS pattern, count(*) AS logs FROM logs GROUP BY 1, 2"""))
def aggregate_logs(spark, sf_dir):
    return explore.aggregate_logs(logs(spark, sf_dir), ["severity_text"], patterns=True)


@register("trace_details", over("spans", "logs", body="""
, t AS (SELECT trace_id FROM spans ORDER BY timestamp DESC LIMIT 1),
both_ AS (
  SELECT 'span' AS kind, timestamp, span_id, name,
    CAST(CASE event_id % 5 WHEN 0 THEN 0 WHEN 1 THEN 1 WHEN 2 THEN 1 ELSE 2 END AS BIGINT) AS depth, duration_nano, has_error AS failed
  FROM spans WHERE trace_id = (SELECT trace_id FROM t)
  UNION ALL
  SELECT 'log', timestamp, span_id, body, NULL, NULL, severity_text IN ('ERROR', 'WARN') FROM logs WHERE trace_id = (SELECT trace_id FROM t))
SELECT *, round((epoch_us(timestamp) - (SELECT min(epoch_us(timestamp)) FROM both_ WHERE kind = 'span')) / 1000, 3) AS offset_ms FROM both_"""))
def trace_details(spark, sf_dir):
    s = spans(spark, sf_dir)
    newest = s.orderBy(F.desc("timestamp")).select("trace_id").first()[0]
    return explore.trace_details(s, newest, logs(spark, sf_dir))


@register("trace_details_located", ORACLES["trace_details"])
def trace_details_located(spark, sf_dir):
    """The same trace from stored tables, by the locator."""
    s = spans(spark, sf_dir)
    newest = s.orderBy(F.desc("timestamp")).select("trace_id").first()[0]
    path, index = scratch_path(spark, "spans"), scratch_path(spark, "locator")
    locator.write_located(s, path, index, hourly=False)
    stored_logs = _stored(spark, logs(spark, sf_dir), "logs")
    return locator.located_trace_details(spark, path, index, newest, stored_logs, hourly=False, after="30 days")


@register("builder_query", over("spans", body=f"""
SELECT {DAY} AS ts, tier AS customer_tier, count(*) AS calls, round(avg(duration_nano), 2) AS mean,
  round(quantile_cont(duration_nano, 0.95), 2) AS slow, count(DISTINCT trace_id) AS traces FROM spans
WHERE serviceName = 'temporal-worker' GROUP BY 1, 2 HAVING count(*) > 60 ORDER BY calls DESC, ts, customer_tier NULLS FIRST LIMIT 25"""))
def builder_query(spark, sf_dir):
    out = explore.builder_query(
        spans(spark, sf_dir),
        {
            "calls": ("count", None),
            "mean": ("avg", "duration_nano"),
            "slow": ("p95", "duration_nano"),
            "traces": ("count_distinct", "trace_id"),
        },
        where="serviceName = 'temporal-worker'",
        group_by=["customer.tier"],
        step="1 day",
        having="calls > 60",
        order_by=[F.desc("calls"), "ts", "customer_tier"],
        limit=25,
    )
    return out.withColumn("mean", F.round("mean", 2)).withColumn("slow", F.round("slow", 2))


_RATE = """
, deltas AS (SELECT timestamp, event_type, counter AS v,
    lag(counter) OVER (PARTITION BY serviceName, event_type ORDER BY timestamp, counter) AS prev FROM metric_points),
grown AS (SELECT timestamp, event_type, CASE WHEN prev IS NULL THEN 0 WHEN v < prev THEN v ELSE v - prev END AS d FROM deltas),
rate AS (SELECT time_bucket(INTERVAL '1 day', timestamp) AS ts, event_type, sum(d) / 86400 AS value FROM grown GROUP BY 1, 2)"""


@register("query_metrics", over("metrics", body=_RATE + " SELECT ts, event_type, round(value, 8) AS value FROM rate"))
def query_metrics(spark, sf_dir):
    out = metrics.query_metrics(
        metric_points(spark, sf_dir), "orders.processed", step="1 day", aggregation="rate", group_by=["event.type"]
    )
    return out.select("ts", F.col("event_type"), F.round("value", 8).alias("value"))


@register("metric_formula", over("metrics", body="""
, a AS (SELECT time_bucket(INTERVAL '1 day', timestamp) AS ts, serviceName, avg(gauge) AS a, max(gauge) AS b FROM metric_points GROUP BY 1, 2)
SELECT ts, serviceName, round(a / nullif(b, 0) * 100, 4) AS value FROM a"""))
def metric_formula(spark, sf_dir):
    points = metric_points(spark, sf_dir)
    series = {
        name: metrics.query_metrics(points, "queue.depth", step="1 day", aggregation=kind, group_by=["serviceName"])
        for name, kind in (("a", "avg"), ("b", "max"))
    }
    return metrics.metric_formula(series, "round(try_divide(a, b) * 100, 4)", keys=["ts", "serviceName"])


@register("metric_histogram_quantile", over("metrics", body="""
, b AS (SELECT time_bucket(INTERVAL '1 day', timestamp) AS ts, serviceName,
    CASE WHEN latency <= 50 THEN 0 WHEN latency <= 100 THEN 1 WHEN latency <= 250 THEN 2 WHEN latency <= 500 THEN 3
      WHEN latency <= 1000 THEN 4 ELSE 5 END AS i FROM metric_points),
c AS (SELECT ts, serviceName, i, count(*) AS n FROM b GROUP BY 1, 2, 3),
w AS (SELECT *, CAST(sum(n) OVER (PARTITION BY ts, serviceName ORDER BY i) AS BIGINT) AS upto,
    CAST(sum(n) OVER (PARTITION BY ts, serviceName) AS BIGINT) AS total FROM c),
k AS (SELECT *, [0, 50, 100, 250, 500, 1000][i + 1] AS lo, [50, 100, 250, 500, 1000, NULL][i + 1] AS hi FROM w
  WHERE upto - n < 0.95 * total AND 0.95 * total <= upto)
SELECT ts, serviceName, total AS count,
  round(CASE WHEN hi IS NULL THEN CAST(lo AS DOUBLE) ELSE lo + (hi - lo) * (0.95 * total - (upto - n)) / CAST(n AS DOUBLE) END, 6) AS value
FROM k"""))
def metric_histogram_quantile(spark, sf_dir):
    out = metrics.metric_histogram_quantile(metric_points(spark, sf_dir), "request.latency", 0.95, step="1 day")
    return out.withColumn("value", F.round("value", 6))


@register("metric_histogram_mixed", over("metrics", body="""
, laid AS (SELECT time_bucket(INTERVAL '1 day', timestamp) AS ts, serviceName, latency,
    CASE WHEN event_type IN ('view', 'click') THEN [40, 200, 800] ELSE [50, 100, 250, 500, 1000] END AS bounds FROM metric_points),
b AS (SELECT *, CAST(latency > bounds[1] AS INTEGER) + CAST(latency > bounds[2] AS INTEGER) + CAST(latency > bounds[3] AS INTEGER)
    + CAST(coalesce(latency > bounds[4], false) AS INTEGER) + CAST(coalesce(latency > bounds[5], false) AS INTEGER) AS i FROM laid),
pieces AS (SELECT ts, serviceName, coalesce(bounds[i], 0) AS lo, bounds[i + 1] AS hi, count(*) AS n FROM b GROUP BY ALL),
total AS (SELECT ts, serviceName, CAST(sum(n) AS BIGINT) AS count FROM pieces GROUP BY ALL),
grid AS (SELECT DISTINCT ts, serviceName, x FROM (SELECT ts, serviceName, lo AS x FROM pieces UNION ALL SELECT ts, serviceName, hi FROM pieces WHERE hi IS NOT NULL)),
f AS (SELECT ts, serviceName, x,
    sum(CASE WHEN hi IS NULL THEN CASE WHEN x > lo THEN n ELSE 0 END ELSE n * least(1, greatest(0, (x - lo) / CAST(hi - lo AS DOUBLE))) END) AS below,
    sum(CASE WHEN hi IS NULL THEN CASE WHEN x >= lo THEN n ELSE 0 END ELSE n * least(1, greatest(0, (x - lo) / CAST(hi - lo AS DOUBLE))) END) AS upto
  FROM grid JOIN pieces USING (ts, serviceName) GROUP BY ALL),
s AS (SELECT *, lead(x) OVER w AS nx, lead(below) OVER w AS nb FROM f WINDOW w AS (PARTITION BY ts, serviceName ORDER BY x)),
q AS (SELECT unnest([0.5, 0.9, 0.99]) AS q),
v AS (SELECT ts, serviceName, q, count, x, CASE WHEN upto >= q * count - count * 1e-9 THEN CAST(x AS DOUBLE)
      ELSE x + (nx - x) * least(1, (q * count - upto) / (nb - upto)) END AS value
    FROM s JOIN total USING (ts, serviceName), q WHERE below < q * count - count * 1e-9 AND (upto >= q * count - count * 1e-9 OR nb >= q * count - count * 1e-9)),
r AS (SELECT ts, serviceName, q, count, arg_min(value, x) AS value FROM v GROUP BY ALL)
SELECT ts, serviceName, max(count) AS count, round(max(value) FILTER (WHERE q = 0.5), 4) AS p50, round(max(value) FILTER (WHERE q = 0.9), 4) AS p90,
  round(max(value) FILTER (WHERE q = 0.99), 4) AS p99 FROM r GROUP BY ts, serviceName"""))
def metric_histogram_mixed(spark, sf_dir):
    """Some series have other bounds than the rest of their group."""
    wide, narrow = (40.0, 200.0, 800.0), tuple(float(b) for b in views.BOUNDS)
    latency = F.col("sum")  # one observation per point

    def counts(bounds):
        edges = [None, *bounds, None]
        inside = [
            (F.lit(True) if low is None else latency > low) & (F.lit(True) if high is None else latency <= high)
            for low, high in zip(edges, edges[1:])
        ]
        return F.array(*[F.lit(float(b)) for b in bounds]), F.array(*[x.cast("long") for x in inside])

    other = F.col("attributes")["event.type"].isin("view", "click")
    points = metric_points(spark, sf_dir).where("metric_type = 'histogram'")
    points = points.withColumn("bucket_bounds", F.when(other, counts(wide)[0]).otherwise(counts(narrow)[0]))
    points = points.withColumn("bucket_counts", F.when(other, counts(wide)[1]).otherwise(counts(narrow)[1]))
    out = None
    for name, q in (("p50", 0.5), ("p90", 0.9), ("p99", 0.99)):
        part = metrics.metric_histogram_quantile(points, "request.latency", q, step="1 day").withColumn(name, F.round("value", 4)).drop("value")
        out = part if out is None else out.join(part, ["ts", "serviceName", "count"])
    return out


@register("list_metrics", over("metrics", body="""
, s AS (SELECT count(DISTINCT (serviceName, event_type)) AS series, count(*) AS points FROM metric_points)
SELECT 'orders.processed' AS metric_name, 'sum' AS metric_type, 'cumulative' AS temporality, series, points FROM s
UNION ALL SELECT 'queue.depth', 'gauge', NULL, series, points FROM s
UNION ALL SELECT 'request.latency', 'histogram', 'delta', series, points FROM s"""))
def list_metrics(spark, sf_dir):
    return metrics.list_metrics(metric_points(spark, sf_dir))
