import json
from datetime import timedelta

from pyspark.sql import functions as F

from spanops.functions.predicates import latest
from spanops.sources import otlp, tables
from spanops.sources.orders import parse_orders
from spanops.operators import latency
from tests.conftest import START


def _attrs(**values):
    kinds = {str: "stringValue", bool: "boolValue", int: "intValue", float: "doubleValue"}
    return [
        {"key": k.replace("__", "."), "value": {kinds[type(v)]: str(v) if type(v) is int else v}} for k, v in values.items()
    ]


RESOURCE = {"attributes": _attrs(service__name="temporal-worker", deployment__environment="dev")}
NANOS = 1709294400123456789


def test_otlp_files(spark, tmp_path):
    span = {
        "traceId": "t", "spanId": "s", "parentSpanId": "", "name": "activity.x", "kind": "SPAN_KIND_INTERNAL",
        "startTimeUnixNano": str(NANOS), "endTimeUnixNano": str(NANOS + 5), "status": {"code": 2},
        "attributes": _attrs(customer__tier="pro", order__items=3, order__amount=1.5, validation__passed=True)
        + _attrs(customer__tier="enterprise"),
    }
    request = {"resourceSpans": [{"resource": RESOURCE, "scopeSpans": [{"spans": [span, {**span, "spanId": "z", "status": {}}]}]}]}
    (tmp_path / "traces.json").write_text(json.dumps(request) + "\n" + json.dumps({"resourceSpans": []}) + "\n")
    rows = otlp.ingest_otlp_json(spark, str(tmp_path / "traces.json"), "traces").orderBy("span_id").collect()
    assert [r["has_error"] for r in rows] == [True, False]
    r = rows[0]
    assert (r["duration_nano"], r["parent_span_id"], r["kind"], r["serviceName"]) == (5, None, "Internal", "temporal-worker")
    assert r["attributes_string"] == {"customer.tier": "enterprise"}  # the last of equal keys
    assert r["attributes_number"] == {"order.items": 3.0, "order.amount": 1.5} and r["attributes_bool"] == {"validation.passed": True}
    assert r["resource"]["deployment.environment"] == "production"
    assert r["timestamp"].microsecond == 123456 and r["ts_bucket_start"] == 1709294400

    log = {
        "timeUnixNano": str(NANOS), "severityNumber": 17, "severityText": "ERROR", "body": {"stringValue": "payment failed"},
        "attributes": _attrs(trace_id="from-attribute"), "spanId": "s",
    }
    (tmp_path / "logs.json").write_text(json.dumps({"resourceLogs": [{"resource": RESOURCE, "scopeLogs": [{"logRecords": [log]}]}]}))
    row = otlp.ingest_otlp_json(spark, str(tmp_path / "logs.json"), "logs", environment=None).first()
    assert (row["trace_id"], row["severity_text"], row["resource"]["deployment.environment"]) == ("from-attribute", "ERROR", "dev")

    metrics = [
        {"name": "g", "gauge": {"dataPoints": [{"timeUnixNano": str(NANOS), "asInt": "4", "attributes": _attrs(cpu=1)}]}},
        {"name": "c", "sum": {"aggregationTemporality": 2, "dataPoints": [{"timeUnixNano": str(NANOS), "asDouble": 2.5}]}},
        {"name": "h", "histogram": {"aggregationTemporality": 1, "dataPoints": [
            {"timeUnixNano": str(NANOS), "count": "3", "sum": 9.0, "bucketCounts": ["1", "2"], "explicitBounds": [5.0]}]}},
    ]
    (tmp_path / "metrics.json").write_text(json.dumps({"resourceMetrics": [{"resource": RESOURCE, "scopeMetrics": [{"metrics": metrics}]}]}))
    rows = {r["metric_name"]: r for r in otlp.ingest_otlp_json(spark, str(tmp_path / "metrics.json"), "metrics").collect()}
    assert rows["g"]["value"] == 4.0 and rows["g"]["attributes"] == {"cpu": "1"}
    assert (rows["c"]["value"], rows["c"]["temporality"]) == (2.5, "cumulative")
    assert (rows["h"]["bucket_counts"], rows["h"]["count"], rows["h"]["temporality"]) == ([1, 2], 3, "delta")


def test_otlp_bad_numbers_do_not_stop_the_job(spark):
    span = {"traceId": "t", "spanId": "s", "name": "n", "startTimeUnixNano": "soon", "endTimeUnixNano": "later",
            "attributes": [{"key": "n", "value": {"intValue": "many"}}]}
    lines = spark.createDataFrame(
        [(json.dumps({"resourceSpans": [{"scopeSpans": [{"spans": [span]}]}]}),), ("{bad",)], "value string"
    )
    rows = otlp.parse_otlp(lines, "traces").collect()
    assert len(rows) == 1 and rows[0]["timestamp"] is None and rows[0]["attributes_number"] == {}


def test_bucket_start_is_added_on_write(spark, make_spans, tmp_path):
    spans = make_spans([{"sec": i * 900} for i in range(8)]).withColumn("timestamp", F.col("timestamp").cast("timestamp"))
    tables.write_telemetry(spans, str(tmp_path / "s"))
    assert tables.read_spans(spark, str(tmp_path / "s"), START, START + timedelta(hours=1)).count() == 5


def test_orders_and_rejects(spark):
    good = {"order_id": "7", "customer_id": "c", "customer_tier": "pro", "amount": 9.5, "items": 2, "payment_method": "paypal"}
    lines = spark.createDataFrame([(json.dumps(good),), ("{bad",), (json.dumps({**good, "amount": "much"}),), (json.dumps({"order_id": "8"}),)], "value string")
    orders, rejects = parse_orders(lines)
    assert [(r["order_id"], r["workflow_id"]) for r in orders.orderBy("order_id").collect()] == [("7", "order-7"), ("8", "order-8")]
    assert rejects.count() == 2


def test_partitioned_table_prunes(spark, make_spans, tmp_path):
    rows = [{"sec": h * 3600, "tier": "pro" if h % 2 else None, "ms": h} for h in range(48)]
    spans = tables.with_bucket_start(make_spans(rows).withColumn("timestamp", F.col("timestamp").cast("timestamp")))
    path = str(tmp_path / "spans")
    tables.write_telemetry(spans, path)
    start, end = START + timedelta(hours=10), START + timedelta(hours=20)
    found = tables.read_spans(spark, path, start, end)
    assert found.count() == 11
    assert found.where("customer_tier = 'pro'").count() == 5
    plan = found._jdf.queryExecution().explainString(found._sc._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))
    pruned = [line for line in plan.splitlines() if "PartitionFilters" in line][0]
    assert "dt" in pruned and "hour" in pruned
    assert tables.read_spans(spark, path).count() == 48
    assert tables.read_spans(spark, path, start.isoformat(), None).count() == 38
    whole = tables.read_spans(spark, path)
    assert latest(whole) == START + timedelta(hours=47) and latest(whole.where("false")) is None
    drift = latency.latency_drift(found, live=None, baseline=None, as_of=end)
    assert drift.first()["total_spans"] == 5


def test_rollup_quantile_close(make_spans):
    spans = make_spans([{"ms": i, "sec": i % 600} for i in range(1, 2001)])
    rollup = tables.rollup_latency(spans)
    row = tables.rollup_quantile(rollup, ["name"], 0.95).first()
    assert row["spans"] == 2000 and abs(row["quantile_ms"] - 1900) < 60


def _value(v):
    if isinstance(v, list):
        return {"arrayValue": {"values": [_value(x) for x in v]}}
    if isinstance(v, dict):
        return {"kvlistValue": {"values": [{"key": k, "value": _value(x)} for k, x in v.items()]}}
    return _attrs(x=v)[0]["value"]


def _trace(**attributes):
    span = {"traceId": "t", "spanId": "s", "name": "n", "startTimeUnixNano": str(NANOS), "endTimeUnixNano": str(NANOS)}
    span["attributes"] = [{"key": k, "value": _value(v)} for k, v in attributes.items()]
    return {"resourceSpans": [{"scopeSpans": [{"spans": [span]}]}]}


def test_otlp_values_of_any_kind(spark):
    values = {
        "text": 'say "x"', "whole": 7, "part": 1.5, "flag": True, "empty": [], "none": {}, "list": ["a", 2, [True, {"deep": [1.5]}]],
        "map": {"a": 1, "b": {"c": ["x", {"d": False}]}},
    }
    lines = spark.createDataFrame([(json.dumps(_trace(**values)),)], "value string")
    row = otlp.parse_otlp(lines, "traces", nested=True).withColumn("attributes", F.to_json("attributes")).first()
    assert json.loads(row["attributes"]) == values
    strings = row["attributes_string"]
    assert strings["text"] == 'say "x"' and json.loads(strings["list"]) == values["list"] and json.loads(strings["map"]) == values["map"]
    assert row["attributes_number"] == {"whole": 7.0, "part": 1.5} and row["attributes_bool"] == {"flag": True}
    assert "attributes" not in otlp.parse_otlp(lines, "traces").columns


def test_otlp_values_beyond_the_depth_and_repeated_keys(spark):
    deep = value = []
    for _ in range(otlp.MAX_DEPTH + 2):
        value.append(inner := [])
        value = inner
    request = _trace(deep=deep, again=1)
    spans = request["resourceSpans"][0]["scopeSpans"][0]["spans"][0]
    spans["attributes"] += _attrs(again=2) + [{"key": "m", "value": {"kvlistValue": {"values": _attrs(k=1) + _attrs(k=2)}}}]
    lines = spark.createDataFrame([(json.dumps(request),)], "value string")
    got = json.loads(otlp.parse_otlp(lines, "traces", nested=True).select(F.to_json("attributes")).first()[0])
    assert got["again"] == 2 and got["m"] == {"k": 2}
    text = json.dumps(got["deep"])
    assert text.startswith("[" * (otlp.MAX_DEPTH + 1)) and "arrayValue" in text  # deeper values stay as written


def test_otlp_structured_bodies(spark):
    bodies = ["plain", 3, True, {"event": "refund", "ids": [1, 2]}, None]
    logs = [{"timeUnixNano": str(NANOS), "spanId": str(i), "body": _value(b) if b is not None else {}} for i, b in enumerate(bodies)]
    lines = spark.createDataFrame([(json.dumps({"resourceLogs": [{"scopeLogs": [{"logRecords": logs}]}]}),)], "value string")
    rows = otlp.parse_otlp(lines, "logs", nested=True).withColumn("body_value", F.to_json("body_value")).orderBy("span_id").collect()
    assert [r["body"] for r in rows] == ["plain", "3", "true", '{"event":"refund","ids":[1,2]}', None]
    assert [r["body_value"] and json.loads(r["body_value"]) for r in rows] == bodies


def test_otlp_rejects(spark, tmp_path):
    good = json.dumps(_trace(k="v"))
    untimed = json.dumps(_trace(k="v")).replace(str(NANOS), "soon")
    bad = ["{bad", "[1, 2]", '"text"', '{"resourceLogs": []}', good[:-3], '{"resourceSpans": 3}']
    (tmp_path / "x.json").write_text("\n".join([good, "", *bad, untimed, "   ", good]))
    records, rejects = otlp.read_otlp(spark, str(tmp_path / "x.json"), "traces")
    assert records.count() == 2
    found = {r["line"]: r["reason"] for r in rejects.collect()}
    assert {line: found.get(line) for line in bad} == {
        "{bad": "malformed", "[1, 2]": "malformed", '"text"': "malformed", '{"resourceLogs": []}': "no resourceSpans", good[:-3]: "malformed",
        '{"resourceSpans": 3}': "malformed",
    }
    (late,) = [line for line, reason in found.items() if reason == "no time"]
    assert json.loads(late)["span_id"] == "s" and len(found) == len(bad) + 1
    assert otlp.ingest_otlp_json(spark, str(tmp_path / "x.json"), "traces").count() == 3
