import os
from datetime import timedelta

import pytest
from pyspark.sql import functions as F

from spanops.operators import latency, slo, timeseries, workflow
from spanops.streaming import aggregates, ingest, joins
from spanops.streaming.run import run_available, stream_otlp, stream_parquet
from spanops.session import scratch_path
from tests.conftest import START


def _feed(spark, folder, *frames):
    """One file per frame, taken up one per micro-batch in this order."""
    os.makedirs(folder, exist_ok=True)
    for i, frame in enumerate(frames):
        frame.coalesce(1).write.mode("append").parquet(str(folder))
        for name in os.listdir(folder):
            full = os.path.join(folder, name)
            if name.endswith(".parquet") and not os.path.exists(full + ".seen"):
                os.utime(full, (1_700_000_000 + i * 60,) * 2)
                open(full + ".seen", "w").close()
    return stream_parquet(spark, str(folder), frames[0].schema, "*.parquet", files_per_trigger=1)


def _rows(df):
    return sorted(map(str, df.collect()))


def test_late_span_is_dropped_by_aggregates_and_kept_by_ingest(spark, make_spans, tmp_path):
    first = make_spans([{"tier": "pro", "sec": s} for s in (0, 30, 3600, 7200)])
    # Lateness is judged by the watermark of the batch before, so another batch comes in between.
    between = make_spans([{"tier": "pro", "sec": 7210}])
    late = make_spans([{"tier": "pro", "sec": -3600}, {"tier": "pro", "sec": 10800}])
    stream = _feed(spark, tmp_path / "in", first, between, late)
    counted = run_available(aggregates.st_traffic(stream), "append").collect()
    assert {r["ts"].hour for r in counted} == {12, 13, 14} and sum(r["requests"] for r in counted) == 5
    stored = str(tmp_path / "table")
    ingest.st_ingest(stream, stored, str(tmp_path / "state"), every=None).awaitTermination()
    assert spark.read.parquet(stored).count() == 7


def test_batch_and_stream_agree(spark, make_spans, tmp_path):
    rows = [
        {"tier": ("pro", "free", "enterprise", None)[i % 4], "sec": i * 7, "ms": 50 + i % 40, "error": i % 11 == 0,
         "name": ("activity.check_fraud", "activity.validate_order")[i % 2], "trace": f"t{i // 3}"}
        for i in range(300)
    ]
    spans = make_spans(rows)
    stream = _feed(spark, tmp_path / "in", spans.where("duration_nano % 2 = 0 AND has_error"), spans.where("NOT has_error"), spans.where("has_error AND duration_nano % 2 <> 0"))

    def zoned(df):
        return _rows(df.withColumn("ts", F.col("ts").cast("timestamp_ntz")))

    assert zoned(run_available(aggregates.st_traffic(stream))) == zoned(timeseries.traffic_ts(spans, window=None))
    assert zoned(run_available(aggregates.st_burn_rate(stream))) == zoned(slo.burn_rate_ts(spans, window=None))
    assert zoned(run_available(aggregates.st_error_rate(stream))) == zoned(timeseries.error_rate_ts(spans, window=None))
    tiers = run_available(aggregates.st_p99(stream, by="customer.tier", step="1 hour"))
    assert tiers.count() == 3
    sliding = run_available(aggregates.st_sliding_budget(stream, window="10 minutes", slide="5 minutes"))
    assert sliding.agg(F.sum("total_requests")).first()[0] == 2 * 225
    distinct = run_available(aggregates.st_workflows(stream, step="1 hour")).first()["workflows"]
    true = spans.where("name = 'activity.validate_order'").select("trace_id").distinct().count()
    assert distinct == pytest.approx(true, rel=0.1)
    anomaly = run_available(aggregates.st_anomaly(stream, window="1 hour", slide="30 minutes"))
    assert {r["activity"] for r in anomaly.collect()} == {"activity.check_fraud", "activity.validate_order"}


def test_dedup_across_batches(spark, make_spans, tmp_path):
    spans = make_spans([{"sec": i, "trace": "t", "span": f"s{i}"} for i in range(5)])
    stream = _feed(spark, tmp_path / "in", spans, spans)
    assert run_available(aggregates.st_dedup(stream), "append").count() == 5


def test_outer_join_emits_unmatched_after_the_bound(spark, make_spans, make_logs, tmp_path):
    spans = make_spans([{"trace": "a", "span": "1", "sec": 0}, {"trace": "b", "span": "2", "sec": 1}])
    after = make_spans([{"trace": "z", "span": "9", "sec": 7200}])
    logs = make_logs([{"trace": "a", "span": "1", "sec": 5}, {"trace": "b", "span": "2", "sec": 900}])
    later = make_logs([{"trace": "y", "span": "8", "sec": 7200}])
    left = _feed(spark, tmp_path / "spans", spans, after)
    right = _feed(spark, tmp_path / "logs", logs, later)
    out = {r["trace_id"]: r["body"] for r in run_available(joins.st_trace_log_join(left, right), "append").collect()}
    assert out == {"a": "payment failed", "b": None}


def test_drift_is_recomputed(spark, make_spans, tmp_path):
    rows = [{"ms": 100 + i % 9, "tier": ("pro", "free")[i % 2], "sec": i * 10} for i in range(200)]
    spans = make_spans(rows)
    stream = _feed(spark, tmp_path / "in", spans.where("duration_nano < 104000000"), spans.where("duration_nano >= 104000000"))
    table, report = str(tmp_path / "table"), str(tmp_path / "report")
    ingest.st_drift(stream, table, report, str(tmp_path / "state"), every=None).awaitTermination()
    newest = START + timedelta(seconds=1990)
    assert _rows(spark.read.parquet(report)) == _rows(latency.latency_drift(spans, as_of=newest))


def test_outcome_closes_after_a_quiet_time(spark, make_spans, tmp_path):
    flow = [{"trace": "w", "name": f"activity.{n}", "sec": i, "tier": "pro"} for i, n in enumerate(
        ("validate_order", "check_fraud", "process_payment", "reserve_inventory", "schedule_shipping"))]
    spans = make_spans(flow)
    open_one = make_spans([{"trace": "v", "name": "activity.validate_order", "sec": 7200}])
    stream = _feed(spark, tmp_path / "in", spans, open_one)
    closed = run_available(joins.st_workflow_outcome(stream), "append")
    assert [(r["trace_id"], r["status"]) for r in closed.collect()] == [("w", "completed")]
    everything = run_available(joins.st_workflow_outcome(stream)).drop("closed_at")
    assert _rows(everything) == _rows(workflow.workflow_outcome(spans.unionByName(open_one)))


def test_otlp_stream(spark, tmp_path):
    (tmp_path / "a.json").write_text(
        '{"resourceSpans":[{"scopeSpans":[{"spans":[{"traceId":"t","spanId":"s","name":"activity.x",'
        '"startTimeUnixNano":"1709294400000000000","endTimeUnixNano":"1709294400000000007"}]}]}]}\n'
    )
    stream = stream_otlp(spark, str(tmp_path), "traces")
    path = scratch_path(spark, "otlp")
    ingest.st_ingest(stream, path, scratch_path(spark, "state"), every=None).awaitTermination()
    row = spark.read.parquet(path).first()
    assert (row["trace_id"], row["duration_nano"], row["hour"]) == ("t", 7, 12)
