from datetime import timedelta

from pyspark.sql import functions as F

from spanops import schema as S
from spanops.functions.scalars import attribute_error
from spanops.operators import correlate, explore, latency
from spanops.session import materialize
from tests.conftest import START


def test_logs_do_not_multiply_spans(make_spans, make_logs):
    spans = make_spans([{"trace": "t", "span": "s", "error": True}, {"trace": "t", "span": "z", "sec": 1}])
    logs = make_logs([{"trace": "t", "span": "s"}] * 3 + [{"trace": "t", "span": None, "severity": "WARN"}, {"trace": "t", "severity": "INFO", "span": "s"}])
    row = correlate.trace_log_correlation(spans, logs, window=None).first()
    # The log without a span id is counted once, with the first span of its trace.
    assert (row["total_spans"], row["error_spans"], row["bad_logs"], row["logged_without_error"]) == (2, 1, 4, 0)


def test_semi_and_anti(make_spans, make_logs):
    spans = make_spans([{"trace": "a", "error": True}, {"trace": "b", "error": True}, {"trace": "c"}])
    logs = make_logs([{"trace": "a"}, {"trace": "c"}, {"trace": "b", "severity": "INFO"}])
    assert [r["trace_id"] for r in correlate.error_logs_for_failed(spans, logs).collect()] == ["a"]
    assert [r["trace_id"] for r in correlate.unlogged_failures(spans, logs).collect()] == ["b"]


def test_effective_error(make_spans, make_logs):
    rows = [
        {"trace": "a", "span": "1"}, {"trace": "a", "span": "2", "error": True}, {"trace": "a", "span": "3"},
        {"trace": "a", "span": "4", "strings": {"inventory.failure": ""}},
    ]
    logs = make_logs([{"trace": "a", "span": "3", "severity": "WARN"}] * 2)
    spans = make_spans(rows)
    flags = correlate.effective_error(spans, logs).orderBy("span_id").select("effective_error").collect()
    assert [r[0] for r in flags] == [False, True, True, True]
    alone = correlate.effective_error(spans).orderBy("span_id").select("effective_error").collect()
    assert [r[0] for r in alone] == [False, True, False, True]


def test_tier_backfill(make_spans):
    rows = [{"trace": "a", "tier": "pro"}, {"trace": "a"}, {"trace": "a", "tier": ""}, {"trace": "b"}]
    out = correlate.tier_backfill(make_spans(rows)).groupBy("trace_id", "tier").count()
    assert sorted(map(tuple, out.collect()), key=str) == [("a", "pro", 3), ("b", None, 1)]


def _chain(n, trace="t"):
    return [{"trace": trace, "span": f"{trace}{i}", "parent": f"{trace}{i - 1}" if i else None, "ms": 100 - i} for i in range(n)]


def test_depth_of_a_long_chain_loops_and_orphans(make_spans):
    rows = _chain(40)
    rows += [{"trace": "o", "span": "x", "parent": "missing"}]
    rows += [{"trace": "l", "span": "p", "parent": "q"}, {"trace": "l", "span": "q", "parent": "p"}, {"trace": "l", "span": "r", "parent": "q"}]
    out = {(r["trace_id"], r["span_id"]): r["depth"] for r in correlate.span_depths(make_spans(rows)).collect()}
    assert [out["t", f"t{i}"] for i in range(40)] == list(range(40))
    assert out["o", "x"] == 0
    assert out["l", "p"] is None and out["l", "q"] is None and out["l", "r"] is None


def test_self_time(make_spans):
    rows = [
        {"trace": "t", "span": "a", "ms": 100}, {"trace": "t", "span": "b", "parent": "a", "ms": 30},
        {"trace": "t", "span": "c", "parent": "a", "ms": 50}, {"trace": "t", "span": "d", "parent": "c", "ms": 80},
    ]
    out = {r["span_id"]: r for r in correlate.parent_child(make_spans(rows)).collect()}
    assert [(out[s]["child_count"], out[s]["self_nano"]) for s in "abcd"] == [(2, 20_000_000), (0, 30_000_000), (1, 0), (0, 80_000_000)]
    assert out["d"]["depth"] == 2 and out["b"]["parent_name"] == "activity.check_fraud"


def test_trace_details(make_spans, make_logs):
    spans = make_spans(_chain(3) + _chain(2, "u"))
    logs = make_logs([{"trace": "t", "span": "t1", "sec": 2}, {"trace": "u", "span": "u1"}])
    out = explore.trace_details(spans, "t", logs).collect()
    assert [(r["kind"], r["depth"], r["offset_ms"]) for r in out] == [
        ("span", 0, 0.0), ("span", 1, 0.0), ("span", 2, 0.0), ("log", None, 2000.0)
    ]


def test_hot_trace_keeps_every_row(make_spans, make_logs, spark):
    """A third of all spans in one trace, with AQE allowed to split it."""
    hot = make_spans([{"trace": "hot", "tier": "pro"}])
    ids = F.explode(F.transform(F.sequence(F.lit(1), F.lit(3000)), lambda i: F.concat(F.lit("h"), i.cast("string"))))
    many = hot.withColumn("span_id", ids).withColumn("attributes_string", F.create_map(F.lit("customer.id"), F.lit("c")))
    cold = make_spans([{"trace": f"c{i}", "span": f"c{i}", "tier": "free"} for i in range(50)])
    spans = many.unionByName(cold).unionByName(hot)
    out = dict(correlate.tier_backfill(spans).groupBy("tier").count().collect())
    assert out == {"pro": 3001, "free": 50}


def test_explore_search_and_aggregate(make_spans, make_logs):
    spans = make_spans([{"sec": i, "ms": i, "tier": "pro" if i % 2 else "free"} for i in range(10)])
    newest = explore.search_traces(spans, "name LIKE '%fraud%'", limit=3).collect()
    assert [r["span_id"] for r in newest] == ["s9", "s8", "s7"]
    out = explore.aggregate_traces(spans, "max", "duration_nano", group_by=["customer.tier"]).collect()
    assert [(r["customer_tier"], r["value"]) for r in out] == [("pro", 9_000_000), ("free", 8_000_000)]
    for kind in ("count", "avg", "sum", "min", "p50", "count_distinct"):
        assert explore.aggregate_traces(spans, kind, "duration_nano").count() == 1
    values = explore.field_values(spans, "customer.tier").collect()
    assert [(r["value"], r["rows"]) for r in values] == [("free", 5), ("pro", 5)]
    logs = make_logs([{"trace": "a", "body": "payment failed for 17"}, {"trace": "b", "body": "payment failed for 4"}, {"trace": "c", "body": "ok", "severity": "INFO"}])
    assert explore.search_logs(logs, "payment", severity=["ERROR"], limit=1).count() == 1
    assert explore.search_logs(logs, limit=None).count() == 3 and explore.search_traces(spans, limit=None).count() == 10
    patterns = explore.aggregate_logs(logs, ["severity_text"], patterns=True).collect()
    assert [(r["pattern"], r["logs"]) for r in patterns] == [("payment failed for <n>", 2), ("ok", 1)]
    both = explore.builder_query(spans, {"n": ("count", None), "p": ("p99", "duration_nano"), "d": ("count_distinct", "trace_id")}).first()
    assert (both["n"], both["d"]) == (10, 10)


def test_failures_told_by_attributes_only(make_spans, make_logs):
    """Spans that never set a status count as failed where the caller's expression says so."""
    key = S.FAILURE_KEYS[0]
    rows = [{"trace": "a", "strings": {key: "out of stock"}, "ms": 5000}, {"trace": "b", "ms": 5000}, {"trace": "c", "strings": {key: "declined"}}]
    spans, logs = make_spans(rows), make_logs([{"trace": "a"}, {"trace": "b"}])
    failed = attribute_error()
    assert correlate.error_logs_for_failed(spans, logs).count() == 0
    assert [r["trace_id"] for r in correlate.error_logs_for_failed(spans, logs, failed).collect()] == ["a"]
    assert [r["trace_id"] for r in correlate.unlogged_failures(spans, logs, failed).collect()] == ["c"]
    assert explore.list_services(spans, error=failed).first()["error_rate_pct"] == 66.67
    assert explore.top_operations(spans, S.WORKER_SERVICE, error=failed).first()["errors"] == 2
    silent = latency.silent_failure(spans, window=None, error=failed).first()
    assert silent["silent_spans"] == 1


def test_rounds_write_only_open_spans(make_spans, monkeypatch):
    written = []

    def counting(frame, kind="table"):
        written.append(frame.count())
        return materialize(frame, kind)

    monkeypatch.setattr(correlate, "materialize", counting)
    rows = [r for k in range(20) for r in _chain(3, f"c{k}-")] + _chain(12, "long-")
    depths = correlate.span_depths(make_spans(rows))
    assert depths.groupBy("depth").count().count() == 12 and depths.count() == 72
    # All spans once, then those that a round before left open.
    assert written[:3] == [72, 51, 30] and written == sorted(written, reverse=True) and written[-1] < 12


def test_time_ranges_of_log_joins(make_spans, make_logs):
    spans = make_spans([{"trace": "old", "error": True, "sec": -7200}, {"trace": "a", "error": True, "sec": 0}, {"trace": "b", "error": True, "sec": 10}])
    logs = make_logs([{"trace": "old", "sec": -7100}, {"trace": "a", "sec": 5}, {"trace": "b", "sec": -7000}])
    at = {"window": "1 hour", "as_of": START + timedelta(seconds=60)}
    assert [r["trace_id"] for r in correlate.error_logs_for_failed(spans, logs, **at).collect()] == ["a"]
    assert {r["trace_id"] for r in correlate.error_logs_for_failed(spans, logs).collect()} == {"old", "a", "b"}
    assert [r["trace_id"] for r in correlate.unlogged_failures(spans, logs, **at).collect()] == ["b"]
    flags = correlate.effective_error(spans.withColumn("has_error", F.lit(False)), logs.withColumn("span_id", F.lit("s1")), **at)
    assert {r["trace_id"]: r["effective_error"] for r in flags.collect()} == {"a": True, "b": False}
    # The bound reaches the scan of the logs as a plain comparison of the column.
    row = correlate.trace_log_correlation(spans.withColumn("has_error", F.lit(False)), logs, error=F.col("trace_id") == "b", **at).collect()
    assert sum(r["error_spans"] for r in row) == 1 and sum(r["bad_logs"] for r in row) == 1
