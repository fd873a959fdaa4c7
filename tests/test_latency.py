import pytest

from spanops.functions import quantiles
from spanops.operators import explore, latency, timeseries


def test_zero_spread_is_normal(make_spans):
    row = latency.zscore_anomaly(make_spans([{"ms": 35}] * 10), window=None).first()
    assert row["z_score"] is None and row["health"] == "NORMAL" and row["tail_spread_pct"] == 0.0


def test_group_floor(make_spans):
    rows = [{"name": "activity.a"}] * 9 + [{"name": "activity.b"}] * 10
    assert [r["activity"] for r in latency.zscore_anomaly(make_spans(rows), window=None).collect()] == ["activity.b"]


@pytest.mark.parametrize("values,label", [
    ([10] * 995 + [5000] * 15, "ANOMALOUS"),
    ([100] * 75 + [400] * 25, "LONG TAIL"),
    ([100, 101] * 50, "NORMAL"),
])
def test_health_labels(make_spans, values, label):
    spans = make_spans([{"ms": v} for v in values])
    assert latency.zscore_anomaly(spans, window=None).first()["health"] == label


def test_null_scores_sort_last(make_spans):
    rows = [{"name": "activity.flat", "ms": 5}] * 10 + [{"name": "activity.x", "ms": i} for i in range(1, 40)]
    out = latency.zscore_anomaly(make_spans(rows), window=None).collect()
    assert [r["activity"] for r in out] == ["activity.x", "activity.flat"]


@pytest.mark.parametrize("ms,label", [
    (201, "CRITICAL"), (200, "DRIFTING"), (151, "DRIFTING"), (150, "ELEVATED"), (111, "ELEVATED"), (105, "HEALTHY"),
    (89, "UNDER-BASELINE"),
])
def test_drift_labels(make_spans, ms, label):
    rows = [{"ms": 100}] * 995 + [{"ms": ms, "tier": "pro"}] * 5
    row = latency.latency_drift(make_spans(rows), live=None, baseline=None).first()
    assert row["baseline_p99_ms"] == 100.0
    assert row["status"] == label
    assert row["drift_pct"] == pytest.approx(ms - 100)


def test_drift_zero_baseline(make_spans):
    row = latency.latency_drift(make_spans([{"ms": 0, "tier": "pro"}] * 6), live=None, baseline=None).first()
    assert row["drift_pct"] is None and row["status"] == "HEALTHY"


def test_drift_needs_five_spans(make_spans):
    rows = [{"ms": 100, "tier": "pro"}] * 4 + [{"ms": 100, "tier": "free"}] * 5
    assert [r["tier"] for r in latency.latency_drift(make_spans(rows), live=None, baseline=None).collect()] == ["free"]


def test_peer_median(make_spans):
    values = {"a": 10, "b": 20, "c": 30, "d": 40, "e": 5000}
    rows = [{"name": f"activity.{k}", "ms": v} for k, v in values.items()]
    out = {r["activity"][-1]: r["peer_median_p99_ms"] for r in latency.peer_latency_ratio(make_spans(rows), window=None).collect()}
    for key in values:
        others = sorted(v for k, v in values.items() if k != key)
        assert out[key] == (others[1] + others[2]) / 2
    ties = [{"name": f"activity.{k}", "ms": v} for k, v in zip("abcd", (10, 10, 20, 20))]
    out = {r["activity"][-1]: r["peer_median_p99_ms"] for r in latency.peer_latency_ratio(make_spans(ties), window=None).collect()}
    assert out == {"a": 20, "b": 20, "c": 10, "d": 10}
    alone = latency.peer_latency_ratio(make_spans([{"ms": 5}]), window=None).first()
    assert alone["peer_ratio"] is None


def test_silent_failure_verdicts(make_spans):
    # The recorded figures: nearly the same P99 in every tier, far above the peers, no errors.
    p99 = {"pro": 25_199_942_524, "free": 25_198_009_983, "enterprise": 25_175_404_774}
    rows = [{"tier": t, "ns": ns} for t, ns in p99.items()]
    for peer in ("validate_order", "process_payment", "schedule_shipping"):
        rows += [{"name": f"activity.{peer}", "ms": 60 + i, "tier": "pro"} for i in range(3)]
    out = {r["activity"]: r for r in latency.silent_failure(make_spans(rows), window=None).collect()}
    row = out["activity.check_fraud"]
    assert (row["verdict"], row["silent_spans"], row["tier_spread_pct"]) == ("SYSTEMIC", 3, 0.1)
    assert out["activity.validate_order"]["verdict"] == "OK"
    rows[0]["ns"] //= 2
    out = {r["activity"]: r for r in latency.silent_failure(make_spans(rows), window=None).collect()}
    assert out["activity.check_fraud"]["verdict"] == "SLOW"


def test_workflow_latency(make_spans):
    rows = [
        {"trace": "a", "sec": 0, "ms": 100, "tier": "pro"},
        {"trace": "a", "sec": 5, "ms": 500},
        {"trace": "b", "sec": 0, "ms": 1500, "tier": "pro"},
    ]
    row = latency.workflow_latency(make_spans(rows), window=None).first()
    assert (row["workflows"], row["p50_ms"], row["max_ms"]) == (2, 3500.0, 5500.0)


def test_histogram(make_spans):
    spans = make_spans([{"ms": m} for m in (0, 99.9, 100, 250)])
    out = latency.latency_histogram(spans, window=None).collect()
    assert [(r["bucket_ms"], r["spans"]) for r in out] == [(0.0, 2), (100.0, 1), (200.0, 1)]


def test_modes_agree_roughly(make_spans):
    rows = [{"ms": i} for i in range(1, 500)]
    spans = make_spans(rows)
    exact, approx, kll = (
        latency.zscore_anomaly(spans, window=None, quantile_mode=m).first()["p95_ms"] for m in ("exact", "approx", "kll")
    )
    assert approx == pytest.approx(exact, rel=0.02) and kll == pytest.approx(exact, rel=0.05)


def test_reports_are_the_same_for_groups_too_large_for_a_buffer(make_spans, monkeypatch):
    rows = [
        {"ms": (i * i) % 977 + i / 1000, "tier": ("pro", "free", None)[i % 3], "sec": i * 40, "trace": f"t{i // 4}",
         "name": ("activity.check_fraud", "activity.x", "activity.y")[i % 7 % 3], "error": i % 50 == 0}
        for i in range(400)
    ]
    spans = make_spans(rows)
    reports = [
        lambda: latency.zscore_anomaly(spans, window=None),
        lambda: latency.latency_drift(spans, live=None, baseline=None),
        lambda: latency.rolling_drift(spans, window=None),
        lambda: latency.silent_failure(spans, window=None, ceiling_ms=500),
        lambda: latency.workflow_latency(spans, window=None),
        lambda: timeseries.p99_trend_ts(spans, window=None, step="30 minutes"),
        lambda: explore.builder_query(
            spans, {"n": ("count", None), "p": ("p95", "duration_nano")}, group_by=["customer.tier"], order_by=["customer_tier"]
        ),
    ]
    small = [report().collect() for report in reports]
    monkeypatch.setattr(quantiles, "GROUP_ROWS", 0)
    for report, expected in zip(reports, small):
        found = report().collect()
        assert len(found) == len(expected)
        for a, b in zip(found, expected):
            assert all(x == y or (isinstance(x, float) and x == pytest.approx(y)) for x, y in zip(a, b))
