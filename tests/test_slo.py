import pytest
from pyspark.sql import functions as F

from spanops.operators import slo
from spanops.functions import predicates as P
from tests.conftest import START


def _budget(make_spans, failures, n=1000, tier="pro", **options):
    rows = [{"tier": tier, "error": i < failures} for i in range(n)]
    return slo.slo_budget(make_spans(rows), window=None, **options).first()


@pytest.mark.parametrize(
    "failures,label",
    [(6, "BUDGET EXHAUSTED"), (5, "BUDGET AT RISK"), (4, "BUDGET AT RISK"), (3, "BURNING FAST"), (1, "WITHIN BUDGET")],
)
def test_budget_labels(make_spans, failures, label):
    row = _budget(make_spans, failures)
    assert row["status"] == label
    assert row["budget_burn_pct"] == pytest.approx(failures * 20.0)
    assert row["error_budget"] == 5.0
    assert row["actual_uptime_pct"] == pytest.approx(100 - failures / 10)


def test_budget_icons_and_unknown_tier(make_spans):
    assert _budget(make_spans, 6, icons=True)["status"] == "🔴 BUDGET EXHAUSTED"
    assert _budget(make_spans, 1, tier="trial")["slo_target_pct"] == 99.0


def test_budget_skips_spans_without_tier(make_spans):
    rows = [{"tier": None}, {"tier": ""}, {"tier": "pro"}]
    out = slo.slo_budget(make_spans(rows), window=None).collect()
    assert [(r["tier"], r["total_requests"]) for r in out] == [("pro", 1)]


def test_tier_filters(make_spans):
    spans = make_spans([{"tier": None}, {"tier": ""}, {"tier": "pro"}])
    assert spans.where(P.attr_nonempty(spans)).count() == 1
    assert spans.where(P.attr_exists(spans)).count() == 2


def test_budget_by_trace(make_spans):
    rows = [{"tier": "free", "trace": "a", "error": e} for e in (True, True, False)]
    rows += [{"tier": "free", "trace": "b"}]
    row = slo.slo_budget(make_spans(rows), window=None, grain="trace").first()
    assert (row["total_requests"], row["failures"]) == (2, 1)


def test_remaining_goes_below_zero_and_mirrors_burn(make_spans):
    rows = [{"tier": "enterprise", "error": i < 3} for i in range(1000)]
    spans = make_spans(rows)
    assert slo.budget_remaining(spans, window=None).first()["value"] == -200.0
    burn = slo.slo_budget(spans, window=None).first()["budget_burn_pct"]
    assert burn + slo.budget_remaining(spans, window=None).first()["value"] == pytest.approx(100)


def test_empty_input(make_spans):
    nothing = make_spans([{}]).where("false")
    assert slo.timeout_rate(nothing, window=None).collect()[0]["value"] is None
    assert slo.budget_remaining(nothing, window=None).collect()[0]["value"] is None
    assert slo.workflows_processed(nothing, window=None).collect()[0]["value"] == 0
    assert slo.slo_budget(nothing, window=None).count() == 0
    assert slo.burn_rate_ts(nothing, window=None).count() == 0


def test_timeout_rate_is_strict(make_spans):
    spans = make_spans([{"ms": 1000}, {"ms": 1000.5}, {"ms": 25_000}, {"ms": 10}])
    assert slo.timeout_rate(spans, window=None).first()["value"] == 50.0


def test_workflows_count_once_despite_retries(make_spans):
    rows = [{"name": "activity.validate_order", "trace": "w"} for _ in range(3)]
    assert slo.workflows_processed(make_spans(rows), window=None).first()["value"] == 1


def test_lookback_bounds_are_inclusive(make_spans):
    spans = make_spans([{"sec": -3601}, {"sec": -3600}, {"sec": 0}, {"sec": 1}])
    inside = spans.where(P.lookback(spans, "1 hour", START)).count()
    assert inside == 2


def test_burn_rate_per_bucket(make_spans):
    rows = [{"tier": "free", "sec": 10 + i, "error": i == 0} for i in range(100)]
    rows += [{"tier": "free", "sec": 310, "error": False}]
    out = slo.burn_rate_ts(make_spans(rows), window=None).collect()
    assert [r["burn_rate_pct"] for r in out] == [100.0, 0.0]


def test_forecast(make_spans):
    hour = 3600
    rows = []
    for h, failed in enumerate([2, 0, 4]):
        if h == 1:
            continue  # an hour without traffic still counts in the recent rate
        rows += [{"tier": "free", "sec": h * hour + i, "error": i < failed} for i in range(500)]
    out = slo.budget_forecast(make_spans(rows), window=None, step="1 hour", recent=3).collect()
    assert [(r["total_failed"], r["budget"], r["remaining"]) for r in out] == [(2, 5.0, 3.0), (6, 10.0, 4.0)]
    assert out[0]["recent_rate"] == pytest.approx(2 / 3, abs=1e-4)
    assert out[1]["eta_buckets"] == pytest.approx(4 / 2.0)
    quiet = slo.budget_forecast(make_spans([{"tier": "free"}]), window=None).first()
    assert quiet["eta_buckets"] is None
    spent = slo.budget_forecast(make_spans([{"tier": "free", "error": True}]), window=None).first()
    assert spent["eta_buckets"] == 0.0


def test_burn_columns_do_not_throw_on_zero(spark):
    row = spark.createDataFrame([("pro", 0, 0)], "tier string, total_requests bigint, failures bigint").select(
        *slo.budget_columns({}, 1.0)
    ).first()
    assert row["budget_burn_pct"] is None and row["status"] == "WITHIN BUDGET"


def test_custom_error_expression(make_spans):
    spans = make_spans([{"tier": "pro", "strings": {"inventory.failure": "x"}}, {"tier": "pro"}])
    flag = F.map_contains_key("attributes_string", "inventory.failure")
    assert slo.slo_budget(spans, window=None, error=flag).first()["failures"] == 1
