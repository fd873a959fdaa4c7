import pytest
from pyspark.sql import functions as F

from spanops.functions import scalars as X
from spanops.operators import workflow

STEPS = ["validate_order", "check_fraud", "process_payment", "reserve_inventory", "schedule_shipping"]


def _flow(trace, upto=5, failed=None, tier="pro", score=0.3, attempts=1, refund=False):
    """Steps of one workflow; the failed step fails on every attempt."""
    rows, sec = [], 0
    for step in STEPS[:upto]:
        bad = step == failed
        for _ in range(attempts if bad else 1):
            sec += 1
            numbers = {"order.amount": 100.0}
            if step == "check_fraud" and not bad:
                numbers["fraud.score"] = score
            strings = {"shipping.eta": "2024-03-03"} if step == "schedule_shipping" and not bad else {}
            rows.append({
                "trace": trace, "name": f"activity.{step}", "sec": sec, "error": bad, "numbers": numbers, "strings": strings,
                "tier": None if step == "reserve_inventory" else tier, "span": f"{trace}-{sec}",
            })
        if bad:
            break
    if refund:
        rows.append({"trace": trace, "name": "activity.refund_payment", "sec": sec + 1, "span": f"{trace}-r"})
    return rows


def test_outcomes_partition_the_traces(make_spans):
    rows = (
        _flow("done") + _flow("fraud", upto=2, score=0.81) + _flow("edge", upto=2, score=0.8)
        + _flow("pay", failed="process_payment", attempts=3) + _flow("inv", failed="reserve_inventory", refund=True)
        + _flow("open", upto=3)
    )
    out = {r["trace_id"]: r for r in workflow.workflow_outcome(make_spans(rows)).collect()}
    assert {k: r["status"] for k, r in out.items()} == {
        "done": "completed", "fraud": "rejected_fraud", "edge": "in_flight", "pay": "failed:process_payment",
        "inv": "failed:reserve_inventory", "open": "in_flight",
    }
    assert out["done"]["total_charged"] == 108.0 and out["done"]["shipping_eta"] == "2024-03-03"
    assert out["fraud"]["total_charged"] is None and out["inv"]["tier"] == "pro"


def test_last_attempt_decides(make_spans):
    rows = _flow("w", upto=2)
    rows.insert(0, {**rows[0], "sec": 0, "error": True, "span": "early"})
    assert workflow.workflow_outcome(make_spans(rows)).first()["status"] == "in_flight"
    rows[0] = {**rows[0], "sec": 99, "name": "activity.check_fraud"}
    assert workflow.workflow_outcome(make_spans(rows)).first()["status"] == "failed:check_fraud"


def test_retries(make_spans):
    rows = _flow("a", failed="process_payment", attempts=3) + _flow("b")
    out = {r["activity"]: r for r in workflow.retry_attempts(make_spans(rows)).collect()}
    row = out["activity.process_payment"]
    assert (row["workflows"], row["attempts"], row["most_attempts"], row["max_attempts"]) == (2, 4, 3, 3)
    assert (row["retried"], row["exhausted"], row["exhausted_pct"]) == (1, 1, 50.0)
    # The inventory span carries no tier of its own.
    assert out["activity.reserve_inventory"]["tier"] == "pro"


def test_compensation(make_spans):
    rows = (
        _flow("ok") + _flow("r", failed="reserve_inventory", refund=True) + _flow("m", failed="reserve_inventory")
        + _flow("s", failed="schedule_shipping") + _flow("x", refund=True)
    )
    out = dict(workflow.compensation_audit(make_spans(rows)).select("trace_id", "audit").collect())
    assert out == {"r": "refunded", "m": "missing_refund", "s": "charged_not_refunded", "x": "refund_without_failure"}


def test_failure_reasons(make_spans):
    rows = [
        {"name": "activity.process_payment", "tier": "pro", "strings": {"payment.failure_reason": "card_declined"}},
        {"name": "activity.reserve_inventory", "strings": {"inventory.failure": "out_of_stock"}},
        {"name": "activity.check_fraud", "tier": "pro"},
    ]
    out = workflow.failure_reasons(make_spans(rows)).collect()
    assert [(r["reason"], r["tier"], r["failures"]) for r in out] == [("card_declined", "pro", 1), ("out_of_stock", "", 1)]


@pytest.mark.parametrize("score,decision", [(0.5, "approve"), (0.51, "review"), (0.8, "review"), (0.81, "reject")])
def test_fraud_decision(spark, score, decision):
    assert spark.range(1).select(X.fraud_decision(F.lit(score))).first()[0] == decision


def test_retry_schedule(spark):
    orders = spark.createDataFrame([("enterprise",), ("pro",), ("other",)], "customer_tier string")
    out = X.retry_schedule(orders).orderBy("customer_tier", "retry").collect()
    waits = {}
    for r in out:
        waits.setdefault(r["customer_tier"], []).append(r["wait_ms"])
        assert r["total_wait_ms"] == pytest.approx(sum(waits[r["customer_tier"]]))
    assert waits == {"enterprise": [500.0, 750.0, 1125.0, 1687.5], "pro": [1000.0, 2000.0], "other": [2000.0]}


def test_guards(spark):
    row = spark.range(1).select(
        X.ratio(F.lit(1), F.lit(0)).alias("a"),
        X.resource_upsert(F.create_map(F.lit("deployment.environment"), F.lit("dev"))).alias("m"),
        X.resource_upsert(F.lit(None).cast("map<string,string>")).alias("n"),
        X.message_template(F.lit("order 12 took 3.5 s, id 0123456789abcdef0123456789abcdef")).alias("t"),
    ).first()
    assert row["a"] is None and row["m"] == row["n"] == {"deployment.environment": "production"}
    assert row["t"] == "order <n> took <n> s, id <id>"
