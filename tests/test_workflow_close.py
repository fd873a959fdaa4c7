import random
from datetime import timedelta

import pytest
from pyspark.sql import functions as F

from spanops.operators import workflow
from spanops.operators.correlate import attribute_error
from spanops.streaming.run import run_available
from spanops.streaming.workflows import st_workflow_close, state_store
from tests.conftest import START
from tests.test_streaming import _feed, _rows

STEPS = [f"activity.{n}" for n in ("validate_order", "check_fraud", "process_payment", "reserve_inventory", "schedule_shipping")]


@pytest.fixture(autouse=True)
def store(spark):
    with state_store(spark):
        yield


def flow(trace, sec, upto=5, **more):
    return [{"trace": trace, "span": f"{trace}{i}", "name": name, "sec": sec + i, "tier": "pro", **more} for i, name in enumerate(STEPS[:upto])]


def closed(stream, **options):
    return run_available(st_workflow_close(stream, **options), "append")


def test_closes_when_shipping_ends_and_else_when_quiet(spark, make_spans, tmp_path):
    first = make_spans(flow("done", 0) + flow("stuck", 0, 3))
    second = make_spans(flow("other", 200))  # the watermark passes the end of shipping, not the quiet time
    third = make_spans(flow("last", 7200))
    rows = {r["trace_id"]: r for r in closed(_feed(spark, tmp_path / "in", first, second, third)).collect()}
    assert set(rows) == {"done", "stuck", "other"}
    utc = lambda s: (START + timedelta(seconds=s)).replace(tzinfo=None)
    assert rows["done"]["status"] == "completed" and rows["stuck"]["status"] == "in_flight"
    assert rows["done"]["closed_at"] == utc(4 + 30) and rows["stuck"]["closed_at"] == utc(2 + 600)
    assert {r["revision"] for r in rows.values()} == {1}


def test_early_rows_are_out_before_the_quiet_time(spark, make_spans, tmp_path):
    stream = _feed(spark, tmp_path / "in", make_spans(flow("done", 0) + flow("stuck", 0, 3)), make_spans(flow("other", 300)))
    assert [r["trace_id"] for r in closed(stream).collect()] == ["done"]


def test_late_retries_count(spark, make_spans, tmp_path):
    first = make_spans(flow("w", 0))
    soon = make_spans([{"trace": "w", "span": "again", "name": STEPS[2], "sec": 20, "tier": "pro"}] + flow("x", 190))
    between = make_spans(flow("y", 200))
    # After the row was shown: the watermark stands at 84 s, the retry of shipping at 100 s fails.
    late = make_spans([{"trace": "w", "span": "retry", "name": STEPS[4], "sec": 100, "error": True}])
    last = make_spans(flow("end", 7200))
    feed = (first, soon, between, late, last)
    rows = [r for r in closed(_feed(spark, tmp_path / "in", *feed)).collect() if r["trace_id"] == "w"]
    rows.sort(key=lambda r: r["revision"])
    assert [(r["revision"], r["spans"], r["status"]) for r in rows] == [(1, 6, "completed"), (2, 7, "failed:schedule_shipping")]


@pytest.mark.parametrize("error", [None, "attribute"])
def test_last_revision_equals_the_batch_report(spark, make_spans, tmp_path, error):
    rng, rows = random.Random(3), []
    for k in range(60):
        sec = rng.randrange(0, 900)
        for i, name in enumerate(STEPS[: rng.choice([1, 2, 3, 4, 5, 5, 5])]):
            for attempt in range(rng.choice([1, 1, 2])):
                failed = rng.random() < 0.2
                rows.append({
                    "trace": f"w{k}", "span": f"{k}-{i}-{attempt}", "name": name, "sec": sec + 5 * i + attempt, "error": failed and error is None,
                    "tier": rng.choice(["pro", "free", None]),
                    "strings": {"shipping.eta": f"2024-03-0{rng.randrange(1, 9)}"} if i == 4 else {"payment.failure_reason": "x"} if failed else {},
                    "numbers": {"order.amount": float(k), "fraud.score": rng.random()},
                })
    spans = make_spans(sorted(rows, key=lambda r: r["sec"] + rng.randrange(0, 100)))
    by_hash = lambda k: F.pmod(F.xxhash64("span_id"), F.lit(3)) == k
    end = make_spans(flow("end", 20_000))
    feed = [spans.where(by_hash(k)) for k in range(3)]
    flag = attribute_error() if error else None
    found = closed(_feed(spark, tmp_path / "in", *feed, end), error=flag, delay="30 minutes")
    newest = found.groupBy("trace_id").agg(F.max_by(F.struct(*[c for c in found.columns if c != "trace_id"]), "revision").alias("r"))
    want = workflow.workflow_outcome(spans, error=flag)
    got = newest.select("trace_id", "r.*").select(*want.columns)
    assert _rows(got) == _rows(want)


def test_empty_and_null_traces(spark, make_spans, tmp_path):
    odd = make_spans([{"trace": "", "sec": 0}, {"trace": None, "sec": 0}])
    assert closed(_feed(spark, tmp_path / "in", odd, make_spans(flow("end", 7200)))).collect() == []


def test_one_bucket_holds_many_workflows(spark, make_spans, tmp_path):
    """Workflows that share a state and a timer: equal and different times due, one state row, NaN kept apart from NULL."""
    nan = {"numbers": {"order.amount": float("nan"), "fraud.score": float("nan")}}
    first = make_spans(flow("a", 0) + flow("b", 0) + flow("c", 1, 2) + flow("d", 2, 3, **nan) + [{"trace": "u", "sec": 3, "at": None}])
    later = make_spans(flow("x", 200) + [{"trace": "b", "span": "again", "name": STEPS[0], "sec": 199, "tier": "free"}])
    end = make_spans(flow("end", 20_000))
    stream = st_workflow_close(_feed(spark, tmp_path / "in", first, later, end), buckets=1)
    out = str(tmp_path / "out")
    query = stream.writeStream.outputMode("append").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "state")).format("parquet").start(out)
    query.awaitTermination()
    assert {p["stateOperators"][0]["numRowsTotal"] for p in query.recentProgress} == {1}
    found = spark.read.parquet(out)
    got = found.groupBy("trace_id").agg(F.max("revision").alias("revision"), F.max_by("spans", "revision").alias("spans"))
    assert {r["trace_id"]: (r["revision"], r["spans"]) for r in got.collect()} == {"a": (1, 5), "b": (1, 6), "c": (1, 2), "d": (1, 3), "x": (1, 5)}
    scores = {r["trace_id"]: r["fraud_score"] for r in found.where("revision = 1").collect()}
    assert scores["a"] is None and scores["d"] != scores["d"]
