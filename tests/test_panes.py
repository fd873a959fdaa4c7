import io
import os
from contextlib import redirect_stdout
from datetime import timedelta

from pyspark.sql import functions as F

from spanops.operators import latency
from spanops.streaming import aggregates, panes
from spanops.streaming.run import run_available
from tests.conftest import START
from tests.test_streaming import _feed, _rows


def _spans(n=400, gap=7):
    return [
        {"tier": ("pro", "free", "enterprise", None)[i % 4], "sec": i * gap, "ms": 50 + (i * 37) % 400, "error": i % 11 == 0,
         "name": ("activity.check_fraud", "activity.validate_order")[i % 2], "trace": f"t{i // 3}"}
        for i in range(n)
    ]


def _fed(spark, make_spans, folder):
    """Three files of all spans, then one long after them."""
    spans = make_spans(_spans())
    third = lambda k: spans.where(F.pmod(F.xxhash64("trace_id", "duration_nano"), F.lit(3)) == k)
    after = make_spans([{"sec": 90_000, "tier": "pro"}])
    return spans, _feed(spark, folder, third(0), third(1), third(2), after)


def test_panes_give_the_rows_of_the_sliding_reports(spark, make_spans, tmp_path):
    _, stream = _fed(spark, make_spans, tmp_path / "in")
    options = {"window": "20 minutes", "slide": "5 minutes", "delay": "2 hours"}
    closed = F.col("as_of") < F.lit(START + timedelta(hours=20))
    want = run_available(aggregates.st_sliding_budget(stream, **options)).where(closed)
    assert _rows(run_available(panes.budget_panes(stream, **options), "append")) == _rows(want) and want.count() > 20
    want = run_available(aggregates.st_anomaly(stream, **options)).where(closed)
    assert _rows(run_available(panes.anomaly_panes(stream, **options), "append")) == _rows(want) and want.count() > 10


def test_a_span_enters_one_pane(spark, make_spans, tmp_path):
    _, stream = _fed(spark, make_spans, tmp_path / "in")
    result = panes.budget_panes(stream, window="1 hour", slide="5 minutes")
    out = io.StringIO()
    with redirect_stdout(out):
        result.explain("extended")
    plan = out.getvalue().split("== Physical Plan ==")[1]
    # Rows are multiplied above the first aggregate only.
    lines = plan.splitlines()
    expands = [k for k, line in enumerate(lines) if "Expand" in line or "Generate" in line]
    saves = [k for k, line in enumerate(lines) if "StateStoreSave" in line]
    assert len(saves) == 2 and len(expands) == 1 and saves[0] < expands[0] < saves[1]


def test_rows_without_a_duration_count(spark, make_spans, tmp_path):
    rows = [{"sec": i, "ms": 100} for i in range(20)] + [{"sec": 30, "ns": None} for _ in range(5)]
    stream = _feed(spark, tmp_path / "in", make_spans(rows), make_spans([{"sec": 90_000}]))
    row = run_available(panes.anomaly_panes(stream, window="10 minutes", slide="10 minutes"), "append").first()
    assert (row["executions"], row["p99_ms"], row["z_score"]) == (25, 100.0, None)


def test_drift_view_merges_stored_panes(spark, make_spans, tmp_path):
    spans = make_spans([{"ms": 100 + (i * 13) % 90, "tier": ("pro", "free", None)[i % 3], "sec": i * 10, "error": i % 7 == 0} for i in range(600)])
    files = [spans.where(F.pmod(F.xxhash64("span_id"), F.lit(3)) == k) for k in range(3)]
    store, report = str(tmp_path / "panes"), str(tmp_path / "report")
    panes.st_drift_view(_feed(spark, tmp_path / "in", *files), store, report, str(tmp_path / "state"), every=None).awaitTermination()
    got = spark.read.parquet(report)
    end = START + timedelta(minutes=100)
    assert {r["as_of"] for r in got.collect()} == {end}
    # All rows in a pane of the live time; the sketch is exact at this size, the quantile an order statistic.
    want = latency.latency_drift(spans.where(F.col("timestamp") >= F.lit(end - timedelta(minutes=30))), as_of=end, quantile_mode="kll")
    shown = {r["tier"]: (r["total_spans"], r["error_rate_pct"], r["p99_ms"]) for r in got.collect()}
    assert shown == {r["tier"]: (r["total_spans"], r["error_rate_pct"], r["p99_ms"]) for r in want.collect()}
    fleet = spans.agg(F.expr("percentile_disc(0.99) WITHIN GROUP (ORDER BY duration_nano)").alias("p")).first().p
    assert {r["baseline_p99_ms"] for r in got.collect()} == {round(fleet / 1e6, 2)}


def test_drift_view_does_not_look_at_old_panes(spark, make_spans, tmp_path):
    write = panes.drift_view(str(tmp_path / "panes"), str(tmp_path / "report"))
    day = make_spans([{"ms": 100, "tier": "pro", "sec": s} for s in range(0, 600, 10)])
    write(day, 0)
    (folder,) = [f for f in os.listdir(tmp_path / "panes") if f.startswith("hour=")]
    for name in os.listdir(tmp_path / "panes" / folder / "batch=0"):
        if name.startswith("part-"):
            (tmp_path / "panes" / folder / "batch=0" / name).write_bytes(b"unreadable")
    later = make_spans([{"ms": 200, "tier": "free", "sec": 86_400 + s} for s in range(0, 600, 10)])
    write(later, 1)
    assert [(r["tier"], r["total_spans"]) for r in spark.read.parquet(str(tmp_path / "report")).collect()] == [("free", 60)]


def test_repeated_batch_late_rows_and_empty_batch(spark, make_spans, tmp_path):
    report = str(tmp_path / "report")
    write = panes.drift_view(str(tmp_path / "panes"), report)
    now = make_spans([{"ms": 100, "tier": "pro", "sec": s} for s in range(0, 600, 10)])
    write(now, 0)
    write(now.limit(0), 1)
    write(now, 2)
    write(now, 2)
    late = make_spans([{"ms": 100, "tier": "pro", "sec": -60}])
    write(late, 3)
    write(late, 3)
    row = spark.read.parquet(report).first()
    assert (row["total_spans"], row["as_of"]) == (121, START + timedelta(minutes=10))
