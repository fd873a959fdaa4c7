from datetime import timedelta

from pyspark.sql import functions as F

from spanops.operators import timeseries
from spanops.plans import panels
from tests.conftest import START


def test_gap_fill_between(spark):
    series = spark.createDataFrame(
        [(START, "a", 4), (START + timedelta(minutes=3), "a", 6)], "ts timestamp_ntz, activity string, n bigint"
    )
    out = timeseries.gap_fill(series, keys=["activity"], value="n", step="1 minute").collect()
    assert [r["n"] for r in out] == [4, 0, 0, 6]
    assert [r["ts"] for r in out] == [START + timedelta(minutes=i) for i in range(4)]


def test_gap_fill_covers_every_series_and_given_ends(spark):
    rows = [(START + timedelta(minutes=i), k, 1) for k, i in (("a", 0), ("b", 2), ("a", 4))]
    series = spark.createDataFrame(rows, "ts timestamp_ntz, k string, n bigint")
    out = timeseries.gap_fill(series, keys=["k"], value="n", step="1 minute")
    assert out.groupBy("k").count().orderBy("k").collect() == [("a", 5), ("b", 5)]
    assert out.agg(F.sum("n")).first()[0] == 3
    wide = timeseries.gap_fill(
        series, keys=["k"], value="n", step="1 minute", start=START - timedelta(minutes=1), end=START + timedelta(minutes=6)
    )
    assert wide.where("k = 'b'").count() == 8
    assert wide.agg(F.sum("n")).first()[0] == 3


def test_series_and_pivot(make_spans):
    rows = [{"tier": "pro", "sec": 1}, {"tier": "free", "sec": 2}, {"tier": "pro", "sec": 61}]
    spans = make_spans(rows)
    traffic = timeseries.traffic_ts(spans, window=None)
    assert [(r["tier"], r["requests"]) for r in traffic.collect()] == [("free", 1), ("pro", 1), ("pro", 1)]
    wide = timeseries.series_pivot(traffic, key="tier", value="requests", values=["pro", "free"]).collect()
    assert [(r["pro"], r["free"]) for r in wide] == [(1, 1), (1, None)]


def test_error_rate_only_with_errors(make_spans):
    rows = [{"sec": 0}, {"sec": 1, "error": True}, {"sec": 400}]
    out = timeseries.error_rate_ts(make_spans(rows), window=None).collect()
    assert [(r["total_spans"], r["error_spans"], r["error_rate_pct"]) for r in out] == [(2, 1, 50.0)]


def test_p99_by_tier_keeps_empty_tier_and_any_service(make_spans):
    rows = [{"tier": "", "ms": 5, "service": "other"}, {"tier": None}, {"tier": "pro", "ms": 7}]
    out = timeseries.p99_by_tier_ts(make_spans(rows), start=START, end=START).collect()
    assert [(r["customer_tier"], r["value"]) for r in out] == [("", 5e6), ("pro", 7e6)]


def test_panel_pack_and_sink(make_spans, spark, tmp_path):
    rows = [
        {"tier": t, "sec": -i * 20, "ms": 50 + i, "name": n, "error": i % 30 == 0}
        for i in range(60) for t in ("pro", "free") for n in ("activity.check_fraud", "activity.validate_order")
    ]
    spans = make_spans(rows)
    pack = panels.panel_pack(spans, as_of=START)
    assert list(pack) == list(panels.PANEL_WINDOWS)
    names = panels.sink_panels(spans, str(tmp_path), as_of=START)
    for name in names:
        written = spark.read.parquet(f"{tmp_path}/{name}")
        assert sorted(map(str, written.collect())) == sorted(map(str, pack[name].collect()))
    steps = pack["ts-step-breakdown"]
    assert steps.select("ts").distinct().count() == 31
    assert panels.long_panels(pack).where("word = '🟢 NORMAL'").count() == 2


def test_tag_is_removed_afterwards(spark):
    with panels.tag_query(spark, "a, b"):
        assert "a; b" in spark.getTags()
    assert "a; b" not in spark.getTags()


def test_a_value_that_is_null_stays(spark):
    rows = [(START, "a", 1), (START + timedelta(minutes=1), "a", None), (START + timedelta(minutes=3), "a", 4)]
    series = spark.createDataFrame(rows, "ts timestamp_ntz, k string, v int")
    out = timeseries.gap_fill(series, keys=["k"], value="v", step="1 minute")
    assert [r["v"] for r in out.collect()] == [1, None, 0, 4]


def test_all_panels_share_one_instant(make_spans):
    """Without an ``as_of`` the clock is read once: every panel's lower bound comes from the same present."""
    import re

    spans = make_spans([{"sec": 0, "tier": "pro"}])
    found = set()
    for frame in panels.panel_pack(spans, windows={name: "1 hour" for name in panels.PANEL_WINDOWS}, baseline="1 hour").values():
        mode = frame._sc._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("simple")
        plan = frame._jdf.queryExecution().explainString(mode)
        found |= set(re.findall(r"timestamp#\d+ >= (\d{4}-\d\d-\d\d \d\d:\d\d:\d\d(?:\.\d+)?)", plan))
    assert len(found) == 1
