from datetime import timedelta

from pyspark.sql import functions as F

from spanops.sources import tables
from spanops.streaming import joins
from spanops.streaming.run import run_available
from tests.conftest import START
from tests.test_streaming import _feed, _rows


def test_logs_without_a_span_go_to_the_first(spark, make_spans, make_logs, tmp_path):
    spans = make_spans([
        {"trace": "a", "span": "1", "sec": 10}, {"trace": "a", "span": "2", "sec": 0}, {"trace": "a", "span": "3", "sec": 0},
        {"trace": "b", "span": "4", "sec": 0}, {"trace": "c", "span": "5", "sec": 0},
    ])
    logs = make_logs([
        {"trace": "a", "sec": 20}, {"trace": "a", "sec": 20}, {"trace": "a", "sec": 20, "body": "other"}, {"trace": "a", "span": "1", "sec": 12},
        {"trace": "b", "span": "", "sec": 30}, {"trace": "c", "sec": 400}, {"trace": "c", "sec": 5, "severity": "INFO"}, {"trace": "nowhere", "sec": 5},
    ])
    end = make_spans([{"trace": "end", "span": "9", "sec": 9000}])
    left = _feed(spark, tmp_path / "spans", spans.where("span_id < '3'"), spans.where("span_id >= '3'"), end)
    right = _feed(spark, tmp_path / "logs", logs.where("span_id IS NULL"), logs.where("span_id IS NOT NULL"), make_logs([{"trace": "late", "sec": 9000}]))
    streamed = run_available(joins.st_span_logs(left, right), "append")
    found = sorted((r["span_id"], r["body"]) for r in streamed.where("body IS NOT NULL").collect())
    # Equal logs are one; of equal starts the smaller id; a log after the bound stays out.
    assert found == [("1", "payment failed"), ("2", "other"), ("2", "payment failed"), ("4", "payment failed")]
    assert {r["span_id"] for r in streamed.where("body IS NULL").collect()} == {"3", "5"}
    # The same function over stored frames.
    assert _rows(streamed) == _rows(joins.st_span_logs(spans, logs))


def test_distinct_workflows_merge(spark, make_spans, tmp_path):
    spans = make_spans([{"trace": f"t{k % 700}", "sec": k * 7} for k in range(2000)] + [{"trace": "", "sec": 0}, {"trace": None, "sec": 1}])
    path = str(tmp_path / "rollup")
    tables.rollup_workflows(spans, "10 minutes").write.parquet(path)
    stored = spark.read.parquet(path)
    whole = tables.rollup_distinct(stored, ["name"]).first()["workflows"]
    assert abs(whole - 700) <= 35  # two standard errors are 3.2 %
    half = stored.where(F.col("ts") < F.lit(START + timedelta(minutes=50)))
    exact = spans.where((F.col("timestamp") < F.lit(START + timedelta(minutes=50))) & (F.col("trace_id") != "")).agg(F.count_distinct("trace_id")).first()[0]
    assert abs(tables.rollup_distinct(half, ["name"]).first()["workflows"] - exact) <= 0.05 * exact
    stream = _feed(spark, tmp_path / "in", spans)
    streamed = run_available(tables.rollup_workflows(stream.withColumn("timestamp", F.col("timestamp").cast("timestamp")).withWatermark("timestamp", "1 minute"), "1 day"))
    assert abs(tables.rollup_distinct(streamed, ["name"]).first()["workflows"] - 700) <= 35
