from datetime import timedelta

import pytest
from pyspark.sql import functions as F

from spanops.operators import explore
from spanops.sources import locator, tables
from tests.conftest import START
from tests.test_streaming import _feed, _rows


def _opened(frame):
    """Partitions that the scans of a frame's last run opened."""
    frame.collect()
    plan = frame._jdf.queryExecution().executedPlan()
    if plan.getClass().getSimpleName() == "AdaptiveSparkPlanExec":
        plan = plan.executedPlan()
    leaves = plan.collectLeaves()
    found = {}
    for k in range(leaves.size()):
        leaf = leaves.apply(k)
        if hasattr(leaf, "metrics") and leaf.getClass().getSimpleName() == "FileSourceScanExec":
            metrics = leaf.metrics()
            found[k] = tuple(metrics.apply(name).value() if metrics.contains(name) else None for name in ("numFiles", "numPartitions"))
    return list(found.values())


@pytest.fixture()
def stored(spark, make_spans, tmp_path):
    rows = [{"trace": f"t{k % 40}", "span": f"s{k}", "parent": f"s{k - 40}" if k >= 40 else None, "sec": (k % 40) * 3600 + k // 40 * 60} for k in range(160)]
    spans = make_spans(rows).withColumn("timestamp", F.col("timestamp").cast("timestamp"))
    path, index = str(tmp_path / "spans"), str(tmp_path / "locator")
    for part in range(2):
        locator.write_located(spans.where(F.pmod(F.xxhash64("span_id"), F.lit(2)) == part), path, index)
    return spans, path, index


def test_only_the_hours_of_the_trace_are_opened(spark, stored):
    spans, path, index = stored
    own = spans.where("trace_id = 't17'")
    with_index = locator.trace_spans(spark, path, index, "t17")
    assert _rows(with_index.select("span_id", "timestamp")) == _rows(own.select("span_id", "timestamp"))
    without = tables.read_spans(spark, path).where("trace_id = 't17'")
    ((files, partitions),) = _opened(with_index.select("span_id"))
    ((all_files, all_partitions),) = _opened(without.select("span_id"))
    assert partitions == 1 and all_partitions == 40 and files <= 2 < all_files


def test_place_of_a_trace(spark, stored):
    _, _, index = stored
    found = locator.locate(spark, index, "t3")
    begin = START + timedelta(hours=3)
    assert (found.first, found.last, found.spans) == (begin, begin + timedelta(minutes=3), 4)
    assert found.hours == [(begin.date(), begin.hour)]
    assert locator.locate(spark, index, "nowhere") is None


def test_details_equal_those_of_the_whole_table(spark, stored, make_logs, tmp_path):
    spans, path, index = stored
    rows = [{"trace": "t5", "span": "s5", "sec": 5 * 3600 + 30}, {"trace": "t5", "sec": 5 * 3600 + 1800}, {"trace": "t6", "sec": 6 * 3600}]
    logs = make_logs(rows).withColumn("timestamp", F.col("timestamp").cast("timestamp"))
    stored_logs = str(tmp_path / "logs")
    tables.write_telemetry(logs, stored_logs)
    got = locator.located_trace_details(spark, path, index, "t5", stored_logs)
    assert _rows(got) == _rows(explore.trace_details(spans, "t5", logs)) and got.count() == 6
    assert locator.located_trace_details(spark, path, index, "nowhere", stored_logs).count() == 0


def test_traces_over_midnight_later_spans_and_odd_ids(spark, make_spans, tmp_path):
    path, index = str(tmp_path / "spans"), str(tmp_path / "locator")
    make = lambda rows: make_spans(rows).withColumn("timestamp", F.col("timestamp").cast("timestamp"))
    locator.write_located(make([{"trace": "a", "span": "1", "sec": 42_000}, {"trace": "", "sec": 0}, {"trace": None, "sec": 0}]), path, index)
    locator.write_located(make([{"trace": "a", "span": "2", "sec": 43_300}, {"trace": "b", "sec": 43_300}]), path, index)
    found = locator.locate(spark, index, "a")
    assert len({d for d, _ in found.hours}) == 2 and found.spans == 2
    assert locator.trace_spans(spark, path, index, "a").count() == 2
    assert locator.locate(spark, index, "") is None
    locator.write_locator(make([{"trace": "a", "sec": 0}]).limit(0), index)
    assert locator.locate(spark, index, "a").spans == 2


def test_locator_of_a_stream(spark, make_spans, tmp_path):
    spans = make_spans([{"trace": f"t{k % 5}", "sec": k * 600} for k in range(30)])
    stream = _feed(spark, tmp_path / "in", spans.where("trace_id < 't3'"), spans.where("trace_id >= 't3'"))
    index = str(tmp_path / "locator")
    query = stream.writeStream.foreachBatch(locator.locating(index)).option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
    query.awaitTermination()
    locator.locating(index)(spans.where("trace_id >= 't3'"), 1)  # delivered again
    assert [locator.locate(spark, index, f"t{k}").spans for k in range(5)] == [6] * 5
