from datetime import timedelta

import pytest

from spanops import schema as S
from spanops.operators import metrics
from tests.conftest import START


def _points(spark, rows):
    """(metric, seconds, label, value, counts)"""
    out = [
        (
            START + timedelta(seconds=sec), name, "sum" if counts is None else "histogram", "svc", {"k": label}, value,
            None if counts is None else [10.0, 20.0], counts, None, None, "cumulative" if counts is None else "delta",
        )
        for name, sec, label, value, counts in rows
    ]
    return spark.createDataFrame(out, S.METRIC_POINTS)


def test_rate_with_reset_across_pieces(spark):
    values = [(0, 10.0), (30, 40.0), (70, 100.0), (130, 5.0), (190, 25.0), (250, 30.0)]
    points = _points(spark, [("c", s, "a", v, None) for s, v in values] + [("c", 0, "b", 1.0, None)])
    out = metrics.query_metrics(points, "c", step="2 minutes", aggregation="rate", group_by=["k"]).collect()
    got = {(r["k"], (r["ts"] - START).seconds): r["value"] * 120 for r in out}
    # 10 to 100 in the first bucket; the reset to 5 counts as 5; then 20 and 5 more.
    assert got[("a", 0)] == pytest.approx(90) and got[("a", 120)] == pytest.approx(25) and got[("a", 240)] == pytest.approx(5)
    assert got[("b", 0)] == 0


def test_plain_aggregations_and_formula(spark):
    points = _points(spark, [("a", 0, "x", 6.0, None), ("a", 10, "x", 2.0, None), ("b", 0, "x", 2.0, None), ("b", 70, "x", 0.0, None), ("a", 70, "x", 3.0, None)])
    series = {n: metrics.query_metrics(points, n, aggregation="sum") for n in ("a", "b")}
    out = metrics.metric_formula(series, "try_divide(a, b)").collect()
    assert [r["value"] for r in out] == [4.0, None]


def test_histogram_quantile(spark):
    points = _points(spark, [("h", 0, "x", None, [2, 6, 0]), ("h", 1, "x", None, [0, 2, 0])])
    value = metrics.metric_histogram_quantile(points, "h", 0.5).first()["value"]
    assert value == pytest.approx(10 + 10 * (5 - 2) / 8)
    beyond = _points(spark, [("h", 0, "x", None, [0, 0, 4])])
    assert metrics.metric_histogram_quantile(beyond, "h", 0.5).first()["value"] == 20.0
    assert metrics.metric_histogram_quantile(points, "h", 0.0).first()["value"] == 0.0


def test_catalogue(spark):
    points = _points(spark, [("a", 0, "x", 1.0, None), ("a", 1, "y", 1.0, None), ("a", 2, "y", 1.0, None)])
    row = metrics.list_metrics(points).first()
    assert (row["metric_name"], row["series"], row["points"]) == ("a", 2, 3)


def _laid_out(spark, rows, temporality="delta"):
    """(seconds, bounds, counts)"""
    out = [
        (START + timedelta(seconds=sec), "h", "histogram", "svc", {}, None, bounds, counts, None, None, temporality) for sec, bounds, counts in rows
    ]
    return spark.createDataFrame(out, S.METRIC_POINTS)


def _quantiles(points, *qs, **options):
    return [metrics.metric_histogram_quantile(points, "h", q, **options).first()["value"] for q in qs]


def test_histograms_of_different_bounds_add_up(spark):
    points = _laid_out(spark, [(0, [10.0, 100.0], [0, 100, 0]), (1, [60.0], [0, 100])])
    # 55.6 of the first lie below 60, where the hundred beyond 60 count.
    got = _quantiles(points, 0.1, 0.25, 0.5, 0.75, 0.9, 1.0)
    assert got == sorted(got)
    assert got == pytest.approx([10 + 90 * 0.2, 10 + 90 * 0.5, 60, 60, 60 + 40 * (180 - 155.5555555) / 44.4444444, 100])


def test_refined_bounds_against_plain_sums(spark):
    import random

    rng = random.Random(5)
    layouts = [sorted(rng.sample(range(1, 200), rng.randrange(1, 6))) for _ in range(5)]
    rows = [(k % 50, [float(b) for b in layouts[k % 5]], [rng.randrange(0, 9) for _ in range(len(layouts[k % 5]) + 1)]) for k in range(40)]
    pieces = [(([0.0, *b])[i], ([*b, None])[i], c) for _, b, cs in rows for i, c in enumerate(cs) if c]
    n = sum(c for *_, c in pieces)

    def upto(x):
        return sum(c * (float(x >= lo) if hi is None else min(1.0, max(0.0, (x - lo) / (hi - lo)))) for lo, hi, c in pieces)

    points = _laid_out(spark, rows)
    for q in (0.03, 0.2, 0.5, 0.77, 0.93, 0.999):
        (value,) = _quantiles(points, q)
        assert upto(value) >= q * n - 1e-6 and upto(value - 1e-6) <= q * n + 1e-6


def test_empty_buckets_and_odd_bounds(spark):
    assert _quantiles(_laid_out(spark, [(0, [10.0, 20.0, 30.0], [5, 0, 5, 0])]), 0.5, 0.500001, 0.0) == pytest.approx([10, 20, 0], abs=1e-3)
    assert _quantiles(_laid_out(spark, [(0, [-20.0, -10.0], [0, 4, 0])]), 0.5) == [-15]
    assert _quantiles(_laid_out(spark, [(0, [], [7])]), 0.5) == [0]
    assert metrics.metric_histogram_quantile(_laid_out(spark, [(0, [1.0], [0, 0])]), "h", 0.5).count() == 0


def test_cumulative_histograms_across_pieces(spark):
    rows = [(0, [10.0], [5, 0]), (30, [10.0], [7, 1]), (70, [10.0], [9, 1]), (100, [10.0], [1, 0]), (400, [10.0], [4, 6])]
    points = _laid_out(spark, rows, "cumulative")
    counted = metrics.histogram_counts(points).orderBy("timestamp")
    assert [r["bucket_counts"] for r in counted.collect()] == [[2, 1], [2, 0], [1, 0], [3, 6]]
