import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from spanops.functions import quantiles
from spanops.functions.quantiles import exact_quantiles, group_stats
from spanops.operators import explore

POINTS = {"p0": 0.0, "p1": 0.01, "p50": 0.5, "p95": 0.95, "p99": 0.99, "p100": 1.0}


def _expected(pdf):
    return {
        key: [float(np.percentile(group["v"].dropna(), p * 100)) for p in POINTS.values()]
        for key, group in pdf.dropna(subset=["v"]).groupby("k", dropna=False)
    }


def _check(df, pdf, **options):
    rows = exact_quantiles(df, {"k": F.col("k")}, F.col("v"), POINTS, **options).collect()
    expected = {None if isinstance(k, float) else k: v for k, v in _expected(pdf).items()}
    assert {r["k"] for r in rows} == set(expected)
    for r in rows:
        np.testing.assert_allclose([r[q] for q in POINTS], expected[r["k"]], rtol=1e-12)


def _frame(kind):
    rng = np.random.default_rng(7)
    if kind == "skewed":
        # One group with most rows, half of them one value; a tiny group; a group of one value.
        hot = np.concatenate([np.full(3000, 35_000_000), rng.integers(1, 30_000_000_000, 3000)])
        parts = [("hot", hot), ("tiny", np.array([5, 9])), ("one", np.array([42])), ("flat", np.full(50, 7))]
    elif kind == "doubles":
        parts = [("a", rng.normal(0, 1e6, 2000)), ("b", np.concatenate([rng.normal(0, 1e-3, 500), [0.0, -0.0, 1e300, -1e300]]))]
    elif kind == "nulls":
        values = rng.integers(-500, 500, 800).astype("float64")
        values[::7] = np.nan
        parts = [(None, values), ("n", np.full(3, np.nan)), ("x", rng.integers(0, 3, 100).astype("float64"))]
    else:
        parts = [("a", rng.integers(-(2**62), 2**62, 1500)), ("b", rng.integers(2**61, 2**61 + 500, 900))]
    frames = [pd.DataFrame({"k": [k] * len(v), "v": v}) for k, v in parts]
    return pd.concat(frames, ignore_index=True)


@pytest.mark.parametrize("kind", ["skewed", "doubles", "nulls", "huge"])
@pytest.mark.parametrize("range_rows", [4_000_000, 10])
def test_exact_by_ranges(spark, kind, range_rows):
    pdf = _frame(kind)
    whole = kind in ("skewed", "huge")
    rows = [
        (k if isinstance(k, str) else None, None if v != v else (int(v) if whole else float(v)))
        for k, v in zip(pdf["k"], pdf["v"])
    ]
    df = spark.createDataFrame(rows, f"k string, v {'bigint' if whole else 'double'}").repartition(5)
    _check(df, pdf, group_rows=0, range_rows=range_rows)


def test_exact_in_buffer(spark):
    pdf = _frame("skewed")
    df = spark.createDataFrame([(k, int(v)) for k, v in zip(pdf["k"], pdf["v"])], "k string, v bigint")
    _check(df, pdf)


@pytest.mark.parametrize("group_rows", [0, 10**9])
def test_stats_next_to_quantiles(spark, group_rows):
    df = spark.range(1000).select((F.col("id") % 3).alias("k"), F.col("id").alias("v"))
    extra = [F.count("*").alias("n"), F.sum("v").alias("total")]
    rows = group_stats(df, {"k": F.col("k")}, F.col("v"), {"m": 0.5}, extra, group_rows=group_rows).orderBy("k").collect()
    assert [(r["k"], r["n"], r["m"]) for r in rows] == [(0, 334, 499.5), (1, 333, 499.0), (2, 333, 500.0)]
    whole = group_stats(df, {}, F.col("v"), {"m": 0.5}, extra, group_rows=group_rows).collect()
    assert [(r["n"], r["m"]) for r in whole] == [(1000, 499.5)]
    nothing = group_stats(df.where("v < 0"), {}, F.col("v"), {"m": 0.5}, extra, group_rows=group_rows).collect()
    assert [(r["n"], r["m"]) for r in nothing] == [(0, None)]


@pytest.mark.parametrize("mode,tolerance", [("approx", 0.001), ("kll", 0.03)])
def test_sketches_are_close_in_rank(spark, mode, tolerance):
    rng = np.random.default_rng(3)
    values = rng.integers(1, 10**9, 20_000)
    df = spark.createDataFrame(pd.DataFrame({"v": values}))
    row = group_stats(df, {}, F.col("v"), POINTS, mode=mode).first()
    ordered = np.sort(values)
    for name, p in POINTS.items():
        rank = np.searchsorted(ordered, row[name]) / len(ordered)
        assert abs(rank - p) <= tolerance
    found = [row[q] for q in POINTS]
    assert found == sorted(found)


def test_unknown_mode(spark):
    with pytest.raises(ValueError):
        group_stats(spark.range(3), {}, F.col("id"), {"m": 0.5}, mode="guess")


def _brute(pdf):
    return {(None if isinstance(k, float) else k): v for k, v in _expected(pdf).items()}


@pytest.mark.parametrize("kind", ["skewed", "doubles", "nulls", "huge", "large"])
@pytest.mark.parametrize("bracket", [None, 0.0])
def test_exact_by_sketch(spark, monkeypatch, kind, bracket):
    """Brackets of no width miss some ranks; the result is exact all the same."""
    if bracket is not None:
        monkeypatch.setattr(quantiles, "BRACKET", bracket)
        monkeypatch.setattr(quantiles, "SKETCH_K", 16)
    rng = np.random.default_rng(9)
    pdf = pd.DataFrame({"k": ["a"] * 30_000 + ["b"] * 500, "v": rng.integers(0, 10**12, 30_500)}) if kind == "large" else _frame(kind)
    whole = kind in ("skewed", "huge", "large")
    rows = [(k if isinstance(k, str) else None, None if v != v else (int(v) if whole else float(v))) for k, v in zip(pdf["k"], pdf["v"])]
    df = spark.createDataFrame(rows, f"k string, v {'bigint' if whole else 'double'}").repartition(5)
    got = group_stats(df, {"k": F.col("k")}, F.col("v"), POINTS, [F.count("*").alias("rows")], group_rows=0).collect()
    expected = _brute(pdf)
    assert {r["k"] for r in got} == {None if isinstance(k, float) else k for k in pdf["k"].unique()}
    for r in got:
        if r["k"] in expected:
            np.testing.assert_allclose([r[q] for q in POINTS], expected[r["k"]], rtol=1e-12)
        else:
            assert [r[q] for q in POINTS] == [None] * len(POINTS)


def test_two_scans(spark, monkeypatch):
    df = spark.range(60_000).select((F.col("id") % 3).alias("k"), (F.col("id") * 7919 % 60_013).alias("v"))
    written = []
    real = quantiles.materialize

    def counting(frame, kind="table"):
        written.append(kind)
        return real(frame, kind)

    monkeypatch.setattr(quantiles, "materialize", counting)
    group_stats(df, {"k": F.col("k")}, F.col("v"), POINTS, [F.sum("v").alias("total")], group_rows=0).collect()
    assert written == ["brackets", "ranks"]


@pytest.mark.parametrize("group_by", [["customer.tier"], []])
def test_a_single_quantile_of_large_groups(make_spans, monkeypatch, group_by):
    """A lone quantile has no plain aggregates beside it, and results may be called like the counters of the pass."""
    monkeypatch.setattr(quantiles, "GROUP_ROWS", 0)
    spans = make_spans([{"ms": i, "tier": "pro" if i % 2 else None} for i in range(10)])
    rows = explore.aggregate_traces(spans, "p50", "duration_nano", group_by=group_by).collect()
    assert [r["value"] for r in rows] == ([5_000_000, 4_000_000] if group_by else [4_500_000])
    wanted = {"_n": ("count", None), "_low": ("min", "duration_nano"), "mid": ("p50", "duration_nano")}
    rows = explore.builder_query(spans, wanted, group_by=group_by).collect()
    found = {(r["_n"], r["_low"], r["mid"]) for r in rows}
    assert found == ({(5, 0, 4_000_000), (5, 1_000_000, 5_000_000)} if group_by else {(10, 0, 4_500_000)})
