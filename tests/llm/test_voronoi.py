import math
import random

import pytest

from spanops.llm import voronoi
from tests.llm import frames  # noqa: F401

SF_DIR = "/root/testdata/sf0.001"
KIND = "vec_id long, embedding array<float>, label int"


def brute(rows, k=5, every=50):
    whole = []
    for i, v in rows:
        if i is None or v is None or any(x is None or not math.isfinite(x) for x in v) or not v:
            continue
        whole.append((i, [math.floor(256 * x) for x in v]))
    out, seen = [], set()
    for i, q in whole:
        if i % every or i in seen:
            continue
        seen.add(i)
        found = sorted((-sum(a * b for a, b in zip(q, v, strict=True)), j) for j, v in whole if j != i)[:k]
        out += [(i, n, j, -s) for n, (s, j) in enumerate(found, 1)]
    return sorted(out)


def result(df, **kw):
    return sorted(tuple(r) for r in voronoi.top_k(df, **kw).select("query_id", "rank", "vec_id", "score").collect())


def frame(spark, rows):
    return spark.createDataFrame([(i, v, 0) for i, v in rows], KIND)


def test_small_table_whole(spark):
    df = spark.read.parquet(f"{SF_DIR}/embeddings.parquet")
    rows = [(r.vec_id, r.embedding) for r in df.collect()]
    assert result(df) == brute(rows)


@pytest.mark.parametrize("pivots", [1, 6])
def test_clusters_ties_and_bad_rows(spark, monkeypatch, pivots):
    rng = random.Random(4)
    centers = [[rng.gauss(0, 1) for _ in range(6)] for _ in range(5)]
    f32 = lambda v: spark.sparkContext._jvm.java.lang.Float.valueOf(str(v)).doubleValue()  # noqa: E731,F841
    rows = [(k, [round(8 * (c + rng.gauss(0, 0.05))) / 8 for c in centers[k % 5]]) for k in range(400)]
    rows += [(1000 + k, list(rows[50][1])) for k in range(60)]  # many equal vectors: ties to the smaller id
    rows += [(2000, None), (2050, [float("nan")] * 6), (2100, [None] + [0.0] * 5), (2150, [float("inf")] * 6), (None, rows[0][1]), (-50, rows[3][1]), (2200, [])]
    monkeypatch.setattr(voronoi, "DATA_BLOCK", 64)
    monkeypatch.setattr(voronoi, "QUERY_BLOCK", 3)
    assert result(frame(spark, rows).repartition(4), pivots=pivots) == brute(rows)


def test_bounds_leave_rows_out(spark):
    """Well separated groups: what is far from a pivot is not sent to it."""
    import numpy as np

    v = np.array([[100, 0], [101, 1], [-100, 0]])
    d = voronoi._distances(v, np.zeros(3), np.array([[100.0, 0.0]]), np.zeros(1))
    assert d[:, 0].round(3).tolist() == [0.0, 1.414, 200.0]


def test_few_candidates_and_empty(spark):
    rows = [(0, [0.5, 0.25]), (1, [1.0, 0.0]), (50, [0.0, 1.0])]
    assert result(frame(spark, rows)) == brute(rows)
    assert result(frame(spark, [])) == [] and result(frame(spark, [(0, [1.0])])) == []
    assert result(frame(spark, [(1, [1.0]), (2, [2.0])])) == []
    assert result(frame(spark, [(0, [1.0, 2.0]), (0, [1.0, 2.0]), (1, [1.0, 1.0])])) == [(0, 1, 1, 256 * 256 * 3)]


def test_large_components(spark):
    """Squared lengths beyond 2^63; the inner products of the query fit."""
    rows = [(0, [1.0, 0.5]), (1, [1e8, 0.0]), (2, [1e8, 3e7]), (3, [-1e8, 2.0]), (50, [0.25, -1.0]), (51, [0.0, 0.0]), (52, [2.0, 1e7])]
    assert result(frame(spark, rows)) == brute(rows)
