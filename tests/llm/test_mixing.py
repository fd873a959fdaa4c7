import os

import numpy as np
import pytest

from spanops.llm import mixing
from tests.llm import frames

SF_DIR = "/root/testdata/sf0.1"
LABELS = "doc_id long, quality int, toxic int"


def test_projected_gradient_against_numpy(spark):
    """The fitted rates are those of the same descent over single documents; the targets are met."""
    rng = np.random.default_rng(1)
    p = rng.dirichlet([0.3, 0.3, 0.3], 200)
    whole = np.floor(p * mixing.GRID).astype(int)
    whole[:, 0] += mixing.GRID - whole.sum(1)
    t = rng.integers(1, 900, 200)
    df = spark.createDataFrame([(row.tolist(), int(n)) for row, n in zip(whole, t, strict=True)], "mix_p array<int>, mix_tokens long")
    want = {"clean": 1.2, "low": 0.4, "toxic": 0.1}
    steps = mixing.fit_rates(df, want)
    q = whole / mixing.GRID
    r = np.ones(200)
    for g in steps:
        r = np.maximum(0, r - q @ np.array(g[:3]) - g[3] * (r - 1))
    got = np.array([x[0] for x in df.select(mixing.rate_column(mixing.F.col("mix_p"), steps)).collect()])
    np.testing.assert_allclose(got, r, atol=1e-9)
    have = (t[:, None] * q).sum(0)
    met = (r[:, None] * t[:, None] * q).sum(0)
    assert (r >= 0).all()
    assert np.abs(met - have * np.array(list(want.values()))).max() < 0.02 * have.sum()


@pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="test tables are not there")
def test_held_out_accuracy_and_targets(spark):
    docs, known = spark.read.parquet(f"{SF_DIR}/documents.parquet"), spark.read.parquet(f"{SF_DIR}/labels.parquet")
    out = mixing.rates(docs, known.where("doc_id % 4 != 1"))
    held = out.join(known.where("doc_id % 4 = 1"), "doc_id").toPandas()
    held["domain"] = np.where(held.toxic == 1, 2, np.where(held.quality == 0, 1, 0))
    guess = held[["p_clean", "p_low", "p_toxic"]].to_numpy().argmax(1)
    assert (guess == held.domain).mean() > 0.95
    assert (held.rate[(held.domain == 0)] >= 1).mean() > 0.97
    assert held.rate[held.domain == 2].mean() < 0.5


@pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="test tables are not there")
def test_clean_documents_stay_where_a_domain_is_rare(spark):
    """Where earlier stages left hardly any text of a domain, its traces in the posteriors cost no clean document."""
    docs, known = spark.read.parquet(f"{SF_DIR}/documents.parquet"), spark.read.parquet(f"{SF_DIR}/labels.parquet")
    left = docs.join(known.where("quality = 0 and doc_id % 50 <> 0"), "doc_id", "left_anti")
    clean = known.where("quality = 1 and toxic = 0").select("doc_id")
    kept = mixing.mix(left, known).join(clean, "doc_id", "left_semi").select("doc_id").distinct().count()
    assert kept >= 0.98 * clean.join(docs, "doc_id", "left_semi").count()


def test_whole_texts_are_read(spark):
    """A word at the very end of a long text decides as one at its start does."""
    filler = "plain words of no meaning " * 3000
    rows = [(k, filler + ("vile" if k % 2 else "kind")) for k in range(140)]
    known = spark.createDataFrame([(k, 1, k % 2) for k in range(100)], LABELS)
    out = {r.doc_id: r for r in mixing.rates(spark.createDataFrame(rows, "doc_id long, text string"), known).collect()}
    assert all((out[k].p_toxic > 0.5) == bool(k % 2) for k in range(100, 140))


def test_rows_and_columns(spark):
    rows = frames.mixed()
    df = frames.docs(spark, rows).selectExpr("*", "1 as mix_rate", "2 as rate", "'x' as `odd name`")
    known = spark.createDataFrame([(3 * k % 101, k % 3 != 0 and 1 or 0, int(k % 5 == 0)) for k in range(40)] + [(None, 1, 0), (3, None, None)], LABELS)
    out = mixing.rates(df.repartition(3), known)
    assert out.count() == len(rows) and out.where("rate < 0").count() == 0
    assert out.where("n_tokens = 0 and doc_id in (500, 501, 502)").count() == 3
    mixed = mixing.mix(df, known)
    assert mixed.columns == df.columns
    assert mixed.count() == mixing.mix(df, known).count()
    assert mixing.rates(df.limit(0), known).count() == 0 and mixing.mix(df.limit(0), known).count() == 0
    none = mixing.rates(df, known.limit(0)).collect()
    assert {r.rate for r in none} == {1.0} and none[0].p_clean is None and len(none) == len(rows)


def test_values_of_clashing_columns(spark):
    rows = [(k, f"word{k} kind" if k % 2 else f"word{k} vile") for k in range(120)]
    known = spark.createDataFrame([(k, 1, int(k % 2 == 0)) for k in range(100)], LABELS)
    df = frames.docs(spark, rows).selectExpr("*", "doc_id * 2 as mix_p", "'a' as mix_rate", "array(doc_id) as mix_tokens", "struct(doc_id) as mix_row", "7 as rate", "8 as draw", "9 as `a.b`")
    out = mixing.mix(df, known)
    assert out.columns == df.columns
    kept = [tuple(r) for r in out.collect()]
    assert kept and set(map(repr, kept)) <= {repr(tuple(r)) for r in df.collect()}


@pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="test tables are not there")
def test_totals_meet_the_targets(spark):
    docs, known = spark.read.parquet(f"{SF_DIR}/documents.parquet"), spark.read.parquet(f"{SF_DIR}/labels.parquet")
    out = mixing.rates(docs, known)
    sums = out.selectExpr(*[f"sum(n_tokens * p_{d} * rate) / sum(n_tokens * p_{d}) as {d}" for d in mixing.DOMAINS]).first()
    for d in mixing.DOMAINS:
        assert abs(sums[d] / mixing.TARGETS[d] - 1) < 0.05, (d, sums)
