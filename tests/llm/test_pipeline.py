import os
import random

import pytest

import corpus_pipeline
from spanops.llm import linecrf, mixing, pieces, secretscan
from spanops.llm import common
from tests.llm import frames
from tests.llm.test_partenum import brute as classes

SF_DIR = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="test tables are not there")
def test_against_brute_force(spark):
    """Every stage by plain Python over the stage before, with the same fitted models."""
    docs, labels = spark.read.parquet(f"{SF_DIR}/documents.parquet"), spark.read.parquet(f"{SF_DIR}/labels.parquet")
    crf, hashes = linecrf.train(docs, labels), common.WordHashes()
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    rows = [(i, t) for i, t in rows if linecrf.measure(t, hashes, crf)[6]]
    first = {i for i, _, c in classes(rows, 80, 5) if i == c}
    rows = [(i, secretscan.redact(t, secretscan.secret_spans(t))) for i, t in rows if i in first]
    got = corpus_pipeline.run(spark, SF_DIR).collect()
    coder = pieces.codec(pieces.default_model())
    ids = {i: coder.encode(t) for i, t in rows}
    assert {r.doc_id for r in got} <= set(ids)
    assert all(r.ids == ids[r.doc_id] and r.decoded_equal for r in got)
    # The mixture repeats or leaves out rows by the fitted rate of each document.
    df = frames.docs(spark, rows)
    rate = {r.doc_id: r.rate for r in mixing.rates(df, labels).collect()}
    copies = {i: sum(r.doc_id == i for r in got) for i in ids}
    assert all(int(rate[i]) <= n <= int(rate[i]) + 1 for i, n in copies.items())


def test_columns_of_documents_until_the_last(spark):
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs.limit(30), SF_DIR).columns == docs.columns
    assert [name for name, _ in corpus_pipeline.STAGES][0] == "quality rules" and len(corpus_pipeline.STAGES) == 5


def _stages(spark, docs, until=5):
    for _, stage in corpus_pipeline.STAGES[:until]:
        docs = stage(spark, docs, SF_DIR)
    return docs


def _text(seed, n=60):
    rng = random.Random(seed)
    return " ".join(rng.choice("the of and to in that is for with on river stone garden letter music window people".split()) + str(rng.randrange(30)) for _ in range(n)) + "."


@pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="test tables are not there")
def test_odd_rows_and_clashing_columns(spark):
    copy, near = _text(1), _text(2, 200)
    rows = [
        (1, None), (2, ""), (3, " \n\t"), (10, copy), (11, copy), (None, copy), (20, near), (21, near + " more words"), (None, near + " end"),
        (None, _text(3)), (None, _text(3)), (30, _text(4)), (30, _text(4)), (30, _text(5)), (40, _text(6, 20_000)),
        (50, _text(7) + " pwd = Zx81kQpL55a9 token = abcdefgh1234"),
    ]
    docs = frames.docs(spark, rows)
    extra = docs.selectExpr("*", "doc_id as k_id", "'c' as comp", "1 as mix_p", "2.5 as mix_rate", "array(1) as mix_tokens", "named_struct('a', 1) as r", "'x' as kept")
    before = {}
    for i, t in rows:
        before.setdefault(i, []).append(t)
    deduped = _stages(spark, extra, 2)
    assert deduped.columns == extra.columns
    left = sorted((r.doc_id is None, r.doc_id or 0, r.text) for r in deduped.collect())
    want = [(False, 10, copy), (False, 20, near), (False, 30, _text(4)), (False, 30, _text(5)), (False, 40, _text(6, 20_000)), (True, 0, _text(3))]
    assert [x for x in left if x[1] != 50] == sorted(want)
    mixed = _stages(spark, extra, 4)
    assert mixed.columns == extra.columns
    for r in mixed.collect():
        assert (r.k_id, r.comp, r.mix_p, float(r.mix_rate), r.mix_tokens, r.r.a, r.kept) == (r.doc_id, "c", 1, 2.5, [1], 1, "x")
        assert r.n_chars == len(r.text) and "Zx81kQpL55a9" not in r.text and "abcdefgh1234" not in r.text
    assert all(r.decoded_equal for r in _stages(spark, extra).collect())


@pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="test tables are not there")
def test_ties_go_to_the_first_row_as_json(spark):
    rows = [(7, _text(8)), (7, _text(8)), (7, _text(8))]
    docs = frames.docs(spark, rows).drop("source")
    tagged = docs.limit(1).selectExpr("*", "'b' as source").unionByName(docs.limit(1).selectExpr("*", "'a' as source")).unionByName(docs.limit(1).selectExpr("*", "'c' as source"))
    assert [r.source for r in corpus_pipeline.near_duplicates(spark, tagged.repartition(3), SF_DIR).collect()] == ["a"]


@pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="test tables are not there")
def test_empty_table(spark):
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet").limit(0)
    for until in range(1, 6):
        assert _stages(spark, docs, until).collect() == []
