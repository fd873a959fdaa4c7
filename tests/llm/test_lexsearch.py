import random
from collections import Counter

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from spanops.llm import common, lexsearch, registered
from tests.llm.frames import docs, mixed


def ranking(rows, query, top=10):
    """(doc_id, score) by scoring every document."""
    held = [(i, lexsearch.terms(t or "")) for i, t in rows]
    n_docs, length = sum(bool(t) for _, t in held), sum(len(t) for _, t in held)
    df = Counter(w for _, t in held for w in set(t))
    out = []
    for doc_id, words in held:
        tf = Counter(words)
        m = 25 + 75 * len(words) * n_docs // max(1, length)
        score = sum(lexsearch.weight(df[w], n_docs) * (10**9 * tf[w] // (1000 * tf[w] + 8 * m)) for w in lexsearch.terms(query or "") if tf[w])
        if score > 0:
            out.append((-score, doc_id is not None, doc_id or 0, doc_id))
    return [(d, -s) for s, _, _, d in sorted(out, key=lambda x: x[:3])[:top]]


def items(spark, rows):
    return spark.createDataFrame(rows, "item_id long, text string")


def found(frame):
    out = {}
    for r in sorted(frame.collect(), key=lambda r: (repr(r.item_id), r.rank)):
        out.setdefault(r.item_id, []).append((r.doc_id, r.score))
        assert r.rank == len(out[r.item_id])
    return out


def skewed(rng, n, alpha):
    return " ".join(f"w{int(rng.paretovariate(alpha))}" for _ in range(n))


@pytest.mark.parametrize("seed", range(6))
def test_shard_search(seed, monkeypatch):
    rng = random.Random(seed)
    monkeypatch.setattr(lexsearch, "RANGE", rng.choice([4, 16, 1024]))
    monkeypatch.setattr(lexsearch, "SHORT_SHARE", rng.choice([1, 2, 8, 64, 10_000]))
    rows = [(i, skewed(rng, rng.choice([0, 1, 5, 40, 80]), rng.choice([0.5, 1]))) for i in rng.sample(range(10_000), 300)]
    held = [lexsearch.terms(t) for _, t in rows]
    visited = ranges = 0
    for _ in range(8):
        query = skewed(rng, rng.choice([1, 3, 10]), 0.5)
        number = {w: k for k, w in enumerate(dict.fromkeys(lexsearch.terms(query)))}
        triples = [(d, number[w], c) for d, t in enumerate(held) for w, c in Counter(t).items() if w in number] or [(0, 0, 0)][:0]
        d, t, c = np.array(triples, np.int64).reshape(-1, 3).T
        shard = lexsearch.build(np.array([i for i, _ in rows]), np.array([len(t) for t in held]), d, t, c)
        df, total = Counter(w for t in held for w in set(t)), sum(bool(t) for t in held)
        search = lexsearch.ShardSearch(shard, total, sum(map(len, held)))
        wanted = [(number[w], k * lexsearch.weight(df[w], total)) for w, k in Counter(lexsearch.terms(query)).items()]
        assert [(int(shard.ids[at]), s) for at, s in search.top(wanted)] == ranking(rows, query)
        visited, ranges = visited + search.visited, ranges + search.ranges
    assert visited <= ranges


def test_ranges_are_skipped(monkeypatch):
    """Documents that hold only the frequent term are never reached once ten hold the rare one as well."""
    monkeypatch.setattr(lexsearch, "RANGE", 16)
    n = 4096
    ids, sizes = np.arange(n), np.full(n, 10)
    doc = np.concatenate([np.arange(n), np.arange(20)])
    term = np.concatenate([np.zeros(n, np.int64), np.ones(20, np.int64)])
    search = lexsearch.ShardSearch(lexsearch.build(ids, sizes, doc, term, np.ones(len(doc), np.int64)), n, 10 * n)
    assert [at for at, _ in search.top([(0, 10), (1, 5000)])] == list(range(10))
    assert search.visited <= 2 < search.ranges


def test_defined_cases(spark, monkeypatch):
    monkeypatch.setattr(lexsearch, "SHARD_DOCS", 7)
    rng = random.Random(2)
    rows = mixed(4, 40) + [(None, "w1 w2 zebra"), (900, "Zebra-crossing ÉTÉ été"), (901, "zebra"), (902, "zebra"), (902, "zebra"), (903, "")]
    queries = [(1, "zebra"), (2, "ZEBRA zebra w1 w2 w3 w1"), (3, None), (4, ""), (5, "unknownword"), (6, "été w7"), (None, "w1 w5 w9"), (7, " ".join(f"w{rng.randrange(400)}" for _ in range(60)))]
    frame = docs(spark, rows).withColumnsRenamed({"lang": "score", "source": "rank", "n_chars": "item_id"}).repartition(5)
    asked = items(spark, [*queries, queries[0]]).withColumn("doc_id", F.lit(1)).withColumn("place", F.lit(2))
    got = found(lexsearch.search(frame, asked))
    for item_id, text in queries:
        assert got.get(item_id, []) == ranking(rows, text)


def test_blocks_of_queries(spark, monkeypatch):
    monkeypatch.setattr(lexsearch, "BLOCK_ITEMS", 2)
    rows = mixed(5, 30)
    queries = [(k, f"w{k} w{k + 1} w{k + 2}") for k in range(5)]
    got = found(lexsearch.search(docs(spark, rows), items(spark, queries)))
    for item_id, text in queries:
        assert got.get(item_id, []) == ranking(rows, text)


def test_empty_tables(spark):
    none, some = items(spark, []), items(spark, [(1, "w1")])
    assert lexsearch.search(docs(spark, mixed()), none).collect() == []
    assert lexsearch.search(docs(spark, mixed()).limit(0), some).collect() == []


def test_query_against_sql(spark):
    sf = "/root/testdata/sf0.001"
    con = duckdb.connect()
    for name in ("documents", "benchmark"):
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{sf}/{name}.parquet')")
    want = con.execute(registered.ORACLES["op13_lexical_search"]).fetchall()
    got = [tuple(r) for r in registered.op13_lexical_search(spark, sf).collect()]
    assert sorted(got) == sorted(want) and len(got) > 100
    common.prepare(spark)
