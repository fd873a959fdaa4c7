import math
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from spanops.llm import pst
from tests.llm import frames

SF_DIR = "/root/testdata/sf0.001"


def model(rows):
    """The same tree with plain dictionaries, word by word."""
    trained = [(t or "").encode().lower().split() + [None] for i, t in rows if zlib.crc32(b"" if i is None else str(i).encode()) % 5 != 1]
    count = Counter(w for doc in trained for w in doc)
    n, v = sum(count.values()), len(count)
    floor = max(pst.MIN_COUNT, math.ceil(pst.MIN_SHARE * n))
    base = lambda w: (count.get(w, 0) + 0.5) / (n + 0.5 * (v + 1))
    frequent = {w for w, c in count.items() if c >= floor}
    states, candidates, totals = {}, {(): None}, {(): n}
    for depth in (1, 2):
        seen = Counter()
        for doc in trained:
            for k in range(depth, len(doc)):
                part = tuple(doc[k - depth : k + 1])
                if all(w in frequent for w in part) and (depth == 1 or part[:-1] in candidates):
                    seen[part] += 1
        pairs = {p: c for p, c in seen.items() if c >= floor}
        ctx_total = {(w,): c for w, c in count.items()} if depth == 1 else dict(candidates)
        for s in {p[:-1] for p in pairs}:
            listed = {p[-1]: c for p, c in pairs.items() if p[:-1] == s}
            total = ctx_total[s]
            spread = max(total - sum(max(c - pst.DISCOUNT, 0) for c in listed.values()), pst.DISCOUNT) / total
            parent = (lambda w: base(w)) if depth == 1 else (lambda w, s=s: prob(states, base, s[1:], w))
            p = {w: (c - pst.DISCOUNT) / total + spread * parent(w) for w, c in listed.items()}
            gain = sum(c * math.log(p[w] / parent(w)) for w, c in listed.items()) + max(total - sum(listed.values()), 0) * math.log(spread)
            if gain > 0.5 * math.log(max(2, n)) * (len(listed) + 1):
                states[s] = (spread, p)
        candidates = pairs
    del totals
    return n, count, base, states


def prob(states, base, s, w):
    if not s:
        return base(w)
    if s not in states:
        return prob(states, base, s[1:], w)
    spread, p = states[s]
    return p[w] if w in p else spread * prob(states, base, s[1:], w)


def brute(rows):
    n, count, base, states = model(rows)
    out = []
    for i, t in rows:
        doc = (t or "").encode().lower().split() + [None]
        score = sum(math.log10(prob(states, base, tuple(doc[max(0, k - 2) : k]), w)) for k, w in enumerate(doc))
        out.append((i, zlib.crc32(b"" if i is None else str(i).encode()) % 5 == 1, len(doc), sum(w in count for w in doc), n, sum(math.log10(base(w)) for w in doc), score))
    return out, states


def key(r):
    return (r[0] is not None, r[0], r[2], round(r[5], 6))


def same(got, want):
    got, want = sorted(got, key=key), sorted(want, key=key)
    assert [g[:5] for g in got] == [w[:5] for w in want]
    np.testing.assert_allclose([g[5:] for g in got], [w[5:] for w in want], rtol=1e-9, atol=1e-7)


def test_against_brute_force(spark):
    rows = frames.mixed(n=64) + [(600 + k, "one two three four five six seven " * 3) for k in range(9)]
    want, states = brute(rows)
    assert {len(s) for s in states} == {1, 2}
    same([tuple(r) for r in pst.score(frames.docs(spark, rows).repartition(3)).collect()], want)


def test_small_table_whole(spark):
    df = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    rows = [(r.doc_id, r.text) for r in df.collect()]
    got = [tuple(r) for r in pst.score(df).collect()]
    same(got, brute(rows)[0])
    held = [r for r in got if r[1]]
    assert sum(r[6] for r in held) > sum(r[5] for r in held)  # contexts help on texts that were not learnt


def test_every_state_sums_to_one():
    rows = [(k, "a b c a b d a b c e f") for k in range(40)]
    n, count, base, states = model(rows)
    unseen = base("never")
    for s in states:
        total = sum(prob(states, base, s, w) for w in count) + prob(states, base, s, "never")
        assert states and unseen > 0 and total == pytest.approx(1.0, abs=1e-9)


def test_empty_and_untrained(spark):
    assert pst.score(frames.docs(spark, [])).count() == 0
    only_held = next(k for k in range(99) if zlib.crc32(str(k).encode()) % 5 == 1)
    row = pst.score(frames.docs(spark, [(only_held, "a b")])).first()
    assert (row.held_out, row.n_tokens, row.n_known, row.train_tokens, row.base_score, row.score) == (True, 3, 0, 0, 0.0, 0.0)


def test_floor_does_not_rise_with_the_input(spark):
    """Nine pairs count among 12 million tokens as they do in a small table."""
    filler = spark.range(1000, 1250).selectExpr("id as doc_id", "repeat('a ', 60000) as text")
    trained = [k for k in range(50) if zlib.crc32(str(k).encode()) % 5 != 1][:10]
    rows = frames.docs(spark, [(k, "left right") for k in trained]).select("doc_id", "text")
    out = {r.doc_id: r for r in pst.score(filler.union(rows)).collect()}
    assert out[trained[0]].train_tokens > 8 * 10**6 * 1.25
    assert all(out[k].score > out[k].base_score + 5 for k in trained)


def test_keys_outside_the_cache_are_joined(spark, monkeypatch):
    monkeypatch.setattr(pst, "CACHE", 3)
    monkeypatch.setattr(pst, "BITS", 15)  # crowded bitmaps let keys through that add nothing
    rows = frames.mixed(n=64) + [(600 + k, "one two three four five six seven " * 3) for k in range(9)]
    same([tuple(r) for r in pst.score(frames.docs(spark, rows).repartition(3)).collect()], brute(rows)[0])


def test_turns_change_no_result_and_leave_only_the_scores(spark):
    """Each turn's shuffle files and all tables but the scores go, so at no time do all of them lie on disk."""
    rows = [(k, t) for k, (_, t) in enumerate(frames.mixed(5, 30))] * 2
    df = frames.docs(spark, rows).repartition(3)
    once = sorted(tuple(r) for r in pst.score(df, pair_turns=1, score_turns=1).collect())
    many = pst.score(df, pair_turns=3, score_turns=4)
    same([tuple(r) for r in many.collect()], once)
    assert {f.rsplit("/", 2)[1].rsplit("-", 1)[0] for f in many.inputFiles()} == {"scores"}
    assert len({f.rsplit("/", 2)[1] for f in many.inputFiles()}) == 4


def test_every_pair_is_counted_in_one_turn():
    class Shared:
        value = np.full(1 << 10, 255, np.uint8)

    batch = pa.RecordBatch.from_pydict({"text": ["a b c a b d e", "a b a c", None, "e"]})
    parts = [pst._count_grams(Shared, 2, 3, turn, batch).to_pylist() for turn in range(3)]
    whole = pst._count_grams(Shared, 2, 1, 0, batch).to_pylist()
    plain = lambda rows: sorted((r["ctx"], r["rest"], r["c"]) for r in rows)
    assert plain(sum(parts, [])) == plain(whole) and all(parts)
