import hashlib
import random
import zlib

import numpy as np

from spanops.llm import common, registered, runs
from tests.llm.frames import docs, mixed


def plain_runs(words):
    """All runs by comparing words at every distance."""
    n, found = len(words), set()
    for q in range(1, n // 2 + 1):
        i = 0
        while i < n - q:
            j = i
            while j < n - q and words[j] == words[j + q]:
                j += 1
            if j > i and j - i + q >= max(12, 2 * q):
                part = words[i : j + q]
                if all(any(part[k] != part[k + p] for k in range(len(part) - p)) for p in range(1, q)):
                    found.add((i, j - i + q, q))
            i = j + 1
    return sorted(found)


def sha(text):
    return hashlib.sha256(text.encode("utf-8", "surrogatepass")).hexdigest()


def expected(doc_id, text):
    """The query's row, from its definition."""
    words = (text or "").encode().split()
    words = [w.decode() for w in words]
    n = len(words)
    if doc_id is not None and n and zlib.crc32(str(doc_id).encode()) % 10 == 0:
        g = zlib.crc32(str(doc_id).encode()) // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
    found = plain_runs(words)
    kept = [w for i, w in enumerate(words) if not any(s + q <= i < s + k for s, k, q in found)]
    best = min(found, key=lambda r: (-r[1], r[0], r[2])) if found else (None, None, None)
    listed = "".join(f"{s},{k},{q}\n" for s, k, q in found)
    return (doc_id, len(found), *best, 1000 * best[1] // best[2] if found else None, sha(listed), sha(" ".join(kept)))


def test_random_sequences():
    rng = random.Random(7)
    for _ in range(400):
        size, n = rng.choice([1, 2, 3, 6, 40]), rng.randrange(0, 80)
        words = [rng.randrange(size) for _ in range(n)]
        if n and rng.random() < 0.6:
            a = rng.randrange(n)
            p = 1 + rng.randrange(1 + (n - a) // 2)
            words = words[:a] + [words[a + k % p] for k in range(n - a)]
        assert runs.find_runs(np.array(words, np.int64)) == plain_runs(words)


def test_squares_of_every_append():
    """The automaton alone, without the window filter: periods of primitive squares that end at each word."""
    rng = random.Random(8)
    for _ in range(100):
        words = [rng.randrange(2) for _ in range(rng.randrange(1, 40))]
        paths = runs.SuffixPaths()
        for end, word in enumerate(words):
            squares = {d for d in range(1, (end + 1) // 2 + 1) if words[end - d + 1 : end + 1] == words[end - 2 * d + 1 : end - d + 1]}
            roots = {d: words[end - d + 1 : end + 1] for d in squares}
            primitive = {d for d, r in roots.items() if not any(d % e == 0 and r == r[:e] * (d // e) for e in range(1, d))}
            assert sorted(paths.append(word)) == sorted(primitive)


def test_runs_inside_runs_and_long_texts():
    inner = ["a", "b"] * 6 + ["c"]
    words = inner * 3 + ["x"]
    assert runs.summary([w.encode() for w in words])[1] == plain_runs(words)
    many = np.array([k % 7 for k in range(200_000)])
    assert runs.find_runs(many) == [(0, 200_000, 7)]
    assert runs.find_runs(np.zeros(100_000, np.int64)) == [(0, 100_000, 1)]


def test_query_against_definition(spark):
    rows = mixed(3, 48) + [(k, "one two three " * 9 + "end") for k in (700, 701, 701)] + [(None, "z " * 30)]
    frame = docs(spark, rows).withColumnsRenamed({"lang": "runs", "source": "start", "n_chars": "n_runs"})
    out = runs.periodic_runs(frame, runs.planted_repeats)
    got = sorted((tuple(r)[:8] for r in out.collect()), key=repr)
    assert got == sorted((expected(i, t) for i, t in rows), key=repr)
    assert sum(r[1] for r in got) > 5


def test_runs_are_returned(spark):
    out = runs.periodic_runs(docs(spark, [(1, "p q " * 8)])).first()
    assert [tuple(r) for r in out.runs] == [(0, 16, 2)] and out.exponent_milli == 8000


def test_given_table_and_empty(spark):
    common.prepare(spark)
    table = common.table(spark, "/root/testdata/sf0.001", "documents")
    out = {r.doc_id: tuple(r) for r in registered.op12_periodic_runs(spark, "/root/testdata/sf0.001").collect()}
    rows = [r for r in table.collect() if len(r.text or "") < 2500]
    assert len(rows) > 100
    for r in rows:
        assert out[r.doc_id] == expected(r.doc_id, r.text)
    assert runs.periodic_runs(table.limit(0)).collect() == []
