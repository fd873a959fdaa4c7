import random

import numpy as np
import pyarrow as pa

from spanops.llm import common, partenum
from tests.llm import frames

SF_DIR = "/root/testdata/sf0.001"


def brute(rows, pct=90, size=3):
    sets = []
    for _, t in rows:
        w = (t or "").encode().lower().split()
        sets.append({tuple(w[k : k + size]) for k in range(max(1, len(w) - size + 1))} if w else set())
    group = list(range(len(rows)))

    def top(x):
        while group[x] != x:
            x = group[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            both = len(sets[a] & sets[b])
            if sets[a] and 100 * both >= pct * (len(sets[a]) + len(sets[b]) - both):
                group[top(a)] = top(b)
    low = {}
    for k, (i, _) in enumerate(rows):
        if i is not None:
            low[top(k)] = min(low.get(top(k), i), i)
    return sorted([(i, len(sets[k]), low.get(top(k)) if sets[k] else i) for k, (i, _) in enumerate(rows)], key=key)


def key(row):
    return tuple((x is not None, x) for x in row)


def result(df, **kw):
    return sorted([tuple(r) for r in partenum.link_classes(df, **kw).collect()], key=key)


def near_rows():
    rng = random.Random(5)
    rows, n = [], 0
    for size in (1, 2, 3, 5, 12, 14, 21, 22, 40, 41, 100, 400, 900):
        base = [f"v{rng.randrange(9999)}" for _ in range(size)]
        for edits in (0, 0, 1, 1, 2, 3, max(1, size // 60), max(1, size // 40)):
            w = list(base)
            for _ in range(edits):
                w[rng.randrange(size)] = f"z{rng.randrange(9999)}"
            rows.append((n * 7 % 1009, " ".join(w)))
            n += 1
        rows.append((n * 7 % 1009, " ".join(base + base[: size // 9])))
        n += 1
    return rows


def test_near_copies_against_brute_force(spark):
    rows = near_rows() + [(2000, None), (2001, "  "), (None, rows_text(near_rows(), 60)), (None, None)]
    assert result(frames.docs(spark, rows).repartition(3)) == brute(rows)
    assert result(frames.docs(spark, rows), pct=80, size=5) == brute(rows, 80, 5)


def rows_text(rows, k):
    return rows[k][1]


def test_small_table_whole(spark):
    df = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    rows = [(r.doc_id, r.text) for r in df.collect()]
    assert result(df) == brute(rows)


def test_sets_at_the_limit_share_a_signature():
    """Random pairs of sets of at least the similarity share a signature, whatever their sizes."""
    rng = np.random.default_rng(2)
    for pct in (80, 90):
        ends = partenum.bands(4000, pct)
        ends += [max(ends[-1] + 1, (ends[-1] + 1) * 100 // pct)]
        for _ in range(300):
            n = int(rng.integers(1, 1500))
            lost = n * (100 - pct) // 100
            a = np.unique(rng.integers(0, 2**63, n).astype(np.uint64))
            mode = rng.integers(0, 3)
            b = a[lost:] if mode == 0 else np.unique(np.concatenate([a[lost // 2 :], rng.integers(0, 2**63, lost // 2).astype(np.uint64)]))
            both = len(np.intersect1d(a, b))
            if 100 * both >= pct * (len(a) + len(b) - both):
                assert len(np.intersect1d(partenum.signatures(a, ends, pct), partenum.signatures(b, ends, pct)))


def test_chain_of_links_is_one_class(spark):
    words = [f"u{k}" for k in range(300)]
    rows = [(900 - k, " ".join(words[4 * k : 4 * k + 150])) for k in range(30)]
    assert result(frames.docs(spark, rows)) == brute(rows)


def test_one_stays_of_each_class(spark):
    rows = near_rows() + [(3000, None), (3001, ""), (None, "a b c"), (3002, "same text here"), (3002, "same text here")]
    df = frames.docs(spark, rows).selectExpr("*", "1 as node", "2 as k_id", "3 as comp")
    kept = partenum.keep_one(df)
    assert kept.columns == df.columns
    want = {i for i, _, c in brute(rows, 80, 5) if i == c and i is not None}
    got = [r.doc_id for r in kept.collect()]
    assert sorted(x for x in got if x is not None) == sorted(want) and got.count(None) == 1


def test_empty_table(spark):
    df = frames.docs(spark, [])
    assert result(df) == [] and partenum.keep_one(df).count() == 0


def test_set_hash_ignores_order_of_words_in_text(spark):
    h = common.WordHashes()
    assert partenum.set_hash(partenum.shingles("A b c d", 3, h)) == partenum.set_hash(partenum.shingles("a B c d", 3, h))


def test_one_document_stays_of_classes_with_null_or_equal_ids(spark):
    common_part = " ".join(f"w{k}" for k in range(200))
    other = " ".join(f"v{k}" for k in range(200))
    rows = [(None, f"{common_part} a"), (None, f"{common_part} b"), (7, f"{other} a"), (7, f"{other} b"), (None, f"{other} c"), (None, ""), (None, None), (8, " ")]
    kept = [(r.doc_id, r.text) for r in partenum.keep_one(frames.docs(spark, rows)).collect()]
    assert sum(common_part in (t or "") for _, t in kept) == 1
    assert [i for i, t in kept if other in (t or "")] == [7]
    assert len(kept) == 4 and (8, " ") in kept


def test_pairs_in_turns_are_those_of_one_turn(spark):
    """Cells of several members, pairs that meet in several cells, sizes that rule a pair out; tables in between are deleted."""
    cells = spark.createDataFrame([(s, n) for s in range(12) for n in range(1 + s % 4, 9, 1 + s % 3)], "sig long, node long")
    columns = ["node long", "n long", "sketch binary", *[f"{p} long" for p in partenum._PARITY]]
    traits = [(n, 1000 if n == 5 else 20, b"", *[0] * len(partenum._PARITY)) for n in range(1, 9)]
    info = spark.createDataFrame(traits, ", ".join(columns))
    labels = spark.createDataFrame([(1, 1), (2, 1)], "node long, comp long")
    for known in (None, labels):
        keep = common.Scratch(spark)
        want = sorted(map(tuple, partenum._candidates(cells, info, known, 1, 80).collect()))
        got = sorted(map(tuple, partenum._pairs_in_turns(cells, info, known, 1, 80, 3, keep).collect()))
        assert got == want and want and not any(5 in pair for pair in want)
        assert len(keep.paths) == 3


def test_signatures_in_turns_are_all_of_each_set():
    rng = np.random.default_rng(4)
    ends = partenum.bands(3000, 80) + [4000]
    sets = [np.unique(rng.integers(0, 2**48, n).astype(np.uint64)) for n in (1, 2, 3, 9, 40, 300, 2500)]
    made: list[list[np.ndarray]] = [[] for _ in sets]
    for turn in range(3):
        sigs, own = partenum.signatures_of(np.concatenate(sets), np.array([len(x) for x in sets]), ends, 80, 3, turn)
        for k in range(len(sets)):
            made[k].append(sigs[own == k])
    for items, parts in zip(sets, made, strict=True):
        assert sorted(np.concatenate(parts)) == sorted(partenum.signatures(items, ends, 80))


def test_shared_signatures_sent_in_several_pieces():
    """Nodes that are sent twice, one signature that all have, some that two have; the frequent one is a row of each piece."""
    rng, parts = random.Random(6), 3
    has = {node: {2 * s for s in rng.sample(range(1, 2**62), 40)} | {2**60} for node in range(-100, 100)}
    for _ in range(300):
        a, b = rng.sample(sorted(has), 2)
        has[a].add(min(has[b]))
    met, hot = {}, 0
    for piece in range(5):
        nodes = [n for n in has if n % 5 == piece or n % 7 == piece]
        sigs, owners = zip(*[(s, n) for n in nodes for s in has[n]], strict=True)
        cut = partenum._cut(np.array(sigs, np.uint64), np.array(owners, np.int64), parts)
        for row in cut.to_pylist():
            met.setdefault(row["part"] if row["part"] < parts else parts, []).append(row)
            hot += row["part"] < parts and sum(int(x) >> 1 == 2**59 for x in np.frombuffer(row["sigs"], np.uint64))
    found = set()
    for part, rows in met.items():
        table = pa.table({"part": [r["part"] for r in rows], "sigs": [r["sigs"] for r in rows], "nodes": [r["nodes"] for r in rows]})
        found |= {(r["sig"], r["node"]) for r in partenum._shared(parts, table).to_pylist()}
    of = {}
    for node, sigs in has.items():
        for s in sigs:
            of.setdefault(s >> 1, set()).add(node)
    assert found == {(s, n) for s, nodes in of.items() if len(nodes) > 1 for n in nodes} and hot == 5


def test_a_share_of_the_sets_is_sent_at_once(spark, monkeypatch):
    """Pairs are tested in turns: each written table of links comes from a part of the pairs, and the sets go before the result is made."""
    written = []
    write = common.Scratch.write

    def spy(self, df, kind):
        found = write(self, df, kind)
        written.append((kind, found.count() if kind == "links" else 0))
        return found

    monkeypatch.setattr(common.Scratch, "write", spy)
    monkeypatch.setattr(partenum, "_turns", lambda wanted, rows, least: 3 if rows > 10 else 1, raising=False)
    base = [f"w{k}" for k in range(120)]
    rows = [(k, " ".join([*base[: 100 + k % 20], f"x{k}"])) for k in range(30)]
    assert sorted(r.doc_id for r in partenum.keep_one(frames.docs(spark, rows), turns=2).collect()) == sorted({c for _, _, c in brute(rows, 80, 5)})
    links = [n for kind, n in written if kind == "links"]
    assert max(links) < 0.7 * sum(links[:3])


def test_unrelated_sets_share_no_signature():
    """Parts without elements are no signature where enough parts have some."""
    rng = np.random.default_rng(8)
    ends = partenum.bands(4000, 80) + [5000]
    for n in (60, 250, 290, 700, 2000):
        sets = [np.unique(rng.integers(0, 2**48, n).astype(np.uint64)) for _ in range(60)]
        made, own = partenum.signatures_of(np.concatenate(sets), np.array([len(x) for x in sets]), ends, 80)
        cells = np.bincount(np.unique(made, return_inverse=True)[1])
        assert len(own) == len(made) and (cells * (cells - 1) // 2).sum() < 60 * 59 // 2 // 4


def test_near_random_sets_share_a_signature():
    """Sets that differ as much as they may, of all sizes with several plans."""
    rng = np.random.default_rng(9)
    for pct in (80, 90):
        ends = partenum.bands(2000, pct) + [9000]
        for n in [*range(1, 400, 3), 700, 1500]:
            a = np.unique(rng.integers(0, 2**48, n).astype(np.uint64))
            both = -(-2 * n * pct // (100 + pct))
            for b in (a[: -(-n * pct // 100)], np.concatenate([a[:both], rng.integers(0, 2**48, n - both).astype(np.uint64)])):
                b = np.unique(b)
                same = len(np.intersect1d(a, b))
                if 100 * same >= pct * (len(a) + len(b) - same):
                    assert len(np.intersect1d(partenum.signatures(a, ends, pct), partenum.signatures(b, ends, pct)))
