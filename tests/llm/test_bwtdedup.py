import hashlib
from collections import defaultdict

import numpy as np
import pytest

from spanops.llm import bwtdedup, common
from tests.llm import frames

SF_DIR = "/root/testdata/sf0.001"


def brute(rows, length=bwtdedup.LENGTH):
    """Window by window: covered where the same bytes start at a smaller id or earlier in the text."""
    data = [(common.NULL_ID if i is None else i, (t or "").encode()) for i, t in rows]
    starts = defaultdict(list)
    for i, b in data:
        for p in range(len(b) - length + 1):
            starts[b[p : p + length]].append(i)
    lowest = {w: min(ids) for w, ids in starts.items()}
    out = []
    for (i, _), (key, b) in zip(rows, data, strict=True):
        gone = np.zeros(len(b), bool)
        seen = set()
        for p in range(len(b) - length + 1):
            w = b[p : p + length]
            if lowest[w] < key or w in seen:
                gone[p : p + length] = True
            seen.add(w)
        spans = int((np.diff(np.concatenate([[0], gone.astype(int)])) == 1).sum())
        kept = bytes(np.frombuffer(b, np.uint8)[~gone])
        out.append((i, len(b), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest()))
    return out


def key(row):
    return tuple((x is not None, x) for x in row)


def result(df):
    return sorted([tuple(r) for r in bwtdedup.dedup(df).drop("spans").collect()], key=key)


def test_against_brute_force(spark):
    rows = frames.mixed()
    assert result(frames.docs(spark, rows).repartition(5)) == sorted(brute(rows), key=key)


def test_small_table_whole(spark):
    df = spark.read.parquet(f"{SF_DIR}/documents.parquet").repartition(4)
    rows = [(r.doc_id, r.text) for r in df.collect()]
    assert result(df) == sorted(brute(rows), key=key)


def test_small_pieces(spark, monkeypatch):
    """The same with tiny chunks, anchors found anew at every border."""
    rows = frames.mixed(7)
    data = [(t or "").encode() for _, t in rows]
    ends = np.concatenate([[0], np.cumsum([len(d) for d in data])])
    flat = np.frombuffer(b"".join(data), np.uint8)
    whole = bwtdedup.anchors(flat, ends)
    monkeypatch.setattr(bwtdedup, "CHUNK", 257)
    parts = bwtdedup.anchors(flat, ends)

    def windows(found):
        return {(int(p) - o, int(p), int(k)) for p, k, a, b in zip(*found, strict=True) for o in range(a, b + 1)}

    assert windows(whole) == windows(parts)
    assert {w[0] for w in windows(whole)} == {int(s) + p for s, d in zip(ends, data) for p in range(len(d) - bwtdedup.LENGTH + 1)}


def test_interleave_is_the_suffix_order():
    rng = np.random.default_rng(3)
    rows = rng.integers(97, 99, (60, 16)).astype(np.uint8)
    rows[30:40] = rows[0]
    block = np.repeat([4, 9, 11], 20)
    order, shared = bwtdedup.refine(block, bwtdedup._symbols(rows))
    keys = [(block[k], rows[k].tobytes()) for k in order]
    assert keys == sorted(keys)
    for a, b, s in zip(order, order[1:], shared[1:], strict=False):
        x, y = rows[a].tobytes(), rows[b].tobytes()
        common_ = next((i for i in range(16) if x[i] != y[i]), 16) if block[a] == block[b] else 0
        assert s == common_


@pytest.mark.parametrize("rows", [[], [(1, None)], [(1, "short"), (2, "short")]])
def test_nothing_to_remove(spark, rows):
    assert [r[2:4] for r in result(frames.docs(spark, rows))] == [(0, 0)] * len(rows)


def test_very_long_text_and_clashing_columns(spark):
    text = "".join(f"{k * k} " for k in range(300_000))
    df = frames.docs(spark, [(1, text), (2, text[1000:5000])]).selectExpr("*", "1 as block", "2 as k_id", "3 as at", "4 as n_removed", "5 as spots")
    rows = result(df)
    assert [(r[0], r[2]) for r in rows] == [(1, 0), (2, 4000)]
