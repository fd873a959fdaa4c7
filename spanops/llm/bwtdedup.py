"""Suffix-array dedup: bytes covered by a string of ``LENGTH`` bytes that also starts earlier are removed.

A full suffix array of the corpus is not needed. Every window of LENGTH bytes holds one *anchor*: the position among its first
``REACH`` with the smallest 16-byte hash (ties: leftmost). Equal windows have equal anchors at equal offsets, so only the
suffixes that start at anchors matter, about one for 32 bytes. Work goes in these steps:

1. Each shard finds its anchors and the hash of the LENGTH - REACH bytes from there on: the block of the interleave that the suffix
   lies in at that depth. Blocks with one suffix in the whole corpus are settled and leave.
2. Shards sort what is left: for each block a run of suffixes in order (their suffix array), each with the bytes before it (the
   symbols of the Burrows-Wheeler transform). Suffixes equal to an earlier one of the shard in all bytes that any
   window can reach are settled on the spot, so copies of a passage do not pile up in one task.
3. The runs of all shards are merged block by block by refining the interleave: in each round the suffixes of a block are moved,
   stably, by their next eight symbols; a block that splits tells the common prefix of its parts; blocks of one suffix rest.
   Nothing is sorted anew: a round only looks at blocks that are still open. The preceding symbols are refined likewise.
4. Common prefixes (forwards) and common suffixes (backwards) give the repeated intervals: the windows at offset o before
   the anchor are equal where the forward classes at depth LENGTH - o and the backward classes at depth o are equal.
5. The windows that are not the first of their class are put together for each document and cut out.

Defined results: a null or empty text has no bytes; a null id counts as the smallest id; rows that share an id are not earlier than each
other, and rows read twice get the same result each; texts shorter than LENGTH stay whole; an empty table gives an empty
result; other columns play no part. Cuts are judged on the input and may split a UTF-8 character.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from spanops.llm import common
from spanops.session import materialize

LENGTH = 100
REACH = 64  # one bit of a 64-bit mask for each offset
GRAM = 16
DEPTH = LENGTH - REACH
# Positions handled at once; documents may be longer.
CHUNK = 1 << 21
# Suffixes a shard sorts, and a merging task refines, at once (about 200 bytes each); a block is never split.
RUN = 200_000
MERGE = 60_000

_C = [np.uint64(c) for c in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93)]


def _words(data: np.ndarray) -> np.ndarray:
    """The eight bytes from each position on, as little-endian numbers."""
    return np.ndarray((max(0, len(data) - 7),), "<u8", np.ascontiguousarray(data), strides=(1,)).copy()


def anchors(data: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Over concatenated texts: position, hash of the DEPTH bytes there, and first and last offset of the windows it serves."""
    out = []
    for at in range(0, max(1, len(data)), CHUNK):
        part = data[at : at + CHUNK + LENGTH]
        if len(part) < LENGTH:
            continue
        last = min(len(part) - LENGTH + 1, CHUNK)  # windows that start here
        with np.errstate(over="ignore"):
            v = _words(part)
            h = v[: last + REACH - 1] * _C[0]
            h ^= (v[8 : last + REACH + 7] * _C[1]) >> np.uint64(29)
            h *= _C[2]
            h &= np.uint64(0xFFFFFFFFFF000000)
            h |= np.arange(len(h), dtype=np.uint64)
            step = 1
            while step < REACH:
                np.minimum(h[:-step], h[step:], out=h[:-step])
                h = h[:-step]
                step *= 2
            pick = (h[:last] & np.uint64(0xFFFFFF)).astype(np.int64)
        # Windows must not go over the end of a text.
        ok = np.zeros(last + 1, np.int64)
        low = np.clip(ends[:-1] - at, 0, last)
        high = np.clip(ends[1:] - LENGTH + 1 - at, low, last)
        np.add.at(ok, low, 1)
        np.add.at(ok, high, -1)
        windows = np.flatnonzero(np.cumsum(ok[:-1]) > 0)
        if not len(windows):
            continue
        chosen = pick[windows]
        new = np.ones(len(chosen), bool)
        new[1:] = (chosen[1:] != chosen[:-1]) | (windows[1:] != windows[:-1] + 1)
        start = np.flatnonzero(new)
        stop = np.append(start[1:], len(chosen)) - 1
        pos = chosen[start]
        with np.errstate(over="ignore"):
            key = np.zeros(len(pos), np.uint64)
            for k in (0, 8, 16, 24, DEPTH - 8):
                key = common.mix(key * _C[3] + v[pos + k])
        out.append((pos + at, key, pos - windows[stop], pos - windows[start]))
    if not out:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def _blocks(batch: pa.RecordBatch) -> pa.RecordBatch:
    """One row for each anchor: its block, its text, and position and offsets in one number.

    Anchors of a block that the batch holds several times are ``sure`` to stay. They are dealt out at random, and one row
    without a text (``at`` -1) stands for all of them in the block, so a very frequent block is no hot key.
    """
    data, ends = common.raw_texts(batch)
    pos, key, low, high = anchors(data, ends)
    doc = np.searchsorted(ends, pos, side="right") - 1
    ids, hashes = np.asarray(batch.column("k_id")), np.asarray(batch.column("k_hash"))
    at = ((pos - ends[doc]) << 12) | (low << 6) | high
    blocks, back, times = np.unique(key, return_inverse=True, return_counts=True)
    sure = times[back] > 1
    several = blocks[times > 1]
    dealt = np.where(sure, common.mix(key ^ common.mix(pos.astype(np.uint64))), key)
    n = len(several)
    columns = [
        np.concatenate([dealt, several]).view(np.int64), np.concatenate([ids[doc], np.zeros(n, np.int64)]),
        np.concatenate([hashes[doc], np.zeros(n, np.int64)]), np.concatenate([at, np.full(n, -1)]), np.concatenate([sure, np.zeros(n, bool)]),
    ]
    return pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["block", "k_id", "k_hash", "at", "sure"])


def _symbols(rows: np.ndarray) -> np.ndarray:
    """Rows of bytes as rows of big-endian 64-bit symbols, whose order is that of the bytes."""
    pad = -rows.shape[1] % 8
    wide = np.pad(rows, ((0, 0), (0, pad))) if pad else np.ascontiguousarray(rows)
    return wide.view(">u8").astype(np.uint64)


def _equal_bytes(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Leading equal bytes (0 to 7) of differing symbols."""
    x = a ^ b
    out = np.zeros(len(x), np.int64)
    for k in range(1, 8):
        out += x < (np.uint64(1) << np.uint64(64 - 8 * k))
    return out


def refine(block: np.ndarray, symbols: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Merge runs by interleave refinement.

    ``block`` numbers the blocks in ascending order along the rows. Gives the order of the rows, and for each place the bytes
    that its row shares with the one before it (0 at the start of a block, all bytes where the rows are equal).
    """
    n, width = symbols.shape
    order = np.arange(n)
    shared = np.full(n, 8 * width, np.int64)
    first = np.ones(n, bool)
    first[1:] = block[1:] != block[:-1]
    shared[first] = 0
    for depth in range(width):
        # Places in blocks of more than one suffix.
        start = np.flatnonzero(first)
        size = np.diff(np.append(start, n))
        if not (size > 1).any():
            break
        number = np.repeat(np.arange(len(start)), size)
        open_ = np.flatnonzero((size > 1)[number])
        s = symbols[order[open_], depth]
        moved = np.lexsort((s, number[open_]))
        order[open_] = order[open_][moved]
        s = s[moved]
        inside = np.ones(len(open_), bool)
        inside[0] = False
        inside[1:] = number[open_][1:] == number[open_][:-1]
        split = np.flatnonzero(inside & np.append(False, s[1:] != s[:-1]))
        first[open_[split]] = True
        shared[open_[split]] = 8 * depth + _equal_bytes(s[split - 1], s[split])
    return order, shared


def _class_of(order: np.ndarray, shared: np.ndarray, depth: int) -> np.ndarray:
    """Number of each row's class of rows that share ``depth`` bytes, within their blocks."""
    out = np.empty(len(order), np.int64)
    new = shared < depth
    new[0] = True
    out[order] = np.cumsum(new) - 1
    return out


def repeated(block, k_id, k_hash, pos, low, high, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """For each suffix the offsets (bits) whose window also starts earlier; rows come sorted by block.

    ``left`` holds the preceding bytes, nearest first.
    """
    n = len(block)
    forward, backward = refine(block, _symbols(right)), refine(block, _symbols(left))
    group = np.zeros(n, np.int64)
    group[1:] = np.cumsum(block[1:] != block[:-1])
    by_age = np.lexsort((pos, k_hash, k_id))
    mask = np.zeros(n, np.uint64)
    for offset in range(REACH):
        rows = by_age[(low[by_age] <= offset) & (offset <= high[by_age])]
        if len(rows) < 2:
            continue
        ahead = _class_of(*forward, LENGTH - offset)
        behind = _class_of(*backward, offset) if offset else group
        cls = ahead[rows] * np.int64(n + 1) + behind[rows]
        by_class = np.argsort(cls, kind="stable")
        rows, cls = rows[by_class], cls[by_class]
        new = np.ones(len(rows), bool)
        new[1:] = cls[1:] != cls[:-1]
        ids, hashes, p = k_id[rows], k_hash[rows], pos[rows]
        oldest = ids[np.maximum.accumulate(np.where(new, np.arange(len(rows)), 0))]
        other = new.copy()
        other[1:] |= (ids[1:] != ids[:-1]) | (hashes[1:] != hashes[:-1])
        start = p[np.maximum.accumulate(np.where(other, np.arange(len(rows)), 0))]
        again = (ids > oldest) | (p > start)
        mask[rows[again]] |= np.uint64(1) << np.uint64(offset)
    return mask


def _bits(low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """Masks with the bits low to high set."""
    all_ = np.uint64(0xFFFFFFFFFFFFFFFF)
    return (all_ >> (np.uint64(63) - high.astype(np.uint64))) & (all_ << low.astype(np.uint64))


_RUN = "block long, k_id long, k_hash long, at long, place int, before binary, after binary, settled array<long>"
_RUN_NAMES = [c.split()[0] for c in _RUN.split(", ")]


def _pick(data: np.ndarray, ends: np.ndarray, doc: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes before (nearest first) and after each anchor as far as its windows reach, 0 beyond."""
    p, low, high = (at >> 12) + ends[doc], (at >> 6) & 63, at & 63
    ahead = p[:, None] + np.arange(LENGTH)[None]
    back = p[:, None] - np.arange(1, REACH)[None]
    last = len(data) - 1
    right = np.where(ahead < (p + LENGTH - low)[:, None], data[np.minimum(ahead, last)], 0).astype(np.uint8)
    left = np.where(back >= (p - high)[:, None], data[np.maximum(back, 0)], 0).astype(np.uint8)
    return left, right


def _fixed(rows: np.ndarray) -> pa.Array:
    """Rows of bytes as binary values."""
    n, width = rows.shape
    offsets = pa.array(np.arange(n + 1, dtype=np.int32) * width)
    return pa.Array.from_buffers(pa.binary(), n, [None, offsets.buffers()[1], pa.py_buffer(np.ascontiguousarray(rows).tobytes())])


def _run(parts: list[tuple]) -> Iterator[pa.RecordBatch]:
    """Sort a shard's suffixes; settle those that equal an earlier one of the shard in every byte their windows reach."""
    block, k_id, k_hash, at, left, right = (np.concatenate(x) for x in zip(*parts, strict=True))
    pos, low, high = at >> 12, (at >> 6) & 63, at & 63
    both = np.concatenate([_symbols(right), _symbols(left)], 1)
    with np.errstate(over="ignore"):
        whole = block.view(np.uint64).copy()
        for k in range(both.shape[1]):
            whole = common.mix(whole * _C[3] + both[:, k])
    age = np.lexsort((pos, k_hash, k_id, whole))
    new = np.ones(len(age), bool)
    new[1:] = whole[age][1:] != whole[age][:-1]
    lead = age[np.maximum.accumulate(np.where(new, np.arange(len(age)), 0))]
    # Bytes are compared, not only their hash, and the leader must have the same windows.
    same = (both[age] == both[lead]).all(1) & (block[age] == block[lead]) & (low[age] == low[lead]) & (high[age] == high[lead])
    older = (k_id[age] > k_id[lead]) | ((k_id[age] == k_id[lead]) & (k_hash[age] == k_hash[lead]) & (pos[age] > pos[lead]))
    settled = np.zeros(len(age), bool)
    settled[age] = same & older
    # Settled suffixes travel as one row for each text; all their windows are repeated.
    rows = np.flatnonzero(settled)
    rows = rows[np.lexsort((at[rows], k_hash[rows], k_id[rows]))]
    if len(rows):
        new = np.ones(len(rows), bool)
        new[1:] = (k_id[rows][1:] != k_id[rows][:-1]) | (k_hash[rows][1:] != k_hash[rows][:-1])
        start = np.flatnonzero(new)
        first, n = rows[start], len(start)
        yield pa.RecordBatch.from_arrays(
            [
                pa.array(k_hash[first]), pa.array(k_id[first]), pa.array(k_hash[first]), pa.nulls(n, pa.int64()), pa.nulls(n, pa.int32()),
                pa.nulls(n, pa.binary()), pa.nulls(n, pa.binary()), common.lists(at[rows], np.append(start, len(rows)), pa.int64()),
            ],
            _RUN_NAMES,
        )
    rows = np.flatnonzero(~settled)
    rows = rows[np.lexsort((*_symbols(right[rows]).T[::-1], block[rows]))]
    for a in range(0, len(rows), 20_000):
        some = rows[a : a + 20_000]
        yield pa.RecordBatch.from_arrays(
            [
                pa.array(block[some]), pa.array(k_id[some]), pa.array(k_hash[some]), pa.array(at[some]), pa.array(np.arange(a, a + len(some)), pa.int32()),
                _fixed(left[some]), _fixed(right[some]), pa.nulls(len(some), pa.list_(pa.int64())),
            ],
            _RUN_NAMES,
        )


def _block_of(data: np.ndarray, p: np.ndarray) -> np.ndarray:
    """Hash of the DEPTH bytes from each place on."""
    with np.errstate(over="ignore"):
        key = np.zeros(len(p), np.uint64)
        for k in (0, 8, 16, 24, DEPTH - 8):
            eight = np.ascontiguousarray(data[(p + k)[:, None] + np.arange(8)[None]]).view("<u8")[:, 0]
            key = common.mix(key * _C[3] + eight)
    return key.view(np.int64)


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    parts, n = [], 0
    for batch in batches:
        if not batch.num_rows:
            continue
        data, ends = common.raw_texts(batch)
        spots = batch.column("spots")
        doc = np.repeat(np.arange(batch.num_rows), np.asarray(spots.value_lengths().fill_null(0)))
        at = np.asarray(spots.flatten())
        ids, hashes = np.asarray(batch.column("k_id")), np.asarray(batch.column("k_hash"))
        for a in range(0, len(at), RUN):
            d, x = doc[a : a + RUN], at[a : a + RUN]
            left, right = _pick(data, ends, d, x)
            parts.append((_block_of(data, (x >> 12) + ends[d]), ids[d], hashes[d], x, left, right))
            n += len(x)
            if n >= RUN:
                yield from _run(parts)
                parts, n = [], 0
    if n:
        yield from _run(parts)


_MASKS = "k_id long, k_hash long, at array<long>, mask array<long>"


def _rows_of(column: pa.Array, width: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(-1, width)


def _merged(rows: list[pa.RecordBatch]) -> pa.RecordBatch:
    t = pa.Table.from_batches(rows).combine_chunks()
    fixed = t.filter(t["place"].is_null())
    open_ = t.filter(t["place"].is_valid())
    cols = {c: np.asarray(open_[c].combine_chunks() if open_.num_rows else open_[c]) for c in ("block", "k_id", "k_hash", "at")}
    masks = np.zeros(0, np.uint64)
    if open_.num_rows:
        at = cols["at"]
        left, right = (_rows_of(open_[c], w) for c, w in (("before", REACH - 1), ("after", LENGTH)))
        masks = repeated(cols["block"], cols["k_id"], cols["k_hash"], at >> 12, (at >> 6) & 63, at & 63, left, right)
    hit = np.flatnonzero(masks)
    order = hit[np.lexsort((cols["k_hash"][hit], cols["k_id"][hit]))]
    k_id, k_hash = cols["k_id"][order], cols["k_hash"][order]
    new = np.ones(len(order), bool)
    new[1:] = (k_id[1:] != k_id[:-1]) | (k_hash[1:] != k_hash[:-1])
    start = np.flatnonzero(new)
    ends = np.append(start, len(order))
    settled = fixed["settled"].combine_chunks()
    if isinstance(settled, pa.ChunkedArray):
        settled = pa.concat_arrays(settled.chunks) if settled.num_chunks else pa.array([], pa.list_(pa.int64()))
    n = len(settled)
    flat = np.asarray(settled.flatten()).astype(np.int64)
    settled_ends = np.concatenate([[0], np.cumsum(np.asarray(settled.value_lengths()).astype(np.int64))])
    whole = _bits((flat >> 6) & 63, flat & 63).view(np.int64)
    both_ends = np.concatenate([settled_ends, settled_ends[-1] + ends[1:]]) if n or len(start) else np.zeros(1, np.int64)
    return pa.RecordBatch.from_arrays(
        [
            pa.array(np.concatenate([np.asarray(fixed["k_id"]).astype(np.int64), k_id[start]]).astype(np.int64)),
            pa.array(np.concatenate([np.asarray(fixed["k_hash"]).astype(np.int64), k_hash[start]]).astype(np.int64)),
            common.lists(np.concatenate([flat, cols["at"][order]]).astype(np.int64), both_ends, pa.int64()),
            common.lists(np.concatenate([whole, masks[order].view(np.int64)]).astype(np.int64), both_ends, pa.int64()),
        ],
        ["k_id", "k_hash", "at", "mask"],
    )


def _merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches sorted by block; merged some blocks at a time, never a part of a block."""
    held: list[pa.RecordBatch] = []
    n = 0
    for batch in batches:
        if not batch.num_rows:
            continue
        block = np.asarray(batch.column("block"))
        if n >= MERGE:
            # Up to the last block of this batch all others are complete.
            cut = int(np.searchsorted(block, block[-1]))
            if cut or np.asarray(held[-1].column("block"))[-1] != block[0]:
                yield _merged([*held, batch.slice(0, cut)])
                held, n, batch = [], 0, batch.slice(cut)
        held.append(batch)
        n += batch.num_rows
    if held:
        yield _merged(held)


def covered(length: int, at: np.ndarray, mask: np.ndarray) -> np.ndarray:
    """Which bytes of a text lie in a window named by the masks."""
    row, offset = np.nonzero((mask.view(np.uint64)[:, None] >> np.arange(REACH, dtype=np.uint64)[None]) & np.uint64(1))
    start = (at[row] >> 12) - offset
    change = np.zeros(length + 1, np.int64)
    np.add.at(change, start, 1)
    np.add.at(change, start + LENGTH, -1)
    return np.cumsum(change[:-1]) > 0


_RESULT = "k_id long, k_hash long, n_removed long, n_spans long, cut_sha256 string, spans array<struct<start:long,end:long>>"


def _cut(batch: pa.RecordBatch) -> pa.RecordBatch:
    data, ends = common.raw_texts(batch)
    rows = []
    for k, (at, mask) in enumerate(zip(batch.column("at"), batch.column("mask"), strict=True)):
        own = data[ends[k] : ends[k + 1]]
        gone = covered(len(own), np.asarray(at.values), np.asarray(mask.values))
        edges = np.flatnonzero(np.diff(np.concatenate([[0], gone.astype(np.int8), [0]])))
        spans = [{"start": int(a), "end": int(b)} for a, b in edges.reshape(-1, 2)]
        rows.append((int(gone.sum()), len(spans), hashlib.sha256(own[~gone].tobytes()).hexdigest(), spans))
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))]
    columns = [pa.array(c, kind) for c, kind in zip(zip(*rows, strict=True), kinds, strict=True)]
    return pa.RecordBatch.from_arrays(
        [batch.column("k_id"), batch.column("k_hash"), *columns], ["k_id", "k_hash", "n_removed", "n_spans", "cut_sha256", "spans"]
    )


FILTER_BITS = 26


def only(source: DataFrame, keys: DataFrame) -> DataFrame:
    """Rows of ``source`` whose key may be among ``keys``, so that the others' texts are not shuffled for a join.

    The filter is a bitmap of 2^FILTER_BITS bits (8 MB) whatever the number of keys; with very many keys it lets more rows
    through, which costs time but changes nothing, as an exact join follows.
    """
    slot = F.col("k_hash").bitwiseAND(F.lit((1 << FILTER_BITS) - 1)) + 1
    rows = keys.select(F.bitmap_bucket_number(slot).alias("b"), F.bitmap_bit_position(slot).alias("p")).groupBy("b").agg(F.bitmap_construct_agg("p").alias("bits")).collect()
    bitmap = np.zeros((1 << (FILTER_BITS - 15), 4096), np.uint8)
    for r in rows:
        bitmap[r["b"] - 1] = np.frombuffer(bytes(r["bits"]), np.uint8)
    shared = source.sparkSession.sparkContext.broadcast(bitmap)

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        x = np.asarray(batch.column("k_hash")) & ((1 << FILTER_BITS) - 1)
        hit = (shared.value[x >> 15, (x & 32767) >> 3] >> (x & 7).astype(np.uint8)) & 1
        return batch.filter(pa.array(hit.astype(bool)))

    return common.map_arrow(source, work, "k_id long, k_hash long, text string")


def repeated_windows(source: DataFrame) -> DataFrame:
    """``k_id, k_hash, at, mask``: for each text with repeats its anchors and the masks of their repeated windows."""
    found = common.map_arrow(source, _blocks, "block long, k_id long, k_hash long, at long, sure boolean")
    size = F.count("*").over(Window.partitionBy("block"))
    several = found.withColumn("size", size).where("(sure or size > 1) and at >= 0")
    spots = materialize(several.groupBy("k_id", "k_hash").agg(F.collect_set("at").alias("spots")), "spots")
    runs = only(source, spots).join(spots, ["k_id", "k_hash"]).mapInArrow(_runs, _RUN)
    sorted_runs = runs.withColumn("shard", F.spark_partition_id()).repartition("block").sortWithinPartitions("block", "shard", "place").drop("shard")
    masks = sorted_runs.mapInArrow(_merge, _MASKS)
    gathered = masks.groupBy("k_id", "k_hash").agg(F.flatten(F.collect_list("at")).alias("at"), F.flatten(F.collect_list("mask")).alias("mask"))
    # collect_list keeps rows in step: both lists take the same rows in the same order.
    return materialize(gathered, "masks")


def dedup(docs: DataFrame) -> DataFrame:
    """Bytes, removed bytes and spans, and the digest of what stays, for every document."""
    common.prepare(docs.sparkSession)
    source = common.keyed(docs)
    masks = repeated_windows(source)
    marked = only(source, masks).dropDuplicates(["k_id", "k_hash"]).join(masks, ["k_id", "k_hash"])
    cut = common.map_arrow(marked, _cut, _RESULT)
    every = source.select("k_id", "k_hash", F.octet_length("text").cast("long").alias("n_bytes"), F.sha2("text", 256).alias("whole_sha256"))
    none = F.array().cast("array<struct<start:long,end:long>>")
    return every.join(cut, ["k_id", "k_hash"], "left").select(
        common.shown_id().alias("doc_id"), "n_bytes", *[F.coalesce(c, F.lit(0).cast("long")).alias(c) for c in ("n_removed", "n_spans")],
        F.coalesce("cut_sha256", "whole_sha256").alias("kept_sha256"), F.coalesce("spans", none).alias("spans"),
    )
