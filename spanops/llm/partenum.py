"""N-gram Jaccard join with PartEnum signatures.

A document's set holds hashes of its word shingles. Sizes fall into bands [l, l / J]; two sets that reach the similarity lie in
the same or in neighbouring bands, and differ in at most k = 2 r (1 - J) / (1 + J) elements, r being the largest size of the
pair of bands. For such a pair of bands the feature domain is partitioned by hash into n1 parts; by the pigeonhole principle two
sets agree, in one part at least, up to k2 elements. Each part is partitioned again into n2, and the signatures are all
ways to leave out k2 of these: one of them is untouched. Sets that reach the similarity therefore share a signature.

Documents with equal sets are one node. Candidates are first held against a parity sketch: a bit for each of 512 parts of the domain
tells whether the set has an odd number of elements there. Sets whose sketches differ in d bits differ in d elements at least,
so too large a d rules the link out for certain. A larger sketch, counts of the elements in as many parts as suit the set, does
the same for the pairs that are left, and only then whole sets are sent. Within a signature nodes are first compared with the smallest node only (twice, by
different orders), not with each other; the links give components, and pairs are then formed only between members of
different components, so a large group of copies costs a pass, not its square, and no link is lost. Every candidate pair
is decided by the exact intersection of the two sets.

Defined results: a null or empty text has an empty set and links with nothing (its component is its own id); a null id takes
no part in minima and gets the component of its links, or null; rows read twice get the same result each; an empty table
gives an empty result; other columns play no part. Fewer words than a shingle count as one shingle.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import partial, reduce
from itertools import combinations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession, functions as F

from spanops.llm import common

SIMILARITY_PCT = 90
SHINGLE = 3
# Up to this distance a part is partitioned again and subsets are enumerated; beyond, parts are many and selective anyway.
ENUMERATED = 64


def shingles(text: str, size: int, hashes: common.WordHashes) -> np.ndarray:
    """Sorted distinct hashes of the word shingles of a text."""
    words = hashes.of(text)
    if not len(words):
        return words
    n = max(1, len(words) - size + 1)
    h = np.full(n, np.uint64(min(len(words), size)))
    with np.errstate(over="ignore"):
        for k in range(min(size, len(words))):
            h = common.mix(h * np.uint64(0x9E3779B97F4A7C15) + words[k : k + n])
    return np.unique(h)


def bands(largest: int, pct: int = SIMILARITY_PCT) -> list[int]:
    """Upper ends of the size bands up to one that holds ``largest``."""
    ends, low = [], 1
    while not ends or ends[-1] < largest:
        ends.append(max(low, low * 100 // pct))
        low = ends[-1] + 1
    return ends


def distance(size: int, pct: int = SIMILARITY_PCT) -> int:
    """Most elements in which two sets of at most ``size`` elements may differ: |a xor b| <= (1 - J)/(1 + J) (|a| + |b|)."""
    return 2 * size * (100 - pct) // (100 + pct)


def plan(k: int) -> tuple[int, int, int]:
    """(n1, n2, k2) for distance k. A quarter more parts than the pigeonhole needs, as some have too few elements to count."""
    if k == 0:
        return 1, 1, 0
    if k <= ENUMERATED:
        return (k + 2) // 2 + (k + 7) // 8, 3, 1
    return k + 1 + k // 4, 1, 0


def signatures(items: np.ndarray, ends: list[int], pct: int = SIMILARITY_PCT) -> np.ndarray:
    """PartEnum signatures of a set (sorted hashes) for the pair of bands below and the pair above its size."""
    return np.unique(signatures_of(items, np.array([len(items)]), ends, pct)[0])


def signatures_of(items: np.ndarray, counts: np.ndarray, ends: list[int], pct: int, turns: int = 1, turn: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """Signatures of several sets, whose elements stand one after the other, and for each the number of its set.

    Of several turns each makes the signatures of its own parts; elements of other parts are not summed up.

    Signatures of no elements are what unrelated sets share, so they are left out where they are not needed: a part is good if it
    is not empty whatever k2 of its subsets are left out. If (k2 + 1) times the good parts are more than k, any set within k agrees on a good
    part up to k2 subsets, and so on elements. Of two sets that both have fewer good parts, both keep the signatures of no elements.
    """
    plans = np.array([(*plan(distance(end, pct)), distance(end, pct)) for end in ends])
    band, number = np.searchsorted(ends, counts), np.arange(len(counts))
    of, out, owners = np.repeat(number, counts), [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
    with np.errstate(over="ignore"):
        for top in (band, band + 1):
            n1, n2, k2, most = plans[top].T
            salted = common.mix(items ^ common.mix((top + 1).astype(np.uint64))[of])
            part = ((salted >> np.uint64(8)) % (n1 * n2).astype(np.uint64)[of]).astype(np.int64)
            first, whose = np.cumsum(n1 * n2) - n1 * n2, np.repeat(number, n1)
            nth_part = np.arange(len(whose)) - (np.cumsum(n1) - n1)[whose]
            at = first[of] + part
            filled = np.zeros(int((n1 * n2).sum()), bool)
            filled[at] = True
            once, owner = np.flatnonzero(filled), np.repeat(number, n1 * n2)[filled]
            row = (np.cumsum(n1) - n1)[owner] + (once - first[owner]) // n2[owner]
            good = np.bincount(row, minlength=len(whose)) > k2[whose]
            enough = (k2 + 1) * np.bincount(whose, good, minlength=len(counts)) > most
            if turns > 1:
                mine = (part // n2[of] + top[of]) % turns == turn
                salted, at = salted[mine], at[mine]
                mine = (nth_part + top[whose]) % turns == turn
                whose, nth_part = whose[mine], nth_part[mine]
            sums = np.zeros(len(filled), np.uint64)
            np.add.at(sums, at, common.mix(salted))
            for parts, left_out in {(int(x), int(y)) for x, y in zip(n2, k2, strict=True)}:
                these = (n2[whose] == parts) & (k2[whose] == left_out)
                own, nth_own = whose[these], nth_part[these]
                start = first[own] + nth_own * parts
                base = nth_own.astype(np.uint64) * np.uint64(64) + top[own].astype(np.uint64) * np.uint64(1 << 40)
                for nth, chosen in enumerate(combinations(range(parts), parts - left_out)):
                    h, some = base + np.uint64(nth), ~enough[own]
                    for c in chosen:
                        h = common.mix(h * np.uint64(0x9E3779B97F4A7C15) + sums[start + c])
                        some |= filled[start + c]
                    out.append(h[some])
                    owners.append(own[some])
    return np.concatenate(out), np.concatenate(owners)


PARITY_WORDS = 8
_PARITY = [f"p{k}" for k in range(PARITY_WORDS)]


def parity(items: np.ndarray) -> np.ndarray:
    """For each of 64 * PARITY_WORDS parts of the domain one bit: whether the set has an odd number of elements there."""
    odd = np.bincount((common.mix(items) >> np.uint64(20)).astype(np.int64) % (64 * PARITY_WORDS), minlength=64 * PARITY_WORDS) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").view("<i8")


def set_hash(items: np.ndarray) -> int:
    with np.errstate(over="ignore"):
        total = common.mix(items + np.uint64(0x51ED270B)).sum(dtype=np.uint64) + np.uint64(len(items))
    return int(common.mix(np.array([total], np.uint64)).view(np.int64)[0])


def _nodes(size: int, batch: pa.RecordBatch) -> pa.RecordBatch:
    """Size, hash, parities and packed set of every document; of equal sets in a batch the first alone is kept."""
    hashes, rows, seen = common.WordHashes(), [], set()
    for text in common.texts(batch):
        items = np.unique(shingles(text, size, hashes) & _SIX_BYTES)
        node = set_hash(items) if len(items) else None
        first = node is not None and node not in seen
        rows.append((len(items), node, packed(items) if first else None, sketch(items).tobytes() if first else None, parity(items)))
        seen.add(node)
    count, node, sets, sketches, bits = zip(*rows, strict=True)
    return pa.RecordBatch.from_arrays(
        [
            batch.column("k_id"), batch.column("k_hash"), pa.array(count, pa.int64()), pa.array(node, pa.int64()), pa.array(sets, pa.binary()),
            pa.array(sketches, pa.binary()), *[pa.array(np.ascontiguousarray(word)) for word in np.stack(bits).T],
        ],
        ["k_id", "k_hash", "n", "node", "items", "sketch", *_PARITY],
    )


# Signatures that a task holds before it sends them, and those that meet in one group at most (about).
SENT_AT_ONCE = 250_000


def _signed(pct: int, ends: list[int], turns: int, turn: int, parts: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``part, sigs, nodes``: signatures of one turn with their nodes, eight bytes each, cut by ranges of the signature."""
    sigs: list[np.ndarray] = []
    nodes: list[np.ndarray] = []
    seen: set[int] = set()
    for batch in batches:
        found = [(n, unpacked(x)) for n, x in zip(batch.column("node").to_pylist(), batch.column("items").to_pylist(), strict=True)]
        sets = {n: x for n, x in found if n not in seen}
        if not sets:
            continue
        seen.update(sets)
        made, own = signatures_of(np.concatenate([*sets.values()]), np.array([len(x) for x in sets.values()]), ends, pct, turns, turn)
        sigs.append(made)
        nodes.append(np.array([*sets], np.int64)[own])
        if sum(map(len, sigs)) >= SENT_AT_ONCE:
            yield _cut(np.concatenate(sigs), np.concatenate(nodes), parts)
            sigs, nodes, seen = [], [], set()
    if sum(map(len, sigs)):
        yield _cut(np.concatenate(sigs), np.concatenate(nodes), parts)


def _cut(sigs: np.ndarray, nodes: np.ndarray, parts: int) -> pa.RecordBatch:
    """One row for each part. Of a signature that several of these nodes have, one goes to its part, with the lowest bit set.

    All of them go, as they are, to one more part, so a signature of very many nodes is a row of each call and no hot group.
    """
    sigs = sigs >> np.uint64(1)
    order = np.argsort(sigs, kind="stable")
    sigs, nodes = sigs[order], nodes[order]
    start = np.flatnonzero(np.r_[True, sigs[1:] != sigs[:-1]])
    size = np.diff(np.r_[start, len(sigs)])
    whole = np.repeat(size > 1, size)
    part = ((sigs[start] >> np.uint64(31)) * np.uint64(parts)) >> np.uint64(32)
    edge = np.flatnonzero(np.r_[True, part[1:] != part[:-1]])
    ends = np.r_[edge, len(start), len(start) + np.count_nonzero(whole)].astype(np.int32) * np.int32(8)
    marked = np.r_[(sigs[start] << np.uint64(1)) | (size > 1), sigs[whole] << np.uint64(1)]
    number = np.r_[part[edge].astype(np.int64), parts + int(sigs[0] % np.uint64(parts))]
    cut = lambda x: pa.Array.from_buffers(pa.binary(), len(number), [None, pa.py_buffer(ends), pa.py_buffer(np.ascontiguousarray(x))])
    return pa.RecordBatch.from_arrays([pa.array(number), cut(marked), cut(np.r_[nodes[start], nodes[whole]])], ["part", "sigs", "nodes"])


def _shared(parts: int, table: pa.Table) -> pa.Table:
    """(sig, node) of the signatures of a part that two nodes have; those marked were sent whole already."""
    sigs = np.frombuffer(b"".join(table.column("sigs").to_pylist()), np.uint64)
    nodes = np.frombuffer(b"".join(table.column("nodes").to_pylist()), np.int64)
    marked, sigs = sigs & np.uint64(1) == 1, (sigs >> np.uint64(1)).view(np.int64)
    if table.column("part")[0].as_py() < parts and len(sigs):
        order = np.lexsort((nodes, sigs))
        marked, sigs, nodes = marked[order], sigs[order], nodes[order]
        fresh = np.r_[True, sigs[1:] != sigs[:-1]]
        other = fresh | np.r_[True, nodes[1:] != nodes[:-1]]
        cell = np.cumsum(fresh) - 1
        shared = (np.bincount(cell, other) > 1) | (np.bincount(cell, marked) > 0)
        kept = shared[cell] & other & ~marked
        sigs, nodes = sigs[kept], nodes[kept]
    return pa.table({"sig": sigs, "node": nodes})


def _sets(bits: Broadcast, batch: pa.RecordBatch) -> pa.RecordBatch:
    """The sets that may be wanted, by a bitmap of their hashes."""
    return batch.filter(pa.array(common.in_bitmap(bits.value, batch.column("node").to_numpy())))


# Elements are told apart by six bytes of their hash.
_SIX_BYTES = np.uint64((1 << 48) - 1)


def packed(items: np.ndarray) -> bytes:
    """A set as six bytes of each element."""
    return np.ascontiguousarray(items, "<u8").view(np.uint8).reshape(-1, 8)[:, :6].tobytes()


def unpacked(data: bytes) -> np.ndarray:
    """The elements of a packed set, sorted."""
    parts = np.frombuffer(data, np.uint8).reshape(-1, 6)
    whole = np.zeros((len(parts), 8), np.uint8)
    whole[:, :6] = parts
    return whole.view("<u8").ravel()


def sketch(items: np.ndarray) -> np.ndarray:
    """How many elements lie in each part of the domain (at most 255 are told); a quarter to half as many parts as elements."""
    parts = max(64, 1 << (len(items) // 4).bit_length())
    at = (common.mix(items) >> np.uint64(8)).astype(np.int64) & (parts - 1)
    return np.minimum(np.bincount(at, minlength=parts), 255).astype(np.uint8)


def _plausible(pct: int, batch: pa.RecordBatch) -> pa.RecordBatch:
    """The pairs that their sketches leave possible: two sets differ in as many elements at least as their counts do."""
    keep = []
    for x, y, n in zip(batch.column("sketch_a").to_pylist(), batch.column("sketch_b").to_pylist(), batch.column("both").to_pylist(), strict=True):
        p, q = np.frombuffer(x, np.uint8).astype(np.int64), np.frombuffer(y, np.uint8).astype(np.int64)
        size = min(len(p), len(q))
        p, q = p.reshape(-1, size).sum(0), q.reshape(-1, size).sum(0)
        keep.append(int(np.abs(p - q).sum()) * (100 + pct) <= n * (100 - pct))
    return batch.filter(pa.array(keep, pa.bool_())).select(["a", "b"])


def _verified(pct: int, batch: pa.RecordBatch) -> pa.RecordBatch:
    """The candidate pairs that link: 100 * |a and b| >= pct * |a or b|."""
    keep, last, q = [], None, None
    for x, y in zip(batch.column("items_a").to_pylist(), batch.column("items_b").to_pylist(), strict=True):
        if y != last:  # pairs come by their second node, whose set serves all its partners
            last, q = y, unpacked(y)
        p = unpacked(x)
        both = len(np.intersect1d(p, q, assume_unique=True))
        keep.append(100 * both >= pct * (len(p) + len(q) - both))
    return batch.filter(pa.array(keep, pa.bool_())).select(["a", "b"])


def components(links: DataFrame, keep: common.Scratch | None = None) -> DataFrame:
    """``node, comp``: the smallest node reachable, for every node that has a link.

    Labels spread to neighbours and are then followed one step further (pointer jumping), so the rounds grow with the logarithm
    of a component's length; every round is a written table, deleted once the next stands.
    """
    keep = keep or common.Scratch(links.sparkSession)
    edges = keep.write(links.select("a", "b").union(links.select("b", "a")).distinct(), "edges")
    labels = keep.write(edges.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("comp")).withColumnRenamed("a", "node"), "labels")
    while True:
        spread = edges.join(labels, F.col("b") == F.col("node")).groupBy("a").agg(F.min("comp").alias("near"))
        closer = labels.join(spread, F.col("node") == F.col("a")).select("node", "comp", F.least("comp", "near").alias("low"))
        jump = labels.select(F.col("node").alias("low"), F.col("comp").alias("far"))
        after = closer.join(jump, "low", "left").select("node", F.least("low", F.coalesce("far", "low")).alias("comp"), (F.col("comp") != F.col("low")).alias("moved"))
        before, labels = labels, keep.write(after, "labels")
        keep.drop(before)
        if not labels.where("moved").limit(1).count():
            keep.drop(edges)
            return labels.select("node", "comp")


def _possible(pct: int) -> F.Column:
    """Whether the sizes and the parities of a pair (columns, and the same with 2) leave room for the similarity."""
    size = 100 * F.least("n", "n2") >= pct * F.greatest("n", "n2")
    differ = sum((F.bit_count(F.col(p).bitwiseXOR(F.col(f"{p}2"))) for p in _PARITY), F.lit(0))
    return size & (differ * (100 + pct) <= (F.col("n") + F.col("n2")) * (100 - pct))


def _met(cells: DataFrame, labels: DataFrame | None, order: int) -> DataFrame:
    """Distinct (node, other): each member of a cell whose members are not all of one component, with the first of the cell."""
    known, open_cells = _open(cells, labels, order)
    return known.join(open_cells, "sig").where("comp != comp2").select("node", "other").distinct()


def _open(cells: DataFrame, labels: DataFrame | None, order: int | None) -> tuple[DataFrame, DataFrame]:
    """Cells with the components of their members, and one row for each cell that holds several components."""
    if labels is None:
        known = cells.withColumn("comp", F.col("node"))
    else:
        known = cells.join(labels, "node", "left").withColumn("comp", F.coalesce("comp", "node"))
    # One row for each open cell, combined before the shuffle, so a cell of very many members is no hot task.
    rank = F.xxhash64("node", F.lit(order or 0)).alias("h")
    open_cells = known.groupBy("sig").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"), F.min(F.struct(rank, "node", "comp")).alias("first"))
    return known, open_cells.where("lo != hi").select("sig", F.col("first.node").alias("other"), F.col("first.comp").alias("comp2"))


def _in_turn(rows: DataFrame, turns: int, turn: int, *columns: str) -> DataFrame:
    return rows if turns == 1 else rows.where(F.pmod(F.xxhash64(*columns), F.lit(turns)) == turn)


def _pairs_in_turns(cells: DataFrame, info: DataFrame, labels: DataFrame | None, order: int | None, pct: int, turns: int, keep: common.Scratch) -> DataFrame:
    """``_candidates`` with its shuffles in turns: first by signature, then, with sizes and parities, by pair. Every pair is in one turn."""
    met: list[DataFrame] = []
    for turn in range(turns):
        some = _in_turn(cells, turns, turn, "sig")
        met.append(keep.write(_candidates(some, info, labels, None, pct) if order is None else _met(some, labels, order), "met"))
        keep.forget()
    by = ("a", "b") if order is None else ("node", "other")
    pairs: DataFrame | None = None
    for turn in range(turns):
        some = reduce(DataFrame.unionByName, [_in_turn(part, turns, turn, *by) for part in met]).distinct()
        part = keep.write(some if order is None else _left_possible(some, info, pct), "possible")
        keep.forget()
        pairs = part if pairs is None else pairs.unionByName(part)
    keep.drop(*met)
    return pairs


def _left_possible(pairs: DataFrame, info: DataFrame, pct: int) -> DataFrame:
    """Pairs (a, b) that sizes and parities do not rule out."""
    traits = ["n", *_PARITY]
    second = info.select(F.col("node").alias("other"), *[F.col(c).alias(f"{c}2") for c in traits])
    kept = pairs.join(info.select("node", *traits), "node").join(second, "other").where(_possible(pct))
    return kept.select(F.col("node").alias("a"), F.col("other").alias("b"))


def _candidates(cells: DataFrame, info: DataFrame, labels: DataFrame | None, order: int | None, pct: int) -> DataFrame:
    """Pairs (a, b) from signature cells (sig, node) whose members are not all of one component.

    With an order: each member (a) with the first of the cell (b). Without: pairs of members of different components. Pairs that
    sizes or parities rule out are never formed.
    """
    if order is not None:
        return _left_possible(_met(cells, labels, order), info, pct).distinct()
    traits, (known, open_cells) = ["n", *_PARITY], _open(cells, labels, order)
    members = known.join(open_cells.select("sig"), "sig").join(info.drop("sketch"), "node")
    left = members.select("sig", "node", "comp", *traits)
    right = members.select("sig", F.col("node").alias("other"), F.col("comp").alias("comp2"), *[F.col(c).alias(f"{c}2") for c in traits])
    same = left["sig"] == right["sig"]
    pairs = left.join(right, same & (left["comp"] < right["comp2"]) & _possible(pct))
    return pairs.select(F.col("node").alias("a"), F.col("other").alias("b")).distinct()


def _cells(sets: DataFrame, elements: int, pct: int, ends: list[int], turns: int, keep: common.Scratch) -> DataFrame:
    """(sig, node) of the signatures that two nodes share. A row may come more than once.

    Signatures are made in turns, sixteen bytes each with its node, and only those that are shared are written.
    """
    parts = max(2 * int(sets.sparkSession.conf.get("spark.sql.shuffle.partitions")), elements // turns // SENT_AT_ONCE + 1)
    cells: DataFrame | None = None
    for turn in range(turns):
        signed = sets.mapInArrow(partial(_signed, pct, ends, turns, turn, parts), "part long, sigs binary, nodes binary")
        part = keep.write(signed.groupBy("part").applyInArrow(lambda table: _shared(parts, table), "sig long, node long"), "cells")
        cells = part if cells is None else cells.unionByName(part)
        keep.forget()
    return cells


def _turns(wanted: float, rows: int, least: int) -> int:
    """So many turns, but none for less than so many rows."""
    return max(1, min(math.ceil(wanted), rows // least))


def _linked(pairs: DataFrame, info: DataFrame, all_sets: DataFrame, sets: int, pct: int, turns: int, keep: common.Scratch) -> DataFrame:
    """The pairs that link. Where the whole join has turns, so many pairs are tested at once that a share of the sets is sent at most."""
    x = info.select(F.col("node").alias("a"), F.col("sketch").alias("sketch_a"), F.col("n").alias("n_a"))
    y = info.select(F.col("node").alias("b"), F.col("sketch").alias("sketch_b"), F.col("n").alias("n_b"))
    left: DataFrame | None = None
    count = pairs.count()
    several = 1 if turns == 1 else _turns(turns * count / (8 * sets), count, 100_000)  # sketches are a sixteenth of the sets
    for turn in range(several):
        some = _in_turn(pairs, several, turn, "a", "b")
        sketched = some.join(x, "a").join(y, "b").select("a", "b", "sketch_a", "sketch_b", (F.col("n_a") + F.col("n_b")).alias("both"))
        part = keep.write(common.map_arrow(sketched, partial(_plausible, pct), "a long, b long"), "plausible")
        left = part if left is None else left.unionByName(part)
        keep.forget()
    found: DataFrame | None = None
    count = left.count()
    several = 1 if turns == 1 else _turns(2 * turns * count / sets, count, 10_000)
    for turn in range(several):
        some = _in_turn(left, several, turn, "a", "b")
        # The set of a, the member, travels; that of b, the first of many cells, is sent once to where its partners are.
        ends_of = some.select(F.col("a").alias("node")).union(some.select("b"))
        bits = pairs.sparkSession.sparkContext.broadcast(common.bitmap(ends_of, "node"))  # fixed size; keeps other sets from being sent
        sent = common.map_arrow(all_sets, partial(_sets, bits), "node long, items binary").groupBy("node").agg(F.first("items").alias("items"))
        a, b = sent.toDF("a", "items_a"), sent.toDF("b", "items_b")
        part = keep.write(common.map_arrow(some.join(a, "a").join(b, "b"), partial(_verified, pct), "a long, b long"), "links")
        bits.destroy()
        found = part if found is None else found.unionByName(part)
        keep.forget()
    keep.drop_kind("plausible")
    return found


def join(docs: DataFrame, pct: int = SIMILARITY_PCT, size: int = SHINGLE, turns: int = 1) -> DataFrame:
    """``k_id, k_hash, n_shingles, component_id, comp`` of every row (``comp``: key of its class, null without words); links join documents of similarity >= pct %.

    A set has about 4 (1 - J) / (1 + J) signatures for each element; they are worked off in ``turns``, of which each has its share of the
    shuffle and of the tasks' hash tables. The result does not depend on them.
    """
    spark: SparkSession = common.prepare(docs.sparkSession)
    common.small_batches(spark)  # what comes back is larger
    keep = common.Scratch(spark)
    source = common.keyed(docs)
    node_schema = "k_id long, k_hash long, n long, node long, items binary, sketch binary, " + ", ".join(f"{p} long" for p in _PARITY)
    whole = keep.write(common.map_arrow(source, partial(_nodes, size), node_schema), "nodes")
    nodes = keep.write(whole.select("k_id", "k_hash", "n", "node"), "rows")  # what is needed to the end
    ends = bands(max(1, nodes.agg(F.max("n")).first()[0] or 1), pct)
    ends += [max(ends[-1] + 1, (ends[-1] + 1) * 100 // pct)]
    all_sets = whole.where("items is not null").select("node", "items")
    one = F.first(F.struct("n", "sketch", *_PARITY)).alias("t")
    info = keep.write(whole.where("items is not null").groupBy("node").agg(one).select("node", "t.*"), "traits")
    keep.forget()
    sets, elements = info.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
    cells = _cells(all_sets, elements, pct, ends, turns, keep)
    count = cells.count()
    several = 1 if turns == 1 else _turns(7 * turns * count / max(1, elements), count, 1_000_000)  # some 40 bytes a row, six an element
    links: DataFrame | None = None
    done: DataFrame | None = None
    labels: DataFrame | None = None
    for order in (1, 2, None):
        if several > 1:
            pairs = _pairs_in_turns(cells, info, labels, order, pct, several, keep)
        else:
            pairs = _candidates(cells, info, labels, order, pct)
        pairs = pairs.select("a", "b", F.least("a", "b").alias("p"), F.greatest("a", "b").alias("q"))
        if done is not None:
            pairs = pairs.join(done, ["p", "q"], "left_anti")
        pairs = keep.write(pairs, "pairs")
        keep.drop_kind("possible")
        keep.forget()
        if not pairs.limit(1).count():
            continue  # a later round looks at other pairs
        done = pairs.select("p", "q") if done is None else done.unionByName(pairs.select("p", "q"))
        found = _linked(pairs.select("a", "b"), info, all_sets, sets, pct, turns, keep)
        links = found if links is None else links.unionByName(found)
        before, labels = labels, components(links, keep)
        if before is not None:
            keep.drop(before)
        keep.forget()
    keep.drop(info, whole)
    keep.drop_kind("cells")
    if labels is None:
        labels = spark.createDataFrame([], "node long, comp long")
    # The component of a document: smallest id over all documents of all nodes of its node's component.
    placed = nodes.join(labels, "node", "left").withColumn("comp", F.coalesce("comp", "node"))
    lowest = placed.where("node is not null").groupBy("comp").agg(F.min(F.when(F.col("k_id") != common.NULL_ID, F.col("k_id"))).alias("low"))
    return placed.join(lowest, "comp", "left").select(
        "k_id", "k_hash", F.col("n").alias("n_shingles"), F.when(F.col("node").isNull(), common.shown_id()).otherwise(F.col("low")).alias("component_id"),
        "comp",
    )


def link_classes(docs: DataFrame, pct: int = SIMILARITY_PCT, size: int = SHINGLE) -> DataFrame:
    """``doc_id, n_shingles, component_id`` of every document."""
    return join(docs, pct, size).select(common.shown_id().alias("doc_id"), "n_shingles", "component_id")


def keep_one(docs: DataFrame, pct: int = 80, size: int = 5, turns: int = 5) -> DataFrame:
    """One document of each class of near copies, the one with the smallest id; all columns of ``docs``.

    Null ids come last, and of different texts with the same id the one with the smallest hash stays.

    Documents without words link with nothing and stay. Of rows with the same id and text one stays: where other columns
    differ, the one whose columns come first as JSON text.
    """
    classes = join(docs, pct, size, turns).select("k_id", "k_hash", "comp")
    null_last = F.struct((F.col("k_id") == common.NULL_ID).alias("no_id"), "k_id", "k_hash")
    first = classes.where("comp is not null").groupBy("comp").agg(F.min(null_last).alias("k")).select("k.k_id", "k.k_hash")
    kept = classes.where("comp is null").select("k_id", "k_hash").distinct().union(first)
    k_id, k_hash = F.coalesce(docs["doc_id"].cast("long"), F.lit(common.NULL_ID)), F.xxhash64(F.coalesce(docs["text"].cast("string"), F.lit("")))
    row = F.struct(*[docs[c] for c in docs.columns]).alias("r")
    rows = docs.select(k_id.alias("k_id"), k_hash.alias("k_hash"), row).join(kept, ["k_id", "k_hash"])
    return rows.groupBy("k_id", "k_hash").agg(F.min_by("r", F.to_json("r")).alias("r")).select("r.*")
