"""Ranked lexical search by summed accumulators and document-at-a-time skipping together.

The collection is cut into shards of bounded size; a shard is one row that holds the postings of the queries' terms, its documents
in ascending id order. Corpus statistics (documents, terms, document frequencies) are sums over the shards. Every shard is then
searched for every query: the short lists are read term at a time into summed accumulators, which from then on are one iterator
with known bounds, next to the long lists. Ranges of documents are visited in order; a range is skipped where the bounds of
the accumulators and of the long lists say that nothing in it can enter the best k, and in a visited range the long lists are
searched only for documents that can still do so (lists that cannot lift a document over the k-th score on their own
bring up no documents). The shards' best k meet in one ranking per query.

Terms are the maximal stretches of ASCII letters and digits and all characters beyond ASCII, with A-Z in lower case. Weights and scores
are whole numbers, as the functions below state.

Queries come in blocks of bounded size; each block is one pass over the collection, so what goes to all tasks is bounded.

Defined results: null and empty texts have no terms and are never found; a null id ranks as the smallest and stays null; rows
read twice are documents of their own; rows of equal item id and text are one item, other texts with the same id are ranked by
themselves; an empty table, or an item without a known term, gives no rows; other columns play no part.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from spanops.llm import common
from spanops.session import materialize

TOP = 10
# Length normalisation: m = 100 - B + B * n * N / L, in percent of the mean length.
B = 75
# A shard ends at whichever bound comes first; the last is in postings.
SHARD_DOCS = 1 << 15
SHARD_POSTINGS = 1 << 20
# Documents of one range, and the share of a shard's documents up to which a list counts as short.
RANGE = 1 << 10
SHORT_SHARE = 64
# A block of queries: at most so many items and characters (one longer item makes a block of its own).
BLOCK_ITEMS = 2000
BLOCK_CHARS = 4 << 20

_TERM_BYTES = bytes(
    b if b >= 0x80 or 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A else b + 32 if 0x41 <= b <= 0x5A else 0x20 for b in range(256)
)


def terms(text: str) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").translate(_TERM_BYTES).split()


def weight(df: int, total: int) -> int:
    """Weight of a term that ``df`` of ``total`` documents hold."""
    return math.floor(1000 * math.log((2 * total + 2) / (2 * df + 1)))


def impacts(tf: np.ndarray, n: np.ndarray, docs: int, length: int) -> np.ndarray:
    """What an occurrence count adds to a score for a weight of 1."""
    m = 100 - B + (B * n.astype(np.int64) * docs) // max(1, length)
    tf = tf.astype(np.int64)
    return (1_000_000_000 * tf) // (1000 * tf + 8 * m)


class Shard(NamedTuple):
    """Documents by ascending id, and for each known term the positions of the documents that hold it, ascending."""

    ids: np.ndarray
    sizes: np.ndarray
    term: np.ndarray
    begin: np.ndarray
    doc: np.ndarray
    tf: np.ndarray


class _Known(dict):
    """Number of a query term; all others are -1 and not remembered."""

    def __missing__(self, word: bytes) -> int:
        return -1


def build(ids: np.ndarray, sizes: np.ndarray, doc: np.ndarray, term: np.ndarray, tf: np.ndarray) -> Shard:
    """A shard from documents in any order and their (document, term, count) triples."""
    order = np.argsort(ids, kind="stable")
    place = np.empty(len(ids), np.int64)
    place[order] = np.arange(len(ids))
    by = np.lexsort((place[doc], term))
    doc, term, tf = place[doc[by]], term[by], tf[by]
    distinct, begin = np.unique(term, return_index=True)
    return Shard(ids[order], sizes[order], distinct, np.append(begin, len(term)), doc, tf)


_SHARD_TYPES = Shard(np.int64, np.int64, np.int32, np.int64, np.int32, np.int32)
_SHARD_SCHEMA = ", ".join(f"{name} binary" for name in Shard._fields) + ", n_docs long, n_terms long, df array<struct<term:int,df:long>>"


def _shard_row(shard: Shard) -> pa.RecordBatch:
    columns = [pa.array([np.ascontiguousarray(part, kind).tobytes()], pa.binary()) for part, kind in zip(shard, _SHARD_TYPES, strict=True)]
    df = [{"term": t, "df": n} for t, n in zip(shard.term.tolist(), np.diff(shard.begin).tolist(), strict=True)]
    kind = pa.list_(pa.struct([("term", pa.int32()), ("df", pa.int64())]))
    more = [pa.array([int((shard.sizes > 0).sum())], pa.int64()), pa.array([int(shard.sizes.sum())], pa.int64()), pa.array([df], kind)]
    return pa.RecordBatch.from_arrays([*columns, *more], [*Shard._fields, "n_docs", "n_terms", "df"])


def index(docs: DataFrame, vocabulary: list[bytes]) -> DataFrame:
    """The shards of a collection, one row each, for the terms of a block of queries."""
    spark = docs.sparkSession
    known = spark.sparkContext.broadcast({t: k for k, t in enumerate(vocabulary)})  # bounded by the block of queries
    source = docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"].cast("string").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = _Known(known.value)
        width = max(1, len(number))
        parts: list[tuple[np.ndarray, ...]] = []
        held = postings = 0
        for batch in batches:
            if not batch.num_rows:
                continue
            ids = np.array([common.NULL_ID if i is None else i for i in batch.column("doc_id").to_pylist()], np.int64)
            sizes, keys = np.zeros(len(ids), np.int64), [np.zeros(0, np.int64)]
            for k, text in enumerate(common.texts(batch)):
                words = terms(text)
                sizes[k] = len(words)
                found = np.fromiter(map(number.__getitem__, words), np.int64, len(words))
                keys.append(found[found >= 0] + k * width)
            key, tf = np.unique(np.concatenate(keys), return_counts=True)
            parts.append((ids, sizes, key // width + held, key % width, tf))
            held, postings = held + len(ids), postings + len(key)
            if held >= SHARD_DOCS or postings >= SHARD_POSTINGS:
                yield _shard_row(build(*map(np.concatenate, zip(*parts, strict=True))))
                parts, held, postings = [], 0, 0
        if parts:
            yield _shard_row(build(*map(np.concatenate, zip(*parts, strict=True))))

    return source.mapInArrow(run, _SHARD_SCHEMA)


class ShardSearch:
    """Searches of one shard; lists with their impacts and range bounds are made once per term."""

    def __init__(self, shard: Shard, docs: int, length: int):
        self.shard = shard
        self.place = {t: k for k, t in enumerate(shard.term.tolist())}
        self.short = max(1, len(shard.ids) // SHORT_SHARE)
        self.ranges = -(-len(shard.ids) // RANGE)
        self.impact = impacts(shard.tf, shard.sizes[shard.doc], docs, length)
        self.bounds: dict[int, np.ndarray] = {}
        self.visited = 0

    def _bounds(self, k: int) -> np.ndarray:
        """Greatest impact of a long list in each range."""
        if k not in self.bounds:
            a, b = self.shard.begin[k], self.shard.begin[k + 1]
            top = np.zeros(self.ranges, np.int64)
            np.maximum.at(top, self.shard.doc[a:b] // RANGE, self.impact[a:b])
            self.bounds[k] = top
        return self.bounds[k]

    def top(self, query: list[tuple[int, int]], k: int = TOP) -> list[tuple[int, int]]:
        """(position, score) of the k best documents with a score above 0; ``query`` lists (term, weight times occurrences).

        Best first; of equal scores the earlier position.
        """
        shard, short, long = self.shard, [], []
        for term, w in query:
            at = self.place.get(term)
            if at is not None and w > 0:
                (short if shard.begin[at + 1] - shard.begin[at] <= self.short else long).append((at, w))
        # Term at a time: the short lists become one list of documents with their sums so far.
        spans = [(slice(shard.begin[at], shard.begin[at + 1]), w) for at, w in short]
        some = np.concatenate([shard.doc[s] for s, _ in spans] or [np.zeros(0, np.int64)])
        added = np.concatenate([self.impact[s] * w for s, w in spans] or [np.zeros(0, np.int64)])
        acc_doc, back = np.unique(some, return_inverse=True)
        acc = np.zeros(len(acc_doc), np.int64)
        np.add.at(acc, back, added)
        # From here on the sums are one iterator with a bound per range.
        bound = np.zeros(self.ranges, np.int64)
        np.maximum.at(bound, acc_doc // RANGE, acc)
        # Sums so far are reached at least, so the k-th of them already rules documents out.
        floor = int(np.partition(acc, len(acc) - k)[len(acc) - k]) if len(acc) >= k else 0
        limits = sorted(((self._bounds(at) * w, at, w) for at, w in long), key=lambda x: int(x[0].max()))
        whole = bound + sum((top for top, _, _ in limits), np.zeros(self.ranges, np.int64))
        edges = np.searchsorted(acc_doc, np.arange(self.ranges + 1) * RANGE)
        best: list[tuple[int, int]] = []  # heap of (score, -position)
        for r in range(self.ranges):
            # Positions ascend, so a later document needs more than the k-th score; before k are known, as much as the floor.
            least = best[0][0] + 1 if len(best) == k else 1
            least = max(least, floor)
            if whole[r] < least:
                continue
            self.visited += 1
            found, score = self._range(r, acc_doc[edges[r] : edges[r + 1]], acc[edges[r] : edges[r + 1]], limits, least)
            good = np.flatnonzero(score >= least)
            for j in good[np.lexsort((found[good], -score[good]))[:k]].tolist():
                entry = (int(score[j]), -int(found[j]))
                if len(best) < k:
                    heapq.heappush(best, entry)
                elif entry > best[0]:
                    heapq.heapreplace(best, entry)
        return [(-at, s) for s, at in sorted(best, reverse=True)]

    def _range(self, r: int, acc_doc: np.ndarray, acc: np.ndarray, limits: list, least: int) -> tuple[np.ndarray, np.ndarray]:
        """Documents of a range that may reach ``least``, with their scores; those that fall short on the way are left out."""
        shard = self.shard
        # Lists that together stay below the wanted score bring up no documents of their own.
        silent, total = 0, 0
        while silent < len(limits) and total + int(limits[silent][0][r]) < least:
            total += int(limits[silent][0][r])
            silent += 1
        pieces = []
        for _, at, w in limits:
            a, b = shard.begin[at], shard.begin[at + 1]
            i, j = np.searchsorted(shard.doc[a:b], (r * RANGE, (r + 1) * RANGE))
            pieces.append((shard.doc[a + i : a + j], self.impact[a + i : a + j], w))
        found = np.unique(np.concatenate([acc_doc, *[p[0] for p in pieces[silent:]]]))
        score = np.zeros(len(found), np.int64)
        score[np.searchsorted(found, acc_doc)] = acc
        left = sum(int(top[r]) for top, _, _ in limits)
        for (top, _, _), (doc, impact, w) in zip(reversed(limits), reversed(pieces), strict=True):
            possible = score + left >= least
            found, score = found[possible], score[possible]
            left -= int(top[r])
            if not len(found) or not len(doc):
                continue
            at = np.minimum(np.searchsorted(doc, found), len(doc) - 1)
            score = score + np.where(doc[at] == found, impact[at] * w, 0)
        return found, score


def _blocks(items: DataFrame) -> Iterator[list[tuple[int | None, str]]]:
    """Items in blocks of bounded size, in order of id and text; rows that agree in both come once."""
    distinct = items.select(items["item_id"].cast("long").alias("item_id"), F.coalesce(items["text"].cast("string"), F.lit("")).alias("text")).distinct()
    block: list[tuple[int | None, str]] = []
    chars = 0
    for row in distinct.orderBy("item_id", "text").toLocalIterator():
        if block and (len(block) >= BLOCK_ITEMS or chars + len(row.text) > BLOCK_CHARS):
            yield block
            block, chars = [], 0
        block.append((row.item_id, row.text))
        chars += len(row.text)
    if block:
        yield block


def _search_block(spark: SparkSession, docs: DataFrame, block: list[tuple[int | None, str]], top: int) -> DataFrame:
    wanted: list[tuple[int, int | None, dict[int, int]]] = []
    number: dict[bytes, int] = {}
    for place, (item_id, text) in enumerate(block):
        counts: dict[int, int] = {}
        for t in terms(text):
            k = number.setdefault(t, len(number))
            counts[k] = counts.get(k, 0) + 1
        wanted.append((place, item_id, counts))
    shards = materialize(index(docs, list(number)), "shards")
    sums = shards.agg(F.sum("n_docs").alias("n"), F.sum("n_terms").alias("l")).first()
    total, length = sums.n or 0, sums.l or 0
    df = shards.select(F.explode("df").alias("d")).groupBy("d.term").agg(F.sum("d.df").alias("df"))
    weights = {r.term: weight(r.df, total) for r in df.collect()}  # bounded by the block's terms
    queries = [(place, item, [(t, c * weights[t]) for t, c in counts.items() if t in weights]) for place, item, counts in wanted]
    shared = spark.sparkContext.broadcast(queries)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                shard = Shard(*[np.frombuffer(row[name], kind) for name, kind in zip(Shard._fields, _SHARD_TYPES, strict=True)])
                search = ShardSearch(shard, total, length)
                out = [
                    (place, item, None if shard.ids[at] == common.NULL_ID else int(shard.ids[at]), score)
                    for place, item, query in shared.value
                    for at, score in search.top(query, top)
                ]
                if out:
                    kinds = (pa.int32(), pa.int64(), pa.int64(), pa.int64())
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], ["place", "item_id", "doc_id", "score"])

    rows = shards.select(*Shard._fields).mapInArrow(run, "place int, item_id long, doc_id long, score long")
    order = Window.partitionBy("place").orderBy(F.desc("score"), F.asc_nulls_first("doc_id"))
    ranked = rows.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
    return ranked.select("item_id", "rank", "doc_id", "score")


def search(docs: DataFrame, items: DataFrame, top: int = TOP) -> DataFrame:
    """``item_id, rank, doc_id, score``: the best documents of every item."""
    spark = common.prepare(docs.sparkSession)
    parts = [_search_block(spark, docs, block, top) for block in _blocks(items)]
    if not parts:
        return spark.createDataFrame([], "item_id long, rank int, doc_id long, score long")
    if len(parts) == 1:
        return parts[0]
    out = materialize(parts[0], "found")
    for part in parts[1:]:
        out = out.unionByName(materialize(part, "found"))
    return out
