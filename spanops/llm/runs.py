"""Periodic runs of words, found with a suffix automaton whose link tree is a link-cut tree.

A run is a longest stretch of words with smallest period q (words q apart are equal) and at least ``max(MIN_WORDS, 2 q)`` words.
Words are appended to a suffix automaton one by one. The states on the path from the state of the whole prefix to the root
stand for its suffixes; each append recolours that path with its own end position (*access* of a link-cut tree). The path
meets segments of one colour each: suffixes of lengths (low, high] that ended last at position ``e``. With d = end - e, the
suffix of length d is the right half of a square with a primitive root exactly if low < d <= high. Squares of one period with
consecutive ends make up one run, which starts 2 d - 1 words before the first end.

Only words inside six-word windows that occur again in the same stretch are appended: a run of period q holds, at each of its
words, a window of six that recurs q words on or back, so nothing else can belong to one. The windows are found by hash; a
collision appends needless words and changes no result.

Defined results: a null or empty text has no words and no run (nulls for the greatest run, hashes of nothing); a null id
stays null; equal rows get equal results; an empty
table gives an empty result; other columns play no part. Texts are read whole; a task holds the automaton of one stretch of one
document at a time, some hundred bytes a word.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from spanops.llm import common

MIN_WORDS = 12
WINDOW = MIN_WORDS // 2
_SCHEMA = (
    "doc_id long, n_runs long, start long, length long, period long, exponent_milli long, runs_sha256 string, collapsed_sha256 string"
)

Run = tuple[int, int, int]


class SuffixPaths:
    """Suffix automaton; its suffix links form a link-cut tree whose paths are coloured by the last end of their strings.

    A splay tree holds a path of one colour, ordered by length; the colour stands at its root, and ``up`` of that root is the state
    above the path. State 0 is no state (never a child), state 1 the empty string.
    """

    def __init__(self) -> None:
        self.length, self.link, self.step = [0, 0], [0, 0], [{}, {}]
        self.up, self.left, self.right, self.colour = [0, 0], [0, 0], [0, 0], [-1, -1]
        self.last, self.end = 1, -1

    def _state(self, length: int, step: dict[int, int]) -> int:
        self.length.append(length)
        self.link.append(0)
        self.step.append(step)
        for column, value in ((self.up, 0), (self.left, 0), (self.right, 0), (self.colour, -1)):
            column.append(value)
        return len(self.length) - 1

    def _rotate(self, x: int) -> None:
        """Turn x above its parent in the splay tree; a root's colour goes with the root."""
        up, left, right = self.up, self.left, self.right
        p = up[x]
        g = up[p]
        if left[p] == x:
            inner = left[p] = right[x]
            right[x] = p
        else:
            inner = right[p] = left[x]
            left[x] = p
        if inner:
            up[inner] = p
        if left[g] == p:
            left[g] = x
        elif right[g] == p:
            right[g] = x
        up[p], up[x] = x, g
        self.colour[x] = self.colour[p]

    def _splay(self, x: int) -> None:
        """Make x the root of its splay tree."""
        up, left, right = self.up, self.left, self.right
        p = up[x]
        while left[p] == x or right[p] == x:
            g = up[p]
            if left[g] == p or right[g] == p:
                self._rotate(p if (left[g] == p) == (left[p] == x) else x)
            self._rotate(x)
            p = up[x]

    def append(self, word: int) -> list[int]:
        """Add a word; the periods of the squares with a primitive root that end with it."""
        length, link, step = self.length, self.link, self.step
        up, left, right, colour = self.up, self.left, self.right, self.colour
        self.end += 1
        end = self.end
        new, p = self._state(end + 1, {}), self.last
        while p and word not in step[p]:
            step[p][word] = new
            p = link[p]
        if not p:
            parent = 1
        else:
            q = step[p][word]
            parent = q
            if length[q] != length[p] + 1:
                parent = self._state(length[p] + 1, dict(step[q]))
                link[parent], link[q] = link[q], parent
                while p and step[p].get(word) == q:
                    step[p][word] = parent
                    p = link[p]
                # The copy goes between q and what lies above it, on q's own path and with its colour.
                self._splay(q)
                above = left[q]
                left[parent], left[q], up[parent] = above, parent, q
                if above:
                    up[above] = parent
        link[new] = up[new] = parent
        self.last = new
        colour[new] = end
        periods, below, x = [], new, parent
        while x:
            self._splay(x)
            distance, high, next_path = end - colour[x], length[x], up[x]
            if distance <= high and distance > (length[next_path] if next_path else 0):
                periods.append(distance)
            cut = right[x]
            if cut:  # longer strings keep their colour and become a path below x
                colour[cut] = colour[x]
            right[x] = below
            colour[x] = end
            below, x = x, next_path
        return periods


def _stretches(ids: np.ndarray) -> Iterator[tuple[int, int]]:
    """(start, end) of the stretches whose words all lie in six-word windows that occur again in the same stretch."""
    todo = [(0, len(ids))]
    while todo:
        a, b = todo.pop()
        n = b - a - WINDOW + 1
        if n <= WINDOW:
            continue
        h = np.zeros(n, np.uint64)
        with np.errstate(over="ignore"):
            for k in range(WINDOW):
                h = common.mix(h * np.uint64(0x9E3779B97F4A7C15) + ids[a + k : a + k + n])
        order = np.sort(h)
        again = order[1:][order[1:] == order[:-1]]
        if not len(again):
            continue
        cover = np.zeros(b - a + 1, np.int64)
        at = np.flatnonzero(np.isin(h, again))
        np.add.at(cover, at, 1)
        np.add.at(cover, at + WINDOW, -1)
        inside = np.concatenate([[False], np.cumsum(cover)[:-1] > 0, [False]])
        edges = np.flatnonzero(inside[1:] != inside[:-1]) + a
        if len(edges) == 2 and edges[1] - edges[0] == b - a:
            yield a, b
        else:
            todo.extend(zip(edges[::2].tolist(), edges[1::2].tolist(), strict=True))


def find_runs(ids: np.ndarray) -> list[Run]:
    """(start, length, period) of every run of a sequence of word numbers, by start and period."""
    found = []
    for a, b in _stretches(ids.astype(np.uint64)):
        paths = SuffixPaths()
        open_runs: dict[int, list[int]] = {}
        for end, word in enumerate(ids[a:b].tolist()):
            for period in paths.append(word):
                run = open_runs.get(period)
                if run and run[1] == end - 1:
                    run[1] = end
                else:
                    if run:
                        found.append((a, period, *run))
                    open_runs[period] = [end, end]
        found.extend((a, period, *run) for period, run in open_runs.items())
    runs = [(a + first - 2 * d + 1, last - first + 2 * d, d) for a, d, first, last in found]
    return sorted((s, n, d) for s, n, d in runs if n >= MIN_WORDS)


class Numbers(dict):
    """Word to its number, in order of first sight."""

    def __missing__(self, word: bytes) -> int:
        value = self[word] = len(self)
        return value


def _sha(data: bytes) -> str:
    return hashlib.sha256(data).hexdigest()


def summary(words: list[bytes]) -> tuple[tuple, list[Run]]:
    """The result's columns after the id, and the runs."""
    n = len(words)
    ids = np.fromiter(map(Numbers().__getitem__, words), np.int64, n)
    runs = find_runs(ids)
    if not runs:
        return (0, None, None, None, None, _sha(b""), _sha(b" ".join(words))), runs
    dropped = np.zeros(n + 1, np.int64)
    for start, length, period in runs:
        dropped[start + period] += 1
        dropped[start + length] -= 1
    keep = np.cumsum(dropped)[:n] == 0
    start, length, period = min(runs, key=lambda r: (-r[1], r[0], r[2]))
    listed = "".join(f"{s},{k},{d}\n" for s, k, d in sorted(runs, key=lambda r: (r[0], r[2])))
    kept = [w for w, k in zip(words, keep.tolist(), strict=True) if k]
    return (len(runs), start, length, period, 1000 * length // period, _sha(listed.encode()), _sha(b" ".join(kept))), runs


def _words(k_id: int | None, text: str) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").split()


def planted_repeats(k_id: int | None, text: str) -> list[bytes]:
    """Words of a text; for a tenth of the ids, chosen by hash, the end of the text is one stretch repeated over and over.

    Part of the query's definition: with h the CRC of the id and g = h div 10, where h ends in 0 each word i >= a becomes word
    a + (i - a) mod p, a = g mod n, p = 1 + (n - a) div (3 + g mod 8).
    """
    words = _words(k_id, text)
    if k_id is None or not words:
        return words
    h, n = zlib.crc32(str(k_id).encode()), len(words)
    if h % 10:
        return words
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return words[:a] + [words[a + k % p] for k in range(n - a)]


def periodic_runs(docs: DataFrame, words_of: Callable[[int | None, str], list[bytes]] = _words) -> DataFrame:
    """Runs of every document: their number, the longest (ties: first, then shortest period), and hashes of the list and of the
    text without repeats; ``runs`` lists (start, length, period).

    A word is left out of the collapsed text if a run holds it after that run's first period.
    """
    common.prepare(docs.sparkSession)
    source = docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"].cast("string").alias("text"))
    kinds = [pa.int64()] * 5 + [pa.string()] * 2
    run_kind = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        rows, lists = [], []
        for k_id, text in zip(batch.column("doc_id").to_pylist(), common.texts(batch), strict=True):
            row, runs = summary(words_of(k_id, text))
            rows.append(row)
            lists.append([{"start": s, "length": n, "period": d} for s, n, d in runs])
        columns = [pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)]
        names = [part.strip().split()[0] for part in _SCHEMA.split(",")]
        return pa.RecordBatch.from_arrays([batch.column("doc_id"), *columns, pa.array(lists, run_kind)], [*names, "runs"])

    return common.map_arrow(source, work, _SCHEMA + ", runs array<struct<start:long,length:long,period:long>>")
