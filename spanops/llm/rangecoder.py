"""Token ids in binary files, coded by an adaptive context-mixing range coder.

A file holds the texts of one range of document ids: a header, an index of ids and lengths, and blocks of at most ``BLOCK`` ids.
A block starts from nothing and has a checksum, so any block decodes alone. In a block the ids are cut into lanes that advance
together, one id each per step, with numpy doing all lanes at once: every step codes with the model as it stood
before the step, then learns from all its ids, in the decoder as in the encoder.

The model predicts from three orders. Order 2 and order 1 each name the id they saw last after their context, with a confidence
of 0 to 3; order 0 is a table of adaptive frequencies. The weights by which the three are mixed are counted for each
combination of confidences: how often order 2, order 1 or neither was right there. The range coder (48 bits, words of 16, no
carries) codes first which predictor is right, then, where neither is, the id by its order-0 frequency.

Defined results: a null or empty text is its end id alone; a null id counts as the smallest; ties go by the text's hash; rows
read twice are both written; an empty table writes no file and gives an empty result; other columns play no part.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window, functions as F

from spanops.llm import bytebpe, common
from spanops.session import materialize, scratch_path

END_ID = 0
BLOCK = 1 << 18
LANES = 2048
FILE_IDS = 1 << 22
MAGIC = b"SPTK\x01"

_TOP, _LOW, _WIDE = np.uint64(1 << 32), np.uint64(1 << 24), np.uint64((1 << 48) - 1)
_WORD = np.uint64(16)
_MIX = 1 << 15
_CONTEXTS = 1 << 16


class Model:
    """Predictions of orders 0 to 2 and their mixing weights, for all lanes of a block."""

    def __init__(self, vocabulary: int, lanes: int):
        self.vocabulary = vocabulary
        self.guess2, self.sure2 = np.full(_CONTEXTS, vocabulary, np.int64), np.zeros(_CONTEXTS, np.int64)
        self.guess1, self.sure1 = np.full(vocabulary + 1, vocabulary, np.int64), np.zeros(vocabulary + 1, np.int64)
        # One row for each pair of confidences and whether the guesses agree: order 2 right, order 1 right, neither.
        self.right = np.tile(np.array([1.0, 1.0, 6.0]), (32, 1))
        self.counts = np.ones(vocabulary, np.int64)
        self.waiting: list[np.ndarray] = []
        self.step = 0
        self.last = np.full(lanes, vocabulary, np.int64)
        self.before = self.last.copy()
        self._sum()

    def _sum(self) -> None:
        if self.waiting:
            self.counts += 24 * np.bincount(np.concatenate(self.waiting), minlength=self.vocabulary)
            self.waiting = []
            if self.counts.sum() > 1 << 22:
                self.counts = (self.counts + 1) >> 1
        self.below = np.concatenate([[0], np.cumsum(self.counts)]).astype(np.uint64)
        self.total = self.below[-1]

    def predict(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Guesses of order 2 and 1, and the cumulative shares (lanes, 2) of [order 2, order 1] out of ``_MIX``."""
        self.slot = (self.before * 40503 + self.last * 2654435761 >> 7) & (_CONTEXTS - 1)
        g2, g1 = self.guess2[self.slot], self.guess1[self.last]
        self.state = self.sure2[self.slot] * 8 + self.sure1[self.last] * 2 + (g1 == g2)
        share = np.cumsum(self.right, 1)
        edges = np.clip((share[:, :2] / share[:, 2:] * _MIX).astype(np.int64), [1, 2], [_MIX - 2, _MIX - 1])
        return g2, g1, edges[self.state]

    def learn(self, ids: np.ndarray, which: np.ndarray, live: int) -> None:
        """``which``: 0 order 2 was right, 1 order 1, 2 neither. Only the first ``live`` lanes hold ids."""
        s, k = self.slot[:live], self.last[:live]
        ids_, which = ids[:live], which[:live]
        np.add.at(self.right, (self.state[:live], which), 1.0)
        if self.step % 32 == 31:
            self.right = self.right * 0.5 + 0.5
        for guess, sure, at in ((self.guess2, self.sure2, s), (self.guess1, self.sure1, k)):
            hit = guess[at] == ids_
            level = sure[at]
            guess[at] = np.where(hit | (level > 0), guess[at], ids_)
            sure[at] = np.where(hit, np.minimum(level + 1, 3), np.maximum(level - 1, 0))
        self.waiting.append(ids_)
        self.step += 1
        if self.step < 16 or self.step % 4 == 0:
            self._sum()
        self.before, self.last = self.last, ids


class _Writer:
    def __init__(self, lanes: int, steps: int):
        self.low, self.range = np.zeros(lanes, np.uint64), np.full(lanes, _WIDE, np.uint64)
        self.words = np.zeros((lanes, 4 * steps + 8), np.uint16)
        self.used = np.zeros(lanes, np.int64)

    def put(self, rows: np.ndarray, start: np.ndarray, size: np.ndarray, total: np.uint64) -> None:
        low, span = self.low[rows], self.range[rows]
        unit = span // total
        low, span = low + unit * start, unit * size
        while True:
            same = (low ^ (low + span)) < _TOP
            small = ~same & (span < _LOW)
            go = same | small
            if not go.any():
                break
            span = np.where(small, (~low + np.uint64(1)) & (_LOW - np.uint64(1)), span)
            out = rows[go]
            self.words[out, self.used[out]] = (low[go] >> np.uint64(32)).astype(np.uint16)
            self.used[out] += 1
            low = np.where(go, (low << _WORD) & _WIDE, low)
            span = np.where(go, span << _WORD, span)
        self.low[rows], self.range[rows] = low, span

    def finish(self) -> bytes:
        for shift in (32, 16, 0):
            self.words[np.arange(len(self.low)), self.used] = ((self.low >> np.uint64(shift)) & np.uint64(0xFFFF)).astype(np.uint16)
            self.used += 1
        filled = np.arange(self.words.shape[1])[None] < self.used[:, None]
        return self.used.astype("<u2").tobytes() + self.words[filled].astype("<u2").tobytes()


class _Reader:
    def __init__(self, lanes: int, data: bytes):
        used = np.frombuffer(data, "<u2", lanes).astype(np.int64)
        self.words = np.append(np.frombuffer(data, "<u2", offset=2 * lanes).astype(np.uint64), np.zeros(8, np.uint64))
        self.at = np.concatenate([[0], np.cumsum(used)[:-1]])
        self.low, self.range, self.code = np.zeros(lanes, np.uint64), np.full(lanes, _WIDE, np.uint64), np.zeros(lanes, np.uint64)
        for _ in range(3):
            self.code = (self.code << _WORD) | self.words[self.at]
            self.at += 1

    def value(self, rows: np.ndarray, total: np.uint64) -> np.ndarray:
        self.unit = self.range[rows] // total
        return np.minimum(((self.code[rows] - self.low[rows]) & _WIDE) // self.unit, total - np.uint64(1))

    def take(self, rows: np.ndarray, start: np.ndarray, size: np.ndarray) -> None:
        low, span, code = self.low[rows] + self.unit * start, self.unit * size, self.code[rows]
        at = self.at[rows]
        while True:
            same = (low ^ (low + span)) < _TOP
            small = ~same & (span < _LOW)
            go = same | small
            if not go.any():
                break
            span = np.where(small, (~low + np.uint64(1)) & (_LOW - np.uint64(1)), span)
            code = np.where(go, ((code << _WORD) & _WIDE) | self.words[np.minimum(at, len(self.words) - 1)], code)
            at += go
            low = np.where(go, (low << _WORD) & _WIDE, low)
            span = np.where(go, span << _WORD, span)
        self.low[rows], self.range[rows], self.code[rows], self.at[rows] = low, span, code, at


def _shape(n: int) -> tuple[int, int]:
    lanes = max(1, min(LANES, n // 64))
    return lanes, -(-n // lanes)


_HEAD = struct.Struct("<IIII")


def encode_block(ids: np.ndarray) -> bytes:
    """A block: count, vocabulary, checksum, length of the code, code."""
    n, vocabulary = len(ids), int(ids.max(initial=0)) + 1
    lanes, steps = _shape(n)
    grid = np.zeros(lanes * steps, np.int64)
    grid[:n] = ids
    grid = grid.reshape(lanes, steps)
    model, out, every = Model(vocabulary, lanes), _Writer(lanes, steps), np.arange(lanes)
    for t in range(steps):
        live = lanes if t < n - (lanes - 1) * steps else -(-(n - t) // steps)
        x, rows = grid[:, t], every[:live]
        g2, g1, edges = model.predict()
        which = np.where(x == g2, 0, np.where(x == g1, 1, 2))
        w, e = which[:live], edges[:live].astype(np.uint64)
        start = np.where(w == 0, np.uint64(0), np.where(w == 1, e[:, 0], e[:, 1]))
        stop = np.where(w == 0, e[:, 0], np.where(w == 1, e[:, 1], np.uint64(_MIX)))
        out.put(rows, start, stop - start, np.uint64(_MIX))
        missed = rows[w == 2]
        if len(missed):
            below = model.below[x[missed]]
            out.put(missed, below, model.below[x[missed] + 1] - below, model.total)
        model.learn(x, which, live)
    code = out.finish()
    return _HEAD.pack(n, vocabulary, zlib.crc32(ids.astype("<u4").tobytes()), len(code)) + code


def decode_block(data: memoryview | bytes, at: int) -> tuple[np.ndarray, int]:
    """Ids of the block at ``at`` and the place after it; raises where the checksum differs."""
    n, vocabulary, check, size = _HEAD.unpack_from(data, at)
    at += _HEAD.size
    lanes, steps = _shape(n)
    grid = np.zeros((lanes, steps), np.int64)
    model, source, every = Model(vocabulary, lanes), _Reader(lanes, bytes(data[at : at + size])), np.arange(lanes)
    for t in range(steps):
        live = lanes if t < n - (lanes - 1) * steps else -(-(n - t) // steps)
        rows = every[:live]
        g2, g1, edges = model.predict()
        e = edges[:live].astype(np.uint64)
        value = source.value(rows, np.uint64(_MIX))
        w = (value >= e[:, 0]).astype(np.int64) + (value >= e[:, 1])
        start = np.where(w == 0, np.uint64(0), np.where(w == 1, e[:, 0], e[:, 1]))
        stop = np.where(w == 0, e[:, 0], np.where(w == 1, e[:, 1], np.uint64(_MIX)))
        source.take(rows, start, stop - start)
        x = np.zeros(lanes, np.int64)
        x[:live] = np.where(w == 0, g2[:live], g1[:live])
        missed = rows[w == 2]
        if len(missed):
            found = np.searchsorted(model.below, source.value(missed, model.total), side="right") - 1
            source.take(missed, model.below[found], model.below[found + 1] - model.below[found])
            x[missed] = found
        grid[:, t] = x
        which = np.full(lanes, 2)
        which[:live] = w
        model.learn(x, which, live)
    ids = grid.ravel()[:n].astype(np.uint32)
    if zlib.crc32(ids.astype("<u4").tobytes()) != check:
        raise ValueError("a block of token ids is damaged")
    return ids, at + size


def encode_file(doc_ids: list[int], lengths: list[int], ids: np.ndarray) -> bytes:
    index = zlib.compress(np.array(doc_ids, "<i8").tobytes() + np.array(lengths, "<u4").tobytes(), 1)
    blocks = [encode_block(ids[a : a + BLOCK]) for a in range(0, len(ids), BLOCK)]
    return b"".join([MAGIC, struct.pack("<QQI", len(doc_ids), len(ids), len(index)), index, *blocks])


def decode_file(data: bytes) -> Iterator[tuple[int, int, int, int]]:
    """(doc id, first place in the file, length, checksum) of each document, block by block."""
    if data[: len(MAGIC)] != MAGIC:
        raise ValueError("not a file of token ids")
    docs, total, size = struct.unpack_from("<QQI", data, len(MAGIC))
    at = len(MAGIC) + struct.calcsize("<QQI")
    index = zlib.decompress(data[at : at + size])
    doc_ids, lengths = np.frombuffer(index, "<i8", docs), np.frombuffer(index, "<u4", docs, 8 * docs).astype(np.int64)
    at += size
    ends = np.cumsum(lengths)
    done, k, check = 0, 0, 0
    view = memoryview(data)
    while done < total:
        ids, at = decode_block(view, at)
        raw, used = ids.astype("<u4").tobytes(), 0
        while k < docs and ends[k] <= done + len(ids):
            stop = int(ends[k]) - done
            yield int(doc_ids[k]), int(ends[k] - lengths[k]), int(lengths[k]), zlib.crc32(raw[4 * used : 4 * stop], check)
            used, k, check = stop, k + 1, 0
        if used < len(ids):
            check = zlib.crc32(raw[4 * used :], check)
        done += len(ids)


def write(docs: DataFrame, folder: str, tokenizer_file: str | None = None, end_id: int = END_ID) -> DataFrame:
    """Write all documents, ascending by id, to ``folder``; one row for each file: ``part, file, docs, ids``."""
    common.prepare(docs.sparkSession)
    file, place = tokenizer_file or bytebpe.default_file(), bytebpe.as_uri(folder)
    ordered = common.keyed(docs).repartitionByRange("k_id", "k_hash").sortWithinPartitions("k_id", "k_hash")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder, part, number = bytebpe.coder(file), TaskContext.get().partitionId(), 0
        doc_ids: list[int] = []
        held: list[np.ndarray] = []
        size = 0

        def flush() -> pa.RecordBatch:
            data = encode_file(doc_ids, [len(h) for h in held], np.concatenate(held))
            bytebpe.write_whole(f"{place}/{part:06d}-{number:06d}.ids", data)
            return pa.RecordBatch.from_pylist([{"part": part, "file": number, "docs": len(doc_ids), "ids": size}], _MANIFEST)

        for batch in batches:
            keys, texts = np.asarray(batch.column("k_id")).tolist(), common.texts(batch)
            for a in range(0, len(texts), 200):
                for key, ids in zip(keys[a : a + 200], coder.encode_all(texts[a : a + 200]), strict=True):
                    doc_ids.append(key)
                    held.append(np.append(ids, np.uint32(end_id)))
                    size += len(held[-1])
                    if size >= FILE_IDS:
                        yield flush()
                        doc_ids, held, size, number = [], [], 0, number + 1
        if held:
            yield flush()

    return materialize(ordered.mapInArrow(run, "part int, file int, docs long, ids long"), "manifest")


_MANIFEST = pa.schema([("part", pa.int32()), ("file", pa.int32()), ("docs", pa.int64()), ("ids", pa.int64())])


def read(spark, folder: str) -> DataFrame:
    """``part, file, k_id, at, n_tokens, ids_crc32`` of every document, decoded from the files of ``folder``."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.ids").load(folder)
    number = F.regexp_extract("path", r"(\d+)-(\d+)\.ids$", 1).cast("int"), F.regexp_extract("path", r"(\d+)-(\d+)\.ids$", 2).cast("int")
    source = files.select(number[0].alias("part"), number[1].alias("file"), "content")
    names = ["part", "file", "k_id", "at", "n_tokens", "ids_crc32"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                rows = list(decode_file(batch.column("content")[k].as_py()))
                part, file = batch.column("part")[k].as_py(), batch.column("file")[k].as_py()
                columns = [pa.array([x] * len(rows), pa.int32()) for x in (part, file)] + [pa.array(c, pa.int64()) for c in zip(*rows, strict=True)]
                yield pa.RecordBatch.from_arrays(columns, names)

    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1")  # a row is a whole file
    try:
        return materialize(source.mapInArrow(run, "part int, file int, k_id long, at long, n_tokens long, ids_crc32 long"), "decoded")
    finally:
        common.prepare(spark)


def stored(docs: DataFrame, folder: str | None = None, tokenizer_file: str | None = None) -> DataFrame:
    """Write and read back: ``doc_id, start, n_tokens, ids_crc32`` of every document."""
    spark = docs.sparkSession
    folder = folder or scratch_path(spark, "tokens")
    manifest = write(docs, folder, tokenizer_file)
    if not manifest.limit(1).count():
        return spark.createDataFrame([], "doc_id long, start long, n_tokens long, ids_crc32 long")
    # Ids before a file: those of earlier files of its part, and of earlier parts.
    zero = lambda c: F.coalesce(c, F.lit(0))
    before = lambda *by: Window.partitionBy(*by[:-1]).orderBy(by[-1]).rowsBetween(Window.unboundedPreceding, -1)
    files = manifest.withColumn("inner", zero(F.sum("ids").over(before("part", "file"))))
    parts = manifest.groupBy("part").agg(F.sum("ids").alias("n"))
    parts = parts.select("part", zero(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1))).alias("outer"))
    bases = files.join(parts, "part").select("part", "file", (F.col("inner") + F.col("outer")).alias("base"))
    return read(spark, folder).join(bases, ["part", "file"]).select(
        common.shown_id().alias("doc_id"), (F.col("base") + F.col("at")).alias("start"), "n_tokens", "ids_crc32"
    )
