"""Quality rules: a linear-chain CRF labels every line as content or boilerplate; the share of content decides.

Fitting uses a bounded sample of labelled documents (``SAMPLE_DOCS`` of each class; of each up to ``SAMPLE_PIECES`` pieces of
``SAMPLE_LINES`` lines, taken by hash from the whole text). A line of a good document is taken as content, one of a bad document as
boilerplate, and pages are composed of both in turn, so that the chain learns to change its label inside a page. Labelling reads
whole texts.

Defined results: a null or empty text has no words, fails the base rule and is not kept; a null id stays null; equal
rows get equal results; an empty table gives an empty result; without labelled documents of both classes the CRF
abstains (every line is content) and the base rule alone decides. Other columns of the input play no part.
"""

from __future__ import annotations

import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from spanops.llm import common

SAMPLE_DOCS = 400
SAMPLE_LINES = 40
SAMPLE_PIECES = 8
# Lines of one kind that follow each other in a composed page.
STRETCH = 8
MIN_CONTENT = 0.5
MIN_WORDS = 20
MAX_REPEAT_PCT = 30
WINDOW = 8

_SYMBOLS = "#*$%&|<>"
_WORD = re.compile(r"[^\x20\x09-\x0D]+")
_SCHEMA = (
    "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, "
    "base_failed boolean, kept boolean, content_share double"
)


def repeat_words(ids: np.ndarray, window: int = WINDOW) -> int:
    """Words inside windows of ``window`` words that occur at least twice, the first occurrence included."""
    n = len(ids) - window + 1
    if n < 2:
        return 0
    h = np.zeros(n, np.uint64)
    with np.errstate(over="ignore"):
        for k in range(window):
            h = h * np.uint64(0x9E3779B97F4A7C15) + ids[k : k + n]
    _, back, times = np.unique(h, return_inverse=True, return_counts=True)
    if len(times) == n:
        return 0
    starts = np.flatnonzero(times[back] > 1)
    cover = np.zeros(len(ids) + 1, np.int64)
    np.add.at(cover, starts, 1)
    np.add.at(cover, starts + window, -1)
    return int((np.cumsum(cover) > 0).sum())


def line_features(lines: list[str]) -> np.ndarray:
    """One row of binary features per line; ``lines`` hold a word each. The same at every size of text."""
    rows, seen = [], set()
    for line in lines:
        words = line.split()
        n, chars = len(words), max(1, len(line))
        symbols = sum(line.count(c) for c in _SYMBOLS)
        distinct = len(set(words))
        pipes, bangs = line.count("|"), line.count("!")
        upper = sum(w.isupper() for w in words if len(w) > 1)
        digits = sum(line.count(c) for c in "0123456789")
        link = "http" in line or "@" in line
        closed = line.rstrip()[-1:] in ".?!:;\"')"
        rows.append(
            (
                1, n < 3, n < 8, n > 60, symbols > 0, symbols * 20 > chars, symbols * 8 > chars, pipes > 0, pipes * 4 > n,
                bangs * 5 > n, upper * 2 > n, distinct * 2 < n, distinct * 5 < n, line in seen, digits * 5 > chars,
                link, not closed,
            )
        )
        seen.add(line)
    return np.array(rows, np.float64).reshape(len(rows), 17)


class LineCRF:
    """Two labels (0 boilerplate, 1 content), emission weights and label transitions."""

    def __init__(self, emit: np.ndarray, move: np.ndarray):
        self.emit, self.move = emit, move

    def viterbi(self, features: np.ndarray) -> np.ndarray:
        """Most likely label sequence; ties go to content."""
        scores = features @ self.emit
        (m00, m01), (m10, m11) = self.move.tolist()
        back, a, b = [], 0.0, 0.0
        for k, (s0, s1) in enumerate(scores.tolist()):
            if k == 0:
                a, b = s0, s1
                continue
            f0, f1 = b + m10 >= a + m00, b + m11 >= a + m01
            back.append((f0, f1))
            a, b = (b + m10 if f0 else a + m00) + s0, (b + m11 if f1 else a + m01) + s1
        label = b >= a
        out = [label]
        for choice in reversed(back):
            label = choice[label]
            out.append(label)
        return np.array(out[::-1], bool)

    @classmethod
    def fit(cls, sequences: list[np.ndarray], labels: list[np.ndarray], rounds: int = 150, l2: float = 1e-3) -> LineCRF:
        """Maximum likelihood by forward-backward and Adam over all sequences at once (padded)."""
        width, longest = sequences[0].shape[1], max(map(len, sequences))
        x = np.zeros((len(sequences), longest, width))
        y = np.zeros((len(sequences), longest), int)
        live = np.zeros((len(sequences), longest), bool)
        for k, (s, t) in enumerate(zip(sequences, labels, strict=True)):
            x[k, : len(s)], y[k, : len(s)], live[k, : len(s)] = s, t, True
        pairs = live[:, 1:]
        onehot = np.eye(2)[y] * live[..., None]
        seen_emit = np.einsum("ntf,ntl->fl", x, onehot)
        seen_move = np.einsum("nta,ntb->ab", onehot[:, :-1], onehot[:, 1:])
        theta = np.zeros(width * 2 + 4)
        m1, m2 = np.zeros_like(theta), np.zeros_like(theta)
        for step in range(1, rounds + 1):
            emit, move = theta[: width * 2].reshape(width, 2), theta[width * 2 :].reshape(2, 2)
            s = x @ emit
            alpha = np.zeros_like(s)
            alpha[:, 0] = s[:, 0]
            for t in range(1, longest):
                step_in = np.logaddexp(alpha[:, t - 1, 0, None] + move[0], alpha[:, t - 1, 1, None] + move[1]) + s[:, t]
                alpha[:, t] = np.where(live[:, t, None], step_in, alpha[:, t - 1])
            total = np.logaddexp(alpha[:, -1, 0], alpha[:, -1, 1])
            beta = np.zeros_like(s)
            got_move = np.zeros((2, 2))
            for t in range(longest - 2, -1, -1):
                ahead = s[:, t + 1] + beta[:, t + 1]
                both = alpha[:, t, :, None] + move[None] + ahead[:, None, :] - total[:, None, None]
                got_move += (np.exp(np.minimum(both, 0)) * pairs[:, t, None, None]).sum(0)
                back = np.logaddexp(move[:, 0] + ahead[:, 0, None], move[:, 1] + ahead[:, 1, None])
                beta[:, t] = np.where(live[:, t + 1, None], back, 0.0)
            post = np.exp(np.minimum(alpha + beta - total[:, None, None], 0)) * live[..., None]
            got_emit = np.einsum("ntf,ntl->fl", x, post)
            g = np.concatenate([(seen_emit - got_emit).ravel(), (seen_move - got_move).ravel()]) / live.sum() - l2 * theta
            m1, m2 = 0.9 * m1 + 0.1 * g, 0.99 * m2 + 0.01 * g * g
            theta += 0.2 * (m1 / (1 - 0.9**step)) / (np.sqrt(m2 / (1 - 0.99**step)) + 1e-8)
        return cls(theta[: width * 2].reshape(width, 2), theta[width * 2 :].reshape(2, 2))


def _lines(text: str) -> list[str]:
    return [line for line in text.split("\n") if _WORD.search(line)]


def _pieces(batch: pa.RecordBatch) -> pa.RecordBatch:
    """Line features, one number of bits a line, of up to ``SAMPLE_PIECES`` pieces of each text, the pieces with the smallest hashes."""
    k_id, good, bits = [], [], []
    weights = 1 << np.arange(17)
    for doc, label, text in zip(batch.column("k_id").to_pylist(), batch.column("good").to_pylist(), common.texts(batch), strict=True):
        features = line_features(_lines(text))
        starts = list(range(0, len(features), SAMPLE_LINES))
        for start in sorted(sorted(starts, key=lambda s: zlib.crc32(f"{doc}:{s}".encode()))[:SAMPLE_PIECES]):
            k_id.append(doc)
            good.append(label)
            bits.append((features[start : start + SAMPLE_LINES] @ weights).astype(int).tolist())
    return pa.RecordBatch.from_arrays([pa.array(k_id, pa.int64()), pa.array(good, pa.int32()), pa.array(bits, pa.list_(pa.int32()))], ["k_id", "good", "bits"])


def composed(pieces: list[tuple[np.ndarray, int]]) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """Pages and their line labels: stretches of good and bad documents in turn, each line once; what is left stays by itself."""
    stretches: tuple[list[np.ndarray], list[np.ndarray]] = ([], [])
    for features, good in pieces:
        stretches[good].extend(features[k : k + STRETCH] for k in range(0, len(features), STRETCH))
    pages, labels = [], []
    most = max(map(len, stretches))
    for k in range(0, most, 2):
        parts = [(s, good) for j in (k, k + 1) for good in (1, 0) for s in stretches[good][j : j + 1]]
        pages.append(np.concatenate([s for s, _ in parts]))
        labels.append(np.concatenate([np.full(len(s), good) for s, good in parts]))
    return pages, labels


def train(docs: DataFrame, labels: DataFrame, sample_docs: int = SAMPLE_DOCS) -> LineCRF | None:
    """CRF from the labelled documents with the smallest id hashes, as many of each class; the driver gets line features only."""
    told = labels.select(labels["doc_id"].cast("long").alias("k_id"), labels["quality"].cast("int").alias("good"))
    told = told.where("k_id is not null and good in (0, 1)").groupBy("k_id").agg(F.max("good").alias("good"))
    rank = F.xxhash64("k_id")
    picks = [told.where(F.col("good") == g).orderBy(rank, "k_id").limit(sample_docs) for g in (0, 1)]
    texts = docs.select(docs["doc_id"].cast("long").alias("k_id"), docs["text"].cast("string").alias("text")).where("text is not null")
    sample = texts.join(picks[0].unionByName(picks[1]), "k_id").select("k_id", "good", "text")
    rows = sorted(map(tuple, common.map_arrow(sample, _pieces, "k_id long, good int, bits array<int>").collect()))
    found = [((np.array(bits)[:, None] >> np.arange(17) & 1).astype(float), good) for _, good, bits in rows if bits]
    if {good for _, good in found} != {0, 1}:
        return None
    return LineCRF.fit(*composed(found))


def measure(text: str, hashes: common.WordHashes, crf: LineCRF | None, min_content: float = MIN_CONTENT) -> tuple:
    """The figures of one text, in the order of the result's columns after the id."""
    words = text.encode("utf-8", "surrogatepass").split()
    n = len(words)
    word_chars = len(text) - sum(text.count(c) for c in common.SPACES)
    symbols = sum(text.count(c) for c in _SYMBOLS)
    lines = _lines(text)
    duplicates = len(lines) - len(set(lines))
    repeats = repeat_words(hashes.words(words))
    failed = n < MIN_WORDS or 100 * repeats > MAX_REPEAT_PCT * n
    share = 1.0 if lines else 0.0
    if crf is not None and lines:
        weight = np.array([len(line) for line in lines], float)
        share = float((weight * crf.viterbi(line_features(lines))).sum() / weight.sum())
    return n, word_chars, symbols, duplicates, repeats, failed, not failed and share >= min_content, share


def quality(docs: DataFrame, labels: DataFrame, min_content: float = MIN_CONTENT) -> DataFrame:
    """Counts of every document, the base verdict, the content share and whether the document is kept."""
    common.prepare(docs.sparkSession)
    crf = train(docs, labels)
    source = docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"].cast("string").alias("text"))

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        hashes = common.WordHashes()
        rows = [measure(t, hashes, crf, min_content) for t in common.texts(batch)]
        kinds = [pa.int64()] * 5 + [pa.bool_()] * 2 + [pa.float64()]
        columns = [pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)]
        names = [part.strip().split()[0] for part in _SCHEMA.split(",")]
        return pa.RecordBatch.from_arrays([batch.column("doc_id"), *columns], names)

    return common.map_arrow(source, work, _SCHEMA)


def keep_good(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents whose content share and base rule pass, with all their columns and rows."""
    common.prepare(docs.sparkSession)
    crf = train(docs, labels)
    common.small_batches(docs.sparkSession)

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        hashes = common.WordHashes()
        return batch.filter(pa.array([measure(t, hashes, crf)[6] for t in common.texts(batch)], pa.bool_()))

    return common.map_arrow(docs, work, docs.schema)
