"""Toxicity scores of texts whose disguises are undone by a noisy channel.

Writing l3etspeak, s p a c e d letters, d.o.t.s or loooong letters is taken as noise over plain letters. A disguised stretch becomes
a lattice: each sign may stand for itself or for the letters it imitates, a repetition for one letter or two, a gap between
single letters for nothing or for a word's end. A character model (four letters, interpolated down to one) counted over all texts says
which path is likeliest (Viterbi). The restored words and their beginnings, not the written ones, are the features of a logistic
regression on the labels; only those that occur in the two classes more unevenly than chance explains take part.

Plain words have a lattice of one path and are read as they are. Restoring and scoring work on whole texts. Labelled rows are
learned from a bounded sample: those with the smallest id hashes, up to ``SAMPLE_DOCS`` of each class; the classes weigh as
often as the labels have them.

Defined results: a null or empty text scores what the model says without any word; a null id stays null and is learned from by nobody;
equal rows get equal scores; an empty table gives an empty result; with labels of one class or none, every score is that
class, or 0; of differing labels of a document the higher counts; other columns play no part.
"""

from __future__ import annotations

import re
import unicodedata
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from spanops.llm import common
from spanops.session import materialize

SAMPLE_DOCS = 4000
BUCKETS = 1 << 18
# Lengths of the beginnings of words that count as stems.
STEMS = (4, 5, 6, 7, 8)
CHI_SQUARED = 25.0
ROUNDS = 300
HELD_OUT = (5, 0)

# Letters are 1 to 26, 0 is a word's end, 27 any other sign.
LETTERS, OTHER, ORDER = 28, 27, 4
# Letters that a sign imitates.
IMITATED = {
    "0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "bg", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s", "!": "i",
    "|": "il", "+": "t", "(": "c", "€": "e", "£": "l", "§": "s", "*": "aeiou", "#": "h", "%": "x", "&": "a",
}
GAPS = " .-_*~,/"
# Costs (negative logs) of the channel: a sign for a letter, a gap left out, a repetition for one letter or for two, and
# any other sign as itself.
SIGN_COST, GAP_COST, ONE_COST, TWO_COST, SELF_COST = 1.2, 0.7, 0.2, 1.6, 9.0

# Accented letters as their base letter: by decomposition.
_BASE = {c: d for c in range(0xC0, 0x250) if (d := unicodedata.normalize("NFKD", chr(c)).lower()[0]) != chr(c) and d.isascii()}
_CODES = bytes(c - 96 if 97 <= c <= 122 else 0 if chr(c) in common.SPACES + ".,;:?\"'()-_/" else OTHER for c in range(256))
_MIXED = re.compile(r"(?=[^\s]*[a-z])[^\s]*[^a-z\s.,;:?\"')\-_/]")
_REPEAT = re.compile(r"(.)\1\1")
# Single letters with single gaps between them, three at least; or a word of them joined by signs.
_SPACED = re.compile(r"(?<!\S)\S(?: \S){2,}(?!\S)")
_JOINED = re.compile(r"(?:^|(?<=[^\w]))\w(?:[.\-_*~,/]\w){2,}(?!\w)")
_EDGE = "".join(chr(c) for c in range(33, 127) if not chr(c).isalnum())


_STEM = zlib.crc32(b"\0")


def fold(text: str) -> str:
    """Lower case, accented and wide letters as plain ones."""
    text = text.lower()
    return text if text.isascii() else unicodedata.normalize("NFKC", text).translate(_BASE)


def codes(folded: str) -> np.ndarray:
    points = np.frombuffer(folded.encode("utf-32-le", "surrogatepass"), np.uint32)
    table = np.frombuffer(_CODES, np.uint8)
    return np.where(points < 256, table[points & 255], np.uint8(OTHER))


# Each Latin-1 character, folded; those that become several letters count as one sign.
_LATIN = bytes(codes(f)[0] if len(f := fold(chr(c))) == 1 else OTHER for c in range(256))


def letter_codes(text: str) -> np.ndarray:
    """``codes(fold(text))``, by one table where the text has Latin letters only."""
    try:
        return np.frombuffer(text.lower().encode("latin-1").translate(_LATIN), np.uint8)
    except UnicodeEncodeError:
        return codes(fold(text))


def letter_counts(docs: DataFrame) -> np.ndarray:
    """How often each four signs follow each other, over all texts; word ends stand between texts."""
    source = docs.select(F.coalesce(docs["text"].cast("string"), F.lit("")).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(LETTERS**ORDER, np.int64)
        gap = np.zeros(ORDER - 1, np.uint8)
        for batch in batches:
            found = [part for t in common.texts(batch) if t for part in (gap, letter_codes(t))]
            if found:
                c = np.concatenate([*found, gap[:1]]).astype(np.int32)
                at = c[:-3] * LETTERS**3 + c[1:-2] * LETTERS**2 + c[2:-1] * LETTERS + c[3:]
                total += np.bincount(at, minlength=LETTERS**ORDER)
        at = np.flatnonzero(total)
        for k in range(0, len(at), 1 << 16):
            part = at[k : k + (1 << 16)]
            yield pa.RecordBatch.from_arrays([pa.array(part, pa.int32()), pa.array(total[part], pa.int64())], ["at", "n"])

    rows = source.mapInArrow(run, "at int, n long").groupBy("at").agg(F.sum("n").alias("n")).toArrow()  # at most LETTERS ** ORDER rows
    counts = np.zeros(LETTERS**ORDER, np.float64)
    counts[rows.column("at").to_numpy()] = rows.column("n").to_numpy()
    return counts.reshape((LETTERS,) * ORDER)


def letter_costs(counts: np.ndarray) -> np.ndarray:
    """Negative log probability of a letter or word end after three signs, interpolated with shorter contexts.

    Counts with other signs are left out, as disguises must not become part of the language; such a sign has a fixed cost and
    counts as a word end for what follows.
    """
    counts = counts[:OTHER, :OTHER, :OTHER, :OTHER]
    p = np.full(OTHER, 1.0 / OTHER)
    for order in range(1, ORDER + 1):
        seen = counts.sum(axis=tuple(range(ORDER - order)))
        strength = 5.0 if order > 1 else OTHER
        p = (seen + strength * p) / (seen.sum(-1, keepdims=True) + strength)
    costs = np.full((LETTERS,) * ORDER, SELF_COST, np.float32)
    context = np.arange(LETTERS) % OTHER
    costs[..., :OTHER] = -np.log(p)[np.ix_(context, context, context)]
    return costs


def lattice(folded: str) -> list[list[tuple[str, float]]]:
    """For each step the readings with their cost; an empty reading leaves the step out."""
    steps: list[list[tuple[str, float]]] = []
    k = 0
    while k < len(folded):
        c, run = folded[k], 1
        while k + run < len(folded) and folded[k + run] == c:
            run += 1
        single = run == 1 and c in GAPS and 0 < k < len(folded) - 1
        if single and (k == 1 or not folded[k - 2].isalnum()) and (k + 2 == len(folded) or not folded[k + 2].isalnum()):
            steps.append([(" ", 0.0), ("", GAP_COST)])  # a gap between single letters
            if c in IMITATED:
                steps[-1] += [(x, SIGN_COST) for x in IMITATED[c]]
        elif "a" <= c <= "z":
            steps.extend([[(c, ONE_COST), (c + c, TWO_COST)]] if run > 2 else [[(c, 0.0)]] * run)
        elif c in IMITATED:
            readings = [(x, SIGN_COST) for x in IMITATED[c]]
            steps.extend([[(c, 0.0), *readings]] if run > 2 else [[(c, 0.0), *readings]] * run)
        else:
            steps.extend([[(c, 0.0)]] * (1 if run > 2 else run))
        k += run
    return steps


def _code(sign: str) -> int:
    return _CODES[ord(sign)] if ord(sign) < 256 else OTHER


def restore(folded: str, costs: np.ndarray) -> str:
    """The likeliest plain text of a disguised stretch; of equal costs the reading named first."""
    # State: the last three signs. What all surviving paths share is final, so only open ends are kept as paths.
    done: list[str] = []
    paths: dict[tuple[int, int, int], tuple[float, str]] = {(0, 0, 0): (0.0, "")}
    for readings in lattice(folded) + [[(" ", 0.0)]]:
        after: dict[tuple[int, int, int], tuple[float, str]] = {}
        for state, (cost, text) in paths.items():
            for reading, extra in readings:
                a, b, c = state
                total = cost + extra
                for sign in reading:
                    d = _code(sign)
                    total += float(costs[a, b, c, d])
                    a, b, c = b, c, d
                known = after.get((a, b, c))
                if known is None or total < known[0]:
                    after[a, b, c] = (total, text + reading)
        paths = after
        if len(paths) == 1:
            state, (cost, text) = next(iter(paths.items()))
            done.append(text)
            paths = {state: (cost, "")}
    done.append(min(paths.values())[1])
    return "".join(done).strip()


class Words(dict):
    """Written word to the feature buckets of its restored words, remembered up to a bound."""

    LIMIT = 300_000

    def __init__(self, costs: np.ndarray, weights: np.ndarray | None = None):
        """With weights, buckets without weight are left out."""
        super().__init__()
        self.costs = costs
        self.used = None if weights is None else (weights != 0).tobytes()

    def __missing__(self, word: str) -> tuple[int, ...]:
        if len(self) >= self.LIMIT:
            self.clear()
        value = self[word] = self.buckets(self.plain(word))
        return value

    def plain(self, word: str) -> str:
        """A written word as it was meant."""
        core = fold(word)
        if core.isalpha() and not _REPEAT.search(core):
            return core
        inner = core.strip(_EDGE)
        if inner.isalpha() and core[:1] not in IMITATED and core[-1:] not in "$@" and not _REPEAT.search(inner):
            return inner
        if _MIXED.match(core) or _REPEAT.search(core) or _JOINED.search(core):
            return restore(core.lstrip(".,;:?\"'").rstrip(".,;:?!\"'"), self.costs)
        return inner

    def buckets(self, plain: str) -> tuple[int, ...]:
        """Buckets of the words and of their beginnings, which stand for the stems of inflected and compound words."""
        found = []
        for part in plain.split():
            if word := part.strip(_EDGE):
                raw = word.encode("utf-8", "surrogatepass")
                found.append(zlib.crc32(raw) % BUCKETS)
                if len(raw) != len(word):
                    found += [zlib.crc32(word[:k].encode("utf-8", "surrogatepass"), _STEM) % BUCKETS for k in STEMS if k < len(word)]
                else:
                    found += [zlib.crc32(raw[:k], _STEM) % BUCKETS for k in STEMS if k < len(raw)]
        used = self.used
        return tuple(found if used is None else [b for b in found if used[b]])

    def of(self, text: str) -> np.ndarray:
        """Distinct buckets of the words of a text, restored."""
        seen: set[int] = set()
        for found in map(self.__getitem__, set(text.lower().split())):
            seen.update(found)
        for stretch in _SPACED.findall(text):
            seen.update(self.buckets(restore(fold(stretch), self.costs)))
        return np.fromiter(seen, np.int64, len(seen))


def restored(text: str, costs: np.ndarray) -> str:
    """A whole text with its disguised stretches in plain letters, the rest in lower case."""
    make = Words(costs)
    text = _SPACED.sub(lambda m: restore(fold(m.group()), costs), text)
    return re.sub(r"\S+", lambda m: m.group().lower() if m.group().strip(_EDGE).isalpha() and not _REPEAT.search(m.group()) else make.plain(m.group().lower()), text)


def telling(hits: Column, total: Column, sizes: tuple[int, int]) -> Column:
    """Whether a bucket (``hits`` of ``total`` documents with label 1) occurs more unevenly than chance, by a chi-squared score.

    ``sizes``: documents with label 0 and 1.
    """
    share = total / F.lit(float(sum(sizes)))
    spread = share * (1 - share) * F.lit(sizes[0] * sizes[1] / sum(sizes))
    return (total >= 4) & (F.pow(hits - share * sizes[1], F.lit(2.0)) > F.lit(CHI_SQUARED) * spread)


def fit(parts: list[np.ndarray], labels: np.ndarray, share: float, l2: float = 1e-4) -> np.ndarray:
    """Logistic regression over binary features by Adam; weights of all buckets and the intercept.

    Documents weigh so that label 1 has its ``share`` among the labels.
    """
    flat = np.concatenate(parts)
    doc = np.repeat(np.arange(len(parts)), [len(p) for p in parts])
    sizes = np.bincount(labels, minlength=2)
    weight = np.where(labels == 1, share / sizes[1], (1 - share) / sizes[0])
    used, flat = np.unique(flat, return_inverse=True)
    w = np.zeros(len(used) + 1)
    w[-1] = np.log(share / (1 - share))
    first, second = np.zeros_like(w), np.zeros_like(w)
    for step in range(1, ROUNDS + 1):
        z = np.bincount(doc, w[flat], len(parts)) + w[-1]
        error = (1 / (1 + np.exp(-z)) - labels) * weight
        g = np.append(np.bincount(flat, error[doc], len(used)), error.sum()) + l2 * w
        first = 0.9 * first + 0.1 * g
        second = 0.99 * second + 0.01 * g * g
        w -= 0.1 * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.99**step)) + 1e-9)
    out = np.zeros(BUCKETS + 1)
    out[used], out[BUCKETS] = w[:-1], w[-1]
    return out


def held_out(doc_id: Column) -> Column:
    """Whether labels of a document are kept back, by a hash of its id."""
    every, rest = HELD_OUT
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % every == rest, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, costs: np.ndarray, sample_docs: int = SAMPLE_DOCS) -> np.ndarray | float:
    """Weights from labelled documents that are not held out; a bare share where the labels do not differ."""
    told = labels.select(labels["doc_id"].cast("long").alias("k_id"), labels["toxic"].cast("int").alias("label"))
    told = told.where("k_id is not null and label in (0, 1)").where(~held_out(F.col("k_id"))).groupBy("k_id").agg(F.max("label").alias("label"))
    texts = docs.select(docs["doc_id"].cast("long").alias("k_id"), docs["text"].cast("string").alias("text")).where("text is not null")
    told = materialize(told.join(texts.select("k_id"), "k_id", "left_semi"), "told")
    have = {r["label"]: r["count"] for r in told.groupBy("label").count().collect()}
    if len(have) < 2:
        return float(next(iter(have), 0))
    rank = F.xxhash64("k_id")
    picks = [told.where(F.col("label") == k).orderBy(rank, "k_id").limit(sample_docs) for k in (0, 1)]
    sample = texts.join(picks[0].unionByName(picks[1]), "k_id").select("k_id", "label", "text")

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        make = Words(costs)
        found = [np.sort(make.of(t)) for t in common.texts(batch)]
        ends = np.concatenate([[0], np.cumsum([len(f) for f in found])])
        return pa.RecordBatch.from_arrays([batch.column("k_id"), batch.column("label"), common.lists(np.concatenate(found), ends, pa.int32())], ["k_id", "label", "features"])

    features = materialize(common.map_arrow(sample, work, "k_id long, label int, features array<int>"), "features")
    sizes = {r["label"]: r["count"] for r in features.groupBy("label").count().collect()}
    counted = features.select("label", F.explode("features").alias("bucket")).groupBy("bucket").agg(F.sum("label").alias("hits"), F.count("*").alias("total"))
    # Only telling buckets leave the tasks, and the driver learns from those alone.
    useful = counted.where(telling(F.col("hits"), F.col("total"), (sizes.get(0, 0), sizes.get(1, 0)))).select("bucket")
    kept = features.select("k_id", "label", F.explode("features").alias("bucket")).join(F.broadcast(useful), "bucket")  # at most BUCKETS rows
    told_of = kept.groupBy("k_id").agg(F.collect_set("bucket").alias("features"))
    rows = sorted((r.k_id, r.label, sorted(r.features or [])) for r in features.select("k_id", "label").distinct().join(told_of, "k_id", "left").collect())
    return fit([np.array(f, np.int64) for _, _, f in rows], np.array([k for _, k, _ in rows]), have[1] / (have[0] + have[1]))


def scores(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``doc_id, held_out, score, predicted`` of every document."""
    spark = common.prepare(docs.sparkSession)
    costs = letter_costs(letter_counts(docs))
    weights = train(docs, labels, costs)
    if isinstance(weights, float):
        weights = np.append(np.zeros(BUCKETS), np.inf if weights else -np.inf)
    shared = spark.sparkContext.broadcast((costs, weights))  # bounded: LETTERS ** ORDER and BUCKETS numbers
    source = docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"].cast("string").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        letters, w = shared.value
        make = Words(letters, w)
        for batch in batches:
            if batch.num_rows:
                z = np.array([np.sort(w[make.of(t)]).sum() + w[BUCKETS] for t in common.texts(batch)])
                score = 1 / (1 + np.exp(-z))
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(score), pa.array((score >= 0.5).astype(np.int32))], ["doc_id", "score", "predicted"])

    scored = source.mapInArrow(run, "doc_id long, score double, predicted int")
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")
