"""Mixing sources to target weights by soft domain membership.

A softmax classifier, fitted on a bounded sample of the labelled table (``SAMPLE_DOCS`` of each class, whole texts), gives every
document posteriors over domains. It looks only at words that occur in the domains more unevenly than chance explains.
Nonnegative rates are then fitted by projected gradient so that the expected tokens of each domain,
sum(rate * tokens * posterior), match the targets in least squares. A document's rate depends only on its posteriors;
they are rounded to 1 / ``GRID``, so the documents first combine to one row for each posterior vector (their number is bounded
by the grid, whatever the corpus) and each gradient step is one distributed aggregation over those rows.

Domains come from the labels: toxic, else low (quality 0), else clean (quality 1).

Defined results: a null or empty text has no tokens and the prior as posteriors; a null id stays null; equal rows get equal
results; an empty table gives an empty result; without labels of two domains every document has rate 1 and null
posteriors; other columns play no part.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from spanops.llm import common
from spanops.session import materialize

DOMAINS = ("clean", "low", "toxic")
# Wanted tokens of a domain as a multiple of its expected tokens in the corpus.
TARGETS = {"clean": 1.2, "low": 0.4, "toxic": 0.1}
SAMPLE_DOCS = 1500
BUCKETS = 1 << 17
CHI_SQUARED = 30.0
GRID = 64
STEPS = 90
# Pull of every rate towards 1, so that no rate moves far for a trace of a domain in its posteriors. It fades by FADE a step, and is
# gone by the time the totals meet the targets to MET of each.
RIDGE, FADE, MET = 0.02, 0.9, 0.005

# Signs around a word: every ASCII byte but digits and (lower-case) letters.
_EDGE = bytes(b for b in range(128) if not (48 <= b <= 57 or 97 <= b <= 122))


class Features(dict):
    """Word to feature bucket, remembered up to a bound."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= 400_000:
            self.clear()
        value = self[word] = zlib.crc32(word.strip(_EDGE) or word) % BUCKETS
        return value

    def of(self, text: str) -> tuple[np.ndarray, int]:
        """Distinct buckets of the words of a text and of a few traits of the whole; the number of words."""
        words = text.encode("utf-8", "surrogatepass").lower().split()
        distinct = set(words)
        seen = set(map(self.__getitem__, distinct))
        n, chars = len(words), max(1, len(text))
        symbols = sum(text.count(c) for c in "#*$%&|<>!")
        for trait, value in (("s", symbols * 50 // chars), ("d", 8 * len(distinct) // max(1, n) if n > 50 else 9), ("n", n.bit_length())):
            seen.add(zlib.crc32(f"\0{trait}{value}".encode()) % BUCKETS)
        return np.fromiter(seen, np.int64, len(seen)), n


def telling(flat: np.ndarray, domain: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Whether a bucket occurs in the domains' documents more unevenly than chance, by a chi-squared score.

    ``flat`` lists the buckets of all sampled documents, ``domain`` the domain of each entry. Most words are rare
    compounds; left in, they fit the sample and only blur the posteriors of other documents.
    """
    counts = np.stack([np.bincount(flat[domain == k], minlength=BUCKETS) for k in range(len(sizes))], 1)
    total = counts.sum(1)
    share = (total / sizes.sum())[:, None]
    score = ((counts - share * sizes) ** 2 / np.maximum(share * (1 - share) * sizes, 1e-9)).sum(1)
    return (score > CHI_SQUARED) & (total >= 3)


def fit_classifier(parts: list[np.ndarray], domains: np.ndarray, prior: np.ndarray, rounds: int = 150, l2: float = 3e-4) -> np.ndarray:
    """Softmax regression over binary features, plain batch gradient with momentum; weights (BUCKETS + 1, domains).

    Sampled documents weigh as their domain's share among all labels (``prior``), so that posteriors are those of the corpus.
    """
    classes = len(prior)
    flat = np.concatenate(parts)
    doc = np.repeat(np.arange(len(parts)), [len(p) for p in parts])
    sizes = np.bincount(domains, minlength=classes)
    useful = telling(flat, domains[doc], sizes)[flat]
    flat, doc = flat[useful], doc[useful]
    label = np.eye(classes)[domains]
    weight = (prior / np.maximum(1, sizes))[domains]
    weight /= weight.sum()
    w = np.zeros((BUCKETS + 1, classes))
    first, second = np.zeros_like(w), np.zeros_like(w)
    used = np.unique(np.append(flat, BUCKETS))
    for step in range(1, rounds + 1):
        logits = np.stack([np.bincount(doc, w[flat, k], len(parts)) for k in range(classes)], 1) + w[BUCKETS]
        p = np.exp(logits - logits.max(1, keepdims=True))
        p /= p.sum(1, keepdims=True)
        error = (p - label) * weight[:, None]
        g = np.stack([np.bincount(flat, error[doc, k], BUCKETS + 1) for k in range(classes)], 1)
        g[BUCKETS] = error.sum(0)
        g = g[used] + l2 * w[used]
        first[used] = 0.9 * first[used] + 0.1 * g
        second[used] = 0.99 * second[used] + 0.01 * g * g
        w[used] -= 0.05 * (first[used] / (1 - 0.9**step)) / (np.sqrt(second[used] / (1 - 0.99**step)) + 1e-9)
    return w


def _sampled(batch: pa.RecordBatch) -> pa.RecordBatch:
    make = Features()
    found = [np.sort(make.of(text)[0]) for text in common.texts(batch)]
    ends = np.concatenate([[0], np.cumsum([len(f) for f in found])])
    return pa.RecordBatch.from_arrays(
        [batch.column("k_id"), batch.column("domain"), common.lists(np.concatenate(found), ends, pa.int32())], ["k_id", "domain", "features"]
    )


def train(docs: DataFrame, labels: DataFrame, sample_docs: int = SAMPLE_DOCS) -> np.ndarray | None:
    """Classifier from the labelled documents with the smallest id hashes, up to ``sample_docs`` of each domain.

    Shares of the domains come from all labels of documents at hand. Whole texts are read; the driver gets bucket numbers only.
    """
    domain = F.when(F.col("toxic") == 1, 2).when(F.col("quality") == 0, 1).when(F.col("quality") == 1, 0)
    told = labels.select(labels["doc_id"].cast("long").alias("k_id"), labels["quality"], labels["toxic"])
    told = told.withColumn("domain", domain).where("k_id is not null and domain is not null")
    told = told.groupBy("k_id").agg(F.max("domain").alias("domain"))
    texts = docs.select(docs["doc_id"].cast("long").alias("k_id"), docs["text"].cast("string").alias("text")).where("text is not null")
    told = told.join(texts.select("k_id"), "k_id", "left_semi")
    told = materialize(told, "told")
    shares = {r["domain"]: r["count"] for r in told.groupBy("domain").count().collect()}
    if len(shares) < 2:
        return None
    rank = F.xxhash64("k_id")
    picks = [told.where(F.col("domain") == k).orderBy(rank, "k_id").limit(sample_docs) for k in range(len(DOMAINS))]
    sample = texts.join(picks[0].unionByName(picks[1]).unionByName(picks[2]), "k_id").select("k_id", "domain", "text")
    rows = common.map_arrow(sample, _sampled, "k_id long, domain int, features array<int>").collect()
    rows = sorted((r.k_id, r.domain, r.features) for r in rows)
    prior = np.array([shares.get(k, 0) for k in range(len(DOMAINS))], float)
    return fit_classifier([np.array(f, np.int64) for _, _, f in rows], np.array([k for _, k, _ in rows]), prior / prior.sum())


def posteriors(docs: DataFrame, weights: np.ndarray, keep_row: bool = False, grid: int = GRID) -> DataFrame:
    """``doc_id, mix_tokens, mix_p`` (counts that sum to ``grid``); with ``keep_row`` the input's row as one struct ``mix_row`` too,
    so that none of its columns can clash with these.
    """
    shared = docs.sparkSession.sparkContext.broadcast(weights.astype(np.float32))  # bounded: BUCKETS x domains
    row = [F.struct(*[docs[f"`{c}`"] for c in docs.columns]).alias("mix_row")] if keep_row else []
    source = docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"].cast("string").alias("text"), *row)
    kept = ["doc_id", "mix_row"] if keep_row else ["doc_id"]

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        w, make = shared.value, Features()
        counts, p = [], []
        for text in common.texts(batch):
            seen, n = make.of(text)
            logits = w[seen].sum(0) + w[BUCKETS]
            e = np.exp(logits - logits.max())
            e /= e.sum()
            whole = np.floor(e * grid).astype(int)
            for k in np.argsort(-(e * grid - whole), kind="stable")[: grid - int(whole.sum())]:
                whole[k] += 1
            counts.append(n)
            p.append(whole.tolist())
        columns = [batch.column(c) for c in kept]
        return pa.RecordBatch.from_arrays([*columns, pa.array(counts, pa.int64()), pa.array(p, pa.list_(pa.int32()))], [*kept, "mix_tokens", "mix_p"])

    made = T.StructType([source.schema[c] for c in kept]).add("mix_tokens", "long").add("mix_p", T.ArrayType(T.IntegerType()))
    return common.map_arrow(source, work, made)


def rate_column(p: Column, gradients: list[list[float]], grid: int = GRID) -> Column:
    """The rate after the given steps, from 1; a step is its g for each domain and then its pull c towards 1.

    Each step takes the rate to max(0, rate - p . g - c (rate - 1)).
    """
    rate = F.lit(1.0)
    if not gradients:
        return rate
    k = len(DOMAINS)
    steps = F.array(*[F.array(*[F.lit(float(v) / grid) for v in g[:k]], F.lit(float(g[k]))) for g in gradients])
    dot = lambda g: sum((p[j] * g[j] for j in range(k)), F.lit(0.0))
    return F.aggregate(steps, rate, lambda r, g: F.greatest(F.lit(0.0), r - dot(g) - g[k] * (r - 1)))


def fit_rates(groups: DataFrame, targets: dict[str, float], steps: int = STEPS, grid: int = GRID) -> list[list[float]]:
    """The step vectors of the projected gradient over rows (mix_p, mix_tokens).

    Minimises |sum_i r_i t_i p_i - T|^2, each domain by its own size, plus RIDGE * sum_i t_i (r_i - 1)^2 over r >= 0 from
    r = 1, in the metric that weighs a rate by its tokens, with steps of 1 / L, L being the largest eigenvalue of
    sum_i t_i p_i p_i^T (scaled) plus RIDGE; the pull fades from step to step. Each step is one aggregation to as many numbers as there
    are domains.
    """
    k = len(DOMAINS)
    p, t = [F.col("mix_p")[i] / grid for i in range(k)], F.col("mix_tokens").cast("double")
    row = groups.agg(
        *[F.sum(t * p[i]).alias(f"t{i}") for i in range(k)],
        *[F.sum(t * p[i] * p[j]).alias(f"g{i}{j}") for i in range(k) for j in range(k)],
    ).first()
    have = np.array([row[f"t{i}"] or 0.0 for i in range(k)])
    gram = np.array([[row[f"g{i}{j}"] or 0.0 for j in range(k)] for i in range(k)])
    want = have * np.array([targets[name] for name in DOMAINS])
    size = have.sum()
    if size <= 0:
        return []
    # A domain counts by its own size, else small domains would never be matched.
    scale = 1.0 / np.sqrt(np.maximum(have, 1e-6 * size))
    scaled = scale[:, None] * gram * scale[None]
    step = 1.0 / (max(np.linalg.eigvalsh(scaled)[-1], 1e-12) + RIDGE)
    gradients: list[list[float]] = []
    now = have
    for nth in range(steps):
        gap = now - want
        if (np.abs(gap) <= np.maximum(MET * want, 1e-6 * size)).all():
            break
        gradients.append([*(step * scale * scale * gap).tolist(), step * RIDGE * FADE**nth])
        rate = rate_column(F.col("mix_p"), gradients, grid)
        sums = groups.select(rate.alias("r"), "mix_p", "mix_tokens").agg(*[F.sum(F.col("r") * t * p[i]).alias(f"t{i}") for i in range(k)]).first()
        before, now = now, np.array([sums[f"t{i}"] or 0.0 for i in range(k)])
        if np.abs(now - before).max() <= 1e-7 * size:
            break
    return gradients


def _groups(scored: DataFrame, spark: SparkSession) -> DataFrame:
    """One row for each posterior vector; their number is bounded by the grid."""
    combined = scored.groupBy("mix_p").agg(F.sum("mix_tokens").alias("mix_tokens"), F.count("*").alias("mix_docs"))
    return materialize(combined, "mixing")


def rates(docs: DataFrame, labels: DataFrame, targets: dict[str, float] | None = None) -> DataFrame:
    """Tokens, domain posteriors and fitted rate of every document."""
    spark = common.prepare(docs.sparkSession)
    weights = train(docs, labels)
    if weights is None:
        n = F.size(F.filter(F.split(F.coalesce("text", F.lit("")), r"[\x20\x09-\x0D]+"), lambda w: w != ""))
        none = F.lit(None).cast("double")
        return docs.select(F.col("doc_id").cast("long"), n.cast("long").alias("n_tokens"), *[none.alias(f"p_{d}") for d in DOMAINS], F.lit(1.0).alias("rate"))
    scored = materialize(posteriors(docs, weights), "posteriors")
    gradients = fit_rates(_groups(scored, spark), targets or TARGETS)
    return scored.select(
        "doc_id", F.col("mix_tokens").alias("n_tokens"), *[(F.col("mix_p")[k] / GRID).alias(f"p_{d}") for k, d in enumerate(DOMAINS)],
        rate_column(F.col("mix_p"), gradients).alias("rate"),
    )


def mix(docs: DataFrame, labels: DataFrame, targets: dict[str, float] | None = None) -> DataFrame:
    """``docs`` with each row repeated by its rate: the whole part always, one more with the remaining probability.

    The draw hashes the id and the text, so that it can be repeated. Columns are those of ``docs``.
    """
    spark = common.prepare(docs.sparkSession)
    weights = train(docs, labels)
    if weights is None:
        return docs
    scored = posteriors(docs, weights, keep_row=True)
    gradients = fit_rates(_groups(posteriors(docs, weights), spark), targets or TARGETS)
    draw = F.pmod(F.xxhash64("mix_row.doc_id", "mix_row.text"), F.lit(1 << 20)) / float(1 << 20)
    rated = scored.select("mix_row", draw.alias("draw"), rate_column(F.col("mix_p"), gradients).alias("rate"))
    copies = (F.floor("rate") + (F.col("draw") < F.col("rate") - F.floor("rate")).cast("long")).cast("int")
    return rated.select("mix_row", F.explode(F.array_repeat(F.lit(0), copies))).select("mix_row.*")
