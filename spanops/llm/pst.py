"""LM scoring with a probabilistic suffix tree over words.

A state of the tree is a context of up to two words. The tree grows level by level: a context and a (context, word) pair
are candidates if they occur at least ``MIN_COUNT`` times, at every size of the input. A candidate context is retained
if its next-word distribution diverges from that of its longest retained suffix by more than its parameters cost (half of
ln N each): a test by description length. In a state, counts of its pairs (less ``DISCOUNT`` each) go to the words it lists,
and the remaining mass goes by its parent's distribution down to the base, so every state's distribution sums to one:

    P(w | s) = (max(c(s, w) - DISCOUNT, 0) + rest(s) * P(w | parent(s))) / c(s)

The longest retained suffix of the words before a token is its state. The base is (c + 0.5) / (N + 0.5 (V + 1)) over all training
tokens, ends included. Word counts are complete: words too rare for the tree are counted and joined, never dropped.
Words, pairs and triples are identified by 64-bit hashes.

Counts, levels and states are written tables and the test is an aggregation of theirs. Each state and pair adds a fixed number
to a token's log10 P, so a document's score is a sum over its words, pairs and triples, each as often as it occurs, joined to
one table of those numbers. Only two things of bounded size go through the driver, and neither changes a result: bitmaps of key
hashes (``BITS``) keep keys that are surely absent out of the shuffles, and the ``CACHE`` most frequent numbers are added in the tasks.

Defined results: documents train unless crc32(doc_id as text) mod 5 is 1 (a null id counts as the text '' and trains); a null or
empty text is one end token; rows read twice train twice and get the same score each; without training tokens the base
scores are log10(0.5 / 0.5) = 0; an empty table gives an empty result; other columns play no part.
"""

from __future__ import annotations

import math
from functools import partial, reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from spanops.llm import common

MIN_COUNT = 8
MIN_SHARE = 0.0  # the floor does not rise with the input
DISCOUNT = 0.5
END = 0x5E0E0E0E0E0E0E0E  # stands for the end token among word hashes
BITS = 27  # log2 of the bits of a bitmap
CACHE = 1 << 18
# Pairs are counted and documents are scored in turns, each with its share of the shuffle files; results do not depend on them.
PAIR_TURNS = 2
SCORE_TURNS = 3


def is_training(id_text) -> F.Column:
    return F.pmod(F.crc32(id_text.cast("binary")), F.lit(5)) != 1


def tokens_of(texts: list[str], hashes: common.WordHashes) -> tuple[np.ndarray, np.ndarray]:
    """Word hashes of all texts, an end after each, and the number of tokens of each text."""
    parts, end = [], np.array([END], np.uint64)
    for text in texts:
        parts += [hashes.of(text), end]
    lengths = np.array([len(p) for p in parts[::2]], np.int64) + 1
    return np.concatenate(parts), lengths


def _signed(h: np.ndarray) -> pa.Array:
    return pa.array(h.view(np.int64))


def _joined(context: np.ndarray, word: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        return common.mix(common.mix(context) + word)


def grams(tokens: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Where a token has one and two words before it in its text, and the keys of the pairs and triples ending there."""
    at = np.arange(len(tokens)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
    second, third = np.flatnonzero(at >= 1), np.flatnonzero(at >= 2)
    pair = np.zeros(len(tokens), np.uint64)
    pair[second] = _joined(tokens[second - 1], tokens[second])
    return second, third, pair, _joined(pair[third - 1], tokens[third])


def bitmap(keys: DataFrame) -> np.ndarray:
    """Bits of the keys (column k) by their low ``BITS`` bits; what is not set is surely absent."""
    low = F.col("k").bitwiseAND(F.lit((1 << BITS) - 1))
    parts = keys.groupBy(F.shiftright(low, 15).alias("b")).agg(F.bitmap_construct_agg(low.bitwiseAND(F.lit(32767))).alias("bits")).toArrow()
    out = np.zeros((1 << BITS) // 8, np.uint8).reshape(-1, 4096)
    for b, bits in zip(parts["b"].to_pylist(), parts["bits"].to_pylist(), strict=True):
        out[b] = np.frombuffer(bits, np.uint8)
    return out.reshape(-1)


def maybe(bits: np.ndarray, keys: np.ndarray) -> np.ndarray:
    low = keys & np.uint64(8 * len(bits) - 1)
    return (bits[low >> np.uint64(3)] >> (low & np.uint64(7)).astype(np.uint8)) & 1 == 1


def _count_words(batch: pa.RecordBatch) -> pa.RecordBatch:
    tokens, _ = tokens_of(common.texts(batch), common.WordHashes())
    words, counts = np.unique(tokens, return_counts=True)
    return pa.RecordBatch.from_arrays([_signed(words), pa.array(counts)], ["w", "c"])


def _count_grams(shared, size: int, turns: int, turn: int, batch: pa.RecordBatch) -> pa.RecordBatch:
    """Pairs of words, or triples of pairs, of this turn that may be frequent: key of the context, key of what the parent predicts, count."""
    bits = shared.value
    tokens, lengths = tokens_of(common.texts(batch), common.WordHashes())
    second, third, pair, triple = grams(tokens, lengths)
    if size == 2:
        may = maybe(bits, tokens)
        at = second[may[second] & may[second - 1]]
        keys, context, rest = pair[at], tokens[at - 1], tokens[at]
    else:
        may = maybe(bits, pair)
        good = may[third] & may[third - 1]
        at = third[good]
        keys, context, rest = triple[good], pair[at - 1], pair[at]
    if turns > 1:
        here = (keys >> np.uint64(32)) % np.uint64(turns) == turn
        keys, context, rest = keys[here], context[here], rest[here]
    _, first, counts = np.unique(keys, return_index=True, return_counts=True)
    return pa.RecordBatch.from_arrays([_signed(context[first]), _signed(rest[first]), pa.array(counts)], ["ctx", "rest", "c"])


def _with_key(size: int, batch: pa.RecordBatch) -> pa.RecordBatch:
    """The key of a gram from its parts: a pair's from its words; a triple's from its first pair and, of the second, the last word."""
    context, rest = batch.column("ctx").to_numpy().view(np.uint64), batch.column("last" if size == 3 else "rest").to_numpy().view(np.uint64)
    return pa.RecordBatch.from_arrays(
        [_signed(_joined(context, rest)), *[batch.column(c) for c in ("ctx", "rest", "c")]], ["k", "ctx", "rest", "c"]
    )


def _frequent_grams(docs: DataFrame, lower: DataFrame, size: int, keep: common.Scratch, turns: int = 1) -> list[DataFrame]:
    """(k, ctx, rest, c) of the frequent grams, a table for each turn. Only context, rest and count are sent; keys are made for what is left."""
    shared = docs.sparkSession.sparkContext.broadcast(bitmap(lower))
    found = []
    for turn in range(turns):
        rows = common.map_arrow(docs.select("text"), partial(_count_grams, shared, size, turns, turn), "ctx long, rest long, c long")
        counted = rows.groupBy("ctx", "rest").agg(F.sum("c").alias("c")).where(F.col("c") >= MIN_COUNT)
        if size == 3:
            counted = counted.join(lower.select(F.col("k").alias("rest"), "last"), "rest")
        found.append(keep.write(common.map_arrow(counted, partial(_with_key, size), "k long, ctx long, rest long, c long"), "grams"))
        keep.forget()
    shared.destroy()
    return found


def retain(parts: list[DataFrame], lower: DataFrame, n: int, kind: str, keep: common.Scratch) -> tuple[DataFrame, DataFrame]:
    """The level of the grams in ``parts`` (k, ctx, rest, c) over ``lower`` (k, c, p): rows (k, c, p, delta, last) and states (ctx, passed).

    ``p`` is log10 P of the last word after the context, the parent's where the context is not retained; ``delta`` is what
    a listed word adds to the mass passed on and the parent's ``p``. Contexts are retained that diverge from their parent.
    """
    total = lower.select(F.col("k").alias("ctx"), F.col("c").alias("total"))
    below = lower.select(F.col("k").alias("rest"), F.col("p").alias("below"))
    found = reduce(DataFrame.unionByName, parts)
    rows = keep.write(found.join(total, "ctx").join(below, "rest").withColumnRenamed("rest", "last"), kind)
    keep.drop(*parts)
    keep.forget()
    sums = rows.groupBy("ctx").agg(
        F.max("total").alias("t"), F.sum("c").alias("listed"), F.count("*").alias("size"), F.sum(F.col("c") - DISCOUNT).alias("own"),
    )
    spread = F.greatest(F.col("t") - F.col("own"), F.lit(DISCOUNT)) / F.col("t")
    sums = sums.select("ctx", "t", "listed", "size", spread.alias("spread"))
    p = (F.col("c") - DISCOUNT) / F.col("total") + F.col("spread") * F.pow(F.lit(10.0), F.col("below"))
    coded = rows.join(sums.select("ctx", "spread"), "ctx").groupBy("ctx").agg(
        # Gain in nats of coding the listed words here instead of in the parent; the others pay for the mass passed on.
        F.sum(F.col("c") * (F.log(p) - F.col("below") * math.log(10))).alias("gain")
    )
    gain = F.col("gain") + F.greatest(F.col("t") - F.col("listed"), F.lit(0)) * F.log("spread")
    kept = coded.join(sums, "ctx").where(gain > 0.5 * math.log(max(2, n)) * (F.col("size") + 1))
    states = keep.write(kept.select("ctx", "spread"), kind)
    own = F.log10(p)
    level = rows.join(states, "ctx", "left").select(
        "k", "c", "last", F.coalesce(own, F.col("below")).alias("p"),
        F.coalesce(own - F.log10("spread") - F.col("below"), F.lit(0.0)).alias("delta"),
    )
    level = keep.write(level, kind)
    keep.drop(rows)
    keep.forget()
    return level, states.select("ctx", F.log10("spread").alias("passed"))


def learn(docs: DataFrame, keep: common.Scratch, pair_turns: int = PAIR_TURNS) -> tuple[DataFrame, int, float]:
    """What each word, pair and triple adds to the scores (k, c, known, base, model), the training tokens and the base's divisor."""
    counted = common.map_arrow(docs.select("text"), _count_words, "w long, c long").groupBy("w").agg(F.sum("c").alias("c"))
    words = keep.write(counted.withColumnRenamed("w", "k"), "words")
    keep.forget()
    counts = words
    total = words.agg(F.sum("c").alias("n"), F.count("*").alias("v")).first()
    n, v = int(total["n"] or 0), int(total["v"] or 0)
    base_den = math.log10(n + 0.5 * (v + 1))
    words = words.withColumn("p", F.log10(F.col("c") + 0.5) - F.lit(base_den))
    frequent = words.where(F.col("c") >= MIN_COUNT)
    pairs, states = retain(_frequent_grams(docs, frequent, 2, keep, pair_turns), frequent, n, "pairs", keep)
    triples, deep = retain(_frequent_grams(docs, pairs, 3, keep), pairs, n, "triples", keep)
    passed = F.coalesce(F.col("passed"), F.lit(0.0))
    none = F.lit(0.0).alias("base")
    adds = (
        words.join(states.withColumnRenamed("ctx", "k"), "k", "left").select("k", "c", F.lit(1).alias("known"), F.col("p").alias("base"), (F.col("p") + passed).alias("model"))
        .union(pairs.join(deep.withColumnRenamed("ctx", "k"), "k", "left").select("k", "c", F.lit(0), none, (F.col("delta") + passed).alias("model")).where("model <> 0"))
        .union(triples.select("k", "c", F.lit(0), none, F.col("delta").alias("model")).where("model <> 0"))
    )
    out = keep.write(adds, "adds")
    keep.drop(counts, pairs, triples)
    keep.forget()
    return out, n, base_den


def _combined(doc: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Equal (document, key) rows as one, with how often each occurs."""
    order = np.lexsort((keys, doc))
    doc, keys = doc[order], keys[order]
    new = np.ones(len(keys), bool)
    new[1:] = (keys[1:] != keys[:-1]) | (doc[1:] != doc[:-1])
    return doc[new], keys[new], np.diff(np.append(np.flatnonzero(new), len(keys)))


def _score_rows(shared, batch: pa.RecordBatch) -> pa.RecordBatch:
    """A row for each document with the sums over cached keys, and one for each of its other words, pairs and triples."""
    (known_keys, known, base, model), bits = shared.value
    tokens, lengths = tokens_of(common.texts(batch), common.WordHashes())
    second, third, pair, triple = grams(tokens, lengths)
    doc = np.repeat(np.arange(len(lengths)), lengths)
    pair, of_pair = pair[second], doc[second]
    may = maybe(bits, pair), maybe(bits, triple)
    keys = np.concatenate([tokens, pair[may[0]], triple[may[1]]])
    of = np.concatenate([doc, of_pair[may[0]], doc[third][may[1]]])
    word = np.arange(len(keys)) < len(tokens)
    at = np.minimum(np.searchsorted(known_keys, keys), max(0, len(known_keys) - 1))
    hit = known_keys[at] == keys if len(known_keys) else np.zeros(len(keys), bool)
    sums = [np.bincount(of[hit], x[at[hit]], len(lengths)) for x in (known, base, model)]
    rows = [_combined(of[good], keys[good]) for good in (word & ~hit, ~word & ~hit)]
    docs, more = np.arange(len(lengths)), sum(len(r[0]) for r in rows)
    none, zeros = np.zeros(len(docs), np.int64), np.zeros(more, np.int64)
    ids, hashes = np.asarray(batch.column("k_id")), np.asarray(batch.column("k_hash"))
    at = np.concatenate([docs, *(r[0] for r in rows)])
    own = _joined(ids.view(np.uint64), hashes.view(np.uint64))
    times = [np.concatenate([none, *(r[2] for r in rows)]), np.concatenate([none, rows[0][2], np.zeros_like(rows[1][2])])]
    return pa.RecordBatch.from_arrays(
        [
            # A document's own row looks for a key that is none: it has no times.
            pa.array(ids[at]), pa.array(hashes[at]), _signed(np.concatenate([own, *(r[1] for r in rows)])),
            pa.array(np.concatenate([np.ones(len(docs), np.int64), zeros])), *map(pa.array, times),
            pa.array(np.concatenate([lengths, zeros])), pa.array(np.concatenate([sums[0].astype(np.int64), zeros])),
            pa.array(np.concatenate([sums[1], zeros.astype(float)])), pa.array(np.concatenate([sums[2], zeros.astype(float)])),
        ],
        ["k_id", "k_hash", "k", "copies", "times", "words", "n_tokens", "n_known", "base_sum", "model_sum"],
    )


_HASHED = "spark.sql.adaptive.maxShuffledHashJoinLocalMapThreshold"
_SCORED = "k_id long, k_hash long, k long, copies long, times long, words long, n_tokens long, n_known long, base_sum double, model_sum double"


def score(docs: DataFrame, pair_turns: int = PAIR_TURNS, score_turns: int = SCORE_TURNS) -> DataFrame:
    """Token counts, base and model score of every document; learnt from the training documents of the same table."""
    spark: SparkSession = common.prepare(docs.sparkSession)
    source, keep = common.keyed(docs), common.Scratch(spark)
    training = is_training(F.coalesce(common.shown_id().cast("string"), F.lit("")))
    before = spark.conf.get(_HASHED)
    spark.conf.set(_HASHED, "32m")  # joins whose partitions are all this small need no sorting
    try:
        adds, n, base_den = learn(source.where(training), keep, pair_turns)
        top = adds.orderBy(F.desc("c"), "k").limit(CACHE).toArrow()
        keys = np.asarray(top["k"].to_numpy()).astype(np.int64).view(np.uint64)
        order = np.argsort(keys)
        cached = keys[order], *(np.asarray(top[x].to_numpy()).astype(float)[order] for x in ("known", "base", "model"))
        shared = spark.sparkContext.broadcast((cached, bitmap(adds.where("known = 0"))))
        # Words that no training document has; pairs and triples without a number add nothing.
        unseen = F.when(F.col("known").isNull(), F.col("words") * F.lit(math.log10(0.5) - base_den)).otherwise(0.0)
        add = lambda x: F.coalesce(F.col("times") * F.col(x), unseen)
        done = []
        for turn in range(score_turns):
            some = source.where(F.pmod(F.xxhash64("k_id", "k_hash"), F.lit(score_turns)) == turn)
            rows = common.map_arrow(some, partial(_score_rows, shared), _SCORED)
            joined = rows.join(adds.select("k", "known", "base", "model"), "k", "left")
            sums = joined.groupBy("k_id", "k_hash").agg(
                F.sum("copies").alias("copies"),
                F.sum("n_tokens").alias("n_tokens"),
                F.sum(F.col("n_known") + F.coalesce(F.col("known") * F.col("words"), F.lit(0))).alias("n_known"),
                F.sum(F.col("base_sum") + add("base")).alias("base_score"),
                F.sum(F.col("model_sum") + add("model")).alias("score"),
            )
            done.append(keep.write(sums, "scores"))
            keep.forget()
    finally:
        spark.conf.set(_HASHED, before)
    shared.destroy()
    keep.drop(adds)
    # Equal rows were added up; each gets its share back.
    each = reduce(DataFrame.unionByName, done).select(
        common.shown_id().alias("doc_id"), (~training).alias("held_out"),
        *[(F.col(x) / F.col("copies")).cast("long").alias(x) for x in ("n_tokens", "n_known")],
        F.lit(n).cast("long").alias("train_tokens"),
        *[(F.col(x) / F.col("copies")).alias(x) for x in ("base_score", "score")],
        F.explode(F.expr("array_repeat(0, int(copies))")).alias("copy"),
    )
    return each.drop("copy")
