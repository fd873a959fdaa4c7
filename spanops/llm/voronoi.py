"""Exact top-k search as a Voronoi kNN join.

Components become floor(256 x); the score is the integer inner product. With one more component, sqrt(M - |v|^2) for
candidates (M the largest squared length) and 0 for queries, the order by score is the order by Euclidean distance, so distance bounds
hold. Queries are grouped by their nearest pivot. For a group with pivot p and radius R (its farthest query) the k-th nearest
candidate of any of its queries is at most R + D away, D being the (k+1)-th smallest distance from p to a candidate (one
more, as a query's own row does not count), so a candidate farther than 2 R + D from p cannot be among the results. Only
candidates within that bound are sent to the group. The bounds come from summaries: one number for each pivot and each
of its k+1 nearest candidates. Groups are worked off in blocks of bounded size, each block gives its best k, and the best
of all blocks are exact.

Defined results: rows whose vector is null, or holds a null or a non-finite component, or whose id is null, take no part;
vectors of another length than the most frequent one (ties: the longer) take no part either; rows repeated with the same id are
separate candidates, except that no row with the query's own id counts, and equal queries are answered once; fewer than k
candidates give fewer rows; an empty table gives an empty result; other columns play no part.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from spanops.llm import common
from spanops.session import materialize

K = 5
EVERY = 50
SCALE = 256
PIVOTS = 24
QUERY_BLOCK = 512
DATA_BLOCK = 20_000
# Relative slack of the bounds, far above the rounding of the distances.
SLACK = 1e-6


def clean(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """``vec_id, v`` (integers as long) of the rows that take part."""
    v, x = F.col(vector_col), "x"
    good = F.expr(f"vec_id is not null and raw is not null and size(raw) > 0 and forall(raw, {x} -> {x} is not null and not isnan({x}) and abs({x}) < double('Infinity'))")
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.transform(v, lambda y: y.cast("double")).alias("raw")).where(good)
    length = rows.groupBy(F.size("raw").alias("n")).agg(F.count("*").alias("c")).orderBy(F.desc("c"), F.desc("n")).first()
    width = length["n"] if length else 0
    whole = F.transform("raw", lambda y: F.floor(y * SCALE).cast("long"))
    return rows.where(F.size("raw") == width).select("vec_id", whole.alias("v"))


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    return np.asarray(column.flatten()).reshape(-1, width)


def _distances(v: np.ndarray, extra: np.ndarray, pivots: np.ndarray, lifted: np.ndarray) -> np.ndarray:
    """Distances of rows (v, extra) to the pivots (pivots, lifted); extra and lifted are the added component."""
    x = v.astype(np.float64)
    square = (x * x).sum(1)[:, None] + (pivots * pivots).sum(1)[None] - 2 * x @ pivots.T + (extra[:, None] - lifted[None]) ** 2
    return np.sqrt(np.maximum(square, 0.0))


def best(q_ids: np.ndarray, q: np.ndarray, ids: np.ndarray, v: np.ndarray, k: int) -> list[tuple[int, int, int]]:
    """(query, candidate, score) of the k best candidates of each query, ties to the smaller id."""
    order = np.argsort(ids, kind="stable")
    ids, v = ids[order], v[order]
    # Products of 256-fold components: exact as double as long as |score| < 2^53.
    exact = float(np.abs(q).max(initial=0)) * float(np.abs(v).max(initial=0)) * v.shape[1] < 2**52
    scores = q.astype(np.float64) @ v.astype(np.float64).T if exact else q @ v.T
    out = []
    for row, query in zip(scores, q_ids, strict=True):
        other = np.flatnonzero(ids != query)
        own = row[other]
        if len(own) > k:
            floor = np.partition(own, len(own) - k)[len(own) - k]
            chosen = np.concatenate([other[own > floor], other[own == floor][:k]])
        else:
            chosen = other
        chosen = chosen[np.lexsort((ids[chosen], -row[chosen]))][:k]
        out += [(int(query), int(ids[c]), int(row[c])) for c in chosen]
    return out


def top_k(vectors: DataFrame, k: int = K, every: int = EVERY, pivots: int = PIVOTS) -> DataFrame:
    """``query_id, rank, vec_id, score``: the ``k`` best of all other rows for every row whose id divides by ``every``."""
    spark = common.prepare(vectors.sparkSession)
    rows = materialize(clean(vectors), "vectors")
    length = F.aggregate("v", F.lit(0.0), lambda a, y: a + y.cast("double") * y.cast("double"))  # beyond what a long holds
    stats = rows.agg(F.max(length).alias("longest"), F.max(F.size("v")).alias("width"), F.count("*").alias("n")).first()
    schema = "query_id long, rank int, vec_id long, score long"
    if not stats["n"]:
        return spark.createDataFrame([], schema)
    longest, width = float(stats["longest"]), int(stats["width"])
    is_query = F.pmod("vec_id", F.lit(every)) == 0
    # Pivots: the queries with the smallest hashes; a fixed number, so they and all summaries are small at any size.
    chosen = rows.where(is_query).select("v").distinct().orderBy(F.xxhash64("v"), "v").limit(pivots).collect()
    if not chosen:
        return spark.createDataFrame([], schema)
    at = np.array([r["v"] for r in chosen], np.float64)
    lifted = np.zeros(len(at))  # queries have 0 as added component

    def extra_of(v: np.ndarray) -> np.ndarray:
        x = v.astype(np.float64)
        return np.sqrt(np.maximum(longest - (x * x).sum(1), 0.0))

    def nearest(batch: pa.RecordBatch) -> pa.RecordBatch:
        v = _matrix(batch.column("v"), width)
        d = _distances(v, np.zeros(len(v)), at, lifted)
        group = d.argmin(1)
        return pa.RecordBatch.from_arrays(
            [batch.column("vec_id"), batch.column("v"), pa.array(group, pa.int32()), pa.array(d[np.arange(len(d)), group])],
            ["vec_id", "v", "cell", "far"],
        )

    def summary(batch: pa.RecordBatch) -> pa.RecordBatch:
        v = _matrix(batch.column("v"), width)
        d = np.sort(_distances(v, extra_of(v), at, lifted), axis=0)[: k + 1]
        cells = np.tile(np.arange(len(at)), len(d))
        return pa.RecordBatch.from_arrays([pa.array(cells, pa.int32()), pa.array(d.ravel())], ["cell", "d"])

    queries = materialize(common.map_arrow(rows.where(is_query).distinct(), nearest, "vec_id long, v array<long>, cell int, far double"), "queries")
    radius = {r["cell"]: (r["far"], r["n"]) for r in queries.groupBy("cell").agg(F.max("far").alias("far"), F.count("*").alias("n")).collect()}
    # A batch gives k+1 numbers for each pivot; each partition, then all of them, keep the k+1 smallest.
    ranked = F.row_number().over(Window.partitionBy("cell", "part").orderBy("d"))
    near = common.map_arrow(rows.select("vec_id", "v"), summary, "cell int, d double").withColumn("part", F.spark_partition_id() % 64)
    near = near.withColumn("rk", ranked).where(F.col("rk") <= k + 1).drop("rk", "part")
    near = near.withColumn("rk", F.row_number().over(Window.partitionBy("cell").orderBy("d"))).where(F.col("rk") <= k + 1)
    kth = {r["cell"]: (r["d"], r["n"]) for r in near.groupBy("cell").agg(F.max("d").alias("d"), F.count("*").alias("n")).collect()}
    bound = np.full(len(at), -1.0)
    for cell, (far, _) in radius.items():
        d, n = kth[cell]
        bound[cell] = np.inf if n <= k else (2 * far + d) * (1 + SLACK) + 1e-3

    def needed(batch: pa.RecordBatch) -> pa.RecordBatch:
        v = _matrix(batch.column("v"), width)
        row, cell = np.nonzero(_distances(v, extra_of(v), at, lifted) <= bound[None])
        return pa.RecordBatch.from_arrays(
            [batch.column("vec_id").take(pa.array(row)), batch.column("v").take(pa.array(row)), pa.array(cell, pa.int32())], ["vec_id", "v", "cell"]
        )

    def blocks(sizes: dict[int, int], size: int):
        """How many blocks each cell is dealt to."""
        pairs = [F.lit(x) for cell, n in sorted(sizes.items()) for x in (cell, max(1, -(-n // size)))]
        return F.coalesce(F.element_at(F.create_map(*pairs), F.col("cell")), F.lit(1))

    sent = common.map_arrow(rows, needed, "vec_id long, v array<long>, cell int")
    loads = {r["cell"]: r["count"] for r in sent.groupBy("cell").count().collect()}
    q_blocks, d_blocks = blocks({c: n for c, (_, n) in radius.items()}, QUERY_BLOCK), blocks(loads, DATA_BLOCK)
    hashed = F.xxhash64("vec_id", F.lit(7))
    left = queries.select(
        "vec_id", "v", "cell", F.pmod(hashed, q_blocks).cast("int").alias("qb"), F.explode(F.sequence(F.lit(0), d_blocks - 1)).alias("db")
    )
    right = sent.select(
        "vec_id", "v", "cell", F.explode(F.sequence(F.lit(0), q_blocks - 1)).alias("qb"), F.pmod(hashed, d_blocks).cast("int").alias("db")
    )

    def local(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        names = ["query_id", "vec_id", "score"]
        if a.empty or b.empty:
            return pd.DataFrame({n: pd.Series(dtype="int64") for n in names})
        found = best(a["vec_id"].to_numpy(), np.stack(a["v"]), b["vec_id"].to_numpy(), np.stack(b["v"]), k)
        return pd.DataFrame(found, columns=names).astype("int64")

    keys = ["cell", "qb", "db"]
    partial = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInPandas(local, "query_id long, vec_id long, score long")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    final = partial.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return final.select("query_id", "rank", "vec_id", "score")
