"""The queries of this package over the given tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from spanops.llm import (
    bwtdedup, common, lexsearch, linecrf, mixing, partenum, pieces, pst, rangecoder, runs, secretscan, separators, toxicity, voronoi,
)

Query = Callable[[SparkSession, str], DataFrame]


def _docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return common.table(spark, sf_dir, "documents")


def op1_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bwtdedup.dedup(_docs(spark, sf_dir)).drop("spans")


def op2_suffix_tree_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pst.score(_docs(spark, sf_dir))


def op3_partenum_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return partenum.link_classes(_docs(spark, sf_dir))


def op4_soft_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.rates(_docs(spark, sf_dir), common.table(spark, sf_dir, "labels"))


def op5_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rangecoder.stored(_docs(spark, sf_dir))


def op6_line_crf(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linecrf.quality(_docs(spark, sf_dir), common.table(spark, sf_dir, "labels"))


def op7_voronoi_knn(spark: SparkSession, sf_dir: str) -> DataFrame:
    return voronoi.top_k(common.table(spark, sf_dir, "embeddings"))


def op8_streaming_viterbi(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.encode(_docs(spark, sf_dir))


def op9_separator_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return separators.token_counts(_docs(spark, sf_dir))


def op10_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secretscan.scan(_docs(spark, sf_dir))


def op11_noisy_channel(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.scores(_docs(spark, sf_dir), common.table(spark, sf_dir, "labels"))


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return runs.periodic_runs(_docs(spark, sf_dir), runs.planted_repeats).drop("runs")


def op13_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexsearch.search(_docs(spark, sf_dir), common.table(spark, sf_dir, "benchmark"))


QUERIES: dict[str, Query] = {
    f.__name__: f
    for f in (
        op1_suffix_dedup, op2_suffix_tree_score, op3_partenum_join, op4_soft_mixing, op5_token_files, op6_line_crf,
        op7_voronoi_knn, op8_streaming_viterbi, op9_separator_scan, op10_secret_scan, op11_noisy_channel,
        op12_periodic_runs, op13_lexical_search,
    )
}

ORACLES: dict[str, str] = {
    "op7_voronoi_knn": """
WITH good AS (
  SELECT vec_id, list_transform(embedding, x -> CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
  FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, x -> x IS NULL OR NOT isfinite(x))) = 0
), scored AS (
  SELECT q.vec_id AS query_id, c.vec_id,
    CAST(list_sum(list_transform(list_zip(q.v, c.v), p -> p[1] * p[2])) AS BIGINT) AS score
  FROM good q JOIN good c ON c.vec_id <> q.vec_id WHERE q.vec_id % 50 = 0
)
SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score
FROM scored QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) <= 5
""",
    "op13_lexical_search": r"""
WITH docs AS (
  SELECT row_number() OVER () AS r, doc_id,
    regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS w
  FROM documents
), items AS (
  SELECT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS t
  FROM (SELECT DISTINCT item_id, text FROM benchmark)
), asked AS (
  SELECT item_id, t, count(*) AS qtf FROM items GROUP BY item_id, t
), total AS (
  SELECT count(*) FILTER (WHERE len(w) > 0) AS n_docs, CAST(sum(len(w)) AS BIGINT) AS n_terms FROM docs
), counts AS (
  SELECT r, doc_id, n, t, count(*) AS tf FROM (SELECT r, doc_id, len(w) AS n, unnest(w) AS t FROM docs) WHERE t IN (SELECT t FROM asked) GROUP BY r, doc_id, n, t
), weights AS (
  SELECT t, CAST(floor(1000 * ln((2 * n_docs + 2) / (2 * df + 1))) AS BIGINT) AS w
  FROM (SELECT t, count(*) AS df FROM counts GROUP BY t), total
), scored AS (
  SELECT item_id, r, doc_id, CAST(sum(qtf * w * ((1000000000 * tf) // (1000 * tf + 8 * (25 + (75 * n * n_docs) // n_terms)))) AS BIGINT) AS score
  FROM asked JOIN counts USING (t) JOIN weights USING (t), total GROUP BY item_id, r, doc_id
)
SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank, doc_id, score
FROM scored WHERE score > 0 QUALIFY row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) <= 10
""",
}
