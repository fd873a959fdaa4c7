"""From raw documents to token ids: quality rules, near copies, secrets, mixing, encoding.

Every stage works on all rows that its predecessor kept, and is written as Parquet in the shared folder before the next one
reads it, so a lost executor costs tasks, not stages. All stages but the last return the columns of ``documents``, extra ones included.

Defined results: a null or empty text has too few words and goes with the quality rules. Of rows with the same id and text one stays (where other columns differ, the first as JSON text), and one of each
class of near copies: the smallest id, null ids last, then the smallest hash of the text. Secrets are masked in the text, and
``n_chars``, where there is one, follows. A document whose rate is over 1 comes out more than once, equal rows alike; without labels
of two domains every rate is 1, and without labelled documents of both qualities the base rule alone decides. An empty table
gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from spanops.llm import common, linecrf, mixing, partenum, pieces, secretscan
from spanops.session import materialize


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that fail the base rule, or are mostly boilerplate, go."""
    return linecrf.keep_good(docs, common.table(spark, sf_dir, "labels"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document stays of each class linked by 0.8 of the five-word shingles."""
    return partenum.keep_one(docs, pct=80, size=5)


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are masked; every document stays."""
    return secretscan.redact_secrets(docs)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents are repeated or left out so that the domains' tokens match the targets."""
    return mixing.mix(docs, common.table(spark, sf_dir, "labels"))


def encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document."""
    return pieces.encode(docs)


STAGES = [
    ("quality rules", quality_rules),
    ("n-gram Jaccard join", near_duplicates),
    ("secret scans", secret_scan),
    ("mixing sources to target weights", mixture),
    ("SentencePiece encoding and decoding", encoding),
]

# The stages use trained models and a tokenizer, which SQL cannot state.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; the last one's rows."""
    docs = common.table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), "stage")
    return STAGES[-1][1](spark, docs, sf_dir)
