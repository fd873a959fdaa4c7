"""Registration of queries with their comparison SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from checks import views
from spanops.session import configure

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}

_VIEWS = {
    "spans": views.SPANS_SQL,
    "logs": views.LOGS_SQL,
    "orders_in": views.ORDERS_IN_SQL,
    "workflow": views.WORKFLOW_SQL,
    "metrics": views.METRICS_SQL,
}

# Tier to target as SQL, in the same floating point as the Spark side.
TARGET = (
    "CASE tier WHEN 'enterprise' THEN CAST(0.999 AS DOUBLE) WHEN 'pro' THEN CAST(0.995 AS DOUBLE) "
    "ELSE CAST(0.99 AS DOUBLE) END"
)


def over(*names: str, body: str) -> str:
    """SQL over derived views; ``body`` may go on with common tables of its own after a comma."""
    return "WITH " + ",".join(_VIEWS[name] for name in names) + body


def register(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def add(build: Query) -> Query:
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            configure(spark)
            return plain(build(spark, sf_dir))

        QUERIES[name] = run
        if sql is not None:
            ORACLES[name] = sql
        return build

    return add


def plain(df: DataFrame) -> DataFrame:
    """Times without zone, as the comparison engine returns them."""
    return df.select(
        *[F.col(c).cast("timestamp_ntz").alias(c) if t == "timestamp" else F.col(c) for c, t in df.dtypes]
    )


def spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.spans(views.table(spark, sf_dir, "events"))


def logs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.logs(views.table(spark, sf_dir, "events"))


def metric_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.metric_points(views.table(spark, sf_dir, "events"))


def orders_in(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.orders_in(views.table(spark, sf_dir, "orders"))


def workflow_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.workflow_spans(views.table(spark, sf_dir, "orders"))
