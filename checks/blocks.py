"""Building blocks: filters, scalars, aggregates and grouping, each in a query of its own."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks import views
from checks.registry import TARGET, logs, orders_in, over, register, spans
from spanops.functions import predicates as P, scalars as X
from spanops.functions.quantiles import group_stats
from spanops.operators import correlate

NEWEST = "(SELECT max(timestamp) FROM spans)"
TIER = "customer.tier"
START, END = "2024-01-05 00:00:00", "2024-01-20 12:00:00"


def _filtered(name: str, condition, where_sql: str) -> None:
    """A query that keeps the spans meeting one predicate."""

    @register(name, over("spans", body=f" SELECT span_id, timestamp, name FROM spans WHERE {where_sql}"))
    def run(spark, sf_dir):
        s = spans(spark, sf_dir)
        return s.where(condition(s)).select("span_id", "timestamp", "name")


_filtered(
    "f_lookback",
    lambda s: P.lookback(s, "7 days", P.latest(s)),
    f"timestamp >= {NEWEST} - INTERVAL 7 DAY AND timestamp <= {NEWEST}",
)
_filtered("f_between", lambda s: P.between(s, START, END), f"timestamp BETWEEN TIMESTAMP '{START}' AND TIMESTAMP '{END}'")
_filtered(
    "f_bucket_prune",
    lambda s: P.bucket_prune(s, START, END),
    f"ts_bucket_start BETWEEN epoch(TIMESTAMP '{START}') - 1800 AND epoch(TIMESTAMP '{END}')",
)
_filtered("f_prefix", lambda s: P.name_prefix("activity.check"), "name LIKE 'activity.check%'")
_filtered("f_equals", lambda s: P.equals(s, TIER, "pro") & P.equals(s, "serviceName", "temporal-worker"),
          "tier = 'pro' AND serviceName = 'temporal-worker'")
_filtered("f_attr_nonempty", lambda s: P.attr_nonempty(s.drop("customer_tier"), TIER), "tier <> ''")
_filtered("f_attr_exists", lambda s: P.attr_exists(s.drop("customer_tier"), TIER), "tier IS NOT NULL")
_filtered("f_contains", lambda s: P.contains("name", "check_fraud"), "name LIKE '%check_fraud%'")
_filtered("f_duration_over", lambda s: P.slower_than(1000), "duration_nano / 1000000 > 1000")


@register("having_min_count", over("spans", body="""
SELECT name, tier, count(*) AS n FROM spans WHERE tier IS NOT NULL GROUP BY name, tier HAVING count(*) >= 480"""))
def having_min_count(spark, sf_dir):
    s = spans(spark, sf_dir).where("customer_tier IS NOT NULL")
    return s.groupBy("name", F.col("customer_tier").alias("tier")).agg(F.count("*").alias("n")).where("n >= 480")


@register("having_errors", over("spans", body="""
SELECT name, trace_id, count(*) FILTER (WHERE has_error) AS error_spans FROM spans
GROUP BY name, trace_id HAVING count(*) FILTER (WHERE has_error) > 0"""))
def having_errors(spark, sf_dir):
    counted = spans(spark, sf_dir).groupBy("name", "trace_id").agg(F.count_if("has_error").alias("error_spans"))
    return counted.where("error_spans > 0")


def _projected(name: str, select, select_sql: str) -> None:
    """A query that computes scalar columns for every span."""

    @register(name, over("spans", body=f" SELECT span_id, {select_sql} FROM spans"))
    def run(spark, sf_dir):
        s = spans(spark, sf_dir)
        return s.select("span_id", *select(s))


_projected(
    "attr_get",
    lambda s: [
        X.attr(TIER).alias("tier"),
        X.attr("customer.id").alias("customer_id"),
        X.attr("fraud.score", "number").alias("fraud_score"),
    ],
    "tier, customer_id, fraud_score",
)
_projected(
    "ns_to_ms",
    lambda s: [F.round(X.ns_to_ms(F.col("duration_nano")), 2).alias("ms")],
    "round(duration_nano / 1000000, 2) AS ms",
)
_projected("to_double", lambda s: [F.col("duration_nano").cast("double").alias("d")], "CAST(duration_nano AS DOUBLE) AS d")
_projected(
    "null_if",
    lambda s: [F.round(X.ratio(F.col("duration_nano"), F.length("name") % 3), 3).alias("guarded")],
    "round(CAST(duration_nano AS DOUBLE) / nullif(length(name) % 3, 0), 3) AS guarded",
)
_projected(
    "case_label",
    lambda s: [
        X.threshold_label(
            [(F.col("duration_nano") > 1e9, "!", "SLOW"), (F.col("duration_nano") > 1e8, "?", "FAIR")], ("", "FAST")
        ).alias("label")
    ],
    "CASE WHEN duration_nano > 1e9 THEN 'SLOW' WHEN duration_nano > 1e8 THEN 'FAIR' ELSE 'FAST' END AS label",
)
_projected(
    "time_bucket",
    lambda s: [
        X.bucket_start(F.col("timestamp"), "5 minutes").alias("five"),
    ],
    "time_bucket(INTERVAL '5 minutes', timestamp) AS five",
)
_projected("slo_target", lambda s: [X.slo_target(F.col("customer_tier")).alias("target")], f"{TARGET} AS target")
_projected(
    "fraud_decision",
    lambda s: [
        F.when(X.attr("fraud.score", "number").isNotNull(), X.fraud_decision(X.attr("fraud.score", "number"))).alias("decision")
    ],
    """CASE WHEN fraud_score IS NULL THEN NULL WHEN fraud_score > 0.8 THEN 'reject'
       WHEN fraud_score > 0.5 THEN 'review' ELSE 'approve' END AS decision""",
)
_projected(
    "resource_upsert",
    lambda s: [
        X.resource_upsert(F.col("resource"))["deployment.environment"].alias("environment"),
        X.resource_upsert(F.col("resource"))["service.name"].alias("service"),
        F.size(X.resource_upsert(F.col("resource"))).alias("entries"),
    ],
    "'production' AS environment, serviceName AS service, 2 AS entries",
)


@register("slo_targets_join", over("spans", body=f" SELECT span_id, tier, {TARGET} AS target FROM spans"))
def slo_targets_join(spark, sf_dir):
    config = spark.createDataFrame([("enterprise", 0.999), ("pro", 0.995)], "tier string, target double")
    joined = X.with_slo_target(spans(spark, sf_dir), "customer_tier", config)
    return joined.select("span_id", F.col("customer_tier").alias("tier"), F.col("slo_target").alias("target"))


@register("charged_amount", over("orders_in", body=" SELECT order_id, round(amount * 1.08, 4) AS charged FROM orders_in"))
def charged_amount(spark, sf_dir):
    return orders_in(spark, sf_dir).select("order_id", F.round(X.charged_amount(F.col("amount")), 4).alias("charged"))


@register("shipping_eta", over("orders_in", body="""
SELECT order_id, strftime(received + CASE customer_tier WHEN 'enterprise' THEN INTERVAL 24 HOUR
  WHEN 'pro' THEN INTERVAL 48 HOUR ELSE INTERVAL 120 HOUR END, '%Y-%m-%d') AS eta FROM orders_in"""))
def shipping_eta(spark, sf_dir):
    orders = views.table(spark, sf_dir, "orders")
    picked = F.when(F.col("o_custkey") % 3 == 0, "enterprise").when(F.col("o_custkey") % 3 == 1, "pro").otherwise("free")
    eta = X.shipping_eta(F.col("o_orderdate"), picked)
    return orders.select(F.col("o_orderkey").cast("string").alias("order_id"), eta.alias("eta"))


@register("retry_schedule", over("orders_in", body="""
, policy AS (
  SELECT order_id, customer_tier,
    CASE customer_tier WHEN 'enterprise' THEN 500 WHEN 'pro' THEN 1000 ELSE 2000 END AS first_ms,
    CASE customer_tier WHEN 'enterprise' THEN CAST(1.5 AS DOUBLE) ELSE CAST(2.0 AS DOUBLE) END AS factor,
    CASE customer_tier WHEN 'enterprise' THEN 4 WHEN 'pro' THEN 2 ELSE 1 END AS retries FROM orders_in),
numbered AS (SELECT *, CAST(unnest(generate_series(1, retries)) AS INTEGER) AS retry FROM policy)
SELECT order_id, customer_tier, retry, round(first_ms * pow(factor, retry - 1), 3) AS wait_ms,
  round(first_ms * (pow(factor, retry) - 1) / (factor - 1), 3) AS total_wait_ms FROM numbered"""))
def retry_schedule(spark, sf_dir):
    rows = X.retry_schedule(orders_in(spark, sf_dir))
    waits = [F.round(c, 3).alias(c) for c in ("wait_ms", "total_wait_ms")]
    return rows.select("order_id", "customer_tier", "retry", *waits)


@register("workflow_key", over("orders_in", body=" SELECT order_id, 'order-' || order_id AS workflow_id FROM orders_in"))
def workflow_key(spark, sf_dir):
    return orders_in(spark, sf_dir).select("order_id", X.workflow_key(F.col("order_id")).alias("workflow_id"))


@register("effective_error", over("spans", "logs", body="""
, bad AS (SELECT DISTINCT trace_id, span_id FROM logs WHERE severity_text IN ('ERROR', 'WARN') AND span_id <> '')
SELECT s.span_id, s.name, s.has_error, s.has_error OR s.reason IS NOT NULL OR b.span_id IS NOT NULL AS effective_error
FROM spans s LEFT JOIN bad b ON s.trace_id = b.trace_id AND s.span_id = b.span_id"""))
def effective_error(spark, sf_dir):
    rows = correlate.effective_error(spans(spark, sf_dir), logs(spark, sf_dir))
    return rows.select("span_id", "name", "has_error", "effective_error")


def _grouped(name: str, columns, select_sql: str, group: bool = True) -> None:
    """A query that aggregates spans by activity, or all of them."""
    tail = "SELECT name, " + select_sql + " FROM spans GROUP BY name" if group else "SELECT " + select_sql + " FROM spans"

    @register(name, over("spans", body=" " + tail))
    def run(spark, sf_dir):
        s = spans(spark, sf_dir)
        return (s.groupBy("name") if group else s).agg(*columns())


_grouped("agg_count", lambda: [F.count("*").alias("n")], "count(*) AS n")
_grouped("agg_avg", lambda: [F.round(F.avg("duration_nano") / 1e6, 3).alias("avg_ms")], "round(avg(duration_nano) / 1e6, 3) AS avg_ms")
_grouped(
    "agg_stddev_pop",
    lambda: [F.round(F.stddev_pop("duration_nano") / 1e6, 3).alias("stddev_ms")],
    "round(stddev_pop(duration_nano) / 1e6, 3) AS stddev_ms",
)
_grouped("agg_count_if", lambda: [F.count_if("has_error").alias("errors")], "count(*) FILTER (WHERE has_error) AS errors")
_grouped(
    "agg_rate_pct",
    lambda: [F.round(X.rate_pct(F.col("has_error")), 2).alias("error_pct")],
    "round(count(*) FILTER (WHERE has_error) * CAST(100 AS DOUBLE) / count(*), 2) AS error_pct",
)
_grouped("agg_count_distinct", lambda: [F.countDistinct("trace_id").alias("traces")], "count(DISTINCT trace_id) AS traces")
_grouped(
    "agg_global",
    lambda: [
        F.count("*").alias("n"),
        F.round(F.avg("duration_nano") / 1e6, 3).alias("avg_ms"),
        F.max("duration_nano").alias("slowest"),
    ],
    "count(*) AS n, round(avg(duration_nano) / 1e6, 3) AS avg_ms, max(duration_nano) AS slowest",
    group=False,
)

_THREE = {"p50": 0.5, "p95": 0.95, "p99": 0.99}


def _quantiles(spark, sf_dir, **options):
    stats = group_stats(spans(spark, sf_dir), {"name": F.col("name")}, F.col("duration_nano"), _THREE, **options)
    return stats.select("name", *[F.round(F.col(q) / 1e6, 2).alias(q) for q in _THREE])


_QUANTILES_SQL = over("spans", body=" SELECT name, " + ", ".join(
    f"round(quantile_cont(duration_nano, {p}) / 1e6, 2) AS {q}" for q, p in _THREE.items()
) + " FROM spans GROUP BY name")


@register("agg_quantile", _QUANTILES_SQL)
def agg_quantile(spark, sf_dir):
    return _quantiles(spark, sf_dir)


@register("agg_quantile_ranges", _QUANTILES_SQL)
def agg_quantile_ranges(spark, sf_dir):
    """The exact mode as it runs on groups too large for one buffer."""
    return _quantiles(spark, sf_dir, group_rows=0)


def _within(spark, sf_dir, mode, bound):
    """Whether the estimate of each group lies between the exact quantiles ``bound`` below and above."""
    rows, points = spans(spark, sf_dir), {"p50": 0.5, "p99": 0.99}
    keys = {"name": F.col("name")}
    around = {f"{q}_{side}": min(1.0, max(0.0, p + d)) for q, p in points.items() for side, d in (("lo", -bound), ("hi", bound))}
    exact = group_stats(rows, keys, F.col("duration_nano"), around, [F.count("*").alias("n")])
    guess = group_stats(rows, keys, F.col("duration_nano"), points, mode=mode)
    inside = [F.col(q).between(F.col(f"{q}_lo"), F.col(f"{q}_hi")).alias(f"{q}_within") for q in points]
    return exact.join(guess, "name").select("name", "n", *inside)


_WITHIN_SQL = over("spans", body=" SELECT name, count(*) AS n, true AS p50_within, true AS p99_within FROM spans GROUP BY name")


@register("agg_quantile_approx", _WITHIN_SQL)
def agg_quantile_approx(spark, sf_dir):
    return _within(spark, sf_dir, "approx", 0.01)


@register("agg_quantile_kll", _WITHIN_SQL)
def agg_quantile_kll(spark, sf_dir):
    return _within(spark, sf_dir, "kll", 0.03)


@register("agg_by_key", over("spans", body="""
SELECT time_bucket(INTERVAL '1 day', timestamp) AS ts, name, tier, count(*) AS n FROM spans GROUP BY 1, 2, 3"""))
def agg_by_key(spark, sf_dir):
    day = X.bucket_start(F.col("timestamp"), "1 day").alias("ts")
    s = spans(spark, sf_dir).select(day, "name", F.col("customer_tier").alias("tier"))
    return s.groupBy("ts", "name", "tier").agg(F.count("*").alias("n"))


@register("multi_agg", over("spans", body="""
SELECT name, count(*) AS n, round(avg(duration_nano) / 1e6, 2) AS avg_ms, round(stddev_pop(duration_nano) / 1e6, 2) AS std_ms,
  count(*) FILTER (WHERE has_error) AS errors, round(quantile_cont(duration_nano, 0.5) / 1e6, 2) AS p50_ms,
  round(quantile_cont(duration_nano, 0.99) / 1e6, 2) AS p99_ms FROM spans GROUP BY name"""))
def multi_agg(spark, sf_dir):
    plain = [
        F.count("*").alias("n"),
        F.round(F.avg("duration_nano") / 1e6, 2).alias("avg_ms"),
        F.round(F.stddev_pop("duration_nano") / 1e6, 2).alias("std_ms"),
        F.count_if("has_error").alias("errors"),
    ]
    stats = group_stats(
        spans(spark, sf_dir), {"name": F.col("name")}, F.col("duration_nano"), {"p50": 0.5, "p99": 0.99}, plain
    )
    rounded = [F.round(F.col(q) / 1e6, 2).alias(f"{q}_ms") for q in ("p50", "p99")]
    return stats.select("name", "n", "avg_ms", "std_ms", "errors", *rounded)
