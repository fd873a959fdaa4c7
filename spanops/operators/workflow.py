"""Workflow reconstruction from spans: outcomes, retries, failures and compensation.

All reports combine rows per trace before the shuffle, so a trace with very many spans is still one
partial row per task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from spanops import schema as S
from spanops.functions.scalars import (
    attr,
    charged_amount,
    failure_reason,
    field,
    max_attempts,
    ratio,
)


def _failed(error: Column | None = None) -> Column:
    return F.coalesce(F.col("has_error") if error is None else error, F.lit(False))


def _is(name: str) -> Column:
    return F.col("name") == name


def _order() -> Column:
    """Place in time as one number; a hash of the span id (512 values) settles equal times, then the failed row counts as later.

    Numbers, unlike structs and strings, can be updated in place by the hash aggregate, which then
    needs no sort by trace.
    """
    return F.unix_micros(F.col("timestamp").cast("timestamp")) * 512 + F.pmod(F.xxhash64("span_id"), F.lit(512))


def _last_failed(condition: Column, error: Column | None = None) -> Column:
    """Aggregate: whether the last row in time where ``condition`` holds failed; NULL without such a row."""
    marked = F.max(F.when(condition, _order() * 2 + _failed(error).cast("long")))
    return marked % 2 == 1


def _last(value: Column, condition: Column) -> Column:
    """Aggregate: number of the last row in time where ``condition`` holds."""
    return F.max_by(value, F.when(condition, _order()))


def outcome_aggregates(spans: DataFrame, dim: str = S.TIER_KEY, error: Column | None = None) -> list[Column]:
    """Per-trace aggregates behind ``workflow_outcome``; also used on streams with session windows."""
    paid = _is(S.PROCESS_PAYMENT) & ~_failed(error)
    charged = F.coalesce(attr("payment.charged", "number"), charged_amount(attr("order.amount", "number")))
    return [
        *[_last_failed(_is(name), error).alias(f"_failed{place}") for place, name in enumerate(S.PIPELINE)],
        F.max(field(spans, dim)).alias("tier"),
        F.count(F.lit(1)).alias("spans"),
        _last(attr("fraud.score", "number"), _is(S.CHECK_FRAUD) & ~_failed(error)).alias("fraud_score"),
        _last(charged, paid).alias("total_charged"),
        F.max(F.when(_is(S.SCHEDULE_SHIPPING), attr("shipping.eta"))).alias("shipping_eta"),
    ]


def outcome_columns() -> list[Column]:
    """Status and order result over the aggregates of ``outcome_aggregates``."""
    failed = [F.col(f"_failed{place}") for place in range(len(S.PIPELINE))]
    # The furthest step decides: its flag is the first that is there, from the end.
    stuck = F
    for name, flag in reversed(list(zip(S.PIPELINE, failed))):
        state = F.when(flag, F.lit("failed:" + name.removeprefix(S.ACTIVITY_PREFIX))).otherwise(F.lit("in_flight"))
        stuck = stuck.when(flag.isNotNull(), state)
    untried = failed[S.PIPELINE.index(S.PROCESS_PAYMENT)].isNull()
    status = (
        F.when(~failed[-1], "completed")
        .when((F.col("fraud_score") > 0.8) & untried, "rejected_fraud")
        .otherwise(stuck.otherwise(F.lit("in_flight")))
    )
    return [
        F.col("trace_id"),
        F.col("tier"),
        F.col("spans"),
        status.alias("status"),
        F.round("total_charged", 2).alias("total_charged"),
        F.round("fraud_score", 4).alias("fraud_score"),
        F.col("shipping_eta"),
    ]


def workflow_outcome(spans: DataFrame, dim: str = S.TIER_KEY, error: Column | None = None) -> DataFrame:
    """One row per workflow with its final status, charge, fraud score and promised delivery.

    ``error`` says when a span failed (default: its ``has_error``). For activities that fail without setting it pass
    ``attribute_error()``, here and in the other reports of this module.
    """
    return spans.groupBy("trace_id").agg(*outcome_aggregates(spans, dim, error)).select(*outcome_columns())


def attempts(spans: DataFrame, dim: str = S.TIER_KEY, error: Column | None = None) -> DataFrame:
    """One row per workflow and activity: attempts, whether the last one failed, and the workflow's tier."""
    known = spans.where(F.col("name").isin(*S.PIPELINE))
    steps = known.groupBy("trace_id", "name", field(spans, dim).alias("_tier")).agg(
        F.count(F.lit(1)).alias("attempts"), F.max(_order() * 2 + _failed(error).cast("long")).alias("_last")
    )
    # Few rows per workflow are left: one per activity and tier.
    tiered = steps.withColumn("tier", F.max("_tier").over(Window.partitionBy("trace_id")))
    return tiered.groupBy("trace_id", "name", "tier").agg(
        F.sum("attempts").alias("attempts"), (F.max("_last") % 2 == 1).alias("last_failed")
    )


def retry_attempts(spans: DataFrame, dim: str = S.TIER_KEY, error: Column | None = None) -> DataFrame:
    """Attempts per tier and activity against the tier's permitted number."""
    rows = attempts(spans, dim, error).withColumn("allowed", max_attempts(F.col("tier")))
    exhausted = F.col("last_failed") & (F.col("attempts") >= F.col("allowed"))
    out = rows.groupBy(F.coalesce("tier", F.lit("")).alias("tier"), F.col("name").alias("activity")).agg(
        F.count(F.lit(1)).alias("workflows"),
        F.sum("attempts").alias("attempts"),
        F.max("attempts").alias("most_attempts"),
        F.max("allowed").cast("long").alias("max_attempts"),
        F.count_if(F.col("attempts") > 1).alias("retried"),
        F.count_if(exhausted).alias("exhausted"),
        F.round(ratio(F.count_if(exhausted), F.count(F.lit(1))) * 100, 2).alias("exhausted_pct"),
    )
    return out.orderBy("tier", "activity")


def failure_reasons(spans: DataFrame, dim: str = S.TIER_KEY) -> DataFrame:
    """Failures by activity, stated reason and tier."""
    reason = failure_reason()
    rows = spans.where(reason.isNotNull()).groupBy(
        F.col("name").alias("activity"), reason.alias("reason"), F.coalesce(field(spans, dim), F.lit("")).alias("tier")
    )
    return rows.agg(F.count(F.lit(1)).alias("failures")).orderBy(F.desc("failures"), "activity", "reason", "tier")


def compensation_audit(spans: DataFrame, error: Column | None = None) -> DataFrame:
    """Workflows whose payment needed undoing, or was undone without need.

    ``refunded`` / ``missing_refund``: the inventory step failed for good, with / without a refund.
    ``refund_without_failure``: refunded although inventory did not fail.
    ``charged_not_refunded``: shipping failed for good after the payment; nothing compensates that.
    """
    refund, payment = _is(S.REFUND_PAYMENT), _is(S.PROCESS_PAYMENT)
    inventory, shipping = _is(S.RESERVE_INVENTORY), _is(S.SCHEDULE_SHIPPING)
    flags = spans.groupBy("trace_id").agg(
        F.coalesce(_last_failed(inventory, error), F.lit(False)).alias("inventory_failed"),
        F.coalesce(_last_failed(shipping, error), F.lit(False)).alias("shipping_failed"),
        F.coalesce(F.max(refund), F.lit(False)).alias("refunded"),
        F.coalesce(F.max(payment & ~_failed(error)), F.lit(False)).alias("paid"),
    )
    audit = (
        F.when(F.col("inventory_failed") & F.col("refunded"), "refunded")
        .when(F.col("inventory_failed"), "missing_refund")
        .when(F.col("refunded"), "refund_without_failure")
        .when(F.col("shipping_failed") & F.col("paid"), "charged_not_refunded")
    )
    return flags.select("trace_id", audit.alias("audit"), "paid").where(F.col("audit").isNotNull())
