"""Scalar expressions shared by the operators."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, functions as F

from spanops import schema as S


def field(df: DataFrame, name: str, context: str | None = None) -> Column:
    """Resolve a field name: promoted column, plain column, else a key of the attribute maps.

    ``context`` narrows the lookup to ``span`` (columns), ``attribute`` or ``resource``.
    """
    if context == "resource":
        return F.col("resource")[name]
    if context != "span" and name in S.PROMOTED and S.PROMOTED[name] in df.columns:
        return F.col(S.PROMOTED[name])
    if context != "attribute" and name in df.columns:
        return F.col(name)
    if "attributes_string" in df.columns:
        return F.col("attributes_string")[name]
    return F.col("attributes")[name]


def attr(key: str, kind: str = "string") -> Column:
    """Value of an attribute; NULL where the key is absent."""
    return F.col(f"attributes_{kind}")[key]


def ns_to_ms(nanos: Column) -> Column:
    return nanos / F.lit(1000000)


def ratio(top: Column, bottom: Column) -> Column:
    """Division as doubles that is NULL at a zero divisor."""
    return F.try_divide(top.cast("double"), F.nullif(bottom.cast("double"), F.lit(0.0)))


def rate_pct(predicate: Column) -> Column:
    """Aggregate: share of rows where ``predicate`` holds, in percent."""
    return F.try_divide(F.count_if(predicate) * F.lit(100.0), F.count(F.lit(1)))


def bucket_start(timestamp: Column, width: str, slide: str | None = None) -> Column:
    """Start of the fixed (or sliding) interval a timestamp falls in; rows without one are dropped."""
    return F.window(timestamp, width, slide).getField("start")


def interval(text: str) -> Column:
    """A literal interval such as ``30 minutes``."""
    return F.expr(f"INTERVAL {text}")


def threshold_label(
    rules: Sequence[tuple[Column, str, str]], default: tuple[str, str], icons: bool = False
) -> Column:
    """First label whose condition holds; a NULL condition never does. With ``icons`` the sign leads."""

    def text(icon: str, label: str) -> Column:
        return F.lit(f"{icon} {label}" if icons else label)

    out = None
    for condition, icon, label in rules:
        out = F.when(condition, text(icon, label)) if out is None else out.when(condition, text(icon, label))
    return out.otherwise(text(*default))


def lookup(key: Column, values: Mapping[str, object], default: object) -> Column:
    """Value configured for ``key``, or the default; a handful of entries, so no join is needed."""
    out = None
    for name, value in values.items():
        hit = key == F.lit(name)
        out = F.when(hit, F.lit(value)) if out is None else out.when(hit, F.lit(value))
    return F.lit(default) if out is None else out.otherwise(F.lit(default))


def slo_target(
    tier: Column,
    targets: Mapping[str, float] = S.SLO_TARGETS,
    default: float = S.DEFAULT_SLO_TARGET,
) -> Column:
    return lookup(tier, targets, default)


def with_slo_target(df: DataFrame, tier: str, targets: DataFrame, default: float = S.DEFAULT_SLO_TARGET) -> DataFrame:
    """Attach ``slo_target`` from a (tier, target) table; the planner broadcasts it by its size."""
    config = targets.select(F.col("tier").alias("_tier"), F.col("target").alias("_target"))
    joined = df.join(config, F.col(tier) == F.col("_tier"), "left")
    return joined.withColumn("slo_target", F.coalesce("_target", F.lit(default))).drop("_tier", "_target")


def _policy(tier: Column, position: int) -> Column:
    values = {name: row[position] for name, row in S.TIER_POLICY.items()}
    return lookup(tier, values, S.DEFAULT_TIER_POLICY[position])


def max_attempts(tier: Column) -> Column:
    return _policy(tier, 2)


def fraud_decision(score: Column) -> Column:
    return F.when(score > 0.8, F.lit("reject")).when(score > 0.5, F.lit("review")).otherwise(F.lit("approve"))


def charged_amount(amount: Column) -> Column:
    """Order amount with the 8 % surcharge; not rounded."""
    return amount * F.lit(1.08)


def shipping_eta(start: Column, tier: Column) -> Column:
    """Promised delivery day by tier, as text."""
    hours = _policy(tier, 3)
    return F.date_format(start + F.make_dt_interval(F.lit(0), hours), "yyyy-MM-dd")


def retry_schedule(orders: DataFrame, tier: str = "customer_tier") -> DataFrame:
    """One row per permitted retry with the wait before it, in ms, and the wait summed up to it."""
    first, factor = _policy(F.col(tier), 0), _policy(F.col(tier), 1)
    retries = _policy(F.col(tier), 2) - 1
    numbered = orders.withColumn("retry", F.explode(F.sequence(F.lit(1), retries)))
    power = F.pow(factor, F.col("retry") - 1)
    total = first * (F.pow(factor, F.col("retry")) - 1) / (factor - 1)
    return numbered.withColumn("wait_ms", first * power).withColumn("total_wait_ms", total)


def workflow_key(order_id: Column) -> Column:
    return F.concat(F.lit("order-"), order_id)


def resource_upsert(resource: Column, key: str = "deployment.environment", value: str = "production") -> Column:
    """Set one key of the resource map, replacing an earlier value."""
    kept = F.map_filter(F.coalesce(resource, F.create_map().cast("map<string,string>")), lambda k, _: k != key)
    return F.map_concat(kept, F.create_map(F.lit(key), F.lit(value)))


def failure_reason() -> Column:
    """First failure attribute of the span, or NULL."""
    return F.coalesce(*[attr(key) for key in S.FAILURE_KEYS])


def attribute_error() -> Column:
    """True where the span reports an error itself or carries a failure attribute."""
    flags = [F.coalesce(F.map_contains_key("attributes_string", key), F.lit(False)) for key in S.FAILURE_KEYS]
    out = F.coalesce(F.col("has_error"), F.lit(False))
    for flag in flags:
        out = out | flag
    return out


def epoch_nanos(timestamp: Column) -> Column:
    """Whole nanoseconds since the epoch of a microsecond timestamp."""
    return F.unix_micros(timestamp.cast("timestamp")) * F.lit(1000)


def message_template(text: Column) -> Column:
    """Log body with ids and numbers masked, so that messages of one kind group together."""
    masked = F.regexp_replace(text, r"\b[0-9a-fA-F]{8}(-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}\b", "<id>")
    masked = F.regexp_replace(masked, r"\b[0-9a-fA-F]{16,32}\b", "<id>")
    return F.regexp_replace(masked, r"[0-9]+(\.[0-9]+)?", "<n>")
