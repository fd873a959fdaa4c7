"""Discovery and search over spans and logs: the functions an investigation starts with."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, functions as F

from spanops import schema as S
from spanops.functions.predicates import lookback
from spanops.functions.quantiles import group_stats, match_groups
from spanops.functions.scalars import bucket_start, epoch_nanos, field, message_template, ns_to_ms, rate_pct
from spanops.operators.correlate import span_depths

DURATION = "duration_nano"

# Quantile aggregations by name.
QUANTILES = {"p50": 0.50, "p95": 0.95, "p99": 0.99}


def _condition(condition: Column | str) -> Column:
    return F.expr(condition) if isinstance(condition, str) else condition


def _narrow(
    rows: DataFrame, where: Column | str | None, window: str | None, as_of: object | None, service: str | None
) -> DataFrame:
    out = rows
    if window is not None:
        out = out.where(lookback(rows, window, as_of))
    if service is not None:
        out = out.where(F.col("serviceName") == service)
    return out if where is None else out.where(_condition(where))


def _failed(error: Column | None = None) -> Column:
    return F.coalesce(F.col("has_error") if error is None else error, F.lit(False))


def list_services(
    spans: DataFrame,
    *,
    window: str | None = None,
    as_of: object | None = None,
    quantile_mode: str = "exact",
    error: Column | None = None,
) -> DataFrame:
    """Services with their span count, error share and P99."""
    rows = _narrow(spans, None, window, as_of, None)
    stats = group_stats(
        rows,
        {"service": F.col("serviceName")},
        F.col(DURATION),
        {"_p99": 0.99},
        [F.count(F.lit(1)).alias("spans"), F.round(rate_pct(_failed(error)), 2).alias("error_rate_pct")],
        quantile_mode,
    )
    out = stats.select("service", "spans", "error_rate_pct", F.round(ns_to_ms(F.col("_p99")), 2).alias("p99_ms"))
    return out.orderBy(F.desc("spans"), "service")


def top_operations(
    spans: DataFrame,
    service: str,
    limit: int | None = 10,
    *,
    window: str | None = None,
    as_of: object | None = None,
    quantile_mode: str = "exact",
    error: Column | None = None,
) -> DataFrame:
    """Busiest span names of a service with latency quantiles and errors."""
    rows = _narrow(spans, None, window, as_of, service)
    stats = group_stats(
        rows,
        {"operation": F.col("name")},
        F.col(DURATION),
        {f"_{name}": p for name, p in QUANTILES.items()},
        [F.count(F.lit(1)).alias("calls"), F.count_if(_failed(error)).alias("errors")],
        quantile_mode,
    )
    columns = [F.round(ns_to_ms(F.col(f"_{name}")), 2).alias(f"{name}_ms") for name in QUANTILES]
    out = stats.select("operation", "calls", "errors", *columns).orderBy(F.desc("calls"), "operation")
    return out if limit is None else out.limit(limit)


def field_keys(signal: DataFrame) -> DataFrame:
    """Every field of a table with its context, type and number of rows that have it, in one scan."""
    key, context, kind = "key", "context", "data_type"

    def entry(name: Column, where: str, data_type: str) -> Column:
        return F.struct(name.alias(key), F.lit(where).alias(context), F.lit(data_type).alias(kind))

    def entries(names: Column, where: str, data_type: str) -> Column:
        found = F.transform(names, lambda name: entry(name, where, data_type))
        return F.coalesce(found, F.array().cast("array<struct<key:string,context:string,data_type:string>>"))

    lists, plain = [], []
    for column in signal.schema:
        if column.dataType.typeName() == "map":
            where = "resource" if column.name == "resource" else "attribute"
            data_type = column.dataType.valueType.simpleString()
            names = F.map_keys(F.map_filter(F.col(column.name), lambda _, v: v.isNotNull()))
            lists.append(entries(names, where, data_type))
        elif column.name not in S.PROMOTED.values():
            own = entry(F.lit(column.name), "span", column.dataType.simpleString())
            plain.append(F.when(F.col(column.name).isNotNull(), own))
    lists.append(F.array_compact(F.array(*plain)))
    fields = signal.select(F.explode(F.concat(*lists)).alias("field")).select("field.*")
    return fields.groupBy(context, key, kind).agg(F.count(F.lit(1)).alias("rows")).orderBy(context, key, kind)


def field_values(signal: DataFrame, name: str, context: str | None = None) -> DataFrame:
    """Distinct values of a field with their row counts."""
    value = field(signal, name, context).cast("string")
    rows = signal.where(value.isNotNull()).groupBy(value.alias("value")).agg(F.count(F.lit(1)).alias("rows"))
    return rows.orderBy(F.desc("rows"), "value")


def search_traces(
    spans: DataFrame,
    where: Column | str | None = None,
    *,
    window: str | None = None,
    as_of: object | None = None,
    limit: int | None = 5,
) -> DataFrame:
    """Newest matching spans; the condition is a Column or SQL text. Without a limit, all of them."""
    rows = _narrow(spans, where, window, as_of, None)
    newest = rows.orderBy(F.desc("timestamp"), F.desc("span_id"))
    return newest if limit is None else newest.limit(limit)


def _plain_aggregate(aggregation: str, value: Column | None) -> Column:
    if aggregation == "count":
        return F.count(F.lit(1)) if value is None else F.count(value)
    known = {"count_distinct": F.countDistinct, "avg": F.avg, "sum": F.sum, "min": F.min, "max": F.max}
    if aggregation not in known:
        raise ValueError(f"unknown aggregation {aggregation!r}")
    return known[aggregation](value)


def aggregate(
    rows: DataFrame, keys: Mapping[str, Column], aggregations: Mapping[str, tuple[str, Column | None]], quantile_mode: str = "exact"
) -> DataFrame:
    """Named aggregations side by side. All quantiles of one value are one pass, which takes the plain aggregates along; distinct
    counts run apart.

    A distinct count in the same aggregate would first spread every group by the counted value.
    """
    columns = [column.alias(name) for name, column in keys.items()]
    plain = [
        _plain_aggregate(kind, v).alias(n) for n, (kind, v) in aggregations.items() if kind not in QUANTILES and kind != "count_distinct"
    ]
    by_value: dict[str, tuple[Column, dict[str, float]]] = {}
    for name, (kind, value) in aggregations.items():
        if kind in QUANTILES:
            by_value.setdefault(str(value), (value, {}))[1][name] = QUANTILES[kind]
    parts = []
    for value, wanted in by_value.values():
        parts.append(group_stats(rows, keys, value, wanted, plain, quantile_mode))
        plain = []
    if plain:
        parts.append(rows.groupBy(*columns).agg(*plain))
    for name, (kind, value) in aggregations.items():
        if kind == "count_distinct":
            parts.append(rows.groupBy(*columns).agg(F.countDistinct(value).alias(name)))
    out = parts[0]
    for part in parts[1:]:
        if keys:
            out = match_groups(out, part, list(keys))
        else:
            for name in part.columns:
                out = out.withColumn(name, part.select(name).scalar())
    return out.select(*keys, *aggregations)


def aggregate_traces(
    spans: DataFrame,
    aggregation: str = "count",
    aggregate_on: str | None = None,
    *,
    where: Column | str | None = None,
    group_by: Sequence[str] = (),
    request_type: str = "scalar",
    step: str = "1 minute",
    window: str | None = None,
    as_of: object | None = None,
    service: str | None = None,
    quantile_mode: str = "exact",
) -> DataFrame:
    """One aggregation of one field, grouped by fields, as a table or a time series."""
    rows = _narrow(spans, where, window, as_of, service)
    value = field(spans, aggregate_on) if aggregate_on else None
    names = {name: name.replace(".", "_") for name in group_by}
    picked = rows.select(
        *([bucket_start(F.col("timestamp"), step).alias("ts")] if request_type == "time_series" else []),
        *[field(spans, name).alias(names[name]) for name in group_by],
        (F.lit(1) if value is None else value).alias("_value"),
    )
    keys = {name: F.col(name) for name in picked.columns[:-1]}
    out = aggregate(picked, keys, {"value": (aggregation, F.col("_value"))}, quantile_mode)
    if request_type == "time_series":
        return out.orderBy("ts", *names.values())
    return out.orderBy(F.desc_nulls_last("value"), *names.values())


def search_logs(
    logs: DataFrame,
    text: str | None = None,
    *,
    severity: Sequence[str] = (),
    where: Column | str | None = None,
    window: str | None = None,
    as_of: object | None = None,
    service: str | None = None,
    limit: int | None = 100,
) -> DataFrame:
    """Newest logs that contain a text, have one of the severities and meet a condition."""
    rows = _narrow(logs, where, window, as_of, service)
    if text is not None:
        rows = rows.where(F.col("body").contains(text))
    if severity:
        rows = rows.where(F.col("severity_text").isin(*severity))
    newest = rows.orderBy(F.desc("timestamp"), F.desc("span_id"))
    return newest if limit is None else newest.limit(limit)


def aggregate_logs(
    logs: DataFrame,
    by: Sequence[str] = ("severity_text",),
    *,
    patterns: bool = False,
    where: Column | str | None = None,
    window: str | None = None,
    as_of: object | None = None,
) -> DataFrame:
    """Log counts by fields; with ``patterns`` also by the body with its numbers and ids masked."""
    rows = _narrow(logs, where, window, as_of, None)
    keys = {name.replace(".", "_"): field(logs, name) for name in by}
    if patterns:
        keys["pattern"] = message_template(F.col("body"))
    counted = rows.groupBy(*[c.alias(n) for n, c in keys.items()]).agg(F.count(F.lit(1)).alias("logs"))
    return counted.orderBy(F.desc("logs"), *keys)


def trace_details(spans: DataFrame, trace_id: str, logs: DataFrame | None = None) -> DataFrame:
    """One trace in time order: spans with depth and offset from its start, and its logs among them."""
    own = spans.where(F.col("trace_id") == trace_id)
    depths = span_depths(own.select("trace_id", "span_id", "parent_span_id"))
    start = own.agg(F.min("timestamp").alias("start")).scalar()
    signal = own.join(depths, ["trace_id", "span_id"], "left").select(
        F.lit("span").alias("kind"),
        "timestamp",
        "span_id",
        "name",
        "depth",
        DURATION,
        F.col("has_error").alias("failed"),
    )
    if logs is not None:
        entries = logs.where(F.col("trace_id") == trace_id).select(
            F.lit("log").alias("kind"),
            "timestamp",
            "span_id",
            F.col("body").alias("name"),
            F.lit(None).cast("long").alias("depth"),
            F.lit(None).cast("long").alias(DURATION),
            F.col("severity_text").isin("ERROR", "WARN").alias("failed"),
        )
        signal = signal.unionByName(entries)
    offset = (epoch_nanos(F.col("timestamp")) - epoch_nanos(start)) / F.lit(1000000)
    return signal.withColumn("offset_ms", F.round(offset, 3)).orderBy("timestamp", F.desc("kind"), "span_id")


def builder_query(
    table: DataFrame,
    aggregations: Mapping[str, tuple[str, str | None]],
    *,
    where: Column | str | None = None,
    group_by: Sequence[str] = (),
    step: str | None = None,
    having: Column | str | None = None,
    order_by: Sequence[Column | str] = (),
    limit: int | None = None,
    window: str | None = None,
    as_of: object | None = None,
    quantile_mode: str = "exact",
) -> DataFrame:
    """Filter, group, aggregate, filter groups, sort and limit in one call.

    ``aggregations`` maps an output name to (aggregation, field), such as ``{"slow": ("p99", "duration_nano")}``.
    """
    rows = _narrow(table, where, window, as_of, None)
    picked, keys = [], {}
    if step is not None:
        picked.append(bucket_start(F.col("timestamp"), step).alias("ts"))
        keys["ts"] = F.col("ts")
    for name in group_by:
        flat = name.replace(".", "_")
        picked.append(field(table, name).alias(flat))
        keys[flat] = F.col(flat)
    wanted, place = {}, {on: f"_v{k}" for k, on in enumerate(dict.fromkeys(on for _, on in aggregations.values()))}
    picked += [(F.lit(1) if on is None else field(table, on)).alias(name) for on, name in place.items()]
    for out_name, (kind, on) in aggregations.items():
        wanted[out_name] = (kind, F.col(place[on]))
    out = aggregate(rows.select(*picked), keys, wanted, quantile_mode)
    if having is not None:
        out = out.where(_condition(having))
    if order_by:
        out = out.orderBy(*order_by)
    return out if limit is None else out.limit(limit)
