"""Joins across signals: spans with logs, metric points with spans, spans with their parents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from spanops import schema as S
from spanops.functions.predicates import instant, lookback, select_spans, settled
from spanops.functions.scalars import attribute_error, field, interval
from spanops.session import materialize

# Severities that mark a failure.
BAD_SEVERITIES = ("ERROR", "WARN")

# Hops double with every round, so this covers any parent chain that is not a loop.
MAX_ROUNDS = 32


def _failed(error: Column | None = None) -> Column:
    return F.coalesce(F.col("has_error") if error is None else error, F.lit(False))


def _bad() -> Column:
    return F.col("severity_text").isin(*BAD_SEVERITIES)


def _since(rows: DataFrame, window: str | None, as_of: object | None) -> DataFrame:
    """Rows not older than the window, so that older files are not opened. Later ones stay: a log may follow its span."""
    if window is None:
        return rows
    return rows.where(F.col("timestamp") >= instant(rows, as_of) - interval(window))


def _within(rows: DataFrame, window: str | None, as_of: object | None) -> DataFrame:
    return rows if window is None else rows.where(lookback(rows, window, as_of))


def _has_span(column: str = "span_id") -> Column:
    return F.coalesce(F.col(column) != "", F.lit(False))


def _logs_per_span(logs: DataFrame) -> DataFrame:
    """Bad logs combined to one row per (trace, span), so that the join cannot multiply spans."""
    return logs.where(_bad() & _has_span()).groupBy("trace_id", "span_id").agg(
        F.count(F.lit(1)).alias("log_count"), F.min("body").alias("sample_body")
    )


def trace_log_correlation(
    spans: DataFrame,
    logs: DataFrame,
    *,
    as_of: object | None = None,
    window: str | None = "1 hour",
    step: str = "5 minutes",
    error: Column | None = None,
    **base: object,
) -> DataFrame:
    """Failed spans and ERROR/WARN logs side by side per bucket and activity.

    A log with a span id belongs to that span. One without belongs to its trace and is counted with
    the trace's first span, so every log counts once however many spans the trace has. ``error`` says which spans failed
    (default ``has_error``). Logs older than the window are not read.
    """
    as_of = settled(spans, as_of)
    logs = _since(logs, window, as_of)
    rows = select_spans(spans, as_of=as_of, window=window, **base).select(
        "timestamp", "trace_id", "span_id", F.col("name").alias("activity"), _failed(error).alias("failed")
    )
    per_span = _logs_per_span(logs)
    loose = logs.where(_bad() & ~_has_span()).groupBy("trace_id").agg(
        F.count(F.lit(1)).alias("_count"), F.min("body").alias("_body")
    )
    firsts = rows.join(loose, "trace_id", "left_semi").groupBy("trace_id").agg(
        F.min_by("span_id", F.struct("timestamp", "span_id")).alias("span_id")
    )
    placed = firsts.join(loose, "trace_id").select(
        "trace_id", "span_id", F.col("_count").alias("log_count"), F.col("_body").alias("sample_body")
    )
    combined = per_span.unionByName(placed).groupBy("trace_id", "span_id").agg(
        F.sum("log_count").alias("log_count"), F.min("sample_body").alias("sample_body")
    )
    # All spans are only counted; just those with a log are joined, so the join is an inner one and
    # the text sample, which needs a sort to aggregate, covers few rows.
    bucket = F.window("timestamp", step).alias("w")
    counted = rows.groupBy(bucket, "activity").agg(
        F.count(F.lit(1)).alias("total_spans"), F.count_if("failed").alias("error_spans")
    )
    logged = rows.join(combined, ["trace_id", "span_id"]).groupBy(bucket, "activity").agg(
        F.sum("log_count").alias("bad_logs"),
        F.count_if(~F.col("failed")).alias("logged_without_error"),
        F.min("sample_body").alias("sample_body"),
    )
    joined = counted.join(logged, ["w", "activity"], "left").where("error_spans > 0 OR bad_logs > 0")
    out = joined.select(
        F.col("w.start").alias("ts"),
        "activity",
        "total_spans",
        "error_spans",
        F.coalesce("bad_logs", F.lit(0)).alias("bad_logs"),
        F.coalesce("logged_without_error", F.lit(0)).alias("logged_without_error"),
        "sample_body",
    )
    return out.orderBy(F.desc("ts"), F.desc("bad_logs"), "activity")


def _failed_traces(spans: DataFrame, error: Column | None = None) -> DataFrame:
    return spans.where(_failed(error)).select("trace_id").distinct()


def error_logs_for_failed(
    spans: DataFrame, logs: DataFrame, error: Column | None = None, *, window: str | None = None, as_of: object | None = None
) -> DataFrame:
    """ERROR/WARN logs of workflows with a failed span; ``error`` says which spans failed (default ``has_error``).

    With a window: of the spans in it, and logs not older than it.
    """
    as_of = settled(spans, as_of)
    failed = _failed_traces(_within(spans, window, as_of), error)
    return _since(logs, window, as_of).where(_bad()).join(failed, "trace_id", "left_semi")


def unlogged_failures(
    spans: DataFrame, logs: DataFrame, error: Column | None = None, *, window: str | None = None, as_of: object | None = None
) -> DataFrame:
    """Failed spans of workflows without any ERROR/WARN log; with a window, of the spans in it, and logs not older than it."""
    as_of = settled(spans, as_of)
    logged = _since(logs, window, as_of).where(_bad()).select("trace_id").distinct()
    return _within(spans, window, as_of).where(_failed(error)).join(logged, "trace_id", "left_anti")


def effective_error(
    spans: DataFrame, logs: DataFrame | None = None, *, window: str | None = None, as_of: object | None = None
) -> DataFrame:
    """Add ``effective_error``: reported, or told by a failure attribute or an ERROR/WARN log of the span.

    With a window: the spans in it, and logs not older than it.
    """
    as_of = settled(spans, as_of)
    spans = _within(spans, window, as_of)
    if logs is None:
        return spans.withColumn("effective_error", attribute_error())
    logs = _since(logs, window, as_of)
    bad = logs.where(_bad() & _has_span()).select("trace_id", "span_id").distinct().withColumn("_logged", F.lit(True))
    joined = spans.join(bad, ["trace_id", "span_id"], "left")
    flag = attribute_error() | F.coalesce("_logged", F.lit(False))
    return joined.withColumn("effective_error", flag).drop("_logged")


def tier_backfill(spans: DataFrame, dim: str = S.TIER_KEY, out: str = "tier") -> DataFrame:
    """Fill a missing tier from the other spans of the workflow. Only the spans without one are joined."""
    tiered = spans.withColumn(out, F.nullif(field(spans, dim), F.lit("")))
    known = tiered.where(F.col(out).isNotNull())
    # Spans without a workflow id do not form a workflow.
    tiers = known.where("trace_id != ''").groupBy("trace_id").agg(F.max(out).alias("_tier"))
    filled = tiered.where(F.col(out).isNull()).drop(out).join(tiers, "trace_id", "left")
    return known.unionByName(filled.withColumnRenamed("_tier", out))


def metric_trace_link(
    points: DataFrame,
    spans: DataFrame,
    *,
    metric: str,
    step: str = "5 minutes",
    limit_ms: float = 1000,
) -> DataFrame:
    """Mean metric value next to span, error and timeout counts per service and bucket; a bucket without spans counts 0."""
    measured = points.where(F.col("metric_name") == metric).groupBy(
        F.window("timestamp", step).alias("w"), "serviceName"
    ).agg(F.avg("value").alias("metric_avg"), F.count(F.lit(1)).alias("points"))
    traced = spans.groupBy(F.window("timestamp", step).alias("w"), "serviceName").agg(
        F.count(F.lit(1)).alias("total_spans"),
        F.count_if(_failed()).alias("error_spans"),
        F.count_if(F.col("duration_nano") > F.lit(limit_ms * 1000000)).alias("slow_spans"),
    )
    joined = measured.join(traced, ["w", "serviceName"], "left")
    return joined.select(
        F.col("w.start").alias("ts"),
        "serviceName",
        "points",
        F.round("metric_avg", 4).alias("metric_avg"),
        *[F.coalesce(c, F.lit(0)).alias(c) for c in ("total_spans", "error_spans", "slow_spans")],
    ).orderBy("ts", "serviceName")


def parent_child(spans: DataFrame) -> DataFrame:
    """Each span with its parent's name, its depth, and the time not spent in its children.

    A span whose parent is not in the table counts as a root. Depths come from pointer doubling: a
    round joins every open span with the ancestor it points at, so a chain of depth d takes about
    log2(d) rounds. Spans on a parent loop have no root; their depth is NULL. A span that was delivered more than once
    counts once, by its earliest row.
    """
    row = F.min(F.struct("timestamp", "duration_nano", "name", "parent_span_id")).alias("r")
    nodes = spans.groupBy("trace_id", "span_id").agg(row).select(
        "trace_id", "span_id", "r.parent_span_id", "r.name", "r.timestamp", "r.duration_nano"
    )
    nodes = materialize(nodes, "nodes")
    children = nodes.where(_has_span("parent_span_id")).groupBy("trace_id", F.col("parent_span_id").alias("span_id"))
    children = children.agg(F.count(F.lit(1)).alias("child_count"), F.sum("duration_nano").alias("_child_nano"))
    parents = nodes.select(
        "trace_id", F.col("span_id").alias("parent_span_id"), F.col("name").alias("parent_name"), F.lit(True).alias("_found")
    )
    tree = nodes.join(parents, ["trace_id", "parent_span_id"], "left")
    tree = tree.join(children, ["trace_id", "span_id"], "left")
    depths = span_depths(nodes)
    return tree.join(depths, ["trace_id", "span_id"], "left").select(
        "trace_id",
        "span_id",
        "parent_span_id",
        "name",
        "parent_name",
        "timestamp",
        "duration_nano",
        "depth",
        F.coalesce("child_count", F.lit(0)).alias("child_count"),
        F.greatest(F.col("duration_nano") - F.coalesce("_child_nano", F.lit(0)), F.lit(0)).alias("self_nano"),
    )


def span_depths(nodes: DataFrame) -> DataFrame:
    """(trace_id, span_id, depth) by pointer doubling; runs its rounds when called.

    A round writes the spans that were still open, with how far they got; those that it closes are not touched again.
    """
    ids = nodes.select("trace_id", F.col("span_id").alias("_to"), F.lit(True).alias("_found"))
    links = nodes.select("trace_id", "span_id", F.col("parent_span_id").alias("_to"))
    state = links.join(ids, ["trace_id", "_to"], "left").select(
        "trace_id",
        "span_id",
        F.when(F.col("_found"), F.col("_to")).alias("_to"),
        F.when(F.col("_found"), 1).otherwise(0).cast("long").alias("_hops"),
    )
    closed: DataFrame | None = None
    before = None
    for _ in range(MAX_ROUNDS):
        state = materialize(state, "depth")
        is_open = F.col("_to").isNotNull()
        done, still = state.where(~is_open), state.where(is_open)
        closed = done if closed is None else closed.unionByName(done)
        left = still.count()
        # Every round closes the spans of some depth; where it closed none, only loops are left.
        if left in (0, before):
            break
        before = left
        ahead = closed.unionByName(still).select(
            "trace_id", F.col("span_id").alias("_to"), F.col("_to").alias("_next"), F.col("_hops").alias("_more")
        )
        state = still.join(ahead, ["trace_id", "_to"]).select(
            "trace_id", "span_id", F.col("_next").alias("_to"), (F.col("_hops") + F.col("_more")).alias("_hops")
        )
    whole = closed.unionByName(still)
    return whole.select("trace_id", "span_id", F.when(F.col("_to").isNull(), F.col("_hops")).alias("depth"))


def cross_baseline(grouped: DataFrame, baseline: DataFrame, columns: list[str]) -> DataFrame:
    """Attach the columns of a one-row aggregate to every row, as a scalar subquery."""
    row = baseline.select(F.struct(*columns).alias("row")).scalar()
    attached = grouped.withColumn("_row", row)
    return attached.select(*grouped.columns, *[F.col("_row")[name].alias(name) for name in columns])
