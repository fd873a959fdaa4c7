"""Row filters over span-shaped tables, written so that they reach the parquet scan."""

from __future__ import annotations

import operator
from dataclasses import dataclass
from datetime import datetime, timezone
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from spanops import schema as S
from spanops.functions.scalars import field, interval, ns_to_ms


@dataclass(frozen=True)
class Now:
    """The present, read once for a report of several passes; like no ``as_of``, it is no upper bound."""

    at: datetime


def settled(df: DataFrame, as_of: object | None) -> object | None:
    """``as_of`` as it is to be passed on by a report that looks at the table more than once. A stream asks the clock for every batch."""
    return Now(datetime.now(timezone.utc)) if as_of is None and not df.isStreaming else as_of


def instant(df: DataFrame, value: object | None, column: str = "timestamp") -> Column:
    """A point in time with the type of the table's own time column, so that no cast lands on the column.

    The present moment is read once, when the report is built: all its passes look at the same rows. Only a stream asks
    the clock again for every batch.
    """
    kind = df.schema[column].dataType
    value = value.at if isinstance(value, Now) else value
    if value is None:
        return (F.current_timestamp() if df.isStreaming else F.lit(datetime.now(timezone.utc))).cast(kind)
    return (value if isinstance(value, Column) else F.lit(value)).cast(kind)


def latest(df: DataFrame, column: str = "timestamp") -> object:
    """Newest time in the table, to be passed as ``as_of``.

    On a table partitioned by event time only the newest partition is searched.
    """
    rows = df
    for part in ("dt", "hour"):
        if part in df.columns:
            newest = rows.agg(F.max(part)).first()[0]
            rows = rows.where(F.col(part) == F.lit(newest))
    return rows.agg(F.max(column)).first()[0]


def lookback(
    df: DataFrame, span: str, as_of: object | None = None, column: str = "timestamp", slack: str | None = None
) -> Column:
    """``as_of - span`` and later, inclusive. Against the clock there is no upper bound; an ``as_of`` is one.

    ``slack`` reaches further back.
    """
    end = instant(df, as_of, column)
    first = end - interval(span)
    since = F.col(column) >= (first if slack is None else first - interval(slack))
    return since if as_of is None or isinstance(as_of, Now) else since & (F.col(column) <= end)


def between(df: DataFrame, start: object, end: object, column: str = "timestamp") -> Column:
    """Both ends inclusive; an end that is ``None`` is the present moment, a start that is ``None`` is open."""
    if start is None:
        return F.col(column) <= instant(df, end, column)
    return F.col(column).between(instant(df, start, column), instant(df, end, column))


def bucket_prune(df: DataFrame, start: object, end: object) -> Column:
    """Range on ``ts_bucket_start`` implied by a time range, with one bucket of slack at the lower end."""

    def seconds(value: object) -> Column:
        return F.unix_seconds(instant(df, value).cast("timestamp"))

    if start is None:
        return F.col("ts_bucket_start") <= seconds(end)
    return F.col("ts_bucket_start").between(seconds(start) - S.BUCKET_SECONDS, seconds(end))


def name_prefix(prefix: str = S.ACTIVITY_PREFIX) -> Column:
    return F.col("name").startswith(prefix)


def equals(df: DataFrame, name: str, value: object) -> Column:
    return field(df, name) == F.lit(value)


def attr_nonempty(df: DataFrame, key: str = S.TIER_KEY) -> Column:
    """Key present and not empty."""
    return field(df, key) != ""


def attr_exists(df: DataFrame, key: str = S.TIER_KEY) -> Column:
    """Key present; an empty value counts."""
    if S.PROMOTED.get(key) in df.columns:
        return F.col(S.PROMOTED[key]).isNotNull()
    return F.coalesce(F.map_contains_key("attributes_string", key), F.lit(False))


def contains(column: str, text: str) -> Column:
    return F.col(column).contains(text)


def slower_than(limit_ms: float) -> Column:
    return ns_to_ms(F.col("duration_nano")) > F.lit(limit_ms)


def select_spans(
    spans: DataFrame,
    *,
    as_of: object | None = None,
    window: str | None = None,
    start: object | None = None,
    end: object | None = None,
    prefix: str | None = S.ACTIVITY_PREFIX,
    name: str | None = None,
    service: str | None = S.WORKER_SERVICE,
    where: Column | str | None = None,
) -> DataFrame:
    """The base filter every report starts from: time, name, service and an optional extra condition."""
    conditions = []
    if window is not None:
        conditions.append(lookback(spans, window, as_of))
    if start is not None or end is not None:
        conditions.append(between(spans, start, end))
        if "ts_bucket_start" in spans.columns:
            conditions.append(bucket_prune(spans, start, end))
    if name is not None:
        conditions.append(F.col("name") == name)
    elif prefix is not None:
        conditions.append(name_prefix(prefix))
    if service is not None:
        conditions.append(F.col("serviceName") == service)
    if where is not None:
        conditions.append(F.expr(where) if isinstance(where, str) else where)
    return spans.where(reduce(operator.and_, conditions)) if conditions else spans
