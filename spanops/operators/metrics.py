"""Metric points: counter rates, formulas, histogram quantiles and the catalogue."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from spanops.functions.scalars import interval, ratio


def _width_seconds(step: str) -> Column:
    return F.unix_seconds((F.lit("1970-01-01").cast("timestamp_ntz") + interval(step)).cast("timestamp"))


def _series(points: DataFrame) -> Column:
    """Identity of a series: service and sorted attributes."""
    entries = F.array_sort(F.map_entries(F.coalesce("attributes", F.create_map().cast("map<string,string>"))))
    return F.struct(F.col("serviceName"), entries.alias("attributes"))


def _delta() -> Column:
    """Whether a point holds the change since the last one; without a stated temporality it does not."""
    return F.lower(F.coalesce("temporality", F.lit(""))) == "delta"


def histogram_counts(points: DataFrame, piece: str = "1 minute") -> DataFrame:
    """Histogram points whose ``bucket_counts`` are counts of their own interval.

    Cumulative points become differences to the point before of the same series and bounds. The first is the base and counts
    nothing; where a count falls the series was reset, and the new counts count in full. Points are compared within short pieces of
    a series, and the first of a piece with the last of the piece before, so a series with very many points is spread over tasks.
    """
    cumulative = F.lower(F.coalesce("temporality", F.lit(""))) == "cumulative"
    part = ["_series", "bucket_bounds", "_piece"]
    inside = Window.partitionBy(*part).orderBy("timestamp")
    rows = points.where(cumulative).withColumn("_series", _series(points))
    rows = rows.withColumn("_piece", F.window("timestamp", piece).getField("start"))
    chained = rows.withColumn("_inside", F.lag("bucket_counts").over(inside))
    ends = rows.groupBy(*part).agg(F.max_by("bucket_counts", "timestamp").alias("_last"))
    along = Window.partitionBy("_series", "bucket_bounds").orderBy("_piece")
    prior = ends.withColumn("_prior", F.lag("_last").over(along)).drop("_last")
    chained = chained.join(prior, part).withColumn("_before", F.coalesce("_inside", "_prior"))
    reset = F.exists(F.arrays_zip(F.col("bucket_counts").alias("now"), F.col("_before").alias("old")), lambda x: x["now"] < x["old"])
    differences = F.zip_with("bucket_counts", "_before", lambda a, b: a - b)
    own = F.when(reset, F.col("bucket_counts")).otherwise(differences)
    counted = chained.where(F.col("_before").isNotNull()).withColumn("bucket_counts", own).select(*points.columns)
    return points.where(~cumulative).unionByName(counted)


def counter_increase(points: DataFrame, metric: str, *, step: str, piece: str = "1 minute") -> DataFrame:
    """Increase of a counter per series and bucket. Delta points are increases themselves and are summed.

    Of cumulative points the first is the base; after a reset the new value counts.

    Consecutive points are compared within short pieces of a series, and pieces by their end points
    only, so a series with very many points is spread over tasks by time.
    """
    own = points.where(F.col("metric_name") == metric)
    is_delta = _delta()
    deltas = own.where(is_delta).groupBy(_series(points).alias("series"), F.window("timestamp", step).getField("start").alias("ts"))
    deltas = deltas.agg(F.sum("value").alias("increase"))
    rows = own.where(~is_delta).select(
        _series(points).alias("series"),
        F.col("timestamp").alias("at"),
        "value",
        F.window("timestamp", piece).getField("start").alias("piece"),
    )

    def grown(now: Column, before: Column) -> Column:
        return F.when(before.isNull(), F.lit(0.0)).when(now < before, now).otherwise(now - before)

    inside = Window.partitionBy("series", "piece").orderBy("at", "value")
    steps = rows.withColumn("_grown", grown(F.col("value"), F.lag("value").over(inside)))
    pieces = steps.groupBy("series", "piece").agg(
        F.sum("_grown").alias("_inside"),
        F.min_by("value", F.struct("at", "value")).alias("_first"),
        F.max_by("value", F.struct("at", "value")).alias("_last"),
    )
    along = Window.partitionBy("series").orderBy("piece")
    total = F.col("_inside") + grown(F.col("_first"), F.lag("_last").over(along))
    bucket = F.window("piece", step).getField("start")
    increased = pieces.select("series", bucket.alias("ts"), total.alias("_total"))
    return increased.groupBy("series", "ts").agg(F.sum("_total").alias("increase")).unionByName(deltas)


def query_metrics(
    points: DataFrame,
    metric: str,
    *,
    step: str = "1 minute",
    aggregation: str = "avg",
    group_by: Sequence[str] = (),
) -> DataFrame:
    """One metric per bucket and group: avg, sum, min, max or count of the points, or the counter ``rate`` per second."""
    names = [name.replace(".", "_") for name in group_by]
    if aggregation == "rate":
        rows = counter_increase(points, metric, step=step)
        attributes = F.map_from_entries("series.attributes")
        keys = [
            (F.col("series.serviceName") if g == "serviceName" else attributes[g]).alias(n) for g, n in zip(group_by, names)
        ]
        out = rows.groupBy("ts", *keys).agg((F.sum("increase") / _width_seconds(step)).alias("value"))
    else:
        known = {"avg": F.avg, "sum": F.sum, "min": F.min, "max": F.max, "count": F.count}
        keys = [(F.col(g) if g == "serviceName" else F.col("attributes")[g]).alias(n) for g, n in zip(group_by, names)]
        rows = points.where(F.col("metric_name") == metric)
        grouped = rows.groupBy(F.window("timestamp", step).alias("w"), *keys).agg(known[aggregation]("value").alias("value"))
        out = grouped.select(F.col("w.start").alias("ts"), *names, "value")
    return out.orderBy("ts", *names)


def metric_formula(series: Mapping[str, DataFrame], formula: str, *, keys: Sequence[str] = ("ts",)) -> DataFrame:
    """SQL expression over named series joined on their buckets, such as ``a / b``; a zero divisor gives NULL.

    Write the division as ``try_divide(a, b)``.
    """
    out = None
    for name, frame in series.items():
        part = frame.select(*keys, F.col("value").alias(name))
        out = part if out is None else out.join(part, list(keys), "full_outer")
    return out.select(*keys, F.expr(formula).alias("value")).orderBy(*keys)


# Share of a group's count below which two cumulative counts are the same number.
_EQUAL = 1e-9


def _distribution(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Cumulative counts of each group on all bounds that occur in it, whatever the layouts of its histograms.

    A bucket's count rises evenly from its lower to its upper bound (0 stands below the first, unless that is negative); what lies
    beyond the last bound counts at that bound. So every bucket changes the slope at its two ends, and the counts at the bounds follow
    from the slopes so far; layouts are never paired. Columns: ``x``, ``below`` (count before x), ``upto`` (with what counts at x),
    ``next_x`` and ``next_below``, and ``n`` of the whole group. One row per bound and group enters the windows.
    """
    opened = rows.groupBy(*keys, "bucket_bounds", "pos").agg(F.sum("col").alias("rows")).where("rows > 0")
    upper = F.get("bucket_bounds", F.col("pos"))
    first = F.least(F.lit(0.0), F.get("bucket_bounds", F.lit(0)))
    lower = F.when(F.col("pos") > 0, F.get("bucket_bounds", F.col("pos") - 1)).otherwise(F.coalesce(first, F.lit(0.0)))
    pieces = opened.select(*keys, lower.alias("lower"), upper.alias("upper"), F.col("rows").cast("double").alias("rows"))
    flat = F.col("upper").isNull() | (F.col("upper") <= F.col("lower"))
    slope = F.when(flat, F.lit(0.0)).otherwise(F.try_divide(F.col("rows"), F.col("upper") - F.col("lower")))
    at = F.when(F.col("upper").isNull(), F.col("lower")).otherwise(F.greatest("lower", "upper"))

    def event(x: Column, bend: Column, jump: Column, count: Column) -> Column:
        return F.struct(x.alias("x"), bend.alias("bend"), jump.alias("jump"), count.alias("count"))

    none = F.lit(0.0)
    jump = F.when(flat, F.col("rows")).otherwise(none)
    events = F.array(event(F.col("lower"), slope, none, none), event(at, -slope, jump, F.col("rows")))
    bends = pieces.select(*keys, F.explode(events).alias("e")).groupBy(*keys, "e.x").agg(
        F.sum("e.bend").alias("bend"), F.sum("e.jump").alias("jump"), F.sum("e.count").alias("count")
    )
    group = Window.partitionBy(*keys)
    along = group.orderBy("x")
    upto, before = along.rowsBetween(Window.unboundedPreceding, 0), along.rowsBetween(Window.unboundedPreceding, -1)
    sloped = bends.withColumn("slope", F.sum("bend").over(upto)).withColumn("next_x", F.lead("x").over(along))
    area = F.coalesce(F.greatest(F.col("slope"), none) * (F.col("next_x") - F.col("x")), none)
    grown = sloped.withColumn("area", area)
    below = F.coalesce(F.sum(F.col("area") + F.col("jump")).over(before), none)
    counted = grown.withColumn("below", below).withColumn("upto", F.col("below") + F.col("jump"))
    return counted.select(*keys, "x", "below", "upto", "next_x", (F.col("upto") + F.col("area")).alias("next_below"), F.sum("count").over(group).alias("n"))


def metric_histogram_quantile(
    points: DataFrame,
    metric: str,
    quantile: float,
    *,
    step: str = "1 minute",
    group_by: Sequence[str] = ("serviceName",),
) -> DataFrame:
    """Quantile from explicit-bucket histograms: cumulative counts on the common refinement of all bounds, interpolated.

    Values beyond a histogram's last bound count as that bound. Histograms of different bounds add up, so quantiles never fall as
    ``quantile`` rises. Cumulative points count by their differences.
    """
    rows = histogram_counts(points.where((F.col("metric_name") == metric) & F.col("bucket_counts").isNotNull()))
    names = [name.replace(".", "_") for name in group_by]
    keys = [(F.col(g) if g == "serviceName" else F.col("attributes")[g]).alias(n) for g, n in zip(group_by, names)]
    opened = rows.select(F.window("timestamp", step).getField("start").alias("ts"), *keys, "bucket_bounds", F.posexplode("bucket_counts"))
    placed = _distribution(opened, ["ts", *names])
    wanted = F.lit(float(quantile)) * F.col("n")
    if quantile > 0:
        short = lambda c: F.col(c) < wanted - F.col("n") * _EQUAL
        holds = short("below") & (~short("upto") | ~short("next_below"))
        inside = F.col("x") + (F.col("next_x") - F.col("x")) * F.least(F.lit(1.0), ratio(wanted - F.col("upto"), F.col("next_below") - F.col("upto")))
        value = F.when(~short("upto"), F.col("x")).otherwise(inside)
        held = placed.where(holds | (short("upto") & ~short("next_below")))
    else:
        value = F.col("x")
        held = placed.where((F.col("below") == 0) & (F.col("next_below") > 0))
    out = held.groupBy("ts", *names).agg(F.min_by(value, "x").alias("value"), F.max("n").cast("long").alias("count"))
    return out.select("ts", *names, "count", "value").orderBy("ts", *names)


def list_metrics(points: DataFrame) -> DataFrame:
    """Metric names with type, temporality, number of series and number of points."""
    series = points.groupBy("metric_name", "metric_type", "temporality", _series(points).alias("series")).agg(
        F.count(F.lit(1)).alias("_points")
    )
    out = series.groupBy("metric_name", "metric_type", "temporality").agg(
        F.count(F.lit(1)).alias("series"), F.sum("_points").alias("points")
    )
    return out.orderBy("metric_name", "metric_type", "temporality")
