"""Quantiles per group, in three modes.

``exact``
    Linear interpolation between order statistics, without ever holding a large group in one task.
    The largest group is counted first. Up to ``GROUP_ROWS`` the built-in ``percentile`` holds each
    group in one buffer. Beyond it, ``group_stats`` takes two scans. The first makes the plain aggregates, counts and a KLL sketch per
    group; the sketch brackets each wanted rank between two values. The second counts, combined before the shuffle, the values
    inside the brackets one by one and those between brackets together, which gives true ranks. Sketches may err, ranks do not:
    a group whose wanted rank fell outside its bracket is solved by ranges. ``exact_quantiles`` goes by ranges at once: one pass counts
    rows per value range, a further pass looks at the rows of the ranges that hold the wanted ranks only, and ranges that are still
    large are split again.
``approx``
    ``percentile_approx``: one pass, bounded buffer, also on streams.
``kll``
    KLL sketches: one pass, bounded buffer, can be stored and merged later.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from spanops.session import materialize

MODES = ("exact", "approx", "kll")

# Groups up to this many rows fit the buffer of the built-in aggregate.
GROUP_ROWS = 250_000
# Ranges per e-fold of the value in the first pass, and per range in a further pass.
RANGES = 2048
# A range with more rows than this is split again before its rows are sorted.
RANGE_ROWS = 4_000_000
# Each split narrows a range 2048-fold, so a 64-bit value is resolved long before this.
MAX_SPLITS = 8

# Size parameter of the sketches that bracket ranks, and the share of ranks on both sides of a quantile that a bracket takes in: three
# times the error that 99 in 100 such sketches keep.
SKETCH_K = 2048
BRACKET = 0.008

Keys = Mapping[str, Column]


def sketch_quantiles(value: Column, quantiles: Mapping[str, float], mode: str, accuracy: int = 10000) -> list[Column]:
    """One-pass quantile aggregates with a bounded buffer, one column per name."""
    points = list(quantiles.values())
    if mode == "approx":
        values = F.percentile_approx(value, points, accuracy)
    elif mode == "kll":
        sketch = F.kll_sketch_agg_double(value.cast("double"))
        values = F.kll_sketch_get_quantile_double(sketch, F.array(*[F.lit(p) for p in points]))
    else:
        raise ValueError(f"unknown quantile mode {mode!r}, expected one of {MODES}")
    return [values[i].cast("double").alias(name) for i, name in enumerate(quantiles)]


def group_stats(
    df: DataFrame,
    keys: Keys,
    value: Column,
    quantiles: Mapping[str, float],
    aggregates: Sequence[Column] = (),
    mode: str = "exact",
    group_rows: int | None = None,
    at_most: int | None = None,
) -> DataFrame:
    """Plain aggregates and quantiles of ``value`` side by side, one row per group.

    ``at_most`` is a number of rows already known not to be exceeded; where it is small, nothing is counted.
    """
    columns = [column.alias(name) for name, column in keys.items()]
    if mode != "exact":
        return df.groupBy(*columns).agg(*aggregates, *sketch_quantiles(value, quantiles, mode))
    group_rows = GROUP_ROWS if group_rows is None else group_rows
    known = at_most is not None and at_most <= group_rows
    if known or fits_buffer(df, keys, value, group_rows):
        return df.groupBy(*columns).agg(*aggregates, *_buffered(value, quantiles))
    return _by_sketch(df, keys, value, quantiles, aggregates)


def _by_sketch(df: DataFrame, keys: Keys, value: Column, quantiles: Mapping[str, float], aggregates: Sequence[Column]) -> DataFrame:
    """Two scans: brackets of the wanted ranks from a sketch, then true ranks inside them; see the module text."""
    group = [f"_k{i}" for i in range(len(keys))]
    named = [c.alias(g) for g, c in zip(group, keys.values())]
    whole = isinstance(df.select(value).schema[0].dataType, T.IntegralType)
    number, kind = (value.cast("bigint"), "bigint") if whole else (value.cast("double"), "double")
    sketch, read = getattr(F, f"kll_sketch_agg_{kind}"), getattr(F, f"kll_sketch_get_quantile_{kind}")
    points = list(quantiles.values())

    # The plain aggregates travel as one struct, as a result may be called like a column or like one of the counters here.
    carried = [F.struct(*aggregates).alias("_plain")] if aggregates else []
    sides = [min(max(p + side * BRACKET, 0.0), 1.0) for p in points for side in (-1, 1)]
    passed = df.groupBy(*named).agg(
        *carried, F.count(number).alias("_n"), F.min(number).alias("_low"), F.max(number).alias("_high"),
        sketch(number, F.lit(SKETCH_K)).alias("_sketch"),
    )
    guess = F.when(F.col("_n") > 0, read("_sketch", F.array(*[F.lit(side) for side in sides])))
    small = F.col("_n") <= SKETCH_K
    bounds = []
    for i, _ in enumerate(points):
        bounds.append(F.when(small | (F.lit(sides[2 * i]) <= 0), F.col("_low")).otherwise(F.col("_g")[2 * i]).alias(f"_a{i}"))
        bounds.append(F.when(small | (F.lit(sides[2 * i + 1]) >= 1), F.col("_high")).otherwise(F.col("_g")[2 * i + 1]).alias(f"_b{i}"))
    first = passed.withColumn("_g", guess).select(*passed.columns, *bounds).drop("_sketch", "_low", "_high")
    first = materialize(first, "brackets")

    ends = materialize(_inside_brackets(df.select(*named, number.alias("_v")), first, group, points), "ranks")
    out = _interpolated(ends, group, quantiles)
    missed = F.lit(False)
    for i, _ in enumerate(points):
        missed = missed | F.col(f"_lo{i}").isNull() | F.col(f"_hi{i}").isNull()
    if ends.where(missed).limit(1).count():
        again = match_groups(df.select("*", *named), ends.where(missed).select(*group, F.lit(True).alias("_again")), group).where("_again")
        solved = _by_ranges(again, {g: F.col(g) for g in group}, number, quantiles, RANGE_ROWS)
        out = _interpolated(ends.where(~missed), group, quantiles).unionByName(solved)
    plain = first.drop("_n", *[f"_{s}{i}" for i, _ in enumerate(points) for s in "ab"])
    found = out.select(*group, F.struct(*quantiles).alias("_q"))
    joined = match_groups(plain, found, group) if group else plain.withColumn("_q", found.scalar())
    renamed = [F.col(g).alias(name) for g, name in zip(group, keys)]
    return joined.select(*renamed, *(["_plain.*"] if aggregates else []), *[F.col("_q")[name].alias(name) for name in quantiles])


def _inside_brackets(rows: DataFrame, first: DataFrame, group: list[str], points: list[float]) -> DataFrame:
    """The order statistics on both sides of every wanted rank, one row per group; NULL where one lies outside its bracket.

    Values outside all brackets count together at the end of the bracket below them. What enters the window is the distinct values
    inside the brackets.
    """
    sides = [f"_{s}{i}" for i, _ in enumerate(points) for s in "ab"]
    present = rows.where(F.col("_v").isNotNull())
    if group:
        small = first.where("_n > 0").select(*[F.col(g).alias(f"_t{g}") for g in group], "_n", *sides)
        same = F.lit(True)
        for g in group:
            same = same & F.col(g).eqNullSafe(F.col(f"_t{g}"))
        placed = present.join(small, same).drop(*[f"_t{g}" for g in group])
    else:
        row = first.select(F.struct("_n", *sides).alias("s")).scalar()
        placed = present.withColumn("_s", row).select("_v", "_s.*")
    inside = F.lit(False)
    below = F.lit(None)
    for i, _ in enumerate(points):
        low, high = F.col(f"_a{i}"), F.col(f"_b{i}")
        inside = inside | ((F.col("_v") >= low) & (F.col("_v") <= high))
        end = F.when(F.col("_v") > high, high)
        below = end if i == 0 else F.greatest(below, end)
    counted = placed.select(*group, "_n", inside.alias("_in"), F.when(inside, F.col("_v")).otherwise(below).alias("_v"))
    counted = counted.groupBy(*group, "_n", "_in", "_v").agg(F.count(F.lit(1)).alias("_rows"))
    upto = Window.partitionBy(*group).orderBy(F.asc_nulls_first("_v"), F.desc("_in")).rowsBetween(Window.unboundedPreceding, 0)
    ranked = counted.withColumn("_to", F.sum("_rows").over(upto)).withColumn("_from", F.col("_to") - F.col("_rows")).where("_in")
    return _picked(ranked, group, points)


def _picked(ranked: DataFrame, group: list[str], points: list[float]) -> DataFrame:
    """From values with the ranks they take up: those at the ranks on both sides of each quantile."""
    picked = []
    for i, p in enumerate(points):
        for side, rank in zip(("lo", "hi"), _ranks(p)):
            hit = (F.col("_from") <= rank) & (rank < F.col("_to"))
            picked.append(F.max(F.when(hit, F.col("_v"))).alias(f"_{side}{i}"))
    ends = ranked.groupBy(*group).agg(F.max("_n").alias("_n"), *picked)
    return ends if group else ends.where(F.col("_n").isNotNull())


def _interpolated(ends: DataFrame, group: list[str], quantiles: Mapping[str, float]) -> DataFrame:
    """Quantiles from the order statistics on both sides."""
    out = [F.col(g) for g in group]
    for i, (name, p) in enumerate(quantiles.items()):
        low, high = F.col(f"_lo{i}").cast("double"), F.col(f"_hi{i}").cast("double")
        at = _position(p)
        # The same steps in floating point as the built-in aggregate takes.
        between = (F.ceil(at) - at) * low + (at - F.floor(at)) * high
        out.append(F.when(F.floor(at) == F.ceil(at), low).otherwise(between).alias(name))
    return ends.select(*out)


def fits_buffer(df: DataFrame, keys: Keys, value: Column, group_rows: int) -> bool:
    """Whether every group is small enough for the built-in aggregate; only counters leave the tasks.

    A small total settles it at once; else the largest group is counted.
    """
    if df.agg(F.count(value)).first()[0] <= group_rows:
        return True
    if not keys:
        return False
    counted = df.groupBy(*keys.values()).agg(F.count(value).alias("rows"))
    return counted.agg(F.max("rows")).first()[0] <= group_rows


def _buffered(value: Column, quantiles: Mapping[str, float]) -> list[Column]:
    values = F.percentile(value, list(quantiles.values()))
    return [values[i].alias(name) for i, name in enumerate(quantiles)]


def match_groups(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Left join of two frames with one row per group; a NULL key matches a NULL key."""
    renamed = right.select(*[F.col(k).alias(f"_r_{k}") for k in keys], *[c for c in right.columns if c not in keys])
    condition = F.lit(True)
    for k in keys:
        condition = condition & F.col(k).eqNullSafe(F.col(f"_r_{k}"))
    return left.join(renamed, condition, "left").drop(*[f"_r_{k}" for k in keys])


def exact_quantiles(
    df: DataFrame,
    keys: Keys,
    value: Column,
    quantiles: Mapping[str, float],
    group_rows: int | None = None,
    range_rows: int = RANGE_ROWS,
) -> DataFrame:
    """Exact interpolated quantiles of a numeric column, one row per group with any value.

    Runs the counting passes when called; the returned frame is lazy.
    """
    present = df.where(value.isNotNull())
    if not fits_buffer(present, keys, value, GROUP_ROWS if group_rows is None else group_rows):
        return _by_ranges(present, keys, value, quantiles, range_rows)
    columns = [column.alias(name) for name, column in keys.items()]
    return present.groupBy(*columns).agg(*_buffered(value, quantiles))


def _by_ranges(df: DataFrame, keys: Keys, value: Column, quantiles: Mapping[str, float], range_rows: int) -> DataFrame:
    """Quantiles from rank ranges; see the module text."""
    group = [f"_k{i}" for i in range(len(keys))]
    rows = df.select(*[c.alias(g) for g, c in zip(group, keys.values())], value.alias("_v"))
    rows = rows.where(F.col("_v").isNotNull()).select("*", _log_range(F.col("_v")).alias("_range"))
    rows = rows.withColumn("_base", F.lit(0).cast("bigint"))
    points = list(quantiles.values())

    ranges = materialize(_wanted_ranges(rows, group, points, None), "ranges")
    solved = [_solved(ranges, group)]
    splits = 0
    while True:
        largest = ranges.where("_low < _high").agg(F.max("_rows")).first()[0]
        if largest is None:
            break
        rows = _narrow(rows, ranges, group)
        if largest <= range_rows or splits == MAX_SPLITS:
            solved.append(_ranked(rows, group))
            break
        ranges = materialize(_wanted_ranges(rows, group, points, "_n"), "ranges")
        solved.append(_solved(ranges, group))
        splits += 1

    ranked = solved[0]
    for part in solved[1:]:
        ranked = ranked.unionByName(part)
    found = _interpolated(_picked(ranked, group, points), group, quantiles)
    return found.select(*[F.col(g).alias(name) for g, name in zip(group, keys)], *quantiles)


def _position(p: float) -> Column:
    return F.lit(float(p)) * (F.col("_n") - 1)


def _ranks(p: float) -> tuple[Column, Column]:
    """Zero-based ranks on both sides of a quantile."""
    return F.floor(_position(p)), F.ceil(_position(p))


def _log_range(v: Column) -> Column:
    """Range number that never falls as the value rises; ranges are narrow near zero and wide far out."""
    d = v.cast("double")
    raw = F.signum(d) * F.log1p(F.abs(d)) * F.lit(RANGES)
    limit = F.lit(2.0e9)
    return F.floor(F.least(F.greatest(raw, -limit), limit)).cast("int")


def _wanted_ranges(rows: DataFrame, group: list[str], points: list[float], total: str | None) -> DataFrame:
    """Count rows per range and keep the ranges that hold a wanted rank, with the rank they start at.

    The windows run over counters only: at most one row per range that occurs in a group.
    """
    carried = [total] if total else []
    counted = rows.groupBy(*group, "_base", *carried, "_range").agg(
        F.count(F.lit(1)).alias("_rows"), F.min("_v").alias("_low"), F.max("_v").alias("_high")
    )
    within = Window.partitionBy(*group, "_base")
    before = within.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    if not total:
        counted = counted.withColumn("_n", F.sum("_rows").over(within))
    placed = counted.withColumn("_from", F.col("_base") + F.coalesce(F.sum("_rows").over(before), F.lit(0)))
    wanted = F.lit(False)
    for p in points:
        for rank in _ranks(p):
            wanted = wanted | ((F.col("_from") <= rank) & (rank < F.col("_from") + F.col("_rows")))
    return placed.where(wanted)


def _solved(ranges: DataFrame, group: list[str]) -> DataFrame:
    """Ranges that hold a single value need no second look."""
    return ranges.where("_low = _high").select(
        *group, "_n", "_from", (F.col("_from") + F.col("_rows")).alias("_to"), F.col("_low").alias("_v")
    )


def _narrow(rows: DataFrame, ranges: DataFrame, group: list[str]) -> DataFrame:
    """Rows of the open ranges, each with its place in an even split of its range."""
    open_ranges = ranges.where("_low < _high").select(
        *[F.col(g).alias(f"_t{g}") for g in group],
        F.col("_base").alias("_tbase"),
        F.col("_range").alias("_trange"),
        "_low", "_high", "_n", "_from",
    )
    same = (F.col("_base") == F.col("_tbase")) & (F.col("_range") == F.col("_trange"))
    for g in group:
        same = same & F.col(g).eqNullSafe(F.col(f"_t{g}"))
    low, high = F.col("_low").cast("double"), F.col("_high").cast("double")
    place = F.try_divide(F.col("_v").cast("double") - low, high - low) * F.lit(RANGES)
    plain = rows.drop("_n")
    return plain.join(open_ranges, same).select(
        *group, "_v", F.col("_from").alias("_base"), "_n",
        F.coalesce(F.floor(F.least(place, F.lit(2.0e9))), F.lit(0)).cast("int").alias("_range"),
    )


def _ranked(rows: DataFrame, group: list[str]) -> DataFrame:
    """Ranks of the distinct values of each open range, combined before they are sorted."""
    counted = rows.groupBy(*group, "_base", "_n", "_v").agg(F.count(F.lit(1)).alias("_rows"))
    upto = Window.partitionBy(*group, "_base").orderBy("_v").rowsBetween(Window.unboundedPreceding, 0)
    return counted.withColumn("_to", F.col("_base") + F.sum("_rows").over(upto)).select(
        *group, "_n", (F.col("_to") - F.col("_rows")).alias("_from"), "_to", "_v"
    )
