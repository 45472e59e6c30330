"""Sequence numbers, ranks, neighbour counts and quantiles that survive a hot group.

A window over raw rows would sort a hot group in one task. Each function here first aggregates to
buckets (a day, or a slice of the value range), numbers the buckets per group, and only then works
inside a bucket. The bucket tables are bounded by the calendar or the value range, not by row count.
"""

from __future__ import annotations

from collections.abc import Sequence
from decimal import Decimal

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cohortspark.operators.relational import natural_join
from cohortspark.session import discard, last_staged, staged

#: width of an id slice when a unique integer id breaks ties inside a day; suits consecutively assigned
#: ids, which then put at most this many rows into one window partition
ID_SLICE = 1 << 20


def _asc(cols: Sequence[str]) -> list[Column]:
    return [F.col(c).asc_nulls_last() for c in cols]


def _before(w, n: str) -> Column:
    return F.coalesce(F.sum(n).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))


def day_table(df: DataFrame, keys: Sequence[str], day: str) -> DataFrame:
    """One row per (keys, day): rows that day, rows before, day number, previous and next day."""
    w = Window.partitionBy(*keys).orderBy(F.col(day).asc_nulls_last())
    days = df.groupBy(*keys, day).agg(F.count(F.lit(1)).alias("n_rows"))
    return days.select(
        *keys,
        day,
        "n_rows",
        _before(w, "n_rows").cast("bigint").alias("rows_before"),
        F.when(F.col(day).isNotNull(), F.row_number().over(w).cast("bigint")).alias("day_no"),
        F.lag(day).over(w).alias("previous_day"),
        F.lead(day).over(w).alias("next_day"),
    )


def id_slice(df: DataFrame, column: str, rows: int | None = None) -> int:
    """A slice width that holds about ``rows`` rows where ids are spread evenly, such as hashes; one pass."""
    rows = rows or ID_SLICE
    r = df.agg(F.min(column), F.max(column), F.count(column)).first()
    return 1 if not r[2] else max(1, -(-(r[1] - r[0] + 1) * rows // r[2]))


def _buckets(df: DataFrame, order: Sequence[str], width: int | None = None) -> dict[str, Column]:
    """Coarse sort keys: days as they are, then the first integer column in slices."""
    width = width or ID_SLICE
    out = {}
    for i, c in enumerate(order):
        kind = df.schema[c].dataType
        if isinstance(kind, T.DateType):
            out[f"_b{i}"] = F.col(c)
            continue
        if isinstance(kind, T.IntegralType):
            out[f"_b{i}"] = F.floor(F.col(c).cast("decimal(20,0)") / F.lit(width).cast("decimal(20,0)"))
        break
    if not out:
        raise ValueError("the order must begin with a date or an integer column")
    return out


def number_rows(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    out: str,
    counted: DataFrame | None = None,
    width: int | None = None,
) -> DataFrame:
    """``row_number`` over ``keys`` ordered by ``order``, NULLs last.

    ``width`` is that of an id slice: the default suits consecutive ids, ``id_slice`` gives one for sparse ids.
    The order begins with days and unique integer ids; these cut a hot group into buckets. When
    several numbers are attached in a row, ``counted`` is the common starting frame (same rows), so
    that the plan grows by one branch per number instead of doubling.
    """
    keys, order = list(keys), list(order)
    buckets = _buckets(df, order, width)
    names = list(buckets)
    # one non-null key per bucket: the window and the join below share its partitioning
    key = F.struct(*keys, *[c.alias(b) for b, c in buckets.items()])
    tagged = df.withColumn("_key", key)
    start = df if counted is None else counted
    sizes = start.groupBy(key.alias("_key")).agg(F.count(F.lit(1)).alias("_n"))
    across = Window.partitionBy(*[f"_key.{k}" for k in keys]).orderBy(
        *[F.col(f"_key.{b}").asc_nulls_last() for b in names]
    )
    offsets = sizes.select("_key", _before(across, "_n").alias("_offset"))
    inside = Window.partitionBy("_key").orderBy(*_asc(order))
    return (
        tagged.withColumn("_in", F.row_number().over(inside))
        .join(offsets, "_key")
        .withColumn(out, (F.col("_offset") + F.col("_in")).cast("bigint"))
        .drop("_key", "_in", "_offset")
    )


def global_order(
    df: DataFrame, order: Sequence[str | Column], out: str = "row_no", partitions: int | None = None
) -> DataFrame:
    """All rows with their place (from 1) in the order over the whole frame, NULLs last unless a given order says else.

    The frame is written once, dealt into ranges of the order and sorted inside each; a row's number is its place in its range plus
    the rows of the ranges before it. One small count per range reaches the driver, no task holds all rows. The row's place in
    the written frame is the last key, so equal rows, however many, are spread over ranges as well and every row gets a number of its own.
    Staged twice in the shared folder; the first copy is deleted.
    """
    spark, keys = df.sparkSession, [F.col(c).asc_nulls_last() if isinstance(c, str) else c for c in order]
    first = staged(df)
    path = last_staged()
    # the file scan below reads the same files in the same splits, so this number is the same whenever a task runs again
    keyed = first.withColumn("__tie", F.monotonically_increasing_id())
    keys = [*keys, F.col("__tie")]
    dealt = keyed.repartitionByRange(partitions, *keys) if partitions else keyed.repartitionByRange(*keys)
    ranged = dealt.sortWithinPartitions(*keys).withColumn("__place", F.monotonically_increasing_id()).drop("__tie")
    held = staged(ranged)
    discard(spark, path)
    part = F.shiftright("__place", 33)
    sizes = {r["part"]: r["n"] for r in held.groupBy(part.alias("part")).agg(F.count(F.lit(1)).alias("n")).collect()}
    before, offsets = 0, []
    for p in sorted(sizes):
        offsets.append((p, before))
        before += sizes[p]
    if not offsets:
        return held.withColumn(out, F.lit(1).cast("bigint")).drop("__place")
    table = spark.createDataFrame(offsets, "__part bigint, __before bigint")
    inside = F.col("__place").bitwiseAND(F.lit((1 << 33) - 1))
    # one row per range: bounded by the number of partitions
    numbered = held.withColumn("__part", part).join(F.broadcast(table), "__part")
    return numbered.withColumn(out, (F.col("__before") + inside + 1).cast("bigint")).drop("__part", "__before", "__place")


def shifted(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    columns: dict[str, str],
    how: str = "lead",
    width: int | None = None,
) -> DataFrame:
    """The next (``lead``) or previous (``lag``) row's values within ``keys``; ``columns`` maps a column to its new name.

    The order must be unique within a group, begins like that of ``number_rows`` and has NULLs last. The window runs inside a
    bucket; the first (last) row of every bucket is found with map-side combine and carried to the end (start) of the
    bucket before (after) it, so that a group of any size spreads over tasks. No neighbour gives NULL.
    """
    if how not in ("lead", "lag"):
        raise ValueError("how is lead or lag")
    keys, order, names = list(keys), list(order), list(columns)
    buckets = _buckets(df, order, width)
    key = F.struct(*keys, *[c.alias(b) for b, c in buckets.items()])
    place = F.struct(*[f(c) for c in order for f in (lambda c: F.col(c).isNull(), F.col)])
    row = F.struct(*[F.col(c).alias(f"v{i}") for i, c in enumerate(names)])
    edge, move = (F.min_by, F.lead) if how == "lead" else (F.max_by, F.lag)
    edges = df.groupBy(key.alias("_key")).agg(edge(row, place).alias("_edge"))
    across = Window.partitionBy(*[f"_key.{k}" for k in keys]).orderBy(
        *[F.col(f"_key.{b}").asc_nulls_last() for b in buckets]
    )
    edges = edges.select("_key", move("_edge").over(across).alias("_edge"))
    inside = Window.partitionBy("_key").orderBy(*_asc(order))
    near = df.withColumn("_key", key).withColumn("_row", row)
    near = near.withColumn("_row", move("_row").over(inside)).join(edges, "_key")
    # a neighbour inside the bucket is never NULL itself, only its values may be
    near = near.withColumn("_row", F.coalesce("_row", "_edge"))
    return near.select(*df.columns, *[F.col(f"_row.v{i}").alias(columns[c]) for i, c in enumerate(names)])


def number_days(
    df: DataFrame, keys: Sequence[str], day: str, out: str, counted: DataFrame | None = None
) -> DataFrame:
    """``dense_rank`` of the day per group; NULL days get NULL."""
    w = Window.partitionBy(*keys).orderBy(day)
    start = df if counted is None else counted
    days = start.filter(F.col(day).isNotNull()).select(*keys, day).distinct()
    return natural_join(
        df, days.withColumn(out, F.row_number().over(w).cast("bigint")), "left", [*keys, day]
    )


def _grain(df: DataFrame, value: str) -> Decimal | None:
    """Smallest step between two values of an exact type; None for floating point."""
    kind = df.schema[value].dataType
    if isinstance(kind, T.DecimalType):
        return Decimal(1).scaleb(-kind.scale)
    return Decimal(1) if isinstance(kind, T.IntegralType) else None


def value_table(
    df: DataFrame,
    keys: Sequence[str],
    value: str,
    thresholds: dict[str, object],
    rank: str,
    width: float,
) -> DataFrame:
    """Per (keys, value): rank of the value from the top and, per threshold, the rows strictly nearer.

    Values are cut into slices of ``width`` (at least the largest threshold). A slice sees its two
    neighbours as halo rows, so counts inside one slice are complete.
    """
    if any(t > width for t in thresholds.values()):
        raise ValueError("width must be at least the largest threshold")
    keys = list(keys)
    counts = df.filter(F.col(value).isNotNull()).groupBy(*keys, value).agg(
        F.count(F.lit(1)).alias("_n")
    )
    sliced = counts.withColumn("_slice", F.floor(F.col(value) / F.lit(width)).cast("bigint"))
    if thresholds:
        halo = sliced.withColumn("_home", F.col("_slice")).withColumn(
            "_slice", F.explode(F.array(*[F.col("_slice") + d for d in (-1, 0, 1)]))
        )
    else:
        halo = sliced.withColumn("_home", F.col("_slice"))
    own = F.when(F.col("_home") == F.col("_slice"), F.col("_n")).otherwise(0)
    part = ", ".join(f"`{c}`" for c in [*keys, "_slice"])
    near = {}
    grain = _grain(df, value)
    for name, t in thresholds.items():
        if grain is not None:
            # values are multiples of the grain: "less than t" is "at most t minus one grain"
            reach = Decimal(str(t)) - grain
            near[name] = F.expr(
                f"sum(_n) over (partition by {part} order by `{value}`"
                f" range between {reach} preceding and {reach} following) - 1"
            ).cast("bigint")
            continue
        inclusive = f"partition by {part} order by `{value}` range between"
        # RANGE frames include both ends; values exactly at the threshold are taken off again
        near[name] = F.expr(
            f"sum(_n) over ({inclusive} {t} preceding and {t} following)"
            f" - coalesce(sum(_n) over ({inclusive} {t} preceding and {t} preceding), 0)"
            f" - coalesce(sum(_n) over ({inclusive} {t} following and {t} following), 0) - 1"
        ).cast("bigint")
    down = Window.partitionBy(*keys, "_slice").orderBy(F.col(value).desc())
    local = (
        halo.withColumn("_own", own)
        .withColumns({**near, "_above": _before(down, "_own")})
        .filter(F.col("_home") == F.col("_slice"))
    )
    slices = sliced.groupBy(*keys, "_slice").agg(F.sum("_n").alias("_m"))
    higher = Window.partitionBy(*keys).orderBy(F.col("_slice").desc())
    offsets = slices.select(*keys, "_slice", _before(higher, "_m").alias("_higher"))
    ranked = natural_join(local, offsets, "inner", [*keys, "_slice"])
    return ranked.select(
        *keys,
        value,
        (F.col("_higher") + F.col("_above") + 1).cast("bigint").alias(rank),
        *thresholds,
    )


def summary_stats(
    df: DataFrame, value: str, by: Sequence[str] = (), width: float | None = None, slices: int = 1024
) -> DataFrame:
    """Minimum, quartiles (linear interpolation), mean, maximum and NULL count, exact.

    Without a ``width`` the value range is cut into ``slices`` slices, which takes one more pass.
    Works on value counts: ranks come from slice totals plus ranks inside a slice, so no task ever
    holds all values of a group.
    """
    by = list(by) or ["_all"]
    if width is None:
        low, high = df.agg(F.min(value).cast("double"), F.max(value).cast("double")).first()
        width = (high - low) / slices if low is not None and high > low else 1.0
    base = df if by != ["_all"] else df.withColumn("_all", F.lit(1))
    # the only pass over the rows; everything below works on distinct values
    every = base.groupBy(*by, value).agg(F.count(F.lit(1)).alias("_n"))
    known = F.when(F.col(value).isNotNull(), F.col("_n"))
    totals = every.groupBy(*by).agg(
        F.min(value).alias("min"),
        F.try_divide(F.sum(F.col(value) * F.col("_n")), F.sum(known)).alias("mean"),
        F.max(value).alias("max"),
        F.coalesce(F.sum(known), F.lit(0)).alias("_count"),
        F.coalesce(F.sum(F.when(F.col(value).isNull(), F.col("_n"))), F.lit(0)).alias("n_null"),
    )
    # NULLs stay as a last slice: a filter would be pushed below the aggregate and scan the rows again
    counts = every.withColumn("_slice", F.floor(F.col(value) / F.lit(width)).cast("bigint"))
    sizes = counts.groupBy(*by, "_slice").agg(F.sum("_n").alias("_m"))
    lower = Window.partitionBy(*by).orderBy(F.col("_slice").asc_nulls_last())
    offsets = sizes.select(*by, "_slice", _before(lower, "_m").alias("_offset"))
    inside = Window.partitionBy(*by, "_slice").orderBy(value)
    placed = natural_join(
        counts.withColumn("_in", _before(inside, "_n")), offsets, "inner", [*by, "_slice"]
    ).select(*by, value, "_n", (F.col("_offset") + F.col("_in")).alias("_from"))
    placed = natural_join(placed, totals.select(*by, "_count"), "inner", by)

    def at(position: Column) -> Column:
        hit = (F.col("_from") <= position) & (position < F.col("_from") + F.col("_n"))
        return F.max(F.when(hit, F.col(value)))

    picks = []
    for name, p in (("q1", 0.25), ("median", 0.5), ("q3", 0.75)):
        position = (F.col("_count") - 1) * F.lit(p)
        picks += [at(F.floor(position)).alias(f"_{name}_lo"), at(F.ceil(position)).alias(f"_{name}_hi")]
    found = placed.groupBy(*by).agg(*picks)
    out = natural_join(totals, found, "left", by)

    def quantile(name: str, p: float) -> Column:
        position = (F.col("_count") - 1) * F.lit(p)
        lo, hi = F.col(f"_{name}_lo"), F.col(f"_{name}_hi")
        return (lo + (hi - lo) * (position - F.floor(position))).alias(name)

    keep = [] if by == ["_all"] else by
    return out.select(
        *keep,
        "min",
        quantile("q1", 0.25),
        quantile("median", 0.5),
        "mean",
        quantile("q3", 0.75),
        "max",
        "n_null",
    )
