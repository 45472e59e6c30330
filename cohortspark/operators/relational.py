"""Joins, set operations, grouping and reshaping with the NULL and ordering rules spelled out.

Nothing here puts a whole group into one task: group-wide values are partial aggregates joined back,
first-row-per-key is an aggregate, and category skeletons are generated per row.
"""

from __future__ import annotations

import re
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_RIGHT = "__right_"


def _as_list(cols) -> list[str]:
    return [cols] if isinstance(cols, str) else list(cols)


def _null_safe(pairs: Sequence[tuple[str, str]]) -> Column:
    return reduce(lambda a, b: a & b, [F.col(a).eqNullSafe(F.col(b)) for a, b in pairs])


def common_columns(left: DataFrame, right: DataFrame) -> list[str]:
    return [c for c in left.columns if c in set(right.columns)]


def natural_join(
    left: DataFrame, right: DataFrame, how: str = "inner", on: Sequence[str] | str | None = None
) -> DataFrame:
    """Join on ``on`` (default: all common columns) where NULL keys match NULL keys.

    Key columns appear once. Non-key columns present on both sides are an error.
    """
    keys = _as_list(on) if on is not None else common_columns(left, right)
    if not keys:
        raise ValueError("no common column to join on")
    if how in ("left_semi", "left_anti"):
        right = right.select(*keys)
    else:
        clash = (set(left.columns) & set(right.columns)) - set(keys)
        if clash:
            raise ValueError(f"columns on both sides but not join keys: {sorted(clash)}")
    renamed = right.withColumnsRenamed({k: _RIGHT + k for k in keys})
    joined = left.join(renamed, _null_safe([(k, _RIGHT + k) for k in keys]), how)
    if how in ("left_semi", "left_anti"):
        return joined
    if how in ("full", "outer", "full_outer", "right", "right_outer"):
        joined = joined.withColumns({k: F.coalesce(F.col(k), F.col(_RIGHT + k)) for k in keys})
    return joined.drop(*[_RIGHT + k for k in keys])


def heavy_keys(df: DataFrame, keys: Sequence[str], limit: int) -> DataFrame:
    """(keys, __parts) of the keys with more than ``limit`` rows, into so many parts they are cut; at most rows / limit keys."""
    counts = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("__n"))
    return counts.filter(F.col("__n") > limit).select(*keys, F.ceil(F.col("__n") / limit).cast("int").alias("__parts"))


def heavy_join(
    left: DataFrame, right: DataFrame, how: str = "inner", on: Sequence[str] | str | None = None, limit: int | None = None
) -> DataFrame:
    """``natural_join`` where a key, NULL too, may hold any share of the left rows.

    Keys with more than ``limit`` left rows (default: a quarter of a shuffle partition's even share) are counted first, with map-side
    combine. Their left rows are dealt over several salts by a hash of the whole row, their right rows are repeated once per salt, all
    others keep salt 0: one shuffle of each side as before, and no task gets much more than ``limit`` rows of one key. ``how`` is inner,
    left, left_semi, left_anti or full; a full join adds the right rows whose key the left side lacks.
    """
    keys = _as_list(on) if on is not None else common_columns(left, right)
    if how in ("full", "outer", "full_outer"):
        lone = natural_join(right, left.select(*keys).distinct(), "left_anti", keys)
        return heavy_join(left, right, "left", keys, limit).unionByName(lone, allowMissingColumns=True)
    if how not in ("inner", "left", "left_outer", "left_semi", "left_anti"):
        raise ValueError(f"not a kind of heavy join: {how}")
    if limit is None:
        partitions = int(left.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        limit = max(1, left.count() // (4 * partitions))
    # bounded: rows / limit keys, so a broadcast is safe
    heavy = F.broadcast(heavy_keys(left, keys, limit))
    parts = F.coalesce("__parts", F.lit(1))
    row = F.xxhash64(*[F.col(f"`{c}`") for c in left.columns])
    dealt = natural_join(left, heavy, "left", keys).withColumn("__salt", F.pmod(row, parts).cast("int")).drop("__parts")
    salts = F.explode(F.sequence(F.lit(0), parts - 1))
    if how in ("left_semi", "left_anti"):
        right = right.select(*keys).distinct()
    copied = natural_join(right, heavy, "left", keys).withColumn("__salt", salts).drop("__parts")
    return natural_join(dealt, copied, how, [*keys, "__salt"]).drop("__salt")


def join_on(left: DataFrame, right: DataFrame, pairs: dict[str, str], how: str = "inner") -> DataFrame:
    """Null-safe join on differently named keys (left name -> right name); right keys are dropped."""
    renamed = right.withColumnsRenamed({r: _RIGHT + r for r in pairs.values()})
    cond = _null_safe([(a, _RIGHT + b) for a, b in pairs.items()])
    return left.join(renamed, cond, how).drop(*[_RIGHT + r for r in pairs.values()])


def lookup(left: DataFrame, right: DataFrame, on: Sequence[str] | str, how: str = "left") -> DataFrame:
    """Join to a derived table whose keys are never NULL.

    Plain equality then equals the null-safe test, and Spark can reuse the partitioning the derived
    table already has.
    """
    return left.join(right, _as_list(on), how)


def semi(left: DataFrame, right: DataFrame, on=None) -> DataFrame:
    return natural_join(left, right, "left_semi", on)


def anti(left: DataFrame, right: DataFrame, on=None) -> DataFrame:
    """Rows of ``left`` with no partner in ``right``; with ``on=None`` this is EXCEPT on rows."""
    return natural_join(left, right, "left_anti", on)


def union_rows(*frames: DataFrame) -> DataFrame:
    """Stack by column name; columns missing from a frame become NULL."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def union_distinct(*frames: DataFrame) -> DataFrame:
    return union_rows(*frames).distinct()


def nulls_last(cols: Sequence[str]) -> Column:
    """One sortable value for several columns, NULLs after everything else."""
    return F.struct(*[x for c in cols for x in (F.col(c).isNull(), F.col(c))])


def keep_first(df: DataFrame, keys: Sequence[str] | str, order: Sequence[str] | str) -> DataFrame:
    """One whole row per key: the first by ``order``, NULLs last.

    An aggregate, so duplicates collapse before the shuffle and a hot key never sits in one task.
    """
    keys, order = _as_list(keys), _as_list(order)
    rest = [c for c in df.columns if c not in keys]
    if not rest:
        return df.distinct()
    ranked = nulls_last(order + [c for c in rest if c not in order])
    best = df.groupBy(*keys).agg(F.min_by(F.struct(*rest), ranked).alias("_row"))
    return best.select(*keys, "_row.*").select(*df.columns)


def group_values(df: DataFrame, keys: Sequence[str] | str, **aggs: Column) -> DataFrame:
    """Attach group aggregates to every row of the group (partial aggregate, then equi join)."""
    keys = _as_list(keys)
    totals = df.groupBy(*keys).agg(*[c.alias(n) for n, c in aggs.items()])
    return natural_join(df, totals, "inner", keys)


def keep_extreme(df: DataFrame, keys: Sequence[str] | str, value: str, which: str = "min") -> DataFrame:
    """Rows whose value equals the group's minimum or maximum; ties stay, NULL values go."""
    agg = {"min": F.min, "max": F.max}[which]
    best = df.groupBy(*_as_list(keys)).agg(agg(value).alias(value))
    return natural_join(df, best.filter(F.col(value).isNotNull()), "left_semi", [*_as_list(keys), value])


def duplicates(df: DataFrame, keys: Sequence[str] | str, count: str = "n") -> DataFrame:
    """Rows whose key occurs more than once, with the number of occurrences."""
    keys = _as_list(keys)
    repeated = df.groupBy(*keys).agg(F.count(F.lit(1)).alias(count)).filter(F.col(count) > 1)
    return natural_join(df, repeated, "inner", keys)


def levels(df: DataFrame, column: str, most: int = 1000) -> list:
    """The values of a column in order, without NULL; more than ``most`` are an error, so what reaches the driver is bounded."""
    found = df.filter(F.col(column).isNotNull()).select(F.col(column).alias("v")).distinct().limit(most + 1).collect()
    if len(found) > most:
        raise ValueError(f"{column} has more than {most} levels")
    return sorted(r["v"] for r in found)


def contingency(
    df: DataFrame, rows: Sequence[str] | str, column: str, values: Sequence | None = None, most: int = 1000
) -> DataFrame:
    """Counts of ``column`` values as columns, zero-filled; the value list fixes the column order (default: ``levels``).

    Conditional aggregates need one shuffle where ``pivot`` needs two.
    """
    values = levels(df, column, most) if values is None else values
    cells = [F.count(F.when(F.col(column) == v, 1)).alias(str(v)) for v in values]
    # a column without values has no cells
    return df.groupBy(*_as_list(rows)).agg(*cells) if cells else df.select(*_as_list(rows)).distinct()


def to_wide(
    df: DataFrame,
    rows: Sequence[str] | str,
    column: str,
    values: Sequence | None,
    value: str,
    default=0,
    most: int = 1000,
) -> DataFrame:
    """Sum of ``value`` per category as columns; without a value list (None) for all ``levels`` of the column."""
    cells = []
    for v in levels(df, column, most) if values is None else values:
        total = F.sum(F.when(F.col(column) == v, F.col(value)))
        cells.append((total if default is None else F.coalesce(total, F.lit(default))).alias(str(v)))
    # a column without values has no cells
    return df.groupBy(*_as_list(rows)).agg(*cells) if cells else df.select(*_as_list(rows)).distinct()


def to_long(
    df: DataFrame, ids: Sequence[str] | str, columns: Sequence[str], name: str, value: str
) -> DataFrame:
    return df.unpivot(
        [F.col(f"`{c}`") for c in _as_list(ids)], [F.col(f"`{c}`") for c in columns], name, value
    )


def group_by_all_but(df: DataFrame, column: str):
    return df.groupBy(*[c for c in df.columns if c != column])


def make_names(df: DataFrame) -> DataFrame:
    """Column names as plain identifiers: every other character becomes a dot."""
    return df.toDF(*[syntactic(c) for c in df.columns])


def syntactic(name: str) -> str:
    clean = re.sub(r"[^A-Za-z0-9._]", ".", name)
    return clean if re.match(r"[A-Za-z.]", clean) else "X" + clean
