"""Dated intervals: who was where on a day, rosters, change days.

Both interval ends are inclusive, so a day on which one interval ends and the next starts gives two
rows; intervals with a missing bound match nothing.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortspark.functions.dates import epoch_day
from cohortspark.functions.nulls import not_isin_safe
from cohortspark.operators.relational import keep_first, lookup, union_distinct
from cohortspark.session import staged

#: cell widths in days; an interval is stored at the first width that covers it with few cells, and the
#: last covers the whole calendar with few
CELL_WIDTHS = (64, 4096, 131_072)
CELLS_PER_INTERVAL = 32


def _cell(day: Column, width: int) -> Column:
    return F.floor(epoch_day(day) / F.lit(width)).cast("int")


def _code(cell: Column, level: Column, widths: Sequence[int]) -> Column:
    return cell * F.lit(len(widths)) + level


def interval_join(
    points: DataFrame,
    intervals: DataFrame,
    keys: Sequence[str],
    day: str,
    start: str,
    end: str,
    widths: Sequence[int] = CELL_WIDTHS,
) -> DataFrame:
    """Every (point, interval) pair with equal keys and ``start <= day <= end``.

    The equi key is (keys, level and cell) rather than keys alone: a hot key spreads over its calendar
    cells, and a point meets only intervals that touch its own cell. Short intervals live at the fine
    level, long or open-ended ones at the coarse level, so an interval never becomes many rows and
    every pair is found exactly once. A point becomes one row per level; ``cell_widths`` finds the
    levels that intervals need.
    """
    length = F.datediff(end, start)
    level = F.lit(len(widths) - 1)
    for i in reversed(range(len(widths) - 1)):
        level = F.when(length <= widths[i] * CELLS_PER_INTERVAL, F.lit(i)).otherwise(level)
    # only the chosen level's cells are made
    own = F.sequence(_cell(F.col(start), widths[-1]), _cell(F.col(end), widths[-1]))
    for i in reversed(range(len(widths) - 1)):
        own = F.when(
            F.col("_level") == i, F.sequence(_cell(F.col(start), widths[i]), _cell(F.col(end), widths[i]))
        ).otherwise(own)
    stored = intervals.filter(F.col(start) <= F.col(end)).withColumn("_level", level).withColumn("_cell", F.explode(own))
    dated = points.filter(F.col(day).isNotNull())
    if len(widths) == 1:
        stored, probes = stored.drop("_level"), dated.withColumn("_cell", _cell(F.col(day), widths[0]))
    else:
        # level and cell in one number: shuffled and sorted rows are a column shorter
        stored = stored.withColumn("_cell", _code(F.col("_cell"), F.col("_level"), widths)).drop("_level")
        cells = [_code(_cell(F.col(day), w), F.lit(i), widths) for i, w in enumerate(widths)]
        probes = dated.withColumn("_cell", F.explode(F.array(*cells)))
    return (
        probes.join(stored, [*keys, "_cell"], "inner")
        .filter((F.col(start) <= F.col(day)) & (F.col(day) <= F.col(end)))
        .drop("_cell")
    )


def cell_widths(intervals: DataFrame, start: str, end: str) -> tuple[int, ...]:
    """Widths for ``interval_join`` that suit these intervals: as few levels as store each in few cells; one pass, 24 counts at most.

    A point becomes one row per level, so levels that no interval needs only cost. The finest cell is about as wide as the middle
    interval (64 days at least), so most intervals touch one or two cells.
    """
    days = F.datediff(end, start) + 1
    found = intervals.filter(F.col(start) <= F.col(end)).groupBy(F.length(F.bin(days)).alias("bits")).count().collect()
    counts = sorted((r["bits"], r["count"]) for r in found)
    total, before, middle = sum(n for _, n in counts), 0, CELL_WIDTHS[0]
    for bits, n in counts:
        before += n
        if 2 * before >= total:
            middle = max(CELL_WIDTHS[0], 1 << bits)
            break
    longest = 1 << (counts[-1][0] if counts else 0)
    widths = [middle]
    while longest > widths[-1] * CELLS_PER_INTERVAL:
        widths.append(64 * widths[-1])
    return tuple(widths)


def interval_membership(
    points: DataFrame,
    intervals: DataFrame,
    key: str,
    day: str,
    start: str,
    end: str,
    keep: str = "all",
    unique: bool = False,
) -> DataFrame:
    """Attributes of the intervals each distinct (key, day) falls in.

    ``keep='first'|'last'`` leaves one row on a change day: the interval that started earlier or later. ``unique`` says that
    the points hold each (key, day) once already, which saves the shuffle that would make them so.
    """
    # read for its lengths, then joined
    intervals = staged(intervals)
    widths = cell_widths(intervals, start, end)
    wanted = points.select(key, day)
    found = interval_join(wanted if unique else wanted.distinct(), intervals, [key], day, start, end, widths)
    if keep == "last":
        found = found.withColumn("_late", -epoch_day(F.col(start)))
        found = keep_first(found, [key, day], "_late").drop("_late")
    elif keep == "first":
        found = keep_first(found, [key, day], start)
    elif keep != "all":
        raise ValueError("keep must be 'all', 'first' or 'last'")
    return found.drop(start, end)


def group_roster(
    group_days: DataFrame, intervals: DataFrame, group: str, day: str, member: str, start: str, end: str
) -> DataFrame:
    """All members of each distinct (group, day)."""
    wanted = group_days.select(group, day).distinct()
    found = interval_join(
        wanted, intervals.select(group, member, start, end), [group], day, start, end
    )
    return found.select(group, member, day)


def groups_at_offsets(
    entities: DataFrame,
    intervals: DataFrame,
    key: str,
    anchors: dict[str, tuple[str, int]],
    group: str,
    start: str,
    end: str,
    exclude: Sequence[str] = (),
) -> DataFrame:
    """Group of each entity some days after an anchor date; the earlier interval on a change day.

    ``anchors`` maps an output column to (anchor date column, days). All dates share one interval join
    and one aggregation; entities without any group drop out.
    """
    dates = F.array(
        *[
            F.struct(F.lit(out).alias("_which"), F.date_add(anchor, days).alias("_day"))
            for out, (anchor, days) in anchors.items()
        ]
    )
    wanted = entities.select(key, F.inline(dates))
    usable = intervals.select(key, group, start, end).filter(not_isin_safe(F.col(group), exclude))
    found = interval_join(wanted, usable, [key], "_day", start, end)
    # min_by skips rows whose order is NULL, i.e. rows of the other dates
    order = F.struct(start, group)
    return found.groupBy(key).agg(
        *[F.min_by(group, F.when(F.col("_which") == out, order)).alias(out) for out in anchors]
    )


def group_at_offset(
    entities: DataFrame,
    intervals: DataFrame,
    key: str,
    anchor: str,
    days: int,
    group: str,
    start: str,
    end: str,
    out: str,
    exclude: Sequence[str] = (),
) -> DataFrame:
    return groups_at_offsets(
        entities, intervals, key, {out: (anchor, days)}, group, start, end, exclude
    )


def change_day_flag(
    points: DataFrame, membership: DataFrame, keys: Sequence[str], group: str, out: str = "change_day"
) -> DataFrame:
    """"Yes" where a (key, day) lies in more than one distinct group, else "No"."""
    # more than one distinct group: the smallest and the largest differ; one shuffle instead of a distinct count's two
    doubled = (
        membership.groupBy(*keys)
        .agg(F.min(group).alias("_least"), F.max(group).alias("_most"))
        .filter(F.col("_least") != F.col("_most"))
        .select(*keys, F.lit("Yes").alias(out))
    )
    return lookup(points, doubled, list(keys)).fillna("No", subset=[out])


def declared_vs_derived(
    rows: DataFrame,
    membership: DataFrame,
    keys: Sequence[str],
    declared: str,
    derived: str,
    exclude_change_days: bool = False,
    out: str = "agrees",
) -> DataFrame:
    """Recorded group against the group derived from membership, per derived row."""
    if exclude_change_days:
        # a day with a single group: its smallest and largest group are the same
        per_day = membership.groupBy(*keys).agg(
            F.min(derived).alias(derived), F.max(derived).alias("_other"), F.count(F.lit(1)).alias("_n")
        )
        membership = per_day.filter(F.col(derived) == F.col("_other")).select(
            *keys, derived, F.explode(F.array_repeat(F.lit(True), F.col("_n").cast("int"))).alias("_row")
        )
    both = lookup(rows, membership.select(*keys, derived), list(keys), "inner")
    return both.withColumn(
        out, F.when(F.col(declared) == F.col(derived), "Yes").otherwise("No")
    )


def roster_union(queried: DataFrame, observed: DataFrame, member: str) -> DataFrame:
    """Members known from intervals together with those actually seen; ids upper-cased."""
    upper = {member: F.upper(F.col(member).cast("string"))}
    return union_distinct(queried.withColumns(upper), observed.withColumns(upper))


def select_in_period(
    periods: DataFrame, events: DataFrame, key: str, event_day: str, newest: str, oldest: str
) -> DataFrame:
    """Distinct (period, event) pairs with ``oldest <= event day <= newest``, both ends inclusive.

    Periods last months, so one level of cells is enough.
    """
    return interval_join(events, periods, [key], event_day, oldest, newest).distinct()
