"""Who an individual is and what its state was on a date; group composition on a date."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortspark.functions import status
from cohortspark.functions.dates import age, day_diff
from cohortspark.functions.nulls import count_where
from cohortspark.operators.intervals import CELL_WIDTHS, interval_join
from cohortspark.operators.ordering import value_table
from cohortspark.operators.relational import keep_first, lookup, natural_join


def entity_profile(
    ids: DataFrame,
    dimensions: Sequence[DataFrame],
    key: str,
    birth: str,
    death: str,
    out: str = "death_age",
) -> DataFrame:
    """Star of left joins on the key, death age in days, one row per individual."""
    wide = ids
    for dim in dimensions:
        wide = natural_join(wide, dim, "left", key)
    wide = wide.withColumn(out, day_diff(F.col(death), F.col(birth)))
    return keep_first(wide, key, [c for c in wide.columns if c != key])


def add_age(
    points: DataFrame, births: DataFrame, key: str, day: str, birth: str, units: dict[str, str]
) -> DataFrame:
    """Age at each point; ``units`` maps output column to 'days' or 'months'."""
    joined = natural_join(points, births.select(key, birth), "left", key)
    return joined.withColumns({o: age(F.col(day), F.col(birth), u) for o, u in units.items()})


def status_at_date(
    points: DataFrame,
    profile: DataFrame,
    key: str,
    day: str,
    founder: str,
    first_as_mother: str,
    first_as_father: str,
    gestation: int = 105,
    out: str = "status",
) -> DataFrame:
    joined = natural_join(points, profile, "inner", key)
    label = status.breeding_status(
        F.col(day), F.col(founder), F.col(first_as_mother), F.col(first_as_father), gestation
    )
    return joined.withColumn(out, label)


def event_offset(df: DataFrame, day: str, days: int = 88, out: str = "conception_day") -> DataFrame:
    """Date ``days`` before the event, e.g. conception from birth and gestation length."""
    return df.withColumn(out, F.date_sub(day, days))


def young_count(
    points: DataFrame,
    births: DataFrame,
    keys: Sequence[str],
    day: str,
    birth: str,
    max_age: int = 14,
    out: str = "young",
) -> DataFrame:
    """Births in the ``max_age`` days up to and including each distinct (keys, day); 0 when none."""
    wanted = points.select(*keys, day).distinct()
    spans = births.select(*keys, F.col(birth).alias("_born"), F.date_add(birth, max_age).alias("_until"))
    found = (
        # all spans are of one length, so one level of cells holds them
        interval_join(wanted, spans, keys, day, "_born", "_until", [max(CELL_WIDTHS[0], max_age)])
        .groupBy(*keys, day)
        .agg(F.count(F.lit(1)).alias(out))
    )
    return lookup(wanted, found, [*keys, day]).fillna(0, subset=[out])


def neighbour_count(
    rows: DataFrame, partition: Sequence[str], value: str, thresholds: dict[str, object], width: float
) -> DataFrame:
    """Other rows of the partition whose value differs by strictly less than each threshold.

    One NULL value in a partition makes all its counts NULL, as a strict sum does.
    """
    found = value_table(rows, list(partition), value, thresholds, "_rank", width).drop("_rank")
    gaps = rows.groupBy(*partition).agg(F.max(F.col(value).isNull()).alias("_gap"))
    out = natural_join(rows, found, "left", [*partition, value])
    return _strict(natural_join(out, gaps, "inner", list(partition)), "_gap", thresholds).drop("_gap")


def _strict(df: DataFrame, gap: str, names) -> DataFrame:
    return df.withColumns({n: F.when(~F.col(gap), F.col(n)) for n in names})


def group_profile(
    rows: DataFrame,
    group: str,
    day: str,
    sex: str,
    age_col: str,
    weight: str,
    thresholds: Sequence = (5, 10, 15, 20),
    weight_width: float = 20,
    age_width: float = 365,
    young_days: int = 14,
) -> DataFrame:
    """Group and same-sex queue composition attached to every row.

    Group: size, weight and age rank, competitors within each weight threshold, newborns (age < 1),
    young (age of at most ``young_days``), newborn presence, minimum age. Queue (group, day, sex): size, weight rank, competitors.
    """
    place = [group, day]
    queue = [group, day, sex]
    near = {f"comp_{t}": t for t in thresholds}
    near_queue = {f"comp_{t}_queue": t for t in thresholds}
    gap = F.max(F.col(weight).isNull())
    sizes = rows.groupBy(*place).agg(
        F.count(F.lit(1)).alias("group_size"),
        count_where(F.col(age_col) < 1).alias("pup_count"),
        count_where((F.col(age_col) >= 0) & (F.col(age_col) <= young_days)).alias("young_count"),
        F.min(age_col).alias("min_age"),
        gap.alias("_gap"),
    ).withColumn("pup_presence", F.when(F.col("pup_count") == 0, "No").otherwise("Yes"))
    queues = rows.groupBy(*queue).agg(
        F.count(F.lit(1)).alias("queue_size"), gap.alias("_queue_gap")
    )
    # the tables meet each other first: the rows themselves are joined three times, not five
    by_weight = natural_join(
        value_table(rows, queue, weight, near_queue, "weight_rank_queue", weight_width),
        value_table(rows, place, weight, near, "weight_rank", weight_width),
        "inner",
        [*place, weight],
    )
    by_age = value_table(rows, place, age_col, {}, "age_rank", age_width)
    out = natural_join(rows, natural_join(queues, sizes, "inner", place), "inner", queue)
    out = natural_join(out, by_weight, "left", [*queue, weight])
    out = natural_join(out, by_age, "left", [*place, age_col])
    out = _strict(out, "_gap", near)
    return _strict(out, "_queue_gap", near_queue).drop("_gap", "_queue_gap")


def young_per_group(
    rows: DataFrame, group: Sequence[str], age_col: str, max_age: int = 14
) -> DataFrame:
    """Number, youngest and oldest age of individuals no older than ``max_age`` per group."""
    is_young: Column = (F.col(age_col) >= 0) & (F.col(age_col) <= max_age)
    return rows.groupBy(*group).agg(
        F.count(F.lit(1)).alias("group_size"),
        count_where(is_young).alias("young"),
        F.min(F.when(is_young, F.col(age_col))).alias("youngest"),
        F.max(F.when(is_young, F.col(age_col))).alias("oldest_young"),
    )


def partner_info(
    dyads: DataFrame,
    info: DataFrame,
    actor: str,
    partner: str,
    key: str,
    columns: Sequence[str],
    dated: Callable[[Callable[[str], Column]], dict[str, Column]] | None = None,
) -> DataFrame:
    """Profile columns of actor and partner, prefixed, on every dyad.

    ``dated`` makes further columns that depend on the dyad's own ones, such as age or status on its
    day; it gets a function that gives a side's profile column. Both sides stay one join each.
    """
    out = dyads
    for role in (actor, partner):
        side = info.select(F.col(key).alias(role), *[F.col(c).alias(f"{role}_{c}") for c in columns])
        out = natural_join(out, side, "left", role)
        made = dated(lambda c, role=role: F.col(f"{role}_{c}")) if dated else {}
        out = out.withColumns({f"{role}_{n}": c for n, c in made.items()}) if made else out
    return out
