"""Nearest-in-time lookups.

Points and observations are merged to one row per (key, day) before the window runs, so a window
partition holds at most one row per calendar day however many rows a key has.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cohortspark.functions.dates import day_diff
from cohortspark.operators.relational import lookup


def _timeline(
    points: DataFrame, days: DataFrame, key: str, day: str, payload: dict[str, Column] | None = None
) -> DataFrame:
    """Each distinct point day with ``_prev`` and ``_next``: the nearest observed days around it.

    ``payload`` maps columns of ``days`` to the aggregate that sums up one day.
    """
    payload = payload or {}
    at = points.select(key, day, F.lit(True).alias("_point"))
    seen = days.select(key, day, F.lit(False).alias("_point"), *payload)
    merged = (
        at.unionByName(seen, allowMissingColumns=True)
        .filter(F.col(key).isNotNull() & F.col(day).isNotNull())
        .groupBy(key, day)
        .agg(
            F.max("_point").alias("_point"),
            F.max(~F.col("_point")).alias("_seen"),
            *[agg.alias(c) for c, agg in payload.items()],
        )
    )
    found = F.when(F.col("_seen"), F.struct(F.col(day).alias("day"), *payload))
    back = Window.partitionBy(key).orderBy(F.col(day))
    # "next" is "last seen" on the reversed order: a frame open to the right is quadratic
    ahead = Window.partitionBy(key).orderBy(F.col(day).desc())
    return merged.select(
        key,
        day,
        "_point",
        F.last(found, ignorenulls=True).over(back).alias("_prev"),
        F.last(found, ignorenulls=True).over(ahead).alias("_next"),
    ).filter("_point")


def nearest_observation(
    points: DataFrame,
    observations: DataFrame,
    key: str,
    day: str,
    obs_day: str,
    value: str,
    direction: str = "nearest",
    diff: str = "day_diff",
) -> DataFrame:
    """Mean of all observations at the smallest distance from each distinct (key, day).

    ``nearest`` looks both ways, averages both sides on a tie and returns the unsigned distance;
    ``forward`` and ``backward`` return the signed distance. Points without a match drop out. A NULL
    among the observations averaged makes the mean NULL.
    """
    obs = observations.select(
        F.col(key),
        F.col(obs_day).alias(day),
        F.col(value).alias("_sum"),
        F.lit(1).alias("_rows"),
        F.when(F.col(value).isNotNull(), 1).otherwise(0).alias("_known"),
    )
    daily = {c: F.sum(c) for c in ("_sum", "_rows", "_known")}
    line = _timeline(points, obs, key, day, daily)

    def total(field: str, *sides: Column) -> Column:
        cols = [F.coalesce(s[field], F.lit(0)) for s in sides]
        return cols[0] if len(cols) == 1 else cols[0] + cols[1]

    def mean(*sides: Column) -> Column:
        complete = total("_known", *sides) == total("_rows", *sides)
        return F.when(complete, F.try_divide(total("_sum", *sides), total("_rows", *sides)))

    prev, nxt = F.col("_prev"), F.col("_next")
    to_prev = day_diff(F.col(day), prev["day"])
    to_next = day_diff(nxt["day"], F.col(day))
    if direction == "forward":
        distance, average = to_next, mean(nxt)
    elif direction == "backward":
        distance, average = -to_prev, mean(prev)
    elif direction == "nearest":
        only_prev = nxt.isNull() | (to_prev < to_next) | (to_prev == 0)
        only_next = prev.isNull() | (to_next < to_prev)
        distance = F.least(to_prev, to_next)
        average = F.when(only_prev, mean(prev)).when(only_next, mean(nxt)).otherwise(mean(prev, nxt))
    else:
        raise ValueError("direction must be 'nearest', 'forward' or 'backward'")
    return line.select(key, day, distance.alias(diff), average.alias(value)).filter(
        F.col(diff).isNotNull()
    )


def next_event_day(
    points: DataFrame, events: DataFrame, key: str, day: str, event_day: str, out: str
) -> DataFrame:
    """First event day at or after each distinct (key, day); NULL when there is none."""
    line = _timeline(points, events.select(key, F.col(event_day).alias(day)), key, day)
    return line.select(key, day, F.col("_next")["day"].alias(out))


def previous_event_day(
    points: DataFrame, events: DataFrame, key: str, day: str, event_day: str, out: str
) -> DataFrame:
    """Last event day at or before each distinct (key, day); NULL when there is none."""
    line = _timeline(points, events.select(key, F.col(event_day).alias(day)), key, day)
    return line.select(key, day, F.col("_prev")["day"].alias(out))


def next_event(
    points: DataFrame, events: DataFrame, key: str, day: str, event_day: str, diff: str = "day_diff"
) -> DataFrame:
    """All events on the first event day at or after each point; the difference is zero or negative."""
    upcoming = next_event_day(points, events, key, day, event_day, "_next_day")
    joined = upcoming.join(
        events.withColumnRenamed(event_day, "_next_day"), [key, "_next_day"], "inner"
    )
    return joined.withColumn(diff, day_diff(F.col(day), F.col("_next_day"))).withColumnRenamed(
        "_next_day", "next_" + event_day
    )


def attribute_pairing(
    events: DataFrame,
    pairings: DataFrame,
    key: str,
    event_day: str,
    pairing_day: str,
    pairing_group: str,
    min_gap: int = 80,
    diff: str = "day_diff",
) -> DataFrame:
    """Latest pairing more than ``min_gap`` days before each event; events without one drop out.

    Shifting the event back turns the gap test into a plain backward lookup. Two pairings on the same
    day resolve to the first group name.
    """
    shifted = events.withColumn("_latest", F.date_sub(event_day, min_gap + 1))
    dated = pairings.select(key, F.col(pairing_day).alias("_latest"), pairing_group)
    line = _timeline(shifted, dated, key, "_latest", {pairing_group: F.min(pairing_group)})
    found = line.filter(F.col("_prev").isNotNull()).select(
        key, "_latest", F.col("_prev")["day"].alias(pairing_day), F.col("_prev")[pairing_group].alias(pairing_group)
    )
    return (
        lookup(shifted, found, [key, "_latest"], "inner")
        .withColumn(diff, day_diff(F.col(event_day), F.col(pairing_day)))
        .drop("_latest")
    )
