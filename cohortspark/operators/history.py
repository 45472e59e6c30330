"""Pairing and litter histories."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortspark.functions.dates import day_diff
from cohortspark.functions.nulls import not_isin_safe
from cohortspark.operators.asof import attribute_pairing
from cohortspark.operators.intervals import interval_membership
from cohortspark.operators.ordering import day_table, number_days, number_rows
from cohortspark.operators.profile import event_offset
from cohortspark.operators.relational import lookup, natural_join, union_rows
from cohortspark.session import staged

#: spellings of a father that stand for "not known" (fixed values)
UNKNOWN_FATHER = ("Unknown ", "Unknown")


def parent_events(
    litters: DataFrame,
    parentage: DataFrame,
    litter: str,
    mother: str,
    father: str,
    day: str,
    out: str,
    unknown: Sequence[str] = UNKNOWN_FATHER,
) -> DataFrame:
    """Litters in long form: one row for the mother, one per distinct known father."""
    mothers = litters.select(litter, F.upper(mother).alias(out), day)
    fathers = (
        litters.select(litter, day)
        .join(parentage.select(litter, father), litter, "inner")
        .filter(F.col(litter).isNotNull() & not_isin_safe(F.col(father), unknown))
        .select(litter, F.col(father).alias(out), day)
        .distinct()
    )
    return mothers.unionByName(fathers)


def pairing_sequence(pairings: DataFrame, key: str, group: str, day: str) -> DataFrame:
    """De-duplicated pairings numbered per individual, per individual and group, and per group date."""
    unique = pairings.select(key, group, day).distinct()
    out = number_rows(unique, [key], [day, group], "pairing_no")
    out = number_days(out, [key, group], day, "pairing_no_in_group", counted=unique)
    return number_days(out, [group], day, "group_pairing_no", counted=unique)


def event_group(
    events: DataFrame,
    intervals: DataFrame,
    key: str,
    day: str,
    group: str,
    start: str,
    end: str,
    gestation: int = 88,
) -> DataFrame:
    """Group on the event day and on the day ``gestation`` days earlier, both left joined."""
    dated = event_offset(events, day, gestation)
    spans = intervals.select(key, group, start, end)
    # one pass over the intervals answers both dates
    wanted = dated.select(key, day).unionByName(dated.select(key, F.col("conception_day").alias(day)))
    where = interval_membership(wanted, spans, key, day, start, end)
    at_birth = where.withColumnRenamed(group, "event_group")
    at_conception = where.withColumnsRenamed({group: "conception_group", day: "conception_day"})
    out = lookup(dated, at_birth, [key, day])
    return lookup(out, at_conception, [key, "conception_day"])


def event_history(
    events: DataFrame,
    sexes: DataFrame,
    pairings: DataFrame,
    intervals: DataFrame,
    key: str,
    event: str,
    day: str,
    pairing_day: str,
    pairing_group: str,
    group: str,
    start: str,
    end: str,
    gestation: int = 88,
    min_gap: int = 80,
) -> DataFrame:
    """Litter history: sex, attributed pairing, conception, groups, and the three event counters.

    Counters follow (event day, event id, conception group), after the conception group is attached.
    """
    paired = attribute_pairing(
        events, pairings, key, day, pairing_day, pairing_group, min_gap, "pairing_gap"
    ).select(key, event, day, pairing_day, pairing_group, "pairing_gap")
    dated = event_offset(events, day, gestation)
    spans = intervals.select(key, group, start, end)
    wanted = dated.select(key, day).unionByName(dated.select(key, F.col("conception_day").alias(day)))
    where = interval_membership(wanted, spans, key, day, start, end)
    at_conception = where.withColumnsRenamed({group: "conception_group", day: "conception_day"})
    at_birth = where.withColumnRenamed(group, "event_group").distinct()

    out = natural_join(dated, sexes, "left", key)
    out = lookup(out, paired, [key, event, day])
    base = staged(lookup(out, at_conception, [key, "conception_day"]))
    out = number_rows(base, [key], [day, event, "conception_group"], "event_no")
    out = number_rows(
        out, [key, "conception_group"], [day, event, "event_no"], "event_no_in_group", counted=base
    )
    out = number_days(out, ["conception_group"], "conception_day", "group_event_no", counted=base)
    return lookup(out, at_birth, [key, day]).distinct()


def breeder_membership(events: DataFrame, intervals: DataFrame, sexes: DataFrame, key: str) -> DataFrame:
    """Every interval of everyone who ever bred, with sex."""
    breeders = events.select(key).distinct()
    return natural_join(natural_join(breeders, intervals, "left", key), sexes, "left", key)


def pairing_timeline(
    cohort: DataFrame, pairings: DataFrame, key: str, pairing_day: str, tie: str, study_start: str
) -> DataFrame:
    """Per individual: nth pairing, date of the next one, days since study start.

    An individual without pairings keeps one row with number 1.
    """
    rows = natural_join(cohort, pairings, "left", key)
    days = day_table(rows, [key], pairing_day).select(
        key, pairing_day, "n_rows", "rows_before", F.col("next_day").alias("_next_day")
    )
    numbered = natural_join(
        number_rows(rows, [key], [pairing_day, tie], "pairing_no"), days, "inner", [key, pairing_day]
    )
    last_of_day = F.col("pairing_no") == F.col("rows_before") + F.col("n_rows")
    return numbered.withColumns(
        {
            "next_pairing_day": F.when(last_of_day, F.col("_next_day")).otherwise(F.col(pairing_day)),
            "days_from_start": day_diff(F.col(pairing_day), F.col(study_start)),
        }
    ).drop("n_rows", "rows_before", "_next_day")


def pairing_success(
    pairings: DataFrame, history: DataFrame, key: str, pairing_day: str, event_day: str
) -> DataFrame:
    """Per pairing: first litter it led to, success Yes/No, and the first litter ever.

    ``history`` holds every litter with the pairing it is attributed to, if any.
    """
    litters = history.filter(F.col(pairing_day).isNotNull())
    first_of_pairing = litters.groupBy(key, pairing_day).agg(F.min(event_day).alias("first_event_day"))
    first_ever = history.groupBy(key).agg(F.min(event_day).alias("first_event_ever"))
    unique = pairings.select(key, pairing_day).distinct()
    out = natural_join(unique, first_of_pairing, "left", [key, pairing_day])
    out = out.withColumn(
        "successful", F.when(F.col("first_event_day").isNull(), "No").otherwise("Yes")
    )
    return natural_join(out, first_ever, "left", key)


def first_event_both_parents(
    mothers: DataFrame,
    fathers: DataFrame,
    intervals: DataFrame,
    key: str,
    day: str,
    group: str,
    start: str,
    end: str,
) -> DataFrame:
    """First event per parent, both roles stacked, with the group on that date."""
    firsts = union_rows(
        mothers.groupBy(key).agg(F.min(day).alias(day)),
        fathers.groupBy(key).agg(F.min(day).alias(day)),
    )
    return interval_membership(firsts, intervals.select(key, group, start, end), key, day, start, end)
