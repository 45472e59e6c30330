"""Checks on cohort and sample tables: completeness, contradictions, duplicates, delays."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortspark.functions.dates import months_between_days
from cohortspark.functions.nulls import count_where
from cohortspark.functions.status import month_bin
from cohortspark.operators.relational import anti, duplicates, natural_join


def incomplete_units(
    df: DataFrame, unit: Sequence[str], processed: Column, drop_null: Sequence[str] = ()
) -> DataFrame:
    """Members of units that hold both processed and unprocessed individuals.

    Each member carries its own state and both counts; the pairs it stands for are never built.
    """
    rows = df.withColumn("processed", F.coalesce(processed, F.lit(False)))
    for c in drop_null:
        rows = rows.filter(F.col(c).isNotNull())
    counts = (
        rows.groupBy(*unit)
        .agg(
            count_where(F.col("processed")).alias("n_processed"),
            count_where(~F.col("processed")).alias("n_unprocessed"),
        )
        .filter((F.col("n_processed") > 0) & (F.col("n_unprocessed") > 0))
    )
    return natural_join(rows, counts, "inner", list(unit)).withColumn(
        "processed", F.when(F.col("processed"), "Yes").otherwise("No")
    )


def set_difference_check(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows of ``left`` whose key is missing from ``right``."""
    return anti(left, right, list(keys))


def status_contradictions(df: DataFrame, rules: dict[str, Column]) -> DataFrame:
    """Rows that break a rule, one row per broken rule, in a single scan."""
    hits = [F.when(cond, F.lit(name)) for name, cond in rules.items()]
    found = F.filter(F.array(*hits), lambda x: x.isNotNull())
    return df.withColumn("problem", F.explode(found))


def duplicate_check(df: DataFrame, keys: Sequence[str], count: str = "n") -> DataFrame:
    return duplicates(df, keys, count)


def delay_bins(
    points: DataFrame, entities: DataFrame, key: str, day: str, birth: str, start: str, end: str
) -> DataFrame:
    """Age, months before the end date and after the start date, and the months-before-end bin."""
    joined = natural_join(points, entities, "inner", key)
    out = joined.withColumns(
        {
            "obs_age": months_between_days(F.col(day), F.col(birth)),
            "end_delay": months_between_days(F.col(end), F.col(day)),
            "start_delay": months_between_days(F.col(day), F.col(start)),
        }
    )
    return out.withColumn("months_before_end", month_bin(F.col("end_delay")))


def eligible_by_delay(
    df: DataFrame,
    status: str,
    min_age: float = 11,
    by_start: Sequence[str] = ("Solitary", "Queen", "King"),
    by_age: str = "Helper",
) -> DataFrame:
    """Breeders and solitaries after their start; helpers, and anyone without a start, by age."""
    started = F.col(status).isin(list(by_start)) & (F.col("start_delay") > 0)
    by_years = F.col("start_delay").isNull() | (F.col(status) == by_age)
    return df.filter(started | (by_years & (F.col("obs_age") > min_age)))


def bin_counts(df: DataFrame, keys: Sequence[str], out: str = "n") -> DataFrame:
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias(out))
