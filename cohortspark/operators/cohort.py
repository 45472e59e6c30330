"""Cohort assembly: members, treatments, units, the master table and its count tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortspark.functions.dates import months_between_days
from cohortspark.functions.nulls import fill, isin_safe, not_isin_safe
from cohortspark.functions.status import recode
from cohortspark.operators.intervals import groups_at_offsets, interval_join
from cohortspark.operators.ordering import number_rows
from cohortspark.operators.relational import anti, contingency, lookup, natural_join, union_rows

NO_UNIT = "Non-Experimental"


def alias_ids(df: DataFrame, column: str, mapping: dict) -> DataFrame:
    """Apply fixed corrections to an id column."""
    return df.withColumn(column, recode(F.col(column), mapping))


def cohort_members(
    subjects: DataFrame, tissue: DataFrame, key: str, exclude: Sequence, out: str = "euthanized"
) -> DataFrame:
    """Study subjects minus exclusions, plus tissue donors outside the study; donors are flagged Yes."""
    kept = subjects.distinct().filter(not_isin_safe(F.col(key), exclude))
    donors = tissue.select(key).distinct()
    everyone = union_rows(kept, anti(donors, kept, key))
    flagged = natural_join(everyone, donors.withColumn(out, F.lit("Yes")), "left", key)
    return fill(flagged, {out: "No"})


def treatment(
    subjects: DataFrame,
    intervals: DataFrame,
    key: str,
    anchor_start: str,
    study_start: str,
    group: str,
    start: str,
    end: str,
    start_offset: int = 20,
    experiment_offset: int = 14,
) -> DataFrame:
    """Solitary when alone in the experiment group, Breeder when the group changed, else Helper.

    Subjects without an experiment group drop out.
    """
    spans = intervals.select(key, group, start, end)
    anchors = {
        "start_group": (anchor_start, start_offset),
        "experiment_group": (study_start, experiment_offset),
    }
    groups = groups_at_offsets(subjects, spans, key, anchors, group, start, end)
    placed = lookup(
        subjects.withColumn("_at", F.date_add(study_start, experiment_offset)),
        groups.filter(F.col("experiment_group").isNotNull()),
        key,
        "inner",
    )
    group_days = placed.select("experiment_group", "_at").distinct()
    members = interval_join(
        group_days,
        spans.select(F.col(group).alias("experiment_group"), F.col(key).alias("_member"), start, end),
        ["experiment_group"],
        "_at",
        start,
        end,
    )
    sizes = members.groupBy("experiment_group", "_at").agg(F.count(F.lit(1)).alias("group_size"))
    out = lookup(placed, sizes, ["experiment_group", "_at"], "inner")
    label = (
        F.when(F.col("group_size") == 1, "Solitary")
        .when(F.col("experiment_group") != F.col("start_group"), "Breeder")
        .otherwise("Helper")
    )
    return out.withColumn("treatment", label).drop("_at")


def experimental_unit(
    subjects: DataFrame, study: str, sex: str, litter: str, study_start: str, out: str = "unit"
) -> DataFrame:
    """Distinct (study, sex, litter) numbered by first study start within (study, sex)."""
    litters = subjects.groupBy(study, sex, litter).agg(F.min(study_start).alias("first_start"))
    return number_rows(litters, [study, sex], ["first_start", litter], out)


def study_info(
    subjects: DataFrame,
    dimensions: Sequence[tuple[DataFrame, Sequence[str]]],
    study_start: str,
    birth: str,
    death: str,
    series_from: str,
) -> DataFrame:
    """Subjects with their study facts, series (2 after ``series_from``, else 1), ages in months."""
    out = subjects
    for dim, keys in dimensions:
        out = natural_join(out, dim, "left", keys)
    begun, cut = F.col(study_start), F.lit(series_from).cast("date")
    return out.withColumns(
        {
            "series": F.when(begun > cut, 2).otherwise(1),
            "start_age": months_between_days(begun, F.col(birth)),
            "duration": months_between_days(F.col(death), begun),
        }
    )


def cohort_table(
    members: DataFrame,
    dimensions: Sequence[DataFrame],
    flags: dict[str, DataFrame],
    key: str,
    death_age: str,
    status: str,
    first_conception: str,
    pup_age: int = 100,
    breeder_names: Sequence[str] = ("King", "Queen"),
    overrides: dict | None = None,
    out: str = "queried_status",
) -> DataFrame:
    """Master table: left joins, Yes flags, pups by age at death, and the status used for analysis."""
    table = members
    for dim in dimensions:
        table = natural_join(table, dim, "left", key)
    for name, frame in flags.items():
        hit = frame.select(key).distinct().withColumn(name, F.lit("Yes"))
        table = natural_join(table, hit, "left", key)
    table = table.withColumn(
        status, F.when(F.col(death_age) < pup_age, "Pup").otherwise(F.col(status))
    )
    label: Column = F.when(F.col(first_conception).isNotNull(), "Breeder")
    for who, value in (overrides or {}).items():
        label = label.when(F.col(key) == F.lit(who), value)
    label = label.when(isin_safe(F.col(status), breeder_names), "Breeder").otherwise(F.col(status))
    return table.withColumn(out, label)


def sample_size_table(df: DataFrame, rows: str, column: str, values: Sequence[str]) -> DataFrame:
    return contingency(df, rows, column, values)


def dataset_table(
    df: DataFrame, rows: Sequence[str], unit: str, column: str, values: Sequence[str]
) -> DataFrame:
    """Counts per (rows, unit) with one column per status; a missing unit is named."""
    return fill(contingency(df, [*rows, unit], column, values), {unit: NO_UNIT})


def region_table(
    df: DataFrame, rows: Sequence[str], column: str, values: Sequence[str]
) -> DataFrame:
    return contingency(df, rows, column, values)
