"""Status labels derived from dates and counts. All thresholds are parameters."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from cohortspark.functions.nulls import ifelse_na, isin_safe

PREGNANT = ("FirstTrimester", "SecondTrimester", "ThirdTrimester")


def breeding_status(
    day: Column,
    founder_flag: Column,
    first_as_mother: Column,
    first_as_father: Column,
    gestation: int = 105,
) -> Column:
    """Breeder once a founder or once a first litter, minus gestation, lies before the day.

    A missing founder flag leaves the answer missing unless one of the litter tests holds.
    """

    def conceived(first: Column) -> Column:
        return first.isNotNull() & (F.date_sub(first, gestation) < day)

    known = (founder_flag == 1) | conceived(first_as_mother) | conceived(first_as_father)
    return ifelse_na(known, F.lit("Breeder"), F.lit("Helper"))


#: fixed values: the stage after the last birth
AFTER_LAST = "PostLastParturition"


def trimester_status(
    diff: Column,
    conception: int = 105,
    first: int = 90,
    second: int = 60,
    third: int = 30,
    last_birth: Column | None = None,
) -> Column:
    """Gestation stage from the signed day difference to the next birth (zero or negative).

    A difference gets the first stage whose limit it has not passed. With ``last_birth``, the latest birth
    before the day, a day that has one and no next birth lies after the last one.
    """
    stage = (
        F.when(diff < -conception, "NotPregnant")
        .when(diff <= -first, "Conception")
        .when(diff < -second, "FirstTrimester")
        .when(diff < -third, "SecondTrimester")
        .when(diff <= 0, "ThirdTrimester")
    )
    if last_birth is None:
        return stage
    return stage.when(diff.isNull() & last_birth.isNotNull(), AFTER_LAST)


def semester_status(
    diff: Column, day: Column, tenure_end: Column, last_event: Column, gestation: int = 90
) -> Column:
    """Two-stage split; days after the last birth that could still hide a pregnancy are undetermined."""
    tail = F.date_sub(tenure_end, gestation)
    undetermined_from = F.when(tail >= last_event, tail).when(tail < last_event, last_event)
    half = gestation / 2
    return (
        F.when(diff < -gestation, "NotPregnant")
        .when((diff >= -gestation) & (diff < -half), "FirstSemester")
        .when((diff >= -half) & (diff <= 0), "SecondSemester")
        .when(diff.isNull() & (day >= undetermined_from), "Undetermined")
    )


def lactation_status(sex: Column, status: Column, young: Column) -> Column:
    breeding_female = (sex == "F") & (status == "Breeder")
    return (
        F.when(breeding_female & (young > 0), "Lactating")
        .when(breeding_female & (young == 0), "NotLactating")
        .otherwise("")
    )


def female_category(status: Column, lactating: Column, gestation: Column) -> Column:
    dry_breeder = (status == "Breeder") & (lactating == "NotLactating")
    return (
        F.when(status == "Helper", "Helper")
        .when(dry_breeder & isin_safe(gestation, ("Conception", "NotPregnant")), "NotPreg")
        .when(dry_breeder & isin_safe(gestation, ("FirstTrimester", "SecondTrimester")), "EarlyGest")
        .when(dry_breeder & (gestation == "ThirdTrimester"), "LateGest")
        .when((status == "Breeder") & (lactating == "Lactating"), "Lact")
    )


def pregnancy_split(sex: Column, status: Column, gestation: Column) -> Column:
    """Breeding females become pregnant or non-pregnant breeders; a missing stage is non-pregnant."""
    breeding_female = (sex == "F") & (status == "Breeder")
    pregnant = isin_safe(gestation, PREGNANT)
    return (
        F.when(breeding_female & pregnant, "PregnantBreeder")
        .when(breeding_female & ~pregnant, "NonPregnantBreeder")
        .otherwise(status)
    )


def month_bin(delay: Column, step: int = 6, last: int = 42, slack: float = 0.5) -> Column:
    """Upper edge of the ``step``-month bin a delay falls in; delays past the last bin stay raw."""
    upper = last + slack
    edge = (F.floor(delay / step) + 1) * step
    return (
        F.when(delay < step, F.lit(float(step)))
        .when(delay < upper, F.least(edge, F.lit(last)).cast("double"))
        .otherwise(delay)
    )


def recode(col: Column, mapping: dict) -> Column:
    """Fixed value corrections; values outside the mapping stay as they are."""
    pairs: Sequence = [F.lit(x) for kv in mapping.items() for x in kv]
    return F.coalesce(F.try_element_at(F.create_map(*pairs), col), col) if pairs else col
