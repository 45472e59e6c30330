"""Look-back periods before an end date, and the samples that fall into them."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortspark.functions.dates import months_between_days
from cohortspark.functions.nulls import fill, not_isin_safe
from cohortspark.functions.status import pregnancy_split, trimester_status
from cohortspark.operators.asof import next_event_day
from cohortspark.operators.intervals import select_in_period
from cohortspark.operators.ordering import number_rows
from cohortspark.operators.relational import join_on, lookup, natural_join, union_rows
from cohortspark.session import staged

#: fixed values: months before the end date and the name of that look-back point
PERIOD_NAMES = {
    3: "Three_M",
    6: "Six_M",
    9: "Nine_M",
    12: "Twelve_M",
    15: "Fifteen_M",
    18: "Eighteen_M",
    21: "TwentyOne_M",
    24: "TwentyFour_M",
}
END_PERIOD = "Death"
PERIOD_COLUMNS = ("period", "period_day", "period_type")


def lookback_grid(
    entities: DataFrame,
    key: str,
    birth: str,
    start: str,
    end: str,
    months: Sequence[int] = tuple(PERIOD_NAMES),
    default_start_days: int = 500,
) -> DataFrame:
    """One row per entity and look-back month; a missing start is ``default_start_days`` before the end."""
    begun = F.coalesce(F.col(start), F.date_sub(end, default_start_days))
    points = F.array(
        *[F.struct(F.lit(m).alias("months"), F.lit(PERIOD_NAMES[m]).alias("period")) for m in months]
    )
    return (
        entities.select(key, birth, begun.alias(start), end)
        .withColumns(
            {
                "duration": months_between_days(F.col(end), F.col(start)),
                "first_birthday": F.add_months(birth, 12),
            }
        )
        .select("*", F.inline(points))
        .withColumn("period_day", F.add_months(F.col(end), -F.col("months")))
        .withColumn("period_age", months_between_days(F.col("period_day"), F.col(birth)))
    )


def _stretches(
    entities: DataFrame,
    key: str,
    birth: str,
    start: str,
    end: str,
    step: int,
    last: int,
    min_age: float,
    default_start_days: int,
) -> DataFrame:
    """Per entity: the half-year points ``_p0``, ``_p1``, ... (NULL unless kept) and the oldest
    stretch ``_last`` (NULL if there is none).

    Everything follows from the entity's own dates, so this is row-wise arithmetic on a few columns:
    no shuffle, no window.
    """
    rows = entities.select(
        key, birth, F.coalesce(F.col(start), F.date_sub(end, default_start_days)).alias("_start"), end
    ).withColumn("_duration", months_between_days(F.col(end), F.col("_start")))
    months = [m for m in PERIOD_NAMES if m % step == 0 and m <= last]
    points = {}
    for i, m in enumerate(months):
        day = F.add_months(end, -m)
        short = (F.col("_duration") < step) if m == step else F.lit(False)
        adult = (months_between_days(day, F.col(birth)) > min_age) | F.col(birth).isNull()
        keep = F.coalesce((adult & (day > F.col("_start"))) | short, F.lit(False))
        points[f"_p{i}"] = F.when(
            keep,
            F.struct(
                F.lit(m).alias("months"),
                F.lit(PERIOD_NAMES[m]).alias("period"),
                F.lit(PERIOD_NAMES[m + step] if m < last else None).cast("string").alias("next_period"),
                F.when(day < F.col("_start"), F.col("_start")).otherwise(day).alias("period_day"),
                F.when(short, "Last").otherwise("First").alias("period_type"),
            ),
        )
    rows = rows.withColumns(points)
    rows = rows.withColumn("_oldest", F.coalesce(*reversed([F.col(p) for p in points])))
    oldest = F.col("_oldest")
    stretch = F.struct(
        (oldest["months"] + step).alias("months"),
        oldest["next_period"].alias("period"),
        # greatest() skips a NULL birthday, which leaves the study start
        F.greatest(F.add_months(birth, 12), F.col("_start")).alias("period_day"),
        F.lit("Last").alias("period_type"),
    )
    has_last = oldest["next_period"].isNotNull() & (F.col("_duration") > step)
    return rows.withColumn("_last", F.when(has_last, stretch))


def _points(rows: DataFrame) -> list[str]:
    return [c for c in rows.columns if c.startswith("_p")]


def period_starts(
    entities: DataFrame,
    key: str,
    birth: str,
    start: str,
    end: str,
    step: int = 6,
    last: int = 24,
    min_age: float = 12,
    default_start_days: int = 500,
) -> DataFrame:
    """Half-year points old enough and after the start, or the first one of a short study.

    A point before the start moves to the start.
    """
    rows = _stretches(entities, key, birth, start, end, step, last, min_age, default_start_days)
    return rows.select(key, F.inline(F.array(*_points(rows)))).filter(F.col("months").isNotNull())


def last_period(
    entities: DataFrame,
    key: str,
    birth: str,
    start: str,
    end: str,
    step: int = 6,
    last: int = 24,
    min_age: float = 12,
    default_start_days: int = 500,
) -> DataFrame:
    """The stretch older than the oldest kept point: from the later of first birthday and study start."""
    rows = _stretches(entities, key, birth, start, end, step, last, min_age, default_start_days)
    return rows.filter(F.col("_last").isNotNull()).select(key, "_last.*")


def available_periods(
    entities: DataFrame,
    key: str,
    birth: str,
    start: str,
    end: str,
    step: int = 6,
    last: int = 24,
    min_age: float = 12,
    default_start_days: int = 500,
) -> DataFrame:
    """Consecutive stretches per entity from the end date backwards; the oldest point only closes one."""
    rows = _stretches(entities, key, birth, start, end, step, last, min_age, default_start_days)

    def entry(day: Column, months: Column, period: Column, kind: Column) -> Column:
        fields = {"day": day, "rank": -months, "period": period, "type": kind}
        return F.struct(*[c.alias(n) for n, c in fields.items()])

    finish = entry(F.col(end), F.lit(0), F.lit(END_PERIOD), F.lit(None).cast("string"))
    entries = [finish]
    for name in [*_points(rows), "_last"]:
        p = F.col(name)
        fields = (p["period_day"], p["months"], p["period"], p["period_type"])
        entries.append(F.when(p.isNotNull(), entry(*fields)))
    # newest first, absent entries last
    rows = rows.withColumn("_chain", F.sort_array(F.array(*entries), asc=False))
    names = dict(zip(PERIOD_COLUMNS, ("period", "day", "type"), strict=True))
    pairs = []
    for i in range(len(entries) - 1):
        now, older = F.get("_chain", F.lit(i)), F.get("_chain", F.lit(i + 1))
        pairs.append(
            F.struct(
                *[now[f].alias(c) for c, f in names.items()],
                *[older[f].alias("end_" + c) for c, f in names.items()],
            )
        )
    return rows.select(key, F.inline(F.array(*pairs))).filter(F.col("end_period").isNotNull())


def period_list(periods: DataFrame, key: str) -> DataFrame:
    return periods.select(key, *["end_" + c for c in PERIOD_COLUMNS]).distinct()


def status_expansion(
    entities: DataFrame, periods: DataFrame, key: str, sex: str, status: str
) -> DataFrame:
    """Breeding females as a pregnant and a non-pregnant row, everyone else once, times the periods."""
    breeding_female = (F.col(sex) == "F") & (F.col(status) == "Breeder")
    labels = F.when(
        breeding_female, F.array(F.lit("PregnantBreeder"), F.lit("NonPregnantBreeder"))
    ).otherwise(F.array(F.col(status)))
    rows = entities.select(key, sex, F.explode(labels).alias(status))
    return natural_join(rows, periods, "left", key)


def stack_samples(
    samples: dict[str, DataFrame],
    key: str,
    day: str,
    sample: str,
    exclusions: dict[str, Sequence],
    kind: str = "sample_type",
) -> DataFrame:
    """Sample tables stacked by type; ``exclusions`` drops listed labels and keeps missing ones."""
    parts = []
    for name, frame in samples.items():
        for column, values in exclusions.items():
            if column in frame.columns:
                frame = frame.filter(not_isin_safe(F.col(column), values))
        parts.append(frame.select(key, day, sample, F.lit(name).alias(kind)))
    return union_rows(*parts)


def number_repeats(
    stacked: DataFrame, key: str, day: str, sample: str, kind: str = "sample_type", out: str = "repeat_no"
) -> DataFrame:
    """Repeats per (key, day, type) numbered by sample id. Reads its input twice: stage it first."""
    return number_rows(stacked, [key, day, kind], [sample], out)


def sample_union(
    samples: dict[str, DataFrame],
    key: str,
    day: str,
    sample: str,
    exclusions: dict[str, Sequence],
    kind: str = "sample_type",
    out: str = "repeat_no",
) -> DataFrame:
    """Stacked samples with their repeat number."""
    stacked = staged(stack_samples(samples, key, day, sample, exclusions, kind))
    return number_repeats(stacked, key, day, sample, kind, out)


def with_gestation(
    samples: DataFrame,
    events: DataFrame,
    key: str,
    day: str,
    event_day: str,
    out: str = "gestation",
    days: DataFrame | None = None,
) -> DataFrame:
    """Trimester stage of each sample day from the next event of the same individual.

    ``days`` may name a cheaper frame holding the same (key, day) pairs.
    """
    upcoming = next_event_day(samples if days is None else days, events, key, day, event_day, "_next")
    stage = trimester_status(F.datediff(day, "_next"))
    return lookup(samples, upcoming.withColumn(out, stage).drop("_next"), [key, day])


def samples_in_period(
    periods: DataFrame,
    samples: DataFrame,
    profile: DataFrame,
    key: str,
    day: str,
    sex: str,
    status: str,
    gestation: str | None = None,
) -> DataFrame:
    """Samples inside each period with the individual's status, split by gestation where given."""
    spans = periods.select(key, "period_day", *["end_" + c for c in PERIOD_COLUMNS])
    found = select_in_period(spans, samples, key, day, "period_day", "end_period_day")
    out = natural_join(found, profile.select(key, sex, status), "inner", key)
    if gestation is None:
        return out
    return out.withColumn(status, pregnancy_split(F.col(sex), F.col(status), F.col(gestation)))


def count_in_period(
    expected: DataFrame, selected: DataFrame, keys: Sequence[str], what: str, out: str = "n"
) -> DataFrame:
    """Distinct samples (or days) per key, zero for expected keys without any."""
    counts = selected.groupBy(*keys).agg(F.count_distinct(what).alias(out))
    return fill(natural_join(expected, counts, "left", list(keys)), {out: 0})


def export_status(
    selection: DataFrame, exported: DataFrame, sample: str, exported_sample: str, export_day: str
) -> DataFrame:
    """Export record of each selected sample, if any, and whether it left."""
    joined = join_on(selection, exported, {sample: exported_sample}, "left")
    return joined.withColumn(
        "exported", F.when(F.col(export_day).isNotNull(), "Yes").otherwise("No")
    )
