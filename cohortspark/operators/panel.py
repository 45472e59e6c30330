"""Zero-filled behaviour panels: every unit times every category, effort and daily rates.

Facts are summed per (unit, category), folded into one small map per unit and joined to the units; the
zeros appear only then, row by row from the fixed category list. Dense rows never cross the network.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortspark.functions.dates import per_hour
from cohortspark.functions.nulls import count_where, isin_safe
from cohortspark.functions.status import female_category
from cohortspark.operators.relational import anti, keep_first, natural_join


def category_map(
    facts: DataFrame,
    keys: Sequence[str],
    category: str,
    categories: Sequence[str],
    measures: Sequence[str],
    extra: dict[str, Column] | None = None,
) -> DataFrame:
    """One row per key with a map ``cells``: category -> struct of sums.

    Every key of the facts stays, with an empty map if none of its categories is listed. A map holds at
    most one entry per listed category, whatever the number of facts. ``extra`` aggregates run over the
    sums of all categories, listed or not.
    """
    sums = facts.groupBy(*keys, category).agg(*[F.sum(m).alias(m) for m in measures])
    listed = isin_safe(F.col(category), categories)
    cell = F.when(listed, F.struct(category, F.struct(*measures)))  # nulls are not collected
    cells = F.map_from_entries(F.collect_list(cell))
    more = [c.alias(n) for n, c in (extra or {}).items()]
    return sums.groupBy(*keys).agg(cells.alias("cells"), *more)


def unroll(df: DataFrame, category: str, categories: Sequence[str], measures: Sequence[str]) -> DataFrame:
    """One row per listed category from the map ``cells``, zero where the map has no entry."""
    rows = df.withColumn(category, F.explode(F.array(*[F.lit(c) for c in categories])))
    found = F.try_element_at(F.col("cells"), F.col(category))
    kinds = {f.name: f.dataType for f in df.schema["cells"].dataType.valueType.fields}
    return rows.withColumns(
        {m: F.coalesce(found[m], F.lit(0).cast(kinds[m])) for m in measures}
    ).drop("cells")


def balanced_panel(
    units: DataFrame,
    facts: DataFrame,
    keys: Sequence[str],
    category: str,
    categories: Sequence[str],
    measures: Sequence[str],
    drop_empty: str | None = None,
) -> DataFrame:
    """Every unit times every category with the summed measures, 0 where there is no fact.

    ``units`` has one row per key; its other columns are kept. ``drop_empty`` names a measure: units
    whose total of it is zero are left out before the rows are unrolled.
    """
    listed = isin_safe(F.col(category), categories)
    total = {"_total": F.sum(F.when(listed, F.col(drop_empty)))} if drop_empty else None
    cells = category_map(facts, keys, category, categories, measures, total)
    how = "left"
    if drop_empty:
        cells, how = cells.filter(F.col("_total") != 0).drop("_total"), "inner"
    return unroll(units.join(cells, list(keys), how), category, categories, measures)


def given_totals(
    facts: DataFrame,
    keys: Sequence[str],
    behaviour: str,
    received: str,
    measures: Sequence[str],
    directed: Sequence[str],
    received_value: int = 0,
) -> DataFrame:
    """Totals per behaviour without the rows in which a directed behaviour was received."""
    received_row = F.col(behaviour).isin(list(directed)) & (F.col(received) == received_value)
    given = facts.filter(~received_row)
    return given.groupBy(*keys, behaviour).agg(*[F.sum(m).alias(m) for m in measures])


def exclude_empty_units(panel: DataFrame, keys: Sequence[str], measure: str) -> DataFrame:
    """Drop units of an existing panel whose total over all categories is zero."""
    empty = panel.groupBy(*keys).agg(F.sum(measure).alias("_t")).filter(F.col("_t") == 0)
    return anti(panel, empty, list(keys))


def observation_effort(
    facts: DataFrame,
    keys: Sequence[str],
    behaviour: str,
    duration: str,
    unseen: str = "Out of sight",
    out: str = "seen",
) -> DataFrame:
    """Seconds seen per unit: all state durations except time out of sight."""
    return facts.filter(F.col(behaviour) != unseen).groupBy(*keys).agg(F.sum(duration).alias(out))


def seen_time(observed: Column, unseen: Column) -> Column:
    """Observed time minus time out of sight; no record of the latter means none."""
    return observed - F.coalesce(unseen, F.lit(0))


def effort_checks(
    effort: DataFrame, seen: str, limits: Sequence[int] = (60, 300, 1200), by: Sequence[str] = ()
) -> DataFrame:
    """How many units are shorter than each limit, and longer than the last one."""
    shorter = [count_where(F.col(seen) < x).alias(f"under_{x}") for x in limits]
    longer = count_where(F.col(seen) > limits[-1]).alias(f"over_{limits[-1]}")
    return effort.groupBy(*by).agg(F.count(F.lit(1)).alias("n_units"), *shorter, longer)


def daily_rollup(
    facts: DataFrame,
    keys: Sequence[str],
    behaviour: str,
    categories: Sequence[str],
    count: str,
    duration: str,
    unseen: str = "Out of sight",
) -> DataFrame:
    """Per day key and listed behaviour: count, duration, share of the time seen, and frequency per hour.

    The time seen is that of all behaviours but ``unseen``, listed or not, and every observed day stays.
    """
    seen = F.sum(F.when(F.col(behaviour) != unseen, F.col(duration)).otherwise(F.lit(0)))
    per_day = category_map(facts, keys, behaviour, categories, [count, duration], {"seen": seen})
    return unroll(per_day, behaviour, categories, [count, duration]).withColumns(
        {
            "proportion": F.try_divide(F.col(duration).cast("double"), F.col("seen").cast("double")),
            "per_hour": per_hour(F.col(count).cast("double"), F.col("seen").cast("double")),
        }
    )


def cohort_category(
    days: DataFrame,
    keys: Sequence[str],
    sex: str,
    age_months: str,
    seen: str,
    status: str,
    lactating: str,
    gestation: str,
    min_age: float = 12,
    min_seen: float = 1200,
    out: str = "category",
) -> DataFrame:
    """Adult, sufficiently observed female days with their reproductive category."""
    one_row = keep_first(days, keys, [sex, status])
    kept = one_row.filter(
        (F.col(sex) == "F")
        & ((F.col(age_months) > min_age) | F.col(age_months).isNull())
        & (F.col(seen) > min_seen)
        & (F.col(gestation).isNull() | (F.col(gestation) != "PostLastParturition"))
    )
    label = female_category(F.col(status), F.col(lactating), F.col(gestation))
    return kept.withColumn(out, label)


def category_sample_size(df: DataFrame, category: str, key: str) -> DataFrame:
    return df.groupBy(category).agg(
        F.count_distinct(key).alias("n_animals"), F.count(F.lit(1)).alias("n_days")
    )


def behaviour_dictionary(codes: DataFrame, label: str, raw: str) -> DataFrame:
    """Code list with a flag for directed behaviours, i.e. labels with more than one raw form."""
    forms = codes.groupBy(label).agg(F.count(F.lit(1)).alias("n_forms"))
    flagged = natural_join(codes, forms, "inner", label)
    return flagged.withColumn("directed", F.when(F.col("n_forms") > 1, "Yes").otherwise("No"))


def decode_behaviours(facts: DataFrame, codes: DataFrame, raw: str, label: str, received: str) -> DataFrame:
    """Attach label and received code to raw behaviour names; unknown names keep NULL."""
    return natural_join(facts, codes.select(raw, label, received), "left", raw)


def modifier_inventory(
    facts: DataFrame, behaviour: str, modifiers: Sequence[str], wanted: Sequence[str]
) -> DataFrame:
    """Behaviours that carry any of the wanted modifier classes, with the classes seen."""
    hit = F.lit(False)
    for m in modifiers:
        hit = hit | isin_safe(F.col(m), wanted)
    return facts.filter(hit).select(behaviour, *modifiers).distinct()


def partners_per_unit(facts: DataFrame, keys: Sequence[str], partner: str, out: str = "n_partners") -> DataFrame:
    return facts.groupBy(*keys).agg(F.count_distinct(partner).alias(out))
