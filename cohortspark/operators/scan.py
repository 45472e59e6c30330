"""Scan observations: instantaneous counts, directed counts, and category proportions."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortspark.operators.panel import balanced_panel, category_map
from cohortspark.operators.relational import syntactic

#: fixed values: the instantaneous behaviours and the totals built from them
INSTANT = (
    "Dig",
    "Eat",
    "Food Carry",
    "Gnaw",
    "Huddeling",
    "Kick",
    "Locomotion",
    "LocoWork",
    "Nest Material",
    "Other",
    "Pump",
    "Pup Carry",
    "Rest",
    "Self Groom",
    "Sniff",
    "Social Interact",
    "Sweep",
)
TOTALS = {
    "Help.Burrow": ("Dig", "Sweep", "Kick", "LocoWork"),
    "Active.NoHelp": (
        "Gnaw", "Other", "Pump", "Self.Groom", "Sniff", "Locomotion", "Social.Interact", "Eat",
    ),
    "Help.Total": ("Dig", "Sweep", "Kick", "Food.Carry", "Nest.Material", "LocoWork", "Pup.Carry"),
    "TotActive": (
        "Dig", "Eat", "Food.Carry", "Gnaw", "Kick", "Locomotion", "LocoWork", "Nest.Material", "Other",
        "Pump", "Pup.Carry", "Self.Groom", "Sniff", "Social.Interact", "Sweep",
    ),
}
#: fixed values: names used in category tables, and the seven categories
SHORT_NAMES = {
    "Food.Carry": "Foodcarry",
    "Nest.Material": "Nestbuilding",
    "Pup.Carry": "Pupcarry",
    "Self.Groom": "Selfgroom",
    "Social.Interact": "Socint",
}
CATEGORY = {
    "Rest": "Rest",
    "Huddeling": "Rest",
    "Dig": "Burrow",
    "Sweep": "Burrow",
    "Kick": "Burrow",
    "LocoWork": "Burrow",
    "Gnaw": "Activeother",
    "Other": "Activeother",
    "Pump": "Activeother",
    "Selfgroom": "Activeother",
    "Sniff": "Activeother",
    "Locomotion": "Activeother",
    "Socint": "Activeother",
}


def _instant(events: DataFrame, keys: Sequence[str], behaviour: str, count: str, listed: Sequence[str]):
    """One row per unit seen, whatever it did, with its map of sums, and the count of every listed behaviour."""
    wide = category_map(events, keys, behaviour, listed, [count])
    at = {
        syntactic(b): F.coalesce(F.try_element_at("cells", F.lit(b))[count], F.lit(0)).cast("bigint")
        for b in listed
    }
    if "Locomotion" in at and "LocoWork" in at:
        # plain locomotion excludes locomotion while working
        at["Locomotion"] = at["Locomotion"] - at["LocoWork"]
    return wide, at


def _total(at: dict[str, Column], parts: Sequence[str]) -> Column:
    return reduce(lambda a, b: a + b, [at[p] for p in parts])


def _instant_rows(at: dict[str, Column], behaviour: str, count: str) -> Column:
    totals = {n: [p for p in parts if p in at] for n, parts in TOTALS.items()}
    rows = {**at, **{n: _total(at, parts) for n, parts in totals.items() if parts}}
    return F.array(
        *[
            F.struct(F.lit(n).alias(behaviour), F.lit("G").alias("received"), c.alias(count))
            for n, c in rows.items()
        ]
    )


def scan_instant_counts(
    events: DataFrame,
    keys: Sequence[str],
    behaviour: str,
    count: str,
    listed: Sequence[str] = INSTANT,
) -> DataFrame:
    """Zero-filled instantaneous counts per (session, individual) with the totals, in long form.

    Everyone seen stays, with zeros if none of the ``listed`` behaviours was shown. ``total_scans`` sums
    the listed behaviours.
    """
    wide, at = _instant(events, keys, behaviour, count, listed)
    rows = _instant_rows(at, behaviour, count)
    return wide.select(*keys, _total(at, list(at)).alias("total_scans"), F.inline(rows))


def _sides(events: DataFrame, session: str, actor: str, partner: str, behaviour: str, count: str) -> DataFrame:
    """Each event once for its actor (given) and once for its partner (received), if it has one."""
    n, none = F.col(count).cast("bigint"), F.lit(0).cast("bigint")
    roles = F.array(
        F.struct(F.col(actor).alias("_who"), n.alias("_g"), none.alias("_r")),
        F.struct(F.col(partner).alias("_who"), none.alias("_g"), n.alias("_r")),
    )
    return (
        events.select(session, behaviour, F.inline(roles))
        .filter(F.col("_who").isNotNull())
        .withColumnRenamed("_who", actor)
    )


def _ways(given: Column, received: Column) -> list[tuple[str, Column]]:
    return [("G", given), ("R", received), ("T", given + received)]


def scan_directed_counts(
    seen: DataFrame,
    events: DataFrame,
    session: str,
    actor: str,
    partner: str,
    behaviour: str,
    behaviours: Sequence[str],
    count: str,
) -> DataFrame:
    """Given (as actor), received (as partner) and total counts per individual seen in a session."""
    sides = _sides(events, session, actor, partner, behaviour, count)
    units = seen.select(session, actor).distinct()
    panel = balanced_panel(units, sides, [session, actor], behaviour, behaviours, ["_g", "_r"])
    ways = F.array(
        *[
            F.struct(F.lit(w).alias("received"), c.alias(count))
            for w, c in _ways(F.col("_g"), F.col("_r"))
        ]
    )
    return panel.select(session, actor, behaviour, F.inline(ways))


def scan_behaviour_counts(
    instant_events: DataFrame,
    directed_events: DataFrame,
    session: str,
    actor: str,
    partner: str,
    behaviour: str,
    behaviours: Sequence[str],
    count: str,
    listed: Sequence[str] = INSTANT,
) -> DataFrame:
    """Instantaneous and directed counts in one long table, the scan total on every row.

    Both event tables fold to one map per (session, individual); the maps meet in a join on the key
    they are already partitioned by, and only then unroll.
    """
    keys = [session, actor]
    wide, at = _instant(instant_events, keys, behaviour, count, listed)
    sides = _sides(directed_events, session, actor, partner, behaviour, count)
    directed = category_map(sides, keys, behaviour, behaviours, ["_g", "_r"]).withColumnRenamed(
        "cells", "directed"
    )
    zero = F.lit(0).cast("bigint")

    def side(b: str, field: str) -> Column:
        return F.coalesce(F.try_element_at("directed", F.lit(b))[field], zero)

    directed_rows = F.array(
        *[
            F.struct(F.lit(b).alias(behaviour), F.lit(w).alias("received"), c.alias(count))
            for b in behaviours
            for w, c in _ways(side(b, "_g"), side(b, "_r"))
        ]
    )
    kinds = F.array(
        F.struct(F.lit("ScanInst").alias("obs_type"), _instant_rows(at, behaviour, count).alias("rows")),
        F.struct(F.lit("ScanCont").alias("obs_type"), directed_rows.alias("rows")),
    )
    both = wide.join(directed, keys, "left").withColumn("total_scans", _total(at, list(at)))
    return both.select(*keys, "total_scans", F.inline(kinds)).select(
        *keys, "total_scans", "obs_type", F.inline("rows")
    )


def scan_categories(
    events: DataFrame,
    roster: DataFrame,
    keys: Sequence[str],
    behaviour: str,
    count: str,
    listed: Sequence[str] = INSTANT,
) -> DataFrame:
    """Count and share of scans per category; roster members never seen keep one empty row."""
    wide, at = _instant(events, keys, behaviour, count, listed)
    members: dict[str, list[str]] = {}
    for name in at:
        short = SHORT_NAMES.get(name, name)
        members.setdefault(CATEGORY.get(short, short), []).append(name)
    cells = F.array(
        *[
            F.struct(F.lit(c).alias("category"), _total(at, parts).alias("n"))
            for c, parts in members.items()
        ]
    )
    rows = wide.select(*keys, _total(at, list(at)).alias("total_scans"), cells.alias("cells"))
    out = roster.join(rows, list(keys), "left").select(
        *roster.columns, "total_scans", F.inline_outer("cells")
    )
    share = F.try_divide(F.col("n").cast("double"), F.col("total_scans").cast("double"))
    return out.withColumn("proportion", share)
