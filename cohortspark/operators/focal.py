"""Focal observations: state behaviours (durations) and point behaviours (counts) per session."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortspark.functions.dates import per_hour
from cohortspark.functions.nulls import ifelse_na, isin_safe
from cohortspark.operators.panel import balanced_panel
from cohortspark.operators.relational import keep_first

#: fixed values: state and point behaviours of the code lists
STATES = (
    "Beg/Suckle",
    "Carry food",
    "Carry NM",
    "Dig",
    "Drumming",
    "Eat",
    "Gnaw",
    "Groom",
    "Huddeling",
    "Kick",
    "Miscellaneous",
    "Nest Building",
    "Out of sight",
    "Rest",
    "Self groom",
    "Sex forplay",
    "Sparr",
    "Sweep",
)
POINTS = (
    "Back Sparr",
    "Begging Call",
    "Bite",
    "Carry pup",
    "Chase",
    "Copulation",
    "Displace",
    "DropFS",
    "Groom call",
    "Overt aggression",
    "Pass",
    "Pull tail",
    "Pump",
    "Retreat",
    "Sniff",
    "Submiss call",
    "Unknown call",
)
#: fixed values: states counted separately when received, and sub-types of passes and copulations
RECEIVED_STATES = ("Groom", "Huddeling", "Beg/Suckle")
REPEATED_STATE = "Huddeling"
PASS_DIRECTIONS = ("NoseToNose", "NoseToTail", "TailToNose", "TailToTail")
PASS_LOCATIONS = ("Over", "Sidewards", "Under")
FRONT_COPULATION = "CopulationF"


def state_names(states: Sequence[str] = STATES) -> list[str]:
    return [*states, *[s + "_R" for s in RECEIVED_STATES]]


def point_names(points: Sequence[str] = POINTS) -> list[str]:
    """Point behaviours with the sub-types of passes (Pass_<direction>_<location>) and copulations."""
    passes = [f"Pass_{way}_{where}" for way in PASS_DIRECTIONS for where in PASS_LOCATIONS]
    return [*points, *passes, FRONT_COPULATION]


def focal_state_counts(
    sessions: DataFrame,
    events: DataFrame,
    session: str,
    event: str,
    behaviour: str,
    received: str,
    duration: str,
    count: str,
    seen: str,
    order: str,
    states: Sequence[str] = STATES,
) -> DataFrame:
    """Duration and count of every state per session, frequency per hour and percent of time seen.

    Received grooming, huddling and begging get their own name. Given huddling repeats once per
    partner and is counted once per event.
    """
    suffix = isin_safe(F.col(behaviour), RECEIVED_STATES) & (F.col(received) == "Received")
    named = events.filter(F.col(duration).isNotNull()).withColumn(
        behaviour,
        F.when(suffix, F.concat(behaviour, F.lit("_R"))).otherwise(F.col(behaviour)),
    )
    columns = [session, behaviour, duration, count]
    others = named.filter(F.col(behaviour) != REPEATED_STATE).select(*columns)
    repeated = named.filter(F.col(behaviour) == REPEATED_STATE).select(*columns, event, order)
    facts = others.unionByName(keep_first(repeated, event, order).select(*columns))
    out = balanced_panel(sessions, facts, [session], behaviour, state_names(states), [duration, count])
    time = F.col(seen).cast("double")
    return out.withColumns(
        {
            "per_hour": per_hour(F.col(count).cast("double"), time),
            "percent_time": F.try_divide(F.col(duration).cast("double"), time) * 100,
        }
    )


def focal_point_counts(
    sessions: DataFrame,
    events: DataFrame,
    session: str,
    behaviour: str,
    received: str,
    count: str,
    copulation_side: str,
    pass_direction: str,
    pass_location: str,
    seen: str,
    points: Sequence[str] = POINTS,
) -> DataFrame:
    """Given, received and total counts of every point behaviour and sub-type per session.

    "Pass" itself counts all passes, whatever their direction code, as given.
    """
    b = F.col(behaviour)
    front = (b == "Copulation") & (F.col(copulation_side) == "Front")
    pass_name = F.concat_ws(
        "_", F.lit("Pass"), *[F.coalesce(F.col(c), F.lit("NA")) for c in (pass_direction, pass_location)]
    )
    named = ifelse_na(front, F.lit(FRONT_COPULATION), F.when(b == "Pass", pass_name).otherwise(b))
    given = F.col(received).isNull() | (F.col(received) == "Initiated")
    n = F.col(count).cast("bigint")
    none = F.lit(0).cast("bigint")
    rows = F.array(
        F.struct(
            named.alias("_name"),
            F.when(given, n).otherwise(none).alias("_g"),
            F.when(F.col(received) == "Received", n).otherwise(none).alias("_r"),
        ),
        F.struct(F.when(b == "Pass", b).alias("_name"), n.alias("_g"), none.alias("_r")),
    )
    facts = (
        events.filter(isin_safe(b, points))
        .select(session, F.inline(rows))
        .filter(F.col("_name").isNotNull())
        .withColumnRenamed("_name", behaviour)
    )
    panel = balanced_panel(sessions, facts, [session], behaviour, point_names(points), ["_g", "_r"])
    ways = F.array(
        F.struct(F.lit("G").alias("direction"), F.col("_g").alias(count)),
        F.struct(F.lit("R").alias("direction"), F.col("_r").alias(count)),
        F.struct(F.lit("T").alias("direction"), (F.col("_g") + F.col("_r")).alias(count)),
    )
    out = panel.select("*", F.inline(ways)).drop("_g", "_r")
    return out.withColumn(
        "per_hour", per_hour(F.col(count).cast("double"), F.col(seen).cast("double"))
    )
