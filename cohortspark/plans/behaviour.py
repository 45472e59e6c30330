"""Behaviour panels, scan and focal counts, dyads, and multivariate summaries."""

from __future__ import annotations

from pyspark.sql import functions as F

from cohortspark.functions.dates import age
from cohortspark.functions.status import lactation_status, trimester_status
from cohortspark.operators import dyads as dyadic
from cohortspark.operators import focal, panel, profile, scan, stats
from cohortspark.operators.asof import next_event_day, previous_event_day
from cohortspark.operators.focal import POINTS, STATES
from cohortspark.operators.intervals import interval_join
from cohortspark.operators.relational import natural_join
from cohortspark.operators.scan import CATEGORY, INSTANT, SHORT_NAMES, TOTALS
from cohortspark.plans import roles
from cohortspark.plans.registry import query
from cohortspark.plans.roles import EVENT_TYPES, sql

SPAN = ("member_from", "member_to")
UNIT = ["source", "focal_ref", "animal", "day"]
DAY = ["source", "animal", "day"]


def _values(items) -> str:
    return ", ".join(f"('{v}')" for v in items)


# ---------------------------------------------------------------------------------------- panels


def _facts(spark, sf):
    return roles.sessions(spark, sf).withColumn("n", F.lit(1).cast("bigint"))


_PANEL = f"""SELECT u.source, u.focal_ref, u.animal, u.day, c.behaviour, COALESCE(SUM(s.n), 0)::BIGINT AS n,
      COALESCE(SUM(s.duration), 0) AS duration
    FROM (SELECT DISTINCT source, focal_ref, animal, day FROM sessions) u
    CROSS JOIN (VALUES {_values(EVENT_TYPES)}) AS c(behaviour)
    LEFT JOIN (SELECT *, 1 AS n FROM sessions) s
      ON s.focal_ref = u.focal_ref AND s.source = u.source AND s.behaviour = c.behaviour
    GROUP BY ALL"""


def _panel(spark, sf, drop_empty=None):
    facts = _facts(spark, sf)
    units = facts.select(*UNIT).distinct()
    return panel.balanced_panel(units, facts, UNIT, "behaviour", EVENT_TYPES, ["n", "duration"], drop_empty)


@query("balanced_panel", sql(_PANEL, "sessions"),
    exact=("duration",),
)
def balanced_panel(spark, sf):
    return _panel(spark, sf)


@query(
    "exclude_empty_units",
    sql(
        """SELECT * FROM panel WHERE (source, focal_ref) IN
             (SELECT (source, focal_ref) FROM panel GROUP BY source, focal_ref HAVING SUM(duration) <> 0)""",
        "sessions",
        panel=_PANEL,
    ),
    exact=("duration",),
)
def exclude_empty_units(spark, sf):
    return _panel(spark, sf, drop_empty="duration")


_EFFORT = """SELECT source, focal_ref, animal, day, SUM(duration) AS seen FROM sessions
    WHERE behaviour <> 'error' GROUP BY ALL"""


def _effort(spark, sf):
    return panel.observation_effort(
        roles.sessions(spark, sf), UNIT, "behaviour", "duration", unseen="error"
    )


@query("observation_effort", sql(_EFFORT, "sessions"),
    exact=("seen",),
)
def observation_effort(spark, sf):
    return _effort(spark, sf)


@query(
    "seen_time",
    sql(
        """SELECT source, focal_ref, animal, day,
             SUM(duration) - COALESCE(SUM(duration) FILTER (behaviour = 'error'), 0) AS seen
           FROM sessions GROUP BY ALL""",
        "sessions",
    ),
    exact=("seen",),
)
def seen_time(spark, sf):
    """Observed time minus time out of sight, sessions without the latter included."""
    unseen = F.sum(F.when(F.col("behaviour") == "error", F.col("duration")))
    whole = roles.sessions(spark, sf).groupBy(*UNIT).agg(F.sum("duration").alias("observed"), unseen.alias("unseen"))
    return whole.select(*UNIT, panel.seen_time(F.col("observed"), F.col("unseen")).alias("seen"))


@query(
    "given_state_totals",
    sql(
        """SELECT source, focal_ref, behaviour, COUNT(*) AS n, SUM(duration) AS duration FROM sessions
           WHERE NOT (behaviour IN ('click', 'view') AND NULLIF(k % 3, 2) = 0) GROUP BY ALL""",
        "sessions",
    ),
    exact=("duration",),
)
def given_state_totals(spark, sf):
    k = F.col("k") % 3
    facts = _facts(spark, sf).withColumn("received", F.when(k != 2, k))
    return panel.given_totals(
        facts,
        ["source", "focal_ref"],
        "behaviour",
        "received",
        ["n", "duration"],
        directed=("click", "view"),
    )


@query(
    "effort_checks",
    sql(
        """SELECT source, COUNT(*) AS n_units, COUNT(*) FILTER (seen < 20) AS under_20,
             COUNT(*) FILTER (seen < 50) AS under_50, COUNT(*) FILTER (seen < 100) AS under_100,
             COUNT(*) FILTER (seen > 100) AS over_100 FROM effort GROUP BY source""",
        "sessions",
        effort=_EFFORT,
    ),
)
def effort_checks(spark, sf):
    return panel.effort_checks(_effort(spark, sf), "seen", (20, 50, 100), by=["source"])


_DAILY = f"""SELECT d.source, d.animal, d.day, c.behaviour, d.seen,
      COALESCE(SUM(s.n), 0)::BIGINT AS n, COALESCE(SUM(s.duration), 0) AS duration
    FROM (SELECT source, animal, day, SUM(CASE WHEN behaviour <> 'error' THEN duration ELSE 0 END) AS seen
          FROM sessions GROUP BY ALL) d
    CROSS JOIN (VALUES {_values(EVENT_TYPES)}) AS c(behaviour)
    LEFT JOIN (SELECT *, 1 AS n FROM sessions) s ON s.source = d.source AND s.animal = d.animal
      AND s.day = d.day AND s.behaviour = c.behaviour
    GROUP BY ALL"""


@query(
    "daily_rollup",
    sql(
        """SELECT *, ROUND(CAST(duration AS DOUBLE) / NULLIF(CAST(seen AS DOUBLE), 0), 6) AS proportion,
             ROUND(n / NULLIF(CAST(seen AS DOUBLE) / 3600, 0), 6) AS per_hour FROM daily""",
        "sessions",
        daily=_DAILY,
    ),
    exact=("seen", "duration"),
)
def daily_rollup(spark, sf):
    out = panel.daily_rollup(
        _facts(spark, sf), DAY, "behaviour", EVENT_TYPES, "n", "duration", unseen="error"
    )
    return out.withColumns(
        {"proportion": F.round("proportion", 6), "per_hour": F.round("per_hour", 6)}
    )


_SUBSET = EVENT_TYPES[:3]
_DAILY_SUBSET = f"""SELECT d.source, d.animal, d.day, c.behaviour, d.seen,
      COALESCE(SUM(s.n), 0)::BIGINT AS n, COALESCE(SUM(s.duration), 0) AS duration
    FROM (SELECT source, animal, day, SUM(CASE WHEN behaviour <> 'error' THEN duration ELSE 0 END) AS seen
          FROM sessions GROUP BY ALL) d
    CROSS JOIN (VALUES {_values(_SUBSET)}) AS c(behaviour)
    LEFT JOIN (SELECT *, 1 AS n FROM sessions) s ON s.source = d.source AND s.animal = d.animal
      AND s.day = d.day AND s.behaviour = c.behaviour
    GROUP BY ALL"""


@query(
    "daily_rollup_subset",
    sql(
        """SELECT *, ROUND(CAST(duration AS DOUBLE) / NULLIF(CAST(seen AS DOUBLE), 0), 6) AS proportion,
             ROUND(n / NULLIF(CAST(seen AS DOUBLE) / 3600, 0), 6) AS per_hour FROM daily""",
        "sessions",
        daily=_DAILY_SUBSET,
    ),
    exact=("seen", "duration"),
)
def daily_rollup_subset(spark, sf):
    """Three of the five types are listed; the time seen is that of all."""
    out = panel.daily_rollup(_facts(spark, sf), DAY, "behaviour", _SUBSET, "n", "duration", unseen="error")
    return out.withColumns(
        {"proportion": F.round("proportion", 6), "per_hour": F.round("per_hour", 6)}
    )


_FEMALE_DAYS = """SELECT source, animal, day, seen, sex, age_months, status, lactating, gestation FROM (
      SELECT d.*, CASE WHEN d.animal % 3 < 2 THEN 'F' ELSE 'M' END AS sex,
        CASE WHEN d.animal % 10 > 0
          THEN date_diff('day', DATE '2022-06-01' + CAST(d.animal * 7 % 400 AS INTEGER), d.day) / 30.4375
          END AS age_months,
        CASE WHEN d.animal % 4 = 0 THEN 'Helper' ELSE 'Breeder' END AS status,
        CASE WHEN d.animal % 3 < 2 AND d.animal % 4 <> 0 THEN
          CASE WHEN d.animal % 5 = 1 THEN 'Lactating' ELSE 'NotLactating' END ELSE '' END AS lactating,
        CASE WHEN diff < -105 THEN 'NotPregnant' WHEN diff <= -90 THEN 'Conception'
             WHEN diff < -60 THEN 'FirstTrimester' WHEN diff < -30 THEN 'SecondTrimester'
             WHEN diff <= 0 THEN 'ThirdTrimester' WHEN had THEN 'PostLastParturition' END AS gestation
      FROM (SELECT source, animal, day, SUM(duration) AS seen FROM sessions WHERE behaviour <> 'error'
            GROUP BY ALL) d
      LEFT JOIN (SELECT d.animal, d.day, MAX(date_diff('day', b.born, d.day)) FILTER (b.born >= d.day) AS diff,
            BOOL_OR(b.born <= d.day) AS had
          FROM (SELECT DISTINCT animal, day FROM sessions) d
          JOIN (SELECT DISTINCT animal, day + CAST(animal * 13 % 140 AS INTEGER) - 70 AS born FROM sessions) b
            ON b.animal = d.animal GROUP BY ALL) n
        ON n.animal = d.animal AND n.day = d.day)"""
_CATEGORY = """SELECT *, CASE WHEN status = 'Helper' THEN 'Helper'
      WHEN lactating = 'NotLactating' AND gestation IN ('Conception', 'NotPregnant') THEN 'NotPreg'
      WHEN lactating = 'NotLactating' AND gestation IN ('FirstTrimester', 'SecondTrimester')
        THEN 'EarlyGest'
      WHEN lactating = 'NotLactating' AND gestation = 'ThirdTrimester' THEN 'LateGest'
      WHEN lactating = 'Lactating' THEN 'Lact' END AS category
    FROM female_days WHERE sex = 'F' AND (age_months > 12 OR age_months IS NULL) AND seen > 30
      AND (gestation IS NULL OR gestation <> 'PostLastParturition')"""


def _female_days(spark, sf):
    rows = roles.sessions(spark, sf)
    seen = panel.observation_effort(rows, DAY, "behaviour", "duration", unseen="error")
    # births of every session row, up to 70 days before or after it
    shift = (F.col("animal") * 13 % 140 - 70).cast("int")
    births = rows.select("animal", F.date_add("day", shift).alias("born"))
    upcoming = next_event_day(rows, births, "animal", "day", "born", "next_day")
    before = previous_event_day(rows, births, "animal", "day", "born", "last_day")
    out = natural_join(seen, upcoming, "left", ["animal", "day"])
    out = natural_join(out, before, "left", ["animal", "day"])
    a = F.col("animal")
    born = F.date_add(F.lit("2022-06-01").cast("date"), (a * 7 % 400).cast("int"))
    stage = trimester_status(F.datediff("day", "next_day"), last_birth=F.col("last_day"))
    out = out.withColumns(
        {
            "sex": F.when(a % 3 < 2, "F").otherwise("M"),
            "age_months": F.when(a % 10 > 0, age(F.col("day"), born, "months")),
            "status": F.when(a % 4 == 0, "Helper").otherwise("Breeder"),
            "gestation": stage,
        }
    ).drop("next_day", "last_day")
    young = F.when(a % 5 == 1, 1).otherwise(0)
    return out.withColumn("lactating", lactation_status(F.col("sex"), F.col("status"), young))


def _categories(spark, sf):
    return panel.cohort_category(
        _female_days(spark, sf),
        DAY,
        "sex",
        "age_months",
        "seen",
        "status",
        "lactating",
        "gestation",
        min_seen=30,
    )


@query(
    "cohort_category",
    sql(
        """SELECT * REPLACE (ROUND(age_months, 6) AS age_months) FROM chosen""",
        "sessions",
        female_days=_FEMALE_DAYS,
        chosen=_CATEGORY,
    ),
    exact=("seen",),
)
def cohort_category(spark, sf):
    return _categories(spark, sf).withColumn("age_months", F.round("age_months", 6))


@query(
    "category_sample_size",
    sql(
        """SELECT category, COUNT(DISTINCT animal) AS n_animals, COUNT(*) AS n_days FROM chosen
           GROUP BY category""",
        "sessions",
        female_days=_FEMALE_DAYS,
        chosen=_CATEGORY,
    ),
)
def category_sample_size(spark, sf):
    return panel.category_sample_size(_categories(spark, sf), "category", "animal")


_CODES = """SELECT DISTINCT behaviour AS label, CASE WHEN k % 2 = 0 THEN behaviour ELSE 'R' || behaviour END
      AS raw, CASE WHEN behaviour IN ('click', 'view') THEN k % 2 END AS received
    FROM obs WHERE behaviour IN ('click', 'view') OR k % 2 = 0"""


def _codes(spark, sf):
    rows = roles.obs(spark, sf)
    b, k = F.col("behaviour"), F.col("k") % 2
    directed = b.isin("click", "view")
    return (
        rows.filter(directed | (k == 0))
        .select(
            b.alias("label"),
            F.when(k == 0, b).otherwise(F.concat(F.lit("R"), b)).alias("raw"),
            F.when(directed, k).alias("received"),
        )
        .distinct()
    )


@query(
    "behaviour_dictionary",
    sql(
        """SELECT *, COUNT(*) OVER (PARTITION BY label) AS n_forms,
             CASE WHEN COUNT(*) OVER (PARTITION BY label) > 1 THEN 'Yes' ELSE 'No' END AS directed
           FROM codes""",
        "obs",
        codes=_CODES,
    ),
)
def behaviour_dictionary(spark, sf):
    return panel.behaviour_dictionary(_codes(spark, sf), "label", "raw")


@query(
    "decoded_behaviours",
    sql(
        """SELECT o.event_id, o.raw, c.label, c.received FROM
             (SELECT event_id, CASE WHEN k % 2 = 0 THEN behaviour ELSE 'R' || behaviour END AS raw FROM obs) o
           LEFT JOIN codes c ON c.raw = o.raw""",
        "obs",
        codes=_CODES,
    ),
)
def decoded_behaviours(spark, sf):
    b = F.col("behaviour")
    raw = F.when(F.col("k") % 2 == 0, b).otherwise(F.concat(F.lit("R"), b))
    rows = roles.obs(spark, sf).select("event_id", raw.alias("raw"))
    return panel.decode_behaviours(rows, _codes(spark, sf), "raw", "label", "received")


_MODIFIED = """SELECT animal, day, behaviour, k,
      CASE k % 4 WHEN 0 THEN 'Received' WHEN 1 THEN 'AnimalID' WHEN 2 THEN 'Place' END AS class_1,
      CASE WHEN k % 6 = 0 THEN 'AnimalID' WHEN k % 6 = 1 THEN 'Place' END AS class_2 FROM obs"""


def _modified(spark, sf):
    k = F.col("k")
    return roles.obs(spark, sf).select(
        "animal",
        "day",
        "behaviour",
        "k",
        F.when(k % 4 == 0, "Received").when(k % 4 == 1, "AnimalID").when(k % 4 == 2, "Place").alias(
            "class_1"
        ),
        F.when(k % 6 == 0, "AnimalID").when(k % 6 == 1, "Place").alias("class_2"),
    )


@query(
    "modifier_inventory",
    sql(
        """SELECT DISTINCT behaviour, class_1, class_2 FROM modified
           WHERE class_1 IN ('Received', 'AnimalID') OR class_2 IN ('Received', 'AnimalID')""",
        "obs",
        modified=_MODIFIED,
    ),
)
def modifier_inventory(spark, sf):
    return panel.modifier_inventory(
        _modified(spark, sf), "behaviour", ["class_1", "class_2"], ("Received", "AnimalID")
    )


@query(
    "partners_per_session",
    sql("SELECT animal, day, COUNT(DISTINCT k) AS n_partners FROM obs GROUP BY ALL", "obs"),
)
def partners_per_session(spark, sf):
    return panel.partners_per_unit(roles.obs(spark, sf), ["animal", "day"], "k")


# ------------------------------------------------------------------------------------------ scan


def _sum_of(parts) -> str:
    return " + ".join(f'"{p}"' for p in parts)


_PLAIN = {b: b.replace(" ", ".") for b in INSTANT}
_SCAN_WIDE = (
    "SELECT obs_ref, animal, "
    + ", ".join(
        f"COALESCE(SUM(n) FILTER (behaviour = '{b}'), 0)::BIGINT AS \"{p}\"" for b, p in _PLAIN.items()
    )
    + " FROM scan_inst GROUP BY ALL"
)
_SCAN_FIXED = """SELECT * REPLACE ("Locomotion" - "LocoWork" AS "Locomotion") FROM scan_wide"""
_SCAN_ALL = (
    f"SELECT *, {_sum_of(_PLAIN.values())} AS total_scans, "
    + ", ".join(f'{_sum_of(parts)} AS "{name}"' for name, parts in TOTALS.items())
    + " FROM scan_fixed"
)
_SCAN_LONG = " UNION ALL ".join(
    f"SELECT obs_ref, animal, total_scans, 'G' AS received, '{c}' AS behaviour, \"{c}\" AS n FROM scan_all"
    for c in [*_PLAIN.values(), *TOTALS]
)
_SCAN = {
    "scan_wide": _SCAN_WIDE,
    "scan_fixed": _SCAN_FIXED,
    "scan_all": _SCAN_ALL,
    "instant": _SCAN_LONG,
}


@query("scan_instant_counts", sql("SELECT * FROM instant", "scan_inst", **_SCAN))
def scan_instant_counts(spark, sf):
    return scan.scan_instant_counts(
        roles.scan_inst(spark, sf), ["obs_ref", "animal"], "behaviour", "n"
    )


_SCAN_SUBSET = ("Dig", "Sweep", "Rest")


@query(
    "scan_counts_unlisted",
    sql(
        """SELECT w.obs_ref, w.animal, w.total_scans, 'G' AS received, c.behaviour, CAST(CASE c.behaviour
             WHEN 'Dig' THEN "Dig" WHEN 'Sweep' THEN "Sweep" WHEN 'Rest' THEN "Rest"
             ELSE "Dig" + "Sweep" END AS BIGINT) AS n
           FROM (SELECT obs_ref, animal, COALESCE(SUM(n) FILTER (behaviour = 'Dig'), 0)::BIGINT AS "Dig",
                   COALESCE(SUM(n) FILTER (behaviour = 'Sweep'), 0)::BIGINT AS "Sweep",
                   COALESCE(SUM(n) FILTER (behaviour = 'Rest'), 0)::BIGINT AS "Rest",
                   COALESCE(SUM(n) FILTER (behaviour IN ('Dig', 'Sweep', 'Rest')), 0)::BIGINT AS total_scans
                 FROM scan_inst GROUP BY ALL) w
           CROSS JOIN (VALUES ('Dig'), ('Sweep'), ('Rest'), ('Help.Burrow'), ('Help.Total'), ('TotActive'))
             AS c(behaviour)""",
        "scan_inst",
    ),
)
def scan_counts_unlisted(spark, sf):
    """Everyone seen has a row for each listed behaviour and total, whatever else was shown."""
    return scan.scan_instant_counts(
        roles.scan_inst(spark, sf), ["obs_ref", "animal"], "behaviour", "n", _SCAN_SUBSET
    )


_DIRECTED = f"""SELECT s.obs_ref, s.animal, b.behaviour, r.received,
      CAST(COALESCE(CASE r.received WHEN 'G' THEN g.n WHEN 'R' THEN p.n
        ELSE COALESCE(g.n, 0) + COALESCE(p.n, 0) END, 0) AS BIGINT) AS n
    FROM (SELECT DISTINCT obs_ref, animal FROM scan_inst) s
    CROSS JOIN (VALUES {_values(EVENT_TYPES)}) AS b(behaviour)
    CROSS JOIN (VALUES ('G'), ('R'), ('T')) AS r(received)
    LEFT JOIN (SELECT obs_ref, animal, behaviour, SUM(n) AS n FROM scan_cont GROUP BY ALL) g
      ON g.obs_ref = s.obs_ref AND g.animal = s.animal AND g.behaviour = b.behaviour
    LEFT JOIN (SELECT obs_ref, partner, behaviour, SUM(n) AS n FROM scan_cont WHERE partner IS NOT NULL
               GROUP BY ALL) p
      ON p.obs_ref = s.obs_ref AND p.partner = s.animal AND p.behaviour = b.behaviour"""


@query("scan_directed_counts", sql(_DIRECTED, "scan_inst", "scan_cont"))
def scan_directed_counts(spark, sf):
    return scan.scan_directed_counts(
        roles.scan_inst(spark, sf),
        roles.scan_cont(spark, sf),
        "obs_ref",
        "animal",
        "partner",
        "behaviour",
        EVENT_TYPES,
        "n",
    )


@query(
    "scan_behaviour_counts",
    sql(
        """SELECT a.*, t.total_scans FROM (
             SELECT 'ScanInst' AS obs_type, obs_ref, animal, behaviour, received, n FROM instant
             UNION ALL SELECT 'ScanCont', obs_ref, animal, behaviour, received, n FROM directed) a
           LEFT JOIN scan_all t ON t.obs_ref = a.obs_ref AND t.animal = a.animal""",
        "scan_inst",
        "scan_cont",
        **_SCAN,
        directed=_DIRECTED,
    ),
)
def scan_behaviour_counts(spark, sf):
    return scan.scan_behaviour_counts(
        roles.scan_inst(spark, sf),
        roles.scan_cont(spark, sf),
        "obs_ref",
        "animal",
        "partner",
        "behaviour",
        EVENT_TYPES,
        "n",
    )


def _case(mapping: dict, col: str) -> str:
    arms = " ".join(f"WHEN '{a}' THEN '{b}'" for a, b in mapping.items())
    return f"CASE {col} {arms} ELSE {col} END"


@query(
    "scan_categories",
    sql(
        f"""SELECT r.obs_ref, r.animal, c.total_scans, c.category, c.n,
              ROUND(CAST(c.n AS DOUBLE) / NULLIF(c.total_scans, 0), 6) AS proportion
            FROM (SELECT g.obs_ref, m.animal FROM
                (SELECT DISTINCT obs_ref, animal % 5 AS grp, day FROM scan_inst) g
                JOIN obs_membership m ON m.grp = g.grp AND g.day BETWEEN m.member_from AND m.member_to) r
            LEFT JOIN (SELECT obs_ref, animal, total_scans, category, CAST(SUM(n) AS BIGINT) AS n
                FROM (SELECT *, {_case(CATEGORY, "short")} AS category
                      FROM (SELECT *, {_case(SHORT_NAMES, "behaviour")} AS short FROM instant
                            WHERE behaviour NOT IN ({", ".join(f"'{t}'" for t in TOTALS)})))
                GROUP BY ALL) c ON c.obs_ref = r.obs_ref AND c.animal = r.animal""",
        "scan_inst",
        "obs_membership",
        **_SCAN,
    ),
)
def scan_categories(spark, sf):
    days = roles.scan_inst(spark, sf).select("obs_ref", (F.col("animal") % 5).alias("grp"), "day")
    roster = interval_join(
        days.distinct(), roles.obs_membership(spark, sf), ["grp"], "day", *SPAN
    ).select("obs_ref", "animal")
    out = scan.scan_categories(
        roles.scan_inst(spark, sf), roster, ["obs_ref", "animal"], "behaviour", "n"
    )
    return out.withColumn("proportion", F.round("proportion", 6))


# ----------------------------------------------------------------------------------------- focal


@query(
    "focal_state_counts",
    sql(
        f"""SELECT s.focal_ref, s.animal, s.seen, b.behaviour, COALESCE(c.n, 0)::BIGINT AS n,
              COALESCE(c.duration, 0) AS duration,
              ROUND(COALESCE(c.n, 0) / (CAST(s.seen AS DOUBLE) / 3600), 6) AS per_hour,
              ROUND(CAST(COALESCE(c.duration, 0) AS DOUBLE) / CAST(s.seen AS DOUBLE) * 100, 6)
                AS percent_time
            FROM focal_sessions s CROSS JOIN (VALUES {_values(focal.state_names())}) AS b(behaviour)
            LEFT JOIN (SELECT focal_ref, behaviour, SUM(n) AS n, SUM(duration) AS duration FROM (
                SELECT *, ROW_NUMBER() OVER (PARTITION BY behaviour, focal_event ORDER BY event_id) AS rn
                FROM (SELECT *, CASE WHEN state IN ('Groom', 'Huddeling', 'Beg/Suckle')
                        AND received = 'Received' THEN state || '_R' ELSE state END AS behaviour
                      FROM focal_events WHERE duration IS NOT NULL))
              WHERE behaviour <> 'Huddeling' OR rn = 1 GROUP BY ALL) c
              ON c.focal_ref = s.focal_ref AND c.behaviour = b.behaviour""",
        "focal_events",
        "focal_sessions",
    ),
    exact=("seen", "duration"),
)
def focal_state_counts(spark, sf):
    events = roles.focal_events(spark, sf).withColumnRenamed("state", "behaviour")
    out = focal.focal_state_counts(
        roles.focal_sessions(spark, sf),
        events.drop("point", "side", "way", "location"),
        "focal_ref",
        "focal_event",
        "behaviour",
        "received",
        "duration",
        "n",
        "seen",
        "event_id",
        STATES,
    )
    return out.withColumns(
        {"per_hour": F.round("per_hour", 6), "percent_time": F.round("percent_time", 6)}
    )


_POINT_NAMED = """SELECT *, CASE WHEN point = 'Copulation' THEN
        CASE WHEN side = 'Front' THEN 'CopulationF' WHEN side IS NOT NULL THEN 'Copulation' END
      WHEN point = 'Pass' THEN 'Pass_' || way || '_' || location ELSE point END AS behaviour
    FROM focal_events"""


@query(
    "focal_point_counts",
    sql(
        f"""SELECT s.focal_ref, s.animal, s.seen, b.behaviour, r.direction,
              CAST(COALESCE(CASE r.direction WHEN 'G' THEN c.g WHEN 'R' THEN c.r ELSE c.g + c.r END, 0)
                AS BIGINT) AS n,
              ROUND(COALESCE(CASE r.direction WHEN 'G' THEN c.g WHEN 'R' THEN c.r ELSE c.g + c.r END, 0)
                / (CAST(s.seen AS DOUBLE) / 3600), 6) AS per_hour
            FROM focal_sessions s CROSS JOIN (VALUES {_values(focal.point_names())}) AS b(behaviour)
            CROSS JOIN (VALUES ('G'), ('R'), ('T')) AS r(direction)
            LEFT JOIN (
              SELECT focal_ref, behaviour,
                COALESCE(SUM(n) FILTER (received IS NULL OR received = 'Initiated'), 0) AS g,
                COALESCE(SUM(n) FILTER (received = 'Received'), 0) AS r FROM named GROUP BY ALL
              UNION ALL
              SELECT focal_ref, point, SUM(n), 0 FROM named WHERE point = 'Pass' GROUP BY ALL) c
              ON c.focal_ref = s.focal_ref AND c.behaviour = b.behaviour""",
        "focal_events",
        "focal_sessions",
        named=_POINT_NAMED,
    ),
    exact=("seen",),
)
def focal_point_counts(spark, sf):
    events = roles.focal_events(spark, sf).withColumnRenamed("point", "behaviour")
    out = focal.focal_point_counts(
        roles.focal_sessions(spark, sf),
        events,
        "focal_ref",
        "behaviour",
        "received",
        "n",
        "side",
        "way",
        "location",
        "seen",
        POINTS,
    )
    return out.withColumn("per_hour", F.round("per_hour", 6))


# ----------------------------------------------------------------------------------------- dyads


def _valid(spark, sf):
    return dyadic.valid_dyads(
        roles.dyads(spark, sf),
        roles.obs_membership(spark, sf),
        "animal",
        "partner",
        "day",
        "grp",
        "study",
        "OTHER",
        *SPAN,
    )


@query("valid_dyads", sql("SELECT * FROM valid", "valid"))
def valid_dyads(spark, sf):
    return _valid(spark, sf)


_KEEP = ["event_id", "day", "event_time", "grp"]


def _calls(spark, sf):
    return dyadic.win_loss(
        _valid(spark, sf),
        F.col("behaviour") == "click",
        "received",
        0,
        1,
        "animal",
        "partner",
        _KEEP,
        "grp",
        ["day", "event_time", "event_id"],
    )


@query(
    "win_loss_call",
    sql(
        """SELECT *, ROW_NUMBER() OVER (PARTITION BY grp ORDER BY day, event_time, event_id) AS contest_no FROM (
           SELECT event_id, day, event_time, grp, animal AS winner, partner AS loser FROM valid
           WHERE behaviour = 'click' AND received = 0
           UNION ALL SELECT event_id, day, event_time, grp, partner, animal FROM valid
           WHERE behaviour = 'click' AND received = 1)""",
        "valid",
    ),
)
def win_loss_call(spark, sf):
    return _calls(spark, sf)


@query(
    "win_loss_pass",
    sql(
        """SELECT *, ROW_NUMBER() OVER (PARTITION BY grp ORDER BY day, event_time, event_id) AS contest_no FROM (
           SELECT event_id, day, event_time, grp, animal AS winner, partner AS loser FROM valid
           WHERE behaviour = 'view' AND way = 'NoseToNose' AND location = 'Over'
           UNION ALL SELECT event_id, day, event_time, grp, partner, animal FROM valid
           WHERE behaviour = 'view' AND way = 'NoseToNose' AND location = 'Under')""",
        "valid",
    ),
)
def win_loss_pass(spark, sf):
    return dyadic.win_loss(
        _valid(spark, sf),
        (F.col("behaviour") == "view") & (F.col("way") == "NoseToNose"),
        "location",
        "Over",
        "Under",
        "animal",
        "partner",
        _KEEP,
        "grp",
        ["day", "event_time", "event_id"],
    )


@query(
    "partner_info",
    sql(
        """SELECT d.event_id, d.animal, d.partner, a.sex AS animal_sex, a.status AS animal_status,
             p.sex AS partner_sex, p.status AS partner_status
           FROM dyads d LEFT JOIN entity a ON a.animal = d.animal LEFT JOIN entity p ON p.animal = d.partner""",
        "dyads",
        "entity",
    ),
)
def partner_info(spark, sf):
    pairs = roles.dyads(spark, sf).select("event_id", "animal", "partner")
    info = roles.entity(spark, sf).select(F.col("animal").alias("who"), "sex", "status")
    return profile.partner_info(pairs, info, "animal", "partner", "who", ["sex", "status"])


_DATED = ", ".join(
    f"""ROUND(date_diff('day', {t}.birth_date, d.day) / 30.4375, 6) AS {r}_age,
        CASE WHEN {t}.start_date IS NULL THEN NULL WHEN d.day >= {t}.start_date THEN 'Started' ELSE 'Before' END
          AS {r}_stage"""
    for r, t in (("animal", "a"), ("partner", "p"))
)


@query(
    "partner_on_day",
    sql(
        f"""SELECT d.event_id, d.animal, d.partner, d.day, a.sex AS animal_sex, p.sex AS partner_sex, {_DATED}
           FROM dyads d LEFT JOIN entity a ON a.animal = d.animal LEFT JOIN entity p ON p.animal = d.partner""",
        "dyads",
        "entity",
    ),
)
def partner_on_day(spark, sf):
    """Age and stage of both sides on the day of the dyad."""
    pairs = roles.dyads(spark, sf).select("event_id", "animal", "partner", "day")
    info = roles.entity(spark, sf).select(F.col("animal").alias("who"), "sex", "birth_date", "start_date")

    def dated(side):
        started = F.when(F.col("day") >= side("start_date"), "Started").when(F.col("day") < side("start_date"), "Before")
        return {"age": F.round(age(F.col("day"), side("birth_date"), "months"), 6), "stage": started}

    out = profile.partner_info(pairs, info, "animal", "partner", "who", ["sex", "birth_date", "start_date"], dated)
    return out.drop(*[f"{r}_{c}" for r in ("animal", "partner") for c in ("birth_date", "start_date")])


_GAMES = """SELECT grp, day, animal AS winner, partner AS loser FROM valid
      WHERE behaviour = 'click' AND received = 0
      UNION ALL SELECT grp, day, partner, animal FROM valid WHERE behaviour = 'click' AND received = 1"""
#: each contest from both sides, with its period; a recursion over the periods, however many there are
_RATINGS = """SELECT 0 AS p, grp, player, 1000.0::DOUBLE AS rating FROM sides GROUP BY grp, player
    UNION ALL
    SELECT p + 1, grp, player, ANY_VALUE(rating) + LEAST(200, GREATEST(-200, COALESCE(SUM(
        100.0::DOUBLE * (won - 1 / (1 + POWER(10.0::DOUBLE, (other - rating) / 400.0::DOUBLE)))), 0)))
    FROM (
      SELECT r.p, r.grp, r.player, r.rating, s.won, o.rating AS other
      FROM ratings r
      LEFT JOIN sides s ON s.p = r.p AND s.grp = r.grp AND s.player = r.player
      LEFT JOIN ratings o ON o.p = r.p AND o.grp = s.grp AND o.player = s.opponent
      WHERE r.p <= (SELECT MAX(p) FROM sides))
    GROUP BY p, grp, player"""
_ELO = sql(
    """SELECT grp, player, wins, losses, ROUND(rating, 6) AS rating FROM ratings
       JOIN (SELECT grp, player, CAST(SUM(won) AS BIGINT) AS wins, CAST(SUM(1 - won) AS BIGINT) AS losses
             FROM sides GROUP BY ALL) USING (grp, player)
       WHERE p = (SELECT MAX(p) FROM ratings)""",
    "valid",
    games=_GAMES,
    sides="""SELECT grp, winner AS player, loser AS opponent, 1 AS won,
        date_diff('day', (SELECT MIN(day) FROM games), day) // 7 AS p FROM games
      UNION ALL SELECT grp, loser, winner, 0, date_diff('day', (SELECT MIN(day) FROM games), day) // 7 FROM games""",
    ratings=_RATINGS,
).replace("WITH ", "WITH RECURSIVE ", 1)


@query("elo_rating", _ELO)
def elo_rating(spark, sf):
    out = dyadic.periodic_ratings(_calls(spark, sf), "grp", "winner", "loser", "day", period_days=7)
    return out.withColumn("rating", F.round("rating", 6))


_IN_ORDER = sql(
    """SELECT grp, player, wins, losses, ROUND(rating, 6) AS rating FROM ratings
       JOIN (SELECT grp, player, CAST(SUM(won) AS BIGINT) AS wins, CAST(SUM(1 - won) AS BIGINT) AS losses
             FROM sides GROUP BY ALL) USING (grp, player)
       WHERE p = (SELECT MAX(p) FROM ratings)""",
    "valid",
    games="""SELECT *, ROW_NUMBER() OVER (PARTITION BY grp ORDER BY day, event_time, event_id) - 1 AS p FROM (
        SELECT event_id, day, event_time, grp, animal AS winner, partner AS loser FROM valid
        WHERE behaviour = 'click' AND received = 0
        UNION ALL SELECT event_id, day, event_time, grp, partner, animal FROM valid
        WHERE behaviour = 'click' AND received = 1)""",
    sides="""SELECT grp, winner AS player, loser AS opponent, 1 AS won, p FROM games
        UNION ALL SELECT grp, loser, winner, 0, p FROM games""",
    # a period is one contest here, and nothing bounds its move
    ratings=_RATINGS.replace("LEAST(200, GREATEST(-200, COALESCE(SUM(", "COALESCE(SUM(").replace(")), 0)))", ")), 0)"),
).replace("WITH ", "WITH RECURSIVE ", 1)


@query("elo_sequential", _IN_ORDER)
def elo_sequential(spark, sf):
    out = dyadic.sequential_ratings(_calls(spark, sf), "grp", "winner", "loser", "contest_no", block=200)
    return out.withColumn("rating", F.round("rating", 6))


# ---------------------------------------------------------------------------------- multivariate


def _wide(spark, sf):
    sums = [
        F.coalesce(F.sum(F.when(F.col("behaviour") == b, F.col("duration"))), F.lit(0))
        .cast("double")
        .alias(b)
        for b in EVENT_TYPES
    ]
    return roles.sessions(spark, sf).groupBy("animal", "day").agg(*sums)


_PAIRS = [(a, b) for i, a in enumerate(EVENT_TYPES) for b in EVENT_TYPES[i + 1 :]]


@query(
    "behaviour_correlation",
    sql(
        " UNION ALL ".join(
            f"SELECT '{a}' AS a, '{b}' AS b, ROUND(CORR({a}, {b}), 6) AS r FROM wide" for a, b in _PAIRS
        ),
        "sessions",
        wide="SELECT animal, day, "
        + ", ".join(
            f"CAST(COALESCE(SUM(duration) FILTER (behaviour = '{b}'), 0) AS DOUBLE) AS {b}"
            for b in EVENT_TYPES
        )
        + " FROM sessions GROUP BY ALL",
    ),
)
def behaviour_correlation(spark, sf):
    out = stats.behaviour_correlation(_wide(spark, sf), EVENT_TYPES)
    return out.withColumn("r", F.round("r", 6))


_WIDE_SQL = (
    "SELECT animal, day, "
    + ", ".join(f"CAST(COALESCE(SUM(duration) FILTER (behaviour = '{b}'), 0) AS DOUBLE) AS {b}" for b in EVENT_TYPES)
    + " FROM sessions GROUP BY ALL"
)
_EVENTS = f"[{', '.join(EVENT_TYPES)}]"
_SQUARINGS = 45


def _power(matrix: str) -> str:
    """SQL for the projector onto the first eigenvector: the matrix ``m`` of the table, squared again and again."""
    return f"""SELECT p FROM (WITH RECURSIVE it(i, m, t) AS (
          SELECT 0, m, [[r[j] FOR r IN m] FOR j IN range(1, len(m) + 1)] FROM {matrix}
          UNION ALL SELECT i + 1, [[x / s FOR x IN r] FOR r IN m2], [[x / s FOR x IN r] FOR r IN t2] FROM (
            SELECT i, m2, t2, list_sum([m2[j][j] FOR j IN range(1, len(m2) + 1)]) AS s FROM (
              SELECT i, [[list_dot_product(r, c) FOR c IN t] FOR r IN m] AS m2,
                [[list_dot_product(r, c) FOR r IN m] FOR c IN t] AS t2 FROM it WHERE i < {_SQUARINGS})))
        SELECT m AS p FROM it WHERE i = {_SQUARINGS})"""


def _deflated(matrix: str, projector: str) -> str:
    """SQL for the matrix without its first eigenvector."""
    return f"""SELECT [[m[i][j] - list_dot_product(m[i], [q[j] FOR q IN p]) FOR j IN range(1, len(m) + 1)]
          FOR i IN range(1, len(m) + 1)] AS m FROM {matrix}, {projector}"""


def _axis(projector: str) -> str:
    """SQL for the unit eigenvector of a projector, its largest loading positive."""
    return f"""SELECT [x / n * g FOR x IN v] AS v FROM (
          SELECT v, SQRT(list_dot_product(v, v)) AS n,
            CASE WHEN list_max(v) >= -list_min(v) THEN 1 ELSE -1 END AS g FROM (
            SELECT UNNEST([[r[j] FOR r IN p] FOR j IN range(1, len(p) + 1)]) AS v FROM {projector})
          ORDER BY n DESC LIMIT 1)"""


def _cells(name: str, of: str = "{a}, {b}") -> str:
    return "[" + ", ".join("[" + ", ".join(f"{name}({of.format(a=a, b=b)})" for b in EVENT_TYPES) + "]" for a in EVENT_TYPES) + "]"


@query(
    "pca",
    sql(
        f"""SELECT animal, day, ROUND(ABS(list_dot_product({_EVENTS}, a1.v)), 4) AS pc1,
             ROUND(ABS(list_dot_product({_EVENTS}, a2.v)), 4) AS pc2 FROM wide, a1, a2""",
        "sessions",
        wide=_WIDE_SQL,
        m1=f"SELECT {_cells('COVAR_SAMP')} AS m FROM wide",
        p1=_power("m1"),
        m2=_deflated("m1", "p1"),
        p2=_power("m2"),
        a1=_axis("p1"),
        a2=_axis("p2"),
    ),
)
def pca(spark, sf):
    """Scores on two components of all columns, up to their sign; the check squares the covariance matrix."""
    out = stats.principal_components(_wide(spark, sf), EVENT_TYPES, 2, keep=["animal", "day"])
    return out.select("animal", "day", *[F.round(F.abs(c), 4).alias(c) for c in ("pc1", "pc2")])


_TWO = EVENT_TYPES[:2]


def _counts(spark, sf):
    """How often each of two behaviours was shown per individual and day."""
    return roles.sessions(spark, sf).groupBy("animal", "day").agg(
        *[F.count(F.when(F.col("behaviour") == b, 1)).cast("double").alias(b) for b in _TWO]
    )


@query(
    "pca_two",
    sql(
        f"""SELECT animal, day, ROUND(ABS(a * v1 + b * v2), 4) AS pc1, ROUND(ABS(b * v1 - a * v2), 4) AS pc2
           FROM pairs, (
             SELECT x / SQRT(x * x + y * y) AS v1, y / SQRT(x * x + y * y) AS v2 FROM (
               SELECT sab AS x, (saa + sbb + SQRT((saa - sbb) * (saa - sbb) + 4 * sab * sab)) / 2 - saa AS y
               FROM (SELECT VAR_SAMP(a) AS saa, VAR_SAMP(b) AS sbb, COVAR_SAMP(a, b) AS sab FROM pairs)))""",
        "sessions",
        pairs=f"""SELECT animal, day, CAST(COUNT(*) FILTER (behaviour = '{_TWO[0]}') AS DOUBLE) AS a,
             CAST(COUNT(*) FILTER (behaviour = '{_TWO[1]}') AS DOUBLE) AS b FROM sessions GROUP BY ALL""",
    ),
)
def pca_two(spark, sf):
    """Two columns, whose components have a closed form."""
    out = stats.principal_components(_counts(spark, sf), _TWO, 2, keep=["animal", "day"])
    return out.select("animal", "day", *[F.round(F.abs(c), 4).alias(c) for c in ("pc1", "pc2")])


@query(
    "lda_two",
    sql(
        f"""SELECT animal, day, label,
             ROUND(ABS((a - ca) * x + (b - cb) * y) / SQRT(x * x + y * y), 6) AS ld1
           FROM pairs, (
             SELECT ca, cb, wbb * da - wab * db AS x, waa * db - wab * da AS y FROM (
               SELECT SUM(n * saa) AS waa, SUM(n * sbb) AS wbb, SUM(n * sab) AS wab,
                 SUM(n * ma) / SUM(n) AS ca, SUM(n * mb) / SUM(n) AS cb,
                 MAX(ma) FILTER (label = 1) - MAX(ma) FILTER (label = 0) AS da,
                 MAX(mb) FILTER (label = 1) - MAX(mb) FILTER (label = 0) AS db
               FROM (SELECT label, COUNT(*) AS n, VAR_POP(a) AS saa, VAR_POP(b) AS sbb,
                       COVAR_POP(a, b) AS sab, AVG(a) AS ma, AVG(b) AS mb FROM pairs GROUP BY label)))""",
        "sessions",
        pairs=f"""SELECT animal, day, CAST(animal % 2 AS INTEGER) AS label,
             CAST(COUNT(*) FILTER (behaviour = '{_TWO[0]}') AS DOUBLE) AS a,
             CAST(COUNT(*) FILTER (behaviour = '{_TWO[1]}') AS DOUBLE) AS b FROM sessions GROUP BY ALL""",
    ),
)
def lda_two(spark, sf):
    """Two classes and two columns, whose discriminant has a closed form up to its sign."""
    rows = _counts(spark, sf).withColumn("label", (F.col("animal") % 2).cast("int"))
    out = stats.linear_discriminants(rows, _TWO, "label", 1, keep=["animal", "day", "label"])
    return out.withColumn("ld1", F.round(F.abs("ld1"), 6))


def _labelled(spark, sf):
    return _wide(spark, sf).withColumn("label", (F.col("animal") % 3).cast("int"))


@query("multinomial")
def multinomial(spark, sf):
    rows = _labelled(spark, sf)
    model = stats.multinomial(rows, EVENT_TYPES, "label", max_iter=20)
    return stats.predict(model, rows, EVENT_TYPES, ["animal", "day", "label"])


_N = len(EVENT_TYPES)
_MEANS = f"[{', '.join(f'AVG({b})' for b in EVENT_TYPES)}]"


@query(
    "lda",
    sql(
        f"""SELECT animal, day, label,
             ROUND(list_dot_product({_EVENTS}, a1.v) - list_dot_product(c, a1.v), 6) AS ld1,
             ROUND(list_dot_product({_EVENTS}, a2.v) - list_dot_product(c, a2.v), 6) AS ld2
           FROM wide, centre, a1, a2""",
        "sessions",
        wide=_WIDE_SQL.replace("animal, day, ", "animal, day, CAST(animal % 3 AS INTEGER) AS label, ", 1),
        centre=f"SELECT {_MEANS} AS c FROM wide",
        classes=f"SELECT label, COUNT(*) AS n, {_MEANS} AS mean, {_cells('COVAR_POP')} AS cov FROM wide GROUP BY label",
        # within and between sums of products, cell by cell, side by side; then Gauss-Jordan leaves W^-1 B on the right
        cells=f"""SELECT i, j, SUM(n * cov[i][j]) AS w, SUM(n * (mean[i] - c[i]) * (mean[j] - c[j])) AS b
            FROM classes, centre, range(1, {_N + 1}) AS a(i), range(1, {_N + 1}) AS d(j) GROUP BY i, j""",
        sides="""SELECT list(row ORDER BY i) AS m FROM (
            SELECT i, list_concat(list(w ORDER BY j), list(b ORDER BY j)) AS row FROM cells GROUP BY i)""",
        m1=f"""SELECT [r[{_N + 1}:] FOR r IN m] AS m FROM (WITH RECURSIVE it(k, m) AS (
              SELECT 1, m FROM sides
              UNION ALL SELECT k + 1, [[CASE WHEN i = k THEN m[k][j] / m[k][k] ELSE m[i][j] - m[i][k] * m[k][j] / m[k][k] END
                FOR j IN range(1, {2 * _N + 1})] FOR i IN range(1, {_N + 1})] FROM it WHERE k <= {_N})
            SELECT m FROM it WHERE k = {_N + 1})""",
        p1=_power("m1"),
        m2=_deflated("m1", "p1"),
        p2=_power("m2"),
        a1=_axis("p1"),
        a2=_axis("p2"),
    ),
)
def lda(spark, sf):
    rows = _labelled(spark, sf)
    out = stats.linear_discriminants(rows, EVENT_TYPES, "label", 2, keep=["animal", "day", "label"])
    return out.withColumns({c: F.round(c, 6) for c in ("ld1", "ld2")})


@query(
    "multinomial_scores",
    sql(
        "SELECT class, term, ROUND(total, 3) AS observed, ROUND(total, 3) AS fitted FROM ("
        + " UNION ALL ".join(
            f"SELECT CAST(label AS VARCHAR) AS class, '{t}' AS term, {f'SUM({t})' if t != 'rows' else 'COUNT(*)::DOUBLE'} AS total"
            " FROM wide GROUP BY label"
            for t in ("rows", *EVENT_TYPES)
        )
        + ")",
        "sessions",
        wide=_WIDE_SQL.replace("animal, day, ", "animal, day, CAST(animal % 3 AS INTEGER) AS label, ", 1),
    ),
)
def multinomial_scores(spark, sf):
    """Observed and fitted totals of every column per class; the likelihood is at its maximum only where they agree."""
    rows = _labelled(spark, sf)
    fit = stats.multinomial_fit(rows, EVENT_TYPES, "label")
    terms = ("rows", *EVENT_TYPES)
    x = F.array(*[F.lit(1.0) if t == "rows" else F.col(t) for t in terms])
    share = fit.probabilities(rows).select(F.posexplode("p").alias("k", "p"), "label", x.alias("x"))
    names = F.array(*[F.lit(str(c)) for c in fit.classes])
    own = F.when(F.element_at(names, F.col("k") + 1) == F.col("label").cast("string"), 1.0).otherwise(0.0)
    sums = share.groupBy("k").agg(
        F.array(
            *[
                F.struct(
                    F.lit(t).alias("term"),
                    F.sum(F.col("x")[i] * own).alias("observed"),
                    F.sum(F.col("x")[i] * F.col("p")).alias("fitted"),
                )
                for i, t in enumerate(terms)
            ]
        ).alias("cells")
    )
    out = sums.select(F.element_at(names, F.col("k") + 1).alias("class"), F.inline("cells"))
    return out.withColumns({c: F.round(c, 3) for c in ("observed", "fitted")})


@query(
    "multinomial_coefficients",
    sql(
        """SELECT class, term, ROUND(estimate, 5) AS estimate, ROUND(std_error, 5) AS std_error FROM (
             SELECT k.behaviour AS class, t.term,
               CASE WHEN t.term = 'odd' THEN LN(k.n1 / b.n1) - LN(k.n0 / b.n0) ELSE LN(k.n0 / b.n0) END AS estimate,
               SQRT(1 / k.n0 + 1 / b.n0 + CASE WHEN t.term = 'odd' THEN 1 / k.n1 + 1 / b.n1 ELSE 0 END) AS std_error
             FROM counts k, (SELECT * FROM counts ORDER BY behaviour LIMIT 1) b, (VALUES ('(Intercept)'), ('odd')) AS t(term)
             WHERE k.behaviour > b.behaviour)""",
        "sessions",
        counts="""SELECT behaviour, CAST(COUNT(*) FILTER (animal % 2 = 0) AS DOUBLE) AS n0,
             CAST(COUNT(*) FILTER (animal % 2 = 1) AS DOUBLE) AS n1 FROM sessions GROUP BY behaviour""",
    ),
)
def multinomial_coefficients(spark, sf):
    """Which behaviour was shown, by a column of two values, where estimates and errors have a closed form."""
    rows = roles.sessions(spark, sf).select("behaviour", (F.col("animal") % 2).cast("double").alias("odd"))
    fit = stats.multinomial_fit(rows, ["odd"], "behaviour").table(spark)
    return fit.select("class", "term", *[F.round(c, 5).alias(c) for c in ("estimate", "std_error")])
