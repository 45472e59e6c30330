"""Pairing and litter histories, cohort assembly, quality checks."""

from __future__ import annotations

from pyspark.sql import functions as F

from cohortspark.operators import cohort, history, quality
from cohortspark.operators.ordering import summary_stats as stats
from cohortspark.operators.relational import lookup, natural_join
from cohortspark.plans import roles
from cohortspark.plans.registry import query
from cohortspark.plans.roles import PRIORITIES, SEGMENTS, sql

SPAN = ("member_from", "member_to")

# ------------------------------------------------------------------------------------- histories

_PARENTS = """SELECT o_orderkey AS litter, UPPER('c' || o_custkey) AS parent, CAST(o_orderdate AS DATE) AS day
    FROM orders
    UNION ALL
    SELECT DISTINCT o_orderkey, 's' || l_suppkey, CAST(o_orderdate AS DATE)
    FROM orders JOIN lineitem ON l_orderkey = o_orderkey WHERE l_suppkey % 10 > 1"""


def _parents(spark, sf):
    births = roles.table(spark, sf, "orders").select(
        F.col("o_orderkey").alias("litter"),
        F.concat(F.lit("c"), F.col("o_custkey").cast("string")).alias("mother"),
        roles.day_of("o_orderdate").alias("day"),
    )
    s = F.col("l_suppkey")
    sires = roles.table(spark, sf, "lineitem").select(
        F.col("l_orderkey").alias("litter"),
        F.when(s % 10 == 0, "Unknown ")
        .when(s % 10 == 1, "Unknown")
        .otherwise(F.concat(F.lit("s"), s.cast("string")))
        .alias("father"),
    )
    return history.parent_events(births, sires, "litter", "mother", "father", "day", "parent")


@query("parent_events", sql(_PARENTS))
def parent_events(spark, sf):
    return _parents(spark, sf)


@query(
    "pairing_sequence",
    sql(
        """SELECT animal, colony, pairing_day,
             ROW_NUMBER() OVER (PARTITION BY animal ORDER BY pairing_day, colony) AS pairing_no,
             ROW_NUMBER() OVER (PARTITION BY animal, colony ORDER BY pairing_day) AS pairing_no_in_group,
             DENSE_RANK() OVER (PARTITION BY colony ORDER BY pairing_day) AS group_pairing_no
           FROM (SELECT DISTINCT animal, colony, pairing_day FROM pairings)""",
        "pairings",
    ),
)
def pairing_sequence(spark, sf):
    return history.pairing_sequence(roles.pairings(spark, sf), "animal", "colony", "pairing_day")


_PAIRED = """SELECT event_id, animal, day, pairing_day, colony, pairing_gap FROM (
    SELECT l.event_id, l.animal, l.day, p.pairing_day, p.colony,
      date_diff('day', p.pairing_day, l.day) AS pairing_gap,
      ROW_NUMBER() OVER (PARTITION BY l.event_id, l.animal ORDER BY p.pairing_day DESC, p.colony) AS rn
    FROM litters l JOIN pairings p ON p.animal = l.animal
      AND date_diff('day', p.pairing_day, l.day) > 80) WHERE rn = 1"""


@query("attribute_pairing", sql(_PAIRED, "litters", "pairings"))
def attribute_pairing(spark, sf):
    return history.attribute_pairing(
        roles.litters(spark, sf),
        roles.pairings(spark, sf),
        "animal",
        "day",
        "pairing_day",
        "colony",
        80,
        "pairing_gap",
    )


_EVENT_GROUP = """SELECT l.event_id, l.animal, l.day, l.day - 88 AS conception_day,
      b.grp AS event_group, c.grp AS conception_group
    FROM litters l
    LEFT JOIN membership b ON b.animal = l.animal AND l.day BETWEEN b.member_from AND b.member_to
    LEFT JOIN membership c ON c.animal = l.animal AND l.day - 88 BETWEEN c.member_from AND c.member_to"""


@query("event_group", sql(_EVENT_GROUP, "litters", "membership"))
def event_group(spark, sf):
    return history.event_group(
        roles.litters(spark, sf), roles.membership(spark, sf), "animal", "day", "grp", *SPAN
    )


_HISTORY = """SELECT DISTINCT h.*, b.grp AS event_group
    FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY animal, conception_group
        ORDER BY day, event_id, event_no) AS event_no_in_group FROM (
      SELECT l.event_id, l.animal, e.sex, l.day, p.pairing_day, p.colony, p.pairing_gap,
        l.day - 88 AS conception_day, c.grp AS conception_group,
        ROW_NUMBER() OVER (PARTITION BY l.animal ORDER BY l.day, l.event_id, c.grp NULLS LAST) AS event_no,
        DENSE_RANK() OVER (PARTITION BY c.grp ORDER BY l.day) AS group_event_no
      FROM litters l JOIN entity e ON e.animal = l.animal
      LEFT JOIN paired p ON p.event_id = l.event_id AND p.animal = l.animal
      LEFT JOIN membership c ON c.animal = l.animal
        AND l.day - 88 BETWEEN c.member_from AND c.member_to)) h
    LEFT JOIN membership b ON b.animal = h.animal AND h.day BETWEEN b.member_from AND b.member_to"""


def _history(spark, sf):
    return history.event_history(
        roles.litters(spark, sf),
        roles.entity(spark, sf).select("animal", "sex"),
        roles.pairings(spark, sf),
        roles.membership(spark, sf),
        "animal",
        "event_id",
        "day",
        "pairing_day",
        "colony",
        "grp",
        *SPAN,
    )


@query("event_history", sql(_HISTORY, "litters", "entity", "membership", "pairings", paired=_PAIRED))
def event_history(spark, sf):
    return _history(spark, sf)


@query(
    "breeder_membership",
    sql(
        """SELECT b.animal, m.grp, m.member_from, m.member_to, e.sex
           FROM (SELECT DISTINCT animal FROM litters) b LEFT JOIN membership m ON m.animal = b.animal
           LEFT JOIN entity e ON e.animal = b.animal""",
        "litters",
        "membership",
        "entity",
    ),
)
def breeder_membership(spark, sf):
    return history.breeder_membership(
        roles.litters(spark, sf),
        roles.membership(spark, sf),
        roles.entity(spark, sf).select("animal", "sex"),
        "animal",
    )


_TIMELINE = """SELECT e.animal, p.pairing_id, p.pairing_day,
      ROW_NUMBER() OVER w AS pairing_no, LEAD(p.pairing_day) OVER w AS next_pairing_day,
      date_diff('day', e.start_date, p.pairing_day) AS days_from_start
    FROM entity e LEFT JOIN pairings p ON p.animal = e.animal
    WINDOW w AS (PARTITION BY e.animal ORDER BY p.pairing_day, p.pairing_id)"""


def _timeline(spark, sf):
    return history.pairing_timeline(
        roles.entity(spark, sf).select("animal", "start_date"),
        roles.pairings(spark, sf).drop("colony"),
        "animal",
        "pairing_day",
        "pairing_id",
        "start_date",
    ).drop("start_date")


@query("pairing_timeline", sql(_TIMELINE, "entity", "pairings"))
def pairing_timeline(spark, sf):
    return _timeline(spark, sf)


@query(
    "repeated_pairings",
    sql(
        "SELECT animal, pairing_id, pairing_day, pairing_no FROM timeline WHERE pairing_no > 1",
        "entity",
        "pairings",
        timeline=_TIMELINE,
    ),
)
def repeated_pairings(spark, sf):
    rows = _timeline(spark, sf).filter(F.col("pairing_no") > 1)
    return rows.select("animal", "pairing_id", "pairing_day", "pairing_no")


@query(
    "pairing_success",
    sql(
        """SELECT q.animal, q.pairing_day, f.first_event_day,
             CASE WHEN f.first_event_day IS NULL THEN 'No' ELSE 'Yes' END AS successful,
             e.first_event_ever
           FROM (SELECT DISTINCT animal, pairing_day FROM pairings) q
           LEFT JOIN (SELECT animal, pairing_day, MIN(day) AS first_event_day FROM paired GROUP BY ALL) f
             ON f.animal = q.animal AND f.pairing_day = q.pairing_day
           LEFT JOIN (SELECT animal, MIN(day) AS first_event_ever FROM litters GROUP BY ALL) e
             ON e.animal = q.animal""",
        "litters",
        "pairings",
        paired=_PAIRED,
    ),
)
def pairing_success(spark, sf):
    births, pairs = roles.litters(spark, sf), roles.pairings(spark, sf)
    paired = history.attribute_pairing(births, pairs, "animal", "day", "pairing_day", "colony")
    litters = lookup(births, paired.select("animal", "event_id", "pairing_day"), ["animal", "event_id"])
    return history.pairing_success(pairs, litters, "animal", "pairing_day", "day")


@query(
    "first_event_both_parents",
    sql(
        """SELECT f.animal, f.day, m.grp FROM (
             SELECT animal, MIN(day) AS day FROM order_days GROUP BY animal
             UNION
             SELECT l_suppkey, MIN(day) FROM lineitem JOIN order_days ON event_id = l_orderkey
             GROUP BY l_suppkey) f
           JOIN membership m ON m.animal = f.animal AND f.day BETWEEN m.member_from AND m.member_to""",
        "membership",
    ),
)
def first_event_both_parents(spark, sf):
    mothers = roles.order_days(spark, sf)
    fathers = (
        roles.table(spark, sf, "lineitem")
        .select(F.col("l_orderkey").alias("event_id"), F.col("l_suppkey").alias("father"))
        .join(mothers.select("event_id", "day"), "event_id")
        .select(F.col("father").alias("animal"), "day")
    )
    return history.first_event_both_parents(
        mothers, fathers, roles.membership(spark, sf), "animal", "day", "grp", *SPAN
    )


# ---------------------------------------------------------------------------------------- cohort

_ALIASES = {"1-URGENT": "URGENT", "5-LOW": "LOW"}
_EXCLUDED = (1, 2, 3, 5, 8, 13)


@query(
    "alias_ids",
    sql(
        """SELECT event_id, CASE grp WHEN '1-URGENT' THEN 'URGENT' WHEN '5-LOW' THEN 'LOW' ELSE grp END
             AS grp FROM order_days""",
        "order_days",
    ),
)
def alias_ids(spark, sf):
    rows = roles.order_days(spark, sf).select("event_id", "grp")
    return cohort.alias_ids(rows, "grp", _ALIASES)


@query(
    "cohort_members",
    sql(
        """SELECT animal, study, CASE WHEN animal IN (SELECT animal FROM donors) THEN 'Yes' ELSE 'No' END
             AS euthanized
           FROM (SELECT * FROM subjects UNION ALL
                 SELECT animal, NULL FROM donors WHERE animal NOT IN (SELECT animal FROM subjects))""",
        "order_days",
        subjects="""SELECT c_custkey AS animal, c_mktsegment AS study FROM customer
            WHERE c_mktsegment = 'BUILDING' AND c_custkey NOT IN (1, 2, 3, 5, 8, 13)""",
        donors="""SELECT DISTINCT animal FROM order_days WHERE status = 'F' AND day >= DATE '2001-01-01'""",
    ),
)
def cohort_members(spark, sf):
    subjects = (
        roles.table(spark, sf, "customer")
        .filter(F.col("c_mktsegment") == "BUILDING")
        .select(F.col("c_custkey").alias("animal"), F.col("c_mktsegment").alias("study"))
    )
    donors = roles.order_days(spark, sf).filter(
        (F.col("status") == "F") & (F.col("day") >= F.lit("2001-01-01").cast("date"))
    )
    return cohort.cohort_members(subjects, donors, "animal", _EXCLUDED)


_SMALL_GROUPS = """SELECT animal, grp || '/' || (animal % 300) AS grp, member_from, member_to FROM membership"""
_TREATMENT = """SELECT t.animal, t.start_group, t.experiment_group, s.group_size,
      CASE WHEN s.group_size = 1 THEN 'Solitary' WHEN t.experiment_group <> t.start_group THEN 'Breeder'
           ELSE 'Helper' END AS treatment
    FROM (SELECT e.animal, e.start_date + 14 AS at_day,
        (SELECT arg_min(m.grp, m.member_from) FROM small m WHERE m.animal = e.animal
          AND e.first_day + 20 BETWEEN m.member_from AND m.member_to) AS start_group,
        (SELECT arg_min(m.grp, m.member_from) FROM small m WHERE m.animal = e.animal
          AND e.start_date + 14 BETWEEN m.member_from AND m.member_to) AS experiment_group
      FROM entity e) t
    JOIN (SELECT grp, at_day, COUNT(*) AS group_size FROM
        (SELECT DISTINCT start_date + 14 AS at_day FROM entity WHERE start_date IS NOT NULL) d
        JOIN small m ON d.at_day BETWEEN m.member_from AND m.member_to GROUP BY ALL) s
      ON s.grp = t.experiment_group AND s.at_day = t.at_day"""


def _treatment(spark, sf):
    a = F.col("animal")
    small = roles.membership(spark, sf).withColumn(
        "grp", F.concat(F.col("grp"), F.lit("/"), (a % 300).cast("string"))
    )
    out = cohort.treatment(
        roles.entity(spark, sf).select("animal", "first_day", "start_date"),
        small,
        "animal",
        "first_day",
        "start_date",
        "grp",
        *SPAN,
    )
    return out.select("animal", "start_group", "experiment_group", "group_size", "treatment")


@query("treatment", sql(_TREATMENT, "entity", "membership", small=_SMALL_GROUPS))
def treatment(spark, sf):
    return _treatment(spark, sf)


_UNITS = """SELECT segment, sex, nation, first_start,
      ROW_NUMBER() OVER (PARTITION BY segment, sex ORDER BY first_start NULLS LAST, nation) AS unit
    FROM (SELECT segment, sex, nation, MIN(start_date) AS first_start FROM entity GROUP BY ALL)"""


def _units(spark, sf):
    return cohort.experimental_unit(
        roles.entity(spark, sf), "segment", "sex", "nation", "start_date"
    )


@query("experimental_unit", sql(_UNITS, "entity"))
def experimental_unit(spark, sf):
    return _units(spark, sf)


@query(
    "study_info",
    sql(
        """SELECT e.animal, e.segment, e.sex, u.unit, t.treatment,
             CASE WHEN e.start_date > DATE '2000-01-01' THEN 2 ELSE 1 END AS series,
             ROUND(date_diff('day', e.birth_date, e.start_date) / 30.4375, 6) AS start_age,
             ROUND(date_diff('day', e.start_date, e.death_date) / 30.4375, 6) AS duration
           FROM entity e
           LEFT JOIN units u ON u.segment = e.segment AND u.sex = e.sex AND u.nation = e.nation
           LEFT JOIN treated t ON t.animal = e.animal""",
        "entity",
        "membership",
        small=_SMALL_GROUPS,
        units=_UNITS,
        treated=_TREATMENT,
    ),
)
def study_info(spark, sf):
    out = cohort.study_info(
        roles.entity(spark, sf),
        [
            (_units(spark, sf).drop("first_start"), ["segment", "sex", "nation"]),
            (_treatment(spark, sf).select("animal", "treatment"), ["animal"]),
        ],
        "start_date",
        "birth_date",
        "death_date",
        "2000-01-01",
    )
    return out.select(
        "animal",
        "segment",
        "sex",
        "unit",
        "treatment",
        "series",
        F.round("start_age", 6).alias("start_age"),
        F.round("duration", 6).alias("duration"),
    )


_COHORT = """SELECT x.*, CASE WHEN first_conception IS NOT NULL THEN 'Breeder' WHEN animal = 7 THEN 'Solitary'
      WHEN status IN ('King', 'Queen') THEN 'Breeder' ELSE status END AS queried_status
    FROM (SELECT e.animal, e.sex, e.nation, e.death_age, f.first_conception,
        CASE WHEN e.animal IN (SELECT animal FROM order_days WHERE grp = '1-URGENT') THEN 'Yes' END AS punched,
        CASE WHEN e.animal IN (SELECT animal FROM order_days WHERE grp = '2-HIGH') THEN 'Yes' END AS sequenced,
        CASE WHEN e.death_age < 400 THEN 'Pup' ELSE e.status END AS status
      FROM (SELECT *, date_diff('day', birth_date, death_date) AS death_age FROM entity) e
      LEFT JOIN (SELECT animal, MIN(day) - 88 AS first_conception FROM order_days
                 WHERE grp = '3-MEDIUM' AND status = 'F' GROUP BY animal) f ON f.animal = e.animal) x"""


def _cohort(spark, sf):
    ent, days = roles.entity(spark, sf), roles.order_days(spark, sf)
    conceived = (
        days.filter((F.col("grp") == "3-MEDIUM") & (F.col("status") == "F"))
        .groupBy("animal")
        .agg(F.date_sub(F.min("day"), 88).alias("first_conception"))
    )
    facts = ent.select(
        "animal",
        "sex",
        "nation",
        "status",
        F.datediff("death_date", "birth_date").cast("bigint").alias("death_age"),
    )
    return cohort.cohort_table(
        ent.select("animal"),
        [facts, conceived],
        {
            "punched": days.filter(F.col("grp") == "1-URGENT"),
            "sequenced": days.filter(F.col("grp") == "2-HIGH"),
        },
        "animal",
        "death_age",
        "status",
        "first_conception",
        pup_age=400,
        overrides={7: "Solitary"},
    )


@query("cohort_table", sql(_COHORT, "entity"))
def cohort_table(spark, sf):
    return _cohort(spark, sf)


_WIDE = ", ".join(f"COUNT(*) FILTER (segment = '{s}') AS \"{s}\"" for s in SEGMENTS)


@query(
    "sample_size_table",
    sql(f"SELECT sex, {_WIDE} FROM entity GROUP BY sex", "entity"),
)
def sample_size_table(spark, sf):
    return cohort.sample_size_table(roles.entity(spark, sf), "sex", "segment", SEGMENTS)


def _placed(spark, sf):
    nations = roles.table(spark, sf, "nation").join(
        roles.table(spark, sf, "region"), F.col("n_regionkey") == F.col("r_regionkey")
    )
    places = nations.select(F.col("n_nationkey").alias("nation"), F.col("r_name").alias("region"))
    return natural_join(roles.entity(spark, sf), places, "inner", "nation")


_PLACED = """SELECT e.*, r_name AS region FROM entity e JOIN nation ON n_nationkey = e.nation
    JOIN region ON r_regionkey = n_regionkey"""


@query(
    "dataset_table",
    sql(
        f"""SELECT sex, region, COALESCE(CAST(unit AS VARCHAR), 'Non-Experimental') AS unit, {_WIDE}
            FROM (SELECT *, CASE WHEN nation % 4 <> 0 THEN nation END AS unit FROM placed)
            GROUP BY sex, region, unit""",
        "entity",
        placed=_PLACED,
    ),
)
def dataset_table(spark, sf):
    rows = _placed(spark, sf).withColumn("unit", F.when(F.col("nation") % 4 != 0, F.col("nation")))
    return cohort.dataset_table(rows, ["sex", "region"], "unit", "segment", SEGMENTS)


@query(
    "region_table",
    sql(f"SELECT sex, region, {_WIDE} FROM placed GROUP BY ALL", "entity", placed=_PLACED),
)
def region_table(spark, sf):
    return cohort.region_table(_placed(spark, sf), ["sex", "region"], "segment", SEGMENTS)


@query(
    "region_table_by_animal",
    sql(
        "SELECT animal, "
        + ", ".join(f"COUNT(*) FILTER (grp = '{p}') AS \"{p}\"" for p in PRIORITIES)
        + " FROM order_days GROUP BY animal",
        "order_days",
    ),
)
def region_table_by_animal(spark, sf):
    return cohort.region_table(roles.order_days(spark, sf), ["animal"], "grp", PRIORITIES)


# --------------------------------------------------------------------------------------- quality


@query(
    "incomplete_units",
    sql(
        """SELECT sex, unit, animal, CASE WHEN done THEN 'Yes' ELSE 'No' END AS processed,
             n_processed, n_unprocessed
           FROM (SELECT *, COUNT(*) FILTER (done) OVER w AS n_processed,
                   COUNT(*) FILTER (NOT done) OVER w AS n_unprocessed
                 FROM (SELECT sex, CASE WHEN nation % 4 <> 0 THEN nation * 100 + animal % 50 END AS unit,
                         animal, COALESCE(start_date < DATE '2000-06-01', FALSE) AS done FROM entity)
                 WHERE unit IS NOT NULL WINDOW w AS (PARTITION BY sex, unit))
           WHERE n_processed > 0 AND n_unprocessed > 0""",
        "entity",
    ),
)
def incomplete_units(spark, sf):
    unit = F.when(F.col("nation") % 4 != 0, F.col("nation") * 100 + F.col("animal") % 50)
    rows = roles.entity(spark, sf).select("sex", unit.alias("unit"), "animal", "start_date")
    done = F.col("start_date") < F.lit("2000-06-01").cast("date")
    return quality.incomplete_units(rows, ["sex", "unit"], done, drop_null=["unit"]).drop("start_date")


@query(
    "set_difference_check",
    sql(
        """SELECT animal, sex, segment FROM entity WHERE animal NOT IN
             (SELECT animal FROM order_days WHERE grp = '1-URGENT' AND status = 'F')""",
        "entity",
    ),
)
def set_difference_check(spark, sf):
    seen = roles.order_days(spark, sf).filter(
        (F.col("grp") == "1-URGENT") & (F.col("status") == "F")
    )
    rows = roles.entity(spark, sf).select("animal", "sex", "segment")
    return quality.set_difference_check(rows, seen, ["animal"])


@query(
    "status_contradictions",
    sql(
        """SELECT animal, status, first_conception, 'helper that bred' AS problem FROM cohort
           WHERE status = 'Helper' AND first_conception IS NOT NULL
           UNION ALL SELECT animal, status, first_conception, 'breeder that never bred' FROM cohort
           WHERE status IN ('King', 'Queen') AND first_conception IS NULL""",
        "entity",
        cohort=_COHORT,
    ),
)
def status_contradictions(spark, sf):
    rows = _cohort(spark, sf).select("animal", "status", "first_conception")
    bred = F.col("first_conception").isNotNull()
    return quality.status_contradictions(
        rows,
        {
            "helper that bred": (F.col("status") == "Helper") & bred,
            "breeder that never bred": F.col("status").isin("King", "Queen") & ~bred,
        },
    )


@query(
    "duplicate_check",
    sql(
        """SELECT * FROM (SELECT animal, day, event_id, COUNT(*) OVER (PARTITION BY animal, day) AS n
             FROM order_days) WHERE n > 1""",
        "order_days",
    ),
)
def duplicate_check(spark, sf):
    rows = roles.order_days(spark, sf).select("animal", "day", "event_id")
    return quality.duplicate_check(rows, ["animal", "day"])


_DELAYS = """SELECT *, CASE WHEN end_delay < 6 THEN 6 WHEN end_delay < 12 THEN 12 WHEN end_delay < 18 THEN 18
      WHEN end_delay < 24 THEN 24 WHEN end_delay < 30 THEN 30 WHEN end_delay < 36 THEN 36
      WHEN end_delay < 42.5 THEN 42 ELSE end_delay END AS months_before_end
    FROM (SELECT p.animal, p.day, e.status,
        date_diff('day', e.birth_date, p.day) / 30.4375 AS obs_age,
        date_diff('day', p.day, e.death_date) / 30.4375 AS end_delay,
        date_diff('day', e.start_date, p.day) / 30.4375 AS start_delay
      FROM points p JOIN entity e ON e.animal = p.animal)"""
_ELIGIBLE = """SELECT * FROM delays WHERE (status IN ('Solitary', 'Queen', 'King') AND start_delay > 0)
    OR (obs_age > 11 AND start_delay IS NULL)
    OR (obs_age > 11 AND status = 'Helper' AND start_delay IS NOT NULL)"""


def _delays(spark, sf):
    who = roles.entity(spark, sf).select("animal", "birth_date", "start_date", "death_date", "status")
    return quality.delay_bins(
        roles.points(spark, sf), who, "animal", "day", "birth_date", "start_date", "death_date"
    ).select("animal", "day", "status", "obs_age", "end_delay", "start_delay", "months_before_end")


def _rounded(df):
    return df.withColumns(
        {c: F.round(c, 6) for c in ("obs_age", "end_delay", "start_delay", "months_before_end")}
    )


_ROUNDED = """SELECT animal, day, status, ROUND(obs_age, 6) AS obs_age, ROUND(end_delay, 6) AS end_delay,
    ROUND(start_delay, 6) AS start_delay, ROUND(months_before_end, 6) AS months_before_end"""


@query("delay_bins", sql(f"{_ROUNDED} FROM delays", "points", "entity", delays=_DELAYS))
def delay_bins(spark, sf):
    return _rounded(_delays(spark, sf))


@query(
    "eligible_by_delay",
    sql(f"{_ROUNDED} FROM eligible", "points", "entity", delays=_DELAYS, eligible=_ELIGIBLE),
)
def eligible_by_delay(spark, sf):
    return _rounded(quality.eligible_by_delay(_delays(spark, sf), "status"))


@query(
    "bin_counts",
    sql(
        """SELECT animal, status, ROUND(months_before_end, 6) AS months_before_end, COUNT(*) AS n
           FROM eligible GROUP BY animal, status, ROUND(months_before_end, 6)""",
        "points",
        "entity",
        delays=_DELAYS,
        eligible=_ELIGIBLE,
    ),
)
def bin_counts(spark, sf):
    rows = _rounded(quality.eligible_by_delay(_delays(spark, sf), "status"))
    return quality.bin_counts(rows, ["animal", "status", "months_before_end"])


@query(
    "summary_stats",
    sql(
        """SELECT l_returnflag, MIN(l_extendedprice) AS min,
             ROUND(quantile_cont(l_extendedprice, 0.25), 6) AS q1,
             ROUND(quantile_cont(l_extendedprice, 0.5), 6) AS median,
             ROUND(AVG(CAST(l_extendedprice AS DECIMAL(18,2))), 4) AS mean,
             ROUND(quantile_cont(l_extendedprice, 0.75), 6) AS q3, MAX(l_extendedprice) AS max,
             COUNT(*) - COUNT(l_extendedprice) AS n_null
           FROM lineitem GROUP BY l_returnflag"""
    ),
)
def summary_stats(spark, sf):
    out = stats(
        roles.table(spark, sf, "lineitem"), "l_extendedprice", by=["l_returnflag"], width=1000.0
    )
    digits = {"q1": 6, "median": 6, "mean": 4, "q3": 6}
    return out.withColumns({c: F.round(c, n) for c, n in digits.items()})


