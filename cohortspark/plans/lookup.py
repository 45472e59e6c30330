"""Interval membership, nearest-in-time lookups, profile and status at a date, group composition."""

from __future__ import annotations

from pyspark.sql import functions as F

from cohortspark.functions import status as labels
from cohortspark.functions.dates import day_diff
from cohortspark.operators import asof, intervals, profile
from cohortspark.operators.relational import lookup, natural_join
from cohortspark.plans import roles
from cohortspark.plans.registry import query
from cohortspark.plans.roles import sql
from cohortspark.session import staged

SPAN = ("member_from", "member_to")


@query(
    "interval_membership",
    sql(
        """SELECT p.animal, p.day, m.grp FROM points p JOIN membership m ON m.animal = p.animal
           AND p.day >= m.member_from AND p.day <= m.member_to""",
        "points",
        "membership",
    ),
)
def interval_membership(spark, sf):
    return intervals.interval_membership(
        roles.points(spark, sf), roles.membership(spark, sf), "animal", "day", *SPAN
    )


@query(
    "group_roster",
    sql(
        """SELECT g.grp, m.animal, g.day
           FROM (SELECT DISTINCT grp, CAST(date_trunc('month', day) AS DATE) AS day FROM order_days) g
           JOIN membership m ON m.grp = g.grp AND g.day BETWEEN m.member_from AND m.member_to""",
        "membership",
    ),
)
def group_roster(spark, sf):
    days = roles.order_days(spark, sf).select(
        "grp", F.trunc("day", "month").alias("day")
    )
    return intervals.group_roster(days, roles.membership(spark, sf), "grp", "day", "animal", *SPAN)


@query(
    "group_at_offset",
    sql(
        """SELECT animal, grp AS start_group FROM (
             SELECT e.animal, m.grp,
               ROW_NUMBER() OVER (PARTITION BY e.animal ORDER BY m.member_from) AS rn
             FROM entity e JOIN membership m ON m.animal = e.animal AND m.grp <> '5-LOW'
               AND e.first_day + 20 BETWEEN m.member_from AND m.member_to) WHERE rn = 1""",
        "entity",
        "membership",
    ),
)
def group_at_offset(spark, sf):
    return intervals.group_at_offset(
        roles.entity(spark, sf),
        roles.membership(spark, sf),
        "animal",
        "first_day",
        20,
        "grp",
        *SPAN,
        "start_group",
        exclude=("5-LOW",),
    )


_CHANGE = """SELECT p.animal, p.day, CASE WHEN g.n > 1 THEN 'Yes' ELSE 'No' END AS change_day
    FROM points p LEFT JOIN (SELECT p.animal, p.day, COUNT(DISTINCT m.grp) AS n
      FROM points p JOIN membership m ON m.animal = p.animal
        AND p.day BETWEEN m.member_from AND m.member_to GROUP BY ALL) g
      ON g.animal = p.animal AND g.day = p.day"""


@query("change_day_flag", sql(_CHANGE, "points", "membership"))
def change_day_flag(spark, sf):
    # used twice: written once, so that shipments are joined once
    pts = staged(roles.points(spark, sf))
    where = intervals.interval_membership(pts, roles.membership(spark, sf), "animal", "day", *SPAN, unique=True)
    return intervals.change_day_flag(pts, where, ["animal", "day"], "grp")


@query(
    "declared_vs_derived",
    sql(
        """SELECT d.event_id, d.animal, d.day, d.declared, w.grp AS derived,
             CASE WHEN d.declared = w.grp THEN 'Yes' ELSE 'No' END AS agrees
           FROM declared d JOIN placed w ON w.animal = d.animal AND w.day = d.day
           WHERE NOT EXISTS (SELECT 1 FROM placed x WHERE x.animal = d.animal AND x.day = d.day
             GROUP BY x.animal, x.day HAVING COUNT(DISTINCT x.grp) > 1)""",
        "membership",
        declared="SELECT event_id, animal, day + 30 AS day, grp AS declared FROM order_days",
        placed="""SELECT d.animal, d.day, m.grp FROM (SELECT DISTINCT animal, day FROM declared) d
             JOIN membership m ON m.animal = d.animal AND d.day BETWEEN m.member_from AND m.member_to""",
    ),
)
def declared_vs_derived(spark, sf):
    declared = roles.order_days(spark, sf).select(
        "event_id", "animal", F.date_add("day", 30).alias("day"), F.col("grp").alias("declared")
    )
    where = intervals.interval_membership(
        declared, roles.membership(spark, sf), "animal", "day", *SPAN
    ).withColumnRenamed("grp", "derived")
    return intervals.declared_vs_derived(
        declared, where, ["animal", "day"], "declared", "derived", exclude_change_days=True
    )


@query(
    "roster_union",
    sql(
        """SELECT DISTINCT day, UPPER(id) AS id FROM (
             SELECT g.day, 'u' || m.animal AS id
             FROM (SELECT DISTINCT animal % 5 AS grp, day FROM obs) g
             JOIN obs_membership m ON m.grp = g.grp AND g.day BETWEEN m.member_from AND m.member_to
             UNION ALL SELECT day, 'U' || animal FROM obs
             UNION ALL SELECT day, 'u' || k FROM obs)""",
        "obs",
        "obs_membership",
    ),
)
def roster_union(spark, sf):
    seen = roles.obs(spark, sf)
    days = seen.select((F.col("animal") % 5).alias("grp"), "day")
    named = F.concat(F.lit("u"), F.col("animal").cast("string"))
    queried = intervals.group_roster(
        days, roles.obs_membership(spark, sf), "grp", "day", "animal", *SPAN
    ).select("day", named.alias("id"))
    both = F.array(
        F.concat(F.lit("U"), F.col("animal").cast("string")),
        F.concat(F.lit("u"), F.col("k").cast("string")),
    )
    return intervals.roster_union(queried, seen.select("day", F.explode(both).alias("id")), "id")


def _nearest_sql(diff: str, keep: str, best: str) -> str:
    return sql(
        f"""SELECT animal, day, CAST(MIN(diff) AS BIGINT) AS day_diff, ROUND(AVG(weight), 6) AS weight
            FROM (SELECT *, {best}(diff) OVER (PARTITION BY animal, day) AS best FROM (
              SELECT p.animal, p.day, s.weight, {diff} AS diff
              FROM (SELECT DISTINCT animal, day FROM order_days) p JOIN shipments s ON s.animal = p.animal)
              WHERE {keep}) WHERE diff = best GROUP BY animal, day""",
        "order_days",
        "shipments",
    )


def _nearest(spark, sf, direction):
    found = asof.nearest_observation(
        roles.order_days(spark, sf),
        roles.shipments(spark, sf).select("animal", F.col("day").alias("weighed"), "weight"),
        "animal",
        "day",
        "weighed",
        "weight",
        direction,
    )
    return found.withColumn("weight", F.round("weight", 6))


@query("nearest_both", _nearest_sql("ABS(date_diff('day', p.day, s.day))", "TRUE", "MIN"))
def nearest_both(spark, sf):
    return _nearest(spark, sf, "nearest")


@query("nearest_after", _nearest_sql("date_diff('day', p.day, s.day)", "diff >= 0", "MIN"))
def nearest_after(spark, sf):
    return _nearest(spark, sf, "forward")


@query("nearest_before", _nearest_sql("date_diff('day', p.day, s.day)", "diff <= 0", "MAX"))
def nearest_before(spark, sf):
    return _nearest(spark, sf, "backward")


@query(
    "entity_profile",
    sql(
        """SELECT c.c_custkey AS animal, e.sex, e.birth_date, n.n_name AS birth_place,
             r.r_name AS region, s.grp AS developing_group, e.death_date,
             date_diff('day', e.birth_date, e.death_date) AS death_age
           FROM customer c JOIN entity e ON e.animal = c.c_custkey
           LEFT JOIN nation n ON n.n_nationkey = c.c_nationkey
           LEFT JOIN region r ON r.r_regionkey = n.n_regionkey
           LEFT JOIN (SELECT e.animal, m.grp,
               ROW_NUMBER() OVER (PARTITION BY e.animal ORDER BY m.member_from) AS rn
             FROM entity e JOIN membership m ON m.animal = e.animal
               AND e.first_day + 40 BETWEEN m.member_from AND m.member_to) s
             ON s.animal = c.c_custkey AND s.rn = 1""",
        "entity",
        "membership",
    ),
)
def entity_profile(spark, sf):
    ent = roles.entity(spark, sf)
    places = roles.table(spark, sf, "nation").join(
        roles.table(spark, sf, "region"), F.col("n_regionkey") == F.col("r_regionkey"), "left"
    )
    customers = roles.table(spark, sf, "customer")
    place = customers.join(places, F.col("c_nationkey") == F.col("n_nationkey"), "left").select(
        F.col("c_custkey").alias("animal"),
        F.col("n_name").alias("birth_place"),
        F.col("r_name").alias("region"),
    )
    developing = intervals.group_at_offset(
        ent, roles.membership(spark, sf), "animal", "first_day", 40, "grp", *SPAN, "developing_group"
    )
    ids = customers.select(F.col("c_custkey").alias("animal"))
    out = profile.entity_profile(
        ids,
        [ent.select("animal", "sex", "birth_date", "death_date"), place, developing],
        "animal",
        "birth_date",
        "death_date",
    )
    return out.select(
        "animal", "sex", "birth_date", "birth_place", "region", "developing_group", "death_date", "death_age"
    )


@query(
    "age_at",
    sql(
        """SELECT p.animal, p.day, date_diff('day', e.birth_date, p.day) AS age_days,
             ROUND(date_diff('day', e.birth_date, p.day) / 30.4375, 6) AS age_months
           FROM points p LEFT JOIN entity e ON e.animal = p.animal""",
        "points",
        "entity",
    ),
)
def age_at(spark, sf):
    out = profile.add_age(
        roles.points(spark, sf),
        roles.entity(spark, sf),
        "animal",
        "day",
        "birth_date",
        {"age_days": "days", "age_months": "months"},
    )
    return out.select("animal", "day", "age_days", F.round("age_months", 6).alias("age_months"))


_BREEDING = """SELECT c_custkey AS animal,
    CASE WHEN c_custkey % 7 = 0 THEN NULL WHEN c_custkey % 50 = 1 THEN 1 ELSE 0 END AS founder,
    MIN(CASE WHEN status = 'F' AND day >= DATE '1998-01-01' THEN day END) AS as_mother,
    MIN(CASE WHEN status = 'O' AND day >= DATE '1999-06-01' THEN day END) AS as_father
    FROM customer LEFT JOIN order_days ON animal = c_custkey GROUP BY c_custkey"""

_STATUS = """SELECT p.animal, p.day, CASE WHEN founder = 1 OR as_mother - 105 < p.day
      OR as_father - 105 < p.day THEN 'Breeder' WHEN founder IS NULL THEN NULL ELSE 'Helper' END AS status
    FROM points p JOIN breeding b ON b.animal = p.animal"""


def _breeding(spark, sf):
    a, days = F.col("animal"), roles.order_days(spark, sf)
    firsts = days.groupBy("animal").agg(
        F.min(F.when((F.col("status") == "F") & (F.col("day") >= "1998-01-01"), F.col("day"))).alias(
            "as_mother"
        ),
        F.min(F.when((F.col("status") == "O") & (F.col("day") >= "1999-06-01"), F.col("day"))).alias(
            "as_father"
        ),
    )
    founder = F.when(a % 7 == 0, None).when(a % 50 == 1, 1).otherwise(0)
    ids = roles.table(spark, sf, "customer").select(F.col("c_custkey").alias("animal"))
    return ids.withColumn("founder", founder).join(firsts, "animal", "left")


def _status(spark, sf, points=None):
    return profile.status_at_date(
        roles.points(spark, sf) if points is None else points,
        _breeding(spark, sf),
        "animal",
        "day",
        "founder",
        "as_mother",
        "as_father",
    ).select("animal", "day", "status")


@query("status_at_date", sql(_STATUS, "points", "order_days", breeding=_BREEDING))
def status_at_date(spark, sf):
    return _status(spark, sf)


@query(
    "event_offset",
    sql("SELECT event_id, animal, day, day - 88 AS conception_day FROM litters", "litters"),
)
def event_offset(spark, sf):
    return profile.event_offset(roles.litters(spark, sf), "day", 88)


_NEXT = """SELECT p.animal, p.day, MIN(l.day) AS next_day FROM points p JOIN litters l
    ON l.animal = p.animal AND l.day >= p.day GROUP BY ALL"""


@query(
    "next_event",
    sql(
        """SELECT n.animal, n.day, n.next_day AS next_litter_day, l.event_id,
             date_diff('day', n.next_day, n.day) AS day_diff
           FROM upcoming n JOIN litters l ON l.animal = n.animal AND l.day = n.next_day""",
        "points",
        "litters",
        upcoming=_NEXT,
    ),
)
def next_event(spark, sf):
    events = roles.litters(spark, sf).withColumnRenamed("day", "litter_day")
    return asof.next_event(roles.points(spark, sf), events, "animal", "day", "litter_day")


@query(
    "trimester_status",
    sql(
        """SELECT animal, day, diff AS day_diff, CASE WHEN diff < -105 THEN 'NotPregnant'
             WHEN diff >= -105 AND diff <= -90 THEN 'Conception'
             WHEN diff >= -90 AND diff < -60 THEN 'FirstTrimester'
             WHEN diff >= -60 AND diff < -30 THEN 'SecondTrimester'
             WHEN diff >= -30 AND diff <= 0 THEN 'ThirdTrimester' END AS gestation
           FROM (SELECT p.animal, p.day, date_diff('day', n.next_day, p.day) AS diff FROM points p
                 LEFT JOIN upcoming n ON n.animal = p.animal AND n.day = p.day)""",
        "points",
        "litters",
        upcoming=_NEXT,
    ),
)
def trimester_status(spark, sf):
    line = asof.next_event_day(
        roles.points(spark, sf),
        roles.litters(spark, sf).withColumnRenamed("day", "litter_day"),
        "animal",
        "day",
        "litter_day",
        "next_day",
    )
    diff = day_diff(F.col("day"), F.col("next_day"))
    return line.select(
        "animal", "day", diff.alias("day_diff"), labels.trimester_status(diff).alias("gestation")
    )


@query(
    "semester_status",
    sql(
        """SELECT animal, day, diff AS day_diff, CASE WHEN diff < -90 THEN 'NotPregnant'
             WHEN diff >= -90 AND diff < -45 THEN 'FirstSemester'
             WHEN diff >= -45 AND diff <= 0 THEN 'SecondSemester'
             WHEN diff IS NULL AND last_litter IS NOT NULL
               AND day >= CASE WHEN tenure_end - 90 >= last_litter THEN tenure_end - 90 ELSE last_litter END
             THEN 'Undetermined' END AS gestation
           FROM (SELECT p.animal, p.day, date_diff('day', n.next_day, p.day) AS diff, l.last_litter,
                   COALESCE(CASE WHEN e.sex = 'F' THEN e.death_date END, DATE '2001-12-31') AS tenure_end
                 FROM points p LEFT JOIN upcoming n ON n.animal = p.animal AND n.day = p.day
                 LEFT JOIN (SELECT animal, MAX(day) AS last_litter FROM litters GROUP BY animal) l
                   ON l.animal = p.animal
                 LEFT JOIN entity e ON e.animal = p.animal)""",
        "points",
        "litters",
        "entity",
        upcoming=_NEXT,
    ),
)
def semester_status(spark, sf):
    births = roles.litters(spark, sf).withColumnRenamed("day", "litter_day")
    line = asof.next_event_day(
        roles.points(spark, sf), births, "animal", "day", "litter_day", "next_day"
    )
    last = births.groupBy("animal").agg(F.max("litter_day").alias("last_litter"))
    died = roles.entity(spark, sf).select(
        "animal",
        F.coalesce(
            F.when(F.col("sex") == "F", F.col("death_date")), F.lit(roles.LAST_DAY).cast("date")
        ).alias("tenure_end"),
    )
    rows = natural_join(natural_join(line, last, "left", "animal"), died, "left", "animal")
    diff = day_diff(F.col("day"), F.col("next_day"))
    stage = labels.semester_status(diff, F.col("day"), F.col("tenure_end"), F.col("last_litter"))
    return rows.select("animal", "day", diff.alias("day_diff"), stage.alias("gestation"))


@query(
    "lactation_status",
    sql(
        """SELECT s.animal, s.day, COALESCE(y.young, 0) AS young,
             CASE WHEN e.sex = 'F' AND s.status = 'Breeder' AND COALESCE(y.young, 0) > 0 THEN 'Lactating'
                  WHEN e.sex = 'F' AND s.status = 'Breeder' AND COALESCE(y.young, 0) = 0
                    THEN 'NotLactating' ELSE '' END AS lactating
           FROM states s JOIN entity e ON e.animal = s.animal
           LEFT JOIN (SELECT p.animal, p.day, COUNT(*) AS young FROM points p JOIN litters l
               ON l.animal = p.animal AND p.day BETWEEN l.day AND l.day + 14 GROUP BY ALL) y
             ON y.animal = s.animal AND y.day = s.day""",
        "points",
        "litters",
        "entity",
        breeding=_BREEDING,
        states=_STATUS,
    ),
)
def lactation_status(spark, sf):
    # used three times: written once, so that shipments are joined once
    points = staged(roles.points(spark, sf))
    states = _status(spark, sf, points)
    young = profile.young_count(
        points,
        roles.litters(spark, sf).withColumnRenamed("day", "born"),
        ["animal"],
        "day",
        "born",
    )
    # both joins by individual first: they share one shuffle
    states = natural_join(states, roles.entity(spark, sf).select("animal", "sex"), "inner", "animal")
    rows = lookup(states, young, ["animal", "day"], "inner")
    label = labels.lactation_status(F.col("sex"), F.col("status"), F.col("young"))
    return rows.select("animal", "day", "young", label.alias("lactating"))


_HERD = """SELECT animal, nation AS grp, sex,
    CASE WHEN animal % 3 = 0 THEN DATE '2000-01-01' ELSE DATE '2000-02-01' END AS day,
    date_diff('day', first_day, DATE '1995-06-01') AS age,
    CASE WHEN animal % 401 <> 0 THEN CAST(c_acctbal AS DECIMAL(12,2)) END AS weight
    FROM entity JOIN customer ON c_custkey = animal"""


def _herd(spark, sf):
    balances = roles.table(spark, sf, "customer").select(
        F.col("c_custkey").alias("animal"), F.col("c_acctbal").cast("decimal(12,2)").alias("_w")
    )
    rows = roles.entity(spark, sf).join(balances, "animal")
    a = F.col("animal")
    return rows.select(
        "animal",
        F.col("nation").alias("grp"),
        "sex",
        F.when(a % 3 == 0, F.lit("2000-01-01")).otherwise("2000-02-01").cast("date").alias("day"),
        day_diff(F.lit("1995-06-01").cast("date"), F.col("first_day")).alias("age"),
        F.when(a % 401 != 0, F.col("_w")).alias("weight"),
    )


def _near(t: int, keys: str, out: str) -> str:
    same = " AND ".join(f"o.{k} = h.{k}" for k in keys.split(", "))
    return f"""(SELECT CASE WHEN COUNT(*) = COUNT(o.weight)
        THEN SUM(CASE WHEN ABS(o.weight - h.weight) < {t} THEN 1 ELSE 0 END) - 1 END
        FROM herd o WHERE {same}) AS {out}"""


_COMP = ",\n".join(
    [_near(t, "grp, day", f"comp_{t}") for t in (50, 100, 150, 200)]
    + [_near(t, "grp, day, sex", f"comp_{t}_queue") for t in (50, 100, 150, 200)]
)


@query(
    "group_profile",
    sql(
        f"""SELECT animal, grp, day, sex, age, weight, group_size, pup_count, young_count, pup_presence, min_age,
              queue_size, weight_rank, weight_rank_queue, age_rank,
              {", ".join(f"CAST(CASE WHEN weight IS NOT NULL THEN comp_{t}{q} END AS BIGINT) AS comp_{t}{q}"
                         for q in ("", "_queue") for t in (50, 100, 150, 200))}
            FROM (SELECT h.animal, h.grp, h.day, h.sex, h.age, h.weight,
              COUNT(*) OVER g AS group_size,
              CAST(SUM(CASE WHEN age < 1 THEN 1 ELSE 0 END) OVER g AS BIGINT) AS pup_count,
              CAST(SUM(CASE WHEN age BETWEEN 0 AND 14 THEN 1 ELSE 0 END) OVER g AS BIGINT) AS young_count,
              CASE WHEN SUM(CASE WHEN age < 1 THEN 1 ELSE 0 END) OVER g = 0 THEN 'No' ELSE 'Yes' END
                AS pup_presence,
              MIN(age) OVER g AS min_age, COUNT(*) OVER q AS queue_size,
              CASE WHEN weight IS NOT NULL THEN RANK() OVER (PARTITION BY grp, day
                ORDER BY weight DESC NULLS LAST) END AS weight_rank,
              CASE WHEN weight IS NOT NULL THEN RANK() OVER (PARTITION BY grp, day, sex
                ORDER BY weight DESC NULLS LAST) END AS weight_rank_queue,
              CASE WHEN age IS NOT NULL THEN RANK() OVER (PARTITION BY grp, day
                ORDER BY age DESC NULLS LAST) END AS age_rank,
              {_COMP}
            FROM herd h
            WINDOW g AS (PARTITION BY grp, day), q AS (PARTITION BY grp, day, sex))""",
        "entity",
        herd=_HERD,
    ),
    exact=("weight",),
)
def group_profile(spark, sf):
    return profile.group_profile(
        _herd(spark, sf),
        "grp",
        "day",
        "sex",
        "age",
        "weight",
        thresholds=(50, 100, 150, 200),
        weight_width=200,
        age_width=365,
    )


@query(
    "neighbour_count",
    sql(
        """SELECT h.animal, h.grp, h.weight,
             COUNT(o.animal) FILTER (ABS(o.weight - h.weight) < 50) AS n_50,
             COUNT(o.animal) FILTER (ABS(o.weight - h.weight) < 100) AS n_100,
             COUNT(o.animal) FILTER (ABS(o.weight - h.weight) < 150) AS n_150,
             COUNT(o.animal) FILTER (ABS(o.weight - h.weight) < 200) AS n_200
           FROM herd h LEFT JOIN herd o ON o.grp = h.grp AND o.animal <> h.animal
           GROUP BY h.animal, h.grp, h.weight""",
        herd="""SELECT c_custkey AS animal, c_nationkey AS grp,
                  CAST(c_acctbal AS DECIMAL(12,2)) AS weight FROM customer""",
    ),
    exact=("weight",),
)
def neighbour_count(spark, sf):
    rows = roles.table(spark, sf, "customer").select(
        F.col("c_custkey").alias("animal"),
        F.col("c_nationkey").alias("grp"),
        F.col("c_acctbal").cast("decimal(12,2)").alias("weight"),
    )
    return profile.neighbour_count(
        rows, ["grp"], "weight", {f"n_{t}": t for t in (50, 100, 150, 200)}, width=200
    )


@query(
    "young_per_group",
    sql(
        """SELECT grp, day, COUNT(*) AS group_size,
             COUNT(*) FILTER (age BETWEEN 0 AND 14) AS young,
             MIN(age) FILTER (age BETWEEN 0 AND 14) AS youngest,
             MAX(age) FILTER (age BETWEEN 0 AND 14) AS oldest_young
           FROM herd GROUP BY grp, day""",
        "entity",
        herd=_HERD,
    ),
)
def young_per_group(spark, sf):
    return profile.young_per_group(_herd(spark, sf), ["grp", "day"], "age")
