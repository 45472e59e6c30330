"""The shared tables in the roles the operators expect, in Spark and as SQL building blocks.

Customers act as individuals, orders as life events and group moves, shipments as samples and
weights, the event log as behaviour observations.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cohortspark.operators.focal import PASS_DIRECTIONS, PASS_LOCATIONS, POINTS, STATES
from cohortspark.operators.relational import keep_first
from cohortspark.operators.scan import INSTANT

PRIORITIES = ("1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW")
SEGMENTS = ("AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY")
EVENT_TYPES = ("click", "error", "purchase", "signup", "view")
REGIONS = ("AFRICA", "AMERICA", "ASIA", "EUROPE", "MIDDLE EAST")
LAST_DAY = "2001-12-31"


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def day_of(col: str) -> Column:
    return F.to_date(col)


# ---------------------------------------------------------------------------- SQL building blocks


def _items(values) -> str:
    return "[" + ", ".join("'" + v + "'" for v in values) + "]"


CTE: dict[str, tuple[tuple[str, ...], str]] = {
    "order_days": (
        (),
        """SELECT o_orderkey AS event_id, o_custkey AS animal, CAST(o_orderdate AS DATE) AS day,
             o_orderpriority AS grp, o_orderstatus AS status FROM orders""",
    ),
    "membership": (
        ("order_days",),
        """SELECT animal, grp, day AS member_from,
             COALESCE(LEAD(day) OVER (PARTITION BY animal ORDER BY day), DATE '2001-12-31') AS member_to
           FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY animal, day ORDER BY event_id) AS rn
                 FROM order_days) WHERE rn = 1""",
    ),
    "shipments": (
        (),
        """SELECT o_custkey AS animal, CAST(l_shipdate AS DATE) AS day, l_orderkey AS order_id,
             l_linenumber AS line, l_quantity AS weight, l_returnflag AS flag, l_suppkey AS supplier
           FROM lineitem JOIN orders ON l_orderkey = o_orderkey""",
    ),
    "points": (("shipments",), "SELECT DISTINCT animal, day FROM shipments"),
    "entity": (
        ("order_days",),
        """SELECT c_custkey AS animal, CASE WHEN c_custkey % 2 = 0 THEN 'F' ELSE 'M' END AS sex,
             c_nationkey AS nation, c_mktsegment AS segment, first_day,
             CASE WHEN c_mktsegment <> 'BUILDING'
                  THEN last_day - CAST(300 + c_custkey * 7 % 1500 AS INTEGER) END AS birth_date,
             CASE WHEN c_mktsegment <> 'MACHINERY'
                  THEN last_day - CAST(c_custkey % 900 AS INTEGER) END AS start_date,
             last_day AS death_date,
             CASE c_mktsegment WHEN 'AUTOMOBILE' THEN 'Solitary' WHEN 'BUILDING' THEN 'Queen'
               WHEN 'FURNITURE' THEN 'King' WHEN 'HOUSEHOLD' THEN 'Breeder' ELSE 'Helper' END AS status
           FROM customer LEFT JOIN
             (SELECT animal, MIN(day) AS first_day, MAX(day) AS last_day FROM order_days GROUP BY animal)
             ON c_custkey = animal""",
    ),
    "obs": (
        (),
        """SELECT event_id, user_id AS animal, CAST(ts AS DATE) AS day, ts, event_type AS behaviour,
             CAST(value AS DECIMAL(12,2)) AS duration,
             CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events""",
    ),
    "obs_membership": (
        (),
        """SELECT animal, (animal + i) % 5 AS grp,
             DATE '2024-01-01' + CAST(10 * i AS INTEGER) AS member_from,
             DATE '2024-01-01' + CAST(10 * i + 10 AS INTEGER) AS member_to
           FROM (SELECT DISTINCT user_id AS animal FROM events), (VALUES (0), (1), (2)) AS t(i)""",
    ),
    "sessions": (
        ("obs",),
        """SELECT CASE WHEN animal % 2 = 0 THEN 'new' ELSE 'old' END AS source,
             animal * 1000 + EXTRACT(DAY FROM day) * 10
               + CASE WHEN EXTRACT(HOUR FROM ts) >= 12 THEN 1 ELSE 0 END AS focal_ref,
             animal, day, event_id, behaviour, duration, k FROM obs""",
    ),
    "scan_inst": (
        ("obs",),
        f"""SELECT (animal % 5) * 100 + EXTRACT(DAY FROM day) AS obs_ref, animal, day,
             list_extract({_items(INSTANT)}, CAST(k % 17 + 1 AS INTEGER)) AS behaviour,
             1 + event_id % 3 AS n FROM obs""",
    ),
    "scan_cont": (
        ("obs",),
        """SELECT (animal % 5) * 100 + EXTRACT(DAY FROM day) AS obs_ref, animal,
             CASE WHEN k % 10 <> 0 THEN k END AS partner, behaviour, 1 + event_id % 2 AS n FROM obs""",
    ),
    "focal_events": (
        ("sessions",),
        f"""SELECT focal_ref, event_id, event_id // 2 AS focal_event,
             list_extract({_items(STATES)}, CAST(k % 18 + 1 AS INTEGER)) AS state,
             list_extract({_items(POINTS)}, CAST(k % 17 + 1 AS INTEGER)) AS point,
             CASE WHEN event_id % 5 = 0 THEN NULL WHEN event_id % 2 = 0 THEN 'Received'
                  ELSE 'Initiated' END AS received,
             CASE WHEN event_id % 11 <> 0 THEN duration END AS duration, 1 + event_id % 3 AS n,
             CASE WHEN event_id % 7 = 0 THEN NULL WHEN event_id % 3 = 0 THEN 'Front' ELSE 'Back' END
               AS side,
             list_extract({_items(PASS_DIRECTIONS)}, CAST(event_id % 4 + 1 AS INTEGER)) AS way,
             list_extract({_items(PASS_LOCATIONS)}, CAST(event_id % 3 + 1 AS INTEGER)) AS location
           FROM sessions""",
    ),
    "focal_sessions": (
        ("sessions",),
        """SELECT focal_ref, MIN(animal) AS animal,
             SUM(duration) * 20 - COALESCE(SUM(CASE WHEN behaviour = 'error' THEN duration END), 0) AS seen
           FROM sessions GROUP BY focal_ref""",
    ),
    "dyads": (
        ("obs",),
        """SELECT event_id, animal, k AS partner, day, strftime(ts, '%H:%M:%S') AS event_time,
             (animal + (EXTRACT(DAY FROM day) - 1) // 10) % 5 AS grp, behaviour, k % 2 AS received,
             CASE WHEN event_id % 2 = 0 THEN 'NoseToNose' ELSE 'NoseToTail' END AS way,
             CASE event_id % 3 WHEN 0 THEN 'Over' WHEN 1 THEN 'Under' ELSE 'Sidewards' END AS location,
             CASE event_id % 7 WHEN 0 THEN NULL WHEN 1 THEN 'OTHER' ELSE 'MAIN' END AS study
           FROM obs""",
    ),
    "valid": (
        ("dyads", "obs_membership"),
        """SELECT DISTINCT d.* FROM dyads d JOIN obs_membership m ON m.animal = d.partner
             AND d.day BETWEEN m.member_from AND m.member_to WHERE study <> 'OTHER' AND m.grp = d.grp""",
    ),
    "grid": (
        ("entity",),
        """SELECT e.*, months, period,
             CAST(death_date - to_months(months) AS DATE) AS period_day,
             date_diff('day', birth_date, CAST(death_date - to_months(months) AS DATE)) / 30.4375
               AS period_age
           FROM (SELECT animal, birth_date, start_date, death_date,
                   date_diff('day', start_date, death_date) / 30.4375 AS duration,
                   CAST(birth_date + to_months(12) AS DATE) AS first_birthday
                 FROM (SELECT animal, birth_date, death_date,
                         COALESCE(start_date, death_date - 500) AS start_date FROM entity)) e,
             (VALUES (3, 'Three_M'), (6, 'Six_M'), (9, 'Nine_M'), (12, 'Twelve_M'), (15, 'Fifteen_M'),
                     (18, 'Eighteen_M'), (21, 'TwentyOne_M'), (24, 'TwentyFour_M')) AS p(months, period)""",
    ),
    "starts": (
        ("grid",),
        """SELECT animal, birth_date, start_date, death_date, duration, first_birthday, months, period,
             next_period, CASE WHEN period_day < start_date THEN start_date ELSE period_day END AS period_day,
             CASE WHEN duration < 6 AND period = 'Six_M' THEN 'Last' ELSE 'First' END AS period_type
           FROM (SELECT *, LEAD(period) OVER (PARTITION BY animal ORDER BY period_day DESC, months)
                   AS next_period
                 FROM grid WHERE period IN ('Six_M', 'Twelve_M', 'Eighteen_M', 'TwentyFour_M'))
           WHERE (period_age > 12 OR birth_date IS NULL) AND period_day > start_date
              OR duration < 6 AND period = 'Six_M'""",
    ),
    "last_stretch": (
        ("grid", "starts"),
        """SELECT g.animal, g.months, g.period, 'Last' AS period_type,
             CASE WHEN g.first_birthday > g.start_date THEN g.first_birthday ELSE g.start_date END
               AS period_day
           FROM (SELECT *, RANK() OVER (PARTITION BY animal ORDER BY period_day) AS rk FROM starts) s
           JOIN grid g ON g.animal = s.animal AND g.period = s.next_period
           WHERE s.rk = 1 AND g.duration > 6""",
    ),
    "periods": (
        ("entity", "starts", "last_stretch"),
        """SELECT * FROM (
             SELECT animal, period, period_day, period_type,
               LEAD(period) OVER w AS end_period, LEAD(period_day) OVER w AS end_period_day,
               LEAD(period_type) OVER w AS end_period_type
             FROM (SELECT animal, months, period, period_day, period_type FROM starts
                   UNION ALL SELECT animal, months, period, period_day, period_type FROM last_stretch
                   UNION ALL SELECT animal, 0, 'Death', death_date, NULL FROM entity)
             WINDOW w AS (PARTITION BY animal ORDER BY period_day DESC NULLS LAST, months, period))
           WHERE end_period IS NOT NULL""",
    ),
    "samples": (
        ("order_days", "shipments"),
        """SELECT *, ROW_NUMBER() OVER (PARTITION BY animal, day, sample_type ORDER BY sample_id)
             AS repeat_no
           FROM (SELECT animal, day, event_id AS sample_id, 'Urine' AS sample_type FROM order_days
                 WHERE NOT COALESCE(NULLIF(status, 'O') = 'P', FALSE)
                 UNION ALL
                 SELECT animal, day, order_id * 10 + line, 'Plasma' FROM shipments
                 WHERE NOT COALESCE(flag = 'N', FALSE))""",
    ),
    "litters": (
        ("order_days",),
        "SELECT event_id, animal, day FROM order_days WHERE status = 'F'",
    ),
    "pairings": (
        ("order_days",),
        """SELECT event_id AS pairing_id, animal, day AS pairing_day, status AS colony
           FROM order_days WHERE grp IN ('1-URGENT', '2-HIGH')""",
    ),
    "gestating": (
        ("samples", "litters"),
        """SELECT s.*, CASE WHEN diff < -105 THEN 'NotPregnant' WHEN diff <= -90 THEN 'Conception'
             WHEN diff < -60 THEN 'FirstTrimester' WHEN diff < -30 THEN 'SecondTrimester'
             WHEN diff <= 0 THEN 'ThirdTrimester' END AS gestation
           FROM samples s LEFT JOIN
             (SELECT p.animal, p.day, MAX(date_diff('day', l.day, p.day)) AS diff
              FROM (SELECT DISTINCT animal, day FROM samples) p JOIN litters l
                ON l.animal = p.animal AND l.day >= p.day GROUP BY ALL) g
             ON g.animal = s.animal AND g.day = s.day""",
    ),
    "selected": (
        ("periods", "gestating", "entity"),
        """SELECT DISTINCT p.animal, p.period_day, p.end_period, p.end_period_day, p.end_period_type,
             s.day, s.sample_id, s.sample_type, s.repeat_no, s.gestation, e.sex,
             CASE WHEN e.sex = 'F' AND e.status = 'Breeder' THEN
                CASE WHEN s.gestation IN ('FirstTrimester', 'SecondTrimester', 'ThirdTrimester')
                     THEN 'PregnantBreeder' ELSE 'NonPregnantBreeder' END
                ELSE e.status END AS status
           FROM periods p JOIN gestating s ON s.animal = p.animal
             AND s.day <= p.period_day AND s.day >= p.end_period_day
           JOIN entity e ON e.animal = p.animal""",
    ),
    "expected": (
        ("entity", "periods"),
        """SELECT x.animal, x.sex, x.status, l.end_period, l.end_period_day, l.end_period_type
           FROM (SELECT animal, sex, UNNEST(CASE WHEN sex = 'F' AND status = 'Breeder'
                   THEN ['PregnantBreeder', 'NonPregnantBreeder'] ELSE [status] END) AS status
                 FROM entity) x
           LEFT JOIN (SELECT DISTINCT animal, end_period, end_period_day, end_period_type FROM periods) l
             ON l.animal = x.animal""",
    ),
}


def sql(body: str, *names: str, **extra: str) -> str:
    """``body`` with the named building blocks, and everything they need, as WITH clauses."""
    ordered: dict[str, str] = {}

    def add(name: str) -> None:
        if name in ordered:
            return
        needs, text = CTE[name]
        for n in needs:
            add(n)
        ordered[name] = text

    for n in names:
        add(n)
    ordered.update(extra)
    if not ordered:
        return body
    clauses = ",\n".join(f"{n} AS ({t})" for n, t in ordered.items())
    return f"WITH {clauses}\n{body}"


# ------------------------------------------------------------------------------------ Spark roles


def order_days(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "orders").select(
        F.col("o_orderkey").alias("event_id"),
        F.col("o_custkey").alias("animal"),
        day_of("o_orderdate").alias("day"),
        F.col("o_orderpriority").alias("grp"),
        F.col("o_orderstatus").alias("status"),
    )


def membership(spark: SparkSession, sf: str) -> DataFrame:
    """Group intervals: each order day starts one, the next order day (inclusive) ends it."""
    moves = keep_first(
        order_days(spark, sf).select("animal", "day", "event_id", "grp"), ["animal", "day"], "event_id"
    )
    # at most one row per individual and calendar day
    w = Window.partitionBy("animal").orderBy("day")
    until = F.coalesce(F.lead("day").over(w), F.lit(LAST_DAY).cast("date"))
    return moves.select("animal", "grp", F.col("day").alias("member_from"), until.alias("member_to"))


def shipments(spark: SparkSession, sf: str) -> DataFrame:
    lines = table(spark, sf, "lineitem").select(
        F.col("l_orderkey").alias("order_id"),
        F.col("l_linenumber").alias("line"),
        F.col("l_quantity").alias("weight"),
        F.col("l_returnflag").alias("flag"),
        F.col("l_suppkey").alias("supplier"),
        day_of("l_shipdate").alias("day"),
    )
    owners = table(spark, sf, "orders").select(
        F.col("o_orderkey").alias("order_id"), F.col("o_custkey").alias("animal")
    )
    return lines.join(owners, "order_id")


def points(spark: SparkSession, sf: str) -> DataFrame:
    return shipments(spark, sf).select("animal", "day").distinct()


def entity(spark: SparkSession, sf: str) -> DataFrame:
    seen = order_days(spark, sf).groupBy("animal").agg(
        F.min("day").alias("first_day"), F.max("day").alias("death_date")
    )
    segment = F.col("segment")
    status = F.create_map(
        *[
            F.lit(x)
            for kv in zip(SEGMENTS, ("Solitary", "Queen", "King", "Breeder", "Helper"), strict=True)
            for x in kv
        ]
    )
    customers = table(spark, sf, "customer").select(
        F.col("c_custkey").alias("animal"),
        F.when(F.col("c_custkey") % 2 == 0, "F").otherwise("M").alias("sex"),
        F.col("c_nationkey").alias("nation"),
        F.col("c_mktsegment").alias("segment"),
    )
    days_back = (300 + F.col("animal") * 7 % 1500).cast("int")
    return customers.join(seen, "animal", "left").withColumns(
        {
            "birth_date": F.when(segment != "BUILDING", F.date_sub("death_date", days_back)),
            "start_date": F.when(
                segment != "MACHINERY", F.date_sub("death_date", (F.col("animal") % 900).cast("int"))
            ),
            "status": F.try_element_at(status, segment),
        }
    )


def obs(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "events").select(
        "event_id",
        F.col("user_id").alias("animal"),
        day_of("ts").alias("day"),
        "ts",
        F.col("event_type").alias("behaviour"),
        F.col("value").cast("decimal(12,2)").alias("duration"),
        F.get_json_object("props", "$.k").cast("bigint").alias("k"),
    )


def obs_membership(spark: SparkSession, sf: str) -> DataFrame:
    first = F.lit("2024-01-01").cast("date")
    return (
        table(spark, sf, "events")
        .select(F.col("user_id").alias("animal"))
        .distinct()
        .withColumn("i", F.explode(F.array(F.lit(0), F.lit(1), F.lit(2))))
        .select(
            "animal",
            ((F.col("animal") + F.col("i")) % 5).alias("grp"),
            F.date_add(first, F.col("i") * 10).alias("member_from"),
            F.date_add(first, F.col("i") * 10 + 10).alias("member_to"),
        )
    )


def _pick(values, index: Column) -> Column:
    return F.element_at(F.array(*[F.lit(v) for v in values]), (index + 1).cast("int"))


def sessions(spark: SparkSession, sf: str) -> DataFrame:
    half = F.when(F.hour("ts") >= 12, 1).otherwise(0)
    return obs(spark, sf).select(
        F.when(F.col("animal") % 2 == 0, "new").otherwise("old").alias("source"),
        (F.col("animal") * 1000 + F.dayofmonth("day") * 10 + half).alias("focal_ref"),
        "animal",
        "day",
        "event_id",
        "behaviour",
        "duration",
        "k",
    )


def scan_inst(spark: SparkSession, sf: str) -> DataFrame:
    return obs(spark, sf).select(
        ((F.col("animal") % 5) * 100 + F.dayofmonth("day")).alias("obs_ref"),
        "animal",
        "day",
        _pick(INSTANT, F.col("k") % 17).alias("behaviour"),
        (1 + F.col("event_id") % 3).alias("n"),
    )


def scan_cont(spark: SparkSession, sf: str) -> DataFrame:
    return obs(spark, sf).select(
        ((F.col("animal") % 5) * 100 + F.dayofmonth("day")).alias("obs_ref"),
        "animal",
        F.when(F.col("k") % 10 != 0, F.col("k")).alias("partner"),
        "behaviour",
        (1 + F.col("event_id") % 2).alias("n"),
    )


def focal_events(spark: SparkSession, sf: str) -> DataFrame:
    e = F.col("event_id")
    return sessions(spark, sf).select(
        "focal_ref",
        "event_id",
        F.floor(e / 2).alias("focal_event"),
        _pick(STATES, F.col("k") % 18).alias("state"),
        _pick(POINTS, F.col("k") % 17).alias("point"),
        F.when(e % 5 == 0, None).when(e % 2 == 0, "Received").otherwise("Initiated").alias("received"),
        F.when(e % 11 != 0, F.col("duration")).alias("duration"),
        (1 + e % 3).alias("n"),
        F.when(e % 7 == 0, None).when(e % 3 == 0, "Front").otherwise("Back").alias("side"),
        _pick(PASS_DIRECTIONS, e % 4).alias("way"),
        _pick(PASS_LOCATIONS, e % 3).alias("location"),
    )


def focal_sessions(spark: SparkSession, sf: str) -> DataFrame:
    out_of_sight = F.sum(F.when(F.col("behaviour") == "error", F.col("duration")))
    return (
        sessions(spark, sf)
        .groupBy("focal_ref")
        .agg(
            F.min("animal").alias("animal"),
            (F.sum("duration") * 20 - F.coalesce(out_of_sight, F.lit(0))).alias("seen"),
        )
    )


def dyads(spark: SparkSession, sf: str) -> DataFrame:
    e = F.col("event_id")
    return obs(spark, sf).select(
        "event_id",
        "animal",
        F.col("k").alias("partner"),
        "day",
        F.date_format("ts", "HH:mm:ss").alias("event_time"),
        ((F.col("animal") + F.floor((F.dayofmonth("day") - 1) / 10)) % 5).alias("grp"),
        "behaviour",
        (F.col("k") % 2).alias("received"),
        F.when(e % 2 == 0, "NoseToNose").otherwise("NoseToTail").alias("way"),
        F.when(e % 3 == 0, "Over").when(e % 3 == 1, "Under").otherwise("Sidewards").alias("location"),
        F.when(e % 7 == 0, None).when(e % 7 == 1, "OTHER").otherwise("MAIN").alias("study"),
    )


def litters(spark: SparkSession, sf: str) -> DataFrame:
    return order_days(spark, sf).filter(F.col("status") == "F").select("event_id", "animal", "day")


def pairings(spark: SparkSession, sf: str) -> DataFrame:
    return (
        order_days(spark, sf)
        .filter(F.col("grp").isin("1-URGENT", "2-HIGH"))
        .select(
            F.col("event_id").alias("pairing_id"),
            "animal",
            F.col("day").alias("pairing_day"),
            F.col("status").alias("colony"),
        )
    )
