"""Look-back periods and sample selection."""

from __future__ import annotations

from pyspark.sql import functions as F

from cohortspark.operators import periods
from cohortspark.plans import roles
from cohortspark.plans.registry import query
from cohortspark.plans.roles import sql
from cohortspark.session import staged
from cohortspark.sources.readers import observation_dates as dates_of

LIST = ["end_period", "end_period_day", "end_period_type"]


def _grid(spark, sf):
    return periods.lookback_grid(
        roles.entity(spark, sf), "animal", "birth_date", "start_date", "death_date"
    )


DATES = ("animal", "birth_date", "start_date", "death_date")


def _periods(spark, sf):
    return periods.available_periods(roles.entity(spark, sf), *DATES)


def _sources(spark, sf):
    status = F.when(F.col("status") != "O", F.col("status"))
    urine = roles.order_days(spark, sf).select(
        "animal", "day", F.col("event_id").alias("sample_id"), status.alias("label")
    )
    plasma = roles.shipments(spark, sf).select(
        "animal",
        "day",
        (F.col("order_id") * 10 + F.col("line")).alias("sample_id"),
        F.col("flag").alias("label"),
    )
    return {"Urine": urine, "Plasma": plasma}


NO_LABELS = {"label": ("P", "N")}


def _selected(spark, sf, kinds=("Urine", "Plasma"), first_only=False):
    sources = {k: v for k, v in _sources(spark, sf).items() if k in kinds}
    stacked = staged(periods.stack_samples(sources, "animal", "day", "sample_id", NO_LABELS))
    rows = periods.number_repeats(stacked, "animal", "day", "sample_id")
    if first_only:
        rows = rows.filter(F.col("repeat_no") == 1)
    births = roles.litters(spark, sf).withColumnRenamed("day", "litter_day")
    with_stage = periods.with_gestation(rows, births, "animal", "day", "litter_day", days=stacked)
    return periods.samples_in_period(
        _periods(spark, sf),
        with_stage,
        roles.entity(spark, sf),
        "animal",
        "day",
        "sex",
        "status",
        "gestation",
    )


def _expected(spark, sf):
    return periods.status_expansion(
        roles.entity(spark, sf),
        periods.period_list(_periods(spark, sf), "animal"),
        "animal",
        "sex",
        "status",
    )


@query(
    "lookback_grid",
    sql(
        """SELECT animal, birth_date, start_date, death_date, ROUND(duration, 6) AS duration,
             first_birthday, months, period, period_day, ROUND(period_age, 6) AS period_age FROM grid""",
        "grid",
    ),
)
def lookback_grid(spark, sf):
    return _grid(spark, sf).withColumns(
        {"duration": F.round("duration", 6), "period_age": F.round("period_age", 6)}
    )


@query(
    "period_starts",
    sql("SELECT animal, months, period, next_period, period_day, period_type FROM starts", "starts"),
)
def period_starts(spark, sf):
    return periods.period_starts(roles.entity(spark, sf), *DATES)


@query(
    "last_period",
    sql("SELECT animal, months, period, period_day, period_type FROM last_stretch", "last_stretch"),
)
def last_period(spark, sf):
    return periods.last_period(roles.entity(spark, sf), *DATES)


@query("available_periods", sql("SELECT * FROM periods", "periods"))
def available_periods(spark, sf):
    return _periods(spark, sf)


@query("status_expansion", sql("SELECT * FROM expected", "expected"))
def status_expansion(spark, sf):
    return _expected(spark, sf)


@query("sample_union", sql("SELECT * FROM samples", "samples"))
def sample_union(spark, sf):
    return periods.sample_union(_sources(spark, sf), "animal", "day", "sample_id", NO_LABELS)


@query("select_in_period", sql("SELECT * FROM selected", "selected"))
def select_in_period(spark, sf):
    return _selected(spark, sf)


def _count_sql(what: str, where: str) -> str:
    return sql(
        f"""SELECT x.*, COALESCE(c.n, 0) AS n FROM expected x LEFT JOIN (
              SELECT animal, sex, status, end_period, end_period_day, end_period_type,
                COUNT(DISTINCT {what}) AS n FROM selected WHERE {where} GROUP BY ALL) c
            ON c.animal = x.animal AND c.sex = x.sex AND c.status = x.status
              AND c.end_period IS NOT DISTINCT FROM x.end_period
              AND c.end_period_day IS NOT DISTINCT FROM x.end_period_day
              AND c.end_period_type IS NOT DISTINCT FROM x.end_period_type""",
        "expected",
        "selected",
    )


@query("count_in_period", _count_sql("sample_id", "sample_type = 'Urine' AND repeat_no = 1"))
def count_in_period(spark, sf):
    chosen = _selected(spark, sf, ["Urine"], first_only=True)
    return periods.count_in_period(
        _expected(spark, sf), chosen, ["animal", "sex", "status", *LIST], "sample_id"
    )


@query("count_days_in_period", _count_sql("day", "sample_type = 'Plasma'"))
def count_days_in_period(spark, sf):
    return periods.count_in_period(
        _expected(spark, sf),
        _selected(spark, sf, ["Plasma"]),
        ["animal", "sex", "status", *LIST],
        "day",
    )


@query(
    "export_status",
    sql(
        """SELECT s.animal, s.day, s.sample_id, x.export_day, x.lab,
             CASE WHEN x.export_day IS NOT NULL THEN 'Yes' ELSE 'No' END AS exported
           FROM (SELECT DISTINCT animal, day, sample_id FROM selected WHERE sample_type = 'Plasma') s
           LEFT JOIN (SELECT DISTINCT order_id * 10 + line AS sample_number, day + 30 AS export_day,
               'lab' || (supplier % 3) AS lab FROM shipments WHERE flag = 'R') x
             ON x.sample_number = s.sample_id""",
        "selected",
    ),
)
def export_status(spark, sf):
    chosen = _selected(spark, sf, ["Plasma"]).select("animal", "day", "sample_id").distinct()
    sent = (
        roles.shipments(spark, sf)
        .filter(F.col("flag") == "R")
        .select(
            (F.col("order_id") * 10 + F.col("line")).alias("sample_number"),
            F.date_add("day", 30).alias("export_day"),
            F.concat(F.lit("lab"), (F.col("supplier") % 3).cast("string")).alias("lab"),
        )
        .distinct()
    )
    return periods.export_status(chosen, sent, "sample_id", "sample_number", "export_day")


@query(
    "observation_dates",
    sql(
        """SELECT DISTINCT CAST(o_custkey AS VARCHAR) AS animal, CAST(o_orderdate AS DATE) AS day
           FROM orders WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem)
           UNION ALL SELECT DISTINCT CAST(user_id AS VARCHAR), CAST(ts AS DATE) FROM events"""
    ),
)
def observation_dates(spark, sf):
    orders, lines = (roles.table(spark, sf, t) for t in ("orders", "lineitem"))
    log = roles.table(spark, sf, "events")
    old_events = lines.select("l_orderkey").join(
        orders.select("o_orderkey", "o_custkey"), F.col("l_orderkey") == F.col("o_orderkey")
    ).drop("o_orderkey")
    return dates_of(
        [
            (
                old_events,
                orders.select("o_orderkey", "o_orderdate"),
                {"l_orderkey": "scan_ref", "o_custkey": "animal"},
                {"o_orderkey": "scan_ref", "o_orderdate": "day"},
            ),
            (
                log.select("event_id", "user_id"),
                log.select("event_id", "ts"),
                {"event_id": "scan_ref", "user_id": "animal"},
                {"event_id": "scan_ref", "ts": "day"},
            ),
        ],
        "scan_ref",
        "animal",
        "day",
        {"animal": "string", "day": "date"},
    )
