"""Status rules, group composition, histories, cohorts, checks and look-back periods."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from cohortspark.functions import status
from cohortspark.functions.dates import age
from cohortspark.operators import cohort, history, periods, profile, quality

SPAN = ("since", "until")


@pytest.mark.parametrize(
    ("diff", "trimester"),
    [
        (-106, "NotPregnant"), (-105, "Conception"), (-90, "Conception"), (-89, "FirstTrimester"),
        (-60, "SecondTrimester"), (-30, "ThirdTrimester"), (0, "ThirdTrimester"), (None, None), (1, None),
    ],
)
def test_trimester_boundaries(spark, diff, trimester):
    df = spark.createDataFrame([(diff,)], "d int")
    assert df.select(status.trimester_status(F.col("d"))).first()[0] == trimester


def test_semester_and_undetermined_tail(frame, rows):
    df = frame(
        "i int, diff int, d date, tenure date, last date",
        [
            (1, -91, "2020-01-01", "2021-01-01", "2020-06-01"),
            (2, -46, "2020-01-01", "2021-01-01", "2020-06-01"),
            (3, -45, "2020-01-01", "2021-01-01", "2020-06-01"),
            (4, None, "2020-10-03", "2021-01-01", "2020-06-01"),
            (5, None, "2020-10-02", "2021-01-01", "2020-06-01"),
            (6, None, "2020-12-15", "2021-01-01", "2020-12-15"),
            (7, None, "2020-12-15", "2021-01-01", None),
        ],
    )
    label = status.semester_status(F.col("diff"), F.col("d"), F.col("tenure"), F.col("last"))
    assert rows(df.select("i", label)) == [
        (1, "NotPregnant"), (2, "FirstSemester"), (3, "SecondSemester"), (4, "Undetermined"),
        (5, None), (6, "Undetermined"), (7, None),
    ]


def test_breeding_status_missing_rule(frame, rows):
    pts = frame("who string, d date", [(w, "2020-06-01") for w in "abcdef"])
    prof = frame(
        "who string, founder int, m date, f date",
        [
            ("a", 1, None, None), ("b", 0, "2020-09-13", None), ("c", 0, "2020-09-14", None),
            ("d", None, None, None), ("e", None, None, "2020-01-01"), ("f", 0, None, None),
        ],
    )
    got = profile.status_at_date(pts, prof, "who", "d", "founder", "m", "f", gestation=105)
    assert rows(got, "who", "status") == [
        ("a", "Breeder"), ("b", "Breeder"), ("c", "Helper"), ("d", None), ("e", "Breeder"), ("f", "Helper"),
    ]


def test_lactation_category_split_bins_and_recode(frame, rows):
    df = frame("s string, st string, y int", [("F", "Breeder", 1), ("F", "Breeder", 0), ("M", "Breeder", 1), ("F", None, 1)])
    lact = status.lactation_status(F.col("s"), F.col("st"), F.col("y"))
    assert [r[0] for r in df.select(lact).collect()] == ["Lactating", "NotLactating", "", ""]
    df = frame("st string, l string, g string", [
        ("Helper", "", None), ("Breeder", "NotLactating", "Conception"), ("Breeder", "NotLactating", "SecondTrimester"),
        ("Breeder", "NotLactating", "ThirdTrimester"), ("Breeder", "Lactating", None), ("Breeder", "NotLactating", None),
    ])
    cat = status.female_category(F.col("st"), F.col("l"), F.col("g"))
    assert [r[0] for r in df.select(cat).collect()] == ["Helper", "NotPreg", "EarlyGest", "LateGest", "Lact", None]
    df = frame("s string, st string, g string", [("F", "Breeder", None), ("F", "Breeder", "FirstTrimester"), ("M", "Breeder", "FirstTrimester")])
    split = status.pregnancy_split(F.col("s"), F.col("st"), F.col("g"))
    assert [r[0] for r in df.select(split).collect()] == ["NonPregnantBreeder", "PregnantBreeder", "Breeder"]
    df = frame("v double", [(-3.0,), (5.99,), (6.0,), (35.9,), (36.0,), (42.4,), (42.5,), (50.0,), (None,)])
    assert [r[0] for r in df.select(status.month_bin(F.col("v"))).collect()] == [6, 6, 12, 36, 42, 42, 42.5, 50, None]
    df = frame("v string", [("N0",), ("x",), (None,)])
    assert [r[0] for r in df.select(status.recode(F.col("v"), {"N0": "NO"})).collect()] == ["NO", "x", None]


def test_age_units(frame):
    df = frame("d date, b date", [("2021-01-01", "2020-01-01")])
    got = df.select(age(F.col("d"), F.col("b")), age(F.col("d"), F.col("b"), "months")).first()
    assert got[0] == 366 and got[1] == pytest.approx(366 / 30.4375)
    with pytest.raises(ValueError, match="unit"):
        age(F.col("d"), F.col("b"), "weeks")


def test_group_profile(frame):
    df = frame(
        "who int, g string, d date, sex string, age int, w int",
        [(1, "x", "2020-01-01", "F", 900, 50), (2, "x", "2020-01-01", "F", 0, 46), (3, "x", "2020-01-01", "M", 900, 55), (4, "y", "2020-01-01", "M", None, None)],
    )
    got = {r.who: r for r in profile.group_profile(df, "g", "d", "sex", "age", "w").collect()}
    a = got[1]
    assert (a.group_size, a.queue_size, a.weight_rank, a.weight_rank_queue, a.age_rank) == (3, 2, 2, 1, 1)
    # a difference of exactly five does not count
    assert (a.comp_5, a.comp_10, a.comp_5_queue, a.pup_count, a.pup_presence, a.min_age) == (1, 2, 1, 1, "Yes", 0)
    assert (got[4].weight_rank, got[4].comp_5, got[4].pup_presence) == (None, None, "No")


def test_profile_keeps_one_row(frame, rows):
    ids = frame("who string", [("a",), ("b",)])
    facts = frame("who string, born date, died date", [("a", "2020-01-01", "2020-03-01"), ("b", None, "2020-03-01")])
    groups = frame("who string, g string", [("a", "g1"), ("a", "g2")])
    got = profile.entity_profile(ids, [facts, groups], "who", "born", "died")
    assert rows(got, "who", "g", "death_age") == [("a", "g1", 60), ("b", None, None)]


def test_parents(frame, rows):
    litters = frame("l int, m string, d date", [(1, "ab", "2020-01-01"), (2, "cd", "2020-02-01")])
    sires = frame("l int, f string", [(1, "S1"), (1, "S1"), (1, "S2"), (2, "Unknown "), (2, None), (9, "S9")])
    got = history.parent_events(litters, sires, "l", "m", "f", "d", "p")
    assert rows(got, "l", "p") == [(1, "AB"), (1, "S1"), (1, "S2"), (2, "CD"), (2, None)]


def test_pairing_sequence_and_timeline(frame, rows):
    pairs = frame("who string, g string, d date", [("a", "x", "2020-01-01"), ("a", "x", "2020-01-01"), ("a", "y", "2020-02-01"), ("a", "x", "2020-03-01"), ("b", "x", "2020-03-01")])
    assert rows(history.pairing_sequence(pairs, "who", "g", "d"), "who", "g", "d", "pairing_no", "pairing_no_in_group", "group_pairing_no") == [
        ("a", "x", "2020-01-01", 1, 1, 1), ("a", "x", "2020-03-01", 3, 2, 2),
        ("a", "y", "2020-02-01", 2, 1, 1), ("b", "x", "2020-03-01", 1, 1, 2),
    ]
    who = frame("who string, began date", [("a", "2020-01-11"), ("z", "2020-01-01")])
    got = history.pairing_timeline(who, frame("who string, d date, id int", [("a", "2020-01-01", 1), ("a", "2020-01-01", 2), ("a", "2020-02-01", 3)]), "who", "d", "id", "began")
    assert rows(got, "who", "pairing_no", "next_pairing_day", "days_from_start") == [
        ("a", 1, "2020-01-01", -10), ("a", 2, "2020-02-01", -10), ("a", 3, None, 21), ("z", 1, None, None),
    ]


def test_event_history_counts_and_groups(frame, rows):
    events = frame("who string, id int, d date", [("a", 1, "2020-06-01"), ("a", 2, "2021-06-01"), ("b", 3, "2020-06-01")])
    sexes = frame("who string, sex string", [("a", "F"), ("b", "M")])
    pairs = frame("who string, paired date, pg string", [("a", "2020-01-01", "x"), ("a", "2021-05-01", "y")])
    spans = frame("who string, g string, since date, until date", [("a", "x", "2020-01-01", "2030-01-01"), ("b", "x", "2020-05-01", "2030-01-01")])
    got = history.event_history(events, sexes, pairs, spans, "who", "id", "d", "paired", "pg", "g", *SPAN)
    assert rows(got, "id", "sex", "paired", "conception_group", "event_group", "event_no", "event_no_in_group", "group_event_no") == [
        (1, "F", "2020-01-01", "x", "x", 1, 1, 1),
        (2, "F", "2020-01-01", "x", "x", 2, 2, 2),
        (3, "M", None, None, "x", 1, 1, 1),
    ]


def test_pairing_success(frame, rows):
    pairs = frame("who string, p date", [("a", "2020-01-01"), ("a", "2021-01-01")])
    litters = frame("who string, d date, p date", [("a", "2020-05-01", "2020-01-01"), ("a", "2020-09-01", "2020-01-01"), ("a", "2019-01-01", None)])
    assert rows(history.pairing_success(pairs, litters, "who", "p", "d"), "p", "first_event_day", "successful", "first_event_ever") == [
        ("2020-01-01", "2020-05-01", "Yes", "2019-01-01"), ("2021-01-01", None, "No", "2019-01-01"),
    ]


def test_members_come_back_as_donors(frame, rows):
    subjects = frame("who string, exp string", [("a", "E"), ("a", "E"), ("b", "E"), ("c", "E")])
    donors = frame("who string", [("a",), ("c",), ("z",)])
    assert rows(cohort.cohort_members(subjects, donors, "who", ["c"])) == [
        ("a", "E", "Yes"), ("b", "E", "No"), ("c", None, "Yes"), ("z", None, "Yes"),
    ]


def test_treatments(frame, rows):
    subjects = frame("who string, born date, began date", [(w, "2020-01-01", "2021-01-01") for w in ("solo", "moved", "stayed", "gone")])
    spans = frame("who string, g string, since date, until date", [
        ("solo", "h", "2020-01-01", "2020-12-01"), ("solo", "s", "2020-12-01", "2022-01-01"),
        ("moved", "h", "2020-01-01", "2020-12-01"), ("moved", "n", "2020-12-01", "2022-01-01"), ("mate", "n", "2020-12-01", "2022-01-01"),
        ("stayed", "h", "2020-01-01", "2022-01-01"), ("sib", "h", "2020-01-01", "2022-01-01"),
        ("gone", "h", "2020-01-01", "2020-12-01"),
    ])
    got = cohort.treatment(subjects, spans, "who", "born", "began", "g", *SPAN)
    assert rows(got, "who", "group_size", "treatment") == [("moved", 2, "Breeder"), ("solo", 1, "Solitary"), ("stayed", 2, "Helper")]


def test_units_series_and_tables(frame, rows):
    df = frame("who int, e string, s string, l int, began date", [(1, "E", "F", 7, "2018-02-01"), (2, "E", "F", 7, "2017-01-01"), (3, "E", "F", 3, "2017-06-01"), (4, "E", "F", 9, None), (5, "E", "M", 9, "2017-10-01")])
    units = cohort.experimental_unit(df, "e", "s", "l", "began")
    assert rows(units, "s", "l", "unit") == [("F", 3, 2), ("F", 7, 1), ("F", 9, 3), ("M", 9, 1)]
    dated = df.withColumns({"b": F.date_sub("began", 365), "x": F.date_add("began", 487)})
    info = cohort.study_info(dated, [(units.drop("first_start"), ["e", "s", "l"])], "began", "b", "x", "2017-10-01")
    got = {r.who: (r.unit, r.series, r.duration) for r in info.collect()}
    assert got[1] == (1, 2, 16.0) and got[5][1] == 1 and got[4] == (3, 1, None)
    table = cohort.dataset_table(frame("s string, u int, st string", [("F", 1, "A"), ("F", None, "A"), ("F", None, "B")]), ["s"], "u", "st", ["A", "B"])
    assert rows(table) == [("F", "1", 1, 0), ("F", "Non-Experimental", 1, 1)]


def test_cohort_table(frame, rows):
    members = frame("who string", [(w,) for w in "abcde"])
    facts = frame("who string, da int, st string, fc date", [
        ("a", 99, "Helper", None), ("b", 500, "King", None), ("c", 500, "Helper", "2020-01-01"), ("d", None, "Queen", None), ("e", 500, None, None),
    ])
    got = cohort.cohort_table(members, [facts], {"punched": frame("who string", [("a",), ("a",)])}, "who", "da", "st", "fc", overrides={"d": "Solitary"})
    assert rows(got, "who", "punched", "st", "queried_status") == [
        ("a", "Yes", "Pup", "Pup"), ("b", None, "King", "Breeder"), ("c", None, "Helper", "Breeder"), ("d", None, "Queen", "Solitary"), ("e", None, None, None),
    ]


def test_quality_checks(frame, rows):
    df = frame("s string, u int, who int, p string", [("F", 1, 1, "Yes"), ("F", 1, 2, None), ("F", 2, 3, "Yes"), ("F", None, 4, "Yes"), ("F", None, 5, None)])
    mixed = quality.incomplete_units(df, ["s", "u"], F.col("p") == "Yes", drop_null=["u"])
    assert rows(mixed, "who", "processed", "n_processed", "n_unprocessed") == [(1, "Yes", 1, 1), (2, "No", 1, 1)]
    assert len(quality.incomplete_units(df, ["s", "u"], F.col("p") == "Yes").collect()) == 4
    bad = quality.status_contradictions(df, {"x": F.col("u") == 1, "y": F.col("p") == "Yes"})
    assert rows(bad, "who", "problem") == [(1, "x"), (1, "y"), (2, "x"), (3, "y"), (4, "y")]
    assert rows(quality.set_difference_check(df, df.filter("u = 1"), ["u"]), "who") == [(3,), (4,), (5,)]
    e = frame("st string, obs_age double, start_delay double, i int", [
        ("King", 1.0, 0.5, 1), ("King", 20.0, -1.0, 2), ("King", 20.0, None, 3), ("Helper", 12.0, -5.0, 4), ("Helper", 11.0, 5.0, 5), (None, 12.0, None, 6),
    ])
    assert rows(quality.eligible_by_delay(e, "st"), "i") == [(1,), (3,), (4,), (6,)]


ENTITY = "who string, born date, began date, died date"


def stretches(got, rows):
    return rows(got, "who", "period", "period_day", "period_type", "end_period", "end_period_day", "end_period_type")


def test_periods_of_a_long_study(frame, rows):
    df = frame(ENTITY, [("a", "2016-01-15", "2017-03-01", "2018-08-31")])
    grid = periods.lookback_grid(df, "who", "born", "began", "died")
    assert rows(grid.filter("months = 6"), "period", "period_day") == [("Six_M", "2018-02-28")]
    assert grid.count() == 8
    assert rows(periods.period_starts(df, "who", "born", "began", "died"), "period", "period_day", "next_period", "period_type") == [
        ("Six_M", "2018-02-28", "Twelve_M", "First"), ("Twelve_M", "2017-08-31", "Eighteen_M", "First"),
    ]
    assert rows(periods.last_period(df, "who", "born", "began", "died"), "period", "period_day", "period_type") == [("Eighteen_M", "2017-03-01", "Last")]
    got = periods.available_periods(df, "who", "born", "began", "died")
    assert sorted(stretches(got, rows), key=lambda r: r[2], reverse=True) == [
        ("a", "Death", "2018-08-31", None, "Six_M", "2018-02-28", "First"),
        ("a", "Six_M", "2018-02-28", "First", "Twelve_M", "2017-08-31", "First"),
        ("a", "Twelve_M", "2017-08-31", "First", "Eighteen_M", "2017-03-01", "Last"),
    ]
    assert len(rows(periods.period_list(got, "who"))) == 3


def test_short_missing_and_inverted_studies(frame, rows):
    df = frame(ENTITY, [
        ("short", "2016-01-01", "2018-05-01", "2018-08-31"),
        ("unknown", None, None, "2018-08-31"),
        ("late", "2016-01-01", "2018-09-30", "2018-08-31"),
        ("alive", "2016-01-01", "2018-01-01", None),
    ])
    got = stretches(periods.available_periods(df, "who", "born", "began", "died"), rows)
    assert [r for r in got if r[0] == "short"] == [("short", "Death", "2018-08-31", None, "Six_M", "2018-05-01", "Last")]
    # start after the end: the start sorts first and closes at the end date
    assert [r for r in got if r[0] == "late"] == [("late", "Six_M", "2018-09-30", "Last", "Death", "2018-08-31", None)]
    assert [r[1:3] + r[4:6] for r in got if r[0] == "unknown"] == [
        ("Death", "2018-08-31", "Six_M", "2018-02-28"), ("Six_M", "2018-02-28", "Twelve_M", "2017-08-31"),
        ("Twelve_M", "2017-08-31", "Eighteen_M", "2017-04-18"),
    ]
    assert not [r for r in got if r[0] == "alive"]


def test_last_stretch_starts_at_the_birthday_or_the_start(frame, rows):
    df = frame(ENTITY, [("young", "2016-12-01", "2016-12-10", "2018-08-31"), ("same", "2016-02-01", "2017-02-01", "2018-08-31")])
    got = rows(periods.last_period(df, "who", "born", "began", "died"), "who", "period_day")
    assert got == [("same", "2017-02-01"), ("young", "2017-12-01")]


def test_samples(frame, rows):
    urine = frame("who string, d date, id int, label string", [("a", "2020-01-01", 2, None), ("a", "2020-01-01", 1, "ok"), ("a", "2020-01-01", 3, "Stress")])
    plasma = frame("who string, d date, id int", [("a", "2020-01-01", 9)])
    got = periods.sample_union({"Urine": urine, "Plasma": plasma}, "who", "d", "id", {"label": ["Stress"]})
    assert rows(got, "sample_type", "id", "repeat_no") == [("Plasma", 9, 1), ("Urine", 1, 1), ("Urine", 2, 2)]
    born = frame("who string, b date", [("a", "2020-02-15")])
    staged = periods.with_gestation(got, born, "who", "d", "b")
    assert {r.gestation for r in staged.collect()} == {"SecondTrimester"}
    spans = frame("who string, period_day date, end_period string, end_period_day date, end_period_type string", [("a", "2020-01-01", "Six_M", "2019-07-01", "First"), ("a", "2020-07-01", "Death", "2020-01-01", None)])
    who = frame("who string, sex string, st string", [("a", "F", "Breeder")])
    chosen = periods.samples_in_period(spans, staged, who, "who", "d", "sex", "st", "gestation")
    assert chosen.count() == 6 and {r.st for r in chosen.collect()} == {"PregnantBreeder"}
    expected = periods.status_expansion(who, periods.period_list(spans, "who"), "who", "sex", "st")
    keys = ["who", "sex", "st", "end_period", "end_period_day", "end_period_type"]
    counts = periods.count_in_period(expected, chosen, keys, "id")
    assert rows(counts, "st", "end_period", "n") == [
        ("NonPregnantBreeder", "Death", 0), ("NonPregnantBreeder", "Six_M", 0), ("PregnantBreeder", "Death", 3), ("PregnantBreeder", "Six_M", 3),
    ]
    sent = frame("no int, at date, lab string", [(9, "2021-01-01", "L")])
    out = periods.export_status(chosen.select("id").distinct(), sent, "id", "no", "at")
    assert rows(out, "id", "exported") == [(1, "No"), (2, "No"), (9, "Yes")]


def test_stage_after_the_last_birth(spark):
    from cohortspark.functions.status import trimester_status

    df = spark.sql(
        "SELECT * FROM VALUES (-106, NULL), (-105, NULL), (-90, NULL), (-60, NULL), (-30, NULL), (0, NULL),"
        " (NULL, DATE '2020-01-01'), (NULL, NULL), (-5, DATE '2020-01-01') AS t(d, last)"
    )
    got = [r[0] for r in df.select(trimester_status(F.col("d"), last_birth=F.col("last"))).collect()]
    assert got == [
        "NotPregnant", "Conception", "Conception", "SecondTrimester", "ThirdTrimester", "ThirdTrimester",
        "PostLastParturition", None, "ThirdTrimester",
    ]
