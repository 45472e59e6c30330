"""Panels, scan and focal counts, dyads, ratings, multivariate summaries, sources, plans."""

from __future__ import annotations

import re

import pytest
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

import __spark_entry__ as registry
from cohortspark.plans import catalog
from cohortspark.operators import dyads, focal, panel, scan, stats
from cohortspark.sources import readers, schemas, writers


def test_panel_conserves_totals(frame, rows):
    units = frame("u int, d date", [(1, "2020-01-01"), (2, "2020-01-02")])
    facts = frame("u int, b string, n int", [(1, "x", 2), (1, "x", 3), (9, "x", 5), (1, "other", 1)])
    got = panel.balanced_panel(units, facts, ["u"], "b", ["x", "y"], ["n"])
    assert rows(got) == [(1, "2020-01-01", "x", 5), (1, "2020-01-01", "y", 0), (2, "2020-01-02", "x", 0), (2, "2020-01-02", "y", 0)]
    kept = panel.balanced_panel(units, facts, ["u"], "b", ["x", "y"], ["n"], drop_empty="n")
    assert rows(kept, "u", "b", "n") == [(1, "x", 5), (1, "y", 0)]
    assert rows(panel.exclude_empty_units(got, ["u"], "n")) == rows(got.filter("u = 1"))


def test_given_totals_missing_code(frame, rows):
    facts = frame("u int, b string, r int, n int", [(1, "Groom", 0, 1), (1, "Groom", 1, 2), (1, "Groom", None, 4), (1, "Dig", None, 8), (1, "Dig", 0, 16)])
    # a directed behaviour without a code drops out, others never do
    assert rows(panel.given_totals(facts, ["u"], "b", "r", ["n"], ["Groom"])) == [(1, "Dig", 24), (1, "Groom", 2)]


def test_daily_rollup_and_effort(frame, rows):
    facts = frame("u int, b string, n int, t double", [(1, "Dig", 2, 900.0), (1, "Rest", 1, 2700.0), (1, "Out of sight", 1, 400.0), (2, "Out of sight", 1, 10.0)])
    got = panel.daily_rollup(facts, ["u"], "b", ["Dig", "Rest", "Out of sight"], "n", "t")
    assert rows(got.filter("u = 1"), "b", "seen", "n", "proportion", "per_hour") == [
        ("Dig", 3600.0, 2, 0.25, 2.0), ("Out of sight", 3600.0, 1, 400 / 3600, 1.0), ("Rest", 3600.0, 1, 0.75, 1.0),
    ]
    assert {r.proportion for r in got.filter("u = 2").collect()} == {None}
    effort = panel.observation_effort(facts, ["u"], "b", "t")
    assert rows(effort) == [(1, 3600.0)]
    checks = panel.effort_checks(frame("s double", [(10.0,), (200.0,), (1200.0,), (5000.0,)]), "s").first()
    assert tuple(checks) == (4, 1, 2, 2, 1)
    seen = frame("o double, x double", [(10.0, None), (10.0, 4.0), (None, 1.0)])
    assert [r[0] for r in seen.select(panel.seen_time(F.col("o"), F.col("x"))).collect()] == [10, 6, None]


def test_dictionary_and_modifiers(frame, rows):
    codes = frame("label string, raw string, code int", [("Groom", "RGroom", 0), ("Groom", "Groom", 1), ("Dig", "Dig", None)])
    assert rows(panel.behaviour_dictionary(codes, "label", "raw"), "raw", "directed") == [("Dig", "No"), ("Groom", "Yes"), ("RGroom", "Yes")]
    facts = frame("raw string", [("RGroom",), ("zzz",)])
    assert rows(panel.decode_behaviours(facts, codes, "raw", "label", "code")) == [("RGroom", "Groom", 0), ("zzz", None, None)]
    mods = frame("b string, c1 string, c2 string", [("x", "AnimalID", None), ("x", "AnimalID", None), ("y", "Place", "Received"), ("z", None, None)])
    assert rows(panel.modifier_inventory(mods, "b", ["c1", "c2"], ["AnimalID", "Received"])) == [("x", "AnimalID", None), ("y", "Place", "Received")]


def test_scan_instant(frame):
    ev = frame("o int, who string, b string, n int", [(1, "a", "Locomotion", 5), (1, "a", "LocoWork", 2), (1, "a", "Self Groom", 1), (1, "a", "Rest", 4), (1, "a", "Dig", 3)])
    got = {r.b: r.n for r in scan.scan_instant_counts(ev, ["o", "who"], "b", "n").collect()}
    assert len(got) == 21
    assert (got["Locomotion"], got["LocoWork"], got["Self.Groom"], got["Eat"]) == (3, 2, 1, 0)
    assert (got["Help.Burrow"], got["Active.NoHelp"], got["Help.Total"], got["TotActive"]) == (5, 4, 5, 9)
    assert scan.scan_instant_counts(ev, ["o", "who"], "b", "n").first().total_scans == 13


def test_scan_directed_and_combined(frame, rows):
    inst = frame("o int, who string, b string, n int", [(1, "a", "Rest", 4), (1, "b", "Dig", 1)])
    cont = frame("o int, who string, p string, b string, n int", [(1, "a", "b", "Bite", 2), (1, "b", "a", "Bite", 1), (1, "a", None, "Pump", 3), (1, "z", "a", "Pump", 7)])
    got = scan.scan_directed_counts(inst, cont, "o", "who", "p", "b", ["Bite", "Pump"], "n")
    assert rows(got.filter("who = 'a'"), "b", "received", "n") == [
        ("Bite", "G", 2), ("Bite", "R", 1), ("Bite", "T", 3), ("Pump", "G", 3), ("Pump", "R", 7), ("Pump", "T", 10),
    ]
    both = scan.scan_behaviour_counts(inst, cont, "o", "who", "p", "b", ["Bite", "Pump"], "n")
    assert both.count() == 2 * (21 + 6)
    assert rows(both.filter("obs_type = 'ScanCont'"), "o", "who", "b", "received", "n") == rows(got, "o", "who", "b", "received", "n")
    assert {(r.who, r.total_scans) for r in both.collect()} == {("a", 4), ("b", 1)}


def test_scan_categories_keep_unseen(frame, rows):
    inst = frame("o int, who string, b string, n int", [(1, "a", "Rest", 3), (1, "a", "Huddeling", 1), (1, "a", "Food Carry", 4)])
    roster = frame("o int, who string", [(1, "a"), (1, "ghost")])
    got = scan.scan_categories(inst, roster, ["o", "who"], "b", "n")
    assert rows(got.filter("n > 0"), "category", "n", "proportion") == [("Foodcarry", 4, 0.5), ("Rest", 4, 0.5)]
    assert got.filter("who = 'a'").count() == 7
    assert rows(got.filter("who = 'ghost'"), "category", "n") == [(None, None)]


def test_focal_states(frame, rows):
    sessions = frame("f int, seen double", [(1, 1800.0), (2, None)])
    ev = frame("f int, e int, b string, r string, t double, n int, o int", [
        (1, 7, "Huddeling", "Initiated", 100.0, 1, 1), (1, 7, "Huddeling", "Initiated", 100.0, 1, 2),
        (1, 8, "Huddeling", "Received", 50.0, 1, 3), (1, 8, "Huddeling", "Received", 50.0, 1, 4),
        (1, 9, "Dig", None, 900.0, 2, 5), (1, 10, "Dig", None, None, 5, 6),
    ])
    got = focal.focal_state_counts(sessions, ev, "f", "e", "b", "r", "t", "n", "seen", "o")
    assert got.count() == 2 * 21
    assert rows(got.filter("n > 0"), "b", "t", "n", "per_hour", "percent_time") == [
        ("Dig", 900.0, 2, 4.0, 50.0), ("Huddeling", 100.0, 1, 2.0, 100 / 18), ("Huddeling_R", 100.0, 2, 4.0, 100 / 18),
    ]
    assert {r.per_hour for r in got.filter("f = 2").collect()} == {None}


def test_focal_points(frame, rows):
    sessions = frame("f int, seen double", [(1, 3600.0)])
    ddl = "f int, b string, r string, n int, side string, way string, loc string"
    ev = frame(ddl, [
        (1, "Bite", "Initiated", 1, None, None, None), (1, "Bite", "Received", 2, None, None, None), (1, "Bite", None, 4, None, None, None),
        (1, "Pass", None, 1, None, "NoseToNose", "Over"), (1, "Pass", "Received", 2, None, "NoseToNose", "Over"), (1, "Pass", None, 8, None, None, "Over"),
        (1, "Copulation", None, 1, "Front", None, None), (1, "Copulation", None, 2, "Back", None, None), (1, "Copulation", None, 4, None, None, None),
        (1, "Dig", None, 9, None, None, None),
    ])
    got = focal.focal_point_counts(sessions, ev, "f", "b", "r", "n", "side", "way", "loc", "seen")
    assert got.count() == 30 * 3
    counts = {(r.b, r.direction): r.n for r in got.filter("n > 0").collect()}
    assert counts == {
        ("Bite", "G"): 5, ("Bite", "R"): 2, ("Bite", "T"): 7, ("Copulation", "G"): 2, ("Copulation", "T"): 2,
        ("CopulationF", "G"): 1, ("CopulationF", "T"): 1, ("Pass", "G"): 11, ("Pass", "T"): 11,
        ("Pass_NoseToNose_Over", "G"): 1, ("Pass_NoseToNose_Over", "R"): 2, ("Pass_NoseToNose_Over", "T"): 3,
    }


def test_dyads(frame, rows):
    pairs = frame("i int, who string, p string, d date, g string, st string, r int", [
        (1, "a", "b", "2020-01-05", "x", "S", 0), (2, "a", "b", "2020-01-05", "x", "S", 1), (3, "a", "b", "2020-01-05", "y", "S", 0),
        (4, "a", "b", "2020-01-05", "x", "OUT", 0), (5, "a", "b", "2020-01-05", "x", None, 0), (6, "a", "c", "2020-01-05", "x", "S", 0),
        (1, "a", "b", "2020-01-05", "x", "S", 0),
    ])
    spans = frame("who string, g string, since date, until date", [("b", "x", "2020-01-01", "2020-02-01")])
    valid = dyads.valid_dyads(pairs, spans, "who", "p", "d", "g", "st", "OUT", "since", "until")
    assert rows(valid, "i") == [(1,), (2,)]
    won = dyads.win_loss(valid, F.lit(True), "r", 0, 1, "who", "p", ["i", "g", "d"], "g", ["d", "i"])
    assert rows(won, "i", "winner", "loser", "contest_no") == [(1, "a", "b", 1), (2, "b", "a", 2)]


def test_elo(frame):
    games = frame("g string, w string, l string, d date", [("x", "a", "b", "2020-01-01"), ("x", "a", "b", "2020-01-02"), ("x", "b", "a", "2020-01-09"), ("y", "a", "b", "2020-01-01")])
    got = {(r.g, r.player): (r.wins, r.losses, r.rating) for r in dyads.periodic_ratings(games, "g", "w", "l", "d", 7).collect()}
    # first week: two wins at even odds, +50 each; second week: the loser at 900 beats the winner at 1100
    swing = 100 * (1 - 1 / (1 + 10 ** (200 / 400)))
    assert got["x", "a"][:2] == (2, 1) and got["x", "a"][2] == pytest.approx(1100 - swing)
    assert got["x", "b"][2] == pytest.approx(900 + swing)
    assert got["y", "a"] == (1, 0, 1050.0)


def test_multivariate(spark, rows):
    data = [(i, i % 3, float(i % 3 * 5 + (i * 7 % 11) / 10), float((i * 5 % 13) / 3)) for i in range(90)]
    df = spark.createDataFrame(data, "i int, c int, x double, y double")
    r = stats.behaviour_correlation(df, ["x", "y"]).first().r
    assert r == pytest.approx(df.stat.corr("x", "y"))
    assert len(stats.principal_components(df, ["x", "y"], 2, ["i"]).columns) == 3
    model = stats.multinomial(df, ["x", "y"], "c")
    hit = stats.predict(model, df, ["x", "y"], ["i", "c"]).filter("c = predicted").count()
    assert hit == 90
    ld = stats.linear_discriminants(df, ["x", "y"], "c", 1, ["c"]).groupBy("c").agg(F.min("ld1").alias("a"), F.max("ld1").alias("b"))
    spans = sorted((r.a, r.b) for r in ld.collect())
    assert all(spans[k][1] < spans[k + 1][0] for k in range(2))


def test_csv(spark, frame, rows, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "x.csv").write_text('"id","name","v","d"\n1,"NA",NA,2020-01-02\n2,"",1.5,NA\n3,,x,\n4,"a, ""b""",2,2020-01-03\n')
    schema = StructType.fromDDL("id int, name string, v double, d date")
    df = readers.read_csv(spark, str(tmp_path / "in"), schema)
    assert rows(df) == [(1, None, None, "2020-01-02"), (2, "", 1.5, None), (3, "", None, None), (4, 'a, "b"', 2.0, "2020-01-03")]
    writers.write_csv(df, str(tmp_path / "out"))
    assert rows(readers.read_csv(spark, str(tmp_path / "out"), schema)) == rows(df)
    writers.write_parquet(df, str(tmp_path / "pq"), ["id"])
    assert rows(readers.read_parquet(spark, str(tmp_path / "pq"), ["id", "v"])) == rows(df, "id", "v")


def test_imports(frame, rows):
    old = frame("ScanRef int, AnimalID string", [(1, "a"), (1, "a"), (2, "b"), (9, "c")])
    old_s = frame("ScanRef int, ObsDate date", [(1, "2020-01-01"), (2, "2020-01-01")])
    new = frame("ScanFileID string, Subject string", [("n1", "a")])
    new_s = frame("ScanFileID string, On date", [("n1", "2020-01-01")])
    got = readers.observation_dates(
        [(old, old_s, {}, {}), (new, new_s, {"ScanFileID": "ScanRef", "Subject": "AnimalID"}, {"ScanFileID": "ScanRef", "On": "ObsDate"})],
        "ScanRef", "AnimalID", "ObsDate", {"AnimalID": "string", "ObsDate": "date"},
    )
    assert rows(got) == [("a", "2020-01-01"), ("a", "2020-01-01"), ("b", "2020-01-01"), ("c", None)]
    both = readers.reconcile_imports([(old, {"ScanRef": "ref"}), (new, {"ScanFileID": "ref", "Subject": "AnimalID"})], {"ref": "int", "AnimalID": "string"})
    assert (None, "a") in rows(both) and both.count() == 5
    codes = frame("CodeRef string, Value int, Label string", [("P", 2, "b"), ("P", 1, "a"), ("S", 1, "z"), ("P", 1, "a")])
    assert [tuple(r) for r in readers.code_list(codes, "P").collect()] == [(1, "a"), (2, "b")]
    assert rows(readers.without(frame("a string", [("x",), (None,)]), "a", ["x"])) == [(None,)]


def test_declared_schemas():
    assert {"membership", "dyad", "behaviour_code"} <= set(schemas.names())
    assert all(schemas.schema(n).fields for n in schemas.names())


#: queries whose result is a single row per table or per fixed list
GRAND = {"grand_total", "behaviour_correlation", "elo_rating"}


@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - {"pca", "multinomial", "lda", "pca_two", "lda_two", "elo_rating"}))
def test_plans_stay_distributed(spark, name):
    """No cartesian or nested-loop join, no window or aggregate over all rows, no row-wise Python."""
    threshold = "spark.sql.autoBroadcastJoinThreshold"
    before = spark.conf.get(threshold)
    spark.conf.set(threshold, "-1")
    try:
        df = registry.queries()[name](spark, "/root/testdata/sf0.001")
        plan = df._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set(threshold, before)
    assert not re.search(r"CartesianProduct|BroadcastNestedLoopJoin|PythonUDF|InPandas|PythonEval", plan)
    if name not in GRAND:
        assert "SinglePartition" not in plan
    assert plan.count("Exchange ") <= 60


def test_rollup_counts_effort_of_unlisted_behaviours(frame, rows):
    facts = frame(
        "u int, b string, n bigint, t double",
        [(1, "a", 1, 10.0), (1, "b", 1, 30.0), (2, "b", 1, 5.0), (3, "Out of sight", 1, 7.0)],
    )
    out = panel.daily_rollup(facts, ["u"], "b", ["a"], "n", "t")
    assert rows(out, "u", "seen", "t", "proportion") == [
        (1, 40.0, 10.0, 0.25),
        (2, 5.0, 0.0, 0.0),
        (3, 0.0, 0.0, None),
    ]


def test_scan_keeps_everyone_seen(frame, rows):
    events = frame("s int, a int, b string, n bigint", [(1, 1, "Dig", 2), (1, 2, "Yawn", 3)])
    out = scan.scan_instant_counts(events, ["s", "a"], "b", "n", ["Dig", "Rest"])
    assert rows(out.filter("b = 'Dig'"), "a", "total_scans", "n") == [(1, 2, 2), (2, 0, 0)]


def test_models_keep_incomplete_rows(spark):
    data = [(i, float(i % 7), float((i * 3) % 5), i % 2) for i in range(20)] + [(20, None, 1.0, 1)]
    df = spark.createDataFrame(data, "i int, x double, y double, label int")
    scores = {r["i"]: r for r in stats.principal_components(df, ["x", "y"], 2, ["i"]).collect()}
    assert len(scores) == 21 and scores[20]["pc1"] is None and scores[3]["pc1"] is not None
    axes = {r["i"]: r for r in stats.linear_discriminants(df, ["x", "y"], "label", 1, ["i"]).collect()}
    assert len(axes) == 21 and axes[20]["ld1"] is None and axes[3]["ld1"] is not None
    model = stats.multinomial(df, ["x", "y"], "label")
    guess = {r["i"]: r["predicted"] for r in stats.predict(model, df, ["x", "y"], ["i"]).collect()}
    assert len(guess) == 21 and guess[20] is None and guess[3] is not None
