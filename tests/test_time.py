"""Intervals, nearest lookups, sequence numbers and ranks against brute force."""

from __future__ import annotations

import datetime as dt
import random
from collections import Counter, defaultdict
from decimal import Decimal

import pytest

from cohortspark.operators import asof, intervals, ordering
from cohortspark.operators.profile import neighbour_count

D0 = dt.date(2020, 1, 1)


def day(n: int) -> dt.date:
    return D0 + dt.timedelta(days=n)


SPANS = [
    ("a", "2020-01-01", "2020-01-10", "g1"),
    ("a", "2020-01-10", "2020-02-01", "g2"),
    ("a", "2020-03-01", None, "g3"),
    ("b", "2019-01-01", "9999-12-31", "g1"),
    ("b", "2020-05-01", "2020-04-01", "g9"),
]
SPAN_DDL = "who string, since date, until date, grp string"


def test_change_day_gives_two_rows_and_open_end_none(frame, rows):
    pts = frame("who string, d date", [("a", "2020-01-10"), ("a", "2020-01-10"), ("a", "2020-02-15"), ("a", "2020-03-05"), ("b", "2024-02-29"), ("b", None)])
    got = intervals.interval_membership(pts, frame(SPAN_DDL, SPANS), "who", "d", "since", "until")
    assert rows(got, "who", "d", "grp") == [
        ("a", "2020-01-10", "g1"), ("a", "2020-01-10", "g2"), ("b", "2024-02-29", "g1"),
    ]


@pytest.mark.parametrize(("keep", "want"), [("first", "g1"), ("last", "g2")])
def test_keep_one_side_of_a_change_day(frame, rows, keep, want):
    pts = frame("who string, d date", [("a", "2020-01-10")])
    got = intervals.interval_membership(pts, frame(SPAN_DDL, SPANS), "who", "d", "since", "until", keep)
    assert rows(got, "grp") == [(want,)]


def test_roster_flags_and_agreement(frame, rows):
    spans = frame(SPAN_DDL, SPANS)
    days = frame("grp string, d date", [("g1", "2020-01-05"), ("g1", "2020-01-05")])
    roster = intervals.group_roster(days, spans, "grp", "d", "who", "since", "until")
    assert rows(roster) == [("g1", "a", "2020-01-05"), ("g1", "b", "2020-01-05")]
    pts = frame("who string, d date, said string", [("a", "2020-01-10", "g1"), ("a", "2020-01-20", "g1"), ("c", "2020-01-01", "g1")])
    where = intervals.interval_membership(pts, spans, "who", "d", "since", "until")
    flags = intervals.change_day_flag(pts.select("who", "d"), where, ["who", "d"], "grp")
    assert rows(flags) == [("a", "2020-01-10", "Yes"), ("a", "2020-01-20", "No"), ("c", "2020-01-01", "No")]
    all_days = intervals.declared_vs_derived(pts, where, ["who", "d"], "said", "grp")
    assert rows(all_days, "d", "agrees") == [("2020-01-10", "No"), ("2020-01-10", "Yes"), ("2020-01-20", "No")]
    clean = intervals.declared_vs_derived(pts, where, ["who", "d"], "said", "grp", exclude_change_days=True)
    assert rows(clean, "d", "agrees") == [("2020-01-20", "No")]


@pytest.mark.parametrize("widths", [(64, 4096), (3, 20), (7,)])
def test_interval_join_is_exact_for_a_hot_key(spark, widths):
    rnd = random.Random(5)
    spans = [("hot" if i % 3 == 0 else f"k{i % 9}", day(s := rnd.randint(-300, 300)), day(s + rnd.choice([0, 1, 5, 60, 400])), i) for i in range(150)]
    pts = [("hot" if i % 3 == 0 else f"k{i % 9}", day(rnd.randint(-320, 720)), i) for i in range(300)]
    got = intervals.interval_join(
        spark.createDataFrame(pts, "k string, d date, p int"),
        spark.createDataFrame(spans, "k string, s date, e date, i int"),
        ["k"], "d", "s", "e", widths,
    )
    want = Counter((p, i) for k, d, p in pts for k2, s, e, i in spans if k == k2 and s <= d <= e)
    assert Counter((r.p, r.i) for r in got.collect()) == want
    assert want


WEIGHTS = [
    ("a", "2020-01-08", 10.0), ("a", "2020-01-12", 20.0), ("a", "2020-01-12", 30.0),
    ("a", "2020-02-01", 7.0), ("a", "2020-02-01", None), ("b", "2020-01-01", 1.0),
]


@pytest.mark.parametrize(
    ("direction", "want"),
    [
        # two days before and after: all three observations count
        ("nearest", [("a", "2020-01-10", 2, 20.0), ("a", "2020-02-02", 1, None), ("b", "2020-01-01", 0, 1.0)]),
        ("forward", [("a", "2020-01-10", 2, 25.0), ("b", "2020-01-01", 0, 1.0)]),
        ("backward", [("a", "2020-01-10", -2, 10.0), ("a", "2020-02-02", -1, None), ("b", "2020-01-01", 0, 1.0)]),
    ],
)
def test_nearest(frame, rows, direction, want):
    pts = frame("who string, d date", [("a", "2020-01-10"), ("a", "2020-02-02"), ("b", "2020-01-01"), ("c", "2020-01-01")])
    obs = frame("who string, at date, w double", WEIGHTS)
    assert rows(asof.nearest_observation(pts, obs, "who", "d", "at", "w", direction)) == want


def test_nearest_random_hot_key(spark):
    rnd = random.Random(9)
    key = lambda i: "hot" if i % 2 else f"k{i % 5}"
    pts = {(key(i), day(rnd.randint(0, 200))) for i in range(150)}
    obs = [(key(rnd.randint(0, 99)), day(rnd.randint(0, 200)), float(rnd.randint(1, 50))) for _ in range(200)]
    got = asof.nearest_observation(
        spark.createDataFrame(list(pts), "k string, d date"),
        spark.createDataFrame(obs, "k string, at date, w double"), "k", "d", "at", "w",
    )
    want = {}
    for k, d in pts:
        dist = [(abs((at - d).days), w) for k2, at, w in obs if k2 == k]
        if dist:
            best = min(x for x, _ in dist)
            vals = [w for x, w in dist if x == best]
            want[k, d] = (best, round(sum(vals) / len(vals), 9))
    assert {(r.k, r.d): (r.day_diff, round(r.w, 9)) for r in got.collect()} == want


def test_next_event_keeps_ties(frame, rows):
    pts = frame("who string, d date", [("a", "2020-01-01"), ("a", "2020-01-05"), ("a", "2020-02-01")])
    ev = frame("who string, born date, id int", [("a", "2020-01-05", 1), ("a", "2020-01-05", 2), ("a", "2019-01-01", 3)])
    got = asof.next_event(pts, ev, "who", "d", "born")
    assert rows(got, "d", "id", "day_diff") == [
        ("2020-01-01", 1, -4), ("2020-01-01", 2, -4), ("2020-01-05", 1, 0), ("2020-01-05", 2, 0),
    ]


def test_pairing_needs_more_than_the_gap(frame, rows):
    ev = frame("who string, born date, id int", [("a", "2020-04-01", 1), ("a", "2020-04-02", 2), ("b", "2020-04-02", 3)])
    pairs = frame("who string, paired date, grp string", [("a", "2020-01-12", "z"), ("a", "2020-01-12", "y"), ("a", "2019-12-01", "x")])
    got = asof.attribute_pairing(ev, pairs, "who", "born", "paired", "grp")
    # 80 days after the later pairing is too soon, 81 days is enough
    assert rows(got, "id", "paired", "grp", "day_diff") == [(1, "2019-12-01", "x", 122), (2, "2020-01-12", "y", 81)]


def test_row_numbers_across_id_slices(spark, monkeypatch):
    monkeypatch.setattr(ordering, "ID_SLICE", 4)
    rnd = random.Random(1)
    data = [(rnd.choice(["hot", "hot", "x", None]), None if rnd.random() < 0.1 else day(rnd.randint(0, 5)), i) for i in range(120)]
    got = ordering.number_rows(spark.createDataFrame(data, "k string, d date, id int"), ["k"], ["d", "id"], "no")
    groups = defaultdict(list)
    for k, d, i in data:
        groups[k].append((d is None, d or D0, i))
    want = {i: n for rows in groups.values() for n, (_, _, i) in enumerate(sorted(rows), 1)}
    assert {r.id: r.no for r in got.collect()} == want


def test_row_numbers_need_a_day_or_an_id(frame):
    with pytest.raises(ValueError, match="date or an integer"):
        ordering.number_rows(frame("k int, s string", [(1, "a")]), ["k"], ["s"], "no")


def test_day_numbers_are_dense_and_missing_days_have_none(frame, rows):
    df = frame("k int, d date", [(1, "2020-01-01"), (1, "2020-01-01"), (1, "2020-01-09"), (1, None)])
    assert rows(ordering.number_days(df, ["k"], "d", "no")) == [
        (1, "2020-01-01", 1), (1, "2020-01-01", 1), (1, "2020-01-09", 2), (1, None, None),
    ]


@pytest.mark.parametrize("exact", [True, False])
def test_ranks_and_neighbours(spark, exact):
    rnd = random.Random(3)
    data = [("hot" if i % 2 else "x", rnd.randint(-40, 40) / 2, i) for i in range(80)]
    kind = "decimal(6,2)" if exact else "double"
    df = spark.createDataFrame([(k, Decimal(str(v)) if exact else v, i) for k, v, i in data], f"k string, v {kind}, i int")
    table = ordering.value_table(df, ["k"], "v", {"n5": 5, "n10": 10}, "rank", 10)
    got = {(r.k, float(r.v)): (r["rank"], r.n5, r.n10) for r in table.collect()}
    for k, v, _ in data:
        same = [w for k2, w, _ in data if k2 == k]
        want = (1 + sum(w > v for w in same), *(sum(abs(w - v) < t for w in same) - 1 for t in (5, 10)))
        assert got[k, v] == want


def test_one_missing_value_hides_all_counts(frame, rows):
    df = frame("k int, v int", [(1, 3), (1, 5), (2, 3), (2, None)])
    assert rows(neighbour_count(df, ["k"], "v", {"n": 3}, 10)) == [(1, 3, 1), (1, 5, 1), (2, 3, None), (2, None, None)]


def test_threshold_wider_than_slice_is_refused(frame):
    with pytest.raises(ValueError, match="width"):
        neighbour_count(frame("k int, v int", [(1, 1)]), ["k"], "v", {"n": 30}, 10)


def test_summary_quartiles(frame):
    df = frame("v double", [(float(v),) for v in (1, 2, 2, 4, 10, 17, 30)] + [(None,)])
    got = ordering.summary_stats(df, "v", width=5.0).first()
    assert (got["min"], got.q1, got.median, got.q3, got["max"], got.n_null) == (1, 2, 4, 13.5, 30, 1)
    assert got.mean == pytest.approx(66 / 7)


def test_summary_by_group(frame):
    df = frame("k string, v int", [("a", 1), ("a", 3), ("b", 5), ("c", None)])
    got = {r.k: (r.median, r.n_null) for r in ordering.summary_stats(df, "v", by=["k"], width=2).collect()}
    assert got == {"a": (2.0, 0), "b": (5.0, 0), "c": (None, 1)}


def test_select_in_period_is_inclusive(frame, rows):
    periods = frame("who string, newest date, oldest date", [("a", "2020-07-01", "2020-01-01"), ("a", "2020-01-01", "2019-07-01")])
    ev = frame("who string, d date, id int", [("a", "2020-01-01", 1), ("a", "2020-07-02", 2), ("a", "2019-07-01", 3)])
    got = intervals.select_in_period(periods, ev, "who", "d", "newest", "oldest")
    assert rows(got, "id", "oldest") == [(1, "2019-07-01"), (1, "2020-01-01"), (3, "2019-07-01")]


def test_groups_at_several_dates(frame, rows):
    who = frame("who string, born date, began date", [("a", "2019-12-31", "2020-01-09"), ("b", None, "2020-01-01"), ("z", "2020-01-01", None)])
    got = intervals.groups_at_offsets(
        who, frame(SPAN_DDL, SPANS), "who", {"early": ("born", 10), "late": ("began", 14)}, "grp", "since", "until"
    )
    # 2020-01-10 is a change day: the earlier interval wins
    assert rows(got) == [("a", "g1", "g2"), ("b", None, "g1")]
    none = intervals.group_at_offset(who, frame(SPAN_DDL, SPANS), "who", "began", 0, "grp", "since", "until", "g", exclude=["g1"])
    assert rows(none) == []


def test_roster_union_upper_cases(frame, rows):
    a, b = frame("id string", [("x1",)]), frame("id string", [("X1",), ("y2",)])
    assert rows(intervals.roster_union(a, b, "id")) == [("X1",), ("Y2",)]


def test_day_table(frame, rows):
    df = frame("k int, d date", [(1, "2020-01-01"), (1, "2020-01-01"), (1, "2020-01-03")])
    assert rows(ordering.day_table(df, ["k"], "d")) == [
        (1, "2020-01-01", 2, 0, 1, None, "2020-01-03"), (1, "2020-01-03", 1, 2, 2, "2020-01-01", None),
    ]


def test_interval_cells_are_few(spark):
    """An interval to the end of the calendar is stored in a bounded number of rows."""
    from cohortspark.operators import intervals

    spans = spark.sql("SELECT 1 AS k, DATE '1995-01-01' AS a, DATE '9999-12-31' AS b")
    points = spark.sql("SELECT 1 AS k, DATE '2020-01-01' AS d")
    joined = intervals.interval_join(points, spans, ["k"], "d", "a", "b")
    assert joined.count() == 1
    plan = joined._jdf.queryExecution().executedPlan()
    made = []

    def walk(node):
        if node.nodeName() == "Generate":
            made.append(node.metrics().apply("numOutputRows").value())
        for i in range(node.children().size()):
            walk(node.children().apply(i))

    joined.collect()
    plan = joined._jdf.queryExecution().executedPlan()
    walk(plan.executedPlan() if plan.nodeName().startswith("AdaptiveSparkPlan") else plan)
    assert all(n <= intervals.CELLS_PER_INTERVAL + 1 for n in made)


def test_slices_follow_the_data(spark):
    from pyspark.sql import functions as F

    df = spark.range(3000).select((F.rand(3) * F.lit(1.0)).alias("v"))
    values = sorted(r.v for r in df.collect())
    got = ordering.summary_stats(df, "v").first()
    assert got.median == pytest.approx((values[1499] + values[1500]) / 2)
    ids = spark.range(2000).select(F.lit(1).alias("k"), F.xxhash64("id").alias("i"))
    width = ordering.id_slice(ids, "i", rows=50)
    buckets = ids.groupBy(ordering._buckets(ids, ["i"], width)["_b0"]).count()
    assert buckets.agg(F.max("count")).first()[0] < 150
    numbered = ordering.number_rows(ids, ["k"], ["i"], "n", width=width)
    assert [r.n for r in numbered.orderBy("i").collect()] == list(range(1, 2001))


def generators(df) -> int:
    """Generate nodes in the plan: one stores the intervals, one more would repeat the points."""
    return df._jdf.queryExecution().optimizedPlan().toString().count("Generate ")


def test_points_become_one_row_for_intervals_of_one_level(spark):
    """Points are not repeated for levels that no interval needs, and a flag takes one aggregation by day."""
    from cohortspark.operators import profile

    spans = spark.createDataFrame([("a", day(0), day(30), "g1"), ("a", day(30), day(2000), "g2")], "k string, s date, e date, g string")
    points = spark.createDataFrame([("a", day(30)), ("a", day(31)), ("b", day(30))], "k string, d date")
    where = intervals.interval_membership(points, spans, "k", "d", "s", "e", unique=True)
    assert generators(where) == 1
    assert sorted((r.d, r.g) for r in where.collect()) == [(day(30), "g1"), (day(30), "g2"), (day(31), "g2")]
    flags = intervals.change_day_flag(points, where, ["k", "d"], "g")
    assert flags._jdf.queryExecution().optimizedPlan().toString().count("Aggregate ") == 1
    assert "distinct" not in flags._jdf.queryExecution().optimizedPlan().toString()
    assert sorted((r.k, r.d, r.change_day) for r in flags.collect()) == [("a", day(30), "Yes"), ("a", day(31), "No"), ("b", day(30), "No")]
    births = spark.createDataFrame([("a", day(20)), ("a", day(16)), ("a", day(15))], "k string, born date")
    young = profile.young_count(points, births, ["k"], "d", "born")
    assert generators(young) == 1
    assert sorted((r.k, r.d, r.young) for r in young.collect()) == [("a", day(30), 2), ("a", day(31), 1), ("b", day(30), 0)]


@pytest.mark.parametrize("lengths", [[0, 1, 5], [0, 40, 400, 3000], [1, 300, 90_000, 2_900_000]])
def test_cell_widths_follow_the_intervals(spark, lengths):
    rnd = random.Random(len(lengths))
    least, last = dt.date(2000, 1, 1), dt.date(9999, 12, 31)
    spans = []
    for i in range(120):
        s = least + dt.timedelta(days=rnd.randint(0, 3000))
        n = rnd.choice(lengths)
        spans.append(("hot" if i % 3 == 0 else f"k{i % 7}", s, last if n > (last - s).days else s + dt.timedelta(days=n), i))
    spans += [("hot", least, None, 900), ("hot", least + dt.timedelta(days=9), least, 901)]
    points = [("hot" if i % 3 == 0 else f"k{i % 7}", least + dt.timedelta(days=rnd.randint(-5, 6000))) for i in range(200)] + [("hot", last), ("hot", None)]
    stored = spark.createDataFrame(spans, "k string, s date, e date, i int")
    widths = intervals.cell_widths(stored, "s", "e")
    longest = max((e - s).days for _, s, e, _ in spans if e and e >= s)
    assert widths[-1] * intervals.CELLS_PER_INTERVAL >= longest
    assert len(widths) == 1 or widths[-2] * intervals.CELLS_PER_INTERVAL <= 2 * longest
    got = intervals.interval_membership(spark.createDataFrame(points, "k string, d date"), stored, "k", "d", "s", "e")
    want = {(k, d, i) for k, d in points if d for j, s, e, i in spans if j == k and e and s <= d <= e}
    assert sorted((r.k, r.d, r.i) for r in got.collect()) == sorted(want)


def test_cell_widths_of_nothing(spark):
    nothing = spark.createDataFrame([], "k string, s date, e date")
    assert intervals.cell_widths(nothing, "s", "e") == intervals.CELL_WIDTHS[:1]
