from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from cohortspark.functions import nulls
from cohortspark.operators import relational as rel


def test_not_isin_keeps_missing(frame, rows):
    df = frame("a string", [("x",), ("y",), (None,)])
    assert rows(df.filter(nulls.not_isin_safe(F.col("a"), ["x"]))) == [("y",), (None,)]
    assert rows(df.filter(nulls.isin_safe(F.col("a"), ["x"]))) == [("x",)]


def test_ifelse_is_missing_where_condition_is(frame, rows):
    df = frame("a int", [(1,), (2,), (None,)])
    out = df.select("a", nulls.ifelse_na(F.col("a") == 1, F.lit("y"), F.lit("n")).alias("b"))
    assert rows(out) == [(1, "y"), (2, "n"), (None, None)]


def test_strict_sum_and_distinct_count(frame, rows):
    df = frame("k string, v int", [("a", 1), ("a", 2), ("b", 1), ("b", None)])
    out = df.groupBy("k").agg(nulls.sum_strict(F.col("v")).alias("s"), nulls.n_distinct_na(F.col("v")).alias("n"))
    assert rows(out) == [("a", 3, 2), ("b", None, 2)]


def test_fill_turns_number_into_text(frame, rows):
    df = frame("k int, v int", [(1, 5), (2, None)])
    assert rows(nulls.fill(df, {"v": "none"})) == [(1, "5"), (2, "none")]


@pytest.mark.parametrize(
    ("how", "want"),
    [
        ("inner", [(1, "a", "x"), (None, "b", "y")]),
        ("left", [(1, "a", "x"), (2, "c", None), (None, "b", "y")]),
        ("full", [(1, "a", "x"), (2, "c", None), (3, None, "z"), (None, "b", "y")]),
        ("left_semi", [(1, "a"), (None, "b")]),
        ("left_anti", [(2, "c")]),
    ],
)
def test_natural_join_matches_missing_keys(frame, rows, how, want):
    left = frame("k int, l string", [(1, "a"), (None, "b"), (2, "c")])
    right = frame("k int, r string", [(1, "x"), (None, "y"), (3, "z")])
    assert rows(rel.natural_join(left, right, how)) == want


def test_natural_join_refuses_clashes(frame):
    left, right = frame("k int, v int", [(1, 1)]), frame("k int, v int", [(1, 2)])
    with pytest.raises(ValueError, match="both sides"):
        rel.natural_join(left, right, on="k")
    with pytest.raises(ValueError, match="no common column"):
        rel.natural_join(left, frame("z int", [(1,)]))


def test_join_on_different_names(frame, rows):
    left = frame("a int, l string", [(1, "p"), (None, "q")])
    right = frame("b int, r string", [(1, "x"), (None, "y")])
    assert rows(rel.join_on(left, right, {"a": "b"})) == [(1, "p", "x"), (None, "q", "y")]


def test_keep_first_orders_missing_last(frame, rows):
    df = frame("k int, d date, v string", [(1, None, "a"), (1, "2020-01-02", "b"), (1, "2020-01-01", "c"), (2, None, "d")])
    assert rows(rel.keep_first(df, "k", "d")) == [(1, "2020-01-01", "c"), (2, None, "d")]


def test_keep_first_of_keys_only(frame, rows):
    assert rows(rel.keep_first(frame("k int", [(1,), (1,), (2,)]), "k", "k")) == [(1,), (2,)]


def test_keep_extreme_keeps_ties_and_drops_missing(frame, rows):
    df = frame("k int, v int", [(1, 3), (1, 1), (1, 1), (1, None), (2, None)])
    assert rows(rel.keep_extreme(df, "k", "v")) == [(1, 1), (1, 1)]


def test_contingency_and_reshaping(frame, rows):
    df = frame("k string, c string, n int", [("a", "x", 2), ("a", "x", 3), ("b", "y", 1)])
    assert rows(rel.contingency(df, "k", "c", ["y", "x"])) == [("a", 0, 2), ("b", 1, 0)]
    wide = rel.to_wide(df, "k", "c", ["x", "y"], "n")
    assert rows(wide) == [("a", 5, 0), ("b", 0, 1)]
    long = rel.to_long(wide, "k", ["x", "y"], "c", "n")
    assert rows(long) == [("a", "x", 5), ("a", "y", 0), ("b", "x", 0), ("b", "y", 1)]


def test_duplicates_and_group_values(frame, rows):
    df = frame("k int, v int", [(1, 1), (1, 2), (None, 3), (None, 4), (2, 5)])
    assert rows(rel.duplicates(df, "k")) == [(1, 1, 2), (1, 2, 2), (None, 3, 2), (None, 4, 2)]
    assert rows(rel.group_values(df, "k", total=F.sum("v"))) == [
        (1, 1, 3), (1, 2, 3), (2, 5, 5), (None, 3, 7), (None, 4, 7),
    ]


def test_unions_fill_missing_columns(frame, rows):
    a, b = frame("k int, x int", [(1, 1), (1, 1)]), frame("k int, y int", [(2, 2)])
    assert rows(rel.union_distinct(a, b)) == [(1, 1, None), (2, None, 2)]


def test_names(frame):
    df = frame("a int", [(1,)]).select(F.col("a").alias("ng/ul"), F.col("a").alias("2nd one"))
    assert rel.make_names(df).columns == ["ng.ul", "X2nd.one"]


def test_staging_leaves_no_table(spark):
    from pathlib import Path

    from cohortspark.session import shared_folder, staged, staging

    folder = Path(shared_folder(spark))
    before = set(folder.iterdir())
    with staging(spark):
        assert staged(spark.range(5)).count() == 5
        assert len(set(folder.iterdir()) - before) == 1
    assert set(folder.iterdir()) == before
