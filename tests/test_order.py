"""Places in the order over a whole frame, and row names in exports."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from cohortspark.operators import relational
from cohortspark.operators.ordering import global_order
from cohortspark.sources import readers, writers


def test_global_order_numbers_all_rows(frame):
    df = frame("a int, b string", [(3, "x"), (None, "y"), (1, None), (1, "z"), (3, "x"), (2, "w")])
    got = global_order(df, ["a", "b"]).orderBy("row_no").collect()
    assert [(r.a, r.b) for r in got] == [(1, "z"), (1, None), (2, "w"), (3, "x"), (3, "x"), (None, "y")]
    assert [r.row_no for r in got] == [1, 2, 3, 4, 5, 6]


def test_global_order_descending_and_empty(frame):
    df = frame("a int", [(1,), (None,), (5,)])
    got = global_order(df, [F.col("a").desc_nulls_first()], "place").orderBy("place").collect()
    assert [r.a for r in got] == [None, 5, 1]
    none = global_order(df.where("a > 9"), ["a"])
    assert none.columns == ["a", "row_no"] and none.count() == 0


def test_equal_rows_are_spread_over_ranges(spark):
    """Half of the rows are equal: they still lie in several ranges, and numbers are whole."""
    df = spark.range(0, 20000, 1, 8).select(F.when(F.col("id") % 2 == 0, 7).otherwise(F.col("id")).alias("v"))
    got = global_order(df, ["v"], partitions=8)
    r = got.agg(F.min("row_no"), F.max("row_no"), F.countDistinct("row_no"), F.count("*")).first()
    assert tuple(r) == (1, 20000, 20000, 20000)
    wrong = got.alias("x").join(got.alias("y"), F.col("x.row_no") + 1 == F.col("y.row_no")).where("x.v > y.v")
    assert wrong.count() == 0
    # a range holds about an eighth of all rows although one value has half of them
    ranges = got.groupBy(F.input_file_name().alias("f")).count().agg(F.max("count")).first()[0]
    assert ranges < 20000 / 3


def test_row_names_in_csv(spark, frame, tmp_path):
    df = frame("a int, b string", [(2, "x"), (1, "NA y"), (3, None)])
    path = str(tmp_path / "out")
    writers.write_csv(df, path, order=["a"], row_names="name")
    lines = spark.read.text(path).collect()
    assert sorted(r.value for r in lines if not r.value.startswith("name,")) == ["1,1,NA y", "2,2,x", "3,3,NA"]


def test_code_list_in_order(frame):
    codes = frame("CodeRef string, Value int, Label string", [("k", 2, "b"), ("k", 1, "a"), ("k", 2, "b"), ("m", 0, "z"), ("k", None, "c")])
    got = readers.code_list(codes, "k", row_no="n").orderBy("n").collect()
    assert [(r.n, r.Value, r.Label) for r in got] == [(1, 1, "a"), (2, 2, "b"), (3, None, "c")]


def test_levels_come_from_the_data(frame):
    df = frame("g string, v int, n int", [("a", 2, 5), ("a", 10, 1), ("b", 2, 2), ("b", None, 9), (None, 1, 4)])
    assert relational.levels(df, "v") == [1, 2, 10]
    got = relational.contingency(df, "g", "v")
    assert got.columns == ["g", "1", "2", "10"]
    assert {r[0]: tuple(r)[1:] for r in got.collect()} == {"a": (0, 1, 1), "b": (0, 1, 0), None: (1, 0, 0)}
    wide = relational.to_wide(df, "g", "v", None, "n", default=None)
    assert {r[0]: tuple(r)[1:] for r in wide.collect()} == {"a": (None, 5, 1), "b": (None, 2, None), None: (4, None, None)}
    with pytest.raises(ValueError, match="more than 2"):
        relational.contingency(df, "g", "v", most=2)
    assert relational.contingency(df.limit(0), "g", "v").columns == ["g"]
