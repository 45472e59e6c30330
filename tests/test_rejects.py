"""CSV lines that do not fit their schema, and column classes read from a table."""

from __future__ import annotations

import pytest
from pyspark.sql.types import DoubleType, IntegerType, StringType, StructType

from cohortspark.sources import readers

SCHEMA = StructType().add("id", IntegerType(), False).add("name", StringType()).add("weight", DoubleType())


def test_accepted_and_rejected_lines(spark, tmp_path):
    path = tmp_path / "a.csv"
    good = ['1,x,2.5', '2,"a, ""b""",NA', '3,,']
    bad = ['4,y', '5,z,1,9', 'six,"q, r",heavy', 'NA,w,1']
    path.write_text("\n".join(["id,name,weight", *good, *bad, ""]))
    accepted, rejected = readers.read_csv_checked(spark, str(path), SCHEMA)
    assert sorted(tuple(r) for r in accepted.collect()) == [(1, "x", 2.5), (2, 'a, "b"', None), (3, None, None)]
    got = {r.line: r.reasons for r in rejected.collect()}
    assert got["4,y"] == got["5,z,1,9"] == ["wrong number of cells"]
    assert got['six,"q, r",heavy'] == ["id: not int: six", "weight: not double: heavy"]
    assert got["NA,w,1"] == ["id: missing"] and len(got) == 4
    assert accepted.count() + rejected.count() == len(good) + len(bad)


def test_a_file_without_rows(spark, tmp_path):
    path = tmp_path / "none.csv"
    path.write_text("id,name,weight\n")
    accepted, rejected = readers.read_csv_checked(spark, str(path), SCHEMA)
    assert accepted.columns == ["id", "name", "weight"] and accepted.count() == rejected.count() == 0


def test_the_widest_class_wins(frame):
    table = frame(
        "col string, one string, two string",
        [("a", "integer", "numeric"), ("b", "NA", "integer"), ("c", None, None), ("d", "integer", "character"), ("b", "numeric", None)],
    )
    assert readers.column_classes(table, "col") == {"a": "numeric", "b": "numeric", "c": "character", "d": "character"}
    assert readers.column_classes(table, "col", ["one"])["a"] == "integer"
    with pytest.raises(ValueError, match="unknown class"):
        readers.column_classes(frame("col string, one string", [("a", "date")]), "col")


def test_cells_that_do_not_fit_are_listed(frame):
    df = frame("id int, a string, b string, other string", [(1, "5", "x"  , "k"), (2, "5.5", "2", None), (None, "q", None, "m")])
    typed, ledger = readers.apply_classes(df, {"a": "integer", "b": "numeric", "absent": "integer"}, ["id"])
    assert typed.columns == df.columns and typed.schema["a"].dataType.simpleString() == "bigint"
    assert {tuple(r) for r in typed.collect()} == {(1, 5, None, "k"), (2, None, 2.0, None), (None, None, None, "m")}
    assert {tuple(r) for r in ledger.collect()} == {(1, "b", "x", "numeric"), (2, "a", "5.5", "integer"), (None, "a", "q", "integer")}
    assert readers.apply_classes(df, {}, ["id"])[1].count() == 0
