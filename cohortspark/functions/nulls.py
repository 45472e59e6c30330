"""NULL rules that differ from Spark's defaults.

The analyses this library serves treat a missing value as a value in group keys and joins, let
"not in" keep missing values, and let a conditional or a strict sum turn missing when its input is.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def isin_safe(col: Column, values: Iterable) -> Column:
    """``col in values``; a NULL is simply not in the list."""
    return F.coalesce(col.isin(list(values)), F.lit(False))


def not_isin_safe(col: Column, values: Iterable) -> Column:
    """``not (col in values)``; keeps NULL rows, unlike ``~col.isin``."""
    return ~isin_safe(col, values)


def ifelse_na(cond: Column, yes, no) -> Column:
    """Two-way conditional that is NULL where the condition is NULL."""
    return F.when(cond, yes).when(~cond, no)


def sum_strict(col: Column) -> Column:
    """Sum that is NULL as soon as one input is NULL."""
    return F.when(F.count(F.lit(1)) == F.count(col), F.sum(col))


def n_distinct_na(col: Column) -> Column:
    """Distinct count in which NULL counts as one more value."""
    return F.count_distinct(col) + F.max(col.isNull().cast("bigint"))


def count_where(cond: Column) -> Column:
    return F.coalesce(F.sum(F.when(cond, 1)), F.lit(0)).cast("bigint")


def fill(df: DataFrame, defaults: dict) -> DataFrame:
    """Replace NULLs per column; a text default turns a non-text column into text."""
    types = dict(df.dtypes)
    out = {}
    for name, default in defaults.items():
        col = F.col(name)
        if isinstance(default, str) and types[name] != "string":
            col = col.cast("string")
        out[name] = F.coalesce(col, F.lit(default))
    return df.withColumns(out)
