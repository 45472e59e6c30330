"""Writers: CSV for hand-over, Parquet partitioned by a date part for reuse."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortspark.operators.ordering import global_order


def write_csv(
    df: DataFrame,
    path: str,
    missing: str = "NA",
    mode: str = "errorifexists",
    order: Sequence[str] = (),
    row_names: str | None = None,
) -> None:
    """Headered CSV folder, one file per partition.

    ``row_names`` names a first column with the rows' places from 1, as text, in ``order`` (default: all columns); the files then
    hold consecutive runs of that order, by name.
    """
    if row_names is not None:
        if row_names in df.columns:
            raise ValueError(f"the column {row_names} is there already")
        numbered = global_order(df, list(order) or df.columns, row_names)
        ranged = numbered.repartitionByRange(row_names).sortWithinPartitions(row_names)
        df = ranged.select(F.col(row_names).cast("string").alias(row_names), *[F.col(f"`{c}`") for c in df.columns])
    elif order:
        df = df.orderBy(*[F.col(c).asc_nulls_last() for c in order])
    df.write.mode(mode).csv(path, header=True, nullValue=missing, emptyValue="", escape='"')


def write_parquet(
    df: DataFrame, path: str, partition_by: Sequence[str] = (), mode: str = "errorifexists"
) -> None:
    df.write.mode(mode).partitionBy(*partition_by).parquet(path)
