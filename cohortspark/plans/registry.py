"""Name -> (Spark query, SQL check)."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
CHECKS: dict[str, str] = {}


def query(name: str, check: str | None = None, exact: Sequence[str] = ()) -> Callable[[Query], Query]:
    """Register a query. ``exact`` columns are summed as decimals and reported as doubles."""

    def register(fn: Query) -> Query:
        if name in QUERIES:
            raise ValueError(f"{name} is registered twice")

        def run(spark: SparkSession, sf: str) -> DataFrame:
            return fn(spark, sf).withColumns({c: F.col(f"`{c}`").cast("double") for c in exact})

        QUERIES[name] = run if exact else fn
        if check is not None:
            casts = ", ".join(f'CAST("{c}" AS DOUBLE) AS "{c}"' for c in exact)
            CHECKS[name] = f"SELECT * REPLACE ({casts}) FROM (\n{check})" if exact else check
        return fn

    return register
