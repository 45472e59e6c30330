"""Helpers shared by the training-data operators."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortspark.operators.ordering import global_order

#: fixed values: the white space of every word definition here, as regular-expression class members
SPACE = r"\x20\x09-\x0D"
#: the same characters as a literal
SPACE_CHARS = " \t\n\x0b\x0c\r"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def remainder(id_column: str, modulus: int) -> Column:
    """crc32 of an id as text, modulo; a null id counts as empty text."""
    return F.crc32(F.coalesce(F.col(id_column).cast("string"), F.lit(""))) % modulus


def whole_text(column: str = "text") -> Column:
    """A text column with null as the empty text."""
    return F.coalesce(F.col(column), F.lit(""))


PARTS = "part int, block int, data binary"


def _adding(kind: type):
    def run(rows: pd.DataFrame) -> pd.DataFrame:
        total = np.sum([np.frombuffer(d, dtype=kind) for d in rows["data"]], axis=0, dtype=np.float64).astype(kind)
        return pd.DataFrame({"part": [rows["part"].iloc[0]], "block": [rows["block"].iloc[0]], "data": [total.tobytes()]})

    return run


def blocks(vector: np.ndarray, part: int, n: int = 16, kind: type = np.float64) -> pd.DataFrame:
    """A task's vector as rows for ``added``."""
    cut = np.array_split(np.asarray(vector, dtype=kind), n)
    return pd.DataFrame({"part": part, "block": range(n), "data": [c.tobytes() for c in cut]})


def added(parts: DataFrame, fan: int = 256, kind: type = np.float64) -> np.ndarray:
    """The sum of the tasks' vectors, in a tree: first over ``fan`` groups of tasks, then over the groups.

    The vectors' length must not grow with the data; only their sum reaches the driver. ``kind`` is the number type of ``blocks``.
    """
    first = parts.withColumn("part", F.col("part") % fan).groupBy("part", "block").applyInPandas(_adding(kind), PARTS)
    last = first.withColumn("part", F.lit(0)).groupBy("part", "block").applyInPandas(_adding(kind), PARTS)
    rows = sorted(last.collect(), key=lambda r: r["block"])
    return np.concatenate([np.frombuffer(r["data"], dtype=kind) for r in rows]) if rows else np.zeros(0, dtype=kind)


def most_frequent(counts: DataFrame, word: str, n: str, k: int) -> list:
    """The ``k`` rows of a written count table with the largest ``n``, ties by ``word``, the largest first.

    Counts are first tallied by size (64 steps a doubling, a few thousand rows), which tells above which size about ``k`` rows lie; so the
    sort that ends at the driver sees those alone and not ``k`` rows of every task.
    """
    size = F.floor(F.log2(F.col(n)) * 64).cast("int")
    steps = sorted(((r["s"], r["m"]) for r in counts.groupBy(size.alias("s")).agg(F.count("*").alias("m")).collect()), reverse=True)
    total, least = 0, None
    for s, m in steps:
        total, least = total + m, s
        if total >= k:
            break
    if least is None or k <= 0:
        return []
    top = counts.where(size >= least)
    if total > 4 * k:  # very many of one size: put in order by ranges, so that k rows are sent, whatever the number of tasks
        top = global_order(top, [F.col(n).desc(), F.col(word)], "__place").where(F.col("__place") <= k)
    return sorted(top.collect(), key=lambda r: (-r[n], bytes(r[word])))[:k]
