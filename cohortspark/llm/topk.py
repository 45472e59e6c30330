"""Exact top-k search by inner product: tiled matrix products, partial selection per tile, tree merging.

Rows are dealt by a hash of their id into shards of about ``shard`` rows, queries into tiles of about ``tile``
rows, each packed into one binary matrix. Every tile meets every shard once (an equi-join on the shard number,
as a stated query set is searched in blocks); a task multiplies, keeps the best k per query and passes only those on.
Lists of one query are merged in groups of ``FAN`` shards, then across the groups, so no task sees more than
``FAN * k`` entries of a query at once however many shards there are (more levels would be added beyond FAN^2 shards).

Scores are exact integers: products run in doubles while they stay below 2^53, else in Python integers, and results
beyond 64 bits are an error. Ties go to the smaller id.

Defined results: null or empty vectors, vectors holding null or non-finite components, and rows with a null id take no part;
vectors of different lengths are compared over their common components (the rest counts as 0); repeated rows (same id and
vector) count once, and if an id has several vectors the smallest is its query; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

FAN = 64


def whole_vector(vector: str) -> Column:
    """True where a vector is there and all its components are finite numbers."""
    x = F.col(f"`{vector}`")
    return F.coalesce(
        F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))) & (F.size(x) > 0), F.lit(False)
    )


def scaled(vector: str, scale: float = 64.0) -> Column:
    """floor(scale * x) of each component, taken as a double."""
    return F.transform(F.col(f"`{vector}`"), lambda v: F.floor(F.lit(scale) * v.cast("double")).cast("bigint"))


def _packed(first_only: bool):
    """A group of rows as one row: ids and matrix bytes, in id order, without repeated rows."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        width = max(len(v) for v in rows["vector"])
        matrix = np.zeros((len(rows), width), dtype=np.int64)
        for i, v in enumerate(rows["vector"]):
            matrix[i, : len(v)] = v
        whole = np.unique(np.column_stack([rows["id"].to_numpy(dtype=np.int64), matrix]), axis=0)
        if first_only:
            whole = whole[np.unique(whole[:, 0], return_index=True)[1]]
        return pd.DataFrame(
            {
                "part": [int(rows["part"].iloc[0])],
                "ids": [np.ascontiguousarray(whole[:, 0]).tobytes()],
                "matrix": [np.ascontiguousarray(whole[:, 1:]).tobytes()],
            }
        )

    return run


def _matrix(ids: bytes, data: bytes) -> tuple[np.ndarray, np.ndarray]:
    keys = np.frombuffer(ids, dtype=np.int64)
    return keys, np.frombuffer(data, dtype=np.int64).reshape(len(keys), -1)


def _products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    d = min(a.shape[1], b.shape[1])
    a, b = a[:, :d], b[:, :d]
    most = float(np.abs(a.astype(float)).max(initial=0)) * float(np.abs(b.astype(float)).max(initial=0)) * d
    if most < 2**53:
        return (a.astype(float) @ b.astype(float).T).astype(np.int64)
    exact = a.astype(object) @ b.astype(object).T
    return exact.astype(np.int64)  # raises beyond 64 bits


def best(queries: np.ndarray, q: np.ndarray, ids: np.ndarray, c: np.ndarray, k: int) -> pd.DataFrame:
    """The k best of ``ids`` (ascending) per query, ties to the smaller id, without the query's own id."""
    scores = _products(q, c)
    n = len(ids)
    own = queries[:, None] == ids[None, :]
    # unique keys: the score, then the earlier position; so the partial selection is exact under ties
    if np.abs(scores).max(initial=0) < 2**62 // (n + 1):
        keys = scores * n + (n - 1 - np.arange(n))[None, :]
        keys[own] = np.iinfo(np.int64).min
        take = min(k + 1, n)
        at = np.argpartition(keys, n - take, axis=1)[:, n - take :]
    else:
        order = [sorted(range(n), key=lambda j, row=row: (-int(row[j]), j)) for row in scores]
        at = np.array(order, dtype=np.int64).reshape(scores.shape)
    rows = np.repeat(np.arange(len(queries)), at.shape[1])
    at = at.ravel()
    out = pd.DataFrame({"query_id": queries[rows], "vec_id": ids[at], "score": scores[rows, at]})
    out = out[~own[rows, at]].drop_duplicates()
    out = out.sort_values(["query_id", "score", "vec_id"], ascending=[True, False, True])
    return out[out.groupby("query_id").cumcount() < k]


def _searched(k: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pairs in batches:
            for row in pairs.itertuples(index=False):
                queries, q = _matrix(row.q_ids, row.q_matrix)
                ids, c = _matrix(row.ids, row.matrix)
                found = best(queries, q, ids, c, k)
                yield found.assign(part=row.part)

    return run


def _merged(lists: DataFrame, by: list[str], k: int) -> DataFrame:
    ranked = F.slice(F.sort_array(F.collect_set(F.struct((-F.col("score")).alias("minus"), "vec_id"))), 1, k)
    return lists.groupBy(*by).agg(ranked.alias("best"))


def top_k(
    rows: DataFrame, key: str, vector: str, queries: Column, k: int = 20, shard: int = 4096, tile: int = 2048
) -> DataFrame:
    """(query_id, rank, vec_id, score) of every row for which ``queries`` holds, against all other rows.

    ``vector`` must be an array of bigint. Counts the rows first, to size the grid.
    """
    some = rows.where(F.col(f"`{key}`").isNotNull() & (F.size(f"`{vector}`") > 0)).select(
        F.col(f"`{key}`").cast("bigint").alias("id"), F.col(f"`{vector}`").alias("vector"), F.coalesce(queries, F.lit(False)).alias("asks")
    )
    n, asking = some.agg(F.count("*"), F.count(F.when(F.col("asks"), 1))).first()
    shards, tiles = max(1, -(-n // shard)), max(1, -(-asking // tile))

    def dealt(frame: DataFrame, parts: int, first_only: bool) -> DataFrame:
        part = F.pmod(F.xxhash64("id"), F.lit(parts)).alias("part")
        return frame.select("id", "vector", part).groupBy("part").applyInPandas(
            _packed(first_only), "part bigint, ids binary, matrix binary"
        )

    asked = dealt(some.where("asks"), tiles, True).select(
        F.col("ids").alias("q_ids"),
        F.col("matrix").alias("q_matrix"),
        F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(shards - 1).cast("bigint"))).alias("part"),
    )
    pairs = asked.join(dealt(some, shards, False).hint("shuffle_hash"), "part")
    found = pairs.mapInPandas(_searched(k), "query_id bigint, vec_id bigint, score bigint, part bigint")
    while shards > 1:
        found = found.withColumn("part", F.floor(F.col("part") / FAN))
        lists = _merged(found, ["query_id", "part"], k)
        found = lists.select("query_id", "part", F.inline("best")).select("query_id", "part", "vec_id", (-F.col("minus")).alias("score"))
        shards = -(-shards // FAN)
    last = _merged(found, ["query_id"], k)
    return last.select("query_id", F.posexplode("best").alias("at", "x")).select(
        "query_id", (F.col("at") + 1).alias("rank"), F.col("x.vec_id").alias("vec_id"), (-F.col("x.minus")).alias("score")
    )
