"""Centroid clustering on exact integers with a persistent, incrementally updated matrix of dot products.

Every vector keeps its squared length and its dot product with each centroid. A round moves centroids; the products are then brought up
to date from the components that changed alone (``dots[c] += change[c, j] * vector[j]`` over nonzero changes), the distance to a centroid
is ``|v|^2 - 2 dots[c] + |c|^2``, and the nearest one is read from that row. Nothing is recomputed from scratch, and all of it is exact.

On Spark: the state (vector, squared length, products, cluster) is a written table, one per round, so a lost executor costs tasks of
one round; the table before it is deleted once its successor is there. Sums per cluster are added inside each task with numpy, so a
cluster that holds most rows shuffles one row per task like any other. The driver holds the centroids only (``k`` times the dimension).

Defined results: a vector that is null or empty, of another length, or holds null or non-finite components takes no part; repeated rows
are vectors of their own and come back as often; equal hashes of the start (repeated ids) are ordered by the components; a null id is
hashed as empty text and comes back; fewer vectors than ``k`` start fewer centroids; an empty table gives no rows; other columns are
ignored. A component beyond 2^27 after scaling is an error, since distances would leave 64 bits.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortspark.llm.topk import scaled, whole_vector
from cohortspark.session import discard, last_staged, staged

#: scaled components up to this size keep squared distances in 64 bits
LARGEST = 1 << 27


@dataclass(frozen=True)
class Settings:
    k: int = 8
    dimension: int = 64
    rounds: int = 10
    scale: float = 1024.0
    salt: str = "3:"
    #: rows of one numpy step
    rows: int = field(default=16_384)


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    values = column.flatten().to_numpy(zero_copy_only=False).astype(np.int64, copy=False)
    return values.reshape(len(column), width)


def changes(old: np.ndarray, new: np.ndarray) -> list[tuple[int, np.ndarray, np.ndarray]]:
    """(centroid, components that change, by how much) of every centroid that moves."""
    moved = new - old
    return [(c, at, moved[c, at]) for c in range(len(moved)) if len(at := np.flatnonzero(moved[c]))]


def update(dots: np.ndarray, vectors: np.ndarray, moved: list[tuple[int, np.ndarray, np.ndarray]]) -> np.ndarray:
    """The products after the centroids moved, from the changed components alone."""
    dots = dots.copy()
    for c, at, by in moved:
        dots[:, c] += vectors[:, at] @ by
    return dots


def nearest(square: np.ndarray, dots: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(number of the nearest centroid, squared distance); ties go to the smaller number."""
    far = square[:, None] - 2 * dots + (centroids * centroids).sum(axis=1)[None, :]
    cluster = far.argmin(axis=1)
    return cluster, far[np.arange(len(far)), cluster]


STATE = "id bigint, vector array<int>, square bigint, dots array<bigint>, cluster int, distance bigint"


def _lists(matrix: np.ndarray, kind: pa.DataType) -> pa.Array:
    n, width = matrix.shape
    return pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * width), pa.array(matrix.ravel(), kind))


def _assigned(moved: list, centroids: np.ndarray, fresh: bool, s: Settings):
    """State rows brought to these centroids; ``fresh`` rows hold only (id, vector) and start from products of zero."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for a in range(0, whole.num_rows, s.rows):
                batch = whole.slice(a, s.rows)
                vectors = _matrix(batch.column(1), s.dimension)
                if fresh:
                    square, dots = (vectors * vectors).sum(axis=1), np.zeros((len(vectors), len(centroids)), dtype=np.int64)
                else:
                    square, dots = batch.column(2).to_numpy(zero_copy_only=False), _matrix(batch.column(3), len(centroids))
                dots = update(dots, vectors, moved)
                cluster, distance = nearest(square, dots, centroids)
                columns = [
                    batch.column(0),
                    _lists(vectors, pa.int32()),
                    pa.array(square, pa.int64()),
                    _lists(dots, pa.int64()),
                    pa.array(cluster, pa.int32()),
                    pa.array(distance, pa.int64()),
                ]
                yield pa.RecordBatch.from_arrays(columns, names=["id", "vector", "square", "dots", "cluster", "distance"])

    return run


def _summed(k: int, s: Settings):
    """Per task and cluster the componentwise sums, the count and the summed distance, as exact integers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, count, inertia = np.zeros((k, s.dimension), dtype=np.int64), np.zeros(k, dtype=np.int64), [0] * k
        for batch in batches:
            vectors, cluster = _matrix(batch.column(0), s.dimension), batch.column(1).to_numpy(zero_copy_only=False)
            distance = batch.column(2).to_numpy(zero_copy_only=False)
            for c in np.unique(cluster):
                own = cluster == c
                total[c] += vectors[own].sum(axis=0)
                count[c] += int(own.sum())
                inertia[c] += sum(int(x) for x in np.add.reduceat(distance[own], range(0, int(own.sum()), 1024)))
        some = np.flatnonzero(count)
        yield pa.RecordBatch.from_arrays(
            [
                pa.array(some, pa.int32()),
                _lists(total[some], pa.int64()),
                pa.array(count[some], pa.int64()),
                pa.array([str(inertia[c]) for c in some], pa.string()),
            ],
            names=["cluster", "total", "n", "inertia"],
        )

    return run


def _totals(state: DataFrame, k: int, s: Settings) -> tuple[dict[int, list[int]], dict[int, int], dict[int, int]]:
    """Per cluster: exact sums by component, count, and inertia; added over the tasks by Spark, k rows reach the driver."""
    parts = state.select("vector", "cluster", "distance").mapInArrow(
        _summed(k, s), "cluster int, total array<bigint>, n bigint, inertia string"
    )
    wide = [F.sum(F.col("total")[j].cast("decimal(38,0)")).alias(f"c{j}") for j in range(s.dimension)]
    rows = parts.groupBy("cluster").agg(
        F.sum("n").alias("n"), F.sum(F.col("inertia").cast("decimal(38,0)")).alias("inertia"), F.array(*wide).alias("total")
    ).collect()
    return (
        {r["cluster"]: [int(x) for x in r["total"]] for r in rows},
        {r["cluster"]: int(r["n"]) for r in rows},
        {r["cluster"]: int(r["inertia"]) for r in rows},
    )


def vectors(rows: DataFrame, key: str, vector: str, s: Settings = Settings()) -> DataFrame:
    """(id, vector) of the rows that take part, components scaled and floored; a component out of range is an error."""
    sized = rows.where(whole_vector(vector) & (F.size(f"`{vector}`") == s.dimension))
    large = F.raise_error(F.lit(f"a scaled component is beyond {LARGEST}")).cast("int")
    whole = F.transform(scaled(vector, s.scale), lambda v: F.when(F.abs(v) <= LARGEST, v.cast("int")).otherwise(large))
    return sized.select(F.col(f"`{key}`").cast("bigint").alias("id"), whole.alias("vector"))


def start(rows: DataFrame, s: Settings = Settings()) -> np.ndarray:
    """The vectors with the smallest hashes of salt and id, in hash order."""
    digest = F.sha2(F.concat(F.lit(s.salt), F.coalesce(F.col("id").cast("string"), F.lit(""))), 256)
    first = rows.select(digest.alias("h"), "vector").orderBy("h", "vector").limit(s.k).collect()
    return np.array([r["vector"] for r in first], dtype=np.int64).reshape(-1, s.dimension)


def digest(centroid: np.ndarray) -> str:
    return hashlib.sha256(",".join(str(int(x)) for x in centroid).encode()).hexdigest()


def cluster(rows: DataFrame, key: str, vector: str, s: Settings = Settings()) -> DataFrame:
    """(id, vector, cluster, distance, cluster_inertia, inertia, centroid, centroid_sha256), one row per vector that takes part."""
    spark = rows.sparkSession
    own = staged(vectors(rows, key, vector, s))
    own_path = last_staged()
    now = start(own, s)
    made = "id bigint, vector array<int>, cluster int, distance bigint, cluster_inertia bigint, inertia bigint, centroid array<bigint>, centroid_sha256 string"
    if not len(now):
        return spark.createDataFrame([], made)
    state = staged(own.mapInArrow(_assigned(changes(np.zeros_like(now), now), now, True, s), STATE))
    discard(spark, own_path)
    for _ in range(s.rounds):
        path = last_staged()
        total, n, _ = _totals(state, len(now), s)
        new = now.copy()
        for c, sums in total.items():
            new[c] = [x // n[c] for x in sums]  # exact, downwards
        moved = changes(now, new)
        now = new
        if not moved:  # every later round would repeat this one
            break
        state = staged(state.mapInArrow(_assigned(moved, now, False, s), STATE))
        discard(spark, path)
    _, _, inertia = _totals(state, len(now), s)
    centroids = spark.createDataFrame(
        [(c, inertia.get(c, 0), sum(inertia.values()), [int(x) for x in now[c]], digest(now[c])) for c in range(len(now))],
        "cluster int, cluster_inertia bigint, inertia bigint, centroid array<bigint>, centroid_sha256 string",
    )
    return state.select("id", "vector", "cluster", "distance").join(F.broadcast(centroids), "cluster")
