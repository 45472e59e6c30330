"""Best-fit packing by exact-complement hashing.

Only the histogram of piece lengths (at most ``capacity`` numbers) decides which lengths share a sequence, so
the plan does not grow with the data: sums of one, two and three available lengths are indexed, combinations
that exactly fill the gap left by a longer length are consumed as often as their counts allow, and what
remains is placed best-fit, longest first, again by counts. A plan is a list of segments: the pieces of one
length with ranks in a range go to consecutive sequences at one offset. Pieces are ranked inside their length by
a count per (length, hash bucket) and a number inside the bucket, so no length is sorted in one task.

Defined results: a piece of length 0 gets a sequence of its own kind like any other length (it takes no
place); pieces longer than the capacity are an error; repeated pieces are each placed; an empty table gives no rows.
"""

from __future__ import annotations

import bisect
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T


class _Counts:
    """Available pieces per length and the next rank to hand out; records segments."""

    def __init__(self, histogram: np.ndarray):
        self.left = histogram.astype(np.int64).copy()
        self.rank = np.zeros_like(self.left)
        self.bins = 0
        self.segments: list[tuple[int, int, int, int, int]] = []

    def put(self, length: int, times: int, first_bin: int, offset: int) -> None:
        self.segments.append((length, int(self.rank[length]), times, first_bin, offset))
        self.rank[length] += times
        self.left[length] -= times

    def together(self, lengths: list[int]) -> int:
        """Consume a combination as often as its counts allow; returns how often."""
        kinds, needs = np.unique(lengths, return_counts=True)
        times = int((self.left[kinds] // needs).min())
        if times:
            offset = 0
            for length in lengths:
                self.put(length, times, self.bins, offset)
                offset += length
            self.bins += times
        return times


def _pair(left: np.ndarray, total: int, most: int) -> tuple[int, int] | None:
    """Two available lengths that sum to ``total``, the longer as long as can be, at most ``most``."""
    high = np.arange(min(total - 1, most), (total + 1) // 2 - 1, -1)
    if not len(high):
        return None
    ok = (left[high] > 0) & (left[total - high] > 0)
    if total % 2 == 0 and high[-1] == total // 2:
        ok[-1] = left[total // 2] > 1
    at = int(ok.argmax())
    return (int(high[at]), int(total - high[at])) if ok[at] else None


def _exact(counts: _Counts, capacity: int) -> None:
    left = counts.left
    if capacity < len(left) and left[capacity]:
        counts.together([capacity])
    for parts in (1, 2, 3):
        for a in range(capacity - 1, 0, -1):
            while left[a] > 0:
                gap, found = capacity - a, None
                left[a] -= 1  # its own place is taken
                if parts == 1:
                    found = [gap] if gap <= a and left[gap] > 0 else None
                elif parts == 2:
                    found = _pair(left, gap, a)
                else:
                    for b in range(min(gap - 2, a), (gap + 2) // 3 - 1, -1):
                        if left[b] > 0:
                            left[b] -= 1
                            rest = _pair(left, gap - b, b)
                            left[b] += 1
                            if rest:
                                found = [b, *rest]
                                break
                left[a] += 1
                if not found or not counts.together([a, *found]):
                    break


def _best_fit(counts: _Counts, capacity: int) -> None:
    """Longest first into the fullest open sequences that still fit; equal sequences are kept as ranges."""
    gaps: list[int] = []  # sorted gaps with open sequences
    open_: dict[int, list[tuple[int, int]]] = {}  # gap -> ranges (first, count)

    def add(gap: int, first: int, count: int) -> None:
        if gap not in open_:
            open_[gap] = []
            bisect.insort(gaps, gap)
        open_[gap].append((first, count))

    for length in range(len(counts.left) - 1, 0, -1):
        while counts.left[length] > 0:
            n = int(counts.left[length])
            at = bisect.bisect_left(gaps, length)
            if at < len(gaps):
                gap = gaps[at]
                first, count = open_[gap].pop()
                if not open_[gap]:
                    del open_[gap]
                    gaps.pop(at)
                times = min(n, count)
                counts.put(length, times, first, capacity - gap)
                if times < count:
                    add(gap, first + times, count - times)
                if gap > length:
                    add(gap - length, first, times)
            else:
                per = capacity // length  # several of a length share a new sequence
                times = n // per if n >= per else 1
                first = counts.bins
                counts.bins += times
                used = 0
                for _ in range(min(per, n)):
                    counts.put(length, times, first, used)
                    used += length
                if used < capacity:
                    add(capacity - used, first, times)


def plan(histogram: np.ndarray, capacity: int) -> list[tuple[int, int, int, int, int]]:
    """Segments (length, first rank, count, first sequence, offset) for pieces counted by length."""
    counts = _Counts(histogram)
    if len(histogram) > capacity + 1 and histogram[capacity + 1 :].any():
        raise ValueError("a piece is longer than the capacity")
    _exact(counts, capacity)
    _best_fit(counts, capacity)
    if counts.left[0]:
        counts.put(0, int(counts.left[0]), counts.bins, 0)
        counts.bins += int(counts.left[0])
    return counts.segments


def _placed(segments: np.ndarray):
    """Looks up a piece's segment by (length, rank): segments are sorted by both."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        starts = segments["key"]
        for pieces in batches:
            key = (pieces["__length"].to_numpy(dtype=np.int64) << 44) + pieces["__rank"].to_numpy(dtype=np.int64)
            hit = segments[np.searchsorted(starts, key, side="right") - 1]
            pieces["sequence_id"] = hit["bin"] + key - hit["key"]
            pieces["offset"] = hit["offset"]
            yield pieces.drop(columns=["__length", "__rank"])

    return run


def pack(pieces: DataFrame, length: str, order: list[str], capacity: int = 1024, per_bucket: int = 20_000) -> DataFrame:
    """The pieces with sequence_id and offset. ``order`` columns number equal lengths; ties go either way.

    ``pieces`` is read three times and should be a written table. A bucket holds about ``per_bucket`` pieces.
    """
    size = F.col(f"`{length}`")
    counted = {r[0]: r[1] for r in pieces.groupBy(size.cast("bigint")).count().collect()}
    histogram = np.zeros(max(capacity, *counted, 0) + 1, dtype=np.int64)
    for k, n in counted.items():
        histogram[k] = n
    made = sorted(plan(histogram, capacity))
    segments = np.zeros(len(made) + 1, dtype=[("key", "i8"), ("bin", "i8"), ("offset", "i8")])
    for i, (k, rank, _, first, offset) in enumerate(made):
        segments[i + 1] = ((k << 44) + rank, first, offset)
    segments[0]["key"] = -1
    buckets = max(1024, int(histogram.sum()) // per_bucket)
    bucketed = pieces.withColumn("__length", size.cast("bigint")).withColumn(
        "__bucket", F.pmod(F.xxhash64(*[F.col(f"`{c}`") for c in order]), F.lit(buckets))
    )
    before = Window.partitionBy("__length").orderBy("__bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = bucketed.groupBy("__length", "__bucket").count()
    offsets = offsets.select(
        "__length", "__bucket", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("__before")
    )
    inside = Window.partitionBy("__length", "__bucket").orderBy(*[F.col(f"`{c}`") for c in order])
    ranked = bucketed.withColumn("__number", F.row_number().over(inside))
    ranked = ranked.join(offsets, ["__length", "__bucket"])
    ranked = ranked.select(
        *[F.col(f"`{c}`") for c in pieces.columns if c not in ("sequence_id", "offset")],
        "__length",
        (F.col("__before") + F.col("__number") - 1).alias("__rank"),
    )
    fields = [f for f in ranked.schema.fields if not f.name.startswith("__")]
    schema = T.StructType([*fields, T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType())])
    return ranked.mapInPandas(_placed(segments), schema)


def _cut(end_id: int, capacity: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = batch.schema.get_field_index("ids")
            row, piece, start, length, data = [], [], [], [], []
            for i, ids in enumerate(batch.column(at)):
                own = ids.values.to_numpy(zero_copy_only=False) if ids.is_valid else ()
                own = np.append(own, end_id).astype("<u4")
                n = len(own)
                cuts = [0, *range(n % capacity or capacity, n, capacity)] if n > capacity else [0]
                for k, (a, b) in enumerate(zip(cuts, [*cuts[1:], n], strict=True)):
                    row.append(i)
                    piece.append(k)
                    start.append(a)
                    length.append(b - a)
                    data.append(own[a:b].tobytes())
            take = pa.array(row, pa.int64())
            kept = [(name, batch.column(j).take(take)) for j, name in enumerate(batch.schema.names) if j != at]
            made = [
                ("piece", pa.array(piece, pa.int32())),
                ("start", pa.array(start, pa.int64())),
                ("length", pa.array(length, pa.int64())),
                ("tokens", pa.array(data, pa.binary())),
            ]
            yield pa.RecordBatch.from_arrays([c for _, c in kept + made], names=[n for n, _ in kept + made])

    return run


def cut(encoded: DataFrame, end_id: int, capacity: int = 1024) -> DataFrame:
    """One row per piece (piece, start, length, tokens as little-endian unsigned 32-bit) of ``ids`` and an end id.

    A longer document is cut into pieces of the capacity; its first piece takes the remainder. Null ids are none.
    """
    made = T.StructType.fromDDL("piece int, start bigint, length bigint, tokens binary")
    kept = [f for f in encoded.schema.fields if f.name not in ("ids", *made.names)]
    rows = encoded.select(*[F.col(f"`{f.name}`") for f in kept], "ids")
    return rows.mapInArrow(_cut(end_id, capacity), T.StructType([*kept, *made.fields]))
