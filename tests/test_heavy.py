"""Joins with a heavy key, and ratings in sequence."""

from __future__ import annotations

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from cohortspark.operators import dyads, relational


@pytest.fixture
def half_null(spark):
    left = spark.range(0, 8000, 1, 4).select(
        "id", F.when(F.col("id") % 2 == 1, F.col("id") % 50).alias("k"), (F.col("id") % 7).alias("v")
    )
    right = spark.createDataFrame([(None, "none"), (None, "again"), (1, "one"), (3, "three"), (99, "lone")], "k bigint, w string")
    return left, right


@pytest.mark.parametrize("how", ["inner", "left", "left_semi", "left_anti", "full"])
def test_heavy_join_returns_the_natural_join(half_null, rows, how):
    left, right = half_null
    got = relational.heavy_join(left, right, how, "k", limit=300)
    want = relational.natural_join(left, right, how, "k")
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got, *want.columns) == rows(want, *want.columns)


def test_no_task_gets_the_heavy_key(spark, half_null):
    """Half of all rows have no key; plainly joined they meet in one partition."""
    left, right = half_null
    before = {n: spark.conf.get(n) for n in ("spark.sql.adaptive.enabled", "spark.sql.autoBroadcastJoinThreshold", "spark.sql.shuffle.partitions")}
    try:
        spark.conf.set("spark.sql.adaptive.enabled", "false")
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        spark.conf.set("spark.sql.shuffle.partitions", "16")
        few = right.dropDuplicates(["k"])

        def most(df):
            return df.groupBy(F.spark_partition_id().alias("p")).count().agg(F.max("count")).first()[0]

        assert most(relational.natural_join(left, few, "left", "k")) >= 4000
        assert most(relational.heavy_join(left, few, "left", "k", limit=200)) < 1600
    finally:
        for name, value in before.items():
            spark.conf.set(name, value)


def test_no_heavy_key_and_empty_sides(half_null, rows):
    left, right = half_null
    assert rows(relational.heavy_join(left, right, "inner", "k")) == rows(relational.natural_join(left, right, "inner", "k"))
    assert relational.heavy_join(left.limit(0), right, "left", "k").count() == 0
    assert relational.heavy_join(left, right.limit(0), "left", "k", limit=100).count() == 8000


def elo(sequence, k=100.0, start=1000.0):
    now = {}
    for a, b in sequence:
        x, y = now.get(a, start), now.get(b, start)
        move = 0 if a == b else k * (1 - 1 / (1 + 10 ** ((y - x) / 400)))
        now[a], now[b] = x + move, (y if a != b else x) - move
    return now


def test_layers():
    one, two = np.array([0, 2, 0, 1, 5, 0]), np.array([1, 3, 2, 3, 6, 5])
    assert dyads.dependency_layers(one, two).tolist() == [1, 1, 2, 2, 1, 3]


@pytest.mark.parametrize("block", [1, 7, 1000])
def test_sequential_ratings(frame, block):
    """Row by row, whatever the blocks; contests of one day in their own order, a group without a name as a group."""
    rng = random.Random(block)
    contests = []
    for group, n in (("a", 90), ("b", 11), (None, 5)):
        contests += [(group, i + 1, f"p{rng.randrange(9)}", f"p{rng.randrange(9)}") for i in range(n)]
    contests.append(("b", 12, None, "p1"))
    shuffled = contests[:]
    rng.shuffle(shuffled)
    df = frame("g string, n int, w string, l string", shuffled)
    got = {(r.g, r.player): r.rating for r in dyads.sequential_ratings(df, "g", "w", "l", "n", block=block).collect()}
    want = {}
    for group in ("a", "b", None):
        sequence = [(w, x) for g, _, w, x in contests if g == group and w is not None]
        want |= {(group, p): r for p, r in elo(sequence).items()}
    assert got.keys() == want.keys()
    assert all(abs(got[p] - want[p]) < 1e-8 for p in want)


def test_sequential_ratings_of_nothing(frame):
    df = frame("g string, n int, w bigint, l bigint", [])
    out = dyads.sequential_ratings(df, "g", "w", "l", "n")
    assert out.columns == ["g", "player", "wins", "losses", "rating"] and out.count() == 0


@pytest.mark.parametrize("held_rows", [1, 30, 100_000])
def test_small_blocks_share_a_step(frame, held_rows, monkeypatch):
    """The number of written steps follows the rows a step may hold, not the block; the ratings stay those of the sequence."""
    rng = random.Random(held_rows)
    contests = [("a", i + 1, f"p{rng.randrange(9)}", f"p{rng.randrange(9)}") for i in range(90)]
    written = []
    real = dyads.staged
    monkeypatch.setattr(dyads, "staged", lambda df, by=(): written.append(1) or real(df, by))
    df = frame("g string, n int, w string, l string", contests)
    more = {} if held_rows == 100_000 else {"held_rows": held_rows}
    got = {r.player: r.rating for r in dyads.sequential_ratings(df, "g", "w", "l", "n", block=7, **more).collect()}
    # the contests, the first ratings, and one table a step
    assert len(written) == 2 + {1: 13, 30: 4, 100_000: 1}[held_rows]
    want = elo([(w, x) for _, _, w, x in contests])
    assert got.keys() == want.keys() and all(abs(got[p] - want[p]) < 1e-8 for p in want)
