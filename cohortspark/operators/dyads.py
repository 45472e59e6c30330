"""Dyadic interactions: valid pairs, winners and losers, and ratings from their sequence."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import timedelta

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortspark.operators.intervals import interval_join
from cohortspark.operators.ordering import number_rows
from cohortspark.operators.relational import natural_join
from cohortspark.session import discard, last_staged, staged


def valid_dyads(
    dyads: DataFrame,
    intervals: DataFrame,
    key: str,
    partner: str,
    day: str,
    group: str,
    study: str,
    exclude_study: str,
    start: str,
    end: str,
) -> DataFrame:
    """Distinct dyads outside one study whose partner belonged to the session's group that day.

    Dyads without a study name are dropped along with the excluded study.
    """
    kept = dyads.filter(F.col(study) != exclude_study)
    spans = intervals.select(F.col(key).alias(partner), group, start, end)
    found = interval_join(kept, spans, [partner, group], day, start, end)
    return found.drop(start, end).distinct()


def win_loss(
    dyads: DataFrame,
    which: Column,
    outcome: str,
    actor_wins,
    partner_wins,
    actor: str,
    partner: str,
    columns: Sequence[str],
    group: str,
    order: Sequence[str],
) -> DataFrame:
    """Winner and loser of each contest in one scan, numbered per group; other outcomes are dropped.

    ``order`` begins with a day and ends with a unique id, so that the number is the same in every run;
    whoever needs rows in order sorts by it.
    Submissive calls: received -> actor wins, given -> partner wins. Frontal passes: over -> actor
    wins, under -> partner wins.
    """
    won = F.col(outcome) == F.lit(actor_wins)
    contests = dyads.filter(which & F.col(outcome).isin(actor_wins, partner_wins))
    out = contests.select(
        *columns,
        F.when(won, F.col(actor)).otherwise(F.col(partner)).alias("winner"),
        F.when(won, F.col(partner)).otherwise(F.col(actor)).alias("loser"),
    )
    return number_rows(out, [group], order, "contest_no")


def periodic_ratings(
    contests: DataFrame,
    group: str,
    winner: str,
    loser: str,
    day: str,
    period_days: int = 1,
    k: float = 100.0,
    start: float = 1000.0,
    scale: float = 400.0,
    most: float = 200.0,
) -> DataFrame:
    """Ratings per group with the odds of Elo's system, updated once per rating period.

    All contests of a period are rated against the ratings at its start, so a period is a join and an
    aggregation instead of a walk through a group's rows; a period with one contest per player is the
    sequential rating. A player's move in a period is bounded by ``most``, so that a busy pair does not run
    away. The loop runs over calendar periods; its length does not depend on the number of rows. Contests
    are written by day and each is read once; only the latest ratings are kept.
    """
    spark = contests.sparkSession
    results = staged(
        contests.groupBy(
            group, F.col(day).alias("_day"), F.col(winner).alias("_w"), F.col(loser).alias("_l")
        ).agg(F.count(F.lit(1)).alias("_n")),
        by=["_day"],
    )
    span = results.agg(F.min("_day").alias("a"), F.max("_day").alias("b")).first()
    sides = F.array(
        F.struct(F.col("_w").alias("player"), F.col("_n").alias("won"), F.lit(0).alias("lost")),
        F.struct(F.col("_l").alias("player"), F.lit(0).alias("won"), F.col("_n").alias("lost")),
    )
    tally = (
        results.select(group, F.inline(sides))
        .groupBy(group, "player")
        .agg(F.sum("won").cast("bigint").alias("wins"), F.sum("lost").cast("bigint").alias("losses"))
    )
    ratings = staged(tally.withColumn("rating", F.lit(float(start))))
    kept = last_staged()
    if span["a"] is None:
        return ratings
    for offset in range(0, (span["b"] - span["a"]).days + 1, period_days):
        first = span["a"] + timedelta(days=offset)
        now = ratings.select(group, "player", "rating")
        round_ = (
            results.filter(F.col("_day").between(first, first + timedelta(days=period_days - 1)))
            .join(now.withColumnsRenamed({"player": "_w", "rating": "_rw"}), [group, "_w"])
            .join(now.withColumnsRenamed({"player": "_l", "rating": "_rl"}), [group, "_l"])
        )
        expected = 1 / (1 + F.pow(F.lit(10.0), (F.col("_rl") - F.col("_rw")) / scale))
        gain = F.lit(float(k)) * F.col("_n") * (1 - expected)
        moves = F.array(
            F.struct(F.col("_w").alias("player"), gain.alias("_d")),
            F.struct(F.col("_l").alias("player"), (-gain).alias("_d")),
        )
        change = round_.select(group, F.inline(moves)).groupBy(group, "player").agg(F.sum("_d").alias("_d"))
        move = F.least(F.lit(most), F.greatest(F.lit(-most), F.coalesce(F.col("_d"), F.lit(0.0))))
        ratings = staged(
            ratings.join(change, [group, "player"], "left")
            .withColumn("rating", F.col("rating") + move)
            .drop("_d")
        )
        discard(spark, kept)
        kept = last_staged()
    return ratings


def dependency_layers(one: np.ndarray, two: np.ndarray) -> np.ndarray:
    """Per contest of a sequence (players by number): one more than the latest earlier contest of either player."""
    last: dict[int, int] = {}
    out = np.empty(len(one), dtype=np.int64)
    for i, (a, b) in enumerate(zip(one.tolist(), two.tolist(), strict=True)):
        out[i] = last[a] = last[b] = max(last.get(a, 0), last.get(b, 0)) + 1
    return out


def _rated(k: float, start: float, scale: float, block: int):
    """Ratings after a step's contests, block by block: those of one layer share no player, so a layer is one vector operation."""

    def run(contests: pd.DataFrame, known: pd.DataFrame) -> pd.DataFrame:
        contests = contests.sort_values("_n")
        sides = pd.concat([contests["_w"], contests["_l"]], ignore_index=True)
        number, players = pd.factorize(sides, use_na_sentinel=False)
        one, two = number[: len(contests)], number[len(contests) :]
        now = pd.Series(known["rating"].to_numpy(), index=pd.Index(known["player"].to_numpy(), dtype=players.dtype))
        rating = now.reindex(players).fillna(start).to_numpy(dtype=np.float64, copy=True)
        for first in range(0, len(contests), block):
            left, right = one[first : first + block], two[first : first + block]
            layer = dependency_layers(left, right)
            order = np.argsort(layer, kind="stable")
            for part in np.split(order, np.flatnonzero(np.diff(layer[order])) + 1):
                a, b = left[part], right[part]
                move = k * (1 - 1 / (1 + 10.0 ** ((rating[b] - rating[a]) / scale)))
                move[a == b] = 0  # nobody wins against themselves
                rating[a] += move
                rating[b] -= move
        group = contests["_g"].iloc[0] if len(contests) else None
        return pd.DataFrame({"_g": [group] * len(players), "player": players, "rating": rating})

    return run


def sequential_ratings(
    contests: DataFrame,
    group: str,
    winner: str,
    loser: str,
    number: str,
    k: float = 100.0,
    start: float = 1000.0,
    scale: float = 400.0,
    block: int = 100_000,
    held_rows: int = 100_000,
) -> DataFrame:
    """(group, player, wins, losses, rating): Elo's system, one contest after the other as ``number`` (from 1 per group) says.

    A contest depends on the latest earlier contests of its two players, so a group's sequence cannot be cut at will. It is walked in
    blocks of ``block`` contests per group, as many blocks in a step as hold ``held_rows`` contests (one at least): a step is one join of
    its contests with their players' ratings, all groups side by side, and a task holds one group's step, never a group. Inside a
    block contests fall into dependency layers; a layer's contests share no player and are rated together. Ratings are written after each
    step. The number of steps is the largest group's contests over the larger of ``block`` and ``held_rows``, so small blocks do not
    multiply Spark jobs. Contests without a winner or loser are left out.
    """
    spark = contests.sparkSession
    kinds = {f.name: f.dataType.simpleString() for f in contests.schema.fields}
    if kinds[winner] != kinds[loser]:
        raise ValueError("winner and loser must be of one type")
    whole = contests.filter(F.col(winner).isNotNull() & F.col(loser).isNotNull()).select(
        F.col(group).alias("_g"),
        F.col(number).cast("bigint").alias("_n"),
        F.col(winner).alias("_w"),
        F.col(loser).alias("_l"),
    )
    # whole blocks, so that the cuts inside a step are those of the blocks
    step = block * max(1, held_rows // block)
    held = staged(whole.withColumn("_b", F.floor((F.col("_n") - 1) / step)), by=["_b"])
    sides = F.array(
        F.struct(F.col("_w").alias("player"), F.lit(1).alias("won")), F.struct(F.col("_l").alias("player"), F.lit(0).alias("won"))
    )
    both = held.select("_g", "_b", F.inline(sides))
    tally = both.groupBy("_g", "player").agg(
        F.sum("won").cast("bigint").alias("wins"), F.sum(1 - F.col("won")).cast("bigint").alias("losses")
    )
    ratings = staged(tally.withColumn("rating", F.lit(float(start))))
    kept = last_staged()
    made = f"_g {kinds[group]}, player {kinds[winner]}, rating double"
    blocks = [r["_b"] for r in held.select("_b").distinct().orderBy("_b").collect()]
    for b in blocks:
        now = held.filter(F.col("_b") == b)
        players = both.filter(F.col("_b") == b).select("_g", "player").distinct()
        known = natural_join(ratings.select("_g", "player", "rating"), players, "left_semi", ["_g", "player"])
        new = now.groupBy("_g").cogroup(known.groupBy("_g")).applyInPandas(_rated(float(k), float(start), float(scale), block), made)
        ratings = staged(
            natural_join(ratings, new.withColumnRenamed("rating", "_new"), "left", ["_g", "player"])
            .withColumn("rating", F.coalesce("_new", "rating"))
            .drop("_new")
        )
        discard(spark, kept)
        kept = last_staged()
    return ratings.withColumnRenamed("_g", group)
