"""Multinomial regression by Newton steps, and values of neighbouring rows in hot groups."""

from __future__ import annotations

import math

import numpy as np
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from cohortspark.operators import stats
from cohortspark.operators.ordering import id_slice, shifted


def test_two_classes_equal_a_plain_newton(spark):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(400, 2)) * [1, 100] + [0, 5000]
    y = (rng.random(400) < 1 / (1 + np.exp(-(x[:, 0] - (x[:, 1] - 5000) / 80)))).astype(int)
    df = spark.createDataFrame([(float(a), float(b), int(k)) for (a, b), k in zip(x, y)], "a double, b double, k int")
    fit = stats.multinomial_fit(df, ["a", "b"], "k")
    design, beta = np.column_stack([np.ones(400), x[:, 0], (x[:, 1] - 5000) / 100]), np.zeros(3)
    for _ in range(30):
        p = 1 / (1 + np.exp(-design @ beta))
        info = design.T @ (design * (p * (1 - p))[:, None])
        beta = beta + np.linalg.solve(info, design.T @ (y - p))
    errors = np.sqrt(np.diag(np.linalg.inv(info)))
    assert fit.converged
    assert np.allclose(fit.beta[1:, 0], beta[1:] / [1, 100], rtol=1e-7)
    assert fit.beta[0, 0] == pytest.approx(beta[0] - 50 * beta[2], rel=1e-7)
    got = {r["term"]: r for r in fit.table(spark).collect()}
    assert got["a"]["std_error"] == pytest.approx(errors[1], rel=1e-6) and got["a"]["class"] == "1"
    assert got["b"]["z"] == pytest.approx(beta[2] / errors[2], rel=1e-6)


def test_missing_values_constant_columns_and_separation(frame):
    rows = [("u", 1.0, 7.0), ("u", 2.0, 7.0), ("v", 2.0, 7.0), ("v", 3.0, 7.0), ("w", 1.5, 7.0), ("w", 2.5, 7.0)]
    df = frame("k string, a double, c double", [*rows, ("u", None, 7.0), (None, 9.0, 7.0), ("x", float("nan"), 7.0)])
    fit = stats.multinomial_fit(df, ["a", "c"], "k")
    assert fit.classes == ["u", "v", "w"] and fit.converged and np.allclose(fit.beta[2], 0)
    got = fit.probabilities(df).collect()
    assert [r["p"] is None for r in got] == [False] * 6 + [True, False, True]
    assert all(math.isclose(sum(r["p"]), 1) for r in got if r["p"])
    # probabilities add up to the class sizes
    assert np.allclose(np.sum([r["p"] for r in got[:6]], axis=0), 2)
    split = stats.multinomial_fit(frame("k int, a double", [(0, 1.0), (0, 2.0), (1, 3.0), (1, 4.0)]), ["a"], "k", max_iter=8)
    assert not split.converged and np.isfinite(split.beta).all()
    one = stats.multinomial_fit(frame("k int, a double", [(4, 1.0), (4, 2.0)]), ["a"], "k")
    assert one.classes == [4] and one.converged
    assert [r["p"] for r in one.probabilities(frame("a double", [(1.0,)])).collect()] == [[1.0]]
    with pytest.raises(ValueError, match="no complete rows"):
        stats.multinomial_fit(df.limit(0), ["a"], "k")


@pytest.mark.parametrize("how", ["lead", "lag"])
def test_neighbours_equal_a_plain_window(spark, how):
    """A group of a third of all rows, sparse ids, values that are missing, over many buckets."""
    ids = spark.range(3000).select(
        (F.col("id") * 977 % 100_003).alias("ref"),
        F.when(F.col("id") % 3 == 0, F.lit("hot")).when(F.col("id") % 7 > 0, F.concat(F.lit("g"), F.col("id") % 40)).alias("g"),
        F.when(F.col("id") % 5 > 0, F.col("id")).alias("v"),
    )
    width = id_slice(ids, "ref", 50)
    got = shifted(ids, ["g"], ["ref"], {"v": "near", "ref": "near_ref"}, how, width)
    w, move = Window.partitionBy("g").orderBy("ref"), {"lead": F.lead, "lag": F.lag}[how]
    want = ids.select("*", move("v").over(w).alias("near"), move("ref").over(w).alias("near_ref"))
    assert got.columns == want.columns
    assert got.count() == 3000 and got.exceptAll(want).count() == 0 and want.exceptAll(got).count() == 0
    # no window sorts more than a bucket of the hot group
    most = ids.groupBy("g", F.floor(F.col("ref") / width)).count().agg(F.max("count")).first()[0]
    assert most < 100 < 1000


def test_neighbours_of_missing_days(frame, rows):
    df = frame("g int, day date, id int", [(1, "2020-01-02", 1), (1, None, 2), (1, "2020-01-01", 3), (1, None, 4), (None, None, 5)])
    got = shifted(df, ["g"], ["day", "id"], {"id": "next"})
    assert rows(got, "id", "next") == [(1, 2), (2, 4), (3, 1), (4, None), (5, None)]
    assert shifted(df.limit(0), ["g"], ["day", "id"], {"id": "next"}).count() == 0
    with pytest.raises(ValueError, match="lead or lag"):
        shifted(df, ["g"], ["day"], {"id": "x"}, "next")
