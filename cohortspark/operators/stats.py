"""Multivariate summaries of behaviour panels, on Spark ML where it has the method.

Only feature-by-feature matrices reach the driver; their size is the number of behaviours squared.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from functools import reduce
from itertools import combinations, combinations_with_replacement

import numpy as np
import pandas as pd
from pyspark.ml.classification import LogisticRegression, LogisticRegressionModel
from pyspark.ml.feature import PCA, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortspark.operators.relational import levels
from cohortspark.session import staged


def behaviour_correlation(wide: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Pearson correlation of every pair of columns, all in one aggregation, in long form."""
    pairs = list(combinations(columns, 2))
    row = wide.agg(*[F.corr(a, b).alias(f"_{i}") for i, (a, b) in enumerate(pairs)])
    cells = F.array(
        *[
            F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.col(f"_{i}").alias("r"))
            for i, (a, b) in enumerate(pairs)
        ]
    )
    return row.select(F.inline(cells))


def _complete(columns: Sequence[str]) -> Column:
    """No column is missing; models are fitted on such rows, other rows keep NULL results."""
    return reduce(
        lambda a, b: a & b, [F.col(c).isNotNull() & ~F.isnan(F.col(c).cast("double")) for c in columns]
    )


def _features(df: DataFrame, columns: Sequence[str], out: str = "_features") -> DataFrame:
    return VectorAssembler(inputCols=list(columns), outputCol=out, handleInvalid="keep").transform(df)


def principal_components(
    df: DataFrame, columns: Sequence[str], k: int, keep: Sequence[str] = ()
) -> DataFrame:
    """Scores of every row on the first ``k`` components, as columns ``pc1`` to ``pck``.

    Components are those of the complete rows; a row with a missing value has NULL scores.
    """
    rows, whole = _features(df, columns), _complete(columns)
    model = PCA(k=k, inputCol="_features", outputCol="_scores").fit(rows.filter(whole))
    scores = model.transform(rows).withColumn("_scores", F.when(whole, vector_to_array("_scores")))
    return scores.select(*keep, *[F.col("_scores")[i].alias(f"pc{i + 1}") for i in range(k)])


def multinomial(
    df: DataFrame, columns: Sequence[str], label: str, max_iter: int = 50
) -> LogisticRegressionModel:
    """Multinomial logistic regression of an integer label on the columns, fitted on complete rows."""
    rows = _features(df.filter(_complete([*columns, label])), columns)
    fit = LogisticRegression(
        family="multinomial", featuresCol="_features", labelCol=label, maxIter=max_iter
    )
    return fit.fit(rows.withColumn(label, F.col(label).cast("double")))


def predict(model: LogisticRegressionModel, df: DataFrame, columns: Sequence[str], keep: Sequence[str]) -> DataFrame:
    """The predicted class of every row, NULL where a column is missing."""
    out = model.transform(_features(df, columns))
    guess = F.when(_complete(columns), F.col(model.getPredictionCol()).cast("int"))
    return out.select(*keep, guess.alias("predicted"))


def linear_discriminants(
    df: DataFrame, columns: Sequence[str], label: str, k: int, keep: Sequence[str] = ()
) -> DataFrame:
    """Scores on the first ``k`` linear discriminants; NULL where a column is missing.

    Class sizes, means and cross products come from one aggregation; the driver solves the
    between/within problem, a matrix of the number of columns squared.
    """
    cols = list(columns)
    x = [F.col(c).cast("double") for c in cols]
    pairs = list(combinations_with_replacement(range(len(cols)), 2))
    stats = (
        df.filter(_complete(columns) & F.col(label).isNotNull())
        .groupBy(label)
        .agg(
            F.count(F.lit(1)).alias("n"),
            F.array(*[F.avg(c) for c in x]).alias("mean"),
            F.array(*[F.covar_pop(x[i], x[j]) for i, j in pairs]).alias("cov"),
        )
        .collect()
    )
    total = sum(r["n"] for r in stats)
    means = np.array([r["mean"] for r in stats])
    sizes = np.array([r["n"] for r in stats], dtype=float)
    centre = sizes @ means / total
    within = np.zeros((len(cols), len(cols)))
    for r in stats:
        for (i, j), v in zip(pairs, r["cov"], strict=True):
            within[i, j] += r["n"] * v
            within[j, i] = within[i, j]
    between = ((means - centre).T * sizes) @ (means - centre)
    values, vectors = np.linalg.eig(np.linalg.pinv(within) @ between)
    best = np.argsort(-values.real)[:k]
    axes = vectors.real[:, best]
    # sign convention: the largest loading of every axis is positive
    axes = axes * np.sign(axes[np.abs(axes).argmax(axis=0), range(axes.shape[1])])
    scores = []
    for i in range(axes.shape[1]):
        parts = [(x[j] - float(centre[j])) * float(axes[j, i]) for j in range(len(cols))]
        score = parts[0]
        for p in parts[1:]:
            score = score + p
        scores.append(score.alias(f"ld{i + 1}"))
    return df.select(*keep, *scores)


@dataclass
class Multinomial:
    """A fitted model: log odds of every class against the first one, and the covariance of the coefficients.

    ``beta`` has a row per term (intercept first) and a column per class but the first; ``covariance`` runs over
    the classes' coefficients one class after the other.
    """

    classes: list
    columns: list[str]
    beta: np.ndarray
    covariance: np.ndarray
    log_likelihood: float
    converged: bool

    def table(self, spark: SparkSession) -> DataFrame:
        """One row per class and term: estimate, standard error and their ratio."""
        terms, errors = ["(Intercept)", *self.columns], np.sqrt(np.clip(np.diag(self.covariance), 0, None))
        rows = []
        for k, name in enumerate(self.classes[1:]):
            for j, term in enumerate(terms):
                estimate, error = float(self.beta[j, k]), float(errors[k * len(terms) + j])
                rows.append((str(name), term, estimate, error, estimate / error if error else None))
        return spark.createDataFrame(rows, "class string, term string, estimate double, std_error double, z double")

    def probabilities(self, df: DataFrame, out: str = "p") -> DataFrame:
        """``df`` with an array of the classes' probabilities in order; NULL where a column is missing."""
        odds = [F.lit(0.0)]
        for k in range(len(self.classes) - 1):
            parts = [F.col(c).cast("double") * float(b) for c, b in zip(self.columns, self.beta[1:, k], strict=True)]
            odds.append(reduce(lambda a, b: a + b, parts, F.lit(float(self.beta[0, k]))))
        top = F.greatest(*odds) if len(odds) > 1 else odds[0]
        parts = F.array(*[F.exp(o - top) for o in odds])
        total = F.aggregate(parts, F.lit(0.0), lambda a, x: a + x)
        return df.withColumn(out, F.when(_complete(self.columns), F.transform(parts, lambda x: x / total)))


def _likelihood(rows: DataFrame, beta: np.ndarray, centre: np.ndarray, scale: np.ndarray):
    """Log-likelihood, gradient and information at ``beta``: one row of sums a task, added up cell by cell."""
    width, others = beta.shape

    def sums(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = None
        for part in batches:
            if not len(part):
                continue
            x = np.column_stack([np.ones(len(part)), (np.stack(part["x"].to_numpy()) - centre) / scale])
            odds = np.column_stack([np.zeros(len(part)), x @ beta])
            odds -= odds.max(axis=1, keepdims=True)
            logs = odds - np.log(np.exp(odds).sum(axis=1, keepdims=True))
            seen = part["k"].to_numpy()
            p = np.exp(logs)[:, 1:]
            miss = (seen[:, None] == np.arange(1, others + 1)) - p
            info = np.empty((others, width, others, width))
            for a in range(others):
                for b in range(a, others):
                    weight = p[:, a] * ((a == b) - p[:, b])
                    info[a, :, b, :] = info[b, :, a, :] = x.T @ (x * weight[:, None])
            cells = [[logs[np.arange(len(part)), seen].sum()], (x.T @ miss).T.ravel(), info.ravel()]
            total = np.concatenate(cells) + (0 if total is None else total)
        if total is not None:
            yield pd.DataFrame({"cells": [total]})

    added = (
        rows.mapInPandas(sums, "cells array<double>")
        .select(F.posexplode("cells").alias("at", "v"))
        .groupBy("at")
        .agg(F.sum("v").alias("v"))
        .collect()
    )
    flat = np.zeros(1 + width * others + (width * others) ** 2)
    for r in added:
        flat[r["at"]] = r["v"]
    m = width * others
    return flat[0], flat[1 : 1 + m], flat[1 + m :].reshape(m, m)


def multinomial_fit(
    df: DataFrame, columns: Sequence[str], label: str, max_iter: int = 50, tolerance: float = 1e-10, most: int = 100
) -> Multinomial:
    """Multinomial regression by maximum likelihood; the first class in order is the base.

    Newton steps, which here are iteratively reweighted least squares, on centred and scaled columns. A step is one
    pass that sums the log-likelihood, its gradient and the information, a matrix of (classes - 1) x (columns + 1)
    squared; a step that loses likelihood is halved. Rows with a missing value are left out, a constant column gets
    the coefficient 0, and collinear columns share the least-squares solution. Where classes are separable there is no maximum:
    the fit stops after ``max_iter`` steps with ``converged`` false. More classes than ``most`` are an error, as is no row.
    """
    columns = list(columns)
    whole = df.filter(_complete(columns) & F.col(label).isNotNull())
    classes = levels(whole, label, most)
    if not classes:
        raise ValueError("no complete rows to fit")
    place = F.array_position(F.array(*[F.lit(c) for c in classes]), F.col(label)) - 1
    x = F.array(*[F.col(c).cast("double") for c in columns])
    rows = staged(whole.select(x.cast("array<double>").alias("x"), place.cast("int").alias("k")))
    moments = [f(F.col("x")[j]) for j in range(len(columns)) for f in (F.avg, F.stddev_pop)]
    found = list(rows.agg(F.count(F.lit(1)), *moments).first())[1:]
    centre, scale = np.array(found[::2], dtype=float), np.array(found[1::2], dtype=float)
    scale[scale == 0] = 1.0
    width, others = len(columns) + 1, len(classes) - 1
    beta, converged = np.zeros((width, others)), others == 0
    value, slope, info = _likelihood(rows, beta, centre, scale)
    for _ in range(0 if converged else max_iter):
        step = (np.linalg.pinv(info, rcond=1e-12, hermitian=True) @ slope).reshape(others, width).T
        gain = float(step.T.ravel() @ slope)
        if gain <= tolerance * (abs(value) + 1) * 1e-6:
            converged = True
            break
        for _ in range(30):
            at = _likelihood(rows, beta + step, centre, scale)
            if at[0] >= value - 1e-12 * abs(value):
                break
            step = step / 2
        else:
            break
        beta, (value, slope, info) = beta + step, at
    # back to the columns' own units
    back = np.eye(width)
    back[0, 1:] = -centre / scale
    back[1:, 1:] = np.diag(1 / scale)
    spread = np.kron(np.eye(others), back)
    covariance = spread @ np.linalg.pinv(info, rcond=1e-12, hermitian=True) @ spread.T
    return Multinomial(classes, columns, back @ beta, covariance, float(value), converged)
