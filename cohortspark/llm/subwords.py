"""Quality classifier on supervised subword embeddings.

Hashed words, character n-grams and word-window marks have learned vectors. Each kind is averaged per document by
itself, the averages are added, and a softmax layer gives the class probabilities. Word-window marks say whether a
window, or a word pair, repeats what the text said before, so that the average also tells repetition.

Training is numpy stochastic gradient descent on a bounded sample of labelled rows (``Settings.sample``, those with
the smallest id hashes). After training the output layer is folded into the vectors: a document's
score needs one number per feature, so whole texts of any length are scored in one pass without a shuffle.

Defined results: null and empty texts have no features and get the score of the bias; repeated rows are each
scored; other columns are kept; without labels of both classes every score is the prior (0.5 without any label); an empty
table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cohortspark.llm.textnum import Texts, mix, pieces


@dataclass(frozen=True)
class Settings:
    sample: int = 4000
    bits: int = 17
    width: int = 8
    grams: tuple[int, ...] = (3, 5)
    window: int = 3
    epochs: int = 12
    rate: float = 0.4
    decay: float = 1e-5
    seed: int = 7


#: features of their own, in the first places of the vector table
FRESH, AGAIN, STEP, TWIN, FIRST = 0, 1, 2, 3, 4


def _bucket(hashes: np.ndarray, bits: int) -> np.ndarray:
    return (hashes >> np.uint64(64 - bits)).astype(np.int64).clip(FIRST)


def features(texts: Texts, s: Settings) -> list[tuple[np.ndarray, np.ndarray]]:
    """Per kind: feature numbers in text order, and where each text's begin (one more at the end)."""
    words = texts.words
    out = [(_bucket(mix(words), s.bits), texts.first_word)]
    for n in s.grams:
        places, hashes = texts.grams(n)
        out.append((_bucket(hashes, s.bits), np.searchsorted(places, texts.off)))
    text, windows = texts.windows(s.window)
    # a window repeats if an earlier one of its text is the same: all but the first of each run in a stable sort
    order = np.lexsort((windows, text))
    same = np.zeros(len(order), dtype=bool)
    same[1:] = (windows[order][1:] == windows[order][:-1]) & (text[order][1:] == text[order][:-1])
    marks = np.full(len(order), FRESH)
    marks[order[same]] = AGAIN
    out.append((marks, np.searchsorted(text, np.arange(len(texts) + 1))))
    of = texts.text_of_word
    pair = of[1:] == of[:-1]
    out.append((np.where(words[1:] == words[:-1], TWIN, STEP)[pair], np.searchsorted(of[1:][pair], np.arange(len(texts) + 1))))
    return out


def train(docs: list[str], labels: np.ndarray, s: Settings) -> tuple[np.ndarray, float]:
    """One number per feature and a bias: the log-odds of class 1 folded from vectors and output layer."""
    labels = np.asarray(labels, dtype=np.int64)
    size = 1 << s.bits
    if len(set(labels.tolist())) < 2:
        prior = float(labels.mean()) if len(labels) else 0.5
        prior = min(max(prior, 0.01), 0.99)
        return np.zeros(size, dtype=np.float32), float(np.log(prior / (1 - prior)))
    rng = np.random.default_rng(s.seed)
    rows = []
    for doc in docs:
        ids, weights = [], []
        for kind, (found, _) in enumerate(features(Texts.of(pa.array([doc])), s)):
            if len(found):
                one, count = np.unique(found, return_counts=True)
                ids.append(one)
                weights.append(count / len(found))
        # features of two kinds may share a place: its weights are added, so that a step moves it once by both
        ids, place = np.unique(np.concatenate([np.zeros(0, dtype=np.int64), *ids]), return_inverse=True)
        weights = np.bincount(place, np.concatenate([np.zeros(0), *weights]), len(ids))
        rows.append((ids.astype(np.int32), weights.astype(np.float32)))
    vectors = rng.uniform(-1 / s.width, 1 / s.width, (size, s.width)).astype(np.float32)
    out = np.zeros((2, s.width), dtype=np.float32)
    bias = np.log(np.bincount(labels, minlength=2) / len(labels)).astype(np.float32)
    steps, done = s.epochs * len(rows), 0
    for _ in range(s.epochs):
        for i in rng.permutation(len(rows)):
            ids, weights = rows[i]
            rate = s.rate * (1 - done / steps)
            done += 1
            hidden = weights @ vectors[ids]
            logits = out @ hidden + bias
            wrong = np.exp(logits - logits.max())
            wrong /= wrong.sum()
            wrong[labels[i]] -= 1
            step = wrong @ out
            out -= rate * (np.outer(wrong, hidden) + s.decay * out)
            bias -= 0.1 * rate * wrong
            vectors[ids] -= rate * np.outer(weights, step)
    return (vectors @ (out[1] - out[0])).astype(np.float32), float(bias[1] - bias[0])


def _scored(weights: bytes, bias: float, s: Settings, text: str, keep_text: bool = False):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = np.frombuffer(weights, dtype=np.float32)
        for batch in batches:
            column = batch.column(batch.schema.get_field_index(text))
            scores = []
            for a, b in pieces(column):
                texts = Texts.of(column.slice(a, b - a))
                logit = np.full(len(texts), bias)
                for found, first in features(texts, s):
                    logit += texts.sums(table[found], first) / np.maximum(np.diff(first), 1)
                scores.append(1 / (1 + np.exp(-logit.clip(-30, 30))))
            score = pa.array(np.concatenate(scores) if scores else np.zeros(0))
            rest = [(n, batch.column(j)) for j, n in enumerate(batch.schema.names) if keep_text or n != text]
            yield pa.RecordBatch.from_arrays([*(c for _, c in rest), score], names=[*(n for n, _ in rest), "score"])

    return run


def fit(docs: DataFrame, labels: DataFrame, label: str, learn: Column, key: str, text: str = "text", s: Settings = Settings()) -> tuple[np.ndarray, float]:
    """Train on the ``s.sample`` rows of ``labels`` (key, label) with the smallest key hashes among those that ``learn`` admits.

    Only those keys, a fixed number, are sent to the tasks that read the texts.
    """
    some = labels.where(F.coalesce(learn, F.lit(False)) & F.col(f"`{label}`").isNotNull() & F.col(f"`{key}`").isNotNull())
    some = some.select(F.col(f"`{key}`").alias("key"), (F.col(f"`{label}`") != 0).cast("int").alias("label"))
    some = some.orderBy(F.xxhash64("key"), "label").limit(s.sample)
    texts = docs.select(F.col(f"`{key}`").alias("key"), F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("text"))
    # one text of each key, that of the smallest hash: repeated ids do not add rows
    found = texts.join(F.broadcast(some), "key").groupBy("key", "label")
    rows = found.agg(F.min_by("text", F.struct(F.xxhash64("text"), F.length("text"))).alias("text")).collect()
    rows.sort(key=lambda r: (str(r["key"]), r["text"], r["label"]))
    return train([r["text"] for r in rows], np.array([r["label"] for r in rows], dtype=np.int64), s)


def score(docs: DataFrame, model: tuple[np.ndarray, float], text: str = "text", s: Settings = Settings(), keep_text: bool = False) -> DataFrame:
    """The rows with ``score``, the probability of class 1, in place of the text column, or beside it, so that a text is sent once."""
    kept = [f for f in docs.schema.fields if f.name != "score" and (keep_text or f.name != text)]
    rows = docs.select(*[F.col(f"`{f.name}`") for f in kept], *([] if keep_text else [F.col(f"`{text}`").alias("__text")]))
    maker = _scored(model[0].tobytes(), model[1], s, text if keep_text else "__text", keep_text)
    return rows.mapInArrow(maker, T.StructType([*kept, T.StructField("score", T.DoubleType())]))
