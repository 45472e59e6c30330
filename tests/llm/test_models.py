"""Classifiers and the language model: held-out accuracy, exact bases, proper probabilities, edge cases."""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from cohortspark.llm import gru, lm, subwords, toxicity
from cohortspark.llm.textnum import Texts

WORD = re.compile(rb"[^\x20\x09-\x0D]+")


def auc(score, y):
    order = np.argsort(score, kind="stable")
    rank = np.empty(len(order))
    rank[order] = np.arange(len(order))
    y = np.asarray(y)
    return (rank[y == 1].sum() - (y == 1).sum() * ((y == 1).sum() - 1) / 2) / ((y == 1).sum() * (y == 0).sum())


def good(rng, n=60):
    return " ".join(f"{'aeiou'[rng.integers(5)]}{'bcdfg'[rng.integers(5)]}{'lmnr'[rng.integers(4)]}" for _ in range(n))


def marked(spark, rng, spoil, n=400):
    rows, labels = [], []
    for i in range(n):
        bad = i % 3 == 0
        rows.append((i, spoil(good(rng), rng) if bad else good(rng), "x"))
        labels.append((i, int(bad)))
    return spark.createDataFrame(rows, "doc_id bigint, text string, votes string"), spark.createDataFrame(labels, "doc_id bigint, y int")


def test_hashes_are_words(spark):
    texts = ["Ab  cd\nab", None, "", " x ", "é ab"]
    t = Texts.of(pa.array(texts))
    assert t.n_words.tolist() == [3, 0, 0, 1, 2]
    h = t.words.tolist()
    assert h[0] == h[2] == h[5] and len(set(h)) == 4
    places, _ = t.grams(3)
    assert [bytes(t.low[p : p + 3]) for p in places][:2] == [b"ab ", b" cd"]


def test_subwords_learn(spark, documents, nothing):
    rng = np.random.default_rng(1)

    def spoil(text, rng):
        return " ".join(w + "%%" for w in text.split()) if rng.integers(2) else " ".join([text[:40]] * 6)

    docs, labels = marked(spark, rng, spoil)
    held = F.col("doc_id") % 4 == 2
    model = subwords.fit(docs, labels, "y", ~held, "doc_id")
    out = subwords.score(docs.join(labels, "doc_id").withColumn("held", held), model)
    assert set(out.columns) == {"doc_id", "votes", "y", "held", "score"}
    rows = [r for r in out.collect() if r["held"]]
    assert auc([r["score"] for r in rows], [r["y"] for r in rows]) > 0.98
    edge = {r["doc_id"]: r["score"] for r in subwords.score(documents, model).collect()}
    assert all(0 <= x <= 1 for x in edge.values()) and edge[4] == edge[5]
    assert subwords.score(nothing, model).count() == 0
    empty = subwords.fit(docs, labels.where("false"), "y", F.lit(True), "doc_id")
    assert {r["score"] for r in subwords.score(documents, empty).collect()} == {0.5}


def test_toxicity_learns(spark, documents, nothing):
    rng = np.random.default_rng(2)

    def spoil(text, rng):
        words = text.split()
        for i in rng.choice(len(words), 3, replace=False):
            words[i] = f"zorqu{'xyz'[rng.integers(3)]}{rng.integers(100)}" if rng.integers(4) else "idiot"
        return " ".join(words)

    docs, labels = marked(spark, rng, spoil)
    held = F.col("doc_id") % 5 == 0
    out = toxicity.score(docs.withColumn("held", held), labels, "y", ~held, "doc_id").join(labels, "doc_id")
    rows = [r for r in out.collect() if r["held"]]
    assert auc([r["score"] for r in rows], [r["y"] for r in rows]) > 0.98
    assert np.mean([(r["score"] >= 0.5) == r["y"] for r in rows]) > 0.95
    edge = toxicity.score(documents.withColumnRenamed("score", "votes"), labels.where("false"), "y", F.lit(True), "doc_id")
    assert edge.count() == documents.count() and all(0 <= r["score"] < 0.5 for r in edge.collect())
    assert toxicity.score(nothing, labels, "y", F.lit(True), "doc_id").count() == 0


def test_overlapping_voters_count_once():
    n = 3
    same = np.eye(n)
    same[0, 1] = same[1, 0] = 1
    model = toxicity.LabelModel(np.full(n + 1, 0.5), np.full(n + 1, 0.1), 0.1, same)
    one, twins, two = model.posterior([[0], [0, 1], [0, 2]])
    assert one == pytest.approx(twins) and two > twins


def small_model(rng):
    shape = gru.Shape(top=20, per_class=4, tails=5, hidden=6, lanes=4, steps=5)
    counts, tails, types = rng.integers(1, 50, 18), rng.integers(1, 30, 5), rng.integers(1, 5, 5)
    return gru.Model.fresh(shape, counts.astype(float), tails.astype(float)), types


def test_gru_probabilities_add_up():
    rng = np.random.default_rng(3)
    model, _ = small_model(rng)
    tokens = rng.integers(0, 23, 400)
    model.train(tokens, np.arange(0, 401, 20))
    h = rng.normal(size=(7, 6)).astype(np.float32)
    total = sum(np.exp(model.log_prob(h, np.full(7, t))) for t in range(23))
    assert np.allclose(total, 1, atol=1e-4)


def test_gru_gradients():
    """The update direction of one window against numeric differences of its log-likelihood."""
    rng = np.random.default_rng(4)
    model, _ = small_model(rng)
    for k in ("classes", "outputs"):
        model.p[k] = rng.normal(0, 0.5, model.p[k].shape).astype(np.float32)
    tokens, first = rng.integers(0, 23, 5), np.array([0, 5])
    data = np.full((4, 5), -1)
    data[0] = tokens
    new = np.zeros((4, 5), bool)
    new[:, 0] = True
    start = {k: v.copy() for k, v in model.p.items()}
    # with all sums at a large constant a step is proportional to the gradient
    model.sums = {k: np.full(v.shape, 1e8, np.float32) for k, v in model.p.items()}
    model.shape = gru.Shape(**{**model.shape.__dict__, "rate": 1e4})
    model._window(data, new, np.zeros((4, 6), np.float32))
    for name, (i, j) in {"gates": (1, 2), "candidate": (2, 3), "classes": (3, 1), "inputs": (int(tokens[1]), 4)}.items():
        step = (start[name] - model.p[name])[i, j] * 5  # the window's mean, times its tokens
        values = []
        for eps in (1e-2, -1e-2):
            p = {k: v.copy() for k, v in start.items()}
            p[name][i, j] += eps
            values.append(gru.Model(model.shape, p).score(tokens, first)[0])
        assert step == pytest.approx(-(values[0] - values[1]) / 2e-2, abs=5e-3), name


def test_gru_state_is_carried():
    rng = np.random.default_rng(5)
    model, _ = small_model(rng)
    model.p["classes"] = rng.normal(size=model.p["classes"].shape).astype(np.float32)
    tokens = rng.integers(0, 23, 90)
    first = np.array([0, 70, 70, 90])
    assert np.allclose(model.score(tokens, first, window=7), model.score(tokens, first, window=64), atol=1e-3)


def test_lm_bases_are_exact(spark, documents, nothing):
    s = lm.Settings(shape=gru.Shape(top=40, per_class=8, tails=7, hidden=8), near=60, per_task=3, fan=2)
    learn = F.col("doc_id").isNotNull() & (F.col("doc_id") % 7 != 2)
    out = lm.score(documents.withColumnRenamed("score", "n_known"), learn, s=s).collect()
    texts = [(r["doc_id"], r["text"]) for r in documents.collect()]
    tokens = [WORD.findall((t or "").encode().lower()) + [b"\n"] for _, t in texts]
    c = Counter(w for (i, _), t in zip(texts, tokens, strict=True) if i is not None and i % 7 != 2 for w in t)
    n, v = sum(c.values()), len(c)
    want = Counter((i, len(t), sum(w in c for w in t), n, round(sum(math.log10((c[w] + 1) / (n + v + 1)) for w in t), 6)) for (i, _), t in zip(texts, tokens, strict=True))
    assert Counter((r["doc_id"], r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 6)) for r in out) == want
    assert all(r["score"] < 0 and math.isfinite(r["score"]) for r in out)
    assert lm.score(nothing, F.lit(True), s=s).count() == 0
    none = lm.score(documents, F.lit(False), s=s).collect()
    assert {r["train_tokens"] for r in none} == {0} and {r["base_score"] for r in none} == {0.0}


def test_lm_beats_its_base(spark):
    rng = np.random.default_rng(6)
    words = [[f"{x}{k}" for k in range(40)] for x in "pq"]
    rows = [(i, " ".join(rng.choice(words[i % 2], 80))) for i in range(300)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    learn = F.crc32(F.col("doc_id").cast("string")) % 7 != 2
    out = [r for r in lm.score(df, learn).collect() if zlib.crc32(str(r["doc_id"]).encode()) % 7 == 2]
    assert len(out) > 20 and np.mean([r["score"] > r["base_score"] for r in out]) > 0.9


def test_lm_trains_on_whole_documents(spark):
    """Each word of a long document stands in it once, and nearly all their vectors learn (the last of a window has no successor in it)."""
    df = spark.createDataFrame([(1, " ".join(f"w{i}" for i in range(3000))), (2, "w0")], "doc_id bigint, text string")
    vocab = lm.vocabulary(lm.count_words(df))
    model = lm.train(df, vocab)
    moved = (model.sums["inputs"][: vocab.top] > 1.00001e-7).any(axis=1)
    assert moved.mean() > 0.9


def test_gru_trains_all_tokens_whatever_the_lengths():
    rng = np.random.default_rng(8)
    model, _ = small_model(rng)
    first = np.array([0, 0, 301, 302, 310, 310, 355])
    assert model.train(rng.integers(0, 23, 355), first) == 355 and all(np.isfinite(v).all() for v in model.p.values())
    assert model.train(np.zeros(0, np.int64), np.array([0, 0])) == 0


def test_overlap_is_counted_inside_the_classes():
    """Voters that only share their class have no overlap, voters that copy each other have all of it."""
    rng = np.random.default_rng(4)
    toxic = rng.random(40_000) < 0.2
    rates = np.where(toxic, 0.6, 0.01)
    votes = np.column_stack([rng.random(40_000) < rates for _ in range(3)])
    votes = np.column_stack([votes, votes[:, 0]]).astype(float)
    both = np.stack([votes[k].T @ votes[k] for k in (toxic, ~toxic)])
    got = toxicity.overlap(both, np.array([toxic.sum(), (~toxic).sum()], dtype=float))
    assert got[0, 3] == pytest.approx(1) and got[0, 1] < 0.05 and got[1, 2] < 0.05
    assert toxicity.overlap(np.zeros((2, 2, 2)), np.zeros(2)).tolist() == [[0, 0], [0, 0]]


def test_repeated_ids_add_no_rows_to_the_sample(spark, monkeypatch):
    """A labelled id on thousands of rows sends one text to the driver."""
    docs = spark.createDataFrame([(1, f"text {k % 5}") for k in range(3000)] + [(2, "other words"), (3, None)], "doc_id bigint, text string")
    labels = spark.createDataFrame([(1, 1), (1, 1), (2, 0), (3, 0)], "doc_id bigint, quality int")
    seen = []
    monkeypatch.setattr(subwords, "train", lambda texts, marks, s: seen.append((texts, marks.tolist())))
    subwords.fit(docs, labels, "quality", F.lit(True), "doc_id")
    (texts, marks), = seen
    assert len(texts) == 3 and marks == [1, 0, 0] and texts[0].startswith("text ") and texts[1:] == ["other words", ""]
