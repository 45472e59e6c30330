"""The two classifiers against slow versions that hold everything in dicts and Python numbers."""

from __future__ import annotations

import math
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from cohortspark.llm import queries, subwords, toxicity

SF = "/root/testdata/sf0.001"
SPACE = b"\t\n\x0b\x0c\r "
FULL = (1 << 64) - 1
BASE = 0x9E3779B97F4A7C15
ODD = ["", None, " \n", "one", "Two two TWO two", "é ü é ü", "a b c a b c a b c", "x" * 300, "ab\tab  ab"]


def mixed(h: int) -> int:
    h = (h ^ (h >> 31)) * 0xBF58476D1CE4E5B9 & FULL
    return h ^ (h >> 29)


def hashed(raw: bytes, start: int = 0) -> int:
    total, power = start, 1
    for x in raw:
        total, power = (total + (x + 1) * power) & FULL, power * BASE & FULL
    return mixed(total)


def lowered(text: str | None) -> bytes:
    return re.sub(rb"[A-Z]", lambda m: m[0].lower(), (text or "").encode())


def plain_features(text: str | None, s: subwords.Settings) -> list[dict[int, float]]:
    """Per kind: the share of each feature number among the kind's features."""
    raw = lowered(text)
    words = [w for w in re.split(rb"[\t-\r ]+", raw) if w]
    spaced = bytes(32 if x in SPACE else x for x in raw)

    def place(h: int) -> int:
        return max(h >> (64 - s.bits), subwords.FIRST)

    kinds: list[list[int]] = [[place(mixed(hashed(w))) for w in words]]
    for n in s.grams:
        grams = [spaced[i : i + n] for i in range(len(raw) - n + 1)]
        kinds.append([place(hashed(g, n)) for g in grams if 32 not in g[1:-1]])
    seen, marks = set(), []
    for i in range(len(words) - s.window + 1):
        window = tuple(words[i : i + s.window])
        marks.append(subwords.AGAIN if window in seen else subwords.FRESH)
        seen.add(window)
    kinds.append(marks)
    kinds.append([subwords.TWIN if a == b else subwords.STEP for a, b in zip(words, words[1:], strict=False)])
    return [{f: n / len(kind) for f, n in Counter(kind).items()} for kind in kinds]


def sigmoid(x: float) -> float:
    return 1 / (1 + math.exp(-min(max(x, -30), 30)))


def test_quality_scores_of_the_table(spark, monkeypatch):
    """Every row of the query, and odd texts, against features gathered in dicts."""
    models, s = [], subwords.Settings()
    fit = subwords.fit
    monkeypatch.setattr(subwords, "fit", lambda *a, **k: models.append(fit(*a, **k)) or models[-1])
    got = {r.doc_id: r for r in queries.op2_quality_classifier(spark, SF).collect()}
    (table, bias), = models

    def plain(text):
        return sigmoid(bias + sum(w * float(table[f]) for kind in plain_features(text, s) for f, w in kind.items()))

    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    assert len(got) == len(docs)
    for r in docs:
        assert got[r.doc_id].score == pytest.approx(plain(r.text), abs=1e-5)
        assert got[r.doc_id].predicted == int(got[r.doc_id].score >= 0.7)
    odd = spark.createDataFrame(list(enumerate(ODD)), "doc_id bigint, text string")
    for r in subwords.score(odd, (table, bias)).collect():
        assert r.score == pytest.approx(plain(ODD[r.doc_id]), abs=1e-5)


@pytest.mark.parametrize("bits", [6, 17])
def test_quality_training_step_by_step(bits):
    """Stochastic gradient descent on dicts of vectors; few places make features of different kinds share one."""
    s = subwords.Settings(bits=bits, width=3, epochs=3)
    texts = [t or "" for t in ODD] + ["good plain words here", "bad %% bad %% bad %%"]
    labels = [i % 2 for i in range(len(texts))]
    weights, shift = subwords.train(texts, np.array(labels), s)
    rng = np.random.default_rng(s.seed)
    start = rng.uniform(-1 / s.width, 1 / s.width, (1 << s.bits, s.width)).astype(np.float32)
    vectors = defaultdict(list, {f: row.tolist() for f, row in enumerate(start)})
    out = [[0.0] * s.width, [0.0] * s.width]
    bias = [math.log(labels.count(y) / len(labels)) for y in (0, 1)]
    done, steps = 0, s.epochs * len(texts)
    for _ in range(s.epochs):
        for i in rng.permutation(len(texts)):
            rate = s.rate * (1 - done / steps)
            done += 1
            doc = Counter()
            for kind in plain_features(texts[i], s):
                doc.update(kind)
            hidden = [sum(w * vectors[f][j] for f, w in doc.items()) for j in range(s.width)]
            logits = [sum(o * h for o, h in zip(out[y], hidden, strict=True)) + bias[y] for y in (0, 1)]
            p = [math.exp(x - max(logits)) for x in logits]
            wrong = [x / sum(p) - (y == labels[i]) for y, x in enumerate(p)]
            step = [sum(wrong[y] * out[y][j] for y in (0, 1)) for j in range(s.width)]
            for y in (0, 1):
                out[y] = [o - rate * (wrong[y] * h + s.decay * o) for o, h in zip(out[y], hidden, strict=True)]
                bias[y] -= 0.1 * rate * wrong[y]
            for f, w in doc.items():
                vectors[f] = [v - rate * w * g for v, g in zip(vectors[f], step, strict=True)]
    plain = [sum(v * (b - a) for v, a, b in zip(vectors[f], *out, strict=True)) for f in range(1 << s.bits)]
    assert np.allclose(weights, plain, atol=1e-4) and shift == pytest.approx(bias[1] - bias[0], abs=1e-4)


def plain_votes(text: str | None, voters: list[tuple[int, int]], s: toxicity.Settings) -> list[int]:
    words = [w for w in re.split(rb"[\t-\r ]+", lowered(text)) if w]
    marks: Counter = Counter()
    for w in words:
        for n in s.beginnings:
            if n == 0:
                marks[hashed(w)] += 1
            elif len(w) >= n:
                marks[hashed(w[:n], n)] += 1
    return [k for k, (mark, level) in enumerate(voters) if marks[mark] >= level]


def plain_label_model(votes: list[list[int]], known: list[float | None], yes, no, prior, overlap, s: toxicity.Settings):
    """The rates after all rounds of expectation maximisation, one row after the other, with given overlaps."""
    n = len(yes)
    first_yes = yes = [min(max(x, 1e-4), 0.95) for x in yes] + [0.1]
    first_no = no = [min(max(x, 1e-6), 0.95) for x in no] + [0.9]
    first_prior = prior
    for _ in range(s.rounds):
        sums, sizes = [[0.0] * (n + 1), [0.0] * (n + 1)], [0.0, 0.0]
        for v, k in zip(votes, known, strict=True):
            x = math.log(prior / (1 - prior))
            for a in v:
                x += math.log(yes[a] / no[a]) / sum(overlap[a][b] for b in v)
            if not v:
                x += math.log(yes[n] / no[n])
            p, weight = (sigmoid(x), s.guess) if k is None else (k, 1.0)
            for y, share in enumerate((p, 1 - p)):
                sizes[y] += weight * share
                for a in v or [n]:
                    sums[y][a] += weight * share
        yes = [min(max((a + 20 * b) / (sizes[0] + 20), 1e-4), 0.95) for a, b in zip(sums[0], first_yes, strict=True)]
        no = [min(max((a + 20 * b) / (sizes[1] + 20), 1e-6), 0.95) for a, b in zip(sums[1], first_no, strict=True)]
        prior = min(max((sizes[0] + 20 * first_prior) / (sum(sizes) + 20), 1e-4), 0.5)
    return yes, no, prior


def test_toxicity_scores_of_the_table(spark, monkeypatch):
    """Votes, the label model's rates, and every row of the query against versions without arrays."""
    s, seen = toxicity.Settings(), {}

    def spy(name):
        real = getattr(toxicity, name)

        def call(*a, **k):
            seen[name] = (a, real(*a, **k))
            return seen[name][1]

        monkeypatch.setattr(toxicity, name, call)

    for name in ("mine", "label_model", "classifier"):
        spy(name)
    got = {r.doc_id: r for r in queries.op5_toxicity(spark, SF).collect()}
    voters = [(int(m), int(n)) for m, n in seen["mine"][1][0].tolist()]
    (usable, yes, no, prior, _), model = seen["label_model"]
    weights, bias = seen["classifier"][1]
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    votes = {r.doc_id: plain_votes(r.text, voters, s) for r in docs}
    assert len(got) == len(docs) and any(votes.values())
    for i, v in votes.items():
        assert got[i].score == pytest.approx(sigmoid(bias + sum(weights[k] for k in v)), abs=1e-9)
        assert got[i].predicted == int(got[i].score >= 0.5)
    odd = spark.createDataFrame(list(enumerate([*ODD, "Idiot! idiot, you STUPID"])), "doc_id bigint, text string")
    said = toxicity.vote(odd, seen["mine"][1][0]).collect()
    assert [r.votes for r in sorted(said)] == [plain_votes(t, voters, s) for t in [*ODD, "Idiot! idiot, you STUPID"]] and said
    rows = usable.select("votes", F.col("known")).collect()
    plain = plain_label_model([r.votes for r in rows], [r.known for r in rows], yes.tolist(), no.tolist(), prior, model.overlap.tolist(), s)
    assert np.allclose(model.yes, plain[0]) and np.allclose(model.no, plain[1]) and model.prior == pytest.approx(plain[2])
