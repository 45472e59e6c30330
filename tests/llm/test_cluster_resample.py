"""Centroid clustering and importance resampling against plain versions on small frames."""

from __future__ import annotations

import hashlib
import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from cohortspark.llm import centroids, resampling
from cohortspark.llm.common import most_frequent


def plain_clusters(vectors: list[tuple], s: centroids.Settings) -> list[tuple]:
    kept = [(i, [math.floor(s.scale * x) for x in v]) for i, v in vectors]
    first = sorted(kept, key=lambda r: (hashlib.sha256(f"{s.salt}{'' if r[0] is None else r[0]}".encode()).hexdigest(), r[1]))
    now = [list(v) for _, v in first[: s.k]]
    for turn in range(s.rounds + 1):
        far = [[sum((a - b) ** 2 for a, b in zip(v, c, strict=True)) for c in now] for _, v in kept]
        own = [min(range(len(now)), key=lambda c: (row[c], c)) for row in far]
        for c in range(len(now)) if turn < s.rounds else ():
            mine = [v for (_, v), o in zip(kept, own, strict=True) if o == c]
            now[c] = [sum(x) // len(mine) for x in zip(*mine, strict=True)] if mine else now[c]
    return [(i, o, row[o]) for (i, _), o, row in zip(kept, own, far, strict=True)]


@pytest.mark.parametrize("k", [1, 3, 8])
def test_clusters(spark, k):
    rng = np.random.default_rng(k)
    vectors = [(int(i), [float(x) for x in rng.normal(0, 1, 4).round(2)]) for i in range(40)]
    vectors += [vectors[0], vectors[1], (None, [0.5, -0.5, 0.25, 1.0])]  # repeated rows, no id
    bad = [(90, None), (91, [1.0, None, 1.0, 1.0]), (92, [1.0, float("nan"), 0.0, 0.0]), (93, [1.0]), (94, []), (95, [float("inf")] * 4)]
    s = centroids.Settings(k=k, dimension=4, rounds=4, rows=7)
    df = spark.createDataFrame([(*r, 5, "x") for r in vectors + bad], "vec_id bigint, e array<double>, cluster int, dots string")
    got = centroids.cluster(df, "vec_id", "e", s)
    want = plain_clusters(vectors, s)
    assert sorted((str(r.id), r.cluster, r.distance) for r in got.collect()) == sorted((str(i), c, d) for i, c, d in want)
    r = got.first()
    assert r.inertia == sum(d for *_, d in want)
    assert r.cluster_inertia == sum(d for _, c, d in want if c == r.cluster)


def test_ties_few_vectors_and_empty(spark):
    s = centroids.Settings(k=8, dimension=2, rounds=2)
    df = spark.createDataFrame([(1, [0.0, 0.0]), (2, [0.0, 0.0]), (3, [1.0, 0.0])], "vec_id bigint, e array<float>")
    got = {r.id: (r.cluster, r.distance) for r in centroids.cluster(df, "vec_id", "e", s).collect()}
    want = {i: (c, d) for i, c, d in plain_clusters([(1, [0.0, 0.0]), (2, [0.0, 0.0]), (3, [1.0, 0.0])], s)}
    assert got == want and got[1] == got[2]
    assert centroids.cluster(df.limit(0), "vec_id", "e", s).count() == 0
    with pytest.raises(Exception, match="beyond"):
        centroids.cluster(spark.createDataFrame([(1, [1e9, 0.0])], "vec_id bigint, e array<double>"), "vec_id", "e", s).collect()


def test_products_follow_the_changes():
    rng = np.random.default_rng(0)
    old, vectors = rng.integers(-99, 99, (3, 6)), rng.integers(-99, 99, (5, 6))
    new = old.copy()
    new[0, 2] += 7
    new[2] -= 1
    moved = centroids.changes(old, new)
    assert [(c, at.tolist()) for c, at, _ in moved] == [(0, [2]), (2, [0, 1, 2, 3, 4, 5])]
    assert (centroids.update(vectors @ old.T, vectors, moved) == vectors @ new.T).all()


def plain_sample(docs: list[tuple], target: list, s: resampling.Settings) -> list[tuple]:
    def words(text):
        low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)

    def features(text):
        w = words(text)
        return [zlib.crc32(" ".join(w[i : i + n]).encode()) % s.buckets for n in range(1, s.longest + 1) for i in range(len(w) - n + 1)]

    have, want = Counter(b for _, t in docs for b in features(t)), Counter(b for t in target for b in features(t))
    s_all, t_all = sum(have.values()), sum(want.values())
    gain = [math.floor(1000 * math.log((want[b] + 1) * (s_all + s.buckets) / ((have[b] + 1) * (t_all + s.buckets)))) for b in range(s.buckets)]
    rows = []
    for key, t in docs:
        f = features(t)
        weight = sum(gain[b] for b in f) // len(f) if f else 0
        h = int(hashlib.sha256(f"{s.salt}{'' if key is None else key}".encode()).hexdigest()[:8], 16)
        score = weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 2**32)))
        rows.append([key, len(f), weight, score, None, len(words(t)) >= s.least_words])
    able = sorted((r for r in rows if r[5]), key=lambda r: (-r[3], r[0] is None, r[0] or 0))
    for place, r in enumerate(able[: s.percent * len(able) // 100], 1):
        r[4] = place
    return sorted((tuple(r[:5]) for r in rows), key=str)


@pytest.mark.parametrize(("longest", "size"), [(1, 65_536), (1, 0), (3, 7)])
def test_resampling(spark, longest, size):
    """Runs composed from payloads; with a small or an empty dictionary the gaps give the same results."""
    rng = np.random.default_rng(2)
    pool = ["Alpha", "beta", "Ärger", "ß", "gamma2", "日本", "x", "don", "long" * 40, "É"]
    docs = [(i, " ".join(rng.choice(pool, rng.integers(0, 40)))) for i in range(60)]
    docs += [(None, "Beta, beta;\tBETA\x00x " * 9), (61, None), (62, ""), (63, "  ,.-  "), (5, docs[5][1]), (64, "y" * 300_000)]
    target = ["alpha alpha ärger", None, "日本 x x don"]
    s = resampling.Settings(longest=longest, buckets=97, least_words=5, percent=30, words=size, scan=200)
    df = spark.createDataFrame([(*d, 1, "q") for d in docs], "doc_id bigint, text string, rank int, other string").repartition(3)
    got = resampling.resample(df, spark.createDataFrame([(t,) for t in target], "text string"), s=s)
    rows = [tuple(r) for r in got.select("doc_id", "n_features", "weight", "score", "rank").collect()]
    assert sorted(rows, key=str) == plain_sample(docs, target, s)
    assert "other" in got.columns


def test_resampling_of_nothing(spark):
    none = spark.createDataFrame([], "doc_id bigint, text string")
    assert resampling.resample(none, none).count() == 0
    few = spark.createDataFrame([(1, "a b")], "doc_id bigint, text string")
    assert [r["rank"] for r in resampling.resample(few, none).collect()] == [None]


@pytest.mark.parametrize("k", [0, 3, 50, 500])
def test_most_frequent(spark, k):
    """The top of a count table, also where hundreds of words share one count."""
    rows = [(f"w{i:03}".encode(), 1) for i in range(400)] + [(b"a", 9), (b"b", 70), (b"c", 70)]
    df = spark.createDataFrame(rows, "word binary, n bigint")
    got = [(bytes(r["word"]), r["n"]) for r in most_frequent(df, "word", "n", k)]
    assert got == sorted(rows, key=lambda r: (-r[1], r[0]))[:k]
