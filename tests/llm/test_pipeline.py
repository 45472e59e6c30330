"""The corpus pipeline's stages, its near-duplicate decision against all pairs, and the language model on the shared tables."""

from __future__ import annotations

import math
import re
import tracemalloc
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from cohortspark.llm import neardup, queries, subwords
from cohortspark.llm.textnum import Texts

SF = "/root/testdata/sf0.01"
BASE = "the quick brown fox jumps over the lazy dog and runs far away into the deep green forest of the north today with all of its many good friends"


def plain_shingles(text: str | None) -> Counter:
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return Counter(tuple(w[i : i + 5]) for i in range(max(len(w) - 4, 1))) if w else Counter()


def plain_weights(sets: list[Counter], s: neardup.Settings) -> dict[tuple, float]:
    """The damped inverse document frequency of every shingle, counted one by one."""
    n = Counter(shingle for x in sets for shingle in x)
    share = max(1.0, sum(sum(x.values()) for x in sets) / s.heavy)
    most = max(math.log((len(sets) + 1) / (share + 1)), math.log(2))
    weight = {k: 1 + s.damping * min(1, math.log((len(sets) + 1) / (m + 1)) / most) for k, m in n.items()}
    return {k: w if n[k] >= share else 1 + s.damping for k, w in weight.items()}


def plain_classes(rows: list[tuple], s: neardup.Settings = neardup.Settings()) -> dict[int, int]:
    """Smallest connected id by the weighted Jaccard similarity of all pairs that share a shingle."""
    sets, first = {}, {}
    for key, text in sorted(rows):
        sets[key] = plain_shingles(text)
        first.setdefault(text or "", key)
    weight = plain_weights(list(sets.values()), s)
    root = {key: first[text or ""] for key, text in rows}

    def top(x):
        while root[x] != x:
            x = root[x]
        return x

    holders: dict = {}
    for key, found in sets.items():
        for shingle in found:
            holders.setdefault(shingle, []).append(key)
    met = set()
    for keys in holders.values():
        for i, a in enumerate(keys):
            met.update((a, b) for b in keys[i + 1 :])
    size = {key: sum(weight[k] * n for k, n in found.items()) for key, found in sets.items()}
    for a, b in met:
        common = sum(weight[k] * n for k, n in (sets[a] & sets[b]).items())
        if common >= 0.8 * (size[a] + size[b] - common):
            x, y = sorted((top(a), top(b)))
            root[y] = x
    return {key: top(key) for key in root}


def test_near_duplicates_of_the_table_against_all_pairs(spark):
    """Recall and precision on the table: similar pairs share a class, and no class joins texts without a chain of them."""
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    want = plain_classes(rows)
    got = {r.doc_id: r.class_id for r in queries.op8_minhash_neardup(spark, SF).collect()}
    assert got.keys() == want.keys()
    linked = [k for k, c in want.items() if k != c]
    assert sum(got[k] == got[want[k]] for k in linked) >= 0.99 * len(linked)
    assert all(want[k] == want[c] for k, c in got.items())


@pytest.mark.parametrize("heavy", [1 << 16, 1 << 10, 16])
def test_document_frequencies_are_exact(spark, documents, heavy):
    """Every shingle's weight against a plain count, with few and with many shingles above the share, on the table and on odd texts."""
    s = neardup.Settings(heavy=heavy, counters=1 << 13)
    for df in (spark.read.parquet("/root/testdata/sf0.001/documents.parquet"), documents):
        texts = [r.text for r in df.select("text").collect()]
        weight = plain_weights([plain_shingles(t) for t in texts], s)
        got = neardup.rarity(df, "text", len(texts), s)
        assert len(got.hashes) <= heavy
        for text in texts:
            _, found, tf = neardup.shingles(Texts.of(pa.array([text], pa.string())), s)
            mine = sorted(zip(got.of(found).tolist(), tf.tolist(), strict=True))
            plain = sorted((weight[k], n) for k, n in plain_shingles(text).items())
            assert len(mine) == len(plain)
            assert np.allclose(mine, plain, atol=1e-5) if plain else not mine


def test_rarity_without_documents(spark, nothing):
    got = neardup.rarity(nothing, "text", 0)
    assert len(got.hashes) == 0 and got.of(np.array([5], dtype=np.uint64)).tolist() == [1.25]


def test_near_copies_of_a_hot_group_stay_linked(spark):
    """Copies that a third of all documents resemble weigh little; the damping keeps a copy with one word in sixty changed."""
    words = [f"{w}{i}" for i, w in enumerate(BASE.split() * 3)]
    rows = [(i, " ".join([*words[: 7 + i % 60], f"x{i}", *words[8 + i % 60 :]])) for i in range(1, 101)]
    rows += [(i, " ".join(f"y{i * 100 + k}" for k in range(60))) for i in range(200, 400)]
    got = {r.doc_id: r.class_id for r in neardup.classes(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    assert {got[i] for i in range(1, 101)} == {1} and all(got[i] == i for i in range(200, 400))


def test_one_row_of_each_family_stays(spark):
    """Missing ids, an id of different texts, repeated rows and a clashing column."""
    other = "an entirely different text about ships and the sea and the wind over the water in the cold long night of the winter"
    rows = [
        (1, BASE, "a"),
        (2, BASE, "b"),
        (None, BASE, "c"),
        (None, other, "d"),
        (None, other, "e"),
        (2, "a text that shares its id with a copy of another one and must not be lost with it", "f"),
        (3, None, "g"),
        (4, "", "h"),
        (5, "lone", "i"),
        (5, "lone", "j"),
    ]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, family string")
    got = corpus_pipeline.drop_near_duplicates(spark, df, SF)
    assert got.columns == df.columns
    kept = Counter((r.doc_id, r.text) for r in got.collect())
    assert kept == Counter({(1, BASE): 1, (None, other): 1, (2, rows[5][1]): 1, (3, None): 1, (5, "lone"): 1})


def test_a_large_group_of_near_copies(spark):
    """Every text shares buckets with many others; one leader a text joins them, a stray text stays outside."""
    words = BASE.split() * 6
    rows = [(i, " ".join([*words[: i % 100], f"x{i}", *words[i % 100 + 1 :]])) for i in range(1, 400)]
    rows.append((500, " ".join(f"{w}{i}" for i, w in enumerate(words))))
    got = {r.doc_id: r.class_id for r in neardup.classes(spark.createDataFrame(rows, "doc_id bigint, text string"), s=neardup.Settings(tile=16, group=4)).collect()}
    assert {got[i] for i in range(1, 400)} == {1} and got[500] == 500


def test_stages_take_nothing_and_nulls(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    odd = spark.createDataFrame([(None, None, None, None, None), (7, None, "xx", None, 0), (7, "", None, "s", 0)], docs.schema)
    for frame in (docs.limit(0), odd):
        now = frame.withColumn("score", F.lit("own")).withColumn("n", F.lit(1))
        for _, stage in corpus_pipeline.STAGES[:-1]:
            now = stage(spark, now, "/root/testdata/sf0.001")
            assert now.columns == [*docs.columns, "score", "n"]
        assert corpus_pipeline.STAGES[-1][1](spark, now, "/root/testdata/sf0.001").count() >= 0


def test_the_classifier_gets_each_text_once(spark):
    """What is sent to Python is held there and in the executor: the columns and the mark of held-out rows, no second text."""
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    node = corpus_pipeline.keep_quality(spark, docs, sf)._jdf.queryExecution().optimizedPlan()
    while node.nodeName() != "MapInArrow":
        node = node.children().apply(0)
    assert node.children().apply(0).output().size() == len(docs.columns) + 1


def test_stages_in_python_get_small_batches(spark):
    name, sf = "spark.sql.execution.arrow.maxRecordsPerBatch", "/root/testdata/sf0.001"
    docs = spark.createDataFrame([(i, f"{BASE} {i}") for i in range(30)], "doc_id bigint, text string").coalesce(1)
    try:
        for _, stage in corpus_pipeline.STAGES[1:]:
            for before, after in (("10000", "1000"), ("0", "1000"), ("7", "7")):
                spark.conf.set(name, before)
                made = stage(spark, docs, sf)
                assert spark.conf.get(name) == after
            assert made.count() >= 0  # batches of seven rows
    finally:
        spark.conf.unset(name)


def test_small_batches_change_no_row(spark):
    """Every stage carries its state over from batch to batch."""
    name, sf = "spark.sql.execution.arrow.maxRecordsPerBatch", "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    got = []
    try:
        for rows in ("1000", "3"):
            spark.conf.set(name, rows)
            got.append(sorted(tuple(r) for r in corpus_pipeline.run(spark, sf).select("doc_id", "piece", "start", "length", "ids_crc32").collect()))
    finally:
        spark.conf.unset(name)
    assert docs.count() and got[0] == got[1]


def test_scores_hold_little_beside_the_texts():
    texts = pa.RecordBatch.from_arrays([pa.array([f"{BASE} {i}" * 15 for i in range(2000)])], names=["text"])
    weights = np.zeros(1 << subwords.Settings().bits, dtype=np.float32).tobytes()
    scored = subwords._scored(weights, 0.5, subwords.Settings(), "text", keep_text=True)
    tracemalloc.start()
    out = list(scored(iter([texts])))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert out[0].schema.names == ["text", "score"] and out[0].num_rows == 2000
    assert peak < 64_000_000


def test_run_is_the_chain_of_its_stages(spark):
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        rows = [tuple(r) for r in stage(spark, docs, sf).collect()]
        assert len(rows) == len({r[0] for r in rows}) and set(rows) <= {tuple(r) for r in docs.collect()}
        docs = spark.createDataFrame(rows, docs.schema)
    want = corpus_pipeline.STAGES[-1][1](spark, docs, sf).groupBy("doc_id").agg(F.sum("length").alias("n"))
    got = corpus_pipeline.run(spark, sf).groupBy("doc_id").agg(F.sum("length").alias("n"))
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


@pytest.mark.parametrize("sf", ["/root/testdata/sf0.001", SF])
def test_language_model_beats_its_base_on_held_out_documents(spark, sf):
    """Texts of very unequal lengths: the longest ones must not rule the end of training."""
    rows = queries.op3_lm_scoring(spark, sf).where("held_out").select("score", "base_score", "n_tokens").collect()
    assert sum(r.score for r in rows) > sum(r.base_score for r in rows)
