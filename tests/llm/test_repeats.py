"""Suffix arrays by induced sorting, and the removal of repeated strings against a brute-force version."""

from __future__ import annotations

import hashlib
import tracemalloc

import numpy as np
import pytest
from pyspark.sql import functions as F

from cohortspark.llm import repeats
from cohortspark.llm.induced import Plan, suffix_array
from cohortspark.llm.queries import op11_suffix_dedup


def plain_suffixes(text: list[int]) -> tuple[list[int], list[int]]:
    order, common = sorted(range(len(text)), key=lambda i: text[i:]), [0]
    for a, b in zip(order, order[1:], strict=False):
        n = 0
        while max(a, b) + n < len(text) and text[a + n] == text[b + n]:
            n += 1
        common.append(n)
    return order, common


@pytest.mark.parametrize("seed", range(4))
def test_suffix_array_with_prefixes(seed):
    """Random and periodic texts; small alphabets of names force digits, small arrays force mapped files."""
    rng = np.random.default_rng(seed)
    for trial in range(60):
        size = int(rng.choice([1, 2, 3, 10, 200]))
        text = rng.integers(1, size + 1, rng.integers(0, 120)).tolist()
        if trial % 3 == 0:
            text = (text[:7] * 30)[: len(text)]
        text, depth = [*text, 0], int(rng.choice([3, 10, 1 << 30]))
        plan = Plan(array=int(rng.choice([64, 1 << 20])), base=int(rng.choice([2, 3, 2048])))
        order, common = suffix_array(np.array(text), depth, plan)
        want, lengths = plain_suffixes(text)
        assert order.tolist() == want
        assert common.tolist() == [min(n, depth) for n in lengths]


@pytest.mark.parametrize("direct", [0, 5, 40])
def test_suffix_array_where_the_recursion_ends(direct):
    """Levels above and below the size that is ranked in memory give the same order and prefixes."""
    rng = np.random.default_rng(direct)
    for trial in range(60):
        text = rng.integers(1, int(rng.choice([2, 3, 10])) + 1, rng.integers(0, 120)).tolist()
        if trial % 3 == 0:
            text = (text[:7] * 30)[: len(text)]
        text, depth = [*text, 0], int(rng.choice([3, 10, 1 << 30]))
        plan = Plan(base=int(rng.choice([2, 3, 2048])), direct=direct)
        order, common = suffix_array(np.array(text), depth, plan)
        want, lengths = plain_suffixes(text)
        assert order.tolist() == want
        assert common.tolist() == [min(n, depth) for n in lengths]


def test_suffix_array_holds_few_bytes_a_character():
    """Passages that come back with small changes: the levels' arrays must not pile up."""
    rng = np.random.default_rng(4)
    passage = rng.integers(2, 60, 600)
    text = np.tile(passage, 400)
    text[rng.integers(0, len(text), len(text) // 300)] = 61
    text = np.append(text, 0).astype(np.int32)
    tracemalloc.start()
    suffix_array(text, 100)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 75 * len(text)


def brute(rows: list[tuple], n: int) -> list[tuple]:
    """Rows (id, text) as the operator reports them; documents in order of id (none last) and of their texts' hash."""
    seen, out = set(), []
    for key, text in rows:
        raw = (text or "").encode()
        gone = bytearray(len(raw))
        for p in range(len(raw) - n + 1):
            if raw[p : p + n] in seen:
                gone[p : p + n] = b"\1" * n
            seen.add(raw[p : p + n])
        kept = bytes(b for b, g in zip(raw, gone, strict=True) if not g)
        spans = sum(g and not (i and gone[i - 1]) for i, g in enumerate(gone))
        out.append((key, len(raw), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


def found(df) -> list[tuple]:
    rows = df.select("doc_id", "n_bytes", "n_removed", F.size("spans"), "kept_sha256").collect()
    return sorted((tuple(r) for r in rows), key=str)


def some_texts(rng, n: int) -> list[str]:
    words = ["".join(rng.choice(list("abcdeé"), rng.integers(1, 6))) for _ in range(60)]
    line = " ".join(words[:9])
    out = []
    for _ in range(n):
        parts = [" ".join(rng.choice(words, rng.integers(1, 60))) for _ in range(rng.integers(1, 4))]
        if rng.random() < 0.4:
            parts.insert(1, line)
        if out and rng.random() < 0.4:  # a near copy
            old = out[int(rng.integers(len(out)))]
            at = int(rng.integers(len(old)))
            parts = [old[:at] + "#" + old[at + 1 :]]
        out.append(" ".join(parts))
    return out


@pytest.mark.parametrize("hot", [1e9, 1e-6])
def test_removed_bytes_on_random_texts(spark, hot):
    """Also with all frequent grams avoided as anchors, small steps that cut texts, and several shards."""
    rng = np.random.default_rng(5)
    texts = some_texts(rng, 120)
    rows = [(i * 3 - 40, t) for i, t in enumerate([*texts, *texts[:9], "ab" * 300, "x" * 500, "x" * 99])]
    s = repeats.Settings(shard=4000, sorted=3000, step=300, held=40, hot=hot, length=40, gram=13)
    df = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(5)
    assert found(repeats.remove_repeats(df, s=s)) == brute(rows, 40)


def test_nulls_repeated_rows_and_clashing_columns(spark):
    text = "once upon a time there was a text of more than a hundred bytes, which was long enough to be looked at by this operator."
    rows = [(1, text), (1, text), (None, text), (2, None), (3, ""), (4, "short"), (None, None), (0, text[5:])]
    df = spark.createDataFrame([(*r, "k", 1, 2) for r in rows], "doc_id bigint, text string, tie string, key int, id int")
    want = brute(sorted(rows, key=lambda r: (r[0] is None, r[0] or 0)), 100)
    assert found(repeats.remove_repeats(df)) == want
    assert found(repeats.remove_repeats(df.limit(0))) == []


def test_one_id_with_two_texts(spark):
    """Counted as two documents: what they share goes from one of them only."""
    a = "the quick brown fox jumps over the lazy dog and runs through the forest until it is dark and all is quiet again now"
    df = spark.createDataFrame([(7, a + " one"), (7, "two " + a)], "doc_id bigint, text string")
    got = repeats.remove_repeats(df).collect()
    assert sorted(r.n_removed for r in got) == [0, len(a)]


def test_a_very_long_text(spark):
    rng = np.random.default_rng(1)
    body = "".join(rng.choice(list("abcdefgh "), 3_000_000))
    rows = [(1, body), (2, body[1_500_000:1_600_000] + "!" + body[:200_000])]
    got = {r.doc_id: r for r in repeats.remove_repeats(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    assert got[1].n_removed == 0
    assert [(s.begin, s.end) for s in got[2].spans] == [(0, 100_000), (100_001, 300_001)]


def test_query_on_the_table(spark):
    rows = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").orderBy("doc_id").collect()
    got = sorted((tuple(r) for r in op11_suffix_dedup(spark, "/root/testdata/sf0.001").collect()), key=str)
    assert got == brute([tuple(r) for r in rows], 100)


def test_a_scan_holds_and_sends_bounded_parts(monkeypatch):
    """Texts are copied out of a batch in parts, a numpy step stays near its size, and a shard's places go out in several rows."""
    import pyarrow as pa

    rng = np.random.default_rng(4)
    texts = ["".join(rng.choice(list("abcdefgh "), 400)) for _ in range(60)] + ["x" * 30_000]
    batch = pa.record_batch([pa.array(range(len(texts)), pa.int64()), pa.array([0] * len(texts), pa.int64()), pa.array(texts)], names=["id", "tie", "text"])
    read, steps = [], []
    part, regions = repeats._scanned_part, repeats.regions
    monkeypatch.setattr(repeats, "_scanned_part", lambda b, *more: read.append(b.num_rows) or part(b, *more))
    monkeypatch.setattr(repeats, "regions", lambda raw, *more: steps.append(len(raw)) or regions(raw, *more))

    def places(s):
        sent = list(repeats._sent(2, b"", s)(iter([batch])))
        rows = [(r["shard"], repeats._unpacked(r["data"])) for b in sent for r in b.to_pylist() if r["kind"] == 0]
        return sorted((shard, *p) for shard, data in rows for p in data.tolist()), max(len(data) for _, data in rows)

    whole, _ = places(repeats.Settings())
    read.clear(), steps.clear()
    s = repeats.Settings(step=4_000, read=5_000, row=50)
    cut, most = places(s)
    assert most <= s.row and max(steps) <= s.step + s.length and len(read) > 4
    # a long text is cut, and its windows stay the same
    assert len(whole) > 10 * s.row and {p[0] for p in cut} == {0, 1}
    short = [p for p in whole if p[3] < 60]
    assert short == [p for p in cut if p[3] < 60]


def test_a_shard_unpacks_places_of_repeated_anchors_only(monkeypatch):
    import pyarrow as pa

    def row(places):
        r = np.array(places, dtype=repeats.PACKED)
        return b"".join(np.ascontiguousarray(r[n]).tobytes() for n, _ in repeats.FIELDS)

    # (anchor, region, id, tie, start, many, lead): 1 twice alike, 2 twice with two regions, 3, 4 and 5 once
    first = [(1, 10, 0, 0, 0, 3, 1), (2, 20, 0, 0, 50, 3, 1), (3, 30, 0, 0, 90, 3, 1)]
    second = [(1, 10, 1, 0, 7, 3, 1), (2, 21, 1, 0, 60, 3, 1), (4, 40, 1, 0, 95, 3, 1), (5, 40, 1, 0, 99, 3, 1)]
    sizes, combined = [], repeats.combined
    monkeypatch.setattr(repeats, "combined", lambda rows: sizes.append(len(rows)) or combined(rows))
    out = repeats._matched(pa.table({"shard": [0, 0], "data": pa.array([row(first), row(second)], pa.binary())}))
    assert sizes == [4]
    got = [(r["kind"], r["id"], np.frombuffer(r["data"], dtype=repeats.ENTRY)["start"].tolist()) for r in out.to_pylist()]
    assert sorted(got) == [(1, 1, [7]), (2, 0, [50]), (2, 1, [60])]
