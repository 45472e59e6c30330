"""Quality rules, BPE, packing and near-duplicates against brute-force versions on small frames."""

from __future__ import annotations

import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from cohortspark.llm import bpe, neardup, packing, quality_rules, queries

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute_counts(text):
    text = text or ""
    words = WORD.findall(text)
    windows = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
    count = Counter(windows)
    covered = {i + k for i, w in enumerate(windows) if count[w] > 1 for k in range(5)}
    lines = [x for x in text.split("\n") if WORD.search(x)]
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered)


def test_quality_counts(spark, documents, nothing):
    more = ["a b c d e a b c d e a b", "x\nx\n\n \ny\nx", "# | <b> & $5 é é", "a b c d e f g h i j", "a a a a a a a"]
    rows = documents.select("doc_id", "text").unionByName(spark.createDataFrame([(100 + i, t) for i, t in enumerate(more)], "doc_id bigint, text string"))
    out = quality_rules.apply_rules(rows).collect()
    assert len(out) == rows.count()
    for r in out:
        got = (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"])
        assert got == brute_counts(r["text"]), r["text"]
        assert r["base_failed"] == (got[0] < 10 or 100 * got[4] > 20 * got[0]) and not (r["kept"] and r["base_failed"])
    assert quality_rules.apply_rules(nothing).count() == 0
    kept = quality_rules.keep(documents)
    assert kept.columns == documents.columns and {r["doc_id"] for r in kept.collect()} == {1, 2, 3}


def test_quality_plan_has_no_user_function(documents):
    plan = quality_rules.keep(documents)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Exchange" not in plan


@pytest.mark.parametrize("chunk, overlap", [(200, 60), (60_000, 4_000)])
def test_bpe_is_exact(spark, documents, nothing, chunk, overlap):
    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    whole = bpe.encoding(path, public_tokenizers.PATTERN)
    random.seed(1)
    bits = ["a", "b'll", "  ", "\n", " ", "é", "中", "\t", "'s", "12", " x", "\x00", "\x1c", "\xa0", "don't", "####", "　"]
    hard = [(1000 + i, "".join(random.choice(bits) for _ in range(random.choice([3, 30, 300, 2000])))) for i in range(60)]
    hard += [(2000, "a" * 3000), (2001, " " * 2000 + "x"), (2002, "x" + " \n" * 900), (2003, "w " * 700)]
    rows = documents.select("doc_id", "text", "score").unionByName(spark.createDataFrame(hard, "doc_id bigint, text string"), True)
    rows = rows.withColumn("ids", F.lit("clash"))
    out = bpe.decode(bpe.encode(rows, path, public_tokenizers.PATTERN, chunk=chunk, overlap=overlap), path, public_tokenizers.PATTERN)
    want = Counter((r["doc_id"], tuple(whole.encode_ordinary(r["text"] or ""))) for r in rows.collect())
    got = out.collect()
    assert Counter((r["doc_id"], tuple(r["ids"])) for r in got) == want
    texts = {r["doc_id"]: r["text"] or "" for r in rows.collect()}
    assert all(bytes(r["decoded"]) == texts[r["doc_id"]].encode() for r in got)
    assert bpe.encode(nothing, path, public_tokenizers.PATTERN).count() == 0


@pytest.mark.parametrize("seed, n", [(0, 0), (1, 1), (2, 60), (3, 3000)])
def test_packing_plan(seed, n):
    rng = np.random.default_rng(seed)
    lengths = np.clip(rng.lognormal(5.8, 1.0, n).astype(int), 1, 1024)
    segments = packing.plan(np.bincount(lengths, minlength=1025), 1024)
    used, placed = Counter(), defaultdict(list)
    for length, rank, times, first, offset in segments:
        assert rank == used[length]
        used[length] += times
        for k in range(times):
            placed[first + k].append((offset, length))
    assert used == Counter(lengths.tolist())
    for parts in placed.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 1024
    least = -(-int(lengths.sum()) // 1024)
    assert len(placed) <= least * 1.02 + 1


def test_packing_uses_complements():
    assert len({s[3] for s in packing.plan(np.bincount([600, 424, 500, 300, 224, 1024], minlength=1025), 1024)}) == 3
    with pytest.raises(ValueError):
        packing.plan(np.bincount([1025]), 1024)


def test_packed_documents(spark, documents, nothing):
    tok = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    special = spark.createDataFrame([(50, "a<|endoftext|> b  c")], "doc_id bigint, text string")
    rows = documents.where("doc_id is not null").select("doc_id", "text").dropDuplicates().unionByName(special)
    pieces = defaultdict(list)
    for r in queries.packed(rows).collect():
        pieces[r["doc_id"]].append(r)
    for r in rows.collect():
        ids, at = [*tok.encode(r["text"] or "", add_special_tokens=False).ids, 2], 0
        for k, p in enumerate(sorted(pieces[r["doc_id"]], key=lambda p: p["piece"])):
            assert (p["piece"], p["start"]) == (k, at) and (k == 0 or p["length"] == 1024)
            assert p["ids_crc32"] == zlib.crc32(np.array(ids[at : at + p["length"]], dtype="<u4").tobytes())
            at += p["length"]
        assert at == len(ids)
    assert queries.packed(nothing).count() == 0


def near(text, share, rng):
    words = text.split()
    for i in rng.choice(len(words), max(1, int(share * len(words))), replace=False):
        words[i] = f"n{rng.integers(1 << 40)}"
    return " ".join(words)


def test_neardup_classes(spark, documents, nothing):
    rng = np.random.default_rng(5)
    base = [" ".join(f"w{rng.integers(3000)}" for _ in range(200)) for _ in range(30)]
    rows, family = [], {}
    for k, text in enumerate(base):
        for j in range(6):
            rows.append((100 * k + j + 20, near(text, 0.005, rng) if j % 2 else text))
            family[rows[-1][0]] = k
        rows.append((100 * k + 70, near(text, 0.2, rng)))  # far from all
    # one bucket of many copies, and texts that share a long passage
    rows += [(10_000 + i, near(base[0], 0.005, rng)) for i in range(300)]
    rows += [(20_000 + i, base[1][:400] + " " + " ".join(f"u{rng.integers(1 << 30)}" for _ in range(150))) for i in range(100)]
    df = documents.select("doc_id", "text").unionByName(spark.createDataFrame(rows, "doc_id bigint, text string"))
    out = neardup.classes(df).collect()
    assert len(out) == df.count()
    got = {r["doc_id"]: r["class_id"] for r in out if r["doc_id"] is not None}
    for i, k in family.items():
        assert got[i] == 100 * k + 20, i
    assert all(got[10_000 + i] == 20 for i in range(300))
    assert all(got[100 * k + 70] == 100 * k + 70 for k in range(30))
    assert all(got[20_000 + i] == 20_000 + i for i in range(100))
    assert (got[1], got[2], got[3], got[4], got[5], got[6], got[7], got[8]) == (1, 1, 1, 4, 4, 6, 7, 7)
    assert neardup.classes(nothing).count() == 0


def test_neardup_tiles_find_what_leaders_miss(spark):
    """A chain: neighbours are similar, far members are not, so the leader alone does not join them."""
    rng = np.random.default_rng(9)
    words = [f"w{i}" for i in range(300)]
    rows = []
    for i in range(40):
        rows.append((i, " ".join(words)))
        for k in rng.choice(300, 4, replace=False):
            words[k] = f"n{i}x{k}"
    s = neardup.Settings(tile=8)
    out = neardup.classes(spark.createDataFrame(rows, "doc_id bigint, text string"), s=s).collect()
    assert {r["class_id"] for r in out} == {0}


def test_neardup_finds_long_near_copies_anywhere(spark):
    """Near copies of 50,000-word texts, at different places of a batch."""
    rng = np.random.default_rng(11)
    base = [" ".join(f"w{x}" for x in rng.integers(1 << 20, size=50_000)) for _ in range(4)]
    texts = [*base, *(near(b, 0.005, rng) for b in reversed(base))]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").coalesce(1)
    got = {r["doc_id"]: r["class_id"] for r in neardup.classes(df).collect()}
    assert got == {i: min(i, 7 - i) for i in range(8)}


def test_neardup_sample_ignores_the_order_of_shingles():
    """Also where hardly any random values are left, so that most minima tie."""
    s = neardup.Settings(table=2)
    rng = np.random.default_rng(12)
    found = rng.integers(1 << 63, size=500, dtype=np.uint64)
    text, weight = np.zeros(500, dtype=np.int64), np.ones(500)
    one = neardup.sample(text, found, weight, neardup._tables(s), s)[1]
    assert (one == neardup.sample(text, found[::-1], weight, neardup._tables(s), s)[1]).all()
