"""Near-duplicates by improved consistent weighted sampling over TF-IDF shingles.

A text is the weighted set of its five-word shingles: term frequency times a damped inverse document frequency. The exact document
frequency n of every shingle counts that is found in at least a share of the corpus (one part in ``heavy`` of all its shingles, so there are
at most ``heavy`` such); rarer ones all weigh as if found at that share, ``1 + damping``, and one found in all documents weighs 1. The
frequencies take two passes without a shuffle of shingles: a sketch of counts from above that leaves none of them out, then the exact counts of
those that it admits. Each text draws ``bands * rows`` consistent samples; texts that agree on all samples of a band
share a bucket and are candidates. Exact copies are found by their digest and need no candidates.

Candidates are not expanded to all pairs of a bucket. First each text is compared with one leader, the smallest text of all its buckets,
and classes are merged; a bucket of thousands of copies then is one class and done. Then come the leaders of its other buckets, as far as the
classes still differ. In buckets that still hold several classes, all texts of different classes are compared in tiles of bounded
size inside tasks, by a sketch that bounds the similarity from above: weights summed in hashed
groups. Only pairs that pass the bound become rows. Every passing pair is verified by weighted Jaccard similarity on the whole texts, so no
candidate link between two classes stays untested. Classes are connected components, by label propagation with pointer jumping over
written tables.

Defined results: null texts count as empty; copies (repeated rows, too) share a class; a text without words equals only
its copies; a text of fewer than five words is one shingle; a row without id gets the smallest id of its class, if any; an id may stand for
several texts, each of which is compared; other columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cohortspark.llm.common import PARTS, added, blocks
from cohortspark.llm.textnum import Texts, mix, pieces
from cohortspark.operators.relational import heavy_join
from cohortspark.session import staged

_PARTS = pa.schema([("part", pa.int32()), ("block", pa.int32()), ("data", pa.binary())])
_COUNTS = pa.schema([("shingle", pa.int64()), ("n", pa.int64())])


@dataclass(frozen=True)
class Settings:
    words: int = 5
    similarity: float = 0.8
    bands: int = 20
    rows: int = 5
    seed: int = 5
    #: most shingles that weigh less than the rare ones, entries of the sketch that finds them, weight of a rare shingle over 1
    heavy: int = 1 << 16
    counters: int = 1 << 18
    damping: float = 0.25
    #: entries of the random tables of the samples, groups of a sketch, texts of a tile
    table: int = 1 << 14
    groups: int = 256
    tile: int = 256
    #: texts that meet one copy of their partner
    group: int = 32
    #: ids of texts to read again are sent to all tasks up to this number, else joined
    sent: int = 2_000_000


def places(texts: Texts, s: Settings) -> tuple[np.ndarray, np.ndarray]:
    """(text, hash) of the shingles at all their places."""
    text, found = texts.windows(s.words)
    short = np.flatnonzero((texts.n_words > 0) & (texts.n_words < s.words))
    if len(short):  # the whole text is one shingle
        words, first = texts.words, texts.first_word
        whole = [mix(np.add.reduce(words[first[i] : first[i + 1]] * np.arange(1, first[i + 1] - first[i] + 1, dtype=np.uint64), keepdims=True) + np.uint64(first[i + 1] - first[i])) for i in short]
        text, found = np.concatenate([text, short]), np.concatenate([found, *whole])
    return text, found


def _once(text: np.ndarray, found: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(where each shingle of each text stands first, how often it does), texts in order."""
    # one sort by a key that mixes in the text; the keys of a text are put together again after it
    key = mix(found + text.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))
    _, at, tf = np.unique(key, return_index=True, return_counts=True)
    order = np.argsort(text[at], kind="stable")
    return at[order], tf[order]


def shingles(texts: Texts, s: Settings) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, hash, term frequency) of the shingles, each once per text, texts in order."""
    text, found = places(texts, s)
    at, tf = _once(text, found)
    return text[at], found[at], tf


def _bucket(hashes: np.ndarray, size: int) -> np.ndarray:
    """Places in a table of ``size``, a power of two."""
    return (hashes >> np.uint64(65 - size.bit_length())).astype(np.int64)


@dataclass(frozen=True)
class Rarity:
    """Weights of shingles: those of ``hashes`` (sorted) have their own, all others ``rare``."""

    hashes: np.ndarray
    weights: np.ndarray
    rare: float

    def of(self, found: np.ndarray) -> np.ndarray:
        out = np.full(len(found), self.rare, dtype=np.float32)
        if len(self.hashes):
            known = np.zeros(1 << 20, dtype=bool)  # a quick test before the exact search
            known[_bucket(self.hashes, len(known))] = True
            may = np.flatnonzero(known[_bucket(found, len(known))])
            at = np.searchsorted(self.hashes, found[may]).clip(0, len(self.hashes) - 1)
            hit = self.hashes[at] == found[may]
            out[may[hit]] = self.weights[at[hit]]
        return out


def _tallied(s: Settings):
    """Shingles by bucket at all their places, summed over what a task reads: never less than a shingle's documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(s.counters, dtype=np.int64)
        for batch in batches:
            column = batch.column(0)
            for a, b in pieces(column):
                _, found = places(Texts.of(column.slice(a, b - a)), s)
                total += np.bincount(_bucket(found, s.counters), minlength=s.counters)
        yield pa.RecordBatch.from_pandas(blocks(total, TaskContext.get().partitionId(), kind=np.float32), _PARTS, preserve_index=False)

    return run


def _counted(admitted: bytes, s: Settings):
    """Document frequencies of the admitted shingles in what a task reads."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        open_ = np.unpackbits(np.frombuffer(admitted, dtype=np.uint8)).astype(bool)
        keys, n = np.zeros(0, dtype=np.uint64), np.zeros(0, dtype=np.int64)
        held: list[np.ndarray] = []

        def put_together() -> None:
            nonlocal keys, n
            more, count = np.unique(np.concatenate(held), return_counts=True)
            keys, at = np.unique(np.concatenate([keys, more]), return_inverse=True)
            n = np.bincount(at, np.concatenate([n, count]), len(keys)).astype(np.int64)
            held.clear()

        for batch in batches:
            column = batch.column(0)
            for a, b in pieces(column):
                text, found = places(Texts.of(column.slice(a, b - a)), s)
                some = open_[_bucket(found, s.counters)]
                text, found = text[some], found[some]
                held.append(found[_once(text, found)[0]])
                if sum(map(len, held)) > 1_000_000:
                    put_together()
        if held:
            put_together()
        yield pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), pa.array(n)], schema=_COUNTS)

    return run


def rarity(docs: DataFrame, text: str, documents: int, s: Settings = Settings()) -> Rarity:
    """1 + damping * ln((N+1)/(n+1)) / ln((N+1)/(m+1)), from 1 to 1 + damping: the shingle's documents n of N, at least the share m.

    ``m`` is the places of all shingles over ``heavy`` (at least 1). At most ``heavy`` shingles have m documents or more; their exact counts
    reach the driver and all tasks.
    """
    texts = docs.select(F.coalesce(F.col(f"`{text}`"), F.lit("")))
    total = added(texts.mapInArrow(_tallied(s), PARTS), kind=np.float32)
    share = max(1.0, float(total.sum(dtype=np.float64)) / s.heavy)
    # sums of 32-bit numbers may fall short by some parts in ten million
    admitted = total >= share * (1 - 1e-4) if len(total) else np.zeros(s.counters, dtype=bool)
    counts = texts.mapInArrow(_counted(np.packbits(admitted).tobytes(), s), "shingle bigint, n bigint")
    rows = counts.groupBy("shingle").agg(F.sum("n").alias("n")).where(F.col("n") >= share).toPandas()
    hashes, n = rows["shingle"].to_numpy(dtype=np.int64).view(np.uint64), rows["n"].to_numpy(dtype=np.float64)
    order = np.argsort(hashes)
    most = max(np.log((documents + 1) / (share + 1)), np.log(2))
    weights = 1 + s.damping * (np.log((documents + 1) / (n + 1)) / most).clip(0, 1)
    return Rarity(hashes[order], weights[order].astype(np.float32), 1 + s.damping)


def _tables(s: Settings) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Per sample: multipliers, and tables of r, ln c and beta, each read by bits of its own of the hashed shingle."""
    rng = np.random.default_rng(s.seed)
    shape = (s.bands * s.rows, s.table)
    r = rng.gamma(2, 1, shape).astype(np.float32).clip(1e-3)
    lnc = np.log(rng.gamma(2, 1, shape)).astype(np.float32)
    beta = rng.uniform(0, 1, shape).astype(np.float32)
    odd = rng.integers(0, 2**63, shape[0], dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    return odd, r, lnc, beta


def sample(text: np.ndarray, found: np.ndarray, weight: np.ndarray, tables, s: Settings) -> tuple[np.ndarray, np.ndarray]:
    """(texts with shingles, their band keys): consistent samples (shingle, quantised weight), hashed per band.

    r, ln c and beta come from three tables by separate bits, so shingles of a long text hardly ever tie; a tie goes to the smallest hash,
    since the order of the shingles depends on where the text stands.
    """
    odd, r, lnc, beta = tables
    if not len(text):
        return np.zeros(0, dtype=np.int64), np.zeros((0, s.bands), dtype=np.uint64)
    begins = np.append(True, text[1:] != text[:-1])
    first, owner = np.flatnonzero(begins), np.cumsum(begins) - 1
    lnw = np.log(weight).astype(np.float32)
    width = int(s.table).bit_length() - 1
    shifts, mask = [np.uint64(64 - width * i) for i in (1, 2, 3)], np.uint64(s.table - 1)
    keys = np.zeros((len(first), s.bands), dtype=np.uint64)
    for k in range(s.bands * s.rows):
        bits = found * odd[k]
        rk = r[k][(bits >> shifts[0]).astype(np.int32)]
        bk = beta[k][((bits >> shifts[1]) & mask).astype(np.int32)]
        t = np.floor(lnw / rk + bk)
        a = lnc[k][((bits >> shifts[2]) & mask).astype(np.int32)] - rk * (t - bk + 1)
        least = np.minimum.reduceat(a, first)
        hit = np.flatnonzero(a == least[owner])
        if len(hit) > len(first):
            hit = hit[np.lexsort((found[hit], owner[hit]))]
        hit = hit[np.append(True, owner[hit[1:]] != owner[hit[:-1]])]
        drawn = mix(found[hit] + t[hit].astype(np.int64).astype(np.uint64) * np.uint64(0xA24BAED4963EE407))
        band = k // s.rows
        keys[:, band] = mix(keys[:, band] * np.uint64(31) + drawn + np.uint64(band))
    return text[first], keys


def _signed(idf: Rarity, s: Settings):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables = _tables(s)
        for batch in batches:
            column = batch.column(2)
            for a, b in pieces(column, 1_500_000):
                text, found, tf = shingles(Texts.of(column.slice(a, b - a)), s)
                rows, keys = sample(text, found, tf * idf.of(found), tables, s)
                sizes = np.zeros(b - a, dtype=np.int32)
                sizes[rows] = s.bands
                bands = pa.ListArray.from_arrays(
                    pa.array(np.append(0, np.cumsum(sizes)).astype(np.int32)), pa.array(keys.ravel().view(np.int64))
                )
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(a, b - a), batch.column(1).slice(a, b - a), bands], names=["id", "digest", "bands"]
                )

    return run


def _sketched(idf: Rarity, s: Settings):
    """Per text: shingle weights summed in hashed groups, rounded up."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, column = batch.column(0), batch.column(1)
            for a, b in pieces(column):
                text, found, tf = shingles(Texts.of(column.slice(a, b - a)), s)
                at = text * s.groups + (found % np.uint64(s.groups)).astype(np.int64)
                total = np.bincount(at, tf * idf.of(found), (b - a) * s.groups).clip(0, 60_000)
                low = total.astype(np.float16)
                up = np.where(low < total, np.nextafter(low, np.float16(np.inf)), low).reshape(b - a, s.groups)
                yield pa.RecordBatch.from_arrays(
                    [ids.slice(a, b - a), pa.array([r.tobytes() for r in up], pa.binary())], names=["id", "sketch"]
                )

    return run


def _may(one: np.ndarray, many: np.ndarray, similarity: float) -> np.ndarray:
    """Whether the similarity can reach the bound: common weight is at most the sum of the groups' smaller weights.

    A group at the sketch's ceiling says nothing, so it passes.
    """
    common = np.minimum(one, many).sum(axis=-1)
    whole = one.sum(axis=-1) + many.sum(axis=-1) - common
    # sums of rounded-up weights overstate the whole by one part in a thousand at most
    return (common >= similarity * whole * (1 - 2e-3)) | (one.max(axis=-1) >= 60_000) | (many.max(axis=-1) >= 60_000)


def _vectors(column: pa.Array, s: Settings) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), dtype=np.float16).reshape(-1, s.groups).astype(np.float32)


def _bounded(s: Settings):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                ok = _may(_vectors(batch.column(2), s), _vectors(batch.column(3), s), s.similarity)
                yield batch.select([0, 1]).filter(pa.array(ok))

    return run


def _tiled(s: Settings):
    """Pairs of different classes that pass the bound, per group of rows with one ``tiles`` value; groups come sorted.

    A pair is returned in the first band that it shares, so a pair of many shared buckets is one row. (If one of the two leads that
    bucket, the pair has been compared already.)
    """

    def pairs(rows: pd.DataFrame) -> tuple[list, list]:
        vectors = np.frombuffer(b"".join(rows["sketch"]), dtype=np.float16).reshape(-1, s.groups).astype(np.float32)
        ids, label, leads, side = (rows[c].to_numpy() for c in ("id", "label", "leads", "side"))
        mixed = bool(rows["mixed"].iloc[0])  # two tiles, or one tile with itself
        band, bands = int(rows["band"].iloc[0]), np.stack(rows["bands"].to_numpy())
        left = np.flatnonzero(~leads & (side == 0)) if mixed else np.flatnonzero(~leads)
        right = np.flatnonzero(~leads & (side == 1)) if mixed else left
        a, b = [], []
        for i in left:
            others = right[label[right] != label[i]]
            if not mixed:
                others = others[others > i]
            if band and len(others):
                others = others[~(bands[others, :band] == bands[i, :band]).any(axis=1)]
            if len(others):
                others = others[_may(vectors[i], vectors[others], s.similarity)]
                a += np.minimum(ids[i], ids[others]).tolist()
                b += np.maximum(ids[i], ids[others]).tolist()
        return a, b

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rest: pd.DataFrame | None = None
        for batch in batches:
            batch = batch if rest is None else pd.concat([rest, batch], ignore_index=True)
            if not len(batch):
                continue
            cut = batch["tiles"].to_numpy()
            first = np.flatnonzero(np.append(True, cut[1:] != cut[:-1]))
            for x, y in zip(first[:-1], first[1:], strict=True):
                if y - x > 1:
                    yield pd.DataFrame(dict(zip("ab", pairs(batch.iloc[x:y]), strict=True)))
            rest = batch.iloc[first[-1] :].reset_index(drop=True)
        if rest is not None and len(rest) > 1:
            yield pd.DataFrame(dict(zip("ab", pairs(rest), strict=True)))

    return run


def _similar_sets(text: np.ndarray, found: np.ndarray, weight: np.ndarray, n: int, similarity: float) -> np.ndarray:
    """Whether the two weighted sets of each pair are similar; entries are (pair, shingle, weight), a shingle at most once a side."""
    order = np.lexsort((found, text))
    text, found, weight = text[order], found[order], weight[order]
    both = np.flatnonzero((text[1:] == text[:-1]) & (found[1:] == found[:-1]))
    common = np.bincount(text[both], np.minimum(weight[both], weight[both + 1]), n)
    whole = np.bincount(text, weight, n) - common
    return (whole > 0) & (common >= similarity * whole * (1 - 1e-6))


def _verifying(idf: Rarity, s: Settings):
    """The similar pairs of rows (a, part, id, text) sorted by (a, part, lead first): each text against the last lead before it.

    A lead's shingles are computed once for all the texts that follow it; they are carried over to the next batch.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        carried = (np.zeros(0, dtype=np.uint64), np.zeros(0, dtype=np.float32))
        for whole in batches:
            for x, y in pieces(whole.column(whole.schema.get_field_index("text"))):
                part = whole.slice(x, y - x)
                a, ids, lead = (part.column(part.schema.get_field_index(c)).to_numpy(zero_copy_only=False) for c in ("a", "id", "lead"))
                text, found, tf = shingles(Texts.of(part.column(part.schema.get_field_index("text"))), s)
                weight = (tf * idf.of(found)).astype(np.float64)
                first = np.searchsorted(text, np.arange(len(ids) + 1))
                # row 0 stands for the carried lead
                found, weight = np.concatenate([carried[0], found]), np.concatenate([carried[1], weight])
                begin = np.append(0, first[:-1] + len(carried[0]))
                many = np.append(len(carried[0]), np.diff(first))
                own = np.maximum.accumulate(np.where(lead, np.arange(1, len(ids) + 1), 0))
                rows = np.flatnonzero(~lead)
                if len(rows):
                    sides = np.concatenate([rows + 1, own[rows]])
                    n = many[sides]
                    at = np.repeat(begin[sides] - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))
                    pair = np.repeat(np.tile(np.arange(len(rows)), 2), n)
                    ok = rows[_similar_sets(pair, found[at], weight[at], len(rows), s.similarity)]
                    yield pa.RecordBatch.from_arrays([pa.array(a[ok], pa.int64()), pa.array(ids[ok], pa.int64())], names=["a", "b"])
                last = int(own[-1])
                carried = tuple(v[begin[last] : begin[last] + many[last]].copy() for v in (found, weight))

    return run


def components(edges: DataFrame, most: int = 60) -> DataFrame:
    """(id, label): the smallest id connected to each id of ``edges`` (a, b), a written table."""
    both = staged(edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    labels = staged(both.groupBy(F.col("a").alias("id")).agg(F.least(F.first("a"), F.min("b")).alias("label")))
    for _ in range(most):
        near = both.join(labels.withColumnsRenamed({"id": "b", "label": "other"}), "b")
        least = near.groupBy(F.col("a").alias("id")).agg(F.min("other").alias("other"))
        moved = labels.join(least, "id").select("id", "label", F.least("label", "other").alias("low"))
        # pointer jumping: take over the label of one's label
        jump = labels.select(F.col("id").alias("low"), F.col("label").alias("far"))
        moved = staged(moved.join(jump, "low", "left").select("id", "label", F.least("low", F.coalesce("far", "low")).alias("new")))
        changed = moved.where("new <> label").limit(1).count()
        labels = moved.select("id", F.col("new").alias("label"))
        if not changed:
            return labels
    raise RuntimeError("the components did not settle")


def roots(parents: DataFrame, most: int = 60) -> DataFrame:
    """(id, label): the root of each id of a forest (id, parent), parents being smaller; a written table.

    Pointer jumping halves every way to the root, and a step joins one row per id.
    """
    labels = staged(parents.select("id", F.col("parent").alias("label")))
    for _ in range(most):
        jump = labels.select(F.col("id").alias("label"), F.col("label").alias("far"))
        moved = staged(labels.join(jump, "label", "left").select("id", "label", "far"))
        going = moved.where("far is not null").limit(1).count()
        labels = moved.select("id", F.coalesce("far", "label").alias("label"))
        if not going:
            return staged(labels.unionByName(labels.select(F.col("label").alias("id"), "label").distinct()))
    raise RuntimeError("the forest did not settle")


def merged(labels: DataFrame, edges: DataFrame) -> DataFrame:
    """The labels after the classes that ``edges`` (a, b) connect became one; only edges between classes are walked."""
    between = staged(_apart(edges, labels, True).distinct())
    if not between.limit(1).count():
        return labels
    new = components(between).select(F.col("id").alias("label"), F.col("label").alias("new"))
    known = labels.join(new, "label", "left").select("id", F.coalesce("new", "label").alias("label"))
    lone = new.join(labels.select(F.col("id").alias("label")), "label", "left_anti").select(F.col("label").alias("id"), F.col("new").alias("label"))
    return staged(known.unionByName(lone))


def _verified(pairs: DataFrame, texts: DataFrame, idf: Rarity, s: Settings) -> DataFrame:
    """The pairs (a, b) that are similar, by their whole texts; a written table.

    Texts are dealt to their partner ``a`` in parts of about ``s.group`` texts, so a text travels once per pair and the partner's once
    per part, and a partner of very many texts is no single group.
    """
    pairs = staged(pairs.select("a", "b"))
    parts = pairs.groupBy("a").agg(F.ceil(F.count("*") / s.group).cast("int").alias("parts"))
    dealt = pairs.join(parts, "a").select("a", F.pmod(F.xxhash64("b"), F.col("parts")).cast("int").alias("part"), F.col("b").alias("id"), F.lit(False).alias("lead"))
    leads = parts.select("a", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), F.col("a").alias("id"), F.lit(True).alias("lead"))
    rows = dealt.unionByName(leads).join(texts, "id").select("a", "part", "lead", "id", "text")
    met = rows.repartition("a", "part").sortWithinPartitions("a", "part", F.desc("lead"))
    return staged(met.mapInArrow(_verifying(idf, s), "a bigint, b bigint"))


def _may_match(pairs: DataFrame, sketches: DataFrame, s: Settings) -> DataFrame:
    """The pairs whose sketches allow the similarity."""
    one = sketches.select(F.col("id").alias("a"), F.col("sketch").alias("sketch_a"))
    two = sketches.select(F.col("id").alias("b"), F.col("sketch").alias("sketch_b"))
    held = pairs.join(one, "a").join(two, "b").select("a", "b", "sketch_a", "sketch_b")
    return held.mapInArrow(_bounded(s), held.select("a", "b").schema)


def _apart(pairs: DataFrame, labels: DataFrame, as_labels: bool = False) -> DataFrame:
    """The pairs whose texts are of different classes, as texts or as their classes."""
    one = labels.withColumnsRenamed({"id": "a", "label": "label_a"})
    two = labels.withColumnsRenamed({"id": "b", "label": "label_b"})
    both = pairs.join(one, "a", "left").join(two, "b", "left")
    both = both.withColumns({"label_a": F.coalesce("label_a", "a"), "label_b": F.coalesce("label_b", "b")}).where("label_a <> label_b")
    return both.select(F.col("label_a").alias("a"), F.col("label_b").alias("b")) if as_labels else both.select("a", "b")


def _with_leaders(entries: DataFrame, texts: DataFrame, sketches: DataFrame, idf: Rarity, s: Settings) -> DataFrame:
    """Labels after every text was compared with the leaders of its buckets, as far as their classes differ.

    First each text meets one leader, the smallest of all its buckets, which joins most groups at once; these links are a forest.
    Later rounds only hold pairs whose classes still differ, and while a text has many of those left it again meets one at a time.
    """
    leaders = entries.where("id <> leader").select(F.col("leader").alias("a"), F.col("id").alias("b"))
    first = staged(leaders.groupBy("b").agg(F.min("a").alias("a")).select("a", "b"))
    labels = roots(_verified(first, texts, idf, s).select(F.col("b").alias("id"), F.col("a").alias("parent")))
    # a bucket whose texts are all of one class asks nothing more, so its pairs are never made
    placed = entries.join(labels, "id", "left").withColumn("label", F.coalesce("label", "id"))
    open_ = placed.groupBy("key").agg(F.min("label").alias("low"), F.max("label").alias("high")).where("low <> high").select("key")
    left = entries.join(open_, "key", "left_semi").where("id <> leader").select(F.col("leader").alias("a"), F.col("id").alias("b")).distinct()
    left = staged(_apart(left.join(first, ["a", "b"], "left_anti"), labels))
    while True:
        n, texts_left = left.agg(F.count("*"), F.countDistinct("b")).first()
        if not n:
            return labels
        last = n <= 2 * texts_left
        now = left if last else staged(left.groupBy("b").agg(F.min("a").alias("a")).select("a", "b"))
        labels = merged(labels, _verified(_may_match(now, sketches, s), texts, idf, s))
        if last:
            return labels
        left = staged(_apart(left.join(now, ["a", "b"], "left_anti"), labels))


def _across(entries: DataFrame, labels: DataFrame, sketches: DataFrame, s: Settings) -> DataFrame:
    """Pairs of different classes inside the buckets, but for those with the leader, where the bound allows it.

    A class of more than a tile's texts in a bucket has tiles of its own, which meet only tiles of other classes; small classes
    share tiles. So a stray text in a bucket of one large class meets each of that class's texts once.
    """
    placed = staged(entries.join(labels, "id", "left").withColumn("label", F.coalesce("label", "id")))
    sizes = placed.groupBy("key", "label").agg(F.count("*").alias("n"))
    mixed = sizes.groupBy("key").agg(F.min("label").alias("low"), F.max("label").alias("high"), F.sum("n").alias("all")).where("low <> high and all > 2")
    sizes = staged(sizes.join(mixed.select("key"), "key", "left_semi"))
    small = F.coalesce(F.sum(F.when(F.col("n") <= s.tile, F.col("n"))), F.lit(0))
    own_tiles = F.when(F.col("n") > s.tile, F.ceil(F.col("n") / s.tile)).otherwise(0)
    keys = sizes.groupBy("key").agg(F.ceil(small / s.tile).cast("int").alias("shared"), F.sum(own_tiles).cast("int").alias("owned"))
    # large classes of a bucket one after the other; there are at most its texts over a tile's
    large = sizes.where(F.col("n") > s.tile).withColumn("many", F.ceil(F.col("n") / s.tile).cast("int"))
    before = F.coalesce(F.sum("many").over(Window.partitionBy("key").orderBy("label").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    large = large.select("key", "label", "many", before.cast("int").alias("before"))
    rows = placed.join(keys, "key").join(large, ["key", "label"], "left").join(sketches, "id")
    first = F.when(F.col("many").isNull(), 0).otherwise(F.col("shared") + F.col("before"))
    rows = rows.withColumn("first", first).withColumn("own", F.col("first") + F.pmod(F.xxhash64("id"), F.coalesce("many", "shared")).cast("int"))
    # a text meets every tile but those of its own large class
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("shared") + F.col("owned") - 1)))
    rows = rows.where(F.col("many").isNull() | (F.col("other") < F.col("first")) | (F.col("other") >= F.col("first") + F.col("many")))
    low, high = F.least("own", "other"), F.greatest("own", "other")
    rows = rows.select(
        F.xxhash64("key", low, high).alias("tiles"),
        "id",
        "label",
        (F.col("id") == F.col("leader")).alias("leads"),
        (F.col("own") > low).cast("int").alias("side"),
        (low < high).alias("mixed"),
        "band",
        "bands",
        "sketch",
    )
    sorted_ = rows.repartition("tiles").sortWithinPartitions("tiles")
    return sorted_.mapInPandas(_tiled(s), "a bigint, b bigint").distinct()


def links(nodes: DataFrame, docs: DataFrame, idf: Rarity, s: Settings = Settings()) -> DataFrame | None:
    """(id, label) of all nodes with a similar other text; ``nodes`` holds (node, digest, bands), ``docs`` (digest, text)."""
    signed = nodes.select(F.col("node").alias("id"), "bands")
    entries = signed.select("id", F.posexplode("bands").alias("band", "key")).select(F.xxhash64("band", "key").alias("key"), "band", "id")
    # only buckets with several texts matter from here on
    shared = entries.groupBy("key").agg(F.min("id").alias("leader"), F.max("id").alias("last")).where("leader < last")
    entries = staged(entries.join(shared.select("key", "leader"), "key").distinct())
    ids = staged(entries.select("id").distinct())
    n = ids.count()
    if not n:
        return None
    wanted = nodes.join(ids.withColumnRenamed("id", "node"), "node", "left_semi").select("digest", F.col("node").alias("id"))
    held = docs.join(F.broadcast(wanted) if n <= s.sent else wanted, "digest").select("id", "text")
    texts = staged(held.groupBy("id").agg(F.first("text").alias("text")))
    sketches = staged(texts.mapInArrow(_sketched(idf, s), "id bigint, sketch binary"))
    labels = _with_leaders(entries, texts, sketches, idf, s)
    wider = sketches.join(signed, "id")
    return merged(labels, _verified(_across(entries, labels, wider, s), texts, idf, s))


def families(docs: DataFrame, key: str = "doc_id", text: str = "text", s: Settings = Settings()) -> DataFrame:
    """(id, digest, family, class_id) per row: a number for each group of connected texts, and the smallest id in it.

    Texts, not ids, are connected: every text has a number of its own, so ids may be missing or stand for several texts.
    """
    rows = docs.select(F.col(f"`{key}`").alias("id"), F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("text"))
    rows = rows.withColumn("digest", F.md5("text"))
    idf = rarity(rows, "text", rows.count(), s)
    kind = rows.schema["id"].dataType.simpleString()
    signed = rows.select("id", "digest", "text").mapInArrow(
        _signed(idf, s), f"id {kind}, digest string, bands array<bigint>"
    )
    signed = staged(signed)
    nodes = signed.groupBy("digest").agg(F.min("id").alias("low"), F.first("bands").alias("bands"))
    nodes = staged(nodes.withColumn("node", F.monotonically_increasing_id()))
    found = links(nodes.select("node", "digest", "bands"), rows.select("digest", "text"), idf, s)
    known = nodes.select("node", "digest", "low")
    if found is None:
        decided = known.select("digest", F.col("node").alias("family"), F.col("low").alias("class_id"))
    else:
        linked = staged(found.withColumnsRenamed({"id": "node", "label": "family"}).join(known, "node"))
        least = linked.groupBy("family").agg(F.min("low").alias("class_id"))
        alone = known.join(linked.select("node"), "node", "left_anti").select("digest", F.col("node").alias("family"), F.col("low").alias("class_id"))
        decided = heavy_join(linked.select("digest", "family"), least, "left", "family").select("digest", "family", "class_id").unionByName(alone)
    # a text may stand in any share of the rows
    return heavy_join(signed.select("id", "digest"), staged(decided), "left", "digest").select("id", "digest", "family", "class_id")


def classes(docs: DataFrame, key: str = "doc_id", text: str = "text", s: Settings = Settings()) -> DataFrame:
    """(key, class_id) per row: the smallest id among the copies and near-copies a row is connected with."""
    return families(docs, key, text, s).select(F.col("id").alias(key), "class_id")


def keep_one(docs: DataFrame, key: str = "doc_id", text: str = "text", s: Settings = Settings()) -> DataFrame:
    """The rows of ``docs`` without near-duplicates: of each family the row of the smallest id (none last), then the smallest digest.

    Rows are told apart by id and text, so rows without an id and ids of several texts are decided like others; one of equal rows stays.
    """
    found = families(docs, key, text, s).groupBy("id", "digest", "family").agg(F.count("*").alias("n"))
    found = staged(found)
    rank = F.struct(F.col("id").isNull(), F.col("id"), F.col("digest"))
    best = found.groupBy("family").agg(F.min(rank).alias("best"), F.count("*").alias("m"))
    several = heavy_join(found, best.where("m > 1").select("family", "best"), "inner", "family")
    gone = staged(several.where(~rank.eqNullSafe(F.col("best"))).select(F.col("id").alias("__id"), F.col("digest").alias("__digest")))
    again = staged(found.where("n > 1").select(F.col("id").alias("__id"), F.col("digest").alias("__digest")))
    marked = docs.withColumn("__own", F.md5(F.coalesce(F.col(f"`{text}`"), F.lit(""))))

    def only(frame: DataFrame, few: DataFrame, how: str) -> DataFrame:
        few = F.broadcast(few) if few.count() <= s.sent else few
        return frame.join(few, F.col(f"`{key}`").eqNullSafe(F.col("__id")) & (F.col("__own") == F.col("__digest")), how)

    kept = only(marked, gone, "left_anti")
    single = only(kept, again, "left_anti")
    one = only(kept, again, "left_semi").dropDuplicates([key, "__own"])
    return single.unionByName(one).select(*[F.col(f"`{c}`") for c in docs.columns])
