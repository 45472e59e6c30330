"""Removal of repeated byte strings by suffix sorting of shards.

A byte goes if it lies in a string of ``length`` bytes that also starts earlier: in a document of a smaller id, or earlier in its own. The
whole corpus cannot be sorted in one place, and sorting parts of it apart would miss repeats across parts, so windows (strings of
``length`` bytes at one start) are dealt by content. Each window has an anchor, its gram of ``gram`` bytes with the smallest hash (leftmost among
equals). Equal windows have equal anchors, so all occurrences of a window meet in its anchor's shard. Neighbouring windows of one anchor form a
region, at most ``length - gram + 1`` windows.

1. Whole copies of a document are found by digest; only the first is looked at, the others go wholly.
2. A scan of the first copies sends (anchor, hash of the region, place) to the anchor's shard, packed in arrays. Equal regions are
   combined before the shuffle: all but the first are repeats. So a passage shared by a third of all documents sends one entry per task.
   Grams that hold more than a share of a shard are avoided as anchors wherever a window has another gram, which spreads a frequent line over
   the different texts around it; they are found by bounded counts per task.
3. A shard keeps the first of equal regions. Anchors with several different regions are left: their bytes are read, dealt into shards again
   and sorted there by external induced sorting (``induced``); windows whose common prefix reaches ``length`` are equal, and all
   but the first of them are repeats.
4. Repeats are joined with the documents they lie in, and the uncovered bytes hashed (or returned).

Regions are compared by two independent 64-bit hashes (anchor and region), windows of different regions by their bytes.

Defined results: null texts are empty; texts shorter than ``length`` lose nothing; repeated rows are documents one after the other, so the second
of two rows of one text loses all of it; documents of one id count as documents in the order of a hash of their texts; a null id comes
after all others; other columns are ignored; an empty table gives no rows; a removed run may split a character, so what is kept is bytes.
"""

from __future__ import annotations

import hashlib
import struct
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortspark.llm.induced import Plan, suffix_array
from cohortspark.llm.textnum import mix, pieces
from cohortspark.session import staged

_U = np.uint64
_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)
_PLACE = _U((1 << 22) - 1)


@dataclass(frozen=True)
class Settings:
    length: int = 100
    gram: int = 32
    #: bytes of text behind a shard of places, of regions in a shard to sort, and of one numpy step
    shard: int = 24 << 20
    sorted: int = 2 << 20
    step: int = 1 << 20
    #: places held by a task before they are sent, and places of one row that is sent
    held: int = 400_000
    row: int = 100_000
    #: bytes of texts copied out of a batch at once
    read: int = 8_000_000
    #: an anchor with more than this part of a shard's places is avoided; grams counted per task
    hot: float = 0.05
    counted: int = 4096
    #: ids sent to all tasks up to this number, else joined
    sent: int = 2_000_000
    plan: Plan = field(default_factory=Plan)
    #: classes of a region's windows
    classes: int = 4


def _random_bytes() -> np.ndarray:
    return np.random.default_rng(11).integers(1, 2**63, 256, dtype=np.uint64) * _U(2) + _U(1)


class Rolling:
    """Polynomial hashes of all substrings of a piece, from sums of prefixes."""

    def __init__(self, size: int):
        steps = np.full(size + 1, _BASE, dtype=np.uint64)
        steps[0] = 1
        self.power = np.multiply.accumulate(steps)
        steps[1:] = _INVERSE
        self.inverse = np.multiply.accumulate(steps)
        self.table = _random_bytes()

    def read(self, raw: np.ndarray) -> np.ndarray:
        total = np.zeros(len(raw) + 1, dtype=np.uint64)
        np.cumsum(self.table[raw] * self.power[: len(raw)], out=total[1:])
        return total

    def all(self, total: np.ndarray, n: int) -> np.ndarray:
        return (total[n:] - total[:-n]) * self.inverse[: len(total) - n]

    def some(self, total: np.ndarray, first: np.ndarray, size: np.ndarray) -> np.ndarray:
        return (total[first + size] - total[first]) * self.inverse[first]


def _avoided(h: np.ndarray, hot: np.ndarray) -> np.ndarray:
    """Places of hot grams; a table of low bits first, since hardly any gram is hot."""
    low = np.zeros(1 << 16, dtype=bool)
    low[(hot & _U(0xFFFF)).astype(np.int64)] = True
    at = np.flatnonzero(low[(h & _U(0xFFFF)).astype(np.int64)])
    return at[np.isin(h[at], hot)]


def regions(raw: np.ndarray, valid: np.ndarray, rolling: Rolling, hot: np.ndarray, s: Settings):
    """(anchor, region hash, first window, windows, bytes before the anchor) of a piece; ``valid`` marks the starts of windows that lie in one text."""
    starts = len(raw) - s.length + 1
    if starts <= 0 or not valid[:starts].any():
        none = np.zeros(0, dtype=np.uint64)
        return none, none, *[none.astype(np.int64)] * 3
    total = rolling.read(raw)
    h = mix(rolling.all(total, s.gram)) >> _U(1)
    key = (h & ~_PLACE) | np.arange(len(h), dtype=np.uint64)
    if len(hot):
        key[_avoided(h, hot)] |= _U(1 << 63)
    wide, done = s.length - s.gram + 1, 1
    least = key
    while 2 * done <= wide:
        least = np.minimum(least[:-done], least[done:])
        done *= 2
    if done < wide:
        least = np.minimum(least[: len(least) - (wide - done)], least[wide - done :])
    at = (least & _PLACE).astype(np.int64)[:starts]
    ok = valid[:starts]
    new = ok.copy()
    new[1:] &= ~ok[:-1] | (at[1:] != at[:-1])
    first = np.flatnonzero(new)
    ends = ok.copy()
    ends[:-1] &= ~ok[1:] | new[1:]
    many = np.flatnonzero(ends) - first + 1
    anchor = h[at[first]]
    return anchor, mix(rolling.some(total, first, many + s.length - 1)), first, many, at[first] - first


def _segments(texts: list[bytes], s: Settings) -> Iterator[list[tuple[int, int, int]]]:
    """Groups of (text, begin, end) of about ``step`` bytes; a long text is cut so that every window lies in one part."""
    group, size = [], 0
    for i, t in enumerate(texts):
        for a in range(0, max(len(t) - s.length + 1, 0), s.step):
            b = min(len(t), a + s.step + s.length - 1)
            if size + b - a > s.step + s.length and group:
                yield group
                group, size = [], 0
            group.append((i, a, b))
            size += b - a
    if group:
        yield group


def _scanned(batch: pa.RecordBatch, rolling: Rolling, hot: np.ndarray, s: Settings) -> Iterator[tuple[np.ndarray, ...]]:
    """(anchor, region, id, tie, start, windows, lead) of the rows (id, tie, text) of a batch."""
    for a, b in pieces(batch.column(2), s.read):
        yield from _scanned_part(batch.slice(a, b - a), rolling, hot, s)


def _scanned_part(batch: pa.RecordBatch, rolling: Rolling, hot: np.ndarray, s: Settings) -> Iterator[tuple[np.ndarray, ...]]:
    ids, ties = (batch.column(i).to_numpy(zero_copy_only=False) for i in (0, 1))
    texts = [t.as_buffer().to_pybytes() if t.is_valid else b"" for t in batch.column(2).cast(pa.binary())]
    for group in _segments(texts, s):
        raw = np.frombuffer(b"".join(texts[i][a:b] for i, a, b in group), dtype=np.uint8)
        sizes = np.array([b - a for _, a, b in group])
        begin = np.cumsum(sizes) - sizes
        valid = np.zeros(len(raw), dtype=np.int8)
        valid[begin] += 1
        stop = begin + sizes - s.length + 1
        np.subtract.at(valid, stop[stop < len(raw)], 1)
        valid = np.cumsum(valid, dtype=np.int8).astype(bool)
        anchor, region, first, many, lead = regions(raw, valid, rolling, hot, s)
        part = np.searchsorted(begin, first, side="right") - 1
        row, at = np.array([g[0] for g in group]), np.array([g[1] for g in group])
        yield anchor, region, ids[row[part]], ties[row[part]], first - begin[part] + at[part], many, lead


FIELDS = (("anchor", np.uint64), ("region", np.uint64), ("id", np.int64), ("tie", np.int64), ("start", np.int64), ("many", np.uint8), ("lead", np.uint8))
PACKED = np.dtype(list(FIELDS))
#: kind 0: places for a shard; 1: repeated windows of a document; 2: regions of a document to be sorted
MADE = pa.schema([("kind", pa.int32()), ("shard", pa.int64()), ("id", pa.int64()), ("tie", pa.int64()), ("data", pa.binary())])
MADE_DDL = "kind int, shard bigint, id bigint, tie bigint, data binary"


def _rows(kind: int, shard: np.ndarray, ids: np.ndarray, ties: np.ndarray, data: list[bytes]) -> pa.RecordBatch:
    n = len(data)
    return pa.RecordBatch.from_arrays(
        [pa.array(np.full(n, kind), pa.int32()), pa.array(shard, pa.int64()), pa.array(ids, pa.int64()), pa.array(ties, pa.int64()), pa.array(data, pa.binary())],
        schema=MADE,
    )


def _by_document(kind: int, rows: np.ndarray) -> pa.RecordBatch:
    """One row per document with its entries' (anchor, start, windows)."""
    rows = rows[np.lexsort((rows["start"], rows["tie"], rows["id"]))]
    new = np.append(True, (rows["id"][1:] != rows["id"][:-1]) | (rows["tie"][1:] != rows["tie"][:-1])) if len(rows) else np.zeros(0, bool)
    first = np.flatnonzero(new)
    cut = [*first.tolist(), len(rows)]
    entries = _entries(rows)
    data = [entries[a:b].tobytes() for a, b in zip(cut[:-1], cut[1:], strict=True)]
    return _rows(kind, np.zeros(len(first)), rows["id"][first], rows["tie"][first], data)


ENTRY = np.dtype({"names": ["anchor", "start", "many", "lead"], "formats": [np.uint64, np.int64, np.uint8, np.uint8]})


def _entries(rows: np.ndarray) -> np.ndarray:
    out = np.empty(len(rows), dtype=ENTRY)
    for n in ENTRY.names:
        out[n] = rows[n]
    return out


def combined(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(first of equal regions, the others at other places), sorted by anchor and region."""
    order = np.lexsort((rows["start"], rows["tie"], rows["id"], rows["many"], rows["region"], rows["anchor"]))
    rows = rows[order]
    same = np.zeros(len(rows), dtype=bool)
    same[1:] = (rows["anchor"][1:] == rows["anchor"][:-1]) & (rows["region"][1:] == rows["region"][:-1]) & (rows["many"][1:] == rows["many"][:-1])
    lead = np.maximum.accumulate(np.where(same, 0, np.arange(len(rows)))) if len(rows) else np.zeros(0, np.int64)
    # a row that the table holds twice is one place
    elsewhere = same & ~((rows["id"] == rows["id"][lead]) & (rows["tie"] == rows["tie"][lead]) & (rows["start"] == rows["start"][lead]))
    return rows[~same], rows[elsewhere]


def _taken(held: list[np.ndarray]) -> np.ndarray:
    """What the list holds as one array; the list is emptied, so that nothing is kept twice."""
    rows = np.concatenate(held)
    held.clear()
    return rows


def _sent(shards: int, hot: bytes, s: Settings):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rolling, avoid, held, size = Rolling(s.step + s.length), np.frombuffer(hot, dtype=np.uint64), [], 0

        def flush() -> Iterator[pa.RecordBatch]:
            kept, repeats = combined(_taken(held))
            yield _by_document(1, repeats)
            del repeats
            shard = (kept["anchor"] % _U(shards)).astype(np.int64)
            order = np.lexsort((kept["start"], kept["tie"], kept["id"], shard))
            shard = shard[order]
            first = np.flatnonzero(np.append(True, shard[1:] != shard[:-1])) if len(shard) else np.zeros(0, np.int64)
            for a, b in zip(first.tolist(), [*first[1:].tolist(), len(shard)], strict=True):
                for at in range(a, b, s.row):
                    part = kept[order[at : min(at + s.row, b)]]
                    # column by column: neighbours are alike there, so the shuffle packs them better
                    data = b"".join(np.ascontiguousarray(part[n]).tobytes() for n, _ in FIELDS)
                    yield _rows(0, shard[a : a + 1], np.zeros(1), np.zeros(1), [data])

        for batch in batches:
            for found in _scanned(batch, rolling, avoid, s):
                rows = np.empty(len(found[0]), dtype=PACKED)
                for (name, _), values in zip(FIELDS, found, strict=True):
                    rows[name] = values
                held.append(rows)
                size += len(rows)
                if size > s.held:
                    yield from flush()
                    size = 0
        if size:
            yield from flush()

    return run


WIDTH = sum(np.dtype(t).itemsize for _, t in FIELDS)


def _unpacked(data: bytes | pa.Buffer, keep: np.ndarray | None = None) -> np.ndarray:
    """The places of a row, or those marked in ``keep``."""
    n, at = len(data) // WIDTH, 0
    out = np.empty(n if keep is None else int(keep.sum()), dtype=PACKED)
    for name, kind in FIELDS:
        column = np.frombuffer(data, dtype=kind, count=n, offset=at)
        out[name] = column if keep is None else column[keep]
        at += n * np.dtype(kind).itemsize
    return out


def _several(values: np.ndarray) -> np.ndarray:
    """Marks values that stand in the array more than once."""
    order = np.argsort(values, kind="stable")
    same = values[order[1:]] == values[order[:-1]]
    out = np.zeros(len(values), dtype=bool)
    out[order[1:]] = same
    out[order[:-1]] |= same
    return out


def _matched(rows: pa.Table) -> pa.Table:
    """A shard's repeats by document, and the regions whose anchors have several.

    Anchors come first in a row, so they are read alone; of the places only those of anchors found more than once are unpacked.
    """
    data = [d.as_buffer() for chunk in rows.column("data").chunks for d in chunk]
    anchors = [np.frombuffer(d, dtype=FIELDS[0][1], count=len(d) // WIDTH) for d in data]
    # an anchor found once repeats nothing
    often = _several(np.concatenate(anchors))
    ends = np.cumsum([len(a) for a in anchors])
    found = [_unpacked(d, often[end - len(a) : end]) for d, a, end in zip(data, anchors, ends.tolist(), strict=True)]
    kept, repeats = combined(_taken(found))
    parts = [_by_document(1, repeats)]
    del repeats
    same = kept["anchor"][1:] == kept["anchor"][:-1]
    kept = kept[np.append(False, same) | np.append(same, False)] if len(kept) else kept
    return pa.Table.from_batches([*parts, _by_document(2, kept)])


def _counted(s: Settings):
    """The most frequent anchors of a task, one count per region that the task finds different."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rolling, none = Rolling(s.step + s.length), np.zeros(0, dtype=np.uint64)
        keys, counts = none, np.zeros(0, dtype=np.int64)
        for batch in batches:
            for anchor, region, *_ in _scanned(batch, rolling, none, s):
                one = np.unique(np.stack([anchor, region], axis=1), axis=0)[:, 0] if len(anchor) else none
                more, n = np.unique(one, return_counts=True)
                more, n = more[n > 1], n[n > 1]
                keys, back = np.unique(np.concatenate([keys, more]), return_inverse=True)
                counts = np.bincount(back, np.concatenate([counts, n]), len(keys)).astype(np.int64)
                if len(keys) > 8 * s.counted:
                    top = np.argpartition(counts, -4 * s.counted)[-4 * s.counted :]
                    top.sort()
                    keys, counts = keys[top], counts[top]
        top = np.argsort(-counts, kind="stable")[: s.counted]
        yield pa.RecordBatch.from_arrays([pa.array(keys[top].view(np.int64)), pa.array(counts[top])], names=["anchor", "n"])

    return run


def hot_anchors(texts: DataFrame, shards: int, s: Settings) -> np.ndarray:
    """Anchors with more than a part of a shard's places; at most ``shards / hot`` of them reach the driver."""
    least = int(s.hot * s.shard * 2 / (s.length - s.gram + 2))
    counts = texts.mapInArrow(_counted(s), "anchor bigint, n bigint").groupBy("anchor").agg(F.sum("n").alias("n"))
    return np.array([r["anchor"] for r in counts.where(F.col("n") > least).collect()], dtype=np.int64).view(np.uint64)


def _cut_out(shards: int, s: Settings):
    """The bytes of regions to be sorted, dealt by anchor: rows (id, tie, text, list of entries)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            held: dict[int, list[bytes]] = {}
            for i in range(batch.num_rows):
                text = batch.column(2)[i].as_buffer().to_pybytes()
                place = np.array([batch.column(0)[i].as_py(), batch.column(1)[i].as_py()], dtype=np.int64).tobytes()
                seen = np.unique(np.concatenate([np.frombuffer(d.as_buffer(), dtype=ENTRY) for d in batch.column(3)[i].values]))
                for anchor, start, many, lead in zip(*(seen[n].tolist() for n in ENTRY.names), strict=True):
                    # the anchor's other bits; all its regions go to one shard
                    entry = place + np.array([start, many, lead], dtype=np.int64).tobytes() + text[start : start + many + s.length - 1]
                    held.setdefault((anchor >> 20) % shards, []).append(len(entry).to_bytes(4, "little") + entry)
            if held:
                yield pa.RecordBatch.from_arrays(
                    [pa.array(list(held), pa.int64()), pa.array([b"".join(v) for v in held.values()], pa.binary())], names=["shard", "data"]
                )

    return run


def shared(places: list[tuple], parts: list[bytes], s: Settings) -> tuple[list[tuple], list[bytes], np.ndarray]:
    """The regions cut to what can repeat: (places, bytes) to be sorted, and repeats found on the way.

    A region's windows fall into ``classes`` by the bytes before their anchor; all windows of a class hold the same middle. A class whose
    middle no other region has repeats nothing. Of classes with equal bytes the first stays and the others are repeats.
    """
    wide = s.length - s.gram
    step = -(-(wide + 1) // s.classes)
    own, times = [], Counter()
    for k, ((_, _, _, many, lead), part) in enumerate(zip(places, parts, strict=True)):
        for least in range(0, wide + 1, step):
            # the class holds the windows with least..full bytes before the anchor, this region those with low..most
            full = min(least + step - 1, wide)
            low, most = max(least, lead - many + 1), min(full, lead)
            if low <= most:
                middle = (least, part[lead - least : lead + s.gram + wide - full])
                own.append((k, low, most, middle))
                times[middle] += 1
    first: dict = {}
    cut = []
    for k, low, most, middle in own:
        if times[middle] > 1:
            doc, tie, start, _, lead = places[k]
            a = lead - most
            cut.append(((doc, tie, start + a), most - low + 1, parts[k][a : lead - low + s.length]))
    for place, many, part in cut:
        if (many, part) not in first or place < first[many, part]:
            first[many, part] = place
    repeats = [(*place, many) for place, many, part in cut if place != first[many, part]]
    out = np.zeros(len(repeats), dtype=PACKED)
    for i, name in enumerate(("id", "tie", "start", "many")):
        out[name] = [r[i] for r in repeats]
    return [(*place, many, 0) for (many, _), place in first.items()], [part for _, part in first], out


def _sorted(s: Settings):
    """Repeated windows of a shard's regions by document."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        places, parts = [], []
        for data in rows["data"]:
            at = 0
            while at < len(data):
                size = int.from_bytes(data[at : at + 4], "little")
                places.append(struct.unpack_from("<5q", data, at + 4))
                parts.append(data[at + 44 : at + 4 + size])
                at += 4 + size
        places, parts, found = shared(places, parts, s)
        if not parts:
            return pa.Table.from_batches([_by_document(1, found)]).to_pandas()
        place = np.array(places, dtype=np.int64)
        sizes = np.array([len(p) + 1 for p in parts])
        first = np.cumsum(sizes) - sizes
        text = np.zeros(int(sizes.sum()) + 1, dtype=np.int32)
        text[:-1] = np.frombuffer(b"\0".join(parts) + b"\0", dtype=np.uint8)
        text[:-1] += 2
        text[first + sizes - 1] = 1  # between regions
        order, common = suffix_array(text, s.length, s.plan)
        # of the suffixes only the windows' starts matter; equal windows stand together
        owner = np.full(len(text), -1, dtype=np.int32)
        n = place[:, 3]
        starts = np.repeat(first, n) + np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
        owner[starts] = np.repeat(np.arange(len(parts)), n)
        group = np.cumsum(common < s.length, dtype=np.int32)
        own = owner[order] >= 0
        at, group = order[own], group[own]
        who = owner[at]
        begin = place[who, 2] + at - first[who]
        _, document = np.unique(place[:, :2], axis=0, return_inverse=True)  # in order of id and tie
        rank = np.lexsort((begin, document[who], group))
        at, group, who, begin = at[rank], group[rank], who[rank], begin[rank]
        lead = np.maximum.accumulate(np.where(np.append(True, group[1:] != group[:-1]), np.arange(len(group)), 0))
        repeat = (document[who] != document[who[lead]]) | (begin != begin[lead])
        out = np.zeros(int(repeat.sum()), dtype=PACKED)
        out["id"], out["tie"] = place[who[repeat], 0], place[who[repeat], 1]
        out["start"], out["many"] = begin[repeat], 1
        return pa.Table.from_batches([_by_document(1, np.concatenate([found, out]))]).to_pandas()

    return run


def _kept(s: Settings):
    """(id, tie, n_removed, spans, kept) of rows (id, tie, text, list of entries)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            removed, spans, kept = [], [], []
            for i in range(batch.num_rows):
                text = batch.column(2)[i].as_buffer().to_pybytes()
                found = np.concatenate([np.frombuffer(d.as_buffer(), dtype=ENTRY) for d in batch.column(3)[i].values])
                first = np.sort(found["start"])
                end = found["start"] + found["many"] + s.length - 1
                end = np.maximum.accumulate(end[np.argsort(found["start"], kind="stable")])
                new = np.append(True, first[1:] > end[:-1])
                a, b = first[new], end[np.append(new[1:], True)]
                spans.append([{"begin": x, "end": y} for x, y in zip(a.tolist(), b.tolist(), strict=True)])
                removed.append(int((b - a).sum()))
                edges = [0, *np.stack([a, b], axis=1).ravel().tolist(), len(text)]
                kept.append(b"".join(text[x:y] for x, y in zip(edges[::2], edges[1::2], strict=True)))
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    batch.column(1),
                    pa.array(removed, pa.int64()),
                    pa.array(spans, pa.list_(pa.struct([("begin", pa.int64()), ("end", pa.int64())]))),
                    pa.array([hashlib.sha256(k).hexdigest() for k in kept], pa.string()),
                ],
                names=["id", "tie", "n_removed", "spans", "kept_sha256"],
            )

    return run


def _only(frame: DataFrame, keys: DataFrame, s: Settings, how: str = "left_semi") -> DataFrame:
    """Rows of (id, tie) in (or not in) ``keys``; a small list of keys is sent instead of shuffling texts."""
    keys = staged(keys.select("id", "tie"))
    return frame.join(F.broadcast(keys) if keys.count() <= s.sent else keys, ["id", "tie"], how)


def remove_repeats(docs: DataFrame, key: str = "doc_id", text: str = "text", s: Settings = Settings()) -> DataFrame:
    """(key, n_bytes, n_removed, spans, kept_sha256) per row; ``spans`` are the maximal removed runs as (begin, end) bytes."""
    k: Column = F.col(f"`{key}`").cast("bigint")
    whole = docs.select(
        F.coalesce(k, F.lit(2**63 - 1)).alias("id"),
        F.xxhash64(F.coalesce(F.col(f"`{text}`"), F.lit(""))).alias("tie"),
        k.alias("key"),
        F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("text"),
    )
    size = F.octet_length("text").cast("bigint")
    rows = staged(
        whole.groupBy("id", "tie", "key", F.sha2("text", 256).alias("digest"), size.alias("n_bytes")).agg(F.count("*").alias("n"))
    )
    owner = rows.groupBy("digest").agg(F.min("id").alias("first"), F.count("*").alias("m")).where("m > 1").select("digest", "first")
    marked = rows.join(owner, "digest", "left").withColumn("copy", F.coalesce(F.col("id") != F.col("first"), F.lit(False)))
    marked = staged(marked.drop("first"))
    long = whole.where(size >= s.length).select("id", "tie", "text")
    texts = _only(long, marked.where("copy"), s, "left_anti")
    total = marked.where(~F.col("copy") & (F.col("n_bytes") >= s.length)).agg(F.coalesce(F.sum("n_bytes"), F.lit(0))).first()[0]
    shards = max(1, -(-int(total) // s.shard))
    hot = hot_anchors(texts, shards, s).tobytes()
    sent = staged(texts.mapInArrow(_sent(shards, hot, s), MADE_DDL))
    met = staged(sent.where("kind = 0").select("shard", "data").groupBy("shard").applyInArrow(_matched, MADE_DDL))
    regions_ = met.where("kind = 2").groupBy("id", "tie").agg(F.collect_list("data").alias("found"))
    size_ = F.length("data") / ENTRY.itemsize * (1.5 * s.length)
    parts = max(1, int((met.where("kind = 2").agg(F.sum(size_)).first()[0] or 0) // s.sorted) + 1)
    asked = _only(texts, regions_, s).dropDuplicates(["id", "tie"]).join(regions_, ["id", "tie"])
    cut = asked.select("id", "tie", F.col("text").cast("binary").alias("text"), "found").mapInArrow(_cut_out(parts, s), "shard bigint, data binary")
    last = cut.groupBy("shard").applyInPandas(_sorted(s), MADE_DDL)
    repeats = sent.where("kind = 1").unionByName(met.where("kind = 1")).unionByName(last).select("id", "tie", "data")
    repeats = staged(repeats)
    marks = repeats.groupBy("id", "tie").agg(F.collect_list("data").alias("found"))
    hit = _only(texts, repeats.select("id", "tie").distinct(), s).dropDuplicates(["id", "tie"]).join(marks, ["id", "tie"])
    spans = "array<struct<begin: bigint, end: bigint>>"
    cleaned = hit.select("id", "tie", F.col("text").cast("binary").alias("text"), "found").mapInArrow(
        _kept(s), f"id bigint, tie bigint, n_removed bigint, spans {spans}, kept_sha256 string"
    )
    out = marked.join(cleaned, ["id", "tie"], "left")
    # of the rows of one document and text, the first stays as found and the others are copies of it
    at = F.explode(F.sequence(F.lit(1).cast("bigint"), F.col("n"))).alias("__at")
    out = out.select("*", at)
    gone = (F.col("copy") | (F.col("__at") > 1)) & (F.col("n_bytes") >= s.length)
    all_ = F.array(F.struct(F.lit(0).cast("bigint").alias("begin"), F.col("n_bytes").alias("end")))
    return out.select(
        F.col("key").alias(key),
        "n_bytes",
        F.when(gone, F.col("n_bytes")).otherwise(F.coalesce("n_removed", F.lit(0))).cast("bigint").alias("n_removed"),
        F.when(gone, all_).otherwise(F.coalesce("spans", F.array().cast(spans))).alias("spans"),
        F.when(gone, hashlib.sha256(b"").hexdigest()).otherwise(F.coalesce("kept_sha256", "digest")).alias("kept_sha256"),
    )
