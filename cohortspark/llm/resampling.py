"""Importance resampling towards a target text set, by an Aho-Corasick dictionary of words with CRC payloads.

A feature is a run of 1 to ``longest`` consecutive words, and its bucket the CRC-32 of its bytes modulo ``buckets``. The dictionary holds the
corpus's most frequent distinct words (exact counts over all texts; ``words`` bounds what is sent to the tasks), each bounded by a
delimiter on both sides and carrying a payload: the CRC and the length of its bytes. One scan of the automaton over a text emits the payloads
of its words in order; a word that no payload covers is found as the gap it leaves and gets its payload from its own bytes,
so the dictionary's size decides the speed only. The CRC of a longer run is composed from neighbouring payloads without touching
the text again: appending ``n`` bytes shifts the CRC register by ``n`` zero bytes, a linear map applied by tables for powers of two.

The scan runs twice: tasks count buckets of corpus and target (a fixed-length vector per task, added in a tree), then every text is
weighed by the floored mean of its buckets' gains and scored with the noise of its id. The highest scores of all eligible texts are
numbered by a range-partitioned order, so no task and not the driver holds them.

Defined results: null texts have no words; texts without features weigh 0; repeated rows count and are scored each (the same score; one is
ranked before the other); a null id takes the noise of empty text and comes last among ties; other columns are kept, those named like a result
are replaced; without eligible texts nothing is drawn; an empty table gives no rows; an empty target counts as zero everywhere.
"""

from __future__ import annotations

import hashlib
import math
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import ahocorasick
import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cohortspark.llm.common import PARTS, added, blocks, most_frequent
from cohortspark.llm.textnum import pieces
from cohortspark.operators.ordering import global_order
from cohortspark.session import staged


@dataclass(frozen=True)
class Settings:
    #: longest run of words, and number of buckets
    longest: int = 1
    buckets: int = 10_000
    #: texts of fewer words are never drawn; the share drawn, in hundredths; the prefix of the noise
    least_words: int = 20
    percent: int = 10
    salt: str = "2024:"
    #: words of the dictionary
    words: int = 65_536
    #: bytes of one scan
    scan: int = 1_000_000


#: word bytes as they are with A-Z in lower case, all others as a space
_PLAIN = bytes(
    b + 32 if 0x41 <= b <= 0x5A else b if 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80 else 0x20 for b in range(256)
)


def plain(text: str | None) -> bytes:
    """The text's words as bytes between spaces."""
    return (text or "").encode("utf-8", "surrogatepass").translate(_PLAIN)


class Shift:
    """CRC-32 registers after runs of zero bytes: four 256-entry tables per power of two of the run's length."""

    def __init__(self) -> None:
        byte = np.arange(256, dtype=np.uint32)
        for _ in range(8):
            byte = np.where(byte & 1, (byte >> 1) ^ np.uint32(0xEDB88320), byte >> 1).astype(np.uint32)
        one = [(np.arange(256, dtype=np.uint32) << np.uint32(8 * j)) for j in range(4)]
        self.tables = [[byte[v & 255] ^ (v >> np.uint32(8)) for v in one]]

    @staticmethod
    def _by(tables: list[np.ndarray], crc: np.ndarray) -> np.ndarray:
        out = tables[0][crc & 255]
        for j in (1, 2, 3):
            out = out ^ tables[j][(crc >> np.uint32(8 * j)) & 255]
        return out

    def __call__(self, crc: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        crc, k = crc.copy(), 0
        while lengths.any():
            if k == len(self.tables):
                self.tables.append([self._by(self.tables[-1], t) for t in self.tables[-1]])
            odd = (lengths & 1).astype(bool)
            crc[odd] = self._by(self.tables[k], crc[odd])
            lengths, k = lengths >> 1, k + 1
        return crc


class Scanner:
    """The automaton over delimiter-bounded words with its payloads."""

    def __init__(self, words: list[bytes]):
        self.automaton = ahocorasick.Automaton()
        # one character per byte, so places are byte places
        for i, word in enumerate(words):
            self.automaton.add_word(f" {word.decode('latin-1')} ", i)
        if words:
            self.automaton.make_automaton()
        self.crc = np.array([zlib.crc32(w) for w in words], dtype=np.uint32)
        self.length = np.array([len(w) for w in words], dtype=np.int64)
        self.shift = Shift()
        self.space = np.uint32(zlib.crc32(b" "))

    def payloads(self, data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(place, CRC, length) of every word of space-separated words, in order."""
        text = b" " + data + b" "
        found = list(self.automaton.iter(text.decode("latin-1"))) if len(self.crc) else []
        hits = np.array(found, dtype=np.int64).reshape(-1, 2)
        which = hits[:, 1]
        length = self.length[which]
        place, crc = hits[:, 0] - length, self.crc[which]
        # what the payloads leave uncovered are words outside the dictionary
        inside = np.frombuffer(text, dtype=np.uint8) != 32
        rest = inside.astype(np.int8)
        if int(length.sum()) == int(inside.sum()):
            return place - 1, crc, length
        edge = np.zeros(len(rest) + 1, dtype=np.int8)
        edge[place] += 1
        edge[place + length] -= 1
        rest -= np.cumsum(edge[:-1], dtype=np.int8)
        step = np.diff(rest, prepend=np.int8(0), append=np.int8(0))
        first, last = np.flatnonzero(step > 0), np.flatnonzero(step < 0)
        own = np.array([zlib.crc32(text[a:b]) for a, b in zip(first.tolist(), last.tolist(), strict=True)], dtype=np.uint32)
        place, crc, length = (
            np.concatenate(x) for x in ((place, first), (crc, own), (length, last - first))
        )
        order = np.argsort(place, kind="stable")
        return place[order] - 1, crc[order], length[order]

    def runs(self, crc: np.ndarray, length: np.ndarray, first: np.ndarray, longest: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Per run length (text of each run, its CRC), composed from the words' payloads; ``first`` cuts the words into texts."""
        text = np.repeat(np.arange(len(first) - 1), np.diff(first))
        yield text, crc
        led = self.shift(np.full(len(crc), self.space), length) ^ crc  # a space, then the word
        now = crc
        for m in range(1, longest):
            if len(crc) <= m:
                return
            now = self.shift(now[:-1], length[m:] + 1) ^ led[m:]
            whole = text[:-m] == text[m:]
            yield text[:-m][whole], now[whole]

    def texts(self, column: pa.Array, s: Settings) -> Iterator[tuple[int, np.ndarray, list[tuple[np.ndarray, np.ndarray]]]]:
        """Per piece of a column: (first row, words per text, runs by length)."""
        for a, b in pieces(column, s.scan):
            parts = [plain(t.as_py()) for t in column.slice(a, b - a)]
            ends = np.cumsum([len(p) + 1 for p in parts])
            place, crc, length = self.payloads(b" ".join(parts))
            first = np.concatenate([[0], np.searchsorted(place, ends)])
            yield a, np.diff(first), list(self.runs(crc, length, first, s.longest))


def _words_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def rows(counts: Counter) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays(
            [pa.array(list(counts), pa.binary()), pa.array(list(counts.values()), pa.int64())], names=["word", "n"]
        )

    counts: Counter = Counter()
    for batch in batches:
        for text in batch.column(0):
            counts.update(plain(text.as_py()).split())
            if len(counts) > 200_000:
                yield rows(counts)
                counts = Counter()
    yield rows(counts)


def dictionary(texts: DataFrame, text: str = "text", s: Settings = Settings()) -> list[bytes]:
    """The ``s.words`` most frequent distinct words of all texts, ties by their bytes."""
    found = texts.select(F.col(f"`{text}`")).mapInArrow(_words_of, "word binary, n bigint")
    counts = staged(found.groupBy("word").agg(F.sum("n").alias("n")))
    return [bytes(r["word"]) for r in most_frequent(counts, "word", "n", s.words)]


_PARTS = pa.schema([("part", pa.int32()), ("block", pa.int32()), ("data", pa.binary())])


def _tallied(words: bytes, s: Settings):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner, total = Scanner(words.split()), np.zeros(s.buckets, dtype=np.int64)
        for batch in batches:
            for _, _, runs in scanner.texts(batch.column(0), s):
                for _, crc in runs:
                    total += np.bincount(crc % np.uint32(s.buckets), minlength=s.buckets)
        rows: pd.DataFrame = blocks(total, TaskContext.get().partitionId())
        yield pa.RecordBatch.from_pandas(rows, _PARTS, preserve_index=False)

    return run


def tally(texts: DataFrame, words: list[bytes], text: str = "text", s: Settings = Settings()) -> np.ndarray:
    """How many features of all texts fall into each bucket (exact below 2^53)."""
    total = added(texts.select(F.col(f"`{text}`")).mapInArrow(_tallied(b" ".join(words), s), PARTS))
    return total.astype(np.int64) if len(total) else np.zeros(s.buckets, dtype=np.int64)


def gains(corpus: np.ndarray, target: np.ndarray) -> np.ndarray:
    """floor(1000 ln((t+1)(S+B) / ((s+1)(T+B)))) per bucket, in doubles."""
    b, s_all, t_all = len(corpus), float(corpus.sum()), float(target.sum())
    return np.array(
        [
            math.floor(1000 * math.log(float(t + 1) * (s_all + b) / (float(s + 1) * (t_all + b))))
            for s, t in zip(corpus.tolist(), target.tolist(), strict=True)
        ],
        dtype=np.int64,
    )


def noise(key: object, salt: str) -> int:
    """floor(-1000 ln(-ln u)) for u in (0, 1) from the first 32 bits of the salted id's SHA-256."""
    h = int(hashlib.sha256(f"{salt}{'' if key is None else key}".encode()).hexdigest()[:8], 16)
    return math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))


def _weighed(words: bytes, gain: np.ndarray, key: str, text: str, s: Settings):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(words.split())
        for batch in batches:
            names = batch.schema.names
            rest = [n for n in names if n != text]
            for a, n_words, runs in scanner.texts(batch.column(names.index(text)), s):
                part, n = batch.slice(a, len(n_words)), len(n_words)
                total, features = np.zeros(n, dtype=np.int64), np.zeros(n, dtype=np.int64)
                for owner, crc in runs:
                    np.add.at(total, owner, gain[crc % np.uint32(s.buckets)])
                    features += np.bincount(owner, minlength=n)
                weight = np.where(features > 0, total // np.maximum(features, 1), 0)
                drawn = np.array([noise(k, s.salt) for k in part.column(names.index(key)).to_pylist()], dtype=np.int64)
                made = [pa.array(x, pa.int64()) for x in (n_words, features, weight, weight + drawn)]
                yield pa.RecordBatch.from_arrays(
                    [*(part.column(names.index(c)) for c in rest), *made],
                    names=[*rest, "__words", "n_features", "weight", "score"],
                )

    return run


MADE = ("n_features", "weight", "score", "rank")


def resample(
    docs: DataFrame, target: DataFrame, key: str = "doc_id", text: str = "text", target_text: str = "text", s: Settings = Settings()
) -> DataFrame:
    """The rows with n_features, weight, score and rank in place of the text; rank is null for texts that are not drawn."""
    words = dictionary(docs, text, s)
    gain = gains(tally(docs, words, text, s), tally(target, words, target_text, s))
    kept = [f for f in docs.schema.fields if f.name != text and f.name not in (*MADE, "__words")]
    made = [T.StructField(n, T.LongType()) for n in ("__words", *MADE[:3])]
    rows = docs.select(*[F.col(f"`{f.name}`") for f in kept], F.col(f"`{text}`"))
    scored = staged(rows.mapInArrow(_weighed(b" ".join(words), gain, key, text, s), T.StructType([*kept, *made])))
    able = scored.where(F.col("__words") >= s.least_words)
    quota = s.percent * able.count() // 100
    ranked = global_order(able, [F.col("score").desc(), F.col(f"`{key}`").asc_nulls_last()], "rank")
    ranked = ranked.withColumn("rank", F.when(F.col("rank") <= quota, F.col("rank")))
    rest = scored.where(F.col("__words") < s.least_words).withColumn("rank", F.lit(None).cast("bigint"))
    return ranked.unionByName(rest).drop("__words")
