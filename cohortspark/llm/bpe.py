"""Byte-level BPE encoding and decoding of whole texts by a rank file.

Long texts are cut into overlapping chunks that are pre-tokenised in parallel. Two scans of one text agree for
good once both start a match at the same place, so neighbouring chunks are stitched at the first such place
in their overlap whose previous character is no white space (there a cut changes no match before it). The
pieces between the stitches are encoded by themselves, and their ids are put together in order. If an
overlap has no such place (one match spans it), the two chunks become one piece. Decoding concatenates raw bytes.

Inside a piece, a space between two other characters always starts a match, so a piece is split at such
spaces and each distinct part is encoded once per task (``PartEncoder``); texts with other runs of white
space are encoded as they are.

Defined results: a null or empty text has no ids and decodes to no bytes; repeated rows are each encoded;
other columns are kept; an empty table gives no rows.
"""

from __future__ import annotations

import base64
import re
from array import array
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import regex
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cohortspark.session import staged

#: a space that does not simply separate two characters that are no white space
ODD_SPACE = re.compile(r"\s |^ | (?:\s|$)")
CHUNK, OVERLAP = 60_000, 4_000
#: rows of an Arrow batch that are split at once
ROWS = 400


def encoding(path: str, pattern: str, special: tuple[tuple[str, int], ...] = ()) -> tiktoken.Encoding:
    with open(path, "rb") as lines:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
    return tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens=dict(special))


class PartEncoder:
    """Encodes batches of texts; ids come as the bytes of native unsigned 32-bit integers."""

    def __init__(self, path: str, pattern: str, special: tuple[tuple[str, int], ...] = (), keep: int = 150_000):
        self.encoding, self.keep = encoding(path, pattern, special), keep
        self.allowed = {s for s, _ in special}
        self.known: dict[str, bytes] = {}
        n = self.encoding.max_token_value + 1
        self.widths = np.zeros(n, dtype=np.int64)
        for token, rank in self.encoding._mergeable_ranks.items():
            self.widths[rank] = len(token)
        for text, rank in special:
            self.widths[rank] = len(text.encode())

    def _whole(self, text: str) -> array:
        return array("I", self.encoding.encode(text, allowed_special=self.allowed, disallowed_special=()))

    def _learn(self, parts: list[str]) -> None:
        """Encode parts that each start with a space before another character: one call, cut by widths."""
        ids = np.frombuffer(self._whole("".join(parts)), dtype=np.uint32)
        ends = np.cumsum(np.fromiter((len(p.encode()) for p in parts), dtype=np.int64, count=len(parts)))
        cuts = np.searchsorted(np.cumsum(self.widths[ids]), ends) + 1
        data, at = ids.tobytes(), 0
        for part, cut in zip(parts, (4 * cuts).tolist(), strict=True):
            self.known[part] = data[at:cut]
            at = cut

    def batch(self, texts: list[str]) -> list[bytes]:
        if len(self.known) > self.keep:
            self.known.clear()
        split: list[list[str] | None] = []
        new: set[str] = set()
        for text in texts:
            if not text or ODD_SPACE.search(text):
                split.append(None)
                continue
            parts = text.replace(" ", "\0 ").split("\0") if "\0" not in text else None
            split.append(parts)
            if parts:
                new.update(parts[1:])
        if new := [p for p in new if p not in self.known]:
            self._learn(new)
        out = []
        for text, parts in zip(texts, split, strict=True):
            if not parts:
                out.append(self._whole(text).tobytes())
            else:
                out.append(self._whole(parts[0]).tobytes() + b"".join(map(self.known.__getitem__, parts[1:])))
        return out


def _starts(pattern: regex.Pattern, text: str) -> list[int]:
    """Where matches start; the last match may go on after the text, so it is left out."""
    return [m.start() for m in pattern.finditer(text)][:-1]


def _chunk_marks(pattern: str, overlap: int):
    """Per chunk: places, in its first and its last ``overlap`` characters, where a match may be cut off."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        match = regex.compile(pattern)
        for chunks in batches:
            head, tail = [], []
            for text, start, last in zip(chunks["chunk"], chunks["start"], chunks["last"], strict=True):
                safe = [p for p in _starts(match, text) if p == 0 or not text[p - 1].isspace()]
                head.append([start + p for p in safe if 0 < p < overlap])
                tail.append([] if last else [start + p for p in safe if p >= len(text) - overlap])
            yield pd.DataFrame(
                {"row": chunks["row"], "k": chunks["k"], "head": head, "tail": tail}
            )

    return run


def _pieces(long: DataFrame, pattern: str, chunk: int, overlap: int) -> DataFrame:
    """(__row, __piece, __text): long texts cut where the scans of neighbouring chunks agree."""
    n = F.length("__text")
    step = F.col("k") * chunk
    numbers = F.sequence(F.lit(0).cast("bigint"), F.floor((n - 1) / chunk))
    chunks = long.select(F.col("__row").alias("row"), "__text", F.explode(numbers).alias("k")).select(
        "row",
        "k",
        step.alias("start"),
        F.substring(F.col("__text"), (step + 1).cast("int"), F.lit(chunk + overlap)).alias("chunk"),
        (step + chunk + overlap >= n).alias("last"),
    )
    # a chunk's overlap is the head of the next chunk; the repartition spreads one text's chunks
    marks = chunks.repartition("row", "k").mapInPandas(
        _chunk_marks(pattern, overlap), "row bigint, k bigint, head array<bigint>, tail array<bigint>"
    )
    # the same marks serve as left and right side: one pass, grouped by the pair of chunks they belong to
    sides = marks.select(
        "row",
        F.explode(
            F.array(
                F.struct(F.col("k").alias("pair"), F.col("tail").alias("tail"), F.lit(None).cast("array<bigint>").alias("head")),
                F.struct((F.col("k") - 1).alias("pair"), F.lit(None).cast("array<bigint>").alias("tail"), F.col("head")),
            )
        ).alias("side"),
    ).select("row", "side.*")
    cuts = sides.groupBy("row", "pair").agg(F.first("tail", True).alias("tail"), F.first("head", True).alias("head"))
    cuts = cuts.select("row", "pair", F.array_min(F.array_intersect("tail", "head")).alias("cut")).where("cut is not null")
    cuts = cuts.groupBy("row").agg(F.sort_array(F.collect_list(F.struct("pair", "cut"))).alias("cuts"))
    # a scan is proven only by an unbroken chain of cuts from the start; after a gap the rest is one piece
    proven = F.transform(F.filter("cuts", lambda x, i: x["pair"] == i), lambda x: x["cut"])
    cuts = cuts.select("row", proven.alias("cuts"))
    none = F.array().cast("array<bigint>")
    bounds = F.concat(F.array(F.lit(0).cast("bigint")), F.coalesce("cuts", none), F.array(n.cast("bigint")))
    cut = long.join(cuts, F.col("__row") == F.col("row"), "left").withColumn("bounds", bounds)
    cut = cut.select("__row", "__text", "bounds", F.posexplode(F.slice("bounds", 1, F.size("bounds") - 1)).alias("k", "at"))
    return cut.select(
        "__row",
        F.col("k").alias("__piece"),
        F.substring("__text", (F.col("at") + 1).cast("int"), (F.get("bounds", F.col("k") + 1) - F.col("at")).cast("int")).alias(
            "__text"
        ),
    ).repartition("__row", "__piece")


def _lists(rows: list[bytes]) -> pa.Array:
    sizes = np.fromiter((len(r) // 4 for r in rows), dtype=np.int64, count=len(rows))
    offsets = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.frombuffer(b"".join(rows), dtype=np.int32)))


def _encoded(path: str, pattern: str, special: tuple[tuple[str, int], ...], text: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = PartEncoder(path, pattern, special)
        for whole in batches:
            at = whole.schema.get_field_index(text)
            for k in range(0, whole.num_rows, ROWS):
                batch = whole.slice(k, ROWS)
                ids = encoder.batch([t or "" for t in batch.column(at).to_pylist()])
                rest = [(n, batch.column(j)) for j, n in enumerate(batch.schema.names) if j != at]
                yield pa.RecordBatch.from_arrays([*(c for _, c in rest), _lists(ids)], names=[*(n for n, _ in rest), "ids"])

    return run


def encode(
    df: DataFrame,
    path: str,
    pattern: str,
    text: str = "text",
    special: tuple[tuple[str, int], ...] = (),
    chunk: int = CHUNK,
    overlap: int = OVERLAP,
) -> DataFrame:
    """The rows with ``ids`` (array of int) in place of the text column.

    ``chunk`` and ``overlap`` count characters; a text of at most their sum is encoded where it is read. The
    longer ones are staged once, so that their row numbers hold, and only they are shuffled.
    """
    kept = [c for c in df.columns if c not in (text, "ids")]
    maker = _encoded(path, pattern, special, "__text")

    def made(rows: DataFrame) -> DataFrame:
        fields = [f for f in rows.schema.fields if f.name != "__text"]
        return rows.mapInArrow(maker, T.StructType([*fields, T.StructField("ids", T.ArrayType(T.IntegerType()))]))

    texts = df.select(*[F.col(f"`{c}`") for c in kept], F.col(f"`{text}`").alias("__text"))
    short = made(texts.where(F.coalesce(F.length("__text"), F.lit(0)) <= chunk + overlap))
    long = staged(texts.where(F.length("__text") > chunk + overlap).withColumn("__row", F.monotonically_increasing_id()))
    pieces = made(_pieces(long.select("__row", "__text"), pattern, chunk, overlap))
    ids = pieces.groupBy("__row").agg(
        F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("__piece", "ids"))), lambda x: x["ids"])).alias("ids")
    )
    return short.unionByName(long.drop("__text").join(ids, "__row").drop("__row"))


def _decoded(path: str, pattern: str, special: tuple[tuple[str, int], ...]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decode = encoding(path, pattern, special).decode_bytes
        for whole in batches:
            for k in range(0, whole.num_rows, ROWS):
                batch = whole.slice(k, ROWS)
                ids = batch.column(batch.schema.get_field_index("ids"))
                made = pa.array([decode(x or []) for x in ids.to_pylist()], pa.binary())
                yield pa.RecordBatch.from_arrays([*batch.columns, made], names=[*batch.schema.names, "decoded"])

    return run


def decode(df: DataFrame, path: str, pattern: str, special: tuple[tuple[str, int], ...] = ()) -> DataFrame:
    """The rows with ``decoded``: the raw bytes that their ``ids`` stand for."""
    schema = T.StructType([*df.schema.fields, T.StructField("decoded", T.BinaryType())])
    return df.mapInArrow(_decoded(path, pattern, special), schema)
