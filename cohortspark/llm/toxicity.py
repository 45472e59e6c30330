"""Toxicity by weak supervision.

Voters look at whole texts: a lexicon of insults (one voter per word), and patterns (word beginnings and whole
words) mined from a bounded sample of labelled rows. A voter says "toxic" or abstains. A generative label
model with a hidden class estimates, over all rows that may be learned from, how often each voter speaks in either class
(expectation maximisation; the passes are Spark aggregations of a vector as long as the voter list), and the
correlations of voters inside the classes, from co-vote counts; a voter's log-odds are divided by the votes it
shares with others, so nested patterns do not count twice. A linear classifier on the votes is trained on the
posterior labels of a bounded sample and scores every document.

Texts are read once: the votes of each document are written to the shared folder and serve all later steps.

Defined results: null and empty texts get no votes and the score of the bias; repeated rows are each scored; other
columns are kept; without toxic labels only the lexicon votes, at its prior rates; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cohortspark.llm.common import PARTS, added, blocks
from cohortspark.llm.textnum import Texts, pieces
from cohortspark.session import staged

#: fixed values: general insults
LEXICON = (
    "idiot stupid moron loser scum trash pathetic worthless disgusting clown dumb imbecile fool jerk bastard filth garbage "
    "vermin pig lowlife coward degenerate freak ugly hateful dimwit halfwit nitwit swine traitor"
).split()


@dataclass(frozen=True)
class Settings:
    #: bounds of the labelled samples of either class, of the voters, and of the classifier's rows
    toxic: int = 1500
    clean: int = 3000
    voters: int = 400
    rows: int = 20_000
    #: bytes of the word beginnings that may become patterns; 0 is the whole word
    beginnings: tuple[int, ...] = (4, 5, 6, 7, 8, 0)
    #: a pattern may have to occur so often in a text; a chance hit of a common syllable is no insult
    levels: tuple[int, ...] = (1, 2, 3, 5, 8)
    least_support: int = 3
    least_precision: float = 0.9
    rounds: int = 4
    guess: float = 0.1
    seed: int = 11


def _marks(texts: Texts, n: int) -> np.ndarray:
    """Hashes of word beginnings of n bytes (0 where a word is shorter), or of whole words; never of both kinds alike."""
    return texts.words if n == 0 else texts.prefixes(n)


def _counted(texts: Texts, s: Settings) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, mark, occurrences), each mark once per text."""
    text, mark = [], []
    for n in s.beginnings:
        found = _marks(texts, n)
        there = found != 0
        text.append(texts.text_of_word[there])
        mark.append(found[there])
    pairs = np.zeros(sum(map(len, text)), dtype=[("mark", "u8"), ("text", "i8")])
    pairs["mark"], pairs["text"] = np.concatenate(mark), np.concatenate(text)
    pairs, count = np.unique(pairs, return_counts=True)
    return pairs["text"], pairs["mark"], count


def lexicon(words: list[str] = LEXICON) -> np.ndarray:
    """Marks of whole words, and of their beginnings' forms with a punctuation mark behind."""
    forms = [w + end for w in words for end in ("", ".", ",", "!", "?", ";", ":")]
    return Texts.of(pa.array(forms)).words


#: a voter: the mark it looks for and how often it must occur
VOTER = np.dtype([("mark", "u8"), ("level", "i8")])


def mine(sample: list[tuple[str, int]], s: Settings = Settings()) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Voters, sorted, and per voter the share of toxic and of clean sample texts it speaks on."""
    toxic, clean = [t for t, y in sample if y], [t for t, y in sample if not y]

    def counted(docs: list[str], only: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        parts: list[np.ndarray] = []
        for k in range(0, len(docs), 300):
            _, mark, count = _counted(Texts.of(pa.array(docs[k : k + 300])), s)
            if only is not None:
                inside = np.isin(mark, only)
                mark, count = mark[inside], count[inside]
            for level in s.levels:
                some = np.zeros(int((count >= level).sum()), dtype=VOTER)
                some["mark"], some["level"] = mark[count >= level], level
                parts.append(some)
            if only is None and len(parts) > 20 * len(s.levels):  # keep what can still matter compact
                parts = [np.sort(np.concatenate(parts))]
        return np.unique(np.concatenate(parts), return_counts=True) if parts else (np.zeros(0, VOTER), np.zeros(0, int))

    def looked_up(voters: np.ndarray, table: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
        if not len(table[0]):
            return np.zeros(len(voters))
        at = np.searchsorted(table[0], voters).clip(0, len(table[0]) - 1)
        return np.where(table[0][at] == voters, table[1][at], 0)

    bad = counted(toxic)
    keep = bad[1] >= s.least_support
    voters, yes = bad[0][keep], bad[1][keep]
    good = counted(clean, np.unique(voters["mark"]))
    p, q = yes / max(len(toxic), 1), looked_up(voters, good) / max(len(clean), 1)
    ok = (p + 0.5 / max(len(toxic), 1)) / (p + q + 1 / max(len(toxic), 1)) >= s.least_precision
    # evidence: how much more often it stands in toxic texts, in deviations of the difference
    strength = (p - q) / np.sqrt(p / max(len(toxic), 1) + (q + 1 / max(len(clean), 1)) / max(len(clean), 1) + 1e-12)
    order = np.argsort(-strength[ok], kind="stable")[: s.voters]
    insults = np.array([(m, 1) for m in lexicon()], dtype=VOTER)
    chosen = np.unique(np.concatenate([voters[ok][order], insults]))
    # smoothed, so that a rare voter is not taken for certain
    return chosen, (looked_up(chosen, bad) + 0.5) / (len(toxic) + 1), (looked_up(chosen, good) + 0.5) / (len(clean) + 1)


def _voted(voters: bytes, s: Settings, text: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = np.frombuffer(voters, dtype=VOTER)
        marks, first = np.unique(own["mark"], return_index=True)  # voters of one mark stand together, by level
        size = np.diff(np.append(first, len(own)))
        some = np.zeros(1 << 16, dtype=bool)  # a quick test before the exact search
        some[(marks >> np.uint64(48)).astype(np.int64)] = True
        for batch in batches:
            column = batch.column(batch.schema.get_field_index(text))
            lists = []
            for a, b in pieces(column):
                texts = Texts.of(column.slice(a, b - a))
                hits = []
                for n in s.beginnings:
                    found = _marks(texts, n)
                    may = np.flatnonzero(some[(found >> np.uint64(48)).astype(np.int64)])
                    at = np.searchsorted(marks, found[may]).clip(0, len(marks) - 1)
                    hit = marks[at] == found[may]
                    hits.append(np.stack([texts.text_of_word[may[hit]], at[hit]]))
                pairs, count = np.unique(np.concatenate(hits, axis=1), axis=1, return_counts=True)
                row = np.repeat(pairs[0], size[pairs[1]])
                start = np.cumsum(size[pairs[1]]) - size[pairs[1]]
                voter = np.arange(len(row)) - np.repeat(start - first[pairs[1]], size[pairs[1]])
                speaks = own["level"][voter] <= np.repeat(count, size[pairs[1]])
                row, voter = row[speaks], voter[speaks].astype(np.int32)
                cuts = np.searchsorted(row, np.arange(len(texts) + 1))
                lists += [voter[cuts[i] : cuts[i + 1]] for i in range(len(texts))]
            rest = [(n, batch.column(j)) for j, n in enumerate(batch.schema.names) if n != text]
            votes = pa.array(lists, pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([*(c for _, c in rest), votes], names=[*(n for n, _ in rest), "votes"])

    return run


def vote(docs: DataFrame, voters: np.ndarray, text: str = "text", s: Settings = Settings()) -> DataFrame:
    """The rows with ``votes``, the numbers of the voters that speak, in place of the text column."""
    kept = [f for f in docs.schema.fields if f.name not in (text, "votes")]
    rows = docs.select(*[F.col(f"`{f.name}`") for f in kept], F.col(f"`{text}`").alias("__text"))
    schema = T.StructType([*kept, T.StructField("votes", T.ArrayType(T.IntegerType()))])
    return rows.mapInArrow(_voted(voters.tobytes(), s, "__text"), schema)


def _clamped(p: np.ndarray, known) -> np.ndarray:
    """A known label stands for itself."""
    known = np.asarray(known, dtype=float)
    return np.where(np.isnan(known), p, known)


def _linear(votes, weights: np.ndarray, bias: float) -> np.ndarray:
    logit = np.array([bias + weights[np.asarray(v, dtype=np.int64)].sum() for v in votes], dtype=float)
    return 1 / (1 + np.exp(-logit.clip(-30, 30)))


@dataclass
class LabelModel:
    """Per voter its rates of speaking in toxic and clean texts, the same for "no voter speaks" (the last entry),
    the toxic prior, and the overlap of each two voters (1: they always speak together, 0: as by chance)."""

    yes: np.ndarray
    no: np.ndarray
    prior: float
    overlap: np.ndarray

    def posterior(self, votes) -> np.ndarray:
        """A vote counts its log-odds, divided by the votes in the same text that it overlaps with."""
        weight = np.log(self.yes / self.no)
        base = np.log(self.prior / (1 - self.prior))
        logit = np.full(len(votes), base + weight[-1])
        for i, v in enumerate(votes):
            if len(v):
                at = np.asarray(v, dtype=np.int64)
                logit[i] = base + (weight[at] / self.overlap[np.ix_(at, at)].sum(axis=1)).sum()
        return 1 / (1 + np.exp(-logit.clip(-30, 30)))


def _sums(model: LabelModel, pairs: bool, guess: float):
    """Per task: expected votes by class, and the classes' sizes; with ``pairs`` also the expected co-votes by class."""
    n = len(model.yes) - 1

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        single, double = np.zeros((2, n + 2)), np.zeros((2, n, n) if pairs else (2, 0, 0))
        for batch in batches:
            p = _clamped(model.posterior(batch["votes"].tolist()), batch["known"])
            # a guessed row weighs less than a known one, so that guesses do not confirm themselves
            weight = np.where(batch["known"].isna(), guess, 1.0)
            single[:, n + 1] += (weight * p).sum(), (weight * (1 - p)).sum()
            for v, x, w in zip(batch["votes"], p, weight, strict=True):
                at = np.asarray(v, dtype=np.int64) if len(v) else [n]
                single[0, at] += w * x
                single[1, at] += w * (1 - x)
                if pairs and len(v):
                    double[0][np.ix_(at, at)] += w * x
                    double[1][np.ix_(at, at)] += w * (1 - x)
        yield blocks(np.concatenate([single.ravel(), double.ravel()]), TaskContext.get().partitionId())

    return run


def overlap(both: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """How much two voters say the same beyond chance, from 0 to 1: found inside each class, then averaged by the classes' co-votes.

    ``both`` holds the expected co-votes of every pair by class, ``sizes`` the expected rows of a class with the same row weights. Voters
    that are independent inside the classes have none, however often a class makes both speak.
    """
    total, seen = np.zeros(both.shape[1:]), np.zeros(both.shape[1:])
    for votes, size in zip(both, sizes, strict=True):
        alone = np.maximum(np.diag(votes), 1e-9)
        chance = np.outer(alone, alone) / max(size, 1e-9)
        beyond = (votes - chance) / np.maximum(np.sqrt(np.outer(alone, alone)) - chance, 1e-9)
        total += votes * beyond.clip(0, 1)
        seen += votes
    return total / np.maximum(seen, 1e-9)


def label_model(votes: DataFrame, yes: np.ndarray, no: np.ndarray, prior: float, s: Settings = Settings()) -> LabelModel:
    """Estimated on ``votes`` (a written table: votes, known label or null), from first guesses of the rates.

    What reaches the driver is as long as the voter list, or its square for the co-votes.
    """
    n = len(yes)
    yes0, no0 = np.append(yes, 0.1).clip(1e-4, 0.95), np.append(no, 0.9).clip(1e-6, 0.95)
    model = LabelModel(yes0, no0, prior, np.eye(n))
    for turn in range(s.rounds + 1):
        total = added(votes.select("votes", "known").mapInPandas(_sums(model, turn == 0, s.guess), PARTS))
        if not len(total):
            break
        single = total[: 2 * (n + 2)].reshape(2, n + 2)
        toxic, clean = single[:, n + 1]
        if toxic + clean == 0:
            break
        if turn == 0:  # the co-votes give the overlaps that all rounds use
            model.overlap = overlap(total[2 * (n + 2) :].reshape(2, n, n), single[:, n + 1])
            np.fill_diagonal(model.overlap, 1)
            continue
        # first guesses count as pseudo-observations, so that a voter that never speaks keeps its rates
        model.yes = ((single[0, : n + 1] + 20 * yes0) / (toxic + 20)).clip(1e-4, 0.95)
        model.no = ((single[1, : n + 1] + 20 * no0) / (clean + 20)).clip(1e-6, 0.95)
        model.prior = float(np.clip((toxic + 20 * prior) / (toxic + clean + 20), 1e-4, 0.5))
    return model


def classifier(votes: list, target: np.ndarray, share: np.ndarray, n: int, s: Settings = Settings()) -> tuple[np.ndarray, float]:
    """Logistic regression on votes by stochastic gradient descent against posterior labels."""
    rng = np.random.default_rng(s.seed)
    weights, bias = np.zeros(n), 0.0
    grads = np.full(n, 1e-6)
    for _ in range(8):
        for i in rng.permutation(len(votes)):
            at = np.asarray(votes[i], dtype=np.int64)
            wrong = 1 / (1 + np.exp(-np.clip(bias + weights[at].sum(), -30, 30))) - target[i]
            wrong *= share[i]
            bias -= 0.05 * wrong
            grads[at] += wrong * wrong
            weights[at] -= 0.5 * (wrong + 1e-4 * weights[at]) / np.sqrt(grads[at])
    return weights, bias


def _scored(weights: np.ndarray, bias: float):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield batch.drop(columns=["votes"]).assign(score=_linear(batch["votes"], weights, bias))

    return run


def score(
    docs: DataFrame, labels: DataFrame, label: str, learn: Column, key: str, text: str = "text", s: Settings = Settings()
) -> DataFrame:
    """``docs`` with ``score`` in place of the text. ``labels`` holds key and label; ``learn`` says which keys may teach.

    The sample's keys, a fixed number, are sent to the tasks that read the texts; no text is shuffled.
    """
    may = F.coalesce(learn, F.lit(False))
    order = F.xxhash64(f"`{key}`")
    teach = labels.where(may & F.col(f"`{label}`").isNotNull() & F.col(f"`{key}`").isNotNull())
    teach = teach.select(F.col(f"`{key}`").alias("key"), (F.col(f"`{label}`") != 0).cast("int").alias("y"))
    picked = [teach.where(F.col("y") == y).orderBy(F.xxhash64("key")).limit(most) for y, most in ((1, s.toxic), (0, s.clean))]
    texts = docs.select(F.col(f"`{key}`").alias("key"), F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("text"))
    # one text of each key, that of the smallest hash: repeated ids do not add rows
    found = texts.join(F.broadcast(picked[0].unionByName(picked[1])), "key").groupBy("key", "y")
    rows = found.agg(F.min_by("text", F.struct(F.xxhash64("text"), F.length("text"))).alias("text")).collect()
    sample = sorted((r["text"], r["y"]) for r in rows)
    voters, yes, no = mine(sample, s)
    rates = teach.agg(F.avg("y")).first()[0]
    prior = float(np.clip(0.05 if rates is None else rates, 1e-3, 0.5))
    known = teach.groupBy(F.col("key").alias("__key")).agg(F.max("y").cast("double").alias("known"))
    votes = staged(vote(docs.withColumn("__learn", may).withColumn("__order", order), voters, text, s))
    usable = votes.where("__learn").select("votes", "__order", F.col(f"`{key}`").alias("__key")).join(known, "__key", "left")
    usable = staged(usable.drop("__key"))  # read in every round
    model = label_model(usable, yes, no, prior, s)
    # the classifier's rows: half with votes, half of any kind, by id hash
    picked = []
    for some in (usable.where(F.size("votes") > 0), usable):
        picked += some.orderBy("__order").select("votes", "known").limit(s.rows // 2).collect()
    said, known = [r["votes"] for r in picked], [r["known"] for r in picked]
    share = np.array([s.guess if k is None else 1.0 for k in known])
    weights, bias = classifier(said, _clamped(model.posterior(said), known), share, len(voters), s)
    out = votes.drop("__learn", "__order")
    schema = T.StructType([*[f for f in out.schema.fields if f.name not in ("votes", "score")], T.StructField("score", T.DoubleType())])
    return out.mapInPandas(_scored(weights, bias), schema)
