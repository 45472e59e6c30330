"""From raw documents to packed training sequences: rules, classifier, near-duplicates, packing.

Each stage takes (spark, docs, sf_dir), works on all rows its predecessor kept and returns the columns of ``documents``, the last one
the places of all pieces. Stages may meet null texts (empty, so the rules reject them), repeated rows (one stays) and empty tables;
columns besides doc_id and text are passed on. Rows are told apart by id and text, so one of several equal rows stays, rows without
a doc_id are decided like others, and an id that stands for different texts loses none of them. Stages that work in Python lower the
session's rows of an Arrow batch (``session.small_batches``), which holds whole texts.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from cohortspark.llm import neardup, quality_rules
from cohortspark.llm.common import table
from cohortspark.llm.queries import packed, quality_scores
from cohortspark.session import small_batches, staged

#: a stage that SQL cannot express is tested against a brute-force version
ORACLE_SQL = None


def follow_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rules and the threshold table."""
    return quality_rules.keep(docs)


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, learned from the folder's labels, scores at 0.7 or more."""
    small_batches(spark)
    scored = quality_scores(spark, sf_dir, docs, keep_text=True)
    return scored.where("score >= 0.7").select(*docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of copies and near-copies: that of the smallest id, or of the smallest digest where none has one."""
    small_batches(spark)
    return neardup.keep_one(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The places of all pieces of all documents in sequences of at most 1024 tokens."""
    small_batches(spark)
    return packed(docs)


STAGES = [
    ("quality_rules", follow_rules),
    ("quality_classifier", keep_quality),
    ("minhash_neardup", drop_near_duplicates),
    ("best_fit_packing", pack_sequences),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in order over ``documents``; what a stage keeps is written once and read by the next."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = staged(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
